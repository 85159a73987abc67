"""Greedy rules over keys of any size: pairs that clash, and the choice by rank as rounds over their graph.

A greedy pass keeps a row unless it clashes with a better one that it kept. Its
result is the lexicographically first independent set of the graph of clashes,
which rounds find without a pass: a row all of whose better neighbours are
dropped is kept, and its worse neighbours then drop. A chain of clashes is
settled link by link; for ranks that are independent of the graph the number of
rounds grows with the square of the logarithm of the rows (Blelloch, Fineman and
Shun, 2012). Each round is written to the shared folder; no key is ever gathered.

Pairs of cells of more than `FEW` comparisons are compared by tasks of two blocks of up to `BLOCK` rows: a product of
matrices of single precision leaves out pairs that are certainly apart, the others are summed as `vec.dot` does.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from weftline.functions import vec
from weftline.sources.scratch import cut

#: Similarity from which pivots are worth their copies: below, a ring around a pivot holds nearly all vectors.
PIVOTS_FROM = 0.6
#: Room for rounding of an angle.
_SLACK = 1e-6
#: Comparisons of a cell with its neighbours up to which rows are joined; rows of a block, and of one product of matrices.
FEW, BLOCK, STEP = 4_096, 4_096, 512
#: Cells up to which their sizes are broadcast.
CELLS = 100_000


def celled(rows: DataFrame, key: list[str], pose: float, similarity: float) -> tuple[DataFrame, list[Column]]:
    """The rows with `look` (the unit embedding) and cells such that close rows' cells differ by 1 at most in each.

    The first cell is of yaw, as wide as `pose`. The others are rings around two
    vectors of the key, as wide as the angle that belongs to the similarity: by the
    triangle inequality two vectors' angles to a pivot differ by no more than their own.
    """
    rows = rows.withColumn("look", vec.unit("embedding")).withColumn("cell_0", F.floor(F.col("yaw") / pose))
    cells = ["cell_0"]
    if similarity >= PIVOTS_FROM:
        width = math.acos(min(similarity, 1.0)) + _SLACK
        names = ["pivot_1", "pivot_2"]
        pivots = rows.groupBy(*key).agg(*(F.min_by("look", F.struct(F.xxhash64("vec_id", F.lit(n)), "vec_id")).alias(n) for n in names))
        rows = rows.join(pivots, key)
        for n in names:
            angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vec.dot("look", n))))
            rows = rows.withColumn(cell := f"cell_{len(cells)}", F.floor(F.coalesce(angle, F.lit(0.0)) / width))
            cells.append(cell)
        rows = rows.drop(*names)
    return rows, [F.col(c) for c in cells]


def _compared(rows: DataFrame, key: list[str], order: Column, pose: float, similarity: float) -> DataFrame:
    """key..., better, worse and what tells whether they are close, for all pairs of neighbouring cells."""
    rows, cells = celled(rows.withColumn("place", F.struct(order.alias("order"), "vec_id")), key, pose, similarity)
    row = F.struct("place", "yaw", "look")
    left = rows.select(*key, *cells, row.alias("x"))
    right = rows.select(*key, row.alias("y"), *cells)
    for c in cells:  # one copy for each neighbouring cell
        name = c._jc.toString()
        right = right.withColumn(name, F.explode(F.array(c - 1, c, c + 1)))
    return left.join(right, [*key, *(c._jc.toString() for c in cells)]).where("x.place < y.place")


def _near(batches: Iterator[pa.RecordBatch], key: list[str], pose: float, similarity: float) -> Iterator[pa.RecordBatch]:
    """key..., x, y, home, similarity of the close pairs of a block of rows and one of their neighbours; in one cell (home) both ways."""
    table = pa.Table.from_batches(list(batches))
    left, right = (table.filter(table.column("_left") if own else pc.invert(table.column("_left"))).combine_chunks() for own in (True, False))
    if not left.num_rows or not right.num_rows:
        return
    (a, b), (yaw_a, yaw_b) = ([_matrix(t.column("look")) for t in (left, right)], [t.column("yaw").to_numpy() for t in (left, right)])
    home = right.column("_home").to_numpy()
    single, least = b.astype(np.float32).T, similarity - 1e-6 * (a.shape[1] + 10)  # more than products and sums of unit vectors lose
    columns_a, columns_b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for lo in range(0, len(a), STEP):
        with np.errstate(invalid="ignore", over="ignore"):
            apart = a[lo : lo + STEP].astype(np.float32) @ single < least  # not so for NaN, which counts as more than any number
            i, j = np.nonzero(~apart & (np.abs(yaw_a[lo : lo + STEP, None] - yaw_b) <= pose))
            i += lo
            found = np.zeros(len(i))
            for x, y in zip(columns_a, columns_b, strict=True):  # in the order of `vec.dot`, so that sums are the same
                found += x[i] * y[j]
            close = np.flatnonzero(~(found < similarity))
        x, y = left.take(i[close]), right.take(j[close])
        names, columns = [*key, "x", "y", "_home", "similarity"], [*(x.column(k) for k in key), x.column("place"), y.column("place"), pa.array(home[j[close]]), pa.array(found[close])]
        yield from pa.table(columns, names=names).combine_chunks().to_batches()


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length, without nulls, as rows."""
    flat = pa.concat_arrays(vectors.chunks).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def near_pairs(rows: DataFrame, key: list[str], order: Column, pose: float, similarity: float) -> DataFrame:
    """key..., better, worse (their `place`: order and vec_id) and similarity of rows close in pose and look."""
    rows, cells = celled(rows.withColumn("place", F.struct(order.alias("order"), "vec_id")), key, pose, similarity)
    names = [c._jc.toString() for c in cells]
    usable = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*key, "yaw", "look", *names)]) & ~F.isnan("yaw") & ~F.exists("look", lambda x: x.isNull())
    rows = cut(rows.where(usable).select(*key, *names, F.size("look").alias("_size"), "place", "yaw", "look"))
    at = [*key, *names, "_size"]
    # Of two neighbouring cells the lesser one's rows are compared with the greater one's.
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(names)) if s >= (0,) * len(names)]
    group = lambda s: F.struct(*((F.col(n) - d).alias(n) for n, d in zip(names, s, strict=True)), F.lit(not any(s)).alias("_home"))
    spread = lambda t: t.withColumn("_to", F.explode(F.array(*map(group, steps)))).drop(*names).select("*", "_to.*").drop("_to")
    own = rows.groupBy(*at).agg(F.count("*").alias("_own"))
    both = spread(own).groupBy(*at).agg(F.sum("_own").alias("_all"))
    sizes = cut(own.join(both, at).withColumn("_few", F.col("_own") * F.col("_all") <= FEW))
    sizes = F.broadcast(sizes) if sizes.count() <= CELLS else sizes
    left, right = rows.join(sizes, at), spread(rows).join(sizes, at)

    few_left = left.where("_few").select(*at, F.struct("place", "yaw", "look").alias("a"))
    few = few_left.join(right.where("_few").select(*at, "_home", F.struct("place", "yaw", "look").alias("b")), at)
    few = few.where(F.abs(F.col("a.yaw") - F.col("b.yaw")) <= pose).withColumn("similarity", vec.dot("a.look", "b.look")).where(F.col("similarity") >= similarity)
    few = few.select(*key, F.col("a.place").alias("x"), F.col("b.place").alias("y"), "_home", "similarity")

    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    of = lambda n: F.pmod(F.xxhash64("place"), blocks(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    row = ["place", "yaw", "look"]
    tasks = left.where("not _few").select(*at, *row, F.lit(True).alias("_left"), F.lit(True).alias("_home"), of("_own").alias("_i"), upto("_all").alias("_j"))
    tasks = tasks.unionByName(right.where("not _few").select(*at, *row, F.lit(False).alias("_left"), "_home", upto("_own").alias("_i"), of("_all").alias("_j")))
    schema = StructType([*(rows.schema[k] for k in key)]).add("x", rows.schema["place"].dataType).add("y", rows.schema["place"].dataType).add("_home", BooleanType()).add("similarity", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _near(batches, key, pose, similarity)

    # Dealt out explicitly: both sides' partitioning by cell is not to be taken for that of their union, as they may be coalesced each in its way.
    many = tasks.repartition(*at, "_i", "_j").groupBy(*at, "_i", "_j").applyInArrow(run, schema)
    ahead = F.col("x") < F.col("y")
    pairs = few.unionByName(many).where(F.when(F.col("_home"), ahead).otherwise(F.col("x") != F.col("y")))
    return pairs.select(*key, F.when(ahead, F.col("x")).otherwise(F.col("y")).alias("better"), F.when(ahead, F.col("y")).otherwise(F.col("x")).alias("worse"), "similarity")


def comparisons(rows: DataFrame, key: list[str], pose: float, similarity: float) -> DataFrame:
    """key..., compared, all_pairs: how many pairs share neighbouring cells, of how many there are."""
    compared = _compared(rows, key, F.lit(0), pose, similarity).groupBy(*key).agg(F.count("*").alias("compared"))
    n = F.count("*")
    return rows.groupBy(*key).agg((n * (n - 1) / 2).cast("long").alias("all_pairs")).join(compared, key, "left").select(*key, F.coalesce("compared", F.lit(0)).alias("compared"), "all_pairs")


def dropped(clashes: DataFrame, key: list[str]) -> DataFrame | None:
    """key..., worse: the rows that the greedy pass drops, of the clashes (key..., better, worse); None without any."""
    names = [*key, "better", "worse"]
    left, out = cut(clashes.select(*names)), []
    while not left.isEmpty():
        worse = left.select(*key, F.col("worse").alias("better")).distinct()
        kept = left.select(*key, "better").distinct().join(worse, [*key, "better"], "left_anti")
        gone = cut(left.join(kept, [*key, "better"], "left_semi").select(*key, "worse").distinct())
        out.append(gone)
        of = gone.select(*key, F.col("worse").alias("better"))
        left = cut(left.join(gone, [*key, "worse"], "left_anti").join(of, [*key, "better"], "left_anti").select(*names))
    return reduce(DataFrame.unionByName, out) if out else None


def settled(places: DataFrame, clashes: DataFrame, key: list[str]) -> DataFrame:
    """key..., place, of: every row of (key..., place), with the best kept row that it clashes with; null for the kept ones."""
    clashes = cut(clashes)
    gone = dropped(clashes, key)
    if gone is None:
        return places.withColumn("of", F.lit(None).cast(places.schema["place"].dataType))
    gone = gone.withColumnRenamed("worse", "place")
    by_kept = clashes.join(gone.withColumnRenamed("place", "better"), [*key, "better"], "left_anti")
    first = by_kept.groupBy(*key, F.col("worse").alias("place")).agg(F.min("better").alias("of"))
    return places.join(first.join(gone, [*key, "place"], "left_semi"), [*key, "place"], "left")


def overlapping(rows: DataFrame, key: list[str], order: Column, name: str, least: float) -> DataFrame:
    """key..., better, worse of boxes whose overlap exceeds `least`.

    Such boxes' widths differ by a factor under 1 / least, and their middles by less than the wider one: an
    equi-join on classes of width and on cells of the middle, as wide as the next class's boxes.
    """
    from weftline.functions import geo

    box = F.col("box")
    width, middle = F.greatest(box[2] - box[0], F.lit(1e-9)), (box[0] + box[2]) / 2
    ratio = 1.0 / least
    grade = F.floor(F.log(width) / math.log(ratio))
    at = lambda g: F.floor(middle / F.pow(F.lit(ratio), g + 2))
    row = F.struct(F.struct(order.alias("order"), name).alias("place"), "box")
    left = rows.select(*key, grade.alias("grade"), at(grade).alias("cell"), row.alias("x"))
    near = F.explode(F.array(*(F.struct((grade + g).alias("grade"), (at(grade + g) + c).alias("cell")) for g in (-1, 0, 1) for c in (-1, 0, 1))))
    right = rows.select(*key, near.alias("n"), row.alias("y")).select(*key, "n.grade", "n.cell", "y")
    pairs = left.join(right, [*key, "grade", "cell"]).where("x.place < y.place").where(geo.iou("x.box", "y.box") > least)
    return pairs.select(*key, F.col("x.place").alias("better"), F.col("y.place").alias("worse"))


def suppressed(rows: DataFrame, key: list[str], order: Column, name: str, least: float) -> DataFrame:
    """key..., name of the boxes that don't overlap a better kept one by more than `least`, in keys of any number of boxes."""
    places = rows.select(*key, F.struct(order.alias("order"), name).alias("place"))
    return settled(places, overlapping(rows, key, order, name, least), key).where("of is null").select(*key, F.col(f"place.{name}").alias(name))
