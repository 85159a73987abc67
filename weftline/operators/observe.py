"""Observations of one identity: weighted centres, agreement, outliers, coverage, redundancy.

Columns: a key, vec_id, embedding and those that `weftline.functions.score` names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import score, vec
from weftline.operators import greedy
from weftline.sources.scratch import cut


def weighted_centre(rows: DataFrame, key: list[str], weight: Column | float = 1.0, normalise: bool = True) -> DataFrame:
    """key..., centre: the weighted mean vector, summed per dimension on the map side first."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    parts = rows.select(*key, w.alias("w"), F.posexplode(vec.doubles("embedding")).alias("dim", "x"))
    means = parts.groupBy(*key, "dim").agg((F.sum(F.col("x") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("v"))
    packed = means.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("centre"))
    return packed.withColumn("centre", vec.unit("centre")) if normalise else packed


def consensus(rows: DataFrame, key: list[str], weight: Column | float = 1.0) -> DataFrame:
    """The rows with their agreement with the weighted centre of their key; there are few keys per vector row, so centres join by key."""
    centres = weighted_centre(rows, key, weight)
    return rows.join(centres, key).withColumn("consensus", vec.cosine("embedding", "centre")).drop("centre")


def reject_outliers(rows: DataFrame, key: list[str], weight: Column | float, floor: float = 0.05, least: int = 3) -> DataFrame:
    """Adds kept and consensus: of keys with `least` rows, those that agree; all of them if none does. Agreement is then taken among the kept.

    Three passes give a row a key each: the centres, how many agree, and the centres of those
    kept; these are written, and the result reads the rows once.
    """
    first = cut(weighted_centre(rows, key, weight))
    like = rows.join(first, key).withColumn("_like", vec.cosine("embedding", "centre")).drop("centre")
    per = cut(like.groupBy(*key).agg(F.count("*").alias("_n"), F.max(F.col("_like") >= floor).alias("_any")))
    flagged = like.join(per, key).withColumn("kept", (F.col("_n") < least) | ~F.col("_any") | (F.col("_like") >= floor)).drop("_n", "_any", "_like")
    second = cut(weighted_centre(flagged.where("kept"), key, weight))
    return flagged.join(second, key, "left").withColumn("consensus", F.when(F.col("kept"), vec.cosine("embedding", "centre"))).drop("centre")


def cross_check(centres: DataFrame, key: str, limit: float = 0.25) -> DataFrame:
    """a, b, similarity, distinct of each two centres: an equi-join on dimensions, summed per pair."""
    long = centres.select(key, F.posexplode("centre").alias("dim", "v"))
    left = long.select(F.col(key).alias("a"), "dim", F.col("v").alias("va"))
    right = long.select(F.col(key).alias("b"), "dim", F.col("v").alias("vb"))
    pairs = left.join(right, "dim").where("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("similarity"))
    return pairs.withColumn("distinct", F.col("similarity") < limit)


def pose_conditioned(rows: DataFrame, key: list[str], targets: list[float], sigma: float = 18.0, quality: Column | None = None) -> DataFrame:
    """key..., target, dim, value: mean vectors weighted by quality and nearness in yaw; by quality alone where nothing is near."""
    quality = score.quality("base") if quality is None else quality
    near = rows.withColumn("q", quality).withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    near = near.withColumn("w", score.pose_kernel(F.col("yaw") - F.col("target"), sigma) * F.col("q"))
    near = near.select(*key, "target", "w", "q", F.posexplode(vec.doubles("embedding")).alias("dim", "x"))
    sums = near.groupBy(*key, "target", "dim").agg(
        F.sum(F.col("x") * F.col("w")).alias("xw"), F.sum("w").alias("sw"), F.sum(F.col("x") * F.col("q")).alias("xq"), F.sum("q").alias("sq")
    )
    value = F.when(F.col("sw") < 1e-8, F.col("xq") / F.col("sq")).otherwise(F.col("xw") / F.col("sw"))
    return sums.select(*key, "target", "dim", value.alias("value"))


#: The anchor's share in a conditioned vector, and the least agreement of the same person.
ANCHOR_SHARE, SAME_PERSON = 0.55, 0.28


def anchored(rows: DataFrame, key: list[str], targets: list[float], sigma: float = 18.0, quality: Column | None = None, share: float = ANCHOR_SHARE) -> DataFrame:
    """key..., target, vector: the pose-conditioned mean, made of unit length, blended with the key's centre and made of unit length again.

    A mean or a blend of no length is the centre.
    """
    quality = score.quality("base") if quality is None else quality
    centres = cut(weighted_centre(rows, key, quality))  # a row a key
    long = pose_conditioned(rows, key, targets, sigma, quality)
    means = long.groupBy(*key, "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("mean"))
    or_centre = lambda v: F.when(vec.norm(v) > 1e-6, vec.unit(v)).otherwise(F.col("centre"))
    mixed = means.join(centres, key).withColumn("mean", or_centre(F.col("mean"))).withColumn("mixed", vec.blend("centre", "mean", share))
    return mixed.select(*key, "target", or_centre(F.col("mixed")).alias("vector"))


def same_person(rows: DataFrame, key: list[str], photo: Column, quality: Column, floor: float = SAME_PERSON) -> DataFrame:
    """key..., vec_id, anchor, consensus, kept of a key's video rows: whether they agree with its person.

    Two passes: the anchor is the weighted mean of the key's photos (`photos`), or, where it has none, of the
    video rows themselves (`own`), all of which the first pass then takes on quality alone.
    """
    asked = rows.withColumn("_photo", F.coalesce(photo, F.lit(False)))
    has = asked.groupBy(*key).agg(F.max("_photo").alias("_has"))
    marked = asked.join(cut(has), key)
    anchors = cut(weighted_centre(marked.where("_photo or not _has"), key, quality))
    video = marked.where("not _photo").join(anchors, key).withColumn("consensus", vec.cosine("embedding", "centre"))
    return video.select(*key, "vec_id", F.when(F.col("_has"), "photos").otherwise("own").alias("anchor"), "consensus", (F.col("consensus") >= floor).alias("kept"))


def coverage(rows: DataFrame, key: list[str], bins=score.POSE_BINS) -> DataFrame:
    """key..., bin, n for every bin, zeros included."""
    names = F.explode(F.array(*(F.lit(b[0]) for b in bins))).alias("bin")
    return (
        rows.select(*key).distinct().select(*key, names)
        .join(rows.groupBy(*key, score.binned("yaw", bins).alias("bin")).agg(F.count("*").alias("c")), [*key, "bin"], "left")
        .select(*key, "bin", F.coalesce("c", F.lit(0)).alias("n"))
    )


def near_pairs(rows: DataFrame, key: list[str], pose: float = 12.0, similarity: float = 0.86) -> DataFrame:
    """key..., a, b, similarity of rows close in pose and look: an equi-join on cells of pose and of angles to pivots."""
    pairs = greedy.near_pairs(rows, key, F.lit(0), pose, similarity)
    return pairs.select(*key, F.col("better.vec_id").alias("a"), F.col("worse.vec_id").alias("b"), "similarity")


def _settled(rows: DataFrame, key: list[str], quality: Column, pose: float, similarity: float) -> DataFrame:
    places = rows.select(*key, F.struct((-quality).alias("order"), "vec_id").alias("place"))
    return greedy.settled(places, greedy.near_pairs(rows, key, -quality, pose, similarity), key)


def deduplicated(rows: DataFrame, key: list[str], quality: Column, pose: float = 7.0, similarity: float = 0.92, most: int | None = 24) -> DataFrame:
    """key..., rank, vec_id of the observations kept, best first, the best `most` of a key.

    Kept by rounds over the pairs that clash, so a key may have any number of rows; the cut at `most` comes afterwards.
    """
    kept = _settled(rows, key, quality, pose, similarity).where("of is null")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("place")))
    # A limit on the rank is taken in each task first, so of a large key only `most` rows a task are shuffled.
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    return ranked.select(*key, (F.col("rank") - 1).alias("rank"), F.col("place.vec_id").alias("vec_id"))


def marked_duplicates(rows: DataFrame, key: list[str], quality: Column, pose: float = 12.0, similarity: float = 0.86, penalty: float = 0.5) -> DataFrame:
    """key..., vec_id, duplicate_of (the best kept row that it is close to, null for those kept), penalty: every row stays, keys may have any number."""
    marked = _settled(rows, key, quality, pose, similarity)
    return marked.select(*key, F.col("place.vec_id").alias("vec_id"), F.col("of.vec_id").alias("duplicate_of"), F.when(F.col("of").isNull(), 1.0).otherwise(penalty).alias("penalty"))


def acquire(rows: DataFrame, key: str, quality: Column, limit: int = 5, pose: float = 10.0, similarity: float = 0.90) -> DataFrame:
    """key, pick, vec_id, why: an anchor, then the best new view of each band, then the best of the rest.

    Rows need is_photo; vec_id names a row of its key. Uploaded photos come first
    for the anchor and in each band. Each pick is an arg-min over all rows that
    are not redundant to the picks so far, computed where the rows lie: `limit`
    passes, after each of which the picks, `limit` a key, are written and joined back. A band without a
    new view never gets one later, so the least open band that has one is next.
    """
    bands = [b[0] for b in score.POSE_BANDS]
    band, photo = F.col("band"), F.coalesce("is_photo", F.lit(False))
    ranked = rows.select(
        F.col(key).alias("key"), "vec_id", "yaw", (~photo).alias("frame"), vec.unit("embedding").alias("look"),
        F.coalesce(-quality, F.lit(float("nan"))).alias("order"), score.binned("yaw", score.POSE_BANDS).alias("band"),  # null and NaN come last
    )
    view = ["vec_id", "yaw", "look", "band"]
    best = ranked.groupBy("key").agg(F.min(F.struct("frame", F.coalesce(band != bands[0], F.lit(True)).alias("turned"), "order", *view)).alias("x"))
    picks = cut(best.select(F.col("key").alias("of"), F.array(F.struct(*(F.col(f"x.{c}").alias(c) for c in view), F.lit("anchor").alias("why"))).alias("picks")))
    place = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, name in enumerate(bands) for x in (name, i))), band), F.lit(len(bands)))
    for _ in range(limit - 1):
        near = lambda c: F.coalesce((F.abs(c["yaw"] - F.col("yaw")) <= pose) & (vec.dot(c["look"], "look") >= similarity), F.lit(False))
        fresh = ranked.join(picks, F.col("key").eqNullSafe(F.col("of"))).where(~F.exists("picks", lambda c: (c["vec_id"] == F.col("vec_id")) | near(c)))
        open_ = (place < len(bands)) & ~F.exists("picks", lambda c: c["band"].eqNullSafe(band))
        order = F.struct(F.when(open_, place).otherwise(len(bands)).alias("step"), (open_ & F.col("frame")).alias("later"), "order", *view)
        new = fresh.groupBy("key").agg(F.min(order).alias("x"))
        why = F.when(F.col("x.step") < len(bands), F.col("x.band")).otherwise("fill")
        added = F.array(F.struct(*(F.col(f"x.{c}").alias(c) for c in view), why.alias("why")))
        both = picks.join(new, F.col("of").eqNullSafe(F.col("key")), "left")
        picks = cut(both.select("of", F.when(F.col("x").isNull(), F.col("picks")).otherwise(F.concat("picks", added)).alias("picks")))
    return picks.select(F.col("of").alias(key), F.posexplode("picks").alias("pick", "c")).select(key, "pick", "c.vec_id", "c.why")


def by_origin(picks: DataFrame, key: str, photo: Column, yaw: str) -> DataFrame:
    """key, n_selected, from_photo, from_video, bands: what was selected, by origin, and the pose bands it covers, sorted."""
    return picks.groupBy(key).agg(
        F.count("*").alias("n_selected"), F.count(F.when(photo, 1)).alias("from_photo"), F.count(F.when(~photo, 1)).alias("from_video"),
        F.array_sort(F.collect_set(score.binned(yaw, score.POSE_BANDS))).alias("bands"),
    )


def in_order(first: DataFrame, second: DataFrame, order: list[str]) -> DataFrame:
    """All rows of both tables, the first one's first, with place: no row is merged with another."""
    both = first.withColumn("_source", F.lit(0)).unionByName(second.withColumn("_source", F.lit(1)))
    return both.withColumn("place", F.struct("_source", *order)).drop("_source")

