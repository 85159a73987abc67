"""Reading and writing tables that stand for documents and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_documents(spark: SparkSession, path: str, schema: StructType | str, version: tuple[str, int] | None = None) -> DataFrame:
    """JSON documents; one that can't be read, or has another version, counts as absent."""
    kept = f"{schema if isinstance(schema, str) else ', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, _bad string"
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
    good = rows.where(F.col("_bad").isNull()).drop("_bad")
    return good.where(F.col(version[0]) == version[1]) if version else good


def samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV samples; lines in which a value is missing or can't be read are skipped, whichever columns are used later."""
    kinds = StructType.fromDDL(schema)
    raw = spark.read.schema(", ".join(f"`{f.name}` string" for f in kinds)).csv(path)
    read = raw.select(*(F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in kinds))
    return read.dropna()


def _parsed(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """The other columns, and the values of a comma-separated line; lines with too few or unreadable values are left out."""
    kinds = StructType.fromDDL(schema)
    parts = F.split(line, ",")
    values = [F.trim(F.get(parts, i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(kinds)]
    return lines.select(*(c for c in lines.columns if c != line), *values).dropna(subset=[f.name for f in kinds])


def first_card(polls: DataFrame, output: str, schema: str) -> DataFrame:
    """The values of the first card of each poll, whose output has a line a card; a poll without a readable first line is left out."""
    first = F.get(F.split(F.regexp_replace(output, r"^\s+", ""), "\n"), 0)
    return _parsed(polls.withColumn(output, first), output, schema)


def sample_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int | None = None) -> DataFrame:
    """Samples as a stream: the lines of the files that come into a folder, malformed ones skipped as by `samples`."""
    reader = spark.readStream.format("text")
    reader = reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader
    return _parsed(reader.load(folder), "value", schema)


def zipped(records: DataFrame, names: str, values: str, as_name: str, as_value: str) -> DataFrame:
    """One row an element of two parallel arrays; the rest of the record repeats."""
    rest = [c for c in records.columns if c not in (names, values)]
    pairs = F.explode(F.arrays_zip(F.col(names).alias("n"), F.col(values).alias("v"))).alias("x")
    return records.select(*rest, pairs).select(*rest, F.col("x.n").alias(as_name), F.col("x.v").alias(as_value))


def probe(raw: DataFrame) -> DataFrame:
    """Clip facts from raw probe columns (avg_rate, nominal_rate as "num/den", stream_s, format_s, nb_frames, width, height, rotation)."""
    from weftline.functions.score import rational

    avg, nominal = rational(F.col("avg_rate"), F.lit(0.0)), rational(F.col("nominal_rate"), F.lit(0.0))
    turned = F.pmod(F.abs(F.col("rotation")), F.lit(180)) == 90
    out = raw.withColumn("fps", F.when(avg > 0, avg).when(nominal > 0, nominal).otherwise(25.0))
    out = out.withColumn("is_vfr", (avg > 0) & (nominal > 0) & (F.abs(avg - nominal) / F.greatest(nominal, F.lit(1e-6)) > 0.01))
    out = out.withColumn("duration", F.coalesce("stream_s", "format_s"))
    out = out.withColumn("total_frames", F.coalesce(F.nullif("nb_frames", F.lit(0)), F.bround(F.col("fps") * F.col("duration")).cast("long")))
    return out.withColumn("shown_width", F.when(turned, F.col("height")).otherwise(F.col("width"))).withColumn("shown_height", F.when(turned, F.col("width")).otherwise(F.col("height")))


def write_keyed(rows: DataFrame, path: str, key: str) -> None:
    """Overwrite only the keys that the rows hold; other keys' files stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def ensured(wanted: DataFrame, found: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """wanted, with error (null for what is as it should be): a whole batch is looked at, and what is wrong with an item is its own row's column.

    wanted: key, size and digest, either null if not known; found: key, size and digest of what is there.
    """
    there = found.select(key, F.col(size).alias("_size"), F.col(digest).alias("_digest"), F.lit(True).alias("_there"))
    error = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("_size") != F.col(size), F.concat(F.lit("size is "), "_size", F.lit(", not "), size))
        .when(F.col("_digest") != F.col(digest), "digest differs")
    )
    return wanted.join(there, key, "left").select(*wanted.columns, error.alias("error"))


def write_report(rows: DataFrame, path: str, score: str) -> None:
    """A ranked JSON report, best first; a report is one file because it is a few rows."""
    rows.orderBy(F.desc(score)).coalesce(1).write.mode("overwrite").json(path)


def reassembled(chunks: DataFrame, key: str, index: str, text: str) -> DataFrame:
    """key, text: chunks joined in the order of their index."""
    parts = F.array_sort(F.collect_list(F.struct(index, text)))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda s: s[text]), "").alias(text))


#: Photos read of one request, and the first bytes of the formats that can be.
MOST_PHOTOS = 5
_FORMATS = {"jpeg": "FFD8FF", "png": "89504E47", "webp": "52494646", "bmp": "424D", "gif": "47494638"}


def photos(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 and format (null if it is none that can be read) of each file of a folder, from its content; Spark leaves out files of no bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.substring("content", 1, 4))
    kind = F.coalesce(*(F.when(head.startswith(magic), name) for name, magic in _FORMATS.items()))
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("format"))


def source_problems(files: DataFrame, faces: DataFrame, key: list[str], order: str, most: int = MOST_PHOTOS) -> DataFrame:
    """key..., name, problem (null for a photo that is used) of every file of a request.

    files: key, name, order and readable; faces: key and name of each face found. Only the first `most` of a request
    are looked at; the others are named as such. A request's trouble is a row each, not a failure of the query.
    """
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order, "name", "readable"))
    found = faces.select(*key, "name").distinct().withColumn("_face", F.lit(True))
    rows = files.withColumn("_place", place).join(found, [*key, "name"], "left")
    problem = F.when(F.col("_place") > most, f"not read: more than {most} photos").when(~F.col("readable"), "unreadable or unsupported").when(F.col("_face").isNull(), "no face found")
    return rows.select(*key, "name", problem.alias("problem"))


def unusable(problems: DataFrame, key: list[str]) -> DataFrame:
    """key..., error: requests of which no photo can be used, with all that is wrong in the order of names; the rest have no row."""
    parts = F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.concat("name", F.lit(": "), "problem"))))
    return problems.groupBy(*key).agg(F.count(F.when(F.col("problem").isNull(), 1)).alias("_used"), F.array_join(parts, "; ").alias("error")).where("_used = 0").drop("_used")
