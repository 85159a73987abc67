"""Domain tables derived from the driver's tables by integer arithmetic, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation a vector: pose, size, sharpness, confidence, exposure and an embedding."""
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"),
        ((i * 37) % 161 - 80).cast("double").alias("yaw"), ((i * 17) % 61 - 30).cast("double").alias("pitch"),
        (60 + (i * 13) % 200).cast("double").alias("face_px"), (20 + (i * 29) % 200).cast("double").alias("sharpness"),
        (0.5 + ((i * 7) % 50) / 100).alias("detector_conf"), (10 + (i * 11) % 240).cast("double").alias("exposure"),
        ((i * 3) % 20 / 100).alias("clipped_high"), ((i * 5) % 20 / 100).alias("clipped_low"), ((i * 19) % 101 / 100).alias("visible_fraction"),
    )


OBS = """obs AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, ((vec_id * 37) % 161 - 80)::DOUBLE AS yaw, ((vec_id * 17) % 61 - 30)::DOUBLE AS pitch,
  (60 + (vec_id * 13) % 200)::DOUBLE AS face_px, (20 + (vec_id * 29) % 200)::DOUBLE AS sharpness, 5e-1 + ((vec_id * 7) % 50) / 100 AS detector_conf,
  (10 + (vec_id * 11) % 240)::DOUBLE AS exposure, (vec_id * 3) % 20 / 100 AS clipped_high, (vec_id * 5) % 20 / 100 AS clipped_low, (vec_id * 19) % 101 / 100 AS visible_fraction
  FROM embeddings),
q AS (SELECT *, greatest(1e-3, least(1e0, face_px / 160) * least(greatest(detector_conf, 0e0), 1e0) * least(1e0, sharpness / 120)
  * least(greatest(1e0 - abs(exposure - 130) / 110, 5e-2), 1e0)) AS quality FROM obs)"""


def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measured frame a line item; `error` marks frames that failed."""
    part, supp, line, qty = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("candidate"), (supp % 5).alias("category"),
        (F.col("l_orderkey") * 8 + line).alias("frame"),
        F.when(qty == 50, "render failed").alias("error"),
        F.when(line < 7, 0.30 + (part % 65) / 100).alias("identity"),
        (0.80 + (supp % 20) / 100).alias("identity_stability"), (0.010 + (qty % 13) / 1000).alias("expression_delta"),
        (part % 9 / 100).alias("landmark_delta"), (0.55 + (part % 10) / 10).alias("seam"), (2.0 + (qty % 21)).alias("color_discontinuity"),
        (60 + (part * 7) % 360).cast("double").alias("sharpness"), (0.45 + line / 10).alias("texture_retention"), (0.01 + (qty % 12) / 100).alias("mask_jitter"),
        F.when(supp % 11 > 0, 2.0 + supp % 12).alias("flow_flicker"), (60 + F.col("l_orderkey") % 1340).cast("double").alias("ms"),
        (qty % 47).cast("double").alias("yaw"), (part % 300).cast("double").alias("blur"), (20 + supp % 400).cast("double").alias("face_size"),
        (part % 256).cast("double").alias("brightness"), (1 + qty % 3).alias("n_faces"),
    )


FM = """fm AS (SELECT l_returnflag || l_linestatus AS candidate, l_suppkey % 5 AS category, l_orderkey * 8 + l_linenumber AS frame,
  CASE WHEN l_quantity::BIGINT = 50 THEN 'render failed' END AS error, CASE WHEN l_linenumber < 7 THEN 3e-1 + (l_partkey % 65) / 100 END AS identity,
  8e-1 + (l_suppkey % 20) / 100 AS identity_stability, 1e-2 + (l_quantity::BIGINT % 13) / 1000 AS expression_delta, l_partkey % 9 / 100 AS landmark_delta,
  55e-2 + (l_partkey % 10) / 10 AS seam, 2e0 + (l_quantity::BIGINT % 21) AS color_discontinuity, (60 + (l_partkey * 7) % 360)::DOUBLE AS sharpness,
  45e-2 + l_linenumber / 10 AS texture_retention, 1e-2 + (l_quantity::BIGINT % 12) / 100 AS mask_jitter, CASE WHEN l_suppkey % 11 > 0 THEN 2e0 + l_suppkey % 12 END AS flow_flicker,
  (60 + l_orderkey % 1340)::DOUBLE AS ms, (l_quantity::BIGINT % 47)::DOUBLE AS yaw, (l_partkey % 300)::DOUBLE AS blur, (20 + l_suppkey % 400)::DOUBLE AS face_size,
  (l_partkey % 256)::DOUBLE AS brightness, 1 + l_quantity::BIGINT % 3 AS n_faces FROM lineitem)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip a user, a frame an event, in order of (ts, event_id)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), "ts", "event_id", "value", "event_type", (F.col("event_type") == "error").alias("cut"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame an order, a detection a line item."""
    part, supp, qty = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    x, y = (part % 40).cast("double"), (supp % 30).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), ((F.col("l_linenumber").cast("long") * 1000 + F.col("l_suppkey") % 1000) * 1_000_000 + F.col("l_partkey")).alias("det"), F.array(x, y, x + 10 + qty % 23, y + 10 + part % 19).alias("box"),
        ((part * 13 + F.col("l_linenumber")) % 97 / 100).alias("score"),
    )


DET = """det AS (SELECT l_orderkey AS frame, (l_linenumber::BIGINT * 1000 + l_suppkey % 1000) * 1000000 + l_partkey AS det, (l_partkey % 40)::DOUBLE AS x1, (l_suppkey % 30)::DOUBLE AS y1,
  (l_partkey % 40)::DOUBLE + 10 + l_quantity % 23 AS x2, (l_suppkey % 30)::DOUBLE + 10 + l_partkey % 19 AS y2, (l_partkey * 13 + l_linenumber) % 97 / 100 AS score FROM lineitem)"""
