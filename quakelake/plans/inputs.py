"""The given tables seen as catalogs, picks, traces and documents.

Coordinates are plain arithmetic on ids; everything grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelake.functions.times import micros
from quakelake.operators.common import spread, with_position

# Tables whose rows are costly to process, with the key that spreads them over the cores.
HEAVY_ROWS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, HEAVY_ROWS[name]) if name in HEAVY_ROWS else df


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an earthquake catalog."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("time"),
        (F.col("value") / 100).alias("magnitude"),
        "event_type",
        "user_id",
        (F.lit(100.0) + (e % 1000) / F.lit(100.0)).alias("longitude"),
        (F.lit(25.0) + (e % 777) / F.lit(77.7)).alias("latitude"),
        (e % 40).cast("double").alias("depth"),
    )


CATALOG_SQL = """cat AS (
  SELECT event_id, ts AS time, value / 100 AS magnitude, event_type, user_id,
         100e0 + (event_id % 1000) / 100e0 AS longitude,
         25e0 + (event_id % 777) / 77.7e0 AS latitude,
         CAST(event_id % 40 AS DOUBLE) AS depth
  FROM events)"""


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as phase picks: station per user, phase by type, confidence and SNR from value."""
    phase = (
        F.when(F.col("event_type") == "click", "Pg")
        .when(F.col("event_type") == "view", "Sg")
        .when(F.col("event_type") == "purchase", "Pn")
        .when(F.col("event_type") == "signup", "Sn")
        .otherwise("P")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pick_id"),
        phase.alias("phase"),
        F.concat(F.lit("X"), (F.col("user_id") % 7).cast("string"), F.lit(".S"), F.col("user_id").cast("string")).alias("station"),
        F.col("ts").alias("abs_time"),
        (F.col("value") / 500).alias("confidence"),
        F.col("value").alias("snr"),
    )


PICKS_SQL = """pick AS (
  SELECT event_id AS pick_id,
         CASE event_type WHEN 'click' THEN 'Pg' WHEN 'view' THEN 'Sg' WHEN 'purchase' THEN 'Pn'
              WHEN 'signup' THEN 'Sn' ELSE 'P' END AS phase,
         'X' || (user_id % 7) || '.S' || user_id AS station,
         ts AS abs_time, value / 500 AS confidence, value AS snr
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as long-form traces: one trace per user, samples in time order at 100 Hz."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"), "event_id", "ts", F.col("value").alias("v")
    )
    ranked = with_position(ev, ["trace_id"], micros(F.col("ts")), ["event_id"], "i")
    return ranked.select("trace_id", (F.col("i") - 1).alias("i"), "v")


SAMPLES_SQL = """smp AS (
  SELECT user_id AS trace_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v
  FROM events)"""
