"""Writers: evidence, polarity results, stores, input tables of location programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelake.functions.times import micros


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def polarity_lines(decided: DataFrame) -> DataFrame:
    """``station,time,polarity,prob`` lines with three decimals."""
    return decided.select(
        F.concat_ws(
            ",", "station", F.date_format("abs_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "polarity", F.format_string("%.3f", "prob")
        ).alias("value")
    )


def write_polarity(decided: DataFrame, path: str) -> None:
    """One commented CSV per task; every part file opens with the header line."""
    decided.select(
        F.col("station").alias("# Station"),
        F.date_format("abs_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Time"),
        F.col("polarity").alias("Polarity"),
        F.format_string("%.3f", "prob").alias("Confidence"),
    ).write.mode("overwrite").option("header", True).option("comment", "~").csv(path)


# --- versioned stores ---------------------------------------------------------------------------


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a store, oldest first. A version counts once its write has succeeded."""
    fs, jvm = _file_system(spark, path)
    root = jvm.org.apache.hadoop.fs.Path(path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


def save_store(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write the next version of a store beside the current one and return its number.

    Readers keep the old version until the new one is complete.
    """
    held = versions(df.sparkSession, path)
    number = held[-1] + 1 if held else 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/v={number}")
    return number


def load_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    held = versions(spark, path)
    if not held:
        raise FileNotFoundError(f"no complete version under {path}")
    return spark.read.parquet(f"{path}/v={version or held[-1]}")


# --- location-program inputs --------------------------------------------------------------------


def station_lines(stations: DataFrame) -> DataFrame:
    """``NET_STA LAT LON ELE`` lines (elevation in metres)."""
    return stations.select(
        F.format_string(
            "%-8s %9.4f %10.4f %7.1f", F.concat_ws("_", "network", "code"), "latitude", "longitude", "elevation"
        ).alias("value")
    )


def differential_time_lines(pairs: DataFrame) -> DataFrame:
    """dt.ct text: a ``# EV1 EV2 0.0`` line per pair, then its stations, in order of pair, station and phase.

    Pairs are dealt to ranges once, as numbers; a pair lies in one range, where its first row brings
    the head line, and lines are written after the sort.
    """
    order = Window.partitionBy("ev1", "ev2").orderBy("station", "phase")
    ranked = pairs.select("ev1", "ev2", "station", "phase", "tp1", "tp2", "weight").repartitionByRange("ev1", "ev2")
    ranked = ranked.withColumn("__first", F.row_number().over(order) == 1)
    blank = F.lit("")
    one, two = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("ev1", "ev2"))
    head = F.struct(
        blank.alias("station"), blank.alias("phase"), F.concat(F.lit("# "), one, F.lit(" "), two, F.lit(" 0.0")).alias("value")
    )
    body = F.struct(
        "station", "phase", F.format_string("%-8s %9.3f %9.3f %7.4f %s", "station", "tp1", "tp2", "weight", "phase").alias("value")
    )
    lines = F.when(F.col("__first"), F.array(head, body)).otherwise(F.array(body))
    return ranked.select("ev1", "ev2", F.explode_outer(lines).alias("__l")).select("ev1", "ev2", "__l.station", "__l.phase", "__l.value")


def phase_lines(picks: DataFrame) -> DataFrame:
    """Phase file rows: station, phase, absolute time and weight, ordered by event."""
    return picks.orderBy("event_id", "abs_time", "station", "phase").select(
        F.col("event_id"),
        F.format_string(
            "%-8s %-3s %s %6.3f", "station", "phase", F.date_format(F.timestamp_micros(micros(F.col("abs_time"))), "yyyy-MM-dd HH:mm:ss.SSSSSS"), "confidence"
        ).alias("value"),
    )


def polarity_input_lines(decided: DataFrame) -> DataFrame:
    """First-motion rows: station and U or D; uncertain picks are left out."""
    return decided.filter(F.col("polarity") != "N").select(
        F.format_string("%-8s %s", "station", "polarity").alias("value")
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files in the order of the rows."""
    lines.select("value").write.mode("overwrite").text(path)
