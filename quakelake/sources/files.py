"""Files as tables: listings, metadata, contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelake.operators.index import extension, fingerprint
from quakelake.sources.picks import read_lines


def listing(spark: SparkSession, path: str, extensions: Sequence[str] | None = None, recursive: bool = True) -> DataFrame:
    """Files under a path: ``path, size, size_mb, mtime, ext``. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    found = files.select(
        "path",
        F.col("length").alias("size"),
        F.round(F.col("length") / 1_000_000, 2).alias("size_mb"),
        F.col("modificationTime").alias("mtime"),
        extension(F.col("path")).alias("ext"),
    )
    if extensions is not None:
        found = allowed(found, extensions)
    return found.dropDuplicates(["path"])


def allowed(df: DataFrame, extensions: Sequence[str], path: str = "path") -> DataFrame:
    """Rows whose file extension is on the list."""
    return df.filter(extension(F.col(path)).isin([e.lower() for e in extensions]))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Files with modification seconds, size, fingerprint and content, for indexing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        "path",
        F.unix_micros("modificationTime").cast("double").alias("__us"),
        F.col("length").alias("size"),
        fingerprint(F.col("content")).alias("sha256"),
        "content",
    ).withColumn("mtime", F.col("__us") / 1e6).drop("__us")


def line_counts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Lines per text file."""
    return read_lines(spark, path, pattern).groupBy("path").agg(F.count("*").alias("n_lines"))
