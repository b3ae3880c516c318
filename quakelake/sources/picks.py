"""Phase-pick text files.

A line is ``Phase,RelTime,Confidence,AbsTime,SNR,Amplitude,Station,Polarity,PolarityProb``; lines
starting with ``#`` are comments and name the waveform file of the picks that follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelake.functions import text as X
from quakelake.functions.times import pick_time
from quakelake.operators.common import join_keys

NAME_PATTERN = "*picks*.txt"


def read_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Lines of text files, found recursively: ``path, block, pos, line``.

    ``(path, block, pos)`` orders the lines of a file: the byte offset of the split and the row
    number within it. Large files are read in several splits.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    )
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )


def pick_lines(spark: SparkSession, path: str, pattern: str = NAME_PATTERN) -> DataFrame:
    """Lines of the pick files under a path; any ``.txt`` file when none has a pick-file name."""
    named = read_lines(spark, path, pattern)
    if named.limit(1).count():
        return named
    other = read_lines(spark, path, "*.txt")
    if not other.limit(1).count():
        raise FileNotFoundError(f"no pick files under {path}")
    return other


def _data_lines(lines: DataFrame, min_fields: int, trim: bool = True) -> DataFrame:
    """Data lines split at commas. Empty lines, comments and short lines are skipped."""
    bare = X.strip(F.col("line"))
    parts = F.split(bare, ",")
    return (
        lines.withColumn("__bare", bare)
        .filter((F.col("__bare") != "") & ~F.startswith("__bare", F.lit("#")))
        .withColumn("__p", F.transform(parts, X.strip) if trim else parts)
        .filter(F.size("__p") >= min_fields)
        .drop("__bare", "line")
    )


def _field(i: int) -> Column:
    return F.get(F.col("__p"), F.lit(i))


def _number(i: int) -> Column:
    return X.strip(_field(i)).try_cast("double")


def parse_picks(lines: DataFrame) -> DataFrame:
    """Picks whose confidence, absolute time and SNR are readable."""
    return (
        _data_lines(lines, 7)
        .withColumns(
            {
                "phase": _field(0),
                "time": pick_time(_field(3)),
                "confidence": _number(2),
                "snr": _number(4),
                "station": _field(6),
            }
        )
        .filter(F.col("confidence").isNotNull() & F.col("time").isNotNull() & F.col("snr").isNotNull())
        .drop("__p")
    )


def parse_full_picks(lines: DataFrame) -> DataFrame:
    """Picks with every number readable; a missing polarity is N."""
    cols = {
        "phase": _field(0),
        "rel_time": _number(1),
        "confidence": _number(2),
        "abs_time": pick_time(_field(3)),
        "snr": _number(4),
        "amplitude": _number(5),
        "station": _field(6),
        "polarity": F.coalesce(_field(7), F.lit("N")),
    }
    found = _data_lines(lines, 7).withColumns(cols).drop("__p")
    for name in ("rel_time", "confidence", "abs_time", "snr", "amplitude"):
        found = found.filter(F.col(name).isNotNull())
    return found


def parse_lenient_picks(lines: DataFrame) -> DataFrame:
    """Picks of four fields or more: absent SNR is 0, station empty, polarity N; times stay text."""
    snr = F.when(F.size("__p") > 4, _number(4)).otherwise(F.lit(0.0))
    cols = {
        "phase": _field(0),
        "time_s": _number(1),
        "confidence": _number(2),
        "abs_time": _field(3),
        "snr": snr,
        "station": F.coalesce(_field(6), F.lit("")),
        "polarity": F.coalesce(_field(7), F.lit("N")),
    }
    found = _data_lines(lines, 4, trim=False).withColumns(cols).drop("__p")
    for name in ("time_s", "confidence", "snr"):
        found = found.filter(F.col(name).isNotNull())
    return found


def with_waveform_file(lines: DataFrame) -> DataFrame:
    """Add ``source`` to every line: the text of the last ``#`` line above it in its file.

    A file may be larger than a task: headers are carried forward inside each split, and a line
    before a split's first header takes the last header of the splits before.
    """
    bare = X.strip(F.col("line"))
    header = F.when(F.startswith("line", F.lit("#")), F.substring(bare, F.lit(2), F.length(bare)))
    inner = Window.partitionBy("path", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("__h", header)
    near = marked.withColumn("__near", F.last("__h", ignorenulls=True).over(inner))
    outer = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_split = (
        marked.groupBy("path", "block")
        .agg(F.max_by("__h", F.when(F.col("__h").isNotNull(), F.col("pos"))).alias("__last"))
        .withColumn("__above", F.last("__last", ignorenulls=True).over(outer))
        .select("path", "block", "__above")
    )
    return (
        join_keys(near, per_split, ["path", "block"])
        .withColumn("source", F.coalesce("__near", "__above"))
        .drop("__h", "__near", "__above")
    )


def read_picks(spark: SparkSession, path: str, pattern: str = NAME_PATTERN) -> DataFrame:
    """Picks of a file or folder tree. Raises if no line is a valid pick."""
    found = parse_picks(pick_lines(spark, path, pattern)).withColumnRenamed("path", "source_file")
    if not found.limit(1).count():
        raise ValueError(f"no valid picks in {path}")
    return found.drop("block", "pos")


def read_full_picks(spark: SparkSession, path: str) -> DataFrame:
    """Full pick rows with the waveform file each belongs to."""
    return parse_full_picks(with_waveform_file(read_lines(spark, path))).drop("block", "pos")


def read_lenient_picks(spark: SparkSession, path: str) -> DataFrame:
    return parse_lenient_picks(read_lines(spark, path)).drop("block", "pos")
