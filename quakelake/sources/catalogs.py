"""Earthquake catalogs from CSV, JSON and free-form text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakelake.functions import text as X
from quakelake.functions.times import parse_time
from quakelake.sources.picks import parse_picks, read_lines

# Accepted column names, best first, and JSON wrapper keys.
ALIASES = {
    "time": ["time", "origin_time", "datetime", "date", "origintime"],
    "magnitude": ["magnitude", "mag", "ml", "mb", "ms", "mw", "m"],
    "longitude": ["longitude", "lon", "x"],
    "latitude": ["latitude", "lat", "y"],
    "depth": ["depth", "dep", "z"],
}
WRAPPERS = ["events", "data", "catalog", "earthquakes"]
# What the opening of a pick file looks like.
PICK_HEADER_WORDS = ["震相", "相对时间"]
PICK_LINE = r"^(?:Pg|Sg|Pn|Sn|P,|S,)"


def find_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """First of ``names`` that is a column (ignoring case and blanks around); names outrank order."""
    held: dict[str, str] = {}
    for column in columns:
        held.setdefault(column.lower().strip(), column)
    return next((held[n] for n in names if n in held), None)


def canonical(df: DataFrame, date_only: bool = False) -> DataFrame:
    """``time, magnitude, longitude, latitude, depth`` from a table of text columns.

    Unreadable cells become NULL; absent columns are NULL throughout.
    """
    out = []
    for role, names in ALIASES.items():
        column = find_column(df.columns, names)
        if column is None:
            kind = "timestamp" if role == "time" else "double"
            out.append(F.lit(None).cast(kind).alias(role))
        elif role == "time":
            out.append(parse_time(F.col(f"`{column}`").cast("string"), date_only).alias(role))
        else:
            out.append(X.strip(F.col(f"`{column}`").cast("string")).try_cast("double").alias(role))
    if find_column(df.columns, ALIASES["time"]) is None and find_column(df.columns, ALIASES["magnitude"]) is None:
        raise ValueError(f"no time or magnitude column among {df.columns}")
    extra = [c for c in ("source_file",) if c in df.columns]
    return df.select(*out, *extra)


def read_csv(spark: SparkSession, path: str, date_only: bool = False, with_file: bool = False) -> DataFrame:
    """CSV catalog with a header; lines starting with ``#`` are comments."""
    table = spark.read.option("header", True).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    if with_file:
        table = table.withColumn("source_file", F.col("_metadata.file_path"))
    return canonical(table, date_only)


def parse_records(df: DataFrame, record: str = "record", date_only: bool = False) -> DataFrame:
    """Catalog rows from JSON object texts whose keys vary in name and case from record to record."""
    pairs = F.map_entries(F.from_json(F.col(record), "map<string,string>"))
    # The first of two keys that differ only in case wins.
    low = F.transform(pairs, lambda e: F.struct(F.lower(F.btrim(e["key"])).alias("key"), e["value"].alias("value")))

    def held(name: str) -> Column:
        return F.get(F.filter(F.col("__e"), lambda e: e["key"] == name), F.lit(0))["value"]

    def value(names: Sequence[str]) -> Column:
        return F.coalesce(*[held(n) for n in names])

    cols = [
        (parse_time(value(names), date_only) if role == "time" else X.strip(value(names)).try_cast("double")).alias(role)
        for role, names in ALIASES.items()
    ]
    return df.withColumn("__e", low).filter(F.col("__e").isNotNull()).select(
        *[c for c in df.columns if c != record], *cols
    )


def read_json(spark: SparkSession, path: str, date_only: bool = False) -> DataFrame:
    """JSON catalog: a list of objects, or one under events, data, catalog or earthquakes.

    One JSON document per file; line-delimited JSON is read by :func:`read_json_lines`.
    """
    whole = spark.read.text(path, wholetext=True).select(X.strip(F.col("value")).alias("v"))
    fields = T.StructType([T.StructField(w, T.StringType()) for w in WRAPPERS])
    wrapped = F.from_json("v", fields)
    lists = F.coalesce(
        F.when(F.startswith("v", F.lit("[")), F.col("v")),
        *[F.when(F.startswith(F.ltrim(wrapped[w]), F.lit("[")), wrapped[w]) for w in WRAPPERS],
    )
    records = whole.select(F.explode(F.from_json(lists, "array<string>")).alias("record"))
    return parse_records(records, date_only=date_only)


def read_json_lines(spark: SparkSession, path: str, date_only: bool = False) -> DataFrame:
    """Catalog of one JSON object per line, which splits across tasks."""
    return parse_records(spark.read.text(path).withColumnRenamed("value", "record"), date_only=date_only)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Free-form table: commas if the header line has one, else white space; ``#`` lines skipped.

    All columns are text, named by the first data line of the file.
    """
    bare = X.strip(F.col("line"))
    rows = read_lines(spark, path).withColumn("bare", bare).filter((F.col("bare") != "") & ~F.startswith("bare", F.lit("#")))
    first = rows.orderBy("path", "block", "pos").select("bare", "path", "block", "pos").head()
    if first is None:
        raise ValueError(f"no rows in {path}")
    sep = r"\s*,\s*" if "," in first["bare"] else r"\s+"
    names = [n.strip() for n in (first["bare"].split(",") if "," in first["bare"] else first["bare"].split())]
    body = rows.filter(F.col("bare") != first["bare"]).withColumn("p", F.split("bare", sep))
    return body.select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])


def is_pick_file(spark: SparkSession, path: str) -> bool:
    """Whether the first five lines look like picks."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(5).collect())
    import re

    return any(w in head for w in PICK_HEADER_WORDS) or bool(re.search(PICK_LINE, head, re.M))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog or pick file by suffix; ``.txt`` files are told apart by their first lines."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "json":
        return read_json(spark, path)
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix == "txt":
        if is_pick_file(spark, path):
            return parse_picks(read_lines(spark, path)).drop("path", "block", "pos")
        return read_csv(spark, path)
    raise ValueError(f"unsupported catalog format: {path}")
