"""Shared building blocks: size-checked small sides and ordered scans that survive hot keys."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakelake.functions.times import micros

#: A small side may hold this many rows before another join strategy takes over.
SMALL_ROWS = 20_000
#: Bytes a small side may hold, and a side that becomes a constant of the plan.
SMALL_BYTES = 32 * 1024 * 1024
LITERAL_BYTES = 4 * 1024 * 1024
#: Rows one task sorts in an ordered scan.
ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 20_000


def _fixed_width(df: DataFrame) -> bool:
    kinds = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return all(isinstance(f.dataType, kinds) for f in df.schema.fields)


def measure(df: DataFrame, max_rows: int) -> tuple[int, int]:
    """Rows and bytes (as JSON) of the first ``max_rows + 1`` rows, measured on the executors."""
    found = df.limit(max_rows + 1).agg(
        F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")
    ).head()
    return found["n"], found["b"] or 0


def collect_small(df: DataFrame, max_rows: int, max_bytes: int = SMALL_BYTES) -> list[Row] | None:
    """The rows of a table proven small in rows and bytes, else None.

    Tables with texts or arrays are measured before any row reaches the driver; rows of numbers
    need only the row limit.
    """
    if not _fixed_width(df):
        n, size = measure(df, max_rows)
        if n > max_rows or size > max_bytes:
            return None
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Mark a join side for broadcast if it is proven small, else hand it back unmarked.

    A side within the bounds becomes a local table, so the work behind it is not run again by the
    join.
    """
    rows = collect_small(df, max_rows)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def exploded(df: DataFrame, keep: Sequence[Column | str], array: Column, value: str, position: str | None = None) -> DataFrame:
    """One row per element of a costly array expression, empty and NULL arrays giving none.

    A plain explode makes the optimizer test ``size(array) > 0`` below it, which works the array
    out again (several times, and before any repartitioning); the outer form does not.
    """
    if position is None:
        return df.select(*keep, F.explode_outer(array).alias(value)).filter(F.col(value).isNotNull())
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, value)).filter(F.col(position).isNotNull())
    return rows.withColumn(position, F.col(position).cast("long"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread an input of fewer files than cores by its key before per-row work that costs much.

    One small file is one task, whatever the number of cores. Inputs with at least as many files as
    cores, as on a cluster, are left where they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also pairs NULL keys and keeps one copy of them."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    test = None
    for key in keys:
        one = F.col(key).eqNullSafe(F.col(f"__r_{key}"))
        test = one if test is None else test & one
    return left.join(renamed, test, how).drop(*[f"__r_{k}" for k in keys])


def attach(df: DataFrame, stats: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Add per-group statistics to every row.

    Without groups the single statistics row is a scalar subquery; with groups it is an equi-join
    whose right side is broadcast only when small.
    """
    names = [c for c in stats.columns if c not in group_cols]
    if not group_cols:
        packed = stats.select(F.struct(*names).alias("s")).scalar()
        return df.withColumn("__s", packed).select(
            "*", *[F.col(f"__s.{n}").alias(n) for n in names]
        ).drop("__s")
    return join_keys(df, small_side(stats), group_cols)


def literal_rows(df: DataFrame, max_rows: int) -> Column | None:
    """The rows of a small table as one constant array column, or None when it is larger."""
    rows = collect_small(df, max_rows, LITERAL_BYTES)
    if rows is None:
        return None
    text = json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False)
    return F.from_json(F.lit(text), f"array<{df.schema.simpleString()}>")


# --- ordered scans ------------------------------------------------------------------------------


def order_buckets(df: DataFrame, order_value: Column, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Add ``__bucket``: equal-count ranges of a numeric order value.

    A window over ``(keys, __bucket)`` holds about ``rows / buckets`` rows however hot one key is.
    The bounds come from approximate quantiles; they steer balance only, never results.
    """
    if buckets is None:
        buckets = min(MAX_BUCKETS, df.count() // ROWS_PER_BUCKET + 1)
    valued = df.withColumn("__order", order_value.cast("double"))
    if buckets <= 1:
        return valued.withColumn("__bucket", F.lit(0)), 1
    probs = [i / buckets for i in range(1, buckets)]
    bounds = valued.agg(F.percentile_approx("__order", F.array(*map(F.lit, probs)), 10 * buckets)).head()[0]
    splits = [float("-inf"), *sorted(set(bounds or [])), float("inf")]
    if len(splits) < 3:
        return valued.withColumn("__bucket", F.lit(0)), 1
    cut = Bucketizer(splits=splits, inputCol="__order", outputCol="__bucket", handleInvalid="keep")
    return cut.transform(valued).withColumn("__bucket", F.col("__bucket").cast("int")), len(splits) - 1


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order_value: Column,
    ties: Sequence[str] = (),
    name: str = "position",
    buckets: int | None = None,
) -> DataFrame:
    """1-based position of each row within its key by ``order_value`` and then ``ties``.

    Two levels: a row number inside each (key, range) and the count of the ranges before it.
    """
    cut, n = order_buckets(df, order_value, buckets)
    keys = list(keys)
    inner = Window.partitionBy(*keys, "__bucket").orderBy("__order", *ties)
    ranked = cut.withColumn(name, F.row_number().over(inner).cast("long"))
    if n == 1:
        return ranked.drop("__order", "__bucket")
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "__bucket")
        .count()
        .withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    joined = join_keys(ranked, offsets, [*keys, "__bucket"])
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__order", "__bucket", "__before")


def gap_groups(
    df: DataFrame,
    time_col: str,
    gap_seconds: float,
    keys: Sequence[str] = (),
    ties: Sequence[str] = (),
    name: str = "group_no",
    buckets: int | None = None,
) -> DataFrame:
    """Number runs of rows whose successive times differ by at most ``gap_seconds``.

    Runs are found inside each time range first; a summary row per range then says whether its
    first run continues the last one before it, so no task sees the whole time line.
    """
    order = micros(F.col(time_col))
    gap = int(round(gap_seconds * 1_000_000))
    cut, n = order_buckets(df, order, buckets)
    keys = list(keys)
    part = [*keys, "__bucket"]
    inner = Window.partitionBy(*part).orderBy("__order", *ties)
    prev = F.lag("__order").over(inner)
    flagged = cut.withColumn(
        "__start", F.when(prev.isNull() | (F.col("__order") - prev > gap), 1).otherwise(0)
    )
    local = flagged.withColumn(
        "__local", F.sum("__start").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    )
    if n == 1:
        return local.withColumn(name, F.col("__local").cast("long")).drop(
            "__order", "__bucket", "__start", "__local"
        )
    over_keys = Window.partitionBy(*keys).orderBy("__bucket")
    edges = (
        local.groupBy(*part)
        .agg(F.min("__order").alias("__first"), F.max("__order").alias("__last"), F.max("__local").alias("__runs"))
        .withColumn("__prev", F.lag("__last").over(over_keys))
        .withColumn(
            "__new", F.when(F.col("__prev").isNull() | (F.col("__first") - F.col("__prev") > gap), 1).otherwise(0)
        )
        .withColumn(
            "__before",
            F.coalesce(
                F.sum(F.col("__runs") - 1 + F.col("__new")).over(
                    over_keys.rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select(*part, "__new", "__before")
    )
    return (
        join_keys(local, edges, part)
        .withColumn(name, (F.col("__before") + F.col("__local") - 1 + F.col("__new")).cast("long"))
        .drop("__order", "__bucket", "__start", "__local", "__new", "__before")
    )


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key. Spark limits each task's rows per key before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))
