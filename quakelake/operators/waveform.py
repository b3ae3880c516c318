"""Waveforms in long form (``trace_id, i, v``) and as bounded segments with a ``data`` array.

Long-form operators reduce each trace with map-side combining and join the result back; windows run
over (trace, block of sample numbers), so no task holds a whole trace. Kernels that need the whole
sample array (filters, spectra) work on array rows, one trace or one named window each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelake.functions.times import micros
from quakelake.operators.common import attach, join_keys

#: Samples one (trace, block) window may hold.
BLOCK = 262_144
#: Samples one array row may hold.
LARGEST = 16_777_216
DISPLAY_POINTS = 4000


def trace_summary(samples: DataFrame, keys: Sequence[str] = ("trace_id",)) -> DataFrame:
    """Samples, smallest and largest value of each trace."""
    return samples.groupBy(*keys).agg(
        F.count("*").alias("npts"), F.min("v").alias("v_min"), F.max("v").alias("v_max")
    )


def segment_summary(segments: DataFrame) -> DataFrame:
    """Identity, rate, start, end, length and range of array traces."""
    n = F.size("data")
    span = ((n - 1) / F.col("sampling_rate") * 1_000_000).cast("long")
    return segments.select(
        *[c for c in segments.columns if c != "data"],
        n.cast("long").alias("npts"),
        F.timestamp_micros(micros(F.col("starttime")) + span).alias("endtime"),
        F.array_min("data").alias("v_min"),
        F.array_max("data").alias("v_max"),
    )


def detrend(samples: DataFrame, kind: str = "demean", keys: Sequence[str] = ("trace_id",)) -> DataFrame:
    """Remove the mean (``demean``, ``constant``) or the least-squares line (``linear``) of each trace."""
    keys = list(keys)
    if kind in ("demean", "constant"):
        stats = samples.groupBy(*keys).agg(F.avg("v").alias("__c"))
        value = F.col("v") - F.col("__c")
    elif kind == "linear":
        stats = samples.groupBy(*keys).agg(
            F.avg("v").alias("__c"), F.avg(F.col("i").cast("double")).alias("__mid"), F.regr_slope("v", "i").alias("__slope")
        )
        value = F.col("v") - F.col("__c") - F.coalesce("__slope", F.lit(0.0)) * (F.col("i") - F.col("__mid"))
    else:
        raise ValueError(f"unknown detrend kind: {kind}")
    return attach(samples, stats, keys).withColumn("v", value).drop("__c", "__mid", "__slope")


def taper(samples: DataFrame, fraction: float = 0.05, keys: Sequence[str] = ("trace_id",)) -> DataFrame:
    """Cosine taper over ``fraction`` of each end (at most half the trace). Samples count from 0."""
    keys = list(keys)
    stats = samples.groupBy(*keys).agg(F.count("*").alias("__n"))
    length = F.least(F.floor(F.lit(fraction) * F.col("__n")), F.floor(F.col("__n") / 2))
    rise = lambda at: (F.lit(1.0) - F.cos(F.lit(math.pi) * at / F.nullif(length - 1, F.lit(0)))) * 0.5
    at_end = F.col("__n") - 1 - F.col("i")
    # A one-sample taper leaves the first sample and silences the last.
    weight = (
        F.when(length == 0, F.lit(1.0))
        .when(length == 1, F.when(at_end == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
        .when(F.col("i") < length, rise(F.col("i")))
        .when(at_end < length, rise(at_end))
        .otherwise(F.lit(1.0))
    )
    return attach(samples, stats, keys).withColumn("v", F.col("v") * weight).drop("__n")


def normalise(samples: DataFrame, keys: Sequence[str] = ("trace_id",)) -> DataFrame:
    """Divide by the largest absolute value; an all-zero trace stays."""
    keys = list(keys)
    stats = samples.groupBy(*keys).agg(F.max(F.abs("v")).alias("__peak"))
    return (
        attach(samples, stats, keys)
        .withColumn("v", F.when(F.col("__peak") > 0, F.col("v") / F.col("__peak")).otherwise(F.col("v")))
        .drop("__peak")
    )


def display_points(
    samples: DataFrame, sampling_rate: float, max_points: int = DISPLAY_POINTS, keys: Sequence[str] = ("trace_id",)
) -> DataFrame:
    """Normalised samples thinned to every (n // max_points)-th, with seconds from the start."""
    keys = list(keys)
    stats = samples.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(F.abs("v")).alias("__peak"))
    step = F.greatest(F.floor(F.col("__n") / max_points), F.lit(1))
    return (
        attach(samples, stats, keys)
        .filter(F.col("i") % step == 0)
        .select(
            *keys,
            "i",
            (F.col("i") / F.lit(float(sampling_rate))).alias("t"),
            F.when(F.col("__peak") > 0, F.col("v") / F.col("__peak")).otherwise(F.col("v")).alias("v"),
        )
    )


def _number_range(df: DataFrame, first: Column, last: Column, name: str, step: int = 65_536) -> DataFrame:
    """One row per whole number first..last, expanded in two steps of bounded arrays."""
    return (
        df.withColumn("__a", first.cast("long"))
        .withColumn("__b", last.cast("long"))
        .filter(F.col("__a") <= F.col("__b"))
        .withColumn("__s", F.explode(F.expr(f"sequence(__a, __b, {step}L)")))
        .withColumn(name, F.explode(F.expr(f"sequence(__s, least(__s + {step - 1}L, __b))")))
        .drop("__a", "__b", "__s")
    )


def trim(
    samples: DataFrame,
    headers: DataFrame,
    start: str,
    end: str,
    fill: float = 0.0,
) -> DataFrame:
    """Samples of the window [start, end], zero-padded where a trace has none, numbered from 0.

    ``headers`` has ``trace_id, starttime, sampling_rate``.
    """
    t0, t1 = (micros(F.to_timestamp(F.lit(t))) for t in (start, end))
    rate = F.col("sampling_rate")
    head = headers.select(
        "trace_id",
        F.round((t0 - micros(F.col("starttime"))) / 1e6 * rate).cast("long").alias("__off"),
        F.round((t1 - t0) / 1e6 * rate).cast("long").alias("__last"),
    )
    grid = _number_range(head, F.lit(0), F.col("__last"), "i").select("trace_id", "i")
    moved = attach(samples, head, ["trace_id"]).withColumn("i", F.col("i") - F.col("__off")).filter(
        (F.col("i") >= 0) & (F.col("i") <= F.col("__last"))
    )
    return join_keys(grid, moved.select("trace_id", "i", "v"), ["trace_id", "i"], "left").withColumn(
        "v", F.coalesce("v", F.lit(float(fill)))
    )


def merge_segments(
    samples: DataFrame, order: str = "segment", keys: Sequence[str] = ("trace_id",), block: int = BLOCK
) -> DataFrame:
    """One trace per key from segments on a common sample numbering; gaps filled by straight lines.

    Where segments overlap the later one (by ``order``) wins. ``filled`` marks interpolated samples.
    Neighbours are found inside blocks of sample numbers; the last sample of a block meets the
    first of the next block through a row per block.
    """
    keys = list(keys)
    single = samples.groupBy(*keys, "i").agg(F.max_by("v", F.col(order)).alias("v")).withColumn(
        "__b", F.floor(F.col("i") / block)
    )
    inner = Window.partitionBy(*keys, "__b").orderBy("i")
    edges = (
        single.groupBy(*keys, "__b")
        .agg(F.min(F.struct("i", "v")).alias("__first"))
        .withColumn("__after", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__b")))
        .select(*keys, "__b", "__after")
    )
    paired = join_keys(
        single.withColumn("__next", F.lead(F.struct("i", "v")).over(inner)), edges, [*keys, "__b"]
    ).withColumn("__n", F.coalesce("__next", "__after"))
    gaps = _number_range(
        paired.filter(F.col("__n.i") - F.col("i") > 1).select(
            *keys, F.col("i").alias("__i0"), F.col("v").alias("__v0"), "__n"
        ),
        F.col("__i0") + 1,
        F.col("__n.i") - 1,
        "i",
    ).select(
        *keys,
        "i",
        (
            F.col("__v0")
            + (F.col("__n.v") - F.col("__v0")) * (F.col("i") - F.col("__i0")) / (F.col("__n.i") - F.col("__i0"))
        ).alias("v"),
        F.lit(True).alias("filled"),
    )
    return single.select(*keys, "i", "v", F.lit(False).alias("filled")).unionByName(gaps)


def motion_pairs(samples: DataFrame, keys: Sequence[str] = ("station",), component: str = "component") -> DataFrame:
    """Particle-motion pairs (E, N) and (Z, N): samples of three components with the same number."""
    of = lambda c: F.max(F.when(F.col(component) == c, F.col("v")))
    wide = samples.groupBy(*keys, "i").agg(of("E").alias("e"), of("N").alias("n"), of("Z").alias("z"))
    return wide.filter(F.col("e").isNotNull() & F.col("n").isNotNull() & F.col("z").isNotNull())


def segments(samples: DataFrame, keys: Sequence[str] = ("trace_id",), length: int | None = None) -> DataFrame:
    """Array rows ``keys, segment, data``: whole traces, or windows of ``length`` samples where asked for.

    Kernels on arrays begin anew in every row, so traces are cut only at a length the caller names. A
    row that would hold more than ``LARGEST`` samples is an error, not a silent cut.
    """
    at = F.lit(0) if length is None else F.floor(F.col("i") / length)
    cut = samples.withColumn("segment", at.cast("long"))
    held = F.when(
        F.count("*") > LARGEST, F.raise_error(F.lit(f"a trace holds more than {LARGEST} samples: name a window length"))
    ).otherwise(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]))
    return cut.groupBy(*keys, "segment").agg(held.alias("data"))
