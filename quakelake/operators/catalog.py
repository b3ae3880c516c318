"""Earthquake-catalog statistics.

Catalog columns: ``time, magnitude, longitude, latitude, depth`` and any grouping columns. Raw rows
are reduced to bins in one pass with map-side combining; everything after that works on bins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelake.functions import geo
from quakelake.functions.times import micros
from quakelake.operators.common import attach, join_keys, literal_rows, small_side, with_position
from quakelake.session import cut_lineage, local_folder

LOG10_E = math.log10(math.e)


# --- frequency-magnitude distribution -----------------------------------------------------------


def _centre(k: Column, width: float) -> Column:
    return F.round(k * F.lit(width), 10)


def magnitude_bins(
    df: DataFrame, width: float = 0.1, group_cols: Sequence[str] = (), magnitude: str = "magnitude"
) -> DataFrame:
    """Occupied magnitude bins per group with counts, sums and suffix totals, one array per group.

    Each event finds the highest bin whose lower edge (centre - width/2, in floating point) it
    reaches, by testing edges rather than dividing, so an event on an edge lands where the edge
    arithmetic puts it. ``bins`` is dense from floor(min/width) to ceil(max/width).
    """
    m = F.col(magnitude)
    half = width / 2
    guess = F.floor(m / F.lit(width) + 0.5) + 1
    low = lambda k: _centre(k, width) - half
    top = F.when(m >= low(guess), guess).when(m >= low(guess - 1), guess - 1).otherwise(guess - 2)
    binned = (
        df.filter(m.isNotNull())
        .select(*group_cols, m.alias("__m"), top.alias("__k"))
        .groupBy(*group_cols, "__k")
        .agg(
            F.count("*").alias("n_low"),
            F.count_if(F.col("__m") < _centre(F.col("__k"), width) + half).alias("n_in"),
            F.count_if(F.col("__m") < _centre(F.col("__k") - 1, width) + half).alias("n_below"),
            F.sum("__m").alias("total"),
            F.min("__m").alias("least"),
            F.max("__m").alias("most"),
        )
    )
    # One small row per (group, bin) from here on.
    per_group = binned.groupBy(*group_cols).agg(
        F.map_from_entries(
            F.collect_list(F.struct("__k", F.struct("n_low", "n_in", "n_below", "total")))
        ).alias("at"),
        F.floor(F.min("least") / F.lit(width)).alias("k0"),
        F.ceil(F.max("most") / F.lit(width)).alias("k1"),
    ).filter(F.col("k0").isNotNull())
    dense = per_group.select(
        *group_cols,
        F.explode(F.sequence("k0", "k1")).alias("k"),
        "at",
    ).select(
        *group_cols,
        "k",
        _centre(F.col("k"), width).alias("mag_bin"),
        (
            F.coalesce(F.try_element_at("at", F.col("k"))["n_in"], F.lit(0))
            + F.coalesce(F.try_element_at("at", F.col("k") + 1)["n_below"], F.lit(0))
        ).alias("n"),
        F.coalesce(F.try_element_at("at", F.col("k"))["n_low"], F.lit(0)).alias("__n"),
        F.coalesce(F.try_element_at("at", F.col("k"))["total"], F.lit(0.0)).alias("__t"),
    )
    suffix = (
        Window.partitionBy(*group_cols).orderBy("k").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    return dense.select(
        *group_cols,
        "mag_bin",
        "n",
        F.sum("__n").over(suffix).alias("n_cum"),
        F.sum("__t").over(suffix).alias("sum_cum"),
    )


def frequency_magnitude(
    df: DataFrame, width: float = 0.1, group_cols: Sequence[str] = (), magnitude: str = "magnitude"
) -> DataFrame:
    """Bin centre, events in the bin, and events at or above its lower edge; empty bins kept."""
    return magnitude_bins(df, width, group_cols, magnitude).drop("sum_cum")


def mc_max_curvature(
    df: DataFrame,
    width: float = 0.1,
    group_cols: Sequence[str] = (),
    correction: float = 0.2,
    magnitude: str = "magnitude",
) -> DataFrame:
    """Completeness magnitude: the fullest bin (lowest on ties) plus a correction."""
    return _max_curvature(magnitude_bins(df, width, group_cols, magnitude), group_cols, correction)


def _max_curvature(bins: DataFrame, group_cols: Sequence[str], correction: float = 0.2) -> DataFrame:
    return (
        bins.groupBy(*group_cols)
        .agg(
            F.min_by("mag_bin", F.struct(-F.col("n"), F.col("mag_bin"))).alias("peak"),
            F.count("*").alias("n_bins"),
        )
        .filter(F.col("n_bins") > 0)
        .select(*group_cols, "peak", F.round(F.col("peak") + correction, 2).alias("mc"))
    )


def mc_goodness_of_fit(
    df: DataFrame,
    width: float = 0.1,
    group_cols: Sequence[str] = (),
    r_threshold: float = 95.0,
    correction: float = 0.2,
    min_events: int = 10,
    magnitude: str = "magnitude",
) -> DataFrame:
    """Lowest bin from the peak on whose fitted line misses the cumulative counts by at most 100-r %.

    Falls back to maximum curvature. ``residual`` is the misfit at the chosen bin, NULL on fallback.
    """
    bins = magnitude_bins(df, width, group_cols, magnitude)
    return _goodness_of_fit(bins, width, group_cols, r_threshold, correction, min_events)


def _goodness_of_fit(
    bins: DataFrame,
    width: float,
    group_cols: Sequence[str],
    r_threshold: float = 95.0,
    correction: float = 0.2,
    min_events: int = 10,
) -> DataFrame:
    packed = bins.groupBy(*group_cols).agg(
        F.sort_array(F.collect_list(F.struct("mag_bin", "n", "n_cum", "sum_cum"))).alias("b"),
        F.min_by("mag_bin", F.struct(-F.col("n"), F.col("mag_bin"))).alias("peak"),
    ).filter(F.size("b") > 0)

    def trial(bin_row: Column) -> Column:
        mc = bin_row["mag_bin"]
        count = bin_row["n_cum"]
        b = F.try_divide(F.lit(LOG10_E), F.try_divide(bin_row["sum_cum"], count) - (mc - width / 2))
        a = F.log10(count.cast("double")) + b * mc
        tail = F.filter(F.col("b"), lambda y: y["mag_bin"] >= mc)
        miss = F.aggregate(
            tail,
            F.lit(0.0),
            lambda acc, y: acc + F.abs(y["n_cum"] - F.pow(F.lit(10.0), a - b * y["mag_bin"])),
        )
        seen = F.aggregate(tail, F.lit(0.0), lambda acc, y: acc + y["n_cum"])
        return F.struct(mc.alias("mc"), (F.try_divide(miss, seen) * 100).alias("residual"))

    candidates = F.filter(
        F.col("b"), lambda x: (x["mag_bin"] >= F.col("peak")) & (x["n_cum"] >= min_events)
    )
    good = F.filter(F.transform(candidates, trial), lambda t: t["residual"] <= 100 - r_threshold)
    best = F.get(good, F.lit(0))
    return packed.select(*group_cols, "peak", best.alias("best")).select(
        *group_cols,
        "peak",
        F.round(F.coalesce(F.col("best.mc"), F.round(F.col("peak") + correction, 2)), 2).alias("mc"),
        F.col("best.residual").alias("residual"),
    )


def completeness(
    df: DataFrame,
    width: float = 0.1,
    group_cols: Sequence[str] = (),
    method: str = "maxcurvature",
    magnitude: str = "magnitude",
) -> DataFrame:
    """``group_cols, mc`` by the named method."""
    return _completeness(magnitude_bins(df, width, group_cols, magnitude), width, group_cols, method)


def _completeness(bins: DataFrame, width: float, group_cols: Sequence[str], method: str) -> DataFrame:
    if method == "gof":
        found = _goodness_of_fit(bins, width, group_cols)
    elif method == "maxcurvature":
        found = _max_curvature(bins, group_cols)
    else:
        raise ValueError(f"unknown completeness method: {method}")
    return found.select(*group_cols, "mc")


def with_mc(
    df: DataFrame,
    mc: float | None,
    width: float,
    group_cols: Sequence[str],
    method: str,
    magnitude: str,
) -> DataFrame:
    if mc is not None:
        return df.withColumn("mc", F.lit(float(mc)))
    return attach(df, completeness(df, width, group_cols, method, magnitude), group_cols)


def b_value_mle(
    df: DataFrame,
    mc: float | None = None,
    width: float = 0.1,
    group_cols: Sequence[str] = (),
    mc_method: str = "maxcurvature",
    sigma: str = "sample",
    magnitude: str = "magnitude",
) -> DataFrame:
    """Maximum-likelihood b-value per group.

    ``sigma='sample'`` divides the sample deviation by sqrt(n(n-1)); ``'shi_bolt'`` is the published
    form (the sample deviation over sqrt(n)). Groups with fewer than 3 events give NULL values.
    """
    m = F.col(magnitude)
    base = df.select(*group_cols, magnitude).filter(m.isNotNull())
    stats = (
        with_mc(base, mc, width, group_cols, mc_method, magnitude)
        .filter(m >= F.col("mc") - width / 2)
        .groupBy(*group_cols)
        .agg(
            F.max("mc").alias("mc"),
            F.count("*").alias("n_events"),
            F.avg(m).alias("mean_magnitude"),
            F.stddev_samp(m).alias("__s"),
        )
    )
    n = F.col("n_events").cast("double")
    b = F.try_divide(F.lit(LOG10_E), F.col("mean_magnitude") - (F.col("mc") - width / 2))
    spread = F.sqrt(n * (n - 1)) if sigma == "sample" else F.sqrt(n)
    enough = F.col("n_events") >= 3
    return (
        stats.filter(F.col("n_events") > 0)
        .withColumn("b_value", F.when(enough, b))
        .withColumn(
            "b_uncertainty",
            F.when(enough, F.try_divide(F.col("b_value") * F.col("b_value") * 2.3 * F.col("__s"), spread)),
        )
        .withColumn("a_value", F.log10(n) + F.col("b_value") * F.col("mc"))
        .select(*group_cols, "mc", "b_value", "b_uncertainty", "a_value", "n_events", "mean_magnitude")
    )


def b_value_lsq(
    df: DataFrame,
    mc: float | None = None,
    width: float = 0.1,
    group_cols: Sequence[str] = (),
    mc_method: str = "maxcurvature",
    magnitude: str = "magnitude",
) -> DataFrame:
    """b-value from a straight line through log10 of the cumulative counts at and above Mc.

    Groups with fewer than two usable bins are left out.
    """
    bins = magnitude_bins(df.select(*group_cols, magnitude), width, group_cols, magnitude)
    if mc is not None:
        lined = bins.withColumn("mc", F.lit(float(mc)))
    elif mc_method == "maxcurvature":
        # The peak of each group over its own bins: no second pass over the events.
        peak = F.min_by("mag_bin", F.struct(-F.col("n"), F.col("mag_bin"))).over(Window.partitionBy(*group_cols))
        lined = bins.withColumn("mc", F.round(peak + 0.2, 2))
    else:
        lined = attach(bins, _completeness(bins, width, group_cols, mc_method), group_cols)
    x, y = F.col("mag_bin"), F.log10(F.col("n_cum").cast("double"))
    fit = (
        lined.filter((x >= F.col("mc") - width / 2) & (F.col("n_cum") > 0))
        .groupBy(*group_cols)
        .agg(
            F.max("mc").alias("mc"),
            F.count("*").alias("n_bins"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("a_value"),
            F.regr_sxx(y, x).alias("sxx"),
            F.collect_list(F.struct(x.alias("x"), y.alias("y"))).alias("pts"),
            F.max("n_cum").alias("n_events"),
        )
        .filter(F.col("n_bins") >= 2)
    )
    ssr = F.aggregate(
        "pts",
        F.lit(0.0),
        lambda acc, p: acc
        + F.pow(p["y"] - (F.col("a_value") + F.col("slope") * p["x"]), F.lit(2.0)),
    )
    error = F.sqrt(ssr / F.greatest(F.col("n_bins") - 2, F.lit(1)))
    line = fit.select(
        *group_cols,
        "mc",
        (-F.col("slope")).alias("b_value"),
        F.try_divide(error, F.sqrt("sxx")).alias("b_uncertainty"),
        "a_value",
        "n_events",
        "n_bins",
    )
    # The mean needs the events again; the fitted lines are one small row per group.
    line = small_side(line)
    m = F.col(magnitude)
    means = (
        attach(df.select(*group_cols, magnitude), line.select(*group_cols, "mc"), group_cols)
        .filter(m >= F.col("mc") - width / 2)
        .groupBy(*group_cols)
        .agg(F.avg(m).alias("mean_magnitude"))
    )
    if not group_cols:
        return line.withColumn("mean_magnitude", means.scalar())
    return join_keys(means, line, group_cols).select(*line.columns, "mean_magnitude")


def gr_fit(
    df: DataFrame, width: float = 0.1, group_cols: Sequence[str] = (), method: str = "mle", **options
) -> DataFrame:
    """Observed bins from Mc - 0.05 up with the fitted Gutenberg-Richter count beside them."""
    estimate = {"mle": b_value_mle, "lsq": b_value_lsq}[method]
    line = estimate(df, width=width, group_cols=group_cols, **options).select(
        *group_cols, "mc", "a_value", "b_value"
    )
    bins = frequency_magnitude(df, width, group_cols)
    return (
        attach(bins, line, group_cols)
        .filter(F.col("mag_bin") >= F.col("mc") - 0.05)
        .withColumn("n_fit", F.pow(F.lit(10.0), F.col("a_value") - F.col("b_value") * F.col("mag_bin")))
        .select(*group_cols, "mag_bin", "n", "n_cum", "n_fit")
    )


# --- summaries ----------------------------------------------------------------------------------


def summary(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Record count (the fuller of times and magnitudes) and ranges."""
    ranges = [
        f(c).alias(f"{c}_{n}")
        for c in ("time", "magnitude", "longitude", "latitude", "depth")
        for n, f in (("min", F.min), ("max", F.max))
        if c in df.columns
    ]
    return df.groupBy(*group_cols).agg(
        F.greatest(F.count("time"), F.count("magnitude")).alias("n_records"), *ranges
    )


def phase_counts(df: DataFrame, phase: str = "phase") -> DataFrame:
    """Phase histogram, most frequent first."""
    return (
        df.filter(F.col(phase).isNotNull())
        .groupBy(phase)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), phase)
    )


def preview_summary(df: DataFrame) -> DataFrame:
    """Rounded ranges for display: magnitude 2, depth 1, coordinates 3 decimals."""
    places = {"magnitude": 2, "depth": 1, "longitude": 3, "latitude": 3}
    return df.agg(
        F.count("*").alias("n_events"),
        *[
            F.round(f(c), p).alias(f"{c}_{n}")
            for c, p in places.items()
            if c in df.columns
            for n, f in (("min", F.min), ("max", F.max))
        ],
    )


def preview_rows(df: DataFrame, n: int = 20, order: Sequence[str] = ("time",)) -> DataFrame:
    return df.orderBy(*order).limit(n)


# --- rates and histograms -----------------------------------------------------------------------


def _bin_starts(spans: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return spans.select(*group_cols, "t0", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))


def seismicity_rate(
    df: DataFrame, bin_hours: float = 24.0, group_cols: Sequence[str] = (), time: str = "time"
) -> DataFrame:
    """Events per time bin from the first event on, with running totals; empty bins kept.

    The number of bins is the whole bins in the span (at least 1); the last takes the remainder.
    """
    events = df.filter(F.col(time).isNotNull()).select(*group_cols, micros(F.col(time)).alias("__t"))
    bin_us = bin_hours * 3_600_000_000.0
    hours = (F.max("__t") - F.min("__t")) / F.lit(3_600_000_000.0)
    spans = events.groupBy(*group_cols).agg(
        F.min("__t").alias("t0"),
        F.greatest(
            F.floor(F.greatest(hours, F.lit(float(bin_hours))) / F.lit(float(bin_hours))).cast("int"), F.lit(1)
        ).alias("n_bins"),
    ).filter(F.col("t0").isNotNull())
    counted = (
        attach(events, spans, group_cols)
        .select(
            *group_cols,
            F.least(
                F.floor((F.col("__t") - F.col("t0")) / F.lit(3_600_000_000.0) / F.lit(float(bin_hours))).cast("int"),
                F.col("n_bins") - 1,
            ).alias("bin"),
        )
        .groupBy(*group_cols, "bin")
        .agg(F.count("*").alias("n"))
    )
    grid = _bin_starts(spans, group_cols)
    joined = join_keys(grid, counted, [*group_cols, "bin"], "left")
    running = Window.partitionBy(*group_cols).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.col("t0") + (F.col("bin") * F.lit(bin_us)).cast("long")).cast("long")
    return (
        joined.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
        .withColumn("n_cum", F.sum("n").over(running))
        .withColumn("bin_start", F.timestamp_micros(start))
        .withColumn("bin_centre", F.timestamp_micros((start + F.lit(int(bin_us // 2))).cast("long")))
        .select(*group_cols, F.col("bin").cast("long").alias("bin"), "bin_start", "bin_centre", "n", "n_cum")
    )


def value_histogram(
    df: DataFrame, value: str = "depth", n_bins: int = 30, group_cols: Sequence[str] = ()
) -> DataFrame:
    """Equal-width histogram with the last bin closed; empty bins kept.

    Events are placed by edge comparison after a division, so a value on an edge opens its bin.
    A constant column gets the unit-wide range around it.
    """
    v = F.col(value)
    data = df.filter(v.isNotNull()).select(*group_cols, v.cast("double").alias("__v"))
    spans = data.groupBy(*group_cols).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi")).filter(
        F.col("lo").isNotNull()
    )
    flat = F.col("lo") == F.col("hi")
    spans = spans.select(
        *group_cols,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(n_bins)))
    edge = lambda k: F.when(k == n_bins, F.col("hi")).otherwise(F.col("lo") + k * F.col("step"))
    k = F.least(
        F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(n_bins))).cast("int"),
        F.lit(n_bins - 1),
    )
    placed = attach(data, spans, group_cols).withColumn("__k", k)
    placed = placed.select(
        *group_cols,
        F.when(F.col("__v") < edge(F.col("__k")), F.col("__k") - 1)
        .when((F.col("__v") >= edge(F.col("__k") + 1)) & (F.col("__k") != n_bins - 1), F.col("__k") + 1)
        .otherwise(F.col("__k"))
        .alias("bin"),
    )
    counted = placed.groupBy(*group_cols, "bin").agg(F.count("*").alias("n"))
    grid = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return join_keys(grid, counted, [*group_cols, "bin"], "left").select(
        *group_cols,
        F.col("bin").cast("long").alias("bin"),
        edge(F.col("bin")).alias("bin_low"),
        edge(F.col("bin") + 1).alias("bin_high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def cumulative_events(
    df: DataFrame,
    group_cols: Sequence[str] = (),
    time: str = "time",
    ties: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Each event with its running count by time, numbered through equal-count time ranges."""
    return with_position(
        df.filter(F.col(time).isNotNull()), group_cols, micros(F.col(time)), ties, "n_cum", buckets
    )


def marker_size(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Map symbol size 10 * 2^(M - min M) kept within 5..300, and the plain (3M)^2 variant."""
    least = df.groupBy(*group_cols).agg(F.min("magnitude").alias("__least"))
    m = F.col("magnitude")
    return (
        attach(df, least, group_cols)
        .withColumn(
            "size",
            F.greatest(
                F.lit(5.0), F.least(F.lit(300.0), F.pow(F.lit(2.0), m - F.col("__least")) * 10)
            ),
        )
        .withColumn("size_square", (m * 3) * (m * 3))
        .drop("__least")
    )


# --- selections ---------------------------------------------------------------------------------


def complete_part(df: DataFrame, mc: float, width: float = 0.1) -> DataFrame:
    """Events at or above the lower edge of the completeness bin."""
    return df.filter(F.col("magnitude") >= mc - width / 2)


# Column names other programs use for the canonical catalog columns.
WORKFLOW_NAMES = {"longitude": "lon", "latitude": "lat", "depth_km": "depth", "ml": "magnitude"}


def above_mc(df: DataFrame, mc: float) -> DataFrame:
    """Rename to the short column names, then keep events with M >= Mc."""
    for old, new in WORKFLOW_NAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.filter(F.col("magnitude") >= mc)


def in_region(df: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    return df.filter(geo.in_region(F.col("longitude"), F.col("latitude"), region))


def depth_slice(df: DataFrame, depth: float, half_width: float = 2.0, column: str = "depth") -> DataFrame:
    return df.filter(F.abs(F.col(column) - depth) < half_width)


def profile(
    df: DataFrame, p1: tuple[float, float], p2: tuple[float, float], half_width_km: float = 50.0
) -> DataFrame:
    """Events within a corridor around the line p1-p2, with distance along and off it."""
    along, across = geo.along_and_across(F.col("longitude"), F.col("latitude"), p1, p2)
    return (
        df.withColumn("along_km", along)
        .withColumn("across_km", across)
        .filter(F.abs("across_km") <= half_width_km)
    )


def with_epicentral_distance(df: DataFrame, ref_lon: float, ref_lat: float) -> DataFrame:
    return df.withColumn(
        "epicentral_km", geo.epicentral_km(F.col("longitude"), F.col("latitude"), ref_lon, ref_lat)
    )


def time_series(df: DataFrame) -> DataFrame:
    """The series behind magnitude-time and depth-time plots."""
    return df.select("time", "magnitude", "depth").filter(F.col("time").isNotNull()).orderBy("time", "magnitude", "depth")


#: Degrees of a cell of the finest grid of segments, and its doublings up to the whole globe.
FAULT_CELL, FAULT_LEVELS = 0.125, 13


def _segment_cells(segments: DataFrame, cell: float) -> DataFrame:
    """Segments with every cell that they pass through: row by row of the grid, then along the row."""
    pad = 1e-9
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    rows = segments.withColumn("y", F.explode(F.sequence(F.floor((low - pad) / cell), F.floor((high + pad) / cell))))
    dy = F.col("lat2") - F.col("lat1")
    bottom, top = F.greatest(F.col("y") * cell - pad, low), F.least((F.col("y") + 1) * cell + pad, high)

    def lon(lat: Column) -> Column:
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(lat - F.col("lat1"), dy)))
        return F.col("lon1") + along * (F.col("lon2") - F.col("lon1"))

    flat = F.abs(dy) < 1e-6
    ends = [F.when(flat, F.col("lon1")).otherwise(lon(bottom)), F.when(flat, F.col("lon2")).otherwise(lon(top))]
    first, last = F.floor((F.least(*ends) - pad) / cell), F.floor((F.greatest(*ends) + pad) / cell)
    return rows.withColumn("x", F.explode(F.sequence(first, last)))


def _nearest_by_grid(events: DataFrame, segments: DataFrame, event_id: str, cell: float) -> DataFrame:
    """Nearest segments from the nine cells around each event, in coarser and coarser grids.

    What lies outside those cells is at least one cell away, so an event whose nearest segment is
    closer than that is done; the others go on in cells of twice the size. At the last size the nine
    cells hold the globe.
    """
    fine = _segment_cells(segments, cell)
    lon, lat = F.col("longitude"), F.col("latitude")
    places = events.select(event_id, "longitude", "latitude")
    open_ = places.filter(lon.isNotNull() & lat.isNotNull()).withColumns(
        {"cx": F.floor(lon / cell), "cy": F.floor(lat / cell)}
    )
    kind = f"struct<km:double,id:{segments.schema['segment_id'].dataType.simpleString()}>"
    done = places.filter(lon.isNull() | lat.isNull()).select(event_id, F.lit(None).cast(kind).alias("__near"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for level in range(FAULT_LEVELS):
        cells = fine.withColumns({"x": F.shiftright("x", level), "y": F.shiftright("y", level)}).distinct()
        asked = open_.withColumn("__d", around).withColumns(
            {"x": F.shiftright("cx", level) + F.col("__d.i"), "y": F.shiftright("cy", level) + F.col("__d.j")}
        )
        met = asked.join(cells, ["x", "y"])
        one = F.array(F.struct("segment_id", "lon1", "lat1", "lon2", "lat2"))
        best = met.groupBy(event_id).agg(F.min(geo.nearest_segment(lon, lat, one)).alias("__near"))
        scored = cut_lineage(open_.join(best, event_id, "left"), local_folder(events.sparkSession))
        reach = F.greatest(F.lit(0.0), F.cos(F.radians(lat))) * (cell * 2**level * geo.KM_PER_DEGREE * (1 - 1e-9))
        sure = F.coalesce(F.col("__near.km") <= reach, F.lit(False)) if level < FAULT_LEVELS - 1 else F.lit(True)
        done = done.unionByName(scored.filter(sure).select(event_id, "__near"))
        open_ = scored.filter(~sure).drop("__near")
        if open_.isEmpty():
            break
    return done


def nearest_fault(
    events: DataFrame, segments: DataFrame, event_id: str = "event_id", max_rows: int = 2_000, cell: float = FAULT_CELL
) -> DataFrame:
    """Distance of each event to its nearest fault segment, the smaller id on ties.

    ``segments`` has ``segment_id, lon1, lat1, lon2, lat2``; those with a null are left out, and
    events without a place or without segments have nulls. Few segments ride along as a plan
    constant. More are laid out on a grid of ``cell`` degrees, and an event meets only those of the
    cells around it. ``event_id`` is unique.
    """
    seg = segments.select("segment_id", "lon1", "lat1", "lon2", "lat2").dropna()
    lon, lat = F.col("longitude"), F.col("latitude")
    constant = literal_rows(seg, max_rows)
    if constant is not None:
        near = geo.nearest_segment(lon, lat, F.col("__segs")).alias("__near")
        nearest = events.withColumn("__segs", constant).select(event_id, near)
    else:
        nearest = _nearest_by_grid(events, seg, event_id, cell)
    return nearest.select(
        event_id,
        F.col("__near.km").alias("fault_km"),
        F.when(F.col("__near.km").isNotNull(), F.col("__near.id")).alias("segment_id"),
    )
