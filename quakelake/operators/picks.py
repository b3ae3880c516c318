"""Phase picks: selection, components, polarity windows, grouping into events, time differences."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelake.functions.times import micros
from quakelake.operators.common import gap_groups, join_keys, order_buckets, small_side

# Model phase codes, channel priority per component, half polarity window.
PHASE_CODES = {0: "Pg", 1: "Sg", 2: "Pn", 3: "Sn", 4: "P", 5: "S"}
BANDS = ["BH", "HH", "SH", "EI", "HN"]
COMPONENTS = ["E", "N", "Z"]
HALF_WINDOW = 512


def last_code(station: Column) -> Column:
    """Station part of ``NET.STA``: its last dotted part."""
    return F.element_at(F.split(station, r"\."), -1)


def at_stations(df: DataFrame, wanted: Sequence[str], network: str = "network", station: str = "station") -> DataFrame:
    """Rows of the named stations: ``NET.STA`` equal, or the station code alone equal."""
    names = [w.upper() for w in wanted]
    full = F.upper(F.concat_ws(".", network, station))
    return df.filter(full.isin(names) | F.upper(station).isin([n.split(".")[-1] for n in names]))


def of_phase(picks: DataFrame, phase: str) -> DataFrame:
    return picks.filter(F.col("phase") == phase)


def station_counts(picks: DataFrame) -> DataFrame:
    """Picks, mean confidence and time range per station and phase."""
    return picks.groupBy("station", "phase").agg(
        F.count("*").alias("n"),
        F.avg("confidence").alias("confidence"),
        F.min("abs_time").alias("first"),
        F.max("abs_time").alias("last"),
    )


def decode_model_picks(raw: DataFrame, sampling_rate: float = 100.0) -> DataFrame:
    """Phase names, seconds and confidences of model rows ``code, sample, conf`` (3 decimals)."""
    code = F.col("code").cast("int")
    name = F.coalesce(
        *[F.when(code == k, v) for k, v in PHASE_CODES.items()], F.concat(F.lit("P"), code.cast("string"))
    )
    return raw.select(
        *[c for c in raw.columns if c not in ("code", "sample", "conf")],
        name.alias("phase"),
        F.round(F.col("sample") / sampling_rate, 3).alias("time_s"),
        F.round("conf", 3).alias("confidence"),
        F.col("sample").cast("long").alias("sample"),
    )


# --- components ---------------------------------------------------------------------------------


def component_sets(traces: DataFrame, keys: Sequence[str] = ("station",), channel: str = "channel") -> DataFrame:
    """Components present per station and whether all three are (1 and 2 count as N and E)."""
    letter = F.upper(F.right(F.col(channel), F.lit(1)))
    component = F.when(letter == "1", "N").when(letter == "2", "E").otherwise(letter)
    return (
        traces.select(*keys, component.alias("c"))
        .filter(F.col("c").isin(COMPONENTS))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("c")).alias("components"))
        .withColumn("complete", F.size("components") == 3)
    )


def completeness_counts(sets: DataFrame) -> DataFrame:
    return sets.agg(
        F.count_if("complete").alias("n_complete"), F.count_if(~F.col("complete")).alias("n_incomplete")
    )


def fill_components(sets: DataFrame, policy: str = "skip") -> DataFrame:
    """Source component for each of E, N, Z: incomplete stations skipped, or a present one repeated."""
    if policy == "skip":
        kept = sets.filter("complete")
    elif policy == "duplicate":
        kept = sets
    else:
        raise ValueError(f"unknown policy: {policy}")
    has = lambda c: F.array_contains("components", c)
    any_one = F.element_at("components", -1)
    return kept.withColumns({f"use_{c.lower()}": F.when(has(c), c).otherwise(any_one) for c in COMPONENTS})


def component_choice(
    traces: DataFrame, keys: Sequence[str] = ("network", "station", "location"), order: str = "trace_no"
) -> DataFrame:
    """The trace used for each component: ``keys, component, trace_no``.

    Bands are tried in order BH, HH, SH, EI, HN; without all three components the first three
    traces stand in, and stations with fewer than three traces are left out.
    """
    component = F.upper(F.right("channel", F.lit(1)))
    band = F.coalesce(*[F.when(F.upper(F.left("channel", F.lit(2))) == b, i) for i, b in enumerate(BANDS)])
    best = lambda c: F.min_by(order, F.when((component == c) & band.isNotNull(), F.struct(band, F.col(order))))
    first3 = lambda i: F.get(F.col("__any"), F.lit(i))
    lead = traces.select(*keys, order, "channel")
    low = Window.partitionBy(*keys).orderBy(order)
    firsts = (
        lead.withColumn("__r", F.row_number().over(low)).filter("__r <= 3").groupBy(*keys)
        .agg(F.array_sort(F.collect_list(order)).alias("__any"))
    )
    chosen = lead.groupBy(*keys).agg(*[best(c).alias(c) for c in COMPONENTS])
    full = F.col("E").isNotNull() & F.col("N").isNotNull() & F.col("Z").isNotNull()
    both = join_keys(chosen, firsts, list(keys)).filter(full | (F.size("__any") == 3))
    picked = F.when(full, F.array("E", "N", "Z")).otherwise(F.array(first3(0), first3(1), first3(2)))
    return both.select(*keys, F.posexplode(picked).alias("c", order)).select(
        *keys, F.element_at(F.array(*map(F.lit, COMPONENTS)), F.col("c") + 1).alias("component"), order
    )


def align_components(
    traces: DataFrame, keys: Sequence[str] = ("network", "station", "location"), order: str = "trace_no"
) -> DataFrame:
    """Three components cut to their common time span: ``keys, starttime, sampling_rate, data``.

    ``data`` is an array of ``struct(e, n, z)``; stations whose traces do not overlap give no row.
    Traces are array rows with ``starttime`` and one ``sampling_rate`` per station.
    """
    chosen = component_choice(traces, keys, order)
    body = traces.select(F.col(order).alias("__o"), "starttime", "sampling_rate", "data")
    start = micros(F.col("starttime"))
    span = F.struct(
        start.alias("t0"),
        (start + ((F.size("data") - 1) / F.col("sampling_rate") * 1e6).cast("long")).alias("t1"),
        F.col("sampling_rate").alias("sr"),
        F.col("data").alias("x"),
    )
    of = lambda c: F.max_by(span, F.when(F.col("component") == c, F.lit(1))).alias(c)
    wide = chosen.join(body, F.col(order) == F.col("__o")).groupBy(*keys).agg(*[of(c) for c in COMPONENTS])
    timed = wide.withColumn("__t0", F.greatest(*[F.col(f"{c}.t0") for c in COMPONENTS])).withColumn(
        "__t1", F.least(*[F.col(f"{c}.t1") for c in COMPONENTS])
    ).filter(F.col("__t1") > F.col("__t0"))
    n = (F.round((F.col("__t1") - F.col("__t0")) / 1e6 * F.col("Z.sr")) + 1).cast("int")
    cut = lambda c: F.slice(
        F.col(f"{c}.x"), (F.round((F.col("__t0") - F.col(f"{c}.t0")) / 1e6 * F.col(f"{c}.sr")) + 1).cast("int"), n
    )
    return timed.select(
        *keys,
        F.timestamp_micros("__t0").alias("starttime"),
        F.col("Z.sr").alias("sampling_rate"),
        F.arrays_zip(cut("E").alias("e"), cut("N").alias("n"), cut("Z").alias("z")).alias("data"),
    ).withColumn(
        "data",
        F.filter("data", lambda s: s["e"].isNotNull() & s["n"].isNotNull() & s["z"].isNotNull()),
    )


# Channel groups known to the pickers.
CHANNEL_GROUPS = [[b + c for c in COMPONENTS] for b in ("BH", "SH", "HH", "EI", "HN")]


def data_format(listing: DataFrame, path: str = "path") -> DataFrame:
    """Most common extension, position of the channel in file names, and the channels seen."""
    name = F.element_at(F.split(path, "/"), -1)
    known = [c for g in CHANNEL_GROUPS for c in g]
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), r"\.")
    at = F.coalesce(F.array_position(F.transform(parts, lambda p: F.upper(p).isin(known)), True), F.lit(0)) - 1
    named = listing.select(ext.alias("ext"), at.alias("at"), F.when(at >= 0, F.upper(F.get(parts, at.cast("int")))).alias("ch"))
    # Few distinct (extension, position, channel) triples remain after this aggregate.
    few = named.groupBy("ext", "at", "ch").agg(F.count("*").alias("n"))
    exts = few.groupBy("ext").agg(F.sum("n").alias("n")).agg(F.max_by("ext", F.struct("n", "ext")).alias("extension"))
    spots = few.filter("at >= 0").groupBy("at").agg(F.sum("n").alias("n")).agg(F.max_by("at", F.struct("n", -F.col("at"))).alias("at"))
    channels = few.filter("ch IS NOT NULL").agg(F.array_sort(F.collect_set("ch")).alias("ch"))
    return exts.select(
        "extension",
        F.coalesce(spots.scalar(), F.lit(3)).cast("long").alias("channel_index"),
        channels.scalar().alias("channels"),
    )


def active_groups(formats: DataFrame) -> DataFrame:
    """Channel groups with a channel seen; all groups when none is."""
    groups = F.array(*[F.array(*map(F.lit, g)) for g in CHANNEL_GROUPS])
    used = F.filter(groups, lambda g: F.arrays_overlap(g, F.col("channels")))
    return formats.withColumn("groups", F.when(F.size(used) > 0, used).otherwise(groups))


# --- polarity -----------------------------------------------------------------------------------


def polarity_windows(picks: DataFrame, traces: DataFrame, keys: Sequence[str] = ("file", "station")) -> DataFrame:
    """Samples [i-512, i+512) around each pick on the vertical trace of its own file.

    ``picks`` has ``rel_time``; ``traces`` has ``sampling_rate, data``. Picks too near an end get
    no window and the reason ``out_of_bounds``; picks without a trace are dropped.

    Traces are cut into blocks of a window's length, each row holding its block and the next, so
    that a pick meets one such row and not the whole trace, and a busy station is as many keys as it
    has blocks.
    """
    keys, width = list(keys), 2 * HALF_WINDOW
    heads = traces.select(*keys, "sampling_rate", F.size("data").alias("__n"))
    at = F.floor(F.col("rel_time") * F.col("sampling_rate"))
    placed = (
        picks.join(heads, keys)
        .withColumn("__first", at - HALF_WINDOW)
        .withColumn("__ok", (F.col("__first") >= 0) & (F.col("__first") <= F.col("__n") - width))
        .withColumn("__block", F.when(F.col("__ok"), F.floor(F.col("__first") / width)))
    )
    last = F.floor(F.greatest(F.size("data") - 1, F.lit(0)) / width)
    blocks = traces.select(*keys, "data", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("__block")).select(
        *keys, "__block", F.slice("data", (F.col("__block") * width + 1).cast("int"), F.lit(2 * width)).alias("__part")
    )
    window = F.slice("__part", (F.col("__first") - F.col("__block") * width + 1).cast("int"), F.lit(width))
    return placed.join(blocks, [*keys, "__block"], "left").select(
        *[F.col(c) for c in picks.columns],
        F.when(F.col("__ok"), window).alias("window"),
        F.when(F.col("__ok"), "ok").otherwise("out_of_bounds").alias("reason"),
    )


def score_windows(windows: DataFrame, scorer: Callable[[list], list], column: str = "probs") -> DataFrame:
    """Add class probabilities from a user-supplied scorer (list of windows in, list of lists out)."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in windows.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            have = batch["window"].notna()
            scores = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if have.any():
                scores[have] = pd.Series(scorer(batch.loc[have, "window"].tolist()), index=batch.index[have], dtype=object)
            yield batch.assign(**{column: scores})

    return windows.mapInPandas(run, ", ".join([*fields, f"{column} array<double>"]))


def decide_polarity(scored: DataFrame, min_confidence: float = 0.5, probs: str = "probs") -> DataFrame:
    """U when the first class is the most likely, else D; N below the confidence or without a window."""
    top = F.array_max(probs)
    first = F.array_position(probs, top) == 1
    return scored.withColumn(
        "polarity",
        F.when(top.isNull() | (top < min_confidence), "N").when(first, "U").otherwise("D"),
    ).withColumn("prob", F.coalesce(top, F.lit(0.0)))


def polarity_tally(decided: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    of = lambda p: F.count_if(F.col("polarity") == p)
    return decided.groupBy(*keys).agg(
        F.count("*").alias("n"), of("U").alias("n_up"), of("D").alias("n_down"), of("N").alias("n_uncertain")
    )


# --- picks and traces, stations, events ---------------------------------------------------------


def picks_on_traces(picks: DataFrame, traces: DataFrame, cell_seconds: int = 86_400) -> DataFrame:
    """Picks that fall inside a trace of their station, with seconds from its start.

    ``traces`` has ``trace_id, station, starttime, sampling_rate, npts``; a pick names the station
    by its code or as ``NET.STA``. Traces are laid out over the cells of time that they cover (a day
    each), and a pick meets only those of its own station and cell, so a busy station is many keys.
    Picks and traces without a time, station or rate meet nothing.
    """
    cell = cell_seconds * 1_000_000
    start = micros(F.col("starttime"))
    seconds = (F.col("npts") - 1) / F.col("sampling_rate")
    first, last = F.floor(start / cell), F.floor((start + F.ceil(seconds * 1_000_000)) / cell)
    spans = (
        traces.filter((F.col("npts") > 0) & (F.col("sampling_rate") > 0))
        .select("trace_id", F.col("station").alias("__sta"), start.alias("__t0"), seconds.alias("__len"), F.explode(F.sequence(first, last)).alias("__span"))
    )
    at = micros(F.col("abs_time"))
    return (
        picks.withColumn("__code", last_code(F.col("station")))
        .withColumn("__cell", F.floor(at / cell))
        .join(spans, (F.col("__code") == F.col("__sta")) & (F.col("__cell") == F.col("__span")))
        .withColumn("rel_time", (at - F.col("__t0")) / 1e6)
        .filter((F.col("rel_time") >= 0) & (F.col("rel_time") <= F.col("__len")))
        .drop("__code", "__sta", "__t0", "__len", "__cell", "__span")
    )


def with_station(picks: DataFrame, stations: DataFrame) -> DataFrame:
    """Picks with the coordinates of their station; picks of unknown stations are dropped."""
    return picks.join(small_side(stations), "station")


def group_picks(
    picks: DataFrame, gap_seconds: float, keys: Sequence[str] = (), ties: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Number runs of picks separated by more than ``gap_seconds``: a plain gap grouper."""
    return gap_groups(picks, "abs_time", gap_seconds, keys, ties, "event_no", buckets)


def events_from_groups(
    grouped: DataFrame, keys: Sequence[str] = (), min_phases: int = 1, min_p: int = 0, min_s: int = 0
) -> DataFrame:
    """One row per group with enough picks in all, of P kind and of S kind."""
    return (
        grouped.groupBy(*keys, "event_no")
        .agg(
            F.count("*").alias("n_phases"),
            F.count_if(F.startswith("phase", F.lit("P"))).alias("n_p"),
            F.count_if(F.startswith("phase", F.lit("S"))).alias("n_s"),
            F.min("abs_time").alias("first"),
            F.max("abs_time").alias("last"),
        )
        .filter((F.col("n_phases") >= min_phases) & (F.col("n_p") >= min_p) & (F.col("n_s") >= min_s))
    )


def neighbour_pairs(
    events: DataFrame, k: int = 10, event: str = "event_id", time: str = "time", buckets: int | None = None
) -> DataFrame:
    """Each event with its next ``k`` events in time: ``ev1, ev2``, at most k rows per event.

    Events are taken in equal-count time ranges; the first k of a range also close the one before.
    """
    slim = events.select(F.col(event).alias("__e"), micros(F.col(time)).alias("__t"))
    cut, n = order_buckets(slim, F.col("__t"), buckets)
    own = cut.withColumn("__home", F.lit(True))
    if n > 1:
        w = Window.partitionBy("__bucket").orderBy("__order", "__e")
        heads = (
            cut.withColumn("__r", F.row_number().over(w))
            .filter(F.col("__r") <= k)
            .groupBy("__bucket")
            .agg(F.array_sort(F.collect_list(F.struct("__order", "__e", "__t"))).alias("__h"))
        )
        # One row per range with at most k events each, so k following ranges always suffice.
        following = F.flatten(F.collect_list("__h").over(Window.orderBy("__bucket").rowsBetween(1, k)))
        reach = heads.withColumn("__f", following).select("__bucket", F.explode(F.slice("__f", 1, k)).alias("__x"))
        borrowed = reach.select(
            "__x.__e", "__x.__t", "__x.__order", "__bucket", F.lit(False).alias("__home")
        )
        own = own.unionByName(borrowed)
    ordered = Window.partitionBy("__bucket").orderBy("__order", "__e").rowsBetween(1, k)
    ahead = F.collect_list("__e").over(ordered)
    return own.withColumn("__next", ahead).filter("__home").select(
        F.col("__e").alias("ev1"), F.explode("__next").alias("ev2")
    )


def differential_times(picks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Travel times of event pairs at common stations and phases: the rows of a dt.ct file.

    ``picks`` has ``event_id, station, phase, travel_time, weight``; ``pairs`` has ``ev1, ev2``.
    Output grows with the pair list, not with the square of the picks of a station.
    """
    one = picks.select(
        F.col("event_id").alias("ev1"), "station", "phase", F.col("travel_time").alias("tp1"), F.col("weight").alias("__w1")
    )
    two = picks.select(
        F.col("event_id").alias("ev2"), "station", "phase", F.col("travel_time").alias("tp2"), F.col("weight").alias("__w2")
    )
    return (
        pairs.select("ev1", "ev2")
        .join(one, "ev1")
        .join(two, ["ev2", "station", "phase"])
        .select("ev1", "ev2", "station", "phase", "tp1", "tp2", ((F.col("__w1") + F.col("__w2")) / 2).alias("weight"))
    )
