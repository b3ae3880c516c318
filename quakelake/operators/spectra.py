"""Filters and spectra of trace segments: one row in, rows out, no shuffle.

Segments have key columns, ``sampling_rate`` and a ``data`` array of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelake.functions import signal as S
from quakelake.functions import source_params as P


def _per_segment(df: DataFrame, keys: Sequence[str], kernel: Callable[[np.ndarray, float], dict], columns: str) -> DataFrame:
    """Run a kernel on every segment; its columns (equal lengths) become rows beside the keys."""
    keys = list(keys)
    key_ddl = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [kernel(np.asarray(x, dtype=float), float(r)) for x, r in zip(batch["data"], batch["sampling_rate"])]
            lengths = np.array([len(got[names[0]]) if got else 0 for got in done])
            if not lengths.sum():
                continue
            columns_of_keys = {k: np.repeat(batch[k].to_numpy(), lengths) for k in keys}
            yield pd.DataFrame(
                {**columns_of_keys, **{c: np.concatenate([got[c] for got in done if got]) for c in names}}
            )

    return df.select(*keys, "sampling_rate", "data").mapInPandas(run, f"{key_ddl}, {columns}")


def _map_data(df: DataFrame, kernel: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
    """Replace ``data`` by a kernel's result, batch by batch."""

    @F.pandas_udf("array<double>")
    def run(data: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([kernel(np.asarray(x, dtype=float), float(r)).tolist() for x, r in zip(data, rate)])

    return df.withColumn("data", run("data", "sampling_rate"))


def bandfilter(
    df: DataFrame,
    kind: str = "bandpass",
    low: float | None = 1.0,
    high: float | None = 10.0,
    corners: int = 4,
    zerophase: bool = True,
) -> DataFrame:
    """Butterworth bandpass, lowpass, highpass or bandstop of every segment.

    A lowpass uses ``high`` (else ``low``) as its corner, a highpass ``low``.
    """
    if kind not in ("bandpass", "lowpass", "highpass", "bandstop"):
        raise ValueError(f"unknown filter kind: {kind}")
    if kind == "lowpass":
        low, high = None, high or low
    elif kind == "highpass":
        high = None
    return _map_data(df, lambda x, r: S.filtered(x, r, kind, low, high, corners, zerophase))


def resample(df: DataFrame, new_rate: float) -> DataFrame:
    return _map_data(df, lambda x, r: S.resample(x, r, new_rate)).withColumn("sampling_rate", F.lit(float(new_rate)))


def spectrum(df: DataFrame, keys: Sequence[str] = ("trace_id", "segment"), method: str = "fft", window: str = "hann") -> DataFrame:
    """Amplitude spectrum rows ``keys, k, freq, amp`` (``welch``: square root of the power density)."""

    def kernel(x: np.ndarray, rate: float) -> dict:
        if method == "welch":
            freq, power = S.welch(x, rate, window)
            amp = np.sqrt(power)
        else:
            freq, amp = S.amplitude_spectrum(x, rate, window)
        return {"k": np.arange(len(freq)), "freq": freq, "amp": amp}

    if method not in ("fft", "welch"):
        raise ValueError(f"unknown spectrum method: {method}")
    return _per_segment(df, keys, kernel, "k long, freq double, amp double")


def power_density(df: DataFrame, keys: Sequence[str] = ("trace_id", "segment"), window: str = "hann") -> DataFrame:
    """Welch power density rows with decibels."""

    def kernel(x: np.ndarray, rate: float) -> dict:
        freq, power = S.welch(x, rate, window)
        return {"k": np.arange(len(freq)), "freq": freq, "power": power}

    rows = _per_segment(df, keys, kernel, "k long, freq double, power double")
    return rows.withColumn("db", F.log10(F.col("power") + 1e-30) * 10)


def spectrogram(
    df: DataFrame,
    keys: Sequence[str] = ("trace_id", "segment"),
    seconds: float = 1.0,
    overlap: float = 0.9,
    decibel: bool = True,
) -> DataFrame:
    """Time-frequency rows ``keys, t, freq, power``; segments shorter than a window give none."""

    def kernel(x: np.ndarray, rate: float) -> dict:
        if len(x) < S.nearest_power_of_two(seconds * rate):
            return {}
        freq, times, power = S.spectrogram(x, rate, seconds, overlap, decibel)
        return {"t": np.repeat(times, len(freq)), "freq": np.tile(freq, len(times)), "power": power.T.ravel()}

    return _per_segment(df, keys, kernel, "t double, freq double, power double")


def hv_ratio(
    spectra: DataFrame,
    keys: Sequence[str] = ("station", "segment"),
    component: str = "component",
    low: float = 0.1,
    high: float = 20.0,
) -> DataFrame:
    """Horizontal over vertical amplitude per frequency; components 1 and 2 stand in for N and E.

    Stations without all three components have no rows; a zero vertical amplitude gives 0.
    """
    of = lambda c, v: F.max(F.when(F.upper(component) == c, F.col(v)))
    wide = spectra.groupBy(*keys, "k").agg(
        of("Z", "freq").alias("freq"),
        of("Z", "amp").alias("z"),
        F.coalesce(of("N", "amp"), of("1", "amp")).alias("n"),
        F.coalesce(of("E", "amp"), of("2", "amp")).alias("e"),
    )
    horizontal = F.sqrt((F.col("n") * F.col("n") + F.col("e") * F.col("e")) / 2)
    return (
        wide.filter(F.col("z").isNotNull() & F.col("n").isNotNull() & F.col("e").isNotNull())
        .filter(F.col("freq").between(low, high))
        .select(
            *keys, "k", "freq", F.when(F.col("z") > 0, horizontal / F.nullif("z", F.lit(0.0))).otherwise(0.0).alias("hvsr")
        )
    )


def peak_frequency(rows: DataFrame, keys: Sequence[str] = ("trace_id", "segment"), value: str = "amp") -> DataFrame:
    """Frequency of the largest value, the lowest on ties."""
    return rows.groupBy(*keys).agg(
        F.max_by("freq", F.struct(F.col(value), -F.col("freq"))).alias("peak_freq"), F.max(value).alias(f"peak_{value}")
    )


def corner_frequency(
    df: DataFrame,
    keys: Sequence[str] = ("trace_id", "segment"),
    low: float = 1.0,
    high: float = 30.0,
    t_start: float | None = None,
    t_end: float | None = None,
) -> DataFrame:
    """Corner frequency (3 decimals) per segment, NULL with too little data."""

    @F.pandas_udf("double")
    def run(data: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for x, r in zip(data, rate):
            first = int(t_start * r) if t_start else 0
            last = int(t_end * r) if t_end else len(x)
            out.append(S.corner_frequency(np.asarray(x, dtype=float)[first:last], float(r), low, high))
        return pd.Series(out)

    fitted = df.select(*keys, run("data", "sampling_rate").alias("fc"))
    return fitted.withColumn("fc", F.when(~F.isnan("fc"), F.round("fc", 3)))


def plateau(spectra: DataFrame, keys: Sequence[str] = ("trace_id", "segment")) -> DataFrame:
    """Median amplitude strictly between 0.1 and 2 Hz, else the second amplitude."""
    low = (F.col("freq") > 0.1) & (F.col("freq") < 2.0)
    return spectra.groupBy(*keys).agg(
        F.coalesce(F.median(F.when(low, F.col("amp"))), F.max(F.when(F.col("k") == 1, F.col("amp")))).alias("omega0")
    )


def source_parameters(
    segments: DataFrame, distance_km: Column, keys: Sequence[str] = ("trace_id", "segment"), low: float = 1.0, high: float = 30.0
) -> DataFrame:
    """Local magnitude, moment, moment magnitude, corner frequency and stress drop per segment."""
    keys = list(keys)
    base = segments.select(
        *keys, F.array_max(F.transform("data", F.abs)).alias("peak"), distance_km.alias("distance_km")
    )
    joined = base.join(plateau(spectrum(segments, keys), keys), keys).join(
        corner_frequency(segments, keys, low, high), keys
    )
    moment = P.seismic_moment(F.col("omega0"), F.col("distance_km"))
    return (
        joined.withColumn("ml", P.local_magnitude(F.col("peak"), F.col("distance_km")))
        .withColumn("m0", moment)
        .withColumn("mw", P.moment_magnitude(F.col("m0")))
        .withColumn("stress_drop", P.stress_drop(F.col("m0"), F.col("fc")))
    )


def station_average(params: DataFrame, event: str = "event_id", values: Sequence[str] = ("ml", "mw", "fc", "stress_drop")) -> DataFrame:
    """Mean and sample deviation of source parameters over the stations of each event."""
    return params.groupBy(event).agg(
        F.count("*").alias("n_stations"),
        *[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
    )
