"""Overlapping frames of whole traces in long form, and the spectra that are taken frame by frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelake.functions import signal as S
from quakelake.operators.common import join_keys


def frames(samples: DataFrame, size: int | Column, step: int | Column, keys: Sequence[str] = ("trace_id",)) -> DataFrame:
    """``(keys, frame, data)``: frame f holds the samples from ``f * step`` on, ``size`` of them.

    ``samples`` is ``(keys, i, v)`` with i counted from 0 in each trace; ``size`` and ``step`` may be
    columns that are constant in a trace. Each sample goes to the frames that hold it, so frames do
    not depend on how a trace is stored or cut, and one long trace is as many groups as it has frames.
    Frames with a missing sample, such as those beyond the end, are left out.
    """
    size, step = (F.lit(x) if isinstance(x, int) else x for x in (size, step))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - size + 1) / step))
    last = F.floor(F.col("i") / step)
    placed = samples.filter("i >= 0").select(
        *keys, "i", "v", size.cast("long").alias("__size"), F.explode(F.filter(F.sequence(first, F.greatest(first, last)), lambda f: f <= last)).alias("frame")
    )
    held = placed.groupBy(*keys, "frame", "__size").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("__s"))
    whole = held.filter((F.size("__s") == F.col("__size")) & F.forall("__s", lambda s: s["v"].isNotNull()))
    return whole.select(*keys, "frame", F.transform("__s", lambda s: s["v"]).alias("data"))


def _spectra(framed: DataFrame, keys: Sequence[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(keys, frame, n, k, power)`` from a kernel over frames of one length at a time, as a matrix."""
    keys = list(keys)
    ddl = ", ".join(f"{k} {framed.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["data"].map(len)
            for n, rows in batch.groupby(sizes).indices.items():
                part = batch.iloc[rows]
                power = kernel(np.stack(part["data"].to_numpy()).astype(float))
                width = power.shape[1]
                yield pd.DataFrame(
                    {
                        **{c: np.repeat(part[c].to_numpy(), width) for c in [*keys, "frame"]},
                        "n": np.int64(n),
                        "k": np.tile(np.arange(width), len(part)),
                        "power": power.ravel(),
                    }
                )

    return framed.select(*keys, "frame", "data").mapInPandas(run, f"{ddl}, frame long, n long, k long, power double")


def _one_sided(x: np.ndarray, n_fft: int, scale: float) -> np.ndarray:
    power = np.abs(np.fft.rfft(x, n_fft, axis=1)) ** 2 / scale
    power[:, 1 : -1 if n_fft % 2 == 0 else None] *= 2
    return power


def power_density(
    samples: DataFrame, rate: float, keys: Sequence[str] = ("trace_id",), seconds: float = 10.0, window: str = "hann"
) -> DataFrame:
    """Welch power density of whole traces: rows ``keys, k, freq, power, db``.

    Half-overlapping frames of ``seconds``, or of the whole trace where it is shorter; their means are
    removed and their powers averaged per frequency.
    """
    most = int(rate * seconds)
    sizes = samples.groupBy(*keys).agg(F.least(F.count("*"), F.lit(most)).cast("long").alias("__n")).filter("__n > 0")
    sized = join_keys(samples, sizes, list(keys))
    framed = frames(sized, F.col("__n"), F.col("__n") - F.floor(F.col("__n") / 2), keys)

    def kernel(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        w = S.window(window, n)
        return _one_sided((x - x.mean(axis=1, keepdims=True)) * w, n, rate * np.sum(w * w))

    found = _spectra(framed, keys, kernel).groupBy(*keys, "n", "k").agg(F.avg("power").alias("power"))
    freq = F.col("k") * F.lit(float(rate)) / F.col("n")
    return found.select(*keys, "k", freq.alias("freq"), "power", (F.log10(F.col("power") + 1e-30) * 10).alias("db"))


def spectrogram(
    samples: DataFrame,
    rate: float,
    keys: Sequence[str] = ("trace_id",),
    seconds: float = 1.0,
    overlap: float = 0.9,
    decibel: bool = True,
    pad: float = 8.0,
) -> DataFrame:
    """Time-frequency rows ``keys, t, freq, power`` of whole traces, without the zero frequency.

    Traces are centred on their own mean; those shorter than a frame give none.
    """
    n = S.nearest_power_of_two(seconds * rate)
    n_fft, step, w = S.nearest_power_of_two(pad) * n, n - int(n * overlap), np.hanning(n)
    means = samples.groupBy(*keys).agg(F.avg("v").alias("__mean"))
    centred = join_keys(samples, means, list(keys)).withColumn("v", F.col("v") - F.col("__mean"))
    framed = frames(centred, n, step, keys)
    found = _spectra(framed, keys, lambda x: _one_sided(x * w, n_fft, rate * np.sum(w * w))).filter("k > 0")
    shown = F.log10(F.greatest(F.col("power"), F.lit(1e-300))) * 10 if decibel else F.sqrt("power")
    return found.select(
        *keys, ((F.col("frame") * step + n / 2) / rate).alias("t"), (F.col("k") * (rate / n_fft)).alias("freq"), shown.alias("power")
    )
