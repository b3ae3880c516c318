"""Frames of whole traces against plain loops over the same samples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakelake.operators import frames as Fr


def table(spark, traces, parts):
    rows = [(t, i, float(v)) for t, x in traces.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "trace_id string, i long, v double").repartition(parts)


@pytest.fixture(scope="module")
def traces():
    rng = np.random.default_rng(4)
    t = np.arange(5000) / 100
    return {"long": np.sin(2 * np.pi * 3 * t) + rng.normal(size=5000), "short": rng.normal(size=37), "one": np.array([2.0]), "two": np.array([1.0, 4.0])}


def dft_power(x, k, n_fft):
    a = sum(v * math.cos(2 * math.pi * k * j / n_fft) for j, v in enumerate(x))
    b = sum(v * math.sin(2 * math.pi * k * j / n_fft) for j, v in enumerate(x))
    return a * a + b * b


@pytest.mark.parametrize("parts", [1, 7])
def test_power_density(spark, traces, parts):
    got = {(r["trace_id"], r["k"]): r for r in Fr.power_density(table(spark, traces, parts), 100.0).collect()}
    assert len(got) == 501 + 19 + 1 + 2
    for name, x in traces.items():
        n = min(len(x), 1000)
        hann = np.array([1.0 if n == 1 else 0.5 - 0.5 * math.cos(2 * math.pi * j / n) for j in range(n)])
        for k in {0, min(1, n // 2), n // 4, n // 2}:
            powers = []
            for s in range(0, len(x) - n + 1, n - n // 2):
                part = x[s : s + n]
                sided = 1 if k == 0 or (n % 2 == 0 and k == n // 2) else 2
                powers.append(sided * dft_power((part - part.mean()) * hann, k, n) / (100.0 * sum(hann * hann)) if sum(hann * hann) else 0.0)
            row = got[(name, k)]
            assert row["power"] == pytest.approx(np.mean(powers), rel=1e-6, abs=1e-12)
            assert row["freq"] == pytest.approx(k * 100.0 / n)
            assert row["db"] == pytest.approx(10 * math.log10(row["power"] + 1e-30))


@pytest.mark.parametrize("parts", [1, 7])
def test_spectrogram(spark, traces, parts):
    got = {}
    for r in Fr.spectrogram(table(spark, traces, parts), 100.0, decibel=False).collect():
        got[(r["trace_id"], round(r["t"], 6), round(r["freq"], 6))] = r["power"]
    n, n_fft, step = 128, 1024, 13
    starts = list(range(0, 5000 - n + 1, step))
    assert {k[0] for k in got} == {"long"} and len(got) == len(starts) * 512
    x = traces["long"] - traces["long"].mean()
    w = np.array([0.5 - 0.5 * math.cos(2 * math.pi * j / (n - 1)) for j in range(n)])
    for s in (0, 13 * 4, starts[-1]):
        for k in (1, 31, 512):
            power = dft_power(x[s : s + n] * w, k, n_fft) / (100.0 * sum(w * w)) * (1 if k == 512 else 2)
            assert got[("long", round((s + n / 2) / 100, 6), round(k * 100 / n_fft, 6))] == pytest.approx(math.sqrt(power), rel=1e-6)


def test_frames_with_gaps_and_nulls(spark):
    rows = [("a", i, float(i)) for i in range(20) if i != 9] + [("b", i, None if i == 3 else 1.0) for i in range(8)] + [(None, i, 2.0) for i in range(4)]
    got = Fr.frames(spark.createDataFrame(rows, "trace_id string, i long, v double"), 4, 2).collect()
    want = {("a", f): list(map(float, range(2 * f, 2 * f + 4))) for f in (0, 1, 2, 5, 6, 7, 8)}
    want |= {("b", 2): [1.0] * 4, (None, 0): [2.0] * 4}
    assert {(r["trace_id"], r["frame"]): r["data"] for r in got} == want


def test_frame_longer_than_step_is_not_needed(spark):
    """Steps above the size leave samples between frames out."""
    rows = [("a", i, float(i)) for i in range(10)]
    got = Fr.frames(spark.createDataFrame(rows, "trace_id string, i long, v double"), F.lit(2), F.lit(4)).collect()
    assert {r["frame"]: r["data"] for r in got} == {0: [0.0, 1.0], 1: [4.0, 5.0], 2: [8.0, 9.0]}
