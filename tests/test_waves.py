import numpy as np
import pytest
from pyspark.sql import functions as F

from quakelake.functions import signal as S
from quakelake.operators import picks as K
from quakelake.operators import spectra as SP
from quakelake.operators import waveform as W

RATE = 100.0
T = np.arange(2000) / RATE
SINE = np.sin(2 * np.pi * 5 * T) + 3 + 0.2 * T


def long_form(spark, traces):
    rows = [(int(k), i, float(v)) for k, x in traces.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "trace_id long, i long, v double")


def arrays(spark, traces):
    rows = [(int(k), 0, RATE, [float(v) for v in x]) for k, x in traces.items()]
    return spark.createDataFrame(rows, "trace_id long, segment long, sampling_rate double, data array<double>")


def values(df):
    return np.array([r["v"] for r in df.orderBy("trace_id", "i").collect()])


def recursive(sos, x):
    """The difference equation, sample by sample."""
    y = np.asarray(x, float)
    for b0, b1, b2, a1, a2 in sos:
        out, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
        for v in y:
            r = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = v, x1, r, y1
            out.append(r)
        y = np.array(out)
    return y


@pytest.mark.parametrize("kind,low,high", [("bandpass", 1.0, 10.0), ("lowpass", None, 5.0), ("highpass", 2.0, None), ("bandstop", 4.0, 6.0)])
@pytest.mark.parametrize("corners", [2, 3, 4])
def test_filter_response_and_recursion(kind, low, high, corners):
    sos = S.butterworth(kind, corners, RATE, low, high)
    noise = np.random.default_rng(0).normal(size=700)
    assert np.allclose(S.sections_filter(sos, noise), recursive(sos, noise), atol=1e-8)

    def gain(f):
        z = np.exp(-2j * np.pi * f / RATE)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sos]))

    for corner in (low, high):
        if corner is not None:
            assert gain(corner) == pytest.approx(np.sqrt(0.5), rel=1e-6)
    inside = {"bandpass": np.sqrt(10.0), "lowpass": 0.01, "highpass": 40.0, "bandstop": 30.0}[kind]
    assert gain(inside) == pytest.approx(1, abs=0.02)


def test_zero_phase_keeps_a_sine(spark):
    sine = np.sin(2 * np.pi * 5 * T)
    out = np.array(SP.bandfilter(arrays(spark, {1: sine})).head()["data"])
    mid = slice(500, 1500)
    assert np.corrcoef(out[mid], sine[mid])[0, 1] > 0.9999
    with pytest.raises(ValueError):
        SP.bandfilter(arrays(spark, {1: sine}), "comb")


def test_detrend_taper_normalise(spark):
    df = long_form(spark, {1: SINE, 2: [4.0]})
    assert np.allclose(values(W.detrend(df))[:2000], SINE - SINE.mean())
    line = np.polyval(np.polyfit(np.arange(2000), SINE, 1), np.arange(2000))
    assert np.allclose(values(W.detrend(df, "linear"))[:2000], SINE - line, atol=1e-8)
    ramp = 0.5 * (1 - np.cos(np.pi * np.arange(100) / 99))
    want = np.concatenate([ramp, np.ones(1800), ramp[::-1]])
    assert np.allclose(values(W.taper(df))[:2000], SINE * want)
    assert np.abs(values(W.normalise(df))).max() == 1


def test_trim_pads_with_zeros(spark):
    df = long_form(spark, {1: np.arange(1, 201)})
    heads = spark.createDataFrame([(1, "2024-01-01 00:00:00")], "trace_id long, s string").select(
        "trace_id", F.to_timestamp("s").alias("starttime"), F.lit(RATE).alias("sampling_rate")
    )
    got = values(W.trim(df, heads, "2024-01-01 00:00:01.9", "2024-01-01 00:00:02.1"))
    assert got.tolist() == [*range(191, 201), *[0] * 11]


@pytest.mark.parametrize("block", [8, 1000])
def test_merge_fills_gaps_and_later_wins(spark, block):
    rows = [(1, 0, i, float(i)) for i in range(0, 50)] + [(1, 1, i, 2.0 * i) for i in range(40, 60)] + [(1, 2, i, 100.0) for i in range(110, 120)]
    df = spark.createDataFrame(rows, "trace_id long, segment long, i long, v double")
    out = W.merge_segments(df, block=block).orderBy("i").collect()
    got = {r["i"]: (r["v"], r["filled"]) for r in out}
    assert sorted(got) == list(range(120)) and len(out) == 120
    assert got[45] == (90.0, False) and got[39] == (39.0, False)
    assert got[84] == (pytest.approx(118 + (100 - 118) * 25 / 51), True)


def test_display_points(spark):
    got = W.display_points(long_form(spark, {1: np.arange(9000) + 1.0}), RATE)
    assert got.count() == 4500 and got.agg(F.max("t")).head()[0] == 89.98


def test_segments_bound_their_length(spark):
    seg = W.segments(long_form(spark, {1: SINE, 2: SINE[:10]}), length=600)
    assert sorted((r["trace_id"], r["segment"], len(r["data"])) for r in seg.collect()) == [(1, 0, 600), (1, 1, 600), (1, 2, 600), (1, 3, 200), (2, 0, 10)]


def test_spectra_find_the_sine(spark):
    df = arrays(spark, {1: np.sin(2 * np.pi * 5 * T)})
    spec = SP.spectrum(df)
    assert SP.peak_frequency(spec).head()["peak_freq"] == 5.0
    n = len(T)
    want = np.abs(np.fft.rfft(np.sin(2 * np.pi * 5 * T) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)))) / (n * RATE)
    assert np.allclose([r["amp"] for r in spec.orderBy("k").collect()], want)
    power = SP.power_density(df)
    assert SP.peak_frequency(power, value="power").head()["peak_freq"] == pytest.approx(5.0)
    # A unit sine carries a power of one half.
    assert power.agg(F.sum("power")).head()[0] * 0.1 == pytest.approx(0.5, rel=1e-3)
    assert np.allclose([r["amp"] for r in SP.spectrum(df, method="welch").orderBy("k").collect()], np.sqrt([r["power"] for r in power.orderBy("k").collect()]))


def test_spectrogram_peaks_at_the_sine(spark):
    rows = SP.spectrogram(arrays(spark, {1: np.sin(2 * np.pi * 10 * T), 2: np.ones(5)}))
    best = rows.groupBy("trace_id", "t").agg(F.max_by("freq", "power").alias("f")).collect()
    assert {r["trace_id"] for r in best} == {1}
    assert all(abs(r["f"] - 10) < 0.5 for r in best) and len(best) == (2000 - 115) // 13


def test_resample_keeps_a_slow_sine():
    x = np.sin(2 * np.pi * 1 * T) * np.hanning(len(T))
    y = S.resample(x, RATE, 50.0)
    assert len(y) == 1000 and np.allclose(y, x[::2], atol=0.02)


def test_corner_frequency_of_a_model_spectrum(spark):
    n, fc = 4096, 6.0
    freq = np.fft.rfftfreq(n, 1 / RATE)
    spec = 1e-3 / (1 + (freq / fc) ** 2)
    x = np.fft.fftshift(np.fft.irfft(spec, n))
    got = SP.corner_frequency(arrays(spark, {1: x, 2: x[:10]})).orderBy("trace_id").collect()
    assert got[0]["fc"] == pytest.approx(fc, rel=0.05) and got[1]["fc"] is None


def test_hv_ratio_without_vertical_energy(spark):
    rows = [("s", 0, c, k, k * 1.0, a) for c, amps in {"Z": [1.0, 0.0, 2.0], "1": [1.0, 1.0, 1.0], "E": [1.0, 7.0, 3.0]}.items() for k, a in enumerate(amps, 1)]
    rows += [("half", 0, "Z", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "station string, segment int, component string, k int, freq double, amp double")
    got = {r["k"]: r["hvsr"] for r in SP.hv_ratio(df).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: pytest.approx(np.sqrt(5) / 2)}


# --- picks --------------------------------------------------------------------------------------


def test_polarity_window_bounds(spark):
    data = [float(i) for i in range(2048)]
    traces = spark.createDataFrame([("f", "s", RATE, data)], "file string, station string, sampling_rate double, data array<double>")
    picks = spark.createDataFrame([("f", "s", t) for t in (5.11, 5.12, 15.36, 15.37)], "file string, station string, rel_time double")
    got = {r["rel_time"]: r for r in K.polarity_windows(picks, traces).collect()}
    assert [got[t]["reason"] for t in (5.11, 5.12, 15.36, 15.37)] == ["out_of_bounds", "ok", "ok", "out_of_bounds"]
    assert got[5.12]["window"] == data[:1024] and got[15.36]["window"] == data[1024:]
    scored = K.score_windows(K.polarity_windows(picks, traces), lambda ws: [[0.9, 0.1] if w[0] == 0 else [0.2, 0.3] for w in ws])
    decided = {r["rel_time"]: (r["polarity"], r["prob"]) for r in K.decide_polarity(scored).collect()}
    assert decided == {5.11: ("N", 0.0), 5.12: ("U", 0.9), 15.36: ("N", 0.3), 15.37: ("N", 0.0)}


def test_components_chosen_and_aligned(spark):
    def trace(no, sta, ch, off, n):
        return ("X", sta, "00", ch, no, f"2024-01-01 00:00:0{off}", RATE, [float(no * 1000 + i) for i in range(n)])

    rows = [
        trace(1, "A", "HHZ", 0, 500), trace(2, "A", "BHZ", 1, 500), trace(3, "A", "BHN", 0, 300), trace(4, "A", "BHE", 2, 400),
        trace(5, "B", "LOG", 0, 100), trace(6, "B", "AUX", 0, 100), trace(7, "B", "BHZ", 0, 100),
        trace(8, "C", "BHZ", 0, 100),
        trace(9, "D", "BHZ", 0, 100), trace(10, "D", "BHN", 3, 100), trace(11, "D", "BHE", 0, 100),
    ]
    df = spark.createDataFrame(rows, "network string, station string, location string, channel string, trace_no long, s string, sampling_rate double, data array<double>").withColumn("starttime", F.to_timestamp("s"))
    chosen = {(r["station"], r["component"]): r["trace_no"] for r in K.component_choice(df).collect()}
    assert [chosen["A", c] for c in "ENZ"] == [4, 3, 2] and [chosen["B", c] for c in "ENZ"] == [5, 6, 7] and ("C", "Z") not in chosen
    got = {r["station"]: r for r in K.align_components(df).collect()}
    assert set(got) == {"A", "B"}
    # Common span of A: from 2 s to 2.99 s.
    first = got["A"]["data"][0]
    assert len(got["A"]["data"]) == 100 and (first["e"], first["n"], first["z"]) == (4000.0, 3200.0, 2100.0)


def test_events_need_enough_phases(spark):
    rows = [("P", 0), ("Sg", 3), ("Pn", 5), ("P", 500), ("P", 502)]
    df = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(rows)], "phase string, s long, id long").withColumn("abs_time", F.timestamp_seconds("s"))
    got = K.events_from_groups(K.group_picks(df, 60, ties=["id"]), min_phases=2, min_p=2, min_s=1).collect()
    assert [(r["event_no"], r["n_phases"], r["n_p"], r["n_s"]) for r in got] == [(1, 3, 2, 1)]


def test_polarity_windows_over_blocks(spark):
    data = [float(i * i % 977) for i in range(5000)]
    traces = spark.createDataFrame([("f", "s", 100.0, data), ("f", "short", 100.0, data[:900]), ("f", "none", 100.0, [])], "file string, station string, sampling_rate double, data array<double>")
    at = [0, 511, 512, 1023, 1024, 1535, 1536, 2500, 4488, 4489, 4999, 9000]
    picks = [("f", "s", i / 100, i) for i in at] + [("f", "short", 5.0, -1), ("f", "none", 0.0, -2), ("f", "absent", 0.0, -3), ("f", "s", 6.0, 600), ("f", "s", 6.0, 600)]
    df = spark.createDataFrame(picks, "file string, station string, rel_time double, n long")
    rows = K.polarity_windows(df, traces).collect()
    assert len(rows) == len(picks) - 1
    for r in rows:
        i = int(r["n"])
        inside = r["station"] == "s" and 512 <= i <= len(data) - 512
        assert (r["reason"], r["window"]) == (("ok", data[i - 512 : i + 512]) if inside else ("out_of_bounds", None))


def test_traces_are_whole_unless_a_length_is_named(spark, monkeypatch):
    df = long_form(spark, {1: SINE, 2: SINE[:10]})
    assert {r["trace_id"]: len(r["data"]) for r in W.segments(df).collect()} == {1: len(SINE), 2: 10}
    monkeypatch.setattr(W, "LARGEST", 100)
    with pytest.raises(Exception, match="window length"):
        W.segments(df).collect()
