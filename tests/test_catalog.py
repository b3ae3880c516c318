import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakelake.functions import source_params as P
from quakelake.operators import catalog as C
from quakelake.operators import common, picks, profiling

MAGS = [1.0, 1.0, 1.1, 1.1, 1.2, 2.95]


def frame(spark, mags):
    return spark.createDataFrame([(float(m),) for m in mags], "magnitude double")


def brute_fmd(mags, width=0.1):
    m = np.asarray(mags, float)
    k0, k1 = math.floor(m.min() / width), math.ceil(m.max() / width)
    rows = []
    for k in range(k0, k1 + 1):
        c = round(k * width, 10)
        rows.append((c, int(((m >= c - width / 2) & (m < c + width / 2)).sum()), int((m >= c - width / 2).sum())))
    return rows


@pytest.mark.parametrize("width", [0.1, 0.2, 0.25, 0.5])
def test_fmd_matches_brute_force(spark, width):
    rng = np.random.default_rng(5)
    for mags in (MAGS, np.round(rng.exponential(0.7, 400) - 0.5, 2), rng.normal(2, 1, 300), np.arange(-20, 60) * 0.05):
        got = C.frequency_magnitude(frame(spark, mags), width).orderBy("mag_bin").collect()
        assert [(r["mag_bin"], r["n"], r["n_cum"]) for r in got] == brute_fmd(mags, width)


def test_fmd_properties(spark):
    rows = C.frequency_magnitude(frame(spark, MAGS)).orderBy("mag_bin").collect()
    assert sum(r["n"] for r in rows) == len(MAGS)
    cumulative = [r["n_cum"] for r in rows]
    assert cumulative == sorted(cumulative, reverse=True)
    assert any(r["n"] == 0 for r in rows)


def test_peak_tie_takes_lowest_bin(spark):
    assert C.mc_max_curvature(frame(spark, MAGS)).head()["mc"] == 1.2


def test_b_value_by_hand(spark):
    rng = np.random.default_rng(1)
    mags = np.round(1.0 + rng.exponential(1 / (1.0 * math.log(10)), 3000), 1)
    got = C.b_value_mle(frame(spark, mags), mc=1.5).head()
    part = mags[mags >= 1.5 - 0.05]
    b = math.log10(math.e) / (part.mean() - 1.45)
    n = len(part)
    assert got["n_events"] == n
    assert got["b_value"] == pytest.approx(b)
    assert got["b_uncertainty"] == pytest.approx(2.3 * b * b * part.std(ddof=1) / math.sqrt(n * (n - 1)))
    assert got["a_value"] == pytest.approx(math.log10(n) + b * 1.5)
    shi = C.b_value_mle(frame(spark, mags), mc=1.5, sigma="shi_bolt").head()
    assert shi["b_uncertainty"] == pytest.approx(got["b_uncertainty"] * math.sqrt(n - 1))


def test_b_value_needs_three_events(spark):
    assert C.b_value_mle(frame(spark, [1.0, 2.0]), mc=0.5).head()["b_value"] is None


def test_least_squares_against_polyfit(spark):
    rng = np.random.default_rng(2)
    mags = np.round(rng.exponential(0.5, 2000), 2)
    got = C.b_value_lsq(frame(spark, mags)).head()
    rows = [(c, n) for c, _, n in brute_fmd(mags) if c >= got["mc"] - 0.05 and n > 0]
    x, y = np.array([r[0] for r in rows]), np.log10([r[1] for r in rows])
    slope, intercept = np.polyfit(x, y, 1)
    assert got["b_value"] == pytest.approx(-slope)
    assert got["a_value"] == pytest.approx(intercept)
    assert got["mean_magnitude"] == pytest.approx(mags[mags >= got["mc"] - 0.05].mean())


def test_goodness_of_fit_falls_back(spark):
    got = C.mc_goodness_of_fit(frame(spark, MAGS)).head()
    assert got["mc"] == 1.2 and got["residual"] is None


def test_rate_last_bin_takes_remainder(spark):
    rows = [("2024-01-01 00:00:00",), ("2024-01-01 12:00:00",), ("2024-01-04 20:00:00",)]
    df = spark.createDataFrame(rows, "t string").select(F.to_timestamp("t").alias("time"))
    got = C.seismicity_rate(df).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 0, 1]
    assert [r["n_cum"] for r in got] == [2, 2, 3]
    single = C.seismicity_rate(df.limit(1)).collect()
    assert [r["n"] for r in single] == [1]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(10, 4, 500), np.arange(0, 61) / 2.0, np.full(5, 3.0)):
        df = spark.createDataFrame([(float(v),) for v in values], "depth double")
        got = [r["n"] for r in C.value_histogram(df).orderBy("bin").collect()]
        assert got == np.histogram(values, 30)[0].tolist()


def test_marker_size_and_selection(spark):
    rows = [(104.1, 29.5, 10.0, 3.2), (104.2, 29.6, 15.0, 4.1)]
    df = spark.createDataFrame(rows, "longitude double, latitude double, depth double, magnitude double")
    assert [round(r["size"], 3) for r in C.marker_size(df).orderBy("magnitude").collect()] == [10.0, round(10 * 2**0.9, 3)]
    assert C.in_region(df, (104.15, 105, 29, 30)).count() == 1
    assert C.depth_slice(df, 11.0).count() == 1


@pytest.mark.parametrize("buckets", [1, 2, 7, 50])
def test_positions_do_not_depend_on_ranges(spark, buckets):
    rows = [(i % 3 == 0, float((i * 37) % 101), i) for i in range(300)]
    df = spark.createDataFrame(rows, "hot boolean, t double, id long")
    got = common.with_position(df, ["hot"], F.col("t"), ["id"], buckets=buckets)
    want = {}
    for hot in (True, False):
        ordered = sorted((t, i) for h, t, i in rows if h == hot)
        want.update({i: n for n, (_, i) in enumerate(ordered, 1)})
    assert {r["id"]: r["position"] for r in got.collect()} == want


@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
def test_gap_groups_do_not_depend_on_ranges(spark, buckets):
    rng = np.random.default_rng(4)
    secs = np.cumsum(rng.choice([1, 2, 3, 100], 200))
    rows = [(int(i % 2), int(s), int(i)) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "k int, s long, id long").withColumn("time", F.timestamp_seconds("s"))
    got = common.gap_groups(df, "time", 50, ["k"], ["id"], buckets=buckets).collect()
    want = {}
    for k in (0, 1):
        last, no = None, 0
        for _, s, i in sorted((kk, s, i) for kk, s, i in rows if kk == k):
            no += last is None or s - last > 50
            want[i], last = no, s
    assert {r["id"]: r["group_no"] for r in got} == want


@pytest.mark.parametrize("buckets", [1, 3, 60])
def test_neighbour_pairs(spark, buckets):
    times = [(i, (i * 7919) % 1000) for i in range(120)]
    df = spark.createDataFrame(times, "event_id long, s long").withColumn("time", F.timestamp_seconds("s"))
    order = [i for _, i in sorted((s, i) for i, s in times)]
    want = {(order[a], order[b]) for a in range(120) for b in range(a + 1, min(a + 4, 120))}
    got = [(r["ev1"], r["ev2"]) for r in picks.neighbour_pairs(df, 3, buckets=buckets).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_fault_blocks_agree(spark):
    events = spark.createDataFrame([(i, 100 + i * 0.37 % 5, 25 + i * 0.53 % 5) for i in range(60)], "event_id long, longitude double, latitude double")
    seg = spark.createDataFrame([(i, 100.0 + i, 25.0 + i, 100.5 + i, 25.7 + i) for i in range(9)] + [(9, 101.0, 26.0, 101.0, 26.0)], "segment_id long, lon1 double, lat1 double, lon2 double, lat2 double")
    one = sorted(map(tuple, C.nearest_fault(events, seg).collect()))
    assert one == sorted(map(tuple, C.nearest_fault(events, seg, max_rows=4).collect()))


def test_source_parameters_by_hand(spark):
    row = spark.range(1).select(
        P.local_magnitude(F.lit(1e-6), F.lit(100.0)).alias("ml"),
        P.seismic_moment(F.lit(1e-9), F.lit(50.0)).alias("m0"),
        P.moment_magnitude(F.lit(1e15)).alias("mw"),
        P.stress_drop(F.lit(1e15), F.lit(2.0)).alias("sd"),
    ).head()
    assert row["ml"] == pytest.approx(math.log10(1e-6 * 2080 * 1000) + 6 - 2.92)
    assert row["m0"] == pytest.approx(4 * math.pi * 2700 * 3500**3 * 50_000 * 1e-9 / (0.63 * 2))
    assert row["mw"] == pytest.approx(10 - 6.07)
    assert row["sd"] == pytest.approx(7 / 16 * 1e15 / (0.37 * 3500 / 2) ** 3)


def test_roles_of_free_form_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, 1.0)], "event_id int, Lon2 double, lon1 double, LAT double, depth_km double, ML double")
    assert profiling.guess_roles(df) == {"longitude": "lon1", "latitude": "LAT", "depth": "depth_km", "magnitude": "ML"}
    exact = profiling.numeric_profile(df).orderBy("column_name").collect()
    rough = profiling.numeric_profile(df, exact=False).orderBy("column_name").collect()
    assert [r["n_unique"] for r in exact] == [r["n_unique"] for r in rough] == [1] * 6


def test_small_side_is_measured_in_rows_and_bytes(spark):
    narrow = spark.range(100)
    assert len(common.collect_small(narrow, 100)) == 100
    assert common.collect_small(narrow, 99) is None
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert common.collect_small(wide, 10, 5_000) is None
    assert len(common.collect_small(wide, 10, 50_000)) == 10


def test_distinct_longs_beyond_doubles(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (None,)], "v long")
    assert [r["n_unique"] for r in profiling.numeric_profile(df).collect()] == [2]


def test_role_ranking():
    assert profiling.guess_role(["xlat", "lat1", "latitude"], ["lat", "latitude"]) == "latitude"
    assert profiling.guess_role(["xlat", "lat1"], ["lat"]) == "lat1"
    assert profiling.guess_role(["id_lat", "value"], ["lat"]) is None
