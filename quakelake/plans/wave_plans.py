"""Waveform, pick and text-source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakelake.functions import source_params as P
from quakelake.operators import frames as Fr
from quakelake.operators import picks as K
from quakelake.operators import spectra as S
from quakelake.operators import waveform as W
from quakelake.plans.inputs import PICKS_SQL, SAMPLES_SQL, picks, samples, table
from quakelake.plans.registry import query, rounded
from quakelake.sources import catalogs as SC
from quakelake.sources import picks as SP
from quakelake.sources import sinks
from quakelake.sources import tables as ST

_SMP = f"WITH {SAMPLES_SQL}"

# --- long-form traces ---------------------------------------------------------------------------


@query(
    "trace_summary",
    _SMP + " SELECT trace_id, count(*) AS npts, min(v) AS v_min, max(v) AS v_max FROM smp GROUP BY trace_id",
)
def trace_summary(spark, d):
    return W.trace_summary(samples(spark, d))


@query(
    "trace_demean",
    _SMP + " SELECT trace_id, i, round(v - avg(v) OVER (PARTITION BY trace_id), 9) AS v FROM smp",
)
def trace_demean(spark, d):
    return rounded(W.detrend(samples(spark, d)), 9, "v")


@query(
    "trace_detrend",
    _SMP
    + """, l AS (SELECT trace_id, regr_slope(v, i) AS sl, regr_intercept(v, i) AS ic, avg(v) AS m FROM smp GROUP BY trace_id)
SELECT smp.trace_id, i, round(v - coalesce(ic + sl * i, m), 8) AS v FROM smp JOIN l ON l.trace_id = smp.trace_id""",
)
def trace_detrend(spark, d):
    return rounded(W.detrend(samples(spark, d), "linear"), 8, "v")


@query(
    "trace_taper",
    _SMP
    + """, n AS (SELECT trace_id, count(*) AS n, least(floor(0.05e0 * count(*)), floor(count(*) / 2e0)) AS l FROM smp GROUP BY trace_id)
SELECT smp.trace_id, i, round(v * CASE WHEN l = 0 THEN 1 WHEN l = 1 THEN CASE WHEN i = n - 1 THEN 0 ELSE 1 END
  WHEN i < l THEN 0.5e0 * (1 - cos(pi() * i / (l - 1))) WHEN n - 1 - i < l THEN 0.5e0 * (1 - cos(pi() * (n - 1 - i) / (l - 1))) ELSE 1 END, 6) AS v
FROM smp JOIN n ON n.trace_id = smp.trace_id""",
)
def trace_taper(spark, d):
    return rounded(W.taper(samples(spark, d)), 6, "v")


@query(
    "trace_normalise",
    _SMP + " SELECT trace_id, i, round(v / max(abs(v)) OVER (PARTITION BY trace_id), 9) AS v FROM smp",
)
def trace_normalise(spark, d):
    return rounded(W.normalise(samples(spark, d)), 9, "v")


@query(
    "trace_decimate",
    _SMP
    + """, n AS (SELECT trace_id, greatest(count(*) // 20, 1) AS st, max(abs(v)) AS p FROM smp GROUP BY trace_id)
SELECT smp.trace_id, i, i / 100e0 AS t, round(v / p, 9) AS v FROM smp JOIN n ON n.trace_id = smp.trace_id WHERE i % st = 0""",
)
def trace_decimate(spark, d):
    """Display thinning to about twenty points per trace."""
    return rounded(W.display_points(samples(spark, d), 100.0, 20), 9, "v")


@query(
    "trace_trim",
    _SMP
    + """, h AS (SELECT DISTINCT trace_id, CAST(round(1e0 * 100 - (trace_id % 50)) AS BIGINT) AS off FROM smp),
g AS (SELECT trace_id, off, unnest(range(0, 201)) AS i FROM h)
SELECT g.trace_id, g.i, coalesce(v, 0) AS v FROM g LEFT JOIN smp ON smp.trace_id = g.trace_id AND smp.i = g.i + g.off""",
)
def trace_trim(spark, d):
    """A two-second window; traces start up to half a second apart."""
    smp = samples(spark, d)
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    heads = smp.select("trace_id").distinct().select(
        "trace_id",
        F.timestamp_micros(F.unix_micros(t0) + (F.col("trace_id") % 50) * 10_000).alias("starttime"),
        F.lit(100.0).alias("sampling_rate"),
    )
    return W.trim(smp, heads, "2024-01-01 00:00:01", "2024-01-01 00:00:03")


@query(
    "trace_gapfill",
    _SMP
    + """, s AS (SELECT trace_id, i * (1 + trace_id % 3) AS i, v, 0 AS segment FROM smp
      UNION ALL SELECT trace_id, i * (1 + trace_id % 3), v + 1, 1 FROM smp WHERE i % 10 = 0),
o AS (SELECT trace_id, i, arg_max(v, segment) AS v FROM s GROUP BY trace_id, i),
n AS (SELECT *, lead(i) OVER w AS i2, lead(v) OVER w AS v2 FROM o WINDOW w AS (PARTITION BY trace_id ORDER BY i))
SELECT trace_id, i, round(v, 6) AS v, false AS filled FROM n
UNION ALL SELECT trace_id, j AS i, round(v + (v2 - v) * (j - i) / (i2 - i), 6) AS v, true FROM (SELECT *, unnest(range(i + 1, i2)) AS j FROM n WHERE i2 IS NOT NULL)""",
)
def trace_gapfill(spark, d):
    """Every second or third sample of some traces is missing; a later segment overlaps in places."""
    smp = samples(spark, d)
    step = 1 + F.col("trace_id") % 3
    first = smp.select("trace_id", (F.col("i") * step).alias("i"), "v", F.lit(0).alias("segment"))
    later = smp.filter("i % 10 = 0").select("trace_id", (F.col("i") * step).alias("i"), (F.col("v") + 1).alias("v"), F.lit(1).alias("segment"))
    return rounded(W.merge_segments(first.unionByName(later), block=16), 6, "v")


# Three components of a station: event types by user.
_COMP_SQL = """cmp AS (SELECT user_id AS station, CASE event_type WHEN 'view' THEN 'Z' WHEN 'click' THEN 'N' WHEN 'purchase' THEN 'E' WHEN 'signup' THEN '1' ELSE '2' END AS component,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i, value AS v FROM events)"""


def component_samples(spark, d):
    from quakelake.functions.times import micros
    from quakelake.operators.common import with_position

    component = (
        F.when(F.col("event_type") == "view", "Z").when(F.col("event_type") == "click", "N")
        .when(F.col("event_type") == "purchase", "E").when(F.col("event_type") == "signup", "1").otherwise("2")
    )
    ev = table(spark, d, "events").select(F.col("user_id").alias("station"), component.alias("component"), "ts", "event_id", F.col("value").alias("v"))
    ranked = with_position(ev, ["station", "component"], micros(F.col("ts")), ["event_id"], "i")
    return ranked.select("station", "component", (F.col("i") - 1).alias("i"), "v")


@query(
    "motion_pairs",
    f"""WITH {_COMP_SQL} SELECT e.station, e.i, e.v AS e, n.v AS n, z.v AS z FROM cmp e JOIN cmp n ON n.station = e.station AND n.i = e.i AND n.component = 'N'
JOIN cmp z ON z.station = e.station AND z.i = e.i AND z.component = 'Z' WHERE e.component = 'E'""",
)
def motion_pairs(spark, d):
    return W.motion_pairs(component_samples(spark, d))


# --- spectra ------------------------------------------------------------------------------------

# Discrete Fourier sums written out, over whole traces.
_SEG_SQL = """seg AS (SELECT trace_id, 0 AS segment, i AS j, v, count(*) OVER (PARTITION BY trace_id) AS n FROM smp)"""
_SPEC_SQL = (
    _SMP
    + f""", {_SEG_SQL},
w AS (SELECT *, CASE WHEN n > 1 THEN v * (0.5e0 - 0.5e0 * cos(2 * pi() * j / n)) ELSE v END AS x FROM seg),
kk AS (SELECT trace_id, segment, n, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT DISTINCT trace_id, segment, n FROM seg)),
sp AS (SELECT kk.trace_id, kk.segment, kk.k, kk.k * 100e0 / kk.n AS freq,
   sqrt(pow(sum(x * cos(2 * pi() * kk.k * j / kk.n)), 2) + pow(sum(x * sin(2 * pi() * kk.k * j / kk.n)), 2)) / (kk.n * 100e0) AS amp
  FROM kk JOIN w ON w.trace_id = kk.trace_id AND w.segment = kk.segment GROUP BY kk.trace_id, kk.segment, kk.k, kk.n)
"""
)


def trace_segments(spark, d, length: int | None = None):
    return W.segments(samples(spark, d), length=length).withColumn("sampling_rate", F.lit(100.0))


# Here the windows of 64 samples are what is asked for.
@query(
    "segment_lengths",
    _SMP + " SELECT trace_id, i // 64 AS segment, count(*) AS npts, min(v) AS v_min, max(v) AS v_max FROM smp GROUP BY trace_id, i // 64",
)
def segment_lengths(spark, d):
    got = trace_segments(spark, d, 64).withColumn("starttime", F.lit("2024-01-01").cast("timestamp"))
    return W.segment_summary(got).select("trace_id", "segment", "npts", "v_min", "v_max")


@query("spectrum", _SPEC_SQL + "SELECT trace_id, segment, k, round(freq, 9) AS freq, round(amp, 9) AS amp FROM sp")
def spectrum(spark, d):
    return rounded(S.spectrum(trace_segments(spark, d)), 9, "freq", "amp")


# Half-overlapping frames of at most 1,000 samples.
@query(
    "psd",
    _SMP
    + """, len AS (SELECT trace_id, count(*) AS total, least(count(*), 1000) AS n FROM smp GROUP BY trace_id),
fr AS (SELECT trace_id, n, unnest(range(0, (total - n) // (n - n // 2) + 1)) * (n - n // 2) AS s FROM len),
seg AS (SELECT smp.trace_id, s, n, i - s AS j, v - avg(v) OVER (PARTITION BY smp.trace_id, s) AS c,
    CASE WHEN n > 1 THEN 0.5e0 - 0.5e0 * cos(2 * pi() * (i - s) / n) ELSE 1 END AS h
  FROM fr JOIN smp ON smp.trace_id = fr.trace_id AND i >= s AND i < s + n),
kk AS (SELECT trace_id, s, n, unnest(range(0, n // 2 + 1)) AS k FROM fr),
sp AS (SELECT kk.trace_id, kk.s, kk.k, kk.k * 100e0 / kk.n AS freq,
   (pow(sum(c * h * cos(2 * pi() * kk.k * j / kk.n)), 2) + pow(sum(c * h * sin(2 * pi() * kk.k * j / kk.n)), 2)) / (100e0 * sum(h * h))
   * CASE WHEN kk.k = 0 OR (kk.n % 2 = 0 AND kk.k = kk.n // 2) THEN 1 ELSE 2 END AS power
  FROM kk JOIN seg ON seg.trace_id = kk.trace_id AND seg.s = kk.s GROUP BY kk.trace_id, kk.s, kk.k, kk.n),
m AS (SELECT trace_id, k, freq, avg(power) AS power FROM sp GROUP BY trace_id, k, freq)
SELECT trace_id, k, round(freq, 9) AS freq, round(power, 6) AS power, CASE WHEN power > 1e-6 THEN round(10 * log10(power + 1e-30), 4) END AS db FROM m""",
)
def psd(spark, d):
    got = Fr.power_density(samples(spark, d), 100.0).withColumn("db", F.when(F.col("power") > 1e-6, F.round("db", 4)))
    return rounded(got, 9, "freq").withColumn("power", F.round("power", 6))


@query(
    "peak_frequency",
    _SPEC_SQL
    + """SELECT trace_id, segment, round(arg_min(freq, (-round(amp, 9), freq)), 9) AS peak_freq, round(max(amp), 9) AS peak_amp FROM sp GROUP BY trace_id, segment""",
)
def peak_frequency(spark, d):
    return rounded(S.peak_frequency(rounded(S.spectrum(trace_segments(spark, d)), 9, "amp", "freq")), 9, "peak_freq", "peak_amp")


@query(
    "hvsr",
    f"""WITH {_COMP_SQL}, seg AS (SELECT station, component, 0 AS segment, i AS j, v, count(*) OVER (PARTITION BY station, component) AS n FROM cmp),
w AS (SELECT *, CASE WHEN n > 1 THEN v * (0.5e0 - 0.5e0 * cos(2 * pi() * j / n)) ELSE v END AS x FROM seg),
kk AS (SELECT station, component, segment, n, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT DISTINCT station, component, segment, n FROM seg)),
sp AS (SELECT kk.station, kk.component, kk.segment, kk.k, kk.k * 100e0 / kk.n AS freq,
   sqrt(pow(sum(x * cos(2 * pi() * kk.k * j / kk.n)), 2) + pow(sum(x * sin(2 * pi() * kk.k * j / kk.n)), 2)) / (kk.n * 100e0) AS amp
  FROM kk JOIN w ON w.station = kk.station AND w.component = kk.component AND w.segment = kk.segment GROUP BY kk.station, kk.component, kk.segment, kk.k, kk.n),
p AS (SELECT station, segment, k, max(freq) FILTER (WHERE component = 'Z') AS freq, max(amp) FILTER (WHERE component = 'Z') AS z,
   coalesce(max(amp) FILTER (WHERE component = 'N'), max(amp) FILTER (WHERE component = '1')) AS n,
   coalesce(max(amp) FILTER (WHERE component = 'E'), max(amp) FILTER (WHERE component = '2')) AS e FROM sp GROUP BY station, segment, k)
SELECT station, segment, k, round(freq, 9) AS freq, round(CASE WHEN z > 0 THEN sqrt((n * n + e * e) / 2) / z ELSE 0 END, 5) AS hvsr
FROM p WHERE z IS NOT NULL AND n IS NOT NULL AND e IS NOT NULL AND freq BETWEEN 0.1 AND 20""",
)
def hvsr(spark, d):
    seg = W.segments(component_samples(spark, d), ["station", "component"]).withColumn("sampling_rate", F.lit(100.0))
    spec = S.spectrum(seg, ["station", "component", "segment"])
    return rounded(rounded(S.hv_ratio(spec), 9, "freq"), 5, "hvsr")


@query(
    "spectral_plateau",
    _SPEC_SQL
    + """SELECT trace_id, segment, round(coalesce(median(amp) FILTER (WHERE freq > 0.1 AND freq < 2), max(amp) FILTER (WHERE k = 1)), 9) AS omega0 FROM sp GROUP BY trace_id, segment""",
)
def spectral_plateau(spark, d):
    return rounded(S.plateau(S.spectrum(trace_segments(spark, d))), 9, "omega0")


@query(
    "source_magnitudes",
    _SPEC_SQL
    + """, o AS (SELECT trace_id, segment, coalesce(median(amp) FILTER (WHERE freq > 0.1 AND freq < 2), max(amp) FILTER (WHERE k = 1)) AS omega0 FROM sp GROUP BY trace_id, segment),
p AS (SELECT trace_id, segment, max(abs(v)) AS peak, 10e0 + trace_id % 90 AS r FROM seg GROUP BY trace_id, segment)
SELECT p.trace_id, p.segment, round(log10(greatest(peak * 2080e0 * 1000e0, 1e-10)) + 3 * log10(greatest(r, 1)) - 2.92e0, 6) AS ml,
  round(2e0 / 3 * log10(4 * pi() * 2700e0 * pow(3500e0, 3) * r * 1000 * omega0 / (0.63e0 * 2e0)) - 6.07e0, 6) AS mw
FROM p JOIN o ON o.trace_id = p.trace_id AND o.segment = p.segment""",
)
def source_magnitudes(spark, d):
    seg = trace_segments(spark, d)
    distance = 10.0 + F.col("trace_id") % 90
    base = seg.select("trace_id", "segment", F.array_max(F.transform("data", F.abs)).alias("peak"), distance.alias("r"))
    moments = base.join(S.plateau(S.spectrum(seg)), ["trace_id", "segment"])
    return rounded(
        moments.select(
            "trace_id",
            "segment",
            P.local_magnitude(F.col("peak"), F.col("r")).alias("ml"),
            P.moment_magnitude(P.seismic_moment(F.col("omega0"), F.col("r"))).alias("mw"),
        ),
        6, "ml", "mw",
    )


@query(
    "stress_drop",
    """SELECT o_orderkey, round(7e0 / 16 * o_totalprice * 1e10 / pow(0.37e0 * 3500e0 / (1 + o_custkey % 20), 3), 2) AS stress_drop,
  round(2e0 / 3 * log10(o_totalprice * 1e10) - 6.07e0, 8) AS mw FROM orders""",
)
def stress_drop(spark, d):
    m0, fc = F.col("o_totalprice") * 1e10, 1 + F.col("o_custkey") % 20
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.round(P.stress_drop(m0, fc), 2).alias("stress_drop"),
        F.round(P.moment_magnitude(m0), 8).alias("mw"),
    )


@query("corner_frequency")
def corner_frequency(spark, d):
    return S.corner_frequency(trace_segments(spark, d))


@query("source_parameters")
def source_parameters(spark, d):
    return S.source_parameters(trace_segments(spark, d), 10.0 + F.col("trace_id") % 90)


@query(
    "station_average",
    """SELECT o_custkey AS event_id, count(*) AS n_stations, round(avg(o_totalprice / 9973), 6) AS ml_mean, round(stddev_samp(o_totalprice / 9973), 6) AS ml_std FROM orders GROUP BY o_custkey""",
)
def station_average(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("event_id"), (F.col("o_totalprice") / 9973).alias("ml"))
    return rounded(S.station_average(rows, values=["ml"]), 6, "ml_mean", "ml_std")


# Frames of 32 samples every 4 over whole traces, padded to 256 points.
@query(
    "spectrogram",
    _SMP
    + """, c AS (SELECT trace_id, i, count(*) OVER (PARTITION BY trace_id) AS n, v - avg(v) OVER (PARTITION BY trace_id) AS x FROM smp),
fr AS (SELECT trace_id, unnest(range(0, (n - 32) // 4 + 1)) * 4 AS s FROM (SELECT DISTINCT trace_id, n FROM c WHERE n >= 32)),
w AS (SELECT fr.trace_id, fr.s, i - fr.s AS m, x * (0.5e0 - 0.5e0 * cos(2 * pi() * (i - fr.s) / 31)) AS y
      FROM fr JOIN c ON c.trace_id = fr.trace_id AND c.i >= fr.s AND c.i < fr.s + 32),
h AS (SELECT sum(pow(0.5e0 - 0.5e0 * cos(2 * pi() * m / 31), 2)) AS w2 FROM (SELECT unnest(range(32)) AS m)),
k AS (SELECT unnest(range(1, 129)) AS k),
p AS (SELECT w.trace_id, s, k, (pow(sum(y * cos(2 * pi() * k * m / 256)), 2) + pow(sum(y * sin(2 * pi() * k * m / 256)), 2)) / (100e0 * any_value(w2)) * CASE WHEN k = 128 THEN 1 ELSE 2 END AS power
      FROM w, h, k GROUP BY w.trace_id, s, k)
SELECT trace_id, (s + 16) / 100e0 AS t, k * 100e0 / 256 AS freq, CASE WHEN power > 1e-6 THEN round(10 * log10(power), 4) END AS power FROM p""",
)
def spectrogram(spark, d):
    """Decibels; where there is next to no power they are left open."""
    got = Fr.spectrogram(samples(spark, d), 100.0, seconds=0.32)
    return got.withColumn("power", F.when(F.col("power") > -60, F.round("power", 4)))


@query("bandpass")
def bandpass(spark, d):
    return S.bandfilter(trace_segments(spark, d), "bandpass", 1.0, 10.0)


@query("resample")
def resample(spark, d):
    return S.resample(trace_segments(spark, d), 40.0)


# --- picks --------------------------------------------------------------------------------------


@query(
    "pick_sessions",
    f"""WITH {PICKS_SQL}, f AS (SELECT *, CASE WHEN epoch_us(abs_time) - lag(epoch_us(abs_time)) OVER (ORDER BY abs_time, pick_id) <= 120000000 THEN 0 ELSE 1 END AS st FROM pick),
g AS (SELECT *, sum(st) OVER (ORDER BY abs_time, pick_id) AS event_no FROM f)
SELECT CAST(event_no AS BIGINT) AS event_no, count(*) AS n_phases, count(*) FILTER (WHERE phase LIKE 'P%') AS n_p, count(*) FILTER (WHERE phase LIKE 'S%') AS n_s,
  min(abs_time) AS first, max(abs_time) AS last FROM g GROUP BY event_no HAVING count(*) >= 3 AND count(*) FILTER (WHERE phase LIKE 'P%') >= 1 AND count(*) FILTER (WHERE phase LIKE 'S%') >= 1""",
)
def pick_sessions(spark, d):
    """Two minutes apart starts a new event; three picks with a P and an S kind keep it."""
    grouped = K.group_picks(picks(spark, d), 120.0, ties=["pick_id"])
    return K.events_from_groups(grouped, min_phases=3, min_p=1, min_s=1)


@query(
    "pick_groups_by_station",
    f"""WITH {PICKS_SQL}, f AS (SELECT *, CASE WHEN epoch_us(abs_time) - lag(epoch_us(abs_time)) OVER (PARTITION BY station ORDER BY abs_time, pick_id) <= 7200000000 THEN 0 ELSE 1 END AS st FROM pick)
SELECT pick_id, station, CAST(sum(st) OVER (PARTITION BY station ORDER BY abs_time, pick_id) AS BIGINT) AS event_no FROM f""",
)
def pick_groups_by_station(spark, d):
    """The same grouping per station through nine time ranges."""
    got = K.group_picks(picks(spark, d), 7200.0, ["station"], ["pick_id"], buckets=9)
    return got.select("pick_id", "station", "event_no")


@query(
    "station_counts",
    f"""WITH {PICKS_SQL} SELECT station, phase, count(*) AS n, round(avg(confidence), 9) AS confidence, min(abs_time) AS first, max(abs_time) AS last FROM pick GROUP BY station, phase""",
)
def station_counts(spark, d):
    return rounded(K.station_counts(picks(spark, d)), 9, "confidence")


@query(
    "phase_station_filter",
    f"""WITH {PICKS_SQL} SELECT pick_id, phase, station FROM pick WHERE phase = 'Pg' AND (upper(station) IN ('X1.S8', 'X3.S10') OR string_split(upper(station), '.')[2] IN ('S8', 'S10'))""",
)
def phase_station_filter(spark, d):
    rows = K.of_phase(picks(spark, d), "Pg").withColumn("network", F.element_at(F.split("station", "[.]"), 1)).withColumn("code", K.last_code(F.col("station")))
    return K.at_stations(rows, ["X1.S8", "X3.S10"], "network", "code").select("pick_id", "phase", "station")


@query(
    "polarity_decisions",
    """WITH p AS (SELECT event_id, value / 1000 AS up, 0.6e0 - value / 1000 AS down FROM events)
SELECT event_id, CASE WHEN greatest(up, down) < 0.35 THEN 'N' WHEN up >= down THEN 'U' ELSE 'D' END AS polarity, round(greatest(up, down), 9) AS prob FROM p""",
)
def polarity_decisions(spark, d):
    rows = table(spark, d, "events").select("event_id", F.array(F.col("value") / 1000, F.lit(0.6) - F.col("value") / 1000).alias("probs"))
    return rounded(K.decide_polarity(rows, 0.35), 9, "prob").select("event_id", "polarity", "prob")


@query(
    "polarity_tally",
    """WITH p AS (SELECT event_type, value / 1000 AS up, 0.6e0 - value / 1000 AS down FROM events),
q AS (SELECT event_type, CASE WHEN greatest(up, down) < 0.35 THEN 'N' WHEN up >= down THEN 'U' ELSE 'D' END AS p FROM p)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE p = 'U') AS n_up, count(*) FILTER (WHERE p = 'D') AS n_down, count(*) FILTER (WHERE p = 'N') AS n_uncertain FROM q GROUP BY event_type""",
)
def polarity_tally(spark, d):
    rows = table(spark, d, "events").select("event_type", F.array(F.col("value") / 1000, F.lit(0.6) - F.col("value") / 1000).alias("probs"))
    return K.polarity_tally(K.decide_polarity(rows, 0.35), ["event_type"])


@query(
    "polarity_windows",
    """WITH s AS (SELECT o_custkey % 10 AS station, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) - 1 AS i, o_totalprice AS v FROM orders),
n AS (SELECT station, count(*) AS n FROM s GROUP BY station),
p AS (SELECT event_id, user_id % 10 AS station, (event_id % 1700) / 100e0 AS rel, CAST(floor((event_id % 1700) / 100e0 * 100e0) AS BIGINT) AS i FROM events),
w AS (SELECT p.event_id, p.station, p.i, n.n, p.i >= 512 AND p.i <= n.n - 512 AS ok FROM p JOIN n ON n.station = p.station),
c AS (SELECT station, i, sum(v) OVER (PARTITION BY station ORDER BY i) AS c FROM s)
SELECT event_id, w.station, CASE WHEN ok THEN 'ok' ELSE 'out_of_bounds' END AS reason, CASE WHEN ok THEN 1024 END AS n_samples,
  round(CASE WHEN ok THEN b.c - coalesce(a.c, 0) END, 2) AS total
FROM w LEFT JOIN c b ON ok AND b.station = w.station AND b.i = w.i + 511 LEFT JOIN c a ON ok AND a.station = w.station AND a.i = w.i - 513""",
)
def polarity_windows(spark, d):
    """Windows of 1024 samples around picks; ten station traces are built from the orders."""
    from quakelake.operators.common import with_position

    orders = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("station"), "o_orderkey", F.col("o_totalprice").alias("v"))
    smp = with_position(orders, ["station"], F.col("o_orderkey"), name="i").select("station", (F.col("i") - 1).alias("i"), "v")
    traces = W.segments(smp, ["station"]).withColumn("sampling_rate", F.lit(100.0)).withColumn("file", F.col("segment").cast("string"))
    e = F.col("event_id")
    pk = table(spark, d, "events").select(e, (F.col("user_id") % 10).alias("station"), ((e % 1700) / F.lit(100.0)).alias("rel_time"), F.lit("0").alias("file"))
    got = K.polarity_windows(pk, traces)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return got.select("event_id", "station", "reason", F.size("window").alias("n_samples"), F.round(total, 2).alias("total")).withColumn(
        "n_samples", F.when(F.col("reason") == "ok", F.col("n_samples"))
    )


@query(
    "scored_windows",
    """WITH s AS (SELECT label, list_sum(CAST(embedding AS DOUBLE[])) AS s FROM embeddings)
SELECT label, count(*) AS n, count(*) FILTER (WHERE s >= 0.1) AS n_up, count(*) FILTER (WHERE -s >= 0.1) AS n_down, count(*) FILTER (WHERE abs(s) < 0.1) AS n_uncertain FROM s GROUP BY label""",
)
def scored_windows(spark, d):
    """A user-supplied scorer over message-length windows, then the decision and tally."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("window"))

    def scorer(windows):
        return [[max(sum(w), 0.0), max(-sum(w), 0.0)] for w in windows]

    return K.polarity_tally(K.decide_polarity(K.score_windows(rows, scorer), 0.1), ["label"])


@query(
    "model_picks",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Pg' WHEN 1 THEN 'Sg' WHEN 2 THEN 'Pn' WHEN 3 THEN 'Sn' WHEN 4 THEN 'P' WHEN 5 THEN 'S' ELSE 'P6' END AS phase,
  round(user_id * 37 / 100e0, 3) AS time_s, round(value / 500, 3) AS confidence, user_id * 37 AS sample FROM events""",
)
def model_picks(spark, d):
    raw = table(spark, d, "events").select(
        "event_id", (F.col("event_id") % 7).alias("code"), (F.col("user_id") * 37).cast("double").alias("sample"), (F.col("value") / 500).alias("conf")
    )
    return K.decode_model_picks(raw)


_CHAN = "CASE lo.o_orderkey % 6 WHEN 0 THEN 'BHZ' WHEN 1 THEN 'BHN' WHEN 2 THEN 'HHE' WHEN 3 THEN 'SHZ' WHEN 4 THEN 'BH1' ELSE 'LOG' END"


def _channel_rows(spark, d):
    i = F.col("o_orderkey") % 6
    channel = F.when(i == 0, "BHZ").when(i == 1, "BHN").when(i == 2, "HHE").when(i == 3, "SHZ").when(i == 4, "BH1").otherwise("LOG")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("station"), channel.alias("channel"), F.col("o_orderkey").alias("trace_no"))


_SETS = f"""WITH c AS (SELECT o_custkey AS station, {_CHAN} AS channel FROM orders lo),
x AS (SELECT DISTINCT station, CASE channel[3] WHEN '1' THEN 'N' WHEN '2' THEN 'E' ELSE channel[3] END AS c FROM c),
s AS (SELECT station, string_agg(c, ' ' ORDER BY c) AS components, count(*) = 3 AS complete FROM x WHERE c IN ('E', 'N', 'Z') GROUP BY station)
"""


@query("component_sets", _SETS + "SELECT station, components, complete FROM s")
def component_sets(spark, d):
    return K.component_sets(_channel_rows(spark, d)).withColumn("components", F.array_join("components", " "))


@query("component_completeness", _SETS + "SELECT count(*) FILTER (WHERE complete) AS n_complete, count(*) FILTER (WHERE NOT complete) AS n_incomplete FROM s")
def component_completeness(spark, d):
    return K.completeness_counts(K.component_sets(_channel_rows(spark, d)))


@query(
    "component_fill",
    _SETS
    + """SELECT station, CASE WHEN contains(components, 'E') THEN 'E' ELSE components[-1] END AS use_e, CASE WHEN contains(components, 'N') THEN 'N' ELSE components[-1] END AS use_n,
  CASE WHEN contains(components, 'Z') THEN 'Z' ELSE components[-1] END AS use_z FROM s""",
)
def component_fill(spark, d):
    return K.fill_components(K.component_sets(_channel_rows(spark, d)), "duplicate").select("station", "use_e", "use_n", "use_z")


@query(
    "component_choice",
    f"""WITH c AS (SELECT o_custkey AS station, o_orderkey AS trace_no, {_CHAN} AS channel FROM orders lo),
b AS (SELECT *, CASE channel[1:2] WHEN 'BH' THEN 0 WHEN 'HH' THEN 1 WHEN 'SH' THEN 2 WHEN 'EI' THEN 3 WHEN 'HN' THEN 4 END AS band, channel[3] AS comp,
        row_number() OVER (PARTITION BY station ORDER BY trace_no) AS r, count(*) OVER (PARTITION BY station) AS n FROM c),
f AS (SELECT station, comp, arg_min(trace_no, band * 10000000 + trace_no) AS trace_no FROM b WHERE band IS NOT NULL AND comp IN ('E', 'N', 'Z') GROUP BY station, comp),
k AS (SELECT station FROM f GROUP BY station HAVING count(*) = 3)
SELECT station, comp AS component, trace_no FROM f WHERE station IN (SELECT station FROM k)
UNION ALL SELECT station, ['E', 'N', 'Z'][r] AS component, trace_no FROM b WHERE n >= 3 AND r <= 3 AND station NOT IN (SELECT station FROM k)""",
)
def component_choice(spark, d):
    return K.component_choice(_channel_rows(spark, d), ["station"])


@query(
    "aligned_components",
    f"""WITH {_COMP_SQL}, c AS (SELECT *, i // 32 AS segment, i % 32 AS j FROM cmp),
n AS (SELECT station, segment, count(*) FILTER (WHERE component = 'E') AS ne, count(*) FILTER (WHERE component = 'N') AS nn, count(*) FILTER (WHERE component = 'Z') AS nz
   FROM c GROUP BY station, segment),
e AS (SELECT station, segment, least(3 + ne, 2 + nn, nz) - 1 AS last FROM n WHERE ne > 0 AND nn > 0 AND nz > 0)
SELECT e.station, e.segment, make_timestamp(epoch_us(TIMESTAMP '2024-01-01 00:00:00.03') + e.segment * 320000) AS starttime, last - 2 AS n, round(sum(v), 6) AS z_sum
FROM e JOIN c ON c.station = e.station AND c.segment = e.segment AND component = 'Z' AND j BETWEEN 3 AND last WHERE last > 3 GROUP BY e.station, e.segment, last""",
)
def aligned_components(spark, d):
    """Component segments of different starts cut to their common span."""
    three = component_samples(spark, d).filter(F.col("component").isin("E", "N", "Z"))
    seg = W.segments(three, ["station", "component"], 32)
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("segment") * 320_000
    shift = F.when(F.col("component") == "Z", 0).when(F.col("component") == "N", 20_000).otherwise(30_000)
    traces = (
        seg.withColumn("channel", F.concat(F.lit("BH"), "component"))
        .withColumn("trace_no", F.xxhash64("station", "segment", "component"))
        .withColumn("starttime", F.timestamp_micros(start + shift))
        .withColumn("sampling_rate", F.lit(100.0))
    )
    got = K.align_components(traces, ["station", "segment"])
    total = F.aggregate("data", F.lit(0.0), lambda a, s: a + s["z"])
    return got.select(
        "station",
        "segment",
        F.col("starttime").cast("timestamp_ntz").alias("starttime"),
        F.size("data").cast("long").alias("n"),
        F.round(total, 6).alias("z_sum"),
    )


@query(
    "data_format",
    f"""WITH f AS (SELECT CASE WHEN lo.o_orderkey % 4 = 0 THEN '.SAC' ELSE '.mseed' END AS ext, {_CHAN} AS ch FROM orders lo)
SELECT (SELECT lower(mode(ext)) FROM f) AS extension, CAST(3 AS BIGINT) AS channel_index,
  (SELECT string_agg(ch, ' ' ORDER BY ch) FROM (SELECT DISTINCT ch FROM f WHERE ch IN ('BHE','BHN','BHZ','SHE','SHN','SHZ','HHE','HHN','HHZ','EIE','EIN','EIZ','HNE','HNN','HNZ'))) AS channels,
  CAST(3 AS INTEGER) AS n_groups""",
)
def data_format(spark, d):
    rows = _channel_rows(spark, d)
    ext = F.when(F.col("trace_no") % 4 == 0, ".SAC").otherwise(".mseed")
    files = rows.select(F.concat(F.lit("/d/X1.S"), F.col("station").cast("string"), F.lit(".00."), "channel", F.lit(".D.2024"), ext).alias("path"))
    got = K.active_groups(K.data_format(files))
    return got.select("extension", "channel_index", F.array_join("channels", " ").alias("channels"), F.size("groups").alias("n_groups"))


@query(
    "pick_overlay",
    f"""WITH {PICKS_SQL}, t AS (SELECT s_suppkey AS trace_id, 'S' || s_suppkey AS station, TIMESTAMP '2024-01-05' + to_hours(CAST(s_suppkey % 48 AS INTEGER)) AS starttime FROM supplier)
SELECT pick_id, pick.station, trace_id, (epoch_us(abs_time) - epoch_us(starttime)) / 1e6 AS rel_time FROM pick JOIN t ON string_split(pick.station, '.')[2] = t.station
WHERE epoch_us(abs_time) >= epoch_us(starttime) AND (epoch_us(abs_time) - epoch_us(starttime)) / 1e6 <= 863999""",
)
def pick_overlay(spark, d):
    """Ten-day traces of the stations named like suppliers."""
    k = F.col("s_suppkey")
    traces = table(spark, d, "supplier").select(
        k.alias("trace_id"),
        F.concat(F.lit("S"), k.cast("string")).alias("station"),
        F.timestamp_micros(F.unix_micros(F.lit("2024-01-05").cast("timestamp")) + k % 48 * 3_600_000_000).alias("starttime"),
        F.lit(1.0).alias("sampling_rate"),
        F.lit(864_000).alias("npts"),
    )
    return K.picks_on_traces(picks(spark, d), traces).select("pick_id", "station", "trace_id", "rel_time")


@query(
    "pick_stations",
    f"""WITH {PICKS_SQL} SELECT pick_id, pick.station, 100 + c_nationkey / 10e0 AS longitude, c_acctbal AS elevation FROM pick
JOIN customer ON pick.station = 'X' || (c_custkey % 7) || '.S' || c_custkey""",
)
def pick_stations(spark, d):
    k = F.col("c_custkey")
    stations = table(spark, d, "customer").select(
        F.concat(F.lit("X"), (k % 7).cast("string"), F.lit(".S"), k.cast("string")).alias("station"),
        (100 + F.col("c_nationkey") / 10.0).alias("longitude"),
        F.col("c_acctbal").alias("elevation"),
    )
    return K.with_station(picks(spark, d), stations).select("pick_id", "station", "longitude", "elevation")


_PAIR_SQL = """ev AS (SELECT o_orderkey AS event_id, o_orderdate AS time FROM orders),
nb AS (SELECT event_id AS ev1, unnest(list(event_id) OVER (ORDER BY time, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) AS ev2 FROM ev)"""


@query("neighbour_pairs", f"WITH {_PAIR_SQL} SELECT ev1, ev2 FROM nb")
def neighbour_pairs(spark, d):
    """Each order with its next four in time, through eleven time ranges."""
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("time"))
    return K.neighbour_pairs(events, 4, buckets=11)


@query(
    "event_pairs",
    f"""WITH {_PAIR_SQL}, pk AS (SELECT l_orderkey AS event_id, l_linenumber AS station, l_returnflag AS phase, avg(l_extendedprice) AS travel_time, max(l_quantity) / 50 AS weight FROM lineitem GROUP BY ALL)
SELECT nb.ev1, nb.ev2, a.station, a.phase, round(a.travel_time, 4) AS tp1, round(b.travel_time, 4) AS tp2, round((a.weight + b.weight) / 2, 6) AS weight
FROM nb JOIN pk a ON a.event_id = nb.ev1 JOIN pk b ON b.event_id = nb.ev2 AND b.station = a.station AND b.phase = a.phase""",
)
def event_pairs(spark, d):
    """Differential times: line numbers as stations, return flags as phases."""
    pk = table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("station"), F.col("l_returnflag").alias("phase")
    ).agg(F.avg("l_extendedprice").alias("travel_time"), (F.max("l_quantity") / 50).alias("weight"))
    got = K.differential_times(pk, neighbour_pairs(spark, d))
    return rounded(rounded(got, 4, "tp1", "tp2"), 6, "weight")


# --- text sources -------------------------------------------------------------------------------


def pick_file_lines(spark, d):
    """Pick lines as they stand in files: one file per user in splits of a day, headers every ninth event.

    Some lines lack fields or hold unreadable numbers.
    """
    e = F.col("event_id")
    body = F.concat_ws(
        ",", "event_type", F.format_string("%.3f", F.col("value") * 10), F.format_string("%.3f", F.col("value") / 500),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        F.when(e % 13 == 0, "bad").otherwise(F.format_string("%.2f", "value")),
        F.when(e % 11 == 0, "bad").otherwise("892.73"),
        F.concat(F.lit("X1.S"), F.col("user_id").cast("string")),
        F.when(e % 3 == 0, "U").otherwise("D"),
    )
    line = F.when(e % 9 == 0, F.concat(F.lit("#wave"), e.cast("string"), F.lit(".mseed"))).when(e % 17 == 0, "Pg,1.0,0.5").otherwise(body)
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("path"),
        F.unix_date(F.col("ts").cast("date")).cast("long").alias("block"),
        e.alias("pos"),
        line.alias("line"),
    )


_LINES_SQL = """ln AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS pos, ts, event_type AS phase, event_id % 9 = 0 AS is_head, event_id % 17 = 0 AS short,
   event_id % 13 = 0 AS bad_snr, event_id % 11 = 0 AS bad_amp, round(value / 500, 3) AS confidence, value AS snr, round(value * 10, 3) AS rel_time, 'X1.S' || user_id AS station,
   CASE WHEN event_id % 3 = 0 THEN 'U' ELSE 'D' END AS polarity FROM events)"""


@query(
    "parse_picks",
    f"""WITH {_LINES_SQL} SELECT path, pos, phase, ts AS time, confidence, snr, station FROM ln WHERE NOT is_head AND NOT short AND NOT bad_snr""",
)
def parse_picks(spark, d):
    return SP.parse_picks(pick_file_lines(spark, d)).drop("block").withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(
    "parse_full_picks",
    f"""WITH {_LINES_SQL} SELECT path, pos, phase, rel_time, confidence, ts AS abs_time, snr, 892.73e0 AS amplitude, station, polarity FROM ln
WHERE NOT is_head AND NOT short AND NOT bad_snr AND NOT bad_amp""",
)
def parse_full_picks(spark, d):
    return SP.parse_full_picks(pick_file_lines(spark, d)).drop("block").withColumn("abs_time", F.col("abs_time").cast("timestamp_ntz"))


@query(
    "parse_lenient_picks",
    f"""WITH {_LINES_SQL} SELECT path, pos, phase, rel_time AS time_s, confidence, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS abs_time, snr, station, polarity FROM ln
WHERE NOT is_head AND NOT short AND NOT bad_snr""",
)
def parse_lenient_picks(spark, d):
    return SP.parse_lenient_picks(pick_file_lines(spark, d)).drop("block")


@query(
    "carry_waveform_file",
    f"""WITH {_LINES_SQL}, h AS (SELECT *, CASE WHEN is_head THEN 'wave' || pos || '.mseed' END AS h FROM ln)
SELECT path, pos, last_value(h IGNORE NULLS) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS source FROM h""",
)
def carry_waveform_file(spark, d):
    return SP.with_waveform_file(pick_file_lines(spark, d)).select("path", "pos", "source")


_TIMES = """CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
  WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 4 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 5 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END"""


def _written_time():
    t = F.col("ts").cast("timestamp")
    i = F.col("event_id") % 7
    w = lambda p: F.date_format(t, p)
    return (
        F.when(i == 0, w("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(i == 1, w("yyyy-MM-dd'T'HH:mm:ss")).when(i == 2, w("yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(i == 3, w("yyyy-MM-dd HH:mm:ss")).when(i == 4, w("yyyy/MM/dd HH:mm:ss")).when(i == 5, w("yyyy-MM-dd")).otherwise(w("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )


@query(
    "parse_catalog_table",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN ts WHEN 2 THEN ts WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE date_trunc('second', ts) END AS time,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 100 END AS magnitude, 100e0 + event_id % 10 AS longitude, CAST(NULL AS DOUBLE) AS latitude, CAST(event_id % 40 AS DOUBLE) AS depth FROM events""",
)
def parse_catalog_table(spark, d):
    """Text columns under other programs' names; a fifth of the magnitudes is unreadable."""
    e = F.col("event_id")
    text = table(spark, d, "events").select(
        e.cast("string").alias("source_file"),
        F.when(e % 5 == 0, "n/a").otherwise((F.col("value") / 100).cast("string")).alias("MAG"),
        F.lit("9").alias("ml"),
        (100 + e % 10).cast("string").alias(" Lon"),
        F.col("event_type").alias("Place"),
        _written_time().alias("Origin_Time"),
        (e % 40).cast("string").alias("dep"),
    )
    got = SC.canonical(text)
    return got.select(
        F.col("source_file").cast("long").alias("event_id"), F.col("time").cast("timestamp_ntz").alias("time"), "magnitude", "longitude", "latitude", "depth"
    )


@query(
    "parse_catalog_records",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts END AS time, value / 100 AS magnitude, CASE WHEN event_id % 3 <> 0 THEN 100e0 + event_id % 10 END AS longitude,
  CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS depth FROM events""",
)
def parse_catalog_records(spark, d):
    """JSON records whose keys differ from record to record."""
    e = F.col("event_id")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    record = F.concat(
        F.lit('{"'), F.when(e % 4 < 2, "Mag").otherwise("ML"), F.lit('": '), (F.col("value") / 100).cast("string"),
        F.when(e % 2 == 0, F.concat(F.lit(', "Origin_Time": "'), stamp, F.lit('"'))).otherwise(F.lit(', "time": "soon"')),
        F.when(e % 3 != 0, F.concat(F.lit(', " LON ": "'), (100 + e % 10).cast("string"), F.lit('"'))).otherwise(""),
        F.lit("}"),
    )
    rows = table(spark, d, "events").select("event_id", record.alias("record"))
    return SC.parse_records(rows).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(
    "parse_stations",
    """SELECT 'X' || (c_custkey % 7) AS network, 'S' || c_custkey AS code, 'X' || (c_custkey % 7) || '.S' || c_custkey AS station,
  100e0 + c_nationkey AS longitude, 20e0 + c_nationkey AS latitude, CASE WHEN c_custkey % 3 = 0 THEN 0e0 ELSE CAST(c_custkey AS DOUBLE) END AS elevation FROM customer WHERE c_custkey % 10 <> 0""",
)
def parse_stations(spark, d):
    k = F.col("c_custkey")
    sep = F.when(k % 2 == 0, ", ").otherwise("  ")
    line = F.concat(
        F.lit("X"), (k % 7).cast("string"), sep, F.lit("S"), k.cast("string"), sep, F.lit("00"), sep,
        F.when(k % 10 == 0, "?").otherwise((100 + F.col("c_nationkey")).cast("string")), sep, (20 + F.col("c_nationkey")).cast("string"),
        F.when(k % 3 == 0, "").otherwise(F.concat(sep, k.cast("string"))),
    )
    return ST.parse_stations(table(spark, d, "customer").select(line.alias("line"))).drop("location")


@query(
    "parse_velocity_model",
    """SELECT CAST(p_size AS DOUBLE) AS depth, round(p_retailprice / 100, 4) AS vp, CASE WHEN p_partkey % 2 = 0 THEN 3.5e0 END AS vs, CAST(NULL AS DOUBLE) AS density FROM part""",
)
def parse_velocity_model(spark, d):
    line = F.concat_ws(" ", F.col("p_size").cast("string"), F.format_string("%.4f", F.round(F.col("p_retailprice") / 100, 4)), F.when(F.col("p_partkey") % 2 == 0, "3.5"))
    return ST.parse_velocity_model(table(spark, d, "part").select(line.alias("line")))


@query(
    "fault_points",
    """WITH l AS (SELECT CAST(p_size AS VARCHAR) AS path, p_partkey AS pos, p_partkey % 8 = 0 AS brk, p_retailprice AS lon, CAST(p_size AS DOUBLE) AS lat FROM part)
SELECT path, CAST(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS BIGINT) AS segment, pos, lon, lat FROM l QUALIFY NOT brk""",
)
def fault_points(spark, d):
    """Polyline files by part size, in splits of five hundred lines."""
    k = F.col("p_partkey")
    line = F.when(k % 16 == 0, ">").when(k % 8 == 0, "  ").otherwise(F.concat_ws(" ", F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")))
    lines = table(spark, d, "part").select(F.col("p_size").cast("string").alias("path"), F.floor(k / 500).alias("block"), k.alias("pos"), line.alias("line"))
    return ST.fault_points(lines).select("path", "segment", "pos", "lon", "lat")


@query(
    "bibtex_entries",
    """WITH e AS (SELECT doc_id, 'article{k' || doc_id || '_' || lang || ',' || chr(10) || ' title={' || source || '}}' AS e FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, 'k' || doc_id || '_' || lang AS key, '@article{k' || doc_id || '_' || lang || ',' || chr(10) || ' title={' || source || '}}' AS snippet
FROM documents WHERE contains(lower('article{k' || doc_id || '_' || lang || ',' || chr(10) || ' title={' || source || '}}'), 'src1')""",
)
def bibtex_entries(spark, d):
    i = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("@article{k"), i, F.lit("_"), "lang", F.lit(",\n title={"), "source", F.lit("}}\n@book{b"), i, F.lit(",\n title={x}}")
    )
    return ST.bibtex_entries(table(spark, d, "documents").select(i.alias("path"), text.alias("text")), "SRC1", None)


@query(
    "front_matter",
    """SELECT doc_id, 'skill ' || source AS name, 'about ' || lang || ' texts' AS description, CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source ELSE source || '|' || 'x y' END AS keywords,
  trim(text, ' ' || chr(10) || chr(9)) AS body FROM documents""",
)
def front_matter(spark, d):
    i = F.col("doc_id")
    listed = F.when(i % 2 == 0, F.concat(F.lit("keywords: "), "lang", F.lit(", "), "source")).otherwise(
        F.concat(F.lit("keywords:\n  - "), "source", F.lit("\n  - x y"))
    )
    text = F.concat(F.lit('---\nname: "skill '), "source", F.lit('"\ndescription:  about '), "lang", F.lit("   texts\n"), listed, F.lit("\nrelated_skills: []\n---\n"), "text")
    got = ST.front_matter(table(spark, d, "documents").select("doc_id", text.alias("text")))
    return got.select("doc_id", "name", "description", F.array_join("keywords", "|").alias("keywords"), "body")


@query(
    "workflow_steps",
    """SELECT 'w' || p_partkey AS name, CAST(0 AS BIGINT) AS step_no, 's1' AS id, p_brand AS skill, p_type AS description, '' AS depends_on FROM part
UNION ALL SELECT 'w' || p_partkey, 1, 's2', p_brand, 'then', 's1|s0' FROM part""",
)
def workflow_steps(spark, d):
    text = F.concat(
        F.lit("---\nname: w\nsteps:\n  - id: s1\n    skill: "), "p_brand", F.lit("\n    description: "), "p_type",
        F.lit("\n  - id: s2\n    skill: "), "p_brand", F.lit("\n    description: then\n    depends_on: [s1, s0]\ntitle: t\n---\nbody"),
    )
    rows = table(spark, d, "part").select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("name"), text.alias("text"))
    return ST.workflow_steps(rows).withColumn("depends_on", F.array_join("depends_on", "|"))


@query(
    "polarity_lines",
    """WITH p AS (SELECT 'X.S' || user_id AS station, ts, value / 997 AS up, 0.6e0 - value / 997 AS down FROM events)
SELECT station || ',' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ',' || CASE WHEN greatest(up, down) < 0.35 THEN 'N' WHEN up >= down THEN 'U' ELSE 'D' END || ',' || printf('%.3f', greatest(up, down)) AS value FROM p""",
)
def polarity_lines(spark, d):
    rows = table(spark, d, "events").select(
        F.concat(F.lit("X.S"), F.col("user_id").cast("string")).alias("station"), F.col("ts").cast("timestamp").alias("abs_time"),
        F.array(F.col("value") / 997, F.lit(0.6) - F.col("value") / 997).alias("probs"),
    )
    return sinks.polarity_lines(K.decide_polarity(rows, 0.35))


@query(
    "station_lines",
    """SELECT printf('%-8s %9.4f %10.4f %7.1f', 'X1_S' || s_suppkey, 20e0 + s_nationkey, 100e0 + s_nationkey / 4e0, CAST(s_suppkey AS DOUBLE)) AS value FROM supplier""",
)
def station_lines(spark, d):
    st = table(spark, d, "supplier").select(
        F.lit("X1").alias("network"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"),
        (20.0 + F.col("s_nationkey")).alias("latitude"), (100.0 + F.col("s_nationkey") / 4.0).alias("longitude"), F.col("s_suppkey").cast("double").alias("elevation"),
    )
    return sinks.station_lines(st)


@query(
    "differential_time_lines",
    f"""WITH {_PAIR_SQL} SELECT ev1, ev2, '' AS station, '' AS phase, '# ' || ev1 || ' ' || ev2 || ' 0.0' AS value FROM nb
UNION ALL SELECT ev1, ev2, 'S' || (ev1 % 5), 'P', printf('%-8s %9.3f %9.3f %7.4f %s', 'S' || (ev1 % 5), (ev1 % 100) / 8e0, (ev2 % 100) / 8e0, 1e0, 'P') FROM nb""",
)
def differential_time_lines(spark, d):
    pairs = neighbour_pairs(spark, d).select(
        "ev1", "ev2", F.concat(F.lit("S"), (F.col("ev1") % 5).cast("string")).alias("station"), F.lit("P").alias("phase"),
        (F.col("ev1") % 100 / 8.0).alias("tp1"), (F.col("ev2") % 100 / 8.0).alias("tp2"), F.lit(1.0).alias("weight"),
    )
    return sinks.differential_time_lines(pairs)


@query(
    "phase_lines",
    f"""WITH {PICKS_SQL} SELECT pick_id AS event_id, printf('%-8s %-3s %s %6.3f', station, phase, strftime(abs_time, '%Y-%m-%d %H:%M:%S.%f'), confidence * 500 / 997) AS value FROM pick""",
)
def phase_lines(spark, d):
    """Weights are scaled so that none lies halfway between two thousandths, where printing rules differ."""
    rows = picks(spark, d).withColumn("event_id", F.col("pick_id")).withColumn("confidence", F.col("confidence") * 500 / 997)
    return sinks.phase_lines(rows)


@query(
    "polarity_input_lines",
    """WITH p AS (SELECT 'S' || user_id AS station, value / 1000 AS up, 0.6e0 - value / 1000 AS down FROM events)
SELECT printf('%-8s %s', station, CASE WHEN up >= down THEN 'U' ELSE 'D' END) AS value FROM p WHERE greatest(up, down) >= 0.35""",
)
def polarity_input_lines(spark, d):
    rows = table(spark, d, "events").select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("station"), F.array(F.col("value") / 1000, F.lit(0.6) - F.col("value") / 1000).alias("probs")
    )
    return sinks.polarity_input_lines(K.decide_polarity(rows, 0.35))
