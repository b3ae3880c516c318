"""Catalog-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakelake.operators import catalog as C
from quakelake.operators import profiling
from quakelake.operators.common import spread
from quakelake.plans.inputs import CATALOG_SQL, catalog, table
from quakelake.plans.registry import query, rounded

BY_TYPE = ["event_type"]

# Brute-force bins: every bin centre against every event of its group.
_FMD = f"""WITH {CATALOG_SQL},
lim AS (SELECT event_type, CAST(floor(min(magnitude) / 1e-1) AS BIGINT) AS k0,
               CAST(ceil(max(magnitude) / 1e-1) AS BIGINT) AS k1 FROM cat GROUP BY event_type),
grid AS (SELECT event_type, round(k * 1e-1, 10) AS mag_bin
         FROM (SELECT event_type, unnest(range(k0, k1 + 1)) AS k FROM lim)),
fmd AS (SELECT g.event_type, g.mag_bin,
               count(*) FILTER (WHERE magnitude >= mag_bin - 5e-2 AND magnitude < mag_bin + 5e-2) AS n,
               count(*) FILTER (WHERE magnitude >= mag_bin - 5e-2) AS n_cum,
               sum(magnitude) FILTER (WHERE magnitude >= mag_bin - 5e-2) AS s_cum
        FROM grid g JOIN cat c ON c.event_type = g.event_type GROUP BY g.event_type, g.mag_bin),
mc AS (SELECT event_type, mag_bin AS peak, round(mag_bin + 2e-1, 2) AS mc
       FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, mag_bin) AS r FROM fmd)
       WHERE r = 1),
mle0 AS (SELECT c.event_type, max(mc) AS mc, count(*) AS n_events, avg(magnitude) AS mean_magnitude,
               stddev_samp(magnitude) AS s
        FROM cat c JOIN mc ON mc.event_type = c.event_type WHERE magnitude >= mc - 5e-2 GROUP BY c.event_type),
mle1 AS (SELECT *, log10(exp(1e0)) / (mean_magnitude - (mc - 5e-2)) AS b FROM mle0),
mle AS (SELECT event_type, mc, b, 2.3e0 * b * b * s / sqrt(n_events * (n_events - 1e0)) AS bu,
               log10(n_events) + b * mc AS a, n_events, mean_magnitude FROM mle1)
"""


@query("fmd_by_type", _FMD + "SELECT event_type, mag_bin, n, n_cum FROM fmd")
def fmd_by_type(spark, d):
    return C.frequency_magnitude(catalog(spark, d), group_cols=BY_TYPE)


@query("mc_maxc", _FMD + "SELECT event_type, peak, mc FROM mc")
def mc_maxc(spark, d):
    return C.mc_max_curvature(catalog(spark, d), group_cols=BY_TYPE)


@query(
    "mc_gof",
    _FMD
    + """, cand AS (
  SELECT f.event_type, f.mag_bin AS m0, f.n_cum AS c0,
         log10(exp(1e0)) / nullif(f.s_cum / f.n_cum - (f.mag_bin - 5e-2), 0) AS b
  FROM fmd f JOIN mc ON mc.event_type = f.event_type
  WHERE f.mag_bin >= mc.peak AND f.n_cum >= 10),
res AS (
  SELECT c.event_type, c.m0,
         100 * sum(abs(f.n_cum - pow(10e0, log10(c.c0) + c.b * c.m0 - c.b * f.mag_bin))) / sum(f.n_cum) AS r
  FROM cand c JOIN fmd f ON f.event_type = c.event_type AND f.mag_bin >= c.m0
  GROUP BY c.event_type, c.m0),
best AS (SELECT event_type, min(m0) AS m0, arg_min(r, m0) AS r FROM res WHERE r <= 5 GROUP BY event_type)
SELECT mc.event_type, mc.peak, round(coalesce(best.m0, mc.mc), 2) AS mc, round(best.r, 6) AS residual
FROM mc LEFT JOIN best ON best.event_type = mc.event_type""",
)
def mc_gof(spark, d):
    return rounded(C.mc_goodness_of_fit(catalog(spark, d), group_cols=BY_TYPE), 6, "residual")


@query(
    "bvalue_mle",
    _FMD
    + """SELECT event_type, mc, round(b, 6) AS b_value, round(bu, 8) AS b_uncertainty, round(a, 6) AS a_value,
  n_events, round(mean_magnitude, 6) AS mean_magnitude FROM mle""",
)
def bvalue_mle(spark, d):
    got = C.b_value_mle(catalog(spark, d), group_cols=BY_TYPE)
    return rounded(rounded(got, 6, "b_value", "a_value", "mean_magnitude"), 8, "b_uncertainty")


_LSQ = (
    _FMD
    + """, pts AS (SELECT f.event_type, mc.mc, f.mag_bin AS x, log10(f.n_cum) AS y, f.n_cum
  FROM fmd f JOIN mc ON mc.event_type = f.event_type WHERE f.mag_bin >= mc.mc - 5e-2 AND f.n_cum > 0),
line AS (SELECT event_type, max(mc) AS mc, regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic,
                regr_sxx(y, x) AS sxx, count(*) AS n_bins, max(n_cum) AS n_events
         FROM pts GROUP BY event_type HAVING count(*) >= 2),
ssr AS (SELECT p.event_type, sum(pow(p.y - (l.ic + l.sl * p.x), 2)) AS ssr
        FROM pts p JOIN line l ON l.event_type = p.event_type GROUP BY p.event_type)
"""
)


@query(
    "bvalue_lsq",
    _LSQ
    + """SELECT l.event_type, l.mc, round(-sl, 6) AS b_value,
  round(sqrt(ssr / greatest(n_bins - 2, 1)) / sqrt(sxx), 8) AS b_uncertainty, round(ic, 6) AS a_value,
  l.n_events, n_bins, round(mle.mean_magnitude, 6) AS mean_magnitude
FROM line l JOIN ssr ON ssr.event_type = l.event_type JOIN mle ON mle.event_type = l.event_type""",
)
def bvalue_lsq(spark, d):
    got = C.b_value_lsq(catalog(spark, d), group_cols=BY_TYPE)
    return rounded(rounded(got, 6, "b_value", "a_value", "mean_magnitude"), 8, "b_uncertainty")


@query(
    "gr_fit",
    _FMD
    + """SELECT f.event_type, f.mag_bin, f.n, f.n_cum, round(pow(10e0, a - b * f.mag_bin), 4) AS n_fit
FROM fmd f JOIN mle ON mle.event_type = f.event_type WHERE f.mag_bin >= mle.mc - 5e-2""",
)
def gr_fit(spark, d):
    return rounded(C.gr_fit(catalog(spark, d), group_cols=BY_TYPE), 4, "n_fit")


# The same statistics for orders: prices as magnitudes, a second and larger catalog.
@query(
    "fmd_orders",
    """WITH o AS (SELECT o_orderpriority, log10(o_totalprice) AS m FROM orders),
lim AS (SELECT o_orderpriority, CAST(floor(min(m) / 1e-1) AS BIGINT) AS k0,
               CAST(ceil(max(m) / 1e-1) AS BIGINT) AS k1 FROM o GROUP BY o_orderpriority),
grid AS (SELECT o_orderpriority, round(k * 1e-1, 10) AS mag_bin
         FROM (SELECT o_orderpriority, unnest(range(k0, k1 + 1)) AS k FROM lim))
SELECT g.o_orderpriority, mag_bin, count(*) FILTER (WHERE m >= mag_bin - 5e-2 AND m < mag_bin + 5e-2) AS n,
       count(*) FILTER (WHERE m >= mag_bin - 5e-2) AS n_cum
FROM grid g JOIN o ON o.o_orderpriority = g.o_orderpriority GROUP BY g.o_orderpriority, mag_bin""",
)
def fmd_orders(spark, d):
    orders = table(spark, d, "orders").select("o_orderpriority", F.log10("o_totalprice").alias("magnitude"))
    return C.frequency_magnitude(orders, group_cols=["o_orderpriority"])


_RATE = f"""WITH {CATALOG_SQL},
span AS (SELECT event_type, min(epoch_us(time)) AS t0,
                CAST(greatest(floor(greatest((max(epoch_us(time)) - min(epoch_us(time))) / 3.6e9, 24e0) / 24e0), 1) AS BIGINT) AS nb
         FROM cat GROUP BY event_type),
cnt AS (SELECT c.event_type, least(CAST(floor((epoch_us(time) - t0) / 3.6e9 / 24e0) AS BIGINT), nb - 1) AS bin, count(*) AS n
        FROM cat c JOIN span s ON s.event_type = c.event_type GROUP BY 1, 2),
grid AS (SELECT event_type, t0, unnest(range(nb)) AS bin FROM span),
rate AS (SELECT g.event_type, g.bin, make_timestamp(g.t0 + g.bin * 86400000000) AS bin_start,
                make_timestamp(g.t0 + g.bin * 86400000000 + 43200000000) AS bin_centre, coalesce(c.n, 0) AS n
         FROM grid g LEFT JOIN cnt c ON c.event_type = g.event_type AND c.bin = g.bin)
"""


@query(
    "rate_24h",
    _RATE
    + """SELECT event_type, bin, bin_start, bin_centre, n,
  CAST(sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS BIGINT) AS n_cum FROM rate""",
)
def rate_24h(spark, d):
    got = C.seismicity_rate(catalog(spark, d), 24.0, BY_TYPE)
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bin_start", "bin_centre")})


@query(
    "cumulative_events",
    f"""WITH {CATALOG_SQL} SELECT event_id, time, magnitude,
  row_number() OVER (ORDER BY time, event_id) AS n_cum FROM cat""",
)
def cumulative_events(spark, d):
    return C.cumulative_events(catalog(spark, d), ties=["event_id"]).select("event_id", "time", "magnitude", "n_cum")


@query(
    "value_hist30",
    """WITH lim AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30e0 AS st FROM events),
e AS (SELECT k AS bin, lo + k * st AS bin_low, CASE WHEN k = 29 THEN hi ELSE lo + (k + 1) * st END AS bin_high
      FROM lim, (SELECT unnest(range(30)) AS k))
SELECT bin, round(bin_low, 9) AS bin_low, round(bin_high, 9) AS bin_high,
       (SELECT count(*) FROM events WHERE value >= bin_low AND (value < bin_high OR (bin = 29 AND value = bin_high))) AS n
FROM e""",
)
def value_hist30(spark, d):
    got = C.value_histogram(table(spark, d, "events"), "value", 30)
    return rounded(got, 9, "bin_low", "bin_high")


@query(
    "depth_hist_by_type",
    f"""WITH {CATALOG_SQL}, e AS (SELECT k AS bin, k * 13e-1 AS lo, (k + 1) * 13e-1 AS hi FROM (SELECT unnest(range(30)) AS k)),
g AS (SELECT DISTINCT event_type FROM cat)
SELECT g.event_type, bin, (SELECT count(*) FROM cat c WHERE c.event_type = g.event_type
   AND least(CAST(floor((depth - 0e0) / 39e0 * 30e0) AS BIGINT), 29) = bin) AS n FROM g, e""",
)
def depth_hist_by_type(spark, d):
    return C.value_histogram(catalog(spark, d), "depth", 30, BY_TYPE).select("event_type", "bin", "n")


@query(
    "catalog_summary",
    f"""WITH {CATALOG_SQL} SELECT event_type, greatest(count(time), count(magnitude)) AS n_records,
  min(time) AS time_min, max(time) AS time_max, min(magnitude) AS magnitude_min, max(magnitude) AS magnitude_max,
  min(longitude) AS longitude_min, max(longitude) AS longitude_max, min(latitude) AS latitude_min,
  max(latitude) AS latitude_max, min(depth) AS depth_min, max(depth) AS depth_max FROM cat GROUP BY event_type""",
)
def catalog_summary(spark, d):
    return C.summary(catalog(spark, d), BY_TYPE)


@query("phase_counts", "SELECT event_type AS phase, count(*) AS n FROM events GROUP BY event_type")
def phase_counts(spark, d):
    return C.phase_counts(table(spark, d, "events").select(F.col("event_type").alias("phase")))


@query(
    "catalog_preview",
    f"""WITH {CATALOG_SQL} SELECT count(*) AS n_events, round(min(magnitude), 2) AS magnitude_min,
  round(max(magnitude), 2) AS magnitude_max, round(min(depth), 1) AS depth_min, round(max(depth), 1) AS depth_max,
  round(min(longitude), 3) AS longitude_min, round(max(longitude), 3) AS longitude_max,
  round(min(latitude), 3) AS latitude_min, round(max(latitude), 3) AS latitude_max FROM cat""",
)
def catalog_preview(spark, d):
    return C.preview_summary(catalog(spark, d))


@query("catalog_head20", f"WITH {CATALOG_SQL} SELECT * FROM cat ORDER BY time, event_id LIMIT 20")
def catalog_head20(spark, d):
    return C.preview_rows(catalog(spark, d), 20, ["time", "event_id"])


@query(
    "marker_size",
    f"""WITH {CATALOG_SQL}, lo AS (SELECT event_type, min(magnitude) AS m0 FROM cat GROUP BY event_type)
SELECT event_id, round(greatest(5e0, least(300e0, 10 * pow(2e0, magnitude - m0))), 6) AS size,
  round((magnitude * 3) * (magnitude * 3), 6) AS size_square FROM cat JOIN lo ON lo.event_type = cat.event_type""",
)
def marker_size(spark, d):
    got = C.marker_size(catalog(spark, d), BY_TYPE).select("event_id", "size", "size_square")
    return rounded(got, 6, "size", "size_square")


@query("complete_part", f"WITH {CATALOG_SQL} SELECT * FROM cat WHERE magnitude >= 3e-1 - 5e-2")
def complete_part(spark, d):
    return C.complete_part(catalog(spark, d), 0.3)


@query(
    "above_mc",
    f"""WITH {CATALOG_SQL} SELECT event_id, time, magnitude, event_type, user_id, longitude AS lon, latitude AS lat, depth
FROM cat WHERE magnitude >= 5e-1""",
)
def above_mc(spark, d):
    return C.above_mc(catalog(spark, d), 0.5)


@query(
    "bbox_filter",
    f"WITH {CATALOG_SQL} SELECT * FROM cat WHERE longitude BETWEEN 102 AND 106 AND latitude BETWEEN 27 AND 31",
)
def bbox_filter(spark, d):
    return C.in_region(catalog(spark, d), (102.0, 106.0, 27.0, 31.0))


@query("depth_slice", f"WITH {CATALOG_SQL} SELECT * FROM cat WHERE abs(depth - 10) < 2")
def depth_slice(spark, d):
    return C.depth_slice(catalog(spark, d), 10.0)


@query(
    "profile_projection",
    f"""WITH {CATALOG_SQL}, u AS (SELECT 6e0 / sqrt(136e0) AS ux, 10e0 / sqrt(136e0) AS uy),
p AS (SELECT event_id, depth, magnitude, ((longitude - 104) * ux + (latitude - 25) * uy) * 111 AS along_km,
             ((longitude - 104) * (-uy) + (latitude - 25) * ux) * 111 AS across_km FROM cat, u)
SELECT event_id, depth, magnitude, round(along_km, 6) AS along_km, round(across_km, 6) AS across_km
FROM p WHERE abs(across_km) <= 50""",
)
def profile_projection(spark, d):
    got = C.profile(catalog(spark, d), (104.0, 25.0), (110.0, 35.0))
    return rounded(got, 6, "along_km", "across_km").select("event_id", "depth", "magnitude", "along_km", "across_km")


@query(
    "epicentral_km",
    f"""WITH {CATALOG_SQL} SELECT event_id, round(2 * 6371e0 * asin(sqrt(least(1e0,
  sin(radians(latitude - 30) / 2) * sin(radians(latitude - 30) / 2)
  + cos(radians(30e0)) * cos(radians(latitude)) * sin(radians(longitude - 105) / 2) * sin(radians(longitude - 105) / 2)))), 5)
  AS epicentral_km FROM cat""",
)
def epicentral_km(spark, d):
    got = C.with_epicentral_distance(catalog(spark, d), 105.0, 30.0)
    return rounded(got, 5, "epicentral_km").select("event_id", "epicentral_km")


@query("magnitude_time_series", f"WITH {CATALOG_SQL} SELECT time, magnitude, depth FROM cat")
def magnitude_time_series(spark, d):
    return C.time_series(catalog(spark, d))


@query(
    "nearest_fault",
    f"""WITH {CATALOG_SQL}, seg AS (
  SELECT n_nationkey AS segment_id, 100 + (n_nationkey % 5) * 2e0 AS lon1, 25 + n_nationkey / 5e0 AS lat1,
         100 + (n_nationkey % 5) * 2e0 + 15e-1 AS lon2, 25 + n_nationkey / 5e0 + 2e0 AS lat2 FROM nation),
v AS (SELECT event_id, segment_id, (lon1 - longitude) * cos(radians(latitude)) AS ax, lat1 - latitude AS ay,
             (lon2 - longitude) * cos(radians(latitude)) AS bx, lat2 - latitude AS by_ FROM cat, seg),
t AS (SELECT *, greatest(0e0, least(1e0, -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM v),
k AS (SELECT event_id, segment_id, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) * 111 AS km FROM t)
SELECT event_id, round(min(km), 6) AS fault_km, CAST(arg_min(segment_id, (km, segment_id)) AS BIGINT) AS segment_id FROM k GROUP BY event_id""",
)
def nearest_fault(spark, d):
    n = F.col("n_nationkey")
    segments = table(spark, d, "nation").select(
        n.cast("long").alias("segment_id"),
        (100 + (n % 5) * 2.0).alias("lon1"),
        (25 + n / 5.0).alias("lat1"),
        (100 + (n % 5) * 2.0 + 1.5).alias("lon2"),
        (25 + n / 5.0 + 2.0).alias("lat2"),
    )
    return rounded(C.nearest_fault(spread(catalog(spark, d), "event_id"), segments), 6, "fault_km")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_partkey", "l_linenumber"]


@query(
    "profile_numeric",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n_values, round(CAST(min({c}) AS DOUBLE), 4) AS min_value, "
        f"round(CAST(max({c}) AS DOUBLE), 4) AS max_value, round(avg({c}), 4) AS mean_value, "
        f"count(DISTINCT {c}) AS n_unique FROM lineitem"
        for c in _NUM
    ),
)
def profile_numeric(spark, d):
    return profiling.numeric_profile(table(spark, d, "lineitem").select(*_NUM))


@query("table_shape", "SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns, 'n_nationkey:int, n_name:string, n_regionkey:int' AS columns FROM nation")
def table_shape(spark, d):
    return profiling.table_shape(table(spark, d, "nation"))
