"""Streaming queries, drained over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakelake.operators import evidence as E
from quakelake.plans.inputs import PICKS_SQL
from quakelake.plans.registry import query
from quakelake.plans.text_plans import _CHUNKS, _EVIDENCE
from quakelake.streaming import jobs


@query(
    "stream_rate",
    """WITH w AS (SELECT time_bucket(INTERVAL 24 HOURS, ts, TIMESTAMP '1970-01-01') AS bin_start, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT bin_start, bin_start + INTERVAL 24 HOURS AS bin_end, event_type, n FROM w""",
)
def stream_rate(spark, d):
    """All windows: after the end of the input the watermark passes those still open."""
    events = jobs.table_stream(spark, d, "events.parquet").select(F.col("ts").cast("timestamp").alias("time"), "event_type")
    rate = lambda rows: jobs.rolling_rate(rows, keys=["event_type"])
    got = jobs.run_to_end(events, "time", rate, jobs.work_folder(spark, "rate"))
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bin_start", "bin_end")})


@query(
    "stream_pick_sessions",
    f"""WITH {PICKS_SQL},
f AS (SELECT *, CASE WHEN abs_time - lag(abs_time) OVER (PARTITION BY station ORDER BY abs_time) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS st FROM pick),
g AS (SELECT *, sum(st) OVER (PARTITION BY station ORDER BY abs_time) AS grp FROM f)
SELECT station, min(abs_time) AS first, count(*) AS n_phases, count(*) FILTER (WHERE phase LIKE 'P%') AS n_p, count(*) FILTER (WHERE phase LIKE 'S%') AS n_s
FROM g GROUP BY station, grp HAVING count(*) >= 2""",
)
def stream_pick_sessions(spark, d):
    events = jobs.table_stream(spark, d, "events.parquet")
    phase = (
        F.when(F.col("event_type") == "click", "Pg").when(F.col("event_type") == "view", "Sg")
        .when(F.col("event_type") == "purchase", "Pn").when(F.col("event_type") == "signup", "Sn").otherwise("P")
    )
    station = F.concat(F.lit("X"), (F.col("user_id") % 7).cast("string"), F.lit(".S"), F.col("user_id").cast("string"))
    picks = events.select(phase.alias("phase"), station.alias("station"), F.col("ts").cast("timestamp").alias("abs_time"))
    sessions = lambda rows: jobs.pick_sessions(rows, "2 hours", ["station"], min_phases=2)
    got = jobs.run_to_end(picks, "abs_time", sessions, jobs.work_folder(spark, "sessions"))
    return got.withColumn("first", F.col("first").cast("timestamp_ntz"))


@query(
    "stream_observations",
    """SELECT DISTINCT md5(event_type || ' seen at ' || CAST(user_id AS VARCHAR)) AS obs_key FROM events""",
)
def stream_observations(spark, d):
    events = jobs.table_stream(spark, d, "events.parquet").select(
        F.col("ts").cast("timestamp").alias("time"),
        F.concat("event_type", F.lit(" seen at "), F.col("user_id").cast("string")).alias("observation"),
    )
    return jobs.run_available(
        jobs.new_observations(events, "time", "60 days").select("obs_key"), jobs.work_folder(spark, "observations")
    )


@query("stream_index", _CHUNKS + "SELECT chunk_id, doc_id, page, chunk_no, text FROM chunk")
def stream_index(spark, d):
    folder = jobs.work_folder(spark, "index")
    docs = jobs.table_stream(spark, d, "documents.parquet").select("doc_id", "text")
    return jobs.index_documents(docs, f"{folder}/store", folder)[1]


@query("stream_evidence", _EVIDENCE + "SELECT obs_key, seq, evidence_id FROM f")
def stream_evidence(spark, d):
    folder = jobs.work_folder(spark, "evidence")
    arriving = jobs.table_stream(spark, d, "documents.parquet").select(
        F.col("doc_id").alias("seq"),
        E.evidence_id(F.col("doc_id").cast("string"), F.col("text")).alias("evidence_id"),
        F.col("text").alias("observation"),
    )
    return jobs.merge_evidence(arriving, f"{folder}/store", folder).select("obs_key", "seq", "evidence_id")
