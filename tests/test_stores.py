"""Stores cut into shares: null observations come once, and a batch reads the shares it touches."""

from pyspark.sql import functions as F

from quakelake.operators.evidence import new_evidence
from quakelake.streaming import jobs

SCHEMA = "seq long, observation string"


def test_null_observation_is_kept_once(spark):
    first = new_evidence(spark.createDataFrame([(2, None), (1, None), (3, "a")], SCHEMA), None)
    assert sorted((r["seq"], r["observation"]) for r in first.collect()) == [(1, None), (3, "a")]
    again = spark.createDataFrame([(4, None), (5, "b"), (6, "a")], SCHEMA)
    assert [r["seq"] for r in new_evidence(again, first).collect()] == [5]
    assert [r["seq"] for r in new_evidence(again, first.drop("obs_key")).collect()] == [5]


def test_store_over_runs(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(i, None if i % 10 == 0 else f"seen {i % 25}") for i in range(60)], SCHEMA).write.parquet(src)
    stream = lambda: jobs.table_stream(spark, src, "*.parquet")
    first = sorted(r["seq"] for r in jobs.merge_evidence(stream(), store, str(tmp_path / "one")).collect())
    want = sorted({(None if i % 10 == 0 else i % 25): i for i in range(59, -1, -1)}.values())
    assert first == want
    assert sorted(r["seq"] for r in jobs.merge_evidence(stream(), store, str(tmp_path / "two")).collect()) == want


def test_a_batch_reads_only_its_shares(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(i, f"seen {i}") for i in range(200)], SCHEMA).write.parquet(src)
    table = jobs.merge_evidence(jobs.table_stream(spark, src, "*.parquet"), store, str(tmp_path / "one"))
    asked = spark.createDataFrame([(900, "seen 7"), (901, "new")], SCHEMA)
    shares = jobs._touched(asked.select(jobs._share(F.md5("observation")).alias("share")))
    some = table.filter(F.col("share").isin(shares))
    assert 0 < len(shares) <= 2 and 0 < some.select("share").distinct().count() < table.select("share").distinct().count()
    assert [r["seq"] for r in new_evidence(asked, some).collect()] == [901]
    plan = some.select("obs_key")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(share" in plan or "PartitionFilters: [share" in plan


def test_empty_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    got = jobs.merge_evidence(jobs.table_stream(spark, src, "*.parquet"), str(tmp_path / "store"), str(tmp_path / "run"))
    assert got.count() == 0 and {"obs_key", "seq", "observation"} <= set(got.columns)


def test_streams_over_tables_of_one_file_and_of_part_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"seen {i}") for i in range(40)], SCHEMA)
    rows.repartition(3).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    rows.limit(1).write.parquet(str(tmp_path / "parts" / "labels.parquet"))
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "documents.parquet")
    for folder in ("parts", "one"):
        stream = jobs.table_stream(spark, str(tmp_path / folder), "documents.parquet")
        got = jobs.merge_evidence(stream, str(tmp_path / f"{folder}-store"), str(tmp_path / f"{folder}-run"))
        assert sorted(r["seq"] for r in got.collect()) == list(range(40))
        docs = stream.selectExpr("seq AS doc_id", "observation AS text")
        chunks = jobs.index_documents(docs, str(tmp_path / f"{folder}-index"), str(tmp_path / f"{folder}-indexing"))[1]
        assert sorted(r["doc_id"] for r in chunks.collect()) == list(range(40))
