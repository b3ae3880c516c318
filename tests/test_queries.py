"""Every named query beside its SQL twin, or at least run to the end."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import compare, duck
from quakelake.session import apply_settings

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    result, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir)
    assert result.startswith(("ok", "rows-only")), result


def test_entry(spark):
    assert {r["event_type"] for r in entry.entry(spark).collect()}


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_shuffles_start_with_many_partitions(spark):
    """A task's share stays small when the input grows; sessions that ask for more keep theirs."""
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    other = spark.newSession()
    other.conf.unset(initial)
    assert int(apply_settings(other).conf.get(initial)) >= 512
    other.conf.set(initial, "2000")
    assert apply_settings(other).conf.get(initial) == "2000"


def test_file_metadata_of_odd_documents(spark, tmp_path):
    """Ends of lines other than newlines, empty and null texts, null sources and sources with an extension."""
    texts = ["", "\n", "a\n", "a\n\n", "a\rb", "a\r\nb", "a\x0bb\x0cc", "a\x1cb\x85c\u2028d", None]
    places = [(s, t) for s in ("src0", None, "a.MD/b") for t in texts]
    rows = [(10 * n + i, t, s) for n, (s, t) in enumerate(places) for i in range(3)] + [(None, "a", "src0"), (-4, "a\rb", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    twin = duckdb.connect()
    twin.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result, _ = compare(spark, twin, "file_metadata", QUERIES["file_metadata"], SQL["file_metadata"], str(tmp_path))
    assert result == f"ok n={sum(i is not None and i % 3 != 0 for i, _, _ in rows)}"
