"""The pipeline's stages on one small table beside plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quakelake.llm import common, mixing, sentencepiece, toxicity
from quakelake.llm.common import stored
from test_llm_operators import ascii_lower, brute_near, docs


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before and after each stage, over the given documents and a few odd ones."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs(spark, [(90_001, None, "s"), (90_002, "", None), (90_003, "Twice", "s"), (90_003, "Twice", "s"), (None, "twice", None), (90_004, "  ", "s")])
    now = stored(given.unionByName(odd.select(*given.columns)), "t")
    out = [now.collect()]
    for _, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, sf_dir), "t")
        out.append(now.collect())
    return given.columns, out


def pairs(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_columns_and_rows_shrink(stages):
    columns, out = stages
    for rows in out[1:5]:
        assert rows and list(rows[0].asDict()) == columns
    assert list(out[5][0].asDict()) == [*columns, "piece_ids"]


def test_toxicity_stage(spark, sf_dir, stages):
    before, after = stages[1][0], stages[1][1]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")
    model = toxicity.fit_on_tables(df, sf_dir)
    want = Counter((r["doc_id"], r["text"]) for r in before if model.score((r["text"] or "").encode()) < toxicity.THRESHOLD)
    assert pairs(after) == want


def test_exact_stage(stages):
    before, after = stages[1][1], stages[1][2]
    best = {}
    for r in before:
        key = ascii_lower(r["text"])
        best[key] = max(best.get(key, -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert Counter((r["doc_id"], ascii_lower(r["text"])) for r in after) == Counter((i if i >= 0 else None, t) for t, i in best.items())


def test_full_filter_drops_no_unique_document(spark, monkeypatch):
    """With a filter of one bit every row is unsure, as some are on large inputs."""
    monkeypatch.setattr(common, "FILTER_BITS", 1)
    rows = [(1, "one text", "s"), (2, "ONE text", "s"), (3, "another text", "s"), (4, None, "s"), (None, "no id", "s"), (6, "six", "s"), (6, "six", "s")]
    stayed = corpus_pipeline.exact_dedup(spark, docs(spark, rows), "").collect()
    assert pairs(stayed) == Counter([(2, "ONE text"), (3, "another text"), (4, None), (None, "no id"), (6, "six")])
    stayed = corpus_pipeline.near_dedup(spark, docs(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "u v w x y z", "s")]), "").collect()
    assert pairs(stayed) == Counter([(1, "a b c d e f"), (3, "u v w x y z")])


def test_near_stage(stages):
    before, after = stages[1][2], stages[1][3]
    found = brute_near([(r["doc_id"], r["text"], None) for r in before], 5)
    assert Counter(r["doc_id"] for r in after) == Counter(i for i, k in found.items() if i == k)


def test_mixing_stage(spark, stages):
    before, after = stages[1][3], stages[1][4]
    df = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix_sources(df).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in after) == want
    assert set(pairs(after)) <= set(pairs(before))


def test_pieces_stage(stages):
    import sentencepiece as library

    before, after = stages[1][4], stages[1][5]
    assert pairs(before) == pairs(after)
    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    assert all(r["piece_ids"] == model.encode(r["text"] or "") for r in after[:150])


def test_run_and_empty_documents(spark, sf_dir, tmp_path):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given.filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_labels_are_learnt_from_two_thirds_only(spark):
    ids = spark.range(300).withColumn("h", toxicity.held_out(F.col("id")))
    assert 60 < ids.filter("h").count() < 140
