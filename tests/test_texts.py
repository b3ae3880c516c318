import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quakelake.functions import text as X
from quakelake.operators import chat
from quakelake.operators import documents as D
from quakelake.operators import evidence as E
from quakelake.operators import retrieval as R


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).head()["r"]


def packed(text, size=500, overlap=50):
    """Greedy packing stated over the list of sentences."""
    done, held = [], ""
    for piece in filter(None, (p.strip() for p in re.split(r"\n{2,}|(?<=[。！？.!?])\s", text))):
        if len(held) + len(piece) <= size:
            held = f"{held} {piece}".strip()
            continue
        done += [held] if held else []
        n = max(0, -(-(len(piece) - size) // (size - overlap)))
        done += [piece[i * (size - overlap) :][:size] for i in range(n)]
        held = piece[n * (size - overlap) :]
    return [c for c in [*done, held] if c.strip()]


SAMPLES = [
    "x" * 1200,
    "y" * 950 + ". " + "tail of ten",
    "短句一。 " * 60 + "尾巴" + "\n\n" + "z" * 501,
    " ".join(f"Short sentence number {i}." for i in range(40)) + "\n\n" + "\n\n".join(["Paragraph " * 5] * 20),
    "A\x85B. \x1cC! D" * 50,
    "",
]


@pytest.mark.parametrize("text", SAMPLES)
@pytest.mark.parametrize("size,overlap", [(500, 50), (200, 30)])
def test_chunks_match_brute_force(spark, text, size, overlap):
    got = one(spark, text, lambda c: X.chunks(c, size, overlap))
    assert got == packed(text, size, overlap)
    assert all(len(c) <= size + 1 for c in got)


def test_chunks_of_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    for row in docs.select("text", X.chunks(F.col("text")).alias("c")).collect():
        assert row["c"] == packed(row["text"])


def test_long_sentence_is_cut_twice(spark):
    assert [len(c) for c in one(spark, "x" * 1200, X.chunks)] == [500, 500, 300]


def test_tokens(spark):
    assert one(spark, "SVM方法 a-b 地震 x1", X.tokens) == ["svm", "方法", "地震", "x1"]
    assert one(spark, "b-value 地 震!学", X.fine_tokens) == ["b-value", "地", "震", "学", "地震", "震学"]
    long = [one(spark, t, X.long_enough) for t in ("ab", "abc", "地", "地震", "a地")]
    assert long == [False, True, False, True, False]


def test_markdown_sections(spark):
    text = "intro\n# Section 1\nbody\n## Section 2\n### deeper\nend\n"
    assert one(spark, text, X.markdown_sections) == ["intro", "# Section 1\nbody", "## Section 2\n### deeper\nend"]
    assert one(spark, "##\nno heading", X.markdown_sections) == ["##\nno heading"]


def test_text_pages(spark):
    paras = ["a" * 1500, "b" * 600, "c" * 1400, "d" * 2500]
    assert one(spark, "\n\n\n\n".join(paras), X.text_pages) == [paras[0], f"{paras[1]}\n\n{paras[2]}", paras[3]]


def test_paper_sections_carry_their_own_level(spark):
    text = "front\n1. Introduction\nhello\n2.1 Data and Methods\nworld\nCONCLUSIONS\nend"
    got = [tuple(s) for s in one(spark, text, X.paper_sections)]
    assert got == [("Preamble", "front", 1), ("1. Introduction", "hello", 1), ("2.1 Data and Methods", "world", 2), ("CONCLUSIONS", "end", 1)]
    assert one(spark, "", X.paper_sections)[0]["title"] == "Full Text"


def test_papers_without_sections_have_none_on_request(spark):
    docs = spark.createDataFrame([(1, "CONCLUSIONS\n2.1 Mention and Methods"), (2, ""), (3, None), (4, "a\nCONCLUSIONS\nb")], "doc_id long, text string")
    cut = D.paper_sections(docs, whole=False)
    assert sorted(tuple(r)[:4] for r in cut.collect()) == [(4, 0, "Preamble", "a"), (4, 1, "CONCLUSIONS", "b")]
    assert D.paper_search(cut, "tion ment").count() == 0


def test_html_hides_furniture_and_splits_at_headings(spark):
    page = (
        "<html><head><meta charset='utf-8'><style>p{}</style></head><body><nav><ul><li>menu<nav>sub</nav></li></ul></nav>"
        "<p>before</p><h2>One</h2><p>first <b>part</b></p><script>var t='</p>';</script><h2>Two</h2><p>second</p><footer>f</footer></body></html>"
    )
    df = spark.createDataFrame([(1, page), (2, "<script>x</script>")], "page_id long, html string")
    rows = D.html_sections(df).orderBy("page_id", "page").collect()
    texts = [" ".join(r["text"].split()) for r in rows]
    assert texts == ["before", "One first part", "Two second", ""]


def test_html_pages_keep_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = D.html_sections(pages).groupBy("page_id").agg(F.sum(F.length("text")).alias("n")).collect()
    assert len(rows) == pages.count() and min(r["n"] for r in rows) > 0


def test_html_characters_and_stray_tags(spark):
    page = "</nav><p>a &#233;&#x4E2D; &lt;b&gt; &amp;lt; 1 < 2</p><NAV>x<nav>y</nav>z</NAV><!-- <p>no</p> --><pre>end<script>never closed"
    df = spark.createDataFrame([(1, page), (1, page), (2, ""), (3, None)], "page_id long, html string")
    rows = [(r["page_id"], " ".join(r["text"].split())) for r in D.html_sections(df).orderBy("page_id").collect()]
    assert rows == [(1, "a é中 <b> &lt; 1 < 2 end")] * 2 + [(2, "")]


def test_rst_sections(spark):
    text = "Title\n=====\n\nSee :ref:`the label` and ``code``.\n\n.. note::\n   hidden\n\n   more\nShown\n\nNext\n----\nbody"
    assert one(spark, text, D.rst_section_texts) == ["Title\n\nSee the label and code.\n\nShown", "Next\nbody"]
    assert one(spark, "Long title\n===\nx", D.rst_section_texts) == ["Long title\n===\nx"]
    assert one(spark, "  indented\n.. gone\n\n  gone\nkept", D.rst_section_texts) == ["indented\nkept"]
    assert one(spark, "===\n===\n===\nx", D.rst_section_texts) == ["===\n===\nx"]
    assert one(spark, " ", D.rst_section_texts) == [""]


def test_rst_sections_cut_lines_once(spark, sf_dir):
    """Lines are cut in one place of the plan; the rows are those of the expression."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace("text", r"[.] ", ".\n=====================================\n").alias("text"))
    made = spark.createDataFrame([(-1, "A b\n===\n.. x::\n   gone\n``c`` :r:`d`\r\n"), (-2, ""), (-3, None), (-4, "T\n***\n\n")], "doc_id long, text string")
    df = base.unionByName(made)
    got = D.rst_sections(df)
    want = df.filter("text is not null").select("doc_id", F.posexplode(D.rst_section_texts(F.col("text"))).alias("page", "text"))
    assert sorted((r["doc_id"], r["page"], r["text"]) for r in got.collect()) == sorted((r["doc_id"], r["page"], r["text"]) for r in want.collect())
    plan = D.rst_sections(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1


def test_sliding_windows_cover_the_text(spark):
    text = " ".join(f"word{i}." if i % 7 == 0 else f"word{i}" for i in range(400))
    pieces = one(spark, text, D.sliding_window_texts)
    assert pieces[0].startswith("word0.") and pieces[-1].endswith("word399.")
    assert all(20 < len(p) <= 500 for p in pieces)
    for a, b in zip(pieces, pieces[1:]):
        assert b[:10] in a
    assert one(spark, "short", D.sliding_window_texts) == ["short"]
    assert one(spark, "short", lambda c: D.sliding_window_texts(c, shortest=21)) == []
    assert one(spark, "", D.sliding_window_texts) == []


def test_wide_space_opens_a_heading(spark):
    assert one(spark, "a\n#\u3000b\n##\n# c", X.markdown_sections) == ["a", "#\u3000b\n##", "# c"]


def test_model_patterns_in_order(spark):
    text = "use phasenet on data.v2 files"
    assert one(spark, text, X.entities)["model"] is None
    assert one(spark, text, lambda c: X.entities(c, [r"(net\d)", r"(phase\w+)", r"(\w+\.v\d)"]))["model"] == "phasenet"


def test_references(spark):
    text = "Body\nReferences\n[1] Smith, J. A study of faults 2001\n12 Other entry with number\nBrown, K. Another long entry here\nplain line that is long enough\nshort"
    got = one(spark, text, lambda c: X.reference_entries(c, shortest=21))
    assert one(spark, text, X.reference_entries) == got
    assert got == ["[1] Smith, J. A study of faults 2001", "12 Other entry with number", "Brown, K. Another long entry here"]
    assert one(spark, "none", X.reference_entries) == []


def test_metadata_and_source_kinds(spark):
    m = one(spark, "Published 2019. doi.org/10.1029/2018JB016. arXiv: 2101.01234", X.paper_metadata)
    assert (m["year"], m["doi"], m["arxiv_id"]) == ("2019", "10.1029/2018JB016", "2101.01234")
    for text, kind in [("2101.01234", "arxiv"), ("https://arxiv.org/abs/2101.01234", "arxiv"), ("10.1029/x", "doi"), ("https://doi.org/10.1/x", "doi"), ("a/b.pdf", "pdf"), ("http://x/y.pdf", "pdf"), ("http://x/y", "url"), ("hello", "text")]:
        assert one(spark, text, X.source_kind) == kind


@pytest.mark.parametrize(
    "text,paths,stations",
    [
        ("帮我看看/data/seis/目录中的文件", ["/data/seis/"], []),
        ("pick X1.53085 in ./waves/a.sac, now", ["./waves/a.sac"], ["X1.53085", "A.SAC"]),
        ("台站XJ.KAS01拾取", [], ["XJ.KAS01"]),
        ("no mention", [], []),
    ],
)
def test_entities(spark, text, paths, stations):
    got = one(spark, text, X.entities)
    assert got["file_paths"] == paths
    assert got["stations"] == stations
    pattern = re.compile(r"(?<![A-Za-z0-9])([A-Z0-9]{1,3})\.([A-Z0-9]{3,7})(?![A-Za-z0-9])", re.I)
    assert got["stations"] == [f"{a}.{b}".upper() for a, b in pattern.findall(text)]


def test_station_mentions_match_python(spark, sf_dir):
    pattern = re.compile(r"(?<![A-Za-z0-9])([A-Z0-9]{1,3})\.([A-Z0-9]{3,7})(?![A-Za-z0-9])", re.I)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for row in docs.select("text", X.entities(F.col("text"))["stations"].alias("s")).collect():
        assert row["s"] == [f"{a}.{b}".upper() for a, b in pattern.findall(row["text"])]


def test_labels_take_first_rule_on_ties(spark):
    rules = [("pick", ["拾取", "pick"], [r"拾取.*震相"]), ("stats", ["pick", "b值"], [])]
    df = spark.createDataFrame([("拾取所有震相",), ("pick",), ("hello",), ("b值",)], "text string")
    got = {r["text"]: (r["label"], r["confidence"]) for r in chat.label_messages(df, rules).collect()}
    assert got == {"拾取所有震相": ("pick", 0.6), "pick": ("pick", 0.2), "hello": ("unknown", 0.0), "b值": ("stats", 0.2)}


# --- evidence -----------------------------------------------------------------------------------


def evidence(spark, rows):
    return spark.createDataFrame(rows, "seq long, evidence_id string, observation string, geological_structure string, interpretation string, source string, data_type string, confidence string")


ROWS = [
    (1, "a", "x" * 80 + "one", "Fault A", "thrust", "s|1", "t", "high"),
    (2, "b", "x" * 80 + "two", "fault a ", "normal", "s", "t", "low"),
    (3, "c", "other", "Fault A", "thrust", "s", "t", "low"),
    (4, "d", "more", "unspecified", "z", "s", "t", "low"),
    (5, "e", "last|bar", "Basin", "z", "s", "t", "low"),
]


def test_evidence_dedup_and_idempotence(spark):
    table = evidence(spark, ROWS)
    first = E.new_evidence(table, None)
    # Observations that part after a long common opening are two.
    assert sorted(r["seq"] for r in first.collect()) == [1, 2, 3, 4, 5]
    assert E.new_evidence(table.union(table), None).count() == 5
    assert E.new_evidence(table, table).count() == 0


def test_conflicts_are_symmetric_and_complete(spark):
    flagged = E.flag_conflicts(evidence(spark, ROWS))
    assert {r["evidence_id"]: r["n_conflicts"] for r in flagged.collect()} == {"a": 2, "b": 2, "c": 2, "d": 0, "e": 0}
    pairs = {tuple(r) for r in E.conflicts_of(flagged, flagged).collect()}
    assert pairs == {(b, a) for a, b in pairs} and len(pairs) == 6


@pytest.mark.parametrize("few", [100, 1])
def test_conflict_pairs_come_once_and_are_not_shuffled(spark, monkeypatch, few):
    monkeypatch.setattr(E, "SMALL_ROWS", few)
    rows = [("a", "k"), ("a", "m"), ("b", "k"), ("b", "m"), ("b", "m"), ("c", "m"), ("d", None), ("e", "z")]
    flagged = spark.createDataFrame(rows, "evidence_id string, conflict_key string")
    got = E.conflicts_of(flagged, flagged.filter("evidence_id <> 'c'"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c")]
    above_join = got._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert "Exchange" not in above_join and "Aggregate" not in above_join


def test_markdown_replaces_bars(spark):
    rows = {r["evidence_id"]: r["markdown"] for r in E.markdown_rows(E.flag_conflicts(evidence(spark, ROWS))).collect()}
    assert "last∣bar" in rows["e"] and rows["e"].endswith("| — |")


def test_stop_test(spark):
    hyps = spark.createDataFrame([("h1", "active", "high"), ("h2", "rejected", "high")], "hypothesis_id string, status string, confidence string")
    assert E.stop_test(0, 1) is None
    assert E.stop_test(0, 2) == "no_new_evidence"
    assert E.stop_test(3, 2, hyps) == "hypothesis_convergence"
    assert E.stop_test(3, 2, hyps.withColumn("confidence", F.lit("low"))) is None


def test_model_output_without_json_is_dropped(spark):
    df = spark.createDataFrame([(1, "no json"), (2, '{"observation": "n/a"}'), (3, 'ok {"observation": "seen", "confidence": "high"}')], "chunk_id long, raw string")
    got = E.read_paper_output(df).collect()
    assert [(r["chunk_id"], r["observation"], r["confidence"], r["data_type"]) for r in got] == [(3, "seen", "high", "unspecified")]


# --- retrieval ----------------------------------------------------------------------------------


def test_tfidf_zero_scores_fill_in_order(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "beta beta beta"), (4, "zeta")], "doc_id long, text string")
    asked = spark.createDataFrame([("q1", "beta"), ("q2", "nothing here")], "query_id string, query string")
    got = R.tfidf_search(docs, asked, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [("q1", 3), ("q1", 1), ("q1", 2), ("q2", 1), ("q2", 2), ("q2", 3)]
    assert got[2]["score"] == 0.0
    stored = R.tfidf_search(docs, asked, 3, weights=R.tfidf_weights(docs)).orderBy("query_id", "rank").collect()
    assert stored == got


def test_terms_are_counted_in_arrow_and_weighted_after_the_shuffle(spark):
    texts = ["beta alpha beta, Beta", "", None, "a b", "地震 波形 地震 x1", "地震 zz"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for i, text in enumerate(texts):
        words = [w for w in re.findall(r"[a-z0-9]+|[一-鿿㐀-䶿]+", (text or "").lower()) if len(w) > 1]
        want += [(i, len(words), w, n) for w, n in Counter(words).items()]
    assert sorted(map(tuple, R.term_counts(docs).collect())) == sorted(want)
    assert "MapInArrow" in R.term_counts(docs)._jdf.queryExecution().executedPlan().toString()
    # What is dealt by document holds counts only.
    plan = R.tfidf_weights(docs)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression [doc_id") :]
    assert "ln(" not in below.lower() and "log(" not in below.lower()


def test_terms_cut_from_bytes_equal_the_token_column(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abzAZ09 .éß\u212a\u0130一鿿㐀䶿䷀ꀀ㏿😀") for _ in range(rnd.randint(0, 14))) for _ in range(600)]
    docs = spark.createDataFrame([*enumerate([*texts, "", None, "a", "一", "ab一二cd"])], "doc_id long, text string").repartition(3)
    want = Counter((r["doc_id"], len(r["t"]), w) for r in docs.select("doc_id", X.tokens(F.col("text")).alias("t")).collect() for w in r["t"] or [])
    got = R.term_counts(docs).collect()
    assert {(r["doc_id"], r["n_tokens"], r["term"]): r["tf"] for r in got} == want and len(got) == len(want)
    df = Counter(w for _, _, w in want)
    assert {r["term"]: r["df"] for r in R.document_frequency(docs).collect()} == df


@pytest.mark.parametrize(("frequent", "tile"), [(0, 1), (7, 200), (1_000, 4_000_000)])
def test_tfidf_search_joins_rare_terms_only_for_lengths(spark, monkeypatch, frequent, tile):
    """The same hits whatever travels with the tasks; terms that travel are not shuffled with their documents."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(words[: rnd.randint(1, 60)]) for _ in range(rnd.randint(0, 12))) for _ in range(150)]
    docs = spark.createDataFrame([(f"d{i:03}", t) for i, t in enumerate([*texts, *texts[:30], None])], "doc_id string, text string").repartition(4)
    asked = spark.createDataFrame([(i, " ".join(rnd.choice([*words, "none"]) for _ in range(4))) for i in range(12)] + [(12, None), (13, "none")], "query_id int, query string")
    want = R.tfidf_search(docs, asked, 4, weights=R.tfidf_weights(docs)).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(R, "FREQUENT_TERMS", frequent)
    monkeypatch.setattr(R, "TILE_SCORES", tile)
    found = R.tfidf_search(docs, asked, 4)
    assert found.orderBy("query_id", "rank").collect() == want and len(want) == 14 * 4
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow rest(" in plan and "MapInArrow score(" in plan and "MapInArrow count(" not in plan
    monkeypatch.setattr(R, "SMALL_ROWS", 3)
    assert R.tfidf_search(docs, asked, 4).orderBy("query_id", "rank").collect() == want


def test_vector_search_does_not_depend_on_layout(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = emb.limit(9).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    want = R.vector_topk(emb, asked, 5).orderBy("query_id", "rank").collect()
    assert all(r["chunk_id"] == r["query_id"] for r in want if r["rank"] == 1)
    for n in (1, 7):
        assert R.vector_topk(emb.repartition(n), asked, 5).orderBy("query_id", "rank").collect() == want
    blocks = R.vector_topk(emb, asked, 5, small_values=128, vectors_per_cell=60)
    assert blocks.orderBy("query_id", "rank").collect() == want


def test_vector_cells_grow_with_the_input(spark, sf_dir, monkeypatch):
    """Copies of a vector are bounded by a number, not by the number of queries."""
    assert R._blocks(9, 2, 1000) == 5 and R._blocks(10_000, 10, 1000) == R.COPIES and R._blocks(100_000, 10, 1000) == 100
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = emb.limit(40).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    want = R.vector_topk(emb, asked, 5).orderBy("query_id", "rank").collect()
    for copies, tile in ((3, 4_000_000), (100, 100)):
        monkeypatch.setattr(R, "COPIES", copies)
        got = R.vector_topk(emb, asked, 5, small_values=64, vectors_per_cell=10, tile_scores=tile)
        assert got.orderBy("query_id", "rank").collect() == want


def test_overlap_join_agrees_with_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scan = R.overlap_topk(docs, asked, 4, "doc_id").orderBy("query_id", "rank").collect()
    assert scan == R.overlap_topk(docs, asked, 4, "doc_id", max_queries=3).orderBy("query_id", "rank").collect()


def test_field_scores_by_hand_and_by_block(spark):
    catalog = spark.createDataFrame(
        [
            ("b_value", "estimate b value", ["b-value", "gutenberg"], "completeness magnitude", "builtin"),
            ("hvsr", "spectral ratio", ["site effect"], "spectral tools", "user"),
            ("none", "zzz", ["qqq"], "yyy", "builtin"),
        ],
        "name string, description string, keywords array<string>, body string, source string",
    )
    asked = spark.createDataFrame([(1, "compute the b-value and magnitude"), (2, "spectral site"), (3, "??")], "query_id long, query string")
    got = [tuple(r) for r in R.field_topk(catalog, asked, R.entry_score, 3).orderBy("query_id", "rank").collect()]
    # Query 1: keyword 5, "magnitude" in body 1. Query 2: token in keyword 3, description 2, body 1, user 1.
    assert got == [(1, 1, "b_value", 6), (2, 1, "hvsr", 7)]
    blocks = R.field_topk(catalog, asked, R.entry_score, 3, max_rows=1).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in blocks] == got


def test_budget_stops_at_first_overflow(spark):
    rows = [("q", 1, "a" * 400), ("q", 2, "b" * 900), ("q", 3, "c" * 10)]
    df = spark.createDataFrame(rows, "k string, rank int, text string")
    assert [r["rank"] for r in R.budget_pack(df, ["k"], "rank", "text", 1000).collect()] == [1]
    cut = R.budget_pack_cut(df, ["k"], "rank", "text", 1000, note="!").orderBy("rank").collect()
    assert [(r["rank"], len(r["text"])) for r in cut] == [(1, 400), (2, 581)]


def test_relevance_is_rounded_by_its_exact_value(spark):
    scores = [0.495, 0.485, 0.475, 0.505, 0.125, 0.375, 0.0, 1.0, 12345.678]
    df = spark.createDataFrame([(x,) for x in scores], "s double")
    got = [r[0] for r in df.select(R.passage(F.lit("n"), F.lit(0), F.col("s"), F.lit("t"))).collect()]
    assert got == [f"[Source: n, section 1, relevance {x:.2f}]\nt\n" for x in scores]


def test_related_entries_in_order(spark):
    catalog = spark.createDataFrame([("a", ["b", "x"]), ("b", []), ("c", ["a"]), ("d", ["a", "b"]), ("e", [])], "name string, related array<string>")
    hits = spark.createDataFrame([(1, 1, "a")], "query_id int, rank long, name string")
    got = R.related_entries(hits, catalog, 2).orderBy("rank").collect()
    assert [(r["name"], r["extra"]) for r in got] == [("a", False), ("b", True), ("c", True)]


def test_trimmed_history(spark):
    rows = [(1, i, r) for i, r in enumerate(["user", "assistant", "tool", "tool", "assistant", "user"])] + [(2, 0, "tool")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string")
    got = sorted((r["conv_id"], r["turn"]) for r in chat.trimmed_history(df, 4).collect())
    assert got == [(1, 4), (1, 5), (2, 0)]


def test_hashed_vectors_against_loop(spark):
    texts = ["The cat and the dog, the end", "", None, "x", "地震 波形 地震 abc abc abc"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["component"]): r["weight"] for r in R.hashed_vectors(docs, 16).collect()}
    want = {}
    for i, text in enumerate(texts):
        words = [w for w in re.findall(r"[a-z0-9]+|[一-鿿㐀-䶿]+", (text or "").lower()) if len(w) > 1]
        counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in words)
        length = math.sqrt(sum(n * n for n in counts.values()))
        want |= {(i, c): n / length for c, n in counts.items()}
    assert got == pytest.approx(want)
    assert "MapInArrow" in R.hashed_vectors(docs)._jdf.queryExecution().executedPlan().toString()
