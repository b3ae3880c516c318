"""The training-data operators on small rows: edge cases and brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakelake.llm import brown, exact_dedup, graph, minhash, mixing, preference, quality, sentencepiece, topk, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, `rank` string, score string, `a.b` int"


def docs(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, 1, "k", "i", "r", "s", 1) for i, t, s in rows], DOCS)


def ascii_lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# --- exact duplicates ---------------------------------------------------------------------------


def test_exact_duplicates(spark):
    long = "x" * 50_000
    rows = [(1, "Ab", "s"), (5, "aB", "s"), (2, "ÄB", "s"), (3, "äb", "s"), (4, None, "s"), (9, "", "s"), (None, "ab", "s"), (None, "only", "s")]
    rows += [(7, "again", "s")] * 3 + [(20, long + "a", "s"), (21, long + "b", "s"), (22, long.upper() + "A", "s")]
    got = exact_dedup.exact_duplicates(docs(spark, rows), carry=["source"]).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[ascii_lower(t)].append(i)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        mine = [r for r in got if r["keep_id"] == keep and r["doc_id"] in ids]
        assert {r["group_size"] for r in mine} == {len(ids)}
        assert sum(r["kept"] for r in mine) == 1
    assert [r["kept"] for r in by_id[7]].count(True) == 1
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


# --- components ---------------------------------------------------------------------------------


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["path", "random", "star"])
def test_components(spark, kind):
    rnd = random.Random(3)
    order = list(range(150))
    rnd.shuffle(order)
    edges = {
        "path": list(zip(order, order[1:])),
        "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)],
        "star": [(order[0], x) for x in order[1:]],
    }[kind]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges + [(5, 5), (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(df, "a", "b").collect()}
    assert got == components(edges)
    assert graph.connected_components(df.filter("a < 0"), "a", "b").count() == 0


# --- near duplicates ----------------------------------------------------------------------------


def shingles(text, width):
    w = ascii_lower(text).encode().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_near(rows, width):
    sets = {}
    for i, t, _ in rows:
        sets.setdefault(i, []).append(shingles(t, width))
    edges = []
    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for (i, a), (j, b) in combinations(flat, 2):
        if i != j and 100 * len(a & b) >= 80 * len(a | b):
            edges.append((i, j))
    found = components(edges)
    return {i: found.get(i, i) for i in sets}


def near_rows(seed=5):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for family in range(6):
        base = [rnd.choice(words) for _ in range(60 + 20 * family)]
        for copy in range(12):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((k, " ".join(text).upper() if copy % 2 else "\n".join(text), "s"))
            k += 1
    rows += [(900, "a b c", "s"), (901, "A  b\tc", "s"), (902, "a b", "s"), (903, None, "s"), (904, " \n", "s"), (905, "", "s")]
    rows += [(906, "same words here now again", "s")] * 2 + [(907, " ".join(words) * 40, "s"), (908, " ".join(words) * 40 + " x", "s")]
    return rows


@pytest.mark.parametrize("region,block", [(1_024, 256), (4, 5)])
def test_near_duplicates(spark, monkeypatch, region, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows()
    got = minhash.near_duplicates(docs(spark, rows), width=4).collect()
    assert len(got) == len(rows)
    want = brute_near(rows, 4)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    sizes = {i: len(shingles(t, 4)) for i, t, _ in rows}
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    # Crowded regions, cut again and again, still connect what belongs together.
    factors, masks = minhash._functions()
    sets = [minhash.shingle_set((t or "").encode(), 4) for i, t, _ in rows if i < 12]
    lows = np.array([minhash.signature(s, factors[:, None], masks) for s in sets])
    four = (lows >> np.uint32(7)).astype(np.uint8) & 15
    marks = np.ascontiguousarray(four[:, 0::2] * 16 + four[:, 1::2]).view(np.uint64)
    order = np.lexsort(lows[:, : minhash.DEPTH].T[::-1])
    monkeypatch.setattr(minhash, "REGION", region)
    edges = minhash.region_edges(lows[order][:, : minhash.DEPTH], order, marks[order], 0, 0)
    assert set(components(edges).values()) == {0}


@pytest.mark.parametrize("same", [minhash.DEPTH, minhash.SHALLOW])
def test_crowded_regions_compare_all_pairs(same):
    """Two rows alike, far apart in a crowd that shares all hashes or only the first three."""
    n = 3 * minhash.REGION
    rng = np.random.default_rng(3)
    keys = np.zeros((n, minhash.DEPTH), np.uint32)
    keys[:, same:] = np.arange(n)[:, None]
    marks = rng.integers(0, 1 << 63, (n, minhash.TREES * minhash.DEPTH // 16)).astype(np.uint64)
    marks[-1] = marks[0]
    assert minhash.region_edges(keys, np.arange(n), marks, minhash.least_matches(0.8)) == [(0, n - 1)]


@pytest.mark.parametrize("region", [1, 3])
def test_near_duplicates_by_pairs_of_blocks(spark, monkeypatch, region):
    monkeypatch.setattr(minhash, "REGION", region)
    rows = near_rows()
    got = minhash.near_duplicates(docs(spark, rows), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_near(rows, 4)


def test_near_duplicates_null_ids_and_empty(spark):
    rows = [(None, "a b c d e f", "s"), (3, "a b c d e f", "s"), (None, "q r s t u v", "s")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(None, 3, False), (3, 3, True), (None, None, True)}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


# --- pieces -------------------------------------------------------------------------------------

ODD = ["", " ", "  a  b ", "\n\n x\ty\r", "日本語 テキスト", "😀 😀x", "x\0y", "a" * 500, "ab" * 700 + " z", "<0x0A> <s>", "é" * 70]


def test_pieces_equal_the_library_and_come_back(spark):
    import sentencepiece as library

    rnd = random.Random(1)
    texts = ODD + ["▁a"] + ["".join(rnd.choice("ab \n語eth▁😀") for _ in range(rnd.randint(1, 200))) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1000, None, "s"), (0, texts[0], "s")]
    both = sentencepiece.decode_pieces(sentencepiece.encode_pieces(docs(spark, rows).withColumn("piece_ids", F.lit(1)))).collect()
    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    assert len(both) == len(rows)
    for r in both:
        assert r["piece_ids"] == model.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
    assert sentencepiece.encode_pieces(docs(spark, [])).count() == 0


# --- preference pairs ---------------------------------------------------------------------------


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "hi", True), (0, 1, "assistant", "yes <|end|>", True), (0, 2, None, None, True),
        (0, 0, "user", "hi", False), (0, 1, "assistant", "no", False),
        (1, 0, "user", "alone", True),
        (2, 0, "user", "q", True), (2, 0, "user", "q", False), (2, 0, "user", "q", False),
        (3, 5, "user", "x", False), (None, 0, "user", "lost", True),
    ]
    df = spark.createDataFrame(rows, "p long, turn long, role string, text string, side boolean").withColumn("prompt", F.lit(1))
    got = {r["pair_id"]: r for r in preference.preference_pairs(df, F.col("p"), F.col("side")).collect()}
    assert set(got) == {0, 1, 2, 3}
    zero = got[0]
    assert (zero["n_prefix"], zero["prompt"]) == (1, "<|turn|>user\nhi<|end|>\n")
    assert [(s["text"], s["loss"]) for s in zero["chosen"]] == [
        ("<|turn|>assistant\n", False), ("yes < |end|><|end|>\n", True), ("<|turn|>user\n", False), ("<|end|>\n", False)
    ]
    assert [(s["text"], s["loss"]) for s in zero["rejected"]] == [("<|turn|>assistant\n", False), ("no<|end|>\n", True)]
    assert (got[1]["n_prefix"], got[1]["rejected"], got[1]["complete"]) == (0, [], False)
    assert (got[2]["n_prefix"], got[2]["chosen"], got[2]["rejected"], got[2]["complete"]) == (1, [], [], True)
    assert got[3]["chosen"] == [] and not got[3]["complete"]
    assert preference.preference_pairs(df.filter("false"), F.col("p"), F.col("side")).count() == 0


# --- class n-grams ------------------------------------------------------------------------------


def test_class_scores(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"{c}{k}" for c in "abcd" for k in range(30)]
    rows = []
    for i in range(120):
        c = rnd.choice("abcd")
        rows.append((i, " ".join(rnd.choice([w for w in words if w[0] == c]) for _ in range(rnd.randint(0, 40))), "s"))
    rows += [(200, None, "s"), (201, "Never seen A1 a1", "s"), (None, "a1 b2", "s"), (5, rows[5][1], "s"), (300, rows[7][1], "s")]
    learn = F.crc32(F.col("id").cast("string")) % 7 != 2
    df = docs(spark, rows).drop("id", "score").withColumnRenamed("doc_id", "id")
    monkeypatch.setattr(brown, "FREQUENT", 15)
    got = brown.class_scores(df, learn).collect()
    assert len(got) == len(rows)
    tokens = lambda t: ascii_lower(t).encode().split() + [None]
    counts = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t, _ in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, _ in rows:
        tk = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tk)
        want[i, held(i), len(tk), sum(counts[w] > 0 for w in tk), n, round(base, 6)] += 1
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert brown.class_scores(df.filter("false"), learn).count() == 0


def test_class_model_beats_unigrams_and_exchange_finds_classes(spark):
    pairs = np.zeros((21, 21))
    for a in range(20):
        for b in range(20):
            pairs[a, b] = 50 if (a // 10) != (b // 10) else 1
    of = brown.exchange(pairs, classes=2)
    assert len({*of[:10]}) == 1 and len({*of[10:20]}) == 1 and of[0] != of[10] and of[20] == 2
    rnd = random.Random(4)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{rnd.randrange(25)}" for k in range(60)), "s") for i in range(150)]
    df = docs(spark, rows).drop("id", "score").withColumnRenamed("doc_id", "id")
    got = brown.class_scores(df, F.crc32(F.col("id").cast("string")) % 7 != 2).filter("held_out").collect()
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_every_word_has_the_class_of_its_neighbours(spark):
    """Words far below the core, and below what is sent, are classed by their own neighbours, not by a hash."""
    rnd = random.Random(5)
    nouns, verbs = [f"n{i}x" for i in range(900)], [f"v{i}x" for i in range(900)]
    common = ["the", "of", "to", "in", "cat", "dog", "sit", "run"]
    pairs = [*zip(nouns, verbs), *[(rnd.choice(["cat", "dog"]), rnd.choice(["sit", "run"])) for _ in range(400)]]
    lines = [f"of the {a} to {b} in" for a, b in pairs]
    texts = spark.createDataFrame([(line.encode(),) for line in rnd.sample(lines, len(lines))], "text binary")
    counts = Counter(w for line in lines for w in line.split())
    top = pd.DataFrame([(w.encode(), counts[w]) for w in common], columns=["word", "n"])
    class_of, lexicon = brown.word_classes(texts, top)
    got = {bytes(r["word"]).decode(): r["class"] for r in lexicon.collect()}
    assert set(got) == set(nouns + verbs) and set(class_of) == {w.encode() for w in common}
    assert {got[w] for w in nouns} <= {class_of[b"cat"], class_of[b"dog"]}
    assert {got[w] for w in verbs} <= {class_of[b"sit"], class_of[b"run"]}
    assert not {got[w] for w in nouns} & {got[w] for w in verbs}


@pytest.mark.parametrize("collide", [False, True])
def test_neighbours_hand_on_a_row_per_word(spark, monkeypatch, collide):
    """Sides are packed into the row of their word, whatever batches and hashes it meets others in."""
    rnd = random.Random(6)
    lines = [" ".join(rnd.choice(["a", "b", "Zed", "q\x0br", "é", *(f"w{i}" for i in range(40))]) for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    lines += [" \t", "", "  once a ", "only"]
    core = {b"a": 3, b"b": 5}
    want = Counter()
    for line in lines:
        own = line.lower().encode().split()
        at = [brown.BOUND, *(core.get(w, brown.OTHER) for w in own), brown.BOUND]
        want.update((w, at[i] * brown.SIDES + at[i + 2]) for i, w in enumerate(own) if w not in core)
    if collide:
        monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    texts = spark.createDataFrame([(line.encode(),) for line in lines], "text binary").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = brown.neighbours(texts, core, len(core)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [(bytes(r["word"]), int(s), int(n)) for r in rows for s, n in zip(np.frombuffer(r["sides"], "<u2"), np.frombuffer(r["counts"], "<i8"), strict=True)]
    assert len(rows) == len({w for w, _ in want}) and sorted(got) == sorted((w, s, n) for (w, s), n in want.items())
    times = Counter(w for w, _ in want.elements())
    only = {w: s for w, s in want if times[w] == 1}
    assert {bytes(r["word"]): r["only"] for r in rows if r["only"] is not None} == only and b"once" in only


def test_class_scores_do_not_depend_on_what_is_joined(spark, monkeypatch):
    rnd = random.Random(7)
    words = [f"W{i}" for i in range(80)]
    rows = [(i, " " * (i % 3) + " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) + "\n" * (i % 2), "s") for i in range(90)]
    rows += [(i + 100, rows[i][1], "s") for i in range(20)] + [(200, None, "s"), (201, "new w1 new other w2 new", "s")]
    df = docs(spark, rows).drop("id", "score").withColumnRenamed("doc_id", "id")
    monkeypatch.setattr(brown, "CORE", 5)
    scores = []
    for frequent in (5, 40, 1_000):
        monkeypatch.setattr(brown, "FREQUENT", frequent)
        got = brown.class_scores(df, F.crc32(F.col("id").cast("string")) % 7 != 2).collect()
        scores.append({r["id"]: (r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got})
    assert len(scores[0]) == len(rows) and scores[0] == scores[1] == scores[2]


# --- top-k --------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1 << 20, 256])
def test_exact_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_VALUES", block)
    monkeypatch.setattr(topk, "SEEDS", 20)
    rng = np.random.default_rng(6)
    vecs = {i: (rng.normal(0, rng.choice([3, 300, 3000]), 4)).astype(int).tolist() for i in range(400)}
    for i in range(0, 60):
        vecs[i] = vecs[0]
    vecs |= {500: [0, 0, 0, 0], 501: [1, 2], 502: [3, -4], 503: []}
    rows = [(i, v) for i, v in vecs.items()]
    table = spark.createDataFrame(rows + [(None, [1, 1, 1, 1]), (900, None)], "vec_id long, vector array<long>").withColumn("score", F.lit("x"))
    asked = table.filter("vec_id % 50 = 0 or vec_id > 500 or vec_id is null").select(F.col("vec_id").alias("query_id"), "vector")
    got = defaultdict(list)
    for r in topk.exact_top_k(asked.union(asked.limit(1)), table, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in [i for i in vecs if i % 50 == 0 or i > 500]:
        want = sorted(((-sum(a * b for a, b in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q])))
        assert got.get(q, []) == [(i, -s) for s, i in want[:10]]
    assert topk.exact_top_k(asked.filter("false"), table).count() == 0
    assert topk.exact_top_k(asked, table.filter("false")).count() == 0


# --- classifiers --------------------------------------------------------------------------------


def test_non_negative_risk_finds_the_feature():
    rng = np.random.default_rng(1)
    pos = np.zeros((200, 5), np.uint8)
    pos[:, 0] = rng.random(200) < 0.9
    unl = np.zeros((1000, 5), np.uint8)
    unl[:100, 0] = 1
    unl[:, 1:] = rng.random((1000, 4)) < 0.3
    pos[:, 1:] = rng.random((200, 4)) < 0.3
    w, b = toxicity.fit_non_negative(pos, unl, 0.1)
    assert w[0] + b > 1 and b < -1 and np.abs(w[1:]).max() < w[0] / 2


def test_toxicity(spark):
    rnd = random.Random(8)
    words = [f"word{k}" for k in range(80)]
    rows, labels = [], []
    for i in range(600):
        text = [rnd.choice(words) for _ in range(30)]
        if toxic := i % 10 == 0:
            text[3] = rnd.choice(["vileness", "vileful,", "VILER!"])
        rows.append((i, " ".join(text), "s"))
        if i % 3 == 0:
            labels.append((i, int(toxic)))
    rows += [(700, None, "s"), (701, "", "s"), (701, "", "s"), (None, "vileness", "s"), (702, "word1 " * 30_000 + "vileness", "s")]
    df = docs(spark, rows)
    marks = spark.createDataFrame(labels + [(0, 1), (None, 1), (4, None)], "id long, toxic int")
    model = toxicity.fit(df.select(F.col("doc_id").alias("id"), "text"), marks)
    got = toxicity.score_toxicity(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        toxic = "vile" in (r["text"] or "").lower()
        assert (r["score"] >= 0.7) == toxic, r
    none = toxicity.fit(df.select(F.col("doc_id").alias("id"), "text"), marks.filter("false"))
    assert {r["score"] for r in toxicity.score_toxicity(df, none).collect()} == {0.0}
    assert toxicity.score_toxicity(df.filter("false"), model).count() == 0


def test_quality(spark):
    rnd = random.Random(9)
    words = [f"word{chr(97 + k % 26)}{k}" for k in range(80)]
    rows, labels = [], []
    for i in range(300):
        text = [rnd.choice(words) for _ in range(rnd.randint(10, 60))]
        if i % 4 == 0:
            text = [w.upper() + "!!" for w in text] if i % 8 else [text[0]] * len(text)
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(i % 4 != 0)))
    rows += [(700, None, "s"), (701, "", "s"), (702, "word1 " * 50_000, "s"), (3, rows[3][1], "s")]
    df = docs(spark, rows).drop("id", "score").withColumnRenamed("doc_id", "id")
    train = spark.createDataFrame(labels[:200] + [(None, 1), (5, None)], "id long, quality int")
    got = quality.score_quality(df, train).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"] >= 0.5) == (r["id"] % 4 != 0) for r in got if 200 <= r["id"] < 300]
    assert sum(held) / len(held) > 0.9
    assert {r["score"] for r in quality.score_quality(df, train.filter("false")).collect()} == {0.5}
    assert quality.score_quality(df.filter("false"), train).count() == 0


def test_contexts_by_stretches_add_up():
    rng = np.random.default_rng(3)
    w, s = rng.integers(0, 50, 40), rng.integers(quality.WORD_BUCKETS, quality.BUCKETS, 40)
    index = quality.index_vectors()
    whole, parts = np.zeros((quality.BUCKETS, quality.DIMENSIONS)), np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    quality.add_contexts(whole, w, s, index)
    for at in range(0, 40, 7):
        quality.add_contexts(parts, w[at : at + 8], s[at : at + 8], index)
    assert np.array_equal(whole, parts)


# --- URLs ---------------------------------------------------------------------------------------


def test_url_filter(spark):
    pages = [
        (1, "https://Sub.Example.ORG/es/x?q#f", ""),
        (2, "http://example.org/en/123", None),
        (3, "http://example.org", ""),
        (4, "http://a.net/p", '<LINK href="http://example.org/es/y" rel="canonical">'),
        (5, "http://a.net/p#frag", ""),
        (6, "http://b.net/q", '<meta http-equiv="refresh" content="0; url=http://c.com/de/z">'),
        (7, "http://b.net/q.html", '<link rel=canonical href=http://x.org/fine>'),
        (8, None, None),
        (9, "no scheme", '<link rel="canonical" href="http://example.org/es/y">'),
        (10, "ftp://evilexample.org/es/", ""),
        (10, "ftp://evilexample.org/es/", ""),
        (11, "http://d.net/a", '<link rel="canonical" href="/b">'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit(1)).withColumn("node", F.lit(1))
    got = sorted(tuple(r) for r in url_filter.judge_urls(df, url_filter.declared_links(df)).collect())
    assert [(g[0], g[4], g[3]) for g in got] == [
        (1, "block", "example.org/es/"), (2, "block", "example.org/en/1"), (3, "allow", None), (4, "block", None), (5, "block", None),
        (6, "allow", None), (7, "allow", None), (8, "allow", None), (9, "allow", None), (10, "allow", "org/"), (10, "allow", "org/"), (11, "allow", None),
    ]
    assert got[0][1:3] == ("sub.example.org", "/es/x") and got[2][1:3] == ("example.org", "") and got[7][1:3] == ("", "")
    assert url_filter.judge_urls(df.filter("false"), url_filter.declared_links(df.filter("false"))).count() == 0


RFC_3986 = {
    "g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", "?y": "/b/c/d;p?y", "g?y": "/b/c/g?y", "g#s": "/b/c/g",
    "": "/b/c/d;p?q", "#s": "/b/c/d;p?q", ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/", "../g": "/b/g",
    "../..": "/", "../../g": "/g", "../../../g": "/g", "/./g": "/g", "/../g": "/g", "g.": "/b/c/g.", "..g": "/b/c/..g",
    "./../g": "/b/g", "./g/.": "/b/c/g/", "g/../h": "/b/c/h", "g?y/../x": "/b/c/g?y/../x",
}


def test_references_are_resolved(spark):
    rows = [(k, "http://a/b/c/d;p?q", "a" + v) for k, v in RFC_3986.items()]
    rows += [
        ("//G.org", "http://a/b/c/d;p?q", "g.org"),
        ("https://x.org/a/../b?u=1&amp;v=2#f", "http://a/b", "x.org/b?u=1&v=2"),
        ("/go?u=http://c.com/de/z", "http://h.net/p", "h.net/go?u=http://c.com/de/z"),
        (" g ", "http://a", "a/g"),
        ("mailto:x@y.org", "http://a/b", None),
        ("g", "no scheme", None),
        (None, "http://a/b", None),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "ref string, base string, want string, i int")
    for r in df.withColumn("got", url_filter.resolved(F.col("ref"), F.col("base"))).collect():
        assert r["got"] == r["want"], r


def test_declared_links(spark):
    two = '<link rel="canonical" href="http://x.net/1"><link data-href="no" rel=canonical href=\'../de/z\'>'
    pages = [
        (1, "http://a.com/p/q", two),
        (2, "http://e.net/x", '<link rel="canonical" href="//example.org/es/z">'),
        (3, "http://f.net/x", '<link rel="canonical" href="/go?u=http://c.example.com/de/z">'),
        (4, "http://g.net/x", "<meta content='0; url=//example.org/en/1' http-equiv=refresh>"),
        (5, "http://h.net/x", "w" * 3_000_000 + '<link rel="canonical" href="http://example.org/es/">'),
        (6, "http://i.net/x", '<link rel="canonical">'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    links = {tuple(r) for r in url_filter.declared_links(df).collect()}
    assert {("a.com/p/q", "x.net/1"), ("a.com/p/q", "a.com/de/z"), ("e.net/x", "example.org/es/z")} <= links
    assert ("f.net/x", "f.net/go?u=http://c.example.com/de/z") in links and len(links) == 6
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df, url_filter.declared_links(df)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow"}


# --- mixing -------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    budget, out = 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while True:
        level = (budget - sum(out.values())) / max(1e-12, sum(w[s] for s in open_)) if open_ else 0
        over = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over


def test_mixing(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(400):
        source = rnd.choice(["a", "b", "B", "ä", None, "c", "c", "c", "c"])
        rows.append((i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(0, 60))), source))
    rows += [(500, None, "a"), (501, "", "lone"), (502, "x " * 20_000, "b"), (503, "one two", "tiny"), (7, rows[7][1], rows[7][2])]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    used = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        used[r["source"]] += r["taken"]
    longest = Counter()
    for _, t, s in rows:
        longest[s] = max(longest[s], len((t or "").split()))
    for s in sizes:
        assert abs(used[s] - want[s]) <= longest[s] / 2 + 1
    again = mixing.mix_sources(docs(spark, rows[::-1])).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_mixing_cuts_inside_ties(spark):
    """Rows that repeat one id are taken one by one, and the rows of other sources are left alone."""
    rows = [(1, "w " * 10, "a")] * 10 + [(None, "w " * 4, None)] * 9 + [(i, "w " * 7, "b") for i in range(30)]
    df = docs(spark, rows).repartition(3)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    for source, size in (("a", 10), ("b", 7), (None, 4)):
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= size / 2
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
