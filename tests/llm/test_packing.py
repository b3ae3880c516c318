"""Packing: fills against exhaustive search, ids against the tokenizer itself, sequences without padding."""

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quakelake.llm import packing

DOCS = "doc_id long, text string, ids string, start string, length int, sequence_id string, offset double, `a.b` int"


def test_closest_fill():
    rnd = random.Random(4)
    for _ in range(300):
        lengths = sorted({rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(4)}.items(), reverse=True)
        room = rnd.randint(1, 60)
        sums = [sum(n * x for n, (x, _) in zip(c, lengths)) for c in product(*[range(n + 1) for _, n in lengths])]
        uses = packing.closest_fill(lengths, room)
        assert all(0 < n <= dict(lengths)[x] for x, n in uses.items())
        assert sum(x * n for x, n in uses.items()) == max(s for s in sums if s <= room)


def check(windows, sizes, capacity):
    covered = defaultdict(list)
    for window in windows:
        size = sum(len(p[3]) for p in window)
        assert size == capacity or size < capacity and size & (size - 1) == 0
        for doc, total, start, ids in window:
            assert total == sizes[doc]
            covered[doc].append((start, len(ids)))
    for doc, size in sizes.items():
        at = 0
        for start, n in sorted(covered[doc]):
            assert start == at and n > 0
            at += n
        assert at == size


@pytest.mark.parametrize("pool", [64, 4096, 1 << 20])
@pytest.mark.parametrize("kind", ["mixed", "one length", "short", "long"])
def test_pack(pool, kind, monkeypatch):
    monkeypatch.setattr(packing, "POOL", pool)
    rnd = random.Random(7)
    draw = {"mixed": lambda: rnd.randint(1, 300), "one length": lambda: 70, "short": lambda: 1, "long": lambda: rnd.choice([1, 128, 5000])}[kind]
    sizes = {i: draw() for i in range(200)}
    windows = list(packing.pack(((i, np.arange(n, dtype=np.uint32)) for i, n in sizes.items()), 128))
    check(windows, sizes, 128)
    assert sum(sum(len(p[3]) for p in w) < 128 for w in windows) <= 7


def test_exact_fills_cut_nothing():
    sizes = dict(enumerate([x for big in range(65, 128) for x in (big, 128 - big)] * 3))
    windows = list(packing.pack(((i, np.zeros(n, np.uint32)) for i, n in sizes.items()), 128))
    check(windows, sizes, 128)
    assert len(windows) == 189 and not any(p[2] for w in windows for p in w)


def test_segments_keep_ids():
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    alphabet = "abc déÉ  \n\t'st 12.!́ Σσ中文\U0001f600"
    for _ in range(200):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))
        parts = packing.segments(text, 5)
        assert "".join(parts) == text
        assert [i for p in parts for i in model.encode(p, add_special_tokens=False).ids] == model.encode(text, add_special_tokens=False).ids


def test_word_ids(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rnd = random.Random(8)
    words = ["It's", "DON'T", "a\nb.", "x1y22", "<|endoftext|>", "<|ENDOFTEXT|>.", "'sabc", "\"'s", "e\u0301t", "=\u0338", "ΣΑΣ", "…", "\x1c7", "\x85", "", "ab" * 60, "9.81m/s^2", "ÀÉ", "Straße", "naïve,", "ÿÐ÷×ª", "tab\tbed", "''ll"]
    for known in (6, 400_000):
        monkeypatch.setattr(packing, "KNOWN", known)
        monkeypatch.setattr(packing, "SEGMENT", 40)
        coder = packing.WordIds(path, 2)
        assert coder.split is not None
        for _ in range(150):
            text = " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "'", "!?"]) for _ in range(rnd.randint(0, 30)))
            assert coder.of(text).tolist() == model.encode(text, add_special_tokens=False).ids + [2]
    coder.split = None
    assert coder.of("It's Größe").tolist() == model.encode("It's Größe", add_special_tokens=False).ids + [2]
    assert packing.split_pattern({"normalizer": None}) is None


def test_pack_documents(spark):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(5)
    words = ["Earth", "quake", "it's", "Größe", "9.81", "<|endoftext|>", "中文", "a"]
    texts = [None, "", " ", "x" * 30_000, "word " * 150_000] + [" ".join(rnd.choices(words, k=rnd.randint(1, 900))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, texts[7]), (7, texts[7])]
    df = spark.createDataFrame([(i, t, "i", "s", 1, "q", 1.0, 1) for i, t in rows], DOCS).repartition(3)
    got = packing.pack_documents(df).collect()
    want = defaultdict(int)
    for i, t in rows:
        want[(i, tuple(model.encode(t or "", add_special_tokens=False).ids) + (2,))] += 1
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for (i, ids), n in want.items():
        mine = [(s, x) for s, x, _ in pieces[i]]
        assert sum(len(x) for _, x in mine) == n * len(ids)
        assert {t for _, _, t in pieces[i]} == {len(ids)}
        assert all(tuple(x.tolist()) == ids[s : s + len(x)] for s, x in mine)
    for placed in windows.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at == 4096 or at < 4096 and at & (at - 1) == 0
    joined = packing.sequences(packing.pack_documents(df)).collect()
    assert len(joined) == len(windows)
    assert all(len(r["ids"]) == 4 * r["length"] == 4 * sum(r["documents"]) for r in joined)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = packing.op13_packing(spark, sf_dir).collect()
    total = defaultdict(int)
    coded = {i: np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in texts.items()}
    for r in got:
        piece = coded[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(coded[r["doc_id"]])
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(x) for i, x in coded.items()}
