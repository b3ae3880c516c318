"""Sliding windows of long texts against a loop over characters."""

import random
import re

import pytest

from quakelake.operators import documents as D


def plain(text, size, overlap):
    flat = re.sub(r"[ \t\n\r\x0b\x0c\x1c-\x1f\x85\xa0]+", " ", text)
    out, at = [], 0
    while at < len(flat):
        window = flat[at : at + size]
        sentence = max(window.rfind(c) for c in ".!?")
        word = window.rfind(" ")
        if at + size >= len(flat):
            stop = at + size
        elif sentence > size // 2:
            stop = at + sentence + 1
        elif word > size // 2:
            stop = at + word
        else:
            stop = at + size
        out.append(flat[at:stop].strip())
        if len(flat) - (stop - overlap) < overlap:
            break
        at = stop - overlap
    return [w for w in out if w]


@pytest.mark.parametrize("size,overlap", [(20, 5), (50, 0), (500, 50)])
def test_windows_against_loop(spark, size, overlap):
    rnd = random.Random(size)
    words = ["earth", "Beben.", "地震", "a", "wave!", "\n\t", "x" * 70, "\U0001f30d", "fin?"]
    texts = ["", " ", "one", None] + [" ".join(rnd.choices(words, k=rnd.randint(1, 400))) for _ in range(15)]
    texts.append(" ".join(rnd.choices(words, k=12_000)))  # more windows than one short list holds
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in D.sliding_chunks(df, size=size, overlap=overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: w for i, t in enumerate(texts) if t is not None and (w := plain(t, size, overlap))}
