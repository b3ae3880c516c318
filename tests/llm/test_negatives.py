"""Hard negatives: the curve, interval bounds, and results against brute force in tiny blocks."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakelake.llm import negatives


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(axes, bits):
    cells = np.array(list(product(range(1 << bits), repeat=axes)))
    place = negatives.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v, x = rng.integers(-50, 50, (20, 6)), rng.integers(-50, 50, (7, 6)).astype(float)
        least, most = negatives.bounds(x, v.min(0)[None, :].astype(float), v.max(0)[None, :].astype(float))
        scores = x @ v.T
        assert (scores >= least).all() and (scores <= most).all()


def brute(rows, anchor, positives, count, low, high):
    sound = [r for r in rows if None not in r[:3] and None not in r[2]]
    out = []
    for a in sound:
        if not anchor(a[0]):
            continue
        scored = [(sum(x * y for x, y in zip(a[2], r[2])), r) for r in sound if r is not a and len(r[2]) == len(a[2])]
        scored.sort(key=lambda s: (-s[0], s[1][0]))
        for ps, p in [s for s in scored if s[1][1] == a[1]][:positives]:
            fit = [(s, r) for s, r in scored if r[1] != a[1] and low * ps <= 100 * s <= high * ps]
            out += [(a[0], p[0], k + 1, r[0], ps, s) for k, (s, r) in enumerate(fit[:count])]
    return out


@pytest.mark.parametrize("block,page,group", [(10, 11, 11), (2, 1, 2), (3, 2, 1)])
@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_hard_negatives(spark, monkeypatch, block, page, group, kind):
    monkeypatch.setattr(negatives, "BLOCK_BITS", block)
    monkeypatch.setattr(negatives, "PAGE_BITS", page)
    monkeypatch.setattr(negatives, "GROUP_BITS", group)
    rnd = random.Random(6)
    centres = [[rnd.randint(-40, 40) for _ in range(5)] for _ in range(6)]

    def vector(i):
        if kind == "even":
            return [rnd.randint(-9, 9) for _ in range(5)]
        return [c + rnd.randint(-2, 2) for c in centres[i % 6]]

    rows = [(i, rnd.randint(0, 2), vector(i)) for i in range(160)]
    rows += [(None, 1, [1, 2, 3, 4, 5]), (200, None, [1, 1, 1, 1, 1]), (205, 1, None), (210, 1, [1, None, 1, 1, 1])]
    rows += [(215, 1, [3, 4]), (216, 1, [5, 5]), (217, 0, [2, 3]), (218, 0, [1, 9]), (220, 5, [])]
    rows += [(5, 1, rows[5][2]), (5, 0, rows[5][2]), (225, 7, [0] * 5), (226, 7, [0] * 5), (230, 1, [1 << 20] * 5), (231, 1, [1 << 20] * 5)]
    schema = "vec_id long, label int, vector array<bigint>, row string, block string, id int, n int, `a.b` int"
    df = spark.createDataFrame([(*r, "r", "b", 1, 1, 1) for r in rows], schema)
    got = negatives.hard_negatives(df, F.col("id") % 5 == 0, positives=3, negatives=4)
    want = brute(rows, lambda i: i % 5 == 0, 3, 4, 30, 90)
    assert len(want) > 100
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, label int, vector array<bigint>")
    assert negatives.hard_negatives(none, F.col("id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(1, 1, [1, 2])], "vec_id long, label int, vector array<bigint>")
    assert negatives.hard_negatives(one, F.col("id") % 5 == 0).count() == 0
    assert negatives.hard_negatives(one, F.col("id") % 1 == 0).count() == 0
