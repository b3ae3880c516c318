"""Conversation repair against all edit sequences of small conversations, and cut into tiny pages."""

import hashlib
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from quakelake.llm import repair

GAPS = ["", "u", "a", "ua", "au", "uau"]


def brute(rows):
    """(cost, audit) of the best of all edits; rows are (initial, fault) with fault one of ok, blank, duplicate, cut."""
    best = None
    options = []
    for initial, fault in rows:
        mine = [("D", "", 2)]
        if fault in ("ok", "cut"):
            more = 5 if fault == "cut" else 0
            mine += [("K", initial, more), ("R", "u", 1 + more), ("R", "a", 1 + more)]
        options.append(mine)
    for chosen in product(*options):
        for gaps in product(GAPS, repeat=len(rows) + 1):
            said = gaps[0] + "".join(c[1] + g for c, g in zip(chosen, gaps[1:]))
            if re.fullmatch("(s?(ua)+)?", said):
                cost = sum(c[2] for c in chosen) + 5 * sum(map(len, gaps))
                audit = "I" * len(gaps[0]) + "".join(c[0] + "I" * len(g) for c, g in zip(chosen, gaps[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def letters(rows):
    names = ["ok", "blank", "duplicate", "cut"]
    return "".join(repair.KINDS[4 * "suax".index(i) + names.index(f)] for i, f in rows)


def test_edits_are_cheapest():
    rnd = random.Random(11)
    for n in (0, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3):
        rows = [(rnd.choice("suaxua"), rnd.choice(["ok", "ok", "blank", "duplicate", "cut"])) for _ in range(n)]
        cost, tail, steps = repair.edits(letters(rows), 0)
        assert (cost, "".join(s.audit for s in steps) + "I" * len(tail)) == brute(rows)


def test_tables_join():
    rnd = random.Random(3)
    for _ in range(20):
        kinds = "".join(rnd.choice(repair.KINDS) for _ in range(40))
        assert repair.joined_table([repair.page_table(kinds[i : i + 10]) for i in range(0, 40, 10)]) == repair.page_table(kinds)


def test_grammar_must_have_bounded_stacks():
    assert repair.Parser((("S", ""), ("S", "Sua"))).accepting[0]
    with pytest.raises(ValueError):
        repair.Parser((("S", ""), ("S", "uSa")))


def plain(rows):
    """The results of one conversation, row by row; ``rows`` are (turn, role, text) in order."""
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "ok" if bare[-1] in ".!?" else "cut"
        seen.add((role, text))
        kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
    cost, tail, steps = repair.edits(letters(kinds), 0)
    lines = []
    for (_, role, text), step in zip(rows, steps):
        lines += [repair.ROLES[c] + ":" for c in step.before]
        lines += [] if step.edit == "D" else [(repair.ROLES[step.role] if step.edit == "R" else role) + ":" + text]
    lines += [repair.ROLES[c] + ":" for c in tail]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{n: sum(f == k for _, f in kinds) for n, k in [("blank", "blank"), ("duplicate", "duplicate"), ("truncated", "cut")]},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": "".join(s.audit for s in steps) + "I" * len(tail),
    }, lines


@pytest.mark.parametrize("bits", [(10, 8), (1, 1), (2, 2)])
def test_repair_conversations(spark, bits, monkeypatch):
    monkeypatch.setattr(repair, "PAGE_BITS", bits[0])
    monkeypatch.setattr(repair, "FAN_BITS", bits[1])
    rnd = random.Random(5)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "Well", "", None, "Long " * 20_000 + "end.", "\t\n", "Why?\n", "é", "Ok。"]
    rows = [(c, rnd.choice([None, *range(40)]), rnd.choice(roles), rnd.choice(texts)) for c in (1, 2, 3, None) for _ in range(rnd.randint(1, 12))]
    rows += [(9, t, rnd.choice(roles[:5]), f"{rnd.choice(texts[:3])} {rnd.randint(0, 200)}.") for t in range(150)] + [(9, 7, "user", "Same.")] * 30
    schema = "conv_id long, turn int, role string, text string, edit string, at string, c string, page int, `x.y` int"
    df = spark.createDataFrame([(*r, "e", "a", "c", 1, 1) for r in rows], schema)
    got = repair.repair_conversations(df)
    found = {r["conv_id"]: r.asDict() for r in got.conversations.collect()}
    digests = {r["conv_id"]: r["sha256"] for r in repair.text_digests(got.rows).collect()}
    edits = {}
    for r in got.rows.orderBy("conv_id", "at", "place").collect():
        edits.setdefault(r["conv_id"], []).append(r["edit"])
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    assert set(found) == set(groups)
    for c, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        want, lines = plain(mine)
        assert {k: found[c][k] for k in want} == want
        assert "".join(edits[c]) == want["audit"]
        assert digests.get(c, hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_empty(spark):
    got = repair.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert got.rows.count() == got.conversations.count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "So? Yes.") for c in range(40) for t in (None, 0, 1, 2)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = []
    for c, t, r, x in rows:
        d = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        one = (c, t, "user" if d == 4 else r, "" if d == 1 else "So Yes" if d == 2 else x)
        want += [one] * (0 if d == 0 else 2 if d == 3 else 1)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert got.select(F.count_distinct("role")).head()[0] == 2
