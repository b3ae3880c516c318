"""Strings inside texts by their rarest gram, and field scores, against plain loops."""

import random

from quakelake.operators import retrieval as R
from quakelake.operators import substrings


def test_pairs_against_loop(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("abc é中\U0001f600") for _ in range(rnd.randint(0, 12)))) for i in range(80)] + [(99, None), (98, "")]
    patterns = ["", "a", "é", "ab", "abc", "a b", "\U0001f600", "中é", "bca", "abcabc", "zzz", "c é", None, "ab"]
    found = substrings.substring_pairs(
        spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame(texts, "id long, text string")
    )
    want = sorted((p, i) for p in set(patterns) - {None} for i, t in texts if t is not None and p in t)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert len(want) > 100


def test_bound_keeps_pairs(spark):
    """Beyond the bound of the sent side the join is an ordinary one."""
    texts = spark.createDataFrame([(i, f"text {i} of {i * 7}") for i in range(50)], "id long, text string")
    patterns = spark.createDataFrame([(str(i),) for i in range(30)], "pattern string")
    want = sorted(map(tuple, substrings.substring_pairs(patterns, texts).collect()))
    assert sorted(map(tuple, substrings.substring_pairs(patterns, texts, max_rows=2).collect())) == want


def test_field_scores_against_loop(spark):
    rnd = random.Random(9)
    syllables = ["ma", "gni", "tude", "b", "value", "wave", "hv", "sr", "the", "x1", ".", "-"]

    def word():
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))

    def phrase(n):
        return " ".join(word() for _ in range(rnd.randint(0, n)))

    entries = [
        (f"N{i:02d}{word()}", phrase(3), [word() for _ in range(rnd.randint(0, 4))] if i % 9 else None, phrase(9) if i % 7 else None, rnd.choice(["user", "builtin", None]))
        for i in range(40)
    ]
    asked = [(i, phrase(6).title()) for i in range(30)] + [(77, None), (78, "N03"), (79, "...")]
    import re

    want = []
    for q, text in asked:
        low = (text or "").lower()
        toks = {t.lower() for t in re.findall(r"[a-zA-Z0-9_\-\.]+", text or "") if len(t) >= 2}
        scored = []
        for name, description, keywords, body, source in entries:
            if text is None:
                continue
            score = sum(5 if k in low else 3 if any(t in k for t in toks) else 0 for k in keywords or [])
            score += 2 if name.lower() in low or any(t in name.lower() for t in toks) else 0
            score += 2 if any(len(t) >= 3 and t in description for t in toks) else 0
            score += min(3, sum(len(t) >= 3 and t in (body or "") for t in toks))
            score += score > 0 and source == "user"
            scored += [(-score, name)] if score else []
        want += [(q, k + 1, name, -minus) for k, (minus, name) in enumerate(sorted(scored)[:4])]
    catalog = spark.createDataFrame(entries, "name string, description string, keywords array<string>, body string, source string")
    found = R.field_topk(catalog, spark.createDataFrame(asked, "query_id long, query string"), R.entry_score, 4)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_plan_holds_no_product(spark):
    catalog = spark.createDataFrame([("n", "d", ["k"], "b", "user")], "name string, description string, keywords array<string>, body string, source string")
    found = R.field_topk(catalog, spark.createDataFrame([(1, "k n")], "query_id long, query string"), R.entry_score)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_small_catalog_is_scanned_without_shuffling_matches(spark):
    """A small catalog travels to the tasks: k rows per query are shuffled, whatever the number of matches."""
    rnd = random.Random(2)
    bits = ["ma", "gni", "wave", "hv", "地震", "波", "x1", "_", "-", ".", "É"]

    def phrase(n):
        return " ".join("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(0, n)))

    refs = spark.createDataFrame([(i, f"the-{phrase(2)}", f"# {phrase(3)}\n{phrase(6)}") for i in range(60)], "ref_id int, ref_name string, text string")
    asked = spark.createDataFrame([(i, phrase(7)) for i in range(50)] + [(90, None), (91, "...")], "query_id long, query string")
    catalog = R.reference_fields(refs)
    sent = R.field_topk(catalog, asked, R.reference_score, 4, entry_id="ref_id")
    joined = R.field_topk(catalog, asked, R.reference_score, 4, entry_id="ref_id", max_rows=2)
    assert sorted(map(str, sent.collect())) == sorted(map(str, joined.collect())) and sent.schema == joined.schema
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert R.field_topk(catalog.filter("false"), asked, R.reference_score, entry_id="ref_id").count() == 0
