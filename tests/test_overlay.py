"""Picks inside traces by cells of time, against a loop over all pairs."""

import random
from datetime import datetime, timedelta

import pytest

from quakelake.operators import picks as K

ZERO = datetime(1969, 12, 30)


@pytest.mark.parametrize("cell", [60, 3_600, 86_400])
def test_picks_on_traces(spark, cell):
    rnd = random.Random(12)
    traces = [(i, rnd.choice(["A", "B", None]), ZERO + timedelta(seconds=rnd.randint(0, 200_000)), rnd.choice([0.5, 1.0, 100.0]), rnd.choice([0, 1, 2, 900, 40_000])) for i in range(40)]
    traces += [(90, "A", None, 1.0, 10), (91, "A", ZERO, 0.0, 10), (92, "A", ZERO, 1.0, 1)]
    picks = [(i, rnd.choice(["X.A", "A", "Y.B", "C", None]), ZERO + timedelta(seconds=rnd.choice([rnd.randint(0, 250_000), rnd.random() * 250_000]))) for i in range(200)]
    picks += [(300, "A", None), (301, "A", ZERO)]
    want = []
    for pid, name, at in picks:
        for tid, station, start, rate, npts in traces:
            if None in (name, at, station, start) or not rate or not npts:
                continue
            rel = (at - start) / timedelta(seconds=1)
            if name.split(".")[-1] == station and 0 <= rel <= (npts - 1) / rate:
                want.append((pid, tid, round(rel, 6)))
    p = spark.createDataFrame(picks, "pick_id long, station string, abs_time timestamp")
    t = spark.createDataFrame(traces, "trace_id long, station string, starttime timestamp, sampling_rate double, npts long")
    got = K.picks_on_traces(p, t, cell)
    assert sorted((r["pick_id"], r["trace_id"], round(r["rel_time"], 6)) for r in got.collect()) == sorted(want)
    assert len(want) > 50 and got.columns == ["pick_id", "station", "abs_time", "trace_id", "rel_time"]
