"""Nearest fault segments on the grid, against numpy over all pairs."""

import numpy as np
import pytest

from quakelake.operators import catalog as C

SEGMENT = "segment_id long, lon1 double, lat1 double, lon2 double, lat2 double"
EVENT = "event_id long, longitude double, latitude double"


def brute(events, segments):
    s = np.array([r[1:] for r in segments])
    out = {}
    for i, lon, lat in events:
        if lon is None or lat is None:
            out[i] = (None, None)
            continue
        k = np.cos(np.radians(lat))
        ax, ay = (s[:, 0] - lon) * k, s[:, 1] - lat
        dx, dy = (s[:, 2] - s[:, 0]) * k, s[:, 3] - s[:, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.clip(np.nan_to_num(-(ax * dx + ay * dy) / (dx * dx + dy * dy)), 0, 1)
        km = np.hypot(ax + t * dx, ay + t * dy) * 111.0
        at = min(range(len(s)), key=lambda j: (km[j], segments[j][0]))
        out[i] = (km[at], segments[at][0])
    return out


@pytest.mark.parametrize("kind", ["dense", "sparse", "far"])
def test_grid_against_all_pairs(spark, kind):
    rng = np.random.default_rng(8)
    n = {"dense": 5_000, "sparse": 60, "far": 40}[kind]
    start = rng.uniform([-20, -60], [30, 70], (n, 2)) if kind != "far" else rng.uniform([170, -80], [180, -70], (n, 2))
    step = rng.normal(size=(n, 2)) * rng.choice([0.02, 0.5, 6.0], (n, 1), p=[0.9, 0.08, 0.02])
    segments = [(i, *map(float, a), *map(float, a + b)) for i, (a, b) in enumerate(zip(start, step))]
    segments += [(n, 0.0, 0.0, 0.0, 0.0), (n + 1, 5.0, 5.0, 9.0, 5.0), (n + 2, -3.0, -4.0, -3.0, 6.0)]
    events = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-25, -75], [35, 75], (150, 2)))]
    events += [(500, None, 1.0), (501, 1.0, None), (502, 0.0, 0.0), (503, 5.0, 5.0), (504, -179.9, 89.9)]
    rows = segments + [(n + 9, 1.0, None, 2.0, 2.0)]
    got = C.nearest_fault(spark.createDataFrame(events, EVENT), spark.createDataFrame(rows, SEGMENT), max_rows=5).collect()
    want = brute(events, segments)
    assert len(got) == len(events)
    for r in got:
        km, segment = want[r["event_id"]]
        if km is None:
            assert r["fault_km"] is None and r["segment_id"] is None
        else:
            assert r["fault_km"] == pytest.approx(km, rel=1e-9, abs=1e-9)
            assert r["segment_id"] == segment or abs(km - r["fault_km"]) < 1e-9
