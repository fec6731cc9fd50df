"""Gate rows, reports, bends, rays and scattered grids on small hand-made tables."""

import itertools
import math
import random

import numpy as np
import pytest

from shoalwater.operators import gates, reports, spatial


def test_gate_rows_use_what_was_known_at_issue(spark):
    prof = "station long, day long, depths array<double>, temps array<double>"
    z = [0.0, 1.0, 2.0, 3.0, 4.0]
    falling = [14.0, 13.0, 12.0, 10.0, 9.0]
    f = spark.createDataFrame([(1, 10, 24, z, falling), (2, 10, 24, z, falling), (3, 10, 24, z, falling)], "station long, day long, lead_h int, depths array<double>, temps array<double>")
    obs = spark.createDataFrame([(1, 10, z, falling), (2, 10, z, [None, 13.0, 12.0, 10.0, 9.0]), (3, 10, z, [8.0] * 5)], prof)
    anchors = spark.createDataFrame([(1, 10, 99.0), (1, 6, 1.0), (1, 8, 14.0)], "station long, day long, sst double")
    got = gates.forecast_gate(f, obs.limit(0), obs, anchors, 11.0, 0.0).collect()
    # too few levels and a column colder than the target are no observations; the valid day's anchor is not used
    assert [(r["station"], r["issue"], r["obs_iso"], r["raw_iso"], r["anchor"], r["persist_iso"]) for r in got] == [(1, 9, 2.5, 2.5, "ok", None)]
    assert got[0]["corr_iso"] == 2.5 and got[0]["abs_err"] == 0
    none = gates.forecast_gate(f, obs, obs, anchors.where("day = 10"), 11.0, 0.0).collect()
    assert [(r["anchor"], r["corr_iso"]) for r in none] == [("absent", None)]


def test_greedy_match_brute(spark):
    rnd = random.Random(3)
    truth = {(s, d) for s in "abc" for d in rnd.sample(range(40), 12)}
    found = {(s, d) for s in "abd" for d in rnd.sample(range(40), 12)}
    want = {}
    for s in "abcd":
        free, hits = sorted(d for k, d in found if k == s), 0
        n = sum(k == s for k, _ in found)
        days = sorted(d for k, d in truth if k == s)
        for t in days:
            near = sorted((abs(d - t), d) for d in free if abs(d - t) <= 2)
            if near:
                free.remove(near[0][1])
                hits += 1
        want[s] = (hits, len(days) - hits, n - hits)
    t, f = (spark.createDataFrame(sorted(x), "station string, day long") for x in (truth, found))
    assert {r["station"]: (r["hits"], r["misses"], r["false_alarms"]) for r in reports.greedy_match(t, f, 2).collect()} == want
    r = gates.scorecard(t, f, 107, 2).first()
    assert (r["hits"], r["misses"], r["false_alarms"]) == tuple(map(sum, zip(*want.values())))
    empty = gates.scorecard(t.limit(0), f, 107).first()
    assert empty["pod"] is None and empty["chance_pod"] is None and empty["far"] == 1.0


def test_smoothed_brute(spark):
    rnd = random.Random(4)
    grid = {(r, c): rnd.choice([None, float(rnd.randrange(50))]) for r, c in itertools.product(range(12), range(9))}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in grid.items()], "row long, col long, depth double")
    got = {(x["row"], x["col"]): x["smooth"] for x in spatial.smoothed(df, 1.0).collect()}
    assert set(got) == set(grid)
    for (r, c), v in got.items():
        parts = [(math.exp(-((r - a) ** 2 + (c - b) ** 2) / 2), w) for (a, b), w in grid.items() if w is not None and abs(r - a) <= 4 and abs(c - b) <= 4]
        if v is not None:
            assert v == pytest.approx(sum(k * w for k, w in parts) / sum(k for k, _ in parts), rel=1e-9)
    assert {k for k, v in grid.items() if v is not None} <= {k for k, v in got.items() if v is not None}


def test_bend_of_a_circle_and_a_straight_line(spark):
    rows = [("round", i, i * 8, 30.0, 60 * math.cos(i * 8 / 60), 60 * math.sin(i * 8 / 60)) for i in range(20)]
    rows += [("straight", i, i * 8, 30.0, i * 8.0, 0.0) for i in range(20)] + [("round", 20, 160, None, 5000.0, 5000.0)]
    s = spark.createDataFrame(rows, "river string, idx long, dist_m long, width double, x double, y double")
    radius = {(r["river"], r["idx"]): r["radius"] for r in spatial.bend_radius(s.where("idx < 20"), "x", "y").collect()}
    assert {k for k, _ in radius} == {"round"} and all(abs(v - 60) < 1e-6 for v in radius.values())
    got = spatial.bends(s, "x", "y").collect()
    assert [(r["river"], r["side"]) for r in got] == [("round", "right")] and got[0]["rw"] == pytest.approx(2.0, abs=0.2)
    assert spatial.bends(s.limit(0), "x", "y").count() == 0
    assert spatial.bends(s.selectExpr("*", "true AS suppress"), "x", "y").count() == 0


def test_bearing_points_down_the_slope(spark):
    cells = [(r, c, float(c - r)) for r in range(20) for c in range(20)]  # deepest to the north-east
    p = spark.createDataFrame(cells, "row long, col long, depth double")
    spots = spark.createDataFrame([(1, 10, 10, None), (2, 10, 10, 50), (3, 10, 10, 180), (4, 900, 900, None), (5, 900, 900, 12)], "spot long, row long, col long, hint long")
    got = {r["spot"]: r["bearing"] for r in spatial.offshore_bearing(p, spots, 3).collect()}
    assert got[1] == pytest.approx(45) and got[2] == pytest.approx(45) and got[3] == 180 and got[4] is None and got[5] == 12
    ray = spatial.rays(p, spots.where("spot = 1").selectExpr("spot", "row", "col", "90D AS bearing"), 12).collect()
    assert sorted((r["k"], r["depth"]) for r in ray)[:3] == [(0, 0.0), (1, 1.0), (2, 2.0)] and sum(r["depth"] is None for r in ray) == 3


def test_scattered_never_blends_the_sentinel(spark):
    grid = spark.createDataFrame([(0, c, float(c), 0.0) for c in range(12)], "row long, col long, x double, y double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 1.0, 0.0, 7.0), (3, 6.0, 0.0, None), (4, 7.0, 0.0, None)], "node long, x double, y double, v double")
    got = {r["col"]: r["v"] for r in spatial.scattered(grid, nodes, 3.0, 2).collect()}
    assert got[0] == pytest.approx(5, abs=1e-4) and got[1] == pytest.approx(7, abs=1e-4) and got[6] == got[7] == 999 and got[11] is None
    assert all(v is None or v == 999 or 5 - 1e-9 <= v <= 7 + 1e-9 for v in got.values()) and np.isfinite([v for v in got.values() if v is not None]).all()
