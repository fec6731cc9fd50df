"""Profiles from the shore, seams, corrected depth with and without a mask, and file digests."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalwater.operators import spatial
from shoalwater.sources import landed


def brute_profile(depth, r, c, bearing, res, step, n):
    th = math.radians(bearing)
    dr, dc = -math.cos(th), math.sin(th)

    def at(j):
        y, x = round(r + dr * step * j), round(c + dc * step * j)
        return depth[y, x] if 0 <= y < depth.shape[0] and 0 <= x < depth.shape[1] and not math.isnan(depth[y, x]) else None

    back = 0
    while back < n and at(-back - 1) is not None:
        back += 1
    out = [(0, 0.0, 0.0)]
    for k in range(1, n + 1):
        if (v := at(k - back)) is None:
            break
        out.append((k, k * step * res, v))
    return out


def test_shore_profiles(spark):
    rng = np.random.default_rng(4)
    ramp = np.array([[(c - 10) * 0.5 if c > 10 else np.nan for c in range(40)]] * 40)
    ramp[rng.random((40, 40)) < 0.03] = np.nan
    pixels = spark.createDataFrame([(r, c, None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(ramp)], "row long, col long, depth double")
    spots = [(i, int(rng.integers(0, 40)), int(rng.integers(8, 40)), float(rng.integers(0, 360)) + 0.25) for i in range(60)] + [(90, 20, 15, 90.0), (91, 20, 15, None), (92, 500, 500, 10.0)]
    table = spark.createDataFrame(spots, "spot int, row long, col long, bearing double")
    got = {}
    for x in spatial.shore_profiles(pixels, table, 10.0, 1.0, 25).collect():
        got.setdefault(x["spot"], []).append((x["k"], x["dist_m"], x["depth"]))
    for i, r, c, b in spots:
        assert sorted(got.get(i, [])) == ([] if b is None else brute_profile(ramp, r, c, b, 10.0, 1.0, 25)), i
    due_east = sorted(got[90])
    assert all(z[2] > a[2] for a, z in zip(due_east, due_east[1:])) and due_east[0] == (0, 0.0, 0.0)


def test_seams_tell_kinds_apart(spark):
    v = [1.0, 1.0, 0.5, 0.1, None, 0.1, 0.9, 0.9]
    w = [10.0, 20.0, 30.0, 20.0, 10.0, 10.0, 10.0, 10.0]
    rows = [("r", i, 10.0 * i, v[i], w[i], (0.6, -0.6, 0.1, None)[i % 4]) for i in range(8)]
    got = [r["seams"] for r in spatial.seams(spark.createDataFrame(rows, "river string, idx int, dist_m double, velocity double, width double, curv double"), 0.02, 0.5, 0.9).orderBy("idx").collect()]
    assert got == [["seam_bend_right"], ["seam_decel", "seam_bend_left", "seam_expansion"], ["seam_decel"], ["seam_constriction"], ["seam_bend_right"], ["seam_bend_left"], ["seam_accel"], []]


def test_pool_note(spark):
    rows = spark.createDataFrame([(0.1, 1.0, 2.0), (0.3, 1.0, 2.0), (0.1, 1.0, None), (0.0, 1.0, 2.0), (0.1, None, 2.0)], "s double, m double, d double")
    assert [r[0] for r in rows.select(spatial.pool_note(F.col("s"), F.col("m"), F.col("d"))).collect()] == ["lower bound", "", "", "", ""]


def test_corrected_degrades_by_pixel(spark):
    """With a mask a hole in the water is bridged; without one it counts as land, and says so."""
    grid = np.full((24, 24), 8.0)
    grid[:, :4] = np.nan
    grid[10:12, 12:14] = np.nan
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)]
    pixels = spark.createDataFrame(rows, "row long, col long, depth double")
    mask = pixels.select("row", "col", (F.col("col") >= 4).alias("water"))
    of = lambda m, **k: {(r["row"], r["col"]): r for r in spatial.corrected(pixels, m, 2, 30, **k).collect()}
    good, none = of(mask), of(mask.limit(0), least_px=3, mainland_only=False)
    assert good[10, 12]["depth"] == 8.0 and good[10, 12]["was_gap"] and good[10, 12]["dist"] == 9.0 and not good[10, 12]["degraded"]
    assert none[10, 12]["depth"] is None and none[10, 12]["dist"] == 0.0 and all(r["degraded"] for r in none.values()) and none[10, 15]["dist"] == 2.0
    assert good[0, 0]["dist"] == 0.0 and len(good) == len(none) == 576


def _write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text)
    return str(root)


def test_fingerprint(spark, tmp_path):
    files = {f"{'ab'[i % 2]}/{i}.txt": bytes([i]) * i for i in range(20)}
    one = landed.fingerprint(spark, _write(tmp_path / "one", files))
    same = landed.fingerprint(spark, "file://" + _write(tmp_path / "two", dict(reversed(files.items()))))
    assert one == same and len(one) == 12 and set(one) <= set("0123456789abcdef")
    for name, change in (("byte", {"a/2.txt": b"\x02\x03"}), ("path", {"a/x.txt": files["a/2.txt"]}), ("more", {"a/x.txt": b"\n"})):
        other = files | change
        if name == "path":
            other.pop("a/2.txt")
        assert landed.fingerprint(spark, _write(tmp_path / name, other)) != one


def test_merkle_finds_what_differs(spark):
    files = spark.range(500).selectExpr("concat('d', id % 7, '/', id) AS path", "repeat('x', id % 9) AS content")
    a, b = ({r["bucket"]: r["digest"] for r in landed.merkle(f.repartition(n)).collect()} for f, n in ((files, 3), (files.withColumn("content", F.when(F.col("path") == "d3/3", "y").otherwise(F.col("content"))), 5)))
    assert a.keys() == b.keys() and sum(a[k] != b[k] for k in a) == 2 and a[""] != b[""]
    assert a == {r["bucket"]: r["digest"] for r in landed.merkle(files.orderBy(F.rand(1))).collect()}
    assert [r["n"] for r in landed.merkle(files.limit(0)).collect()] == [0]


@pytest.mark.parametrize("content", [None, ""])
def test_merkle_of_missing_content(spark, content):
    files = spark.createDataFrame([("p", content)], "path string, content string")
    assert landed.merkle(files).count() == 2


@pytest.mark.parametrize("metres", [50.0, 250.0, 5000.0])
def test_box_proximity_at_any_reach_and_latitude(spark, metres):
    rng = np.random.default_rng(1)
    at = lambda n: [(i, float(lat), float(lon)) for i, (lat, lon) in enumerate(zip(rng.choice([48.0, 70.0, 82.0], n) + rng.random(n) * 0.2, rng.random(n) * 0.4 - 90))]
    points, others = at(300), at(300)
    d = metres / 111_000
    want = {}
    for i, lat, lon in points:
        w = d / max(0.2, math.cos(math.radians(lat)))
        near = [j for j, a, b in others if abs(a - lat) <= d and abs(b - lon) <= w]
        if near:
            want[i] = min(near)
    got = {r["point"]: r["node"] for r in spatial.box_proximity(spark.createDataFrame(points, "point int, lat double, lon double"), spark.createDataFrame(others, "node int, lat double, lon double"), metres).collect()}
    assert got == want
