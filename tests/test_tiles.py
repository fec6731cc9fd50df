"""Tiled rasters beside brute force on grids that cross many tiles."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalwater.operators import spatial, tiles


def frame(spark, grid):
    """Pixels of a grid; NaN is null."""
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)]
    return spark.createDataFrame(rows, "row long, col long, depth double").repartition(4)


def random_grid(seed, h, w, share):
    rng = np.random.default_rng(seed)
    grid = rng.integers(1, 40, (h, w)).astype(float)
    grid[rng.random((h, w)) < share] = np.nan
    return grid


def brute_labels(on):
    out = {}
    for r, c in zip(*map(np.ndarray.tolist, np.nonzero(on))):
        if (r, c) in out:
            continue
        todo = deque([(r, c)])
        out[r, c] = (r << 32) + c
        while todo:
            y, x = todo.popleft()
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= p[0] < on.shape[0] and 0 <= p[1] < on.shape[1] and on[p] and p not in out:
                    out[p] = (r << 32) + c
                    todo.append(p)
    return out


@pytest.mark.parametrize("seed, size", [(1, 8), (2, 16), (3, 256)])
def test_components(spark, seed, size):
    grid = random_grid(seed, 45, 38, 0.42)
    got = {(r["row"], r["col"]): r["label"] for r in tiles.components(frame(spark, grid).where("depth IS NOT NULL"), size).collect()}
    assert got == brute_labels(~np.isnan(grid))


def test_long_thin_shapes(spark):
    """A comb whose teeth pass through many tiles is one component; so is a spiral."""
    comb = np.full((60, 61), np.nan)
    comb[:, ::4] = 1
    comb[59, :] = 1
    comb[0, 2] = 1
    got = tiles.components(frame(spark, comb).where("depth IS NOT NULL"), 8).groupBy("label").count().collect()
    assert sorted(r["count"] for r in got) == [1, int(np.nansum(comb)) - 1]
    assert tiles.components(frame(spark, comb).limit(0), 8).count() == 0


def test_distance_equals_brute_force_at_limit_40(spark):
    grid = random_grid(7, 70, 66, 0.004)
    land = np.argwhere(np.isnan(grid))
    got = {(r["row"], r["col"]): r["dist"] for r in tiles.distance_to(frame(spark, grid), F.col("depth").isNull(), 40, 16).collect()}
    for p in np.ndindex(grid.shape):
        d2 = ((land - p) ** 2).sum(1).min()
        assert got[p] == (np.sqrt(d2) if d2 <= 1600 else None)
    one = {(r["row"], r["col"]): r["dist"] for r in spatial.distance_to_land(frame(spark, grid), 40).collect()}
    assert one == {p: d for p, d in got.items() if not np.isnan(grid[p])}


def brute_land(grid, shallow, least, mainland, size_of=None):
    nodata, keep = np.isnan(grid), np.zeros(grid.shape, bool)
    labels = brute_labels(nodata)
    groups = {}
    for p, k in labels.items():
        groups.setdefault(k, []).append(p)
    h, w = grid.shape
    good = {}
    for k, own in groups.items():
        ring = [grid[q] for y, x in own for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if 0 <= q[0] < h and 0 <= q[1] < w and not np.isnan(grid[q])]
        if len(own) >= least and ring and min(ring) < shallow:
            good[k] = any(y in (0, h - 1) or x in (0, w - 1) for y, x in own)
    if mainland and any(good.values()):
        good = {k: v for k, v in good.items() if v}
    for k in good:
        for p in groups[k]:
            keep[p] = True
    pad = np.pad(keep, 2)
    core = pad[1:-1, 1:-1] & pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:]
    core = np.pad(core, 1)
    return (core[1:-1, 1:-1] | core[:-2, 1:-1] | core[2:, 1:-1] | core[1:-1, :-2] | core[1:-1, 2:])[1:-1, 1:-1]


@pytest.mark.parametrize("mainland", [True, False])
def test_land_filter(spark, mainland):
    """Mainland at the edge, an island, a speck, a deep hole in the survey and a sliver."""
    grid = np.full((40, 44), 9.0)
    grid[:, :6] = np.nan
    grid[:, 6] = 1.0
    grid[20:25, 20:25] = np.nan
    grid[19, 20:25] = 2.0
    grid[3:5, 30:32] = np.nan
    grid[2, 30] = 0.5
    grid[30:36, 30:36] = np.nan
    grid[10, 6:14] = np.nan
    got = {(r["row"], r["col"]) for r in tiles.genuine_land(frame(spark, grid), F.col("depth").isNull(), mainland_only=mainland, size=8).collect()}
    want = brute_land(grid, 2.5, 12, mainland)
    assert got == set(map(tuple, np.argwhere(want).tolist()))
    assert ((22, 22) in got) is not mainland and (32, 32) not in got and (3, 30) not in got and (10, 12) not in got
    near = {(r["row"], r["col"]): (r["dist"], r["land"]) for r in tiles.shore_distance(frame(spark, grid), tiles.genuine_land(frame(spark, grid), F.col("depth").isNull(), mainland_only=mainland, size=8), 12, 8).collect()}
    ground = np.argwhere(want)
    for p in np.ndindex(grid.shape):
        d2 = ((ground - p) ** 2).sum(1).min()
        assert near[p] == ((np.sqrt(d2) if d2 <= 144 else None), bool(want[p]))


def test_island_only_lake_keeps_its_islands(spark):
    grid = np.full((30, 30), 1.0)
    grid[10:15, 10:15] = np.nan
    assert tiles.genuine_land(frame(spark, grid), F.col("depth").isNull(), size=8).count() == brute_land(grid, 2.5, 12, True).sum() > 0


def test_keep_mask_and_predicate(spark):
    rng = np.random.default_rng(3)
    chosen = {(int(r), int(c)) for r, c in rng.integers(-70, 150, (4000, 2))}
    mask = tiles.mask_tiles(spark.createDataFrame(sorted(chosen), "row long, col long"))
    pixels = spark.range(220 * 220).selectExpr("id DIV 220 - 70 AS row", "id % 220 - 70 AS col", "id AS v")
    got = {(r["row"], r["col"]) for r in tiles.keep(pixels, mask).collect()}
    assert got == {p for p in chosen if -70 <= p[0] < 150 and -70 <= p[1] < 150}
    both = {(r["row"], r["col"]) for r in tiles.keep(pixels, mask, F.col("v") % 2 == 0).collect()}
    assert both == {(r, c) for r, c in got if ((r + 70) * 220 + c + 70) % 2 == 0} and tiles.keep(pixels).columns == ["row", "col", "v"]


def test_shore_edges(spark):
    grid = random_grid(5, 21, 19, 0.3)
    want = set()
    for r, c in np.ndindex(grid.shape):
        for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            y, x = r + dr, c + dc
            if 0 <= y < 21 and 0 <= x < 19 and not np.isnan(grid[r, c]) and np.isnan(grid[y, x]):
                i0, j0 = (max(r, y), c) if dr else (r, max(c, x))
                want.add((y, x, dr, dc, i0, j0, i0 + (not dr), j0 + (not dc)))
    # an edge's corners: along a column border from (r, c) down, along a row border from (r, c) to the right
    got = {tuple(r) for r in tiles.shore_edges(frame(spark, grid), size=8).collect()}
    assert got == want
    kept = tiles.shore_edges(frame(spark, grid), where=F.col("row") > 9, size=8).count()
    assert kept == sum(e[0] > 9 for e in want)


@pytest.mark.parametrize("radius", [1, 3])
def test_box_mean_and_gradient_do_not_depend_on_tiles(spark, radius):
    pixels = frame(spark, random_grid(9, 33, 29, 0.2))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spatial.box_mean(pixels, radius, size=8)) == rows(spatial.box_mean(pixels, radius, size=512))
    assert rows(spatial.gradient(pixels, 10.0, size=8)) == rows(spatial.gradient(pixels, 10.0, size=512))
