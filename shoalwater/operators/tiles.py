"""Rasters as tiles: pixels(tr, tc, row, col, ...) with a halo of neighbours, so that no step sees a whole row or column.

A raster is one row a pixel. ``haloed`` gives every pixel to the tile that owns it and, as a copy, to each tile whose
halo it lies in; one shuffle then serves windows along rows and along columns, and array kernels that run on a tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import pin
from . import graph

#: Pixels of a tile's side.
SIZE = 256


def tile(column: str, size: int = SIZE) -> Column:
    return F.floor(F.col(column) / size).cast("long")


def haloed(pixels: DataFrame, halo: int, size: int = SIZE) -> DataFrame:
    """``pixels`` with tr and tc, the tile that a copy is for, dealt by tile. ``owned`` tells the owner's copy."""
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / size).cast("long"), F.floor((F.col(c) + halo) / size).cast("long")))
    return pixels.withColumn("tr", spread("row")).withColumn("tc", spread("col")).repartition("tr", "tc")


def owned(size: int = SIZE) -> Column:
    return (F.col("tr") == tile("row", size)) & (F.col("tc") == tile("col", size))


def lines(along: str) -> W:
    """The pixels of a tile's row (along col) or column (along row), in order."""
    return W.partitionBy("tr", "tc", "col" if along == "row" else "row").orderBy(along)


def _kernel(pixels: DataFrame, columns: list[str], run: Callable, schema: str) -> DataFrame:
    """``run(tile row, tile column, row, col, *columns)`` as numpy arrays on each tile, giving the columns of ``schema``."""
    names = [f.split()[0] for f in schema.split(", ")]

    def on_tile(key, t):
        args = [t[c].to_numpy() for c in ("row", "col", *columns)]
        return pa.table(dict(zip(names, map(pa.array, run(key[0].as_py(), key[1].as_py(), *args)))))

    return pixels.select("tr", "tc", F.col("row").cast("long"), F.col("col").cast("long"), *columns).groupBy("tr", "tc").applyInArrow(on_tile, schema)


# ------------------------------------------------------------------ distance


def squared_distances(hit: np.ndarray, limit: int) -> np.ndarray:
    """Squared distance of each cell to the nearest hit, more than ``limit`` squared where there is none so near.

    Two separable passes: the distance along columns by a running count from both sides, then along rows the
    lower envelope of the parabolas that stand on those, taken at the offsets within the limit.
    """
    far = limit + 1
    up = np.full(hit.shape, far, np.int64)
    for order in (range(len(hit)), range(len(hit) - 1, -1, -1)):
        now = np.full(hit.shape[1], far, np.int64)
        for r in order:
            now = np.where(hit[r], 0, np.minimum(now + 1, far))
            up[r] = np.minimum(up[r], now)
    tall = np.where(up > limit, far * far, up * up)
    best = tall.copy()
    for k in range(1, min(limit, hit.shape[1] - 1) + 1):
        best[:, k:] = np.minimum(best[:, k:], tall[:, :-k] + k * k)
        best[:, :-k] = np.minimum(best[:, :-k], tall[:, k:] + k * k)
    return best


def distance_to(pixels: DataFrame, hit: Column, limit: int, size: int = SIZE) -> DataFrame:
    """Euclidean distance in pixels to the nearest pixel with ``hit``: row, col, dist; 0 on a hit, null beyond the limit.

    Exact: a tile's halo is as wide as the limit. The work of a pixel grows with the limit, not with its square.
    """

    def run(tr, tc, row, col, hit):
        grid = np.zeros((size + 2 * limit, size + 2 * limit), bool)
        r, c = row - (tr * size - limit), col - (tc * size - limit)
        grid[r[hit], c[hit]] = True
        own = (r >= limit) & (r < size + limit) & (c >= limit) & (c < size + limit)
        d2 = squared_distances(grid, limit)[r[own], c[own]]
        return row[own], col[own], np.where(d2 > limit * limit, -1, d2)

    flagged = pixels.select("row", "col", F.coalesce(hit, F.lit(False)).alias("hit"))
    got = _kernel(haloed(flagged, limit, size), ["hit"], run, "row long, col long, d2 long")
    return got.select("row", "col", F.when(F.col("d2") >= 0, F.sqrt("d2")).alias("dist"))


# ------------------------------------------------------------------ components and their attributes


def _label(on: np.ndarray) -> np.ndarray:
    """4-connected components of a boolean grid: for each cell that is on, the flat index of its component's first cell; else -1."""
    h, w = on.shape
    starts = on & ~np.concatenate((np.zeros((h, 1), bool), on[:, :-1]), axis=1)
    run = np.cumsum(starts.ravel()).reshape(h, w) - 1
    touch = on[:-1] & on[1:]
    root = list(range(int(starts.sum())))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in np.unique(np.stack((run[:-1][touch], run[1:][touch])), axis=1).T.tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    first = np.flatnonzero(starts.ravel())
    to = np.array([first[find(a)] for a in range(len(root))], np.int64)
    return np.where(on, to[np.clip(run, 0, None)] if len(to) else -1, -1)


def components(pixels: DataFrame, size: int = SIZE) -> DataFrame:
    """4-connected components of the given pixels: row, col, label (smallest row * 2^32 + col).

    A tile labels its own pixels; only labels that touch across a border are links of a graph, so the graph has about
    a perimeter's share of the pixels, and its components join the tiles' labels.
    """

    def run(tr, tc, row, col):
        grid = np.zeros((size, size), bool)
        r, c = row - tr * size, col - tc * size
        grid[r, c] = True
        at = _label(grid)[r, c]
        return row, col, ((at // size + tr * size) << 32) + at % size + tc * size

    local = pin(_kernel(haloed(pixels.select("row", "col"), 0, size), [], run, "row long, col long, piece long"), "pieces")
    edge = lambda c, at: F.pmod(F.col(c), F.lit(size)) == at
    pairs = []
    for c in ("row", "col"):
        before = local.where(edge(c, size - 1)).select(*[(F.col(x) + (1 if x == c else 0)).alias(x) for x in ("row", "col")], F.col("piece").alias("b"))
        pairs.append(local.where(edge(c, 0)).join(before, ["row", "col"]).select(F.col("piece").alias("a"), "b"))
    links = pin(pairs[0].union(pairs[1]).distinct(), "links")
    if links.isEmpty():
        return local.withColumnRenamed("piece", "label")
    found = graph.components(links).select(F.col("node").alias("piece"), "component")
    return local.join(found, "piece", "left").select("row", "col", F.coalesce("component", "piece").alias("label"))


def opened(pixels: DataFrame) -> DataFrame:
    """Binary opening by the 4-neighbour cross: pixels in a cross that lies within the set; outside the grid counts as unset."""
    cross = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])
    spread = pixels.withColumn("o", F.explode(cross)).groupBy((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col")).agg(F.count("*").alias("n"))
    core = spread.where("n = 5").select("row", "col")
    return core.withColumn("o", F.explode(cross)).select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col")).distinct()


def genuine_land(pixels: DataFrame, land: Column, shallow_m: float = 2.5, least_px: int = 12, mainland_only: bool = True, inferred: bool = True, value: str = "depth", size: int = SIZE) -> DataFrame:
    """Pixels of real, walk-to land: row, col.

    A component of ``land`` counts if it has ``least_px`` pixels and, where land is only ``inferred`` from missing depth,
    borders water shallower than ``shallow_m`` (a hole in the survey borders deep water). With ``mainland_only``, components
    that reach the grid's border are taken, if there are any; islands and shoals then give no shore. Inferred land is opened, which
    removes slivers of one or two pixels.
    """
    ground = pixels.where(F.coalesce(land, F.lit(False))).select("row", "col")
    labelled = pin(components(ground, size), "land")
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least_px)
    if inferred:
        cross = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0))])
        beside = labelled.withColumn("o", F.explode(cross)).select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), "label").distinct()
        coast = beside.join(pixels.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("_v")), ["row", "col"]).groupBy("label").agg(F.min("_v").alias("least"))
        sizes = sizes.join(coast.where(F.col("least") < shallow_m), "label", "left_semi")
    if mainland_only:
        box = pixels.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
        rim = labelled.join(F.broadcast(box)).where("row IN (r0, r1) OR col IN (c0, c1)").select("label").distinct()
        main = pin(sizes.join(rim, "label", "left_semi"), "mainland")
        sizes = sizes if main.isEmpty() else main
    kept = labelled.join(sizes.select("label"), "label", "left_semi").select("row", "col")
    return opened(kept) if inferred else kept


def shore_distance(pixels: DataFrame, ground: DataFrame, limit: int, size: int = SIZE) -> DataFrame:
    """row, col, land and dist, in pixels to the nearest of the land pixels ``ground``; null beyond the limit."""
    marked = pixels.select("row", "col").join(ground.select("row", "col").withColumn("_g", F.lit(True)), ["row", "col"], "left")
    return distance_to(marked, F.col("_g"), limit, size).withColumn("land", F.coalesce(F.col("dist") == 0, F.lit(False)))


# ------------------------------------------------------------------ masks and edges

#: Pixels of a mask tile's side: a row of one is a 64-bit word.
MASK = 64


def mask_tiles(kept: DataFrame) -> DataFrame:
    """The pixels (row, col) of a mask as bitmaps: tr, tc and the words of the tile's rows by row, a map of at most 64."""
    word = kept.groupBy(tile("row", MASK).alias("tr"), tile("col", MASK).alias("tc"), F.pmod("row", F.lit(MASK)).alias("r")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(col, {MASK}) AS INT))")).alias("w"))
    words = F.map_from_entries(F.collect_list(F.struct(F.col("r").cast("int").alias("r"), "w")))
    return word.groupBy("tr", "tc").agg(words.alias("words"))


def keep(pixels: DataFrame, mask: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """The rows of ``pixels`` (row, col, ...) whose bit is set in ``mask`` (of ``mask_tiles``) and for which ``where`` holds.

    The caller gives a mask, a predicate on the rows' own columns, both or neither. Pixels meet bitmaps by tile: a mask of
    any size is joined, not listed, and a tile without bits keeps nothing.
    """
    own = pixels.columns
    if where is not None:
        pixels = pixels.where(where)
    if mask is None:
        return pixels
    at = pixels.withColumns({"_tr": tile("row", MASK), "_tc": tile("col", MASK)}).join(mask.select(F.col("tr").alias("_tr"), F.col("tc").alias("_tc"), F.col("words").alias("_words")), ["_tr", "_tc"])
    word = F.coalesce(F.try_element_at("_words", F.pmod("row", F.lit(MASK)).cast("int")), F.lit(0).cast("long"))
    return at.where(F.getbit(word, F.pmod("col", F.lit(MASK)).cast("int")) == 1).select(*own)


def shore_edges(pixels: DataFrame, value: str = "depth", mask: DataFrame | None = None, where: Column | None = None, size: int = SIZE) -> DataFrame:
    """Unit edges between water and land (null) pixels that touch: row, col of the land pixel, dr, dc, the step from the water into
    it, and the edge's two corners i0, j0, i1, j1 (corner (i, j) is the upper left one of pixel (i, j)).

    Edges are kept by their land pixel, as ``keep`` says.
    """
    tiled = haloed(pixels.select("row", "col", F.col(value).isNotNull().alias("water")), 1, size)
    found = []
    for along, dr, dc in (("col", 0, 1), ("row", 1, 0)):
        w = lines(along)
        pair = tiled.withColumns({"next": F.lead("water").over(w), "gap": F.lead(along).over(w) - F.col(along)}).where(owned(size) & (F.col("gap") == 1) & (F.col("next") != F.col("water")))
        ahead = F.col("water")  # then the next pixel is the land
        sign = F.when(ahead, 1).otherwise(-1)
        found.append(pair.select((F.col("row") + F.when(ahead, dr).otherwise(0)).alias("row"), (F.col("col") + F.when(ahead, dc).otherwise(0)).alias("col"), (sign * dr).alias("dr"), (sign * dc).alias("dc"), (F.col("row") + dr).alias("i0"), (F.col("col") + dc).alias("j0"), (F.col("row") + 1).alias("i1"), (F.col("col") + 1).alias("j1")))
    return keep(found[0].union(found[1]), mask, where)
