"""Queries over tiled rasters: real land and its shore, corrected depth, masks, shore edges, profiles; seams; fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial, tiles
from ..sources import landed
from .bindings import PIXELS, RIVER, load, pixels, river
from .queries_gates import _SPOTS, _spots
from .registry import query

_STRIP = "(col < 3 + row % 3 OR (row % 20 BETWEEN 5 AND 9 AND col BETWEEN 20 AND 24))"
_COAST = f"px AS (SELECT p_partkey AS k, p_partkey // 50 AS row, p_partkey % 50 AS col, p_size FROM part), cx AS (SELECT k, row, col, {_STRIP} AS land, CASE WHEN NOT {_STRIP} AND k % 13 <> 0 THEN p_size::DOUBLE END AS depth FROM px)"
_NEAR = "abs(a.row - b.row) + abs(a.col - b.col)"


def _coast(spark, d):
    """Pixels with a mainland along the left edge, islands, and single pixels without depth: row, col, k, land, depth."""
    p = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), "p_size")
    land = (F.col("col") < 3 + F.col("row") % 3) | ((F.col("row") % 20).between(5, 9) & F.col("col").between(20, 24))
    return p.withColumn("land", land).withColumn("depth", F.when(~F.col("land") & (F.col("k") % 13 != 0), F.col("p_size").cast("double")))


def _labels(ground: str) -> str:
    return f"reach(row, col, label) AS (SELECT row, col, row * 4294967296 + col FROM {ground} UNION SELECT a.row, a.col, b.label FROM reach b JOIN {ground} a ON {_NEAR} = 1), l AS (SELECT row, col, min(label) AS label FROM reach GROUP BY ALL), n AS (SELECT label FROM l GROUP BY label HAVING count(*) >= 12)"


@query("RAS-08-land", f"""WITH RECURSIVE {_COAST}, g AS (SELECT row, col FROM cx WHERE depth IS NULL), {_labels('g')},
c AS (SELECT label FROM l a JOIN cx b ON {_NEAR} = 1 AND b.depth IS NOT NULL GROUP BY label HAVING min(b.depth) < 2.5), k AS (SELECT row, col FROM l WHERE label IN (FROM n) AND label IN (FROM c)),
core AS (SELECT a.row, a.col FROM k a JOIN k b ON {_NEAR} <= 1 GROUP BY ALL HAVING count(*) = 5), o AS (SELECT DISTINCT a.row, a.col FROM k a JOIN core b ON {_NEAR} <= 1)
SELECT a.row, a.col, sqrt(min(pow(a.row - b.row, 2) + pow(a.col - b.col, 2))) AS dist, count(*) FILTER (a.row = b.row AND a.col = b.col) > 0 AS land FROM cx a LEFT JOIN o b ON pow(a.row - b.row, 2) + pow(a.col - b.col, 2) <= 1600 GROUP BY ALL""")
def ras08_land(spark, d):
    p = _coast(spark, d)
    ground = tiles.genuine_land(p, F.col("depth").isNull(), mainland_only=False)
    return tiles.shore_distance(p, ground, 40).select("row", "col", "dist", "land")


@query("RAS-15-corrected", f"""WITH RECURSIVE {_COAST}, kn AS (SELECT *, CASE WHEN k % 11 <> 0 THEN NOT land END AS water FROM cx), g AS (SELECT row, col FROM kn WHERE NOT coalesce(water, depth IS NOT NULL)), {_labels('g')},
b AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM cx), m AS (SELECT DISTINCT label FROM l, b WHERE label IN (FROM n) AND (row IN (r0, r1) OR col IN (c0, c1))), k AS (SELECT row, col FROM l WHERE label IN (FROM m) OR (label IN (FROM n) AND NOT EXISTS (FROM m))),
f AS (SELECT a.row, a.col, arg_min(b.depth, (pow(a.row - b.row, 2) + pow(a.col - b.col, 2), b.row, b.col)) AS filled FROM kn a JOIN kn b ON b.depth IS NOT NULL AND pow(a.row - b.row, 2) + pow(a.col - b.col, 2) <= 4 WHERE a.water AND a.depth IS NULL GROUP BY ALL),
s AS (SELECT a.row, a.col, sqrt(min(pow(a.row - b.row, 2) + pow(a.col - b.col, 2))) AS dist FROM kn a JOIN k b ON pow(a.row - b.row, 2) + pow(a.col - b.col, 2) <= 144 GROUP BY ALL)
SELECT row, col, coalesce(depth, filled) AS depth, filled IS NOT NULL AS was_gap, dist, water IS NULL AS degraded FROM kn LEFT JOIN f USING (row, col) LEFT JOIN s USING (row, col)""")
def ras15_corrected(spark, d):
    p = _coast(spark, d)
    mask = p.where("k % 11 <> 0").select("row", "col", (~F.col("land")).alias("water"))
    return spatial.corrected(p.select("row", "col", "depth"), mask, 2, 12)


@query("UDF-02", f"""WITH {_COAST}, e AS (SELECT b.row, b.col, b.row - a.row AS dr, b.col - a.col AS dc, greatest(a.row, b.row) AS i0, greatest(a.col, b.col) AS j0, b.k FROM cx a JOIN cx b ON {_NEAR} = 1 WHERE a.depth IS NOT NULL AND b.depth IS NULL)
SELECT e.row, e.col, dr, dc, i0, j0, CASE WHEN dr <> 0 THEN i0 ELSE i0 + 1 END AS i1, CASE WHEN dr <> 0 THEN j0 + 1 ELSE j0 END AS j1 FROM e JOIN px USING (k) WHERE p_size % 3 = 0 AND e.col >= 10""")
def udf02(spark, d):
    p = _coast(spark, d)
    return tiles.shore_edges(p, mask=tiles.mask_tiles(p.where("p_size % 3 = 0").select("row", "col")), where=F.col("col") >= 10)


@query("RAS-12-profile", f"""WITH {PIXELS}, {_SPOTS}, j AS (SELECT spot, j, round_even(row - cos(radians(coalesce(hint, 45))) * j * 0.75, 0)::BIGINT AS row, round_even(col + sin(radians(coalesce(hint, 45))) * j * 0.75, 0)::BIGINT AS col FROM spots, (SELECT unnest(range(-20, 21)) AS j)),
v AS (SELECT spot, j, depth FROM j LEFT JOIN pixels USING (row, col)), m AS (SELECT spot, coalesce(-max(j) FILTER (j < 0 AND depth IS NULL) - 1, 20) AS m FROM v GROUP BY spot), e AS (SELECT spot, m, min(j) FILTER (j > -m AND depth IS NULL) AS stop FROM v JOIN m USING (spot) GROUP BY ALL)
SELECT spot, j + m AS k, (j + m) * 7.5::DOUBLE AS dist_m, CASE WHEN j + m = 0 THEN 0 ELSE depth END AS depth FROM v JOIN e USING (spot) WHERE j + m BETWEEN 0 AND 20 AND (stop IS NULL OR j < stop)""")
def ras12_profile(spark, d):
    spots = _spots(spark, d).withColumn("bearing", F.coalesce("hint", F.lit(45)).cast("double"))
    return spatial.shore_profiles(pixels(spark, d), spots, 10.0, 0.75, 20)


_SEAM = f"""{RIVER}, s AS (SELECT *, 5 + idx % 40 AS q, CASE WHEN count(z_cm) OVER f >= 3 THEN -regr_slope(z_cm / 100, dist_m) OVER f * 1000 END AS slope, (idx * 10)::DOUBLE AS x, (idx % 16 * (16 - idx % 16) * CASE WHEN idx % 32 < 16 THEN 1 ELSE -1 END)::DOUBLE AS y FROM river WINDOW f AS (PARTITION BY river ORDER BY dist_m RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING)),
h AS (SELECT *, CASE WHEN width > 0 AND slope > 0 THEN pow(q * 0.035 / (width * sqrt(slope / 1000)), 0.6) END AS d FROM s), v AS (SELECT *, CASE WHEN NOT abs(z_cm / 100 - 990) <= 0.5 AND d / width >= 0.002 THEN d END AS depth FROM h), u AS (SELECT *, q / (width * depth) AS velocity, avg(slope) OVER (PARTITION BY river) AS mean_slope FROM v),
t AS (SELECT *, x - lag(x, 2) OVER w AS u1, y - lag(y, 2) OVER w AS u2, lead(x, 2) OVER w - x AS w1, lead(y, 2) OVER w - y AS w2, (lead(velocity) OVER w - lag(velocity) OVER w) / (lead(dist_m) OVER w - lag(dist_m) OVER w) AS dvds, (lead(width) OVER w - lag(width) OVER w) / (lead(dist_m) OVER w - lag(dist_m) OVER w) AS dwds FROM u WINDOW w AS (PARTITION BY river ORDER BY idx)),
c AS (SELECT *, CASE WHEN sqrt(u1 * u1 + u2 * u2) > 1 AND sqrt(w1 * w1 + w2 * w2) > 1 THEN (u1 * w2 - u2 * w1) / (sqrt(u1 * u1 + u2 * u2) * sqrt(w1 * w1 + w2 * w2)) END AS curv FROM t)
SELECT river, idx, round(dvds, 5) AS dvds, round(dwds, 5) AS dwds, CASE WHEN depth IS NOT NULL AND slope > 0 AND mean_slope > 0 AND slope < 0.25 * mean_slope THEN 'lower bound' ELSE '' END AS note,
array_to_string(list_filter([CASE WHEN abs(dvds) >= 0.0123457 THEN CASE WHEN dvds < 0 THEN 'seam_decel' ELSE 'seam_accel' END END, CASE WHEN abs(curv) >= 0.2234567 THEN CASE WHEN curv < 0 THEN 'seam_bend_left' ELSE 'seam_bend_right' END END, CASE WHEN abs(dwds) >= 0.4321 THEN CASE WHEN dwds < 0 THEN 'seam_constriction' ELSE 'seam_expansion' END END], lambda z: z IS NOT NULL), ',') AS seams FROM c"""


@query("RAS-13-seams", f"WITH {_SEAM}")
def ras13_seams(spark, d):
    i = F.col("idx") % 16
    r = spatial.reach_slope(river(spark, d), 200).withColumns({"q": F.lit(5) + F.col("idx") % 40, "x": (F.col("idx") * 10).cast("double"), "y": (i * (16 - i) * F.when(F.col("idx") % 32 < 16, 1).otherwise(-1)).cast("double")})
    mean = r.groupBy("river").agg(F.avg("slope").alias("mean_slope"))
    state = spatial.curvature(spatial.hydraulics(r, "q", 990.0), "x", "y").join(mean, "river")
    s = spatial.seams(state, 0.0123457, 0.2234567, 0.4321)
    return s.select("river", "idx", F.round("dvds", 5).alias("dvds"), F.round("dwds", 5).alias("dwds"), spatial.pool_note(F.col("slope"), F.col("mean_slope"), F.col("depth")).alias("note"), F.array_join("seams", ",").alias("seams"))


@query("SRC-22", """WITH f AS (SELECT coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS content FROM documents), x AS (SELECT left(sha256(path), 3) AS bucket, path, sha256(path || content) AS leaf FROM f),
b AS (SELECT bucket, count(*) AS n, sha256(string_agg(leaf, '' ORDER BY path)) AS digest FROM x GROUP BY bucket) FROM b UNION ALL SELECT '', sum(n)::BIGINT, sha256(string_agg(digest, '' ORDER BY bucket)) FROM b""")
def src22(spark, d):
    """The documents as a listing of files, one path each."""
    part = lambda c: F.coalesce(F.col(c), F.lit("none"))
    path = F.concat(part("lang"), F.lit("/"), part("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return landed.merkle(load(spark, d, "documents").select(path.alias("path"), F.col("text").alias("content")))
