"""Queries over points, polygons, pixels and rivers."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import exprs
from ..operators import events, spatial as ops
from .bindings import FLOWS, NODES, PIXELS, POINTS, RIVER, flows, load, nodes, pixels, points, river
from .registry import query

_KM = "2 * 6371 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"
KM = _KM.format(a="p.lat", b="p.lon", c="n.lat", d="n.lon")


@query("FN-03", f"WITH {POINTS} SELECT point, round({_KM.format(a='lat', b='lon', c='48.4', d='-89.2')}, 6) AS km FROM points")
def fn03(spark, d):
    return points(spark, d).select("point", F.round(exprs.haversine_km("lat", "lon", F.lit(48.4), F.lit(-89.2)), 6).alias("km"))


@query("FN-04", f"WITH {POINTS} SELECT point, round(6378137 * radians(lon), 3) AS x, round(6378137 * ln(tan(0.7853981633974483 + radians(lat) / 2)), 3) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon FROM points")
def fn04(spark, d):
    p = points(spark, d)
    x, y = exprs.mercator("lat", "lon")
    m = p.select("point", x.alias("x"), y.alias("y"))
    lat, lon = exprs.from_mercator("x", "y")
    return m.select("point", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("J-08", f"WITH {POINTS}, {NODES}, m AS (SELECT point, node, {KM} AS km FROM points p JOIN nodes n ON n.depth >= 5 AND abs(p.lat - n.lat) < 0.1 WHERE {KM} <= 10), b AS (SELECT point, min(km) AS km, arg_min(node, (km, node)) AS node FROM m GROUP BY point) SELECT points.point, node, round(km, 6) AS km FROM points LEFT JOIN b USING (point)")
def j08(spark, d):
    return ops.nearest_point(points(spark, d), nodes(spark, d), 10.0, least_depth=5.0).withColumn("km", F.round("km", 6))


def _grid_points(spark, d):
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(k.alias("point"), (k * 7919 % 1000).alias("x"), (k * 104729 % 1000).alias("y"), (k % 3).alias("rank"))


def _boxes(spark, d):
    """Edges of 160-unit boxes on a 5 x 5 layout by nation, with a rank by region."""
    n = F.col("n_nationkey")
    x, y = (n % 5) * 200, F.floor(n / 5) * 200
    corner = lambda a, b: (x + a, y + b)
    ring = [corner(0, 0), corner(160, 0), corner(160, 160), corner(0, 160)]
    edges = F.array(*[F.struct(ring[i][0].cast("long").alias("x1"), ring[i][1].cast("long").alias("y1"), ring[(i + 1) % 4][0].cast("long").alias("x2"), ring[(i + 1) % 4][1].cast("long").alias("y2")) for i in range(4)])
    return load(spark, d, "nation").select(n.alias("polygon"), (F.col("n_regionkey") % 3).alias("rank"), F.explode(edges).alias("e")).select("polygon", "rank", "e.*")


GRID = "g AS (SELECT c_custkey AS point, c_custkey * 7919 % 1000 AS x, c_custkey * 104729 % 1000 AS y, c_custkey % 3 AS rank FROM customer), bx AS (SELECT n_nationkey AS polygon, n_regionkey % 3 AS tile_rank, n_nationkey % 5 * 200 AS bx, n_nationkey // 5 * 200 AS by_ FROM nation)"


@query("J-09", f"WITH {GRID} SELECT point, polygon FROM g JOIN bx ON x >= bx AND x < bx + 160 AND y >= by_ AND y < by_ + 160")
def j09(spark, d):
    return ops.in_polygons(_grid_points(spark, d), _boxes(spark, d).drop("rank"), 100)


@query("SET-03", f"WITH {GRID} SELECT point, rank FROM g WHERE NOT EXISTS (SELECT 1 FROM bx WHERE tile_rank < rank AND x >= bx AND x < bx + 160 AND y >= by_ AND y < by_ + 160)")
def set03(spark, d):
    return ops.outside_earlier(_grid_points(spark, d), _boxes(spark, d), 100).select("point", "rank")


@query("FN-11", "SELECT p_partkey AS polygon, (10 + p_size) * (20 + p_partkey % 90) * 0.75::DOUBLE AS area FROM part")
def fn11(spark, d):
    k, wide, high = F.col("p_partkey"), F.col("p_size") + 10, F.col("p_partkey") % 90 + 20
    x, y = k % 1000, F.floor(k / 1000) * 100
    ring = [(x, y), (x + wide, y), (x + wide, y + high), (x, y + high / 2)]
    edges = F.array(*[F.struct(*[c.cast("double").alias(n) for c, n in zip((*ring[i], *ring[(i + 1) % 4]), ("x1", "y1", "x2", "y2"))]) for i in range(4)])
    return ops.ring_area(load(spark, d, "part").select(k.alias("polygon"), F.explode(edges).alias("e")).select("polygon", "e.*"))


@query("J-10", f"WITH {POINTS}, {NODES} SELECT point, min(node) AS node FROM points p JOIN nodes n ON abs(p.lat - n.lat) <= 800 / 111000.0::DOUBLE AND abs(p.lon - n.lon) <= 800 / 111000.0::DOUBLE / greatest(0.2, cos(radians(p.lat))) GROUP BY point")
def j10(spark, d):
    return ops.box_proximity(points(spark, d), nodes(spark, d), 800.0, cell=0.02)


@query("AGG-40", f"WITH {RIVER}, s AS (SELECT river, idx AS sidx, CASE WHEN width >= 40 THEN 'public' WHEN width >= 20 THEN 'crown' ELSE 'private' END AS class FROM river WHERE idx % 5 = 0) SELECT r.river, class, sum(20)::BIGINT AS metres FROM river r JOIN s ON r.river = s.river AND s.sidx = greatest(5, (r.idx + 2) // 5 * 5) GROUP BY ALL")
def agg40(spark, d):
    r = river(spark, d)
    w = F.col("width")
    samples = r.where("idx % 5 = 0").select("river", F.col("idx").alias("s"), F.when(w >= 40, "public").when(w >= 20, "crown").otherwise("private").alias("class"))
    near = F.greatest(F.lit(5), F.floor((F.col("idx") + 2) / 5) * 5)
    return r.withColumn("s", near).join(samples, ["river", "s"]).groupBy("river", "class").agg(F.sum(F.lit(20)).alias("metres"))


# ------------------------------------------------------------------------------- rasters

_G = """CASE WHEN lag({k}) OVER ({w}) IS NULL THEN (lead(depth) OVER ({w}) - depth) / 10 WHEN lead({k}) OVER ({w}) IS NULL THEN (depth - lag(depth) OVER ({w})) / 10 ELSE (lead(depth) OVER ({w}) - lag(depth) OVER ({w})) / 20 END"""


@query("RAS-01", f"WITH {PIXELS}, g AS (SELECT row, col, depth, {_G.format(k='col', w='PARTITION BY row ORDER BY col')} AS gx, {_G.format(k='row', w='PARTITION BY col ORDER BY row')} AS gy FROM pixels) SELECT row, col, round(CASE WHEN depth IS NOT NULL THEN sqrt(gx * gx + gy * gy) END, 6) AS gradient FROM g")
def ras01(spark, d):
    return ops.gradient(pixels(spark, d), 10.0).withColumn("gradient", F.round("gradient", 6))


@query("RAS-02")
def ras02(spark, d):
    return ops.smoothed(pixels(spark, d), 1.0)


@query("RAS-03", f"WITH {PIXELS}, m AS (SELECT a.row, a.col, avg(b.depth) AS m, any_value(a.depth) AS depth FROM pixels a JOIN pixels b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY ALL) SELECT row, col, round(m - depth, 6) + 0.0 AS relief FROM m")
def ras03(spark, d):
    return ops.relief(pixels(spark, d), 2).withColumn("relief", F.round("relief", 6) + F.lit(0.0))


@query("RAS-04", f"WITH {PIXELS} SELECT row, col, coalesce(CASE WHEN depth <= 5 OR depth >= 40 THEN 0 WHEN depth < 12 THEN (depth - 5) / 7 WHEN depth > 20 THEN (40 - depth) / 20 ELSE 1 END, 0)::DOUBLE AS s FROM pixels")
def ras04(spark, d):
    return pixels(spark, d).select("row", "col", ops.suitability("depth", 5, 12, 20, 40).alias("s"))


@query("RAS-05", f"WITH {PIXELS} SELECT row, col, CASE WHEN depth IS NULL OR depth > 45 THEN 'none' WHEN depth >= 30 THEN 's1' WHEN depth >= 10 THEN 's2' ELSE 's3' END AS tier, (coalesce(depth, 0) >= 10)::INT + (coalesce(depth, 0) >= 20)::INT + (coalesce(depth, 0) >= 30)::INT AS band FROM pixels")
def ras05(spark, d):
    z = F.col("depth")
    tier = F.when(z.isNull() | (z > 45), "none").when(z >= 30, "s1").when(z >= 10, "s2").otherwise("s3")
    band = F.size(F.filter(F.array(*[F.lit(float(x)) for x in (10, 20, 30)]), lambda e: e <= F.coalesce(z, F.lit(0.0))))
    return pixels(spark, d).select("row", "col", tier.alias("tier"), band.alias("band"))


@query("RAS-06", f"WITH {PIXELS}, p AS (SELECT *, (row * 7 + col * 3) % 100 AS dist, row // 10 AS tile FROM pixels) SELECT tile, count(*) FILTER (depth BETWEEN 12 AND 40 AND dist <= 60) > 0 AS any, min(dist) FILTER (depth BETWEEN 12 AND 40 AND dist <= 60) AS nearest, count(*) FILTER (depth BETWEEN 12 AND 40 AND dist <= 60) * 100.0::DOUBLE AS area FROM p GROUP BY tile")
def ras06(spark, d):
    p = pixels(spark, d).withColumns({"dist": (F.col("row") * 7 + F.col("col") * 3) % 100, "tile": F.floor(F.col("row") / 10)})
    return ops.reachable(p, 12, 60, 40, 10.0, "tile")


@query("RAS-07", f"WITH RECURSIVE {PIXELS}, c AS (SELECT row, col FROM pixels WHERE depth >= 20), reach(row, col, label) AS (SELECT row, col, row * 4294967296 + col FROM c UNION SELECT c.row, c.col, reach.label FROM reach JOIN c ON abs(c.row - reach.row) + abs(c.col - reach.col) = 1), l AS (SELECT row, col, min(label) AS label FROM reach GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM l GROUP BY label) SELECT row, col, label, n FROM l JOIN n USING (label) WHERE n >= 10")
def ras07(spark, d):
    return ops.without_small(pixels(spark, d).where("depth >= 20"), 10)


@query("RAS-08", f"WITH {PIXELS} SELECT w.row, w.col, sqrt(min(pow(l.row - w.row, 2) + pow(l.col - w.col, 2))) AS dist FROM pixels w LEFT JOIN pixels l ON l.depth IS NULL AND pow(l.row - w.row, 2) + pow(l.col - w.col, 2) <= 16 WHERE w.depth IS NOT NULL GROUP BY w.row, w.col")
def ras08(spark, d):
    return ops.distance_to_land(pixels(spark, d), 4)


@query("RAS-09", f"WITH {PIXELS}, n AS (SELECT a.row, a.col, count(b.depth) AS n FROM pixels a JOIN pixels b ON abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 WHERE a.depth IS NULL GROUP BY ALL), f AS (SELECT n.row, n.col, arg_min(b.depth, (pow(b.row - n.row, 2) + pow(b.col - n.col, 2), b.row, b.col)) AS filled FROM n JOIN pixels b ON b.depth IS NOT NULL AND pow(b.row - n.row, 2) + pow(b.col - n.col, 2) <= 4 WHERE n.n > 5.4 GROUP BY ALL) SELECT p.row, p.col, coalesce(depth, filled) AS depth, filled IS NOT NULL AS was_gap FROM pixels p LEFT JOIN f ON p.row = f.row AND p.col = f.col")
def ras09(spark, d):
    return ops.fill_gaps(pixels(spark, d), 1, 0.6, 2)


@query("RAS-15", f"WITH {PIXELS}, n AS (SELECT a.row, a.col, count(b.depth) AS n FROM pixels a JOIN pixels b ON abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 WHERE a.depth IS NULL GROUP BY ALL), f AS (SELECT n.row, n.col, arg_min(b.depth, (pow(b.row - n.row, 2) + pow(b.col - n.col, 2), b.row, b.col)) AS filled FROM n JOIN pixels b ON b.depth IS NOT NULL AND pow(b.row - n.row, 2) + pow(b.col - n.col, 2) <= 4 WHERE n.n > 6.3 GROUP BY ALL), z AS (SELECT p.row, p.col, coalesce(depth, filled) AS depth, filled IS NOT NULL AS was_gap FROM pixels p LEFT JOIN f ON p.row = f.row AND p.col = f.col), w AS (SELECT w.row, w.col, sqrt(min(pow(l.row - w.row, 2) + pow(l.col - w.col, 2))) AS dist FROM z w LEFT JOIN z l ON l.depth IS NULL AND pow(l.row - w.row, 2) + pow(l.col - w.col, 2) <= 16 WHERE w.depth IS NOT NULL GROUP BY w.row, w.col) SELECT z.row, z.col, depth, was_gap, dist FROM z LEFT JOIN w USING (row, col)")
def ras15(spark, d):
    filled = ops.fill_gaps(pixels(spark, d), 1, 0.7, 2)
    return filled.join(ops.distance_to_land(filled, 4), ["row", "col"], "left").select("row", "col", "depth", "was_gap", "dist")


# ------------------------------------------------------------------------------- rivers

SLOPE = f"{RIVER}, sl AS (SELECT *, CASE WHEN count(z_cm) OVER f >= 3 THEN -regr_slope(z_cm / 100, dist_m) OVER f * 1000 END AS slope FROM river WINDOW f AS (PARTITION BY river ORDER BY dist_m RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING))"


@query("W-17", f"WITH {SLOPE} SELECT river, idx, round(slope, 4) AS slope FROM sl")
def w17(spark, d):
    return ops.reach_slope(river(spark, d), 200).select("river", "idx", F.round("slope", 4).alias("slope"))


@query("W-18", f"WITH {RIVER} SELECT river, idx, (lead(width) OVER w - lag(width) OVER w) / (lead(dist_m) OVER w - lag(dist_m) OVER w) AS dwds FROM river WINDOW w AS (PARTITION BY river ORDER BY idx)")
def w18(spark, d):
    return ops.central_difference(river(spark, d), "width", "dwds").select("river", "idx", "dwds")


@query("W-19", f"WITH {RIVER}, v AS (SELECT *, dist_m - lag(dist_m, 2) OVER w AS ax, width - lag(width, 2) OVER w AS ay, lead(dist_m, 2) OVER w - dist_m AS bx, lead(width, 2) OVER w - width AS by_ FROM river WINDOW w AS (PARTITION BY river ORDER BY idx)), c AS (SELECT river, idx, CASE WHEN sqrt(ax * ax + ay * ay) > 1 AND sqrt(bx * bx + by_ * by_) > 1 THEN (ax * by_ - ay * bx) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_)) END AS curv FROM v) SELECT river, idx, round(curv, 9) + 0.0 AS curv, CASE WHEN abs(curv) >= 0.15 THEN CASE WHEN curv > 0 THEN 'right' ELSE 'left' END END AS side FROM c")
def w19(spark, d):
    return ops.curvature(river(spark, d), "dist_m", "width").select("river", "idx", (F.round("curv", 9) + F.lit(0.0)).alias("curv"), "side")


@query("W-21", f"WITH {RIVER}, l AS (SELECT river, idx, list_sort(list(width) OVER (PARTITION BY river ORDER BY dist_m RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING)) AS v FROM river) SELECT river, idx, v[len(v) // 2 + 1] AS median FROM l")
def w21(spark, d):
    return ops.running_median(river(spark, d), "width", 100).select("river", "idx", "median")


@query("W-22", f"""WITH {RIVER}, r AS (SELECT river, idx, dist_m, CASE WHEN idx % 7 > 3 OR idx % 50 = 0 THEN width END AS v FROM river), k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN dist_m END) OVER (PARTITION BY river ORDER BY idx ROWS UNBOUNDED PRECEDING) AS a, min(CASE WHEN v IS NOT NULL THEN dist_m END) OVER (PARTITION BY river ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM r)
SELECT k.river, k.idx, round(coalesce(k.v, CASE WHEN z - a <= 80 THEN ra.v + (k.dist_m - a) / (z - a)::DOUBLE * (rz.v - ra.v) END), 6) AS filled FROM k LEFT JOIN r ra ON ra.river = k.river AND ra.dist_m = a LEFT JOIN r rz ON rz.river = k.river AND rz.dist_m = z""")
def w22(spark, d):
    r = river(spark, d).withColumn("v", F.when((F.col("idx") % 7 > 3) | (F.col("idx") % 50 == 0), F.col("width")))
    return ops.gap_fill(r, "v", 80).select("river", "idx", F.round("filled", 6).alias("filled"))


@query("W-23", f"WITH {RIVER} SELECT river, idx, dist_m, ahead_m FROM (SELECT *, min(CASE WHEN width >= 47 THEN dist_m END) OVER (PARTITION BY river ORDER BY dist_m RANGE BETWEEN 1 FOLLOWING AND 150 FOLLOWING) AS ahead_m FROM river) WHERE width <= 11")
def w23(spark, d):
    r = river(spark, d).withColumns({"barrier": F.col("width") <= 11, "pool": F.col("width") >= 47})
    return ops.first_ahead(r, "barrier", "pool", 150)


LABELS = f"{RIVER}, lb AS (SELECT river, idx, CASE WHEN width < 12 THEN 'unknown' WHEN width < 35 THEN 'riffle' ELSE 'pool' END AS label FROM river)"


@query("W-08", f"WITH {LABELS}, g AS (SELECT *, row_number() OVER (PARTITION BY river ORDER BY idx) - row_number() OVER (PARTITION BY river, label ORDER BY idx) AS g FROM lb) SELECT river, label, min(idx) AS start, max(idx) + 1 AS stop FROM g WHERE label <> 'unknown' GROUP BY river, label, g HAVING count(*) >= 3")
def w08(spark, d):
    w = F.col("width")
    rows = river(spark, d).select("river", "idx", F.when(w < 12, "unknown").when(w < 35, "riffle").otherwise("pool").alias("label"))
    return ops.spans(rows, "label", 3)


@query("W-28", f"WITH {RIVER}, v AS (SELECT river, dist_m * 3 // 2 + idx % 3 AS at_m, width AS v FROM river), s AS (SELECT *, lead(at_m) OVER w AS z_m, lead(v) OVER w AS z_v FROM v WINDOW w AS (PARTITION BY river ORDER BY at_m)), e AS (SELECT *, unnest(range(((at_m + 24) // 25 * 25)::BIGINT, z_m::BIGINT, 25)) AS m FROM s WHERE z_m > at_m) SELECT river, m, round(v + (m - at_m) / (z_m - at_m)::DOUBLE * (z_v - v), 6) AS v FROM e")
def w28(spark, d):
    v = river(spark, d).select("river", (F.floor(F.col("dist_m") * 3 / 2) + F.col("idx") % 3).alias("at_m"), F.col("width").alias("v"))
    return ops.densify(v, 25).withColumn("v", F.round("v", 6))


_D = "pow(q * {n} / (width * sqrt(slope / 1000)), 0.6)"
_FR = "q / (width * {d}) / sqrt(9.81 * {d})"
HYD = f"""{SLOPE}, qs AS (SELECT sl.*, 5 + idx % 40 AS q, slope AS s0 FROM sl), dp AS (SELECT *, abs(z_cm / 100 - 990) <= 0.5 AS backwater, CASE WHEN q > 0 AND width > 0 AND slope > 0 THEN {_D.format(n=0.035)} END AS d, CASE WHEN slope > 0 THEN {_D.format(n=0.025)} END AS dlo, CASE WHEN slope > 0 THEN {_D.format(n=0.07)} END AS dhi FROM qs),
fr AS (SELECT river, idx, backwater, CASE WHEN NOT backwater AND d / width >= 0.002 THEN d END AS depth, CASE WHEN NOT backwater AND d / width >= 0.002 THEN {_FR.format(d='d')} END AS froude, CASE WHEN NOT backwater AND d / width >= 0.002 THEN {_FR.format(d='dhi')} END AS lo, CASE WHEN NOT backwater AND d / width >= 0.002 THEN {_FR.format(d='dlo')} END AS hi FROM dp)"""


@query("RAS-13", f"WITH {HYD} SELECT river, idx, round(depth, 4) AS depth, round(froude, 4) AS froude, CASE WHEN backwater THEN 'backwater' WHEN froude IS NULL THEN 'unknown' WHEN lo > 1 THEN 'supercritical' WHEN hi < 1 THEN 'subcritical' ELSE 'transitional' END AS state FROM fr")
def ras13(spark, d):
    r = ops.reach_slope(river(spark, d), 200).withColumn("q", F.lit(5) + F.col("idx") % 40)
    return ops.hydraulics(r, "q", 990.0).select("river", "idx", F.round("depth", 4).alias("depth"), F.round("froude", 4).alias("froude"), "state")


@query("PF-19", f"WITH {HYD} SELECT CASE WHEN backwater THEN 'backwater' WHEN froude IS NULL THEN 'unknown' WHEN lo > 1 THEN 'supercritical' WHEN hi < 1 THEN 'subcritical' ELSE 'transitional' END AS state, count(*) AS n FROM fr GROUP BY ALL")
def pf19(spark, d):
    r = ops.reach_slope(river(spark, d), 200).withColumn("q", F.lit(5) + F.col("idx") % 40)
    return ops.hydraulics(r, "q", 990.0).groupBy("state").agg(F.count("*").alias("n"))


@query("RAS-14", f"WITH {SLOPE}, s4 AS (SELECT river, round(slope, 4) AS slope FROM sl), e AS (SELECT river, round(quantile_cont(slope, 0.25), 6) AS p25, round(quantile_cont(slope, 0.9), 6) AS p90, round(quantile_cont(slope, 0.99), 6) AS p99 FROM s4 GROUP BY river) SELECT s4.river, CASE WHEN slope IS NULL THEN 'unknown' WHEN slope >= p99 THEN 'barrier' WHEN slope >= p90 THEN 'rapid' WHEN slope <= p25 THEN 'pool' ELSE 'riffle' END AS class, count(*) AS n FROM s4 JOIN e ON s4.river = e.river GROUP BY ALL")
def ras14(spark, d):
    r = ops.reach_slope(river(spark, d), 200).withColumn("slope", F.round("slope", 4))
    edges = r.groupBy("river").agg(F.percentile("slope", F.array(*[F.lit(x) for x in (0.25, 0.9, 0.99)])).alias("p"))
    s, p = F.col("slope"), [F.round(F.col("p")[i], 6) for i in range(3)]
    label = F.when(s.isNull(), "unknown").when(s >= p[2], "barrier").when(s >= p[1], "rapid").when(s <= p[0], "pool").otherwise("riffle")
    return r.join(edges, "river").groupBy("river", label.alias("class")).agg(F.count("*").alias("n"))


LEAPS = [("steelhead", 3.4), ("coho", 2.2), ("chinook", 2.4), ("walleye", 0.6)]


@query("FN-10", f"WITH {RIVER}, s AS (SELECT river, idx, (lag(z_cm) OVER w - z_cm) / 2 AS drop_m, width FROM river WINDOW w AS (PARTITION BY river ORDER BY idx)), l(species, leap) AS (VALUES ('steelhead', 3.4::DOUBLE), ('coho', 2.2), ('chinook', 2.4), ('walleye', 0.6)) SELECT river, idx, species, CASE WHEN drop_m IS NULL OR drop_m < 0 THEN NULL WHEN CASE WHEN width >= 15 THEN drop_m * 2 ELSE drop_m END <= leap THEN 'pass' ELSE 'barrier' END AS verdict FROM s, l")
def fn10(spark, d):
    w = W.partitionBy("river").orderBy("idx")
    s = river(spark, d).withColumn("drop_m", (F.lag("z_cm").over(w) - F.col("z_cm")) / 2)
    leaps = spark.createDataFrame(LEAPS, "species string, leap double")
    return s.join(F.broadcast(leaps)).select("river", "idx", "species", ops.passable(F.col("drop_m"), F.col("width"), F.col("leap")).alias("verdict"))


@query("W-07", f"""WITH {FLOWS}, f AS (SELECT gauge, day, q > 7 AS ok FROM flows), g AS (SELECT *, row_number() OVER (PARTITION BY gauge ORDER BY day) - row_number() OVER (PARTITION BY gauge, ok ORDER BY day) AS g, min(day) OVER (PARTITION BY gauge) AS first FROM f) SELECT gauge, min(day) AS start_day, max(day) AS end_day, count(*) AS n, min(day) = any_value(first) AS open_now FROM g WHERE ok GROUP BY gauge, g""")
def w07(spark, d):
    f = flows(spark, d).select(F.col("gauge").alias("station"), "day", (F.col("q") > 7).alias("ok"))
    first = f.groupBy("station").agg(F.min("day").alias("first"))
    runs = events.islands(f, "ok", ["day"], 1000).groupBy("station", "island").agg(F.min("day").alias("start_day"), F.max("day").alias("end_day"), F.count("*").alias("n"))
    return runs.join(first, "station").select(F.col("station").alias("gauge"), "start_day", "end_day", "n", (F.col("start_day") == F.col("first")).alias("open_now"))


@query("W-25", f"WITH {FLOWS}, m AS (SELECT gauge, q, day % 97 AS t, avg(q) OVER w AS mq, avg(day % 97) OVER w AS mt, count(*) OVER w AS n FROM flows WINDOW w AS (PARTITION BY gauge ORDER BY day ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING)) SELECT gauge, count(*) AS n, round(corr(q - mq, t - mt), 6) AS r FROM m WHERE n >= 30 GROUP BY gauge")
def w25(spark, d):
    w = W.partitionBy("gauge").orderBy("day").rowsBetween(-30, 29)
    m = flows(spark, d).withColumn("t", F.col("day") % 97)
    m = m.withColumns({"aq": F.col("q") - F.avg("q").over(w), "at": F.col("t") - F.avg("t").over(w), "k": F.count("*").over(w)}).where("k >= 30")
    return m.groupBy("gauge").agg(F.count("*").alias("n"), F.round(F.corr("aq", "at"), 6).alias("r"))


@query("W-26", f"WITH {FLOWS}, m AS (SELECT gauge, year(DATE '1970-01-01' + day::INT) AS year, max(q) OVER (PARTITION BY gauge ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - q AS drop_ FROM flows) SELECT gauge, year, max(drop_) AS drop FROM m GROUP BY ALL")
def w26(spark, d):
    w = W.partitionBy("gauge").orderBy("day").rowsBetween(-2, 0)
    m = flows(spark, d).withColumn("drop", F.max("q").over(w) - F.col("q"))
    return m.groupBy("gauge", F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))).alias("year")).agg(F.max("drop").alias("drop"))


@query("SET-04", f"WITH {FLOWS}, o AS (SELECT gauge, day, q, 'obs' AS kind FROM flows WHERE day <= 10500 + length(gauge) * 10), e AS (SELECT gauge, max(day) AS last FROM o GROUP BY gauge) SELECT * FROM o UNION ALL SELECT f.gauge, f.day, f.q * 1.1::DOUBLE, 'forecast' FROM flows f JOIN e ON f.gauge = e.gauge AND f.day > last")
def set04(spark, d):
    f = flows(spark, d)
    obs = f.where(F.col("day") <= F.lit(10500) + F.length("gauge") * 10).withColumn("kind", F.lit("obs"))
    last = obs.groupBy("gauge").agg(F.max("day").alias("last"))
    ahead = f.join(last, "gauge").where("day > last").select("gauge", "day", (F.col("q") * 1.1).alias("q"), F.lit("forecast").alias("kind"))
    return obs.unionByName(ahead)
