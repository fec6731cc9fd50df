"""Queries over vertical profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as ops
from .bindings import PROFILES, profiles
from .registry import query

SEG = f"{PROFILES}, seg AS (SELECT node, depth AS z0, temp AS t0, lead(depth) OVER w AS z1, lead(temp) OVER w AS t1 FROM levels WINDOW w AS (PARTITION BY node ORDER BY depth))"


def D():
    return F.col("depths")


def T():
    return F.col("temps")


@query("ARR-01", f"WITH {PROFILES}, p AS (SELECT node, depth / 20 * (30 + node % 5) AS z, temp FROM levels), s AS (SELECT node, z AS z0, temp AS t0, lead(z) OVER w AS z1, lead(temp) OVER w AS t1, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY node ORDER BY z)), q(target) AS (VALUES (1.0::DOUBLE), (6.0), (40.0)), e AS (SELECT node, min(z0) AS top, max(z0) AS bottom, arg_min(t0, z0) AS tt, arg_max(t0, z0) AS tb FROM s GROUP BY node), h AS (SELECT node, target, arg_min(t0 + (target - z0) / (z1 - z0) * (t1 - t0), z0) AS t FROM s JOIN q ON target BETWEEN z0 AND z1 GROUP BY ALL) SELECT e.node, q.target, round(CASE WHEN q.target < top THEN tt WHEN q.target > bottom THEN tb ELSE t END, 6) AS temp, q.target < top OR q.target > bottom AS clamped FROM e CROSS JOIN q LEFT JOIN h ON e.node = h.node AND q.target = h.target")
def arr01(spark, d):
    sig = F.transform(D(), lambda z: -z / 20)
    p = profiles(spark, d).withColumn("depths", ops.layer_depths(sig, F.lit(30.0), (F.col("node") % 5).cast("double"))).withColumn("target", F.explode(F.array(*[F.lit(x) for x in (1.0, 6.0, 40.0)])))
    at = ops.at_depth(D(), T(), F.col("target"))
    return p.select("node", "target", at.alias("a")).select("node", "target", F.round("a.temp", 6).alias("temp"), "a.clamped")


@query("ARR-02", f"WITH {SEG} SELECT l.node, round(arg_min(t0 + (7.5 - z0) / (z1 - z0) * (t1 - t0), z0), 6) AS temp, NULL::DOUBLE AS beyond FROM (SELECT DISTINCT node FROM levels) l JOIN seg ON seg.node = l.node AND 7.5 BETWEEN z0 AND z1 GROUP BY l.node")
def arr02(spark, d):
    return profiles(spark, d).select("node", F.round(ops.at_depth(D(), T(), F.lit(7.5), clamp=False)["temp"], 6).alias("temp"), ops.at_depth(D(), T(), F.lit(65.5), clamp=False)["temp"].alias("beyond"))


def _crossing_sql(op: str, t: float) -> str:
    return f"f AS (SELECT node, arg_min(temp, depth) AS first, min(depth) AS top FROM levels GROUP BY node), h AS (SELECT node, min(z0 + ({t} - t0) / (t1 - t0) * (z1 - z0)) AS z FROM seg WHERE NOT t0 {op} {t} AND t1 {op} {t} GROUP BY node) SELECT f.node, round(CASE WHEN first {op} {t} THEN top ELSE z END, 6) AS depth, CASE WHEN first {op} {t} AND first <> {t} THEN 'above_top' WHEN first = {t} OR z IS NOT NULL THEN 'crossing' ELSE 'below_bottom' END AS status FROM f LEFT JOIN h USING (node)"


@query("ARR-03", f"WITH {SEG}, {_crossing_sql('<=', 10.0)}")
def arr03(spark, d):
    return profiles(spark, d).select("node", ops.crossing(D(), T(), 10.0).alias("c")).select("node", F.round("c.depth", 6).alias("depth"), "c.status")


@query("ARR-03-warm", f"WITH {SEG}, {_crossing_sql('>=', 15.0)}")
def arr03_warm(spark, d):
    return profiles(spark, d).select("node", ops.crossing(D(), T(), 15.0, colder=False).alias("c")).select("node", F.round("c.depth", 6).alias("depth"), "c.status")


@query("ARR-04", f"WITH {SEG}, f AS (SELECT node, arg_min(temp, depth) AS first, min(depth) AS d0 FROM levels GROUP BY node), h AS (SELECT node, arg_min(z0 + (13 - t0) / (t1 - t0) * (z1 - z0), z0) AS z FROM seg WHERE t0 <> t1 AND 13 BETWEEN least(t0, t1) AND greatest(t0, t1) GROUP BY node), r AS (SELECT f.node, CASE WHEN 13 <= first THEN d0 ELSE z END AS dist FROM f LEFT JOIN h USING (node)) SELECT node, round(dist, 6) AS dist, CASE WHEN dist IS NULL THEN 'no reach' WHEN dist <= 4 THEN 'in range' ELSE 'too far' END AS verdict FROM r")
def arr04(spark, d):
    dist = ops.depth_to_distance(D(), T(), F.lit(13.0))
    r = profiles(spark, d).select("node", dist.alias("dist"))
    return r.select("node", F.round("dist", 6).alias("dist"), F.when(F.col("dist").isNull(), "no reach").when(F.col("dist") <= 4, "in range").otherwise("too far").alias("verdict"))


def _band_sql(name: str, deep: float) -> str:
    return f"""c_{name} AS (SELECT node, depth, temp - 1.5 + (1.5 - {deep}) * greatest(0, least(1, depth / 6.0::DOUBLE)) AS t FROM levels), s_{name} AS (SELECT node, depth AS z0, t AS t0, lead(depth) OVER w AS z1, lead(t) OVER w AS t1 FROM c_{name} WINDOW w AS (PARTITION BY node ORDER BY depth)), f_{name} AS (SELECT node, arg_min(t, depth) AS first, min(depth) AS top FROM c_{name} GROUP BY node),
h_{name} AS (SELECT node, min(z0 + (10 - t0) / (t1 - t0) * (z1 - z0)) AS z FROM s_{name} WHERE NOT t0 <= 10 AND t1 <= 10 GROUP BY node), {name} AS (SELECT f.node, CASE WHEN first <= 10 THEN top ELSE z END AS depth, CASE WHEN first < 10 THEN 'above_top' WHEN first = 10 OR z IS NOT NULL THEN 'crossing' ELSE 'below_bottom' END AS status FROM f_{name} f LEFT JOIN h_{name} USING (node))"""


@query("ARR-05", f"WITH {PROFILES}, {_band_sql('mid', 3.31)}, {_band_sql('low', 1.51)}, {_band_sql('high', 5.55)} SELECT mid.node, round(mid.depth, 6) AS depth, mid.status, round(least(low.depth, high.depth), 6) AS shallow, round(greatest(low.depth, high.depth), 6) AS deep FROM mid JOIN low USING (node) JOIN high USING (node)")
def arr05(spark, d):
    out = ops.isotherm_band(profiles(spark, d), 10.0, 1.5, (3.31, 1.51, 5.55))
    return out.withColumns({c: F.round(c, 6) for c in ("depth", "shallow", "deep")})


@query("ARR-06", f"WITH {SEG}, g AS (SELECT node, arg_min(abs((t1 - t0) / (z1 - z0)), z0) AS g FROM seg WHERE 6.5 BETWEEN z0 AND z1 GROUP BY node) SELECT node, round(g, 6) AS gradient, round(CASE WHEN g >= 0.05 AND 1.4 / g <= 15 THEN 1.4 / g END, 6) AS metres, CASE WHEN g < 0.05 THEN 'mixed' WHEN 1.4 / g > 15 THEN 'over maximum' END AS reason FROM g")
def arr06(spark, d):
    r = profiles(spark, d).select("node", ops.local_gradient(D(), T(), F.lit(6.5)).alias("g"))
    return r.select("node", F.round("g", 6).alias("gradient"), ops.depth_uncertainty(1.4, F.col("g")).alias("u")).select("node", "gradient", F.round("u.metres", 6).alias("metres"), "u.reason")


@query("ARR-07", f"WITH {PROFILES} SELECT depth, round(avg(temp), 6) AS temp, count(*) AS n FROM levels WHERE abs(node % 1440 * 60000000 - 43200000000) <= 21600000000 GROUP BY depth")
def arr07(spark, d):
    p = profiles(spark, d).select((F.col("node") % 1440 * 60_000_000).alias("us"), F.explode(F.arrays_zip("depths", "temps")).alias("l")).select("us", F.col("l.depths").alias("depth"), F.col("l.temps").alias("temp"))
    return ops.mean_near(p, 43_200_000_000, 21_600_000_000).withColumn("temp", F.round("temp", 6))


@query("AGG-21", f"WITH {PROFILES}, m AS (SELECT label % 6 AS half_month, depth, avg(temp) AS temp FROM levels WHERE depth <= 12 GROUP BY ALL), levels2 AS (SELECT half_month AS node, depth, temp FROM m), s AS (SELECT node, depth AS z0, temp AS t0, lead(depth) OVER w AS z1, lead(temp) OVER w AS t1 FROM levels2 WINDOW w AS (PARTITION BY node ORDER BY depth)), f AS (SELECT node, arg_min(temp, depth) AS first, min(depth) AS top, count(*) AS n, avg(temp) FILTER (depth <= 3) AS surface FROM levels2 GROUP BY node HAVING count(*) >= 3), h AS (SELECT node, min(z0 + (12 - t0) / (t1 - t0) * (z1 - z0)) AS z FROM s WHERE NOT t0 <= 12 AND t1 <= 12 GROUP BY node) SELECT f.node AS half_month, n, round(surface, 6) AS surface, round(CASE WHEN first <= 12 THEN top ELSE z END, 6) AS isotherm_m FROM f LEFT JOIN h USING (node)")
def agg21(spark, d):
    long_ = profiles(spark, d).select((F.col("label") % 6).alias("half_month"), F.explode(F.arrays_zip("depths", "temps")).alias("l")).where("l.depths <= 12")
    mean = long_.groupBy("half_month", F.col("l.depths").alias("z")).agg(F.avg("l.temps").alias("t"))
    p = mean.groupBy("half_month").agg(F.sort_array(F.collect_list(F.struct("z", "t"))).alias("p")).where(F.size("p") >= 3)
    z, t = F.transform("p", lambda x: x["z"]), F.transform("p", lambda x: x["t"])
    surface = F.aggregate(F.slice(t, 1, 3), F.lit(0.0), lambda s, x: s + x) / 3
    return p.select("half_month", F.size("p").alias("n"), F.round(surface, 6).alias("surface"), F.round(ops.crossing(z, t, 12.0)["depth"], 6).alias("isotherm_m"))
