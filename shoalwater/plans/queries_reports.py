"""Queries of the composed reports."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import exprs
from ..operators import events, reports as ops
from .bindings import DAY_US, FLOWS, GATE, HOUR_US, POINTS, READINGS, RIVER, TEMPS, gate_rows, load, points, readings, river, temps
from .queries_events import AT_US, DAILY, DRIVE, IN_SECTOR, daily
from .queries_verify import DRAW, ERR, errors
from .registry import query


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


@query("J-11")
def j11(spark, d):
    days = lambda drop: events.onsets(temps(spark, d), drop, 1.0).select("station", F.floor(F.col("us") / DAY_US).alias("day")).distinct()
    return ops.greedy_match(days(4.0), days(3.0))


@query("J-17", f"WITH {GATE} SELECT site, part, day, lead_h, coalesce(persist, p_retailprice) AS persist FROM gate LEFT JOIN part ON part = p_partkey AND p_size > 25")
def j17(spark, d):
    late = load(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("part"), "p_retailprice")
    return gate_rows(spark, d).join(late, "part", "left").select("site", "part", "day", "lead_h", F.coalesce("persist", "p_retailprice").alias("persist"))


ANCHOR = "a AS (SELECT o_orderkey AS id, month(o_orderdate) AS month, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE (o_orderkey % 20)::VARCHAR END AS cloud, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey * 37 % 300)::VARCHAR END AS dist, (o_orderkey % 12 - 4)::VARCHAR AS delta, CASE WHEN o_custkey % 17 = 0 THEN '' ELSE (o_custkey % 30)::VARCHAR END AS landsat FROM orders)"


@query("PF-05", f"WITH {ANCHOR} SELECT id FROM a WHERE month BETWEEN 7 AND 9 AND CASE WHEN cloud = '' THEN 0 ELSE TRY_CAST(cloud AS DOUBLE) END <= 10 AND coalesce(TRY_CAST(dist AS DOUBLE), 0) <= 150 AND TRY_CAST(delta AS DOUBLE) BETWEEN -3 AND 6 AND TRY_CAST(landsat AS DOUBLE) BETWEEN 2 AND 26")
def pf05(spark, d):
    k, c, text = F.col("o_orderkey"), F.col("o_custkey"), "string"
    cloud = F.when(k % 7 == 0, "").when(k % 11 == 0, "n/a").otherwise((k % 20).cast(text))
    rows = load(spark, d, "orders").select(k.alias("id"), F.month("o_orderdate").alias("month"), cloud.alias("cloud"), F.when(k % 13 != 0, (k * 37 % 300).cast(text)).alias("dist"), (k % 12 - 4).cast(text).alias("delta"), F.when(c % 17 == 0, "").otherwise((c % 30).cast(text)).alias("landsat"))
    return ops.anchor_rows(rows).select("id")


@query("STAT-11", f"""WITH {GATE}, v AS (SELECT year(DATE '1970-01-01' + day::INT) AS year, dayofyear(DATE '1970-01-01' + day::INT) AS doy, avg(obs) AS value FROM gate GROUP BY ALL), o AS (SELECT year, arg_max(doy, (value, doy)) AS doy FROM v WHERE doy BETWEEN 60 AND 300 GROUP BY year), b AS (SELECT year, unnest(range(doy, doy + 7)) AS doy, value FROM v), m AS (SELECT year, doy, avg(value) AS m FROM b GROUP BY ALL HAVING count(*) = 7),
u AS (SELECT year, doy FROM o JOIN m USING (year, doy)), n AS (SELECT doy, row_number() OVER (ORDER BY year) AS k FROM u), w AS (SELECT rep, year, (rep * 7919 + year * 104729 + 1) % 1000003 AS h FROM u, range(1, 501) t(rep)), s AS (SELECT rep, year, row_number() OVER (PARTITION BY rep ORDER BY h * h % 1000003, year) AS k FROM w), p AS (SELECT rep, year, doy FROM s JOIN n USING (k) UNION ALL SELECT 0, year, doy FROM u),
e AS (SELECT rep, stddev_pop(m) AS sd, count(*) AS n FROM p JOIN m USING (year, doy) GROUP BY rep) SELECT z.n, round(z.sd, 6) AS sd, count(*) AS valid, round(avg((e.sd <= z.sd)::INT), 6) AS p FROM e, (SELECT * FROM e WHERE rep = 0 AND n >= 5) z WHERE e.rep > 0 AND e.n = z.n GROUP BY z.n, z.sd""")
def stat11(spark, d):
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))
    days = gate_rows(spark, d).groupBy(F.year(date).alias("year"), F.dayofyear(date).alias("doy")).agg(F.avg("obs").alias("value"))
    onsets = days.where("doy BETWEEN 60 AND 300").groupBy("year").agg(F.max(F.struct("value", "doy"))["doy"].alias("doy"))
    return _rounded(ops.permuted_spread(days, onsets, 500), "sd", "p")


@query("J-18", f"WITH {TEMPS}, {DAILY} SELECT a.day, a.value - b.value AS delta FROM daily a JOIN daily b ON a.day = b.day WHERE a.station = 'view' AND b.station = 'click'")
def j18(spark, d):
    v = daily(spark, d)
    one, two = (v.where(F.col("station") == s).select("day", F.col("value").alias(c)) for s, c in (("view", "x"), ("click", "y")))
    return one.join(two, "day").select("day", (F.col("x") - F.col("y")).alias("delta"))


@query("W-10", f"""WITH {TEMPS}, c AS (SELECT station, arg_min(us, (abs(us - {AT_US}), us, event_id)) AS cu, arg_min(temp_c, (abs(us - {AT_US}), us, event_id)) AS cp FROM temps GROUP BY station), p AS (SELECT t.station, arg_min(t.us, (abs(t.us - (cu - 3 * {HOUR_US})), t.us, event_id)) AS pu, arg_min(temp_c, (abs(t.us - (cu - 3 * {HOUR_US})), t.us, event_id)) AS pp FROM temps t JOIN c USING (station) GROUP BY t.station), r AS (SELECT station, cp, CASE WHEN (cu - pu) / {HOUR_US}.0::DOUBLE >= 1.5 THEN (cp - pp) * (3 / ((cu - pu) / {HOUR_US}.0::DOUBLE)) END AS trend FROM c JOIN p USING (station))
SELECT station, cp AS level, round(trend, 6) + 0.0 AS trend, CASE WHEN trend IS NULL THEN 'unknown' WHEN trend <= -1 THEN 'falling' WHEN trend >= 1 THEN 'rising' ELSE 'steady' END AS state FROM r""")
def w10(spark, d):
    return _rounded(ops.tendency(temps(spark, d), AT_US, "temp_c"), "trend")


@query("W-13", f"WITH {READINGS}, m AS (SELECT event_id, station, avg(sin(radians(dir_deg))) OVER w AS s, avg(cos(radians(dir_deg))) OVER w AS c FROM readings WINDOW w AS (PARTITION BY station ORDER BY us RANGE BETWEEN {6 * HOUR_US} PRECEDING AND {6 * HOUR_US} FOLLOWING)) SELECT event_id, station, round(CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END, 4) AS dir FROM m")
def w13(spark, d):
    return ops.smoothed_direction(readings(spark, d)).withColumn("dir", F.round("dir", 4))


@query("W-27", f"WITH {RIVER}, c AS (SELECT river, idx, sum(10 + width::BIGINT % 7) OVER (PARTITION BY river ORDER BY idx)::BIGINT - 10 AS cum FROM river), t AS (SELECT river, unnest(range(0, max(cum) + 1, 75)) AS cum FROM c GROUP BY river) SELECT t.river, t.cum, c.idx FROM t ASOF LEFT JOIN c ON t.river = c.river AND t.cum >= c.cum")
def w27(spark, d):
    cum = F.sum(F.lit(10) + F.col("width").cast("long") % 7).over(W.partitionBy("river").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)) - 10
    return ops.spaced(river(spark, d).select("river", "idx", cum.alias("cum")), 75)


@query("FN-09", f"""WITH {POINTS}, p AS (SELECT point, lat, lon, unnest([15, 105, 172, 265, 355]) AS doy FROM points), s AS (SELECT *, unnest(range(0, 1440)) AS m FROM p), a AS (SELECT *, radians(-23.44 * cos(2 * pi() / 365 * (doy + 10))) AS decl, radians((m - lon * 4) / 4 - 180 + lon) AS ha FROM s)
SELECT point, doy, min(m) AS rise, max(m) AS sets FROM a WHERE degrees(asin(sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(ha))) >= -0.833 GROUP BY point, doy""")
def fn09(spark, d):
    days = F.explode(F.array(*[F.lit(x) for x in (15, 105, 172, 265, 355)]))
    return ops.light_windows(points(spark, d).withColumn("doy", days))


@query("AGG-23", f"""WITH {ERR}, s AS (SELECT site, day, avg(obs) AS obs, avg(fcst) + 1 AS raw, avg(fcst) AS corr FROM err GROUP BY ALL), l AS (SELECT *, CASE WHEN day - lag(day) OVER w = 1 THEN abs(obs - lag(obs) OVER w) END AS step FROM s WINDOW w AS (PARTITION BY site ORDER BY day))
SELECT site, count(*) AS n, round(avg(abs(raw - obs)), 6) AS raw_mae, round(avg(abs(corr - obs)), 6) AS corr_mae, round(1 - avg(abs(corr - obs)) / avg(abs(raw - obs)), 6) + 0.0 AS skill, round(avg(step), 6) AS day_to_day, count(DISTINCT obs) = 1 AS constant FROM l GROUP BY site""")
def agg23(spark, d):
    s = errors(spark, d).groupBy("site", "day").agg(F.avg("obs").alias("obs"), (F.avg("fcst") + 1).alias("raw"), F.avg("fcst").alias("corr"))
    return _rounded(ops.chain_stats(s, "site"), "raw_mae", "corr_mae", "skill", "day_to_day")


@query("AGG-29", f"WITH {ERR} SELECT lead_h, count(*) AS n, round(avg(abs(f)), 6) AS mae, round(avg(f), 6) + 0.0 AS bias, round(avg(fcst) FILTER (obs BETWEEN 20 AND 40), 6) AS in_fcst, round(avg(obs) FILTER (obs BETWEEN 20 AND 40), 6) AS in_obs FROM err GROUP BY lead_h")
def agg29(spark, d):
    inside = lambda c: F.round(F.avg(F.when(F.col("obs").between(20, 40), F.col(c))), 6)
    return errors(spark, d).groupBy("lead_h").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("f")), 6).alias("mae"), (F.round(F.avg("f"), 6) + F.lit(0.0)).alias("bias"), inside("fcst").alias("in_fcst"), inside("obs").alias("in_obs"))


@query("AGG-31", f"WITH {GATE}, s AS (SELECT site, day, avg(fcst - 25.5) AS m, avg(obs - 25.5) AS t FROM gate GROUP BY ALL), f AS (SELECT site, coalesce(least(3, greatest(1, regr_slope(t, m))), 2.5) AS slope, count(*) AS days, count(*) FILTER (m >= 12) AS alarms FROM s GROUP BY site) SELECT site, round(slope, 6) AS slope, round(1 - pow(1 - alarms / days::DOUBLE, 3), 6) AS chance_pod FROM f")
def agg31(spark, d):
    s = gate_rows(spark, d).groupBy("site", "day").agg(F.avg(F.col("fcst") - 25.5).alias("m"), F.avg(F.col("obs") - 25.5).alias("t"))
    f = s.groupBy("site").agg(F.coalesce(F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.regr_slope("t", "m"))), F.lit(2.5)).alias("slope"), F.count("*").alias("days"), F.count_if(F.col("m") >= 12).alias("alarms"))
    return f.select("site", F.round("slope", 6).alias("slope"), F.round(1 - F.pow(1 - F.col("alarms") / F.col("days"), F.lit(3)), 6).alias("chance_pod"))


@query("AGG-34", f"WITH {GATE}, s AS (SELECT site, day, avg(fcst) AS model, avg(obs) AS truth FROM gate GROUP BY ALL), m AS (SELECT site, quantile_cont(day, 0.5) AS mid FROM s GROUP BY site), f AS (SELECT s.site, regr_slope(truth, model) AS slope, regr_intercept(truth, model) AS i FROM s JOIN m USING (site) WHERE day <= mid GROUP BY s.site) SELECT s.site, round(any_value(slope), 6) AS slope, count(*) AS n, round(avg(abs(i + slope * model - truth)), 6) AS mae FROM s JOIN m USING (site) JOIN f USING (site) WHERE day > mid GROUP BY s.site")
def agg34(spark, d):
    s = gate_rows(spark, d).groupBy("site", "day").agg(F.avg("fcst").alias("model"), F.avg("obs").alias("truth"))
    return _rounded(ops.first_half_fit(s, "site"), "slope", "mae")


@query("AGG-38", f"WITH {FLOWS}, r AS (SELECT gauge, day, q, median(q) OVER (PARTITION BY gauge ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS med, count(q) OVER (PARTITION BY gauge ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS n FROM flows) SELECT gauge, count(*) AS n, round(median(q / med), 6) AS ratio, round(avg((q / med > 1.2)::INT), 6) AS share FROM r WHERE n >= 4 GROUP BY gauge")
def agg38(spark, d):
    from .bindings import flows

    w = W.partitionBy("gauge").orderBy("day").rangeBetween(-7, -1)
    r = flows(spark, d).withColumns({"med": F.percentile("q", F.lit(0.5)).over(w), "k": F.count("q").over(w)}).where("k >= 4")
    ratio = F.col("q") / F.col("med")
    return r.groupBy("gauge").agg(F.count("*").alias("n"), F.round(F.median(ratio), 6).alias("ratio"), F.round(F.avg((ratio > 1.2).cast("int")), 6).alias("share"))


@query("AGG-45", """SELECT 'documents with a text' AS name, count(text)::DOUBLE AS value, CASE WHEN count(text) >= 100 THEN 'pass' ELSE 'warn' END AS verdict FROM documents UNION ALL SELECT 'share of labels', avg((quality = 1)::INT), CASE WHEN avg((quality = 1)::INT) BETWEEN 0.5 AND 0.8 THEN 'pass' ELSE 'warn' END FROM labels UNION ALL SELECT 'largest quantity', max(l_quantity), CASE WHEN max(l_quantity) <= 50 THEN 'pass' ELSE 'warn' END FROM lineitem""")
def agg45(spark, d):
    v = lambda low, high: F.col("value").between(low, high)
    docs, labels, items = (load(spark, d, t) for t in ("documents", "labels", "lineitem"))
    return ops.audit({"documents with a text": (docs, F.count("text"), v(100, 1e18)), "share of labels": (labels, F.avg((F.col("quality") == 1).cast("int")), v(0.5, 0.8)), "largest quantity": (items, F.max("l_quantity"), v(0, 50))})


@query("AGG-47", f"WITH {TEMPS}, {DAILY}, j AS (SELECT a.day, a.value / 10000 AS x, b.value / 10000 AS y FROM daily a JOIN daily b ON a.day = b.day WHERE a.station = 'view' AND b.station = 'error') SELECT count(*) AS n, round(avg(x - y), 6) + 0.0 AS shift_c, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(corr(x, y), 6) AS r FROM j")
def agg47(spark, d):
    v = daily(spark, d).withColumn("value", F.col("value") / 10_000)
    one, two = (v.where(F.col("station") == s).select("day", F.col("value").alias(c)) for s, c in (("view", "x"), ("error", "y")))
    e = F.col("x") - F.col("y")
    return one.join(two, "day").agg(F.count("*").alias("n"), (F.round(F.avg(e), 6) + F.lit(0.0)).alias("shift_c"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.corr("x", "y"), 6).alias("r"))


@query("AGG-48", "WITH c AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN 'restricted' WHEN c_custkey % 97 = 3 THEN 'crown' ELSE 'private' END AS class, c_custkey % 11 = 0 AS official FROM customer) SELECT class, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS share, count(*) FILTER (official AND class = 'private') > 0 AS failed FROM c GROUP BY class")
def agg48(spark, d):
    k = F.col("c_custkey")
    c = load(spark, d, "customer").select(F.when(k % 97 == 0, "restricted").when(k % 97 == 3, "crown").otherwise("private").alias("class"), (k % 11 == 0).alias("official"))
    g = c.groupBy("class").agg(F.count("*").alias("n"), (F.count_if(F.col("official") & (F.col("class") == "private")) > 0).alias("failed"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).select("class", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"), "failed")


@query("AGG-51", f"WITH {ERR}, r AS (SELECT site, avg(abs(f)) AS value, count(*) >= 560 AS complete, avg(abs(f)) < avg(abs(b)) AS passed FROM err GROUP BY site), s AS (SELECT DISTINCT c_custkey AS site FROM customer) SELECT s.site, round(CASE WHEN complete AND passed THEN value ELSE 3.31 END, 6) AS value, CASE WHEN complete AND passed THEN NULL WHEN complete IS NULL THEN 'no result' WHEN NOT complete THEN 'incomplete' ELSE 'not passed' END AS reason FROM s LEFT JOIN r ON s.site = r.site")
def agg51(spark, d):
    r = errors(spark, d).groupBy("site").agg(F.avg(F.abs("f")).alias("value"), (F.count("*") >= 560).alias("complete"), (F.avg(F.abs("f")) < F.avg(F.abs("b"))).alias("passed"))
    spine = load(spark, d, "customer").select(F.col("c_custkey").alias("site")).distinct()
    return _rounded(ops.published(r, spine, "site", 3.31), "value")


@query("AGG-52", f"WITH {READINGS}, {TEMPS}, {DRIVE}, dr AS (SELECT station AS ds, us AS dus, drive FROM drive), t AS (SELECT event_id, station, us, temp_c FROM temps) SELECT t.event_id, t.station, dayofyear(DATE '1970-01-01' + (us // {DAY_US})::INT) AS doy, temp_c, round(drive, 6) AS drive FROM t ASOF LEFT JOIN dr ON t.station = dr.ds AND t.us >= dr.dus")
def agg52(spark, d):
    t = temps(spark, d).select("event_id", "station", "us", "temp_c")
    joined = events.asof_join(t, events.wind_run(readings(spark, d)), ["station"], ["drive"])
    doy = F.dayofyear(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / DAY_US).cast("int")))
    return joined.select("event_id", "station", doy.alias("doy"), "temp_c", F.round("drive", 6).alias("drive"))


@query("STAT-09", f"""WITH {GATE}, dd AS (SELECT lead_h AS key, day, count(*) FILTER (fcst >= 40 AND obs >= 40) AS a, count(*) FILTER (fcst >= 40 AND obs < 40) AS b, count(*) FILTER (fcst < 40 AND obs >= 40) AS c, count(*) FILTER (fcst < 40 AND obs < 40) AS d FROM gate GROUP BY ALL), di AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) - 1 AS i FROM dd), bl AS (SELECT key, i // 25 AS block, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM di GROUP BY ALL), sz AS (SELECT key, count(*) AS k FROM bl GROUP BY key),
sp AS (SELECT key, k, rep, unnest(range(k)) AS slot FROM (SELECT *, unnest(range(200)) AS rep FROM sz)), dr AS (SELECT key, rep, {DRAW.replace(' + 1)', ' + 12345)')} AS block FROM sp), rt AS (SELECT dr.key, rep, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM dr JOIN bl USING (key, block) GROUP BY ALL), ps AS (SELECT key, a / nullif(a + c, 0)::DOUBLE - b / nullif(b + d, 0)::DOUBLE AS pss FROM rt)
SELECT key, count(pss) AS valid, round(quantile_cont(pss, 0.025), 6) AS low, round(quantile_cont(pss, 0.975), 6) AS high FROM ps GROUP BY key""")
def stat09(spark, d):
    f, o = F.col("fcst") >= 40, F.col("obs") >= 40
    days = gate_rows(spark, d).groupBy(F.col("lead_h").alias("key"), "day").agg(F.count_if(f & o).alias("a"), F.count_if(f & ~o).alias("b"), F.count_if(~f & o).alias("c"), F.count_if(~f & ~o).alias("d"))
    days = days.withColumn("i", F.row_number().over(W.partitionBy("key").orderBy("day")) - 1)
    return _rounded(ops.pss_bootstrap(days, 25, 200), "low", "high")


@query("STAT-12", f"""WITH {TEMPS}, {DAILY}, p AS (SELECT a.station, l.lag, a.value AS x, b.value AS y FROM daily a, (VALUES (0), (1), (2), (3), (4)) l(lag) JOIN daily b ON b.station = a.station AND b.day = a.day + l.lag), k AS (SELECT station, lag, rank() OVER (PARTITION BY station, lag ORDER BY x) + (count(*) OVER (PARTITION BY station, lag, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY station, lag ORDER BY y) + (count(*) OVER (PARTITION BY station, lag, y) - 1) / 2.0::DOUBLE AS ry FROM p)
SELECT station, lag, count(*) AS n, round(corr(rx, ry), 6) AS rho, round(abs(corr(rx, ry)) * sqrt(count(*) - 1), 6) AS z FROM k GROUP BY ALL""")
def stat12(spark, d):
    v = daily(spark, d)
    return ops.lag_scan(v, v).withColumns({"rho": F.round("rho", 6), "z": F.round("z", 6)})


@query("STAT-13", f"WITH {ERR}, h AS (SELECT site, obs >= 40 AS label, persist FROM err WHERE persist IS NOT NULL AND year(DATE '1970-01-01' + day::INT) > 1998), k AS (SELECT site, label, rank() OVER (PARTITION BY site ORDER BY persist) + (count(*) OVER (PARTITION BY site, persist) - 1) / 2.0::DOUBLE AS r FROM h), s AS (SELECT site, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg, sum(r) FILTER (label) AS s FROM k GROUP BY site) SELECT site, pos, CASE WHEN pos >= 50 THEN round((s - pos * (pos + 1) / 2.0::DOUBLE) / (pos * neg), 4) END AS auc, CASE WHEN pos < 50 THEN 'under 50 held-out events' END AS reason FROM s")
def stat13(spark, d):
    from ..operators import verify

    held = errors(spark, d).withColumn("label", F.col("obs") >= 40).where("persist IS NOT NULL AND year(date_add(DATE'1970-01-01', day)) > 1998")
    got = verify.auc(held, "site", "persist", "label")
    return got.select("site", "pos", F.when(F.col("pos") >= 50, F.col("auc")).alias("auc"), F.when(F.col("pos") < 50, "under 50 held-out events").alias("reason"))
