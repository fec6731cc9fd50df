"""Queries of forecast verification, calibration and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import events, verify
from .bindings import DAY_US, FLOWS, GATE, HOUR_US, READINGS, TEMPS, flows, gate_rows, readings, temps
from .queries_events import HOURLY, IN_SECTOR, _hourly
from .registry import query


def _r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def errors(spark, d):
    """gate rows with forecast, persistence and climatology errors f, p, c and the harder baseline b."""
    g = gate_rows(spark, d)
    e = g.withColumns({"f": F.col("fcst") - F.col("obs"), "p": F.col("persist") - F.col("obs"), "c": F.col("clim") - F.col("obs")})
    return e.withColumn("b", verify.best_baseline("p", "c"))


ERR = f"{GATE}, err0 AS (SELECT *, fcst - obs AS f, persist - obs AS p, clim - obs AS c FROM gate), err AS (SELECT *, CASE WHEN p IS NULL THEN c WHEN c IS NULL THEN p WHEN abs(p) <= abs(c) THEN p ELSE c END AS b FROM err0)"


@query("J-05", f"WITH {GATE}, m AS (SELECT site, day, avg(fcst) AS model FROM gate GROUP BY ALL), t AS (SELECT site, day, avg(obs) AS truth FROM gate WHERE part % 3 = 0 GROUP BY ALL) SELECT m.site, m.day, round(model, 6) + 0.0 AS model, round(truth, 6) AS truth FROM m JOIN t ON m.site = t.site AND m.day = t.day")
def j05(spark, d):
    g = gate_rows(spark, d)
    model, truth = g.groupBy("site", "day").agg(F.avg("fcst").alias("model")), g.where("part % 3 = 0").groupBy("site", "day").agg(F.avg("obs").alias("truth"))
    return _r(model.join(truth, ["site", "day"]), "model", "truth").withColumn("model", F.col("model") + F.lit(0.0))


@query("AGG-01", f"""WITH {TEMPS.replace("epoch_us(ts) AS us", f"epoch_us(ts) // {HOUR_US} * {HOUR_US} AS us")}, k AS (SELECT * FROM temps WHERE temp_c BETWEEN -2 AND 18.9 QUALIFY row_number() OVER (PARTITION BY station, us ORDER BY issued DESC, event_id) = 1)
SELECT station, us // {DAY_US} AS day, round(avg(temp_c), 6) AS mean_c, max(temp_c) AS max_c, min(temp_c) AS min_c, count(*) AS n, CASE WHEN count(*) < 18 THEN 'thin day' END AS reason FROM k GROUP BY ALL""")
def agg01(spark, d):
    t = temps(spark, d).withColumn("us", F.floor(F.col("us") / HOUR_US) * HOUR_US).where(exprs.plausible("temp_c", -2, 18.9))
    best = events.latest_issue(t)
    out = best.groupBy("station", F.floor(F.col("us") / DAY_US).alias("day")).agg(F.avg("temp_c").alias("mean_c"), F.max("temp_c").alias("max_c"), F.min("temp_c").alias("min_c"), F.count("*").alias("n"))
    return _r(out, "mean_c").withColumn("reason", F.when(F.col("n") < 18, "thin day"))


@query("AGG-02", f"""WITH {GATE}, e AS (SELECT lead_h, persist AS m, obs AS t, persist - obs AS e FROM gate WHERE persist IS NOT NULL)
SELECT lead_h, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(abs(e), 0.5), 6) AS median_abs, round(quantile_cont(abs(e), 0.9), 6) AS p90_abs, round(corr(m, t), 6) AS r FROM e GROUP BY GROUPING SETS ((lead_h), ())""")
def agg02(spark, d):
    return _r(verify.error_stats(gate_rows(spark, d), "lead_h", "persist", "obs"), "mae", "bias", "rmse", "median_abs", "p90_abs", "r")


@query("AGG-03", f"WITH {ERR} SELECT site, count(p) AS n, round(avg(abs(p)), 6) AS mae, round(sqrt(avg(p * p)), 6) AS rmse, round(avg(p), 6) + 0.0 AS bias FROM err GROUP BY site")
def agg03(spark, d):
    p = exprs.finite("p")
    return errors(spark, d).groupBy("site").agg(F.count(p).alias("n"), F.round(F.avg(F.abs(p)), 6).alias("mae"), F.round(F.sqrt(F.avg(p * p)), 6).alias("rmse"), (F.round(F.avg(p), 6) + F.lit(0.0)).alias("bias"))


@query("AGG-04", f"""WITH {GATE}, f AS (SELECT day, max(fcst) >= 50.5 AS f, max(obs) >= 50 AS o FROM gate GROUP BY day), c AS (SELECT count(*) FILTER (f AND o) AS hits, count(*) FILTER (o AND NOT f) AS misses, count(*) FILTER (f AND NOT o) AS false_alarms, count(*) FILTER (NOT f AND NOT o) AS correct_negatives FROM f)
SELECT *, hits / nullif(hits + misses, 0)::DOUBLE AS pod, false_alarms / nullif(hits + false_alarms, 0)::DOUBLE AS far FROM c""")
def agg04(spark, d):
    g = gate_rows(spark, d)
    return verify.contingency(g.where("fcst >= 50.5"), g.where("obs >= 50"), g)


@query("SET-01", f"WITH {GATE}, f AS (SELECT DISTINCT day FROM gate WHERE fcst >= 53), o AS (SELECT DISTINCT day FROM gate WHERE obs >= 49) SELECT day, 'both' AS kind FROM (SELECT * FROM f INTERSECT SELECT * FROM o) UNION ALL SELECT day, 'missed' FROM (SELECT * FROM o EXCEPT SELECT * FROM f) UNION ALL SELECT day, 'any' FROM (SELECT * FROM o UNION SELECT * FROM f)")
def set01(spark, d):
    g = gate_rows(spark, d)
    f, o = g.where("fcst >= 53").select("day").distinct(), g.where("obs >= 49").select("day").distinct()
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    return kind(f.intersect(o), "both").union(kind(o.subtract(f), "missed")).union(kind(o.union(f).distinct(), "any"))


@query("AGG-05", f"""WITH {GATE}, c AS (SELECT lead_h, count(*) FILTER (fcst >= 40 AND obs >= 40) AS a, count(*) FILTER (NOT fcst >= 40 AND obs >= 40) AS c, count(*) FILTER (fcst >= 40 AND NOT obs >= 40) AS b, count(*) FILTER (NOT fcst >= 40 AND NOT obs >= 40) AS d FROM gate GROUP BY lead_h)
SELECT lead_h, a AS hits, c AS misses, b AS false_alarms, d AS correct_negatives, round(a / nullif(a + c, 0)::DOUBLE, 4) AS pod, round(b / nullif(b + d, 0)::DOUBLE, 4) AS pofd, round(b / nullif(a + b, 0)::DOUBLE, 4) AS far, round(a / nullif(a + b + c, 0)::DOUBLE, 4) AS csi, round(a / nullif(a + c, 0)::DOUBLE - b / nullif(b + d, 0)::DOUBLE, 4) AS pss, round((a + c) / nullif(a + b + c + d, 0)::DOUBLE, 4) AS base_rate FROM c""")
def agg05(spark, d):
    g = gate_rows(spark, d)
    return verify.event_skill(g.withColumns({"fe": F.col("fcst") >= 40, "oe": F.col("obs") >= 40}), ["lead_h"], "fe", "oe")


@query("AGG-06", f"WITH {ERR}, b AS (SELECT *, CASE WHEN part % 50 < 5 THEN 0 WHEN part % 50 < 10 THEN 5 WHEN part % 50 < 15 THEN 10 WHEN part % 50 < 20 THEN 15 WHEN part % 50 < 30 THEN 20 WHEN part % 50 < 45 THEN 30 ELSE 45 END AS bin FROM err WHERE p IS NOT NULL) SELECT lead_h, bin, count(*) AS n, round(sqrt(avg(p * p)), 6) AS rmse, round(avg(p), 6) + 0.0 AS bias FROM b GROUP BY ALL")
def agg06(spark, d):
    e = errors(spark, d).select("lead_h", (F.col("part") % 50).alias("depth"), F.col("p").alias("err"))
    return _r(verify.binned_sigma(e), "rmse", "bias").withColumn("bias", F.col("bias") + F.lit(0.0))


@query("AGG-08", f"WITH {ERR} SELECT lead_h, count(*) FILTER (b = p) AS n_persist, round(avg(abs(b)), 6) AS mae_b, round(avg(abs(f)) / avg(abs(b)), 6) AS ratio FROM err GROUP BY lead_h")
def agg08(spark, d):
    return errors(spark, d).groupBy("lead_h").agg(F.count_if(F.col("b") == F.col("p")).alias("n_persist"), F.round(F.avg(F.abs("b")), 6).alias("mae_b"), F.round(F.avg(F.abs("f")) / F.avg(F.abs("b")), 6).alias("ratio"))


@query("AGG-09", f"WITH {ERR} SELECT lead_h, round(avg(abs(f)) FILTER (p IS NOT NULL) / avg(abs(p)), 6) AS vs_persist, round(avg(abs(f)) / avg(abs(c)), 6) AS vs_clim FROM err GROUP BY lead_h")
def agg09(spark, d):
    ratio = lambda k: F.round(F.avg(F.when(F.col(k).isNotNull(), F.abs("f"))) / F.avg(F.abs(k)), 6)
    return errors(spark, d).groupBy("lead_h").agg(ratio("p").alias("vs_persist"), ratio("c").alias("vs_clim"))


@query("AGG-10", f"WITH {ERR}, g AS (SELECT part AS key, count(p) AS n, median(p) AS m, avg(p) AS a, stddev_pop(p) AS s FROM err GROUP BY part) SELECT key, n, round(CASE WHEN n < 3 THEN 3.31 ELSE m END, 6) + 0.0 AS central, round(CASE WHEN n < 3 THEN 1.51 ELSE a - s END, 6) + 0.0 AS low, round(CASE WHEN n < 3 THEN 5.55 ELSE a + s END, 6) + 0.0 AS high, CASE WHEN n < 3 THEN 'prior' ELSE 'measured' END AS source FROM g")
def agg10(spark, d):
    out = verify.pooled_bias(errors(spark, d).withColumnRenamed("part", "key"), "key", "p")
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("central", "low", "high")})


@query("AGG-11", f"WITH {GATE} SELECT lead_h, round(avg((obs BETWEEN fcst - 3 AND fcst + 2)::INT), 9) AS coverage FROM gate GROUP BY lead_h")
def agg11(spark, d):
    inside = F.col("obs").between(F.col("fcst") - 3, F.col("fcst") + 2)
    return gate_rows(spark, d).groupBy("lead_h").agg(F.round(F.avg(inside.cast("int")), 9).alias("coverage"))


@query("AGG-12", f"WITH {GATE}, o AS (SELECT site, avg(obs - persist) AS shift_c FROM gate GROUP BY site) SELECT site, round(any_value(shift_c), 6) + 0.0 AS shift_c, round(avg(abs(persist + shift_c - obs)), 6) AS mae FROM gate JOIN o USING (site) GROUP BY site")
def agg12(spark, d):
    g = gate_rows(spark, d)
    fit = g.groupBy("site").agg(F.avg(F.col("obs") - F.col("persist")).alias("shift_c"))
    return g.join(fit, "site").groupBy("site").agg((F.round(F.first("shift_c"), 6) + F.lit(0.0)).alias("shift_c"), F.round(F.avg(F.abs(F.col("persist") + F.col("shift_c") - F.col("obs"))), 6).alias("mae"))


@query("AGG-13", f"WITH {GATE}, b AS (SELECT lead_h, avg(fcst - obs) AS b FROM gate GROUP BY lead_h), h AS (SELECT lead_h, (sum(b) OVER () - b) / (count(*) OVER () - 1) AS others FROM b) SELECT lead_h, round(avg(abs(fcst - others - obs)), 6) AS mae FROM gate JOIN h USING (lead_h) GROUP BY lead_h")
def agg13(spark, d):
    return _r(verify.leave_one_out_mae(gate_rows(spark, d), "lead_h", "fcst", "obs"), "mae")


ANOM = f"s AS (SELECT site, day, avg(fcst) AS m, avg(obs) AS t FROM gate GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY day)::DOUBLE AS x FROM s), l AS (SELECT site, regr_slope(m, x) AS sm, regr_intercept(m, x) AS im, regr_slope(t, x) AS st, regr_intercept(t, x) AS it FROM x GROUP BY site)"


@query("AGG-14", f"""WITH {GATE}, g AS (SELECT lead_h AS grp, fcst AS x, obs AS y, (part % 50)::DOUBLE AS w, day % 366 AS doy FROM gate), tr AS (SELECT h.grp AS held, g.* FROM g, (SELECT DISTINCT grp FROM g) h WHERE g.grp <> h.grp),
m AS (SELECT held, avg(y - x) AS off, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, avg(x) AS mx, avg(y) AS my, avg(w) AS mw, var_pop(x) AS xx, var_pop(w) AS ww, covar_pop(x, w) AS xw, covar_pop(x, y) AS xy, covar_pop(w, y) AS wy FROM tr GROUP BY held), f AS (SELECT *, (xy * ww - wy * xw) / (xx * ww - xw * xw) AS bx, (wy * xx - xy * xw) / (xx * ww - xw * xw) AS bw FROM m),
dd AS (SELECT tr.held, doy, avg(y - a * x - b) AS e FROM tr JOIN f USING (held) GROUP BY ALL), ld AS (SELECT held, doy, e, lead(doy) OVER w AS z_doy, lead(e) OVER w AS z_e FROM dd WINDOW w AS (PARTITION BY held ORDER BY doy)), fl AS (SELECT held, d AS doy, e + coalesce((d - doy) / (z_doy - doy)::DOUBLE * (z_e - e), 0) AS e FROM (SELECT *, unnest(range(doy, coalesce(z_doy, doy + 1))) AS d FROM ld)), s AS (SELECT held, doy, avg(e) OVER (PARTITION BY held ORDER BY doy RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS season FROM fl),
p AS (SELECT g.grp AS "group", y, unnest(['raw', 'offset', 'linear', 'linear_wind', 'linear_doy']) AS kind, unnest([x, x + off, a * x + b, my - bx * mx - bw * mw + bx * x + bw * w, a * x + b + coalesce(season, 0)]) AS fit FROM g JOIN f ON f.held = g.grp LEFT JOIN s ON s.held = g.grp AND s.doy = g.doy)
SELECT "group", kind, count(*) AS n, round(avg(abs(fit - y)), 6) AS mae FROM p GROUP BY ALL""")
def agg14(spark, d):
    g = gate_rows(spark, d).select(F.col("lead_h").alias("group"), F.col("fcst").alias("x"), F.col("obs").alias("y"), (F.col("part") % 50).cast("double").alias("w"), (F.col("day") % 366).alias("doy"))
    return verify.correction_families(g).withColumn("mae", F.round("mae", 6))


@query("AGG-15", f"WITH {GATE}, {ANOM} SELECT x.site, count(*) AS n, round(corr(m - sm * x - im, t - st * x - it), 6) AS r FROM x JOIN l USING (site) GROUP BY x.site")
def agg15(spark, d):
    s = gate_rows(spark, d).groupBy("site", "day").agg(F.avg("fcst").alias("m"), F.avg("obs").alias("t"))
    return _r(verify.anomaly_correlation(s, "site", "day", "m", "t"), "r")


@query("AGG-16", f"WITH {GATE} SELECT site, count(*) AS n, round(sum(fcst * obs) / sum(fcst * fcst), 9) AS scale, round(avg(obs - fcst), 6) + 0.0 AS offset, round(regr_slope(obs, fcst), 6) AS slope, round(regr_intercept(obs, fcst), 6) AS intercept FROM gate GROUP BY site")
def agg16(spark, d):
    out = verify.linear_fits(gate_rows(spark, d), "site", "fcst", "obs")
    return out.withColumns({"scale": F.round("scale", 9), "offset": F.round("offset", 6) + F.lit(0.0), "slope": F.round("slope", 6), "intercept": F.round("intercept", 6)})


@query("AGG-17", f"WITH {READINGS}, a AS (SELECT station, count(dir_deg) AS n, avg(sin(radians(dir_deg))) AS s, avg(cos(radians(dir_deg))) AS c FROM readings GROUP BY station) SELECT station, n, round(CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END, 6) AS mean_dir, round(sqrt(s * s + c * c), 9) AS concentration FROM a")
def agg17(spark, d):
    mean, strength = verify.circular("dir_deg")
    return readings(spark, d).groupBy("station").agg(F.count("dir_deg").alias("n"), F.round(mean, 6).alias("mean_dir"), F.round(strength, 9).alias("concentration"))


@query("AGG-18", f"WITH {READINGS}, {HOURLY}, j AS (SELECT a.value >= 1600 AS x, b.value >= 1600 AS y FROM hourly a JOIN hourly b ON a.h = b.h WHERE a.station = 'view' AND b.station = 'click') SELECT count(*) AS n, count(*) FILTER (x <> y) AS flips, count(*) FILTER (x AND NOT y) AS missed, count(*) FILTER (y AND NOT x) AS false_ FROM j")
def agg18(spark, d):
    h = _hourly(spark, d)
    one, two = (h.where(F.col("station") == s).select("h", (F.col("value") >= 1600).alias(c)) for s, c in (("view", "x"), ("click", "y")))
    return one.join(two, "h").agg(F.count("*").alias("n"), F.count_if(F.expr("x <> y")).alias("flips"), F.count_if(F.expr("x AND NOT y")).alias("missed"), F.count_if(F.expr("y AND NOT x")).alias("false_"))


PCT = f"fd AS (SELECT gauge AS key, least(dayofyear(DATE '1970-01-01' + day::INT), 365) AS d0, q FROM flows), sp AS (SELECT key, (d0 + unnest(range(-10, 11)) - 1 + 365) % 365 + 1 AS doy, q FROM fd), pct AS (SELECT key, doy, count(*) AS n, round(quantile_cont(q, 0.1), 3) AS p10, round(quantile_cont(q, 0.25), 3) AS p25, round(quantile_cont(q, 0.5), 3) AS p50, round(quantile_cont(q, 0.75), 3) AS p75, round(quantile_cont(q, 0.9), 3) AS p90 FROM sp GROUP BY ALL HAVING count(*) >= 30)"


def _doy_flows(spark, d):
    return flows(spark, d).select(F.col("gauge").alias("key"), F.dayofyear(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))).alias("doy"), "q", "day")


@query("AGG-19", f"WITH {FLOWS}, {PCT} SELECT * FROM pct")
def agg19(spark, d):
    return verify.doy_percentiles(_doy_flows(spark, d))


@query("AGG-20", f"""WITH {FLOWS}, {PCT}, v AS (SELECT gauge AS key, day, least(dayofyear(DATE '1970-01-01' + day::INT), 365) AS doy, q FROM flows)
SELECT key, day, round(CASE WHEN q <= p10 THEN 9 WHEN q >= p90 THEN 91 WHEN q <= p25 THEN 10 + 15.0::DOUBLE * (q - p10) / (p25 - p10) WHEN q <= p50 THEN 25 + 25.0::DOUBLE * (q - p25) / (p50 - p25) WHEN q <= p75 THEN 50 + 25.0::DOUBLE * (q - p50) / (p75 - p50) ELSE 75 + 15.0::DOUBLE * (q - p75) / (p90 - p75) END, 6) AS percentile FROM v JOIN pct USING (key, doy)""")
def agg20(spark, d):
    v = _doy_flows(spark, d)
    context = verify.seasonal_context("q", {p: F.col(f"p{p}") for p in (10, 25, 50, 75, 90)})
    return v.withColumn("doy", F.least("doy", F.lit(365))).join(verify.doy_percentiles(v), ["key", "doy"]).select("key", "day", F.round(context, 6).alias("percentile"))


@query("AGG-22", f"WITH {ERR}, c(cls) AS (VALUES (0), (1), (2), (99)) SELECT cls, coalesce(round(median(p), 6) + 0.0, 0) AS delta, count(p) AS n FROM c LEFT JOIN err ON site % 3 = cls GROUP BY cls")
def agg22(spark, d):
    spine = spark.createDataFrame([(0,), (1,), (2,), (99,)], "cls long")
    e = errors(spark, d).withColumn("cls", F.col("site") % 3)
    n = e.where("p IS NOT NULL").groupBy("cls").agg(F.count("*").alias("n"))
    found = spine.join(verify.quantiles(e, "p", ["cls"], {"median": 0.5}), "cls", "left").join(n, "cls", "left")
    return found.select("cls", F.coalesce(F.round("median", 6) + F.lit(0.0), F.lit(0.0)).alias("delta"), F.coalesce("n", F.lit(0)).alias("n"))


@query("AGG-24", f"""WITH {ERR}, q AS (SELECT lead_h, abs(f) AS a, row_number() OVER (PARTITION BY lead_h ORDER BY abs(f)) AS rn, count(*) OVER (PARTITION BY lead_h) AS n FROM err), l AS (SELECT lead_h, any_value(n) AS n, avg(a) AS mae, max(a) FILTER (rn = round_even(0.9::DOUBLE * (n - 1), 0)::BIGINT + 1) AS p90 FROM q GROUP BY lead_h)
SELECT lead_h, n, round(mae, 6) AS mae, round(CASE WHEN n >= 20 THEN p90 END, 6) AS p90, round((SELECT regr_slope(abs(f), lead_h) FROM err), 9) AS slope FROM l""")
def agg24(spark, d):
    e = errors(spark, d).withColumn("a", F.abs("f"))
    p90 = verify.nth_smallest(e, "a", ["lead_h"], F.bround((F.col("total") - 1) * F.lit(0.9)).cast("long") + 1, "p90")
    by_lead = e.groupBy("lead_h").agg(F.count("*").alias("n"), F.avg("a").alias("mae")).join(p90, "lead_h")
    slope = e.agg(F.regr_slope("a", "lead_h").alias("slope"))
    return by_lead.join(F.broadcast(slope)).select("lead_h", "n", F.round("mae", 6).alias("mae"), F.round(F.when(F.col("n") >= 20, F.col("p90")), 6).alias("p90"), F.round("slope", 9).alias("slope"))


@query("AGG-25", f"""WITH {GATE}, s AS (SELECT part AS site, count(*) AS n, avg(fcst - clim) AS model_off, avg(obs - clim) AS obs_off FROM gate GROUP BY part)
SELECT site, n, round(model_off, 6) + 0.0 AS model_off, round(obs_off, 6) + 0.0 AS obs_off, CASE WHEN n < 25 THEN 'thin' WHEN abs(model_off) <= 3 AND abs(obs_off) <= 3 THEN 'usable' WHEN abs(obs_off) > abs(model_off) THEN 'observation off' ELSE 'model off' END AS verdict FROM s""")
def agg25(spark, d):
    g = gate_rows(spark, d).select(F.col("part").alias("site"), F.col("fcst").alias("model"), "obs", F.col("clim").alias("sat"))
    out = verify.site_validity(g, "site", least=25)
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("model_off", "obs_off")})


@query("AGG-26", f"""WITH {GATE}, s AS (SELECT day, avg(fcst) AS r, avg(obs) AS o FROM gate GROUP BY day), l AS (SELECT day - lag(day) OVER (ORDER BY day) AS gap, r - lag(r) OVER (ORDER BY day) AS dr, o - lag(o) OVER (ORDER BY day) AS do_ FROM s)
SELECT count(*) AS n, round(stddev_pop(dr), 6) AS ref_sd, round(stddev_pop(do_), 6) AS obs_sd, CASE WHEN count(*) >= 30 THEN stddev_pop(dr) / stddev_pop(do_) >= 0.5 END AS usable FROM l WHERE gap = 1""")
def agg26(spark, d):
    s = gate_rows(spark, d).groupBy("day").agg(F.avg("fcst").alias("r"), F.avg("obs").alias("o")).withColumn("station", F.lit("all"))
    one, two = (events.day_changes(s.select("station", "day", F.col(c).alias("value"))).select("day", F.col("change").alias(f"d{c}")) for c in "ro")
    j = one.join(two, "day")
    return j.agg(F.count("*").alias("n"), F.round(F.stddev_pop("dr"), 6).alias("ref_sd"), F.round(F.stddev_pop("do"), 6).alias("obs_sd"), F.when(F.count("*") >= 30, F.stddev_pop("dr") / F.stddev_pop("do") >= 0.5).alias("usable"))


@query("STAT-06", f"WITH {GATE}, s AS (SELECT day, avg(obs) AS o FROM gate GROUP BY day), l AS (SELECT day - lag(day) OVER (ORDER BY day) AS gap, o - lag(o) OVER (ORDER BY day) AS c FROM s) SELECT count(*) AS n, round(CASE WHEN count(*) >= 30 THEN stddev_pop(c) END, 6) AS sd, round(CASE WHEN count(*) >= 30 THEN -2 * stddev_pop(c) END, 6) AS event_bar FROM l WHERE gap = 1")
def stat06(spark, d):
    s = gate_rows(spark, d).groupBy("day").agg(F.avg("obs").alias("value")).withColumn("station", F.lit("all"))
    sd = F.when(F.count("*") >= 30, F.stddev_pop("change"))
    return events.day_changes(s).agg(F.count("*").alias("n"), F.round(sd, 6).alias("sd"), F.round(-2 * sd, 6).alias("event_bar"))


@query("AGG-30", f"""WITH {ERR}, s AS (SELECT site, avg(abs(f)) AS mae, avg(f) AS bias, avg(abs(f)) FILTER (obs BETWEEN 20 AND 40) AS in_f, avg(abs(b)) FILTER (obs BETWEEN 20 AND 40) AS in_b FROM err GROUP BY site) SELECT site, round(mae, 6) AS mae, round(bias, 6) + 0.0 AS bias, round(in_f, 6) AS in_sector, CASE WHEN in_f <= 0.9 * in_b THEN 'switch' ELSE 'keep' END AS verdict FROM s""")
def agg30(spark, d):
    inside = lambda c: F.avg(F.when(F.col("obs").between(20, 40), F.abs(c)))
    s = errors(spark, d).groupBy("site").agg(F.avg(F.abs("f")).alias("mae"), F.avg("f").alias("bias"), inside("f").alias("in_f"), inside("b").alias("in_b"))
    return s.select("site", F.round("mae", 6).alias("mae"), (F.round("bias", 6) + F.lit(0.0)).alias("bias"), F.round("in_f", 6).alias("in_sector"), F.when(F.col("in_f") <= 0.9 * F.col("in_b"), "switch").otherwise("keep").alias("verdict"))


@query("AGG-33", f"WITH {ERR}, p AS (SELECT CASE WHEN obs >= 30 THEN 'active' ELSE 'neutral' END AS phase, f FROM err) SELECT phase, count(*) AS n, round(avg(abs(f)), 6) AS mae, round(avg(f), 6) + 0.0 AS bias FROM p GROUP BY phase")
def agg33(spark, d):
    return errors(spark, d).groupBy(F.when(F.col("obs") >= 30, "active").otherwise("neutral").alias("phase")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs("f")), 6).alias("mae"), (F.round(F.avg("f"), 6) + F.lit(0.0)).alias("bias"))


@query("AGG-35", f"""WITH {ERR}, y AS (SELECT year(DATE '1970-01-01' + day::INT) AS year, part % 4 AS band, p FROM err WHERE p IS NOT NULL), b AS (SELECT band, avg(p) AS first_bias FROM y WHERE year = (SELECT min(year) FROM y) GROUP BY band)
SELECT y.year, y.band, count(*) AS n, round(avg(p), 6) + 0.0 AS bias, round(avg(abs(p - first_bias)), 6) AS mae_transferred FROM y JOIN b USING (band) GROUP BY ALL""")
def agg35(spark, d):
    y = errors(spark, d).where("p IS NOT NULL").select(F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))).alias("year"), (F.col("part") % 4).alias("band"), "p")
    first = y.join(y.agg(F.min("year").alias("year")), "year", "left_semi").groupBy("band").agg(F.avg("p").alias("first_bias"))
    return y.join(first, "band").groupBy("year", "band").agg(F.count("*").alias("n"), (F.round(F.avg("p"), 6) + F.lit(0.0)).alias("bias"), F.round(F.avg(F.abs(F.col("p") - F.col("first_bias"))), 6).alias("mae_transferred"))


@query("AGG-36", f"""WITH {GATE}, c AS (SELECT lead_h, count(*) FILTER (obs <= 12 AND fcst <= 12) AS tp, count(*) FILTER (obs > 12 AND fcst <= 12) AS fp, count(*) FILTER (obs > 12 AND fcst > 12) AS tn, count(*) FILTER (obs <= 12 AND fcst > 12) AS fn FROM gate GROUP BY lead_h)
SELECT *, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS pod, round(fp / nullif(tp + fp, 0)::DOUBLE, 6) AS far, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy FROM c""")
def agg36(spark, d):
    t, m = F.col("obs") <= 12, F.col("fcst") <= 12
    c = gate_rows(spark, d).groupBy("lead_h").agg(F.count_if(t & m).alias("tp"), F.count_if(~t & m).alias("fp"), F.count_if(~t & ~m).alias("tn"), F.count_if(t & ~m).alias("fn"))
    return c.withColumns({"pod": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6), "far": F.round(F.try_divide("fp", F.col("tp") + F.col("fp")), 6), "accuracy": F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")), 6)})


@query("AGG-41", f"WITH {ERR} SELECT lead_h, round(quantile_cont(abs(p), 0.25), 6) AS p25, round(quantile_cont(abs(p), 0.9), 6) AS p90, round(quantile_cont(abs(p), 0.99), 6) AS p99 FROM err GROUP BY lead_h")
def agg41(spark, d):
    e = errors(spark, d).select("lead_h", F.abs("p").alias("a"))
    return _r(verify.quantiles(e, "a", ["lead_h"], {"p25": 0.25, "p90": 0.9, "p99": 0.99}), "p25", "p90", "p99")


@query("AGG-42", f"WITH {ERR} SELECT site, part, day, lead_h, coalesce((abs(p) >= 5)::INT + (abs(p) >= 10)::INT + (abs(p) >= 20)::INT, 0) AS band FROM err")
def agg42(spark, d):
    edges = F.array(*[F.lit(float(x)) for x in (5, 10, 20)])
    band = F.when(F.col("p").isNull(), 0).otherwise(F.size(F.filter(edges, lambda x: x <= F.abs(F.col("p")))))
    return errors(spark, d).select("site", "part", "day", "lead_h", band.alias("band"))


@query("AGG-49", f"WITH {TEMPS} SELECT station, (us - 5 * {HOUR_US}) // {DAY_US} AS day, min(temp_c) AS low, count(*) AS n FROM temps GROUP BY ALL HAVING count(*) >= 20")
def agg49(spark, d):
    return temps(spark, d).groupBy("station", F.floor((F.col("us") - 5 * HOUR_US) / DAY_US).alias("day")).agg(F.min("temp_c").alias("low"), F.count("*").alias("n")).where("n >= 20")


@query("PF-07", f"WITH {GATE}, t AS (SELECT count(DISTINCT day) AS n FROM gate), c AS (SELECT lead_h, part % 50 AS depth, count(DISTINCT day) AS k FROM gate GROUP BY ALL HAVING k >= 0.05 * (SELECT n FROM t)) SELECT gate.lead_h, part % 50 AS depth, count(*) AS n FROM gate JOIN c ON gate.lead_h = c.lead_h AND part % 50 = depth GROUP BY ALL")
def pf07(spark, d):
    g = gate_rows(spark, d).withColumn("depth", F.col("part") % 50)
    total = g.agg(F.count_distinct("day").alias("n"))
    cells = g.groupBy("lead_h", "depth").agg(F.count_distinct("day").alias("k")).join(F.broadcast(total)).where("k >= 0.05 * n").select("lead_h", "depth")
    return g.join(cells, ["lead_h", "depth"]).groupBy("lead_h", "depth").agg(F.count("*").alias("n"))


@query("PF-08", f"WITH {GATE}, c AS (SELECT part FROM gate WHERE lead_h <> 24 GROUP BY part HAVING count(DISTINCT obs % 10) = 1 AND count(DISTINCT day) >= 2) SELECT part, count(*) AS n FROM gate WHERE part NOT IN (SELECT part FROM c) OR lead_h = 24 GROUP BY part")
def pf08(spark, d):
    g = gate_rows(spark, d)
    pinned = g.where("lead_h <> 24").groupBy("part").agg(F.count_distinct(F.col("obs") % 10).alias("v"), F.count_distinct("day").alias("k")).where("v = 1 AND k >= 2")
    return g.join(pinned, "part", "left_anti").union(g.where("lead_h = 24").join(pinned, "part", "left_semi")).groupBy("part").agg(F.count("*").alias("n"))


RANK = "rank() OVER (PARTITION BY site ORDER BY {0}) + (count(*) OVER (PARTITION BY site, {0}) - 1) / 2.0::DOUBLE"


@query("STAT-01", f"WITH {ERR} SELECT site, part, day, lead_h, {RANK.format('obs')} AS rank FROM err")
def stat01(spark, d):
    return verify.average_rank(errors(spark, d).select("site", "part", "day", "lead_h", "obs"), "obs", ["site"]).select("site", "part", "day", "lead_h", F.col("rank").cast("double").alias("rank"))


@query("STAT-02", f"WITH {ERR}, k AS (SELECT site, {RANK.format('f')} AS rx, {RANK.format('p')} AS ry FROM err WHERE p IS NOT NULL) SELECT site, count(*) AS n, round(corr(rx, ry), 6) AS rho, round(abs(corr(rx, ry)) * sqrt(count(*) - 1), 6) AS z FROM k GROUP BY site")
def stat02(spark, d):
    return _r(verify.spearman(errors(spark, d), "site", "f", "p"), "rho", "z")


@query("STAT-03", f"WITH {ERR}, k AS (SELECT site, {RANK.format('f')} AS rx, {RANK.format('p')} AS ry, {RANK.format('obs')} AS rz FROM err WHERE p IS NOT NULL), c AS (SELECT site, count(*) AS n, corr(rx, ry) AS a, corr(rx, rz) AS b, corr(ry, rz) AS c FROM k GROUP BY site) SELECT site, n, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS rho FROM c")
def stat03(spark, d):
    return _r(verify.partial_spearman(errors(spark, d), "site", "f", "p", "obs"), "rho")


@query("STAT-04", f"WITH {ERR}, k AS (SELECT site, obs >= 40 AS label, {RANK.format('persist')} AS r FROM err WHERE persist IS NOT NULL), s AS (SELECT site, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg, sum(r) FILTER (label) AS s FROM k GROUP BY site) SELECT site, pos, neg, round((s - pos * (pos + 1) / 2.0::DOUBLE) / nullif(pos * neg, 0), 4) AS auc FROM s")
def stat04(spark, d):
    return verify.auc(errors(spark, d).withColumn("label", F.col("obs") >= 40), "site", "persist", "label")


@query("STAT-05")
def stat05(spark, d):
    fit = verify.logistic_fit(errors(spark, d).withColumn("label", F.col("obs") >= 40), "persist", "label")
    return spark.createDataFrame([(fit and fit["n"], fit and fit["s50"], fit and fit["width"])], "n long, s50 double, width double")


ACF = "dl AS (SELECT lead_h AS key, day, avg(f) AS err FROM err GROUP BY ALL), di AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY day) - 1 AS i, err FROM dl), dm AS (SELECT key, avg(err) AS m, var_pop(err) AS v, count(*) AS n FROM di GROUP BY key), acf AS (SELECT a.key, b.i - a.i AS lag, sum((a.err - m) * (b.err - m)) / any_value(n) / any_value(v) AS acf FROM di a JOIN dm USING (key) JOIN di b ON a.key = b.key AND b.i BETWEEN a.i AND a.i + 10 GROUP BY ALL)"


def _daily_errors(spark, d):
    from pyspark.sql import Window as W

    daily = errors(spark, d).groupBy(F.col("lead_h").alias("key"), "day").agg(F.avg("f").alias("err"), F.sum(F.abs("f")).alias("f"), F.sum(F.abs("b")).alias("b"))
    return daily.withColumn("i", F.row_number().over(W.partitionBy("key").orderBy("day")) - 1)


@query("STAT-07", f"WITH {ERR}, {ACF} SELECT key, lag, round(acf, 6) + 0.0 AS acf FROM acf")
def stat07(spark, d):
    out = verify.autocorrelation(_daily_errors(spark, d))
    return out.select("key", F.col("lag").cast("long").alias("lag"), (F.round("acf", 6) + F.lit(0.0)).alias("acf"))


DRAW = "((((rep * 7919 + slot * 104729 + 1) % 1000003) * ((rep * 7919 + slot * 104729 + 1) % 1000003)) % 1000003 * 31 + rep * 17 + slot) % 1000003 % k"


@query("STAT-08", f"""WITH {ERR}, dl AS (SELECT lead_h AS key, day, sum(abs(f)) AS f, sum(abs(b)) AS b FROM err GROUP BY ALL), di AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) - 1 AS i FROM dl), bl AS (SELECT key, i // 20 AS block, sum(f) AS f, sum(b) AS b, count(*) AS d FROM di GROUP BY ALL),
sz AS (SELECT key, count(*) AS k, sum(d)::BIGINT AS days, sum(f) / sum(b) AS ratio FROM bl GROUP BY key), sp AS (SELECT key, k, rep, unnest(range(k)) AS slot FROM (SELECT *, unnest(range(200)) AS rep FROM sz)), dr AS (SELECT key, rep, {DRAW} AS block FROM sp), rt AS (SELECT dr.key, rep, sum(f) / sum(b) AS r FROM dr JOIN bl USING (key, block) GROUP BY ALL)
SELECT sz.key, any_value(days) AS n_days, any_value(k) AS n_blocks, round(any_value(ratio), 6) AS ratio, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM sz JOIN rt USING (key) GROUP BY sz.key""")
def stat08(spark, d):
    return _r(verify.block_bootstrap_ratio(_daily_errors(spark, d), 20, 200), "ratio", "low", "high")


@query("STAT-10")
def stat10(spark, d):
    return _r(verify.sign_test_days(errors(spark, d), ["lead_h"]), "p", digits=9)


@query("AGG-07", f"""WITH {ERR}, {ACF}, m AS (SELECT lead_h, count(*) AS n, count(DISTINCT day) AS days, avg(abs(f)) AS mae, avg(abs(f)) / avg(abs(b)) AS ratio, avg(((obs >= 25.5) = (fcst >= 25.5))::INT) AS agree FROM err GROUP BY lead_h), bl AS (SELECT key, least(greatest(coalesce(min(lag) FILTER (lag > 0 AND acf < 1 / exp(1)), 10), 1), 10)::INT AS block_days FROM acf GROUP BY key)
SELECT lead_h, n, days, round(mae, 6) AS mae, round(ratio, 6) AS ratio, round(agree, 6) AS agree, block_days, CASE WHEN days < 10 THEN 'withheld: thin' WHEN ratio < 1 THEN 'better' ELSE 'no better' END AS verdict FROM m JOIN bl ON lead_h = key""")
def agg07(spark, d):
    e = errors(spark, d)
    agree = (F.col("obs") >= 25.5) == (F.col("fcst") >= 25.5)
    m = e.groupBy("lead_h").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"), F.avg(F.abs("f")).alias("mae"), (F.avg(F.abs("f")) / F.avg(F.abs("b"))).alias("ratio"), F.avg(agree.cast("int")).alias("agree"))
    length = verify.block_length(verify.autocorrelation(_daily_errors(spark, d))).withColumnRenamed("key", "lead_h")
    verdict = F.when(F.col("days") < 10, "withheld: thin").when(F.col("ratio") < 1, "better").otherwise("no better")
    return _r(m.join(length, "lead_h").withColumn("verdict", verdict), "mae", "ratio", "agree")


@query("W-11", f"""WITH {FLOWS}, g AS (SELECT gauge, max(day) AS cd FROM flows GROUP BY gauge), c AS (SELECT f.gauge, cd, q AS cq FROM flows f JOIN g ON f.gauge = g.gauge AND day = cd), b AS (SELECT f.gauge, arg_min(day, (abs(day - (cd - 3)), day)) AS bd, arg_min(q, (abs(day - (cd - 3)), day)) AS bq FROM flows f JOIN c USING (gauge) GROUP BY f.gauge)
SELECT gauge, round(cq, 3) AS q, CASE WHEN cd - bd < 0.75 OR bq <= 0 THEN 'unknown' WHEN (cq - bq) / bq >= 0.12 THEN 'rising' WHEN (cq - bq) / bq <= -0.12 THEN 'falling' ELSE 'steady' END AS state FROM c JOIN b USING (gauge)""")
def w11(spark, d):
    f = flows(spark, d).where(exprs.finite("q") >= 0)
    now = f.groupBy("gauge").agg(F.max("day").alias("cd"), F.max_by("q", "day").alias("cq"))
    gap = F.abs(F.col("day") - (F.col("cd") - 3))
    base = f.join(now, "gauge").groupBy("gauge", "cd", "cq").agg(F.min_by(F.struct("day", "q"), F.struct(gap, "day")).alias("b"))
    frac = (F.col("cq") - F.col("b.q")) / F.col("b.q")
    state = F.when((F.col("cd") - F.col("b.day") < 0.75) | (F.col("b.q") <= 0), "unknown").when(frac >= 0.12, "rising").when(frac <= -0.12, "falling").otherwise("steady")
    return base.select("gauge", F.round("cq", 3).alias("q"), state.alias("state"))


@query("W-12", f"""WITH {TEMPS}, e AS (SELECT station, max(us) AS z FROM temps GROUP BY station), a AS (SELECT station, count(*) FILTER (z - us <= 6 * {HOUR_US}) AS nr, count(*) FILTER (z - us > 6 * {HOUR_US}) AS nb, avg(temp_c) FILTER (z - us <= 6 * {HOUR_US}) AS r, avg(temp_c) FILTER (z - us > 6 * {HOUR_US}) AS b FROM temps JOIN e USING (station) WHERE z - us <= 36 * {HOUR_US} GROUP BY station)
SELECT station, nr, nb, round(CASE WHEN nr >= 3 AND nb >= 10 THEN r - b END, 6) AS anomaly, CASE WHEN nr < 3 OR nb < 10 THEN 'unknown' WHEN r - b <= -0.03 THEN 'drawdown' WHEN r - b >= 0.03 THEN 'rebound' ELSE 'steady' END AS trend FROM a""")
def w12(spark, d):
    t = temps(spark, d)
    ends = t.groupBy("station").agg(F.max("us").alias("z"))
    age = F.col("z") - F.col("us")
    recent = age <= 6 * HOUR_US
    a = t.join(ends, "station").where(age <= 36 * HOUR_US).groupBy("station").agg(F.count_if(recent).alias("nr"), F.count_if(~recent).alias("nb"), (F.avg(F.when(recent, F.col("temp_c"))) - F.avg(F.when(~recent, F.col("temp_c")))).alias("x"))
    thin = (F.col("nr") < 3) | (F.col("nb") < 10)
    trend = F.when(thin, "unknown").when(F.col("x") <= -0.03, "drawdown").when(F.col("x") >= 0.03, "rebound").otherwise("steady")
    return a.select("station", "nr", "nb", F.round(F.when(~thin, F.col("x")), 6).alias("anomaly"), trend.alias("trend"))
