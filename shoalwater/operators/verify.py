"""Forecast verification and statistics as table jobs.

Thin evidence gives null with a reason, never a number. Quantiles are exact with linear
interpolation. Ranks come from value histograms and prefix sums, so no group is one task.
"""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import finite


def error_stats(rows: DataFrame, key: str, model: str, truth: str) -> DataFrame:
    """Per key and pooled (key null): n, mae, bias, rmse, median_abs, p90_abs, r. Pairs with a gap are dropped."""
    m, t = finite(model), finite(truth)
    pairs = rows.select(key, m.alias("m"), t.alias("t")).where("m IS NOT NULL AND t IS NOT NULL").withColumn("e", F.col("m") - F.col("t"))
    e = F.col("e")
    stats = pairs.groupingSets([[F.col(key)], []], F.col(key)).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when((F.count("*") >= 2) & (F.stddev_pop("m") > 0) & (F.stddev_pop("t") > 0), F.corr("m", "t")).alias("r"), F.grouping(key).alias("_all"),
    )
    asked, size = {"median_abs": 0.5, "p90_abs": 0.9}, pairs.withColumn("_a", F.abs(e))
    own = quantiles(size, "_a", [key], asked).select(F.col(key).alias("_key"), *asked, F.lit(0).alias("_each"))
    every = quantiles(size, "_a", [], asked).select(F.lit(None).cast(pairs.schema[key].dataType).alias("_key"), *asked, F.lit(1).alias("_each"))
    q = own.union(every)
    return stats.join(q, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_all") == F.col("_each")), "left").select(key, "n", "mae", "bias", "rmse", *asked, "r")


def best_baseline(persist, clim) -> Column:
    """The baseline error with the smaller magnitude (persistence on ties); the other where one is null."""
    p, c = F.col(persist), F.col(clim)
    return F.when(p.isNull(), c).when(c.isNull(), p).when(F.abs(p) <= F.abs(c), p).otherwise(c)


def contingency(forecast: DataFrame, observed: DataFrame, spine: DataFrame) -> DataFrame:
    """2x2 table of day sets within the spine's days: one row with counts, POD and FAR."""
    f, o = forecast.select("day").distinct().withColumn("f", F.lit(True)), observed.select("day").distinct().withColumn("o", F.lit(True))
    flags = spine.select("day").distinct().join(f, "day", "left").join(o, "day", "left").fillna(False, ["f", "o"])
    out = flags.agg(F.count_if(F.expr("f AND o")).alias("hits"), F.count_if(F.expr("o AND NOT f")).alias("misses"), F.count_if(F.expr("f AND NOT o")).alias("false_alarms"), F.count_if(F.expr("NOT f AND NOT o")).alias("correct_negatives"))
    return out.withColumns({"pod": F.try_divide("hits", F.col("hits") + F.col("misses")), "far": F.try_divide("false_alarms", F.col("hits") + F.col("false_alarms"))})


def event_skill(rows: DataFrame, keys: list[str], forecast: str, observed: str) -> DataFrame:
    """POD, POFD, FAR, CSI, PSS and base rate per key, rounded to 4; null where undefined."""
    f, o = F.col(forecast), F.col(observed)
    counts = rows.where(f.isNotNull() & o.isNotNull()).groupBy(*keys).agg(F.count_if(f & o).alias("a"), F.count_if(~f & o).alias("c"), F.count_if(f & ~o).alias("b"), F.count_if(~f & ~o).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    pod, pofd = F.try_divide(a, a + c), F.try_divide(b, b + d)
    rates = {"pod": pod, "pofd": pofd, "far": F.try_divide(b, a + b), "csi": F.try_divide(a, a + b + c), "pss": pod - pofd, "base_rate": F.try_divide(a + c, a + b + c + d)}
    return counts.select(*keys, a.alias("hits"), c.alias("misses"), b.alias("false_alarms"), d.alias("correct_negatives"), *[F.round(v, 4).alias(k) for k, v in rates.items()])


def binned_sigma(rows: DataFrame, edges=(0, 5, 10, 15, 20, 30, 45, 1000)) -> DataFrame:
    """n, RMSE and bias per lead and half-open bin of depth."""
    z = F.col("depth")
    bin_ = F.coalesce(*[F.when((z >= a) & (z < b), F.lit(a)) for a, b in zip(edges, edges[1:])])
    return rows.withColumn("bin", bin_).where("bin IS NOT NULL AND err IS NOT NULL").groupBy("lead_h", "bin").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.avg("err").alias("bias"))


def leave_one_out_mae(rows: DataFrame, key: str, model: str, truth: str) -> DataFrame:
    """Per group: MAE after removing the mean of the other groups' mean biases; a single group gives 0 bias removed."""
    bias = rows.groupBy(key).agg(F.avg(F.col(model) - F.col(truth)).alias("b"))
    total = bias.agg(F.sum("b").alias("s"), F.count("*").alias("k"))
    held = bias.join(F.broadcast(total)).select(key, F.when(F.col("k") > 1, (F.col("s") - F.col("b")) / (F.col("k") - 1)).otherwise(F.lit(0.0)).alias("others"))
    return rows.join(held, key).groupBy(key).agg(F.avg(F.abs(F.col(model) - F.col("others") - F.col(truth))).alias("mae"))


def pooled_bias(rows: DataFrame, key: str, err: str, prior=(3.31, 1.51, 5.55), least: int = 3) -> DataFrame:
    """Median with a band of mean +/- population sd; under ``least`` values the frozen prior, flagged."""
    got = rows.groupBy(key).agg(F.count(err).alias("n"), F.median(err).alias("m"), F.avg(err).alias("a"), F.stddev_pop(err).alias("s"))
    thin = F.col("n") < least
    pick = lambda value, p: F.when(thin, F.lit(p)).otherwise(value)
    return got.select(key, "n", pick(F.col("m"), prior[0]).alias("central"), pick(F.col("a") - F.col("s"), prior[1]).alias("low"), pick(F.col("a") + F.col("s"), prior[2]).alias("high"), F.when(thin, "prior").otherwise("measured").alias("source"))


def linear_fits(rows: DataFrame, key: str, x: str, y: str, least: int = 30) -> DataFrame:
    """Through-origin, additive and affine fits of y on x per key; null where fewer than ``least`` pairs."""
    enough = F.count("*") >= least
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.when(enough, F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("scale"), F.when(enough, F.avg(F.col(y) - F.col(x))).alias("offset"), F.when(enough, F.regr_slope(y, x)).alias("slope"), F.when(enough, F.regr_intercept(y, x)).alias("intercept"))


def circular(direction) -> tuple[Column, Column]:
    """(mean direction, concentration) as aggregates."""
    r = F.radians(direction)
    s, c = F.avg(F.sin(r)), F.avg(F.cos(r))
    return F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)), F.hypot(s, c)


def doy_percentiles(rows: DataFrame, half_width: int = 10, least: int = 30, quantiles=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Percentiles of the pool of days within +/- half_width, circular over 365 days.

    ``rows``: key, doy, q. Percentiles do not pool from sums, so each value is spread to the
    days that it serves; pools of fewer than ``least`` are absent.
    """
    doy = F.least(F.col("doy"), F.lit(365))
    near = rows.withColumn("doy", F.explode(F.sequence(doy - half_width, doy + half_width))).withColumn("doy", F.pmod(F.col("doy") - 1, F.lit(365)) + 1)
    pooled = near.groupBy("key", "doy").agg(F.count("*").alias("n"), F.percentile("q", F.array(*[F.lit(x) for x in quantiles])).alias("p")).where(F.col("n") >= least)
    return pooled.select("key", "doy", "n", *[F.round(F.col("p")[i], 3).alias(f"p{round(100 * x)}") for i, x in enumerate(quantiles)])


def seasonal_context(value, p: dict[int, Column]) -> Column:
    """Piecewise-linear percentile of a value between p10 .. p90; 9 at or below, 91 at or above."""
    v = value if isinstance(value, Column) else F.col(value)
    steps = sorted(p)
    out = F.when(v <= p[steps[0]], F.lit(9.0)).when(v >= p[steps[-1]], F.lit(91.0))
    for a, b in zip(steps, steps[1:]):
        out = out.when(v <= p[b], F.lit(float(a)) + F.lit(float(b - a)) * (v - p[a]) / (p[b] - p[a]))
    return out


def anomaly_correlation(rows: DataFrame, key: str, order: str, model: str, truth: str, least: int = 4) -> DataFrame:
    """Correlation after each ordered series lost its own linear trend; null under ``least``.

    By moments: the residuals' covariances follow from those of the index and both series.
    """
    w = W.partitionBy(key).orderBy(order)
    x = rows.withColumn("x", F.row_number().over(w).cast("double"))
    got = x.groupBy(key).agg(F.count("*").alias("n"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("x", model).alias("xm"), F.covar_pop("x", truth).alias("xt"), F.covar_pop(model, model).alias("mm"), F.covar_pop(truth, truth).alias("tt"), F.covar_pop(model, truth).alias("mt"))
    c = F.col
    num, dm, dt = c("mt") - c("xm") * c("xt") / c("xx"), c("mm") - c("xm") * c("xm") / c("xx"), c("tt") - c("xt") * c("xt") / c("xx")
    return got.select(key, "n", F.when((c("n") >= least) & (dm > 1e-12) & (dt > 1e-12), num / F.sqrt(dm * dt)).alias("r"))


def site_validity(rows: DataFrame, key: str, bar_c: float = 3.0, least: int = 5) -> DataFrame:
    """Is a site usable as truth? Mean model and sensor against the satellite; who is further off."""
    got = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col("model") - F.col("sat")).alias("model_off"), F.avg(F.col("obs") - F.col("sat")).alias("obs_off"))
    m, o = F.abs("model_off"), F.abs("obs_off")
    verdict = F.when(F.col("n") < least, "thin").when((m <= bar_c) & (o <= bar_c), "usable").when(o > m, "observation off").otherwise("model off")
    return got.select(key, "n", "model_off", "obs_off", verdict.alias("verdict"))


# ------------------------------------------------------------------------------- ranks


def average_rank(rows: DataFrame, value: str, keys: list[str], name: str = "rank", ranges: int = 64) -> DataFrame:
    """Rows with the mean rank of their value within the keys; nulls are dropped."""
    ranked = value_ranks(rows, value, keys, ranges).select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return rows.join(ranked, [*keys, value])


def correction_families(rows: DataFrame, least: int = 20, smooth: int = 7) -> DataFrame:
    """Leave-one-group-out error of corrections of x towards y: group, kind, n, mae.

    ``rows``: group, x, y, w, doy, without nulls. raw, offset, linear, linear_wind (x and w) and linear_doy (the
    linear one plus its mean error within ``smooth`` days of the year: first by day, days without rows
    filled linearly between those with; 0 outside their range). Each is fitted on all other groups' sums, so the rows are read once to fit and once
    to score; groups of fewer than ``least`` rows, or with fewer outside, are skipped.
    """
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    sums = {"n": F.count("*"), "x": F.sum(x), "y": F.sum(y), "w": F.sum(w), "xx": F.sum(x * x), "xy": F.sum(x * y), "xw": F.sum(x * w), "ww": F.sum(w * w), "wy": F.sum(w * y)}
    own = rows.groupBy("group").agg(*[s.alias(f"s_{c}") for c, s in sums.items()])
    every = own.agg(*[F.sum(f"s_{c}").alias(f"t_{c}") for c in sums])
    rest = own.join(F.broadcast(every)).where((F.col("s_n") >= least) & (F.col("t_n") - F.col("s_n") >= least))
    rest = rest.select("group", *[(F.col(f"t_{c}") - F.col(f"s_{c}")).alias(f"r_{c}") for c in sums])
    r = lambda c: F.col(f"r_{c}")
    m = lambda a, b: r("xw" if {a, b} == {"x", "w"} else a + b) - r(a) * r(b) / r("n")
    wy, xy, xw, xx, ww = r("wy") - r("w") * r("y") / r("n"), m("x", "y"), m("x", "w"), m("x", "x"), m("w", "w")
    det = xx * ww - xw * xw
    fit = rest.select("group", ((r("y") - r("x")) / r("n")).alias("off"), F.try_divide(xy, xx).alias("a"), F.try_divide(xy * ww - wy * xw, det).alias("bx"), F.try_divide(wy * xx - xy * xw, det).alias("bw"), *[(r(c) / r("n")).alias(f"m_{c}") for c in "xyw"])
    fit = fit.withColumn("b", F.col("m_y") - F.col("a") * F.col("m_x")).withColumn("b0", F.col("m_y") - F.col("bx") * F.col("m_x") - F.col("bw") * F.col("m_w"))

    by_day = rows.groupBy("group", "doy").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    all_days = by_day.groupBy("doy").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy")])
    held = fit.select("group", "a", "b").join(F.broadcast(all_days))  # at most 366 days
    left = held.join(by_day, ["group", "doy"], "left").select("group", "doy", "a", "b", *[(F.col(f"t_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in ("n", "sx", "sy")]).where("n > 0")
    error = left.select("group", "doy", ((F.col("sy") - F.col("a") * F.col("sx") - F.col("b") * F.col("n")) / F.col("n")).alias("e"))
    by_doy = W.partitionBy("group").orderBy("doy")
    ahead = error.withColumns({"z_doy": F.coalesce(F.lead("doy").over(by_doy), F.col("doy") + 1), "z_e": F.lead("e").over(by_doy)}).withColumn("d", F.explode(F.sequence(F.col("doy"), F.col("z_doy") - 1)))
    between = F.col("e") + F.coalesce((F.col("d") - F.col("doy")) / (F.col("z_doy") - F.col("doy")) * (F.col("z_e") - F.col("e")), F.lit(0.0))
    filled = ahead.select("group", F.col("d").alias("doy"), between.alias("e"))  # at most 366 rows a group
    season = filled.select("group", "doy", F.avg("e").over(W.partitionBy("group").orderBy("doy").rangeBetween(-smooth, smooth)).alias("season"))

    linear = F.col("a") * x + F.col("b")
    kinds = {"raw": x, "offset": x + F.col("off"), "linear": linear, "linear_wind": F.col("b0") + F.col("bx") * x + F.col("bw") * w, "linear_doy": linear + F.coalesce("season", F.lit(0.0))}
    scored = rows.join(fit, "group").join(season, ["group", "doy"], "left").groupBy("group").agg(F.count("*").alias("n"), *[F.avg(F.abs(p - y)).alias(k) for k, p in kinds.items()])
    return scored.select("group", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("mae")) for k in kinds])).alias("s")).select("group", "s.kind", "n", "s.mae")


def nth_smallest(rows: DataFrame, value: str, keys: list[str], n: Column, name: str) -> DataFrame:
    """Per key, the n-th smallest value (from 1); ``n``: an expression over ``total``, the key's number of values."""
    ranked = value_ranks(rows, value, keys)
    total = ranked.groupBy(*keys).agg(F.sum("n").alias("total"))
    asked = ranked.join(total, keys).withColumn("_k", n)
    return asked.where((F.col("before") < F.col("_k")) & (F.col("_k") <= F.col("before") + F.col("n"))).select(*keys, F.col(value).alias(name))


def quantiles(rows: DataFrame, value: str, keys: list[str], asked: dict[str, float]) -> DataFrame:
    """Exact quantiles per key (null is a key, too) with linear interpolation: keys and a column for each of ``asked``.

    From counts per distinct value and their prefix sums (``value_ranks``): no task holds the values of a key.
    """
    named = {k: f"_q{i}" for i, k in enumerate(keys)}  # null keys meet as structs
    safe = rows.where(F.col(value).isNotNull()).select(F.struct(*[F.col(k).alias(n) for k, n in named.items()], F.lit(0).alias("_")).alias("_k"), F.col(value).alias("_v"))
    ranked = value_ranks(safe, "_v", ["_k"])
    total = safe.groupBy("_k").agg(F.count("*").alias("_total"))
    at = {name: (F.col("_total") - 1) * q for name, q in asked.items()}
    held = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    ends = ranked.join(total, "_k").groupBy("_k", "_total").agg(*[F.max(F.when(held(f(pos)), F.col("_v"))).alias(f"{name}_{side}") for name, pos in at.items() for side, f in (("a", F.floor), ("z", F.ceil))])
    between = lambda name, pos: F.col(f"{name}_a") + (pos - F.floor(pos)) * (F.col(f"{name}_z") - F.col(f"{name}_a"))
    return ends.select(*[F.col(f"_k.{n}").alias(k) for k, n in named.items()], *[between(name, pos).alias(name) for name, pos in at.items()])


def value_ranks(rows: DataFrame, value: str, keys: list[str], ranges: int = 64) -> DataFrame:
    """Per key and distinct value: n, how many rows have it, and before, how many have a smaller one.

    Counts per distinct value are prefix-summed in two levels (ranges of values between the key's
    approximate quantiles, then within a range), so no window has to hold a whole key and an
    outlier does not crowd the others into one range.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    span = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    joined = counts.join(span, keys) if keys else counts.join(F.broadcast(span))
    cut = joined.withColumn("_r", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    sums = cut.groupBy(*keys, "_r").agg(F.sum("_n").alias("_s"))
    starts = sums.withColumn("_start", F.sum("_s").over(W.partitionBy(*keys).orderBy("_r")) - F.col("_s")).drop("_s")
    inner = W.partitionBy(*keys, "_r").orderBy(value)
    return cut.join(starts, [*keys, "_r"]).select(*keys, value, F.col("_n").alias("n"), (F.col("_start") + F.sum("_n").over(inner) - F.col("_n")).alias("before"))


def spearman(rows: DataFrame, key: str, x: str, y: str, least: int = 10) -> DataFrame:
    """(key, n, rho, z): rank correlation, null under ``least`` pairs or without variance."""
    r = average_rank(average_rank(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, [key], "rx"), y, [key], "ry")
    got = r.groupBy(key).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    rho = F.when((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c"))
    return got.select(key, "n", rho.alias("rho"), (F.abs(rho) * F.sqrt(F.col("n") - 1)).alias("z"))


def normal_tail(z: str = "z"):
    """Two-sided normal tail of a result column; on a handful of result rows, so a pandas UDF is fine."""
    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda q: math.erfc(q / math.sqrt(2)), na_action="ignore")

    return tail(F.col(z))


def partial_spearman(rows: DataFrame, key: str, x: str, y: str, z: str, least: int = 30) -> DataFrame:
    """Rank correlation of x and y with z's rank taken out of both, from pairwise rank correlations."""
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    for c, name in ((x, "rx"), (y, "ry"), (z, "rz")):
        r = average_rank(r, c, [key], name)
    got = r.groupBy(key).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("a"), F.corr("rx", "rz").alias("b"), F.corr("ry", "rz").alias("c"))
    rest = (1 - F.col("b") * F.col("b")) * (1 - F.col("c") * F.col("c"))
    return got.select(key, "n", F.when((F.col("n") >= least) & (rest > 1e-12), (F.col("a") - F.col("b") * F.col("c")) / F.sqrt(rest)).alias("rho"))


def auc(rows: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with half for ties, rounded to 4; null with one class only."""
    r = average_rank(rows.where(F.col(label).isNotNull()), score, [key], "rank")
    got = r.groupBy(key).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"), F.sum(F.when(F.col(label), F.col("rank"))).alias("s"))
    return got.select(key, "pos", "neg", F.round(F.try_divide(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg")), 4).alias("auc"))


def logistic_fit(rows: DataFrame, x: str, label: str, steps: int = 100, tol: float = 1e-9, least: int = 20) -> dict | None:
    """Newton fit of P = 1/(1+exp(-(a+bx))): five sums a step, nothing else reaches the driver.

    Returns a, b, s50, width, n; None under ``least`` rows, with one class or a singular step.
    """
    data = rows.select(F.col(x).cast("double").alias("x"), F.col(label).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL").cache()
    n, pos = data.agg(F.count("*"), F.sum("y")).first()
    if n < least or not 0 < pos < n:
        data.unpersist()
        return None
    a = b = 0.0
    for _ in range(steps):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w, r = p * (1 - p), F.col("y") - p
        g0, g1, h0, h1, h2 = data.agg(F.sum(r), F.sum(r * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
        det = h0 * h2 - h1 * h1
        if abs(det) < 1e-12:
            a = b = 0.0
            break
        da, db = (h2 * g0 - h1 * g1) / det, (h0 * g1 - h1 * g0) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < tol:
            break
    data.unpersist()
    return None if abs(b) < 1e-6 else {"a": a, "b": b, "s50": -a / b, "width": 1 / b, "n": n}


# ------------------------------------------------------------------------------- resampling


def autocorrelation(daily: DataFrame, lags: int = 10) -> DataFrame:
    """ACF of daily mean errors (key, i = 0.., err) at lags 0..lags: key, lag, acf."""
    mean = daily.groupBy("key").agg(F.avg("err").alias("m"), F.var_pop("err").alias("v"), F.count("*").alias("n"))
    d = daily.join(mean, "key").withColumn("d", F.col("err") - F.col("m"))
    one = d.select("key", "v", "n", F.col("d").alias("d0"), "i", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    two = d.select("key", F.col("i").alias("j"), F.col("d").alias("d1"))
    return one.join(two, ["key", "j"]).groupBy("key", "lag").agg((F.sum(F.col("d0") * F.col("d1")) / F.first("n") / F.first("v")).alias("acf"))


def block_length(acf: DataFrame, low: int = 1, high: int = 10) -> DataFrame:
    """First lag under 1/e, clamped: key, block_days."""
    first = F.min(F.when((F.col("lag") > 0) & (F.col("acf") < 1 / math.e), F.col("lag")))
    return acf.groupBy("key").agg(F.least(F.greatest(F.coalesce(first, F.lit(high)), F.lit(low)), F.lit(high)).cast("int").alias("block_days"))


def draw(seed: int, replicate, slot, n) -> Column:
    """A block number in 0..n-1 by integer arithmetic that any engine can repeat."""
    x = (replicate * 7919 + slot * 104729 + seed) % 1_000_003
    return (x * x % 1_000_003 * 31 + replicate * 17 + slot) % 1_000_003 % n


def block_bootstrap_ratio(days: DataFrame, block_days: int, n_boot: int, seed: int = 1) -> DataFrame:
    """Interval of MAE ratio by resampling blocks of contiguous days.

    ``days``: key, i (day index), f, b (sums of forecast and baseline errors), n. Blocks are summed first;
    a replicate draws blocks until it has as many days, so what is resampled is small. One row per
    key: ratio, low, high, n_days, n_blocks; the bounds are null under 3 blocks.
    """
    blocks = days.withColumn("block", F.floor(F.col("i") / block_days)).groupBy("key", "block").agg(F.sum("f").alias("f"), F.sum("b").alias("b"), F.count("*").alias("d"))
    size = blocks.groupBy("key").agg(F.count("*").alias("k"), F.sum("d").alias("days"), (F.sum("f") / F.sum("b")).alias("ratio"))
    spec = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    drawn = spec.withColumn("block", draw(seed, F.col("rep"), F.col("slot"), F.col("k"))).join(blocks.select("key", "block", "f", "b"), ["key", "block"])
    ratios = drawn.groupBy("key", "rep").agg(F.try_divide(F.sum("f"), F.sum("b")).alias("r"))
    q = ratios.groupBy("key").agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))
    enough = F.col("k") >= 3
    return size.join(q, "key", "left").select("key", F.col("days").alias("n_days"), F.col("k").alias("n_blocks"), "ratio", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def sign_test_days(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Wins, losses and ties of the daily MAE against the baseline, with the exact binomial p.

    The tail is a sum over ``sequence`` of exp(log choose - n log 2), all in the engine.
    """
    daily = rows.where("f IS NOT NULL AND b IS NOT NULL").groupBy(*keys, "day").agg(F.avg(F.abs("f")).alias("mf"), F.avg(F.abs("b")).alias("mb"))
    got = daily.groupBy(*keys).agg(F.count_if(F.col("mf") < F.col("mb")).alias("wins"), F.count_if(F.col("mf") > F.col("mb")).alias("losses"), F.count_if(F.col("mf") == F.col("mb")).alias("ties"))
    n, k = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    t = got.withColumn("n", n)
    half = -n * F.log(F.lit(2.0))
    pair = lambda c, total: F.struct(c.alias("c"), total.alias("total"))  # noqa: E731  (log of n over i, and the sum so far)

    def add(acc: Column, i: Column) -> Column:
        c = acc["c"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.when(i <= k, pair(c, acc["total"] + F.exp(c + half))).otherwise(acc)

    tail = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), k).cast("int")), pair(F.lit(0.0), F.exp(half)), add)["total"]
    return t.select(*keys, "wins", "losses", "ties", F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).alias("p"))
