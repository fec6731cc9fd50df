"""Composed reports: matching, transfer, lag scans, audits and other results built from the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exprs
from ..session import pin
from . import events, scan, verify
from .scan import HOUR_US


def anchor_rows(rows: DataFrame) -> DataFrame:
    """Anchor measurements fit for use; ``cloud``, ``dist``, ``delta`` and ``landsat`` are text, ``month`` a number.

    July to September, cloud of at most 10, within 150 m, a difference of -3 to 6 and a reading
    of 2 to 26; blank cloud or distance counts as 0, and a row with a value that is no number goes.
    """
    number = lambda c: F.col(c).try_cast("double")
    or_zero = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", 0.0).otherwise(number(c))
    good = F.col("month").between(7, 9) & (or_zero("cloud") <= 10) & (or_zero("dist") <= 150) & number("delta").between(-3, 6) & number("landsat").between(2, 26)
    return rows.where(good)


def permuted_spread(days: DataFrame, onsets: DataFrame, reps: int, width: int = 7, least: int = 5) -> DataFrame:
    """Do onsets come at alike values? One row: n, sd, valid, p; null under ``least`` years.

    ``days``: year, doy, value; ``onsets``: year, doy. sd is that of the trailing ``width``-day means at
    the onsets, over the years whose own onset has one; a mean needs all its days. p is the share of ``reps`` permuted
    pairings of these years and their onset days whose sd is no larger; a pairing counts if every year has a mean. The
    inputs are a row a day and a year, so a permutation is an order of the years by a small hash.
    """
    back = days.select("year", F.explode(F.sequence(F.col("doy"), F.col("doy") + width - 1)).alias("doy"), "value")
    means = back.groupBy("year", "doy").agg(F.avg("value").alias("m"), F.count("value").alias("k")).where(F.col("k") == width).select("year", "doy", "m")
    usable = pin(onsets.select("year", "doy").join(means.select("year", "doy"), ["year", "doy"], "left_semi"), "years")
    numbered = usable.select("year", "doy", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("year")).alias("k"))
    draw = F.pmod(F.col("rep").cast("long") * 7919 + F.col("year") * 104729 + 1, F.lit(1_000_003))
    order = F.row_number().over(W.partitionBy("rep").orderBy(F.pmod(draw * draw, F.lit(1_000_003)), "year"))
    spine = usable.select("year").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).select("rep", "year", order.alias("k"))
    paired = spine.join(numbered.select("k", "doy"), "k").select("rep", "year", "doy").union(usable.select(F.lit(0), "year", "doy"))
    spread = paired.join(means, ["year", "doy"]).groupBy("rep").agg(F.stddev_pop("m").alias("sd"), F.count("*").alias("n"))
    seen = spread.where("rep = 0").select(F.col("sd").alias("seen"), F.col("n").alias("years")).where(F.col("years") >= least)
    return spread.where("rep > 0").join(F.broadcast(seen)).where(F.col("n") == F.col("years")).groupBy("years", "seen").agg(F.count("*").alias("valid"), F.avg((F.col("sd") <= F.col("seen")).cast("int")).alias("p")).select(F.col("years").alias("n"), F.col("seen").alias("sd"), "valid", "p")


def greedy_match(truth: DataFrame, detected: DataFrame, tau: int = 1) -> DataFrame:
    """Per station one-to-one matches of truth days, in order, to the nearest unused detection within tau.

    The first of equally near ones wins. Only days with a candidate are grouped, so a group is as
    small as a station's episodes. Columns: station, hits, misses, false_alarms.
    """
    pairs = truth.select("station", F.col("day").alias("t"), F.explode(F.sequence(F.col("day") - tau, F.col("day") + tau)).alias("d")).join(detected.select("station", F.col("day").alias("d")), ["station", "d"])

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        hits = 0
        for _, own in rows.sort_values(["t", "d"]).groupby("t"):
            free = [(abs(t - d), d) for t, d in zip(own["t"], own["d"]) if d not in used]
            if free:
                used.add(min(free)[1])
                hits += 1
        return pd.DataFrame({"station": [rows["station"].iloc[0]], "hits": [hits]})

    hits = pairs.groupBy("station").applyInPandas(match, "station string, hits long")
    n = truth.groupBy("station").agg(F.count("*").alias("nt")).join(detected.groupBy("station").agg(F.count("*").alias("nd")), "station", "full").join(hits, "station", "left").na.fill(0, ["nt", "nd", "hits"])
    return n.select("station", "hits", (F.col("nt") - F.col("hits")).alias("misses"), (F.col("nd") - F.col("hits")).alias("false_alarms"))


def tendency(rows: DataFrame, at_us: int, value: str, window_h: float = 3.0, band: float = 1.0) -> DataFrame:
    """Tendency per station: the sample nearest the instant against the one nearest three hours before it."""
    gap = lambda t: F.struct(F.abs(F.col("us") - t), F.col("us"), F.col("event_id"))
    now = rows.groupBy("station").agg(F.min_by(F.struct("us", value), gap(F.lit(at_us))).alias("c"))
    both = rows.join(now, "station")
    prev = both.groupBy("station", "c").agg(F.min_by(F.struct("us", value), gap(F.col("c.us") - int(window_h * HOUR_US))).alias("p"))
    hours = (F.col("c.us") - F.col("p.us")) / HOUR_US
    trend = F.when(hours >= window_h / 2, (F.col(f"c.{value}") - F.col(f"p.{value}")) * (window_h / hours))
    state = F.when(trend.isNull(), "unknown").when(trend <= -band, "falling").when(trend >= band, "rising").otherwise("steady")
    return prev.select("station", F.col(f"c.{value}").alias("level"), trend.alias("trend"), state.alias("state"))


def smoothed_direction(rows: DataFrame, half_h: int = 6) -> DataFrame:
    """Circular mean direction within +/- half_h of each sample."""
    half, r = half_h * HOUR_US, F.radians("dir_deg")
    own = rows.select("event_id", "station", "us", "dir_deg")
    framed = scan.framed(own, ["station"], {"s": ("sum", F.sin(r)), "c": ("sum", F.cos(r)), "n": ("count", r)}, back=half, ahead=half)
    return framed.select("event_id", "station", F.pmod(F.degrees(F.atan2(F.try_divide("s", "n"), F.try_divide("c", "n"))), F.lit(360.0)).alias("dir"))


def spaced(stations: DataFrame, step: int) -> DataFrame:
    """The station at or before each evenly spaced target along a line; a short line gives its middle.

    ``stations``: river, idx, cum (cumulative length).
    """
    total = stations.groupBy("river").agg(F.max("cum").alias("total"))
    at = F.when(F.col("total") < step, F.array(F.floor(F.col("total") / 2))).otherwise(F.sequence(F.lit(0), F.col("total"), F.lit(step)).cast("array<bigint>"))
    targets = total.select("river", F.explode(at).alias("cum"))
    return events.asof_join(targets, stations.select("river", "cum", "idx"), ["river"], ["idx"], time="cum", width=100_000)


def sun_path(lat: Column, doy: Column) -> list[Column]:
    """``offset`` and ``swing`` of a day: the sine of the sun's altitude is offset + swing * cos(hour angle), by the mean declination."""
    decl, la = F.radians(F.lit(-23.44) * F.cos(F.lit(2 * 3.141592653589793 / 365) * (doy + 10))), F.radians(lat)
    return [(F.sin(la) * F.sin(decl)).alias("offset"), (F.cos(la) * F.cos(decl)).alias("swing")]


def light_windows(places: DataFrame, horizon: float = -0.833) -> DataFrame:
    """First and last lit minute of each (point, doy), on a spine of all minutes of local day.

    The sun is followed once for each place and day, however many points lie there; sines are compared, not angles.
    """
    paths = places.select("lat", "lon", "doy").distinct().select("lat", "lon", "doy", *sun_path(F.col("lat"), F.col("doy")))
    spine = paths.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(1439))))
    hour = F.radians((F.col("m") - F.col("lon") * 4) / 4 - 180 + F.col("lon"))
    up = F.col("offset") + F.col("swing") * F.cos(hour) >= F.sin(F.radians(F.lit(horizon)))
    lit = spine.where(up).groupBy("lat", "lon", "doy").agg(F.min("m").alias("rise"), F.max("m").alias("sets"))
    return places.join(lit, ["lat", "lon", "doy"]).groupBy("point", "doy").agg(F.min("rise").alias("rise"), F.max("sets").alias("sets"))


def lag_scan(x: DataFrame, y: DataFrame, lags: int = 4) -> DataFrame:
    """Rank correlation of y with x a number of days before: station, lag, n, rho, z."""
    shifted = x.select("station", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "day", "value").select("station", "lag", (F.col("day") + F.col("lag")).alias("day"), F.col("value").alias("x"))
    pairs = shifted.join(y.select("station", "day", F.col("value").alias("y")), ["station", "day"]).withColumn("k", F.concat_ws(":", "station", "lag"))
    got = verify.spearman(pairs, "k", "x", "y")
    return got.select(F.split_part("k", F.lit(":"), F.lit(1)).alias("station"), F.split_part("k", F.lit(":"), F.lit(2)).cast("int").alias("lag"), "n", "rho", "z")


def pss_bootstrap(days: DataFrame, block_days: int, n_boot: int, seed: int = 12345) -> DataFrame:
    """Interval of PSS by resampling blocks of days that were summed to four counts.

    ``days``: key, i, a, b, c, d. Exactly as many draws as blocks; undefined replicates are left out.
    """
    counts = [F.sum(x).alias(x) for x in "abcd"]
    blocks = days.withColumn("block", F.floor(F.col("i") / block_days)).groupBy("key", "block").agg(*counts)
    size = blocks.groupBy("key").agg(F.count("*").alias("k"))
    spec = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    drawn = spec.withColumn("block", verify.draw(seed, F.col("rep"), F.col("slot"), F.col("k"))).join(blocks, ["key", "block"]).groupBy("key", "rep").agg(*counts)
    pss = F.try_divide("a", F.col("a") + F.col("c")) - F.try_divide("b", F.col("b") + F.col("d"))
    got = drawn.select("key", pss.alias("pss")).where("pss IS NOT NULL").groupBy("key").agg(F.count("*").alias("valid"), F.percentile("pss", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return got.select("key", "valid", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def first_half_fit(rows: DataFrame, key: str) -> DataFrame:
    """Slope of truth on model anomalies from the first half of the days, and its error on the rest."""
    mid = rows.groupBy(key).agg(F.percentile("day", F.lit(0.5)).alias("mid"))
    r = rows.join(mid, key).withColumn("train", F.col("day") <= F.col("mid"))
    fit = r.where("train").groupBy(key).agg(F.regr_slope("truth", "model").alias("slope"), F.regr_intercept("truth", "model").alias("intercept"))
    return r.where("NOT train").join(fit, key).groupBy(key).agg(F.first("slope").alias("slope"), F.count("*").alias("n"), F.avg(F.abs(F.col("intercept") + F.col("slope") * F.col("model") - F.col("truth"))).alias("mae"))


def audit(checks: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """One row per expectation: name, value, verdict (pass, warn or fail).

    Each check is a table, an aggregate and a predicate on it (column ``value``).
    """
    out = None
    for name, (df, value, good) in checks.items():
        row = df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), "value", F.when(F.col("value").isNull(), "fail").when(good, "pass").otherwise("warn").alias("verdict"))
        out = row if out is None else out.union(row)
    return out


def published(results: DataFrame, spine: DataFrame, key: str, prior: float) -> DataFrame:
    """A measured value where its result is complete and passed, else the prior with the reason."""
    j = spine.join(results, key, "left")
    good = F.coalesce(F.col("complete") & F.col("passed"), F.lit(False))
    reason = F.when(good, None).when(F.col("complete").isNull(), "no result").when(~F.col("complete"), "incomplete").otherwise("not passed")
    return j.select(key, F.when(good, F.col("value")).otherwise(F.lit(prior)).alias("value"), reason.alias("reason"))


def chain_stats(rows: DataFrame, key: str) -> DataFrame:
    """Raw and corrected MAE, skill, day-to-day persistence on consecutive days, constant-reference flag."""
    w = W.partitionBy(key).orderBy("day")
    r = rows.withColumn("step", F.when(F.col("day") - F.lag("day").over(w) == 1, F.abs(F.col("obs") - F.lag("obs").over(w))))
    raw, corr = F.avg(F.abs(F.col("raw") - F.col("obs"))), F.avg(F.abs(F.col("corr") - F.col("obs")))
    return r.groupBy(key).agg(F.count("*").alias("n"), raw.alias("raw_mae"), corr.alias("corr_mae"), (1 - corr / raw).alias("skill"), F.avg("step").alias("day_to_day"), (F.count_distinct("obs") == 1).alias("constant"))
