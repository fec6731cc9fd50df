"""Scoring of forecasts against measured series: gate rows, in-situ reports and event scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import pin
from . import events, profiles, reports
from .scan import DAY_US, HOUR_US


def forecast_gate(forecasts: DataFrame, nowcasts: DataFrame, observed: DataFrame, anchors: DataFrame, target: float, deep: float, max_age: int = 2, least: int = 5) -> DataFrame:
    """Forecast isotherm depths beside the observed crossing, with what was known at issue time.

    ``forecasts``: station, day (valid), lead_h, depths, temps; ``nowcasts`` and ``observed``: station,
    day, depths, temps; ``anchors``: station, day, sst. An observation counts only if at least ``least``
    levels hold a value and the profile crosses the target. The surface anchor is the newest of at most
    ``max_age`` days up to the issue, never one of the valid day; without it the corrected depths are
    null. Persistence is the corrected nowcast of the issue day.
    """
    levels = F.filter(F.arrays_zip("depths", "temps"), lambda s: s["temps"].isNotNull())
    seen = observed.select("station", "day", levels.alias("l")).where(F.size("l") >= least)
    seen = seen.select("station", "day", profiles.crossing(F.transform("l", lambda s: s["depths"]), F.transform("l", lambda s: s["temps"]), target).alias("o")).where("o.status = 'crossing'")
    known = anchors.select("station", F.explode(F.sequence(F.col("day"), F.col("day") + max_age)).alias("issue"), "day", "sst").groupBy("station", "issue").agg(F.max_by("sst", "day").alias("sst"))
    depths, temps = F.col("depths"), F.col("temps")
    corrected = profiles.corrected(depths, temps, F.element_at(temps, 1) - F.col("sst"), deep)
    depth = F.when(F.col("sst").isNotNull(), profiles.crossing(depths, corrected, target)["depth"])
    held = nowcasts.withColumnRenamed("day", "issue").join(known, ["station", "issue"]).select("station", "issue", depth.alias("persist_iso"))
    rows = forecasts.withColumn("issue", F.col("day") - F.floor(F.col("lead_h") / 24)).join(seen, ["station", "day"]).join(known, ["station", "issue"], "left")
    rows = rows.withColumn("raw", profiles.crossing(depths, temps, target)).withColumn("corr_iso", depth).join(held, ["station", "issue"], "left")
    miss = lambda c: F.abs(F.col(c) - F.col("o.depth"))
    return rows.select("station", "day", "lead_h", "issue", F.col("o.depth").alias("obs_iso"), F.col("raw.depth").alias("raw_iso"), F.col("raw.status").alias("fcst_status"), "corr_iso", miss("corr_iso").alias("abs_err"), "persist_iso", miss("persist_iso").alias("persist_abs_err"), F.when(F.col("sst").isNull(), "absent").otherwise("ok").alias("anchor"))


def modal_six_hours(rows: DataFrame, first_md: int = 615, last_md: int = 930) -> DataFrame:
    """Six-hour means of a station's most frequent depth (the shallowest on ties) within the season.

    ``rows``: station, us, depth, temp; the season is month * 100 + day, both ends included.
    """
    n = rows.groupBy("station", "depth").agg(F.count("*").alias("n"))
    mode = n.groupBy("station").agg(F.min_by("depth", F.struct(-F.col("n"), "depth")).alias("depth"))
    ts = F.timestamp_micros("us")
    inside = rows.join(mode, ["station", "depth"]).where((F.month(ts) * 100 + F.dayofmonth(ts)).between(first_md, last_md))
    return inside.groupBy("station", F.floor(F.col("us") / (6 * HOUR_US)).alias("slot")).agg(F.avg("temp").alias("temp")).where("temp IS NOT NULL")


def in_situ(model: DataFrame, truth: DataFrame, window: int = 60, train: float = 0.6) -> DataFrame:
    """One row a station over the six-hour slots that both series hold (station, slot, temp).

    Errors at six hours, of daily and 30-day means; skill of the anomalies from the centred mean of
    ``window`` rows (at least half of them); and the error on the last rows before and after an
    offset fitted on the first ``train`` share.
    """
    pair = model.select("station", "slot", F.col("temp").alias("m")).join(truth.select("station", "slot", F.col("temp").alias("o")), ["station", "slot"])
    w = W.partitionBy("station").orderBy("slot")
    centred, whole = w.rowsBetween(-(window // 2), window - window // 2 - 1), W.partitionBy("station")
    enough = F.count("*").over(centred) >= window // 2
    day = F.floor(F.col("slot") / 4)
    j = pair.withColumns({"day": day, "late": F.row_number().over(w) > F.floor(F.count("*").over(whole) * train), "month": F.floor((day - F.min(day).over(whole)) / 30)})
    j = j.withColumns({"ma": F.when(enough, F.col("m") - F.avg("m").over(centred)), "oa": F.when(enough, F.col("o") - F.avg("o").over(centred))})
    e, late = F.col("m") - F.col("o"), F.col("late")
    main = j.groupBy("station").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("m", "o").alias("r"), F.corr("ma", "oa").alias("anomaly_r"),
        F.avg(F.abs("oa")).alias("clim_mae"), (1 - F.try_divide(F.avg(F.abs(F.col("ma") - F.col("oa"))), F.avg(F.abs("oa")))).alias("skill"), F.avg(F.when(~late, -e)).alias("offset"), F.avg(F.when(late, F.abs(e))).alias("late_mae"))
    fixed = j.where(late).join(main.select("station", "offset"), "station").groupBy("station").agg(F.avg(F.abs(e + F.col("offset"))).alias("late_corrected_mae"))
    coarse = lambda by, name: j.groupBy("station", by).agg(F.avg("m").alias("m"), F.avg("o").alias("o")).groupBy("station").agg(F.avg(F.abs(e)).alias(name))
    return main.join(fixed, "station", "left").join(coarse("day", "daily_mae"), "station").join(coarse("month", "monthly_mae"), "station")


#: Metres of depth that are one bucket where isotherms meet pixels.
DEPTH_M = 0.25


def trajectory(columns: DataFrame, patches: DataFrame, target: float, surface: float, band: tuple[float, float, float], cast_m: float, cap_m: float, res_m: float) -> DataFrame:
    """Can cold water be reached at each lead? spot, lead, iso, shallow, deep, reach, nearest, area, certain, possible, gradient.

    ``columns``: spot, lead, depths, temps, a water column for each spot and lead; ``patches``: spot, depth, dist, the pixels around a spot.
    The column is corrected and its isotherm taken with the band's bounds. ``reach``: a pixel lies at least as deep as the isotherm, within
    the cast and not below the cap; ``certain`` and ``possible`` ask the same of the deep and the shallow bound. The
    gradient is that of the corrected column at its isotherm. Without an isotherm nothing is reached. A spot's pixels are
    counted by depth once; a lead looks its isotherm up in the counts at least as deep, so no lead meets all pixels.
    """
    key = columns.withColumn("node", F.struct("spot", "lead"))
    iso = profiles.isotherm_band(key, target, surface, band).select("node.spot", "node.lead", F.col("depth").alias("iso"), "shallow", "deep")
    fixed = columns.select("spot", "lead", "depths", profiles.corrected(F.col("depths"), F.col("temps"), surface, band[0]).alias("temps")).join(iso, ["spot", "lead"])
    rows = fixed.select("spot", "lead", "iso", "shallow", "deep", profiles.local_gradient(F.col("depths"), F.col("temps"), F.col("iso")).alias("gradient"))
    near = patches.where((F.col("dist") <= cast_m) & (F.col("depth") <= cap_m) & F.col("spot").isNotNull()).groupBy("spot", "depth").agg(F.count("*").alias("n"), F.min("dist").alias("dist"))
    deeper = W.partitionBy("spot").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    levels = near.select("spot", (-F.col("depth")).alias("_at"), F.sum("n").over(deeper).alias("n"), F.min("dist").over(deeper).alias("nearest"))
    deepest = near.groupBy("spot").agg(F.max("depth").alias("_deepest"))
    met = events.asof_join(rows.withColumn("_at", F.when(~F.isnan("iso"), -F.col("iso"))), levels, ["spot"], ["n", "nearest"], time="_at", width=DEPTH_M).join(deepest, "spot", "left")
    ok = lambda bound: F.coalesce(F.col("_deepest") >= F.col(bound), F.lit(False))
    n = F.coalesce("n", F.lit(0))
    return met.select("spot", "lead", "iso", "shallow", "deep", "gradient", (n > 0).alias("reach"), "nearest", (n * res_m * res_m).alias("area"), ok("deep").alias("certain"), ok("shallow").alias("possible"))


def reach_windows(points: DataFrame, width: int = 1000) -> DataFrame:
    """Contiguous leads of a spot at which water is reached: spot, first_lead, last_lead, n, certain (at every one of them)."""
    runs = events.islands(points.select(F.col("spot").alias("station"), "lead", "reach", "certain"), "reach", ["lead"], width)
    return runs.groupBy(F.col("station").alias("spot"), "island").agg(F.min("lead").alias("first_lead"), F.max("lead").alias("last_lead"), F.count("*").alias("n"), F.every("certain").alias("certain")).drop("island")


def in_situ_events(model: DataFrame, truth: DataFrame, drop_c: float = 4.0, persist_h: float = 12.0, tau: int = 1, window_us: int = 2 * DAY_US) -> DataFrame:
    """Episodes of sustained drops in the six-hour slots that both series hold: station, hits, misses, false_alarms, pod, far.

    The measured series is the truth. POD is null without a true episode, FAR without a detected one; a station without either
    has no row.
    """
    pair = pin(model.select("station", "slot", F.col("temp").alias("m")).join(truth.select("station", "slot", F.col("temp").alias("o")), ["station", "slot"]), "pairs")
    found = lambda c: onset_episodes(pair.select(F.col("slot").alias("event_id"), "station", (F.col("slot") * 6 * HOUR_US).alias("us"), F.col(c).alias("temp_c")), drop_c, persist_h, window_us=window_us)
    per = reports.greedy_match(found("o"), found("m"), tau)
    return per.withColumns({"pod": F.try_divide("hits", F.col("hits") + F.col("misses")), "far": F.try_divide("false_alarms", F.col("hits") + F.col("false_alarms"))})


def wind_agreement(temps: DataFrame, wind: DataFrame, window_us: int = 2 * DAY_US) -> DataFrame:
    """Correlation of the temperature with the favourable wind run up to it: station, n, r. Negative where wind drives cold water.

    A reading takes the wind run of the last wind sample at or before it; readings before the first one do not count.
    r is null under three readings or where one side does not vary.
    """
    pairs = events.asof_join(temps.select("station", "us", "temp_c"), events.wind_run(wind, window_us), ["station"], ["drive"]).where("drive IS NOT NULL AND temp_c IS NOT NULL")
    return pairs.groupBy("station").agg(F.count("*").alias("n"), F.when(F.count("*") > 2, F.try_divide(F.covar_pop("drive", "temp_c"), F.stddev_pop("drive") * F.stddev_pop("temp_c"))).alias("r"))


def onset_episodes(rows: DataFrame, drop_c: float, persist_h: float, merge_gap: int = 1, window_us: int = DAY_US) -> DataFrame:
    """Episodes of sustained drops by their first day: station, day."""
    return _first_days(events.onsets(rows, drop_c, persist_h, window_us), merge_gap)


def _first_days(runs: DataFrame, merge_gap: int = 1) -> DataFrame:
    days = runs.select("station", F.floor(F.col("us") / DAY_US).alias("day"))
    return events.episodes(days, merge_gap).select("station", F.col("first_day").alias("day"))


def episode_counts(rows: DataFrame, drop_c: float, settings: list[float]) -> DataFrame:
    """Episodes a station for each persistence setting, to choose one on a tuning period: station, persist_h, n.

    The runs are found once; a setting only asks how long they last.
    """
    runs = pin(events.onsets(rows, drop_c, 0.0), "runs")
    names = rows.select("station").distinct()
    out = None
    for h in settings:
        n = _first_days(runs.where(F.col("end_us") - F.col("us") >= h * HOUR_US)).groupBy("station").agg(F.count("*").alias("n"))
        one = names.join(n, "station", "left").select("station", F.lit(float(h)).alias("persist_h"), F.coalesce("n", F.lit(0)).alias("n"))
        out = one if out is None else out.union(one)
    return out


def scorecard(truth: DataFrame, detected: DataFrame, season_days: int, tau: int = 1) -> DataFrame:
    """Pooled events of a held-out period (one row): hits, misses, false alarms, POD, FAR, chance POD.

    POD and its chance value are null without truth, FAR without detections. Chance is that of as
    many alarms a station thrown at random into the season.
    """
    per = reports.greedy_match(truth, detected, tau)
    n_truth, n_found = F.col("hits") + F.col("misses"), F.col("hits") + F.col("false_alarms")
    lucky = 1 - F.pow(F.lit(1 - (2 * tau + 1) / season_days), n_found)
    s = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "misses", "false_alarms")], F.sum(n_truth * lucky).alias("luck"))
    return s.select("hits", "misses", "false_alarms", F.try_divide("hits", n_truth).alias("pod"), F.try_divide("false_alarms", n_found).alias("far"), F.try_divide("luck", n_truth).alias("chance_pod"))
