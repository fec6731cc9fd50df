"""Runs, onsets, sessions and as-of joins on irregular time series.

Tables are keyed by ``station`` with times ``us`` (microseconds, UTC). All functions are lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exprs
from ..session import pin
from . import scan
from .scan import BUCKET_US, DAY_US, HOUR_US


def _by_time(*more) -> W:
    return W.partitionBy("station").orderBy("us", *more)


# ------------------------------------------------------------------------------- joins in time


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], time: str = "us", width: int = BUCKET_US) -> DataFrame:
    """Each left row with the values of the last right row at or before its time; null if none.

    One shuffle on the keys and buckets of time: both sides are stacked, equal times put the right side first, and
    the last right row so far is carried forward, from bucket to bucket, too.
    """
    one = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(time, *values).alias("s")).schema["s"].dataType).alias("_right"))
    own = [c for c in left.columns if c not in keys and c != time]
    two = right.select(*keys, time, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own], F.lit(0).alias("_side"), F.struct(time, *values).alias("_right"))
    both = scan.carried(one.unionByName(two), keys, [time, "_side"], before={"_last": F.col("_right")}, width=width).where("_side = 1")
    return both.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def asof_latest(rows: DataFrame, at_us: Column | int, value: str = "temp_c") -> DataFrame:
    """Per station the newest value at or before an instant (inclusive)."""
    t = at_us if isinstance(at_us, Column) else F.lit(at_us)
    return rows.where(F.col("us") <= t).groupBy("station").agg(F.max_by(value, F.struct("us", "event_id")).alias(value), F.max("us").alias("us"))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance_us: int, tie: str) -> DataFrame:
    """Each left row with the right row nearest in time within the tolerance (earlier on ties, then the smallest ``tie``).

    Both sides are stacked in buckets of time, the right one with a halo of the tolerance; the last right row so far is carried
    forward and backward, so a left row meets two right rows, however many lie within the tolerance.
    """
    width = max(DAY_US, tolerance_us)
    there = right.dropna(subset=[*keys, "us"]).groupBy(*keys, "us").agg(F.min(F.struct(tie, *[v for v in values if v != tie])).alias("_v")).withColumn("_at", F.struct("us", "_v"))
    own = [c for c in left.columns if c not in keys and c != "us"]
    one = left.dropna(subset=[*keys, "us"]).withColumns({"_b": F.floor(F.col("us") / width), "_side": F.lit(1), "_at": F.lit(None).cast(there.schema["_at"].dataType)})
    two = scan.with_halo(there, tolerance_us, tolerance_us, width).select(*keys, "us", *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own], "_b", F.lit(0).alias("_side"), "_at")
    w = W.partitionBy(*keys, "_b")
    last = lambda *order: F.last("_at", ignorenulls=True).over(w.orderBy(*order, "_side").rowsBetween(W.unboundedPreceding, 0))
    met = one.unionByName(two).withColumn("_a", last("us")).withColumn("_z", last(F.desc("us"))).where("_side = 1")
    past, coming = F.col("us") - F.col("_a.us"), F.col("_z.us") - F.col("us")
    near = F.when(F.col("_z").isNull() | (past <= coming), F.col("_a")).otherwise(F.col("_z"))
    best = met.withColumn("_m", near).withColumn("gap_us", F.abs(F.col("us") - F.col("_m.us"))).where(F.col("gap_us") <= tolerance_us)
    return best.select(*left.columns, "gap_us", *[F.col(f"_m._v.{v}").alias(v) for v in values])


def hourly_snap(rows: DataFrame, tolerance_us: int = 10 * HOUR_US // 60) -> DataFrame:
    """Each reading competes for its own and the next full hour; the smallest gap wins."""
    h = F.floor(F.col("us") / HOUR_US)
    near = rows.withColumn("h", F.explode(F.array(h, h + 1))).withColumn("gap", F.abs(F.col("us") - F.col("h") * HOUR_US)).where(F.col("gap") <= tolerance_us)
    return near.groupBy("station", "h").agg(F.min_by(F.struct("event_id", "speed_kn", "dir_deg"), F.struct("gap", "us", "event_id")).alias("m")).select("station", "h", "m.*")


def persistence(obs: DataFrame, lead_h: int) -> DataFrame:
    """Each hourly value beside the value one lead earlier (left join, null allowed)."""
    before = obs.select("station", (F.col("h") + lead_h).alias("h"), F.col("value").alias("persist"))
    return obs.join(before, ["station", "h"], "left")


def other_years_climatology(rows: DataFrame, half_width: int = 7) -> DataFrame:
    """Mean over day-of-year +/- half_width of all years but the row's own; no wrap at the year's end.

    ``rows``: key, year, doy, value. Sums per year are spread to their neighbouring days, pooled
    over years and the own year's part is taken out, so nothing is joined by range.
    """
    daily = rows.groupBy("key", "year", "doy").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    spread = daily.withColumn("doy", F.explode(F.sequence(F.col("doy") - half_width, F.col("doy") + half_width))).groupBy("key", "year", "doy").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    pooled = spread.groupBy("key", "doy").agg(F.sum("s").alias("ps"), F.sum("n").alias("pn"))
    own = rows.select("key", "year", "doy").distinct().join(spread, ["key", "year", "doy"]).join(pooled, ["key", "doy"])
    return own.select("key", "year", "doy", (F.col("pn") - F.col("n")).alias("n"), F.try_divide(F.col("ps") - F.col("s"), F.col("pn") - F.col("n")).alias("clim"))


# ------------------------------------------------------------------------------- integrals


def wind_run(rows: DataFrame, window_us: int = DAY_US, sector=exprs.SECTOR, bucket_us: int = 7 * DAY_US) -> DataFrame:
    """Trapezoid of in-sector speed over the samples of the trailing window, in kt h.

    Calm counts as 0, a null direction that is not calm is no sample, stations of fewer than
    two samples give nothing. Only samples of one window are needed, so a station's series
    is cut into buckets that carry a window of samples before them: one long
    series is many tasks.
    """
    v = F.when(exprs.in_sector("dir_deg", sector), F.col("speed_kn")).otherwise(F.lit(0.0))
    good = rows.where(F.col("speed_kn").isNotNull() & (F.col("dir_deg").isNotNull() | (F.col("speed_kn") == 0))).withColumn("v", v)
    enough = good.groupBy("station").agg(F.count("*").alias("n")).where("n >= 2").select("station")
    b = F.floor(F.col("us") / bucket_us)
    halo = F.sequence(b, F.floor((F.col("us") + window_us) / bucket_us))
    cut = good.join(enough, "station").withColumn("bucket", F.explode(halo))
    w = W.partitionBy("station", "bucket").orderBy("us", "event_id")
    area = (F.col("v") + F.lag("v").over(w)) / 2 * ((F.col("us") - F.lag("us").over(w)) / HOUR_US)
    out = cut.withColumn("area", F.coalesce(area, F.lit(0.0))).where(F.floor(F.col("us") / bucket_us) == F.col("bucket")).select("event_id", "station", "us", "area")
    run = scan.framed(out, ["station"], {"all": ("sum", F.col("area")), "first": ("first", F.col("area"))}, back=window_us, tie=("event_id",))
    return run.select("event_id", "station", "us", (F.col("all") - F.col("first")).alias("drive"))


# ------------------------------------------------------------------------------- onsets and islands


def dropped(rows: DataFrame, window_us: int) -> DataFrame:
    """``rows`` with drop_c: the trailing maximum minus the value."""
    top = scan.framed(rows, ["station"], {"_top": ("max", F.col("temp_c"))}, back=window_us)
    return top.withColumn("drop_c", F.col("_top") - F.col("temp_c")).drop("_top")


def drop_events(rows: DataFrame, drop_c: float = 4.0, cold_c: float = 12.0, window_us: int = DAY_US) -> DataFrame:
    """Rising edges of 'trailing maximum minus value >= drop, or value <= cold', with their trigger."""
    d, t = F.col("drop_c"), F.col("temp_c")
    out = dropped(rows, window_us).withColumn("active", (d >= drop_c) | (t <= cold_c))
    edge = scan.carried(out, ["station"], ["us", "event_id"], before={"_was": F.struct("active")}).where(F.col("active") & ~F.coalesce(F.col("_was.active"), F.lit(False)))
    trigger = F.when((d >= drop_c) & (t <= cold_c), "both").when(d >= drop_c, "drop").otherwise("cold_band")
    return edge.select("event_id", "station", "us", trigger.alias("trigger"), F.round("drop_c", 3).alias("drop_c"))


def islands(rows: DataFrame, flag: str, order: list[str], width: int = BUCKET_US) -> DataFrame:
    """Rows whose flag is true, with their contiguous island within the station (column island: the last row before it, null for none)."""
    off = F.when(~F.coalesce(F.col(flag), F.lit(False)), F.struct(*order))
    return scan.carried(rows, ["station"], order, so_far={"island": off}, width=width).where(flag)


def onsets(rows: DataFrame, drop_c: float, persist_h: float, window_us: int = DAY_US) -> DataFrame:
    """First time of each run of active samples that lasts at least persist_h."""
    active = dropped(rows, window_us).withColumn("active", F.col("drop_c") >= drop_c)
    runs_ = islands(active, "active", ["us", "event_id"]).groupBy("station", "island").agg(F.min("us").alias("us"), F.max("us").alias("end_us"), F.count("*").alias("n"))
    return runs_.where(F.col("end_us") - F.col("us") >= persist_h * HOUR_US).select("station", "us", "end_us", "n")


def runs(rows: DataFrame, threshold_kn: float, min_run_h: float = 6.0, grace_h: float = 2.0, sector=exprs.SECTOR) -> DataFrame:
    """Sustained favourable runs, bracketed by favourable samples.

    Two favourable samples are in one run unless, between them, a step exceeds twice the
    station's median step or an unfavourable sample lies more than the grace after the first.
    The last break so far is carried along and compared with the last favourable sample.
    """
    order = ["us", "event_id"]
    at = F.struct(*order)
    flagged = rows.withColumn("fav", exprs.in_sector("dir_deg", sector) & (F.col("speed_kn") >= threshold_kn))
    # pinned: the median of the steps needs them all before anything else goes on
    step = pin(scan.carried(flagged, ["station"], order, before={"_prev": F.col("us"), "last_fav": F.when(F.col("fav"), at)}).withColumn("step", F.col("us") - F.col("_prev")), "steps")
    spacing = step.groupBy("station").agg(F.coalesce(F.median(F.when(F.col("step") > 0, F.col("step"))), F.lit(float(HOUR_US))).alias("spacing"))
    marked = step.join(spacing, step["station"].eqNullSafe(spacing["station"])).drop(spacing["station"])
    lull = ~F.col("fav") & F.coalesce(F.col("us") - F.col("last_fav.us") > grace_h * HOUR_US, F.lit(False))
    broken = F.coalesce(F.col("step") > 2 * F.col("spacing"), F.lit(False)) | lull
    summed = scan.carried(marked, ["station"], order, so_far={"last_break": F.when(broken, at)})
    start = F.col("fav") & (F.col("last_fav").isNull() | F.coalesce(F.col("last_break") > F.col("last_fav"), F.lit(False)))
    numbered = scan.carried(summed, ["station"], order, so_far={"run": F.when(start, at)}).where("run IS NOT NULL")
    end = F.max(F.when(F.col("fav"), F.col("us"))).over(W.partitionBy("station", "run"))
    inside = numbered.withColumn("end_us", end).where("us <= end_us")
    rad = F.radians("dir_deg")
    out = inside.groupBy("station", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.first("spacing").alias("spacing"), F.max(F.when(F.col("fav"), F.col("speed_kn"))).alias("peak_kn"), F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))), F.lit(360.0)).alias("mean_dir"), F.count_if("fav").alias("n"))
    lasted = F.when(F.col("end_us") > F.col("start_us"), (F.col("end_us") - F.col("start_us")) / HOUR_US).otherwise(F.col("spacing") / HOUR_US)
    return out.withColumn("duration_h", lasted).where(F.col("duration_h") >= min_run_h).select("station", "start_us", "end_us", "duration_h", "peak_kn", "mean_dir", "n")


def phase_at(found: DataFrame, at: DataFrame, setup_h: float = 10.0, peak_h: float = 12.0, relax_h: float = 48.0) -> DataFrame:
    """Phase of each (station, us) by the latest run that started at or before it."""
    joined = asof_join(at, found.select("station", F.col("start_us").alias("us"), "end_us", F.col("start_us").alias("run_us")), ["station"], ["run_us", "end_us"])
    since, after = (F.col("us") - F.col("run_us")) / HOUR_US, (F.col("us") - F.col("end_us")) / HOUR_US
    phase = F.when(F.col("run_us").isNull(), "neutral").when(after <= 0, F.when(since < setup_h, "setup").otherwise("peak")).when(after < peak_h, "peak").when(after < relax_h, "relaxation").otherwise("neutral")
    return joined.select("station", "us", "run_us", phase.alias("phase"))


def episodes(days: DataFrame, merge_gap: int = 1) -> DataFrame:
    """Distinct days merged where they are at most merge_gap apart: station, first, last, n_days."""
    w = W.partitionBy("station").orderBy("day")
    d = days.select("station", "day").distinct().withColumn("new", F.coalesce((F.col("day") - F.lag("day").over(w) > merge_gap).cast("int"), F.lit(1)))
    return d.withColumn("e", F.sum("new").over(w)).groupBy("station", "e").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).drop("e")


def sessions(rows: DataFrame, gap_h: int = 6) -> DataFrame:
    """Events at most gap_h apart are one session (Spark's own session windows)."""
    s = rows.groupBy("station", F.session_window(F.timestamp_micros("us"), f"{gap_h} hours")).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))
    return s.select("station", "first_us", "last_us", "n")


def latest_issue(rows: DataFrame) -> DataFrame:
    """Of rows for one (station, us) the one issued last; the smallest event_id on ties."""
    best = F.max_by(F.struct("event_id", "temp_c", "issued"), F.struct("issued", -F.col("event_id")))
    return rows.groupBy("station", "us").agg(best.alias("b")).select("station", "us", "b.*")


def transitions(rows: DataFrame, state: str) -> DataFrame:
    """Rows whose state differs from the last known one; null keeps it; a first state only if true."""
    known = scan.carried(rows, ["station"], ["us", "event_id"], before={"_before": F.col(state)}).withColumn("_now", F.coalesce(state, "_before"))
    return known.where(F.when(F.col("_before").isNull(), F.col("_now")).otherwise(F.col("_now") != F.col("_before"))).select("event_id", "station", "us", F.col("_now").alias("state"))


def day_changes(rows: DataFrame) -> DataFrame:
    """Change from the day before, only where that day is there: station, day, change."""
    w = W.partitionBy("station").orderBy("day")
    return rows.withColumn("gap", F.col("day") - F.lag("day").over(w)).withColumn("change", F.col("value") - F.lag("value").over(w)).where("gap = 1").select("station", "day", "change")


def member_days(rows: DataFrame, threshold_kn: float = 13.0, min_run_h: float = 6.0, sector=exprs.SECTOR) -> DataFrame:
    """Days touched by an ensemble member's unbroken favourable runs: (station, day), station a member."""
    w = _by_time("event_id")
    step = rows.withColumn("fav", exprs.in_sector("dir_deg", sector) & (F.col("speed_kn") >= threshold_kn)).withColumn("step", F.col("us") - F.lag("us").over(w))
    spacing = step.groupBy("station").agg(F.median(F.when(F.col("step") > 0, F.col("step"))).alias("spacing"))
    new = F.col("fav") & (~F.coalesce(F.lag("fav").over(w), F.lit(False)) | F.coalesce(F.col("step") > 2 * F.col("spacing"), F.lit(True)))
    runs_ = step.join(spacing, "station").withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("fav")
    long_ = runs_.groupBy("station", "run").agg(F.count("*").alias("n"), F.first("spacing").alias("spacing"), F.min("us").alias("a"), F.max("us").alias("z")).where(F.col("n") * F.col("spacing") >= min_run_h * HOUR_US)
    return long_.select("station", F.explode(F.sequence(F.floor(F.col("a") / DAY_US), F.floor(F.col("z") / DAY_US))).alias("day")).distinct()


def preceding_wind(onset: DataFrame, wind: DataFrame, lead_us: int = DAY_US, bar: float = 120.0, sector=exprs.SECTOR) -> DataFrame:
    """Is the wind run over the window before each onset at least the bar? (station, us, drive, consistent)"""
    at = asof_join(onset, wind_run(wind, lead_us, sector), ["station"], ["drive"])
    return at.withColumn("consistent", F.coalesce(F.col("drive") >= bar, F.lit(False)))


def setup_response(rows: DataFrame, back_h: int = 12, ahead_h: int = 24, share: float = 0.6, response_c: float = 2.0, every: int = 6) -> DataFrame:
    """Every n-th sample after a mostly favourable setup: mean speed behind, drop ahead, responded."""
    fav = exprs.in_sector("dir_deg").cast("int")
    numbered = scan.carried(rows, ["station"], ["us", "event_id"], sums={"k": F.lit(1)})
    behind = scan.framed(numbered, ["station"], {"_fav": ("sum", fav), "_n": ("count", fav), "_speed": ("sum", F.when(fav == 1, F.col("speed_kn"))), "_known": ("count", F.when(fav == 1, F.col("speed_kn")))}, back=back_h * HOUR_US)
    out = scan.framed(behind, ["station"], {"low": ("min", F.col("temp_c"))}, ahead=ahead_h * HOUR_US)
    chosen = out.where((F.col("k") % every == 1) & (F.col("_fav") / F.col("_n") >= share))
    return chosen.select("event_id", "station", F.try_divide("_speed", "_known").alias("setup_kn"), (F.col("temp_c") - F.col("low") >= response_c).alias("responded"))
