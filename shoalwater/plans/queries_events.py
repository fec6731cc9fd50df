"""Queries of the time-series family: filters, joins in time, windows and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import events
from .bindings import DAY_US, FLOWS, HOUR_US, READINGS, READINGS_HOURLY, TEMPS, flows, readings, readings_hourly, temps
from .registry import query

#: Fixed values of the queries: the instant of as-of look-ups and the tune and validate days.
AT_US = 1_705_300_000_000_000
TUNE, VALIDATE = (19723, 19737), (19738, 19752)

IN_SECTOR = "coalesce((dir_deg % 360) BETWEEN 225 AND 315, FALSE)"


@query("PF-01", f"WITH {READINGS} SELECT event_id, {IN_SECTOR} AS inside, coalesce((dir_deg % 360) >= 300 OR (dir_deg % 360) <= 40, FALSE) AS wrapped FROM readings")
def pf01(spark, d):
    return readings(spark, d).select("event_id", exprs.in_sector("dir_deg").alias("inside"), exprs.in_sector("dir_deg", (300, 40)).alias("wrapped"))


@query("PF-02", f"WITH {READINGS} SELECT event_id, round(CASE WHEN speed_kn IS NULL THEN NULL WHEN dir_deg IS NULL THEN CASE WHEN speed_kn = 0 THEN 0.0 END ELSE speed_kn * cos(radians(dir_deg - 270)) END, 6) + 0.0 AS component FROM readings")
def pf02(spark, d):
    return readings(spark, d).select("event_id", (F.round(exprs.favourable_component("speed_kn", "dir_deg"), 6) + F.lit(0.0)).alias("component"))


@query("PF-04", f"WITH {TEMPS} SELECT event_id FROM temps WHERE temp_c BETWEEN -2 AND 15")
def pf04(spark, d):
    return temps(spark, d).where(exprs.plausible("temp_c", -2, 15)).select("event_id")


@query("PF-06", f"WITH {TEMPS} SELECT event_id, CASE WHEN us // {DAY_US} BETWEEN {TUNE[0]} AND {TUNE[1]} THEN 'tune' WHEN us // {DAY_US} BETWEEN {VALIDATE[0]} AND {VALIDATE[1]} THEN 'validate' END AS split FROM temps")
def pf06(spark, d):
    return temps(spark, d).select("event_id", exprs.split_label(F.floor(F.col("us") / DAY_US), TUNE, VALIDATE).alias("split"))


@query("PF-17", f"WITH {READINGS} SELECT event_id, greatest(0, -14 + 1.05::DOUBLE * speed_kn) AS corrected FROM readings")
def pf17(spark, d):
    return readings(spark, d).select("event_id", exprs.exposure("speed_kn", -14.0, 1.05).alias("corrected"))


@query("FN-01", f"WITH {READINGS} SELECT event_id, round(1 / (1 + exp(-(speed_kn - 13) / 3)), 9) AS p FROM readings")
def fn01(spark, d):
    return readings(spark, d).select("event_id", F.round(exprs.logistic("speed_kn"), 9).alias("p"))


@query("FN-02", f"WITH {READINGS}, t AS (SELECT event_id, (speed_kn - 11) * 0.514444::DOUBLE AS ms, 5.0::DOUBLE + event_id % 10 AS h FROM readings) SELECT event_id, round(CASE WHEN ms <= 0 THEN 1e9 ELSE least(1e9, 0.0147::DOUBLE * h * h / (1.2::DOUBLE * 1.3e-3::DOUBLE * ms * ms / 1000 * 50000)) END, 4) AS w FROM t")
def fn02(spark, d):
    t = readings(spark, d).select("event_id", ((F.col("speed_kn") - 11) * exprs.KN_TO_MS).alias("ms"), (F.lit(5.0) + F.col("event_id") % 10).alias("h"))
    return t.select("event_id", F.round(F.least(F.lit(1e9), exprs.wedderburn("ms", "h")), 4).alias("w"))


@query("FN-08", f"WITH {READINGS} SELECT event_id, ['N','NE','E','SE','S','SW','W','NW'][(floor((dir_deg + 22.5) / 45)::INT % 8) + 1] AS compass FROM readings")
def fn08(spark, d):
    return readings(spark, d).select("event_id", exprs.compass("dir_deg").alias("compass"))


@query("J-01", f"WITH {TEMPS} SELECT station, arg_max(temp_c, (us, event_id)) AS temp_c, max(us) AS us FROM temps WHERE us <= {AT_US} GROUP BY station")
def j01(spark, d):
    return events.asof_latest(temps(spark, d), AT_US)


def _asked(spark, d):
    return temps(spark, d).where("station = 'purchase'").select("event_id", "us", F.lit("view").alias("station"))


@query("J-02", f"WITH {TEMPS}, q AS (SELECT event_id, us FROM temps WHERE station = 'purchase'), r AS (SELECT us AS rus, temp_c FROM temps WHERE station = 'view') SELECT q.event_id, q.us, 'view' AS station, r.temp_c FROM q ASOF LEFT JOIN r ON q.us >= r.rus")
def j02(spark, d):
    return events.asof_join(_asked(spark, d), temps(spark, d), ["station"], ["temp_c"])


@query("J-03", f"""WITH {TEMPS}, q AS (SELECT event_id, us FROM temps WHERE station = 'purchase'), r AS (SELECT us AS rus, temp_c, event_id AS rid FROM temps WHERE station = 'view')
SELECT q.event_id, 'view' AS station, q.us, min(abs(q.us - rus)) AS gap_us, arg_min(rid, (abs(q.us - rus), rus, rid)) AS near_id, arg_min(temp_c, (abs(q.us - rus), rus, rid)) AS temp_c FROM q JOIN r ON abs(q.us - rus) <= 5400000000 GROUP BY ALL""")
def j03(spark, d):
    right = temps(spark, d).select("station", "us", "temp_c", F.col("event_id").alias("near_id"))
    return events.nearest_in_time(_asked(spark, d), right, ["station"], ["near_id", "temp_c"], 5_400_000_000, "near_id")


@query("J-04", f"""WITH {READINGS}, c AS (SELECT *, unnest([us // {HOUR_US}, us // {HOUR_US} + 1]) AS h FROM readings), g AS (SELECT *, abs(us - h * {HOUR_US}) AS gap FROM c)
SELECT station, h, event_id, speed_kn, dir_deg FROM g WHERE gap <= 600000000 QUALIFY row_number() OVER (PARTITION BY station, h ORDER BY gap, us, event_id) = 1""")
def j04(spark, d):
    return events.hourly_snap(readings(spark, d))


def _hourly(spark, d):
    """station, h, value: hourly mean speed in whole hundredths, exact in both engines."""
    return readings(spark, d).groupBy("station", F.floor(F.col("us") / HOUR_US).alias("h")).agg((F.sum(F.round(F.col("speed_kn") * 100).cast("long")) / F.count("*")).alias("value"))


HOURLY = f"hourly AS (SELECT station, us // {HOUR_US} AS h, sum(round(speed_kn * 100)::BIGINT)::DOUBLE / count(*) AS value FROM readings GROUP BY ALL)"


@query("J-06", f"WITH {READINGS}, {HOURLY} SELECT a.station, a.h, a.value, b.value AS persist FROM hourly a LEFT JOIN hourly b ON a.station = b.station AND b.h = a.h - 24")
def j06(spark, d):
    return events.persistence(_hourly(spark, d), 24)


@query("J-15", f"WITH {READINGS}, {HOURLY} SELECT a.h, a.value AS x, b.value AS y FROM hourly a JOIN hourly b ON a.h = b.h WHERE a.station = 'view' AND b.station = 'click'")
def j15(spark, d):
    hourly = _hourly(spark, d)
    one, two = (hourly.where(F.col("station") == s).select("h", F.col("value").alias(c)) for s, c in (("view", "x"), ("click", "y")))
    return one.join(two, "h")


@query("J-16", f"WITH {READINGS} SELECT DISTINCT us // {DAY_US} AS day FROM readings WHERE station = 'view' AND day IN (SELECT us // {DAY_US} FROM readings WHERE station = 'click' AND speed_kn > 20) AND day IN (SELECT us // {DAY_US} FROM readings WHERE station = 'error' AND dir_deg IS NULL)")
def j16(spark, d):
    r = readings(spark, d).withColumn("day", F.floor(F.col("us") / DAY_US))
    days = r.where("station = 'view'").select("day").distinct()
    return days.join(r.where("station = 'click' AND speed_kn > 20"), "day", "left_semi").join(r.where("station = 'error' AND dir_deg IS NULL"), "day", "left_semi")


def _by_year(spark, d):
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))
    return flows(spark, d).select(F.col("gauge").alias("key"), F.year(date).alias("year"), F.dayofyear(date).alias("doy"), F.round(F.col("q") * 10_000).cast("long").alias("value"))


BY_YEAR = "y AS (SELECT gauge AS key, year(DATE '1970-01-01' + day::INT) AS year, dayofyear(DATE '1970-01-01' + day::INT) AS doy, round(q * 10000)::BIGINT AS value FROM flows)"


@query("J-07", f"WITH {FLOWS}, {BY_YEAR} SELECT a.key, a.year, a.doy, count(b.value) AS n, sum(b.value)::DOUBLE / nullif(count(b.value), 0) AS clim FROM (SELECT DISTINCT key, year, doy FROM y) a LEFT JOIN y b ON a.key = b.key AND b.year <> a.year AND b.doy BETWEEN a.doy - 7 AND a.doy + 7 GROUP BY ALL")
def j07(spark, d):
    return events.other_years_climatology(_by_year(spark, d))


DRIVE = f"""good AS (SELECT *, CASE WHEN {IN_SECTOR} THEN speed_kn ELSE 0 END AS v FROM readings WHERE dir_deg IS NOT NULL OR speed_kn = 0),
seg AS (SELECT *, coalesce((v + lag(v) OVER w) / 2 * ((us - lag(us) OVER w) / {HOUR_US}.0::DOUBLE), 0) AS area FROM good WINDOW w AS (PARTITION BY station ORDER BY us, event_id)),
drive AS (SELECT event_id, station, us, sum(area) OVER f - first_value(area) OVER f AS drive FROM seg WINDOW f AS (PARTITION BY station ORDER BY us RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW))"""


@query("W-01", f"WITH {READINGS}, {DRIVE} SELECT event_id, station, us, round(drive, 6) AS drive FROM drive")
def w01(spark, d):
    return events.wind_run(readings(spark, d)).withColumn("drive", F.round("drive", 6))


@query("PF-03", f"WITH {READINGS}, {DRIVE} SELECT event_id, drive >= 150.5 AS is_event FROM drive")
def pf03(spark, d):
    return events.wind_run(readings(spark, d)).select("event_id", exprs.is_event("drive", 150.5).alias("is_event"))


TOP = f"top AS (SELECT *, max(temp_c) OVER (PARTITION BY station ORDER BY us RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) - temp_c AS drop_c FROM temps)"


@query("W-02", f"""WITH {TEMPS}, {TOP}, a AS (SELECT *, drop_c >= 8 OR temp_c <= 11 AS active FROM top), e AS (SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY station ORDER BY us, event_id), FALSE) AS edge FROM a)
SELECT event_id, station, us, CASE WHEN drop_c >= 8 AND temp_c <= 11 THEN 'both' WHEN drop_c >= 8 THEN 'drop' ELSE 'cold_band' END AS trigger, round(drop_c, 3) AS drop_c FROM e WHERE edge""")
def w02(spark, d):
    return events.drop_events(temps(spark, d), 8.0, 11.0)


ONSETS = f"""{TOP}, act AS (SELECT *, drop_c >= 4 AS active FROM top), chg AS (SELECT *, (active AND NOT coalesce(lag(active) OVER (PARTITION BY station ORDER BY us, event_id), FALSE))::INT AS c FROM act),
isl AS (SELECT *, sum(c) OVER (PARTITION BY station ORDER BY us, event_id) AS island FROM chg),
onsets AS (SELECT station, min(us) AS us, max(us) AS end_us, count(*) AS n FROM isl WHERE active GROUP BY station, island HAVING max(us) - min(us) >= 2 * {HOUR_US})"""


@query("W-03", f"WITH {TEMPS}, {ONSETS} SELECT * FROM onsets")
def w03(spark, d):
    return events.onsets(temps(spark, d), 4.0, 2.0)


RUNS = f"""st AS (SELECT *, {IN_SECTOR} AND speed_kn >= 13 AS fav, us - lag(us) OVER (PARTITION BY station ORDER BY us, event_id) AS step FROM readings),
sp AS (SELECT station, coalesce(quantile_cont(step, 0.5) FILTER (step > 0), {HOUR_US}) AS spacing FROM st GROUP BY station),
mk AS (SELECT st.*, spacing, last_value(CASE WHEN fav THEN us END IGNORE NULLS) OVER (PARTITION BY st.station ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS last_fav FROM st JOIN sp USING (station)),
br AS (SELECT *, sum((coalesce(step > 2 * spacing, FALSE) OR (NOT fav AND coalesce(us - last_fav > 2 * {HOUR_US}, FALSE)))::INT) OVER (PARTITION BY station ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS breaks FROM mk),
fb AS (SELECT *, last_value(CASE WHEN fav THEN breaks END IGNORE NULLS) OVER (PARTITION BY station ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fav_breaks FROM br),
nr AS (SELECT *, sum((fav AND (fav_breaks IS NULL OR breaks > fav_breaks))::INT) OVER (PARTITION BY station ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM fb),
en AS (SELECT *, max(CASE WHEN fav THEN us END) OVER (PARTITION BY station, run) AS run_end FROM nr WHERE run > 0),
rn AS (SELECT station, run, min(us) AS start_us, max(us) AS end_us, any_value(spacing) AS spacing, max(speed_kn) FILTER (fav) AS peak_kn, degrees(atan2(avg(sin(radians(dir_deg))), avg(cos(radians(dir_deg))))) AS md, count(*) FILTER (fav) AS n FROM en WHERE us <= run_end GROUP BY ALL),
runs AS (SELECT station, start_us, end_us, CASE WHEN end_us > start_us THEN (end_us - start_us) / {HOUR_US}.0::DOUBLE ELSE spacing / {HOUR_US}.0::DOUBLE END AS duration_h, peak_kn, CASE WHEN md < 0 THEN md + 360 ELSE md END AS mean_dir, n FROM rn)"""


@query("W-04", f"WITH {READINGS_HOURLY}, {RUNS} SELECT station, start_us, end_us, round(duration_h, 6) AS duration_h, round(peak_kn, 6) AS peak_kn, round(mean_dir, 6) AS mean_dir, n FROM runs WHERE duration_h >= 6")
def w04(spark, d):
    found = events.runs(readings_hourly(spark, d), 13.0)
    return found.withColumns({"duration_h": F.round("duration_h", 6), "peak_kn": F.round("peak_kn", 6), "mean_dir": F.round("mean_dir", 6)})


MEMBER_DAYS = f"""m AS (SELECT *, {IN_SECTOR} AND speed_kn >= 13 AS fav, us - lag(us) OVER (PARTITION BY member ORDER BY us, event_id) AS step FROM readings), ms AS (SELECT member, quantile_cont(step, 0.5) FILTER (step > 0) AS spacing FROM m GROUP BY member),
mn AS (SELECT m.*, spacing, sum((fav AND (NOT coalesce(lag_fav, FALSE) OR coalesce(step > 2 * spacing, TRUE)))::INT) OVER (PARTITION BY m.member ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(fav) OVER (PARTITION BY member ORDER BY us, event_id) AS lag_fav FROM m) m JOIN ms USING (member)),
mr AS (SELECT member, run, min(us) AS a, max(us) AS z FROM mn WHERE fav GROUP BY member, run HAVING count(*) * any_value(spacing) >= 6 * {HOUR_US}),
md AS (SELECT DISTINCT member, unnest(range(a // {DAY_US}, z // {DAY_US} + 1)) AS day FROM mr)"""


def _members(spark, d):
    return readings(spark, d).withColumn("station", F.col("member"))


@query("W-05", f"WITH {READINGS}, {MEMBER_DAYS} SELECT member, day FROM md")
def w05(spark, d):
    return events.member_days(_members(spark, d)).select(F.col("station").alias("member"), "day")


@query("AGG-27", f"WITH {READINGS}, {MEMBER_DAYS} SELECT dd.day, count(DISTINCT md.member) / 10.0::DOUBLE AS probability FROM (SELECT DISTINCT us // {DAY_US} AS day FROM readings) dd LEFT JOIN md USING (day) GROUP BY ALL")
def agg27(spark, d):
    members = _members(spark, d)
    spine = members.select(F.floor(F.col("us") / DAY_US).alias("day")).distinct()
    n = members.select("member").distinct().agg(F.count("*").alias("members"))
    counts = spine.join(events.member_days(members), "day", "left").groupBy("day").agg(F.count_distinct("station").alias("k"))
    return counts.join(F.broadcast(n)).select("day", (F.col("k") / F.col("members")).alias("probability"))


@query("TOP-04", f"WITH {READINGS}, {MEMBER_DAYS}, p AS (SELECT day, count(DISTINCT member) AS k FROM md GROUP BY day) SELECT arg_max(day, (k, -day)) AS day, max(k) AS members FROM p")
def top04(spark, d):
    p = events.member_days(_members(spark, d)).groupBy("day").agg(F.count_distinct("station").alias("k"))
    return p.agg(F.max_by("day", F.struct("k", -F.col("day"))).alias("day"), F.max("k").alias("members"))


@query("AGG-28", f"WITH {READINGS} SELECT us // {DAY_US} AS day, round(avg({IN_SECTOR}::INT / (1 + exp(-(speed_kn - 13) / 3))), 9) AS favour FROM readings GROUP BY ALL")
def agg28(spark, d):
    return readings(spark, d).groupBy(F.floor(F.col("us") / DAY_US).alias("day")).agg(F.round(F.avg(exprs.in_sector("dir_deg").cast("int") * exprs.logistic("speed_kn")), 9).alias("favour"))


@query("AGG-32", f"WITH {READINGS}, e AS (SELECT station, max(us) AS z FROM readings GROUP BY station) SELECT station, count(*) FILTER ({IN_SECTOR}) AS favourable, round(avg(speed_kn) FILTER ({IN_SECTOR}), 9) AS mean_kn, max(speed_kn) FILTER (us > z - {DAY_US}) AS max_kn FROM readings JOIN e USING (station) WHERE us > z - 2 * {DAY_US} GROUP BY station")
def agg32(spark, d):
    r = readings(spark, d)
    ends = r.groupBy("station").agg(F.max("us").alias("z"))
    fav = exprs.in_sector("dir_deg")
    return r.join(ends, "station").where(F.col("us") > F.col("z") - 2 * DAY_US).groupBy("station").agg(F.count_if(fav).alias("favourable"), F.round(F.avg(F.when(fav, F.col("speed_kn"))), 9).alias("mean_kn"), F.max(F.when(F.col("us") > F.col("z") - DAY_US, F.col("speed_kn"))).alias("max_kn"))


@query("W-06", f"""WITH {TEMPS}, {ONSETS}, o AS (SELECT DISTINCT station, us // {DAY_US} AS day FROM onsets), n AS (SELECT *, coalesce((day - lag(day) OVER (PARTITION BY station ORDER BY day) > 1)::INT, 1) AS new FROM o), e AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY day) AS e FROM n)
SELECT station, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM e GROUP BY station, e""")
def w06(spark, d):
    return events.episodes(events.onsets(temps(spark, d), 4.0, 2.0).withColumn("day", F.floor(F.col("us") / DAY_US)))


@query("W-06-hours", f"""WITH {TEMPS}, {TOP}, a AS (SELECT station, us, coalesce((us - lag(us) OVER (PARTITION BY station ORDER BY us) > 6 * {HOUR_US})::INT, 1) AS new FROM top WHERE drop_c >= 5), s AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY us) AS s FROM a)
SELECT station, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY station, s""")
def w06h(spark, d):
    return events.sessions(events.dropped(temps(spark, d), DAY_US).where("drop_c >= 5"))


@query("W-09", f"""WITH {READINGS_HOURLY}, {RUNS}, r AS (SELECT station AS rs, start_us, end_us FROM runs WHERE duration_h >= 6), q AS (SELECT event_id, station, us FROM readings), j AS (SELECT q.*, start_us AS run_us, end_us FROM q ASOF LEFT JOIN r ON q.station = r.rs AND q.us >= r.start_us)
SELECT station, us, run_us, CASE WHEN run_us IS NULL THEN 'neutral' WHEN us <= end_us THEN CASE WHEN us - run_us < 10 * {HOUR_US} THEN 'setup' ELSE 'peak' END WHEN us - end_us < 12 * {HOUR_US} THEN 'peak' WHEN us - end_us < 48 * {HOUR_US} THEN 'relaxation' ELSE 'neutral' END AS phase FROM j""")
def w09(spark, d):
    r = readings_hourly(spark, d)
    return events.phase_at(events.runs(r, 13.0), r.select("station", "us"))


THINNED = TEMPS.replace("epoch_us(ts) AS us", f"epoch_us(ts) // {HOUR_US} * {HOUR_US} AS us")


@query("W-14", f"WITH {THINNED} SELECT station, us, event_id, temp_c, issued FROM temps QUALIFY row_number() OVER (PARTITION BY station, us ORDER BY issued DESC, event_id) = 1")
def w14(spark, d):
    return events.latest_issue(temps(spark, d).withColumn("us", F.floor(F.col("us") / HOUR_US) * HOUR_US))


@query("W-15", f"""WITH {READINGS}, s AS (SELECT event_id, station, us, CASE WHEN dir_deg IS NOT NULL THEN {IN_SECTOR} END AS open FROM readings), k AS (SELECT *, last_value(open IGNORE NULLS) OVER (PARTITION BY station ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS now FROM s), b AS (SELECT *, lag(now) OVER (PARTITION BY station ORDER BY us, event_id) AS before FROM k)
SELECT event_id, station, us, now AS state FROM b WHERE CASE WHEN before IS NULL THEN now ELSE now <> before END""")
def w15(spark, d):
    return events.transitions(readings(spark, d).withColumn("open", F.when(F.col("dir_deg").isNotNull(), exprs.in_sector("dir_deg"))), "open")


DAILY = f"daily AS (SELECT station, us // {DAY_US} AS day, sum(round(temp_c * 10000)::BIGINT)::DOUBLE / count(*) AS value FROM temps GROUP BY ALL)"


def daily(spark, d):
    return temps(spark, d).groupBy("station", F.floor(F.col("us") / DAY_US).alias("day")).agg((F.sum(F.round(F.col("temp_c") * 10_000).cast("long")) / F.count("*")).alias("value"))


@query("W-16", f"WITH {TEMPS}, {DAILY}, l AS (SELECT *, day - lag(day) OVER w AS gap, value - lag(value) OVER w AS change FROM daily WHERE value > 160000 WINDOW w AS (PARTITION BY station ORDER BY day)) SELECT station, day, change FROM l WHERE gap = 1")
def w16(spark, d):
    return events.day_changes(daily(spark, d).where("value > 160000"))


@query("J-12", f"""WITH {READINGS}, {TEMPS}, {ONSETS}, {DRIVE}, o AS (SELECT station, us FROM onsets), dr AS (SELECT station AS ds, us AS dus, drive FROM drive) SELECT o.station, o.us, round(dr.drive, 6) AS drive, coalesce(round(dr.drive, 6) >= 120, FALSE) AS consistent FROM o ASOF LEFT JOIN dr ON o.station = dr.ds AND o.us >= dr.dus""")
def j12(spark, d):
    found = events.preceding_wind(events.onsets(temps(spark, d), 4.0, 2.0).select("station", "us"), readings(spark, d))
    return found.withColumn("drive", F.round("drive", 6))


@query("W-24", f"""WITH {READINGS}, {TEMPS}, b AS (SELECT r.event_id, r.station, r.us, {IN_SECTOR}::INT AS fav, speed_kn, temp_c FROM readings r JOIN temps t USING (event_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY us, event_id) AS k, avg(fav) OVER bk AS share, avg(CASE WHEN fav = 1 THEN speed_kn END) OVER bk AS speed, min(temp_c) OVER (PARTITION BY station ORDER BY us RANGE BETWEEN CURRENT ROW AND {DAY_US} FOLLOWING) AS low FROM b WINDOW bk AS (PARTITION BY station ORDER BY us RANGE BETWEEN {12 * HOUR_US} PRECEDING AND CURRENT ROW))
SELECT event_id, station, round(speed, 9) AS setup_kn, temp_c - low >= 2 AS responded FROM f WHERE k % 6 = 1 AND share >= 0.6""")
def w24(spark, d):
    joined = readings(spark, d).join(temps(spark, d).select("event_id", "temp_c"), "event_id")
    return events.setup_response(joined).withColumn("setup_kn", F.round("setup_kn", 9))
