"""Streaming queries: each runs over the event table to its end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..streaming import jobs
from .bindings import DAY_US, HOUR_US, READINGS, TEMPS, load
from .queries_events import IN_SECTOR
from .registry import query

END = "(SELECT max(epoch_us(ts)) FROM events)"


def _stream(spark, d):
    load(spark, d, "events")
    return jobs.events_stream(spark, f"{d}/events.parquet")


def _readings(spark, d):
    s = _stream(spark, d)
    hour = F.floor(F.unix_micros("ts") / HOUR_US)
    return s.select("event_id", F.col("event_type").alias("station"), "ts", (F.lit(11) + F.col("value") % 12).alias("speed_kn"), F.when(F.col("event_id") % 23 != 0, ((hour * 5 + F.col("event_id") % 20) % 360).cast("double")).alias("dir_deg"))


def _temps(spark, d):
    s = _stream(spark, d)
    h = F.floor(F.unix_micros("ts") / HOUR_US)
    return s.select("event_id", F.col("event_type").alias("station"), "ts", (F.lit(10) + F.abs(F.lit(36) - h % 72) / 4 + F.col("value") % 2).alias("temp_c"))


@query("STR-01", "SELECT DISTINCT user_id, event_type FROM events")
def str01(spark, d):
    return jobs.run_to_table(jobs.keyed_append(_stream(spark, d).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "400 days"), "keyed").select("user_id", "event_type")


@query("STR-02", f"WITH {TEMPS}, dd AS (SELECT station, (us // {DAY_US})::INT AS day, temp_c FROM temps) SELECT station, day, round(avg(temp_c), 6) AS mean_c, max(temp_c) AS max_c, min(temp_c) AS min_c, count(*) AS n, count(*) < 18 AS thin FROM dd WHERE (day + 1)::BIGINT * {DAY_US} <= {END} - 6 * {HOUR_US} GROUP BY station, day")
def str02(spark, d):
    return jobs.run_to_table(jobs.daily_summary(_temps(spark, d)), "daily").withColumn("mean_c", F.round("mean_c", 6))


@query("STR-03", "SELECT event_type AS station, round((1706659200000000 - max(epoch_us(ts))) / 3600000000.0::DOUBLE, 6) AS age_h, (1706659200000000 - max(epoch_us(ts))) / 3600000000.0::DOUBLE > 24.05 AS stale FROM events GROUP BY event_type")
def str03(spark, d):
    s = _stream(spark, d).withColumn("station", F.col("event_type"))
    return jobs.run_to_table(jobs.staleness(s, 1_706_659_200_000_000, 24.05), "stale", "complete").withColumn("age_h", F.round("age_h", 6))


@query("STR-04", f"""WITH {READINGS}, s AS (SELECT event_id, station, us, CASE WHEN dir_deg IS NOT NULL THEN {IN_SECTOR} END AS open FROM readings), k AS (SELECT *, last_value(open IGNORE NULLS) OVER (PARTITION BY station ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS now FROM s), b AS (SELECT *, lag(now) OVER (PARTITION BY station ORDER BY us, event_id) AS before FROM k)
SELECT event_id, station, us, now AS state FROM b WHERE CASE WHEN before IS NULL THEN now ELSE now <> before END""")
def str04(spark, d):
    s = _readings(spark, d).withColumn("open", F.when(F.col("dir_deg").isNotNull(), exprs.in_sector("dir_deg")))
    return jobs.run_to_table(jobs.transitions(s), "alerts").select("event_id", "station", F.unix_micros("ts").alias("us"), "state")


@query("STR-05")
def str05(spark, d):
    s = _readings(spark, d).withColumn("station", F.lit("all"))
    return jobs.run_to_table(jobs.run_tracker(s, 13.0, 0.25), "runs")


@query("STR-06", f"WITH {READINGS}, w AS (SELECT station, CASE WHEN {IN_SECTOR} THEN speed_kn ELSE 0 END AS v, unnest(range(us // {HOUR_US} - 23, us // {HOUR_US} + 1)) * {HOUR_US} + {DAY_US} AS end_us FROM readings) SELECT station, end_us, round(avg(v), 6) AS mean_v, count(*) AS n FROM w GROUP BY ALL HAVING end_us <= {END} - 2 * {HOUR_US}")
def str06(spark, d):
    return jobs.run_to_table(jobs.sliding_drive(_readings(spark, d)), "drive").withColumn("mean_v", F.round("mean_v", 6))


@query("STR-07", f"WITH {READINGS}, f AS (SELECT station, us FROM readings WHERE {IN_SECTOR} AND speed_kn >= 20), a AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY station ORDER BY us) > 6 * {HOUR_US})::INT, 1) AS new FROM f), s AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY us) AS s FROM a) SELECT station, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY station, s HAVING max(us) + 6 * {HOUR_US} <= (SELECT max(us) FROM f) - {HOUR_US}")
def str07(spark, d):
    s = _readings(spark, d).where(exprs.in_sector("dir_deg") & (F.col("speed_kn") >= 20))
    return jobs.run_to_table(jobs.sessions(s), "sessions")


@query("STR-08", "SELECT event_id, c_acctbal AS extra FROM events LEFT JOIN customer ON c_custkey = user_id * 20")
def str08(spark, d):
    static = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("extra"))
    s = _stream(spark, d).select("event_id", (F.col("user_id") * 20).alias("k"))
    return jobs.run_to_table(jobs.late_fill(s, static, "k", "extra"), "filled").select("event_id", "extra")
