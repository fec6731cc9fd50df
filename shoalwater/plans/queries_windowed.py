"""Readers that a caller injects: windows of days over the event table as it was landed, and a resumable sweep."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..session import new_path
from ..sources import windowed
from ..streaming import jobs
from .bindings import day_of, load
from .registry import query

EPOCH = date(1970, 1, 1)


def _landed(spark, d):
    """The event table landed by day: its folder, first and last day as numbers."""
    rows = load(spark, d, "events").select("event_id", "user_id", day_of("ts").alias("day"))
    ends = rows.agg(F.min("day"), F.max("day")).first()
    return windowed.land_by_day(rows, "day"), *ends


def _windows(spark, d):
    """Windows of 2 days, from 5 days before the first event to 9 after the last, where the source ends 5 after it."""
    path, a, z = _landed(spark, d)
    by_day = windowed.landed_days(path, ["event_id", "user_id"], "day")
    epoch = EPOCH  # the function goes to the tasks with what it holds

    def fetch(first: date, last: date):
        return by_day((first - epoch).days, (last - epoch).days + 1)

    at = lambda n: EPOCH + timedelta(days=n)
    return windowed.read_windowed(spark, fetch, "event_id long, user_id long", at(a - 5), at(z + 9), 2, coverage_end=at(z + 5), tries=2, backoff=0.0)


_DAYS = "e AS (SELECT event_id, user_id, datediff('day', DATE '1970-01-01', ts::DATE) AS day FROM events), b AS (SELECT min(day) - 5 AS a, max(day) + 5 AS z FROM e)"


@query("UDF-01", f"WITH {_DAYS}, w AS (SELECT unnest(range(a, z + 1, 2)) AS lo, z FROM b), c AS (SELECT lo, least(lo + 1, z) AS hi, count(event_id) AS records FROM w LEFT JOIN e ON day BETWEEN lo AND least(lo + 1, z) GROUP BY ALL) SELECT lo AS first_day, hi AS last_day, CASE WHEN records = 0 THEN 2 ELSE 1 END AS attempts, records, records = 0 AS missing, true AS clamped FROM c")
def udf01(spark, d):
    _, c = _windows(spark, d)
    return c.select(F.unix_date("window_start").alias("first_day"), F.unix_date("window_end").alias("last_day"), "attempts", "records", "missing", F.col("clamp_reason").startswith("source coverage ends").alias("clamped"))


@query("UDF-01-rows", "SELECT event_id, user_id FROM events")
def udf01_rows(spark, d):
    return _windows(spark, d)[0]


@query("STR-09", "SELECT event_id, user_id, datediff('day', DATE '1970-01-01', ts::DATE) AS day FROM events")
def str09(spark, d):
    """Two runs of one sweep in windows of 4 days; the second reads the first one's open window again, and keys remove it."""
    path, a, z = _landed(spark, d)
    by_day = windowed.landed_days(path, ["event_id", "user_id"], "day")
    out, state = new_path(spark, "swept"), new_path(spark, "swept-state")

    def fetch(lo: int, hi: int):
        return [(*r, n) for n in range(lo, hi) for r in by_day(n, n + 1)]

    for until in (a + (z - a) * 3 // 5, z + 1):
        windowed.sweep(spark, fetch, "event_id long, user_id long, day int", a, 4, until, lambda batch: batch.write.mode("append").parquet(out), state)
    if until <= a or z is None:
        return spark.createDataFrame([], "event_id long, user_id long, day int")
    again = spark.readStream.schema("event_id long, user_id long, day int").parquet(out).withColumn("ts", F.timestamp_seconds(F.col("day").cast("long") * 86400))
    return jobs.run_to_table(jobs.keyed_append(again, ["event_id"], "4000 days").drop("ts"), "swept-once")
