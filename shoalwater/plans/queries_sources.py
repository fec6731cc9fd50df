"""Round trips through the landed formats: tables are written as the raw files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as prof
from ..session import new_path
from ..sources import landed
from .bindings import DAY_US, FLOWS, HOUR_US, PIXELS, PROFILES, READINGS, TEMPS, flows, load, pixels, profiles, readings, temps
from .registry import query


def _stamp(us: str):
    return F.date_format(F.timestamp_micros(us), "yyyy MM dd HH mm")


@query("SRC-01", f"WITH {TEMPS}, k AS (SELECT station, us // {HOUR_US} AS h, max(event_id) AS event_id FROM temps GROUP BY ALL) SELECT k.station AS station_id, h, temp_c FROM k JOIN temps USING (event_id)")
def src01(spark, d):
    path = new_path(spark, "bronze")
    rows = temps(spark, d).select(F.col("station").alias("station_id"), F.col("event_id").cast("int").alias("node"), F.lit(6.0).alias("depth_m"), "temp_c", F.timestamp_micros(F.floor(F.col("us") / HOUR_US) * HOUR_US).alias("valid_time"), F.lit(20.0).alias("water_column_m"), F.lit(False).alias("clamped"))
    landed.write_bronze(rows, path)
    return landed.read_bronze(spark, path).select("station_id", F.floor(F.unix_micros("valid_time") / HOUR_US).alias("h"), "temp_c")


@query("SRC-02", f"WITH {TEMPS}, k AS (SELECT station, us // {HOUR_US} AS h, max(event_id) AS event_id FROM temps GROUP BY ALL) SELECT year(DATE '1970-01-01' + (h // 24)::INT) AS year, count(*) AS n FROM k GROUP BY ALL")
def src02(spark, d):
    path = new_path(spark, "bronze")
    rows = temps(spark, d).select(F.col("station").alias("station_id"), F.col("event_id").cast("int").alias("node"), F.lit(6.0).alias("depth_m"), "temp_c", F.timestamp_micros(F.floor(F.col("us") / HOUR_US) * HOUR_US).alias("valid_time"), F.lit(20.0).alias("water_column_m"), F.lit(False).alias("clamped"))
    for _ in range(2):  # a cycle that runs again overwrites its partition
        landed.write_bronze(rows, path)
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"))


@query("SRC-05", "SELECT doc_id, source, text AS quote FROM documents")
def src05(spark, d):
    path = new_path(spark, "ledger")
    load(spark, d, "documents").select("doc_id", "source", F.col("text").alias("quote")).write.json(path)
    return landed.read_ledger(spark, path, "doc_id long, source string, quote string")


@query("SRC-07", f"WITH {TEMPS} SELECT us // 60000000 AS minute, (event_id % 40)::DOUBLE AS depth_m, round(temp_c, 3) AS temp_c FROM temps WHERE event_id % 6 <> 0")
def src07(spark, d):
    path = new_path(spark, "ocean")
    value = F.when(F.col("event_id") % 6 == 0, F.when(F.col("event_id") % 12 == 0, "MM").otherwise("99.0")).otherwise(F.round("temp_c", 3).cast("string"))
    temps(spark, d).select(F.concat_ws(" ", _stamp("us"), (F.col("event_id") % 40).cast("double").cast("string"), value).alias("value")).write.text(path)
    return landed.buoy_ocean(spark, path).select(F.floor(F.unix_micros("ts") / 60_000_000).alias("minute"), "depth_m", "temp_c")


@query("SRC-08", f"WITH {READINGS} SELECT us // 60000000 AS minute, coalesce(dir_deg, 0) AS dir_deg, round((event_id % 30)::DOUBLE / 0.514444, 2) AS speed_kn FROM readings WHERE event_id % 9 <> 0")
def src08(spark, d):
    path = new_path(spark, "met")
    direction = F.when(F.col("event_id") % 9 == 0, "999").otherwise(F.coalesce("dir_deg", F.lit(0.0)).cast("string"))
    lines = readings(spark, d).select(F.concat_ws(" ", _stamp("us"), direction, (F.col("event_id") % 30).cast("double").cast("string")).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    return landed.buoy_wind(spark, path).select(F.floor(F.unix_micros("ts") / 60_000_000).alias("minute"), "dir_deg", "speed_kn")


@query("SRC-09", f"WITH {TEMPS} SELECT us // 1000000 AS s, round(temp_c, 3) AS temp_c, (event_id % 25)::DOUBLE AS depth_m FROM temps WHERE event_id % 7 <> 0")
def src09(spark, d):
    path = new_path(spark, "chain")
    bad = F.col("event_id") % 7 == 0
    rows = temps(spark, d).select(F.when(bad, "UTC").otherwise(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("time"), F.when(bad, "K").otherwise((F.col("temp_c") + 273.15).cast("string")).alias("temperature"), (F.col("event_id") % 25).cast("string").alias("depth"))
    rows.write.option("header", True).csv(path)
    return landed.csv_with_units(spark, path).select(F.floor(F.unix_micros("ts") / 1_000_000).alias("s"), F.round("temp_c", 3).alias("temp_c"), "depth_m")


@query("SRC-14", f"WITH {TEMPS} SELECT us // 1000000 AS s, 48 + (event_id % 100) / 100.0::DOUBLE AS lat, temp_c AS sst FROM temps WHERE event_id % 5 <> 0")
def src14(spark, d):
    path = new_path(spark, "grid")
    sst = F.when(F.col("event_id") % 5 != 0, F.col("temp_c").cast("string"))
    row = F.array(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), (F.lit(48) + (F.col("event_id") % 100) / 100).cast("string"), F.lit("-89.2"), sst)
    temps(spark, d).groupBy((F.col("event_id") % 16).alias("file")).agg(F.collect_list(row).alias("rows")).select(F.struct("rows").alias("table")).repartition(16).write.option("ignoreNullFields", False).json(path)
    raw = spark.read.schema("table struct<rows: array<array<string>>>").json(path).select(F.explode("table.rows").alias("r"))
    return raw.select(F.floor(F.unix_micros(F.to_timestamp(F.col("r")[0])) / 1_000_000).alias("s"), F.expr("try_cast(r[1] AS double)").alias("lat"), F.expr("try_cast(r[3] AS double)").alias("sst")).where("sst IS NOT NULL")


@query("SRC-15", f"WITH {FLOWS} SELECT day, round(q, 9) AS q FROM flows WHERE day % 4 <> 0")
def src15(spark, d):
    path = new_path(spark, "discharge")
    date = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).cast("string"), F.lit("T00:00:00Z"))
    feature = F.struct(F.struct(date.alias("DATETIME"), F.when(F.col("day") % 4 == 0, F.lit(-1.0)).otherwise(F.col("q")).alias("DISCHARGE")).alias("properties"))
    flows(spark, d).groupBy("gauge").agg(F.collect_list(feature).alias("features")).select("features").repartition(5).write.json(path)
    return landed.discharge(spark, path).select(F.floor(F.unix_micros("ts") / DAY_US).cast("int").alias("day"), F.round("q", 9).alias("q"))


@query("SRC-16", f"WITH {PROFILES} SELECT node, depth, round(temp, 9) AS temp FROM levels")
def src16(spark, d):
    p = profiles(spark, d).select("node", F.explode(F.arrays_zip("depths", "temps")).alias("l"))
    return p.select("node", F.col("l.depths").alias("depth"), F.round("l.temps", 9).alias("temp"))


@query("SRC-19", "SELECT event_type AS station, CASE WHEN event_type = 'error' THEN NULL ELSE count(*) END AS n, CASE WHEN event_type = 'error' THEN 'no sample' END AS reason FROM events GROUP BY event_type")
def src19(spark, d):
    path = new_path(spark, "report")
    e = load(spark, d, "events").select(F.col("event_type").alias("station"))
    landed.write_report(e.distinct(), e.where("station <> 'error'").groupBy("station").agg(F.count("*").alias("n")), ["station"], path)
    return spark.read.schema("station string, n long, reason string").json(path)


@query("RAS-10", f"WITH {PIXELS}, p AS (SELECT *, ((row + col) % 5)::DOUBLE AS z0 FROM pixels) SELECT row, col, round(CASE WHEN depth IS NULL THEN NULL WHEN depth <= z0 THEN 14 WHEN depth <= z0 + 10 THEN 14 - (depth - z0) / 10 * 2 WHEN depth <= z0 + 20 THEN 12 - (depth - z0 - 10) / 10 * 3 WHEN depth <= z0 + 30 THEN 9 - (depth - z0 - 20) / 10 * 3 ELSE 6 END, 6) AS bottom_c FROM p")
def ras10(spark, d):
    z0 = ((F.col("row") + F.col("col")) % 5).cast("double")
    at = prof.at_depth(F.array(*[z0 + 10 * k for k in range(4)]), F.array(*[F.lit(t) for t in (14.0, 12.0, 9.0, 6.0)]), F.col("depth"))
    return pixels(spark, d).select("row", "col", F.when(F.col("depth").isNotNull(), F.round(at["temp"], 6)).alias("bottom_c"))
