"""Landed raw files and tables to typed tables, and the sinks that append to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Fixed value: the contract of the temperature table.
BRONZE = "station_id string, node int, depth_m double, temp_c double, valid_time timestamp, water_column_m double, clamped boolean"
KMH_PER_KN = 1.852
MS_PER_KN = 0.514444


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BRONZE).parquet(path)


def write_bronze(rows: DataFrame, path: str) -> None:
    """Overwrite the years that ``rows`` holds, the last row of each (station, time); others stay."""
    w = W.partitionBy("station_id", "depth_m", "valid_time").orderBy(F.desc("node"))
    last = rows.select(*[c.split()[0] for c in BRONZE.split(", ")]).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    last.withColumn("year", F.year("valid_time")).write.option("partitionOverwriteMode", "dynamic").partitionBy("year").mode("overwrite").parquet(path)


def new_rows(new: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose natural key is not in the log."""
    return new.join(log.select(*key).distinct(), key, "left_anti")


def append_new(new: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key the log at ``path`` does not hold; the first of repeated keys."""
    spark = new.sparkSession
    try:
        log = spark.read.parquet(path)
    except Exception as e:  # an absent log is an empty one; anything else is an error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log = new.limit(0)
    new_rows(new.dropDuplicates(key), log, key).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, blank lines skipped, malformed lines dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    return lines.select(F.split("v", r"\s+").alias("f"))


def buoy_ocean(spark: SparkSession, path: str) -> DataFrame:
    """ts, depth_m, temp_c of space-separated ocean files; missing markers and impossible values go."""
    f = _fields(spark, path).where(F.size("f") >= 7)
    n = lambda i: F.try_to_number(F.col("f")[i], F.lit("S9999.999")).cast("double")
    ts = F.try_to_timestamp(F.concat_ws(" ", *[F.col("f")[i] for i in range(5)]), F.lit("yyyy MM dd HH mm"))
    return f.select(ts.alias("ts"), F.expr("try_cast(f[5] AS double)").alias("depth_m"), F.expr("try_cast(f[6] AS double)").alias("temp_c")).where("ts IS NOT NULL AND depth_m IS NOT NULL AND temp_c > -5 AND temp_c < 50")


def buoy_wind(spark: SparkSession, path: str) -> DataFrame:
    """ts, dir_deg, speed_kn of space-separated meteorological files."""
    ts = F.try_to_timestamp(F.concat_ws(" ", *[F.col("f")[i] for i in range(5)]), F.lit("yyyy MM dd HH mm"))
    rows = _fields(spark, path).where(F.size("f") >= 7).select(ts.alias("ts"), F.expr("try_cast(f[5] AS double)").alias("dir_deg"), F.expr("try_cast(f[6] AS double)").alias("ms"))
    return rows.where("ts IS NOT NULL AND dir_deg BETWEEN 0 AND 360 AND ms BETWEEN 0 AND 60").select("ts", "dir_deg", F.round(F.col("ms") / MS_PER_KN, 2).alias("speed_kn"))


def csv_with_units(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose second line holds units: rows whose time does not parse go; Kelvin to Celsius."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.try_to_timestamp("time").alias("ts"), (F.expr("try_cast(temperature AS double)") - 273.15).alias("temp_c"), F.expr("try_cast(depth AS double)").alias("depth_m")).where("ts IS NOT NULL AND temp_c IS NOT NULL")


def sensors_to_long(wide: DataFrame, n: int) -> DataFrame:
    """temp_k, depth_k, qc_k columns to rows; a blank flag counts as 2, flags other than 1 and 2 go."""
    triples = F.explode(F.array(*[F.struct(F.lit(k).alias("sensor"), F.col(f"temp_{k}").alias("temp"), F.col(f"depth_{k}").alias("depth"), F.coalesce(F.col(f"qc_{k}"), F.lit(2)).cast("long").alias("qc")) for k in range(1, n + 1)]))
    return wide.select("id", triples.alias("s")).select("id", "s.*").where("temp IS NOT NULL AND NOT isnan(temp) AND qc IN (1, 2)")


def flag_histogram(wide: DataFrame, n: int) -> DataFrame:
    """How often each quality flag occurs, null as a flag of its own."""
    return wide.select(F.explode(F.array(*[F.col(f"qc_{k}") for k in range(1, n + 1)])).alias("qc")).groupBy("qc").agg(F.count("*").alias("n"))


def normalise_wind(rows: DataFrame) -> DataFrame:
    """km/h to knots, tens of degrees to degrees, 0 tens as calm (null direction); flagged rows go."""
    speed = F.col("kmh") / KMH_PER_KN
    return rows.where(~F.col("flagged")).withColumn("speed_kn", speed).withColumn("dir_deg", F.when(F.col("tens") != 0, F.col("tens") * 10.0)).where(F.col("speed_kn").between(0, 200))


def wide_members_to_rows(rows: DataFrame, key: str) -> DataFrame:
    """JSON columns wind_speed_10m[_memberNN] with their direction to rows; the control is member 0.

    A member that lacks its direction column is dropped.
    """
    m = F.from_json("hourly", "map<string, array<double>>")
    entries = rows.select(key, m.alias("m")).select(key, "m", F.explode(F.map_keys("m")).alias("name")).where("startswith(name, 'wind_speed_10m')")
    direction = F.try_element_at("m", F.regexp_replace("name", "speed", "direction"))
    member = F.coalesce(F.expr("try_cast(nullif(regexp_extract(name, 'member([0-9]+)$', 1), '') AS long)"), F.lit(0))
    paired = entries.select(key, member.alias("member"), F.posexplode(F.arrays_zip(F.col("m")[F.col("name")].alias("speed"), direction.alias("dir"))).alias("i", "v"), direction.alias("d")).where("d IS NOT NULL")
    return paired.select(key, "member", "i", F.col("v.speed").alias("speed"), F.col("v.dir").alias("dir"))


def grid_rows(spark: SparkSession, path: str) -> DataFrame:
    """time, lat, lon, sst of a JSON table of rows; null sst is cloud or land and goes."""
    raw = spark.read.schema("table struct<rows: array<array<string>>>").option("multiLine", True).json(path)
    r = raw.select(F.explode("table.rows").alias("r"))
    return r.select(F.to_timestamp(F.col("r")[0]).alias("ts"), F.expr("try_cast(r[1] AS double)").alias("lat"), F.expr("try_cast(r[2] AS double)").alias("lon"), F.expr("try_cast(r[3] AS double)").alias("sst")).where("sst IS NOT NULL")


def discharge(spark: SparkSession, path: str) -> DataFrame:
    """ts, q of feature collections; negative discharge goes."""
    raw = spark.read.schema("features array<struct<properties: struct<DATETIME: string, DISCHARGE: double>>>").option("multiLine", True).json(path)
    p = raw.select(F.explode("features").alias("f")).select("f.properties.*")
    return p.select(F.to_timestamp("DATETIME").alias("ts"), F.col("DISCHARGE").alias("q")).where("q >= 0")


#: Fields of a station dimension file, one JSON object a line.
STATION = "id string, position struct<lat: double, lon: double>, depths_m array<double>, bands map<string, struct<low: double, high: double>>, split struct<first: date, last: date>"


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of a station dimension: id, lat, lon, depths_m, bands, first, last. A station without an id or position goes."""
    raw = spark.read.schema(STATION).json(path)
    return raw.where("id IS NOT NULL AND position.lat IS NOT NULL AND position.lon IS NOT NULL").select("id", "position.lat", "position.lon", "depths_m", "bands", "split.first", "split.last")


def merkle(files: DataFrame, digits: int = 3) -> DataFrame:
    """A two-level digest of files (path, content): bucket, n, digest, and the root as the bucket ''.

    A file's leaf is the sha256 of its path and bytes. Leaves lie in 16 ** digits buckets by the first hex digits of their path's
    own sha256, so no folder is one group; a bucket's digest is that of its leaves in path order, the root's that of
    the buckets in order. It depends on paths and bytes alone: not on the order of a listing nor on how it is partitioned.
    Two listings are told apart by bucket, so what differs is found without reading all files again.
    """
    path = F.col("path").cast("binary")
    leaves = files.select(F.substring(F.sha2(path, 256), 1, digits).alias("bucket"), F.col("path"), F.sha2(F.concat(path, F.coalesce(F.col("content").cast("binary"), F.lit(b""))), 256).alias("leaf"))
    joined = lambda c, order: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda x: x[c]), ""), 256)
    buckets = leaves.groupBy("bucket").agg(F.count("*").alias("n"), joined("leaf", "path").alias("digest"))
    root = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined("digest", "bucket").alias("digest"))
    return buckets.union(root.select(F.lit("").alias("bucket"), "n", "digest"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Twelve hex digits over the paths below ``path`` and the bytes of its files: the root of ``merkle``. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.regexp_replace("path", "^[^:]*:/*", "/")
    root = path.split(":", 1)[-1].strip("/")
    listed = files.select(F.substring(below, F.lit(len(root) + 3), F.length(below)).alias("path"), "content")
    return merkle(listed).where("bucket = ''").first()["digest"][:12]


def write_report(spine: DataFrame, results: DataFrame, key: list[str], path: str) -> None:
    """One JSON row for each key of the spine; a key without a result says so, so no stale file survives."""
    out = spine.join(results.withColumn("_has", F.lit(True)), key, "left").withColumn("reason", F.when(F.col("_has").isNull(), "no sample")).drop("_has")
    out.write.mode("overwrite").json(path)
