"""Driver tables seen as the library's tables, once for Spark and once as DuckDB CTEs.

Times are microseconds since 1970 in UTC (``us``), hours are whole hours (``h``), days
are days since 1970 (``day``). Integer arithmetic keeps both engines identical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import scan
from ..operators.scan import DAY_US, HOUR_US  # noqa: F401  (used by the queries, too)



def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def day_of(c: str):
    return F.unix_date(F.col(c).cast("date"))


def readings(spark: SparkSession, sf_dir: str, one_station: bool = False) -> DataFrame:
    """event_id, station, us, speed_kn, dir_deg (null: variable), member, user_id."""
    e = load(spark, sf_dir, "events").withColumn("us", micros("ts"))
    hour = F.floor(F.col("us") / HOUR_US)
    return e.select(
        "event_id",
        (F.lit("all") if one_station else F.col("event_type")).alias("station"),
        "us",
        (F.lit(11) + F.col("value") % 12).alias("speed_kn"),
        F.when(F.col("event_id") % 23 != 0, ((hour * 5 + F.col("event_id") % 20) % 360).cast("double")).alias("dir_deg"),
        (F.col("user_id") % 10).alias("member"),
    )


READINGS = """readings AS (SELECT event_id, event_type AS station, epoch_us(ts) AS us, 11 + value % 12 AS speed_kn,
  CASE WHEN event_id % 23 <> 0 THEN (((epoch_us(ts) // 3600000000) * 5 + event_id % 20) % 360)::DOUBLE END AS dir_deg, user_id % 10 AS member FROM events)"""


def readings_hourly(spark: SparkSession, sf_dir: str, one_station: bool = False) -> DataFrame:
    """One reading per station and hour: mean speed (of whole hundredths), last known direction; event_id is the hour."""
    h = F.floor(F.col("us") / HOUR_US)
    g = readings(spark, sf_dir, one_station).groupBy("station", h.alias("event_id")).agg((F.sum(F.round(F.col("speed_kn") * 100).cast("long")) / F.count("*") / 100).alias("speed_kn"), F.max_by("dir_deg", F.when(F.col("dir_deg").isNotNull(), F.struct("us", "event_id"))).alias("dir_deg"))
    return g.select("event_id", "station", (F.col("event_id") * HOUR_US).alias("us"), "speed_kn", "dir_deg")


READINGS_HOURLY = READINGS.replace("readings AS", "raw AS", 1) + """, readings AS (SELECT us // 3600000000 AS event_id, station, us // 3600000000 * 3600000000 AS us, sum(round(speed_kn * 100)::BIGINT)::DOUBLE / count(*) / 100 AS speed_kn,
  arg_max(dir_deg, (us, event_id)) FILTER (dir_deg IS NOT NULL) AS dir_deg FROM raw GROUP BY station, us // 3600000000)"""


def temps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, station, us, temp_c, issued (us): lake temperature with later re-issues."""
    e = load(spark, sf_dir, "events").withColumn("us", micros("ts"))
    h = F.floor(F.col("us") / HOUR_US)
    return e.select("event_id", F.col("event_type").alias("station"), "us", (F.lit(10) + F.abs(F.lit(36) - h % 72) / 4 + F.col("value") % 2).alias("temp_c"), (F.col("us") + (F.col("event_id") % 4) * 6 * HOUR_US).alias("issued"))


TEMPS = """temps AS (SELECT event_id, event_type AS station, epoch_us(ts) AS us, 10 + abs(36 - (epoch_us(ts) // 3600000000) % 72) / 4.0 + value % 2 AS temp_c,
  epoch_us(ts) + (event_id % 4) * 21600000000 AS issued FROM events)"""


def gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, lead_h, obs, fcst, persist (null allowed), clim: paired forecasts."""
    q = F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").select(day_of("l_shipdate").alias("day"), (F.col("l_linenumber") * 24).alias("lead_h"), q.alias("obs"), (q + (F.col("l_discount") - 0.05) * 100).alias("fcst"), F.when(F.col("l_partkey") % 17 != 0, q + (F.col("l_tax") - 0.04) * 100).alias("persist"), F.lit(25.5).alias("clim"), F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("part"))


GATE = """gate AS (SELECT datediff('day', DATE '1970-01-01', l_shipdate::DATE) AS day, l_linenumber * 24 AS lead_h, l_quantity AS obs, l_quantity + (l_discount - 0.05::DOUBLE) * 100 AS fcst,
  CASE WHEN l_partkey % 17 <> 0 THEN l_quantity + (l_tax - 0.04::DOUBLE) * 100 END AS persist, 25.5::DOUBLE AS clim, l_suppkey AS site, l_partkey AS part FROM lineitem)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gauge, day, q: daily discharge."""
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("gauge"), day_of("o_orderdate").alias("day")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 10_000_000).alias("q"))


FLOWS = """flows AS (SELECT o_orderpriority AS gauge, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 10000000 AS q FROM orders GROUP BY ALL)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, depths (ascending), temps: a vertical profile a row, a level for each component."""
    v = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.transform(v, lambda x, i: (i + 1).cast("double")).alias("depths"), F.transform(v, lambda x: F.lit(12) + F.lit(20) * x.cast("double")).alias("temps"), F.col("label").alias("label"))


PROFILES = """levels AS (SELECT vec_id AS node, label, unnest(range(1, len(embedding) + 1))::DOUBLE AS depth, 12 + 20 * unnest(embedding)::DOUBLE AS temp FROM embeddings)"""


def places(spark: SparkSession, sf_dir: str, name: str, key: str, id_: str) -> DataFrame:
    """id, lat, lon, depth from a keyed table."""
    k = F.col(key)
    return load(spark, sf_dir, name).select(k.alias(id_), (F.lit(48) + (k * 7919 % 1000) / 1000).alias("lat"), (F.lit(-90) + (k * 104729 % 1000) / 1000).alias("lon"), (k % 30).cast("double").alias("depth"))


def points(spark, sf_dir):
    return places(spark, sf_dir, "customer", "c_custkey", "point")


def nodes(spark, sf_dir):
    return places(spark, sf_dir, "supplier", "s_suppkey", "node")


_PLACE = "SELECT {k} AS {id}, 48 + ({k} * 7919 % 1000) / 1000.0::DOUBLE AS lat, -90 + ({k} * 104729 % 1000) / 1000.0::DOUBLE AS lon, ({k} % 30)::DOUBLE AS depth FROM {t}"
POINTS = f"points AS ({_PLACE.format(k='c_custkey', id='point', t='customer')})"
NODES = f"nodes AS ({_PLACE.format(k='s_suppkey', id='node', t='supplier')})"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, depth (null: land or no data)."""
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(F.floor(k / 50).alias("row"), (k % 50).alias("col"), F.when(k % 13 != 0, F.col("p_size").cast("double")).alias("depth"))


PIXELS = "pixels AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, CASE WHEN p_partkey % 13 <> 0 THEN p_size::DOUBLE END AS depth FROM part)"


def river(spark: SparkSession, sf_dir: str) -> DataFrame:
    """river, idx, dist_m, z, width: stations along rivers, water surface falling downstream."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("river"), "o_orderkey", "o_custkey", F.round("o_totalprice").cast("long").alias("p"))
    # numbered and summed over pieces of the key, so that a river is many tasks
    n = scan.carried(o, ["river"], ["o_orderkey"], sums={"idx": F.lit(1), "fall": F.col("p") % 7}, width=50_000)
    return n.select("river", F.col("idx").cast("int").alias("idx"), (F.col("idx") * 20).cast("int").alias("dist_m"), (F.lit(100000) - F.col("fall")).cast("double").alias("z_cm"), (F.lit(10) + F.col("o_custkey") % 40).cast("double").alias("width"))


RIVER = """river AS (SELECT o_orderpriority AS river, row_number() OVER w AS idx, row_number() OVER w * 20 AS dist_m,
  (100000 - sum(round(o_totalprice)::BIGINT % 7) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS z_cm, (10 + o_custkey % 40)::DOUBLE AS width
  FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey))"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, species, day, precision, place_id, confidence, source, quote, count: observation rows."""
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality")
    k = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), ((k / n).cast("long") % len(values) + 1).cast("int"))
    return d.join(lab, k == F.col("_id")).select(
        "doc_id", pick(KINDS, 1).alias("kind"), pick(SPECIES, 1).alias("species"), (F.lit(19723) + k % 365).cast("int").alias("day"), pick(PRECISIONS, 3).alias("precision"),
        F.when(k % 5 != 0, pick(PLACES, 2)).alias("place_id"), (F.col("quality") * 0.5 + 0.25).alias("confidence"), F.concat(F.lit("https://www."), "source", F.lit(".example.org/p/"), k.cast("string")).alias("source"), F.col("text").alias("quote"), (2015 + k % 10).cast("int").alias("year"),
    )


#: The vocabularies of the ledger.
KINDS = ("catch", "sighting", "run_status", "stocking", "rumour")
SPECIES = ("lake_trout", "brook_trout", "chinook", "coho", "pink", "steelhead", "walleye", "northern_pike", "lake_whitefish", "smallmouth_bass", "other")
MIGRATORY = ("chinook", "coho", "pink", "steelhead")
PRECISIONS = ("day", "week", "month", "year")
PLACES = ("kam", "current", "neebing", "silver_islet")


def _sql_pick(values, n: int) -> str:
    return f"[{', '.join(repr(v) for v in values)}][doc_id // {n} % {len(values)} + 1]"


LEDGER = f"""ledger AS (SELECT doc_id, {_sql_pick(KINDS, 1)} AS kind, {_sql_pick(SPECIES, 1)} AS species, (19723 + doc_id % 365)::INT AS day, {_sql_pick(PRECISIONS, 3)} AS precision,
  CASE WHEN doc_id % 5 <> 0 THEN {_sql_pick(PLACES, 2)} END AS place_id, quality * 0.5::DOUBLE + 0.25 AS confidence, 'https://www.' || source || '.example.org/p/' || doc_id AS source, text AS quote, (2015 + doc_id % 10)::INT AS year
  FROM documents JOIN labels USING (doc_id))"""


def tier_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place, species, tier, area (integer)."""
    p, item = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    joined = item.join(p, item["l_partkey"] == p["p_partkey"])
    return joined.groupBy(F.col("p_brand").alias("place"), F.col("p_type").alias("species"), F.concat(F.lit("s"), (1 + F.col("p_size") % 5).cast("string")).alias("tier")).agg(F.sum(F.round(F.col("l_extendedprice") / 100).cast("long")).alias("area"))


TIER_AREA = "tier_area AS (SELECT p_brand AS place, p_type AS species, 's' || (1 + p_size % 5) AS tier, sum(round(l_extendedprice / 100)::BIGINT)::BIGINT AS area FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"

#: The run calendar, as (id, species, start, end) with month-day windows.
CALENDAR = (("c1", "chinook", "08-20", "10-05"), ("c2", "steelhead", "04-10", "05-31"), ("c3", "coho", "09-10", "11-15"), ("c4", "walleye", "11-20", "02-10"), ("c5", "lake_trout", "09-25", "freeze_up"))


def calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in CALENDAR], "id string, species string, start string, end string")


CALENDAR_SQL = "calendar(id, species, start, stop) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in CALENDAR) + ")"
