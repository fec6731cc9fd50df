"""Queries of the ledger family: sources in table form, rules, aliases, ranking and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import ledger as ops
from . import bindings as b
from .bindings import CALENDAR_SQL, DAY_US, HOUR_US, LEDGER, READINGS, TIER_AREA, load
from .registry import query

DATE = "(DATE '1970-01-01' + day::INT)"


def _date(day="day"):
    return F.date_add(F.lit("1970-01-01").cast("date"), F.col(day))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


VALID_KINDS = b.KINDS[:4]
VALID_PRECISIONS = b.PRECISIONS


@query("PF-11", f"""WITH {LEDGER} SELECT doc_id, concat_ws(',', CASE WHEN kind NOT IN {_in(VALID_KINDS)} THEN 'kind' END, CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, FALSE) THEN 'confidence' END, CASE WHEN NOT coalesce(length(quote) BETWEEN 1 AND 400, FALSE) THEN 'quote' END, CASE WHEN place_id = 'silver_islet' THEN 'place' END) AS errors FROM ledger""")
def pf11(spark, d):
    v = ops.violations(VALID_KINDS, b.SPECIES, VALID_PRECISIONS, b.PLACES[:3])
    return b.ledger(spark, d).select("doc_id", F.array_join(v, ",").alias("errors"))


@query("PF-12", r"""SELECT doc_id FROM documents WHERE length(text) >= 12 AND regexp_matches(text, '(?i)ing|ción') AND CASE WHEN source IN ('src0', 'src1') THEN regexp_matches(text, '(?i)the th') OR regexp_matches(text, '(?i)of th') ELSE regexp_matches(text, '(?i)the th') AND regexp_matches(text, '(?i)of th') END""")
def pf12(spark, d):
    docs = load(spark, d, "documents")
    return docs.where(ops.relevant(F.col("text"), "ing|ción", "the th", "of th", F.col("source").isin("src0", "src1"))).select("doc_id")


@query("PF-13", f"""WITH {CALENDAR_SQL}, days AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), n AS (SELECT *, replace(CASE WHEN start = 'freeze_up' THEN '12-01' ELSE start END, '-', '')::INT AS a, replace(CASE WHEN stop = 'freeze_up' THEN '12-01' ELSE stop END, '-', '')::INT AS z FROM calendar)
SELECT date::VARCHAR AS date, id FROM days, n WHERE CASE WHEN a <= z THEN month(date) * 100 + day(date) BETWEEN a AND z ELSE month(date) * 100 + day(date) >= a OR month(date) * 100 + day(date) <= z END""")
def pf13(spark, d):
    days = load(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    inside = exprs.in_annual_window("date", "start", "end")
    return days.join(F.broadcast(b.calendar(spark)), inside).select(F.col("date").cast("string").alias("date"), "id")


@query("PF-14", "SELECT DISTINCT o_orderdate::DATE::VARCHAR AS date, CASE WHEN month(o_orderdate) IN (5, 6) THEN 'spring' WHEN month(o_orderdate) IN (7, 8, 9) THEN 'summer' WHEN month(o_orderdate) IN (10, 11) THEN 'fall' ELSE 'winter' END AS season, CASE WHEN month(o_orderdate) IN (7, 8, 9) THEN 'primary' WHEN month(o_orderdate) IN (10, 11) THEN 'secondary' ELSE 'minimal' END AS upwelling FROM orders")
def pf14(spark, d):
    days = load(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return days.select(F.col("date").cast("string").alias("date"), exprs.season("date").alias("s")).select("date", "s.*")


RULES = [(1, "r1", "brand#1", True, "01-01", "12-31"), (2, "r2", "brand#2", False, "11-15", "03-01"), (3, "r3", "brand#23", False, "06-01", "06-30")]


@query("PF-09", f"""WITH rules(ord, rule, match, hard, a, z) AS (VALUES (1, 'r1', 'brand#1', TRUE, 101, 1231), (2, 'r2', 'brand#2', FALSE, 1115, 301), (3, 'r3', 'brand#23', FALSE, 601, 630)), p AS (SELECT p_partkey AS id, p_brand AS place, month(DATE '2024-01-01' + (p_partkey % 365)::INT) * 100 + day(DATE '2024-01-01' + (p_partkey % 365)::INT) AS md FROM part)
SELECT p.id, arg_min(rule, ord) AS rule FROM p LEFT JOIN rules ON contains(lower(place), match) AND (hard OR CASE WHEN a <= z THEN md BETWEEN a AND z ELSE md >= a OR md <= z END) GROUP BY p.id""")
def pf09(spark, d):
    rules = spark.createDataFrame(RULES, "ord int, rule string, match string, hard boolean, start string, end string")
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("place"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")).alias("date"))
    return ops.closed(p, rules).select("id", "rule")


@query("PF-10", "WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'T2' ELSE 'T1' END AS tier, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'x' END AS verified, s_nationkey AS n, s_suppkey % 5000 AS slot FROM supplier) SELECT id, 'tier' AS problem FROM r WHERE tier <> 'T1' UNION ALL SELECT id, 'unverified' FROM r WHERE verified IS NULL UNION ALL SELECT id, 'no entry' FROM r WHERE (n, slot) NOT IN (SELECT (c_nationkey, c_custkey % 5000) FROM customer)")
def pf10(spark, d):
    k = F.col("s_suppkey")
    r = load(spark, d, "supplier").select(k.alias("id"), F.when(k % 4 == 0, "T2").otherwise("T1").alias("tier"), F.when(k % 7 != 0, "x").alias("verified"), F.col("s_nationkey").alias("n"), (k % 5000).alias("slot"))
    backing = load(spark, d, "customer").select(F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 5000).alias("slot"))
    found = lambda df, what: df.select("id", F.lit(what).alias("problem"))
    return found(r.where("tier <> 'T1'"), "tier").union(found(r.where("verified IS NULL"), "unverified")).union(found(r.join(backing, ["n", "slot"], "left_anti"), "no entry"))


@query("PF-15", "SELECT p_partkey, CASE WHEN (d_iso IS NULL OR abs(d_iso) <= 8) AND abs(d_ml) <= 4 THEN 'ok' ELSE 'DIVERGENT' END AS verdict FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_size - 25 END AS d_iso, p_partkey % 13 - 6 AS d_ml FROM part)")
def pf15(spark, d):
    k = F.col("p_partkey")
    p = load(spark, d, "part").select("p_partkey", F.when(k % 9 != 0, F.col("p_size") - 25).alias("d_iso"), (k % 13 - 6).alias("d_ml"))
    return p.select("p_partkey", exprs.within_tolerance("d_iso", "d_ml").alias("verdict"))


@query("PF-16", f"""WITH {LEDGER}, n(name, code) AS (VALUES ('chinook', 'ON'), ('coho', 'OK'), ('steelhead', 'OM')), m AS (SELECT doc_id, coalesce(code, 'other') AS code, round(CASE WHEN species = 'steelhead' THEN confidence * 0.8 ELSE confidence END, 6) AS confidence, precision FROM ledger LEFT JOIN n ON species = name WHERE year >= 2016) SELECT * FROM m WHERE NOT (code = 'other' AND precision = 'year')""")
def pf16(spark, d):
    names = spark.createDataFrame([("chinook", "ON"), ("coho", "OK"), ("steelhead", "OM")], "species string, code string")
    m = b.ledger(spark, d).where("year >= 2016").join(F.broadcast(names), "species", "left").select("doc_id", F.coalesce("code", F.lit("other")).alias("code"), F.round(F.when(F.col("species") == "steelhead", F.col("confidence") * 0.8).otherwise(F.col("confidence")), 6).alias("confidence"), "precision")
    return m.where("NOT (code = 'other' AND precision = 'year')")


@query("PF-18", """WITH h AS (SELECT c_custkey // 60 AS place, list(DISTINCT CASE c_custkey % 97 WHEN 0 THEN 'restricted' WHEN 1 THEN 'park' WHEN 2 THEN 'municipal' WHEN 3 THEN 'crown' ELSE 'private' END) AS holders FROM customer GROUP BY ALL)
SELECT place, CASE WHEN list_contains(holders, 'restricted') THEN 'restricted' WHEN list_contains(holders, 'park') THEN 'park' WHEN list_contains(holders, 'municipal') THEN 'public' WHEN list_contains(holders, 'crown') THEN 'crown' WHEN list_contains(holders, 'private') THEN 'private' ELSE 'unknown' END AS class FROM h""")
def pf18(spark, d):
    k = F.col("c_custkey") % 97
    holder = F.when(k == 0, "restricted").when(k == 1, "park").when(k == 2, "municipal").when(k == 3, "crown").otherwise("private")
    h = load(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 60).alias("place")).agg(F.collect_set(holder).alias("holders"))
    return h.select("place", ops.tenure(F.col("holders")).alias("class"))


@query("PF-20", f"WITH {b.POINTS} SELECT point FROM points WHERE lat BETWEEN 48.2 AND 48.6 AND lon BETWEEN -89.9 AND -89.3")
def pf20(spark, d):
    return b.points(spark, d).where(F.col("lat").between(48.2, 48.6) & F.col("lon").between(-89.9, -89.3)).select("point")


@query("PF-21", "SELECT p_partkey, CASE WHEN (p_size >> 3) & 1 = 1 THEN round((p_partkey * 25 + 40000) * 0.00341802::DOUBLE + 149 - 273.15, 3) END AS celsius FROM part")
def pf21(spark, d):
    water = F.getbit("p_size", F.lit(3)) == 1
    return load(spark, d, "part").select("p_partkey", F.when(water, F.round((F.col("p_partkey") * 25 + 40_000) * 0.00341802 + 149 - 273.15, 3)).alias("celsius"))


@query("FN-05", "SELECT DISTINCT month(o_orderdate) AS m, day(o_orderdate) AS dd, dayofyear(make_date(2001, month(o_orderdate), day(o_orderdate))) AS doy FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)")
def fn05(spark, d):
    o = load(spark, d, "orders").select(F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("dd")).distinct().where("NOT (m = 2 AND dd = 29)")
    return o.select("m", "dd", exprs.day_of_year("m", "dd").alias("doy"))


@query("FN-06", f"WITH {LEDGER} SELECT doc_id, substr(sha1(concat_ws('|', source, coalesce(day::VARCHAR, 'None'), species, kind, coalesce(place_id, 'None')) || coalesce('|' || CASE WHEN doc_id % 3 = 0 THEN doc_id END, '')), 1, 16) AS id FROM ledger")
def fn06(spark, d):
    row = exprs.row_id("source", "day", "species", "kind", "place_id", external=F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")))
    return b.ledger(spark, d).select("doc_id", row.alias("id"))


@query("FN-07", r"SELECT page_id, regexp_replace(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '^www\.', '') AS domain FROM pages")
def fn07(spark, d):
    return load(spark, d, "pages").select("page_id", exprs.domain("url").alias("domain"))


ALIASES = [("the", "north", 0), ("of the", "kam", 1), ("and the", "current", 2), ("que la", "neebing", 3), ("ing the", "silver", 4)]


@query("J-13", f"WITH a(alias, place, ord) AS (VALUES {', '.join(str(x) for x in ALIASES)}) SELECT doc_id AS id, arg_max(place, (length(alias), -ord)) AS place FROM documents LEFT JOIN a ON contains(lower(text), alias) GROUP BY doc_id")
def j13(spark, d):
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return ops.longest_alias(texts, spark.createDataFrame(ALIASES, "alias string, place string, ord int"))


@query("J-14", f"""WITH {b.FLOWS}, q AS (SELECT DISTINCT o_orderpriority AS gauge, datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 2 AS day FROM orders)
SELECT q.gauge, q.day, arg_max(f.day, f.day) AS found_day, round(arg_max(q, f.day), 9) AS q, CASE WHEN count(f.day) = 0 THEN 'nothing within 4 days' END AS reason FROM q LEFT JOIN (SELECT * FROM (SELECT gauge, day, CASE WHEN day % 11 >= 7 THEN q END AS q FROM flows) WHERE q IS NOT NULL) f ON f.gauge = q.gauge AND f.day BETWEEN q.day - 4 AND q.day GROUP BY ALL""")
def j14(spark, d):
    asked = load(spark, d, "orders").select(F.col("o_orderpriority").alias("gauge"), (b.day_of("o_orderdate") + 2).alias("day")).distinct()
    there = b.flows(spark, d).withColumn("q", F.when(F.col("day") % 11 >= 7, F.col("q"))).where("q IS NOT NULL").select("gauge", F.col("day").alias("found_day"), F.col("q"))  # most days have no value yet
    near = asked.withColumn("found_day", F.explode(F.sequence(F.col("day") - 4, F.col("day")))).join(there, ["gauge", "found_day"])
    best = near.groupBy("gauge", "day").agg(F.max(F.struct("found_day", "q")).alias("m"))
    return asked.join(best, ["gauge", "day"], "left").select("gauge", "day", "m.found_day", F.round("m.q", 9).alias("q"), F.when(F.col("m").isNull(), "nothing within 4 days").alias("reason"))


@query("AGG-37", f"""WITH {LEDGER}, {CALENDAR_SQL}, c AS (SELECT id, species, dayofyear(make_date(2001, split_part(start, '-', 1)::INT, split_part(start, '-', 2)::INT)) AS a, dayofyear(make_date(2001, split_part(stop, '-', 1)::INT, split_part(stop, '-', 2)::INT)) AS z FROM (SELECT id, species, start, CASE WHEN stop = 'freeze_up' THEN '12-01' ELSE stop END AS stop FROM calendar)),
h AS (SELECT id, year, dayofyear({DATE}) AS doy FROM ledger JOIN c USING (species) WHERE a <= z AND dayofyear({DATE}) BETWEEN a - 30 AND z + 30) SELECT id, count(*) AS n, count(DISTINCT year) AS years, round(quantile_cont(doy, 0.1), 3) AS start_doy, round(quantile_cont(doy, 0.9), 3) AS end_doy FROM h GROUP BY id HAVING count(*) >= 5 AND count(DISTINCT year) >= 3""")
def agg37(spark, d):
    rows = b.ledger(spark, d).select("species", "year", F.dayofyear(_date()).alias("doy"))
    return ops.run_windows(rows, b.calendar(spark), least_reports=5)


@query("AGG-39", f"""WITH {LEDGER}, g AS (SELECT *, coalesce(place_id, '_region') || ':' || species AS key FROM ledger WHERE kind IN ('catch', 'sighting', 'run_status') AND precision IN ('day', 'week') AND confidence >= 0.5 AND 19900 - day BETWEEN 0 AND CASE WHEN precision = 'day' THEN 60 ELSE 67 END AND (place_id IS NOT NULL OR species IN {_in(b.MIGRATORY)}))
SELECT key, arg_max(day, (day, -doc_id)) AS day, arg_max(kind, (day, -doc_id)) AS kind, regexp_replace(split_part(regexp_replace(arg_max(source, (day, -doc_id)), '^https?://', ''), '/', 1), '^www\\.', '') AS domain FROM g GROUP BY key""")
def agg39(spark, d):
    return ops.confirmations(b.ledger(spark, d), 19900, b.MIGRATORY, 60)


@query("AGG-43", "SELECT source, count(*) AS total, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS done FROM documents GROUP BY source")
def agg43(spark, d):
    done = load(spark, d, "labels").select("doc_id").distinct().withColumn("done", F.lit(1))
    return load(spark, d, "documents").select("doc_id", "source").join(done, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("done").alias("done"))


WEIGHTS = {"s1": 0.15, "s2": 0.5, "s3": 0.7, "s4": 0.85, "s5": 1.0}
_W = "CASE tier WHEN 's1' THEN 0.15::DOUBLE WHEN 's2' THEN 0.5 WHEN 's3' THEN 0.7 WHEN 's4' THEN 0.85 ELSE 1.0 END"


@query("AGG-44", f"WITH {TIER_AREA} SELECT place, sum(area)::BIGINT AS total, round(sum({_W} * area), 3) AS weighted FROM tier_area GROUP BY place")
def agg44(spark, d):
    w = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return b.tier_area(spark, d).groupBy("place").agg(F.sum("area").alias("total"), F.round(F.sum(w[F.col("tier")] * F.col("area")), 3).alias("weighted"))


@query("TOP-01", f"""WITH {TIER_AREA}, i AS (SELECT species, place, sum(area)::BIGINT AS total, sum({_W} * area) / sum(area) AS idx FROM tier_area WHERE area > 0 AND place NOT IN ('Brand#3') GROUP BY ALL HAVING sum(area) >= 2500), r AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY idx DESC, place) AS rank, max(idx) OVER (PARTITION BY species) AS best FROM i)
SELECT species, place, rank, round(100 * idx / best)::BIGINT AS score, total FROM r WHERE rank <= 5""")
def top01(spark, d):
    return ops.rank_places(b.tier_area(spark, d), WEIGHTS, 2500, 5, ["Brand#3"])


@query("TOP-02", f"""WITH {CALENDAR_SQL}, days AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)), s AS (SELECT date, id, make_date(year(date), split_part(start, '-', 1)::INT, split_part(start, '-', 2)::INT) AS t FROM days, calendar), n AS (SELECT date, id, datediff('day', date, CASE WHEN t > date THEN t ELSE t + INTERVAL 12 MONTH END) AS days FROM s)
SELECT date::VARCHAR AS date, min(days) AS days, arg_min(id, (days, id)) AS id FROM n GROUP BY date""")
def top02(spark, d):
    days = load(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct().where("NOT (month(date) = 2 AND day(date) = 29)")
    return ops.next_window(days, b.calendar(spark)).withColumn("date", F.col("date").cast("string"))


@query("TOP-03", "SELECT doc_id, doc_id % 365 AS day FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY day DESC, doc_id LIMIT 25")
def top03(spark, d):
    docs = load(spark, d, "documents").select("doc_id", (F.col("doc_id") % 365).alias("day"))
    return ops.first_unprocessed(docs, load(spark, d, "labels"), "doc_id", 25)


@query("TOP-05", f"""WITH {CALENDAR_SQL}, m(marker, species) AS (VALUES ('m1', 'chinook'), ('m1', 'coho'), ('m2', 'walleye'), ('m2', 'lake_trout'), ('m3', 'steelhead')), days AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), n AS (SELECT *, replace(start, '-', '')::INT AS a, replace(CASE WHEN stop = 'freeze_up' THEN '12-01' ELSE stop END, '-', '')::INT AS z FROM calendar)
SELECT date::VARCHAR AS date, marker, string_agg(DISTINCT id, ',' ORDER BY id) AS open FROM days, m JOIN n USING (species) WHERE CASE WHEN a <= z THEN month(date) * 100 + day(date) BETWEEN a AND z ELSE month(date) * 100 + day(date) >= a OR month(date) * 100 + day(date) <= z END GROUP BY ALL""")
def top05(spark, d):
    markers = spark.createDataFrame([("m1", ["chinook", "coho"]), ("m2", ["walleye", "lake_trout"]), ("m3", ["steelhead"])], "marker string, species array<string>")
    entries = markers.select("marker", F.explode("species").alias("species")).join(b.calendar(spark), "species")
    days = load(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    open_ = days.join(F.broadcast(entries), exprs.in_annual_window("date", "start", "end"))
    return open_.groupBy(F.col("date").cast("string").alias("date"), "marker").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("open"))


@query("SET-02", "WITH n AS (SELECT doc_id % 700 AS id, text, doc_id, row_number() OVER (PARTITION BY doc_id % 700 ORDER BY doc_id) AS k FROM documents) SELECT id, doc_id FROM n WHERE k = 1 AND id NOT IN (SELECT doc_id % 300 FROM labels)")
def set02(spark, d):
    new = load(spark, d, "documents").select((F.col("doc_id") % 700).alias("id"), "doc_id")
    log = load(spark, d, "labels").select((F.col("doc_id") % 300).alias("id"))
    return ops.merge_shards(new, log, "id", ["doc_id"])


@query("SRC-03", "SELECT event_id, event_type, epoch_us(ts) AS us FROM events WHERE event_id % 2 = 1 AND (event_type, epoch_us(ts) // 600000000) NOT IN (SELECT (event_type, epoch_us(ts) // 600000000) FROM events WHERE event_id % 2 = 0)")
def src03(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type", b.micros("ts").alias("us")).withColumn("h", F.floor(F.col("us") / (HOUR_US // 6)))
    from ..sources.landed import new_rows

    return new_rows(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), ["event_type", "h"]).select("event_id", "event_type", "us")


@query("SRC-04", "SELECT event_id, value, 'v1' AS vintage, NULL::BIGINT AS user_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value, 'v2', user_id FROM events WHERE event_id % 2 = 1")
def src04(spark, d):
    e = load(spark, d, "events")
    return ops.evolve(e.where("event_id % 2 = 0").select("event_id", "value"), e.where("event_id % 2 = 1").select("event_id", "value", F.lit("v2").alias("vintage"), "user_id"), {"vintage": "v1"}).select("event_id", "value", "vintage", "user_id")


@query("SRC-06", "WITH k AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'manual:' || substr(sha256(text), 1, 16) ELSE source || ':' || coalesce(lang, 'none') || ':' || (doc_id % 800) END AS key FROM documents) SELECT key, min(doc_id) AS doc_id FROM k GROUP BY key")
def src06(spark, d):
    i = F.col("doc_id")
    key = F.when(i % 6 == 0, F.concat(F.lit("manual:"), F.substring(F.sha2("text", 256), 1, 16))).otherwise(F.concat_ws(":", "source", F.coalesce("lang", F.lit("none")), (i % 800).cast("string")))
    return load(spark, d, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"))


@query("SRC-10", """WITH s AS (SELECT vec_id AS id, unnest([1, 2, 3]) AS sensor, unnest([embedding[1], embedding[3], embedding[5]])::DOUBLE AS temp, unnest([embedding[2], embedding[4], embedding[6]])::DOUBLE AS depth, unnest([CASE WHEN vec_id % 5 <> 0 THEN vec_id % 4 END, CASE WHEN vec_id % 7 <> 0 THEN (vec_id + 1) % 4 END, 1]) AS qc FROM embeddings) SELECT id, sensor, temp, depth, coalesce(qc, 2)::BIGINT AS qc FROM s WHERE coalesce(qc, 2) IN (1, 2)""")
def src10(spark, d):
    from ..sources.landed import sensors_to_long

    v, k = F.col("embedding"), F.col("vec_id")
    wide = load(spark, d, "embeddings").select(k.alias("id"), *[v[2 * i].cast("double").alias(f"temp_{i + 1}") for i in range(3)], *[v[2 * i + 1].cast("double").alias(f"depth_{i + 1}") for i in range(3)], F.when(k % 5 != 0, k % 4).alias("qc_1"), F.when(k % 7 != 0, (k + 1) % 4).alias("qc_2"), F.lit(1).cast("long").alias("qc_3"))
    return sensors_to_long(wide, 3)


@query("SRC-11", f"WITH r AS (SELECT event_id, value AS kmh, event_id % 37 AS tens, event_id % 29 = 0 AS flagged FROM events) SELECT event_id, round(kmh / 1.852::DOUBLE, 6) AS speed_kn, CASE WHEN tens <> 0 THEN tens * 10.0::DOUBLE END AS dir_deg FROM r WHERE NOT flagged AND kmh / 1.852::DOUBLE BETWEEN 0 AND 200")
def src11(spark, d):
    from ..sources.landed import normalise_wind

    e = load(spark, d, "events").select("event_id", F.col("value").alias("kmh"), (F.col("event_id") % 37).alias("tens"), (F.col("event_id") % 29 == 0).alias("flagged"))
    return normalise_wind(e).select("event_id", F.round("speed_kn", 6).alias("speed_kn"), "dir_deg")


@query("SRC-12", """SELECT user_id % 10 AS member, user_id, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL""")
def src12(spark, d):
    from ..sources.landed import wide_members_to_rows

    e = load(spark, d, "events").groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    m = F.col("user_id") % 10
    name = F.when(m == 0, "wind_speed_10m").otherwise(F.concat(F.lit("wind_speed_10m_member"), F.lpad(m.cast("string"), 2, "0")))
    wide = e.select("user_id", F.to_json(F.map_from_arrays(F.array(name, F.regexp_replace(name, "speed", "direction")), F.array(F.array("total"), F.array(F.lit(270).cast("long"))))).alias("hourly"))
    return wide_members_to_rows(wide, "user_id").select("member", "user_id", F.col("speed").cast("long").alias("total"))


@query("SRC-13", "WITH l AS (SELECT event_id % 5000 AS id, lead, event_id, CASE WHEN event_id % lead <> 0 THEN value * lead END AS speed FROM events, (VALUES (1), (2), (3)) t(lead)) SELECT id, lead, arg_max(speed, event_id) AS speed FROM l WHERE speed IS NOT NULL GROUP BY ALL")
def src13(spark, d):
    e, k = load(spark, d, "events"), F.col("event_id")
    wide = e.select((k % 5000).alias("id"), "event_id", *[F.when(k % n != 0, F.col("value") * n).alias(f"speed_{n}") for n in (1, 2, 3)])
    long_ = wide.unpivot(["id", "event_id"], ["speed_1", "speed_2", "speed_3"], "lead", "speed").where("speed IS NOT NULL").withColumn("lead", F.regexp_extract("lead", r"(\d+)$", 1).cast("int"))
    return long_.groupBy("id", "lead").agg(F.max_by("speed", "event_id").alias("speed"))


@query("SRC-18", f"""WITH {LEDGER}, {CALENDAR_SQL}, c AS (SELECT id, species, dayofyear(make_date(2001, split_part(start, '-', 1)::INT, split_part(start, '-', 2)::INT)) AS a, dayofyear(make_date(2001, split_part(stop, '-', 1)::INT, split_part(stop, '-', 2)::INT)) AS z FROM (SELECT id, species, start, CASE WHEN stop = 'freeze_up' THEN '12-01' ELSE stop END AS stop FROM calendar)),
h AS (SELECT id, year, dayofyear({DATE}) AS doy FROM ledger JOIN c USING (species) WHERE a <= z AND dayofyear({DATE}) BETWEEN a - 30 AND z + 30), f AS (SELECT id, round(quantile_cont(doy, 0.1), 3) AS s FROM h GROUP BY id HAVING count(*) >= 5 AND count(DISTINCT year) >= 3)
SELECT c.id, coalesce(s, a) AS start_doy, CASE WHEN s IS NULL THEN 'T2' ELSE 'DATA(local reports)' END AS tier FROM c LEFT JOIN f ON c.id = f.id""")
def src18(spark, d):
    rows = b.ledger(spark, d).select("species", "year", F.dayofyear(_date()).alias("doy"))
    fitted = ops.run_windows(rows, b.calendar(spark), least_reports=5).select("id", F.col("start_doy").alias("fitted"))
    own = exprs.day_of_year(F.substring("start", 1, 2).cast("int"), F.substring("start", 4, 2).cast("int")).cast("double")
    return b.calendar(spark).join(fitted, "id", "left").select("id", F.coalesce("fitted", own).alias("start_doy"), F.when(F.col("fitted").isNotNull(), "DATA(local reports)").otherwise("T2").alias("tier"))


@query("SRC-20", f"WITH r AS (SELECT datediff('day', DATE '1970-01-01', ts::DATE) AS day FROM events), s AS (SELECT unnest(range(19715, 19761, 7)) AS first) SELECT first, least(first + 6, 19760) AS last, count(day) AS records, count(day) = 0 AS missing FROM s LEFT JOIN r ON day BETWEEN first AND least(first + 6, 19760) GROUP BY ALL")
def src20(spark, d):
    return ops.missing_windows(load(spark, d, "events").select(b.day_of("ts").alias("day")), 19715, 19760, 7)


@query("SRC-21", "WITH r AS (SELECT p_partkey, p_partkey % 100 AS s, p_partkey % 100 + p_size AS e FROM part), c AS (SELECT *, least(e, 90, 80) AS l FROM r) SELECT p_partkey, CASE WHEN l >= s THEN s END AS first, CASE WHEN l >= s THEN l END AS last, concat_ws('; ', CASE WHEN e > 90 THEN 'after today' END, CASE WHEN e > 80 THEN 'after coverage' END) AS reason FROM c")
def src21(spark, d):
    s = F.col("p_partkey") % 100
    c = ops.clamp_range(s, s + F.col("p_size"), F.lit(90).cast("long"), F.lit(80).cast("long"))
    return load(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.*")
