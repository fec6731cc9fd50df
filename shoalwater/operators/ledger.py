"""Report ledgers: validation, aliases, windows, rules, ranking and merging, as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exprs
from ..session import small


def violations(kinds, species, precisions, places) -> Column:
    """Messages of a row's broken rules; empty for a valid row."""
    c = F.col
    checks = [
        (~F.coalesce(c("kind").isin(*kinds), F.lit(False)), "kind"),
        (~F.coalesce(c("species").isin(*species), F.lit(False)), "species"),
        (~F.coalesce(c("precision").isin(*precisions), F.lit(False)), "precision"),
        (~F.coalesce(c("source").rlike("^https?://"), F.lit(False)), "source must be a URL"),
        (~F.coalesce(c("confidence").between(0.0, 1.0), F.lit(False)), "confidence"),
        (~F.coalesce(F.length("quote").between(1, 400), F.lit(False)), "quote"),
        (c("place_id").isNotNull() & ~c("place_id").isin(*places), "place"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda m: m.isNotNull())


def merge_shards(new: DataFrame, log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in the log, the first of each key in order."""
    w = W.partitionBy(key).orderBy(*order)
    return new.join(log.select(key).distinct(), key, "left_anti").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def evolve(old: DataFrame, new: DataFrame, stamped: dict[str, object]) -> DataFrame:
    """Old and new rows under the union of their columns; old rows get a known value where there is one."""
    out = old.unionByName(new, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in stamped.items()})


def longest_alias(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """id with the place of the longest alias that its lower-cased text contains; first listed on ties.

    ``aliases``: alias, place, ord; a small dictionary goes to every task.
    """
    hits = texts.join(small(aliases), F.contains(F.lower("text"), F.col("alias"))).groupBy("id").agg(F.max_by("place", F.struct(F.length("alias"), -F.col("ord"))).alias("place"))
    return texts.select("id").join(hits, "id", "left")


def closed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with the id of the first rule that closes them (null: open).

    ``rules``: ord, rule, match, hard, start, end. A rule matches a substring of the lower-cased place; hard
    rules always close, the others within their annual window.
    """
    window = exprs.in_annual_window("date", "start", "end")
    hits = rows.join(small(rules), F.contains(F.lower("place"), F.col("match"))).where(F.col("hard") | window).groupBy("id").agg(F.min_by("rule", "ord").alias("rule"))
    return rows.join(hits, "id", "left")


def confirmations(rows: DataFrame, as_of: int, migratory, window: int = 7) -> DataFrame:
    """Freshest qualifying report per (place or region, species) within the window of its precision."""
    age = F.lit(as_of) - F.col("day")
    most = F.when(F.col("precision") == "day", window).otherwise(window + 7)
    good = rows.where(F.col("kind").isin("catch", "sighting", "run_status") & F.col("precision").isin("day", "week") & (F.col("confidence") >= 0.5) & (age >= 0) & (age <= most) & (F.col("place_id").isNotNull() | F.col("species").isin(*migratory)))
    key = F.concat_ws(":", F.coalesce("place_id", F.lit("_region")), "species")
    best = F.max_by(F.struct("day", "kind", exprs.domain("source").alias("domain")), F.struct("day", -F.col("doc_id")))
    return good.groupBy(key.alias("key")).agg(best.alias("b")).select("key", "b.*")


def rank_places(areas: DataFrame, weights: dict[str, float], least_area: float, top_n: int, excluded: list[str]) -> DataFrame:
    """Top places per species by the share of weighted area: species, place, rank, score, total.

    ``areas``: place, species, tier, area. The score is relative to the species' best.
    """
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    good = areas.where((F.col("area") > 0) & ~F.col("place").isin(*excluded))
    index = good.groupBy("species", "place").agg(F.sum("area").alias("total"), (F.sum(w[F.col("tier")] * F.col("area")) / F.sum("area")).alias("idx")).where(F.col("total") >= least_area)
    order = W.partitionBy("species").orderBy(F.desc("idx"), "place")
    best = F.max("idx").over(W.partitionBy("species"))
    return index.withColumns({"rank": F.row_number().over(order), "score": F.round(100 * F.col("idx") / best).cast("long")}).where(F.col("rank") <= top_n).select("species", "place", "rank", "score", "total")


def next_window(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """The calendar entry that starts soonest after each date, rolling into the next year."""
    number = F.regexp_replace(F.when(F.col("start") == "freeze_up", "12-01").otherwise(F.col("start")), "-", "").cast("int")
    this = F.make_date(F.year("date"), F.floor(number / 100).cast("int"), (number % 100).cast("int"))
    start = F.when(this > F.col("date"), this).otherwise(F.add_months(this, 12))
    wait = F.datediff(start, F.col("date"))
    return days.join(small(calendar)).groupBy("date").agg(F.min(F.struct(wait.alias("days"), "id")).alias("m")).select("date", "m.days", "m.id")


def first_unprocessed(rows: DataFrame, done: DataFrame, key: str, n: int) -> DataFrame:
    """The newest n rows that are not done; the limit is the feature."""
    return rows.join(done.select(key), key, "left_anti").orderBy(F.desc("day"), key).limit(n)


def run_windows(rows: DataFrame, calendar: DataFrame, tolerance: int = 30, least_reports: int = 12, least_years: int = 3) -> DataFrame:
    """p10 and p90 day of year of reports within an entry's own window +/- tolerance, where there is enough."""
    n = lambda c: F.regexp_replace(F.when(F.col(c) == "freeze_up", "12-01").otherwise(F.col(c)), "-", "").cast("int")
    doy = lambda c: exprs.day_of_year(F.floor(n(c) / 100).cast("int"), (n(c) % 100).cast("int"))
    entries = calendar.select("id", "species", doy("start").alias("a"), doy("end").alias("z")).where("a <= z")
    hit = rows.join(small(entries), "species").where((F.col("doy") >= F.col("a") - tolerance) & (F.col("doy") <= F.col("z") + tolerance))
    got = hit.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("year").alias("years"), F.percentile("doy", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    return got.where((F.col("n") >= least_reports) & (F.col("years") >= least_years)).select("id", "n", "years", F.round(F.col("p")[0], 3).alias("start_doy"), F.round(F.col("p")[1], 3).alias("end_doy"))


def relevant(text: Column, subject: str, context: str, place: str, local: Column) -> Column:
    """Long enough and on the subject; context or place for local sources, context and place elsewhere."""
    about = lambda p: text.rlike(f"(?i){p}")
    both = F.when(local, about(context) | about(place)).otherwise(about(context) & about(place))
    return (F.length(text) >= 12) & about(subject) & both


def tenure(holders: Column) -> Column:
    """Access class from the holders of a place, by precedence."""
    has = lambda *names: F.exists(holders, lambda h: h.isin(*names))
    return F.when(has("restricted"), "restricted").when(has("park"), "park").when(has("municipal", "provincial"), "public").when(has("crown"), "crown").when((F.size(holders) == 0) | holders.isNull(), "unknown").when(has("private") & (F.size(F.array_distinct(holders)) > 1), "unknown").when(has("private"), "private").otherwise("unknown")


def missing_windows(rows: DataFrame, start: int, end: int, chunk: int) -> DataFrame:
    """Coverage of [start, end] days in chunks: first, last, records, missing."""
    spine = rows.sparkSession.range(start, end + 1, chunk).select(F.col("id").alias("first"), F.least(F.col("id") + chunk - 1, F.lit(end)).alias("last"))
    counts = rows.where(F.col("day").between(start, end)).groupBy((F.floor((F.col("day") - start) / chunk) * chunk + start).alias("first")).agg(F.count("*").alias("records"))
    out = spine.join(counts, "first", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return out.withColumn("missing", F.col("records") == 0)


def clamp_range(start: Column, end: Column, today: Column, coverage_end: Column) -> Column:
    """(start, end, reason): the end cut to today and to the coverage; past all coverage it is empty."""
    last = F.least(end, today, coverage_end)
    reason = F.concat_ws("; ", F.when(end > today, "after today"), F.when(end > coverage_end, "after coverage"))
    gone = last < start
    return F.struct(F.when(~gone, start).alias("first"), F.when(~gone, last).alias("last"), reason.alias("reason"))
