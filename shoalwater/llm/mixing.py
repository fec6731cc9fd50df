"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

DataFrame operations only. Each document gets a hash-random key (the md5 of its id, so
that any engine can repeat it). Within a source the key order is cut into ranges by the
key's first hex digits; sizes are summed per range, ranges are prefix-summed on that small
table, and documents are prefix-summed within a range. No window covers a whole source, so a
source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SPACE, pin, table, word_count

#: Weights of the sources in code point order, repeating; the share of all
#: sizes that the mix takes; the most often that a source is repeated.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Hex digits of the key that make a range: 16 ** 3 = 4096 ranges a source.
DIGITS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Target of each source: ``source, source_size, target``.

    ``sizes``: one row per source (source, source_size). A source's target is its weight
    times one common level, at most ``epochs`` times its size; the level is the one at which
    the targets add up to ``share`` of all sizes. It is found by ordering the sources by the
    level at which each is full and taking the first at which the rest fits.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(epochs))
    by_level = W.orderBy("full_at", "_rank")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (
        sizes.withColumn("_rank", F.row_number().over(order))
        .withColumn("w", w)
        .withColumn("full_at", full / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("spent", F.coalesce(F.sum(full).over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("w_left"))
        .withColumn("fits", F.col("level") <= F.col("full_at"))
        .withColumn("common", F.min(F.when(F.col("fits"), F.struct("full_at", "_rank", "level"))).over(everything)["level"])
    )
    return ranked.select("source", "source_size", F.least(full, F.coalesce(F.col("common") * F.col("w"), full)).alias("target"))


def take(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, size: Column | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``; every row stays.

    Whole epochs take a source as often as its target holds it; the last, partial epoch takes
    documents in key order and cuts the one at the budget's end, so the taken words of a
    source are its target rounded to a word. Null text has size 0 and is taken 0 times; a
    null source is a source of its own; a null id is ordered as the empty text; repeated rows
    are ordered among themselves by size and text, and equal rows get equal results up to
    the row that the budget's end cuts. An empty table gives an empty table. Columns of
    ``docs`` named like the new ones are replaced. A text of any length is one row, counted whole. ``size``: another measure than words.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    safe = {c: f"c{i}" for i, c in enumerate(own)}  # no column of the input can clash with a helper's
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in safe.items()], (word_count("text") if size is None else size).alias("size"), F.col("source").alias("from"), key.alias("key")).withColumn("range", F.substring("key", 1, DIGITS))
    ranges = sized.groupBy("from", "range").agg(F.sum("size").alias("range_size"))
    target = targets(ranges.groupBy(F.col("from").alias("source")).agg(F.sum("range_size").alias("source_size")), weights, share, epochs)
    starts = ranges.withColumn("start", F.sum("range_size").over(W.partitionBy("from").orderBy("range")) - F.col("range_size"))
    plan = starts.join(target, F.col("from").eqNullSafe(F.col("source"))).select("source", F.col("range").alias("r"), "start", "source_size", "target")
    within = W.partitionBy("from", "range").orderBy("key", safe["doc_id"], "size", *([safe["text"]] if "text" in own else [])).rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(plan, placed["from"].eqNullSafe(plan["source"]) & (placed["range"] == plan["r"]))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("before")))
    return joined.select(*[F.col(n).alias(c) for c, n in safe.items()], "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken.

    The document that a budget cuts gives its first words, joined by single spaces.
    """
    own = docs.columns
    safe = {c: c if c in ("doc_id", "source", "text") else f"o{i}" for i, c in enumerate(own)}
    got = take(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in safe.items()]), **options).where("taken > 0")
    part = F.col("taken") - F.floor(F.col("taken") / F.col("size")) * F.col("size")
    words = F.array_remove(F.split(F.col("text"), SPACE + "+"), "")
    cut = F.array_join(F.slice(words, F.lit(1), part.cast("int")), " ")
    copies = F.concat(F.array_repeat(F.col("text"), F.floor(F.col("taken") / F.col("size")).cast("int")), F.when(part > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = got.withColumn("text", F.explode(copies))
    if "n_chars" in own:
        out = out.withColumn(safe["n_chars"], F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(n).alias(c) for c, n in safe.items()])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, md5(coalesce(doc_id::VARCHAR, '')) AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((rn - 1) % 3) + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w),
p AS (SELECT *, coalesce(sum(cap) OVER o, 0.0::DOUBLE) AS spent, sum(w) OVER () - coalesce(sum(w) OVER o, 0.0::DOUBLE) AS w_left FROM r WINDOW o AS (ORDER BY full_at, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - spent) / w_left AS level FROM p),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= full_at ORDER BY full_at, rn LIMIT 1) * w, cap)) AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size, d.text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM c
"""


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix over all documents; only ids, sources and sizes go on from the one pass over the texts."""
    docs = table(spark, sf_dir, "documents")
    lean = pin(docs.select("doc_id", "source", word_count("text").alias("size")), "sizes")
    return take(lean, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")
