"""Line dedup: lines that many documents share are dropped, but for the last document that holds them.

DataFrame functions only. Lines are exploded and normalised, their keys hashed to 128 bits and the
documents of a hash counted with one row a document, so that a line which a third of all documents
hold is combined before the shuffle. The hashes over the threshold are a table of their own; the positions
that it drops go back to their documents, whose texts are shuffled once and cut at those positions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .common import pin, table

#: What is stripped at a line's ends, `[\x20\x09-\x0D]`, and the letters that are lower-cased.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Code points of a key, at least, and documents that hold it, at least, for its lines to go.
MIN_POINTS, MIN_DOCS = 20, 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """A line as it is compared: stripped at both ends, A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(key: Column) -> list[Column]:
    """128 bits: two hashes of different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def frequent(rows: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keys in at least ``min_docs`` documents: h1, h2 and last, the largest document id that holds them.

    ``rows``: id, text. A row gives each of its keys once; rows of one id are one document.
    """
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_points))
    held = rows.select("id", F.explode(keys).alias("key")).select("id", *_hashes(F.col("key")))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        held = held.dropDuplicates(["id", "h1", "h2"])
    return held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).select("h1", "h2", "last")


def dropped_lines(rows: DataFrame, over: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Positions of the lines to drop: id, version, and dropped, an ascending array for each document.

    ``rows``: id, version, text. The join keeps a hot key's lines apart: both sides are plain exchanges,
    which adaptive execution splits, and no row meets more than one of ``over``.
    """
    at = rows.select("id", "version", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = at.select("id", "version", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_points)
    hit = keyed.select("id", "version", "pos", *_hashes(F.col("key"))).join(over.hint("merge"), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    return hit.groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def _without(text: Column, dropped: Column) -> Column:
    """``text`` without the lines at the ascending positions ``dropped``: the runs between them, joined.

    Lines and cuts are bound once by the outer ``transform``, so the work is linear in the text.
    """
    cuts = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(_lines(text))))
    bound = F.array(F.struct(_lines(text).alias("lines"), cuts.alias("cuts")))

    def kept(b: Column) -> Column:
        def run(j: Column) -> Column:
            a, z = F.get(b["cuts"], j), F.get(b["cuts"], j + 1)
            return F.slice(b["lines"], a + 2, z - a - 1)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(b["cuts"]) - 2), run)), "\n")

    return F.get(F.transform(bound, kept), F.lit(0))


def dedup(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the text that stays, ``n_lines`` (before) and ``n_dropped``; every row stays.

    A key of at least ``min_points`` code points that at least ``min_docs`` documents hold loses all its
    lines except those of the largest doc_id holding it. Null text counts as empty, one empty line, and
    comes back as empty; a document all of whose lines go comes back empty. Rows of one doc_id are one
    document when documents are counted (equal rows, too, get equal results), each with its own lines;
    null ids are one document below all others. A line that repeats within a document counts once
    and goes or stays everywhere in it. A very long text is one row, cut in linear time. An empty table
    gives an empty table. Columns of ``docs`` named like the new ones are replaced, others keep their names.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    safe = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(own)}
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    over = pin(frequent(rows, min_points, min_docs), "lines")
    gone = dropped_lines(rows, over, min_points).select(F.col("id").alias("gone_id"), F.col("version").alias("gone_version"), "dropped")
    whole = docs.select(F.xxhash64(text).alias("version"), F.col("doc_id").alias("id"), text.alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in safe.items() if c != "text"])
    joined = whole.join(gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left")
    stays = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("dropped")))
    n_lines = F.size(_lines(F.col("text"))).cast("long")
    return joined.select(*[(stays if c == "text" else F.col(n)).alias(c) for c, n in safe.items()], n_lines.alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, whole texts; the digest is that of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
