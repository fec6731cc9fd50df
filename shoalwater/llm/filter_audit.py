"""What each filter of a chain removes, in every order of the chain, from a document-term matrix.

The matrix is sparse and global: a task cuts its documents into shards, counts each document's words
under local numbers and keeps them as one CSR block a shard. The shards' distinct words (not the
words of documents) are shuffled once to be numbered by one dictionary, and every shard's columns are
renumbered by it where the two meet. Row sums are the words of a document, nonzero counts its distinct words; they decide the
filters A and B. C and D come from the same pass over the text, E from the smallest id of each text.
What is left are counts of documents by part and by the set of filters that fail, at most 128 for each
part, from which all 120 orders follow.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import pin, release, table

#: The filters; words that A asks for; B's and C's percentages; D's characters.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3
SPECIAL = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text and documents in a shard, about; a longer document is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 16_000_000, 20_000
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Bits of a word's hash that number its cell of the dictionary, and bits of its rank there.
CELL_BITS, RANK_BITS = 16, 40

_SIDE = "shard long, id array<long>, part array<string>, points array<long>, upper array<long>, special array<boolean>, sha array<binary>, indptr array<long>, columns binary, counts binary"
_TYPES = pa.schema([("shard", pa.int64()), ("id", pa.list_(pa.int64())), ("part", pa.list_(pa.string())), ("points", pa.list_(pa.int64())), ("upper", pa.list_(pa.int64())), ("special", pa.list_(pa.bool_())), ("sha", pa.list_(pa.binary())), ("indptr", pa.list_(pa.int64())), ("columns", pa.binary()), ("counts", pa.binary())])


def count_words(text: bytes) -> Counter:
    """Times of each word, `[^\\x20\\x09-\\x0D]+`: what ``bytes.split`` gives. Cut piece by piece, never within a word."""
    if len(text) <= PIECE:
        return Counter(text.split())
    found, at = Counter(), 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        while stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        found.update(text[at:stop].split())
        at = stop
    return found


def planes(values: np.ndarray) -> bytes:
    """int32 values byte by byte: all lowest bytes first. Small values then compress well wherever they are stored."""
    return values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(code: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(code, np.uint8).reshape(4, -1).T).view("<i4").ravel()


class _Shard:
    """Documents of one shard: their side columns, local dictionary and CSR arrays."""

    def __init__(self):
        self.index, self.side, self.indptr, self.columns, self.counts, self.bytes = {}, [], [0], [], [], 0

    def add(self, doc_id, part, points: int, text: bytes) -> None:
        found, index = count_words(text), self.index
        columns = np.fromiter((index.setdefault(w, len(index)) for w in found), np.int32, len(found))
        order = np.argsort(columns)
        self.columns.append(columns[order])
        self.counts.append(np.fromiter(found.values(), np.int32, len(found))[order])
        self.indptr.append(self.indptr[-1] + len(found))
        upper = len(text) - len(text.translate(None, UPPER))
        special = len(text.translate(None, SPECIAL)) < len(text)
        self.side.append((doc_id, part, points, upper, special, hashlib.sha256(text).digest()))
        self.bytes += len(text)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.side) >= SHARD_DOCS

    def row(self, number: int) -> dict:
        ids, parts, points, upper, special, sha = zip(*self.side)
        steps = np.diff(np.concatenate([np.zeros(1, np.int32), *self.columns]))
        return {"shard": number, "id": ids, "part": parts, "points": points, "upper": upper, "special": special, "sha": sha, "indptr": self.indptr, "columns": planes(steps), "counts": planes(np.concatenate(self.counts)), "words": pa.array(list(self.index), pa.binary()).cast(pa.string())}


def local_shards(docs: DataFrame) -> DataFrame:
    """CSR blocks under local word numbers, with each shard's own dictionary. The caller pins them.

    ``columns`` are the steps from each number to the next, ascending within a document; these and ``counts`` are byte planes.
    """
    types = _TYPES.append(pa.field("words", pa.list_(pa.string())))

    def batch_of(shard: _Shard, task: pa.Scalar, number: int) -> pa.RecordBatch:
        row = shard.row((task.as_py() << 32) + number)
        words = pa.ListArray.from_arrays(pa.array([0, len(row["words"])], pa.int32()), row["words"])
        return pa.RecordBatch.from_arrays([*(pa.array([row[f.name]], f.type) for f in _TYPES), words], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, done = _Shard(), 0
        for batch in batches:
            for task, doc_id, part, points, text in zip(*(batch.column(i) for i in range(5))):
                now.add(doc_id.as_py(), part.as_py(), points.as_py(), text.as_py())
                if now.full():
                    yield batch_of(now, task, done)
                    now, done = _Shard(), done + 1
        if now.side:
            yield batch_of(now, task, done)

    text = F.coalesce(F.col("text"), F.lit(""))
    lean = docs.select(F.spark_partition_id().cast("long").alias("task"), F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.length(text).cast("long").alias("points"), text.cast("binary").alias("text"))
    return lean.mapInArrow(run, _SIDE + ", words array<string>")


def numbered(shards: DataFrame) -> DataFrame:
    """word, column, shard, local: the global number of every word of every shard.

    The words are shuffled once, by a cell of their hash; a word's column is its cell and its rank among the cell's
    distinct words. That depends on the words alone: any task that runs again gives the same numbers.
    """
    uses = shards.select("shard", F.posexplode("words").alias("local", "word")).withColumn("cell", F.xxhash64("word").bitwiseAND((1 << CELL_BITS) - 1))
    rank = F.dense_rank().over(W.partitionBy("cell").orderBy("word")).cast("long") - 1
    return uses.select("word", (F.shiftleft("cell", RANK_BITS) + rank).alias("column"), "shard", "local")


def _renumbered(shard, numbers) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a shard's row under the dictionary's numbers, and their counts."""
    to = np.zeros(numbers.num_rows, np.int64)
    to[numbers["local"].to_numpy()] = numbers["column"].to_numpy()
    return to[np.cumsum(from_planes(shard["columns"][0].as_py()), dtype=np.int64)], from_planes(shard["counts"][0].as_py())


def _matrix_row(shard, numbers):
    columns, counts = _renumbered(shard, numbers)
    new = {"columns": pa.array([columns.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())}
    return pa.table({n: new.get(n, shard[n]) for n in _TYPES.names})


def _row_sums(shard, numbers):
    """The shard's rows summed: ``words``, the sums of the counts, and ``distinct``, the numbers of columns that are not zero."""
    columns, counts = _renumbered(shard, numbers)
    indptr = shard["indptr"][0].values.to_numpy()
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))
    used = np.concatenate((np.zeros(1, np.int64), np.cumsum(columns >= 0, dtype=np.int64)))
    both = {"words": sums[indptr[1:]] - sums[indptr[:-1]], "distinct": used[indptr[1:]] - used[indptr[:-1]]}
    return pa.table({**{n: shard[n] for n in _ROW}, **{k: pa.array([v], pa.list_(pa.int64())) for k, v in both.items()}})


#: The side columns of a shard's documents.
_ROW = ("id", "part", "points", "upper", "special", "sha")


def _meet(docs: DataFrame, give, schema: str) -> tuple[DataFrame, DataFrame]:
    """Each shard with the global numbers of its words, as ``give`` turns them into a row; and the uses of words."""
    local = pin(local_shards(docs), "shards")
    uses = numbered(local)
    both = local.drop("words").groupBy("shard").cogroup(uses.select("shard", "local", "column").groupBy("shard"))
    return both.applyInArrow(lambda shard, numbers: give(shard, numbers), schema), uses


def term_matrix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix as CSR shards, and its dictionary (word, column).

    A shard is one row: the side columns of its documents in row order, ``indptr``, and ``columns`` (int64) and
    ``counts`` (int32) as little-endian bytes. A column occurs once at most in a row.
    """
    matrix, uses = _meet(docs, _matrix_row, _SIDE)
    return matrix, uses.select("word", "column").distinct()


def failures(docs: DataFrame) -> DataFrame:
    """A row per document: id, part, sha, and fails, one bit each for A, B, C and D (1, 2, 4, 8)."""
    sums, _ = _meet(docs, _row_sums, "id array<long>, part array<string>, points array<long>, upper array<long>, special array<boolean>, sha array<binary>, words array<long>, distinct array<long>")
    row = sums.select(F.inline(F.arrays_zip(*_ROW, "words", "distinct")))
    bits = (F.col("words") < MIN_WORDS, 100 * F.col("distinct") < MIN_DISTINCT * F.col("words"), 100 * F.col("upper") > MAX_UPPER * F.col("points"), F.col("special"))
    return row.select("id", "part", "sha", sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0)).alias("fails"))


def patterns(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents by part, by the set of filters that fail (``fails``, E is 16), and by label.

    Documents of one text are counted by (text, part, labels) before they meet, so a group of copies
    with a third of all rows sends a few rows from each task.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failed.groupBy("id", "part", "sha", "fails").agg(F.count(F.lit(1)).alias("n")).join(marks.hint("merge"), "id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # of each (text, part, labels): all rows, rows without an id, and the rows of the smallest id
    kinds = rows.groupBy("sha", "part", "good", "toxic", "fails").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("low"))
    first = F.min("low.id").over(W.partitionBy("sha"))
    clear = F.col("no_id") + F.when(F.col("low.id") == first, F.col("low.n")).otherwise(F.lit(0))
    split = kinds.withColumn("clear", clear)
    both = split.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("fails"), F.col("clear").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("clear")).alias("n")))).alias("x"))
    return both.groupBy("part", "good", "toxic", "x.fails").agg(F.sum("x.n").alias("n"))


def orders(counts: DataFrame) -> DataFrame:
    """The audit from the counts of ``patterns``: a row per part, order of the filters and step."""
    every = ",".join("".join(p) for p in itertools.permutations(FILTERS))
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(every), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("own", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)"))
    steps = steps.withColumn("before", F.expr("aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (m, c) -> m + shiftleft(1, ascii(c) - 65))"))
    hit, earlier = F.col("fails").bitwiseAND(F.col("own")) > 0, F.col("fails").bitwiseAND(F.col("before")) > 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0))).cast("long")
    out = steps.groupBy("part", "filter_order", "step").agg(
        total(~hit & ~earlier).alias("kept"),
        total(hit & ~earlier).alias("removed"),
        total(hit & earlier).alias("redundant"),
        total(F.col("fails") == F.col("own")).alias("unique_fails"),
        total(hit & ~earlier & F.col("good")).alias("good_lost"),
        total(hit & ~earlier & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", letter)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the filters A to E remove at each step of all 120 orders, within each part.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality, toxic. Other columns are not read. A part is
    a lang value; null and empty lang are the part ''. Null and empty texts are the same text without
    words: they fail A alone, and E where a smaller id holds one. Each row is a document; equal rows, and
    rows of one id, are not smaller than each other, so E fails none of them for another; a row without an id is
    never smaller nor larger. Repeated labels of an id count where one of them is set; labels without an id match nothing. Very long texts
    are read piece by piece. No documents give no rows.
    """
    return orders(pin(patterns(failures(docs), labels), "patterns"))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
b AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(x, '[A-Z]')) > 3 * length(x))::INT
  + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS fails
  FROM w LEFT JOIN g USING (doc_id)),
p AS (SELECT part, good, toxic, fails, count(*) AS n FROM b GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS own, list_sum([0] || [1 << (ascii(filter_order[j]) - 65) for j in range(1, step)])::BIGINT AS before FROM o, unnest(range(1, 6)) AS u(step)),
r AS (SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (fails & (own | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (fails & own > 0 AND fails & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails & own > 0 AND fails & before > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (fails & own > 0 AND fails & before = 0 AND good = 1), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (fails & own > 0 AND fails & before = 0 AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM p, s GROUP BY part, filter_order, step)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM r
"""
