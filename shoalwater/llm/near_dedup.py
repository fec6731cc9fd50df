"""MinHash near-dedup with odd sketches.

Every distinct shingle set gets ``SAMPLES`` MinHash samples. Bands of samples give buckets
of candidates; the samples folded into a parity bitmap (odd sketch) give the candidates'
similarity by the population count of an XOR, far more precisely near 1 than in between; pairs
that the sketch does not rule out are confirmed on the full sets.

Copies are one class before anything is compared. In a bucket each class is compared with a
hub, not with every other; after the links found so far are joined to components, only pairs of
*different* components that still share a bucket are looked at, all of them: a bucket is dealt to
spans, and two spans at a time meet. No link between different components is lost, and a large
group of near copies costs about one comparison a member and bucket. Only a bucket of very many
classes that its hub does not link costs the square of their number, in comparisons, not in rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Words, blocks_of, components, mix, pin, release, repeated_ids, table

#: Fixed values of the contract: words of a shingle, least similarity in percent.
WIDTH = 5
PERCENT = 85
#: A pair of similarity 0.85 shares no bucket once in four million times: (1 - .85**6) ** 32.
BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: How far under the least similarity an estimate may be: about 5.5 standard deviations.
MARGIN = 0.15
#: Bits of the whole set's parity bitmap.
PARITY_BITS = 1024
#: Classes of a bucket that meet as many others under one key of the join, about.
SPAN = 4096

_rng = np.random.default_rng(85)
_MUL = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_TAG = mix(np.arange(1, SAMPLES + BANDS + WIDTH + 2, dtype=np.uint64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes.

    A-Z lower-cased; fewer words than ``width``: the whole sequence as one shingle, tagged with
    its length; no words: an empty set.
    """
    w = Words([t.lower() for t in texts])
    h = w.hashes()
    n = np.diff(w.first)
    full = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        full = full * _STEP + h[j : j + len(full)]
    full = mix(full)
    sets = []
    for i, start in enumerate(w.first[:-1]):
        if n[i] >= width:
            sets.append(np.unique(full[start : start + n[i] - width + 1]))
        elif n[i]:
            one = np.zeros(1, np.uint64)
            for x in h[start : start + n[i]]:
                one = one * _STEP + x
            sets.append(mix(one ^ _TAG[SAMPLES + BANDS + n[i]]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _parities(rows: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bitmaps, as rows of 64-bit words, of the positions that occur an odd number of times."""
    odd = (np.bincount(rows * bits + at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For non-empty sets: class hash (n, 2), band keys (n, BANDS), odd sketches of the samples and parity bitmaps of the sets (words of 64 bits)."""
    every, first = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
    ident = np.stack([np.add.reduceat(mix(every), first), np.add.reduceat(mix(every ^ _STEP), first)], axis=1)
    low = (every >> np.uint64(32)).astype(np.uint32)
    samples = np.empty((len(sets), SAMPLES), np.uint32)
    for i in range(SAMPLES):
        samples[:, i] = np.minimum.reduceat(low * _MUL[i] + _ADD[i], first)
    wide = samples.astype(np.uint64)
    keys = np.zeros((len(sets), BANDS), np.uint64) + _TAG[SAMPLES : SAMPLES + BANDS]
    for j in range(ROWS):
        keys = mix(keys * _STEP + wide[:, j::ROWS])
    at = (mix(wide ^ _TAG[:SAMPLES]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    n = len(sets)
    sketch = _parities(np.repeat(np.arange(n), SAMPLES), at.ravel(), n, SKETCH_BITS)
    parity = _parities(np.repeat(np.arange(n), [len(s) for s in sets]), (every % np.uint64(PARITY_BITS)).astype(np.int64), n, PARITY_BITS)
    return ident.view(np.int64), keys.view(np.int64), sketch, parity


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k), pa.int32()), pa.array(values.ravel()))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, c1, c2 (the set's class), bands, sketch, parity; nulls where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            texts = b.column(1).to_pylist()
            for a, z in blocks_of(texts):
                sets = shingle_sets(texts[a:z])
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                ids = b.column(0).slice(a, z - a)
                if len(some):
                    ident, keys, sketch, parity = signatures([sets[i] for i in some])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(sizes[some]), pa.array(ident[:, 0].copy()), pa.array(ident[:, 1].copy()), _lists(keys), _lists(sketch), _lists(parity)], names=names)
                if len(some) < len(sets):
                    none = np.flatnonzero(sizes == 0)
                    n = len(none)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(none)), pa.array(sizes[none]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.list_(pa.int64()))] * 3], names=names)

    names = ["doc_id", "n_shingles", "c1", "c2", "bands", "sketch", "parity"]
    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>, sketch array<long>, parity array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))


def full_sets(docs: DataFrame) -> DataFrame:
    """id, shingles (sorted distinct hashes) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            texts = b.column(1).to_pylist()
            for a, z in blocks_of(texts):
                sets = shingle_sets(texts[a:z])
                offsets = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "shingles"])

    return _texts(docs).mapInArrow(run, "id long, shingles array<long>")


def largest_distance(similarity: float) -> int:
    """Most differing sketch bits of a pair that may have this similarity, by the estimator's inverse."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


def _marks(prefix: str) -> list[Column]:
    """A class's size, sketch and parity words as columns of their own: comparing them is plain compiled arithmetic."""
    words = [F.col(name)[i].alias(f"{prefix}_{name}{i}") for name, bits in (("sketch", SKETCH_BITS), ("parity", PARITY_BITS)) for i in range(bits // 64)]
    return [F.col("n").alias(f"{prefix}_n"), *words]


def _mark_names(prefix: str) -> list[str]:
    return [f"{prefix}_n", *(f"{prefix}_{name}{i}" for name, bits in (("sketch", SKETCH_BITS), ("parity", PARITY_BITS)) for i in range(bits // 64))]


def _possible(x: str, y: str, percent: int) -> Column:
    """May two classes, by their marks, be a link? By set sizes, sketch and parity bitmap.

    Sets of a and b shingles that differ in d have similarity (a + b - d) / (a + b + d); no
    more bits of the bitmaps differ than shingles do.
    """
    distance = lambda name, bits: sum((F.bit_count(F.col(f"{x}_{name}{i}").bitwiseXOR(F.col(f"{y}_{name}{i}"))) for i in range(bits // 64)), F.lit(0))
    a, b = F.col(f"{x}_n"), F.col(f"{y}_n")
    sizes = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    bound = distance("parity", PARITY_BITS) * (100 + percent) <= (a + b) * (100 - percent)
    return sizes & bound & (distance("sketch", SKETCH_BITS) <= largest_distance(percent / 100 - MARGIN))


def _marked(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that their marks do not rule out."""
    side = lambda c: classes.select(F.col("id").alias(c), *_marks(c))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_possible("a", "b", percent)).select("a", "b").distinct()


def _different(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members of different components that their marks do not rule out.

    ``rows``: key, id, component, bucket_n and marks. A bucket is dealt to spans of about ``SPAN`` members; two
    spans meet in one key of the join, and what the marks rule out is not even a row of it.
    """
    spans = F.ceil(F.col("bucket_n") / SPAN).cast("int")
    dealt = rows.withColumn("spans", spans).withColumn("span", F.pmod(F.xxhash64("id", "key"), F.col("spans")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("spans") - 1))).withColumn("i", F.least("span", "other")).withColumn("j", F.greatest("span", "other"))
    left = met.where("span = i").select("key", "i", "j", "id", "component", *_mark_names("own"))
    right = met.where("span = j").select("key", "i", "j", F.col("id").alias("hub"), F.col("component").alias("hub_component"), *[F.col(f"own{n[3:]}").alias(n) for n in _mark_names("hub")])
    pairs = left.join(right, ["key", "i", "j"]).where("component <> hub_component AND (i < j OR id < hub)").where(_possible("own", "hub", percent))
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _confirmed(near: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links by their full sets."""
    near = pin(near, "near")
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = pin(full_sets(docs.join(ids, docs["doc_id"].cast("long") == ids["doc_id"], "left_semi")), "sets")
    left = near.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b").distinct()


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and wordless texts have an empty set and are linked with nothing. Texts of any length are taken whole, as
    shingle hashes of one row. Rows of equal doc_id are one node, repeated rows each keep their row; rows with a null
    doc_id are linked with nothing. Of equal sets the smallest doc_id stands for all. An empty table gives an empty one; other
    columns are not read, whatever their names.
    """
    marks = pin(signed(docs), "signatures")
    known = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = pin(known.groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity")), "classes")

    buckets = classes.select(F.explode("bands").alias("key"), "id")
    shared = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    rows = pin(buckets.join(shared, "key").where("id <> hub"), "buckets")
    pairs = rows.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    twice = repeated_ids(known.select("doc_id", "c1", "c2").join(classes.select("c1", "c2", "id"), ["c1", "c2"]).select(F.col("doc_id").alias("node"), "id"))
    found = components(_confirmed(_marked(pairs, classes, percent), docs, percent).union(twice))
    where = rows.select("key", "id").join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = where.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("bucket_n")).where("low < high").select("key", "bucket_n")
    rest = pin(where.join(mixed, "key").join(classes.select("id", *_marks("own")), "id"), "mixed")
    near = _different(rest, percent)
    more = pin(_confirmed(near, docs, percent), "links")
    if not more.isEmpty():
        found = components(more.union(found.where("node <> component")))

    roots = classes.select("c1", "c2", "id").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("c1", "c2", F.coalesce("component", "id").alias("root"))
    out = marks.select("doc_id", "n_shingles", "c1", "c2").join(roots, ["c1", "c2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keepers(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows of one doc_id stay or go together."""
    gone = groups(docs, percent).where("NOT kept").select(F.col("doc_id").alias("_id")).distinct().hint("merge")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_id"], "left_anti")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
