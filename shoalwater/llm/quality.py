"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are hashed words and word shapes (case, final character, repetition of the
word before, length). A bounded sample of labelled training documents gives the
term weights, the latent space (a truncated SVD) and the labelled vectors; these are broadcast
and every document's cosines with all of them are computed in blocks. The nearest vote with
their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, blocks_of, crc32_of_id, hash_bound, is_training, table

#: Bound of the labelled sample; rows are chosen by a hash of their id.
SAMPLE = 4000
TERMS, SHAPES, RANK, NEIGHBOURS = 4096, 512, 48, 15
#: Weight of hashed words beside shapes: words mostly tell languages apart.
WORD_WEIGHT = 0.3
BLOCK = 256

_CLASS = np.full(256, 5, np.uint8)  # of a byte: 0 lower, 1 upper, 2 digit, 3 full stop or comma, 4 a sign, 5 beyond ASCII
_CLASS[33:127] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[44, 46]] = 3


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of the terms of each text, (texts, TERMS). Whole texts."""
    w = Words(texts)
    n = len(w.start)
    if not n:
        return np.zeros((len(texts), TERMS), np.float32)
    h = w.hashes()
    kind = _CLASS[w.data]
    long_ = np.minimum(w.end - w.start, 255)
    upper = np.concatenate(([0], np.cumsum(kind == 1, dtype=np.int32)))
    uppers = upper[w.end] - upper[w.start]
    first, last = kind[w.start], kind[w.end - 1]
    before = kind[np.maximum(w.start, w.end - 2)]
    repeat = np.zeros(n, np.int64)
    repeat[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    case = np.where(uppers >= np.maximum(2, long_ // 2), 2, np.where(first == 1, 1, 0))
    tail = np.where(last == 4, np.where(long_ == 1, 3, np.where(before == 4, 2, 1)), np.where(last == 3, 4, np.where(last == 2, 5, 0)))
    size = np.searchsorted([2, 5, 10, 20], long_)
    shape = ((case * 6 + tail) * 5 + size) * 2 + repeat
    word = SHAPES + (h % np.uint64(TERMS - SHAPES)).astype(np.int64)
    at = w.text * TERMS
    return np.bincount(np.concatenate((at + shape, at + word)), minlength=len(texts) * TERMS).reshape(len(texts), TERMS).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, idf-weighted terms; shapes and words are each of length 1 before their weights."""
    x = np.log1p(counts) * idf
    for part, weight in ((x[:, :SHAPES], 1.0), (x[:, SHAPES:], WORD_WEIGHT)):
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


class Voter:
    """Term weights, latent space and labelled vectors, all of bounded size."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        x = weighted(counts, self.idf)
        basis = np.random.default_rng(3).standard_normal((TERMS, RANK + 16)).astype(np.float32)
        for _ in range(3):  # subspace iteration towards the leading right singular vectors
            basis = np.linalg.qr(x.T @ (x @ basis))[0] if len(x) else np.linalg.qr(basis)[0]
        if len(x):
            basis = basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T
        self.space = np.ascontiguousarray(basis[:, :RANK])
        self.pool = self._latent(x)

    def _latent(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.space
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; without any, the labels' mean."""
        if not len(self.pool):
            return np.full(len(texts), self.prior)
        cos = self._latent(weighted(term_counts(texts), self.idf)) @ self.pool.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(cos, cos.shape[1] - k, axis=1)[:, -k:]
        w = np.maximum(np.take_along_axis(cos, near, axis=1), 0.0).astype(np.float64) ** 8
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), self.prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, label of the ``sample`` labelled training rows with the smallest hash of the id."""
    marked = labels.where(F.col("quality").isNotNull() & is_training()).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label"))
    near = marked.where(F.xxhash64("_id") <= hash_bound(2 * sample, marked.count()))
    chosen = near.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select(F.coalesce("text", F.lit("")).cast("binary").alias("t"), F.col("_label").cast("double").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Voter:
    """Terms are counted where the texts are; only the sample's sparse counts reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            counts = [term_counts([t])[0] for t in texts]
            rows = [np.flatnonzero(c) for c in counts]
            values = [c[r] for c, r in zip(counts, rows)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["label", "term", "n"])

    got = labelled_sample(docs, labels, sample).mapInArrow(counted, "label double, term array<int>, n array<float>").collect()
    got.sort(key=lambda r: (r["term"], r["n"], r["label"]))  # reruns agree to the last bit
    counts = np.zeros((len(got), TERMS), np.float32)
    for row, r in zip(counts, got):
        row[r["term"]] = r["n"]
    return Voter(counts, np.array([r["label"] for r in got]))


def score(docs: DataFrame, voter: Voter) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts get the labels' mean.

    Whole texts of any length; repeated rows give repeated results; neighbours that tie at the last
    place are chosen by their float32 cosines, whose last bit may depend on the block, so only such ties can differ. An empty
    table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for a, z in blocks_of(texts):
                for i in range(a, z, BLOCK):
                    part = texts[i : min(z, i + BLOCK)]
                    s = np.clip(voter.scores(part), 0.0, 1.0)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), b.column(2).slice(i, len(part)), pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"), (crc32_of_id() % 3 == 1).alias("held_out"))
    return lean.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
