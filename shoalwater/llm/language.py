"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability is
the sum over all its segmentations into pieces, by the forward recursion; pieces do not
cross white space, so a text's is the product over its words, and a worker computes a
frequent word once. The language with the largest probability wins.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import blocks_of, crc32_of_id, hash_bound, held, is_training, mix, table

VOCABULARY = "piece_bpe_32k.model"
#: Training documents of a language at most; those with the smallest hash of the id.
SAMPLE = 800
#: Words of up to so many bytes, start mark included, keep all their forward sums; longer ones the last few, rescaled.
SHORT = 40
#: Long words taken together, starts whose pieces are looked up at once, and steps between rescalings.
TOGETHER, AHEAD, RESCALE = 128, 256, 8
#: Probability of a byte that no piece covers, and what is added to every piece's count.
UNKNOWN, SMOOTH = 1e-6, 0.05
#: Words that a Python worker keeps, and about how many bytes of text it scores together.
KEPT_WORDS, TOGETHER_BYTES = 150_000, 2_000_000
UNDETERMINED = "und"

_START = b"\x01"  # stands for the vocabulary's mark of a word's start
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODE = mix(np.arange(1, 257, dtype=np.uint64))


def model_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _vocabulary(path: str) -> dict[int, bytes]:
    """The pieces that stand for text, by id: no control, unknown or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return {i: sp.id_to_piece(i).replace("▁", "\x01").encode() for i in text}


def _hash(piece: bytes) -> int:
    h = np.zeros(1, np.uint64)
    for c in piece:
        h = h * _BASE + _CODE[c]
    return int(h[0])


class Unigrams:
    """Piece probabilities by language, and the forward recursion over many words at once."""

    def __init__(self, pieces: list[bytes], languages: list[str], counts: np.ndarray):
        p = counts + SMOOTH
        self.languages, self.p = languages, p / p.sum(axis=0, keepdims=True)
        self.longest = max(map(len, pieces))
        self.name = (tuple(languages), len(pieces), zlib.crc32(self.p.tobytes()))
        hashes = np.array([_hash(x) for x in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.piece = hashes[order], order.astype(np.int32)
        # where to begin in the sorted hashes, by their leading bits
        self.shift = np.uint64(64 - 20)
        self.slot = np.searchsorted(self.hashes, np.arange(1 << 20, dtype=np.uint64) << self.shift).astype(np.int32)
        self.deepest = int(np.bincount((self.hashes >> self.shift).astype(np.int64)).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each substring hash, or -1."""
        at, out = self.slot[(h >> self.shift).astype(np.int64)], np.full(len(h), -1, np.int32)
        last = len(self.hashes) - 1
        for step in range(self.deepest):  # as many hashes as share their leading bits
            here = np.minimum(at + step, last)
            hit = self.hashes[here] == h
            out[hit] = self.piece[here[hit]]
        return out

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """(words, languages): the log of the sum over all segmentations."""
        raw = [_START + w.encode("utf-8", "replace") for w in words]
        out = np.zeros((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for k, c in enumerate(raw):
            by_length.setdefault(len(c), []).append(k)
        for n, members in by_length.items():
            for a in range(0, len(members) if n <= SHORT else 0, 20_000):
                own = members[a : a + 20_000]
                codes = _CODE[np.frombuffer(b"".join([raw[k] for k in own]), np.uint8).reshape(len(own), n)]
                out[own] = np.log(self._forward(codes))
        long = sorted((k for k, c in enumerate(raw) if len(c) > SHORT), key=lambda k: len(raw[k]))
        for a in range(0, len(long), TOGETHER):
            out[long[a : a + TOGETHER]] = self._log_forward([raw[k] for k in long[a : a + TOGETHER]])
        return out

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        m, n = codes.shape
        alpha = np.zeros((n + 1, m, len(self.languages)))
        alpha[0] = 1.0
        for i in range(n):
            h = np.zeros(m, np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = h * _BASE + codes[:, j]
                piece = self.find(h)
                hit = np.flatnonzero(piece >= 0)
                alpha[j + 1, hit] += alpha[i, hit] * self.p[piece[hit]]
                if j == i:
                    miss = np.flatnonzero(piece < 0)
                    alpha[j + 1, miss] += alpha[i, miss] * UNKNOWN
        return alpha[n]

    def _log_forward(self, words: list[bytes]) -> np.ndarray:
        """The log of the forward sum over whole words of any length, sorted by length, in bounded memory.

        ``sums[k]`` belongs to the place k bytes on; a word's own is read where it ends, so what
        the shorter ones find behind their end does not count.
        """
        p = np.concatenate((self.p, np.zeros((1, self.p.shape[1]))))  # the last row, -1, is no piece
        out = np.zeros((len(words), p.shape[1]))
        ends = np.array([len(w) for w in words])
        first, at = 0, 0
        sums, scale = np.zeros((self.longest + 1, *out.shape)), np.zeros_like(out)
        sums[0] = 1.0
        while first < len(words):
            codes = _CODE[np.frombuffer(b"".join([w[at : at + AHEAD + self.longest].ljust(AHEAD + self.longest, b"\0") for w in words[first:]]), np.uint8).reshape(len(words) - first, -1)]
            h = np.zeros((len(words) - first, AHEAD), np.uint64)
            piece = np.empty((AHEAD, self.longest, len(words) - first), np.int32)
            for j in range(self.longest):
                h = h * _BASE + codes[:, j : j + AHEAD]
                piece[:, j] = self.find(h.ravel()).reshape(h.shape).T
            began = first
            for i in range(AHEAD):
                while first < len(words) and ends[first] == at + i:
                    out[first] = np.log(sums[0, first]) + scale[first]
                    first += 1
                if first == len(words):
                    return out
                live = piece[i, :, first - began :]
                here = sums[0, first:].copy()
                sums[1:, first:] += here * p[live]
                sums[1, first:][live[0] < 0] += UNKNOWN * here[live[0] < 0]
                sums[:-1] = sums[1:]
                sums[-1] = 0.0
                if i % RESCALE == 0:
                    top = sums[:, first:].max(axis=0)
                    sums[:, first:] /= top
                    scale[first:] += np.log(top)
            at += AHEAD
        return out


class Scorer:
    """Log probabilities of whole texts; the first ``KEPT_WORDS`` words that were seen are not segmented again."""

    def __init__(self, model: Unigrams):
        self.model, self.known = model, {}
        self.table = np.zeros((0, len(model.languages)))

    def scores(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        new = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in self.known]
        found = self.model.log_probabilities(new)
        first = len(self.known)
        table = np.concatenate((self.table[:first], found))
        stay = new[: max(0, KEPT_WORDS - first)]
        if len(stay) + first > len(self.table):
            self.table = np.concatenate((table[: first + len(stay)], np.zeros((min(first + len(stay), KEPT_WORDS - first - len(stay)), table.shape[1]))))
        else:
            self.table[first : first + len(stay)] = found[: len(stay)]
        self.known.update(zip(stay, range(first, first + len(stay))))
        rest = dict(zip(new[len(stay) :], range(first + len(stay), len(table))))
        out = np.zeros((len(texts), table.shape[1]))
        for i, ws in enumerate(words):
            if ws:
                rows = map(self.known.__getitem__, ws) if not rest else (rest[w] if w in rest else self.known[w] for w in ws)
                out[i] = table[np.fromiter(rows, np.int64, len(ws))].sum(axis=0)
        return out


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, text: the ``sample`` training documents of each language with the smallest hash of the id.

    A threshold on the 64-bit hash leaves about twice as many, so only those are ordered.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & is_training())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return rows.select("lang", "text").limit(0)
    most = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, hash_bound(2 * sample, n))])
    near = rows.withColumn("_hash", F.xxhash64("doc_id")).where(F.col("_hash") <= most[F.col("lang")])
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_hash", "doc_id", "text"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= sample).select("lang", "text")


def fit(docs: DataFrame, path: str, sample: int = SAMPLE) -> Unigrams:
    """Counts of pieces by language, from the vocabulary's own segmentation of the sample's words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found: Counter = Counter()
        for b in batches:
            for lang, part in b.groupby("lang"):
                words = Counter(w for t in part["text"] for w in t.lower().split())
                for ids, n in zip(sp.encode(list(words), num_threads=1), words.values()):
                    for i in ids:
                        found[lang, i] += n
        yield pd.DataFrame([(lang, i, n) for (lang, i), n in found.items()], columns=["lang", "piece", "n"])

    rows = training_sample(docs, sample).mapInPandas(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    pieces, languages = _vocabulary(path), sorted({r["lang"] for r in rows})
    at, column = {i: k for k, i in enumerate(pieces)}, {x: k for k, x in enumerate(languages)}
    counts = np.zeros((len(pieces), len(languages)))
    for r in rows:
        if r["piece"] in at:
            counts[at[r["piece"]], column[r["lang"]]] = r["n"]
    return Unigrams(list(pieces.values()), languages, counts)


def predict(docs: DataFrame, model: Unigrams, *keep: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, and the columns ``keep``.

    The score is the winner's posterior for equal priors; of tied languages the first by code
    point wins. Null, empty and letterless texts are ``und`` with score 0, as is every text where
    nothing could be learned. Whole texts of any length; repeated rows give repeated results; an empty
    table gives an empty one. Other columns than text, doc_id and ``keep`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("scorer", *model.name), lambda: Scorer(model)) if model.languages else None
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            some = [i for i, t in enumerate(texts) if scorer and any(map(str.isalpha, t))]
            langs: list[str] = [UNDETERMINED] * len(texts)
            scores = np.zeros(len(texts))
            for a, z in blocks_of([texts[i] for i in some], TOGETHER_BYTES):
                part = some[a:z]
                log_p = scorer.scores([texts[i] for i in part])
                best = log_p.argmax(axis=1)
                scores[part] = 1.0 / np.exp(log_p - log_p.max(axis=1, keepdims=True)).sum(axis=1)
                for i, k in zip(part, best):
                    langs[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs), pa.array(scores)], names=[*b.schema.names[1:], "lang_pred", "score"])

    lean = docs.select(F.col("text").alias("_text"), F.col("doc_id"), (crc32_of_id() % 3 == 1).alias("held_out"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema.fields[1:])
    return lean.mapInArrow(run, f"{fields}, lang_pred string, score double")


def keepers(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` whose language could be told, all columns; a null lang is filled with it."""
    own = docs.columns
    safe = [f"_c{i}" for i in range(len(own))]  # no column of the input can clash with a result's
    renamed = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in zip(own, safe)])
    told = predict(renamed, fit(docs, path), *safe).where(F.col("lang_pred") != UNDETERMINED)
    return told.select(*[F.coalesce(n, "lang_pred").alias(c) if c == "lang" else F.col(n).alias(c) for c, n in zip(own, safe)])


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, model_path())).select("doc_id", "held_out", "lang_pred", "score")
