"""Best-fit packing by exact-complement hashing.

Only the counts by length are planned (at most as many entries as a sequence has tokens):
the plan says which lengths share a sequence and how often. Pieces are ranked within their
length by distributed counts and look their place up by (length, rank).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import pin, table
from .tokens import encoder, texts_of, vocabulary_path

#: Tokens of a sequence, and the id that ends a document.
CAPACITY = 4096
END_ID = 1


class Plan:
    """Sequences for pieces given as counts by length.

    Longest piece first: its gap is looked up among single lengths, then pair sums, then triple
    sums of what is still there; a combination that fills the gap exactly is used as often as
    its counts allow. What then remains goes best fit, longest first, into the sequences with
    the smallest sufficient gap. ``places``: (length, first rank, how many, first sequence,
    offset): the k-th of these pieces is in sequence first + k at that offset.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, most: int = 3):
        self.capacity, self.sequences, self.most = capacity, 0, most
        self.places: list[tuple[int, int, int, int, int]] = []
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self._exact()
        self._best_fit()

    def _place(self, lengths: tuple[int, ...], times: int) -> None:
        at = 0
        for x in lengths:
            self.places.append((x, int(self.used[x]), times, self.sequences, at))
            self.used[x] += times
            self.left[x] -= times
            at += x
        self.sequences += times

    def _fill(self, longest: int, gap: int) -> tuple[int, ...] | None:
        """A single, pair or triple of remaining lengths (besides one ``longest``) that sums to the gap."""
        free = self.left.copy()
        free[longest] -= 1
        there = free[: gap + 1] > 0
        known = np.flatnonzero(there)
        if not len(known) or self.most * known[-1] < gap:
            return None
        if there[gap]:
            return (gap,)
        pair = self._pair(free, there, gap) if self.most > 1 else None
        if pair or self.most < 3:
            return pair
        for c in np.flatnonzero(there[: gap // 3 + 1])[::-1]:
            free[c] -= 1
            pair = self._pair(free, free[: gap - c + 1] > 0, gap - int(c), int(c))
            free[c] += 1
            if pair:
                return (*pair, int(c))
        return None

    @staticmethod
    def _pair(free: np.ndarray, there: np.ndarray, total: int, least: int = 1) -> tuple[int, int] | None:
        b = np.arange(least, total // 2 + 1)
        both = there[b] & there[total - b]
        if total % 2 == 0 and len(b) and b[-1] == total // 2:
            both[-1] = free[total // 2] > 1
        found = np.flatnonzero(both)
        return (int(total - b[found[-1]]), int(b[found[-1]])) if len(found) else None

    def _exact(self) -> None:
        full = int(self.left[self.capacity])
        if full:
            self._place((self.capacity,), full)
        for longest in range(self.capacity - 1, 0, -1):
            while self.left[longest]:
                rest = self._fill(longest, self.capacity - longest)
                if rest is None:
                    break
                need = Counter((longest, *rest))
                self._place((longest, *rest), int(min(self.left[x] // n for x, n in need.items())))

    def _best_fit(self) -> None:
        open_: dict[int, list[list]] = {}  # gap -> groups of alike sequences: first, how many
        gaps = np.zeros(self.capacity + 1, bool)
        for x in range(self.capacity - 1, 0, -1):
            n = int(self.left[x])
            while n:
                fits = np.flatnonzero(gaps[x:])
                if len(fits):
                    gap = x + int(fits[0])
                    group = open_[gap][-1]
                    first, times = group[0], min(n, group[1])
                    group[0] += times
                    group[1] -= times
                    if not group[1]:
                        open_[gap].pop()
                        gaps[gap] = bool(open_[gap])
                else:
                    gap, first = self.capacity, self.sequences
                    times = n if 2 * x > self.capacity else -(-n // (self.capacity // x))
                    self.sequences += times
                self.places.append((x, int(self.used[x]), times, first, self.capacity - gap))
                self.used[x] += times
                self.left[x] -= times
                n -= times
                if gap > x:
                    open_.setdefault(gap - x, []).append([first, times])
                    gaps[gap - x] = True


def plan_for(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences of those that fill gaps with up to three, two or one pieces exactly, or with none.

    A combination that fits exactly can use up pieces that longer ones need, so fewer of them are sometimes better. The
    result never has more sequences than best fit alone; on ties the plan with larger combinations stands, and one that
    meets the lower bound ends the search.
    """
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    best = None
    for most in (3, 2, 1, 0):
        plan = Plan(counts, capacity, most)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == bound:
            break
    return best


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; null text is an empty document."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = e.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                doc, k, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``lengths`` (with a column length, 1 to capacity) with sequence_id and offset added.

    The input is read several times: pin it first. The n rows of a length are dealt by a hash to
    about sqrt(n) groups, counted, and ranked within the group, so a length that many pieces
    share is no single task. Equal rows are interchangeable.
    """
    counted = lengths.groupBy("length").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in counted.collect()}  # at most `capacity` rows
    plan = plan_for(counts, capacity)
    places = np.array(sorted(plan.places), dtype=np.int64).reshape(-1, 5)

    own = lengths.columns
    split = F.floor(F.sqrt("_all")).cast("long")  # one row a length: at most `capacity`, so it is broadcast
    dealt = lengths.join(F.broadcast(counted.withColumnRenamed("n", "_all")), "length").withColumn("_group", F.pmod(F.xxhash64(*own), split)).select(*own, "_group")
    starts = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n")).withColumn("_start", F.sum("_n").over(W.partitionBy("length").orderBy("_group")) - F.col("_n")).drop("_n")
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_group").orderBy(*own)) - 1).join(starts, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_start"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = places[:, 0] * (1 << 40) + places[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(places[at, 3] + rank - places[at, 1]), pa.array(places[at, 4])], names=[*own, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lengths.schema)
    return ranked.select(*own, "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, whole texts; see ``pack_documents``."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id. A text of any length is cut into pieces of ``capacity`` tokens, the last
    one shorter; nothing is left out. Repeated rows are documents of their own, null ids are kept, and pieces of one length
    are interchangeable, so ties only decide which of them lies where. No documents give no rows. Other columns are not read.
    """
    return pack(pin(pieces(docs, path, capacity, end_id), "pieces"), capacity)
