"""Shared pieces: words, their hashes, training rows, and what a worker keeps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import components, repeated_ids  # noqa: F401  (re-exported)
from ..session import new_path, pin, shared_dir  # noqa: F401  (re-exported)

#: The contract's white space, `[\x20\x09-\x0D]`, and its complement, a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text) -> F.Column:
    """Number of words of a text column, 0 for null. JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_of_id(column="doc_id") -> F.Column:
    """crc32 of an id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def is_training(column="doc_id") -> F.Column:
    return (crc32_of_id(column) % 3) != 1


def hash_bound(wanted: int, n: int) -> int:
    """The 64-bit hash that about ``wanted`` of ``n`` rows do not exceed; all, where there are no more."""
    return min(2**63 - 1, -(2**63) + wanted * 2**64 // max(1, n))


# ------------------------------------------------------------------ what a Python worker keeps

_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """The one object that a Python worker keeps from task to task: asking for another lets it go.

    Workers are used again by later stages, so what several operators kept would add up.
    """
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of what an earlier stage's tasks left in this worker."""
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()


# ------------------------------------------------------------------ hashing of words in numpy

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 step), elementwise."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))
#: Bytes that are hashed at once: the memory that a very long text takes stays near that of its words.
WINDOW = 1 << 20
_POWERS = np.full(WINDOW + 1, _ODD, dtype=np.uint64)
_BACK = np.full(WINDOW + 1, _INVERSE, dtype=np.uint64)
_POWERS[0] = _BACK[0] = 1
_POWERS, _BACK = np.multiply.accumulate(_POWERS), np.multiply.accumulate(_BACK)


class Words:
    """The words of several texts in one byte buffer: start, end and text number of each."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.concatenate(([~gap[:1].all()], gap[1:] != gap[:-1], [len(data) > 0 and not gap[-1]])))
        self.data, self.start, self.end = data, edge[0::2], edge[1::2]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(bounds, self.start, side="right")
        #: first word of each text, and one past the last of all
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: sums of byte codes times powers, then mixed.

        Window by window; a word that crosses windows has its parts' sums added.
        """
        h = np.zeros(len(self.start), np.uint64)
        for at in range(0, len(self.data), WINDOW):
            stop = min(len(self.data), at + WINDOW)
            first, last = np.searchsorted(self.end, at, side="right"), np.searchsorted(self.start, stop)
            if first == last:
                continue
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data[at:stop]] * _POWERS[: stop - at], dtype=np.uint64)))
            a, z = np.maximum(self.start[first:last], at) - at, np.minimum(self.end[first:last], stop) - at
            part = (sums[z] - sums[a]) * _BACK[a]
            if self.start[first] < at:  # its bytes before this window count first
                part[:1] *= np.uint64(pow(int(_ODD), int(at - self.start[first]), 2**64))
            h[first:last] += part
        return mix(h ^ ((self.end - self.start).astype(np.uint64) * _ODD))


def blocks_of(texts: list, limit: int = 1_000_000):
    """Cut a list of byte texts into runs of about ``limit`` bytes: pairs of first and last index."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
