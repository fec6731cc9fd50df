"""Exact dedup by an exchange of Golomb-coded fingerprints.

The task that reads a partition's texts sends its sorted distinct 64-bit fingerprints to the
fingerprints' owners as Golomb codes of their gaps, never as rows; an owner returns one bit
for each: does it occur more than once? The answers of a partition are one small file in the
shared folder, and the rows are marked where they lie. Only marked rows are suspects; their
texts alone are shuffled, grouped by their bytes. Grouping combines on the map side, so a group of
copies with a third of all rows sends one row from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, new_path, pin, table

#: Fixed value: bytes that do not count when texts are compared, `[\x20\x09-\x0D]`.
IGNORED = b" \t\n\x0b\x0c\r"
#: Owners of fingerprint ranges, at least, and the fingerprints that one owns, about; a message goes from each partition to each owner.
OWNERS, OWNED = 32, 10_000_000


def golomb_encode(values: np.ndarray, low: int, width: int) -> bytes:
    """Sorted integers in [low, low + width) as Golomb-Rice codes of their gaps.

    The divisor is the power of two nearest below the mean gap: quotients in unary, remainders
    in binary. Header: count (8 bytes) and remainder bits (1 byte). Repeats are gaps of 0.
    """
    n = len(values)
    if not n:
        return (0).to_bytes(8, "little") + b"\0"
    bits = max(0, min(62, (max(1, width // n)).bit_length() - 1))
    gaps = np.diff(np.concatenate(([np.uint64(low)], values.astype(np.uint64))))
    quotient = (gaps >> np.uint64(bits)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low_bits = ((gaps[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return n.to_bytes(8, "little") + bytes([bits]) + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(low_bits.ravel()).tobytes()


def golomb_decode(code: bytes, low: int) -> np.ndarray:
    n, bits = int.from_bytes(code[:8], "little"), code[8]
    if not n:
        return np.zeros(0, np.uint64)
    length = int.from_bytes(code[9:17], "little")
    cut = 17 + (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code[17:cut], np.uint8), count=length))
    gaps = (np.diff(np.concatenate(([-1], ends))) - 1).astype(np.uint64) << np.uint64(bits)
    if bits:
        raw = np.unpackbits(np.frombuffer(code[cut:], np.uint8), count=n * bits).reshape(n, bits)
        gaps |= (raw.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _owner_range(owner: int, owners: int) -> tuple[int, int]:
    step = -(-(2**64) // owners)
    return owner * step, min(2**64, (owner + 1) * step) - owner * step


def fingerprints(docs: DataFrame, owners: int) -> DataFrame:
    """Rows and messages of one pass over the texts, told apart by ``owner``; the caller pins them.

    A row (owner null): part, pos, doc_id, n_points, fp and the normalised text's sha256. ``fp`` is
    the first 8 bytes of the sha256. A message of a part to an owner: the codes of the part's distinct
    fingerprints in the owner's range, and of those that the part itself holds repeatedly.
    """
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, part, seen = 0, 0, []
        for batch in batches:
            n = batch.num_rows
            digests = [hashlib.sha256((text.as_py() or b"").translate(None, IGNORED)).digest() for text in batch.column(2)]
            fp = np.frombuffer(b"".join(digests), ">u8").reshape(n, 4)[:, 0].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(pos, pos + n)), batch.column(1), batch.column(3), pa.array(fp.view(np.int64)), pa.array([d.hex() for d in digests], pa.string()), *(pa.nulls(n, k) for k in kinds[6:])], names=names)
            pos, part = pos + n, batch.column(0)[0].as_py() if n else part
            seen.append(fp)
        values, times = np.unique(np.concatenate(seen), return_counts=True) if pos else (np.zeros(0, np.uint64), np.zeros(0, int))
        rows = []
        for owner in range(owners if pos else 0):
            low, width = _owner_range(owner, owners)
            a, z = np.searchsorted(values, np.uint64(low)), np.searchsorted(values, np.uint64(low + width - 1), side="right")
            if z > a:
                rows.append((owner, golomb_encode(values[a:z], low, width), golomb_encode(values[a:z][times[a:z] > 1], low, width)))
        if rows:
            n, (owner, code, again) = len(rows), zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), *(pa.nulls(n, k) for k in kinds[1:6]), pa.array(owner, pa.int32()), pa.array(code), pa.array(again)], names=names)

    lean = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    return lean.mapInArrow(run, _FIELDS)


_FIELDS = "part int, pos long, doc_id long, n_points long, fp long, text_sha256 string, owner int, code binary, again binary"


def suspects(sent: DataFrame, owners: int) -> DataFrame:
    """The exchange: the rows whose fingerprint occurs more than once.

    A part sends each of its distinct fingerprints once, so an owner gets at most one copy of a
    fingerprint from a part, however large a group of copies is. What crosses the network are
    codes and bitmaps. A task reads the answers for the parts whose rows it holds.
    """

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        low, _ = _owner_range(int(pdf["owner"].iloc[0]), owners)
        lists = [golomb_decode(c, low) for c in pdf["code"]]
        seen, times = np.unique(np.concatenate(lists), return_counts=True)
        twice = np.union1d(seen[times > 1], np.concatenate([golomb_decode(c, low) for c in pdf["again"]]))
        return pd.DataFrame({"part": pdf["part"], "owner": pdf["owner"], "code": pdf["code"], "bits": [np.packbits(np.isin(v, twice)).tobytes() for v in lists]})

    out = new_path(sent.sparkSession, "answers")
    answers = sent.where("owner IS NOT NULL").select("owner", "part", "code", "again").groupBy("owner").applyInPandas(answer, "part int, owner int, code binary, bits binary")
    answers.repartition("part").write.partitionBy("part").parquet(out)

    def repeated(store, root: str, part: int) -> np.ndarray:
        files = [f for f in store.get_file_info(fs.FileSelector(f"{root}/part={part}")) if f.path.endswith(".parquet")]
        values = [np.zeros(0, np.uint64)]
        for f in files:
            got = pq.ParquetFile(store.open_input_file(f.path)).read(["owner", "code", "bits"])
            for owner, code, bits in zip(*(c.to_pylist() for c in got.columns)):
                own = golomb_decode(code, _owner_range(owner, owners)[0])
                values.append(own[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)])
        return np.sort(np.concatenate(values))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        now, twice = None, np.zeros(0, np.uint64)
        for b in batches:
            parts, fp = b.column(0).to_numpy(), b.column(4).to_numpy().view(np.uint64)
            hit = np.zeros(len(fp), bool)
            for part in np.unique(parts):
                if part != now:
                    now, twice = part, repeated(store, root, int(part))
                own = np.flatnonzero(parts == part)
                hit[own] = np.isin(fp[own], twice)
            yield b.filter(pa.array(hit))

    rows = sent.where("owner IS NULL").select("part", "pos", "doc_id", "n_points", "fp", "text_sha256")
    return rows.mapInArrow(mark, rows.schema)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; null counts as the empty
    text, so all empty texts are one group; a text of any length is hashed and compared whole. The longest original text stays, then the
    smallest doc_id (null ids last); of fully tied rows one stays. An empty table gives an
    empty table; other columns are not read.
    """
    owners = max(OWNERS, -(-docs.count() // OWNED))
    sent = pin(fingerprints(docs, owners), "prints")
    prints = sent.where("owner IS NULL").select("part", "pos", "doc_id", "n_points", "fp", "text_sha256")
    found = pin(suspects(sent, owners), "suspects")

    # byte verification: the suspects' normalised texts, grouped by their bytes. The ids grow with
    # the corpus, so they are never broadcast, however few a small input has
    ids = found.select(F.col("doc_id").alias("_id")).distinct().hint("merge")
    texts = docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_id"]), "left_semi").select(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), SPACE, "").cast("binary").alias("t"))
    bytes_ = texts.groupBy(F.sha2("t", 256).alias("text_sha256"), "t").agg(F.count("*").alias("n"))
    checked = bytes_.groupBy("text_sha256").agg(F.count("*").alias("n_texts"))

    stays = F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("doc"), (-F.col("part")).alias("part"), (-F.col("pos")).alias("pos")))
    groups = found.groupBy("text_sha256").agg(F.count("*").alias("group_size"), stays.alias("s")).join(checked, "text_sha256")
    groups = groups.select("text_sha256", "group_size", (-F.col("s.doc")).alias("keep"), (-F.col("s.part")).alias("keep_part"), (-F.col("s.pos")).alias("keep_pos"), F.when(F.col("n_texts") > 1, F.raise_error(F.lit("two texts have one sha256"))).alias("broken"))
    # pinned: both sides of the join are then plain exchanges, and a hot group's rows can be split
    out = prints.join(pin(groups, "groups"), "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | ((F.col("part") == F.col("keep_part")) & (F.col("pos") == F.col("keep_pos")) & F.col("broken").isNull())).alias("kept"),
        "text_sha256",
    )


def keepers(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Rows are found again by doc_id; where an id occurs more than once, by id and text.
    """
    own, found = docs.columns, pin(dedup(docs), "dedup")
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    many = found.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    kept = found.where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    once = kept.join(many, kept["id"].eqNullSafe(many["id"]), "left_anti").select("id").hint("merge")
    stay = named.join(once, named["id"].eqNullSafe(once["id"]), "left_semi")
    if not many.isEmpty():
        again = named.join(many, named["id"].eqNullSafe(many["id"]), "left_semi").withColumn("sha", F.sha2(F.regexp_replace(F.coalesce("body", F.lit("")), SPACE, "").cast("binary"), 256))
        again = again.dropDuplicates(["id", "sha"])
        stay = stay.unionByName(again.join(kept, again["id"].eqNullSafe(kept["id"]) & (again["sha"] == kept["sha"]), "left_semi").drop("sha"))
    return stay.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS rn, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, h AS text_sha256 FROM r
"""
