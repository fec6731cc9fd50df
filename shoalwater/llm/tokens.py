"""Token ids: encoding with a public tokenizer, and a compressed binary file format.

The format: a shard file holds one zstandard frame per document, compressed with a dictionary that
all shards share and that is trained on serialised id arrays; behind the frames an index
(doc ids, frame offsets, token counts), and in the head the dictionary's sha256. A short
document is read with two seeks: the index and its frame.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import hash_bound, held, new_path, pin, table

#: The vocabulary of the contract, and the id that ends a document.
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Fixed values of the file format.
MAGIC = b"SHTOKEN1"
HEAD = struct.Struct("<8s32s")
FOOT = struct.Struct("<QQ8s")
#: Bounds of the dictionary: its bytes, about how many documents and how many ids of each train it.
DICTIONARY_BYTES = 64 * 1024
DICTIONARY_DOCS = 1000
DICTIONARY_IDS = 4096
#: Words, and parts of words, whose ids a Python worker keeps: about 200 bytes each.
KEPT_WORDS = 300_000
# How the vocabulary's pre-tokenizer cuts words of printable ASCII and of the Latin letters from U+00C0 to
# U+00FF, how it lower-cases them, and what it writes for their bytes from 0x9F on that have no character of their own.
PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
LOWER = bytes.maketrans(bytes([*range(65, 91), *range(0x80, 0x9F)]), bytes([*range(97, 123), *range(0xA0, 0xBF)]))
PARTS = re.compile(rb"'(?:[stmd]|re|ve|ll)|(?:[a-z]|\xc3[\x9f-\xbf])+|[0-9]|[!-/:-@\[-`{-~]+")
BYTE_CHARS = {0x9F: "\u0141", 0xA0: "\u0142", 0xAD: "\u0143"}
#: Begins a special token's string, which a tokenizer looks for before it lower-cases.
SPECIAL = b"<|"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Kept(dict):
    """What ``make`` gives for a key; the first ``most`` of them are kept."""

    def __init__(self, make: Callable[[bytes], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, key: bytes) -> bytes:
        made = self.make(key)
        if len(self) < self.most:
            self[key] = made
        return made


class WordEncoder:
    """Ids of texts by a tokenizer whose pre-tokenizer drops white space.

    Such a tokenizer treats each word alone, so the ids of a text are those of its words. A plain
    word is lower-cased and cut into parts here, and the library's model encodes the parts; any
    other word goes through the whole tokenizer. Words and parts that were seen are kept, up to a
    bound. ``encode`` gives little-endian unsigned 32-bit ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = Kept(self._word, KEPT_WORDS)

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():
            parts = [word.lower()]
        elif SPECIAL not in word and PLAIN.fullmatch(word):
            parts = PARTS.findall(word.translate(LOWER))
        else:
            return _packed(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if parts != [word]:  # a part is a word of its own
            return b"".join(map(self.words.__getitem__, parts))
        return _packed([t.id for t in self.model.tokenize(word.decode("latin-1").translate(BYTE_CHARS))])

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; it outlives a task, and with it the words that it knows."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("encoder", path), lambda: WordEncoder(path))


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text's bytes (null: empty) in a fixed order of columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"), *more)


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A zstandard dictionary from ids of at most ``DICTIONARY_DOCS`` documents, those with the smallest hash.

    Of a long text a window at a hashed place is taken. The dictionary only sets how well frames compress, not what they hold.
    """

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            out = [e.encode(t)[: DICTIONARY_IDS * 4] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    # a threshold on the 64-bit hash leaves about twice as many, so only those are ordered
    near = texts_of(docs.where(F.xxhash64("doc_id") <= hash_bound(2 * DICTIONARY_DOCS, docs.count())))
    chosen = near.orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(DICTIONARY_DOCS).select("doc_id", F.substring("t", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("t") - DICTIONARY_IDS * 8)) + 1).cast("int"), F.lit(DICTIONARY_IDS * 8)).alias("t"))
    samples = [bytes(r["ids"]) for r in chosen.mapInArrow(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:  # too few ids to train on: frames without a trained dictionary
        return zstandard.ZstdCompressionDict(b"".join(samples)[:1024] or b"\0" * 64, dict_type=zstandard.DICT_TYPE_RAWCONTENT).as_bytes()


class ShardWriter:
    """Writes one shard: frames in the given order, then the index."""

    def __init__(self, out, dictionary: bytes):
        self.out, self.at = out, 0
        self.frames = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        self.ids: list[int | None] = []
        self.offsets: list[int] = []
        self.counts: list[int] = []
        self._put(HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest()))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.offsets.append(self.at)
        self.counts.append(len(ids) // 4)
        self._put(self.frames.compress(ids))

    def close(self) -> None:
        start = self.at
        known = np.array([i is not None for i in self.ids], dtype=np.uint8)
        for part in (np.array([i or 0 for i in self.ids], "<i8"), known, np.array([*self.offsets, start], "<u8"), np.array(self.counts, "<u4")):
            self._put(part.tobytes())
        self._put(FOOT.pack(start, len(self.ids), MAGIC))
        self.out.close()


class ShardReader:
    """Random access to a shard: ``ids``, ``counts`` and ``read(i)``, the ids of the i-th document."""

    def __init__(self, file, dictionary: bytes):
        self.file, end = file, file.size()
        magic, digest = HEAD.unpack(self._at(0, HEAD.size))
        start, n, tail = FOOT.unpack(self._at(end - FOOT.size, FOOT.size))
        if (magic, tail) != (MAGIC, MAGIC) or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this dictionary")
        index = io.BytesIO(self._at(start, end - FOOT.size - start))
        self.ids = np.frombuffer(index.read(8 * n), "<i8")
        self.known = np.frombuffer(index.read(n), np.uint8).astype(bool)
        self.offsets = np.frombuffer(index.read(8 * (n + 1)), "<u8")
        self.counts = np.frombuffer(index.read(4 * n), "<u4")
        self.frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def read(self, i: int) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.frames.decompress(self._at(int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i])))


#: Documents and bytes after which a task begins another file: what it keeps of the index stays small.
SHARD_DOCS, SHARD_BYTES = 1_000_000, 256 << 20


def write_shards(docs: DataFrame, out_dir: str, path: str, end_id: int = END_ID, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, bytes]:
    """Encode ``docs`` and write shards in ascending doc_id order (null ids first).

    Rows of equal doc_id are ordered by their texts' bytes, so reruns agree.
    Returns the manifest (shard, roll, file, n_docs, n_tokens, n_bytes, start) and the dictionary. A
    task writes files of its own names, one after the other as they fill, and only files in the manifest are read, so a task that
    ran twice does no harm. A text of any length is one frame. No documents give an empty manifest. Only doc_id and text are read. ``out_dir``: a URI in the shared store.
    """
    dictionary = train_dictionary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, end = encoder(path), struct.pack("<I", end_id)
        store, root = fs.FileSystem.from_uri(out_dir)
        store.create_dir(root, recursive=True)
        writer, name, tokens, roll = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            row = {"shard": TaskContext.get().partitionId(), "roll": roll, "file": name, "n_docs": len(writer.ids), "n_tokens": tokens, "n_bytes": writer.at}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("roll", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if writer is None:
                    name, tokens = f"{uuid.uuid4().hex}.ids", 0
                    writer = ShardWriter(store.open_output_stream(f"{root}/{name}"), dictionary)
                ids = e.encode(text.as_py()) + end
                writer.add(doc_id, ids)
                tokens += len(ids) // 4
                if len(writer.ids) >= shard_docs or writer.at >= shard_bytes:
                    yield closed()
                    writer, roll = None, roll + 1
        if writer is not None:
            yield closed()

    ordered = texts_of(docs).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "t")
    shards = pin(ordered.mapInArrow(run, "shard int, roll int, file string, n_docs long, n_tokens long, n_bytes long"), "shards")
    before = W.orderBy("shard", "roll").rowsBetween(W.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), dictionary


def read_shards(manifest: DataFrame, out_dir: str, dictionary: bytes) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(out_dir)
        for b in batches:
            for file, start in zip(b["file"], b["start"]):
                with store.open_input_file(f"{root}/{file}") as f:
                    r = ShardReader(f, dictionary)
                    crc = [zlib.crc32(r.read(i)) for i in range(len(r.ids))]
                counts = r.counts.astype(np.int64)
                ids = pd.Series(r.ids).astype("Int64").where(pd.Series(r.known), pd.NA)
                yield pd.DataFrame({"doc_id": ids, "start": start + np.cumsum(counts) - counts, "n_tokens": counts, "ids_crc32": crc})

    return manifest.select("file", "start").repartition("file").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """Null texts are empty documents of one id; repeated rows are documents of their own."""
    out = new_path(spark, "tokens")
    manifest, dictionary = write_shards(table(spark, sf_dir, "documents"), out, vocabulary_path())
    return read_shards(manifest, out, dictionary)
