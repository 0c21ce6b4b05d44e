"""Token ids as binary files: one compressed frame a document, one shared dictionary.

A document's ids, with an end id, are written as little-endian unsigned 32-bit
integers and compressed by themselves with a zstandard dictionary that was
trained on such arrays, so that a short document costs little and any document
is read without its neighbours.  Spark's writer puts the files in place, so a lost
or repeated task leaves no half files, and any store Spark writes to will do.

Files below a folder::

    dictionary/   one file: the dictionary (may be empty)
    blocks/       one file per block: header, index, frames

    header        MAGIC (8 bytes), shard, block, documents (u64 each), SHA-256 of the dictionary (32 bytes)
    index         doc_id (i64 each), whether it is null (u8 each), place of each frame and the end of the last
                  (u64, from the file's start), ids of each document (u64 each)
    frames        zstandard frames, one a document

All integers are little-endian; each file ends with a line feed that belongs to no
part.  Shards are ranges of (doc_id, hash of the text, frame), nulls first, and
shard and block number them in that order.

The dictionary is fitted on SAMPLES documents, chosen by hash among all, of each
at most SAMPLE_CHARS characters from a hashed place; too few for training are
taken as they are for a dictionary of raw content.  Every document is encoded
whole.  Only the dictionary, DICTIONARY_BYTES at most, reaches the driver.

Defined results: null and empty texts have the end id alone; doc_ids that repeat
are documents of their own, of equal ids ordered by hash and frame; an empty
table gives files without documents and an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import discard, scratch_path, table, written
from .mixing import running

END = 2
MAGIC = b"TIDETOK1"
HEAD = "<8sQQQ32s"
HEAD_BYTES = struct.calcsize(HEAD)
LEVEL = 3
SEED = 12
SAMPLES = 2048
SAMPLE_CHARS = 8192
DICTIONARY_BYTES = 65536
#: A block is closed once it has so many bytes; a shard has about so many.
BLOCK_BYTES = 1 << 24
SHARD_BYTES = 1 << 28


def _encoder(path: str, end: int | None):
    """text -> its ids as bytes; plain texts at once, others by chunks."""
    codec = bpe.Codec(path)
    chunks = bpe.Encoder(codec)
    last = b"" if end is None else struct.pack("<I", end)

    def one(text: str | None) -> bytes:
        if text and codec.plain and bpe.PLAIN.fullmatch(text) and not any(s in text for s in codec.special):
            return codec.fast.encode_to_numpy(text).astype("<u4").tobytes() + last
        return chunks.encode(text).astype("<u4").tobytes() + last

    return one


def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the end of the samples where these are too few to train one, none where they hold nothing."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)[-size:]
        return raw if len(raw) >= 8 else b""


def train(docs: DataFrame, vocabulary: str | None = None, end: int = END, samples: int = SAMPLES, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> bytes:
    """The shared dictionary of a corpus, made in one task from a bounded sample."""
    path, n = vocabulary or bpe.default_vocabulary(), max(1, docs.count())
    h = F.xxhash64(F.lit(SEED), "doc_id")
    place = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.greatest(F.length("text") - chars, F.lit(1)))
    some = docs.where(F.col("text").isNotNull() & (F.pmod(h, F.lit(n)) < samples)).limit(2 * samples)
    some = some.select(h.alias("h"), F.substring("text", (place + 1).cast("int"), F.lit(chars)).alias("text"))

    def run(batches):
        rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        one = _encoder(path, end)
        yield pa.RecordBatch.from_arrays([pa.array([dictionary_of([one(t) for _, t in rows], size)], pa.binary())], names=["dictionary"])

    made = some.coalesce(1).mapInArrow(run, "dictionary binary").first()
    return bytes(made[0]) if made else b""


def _zdict(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def encode_frames(docs: DataFrame, dictionary: bytes, vocabulary: str | None = None, end: int = END, level: int = LEVEL) -> DataFrame:
    """``doc_id, h, n_tokens, frame``; a map without a shuffle."""
    path = vocabulary or bpe.default_vocabulary()

    def run(batches):
        import zstandard

        packer, one = zstandard.ZstdCompressor(level=level, dict_data=_zdict(dictionary)), _encoder(path, end)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                ids = [one(x.as_py()) for x in part.column(2)]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, pa.array(map(packer.compress, ids), pa.binary())], names=["doc_id", "h", "n_tokens", "frame"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, n_tokens long, frame binary")


def pack_block(shard: int, block: int, ids: list[int | None], counts: list[int], frames: list[bytes], dictionary_sha: bytes) -> bytes:
    n = len(ids)
    first = HEAD_BYTES + n * 9 + (n + 1) * 8 + n * 8
    places = first + np.cumsum([0, *map(len, frames)])
    index = [
        np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(),
        places.astype("<u8").tobytes(), np.array(counts, "<u8").tobytes(),
    ]
    return b"".join([struct.pack(HEAD, MAGIC, shard, block, n, dictionary_sha), *index, *frames])


class Block:
    """Index of a block; ``ids(i)`` reads one document alone."""

    def __init__(self, raw: bytes | memoryview, dictionary: bytes):
        import zstandard

        magic, self.shard, self.block, n, sha = struct.unpack_from(HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        if sha != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at, self.raw = HEAD_BYTES, raw

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.places, self.counts = take("<u8", n + 1).tolist(), take("<u8", n).tolist()
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))

    def ids(self, i: int) -> bytes:
        out = self.unpacker.decompress(self.raw[self.places[i] : self.places[i + 1]])
        if len(out) != 4 * self.counts[i]:
            raise ValueError("a frame holds another number of ids than its index says")
        return out


def _pack(sha: bytes, most: int):
    def run(batches):
        shard, block, rows, size = None, 0, [], 0

        def close():
            raw = pack_block(shard, block, *map(list, zip(*rows, strict=True)), sha)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["block"])

        for b in batches:
            for i in range(b.num_rows):
                own = b.column(0)[i].as_py()
                if rows and (size >= most or own != shard):
                    yield close()
                    block, rows, size = (block + 1 if own == shard else 0), [], 0
                shard = own
                rows.append((b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py()))
                size += len(rows[-1][2])
        if rows:
            yield close()

    return run


def write_files(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, **sample) -> str:
    """Write the files of a corpus below ``path``."""
    spark = docs.sparkSession
    dictionary = train(docs, vocabulary, end, **sample)
    frames = written(encode_frames(docs, dictionary, vocabulary, end), "frames", codec="uncompressed")
    bytes_ = frames.agg(F.coalesce(F.sum(F.length("frame")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(bytes_ / shard_bytes))
    order = ["doc_id", "h", "frame"]
    dealt = frames.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions(*order)
    blocks = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "frame").mapInArrow(_pack(hashlib.sha256(dictionary).digest(), block_bytes), "block binary")
    # the text writer writes the bytes of a string as they are
    blocks.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/blocks")
    one = spark.createDataFrame([(dictionary,)], "value binary").coalesce(1)
    one.select(F.col("value").cast("string").alias("value")).write.text(f"{path}/dictionary")
    discard(frames)
    return path


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(f"{path}/dictionary").where("length > 0").select("content").collect()  # one row
    return bytes(rows[0][0])[:-1]


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/blocks").where(f"length >= {HEAD_BYTES}").select("content")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, each frame read back."""
    dictionary = read_dictionary(spark, path)

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                x = Block(memoryview(raw.as_buffer()), dictionary)
                n = len(x.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, x.shard)), pa.array(np.full(n, x.block)), pa.array(x.doc_ids, pa.int64()),
                        pa.array(np.cumsum([0, *x.counts[:-1]], dtype=np.int64)[:n]), pa.array(x.counts, pa.int64()), pa.array([zlib.crc32(x.ids(i)) for i in range(n)], pa.int64()),
                    ],
                    names=["shard", "block", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    found = written(_blocks(spark, path).mapInArrow(run, "shard long, block long, doc_id long, before long, n_tokens long, ids_crc32 long"), "counts")
    totals = found.groupBy("shard", "block").agg(F.sum("n_tokens").alias("ids"))
    starts = running(totals, [F.col("shard"), F.col("block")], {"first": "ids"}).select("shard", "block", "first")
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """``doc_id, ids`` of all documents, or of some, whose frames alone are unpacked then."""
    dictionary, wanted = read_dictionary(spark, path), None if only is None else set(only)

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                x = Block(memoryview(raw.as_buffer()), dictionary)
                for i, d in enumerate(x.doc_ids):
                    if wanted is None or d in wanted:
                        ids = pa.array([np.frombuffer(x.ids(i), "<u4").astype(np.int64)], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), ids], names=["doc_id", "ids"])

    return _blocks(spark, path).mapInArrow(run, "doc_id long, ids array<long>")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_counts(spark, write_files(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens")))
