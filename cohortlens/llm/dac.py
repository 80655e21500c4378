"""Token-ID output as directly addressable codes (DAC).

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id, level 1 the
second chunk of those ids that have one, and so on. Beside the chunks of a level stands a bitmap that
tells which ids go on, and a rank directory with the ones before every 512 bits of it. Token i is
read with one rank per level, without decoding any other token; a run of tokens is a run in every level.

Image of a shard, all numbers little-endian:

    8 bytes   magic "DACIDS1\\n"
    u64 x 5   bytes of the image, part, shard, documents, ids
    u64       levels
    i64, u64  per document: doc_id, its first id's place in the shard (without id: the least i64)
    per level u64 entries, chunks (1 byte each), bitmap (1 bit each, lowest bit first, padded to
              64 bytes), rank directory (u64 for each 64 bytes of bitmap)

A file is a sequence of images, each followed by a line feed: Spark's text writer writes one row's
bytes and a separator, so files go to any file system that Spark writes, under its commit protocol,
and a lost task is simply run again. Documents are in ascending doc_id order over images and files
(rows without a doc_id first, equal ids by the hash of their text); parts are ranges of ids, of bounded size.

Defined results: a null text is empty and holds the end id only; repeated rows are written as often as
they occur; no rows give no images. Extra columns are ignored."""

from __future__ import annotations

import math
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import text_bytes
from cohortlens.llm.tokens import encoder
from cohortlens.operators.scale import settle, shared_folder

MAGIC = b"DACIDS1\n"
HEAD = struct.Struct("<8s6Q")
RANK_BYTES = 64
NO_ID = np.iinfo(np.int64).min
#: Ids in an image; a longer document is an image of its own.
SHARD_IDS = 2_000_000
PART_BYTES = 16_000_000
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint64)


def image(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, part: int = 0, shard: int = 0) -> bytes:
    """The bytes of a shard."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks, rest = (rest & 255).astype(np.uint8), rest >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.r_[bits, np.zeros(-len(bits) % RANK_BYTES, np.uint8)]
        ones = _ONES[bits].reshape(-1, RANK_BYTES).sum(1)
        ranks = (np.cumsum(ones) - ones).astype("<u8")
        levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more]
        if not len(rest):
            break
    body = doc_ids.astype("<i8").tobytes() + starts.astype("<u8").tobytes() + b"".join(levels)
    return HEAD.pack(MAGIC, HEAD.size + len(body), part, shard, len(doc_ids), len(ids), len(levels)) + body


class Image:
    """Random access to the ids of an image."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.size, self.part, self.shard, n, self.n_ids, n_levels = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a DAC image")
        at += HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.starts = np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64)
        at += 16 * n
        self.levels = []
        for _ in range(n_levels):
            entries = struct.unpack_from("<Q", data, at)[0]
            n_bits = math.ceil(math.ceil(entries / 8) / RANK_BYTES) * RANK_BYTES
            chunks = np.frombuffer(data, np.uint8, entries, at + 8)
            bits = np.frombuffer(data, np.uint8, n_bits, at + 8 + entries)
            ranks = np.frombuffer(data, "<u8", n_bits // RANK_BYTES, at + 8 + entries + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += 8 + entries + n_bits + 8 * len(ranks)

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i of the level's bitmap: one directory entry and at most 64 bytes."""
        _, bits, ranks = self.levels[level]
        block, byte = i // (8 * RANK_BYTES), i // 8
        if block == len(ranks):
            return int(ranks[-1] + _ONES[bits[-RANK_BYTES:]].sum()) if len(ranks) else 0
        ones = int(ranks[block]) + int(_ONES[bits[block * RANK_BYTES : byte]].sum())
        return ones + int(_ONES[bits[byte] & ((1 << (i % 8)) - 1)])

    def token(self, i: int) -> int:
        """Id number i."""
        value, level = 0, 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << (8 * level)
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i, level = self.rank(level, i), level + 1

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids from start up to end."""
        value, on, level = np.zeros(end - start, "<u4"), np.arange(end - start), 0
        while len(on):
            chunks, bits, _ = self.levels[level]
            value[on] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start]
            if not more.any():
                break
            on = on[more.astype(bool)]
            start, end, level = self.rank(level, start), self.rank(level, end), level + 1
        return value


def images(content: bytes):
    """The images of a file."""
    at = 0
    while at < len(content):
        one = Image(content, at)
        yield one
        at += one.size + 1


def write_ids(df: DataFrame, folder: str, tokenizer: str, end_id: int, drops_space: bool = False, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text, append the end id, and write files of images to a new folder."""

    def shards(batches):
        encode = encoder(tokenizer, drops_space).encode
        end, part, n = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        ids, sizes, held = [], [], []

        def flush():
            lengths = np.array(sizes, np.int64)
            made = image(np.array(held, np.int64), np.cumsum(lengths) - lengths, np.frombuffer(b"".join(ids), "<u4"), part, n)
            return pa.RecordBatch.from_pydict({"image": pa.array([made], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                made = encode(text or "") + end
                if sizes and sum(sizes) + len(made) // 4 > shard_ids:
                    yield flush()
                    ids, sizes, held, n = [], [], [], n + 1
                ids.append(made)
                sizes.append(len(made) // 4)
                held.append(NO_ID if doc_id is None else doc_id)
        if sizes:
            yield flush()

    n = max(1, math.ceil(text_bytes(df) / PART_BYTES))
    rows = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    made = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(shards, "image binary")
    made.select(F.col("image").cast("string").alias("value")).write.option("compression", "none").text(folder)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: part, shard, place, doc_id, start (in the image), n_tokens,
    ids_crc32 and on demand ids (array)."""

    def docs(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                for one in images(content):
                    ends = np.r_[one.starts[1:], one.n_ids]
                    every = one.tokens(0, one.n_ids)  # all documents of the image: one run of its levels
                    found = [every[a:b] for a, b in zip(one.starts.tolist(), ends.tolist(), strict=True)]
                    n = len(found)
                    columns = {
                        "part": pa.array([one.part] * n, pa.int64()), "shard": pa.array([one.shard] * n, pa.int64()),
                        "place": pa.array(range(n), pa.int64()),
                        "doc_id": pa.array(one.doc_ids, mask=one.doc_ids == NO_ID),
                        "start": pa.array(one.starts), "n_tokens": pa.array(ends - one.starts),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "part long, shard long, place long, doc_id long, start long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(docs, schema + (", ids array<int>" if with_ids else ""))


def with_global_starts(read: DataFrame) -> DataFrame:
    """start as the number of ids of all documents before. The running sum is over images: one
    row for some millions of ids."""
    stored, _ = settle(read)
    sums = stored.groupBy("part", "shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return stored.join(offsets, ["part", "shard"]).withColumn("start", F.col("start") + F.col("_before")).drop("_before", "part", "shard", "place")


def written_and_read(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the ids of a table to a new shared folder and describe them from the files."""
    folder = f"{shared_folder(df.sparkSession)}/dac-{uuid.uuid4().hex}"
    write_ids(df, folder, tokenizer, end_id)
    return with_global_starts(read_ids(df.sparkSession, folder))
