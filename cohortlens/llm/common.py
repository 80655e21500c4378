"""What the operators of this folder share.

Several of them must know, for keys that every text makes in great number (shingles, byte
windows, sentence runs, contexts), which keys occur elsewhere too. Rows of (key, document) would
move many times the size of the texts. Instead texts are dealt over chunks of bounded size, a
chunk asks about its distinct keys in sorted blocks, one per bucket of the key space, and gets
one byte back for each (``ask``, ``answer``, ``tell``). The texts are shuffled once: all passes
over the chunks of one plan reuse the same exchange. Keys are hashes, and a chunk asks about a key
once, so no bucket is hot however often a key occurs. A chunk's blocks depend on its documents
only, not on their order, so a lost executor's work can be repeated."""

from __future__ import annotations

import ctypes
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.scale import settle

#: Bytes of text in a chunk; longer single texts are chunks of their own size.
CHUNK_BYTES = 8_000_000
#: Rows without a document id come last in the order of documents.
LAST = np.iinfo(np.int64).max
SPACE = "[\\x20\\x09-\\x0D]"
U64 = np.uint64
#: Groups of at least so many bytes give back what they freed.
LARGE = 1_000_000
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Freed memory goes back to the system. A Python worker lives on through many tasks and shares the
    executor's memory with the others; what it merely keeps for later adds up with what they need."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(f: Callable, *tables: pa.Table) -> pa.Table:
    """f of a group's tables; what the groups before and f itself have freed is given back."""
    large = sum(t.nbytes for t in tables) >= LARGE
    if large:
        give_back()
    made = f(*tables)
    if large:
        give_back()
    return made


def texts_of(table: pa.Table) -> Iterator[str]:
    """The texts one by one, empty ones for null."""
    return (x.as_py() or "" for x in table["text"])


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one number."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def crc_of_id(id_column: str = "doc_id") -> Column:
    """The unsigned crc32 of the id as text; 0 without an id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(0))


def parts(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def chunked(
    df: DataFrame, extra: list[Column] | None = None, chunk_bytes: int = CHUNK_BYTES, total: int | None = None
) -> tuple[DataFrame, int]:
    """(_chunk, doc_id, text, extra columns) dealt by chunk, and the number of chunks. The
    documents of one id share a chunk; rows without an id are dealt by their text."""
    total = text_bytes(df) if total is None else total
    n = max(1, math.ceil(total / chunk_bytes))
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text")))
    made = df.select(
        F.pmod(key, F.lit(n)).cast("int").alias("_chunk"), F.col("doc_id").cast("long"), F.col("text").cast("string"), *(extra or [])
    )
    return made.repartition(max(1, math.ceil(n / 2)), "_chunk"), n


def in_order(table: pa.Table) -> pa.Table:
    """Documents of a chunk by id, then text: an order that doesn't depend on arrival."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def ids_of(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(LAST).to_numpy().astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def blocks(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the sorted keys begins and ends."""
    bucket = ((keys >> U64(32)) * U64(buckets)) >> U64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def ask(chunks: DataFrame, keys_of: Callable, buckets: int, key_type: type = np.uint64) -> DataFrame:
    """One row (_bucket, _chunk, keys, owners) for every bucket that a chunk has keys in.
    keys_of(table) gives the chunk's distinct keys, sorted, and for each a whole number: its
    first document, a count, or what ``answer`` is to combine. With np.uint32 as key_type the low
    halves of the keys travel: the bucket comes from the high ones, so keys of a bucket seldom agree
    by chance, and those that do are answered as one. For questions where that only asks more of
    the next step."""

    def one(table: pa.Table) -> pa.Table:
        keys, owners = keys_of(table)
        at = blocks(keys, buckets)
        full = np.flatnonzero(at[1:] > at[:-1])
        return pa.table(
            {
                "_bucket": pa.array(full, pa.int32()),
                "_chunk": pa.array(np.full(len(full), table["_chunk"][0].as_py()), pa.int32()),
                "keys": pa.array([keys[at[i] : at[i + 1]].astype(key_type).tobytes() for i in full], pa.binary()),
                "owners": pa.array([owners[at[i] : at[i + 1]].tobytes() for i in full], pa.binary()),
            }
        )

    return chunks.groupBy("_chunk").applyInArrow(lambda table: lean(one, table), "_bucket int, _chunk int, keys binary, owners binary")


def answer(asked: DataFrame, combine: Callable, key_type: type = np.uint64) -> DataFrame:
    """(_chunk, _bucket, said): a byte for each key of a block, made by combine(run, owners,
    chunks, order) -> bytes in sorted key order, run being the number of each key's run."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_chunk", "ascending")])
        blobs = table["keys"].to_pylist()
        keys = np.frombuffer(b"".join(blobs), key_type)
        sizes = np.array([len(x) // keys.itemsize for x in blobs])
        owners = np.frombuffer(b"".join(table["owners"].to_pylist()), np.int64)
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        first = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
        said = np.empty(len(keys), np.uint8)
        said[order] = combine(first, owners[order] if len(owners) else owners)
        ends = np.cumsum(sizes)
        return pa.table(
            {
                "_chunk": table["_chunk"],
                "_bucket": table["_bucket"],
                "said": pa.array([said[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary()),
            }
        )

    return asked.groupBy("_bucket").applyInArrow(lambda table: lean(one, table), "_chunk int, _bucket int, said binary")


def tell(chunks: DataFrame, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(table, said) for every chunk, said holding the bytes in the order of its keys."""

    def one(table: pa.Table, got: pa.Table) -> pa.Table:
        said = b"".join(got.sort_by([("_bucket", "ascending")])["said"].to_pylist())
        return finish(table, np.frombuffer(said, np.uint8))

    return chunks.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(lambda table, got: lean(one, table, got), schema)


def chunk_counts(first: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For ``answer``: in how many chunks the key occurs, 255 at most."""
    run = np.cumsum(first) - 1
    return np.minimum(np.bincount(run), 255).astype(np.uint8)[run]


def who_is_first(first: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For ``answer``: 0 if no other chunk has the key, 1 if this chunk has the smallest owner,
    2 if another one has. Equal owners (rows without id): the first chunk."""
    starts = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    least = np.minimum.reduceat(owners, starts)[run]
    mine = np.flatnonzero(owners == least)
    firsts = mine[np.r_[True, run[mine][1:] != run[mine][:-1]]] if len(mine) else mine
    said = np.where(np.bincount(run)[run] > 1, 2, 0).astype(np.uint8)
    firsts = firsts[said[firsts] == 2]
    said[firsts] = 1
    return said


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges: root is the smallest node reachable. Large-star
    and small-star rounds; every round's edges are settled in the shared folder, and a round costs
    two joins of the edges that are left. Only a count and a sum of hashes reach the driver."""
    current, _ = settle(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # every edge now points from a node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u != v").distinct()
        current, n = settle(small)
        now = (n, current.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0])
        if now == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def single_threaded() -> None:
    """Libraries with threads of their own use one: Spark's tasks already fill the cores."""
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
