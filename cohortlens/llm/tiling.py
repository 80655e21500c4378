"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of lower-cased words. Running Karp-Rabin hashes of
``min_match`` words are the seeds; seeds that a document shares with an item join on their hash. Seeds
on one diagonal are a match, and tiling marks matches longest first: a match that touches words already
marked, in the document or in the item, is cut to what is free of it and takes its turn again if it is
long enough. The share of an item's words that are marked is its coverage; it doesn't depend on the order
in which a document holds an item's passages, so reordered ones are found too. A document is contaminated
if it covers an item to ``percent`` or more.

The benchmark's seeds reach the tasks in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast at once is
bounded however long the benchmark is (an item longer than that is a block of its own); every document is held against every block. Documents aren't
shuffled. Defined results: null and empty texts match nothing; items of fewer than ``min_match`` words are
not tested, as any text holds them; items that occur twice are tested twice. Repeated rows and rows
without a doc_id are judged like any other. Extra columns are ignored."""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import U64, give_back, mix
from cohortlens.operators.scale import settle

MIN_MATCH = 4
PERCENT = 50
BLOCK_WORDS = 1_000_000
#: Documents whose seeds are looked up at once.
TEXTS = 500
_WORD = re.compile(r"\w+")
_BASE = U64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    found = _WORD.findall((text or "").lower())
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found), np.uint64, len(found))


def seeds(words: np.ndarray, length: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of that many words."""
    n = len(words) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    made = words[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, length):
            made = made * _BASE + words[j : j + n]
    return mix(made)


class Index:
    """The seeds of a block of items."""

    def __init__(self, item_ids: list, texts: list, min_match: int):
        words = [word_hashes(x) for x in texts]
        self.item_ids, self.sizes = item_ids, np.array([len(x) for x in words], np.int64)
        found = [seeds(x, min_match) for x in words]
        key = np.concatenate(found) if found else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        place = np.concatenate([np.arange(len(x)) for x in found]) if found else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]


def matches(at: np.ndarray, place: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(length, document place, item place) of the runs of shared seeds on a diagonal."""
    order = np.lexsort((at, at - place))
    at, place = at[order], place[order]
    new = np.r_[True, (np.diff(at - place) != 0) | (np.diff(at) != 1)]
    begin = np.flatnonzero(new)
    runs = np.diff(np.r_[begin, len(at)])
    return [(int(n) + min_match - 1, int(at[i]), int(place[i])) for n, i in zip(runs, begin, strict=True)]


def tiles(found: list[tuple[int, int, int]], item_size: int, min_match: int) -> list[tuple[int, int, int]]:
    """The matches marked, longest first, none touching another; equal lengths in order of places."""
    heap = [(-n, a, b) for n, a, b in found]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(item_size, bool), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [not in_item[b + i] and a + i not in in_doc for i in range(n)]
        if all(free):
            in_item[b : b + n] = True
            in_doc.update(range(a, a + n))
            out.append((n, a, b))
            if in_item.all():
                break
            continue
        start = None
        for i, ok in enumerate([*free, False]):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i - start >= min_match:
                    heapq.heappush(heap, (start - i, a + start, b + start))
                start = None
    return out


def _against(block: Index, texts: list, min_match: int) -> list[list[dict]]:
    """For each text its items with tiles."""
    words = [word_hashes(x) for x in texts]
    sizes = np.array([len(x) for x in words], np.int64)
    joined = np.concatenate(words) if words else np.empty(0, np.uint64)
    made: list[list[dict]] = [[] for _ in texts]
    key = seeds(joined, min_match)
    if not len(key) or not len(block.key):
        return made
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[: len(key)] == text[min_match - 1 :]
    lo = np.searchsorted(block.key, key)
    hit = np.flatnonzero(inside & (block.key[np.minimum(lo, len(block.key) - 1)] == key))
    if not len(hit):
        return made
    lo, hi = lo[hit], np.searchsorted(block.key, key[hit], "right")
    width = hi - lo
    entry = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)
    at = np.repeat(hit, width)
    doc, item = text[at], block.item[entry]
    at, place = at - (np.cumsum(sizes) - sizes)[doc], block.place[entry]
    order = np.lexsort((item, doc))
    pair = doc[order] * len(block.sizes) + item[order]
    cuts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    for s, e in zip(cuts, [*cuts[1:], len(order)], strict=True):
        mine = order[s:e]
        which, size = int(item[mine[0]]), int(block.sizes[item[mine[0]]])
        found = tiles(matches(at[mine], place[mine], min_match), size, min_match)
        covered = sum(n for n, _, _ in found)
        made[int(doc[mine[0]])].append(
            {
                "item_id": block.item_ids[which], "covered": covered, "words": size, "coverage": covered / size,
                "tiles": [{"length": n, "doc_word": a, "item_word": b} for n, a, b in found],
            }
        )
    return made


MATCH = "struct<item_id: long, covered: long, words: long, coverage: double, tiles: array<struct<length: long, doc_word: long, item_word: long>>>"
_MATCH = pa.struct(
    [
        ("item_id", pa.int64()), ("covered", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64()),
        ("tiles", pa.list_(pa.struct([("length", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())]))),
    ]
)


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """The items (item_id, text) in blocks of about that many words, one at a time on the driver."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.regexp_count("text", F.lit("\\w+")))).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_words)) if total > block_words else 1
    for i in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").toArrow()
        yield block["item_id"].to_pylist(), block["text"].to_pylist()


def tiled(df: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, percent: int = PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """row (a struct of all columns of the documents), matches (the items with tiles: item_id,
    covered, words, coverage, tiles) and contaminated."""
    given = df.select(F.struct("*").alias("row"), F.array().cast(f"array<{MATCH}>").alias("matches"))  # the text travels once
    schema, made, text_at = given.schema, given, df.columns.index("text")
    for i, (item_ids, texts) in enumerate(benchmark_blocks(benchmark, block_words)):
        if i:  # a pass over the documents for each block, so no task holds two of them
            made, _ = settle(made)
        shared = df.sparkSession.sparkContext.broadcast(Index(item_ids, texts, min_match))

        def rows(batches, shared=shared):
            for batch in batches:
                give_back()
                for first in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(first, TEXTS)
                    texts = pa.compute.struct_field(part.column("row"), text_at).cast(pa.string()).to_pylist()
                    found = _against(shared.value, texts, min_match)
                    before = part.column("matches").to_pylist()
                    both = pa.array([a + b for a, b in zip(before, found, strict=True)], pa.list_(_MATCH))
                    yield pa.RecordBatch.from_arrays([part.column("row"), both], names=["row", "matches"])

        made = made.mapInArrow(rows, schema)
    enough = F.exists("matches", lambda m: 100 * m["covered"] >= percent * m["words"])
    return made.select("row", "matches", enough.alias("contaminated"))


def contaminated(df: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, contaminated, n_items (covered to ``percent``), max_coverage and matches."""
    made = tiled(df.select("doc_id", "text"), benchmark, min_match, percent)
    full = F.filter("matches", lambda m: 100 * m["covered"] >= percent * m["words"])
    return made.select(
        "row.doc_id", "contaminated", F.size(full).cast("long").alias("n_items"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("max_coverage"), "matches",
    )
