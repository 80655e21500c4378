"""Best-fit packing by exact-complement hashing: documents, cut only where longer than a sequence,
fill as few sequences of bounded length as possible.

The plan needs only how often each length occurs, a table of at most ``size`` numbers, whatever the
number of documents. From the longest length down it looks up the gap that is left among single
lengths, sums of two and sums of three that are still available, and takes each combination that fills
the gap exactly as often as the counts allow. What remains goes best-fit, longest first. The result is a
list of patterns with multiplicities; each lookup uses some length up, so their number is bounded by
``size`` too. The pieces of a length are numbered over all partitions (counts per
(length, hash bucket) give every bucket's first number), and a number falls into the stretch of one
pattern: sequence and offset follow without any task holding more than a bucket.

Defined results: null and empty texts are their end id only. Repeated rows are packed as often as they
occur. Rows without a doc_id are packed too. No rows give no pieces. Extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import give_back, parts
from cohortlens.llm.tokens import encoder
from cohortlens.operators.scale import settle

SIZE = 2048
#: Texts that are encoded at once.
TEXTS = 1_000


def pieces(df: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, drops_space: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each text and the end id in pieces of at most
    that size; ids as little-endian unsigned 32-bit integers."""

    def cut(batches):
        encode, end = encoder(tokenizer, drops_space).encode, np.array([end_id], "<u4").tobytes()
        for whole in batches:
            give_back()
            for first in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(first, TEXTS)
                rows = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    made = encode(text or "") + end
                    for i, at in enumerate(range(0, len(made), 4 * size)):
                        one = made[at : at + 4 * size]
                        for name, value in zip(rows, (doc_id, i, at // 4, len(one) // 4, one), strict=True):
                            rows[name].append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    rows = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def _exact(count: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Available lengths, one, two or three, whose sum is the gap."""
    if count[gap]:
        return (gap,)
    have = np.flatnonzero(count[:gap])

    def pair(total: int, counts: np.ndarray) -> tuple[int, int] | None:
        low = have[have <= total // 2]
        fits = low[(counts[low] > 0) & (counts[total - low] > 0)]
        if len(fits) and fits[-1] * 2 == total and counts[fits[-1]] < 2:
            fits = fits[:-1]
        return (int(total - fits[0]), int(fits[0])) if len(fits) else None

    if found := pair(gap, count):
        return found
    for a in have[::-1]:
        count[a] -= 1
        found = pair(gap - int(a), count)
        count[a] += 1
        if found:
            return (int(a), *found)
    return None


def plan(count: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used. count[x] pieces have length x."""
    count = count.astype(np.int64).copy()
    made: list[tuple[tuple[int, ...], int]] = [((size,), int(count[size]))] if count[size] else []
    count[size] = 0
    rest = np.zeros_like(count)
    for length in range(size - 1, 0, -1):
        while count[length]:
            count[length] -= 1
            found = _exact(count, size - length)
            count[length] += 1
            if found is None:
                rest[length], count[length] = count[length], 0
                break
            pattern = (length, *found)
            kinds, times = np.unique(pattern, return_counts=True)
            n = int((count[kinds] // times).min())
            count[kinds] -= n * times
            made.append((pattern, n))
    # best fit, longest first, runs of equal bins at a time
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in np.flatnonzero(rest)[::-1].tolist():
        left = int(rest[length])
        while left:
            gap = min((g for g in open_bins if g >= length), default=None)
            if gap is None:
                each = size // length
                for per, n in ((each, left // each), (left % each, 1)):
                    if per and n:
                        open_bins.setdefault(size - per * length, []).append(((length,) * per, n))
                break
            pattern, n = open_bins[gap].pop()
            take = min(n, left)
            if n > take:
                open_bins[gap].append((pattern, n - take))
            if not open_bins[gap]:
                del open_bins[gap]
            open_bins.setdefault(gap - length, []).append(((*pattern, length), take))
            left -= take
    return made + [x for bins in open_bins.values() for x in bins]


def _stretches(patterns: list[tuple[tuple[int, ...], int]], size: int) -> dict[str, np.ndarray]:
    """For each slot of a pattern: its length and the numbers of the pieces that fill it, as sorted
    keys, with the first sequence and the offset."""
    used = np.zeros(size + 1, np.int64)
    rows, first = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], first, offset))
            used[length] += n
            offset += length
        first += n
    rows.sort()
    length, number, sequence, offset = np.array(rows, np.int64).reshape(-1, 4).T
    return {"length": length, "number": number, "sequence": sequence, "offset": offset}


def packed(stored: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to a stored table with columns doc_id, piece, length (1 to size)."""
    histogram = np.zeros(size + 1, np.int64)
    for length, n in stored.groupBy("length").count().collect():  # at most `size` rows
        histogram[length] = n
    stretches = _stretches(plan(histogram, size), size)
    start = stretches["length"] * (1 << 44) + stretches["number"]

    n = parts(stored)
    dealt = stored.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", *(["ids_crc32"] if "ids_crc32" in stored.columns else [])), F.lit(n)).cast("int"))
    cells = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy(*[c for c in stored.columns if c not in ("length", "ids")])
    numbered = dealt.withColumn("_in", F.row_number().over(order)).join(cells, ["length", "_bucket"])
    numbered = numbered.withColumn("_key", F.col("length") * F.lit(1 << 44) + F.col("_before") + F.col("_in") - 1)

    def place(batches):
        for batch in batches:
            keys = batch.column("_key").to_numpy()
            at = np.searchsorted(start, keys, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(stretches["sequence"][at] + keys - start[at]), pa.array(stretches["offset"][at])],
                names=[*names, "sequence_id", "offset"],
            )

    names = stored.columns
    schema = ", ".join(f"`{c}` {kind}" for c, kind in stored.dtypes) + ", sequence_id long, offset long"
    return numbered.select(*names, "_key").mapInArrow(place, schema)


def pack(df: DataFrame, tokenizer: str, end_id: int, size: int = SIZE) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = pieces(df, tokenizer, end_id, size).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed(settle(made)[0], size)
