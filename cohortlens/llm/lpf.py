"""Suffix-array dedup: removes every byte covered by a string of 100 bytes that starts earlier too.

The longest previous factor (LPF) of a suffix is the most bytes it shares with one that starts
earlier: where it reaches 100, the suffix's first 100 bytes go. In suffix order the earlier suffix
that shares most is the previous or the next one with a smaller position, so two searches over that
order give all LPFs (``longest_previous``).

A suffix array over all texts would move many times their size. Three steps make it sparse:

1. Anchors. The k-byte window with the smallest hash among those inside a 100-byte string is the
   string's anchor; equal strings have equal anchors at equal offsets. Anchors follow each other
   by some 35 bytes. Every chunk learns which of its anchors occur elsewhere (``common.ask``);
   strings at all others are unique.
2. Contexts. What an anchor's strings cover together is its context. Equal contexts are collapsed
   to the earliest, in the chunk first and then over all: the strings of later ones are all removed.
3. Suffix order. The different contexts of one anchor meet in one task. The suffixes that start at
   the anchors are sorted by their bytes; the order of the suffixes that start one byte earlier
   follows from it by one stable sort on that byte, and so on leftwards. In every such order the
   lengths that neighbours share are compared byte for byte, 100 at most, and previous and next
   smaller positions give the LPFs; a string goes where its LPF is 100.

An anchor in more than ``hot_chunks`` chunks may have any number of contexts. Its strings are dealt
one by one on the fingerprint of their 100 bytes instead, each at most once by a chunk: what meets is a run that
shares them all, of which every string but the first has a smaller position before it.

Order of documents: doc_id, then text; rows without a doc_id come last. Texts that are null are
empty; texts shorter than the length are kept. Repeated rows are documents of their own: the first
one stays. Extra columns are ignored. The result holds one row per input row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.llm.common import U64, answer, ask, chunk_counts, chunked, ids_of, in_order, lean, mix, tell, texts_of

LENGTH = 100
ANCHOR = 32
HOT_CHUNKS = 255
#: Bytes of texts hashed at once.
BATCH = 250_000
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = U64(0x5851F42D4C957F2D)
_UNBASE = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))

ROWS = "_bucket int, kind int, a long, b long, owner long, _chunk int, ord int, s int, e int, m int, ctx binary"


class Fingerprints:
    """64-bit hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.r_[U64(1), np.full(len(data), _BASE)])
            self.sums = np.r_[U64(0), np.cumsum(_BYTE[data] * power[:-1])]
            self.undo = np.cumprod(np.r_[U64(1), np.full(len(data), _UNBASE)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.undo[start])


def _k_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte windows; k a power of two."""
    h, step, power = _BYTE[data], 1, int(_BASE)
    with np.errstate(over="ignore"):
        while step < k:
            h = h[:-step] * U64(power) + h[step:]
            step, power = step * 2, power * power % (1 << 64)
    return mix(h)


def _leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of that many values the position of the first smallest one."""
    value, at, step = h, np.arange(len(h), dtype=np.int32), 1
    while step * 2 <= width:
        less = value[step:] < value[:-step]
        at = np.where(less, at[step:], at[:-step])
        value = np.where(less, value[step:], value[:-step])
        step *= 2
    if rest := width - step:
        less = value[rest:] < value[:-rest]
        at = np.where(less, at[rest:], at[:-rest])
    return at


def anchors(texts: list[bytes], length: int = LENGTH, k: int = ANCHOR, contexts: bool = True):
    """Batches of (texts' bytes, doc, start, end, anchor, key, context hash): the strings that begin
    from start to end (both in the batch's bytes) have that anchor. doc counts the texts."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= BATCH):
            size += len(texts[last])
            last += 1
        data = np.frombuffer(b"".join(texts[first:last]), np.uint8)
        sizes = np.array([len(x) for x in texts[first:last]])
        if len(data) >= length:
            ends = np.repeat(np.cumsum(sizes), sizes)[: len(data) - length + 1]
            begins = np.arange(len(ends))
            whole = begins + length <= ends
            h = _k_hashes(data, k)
            at = _leftmost_minima(h, length - k + 1)
            cut = np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1]) | (ends[1:] != ends[:-1])]
            lo = np.flatnonzero(cut)
            hi = np.r_[lo[1:], len(at)] - 1
            lo, hi = lo[whole[lo]], hi[whole[lo]]
            doc = np.searchsorted(np.cumsum(sizes), lo, "right") + first
            context = None
            if contexts:
                context = Fingerprints(data).of(lo, hi + length)
                with np.errstate(over="ignore"):
                    context = mix(context + U64(512) * (at[lo] - lo).astype(np.uint64) + (hi - lo).astype(np.uint64))
            yield data, doc, lo, hi, at[lo].astype(np.int64), h[at[lo]], context, np.cumsum(sizes) - sizes, first
        first = last


def _later(keys: list[np.ndarray]) -> np.ndarray:
    """Which entries follow another one with the same keys; the last of the keys sorts first, and
    entries are given in the order of their positions."""
    order = np.lexsort(keys)
    same = np.ones(len(order) - 1, bool)
    for x in keys:
        same &= x[order[1:]] == x[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order[1:]] = same
    return out


def _ranges(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of a document as one; given in order."""
    if not len(doc):
        return doc, s, e
    reach = np.maximum.accumulate(doc.astype(np.int64) * (1 << 40) + e) - doc.astype(np.int64) * (1 << 40)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (s[1:] > reach[:-1])]
    return doc[new], s[new], np.maximum.reduceat(e, np.flatnonzero(new))


def _table(bucket, kind, a, b, owner, chunk, doc, s, e, m, ctx) -> pa.Table:
    n = len(doc)

    def column(x, kind):
        return pa.array(np.broadcast_to(x, n).astype(kind))

    return pa.table(
        {
            "_bucket": column(bucket, np.int32), "kind": column(kind, np.int32),
            "a": pa.array(np.broadcast_to(a, n).astype(np.uint64).view(np.int64)),
            "b": pa.array(np.broadcast_to(b, n).astype(np.uint64).view(np.int64)),
            "owner": column(owner, np.int64), "_chunk": column(chunk, np.int32), "ord": column(doc, np.int32),
            "s": column(s, np.int32), "e": column(e, np.int32), "m": column(m, np.int32),
            "ctx": pa.array(ctx if ctx is not None else [None] * n, pa.binary()),
        }
    )


RANGE, CONTEXT, STRING = 0, 1, 2


def _gathered(table: pa.Table, said: np.ndarray, buckets: int, length: int, k: int, hot: int) -> pa.Table:
    """What a chunk hands on: stretches to remove, contexts of anchors that occur elsewhere, and
    single strings of hot anchors."""
    table = in_order(table)
    chunk, owners = table["_chunk"][0].as_py(), ids_of(table)
    batches = list(anchors([x.encode() for x in texts_of(table)], length, k))
    if not batches:
        return _table(0, 0, 0, 0, 0, 0, np.empty(0, int), 0, 0, 0, None)
    every = np.concatenate([x[5] for x in batches])
    _, back, local = np.unique(mix(every), return_inverse=True, return_counts=True)  # in the order of keys_of
    times = np.maximum(said, local)[back]
    chunks_with = said[back]
    tables, found = [], []
    done = 0
    for data, doc, lo, hi, at, key, context, begins, first in batches:
        mine = slice(done, done + len(doc))
        done += len(doc)
        take = np.flatnonzero(times[mine] > 1)
        base = begins[doc[take] - first]
        found.append((doc[take], lo[take], hi[take], at[take], key[take], context[take], base, chunks_with[mine][take]))
    doc, lo, hi, at, key, context, base, with_key = (np.concatenate(x) for x in zip(*found, strict=True))
    batch = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    later = _later([context, key]) if len(doc) else np.empty(0, bool)
    s, e, m = lo - base, hi + length - base, at - base
    r_doc, r_s, r_e = _ranges(doc[later], s[later], e[later])
    tables.append(_table(r_s % buckets, RANGE, 0, 0, 0, chunk, r_doc, r_s, r_e, 0, None))
    is_hot = ~later & (with_key >= hot)
    cold = np.flatnonzero(~later & ~is_hot)
    ctx = [batches[b][0][x : y + length].tobytes() for b, x, y in zip(batch[cold], lo[cold], hi[cold], strict=True)]
    tables.append(
        _table(key[cold] % U64(buckets), CONTEXT, key[cold], context[cold], owners[doc[cold]], chunk, doc[cold], s[cold], e[cold], m[cold], ctx)
    )
    single = []
    for i in np.unique(batch[is_hot]):
        some = np.flatnonzero(is_hot & (batch == i))
        width = hi[some] - lo[some] + 1
        start = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo[some], width)
        which = np.repeat(some, width)
        single.append((which, start - base[which], Fingerprints(batches[i][0]).of(start, start + length)))
    if single:
        which, start, fp = (np.concatenate(x) for x in zip(*single, strict=True))
        later = _later([fp, key[which]])
        r_doc, r_s, r_e = _ranges(doc[which[later]], start[later], start[later] + length)
        tables.append(_table(r_s % buckets, RANGE, 0, 0, 0, chunk, r_doc, r_s, r_e, 0, None))
        which, start, fp = which[~later], start[~later], fp[~later]
        tables.append(_table(fp % U64(buckets), STRING, key[which], fp, owners[doc[which]], chunk, doc[which], start, start + length, 0, None))
    return pa.concat_tables(tables)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte highest."""
    padded, out = np.r_[data, np.zeros(8, np.uint8)], np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << U64(8)) | padded[i : i + len(data)]
    return out


def common_lengths(words: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, ``length`` at most, the stretch at each start shares with the one before it in the
    list; 0 for the first."""
    out, alike = np.zeros(len(start), np.int64), np.arange(1, len(start))
    for step in range(0, length, 8):
        differ = words[start[alike] + step] ^ words[start[alike - 1] + step]
        out[alike] += sum((differ < U64(1 << 8 * i)).astype(np.int64) for i in range(8))
        alike = alike[differ == 0]
    return np.minimum(out, length)


def _shared_with_smaller(position: np.ndarray, common: np.ndarray, steps: int) -> np.ndarray:
    """Bytes that each suffix shares with the nearest one before it that has a smaller position. Blocks of
    1, 2, 4, ... suffixes that end at a place hold their smallest position and the least shared length;
    the longest row of blocks without a smaller position is skipped, the larger blocks first."""
    least, shared, blocks = position, common, []
    for k in range(steps):
        blocks.append((least, shared))
        step = 1 << k
        if step >= len(position):
            break
        least = np.r_[least[:step], np.minimum(least[step:], least[:-step])]
        shared = np.r_[np.zeros(step, shared.dtype), np.minimum(shared[step:], shared[:-step])]
    out, at = common.copy(), np.arange(len(position)) - 1
    for k in range(len(blocks) - 1, -1, -1):
        least, shared = blocks[k]
        skip = np.flatnonzero((at >= 0) & (out > 0))
        skip = skip[least[at[skip]] > position[skip]]
        out[skip] = np.minimum(out[skip], shared[at[skip]])
        at[skip] -= 1 << k
    return out


def longest_previous(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factors of suffixes given in suffix order: common[i] is the length that i and
    i - 1 share, 0 where nothing before may be compared. The earlier suffix that shares most is the
    previous or the next one with a smaller position."""
    if not len(position):
        return common
    ends = np.flatnonzero(np.r_[common == 0, True])
    steps = int(np.diff(ends, prepend=0).max()).bit_length()
    before = _shared_with_smaller(position, common, steps)
    after = _shared_with_smaller(position[::-1], np.r_[0, common[:0:-1]], steps)
    return np.maximum(before, after[::-1])


def _suffix_ranges(key: np.ndarray, s: np.ndarray, e: np.ndarray, m: np.ndarray, blobs: list[bytes], length: int):
    """(entry, start, end) of the strings that an earlier context of the same anchor has too.
    Entries are given in the order of their positions."""
    n = len(key)
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = e - s
    off = np.cumsum(sizes) - sizes
    anchor = off + (m - s)
    _, group = np.unique(key, return_inverse=True)
    left, least = m - s, m - (e - length)  # strings start from `left` down to `least` bytes before the anchor
    right = np.minimum(off + sizes - anchor, length)
    grid = np.zeros((n, length), np.uint8)
    column = np.arange(length)
    inside = column[None, :] < right[:, None]
    grid[inside] = data[(anchor[:, None] + column[None, :])[inside]]
    order = np.argsort(grid.reshape(-1).view(f"S{length}"), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    words = _words(data)
    position = np.arange(n)
    out = []
    small = group.astype(np.uint16) if n <= 65536 else group
    for back in range(int(left.max()) + 1):
        if back:
            order = order[left[order] >= back]
            order = order[np.argsort(data[anchor[order] - back], kind="stable")]
            order = order[np.argsort(small[order], kind="stable")]
        here = order[least[order] <= back]
        if len(here) < 2:
            continue
        common = common_lengths(words, anchor[here] - back, length)
        common[1:][group[here[1:]] != group[here[:-1]]] = 0
        if (common == length).any():
            gone = here[longest_previous(position[here], common) == length]
            out.append((gone, m[gone] - back))
    if not out:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _resolved(table: pa.Table, length: int) -> pa.Table:
    """Stretches to remove from the rows of a bucket."""
    table = table.sort_by([(c, "ascending") for c in ("owner", "_chunk", "ord", "s")])
    kind = table["kind"].to_numpy()
    keep = [table.filter(pa.array(kind == RANGE)).select(["_chunk", "ord", "s", "e"])]

    def stretches(chunk, doc, s, e):
        order = np.lexsort((s, doc, chunk))
        one = chunk[order].astype(np.int64) * (1 << 32) + doc[order]
        _, which = np.unique(one, return_inverse=True)
        r_doc, r_s, r_e = _ranges(which, s[order], e[order])
        first = order[np.searchsorted(which, r_doc)]
        return pa.table(
            {
                "_chunk": pa.array(chunk[first], pa.int32()), "ord": pa.array(doc[first], pa.int32()),
                "s": pa.array(r_s, pa.int32()), "e": pa.array(r_e, pa.int32()),
            }
        )

    for what in (CONTEXT, STRING):
        some = table.filter(pa.array(kind == what))
        if not len(some):
            continue
        a, b, chunk, doc, s, e, m = (some[c].to_numpy() for c in ("a", "b", "_chunk", "ord", "s", "e", "m"))
        s, e, m = (x.astype(np.int64) for x in (s, e, m))
        later = _later([b, a])
        keep.append(stretches(chunk[later], doc[later], s[later], e[later]))
        if what == CONTEXT:
            left = np.flatnonzero(~later)
            _, back, times = np.unique(a[left], return_inverse=True, return_counts=True)
            left = left[times[back] > 1]
            if len(left):
                blobs = some["ctx"].take(pa.array(left)).to_pylist()
                entry, start = _suffix_ranges(a[left], s[left], e[left], m[left], blobs, length)
                at = left[entry]
                keep.append(stretches(chunk[at], doc[at], start, start + length))
    return pa.concat_tables(keep)


def repeated_spans_removed(
    df: DataFrame, length: int = LENGTH, k: int = ANCHOR, hot_chunks: int = HOT_CHUNKS, chunk_bytes: int | None = None, rest: bool = False
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (start, end of the maximal removed runs, in bytes)
    and kept, the remaining bytes. With rest also kept_text, the remaining characters (a character of
    which a cut leaves a part goes), and rest, a struct of all columns but text."""
    columns = [F.struct(*[f"`{c}`" for c in df.columns if c != "text"]).alias("rest")] if rest else []
    chunks, n = chunked(df, columns, **({"chunk_bytes": chunk_bytes} if chunk_bytes else {}))
    buckets = 4 * n

    def keys_of(table: pa.Table):
        texts = [x.encode() for x in texts_of(table)]
        found = [x[5] for x in anchors(texts, length, k, contexts=False)]
        # minima of many hashes lie at the low end of the key space; mixed, they fill all buckets alike
        return np.unique(mix(np.concatenate(found))) if found else np.empty(0, np.uint64), np.empty(0, np.int64)

    def finish(table: pa.Table, ranges: pa.Table) -> pa.Table:
        table = in_order(table)
        ranges = ranges.sort_by([("ord", "ascending"), ("s", "ascending")])
        doc, s, e = _ranges(*(ranges[c].to_numpy().astype(np.int64) for c in ("ord", "s", "e")))
        at = np.searchsorted(doc, np.arange(len(table) + 1))
        out = {"n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for i, text in enumerate(texts_of(table)):
            text = text.encode()
            spans = list(zip(s[at[i] : at[i + 1]].tolist(), e[at[i] : at[i + 1]].tolist(), strict=True))
            begins, ends = [0, *(y for _, y in spans)], [*(x for x, _ in spans), len(text)]
            kept = b"".join(text[x:y] for x, y in zip(begins, ends, strict=True)) if spans else text
            for name, value in zip(out, (len(text), len(text) - len(kept), spans, kept), strict=True):
                out[name].append(value)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "spans": pa.array([[{"start": x, "end": y} for x, y in z] for z in out["spans"]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(out["kept"], pa.binary()),
                **({"kept_text": pa.array([x.decode(errors="ignore") for x in out["kept"]], pa.string()), "rest": table["rest"]} if rest else {}),
            }
        )

    answers = answer(ask(chunks, keys_of, n), chunk_counts)
    gathered = tell(chunks, answers, lambda t, said: _gathered(t, said, buckets, length, k, hot_chunks), ROWS)
    ranges = gathered.groupBy("_bucket").applyInArrow(lambda t: lean(lambda x: _resolved(x, length), t), "_chunk int, ord int, s int, e int")
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
    if rest:
        schema = schema.add("kept_text", "string").add(chunks.schema["rest"])
    return chunks.groupBy("_chunk").cogroup(ranges.groupBy("_chunk")).applyInArrow(lambda table, found: lean(finish, table, found), schema)
