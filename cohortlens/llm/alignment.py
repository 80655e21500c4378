"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which tokens of another.

Both tokenizers spell the same bytes, so their tokens are two ways to cut one string. Where a token of each
ends at the same byte, both sides can be cut. Divide and conquer: in an interval the byte end of the
A token in the middle is looked up among the B ends by bisect, then its neighbours' ends, the nearest
first; a common end cuts the interval, and both halves go on. An interval without one is a leaf: a group of
A and B tokens that only belong together as a whole. All intervals of a level, of all documents at hand, are
bisected at once, and ends of different documents are ends of both sides anyway.

A link is a pair of an A and a B token that share bytes; an id pair's count is the number of its links
in all documents. Documents are encoded and cut once, in chunks of bounded size that also sum up their id pairs;
the sums meet by id pair, the best A ids of each B id are found, and every chunk gets the counts of its own pairs
back: a few thousand rows a chunk, however many links it has.

Defined results: a text that is null or empty, or whose A or B tokens don't spell a space and the text (a
piece file writes its own space mark, so a text with that character is one), has no tokens: zeros and an empty
groups column. Strings of special tokens are plain text. Repeated rows and rows without a doc_id are aligned
like any other and count. An empty table gives no rows. Extra columns are ignored. The encoded table and
the counts are settled when the plan is built."""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import single_threaded
from cohortlens.llm.tokens import LETTERS, encoder, library
from cohortlens.operators.scale import salted_left_join, settle

#: Bytes of text in a chunk, and in one step of the work.
CHUNK_BYTES = 16_000_000
STEP_BYTES = 2_000_000
#: Ends beside the middle that are tried one by one before all of an interval.
NEAR = 4
SPACE_MARK = "▁"


class Side:
    """Bytes and lengths of a vocabulary's tokens, and their ids as decimal text before a separator."""

    def __init__(self, spelt: list[bytes]):
        self.spelt = np.array([*spelt, None], object)[:-1]
        self.sizes = np.array([len(x) for x in spelt], np.int64)
        self.decimal = {end: np.array([b"%d%b" % (i, end) for i in range(len(spelt))] + [None], object)[:-1] for end in (b",", b"|", b";", b"")}


@cache
def byte_side(path: str) -> Side:
    """A byte-level file of the tokenizers library."""
    whole, back = library(path, True), {ord(c): b for b, c in LETTERS.items()}
    tokens = (whole.id_to_token(i) or "" for i in range(whole.get_vocab_size()))
    return Side([x.translate(back).encode("latin-1") if all(ord(c) in back for c in x) else x.encode() for x in tokens])


@cache
def piece_model(path: str):
    single_threaded()
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def piece_side(path: str) -> Side:
    """A piece file: bytes are written <0xHH>, the space mark is a space."""
    model = piece_model(path)
    pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return Side([bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace(SPACE_MARK, " ").encode() for i, x in pieces])


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For every A token whether a cut follows it. a, b: ascending byte ends; first, last: the intervals to
    begin with, as numbers of A tokens; the end of each is an end of both."""
    cut = np.zeros(len(a), bool)
    cut[last] = True
    lo, hi = first, last  # ends lo to hi - 1 are inside
    while True:
        inside = lo < hi
        lo, hi = lo[inside], hi[inside]
        if not len(lo):
            return cut
        middle, found = (lo + hi) // 2, np.full(len(lo), -1)
        still = np.arange(len(lo))
        for step in [s for d in range(NEAR) for s in ((d, -d) if d else (0,))]:
            at = middle[still] + step
            at_inside = (at >= lo[still]) & (at < hi[still])
            at = np.where(at_inside, at, lo[still])
            hit = b[np.searchsorted(b, a[at])] == a[at]
            hit &= at_inside
            found[still[hit]] = at[hit]
            still = still[~hit]
            if not len(still):
                break
        still = still[hi[still] - lo[still] > NEAR]
        if len(still):  # long intervals without a common end near the middle: the nearest of all
            sizes = hi[still] - lo[still]
            of = np.repeat(np.arange(len(still)), sizes)
            at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo[still], sizes)
            hit = b[np.searchsorted(b, a[at])] == a[at]
            of, at = of[hit], at[hit]
            order = np.lexsort((np.abs(at - middle[still][of]), of))
            of, at = of[order], at[order]
            nearest = np.r_[True, of[1:] != of[:-1]] if len(of) else np.empty(0, bool)
            found[still[of[nearest]]] = at[nearest]
        split = found >= 0
        lo, hi, found = lo[split], hi[split], found[split]
        cut[found] = True
        lo, hi = np.column_stack((lo, found + 1)).ravel(), np.column_stack((found, hi)).ravel()


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of A token, number of B token) of all pairs that share bytes. a, b: byte ends."""
    holds = np.searchsorted(b, a)  # the B token that the end of an A token lies in
    begins = np.zeros(len(a), np.int64)
    if len(a):
        begins[1:] = holds[:-1] + (b[holds[:-1]] == a[:-1])
    width = holds - begins + 1
    left = np.repeat(np.arange(len(a)), width)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begins, width)


class Aligned:
    """Documents of a step: tokens a and b (ids of all documents after each other), tokens by document."""

    def __init__(self, left: Side, right: Side, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        self.left, self.right = left, right
        self.a_ends, self.b_ends = np.cumsum(left.sizes[a]), np.cumsum(right.sizes[b])
        self.at_a, self.at_b = np.cumsum(n_a), np.cumsum(n_b)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The id pair of every link and the number of links up to the end of every document."""
        i, j = links(self.a_ends, self.b_ends)
        upto = np.searchsorted(i, self.at_a)
        return (self.a[i].astype(np.int64) << 32) | self.b[j].astype(np.int64), upto

    def groups(self) -> tuple[np.ndarray, list[bytes]]:
        """Groups by document, and their text."""
        some = self.n_a > 0
        last = self.at_a[some] - 1
        cut = shared_cuts(self.a_ends, self.b_ends, self.at_a[some] - self.n_a[some], last)
        cut_a = np.flatnonzero(cut)
        cut_b = np.searchsorted(self.b_ends, self.a_ends[cut_a])
        group_a = np.cumsum(cut) - cut
        b_cut = np.zeros(len(self.b), bool)
        b_cut[cut_b] = True
        group_b = np.cumsum(b_cut) - b_cut
        texts_a = np.where(cut, self.left.decimal[b"|"][self.a], self.left.decimal[b","][self.a])
        texts_b = np.where(b_cut, self.right.decimal[b";"][self.b], self.right.decimal[b","][self.b])
        ends_b = self.at_b[some] - 1
        texts_b[ends_b] = self.right.decimal[b""][self.b[ends_b]]
        # tokens in the order of the text: a group's A tokens, then its B tokens
        text = np.empty(len(self.a) + len(self.b), object)
        text[np.arange(len(self.a)) + np.r_[0, cut_b + 1][group_a]] = texts_a
        text[np.arange(len(self.b)) + (cut_a + 1)[group_b]] = texts_b
        ends = self.at_a + self.at_b
        begins = ends - self.n_a - self.n_b
        made = [b"".join(text[s:e].tolist()) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
        n = np.diff(np.r_[0, np.searchsorted(cut_a, self.at_a)])
        return n, made


def _steps(sizes: list[int], most: int):
    """Ranges of rows of about that many bytes."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


ENCODED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary, pairs binary, counts binary"


def encoded(df: DataFrame, byte_path: str, piece_path: str, with_groups: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each document, its links as numbers of the chunk's id pairs (little-endian, 16 bits each if that
    is enough for the row, else 32), and one for each chunk with those pairs and their counts."""

    def rows(batches):
        left, right, model = byte_side(byte_path), piece_side(piece_path), piece_model(piece_path)
        encode, part = encoder(byte_path, False, True).encode, TaskContext.get().partitionId()
        number, held, known, counts = part << 32, 0, {}, np.empty(0, np.int64)

        def summary():
            pairs = np.fromiter(known, np.int64, len(known))
            return _record({"chunk": [number], "pairs": [pairs.tobytes()], "counts": [counts.tobytes()]})

        for batch in batches:
            texts = [x.encode() if x else b"" for x in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            for s, e in _steps([len(x) for x in texts], STEP_BYTES):
                size = sum(map(len, texts[s:e]))
                if held and held + size > chunk_bytes:
                    yield summary()
                    number, held, known, counts = number + 1, 0, {}, np.empty(0, np.int64)
                held += size + 1
                strings = [x.decode() for x in texts[s:e]]
                a = [np.frombuffer(encode(" " + x), "<u4") if x else np.empty(0, "<u4") for x in strings]
                b = [np.array(x, "<u4") for x in model.encode(strings, num_threads=1)]
                for k, text in enumerate(texts[s:e]):
                    want = b" " + text
                    if not text or b"".join(left.spelt[a[k]]) != want or b"".join(right.spelt[b[k]]) != want:
                        a[k] = b[k] = np.empty(0, "<u4")
                both = Aligned(left, right, np.concatenate(a), np.concatenate(b), np.array([len(x) for x in a]), np.array([len(x) for x in b]))
                n_groups, groups = both.groups()
                pairs, upto = both.pairs()
                kinds, inverse = np.unique(pairs, return_inverse=True)
                # a chunk's pairs are numbered as they first occur
                numbers = np.array([known.setdefault(x, len(known)) for x in kinds.tolist()], np.int64)
                used = numbers[inverse]
                counts = np.r_[counts, np.zeros(len(known) - len(counts), np.int64)] + np.bincount(used, minlength=len(known))
                kind = "<u2" if len(known) <= 1 << 16 else "<u4"
                made, begins = used.astype(kind), np.r_[0, upto]
                yield _record(
                    {
                        "chunk": [number] * (e - s), "doc_id": ids[s:e], "n_a": both.n_a, "n_b": both.n_b, "n_groups": n_groups,
                        "n_links": np.diff(begins), "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in groups],
                        "groups": [x.decode() for x in groups] if with_groups else None,
                        "links": [made[x:y].tobytes() for x, y in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)],
                    }
                )
        if held:
            yield summary()

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, ENCODED)


_KINDS = {"groups_sha256": pa.string(), "groups": pa.string()} | {c: pa.binary() for c in ("links", "pairs", "counts")}


def _record(columns: dict) -> pa.RecordBatch:
    """A batch of the encoded table; columns not given are null."""
    n = len(columns["chunk"])
    names = [x.split()[0] for x in ENCODED.split(", ")]
    given = {c: columns.get(c) if columns.get(c) is not None else [None] * n for c in names}
    return pa.RecordBatch.from_arrays([pa.array(given[c], _KINDS.get(c, pa.int64())) for c in names], names=names)


def pair_counts(stored: DataFrame) -> DataFrame:
    """(chunk, number, pair, n): the id pairs of every chunk."""

    def rows(batches):
        for batch in batches:
            for chunk, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "counts")), strict=True):
                found = np.frombuffer(pairs, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), chunk)), pa.array(np.arange(len(found))), pa.array(found), pa.array(np.frombuffer(counts, np.int64))],
                    names=["chunk", "number", "pair", "n"],
                )

    return stored.where("pairs IS NOT NULL").select("chunk", "pairs", "counts").mapInArrow(rows, "chunk long, number long, pair long, n long")


def aligned(df: DataFrame, byte_path: str, piece_path: str, with_groups: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B id),
    count_sum (of the counts of its links), groups_sha256, and with_groups the groups as text."""
    stored, _ = settle(encoded(df, byte_path, piece_path, with_groups, chunk_bytes))
    asked = pair_counts(stored)
    counts, _ = settle(asked.groupBy("pair").agg(F.sum("n").alias("count")))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("highest"))
    judged = counts.withColumn("b_id", b_id).join(highest, "b_id").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    told = salted_left_join(asked.select("chunk", "number", "pair"), [judged], ["pair"]).select("chunk", "number", "count", "best")

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        got = got.sort_by([("number", "ascending")])
        count, best = got["count"].to_numpy(), got["best"].to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, blobs = table["n_links"].to_pylist(), table["links"].to_pylist()
        n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for i, (n, blob) in enumerate(zip(sizes, blobs, strict=True)):
            if n:
                used = np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4")
                n_best[i], count_sum[i] = best[used].sum(), count[used].sum()
        table = table.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
        return table.select(names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    docs = stored.where("pairs IS NULL").drop("pairs", "counts", *([] if with_groups else ["groups"]))
    # two chunks a task, however many there are
    docs = docs.repartition(max(1, math.ceil(stored.where("pairs IS NOT NULL").count() / 2)), "chunk")
    return docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, schema + (", groups string" if with_groups else ""))
