"""Substring dedup by sliding sentence spans: every run of several consecutive sentences is hashed,
the hashes are joined over all documents, and the sentences of every run but the first of its kind
are removed.

Sentences end at ., ! or ? before white space and at line breaks; they are compared without regard to
case (A to Z) and white space. A run has at least ``least`` sentences and ``min_words`` words, so that
chance repeats of a few short sentences are no passage. The shortest runs that begin and that end at
every sentence stand for all: any run is covered by those inside it, so its sentences go if and
only if they go for one of these. The first of its kind is that of the smallest doc_id, then the
first in the document. The join asks about each chunk's distinct hashes only (``common.ask``), so a
passage that a third of all documents hold is one entry per chunk.

Defined results: null and empty texts have no sentences and stay as they are (null: empty). Texts
too short for a run are kept. Repeated rows are documents of their own: the first one stays. Rows
without a doc_id come last. Extra columns are ignored. The result holds one row per input row."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from cohortlens.llm.common import U64, answer, ask, chunked, ids_of, in_order, mix, tell, who_is_first

SENTENCES = 2
MIN_WORDS = 20
_END = re.compile(r"[.!?]+(?=\s)|\n")
_BASE = U64(0x5851F42D4C957F2D)
_UNBASE = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches of a text that sentences fill; together they are the text."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True))


class Runs:
    """The runs of the texts of a chunk: doc and first and last sentence (numbered over the chunk) and
    key of each, in the order of their positions."""

    def __init__(self, texts: list[str], least: int, min_words: int):
        self.cuts = [sentences(x) if x else [] for x in texts]
        hashes, words = [], []
        for text, cut in zip(texts, self.cuts, strict=True):
            for a, b in cut:
                found = text[a:b].encode().lower().split()
                words.append(len(found))
                hashes.append(xxhash.xxh3_64_intdigest(b" ".join(found)) if found else 0)
        sizes = np.array([len(x) for x in self.cuts], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.total = int(sizes.sum())
        # sentences without words belong to no run and don't part one
        real = np.flatnonzero(np.array(words, np.int64) > 0)
        h, w = np.array(hashes, np.uint64)[real], np.array(words, np.int64)[real]
        doc = np.repeat(np.arange(len(sizes)), sizes)[real]
        n = len(real)
        upto = np.r_[0, np.cumsum(w)]
        last = np.maximum(np.searchsorted(upto, upto[:-1] + min_words) - 1, np.arange(n) + least - 1)
        start = np.minimum(np.searchsorted(upto, upto[1:] - min_words, "right") - 1, np.arange(n) - least + 1)
        begins = np.flatnonzero(last < np.searchsorted(doc, doc, "right"))
        ends = np.flatnonzero(start >= np.searchsorted(doc, doc))
        start, last = np.divmod(np.unique(np.r_[begins * n + last[begins], start[ends] * n + ends]), max(n, 1))
        with np.errstate(over="ignore"):
            power = np.cumprod(np.r_[U64(1), np.full(n, _BASE)])
            sums = np.r_[U64(0), np.cumsum(mix(h) * power[:-1])]
            undo = np.cumprod(np.r_[U64(1), np.full(n, _UNBASE)])
            self.key = mix((sums[last + 1] - sums[start]) * undo[start] + (last - start).astype(np.uint64))
        self.doc, self.first, self.last = doc[start], real[start], real[last]


def spans_removed(df: DataFrame, least: int = SENTENCES, min_words: int = MIN_WORDS, chunk_bytes: int | None = None) -> DataFrame:
    """Per row: doc_id, n_sentences, n_removed (sentences), removed_chars and text, what remains."""
    chunks, n = chunked(df, **({"chunk_bytes": chunk_bytes} if chunk_bytes else {}))

    def runs_of(table: pa.Table) -> tuple[pa.Table, list[str], Runs]:
        table = in_order(table)
        texts = [x or "" for x in table["text"].to_pylist()]
        return table, texts, Runs(texts, least, min_words)

    def keys_of(table: pa.Table):
        table, _, runs = runs_of(table)
        keys, at = np.unique(runs.key, return_index=True)
        return keys, ids_of(table)[runs.doc[at]]

    def finish(table: pa.Table, said: np.ndarray) -> pa.Table:
        table, texts, runs = runs_of(table)
        _, at, back = np.unique(runs.key, return_index=True, return_inverse=True)
        gone = (said[back] == 2) | (at[back] != np.arange(len(back)))
        change = np.zeros(runs.total + 1, np.int64)
        np.add.at(change, runs.first[gone], 1)
        np.add.at(change, runs.last[gone] + 1, -1)
        removed = np.cumsum(change)[:-1] > 0
        kept, counts = [], []
        for text, cut, begin in zip(texts, runs.cuts, runs.begins, strict=True):
            mine = removed[begin : begin + len(cut)]
            counts.append(int(mine.sum()))
            kept.append("".join(text[a:b] for (a, b), r in zip(cut, mine, strict=True) if not r) if counts[-1] else text)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_sentences": pa.array([len(x) for x in runs.cuts], pa.int64()),
                "n_removed": pa.array(counts, pa.int64()),
                "removed_chars": pa.array([len(a) - len(b) for a, b in zip(texts, kept, strict=True)], pa.int64()),
                "text": pa.array(kept, pa.string()),
            }
        )

    answers = answer(ask(chunks, keys_of, n), who_is_first)
    return tell(chunks, answers, finish, "doc_id long, n_sentences long, n_removed long, removed_chars long, text string")
