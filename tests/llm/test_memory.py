"""What a Python worker needs at once and keeps afterwards: executors hold several of them."""

from __future__ import annotations

import ctypes
import random
import re
import tracemalloc
from pathlib import Path
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import common, jaccard, langid, lpf, packing
from cohortlens.llm.tokens import path_of


def held_mb() -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def peak_mb(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def texts(n: int, words: int) -> list[str]:
    draw = random.Random(5)
    return [" ".join(f"w{draw.randrange(1 << 30):x}" for _ in range(words)) for _ in range(n)]


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library gives nothing back on demand")
def test_freed_memory_of_a_group_is_given_back():
    kept, table = [], pa.table({"text": ["x" * 1000] * 2000})

    def group(table):
        made = [bytes(600) for _ in range(200_000)]  # small pieces, not given back when freed ...
        kept.append(made[::20_000] + [bytes(600)])  # ... as a few of them stay
        kept.append(held_mb())
        return table

    before = held_mb()
    assert common.lean(group, table) is table
    after, full = held_mb(), kept[1]
    assert full - before > 90
    assert after - before < 30


def test_anchors_are_found_in_small_steps():
    data = [x.encode() for x in texts(300, 1000)]
    size = sum(map(len, data)) / 1e6
    assert size > 2
    assert peak_mb(lambda: [x[5] for x in lpf.anchors(data, contexts=False)]) < 10 * size


def test_new_words_are_scored_some_at_a_time(monkeypatch):
    asked, score = [], langid.word_scores
    monkeypatch.setattr(langid, "word_scores", lambda model, words: asked.append(len(words)) or score(model, words))
    model = langid.Model(["a", "b"], np.random.default_rng(1).random((2, langid.CELLS), np.float32), np.ones((2, len(langid._NAMES)), bool))
    words = sorted({w for x in texts(60, 1000) for w in langid._WORD.findall(x)})
    parts = np.concatenate([score(model, words[i : i + 700]) for i in range(0, len(words), 700)])
    assert (parts == score(model, words)).all()
    rows = _rows_of(langid.label_spans, model)
    spelt = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(60_000)]
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array([" ".join(spelt[i : i + 100]) for i in range(0, len(spelt), 100)])], ["text"])], names=["row"])
    made = pa.Table.from_batches(list(rows(iter([batch]))))
    assert made.num_rows == 600
    assert sum(asked) == 60_000 and max(asked) <= 20_000


def _rows_of(operator, *args):
    """The function that an operator hands to mapInArrow."""
    class Frame:
        columns = ["text"]
        schema = {"row": None}

        def __init__(self):
            self.sparkSession = mock.Mock()
            self.sparkSession.sparkContext.broadcast = lambda value: mock.Mock(value=value)

        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            return f

    with mock.patch.object(langid, "StructType"), mock.patch.object(langid, "F"), mock.patch.object(packing, "F"):
        return operator(Frame(), *args)


def test_texts_are_encoded_some_at_a_time():
    cut = _rows_of(packing.pieces, path_of("word_bpe_49k.json"), 0)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2500)), "text": [f"text {i}" for i in range(2499)] + [None]})
    made = list(cut(iter([batch])))
    assert [x.num_rows for x in made] == [1000, 1000, 500]
    assert pa.Table.from_batches(made)["doc_id"].to_pylist() == list(range(2500))


def test_distinct_keys_and_which_repeat():
    for n in (0, 1, 2, 500):
        keys = np.random.default_rng(n).integers(0, 300, n).astype(np.uint64)
        want, times = np.unique(keys, return_counts=True)
        got, again = jaccard._distinct(keys.copy())
        assert (got == want).all() and (again == (times > 1)).all()
    sets = [np.arange(i, i + 1_000_000, dtype=np.uint64) for i in range(2)]
    assert peak_mb(lambda: jaccard._distinct(jaccard._join(sets))) < 3 * 16
