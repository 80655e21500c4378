"""N-gram Jaccard join, suffix-array dedup and sentence spans against plain versions."""

import hashlib
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from cohortlens.llm import jaccard, lpf, sentence_spans
from cohortlens.llm.common import ask, blocks
from tests.llm.common import LONG, TEXT, corpus, docs, empty, messy


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(pairs):
    sets = [(i, shingle_set(t)) for i, t in pairs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("seed", [0, 1])
def test_components_match_a_plain_join(spark, seed):
    pairs = corpus(seed)
    got = jaccard.jaccard_components(docs(spark, pairs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(pairs)
    assert any(r.component_id != r.doc_id for r in got)


def test_components_in_small_blocks(spark):
    base = " ".join(f"w{i}" for i in range(120))
    chain = [" ".join(f"w{i}" for i in range(3 * k, 120 + 3 * k)) for k in range(12)]
    pairs = list(enumerate([*chain, base + " more words here", *corpus(3, 20, 2)[0][1:]]))
    got = jaccard.jaccard_components(docs(spark, pairs), block=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(pairs)


def test_blocks_of_a_group_that_share_nothing(spark):
    a, b = np.arange(8, dtype=np.uint64), np.arange(20, 28, dtype=np.uint64)
    n = np.array([8])
    assert jaccard.product([a], [b], n, n, False, 75).shape == (0, 2)
    # a chain is one group, its ends have no shingle in common
    chain = [" ".join(f"w{i}" for i in range(6 * k, 60 + 6 * k)) for k in range(40)]
    longer = [f"{x} " + " ".join(f"v{k}.{i}" for i in range(4)) for k, x in enumerate(chain)]
    pairs = list(enumerate([*chain, *longer]))
    got = jaccard.jaccard_components(docs(spark, pairs), block=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(pairs)
    assert {r.component_id for r in got} == {0}


def test_bound_is_inclusive():
    a, b = np.arange(8, dtype=np.uint64), np.arange(6, dtype=np.uint64)
    n = np.array([8]), np.array([6])
    assert len(jaccard.product([a], [b], *n, False, 75)) == 1  # 6 of 8
    assert len(jaccard.product([a], [b[:5]], n[0], np.array([5]), False, 75)) == 0


def test_product_of_near_copies_in_bounded_memory():
    """A block of 1,000 near copies: 33 million increments, added up a few rows of the counts at a time."""
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**60, 260).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(150, 220), replace=False)) for _ in range(1000)]
    n = np.array([len(s) for s in sets])
    tracemalloc.start()
    made = jaccard.product(sets, sets, n, n, True, 75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    held = np.array([np.isin(pool, s) for s in sets]).astype(np.int64)
    both = held @ held.T
    linked = np.triu(100 * both >= 75 * (n[:, None] + n[None, :] - both), 1)
    assert len(made) and np.array_equal(made, np.argwhere(linked))


def test_components_of_awkward_rows(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(messy(spark)).collect()]
    assert len(got) == 16
    assert (2, 0, 2) in got and (3, 0, 3) in got and (5, 0, 5) in got
    assert got.count((4, len(shingle_set(TEXT)), 1)) == 2
    assert (None, len(shingle_set(TEXT)), None) in got and (None, 0, None) in got
    assert (9, 1, 9) in got
    assert (10, len(shingle_set(LONG + " end")), 6) in got
    assert jaccard.jaccard_components(empty(spark)).collect() == []


def plain_spans(pairs, length):
    seen, out = set(), {}
    for i, t in sorted(pairs):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - length + 1):
            w = data[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "chunk"), [(255, None), (1, None), (1, 3000), (255, 3000)])
def test_spans_match_a_plain_scan(spark, hot, chunk):
    pairs = corpus(5) + [(1000, "ab" * 400), (1001, "xab" * 3 + "ab" * 200), (1002, "z" * 99), (1003, "z" * 100), (1004, "y" + "z" * 100)]
    got = lpf.repeated_spans_removed(docs(spark, pairs), hot_chunks=hot, chunk_bytes=chunk).collect()
    mine = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got}
    assert mine == plain_spans(pairs, 100)


@pytest.mark.parametrize("seed", range(6))
def test_short_alphabets(spark, seed, monkeypatch):
    import random

    rng = random.Random(seed)
    monkeypatch.setattr(lpf, "BATCH", rng.choice([60, 700]))
    alphabet = rng.choice(["ab", "aé\n", "abcdef"])
    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 200))) for _ in range(4)]
    pairs = [(i, "".join(rng.choice(pieces)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 5)))) for i in range(25)]
    got = lpf.repeated_spans_removed(docs(spark, pairs), 24, 8, chunk_bytes=500).collect()
    mine = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got}
    assert mine == plain_spans(pairs, 24)


def test_spans_of_awkward_rows(spark):
    made = lpf.repeated_spans_removed(messy(spark))
    got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed) for r in made.collect()), key=str)
    assert len(got) == 16
    assert [x[2:] for x in got if x[1] == 1] == [(len(TEXT), 0)]
    assert [x[3] for x in got if x[1] == 4] == [0, 0]  # shorter than 100 bytes
    long = [x for x in got if x[1] == 10]
    assert long[0][3] >= len(LONG) - 1
    assert lpf.repeated_spans_removed(empty(spark)).collect() == []
    carried = lpf.repeated_spans_removed(messy(spark), rest=True).collect()
    assert len(carried) == 16 and {r.rest.rest for r in carried} == {5} and {r.rest.matches for r in carried} == {"m"}


def test_kept_text_has_whole_characters(spark):
    text = "é" * 60
    made = lpf.repeated_spans_removed(docs(spark, [(1, text), (2, "a" + text[:-3] + "b")]), rest=True)
    by_id = {r.doc_id: r for r in made.collect()}
    assert by_id[1].kept.startswith("é".encode()) and by_id[1].n_removed > 0
    assert by_id[2].kept_text == by_id[2].kept.decode(errors="ignore")


def test_anchors_are_asked_about_in_even_blocks(spark, monkeypatch):
    import pyarrow as pa

    asked = []
    monkeypatch.setattr(lpf, "ask", lambda chunks, keys_of, n: (asked.append(keys_of), ask(chunks, keys_of, n))[1])
    lpf.repeated_spans_removed(docs(spark, corpus(5)))
    keys, _ = asked[0](pa.table({"doc_id": [1], "text": [LONG]}))
    sizes = np.diff(blocks(keys, 16))
    assert sizes.sum() == len(keys) > 500 and sizes.max() < 2 * sizes.mean()


def shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(30))
def test_longest_previous_factors_match_a_plain_scan(seed):
    import random

    rng = random.Random(seed)
    length = rng.choice([8, 13, 24])
    text = bytes(rng.choice(b"ab" if seed % 2 else b"abc") for _ in range(rng.randint(1, 150))) + b"b" * rng.choice([0, 40])
    text += text[: rng.randint(0, 60)]
    starts = np.arange(max(0, len(text) - length + 1))
    order = np.array(sorted(starts, key=lambda i: text[i : i + length]), int)  # ties by position
    common = lpf.common_lengths(lpf._words(np.frombuffer(text, np.uint8)), order, length)
    suffixes = [text[i : i + length] for i in order]
    assert common.tolist() == [0] * (len(order) > 0) + [shared(x, y) for x, y in zip(suffixes, suffixes[1:], strict=False)]
    found = dict(zip(order.tolist(), lpf.longest_previous(order, common).tolist(), strict=True))
    for i in starts:
        assert found[i] == max((shared(text[i : i + length], text[j : j + length]) for j in range(i)), default=0)


def test_longest_previous_factors_stay_within_groups():
    position, common = np.array([3, 0, 2, 1]), np.array([0, 100, 40, 0])
    assert lpf.longest_previous(position, common).tolist() == [100, 0, 40, 0]
    assert lpf.longest_previous(np.empty(0, int), np.empty(0, int)).tolist() == []


def plain_sentence_spans(pairs, least, min_words):
    seen, out = {}, {}
    for i, t in sorted(pairs):
        t = t or ""
        cut = sentences = sentence_spans.sentences(t) if t else []
        words = [t[a:b].encode().lower().split() for a, b in cut]
        real = [k for k, w in enumerate(words) if w]
        gone = set()
        for x in range(len(real)):
            for y in range(x + least - 1, len(real)):
                run = real[x : y + 1]
                if sum(len(words[k]) for k in run) >= min_words:
                    key = tuple(b" ".join(words[k]) for k in run)
                    if key in seen:
                        gone.update(range(run[0], run[-1] + 1))
                    seen.setdefault(key, (i, x))
                    break
        out[i] = (len(sentences), len(gone), "".join(t[a:b] for k, (a, b) in enumerate(cut) if k not in gone))
    return out


@pytest.mark.parametrize("chunk", [None, 2000])
def test_sentence_spans_match_a_plain_scan(spark, chunk):
    pairs = corpus(9)
    got = sentence_spans.spans_removed(docs(spark, pairs), 2, 8, chunk_bytes=chunk).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in got} == plain_sentence_spans(pairs, 2, 8)
    assert sum(r.n_removed > 0 for r in got) > 5


def plain_spans_of_all_runs(pairs, least, min_words):
    seen, out = set(), {}
    for i, t in sorted(pairs):
        cut = sentence_spans.sentences(t) if t else []
        words = [t[a:b].encode().lower().split() for a, b in cut]
        real = [k for k, w in enumerate(words) if w]
        gone = set()
        for x in range(len(real)):
            for y in range(x + least, len(real) + 1):
                key = tuple(b" ".join(words[k]) for k in real[x:y])
                if sum(len(words[k]) for k in real[x:y]) >= min_words:
                    if key in seen:
                        gone.update(range(real[x], real[y - 1] + 1))
                    seen.add(key)
        out[i] = (len(cut), len(gone), "".join(t[a:b] for k, (a, b) in enumerate(cut) if k not in gone))
    return out


@pytest.mark.parametrize(("least", "min_words", "chunk"), [(2, 20, None), (2, 20, 900), (3, 12, 900), (2, 0, 900)])
def test_sentence_spans_match_all_runs(spark, least, min_words, chunk):
    import random

    rng = random.Random(least * min_words)

    def prose(k):
        return [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", "\n", ".\n\n"]) for _ in range(k)]

    passages = [prose(rng.randint(2, 9)) for _ in range(8)]
    texts = [" ".join(x for _ in range(rng.randint(0, 3)) for x in prose(rng.randint(0, 4)) + rng.choice(passages)) for _ in range(60)]
    # the tail of a repeated passage: fewer words than a run has, then foreign text
    head, tail = " ".join(f"w{i}" for i in range(22)) + ". ", "Short tail here. "
    texts += [head + tail + "One other text follows it with quite a few words of its own.", head + tail + "Nothing alike in this one, whose end is a different sentence."]
    pairs = list(enumerate(texts))
    got = sentence_spans.spans_removed(docs(spark, pairs), least, min_words, chunk_bytes=chunk).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in got} == plain_spans_of_all_runs(pairs, least, min_words)


def test_sentence_spans_of_awkward_rows(spark):
    got = sentence_spans.spans_removed(messy(spark)).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert len(got) == 16
    assert by_id[2][0].text == "" and by_id[2][0].n_sentences == 0
    assert by_id[1][0].n_removed == 0 and [r.n_removed for r in by_id[4]] == [3, 3]
    assert {r.n_removed for r in by_id[None]} == {0, 3}
    assert sentence_spans.spans_removed(empty(spark)).collect() == []
