"""MinHash near-duplicates against a plain join of all pairs."""

import random

import numpy as np
import pytest

from cohortlens.llm import minhash
from cohortlens.llm.jaccard import shingles
from tests.llm.common import LONG, TEXT, corpus, docs, empty, messy


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(pairs, percent=85):
    sets = [(i, shingle_set(t)) for i, t in pairs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def varied(base, rng, changes):
    words = base.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_match_a_plain_join(spark, seed):
    pairs = corpus(seed, 60, 30)
    want = plain(pairs)
    assert found(minhash.near_duplicates(docs(spark, pairs))) == want
    assert sum(not kept for *_, kept in want.values()) > 5


def test_short_sets(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(3)}" for _ in range(k)) for k in [1, 2, 4, 5, 6, 8, 10, 12] * 6]
    pairs = list(enumerate(base + [x + " end" for x in base[:24]]))
    assert found(minhash.near_duplicates(docs(spark, pairs))) == plain(pairs)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_beside_the_hub_are_kept(spark, block):
    """Texts from one template that are too far from each other, but for some pairs and chains."""
    rng = random.Random(5)
    template = " ".join(f"t{i}" for i in range(150))
    texts = []
    for _ in range(40):
        one = varied(template, rng, 6)
        texts += [one, *(varied(one, rng, 1) for _ in range(rng.choice([0, 0, 1, 2])))]
    chain = template
    for _ in range(12):
        chain = varied(chain, rng, 2)
        texts.append(chain)
    texts += [varied(template, rng, 1) for _ in range(30)]
    rng.shuffle(texts)
    pairs = list(enumerate(texts))
    want = plain(pairs)
    assert 1 < len({c for _, c, _ in want.values()}) < len(want)
    assert found(minhash.near_duplicates(docs(spark, pairs), block=block)) == want


def test_awkward_rows(spark):
    got = minhash.near_duplicates(messy(spark))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "class_id", "kept"]
    rows = got.collect()
    assert len(rows) == 16
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert all(r.component_id is None and r.kept for r in by_id[None])
    assert [(r.n_shingles, r.component_id, r.kept) for r in by_id[2] + by_id[3] + by_id[5]] == [(0, i, True) for i in (2, 3, 5)]
    assert [r.component_id for r in by_id[4]] == [1, 1] and not by_id[4][0].kept
    assert by_id[6][0].component_id == by_id[10][0].component_id == 6
    assert minhash.near_duplicates(empty(spark)).collect() == []


def test_clashing_names(spark):
    df = docs(spark, [(1, TEXT), (2, TEXT + " more"), (3, LONG), (4, TEXT)])
    extra = df.selectExpr("*", *[f"'x' AS {c}" for c in ("key", "keys", "n", "set_key", "hub", "size", "text_key", "node", "root", "star", "hashes", "_salt")])
    assert found(minhash.near_duplicates(extra)) == found(minhash.near_duplicates(df))


def test_hot_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_ROWS", 3)
    monkeypatch.setattr(minhash, "STAR", 4)
    rng = random.Random(9)
    base = " ".join(f"b{i}" for i in range(120))
    pairs = [(i, varied(base, rng, 1)) for i in range(30)] + [(100 + i, base) for i in range(20)] + [(200, base)] * 5
    want = plain(pairs)
    assert {c for _, c, _ in want.values()} == {0}
    assert found(minhash.near_duplicates(docs(spark, pairs))) == want


@pytest.mark.parametrize(("size", "shared"), [(7, 6), (40, 37), (400, 368), (4000, 3680)])
def test_bins_agree_with_the_probability_of_the_similarity(size, shared):
    """The similarity of random sets is met by the share of equal bins, with a fitting spread."""
    rng = np.random.default_rng(size)
    agree, missed = [], 0
    for _ in range(300):
        every = np.unique(rng.integers(0, 2**64, 2 * size - shared, dtype=np.uint64))
        a, b = every[:], rng.permutation(every)
        a, b = np.sort(b[:size]), np.sort(np.r_[b[:shared], b[size:]])
        x, y = minhash.signature(a), minhash.signature(b)
        agree.append((x == y).mean())
        missed += not (minhash.band_keys(x) == minhash.band_keys(y)).any()
    similarity = shared / (2 * size - shared)
    assert abs(np.mean(agree) - similarity) < 0.02
    assert missed == 0 or similarity < 0.85


def test_signature_of_small_sets():
    one = shingles("a b")
    assert (minhash.signature(one) == one[0]).all()
    assert len(set(minhash.band_keys(minhash.signature(one)).tolist())) == minhash.BINS // minhash.ROWS
