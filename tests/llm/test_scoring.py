"""Language identification, context-tree weighting, string tiling and quality rules."""

import itertools
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cohortlens.llm import ctw, langid, quality, tiling
from tests.llm.common import LONG, OTHER, TEXT, corpus, docs, empty, messy

DATA = "/root/testdata/sf0.001"


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 4, 0, 5, 2])
    scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
    label, at = langid.viterbi(scores, sizes, 0.8), 0
    for n in sizes:
        s = scores[at : at + n]

        def value(path, s=s):
            return sum(s[i, x] for i, x in enumerate(path)) - 0.8 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        if n:
            assert math.isclose(value(label[at : at + n].tolist()), max(value(p) for p in itertools.product(range(3), repeat=int(n))), abs_tol=1e-5)
        at += n


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = langid.identified(df, fit_documents=150).select("doc_id", "held_out", "lang_pred", "score").join(df.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in made if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in made)
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in made)


def test_mixed_texts_are_cut_into_spans(spark):
    english, german = " ".join([TEXT] * 6), " ".join([OTHER] * 6)
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100 + i, "Это кот. Он сидит на столе и смотрит в окно, где идёт дождь.", "ru") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    asked = docs(spark, [(1, english + " " + german + " " + TEXT), (2, "Привет"), (3, "123"), (4, None)])
    found = {r.row.doc_id: r for r in langid.label_spans(asked, model).collect()}
    assert [s.lang for s in found[1].spans] == ["en", "de", "en"] and found[1].lang_pred == "en"
    assert sum(s.words for s in found[1].spans) == len((english + " " + german + " " + TEXT).split())
    assert found[2].lang_pred == "ru"
    assert [(found[i].lang_pred, found[i].score, found[i].spans) for i in (3, 4)] == [("und", 0.0, [])] * 2


def test_language_of_awkward_rows(spark):
    got = langid.identified(messy(spark)).collect()
    assert len(got) == 16
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 5, 8)} == {"und"}
    assert langid.identified(empty(spark)).collect() == []
    unlabelled = messy(spark).drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {(r.lang_pred, r.score) for r in langid.identified(unlabelled).collect()} == {("und", 0.0)}


def plain_bits(train, texts, depth):
    """Context-tree weighting by its recursion, one node at a time."""
    nodes: dict = {}
    for text in train:
        data = b"\n" * depth + text
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for bit in range(8):
                    key = (data[i - d : i][::-1], bit, data[i] >> (8 - bit))
                    nodes.setdefault(key, [0, 0])[data[i] >> (7 - bit) & 1] += 1
    kids: dict = {}
    for context, bit, symbol in nodes:
        if context:
            kids.setdefault((context[:-1], bit, symbol), []).append((context, bit, symbol))

    def block(key):
        a, b = nodes[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    known: dict = {}

    def weighted(key):
        if key not in known:
            if len(key[0]) == depth:
                known[key] = block(key)
            else:
                known[key] = np.logaddexp(block(key), sum(weighted(x) for x in kids[key])) - math.log(2)
        return known[key]

    out = []
    for text in texts:
        data, total = b"\n" * depth + text, 0.0
        for i in range(depth, len(data)):
            for bit in range(8):
                p, seen = 0.5, False
                x = data[i] >> (7 - bit) & 1
                for d in range(depth, -1, -1):
                    key = (data[i - d : i][::-1], bit, data[i] >> (8 - bit))
                    if key not in nodes:
                        continue
                    w = 1.0 if not seen else math.exp(block(key) - math.log(2) - weighted(key))
                    p = w * (nodes[key][x] + 0.5) / (sum(nodes[key]) + 1) + (1 - w) * p
                    seen = True
                total -= math.log2(p)
        out.append(total)
    return out


@pytest.mark.parametrize("chunk", [None, 300])
def test_code_lengths_match_the_recursion(spark, chunk):
    pairs = [(i, t) for i, t in corpus(8, 14, 2) if len(t) < 700] + [(900, None), (901, ""), (902, "Zq zq\tÜber")]
    got = ctw.scored(docs(spark, pairs), depth=3, chunk_bytes=chunk).collect()
    spelt = {i: b" ".join((t or "").encode().lower().split()) + b"\n" for i, t in pairs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in pairs}
    want = dict(zip(spelt, plain_bits([x for i, x in spelt.items() if not held[i]], spelt.values(), 3), strict=True))
    counts = Counter(w for i, x in spelt.items() if not held[i] for w in (*x.split(), b"\n"))
    n, v = sum(counts.values()), len(counts)
    assert any(held.values()) and len(got) == len(pairs)
    for r in got:
        words = (*spelt[r.doc_id].split(), b"\n")
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), n)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert math.isclose(r.score, -want[r.doc_id] * math.log10(2), rel_tol=1e-5)
        assert math.isclose(r.bits_per_byte, want[r.doc_id] / len(spelt[r.doc_id]), rel_tol=1e-5)


def test_grams_of_a_hot_context_are_dealt_over_tasks(spark):
    rng = np.random.default_rng(5)
    far = np.unique(rng.integers(97, 123, (5000, 4)).astype(np.uint64) @ (np.uint64(256) ** np.arange(4, dtype=np.uint64)))
    keys = far | np.uint64(0x6520 << 32)  # one context of two bytes
    sizes = np.diff(ctw._by_subtree(keys, 16, 5)[1])
    assert sizes.sum() == len(keys) and sizes.max() < len(keys) / 2
    pairs = [(i, t) for i, t in corpus(8, 14, 2) if len(t) < 700]
    chunks, n = ctw.chunked(docs(spark, pairs), [ctw.F.lit(True).alias("train")], chunk_bytes=300)
    found = ctw._merged(ctw._asked(chunks, n, 5), n, 5).collect()
    merged = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in found])
    want, counts = ctw._gram_counts([ctw._spelt(ctw.words_of(t)) for _, t in pairs], np.ones(len(pairs), bool), 5)
    assert n > 5 and sorted(merged) == want.tolist()  # each once, however many chunks have it
    assert sum(np.frombuffer(r["counts"], np.int64).sum() for r in found) == counts.sum()


def test_deep_code_lengths_match_the_recursion(spark):
    pairs = [(i, t) for i, t in corpus(8, 14, 2) if len(t) < 400]
    got = ctw.scored(docs(spark, pairs), chunk_bytes=300).collect()
    spelt = {i: b" ".join(t.encode().lower().split()) + b"\n" for i, t in pairs}
    taught = [x for i, x in spelt.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    want = dict(zip(spelt, plain_bits(taught, spelt.values(), 5), strict=True))
    assert all(math.isclose(r.bits_per_byte, want[r.doc_id] / len(spelt[r.doc_id]), rel_tol=1e-5) for r in got)


def test_word_counts_beyond_32_bits(spark):
    top = spark.sparkContext.broadcast(ctw.top_tree(docs(spark, [(1, "a")])))
    rows = [(4, c, np.array([7, 9 + c], np.uint64).tobytes(), np.array([3_000_000_000, 5]).tobytes()) for c in range(2)]
    asked = spark.createDataFrame(rows, "_bucket int, _chunk int, keys binary, counts binary")
    got = {r["_chunk"]: r for r in ctw._answered(asked, top, 4, 5).collect()}
    assert [np.frombuffer(got[c]["said"], np.int64).tolist() for c in range(2)] == [[6_000_000_000, 5]] * 2
    assert sum(r["distinct"] for r in got.values()) == 3


def test_bits_of_all_bytes_sum_to_one():
    text = [t.encode() + b"\n" for _, t in corpus(3, 10, 1)]
    keys, n = ctw._gram_counts(text, np.ones(len(text), bool), 4)
    few, few_n = ctw._gram_counts(text, np.ones(len(text), bool), 2)
    deep, top = ctw.Tree(keys, n, 2, 4), ctw.Tree(few, few_n, 0, 2)
    for context in (keys[0] >> 8, keys[len(keys) // 2] >> 8, 0x0A0A0A0A, 0xFF01FE02):
        asked = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert math.isclose((2.0 ** -ctw.code_lengths(deep, top, asked)).sum(), 1, rel_tol=1e-9)


def test_weights_of_all_depths_are_those_of_the_whole_tree():
    text = [t.encode()[:300] + b"\n" for _, t in corpus(3, 10, 1)] + [b"q\n", b"q\n", bytes(range(256))]
    keys, n = ctw._gram_counts(text, np.ones(len(text), bool), 5)
    few, few_n = ctw._gram_counts(text, np.ones(len(text), bool), 2)
    whole, tree = ctw.Tree(keys, n, 0, 5), ctw.Tree(few, few_n, 0, 2)
    ids, logs = ctw.Tree(keys, n, 3, 5).sums()
    for depth in (2, 1, 0):
        tree, ids, logs = tree.weighed(depth, ids, logs)
        for bit in range(8):
            assert (tree.nodes[depth, bit][0] == whole.nodes[depth, bit][0]).all()
            assert np.allclose(tree.nodes[depth, bit][3], whole.nodes[depth, bit][3], rtol=1e-9, atol=0)
    assert len(ids) == 0


def test_block_probability():
    n0, n1 = np.array([0, 3, 4095, 4096, 100_000]), np.array([0, 2, 1, 5000, 7])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(n0, n1, strict=True)]
    assert np.allclose(ctw.block_log(n0, n1), want, rtol=1e-9, atol=1e-9)


def test_scores_of_awkward_rows(spark):
    got = ctw.scored(messy(spark)).collect()
    assert len(got) == 16
    assert {(r.n_tokens, r.n_bytes) for r in got if r.doc_id in (2, 3, 5)} == {(1, 1)}
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert ctw.scored(empty(spark)).collect() == []
    untaught = ctw.scored(docs(spark, [(4, "ab")]).where("doc_id = 4"), train=ctw.F.lit(False)).first()
    assert math.isclose(untaught.score, -8 * 3 * math.log10(2)) and untaught.train_tokens == 0


def plain_tiles(doc, item, least):
    """Greedy string tiling: mark the longest match of unmarked words, again and again."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and free_d[a + n] and free_i[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return covered
        free_d[a : a + n] = [False] * n
        free_i[b : b + n] = [False] * n
        covered += n


@pytest.mark.parametrize("seed", range(3))
def test_tiling_matches_a_plain_search(spark, seed):
    import random

    rng = random.Random(seed)
    words = ["".join(rng.choice("abc") for _ in range(2)) for _ in range(8)] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 25)))) for i in range(6)]
    texts = []
    for i in range(12):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))]
        for _, t in rng.sample(items, 2):
            w = t.split()
            k = rng.randint(0, len(w))
            parts += [" ".join(w[k:]), " ".join(w[:k])]  # in another order
        texts.append((i, ", ".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (1_000_000, 80):
        got = tiling.tiled(docs(spark, texts), bench, 3, 50, block_words).collect()
        for r in got:
            doc = r.row.text.replace(",", "").split()
            want = {i: plain_tiles(doc, t.split(), 3) for i, t in items}
            mine = {m.item_id: m.covered for m in r.matches}
            for i, n in want.items():
                assert mine.get(i, 0) == n
            assert r.contaminated == any(2 * n >= len(t.split()) for (_, t), n in zip(items, want.values(), strict=True) if n)


def test_planted_passages_and_clean_texts(spark):
    item = " ".join(f"t{i}" for i in range(40))
    parts = item.split()
    texts = [
        (1, "x " * 50 + item + " y" * 50), (2, " ".join(parts[20:] + ["z"] + parts[:20])), (3, " ".join(parts[:12])),
        (4, TEXT), (5, item.upper().replace(" ", ",\n")), (6, None), (7, " ".join(reversed(parts))),
    ]
    got = tiling.contaminated(docs(spark, texts), spark.createDataFrame([(7, item), (8, None), (9, "the cat")], "item_id long, text string"))
    assert {r.doc_id: (r.contaminated, r.n_items, round(r.max_coverage, 2)) for r in got.collect()} == {
        1: (True, 1, 1.0), 2: (True, 1, 1.0), 3: (False, 0, 0.3), 4: (False, 0, 0.0), 5: (True, 1, 1.0), 6: (False, 0, 0.0), 7: (False, 0, 0.0),
    }


def test_tiling_of_awkward_rows(spark):
    bench = spark.createDataFrame([(None, TEXT), (1, ""), (1, LONG)], "item_id long, text string")
    got = tiling.contaminated(messy(spark), bench).collect()
    assert len(got) == 16
    assert {r.contaminated for r in got if r.doc_id in (1, 4, 6, 10)} == {True}
    assert {r.contaminated for r in got if r.doc_id in (2, 3, 7, 8)} == {False}
    assert tiling.contaminated(empty(spark), bench).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in tiling.contaminated(messy(spark), nothing).collect()} == {False}


def plain_repeats(words, window=8):
    runs = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    times = Counter(runs)
    return len({p for i, r in enumerate(runs) if times[r] > 1 for p in range(i, i + window)})


def test_rules_match_plain_measures(spark):
    texts = [t for _, t in corpus(11)] + [TEXT * 3, "a b c d e f g h " * 5, "# $ | <x> &&", "one\none\n \n\ntwo\none", None, "", "a b c d e f g a b c d e f g a"]
    got = {r.doc_id: r for r in quality.quality(docs(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        r = got[i]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == plain_repeats(words), text
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
        assert not (r.kept and r.base_failed) and r.kept == (not r.base_failed and not r.broken)


def test_rules_match_their_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    made = quality.quality(spark.read.parquet(f"{DATA}/documents.parquet")).withColumn("broken", quality.F.array_join("broken", " "))
    want = duck.execute(quality.oracle())
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in made.collect()) == sorted(want.fetchall())


def test_no_user_functions_in_the_rules(spark):
    plan = quality.quality(messy(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rules_on_awkward_rows(spark):
    got = quality.quality(messy(spark)).collect()
    assert len(got) == 16
    assert {(r.n_words, r.kept) for r in got if r.doc_id in (2, 3, 5)} == {(0, False)}
    assert quality.quality(empty(spark)).collect() == []


def test_number_signs_are_no_letters(spark):
    pairs = [(i, TEXT if i % 2 else OTHER, "en" if i % 2 else "de") for i in range(1, 41)]
    pairs += [(100, "½", None), (101, "²³", None), (102, "Ⅷ 12", None), (103, "½ " + TEXT, None)]
    df = spark.createDataFrame(pairs, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(df).collect()}
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103] == ("en", 1.0)
