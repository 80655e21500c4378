"""The pipeline against plain versions of its stages, and the queries of the folder."""

import math

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlens.llm import jaccard, queries
from cohortlens.llm.tokens import path_of
from tests.llm.common import corpus, docs, empty, messy
from tests.llm.test_dedup import plain_components
from tests.llm.test_scoring import plain_tiles


def plain_cut(pairs, length=100):
    """Texts without the bytes of strings that start earlier too; texts that have nothing left go."""
    seen, out = set(), []
    for i, t in sorted(pairs):
        data = t.encode()
        gone = bytearray(len(data))
        for j in range(len(data) - length + 1):
            w = data[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        if kept or not data:
            out.append((i, kept.decode(errors="ignore")))
    return out


def prepared(spark, tmp_path):
    pairs = [(i, t) for i, t in corpus(12, 40, 6)]
    pairs += [(500, "1 2 3"), (501, "")]
    items = [(0, " ".join(pairs[3][1].split()[:12])), (1, "no such words in any of the texts here")]
    pairs.append((502, "start " + items[0][1] + " end of a leak"))
    rows = [(i, t, "en" if i % 3 else "fr", "s", len(t)) for i, t in pairs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return pairs, items


def test_stages_against_plain_versions(spark, tmp_path):
    pairs, items = prepared(spark, tmp_path)
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, want = docs.columns, [(i, t) for i, t in pairs if any(c.isalpha() for c in t)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name == "near_copies":
            found = plain_components(want)
            want = [(i, t) for i, t in want if found[i][1] == i]
        elif name == "repeated_spans":
            want = plain_cut(want)
        elif name == "benchmark":
            words = {i: "".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).split() for i, t in [*want]}
            cover = {i: max(plain_tiles(words[i], t.lower().split(), 4) / len(t.split()) for _, t in items) for i in words}
            assert any(c >= 0.5 for c in cover.values())
            want = [(i, t) for i, t in want if cover[i] < 0.5]
        assert docs.columns == names
        got = {r.doc_id: r for r in docs.collect()}
        assert {i: r.text for i, r in got.items()} == dict(want), name
        assert all(r.n_chars == len(r.text) and r.source == "s" for r in got.values()), k
    rows = corpus_pipeline.run(spark, folder).collect()
    theirs = Tokenizer.from_file(path_of("word_bpe_49k.json"))
    sizes = {i: len(theirs.encode(t, add_special_tokens=False).ids) + 1 for i, t in want}
    assert {i: sum(r.length for r in rows if r.doc_id == i) for i in sizes} == sizes
    assert len({r.sequence_id for r in rows}) <= math.ceil(sum(sizes.values()) / 2048) + 1
    assert np.all([r.length <= 2048 for r in rows])


def test_awkward_documents(spark, tmp_path):
    given = messy(spark).withColumnRenamed("row", "_copy").withColumnRenamed("score", "_text")
    spark.createDataFrame([(1, "nothing of this is in the texts")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (given, empty(spark)):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        first = corpus_pipeline.language_id(spark, docs, str(tmp_path))
        second = corpus_pipeline.near_copies(spark, first, str(tmp_path))
        third = corpus_pipeline.repeated_spans(spark, second, str(tmp_path))
        for made in (first, second, third, corpus_pipeline.benchmark(spark, third, str(tmp_path))):
            assert made.columns == docs.columns
        kept = {r.doc_id for r in second.collect()}
        assert kept == ({1, 6, 7, 9, 11, 12, None} if docs is given else set())
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_a_query():
    numbers = {name.split("_")[0] for name in queries.QUERIES if name.startswith("op")}
    assert numbers == {f"op{i}" for i in range(1, 14)} and "pipeline" in queries.QUERIES
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"


def test_near_copies_of_a_group_whose_blocks_share_nothing(spark, monkeypatch):
    """A chain of overlapping texts is one group; cut into small blocks, its ends have no shingle in common."""
    made = jaccard._block_products
    monkeypatch.setattr(jaccard, "_block_products", lambda members, percent, block: made(members, percent, 2))
    chain = [" ".join(f"w{i}" for i in range(6 * k, 60 + 6 * k)) for k in range(40)]
    kept = corpus_pipeline.near_copies(spark, docs(spark, [*enumerate(chain), (99, "a text of its own that stays")]), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 99]
