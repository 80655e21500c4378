"""Merkle manifest against a plain version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import merkle
from tests.llm.common import empty, messy


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of a list of digests and every node's siblings, as lists of (before, after)."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place - place % 3 : place - place % 3 + 3]
            proofs[k].append((run[: place % 3], run[place % 3 + 1 :]))
            at[k] = place // 3
        level = [h("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], proofs


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    found = {name: climb([x[2] for x in sorted(trees[name], key=lambda x: x[:3])]) for name in names}
    root, outer = climb([found[name][0] for name in names])
    made = []
    for name, above in zip(names, outer, strict=True):
        for (_, _, own, r), proof in zip(sorted(trees[name], key=lambda x: x[:3]), found[name][1], strict=True):
            text = r[4]
            if text is not None and zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            top = leaf((*r[:4], text))
            for before, after in proof + above:
                top = h("".join(before) + top + "".join(after))
            siblings = h("".join("".join(b + a) for b, a in proof + above))
            made.append((r[0], own, found[name][0], root, siblings, top, top == root))
    return made


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("n", "sources", "levels"), [(1, 1, 7), (9, 1, 1), (10, 1, 1), (400, 5, 1), (400, 40, 1), (300, 3, 2), (700, 2, 7)])
def test_trees_of_any_height(spark, n, sources, levels, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", 50)
    # the first source holds more than half of the rows
    made = [(i * 7919 % 10007, None if i % 97 == 5 else f"s{i % (2 * sources) if i % (2 * sources) < sources else 0}", "en", i, f"line {i}\nend") for i in range(n)]
    df = spark.createDataFrame(made, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    got = merkle.manifest(df, merkle.without_line_feeds(), levels=levels)
    assert sorted_rows(got.collect()) == sorted_rows(brute(made))


def test_awkward_rows(spark):
    df = messy(spark).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "ünï").when(F.col("doc_id") % 3 == 1, ""))
    got = merkle.manifest(df, merkle.without_line_feeds(), levels=1)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted_rows(got.collect()) == sorted_rows(brute(rows_of(df)))
    assert merkle.manifest(empty(spark), merkle.without_line_feeds()).collect() == []


def test_clashing_names(spark):
    df = messy(spark).selectExpr("*", "1 AS tree", "2 AS pos", "'x' AS node", "3 AS n", "4 AS _group", "5 AS other")
    assert sorted_rows(merkle.manifest(df).collect()) == sorted_rows(merkle.manifest(messy(spark)).collect())


def test_equal_rows_are_leaves_of_their_own(spark):
    made = [(1, "a", None, 2, "x")] * 40 + [(None, "a", "en", None, None)] * 30
    df = spark.createDataFrame(made, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(df, levels=2, with_proof=True).collect()
    assert sorted_rows([r[:-1] for r in got]) == sorted_rows(brute(made)) and len(got) == 70
    assert all(r.verified and merkle.folded(r.leaf, r.proof) == r.root and len(r.proof.split("/")) == 4 for r in got)


def test_any_change_is_found(spark):
    made = [(i, "a" if i % 4 else "b", "en", 3, "abc") for i in range(50)]
    df = spark.createDataFrame(made, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(df, {"n_chars": F.when(F.col("doc_id") == 17, 4).otherwise(F.col("n_chars")), "lang": F.when(F.col("doc_id") != 18, F.col("lang"))})
    assert sorted(r.doc_id for r in got.collect() if not r.verified) == [17, 18]
