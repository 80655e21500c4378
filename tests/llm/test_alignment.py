"""Cross-tokenizer alignment against a plain version."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortlens.llm import alignment
from cohortlens.llm.tokens import path_of
from tests.llm.common import LONG, corpus, docs, empty, messy

BYTES, PIECES = path_of("byte_bpe_50k.json"), path_of("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  two  spaces ", "x", "a\nb\n\n c", "tab\tand\r\nfeed", "▁mark", "a▁b", "<|endoftext|> in text", "<s> </s> <unk> <0x41>",
    "Ünï cödé ß 中文 字符 \U0001f600\U0001f468‍\U0001f469", "日本語のテキスト。" * 20, "\x00zero\x01", "don't can't we'll", "12345 3.14159", "aaaaaaaa" * 50,
    "ﬁne ½ ² é", " no break　wide", "{\r\n}\r\n", LONG[:5000],
]


def plain(rows):
    """{row number: all columns} for (doc_id, text)."""
    a_file, b_file = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_file.encode_special_tokens = True
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain_bytes} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain_bytes)}

    def b_bytes(i):
        piece = b_file.id_to_piece(i)
        if re.fullmatch("<0x[0-9A-F]{2}>", piece) and b_file.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    made, total = [], Counter()
    for doc_id, text in rows:
        a, b = [], []
        if text:
            a, b = a_file.encode(" " + text, add_special_tokens=False).ids, b_file.encode(text)
            spelt_a = [bytes(letters[c] for c in a_file.id_to_token(i)) for i in a]
            spelt_b = [b_bytes(i) for i in b]
            if b"".join(spelt_a) != (" " + text).encode() or b"".join(spelt_b) != (" " + text).encode():
                a, b = [], []
        if not a:
            made.append([doc_id, 0, 0, 0, [], ""])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in spelt_a]).tolist(), np.cumsum([len(x) for x in spelt_b]).tolist()
        pairs = [
            (x, y) for x, e, n in zip(a, ends_a, spelt_a, strict=True) for y, f, m in zip(b, ends_b, spelt_b, strict=True) if e - len(n) < f and f - len(m) < e
        ]
        total.update(pairs)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        made.append([doc_id, len(a), len(b), len(groups), pairs, ";".join(groups)])
    highest = {}
    for (_, y), n in total.items():
        highest[y] = max(n, highest.get(y, 0))
    return [
        (i, a, b, g, len(p), sum(total[x] == highest[x[1]] for x in p), sum(total[x] for x in p), hashlib.sha256(t.encode()).hexdigest() if t else "")
        for i, a, b, g, p, t in made
    ]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("chunk_bytes", [300, 16_000_000])
def test_alignment_matches_a_plain_version(spark, chunk_bytes, monkeypatch):
    rows = list(enumerate(ODD)) + [(100 + i, t) for i, t in corpus(5, 30, 3)] + [(200, LONG[:9000]), (None, "no id"), (7, "a\nb")]
    got = alignment.aligned(docs(spark, rows), BYTES, PIECES, chunk_bytes=chunk_bytes).collect()
    assert in_order(got) == in_order(plain(rows))


def test_awkward_rows(spark):
    got = alignment.aligned(messy(spark), BYTES, PIECES, with_groups=True)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    rows = got.collect()
    assert len(rows) == 16
    assert all(tuple(r[1:]) == (0, 0, 0, 0, 0, 0, "", "") for r in rows if r.doc_id in (2, 3))
    for r in rows:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
        assert r.n_groups == (r.groups.count(";") + 1 if r.groups else 0)
    assert alignment.aligned(empty(spark), BYTES, PIECES).collect() == []


def test_clashing_names(spark):
    df = docs(spark, [(1, "some words"), (2, "other words here")])
    extra = df.selectExpr("*", *[f"1 AS {c}" for c in ("chunk", "pair", "pairs", "counts", "a", "b", "n_a", "best", "b_id", "_salt")])
    assert in_order(alignment.aligned(extra, BYTES, PIECES).collect()) == in_order(alignment.aligned(df, BYTES, PIECES).collect())


@pytest.mark.parametrize("seed", range(30))
def test_cuts_and_links_of_random_ends(seed):
    """Against set operations; some intervals have no common end, some only far from the middle."""
    rng = random.Random(seed)
    a_ends, b_ends, first, last, at = [], [], [], [], 0
    for _ in range(rng.randint(1, 6)):
        n = rng.choice([1, 2, 10, 300])
        share = rng.choice([0, 0.02, 0.3, 1])
        a = {x for x in range(1, n) if rng.random() < 0.6}
        b = {x for x in range(1, n) if x not in a or rng.random() < share}
        first.append(len(a_ends))
        a_ends += [at + x for x in sorted(a | {n})]
        b_ends += [at + x for x in sorted(b | {n})]
        last.append(len(a_ends) - 1)
        at += n
    a, b = np.array(a_ends), np.array(b_ends)
    cut = alignment.shared_cuts(a, b, np.array(first), np.array(last))
    assert a[cut].tolist() == sorted(set(a_ends) & set(b_ends))
    left, right = alignment.links(a, b)
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if (a[i - 1] if i else 0) < b[j] and (b[j - 1] if j else 0) < a[i]]
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == want
