"""Token ids, directly addressable codes and packing: exact round trips."""

import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import dac, packing
from cohortlens.llm.tokens import Encoder, path_of
from tests.llm.common import LONG, corpus, docs, empty, messy

BYTES, WORDS = path_of("byte_bpe_50k.json"), path_of("word_bpe_49k.json")
ODD = [
    "", " ", "  a  b\n\n c ", "don't stop, it's a 'test'.", "a\xa0b\x85d　e", "Éá İstanbul ΣΑΣ ß é", "x 123 4.5,", "<|endoftext|> y",
    "<|startoftext|>a<|endoftext|>", "mid<|endoftext|>word b<|ENDOFTEXT|> <|end", "İ. İİ! ÀİÒ. a İ", "a\u0301. E\u0301!", "it's ITS' we'LL 12½³",
    "a\tb\r\nc\x0bd\x0ce", "​zero‍width", "中文 字符。", "a, b.c d!? e.", "²a ½x Ⅷ", "\x1c a\x1fb", "\n", "a\n", " a", "a \nb", "\U0001f600 x", LONG[:3000],
]


@pytest.mark.parametrize(("path", "drops"), [(BYTES, False), (WORDS, True)])
def test_ids_are_the_library_s(path, drops):
    mine, theirs = Encoder(path, drops), Tokenizer.from_file(path)
    for text in ODD + [t for _, t in corpus(2)] + ODD:
        want = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want, text


@pytest.mark.parametrize(("path", "drops"), [(BYTES, False), (WORDS, True)])
def test_ids_of_random_strings(path, drops):
    """50,000 strings a file over letters, numbers, marks, spaces and special tokens."""
    rng = random.Random(7)
    kinds = [
        "abcXYZ'.,!?;:-", "éßÀÑİıſ½²ªµ·¿", "\u0301\u0307\u0130\u01c5\u0250ΣςЖ中文हिก", " \n\t\r\x0b\x0c\x1c\x85\xa0\u1680\u2003\u2028\u3000\ufeff\u200b",
        "0123٣Ⅷ", ["'s", "'LL", " the", "  ", "<|endoftext|>", "<|", "\U0001f600", "e\u0301", "\n\n"],
    ]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 14))) for _ in range(50_000)]
    mine, theirs = Encoder(path, drops), Tokenizer.from_file(path)
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want.ids, repr(text)


def test_full_word_table_is_emptied(monkeypatch):
    monkeypatch.setattr("cohortlens.llm.tokens.TABLE", 3)
    mine, theirs = Encoder(BYTES, False), Tokenizer.from_file(BYTES)
    text = "one two three, four five six. one two"
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_any_token_of_an_image(n):
    rng = np.random.default_rng(n)
    ids = rng.choice([0, 2, 255, 256, 50_256, 65_535, 65_536, 2**24, 2**32 - 1], n).astype(np.uint32)
    starts = np.sort(rng.integers(0, n + 1, 4)) if n else np.zeros(4, int)
    data = dac.image(np.array([dac.NO_ID, 1, 2, 9]), starts, ids, 3, 4)
    one, again = dac.images(data + b"\n" + data + b"\n")
    assert (one.part, one.shard, one.n_ids, one.size) == (3, 4, n, len(data))
    assert [one.token(i) for i in range(0, n, 37)] == ids[::37].tolist()
    for a, b in [(0, n), (n // 3, n // 2), (n // 2, n // 2), (max(0, n - 5), n)]:
        assert again.tokens(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        dac.Image(b"x" + data)


def test_written_ids_are_read_back(spark, tmp_path):
    pairs = corpus(4, 40, 4) + [(500, None), (501, ""), (502, LONG)]
    folder = str(tmp_path / "ids")
    dac.write_ids(docs(spark, pairs), folder, BYTES, 2, shard_ids=300)
    found = dac.with_global_starts(dac.read_ids(spark, folder, with_ids=True)).collect()
    theirs, start = Tokenizer.from_file(BYTES), 0
    by_id = {r.doc_id: r for r in found}
    for i, text in sorted(pairs):
        want = [*theirs.encode(text or "", add_special_tokens=False).ids, 2]
        got = by_id[i]
        assert (got.start, got.n_tokens, got.ids) == (start, len(want), want)
        assert got.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert len(found) == len(pairs)


def test_ids_of_awkward_rows(spark):
    got = dac.written_and_read(messy(spark), BYTES, 2)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert len(rows) == 16 and [r.doc_id for r in rows[:2]] == [None, None]
    assert [r.start for r in rows[1:]] == [r.start + r.n_tokens for r in rows[:-1]]
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert dac.written_and_read(empty(spark), BYTES, 2).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([8, 64, 512]))
    count = np.zeros(size + 1, np.int64)
    lengths = rng.integers(1, size + 1, int(rng.choice([1, 5, 400, 3000])))
    np.add.at(count, lengths, 1)
    before = count.copy()
    made = packing.plan(count, size)
    assert (count == before).all()
    used = np.zeros_like(count)
    for pattern, n in made:
        assert sum(pattern) <= size and n > 0
        for length in pattern:
            used[length] += n
    assert (used == count).all()
    bins, bound = sum(n for _, n in made), math.ceil(lengths.sum() / size)
    large = int((lengths > size // 2).sum())
    assert bins <= max(bound, large) * 11 // 9 + 1


@pytest.mark.parametrize(
    ("have", "want"),
    [
        ({60: 5, 40: 7}, ((60, 40), 5)),
        ({55: 2, 25: 2, 20: 3}, ((55, 25, 20), 2)),
        ({70: 1, 15: 1, 10: 1, 5: 1}, ((70, 15, 10, 5), 1)),
        ({50: 1, 25: 2}, ((50, 25, 25), 1)),
        ({100: 4}, ((100,), 4)),
    ],
)
def test_exact_complements_are_found(have, want):
    count = np.zeros(101, np.int64)
    for length, n in have.items():
        count[length] = n
    assert want in packing.plan(count, 100)


def test_pieces_fill_sequences(spark):
    pairs = corpus(6, 80, 4) + [(500, None), (501, ""), (502, LONG), (503, LONG)]
    rows = packing.pack(docs(spark, pairs), WORDS, 0, size=256).collect()
    theirs, by_id, places = Tokenizer.from_file(WORDS), {}, {}
    for r in rows:
        by_id.setdefault(r.doc_id, {})[r.piece] = r
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in pairs:
        ids = np.array([*theirs.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [ids[a : a + 256] for a in range(0, len(ids), 256)]
        assert len(by_id[i]) == len(cut)
        for k, piece in enumerate(cut):
            r = by_id[i][k]
            assert (r.start, r.length, r.ids_crc32) == (256 * k, len(piece), zlib.crc32(piece.tobytes()))
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and sum(n for _, n in held) <= 256
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False))
    assert len(places) <= math.ceil(sum(r.length for r in rows) / 256) * 1.1 + 1


def test_packing_awkward_rows(spark):
    rows = packing.pack(messy(spark), WORDS, 0).collect()
    assert sum(r.piece == 0 for r in rows) == 16
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(empty(spark), WORDS, 0).collect() == []
