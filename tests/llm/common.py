"""Small tables with every awkward case, and plain versions of the operators to hold them against."""

import random

LONG = " ".join(f"word{i % 977} and the {i}." for i in range(6000))
TEXT = "The cat of the house sat on a mat. It was raining and the dog ran to it. Nobody saw that."
OTHER = "Der Hund und die Katze sind in dem Haus. Es war kalt und der Wind kam von den Bergen."

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, rest int, _chunk int, matches string"


def messy(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    texts = [
        (1, TEXT), (2, None), (3, ""), (4, TEXT), (4, TEXT), (5, "   \n\t "), (6, LONG), (7, OTHER),
        (8, "12 34 !!"), (None, TEXT), (None, None), (9, "x"), (9, TEXT + " " + OTHER), (10, LONG + " end"),
        (11, "Ünï cödé ß 中文 字符 \U0001f600"), (12, "a\x00b \x1c c d e"),
    ]
    rows = [
        (i, t, None if i is None else ("de" if t == OTHER else "en"), None, None if t is None else len(t), "s", "r", 5, 7, "m")
        for i, t in texts
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, pairs, parts=3):
    return spark.createDataFrame(pairs, "doc_id long, text string").repartition(parts)


def corpus(seed=0, n=60, copies=8):
    """Random prose with exact copies, near copies, shared passages and short texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def prose(k):
        words = [rng.choice(vocabulary) for _ in range(k)]
        for i in range(6, k, 9):
            words[i] += "."
        return " ".join(words).replace(". ", ".\n" if rng.random() < 0.2 else ". ")

    texts = [prose(rng.choice([2, 4, 5, 30, 80, 200])) for _ in range(n)]
    passage = prose(70)
    for _ in range(copies):
        base = rng.choice(texts)
        words = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
        texts.append(base)
        texts.append(prose(20) + " " + passage + " " + prose(20))
    rng.shuffle(texts)
    return list(enumerate(texts))
