"""Quality rules: a table of thresholds compiled into one projection of Spark's own functions.

A rule bounds the ratio of two measures of a text from below, from above or both; ``RULES`` lists them in
percent. All measures, the base conditions and all rules are columns of one pass over the table: no
shuffle, no user function. Words are stretches without ASCII white space.

Repeated words are those in windows of eight words that occur twice or more in the text. Windows are
hashed; only texts whose hashes are not all different sort them, and add up how far each repeated
window reaches beyond the one before.

Defined results: null and empty texts have no words and fail. A rule whose second measure is 0 is
not broken. Repeated rows and rows without a doc_id are judged like any other; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of the languages of the texts.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que pour est dans qui par au sur pas avec "
    "el y los se las del por con no una su para al es"
).split()

#: name: (measure, per measure, least percent, most percent)
RULES: dict[str, tuple[str, str, int | None, int | None]] = {
    "word_length": ("word_chars", "n_words", 200, 1200),
    "symbols": ("n_symbols", "n_words", None, 20),
    "stop_words": ("n_stop_words", "n_words", 4, None),
    "dup_lines": ("n_dup_lines", "n_lines", None, 40),
}

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _stop_forms() -> list[str]:
    """Stop words as they stand in a text: at the head of a sentence, before a comma or full stop."""
    return sorted({form + end for w in STOP_WORDS for form in (w, w.capitalize()) for end in ("", ",", ".")})


def repeated_words(words: str, window: int = WINDOW) -> tuple[list[tuple[str, Column]], Column]:
    """Columns to add one after the other, and the number of words in repeated windows."""
    steps = [
        ("_word_hashes", F.transform(words, lambda w: F.xxhash64(w))),
        (
            "_windows",
            F.when(
                F.size(words) >= window,
                F.transform(
                    F.sequence(F.lit(0), F.size(words) - window),
                    lambda i: F.xxhash64(*[F.get("_word_hashes", i + j) for j in range(window)]),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        ),
        ("_some", F.size(F.array_distinct("_windows")) < F.size("_windows")),
        (
            "_sorted",
            F.when(F.col("_some"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        ),
        (
            "_at",
            F.when(
                F.col("_some"),
                F.sort_array(
                    F.transform(
                        F.filter(
                            F.transform(
                                F.sequence(F.lit(0), F.size("_sorted") - 1),
                                lambda j: F.struct(
                                    F.get("_sorted", j)["i"].alias("i"),
                                    F.coalesce(F.get("_sorted", j)["h"] == F.get("_sorted", j - 1)["h"], F.lit(False)).alias("a"),
                                    F.coalesce(F.get("_sorted", j)["h"] == F.get("_sorted", j + 1)["h"], F.lit(False)).alias("b"),
                                ),
                            ),
                            lambda x: x["a"] | x["b"],
                        ),
                        lambda x: x["i"],
                    )
                ),
            ),
        ),
    ]
    reach = F.aggregate(
        F.transform("_at", lambda p, j: F.least(F.lit(window), F.coalesce(F.get("_at", j + 1) - p, F.lit(window)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return steps, F.when(F.col("_some"), reach).otherwise(F.lit(0))


def quality(df: DataFrame, rules: dict[str, tuple[str, str, int | None, int | None]] = RULES) -> DataFrame:
    """Per row: doc_id, the measures (n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stop_words), base_failed, broken (names of the rules broken) and kept."""
    rows = df.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    space = f"[{_SPACES}]+"
    rows = rows.withColumn("_words", F.filter(F.split("_text", space), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: _without(x, _SPACES) != ""))
    steps, repeats = repeated_words("_words")
    for name, made in steps:
        rows = rows.withColumn(name, made)
    rows = rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(_without(F.col("_text"), _SPACES)).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(_without(F.col("_text"), _SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(_stop_forms()))).cast("long").alias("n_stop_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    broken = []
    for name, (measure, per, least, most) in rules.items():
        share, of = 100 * F.col(measure), F.col(per)
        out = F.lit(False)
        if least is not None:
            out = out | (share < least * of)
        if most is not None:
            out = out | (share > most * of)
        broken.append(F.when((of > 0) & out, F.lit(name)))
    rows = rows.select("*", failed.alias("base_failed"), F.array_compact(F.array(*broken)).alias("broken"))
    return rows.select("*", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))


def oracle(rules: dict[str, tuple[str, str, int | None, int | None]] = RULES) -> str:
    """The same rows as DuckDB SQL."""
    def out(measure, per, least, most):
        sides = [f"100 * {measure} < {least} * {per}"] if least is not None else []
        sides += [f"100 * {measure} > {most} * {per}"] if most is not None else []
        return f"({per} > 0 AND ({' OR '.join(sides)}))"

    forms = ", ".join(f"'{x}'" for x in _stop_forms())
    broken = ", ".join(f"CASE WHEN {out(*rule)} THEN '{name}' END" for name, rule in rules.items())
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
win AS (SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS win FROM starts),
twice AS (SELECT doc_id, win FROM win GROUP BY 1, 2 HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN twice USING (doc_id, win)),
rep AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(words, lambda x: x IN ({forms}))) AS BIGINT) AS n_stop_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  list_filter([{broken}], lambda x: x IS NOT NULL) AS broken FROM m)
SELECT * EXCLUDE (broken), array_to_string(broken, ' ') AS broken, NOT base_failed AND len(broken) = 0 AS kept FROM b
"""
