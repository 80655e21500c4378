"""Language identification of texts that may mix languages.

Words are runs of letters. The script ranges of a word's first letter narrow the candidates to the
languages whose training texts use that script; each candidate's score is the word's log-likelihood under
the language's byte n-grams (orders 1 to 4 of the lower-cased word between borders, hashed into a fixed
number of cells). Viterbi over the words, with a penalty for each switch, labels spans; the predicted
language is the one whose spans hold most letters, the score its share of them.

The classifier is fitted on a sample of labelled rows of bounded size (``fit_documents`` for each language,
chosen by a hash of the id); its tables hold ``CELLS`` numbers per language and are all that reaches the
driver and the tasks. Every whole text of the table is then labelled, many texts at a time: step t of the
recursion handles word t of all texts of a batch.

Defined results: a text that is null or has no letters is ``und`` with score 0 and no spans; so is every
text if nothing can be learned. Rows without a label aren't learned from. Ties go to the language first
in the alphabet. Repeated rows and rows without a doc_id are labelled like any other; extra columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.llm.common import U64, crc_of_id, give_back, mix

FIT_DOCUMENTS = 2_000
CELLS = 1 << 16
ORDERS = 4
SMOOTHING = 0.5
SWITCH_PENALTY = 12.0
#: A language uses a script if at least this share of its training letters is of it.
SCRIPT_SHARE = 0.001
#: Words whose scores a task keeps, words scored at once, and texts in one recursion.
TABLE = 200_000
WORDS = 20_000
TEXTS = 1_000
#: Letters of any script; number signs such as one half or Roman eight are none.
_WORD = regex.compile(r"\p{L}+")

#: First letters of blocks of scripts, fixed values of the Unicode standard.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"),
    (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"),
    (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"),
]
_STARTS = np.array([x for x, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_CODE = np.array([_NAMES.index(name) for _, name in SCRIPTS])


@dataclass(frozen=True)
class Model:
    """languages; log-probability of each cell and the scripts used, by language."""

    languages: list[str]
    cells: np.ndarray
    scripts: np.ndarray


def scripts_of(words: list[str]) -> np.ndarray:
    first = np.array([ord(w[0]) for w in words], np.int64)
    return _CODE[np.searchsorted(_STARTS, first, "right") - 1]


def gram_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, cell) of all byte n-grams of the words between borders."""
    spelt = [b"\x02%b\x03" % w.encode() for w in words]
    sizes = np.array([len(x) for x in spelt], np.int64)
    data = np.frombuffer(b"".join(spelt), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    which, cells, value = [], [], np.zeros(len(data), np.uint64)
    for order in range(1, ORDERS + 1):
        value = (value[: len(data) - order + 1] << U64(8)) | data[order - 1 :]
        inside = word[order - 1 :] == word[: len(value)]
        which.append(word[: len(value)][inside])
        cells.append((mix(value[inside] + (U64(order) << U64(40))) % U64(CELLS)).astype(np.int64))
    return np.concatenate(which), np.concatenate(cells)


def learn(labelled: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Fit on labelled rows (doc_id, text, lang): counts of the cells and scripts of each language."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, CELLS), np.float32), np.zeros((0, len(_NAMES)), bool))
    languages = sorted(sizes)
    # every row of a language of few rows, else about fit_documents of them
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit(17)), F.lit(1_000_000))
    most = F.coalesce(*[F.when(F.col("lang") == x, F.lit(max(1, round(1_000_000 * fit_documents / n)))) for x, n in sizes.items()])

    def counts(batches):
        for batch in batches:
            for lang in set(batch.column("lang").to_pylist()):
                texts = batch.filter(pa.compute.equal(batch.column("lang"), lang)).column("text").to_pylist()
                total = np.zeros(CELLS + len(_NAMES), np.int64)
                for text in texts:
                    if words := _WORD.findall(text.lower()):
                        total[:CELLS] += np.bincount(gram_cells(words)[1], minlength=CELLS)
                        total[CELLS:] += np.bincount(scripts_of(words), [len(w) for w in words], len(_NAMES)).astype(np.int64)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "cell": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    found = rows.where(draw < most).select("text", "lang").mapInArrow(counts, "lang string, cell int, n long")
    total = np.zeros((len(languages), CELLS + len(_NAMES)))
    sums = found.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows a language
    row = np.array([languages.index(x) for x in sums["lang"].to_pylist()], np.int64)
    total[row, sums["cell"].to_numpy()] = sums["n"].to_numpy()
    grams, letters = total[:, :CELLS] + SMOOTHING, total[:, CELLS:]
    cells = np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32)
    return Model(languages, cells, letters >= SCRIPT_SHARE * np.maximum(letters.sum(1, keepdims=True), 1))


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Log-likelihood of each word by language; languages that don't use its script are far behind."""
    which, cells = gram_cells(words)
    ends = np.flatnonzero(np.diff(which, prepend=-1) != 0)  # grams come order by order, words ascending
    scores = np.zeros((len(words), len(model.languages)), np.float32)
    for i in range(len(model.languages)):
        sums = np.add.reduceat(model.cells[i][cells], ends)
        scores[:, i] = np.bincount(which[ends], sums, len(words)) / ORDERS
    uses = model.scripts[:, scripts_of(words)].T
    return np.where(uses | ~uses.any(1, keepdims=True), scores, scores.min(1, keepdims=True) - 100)


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word. scores: the words of all texts after each other; sizes: words of
    each text. Word t of all texts that are long enough is one step."""
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begins, lengths = begins[order], sizes[order]
    came = np.zeros(scores.shape, np.uint8 if scores.shape[1] < 256 else np.uint16)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    value = scores[begins[: active[0]]].copy()
    last = np.empty((len(sizes), scores.shape[1]), scores.dtype)
    stay = np.arange(scores.shape[1], dtype=came.dtype)
    for t in range(1, int(lengths[0])):
        n = active[t]
        if n < len(value):
            last[n : len(value)] = value[n:]
            value = value[:n]
        at = begins[:n] + t
        best = value.argmax(1)
        jump = value[np.arange(n), best][:, None] - penalty
        switch = jump > value
        came[at] = np.where(switch, best[:, None], stay)
        value = np.where(switch, jump, value) + scores[at]
    last[: len(value)] = value
    label = np.zeros(len(scores), came.dtype)
    now = last.argmax(1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = active[t]
        at = begins[:n] + t
        label[at] = now[:n]
        now[:n] = came[at, now[:n]] if t else now[:n]
    return label


def label_spans(df: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """row (a struct of all columns), lang_pred, score and spans (first word, words, letters, lang)."""
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.cells, model.scripts))

    def rows(batches):
        own = Model(*shared.value)
        known, table = {}, np.empty((0, len(own.languages)), np.float32)
        for batch in batches:
            give_back()
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                texts = pa.compute.struct_field(part.column("row"), text_at).cast(pa.string()).to_pylist()
                if len(known) > TABLE:
                    known, table = {}, table[:0]
                new, ids, letters = [], [], []
                for text in texts:
                    found = _WORD.findall((text or "").lower())
                    at = list(map(known.get, found))
                    if None in at:
                        for i, x in enumerate(at):
                            if x is None:
                                x = known.get(found[i])
                                if x is None:
                                    x = known[found[i]] = len(known)
                                    new.append(found[i])
                                at[i] = x
                    ids.append(np.array(at, np.int32))
                    letters.append(np.fromiter(map(len, found), np.int32, len(found)))
                if new and own.languages:
                    table = np.concatenate([table, *(word_scores(own, new[i : i + WORDS]) for i in range(0, len(new), WORDS))])
                made = _labelled(own, ids, letters, table, penalty)
                yield pa.RecordBatch.from_arrays([part.column("row"), *made], names=["row", "lang_pred", "score", "spans"])

    given = df.select(F.struct("*").alias("row"))  # the text travels once, inside the row
    text_at = df.columns.index("text")
    return given.mapInArrow(rows, StructType([given.schema["row"], *StructType.fromDDL(LABELS).fields]))


LABELS = "lang_pred string, score double, spans array<struct<word: int, words: int, letters: int, lang: string>>"
SPAN = pa.struct([("word", pa.int32()), ("words", pa.int32()), ("letters", pa.int32()), ("lang", pa.string())])


def _labelled(model: Model, ids: list[np.ndarray], letters: list[np.ndarray], table: np.ndarray, penalty: float) -> list[pa.Array]:
    n, sizes = len(ids), np.array([len(x) for x in ids], np.int64)
    names, pred, score = np.array([*model.languages, "und"], object), np.full(n, len(model.languages)), np.zeros(n)
    offsets, spans = np.zeros(n + 1, np.int32), None
    if sizes.sum() and model.languages:
        all_ids, all_letters = np.concatenate(ids), np.concatenate(letters)
        text = np.repeat(np.arange(n), sizes)
        label = viterbi(table[all_ids], sizes, penalty).astype(np.int64)
        held = np.bincount(text * len(model.languages) + label, all_letters, n * len(model.languages)).reshape(n, -1)
        some = sizes > 0
        pred[some] = held[some].argmax(1)
        score[some] = held[some].max(1) / held[some].sum(1)
        cut = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (text[1:] != text[:-1])])
        begin = (np.cumsum(sizes) - sizes)[text[cut]]
        ends = np.r_[cut[1:], len(label)]
        offsets = np.searchsorted(text[cut], np.arange(n + 1)).astype(np.int32)
        spans = [
            pa.array((cut - begin).astype(np.int32)), pa.array((ends - cut).astype(np.int32)),
            pa.array(np.add.reduceat(all_letters, cut).astype(np.int32)), pa.array(names[label[cut]], pa.string()),
        ]
    values = pa.StructArray.from_arrays(spans, fields=list(SPAN)) if spans else pa.array([], SPAN)
    return [pa.array(names[pred], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), values)]


def held_out(folds: int = 5, id_column: str = "doc_id") -> Column:
    """Whether a row's label is kept from the classifier: crc32 of the id, modulo, is 0."""
    return crc_of_id(id_column) % folds == 0


def identified(df: DataFrame, fit_documents: int = FIT_DOCUMENTS, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Learn from the rows that aren't held out and label all: doc_id, held_out, lang_pred, score, spans."""
    model = learn(df.where(~held_out()), fit_documents)
    made = label_spans(df.select("doc_id", "text"), model, penalty)
    return made.select("row.doc_id", held_out(id_column="row.doc_id").alias("held_out"), "lang_pred", "score", "spans")
