"""From raw documents to packed training sequences: every stage takes (spark, docs, sf_dir), works on
all rows that the stage before kept, and is written and read again before the next.

language_id    rows without letters go
near_copies    of texts linked by n-gram similarity the one with the smallest doc_id stays
repeated_spans bytes of a 100-byte string that starts earlier too are cut out; texts that have nothing
               left go, and n_chars is counted anew
benchmark      documents that cover a benchmark item to half or more go
packing        pieces of documents with their place in sequences of 2048 tokens

All stages but the last return the columns of the documents. Defined results: null and empty texts have
no letters and go at the first stage. Of repeated rows (equal doc_id and text) one stays; rows without a
doc_id are linked with nothing, and all but the first of equal ones lose their text. Further columns of the
documents are carried along; an empty table gives no pieces. ORACLE_SQL is None: a learned language
model, byte-exact spans and tokenizers have no SQL; tests hold run() against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm import jaccard, langid, lpf, packing, tiling
from cohortlens.llm.tokens import path_of
from cohortlens.operators.scale import settle

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs.where(~langid.held_out()))
    if not model.languages:  # nothing to learn from: only texts without letters are rejected
        return docs.where(F.col("text").rlike("\\p{L}"))
    return langid.label_spans(docs, model).where("lang_pred != 'und'").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(docs)
    stays = found.where("doc_id = component_id").select(F.col("doc_id").alias("_stays")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    kept = rows.join(stays, F.col("row.doc_id") == F.col("_stays"), "left_semi")
    order = Window.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy("row.text")
    kept = kept.withColumn("copy", F.row_number().over(order)).where("copy = 1").select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = lpf.repeated_spans_removed(docs, rest=True)
    made = made.where("n_removed < n_bytes OR n_bytes = 0")
    given = {c: F.col("rest").getField(c).alias(c) for c in docs.columns if c != "text"} | {"text": F.col("kept_text").alias("text")}
    if "n_chars" in given:
        given["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return made.select(*[given[c] for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return tiling.tiled(docs, items).where("NOT contaminated").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, path_of("word_bpe_49k.json"), 0)


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("repeated_spans", repeated_spans),
    ("benchmark", benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs, _ = settle(stage(spark, docs, sf_dir))
    return docs
