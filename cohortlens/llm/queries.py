"""The operators of this folder as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import alignment, ctw, dac, jaccard, langid, lpf, merkle, minhash, packing, quality, sentence_spans, tiling, warc
from cohortlens.llm.tokens import path_of

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = langid.identified(table(spark, sf_dir, "documents"))
    return made.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lpf.repeated_spans_removed(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.written_and_read(table(spark, sf_dir, "documents"), path_of("byte_bpe_50k.json"), 2)


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), path_of("word_bpe_49k.json"), 0)


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.transform("matches", lambda m: F.struct(m["item_id"].alias("item_id"), m["covered"].alias("covered"), m["words"].alias("words")))
    return made.withColumn("matches", F.to_json(F.sort_array(items)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.quality(table(spark, sf_dir, "documents"))
    return made.withColumn("broken", F.array_join("broken", " "))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.written_and_read(table(spark, sf_dir, "pages"))
    return made.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.spans_removed(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.without_line_feeds())


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), path_of("byte_bpe_50k.json"), path_of("piece_bpe_32k.model"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("class_id")


QUERIES: dict[str, Query] = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": op1_language_id,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_token_ids": op3_token_ids,
    "op4_context_tree": op4_context_tree,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_string_tiling": op7_string_tiling,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_sentence_spans": op10_sentence_spans,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}
SQL: dict[str, str] = {
    "op8_quality_rules": quality.oracle(),
    "op11_merkle_manifest": merkle.oracle(),
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS leader FROM p),
b AS (SELECT *, [CAST('0x' || substr(hex, 1 + 10 * i, 10) AS BIGINT) for i in range(4)] AS forties FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((forties[1 + i // 8] >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id < leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < leader THEN leader END AS refers_to
FROM b
""",
}
