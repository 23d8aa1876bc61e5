"""The numbered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import alignment, extraction, histogram, langid, licenses, mixing, neardup, packing, quality, repeats, spotsigs, topk, turns
from ._common import table


def _held_out(modulus: int, remainder: int):
    """Whether a document is held out; one without a doc_id isn't learned from, so it is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(True))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample_sizes(table(spark, sf_dir, "documents"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(table(spark, sf_dir, "embeddings"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = labels.where(quality.TRAINING).select("doc_id", F.col("quality").alias("label"))
    weights, bias = quality.train(docs, labelled)
    found = quality.score(docs, weights, bias)
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.TRAINING), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return langid.predict(docs, model, "doc_id").select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op10_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_license_scan": op4_license_scan,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_spotsigs": op7_spotsigs,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_minhash_near_duplicates": op10_minhash_near_duplicates,
    "op11_token_alignment": op11_token_alignment,
    "op12_shortest_pack_first": op12_shortest_pack_first,
    "op13_turn_repair": op13_turn_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {}
