"""The corpus pipeline: documents in, packed token sequences out. Each stage is written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm import langid, mixing, neardup, packing, repeats
from eventloom.llm._common import saved, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Per cent of Jaccard similarity from which documents are copies; op10's 85 is that query's own.
SIMILARITY = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: null texts and texts without a letter go. Rows stand for themselves, repeated
    ones too; of an empty table, or without a labelled row to learn from, none stay."""
    model = langid.train(docs.where(langid.TRAINING), VOCABULARY)
    whole = docs.select(F.struct(*[F.col(f"`{k}`") for k in docs.columns]).alias("whole"), "text")
    return langid.predict(whole, model, "whole").where(F.col("lang_pred") != langid.UNKNOWN).select("whole.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id. Of rows of one doc_id, the first text
    stays; rows without a doc_id stay as they are."""
    kept = neardup.near_duplicates(docs, percent=SIMILARITY).where("kept").select("doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    named = docs.join(kept, "doc_id", "left_semi").select(F.struct(*[F.col(f"`{k}`") for k in docs.columns]).alias("whole"), rank.alias("rank")).where("rank = 1").select("whole.*")
    return named.unionByName(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that documents of smaller doc_id hold too; n_chars, where there
    is such a column, follows the text."""
    left = repeats.remove_repeats(docs, with_text=True)
    return left if "n_chars" not in docs.columns else left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the packed sequences."""
    return packing.packed(docs, TOKENIZER)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("suffix_repeats", without_repeats),
    ("mix_sources", to_weights),
    ("best_fit_packing", into_sequences),
]

#: The stages as a whole aren't expressible in SQL; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
