"""From raw documents to packed training sequences, one stored stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import block_names, language, mixing, packing, shingle_join
from framewise.llm.common import stored
from framewise.llm.tokens import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: without a letter, or between two languages, they go.

    Where there is nothing to learn a language from (no ``lang``, or all rows with one held out),
    only those without a letter go.
    """
    model = language.learn_languages(docs)
    if model is None:
        return language.with_letters(docs)
    found = language.identify(docs, model)
    return found.filter(~F.col("lang_ambiguous")).select(*docs.columns)


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_names.keep_one(docs, block_names.exact_dedup(docs))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.one_of_component(docs, shingle_join.jaccard_components(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", one_of_equal_texts),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed_sequences),
]
#: Tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
