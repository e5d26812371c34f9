"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .block_names import exact_dedup
from .hard_negatives import hard_negatives, hard_negatives_oracle
from .hnsw import near_duplicate_vectors
from .language import held_out, identify, learn_languages
from .mixing import mix_oracle, mix_sources
from .packing import pack_documents
from .ranked_search import ranked_search, search_oracle
from .sharding import shard_plan, sharding_oracle
from .shingle_join import jaccard_components
from .token_files import token_digest
from .tokens import tokenizer_path
from .toxicity import learn_toxicity, score_toxicity
from .url_filter import judge_urls
from .warc import warc_round_trip


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(table(spark, sf, "documents"))


def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents"))


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents")).drop("row_key")


def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc_round_trip(table(spark, sf, "pages"))


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_digest(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), end=2)


def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = identify(docs.select("doc_id", "text"), learn_languages(docs))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_ambiguous").alias("ambiguous"),
    )


def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(table(spark, sf, "pages"))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = learn_toxicity(docs, table(spark, sf, "labels"))
    found = score_toxicity(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_spans").alias("n_passages"),
    )


def op10_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), positives=5, negatives=10, percent=(30, 90))


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=20)


def op13_sharding(spark: SparkSession, sf: str) -> DataFrame:
    plan = shard_plan(table(spark, sf, "documents"), shards=24)
    return plan.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_mix_sources": op3_mix_sources,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_token_files": op6_token_files,
    "op7_language": op7_language,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ranked_search": op12_ranked_search,
    "op13_sharding": op13_sharding,
}

ORACLE = {
    "op5_warc": """
    WITH rows AS (
      SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
    ), last AS (
      SELECT html, max(page_id) AS original FROM rows WHERE n >= 1000 GROUP BY html
    )
    SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
      CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN original <> page_id THEN original END AS refers_to
    FROM rows LEFT JOIN last USING (html)""",
    "op3_mix_sources": mix_oracle(),
    "op11_hard_negatives": hard_negatives_oracle(),
    "op12_ranked_search": search_oracle(),
    "op13_sharding": sharding_oracle(),
    "op4_exact_dedup": r"""
    WITH rows AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
    ), best AS (
      SELECT t, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM rows JOIN best USING (t)""",
}
