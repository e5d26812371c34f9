"""Which keywords fire, and how often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gates import matched_keywords
from ..sources.dims import keyword_dim


def keyword_hits(df: DataFrame, headline: str = "headline") -> DataFrame:
    """gate, keyword, n_headlines for every keyword, 0 included."""
    hits = (
        df.select(F.lower(headline).alias("_text"))
        .select(F.explode(matched_keywords("_text")).alias("keyword"))
        .groupBy("keyword")
        .agg(F.count("*").alias("n"))
    )
    return (
        keyword_dim(df.sparkSession)
        .join(F.broadcast(hits), "keyword", "left")
        .select("gate", "keyword", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_headlines"))
    )
