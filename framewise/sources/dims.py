"""Built-in dimension tables. Their size is fixed, so they are safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import (
    HYPOTHESES,
    LABELS,
    NON_POLITICAL_KEYWORDS,
    POLITICAL_KEYWORDS,
    SOURCES,
)


def _literals(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Rows written as literals of the plan, so the optimizer knows how small they are."""

    def lit(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)

    structs = [F.struct(*[lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def source_dim(spark: SparkSession) -> DataFrame:
    """source, base, category, sections, source_rank."""
    rows = [(*s, i) for i, s in enumerate(SOURCES)]
    return _literals(spark, rows, ["source", "base", "category", "sections", "source_rank"])


def section_dim(sources: DataFrame) -> DataFrame:
    """One row per section of a source: source, base, position, section."""
    return sources.select("source", "base", F.posexplode("sections").alias("position", "section"))


def hypothesis_dim(spark: SparkSession) -> DataFrame:
    """class, hyp_id, hypothesis."""
    rows = [(cls, i, text) for i, (cls, text) in enumerate(HYPOTHESES)]
    return _literals(spark, rows, ["class", "hyp_id", "hypothesis"])


def label_dim(spark: SparkSession) -> DataFrame:
    """label_id, label."""
    return _literals(spark, list(enumerate(LABELS)), ["label_id", "label"])


def keyword_dim(spark: SparkSession) -> DataFrame:
    """gate, keyword."""
    rows = [("non_political", k) for k in NON_POLITICAL_KEYWORDS]
    rows += [("political", k) for k in POLITICAL_KEYWORDS]
    return _literals(spark, rows, ["gate", "keyword"])
