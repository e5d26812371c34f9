"""From raw headlines to a clean, balanced, deduplicated training table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import map_category
from ..functions.text import clean_text, digest, sample_key, strip
from ..lineage import written
from ..operators.balance import balance
from ..operators.dedup import keep_first


def labelled(raw: DataFrame) -> DataFrame:
    """Rows with a headline; category trimmed; clean_headline and bias added."""
    return (
        raw.filter(F.col("headline").isNotNull())
        .withColumn("category", strip("category"))
        .withColumn("clean_headline", clean_text("headline"))
        .withColumn("bias", map_category("category"))
    )


def prepare(raw: DataFrame, target: int | None = None, id_col: str = "headline_id") -> DataFrame:
    """headline, clean_headline, url, source, category, bias.

    With a ``target`` the classes are balanced to it; without, all rows count. Duplicates are removed after
    balancing and the gap they leave is not refilled; of equal clean texts
    the row taken for its class, of the first class, in hash order, stays.
    """
    rows = labelled(raw)
    picked = rows.withColumn("is_fill", F.lit(False)) if target is None else balance(rows, id_col, target)
    order = [F.col("is_fill"), F.col("bias"), sample_key(id_col), F.col(id_col), F.col("url")]
    picked = written(picked, "picked")
    once = keep_first(picked, [digest(F.col("clean_headline"))], order)
    return once.select("headline", "clean_headline", "url", "source", "category", "bias")
