"""Class balancing and class weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import SEED
from ..lineage import written
from .sampling import NOTHING, bounds, keyed_rows, marked


def class_distribution(df: DataFrame, label: str = "bias") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str = "bias") -> DataFrame:
    """label, n, weight = rows / (classes * rows of the class)."""
    sizes = class_distribution(df, label)
    # One row per class here, so a window over all of it is small.
    everything = Window.partitionBy(F.lit(0))
    return sizes.withColumn(
        "weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    )


def balance(
    df: DataFrame, id_col: str, target: int, label: str = "bias", seed: int = SEED
) -> DataFrame:
    """Undersample each class to ceil(target / classes), then fill up to ``target``.

    Adds ``is_fill``. Classes smaller than their quota leave a shortage,
    which rows left over in the other classes fill. Both steps take rows in
    hash order.
    """
    keyed, rows = keyed_rows(df, id_col, label, seed)

    def quotas(sizes: dict) -> dict:
        return {g: min(math.ceil(target / len(sizes)), n) for g, n in sizes.items()}

    sizes, base, shares = bounds(rows, quotas)
    if not sizes:
        return df.withColumn("is_fill", F.lit(False))
    split = marked(keyed, base, shares, "_base")
    missing = target - sum(quotas(sizes).values())
    if missing <= 0:
        return split.filter("_base").select(*df.columns, F.lit(False).alias("is_fill"))
    left = split.filter(~F.col("_base")).select(*df.columns, "_key", F.lit("all").alias("_group"))
    rest = written(left.select("_group", "_key"), "keys")
    _, fill, shares = bounds(rest, lambda n: {g: min(missing, k) for g, k in n.items()})
    if shares:  # rows alike in all columns on both sides of the bound: mark the rest by itself
        filled = marked(left, fill, shares, "_fill").filter("_fill").select(*df.columns, F.lit(True).alias("is_fill"))
        return split.filter("_base").select(*df.columns, F.lit(False).alias("is_fill")).unionByName(filled)
    in_fill = F.col("_key") < F.lit(fill.get("all", NOTHING))
    return split.filter(F.col("_base") | in_fill).select(*df.columns, (~F.col("_base")).alias("is_fill"))
