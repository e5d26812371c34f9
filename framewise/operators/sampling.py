"""Exact samples by hash order, without sorting, shuffling or collecting a group.

The reproducible key of a row is ``md5(seed:id)`` and, among rows of one id, a
hash of the whole row. The n rows of a group with the smallest keys are those
below the group's *bound*. It is found by counting rows per key prefix: the prefix
in which the n-th key lies is read off the running count, and prefixes are
made longer until no row of that prefix is on the other side, or the key ends. Rows
are then kept by comparing their key with the bound, so wide rows are never
shuffled, whatever the size of a group. The driver sees one row per group.

A null id is a value like any other. Rows that are alike in all columns are
interchangeable: where a bound falls among them, the right number of them is taken.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import SEED, TEST_FRACTION
from ..functions.text import sample_key
from ..lineage import written

STEP = 3  # hexadecimal digits a prefix grows by: 4096 parts
KEY_DIGITS = 48
STRETCH = 1 << 16  # rows alike that are counted together
NOTHING, EVERYTHING = "", "~"  # below and above every key


def row_key(df: DataFrame, id_col: str, seed: int = SEED) -> Column:
    """48 hexadecimal digits: the sample key of the id, then a hash of the row."""
    of_row = F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0")
    return F.concat(sample_key(id_col, seed), F.lower(of_row))


def _name(group: Column) -> Column:
    """The group as a string that no two groups share."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("null"))


def _looked_up(values: dict, otherwise: str) -> Column:
    """The value of the row's group from a literal map."""
    if not values:
        return F.lit(otherwise)
    table = F.from_json(F.lit(json.dumps(values)), "map<string,string>")
    return F.coalesce(F.element_at(table, F.col("_group")), F.lit(otherwise))


def bounds(rows: DataFrame, quota: Callable[[dict], dict]) -> tuple[dict, dict, dict]:
    """(sizes, bounds, shares) per group of ``rows`` (columns: _group, _key; stored).

    ``quota`` turns the sizes of all groups into the number of rows wanted
    from each. A row is wanted if its key is below the bound; of the rows
    whose key is the bound, the share says how many, if not none.
    """
    digits, parts, found, shares = STEP, rows, {}, {}
    sizes = wanted = todo = None
    while todo is None or todo:
        prefix = F.substring("_key", 1, digits).alias("_prefix")
        counts = written(parts.groupBy("_group", prefix).agg(F.count("*").alias("_count")), "prefixes")
        if todo is None:
            total = counts.groupBy("_group").agg(F.sum("_count").alias("n")).collect()
            sizes = {r._group: r.n for r in total}
            wanted = quota(sizes)
            found |= {g: NOTHING for g, n in wanted.items() if n <= 0}
            found |= {g: EVERYTHING for g, n in wanted.items() if n >= sizes[g] and n > 0}
            todo = {g: n for g, n in wanted.items() if g not in found}
            if not todo:
                break
        n = _looked_up({g: str(k) for g, k in todo.items()}, "0").cast("bigint")
        upto = F.col("_upto")
        running = Window.partitionBy("_group").orderBy("_prefix")  # at most 4096 rows of a group
        edges = (
            counts.withColumn("_upto", F.sum("_count").over(running))
            .filter((upto >= n) & (upto - F.col("_count") < n))
            .select("_group", "_prefix", (n - upto + F.col("_count")).alias("left"), "_count")
            .collect()
        )
        todo, places = {}, {}
        for r in edges:
            if r.left == r["_count"]:
                found[r._group] = r._prefix + EVERYTHING
            elif digits >= KEY_DIGITS:
                found[r._group], shares[r._group] = r._prefix, r.left
            else:
                todo[r._group], places[r._group] = r.left, r._prefix
        if todo:
            parts = rows.filter(F.col("_key").startswith(_looked_up(places, EVERYTHING)))
            digits = min(digits + STEP, KEY_DIGITS)
    return sizes, found, shares


def marked(keyed: DataFrame, found: dict, shares: dict, flag: str) -> DataFrame:
    """``keyed`` (with _group and _key) with the boolean ``flag``: below the bound of the group."""
    bound = _looked_up(found, NOTHING)
    out = keyed.withColumn(flag, F.col("_key") < bound)
    if not shares:
        return out
    alike = (F.col("_key") == bound) & (_looked_up({g: "y" for g in shares}, "n") == "y")
    share = _looked_up({g: str(n) for g, n in shares.items()}, "0").cast("bigint")
    # rows alike are counted by stretches of the table and numbered by running sums over the stretches
    stretch = F.shiftright(F.monotonically_increasing_id(), STRETCH.bit_length() - 1)
    tied = keyed.filter(alike).withColumn("_stretch", stretch).groupBy(*keyed.columns, "_stretch").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    tied = tied.withColumn("_before", F.coalesce(before, F.lit(0)))
    tied = tied.withColumn("_nth", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_n"))))
    tied = tied.select(*keyed.columns, (F.col("_nth") <= share).alias(flag))
    return out.filter(~alike).unionByName(tied)


def keyed_rows(df: DataFrame, id_col: str, group: str | None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``df`` with _group and _key, and these two columns as a stored table."""
    name = _name(F.col(group)) if group else F.lit("all")
    keyed = df.withColumn("_key", row_key(df, id_col, seed)).withColumn("_group", name)
    return keyed, written(keyed.select("_group", "_key"), "keys")


def take_fraction(
    df: DataFrame,
    id_col: str,
    size: Callable[[int], int],
    flag: str,
    group: str | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Add the boolean ``flag``: true for the first ``size(n)`` rows of each group of n rows."""
    keyed, rows = keyed_rows(df, id_col, group, seed)
    _, found, shares = bounds(rows, lambda n: {g: size(k) for g, k in n.items()})
    return marked(keyed, found, shares, flag).select(*df.columns, flag)


def stratified_split(
    df: DataFrame, id_col: str, label: str, fraction: float = TEST_FRACTION, flag: str = "is_test"
) -> DataFrame:
    """Mark ceil(fraction * n) rows of every label as test rows."""
    return take_fraction(df, id_col, lambda n: math.ceil(fraction * n), flag, label)


def plain_split(
    df: DataFrame, id_col: str, fraction: float = TEST_FRACTION, flag: str = "is_test"
) -> DataFrame:
    """Mark ceil(fraction * n) of all rows as test rows."""
    return take_fraction(df, id_col, lambda n: math.ceil(fraction * n), flag)


def eval_sample(df: DataFrame, id_col: str, fraction: float = TEST_FRACTION) -> DataFrame:
    """round(fraction * n) of all rows."""
    taken = take_fraction(df, id_col, lambda n: round(fraction * n), "_taken")
    return taken.filter("_taken").drop("_taken")
