"""Keep-first deduplication and top-up."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, norm_key
from ..lineage import written


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """For each key, the row that comes first in ``order``; of equal rows one.

    First the winners, in narrow tables of keys, order and a hash of the row: every task
    counts equal rows and reduces a key to one before the shuffle, so a key held by a third of all
    rows sends one row per task. Then the winners' rows are fetched from ``df``, by
    a hash join that builds on the winners: whole rows are never sorted and meet
    no aggregate, but where a winner occurs several times. ``df`` is read twice, or three
    times then: store it first where it is dear.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    ranks = [f"_order{i}" for i in range(len(order))]
    rows = df.select(
        *df.columns,
        *[k.alias(n) for k, n in zip(keys, names)],
        *[o.alias(r) for o, r in zip(order, ranks)],
        F.xxhash64(*df.columns).alias("_row"),
    )
    each = rows.groupBy(*names, *ranks, "_row").agg(F.count("*").alias("_n"))
    best = each.groupBy(*names).agg(F.min(F.struct(*ranks, "_row", "_n")).alias("_best"))
    best = written(best.select(*[F.col(n).alias(f"{n}_") for n in names], "_best.*"), "winners")
    best = best.withColumnsRenamed({c: f"{c}_" for c in (*ranks, "_row")})

    def fetched(winners: DataFrame) -> DataFrame:
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*names, *ranks, "_row")])
        return rows.join(winners.hint("shuffle_hash"), same, "left_semi").select(*df.columns)

    once = fetched(best.filter("_n = 1"))
    several = best.filter("_n > 1")
    return once if several.isEmpty() else once.unionByName(fetched(several).distinct())


def dedup_headlines(
    df: DataFrame, order: list[Column], headline: str = "headline", within: list[str] | None = None
) -> DataFrame:
    """One row per title (ignoring case and outer white space), within ``within`` if given."""
    keys = [F.col(c) for c in within or []] + [digest(norm_key(headline))]
    return keep_first(df, keys, order)


def not_collected(new: DataFrame, existing: DataFrame, headline: str = "headline") -> DataFrame:
    """Rows of ``new`` whose title does not occur in ``existing``.

    ``existing`` is reduced to distinct digests first; ``new`` should hold
    each title once, as ``dedup_headlines`` leaves it, so no key is hot.
    """
    key = digest(norm_key(headline))
    seen = existing.select(key.alias("_title")).distinct()
    return new.withColumn("_title", key).join(seen, "_title", "left_anti").drop("_title")
