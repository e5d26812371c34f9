"""Mixing sources to target weights by Poisson replication.

A source that holds less of the corpus than its weight asks for is repeated,
one that holds more is thinned: each document appears as often as a Poisson
variable with the source's repetition rate as its mean. The variable is the
inverse of the distribution at a number hashed from seed and document, so the
same documents give the same mixture on every run and any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Largest mean drawn at once; a higher rate is the sum of several draws.
MEAN = 256.0


def repetition_rates(
    docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, size: float = 1.0,
    source: str = "source", text: str = "text",
) -> DataFrame:
    """source, n_docs, n_chars, weight, rate: how often a document of each source should appear.

    ``weights`` (source, weight) are the shares of characters the mixture
    should have; a source without one, or with null or a weight of 0 or less,
    goes. Without ``weights`` the share of a source grows with its characters
    to ``power``. ``size`` is the characters of the mixture over those of the
    documents. A null source is a source of its own (matched by a null in
    ``weights``). A source without characters has rate 0.
    """
    own = docs.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("n_docs"),
        F.sum(F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")).alias("n_chars"),
    )
    own = stored(own, "sources")
    if weights is None:
        own = own.withColumn("weight", F.pow(F.col("n_chars").cast("double"), F.lit(power)))
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").alias("_w"))
        own = own.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "n_docs", "n_chars", F.greatest(F.coalesce(F.col("_w").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight")
        )
    totals = own.filter("n_chars > 0").agg(F.sum("n_chars").alias("_chars"), F.sum("weight").alias("_weight"))
    rate = F.lit(size) * F.col("_chars") * F.col("weight") / F.col("_weight") / F.col("n_chars")
    out = own.join(F.broadcast(totals))  # one row
    rate = F.when((F.col("n_chars") > 0) & (F.col("_weight") > 0), rate).otherwise(0.0)
    return out.select("source", "n_docs", "n_chars", "weight", rate.alias("rate"))


def row_name(id: str, text: str) -> Column:
    """What tells a row from others: its id and the md5 of its text."""
    return F.concat_ws(":", F.coalesce(F.col(id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit(""))))


def uniform(*parts: str | Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of the md5 of ``parts``."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _cumulative(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable as far as doubles below 1 reach."""
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step)["c"]


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, size: float = 1.0,
    seed: str = "mix", id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """Every row of ``docs`` as often as its Poisson number says, in an order shuffled as a whole.

    Adds copy (from 1), copies and mix_key, replacing columns of these names.
    Copies are dealt to partitions by mix_key and stand in its order there. A row's number
    follows from its id and text, so rows with a null or a repeated id draw each their own. Rows that agree in both
    draw each their own too, by their places in the table (only for them a mixture
    depends on how the table is stored). Texts are read whole, however long. Weights
    and rates as in ``repetition_rates``. Empty input gives an empty table.
    """
    docs = docs.withColumn("_row", row_name(id, text))
    again = stored(docs.groupBy("_row").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("_row").alias("_again")), "repeated-rows")
    rates = repetition_rates(docs, weights, power, size, source, text)
    draws = F.greatest(F.ceil(F.col("rate") / MEAN), F.lit(1)).cast("int")
    rates = rates.withColumn("_draws", draws)
    rates = stored(
        rates.select(F.col("source").alias("_source"), "_draws", _cumulative(F.col("rate") / F.col("_draws")).alias("_cdf")),
        "rates",
    )
    # the table of rates is stored, so Spark knows its size and broadcasts it only if small
    at = docs.drop("copy", "copies", "mix_key").join(
        rates, F.col(source).eqNullSafe(F.col("_source"))
    )
    at = at.withColumn("_place", F.monotonically_increasing_id())
    at = at.join(again, F.col("_row") == F.col("_again"), "left")
    row = F.when(F.col("_again").isNull(), F.col("_row")).otherwise(F.concat_ws(":", "_row", F.col("_place").cast("string")))
    at = at.withColumn("_row", row)

    def drawn(j: Column) -> Column:
        number = F.transform(F.array(uniform(F.lit(seed), "_row", j.cast("string"))), lambda u: F.size(F.filter("_cdf", lambda c: c <= u)))
        return F.get(number, 0)

    number = F.aggregate(F.sequence(F.lit(1), "_draws"), F.lit(0), lambda n, j: n + drawn(j))
    at = at.withColumn("copies", number).filter("copies > 0")
    at = at.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    at = at.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), "_row", F.col("copy").cast("string"))))
    at = at.select(*[c for c in docs.columns if c not in ("copy", "copies", "mix_key", "_row")], "copy", "copies", "mix_key")
    return at.repartition("mix_key").sortWithinPartitions("mix_key")


def mix_oracle(seed: str = "mix", power: float = 0.5) -> str:
    """The same in DuckDB SQL, for rates up to ``MEAN``."""
    return f"""
    WITH own AS (
      SELECT source, sum(coalesce(length(text), 0))::BIGINT AS n_chars FROM documents GROUP BY source
    ), weighed AS (
      SELECT *, pow(n_chars::DOUBLE, {power}) AS weight FROM own
    ), rates AS (
      SELECT source, (SELECT sum(n_chars) FROM own)::DOUBLE * weight
        / (SELECT sum(weight) FROM weighed) / n_chars AS rate FROM weighed WHERE n_chars > 0
    ), steps AS (
      SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
      FROM rates, range(0, 400) AS t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)
    ), cdf AS (
      SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps
    ), drawn AS (
      SELECT d.*, coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) AS row_name,
        ('0x' || substr(md5('{seed}:' || row_name || ':1'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM documents d
    ), counted AS (
      SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, d.row_name, count(*)::INTEGER AS copies
      FROM drawn d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= d.u
      GROUP BY ALL
    )
    SELECT doc_id, text, lang, source, n_chars, t.copy::INTEGER AS copy, copies,
      md5('{seed}:' || row_name || ':' || t.copy) AS mix_key
    FROM counted, LATERAL (SELECT unnest(range(1, copies + 1)) AS copy) AS t"""
