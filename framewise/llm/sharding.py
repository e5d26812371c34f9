"""Sharding by proportional stratified interleaving: every shard holds the mixture of the whole.

The rows of each source are put in a seeded order; the r-th of a source's n
rows stands at the fraction (r + 1/2) / n of the way. Sorted by that fraction
the sources interleave in proportion, so any stretch of the order has the
mixture of the corpus, and cutting it into equal stretches gives the shards:
row counts are at most one apart, and a shard's share of a source is off by
a row or two.

Neither the rank within a source nor the place in the order needs a task that
sees them all: rows are dealt to buckets that are in order among themselves,
counts per bucket are summed up in two levels, and only the rows of one bucket
(about ``BUCKET_ROWS``) are sorted together. A source that holds a third of all
rows has as many buckets as it needs. Texts are read once and not shuffled; ``write_shards``
moves them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted_before, repeats, stored

#: Rows sorted together.
BUCKET_ROWS = 1024


def order_key(seed: str, id: str, text: str) -> Column:
    """The seeded order of rows: md5 of seed, id and text (left out if null). Equal only for equal rows."""
    row = F.coalesce(F.col(id).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(seed), row, F.col(text)))


def shard_plan(
    docs: DataFrame, shards: int = 24, seed: str = "shards", id: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: row_key, doc_id, source, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 8, ``text_crc32`` their
    CRC-32. Shards are numbered from 0 and slots, the places in a shard, from 0 without gaps.
    A null source is a source of its own. Rows that agree in id, text and source
    are one document stored several times; each gets a place. Rows with the
    same or a null id are told apart by their text. Equal fractions go in order of the source,
    null first. Where there are fewer rows than shards some shards stay empty;
    an empty table gives an empty table. Other columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        order_key(seed, id, text).alias("row_key"),
        F.col(id).alias("doc_id"),
        F.col(source).alias("source"),
        (F.octet_length(whole).cast("bigint") + 8).alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
    )
    rows = stored(repeats(rows), "shard-rows")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    buckets = max(1, total // BUCKET_ROWS)
    first = F.conv(F.substring("row_key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    rows = rows.withColumn("bucket", F.floor(first * buckets).cast("bigint"))

    # rank within the source
    counts = rows.groupBy("source", "bucket").agg(F.sum("copies").alias("n"))
    before = counted_before(counts, ["source"], "bucket")
    of_source = before.select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.col("before").alias("_before"), F.col("total").alias("n")
    )
    here = Window.partitionBy("source", "bucket").orderBy("row_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("rank", F.coalesce(F.sum("copies").over(here), F.lit(0)))
    ranked = ranked.join(of_source, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("_before") + F.col("copy"))
    ranked = ranked.withColumn("fraction", (F.col("rank") + 0.5) / F.col("n"))
    ranked = ranked.select(
        "row_key", "doc_id", "source", "size", "text_crc32", "rank", "fraction",
        F.floor(F.col("fraction") * buckets).cast("bigint").alias("bucket"),
    )
    ranked = stored(ranked, "shard-ranks")

    # place in the order of fractions
    counts = ranked.groupBy("bucket").agg(F.count("*").alias("n"))
    before = counted_before(counts, [], "bucket").select("bucket", "before")
    here = Window.partitionBy("bucket").orderBy("fraction", F.asc_nulls_first("source"), "rank")
    placed = ranked.withColumn("place", F.row_number().over(here) - 1).join(before, "bucket")
    place = F.col("place") + F.col("before")
    placed = placed.withColumn("place", place).withColumn("shard", F.expr(f"place * {shards} div {max(total, 1)}"))
    slot = F.col("place") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.select("row_key", "doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), slot.alias("slot"))


def write_shards(
    docs: DataFrame, plan: DataFrame, path: str, seed: str = "shards", id: str = "doc_id", source: str = "source", text: str = "text",
    rows_per_file: int = 100_000,
) -> None:
    """Write the rows of ``docs`` with their slots as Parquet under ``path``, a folder per shard.

    A file holds a stretch of slots in order. Texts are shuffled once to meet
    their places and once to their files. Of rows that agree in id, text and
    source, the other columns of any one stand for all. Columns named shard, slot or _key are replaced.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot", "_key")]
    once = docs.select(*names, order_key(seed, id, text).alias("_key")).dropDuplicates(["_key", source])
    places = plan.select(F.col("row_key").alias("_key"), F.col("source").alias("_source"), "shard", "slot")
    rows = places.join(once, ["_key"]).filter(F.col("_source").eqNullSafe(F.col(source))).drop("_source", "_key")
    laid = rows.repartition("shard", F.expr(f"slot div {rows_per_file}")).sortWithinPartitions("shard", "slot")
    laid.select(*names, "slot", "shard").write.partitionBy("shard").parquet(path)


def sharding_oracle(shards: int = 24, seed: str = "shards") -> str:
    """The query's rows in DuckDB SQL; the CRC is taken byte by byte from a table made by its rule."""
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    step = "i AS c"
    table = f"SELECT i, {step} FROM range(256) AS t(i)"
    for _ in range(8):
        table = f"SELECT i, {shift} AS c FROM ({table})"
    return f"""
    WITH entries AS (SELECT list(c::BIGINT ORDER BY i) AS crc FROM ({table})),
    rows AS (
      SELECT doc_id, source, text, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
        md5(concat_ws(':', '{seed}', coalesce(doc_id::VARCHAR, 'null'), text)) AS k FROM documents
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM rows
    ), placed AS (
      SELECT *, row_number() OVER (ORDER BY (r::DOUBLE + 0.5::DOUBLE) / n::DOUBLE, source NULLS FIRST, r) - 1 AS p, count(*) OVER () AS total FROM ranked
    ), cut AS (
      SELECT *, p * {shards} // total AS s FROM placed
    )
    SELECT doc_id, size,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32,
      'rows' AS law, s::INTEGER AS shard, p - (s * total + {shards - 1}) // {shards} AS slot, NULL::INTEGER AS grown_shard
    FROM cut, entries"""
