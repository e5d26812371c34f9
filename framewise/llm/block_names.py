"""Exact dedup by deterministic block naming: equal texts are those that get equal names.

A text without its white space is cut into blocks of fixed size (bytes of its
UTF-8 form). The different blocks are sorted and numbered; then adjacent
pairs of numbers are sorted and numbered in turn, until one number is left of
each text. Names come from comparing contents, not from a hash, so two texts
agree in (levels, name) only when they are equal.

Every level is written to the shared folder. Repeats of a block are counted
before they are shuffled, and names are joined back by a sort-merge join whose
large partitions Spark splits, so a block that a third of all texts share is
no one task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, row_key, stored

BLOCK_BYTES = 4096


def squeezed(text: str | Column) -> Column:
    """The text without blank and \\x09 to \\x0d; null is empty."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for white in " \t\n\v\f\r":
        out = F.replace(out, F.lit(white), F.lit(""))
    return out


def _named(parts: DataFrame, content: list[str]) -> DataFrame:
    """``parts`` (key, place, content...) with a number for each different content."""
    kinds = parts.groupBy(*content).agg(F.lit(0).alias("_")).select(*content)
    kinds = kinds.sortWithinPartitions(*content)
    numbered = kinds.withColumn("name", F.monotonically_increasing_id())
    return parts.join(numbered, content).select("key", "place", "name")


def text_names(docs: DataFrame, key: str, text: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """key, levels, name: one row per ``key``; texts are equal when both numbers are.

    ``key`` must tell different texts apart; its repeats must repeat the text.
    A null or empty text has one empty block.
    """
    raw = docs.select(F.col(key).alias("key"), F.encode(squeezed(text), "UTF-8").alias("raw"))
    last = F.greatest(F.lit(0), (F.octet_length("raw") - 1).cast("bigint")) / block
    parts = raw.withColumn("last", last.cast("int"))
    parts = parts.select("key", "raw", F.explode(F.sequence(F.lit(0), "last")).alias("place"))
    parts = parts.select("key", "place", F.substring("raw", F.col("place") * block + 1, F.lit(block)).alias("block"))
    # repeated rows name the same blocks twice: one is enough, seen when levels are paired
    names = stored(_named(parts, ["block"]), "names")
    level, done = 0, []
    while True:
        sizes = names.groupBy("key").agg(F.max("place").alias("last"))
        single = names.join(sizes.filter("last = 0"), "key")
        done.append(
            single.groupBy("key").agg(F.min("name").alias("name")).select("key", F.lit(level).alias("levels"), "name")
        )
        many = names.join(sizes.filter("last > 0").select("key"), "key", "left_semi")
        if names.filter("place > 0").isEmpty():
            break
        pairs = many.groupBy("key", F.expr("place div 2").cast("int").alias("place")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        names = stored(_named(pairs, ["left", "right"]), "names")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and row_key.

    Texts are equal when identical without white space. The row with the
    most code points in the original text stays, of these the one with the
    smallest id (null last). Null counts as empty. Rows repeated with the same
    id and text count each in group_size, and one of them is kept. Other columns
    are not read. Empty input gives an empty table.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", row_key("doc_id", "text"))
    names = text_names(rows, "key", "text", block)
    seen = rows.select(
        "key", "doc_id", F.char_length("text").alias("n"), F.sha2(squeezed("text"), 256).alias("sha")
    )
    seen = seen.groupBy("key", "doc_id", "n", "sha").agg(F.count("*").alias("copies"))
    known = stored(seen.join(names, "key"), "named")
    best = known.groupBy("levels", "name").agg(
        F.min_by(
            F.struct("doc_id", "key"),
            F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("key")),
        ).alias("best"),
        F.sum("copies").alias("group_size"),
    )
    out = known.join(best, ["levels", "name"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return out.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("key") == F.col("best.key")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("key").alias("row_key"),
    )


def keep_one(docs: DataFrame, decisions: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their own columns; one row for each kept key."""
    kept = decisions.filter("kept").select(F.col("row_key").alias("_key"))
    keyed = docs.withColumn("_key", row_key(id, text))
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")
