"""One CSV file read by many tasks, also where texts hold line breaks.

Spark hands out lines of splits in parallel; what a task can't know is whether its split
begins inside a quoted text. So quotes are counted per split first. Their sum over the splits before,
odd or even, says so, and with it each task finds the line breaks that end a record.
A record that runs over the end of a split comes out in pieces, which are put together by the split it began in.
Quotes inside a text are doubled, as writers do, and a text that holds a quote is quoted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import written

SPLITS = "spark.sql.files.minPartitionNum"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split in the file), value: lines, ended by a line feed."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


#: Kinds of pieces: a record, the first piece of one (of a file's heading), a later piece.
WHOLE, FIRST, HEADING, LATER = 0, 1, 2, 3


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines in order, with whether their split begins inside a text, to pieces of records.

    The first record of a file is its heading and left out where it is whole.
    """
    split, inside, held, kind = None, False, [], WHOLE

    def unended() -> list[tuple]:
        return [(*split, FIRST if kind == WHOLE else kind, "\n".join(held))] if held else []

    for batch in batches:
        out = []
        for file, start, value, odd in zip(*(batch[c].tolist() for c in ("file", "start", "value", "odd"))):
            if (file, start) != split:
                out += unended()
                split, inside, held = (file, start), odd, []
                kind = LATER if inside else WHOLE if start else HEADING
            held.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                if kind != HEADING:
                    out.append((*split, kind, "\n".join(held)))
                held, kind = [], WHOLE
        yield pd.DataFrame(out, columns=["file", "start", "kind", "record"])
    yield pd.DataFrame(unended(), columns=["file", "start", "kind", "record"])


def records(spark: SparkSession, path: str, splits: int | None = None) -> DataFrame:
    """record: the records of all CSV files under ``path`` but the first of each file, a stored table.

    A file is cut into splits of ``spark.sql.files.maxPartitionBytes``, and into about
    ``splits`` at least. The table of splits has a row for each, as many as the driver
    lists itself, and is given to all tasks.
    """
    before = spark.conf.get(SPLITS, None)
    # both passes must see the same splits, whatever number of cores there is meanwhile
    spark.conf.set(SPLITS, str(splits or spark.sparkContext.defaultParallelism))
    try:
        quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
        counts = written(_lines(spark, path).groupBy("file", "start").agg(quotes.alias("quotes")), "quotes")
        order = Window.partitionBy("file").orderBy("start")  # one row per split
        odd = ((F.sum("quotes").over(order) - F.col("quotes")) % 2 == 1).alias("odd")
        parity = counts.select(F.col("file").alias("_file"), F.col("start").alias("_start"), odd)
        lines = _lines(spark, path)
        lines = lines.join(F.broadcast(parity), (lines["file"] == F.col("_file")) & (lines["start"] == F.col("_start")), "left")
        known = F.coalesce("odd", F.raise_error(F.lit("the splits of the file have changed")).cast("boolean"))
        found = lines.select("file", "start", "value", known.alias("odd"))
        found = written(found.mapInPandas(_pieces, "file string, start bigint, kind int, record string"), "pieces")
    finally:
        spark.conf.unset(SPLITS) if before is None else spark.conf.set(SPLITS, before)
    # a split has two pieces at most, the later piece of one record before the first of another
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    begun = F.sum((F.col("kind") != LATER).cast("int")).over(order)
    number = found.filter(F.col("kind") != WHOLE).select("file", "start", "kind", begun.alias("nth"))
    parts = found.filter(F.col("kind") != WHOLE).join(number, ["file", "start", "kind"]).groupBy("file", "nth").agg(
        F.array_sort(F.collect_list(F.struct("start", (-F.col("kind")).alias("after"), "record"))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda x: x["record"]), "\n").alias("record")
    heading = F.exists("parts", lambda x: x["after"] == -HEADING)
    parts = parts.filter(~heading).select(joined)
    whole = found.filter(F.col("kind") == WHOLE).select("record").unionByName(parts)
    whole = whole.withColumn("record", F.regexp_replace("record", "\r$", ""))
    return whole.filter(F.trim("record") != "")
