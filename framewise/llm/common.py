"""What the operators share: tables in the shared folder, row keys, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a task counted together by ``repeats``, buckets summed up together by ``counted_before``.
TOGETHER = 1 << 16
BUCKETS = 1 << 12
#: Rows of a few numbers that a task writes to a file of a stored table whose number of rows is known.
ROWS = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one under the warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/llm-scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, lineage cut.

    Its shuffle files go as soon as the table is written; nothing needs them then.
    ``rows``: about how many it has. Its last step then runs as a task per ``ROWS`` of them instead of one per
    shuffle partition. On a local file system each file costs an executor three child processes (chmod).
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS)))
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(shared_folder(spark)) or "/llm-scratch/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str, text_col: str | Column) -> Column:
    """Tells rows apart also where ids are null or repeated: the id and a hash of the text.

    Rows that agree in both are one document stored several times.
    """
    return F.concat_ws(
        ":",
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
        F.hex(F.xxhash64(F.coalesce(F.col(text_col) if isinstance(text_col, str) else text_col, F.lit("")))),
    )


def repeats(rows: DataFrame) -> DataFrame:
    """The different rows of stretches of ``rows``, with copies and block (names the stretch).

    Equal rows are counted before they are shuffled. A row that is repeated without
    end shows once per stretch of ``TOGETHER`` rows, so copies never exceeds that.
    """
    names = rows.columns
    dealt = rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), TOGETHER.bit_length() - 1))
    return dealt.groupBy(*names, "block").agg(F.count("*").alias("copies"))


def counted_before(counts: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """``counts`` (group..., bucket, n) with before, the sum of n in smaller buckets of the group, and total.

    Sums up ``BUCKETS`` buckets at a time and then those sums, so that no task sees all buckets of a group.
    """
    counts = stored(counts.withColumn("part", F.floor(F.col(bucket) / BUCKETS)), "counts")
    parts = counts.groupBy(*group, "part").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*group).orderBy("part")
    parts = parts.select(
        *[F.col(g).alias(f"_{g}") for g in group],
        F.col("part").alias("_part"),
        (F.sum("n").over(order) - F.col("n")).alias("_before"),
        F.sum("n").over(Window.partitionBy(*group)).alias("total"),
    )
    within = F.sum("n").over(Window.partitionBy(*group, "part").orderBy(bucket)) - F.col("n")
    same = F.col("part") == F.col("_part")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = counts.withColumn("before", within).join(parts, same)
    return out.select(*group, bucket, "n", (F.col("before") + F.col("_before")).alias("before"), "total")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, component (both bigint) for ``edges`` (a, b): the smallest node reachable.

    Rounds of hooking every node of an edge to the smallest component next to
    it and then following those pointers to their end; the length of paths
    falls at least by half in a round. Edges inside a component leave the
    table, nothing is collected but a row count. ``rows``: about how many edges there are, if known.
    """
    spark = edges.sparkSession
    links = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges", rows)
    names, nodes = None, 0
    while n := links.count():
        nodes = nodes or 2 * n
        both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("next"))
        )
        hook = both.groupBy("node").agg(F.min("next").alias("next"))
        hook = stored(hook.select("node", F.least("node", "next").alias("root")), "hook", 2 * n)
        more = True
        while more:
            far = hook.select(F.col("node").alias("root"), F.col("root").alias("far"))
            moved = hook.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") < F.col("root")).alias("m"))
            moved = stored(moved, "hook", 2 * n)
            more = not moved.filter("m").isEmpty()
            forget(hook)
            hook = moved.select("node", "root")
        at = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        bt = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = links.join(at, "a").join(bt, "b").filter("ra <> rb")
        fewer = left.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        fewer = stored(fewer, "edges", n)
        if names is None:
            names = hook
        else:
            renamed = names.join(
                hook.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left"
            )
            names = stored(renamed.select("node", F.coalesce("up", "root").alias("root")), "names", nodes)
        forget(links)
        links = fewer
    if names is None:
        return spark.createDataFrame([], "node bigint, component bigint")
    return names.select("node", F.col("root").alias("component"))
