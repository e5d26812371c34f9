"""Structured Streaming jobs: gate headlines as they arrive, collect new titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..fixed_values import DEFAULT_MODEL, LABELS, MODELS
from ..functions import gates as G
from ..functions.text import digest, is_blank, norm_key
from ..lineage import removed, scratch_path
from ..operators.dedup import keep_first
from .key_table import LITERALS, KeyTable


def gated_requests(requests: DataFrame, id_col: str = "headline_id") -> DataFrame:
    """One output row per request; works on a batch and on a stream alike.

    status is ``rejected`` (blank headline or unknown model), ``done``
    (decided by a gate) or ``to_model`` (for the scoring job).
    """
    if "model" not in requests.columns:
        requests = requests.withColumn("model", F.lit(DEFAULT_MODEL))
    requests = requests.withColumn("model", F.coalesce("model", F.lit(DEFAULT_MODEL)))
    gated = requests.withColumn("gate", G.deciding_stage("headline"))
    bad = is_blank("headline") | ~F.col("model").isin(MODELS)
    by_gate = F.col("status") == "done"
    status = (
        F.when(bad, F.lit("rejected"))
        .when(G.is_model_prediction(F.col("gate")), F.lit("to_model"))
        .otherwise(F.lit("done"))
    )
    conf = [
        F.when(by_gate, c).alias(f"conf_{x.lower()}") for x, c in zip(LABELS, G.gate_confidence())
    ]
    return gated.withColumn("status", status).select(
        id_col,
        "headline",
        "model",
        F.when(F.col("status") != "rejected", F.col("gate")).alias("gate"),
        F.when(by_gate, F.lit("Neutral")).alias("label"),
        *conf,
        F.when(by_gate, G.gate_reasoning(F.col("gate"))).alias("reasoning"),
        "status",
    )


def gate_stream(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    id_col: str = "headline_id",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write gated requests as Parquet, one folder per status; exactly once, no state.

    ``trigger`` as for ``DataStreamWriter.trigger``; by default what is there, once.
    """
    return (
        gated_requests(requests, id_col)
        .writeStream.format("parquet")
        .partitionBy("status")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def collect_stream(
    headlines: DataFrame,
    path: str,
    checkpoint: str,
    order: list[Column],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append titles never seen before; within a batch the first in ``order`` wins.

    The table itself is the state, so nothing grows in executors. Each batch
    owns one folder, named by query id and batch number, and overwrites it:
    a batch that is run again after a crash leaves the same rows. What has been
    seen is looked up in the keys beside the table (``KeyTable``), of which a batch opens only files that
    can hold its own keys. Keys that a crash kept from being stored are added from the table when a stream starts.
    """
    spark = headlines.sparkSession
    columns = headlines.columns
    _ensure_folder(spark, path)
    _complete_keys(KeyTable(spark, f"{path}/{KEYS}"), path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        session.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LITERALS))  # a session of the stream's own
        query_id = session.read.json(f"{checkpoint}/metadata").first()["id"]
        keys = KeyTable(session, f"{path}/{KEYS}")
        keys.compact(query_id, batch_id)
        came, scratch = scratch_path(session, "came"), scratch_path(session, "batch")
        batch.select(*columns).write.parquet(came)
        once = keep_first(session.read.parquet(came), [digest(norm_key("headline"))], order)
        once.withColumn("title_key", digest(norm_key("headline"))).write.parquet(scratch)
        once = session.read.parquet(scratch)
        asked = once.select(F.col("title_key").alias("key"))
        own = (F.col("writer") == query_id) & (F.col("batch") == batch_id)
        seen = keys.lookup(asked).filter(~own).select(F.col("key").alias("title_key"))
        fresh = once.join(seen, "title_key", "left_anti")
        place = f"{path}/query_id={query_id}/batch_id={batch_id}"
        fresh.write.mode("overwrite").parquet(place)
        keys.add(session.read.schema(once.schema).parquet(place).select(F.col("title_key").alias("key")), query_id, batch_id)
        removed(session, came)
        removed(session, scratch)

    return (
        headlines.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


#: Where the keys lie beside the table; readers of the table pass such a folder over.
KEYS = "_keys"


def _complete_keys(keys: KeyTable, path: str) -> None:
    """Add the keys of those batches of the table that have none."""
    known = keys.folders()
    for query in (n for n in keys._names(path) if n.startswith("query_id=")):
        writer = query.removeprefix("query_id=")
        for batch in (n for n in keys._names(f"{path}/{query}") if n.startswith("batch_id=")):
            number = int(batch.removeprefix("batch_id="))
            if not any(f.writer == writer and f.first <= number <= f.last for f in known):
                rows = keys.spark.read.schema("title_key string").parquet(f"{path}/{query}/{batch}")
                keys.add(rows.select(F.col("title_key").alias("key")), writer, number)


def _ensure_folder(spark, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm_path)


def read_collected(spark, path: str, like: DataFrame) -> DataFrame:
    """The collected table with the columns of ``like``."""
    fields = ", ".join(f"`{n}` {t}" for n, t in like.dtypes)
    schema = f"{fields}, query_id string, batch_id bigint"
    return spark.read.schema(schema).parquet(path)
