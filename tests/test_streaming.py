"""Streams give what the batch gives; replays add nothing."""

from pyspark.sql import functions as F

from framewise.streaming.jobs import collect_stream, gate_stream, gated_requests, read_collected

SCHEMA = "headline_id bigint, headline string, model string"
FILES = [
    [(1, "Hyderabad weather forecast", "nli"), (2, "Supreme Court hears plea", None), (3, "   ", "nli")],
    [(4, "Railways plan reviewed", "baseline"), (5, None, "nli")],
    [(6, "By-election results", "other"), (7, "Article 370 verdict", "bert")],
]


def test_gate_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in FILES:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        gate_stream(stream, out, str(tmp_path / "state")).awaitTermination()
    batch = gated_requests(spark.read.schema(SCHEMA).parquet(source))
    got = spark.read.parquet(out).select(*batch.columns)
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()
    status = {r.headline_id: r.status for r in got.collect()}
    assert status == {
        1: "done", 2: "to_model", 3: "rejected", 4: "done", 5: "rejected", 6: "rejected", 7: "to_model"
    }


def test_collect_stream_appends_new_titles_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "headline_id bigint, headline string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run(state):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        collect_stream(stream, out, str(tmp_path / state), [F.col("headline_id")]).awaitTermination()
        like = spark.createDataFrame([], schema)
        return sorted((r.headline_id, r.headline) for r in read_collected(spark, out, like).collect())

    add([(1, "A"), (2, "B"), (3, "b ")])
    assert run("state") == [(1, "A"), (2, "B")]
    add([(4, " a "), (5, "C")])
    assert run("state") == [(1, "A"), (2, "B"), (5, "C")]
    # A new checkpoint replays every file against the stored titles.
    assert run("other-state") == [(1, "A"), (2, "B"), (5, "C")]


def test_lookups_of_fifty_batches_open_files_as_the_batch_grows(spark, tmp_path, monkeypatch):
    from framewise.streaming import key_table
    from framewise.streaming.key_table import KeyTable

    monkeypatch.setattr(key_table, "KEYS_PER_FILE", 64)
    keys = KeyTable(spark, str(tmp_path / "keys"))
    numbers = spark.range(64 * 50).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), (F.col("id") % 50).alias("b"))
    numbers = numbers.coalesce(1).cache()
    opened = {}
    for b in range(50):
        own = numbers.filter(F.col("b") == b).select("key")
        keys.compact("w", b)
        if b in (20, 49):
            for n in (1, 4, 16):
                some = own.limit(n)
                rows = keys.lookup(some)
                opened[b, n] = len(rows.inputFiles())
                assert rows.join(some, "key", "left_semi").count() == 0
                old = numbers.filter(F.col("b") < 20).select("key").limit(n)
                assert keys.lookup(old).join(old, "key", "left_semi").count() == n
        keys.add(own, "w", b)
        if b == 30:  # a batch that is added again replaces itself
            keys.add(own, "w", b)
    live = keys.folders()
    assert len(live) <= 2 * key_table.FAN and sum(f.last - f.first + 1 for f in live) == 50
    files = [len(keys._files_of([f], None)) for f in live]
    assert sum(files) >= 40
    for n in (1, 4, 16):
        assert opened[49, n] <= n * len(live)  # at most a file for a key and folder, however many batches
    assert opened[49, 1] <= opened[20, 1] + 4 < sum(files) / 2
    assert keys._rows(keys._files_of(live, None)).count() == 64 * 50


def test_keys_survive_crashes(spark, tmp_path, monkeypatch):
    import shutil

    from framewise.streaming import key_table
    from framewise.streaming.key_table import KeyTable

    monkeypatch.setattr(key_table, "FAN", 2)
    place = str(tmp_path / "keys")
    keys = KeyTable(spark, place)
    for b in range(4):
        keys.add(spark.createDataFrame([(f"{b:064x}",)], "key string"), "w", b)
    shutil.copytree(f"{place}/writer=w/0-0-0-0", str(tmp_path / "old"))
    keys.compact("w", 4)
    assert [(f.level, f.first, f.last) for f in keys.folders()] == [(2, 0, 3)]
    # a merged folder that was not removed in time is covered; one without its marker does not count
    shutil.copytree(str(tmp_path / "old"), f"{place}/writer=w/0-0-0-0")
    shutil.copytree(str(tmp_path / "old"), f"{place}/writer=w/3-0-9-0")
    (tmp_path / "keys/writer=w/3-0-9-0/_SUCCESS").unlink()
    assert [(f.level, f.first, f.last) for f in keys.folders()] == [(2, 0, 3)]
    assert keys._rows(keys._files_of(keys.folders(), None)).count() == 4


def test_keys_lost_in_a_crash_are_found_in_the_table(spark, tmp_path):
    import shutil

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "headline_id bigint, headline string"

    def run(rows, state):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        collect_stream(stream, out, str(tmp_path / state), [F.col("headline_id")]).awaitTermination()
        return sorted(r.headline_id for r in read_collected(spark, out, spark.createDataFrame([], schema)).collect())

    assert run([(1, "A"), (2, "B")], "state") == [1, 2]
    shutil.rmtree(f"{out}/_keys")
    assert run([(3, "b"), (4, "C")], "other") == [1, 2, 4]


def test_batch_run_again_leaves_the_same_rows(spark, tmp_path):
    """A crash after the write and before the commit repeats the batch."""
    import os

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "headline_id bigint, headline string"
    spark.createDataFrame([(1, "A"), (2, "B")], schema).coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        collect_stream(stream, out, state, [F.col("headline_id")]).awaitTermination()
        like = spark.createDataFrame([], schema)
        return sorted(r.headline for r in read_collected(spark, out, like).collect())

    first = run()
    for name in os.listdir(f"{state}/commits"):
        os.remove(f"{state}/commits/{name}")
    assert run() == first == ["A", "B"]


def test_predict_on_a_stream_equals_batch(spark, tmp_path):
    from framewise.plans.predict import predict

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "headline_id bigint, headline string"
    rows = [(1, "Hyderabad weather"), (2, "Govt praises government policies"), (3, "Railways plan")]
    spark.createDataFrame(rows, schema).write.parquet(source)
    query = (
        predict(spark.readStream.schema(schema).parquet(source), "lexical")
        .drop("confidence")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batch = predict(spark.read.schema(schema).parquet(source), "lexical").drop("confidence")
    got = spark.read.parquet(out).select(*batch.columns)
    assert got.count() == 3 and got.exceptAll(batch).isEmpty()


def test_streams_read_a_table_that_is_a_folder_of_files(spark, sf, tmp_path):
    from verification.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("stream_gate", "stream_dedup"):
        whole, parts = QUERIES[name](spark, sf), QUERIES[name](spark, str(tmp_path))
        assert whole.count() > 0
        if name == "stream_gate":
            assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()
        else:
            assert whole.select("headline_id").exceptAll(parts.select("headline_id")).isEmpty() and whole.count() == parts.count()
