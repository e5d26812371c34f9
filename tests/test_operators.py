"""Literal rows and relations for the table operators and plans."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.lineage import scratch_path, shared_folder
from framewise.operators import balance as B
from framewise.operators import evaluate as E
from framewise.operators import features, links, sampling, scoring
from framewise.operators.dedup import dedup_headlines, not_collected
from framewise.plans.collect import collect
from framewise.plans.predict import predict, split_blank
from framewise.plans.prepare import prepare
from framewise.plans.train import evaluate, train
from framewise.sources import tables
from framewise.sources.dims import hypothesis_dim, keyword_dim, label_dim, section_dim, source_dim


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_dimensions(spark):
    sources = source_dim(spark)
    assert sources.count() == 14
    assert rows(sources.filter("source = 'ndtv.com'"), "base", "category", "source_rank") == [
        ("https://www.ndtv.com", "Center-Right", 8)
    ]
    assert section_dim(sources).count() == 30
    assert rows(hypothesis_dim(spark).groupBy("class").count()) == [("Left", 4), ("Neutral", 2), ("Right", 4)]
    assert rows(label_dim(spark)) == [(0, "Left"), (1, "Neutral"), (2, "Right")]
    assert rows(keyword_dim(spark).groupBy("gate").count()) == [("non_political", 57), ("political", 132)]


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame(
        [("Govt acts", 0), (" govt ACTS ", 1), ("\tGovt acts", 2), ("Other", 5), (None, 7)],
        "headline string, rank int",
    )
    once = dedup_headlines(df, [F.col("rank")])
    assert once.count() == 3
    assert rows(once.filter("headline is not null")) == [("Govt acts", 0), ("Other", 5)]
    again = dedup_headlines(once, [F.col("rank")])
    assert again.exceptAll(once).isEmpty() and once.exceptAll(again).isEmpty()
    new = spark.createDataFrame([("other ",), ("New",)], "headline string")
    assert rows(not_collected(new, once)) == [("New",)]


def test_dedup_sorts_no_whole_rows(spark, tmp_path):
    rows = [(i, f"Title {i % 7}", i % 3, "long " * 50) for i in range(100)] + [(200, "Again", 1, "x")] * 3 + [(None, None, None, None)] * 2
    spark.createDataFrame(rows, "id long, headline string, rank int, body string").write.parquet(str(tmp_path / "in"))
    once = dedup_headlines(spark.read.parquet(str(tmp_path / "in")), [F.col("rank"), F.col("id")])
    plan = once._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortMergeJoin", "Sort").replace("SortOrder", "")
    got = sorted((r.headline or "", -1 if r.id is None else r.id) for r in once.collect())
    assert got == [("", -1), ("Again", 200)] + [(f"Title {t}", min(range(t, 100, 7), key=lambda i: (i % 3, i))) for t in range(7)]


def test_dedup_of_one_hot_title(spark):
    df = spark.range(200000).select(
        F.when(F.col("id") % 3 == 0, F.lit("Same title")).otherwise(F.col("id").cast("string")).alias("headline"),
        "id",
    )
    once = dedup_headlines(df, [F.col("id")])
    assert once.count() == 200000 - 66667 + 1
    assert once.filter("headline = 'Same title'").first().id == 0


def test_site_quota():
    assert links.site_quota(14, 1500) == 107
    assert links.site_quota(30, 1500) == 60
    assert links.site_quota(0, 1500) == 1500


def brute_balance(items, target):
    import hashlib
    import math

    key = lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()
    classes = sorted({b for _, b in items})
    quota = math.ceil(target / len(classes))
    base = []
    for c in classes:
        base += sorted((i for i, b in items if b == c), key=key)[:quota]
    rest = sorted((i for i, _ in items if i not in set(base)), key=key)
    fill = rest[: max(0, target - len(base))]
    return sorted([(i, False) for i in base] + [(i, True) for i in fill])


@pytest.mark.parametrize(
    "sizes,target",
    [((6, 2, 1), 9), ((6, 2, 1), 3), ((6, 2, 1), 100), ((900, 200, 40), 600), ((5, 0, 0), 3), ((50, 50, 50), 100)],
)
def test_balance_equals_brute_force(spark, sizes, target):
    items = []
    for n, label in zip(sizes, ("Left", "Neutral", "Right")):
        items += [(len(items) + k, label) for k in range(n)]
    df = spark.createDataFrame(items, "id int, bias string")
    assert rows(B.balance(df, "id", target), "id", "is_fill") == brute_balance(items, target)


def test_prefixes_grow_until_the_bound_is_exact(spark, monkeypatch):
    items = [(k, ("Left", "Neutral", "Right")[k % 3 if k % 2 else 0]) for k in range(3000)]
    df = spark.createDataFrame(items, "id int, bias string")
    monkeypatch.setattr(sampling, "STEP", 1)
    assert rows(B.balance(df, "id", 1700), "id", "is_fill") == brute_balance(items, 1700)


@pytest.mark.parametrize("target,wanted", [(3, 3), (9, 9), (10, 10), (50, 14)])
def test_rows_of_one_id_are_taken_one_by_one(spark, target, wanted):
    """Ten like rows of one id and four null ids in one class."""
    df = spark.createDataFrame([(1, "Left")] * 10 + [(None, "Left")] * 4, "id int, bias string")
    got = B.balance(df, "id", target)
    assert got.count() == wanted and got.filter("is_fill").count() == 0
    split = sampling.stratified_split(df, "id", "bias", target / 20)
    assert split.count() == 14 and split.filter("is_test").count() == -(-14 * target // 20) if target <= 20 else True


def test_fill_falls_among_like_rows(spark):
    df = spark.createDataFrame([(1, "Left")] * 10 + [(2, "Right")], "id int, bias string")
    got = B.balance(df, "id", 8)
    assert (got.count(), got.filter("is_fill").count()) == (8, 3)


def test_null_ids_and_groups_are_split_too(spark):
    df = spark.createDataFrame([(k, "a") for k in range(7)] + [(None, "a")] * 3 + [(k, None) for k in range(5)], "id int, bias string")
    split = sampling.stratified_split(df, "id", "bias", 0.4)
    assert rows(split.groupBy("bias", "is_test").count().na.fill("none")) == [
        ("a", False, 6), ("a", True, 4), ("none", False, 3), ("none", True, 2)
    ]


def test_many_groups(spark):
    df = spark.range(6000).selectExpr("id", "id % 1500 AS bias")
    split = sampling.stratified_split(df, "id", "bias", 0.5)
    assert split.filter("is_test").groupBy("bias").count().filter("count = 2").count() == 1500


def test_samples_are_filters_without_a_shuffle(spark):
    df = spark.createDataFrame([(k, "Left") for k in range(50)], "id int, bias string")
    for out in (B.balance(df, "id", 20), sampling.plain_split(df, "id"), sampling.stratified_split(df, "id", "bias")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_balance_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, bias string")
    assert B.balance(empty, "id", 10).count() == 0
    assert sampling.eval_sample(empty, "id").count() == 0


def test_splits(spark):
    import math

    sizes = {"Left": 61, "Neutral": 7, "Right": 1}
    df = spark.createDataFrame(
        [(f"{c}{k}", c) for c, n in sizes.items() for k in range(n)], "id string, bias string"
    )
    split = sampling.stratified_split(df, "id", "bias")
    assert rows(split.filter("is_test").groupBy("bias").count()) == [
        (c, math.ceil(0.2 * n)) for c, n in sizes.items()
    ]
    plain = sampling.plain_split(df, "id")
    assert plain.count() == 69 and plain.filter("is_test").count() == 14
    assert sampling.eval_sample(df, "id").count() == round(0.2 * 69)


def test_class_weights(spark):
    df = spark.createDataFrame([("Left",)] * 6 + [("Right",)] * 2, "bias string")
    assert rows(B.class_weights(df)) == [("Left", 6, 8 / 12), ("Right", 2, 2.0)]


PAIRS = [("Left", "Left"), ("Left", "Neutral"), ("Neutral", "Neutral"), ("Right", "Right"), ("Right", "Left")]


def test_report(spark, tmp_path):
    pairs = spark.createDataFrame([("m", *p) for p in PAIRS], "model string, y_true string, y_pred string")
    counts = E.confusion(pairs)
    report = E.classification_report(counts)
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in report.collect()}
    want = {
        "Left": (0.5, 0.5, 0.5, 2),
        "Neutral": (0.5, 1.0, 2 / 3, 1),
        "Right": (1.0, 0.5, 2 / 3, 2),
        "accuracy": (None, None, 0.6, 5),
        "macro avg": (2 / 3, 2 / 3, 11 / 18, 5),
        "weighted avg": (0.7, 0.6, 0.6, 5),
    }
    assert got.keys() == want.keys()
    for label in want:
        assert got[label] == pytest.approx(want[label]), label
    want = {("Left", "Left"): 1, ("Left", "Neutral"): 1, ("Neutral", "Neutral"): 1, ("Right", "Left"): 1, ("Right", "Right"): 1}
    names = ("Left", "Neutral", "Right")
    assert rows(E.confusion_matrix(counts)) == [("m", a, b, want.get((a, b), 0)) for a in names for b in names]
    assert rows(E.accuracy_and_f1(counts)) == [("m", pytest.approx(0.6), pytest.approx(11 / 18))]
    path = str(tmp_path / "report")
    tables.write_report(report, path)
    other = report.withColumn("model", F.lit("other"))
    tables.write_report(other, path)
    assert tables.read_report(spark, path).count() == 12


def test_label_seen_only_as_prediction_has_zero_recall(spark):
    pairs = spark.createDataFrame([("m", "Left", "Right")], "model string, y_true string, y_pred string")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in E.per_class(E.confusion(pairs)).collect()}
    assert got == {"Left": (0.0, 0.0, 0.0, 1), "Right": (0.0, 0.0, 0.0, 0)}
    odd = spark.createDataFrame([("m", "Left", "Right"), ("m", "Left", "other"), ("n", "x", "x")], "model string, y_true string, y_pred string")
    names, n = ("Left", "Right", "other"), {"Right": 1, "other": 1}
    assert rows(E.confusion_matrix(E.confusion(odd))) == [
        ("m", a, b, n.get(b, 0) if a == "Left" else 0) for a in names for b in names
    ] + [("n", "x", "x", 1)]


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "farm laws protest"), (2, "farm budget"), (3, "the of")], "id int, text string")
    docs = docs.filter("id < 3")
    got = {(r.id, r.term): r.weight for r in features.tfidf(docs, "id", "text").collect()}
    assert got == pytest.approx(
        {
            (2, "farm"): 0.449436, (2, "budget"): 0.631667, (2, "farm budget"): 0.631667,
            (1, "farm"): 0.303216, (1, "laws"): 0.426160, (1, "protest"): 0.426160, (1, "farm laws"): 0.426160,
            (1, "laws protest"): 0.426160, (1, "farm laws protest"): 0.426160,
        },
        abs=1e-6,
    )


def test_vocabulary_counts_repeats_and_documents(spark):
    docs = spark.createDataFrame([(1, "tax tax tax"), (2, "tax poll"), (3, "")], "id int, text string")
    vocab = features.vocabulary(docs, "text", 3, (1, 2))
    assert rows(vocab, "term_id", "term", "cf", "df") == [(1, "tax", 4, 2), (2, "tax tax", 2, 1), (3, "poll", 1, 1)]
    assert rows(vocab.filter("term = 'tax'"), "idf") == [(pytest.approx(np.log(4 / 3) + 1),)]


@pytest.mark.parametrize("max_terms,ngram_range", [(5, (1, 3)), (40, (1, 3)), (10000, (1, 3)), (30, (2, 3)), (7, (3, 3))])
def test_vocabulary_equals_counting_everything(spark, sf, max_terms, ngram_range):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    low, high = ngram_range
    runs = features._with_runs(docs.select("doc_id", features.content_tokens("text").alias("_n1")), high)
    grams = F.concat(*[F.col(f"_n{n}") for n in range(low, high + 1)])
    terms = runs.select("doc_id", F.explode(grams).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("cf"), F.count_distinct("doc_id").alias("df"))
    want = [tuple(r) for r in counts.orderBy(F.desc("cf"), "term").limit(max_terms).collect()]
    got = features.vocabulary(docs, "text", max_terms, ngram_range).orderBy("term_id")
    assert [tuple(r) for r in got.select("term", "cf", "df").collect()] == want


def test_class_scores_of_a_score_table(spark):
    left = [0.8, 0.6, 0.7, 0.5]
    right = [0.1, 0.1, 0.2, 0.2]
    neutral = [0.2, 0.2]
    by_class = {"Left": iter(left), "Right": iter(right), "Neutral": iter(neutral)}
    table = [(1, r.hypothesis, next(by_class[r["class"]])) for r in hypothesis_dim(spark).orderBy("hyp_id").collect()]
    table += [(2, table[0][1], 0.5)]
    scores = spark.createDataFrame(table, "headline_id int, hypothesis string, score double")
    got = rows(scoring.decisions_from_scores(scores), "headline_id", "conf_left", "conf_neutral", "conf_right", "label")
    assert got == [(1, 0.65, 0.2, 0.15, "Left"), (2, 1.0, 0.0, 0.0, "Left")]


NEWS = [
    (1, "Hyderabad weather forecast for tomorrow"),
    (2, "Railways plan reviewed"),
    (3, "Failures and corruption of the establishment under the government"),
    (4, "Govt praises government policies or achievements"),
    (5, "Supreme Court hears plea"),
]


def test_predict_with_each_kind_of_scorer(spark):
    df = spark.createDataFrame(NEWS, "headline_id bigint, headline string")
    lexical = predict(df, "lexical")
    assert [r.gate for r in lexical.orderBy("headline_id").collect()] == [
        "non_political", "neutral_political", "model", "model", "model"
    ]
    by_id = {r.headline_id: r for r in lexical.collect()}
    assert by_id[1].confidence == {"Left": 0.0, "Neutral": 1.0, "Right": 0.0}
    assert by_id[1].reasoning.startswith("Non-political content")
    assert not by_id[1].is_model_prediction and by_id[3].is_model_prediction
    assert by_id[3].label == "Left" and by_id[4].label == "Right"
    assert by_id[5].label == "Neutral" and by_id[5].confidence == {"Left": 0.33, "Neutral": 0.34, "Right": 0.33}
    for r in by_id.values():
        assert sum(r.confidence.values()) == pytest.approx(1, abs=2e-4)

    def pair_scorer():
        def score(texts, hypotheses):
            assert len(hypotheses) == 10
            assert not any("weather" in t or "Railways" in t for t in texts)
            return np.array([[0.9] * 4 + [0.1] * 6 for _ in texts])

        return score

    nli = {r.headline_id: r for r in predict(df, "nli", pair_scorer).collect()}
    assert [nli[i].label for i in range(1, 6)] == ["Neutral", "Neutral", "Left", "Left", "Left"]
    assert nli[3].reasoning == "NLI analysis: Left framing detected (81.8% confidence)"

    def logit_scorer():
        return lambda texts: np.array([[0.0, 1.0, 2.0] for _ in texts])

    bert = {r.headline_id: r for r in predict(df, "bert", logit_scorer).collect()}
    assert bert[3].label == "Right" and bert[3].conf_right == 0.6652
    assert bert[3].reasoning == "BERT model prediction (66.5% confidence)"


def test_predict_rejects_bad_requests(spark):
    df = spark.createDataFrame(NEWS, "headline_id bigint, headline string")
    with pytest.raises(ValueError):
        predict(df, "gpt")
    with pytest.raises(ValueError):
        predict(df, "nli")
    blank = spark.createDataFrame([(1, "  "), (2, None), (3, "x")], "headline_id int, headline string")
    ok, bad = split_blank(blank)
    assert rows(ok, "headline_id") == [(3,)] and rows(bad, "headline_id") == [(1,), (2,)]


def test_scorer_with_wrong_shape_is_an_error(spark):
    df = spark.createDataFrame(NEWS, "headline_id bigint, headline string")
    with pytest.raises(Exception, match="scorer returned shape"):
        predict(df, "bert", lambda: lambda texts: np.zeros((len(texts), 2))).collect()


def test_gated_rows_do_not_reach_the_scorer_in_the_plan(spark):
    df = spark.createDataFrame(NEWS, "headline_id bigint, headline string")
    plan = predict(df, "bert", lambda: lambda t: np.zeros((len(t), 3)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Exchange" not in plan and "Union" not in plan


def pages_of(spark):
    def page(path, title, *to):
        body = "".join(f'<a href="{t}">x</a>' for t in to)
        return f"https://s.example{path}", f"<html><title>{title}</title>{body}</html>"

    stored = [
        page("/", "Home", "/news", "/a", "/video/v"),
        page("/news", "News", "/a", "/b", "/gone"),
        page("/a", "Alpha", "/c"),
        page("/b", " alpha ", "/a"),
        page("/c", "Gamma", "/d"),
        page("/d", "Delta"),
        page("/video/v", "Clip"),
        page("/a/?again=1", "Later copy of a"),
    ]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(stored)], "page_id bigint, url string, html string")


SITE = [("s.example", "https://s.example", "Left", 0)]
SITE_SCHEMA = "source string, base string, category string, source_rank int"


def test_walk_and_site_headlines(spark):
    sites = spark.createDataFrame(SITE, SITE_SCHEMA)
    sections = spark.createDataFrame(
        [("s.example", "https://s.example", 0, "/"), ("s.example", "https://s.example", 1, "/news")],
        "source string, base string, position int, section string",
    )
    facts = links.page_facts(pages_of(spark)).cache()
    visited = links.frontier(facts, sites, links.seed_urls(sections))
    short = F.regexp_replace("url", "https://s.example", "")
    assert rows(visited, "level", short) == [
        (0, ""), (0, "/news"), (1, "/a"), (1, "/b"), (1, "/video/v"), (2, "/c"), (3, "/d")
    ]
    found = links.site_headlines(visited, facts, 60)
    assert sorted(r.headline for r in found.collect()) == ["Alpha", "Clip", "Delta", "Gamma", "Home", "News"]
    assert links.site_headlines(visited, facts, 2).count() == 2
    capped = links.frontier(facts, sites, links.seed_urls(sections), max_pages=3)
    assert rows(capped, "level", short) == [(0, ""), (0, "/news"), (1, "/a")]
    out = collect(pages_of(spark), sites, sections)
    assert rows(out, "headline", "category") == [(h, "Left") for h in ("Alpha", "Clip", "Delta", "Gamma", "Home", "News")]
    some = out.filter("headline in ('Home', 'News')")
    more = links.top_up(some, facts, sites, 1)
    assert rows(more, "headline", "source") == [("Alpha", "s.example")]
    assert rows(links.top_up(some, facts, sites, 10), "headline") == [("Alpha",), ("Clip",)]


def test_prepare_and_train(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'")
    raw = docs.select(
        F.col("doc_id").alias("headline_id"),
        F.col("text").alias("headline"),
        F.lit("u").alias("url"),
        "source",
        F.element_at(F.array(F.lit("Left"), F.lit(" Center "), F.lit("Right")), (F.col("doc_id") % 3 + 1).cast("int")).alias("category"),
    )
    ready = prepare(raw, 30)
    assert ready.columns == ["headline", "clean_headline", "url", "source", "category", "bias"]
    assert 0 < ready.count() <= 30
    assert ready.groupBy("bias").count().filter("count > 10").count() == 0
    rows_in = raw.withColumn("clean_headline", F.lower("headline"))
    model, report, matrix = train(rows_in, max_terms=200, max_iter=5)
    assert matrix.count() == matrix.select("y_true").distinct().count() ** 2
    assert {"accuracy", "macro avg", "weighted avg"} <= {r.label for r in report.collect()}
    assert evaluate(model, rows_in, "sample").filter("label = 'accuracy'").count() == 1
    with pytest.raises(ValueError):
        evaluate(model, rows_in, "other")
    flat = lambda: lambda texts: np.zeros((len(texts), 3))
    by_logits = {r.label: r for r in evaluate(flat, rows_in, model="bert").collect()}
    assert by_logits["Left"].recall == 1.0 and by_logits["Left"].model == "bert"
    assert evaluate(None, rows_in, "sample", model="lexical").filter("label = 'accuracy'").count() == 1
    from framewise.operators.classifier import linear_parts, load_model, save_model

    path = str(tmp_path / "model")
    save_model(model, path)
    again = load_model(path)
    both = [
        rows(predict(raw, "baseline", m), "headline_id", "label", "conf_left", "gate") for m in (model, again)
    ]
    assert both[0] == both[1]
    # The same probabilities from the parts of the model, without a shuffle.
    linear = features.linear_score(rows_in, "headline_id", "clean_headline", *linear_parts(again))
    plan = linear._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    from framewise.operators.classifier import predict_baseline

    direct = predict_baseline(model, rows_in.select("headline_id", "clean_headline"), "clean_headline")
    assert rows(linear, "headline_id", "conf_left", "conf_neutral", "conf_right", "label") == rows(
        direct, "headline_id", "conf_left", "conf_neutral", "conf_right", "y_pred"
    )


def test_csv_and_parquet_tables(spark, tmp_path):
    data = [('He said "hi", twice\nand left', "u", " s ", "Left"), ("", "u2", "s", "Right"), ("a\\b", None, "s", "x")]
    df = spark.createDataFrame(data, tables.RAW_SCHEMA)
    for fmt, empty in (("csv", None), ("parquet", "")):
        path = str(tmp_path / fmt)
        tables.write_raw(df, path, fmt)
        tables.write_raw(df, path, fmt)
        got = sorted((tuple(r) for r in tables.read_raw(spark, path, fmt).collect()), key=str)
        assert got == sorted([data[0], (empty, *data[1][1:]), data[2]], key=str)
    with pytest.raises(ValueError):
        tables.read_raw(spark, "x", "xml")


def test_shared_folder(spark):
    folder = shared_folder(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert scratch_path(spark, "a").startswith(folder.rstrip("/"))


class FakeSession:
    """Just enough of a session to ask where the shared folder is."""

    def __init__(self, master, setting):
        self.master, self.setting, self.folder = master, setting, None
        self.sparkContext = self.conf = self

    def getConf(self):
        return self

    def get(self, name, default=None):
        assert name == "spark.checkpoint.dir"
        return self.setting

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_must_be_named():
    assert shared_folder(FakeSession("yarn", "hdfs:///shared")) == "hdfs:///shared"
    for master in ("yarn", "local[2]", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(FakeSession(master, None))


def test_pages_table(spark, sf):
    pages = tables.read_pages(spark, f"{sf}/pages.parquet")
    assert pages.columns == ["page_id", "url", "html"]
    found = links.page_headlines(pages)
    assert 0 < found.count() <= pages.count()


def test_partitions_do_not_change_results(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("headline_id"), F.col("text").alias("headline"), "source"
    )
    results = []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        once = dedup_headlines(docs, [F.col("headline_id")])
        bias = docs.withColumn("bias", F.when(F.col("source") == "src1", "Left").otherwise("Right"))
        results.append((rows(once, "headline_id"), rows(B.balance(bias, "headline_id", 30), "headline_id", "is_fill")))
    assert results[0] == results[1]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_csv_file_with_line_breaks_in_texts_is_read_by_many_tasks(spark, tmp_path, end):
    import csv
    import random

    from framewise.sources import csv_records, tables

    draw = random.Random(4)
    parts = ["plain", "two\nlines", 'a "quoted" word', '"', "", "comma, here", "\n\n", "\r\nwindows", "é" * 40, "end\n", " blanks "]
    made = [tuple("".join(draw.choices(parts, k=draw.randint(1, 6))) for _ in range(4)) for _ in range(6000)]
    made[3000] = ("long " + "x\n" * 20_000 + '"', "u", "s", "c")  # runs over several splits
    (tmp_path / "in").mkdir()
    for name, some in (("one.csv", made), ("two.csv", made[:50]), ("none.csv", [])):
        with open(tmp_path / "in" / name, "w", newline="") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["headline", "url", "source", "category"])
            out.writerows(some)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16_384)
    spark.conf.set("spark.sql.files.openCostInBytes", 1_024)
    try:
        lines = csv_records._lines(spark, str(tmp_path / "in"))
        assert lines.rdd.getNumPartitions() > 30
        got = tables.read_raw(spark, str(tmp_path / "in"), "csv").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = Counter(tuple(x or None for x in r) for r in made + made[:50] if any(x.strip() for x in r))
    assert Counter(tuple(r) for r in got) == expected


def test_a_level_moves_its_links_and_not_the_pages(spark, tmp_path, monkeypatch):
    from framewise.operators import layout

    pages = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("t" * 40).alias("title"))
    spark.range(3000).select(F.concat(F.lit("u"), F.col("id") * 9).alias("url")).write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    few = links.limit(3).coalesce(1)
    few.write.parquet(str(tmp_path / "few"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with layout.ByKey(pages, "url", buckets=32) as table:
            many = table.joined(links)
            plan = many._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
            assert many.count() == 2223 and many.filter("title is null").isEmpty()
            some = table.joined(spark.read.parquet(str(tmp_path / "few")))
            plan = some._jdf.queryExecution().executedPlan().toString()
            opened = int(plan.split("SelectedBucketsCount: ")[1].split(" out of 32")[0])
            assert opened <= 3 and some.count() == 3
            assert table.joined(links.limit(0)).count() == 0
        assert not spark.catalog.tableExists(table.name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_alike_are_numbered_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(sampling, "STRETCH", 1 << 8)
    alike = spark.range(20_000).select(F.lit(5).cast("long").alias("id"), F.lit("same").alias("text")).repartition(7)
    other = spark.range(100, 1100).select("id", F.lit("own").alias("text"))
    rows = alike.unionByName(other)
    taken = sampling.take_fraction(rows, "id", lambda n: 12_345, "taken")
    assert taken.count() == 21_000 and taken.filter("taken").count() == 12_345
    both = {(r.id == 5, r.taken): r["count"] for r in taken.groupBy("id", "taken").count().collect() if r.id == 5}
    assert sum(both.values()) == 20_000 and len(both) == 2


def test_gradient_of_a_fit_and_of_one_stopped_early(spark):
    from framewise.operators import classifier

    words = {"Left": "red rose union", "Neutral": "plain grey report", "Right": "blue flag order"}
    docs = [(f"{w} common word{i % 5}", label, 1.0 + i % 2) for i in range(20) for label, w in words.items()]
    docs = spark.createDataFrame(docs, "text string, bias string, unused double")
    weighed = docs.join(B.class_weights(docs).select("bias", "weight"), "bias")

    def steepest(**options):
        model = classifier.fit_baseline(docs, "text", "bias", max_terms=30, **options)
        slopes = classifier.gradient(model, weighed, "text", "bias", "weight")
        return slopes.agg(F.max(F.abs("gradient")), F.count("*")).first(), model

    (largest, n), model = steepest()
    assert largest < 5e-4 and n == 3 * 31
    assert steepest(max_iter=2)[0][0] > 5e-3
    # against the loss itself: a step along one coefficient
    import numpy as np

    stages, matrix, intercepts = classifier.linear_parts(model)
    vectors = classifier.term_vectors(stages, weighed, "text").select("_v", "bias", "weight").collect()

    def loss(matrix):
        total = 0.0
        for r in vectors:
            z = np.array([b + sum(row[i] * x for i, x in zip(r._v.indices, r._v.values)) for row, b in zip(matrix, intercepts)])
            total -= r.weight * (z[["Left", "Neutral", "Right"].index(r.bias)] - np.log(np.exp(z).sum()))
        return total / 60 + 0.5 / 60 * (np.array(matrix) ** 2).sum()

    early = steepest(max_iter=2)[1]
    _, matrix, intercepts = classifier.linear_parts(early)
    at = {(r.label, r.term_id): r.gradient for r in classifier.gradient(early, weighed, "text", "bias", "weight").collect()}
    for k, label, i in ((0, "Left", 0), (1, "Neutral", 3), (2, "Right", 7)):
        up, down = ([list(row) for row in matrix] for _ in range(2))
        up[k][i] += 1e-4
        down[k][i] -= 1e-4
        assert at[label, i] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=1e-6)


def test_a_label_that_no_row_has_is_not_predicted(spark, tmp_path):
    from framewise.operators import classifier

    rows_in = spark.createDataFrame([("red rose", "Left"), ("blue flag", "Right"), ("red union", "Left"), ("blue order", "Right")] * 3, "text string, bias string")
    model = classifier.fit_baseline(rows_in, "text", "bias", max_terms=10, max_iter=50)
    classifier.save_model(model, str(tmp_path / "m"))
    model = classifier.load_model(str(tmp_path / "m"))
    assert classifier.fitted_labels(model) == ["Left", "Right"]
    got = classifier.predict_baseline(model, rows_in, "text").collect()
    assert {(r.bias, r.y_pred, r.conf_neutral) for r in got} == {("Left", "Left", 0.0), ("Right", "Right", 0.0)}
    own = features.linear_score(rows_in.withColumn("n", F.monotonically_increasing_id()), "n", "text", *classifier.linear_parts(model))
    assert {(r.label, r.conf_neutral) for r in own.collect()} == {("Left", 0.0), ("Right", 0.0)}


@pytest.mark.parametrize("parts", [0, 5])
def test_ngrams_of_parts_too_many_to_send_are_joined(spark, sf, monkeypatch, parts):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    wanted = features.vocabulary(docs, "text", 300, (1, 4), []).select("term", "term_id", "cf", "df").collect()
    monkeypatch.setattr(features, "PARTS", parts)
    assert features.vocabulary(docs, "text", 300, (1, 4), []).select("term", "term_id", "cf", "df").collect() == wanted


def test_counting_ngrams_brings_no_occurrence_to_a_shuffle(spark):
    from pyspark.sql import functions as F

    tokens = spark.range(400).select(F.array_repeat(F.lit("word"), 50).alias("_n1")).coalesce(4)
    for n in (1, 2, 3):
        rows = features._counts(tokens, n, [["word"], ["word word"]][: n - 1])
        assert [(r.cf, r.df) for r in rows.collect()] == [(400 * (51 - n), 400)]
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan


def test_vectors_by_batches_are_those_of_the_stages(spark):
    from pyspark.ml import PipelineModel
    from pyspark.sql import functions as F

    from framewise.operators import classifier

    texts = ["Modi to launch metro rail", None, "", "the of", "metro rail metro rail Modi", "İstanbul metro_rail x yy x yy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    stages, terms = classifier.fit_features(docs, "t", 300, (1, 3), ["THE", "of", "to"])
    assert len(terms) > 10
    mine = classifier.term_vectors(stages, docs, "t", ["id"])
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "UDF" not in plan
    theirs = PipelineModel(stages).transform(docs.withColumn(classifier.TEXT, F.coalesce("t", F.lit(""))))
    theirs = {r.id: r.v for r in theirs.select("id", F.unwrap_udt("features").alias("v")).collect()}
    for r in mine.collect():
        wanted = theirs[r.id]
        assert (r._v.type, r._v.size, r._v.indices) == (wanted.type, wanted.size, wanted.indices)
        assert r._v["values"] == pytest.approx(wanted["values"], rel=1e-12)
