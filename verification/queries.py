"""One runnable query per operator, each over whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.fixed_values import LABELS, MAX_PAGES_PER_SITE, MAX_QUEUE, MIN_PER_SITE, TARGET_TOTAL
from framewise.functions import gates as G
from framewise.functions.labels import decode_label, encode_label, map_category
from framewise.functions.numbers import round_half_even
from framewise.functions.text import clean_text, is_blank, norm_key, strip
from framewise.lineage import scratch_path, written
from framewise.operators import balance as B
from framewise.operators import classifier, evaluate, features, links, sampling, scoring
from framewise.operators.dedup import dedup_headlines
from framewise.operators.keywords import keyword_hits
from framewise.plans.collect import collect
from framewise.plans.predict import predict
from framewise.plans.prepare import prepare
from framewise.plans.train import evaluate as evaluate_model
from framewise.plans.train import train, usable
from framewise.sources import tables
from framewise.sources.dims import hypothesis_dim, label_dim, section_dim, source_dim
from framewise.streaming.jobs import collect_stream, gate_stream, read_collected

from . import inputs as I

CONF = [f"conf_{x.lower()}" for x in LABELS]
DECISION = ["headline_id", "gate", "label", *CONF, "gap", "is_model_prediction"]


def gate_headlines(spark: SparkSession, sf: str) -> DataFrame:
    h = I.headlines(spark, sf).filter(~is_blank("headline"))
    h = h.select(
        "headline_id",
        G.is_non_political("headline").alias("is_non_political"),
        G.is_political("headline").alias("is_political"),
    )
    h = h.withColumn("gate", G.stage_of(F.col("is_non_political"), F.col("is_political"), "model"))
    decided = ~G.is_model_prediction(F.col("gate"))
    return h.select(
        "headline_id",
        "gate",
        F.when(decided, F.lit("Neutral")).alias("label"),
        *[F.when(decided, c).alias(n) for n, c in zip(CONF, G.gate_confidence())],
        F.when(decided, G.gate_reasoning(F.col("gate"))).alias("reasoning"),
        "is_non_political",
        "is_political",
    )


def keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_hits(I.headlines(spark, sf))


def clean_headlines(spark: SparkSession, sf: str) -> DataFrame:
    return I.headlines(spark, sf).select(
        "headline_id", clean_text("headline").alias("clean_headline")
    )


def norm_keys(spark: SparkSession, sf: str) -> DataFrame:
    return I.headlines(spark, sf).select("headline_id", norm_key("headline").alias("norm_key"))


def label_codes(spark: SparkSession, sf: str) -> DataFrame:
    d = I.table(spark, sf, "documents")
    raw = d.select("doc_id", I.pick(I.RAW_CATEGORIES, F.col("doc_id") % 8).alias("raw"))
    mapped = raw.select("doc_id", strip("raw").alias("category"))
    mapped = mapped.withColumn("bias", map_category("category"))
    mapped = mapped.withColumn("label_id", encode_label("bias"))
    named = mapped.join(F.broadcast(label_dim(spark)), "label_id")
    return named.select(
        "doc_id", "category", "bias", "label_id", "label", decode_label("label_id").alias("decoded")
    )


def dedup(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("source_rank"), F.col("headline_id")]
    once = dedup_headlines(I.headlines(spark, sf, topics=False), order)
    return once.select("headline_id", "headline", "source", "category")


def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    h = I.headlines(spark, sf).withColumn("bias", map_category("category"))
    return B.class_distribution(h)


def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and titles of every source, and of all together under a null source."""
    d = I.table(spark, sf, "documents").select("source", F.col("text").alias("headline"))
    total = links.title_total(d).select(F.lit(None).cast("string").alias("source"), "n_rows", "n_titles")
    return links.source_counts(d).unionByName(total)


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    h = I.headlines(spark, sf).withColumn("bias", map_category("category"))
    return B.class_weights(h)


def source_table(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per built-in source."""
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 14
    docs = I.table(spark, sf, "documents").groupBy(n.alias("source_rank")).agg(
        F.count("*").alias("n_documents")
    )
    joined = docs.join(F.broadcast(source_dim(spark)), "source_rank")
    return joined.select(
        "source", "base", "category", F.array_join("sections", " ").alias("sections"),
        "source_rank", "n_documents",
    )


def seed_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of the hosts of pages, and of the built-in sources that documents map to."""
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 14
    used = I.table(spark, sf, "documents").select(n.alias("source_rank")).distinct()
    known = section_dim(source_dim(spark).join(used, "source_rank", "left_semi"))
    return links.seed_urls(known.unionByName(I.sections(spark, sf)))


def site_quota(spark: SparkSession, sf: str) -> DataFrame:
    sites = I.sites(spark, sf)
    return sites.select("source", F.lit(links.site_quota(sites.count(), TARGET_TOTAL)).alias("quota"))


def hypothesis_table(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score of each hypothesis over all documents."""
    scores = I.pair_scores(spark, sf).groupBy("hypothesis").agg(
        round_half_even(F.avg("score"), 6).alias("mean_score")
    )
    return scores.join(F.broadcast(hypothesis_dim(spark)), "hypothesis")


def hypothesis_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.hypothesis_pairs(I.headlines(spark, sf))


def nli_class_scores(spark: SparkSession, sf: str) -> DataFrame:
    means = scoring.class_scores(I.pair_scores(spark, sf))
    return scoring.with_confidence(means).select(
        "headline_id",
        *[round_half_even(F.col(f"mean_{x.lower()}"), 6).alias(f"mean_{x.lower()}") for x in LABELS],
        *CONF,
    )


def nli_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.decisions_from_scores(I.pair_scores(spark, sf)).withColumn(
        "is_model_prediction", F.lit(True)
    )


def score_headlines(spark: SparkSession, sf: str) -> DataFrame:
    return predict(I.headlines(spark, sf), "lexical").select(*DECISION)


def lexical_batch():
    """A scorer of the kind a user passes in: here the lexical score, computed in Python."""
    import re

    import numpy as np

    words = re.compile("[a-z0-9]+")
    url = re.compile(r"http\S+")

    def score(texts, hypotheses):
        wanted = [set(words.findall(h.lower())) for h in hypotheses]
        out = np.empty((len(texts), len(wanted)))
        for i, text in enumerate(texts):
            found = set(words.findall(url.sub(" ", text.lower())))
            out[i] = [len(w & found) / len(w) for w in wanted]
        return out

    return score


def logit_batch():
    """A scorer that returns three logits: here from the number of characters."""
    import numpy as np

    def score(texts):
        n = np.array([len(t) for t in texts])
        return np.stack([(n % 7) / 2.0, (n % 5) / 2.0, (n % 3) / 2.0], axis=1)

    return score


def score_headlines_nli(spark: SparkSession, sf: str) -> DataFrame:
    return predict(I.headlines(spark, sf), "nli", lexical_batch).select(*DECISION, "reasoning")


def score_headlines_bert(spark: SparkSession, sf: str) -> DataFrame:
    return predict(I.headlines(spark, sf), "bert", logit_batch).select(*DECISION, "reasoning")


def gap_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.gap_summary(score_headlines(spark, sf))
    return out.select(
        "label",
        "n",
        *[round_half_even(F.col(c), 6).alias(c) for c in ("min_gap", "avg_gap", "max_gap", "median_gap")],
    )


def _target(df: DataFrame) -> int:
    return df.count() * 3 // 4


def balance_classes(spark: SparkSession, sf: str) -> DataFrame:
    h = I.headlines(spark, sf).withColumn("bias", map_category("category"))
    h = I.odd_ids(h.select("headline_id", "bias"))
    return B.balance(h, "headline_id", _target(h))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw headlines, with their exact copies."""
    return I.headlines(spark, sf, topics=False)


def prepare_dataset(spark: SparkSession, sf: str) -> DataFrame:
    raw = I.odd_ids(_raw(spark, sf))
    return prepare(raw, _target(raw))


def _processed(spark: SparkSession, sf: str) -> DataFrame:
    """headline_id, clean_headline, category: a stored table, as preparation leaves it.

    Some texts and categories are null, for what drops them to have work.
    """
    n = F.col("headline_id")
    clean = F.when(n % 60 != 12, clean_text("headline")).alias("clean_headline")
    category = F.when(n % 60 != 11, F.col("category")).alias("category")
    rows = I.headlines(spark, sf).hint("rebalance").select("headline_id", clean, category)
    return written(rows, "processed")


def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.odd_ids(usable(_processed(spark, sf)).select("headline_id", "bias"))
    both = sampling.stratified_split(rows, "headline_id", "bias", flag="test_stratified")
    return sampling.plain_split(both, "headline_id", flag="test_plain")


def eval_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.headlines(spark, sf).withColumn("bias", map_category("category"))
    return sampling.eval_sample(I.odd_ids(rows.select("headline_id", "bias")), "headline_id")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """True labels from the labels table, predicted ones from the flagship."""
    truth = I.table(spark, sf, "labels").select(
        F.col("doc_id").alias("headline_id"),
        decode_label(F.col("quality") + F.col("toxic")).alias("y_true"),
    )
    found = score_headlines(spark, sf).select(
        "headline_id", F.coalesce("label", F.lit("none")).alias("y_pred")
    )
    return truth.join(found, "headline_id").withColumn("model", F.lit("lexical"))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion_matrix(evaluate.confusion(_pairs(spark, sf)))


def _rounded_report(report: DataFrame) -> DataFrame:
    return report.select(
        "model",
        "label",
        *[round_half_even(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")],
        "support",
    )


def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    counts = written(evaluate.confusion(_pairs(spark, sf)), "confusion")
    return _rounded_report(evaluate.classification_report(counts))


def accuracy_and_f1(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.accuracy_and_f1(evaluate.confusion(_pairs(spark, sf)))
    return out.select(
        "model", *[round_half_even(F.col(c), 6).alias(c) for c in ("accuracy", "f1_macro")]
    )


def report_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "report")
    tables.write_report(classification_report(spark, sf), path)
    return tables.read_report(spark, path).select(
        "model", "label", "precision", "recall", "f1", "support"
    )


def softmax_labels(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.decisions_from_logits(I.logits(spark, sf))


def page_headlines(spark: SparkSession, sf: str) -> DataFrame:
    return links.page_headlines(I.varied_pages(spark, sf))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return links.page_links(I.based_pages(spark, sf))


def _walk(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts = written(links.page_facts(I.site_pages(spark, sf)), "facts")
    sites = written(I.sites(spark, sf), "sites")
    seeds = links.seed_urls(I.sections(spark, sf))
    return facts, sites, links.frontier(facts, sites, seeds)


def frontier_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _walk(spark, sf)[2].select("source", "url", "level", "title")


def frontier_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The same walk within the bounds of a polite crawl, given as arguments."""
    facts = written(links.page_facts(I.site_pages(spark, sf)), "facts")
    sites = written(I.sites(spark, sf), "sites")
    seeds = links.seed_urls(I.sections(spark, sf))
    walked = links.frontier(facts, sites, seeds, MAX_PAGES_PER_SITE, MAX_QUEUE)
    return walked.select("source", "url", "level", "title")


def collect_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job over all stored pages."""
    sites = written(I.sites(spark, sf), "sites")
    return collect(I.site_pages(spark, sf), sites, I.sections(spark, sf))


def collect_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job to a target, which sets the quota of a site and stops the second pass, with capped links."""
    sites = written(I.sites(spark, sf), "sites")
    return collect(
        I.site_pages(spark, sf), sites, I.sections(spark, sf),
        target=sites.count() * MIN_PER_SITE, max_article_links=3, max_home_links=9,
    )


def site_headlines(spark: SparkSession, sf: str) -> DataFrame:
    facts, sites, visited = _walk(spark, sf)
    found = links.site_headlines(visited, facts)
    return links.attach_source(found, sites).select(
        "source", "category", "level", "kind", "url", "headline"
    )


def top_up_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """What a second pass over the home pages adds to half the titles of the first."""
    facts, sites, visited = _walk(spark, sf)
    found = links.site_headlines(visited, facts)
    order = [F.col("source_rank"), F.col("level"), F.col("kind"), F.col("url")]
    unique = dedup_headlines(links.attach_source(found, sites), order)
    half = unique.filter(F.col("source_rank") % 2 == 0)
    collected = written(half.select("headline", "url", "source", "category"), "collected")
    return collected.unionByName(links.top_up(collected, facts, sites))


def tfidf_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    vocab = features.vocabulary(_processed(spark, sf), "clean_headline")
    return vocab.withColumn("idf", round_half_even(F.col("idf"), 6))


def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    return features.tfidf(_processed(spark, sf), "headline_id", "clean_headline").withColumn(
        "weight", round_half_even(F.col("weight"), 6)
    )


def linear_score(spark: SparkSession, sf: str) -> DataFrame:
    """Linear scores with coefficients that follow from the term by rule."""
    docs = _processed(spark, sf)
    stages, terms = classifier.fit_features(docs, "clean_headline")
    rule = [
        [((len(t) * 7 + ord(t[0]) * (3 + k)) % 11 - 5) / 4.0 for t in terms] for k in range(len(LABELS))
    ]
    return features.linear_score(docs, "headline_id", "clean_headline", stages, rule, [0.1, 0.0, -0.1])


def baseline_train(spark: SparkSession, sf: str) -> DataFrame:
    """The one optimum of the loss, and the rows it is reached on.

    label, n_train, support (test rows), in_matrix; n_slopes: coefficients, with the intercept;
    is_optimal: the penalised loss has no slope above 5e-4 at any of them.
    """
    processed = _processed(spark, sf)
    model, report, matrix = train(processed)
    rows = sampling.stratified_split(usable(processed), "headline_id", "bias").filter("NOT is_test")
    weighed = rows.join(B.class_weights(rows).select("bias", "weight"), "bias")
    slopes = classifier.gradient(model, weighed, "clean_headline", "bias", "weight")
    slopes = slopes.groupBy("label").agg(
        F.count("*").alias("n_slopes"), (F.max(F.abs("gradient")) < 5e-4).alias("is_optimal")
    )
    sizes = rows.groupBy(F.col("bias").alias("label")).agg(F.count("*").alias("n_train"))
    tested = matrix.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("in_matrix"))
    return (
        report.join(sizes, "label")
        .join(tested, "label")
        .join(slopes, "label")
        .select("label", "n_train", "support", "in_matrix", "n_slopes", "is_optimal")
    )


def baseline_two_classes(spark: SparkSession, sf: str) -> DataFrame:
    """A fit on rows of which none is Neutral: that class has no share of any headline."""
    rows = usable(_processed(spark, sf)).filter("bias <> 'Neutral'")
    model = classifier.fit_baseline(rows, "clean_headline", "bias")
    found = predict(I.headlines(spark, sf), "baseline", model).filter("is_model_prediction")
    one = F.abs(F.col(CONF[0]) + F.col(CONF[2]) - 1) < 2e-4
    return found.select("headline_id", "conf_neutral", (F.col("label") == "Neutral").alias("is_neutral"), one.alias("sums_to_one"))


def baseline_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Fit, save, load, then label every headline that passes the gates.

    The label of rows a gate decides is exact; rows of the model show that
    the coefficients of the loaded model, scored by themselves, say the same.
    """
    rows = usable(_processed(spark, sf))
    fitted = classifier.fit_baseline(rows, "clean_headline", "bias")
    path = scratch_path(spark, "model")
    classifier.save_model(fitted, path)
    model = classifier.load_model(path)
    found = predict(I.headlines(spark, sf), "baseline", model)
    clean = I.headlines(spark, sf).select("headline_id", clean_text("headline").alias("clean_headline"))
    own = features.linear_score(clean, "headline_id", "clean_headline", *classifier.linear_parts(model))
    own = own.select(F.col("headline_id"), *[F.col(c).alias(f"own_{c}") for c in CONF])
    both = found.join(own, "headline_id")
    near = F.greatest(*[F.abs(F.col(c) - F.col(f"own_{c}")) for c in CONF]) < 2e-4
    one = F.abs(F.col(CONF[0]) + F.col(CONF[1]) + F.col(CONF[2]) - 1) < 2e-4
    is_model = F.col("is_model_prediction")
    return both.select(
        "headline_id",
        "gate",
        F.when(~is_model, F.col("label")).alias("gate_label"),
        is_model,
        F.when(is_model, near).alias("same_as_loaded_table"),
        F.when(is_model, one).alias("sums_to_one"),
    )


def baseline_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """Both kinds of evaluation of one trained model, and of two scorers passed in.

    model, how, label, support of every row, and whether its measures lie in [0, 1]; for
    the scorers, whose predictions SQL can make, precision, recall and f1.
    """
    processed = _processed(spark, sf)
    model = train(processed)[0]
    parts = [
        evaluate_model(scorer, processed, how, model=name).withColumn("how", F.lit(how))
        for name, scorer in (("baseline", model), ("bert", logit_batch), ("nli", lexical_batch))
        for how in ("holdout", "sample")
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    inside = F.col("f1").between(0, 1) & F.coalesce(F.col("precision").between(0, 1), F.lit(True))
    seen = (F.col("support") > 0) & (F.col("label") != "none")
    exact = [F.when(F.col("model") != "baseline", round_half_even(F.col(c), 6)).alias(c) for c in ("precision", "recall", "f1")]
    return out.filter(seen).select("model", "how", "label", "support", inside.alias("in_range"), *exact)


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Raw and processed tables written as CSV and read back; '' comes back as null."""
    raw_path, path = scratch_path(spark, "raw"), scratch_path(spark, "processed")
    tables.write_raw(_raw(spark, sf), raw_path, "csv")
    raw = tables.read_raw(spark, raw_path, "csv")
    ready = raw.withColumn("clean_headline", clean_text("headline")).withColumn(
        "bias", map_category("category")
    )
    tables.write_processed(ready, path, "csv")
    return tables.read_processed(spark, path, "csv")


def _document_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = I.table(spark, sf, "documents").schema
    # a pattern, for a stream opens plain paths only as folders: the table is one file or a folder of files
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
    text = I.odd_text(F.col("text"), F.col("doc_id"))
    return stream.select(F.col("doc_id").alias("headline_id"), text.alias("headline"), "source")


def stream_gate(spark: SparkSession, sf: str) -> DataFrame:
    out, state = scratch_path(spark, "gated"), scratch_path(spark, "gate-state")
    topic = I.pick(I.TOPICS, F.col("headline_id") % len(I.TOPICS))
    stream = _document_stream(spark, sf).withColumn(
        "headline", F.concat("headline", F.lit(" "), topic)
    )
    gate_stream(stream, out, state).awaitTermination()
    return spark.read.parquet(out).select("headline_id", "gate", "label", *CONF, "status")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out, state = scratch_path(spark, "titles"), scratch_path(spark, "title-state")
    stream = _document_stream(spark, sf)
    collect_stream(stream, out, state, [F.col("headline_id")]).awaitTermination()
    like = I.headlines(spark, sf).select("headline_id", "headline", "source")
    return read_collected(spark, out, like).select("headline_id", "headline", "source")


def _checked(query):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        I.prepared(spark)
        return query(spark, sf)

    return run


QUERIES = {
    "score_headlines": score_headlines,
    "gate_headlines": gate_headlines,
    "keyword_hits": keyword_counts,
    "clean_headlines": clean_headlines,
    "norm_keys": norm_keys,
    "label_codes": label_codes,
    "dedup_headlines": dedup,
    "class_distribution": class_distribution,
    "source_counts": source_counts,
    "source_dim": source_table,
    "seed_urls": seed_urls,
    "site_quota": site_quota,
    "hypothesis_dim": hypothesis_table,
    "hypothesis_pairs": hypothesis_pairs,
    "nli_class_scores": nli_class_scores,
    "nli_decisions": nli_decisions,
    "score_headlines_nli": score_headlines_nli,
    "score_headlines_bert": score_headlines_bert,
    "gap_summary": gap_summary,
    "class_weights": class_weights,
    "balance_classes": balance_classes,
    "prepare_dataset": prepare_dataset,
    "train_test_split": train_test_split,
    "eval_sample": eval_sample,
    "confusion_matrix": confusion_matrix,
    "classification_report": classification_report,
    "accuracy_and_f1": accuracy_and_f1,
    "report_json": report_json,
    "softmax_labels": softmax_labels,
    "page_headlines": page_headlines,
    "page_links": page_links,
    "frontier_levels": frontier_levels,
    "frontier_bounded": frontier_bounded,
    "collect_headlines": collect_headlines,
    "collect_bounded": collect_bounded,
    "site_headlines": site_headlines,
    "top_up_headlines": top_up_headlines,
    "tfidf_vocabulary": tfidf_vocabulary,
    "tfidf_weights": tfidf_weights,
    "linear_score": linear_score,
    "baseline_train": baseline_train,
    "baseline_two_classes": baseline_two_classes,
    "baseline_predict": baseline_predict,
    "baseline_evaluate": baseline_evaluate,
    "csv_roundtrip": csv_roundtrip,
    "stream_gate": stream_gate,
    "stream_dedup": stream_dedup,
}
QUERIES = {name: _checked(query) for name, query in QUERIES.items()}
