"""Train the TF-IDF + logistic regression model and report on held-out rows."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MAX_ITERATIONS, MAX_TERMS, NGRAM_RANGE, STOP_WORDS, TEST_FRACTION
from ..functions.labels import map_category
from ..functions.text import is_blank
from ..lineage import written
from ..operators.classifier import fit_baseline, predict_baseline
from ..operators.evaluate import classification_report, confusion, confusion_matrix
from ..operators.sampling import eval_sample, stratified_split
from .predict import LogitScorer, PairScorer, predict


def usable(processed: DataFrame, blank_too: bool = True) -> DataFrame:
    """Rows with text and category, and ``bias`` from the category.

    Training also drops blank texts (``blank_too``); evaluation keeps them.
    """
    rows = processed.dropna(subset=["clean_headline", "category"])
    if blank_too:
        rows = rows.filter(~is_blank("clean_headline"))
    return rows.withColumn("bias", map_category("category"))


def train(
    processed: DataFrame,
    id_col: str = "headline_id",
    text_col: str = "clean_headline",
    max_terms: int = MAX_TERMS,
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    test_fraction: float = TEST_FRACTION,
    max_iter: int = MAX_ITERATIONS,
    balanced: bool = True,
    stop_words: list[str] = STOP_WORDS,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """The fitted model, its classification report on the test split, and the confusion matrix."""
    rows = written(usable(processed).select(id_col, text_col, "bias").hint("rebalance"), "usable")
    split = stratified_split(rows, id_col, "bias", test_fraction)
    model = fit_baseline(
        split.filter(~F.col("is_test")), text_col, "bias",
        max_terms, ngram_range, max_iter, balanced, stop_words,
    )
    counts = written(counts_on(model, split.filter("is_test"), id_col, text_col), "confusion")
    return model, classification_report(counts), confusion_matrix(counts)


def counts_on(
    scorer: PipelineModel | PairScorer | LogitScorer | None,
    rows: DataFrame,
    id_col: str = "headline_id",
    text_col: str = "clean_headline",
    model: str = "baseline",
) -> DataFrame:
    """model, y_true, y_pred, n of any scorer on ``rows`` (text and bias), without the gates.

    A blank text, which ``predict`` rejects, is given to the fitted model as it is; a
    scorer passed in is not asked, and the row counts as ``none``.
    """
    if model == "baseline":
        pairs = predict_baseline(scorer, rows.select(text_col, F.col("bias").alias("y_true")), text_col)
    else:
        found = rows.select(F.struct(id_col, "bias").alias("_row"), text_col)
        found = predict(found, model, scorer, "_row", text_col, gates=False)
        pairs = found.select(F.col("_row.bias").alias("y_true"), F.coalesce("label", F.lit("none")).alias("y_pred"))
    return confusion(pairs.select(F.lit(model).alias("model"), "y_true", "y_pred"))


def evaluate(
    scorer: PipelineModel | PairScorer | LogitScorer | None,
    processed: DataFrame,
    how: str = "holdout",
    id_col: str = "headline_id",
    text_col: str = "clean_headline",
    test_fraction: float = TEST_FRACTION,
    model: str = "baseline",
) -> DataFrame:
    """Report of a trained model, or of a scorer as ``predict`` takes it for ``model``.

    ``holdout``  the rows training held out
    ``sample``   a fifth of all rows, which overlaps the training rows
    """
    if how == "holdout":
        rows = stratified_split(usable(processed), id_col, "bias", test_fraction).filter("is_test")
    elif how == "sample":
        rows = eval_sample(usable(processed, blank_too=False), id_col, test_fraction)
    else:
        raise ValueError(f"unknown evaluation {how!r}")
    return classification_report(counts_on(scorer, rows, id_col, text_col, model))
