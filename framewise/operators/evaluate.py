"""Confusion matrix, per-class metrics and gap statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    """model, y_true, y_pred, n. The only step that reads the rows; the rest reads this."""
    return pairs.groupBy("model", "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """model, y_true, y_pred, n: a row for every pair of the labels of a model seen on either side.

    ``pivot("y_pred")`` on it gives the square form. Labels are few, so the
    pairs are too.
    """
    names = counts.select("model", F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    true = names.withColumnRenamed("label", "y_true")
    pred = names.withColumnRenamed("label", "y_pred")
    return (
        true.join(pred, "model")
        .join(counts, ["model", "y_true", "y_pred"], "left")
        .select("model", "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))
    )


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(counts: DataFrame) -> DataFrame:
    """model, label, precision, recall, f1, support for each label seen on either side."""
    cells = counts.select(
        "model",
        "n",
        F.explode(
            F.array(
                F.struct(F.col("y_true").alias("label"), F.lit("t").alias("side"),
                         (F.col("y_true") == F.col("y_pred")).alias("hit")),
                F.struct(F.col("y_pred").alias("label"), F.lit("p").alias("side"),
                         F.lit(False).alias("hit")),
            )
        ).alias("c"),
    )
    sums = cells.groupBy("model", F.col("c.label").alias("label")).agg(
        F.sum(F.when(F.col("c.hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("c.side") == "t", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("c.side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(
        "model",
        "label",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + predicted).alias("f1"),
        "support",
        "tp",
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """Per-class rows, then accuracy, macro avg and weighted avg per model.

    ``accuracy`` carries its value in f1 and leaves precision and recall null.
    """
    classes = per_class(counts)
    total = F.sum("support").alias("support")
    metrics = ["precision", "recall", "f1"]
    macro = classes.groupBy("model").agg(*[F.avg(m).alias(m) for m in metrics], total)
    weighted = classes.groupBy("model").agg(
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in metrics], total
    )
    none = F.lit(None).cast("double")
    accuracy = classes.groupBy("model").agg(
        none.alias("precision"),
        none.alias("recall"),
        (F.sum("tp") / F.sum("support")).alias("f1"),
        total,
    )
    columns = ["model", "label", *metrics, "support"]

    def named(df: DataFrame, label: str) -> DataFrame:
        return df.withColumn("label", F.lit(label)).select(*columns)

    return (
        classes.select(*columns)
        .unionByName(named(accuracy, "accuracy"))
        .unionByName(named(macro, "macro avg"))
        .unionByName(named(weighted, "weighted avg"))
    )


def accuracy_and_f1(counts: DataFrame) -> DataFrame:
    """model, accuracy, f1_macro."""
    return per_class(counts).groupBy("model").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro")
    )


def gap_summary(predictions: DataFrame) -> DataFrame:
    """Gap between the best two classes, per label of the model's predictions."""
    return (
        predictions.filter("is_model_prediction")
        .groupBy("label")
        .agg(
            F.count("*").alias("n"),
            F.min("gap").alias("min_gap"),
            F.avg("gap").alias("avg_gap"),
            F.max("gap").alias("max_gap"),
            F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)").alias("median_gap"),
        )
    )


