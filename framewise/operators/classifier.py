"""Spark ML form of the TF-IDF features with multinomial logistic regression."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    IndexToString,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..fixed_values import LABELS, MAX_ITERATIONS, MAX_TERMS, NGRAM_RANGE, STOP_WORDS
from ..functions.numbers import round_half_even
from ..functions.scores import best_label
from ..functions.text import WORD_RUN
from ..lineage import written
from . import features
from .balance import class_weights


TEXT = "_text"  # input column of every fitted model


def term_stages(
    ngram_range: tuple[int, int] = NGRAM_RANGE, stop_words: list[str] = STOP_WORDS
) -> list:
    """``TEXT`` to an array of n-grams in column ``_terms``."""
    low, high = ngram_range
    stages = [
        RegexTokenizer(inputCol=TEXT, outputCol="_words", pattern=WORD_RUN, gaps=False),
        StopWordsRemover(inputCol="_words", outputCol="_g1", stopWords=stop_words),
    ]
    stages += [NGram(n=n, inputCol="_g1", outputCol=f"_g{n}") for n in range(max(2, low), high + 1)]
    grams = ", ".join(f"_g{n}" for n in range(low, high + 1))
    stages.append(SQLTransformer(statement=f"SELECT *, concat({grams}) AS _terms FROM __THIS__"))
    return stages


def fit_features(
    docs: DataFrame,
    text_col: str,
    max_terms: int = MAX_TERMS,
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    stop_words: list[str] = STOP_WORDS,
) -> tuple[list, list[str]]:
    """Stages from text to a normalised TF-IDF vector in column ``features``, and the vocabulary.

    The vocabulary and its weights (``max_terms`` rows) come to the driver,
    as they become part of the model.
    """
    vocab = features.vocabulary(docs, text_col, max_terms, ngram_range, stop_words)
    rows = vocab.orderBy("term_id").select("term", "idf").collect()
    if not rows:
        return [], []
    vectorizer = CountVectorizerModel.from_vocabulary(
        [r.term for r in rows], inputCol="_terms", outputCol="_tf"
    )
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([r.idf for r in rows]), inputCol="_tf", outputCol="_tfidf"
    )
    stages = [
        *term_stages(ngram_range, stop_words),
        vectorizer,
        scale,
        Normalizer(p=2.0, inputCol="_tfidf", outputCol="features"),
    ]
    return stages, [r.term for r in rows]


VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def term_vectors(stages: list, docs: DataFrame, text_col: str, kept: list[str] | None = None) -> DataFrame:
    """Columns ``kept`` of ``docs`` (by default all) with _v: the vector of a text as a struct with ``indices`` and ``values``.

    The same as the stages give, worked out batch by batch: n-grams are told apart as numbers.
    """
    vectorizer = next(s for s in stages if isinstance(s, CountVectorizerModel))
    idf = next(s for s in stages if isinstance(s, ElementwiseProduct)).getScalingVec().toArray()
    stop = next(s for s in stages if isinstance(s, StopWordsRemover)).getStopWords()
    shared = docs.sparkSession.sparkContext.broadcast((vectorizer.vocabulary, idf))
    tokens = features.content_tokens(F.coalesce(text_col, F.lit("")), [w.lower() for w in stop])
    kept = kept or docs.columns
    rows, place = docs.select(*kept, tokens.alias("_n1")), len(kept)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = None
        for batch in batches:
            if terms is None:
                names, weight = shared.value
                terms = features.GramTable(names, batch.column(place).type.value_type)
            at, index, count = terms.counted(batch.column(place))
            value = count * weight[index]
            length = np.sqrt(np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), value * value, len(at) - 1))
            value = value / np.repeat(length, np.diff(at))
            lists = [pa.ListArray.from_arrays(at.astype(np.int32), x) for x in (pa.array(index, pa.int32()), pa.array(value))]
            n = len(at) - 1
            own = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(weight), np.int32)), *lists]
            vector = pa.StructArray.from_arrays(own, names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], vector], names=[*kept, "_v"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:place])
    return rows.mapInArrow(vectors, f"{schema}, _v {VECTOR}")


def fit_baseline(
    train: DataFrame,
    text_col: str,
    label_col: str,
    max_terms: int = MAX_TERMS,
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    max_iter: int = MAX_ITERATIONS,
    balanced: bool = True,
    stop_words: list[str] = STOP_WORDS,
) -> PipelineModel:
    """Logistic regression with balanced class weights and an L2 penalty of strength C = 1.

    Spark divides the loss by the sum of the weights, so the penalty is
    divided by it too. The vectors are stored once: every pass of the fit reads them.
    Labels that no row has are not fitted; their probability is 0. The last stage names the others in order.
    """
    stages, terms = fit_features(train, text_col, max_terms, ngram_range, stop_words)
    if not terms:
        raise ValueError("no terms left to build a vocabulary from")
    per_class = class_weights(train, label_col)
    if not balanced:
        per_class = per_class.withColumn("weight", F.lit(1.0))
    found = {r[0]: r for r in per_class.select(label_col, "n", "weight").collect()}  # a row per class
    total = sum(r.n * r.weight for r in found.values())
    present = [x for x in LABELS if x in found]
    place = F.array_position(F.array(*[F.lit(x) for x in present]), F.col(label_col)) - 1
    weight = F.element_at(F.create_map(*[F.lit(v) for x in present for v in (x, found[x].weight)]), F.col(label_col))
    rows = train.filter(F.col(label_col).isin(present)).select(
        F.coalesce(text_col, F.lit("")).alias(TEXT), weight.alias("weight"), place.cast("double").alias("label_id")
    )
    vectors = written(term_vectors(stages, rows.hint("rebalance"), TEXT, ["label_id", "weight"]), "vectors")
    # a stored vector is that struct: read as vectors
    found = StructType([StructField("_v", VectorUDT()), *[f for f in vectors.schema if f.name != "_v"]])
    vectors = train.sparkSession.read.schema(found).parquet(*vectors.inputFiles()).withColumnRenamed("_v", "features")
    regression = LogisticRegression(
        featuresCol="features",
        labelCol="label_id",
        weightCol="weight",
        family="multinomial",
        regParam=1.0 / total,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-6,
    )
    names = IndexToString(inputCol="prediction", outputCol="_predicted", labels=present)
    return PipelineModel([*stages, regression.fit(vectors), names])


def fitted_labels(model: PipelineModel) -> list[str]:
    """The labels that ``model`` knows, in the order of its classes."""
    return list(model.stages[-1].getLabels())


def regression_of(model: PipelineModel) -> LogisticRegressionModel:
    return next(s for s in model.stages if isinstance(s, LogisticRegressionModel))


def gradient(model: PipelineModel, rows: DataFrame, text_col: str, label_col: str, weight_col: str) -> DataFrame:
    """label, term_id, gradient: the slope of the penalised loss at each coefficient of ``model`` on ``rows``.

    The intercepts have a null term_id; they are not penalised. At the optimum all are 0.
    """
    fit, labels = regression_of(model), fitted_labels(model)
    scored = model.transform(rows.withColumn(TEXT, F.coalesce(text_col, F.lit(""))))
    p = vector_to_array("probability")
    off = [F.col(weight_col) * (F.get(p, k) - (F.col(label_col) == x).cast("double")) for k, x in enumerate(labels)]
    scored = scored.select(F.col(weight_col).alias("_w"), F.unwrap_udt("features").alias("_v"), F.array(*off).alias("_off"))
    total = scored.agg(F.sum("_w")).first()[0]
    pairs = F.concat(
        F.transform(F.arrays_zip(F.col("_v.indices").alias("i"), F.col("_v.values").alias("x")), lambda z: F.struct(z["i"].alias("i"), z["x"].alias("x"))),
        F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(1.0).alias("x"))),
    )
    each = scored.select("_off", F.inline(pairs).alias("term_id", "x"))
    sums = each.groupBy("term_id").agg(*[F.sum(F.col("x") * F.col("_off")[k]).alias(f"_g{k}") for k in range(len(labels))])
    named = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(k).alias("k"), F.col(f"_g{k}").alias("g")) for k, x in enumerate(labels)])
    sums = sums.select("term_id", F.inline(named))
    coefficients = F.from_json(F.lit(json.dumps(fit.coefficientMatrix.toArray().tolist())), "array<array<double>>")
    pull = F.coalesce(F.get(F.get(coefficients, F.col("k")), F.col("term_id")), F.lit(0.0)) * fit.getRegParam()
    return sums.select("label", "term_id", (F.col("g") / total + pull).alias("gradient"))


def probabilities(model: PipelineModel, df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the array column ``_proba``, exact probabilities of ``text`` in label order."""
    array, known = vector_to_array("probability"), fitted_labels(model)
    in_order = F.array(*[F.get(array, known.index(x)) if x in known else F.lit(0.0) for x in LABELS])
    scored = model.transform(df.withColumn(TEXT, F.coalesce(text, F.lit(""))))
    return scored.select(*df.columns, in_order.alias("_proba"))


def rounded(proba: Column) -> list[Column]:
    return [round_half_even(proba[i], 4) for i in range(len(LABELS))]


def predict_baseline(model: PipelineModel, df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with conf_left, conf_neutral, conf_right and y_pred."""
    scored = probabilities(model, df, F.col(text_col))
    p = F.col("_proba")
    return scored.select(
        *df.columns,
        *[c.alias(f"conf_{x.lower()}") for c, x in zip(rounded(p), LABELS)],
        best_label([p[i] for i in range(len(LABELS))]).alias("y_pred"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def linear_parts(model: PipelineModel) -> tuple[list, list[list[float]], list[float]]:
    """Feature stages, coefficients per label and intercepts, as ``features.linear_score`` takes them.

    A label that was not fitted has the intercept minus infinity, so its probability is 0.
    """
    fit, known = regression_of(model), fitted_labels(model)
    matrix, intercepts = fit.coefficientMatrix.toArray(), list(fit.interceptVector)
    stages = list(model.stages[: model.stages.index(fit)])
    own = [matrix[known.index(x)].tolist() if x in known else [0.0] * matrix.shape[1] for x in LABELS]
    return stages, own, [float(intercepts[known.index(x)]) if x in known else float("-inf") for x in LABELS]


def coefficient_table(model: PipelineModel, spark) -> tuple[DataFrame, list[float]]:
    """Coefficients as (term, left, neutral, right) rows, and the intercepts."""
    vocab = next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
    _, matrix, intercepts = linear_parts(model)
    names = [x.lower() for x in LABELS]
    rows = [(t, *[float(matrix[k][i]) for k in range(len(names))]) for i, t in enumerate(vocab)]
    schema = "term string, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema), intercepts
