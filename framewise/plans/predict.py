"""Label headlines: gates first, then a model for the rows that pass both.

The input is read once. Rows decided by a gate never reach a scorer: the
lexical scorer is a column expression under the gate's condition, the
logistic model sees an empty text for them, and a user's scorer receives
only the texts the gates let through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_MODEL, HYPOTHESES, LABELS, MARGIN, MODELS
from ..functions import gates as G
from ..functions import scores as S
from ..functions.numbers import round_half_even
from ..functions.text import clean_text, is_blank
from ..operators import classifier

# Called once per task that has work; returns the function that scores a batch.
PairScorer = Callable[[], Callable[[Sequence[str], Sequence[str]], np.ndarray]]
LogitScorer = Callable[[], Callable[[Sequence[str]], np.ndarray]]

DISPLAY = {"bert": "BERT", "baseline": "Baseline"}


REJECTED = "rejected"


def with_gate(df: DataFrame, headline: str = "headline", gates: bool = True) -> DataFrame:
    """Add gate: the name of the stage that decides the row; ``rejected`` if it is null or blank.

    Without ``gates`` every other row goes to the model.
    """
    stage = G.deciding_stage(headline) if gates else F.lit("model")
    return df.withColumn("gate", F.when(is_blank(headline), F.lit(REJECTED)).otherwise(stage))


def split_blank(df: DataFrame, headline: str = "headline") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): null and blank headlines are rejected."""
    return df.filter(~is_blank(headline)), df.filter(is_blank(headline))


def _run_scorer(factory, width: int, *extra):
    """Batch function for ``mapInPandas``: fills _scores where _text is not null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = None
        for batch in batches:
            todo = batch["_text"].notna().to_numpy()
            scores = np.empty(len(batch), dtype=object)
            if todo.any():
                score = score or factory()
                found = np.asarray(score(batch.loc[todo, "_text"].tolist(), *extra), dtype=float)
                if found.shape != (int(todo.sum()), width):
                    raise ValueError(f"scorer returned shape {found.shape}, wanted {width} columns")
                scores[np.flatnonzero(todo)] = list(found)
            yield batch.drop(columns="_text").assign(_scores=scores)

    return run


def _scored(gated: DataFrame, id_col: str, text_col: str, run) -> DataFrame:
    to_score = gated.select(
        id_col, "gate", F.when(G.is_model_prediction(F.col("gate")), F.col(text_col)).alias("_text")
    )
    id_type = dict(gated.dtypes)[id_col]
    if id_type.startswith("struct"):  # pandas would turn it into something else
        to_score = to_score.withColumn(id_col, F.to_json(id_col))
        back = F.from_json(id_col, id_type)
    else:
        back = F.col(id_col)
    kept = "string" if id_type.startswith("struct") else id_type
    scored = to_score.mapInPandas(run, f"{id_col} {kept}, gate string, _scores array<double>")
    return scored.withColumn(id_col, back)


def _is_model() -> Column:
    return G.is_model_prediction(F.col("gate"))


def _finish(
    df: DataFrame, id_col: str, conf: list[Column], label: Column, gap: Column, reason: Column
) -> DataFrame:
    """Put gate results and model results into one table; rejected rows have no label and no numbers."""
    by_gate = ~_is_model() & (F.col("gate") != REJECTED)
    c = [F.when(_is_model(), m).when(by_gate, g) for m, g in zip(conf, G.gate_confidence())]
    return df.select(
        id_col,
        F.when(_is_model(), label).when(by_gate, F.lit("Neutral")).alias("label"),
        *[x.alias(f"conf_{n.lower()}") for n, x in zip(LABELS, c)],
        F.when(_is_model() | by_gate, S.confidence_map(c)).alias("confidence"),
        F.when(_is_model(), gap).when(by_gate, F.lit(1.0)).alias("gap"),
        "gate",
        F.when(_is_model(), reason).otherwise(G.gate_reasoning(F.col("gate"))).alias("reasoning"),
        _is_model().alias("is_model_prediction"),
    )


def _by_hypotheses(df: DataFrame, id_col: str, margin: float) -> DataFrame:
    """Decide rows that carry _scores, one score per hypothesis."""
    means = S.class_means(F.col("_scores"))
    df = df.select(id_col, "gate", *[m.alias(f"_m{i}") for i, m in enumerate(means)])
    conf = S.normalise([F.col(f"_m{i}") for i in range(len(LABELS))])
    df = df.select(id_col, "gate", *[c.alias(f"_c{i}") for i, c in enumerate(conf)])
    c = [F.col(f"_c{i}") for i in range(len(LABELS))]
    df = df.withColumn("_gap", S.gap(c))
    df = df.withColumn("_label", S.decide(c, F.col("_gap"), margin))
    label, gap = F.col("_label"), F.col("_gap")
    return _finish(df, id_col, c, label, gap, S.nli_reasoning(label, c, gap, margin))


def _by_probabilities(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """Decide rows that carry _proba, exact probabilities in label order."""
    p = [F.col("_proba")[i] for i in range(len(LABELS))]
    df = df.select(
        id_col,
        "gate",
        S.best_label(p).alias("_label"),
        *[round_half_even(x, 4).alias(f"_c{i}") for i, x in enumerate(p)],
    )
    c = [F.col(f"_c{i}") for i in range(len(LABELS))]
    label = F.col("_label")
    return _finish(df, id_col, c, label, S.gap(c), S.model_reasoning(DISPLAY[name], label, c))


def predict(
    df: DataFrame,
    model: str = DEFAULT_MODEL,
    scorer: PairScorer | LogitScorer | PipelineModel | None = None,
    id_col: str = "headline_id",
    text_col: str = "headline",
    margin: float = MARGIN,
    raw_text: bool = False,
    gates: bool = True,
) -> DataFrame:
    """Label every row of ``df``; null and blank headlines are rejected, with a null label.

    ``nli``       scorer: factory of ``f(texts, hypotheses) -> [n, 10]`` entailment scores
    ``bert``      scorer: factory of ``f(texts) -> [n, 3]`` logits in label order
    ``baseline``  scorer: a fitted ``PipelineModel`` (see ``plans.train``), given the clean text
                  as in training, or the headline as it is with ``raw_text``
    ``lexical``   no scorer: share of the words of a hypothesis found in the headline
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}, expected one of {MODELS}")
    if model != "lexical" and scorer is None:
        raise ValueError(f"model {model!r} needs a scorer")

    gated = with_gate(df.select(id_col, text_col), text_col, gates)

    if model == "lexical":
        words = F.when(_is_model(), S.known_words(text_col))
        gated = gated.select(id_col, "gate", words.alias("_words"))
        gated = gated.select(id_col, "gate", S.lexical_scores(F.col("_words")).alias("_scores"))
        return _by_hypotheses(gated, id_col, margin)

    if model == "nli":
        sentences = [h for _, h in HYPOTHESES]
        run = _run_scorer(scorer, len(sentences), sentences)
        return _by_hypotheses(_scored(gated, id_col, text_col, run), id_col, margin)

    if model == "bert":
        run = _run_scorer(scorer, len(LABELS))
        scored = _scored(gated, id_col, text_col, run)
        p = S.softmax([F.col("_scores")[i] for i in range(len(LABELS))])
        return _by_probabilities(
            scored.select(id_col, "gate", F.array(*p).alias("_proba")), id_col, model
        )

    words = F.col(text_col) if raw_text else clean_text(text_col)
    scored = classifier.probabilities(scorer, gated, F.when(_is_model(), words))
    return _by_probabilities(scored, id_col, model)
