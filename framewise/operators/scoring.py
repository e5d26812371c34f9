"""From scores to decisions: hypothesis tables, class means, logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import HYPOTHESES, LABELS, MARGIN
from ..functions import scores as S
from ..functions.numbers import round_half_even
from ..sources.dims import hypothesis_dim


def hypothesis_pairs(
    df: DataFrame, id_col: str = "headline_id", headline: str = "headline"
) -> DataFrame:
    """Every headline with every hypothesis, for a scorer that works on pairs.

    The fixed list of hypotheses is unfolded inside each row, so the pairs
    of a headline stay in its partition and nothing is joined.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("hyp_id"), F.lit(c).alias("class"), F.lit(h).alias("hypothesis"))
            for i, (c, h) in enumerate(HYPOTHESES)
        ]
    )
    return df.select(id_col, headline, F.inline(pairs))


def class_scores(
    scores: DataFrame, hypotheses: DataFrame | None = None, id_col: str = "headline_id"
) -> DataFrame:
    """Mean score per headline and class from (id, hypothesis, score) rows.

    The ten built-in hypotheses are broadcast. A table of the caller's own
    is joined as the optimizer sees fit. Labels without a row score 0.
    """
    dim = F.broadcast(hypothesis_dim(scores.sparkSession)) if hypotheses is None else hypotheses
    joined = scores.join(dim.select("hypothesis", "class"), "hypothesis")
    return joined.groupBy(id_col).agg(
        *[
            F.coalesce(F.avg(F.when(F.col("class") == label, F.col("score"))), F.lit(0.0)).alias(
                f"mean_{label.lower()}"
            )
            for label in LABELS
        ]
    )


def _means() -> list[Column]:
    return [F.col(f"mean_{label.lower()}") for label in LABELS]


def with_confidence(df: DataFrame, means: list[Column] | None = None) -> DataFrame:
    """Add conf_left, conf_neutral and conf_right."""
    shares = S.normalise(means or _means())
    return df.withColumns({f"conf_{x.lower()}": c for x, c in zip(LABELS, shares)})


def with_decision(df: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Add gap and label under the margin rule."""
    conf = S.confidence_columns()
    return df.withColumn("gap", S.gap(conf)).withColumn(
        "label", S.decide(conf, F.col("gap"), margin)
    )


def decisions_from_scores(
    scores: DataFrame, id_col: str = "headline_id", margin: float = MARGIN
) -> DataFrame:
    """id, conf_*, gap, label from (id, hypothesis, score) rows."""
    out = with_decision(with_confidence(class_scores(scores, id_col=id_col)), margin)
    return out.select(id_col, *S.confidence_columns(), "gap", "label")


def decisions_from_logits(
    df: DataFrame, logits: str = "logits", id_col: str = "headline_id"
) -> DataFrame:
    """id, conf_*, label from an array of three logits, in label order.

    The label is taken from the unrounded probabilities.
    """
    exact = S.softmax([F.col(logits)[i] for i in range(len(LABELS))])
    staged = df.select(id_col, *[p.alias(f"_p{i}") for i, p in enumerate(exact)])
    p = [F.col(f"_p{i}") for i in range(len(LABELS))]
    return staged.select(
        id_col,
        *[round_half_even(x, 4).alias(f"conf_{n.lower()}") for n, x in zip(LABELS, p)],
        S.best_label(p).alias("label"),
    )
