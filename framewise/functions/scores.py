"""Score expressions: lexical scorer, normalisation, softmax and the decision rule."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import HYPOTHESES, LABELS, MARGIN, NO_EVIDENCE
from .numbers import percent_text, round_half_even
from .text import clean_words, col


def hypothesis_words(sentence: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", sentence.lower())))


def known_words(text: Column | str, hypotheses=HYPOTHESES) -> Column:
    """Distinct words of a headline that occur in any hypothesis: a short array."""
    vocabulary = sorted({w for _, h in hypotheses for w in hypothesis_words(h)})
    return F.array_intersect(clean_words(text), F.array(*[F.lit(w) for w in vocabulary]))


def overlap(words: Column, hypothesis: str) -> Column:
    """Share of the words of ``hypothesis`` found in ``words``; 0 if it has none."""
    wanted = hypothesis_words(hypothesis)
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in wanted]))) / F.lit(
        float(len(wanted))
    )


def lexical_scores(words: Column, hypotheses=HYPOTHESES) -> Column:
    """One score per hypothesis, in hypothesis order, from ``known_words``."""
    return F.array(*[overlap(words, h) for _, h in hypotheses])


def class_means(scores: Column, hypotheses=HYPOTHESES) -> list[Column]:
    """Mean score per label, in label order, from an array in hypothesis order."""
    means = []
    for label in LABELS:
        at = [i for i, (cls, _) in enumerate(hypotheses) if cls == label]
        total = F.lit(0.0)
        for i in at:
            total = total + scores[i]
        means.append(total / float(len(at)) if at else F.lit(0.0))
    return means


def normalise(means: list[Column]) -> list[Column]:
    """Shares of the total to four decimals; a fixed near-even split if the total is zero."""
    total = means[0]
    for m in means[1:]:
        total = total + m
    return [
        F.when(total > 0, round_half_even(m / total, 4)).otherwise(F.lit(none))
        for m, none in zip(means, NO_EVIDENCE)
    ]


def gap(confidence: list[Column]) -> Column:
    """Lead of the best label over the second best."""
    ordered = F.sort_array(F.array(*confidence), asc=False)
    return ordered[0] - ordered[1]


def best_label(values: list[Column]) -> Column:
    """Label of the largest value; the earlier label wins a tie."""
    top = F.greatest(*values)
    out = None
    for label, v in list(zip(LABELS, values))[:-1]:
        out = (F if out is None else out).when(v == top, F.lit(label))
    return out.otherwise(F.lit(LABELS[-1]))


def decide(confidence: list[Column], lead: Column, margin: float = MARGIN) -> Column:
    """Best label, or Neutral if its lead is below the margin."""
    return F.when(lead < margin, F.lit("Neutral")).otherwise(best_label(confidence))


def confidence_of(label: Column, confidence: list[Column]) -> Column:
    out = None
    for name, c in zip(LABELS, confidence):
        out = (F if out is None else out).when(label == name, c)
    return out


def nli_reasoning(
    label: Column, confidence: list[Column], lead: Column, margin: float = MARGIN
) -> Column:
    ambiguous = F.concat(
        F.lit("NLI analysis: ambiguous framing (gap "),
        percent_text(lead),
        F.lit(f" < threshold {margin:.0%})"),
    )
    clear = F.concat(
        F.lit("NLI analysis: "),
        label,
        F.lit(" framing detected ("),
        percent_text(confidence_of(label, confidence)),
        F.lit(" confidence)"),
    )
    return F.when(lead < margin, ambiguous).otherwise(clear)


def model_reasoning(name: str, label: Column, confidence: list[Column]) -> Column:
    return F.concat(
        F.lit(f"{name} model prediction ("),
        percent_text(confidence_of(label, confidence)),
        F.lit(" confidence)"),
    )


def softmax(logits: list[Column]) -> list[Column]:
    """Probabilities of the logits, not rounded."""
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    return [p / total for p in powers]


def confidence_map(confidence: list[Column]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in LABELS]), F.array(*confidence))


def confidence_columns() -> list[Column]:
    return [col(f"conf_{label.lower()}") for label in LABELS]
