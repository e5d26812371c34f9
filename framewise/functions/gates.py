"""Keyword gates as column expressions.

Each gate is one regular expression over the lower-cased headline. The
keywords are factored by common prefix, so a position in the text costs
one character test for most of them instead of one per keyword.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import GATE_REASONING, LABELS, NON_POLITICAL_KEYWORDS, POLITICAL_KEYWORDS
from .text import col

NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"


def _literal(text: str) -> str:
    return re.sub(r"([^a-z0-9 ])", r"\\\1", text)


def _by_prefix(words: list[str]) -> str:
    """Alternation of ``words`` with common prefixes written once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    end = "" in heads
    heads.pop("", None)
    parts = [_literal(h) + _by_prefix(tails) for h, tails in heads.items()]
    if not parts:
        return ""
    body = parts[0] if len(parts) == 1 and not end else "(?:" + "|".join(parts) + ")"
    return body + "?" if end else body


def keyword_pattern(keywords: list[str]) -> str:
    """Pattern for any of ``keywords`` standing between word boundaries."""
    first = "".join(sorted({k[0] for k in keywords}))
    return f"(?=[{first}]){NOT_AFTER_WORD}{_by_prefix(sorted(keywords))}{NOT_BEFORE_WORD}"


NON_POLITICAL = keyword_pattern(NON_POLITICAL_KEYWORDS)
POLITICAL = keyword_pattern(POLITICAL_KEYWORDS)


def stage_of(non_political: Column, political: Column, passed: str) -> Column:
    """The first gate wins; ``passed`` names the rows that go through both."""
    return (
        F.when(non_political, F.lit("non_political"))
        .when(~political, F.lit("neutral_political"))
        .when(political, F.lit(passed))
    )


def _gate(headline: Column | str, passed: str) -> Column:
    text = F.lower(col(headline))
    return (
        F.when(text.rlike(NON_POLITICAL), F.lit("non_political"))
        .when(~text.rlike(POLITICAL), F.lit("neutral_political"))
        .when(text.isNotNull(), F.lit(passed))
    )


def classify_gate(headline: Column | str) -> Column:
    """non_political, neutral_political or biased_political; null stays null."""
    return _gate(headline, "biased_political")


def deciding_stage(headline: Column | str) -> Column:
    """The gate that decides the headline, or ``model`` if it passes both."""
    return _gate(headline, "model")


def is_non_political(headline: Column | str) -> Column:
    return F.lower(col(headline)).rlike(NON_POLITICAL)


def is_political(headline: Column | str) -> Column:
    """Any political keyword, whatever the first gate says."""
    return F.lower(col(headline)).rlike(POLITICAL)


def is_model_prediction(gate: Column) -> Column:
    return gate == "model"


def gate_confidence() -> list[Column]:
    """Confidence of a row decided by a gate, in label order."""
    return [F.lit(1.0 if label == "Neutral" else 0.0) for label in LABELS]


def gate_reasoning(gate: Column) -> Column:
    out = None
    for name, text in GATE_REASONING.items():
        out = (F if out is None else out).when(gate == name, F.lit(text))
    return out


_WORDS = [k for k in NON_POLITICAL_KEYWORDS + POLITICAL_KEYWORDS if k.isalnum()]
_PHRASES = [k for k in NON_POLITICAL_KEYWORDS + POLITICAL_KEYWORDS if not k.isalnum()]


_ANY_PHRASE = keyword_pattern(_PHRASES)


def matched_keywords(text: Column | str) -> Column:
    """Every keyword of either gate that occurs in the lower-case ``text``, each once.

    Single words are found by one split of the text. Phrases are looked for
    one by one only in texts where one pattern for all of them matches, and
    by pattern only where they occur as plain text.
    """
    text = col(text)
    words = F.array_intersect(
        F.split(text, r"[^\p{L}\p{N}_]+"), F.array(*[F.lit(w) for w in _WORDS])
    )
    phrases = F.array_compact(
        F.array(
            *[
                F.when(text.contains(p) & text.rlike(keyword_pattern([p])), F.lit(p))
                for p in _PHRASES
            ]
        )
    )
    return F.when(text.rlike(_ANY_PHRASE), F.concat(words, phrases)).otherwise(words)
