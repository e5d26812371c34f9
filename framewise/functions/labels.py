"""Label expressions: five categories to three labels, labels to ids and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import CATEGORY_TO_LABEL, LABELS, OTHER_CATEGORY_LABEL
from .text import col


def map_category(c: Column | str) -> Column:
    """Collapse the source category into Left, Neutral or Right (null and unknown: Right)."""
    c = col(c)
    out = None
    for category, label in CATEGORY_TO_LABEL.items():
        out = (F if out is None else out).when(c == category, F.lit(label))
    return out.otherwise(OTHER_CATEGORY_LABEL)


def encode_label(c: Column | str) -> Column:
    c = col(c)
    out = None
    for i, label in enumerate(LABELS):
        out = (F if out is None else out).when(c == label, F.lit(i))
    return out


def decode_label(c: Column | str) -> Column:
    c = col(c)
    out = None
    for i, label in enumerate(LABELS):
        out = (F if out is None else out).when(c == i, F.lit(label))
    return out
