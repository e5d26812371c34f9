"""Decimal rounding that follows the exact binary value, ties to even.

``round`` in Spark rounds the shortest decimal text of a double and sends
ties up. Here the product ``x * 10^d`` is taken together with its exact
rounding error, so a value is rounded the way correctly rounding
languages print it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_SPLIT = 134217729.0  # 2^27 + 1 cuts a double into two halves of 26 bits


def _scaled(x: Column, scale: float) -> Column:
    """Nearest integer to ``x * scale``; ``scale`` must have at most 26 significant bits."""

    def nearest(v: Column) -> Column:
        product = v * scale
        high = v * _SPLIT - (v * _SPLIT - v)
        error = (high * scale - product) + (v - high) * scale
        below = F.floor(product).cast("double")
        tie = F.when(error > 0, below + 1).when(error < 0, below).otherwise(F.rint(product))
        return F.when(product - below == 0.5, tie).otherwise(F.rint(product))

    return let(x, nearest)


def round_half_even(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return _scaled(x, scale) / scale


def percent_text(x: Column) -> Column:
    """One decimal and a percent sign: 0.1225 gives '12.2%'."""
    tenths = _scaled(x * 100.0, 10.0)
    return F.concat((tenths / 10).cast("decimal(20,1)").cast("string"), F.lit("%"))
