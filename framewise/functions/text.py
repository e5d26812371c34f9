"""Text expressions: trimming, cleaning, keys and tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import SEED, WHITE_SPACE, WHITE_SPACE_CHARS

URL = f"http[^{WHITE_SPACE}]+"
WORD_RUN = r"[\p{L}\p{N}_]{2,}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` written and evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column | str) -> Column:
    """Remove Unicode white space from both ends (``trim`` alone only removes U+0020)."""
    return F.btrim(col(c), F.lit(WHITE_SPACE_CHARS))


def norm_key(c: Column | str) -> Column:
    """Key under which two titles count as the same."""
    return strip(F.lower(col(c)))


def _without_urls(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), URL, " ")


def clean_text(c: Column | str) -> Column:
    """Lower-case words and digits separated by single spaces; null becomes ''."""
    return F.trim(F.regexp_replace(_without_urls(c), "[^a-z0-9]+", " "))


def clean_words(c: Column | str) -> Column:
    """The words of ``clean_text``, perhaps with empty strings at the ends."""
    return F.split(_without_urls(c), "[^a-z0-9]+")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def digest(c: Column) -> Column:
    """Fixed-width stand-in for a long key, so that shuffles carry no second copy of a text."""
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def sample_key(id_col: Column | str, seed: int = SEED) -> Column:
    """Uniform, reproducible sort key of a row: 32 hexadecimal digits. A null id has a key of its own."""
    return F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), col(id_col).cast("string")), F.lit(str(seed))))


def word_tokens(c: Column | str) -> Column:
    """Lower-case runs of at least two word characters, in order."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD_RUN), F.lit(0))


def longer_runs(runs: Column, tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens, from the runs of ``n - 1`` of the same tokens."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return F.zip_with(
        F.slice(runs, F.lit(1), count),
        F.slice(tokens, F.lit(n), count),
        lambda run, token: F.concat(run, F.lit(" "), token),
    )


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | c.startswith(p)
    return hit


def contains_any(c: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | c.contains(p)
    return hit
