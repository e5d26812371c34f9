"""Vocabulary of word n-grams, TF-IDF rows and linear scoring."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import LABELS, MAX_TERMS, NGRAM_RANGE, STOP_WORDS
from ..functions.numbers import round_half_even
from ..functions.scores import best_label, softmax
from ..functions.text import longer_runs, word_tokens
from ..lineage import written

#: Tasks leave out n-grams by their parts themselves where so few parts are left; more are joined.
PARTS = 200_000


def content_tokens(text_col: str, stop_words: list[str] = STOP_WORDS) -> Column:
    """The tokens of a text that are not stop words, in order."""
    tokens = word_tokens(text_col)
    return F.filter(tokens, lambda t: ~t.isin(stop_words)) if stop_words else tokens


def _with_runs(rows: DataFrame, n: int) -> DataFrame:
    """_n1 (tokens) with _n2 .. _n{n}: the longer n-grams."""
    for k in range(2, n + 1):
        runs = longer_runs(F.col(f"_n{k - 1}"), F.col("_n1"), k)
        rows = rows.withColumn(f"_n{k}", runs)
    return rows


def _grams(tokens: pa.Array, most: int, known: list[pa.Array | None]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For 1 to ``most`` words: different n-grams of a batch of token lists, and of each occurrence its number and its row.

    Only n-grams whose parts are all in ``known`` (by length; None: any).
    """
    row = np.asarray(pc.list_parent_indices(tokens), np.int64)
    coded = pc.list_flatten(tokens).dictionary_encode()
    words, code = coded.dictionary, np.asarray(coded.indices, np.int64)
    terms, gram, start = words, code, np.arange(len(code))  # number of the gram that starts at each of ``start``
    size = max(len(words), 1)
    for k in range(1, most + 1):
        if k > 1:
            keep = np.ones(len(terms), bool) if known[k - 2] is None else np.asarray(pc.is_in(terms, known[k - 2]))
            at = np.full(len(code) + 1, -1)
            good = keep[gram]
            at[start[good]] = gram[good]
            first = start[good]
            first = first[at[first + 1] >= 0]
            first = first[first + k - 1 < len(row)]
            first = first[row[first] == row[first + k - 1]]
            found, gram = np.unique(at[first] * size + code[first + k - 1], return_inverse=True)
            terms = pc.binary_join_element_wise(terms.take(pa.array(found // size)), words.take(pa.array(found % size)), " ")
            start = first
        yield terms, gram, row[start]


def _grams_of_batch(tokens: pa.Array, n: int, known: list[pa.Array | None]) -> pa.RecordBatch:
    """term, cf, df of the n-grams of a batch of token lists whose parts are all in ``known``."""
    *_, (terms, gram, row) = _grams(tokens, n, known)
    size = max(len(terms), 1)
    cf, df = (np.bincount(x, minlength=len(terms)) for x in (gram, np.unique(row * size + gram) % size))
    return pa.RecordBatch.from_arrays([terms, pa.array(cf, pa.int64()), pa.array(df, pa.int64())], names=["term", "cf", "df"])


class GramTable:
    """Numbers of given n-grams, by the strings of their words."""

    def __init__(self, terms: list[str], kind: pa.DataType):
        self.terms = pa.array(terms, kind)
        by_length: dict[int, set[str]] = {}
        for term in terms:
            words = term.split(" ")
            for k in range(1, len(words) + 1):  # the parts of a term, too
                by_length.setdefault(k, set()).update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
        self.parts = [pa.array(sorted(by_length.get(k, ())), kind) for k in range(1, max(by_length, default=0) + 1)]

    def counted(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each row begins, and per row the numbers of its n-grams, ascending, with how often each occurs."""
        size = max(len(self.terms), 1)
        keys = [np.zeros(0, np.int64)]
        for terms, gram, row in _grams(tokens, len(self.parts), self.parts):
            number = pc.index_in(terms, self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[gram]
            keys.append(row[number >= 0] * size + number[number >= 0])
        keys, count = np.unique(np.concatenate(keys), return_counts=True)
        return np.searchsorted(keys // size, np.arange(len(tokens) + 1)), keys % size, count


def _counts(tokens: DataFrame, n: int, known: list[list[str] | None]) -> DataFrame:
    """term, cf, df of the n-grams of ``tokens`` (_n1): counted batch by batch, then summed up."""
    shared = tokens.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = None
        for batch in batches:
            column = batch.column(0)
            if sets is None:
                kind = column.type.value_type
                sets = [None if s is None else pa.array(s, kind) for s in shared.value]
            yield _grams_of_batch(column, n, sets)

    rows = tokens.select("_n1").mapInArrow(count, "term string, cf bigint, df bigint")
    return rows.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _top(counts: DataFrame, max_terms: int) -> DataFrame:
    return counts.orderBy(F.desc("cf"), "term").limit(max_terms)


def _terms(counts: DataFrame) -> list[str] | None:
    """The terms of ``counts`` if they are few enough to be sent to all tasks."""
    rows = counts.select("term").limit(PARTS + 1).collect()
    return [r.term for r in rows] if len(rows) <= PARTS else None


def vocabulary(
    docs: DataFrame,
    text_col: str,
    max_terms: int = MAX_TERMS,
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    stop_words: list[str] = STOP_WORDS,
) -> DataFrame:
    """term, term_id, cf, df, idf: the most frequent n-grams, ties by term. A stored table.

    cf counts occurrences, df documents; idf = ln((1 + n) / (1 + df)) + 1
    for n documents.

    Most n-grams of a large corpus are rare, and shuffling them all would
    move several times the text. An n-gram is never more frequent than the
    shorter ones inside it, so the lengths are counted one after the other:
    an n-gram is shuffled only if both its parts reach the count that the
    ``max_terms``-th term has so far. The result is the same. Tasks count the n-grams
    of a batch as numbers; only different ones become strings and are shuffled.

    The texts are dealt out evenly once, before they are cut into tokens: all lengths
    are counted from that table, and documents may come in one large file.
    """
    low, high = ngram_range
    floor, counted, lengths = 1, [], []
    texts = docs.select(text_col).hint("rebalance")
    tokens = written(texts.select(content_tokens(text_col, stop_words).alias("_n1")), "tokens")
    for n in range(1, high + 1):
        parts = [_terms(x.filter(F.col("cf") >= floor)) for x in lengths]
        counts = _counts(tokens, n, parts)
        if parts and parts[-1] is None:
            frequent = lengths[-1].filter(F.col("cf") >= floor).select(F.col("term").alias("_part"))
            for words in (n - 1, 1 - n):  # the first and the last n - 1 words
                part = F.substring_index(F.col("term"), " ", words)
                counts = counts.join(frequent, part == frequent["_part"], "left_semi")
        counts = written(counts.filter(F.col("cf") >= floor), f"terms-{n}")
        lengths.append(counts)
        if n >= low:
            counted.append(counts)
            best = _top(reduce(DataFrame.unionByName, counted), max_terms)
            size, least = best.agg(F.count("*"), F.min("cf")).first()
            floor = least if size == max_terms else 1
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("cf"), "term")
    n_docs = tokens.agg(F.count("*").alias("n")).scalar()
    idf = F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + 1
    numbered = best.select(
        "term", F.row_number().over(order).alias("term_id"), "cf", "df", idf.alias("idf")
    )
    return written(numbered, "vocabulary")


def tfidf(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    max_terms: int = MAX_TERMS,
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    stop_words: list[str] = STOP_WORDS,
) -> DataFrame:
    """id, term, weight: tf * idf, each document scaled to length 1.

    After the vocabulary no row is moved: every document is turned into a
    sparse vector where it lies, and the vector is unfolded into its terms.
    """
    from .classifier import fit_features, term_vectors

    stages, terms = fit_features(docs, text_col, max_terms, ngram_range, stop_words)
    if not terms:
        return docs.select(id_col, F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    pairs = F.arrays_zip(F.col("_v.indices").alias("i"), F.col("_v.values").alias("w"))
    rows = term_vectors(stages, docs, text_col, [id_col]).select(id_col, F.inline(pairs).alias("i", "weight"))
    names = F.from_json(F.lit(json.dumps(terms)), "array<string>")
    return rows.select(id_col, F.element_at(names, F.col("i") + 1).alias("term"), "weight")


def _adding(coefficients: Column):
    return lambda total, p: total + p["w"] * F.element_at(coefficients, p["i"] + 1)


def linear_score(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    stages: list,
    coefficients: list[list[float]],
    intercepts: list[float],
) -> DataFrame:
    """id, conf_*, label: one dot product per label with the vector of a document.

    ``stages`` as ``classifier.fit_features`` gives them; ``coefficients`` has
    one list per label in the order of the vocabulary. Documents without a
    known term get the intercepts. No row is moved.
    """
    from .classifier import term_vectors

    pairs = F.arrays_zip(F.col("_v.indices").alias("i"), F.col("_v.values").alias("w"))
    staged = term_vectors(stages, docs, text_col, [id_col]).select(id_col, pairs.alias("_p"))
    logits = []
    for own, b in zip(coefficients, intercepts):
        table = F.from_json(F.lit(json.dumps([float(x) for x in own])), "array<double>")
        logits.append(
            F.aggregate(
                "_p", F.lit(0.0), _adding(table)
            )
            + F.lit(float(b))
        )
    names = [x.lower() for x in LABELS]
    staged = staged.select(id_col, *[x.alias(f"_z{i}") for i, x in enumerate(logits)])
    p = softmax([F.col(f"_z{i}") for i in range(len(names))])
    staged = staged.select(id_col, *[x.alias(f"_p{i}") for i, x in enumerate(p)])
    p = [F.col(f"_p{i}") for i in range(len(names))]
    return staged.select(
        id_col,
        *[round_half_even(x, 4).alias(f"conf_{n}") for n, x in zip(names, p)],
        best_label(p).alias("label"),
    )
