"""Toxic passages as maximum-scoring segments of a text.

A word's score is its log odds of standing in a toxic rather than a clean
document, with a Dirichlet prior from all documents, and a small charge for
every word, so that chance words cost. One scan over a text, linear in its
length, finds all maximal segments (no segment can gain by growing or shrinking). For random
clean words the largest score follows an extreme-value law: a segment of
score S among n words is expected n * exp(-rate * S) times by chance. Segments that are
expected rarely enough are passages; the log of how unlikely, summed over all segments,
is turned into a probability on the fitted rows. Words that are too unsure for that
only rank texts that are else alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .scan import LOWER, batch_bytes, slices, span_hashes

BUCKETS = 1 << 20
#: At most about so many labelled rows are fitted, chosen by a hash of their id.
FIT_ROWS = 40_000
#: Weight of the prior, in documents; the charge of a word; least likelihood-ratio statistic of a word that counts.
PRIOR, CHARGE, SURE = 50.0, 0.05, 25.0
#: With few labelled rows hardly a word gets there: one in this share of the toxic documents and in no clean one
#: counts too, if it has the second statistic.
IN_TOXIC, LEAST = 0.25, 9.0
#: Least statistic of a word that hints, and the most evidence that hints add.
UNSURE, HINT = 6.0, 0.01
#: A segment expected by chance less often than this is a passage.
EXPECTED = 1.0
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
SPAN = "array<struct<start:bigint,end:bigint,score:double,expected:double>>"


def letter_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, and where each text's runs begin."""
    letter = _LETTER[data]
    begin, stop = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    stop[:-1] &= ~letter[1:]
    edge = at[:-1][at[:-1] < at[1:]]
    begin[edge] = letter[edge]
    inner = edge[edge > 0]
    stop[inner - 1] = letter[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, at)


def _buckets(data: np.ndarray, at: np.ndarray):
    lowered = LOWER[data]
    starts, ends, first = letter_runs(lowered, at)
    return (span_hashes(lowered, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), starts, ends, first


@dataclass
class ToxicModel:
    score: np.ndarray  # per bucket, charge taken off
    rate: float  # of the extreme-value law
    hints: np.ndarray  # the same with the words that hint
    hint_rate: float
    offset: float  # probability = logistic(offset + slope * log1p(evidence))
    slope: float

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.offset + self.slope * np.log1p(evidence))))


def maximal_segments(place: np.ndarray, score: np.ndarray, charge: float) -> list[tuple[int, int, float]]:
    """(first, last + 1, score) of all maximal segments of a text, in one pass.

    ``place`` are the positions of words with a positive score, ``score`` those
    scores; every other word scores -``charge``.
    """
    found: list[list[float]] = []  # first, end, sum before, sum after
    total, before = 0.0, 0
    for p, s in zip(place.tolist(), score.tolist()):
        total -= charge * (p - before)
        before = p + 1
        first, low = p, total
        total += s
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= low:
                k -= 1
            if k < 0 or found[k][3] >= total:
                found.append([first, p + 1, low, total])
                break
            first, low = found[k][0], found[k][2]
            del found[k:]
    return [(int(a), int(b), high - low) for a, b, low, high in found]


def _segments(score: np.ndarray, rate: float, bucket: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, list]]:
    """Text and its maximal segments, (first word, last word, score, log of expected), for texts that have some."""
    value = score[bucket]
    good = np.flatnonzero(value > 0)
    of = np.searchsorted(first, good, "right") - 1
    edge = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
        text, mine = int(of[x]), good[x:y]
        at, longest = int(first[text]), float(np.log(first[text + 1] - first[text]))
        found = maximal_segments(mine - at, value[mine], CHARGE)
        yield text, [(at + a, at + b - 1, s, longest - rate * s) for a, b, s in found]


def _evidence(segments: list) -> float:
    """How unlikely the segments are by chance: minus the log of 1 - exp(-expected), which is about that of ``expected`` if small."""
    log = np.array([e for *_, e in segments])
    return float(np.where(log < -30, -log, -np.log(-np.expm1(-np.exp(np.maximum(log, -30))))).sum())


def _judged(model: ToxicModel, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[int, list]]:
    """The evidence of every text, and the passages, (start byte, end byte, score, expected), of those that have some."""
    evidence, passages = np.zeros(len(at) - 1), {}
    for a, b in slices(at):
        edge = at[a : b + 1] - at[a]
        bucket, starts, ends, first = _buckets(data[at[a] : at[b]], edge)
        for i, segments in _segments(model.score, model.rate, bucket, first):
            evidence[a + i] = _evidence(segments)
            found = [(int(starts[x] - edge[i]), int(ends[y] - edge[i]), s, float(np.exp(e))) for x, y, s, e in segments if e < np.log(EXPECTED)]
            if found:
                passages[a + i] = found
        for i, segments in _segments(model.hints, model.hint_rate, bucket, first):
            hint = _evidence(segments)
            evidence[a + i] += HINT * hint / (1 + hint)
    return evidence, passages


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, id: str = "doc_id", text: str = "text") -> ToxicModel | None:
    """Fit on the rows of ``docs`` that ``labels`` (id, toxic 0/1) name, at most about ``most``.

    Null ids and labels are left out; of several labels of an id the highest
    counts. None unless both classes occur. The labels used are broadcast:
    ``most`` rows at most. Counts per bucket reach the driver, 1,048,576 at most.
    """
    marks = labels.filter(F.col(id).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id).alias("_id"))
    marks = marks.agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    share = int((1 << 30) * min(1.0, most / max(n, 1)))
    marks = marks.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share)
    rows = docs.select(F.col(id).alias("_id"), text).join(F.broadcast(marks), "_id").select(text, "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            data, at = batch_bytes(batch.column(0))
            toxic = (batch.column(1).to_numpy() > 0).astype(np.int64)
            size += np.bincount(toxic, minlength=2)
            for a, b in slices(at):
                bucket, _, _, first = _buckets(data[at[a] : at[b]], at[a : b + 1] - at[a])
                once = np.unique(np.repeat(np.arange(b - a), np.diff(first)) * BUCKETS + bucket)
                np.add.at(seen, (toxic[a + once // BUCKETS], once % BUCKETS), 1)
        used = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_pydict(
            {"bucket": np.append(used, -1).astype(np.int32), "clean": np.append(seen[0][used], size[0]).astype(np.int64), "toxic": np.append(seen[1][used], size[1]).astype(np.int64)}
        )

    counts = rows.mapInArrow(count, "bucket int, clean bigint, toxic bigint").groupBy("bucket")
    table = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow().to_pandas()
    size = table[table.bucket < 0]
    if not len(size) or size.clean.sum() == 0 or size.toxic.sum() == 0:
        return None
    n_clean, n_toxic = int(size.clean.sum()), int(size.toxic.sum())
    table = table[table.bucket >= 0]
    clean, toxic = table.clean.to_numpy(float), table.toxic.to_numpy(float)
    prior = PRIOR * (clean + toxic) / (n_clean + n_toxic) + 0.01
    odds = np.log((toxic + prior) / (n_toxic + PRIOR)) - np.log((clean + prior) / (n_clean + PRIOR))
    share = n_toxic / (n_clean + n_toxic)
    expected = np.stack([toxic, clean]) / np.stack([(toxic + clean) * share, (toxic + clean) * (1 - share)])
    sure = 2 * (toxic * np.log(np.maximum(expected[0], 1e-300)) + clean * np.log(np.maximum(expected[1], 1e-300)))
    used = table.bucket.to_numpy()

    def scores(least: float) -> tuple[np.ndarray, float]:
        score, good = np.full(BUCKETS, -CHARGE, np.float32), (odds > 0) & (sure >= least)
        score[used[good]] = odds[good] - CHARGE
        return score, _rate(score[used], clean + prior)

    least = min(SURE, max(LEAST, IN_TOXIC * 2 * n_toxic * -np.log(share)))
    model = ToxicModel(*scores(least), *scores(UNSURE), 0.0, 1.0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = batch_bytes(batch.column(0))
            evidence, _ = _judged(model, data, at)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.log1p(evidence), 2)), batch.column(1)], names=["x", "toxic"])

    # rounded to hundredths: a table of some hundred rows whatever the corpus
    seen = rows.mapInArrow(weigh, "x double, toxic int").groupBy("x", "toxic").count().toPandas()
    model.offset, model.slope = _logistic(seen["x"].to_numpy(), (seen["toxic"] > 0).to_numpy(float), seen["count"].to_numpy(float))
    return model


def _rate(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of mean(exp(rate * score)) = 1 for words of clean documents."""
    p = weight / weight.sum()
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * score, 700))).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * score, 700))).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of one variable, with a weak pull of the slope to 0."""
    w = np.zeros(2)
    a = np.stack([np.ones_like(x), x], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        grad = a.T @ (n * (p - y)) + np.array([0, 0.1]) * w
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + np.diag([1e-9, 0.1])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score_toxicity(docs: DataFrame, model: ToxicModel | None, text: str = "text") -> DataFrame:
    """``docs`` with toxic_score (0 to 1) and toxic_spans, replacing columns of these names.

    A span is (start, end, score, expected): characters of the text from 0, the
    end not included, the segment's score and how often it is expected by
    chance. A null or empty text has no span and the score of a text without any; so
    have all texts without a model (score 0). Only ``text`` is looked at.
    """
    rows = docs.drop("toxic_score", "toxic_spans")
    if model is None:
        return rows.withColumn("toxic_score", F.lit(0.0)).withColumn("toxic_spans", F.array().cast(SPAN))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB
    place = rows.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            data, at = batch_bytes(batch.column(place))
            evidence, passages = _judged(model, data, at)
            spans = [[] for _ in evidence]
            for i, segments in passages.items():
                chars = np.cumsum((data[at[i] : at[i + 1]] & 0xC0) != 0x80)
                spans[i] = [{"start": int(chars[a]) - 1, "end": int(chars[b - 1]), "score": s, "expected": e} for a, b, s, e in segments]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.probability(evidence)), pa.array(spans, kind)],
                names=[*batch.schema.names, "toxic_score", "toxic_spans"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(judge, f"{schema}, toxic_score double, toxic_spans {SPAN}")


def learn_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id") -> ToxicModel | None:
    """Fit on the labels of rows that are not held out (crc32 of the id mod 5 is not 0)."""
    return fit_toxicity(docs, labels.filter(~held_out(id, 5, 0)))
