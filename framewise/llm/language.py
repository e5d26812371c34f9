"""Language identification with error-correcting output codes.

Every language has a codeword; every bit of it has a binary classifier on hashed
byte trigrams (log odds of the languages with bit 1 against those with bit 0).
A text gets the language whose codeword has the least loss: the logistic loss of
each bit's margin, weighted by how reliable that bit was on the fitted rows.
Texts that lie almost as near to a second codeword are flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .scan import LOWER, batch_bytes, slices

BUCKETS = 1 << 16
#: At most about so many labelled rows are fitted, chosen by a hash of their id and text.
FIT_ROWS = 20_000
#: Languages learned at most.
LANGUAGES = 256
#: Gap between the losses of the two nearest codewords (per unit of bit weight) below which a text is ambiguous.
AMBIGUOUS = 0.02
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LETTER[0x41:0x5B] = True
_FOLD = np.where(_LETTER, LOWER, 0x20).astype(np.uint8)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of +1 and -1: all different splits up to 6 languages, random ones beyond."""
    if n <= 6:
        bits = max(1, 2 ** (n - 1) - 1)
        masks = np.arange(bits)  # the first language has 1 everywhere; never all the others too
        rest = ((masks[:, None] >> np.arange(n - 1)) & 1).T
        return np.concatenate([np.ones((1, bits), np.int8), (2 * rest - 1).astype(np.int8)])[:n]
    bits, draw = int(np.ceil(12 * np.log2(n))), np.random.default_rng(seed)
    while True:
        code = draw.choice(np.array([-1, 1], np.int8), (n, bits))
        if len(np.unique(code, axis=0)) == n and (np.abs(code.sum(0)) < n).all():
            return code


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # buckets x bits
    scale: np.ndarray  # mean size of a bit's margin
    weight: np.ndarray  # reliability of a bit, mean 1

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of exp(-loss), and the gap to the second."""
        z = margins / self.scale
        loss = np.stack([(np.logaddexp(0, -3 * z * row) * self.weight).sum(1) for row in self.code], 1)
        order = np.sort(loss, 1)
        gap = (order[:, 1] - order[:, 0]) / self.weight.sum() if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        share = 1 / np.exp(order[:, :1] - order).sum(1)
        return loss.argmin(1), share, gap


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around every byte, other bytes than letters as blanks; starts of texts."""
    folded = _FOLD[data]
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    folded[after_c3 & (data >= 0x80) & (data <= 0x9E)] += 0x20  # upper case of Latin-1
    wide = folded.astype(np.uint32)
    before, after = np.full_like(wide, 0x20), np.full_like(wide, 0x20)
    before[1:], after[:-1] = wide[:-1], wide[1:]
    edge = at[:-1][at[:-1] < at[1:]]
    before[edge] = 0x20
    after[edge[edge > 0] - 1] = 0x20
    key = before | wide << np.uint32(8) | after << np.uint32(16)
    key *= np.uint32(0x9E3779B1)
    return (key >> np.uint32(16)).astype(np.int64), edge


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    found = np.zeros(len(at) - 1, bool)
    for a, b in slices(at, 1 << 19):
        part = data[at[a] : at[b]]
        letters = np.append(0, np.cumsum(_LETTER[part] & (part < 0x80), dtype=np.int32))
        own = at[a : b + 1] - at[a]
        found[a:b] = letters[own[1:]] > letters[own[:-1]]
    for i in np.flatnonzero(~found & (at[1:] > at[:-1])):
        found[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode(errors="replace"))
    return found


def _margins(odds: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at) - 1, odds.shape[1]))
    for a, b in slices(at, 1 << 19):
        own = at[a : b + 1] - at[a]
        filled = np.flatnonzero(own[1:] > own[:-1])
        if len(filled):
            bucket, starts = trigrams(data[at[a] : at[b]], own)
            for k in range(odds.shape[1]):
                out[a + filled, k] = np.add.reduceat(odds[:, k][bucket], starts) / (own[filled + 1] - own[filled])
    return out


def _sampled(rows: DataFrame, most: int, languages: int) -> DataFrame:
    """Of ``rows`` (id, text, lang) at most about ``most``, as many of each language: all of a rare one.

    Rows are drawn by a hash of id and text, so null and repeated ids make no difference. Of more than
    ``languages`` languages those with the most rows are taken.
    """
    counts = rows.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"))
    counts = stored(counts.orderBy(F.desc("_n"), "_lang").limit(languages), "languages")
    each = most / max(counts.count(), 1)
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.lit(each * (1 << 30)) / F.col("_n")
    return rows.join(F.broadcast(counts), F.col("lang") == F.col("_lang")).filter(drawn)  # ``languages`` rows at most


def fit_languages(rows: DataFrame, most: int = FIT_ROWS, languages: int = LANGUAGES) -> LanguageModel | None:
    """Fit on ``rows`` (id, text, lang), at most about ``most`` of them, dealt evenly over the languages.

    Rows with a null language are left out. None if there is no row.
    ``languages`` x 65,536 counts at most reach the driver, whatever the rows.
    """
    rows = _sampled(rows.filter("lang is not null").select("id", "text", "lang"), most, languages).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, at = batch_bytes(batch.column(0))
            langs = np.array(batch.column(1).to_pylist())
            for a, b in slices(at, 1 << 19):
                bucket, _ = trigrams(data[at[a] : at[b]], at[a : b + 1] - at[a])
                size = np.diff(at[a : b + 1])
                for lang in set(langs[a:b].tolist()):
                    mine = np.repeat(langs[a:b] == lang, size)
                    total[lang] = total.get(lang, 0) + np.bincount(bucket[mine], minlength=BUCKETS)
        for lang, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(seen), "bucket": seen.astype(np.int32), "n": n[seen]})

    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    if not languages:
        return None
    n = np.zeros((len(languages), BUCKETS))
    n[[languages.index(x) for x in table["lang"]], table["bucket"]] = table["n"]
    chance = (n + 0.5) / (n + 0.5).sum(1, keepdims=True)
    code = codewords(len(languages))
    ones = np.stack([chance[row > 0].mean(0) if (row > 0).any() else chance.mean(0) for row in code.T], 1)
    zeros = np.stack([chance[row < 0].mean(0) if (row < 0).any() else chance.mean(0) for row in code.T], 1)
    odds = np.log(ones / zeros).astype(np.float32)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, size, rows = np.zeros(code.shape[1]), np.zeros(code.shape[1]), 0
        for batch in batches:
            margin = _margins(odds, *batch_bytes(batch.column(0)))
            truth = code[[languages.index(x) for x in batch.column(1).to_pylist()]]
            right += (margin * truth > 0).sum(0)
            size += np.abs(margin).sum(0)
            rows += len(margin)
        bits = np.arange(len(right), dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"bit": bits, "right": right, "size": size, "n": np.full(len(bits), rows)})

    judged = rows.mapInArrow(judge, "bit int, right double, size double, n bigint").groupBy("bit")
    judged = judged.agg(*[F.sum(c).alias(c) for c in ("right", "size", "n")]).toPandas().sort_values("bit")
    wrong = 1 - (judged["right"].to_numpy() + 1) / (judged["n"].to_numpy() + 2)
    weight = np.clip(np.log((1 - wrong) / wrong), 0.1, None)
    scale = np.maximum(judged["size"].to_numpy() / np.maximum(judged["n"].to_numpy(), 1), 1e-9)
    return LanguageModel(languages, code, odds, scale, weight / weight.mean())


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1) and lang_ambiguous, replacing columns of these names.

    A null text or one without a letter is ``und`` with score 0. Without a model every text is,
    and all are ambiguous: who drops those should then use ``with_letters``. Only ``text`` is looked at.
    """
    added = ("lang_pred", "lang_score", "lang_ambiguous")
    rows = docs.drop(*added)
    if model is None:
        return rows.withColumns({"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0), "lang_ambiguous": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 65,536 x bits
    place = rows.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages)
        for batch in batches:
            data, at = batch_bytes(batch.column(place))
            best, score, gap = model.decode(_margins(model.odds, data, at))
            known = has_letter(data, at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.where(known, names[best], UNKNOWN).tolist()), pa.array(np.where(known, score, 0.0)), pa.array(~known | (gap < ambiguous))],
                names=[*batch.schema.names, *added],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(predict, f"{schema}, lang_pred string, lang_score double, lang_ambiguous boolean")


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter of any script."""
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_letter(*batch_bytes(batch.column(place)))))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id: str = "doc_id", parts: int = 3, which: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``which``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % parts == which, F.lit(False))


def learn_languages(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Fit on the rows of ``docs`` that are not held out."""
    rows = docs.filter(~held_out(id))
    return fit_languages(rows.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")))
