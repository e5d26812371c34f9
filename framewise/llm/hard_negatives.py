"""Hard negatives by a secondary-sort shuffle.

Vectors are quantised to integers, so scores are exact. For every anchor the
pairs that can matter travel under one packed key (anchor, descending
score, kind, id): repartitioned by anchor and sorted within partitions, an
anchor's positives and negatives arrive in the order of their scores. One
pass over that stream opens a window at each of the first positives and hands
every negative to the windows it fits, until they are full; it holds the open windows of one
anchor and never the anchor's rows.

All rows are scored against all anchors, a block of rows at a time against
blocks of anchors that tasks read from the shared folder in turn; nothing is
broadcast. A block sends on, for an anchor, its first positives and, once
these are known, its first negatives of each window. What is held back can't be among the
answer: the block itself has enough that come before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored
from .files import at

#: Rows scored together, and anchors in a file.
ROWS, ANCHORS = 1 << 16, 1 << 10
#: Scores computed at once.
SCORES = 1 << 22
_POSITIVE, _NEGATIVE = 0, 1
_LONG = (1 << 63) - 1


def quantised(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of every component: whole numbers as float64 where these are exact, else as objects."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    if not x.size or np.abs(x).max() < 1 << 44:
        return np.floor(256 * x)
    whole = [int(v) * 256 if abs(v) >= 1 << 53 else math.floor(256 * v) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``: float64 below 2^53, else objects."""
    if a.dtype != object and b.dtype != object:
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
        if most < 1 << 53:
            return a @ b.T
    a, b = (np.array([int(v) for v in x.ravel()], object).reshape(x.shape) for x in (a, b))
    return (a @ b.T if a.shape[1] else np.zeros((len(a), len(b)), object)).clip(-_LONG, _LONG)


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, id: np.ndarray) -> pa.Array:
    """25 bytes a row that sort by anchor, descending score, kind and id."""
    high = np.uint64(1 << 63)
    out = np.zeros((len(anchor), 25), np.uint8)
    for place, value in ((0, anchor.view(np.uint64) ^ high), (8, ~(score.view(np.uint64) ^ high)), (17, id.view(np.uint64) ^ high)):
        out[:, place : place + 8] = value.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 16] = kind
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(25), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def unpacked(key: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, score, kind, id of packed keys."""
    raw = np.frombuffer(b"".join(key.to_pylist()), np.uint8).reshape(-1, 25)
    high = np.uint64(1 << 63)
    anchor, score, id = (raw[:, k : k + 8].copy().view(">u8").ravel().astype(np.uint64) for k in (0, 8, 17))
    return (anchor ^ high).view(np.int64), (~score ^ high).view(np.int64), raw[:, 16], (id ^ high).view(np.int64)


def window(score: int, percent: tuple[int, int]) -> tuple[int, int]:
    """The least and the greatest score of a positive's negatives: percent[0] * p <= 100 * s <= percent[1] * p."""
    return -(-percent[0] * score // 100), percent[1] * score // 100


class _Block:
    """Rows of one width in order of their ids."""

    def __init__(self, ids: np.ndarray, labels: pa.Array, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        coded = labels.dictionary_encode()
        self.ids, self.vectors = ids[order], vectors[order]
        self.labels, self.names = coded.indices.to_numpy()[order], coded.dictionary

    def groups(self, labels: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
        """Places of ``labels`` by label, with its code here or -1."""
        code = pc.fill_null(pc.index_in(labels, value_set=self.names), -1).to_numpy()
        for c in np.unique(code):
            some = np.flatnonzero(code == c)
            step = max(1, SCORES // max(1, len(self.ids)))
            for a in range(0, len(some), step):
                yield some[a : a + step], int(c)

    def first_positives(self, ids, labels, vectors, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor, score, id) of the first ``most`` rows of each anchor's label, the anchor itself left out."""
        for some, c in self.groups(labels):
            mine = np.flatnonzero(self.labels == c)
            if not len(mine):
                continue
            scores = inner_products(vectors[some], self.vectors[mine])
            found = _highest(scores, most + 1)
            anchor = np.repeat(ids[some], found.shape[1])
            other = self.ids[mine][found].ravel()
            score = np.take_along_axis(scores, found, 1).ravel().astype(np.int64)
            use = anchor != other
            yield anchor[use], score[use], other[use]

    def first_negatives(self, ids, labels, vectors, windows: list, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor, score, id) of the first ``most`` rows of other labels in each of the anchor's windows."""
        for some, c in self.groups(labels):
            others = np.flatnonzero(self.labels != c)
            if not len(others):
                continue
            scores = inner_products(vectors[some], self.vectors[others])
            n = len(others)
            keys = _ordered_keys(scores)
            of, found = [], []
            for row, anchor in zip(keys, some.tolist()):
                taken: set[int] = set()
                for low, high in windows[anchor]:
                    end = int(np.searchsorted(row, max(-_LONG, min(_LONG, (high + 1) * n)) if keys.dtype != object else (high + 1) * n))
                    taken.update(k for k in row[max(0, end - most) : end].tolist() if k >= low * n)
                of += [int(ids[anchor])] * len(taken)
                found += taken
            if found:
                key = np.array(found, keys.dtype)
                place = (n - 1 - key % n).astype(np.int64)
                yield np.array(of), (key // n).astype(np.int64), self.ids[others[place]]


def _ordered_keys(scores: np.ndarray) -> np.ndarray:
    """Each row's scores ascending, equal ones by descending place: score * n + (n - 1 - place)."""
    n = scores.shape[1]
    if scores.dtype != object:
        if np.abs(scores).max() * n < 1 << 62:
            scores = scores.astype(np.int64)
        else:
            scores = np.array([int(v) for v in scores.ravel()], object).reshape(scores.shape)
    return np.sort(scores * n + (n - 1 - np.arange(n)), axis=1)


def _highest(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores of each row, equal ones by place."""
    n = scores.shape[1]
    keys = _ordered_keys(scores)[:, -most:][:, ::-1]
    return (n - 1 - keys % n).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block]]:
    """The rows (id, label, embedding) in blocks of one width and about ``ROWS`` rows."""
    held: list[pa.RecordBatch] = []

    def made():
        table = pa.Table.from_batches(held).combine_chunks()
        width = pc.list_value_length(table.column(2)).to_numpy()
        for w in np.unique(width):
            part = table.filter(pa.array(width == w)).combine_chunks()
            ids, labels, vectors = (part.column(k).combine_chunks() for k in range(3))
            yield int(w), _Block(ids.to_numpy(), labels, quantised(vectors, int(w)))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield from made()
            held = []
    if held:
        yield from made()


def _read(folder: str, columns: list[str]) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray, pa.Table]]:
    """width, ids, labels, vectors and the rows themselves of a folder's anchors, file by file and width by width."""
    store, root = at(folder)
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    for name in names:
        with store.open_input_file(name) as f:
            table = parquet.read_table(f, columns=["id", "label", "embedding", *columns])
        width = pc.list_value_length(table.column("embedding")).to_numpy()
        for w in np.unique(width):
            part = table.filter(pa.array(width == w)).combine_chunks()
            ids, labels, vectors = (part.column(k).combine_chunks() for k in range(3))
            yield int(w), ids.to_numpy(), labels, quantised(vectors, int(w)), part


def _in_files(rows: DataFrame, name: str, most: int) -> str:
    """``rows`` written to a folder of files of about ``most`` rows."""
    path = new_path(rows.sparkSession, name)
    count = rows.count()
    rows.repartition(max(1, -(-count // most))).write.parquet(path)
    return path


def _keys(anchor: np.ndarray, score: np.ndarray, kind: int, id: np.ndarray) -> pa.RecordBatch:
    anchor = np.ascontiguousarray(anchor, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor), packed(anchor, np.ascontiguousarray(score, np.int64), kind, np.ascontiguousarray(id, np.int64))],
        names=["anchor", "key"],
    )


def _secondary_sort(keys: DataFrame) -> DataFrame:
    return keys.repartition("anchor").sortWithinPartitions("key").select("key")


def _first_of_each(keys: DataFrame, most: int) -> DataFrame:
    """anchor, positives, scores: the first ``most`` of each anchor's sorted keys."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, scores = None, [], []
        kind = pa.schema([("anchor", pa.int64()), ("positives", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            anchor, score, _, id = unpacked(batch.column(0))
            for a, s, i in zip(anchor.tolist(), score.tolist(), id.tolist()):
                if a != now:
                    if ids:
                        out.append({"anchor": now, "positives": ids, "scores": scores})
                    now, ids, scores = a, [], []
                if len(ids) < most:
                    ids.append(i)
                    scores.append(s)
            yield pa.RecordBatch.from_pylist(out, kind)
        if ids:
            yield pa.RecordBatch.from_pylist([{"anchor": now, "positives": ids, "scores": scores}], kind)

    return _secondary_sort(keys).mapInArrow(stream, "anchor bigint, positives array<bigint>, scores array<bigint>")


def _mined(keys: DataFrame, most: int, percent: tuple[int, int]) -> DataFrame:
    """The stream of sorted keys read once: positives open windows, negatives go to those that they fit."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []
        for batch in batches:
            out = []
            for a, s, kind, i in zip(*(x.tolist() for x in unpacked(batch.column(0)))):
                if a != now:
                    now, open_ = a, []
                if kind == _POSITIVE:
                    open_.append([i, s, *window(s, percent), 0])
                    continue
                for w in open_:
                    if w[2] <= s <= w[3] and w[4] < most:
                        w[4] += 1
                        out.append((a, w[0], w[4], i, w[1], s))
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return _secondary_sort(keys).mapInArrow(stream, schema)


def usable_rows(vectors: DataFrame, id: str, embedding: str, label: str) -> DataFrame:
    """id, label, embedding of the rows that take part, one per id."""
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    rows = rows.filter("id is not null and label is not null and embedding is not null").filter(sound)
    repeated = stored(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated-ids")
    one = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "embedding")).alias("_"))
    return rows.join(repeated, "id", "left_anti").unionByName(one.select("id", "_.label", "_.embedding"))


def hard_negatives(
    vectors: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90),
    id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the inner product with the anchor of their vectors,
    component by component floor(256 x). Higher scores come first, equal ones by smaller
    id. ``anchors`` is a condition on ``id`` and ``label`` (the columns' names here), by default ids divisible
    by 100. An anchor's positives are its first ``positives`` other rows of the
    same label; each gets its first ``negatives`` rows of other labels whose score is
    between ``percent`` of the positive's score.

    Rows with a null id, label or vector, or a null, NaN or infinite component take
    no part. Vectors of different widths do not meet; empty ones score 0. Of rows that repeat
    an id the one with the smallest label, then vector, stands for all. Scores beyond 64 bits count
    as the largest such number. Other columns are not read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    anchors = F.col("id") % 100 == 0 if anchors is None else anchors
    rows = stored(usable_rows(vectors, id, embedding, label), "vectors")
    blocks = max(rows.count() // ROWS, spark.sparkContext.defaultParallelism)
    asked = rows.filter(anchors)
    folder = _in_files(asked, "anchors", ANCHORS)

    def positive_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, block in _blocks(batches):
            for w, ids, labels, vecs, _ in _read(folder, []):
                if w == width:
                    for found in block.first_positives(ids, labels, vecs, positives):
                        yield _keys(*found[:2], _POSITIVE, found[2])

    keys = rows.repartition(blocks).mapInArrow(positive_keys, "anchor bigint, key binary")
    first = stored(_first_of_each(keys, positives), "positives")
    opened = asked.join(first, asked["id"] == first["anchor"]).select("id", "label", "embedding", "scores")
    opened_in = _in_files(opened, "anchors", ANCHORS)

    def negative_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, block in _blocks(batches):
            for w, ids, labels, vecs, table in _read(opened_in, ["scores"]):
                if w == width:
                    windows = [[window(s, percent) for s in scores] for scores in table.column("scores").to_pylist()]
                    for found in block.first_negatives(ids, labels, vecs, windows, negatives):
                        yield _keys(*found[:2], _NEGATIVE, found[2])

    def opening_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, ids, scores = (batch.column(k) for k in range(3))
            n = pc.list_value_length(ids).to_numpy()
            yield _keys(np.repeat(anchor.to_numpy(), n), scores.flatten().to_numpy(), _POSITIVE, ids.flatten().to_numpy())

    keys = rows.repartition(blocks).mapInArrow(negative_keys, "anchor bigint, key binary")
    keys = keys.unionByName(first.mapInArrow(opening_keys, "anchor bigint, key binary"))
    return _mined(keys, negatives, percent)


def hard_negatives_oracle() -> str:
    """The query's rows in DuckDB SQL."""
    return """
    WITH rows AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ), positives AS (
      SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
      id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10"""
