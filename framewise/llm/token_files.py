"""Token ids in files: frequency ranks in a byte-aligned variable-length code.

The more frequent an id in the whole corpus, the smaller its rank (ties: the
smaller id first). A rank takes one to four bytes; its length less one is two
bits of a control byte, four ranks to one. Control bytes lie apart from the
data bytes, so a block is decoded without a loop: the lengths come from a table
of 256 control bytes, their sums say where each rank begins.

A file is a run of blocks. A block is the magic, six little-endian int64 (texts,
ids, control bytes, data bytes, whether ids of texts are given, 0), the texts'
ids, their numbers of token ids, the control bytes and the data bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, stored
from .files import NewFile, at
from .tokens import encoder

MAGIC = b"RANKVB01"
#: Ids in a block before it is written.
BLOCK_IDS = 1 << 20
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ``ranks`` (uint32)."""
    ranks = np.asarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranks of texts packed one after the other, ``sizes`` of each; no loop over ranks."""
    groups = -(-sizes // 4)
    place = np.arange(len(control)) - np.repeat(np.cumsum(groups) - groups, groups)
    left = np.repeat(sizes, groups) - 4 * place  # ranks from this control byte to the text's end
    size = _LENGTHS[control][np.arange(4) < left[:, None]]
    first = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    four = padded[first]
    for k in (1, 2, 3):
        four = four | padded[first + k] << np.uint32(8 * k)
    return four & _MASKS[size]


def token_counts(docs: DataFrame, path: str, end: int, text: str = "text") -> DataFrame:
    """token int, n bigint: how often each id occurs, ``end`` once for each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = encoder(path), np.zeros(0, np.int64)
        for batch in batches:
            for ids in encode(batch.column(0)):
                more = np.bincount(ids, minlength=end + 1)
                more[end] += 1
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": seen.astype(np.int32), "n": total[seen]})

    return (
        docs.select(text)
        .mapInArrow(count, "token int, n bigint")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
    )


def rank_table(counts: DataFrame) -> np.ndarray:
    """Ids by rank. One row for each id of the vocabulary reaches the driver, no more."""
    rows = counts.collect()
    return np.array([r.token for r in sorted(rows, key=lambda r: (-r.n, r.token))], "<u4")


class _TokenFile:
    """A file of one range of texts while it is written."""

    def __init__(self, folder: str, place: int):
        self.first, self.texts, self.ids = None, 0, 0
        self.file = NewFile(folder, f"ids-{place:08d}.bin")

    def write(self, names: pa.Array, sizes: list[int], control: list[bytes], data: list[bytes]) -> None:
        if not self.texts:
            self.first = names[0].as_py()
        control, data = b"".join(control), b"".join(data)
        n = np.array(sizes, "<i8")
        head = np.array([len(n), n.sum(), len(control), len(data), names.null_count, 0], "<i8")
        ids = np.asarray(names.fill_null(0).to_numpy(), "<i8")
        for part in (MAGIC, head.tobytes(), ids.tobytes(), n.tobytes(), control, data):
            self.file.write(part)
        self.texts, self.ids = self.texts + len(n), self.ids + int(n.sum())

    def finish(self) -> pa.RecordBatch:
        size, name = self.file.finish(), self.file.path.rsplit("/", 1)[1]
        row = (name, self.first, self.texts, self.ids, size)
        kinds = (pa.string(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays(
            [pa.array([x], kind) for x, kind in zip(row, kinds)],
            names=["file", "first_id", "n_texts", "n_ids", "n_bytes"],
        )


def write_tokens(
    docs: DataFrame, path: str, end: int, folder: str, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the ids of all texts to ``folder``, texts in ascending order of ``id``.

    Each text ends with the id ``end``. Null texts are empty; rows with a null
    id come first, rows that share an id follow each other by a hash of their text, so
    that many such rows are several tasks' and several files' share. Files follow each
    other by name. An empty table has no files. Other columns are not read. Texts are
    encoded twice, to count the ids and to write them; that costs less than keeping them.
    Returns one row per file: file, first_id, n_texts, n_ids, n_bytes. The
    ranking lies beside the files as ``ranks.bin`` (little-endian uint32).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    ids = rank_table(token_counts(docs, path, end))
    table = NewFile(folder, "ranks.bin")
    table.write(ids.tobytes())
    table.finish()
    rank = np.zeros(int(ids.max(initial=end)) + 1, "<u4")
    rank[ids] = np.arange(len(ids), dtype="<u4")
    shared = spark.sparkContext.broadcast(rank)  # vocabulary size x 4 bytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ranks, out = encoder(path), shared.value, None
        for batch in batches:
            start, total, sizes, control, data = 0, 0, [], [], []
            for i, found in enumerate(encode(batch.column(1))):
                c, d = pack(np.append(ranks[found], ranks[end]))
                sizes.append(len(found) + 1)
                control.append(c)
                data.append(d)
                total += sizes[-1]
                if total >= BLOCK_IDS or i == batch.num_rows - 1:
                    out = out or _TokenFile(folder, TaskContext.get().partitionId())
                    out.write(batch.column(0).slice(start, i + 1 - start), sizes, control, data)
                    start, total, sizes, control, data = i + 1, 0, [], [], []
        if out is not None:
            yield out.finish()

    # ranges from ids and hashes before any text is encoded
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("id"), F.col("hash")]
    laid = docs.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(
        laid.select("id", "text").mapInArrow(write, "file string, first_id bigint, n_texts bigint, n_ids bigint, n_bytes bigint"),
        "token-files",
    )


def _blocks(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    store, name = at(path)
    with store.open_input_stream(name) as f:
        while head := f.read(len(MAGIC) + 48):
            if head[: len(MAGIC)] != MAGIC:
                raise ValueError(f"{path} is not a token file")
            texts, ids, control, data, nulls, _ = np.frombuffer(head, "<i8", offset=len(MAGIC))
            names = np.frombuffer(f.read(8 * texts), "<i8")
            sizes = np.frombuffer(f.read(8 * texts), "<i8")
            missing = np.arange(texts) < nulls  # nulls come first
            yield names, missing, sizes, (
                np.frombuffer(f.read(control), np.uint8),
                np.frombuffer(f.read(data), np.uint8),
            )


def read_plan(files: DataFrame) -> DataFrame:
    """file, start: each file in a partition of about its own, with the number of ids before it.

    The number is given: Spark sees only the bytes of the names and would merge all into one task.
    """
    order = Window.orderBy("file")  # one row per file
    started = files.withColumn("start", F.sum("n_ids").over(order) - F.col("n_ids"))
    return started.select("file", "start").repartition(max(1, files.count()))


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """id, start, n_tokens, ids (array<int>), ids_crc32 of each text, read from the files.

    ``start`` counts the ids of all texts before it in the order of the files.
    Tasks read whole files; a file holds one task's share of the texts.
    """
    files = read_plan(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = at(folder)
        with store.open_input_stream(f"{root}/ranks.bin") as f:
            table = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for names, missing, sizes, coded in _blocks(f"{folder}/{file}"):
                    yield _decoded(table, names, missing, sizes, coded, start)
                    start += int(sizes.sum())

    return files.mapInArrow(
        read, "id bigint, start bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint"
    )


def _decoded(table, names, missing, sizes, coded, start) -> pa.RecordBatch:
    ids, ends = table[unpack(*coded, sizes)].astype("<u4"), np.cumsum(sizes)
    raw = ids.tobytes()
    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int64(), mask=missing), pa.array(start + ends - sizes), pa.array(sizes, pa.int64()), lists, pa.array(crc, pa.int64())],
        names=["id", "start", "n_tokens", "ids", "ids_crc32"],
    )


def token_digest(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Write ``docs`` as token files, read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = new_path(docs.sparkSession, "tokens")
    files = write_tokens(docs, path, end, folder)
    return read_tokens(files, folder).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )
