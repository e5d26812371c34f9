"""Best-fit packing: as few sequences as possible, none longer than a given number of tokens.

All pieces of one length are alike, so the plan is made on the histogram of
lengths (at most ``capacity`` rows) and its size does not grow with the corpus:

* Linear program over configurations (which lengths share a sequence), solved by
  multiplicative weights. A length's price grows while it is covered too little;
  a knapsack dynamic program finds the dearest filling of every capacity, which
  gives for each length the best configuration that holds it. The average of
  the rounds' answers is the fractional solution; the best prices give a lower
  bound on the number of sequences.
* Rounding: whole parts of the fractional solution first. What is left is packed
  by the same program again on what remains, the longest lengths first, or by
  best fit, whichever takes fewer sequences.

Pieces are then dealt to the places of the plan by their rank within a length.
Ranks come from counts per (length, bucket), so that a length which a third of
all pieces share is ranked in many tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder

ROUNDS = 24
#: How fast the price of a length that is covered too little grows.
LEARN = 2.0
#: Configurations this close to the dearest count as dearest too.
SLACK = 0.02
#: Shares in which the pieces of one length are ranked.
BUCKETS = 256
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(
    docs: DataFrame, path: str, end: int, most: int, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The ids of each whole text and ``end``, cut every ``most`` ids.

    doc_id, piece (from 0), start (ids before it), length, ids_crc32. A null or
    empty text has one piece, the end id. Repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            row, start, size, crc = [], [], [], []
            for i, ids in enumerate(encode(batch.column(1))):
                ids = np.append(ids, end).astype("<u4")
                for a in range(0, len(ids), most):
                    part = ids[a : a + most]
                    row.append(i)
                    start.append(a)
                    size.append(len(part))
                    crc.append(zlib.crc32(part))
            start = np.array(start, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array((start // most).astype(np.int32)), pa.array(start), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id).cast("bigint"), text).mapInArrow(cut, PIECES)


def _knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``capacity`` the highest price of lengths that fit, and one of them."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        n = np.searchsorted(lengths, room, "right")
        value = prices[:n] + best[room - lengths[:n]]
        k = int(np.argmax(value))
        best[room], last[room] = value[k], k
    return best, last


def _filling(last: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    found = []
    while (k := last[room]) >= 0:
        found.append(int(k))
        room -= int(lengths[k])
    return found


@dataclass
class Plan:
    """Sequences of like configuration lie together: ``count`` of them from ``first`` on."""

    configurations: list[tuple[tuple[int, ...], int]]  # lengths in order, count
    bound: int  # no packing has fewer sequences

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configurations)


def plan_packing(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Plan:
    """How to pack ``histogram`` (length: how many) into sequences of ``capacity``."""
    if not histogram:
        return Plan([], 0)
    lengths = np.array(sorted(histogram), np.int64)
    if lengths[0] < 1 or lengths[-1] > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    left = np.array([histogram[int(x)] for x in lengths], np.int64)
    volume = -(-int((lengths * left).sum()) // capacity)
    used: dict[tuple[int, ...], int] = {}
    bound, prices, fraction = _fractional(lengths, left, capacity, rounds, volume)

    def take(config: tuple[int, ...], want: int) -> None:
        kinds, each = np.unique(config, return_counts=True)
        n = min(want, int((left[kinds] // each).min()))
        if n > 0:
            left[kinds] -= n * each
            used[config] = used.get(config, 0) + n

    for config, share in sorted(fraction.items(), key=lambda x: (-x[1], x[0])):
        take(config, int(share))
    over, before = left.copy(), dict(used)
    while (left > 0).any():
        have = np.flatnonzero(left)
        best, last = _knapsack(prices[have], lengths[have], capacity)
        for k in have[::-1]:
            if left[k]:
                rest = _filling(last, lengths[have], capacity - int(lengths[k]))
                take(_held(left, lengths, int(k), [int(have[i]) for i in rest], capacity), int(left[k]))
    # the remainder, or all, by best fit alone, if that takes fewer
    for start, remainder in ((before, over), ({}, np.array([histogram[int(x)] for x in lengths], np.int64))):
        other = _best_fit(lengths, remainder, capacity, dict(start))
        if sum(other.values()) < sum(used.values()):
            used = other
    return Plan([(tuple(int(lengths[k]) for k in c), n) for c, n in sorted(used.items())], max(bound, volume))


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int, used: dict) -> dict:
    """Add to ``used`` the configurations that best fit gives, longest lengths first.

    Sequences with equal contents are one entry, so the work depends on the
    lengths and not on how many pieces there are.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, config: tuple[int, ...], n: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((config, n))

    for k in np.flatnonzero(left)[::-1].tolist():
        length, n = int(lengths[k]), int(left[k])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, config, there = capacity, (), n
            else:
                room = rooms[at]
                config, there = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            each = min(room // length, n)
            many = min(there, n // each)
            put(room - each * length, config + (k,) * each, many)
            n -= each * many
            if there > many and config:
                put(room, config, there - many)
    for entries in open_.values():
        for config, n in entries:
            config = tuple(sorted(config, reverse=True))
            used[config] = used.get(config, 0) + n
    return used


def _held(left, lengths, first: int, rest: list[int], capacity: int) -> tuple[int, ...]:
    """``first`` and ``rest`` without what is used up; room that opens goes to the longest that fits."""
    config, spare = [first], left.copy()
    spare[first] -= 1
    for k in rest:
        if spare[k] > 0:
            spare[k] -= 1
            config.append(k)
    room = capacity - int(lengths[config].sum())
    while room > 0:
        fits = np.flatnonzero((spare > 0) & (lengths <= room))
        if not len(fits):
            break
        k = int(fits[-1])
        n = min(int(spare[k]), room // int(lengths[k]))
        spare[k] -= n
        config += [k] * n
        room -= n * int(lengths[k])
    return tuple(sorted(config, reverse=True))


def _fractional(lengths, count, capacity, rounds, volume):
    """Lower bound, prices and the average answer of the rounds."""
    covered = np.zeros(len(lengths))
    prices = best_prices = lengths / capacity
    bound, answer = 0.0, {}
    for t in range(1, rounds + 1):
        best, last = _knapsack(prices, lengths, capacity)
        worth = float((count * prices).sum() / best[capacity])
        if worth > bound:
            bound, best_prices = worth, prices
        value = prices + best[capacity - lengths]
        each = []
        for k in np.flatnonzero(value >= (1 - SLACK) * best[capacity]):
            config = tuple(sorted([int(k), *_filling(last, lengths, capacity - int(lengths[k]))], reverse=True))
            want = max(0.0, t * count[k] / rounds - covered[k])
            each.append((config, want / config.count(int(k))))
        total = sum(n for _, n in each) or 1.0
        scale = min(1.0, max(volume, bound) / rounds / total)
        for config, n in each:
            if n > 0:
                kinds, copies = np.unique(config, return_counts=True)
                covered[kinds] += copies * n * scale
                answer[config] = answer.get(config, 0.0) + n * scale
        prices = lengths / capacity * np.exp(np.clip(LEARN * (t / rounds - covered / count), -3, 3))
    return int(np.ceil(bound - 1e-6)), best_prices, answer


def _places(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, ranks a sequence, first sequence, offset), sorted by length and rank."""
    rows, given, first = [], {}, 0
    for config, n in plan.configurations:
        offset = 0
        for length in sorted(set(config), reverse=True):
            a = config.count(length)
            rows.append((length, given.get(length, 0), a, first, offset))
            given[length] = given.get(length, 0) + a * n
            offset += a * length
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with sequence_id and offset.

    Pieces of a sequence lie without gaps from 0 and fill at most ``capacity``.
    Repeated rows are packed each. Reads ``pieces`` several times: store it first.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan_packing(counts, capacity, rounds))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    before = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = before.withColumn(
        "_before",
        F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
    ).select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    ranked = dealt.withColumn("_rank", rank.cast("bigint")).join(before, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.select(*pieces.columns, "_rank")
    shared = pieces.sparkSession.sparkContext.broadcast(places)  # rounds x capacity configurations at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            length = batch.column(names.index("length")).cast(pa.int64()).to_numpy()
            at = table[np.searchsorted(key, length << 44 | rank, "right") - 1]
            n = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(at[:, 3] + n // at[:, 2]), pa.array(at[:, 4] + n % at[:, 2] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(deal, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, path: str, end: int = 0, capacity: int = 2048, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token pieces of ``docs`` with the sequence and the place there of each."""
    return pack(stored(token_pieces(docs, path, end, capacity, id, text), "pieces"), capacity)
