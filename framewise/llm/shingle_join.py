"""Jaccard join of documents on word shingles over trees of count vectors.

A document is its set of hashed five-word shingles. The shingles are dealt to
``GROUPS`` groups by their hash, and the numbers per group are a point. The
overlap of two sets is at most the sum over groups of the smaller number, and the
overlap with any set below a tree node at most the same sum with the node's upper
corner; both bounds drop pairs that can't be similar enough, and what
survives is verified on the sets themselves.

How this spreads over a cluster without losing a link:

* Two similar sets share one of the smallest hashes of each (how many follows from
  size and threshold). A document that has too few hashes in common with any
  other leaves early; counting that moves 12 bytes a hash and no text.
* Documents with equal sets are one point.
* Points that share the least hash under one of three orders meet first, each in
  a tree; links found there are verified at once, and only as many as
  connect the points leave the task. Where more than ``BLOCK`` share a hash, blocks of
  them meet a few points that stand in all blocks, so this step is linear in the points.
* Then the points meet by the hashes that similar sets must share: the first of each set,
  those last that ``HOT`` or more have there. Only points of different
  components meet, a pair counts only at its first common hash, and
  only if no bound on its counts forbids it. So a group of many copies, or a passage that many texts share, costs each
  text a few comparisons, and still no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forget, repeats, row_key, stored
from .scan import LOWER, batch_bytes, mix, slices, span_hashes, words

WORDS = 5
GROUPS = 64
LEAF = 16
#: Points of one hash that one task compares; more are dealt to several tasks.
BLOCK = 4096
#: Points that stand in all blocks of a run.
PIVOTS = 32
#: A hash that so many points share stands behind all others.
HOT = 4
#: Orders of the hashes whose least hash brings points together first.
RUNS = 3
#: A point's prefix or hashes take the place of so many small rows when tasks are sized.
WIDE = 8
_FULL = 0xFF
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each set begins.

    A-Z count as a-z; words are runs without ASCII white space. A text with
    fewer words is one shingle, one without words none.
    """
    lowered = LOWER[data]
    starts, ends, first = words(lowered, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = span_hashes(lowered, starts, ends)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(word)) - np.repeat(first[:-1], n)
    size = np.minimum(width, n)[text]
    begin = np.flatnonzero(place <= n[text] - size)
    total = np.zeros(len(begin), np.uint64)
    for k in range(width):
        there = k < size[begin]
        part = word[np.minimum(begin + k, len(word) - 1)] * _ODD[k % 5] + np.uint64(k // 5)
        total = mix(total + np.where(there, part, np.uint64(k)))
    of = text[begin]
    order = np.lexsort((total, of))
    total, of = total[order], of[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
    total, of = total[new], of[new]
    return total, np.searchsorted(of, np.arange(len(n) + 1))


def _needed(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Overlap that a set of ``n`` has at least with any similar set: the threshold's share of it."""
    return -(-n * share[0] // share[1])


def _batch_sets(column: pa.Array, width: int):
    data, at = batch_bytes(column)
    for a, b in slices(at):
        hashes, first = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], width)
        yield a, hashes, first


def _census(docs: DataFrame, share: tuple[int, int], width: int) -> DataFrame:
    """key, doc_id, n, copies, credit per row (and stretch of its repeats): credit below 0 means similar to no other row.

    Of a set's smallest hashes, (those that may be lacking) + a tenth of the
    set are looked at; a similar set has the tenth (of the smaller set) too.
    """
    buckets = 64 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "bucket int, key bigint, doc_id bigint, n bigint, credit bigint, hashes binary, keys binary"
    names = [k.split()[0] for k in kinds.split(", ")]

    def rows(bucket=None, key=None, doc_id=None, n=None, credit=None, hashes=None, keys=None):
        given = {"bucket": bucket, "key": key, "doc_id": doc_id, "n": n, "credit": credit, "hashes": hashes, "keys": keys}
        size = next(len(v) for v in given.values() if v is not None)
        types = [pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
        columns = [pa.nulls(size, t) if given[k] is None else pa.array(given[k], t) for k, t in zip(names, types)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            sizes, hashes, owners = np.zeros(len(key), np.int64), [], []
            for a, found, first in _batch_sets(batch.column(2), width):
                n = np.diff(first)
                sizes[a : a + len(n)] = n
                look = n - _needed(n, share) + -(-n // 10)
                place = np.arange(len(found)) - np.repeat(first[:-1], n)
                use = place < np.repeat(look, n)
                hashes.append(found[use])
                owners.append(np.repeat(key[a : a + len(n)], n)[use])
            # a similar set may be smaller, and so may its tenth
            need = -(-_needed(sizes, share) // 10)
            full = sizes > 0
            yield rows(bucket=np.full(len(key), -1), key=key, doc_id=batch.column(1), n=sizes, credit=np.where(full, -need, -1))
            if not hashes:
                continue
            hashes, owners = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(hashes, kind="stable")
            hashes, owners = hashes[order], owners[order]
            begin = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, int)
            nth = np.arange(len(hashes)) - np.repeat(begin, np.diff(np.append(begin, len(hashes))))
            # of a hash that many rows here have, two go on; the others need no more proof
            proven = nth >= 2
            if proven.any():
                who, times = np.unique(owners[proven], return_counts=True)
                yield rows(bucket=np.full(len(who), -1), key=who, credit=times)
            hashes, owners = hashes[~proven], owners[~proven]
            bucket = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
            ends = [*edge[1:], len(bucket)] if len(bucket) else []
            low = (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
            yield rows(
                bucket=bucket[edge].astype(np.int32) if len(bucket) else [],
                hashes=[low[a:b].tobytes() for a, b in zip(edge, ends)],
                keys=[owners[a:b].astype("<i8").tobytes() for a, b in zip(edge, ends)],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, hashes, keys = None, [], []

        def shared():
            h = np.frombuffer(b"".join(hashes), "<u4")
            k = np.frombuffer(b"".join(keys), "<i8")
            order = np.argsort(h, kind="stable")
            h, k = h[order], k[order]
            same = h[1:] == h[:-1]
            many = np.append(same, False) | np.append(False, same)
            who, times = np.unique(k[many], return_counts=True)
            return rows(bucket=np.full(len(who), -1), key=who, credit=times)

        for batch in batches:
            where = batch.column(0).to_numpy()
            plain = np.flatnonzero(where < 0)
            if len(plain):
                yield batch.take(pa.array(plain))
            for i in np.flatnonzero(where >= 0).tolist():
                if where[i] != bucket:
                    if hashes:
                        yield shared()
                    bucket, hashes, keys = where[i], [], []
                hashes.append(batch.column(5)[i].as_py())
                keys.append(batch.column(6)[i].as_py())
        if hashes:
            yield shared()

    dealt = docs.select("key", "doc_id", "text").mapInArrow(deal, kinds)
    # rows without a bucket are sums and sizes of rows; they go by their key
    dealt = dealt.repartition(F.when(F.col("bucket") < 0, F.col("key")).otherwise(F.col("bucket").cast("bigint")))
    met = dealt.sortWithinPartitions("bucket").mapInArrow(meet, kinds)
    met = stored(met.select("key", "doc_id", "n", "credit"), "credits")
    # keys are hashes: rows whose keys agree by chance share what speaks for them, so none is lost
    credits = met.filter("n is null").groupBy("key").agg(F.sum("credit").alias("more"))
    own = repeats(met.filter("n is not null"))
    census = own.join(credits, "key", "left").withColumn("credit", F.col("credit") + F.coalesce("more", F.lit(0)))
    return stored(census.select("key", "doc_id", "n", "copies", "credit"), "census", met.count())


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """key, doc_id, n, f1, f2 (fingerprint of the set), runs (its least hash under each of ``RUNS`` orders), hashes, counts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, hashes, first in _batch_sets(batch.column(2), width):
                n = np.diff(first)
                f1, f2, runs = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros((len(n), RUNS), np.int64)
                full = np.flatnonzero(n)
                if len(full):
                    at = first[:-1][full]
                    f1[full] = np.add.reduceat(hashes, at).view(np.int64)
                    f2[full] = np.add.reduceat(mix(hashes ^ _ODD[0]), at).view(np.int64)
                    for k in range(RUNS):
                        order = hashes if k == 0 else mix(hashes ^ _ODD[k])
                        runs[full, k] = np.minimum.reduceat(order, at).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                raw = [_counts(hashes[i:j]).tobytes() for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, len(n)) for k in (0, 1)), pa.array(n), pa.array(f1), pa.array(f2), pa.array(runs.tolist(), pa.list_(pa.int64())), lists, pa.array(raw, pa.binary())],
                    names=["key", "doc_id", "n", "f1", "f2", "runs", "hashes", "counts"],
                )

    return docs.select("key", "doc_id", "text").mapInArrow(
        make, "key bigint, doc_id bigint, n bigint, f1 bigint, f2 bigint, runs array<bigint>, hashes array<bigint>, counts binary"
    )


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall into each group, a byte a group: ``GROUPS`` or more groups, a power of two.

    There are half as many as hashes up to 512 hashes and an eighth of very many. With fewer, sets without a
    common hash would look alike. A count beyond a byte fills all, which bounds nothing.
    """
    bits = max(len(hashes) - 1, 1).bit_length()
    groups = max(GROUPS, min(256, 1 << bits - 1), 1 << max(bits - 3, 0))
    counts = np.bincount((mix(hashes) % np.uint64(groups)).astype(np.int64), minlength=groups)
    return (np.full(groups, _FULL) if counts.max() >= _FULL else counts).astype(np.uint8)


def _folded(raw: bytes, groups: int = GROUPS) -> np.ndarray:
    """Counts over fewer groups: groups are powers of two, so the halves fall together."""
    counts = np.frombuffer(raw, np.uint8)
    if counts[0] == _FULL and (counts == _FULL).all():
        return np.full(groups, 0xFFFF, np.uint16)
    return counts.reshape(-1, groups).sum(0, dtype=np.uint16)


def _points(rows: list[bytes]) -> np.ndarray:
    return np.stack([_folded(x) for x in rows]) if rows else np.zeros((0, GROUPS), np.uint16)


def _bound(a: bytes, b: bytes) -> int:
    """Bound of the overlap of two sets from their counts."""
    groups = min(len(a), len(b))
    return int(np.minimum(_folded(a, groups), _folded(b, groups)).sum(dtype=np.int64))


class CountTree:
    """Points packed into leaves and nodes in order of size and counts; nodes keep upper corner and least size."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes
        self.levels = [(counts, sizes, sizes)]
        while len(self.levels[-1][0]) > LEAF:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, query: np.ndarray, size: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) whose bound lets them be similar."""
        nodes = len(self.levels[-1][0])
        q, x = np.repeat(np.arange(len(query)), nodes), np.tile(np.arange(nodes), len(query))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            keep = np.zeros(len(q), bool)
            for a in range(0, len(q), 1 << 14):
                i, j = q[a : a + (1 << 14)], x[a : a + (1 << 14)]
                least = np.maximum(low[j], _needed(size[i], share))
                bound = np.minimum(query[i], top[j]).sum(1, dtype=np.int64)
                fits = _similar(bound, size[i], least, share) & (least <= high[j])
                keep[a : a + (1 << 14)] = fits
            q, x = q[keep], x[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                q = np.repeat(q, LEAF)
                x = (x[:, None] * LEAF + np.arange(LEAF)).ravel()
                q, x = q[x < below], x[x < below]
        return q, x


def _similar(overlap, a, b, share):
    """overlap / (a + b - overlap) >= share."""
    return overlap * (share[0] + share[1]) >= share[0] * (a + b)


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, cut so that a cell (first three columns) is never divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = [c.to_numpy() for c in batch.columns[:3]]
        same = np.ones(batch.num_rows, bool)
        for c in cell:
            same &= c == c[-1]
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if held and any(held[-1].column(k)[-1].as_py() != cell[k][0] for k in range(3)):
            yield pa.concat_batches(held)
            held = []
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _edges_of(batch: pa.RecordBatch) -> np.ndarray:
    cell = [c.to_numpy() for c in batch.columns[:3]]
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in cell:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


class _Union:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> None:
        low, high = sorted((self.root[a], self.root[b]))
        self.root[self.root == high] = low


def _links_within(runs, which, ids, sizes, counts, hashes, first, share) -> tuple[np.ndarray, np.ndarray]:
    """(least id, id) of the points that verified links connect within one run.

    ``which`` is the order this run belongs to; pairs that share a run of an
    earlier order are looked at there.
    """
    order = np.lexsort((*counts.T[:3], sizes))
    tree = CountTree(counts[order], sizes[order])
    union = _Union(len(ids))

    def verify(q: int, others: np.ndarray) -> None:
        others = others[union.root[others] != union.root[q]]
        if not len(others):
            return
        mine = hashes[first[q] : first[q + 1]]
        length = first[others + 1] - first[others]
        ends = np.cumsum(length)
        at = np.repeat(first[others] - (ends - length), length) + np.arange(ends[-1])
        theirs = hashes[at]
        place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        overlap = np.add.reduceat((mine[place] == theirs).astype(np.int64), ends - length)
        for x in others[_similar(overlap, sizes[q], sizes[others], share)].tolist():
            if union.root[x] != union.root[q]:
                union.join(x, q)

    verify(int(order[len(order) // 2]), np.arange(len(ids)))
    kinds, n = np.unique(union.root, return_counts=True)
    ask = np.flatnonzero(union.root != kinds[n.argmax()])
    asked = np.zeros(len(ids), bool)
    asked[ask] = True
    for a in range(0, len(ask), 128):
        some = ask[a : a + 128]
        i, x = tree.search(counts[some], sizes[some], share)
        q, x = some[i], order[x]
        use = (union.root[q] != union.root[x]) & (~asked[x] | (x < q))
        for k in range(which[0]):
            use &= runs[q, k] != runs[x, k]
        q, x = q[use], x[use]
        edge = np.append(np.flatnonzero(np.append(True, q[1:] != q[:-1])), len(q)) if len(q) else [0]
        for c, d in zip(edge[:-1], edge[1:]):
            verify(int(q[c]), x[c:d])
    # stars, so that later rounds over links are few
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, union.root, ids)
    least = least[union.root]
    other = least != ids
    return least[other], ids[other]


def _shared_runs(points: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """id, nth, run, m of the runs that ``m`` > 1 points share; the points with runs of more than ``BLOCK`` made different.

    So points share a run in the second table only if ``_first_links`` has seen them together.
    """
    runs = points.select("id", F.posexplode("runs").alias("nth", "run"))
    sizes = stored(runs.groupBy("nth", "run").agg(F.count("*").alias("m")).filter("m > 1"), "run-sizes", RUNS * size)
    wide = runs.join(sizes.filter(F.col("m") > BLOCK), ["nth", "run"]).groupBy("id").agg(F.collect_list("nth").alias("wide"))
    own = F.transform("runs", lambda r, k: F.when(F.array_contains("wide", k), F.xxhash64("id", k)).otherwise(r))
    own = F.when(F.col("wide").isNull(), F.col("runs")).otherwise(own)
    return runs.join(sizes, ["nth", "run"]), points.join(wide, "id", "left").withColumn("runs", own).drop("wide")


def _first_links(points: DataFrame, runs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Verified links among ``points`` that share the least hash under one of the orders.

    All pairs of a run are looked at, except that a run of more than ``BLOCK`` points is
    dealt to blocks of about as many, which have about ``PIVOTS`` points in common.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    pivot = (F.col("m") > BLOCK) & (F.pmod(F.xxhash64("id", F.lit("pivot")), F.col("m")) < PIVOTS)
    own = F.array(F.pmod(F.xxhash64("id"), blocks).cast("int"))
    cells = runs.withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(own)))
    laid = cells.join(points, "id").select("run", "nth", "block", "id", "n", "runs", "counts", "hashes")
    laid = laid.repartition("run", "nth", "block").sortWithinPartitions("run", "nth", "block")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_cell(batches):
            edges, nth = _edges_of(batch), batch.column(1).to_numpy()
            ids, sizes, counts = batch.column(3).to_numpy(), batch.column(4).to_numpy(), _points(batch.column(6).to_pylist())
            runs = batch.column(5).flatten().to_numpy().reshape(-1, RUNS)
            hashes = batch.column(7).flatten().to_numpy().view(np.uint64)
            first = np.append(0, np.cumsum(pa.compute.list_value_length(batch.column(7)).to_numpy()))
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1:
                    own = first[a : b + 1] - first[a]
                    out.append(_links_within(runs[a:b], nth[a:b], ids[a:b], sizes[a:b], counts[a:b], hashes[first[a] : first[b]], own, share))
            if out:
                yield _pairs(np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]))

    return laid.mapInArrow(find, "a bigint, b bigint").distinct()


def _openness(batch: pa.RecordBatch, share: tuple[int, int]):
    """Whether rows i and j may be a new link: of two components, no common run, sizes that fit.

    Columns 3, 5 and 6 are component, size and runs.
    """
    comp, sizes, runs = batch.column(3).to_numpy(), batch.column(5).to_numpy(), batch.column(6).flatten().to_numpy().reshape(-1, RUNS)

    def open_(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = (comp[i] != comp[j]) & _similar(np.minimum(sizes[i], sizes[j]), sizes[i], sizes[j], share)
        for k in range(RUNS):
            out &= runs[i, k] != runs[j, k]
        return out

    return open_


def _small_pairs(m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within cells of ``m`` rows, small ones only, by the distance of the two."""
    cell = np.repeat(np.arange(len(m)), m)
    small = np.flatnonzero((m <= 2 * LEAF)[cell])
    for d in range(1, 2 * LEAF):
        i, j = small[:-d], small[d:]
        use = cell[i] == cell[j]
        if not use.any():
            return
        yield i[use], j[use]


def _askers(comp: np.ndarray) -> np.ndarray:
    """Places of the points that are not of the largest component: it needn't ask."""
    _, at, n = np.unique(comp, return_inverse=True, return_counts=True)
    return np.flatnonzero(at != n.argmax())


def _prefixes(points: DataFrame, names: DataFrame, share: tuple[int, int], size: int) -> DataFrame:
    """id, comp, n, runs, counts, prefix: the hashes of which a similar set must have one.

    Hashes are in one order for all sets, by size and those last that ``HOT`` or more sets have
    among the first by size.
    """
    few = (F.col("n") - F.ceil(F.col("n") * share[0] / share[1]) + 1).cast("int")
    sets = points.select("id", "hashes", few.alias("few"), F.slice("hashes", F.lit(1), 2 * few).alias("look"))
    hot = sets.select(F.explode(F.slice("hashes", F.lit(1), F.col("few"))).alias("key")).groupBy("key").agg(F.count("*").alias("m"))
    hot = stored(hot.filter(F.col("m") >= HOT).select("key"), "hot-hashes", WIDE * size)

    def held(which: DataFrame, where: str) -> DataFrame:
        own = which.select("id", F.explode(where).alias("key")).join(hot, "key").groupBy("id")
        return which.join(own.agg(F.collect_list("key").alias("hot")), "id", "left")

    def ordered(where: str) -> Column:
        many = F.coalesce("hot", F.array().cast("array<bigint>"))
        return F.concat(F.array_except(where, many), F.array_intersect(where, many))

    # twice as many hashes as needed are enough for most sets; all hashes of the others are looked at
    near = held(sets, "look")
    cold = F.size("look") - F.coalesce(F.size("hot"), F.lit(0))
    enough = (cold >= F.col("few")) | (F.size("look") == F.size("hashes"))
    prefix = F.when(enough, F.slice(ordered("look"), F.lit(1), F.col("few"))).alias("prefix")
    near = stored(near.select("id", "few", prefix), "prefixes", WIDE * size)
    rest = sets.join(near.filter("prefix is null").select("id"), "id", "left_semi")
    rest = held(rest, "hashes").select("id", F.slice(ordered("hashes"), F.lit(1), F.col("few")).alias("prefix"))
    all_ = near.filter("prefix is not null").select("id", "prefix").unionByName(rest)
    out = points.select("id", "n", "runs", "counts").join(all_, "id").join(names, F.col("id") == F.col("node"), "left")
    return out.select("id", F.coalesce("component", "id").alias("comp"), "n", "runs", "counts", "prefix")


def _other_pairs(prefixes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b: all pairs that may still link two components, each found at its first common hash.

    They share no run of ``_first_links``, and the bound by counts lets them be similar. Of a hash
    that more than ``BLOCK`` points share, those outside the largest component ask all, block by block.
    """
    keys = prefixes.select("id", "comp", F.posexplode("prefix").alias("pos", "key"))
    sizes = keys.groupBy("key", "comp").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("key").agg(
        F.sum("m").alias("m"), F.count("*").alias("comps"), F.max_by("comp", F.struct("m", "comp")).alias("top"), F.max("m").alias("most")
    ).filter("comps > 1")
    few = F.col("m") <= BLOCK
    sizes = sizes.select(
        "key",
        "top",
        F.when(few, 1).otherwise(F.ceil((F.col("m") - F.col("most")) / BLOCK)).cast("int").alias("asks"),
        F.when(few, 1).otherwise(F.ceil(F.col("m") / BLOCK)).cast("int").alias("all"),
    )
    cells = keys.join(sizes, "key")
    place = F.xxhash64("id")
    own_ask, own_all = F.pmod(place, F.col("asks")).cast("int"), F.pmod(place, F.col("all")).cast("int")
    asked = F.transform(F.sequence(F.lit(0), F.col("asks") - 1), lambda k: F.struct(k.alias("a"), own_all.alias("b")))
    asking = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda k: F.struct(own_ask.alias("a"), k.alias("b")))
    cell = F.when(F.col("comp") == F.col("top"), asked).otherwise(F.array_distinct(F.concat(asked, asking)))
    cells = cells.select("id", "key", "pos", F.explode(cell).alias("cell"))
    cells = cells.select("id", "key", "pos", F.col("cell.a").alias("cell_a"), F.col("cell.b").alias("cell_b"))
    cell = ["key", "cell_a", "cell_b"]

    def laid_out(rows: DataFrame, *more: str | Column) -> DataFrame:
        rows = rows.join(prefixes, "id").select(*cell, "comp", "id", "n", "runs", *more)
        return rows.repartition(*cell).sortWithinPartitions(*cell)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have a partner in their cell, as far as sizes and runs say."""
        for batch in _by_cell(batches):
            edges, open_ = _edges_of(batch), _openness(batch, share)
            m, keep = np.diff(edges), np.zeros(batch.num_rows, bool)
            for i, j in _small_pairs(m):
                use = open_(i, j)
                keep[i[use]] = keep[j[use]] = True
            for k in np.flatnonzero(m > 2 * LEAF):
                all_ = np.arange(edges[k], edges[k + 1])
                ask = all_[_askers(batch.column(3).to_numpy()[all_])]
                for c in range(0, len(ask), 256):
                    use = open_(ask[c : c + 256, None], all_[None])
                    keep[ask[c : c + 256]] |= use.any(1)
                    keep[all_] |= use.any(0)
            yield batch.select(["id", *cell, "pos"]).filter(pa.array(keep))

    # whole counts and hashes go only where there is a partner at all
    cells = laid_out(cells, "pos").mapInArrow(meet, "id bigint, key bigint, cell_a int, cell_b int, pos int")
    before = F.slice("prefix", F.lit(1), F.col("pos")).alias("before")  # the hashes that precede this one
    laid = laid_out(stored(cells, "cells"), "counts", before)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_cell(batches):
            edges, open_ = _edges_of(batch), _openness(batch, share)
            comp, ids, sizes = (batch.column(k).to_numpy() for k in (3, 4, 5))
            raw = batch.column(7).to_pylist()
            counts, before = _points(raw), batch.column(8).flatten().to_numpy()
            begin = np.append(0, np.cumsum(pa.compute.list_value_length(batch.column(8)).to_numpy()))
            out, m = [np.zeros((2, 0), np.int64)], np.diff(edges)
            for i, j in _small_pairs(m):  # all pairs of all small cells at once
                use = open_(i, j)
                i, j = i[use], j[use]
                use = _similar(np.minimum(counts[i], counts[j]).sum(1, dtype=np.int64), sizes[i], sizes[j], share)
                out.append(np.stack([i[use], j[use]]))
            for k in np.flatnonzero(m > 2 * LEAF):
                a, b = edges[k], edges[k + 1]
                ask = _askers(comp[a:b])
                order = np.lexsort((*counts[a:b].T[:3], sizes[a:b]))
                tree = CountTree(counts[a:b][order], sizes[a:b][order])
                for c in range(0, len(ask), 128):
                    some = ask[c : c + 128]
                    i, j = tree.search(counts[a:b][some], sizes[a:b][some], share)
                    i, j = a + some[i], a + order[j]
                    use = open_(i, j)
                    out.append(np.stack([i[use], j[use]]))
            i, j = np.concatenate(out, 1)
            keep = np.zeros(len(i), bool)
            for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
                if _similar(_bound(raw[x], raw[y]), int(sizes[x]), int(sizes[y]), share):
                    keep[k] = not np.isin(before[begin[x] : begin[x + 1]], before[begin[y] : begin[y + 1]]).any()
            yield _pairs(ids[i[keep]], ids[j[keep]])

    return laid.mapInArrow(find, "a bigint, b bigint").distinct()


def one_of_component(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component, as ``jaccard_components`` found it: one row each."""
    keyed = docs.withColumn("_id", F.col(id).cast("bigint")).withColumn("_key", F.xxhash64(row_key("_id", text)))
    # the different rows; all but one of a component go, and repeats of a row that stays are sought only among those that have any
    rows = found.groupBy("row_hash", "doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    rows = stored(rows.filter("not kept or copies > 1").withColumnsRenamed({"row_hash": "_k", "doc_id": "_d"}), "leaving")
    same = (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d"))
    once = keyed.join(rows.filter("kept"), same, "left_semi").dropDuplicates(["_key", "_id"])
    return keyed.join(rows, same, "left_anti").unionByName(once).drop("_key", "_id")


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs whose sets are similar."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = pairs.join(a, "a").join(b, "b")
    overlap = F.size(F.array_intersect("ha", "hb"))
    return both.filter(_similar(overlap, F.col("na"), F.col("nb"), share)).select("a", "b")


def jaccard_components(
    docs: DataFrame, share: tuple[int, int] = (4, 5), width: int = WORDS, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, row_hash, kept.

    Two documents link when their shingle sets overlap by ``share`` of their
    union or more. The component's id is the smallest doc_id reachable (null if
    none has one). A null or empty text, or one without words, has 0 shingles and links with
    nothing. Every row is a document: rows with a null id or one id and several texts link by their texts like others.
    Of a component the row with the smallest id (null last, then by row_hash, a hash of id and text) is kept;
    equal rows share its decision. Other columns are not read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("key", F.xxhash64(row_key("doc_id", "text")))
    census = _census(rows, share, width)
    near = rows.join(census.filter("credit >= 0").select("key").distinct(), "key", "left_semi")
    # numbered once and stored, so a node is one row and no hash
    sets = stored(_sets(near, width).filter("n > 0").withColumn("id", F.monotonically_increasing_id()), "sets")
    nodes = sets.select("id", "key", "doc_id", "n", "f1", "f2")
    first = nodes.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    same = nodes.join(first, ["n", "f1", "f2"]).select("id", "key", "doc_id", "rep")
    size = sets.count()
    same = stored(same, "equal-sets", size)
    points = sets.join(first.select(F.col("rep").alias("id")), "id", "left_semi")
    points = stored(points.select("id", "n", "runs", "hashes", "counts"), "points", WIDE * size)
    forget(sets)
    runs, points = _shared_runs(points, size)
    names = components(_first_links(points, runs, share), RUNS * size)
    prefixes = stored(_prefixes(points, names, share, size), "prefixes", WIDE * size)
    more = _verified(stored(_other_pairs(prefixes, share), "pairs", WIDE * size), points, share)
    stars = names.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    names = components(stars.unionByName(more), RUNS * size)
    # rows of equal sets have the component of their point
    of_rows = same.join(names, F.col("rep") == F.col("node"), "left")
    of_rows = of_rows.groupBy("key", "doc_id").agg(F.min(F.coalesce("component", "rep")).alias("node"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    named = stored(of_rows, "row-components", size)
    named = named.join(named.groupBy("node").agg(best), "node")
    named = named.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), "best")
    out = census.join(named, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    alone = F.col("best").isNull()
    stays = alone | ((F.col("key") == F.col("best.key")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        F.col("key").alias("row_hash"),
        stays.alias("kept"),
    )
