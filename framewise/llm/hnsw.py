"""Near-duplicate vectors by a navigable small-world graph of cells.

Vectors drawn by hash are the points of a graph, one hierarchy of layers per dimension, and each stands
for a cell: the vectors it is the nearest point of, dealt over shards. A vector walks the graph once; up to
``WALK`` times the points a walk sees it is compared with all points instead, which costs less and misses none, and
the graph then has no links. It asks the cells of the ``beam`` nearest points, and those of all points so near that a neighbour of the
vector can be close to them, so a dense group isn't cut off by the beam. The beam passed an audit:
drawn vectors are compared with all vectors, and beams grow until enough of the neighbours are found, in small
groups and in large ones. Then shards meet in pairs, one task each. Cells and the vectors that ask them
are compared as matrices, and what float32 can't tell from the threshold is verified as a cosine in double precision.

A pair counts where either vector asks the other's cell. A task gives counts and one edge a vector to the
smallest vector it is connected with there, not the pairs; edges are united to components.
Equal vectors are one point with a weight.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import components, new_path, stored
from .files import NewFile, at, removed

#: Fewest shards of the vectors of a dimension; there are more where a shard would pass what follows.
SHARDS = 8
SHARD_VECTORS = 200_000
SHARD_BYTES = 512 << 20  # of a task: 28 bytes a component (two shards, as stored and float32, or Arrow) and 600 a vector
CELL = 128  # vectors that a point of the graph stands for
NODES = 60_000  # most points of a graph, about; cells are larger beyond. Their numbers fit 16 bits
WALK = 16  # points that are compared as matrices in the time a walk takes for each of its links (64 wide, measured)
LINKS = 16  # links a new point makes; a layer keeps twice as many
BEAM = 48  # candidates while building, and the first beam of searches
AUDIT = 1000  # vectors whose neighbours are also found by comparing with all, for each of ``SHARDS``
ENOUGH = 20  # of them with close neighbours, to judge searches by those
FEW = 16  # close neighbours; vectors with more are judged apart
RECALL = 0.97  # share of its close neighbours that a search must find, on average
SLACK = 0.04  # below the threshold, still followed
TOGETHER = 256  # searches in step
ABREAST = 4  # points at most that a search follows at once
PART = 1 << 15  # vectors of a shard whose cells a task finds
TASKS = 512  # at most
NONE = (1 << 16) - 1  # no point, among numbers of points
BLOCK = 1 << 22  # cosines worked out at once


class Layer:
    """Links among some of the points: ``links[i]`` are neighbours of point i, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, links: np.ndarray):
        self.vectors, self.links = vectors, links

    def search(self, asked: np.ndarray, entry: np.ndarray, width: int, floor: float | None = None):
        """The ``width`` best points for each vector, best first: ids (-1: none) and cosines.

        With ``floor`` also (row, point) of all points seen at or above it, followed on
        from each other.
        """
        rows, n = len(asked), len(self.vectors)
        seen = np.full(rows * n, -1, np.int32)
        at = np.arange(rows)
        ids = np.full((rows, width), -1)
        value = np.full((rows, width), -np.inf, np.float32)
        ids[:, 0], value[:, 0] = entry, np.einsum("ij,ij->i", asked, self.vectors[entry])
        done = np.ones((rows, width), bool)
        done[:, 0] = False
        seen[at * n + entry] = 0
        near = [np.stack([at, entry])[:, value[:, 0] >= floor]] if floor is not None else []
        live, taken = at, max(1, min(width // ABREAST, ABREAST))
        while len(live):
            left = np.where(done[live], -np.inf, value[live])
            best = np.argpartition(-left, taken - 1, axis=1)[:, :taken] if taken > 1 else left.argmax(1)[:, None]
            go = np.take_along_axis(left, best, 1) > -np.inf
            going = go.any(1)
            live, best, go = live[going], best[going], go[going]
            if not len(live):
                break
            done[live[:, None], best] = True
            next_ = np.where(go[:, :, None], self.links[ids[live[:, None], best]], -1).reshape(len(live), -1)
            # a point is new once: of its places among all the links taken, the one that is written last
            key = next_ + (live * n)[:, None]
            place = np.flatnonzero((next_ >= 0) & (np.take(seen, key, mode="clip") < 0))
            key = np.take(key, place)
            seen[key] = place
            one = np.take(seen, key) == place
            place = place[one]
            row, point = place // next_.shape[1], np.take(next_, place)
            found = np.einsum("ij,ij->i", np.take(asked, np.take(live, row), axis=0), np.take(self.vectors, point, axis=0))
            if floor is not None:
                close = found >= floor
                near.append(np.stack([live[row[close]], point[close]]))
            cosine = np.full(next_.shape, -np.inf, np.float32)
            cosine.ravel()[place] = found
            all_ids = np.concatenate([ids[live], next_], 1)
            all_value = np.concatenate([value[live], cosine], 1)
            all_done = np.concatenate([done[live], cosine == -np.inf], 1)
            top = np.argpartition(-all_value, width - 1, axis=1)[:, :width]
            value[live] = np.take_along_axis(all_value, top, 1)
            ids[live] = np.where(value[live] > -np.inf, np.take_along_axis(all_ids, top, 1), -1)
            done[live] = np.take_along_axis(all_done, top, 1)
        order = np.argsort(-value, axis=1)
        ids, value = np.take_along_axis(ids, order, 1), np.take_along_axis(value, order, 1)
        if floor is None:
            return ids, value
        found, front = near, np.concatenate(near, 1)
        while front.shape[1]:
            grown = []
            for a in range(0, front.shape[1], 1 << 12):
                row, point = front[:, a : a + (1 << 12)]
                next_ = self.links[point]
                row = np.repeat(row, next_.shape[1])
                next_ = next_.ravel()
                row, next_ = row[next_ >= 0], next_[next_ >= 0]
                pair = np.unique(row * n + next_)
                row, next_ = pair // n, pair % n
                new = seen[pair] < 0
                row, next_ = row[new], next_[new]
                seen[pair[new]] = 0
                good = np.einsum("ij,ij->i", asked[row], self.vectors[next_]) >= floor
                grown.append(np.stack([row[good], next_[good]]))
            front = np.concatenate(grown, 1)
            found.append(front)
        return ids, value, np.concatenate(found, 1)


def _diverse(base: np.ndarray, ids: np.ndarray, value: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (best first), those nearer to the point than to any chosen before; then the best others."""
    points = vectors[np.maximum(ids, 0)]
    between = np.einsum("ikd,ijd->ikj", points, points)
    chosen = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        blocked = (chosen[:, :k] & (between[:, k, :k] > value[:, k : k + 1])).any(1)
        chosen[:, k] = (ids[:, k] >= 0) & ~blocked & (chosen.sum(1) < most)
    rank = np.argsort(np.where(chosen, 0, 1) + (ids < 0) * 2, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, rank, 1)


def _insert(layer: Layer, new: np.ndarray, entry: np.ndarray, beam: int) -> None:
    vectors, links = layer.vectors, layer.links
    ids, value = layer.search(vectors[new], entry, beam)
    # points that come together also see each other
    among = vectors[new] @ vectors[new].T
    np.fill_diagonal(among, -np.inf)
    k = min(LINKS, len(new) - 1)
    if k > 0:
        other = np.argpartition(-among, k - 1, axis=1)[:, :k]
        ids = np.concatenate([ids, new[other]], 1)
        value = np.concatenate([value, np.take_along_axis(among, other, 1)], 1)
        order = np.argsort(-value, axis=1)[:, :beam]
        ids, value = np.take_along_axis(ids, order, 1), np.take_along_axis(value, order, 1)
    chosen = _diverse(new, ids, value, vectors, LINKS)
    links[new, : chosen.shape[1]] = chosen
    a, b = np.repeat(new, chosen.shape[1]), chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    start = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    size = np.diff(np.append(start, len(b)))
    widest = int(size.max(initial=0))
    back = np.full((len(start), widest), -1)
    back[np.repeat(np.arange(len(start)), size), np.arange(len(b)) - np.repeat(start, size)] = a
    nodes = b[start]
    for c in range(0, len(nodes), 64):
        some = nodes[c : c + 64]
        both = np.concatenate([links[some], back[c : c + 64]], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        cosine = np.einsum("ij,ikj->ik", vectors[some], vectors[np.maximum(both, 0)])
        cosine[both < 0] = -np.inf
        order = np.argsort(-cosine, axis=1)[:, : 4 * LINKS]
        both, cosine = np.take_along_axis(both, order, 1), np.take_along_axis(cosine, order, 1)
        kept = _diverse(some, both, cosine, vectors, links.shape[1])
        links[some] = -1
        links[some, : kept.shape[1]] = kept


class Graph:
    """Layers over unit vectors (float32); layer 0 holds all points, each above about a sixteenth.

    Inside, points are in the order of their levels, highest first; ``order`` gives their given places.
    """

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], order: np.ndarray, beam: int = BEAM):
        self.vectors, self.order, self.beam = vectors, order, beam
        self.layers = [Layer(vectors[: len(links)], links) for links in layers]

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 11) -> "Graph":
        n = len(vectors)
        level = np.minimum(np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)), 6).astype(int)
        order = np.argsort(-level, kind="stable")
        vectors = vectors[order]  # members of a layer are its first points
        graph = cls(vectors, [], order)
        for k in range(int(level.max()), -1, -1):
            members, size = int((level >= k).sum()), 1
            layer = Layer(vectors[:members], np.full((members, 2 * LINKS), -1, np.int32))
            while size < members:
                new = np.arange(size, min(size + min(TOGETHER, size), members))
                _insert(layer, new, graph._descend(vectors[new]), BEAM)
                size += len(new)
            graph.layers.insert(0, layer)
        return graph

    def _descend(self, asked: np.ndarray, bottom: int = 0) -> np.ndarray:
        entry = np.zeros(len(asked), np.int64)
        for layer in self.layers[bottom:][::-1]:
            ids, _ = layer.search(asked, entry, 4)
            entry = ids[:, 0]
        return entry

    def within(self, asked: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``asked``, point) with a cosine of about ``floor`` or more."""
        row, point = self._within(asked, floor)
        return row, self.order[point]

    @staticmethod
    def walked(points: int, beam: int) -> bool:
        """Whether a walk over so many points costs less than comparing with all, which misses none."""
        return points > WALK * beam * 2 * LINKS

    def best(self, asked: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the ``beam`` nearest points, best first (-1: none), and (row, point) of others at ``floor`` or above."""
        n, ids, more = len(self.vectors), [np.zeros((0, self.beam), np.int64)], [np.zeros((2, 0), np.int64)]
        walk = self.walked(n, self.beam)
        together = max(1, min(TOGETHER, (1 << 25) // n) if walk else BLOCK // n)
        for a in range(0, len(asked), together):
            some = asked[a : a + together]
            if walk:
                top, _, found = self.layers[0].search(some, self._descend(some, 1), self.beam, floor)
                found = found[:, ~(top[found[0]] == found[1][:, None]).any(1)]
            else:
                cosine = some @ self.vectors.T
                top = np.argpartition(-cosine, self.beam - 1, axis=1)[:, : self.beam]
                value = np.take_along_axis(cosine, top, 1)
                top = np.take_along_axis(top, np.argsort(-value, axis=1), 1)
                np.put_along_axis(cosine, top, -np.inf, 1)
                found = np.stack(np.nonzero(cosine >= floor))
            ids.append(top)
            more.append(found + np.array([[a], [0]]))
        return np.concatenate(ids), np.concatenate(more, 1)

    def _within(self, asked: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        if self.beam >= len(self.vectors):
            return np.nonzero(asked @ self.vectors.T >= floor)
        out = [np.zeros((2, 0), np.int64)]
        together = max(1, min(TOGETHER, (1 << 25) // len(self.vectors)))
        for a in range(0, len(asked), together):
            some = asked[a : a + together]
            _, _, found = self.layers[0].search(some, self._descend(some, 1), self.beam, floor)
            out.append(found + np.array([[a], [0]]))
        return tuple(np.concatenate(out, 1))

    def audit(self, threshold: float, slack: float = SLACK, others: np.ndarray | None = None) -> float:
        """Widen the beam until searches find ``RECALL`` of the neighbours that a full comparison finds.

        Asked are points of the graph and ``others``, unit vectors that are not in it. Each with close
        neighbours counts once, whatever their number. The recall is the worst of these: vectors
        with few and with many close neighbours, points and others.
        """
        n = len(self.vectors)
        pick = np.unique(np.linspace(0, n - 1, min(n, AUDIT)).astype(int))
        asked = self.vectors[pick]
        if others is not None:
            asked = np.concatenate([asked, others])
        own = np.arange(len(asked)) < len(pick)
        close, best, nearest = np.zeros(len(asked), np.int64), np.full(len(asked), -np.inf, np.float32), np.zeros(len(asked), np.int64)
        for a in range(0, n, 4096):
            cosine = asked @ self.vectors[a : a + 4096].T
            inside = np.flatnonzero((pick >= a) & (pick < a + 4096))
            cosine[inside, pick[inside] - a] = -np.inf
            close += (cosine >= threshold).sum(1)
            top = cosine.argmax(1)
            value = cosine[np.arange(len(asked)), top]
            nearest[value > best] = a + top[value > best]
            best = np.maximum(best, value)
        few = (close > 0) & (close <= FEW)
        many = close > FEW
        judged = [x for x in (many & own, many & ~own) if x.any()]
        parts = [few & own, few & ~own]
        judged += parts if min(x.sum() for x in parts) >= ENOUGH else [few] if few.any() else []
        # too few with close neighbours outside large groups: there the nearest must be found, however far
        far = np.flatnonzero(~many) if few.sum() < ENOUGH else np.zeros(0, np.int64)
        with_close = np.flatnonzero(close)
        while self.beam < n:
            found = np.zeros(len(asked), np.int64)
            for a in range(0, len(with_close), 64):
                some = with_close[a : a + 64]
                row, point = self._within(asked[some], threshold - slack)
                self_found = own[some[row]] & (pick[np.minimum(some[row], len(pick) - 1)] == point)
                row, point = row[~self_found], point[~self_found]
                for c in range(0, len(row), 1 << 16):
                    r, x = some[row[c : c + (1 << 16)]], point[c : c + (1 << 16)]
                    good = np.einsum("ij,ij->i", asked[r], self.vectors[x]) >= threshold - 1e-6  # as exact as float32
                    found += np.bincount(r[good], minlength=len(asked))
            share = np.minimum(found / np.maximum(close, 1), 1)
            recall = min((float(share[x].mean()) for x in judged), default=1.0)
            if len(far) and recall >= RECALL:
                hit = 0
                for a in range(0, len(far), TOGETHER):
                    some = far[a : a + TOGETHER]
                    ids, _ = self.layers[0].search(asked[some], self._descend(asked[some], 1), self.beam)
                    hit += int((ids == nearest[some, None]).any(1).sum())
                recall = min(recall, hit / len(far))
            if recall >= RECALL:
                return recall
            self.beam *= 2
        self.beam = n  # then all are compared
        return 1.0

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        layers = {f"layer{k}": x.links for k, x in enumerate(self.layers)}
        np.savez(out, vectors=self.vectors, order=self.order, beam=self.beam, **layers)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Graph":
        z = np.load(io.BytesIO(raw))
        layers = [z[f"layer{k}"] for k in range(sum(name.startswith("layer") for name in z.files))]
        return cls(z["vectors"], layers, z["order"], int(z["beam"]))


def _matrix(column: pa.Array, kind: str = "f8") -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _unit(raw: np.ndarray) -> np.ndarray:
    unit = np.empty(raw.shape, np.float32)
    for a in range(0, len(raw), 4096):
        some = raw[a : a + 4096].astype(np.float64)
        unit[a : a + 4096] = some / np.linalg.norm(some, axis=1, keepdims=True)
    return unit


def _read(folder: str, name: str) -> dict[str, np.ndarray]:
    store, root = at(folder)
    with store.open_input_stream(f"{root}/{name}") as f:
        z = np.load(io.BytesIO(f.read()))
        return {k: z[k] for k in z.files}


def _write(folder: str, name: str, **arrays: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    file = NewFile(folder, name)
    file.write(out.getbuffer())
    file.finish()


def _near(threshold: float) -> float:
    """Cosine of twice the angle of a neighbour: of two neighbours, one as near to a point, the other is within it."""
    close = threshold - SLACK
    return 2 * close * close - 1 if close > 0 else -1.0


class Asked:
    """The cells that some vectors ask: those of ``top`` (a row of numbers each, NONE: no more) and each ``cell`` of ``row``."""

    def __init__(self, top: np.ndarray, row: np.ndarray, cell: np.ndarray, cells: int):
        self.top, self.more, self.cells = top, np.sort(row.astype(np.int64) << 16 | cell), cells

    def has(self, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Of each pair, whether the vector asks the cell."""
        found = np.zeros(len(row), bool)
        for a in range(0, len(row), 1 << 14):
            found[a : a + (1 << 14)] = (self.top[row[a : a + (1 << 14)]] == cell[a : a + (1 << 14), None]).any(1)
        if len(self.more):
            key = row.astype(np.int64) << 16 | cell
            found |= self.more[np.minimum(np.searchsorted(self.more, key), len(self.more) - 1)] == key
        return found

    def by_cell(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows that ask, cell after cell, and where each cell's begin."""
        cell = np.concatenate([self.top.ravel(), (self.more & NONE).astype(np.uint16)])
        row = np.repeat(np.arange(len(self.top), dtype=np.int32), self.top.shape[1])
        row = np.concatenate([row, (self.more >> 16).astype(np.int32)])
        order = np.argsort(cell, kind="stable")  # 16 bits: by counting
        return row[order], np.searchsorted(cell[order], np.arange(self.cells + 1))


class Shard:
    """Vectors of a shard in the order of their cells, and the cells they ask (None: all are compared with all)."""

    def __init__(self, folder: str, dim: int, shard: int, beam: int, nodes: int):
        z = _read(folder, f"shard-{dim}-{shard}.npz")
        self.ids, self.weight, self.raw, self.asked = z.pop("ids"), z.pop("weight"), z.pop("raw"), None
        if beam < nodes:
            asked = _asked(folder, [f"asked-{dim}-{shard}-{beam}-{a}.npz" for a in range(0, len(self.ids), PART)], nodes)
            home = asked.top[:, 0]
            order = np.argsort(home, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.ids, self.weight, self.raw, self.home = self.ids[order], self.weight[order], self.raw[order], home[order]
            self.start = np.searchsorted(self.home, np.arange(nodes + 1))
            self.asked = Asked(asked.top[order], place[asked.more >> 16], asked.more & NONE, nodes)
            self.row, self.at = self.asked.by_cell()
        self.unit = _unit(self.raw)

    def find(self, other: "Shard", threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(vector, vector of ``other``) whose cosine is ``threshold`` or more, of the cells that the first asks."""
        margin = max(1e-4, self.raw.shape[1] * 2.0**-22)  # more than float32 can be wrong by
        for mine, lo, hi in self._meet(other):
            for a in range(0, len(mine), 2048):
                some = mine[a : a + 2048]
                left = self.unit[some]
                for b in range(lo, hi, 512):
                    cosine = left @ other.unit[b : min(hi, b + 512)].T
                    if cosine.max() < threshold - margin:
                        continue
                    x, y = np.nonzero(cosine >= threshold - margin)
                    unsure = np.flatnonzero(cosine[x, y] < threshold + margin)
                    x, y = some[x], b + y
                    good = np.ones(len(x), bool)
                    for c in range(0, len(unsure), 1 << 14):
                        u = unsure[c : c + (1 << 14)]
                        p, q = self.raw[x[u]].astype(np.float64), other.raw[y[u]].astype(np.float64)
                        exact = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
                        good[u] = exact >= threshold
                    yield x[good], y[good]

    def _meet(self, other: "Shard") -> Iterator[tuple[np.ndarray, int, int]]:
        if self.asked is None:
            yield np.arange(len(self.ids)), 0, len(other.ids)
            return
        for c in np.flatnonzero((self.at[1:] > self.at[:-1]) & (other.start[1:] > other.start[:-1])):
            yield self.row[self.at[c] : self.at[c + 1]], int(other.start[c]), int(other.start[c + 1])


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """``root`` (each one's smallest, of those united so far) with a and b united, pair by pair."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _links(one: Shard, other: Shard | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, how many link with each, and an id that each is connected with: within ``one``, or between it and ``other``."""
    n = len(one.ids)
    ids, weight = (one.ids, one.weight) if other is None else (np.concatenate([one.ids, other.ids]), np.concatenate([one.weight, other.weight]))
    degree, root, waiting, held = np.zeros(len(ids), np.int64), np.arange(len(ids)), [], 0

    def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Vectors, vectors, and whether the pair is not seen from the other side as well."""
        if other is None:
            for x, y in one.find(one, threshold):
                x, y = x[x != y], y[x != y]
                yield x, y, np.zeros(len(x), bool) if one.asked is None else ~one.asked.has(y, one.home[x])
            return
        for x, y in one.find(other, threshold):
            yield x, n + y, np.ones(len(x), bool)
        if one.asked is not None:
            for y, x in other.find(one, threshold):
                new = ~one.asked.has(x, other.home[y])
                yield x[new], n + y[new], np.ones(int(new.sum()), bool)

    def count() -> None:
        x, y, once = (np.concatenate(parts) for parts in zip(*waiting))
        degree[:] += np.bincount(x, weight[y], len(ids)).astype(np.int64)
        degree[:] += np.bincount(y[once], weight[x[once]], len(ids)).astype(np.int64)
        _unite(root, x, y)

    for pairs in found():
        waiting.append(pairs)
        held += len(pairs[0])
        if held >= 1 << 16:
            count()
            waiting, held = [], 0
    if waiting:
        count()
    linked = np.flatnonzero(degree)
    return ids[linked], degree[linked], ids[root[linked]]


def build_graphs(points: DataFrame, folder: str, threshold: float) -> DataFrame:
    """A graph per dimension of ``points`` (id, embedding, dim), with vectors for the audit: dim, nodes, audit, beam, recall."""
    kinds = pa.schema([("dim", pa.int32()), ("nodes", pa.int64()), ("audit", pa.int64()), ("beam", pa.int64()), ("recall", pa.float64())])

    def build(table: pa.Table) -> pa.Table:
        unit = _unit(_matrix(table["embedding"].combine_chunks()))
        ids, node, audit = (table[c].to_numpy() for c in ("id", "node", "audit"))
        dim, n, recall = table["dim"][0].as_py(), int(node.sum()), 1.0
        if Graph.walked(n, BEAM):
            graph = Graph.build(unit[node])
            recall = graph.audit(threshold, others=unit[audit & ~node][:AUDIT])
        else:
            graph = Graph(unit[node], [], np.arange(n))
        raw = np.frombuffer(graph.to_bytes(), np.uint8)
        _write(folder, f"graph-{dim}.npz", graph=raw, ids=ids[audit], unit=unit[audit])
        return pa.table({"dim": [dim], "nodes": [n], "audit": [int(audit.sum())], "beam": [graph.beam], "recall": [recall]}, kinds)

    def drawn(name: str, count: Column) -> Column:
        return F.pmod(F.xxhash64("embedding", F.lit(name)), F.lit(1 << 30)) * F.col("n") < count * F.lit(1 << 30)

    count = points.groupBy("dim").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    nodes = F.least(F.lit(NODES), F.ceil(F.col("n") / CELL)).cast("bigint")
    rows = points.select("id", "embedding", "dim").join(count, "dim")
    rows = rows.withColumns({"node": drawn("node", nodes) | (F.col("id") == F.col("first")), "audit": drawn("audit", F.lit(AUDIT * SHARDS).cast("bigint"))})
    rows = rows.filter("node or audit").select("id", "embedding", "dim", "node", "audit")
    return stored(rows.groupBy("dim").applyInArrow(build, "dim int, nodes bigint, audit bigint, beam bigint, recall double"), "graphs")


def lay_shards(points: DataFrame, folder: str) -> DataFrame:
    """A file per (dim, shard) of ``points`` (id, embedding, weight, dim, shard): dim, shard, rows."""
    kind = "f4" if points.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    kinds = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("rows", pa.int64())])

    def lay(table: pa.Table) -> pa.Table:
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        raw = _matrix(table["embedding"].combine_chunks(), kind)
        _write(folder, f"shard-{dim}-{shard}.npz", ids=table["id"].to_numpy(), weight=table["weight"].to_numpy(), raw=raw)
        return pa.table({"dim": [dim], "shard": [shard], "rows": [len(raw)]}, kinds)

    rows = points.select("id", "embedding", "weight", "dim", "shard")
    return stored(rows.groupBy("dim", "shard").applyInArrow(lay, "dim int, shard int, rows bigint"), "shards")


def each(spark: SparkSession, work: list[tuple], run: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """The rows of ``run(*w)`` for every w of ``work``, up to ``TASKS`` tasks with as many each."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield run(*work[k])

    return spark.range(0, len(work), 1, max(1, min(len(work), TASKS))).mapInArrow(go, schema)


def _cells(folder: str, dim: int, beam: int, unit: np.ndarray, near: float, name: str) -> Asked:
    """Writes the cells that ``unit`` ask, as ``name``."""
    graph = Graph.from_bytes(_read(folder, f"graph-{dim}.npz")["graph"].tobytes())
    graph.beam = beam
    top, more = graph.best(unit, near)
    top = np.where(top < 0, NONE, top).astype(np.uint16)
    _write(folder, name, top=top, more=more.T)
    return Asked(top, *more, len(graph.vectors))


def _asked(folder: str, names: list[str], cells: int) -> Asked:
    parts = [_read(folder, name) for name in names]
    first = np.cumsum([0] + [len(x["top"]) for x in parts])
    row, cell = (np.concatenate([x["more"][:, k] + (0 if k else a) for x, a in zip(parts, first)]) for k in (0, 1))
    return Asked(np.concatenate([x["top"] for x in parts]), row, cell, cells)


def ask_cells(spark: SparkSession, shards: list[Row], graphs: list[Row], folder: str, beams: dict[int, int], threshold: float) -> DataFrame:
    """Writes the cells that the vectors of ``shards`` (dim, shard, rows) and those of the audit ask.

    dim, asked, close, found, best, hit by vector of the audit and part of a shard.
    """
    near = _near(threshold)
    kinds = pa.schema([("dim", pa.int32()), ("asked", pa.int64()), ("close", pa.int64()), ("found", pa.int64()), ("best", pa.float32()), ("hit", pa.bool_())])
    dealt = {x.dim: [f"audit-{x.dim}-{beams[x.dim]}-{a}.npz" for a in range(0, x.audit, AUDIT)] for x in graphs}

    def ready(dim: int, k: int) -> pa.RecordBatch:
        audit = _read(folder, f"graph-{dim}.npz")["unit"][k * AUDIT : (k + 1) * AUDIT]
        asks = _cells(folder, dim, beams[dim], audit, near, dealt[dim][k])
        return pa.RecordBatch.from_arrays([pa.array([len(asks.top)])], names=["rows"])

    def ask(dim: int, shard: int, first: int) -> pa.RecordBatch:
        z = _read(folder, f"shard-{dim}-{shard}.npz")
        ids, unit = z["ids"][first : first + PART], _unit(z["raw"][first : first + PART])
        asks = _cells(folder, dim, beams[dim], unit, near, f"asked-{dim}-{shard}-{beams[dim]}-{first}.npz")
        g, audit_asks, home = _read(folder, f"graph-{dim}.npz"), _asked(folder, dealt[dim], asks.cells), asks.top[:, 0]
        audit_ids, audit, n = g["ids"], g["unit"], len(g["ids"])

        rows, close, found, nearest = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = np.full(n, -np.inf, np.float32)
        here = {x: k for k, x in enumerate(ids.tolist())}
        itself = np.array([here.get(x, -1) for x in audit_ids.tolist()])
        step = max(1, BLOCK // n)
        for a in range(0, len(unit), step):
            cosine = audit @ unit[a : a + step].T
            inside = np.flatnonzero((itself >= a) & (itself < a + step))
            cosine[inside, itself[inside] - a] = -np.inf
            top = cosine.argmax(1)
            value = cosine[rows, top]
            nearest = np.where(value > best, a + top, nearest)
            best = np.maximum(best, value)
            row, point = np.nonzero(cosine >= threshold)
            close += np.bincount(row, minlength=n)
            found += np.bincount(row[audit_asks.has(row, home[a + point])], minlength=n)
        columns = [np.full(n, dim), audit_ids, close, found, best, audit_asks.has(rows, home[nearest])]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds.types)], schema=kinds)

    dims = {x.dim for x in shards}
    each(spark, [(dim, k) for dim in dims for k in range(len(dealt[dim]))], ready, "rows bigint").agg(F.sum("rows")).collect()
    parts = [(x.dim, x.shard, first) for x in shards for first in range(0, x.rows, PART)]
    parts.sort(key=lambda p: p[2])  # the last of a shard is smaller
    return stored(each(spark, parts, ask, "dim int, asked bigint, close bigint, found bigint, best float, hit boolean"), "audit")


def recalls(audit: DataFrame) -> dict[int, float]:
    """Per dimension the worst share of neighbours that vectors find by asking: of those with few and with many close ones.

    Each with close neighbours counts once, whatever their number. What neighbours find from their side isn't counted. Where too few have some outside large groups,
    the nearest must be found as well, however far.
    """
    asked = audit.groupBy("dim", "asked").agg(F.sum("close").alias("close"), F.sum("found").alias("found"), F.max_by("hit", "best").alias("hit"))
    many, few = F.col("close") > FEW, (F.col("close") > 0) & (F.col("close") <= FEW)
    share = F.col("found") / F.col("close")
    sums = asked.groupBy("dim").agg(
        F.avg(F.when(few, share)).alias("few"), F.avg(F.when(many, share)).alias("many"),
        F.avg(F.when(~many, F.col("hit").cast("double"))).alias("far"), F.count_if(few).alias("n"),
    )
    return {r.dim: min([x for x in (r.few, r.many, r.far if r.n < ENOUGH else None) if x is not None], default=1.0) for r in sums.collect()}


def audited(spark: SparkSession, shards: list[Row], graphs: list[Row], folder: str, threshold: float) -> dict[int, tuple[int, int]]:
    """Of each dimension the beam that finds ``RECALL`` of the neighbours, and the points of its graph."""
    nodes, beams = {x.dim: x.nodes for x in graphs}, {x.dim: x.beam for x in graphs}
    poor = set(beams)
    while poor := {dim for dim in poor if beams[dim] < nodes[dim]}:
        recall = recalls(ask_cells(spark, [x for x in shards if x.dim in poor], graphs, folder, beams, threshold))
        poor = {dim for dim in poor if recall.get(dim, 1.0) < RECALL}
        beams |= {dim: 2 * beams[dim] for dim in poor}
    return {dim: (beam, nodes[dim]) for dim, beam in beams.items()}


def linked_points(spark: SparkSession, shards: list[Row], folder: str, beams: dict[int, tuple[int, int]], threshold: float) -> DataFrame:
    """id, degree, other by pairs of shards: how many vectors link with it there, and one it is connected with."""
    kinds = pa.schema([("id", pa.int64()), ("degree", pa.int64()), ("other", pa.int64())])

    held: dict[tuple[int, int], Shard] = {}  # of a task, whose pairs follow each other

    def link(dim: int, shard: int, to: int) -> pa.RecordBatch:
        if (dim, shard) not in held:
            held.clear()
            held[dim, shard] = Shard(folder, dim, shard, *beams[dim])
        one = held[dim, shard]
        other = Shard(folder, dim, to, *beams[dim]) if to != shard else None
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _links(one, other, threshold)], schema=kinds)

    pairs = [(x.dim, x.shard, y.shard) for x in shards for y in shards if x.dim == y.dim and x.shard <= y.shard]
    return each(spark, pairs, link, "id bigint, degree bigint, other bigint")


def with_shards(points: DataFrame, fewest: int = SHARDS) -> DataFrame:
    """``points`` (embedding, dim) with shards, as many as their count needs, and shard."""
    most = F.least(F.lit(SHARD_VECTORS), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (F.col("dim") * 28 + 600))))
    needed = F.greatest(F.lit(fewest), F.ceil(F.count("*") / most)).cast("int").alias("shards")
    count = stored(points.groupBy("dim").agg(needed), "shards")
    return points.join(count, "dim").withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int"))


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.9, shards: int = SHARDS, id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of one dimension link when their cosine is ``threshold`` or more.
    Vectors that are null, empty, zero, or hold a null, NaN or infinite component
    link with nothing, and so do rows with a null id (component null, kept).
    Rows that repeat an id count as vectors of their own. Other columns are not
    read. An empty table gives an empty table.
    """
    spark, kind = vectors.sparkSession, vectors.schema[embedding].dataType
    exact = kind if kind.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(embedding).cast(exact).alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    usable = rows.filter("id is not null").filter(F.col("embedding").isNotNull() & sound & F.exists("embedding", lambda x: x != 0))
    kinds = usable.groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    kinds = kinds.select(F.col("rep").alias("id"), "embedding", "weight", F.size("embedding").alias("dim"))
    points = with_shards(stored(kinds, "vectors"), shards)
    folder = new_path(spark, "graphs")
    graphs = build_graphs(points, folder, threshold).collect()
    laid = lay_shards(points, folder).collect()
    beams = audited(spark, laid, graphs, folder, threshold)
    links = stored(linked_points(spark, laid, folder, beams, threshold), "vector-links")
    if beams:
        removed(folder)
    degree = links.groupBy("id").agg(F.sum("degree").alias("degree"))
    known = points.join(degree, "id", "left").join(components(links.select(F.col("id").alias("a"), F.col("other").alias("b"))), F.col("id") == F.col("node"), "left")
    known = known.select(
        F.xxhash64("embedding").alias("_h"),
        F.col("embedding").alias("_e"),
        (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("links"),
        F.coalesce("component", "id").alias("component"),
    )
    # repeated vectors may be many: look rows up by their vector, hot ones are split by the join. It sorts by the hash first:
    # comparing vectors is most of the sort's work
    out = rows.join(known, (F.xxhash64("embedding") == F.col("_h")) & (F.col("embedding") == F.col("_e")) & F.col("id").isNotNull(), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
