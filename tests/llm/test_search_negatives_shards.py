"""Hard negatives, ranked search and sharding against brute force, with odd rows of every kind."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewise.llm import hard_negatives as H
from framewise.llm import ranked_search as R
from framewise.llm import sharding as S
from framewise.llm.common import new_path

from .fixtures import LONG, documents

VECTORS = "vec_id long, embedding array<double>, label int, anchor long, key string, score long"


def vectors(spark):
    draw = random.Random(8)
    rows = []
    for i in range(420):
        scale = draw.choice([0.1, 1, 1])
        rows.append((i, [draw.choice([-1.0, 0.0, 0.5, 0.25, draw.random()]) * scale for _ in range(6)], draw.choice([1, 1, 1, 2, 3]), 0, "k", 1))
    for i in (50, 51, 52, 60):  # ties: equal vectors
        rows[i] = (i, rows[100][1], rows[i][2], 0, "k", 1)
    rows[200] = (200, [0.0] * 6, 1, 0, "k", 1)  # all scores 0
    rows += [(500, [1.0, 2.0], 1, 0, "k", 1), (501, [3.0, 2.0], 1, 0, "k", 1), (502, [0.7, 2.0], 2, 0, "k", 1)]  # another width
    rows += [(600, [], 1, 0, "k", 1), (601, [], 1, 0, "k", 1), (602, [], 2, 0, "k", 1)]  # no width: scores 0
    rows += [(700, [1e9, 1.0, 1.0], 1, 0, "k", 1), (701, [1e5, -3.0, 1.0], 1, 0, "k", 1), (702, [6e4, 0.0, 2.0], 2, 0, "k", 1)]  # beyond 2^53
    rows += [(703, [1e300, 0.0, 2.0], 2, 0, "k", 1), (704, [-1e300, 0.0, 2.0], 1, 0, "k", 1)]  # beyond 2^63
    odd = [(None, [1.0] * 6, 1), (800, None, 1), (801, [1.0] * 6, None), (900, [None] + [1.0] * 5, 1), (1000, [float("nan")] * 6, 1), (1100, [float("inf")] * 6, 2)]
    rows += [(*o, 0, "k", 1) for o in odd] + [(7, [0.5] * 6, 3, 0, "k", 1), (7, rows[7][1], rows[7][2], 1, "l", 2)]
    return spark.createDataFrame(rows, VECTORS).repartition(5)


def mined(rows, n_positives=5, n_negatives=10, percent=(30, 90)):
    whole = {}
    for r in rows:
        if r.vec_id is None or r.label is None or r.embedding is None or any(x is None or not math.isfinite(x) for x in r.embedding):
            continue
        whole[r.vec_id] = min(whole.get(r.vec_id, (r.label, r.embedding)), (r.label, r.embedding))
    q = {i: (label, [int(v) * 256 if abs(v) >= 2**53 else math.floor(256 * v) for v in e]) for i, (label, e) in whole.items()}
    top = (1 << 63) - 1
    for a in sorted(i for i in q if i % 100 == 0):
        scored = [(-max(-top, min(top, sum(x * y for x, y in zip(q[a][1], v)))), i) for i, (_, v) in q.items() if i != a and len(v) == len(q[a][1])]
        scored.sort()
        for p, pid in [s for s in scored if q[s[1]][0] == q[a][0]][:n_positives]:
            fit = [(s, i) for s, i in scored if q[i][0] != q[a][0] and percent[0] * -p <= 100 * -s <= percent[1] * -p]
            for rank, (s, i) in enumerate(fit[:n_negatives], 1):
                yield a, pid, rank, i, -p, -s


@pytest.mark.parametrize("rows, anchors", [(1 << 16, 1 << 10), (40, 2)])
def test_hard_negatives(spark, monkeypatch, rows, anchors):
    monkeypatch.setattr(H, "ROWS", rows)
    monkeypatch.setattr(H, "ANCHORS", anchors)
    table = vectors(spark)
    expected = sorted(mined(table.collect()))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = H.hard_negatives(table)
    assert found.columns == names
    assert sorted(tuple(r) for r in found.collect()) == expected
    anchors = {e[0] for e in expected}
    assert {0, 100, 200, 500, 600, 700} <= anchors and not anchors & {800, 900, 1000, 1100}
    assert H.hard_negatives(table.limit(0)).count() == 0
    few = sorted(mined(table.collect(), 2, 3, (50, 80)))
    assert sorted(tuple(r) for r in H.hard_negatives(table, positives=2, negatives=3, percent=(50, 80)).collect()) == few


def test_packed_keys_sort_by_anchor_score_kind_and_id():
    draw = random.Random(1)
    rows = [tuple(draw.choice([-(1 << 63) + 1, -5, -1, 0, 1, 7, (1 << 63) - 1]) for _ in range(3)) + (draw.choice([0, 1]),) for _ in range(300)]
    keys = []
    for a, s, i, kind in rows:
        keys += H.packed(*(np.array([x], np.int64) for x in (a, s)), kind, np.array([i], np.int64)).to_pylist()
    order = sorted(range(300), key=lambda k: keys[k])
    assert [(rows[k][0], -rows[k][1], rows[k][3], rows[k][2]) for k in order] == sorted((a, -s, kind, i) for a, s, i, kind in rows)
    back = H.unpacked(pa.array(keys, pa.binary()))
    assert [tuple(x) for x in zip(*(c.tolist() for c in back))] == [(a, s, kind, i) for a, s, i, kind in rows]


def ranked(docs, queries, k=20):
    def terms(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    own = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in own]
    count, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in own for t in c)
    out = []
    for item, text in queries:
        scores = []
        for (doc, _), c, size in zip(docs, own, n):
            m = 75 + (25 * size * count) // max(total, 1)
            score = 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort()
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(scores[:k], 1)]
    return out


QUERIES = [
    (1, "One TWO three"), (2, None), (3, ""), (4, " . , "), (5, "w1 w2 w2 w996 nothing"), (6, "日本 語 ünïcode Ünïcode"), (7, "don't stop"),
    (8, "absent words only"), (9, LONG), (None, "one two"), (1, "One TWO three"), (10, "lost and found again here quite"),
]


@pytest.mark.parametrize("shard, depth", [(1 << 25, 32), (3000, 1)])
def test_ranked_search(spark, monkeypatch, shard, depth):
    monkeypatch.setattr(R, "SHARD_BYTES", shard)
    monkeypatch.setattr(R, "DEPTH", depth)
    monkeypatch.setattr(R, "QUERIES", 4)
    monkeypatch.setattr(R, "TERMS", 300)
    docs = documents(spark)
    words = [(i, " ".join(r.text.split()[:12])) for i, r in enumerate(docs.collect(), 100) if r.text and len(r.text) < 2000]
    queries = QUERIES + words[:25]
    asked = spark.createDataFrame([(*q, 1, "t") for q in queries], "item_id long, text string, query long, term string")
    found = R.ranked_search(docs, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    expected = ranked([(r.doc_id, r.text) for r in docs.collect()], queries)
    assert Counter(tuple(r) for r in found.collect()) == Counter(expected)
    assert R.ranked_search(docs.limit(0), asked).count() == 0
    assert R.ranked_search(docs, asked.limit(0)).count() == 0


def test_best_positions_stop_before_the_end_and_lose_no_tie():
    draw = np.random.default_rng(3)
    size, wide = 20_000, 6
    held = draw.random((size, wide)) < [0.9, 0.5, 0.3, 0.2, 0.05, 0.01]
    docs, terms = np.nonzero(held)
    impact = np.floor(1000 / (1 + draw.pareto(1.0, len(docs)))).astype(np.int64) % 50 * 100 + 1
    shard = R.Shard(docs, terms, impact, size, wide)
    read = []
    for some in ([0, 1], [0, 1, 2, 3, 4, 5], [5], [2, 4]):
        weights = draw.integers(1, 5, len(some))
        whole = np.zeros(size, np.int64)
        for t, w in zip(some, weights):
            np.add.at(whole, docs[terms == t], w * impact[terms == t])
        order = np.lexsort((np.arange(size), -whole))[:20]
        found, scores, n = shard.best(np.array(some), weights, 20)
        assert found.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
        read.append(n / sum((terms == t).sum() for t in some))
    assert min(read) < 0.5


def test_terms_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(R, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) << np.uint64(48))
    texts = R.Texts(pa.array(["ab cd abc", None, "xy ab ab"]))
    n, text, term, times = texts.count(R.Vocabulary(["ab", "cd", "zz", "abc"]))
    assert n.tolist() == [3, 0, 3]
    assert sorted(zip(text.tolist(), term.tolist(), times.tolist())) == [(0, 0, 1), (0, 1, 1), (0, 3, 1), (2, 0, 2)]


@pytest.mark.parametrize("shards, bucket", [(24, 1024), (5, 3), (400, 8)])
def test_sharding(spark, monkeypatch, shards, bucket):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket)
    docs = documents(spark)
    plan = S.shard_plan(docs, shards).collect()
    rows = docs.collect()

    def digest(text):
        raw = (text or "").encode()
        return len(raw) + 8, zlib.crc32(raw)

    assert Counter((r.doc_id, r.source, r.size, r.text_crc32) for r in plan) == Counter((r.doc_id, r.source, *digest(r.text)) for r in rows)
    slots, mixture = defaultdict(list), Counter()
    for r in plan:
        slots[r.shard].append(r.slot)
        mixture[r.shard, r.source] += 1
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for source, n in Counter(r.source for r in rows).items():
        for s in range(shards):
            assert abs(mixture[s, source] - n * sizes[s] / len(rows)) <= 2
    again = S.shard_plan(docs.repartition(3), shards).collect()
    assert Counter((r.doc_id, r.size, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.size, r.shard, r.slot) for r in plan)
    assert S.shard_plan(docs, shards, seed="other").collect() != plan
    assert S.shard_plan(docs.limit(0), shards).count() == 0


def test_a_row_that_is_a_third_of_the_table_is_spread(spark, monkeypatch):
    from framewise.llm import common

    monkeypatch.setattr(common, "TOGETHER", 1 << 6)
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("a").alias("source"))
    other = spark.range(6000).selectExpr("id AS doc_id", "concat('t', id) AS text", "if(id % 2 = 0, 'a', 'b') AS source")
    plan = S.shard_plan(same.unionByName(other), 24)
    counts = [r["count"] for r in plan.groupBy("shard").count().collect()]
    assert counts == [375] * 24
    nulls = [r["count"] for r in plan.filter("doc_id is null").groupBy("shard").count().collect()]
    assert sum(nulls) == 3000
    whole = plan.groupBy("source", "shard").count().collect()
    assert all(abs(r["count"] - {"a": 250, "b": 125}[r.source]) <= 2 for r in whole)


def test_written_shards_hold_whole_rows_in_order(spark):
    docs = documents(spark)
    path = new_path(spark, "shards")
    plan = S.shard_plan(docs, 6)
    S.write_shards(docs, plan, path, rows_per_file=7)
    back = spark.read.parquet(path)
    assert set(back.columns) == {*docs.columns, "shard", "slot"}
    assert Counter((r.doc_id, r.text, r.source) for r in back.collect()) == Counter((r.doc_id, r.text, r.source) for r in docs.collect())
    places = Counter((r.shard, r.slot, r.doc_id) for r in plan.collect())
    assert Counter((r.shard, r.slot, r.doc_id) for r in back.collect()) == places
    for shard in range(6):
        texts = back.filter(F.col("shard") == shard).orderBy("slot").collect()
        assert [r.slot for r in texts] == list(range(len(texts)))
