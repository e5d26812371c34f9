import gzip
import hashlib
import io
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewise.llm import hnsw, language, mixing, queries, url_filter, warc
from framewise.llm.common import new_path

from .test_text_operators import brute_components, brute_sets, ids_of


@pytest.fixture(scope="module")
def pages(spark):
    draw = random.Random(2)
    big = "x" * 1500
    rows = [(i, f"http://h{i}.example/", "".join(draw.choice("ab <>&é") for _ in range(draw.choice([0, 5, 999, 1000, 4000]))), i) for i in range(60)]
    rows += [(100 + i, None, big, 0) for i in range(5)] + [(7, "u\r\nWARC-Type: x", big, 0), (None, "u", big, 0)]
    rows += [(300, "u", "y" * 999, 0), (301, "u", "y" * 999, 0), (302, "u", None, 0), (303, "u", "", 0), (-5, "u", "é" * 500, 0), (-4, "u", "é" * 500, 0)]
    inner = warc._record(1, "u", b"inner", "00" * 20, None)
    rows += [(400, "u", "\x1f\x8b\x08" * 400 + gzip.compress(inner).decode("latin-1"), 0), (104, None, big, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(4)


def test_warc_round_trip(spark, pages):
    got = Counter(tuple(r) for r in warc.warc_round_trip(pages).collect())
    last = defaultdict(list)
    for r in pages.collect():
        last[r.html or ""].append(r.page_id)
    expected = Counter()
    for r in pages.collect():
        raw = (r.html or "").encode()
        largest = max((i for i in last[r.html or ""] if i is not None), default=None)
        revisit = len(raw) >= 1000 and largest is not None and r.page_id != largest
        expected[(r.page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", largest if revisit else None)] += 1
    assert got == expected


@pytest.mark.parametrize("split", [1, 7, 300, 5000, 1 << 30])
def test_every_record_is_read_once_whatever_the_ranges(spark, pages, split):
    if split < 300:
        pages = pages.filter("page_id < 12")
    folder = new_path(spark, "warc")
    files = warc.write_warc(warc.with_revisits(pages), folder, file_bytes=6000)
    rows = warc.read_warc(files, folder, split).collect()
    assert len(rows) == pages.count() and files.count() > 1
    payloads = {(r.page_id, (r.html or "").encode()) for r in pages.collect()}
    for r in rows:
        if r.record_type == "response" and r.record_id != "urn:page:none":
            assert (int(r.record_id.split(":")[2]), bytes(r.payload)) in payloads


def test_ranges_are_many_tasks(spark):
    files = spark.createDataFrame([(f"part-{i}", 100 * warc.SPLIT_BYTES) for i in range(10)], "file string, n_bytes long")
    parts = warc.ranges(files)
    sizes = [r[0] for r in parts.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert parts.count() == 1000 and len(sizes) > 100 and max(sizes) < 20


def test_payload_beyond_one_range_and_clashing_columns(spark):
    import random

    draw = random.Random(3)
    long = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz \u00e9", k=400_000))
    rows = [(1, "u", long, 1, "c"), (2, "u", long, 2, "d"), (3, "v", "x" * 999, 3, "e"), (4, "v", "x" * 999, 3, "e"), (5, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, original long, content string")
    folder = new_path(spark, "warc")
    files = warc.write_warc(warc.with_revisits(pages), folder)
    got = {r.record_id: (r.record_type, r.length, r.refers_to) for r in warc.read_warc(files, folder, split=20_000).collect()}
    n = len(long.encode())
    assert n > 20 * 20_000
    assert got["urn:page:1"] == ("revisit", n, "urn:page:2") and got["urn:page:2"] == ("response", n, None)
    assert got["urn:page:3"] == got["urn:page:4"] == ("response", 999, None) and got["urn:page:5"] == ("response", 0, None)


def test_reader_passes_over_what_is_no_record():
    good = gzip.compress(warc._record(5, "u", b"payload", "00" * 20, None))
    data = b"junk" + warc.MAGIC + b"more" + gzip.compress(b"no record") + good + b"\x1f\x8b" + good[:-9]

    class File(io.BytesIO):
        def size(self):
            return len(data)

        def read_at(self, n, at):
            return data[at : at + n]

    found = list(warc.records_in(File(), 0, len(data)))
    assert [(at, r["record_id"], r["payload"]) for at, r in found] == [(data.index(good), "urn:page:5", b"payload")]


def test_warc_of_nothing(spark, pages):
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


URLS = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("http://NET/x", "net", "/x", "net/", "block"),
    ("http://x.example.net/en/1", "x.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/en", "example.net", "/en", "net/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("https://Sub.Example.com/de/?a=/fr/", "sub.example.com", "/de/", "example.com/de/", "block"),
    ("ftp://o.org/fr/#x", "o.org", "/fr/", "org/fr/", "allow"),
    ("http://net", "net", "", None, None),
    ("http://net?/x", "net", "", None, None),
    ("http://a.net#/x", "a.net", "", None, None),
    ("http://É.org/FR/", "É.org", "/FR/", None, None),
    ("mailto:x", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("http://", "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("http://net:80/x", "net:80", "/x", None, None),
    ("http://a.net/x\ny", "a.net", "/x\ny", "net/", "block"),
]


def test_suffix_counts_cover_all_pages(spark):
    rows = [(i, f"http://a{i % 3}.net/x") for i in range(30)] + [(100 + i, f"http://b.dev/{i}") for i in range(60)] + [(200, "http://o.org/fr/"), (201, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    host, path = url_filter.url_parts("url")
    rows = pages.withColumns({"host": host, "path": path}).withColumn("_rule", url_filter.fitting_rule(F.col("host"), F.col("path"), url_filter.RULES))
    table = {r.suffix: (round(r.suffix_share * 92), round(r.suffix_block_rate, 6)) for r in url_filter.suffix_table(rows).collect()}
    assert table == {"net": (30, round(31 / 32, 6)), "dev": (60, 0.5), "org": (1, round(1 / 3, 6)), "": (1, 0.5)}
    few = {r.page_id: r for r in url_filter.judge_urls(pages, most=2).collect()}
    assert len(few) == 92 and all(few[i].verdict == "block" for i in range(30)) and few[200].verdict == "allow"


def test_odd_urls_and_columns(spark):
    long = "http://x.example/" + "a/1" * 50_000
    rows = [(1, long, "p", "r", 1.0), (1, long, "p", "r", 1.0), (2, "http://a.net/", "p", "r", 1.0), (3, "http://o.org/fr/", "p", "r", 1.0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, suffix string, weight double")
    got = url_filter.judge_urls(pages).collect()
    assert sorted((r.page_id, r.rule) for r in got) == [(1, None), (1, None), (2, "net/"), (3, "org/fr/")]
    assert len({(r.verdict, r.block_score) for r in got if r.page_id == 1}) == 1
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "h")], "page_id long, url string, host string")
    rows = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(rows) == len(URLS) + 1 and rows[None].verdict == "block"
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert 0 <= r.block_score <= 1


def test_url_trees_learn_from_labelled_urls(spark):
    draw = random.Random(1)
    bad = [f"http://{draw.randrange(10**9)}-{draw.randrange(10**9)}.net/p?{'&'.join(f'a{k}={draw.random()}' for k in range(6))}" for _ in range(150)]
    good = [f"https://site{k}.example.net/en/page" for k in range(150)]
    unknown = [u.replace(".net", ".xyz") for u in bad[:50]] + [u.replace(".example.net", ".abc") for u in good[:50]]
    df = spark.createDataFrame(list(enumerate(bad + good + unknown)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert sum(rows[300 + i].verdict == "block" for i in range(50)) >= 45
    assert sum(rows[350 + i].verdict == "allow" for i in range(50)) >= 45


def test_urls_without_labels_of_both_kinds(spark):
    df = spark.createDataFrame([(1, "http://a.xyz/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge_urls(df).collect()} == {"allow"}
    more = df.union(spark.createDataFrame([(3, "http://a.net/")], "page_id long, url string"))
    assert {r.verdict for r in url_filter.judge_urls(more).collect()} == {"block"}
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def vectors(n=700, seed=3):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, 16))
    base[: n // 4] = base[n // 2 : n // 2 + n // 4] + 0.1 * draw.normal(size=(n // 4, 16))
    base[-60:] = base[-61] + 0.08 * draw.normal(size=(60, 16))  # one dense group
    base[5] = base[6] = base[7]
    return base.astype(np.float32).tolist()


def test_near_duplicate_vectors(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors())]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None, 1.0], [float("inf")] * 16, [1.0], [2.0], [-1.0], rows[5][1]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(None, rows[5][1], 0), (5, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int").repartition(3)
    got = hnsw.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    known = [(i, v) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    root = {i: i for i, _, _ in rows if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for dim in {len(v) for _, v in known}:
        own = [(i, np.array(v, float)) for i, v in known if len(v) == dim]
        unit = np.array([v / np.linalg.norm(v) for _, v in own])
        for a, b in zip(*np.nonzero(unit @ unit.T >= 0.9)):
            if a != b:
                links[own[a][0]] += 1
                x, y = top(own[a][0]), top(own[b][0])
                root[max(x, y)] = min(x, y)
    links[5] //= 2  # two rows share this id
    wrong = [r for r in got if r.vec_id is not None and (r.n_links, r.component_id) != (links[r.vec_id], top(r.vec_id))]
    assert len(wrong) <= 0.02 * len(rows)  # a search may miss, and nothing else may
    for r in got:
        assert r.n_links <= links[r.vec_id] if r.vec_id is not None else (r.n_links, r.component_id, r.kept) == (0, None, True)
        assert r.vec_id is None or r.kept == (r.vec_id == r.component_id)
    assert {r.vec_id for r in got if r.vec_id is not None and r.vec_id >= 1000 and r.n_links} == {1006, 1007, 1009}
    assert hnsw.near_duplicate_vectors(df.limit(0)).count() == 0


def test_graph_recall_and_bytes():
    raw = np.array(vectors(3000, 8))
    unit = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.Graph.build(unit)
    assert graph.audit(0.9) >= hnsw.RECALL and graph.beam < len(unit)
    again = hnsw.Graph.from_bytes(graph.to_bytes())
    row, point = again.within(unit, 0.86)
    found = np.zeros((len(unit), len(unit)), bool)
    found[row, point] = True
    truth = unit @ unit.T >= 0.9
    assert (found & truth).sum() / truth.sum() > 0.97
    few = hnsw.Graph.build(unit[:3])
    assert few.audit(0.9) == 1.0 and len(few.within(unit[:3], 0.99)[0]) >= 3


def skewed(seed=4):
    """A group of near copies of a third, pairs, and points alone, 16 wide."""
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(1200, 16))
    base[:400] = base[0] + 0.05 * draw.normal(size=(400, 16))
    base[400:500] = base[500:600] + 0.05 * draw.normal(size=(100, 16))
    return (base / np.linalg.norm(base, axis=1, keepdims=True)).astype(np.float32)


def test_audit_sees_pairs_beside_a_large_group():
    graph = hnsw.Graph.build(skewed())
    near = graph.vectors @ graph.vectors.T >= 0.9
    np.fill_diagonal(near, False)
    pairs = np.flatnonzero((near.sum(1) > 0) & (near.sum(1) < 5))
    links = graph.layers[0].links
    links[np.isin(links, pairs)] = -1  # nobody leads to a member of a pair
    assert graph.audit(0.9) >= hnsw.RECALL
    unit = skewed()[400:600]
    row, point = graph.within(unit, 0.86)
    found = {(int(r), int(p)) for r, p in zip(row, point)}
    assert sum((i, 500 + i) in found and (100 + i, 400 + i) in found for i in range(100)) >= 97


def test_audit_asks_with_vectors_of_other_shards():
    unit, draw = skewed(), np.random.default_rng(5)
    graph = hnsw.Graph.build(unit)
    others = unit[600:700] + 0.01 * draw.normal(size=(100, 16)).astype(np.float32)
    others /= np.linalg.norm(others, axis=1, keepdims=True)
    target = (graph.vectors @ others.T).argmax(0)
    links = graph.layers[0].links
    links[np.isin(links, target)] = -1  # found by no search that comes from outside
    assert graph.audit(0.9, others=others) >= hnsw.RECALL
    row, point = graph.within(others, 0.86)
    assert len({r for r, p in zip(row.tolist(), point.tolist()) if p == 600 + r}) >= 97


def test_shards_grow_with_the_count(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_VECTORS", 50)
    df = spark.createDataFrame([(i, [float(i), 1.0], 2) for i in range(1000)] + [(i, [float(i)], 1) for i in range(5)], "id long, embedding array<double>, dim int")
    rows = hnsw.with_shards(df).select("dim", "shards", "shard").collect()
    assert {(r.dim, r.shards) for r in rows} == {(2, 20), (1, 8)} and len(rows) == 1005
    assert max(Counter((r.dim, r.shard) for r in rows).values()) < 100


def test_upper_layers_hold_their_members_only():
    unit = skewed()
    graph = hnsw.Graph.build(unit)
    sizes = [x.links.shape[0] for x in graph.layers]
    assert sizes[0] == len(unit) and sum(sizes[1:]) < len(unit) // 4
    row, point = hnsw.Graph.from_bytes(graph.to_bytes()).within(unit, 0.86)
    assert {(i, i) for i in range(len(unit))} <= set(zip(row.tolist(), point.tolist()))


def checked_links(spark, rows, threshold=0.9):
    """How many rows have fewer links than a full comparison finds; none may have more. All links of a row lie in its component."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: r for r in hnsw.near_duplicate_vectors(df, threshold).collect()}
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    links = near.sum(1) - 1
    assert len(got) == len(rows) and all(got[i].n_links <= links[i] for i in got)
    fewer = [i for i in got if got[i].n_links < links[i]]
    full = [i for i in got if got[i].n_links == links[i]]
    assert all(got[i].component_id == got[j].component_id for i in full for j in np.flatnonzero(near[i]).tolist())
    return len(fewer)


def test_a_dense_group_gives_counts_not_pairs(spark, monkeypatch):
    sizes, stored = {}, hnsw.stored

    def counted(df, name, rows=None):
        out = stored(df, name, rows)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(hnsw, "stored", counted)
    draw = np.random.default_rng(7)
    rows = draw.normal(size=(500, 16)).astype(np.float32)
    rows[:400] = rows[0] + 0.05 * draw.normal(size=(400, 16))
    assert checked_links(spark, rows) == 0
    assert sizes["vector-links"] <= 400 * 2 * hnsw.SHARDS  # there are 79,800 links


def test_links_by_cells_equal_a_full_comparison(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "CELL", 4)
    draw = np.random.default_rng(9)
    rows = draw.normal(size=(2000, 16)).astype(np.float32)
    rows[:300] = rows[0] + 0.05 * draw.normal(size=(300, 16))
    rows[300:600] = rows[600:900] + 0.3 * draw.normal(size=(300, 16))
    rows[900:910] *= np.arange(2, 12)[:, None]
    rows[1000:1005] = rows[1005]
    assert checked_links(spark, rows) <= 4


@pytest.mark.parametrize("walk", [0, 16])
def test_nearest_points_by_a_walk_and_by_comparing_all(monkeypatch, walk):
    monkeypatch.setattr(hnsw, "WALK", walk)
    unit = skewed()
    graph = hnsw.Graph.build(unit)
    assert graph.walked(len(unit), graph.beam) == (walk == 0)
    top, more = graph.best(graph.vectors, 0.5)
    cosine = graph.vectors @ graph.vectors.T
    asked = np.zeros(cosine.shape, bool)
    np.put_along_axis(asked, top, True, 1)
    assert top.shape == (len(unit), graph.beam) and (asked.sum(1) == graph.beam).all()
    assert not asked[more[0], more[1]].any()
    asked[more[0], more[1]] = True
    some = 1.0 if walk else 0.97
    assert (top[:, 0] == cosine.argmax(1)).mean() >= some and asked[cosine >= 0.5].mean() >= some
    assert (np.diff(np.take_along_axis(cosine, top, 1)) <= 1e-6).all()


@pytest.mark.parametrize("walk", [0, 16])
def test_pairs_of_shards(tmp_path, monkeypatch, walk):
    monkeypatch.setattr(hnsw, "WALK", walk)
    monkeypatch.setattr(hnsw, "PART", 300)
    folder, unit = str(tmp_path), skewed()
    weight = np.arange(len(unit)) % 3 + 1
    graph = hnsw.Graph.build(unit[::4])
    hnsw._write(folder, "graph-16.npz", graph=np.frombuffer(graph.to_bytes(), np.uint8))
    ids = [np.arange(k, len(unit), 2) for k in range(2)]
    for k in range(2):
        hnsw._write(folder, f"shard-16-{k}.npz", ids=ids[k], weight=weight[ids[k]], raw=2 * unit[ids[k]])
        for a in range(0, 600, 300):
            hnsw._cells(folder, 16, 48, unit[ids[k][a : a + 300]], hnsw._near(0.9), f"asked-16-{k}-48-{a}.npz")
    one, two = (hnsw.Shard(folder, 16, k, 48, 300) for k in range(2))
    degree, root = np.zeros(len(unit), int), np.arange(len(unit))
    for found, links, other in (hnsw._links(one, None, 0.9), hnsw._links(two, None, 0.9), hnsw._links(one, two, 0.9)):
        np.add.at(degree, found, links)
        hnsw._unite(root, found, other)
    near = unit.astype(float) @ unit.T.astype(float) >= 0.9
    np.fill_diagonal(near, False)
    assert (degree <= near @ weight).all() and (degree == near @ weight).mean() > 0.99
    a, b = np.nonzero(near)
    assert (root[a] == root[b]).mean() > 0.999 and len(np.unique(root)) == len(unit) - 399 - 100


def test_beams_grow_until_links_are_found(spark, monkeypatch):
    """Neighbours as far as they may be, and a first beam that finds few of them."""
    monkeypatch.setattr(hnsw, "CELL", 4)
    tried, ask = [], hnsw.ask_cells

    def one_at_first(spark, shards, graphs, folder, beams, threshold):
        tried.append(dict(beams))
        return ask(spark, shards, graphs, folder, beams, threshold)

    def from_one(points, folder, threshold, build=hnsw.build_graphs):
        return build(points, folder, threshold).withColumn("beam", F.lit(1).cast("bigint"))

    monkeypatch.setattr(hnsw, "ask_cells", one_at_first)
    monkeypatch.setattr(hnsw, "build_graphs", from_one)
    draw = np.random.default_rng(10)
    rows = draw.normal(size=(800, 32)).astype(np.float32)
    rows[:400] = rows[400:] + 0.45 * draw.normal(size=(400, 32))
    assert checked_links(spark, rows) <= 40
    assert len(tried) > 1 and tried[0] == {32: 1}


def test_a_cosine_at_the_threshold_is_told_in_double_precision(spark):
    draw = np.random.default_rng(11)
    base = draw.normal(size=(60, 24))
    side = draw.normal(size=(60, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = 0.9 + np.linspace(-2e-7, 2e-7, 60)[:, None]
    rows = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicate_vectors(df).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    assert 20 < links[:60].sum() < 40
    assert got == dict(enumerate(links.tolist()))


def test_queries_equal_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in queries.ORACLE.items():
        mine = queries.QUERIES[name](spark, sf)
        theirs = con.execute(sql)
        columns = [c[0] for c in theirs.description]
        assert sorted(columns) == sorted(mine.columns), name
        assert Counter(map(tuple, mine.select(*columns).collect())) == Counter(theirs.fetchall()), name


def test_nothing_to_learn_a_language_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [(9001, "123 !!", None, "s", 6), (9002, None, None, "s", 0), (None, "Ж", None, "s", 1)]
    extra = spark.createDataFrame(rows, docs.schema)
    none = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(extra)
    held = docs.filter(language.held_out()).unionByName(extra)
    for given in (none, held):
        kept = corpus_pipeline.known_language(spark, given, "")
        assert kept.columns == docs.columns
        lettered = [r.doc_id for r in given.collect() if any(c.isalpha() for c in r.text or "")]
        assert Counter(r.doc_id for r in kept.collect()) == Counter(lettered) and None in lettered


def test_pipeline_stage_by_stage(spark, tmp_path):
    sf = str(tmp_path / "sf")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 300")
    extra = docs.limit(1).select(F.lit(5000).cast("long").alias("doc_id"), F.lit("123 !!").alias("text"), "lang", "source", "n_chars")
    near = docs.filter("doc_id < 30").withColumns({"doc_id": F.col("doc_id") + 1000, "text": F.concat("text", F.lit(" end"))})
    same = docs.filter("doc_id < 20").withColumns({"doc_id": F.col("doc_id") + 2000, "text": F.replace("text", F.lit(" "), F.lit("  "))})
    docs.unionByName(extra).unionByName(near).unionByName(same).write.parquet(f"{sf}/documents.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, now, sf).write.parquet(path)
        now = spark.read.parquet(path)
        if name != "best-fit packing":
            assert now.columns == docs.columns
        seen[name] = [r.asDict() for r in now.collect()]
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {i: t for i, t in given.items() if i != 5000}
    assert {r["doc_id"] for r in seen["language ID"]} == set(known)
    groups = defaultdict(list)
    for i, t in known.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    single = {min(g)[1] for g in groups.values()}
    assert {r["doc_id"] for r in seen["exact dedup"]} == single
    names = brute_components(brute_sets([(i, known[i]) for i in single]))
    assert {r["doc_id"] for r in seen["n-gram Jaccard join"]} == {i for i in single if names[i] == i}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/n-gram-Jaccard-join/*.parquet'")
    drawn = Counter(r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.mix_oracle()})").fetchall())
    assert Counter(r["doc_id"] for r in seen["mixing sources"]) == drawn
    pieces = Counter((r["doc_id"], r["piece"], r["length"]) for r in seen["best-fit packing"])
    expected = Counter()
    for i, n in drawn.items():
        ids = len(ids_of("word_bpe_49k.json", known[i])) + 1
        for k in range(-(-ids // 2048)):
            expected[(i, k, min(2048, ids - 2048 * k))] += n
    assert pieces == expected
    assert Counter((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, sf).collect()) == Counter(p[:2] for p in pieces.elements())

