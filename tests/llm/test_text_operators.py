import functools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewise.llm import block_names, common, language, mixing, packing, shingle_join, token_files, toxicity
from framewise.llm.common import components, new_path
from framewise.llm.tokens import PieceEncoder, tokenizer_path

from .fixtures import LONG, documents, texts

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return t


def ids_of(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_ids_are_those_of_the_library(name):
    import random

    draw = random.Random(3)
    odd = ["".join(draw.choice("ab 'sA.,\n\té1²  -_<|é×ɐ́") for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    odd += ["<|endoftext|> x", " a", "a ", "a\n\nb", "l'eau d'or", "İstanbul ΣΑΣ", "x" * 5000, None, "", "a b  c"]
    encode = PieceEncoder(tokenizer_path(name))
    for _ in range(2):  # also when all pieces are known
        assert [i.tolist() for i in encode(pa.array(odd))] == [ids_of(name, t) for t in odd]


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_added_tokens_in_texts_are_those_of_the_library(name):
    from tokenizers import Tokenizer

    from framewise.llm.tokens import encoder

    plain = Tokenizer.from_file(tokenizer_path(name))
    end, start = "<|endoftext|>", "<|startoftext|>"
    rows = [f"a {end} b", end, end + end, f"{end} x", f"x {end}", f"x{end}y", f"a  {end}  b", f"é {end}\n\n{start} b c", end.upper(), f"<|{end}|>"]
    rows += ["ends with <|endof", "text|> begins", None, "", "a plain text", f"{'word ' * 12000}{end} {'é word ' * 12000}{start}", f"two {start}{end} 12 ab"]
    expected = [plain.encode(t or "", add_special_tokens=False).ids for t in rows]
    assert len(expected[0]) == (4 if name == BYTE else 3)
    for _ in range(2):
        assert [i.tolist() for i in encoder(tokenizer_path(name))(pa.array(rows))] == expected


def test_documents_with_added_tokens(spark):
    from tokenizers import Tokenizer

    rows = [(1, "a <|endoftext|> b"), (2, "then another")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for name, run in ((BYTE, lambda p: token_files.token_digest(df, p, end=2)), (WORD, lambda p: packing.pack_documents(df, p))):
        plain = Tokenizer.from_file(tokenizer_path(name))
        end = 2 if name == BYTE else 0
        expected = {i: crc(plain.encode(t, add_special_tokens=False).ids + [end]) for i, t in rows}
        assert {r.doc_id: r.ids_crc32 for r in run(tokenizer_path(name)).collect()} == expected


def test_piece_table_begun_anew(monkeypatch):
    monkeypatch.setattr("framewise.llm.tokens.PIECES_KEPT", 50)
    encode = PieceEncoder(tokenizer_path(WORD))
    for t in texts()[12:60]:
        assert next(encode(pa.array([t]))).tolist() == ids_of(WORD, t)


def test_packing(spark, docs):
    rows = packing.pack_documents(docs, tokenizer_path(WORD), capacity=64).collect()
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(WORD, r.text) + [0]
        for a in range(0, len(ids), 64):
            expected[(r.doc_id, a // 64, a, len(ids[a : a + 64]), crc(ids[a : a + 64]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    plan = packing.plan_packing(Counter(r.length for r in rows), 64)
    assert len(sequences) == plan.sequences <= 1.01 * plan.bound + 1


def test_plan_is_near_the_bound():
    draw = np.random.default_rng(1)
    for case in range(6):
        lengths = draw.integers(1, 2049, 3000) if case < 3 else draw.integers(600, 1100, 500)
        histogram = Counter(lengths.tolist())
        plan = packing.plan_packing(histogram, 2048)
        used = Counter()
        for config, n in plan.configurations:
            assert sum(config) <= 2048
            for x in config:
                used[x] += n
        assert used == histogram
        rooms = []  # no worse than first fit, longest first
        for x in sorted(lengths.tolist(), reverse=True):
            at = next((i for i, room in enumerate(rooms) if room >= x), None)
            if at is None:
                rooms.append(2048 - x)
            else:
                rooms[at] -= x
        assert plan.bound <= plan.sequences <= len(rooms)
    assert packing.plan_packing({}, 10).sequences == 0
    assert packing.plan_packing({10: 7}, 10).sequences == 7
    with pytest.raises(ValueError):
        packing.plan_packing({11: 1}, 10)


def brute_sets(rows):
    sets = {}
    for i, t in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return sets


def brute_components(sets):
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for k, i in enumerate(names):
        for j in names[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in names}


def test_jaccard_join(spark, docs):
    rows = shingle_join.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    sets = brute_sets([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    names = brute_components(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == {i: (len(sets[i]), names[i]) for i in sets}
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]
    assert sum(names[i] != i for i in names) > 20


@pytest.mark.parametrize("block, hot", [(16, 64), (4096, 3), (16, 3)])
def test_jaccard_join_of_one_large_family_in_blocks(spark, monkeypatch, block, hot):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    monkeypatch.setattr(shingle_join, "HOT", hot)
    monkeypatch.setattr(shingle_join, "PIVOTS", 2)
    import random

    draw = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 4])):
            words[draw.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(words)))
    found = shingle_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == brute_components(brute_sets(rows))


def test_texts_that_share_a_passage_or_an_id(spark, monkeypatch):
    """Every link is found among families that share a passage, with null and repeated ids; decisions are by row."""
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    monkeypatch.setattr(shingle_join, "HOT", 4)
    import random

    draw = random.Random(21)
    passage = [f"shared{i}" for i in range(40)]
    rows = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(6):
            words = list(base)
            for _ in range(draw.choice([0, 1, 2, 5, 9])):
                words[draw.randrange(60)] = f"own{draw.random()}"
            rows.append((len(rows), " ".join(words[:30] + passage + words[30:])))
    near = rows[0][1] + " more"
    rows += [(0, rows[40][1] + " x"), (None, near), (None, near), (None, "quite another text without kin"), (3, "a clean text of id three " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = brute_sets([(k, t) for k, (_, t) in enumerate(rows)])
    names = brute_components(sets)
    least = {}
    for k, top in names.items():
        if rows[k][0] is not None:
            least[top] = min(least.get(top, 1 << 60), rows[k][0])
    expected = sorted(str((rows[k][0], len(sets[k]), least.get(names[k]))) for k in names)
    found = shingle_join.jaccard_components(docs).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == expected
    kept = shingle_join.one_of_component(docs, shingle_join.jaccard_components(docs)).collect()
    assert len(kept) == len(set(names.values()))
    assert sum(r.doc_id is None for r in kept) == 1 and (3, rows[-1][1]) in [(r.doc_id, r.text) for r in kept]


def test_small_tables_of_the_join_are_single_files_whatever_the_partitions(spark, docs, monkeypatch):
    files = defaultdict(list)

    def counted(df, name, *rows, f=common.stored):
        out = f(df, name, *rows)
        files[name].append(len(out.inputFiles()))
        return out

    expected = sorted(map(str, shingle_join.jaccard_components(docs).collect()))
    for module in (common, shingle_join):
        monkeypatch.setattr(module, "stored", counted)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = sorted(map(str, shingle_join.jaccard_components(docs).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == expected
    small = ("census", "equal-sets", "points", "run-sizes", "edges", "hook", "hot-hashes", "prefixes", "pairs", "row-components")
    assert {name: max(files[name]) for name in small} == dict.fromkeys(small, 1)


def test_tables_are_written_by_a_task_per_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS", 100)
    out = common.stored(spark.range(0, 1000, 1, 50), "rows", 1000)
    assert len(out.inputFiles()) == 10 and out.distinct().count() == 1000
    assert len(common.stored(spark.range(0, 1000, 1, 5), "rows", 1000).inputFiles()) == 5
    assert common.stored(spark.range(0), "rows", 0).count() == 0


def test_bound_by_counts_holds():
    draw = np.random.default_rng(2)
    counts = draw.integers(0, 6, (300, shingle_join.GROUPS)).astype("<u2")
    counts[::7] = counts[0] + draw.integers(0, 2, (len(counts[::7]), shingle_join.GROUPS))
    sizes = counts.sum(1).astype(np.int64)
    order = np.lexsort((counts[:, 0], sizes))
    counts, sizes = counts[order], sizes[order]
    q, x = shingle_join.CountTree(counts, sizes).search(counts, sizes, (4, 5))
    bound = np.minimum(counts[:, None], counts[None]).sum(2)
    truth = 9 * bound >= 4 * (sizes[:, None] + sizes[None])
    found = np.zeros(truth.shape, bool)
    found[q, x] = True
    assert (found >= truth).all()


def test_bound_of_two_sets_holds():
    draw = np.random.default_rng(6)
    for n in (1, 3, 60, 300, 1100, 2000, 2100, 5000):
        a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], draw.integers(0, 1 << 63, n // 2 + 30).astype(np.uint64)]))
        raw = [shingle_join._counts(x).tobytes() for x in (a, b)]
        bound = shingle_join._bound(*raw)
        assert len(np.intersect1d(a, b)) <= bound
        assert bound < 0.9 * n or n < 100
        assert np.minimum(*shingle_join._points(raw)).sum() >= bound
    same = np.full(3000, 7, np.uint64)
    assert shingle_join._bound(shingle_join._counts(same).tobytes(), raw[1]) == len(b)


def test_keeping_one_of_each_component(spark, docs):
    kept = shingle_join.one_of_component(docs, shingle_join.jaccard_components(docs))
    assert kept.columns == docs.columns
    names = brute_components(brute_sets([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]))
    expected = [i for i in names if names[i] == i] + [None, None]
    assert sorted(map(str, expected)) == sorted(str(r.doc_id) for r in kept.collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 90 for i in (90, 95, 100, 200)}}


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_dedup(spark, docs, block):
    rows = block_names.exact_dedup(docs if block > 3 else docs.filter("length(text) < 2000"), block=block).collect()
    given = (docs if block > 3 else docs.filter("length(text) < 2000")).select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in given:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.doc_id))
    import hashlib

    expected = Counter()
    for text, members in groups.items():
        keep = min(members, key=lambda m: m[:3])[3]
        for m in members:
            expected[(m[3], keep, len(members), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == expected
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_keeping_one_of_equal_texts(spark, docs):
    kept = block_names.keep_one(docs, block_names.exact_dedup(docs))
    assert kept.columns == docs.columns
    squeezed = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(squeezed) == len(set(squeezed)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()})


def test_mixing(spark, docs):
    rates = {r.source: r for r in mixing.repetition_rates(docs).collect()}
    total = sum(r.n_chars for r in rates.values())
    assert sum(r.n_chars * r.rate for r in rates.values()) == pytest.approx(total)
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [c for c in docs.columns if c != "copies"] + ["copy", "copies", "mix_key"]
    rows = mixed.collect()
    once = {r for r, n in Counter((r.doc_id, r.text) for r in docs.collect()).items() if n == 1}
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(r.mix_key for r in rows if (r.doc_id, r.text) in once) == sorted(r.mix_key for r in again if (r.doc_id, r.text) in once)
    by_row = Counter((r.doc_id, r.text) for r in rows)
    for r in rows:
        assert by_row[(r.doc_id, r.text)] % r.copies == 0 or (r.doc_id, r.text) not in once
    weights = spark.createDataFrame([("small", 3.0), (None, 1.0), ("big", -1.0), ("none", 9.0)], "source string, weight double")
    assert {r.source for r in mixing.mix_sources(docs, weights).collect()} <= {"small", None}


def test_mixing_draws_poisson_numbers(spark):
    many = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "if(id % 4 = 0, 'a', 'b') AS source")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    n = mixing.mix_sources(many, weights).groupBy("source", "doc_id").count().groupBy("source")
    got = {r.source: r for r in n.agg(F.sum("count").alias("n"), F.sum(F.col("count") ** 2).alias("s"), F.count("*").alias("some")).collect()}
    for source, rows, rate in (("a", 5000, 3.0), ("b", 15_000, 1 / 3)):
        r = got[source]
        assert r.n / rows == pytest.approx(rate, rel=0.04)
        assert r.s / rows - (r.n / rows) ** 2 == pytest.approx(rate, rel=0.08)
        assert r.some / rows == pytest.approx(1 - np.exp(-rate), rel=0.04)
    high = spark.range(40).selectExpr("id AS doc_id", "'x' AS text", "'a' AS source")
    assert mixing.mix_sources(high, size=1000.0).count() == pytest.approx(40_000, rel=0.03)


@pytest.mark.parametrize("seed", ["mix", "a", "b", "c"])
def test_rows_without_an_id_draw_their_own_numbers(spark, seed):
    rows = spark.range(3000).selectExpr("CAST(null AS long) AS doc_id", "concat('text ', lpad(id, 6, '0')) AS text", "'a' AS source")
    mixed = mixing.mix_sources(rows, seed=seed)
    assert mixed.count() == pytest.approx(3000, abs=150)
    assert mixed.select("mix_key").distinct().count() == mixed.count()
    equal = spark.range(3000).selectExpr("7L AS doc_id", "'the same text' AS text", "'a' AS source").repartition(3)
    mixed = mixing.mix_sources(equal, seed=seed)
    assert mixed.count() == pytest.approx(3000, abs=200)
    assert mixed.select("mix_key").distinct().count() == mixed.count()


def test_token_files_are_read_in_many_tasks_and_equal_ids_lie_in_several_files(spark):
    docs = spark.range(4000).selectExpr("CAST(null AS long) AS doc_id", "concat('some words ', id) AS text", "1 AS hash", "'x' AS file")
    folder = new_path(spark, "tokens")
    files = token_files.write_tokens(docs, tokenizer_path(BYTE), 2, folder)
    texts = [r.n_texts for r in files.collect()]
    assert sum(texts) == 4000 and len(texts) == 8 and max(texts) < 1000
    read = token_files.read_tokens(files, folder)
    assert read.rdd.getNumPartitions() == 8
    spans = sorted((r.start, r.n_tokens) for r in read.collect())
    assert len(spans) == 4000 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    names = spark.createDataFrame([(f"ids-{i:08d}.bin", i, 1, 5, 100) for i in range(1000)], files.schema)
    ranges = token_files.read_plan(names)
    sizes = [r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 100 and max(sizes) < 20
    assert sorted(r.start for r in ranges.collect()) == [5 * i for i in range(1000)]


def test_token_files(spark, docs):
    folder = new_path(spark, "tokens")
    files = token_files.write_tokens(docs, tokenizer_path(BYTE), 2, folder)
    rows = token_files.read_tokens(files, folder).collect()
    expected = Counter()
    for r in docs.collect():
        ids = ids_of(BYTE, r.text) + [2]
        expected[(r.doc_id, tuple(ids), crc(ids), len(ids))] += 1
    assert Counter((r.id, tuple(r.ids), r.ids_crc32, r.n_tokens) for r in rows) == expected
    end = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens
    order = [r.id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))


def test_byte_code():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, 7, 300, (1 << 32) - 1], np.uint32)
    parts = [ranks[:3], ranks[:0], ranks, ranks[4:5]]
    packed = [token_files.pack(p) for p in parts]
    control, data = (np.frombuffer(b"".join(p[k] for p in packed), np.uint8) for k in (0, 1))
    sizes = np.array([len(p) for p in parts])
    assert token_files.unpack(control, data, sizes).tolist() == np.concatenate(parts).tolist()


def test_rare_languages_and_rows_without_ids_are_learned(spark):
    words = {"aa": "baba kala baba moko", "bb": "the strength of threads", "cc": "ziq wux qizzy jux"}
    rows = [(None if i % 2 else 7, f"{words['aa']} {i}", "aa") for i in range(3000)] + [(i, f"{words['bb']} {i}", "bb") for i in range(300)]
    rows += [(None, f"{words['cc']} {i}", "cc") for i in range(5)] + [(5, None, "cc"), (6, "no label", None)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    drawn = language._sampled(docs.filter("lang is not null"), 60, 256).groupBy("lang").count().collect()
    n = {r.lang: r["count"] for r in drawn}
    assert n["cc"] == 6 and 5 <= n["aa"] <= 40 and 8 <= n["bb"] <= 40
    model = language.fit_languages(docs, 60)
    found = language.identify(spark.createDataFrame([("moko baba",), ("threads of",), ("jux qizzy wux",), ("12",), (None,)], "text string"), model)
    assert [r.lang_pred for r in found.collect()] == ["aa", "bb", "cc", "und", "und"]
    assert language.fit_languages(docs, 60, languages=2).languages == ["aa", "bb"]


def test_decoding_takes_the_nearest_codeword():
    code = language.codewords(5)
    draw = np.random.default_rng(4)
    model = language.LanguageModel([f"l{i}" for i in range(5)], code, None, draw.random(code.shape[1]) + 0.5, draw.random(code.shape[1]) + 0.5)
    margins = draw.normal(size=(200, code.shape[1]))
    best, score, gap = model.decode(margins)
    for i, row in enumerate(margins):
        again, one, _ = model.decode(row[None])
        assert again[0] == best[i] and one[0] == pytest.approx(score[i])
    clean, _, wide = model.decode(code * 10.0)
    assert clean.tolist() == list(range(5)) and (wide > language.AMBIGUOUS).all()


def test_language_on_rows_not_learned(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "12 345 !!", "en", "s", 0), (-4, "日本", None, "s", 0)], data.schema)
    found = language.identify(data.unionByName(odd), language.learn_languages(data)).withColumn("h", language.held_out()).collect()
    unseen = [r for r in found if r.h and r.doc_id >= 0]
    assert len(unseen) > 200 and sum(r.lang == r.lang_pred for r in unseen) / len(unseen) > 0.98
    assert all(0 <= r.lang_score <= 1 for r in found)
    got = {r.doc_id: r.lang_pred for r in found if r.doc_id < 0}
    assert got[-1] == got[-2] == got[-3] == "und" != got[-4]


def test_language_codewords():
    for n in (1, 2, 3, 4, 6, 9, 30):
        code = language.codewords(n)
        assert len(code) == n == len(np.unique(code, axis=0)) and set(code.ravel()) <= {-1, 1}
        assert n == 1 or (np.abs(code.sum(0)) < n).all()


def brute_segments(scores):
    """The best segment, then the best ones of what lies left and right of it."""
    if not len(scores):
        return []
    sums = np.append(0, np.cumsum(scores))
    best = max(((sums[b] - sums[a], a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    _, a, b = best
    left, right = brute_segments(scores[:a]), brute_segments(scores[b:])
    return left + [(a, b)] + [(b + x, b + y) for x, y in right]


def test_all_maximal_segments():
    draw = np.random.default_rng(4)
    for _ in range(60):
        n = int(draw.integers(1, 40))
        scores = np.where(draw.random(n) < 0.3, draw.random(n) * 3, -0.37)
        place = np.flatnonzero(scores > 0)
        found = toxicity.maximal_segments(place, scores[place], 0.37)
        assert [(a, b) for a, b, _ in found] == brute_segments(scores)
        for a, b, s in found:
            assert s == pytest.approx(scores[a:b].sum())


def test_toxicity_on_rows_not_learned(spark):
    sf = "/root/testdata/sf0.1"
    data, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn_toxicity(data, labels)
    found = toxicity.score_toxicity(data, model).join(labels, "doc_id").filter(language.held_out("doc_id", 5, 0)).collect()
    toxic = [r.toxic_score >= 0.5 for r in found if r.toxic]
    clean = [r.toxic_score >= 0.5 for r in found if not r.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01
    for r in found:
        assert 0 <= r.toxic_score <= 1 and (r.toxic_score < 0.5 or r.toxic_spans)
        for s in r.toxic_spans:
            assert 0 <= s.start < s.end <= len(r.text) and r.text[s.start].isalpha() and r.text[s.end - 1].isalpha()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!")], "doc_id long, text string")
    assert [(r.toxic_spans, r.toxic_score < 0.5) for r in toxicity.score_toxicity(odd, model).collect()] == [([], True)] * 3


def test_toxicity_without_both_classes(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, labels)
    assert model is None
    assert {r.toxic_score for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    path = tokenizer_path(WORD)
    assert packing.pack_documents(none, path).count() == 0
    assert shingle_join.jaccard_components(none).count() == 0
    assert block_names.exact_dedup(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert token_files.token_digest(none, path, 2).count() == 0
    assert language.learn_languages(none) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert toxicity.fit_toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")) is None


def test_long_text_is_whole(spark):
    one = spark.createDataFrame([(1, LONG), (2, LONG + " end")], "doc_id long, text string")
    rows = {r.doc_id: r for r in shingle_join.jaccard_components(one).collect()}
    assert rows[1].n_shingles == 997 and rows[2].n_shingles == 998
    names = {r.doc_id: r.kept for r in block_names.exact_dedup(one).collect()}
    assert names == {1: True, 2: True}


def test_toxicity_of_few_labelled_rows_ranks_those_not_learned(spark):
    sf = "/root/testdata/sf0.001"
    data, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score_toxicity(data, toxicity.learn_toxicity(data, labels)).join(labels, "doc_id")
    found = found.filter(language.held_out("doc_id", 5, 0)).collect()
    toxic, clean = ([r.toxic_score for r in found if r.toxic == k] for k in (1, 0))
    assert toxic and clean and np.mean([[(a > b) + (a == b) / 2 for b in clean] for a in toxic]) > 0.8


def test_hashes_of_no_words_in_a_fresh_worker(monkeypatch):
    from framewise.llm import scan

    monkeypatch.setattr(scan, "_powers", {})
    none = np.zeros(0, np.int64)
    assert len(scan.span_hashes(np.zeros(0, np.uint8), none, none)) == 0
