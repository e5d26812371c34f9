"""Ranked lexical search by the Best Position Algorithm.

A document's score for a query is a weighted sum over the query's terms of an
impact that depends on how often the document holds the term and how long
it is. Documents are searched in shards, each in one task, every shard holding
for each term its impact list: the documents with that term, highest
impact first. A search reads the lists of its terms in parallel. Each
document it meets is looked up in all lists at once (direct access), which gives its
whole score and marks its position in every list. A list's best position is the end
of the stretch of marked positions that starts at its head; a document not met
yet has at most the impact found there. The search stops when the k-th
score so far is above the sum of these bounds, strictly, so that no tie is lost, or
when every list is read. The best of the shards are the best of all.

Shards are stretches of the text table of at most ``SHARD_BYTES`` (or one longer text). Queries and their
terms are files in the shared folder that tasks read in turn, so neither the
corpus nor the queries are ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, stored
from .files import at
from .scan import LOWER, batch_bytes, slices, span_hashes, words

#: Text searched together, queries and different terms in a file.
SHARD_BYTES, QUERIES, TERMS = 1 << 25, 1 << 10, 1 << 16
#: Positions read of each list at first; later twice as many as are read.
DEPTH = 32
#: Bytes that no term holds: ASCII other than digits and letters.
APART = np.ones(256, bool)
APART[0x80:] = False
for _a, _b in (b"09", b"AZ", b"az"):
    APART[_a : _b + 1] = False


class Vocabulary:
    """Terms in order, found in a text by the hash of their bytes and proven by the bytes themselves."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        raw = [t.encode() for t in terms]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
        self.starts, self.ends = np.append(0, ends[:-1])[: len(ends)], ends
        hashes = span_hashes(self.data, self.starts, self.ends) if len(raw) else np.zeros(0, np.uint64)
        # terms whose hashes agree stand side by side and are tried one after the other
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        same = np.append(True, self.hashes[1:] != self.hashes[:-1]) if len(raw) else np.zeros(0, bool)
        self.most = int(np.diff(np.append(np.flatnonzero(same), len(raw))).max(initial=0))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the spans, term) of the spans that are terms."""
        hashes = span_hashes(data, starts, ends)
        word = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        first = np.searchsorted(self.hashes, hashes[word])
        out = []
        for k in range(self.most):
            slot = np.minimum(first + k, len(self.hashes) - 1)
            hit = (first + k < len(self.hashes)) & (self.hashes[slot] == hashes[word])
            term, span = self.order[slot[hit]], word[hit]
            length = self.ends[term] - self.starts[term]
            alike = length == ends[span] - starts[span]
            term, span, length = term[alike], span[alike], length[alike]
            if len(term):
                before = np.cumsum(length) - length
                step = np.arange(int(length.sum())) - np.repeat(before, length)
                equal = data[np.repeat(starts[span], length) + step] == self.data[np.repeat(self.starts[term], length) + step]
                proven = np.logical_and.reduceat(equal, before)
                out.append((span[proven], term[proven]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


class Texts:
    """The texts of a shard; terms are runs of digits, ASCII letters (A-Z as a-z) and all other characters."""

    def __init__(self, column: pa.Array):
        self.data, self.at = batch_bytes(column)
        self.size = len(column)

    def count(self, vocabulary: Vocabulary | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text with repeats; then text, term and count of the vocabulary's in them, by text."""
        n, found = np.zeros(self.size, np.int64), [np.zeros((2, 0), np.int64)]
        wide = len(vocabulary.terms) if vocabulary else 1
        for a, b in slices(self.at):
            data = LOWER[self.data[self.at[a] : self.at[b]]]
            starts, ends, first = words(data, self.at[a : b + 1] - self.at[a], APART)
            n[a:b] = np.diff(first)
            if wide and vocabulary:
                span, term = vocabulary.find(data, starts, ends)
                text = a + np.searchsorted(first, span, "right") - 1
                pair, times = np.unique(text * wide + term, return_counts=True)
                found.append(np.stack([pair, times]))
        pair, times = np.concatenate(found, 1)
        return n, pair // wide, pair % wide, times


class Shard:
    """Impact lists of a shard: documents by text, and by term with the highest impact first."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impact: np.ndarray, size: int, wide: int):
        # given by document: where a document's entries begin
        self.docs, self.terms, self.impact = docs, terms, impact
        self.first = np.searchsorted(docs, np.arange(size + 1))
        self.listed = np.lexsort((docs, -impact, terms))
        self.head = np.searchsorted(terms[self.listed], np.arange(wide + 1))
        self.position = np.empty(len(docs), np.int64)
        self.position[self.listed] = np.arange(len(docs)) - self.head[terms[self.listed]]
        self.size = size

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the ``k`` best, equal scores by document, and how many entries were read in order.

        ``weights`` are positive and hold repeats.
        """
        there = self.head[terms + 1] > self.head[terms]
        terms, weights = terms[there], weights[there]
        length = self.head[terms + 1] - self.head[terms]
        at_term = np.full(len(self.head), -1)
        at_term[terms] = np.arange(len(terms))
        lay = np.cumsum(length) - length  # marks of all lists one after the other
        marked = np.zeros(int(length.sum()), bool)
        seen = np.zeros(self.size, bool)
        best = np.zeros(len(terms), np.int64)
        top = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step, read = 0, DEPTH, 0
        while len(terms) and (depth < length).any():
            end = np.minimum(depth + step, length)
            some = [self.docs[self.listed[self.head[t] + min(depth, e) : self.head[t] + e]] for t, e in zip(terms, end)]
            new = np.unique(np.concatenate(some))
            read += sum(len(x) for x in some)
            new = new[~seen[new]]
            seen[new] = True
            # direct access: all entries of the new documents
            n = self.first[new + 1] - self.first[new]
            entry = np.repeat(self.first[new] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            which = at_term[self.terms[entry]]
            owner = np.repeat(np.arange(len(new)), n)[which >= 0]
            entry, which = entry[which >= 0], which[which >= 0]
            marked[lay[which] + self.position[entry]] = True
            if len(new):
                begin = np.searchsorted(owner, np.arange(len(new)))
                score = np.add.reduceat(weights[which] * self.impact[entry], begin)
                docs, scores = np.append(top[0], new), np.append(top[1], score)
                order = np.lexsort((docs, -scores))[:k]
                top = docs[order], scores[order]
            bound = 0
            for j in range(len(terms)):
                rest = marked[lay[j] + best[j] : lay[j] + length[j]]
                gap = int(rest.argmin()) if len(rest) else 0
                best[j] = length[j] if len(rest) == 0 or rest[gap] else best[j] + gap
                if best[j] < length[j]:  # an unseen document stands below the best position
                    last = self.listed[self.head[terms[j]] + max(best[j] - 1, 0)]
                    bound += int(weights[j]) * int(self.impact[last])
            depth += step
            step = depth
            if len(top[0]) >= k and top[1][-1] > bound:
                break
        return *top, read


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (doc_id, text) in shards, by doc_id with null last."""
    held: list[pa.RecordBatch] = []
    size = 0

    def made():
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return batch.take(pc.sort_indices(batch.column(0)))  # null at the end

    for batch in batches:
        for i, j in slices(batch_bytes(batch.column(1))[1], SHARD_BYTES):
            part = batch.slice(i, j - i)
            bytes_ = int(pc.sum(pc.binary_length(part.column(1))).as_py() or 0)
            if held and size + bytes_ > SHARD_BYTES:
                yield made()
                held, size = [], 0
            held.append(part)
            size += bytes_
    if held:
        yield made()


def _in_files(rows: DataFrame, name: str, most: int) -> str:
    """``rows`` written to a folder of files of about ``most`` rows."""
    path = new_path(rows.sparkSession, name)
    rows.repartition(max(1, -(-rows.count() // most))).write.parquet(path)
    return path


def _tables(folder: str) -> Iterator[pa.Table]:
    store, root = at(folder)
    for name in sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")):
        with store.open_input_file(name) as f:
            yield parquet.read_table(f)


def query_terms(queries: DataFrame, id: str, text: str) -> DataFrame:
    """query (a number of ours), item_id, term, times: the terms of each query row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(2))
            of, out = [], []
            for a, b in slices(texts.at):
                data = LOWER[texts.data[texts.at[a] : texts.at[b]]]
                starts, ends, first = words(data, texts.at[a : b + 1] - texts.at[a], APART)
                raw = data.tobytes()
                out += [raw[i:j].decode() for i, j in zip(starts.tolist(), ends.tolist())]
                of += (a + np.repeat(np.arange(b - a), np.diff(first))).tolist()
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(out, pa.string())], names=["query", "item_id", "term"])

    kind = queries.schema[id].dataType.simpleString()
    numbered = queries.select(F.monotonically_increasing_id().alias("query"), F.col(id).alias("item_id"), F.col(text).alias("text"))
    found = numbered.mapInArrow(cut, f"query bigint, item_id {kind}, term string")
    return found.groupBy("query", "item_id", "term").agg(F.count("*").alias("times"))


def corpus_counts(docs: DataFrame, terms: DataFrame) -> tuple[int, int, DataFrame]:
    """Documents with a term, all terms of all documents, and for each of ``terms`` (term) the documents that hold it.

    ``docs`` has doc_id and text, ``terms`` no repeats.
    """
    folder = _in_files(terms, "terms", TERMS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            texts = Texts(shard.column(1))
            n = texts.count(None)[0]
            out = [(None, int((n > 0).sum()), int(n.sum()))]
            for table in _tables(folder):
                vocabulary = Vocabulary(table.column("term").to_pylist())
                times = np.bincount(texts.count(vocabulary)[2], minlength=len(vocabulary.terms))
                out += [(vocabulary.terms[k], int(times[k]), 0) for k in np.flatnonzero(times)]
            term, held, total = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(held), pa.array(total)], names=["term", "df", "total"])

    counts = docs.mapInArrow(count, "term string, df bigint, total bigint")
    counts = stored(counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "term-counts")
    whole = counts.filter("term is null").first()
    return (whole.df, whole.total, counts.filter("term is not null").select("term", "df")) if whole else (0, 0, counts.select("term", "df"))


def ranked_search(
    docs: DataFrame, queries: DataFrame, k: int = 20,
    id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 for each row of ``queries``.

    A term is a run of digits, ASCII letters (A-Z count as a-z) and characters
    beyond ASCII; null has none. N counts the documents with a term, L all their terms with
    repeats, n those of a document, df the documents that hold a term and tf its
    occurrences in one. A term weighs w = floor(1000 ln((2N + 2) / (2df + 1))); with
    m = 75 + 25nN div L a document scores the sum over the query's terms, with
    repeats, of w * (10^9 tf div (1000tf + 12m)).

    Equal scores are ordered by doc_id, null last. Every row of ``docs`` is a
    document and every row of ``queries`` a query, also where ids are null or repeated. Queries without terms
    have no rows, and neither have those of an empty table or against one. Other
    columns are not read.
    """
    texts = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    asked = stored(query_terms(queries, item_id, item_text), "query-terms")
    documents, total, held = corpus_counts(texts, asked.select("term").distinct())
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weighed = asked.join(held.select("term", weight.alias("w")), "term").filter("w > 0")
    lists = weighed.groupBy("query", "item_id").agg(F.collect_list(F.struct("term", (F.col("w") * F.col("times")).alias("w"))).alias("terms"))
    folder = _in_files(stored(lists, "queries"), "queries", QUERIES)
    kind = queries.schema[item_id].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches):
            texts = Texts(rows.column(1))
            for table in _tables(folder):
                entries = table.column("terms").combine_chunks()
                pairs = entries.flatten()
                coded = pairs.field("term").dictionary_encode()
                vocabulary = Vocabulary(coded.dictionary.to_pylist())
                term, w = coded.indices.to_numpy(), pairs.field("w").to_numpy()
                edge = np.append(0, np.cumsum(pc.list_value_length(entries).to_numpy()))
                n, of, held, tf = texts.count(vocabulary)
                m = 75 + 25 * n[of] * documents // max(total, 1)
                shard = Shard(of, held, 1_000_000_000 * tf // (1000 * tf + 12 * m), texts.size, len(vocabulary.terms))
                where, who, scores = [], [], []
                for q in range(len(entries)):
                    doc, score, _ = shard.best(term[edge[q] : edge[q + 1]], w[edge[q] : edge[q + 1]], k)
                    where += [q] * len(doc)
                    who.append(doc)
                    scores.append(score)
                at_query, who = pa.array(where, pa.int64()), pa.array(np.concatenate(who) if who else [], pa.int64())
                query, item = (table.column(c).combine_chunks().take(at_query) for c in ("query", "item_id"))
                score = pa.array(np.concatenate(scores) if scores else [], pa.int64())
                yield pa.RecordBatch.from_arrays([query, item, rows.column(0).take(who), score], names=["query", "item_id", "doc_id", "score"])

    found = texts.mapInArrow(search, f"query bigint, item_id {kind}, doc_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search_oracle(k: int = 20) -> str:
    """The query's rows in DuckDB SQL."""
    terms = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""
    return f"""
    WITH words AS (
      SELECT doc_id, {terms} FROM documents
    ), tfs AS (
      SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
    ), sizes AS (
      SELECT doc_id, count(*) AS n FROM words GROUP BY ALL
    ), whole AS (
      SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes
    ), weights AS (
      SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, whole GROUP BY term, docs
    ), asked AS (
      SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {terms} FROM benchmark) GROUP BY ALL
    ), scored AS (
      SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
      FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= {k}"""
