"""Ranked lexical search: best-first search of document intervals, bounded by range maxima of posting lists.

1. One pass over the texts counts the terms of the queries in every document; the counts are put at rest, one row for
   each document, with the document's length.
2. Collection statistics (documents, terms, documents of each term) are sums over those rows.
3. Each task reads its rows in blocks of at most BLOCK documents. A block's posting lists hold the impacts, with one
   sparse table for range maxima. For each query the search starts with the interval of the whole block. The sum of the
   lists' maxima over an interval bounds the score of its documents. The intervals of the highest bounds are taken
   first; each is split at its document of maximum impact, which is scored exactly, and the two rests are bounded
   anew. It ends when no bound reaches the k-th score that the task has found, in any of its blocks.
4. Each task gives its k best documents of each query; they are ranked, k at most from each task.

Queries are taken in groups of at most QUERY_BYTES of terms, so what is sent to the tasks is bounded; a larger query set
takes more passes. No posting list is shuffled or collected: a term that a third of all documents hold is as many
short lists as there are blocks.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from riskloom.llm.common import at_rest, mapped, table
from riskloom.llm.encoding import forget

#: Terms are runs of digits, letters and all characters from U+0080 on; only A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))
#: Documents of one index block; its posting lists and their sparse table fit a task's memory.
BLOCK = 16_384
#: Postings of one index block.
BLOCK_POSTINGS = 1_500_000
#: Bytes of distinct terms in one group of queries.
QUERY_BYTES = 4 << 20
#: Intervals that are split at once: few at first, when each split raises the bar, then more.
FEWEST, MOST = 16, 1024


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Posting lists of some documents, by term and document, with a sparse table of the positions of range maxima."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, term))
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        self.n_docs = n_docs
        self.key = term.astype(np.int64) * n_docs + self.doc
        self.start = np.searchsorted(term, np.arange(n_terms + 1)).astype(np.int32)
        longest = int(np.diff(self.start).max(initial=0))
        self.level = np.zeros(longest + 1, np.int8)
        for i in range(1, longest.bit_length()):
            self.level[1 << i:] = i
        self.best = np.zeros((max(1, longest.bit_length()), len(term)), np.int32)
        self.best[0] = np.arange(len(term))
        for i in range(1, longest.bit_length()):
            half = 1 << (i - 1)
            a, b = self.best[i - 1, :-half], self.best[i - 1, half:]
            self.best[i, :-half] = np.where(self.impact[a] >= self.impact[b], a, b)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and impacts of the maxima of postings lo..hi-1, impact 0 where there are none."""
        filled = hi > lo
        level = self.level[np.where(filled, hi - lo, 0)]
        a = self.best[level, np.where(filled, lo, 0)]
        b = self.best[level, np.where(filled, hi - (1 << level.astype(np.int32)), 0)]
        at = np.where(self.impact[a] >= self.impact[b], a, b)
        return at, np.where(filled, self.impact[at], 0)

    def bounded(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For intervals (rows) of some lists (columns): the bound on a document's score, the document to split at."""
        at, impact = self.maxima(lo, hi)
        row = np.arange(len(lo))
        return impact.sum(axis=1), self.doc[at[row, impact.argmax(axis=1)]]

    def search(self, terms: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all that were scored at `bar` or more; every one of the k best is among them, and so
        is every document that ties with the k-th."""
        terms = terms[self.start[terms + 1] > self.start[terms]]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = self.start[terms][None, :], self.start[terms + 1][None, :]
        bound, at = self.bounded(lo, hi)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        base = terms.astype(np.int64)[None, :] * self.n_docs
        width = FEWEST
        while True:
            alive = bound >= bar
            if not alive.any():
                return docs, scores
            if not alive.all():
                lo, hi, bound, at = lo[alive], hi[alive], bound[alive], at[alive]
            if len(bound) > width:
                order = np.argpartition(-bound, width)
                now, later = order[:width], order[width:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            width = min(2 * width, MOST)
            d, low, high = at[now], lo[now], hi[now]
            cut = np.searchsorted(self.key, base + d[:, None]).astype(np.int32)
            there = np.minimum(cut, len(self.key) - 1)
            hit = (cut < high) & (self.doc[there] == d[:, None])
            score = np.where(hit, self.impact[there], 0).sum(axis=1)
            good = score >= bar
            docs, scores = np.concatenate([docs, d[good]]), np.concatenate([scores, score[good]])
            if len(scores) >= k:
                bar = max(bar, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= bar
                docs, scores = docs[keep], scores[keep]
            new_lo, new_hi = np.concatenate([low, cut + hit]), np.concatenate([cut, high])
            new_bound, new_at = self.bounded(new_lo, new_hi)
            keep = new_bound >= bar
            lo, hi = np.concatenate([lo[later], new_lo[keep]]), np.concatenate([hi[later], new_hi[keep]])
            bound, at = np.concatenate([bound[later], new_bound[keep]]), np.concatenate([at[later], new_at[keep]])


def counted(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(key, n, terms, counts) of every document: how many terms it has, and how often those of the vocabulary."""
    number = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        ints = pa.list_(pa.int32())
        for batch in batches:
            sizes, terms, counts = [], [], []
            for x in batch.column(1):
                words = terms_of(x.as_py())
                found = Counter(i for i in map(vocabulary.get, words) if i is not None)
                sizes.append(len(words))
                terms.append(list(found.keys()))
                counts.append(list(found.values()))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, ints),
                                   pa.array(counts, ints)], ["key", "n", "terms", "counts"])

    schema = T.StructType().add("key", number).add("n", "long").add(
        "terms", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.IntegerType()))
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).transform(mapped, run, schema)


def best_documents(postings: DataFrame, queries: Sequence[tuple[int, Sequence[int]]], weights: Sequence[int],
                   n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, key, score): each task's k best documents of each query, all in its part of the postings."""
    weight_of = np.array(weights, np.int64)
    wanted = [(q, np.array(sorted(t), np.int64)) for q, t in queries]
    arrow_key = pa.int64()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, docs, size = [], 0, 0
        for batch in batches:
            at = 0
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                room = int(np.searchsorted(ends, before + max(BLOCK_POSTINGS - size, 0), side="right"))
                to = min(batch.num_rows, at + BLOCK - docs, max(room, at + (not held)))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    docs, size, at = docs + to - at, size + int(ends[to - 1]) - before, to
                if docs >= BLOCK or at < batch.num_rows:
                    yield pa.Table.from_batches(held)
                    held, docs, size = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def index(found: pa.Table) -> tuple[Block, pa.Array]:
        lists = found["terms"].combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term = lists.flatten().to_numpy().astype(np.int64)
        count = found["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 50 + 50 * found["n"].to_numpy().astype(np.int64) * n_docs // n_terms
        row = np.repeat(np.arange(len(lengths)), lengths)
        # Documents stand by their most frequent term, then by length: neighbours score alike, so bounds are tight.
        first = np.zeros(len(lengths), np.int64)
        if len(term):
            top = np.lexsort((-count, row))
            some = np.flatnonzero(lengths)
            first[some] = term[top[(np.cumsum(lengths) - lengths)[some]]]
        order = np.lexsort((m, first))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        impact = weight_of[term] * (1_000_000_000 * count // (1000 * count + 20 * m[row]))
        return (Block(term, place[row], impact, len(weight_of), len(lengths)),
                found["key"].combine_chunks().take(pa.array(order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        # Per query: scores, keys (0 for null) and whether they are null, best first.
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in wanted]
        for found in blocks(batches):
            block, keys = index(found)
            null = keys.is_null().to_numpy(zero_copy_only=False)
            keys = keys.cast(arrow_key).fill_null(0).to_numpy()
            for i, (_, terms) in enumerate(wanted):
                s, v, z = top[i]
                bar = int(s[-1]) if len(s) == k else 1
                d, score = block.search(terms, k, bar)
                s, v, z = np.concatenate([s, score]), np.concatenate([v, keys[d]]), np.concatenate([z, null[d]])
                best = np.lexsort((v, z, -s))[:k]
                top[i] = s[best], v[best], z[best]
        for (q, _), (s, v, z) in zip(wanted, top, strict=True):
            if len(s):
                yield pa.record_batch([pa.array(np.full(len(s), q)), pa.array(v, mask=z), pa.array(s)],
                                      ["query", "key", "score"])

    return postings.transform(mapped, run, "query long, key long, score long")


def _groups(queries: DataFrame, item: str, text: str, limit: int) -> Iterator[list]:
    """The queries in groups of at most `limit` bytes of text (one at least), in the order of their numbers."""
    numbered = queries.select(F.col(item).alias("item"), F.col(text).alias("text")).withColumn(
        "query", F.monotonically_increasing_id())
    numbered = at_rest(numbered, "queries")
    held, size = [], 0
    for r in numbered.toLocalIterator():
        own = sorted(set(terms_of(r["text"])))
        bytes_of = sum(map(len, own))
        if held and size + bytes_of > limit:
            yield held
            held, size = [], 0
        held.append((r["query"], r["item"], own))
        size += bytes_of
    if held:
        yield held


def ranked(docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text",
           item: str = "item_id", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item, rank, key, score): each query's k documents of the highest scores above 0, equal scores by key.

    A query is a row of `queries`: rows that repeat an item, or have none, are ranked by themselves. Its terms count
    once each. A query without terms (null, empty, blanks) finds nothing. Every row of docs is a document; null and
    empty texts are found by nothing, repeated rows are found as often as they are there. Keys are whole numbers; null
    keys come after all others of their score. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    schema = T.StructType().add(item, queries.schema[item].dataType).add("rank", "integer").add(key, "long").add(
        "score", "long")
    parts = []
    for group in _groups(queries, item, text, query_bytes):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, own in group for t in own}))}
        postings = at_rest(counted(docs, vocabulary, key, text), "postings")
        n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not vocabulary:
            continue
        # One row for each term of the group.
        frequency = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = [weight(n_docs, frequency.get(i, 0)) for i in range(len(vocabulary))]
        found = best_documents(postings, [(q, [vocabulary[t] for t in own]) for q, _, own in group], weights, n_docs,
                               n_terms, k)
        order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, i, _ in group], T.StructType().add("query", "long").add(
            item, queries.schema[item].dataType))
        parts.append(at_rest(found.join(names, "query").select(item, "rank", F.col("key").alias(key), "score"),
                             "ranked"))
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part) if out is not None and len(parts) > 1 else part
    return out


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sql() -> str:
    return r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
size as (select doc_id, len(ts) as n from d where len(ts) > 0),
whole as (select count(*) as nd, sum(n)::bigint as nt from size),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
p as (select doc_id, t, count(*) as tf from (select doc_id, unnest(ts) as t from d) group by 1, 2),
f as (select t, count(*) as df from p group by 1),
w as (select t, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double))::bigint as w from f, whole),
s as (select q.item_id, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * size.n * nd) // nt))))
      ::bigint as score from q join p using (t) join w using (t) join size using (doc_id), whole group by 1, 2),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank
      from s where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= 50"""
