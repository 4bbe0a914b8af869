"""Near-duplicate documents by bottom-k sketches.

1. One hash function orders all shingles. A document's sketch is the K least hashes of its set, its retained values. Equal
   sets are one from here on, however many copies there are.
2. Inverted lists: the documents that retain a value. Two linked sets share at least `needed` retained values, so of each
   sketch only the rarest size - needed + 1 values need lists: every linked pair meets in one of them.
3. Each list first links its members to one of them only, the one that shares most of its values with others. What
   these links join is one component already; the search of all pairs of a list then takes pairs of different
   components only, in blocks, so that no list is a single task's work. Before it, sets that share too few of all
   their shingles with any others in such lists are put aside: they have no partner.
4. A candidate pair's union sketch, the K least hashes of both, estimates the Jaccard similarity: the share of its
   values that both retain. Pairs far below the threshold go.
5. The others are verified on the full sets, which are made from the texts of the candidates alone.

Sets of at most K shingles are their own sketches, so the bounds on them are exact. For larger ones `needed` leaves a
linked pair a chance of less than ERROR to be missed; it falls fast above the threshold.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.llm.common import at_rest, mapped, table
from riskloom.llm.components import components
from riskloom.llm.encoding import forget
from riskloom.llm.ngram_join import _texts, ngram_sets, set_id

#: Retained values of a sketch.
K = 128
#: The chance that a pair at the threshold falls below the bound on shared values.
ERROR = Fraction(1, 10 ** 9)
#: Members of a list that one task compares.
LIST_BLOCK = 512
#: Rare shingles that a set carries for a quick look at a pair. Sets that need more go without that look.
MOST_RARE = 256


#: Sets of a size are bounded as the largest of their step; each step is larger by this.
STEP = 1.1


@cache
def least_shared(union: int, k: int, threshold: Fraction, error: Fraction = ERROR) -> int:
    """The most x such that two sets of so large a union, at the threshold, share fewer than x of its k least hashes
    with a chance of at most `error`: k draws without replacement."""
    common = -(-threshold.numerator * union // threshold.denominator)
    drawn = min(k, union)
    low = max(0, drawn - (union - common))
    ways, bar = 0, error * comb(union, drawn)
    for x in range(low, min(drawn, common) + 1):
        ways += comb(common, x) * comb(union - common, drawn - x)
        if ways > bar:
            return x
    return min(drawn, common)


@cache
def steps(k: int, threshold: Fraction) -> tuple[list[int], list[int]]:
    """Ascending sizes, and for sets of at most that size (more than the one before) the least share of their sketch.

    A partner's union with a set of size s has s / threshold shingles at most; for smaller ones the share is larger.
    The last step holds for all larger sizes: it takes the limit, draws with replacement.
    """
    sizes, least = [k], []
    while sizes[-1] < 64 * k:
        sizes.append(int(sizes[-1] * STEP))
    for s in sizes:
        least.append(least_shared(int(s / threshold), k, threshold))
    t, below = threshold, Fraction(0)
    limit = next(x for x in range(k + 1) if (below := below + comb(k, x) * t ** x * (1 - t) ** (k - x)) > ERROR)
    return sizes, [*least, limit]


def needed(size: Column, k: int, threshold: Fraction) -> Column:
    """How many retained values a set of this size shares with any partner, but for a chance of ERROR.

    Where the union is within k, it is the whole overlap: at least the threshold's share of the set.
    """
    own = F.ceil(size * threshold.numerator / F.lit(threshold.denominator)).cast("long")
    sizes, least = steps(k, threshold)
    at = F.when(size <= k, 0).otherwise(F.least(F.lit(len(sizes)), F.ceil(
        F.log(size / F.lit(float(k))) / F.lit(float(np.log(STEP)))).cast("int") + 1))
    return F.least(own, F.element_at(F.array(*[F.lit(x) for x in least]), at + 1).cast("long"))


def sketches(docs: DataFrame, n: int, k: int, key: str, text: str) -> DataFrame:
    """(key, sid, size, sketch) of every row: the name of its set, its size, and its k least hashes, ascending.

    A set that a task has met before has a null sketch.
    """
    number = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        met: set[int] = set()
        longs = pa.list_(pa.int64())
        for batch in batches:
            for at, to, buffer, offsets in _texts(batch.column(1)):
                names, sizes, kept = [], [], []
                for grams in ngram_sets(buffer, offsets, n):
                    name = set_id(grams)
                    names.append(name)
                    sizes.append(len(grams))
                    # Sets are sorted as unsigned numbers; the top bit turned keeps that order among signed ones.
                    kept.append(None if name in met or not len(grams) else
                                (grams[:k] ^ np.uint64(1 << 63)).view(np.int64))
                    met.add(name)
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array(names, pa.int64()),
                                       pa.array(sizes, pa.int64()), pa.array(kept, longs)],
                                      ["key", "sid", "size", "sketch"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).transform(
        mapped, run, f"key {number}, sid long, size long, sketch array<long>")


def _first_texts(docs: DataFrame, n: int, text: str) -> DataFrame:
    """(sid, text): the texts that have words, with the names of their sets; of a set that a task has met, no more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        met: set[int] = {0}
        for batch in batches:
            for at, to, buffer, offsets in _texts(batch.column(0)):
                names, new = [], []
                for grams in ngram_sets(buffer, offsets, n):
                    names.append(set_id(grams) if len(grams) else 0)
                    new.append(names[-1] not in met)
                    met.add(names[-1])
                part = pa.record_batch([pa.array(names, pa.int64()), batch.column(0).slice(at, to - at)],
                                       ["sid", "text"])
                yield part.filter(pa.array(new))

    return docs.select(F.col(text).alias("text")).transform(mapped, run, "sid long, text string")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int, text: str) -> DataFrame:
    """(id, grams): all hashes of the sets of wanted(id, sid), ascending, made from the texts again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at, to, buffer, offsets in _texts(batch.column(1)):
                sets = [g.view(np.int64) for g in ngram_sets(buffer, offsets, n)]
                yield pa.record_batch([batch.column(0).slice(at, to - at),
                                       pa.array(sets, pa.list_(pa.int64()))], ["id", "grams"])

    one = _first_texts(docs, n, text).join(wanted, "sid").groupBy("sid").agg(
        F.first("id").alias("id"), F.first("text").alias("text"))
    return one.select("id", "text").transform(mapped, run, "id long, grams array<long>")


def _share(both: Column, a: Column, b: Column, threshold: Fraction) -> Column:
    """Whether `both` of sets of a and b values reach the threshold."""
    return threshold.denominator * both >= threshold.numerator * (a + b - both)


def _estimated(pairs: DataFrame, sets: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """The pairs whose union sketch does not rule them out. Sets within k values are compared exactly by it."""
    side = lambda v: sets.select(F.col("id").alias(v), F.col("sketch").alias(f"s{v}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    least = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), least))
    whole = F.greatest("size_a", "size_b") <= k
    exact = _share(F.size(F.array_intersect("sa", "sb")), F.col("size_a"), F.col("size_b"), threshold)
    enough = both >= needed(F.least("size_a", "size_b"), k, threshold)
    return met.filter(F.when(whole, exact).otherwise(enough)).select("a", "b", "size_a", "size_b")


def _verified(pairs: DataFrame, grams: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs that link, by their full sets."""
    side = lambda v: grams.select(F.col("id").alias(v), F.col("grams").alias(f"g{v}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.filter(_share(F.size(F.array_intersect("ga", "gb")), F.col("size_a"), F.col("size_b"),
                             threshold)).select("a", "b")


def _may_link(threshold: Fraction, k: int) -> Column:
    """Whether sizes and the numbers of values shared with any other sketch let a and b link."""
    a, b = F.col("size_a"), F.col("size_b")
    up, down = threshold.numerator, threshold.denominator
    shared = F.least("shared_a", "shared_b")
    whole = _within(shared, a, b, threshold)
    return ((F.col("a") != F.col("b")) & (down * F.least(a, b) >= up * F.greatest(a, b))
            & (shared >= needed(F.least(a, b), k, threshold)) & ((F.greatest(a, b) > k) | whole))


def _lists(sets: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """(value, id, size, shared): the inverted lists that candidates need, of values that two sketches or more retain.

    sets: id, size, sketch.
    """
    posts = sets.select("id", "size", F.explode("sketch").alias("value"))
    frequency = at_rest(posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "values")
    by_set = (posts.join(frequency, "value").groupBy("id", "size")
              .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))
              # Values of this sketch alone come first in the order and have no list.
              .select("id", "size", F.size("values").alias("shared"), "values",
                      (F.size("values") - needed(F.col("size"), k, threshold) + 1).cast("int").alias("first")))
    return by_set.filter("first > 0").select(
        "id", "size", "shared", F.explode(F.slice("values", F.lit(1), F.least("first", F.size("values")))).alias("v")
    ).select(F.col("v.value").alias("value"), "id", "size", "shared")


def _mixed(placed: DataFrame) -> DataFrame:
    """(value, blocks) of the lists whose members are in several components."""
    return placed.groupBy("value").agg(F.min("root_b").alias("lo"), F.max("root_b").alias("hi"),
                                       F.count(F.lit(1)).alias("m")).filter("lo <> hi").select(
        "value", F.ceil(F.col("m") / LIST_BLOCK).cast("int").alias("blocks"))


def _within(shared: Column, a: Column, b: Column, threshold: Fraction) -> Column:
    """Whether sets of sizes a and b that share at most `shared` can reach the threshold."""
    return (threshold.numerator + threshold.denominator) * shared >= threshold.numerator * (a + b)


def _with_partners(placed: DataFrame, grams: DataFrame, threshold: Fraction) -> DataFrame:
    """placed, with full_b, how many of a set's shingles, of all, other sets of placed have, and rare_b, its rarest.

    Sets of too many shingles of their own have no partner there, and go. Two linked sets share one of the rarest that
    are left to either when all but the least overlap are taken away; rare_b holds these, or null where they are many.
    The overlap is larger with a partner that is no smaller: then the first brief_b of them will do.
    """
    asked = placed.select(F.col("b").alias("id"), "size_b").distinct()
    posts = grams.join(asked, "id").select("id", "size_b", F.explode("grams").alias("gram"))
    several = at_rest(posts.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "several")
    def overlap(share: Fraction) -> Column:
        return F.ceil(F.col("size_b") * share.numerator / F.lit(share.denominator)).cast("int")

    rarest = F.transform(F.slice("grams", F.lit(1), F.col("spare")), lambda g: g["gram"])
    full = posts.join(several, "gram").groupBy("id", "size_b").agg(
        F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams")).select(
        F.col("id").alias("b"), F.size("grams").alias("full_b"), "grams",
        (F.size("grams") - overlap(threshold) + 1).alias("spare"),
        F.greatest(F.lit(0), F.size("grams") - overlap(2 * threshold / (1 + threshold)) + 1).alias("brief_b"))
    return placed.join(full.filter("spare > 0").select(
        "b", "full_b", "brief_b", F.when(F.col("spare") <= MOST_RARE, rarest).alias("rare_b")), "b")


def _meet() -> Column:
    """Whether a and b share one of their rarest shingles, as far as they carry them."""
    def side(v: str, other: str) -> Column:
        rare = F.col(f"rare_{v}")
        return F.when(F.col(f"size_{v}") <= F.col(f"size_{other}"), F.slice(rare, F.lit(1), F.col(f"brief_{v}"))
                      ).otherwise(rare)

    return F.coalesce(F.arrays_overlap(side("a", "b"), side("b", "a")), F.lit(True))


def links(docs: DataFrame, n: int, threshold: Fraction, key: str, text: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(key, sid, size) of every row, and the components (v, root) of the names of sets that link with another."""
    found = at_rest(sketches(docs, n, k, key, text), "sketches")
    named = found.select("key", "sid", "size")
    # One sketch for each set, under a short number.
    sets = at_rest(found.filter(F.col("sketch").isNotNull()).groupBy("sid").agg(
        F.first("size").alias("size"), F.first("sketch").alias("sketch")).withColumn(
        "id", F.monotonically_increasing_id()), "sets")
    lists = at_rest(_lists(sets, k, threshold), "lists")
    wanted = sets.join(lists.select("id").distinct(), "id", "left_semi").select("id", "sid")
    grams = at_rest(full_sets(docs, wanted, n, text), "grams")
    pair = ["a", "b", "size_a", "size_b"]
    as_b = lists.select("value", F.col("id").alias("b"), F.col("size").alias("size_b"),
                        F.col("shared").alias("shared_b"))
    # One link for each list and member, to the member with the fewest values of its own.
    own = F.least("size", F.lit(k)) - F.col("shared")
    hubs = lists.groupBy("value").agg(F.min(F.struct(own.alias("own"), "id", "size", "shared")).alias("h"),
                                      F.count(F.lit(1)).alias("m")).filter("m > 1").select(
        "value", F.col("h.id").alias("a"), F.col("h.size").alias("size_a"), F.col("h.shared").alias("shared_a"))
    stars = as_b.join(hubs, "value").filter(_may_link(threshold, k)).select(pair).distinct()
    stars = at_rest(_estimated(stars, sets, k, threshold), "stars")
    first = at_rest(_verified(stars, grams, threshold), "links")
    joined = components(first)
    # Pairs of a list that are not in one component already.
    placed = at_rest(as_b.join(joined.withColumnRenamed("v", "b"), "b", "left").withColumn(
        "root_b", F.coalesce("root", "b")).drop("root"), "placed")
    open_ = at_rest(placed.join(_mixed(placed).select("value"), "value"), "open")
    open_ = at_rest(_with_partners(open_, grams, threshold), "partners")
    # A pair is taken in the first list only of those that both are in.
    mixed = at_rest(open_.join(_mixed(open_), "value"), "mixed")
    in_lists = mixed.groupBy("b").agg(F.sort_array(F.collect_set("value")).alias("lists_b"))
    split = mixed.join(in_lists, "b")
    left = split.withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).select(
        "value", "block", *[F.col(f"{c}b").alias(f"{c}a") for c in (
            "", "size_", "shared_", "root_", "full_", "brief_", "rare_",
            "lists_")])
    right = split.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    rest = left.join(right, ["value", "block"]).filter(
        (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _may_link(threshold, k)
        & _within(F.least("full_a", "full_b"), F.col("size_a"), F.col("size_b"), threshold)
        & _meet() & (F.element_at(F.array_intersect("lists_a", "lists_b"), 1) == F.col("value")))
    rest = at_rest(_estimated(rest.select(pair), sets, k, threshold), "rest")
    second = _verified(rest, grams, threshold)
    roots = components(first.unionAll(second))
    name = sets.select("id", "sid")
    return named, (roots.join(name.select(F.col("id").alias("v"), F.col("sid").alias("_s")), "v")
                   .join(name.select(F.col("id").alias("root"), F.col("sid").alias("_r")), "root")
                   .select(F.col("_s").alias("v"), F.col("_r").alias("root")))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), key: str = "doc_id",
                    text: str = "text", k: int = K) -> DataFrame:
    """(key, n_shingles, component_id, kept): texts link when the Jaccard similarity of their n-word shingle sets
    reaches the threshold; component_id is the least key that links lead to, and kept marks the rows of that key.

    A text of fewer than n words has its whole sequence as one shingle. Texts without words (null, empty, blanks) link
    with nothing: component_id is their own key, and they are kept. Null keys stay, with the component of their text;
    kept is true where the component has no other key. Repeated rows are repeated. An empty table gives no rows. Other
    columns are not read.
    """
    named, linked = links(docs, n, threshold, key, text, k)
    least = named.filter("size > 0").groupBy("sid").agg(F.min("key").alias("least"))
    rooted = at_rest(least.join(linked.withColumnRenamed("v", "sid"), "sid", "left").select(
        "sid", "least", F.coalesce("root", "sid").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(ids, "root").select("sid", "component_id")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("key"))
    return named.join(found, "sid", "left").select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"), component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 5, Fraction(85, 100))


def op13_sql() -> str:
    return r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ')
        else array_to_string(ws[i:i+4], ' ') end as g
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select g from s group by 1 having count(*) > 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join shared using (g) join s b using (g)
      where a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b
          where 100 * i >= 85 * (na.n + nb.n - i)),
reach(doc_id, r) as (select doc_id, doc_id from documents
                     union select l.a, reach.r from links l join reach on l.b = reach.doc_id)
select doc_id, coalesce(max(n.n), 0) as n_shingles, min(r) as component_id, min(r) = doc_id as kept
from reach left join n using (doc_id) group by doc_id"""
