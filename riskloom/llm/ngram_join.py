"""N-gram Jaccard join by vertical partitioning.

All n-grams stand in one global order, rare ones first: by document frequency, then by hash. The order is cut by hash
into fragments, so that a document's set becomes short segments and each task counts one fragment of the whole corpus:

1. Words and n-grams are hashed from the UTF-8 bytes in numpy; segments travel as bytes, six for each n-gram.
2. A fragment's task knows the exact frequency of its n-grams. Those of one document only can never be shared: it
   counts them and drops them. For most documents so many are unique that no partner can reach the threshold.
3. The rest keep their shared n-grams. Two linked sets must share one of the first `missing + 1` n-grams of the
   order, where `missing` is how many n-grams of a set its partner may lack: fewer if the partner is no smaller. So
   the smaller set's short prefix meets the larger one's long prefix; these, less the unique n-grams, are the keys of
   the candidate search. Sizes, and how many n-grams of a set are shared with any other, rule out most pairs.
4. First each key links its documents to one of them only, the one with the fewest n-grams of its own. What these links join is one component already, so the
   exhaustive search that follows takes pairs from different components only.
5. For candidate pairs the overlaps of their segments are counted fragment by fragment and summed per pair.

Sets that are equal are one from step 2 on, however many copies there are.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from riskloom.llm.common import at_rest, mapped, partitions, spare, table
from riskloom.llm.components import components
from riskloom.llm.encoding import forget
from riskloom.llm.hashing import BASE, U, mix, powers

#: A set's n-grams are compared in so many fragments; candidates are counted in each and summed.
COUNTING = 4
#: Keys with more documents than this are searched by several tasks.
KEY_BLOCK = 512


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_OF = _BYTE[_LOWER]
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of the texts buffer[offsets[i]:offsets[i + 1]], A-Z as a-z."""
    n = len(buffer)
    black = ~_WHITE[buffer]
    starts, ends = black.copy(), black.copy()
    starts[1:] &= ~black[:-1]
    ends[:-1] &= ~black[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts[inner] |= black[inner]
    ends[inner - 1] |= black[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_OF[buffer] * up[:n], out=sums[1:])
    words = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    return words, np.searchsorted(offsets, s, side="right") - 1


def ngram_sets(buffer: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text. Texts of fewer words have one for all of them, or none."""
    words, owner = word_hashes(buffer, offsets)
    count = np.bincount(owner, minlength=len(offsets) - 1)
    last = np.cumsum(count)
    weights = mix(np.arange(1, n + 1, dtype=np.uint64)) | U(1)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        grams += words[j:j + len(grams)] * weights[j]
    grams = mix(grams)
    out = []
    for c, end in zip(count.tolist(), last.tolist(), strict=True):
        if c >= n:
            own = np.sort(grams[end - c:end - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif c:
            short = (words[end - c:end] * weights[:c]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + U(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _texts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of slices of a text column, some megabytes each; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def set_id(grams: np.ndarray) -> int:
    """64 bits that name a set: equal sets have equal names, also across tasks."""
    return int((mix(grams + BASE).sum(dtype=np.uint64) ^ U(len(grams) * 0x2545F4914F6CDD1D & (1 << 64) - 1))
               .astype(np.int64)) if len(grams) else 0


def set_names(docs: DataFrame, n: int, text: str = "text", name: str = "sid", size: str = "n_shingles") -> DataFrame:
    """docs with the name and the size of every text's n-gram set (0 for texts without words); all rows stay."""
    columns = [c for c in docs.columns if c not in (name, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at, to, buffer, offsets in _texts(batch.column(columns.index(text))):
                sets = ngram_sets(buffer, offsets, n)
                part = batch.slice(at, to - at)
                yield pa.record_batch([*part.columns, pa.array([set_id(s) for s in sets], pa.int64()),
                                       pa.array([len(s) for s in sets], pa.int64())], [*columns, name, size])

    docs = docs.select(columns)
    schema = T.StructType([*docs.schema.fields]).add(name, "long").add(size, "long")
    return docs.transform(mapped, run, schema)


def missing(sizes: np.ndarray, threshold: Fraction, from_larger: bool = False) -> np.ndarray:
    """How many n-grams of a set of each size may be absent from a set that it links with (one no smaller than it).

    The overlap is at least threshold * size, and with a set of the same size or more 2 * threshold / (1 + threshold)
    * size.
    """
    share = 2 * threshold / (1 + threshold) if from_larger else threshold
    return sizes - -(-share.numerator * sizes // share.denominator)


def _six(grams: np.ndarray) -> bytes:
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


BLOBS = ["sids", "sizes", "counts", "grams"]


def _blob(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]], *first: list) -> list:
    return [*first, *zip(*rows, strict=True)]


def segments(texts: DataFrame, n: int, fragments: int, most: int = 500_000) -> DataFrame:
    """(fragment, sids, sizes, counts, grams): for some texts at a time, their sets' segments in one fragment.

    A set that a task has met before is not sent again.
    """
    def flush(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sids = np.array([s for s, _ in held], np.int64)
        sizes = np.array([len(g) for _, g in held], np.int64)
        grams = np.concatenate([g for _, g in held])
        owner = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
        fragment = ((grams >> U(32)) * U(fragments) >> U(32)).astype(np.int32)
        order = np.argsort(fragment, kind="stable")
        grams, owner, fragment = grams[order], owner[order], fragment[order]
        edge = np.flatnonzero(np.diff(fragment)) + 1
        first = np.concatenate([[0], edge])
        rows = []
        for a, b in zip(first.tolist(), [*edge.tolist(), len(grams)], strict=True):
            docs, counts = np.unique(owner[a:b], return_counts=True)
            rows.append((int(fragment[a]), sids[docs].tobytes(), sizes[docs].astype("<i4").tobytes(),
                         counts.astype("<i4").tobytes(), _six(grams[a:b])))
        return pa.record_batch([pa.array(c, t) for c, t in zip(
            zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["fragment", *BLOBS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        met: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for _, _, buffer, offsets in _texts(batch.column(0)):
                for grams in ngram_sets(buffer, offsets, n):
                    name = set_id(grams)
                    if not len(grams) or name in met:
                        continue
                    met.add(name)
                    held.append((name, grams))
                    size += len(grams)
                    if size > most:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return texts.transform(mapped, run, "fragment int, sids binary, sizes binary, counts binary, grams binary")


def shared_grams(parts: DataFrame, groups: int) -> DataFrame:
    """(grp, sids, sizes, unique, counts, grams, df): per fragment and group of sets, the n-grams of two sets or more.

    `unique` counts the n-grams of each set in the fragment that no other set has.
    """
    def count(found: pa.Table) -> pa.Table:
        rows = found.to_pydict()
        sids = np.concatenate([np.frombuffer(b, "<i8") for b in rows["sids"]])
        sizes = np.concatenate([np.frombuffer(b, "<i4") for b in rows["sizes"]])
        counts = np.concatenate([np.frombuffer(b, "<i4") for b in rows["counts"]]).astype(np.int64)
        grams = np.concatenate([_from_six(b) for b in rows["grams"]])
        # Each set once, though several tasks may have sent it.
        _, first = np.unique(sids, return_index=True)
        once = np.zeros(len(sids), bool)
        once[first] = True
        grams = grams[np.repeat(once, counts)]
        sids, sizes, counts = sids[once], sizes[once], counts[once]
        owner = np.repeat(np.arange(len(sids), dtype=np.int32), counts)
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        del order
        new = np.concatenate([[True], grams[1:] != grams[:-1]])
        times = np.diff(np.append(np.flatnonzero(new), len(grams)))
        frequency = np.repeat(times.astype(np.int32), times)
        unique = np.bincount(owner[frequency == 1], minlength=len(sids))
        kept = frequency > 1
        # The fragment is part of what names an n-gram.
        names = mix(grams[kept] + np.array(rows["fragment"][:1], np.uint64) * BASE)
        owner, frequency = owner[kept], frequency[kept]
        group = (mix(sids.astype(np.uint64)) % U(groups)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        names, owner, frequency = names[order], owner[order], frequency[order]
        counts = np.bincount(owner, minlength=len(sids))
        by = np.argsort(group, kind="stable")
        begin = np.cumsum(counts) - counts
        out = []
        for own in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
            take = np.repeat(begin[own] - (np.cumsum(counts[own]) - counts[own]), counts[own]) + np.arange(
                counts[own].sum())
            out.append((int(group[own[0]]), sids[own].tobytes(), sizes[own].astype("<i4").tobytes(),
                        unique[own].astype("<i4").tobytes(), counts[own].astype("<i4").tobytes(),
                        names[take].astype("<u8").tobytes(), frequency[take].astype("<i4").tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 6], strict=True)],
            ["grp", "sids", "sizes", "unique", "counts", "grams", "df"])

    return parts.groupBy("fragment").applyInArrow(
        count, "grp int, sids binary, sizes binary, unique binary, counts binary, grams binary, df binary")


def open_sets(shared: DataFrame, threshold: Fraction) -> DataFrame:
    """(sid, size, shared, short, keys, parts): sets that may have partners.

    shared: how many of their n-grams other sets have. keys: the long prefix, of which the first `short` are the short
    one. parts: COUNTING segments of what is shared.
    """
    def gather(found: pa.Table) -> pa.Table:
        rows = found.to_pydict()
        read = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in rows[c]])
        sids, sizes, unique = read("sids", "<i8"), read("sizes", "<i4"), read("unique", "<i4")
        counts, grams, df = read("counts", "<i4").astype(np.int64), read("grams", "<u8"), read("df", "<i4")
        names, at = np.unique(sids, return_inverse=True)
        size = np.zeros(len(names), np.int64)
        size[at] = sizes
        alone = np.bincount(at, weights=unique, minlength=len(names)).astype(np.int64)
        keys = missing(size, threshold) + 1 - alone
        short = np.maximum(missing(size, threshold, True) + 1 - alone, 0)
        owner = np.repeat(at, counts)
        alive = keys[owner] > 0
        owner, grams, df = owner[alive], grams[alive], df[alive]
        order = np.lexsort((grams, df, owner))
        owner, grams = owner[order], grams[order]
        has = np.bincount(owner, minlength=len(names))
        out = []
        for i, (end, n) in enumerate(zip(np.cumsum(has).tolist(), has.tolist(), strict=True)):
            if n:
                own = grams[end - n:end]
                part = (own % U(COUNTING)).astype(np.int64)
                out.append((int(names[i]), int(size[i]), n, int(short[i]), own[:keys[i]].astype(np.int64),
                            [own[part == p].astype(np.int64) for p in range(COUNTING)]))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        longs = pa.list_(pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(
            columns, [*[pa.int64()] * 4, longs, pa.list_(longs)], strict=True)],
            ["sid", "size", "shared", "short", "keys", "parts"])

    return shared.groupBy("grp").applyInArrow(
        gather, "sid long, size long, shared long, short long, keys array<long>, parts array<array<long>>")


def _links(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose overlaps, counted in each fragment and summed, reach the threshold."""
    parts = sets.select("sid", "size", F.posexplode("parts").alias("part", "grams")).filter(F.size("grams") > 0)
    side = lambda v: parts.select(F.col("sid").alias(v), "part", F.col("grams").alias(f"g{v}"))
    both = (pairs.withColumn("part", F.explode(F.array(*map(F.lit, range(COUNTING)))))
            .join(side("a"), ["a", "part"]).join(side("b"), ["b", "part"]))
    partial = both.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("ga", "gb")).alias("n"))
    total = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
    return total.filter(threshold.denominator * F.col("n") >= threshold.numerator * (
        F.col("size_a") + F.col("size_b") - F.col("n"))).select("a", "b")


def _may_link(threshold: Fraction) -> Column:
    """Whether a and b may link, by their sizes and shared n-grams, and meet in the smaller one's short prefix."""
    up, down = threshold.numerator, threshold.denominator
    a, b = F.col("size_a"), F.col("size_b")
    # |overlap| >= t / (1 + t) * (|a| + |b|), and the overlap is part of what either shares with others.
    enough = (up + down) * F.least("shared_a", "shared_b") >= up * (a + b)
    short = ((a > b) | F.col("short_a")) & ((b > a) | F.col("short_b"))
    return (F.col("a") != F.col("b")) & (down * F.least(a, b) >= up * F.greatest(a, b)) & enough & short


SIDE = ("size", "shared", "short")


def _as_a(c: str) -> Column:
    return F.col(f"{c}_b").alias(f"{c}_a")


def linked_sets(docs: DataFrame, n: int, threshold: Fraction, text: str = "text",
                fragment_bytes: int = 16 << 20) -> DataFrame:
    """(v, root): the components of sets that link with another set; sets without a link are not listed."""
    spark = docs.sparkSession
    texts = docs.select(text)
    total = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    fragments = max(partitions(spark), -(-total // fragment_bytes))
    shared = shared_grams(segments(texts, n, fragments), fragments)
    sets = at_rest(open_sets(shared, threshold), "sets")
    keys = at_rest(sets.select("sid", "size", "shared", "short", F.posexplode("keys").alias("at", "key")).select(
        "key", F.col("sid").alias("b"), F.col("size").alias("size_b"), F.col("shared").alias("shared_b"),
        (F.col("at") < F.col("short")).alias("short_b")), "keys")
    pair = ["a", "b", "size_a", "size_b"]
    # One link for each set and key, to the key's set with the fewest n-grams of its own: the middle of a group of
    # near copies, which all that are near it join at once.
    own = (F.col("size_b") - F.col("shared_b")).alias("own")
    hubs = keys.groupBy("key").agg(F.min(F.struct(own, "b", *[f"{c}_b" for c in SIDE])).alias("h"),
                                   F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "key", F.col("h.b").alias("a"), *[F.col(f"h.{c}_b").alias(f"{c}_a") for c in SIDE])
    stars = keys.join(hubs, "key").filter(_may_link(threshold)).select(*pair).distinct()
    first = at_rest(_links(stars, sets, threshold), "stars")
    joined = components(first)
    # All other pairs that share a key, unless they are in one component already.
    placed = at_rest(keys.join(joined.withColumnRenamed("v", "b"), "b", "left").withColumn(
        "root_b", F.coalesce("root", "b")).drop("root"), "placed")
    mixed = (placed.groupBy("key").agg(F.min("root_b").alias("lo"), F.max("root_b").alias("hi"),
                                       F.count(F.lit(1)).alias("n"), F.max("short_b").alias("any"))
             .filter("lo <> hi and any").select("key", F.ceil(F.col("n") / KEY_BLOCK).cast("int").alias("blocks")))
    split = placed.join(mixed, "key")
    # One side is the smaller, which meets others by its short prefix; of equal sizes, the one of the lesser name.
    left = split.filter("short_b").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).select(
        "key", "block", F.col("b").alias("a"), *map(_as_a, (*SIDE, "root")))
    right = split.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    smaller = F.struct("size_a", "a") < F.struct(F.col("size_b").alias("size_a"), F.col("b").alias("a"))
    rest = (left.join(right, ["key", "block"])
            .filter(smaller & (F.col("root_a") != F.col("root_b")) & _may_link(threshold)).select(*pair).distinct())
    second = _links(rest, sets, threshold)
    return components(first.unionAll(second))


def joined(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): two texts link when the Jaccard similarity of their n-gram sets reaches the
    threshold; component_id is the least key that links lead to.

    A text of fewer than n words has its whole sequence as one n-gram. Texts without words (null, empty, blanks)
    link with nothing: component_id is their own key. Null keys stay; a component's id is null only if all its keys
    are. Repeated rows are repeated in the result. An empty table gives no rows. Other columns are not read.
    """
    named = at_rest(set_names(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), n).drop("text"), "named")
    least = named.filter("n_shingles > 0").groupBy("sid").agg(F.min("key").alias("least"))
    links = linked_sets(docs, n, threshold, text).withColumnRenamed("v", "sid")
    rooted = least.join(links, "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    rooted = at_rest(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(ids, "root").select("sid", "component_id")
    return named.join(found, "sid", "left").select(
        F.col("key").alias(key), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least key (null keys last), of equal keys the least set name.

    Texts without words link with nothing, so all of them stay. Of rows that repeat key and set, one stays. Columns
    stay as they are.
    """
    sid, size, root, copy, least_key, least_set = (
        spare(c, docs.columns) for c in ("_sid", "_size", "_root", "_copy", "_key", "_set"))
    named = at_rest(set_names(docs, n, text, sid, size), "named")
    links = linked_sets(docs, n, threshold, text).select(F.col("v").alias(sid), F.col("root").alias(root))
    first = F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(sid).alias("s")))
    sets = named.filter(F.col(size) > 0).groupBy(sid).agg(first.alias("_first"))
    rooted = sets.join(links, sid, "left").select(F.coalesce(root, sid).alias("root"), "_first")
    chosen = rooted.groupBy("root").agg(F.min("_first").alias("_first")).select(
        F.col("_first.k").alias(least_key), F.col("_first.s").alias(least_set))
    kept = named.join(chosen, (F.col(sid) == F.col(least_set)) & F.col(key).eqNullSafe(F.col(least_key)))
    # Rows of one key and one set are copies of a document; the window holds nothing else.
    only = W.partitionBy(sid, key).orderBy(F.xxhash64(text))
    kept = kept.withColumn(copy, F.row_number().over(only)).filter(F.col(copy) == 1).select(docs.columns)
    return kept.unionByName(named.filter(F.col(size) == 0).select(docs.columns))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"), 4, Fraction(85, 100))


def op2_sql() -> str:
    return r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, case when len(ws) < 4 then array_to_string(ws, ' ')
        else array_to_string(ws[i:i+3], ' ') end as g
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select g from s group by 1 having count(*) > 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join shared using (g) join s b using (g)
      where a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b
          where 100 * i >= 85 * (na.n + nb.n - i)),
reach(doc_id, r) as (select doc_id, doc_id from documents
                     union select l.a, reach.r from links l join reach on l.b = reach.doc_id)
select doc_id, coalesce(max(n.n), 0) as n_shingles, min(r) as component_id
from reach left join n using (doc_id) group by doc_id"""
