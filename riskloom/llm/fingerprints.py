"""Document fingerprints: an invertible Bloom lookup table of paragraph digests. DataFrame functions only.

A text's paragraphs (lines, cut further after sentence ends) are hashed; each distinct digest is put into three cells
of a small table, one in each third. The tables of two versions subtract cell by cell: common paragraphs vanish, and
peeling the cells that hold a single digest recovers those that differ. Where peeling gets stuck, it is tried again
with tables that are large enough for all paragraphs of both sides, and each of those that gets stuck with other
cells, twice as many each time. All of it is a projection without a shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from riskloom.llm.common import bounds_of, bucket_of, let, partitions, table

#: Cells of a third of the published table: it decodes differences of some twenty paragraphs.
THIRD = 12
#: On failure: cells of a third, and digests of both sides for each table.
LARGER = 16
PER_TABLE = 16
#: Tries of a table of the larger ones, each with another seed and twice the cells of the try before.
TRIES = 4
#: Rounds of peeling in a table; each round removes every digest that stands alone in some cell.
ROUNDS = 12
#: Where paragraphs end.
PARAGRAPHS = r"\n+|(?<=[.!?]) +"


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs; none for an empty text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPHS), lambda p: p != ""),
                                        lambda p: F.xxhash64(p)))


def _cell(digest: Column, third: int, size: int, seed: int = 0) -> Column:
    """The digest's cell in one third of a table; seed 0 takes the digest's own bits."""
    if seed:
        digest = F.xxhash64(digest, F.lit(1000 + seed))
    return F.lit(third * size) + F.pmod(F.shiftrightunsigned(digest, 20 * third), F.lit(size)).cast("int")


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(7))


def _is(column: Column, name: str) -> Column:
    return column.alias(name)


def cells(found: Column, size: int = THIRD, seed: int = 0) -> Column:
    """3 * size structs (n, key, check): how many digests a cell holds, their xor, and the xor of their checks."""
    entries = F.transform(found, lambda d: F.struct(
        _is(d, "key"), _is(_check(d), "check"), *[_is(_cell(d, t, size, seed), f"c{t}") for t in range(3)]))
    zero = F.lit(0).cast("long")
    nothing = F.struct(_is(F.lit(0), "n"), _is(zero, "key"), _is(zero, "check"))

    def third(rows: Column, t: int) -> Column:
        return F.transform(F.sequence(F.lit(t * size), F.lit((t + 1) * size - 1)), lambda c: F.aggregate(
            F.filter(rows, lambda e: e[f"c{t}"] == c), nothing,
            lambda a, e: F.struct(_is(a["n"] + 1, "n"), _is(a["key"].bitwiseXOR(e["key"]), "key"),
                                  _is(a["check"].bitwiseXOR(e["check"]), "check"))))

    return let(entries, lambda rows: F.concat(*[third(rows, t) for t in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    """The table of the digests that only one side has; n counts those of a up and those of b down."""
    return F.zip_with(a, b, lambda x, y: F.struct(
        _is(x["n"] - y["n"], "n"), _is(x["key"].bitwiseXOR(y["key"]), "key"),
        _is(x["check"].bitwiseXOR(y["check"]), "check")))


def peeled(difference: Column, size: int = THIRD, seed: int = 0) -> Column:
    """(left, found): the cells after peeling, all zero on success, and the recovered (sign, key) structs."""
    empty = F.array().cast("array<struct<sign:int,key:bigint>>")

    def alone(left: Column) -> Column:
        return F.array_distinct(F.transform(
            F.filter(left, lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"]))),
            lambda c: F.struct(_is(c["n"], "sign"), _is(c["key"], "key"))))

    def without(left: Column, single: Column) -> Column:
        placed = F.transform(single, lambda s: F.struct(
            _is(s["sign"], "sign"), _is(s["key"], "key"), _is(_check(s["key"]), "check"),
            *[_is(_cell(s["key"], t, size, seed), f"c{t}") for t in range(3)]))
        return let(placed, lambda rows: F.transform(left, lambda c, i: F.aggregate(
            F.filter(rows, lambda s: (s["c0"] == i) | (s["c1"] == i) | (s["c2"] == i)), c,
            lambda a, s: F.struct(_is(a["n"] - s["sign"], "n"), _is(a["key"].bitwiseXOR(s["key"]), "key"),
                                  _is(a["check"].bitwiseXOR(s["check"]), "check")))))

    def step(state: Column) -> Column:
        return let(alone(state["left"]), lambda single: F.when(F.size(single) == 0, state).otherwise(F.struct(
            _is(without(state["left"], single), "left"), _is(F.concat(state["found"], single), "found"))))

    start = F.struct(_is(difference, "left"), _is(empty, "found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: step(state))


def stuck(result: Column) -> Column:
    """Whether peeling left digests behind."""
    return F.exists(result["left"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))


def one_sided(a: Column, b: Column) -> Column:
    """The (sign, key) structs by comparing the arrays: for a table that no try could peel."""
    def only(sign: int, x: Column, y: Column) -> Column:
        return F.transform(F.array_except(x, y), lambda k: F.struct(_is(F.lit(sign), "sign"), _is(k, "key")))

    return F.concat(only(1, a, b), only(-1, b, a))


def attempt(a: Column, b: Column, k: int) -> Column:
    """(tries, a, b, found) of the k-th try of a table: a and b stay for the next try if it gets stuck, else found."""
    size, none = LARGER << k, F.lit(None)
    return let(peeled(subtract(cells(a, size, k), cells(b, size, k)), size, k), lambda r: F.when(
        stuck(r), F.struct(_is(F.lit(k + 1), "tries"), _is(a, "a"), _is(b, "b"),
                           _is(none.cast("array<struct<sign:int,key:bigint>>"), "found"))).otherwise(
        F.struct(_is(F.lit(k), "tries"), _is(none.cast("array<bigint>"), "a"), _is(none.cast("array<bigint>"), "b"),
                 _is(r["found"], "found"))))


def again(tables: Column, k: int) -> Column:
    """The tables with the k-th try of those that are stuck."""
    return F.transform(tables, lambda t: F.when(t["found"].isNull(), attempt(t["a"], t["b"], k)).otherwise(t))


def larger(a: Column, b: Column) -> Column:
    """The first try of tables that are large enough for all digests of both sides.

    The large table is many small ones of LARGER cells a third, each for its share of the digests, some PER_TABLE of
    both sides together. Shares are cut twice, so that a side of n digests is read about 2 * sqrt(n) times at most.
    """
    tables = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / PER_TABLE).cast("int"))
    shares = let(tables, lambda t: let(F.ceil(F.sqrt(t)).cast("int"), lambda root: F.transform(
        F.sequence(F.lit(0), root - 1), lambda i: F.struct(
            _is(i, "i"), _is(root, "root"),
            _is(F.filter(a, lambda d: F.pmod(F.xxhash64(d), root) == i), "a"),
            _is(F.filter(b, lambda d: F.pmod(F.xxhash64(d), root) == i), "b")))))

    def table_of(s: Column, j: Column) -> Column:
        def mine(side: Column) -> Column:
            return F.filter(side, lambda d: F.pmod(F.xxhash64(d, F.lit(1)), s["root"]) == j)

        return F.struct(_is(mine(s["a"]), "a"), _is(mine(s["b"]), "b"))

    pairs = F.flatten(F.transform(shares, lambda s: F.transform(
        F.sequence(F.lit(0), s["root"] - 1), lambda j: table_of(s, j))))
    return F.transform(pairs, lambda t: attempt(t["a"], t["b"], 0))


def tried(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """df with the peeled published tables as `_name`, and as `_name_larger` the larger tables after all tries."""
    df = df.withColumns({f"_{n}": peeled(subtract(F.col(a)["cells"], F.col(b)["cells"])) for n, (a, b) in pairs.items()})
    df = df.withColumns({f"_{n}_larger": F.when(stuck(F.col(f"_{n}")), larger(F.col(a)["keys"], F.col(b)["keys"]))
                         for n, (a, b) in pairs.items()})
    for k in range(1, TRIES):
        df = df.withColumns({f"_{n}_larger": again(F.col(f"_{n}_larger"), k) for n in pairs})
    return df


def compared(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """df with, for each name, the (sign, key) structs of the digests that one of two fingerprint columns lacks.

    First the two published tables are subtracted and peeled; where that gets stuck, the larger ones decide.
    """
    return tried(df, pairs).withColumns({n: F.when(F.col(f"_{n}_larger").isNotNull(), F.flatten(F.transform(
        f"_{n}_larger", lambda t: F.coalesce(t["found"], one_sided(t["a"], t["b"]))))).otherwise(
        F.col(f"_{n}")["found"]) for n in pairs}).drop(*[f"_{n}{end}" for n in pairs for end in ("", "_larger")])


def likeness(a: Column, b: Column, difference: Column) -> Column:
    """Jaccard similarity of two fingerprints by their sizes and their difference; 1 if neither has a paragraph."""
    both, n = F.size(a["keys"]) + F.size(b["keys"]), F.size(difference)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - n) / (both + n))


def fingerprint(text: Column) -> Column:
    """A struct of a text's paragraph digests and the cells of its first table; null counts as empty."""
    return let(digests(F.coalesce(text, F.lit(""))), lambda k: F.struct(k.alias("keys"), cells(k).alias("cells")))


def written(print_: Column) -> Column:
    """The fingerprint as text: its number of paragraphs, then count, digests and checks of each cell."""
    return F.concat_ws(":", F.size(print_["keys"]).cast("string"), F.array_join(F.transform(
        print_["cells"], lambda c: F.concat(c["n"].cast("string"), F.lit("."), F.lower(F.hex(c["key"])), F.lit("."),
                                            F.lower(F.hex(c["check"])))), ","))


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """docs with `next`, a struct of the columns of the row that follows in key order; after the last: the first.

    Rows go to quantile ranges of the key, where a window finds the next row; the last of a range takes the first of
    the next range, from a table with a row for each range. Null keys come first, equal keys by text.
    """
    bounds = bounds_of(docs, key, 4 * partitions(docs.sparkSession))
    order = [F.col(key).asc_nulls_first(), *columns]
    rows = docs.withColumn("_range", bucket_of(key, bounds))
    within = W.partitionBy("_range").orderBy(*order)
    follow = F.struct(*columns)
    heads = rows.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull().alias("k"), F.col(key), *columns))
                                       .alias("_h"))
    firsts = heads.select("_range", F.struct(*[F.col(f"_h.{c}") for c in columns]).alias("_head"))
    ranges = W.orderBy("_range")  # a row for each range: four for each shuffle partition
    across = firsts.select("_range", F.coalesce(F.lead("_head").over(ranges), F.first("_head").over(
        ranges.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_head"))
    return (rows.withColumn("_lead", F.lead(follow).over(within)).join(across, "_range")
            .withColumn("next", F.coalesce("_lead", "_head")).drop("_lead", "_head", "_range"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint against its edited text's and the next document's.

    Null texts are empty; equal ids are ordered by text, null ids come first; a lone document is its own next.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", ["text"])
    n = F.length("text")
    changed = F.floor(n / 4).cast("int")
    after = F.col("next.text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - changed), F.substring(after, F.lit(1), changed))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
                       fingerprint(F.col("text")).alias("own"), fingerprint(edited).alias("changed"),
                       fingerprint(after).alias("after"))
    rows = compared(rows, {"d_edited": ("own", "changed"), "d_next": ("own", "after")})
    return rows.select("doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"),
                       written(F.col("changed")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("changed"), F.col("d_edited")).alias("near_edited"),
                       likeness(F.col("own"), F.col("after"), F.col("d_next")).alias("near_next"))
