import hashlib
import random
import re

from pyspark.sql import functions as F

from riskloom.llm import fingerprints as fp

from .conftest import edges


def paragraphs(text):
    return {p for p in re.split(r"\n+|(?<=[.!?]) +", text or "") if p}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_query_equals_brute_force(spark, edge_docs, table_dir):
    got = fp.op1_fingerprints(spark, table_dir(documents=edge_docs)).collect()
    rows = sorted(((k is not None, k or 0, t or "") for k, t, *_ in edges()))
    want = []
    for i, (known, k, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][2]
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        want.append((k if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                     round(jaccard(paragraphs(text), paragraphs(edited)), 9),
                     round(jaccard(paragraphs(text), paragraphs(after)), 9)))
    have = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(have, key=key) == sorted(want, key=key)
    by_text = {}
    texts = {(k, len(t)): t for _, k, t in rows if k}
    for r in got:
        if (t := texts.get((r.doc_id, r.n_chars))) is not None:
            by_text.setdefault(t, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({r.fingerprint for r in got}) > 10


def test_empty_and_lone(spark, no_docs, edge_docs, table_dir):
    assert fp.op1_fingerprints(spark, table_dir(documents=no_docs)).count() == 0
    one = edge_docs.filter("doc_id = 12")
    row = fp.compared(one.select(fp.fingerprint(F.col("text")).alias("a"), fp.fingerprint(F.col("text")).alias("b")),
                      {"d": ("a", "b")}).select(fp.likeness(F.col("a"), F.col("b"), F.col("d"))).first()
    assert row[0] == 1.0


def test_peeling_recovers_the_digests(spark):
    """Differences of every size, by the first table where it is large enough and by larger ones otherwise."""
    rnd = random.Random(1)
    rows, want = [], []
    for n in (0, 1, 2, 5, 12, 20, 40, 150, 700):
        common = [rnd.getrandbits(63) for _ in range(100)]
        a, b = ([rnd.getrandbits(63) for _ in range(n)] for _ in range(2))
        rows.append((n, common + a, b + common))
        want.append({(1, x) for x in a} | {(-1, x) for x in b})
    df = spark.createDataFrame(rows, "n int, a array<long>, b array<long>")
    df = df.select("n", *[F.struct(F.col(c).alias("keys"), fp.cells(F.col(c)).alias("cells")).alias(c) for c in "ab"])
    got = {r.n: {(x.sign, x.key) for x in r.d} for r in fp.compared(df, {"d": ("a", "b")}).collect()}
    assert [got[r[0]] for r in rows] == want
    first = df.filter("n = 5").select(fp.stuck(fp.peeled(fp.subtract(F.col("a.cells"), F.col("b.cells"))))).first()[0]
    assert first is False
    failed = df.filter("n = 40").select(fp.stuck(fp.peeled(fp.subtract(F.col("a.cells"), F.col("b.cells"))))).first()[0]
    assert failed is True


def test_stuck_table_is_retried_larger(spark, monkeypatch):
    """Two digests that share all three cells are told apart by another seed, not by comparing the digests."""
    nothing = F.array().cast("array<struct<sign:int,key:bigint>>")
    monkeypatch.setattr(fp, "one_sided", lambda a, b: nothing)
    one = 5 | 5 << 20 | 5 << 40
    two = one + fp.THIRD * fp.LARGER
    df = spark.createDataFrame([([one, two], [7])], "a array<long>, b array<long>")
    df = df.select(*[F.struct(F.col(c).alias("keys"), fp.cells(F.col(c)).alias("cells")).alias(c) for c in "ab"])
    got = fp.compared(df, {"d": ("a", "b")}).first().d
    assert {(x.sign, x.key) for x in got} == {(1, one), (1, two), (-1, 7)}
