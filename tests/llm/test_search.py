"""Ranked search, whitening and sketches: against brute force on small tables."""
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import lexical, minhash, ngram_join, whitening

from .conftest import SCHEMA, edges, prose
from .test_ngram_join import brute, planted

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def best(docs, items, k):
    """Every item's ranking by scoring every document."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    full = [sum(c.values()) for _, c in counts]
    n, total = sum(1 for x in full if x), sum(full)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (d, c), size in zip(counts, full):
            if not size:
                continue
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (
                1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if z else d, -s) for i, (s, z, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "lantern river stone"), (2, None), (3, ""), (4, prose(10, 60)), (4, "one two three"), (None, "THREE cloud"),
         (5, "unheard-of"), (6, "日本語 é́ ß the of and"), (7, prose(77, 400)), (8, " \n. ;")]


@pytest.fixture
def searched(spark):
    rnd = random.Random(3)
    rows = edges() + [(100 + i, prose(i % 150, rnd.randint(1, 200)), *edges()[0][2:]) for i in range(400)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [(r[0], r[1]) for r in rows]


def test_ranked_equals_scoring_everything(spark, searched):
    docs, rows = searched
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in lexical.ranked(docs, items, 20).collect()), key=str)
    assert got == best(rows, ITEMS, 20)


def test_small_blocks_and_query_groups_give_the_same(spark, searched, monkeypatch):
    docs, rows = searched
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in lexical.ranked(docs, items, 20, query_bytes=40).collect()), key=str)
    assert got == best(rows, ITEMS, 20)


def test_search_of_an_index_with_ties():
    rnd = np.random.default_rng(5)
    for n, v in ((1, 1), (2, 3), (70, 9), (400, 25)):
        posted = rnd.random((v, n)) < rnd.random((v, 1))
        impact = rnd.integers(1, 4, (v, n)) * posted
        term, doc = np.nonzero(posted)
        block = lexical.Block(term, doc, impact[term, doc], v, n)
        for k in (1, 3, 50):
            chosen = np.flatnonzero(rnd.random(v) < 0.5)
            whole = impact[chosen].sum(axis=0)
            docs, scores = block.search(chosen, k, 1)
            bar = np.sort(whole)[::-1][min(k, n) - 1]
            want = {(int(d), int(whole[d])) for d in np.flatnonzero(whole >= max(bar, 1))}
            assert want <= set(zip(docs.tolist(), scores.tolist()))
            assert len(set(docs.tolist())) == len(docs) and (whole[docs] == scores).all()


def test_search_of_empty_tables(spark, no_docs, edge_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked(no_docs, items).count() == 0
    none = lexical.ranked(edge_docs, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.ranked(edge_docs, items.filter("item_id in (2, 3, 8)")).count() == 0


def rotated(eigenvalues, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(eigenvalues),) * 2))
    return q @ np.diag(eigenvalues) @ q.T


@pytest.mark.parametrize("eigenvalues", [
    [1.0], [3.0, 1.0], [5.0, 5.0, 5.0], list(range(1, 41)), [1e6, 1.0, 1e-3, 0.0], [2.0] * 6 + [1.0] * 6 + [0.0] * 3,
    [10.0 ** -i for i in range(12)], [1 + 1e-9 * i for i in range(8)], [0.0, 0.0, 0.0]])
def test_spectrum(eigenvalues):
    a = rotated(eigenvalues)
    values, vectors = whitening.spectrum(a)
    scale = max(1e-300, max(eigenvalues))
    assert np.abs(values - np.sort(eigenvalues)[::-1]).max() <= 1e-13 * scale * len(eigenvalues)
    assert np.abs(vectors.T @ vectors - np.eye(len(eigenvalues))).max() < 1e-13 * len(eigenvalues)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * scale


def test_polar_sign():
    a = rotated([-3.0, -1e-6, 2.0, 5.0, 1e3])
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar_sign(a) - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-9


VECTORS = "vec_id long, embedding array<float>, component string, n int, x string"


def vectors(rnd, rows, d):
    mixed = rnd.normal(size=(d, d))
    x = (rnd.normal(size=(rows, d)) @ mixed).astype(np.float32)
    bad = [(9000, None), (9001, [None] * d), (9002, [float("nan")] + [1.0] * (d - 1)),
           (9003, [float("inf")] * d), (9004, []), (9005, [1.0] * (d + 1))]
    good = [(i % (rows - 5), [float(v) for v in row]) for i, row in enumerate(x)] + [(None, [float(v) for v in x[0]])]
    return [(i, v, "c", 1, "x") for i, v in [*good, *bad]], np.array([v for _, v in good])


@pytest.mark.parametrize("rows, d", [(300, 7), (60, 40)])
def test_whitening(spark, rows, d):
    data, kept = vectors(np.random.default_rng(d), rows, d)
    got = whitening.whitened(spark.createDataFrame(data, VECTORS).repartition(3)).collect()
    x = np.floor(kept.astype(np.float32).astype(float) * 64)
    n, centred = len(x), x - x.mean(axis=0)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    shown = min(d, 32)
    assert len(got) == n * shown and {r.n for r in got} == {n}
    whole = x.astype(int) + 1_000_000
    deviation = ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1)
    assert Counter(r.deviation for r in got if r.component == 1) == Counter(deviation.tolist())
    assert max(r.identity_error for r in got) < 1e-9
    y = centred @ basis[:, :shown] / np.sqrt(values[:shown])
    for c in range(shown):
        mine = np.sort([r.whitened for r in got if r.component == c + 1])
        assert min(np.abs(mine - np.sort(y[:, c])).max(), np.abs(mine - np.sort(-y[:, c])).max()) < 1e-7
        one = next(r for r in got if r.component == c + 1)
        assert abs(one.explained - values[c] / values.sum()) < 1e-9
    # One sign for all rows: the components' rows are those of one rotation.
    by_dev = {}
    for r in got:
        by_dev.setdefault(r.deviation, {})[r.component] = r.whitened
    for dev, row in zip(deviation.tolist(), y, strict=True):
        assert np.allclose(np.abs([by_dev[dev][c + 1] for c in range(shown)]), np.abs(row), atol=1e-6)


def test_whitening_of_few_or_flat_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitened(make([])).count() == 0
    assert whitening.whitened(make([(1, None), (2, []), (3, [None])])).count() == 0
    assert whitening.whitened(make([(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whitened(make([(i, [float(i), 3.0]) for i in range(10)])).collect()
    assert len(flat) == 10 and {r.component for r in flat} == {1} and flat[0].explained == 1.0
    assert max(r.identity_error for r in flat) < 1e-12
    # Doubles are vectors as well; an entry too large for exact sums is an error.
    wide = spark.createDataFrame([(1, [1e9]), (2, [2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="not exact"):
        whitening.whitened(wide).collect()


@pytest.mark.parametrize("n, threshold, k", [(5, Fraction(85, 100), 128), (5, Fraction(4, 5), 128),
                                             (5, Fraction(85, 100), 64)])
def test_sketches_equal_brute_force(spark, n, threshold, k):
    rows = planted() + [(k_, t) for k_, t, *_ in edges()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit(1)).repartition(5)
    got = minhash.near_duplicates(df, n, threshold, k=k).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n, threshold)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_of_a_list_give_the_same(spark, monkeypatch):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "LIST_BLOCK", 3)
    got = minhash.near_duplicates(df, 5, Fraction(85, 100)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 5, Fraction(85, 100))


def test_sketches_of_empty_table(spark, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_needed_bounds_the_tail(spark):
    t, k = Fraction(85, 100), 128
    # All ways to draw 20 of 30, of which 26 are common: fewer than x common in at most the share allowed.
    x = minhash.least_shared(30, 20, t, Fraction(1, 100))
    ways = Counter({c: math.comb(26, c) * math.comb(4, 20 - c) for c in range(16, 21)})
    below = lambda x: sum(w for c, w in ways.items() if c < x) / math.comb(30, 20)
    assert below(x) <= 0.01 < below(x + 1)
    # A union within k is drawn whole.
    assert minhash.least_shared(100, k, t) == 85
    # The steps never ask for more than their largest set's bound, nor for more than what a set must share in full.
    sizes = list(range(1, 700)) + [1000, 3000, 8000, 9000, 50_000, 10 ** 6]
    asked = spark.createDataFrame([(s,) for s in sizes], "s long").select(
        "s", minhash.needed(F.col("s"), k, t).alias("x")).collect()
    for s, x in asked:
        assert x <= -(-85 * s // 100) and x <= minhash.least_shared(int(s / t), k, t)
    assert min(x for s, x in asked if s > 128) >= 81
