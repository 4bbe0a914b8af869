import re
from fractions import Fraction

import numpy as np
import pytest

from riskloom.llm import ngram_join as nj
from riskloom.llm.components import components

from .conftest import SCHEMA, edges, prose


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, threshold):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and Fraction(both, len(a | sets[j])) >= threshold:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def planted():
    """Near copies at all distances around the threshold, chains, exact copies, shared passages, short texts."""
    rows, k = [], 100
    base = prose(1, 220).split(" ")
    passage = prose(2, 60)
    for step in range(40):
        words = list(base)
        for j in range(step % 20):
            words[(7 * j + step) % len(words)] = f"new{step}x{j}"
        rows.append((k := k + 1, " ".join(words)))
    chain = prose(3, 120).split(" ")
    for step in range(12):
        chain = chain[3:] + [f"c{step}a", f"c{step}b", f"c{step}c"]
        rows.append((k := k + 1, " ".join(chain)))
    for step in range(25):
        rows.append((k := k + 1, prose(50 + step, 40 + 10 * step) + " " + passage))
    rows += [((k := k + 1), prose(4, 90).upper()) for _ in range(15)]
    rows += [((k := k + 1), " ".join(f"w{i}" for i in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8) for _ in range(2)]
    return rows


@pytest.mark.parametrize("n, threshold", [(4, Fraction(85, 100)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_components_equal_brute_force(spark, n, threshold):
    rows = planted() + [(k, t) for k, t, *_ in edges()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in nj.joined(df, n, threshold).collect()), key=str)
    assert got == brute(rows, n, threshold)


def test_one_of_each(spark, edge_docs, no_docs):
    rows = planted()
    df = spark.createDataFrame([(k, t, "en", "s", None, "q", 1, "k", "h", 2) for k, t in rows] + edges(), SCHEMA)
    kept = nj.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    all_rows = [(r.doc_id, r.text) for r in df.collect()]
    ids = brute(all_rows, 5, Fraction(4, 5))
    blank = [(k, t or "") for k, t in all_rows if not shingles(t, 5)]
    groups = {c for _, n, c in ids if n}
    assert len(got) == len(groups) + len(blank)
    assert {k for k, t in got if shingles(t, 5)} == groups
    assert nj.one_of_each(no_docs).count() == 0


def test_empty(spark, no_docs):
    assert nj.joined(no_docs).count() == 0


def test_every_fragment_size_gives_the_same(spark):
    df = spark.createDataFrame(planted(), "doc_id long, text string")
    few = {tuple(r) for r in nj.linked_sets(df, 4, Fraction(85, 100)).collect()}
    many = {tuple(r) for r in nj.linked_sets(df, 4, Fraction(85, 100), fragment_bytes=300).collect()}
    names = lambda pairs: {frozenset(v for v, r in pairs if r == root) for _, root in pairs}
    assert names(few) == names(many) and few


def test_missing_is_exact():
    sizes = np.arange(1, 3000)
    for t in (Fraction(85, 100), Fraction(4, 5), Fraction(1)):
        assert nj.missing(sizes, t).tolist() == [max(m for m in range(n + 1) if n - m >= t * n)
                                                 for n in sizes.tolist()]
        near = [max(m for m in range(n + 1) if (n - m) * (1 + t) >= t * 2 * n) for n in sizes.tolist()]
        assert nj.missing(sizes, t, True).tolist() == near


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (7, 6)]
    got = {r.v: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == {*range(201), *range(1000, 1200)}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1200)}) == 1
    assert got[0] != got[1000]


def test_one_of_each_keeps_columns_with_clashing_names(spark):
    names = ["_sid", "_size", "_root", "_copy", "_key", "_set", "_first"]
    df = spark.createDataFrame([(k, t, *names) for k, t in planted()],
                               "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    plain = nj.one_of_each(df.select("doc_id", "text"))
    found = nj.one_of_each(df)
    assert found.columns == df.columns
    rows = found.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in plain.collect())
    assert all(r[n] == n for r in rows for n in names)
