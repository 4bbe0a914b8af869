import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.functions import normalize as nz, similarity as sim
from riskloom.operators import matching
from riskloom.plans import standins

WORDS = "ALPHA BETA GAMMA STEEL WIRE NORTH SOUTH TRADING GROUP HOLDINGS MEC COM OM PUMP VALVE".split()


def table(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return (df.withColumn("name_norm", nz.norm_name(F.col("name"))).withColumn("name_core", nz.name_core(F.col("name")))
            .withColumn("postcode_norm", nz.norm_postcode(F.col("postcode"))))


def names(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 5)))
        if r.random() < 0.5:  # a typo
            j = r.randrange(len(s))
            s = s[:j] + r.choice("ABCXYZ") + s[j + 1:] if r.random() < 0.5 else s[:j] + s[j + 1:]
        out.append((str(i), s + r.choice([" LTD", " LIMITED", ""]), r.choice(["A1", "B2"])))
    return out


def test_postcode_pairs_equal_brute_force(spark):
    recs = table(spark, names(1, 400), "rec_id string, name string, postcode string")
    comps = table(spark, names(2, 400), "company_number string, name string, postcode string")
    got = {tuple(r) for r in matching.postcode_pairs(recs, comps).select(
        "postcode_norm", "rec_core", "cand_core").collect()}
    a = {(r.postcode_norm, r.name_core) for r in recs.collect() if r.name_core}
    b = {(r.postcode_norm, r.name_core) for r in comps.collect() if r.name_core}
    want = {(p, x, y) for p, x in a for q, y in b if p == q and sim.jaro_winkler_py(x, y) >= 0.8
            and sim.match_score_py(x, y) >= 80}
    assert got == want and len(want) > 50


def test_close_pairs_equal_brute_force():
    """Short and long names, blanks that token sorting collapses, empty sorted overlap, several tiles and floors."""
    r = random.Random(4)

    def name(k):
        s = " ".join("".join(r.choice("ABCD  ") for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, k))).strip()
        return (s or "A") + r.choice(["", " BUILDING MATERIALS"])

    for k, floor in ((3, 80), (6, 80), (30, 80), (6, 70)):
        a, b = [name(k) for _ in range(300)], [name(k) for _ in range(120)]
        got = [x for i, j in sim.close_pairs(a, b, floor) for x in zip(i.tolist(), j.tolist())]
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if sim.match_score_py(x, y) >= floor}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_scored_pairs_equal_brute_force(monkeypatch):
    """Either way of taking pairs, names of several words of bits and longer, letters beyond ASCII, both parts."""
    r = random.Random(5)

    def like(s, letters):
        s = list(s)
        for _ in range(r.randint(0, max(1, len(s) // 4))):
            k = r.randrange(len(s))
            s[k] = r.choice([s[k] + r.choice(letters), r.choice(letters), ""])
        return "".join(s).strip() or "B"

    for n, letters in ((3, "AB "), (6, "ABCDEF "), (25, "ABCDEFGHIJKLMNOPQRSTUVWXYZ  "), (60, "XY É")):
        base = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, n))).strip()
                or "A" for _ in range(12)]
        a, b = (list({like(r.choice(base), letters) for _ in range(50)}) for _ in range(2))
        both = {(i, j): (sim.match_score_py(x, y), sim.jaro_winkler_py(x, y)) for i, x in enumerate(a)
                for j, y in enumerate(b) if sim.jaro_winkler_py(x, y) >= 0.8}
        for many, words, places in ((1, 8, 1 << 21), (10 ** 9, 8, 1 << 10), (8, 1, 1 << 21)):
            monkeypatch.setattr(sim, "MANY", many)
            monkeypatch.setattr(sim, "MOST_WORDS", words)
            monkeypatch.setattr(sim, "MOST_PLACES", places)
            got = {}
            for floor, part in ((80.0, "all"), (0.0, "all"), (0.0, "near"), (0.0, "far")):
                got[floor, part] = [(x[:2], x[2:]) for found in sim.scored_pairs(a, b, floor, 0.8, part)
                                    for x in zip(*(f.tolist() for f in found))]
                assert len(got[floor, part]) == len(dict(got[floor, part]))
            assert dict(got[80.0, "all"]) == {k: v for k, v in both.items() if v[0] >= 80}
            assert dict(got[0.0, "all"]) == both and sorted(got[0.0, "near"] + got[0.0, "far"]) == sorted(both.items())
        assert len(both) > 20


def given(spark, path, lines, titles):
    """Stand-ins over documents (a line each) and pages (a title each): (key, text, language)."""
    spark.createDataFrame(lines, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    html = [(k, "https://a", f'<html lang="{p}"><title>{n}</title>') for k, n, p in titles]
    spark.createDataFrame(html, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return standins.Standins(spark, str(path))


def test_candidate_queries_normalise_names_once(spark, tmp_path):
    """Records and companies come from rest: no query cleans every line again for each of its blocks."""
    lines, titles = ([(k, n, "a") for k, (_, n, _) in enumerate(names(seed, n))] for seed, n in ((13, 40), (14, 20)))
    s = given(spark, tmp_path, lines, titles)
    for query in (entry.er_candidates, entry.er_match_score, entry.er_confidence, entry.er_best_match):
        found = query(s)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "LIMITED" not in plan and found.count() > 0, query.__name__


def test_postcode_block_lists_pairs_of_any_score(spark, tmp_path):
    """Every pair of a postcode with Jaro-Winkler >= 0.80, also under the lowest score of the rules and of unlike length."""
    lines = names(11, 150) + [("l", "NORTH PUMP ALPHA STEEL GROUP OF THE SOUTH AND ALL ITS VALVES", "A1"), ("m", "", "A1")]
    titles = names(12, 60) + [("t", "NORTHPU", "A1"), ("u", "NORTH PUMP ALP", "A1")]
    s = given(spark, tmp_path, [(k, n, p.lower()) for k, (_, n, p) in enumerate(lines)],
              [(k, n, p.lower()[0]) for k, (_, n, p) in enumerate(titles)])
    s.records = s.records.withColumn("postcode_norm", F.substring("postcode_norm", 1, 1))
    got = [tuple(r) for r in entry.er_block_postcode(s).collect()]
    a, b = ({(r.postcode_norm, r.name_core) for r in d.collect() if r.name_core} for d in (s.records, s.registry))
    want = {(p, x, y, round(sim.jaro_winkler_py(x, y), 6), round(sim.match_score_py(x, y), 6)) for p, x in a for q, y in b
            if p == q and sim.jaro_winkler_py(x, y) >= 0.8}
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[4] < 80 for r in want) > 20 and any(len(r[1]) > 4 * len(r[2]) for r in want)


def test_one_large_block_writes_no_rows_of_candidates(spark, monkeypatch):
    """Names that share a long word: rows at rest are names and found pairs, never what meets on common letters."""
    r = random.Random(6)
    names = ["".join(r.choice("ABCDEFGHIJKLMNOP") for _ in range(10)) + " BUILDING" for _ in range(600)]
    recs = table(spark, [(str(i), n, "A1") for i, n in enumerate(names)], "rec_id string, name string, postcode string")
    comps = recs.withColumnRenamed("rec_id", "company_number")
    written, keep = [], matching.at_rest

    def counted(df, name):
        written.append((kept := keep(df, name)).count())
        return kept

    monkeypatch.setattr(matching, "at_rest", counted)
    monkeypatch.setattr(matching, "BLOCK", 100)  # several cells for the one key
    found = {(x.rec_core, x.cand_core) for x in matching.postcode_pairs(recs, comps).collect()}
    assert found == {(x, y) for x in names for y in names
                     if sim.match_score_py(x, y) >= 80 and sim.jaro_winkler_py(x, y) >= 0.8}
    assert sum(written) < 4 * len(names)


def test_names_of_no_company_length_are_not_shuffled(spark, monkeypatch):
    """What no company's name is long or short enough for is left out below the first exchange of names."""
    recs = table(spark, [(str(i), n * k, "A1") for i, n in enumerate(["WIRE", "STEEL MEC"]) for k in (1, 500)],
                 "rec_id string, name string, postcode string").withColumn("stated_company_number", F.lit(None).cast("string"))
    comps = table(spark, [("7", "WIRE", "A1"), ("8", "WIRES", "B2"), ("9", "STEEL MEC", "A1")],
                  "company_number string, name string, postcode string").withColumn("status", F.lit("Active"))
    plans = {}

    def kept(df, name):
        plans[name] = plan_of(df)
        return df

    def plan_of(df):
        return df._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(matching, "at_rest", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many companies
    try:
        left, _ = matching._usable_names(recs, comps, 80.0)
        block = matching.block_name(recs, comps)
        plans["block"] = plan_of(block)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name, key in (("record-names", r"postcode_norm#\d+, core#\d+"), ("block", r"rec_full#\d+")):
        first = re.split(rf"Exchange hashpartitioning\({key}, \d+\), ENSURE_REQUIREMENTS", plans[name])[1]
        assert "BroadcastNestedLoopJoin" in re.split(r" Exchange ", first)[0], name
    assert {r.core for r in left.collect()} == {"WIRE", "STEEL MEC"}
    assert {(r.rec_id, r.n_exact) for r in block.collect()} == {("0", 1), ("1", 1)}


def test_one_letter_apart_equals_brute_force():
    r = random.Random(3)
    distance = lambda x, y: len(x) + len(y) - 2 * sim.lcs_length(x, y)
    for letters, k in (("AB ", 6), ("ABCDEF ", 12), ("AB", 3)):
        a, b = ([("".join(r.choice(letters) for _ in range(r.randint(0, k)))).strip() for _ in range(n)]
                for n in (300, 200))
        got = [x for i, j in sim.one_letter_apart(a, b) for x in zip(i.tolist(), j.tolist())]
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b)
                if min(distance(x, y), distance(sim.sort_tokens(x), sim.sort_tokens(y))) <= 1}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    for a, b in (([], ["A"]), (["A"], []), (["X" * 300], ["X" * 300])):
        assert [len(i) for i, _ in sim.one_letter_apart(a, b)] == [0]


def test_best_by_postcode_equals_all_pairs(spark, monkeypatch):
    """Names with and without a company one letter apart, several cells for one postcode, names too long for cuts."""
    long = [("l1", "Q" * 300 + " WORKS", "A1"), ("l2", "Z" * 256, "A1")]
    recs = table(spark, names(7, 300) + long, "rec_id string, name string, postcode string").withColumn(
        "stated_company_number", F.lit(None).cast("string"))
    comps = table(spark, names(8, 300) + [("l3", "Q" * 301 + " WORKS", "A1"), ("l4", "Z" * 257, "A1")],
                  "company_number string, name string, postcode string").withColumn("status", F.lit("Active"))
    monkeypatch.setattr(matching, "CUT_BLOCK", 40)
    got = {tuple(r) for r in matching.best_by_postcode(recs, comps).collect()}
    every = matching.postcode_pairs(recs, comps)
    assert got == {tuple(r) for r in matching.best_by_postcode(recs, comps, every).collect()} and len(got) > 50
    assert {r[0] for r in got} >= {"l1", "l2"}


def test_settled_names_meet_no_other_name(spark, monkeypatch):
    """Records that are a company, or one letter away from one, take no part in the comparison with a whole postcode."""
    r = random.Random(9)
    known = ["".join(r.choice("ABCDEFGHIJKLMNOP") for _ in range(10)) + " BUILDING" for _ in range(200)]
    other = [n[9::-1] + " BUILDING" for n in known[:5]]
    written = [n if i % 2 else n[:4] + n[5:] for i, n in enumerate(known)]
    recs = table(spark, [(str(i), n, "A1") for i, n in enumerate(written + other)],
                 "rec_id string, name string, postcode string").withColumn("stated_company_number", F.lit(None).cast("string"))
    comps = table(spark, [(str(i), n, "A1") for i, n in enumerate(known)],
                  "company_number string, name string, postcode string").withColumn("status", F.lit("Active"))
    left_over, keep = [], matching._all_pairs

    def counted(left, right, floor):
        left_over.append({x.core for x in left.collect()})
        return keep(left, right, floor)

    monkeypatch.setattr(matching, "_all_pairs", counted)
    best = {x.rec_id: x.company_number for x in matching.best_by_postcode(recs, comps).collect()}
    assert left_over == [set(other)] and all(best[str(i)] == str(i) for i in range(len(known)))


COMPANIES = [
    ("00000001", "Acme Steel Limited", "M1 1AA", "Active"), ("00000002", "Acme Steel Group Limited", "M1 1AA", "Active"),
    ("00000003", "Mec Com Limited", "M2 2BB", "Active"), ("00000004", "Twin Pumps Limited", "M3", "Active"),
    ("00000005", "Twin Pumps Limited", "M4", "Active"), ("00000006", "Lone Valve Limited", "M5", "Dissolved"),
    ("00000007", "Unrelated Traders Limited", "M6", "Active"),
]
VENDORS = [  # id, name, postcode, stated number, truth
    ("v1", "ACME STEEL LTD", "m11aa", None, "00000001"),          # parent at the same postcode is not taken
    ("v2", "Acme Steel Group", "M1 1AA", None, "00000002"),
    ("v3", "Mec Om Ltd", "M2 2BB", None, "00000003"),             # one letter dropped
    ("v4", "Twin Pumps Ltd", None, None, None),                   # two companies of that name: ambiguous
    ("v5", "Lone Valve Ltd", None, None, "00000006"),             # exact name, for review
    ("v6", "Acme Steel Limited", None, "00000007", "00000001"),   # wrong number: the name decides
    ("v7", "Nowhere GmbH", "", None, None), ("v8", "Unrelated Traders", None, "00000007", "00000007"),
    ("v9", None, "M1 1AA", None, None),
]


def test_resolution_and_evaluation(spark):
    comps = table(spark, COMPANIES, "company_number string, name string, postcode string, status string")
    recs = table(spark, VENDORS, "rec_id string, name string, postcode string, stated_company_number string, "
                                 "truth string")
    res = matching.resolve(recs, comps)
    got = {r.rec_id: r for r in res.collect()}
    assert {k: v.company_number for k, v in got.items()} == {v[0]: v[4] for v in VENDORS if v[4]}
    assert got["v5"].needs_review and got["v5"].confidence == 0.85 and not got["v8"].needs_review
    assert got["v8"].match_method == "registration_number" and got["v6"].match_method == "exact_name"
    e = matching.evaluate(recs.select("rec_id", F.col("truth").alias("true_company_number")), res).collect()[0]
    assert (e["vendors"], e["precision"], e["recall"], e["false_matches_without_truth"]) == (9, 1.0, 1.0, 0)
    pool = matching.unambiguous_pool(recs, comps).collect()
    assert {r.rec_id for r in pool} == {"v1"}
