"""Quality rules, sharding, language, quotations, pipeline: against brute force on small tables."""
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import language, packing, quality, quotations, sharding

from .conftest import SCHEMA, edges, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


def test_quality_counts(spark, edge_docs, no_docs, table_dir):
    rnd = random.Random(5)
    rows = edges() + [(100 + i, " ".join(rnd.choice("ab#c") for _ in range(rnd.randint(1, 60))).replace("b c", "b\nc"),
                       *edges()[0][2:]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = quality.op9_quality(spark, table_dir(documents=df)).collect()
    want = [(k, *counts(t)) for k, t, *_ in rows]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.judged(no_docs).count() == 0
    judged = quality.judged(df.drop("quality"))
    assert {r.doc_id: r.quality.failed for r in judged.collect()}[2] == ["few_words", "word_length"]


def test_quality_is_evaluated_once(spark, edge_docs, table_dir):
    """Filter and columns refer to one copy of the rules, in the query and in the pipeline's stage."""
    docs = edge_docs.withColumnRenamed("quality", "_m")
    for df in (quality.op9_quality(spark, table_dir(documents=docs)),
               corpus_pipeline.quality_rules(spark, spark.read.parquet(table_dir(other=docs) + "/other.parquet"), "")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("translate(") == 1
    assert corpus_pipeline.quality_rules(spark, docs, "").columns == docs.columns


def test_quality_keeps_prose_and_drops_junk(spark):
    rows = [(1, prose(1, 200)), (2, prose(2, 12)), (3, " ".join(f"{w}$$$" for w in prose(3, 100).split())),
            (4, "\n".join(["a very common line of text here"] * 40)), (5, " ".join("xqzt" + str(i) for i in range(200)))]
    got = {r.doc_id: r.quality for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[2].kept
    assert "symbols" in got[3].failed and "repeated_words" in got[4].failed and got[5].failed == ["no_stop_words"]


def test_sharding(spark, edge_docs, no_docs, table_dir):
    rows = edges() + [(200 + i, prose(i, i % 90), *edges()[0][2:]) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = sharding.op8_sharding(spark, table_dir(documents=df)).collect()
    want = sorted((k is not None, k or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1)
                  for k, t, *_ in rows)
    total, start, slots = sum(r[3] for r in want), 0, {}
    out = []
    for known, k, crc, size in want:
        shard = min(15, (2 * start + size) * 16 // (2 * total))
        start += size
        slots[shard] = slots.get(shard, -1) + 1
        out.append((k if known else None, size, crc, "bytes", shard, slots[shard], None))
    assert sorted(map(tuple, got), key=str) == sorted(out, key=str)
    assert sharding.shard_by_bytes(no_docs).count() == 0


def test_shards_are_even(spark):
    df = spark.range(5000).selectExpr("id * 7 as doc_id", "repeat('x', cast(id % 300 as int)) as text")
    sizes = {}
    for r in sharding.shard_by_bytes(df).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 602


def every_cut(word):
    for n in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), n):
            edges_ = [0, *at, len(word)]
            yield [word[a:b] for a, b in zip(edges_, edges_[1:])]


@pytest.fixture(scope="module")
def spoken(spark):
    """Four made-up languages of their own syllables, a fifth of the rows without a label."""
    syllables = {"aa": "ka lo mi tu re".split(), "bb": "sch ein ung ter kei".split(),
                 "cc": "que aux oir ette ment".split(), "dd": "ción ado los ita ero".split()}
    rnd = random.Random(11)
    rows = []
    for i in range(600):
        name = "abcd"[i % 4] * 2
        text = " ".join("".join(rnd.choice(syllables[name]) for _ in range(rnd.randint(1, 4)))
                        for _ in range(rnd.randint(4, 30)))
        rows.append((i, text, name if i % 5 else None, "s", None, "q", 1, "k", "h", 2))
    return spark.createDataFrame(rows + [(k, t, None, *r) for k, t, _, *r in edges()], SCHEMA)


def test_forward_sums_all_segmentations(spark, spoken):
    model = language.train(spoken)
    scorer = language.Scorer(model, None)
    pieces = scorer.vocabulary.pieces
    words = [w for t in ("ka", "schein", "ciónado", "日x", "qu'e") for w in language.words_of(t)]
    for w, log in zip(words, scorer.forward(words), strict=True):
        total = [0.0] * len(model.languages)
        for cut in every_cut(w):
            ids = [pieces.get(p, scorer.vocabulary.other if len(p) == 1 else None) for p in cut]
            if None not in ids:
                for j in range(len(total)):
                    total[j] += math.prod(model.probabilities[i, j] for i in ids)
        assert [math.log(x) for x in total] == pytest.approx(log.tolist())


def test_language(spark, spoken, no_docs, table_dir):
    found = language.op7_language(spark, table_dir(documents=spoken))
    truth = [(r.doc_id, r.text, r.lang) for r in spoken.collect()]
    got = found.collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 20]
    assert all(r.lang_pred == "abcd"[r.doc_id % 4] * 2 for r in held) and len(held) > 100
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in got)
    silent = {k for k, t, _ in truth if not re.search(r"[^\W\d_]", t or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und"} >= silent - {None}
    assert all(0 <= r.score <= 1 for r in got)
    assert language.identified(no_docs).count() == 0
    none = language.identified(spoken.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in none.select("lang_pred").distinct().collect()} == {"und"}
    assert set(spoken.columns) <= set(language.identified(spoken).columns)


def test_forward_over_long_runs(spark, spoken):
    """Runs longer than a block and than a double reaches: the recursion in logarithms gives the same."""
    model = language.train(spoken)
    scorer = language.Scorer(model, None)
    pieces, other = scorer.vocabulary.pieces, scorer.vocabulary.other
    rnd = random.Random(4)
    words = [language.START + "".join(rnd.choice(["ka", "lo", "schein", "q", "日", "ment"]) for _ in range(n))
             for n in (1, 3, 40, 40, 100, 170, 400)] + [language.START + "x" * n for n in (511, 512, 513, 1300)]
    rnd.shuffle(words)
    logs = np.log(model.probabilities)
    for w, got in zip(words, scorer.forward(words), strict=True):
        alpha = [np.zeros(len(model.languages))]
        for j in range(1, len(w) + 1):
            ids = [(n, pieces.get(w[j - n:j], other if n == 1 else None)) for n in range(1, min(j, 20) + 1)]
            alpha.append(np.logaddexp.reduce([alpha[j - n] + logs[i] for n, i in ids if i is not None]))
        assert alpha[-1].tolist() == pytest.approx(got.tolist())
    assert language.words_of("a" * 70 + "1bc") == ["▁" + "a" * 70, "▁bc"]
    name, score, fit, letters = next(scorer.predict(["kalomitu" * 5000]))
    assert (name, score, letters) == ("aa", 1.0, 40_001) and fit < 0


def test_recognised(spark, spoken, no_docs):
    """Random letters and a language without labels go, as do letterless texts; learned languages stay."""
    rnd = random.Random(8)
    gibberish = [(1000 + i, " ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rnd.randint(3, 9)))
                                     for _ in range(10 + 4 * i))) for i in range(50)]
    unlearned = [(2000 + i, " ".join(rnd.choice("szép volt az idő hogyan vagy köszönöm jól kérem egyszer".split())
                                     for _ in range(10 + 4 * i))) for i in range(50)]
    rows = [(k, t, None, "s", None, "q", 1, "k", "h", 2) for k, t in gibberish + unlearned]
    docs = spoken.union(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("quality", "lang_fit")
    found = language.recognised(docs)
    assert found.columns == docs.columns
    got = [r.doc_id for r in found.collect()]
    assert not [k for k in got if k is not None and k >= 1000]
    assert set(range(20, 600)) <= set(got)
    assert language.recognised(no_docs).count() == 0
    assert language.recognised(spoken.withColumn("lang", F.lit(None).cast("string"))).count() == 0


MAILS = [  # thread, position, text, parent, body
    (1, 0, "Shall we meet on Monday?\nOr Tuesday?", None, "Shall we meet on Monday?\nOr Tuesday?"),
    (1, 1, "> shall we  meet on monday?\nMonday is fine.", 0, "Monday is fine."),
    (1, 2, "> Monday is fine.\n> > Shall we meet on Monday?\n>> Or Tuesday?\nGood.", 1, "Good."),
    (1, 3, "> Or Tuesday?\nTuesday suits me.", 0, "Tuesday suits me."),
    (1, 4, "> Nobody wrote this.\nHm.", None, "Hm."),
    (1, 5, "Good.", None, "Good."),
    (1, 6, "> Good.\nThanks.", 5, "Thanks."),
    (2, 0, "> Good.\nAnother thread.", None, "Another thread."),
    (2, 1, None, None, None), (2, 2, "", None, ""), (2, 3, ">", None, ""), (2, 4, "> Self.\nSelf.", None, "Self."),
    (None, 0, "> Good.\nNo thread.", None, "No thread."), (3, None, "> Good.", None, ""),
]


def test_quotations(spark):
    df = spark.createDataFrame([m[:3] + ("mine", 1) for m in MAILS],
                               "conv_id long, turn long, text string, body string, level int")
    got = {(r.conv_id, r.turn): r for r in quotations.reply_ordered(df).collect()}
    for t, p, _, parent, body in MAILS:
        assert (got[t, p].reply_to, got[t, p].body) == (parent, body), (t, p)
    assert [(got[1, p].thread_root, got[1, p].depth) for p in range(7)] == [
        (0, 0), (0, 1), (0, 2), (0, 1), (4, 0), (5, 0), (5, 1)]
    assert [tuple(q) for q in got[1, 2].quotes] == [(1, 1), (2, 0)]
    assert got[1, 0].level == 1
    twice = df.union(df)
    assert quotations.reply_ordered(twice).count() == 2 * len(MAILS)
    assert quotations.reply_ordered(df.limit(0)).count() == 0


def test_long_chain_and_common_line(spark):
    """5000 replies to each other cross the windows' blocks; a line that all messages wrote names the latest."""
    df = spark.range(5000).selectExpr(
        "7 as conv_id", "id as turn", "concat('> line ', id - 1, '\\n', '> yes', '\\n', 'line ', id, '\\nyes') as text")
    got = quotations.reply_ordered(df)
    assert got.filter("depth <> turn or thread_root <> 0 or (turn > 0 and reply_to <> turn - 1)").count() == 0


def test_reply_order_of_branching_threads(spark):
    """Depth first, as a recursive walk gives it; a message with very many replies crosses the windows' blocks."""
    rnd = random.Random(3)
    parents = {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 2}  # B, C answer A; D answers B, E answers C
    parents |= {(2, p): rnd.choice([None, *range(p)]) if p and rnd.random() < 0.9 else None for p in range(300)}
    parents |= {(3, p): 0 if p % 3 else p - 1 if p else None for p in range(0, 4000)}
    # A long chain with a reply to each message beside it.
    parents |= {(4, p): None if not p else p - 1 if p % 2 else max(0, p - 2) for p in range(200)}
    rows = [(t, p, f"> line {t} {q}\nline {t} {p}" if q is not None else f"line {t} {p}") for (t, p), q in parents.items()]
    rnd.shuffle(rows)
    children = {}
    for (t, p), q in sorted(parents.items()):
        children.setdefault((t, q), []).append(p)
    want = {}
    for t in (1, 2, 3, 4):
        for root in children[t, None]:
            stack, place = [(root, 0)], 0
            while stack:
                p, depth = stack.pop()
                want[t, p] = (parents[t, p], root, depth, place)
                place += 1
                stack += [(c, depth + 1) for c in reversed(children.get((t, p), []))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread_root, r.depth, r.place)
           for r in quotations.reply_ordered(df).collect()}
    assert got == want
    assert [p for p in sorted(range(5), key=lambda p: got[1, p][3])] == [0, 1, 3, 2, 4]


def test_quotations_keep_columns_with_clashing_names(spark):
    names = ["_lines", "_t", "_p", "_root", "_depth", "_place", "root", "thread", "position"]
    df = spark.createDataFrame([m[:3] + (*names,) for m in MAILS],
                               "conv_id long, turn long, text string, " + ", ".join(f"{n} string" for n in names))
    got = quotations.reply_ordered(df)
    assert got.columns == df.columns + ["reply_to", "quotes", "thread_root", "depth", "place", "body"]
    rows = got.collect()
    assert len(rows) == len(MAILS) and all(r[n] == n for r in rows for n in names)


def test_quoting_is_undone(spark, table_dir):
    rows = [(c, t, "user", f"first {c} {t}\nsecond {t}" if t != 2 else None) for c in range(20) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotations.op3_quotations(spark, table_dir(conversations=df)).collect()}
    for c, t, _, text in rows:
        assert got[c, t].body == (text or "")
        assert got[c, t].reply_to == (None if t == 0 else 1 if t == 3 else t - 1 if t != 3 else None)


def brute_pipeline(rows):
    kept = []
    for k, t, lang in rows:
        n, chars, symbols, dups, repeated = counts(t)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        stops = sum(w.lower() in quality.STOP_WORDS for w in WORD.findall(t or ""))
        if (n >= 10 and 100 * repeated <= 20 * n and 1.5 <= chars / n <= 15 and symbols <= 0.08 * chars
                and dups <= 0.5 * len(lines) and (n < 100 or stops >= 0.005 * n)):
            kept.append((k, t))
    return kept


def test_pipeline(spark, table_dir):
    from .test_ngram_join import brute, planted
    from fractions import Fraction

    rows = planted() + [(500 + i, prose(700 + i, 20 + 9 * i)) for i in range(40)] + [
        (900, "123 456 789 10 11 12 13 14 15 16 17"), (901, None)]
    docs = spark.createDataFrame([(k, t, "en" if k % 2 else "xx", "s", None, "q", 1, "k", "h", 2) for k, t in rows], SCHEMA)
    folder = table_dir(documents=docs)
    state = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, folder)
        assert state.columns == docs.columns
        sizes.append({r.doc_id for r in state.select("doc_id").collect()})
    want = {k for k, _ in brute_pipeline([(k, t, None) for k, t in rows])}
    assert sizes[0] == want
    texts = dict(rows)
    assert sizes[1] <= sizes[0] and 900 not in sizes[1]
    assert sizes[2] == {c for _, n, c in brute([(k, texts[k]) for k in sizes[1]], 5, Fraction(4, 5)) if n}
    got = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in got.collect()} == sizes[2]
    assert got.columns == packing.packed(state).columns


def test_a_line_of_very_many_marks(spark):
    """One hostile mail must not end an executor."""
    rows = [(1, 0, "hello there", "u"), (1, 1, ">" * 200_000 + " x\n> hello there\nyes", "a"), (1, 2, "> " * 100_000, "u")]
    got = {r.turn: r for r in quotations.reply_ordered(
        spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")).collect()}
    assert got[1].reply_to == 0 and got[1].body == "yes" and got[2].body == ""
