"""Quality rules: a table of thresholds compiled into one projection; no user function, no shuffle."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.llm.common import WHITE, let, table

#: Symbols of markup, code and junk rather than prose.
SYMBOLS = "#*$%&|<>"
#: Windows of this many words count as repeated when found twice.
WINDOW = 5
#: Frequent words of the four languages; a long text without any of them is no prose.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "be", "this", "are", "from", "have",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "ist", "ein", "eine", "nicht", "auf", "ich",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "est", "pour", "que", "qui", "dans", "avec", "sur",
    "el", "los", "las", "del", "y", "se", "por", "con", "para", "su", "al", "lo", "como", "no",
)


@dataclass(frozen=True)
class Rule:
    """Rejects where `measure` lies outside [low, high]; judged only from `from_words` words on."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Base rules come from the contract; the rest is wide enough that ordinary prose of any length passes.
BASE = (Rule("few_words", "n_words", low=10), Rule("repeated_words", "repeat_ratio", high=0.2))
RULES = (
    Rule("word_length", "mean_word", low=1.5, high=15),
    Rule("symbols", "symbol_ratio", high=0.08),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("no_stop_words", "stop_ratio", low=0.005, from_words=100),
)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of five that occur twice or more, each word counted once.

    Windows are compared by a 64-bit hash. Only texts that repeat a window sort them: the positions of repeated
    windows, in order, each add the words that the one before has not covered.
    """
    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            last = F.size(rows) - 1
            again = F.filter(rows, lambda r, i: (
                ((i > 0) & (F.get(rows, i - 1)["h"] == r["h"]))
                | ((i < last) & (F.get(rows, i + 1)["h"] == r["h"]))))
            return let(F.sort_array(F.transform(again, lambda r: r["i"])), lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(
                    F.least(F.lit(WINDOW), p - F.get(at, i - 1)))),
                F.lit(0).cast("long"), lambda total, x: total + x))

        return let(placed, twice)

    def windows_of(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(
            *[F.get(hashes, i + j) for j in range(WINDOW)]))

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            covered(windows))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(
        let(hashes, lambda h: let(windows_of(h), counted)))


def measures(text: Column, then: Callable[[Column], Column] = lambda m: m) -> Column:
    """A struct of counts of one text, or what `then` makes of it; null counts as the empty text.

    It is one expression: whatever refers to a part of it evaluates the counts once.
    """
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        bare = F.regexp_replace(t, WHITE, "")
        words = F.filter(F.split(t, WHITE), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def counts(ws: Column) -> Column:
            return let(lines, lambda ls: let(F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(bare).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(ls).cast("long").alias("n_lines"),
                _repeat_words(ws).alias("n_repeat_words"),
                F.size(F.filter(ws, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words")),
                then))

        return let(words, counts)

    return let(text, of)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the counts m with `failed` (names of broken rules), base_failed and kept."""
    ratios = {
        "n_words": m["n_words"],
        "mean_word": _ratio(m["word_chars"], m["n_words"]),
        "symbol_ratio": _ratio(m["n_symbols"], m["word_chars"]),
        "dup_line_ratio": _ratio(m["n_dup_lines"], m["n_lines"]),
        "repeat_ratio": _ratio(m["n_repeat_words"], m["n_words"]),
        "stop_ratio": _ratio(m["n_stop_words"], m["n_words"]),
    }

    def broken(rule: Rule) -> Column:
        outside = F.lit(False)
        if rule.low is not None:
            outside = outside | (ratios[rule.measure] < rule.low)
        if rule.high is not None:
            outside = outside | (ratios[rule.measure] > rule.high)
        return F.when(outside & (m["n_words"] >= rule.from_words), F.lit(rule.name))

    base_failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    own = F.array_compact(F.array(*[broken(r) for r in rules]))
    failed = F.concat(F.array_compact(F.array(*[broken(r) for r in BASE])), own)
    return F.struct(
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                                  "n_stop_words")],
        failed.alias("failed"), base_failed.alias("base_failed"), (~base_failed & (F.size(own) == 0)).alias("kept"))


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the struct column `quality`: counts, `failed` (names of broken rules), base_failed, kept.

    One expression, no shuffle. A null or empty text has zero words and fails the base rules; repeated rows get
    equal verdicts; no row is dropped; an empty table gives none. A column `quality` of docs is replaced, all others
    stay.
    """
    return docs.withColumn("quality", measures(F.col(text), lambda m: verdict(m, rules)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols",
                               "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed",
                               "quality.kept")


def op9_sql() -> str:
    ws = r"[\x20\x09-\x0D]"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from t),
win as (select rid, i, array_to_string(ws[i:i+4], ' ') as s
        from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, s) as n from win) where n > 1),
cov as (select rid, sum(least(5, i - coalesce(p, i - 5))) as n
        from (select rid, i, lag(i) over (partition by rid order by i) as p from rep) group by rid),
m as (select doc_id, len(ws) as n_words, length(regexp_replace(text, '{ws}+', '', 'g')) as word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
      len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines,
      cast(coalesce(n, 0) as bigint) as n_repeat_words,
      len(list_filter(ws, lambda x: lower(x) in ({stop}))) as n_stop_words
      from w left join cov using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words
       or word_chars / n_words < 1.5 or word_chars / n_words > 15
       or n_symbols / word_chars > 0.08
       or (n_lines > 0 and n_dup_lines / n_lines > 0.5)
       or (n_words >= 100 and n_stop_words / n_words < 0.005)) as kept
from m"""
