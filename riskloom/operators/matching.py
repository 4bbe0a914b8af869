"""Entity resolution: block, score, decide. Records (vendors, traders) to companies, evidence kept.

Records:   rec_id, name_norm, name_core, postcode_norm, stated_company_number
Companies: company_number, name_norm, name_core, postcode_norm, status

No step lists all pairs of a block. Exact names join only companies whose name is unique (the others are
ambiguous and can never be accepted); postcode candidates come from an exact similarity join over distinct names,
whose blocks meet as matrices in the tasks; decisions are made per distinct name and joined back.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom.functions import fixed, similarity as sim
from riskloom.operators.spread import at_rest, grid

# A postcode pair under the lowest postcode rule gets confidence 0, so it need not be generated.
POSTCODE_SCORE_FLOOR = min(score for method, score, _ in fixed.MATCH_RULES if method == "postcode_name")


def _company_side(companies: DataFrame) -> DataFrame:
    return companies.select(
        "company_number", "postcode_norm", F.col("name_core").alias("cand_core"),
        F.col("name_norm").alias("cand_full"),
        F.coalesce((F.col("status") == "Active").cast("int"), F.lit(0)).alias("is_active"))


def _record_side(records: DataFrame) -> DataFrame:
    return records.select("rec_id", "postcode_norm", "stated_company_number",
                          F.col("name_core").alias("rec_core"), F.col("name_norm").alias("rec_full"))


def _of_length(names: DataFrame, lengths: DataFrame, fits: Column) -> DataFrame:
    """Names that fit the lengths (_lo, _hi) of the one row that the tasks get."""
    return names.crossJoin(F.broadcast(lengths)).filter(fits).drop("_lo", "_hi")


# ---- blocking ------------------------------------------------------------------------------------------------

def block_number(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Stated registration number equals a company's."""
    recs = (_record_side(records).filter(F.col("stated_company_number").isNotNull())
            .withColumnRenamed("stated_company_number", "company_number").drop("postcode_norm"))
    return (recs.join(_company_side(companies).drop("postcode_norm"), "company_number")
            .select("rec_id", "company_number", F.lit("registration_number").alias("match_method"),
                    "rec_core", "cand_core", "rec_full", "cand_full", "is_active"))


def block_name(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Per record: how many companies share its normalised name, and which one if it is the only one."""
    known = _company_side(companies).filter(F.col("cand_full") != "")
    names = (known.groupBy(F.col("cand_full").alias("rec_full"))
             .agg(F.count(F.lit(1)).alias("n_exact"), F.min("company_number").alias("company_number"),
                  F.min("cand_core").alias("cand_core"), F.min("is_active").alias("is_active")))
    # Equal names are equally long: records outside the companies' lengths are left out before they are shuffled.
    lengths = known.agg(F.min(F.length("cand_full")).alias("_lo"), F.max(F.length("cand_full")).alias("_hi"))
    recs = _of_length(_record_side(records).filter(F.col("rec_full") != ""), lengths,
                      F.length("rec_full").between(F.col("_lo"), F.col("_hi")))
    return (recs.join(names, "rec_full")
            .select("rec_id", F.when(F.col("n_exact") == 1, F.col("company_number")).alias("company_number"),
                    F.lit("exact_name").alias("match_method"), "rec_core", "cand_core", "rec_full",
                    F.col("rec_full").alias("cand_full"), "is_active", "n_exact"))


#: Names of one postcode and length that meet in one task, from either side, and steps of length up to the largest ratio.
BLOCK = 8_192
STEPS = 3


def _step(length: Column, ratio: float) -> Column:
    """Step of a length. Lengths within `ratio` are at most STEPS apart."""
    return F.floor(F.log(length + F.lit(1e-9)) / F.lit(math.log(ratio) * (1 + 1e-6) / STEPS)).cast("int")


def _lengths(core: Column, ratio: float) -> Column:
    """Steps of length of a name and of its token-sorted form, which collapses inner blanks."""
    forms = (core, F.trim(F.regexp_replace(core, " +", " ")))
    return F.array_distinct(F.array(*[_step(F.length(f), ratio) for f in forms]))


def _near(steps: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(steps, lambda s: F.sequence(s - STEPS, s + STEPS))))


FIGURES = ("match_score", "jw")


def _meeting(key: int, pairs_of, figures: tuple[str, ...]):
    """Kernel over rows (columns that name a cell, postcode first; core, is_rec), sorted by cell: the pairs of the two
    sides of each cell that pairs_of(record names, company names) gives by their places, with their figures."""

    def meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        core, is_rec = rows.column(key).combine_chunks(), rows.column(key + 1).combine_chunks()
        recs, cands = core.filter(is_rec), core.filter(pc.invert(is_rec))
        postcode = rows.column(0).slice(0, 1).combine_chunks()
        if len(recs) and len(cands):
            for i, j, *found in pairs_of(recs.to_pylist(), cands.to_pylist()):
                yield pa.record_batch([postcode.take(pa.array(np.zeros(len(i), np.int64))), recs.take(pa.array(i)),
                                       cands.take(pa.array(j)), *[pa.array(f, pa.float64()) for f in found]],
                                      ["postcode_norm", "rec_core", "cand_core", *figures])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows - 1, bool)
            for c in batch.columns[:key]:
                new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                cell = tuple(c[x].as_py() for c in batch.columns[:key])
                if held and cell != last:
                    yield from meet(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(x, y - x))
                last = cell
        if held:
            yield from meet(pa.Table.from_batches(held))

    return run


def _ratio(floor: float) -> float:
    """How many times longer one name of a pair may be: by its match score, or by its Jaro-Winkler alone."""
    return (200.0 - floor) / floor if floor else 1.0 / (min(sim.jaro_sums(fixed.POSTCODE_JW_FLOOR)) - 1.0)


def _usable_names(records: DataFrame, companies: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """Distinct (postcode_norm, core) of either side, at rest; record names without a possible partner are left out."""
    usable = F.col("postcode_norm").isNotNull() & (F.col("core") != "")
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # The distinct names are used several times below: at rest, normalising them is paid once.
    right = at_rest(companies.select("postcode_norm", F.col("name_core").alias("core")).filter(usable).distinct()
                    .repartition(tasks, "postcode_norm", "core"), "company-names")

    # Lengths per postcode rule out names with no possible partner before anything is compared. Token sorting
    # collapses inner blanks, so the shorter of the two forms bounds from below.
    squeezed = F.length(F.regexp_replace("core", " +", " "))
    factor = _ratio(floor) * (1 + 1e-6)
    fits = (squeezed <= F.col("_hi") * F.lit(factor)) & (F.length("core") * F.lit(factor) >= F.col("_lo"))
    band = right.groupBy("postcode_norm").agg(F.max(F.length("core")).alias("_hi"), F.min(squeezed).alias("_lo"))
    # The widest band of all postcodes comes first: what it rules out is not shuffled.
    left = _of_length(records.select("postcode_norm", F.col("name_core").alias("core")).filter(usable),
                      band.agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo")), fits).distinct()
    left = at_rest(left.join(band, "postcode_norm").filter(fits)
                   .drop("_hi", "_lo").repartition(tasks, "postcode_norm", "core"), "record-names")
    return left, right


def _measured(pairs: DataFrame, floor: float) -> DataFrame:
    """Pairs with match score >= floor and Jaro-Winkler >= 0.80, with both figures."""
    # The ratio runs vectorised over a batch of pairs, Jaro-Winkler pair by pair: few are left for the second.
    return (pairs.withColumn("match_score", sim.match_score("rec_core", "cand_core"))
            .filter(F.col("match_score") >= F.lit(float(floor)))
            .withColumn("jw", sim.jaro_winkler("rec_core", "cand_core"))
            .filter(F.col("jw") >= F.lit(fixed.POSTCODE_JW_FLOOR)))


def _met(sides: tuple[DataFrame, DataFrame], on: list[str], pairs_of, figures: tuple[str, ...] = ()) -> DataFrame:
    """(postcode_norm, rec_core, cand_core, figures) that pairs_of gives in the cells of the two sides of a grid."""
    tasks = int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cell = [*on, "_i", "_j"]
    rows = [side.select(*cell, "core", F.lit(is_rec).alias("is_rec")) for side, is_rec in zip(sides, (True, False))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("postcode_norm", "rec_core", "cand_core")]
                          + [T.StructField(c, T.DoubleType()) for c in figures])
    return (rows[0].unionByName(rows[1]).repartition(tasks, *cell).sortWithinPartitions(*cell)
            .mapInArrow(_meeting(len(cell), pairs_of, figures), schema))


def _all_pairs(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Every pair of the distinct names whose match score reaches the floor and whose Jaro-Winkler is >= 0.80."""
    steps = _lengths(F.col("core"), _ratio(floor))
    on = ["postcode_norm", "step"]
    sides = grid(left.withColumn("step", F.explode(steps)), right.withColumn("step", F.explode(_near(steps))), on,
                 left_by=["core"], right_by=["core"], block=BLOCK)
    scored_pairs, jw = sim.scored_pairs, fixed.POSTCODE_JW_FLOOR  # they travel with the job
    # A pair meets once for each step of length of its record name.
    return at_rest(_met(sides, on, lambda recs, cands: scored_pairs(recs, cands, floor, jw), FIGURES).distinct(),
                   "name-pairs")


def _winkler_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of the distinct names whose Jaro-Winkler is >= 0.80, whatever its match score.

    Names with enough letters in common for any prefix are of like length. The others begin with the same letter at
    least; their lengths may differ more.
    """
    scored_pairs, jw = sim.scored_pairs, fixed.POSTCODE_JW_FLOOR
    sums, found = sim.jaro_sums(jw), []
    for part, on, least in (("near", [], sums[0]), ("far", ["initial"], min(sums))):
        ratio = (1 + 1e-3) / (least - 1.0)
        named = [d.withColumn("initial", F.substring("core", 1, 1)) if on else d for d in (left, right)]
        step = F.array(_step(F.length("core"), ratio))
        on = ["postcode_norm", *on, "step"]
        sides = grid(named[0].withColumn("step", F.explode(step)), named[1].withColumn("step", F.explode(_near(step))),
                     on, left_by=["core"], right_by=["core"], block=BLOCK)
        found.append(_met(sides, on, lambda recs, cands, part=part: scored_pairs(recs, cands, 0.0, jw, part), FIGURES))
    return found[0].unionByName(found[1])


def postcode_pairs(records: DataFrame, companies: DataFrame, floor: float = POSTCODE_SCORE_FLOOR) -> DataFrame:
    """Distinct (postcode, record core, company core) with Jaro-Winkler >= 0.80 and match score >= floor, with both
    figures. With floor 0 every pair with Jaro-Winkler >= 0.80, whatever its score.

    Exact: names of one postcode meet in cells by their lengths, BLOCK of either side at most, and every pair of a cell
    is bounded or measured in its task. No other pair is written.
    """
    left, right = _usable_names(records, companies, floor)
    return _all_pairs(left, right, floor) if floor else _winkler_pairs(left, right)


#: Names of one postcode that meet in one task to find names one letter apart, from either side.
CUT_BLOCK = 32_768


def _one_letter_apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of names that are equal or that one more letter on either side makes equal, plain or token-sorted, and maybe
    a few others. Their search costs as much as the letters of the names that meet, not their pairs."""
    sides = grid(left.filter(F.length("core") <= sim.CUT_UP_TO), right, ["postcode_norm"], left_by=["core"],
                 right_by=["core"], block=CUT_BLOCK)
    return _met(sides, ["postcode_norm"], sim.one_letter_apart).distinct()


def leading_pairs(records: DataFrame, companies: DataFrame, floor: float = POSTCODE_SCORE_FLOOR) -> DataFrame:
    """Those of postcode_pairs that have the highest match score of their record name, and some others.

    Exact: names two letters or more apart in both forms score at most 100 m / (m + 1), m being the length of the record
    name (both lengths and the common subsequence bound it). A record name whose best pair at one letter scores more
    needs no other pair; the others meet every name of their postcode.
    """
    left, right = _usable_names(records, companies, floor)
    name, m = ["postcode_norm", "rec_core"], F.length("rec_core")
    # Behind a table at rest, as the two uses would measure the pairs twice.
    close = at_rest(_measured(at_rest(_one_letter_apart(left, right), "close-names"), floor), "close-pairs")
    settled = close.groupBy(*name).agg(F.max("match_score").alias("_s")).filter(
        F.col("_s") > F.lit(100.0) * m / (m + 1)).drop("_s")
    open_names = left.join(settled.withColumnRenamed("rec_core", "core"), ["postcode_norm", "core"], "left_anti")
    return close.join(settled, name, "left_semi").unionByName(_all_pairs(open_names, right, floor))


# ---- scoring and decision ------------------------------------------------------------------------------------

def confidence(method: Column, score: Column) -> Column:
    """First rule that holds; 0 when none does."""
    out = F.lit(0.0)
    for rule_method, at_least, value in reversed(fixed.MATCH_RULES):
        out = F.when((method == rule_method) & (score >= F.lit(float(at_least))), F.lit(value)).otherwise(out)
    return out


def _best(df: DataFrame, key: list[str]) -> DataFrame:
    """Best candidate per key: an aggregate with map-side combine, no window. Lowest company number on ties."""
    rank = F.struct(*[(-F.col(c)).alias(c) for c in ("confidence", "match_score", "full_score", "is_active")],
                    "company_number", "match_method")
    carried = ["company_number", "match_method", "match_score", "full_score", "confidence", "is_active"]
    return df.groupBy(*key).agg(F.min_by(F.struct(*carried), rank).alias("b")).select(*key, "b.*")


def best_by_postcode(records: DataFrame, companies: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Best postcode candidate per record, found once per distinct record name and joined back."""
    pairs = leading_pairs(records, companies) if pairs is None else pairs
    names = _record_side(records).select("postcode_norm", "rec_core", "rec_full").distinct()
    groups = (_company_side(companies).filter(F.col("postcode_norm").isNotNull())
              .groupBy("postcode_norm", "cand_core", "cand_full", "is_active")
              .agg(F.min("company_number").alias("company_number")))
    scored = (pairs.join(names, ["postcode_norm", "rec_core"]).join(groups, ["postcode_norm", "cand_core"])
              .withColumn("full_score", sim.indel_ratio("rec_full", "cand_full"))
              .withColumn("match_method", F.lit("postcode_name"))
              .withColumn("confidence", confidence(F.lit("postcode_name"), F.col("match_score"))))
    best = _best(scored, ["postcode_norm", "rec_core", "rec_full"])
    return (_record_side(records).select("rec_id", "postcode_norm", "rec_core", "rec_full")
            .join(best, ["postcode_norm", "rec_core", "rec_full"])
            .select("rec_id", "company_number", "match_method", "match_score", "full_score", "confidence",
                    "is_active"))


def postcode_candidates(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Every (record, company) of one postcode whose names reach the lowest postcode rule."""
    pairs = postcode_pairs(records, companies)
    company = _company_side(companies).select("postcode_norm", "cand_core", "cand_full", "company_number", "is_active")
    return (_record_side(records).select("rec_id", "postcode_norm", "rec_core", "rec_full")
            .join(pairs, ["postcode_norm", "rec_core"]).join(company, ["postcode_norm", "cand_core"])
            .withColumn("full_score", sim.indel_ratio("rec_full", "cand_full"))
            .withColumn("match_method", F.lit("postcode_name"))
            .withColumn("confidence", confidence(F.lit("postcode_name"), F.col("match_score"))))


CANDIDATE = ["rec_id", "company_number", "match_method", "match_score", "full_score", "confidence", "is_active"]


def _number_and_name(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Candidates by number, and by names that one company has; at most one of each per record."""
    by_number = (block_number(records, companies)
                 .withColumn("match_score", sim.match_score("rec_core", "cand_core"))
                 .withColumn("full_score", sim.indel_ratio("rec_full", "cand_full")))
    # Equal normalised names have equal cores: nothing to compare.
    by_name = (block_name(records, companies).filter(F.col("n_exact") == 1)
               .withColumn("match_score", F.when(F.col("rec_core") == "", 0.0).otherwise(100.0))
               .withColumn("full_score", F.lit(100.0)))
    ruled = [d.withColumn("confidence", confidence(F.col("match_method"), F.col("match_score"))).select(*CANDIDATE)
             for d in (by_number, by_name)]
    return ruled[0].unionByName(ruled[1])


def scored_candidates(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Candidates with their evidence and `score_floor`, the score under which a method's pairs are not listed.

    Every candidate by number and by unique name is listed, whatever its score; of the pairs of one postcode those
    that can be accepted (a pair under the lowest postcode rule has confidence 0).
    """
    floor = F.when(F.col("match_method") == "postcode_name", F.lit(float(POSTCODE_SCORE_FLOOR))).otherwise(F.lit(0.0))
    return (_number_and_name(records, companies)
            .unionByName(postcode_candidates(records, companies).select(*CANDIDATE)).withColumn("score_floor", floor))


def decide(candidates: DataFrame) -> DataFrame:
    """Accepted match per record with evidence and the review flag."""
    best = _best(candidates.filter(F.col("confidence") >= F.lit(fixed.ACCEPT_AT)), ["rec_id"])
    return best.select("rec_id", "company_number", "match_method", "match_score", "confidence",
                       (F.col("confidence") < F.lit(fixed.REVIEW_BELOW)).alias("needs_review"))


def resolve(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Only the best postcode pair of a record's name can win, so the others are not expanded to records."""
    best = best_by_postcode(records, companies).select(*CANDIDATE)
    return decide(_number_and_name(records, companies).unionByName(best))


def trader_records(traders: DataFrame, trader_commodity: DataFrame) -> DataFrame:
    """Traders that import something in scope; they state no registration number."""
    return (traders.join(trader_commodity.select("trader_id"), "trader_id", "left_semi")
            .withColumn("stated_company_number", F.lit(None).cast("string"))
            .withColumnRenamed("trader_id", "rec_id"))


# ---- evaluation and truth pool -------------------------------------------------------------------------------

def evaluate(truth: DataFrame, resolved: DataFrame) -> DataFrame:
    """truth: rec_id, true_company_number. One row of counts, precision and recall."""
    m = truth.join(resolved.select("rec_id", "company_number"), "rec_id", "left")
    predicted = F.col("company_number").isNotNull()
    known = F.col("true_company_number").isNotNull()
    n = m.agg(F.count(F.lit(1)).alias("vendors"), F.count_if(predicted).alias("predicted_matches"),
              F.count_if(F.coalesce(F.col("company_number") == F.col("true_company_number"), F.lit(False)))
              .alias("correct"),
              F.count_if(known).alias("known"), F.count_if(predicted & ~known).alias("false_matches_without_truth"))
    share = lambda of: F.round(F.col("correct") / F.greatest(F.col(of), F.lit(1)), 3)
    return n.select("vendors", "predicted_matches", share("predicted_matches").alias("precision"),
                    share("known").alias("recall"), "false_matches_without_truth")


def unambiguous_pool(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Records whose (name, postcode) belongs to exactly one active company. Companies are counted before the join."""
    one = (companies.filter((F.col("status") == "Active") & F.col("postcode_norm").isNotNull())
           .groupBy("name_norm", "postcode_norm")
           .agg(F.count(F.lit(1)).alias("_n"), F.min("company_number").alias("company_number"))
           .filter(F.col("_n") == 1).drop("_n"))
    return records.join(one, ["name_norm", "postcode_norm"])


def sample_by_hash(pool: DataFrame, key: str, n: int) -> DataFrame:
    """A repeatable sample: the n keys with the lowest hash."""
    return pool.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
