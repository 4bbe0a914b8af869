"""Cleaning expressions. Every one is a plain Column, so it stays inside whole-stage codegen."""
from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, SparkSession, functions as F

from riskloom.functions import fixed

# Letters whose uppercase form is several letters (sharp s, ligatures ...). Engines disagree on them, and
# they end up as a blank anyway unless expanded, so they are blanked before upper().
EXPANDING = "".join(chr(c) for c in range(sys.maxunicode + 1) if len(chr(c).upper()) > 1)


def _upper(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.upper(F.translate(c, EXPANDING, " " * len(EXPANDING)))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^[{fixed.WHITE_SPACE}]+|[{fixed.WHITE_SPACE}]+$", "")


def norm_name(c: Column) -> Column:
    """Company name in comparable form. The order of the steps is part of the meaning."""
    return F.trim(reduce(lambda acc, s: F.regexp_replace(acc, F.lit(s[0]), F.lit(s[1])), fixed.NAME_STEPS, _upper(c)))


def norm_postcode(c: Column) -> Column:
    return F.nullif(F.regexp_replace(_upper(c), "[^A-Z0-9]", ""), F.lit(""))


FORM_WORDS = rf"\b({'|'.join(fixed.LEGAL_FORMS)})\b"


def core_of(normalised: Column) -> Column:
    """name_core of a name that is already normalised: without legal form, also a misspelt one at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalised, FORM_WORDS, ""), fixed.MISSPELT_FORM, ""))


def name_core(c: Column) -> Column:
    return core_of(norm_name(c))


def surrogate_key(name: Column, postcode: Column) -> Column:
    """Null when either part is null."""
    return F.md5(F.concat(name, F.lit("|"), postcode))


def regno(c: Column) -> Column:
    """All digits: restore leading zeros to eight places. Else trimmed upper case, blank as null."""
    return F.when(c.rlike("^[0-9]+$"), F.lpad(c, 8, "0")).otherwise(F.nullif(F.upper(strip(c)), F.lit("")))


def fx_rate(currency: Column) -> Column:
    """Rate to GBP, null for a currency without a rate."""
    return lookup(currency, fixed.FX_TO_GBP)


def lookup(c: Column, mapping: dict) -> Column:
    """CASE over a fixed mapping; null when absent."""
    out = F.lit(None)
    for key, value in reversed(list(mapping.items())):
        out = F.when(c == F.lit(key), F.lit(value)).otherwise(out)
    return out


def day_month_year(c: Column) -> Column:
    """Day, month and year with slashes, leading zeros or not; null when blank or impossible."""
    return F.try_to_date(F.nullif(c, F.lit("")), "d/M/yyyy")


def day_mon_yy(c: Column) -> Column:
    """DD-MON-YY, strict. Two-digit years 69-99 belong to the 1900s."""
    part = lambda i: F.split_part(c, F.lit("-"), F.lit(i))
    # The formatter wants 'Mar'; sources write 'MAR'.
    d = F.to_date(F.concat_ws("-", part(1), F.initcap(part(2)), part(3)), "d-MMM-yy")
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def severity(alert_level: Column) -> Column:
    return F.coalesce(lookup(alert_level, fixed.ALERT_SEVERITY), F.lit(0.0))


def in_scope(cn8: Column, chapters=fixed.CHAPTERS) -> Column:
    return F.substring(cn8, 1, 2).isin(list(chapters))


def regime_subject(regime: Column) -> Column:
    """'The Russia (Sanctions) (EU Exit) Regulations 2019' -> 'Russia'; thematic regimes -> null."""
    return F.nullif(F.regexp_extract(regime, fixed.REGIME_SUBJECT, 1), F.lit(""))


def month_label(yyyymm: Column) -> Column:
    return F.date_format(F.to_date(yyyymm.cast("string"), "yyyyMM"), "MMM yyyy")


def company_number_input(c: Column) -> Column:
    """A number typed by a person: trim, upper, pad digits to eight but never cut."""
    t = F.upper(strip(F.coalesce(c, F.lit(""))))
    return F.when(t.rlike("^[0-9]+$") & (F.length(t) < 8), F.lpad(t, 8, "0")).otherwise(t)


def units(c: Column, scale: float) -> Column:
    """Fixed-point form of a double. Sums of it do not depend on row order, retries or partitioning."""
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)).cast("bigint")


MONEY = 1e4
SHARE = 1e12


def sum_units(c: Column, scale: float) -> Column:
    return F.sum(units(c, scale))


def total_units(c: Column) -> Column:
    """Sum of whole units over any number of rows: a decimal, which a total over everything cannot overflow."""
    return F.coalesce(F.sum(c.cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)"))


def register_sql(spark: SparkSession) -> None:
    """The three name rules as SQL functions, for people who write SQL. Built from the same steps as the columns."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    upper = f"upper(translate(coalesce(s, ''), {quoted(EXPANDING)}, {quoted(' ' * len(EXPANDING))}))"
    replaced = lambda x, pattern, to: f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)})"
    steps = {
        "norm_name": f"trim({reduce(lambda acc, step: replaced(acc, *step), fixed.NAME_STEPS, upper)})",
        "norm_postcode": f"nullif({replaced(upper, '[^A-Z0-9]', '')}, '')",
        "name_core": f"trim({replaced(replaced('norm_name(s)', FORM_WORDS, ''), fixed.MISSPELT_FORM, '')})",
    }
    for name, body in steps.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
