"""Trade reference data and import statistics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions import fixed
from riskloom.functions.normalize import MONEY, lookup, strip, sum_units
from riskloom.sources import documents


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """lines: one record per line, in any number of files. Else each file is one document, a list of records. Many
    tasks read either."""
    if lines:
        return spark.read.schema(schema).json(path)
    found, _ = documents.records(spark, path, level=1)
    return found.select(F.from_json("record", schema).alias("r")).select("r.*")


# ---- reference -----------------------------------------------------------------------------------------------

def read_commodity(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    raw = _json(spark, path, "Cn8Code string, Cn8LongDescription string, Hs2Code string, Hs4Code string, "
                             "Hs4Description string, Hs6Description string", lines)
    return raw.filter(F.length("Cn8Code") == 8).select(
        F.col("Cn8Code").alias("cn8_code"), F.col("Cn8LongDescription").alias("description"),
        F.col("Hs2Code").alias("hs2_code"), F.col("Hs4Code").alias("hs4_code"),
        F.col("Hs4Description").alias("hs4_description"), F.col("Hs6Description").alias("hs6_description"))


def read_iso(spark: SparkSession, path: str) -> DataFrame:
    """The ISO country register as a CSV: alpha2, iso3, name, official_name, common_name."""
    return spark.read.option("header", True).schema(
        "alpha2 string, iso3 string, name string, official_name string, common_name string").csv(path)


def to_iso3(df: DataFrame, alpha2: str, iso: DataFrame, out: str = "iso3") -> DataFrame:
    """Adds the ISO3 code: overrides first, then the register; null when unknown."""
    register = iso.select(F.col("alpha2").alias(alpha2), F.col("iso3").alias("_iso"))
    return (df.join(register, alpha2, "left")
            .withColumn(out, F.coalesce(lookup(F.col(alpha2), fixed.TRADE_COUNTRY_OVERRIDES), F.col("_iso")))
            .drop("_iso"))


def read_country(spark: SparkSession, path: str, iso: DataFrame, lines: bool = False) -> DataFrame:
    raw = _json(spark, path, "CountryId long, CountryCodeAlpha string, CountryName string", lines)
    named = raw.select(F.col("CountryId").alias("hmrc_country_id"), F.col("CountryCodeAlpha").alias("hmrc_alpha"),
                       strip(F.col("CountryName")).alias("hmrc_name"))
    return to_iso3(named, "hmrc_alpha", iso).select("hmrc_country_id", "hmrc_alpha", "hmrc_name", "iso3")


# ---- statistics ----------------------------------------------------------------------------------------------

def read_trade(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """{start, end, rows[]} -> one line per commodity and trade country.

    lines: every line is {start, end, CommodityId, CountryId, Value}.
    """
    row = "CommodityId long, CountryId long, Value double"
    if lines:
        flat = _json(spark, path, f"start int, end int, {row}", lines)
        return flat.select(F.col("CommodityId").alias("commodity_id"), F.col("CountryId").alias("country_id"),
                           F.col("Value").alias("value_gbp"), F.col("start").alias("period_start"),
                           F.col("end").alias("period_end"))
    found, outer = documents.records(spark, path, level=2)
    span = outer.select("file", F.from_json("outer", "start int, end int").alias("o")).select(
        "file", F.col("o.start").alias("period_start"), F.col("o.end").alias("period_end"))
    return found.select("file", F.from_json("record", row).alias("r")).join(span, "file").select(
        F.col("r.CommodityId").alias("commodity_id"), F.col("r.CountryId").alias("country_id"),
        F.col("r.Value").alias("value_gbp"), "period_start", "period_end")


def clean(trade: DataFrame, country: DataFrame) -> DataFrame:
    """Unmapped countries stay, with null iso3."""
    names = country.select(F.col("hmrc_country_id").alias("country_id"), "iso3", "hmrc_name")
    return trade.join(names, "country_id", "left").select(
        F.lpad(F.col("commodity_id").cast("string"), 8, "0").alias("cn8_code"), "iso3", "hmrc_name",
        F.col("country_id").alias("hmrc_country_id"), "value_gbp", "period_start", "period_end")


def first_month(end: Column) -> Column:
    """First of the twelve months ending with yyyymm `end`."""
    return F.when(end % 100 < 12, end - 100 + 1).otherwise(end - 11)


def trailing12(monthly: DataFrame, end: int | None = None, chapters: Sequence[str] | None = fixed.CHAPTERS,
               keys: Sequence[str] = ("commodity_id", "country_id")) -> DataFrame:
    """Monthly rows by port -> value per commodity and country over the last twelve months.

    monthly: commodity_id, country_id, month_id (yyyymm), flow_type_id, value. `end` defaults to the latest month.
    """
    last = F.lit(end) if end is not None else monthly.agg(F.max("month_id").alias("m")).scalar()
    keep = (F.col("month_id") >= first_month(last)) & (F.col("month_id") <= last) & F.col("flow_type_id").isin(1, 3)
    if chapters is not None:
        keep = keep & (F.floor(F.col("commodity_id") / 1_000_000).isin([int(c) for c in chapters]))
    return (monthly.filter(keep).groupBy(*keys)
            .agg((sum_units(F.col("value"), MONEY) / F.lit(MONEY)).alias("value_gbp"))
            .withColumns({"period_start": first_month(last).cast("int"), "period_end": last.cast("int")}))
