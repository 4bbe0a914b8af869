"""Importer list: tab-separated latin-1 lines without header; traders with many codes go on over several lines."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions import fixed
from riskloom.functions.normalize import core_of, in_scope, norm_name, norm_postcode, surrogate_key, strip

MIN_FIELDS = 10


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Whole lines: no quoting, and a separator that never occurs."""
    return (spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "")
            .option("lineSep", "\n").schema("line string").csv(path)
            .select(F.regexp_replace("line", "\r$", "").alias("line")))


def split_lines(lines: DataFrame) -> DataFrame:
    f = F.col("f")
    # Filters may be evaluated in any order, so nothing here may fail on a short line.
    part = lambda i: strip(F.get(f, F.lit(i)))
    address = F.array_join(F.filter(F.transform(F.slice(f, 4, 5), lambda x: strip(x)), lambda x: x != ""), ", ")
    return (lines.select(F.split("line", "\t", -1).alias("f"))
            .filter((F.size("f") >= MIN_FIELDS) & F.get(f, F.lit(0)).rlike("^[0-9]+$"))
            .select(part(2).alias("name"), part(8).alias("postcode"), F.get(f, F.lit(0)).try_cast("int").alias("month_id"),
                    F.coalesce(F.get(f, F.lit(1)).try_cast("int"), F.lit(1)).alias("seq"), address.alias("address"),
                    F.filter(F.transform(F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))), lambda x: strip(x)),
                             lambda x: x != "").alias("codes")))


def traders(rows: DataFrame) -> DataFrame:
    """One row per (name, postcode); its first line gives month and address."""
    first = rows.groupBy("name", "postcode").agg(
        F.min_by(F.struct("month_id", "address"), F.struct("seq", "month_id", "address")).alias("r"))
    return (first.withColumn("name_norm", norm_name(F.col("name")))
            .select(surrogate_key(F.col("name"), F.col("postcode")).alias("trader_id"),
                    F.col("r.month_id").alias("month_id"), "name", F.col("r.address").alias("address"), "postcode",
                    "name_norm", core_of(F.col("name_norm")).alias("name_core"),
                    norm_postcode(F.col("postcode")).alias("postcode_norm")))


def trader_commodity(rows: DataFrame, chapters=fixed.CHAPTERS) -> DataFrame:
    """(trader, code) in scope; every line of a trader contributes."""
    return (rows.select(surrogate_key(F.col("name"), F.col("postcode")).alias("trader_id"),
                        F.explode("codes").alias("cn8_code"))
            .filter(in_scope(F.col("cn8_code"), chapters)).distinct())
