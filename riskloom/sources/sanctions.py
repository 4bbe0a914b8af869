"""Sanctions list: CSV with a byte-order mark, a metadata line, then the header; one row per alias."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions import fixed
from riskloom.functions.normalize import lookup, regime_subject
from riskloom.sources import records
from riskloom.sources.companies import csv_cells

COLUMNS = {"Unique ID": "unique_id", "Regime Name": "regime", "Designation Type": "designation_type"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The three columns used, found by the names in the header row. Quoted line breaks are kept, empty cells are
    null. One file is read by many tasks."""
    rows = records.read(spark, path).select(csv_cells(F.col("line")).alias("cells"))
    is_header = F.array_contains("cells", "Unique ID")
    header = rows.filter(is_header).limit(1).collect()[0]["cells"]
    cell = lambda c: F.nullif(F.get("cells", F.lit(header.index(c))), F.lit(""))
    return (rows.filter(~is_header & ~F.get("cells", F.lit(0)).startswith("Report Date"))
            .select(*[cell(c).alias(n) for c, n in COLUMNS.items()]))


def country_names(iso: DataFrame) -> DataFrame:
    """(lower-case key, iso3) for every code and name of a country."""
    keys = F.array("alpha2", "iso3", "name", "official_name", "common_name")
    return (iso.select(F.explode(keys).alias("k"), "iso3").filter(F.col("k").isNotNull())
            .groupBy(F.lower("k").alias("subject_key")).agg(F.min("iso3").alias("_iso")))


def with_iso3(rows: DataFrame, iso: DataFrame) -> DataFrame:
    """Country of the regime: overrides, then any code or name; thematic regimes get null."""
    subject = regime_subject(F.col("regime"))
    return (rows.withColumn("subject", subject).withColumn("subject_key", F.lower("subject"))
            .join(country_names(iso), "subject_key", "left")
            .withColumn("iso3", F.coalesce(lookup(F.col("subject"), fixed.REGIME_COUNTRY_OVERRIDES), F.col("_iso")))
            .drop("subject", "subject_key", "_iso"))


def by_country(rows: DataFrame) -> DataFrame:
    """Designations (distinct ids) and regimes per country. Ids and regimes are made distinct before they meet."""
    mapped = rows.filter(F.col("iso3").isNotNull())
    ids = mapped.select("iso3", "unique_id").distinct().groupBy("iso3").agg(F.count("unique_id").alias("designations"))
    names = (mapped.select("iso3", "regime").filter(F.col("regime").isNotNull()).distinct().groupBy("iso3")
             .agg(F.array_join(F.array_sort(F.collect_list("regime")), "; ").alias("regimes")))
    return ids.join(names, "iso3", "left")
