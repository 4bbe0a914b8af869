"""Disaster alerts as GeoJSON: {features: [{properties: {...}}]}."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.normalize import severity
from riskloom.sources import documents

PROPERTIES = ("eventtype: string, eventid: string, name: string, description: string, alertlevel: string, "
              "fromdate: string, todate: string, iscurrent: string, url: struct<report: string>, iso3: string, "
              "affectedcountries: array<struct<iso3: string>>")
SOURCE = "GDACS"


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per feature with its properties and position.

    lines: one feature per line, in any number of files. Else each file is one document. Many tasks read either.
    """
    if lines:
        each = spark.read.schema(f"properties struct<{PROPERTIES}>").json(path)
        return each.select(F.monotonically_increasing_id().alias("position"), "properties.*")
    found, _ = documents.records(spark, path, level=2)
    return found.select("position", F.from_json("record", f"properties struct<{PROPERTIES}>").alias("f")).select(
        "position", "f.properties.*")


def with_id(features: DataFrame) -> DataFrame:
    return features.withColumn("event_id", F.concat_ws("-", F.lit(SOURCE), "eventtype", "eventid"))


def risk_event(features: DataFrame) -> DataFrame:
    """First feature per event id."""
    rows = with_id(features).select(
        "position", "event_id", F.lit(SOURCE).alias("source"), F.col("eventtype").alias("event_type"),
        F.coalesce(F.nullif("name", F.lit("")), "description").alias("name"), F.col("alertlevel").alias("alert_level"),
        severity(F.col("alertlevel")).alias("severity"),
        F.substring("fromdate", 1, 10).cast("date").alias("start_date"),
        F.substring("todate", 1, 10).cast("date").alias("end_date"),
        F.coalesce(F.lower("iscurrent") == "true", F.lit(False)).alias("is_current"), F.col("url.report").alias("url"))
    kept = [c for c in rows.columns if c not in ("position", "event_id")]
    return rows.groupBy("event_id").agg(F.min_by(F.struct(*kept), "position").alias("r")).select("event_id", "r.*")


def event_country(features: DataFrame) -> DataFrame:
    """Listed countries; the event's own country when the list is missing or empty."""
    listed = F.transform("affectedcountries", lambda c: c["iso3"])
    isos = F.when(F.size(F.coalesce("affectedcountries", F.array())) > 0, listed).otherwise(F.array("iso3"))
    return (with_id(features).select("event_id", F.explode(isos).alias("iso3"))
            .filter(F.coalesce(F.col("iso3"), F.lit("")) != "").distinct())
