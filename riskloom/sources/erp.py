"""Vendor master, purchase lines and the truth file, all read as text and typed here."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.normalize import core_of, day_mon_yy, fx_rate, norm_name, norm_postcode, regno
from riskloom.operators.spread import number_within

VENDOR = ("VENDOR_ID", "VENDOR_NAME", "SEGMENT1", "ADDRESS_LINE1", "ZIP", "COUNTRY", "REGISTRATION_NUMBER",
          "CREATION_DATE", "ENABLED_FLAG")
PO = ("PO_NUMBER", "LINE_NUM", "VENDOR_ID", "CATEGORY_CODE", "ITEM_DESCRIPTION", "QUANTITY", "UNIT_PRICE",
      "CURRENCY_CODE", "CREATION_DATE")


def _csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(
        ", ".join(f"{c} string" for c in columns)).csv(path)


def read_vendors(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, VENDOR)


def read_po_lines(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, PO)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ("vendor_id", "true_company_number")).withColumnRenamed("vendor_id", "rec_id")


def clean_vendors(raw: DataFrame) -> DataFrame:
    return (raw.withColumn("name_norm", norm_name(F.col("VENDOR_NAME")))
            .select(F.col("VENDOR_ID").alias("vendor_id"), F.col("VENDOR_NAME").alias("vendor_name"), "name_norm",
                    core_of(F.col("name_norm")).alias("name_core"), F.col("ZIP").alias("postcode"),
                    norm_postcode(F.col("ZIP")).alias("postcode_norm"), F.col("COUNTRY").alias("country"),
                    regno(F.col("REGISTRATION_NUMBER")).alias("stated_company_number"),
                    day_mon_yy(F.col("CREATION_DATE")).alias("created_on")))


def number_lines(lines: DataFrame, po: str, order: list[str]) -> DataFrame:
    """po_line_id = <order number>-<position>. Ties go by all remaining columns, so the ids are repeatable."""
    rest = [c for c in lines.columns if c not in (po, *order)]
    numbered = number_within(lines, [po], [*order, *rest], "_line")
    return numbered.withColumn("po_line_id", F.concat_ws("-", po, "_line")).drop("_line")


def clean_po_lines(raw: DataFrame) -> DataFrame:
    amount = F.col("QUANTITY").cast("double") * F.col("UNIT_PRICE").cast("double") * fx_rate(F.col("CURRENCY_CODE"))
    return number_lines(raw, "PO_NUMBER", ["VENDOR_ID", "CATEGORY_CODE"]).select(
        "po_line_id", F.col("VENDOR_ID").alias("vendor_id"), F.lpad("CATEGORY_CODE", 8, "0").alias("cn8_code"),
        F.col("ITEM_DESCRIPTION").alias("item_description"), amount.alias("amount_gbp"),
        F.col("CURRENCY_CODE").alias("original_currency"), day_mon_yy(F.col("CREATION_DATE")).alias("order_date"))
