"""Company register: ragged comma-separated records whose tail shifts when a row carries an extra SIC code."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions import fixed as values
from riskloom.functions.normalize import core_of, day_month_year, norm_name, norm_postcode, strip
from riskloom.sources import records

# 0-based field positions, the lowest field count of a usable line, and where SIC codes start.
FIELDS = {
    "name": 0, "company_number": 1, "address_line1": 4, "post_town": 6, "postcode": 9, "category": 10, "status": 11,
    "dissolved_on": 13, "incorporated_on": 14, "accounts_next_due": 17, "accounts_category": 19,
    "mortgages_outstanding": 23,
}
TRIMMED = ("name", "company_number", "address_line1", "post_town", "postcode")
MIN_FIELDS = 30
SIC_FROM = 26
HEADER_NUMBER = "CompanyNumber"


def csv_cells(line: Column) -> Column:
    """All fields of one record, empty ones included. spark.read.csv cannot tell an empty from a missing field."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(1))
    return F.transform(cells, lambda c: F.when(
        c.rlike('(?s)^".*"$'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: each record as written, quoted line breaks inside it. One file is read by many tasks, once."""
    return records.read(spark, path)


def split_lines(lines: DataFrame) -> DataFrame:
    """line -> the fixed fields, SIC codes by pattern, the confirmation date from the right."""
    cells = F.col("cells")
    rows = (lines.select(csv_cells(F.col("line")).alias("cells"))
            .filter((F.size(cells) >= MIN_FIELDS) & (strip(F.get(cells, F.lit(FIELDS["company_number"]))) != HEADER_NUMBER)))
    tail = F.slice(cells, SIC_FROM + 1, F.greatest(F.size(cells) - SIC_FROM, F.lit(0)))
    # The run of codes ends at the first field that is neither a code nor 'None Supplied'.
    is_sic = lambda c: c.rlike(f"{values.SIC_CODE}|{values.NO_SIC_CODE}")
    run = F.aggregate(tail, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("codes")),
                      lambda acc, c: F.struct(
                          (acc["on"] & is_sic(c)).alias("on"),
                          F.when(acc["on"] & c.rlike(values.SIC_CODE),
                                 F.concat(acc["codes"], F.array(F.substring(c, 1, 5))))
                          .otherwise(acc["codes"]).alias("codes")),
                      lambda acc: acc["codes"])
    cell = lambda i: F.get(cells, F.lit(i))
    fixed = [(strip(cell(i)) if name in TRIMMED else cell(i)).alias(name) for name, i in FIELDS.items()]
    return rows.select(*fixed, run.alias("sic_codes"), F.try_element_at(cells, F.lit(-2)).alias("confstmt_next_due"))


def open_quotes(lines: DataFrame) -> DataFrame:
    """Quality metric: records whose quotes do not close (odd number of quotes)."""
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    return lines.agg(F.count_if(quotes % 2 == 1).alias("value")).select(
        F.lit("company_lines_with_open_quote").alias("metric"), F.col("value").cast("double").alias("value"))


def clean(raw: DataFrame) -> DataFrame:
    """Typed companies; raw is split_lines() or its parquet copy."""
    return (raw.withColumn("name_norm", norm_name(F.col("name")))
            .select("company_number", "name", "name_norm", core_of(F.col("name_norm")).alias("name_core"),
                    norm_postcode(F.col("postcode")).alias("postcode_norm"), "postcode", "address_line1", "post_town",
                    "category", "status",
                    *[day_month_year(F.col(c)).alias(c) for c in
                      ("incorporated_on", "dissolved_on", "accounts_next_due", "confstmt_next_due")],
                    "accounts_category", F.col("mortgages_outstanding").try_cast("int").alias("mortgages_outstanding"),
                    "sic_codes"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return clean(split_lines(read_lines(spark, path)))
