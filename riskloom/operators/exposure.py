"""From an event to the suppliers it exposes.

Home suppliers inherit the national sourcing mix (event -> country -> import flow -> commodity -> purchase), the
others carry the risk of their own country. All events are scored in one plan. Events that hit the same set of
countries (a footprint) with the same severity expose the same suppliers alike, so results are kept per footprint,
severity and supplier; `for_events` expands them for the events somebody asks for, and counts need no expansion.
Purchases are reduced to (supplier, commodity) before they meet any event.

Sums are taken in fixed point (1e-4 for money, 1e-12 for shares): independent of order, retries and partitioning.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import fixed
from riskloom.functions.normalize import MONEY, SHARE, sum_units, units
from riskloom.operators import scenarios
from riskloom.operators.spread import spread_join


def top_by(value: str, weight: Column, tie: str | None = None) -> Column:
    """Value with the largest weight, lowest tie key first; rows with a null value or weight are never chosen."""
    rank = F.struct((-weight).alias("w"), F.col(tie or value).alias("t"))
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull() & weight.isNotNull(), rank))


def with_home(suppliers: DataFrame, home: str = fixed.HOME_COUNTRY) -> DataFrame:
    """Null-safe: a supplier of unknown country is not a home supplier."""
    return suppliers.withColumn("is_home", F.col("country_iso3").eqNullSafe(F.lit(home)))


# ---- what we buy ---------------------------------------------------------------------------------------------

def spend_by_commodity(po_line: DataFrame, by: Sequence[str] = ("vendor_id", "cn8_code")) -> DataFrame:
    return po_line.groupBy(*by).agg(
        F.coalesce(sum_units(F.col("amount_gbp"), MONEY), F.lit(0).cast("bigint")).alias("spend_units"),
        F.count(F.lit(1)).alias("po_lines"))


def spend_weights(po_line: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Per (supplier, commodity): spend and its share of the supplier's spend; 0 when the supplier has no spend.

    suppliers: vendor_id, country_iso3, is_home.
    """
    spend = spend_by_commodity(po_line)
    total = (po_line.groupBy("vendor_id").agg(
        F.coalesce(sum_units(F.col("amount_gbp"), MONEY), F.lit(0).cast("bigint")).alias("total_units"))
             .join(suppliers.select("vendor_id", "country_iso3", "is_home"), "vendor_id"))
    return spend.join(total, "vendor_id").select(
        "vendor_id", "cn8_code", "country_iso3", "is_home", "po_lines", "spend_units", "total_units",
        (F.col("spend_units") / F.lit(MONEY)).alias("spend"),
        F.coalesce(F.try_divide(F.col("spend_units").cast("double"), F.col("total_units").cast("double")),
                   F.lit(0.0)).alias("w"))


# ---- where the risk is ---------------------------------------------------------------------------------------

def event_risk(risk_event: DataFrame, affects: DataFrame) -> DataFrame:
    """(event_id, iso3, risk) of every event: its severity in each country it affects."""
    return (affects.select("event_id", "iso3").distinct()
            .join(risk_event.select("event_id", F.col("severity").alias("risk")), "event_id"))


def footprints(affects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event_id, footprint) and the distinct (footprint, iso3).

    The set collected per event is at most the list of countries.
    """
    sets = (affects.groupBy("event_id").agg(F.sort_array(F.collect_set("iso3")).alias("isos"))
            .withColumn("footprint", F.md5(F.concat_ws(",", F.col("isos").cast("array<string>")))))
    countries = (sets.groupBy("footprint").agg(F.min("isos").alias("isos"))
                 .select("footprint", F.explode("isos").alias("iso3")))
    return sets.select("event_id", "footprint"), countries


def for_events(per_footprint: DataFrame, events: DataFrame) -> DataFrame:
    """Rows per (footprint, severity) as rows per event. events: event_id, footprint, severity."""
    return per_footprint.join(events.select("event_id", "footprint", "severity"), ["footprint", "severity"]).drop(
        "footprint", "severity")


def commodity_risk(import_flow: DataFrame, risk: DataFrame, scenario: str) -> DataFrame:
    """Inferred risk per (scenario, commodity): sum of share x risk, and the country that adds most.

    Few countries carry all flows, so their join keys are hot and get split.
    """
    flows = import_flow.select("cn8_code", "iso3", "share_of_uk_imports")
    met = spread_join(flows, risk.select(scenario, "iso3", "risk"), ["iso3"], spread_by=["cn8_code"])
    part = F.col("share_of_uk_imports") * F.col("risk")
    return met.groupBy(scenario, "cn8_code").agg(sum_units(part, SHARE).alias("risk_units"),
                                                 top_by("iso3", part).alias("top_country"))


def inferred_per_footprint(import_flow: DataFrame, countries: DataFrame) -> DataFrame:
    """(footprint, cn8_code, risk, top_country) at severity 1; an event scales it by its own."""
    unit = scenarios.risk_of_commodities(import_flow, countries, "footprint", SHARE)
    return unit.select("footprint", "cn8_code", (F.col("risk_units") / F.lit(SHARE)).alias("risk"), "top_country")


# ---- exposure ------------------------------------------------------------------------------------------------

def inherited_exposure(lines: DataFrame, flows: DataFrame, hits: DataFrame, scenario: str) -> DataFrame:
    """(scenario, vendor_id, unit, driver_commodity, driver_country): sum over the countries hit of w x share.

    lines: vendor_id, cn8_code, w. flows: cn8_code, iso3, share. hits: scenario, iso3.
    """
    found = scenarios.inherited(lines, flows, hits, scenario, SHARE)
    return found.select(scenario, "vendor_id", (F.col("units") / F.lit(SHARE)).alias("unit"), "driver_commodity",
                        "driver_country")


def footprint_exposure(weights: DataFrame, import_flow: DataFrame, countries: DataFrame) -> DataFrame:
    """(footprint, vendor_id): exposure at risk 1, main commodity and country, path type."""
    flows = import_flow.select("cn8_code", "iso3", F.col("share_of_uk_imports").alias("share"))
    home = weights.filter("is_home").select("vendor_id", "cn8_code", "w")
    inferred = inherited_exposure(home, flows, countries, "footprint").withColumn("path_type", F.lit("inferred"))

    abroad = (weights.filter(~F.col("is_home") & (F.col("total_units") != 0) & F.col("country_iso3").isNotNull())
              .groupBy("vendor_id", F.col("country_iso3").alias("iso3"))
              .agg(top_by("cn8_code", F.col("w")).alias("driver_commodity")))
    direct = (spread_join(abroad, countries, ["iso3"], spread_by=["vendor_id"])
              .select("footprint", "vendor_id", F.lit(1.0).alias("unit"), "driver_commodity",
                      F.col("iso3").alias("driver_country"), F.lit("direct").alias("path_type")))
    return inferred.unionByName(direct)


def supplier_exposure(weights: DataFrame, import_flow: DataFrame, events: DataFrame, countries: DataFrame) -> DataFrame:
    """(footprint, severity, vendor_id) with a score above 0, main commodity and country, path type.

    events: event_id, footprint, severity. countries: footprint, iso3.
    """
    unit = footprint_exposure(weights, import_flow, countries)
    kinds = events.select("footprint", "severity").distinct()
    return (unit.join(kinds, "footprint")
            .select("footprint", "severity", "vendor_id",
                    F.least(F.lit(1.0), F.col("severity") * F.col("unit")).alias("exposure_score"),
                    "driver_commodity", "driver_country", "path_type")
            .filter(F.col("exposure_score") > 0))


def per_line(weights: DataFrame, import_flow: DataFrame, country: DataFrame) -> DataFrame:
    """All current risk at once: (supplier, commodity) with its risk and path. country: iso3, country_risk."""
    risk = country.select(F.lit(0).alias("scenario"), "iso3", F.col("country_risk").alias("risk"))
    inferred = commodity_risk(import_flow, risk, "scenario").drop("scenario")
    home = weights.filter("is_home").join(inferred, "cn8_code", "left").select(
        "vendor_id", "cn8_code", "w", F.coalesce(F.col("risk_units") / F.lit(SHARE), F.lit(0.0)).alias("risk"),
        F.col("top_country").alias("via_country"), F.lit("inferred").alias("path_type"))
    abroad = (weights.filter(~F.col("is_home"))
              .join(risk.select(F.col("iso3").alias("country_iso3"), "risk"), "country_iso3", "left")
              .select("vendor_id", "cn8_code", "w", F.coalesce("risk", F.lit(0.0)).alias("risk"),
                      F.col("country_iso3").alias("via_country"), F.lit("direct").alias("path_type")))
    return home.unionByName(abroad)


def all_risk_exposure(weights: DataFrame, import_flow: DataFrame, country: DataFrame) -> DataFrame:
    """Each supplier against all current risk, sanctions included; suppliers without risk score 0."""
    part = units(F.col("w") * F.col("risk"), SHARE)
    lines = per_line(weights, import_flow, country).withColumn("part", part)
    return lines.groupBy("vendor_id").agg(
        F.least(F.lit(1.0), F.sum("part") / F.lit(SHARE)).alias("exposure_score"),
        top_by("cn8_code", F.col("part")).alias("driver_commodity"),
        top_by("via_country", F.col("part"), tie="cn8_code").alias("driver_country"),
        F.max("path_type").alias("path_type"))


# ---- ranking -------------------------------------------------------------------------------------------------

def priority(exposure: Column, criticality: Column, fragility: Column) -> Column:
    """exposure x criticality weight x (1 + fragility) / 2. Unknown (null or NaN) fragility counts as 0."""
    weight = F.lit(fixed.CRITICALITY_WEIGHT["medium"])
    for level, value in fixed.CRITICALITY_WEIGHT.items():
        weight = F.when(criticality == level, F.lit(value)).otherwise(weight)
    known = F.coalesce(F.nanvl(fragility.cast("double"), F.lit(0.0)), F.lit(0.0))
    return exposure * weight * (F.lit(1.0) + known) / F.lit(2.0)


def material_counts(risk_event: DataFrame, events: DataFrame, scored: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Per event: suppliers reached and suppliers at or above the threshold; 0 where none."""
    n = scored.groupBy("footprint", "severity").agg(
        F.count(F.lit(1)).alias("reached"), F.count_if(F.col("exposure_score") >= F.lit(threshold)).alias("material"))
    return risk_event.select("event_id").join(for_events(n, events), "event_id", "left").na.fill(
        0, ["reached", "material"])
