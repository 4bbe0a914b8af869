"""Clean and resolution tables -> ontology tables, with the decisions people took applied on top."""
from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import fixed
from riskloom.functions.normalize import MONEY, sum_units, total_units, units
from riskloom.operators.spread import at_rest, rows_below

Tables = Mapping[str, DataFrame]


class Planned(Mapping):
    """Tables by name, each planned when it is first asked for: what nobody reads puts nothing at rest."""

    def __init__(self, plans: Mapping[str, Callable[[], DataFrame]]):
        self.plans, self.made = plans, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.plans[name]()
        return self.made[name]

    def __contains__(self, name: object) -> bool:
        return name in self.plans

    def __iter__(self) -> Iterator[str]:
        return iter(self.plans)

    def __len__(self) -> int:
        return len(self.plans)


def commodity(clean_commodity: DataFrame) -> DataFrame:
    return clean_commodity.select("cn8_code", "description", "hs2_code", "hs4_code", "hs4_description")


def known(df: DataFrame, commodities: DataFrame) -> DataFrame:
    """Rows whose commodity is in the current nomenclature."""
    return df.join(commodities.select("cn8_code"), "cn8_code", "left_semi")


def po_line(clean_po: DataFrame, commodities: DataFrame) -> DataFrame:
    return known(clean_po, commodities).select("po_line_id", "vendor_id", "cn8_code", "item_description",
                                               "amount_gbp", "order_date")


def company_imports(trader_company: DataFrame, trader_commodity: DataFrame, commodities: DataFrame) -> DataFrame:
    """(company, commodity) its traders import. Trader codes are made distinct before the join."""
    codes = known(trader_commodity.select("trader_id", "cn8_code").distinct(), commodities)
    return (trader_company.select(F.col("rec_id").alias("trader_id"), "company_number").join(codes, "trader_id")
            .select("company_number", "cn8_code").distinct())


def country_keys(imports: DataFrame, affects: DataFrame, sanctions: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Every country any source mentions; each source is made distinct before the union."""
    sources = (imports.select("iso3"), affects.select("iso3"), sanctions.select("iso3"),
               suppliers.select(F.col("country_iso3").alias("iso3")))
    parts = [s.filter(F.col("iso3").isNotNull()).distinct() for s in sources]
    return reduce(DataFrame.union, parts).distinct()


def named_countries(keys: DataFrame, names: DataFrame) -> DataFrame:
    """names: iso3, name. A country without a name keeps its code as name."""
    return keys.join(names.select("iso3", F.col("name").alias("_name")), "iso3", "left").select(
        "iso3", F.coalesce("_name", F.col("iso3").cast("string")).alias("name"))


def country(keys: DataFrame, names: DataFrame, sanctions: DataFrame, risk_event: DataFrame,
            affects: DataFrame) -> DataFrame:
    """Risk of a country: the worst of its current events, and the sanctions value if under a regime."""
    current = risk_event.filter("is_current").select("event_id", "severity")
    worst = (affects.select("event_id", "iso3").join(current, "event_id").groupBy("iso3")
             .agg(F.max("severity").alias("_sev")))
    under = F.col("designations").isNotNull()
    sev = F.coalesce("_sev", F.lit(0.0))
    return (named_countries(keys, names).join(sanctions.select("iso3", "designations"), "iso3", "left")
            .join(worst, "iso3", "left")
            .select("iso3", "name", under.alias("uk_sanctions_regime"),
                    F.coalesce("designations", F.lit(0)).alias("sanctions_designations"),
                    sev.alias("active_event_severity"),
                    F.greatest(sev, F.when(under, F.lit(fixed.SANCTIONS_RISK)).otherwise(F.lit(0.0)))
                    .alias("country_risk")))


def import_flow(imports: DataFrame, commodities: DataFrame) -> DataFrame:
    """Value and share per (commodity, country). Value without a country stays in the denominator."""
    by_country = imports.groupBy("cn8_code", "iso3").agg(
        sum_units(F.col("value_gbp"), MONEY).alias("_v"), F.min("period_start").alias("period_start"),
        F.max("period_end").alias("period_end"))
    totals = by_country.groupBy("cn8_code").agg(F.sum("_v").alias("_tot"))
    return (known(by_country.filter(F.col("iso3").isNotNull() & (F.col("_v") > 0)), commodities)
            .join(totals, "cn8_code")
            .select(F.concat_ws("-", "cn8_code", "iso3", "period_end").alias("flow_id"), "cn8_code", "iso3",
                    "period_start", "period_end", (F.col("_v") / F.lit(MONEY)).alias("value_gbp"),
                    F.try_divide(F.col("_v").cast("double"), F.col("_tot").cast("double"))
                    .alias("share_of_uk_imports")))


# ---- suppliers -----------------------------------------------------------------------------------------------

def supplier_spend(suppliers: DataFrame, po: DataFrame) -> DataFrame:
    """All suppliers with their spend in 1e-4 units, 0 when nothing was bought."""
    spend = po.groupBy("vendor_id").agg(sum_units(F.col("amount_gbp"), MONEY).alias("_s"))
    return (suppliers.join(spend, "vendor_id", "left")
            .withColumn("spend_units", F.coalesce("_s", F.lit(0).cast("bigint"))).drop("_s"))


def criticality_cuts(spend: DataFrame) -> DataFrame:
    """One row: the lowest spend whose percent rank reaches each level (null when none does).

    percent_rank = rows strictly below / (n - 1) only grows with spend, so two cut values say it all.
    """
    ranked = rows_below(spend, "spend_units")
    n = ranked.agg(F.sum("n").alias("t")).scalar()
    rank = F.coalesce(F.try_divide(F.col("below").cast("double"), (n - 1).cast("double")), F.lit(0.0))
    return ranked.agg(*[F.min(F.when(rank >= F.lit(cut), F.col("spend_units"))).alias(level)
                        for level, cut in fixed.CRITICALITY_CUTS.items()])


def supplier_criticality(spend: DataFrame, overrides: DataFrame) -> DataFrame:
    """A person's choice, else high / medium / low by percent rank of spend over all suppliers."""
    cuts = criticality_cuts(spend.select("spend_units")).select(F.struct(*fixed.CRITICALITY_CUTS)).scalar()
    level = F.lit("low")
    for name in reversed(list(fixed.CRITICALITY_CUTS)):
        level = F.when(F.col("spend_units") >= cuts[name], F.lit(name)).otherwise(level)
    return (spend.join(overrides.select("vendor_id", F.col("criticality").alias("_set")), "vendor_id", "left")
            .withColumn("criticality", F.coalesce("_set", level)).drop("_set"))


def erp_supplier(clean_suppliers: DataFrame, po: DataFrame, overrides: DataFrame) -> DataFrame:
    """clean_suppliers already carries country_iso3."""
    # The ranks read the spend several times: at rest, the lines are summed once.
    ranked = supplier_criticality(at_rest(supplier_spend(clean_suppliers, po), "supplier-spend"), overrides)
    return ranked.select("vendor_id", "vendor_name", "postcode", "country", "country_iso3", "stated_company_number",
                         (F.col("spend_units") / F.lit(MONEY)).alias("spend_12m_gbp"), "criticality")


def resolves_to(machine: DataFrame, overrides: DataFrame) -> DataFrame:
    """Machine matches with decisions on top: reject removes, confirm replaces with full confidence.

    machine: rec_id, company_number, match_method, match_score, confidence, needs_review.
    overrides: vendor_id, company_number, decision.
    """
    m = machine.withColumnRenamed("rec_id", "vendor_id")
    o = overrides.select("vendor_id", F.col("company_number").alias("_to"), F.col("decision").alias("_decision"))
    decided = F.col("_decision").isNotNull()
    return (m.join(o, "vendor_id", "full_outer").filter(F.coalesce("_decision", F.lit("")) != "reject")
            .select("vendor_id", F.coalesce("_to", "company_number").alias("company_number"),
                    F.when(decided, F.concat(F.lit("human_"), F.col("_decision"))).otherwise(F.col("match_method"))
                    .alias("match_method"), "match_score",
                    F.when(F.col("_decision") == "confirm", F.lit(1.0)).otherwise(F.col("confidence"))
                    .alias("confidence"),
                    F.coalesce(~decided & F.col("needs_review"), F.lit(False)).alias("needs_review")))


# ---- companies -----------------------------------------------------------------------------------------------

def company_scope(companies: DataFrame, imports_link: DataFrame, resolves: DataFrame) -> DataFrame:
    """Companies an importer or a supplier resolved to."""
    touched = imports_link.select("company_number").union(resolves.select("company_number")).distinct()
    return companies.join(touched, "company_number", "left_semi")


def fragility(companies: DataFrame, as_of: Column) -> DataFrame:
    """Overdue flags, fragility score and its reasons. An unknown signal counts as absent, in score and reasons."""
    flagged = companies.withColumns({
        "accounts_overdue": F.coalesce(F.col("accounts_next_due") < as_of, F.lit(False)),
        "confirmation_overdue": F.coalesce(F.col("confstmt_next_due") < as_of, F.lit(False))})
    no = F.lit(False)
    signals = (
        ("not_active", F.coalesce(F.col("status") != "Active", no), F.concat(F.lit("status: "), F.col("status"))),
        ("accounts_overdue", F.col("accounts_overdue"), F.lit("accounts overdue")),
        ("confirmation_overdue", F.col("confirmation_overdue"), F.lit("confirmation statement overdue")),
        ("younger_than_2y", F.coalesce(F.col("incorporated_on") > F.add_months(as_of, -24), no),
         F.lit("incorporated < 2 years ago")),
        ("charges_outstanding", F.coalesce(F.col("mortgages_outstanding") > 0, no), F.lit("outstanding charges")))
    score = reduce(lambda a, b: a + b,
                   [F.lit(fixed.FRAGILITY_WEIGHTS[name]) * on.cast("int") for name, on, _ in signals])
    return flagged.select(
        "company_number", "name", "status", "category", "postcode", "incorporated_on", "sic_codes",
        "mortgages_outstanding", "accounts_overdue", "confirmation_overdue",
        F.least(F.lit(1.0), score).alias("fragility_score"),
        F.array_compact(F.array(*[F.when(on, why) for _, on, why in signals])).alias("fragility_reasons"))


def company(companies: DataFrame, imports_link: DataFrame, resolves: DataFrame, as_of: Column) -> DataFrame:
    return fragility(company_scope(companies, imports_link, resolves), as_of)


# ---- whole layers --------------------------------------------------------------------------------------------

def apply_edits(t: Tables, as_of: Column) -> Tables:
    """The three tables that decisions can change. Used by the full build and alone after an action.

    Needs clean erp_supplier and companies, ontology po_line and link_company_imports, resolution
    supplier_company, and the folded writeback tables.
    """
    out = Planned({
        "erp_supplier": lambda: erp_supplier(t["clean_erp_supplier"], t["po_line"], t["criticality_override"]),
        "link_supplier_resolves_to": lambda: resolves_to(t["supplier_company"], t["match_override"]),
        "company": lambda: company(t["clean_companies"], t["link_company_imports"], out["link_supplier_resolves_to"],
                                   as_of),
    })
    return out


def build(t: Tables, as_of: Column, purchases: Callable[[], DataFrame] | None = None) -> Tables:
    """All ontology tables from clean_*, resolution and writeback tables.

    purchases: plans the rows of po_line without their ids, where these come cheaper; the suppliers' spend needs no more.
    """
    edited = lambda name: lambda: edits[name]
    out = Planned({
        "commodity": lambda: commodity(t["clean_commodity"]),
        "po_line": lambda: po_line(t["clean_po_line"], out["commodity"]),
        "link_company_imports": lambda: company_imports(t["trader_company"], t["clean_trader_commodity"],
                                                        out["commodity"]),
        **{name: edited(name) for name in ("erp_supplier", "link_supplier_resolves_to", "company")},
        "risk_event": lambda: t["clean_risk_event"],
        "link_event_affects": lambda: t["clean_event_country"].select("event_id", "iso3").distinct(),
        "country": lambda: country(
            country_keys(t["clean_imports"], t["clean_event_country"], t["clean_sanctions"], t["clean_erp_supplier"]),
            t["country_names"], t["clean_sanctions"], out["risk_event"], out["link_event_affects"]),
        "import_flow": lambda: import_flow(t["clean_imports"], out["commodity"]),
        "alert": lambda: t["alert"],
    })
    edits = apply_edits(ChainMap(Planned({"po_line": purchases} if purchases else {}), out, t), as_of)
    return out


def _count(df: DataFrame, metric: str, value: Column | None = None) -> DataFrame:
    return df.agg((F.count(F.lit(1)) if value is None else value).cast("double").alias("value")).select(
        F.lit(metric).alias("metric"), "value")


def data_quality_report(t: Tables) -> DataFrame:
    """(metric, value): what was dropped, unresolved, converted or needs a person."""
    codes, resolves = t["clean_trader_commodity"], t["link_supplier_resolves_to"]
    shared = (resolves.filter(F.col("company_number").isNotNull()).groupBy("company_number")
              .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
    review = F.col("needs_review")
    return reduce(DataFrame.unionByName, [
        _count(codes.select("trader_id").distinct(), "traders_in_scope"),
        _count(t["trader_company"], "traders_resolved"),
        _count(t["trader_company"].filter(review), "traders_needing_review"),
        _count(codes.select("cn8_code").distinct().join(t["clean_commodity"].select("cn8_code"), "cn8_code",
                                                        "left_anti"), "trader_codes_unknown"),
        _count(t["clean_imports"].filter(F.col("iso3").isNull()), "import_value_without_country",
               F.round(total_units(units(F.col("value_gbp"), MONEY)).cast("double") / F.lit(MONEY))),
        _count(t["clean_erp_supplier"], "vendors"),
        _count(resolves.filter(F.col("company_number").isNotNull()), "vendors_resolved"),
        _count(resolves.filter(review), "vendors_needing_review"),
        _count(shared, "vendors_sharing_a_company", F.coalesce(F.sum("n"), F.lit(0))),
        _count(t["clean_po_line"].filter(F.col("original_currency") != "GBP"), "po_lines_converted"),
        _count(t["clean_risk_event"].filter("is_current"), "current_events"),
        _count(t["clean_po_line"].filter(F.col("amount_gbp").isNull()), "po_lines_without_rate"),
    ])
