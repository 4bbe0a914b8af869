"""Registered queries over the given tables, and the same questions as SQL for the side-by-side check."""
from __future__ import annotations

import os
import sys
from collections import ChainMap
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from riskloom.functions import fixed, normalize as nz, similarity as sim  # noqa: E402
from riskloom.operators import actions, contract, exposure as ex, graph, matching  # noqa: E402
from riskloom.plans import build, standins, views  # noqa: E402
from riskloom.plans.spec import LINKS, OBJECTS  # noqa: E402
from riskloom.plans.standins import Standins  # noqa: E402
from riskloom.sources import companies as companies_src, erp as erp_src, events as events_src  # noqa: E402
from riskloom.sources import sanctions as sanctions_src  # noqa: E402
from riskloom.sources import trade  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Standins], DataFrame]) -> Callable[[Standins], DataFrame]:
    """Registers fn under its name; it gets the given tables as domain tables."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(standins.of(spark, sf_dir))
    return fn


def text(*names: str) -> list:
    """Dates, times and lists as text, so that both sides print them alike."""
    return [F.col(n).cast("string").alias(n) for n in names]


# ---- cleaning --------------------------------------------------------------------------------------------------

@query
def norm_name(s: Standins) -> DataFrame:
    return s.given("documents").select("doc_id", nz.norm_name(F.col("text")).alias("name_norm"))


@query
def norm_postcode(s: Standins) -> DataFrame:
    return s.given("pages").select("page_id", nz.norm_postcode(F.col("url")).alias("postcode_norm"))


@query
def name_core(s: Standins) -> DataFrame:
    return s.given("documents").select("doc_id", nz.name_core(F.col("text")).alias("name_core"))


@query
def trader_surrogate_key(s: Standins) -> DataFrame:
    place = F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_nationkey").cast("string"))
    return s.given("customer").select("c_custkey", nz.surrogate_key(F.col("c_name"), place).alias("trader_id"))


@query
def regno_repair(s: Standins) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    raw = (F.when(F.col("c_acctbal") < 0, F.concat(F.lit(" sc"), key, F.lit(" ")))
           .when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(key))
    return s.given("customer").select("c_custkey", nz.regno(raw).alias("company_number"))


@query
def fx_convert(s: Standins) -> DataFrame:
    return s.purchases.select("vendor_id", "cn8_code", "original_currency", "amount_gbp")


@query
def po_line_id(s: Standins) -> DataFrame:
    return s.clean_po_line.select("po_line_id", "vendor_id", "cn8_code")


@query
def country_override_map(s: Standins) -> DataFrame:
    n = F.col("n_nationkey")
    special = {i: code for i, code in enumerate(fixed.TRADE_COUNTRY_OVERRIDES)}
    nation = s.given("nation").withColumn(
        "alpha2", F.coalesce(nz.lookup(n, special), F.when(n != 24, F.concat(F.lit("N"), n))))
    # The register lacks the nations of region 4.
    register = nation.filter(F.col("n_regionkey") < 4).select("alpha2", F.upper("n_name").alias("iso3")).filter(
        F.col("alpha2").isNotNull())
    coded = s.given("customer").join(nation.select(n.alias("c_nationkey"), "alpha2"), "c_nationkey")
    return trade.to_iso3(coded, "alpha2", register).select("c_custkey", "alpha2", "iso3")


@query
def date_formats(s: Standins) -> DataFrame:
    d = F.col("o_orderdate")
    slashed = F.when(F.col("o_orderstatus") == "P", F.lit("31/02/1999")).when(
        F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return s.given("orders").select(
        "o_orderkey", nz.day_month_year(slashed).cast("string").alias("tolerant"),
        nz.day_mon_yy(F.upper(F.date_format(d, "dd-MMM-yy"))).cast("string").alias("strict"))


@query
def regime_extract(s: Standins) -> DataFrame:
    nation = s.given("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    seg = F.col("c_mktsegment")
    regime = (F.when(seg == "BUILDING", F.lit("The Global Human Rights Sanctions Regulations 2020"))
              .when(seg == "HOUSEHOLD", F.lit("The Russia (Sanctions) (EU Exit) Regulations 2019"))
              .when(seg == "MACHINERY", F.concat(F.upper("n_name"), F.lit(" (Sanctions) Regulations")))
              .otherwise(F.concat(F.lit("The "), F.col("n_name"), F.lit(" (Sanctions) (EU Exit) Regulations"))))
    register = s.given("nation").filter("n_regionkey < 4").select(
        F.concat(F.lit("A"), "n_nationkey").alias("alpha2"), F.concat(F.lit("ISO"), "n_nationkey").alias("iso3"),
        F.col("n_name").alias("name"), F.lit(None).cast("string").alias("official_name"),
        F.lit(None).cast("string").alias("common_name"))
    rows = s.given("customer").join(nation, "c_nationkey").select("c_custkey", regime.alias("regime"))
    return sanctions_src.with_iso3(rows, register).select(
        "c_custkey", nz.regime_subject(F.col("regime")).alias("subject"), "iso3")


@query
def severity_map(s: Standins) -> DataFrame:
    level = standins.band(F.col("value"), (100, "Red"), (50, "Orange"), (10, "Green"), low="White")
    return s.given("events").select("event_id", level.alias("alert_level"), nz.severity(level).alias("severity"))


@query
def scope_filter(s: Standins) -> DataFrame:
    code = F.lpad((F.col("p_size") * 1_000_000 + F.col("p_partkey")).cast("string"), 8, "0")
    parts = s.given("part").select("p_partkey", code.alias("cn8_code"))
    return parts.filter(nz.in_scope(F.col("cn8_code"), ("29", "07", "41")))


@query
def sanctions_by_country(s: Standins) -> DataFrame:
    return s.sanctions


@query
def freshness(s: Standins) -> DataFrame:
    return views.freshness(s.import_flow, nz.month_label)


# ---- sources ---------------------------------------------------------------------------------------------------

@query
def clean_projection(s: Standins) -> DataFrame:
    """Customers written as register text fields, then typed by the company reader."""
    dates = s.given("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.date_format(F.min("o_orderdate"), "dd/MM/yyyy").alias("lo"),
        F.date_format(F.max("o_orderdate"), "dd/MM/yyyy").alias("hi"))
    nation = s.given("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    raw = s.given("customer").join(dates, "c_custkey", "left").join(nation, "c_nationkey").select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("company_number"),
        F.concat(F.lit("The "), "c_name", F.lit(" & co. ltd")).alias("name"),
        F.concat_ws(" ", F.col("n_name"), F.col("c_nationkey")).alias("postcode"),
        F.lit("").alias("address_line1"), F.col("n_name").alias("post_town"), F.col("c_mktsegment").alias("category"),
        F.lit("Active").alias("status"), F.col("lo").alias("incorporated_on"), F.lit("").alias("dissolved_on"),
        F.col("hi").alias("accounts_next_due"), F.lit("31/02/2000").alias("confstmt_next_due"),
        F.lit("FULL").alias("accounts_category"),
        F.when(F.col("c_acctbal") < 0, F.lit("n/a")).otherwise(F.floor("c_acctbal").cast("string"))
        .alias("mortgages_outstanding"), F.array("c_mktsegment").alias("sic_codes"))
    c = companies_src.clean(raw)
    return c.select("company_number", "name_norm", "name_core", "postcode_norm", "category",
                    *text("incorporated_on", "accounts_next_due", "confstmt_next_due"),
                    F.coalesce("mortgages_outstanding", F.lit(-1)).alias("mortgages_outstanding"))


@query
def events_parse_json(s: Standins) -> DataFrame:
    return events_src.risk_event(s.features).select(
        "event_id", "source", "event_type", "name", "alert_level", "severity", *text("start_date", "end_date"),
        "is_current", "url")


@query
def event_country_links(s: Standins) -> DataFrame:
    return events_src.event_country(s.features)


@query
def vendor_clean(s: Standins) -> DataFrame:
    return s.clean_vendors.select("vendor_id", "name_norm", "name_core", "postcode_norm", "stated_company_number")


@query
def po_line_clean(s: Standins) -> DataFrame:
    return s.clean_po_line.select("po_line_id", "vendor_id", "cn8_code", "item_description", "amount_gbp",
                                  "original_currency", *text("order_date"))


@query
def po_line_from_text(s: Standins) -> DataFrame:
    """Purchase lines written as text, then typed by the purchase cleaner."""
    return erp_src.clean_po_lines(s.raw_po_lines).select(
        "po_line_id", "vendor_id", "cn8_code", "item_description", "amount_gbp", "original_currency",
        *text("order_date"))


@query
def trailing12_rollup(s: Standins) -> DataFrame:
    t = trade.trailing12(s.monthly, end=s.last_month, chapters=None)
    return t.select("commodity_id", F.coalesce("country_id", F.lit(-1)).alias("country_id"), "value_gbp",
                    "period_start", "period_end")


# ---- entity resolution -----------------------------------------------------------------------------------------

@query
def er_block_number(s: Standins) -> DataFrame:
    return matching.block_number(s.records, s.registry).select("rec_id", "company_number", "rec_core", "cand_core")


@query
def er_block_postcode(s: Standins) -> DataFrame:
    """The whole block: every pair of names with Jaro-Winkler >= 0.80; rules on scores come later."""
    return matching.postcode_pairs(s.records, s.registry, floor=0.0).select(
        "postcode_norm", "rec_core", "cand_core", F.round("jw", 6).alias("jw"),
        F.round("match_score", 6).alias("match_score"))


@query
def er_block_name(s: Standins) -> DataFrame:
    return matching.block_name(s.records, s.registry).select("rec_id", "company_number", "n_exact")


@query
def er_candidates(s: Standins) -> DataFrame:
    return matching.scored_candidates(s.kept_records, s.kept_registry).select("rec_id", "match_method", "company_number",
                                                                    "score_floor")


@query
def er_match_score(s: Standins) -> DataFrame:
    return matching.scored_candidates(s.kept_records, s.kept_registry).select(
        "rec_id", "match_method", "company_number", F.round("match_score", 6).alias("match_score"),
        F.round("full_score", 6).alias("full_score"), "score_floor")


@query
def er_ambiguous(s: Standins) -> DataFrame:
    return matching.block_name(s.records, s.registry).filter("n_exact > 1").select("rec_id", "n_exact")


@query
def er_confidence(s: Standins) -> DataFrame:
    return matching.scored_candidates(s.kept_records, s.kept_registry).select(
        "rec_id", "match_method", "company_number", "confidence", "score_floor")


@query
def er_best_match(s: Standins) -> DataFrame:
    return matching.resolve(s.kept_records, s.kept_registry).withColumn("match_score", F.round("match_score", 6))


@query
def er_trader_scope(s: Standins) -> DataFrame:
    """Customers that ordered a part in scope, as trader records."""
    traders = s.given("customer").select(F.col("c_custkey").alias("trader_id"),
                                         nz.norm_name(F.col("c_name")).alias("name_norm"))
    codes = build.known(s.trader_commodity, s.commodity.filter("hs2_code = 'Brand#7'"))
    return matching.trader_records(traders, codes).select("rec_id", "name_norm", "stated_company_number")


@query
def er_precision_recall(s: Standins) -> DataFrame:
    """Vendor matches of the resolver judged by the rule that made the vendors, which it does not see."""
    i = F.col("s_suppkey")
    truth = s.given("supplier").select(
        i.alias("rec_id"), F.when(i % 10 != 9, F.lpad((i * 7 + 3).cast("string"), 8, "0")).alias("true_company_number"))
    return matching.evaluate(truth, s.supplier_company)


@query
def er_unambiguous_pool(s: Standins) -> DataFrame:
    return matching.unambiguous_pool(s.records, s.registry).select("rec_id", "company_number")


@query
def sample_by_hash(s: Standins) -> DataFrame:
    """Twenty customers by hash, with the scoped parts they ordered."""
    codes = build.known(s.trader_commodity, s.commodity)
    pool = matching.sample_by_hash(codes.select("trader_id").distinct(), "trader_id", 20)
    return (codes.join(pool, "trader_id").groupBy("trader_id")
            .agg(F.array_join(F.array_sort(F.collect_list("cn8_code")).cast("array<string>"), ",").alias("codes")))


# ---- ontology --------------------------------------------------------------------------------------------------

@query
def po_known_commodity(s: Standins) -> DataFrame:
    return s.po.select("vendor_id", "cn8_code", "amount_gbp")


@query
def company_imports_link(s: Standins) -> DataFrame:
    return s.imports_link


@query
def country_union(s: Standins) -> DataFrame:
    keys = build.country_keys(s.imports, s.event_country, s.sanctions, s.clean_vendors)
    return build.named_countries(keys, s.country_names)


@query
def country_risk(s: Standins) -> DataFrame:
    return s.ontology["country"]


@query
def import_flow_share(s: Standins) -> DataFrame:
    return s.import_flow


@query
def supplier_spend(s: Standins) -> DataFrame:
    return build.supplier_spend(s.clean_vendors, s.po).select(
        "vendor_id", (F.col("spend_units") / F.lit(nz.MONEY)).alias("spend_12m_gbp"))


@query
def supplier_criticality(s: Standins) -> DataFrame:
    return s.ontology["erp_supplier"].select("vendor_id", "spend_12m_gbp", "criticality")


@query
def resolves_to_override(s: Standins) -> DataFrame:
    return s.ontology["link_supplier_resolves_to"]


@query
def company_scope(s: Standins) -> DataFrame:
    r = s.ontology["link_supplier_resolves_to"]
    return build.company_scope(s.companies, s.imports_link, r).select("company_number", "name")


@query
def company_fragility(s: Standins) -> DataFrame:
    return build.fragility(s.companies, s.as_of).select(
        "company_number", "accounts_overdue", "confirmation_overdue", "fragility_score",
        F.array_join("fragility_reasons", "; ").alias("fragility_reasons"))


@query
def apply_edits(s: Standins) -> DataFrame:
    """The tables decisions change, joined: supplier, its match and its company."""
    t = build.apply_edits(s.ontology, s.as_of)
    c = t["company"].select("company_number", "name", "fragility_score")
    return (t["erp_supplier"].select("vendor_id", "criticality")
            .join(t["link_supplier_resolves_to"], "vendor_id", "left").join(c, "company_number", "left"))


@query
def resolves_to_first_day(s: Standins) -> DataFrame:
    return s.first_day["link_supplier_resolves_to"]


@query
def criticality_first_day(s: Standins) -> DataFrame:
    return s.first_day["erp_supplier"].select("vendor_id", "spend_12m_gbp", "criticality")


@query
def company_scope_first_day(s: Standins) -> DataFrame:
    return s.first_day["company"].select("company_number", "name", "fragility_score")


@query
def review_queue_first_day(s: Standins) -> DataFrame:
    return views.review_queue(s.first_day)


@query
def data_quality_report(s: Standins) -> DataFrame:
    return build.data_quality_report(s.ontology)


# ---- contract --------------------------------------------------------------------------------------------------

@query
def contract_checks(s: Standins) -> DataFrame:
    return contract.validate(s.ontology)


@query
def contract_pk(s: Standins) -> DataFrame:
    t = s.ontology
    parts = [contract.key_counts(t[o.table], o.key).select(F.lit(name).alias("object_type"), "n", "n_distinct",
                                                           "n_null") for name, o in OBJECTS.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def contract_orphans(s: Standins) -> DataFrame:
    """Both ends of all nine links, and the trader codes, some of which are unknown."""
    t = s.ontology
    parts = [contract.orphans(t[l.table], key, t[OBJECTS[obj].table], OBJECTS[obj].key).select(
        F.lit(f"{name} {side}").alias("link"), "n")
        for name, l in LINKS.items()
        for side, key, obj in (("from", l.source_key, l.source), ("to", l.target_key, l.target))]
    parts.append(contract.orphans(s.trader_commodity, "cn8_code", s.commodity, "cn8_code").select(
        F.lit("trader codes").alias("link"), "n"))
    return reduce(DataFrame.unionByName, parts)


@query
def contract_cardinality(s: Standins) -> DataFrame:
    """Links checked as if each were many-to-one; the many-to-many ones show their fan-out."""
    t = s.ontology
    parts = [contract.fan_out(t[l.table], l).select(F.lit(name).alias("link"), "n")
             for name, l in LINKS.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- exposure --------------------------------------------------------------------------------------------------

@query
def exposure_event_risk(s: Standins) -> DataFrame:
    return ex.event_risk(s.risk_event, s.event_country)


@query
def spend_weights(s: Standins) -> DataFrame:
    return s.weights.select("vendor_id", "cn8_code", "country_iso3", "spend", "w")


@query
def inferred_commodity_risk(s: Standins) -> DataFrame:
    """Per footprint, at severity 1."""
    return ex.inferred_per_footprint(s.flow_at_rest, s.countries)


@query
def exposure_per_line(s: Standins) -> DataFrame:
    return ex.per_line(s.weights, s.import_flow, s.ontology["country"]).select(
        "vendor_id", "cn8_code", "w", "risk", F.coalesce("via_country", F.lit(-1)).alias("via_country"), "path_type")


@query
def supplier_exposure(s: Standins) -> DataFrame:
    """Per footprint and severity: events that share both expose the same suppliers alike."""
    return s.scored


@query
def supplier_exposure_all_risk(s: Standins) -> DataFrame:
    return ex.all_risk_exposure(s.weights, s.import_flow, s.ontology["country"])


@query
def priority(s: Standins) -> DataFrame:
    """Of every event and every supplier that it exposes."""
    return ex.for_events(s.suppliers, s.events).select("event_id", "vendor_id", "priority")


@query
def event_material_counts(s: Standins) -> DataFrame:
    return ex.material_counts(s.risk_event, s.events, s.scored)


# ---- graph -----------------------------------------------------------------------------------------------------

def _typed_properties(nodes: DataFrame) -> DataFrame:
    """JSON prints numbers differently per engine: compare keys and titles."""
    return nodes.select("node_id", "object_type", F.coalesce("title", F.lit("")).alias("title"))


@query
def graph_nodes(s: Standins) -> DataFrame:
    return _typed_properties(graph.nodes(s.ontology))


@query
def graph_edges(s: Standins) -> DataFrame:
    return graph.edges(s.ontology).select("src", "dst", "link_type")


@query
def graph_node_properties(s: Standins) -> DataFrame:
    return graph.node_properties(s.ontology)


@query
def graph_edge_properties(s: Standins) -> DataFrame:
    return graph.edge_properties(s.ontology)


@query
def graph_step(s: Standins) -> DataFrame:
    """Two hops from every event: the countries it affects, the suppliers located there."""
    t = s.ontology
    e = graph.edges(t, ["affects", "located_in"])
    start = t["risk_event"].select(graph.node_id("RiskEvent", F.col("event_id")).alias("event"))
    there = graph.step(start, e, "affects", "event", "country")
    return graph.step(there, e, "located_in", "country", "supplier", forward=False).select(
        "event", "country", "supplier")


def _walked(s: Standins) -> ChainMap:
    """The tables of the walk. Lines come without their ids, which no step follows and which cost a numbering of all."""
    return ChainMap({"erp_supplier": s.clean_vendors, "import_flow": s.flow_at_rest, "po_line": s.po}, s.ontology)


@query
def graph_footprint_impact(s: Standins) -> DataFrame:
    """The walk for all events, once per footprint and severity; it must equal supplier_exposure."""
    return graph.footprint_impact(_walked(s), s.vendor_home.filter("is_home"), s.events)


@query
def graph_event_impact(s: Standins) -> DataFrame:
    """The walk for the events of the latest hour."""
    last = s.risk_event.agg(F.max(F.substring("name", -13, 13)).alias("h")).scalar()
    asked = s.risk_event.filter(F.substring("name", -13, 13) == last)
    return graph.event_impact(_walked(s), s.vendor_home.filter("is_home"), asked)


@query
def explain_path(s: Standins) -> DataFrame:
    """For every supplier that a current event exposes."""
    t = ChainMap({"erp_supplier": s.clean_vendors}, s.ontology)
    return graph.explain_path(ex.for_events(s.scored, s.current), t, F.col("is_home"))


def _focus(s: Standins) -> DataFrame:
    """The pairs that the breakdowns are asked for: every event and its top supplier, once for each kind of event."""
    one = s.kinds.select(F.col("kind").alias("event_id")).distinct()
    return views.top_supplier(s.suppliers, s.events.join(one, "event_id", "left_semi"))


def _breakdown_of_kinds(s: Standins) -> DataFrame:
    """Events of one footprint and severity have the same breakdown: taken for the first event of each kind."""
    return graph.breakdown(_focus(s), s.ontology, s.weights)


def _breakdown(s: Standins) -> DataFrame:
    return graph.for_all(_breakdown_of_kinds(s), s.kinds)


@query
def exposure_breakdown(s: Standins) -> DataFrame:
    return _breakdown(s).select(
        "event_id", "vendor_id", "cn8_code", "description", "spend", "weight", "po_lines", "risk", "contribution",
        F.coalesce("iso3", F.lit(-1)).alias("iso3"), F.coalesce("country", F.lit("")).alias("country"),
        F.coalesce("share", F.lit(0.0)).alias("share"))


@query
def exposure_breakdown_nested(s: Standins) -> DataFrame:
    """One row per commodity, its countries as a list."""
    nested = graph.breakdown_nested(_breakdown(s))
    return nested.select("event_id", "vendor_id", "cn8_code", "risk", "contribution", F.array_join(F.transform(
        "countries", lambda c: F.concat_ws("=", c["iso3"].cast("string"), c["country"])), "; ").alias("countries"))


@query
def path_subgraph(s: Standins) -> DataFrame:
    return graph.path_subgraph(_breakdown_of_kinds(s), s.ontology, s.ontology["link_supplier_resolves_to"], events=s.kinds)


@query
def graph_counts(s: Standins) -> DataFrame:
    return graph.counts(graph.nodes(s.ontology), graph.edges(s.ontology))


@query
def suppliers_reached(s: Standins) -> DataFrame:
    """How many each event reaches, counted per footprint."""
    n = graph.reached(s.po, s.clean_vendors, s.flow_at_rest, s.countries)
    return s.events.join(n, "footprint", "left").select("event_id", F.coalesce("reached", F.lit(0)).alias("reached"))


# ---- actions ---------------------------------------------------------------------------------------------------

JUDGED = ("request_id", "vendor_id", "accepted", "reason")


@query
def action_raise_alert(s: Standins) -> DataFrame:
    return actions.raise_alert(s.requests, s.clean_vendors, s.risk_event, s.alert).select(
        *JUDGED, "event_id", "alert_id")


@query
def action_alert_transitions(s: Standins) -> DataFrame:
    judged, _ = actions.update_alert_status(s.requests, s.alert)
    return judged.select("request_id", "alert_id", "from", "to", "accepted", "reason")


@query
def alert_after_updates(s: Standins) -> DataFrame:
    _, after = actions.update_alert_status(s.requests, s.alert)
    return after.select("alert_id", "status", "note", *text("updated_at"))


@query
def action_confirm_match(s: Standins) -> DataFrame:
    return s.confirmed.select(*JUDGED, "company_number")


@query
def action_reject_match(s: Standins) -> DataFrame:
    return s.rejected.select(*JUDGED)


@query
def action_set_criticality(s: Standins) -> DataFrame:
    return s.criticality_judged.select(*JUDGED, "criticality")


@query
def override_latest_wins(s: Standins) -> DataFrame:
    return actions.match_overrides(s.confirmed, s.rejected).select(
        "vendor_id", "company_number", "decision", "decided_by", *text("decided_at"))


@query
def action_log(s: Standins) -> DataFrame:
    judged, _ = actions.judge_all(s.requests, s.clean_vendors, s.risk_event, s.companies, s.alert)
    return actions.action_log(judged).select("request_id", "action", "params", "actor", *text("logged_at"))


# ---- views -----------------------------------------------------------------------------------------------------

@query
def event_list(s: Standins) -> DataFrame:
    return views.event_list(s.ontology, ex.material_counts(s.risk_event, s.events, s.scored)).select(
        "event_id", "event_type", "name", "alert_level", "severity", *text("start_date", "end_date"), "is_current",
        "countries", "n_countries", "material")


@query
def event_detail(s: Standins) -> DataFrame:
    return views.event_detail(s.ontology).select("event_id", "name", "alert_level", *text("start_date"), "countries")


def _shown(table: DataFrame) -> DataFrame:
    return table.select(
        "event_id", "vendor_id", "vendor_name", "exposure_score", "path_type", "criticality",
        F.coalesce("company_name", F.lit("")).alias("company_name"),
        F.coalesce("company_status", F.lit("")).alias("company_status"),
        F.coalesce("fragility_score", F.lit(-1.0)).alias("fragility_score"),
        F.coalesce(F.array_join("fragility_reasons", "; "), F.lit("")).alias("fragility_reasons"),
        F.coalesce("alert_id", F.lit("")).alias("alert_id"),
        F.coalesce("alert_status", F.lit("")).alias("alert_status"), "priority", "hs4_description",
        "driver_country_name")


@query
def exposure_table(s: Standins) -> DataFrame:
    return views.ranked(_shown(s.exposure_table))


@query
def exposure_top_n(s: Standins) -> DataFrame:
    return (views.top_rows(s.suppliers, s.events).select("event_id", "position", "vendor_id", "priority")
            .join(views.hidden_counts(s.suppliers, s.events), "event_id"))


@query
def event_kpis(s: Standins) -> DataFrame:
    return views.event_kpis(s.ontology, s.suppliers, s.events)


@query
def default_focus(s: Standins) -> DataFrame:
    return views.default_focus(s.ontology, s.suppliers, s.events)


@query
def supplier_detail(s: Standins) -> DataFrame:
    return views.supplier_detail(s.ontology).select(
        "vendor_id", "vendor_name", "criticality", F.coalesce("company_number", F.lit("")).alias("company_number"),
        F.coalesce("match_method", F.lit("")).alias("match_method"),
        F.coalesce("confidence", F.lit(-1.0)).alias("confidence"),
        F.coalesce("company_name", F.lit("")).alias("company_name"),
        F.coalesce(F.array_join("sic_codes", ","), F.lit("")).alias("sic_codes"),
        F.coalesce("fragility_score", F.lit(-1.0)).alias("fragility_score"), "duplicate_vendors")


@query
def supplier_alerts(s: Standins) -> DataFrame:
    return views.supplier_alerts(s.ontology).select("vendor_id", "alert_id", "status", *text("created_at"),
                                                   "event_name")


@query
def alert_queue(s: Standins) -> DataFrame:
    return views.alert_queue(s.ontology).select("alert_id", "status", *text("updated_at"), "vendor_name",
                                               "criticality", "event_name", "alert_level")


@query
def review_queue(s: Standins) -> DataFrame:
    return views.review_queue(s.ontology)


@query
def health_summary(s: Standins) -> DataFrame:
    """Last 25 log rows."""
    judged, _ = actions.judge_all(s.requests, s.clean_vendors, s.risk_event, s.companies, s.alert)
    return views.recent_log(actions.action_log(judged)).select("request_id", "action", "params", "actor", *text("logged_at"))


@query
def health_report(s: Standins) -> DataFrame:
    """Checks, quality metrics and the last log rows."""
    judged, _ = actions.judge_all(s.requests, s.clean_vendors, s.risk_event, s.companies, s.alert)
    return views.health(s.ontology, actions.action_log(judged), contract.validate(s.ontology),
                        build.data_quality_report(s.ontology))


def entry(spark: SparkSession) -> DataFrame:
    """Every footprint and severity x every supplier it exposes, over the smallest tables."""
    return QUERIES["supplier_exposure"](spark, "/root/testdata/sf0.001")


try:  # the one guard: this module works without the subpackage and the pipeline
    import corpus_pipeline
    from riskloom.llm import registry
except ImportError as e:  # an empty folder is a package without modules
    if e.name not in ("corpus_pipeline", "riskloom.llm"):
        raise
    LLM_QUERIES, LLM_SQL = {}, {}
else:
    LLM_QUERIES, LLM_SQL = {**registry.QUERIES, "pipeline": corpus_pipeline.run}, dict(registry.SQL)
    if corpus_pipeline.ORACLE_SQL:
        LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Query]:
    return {**QUERIES, **LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    from oracle.sql import ORACLES
    return {**ORACLES, **LLM_SQL}
