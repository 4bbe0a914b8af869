"""Read views over the built tables: event list, ranked exposure, supplier pages, queues, indicators."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.functions.normalize import total_units
from riskloom.operators.exposure import for_events, priority

Tables = Mapping[str, DataFrame]
THRESHOLD = 0.10
IN_FLIGHT = ("open", "acknowledged", "mitigating")


def affected_countries(t: Tables) -> DataFrame:
    """Per event its country names, ordered, and their number. An event touches each country once."""
    named = t["link_event_affects"].join(t["country"].select("iso3", F.col("name").alias("_c")), "iso3", "left")
    return named.groupBy("event_id").agg(
        F.array_join(F.array_sort(F.collect_list("_c")), ", ").alias("countries"),
        F.count("_c").alias("n_countries"))


def event_list(t: Tables, counts: DataFrame | None = None, current_only: bool = False) -> DataFrame:
    """Events with countries and, given counts (event_id, material), their material suppliers; newest and worst first."""
    ev = t["risk_event"].filter("is_current") if current_only else t["risk_event"]
    out = ev.join(affected_countries(t), "event_id", "left").withColumn(
        "n_countries", F.coalesce("n_countries", F.lit(0)))
    if counts is not None:
        out = out.join(counts.select("event_id", "material"), "event_id", "left").withColumn(
            "material", F.coalesce("material", F.lit(0)))
    return out.orderBy(F.desc("is_current"), F.desc("severity"), F.desc("start_date"), "event_id")


def event_detail(t: Tables, which: Column | None = None) -> DataFrame:
    ev = t["risk_event"] if which is None else t["risk_event"].filter(which)
    return ev.join(affected_countries(t).select("event_id", "countries"), "event_id", "left")


def latest_alert(alerts: DataFrame) -> DataFrame:
    """Newest alert per (supplier, event); the highest id on equal times."""
    return (alerts.groupBy("vendor_id", "event_id")
            .agg(F.max_by(F.struct("alert_id", "status"), F.struct("created_at", "alert_id")).alias("a"))
            .select("vendor_id", "event_id", F.col("a.alert_id").alias("alert_id"),
                    F.col("a.status").alias("alert_status")))


def _supplier_facts(t: Tables) -> DataFrame:
    s = t["erp_supplier"].select("vendor_id", "vendor_name", "criticality", "country_iso3", "spend_12m_gbp")
    r = t["link_supplier_resolves_to"].select("vendor_id", "company_number", "needs_review")
    c = t["company"].select("company_number", F.col("name").alias("company_name"),
                            F.col("status").alias("company_status"), "fragility_score", "fragility_reasons")
    return s.join(r, "vendor_id", "left").join(c, "company_number", "left")


def scored_suppliers(t: Tables, scored: DataFrame) -> DataFrame:
    """Exposure per (footprint, severity, supplier) with the supplier's facts and its priority."""
    return scored.join(_supplier_facts(t), "vendor_id").withColumn("priority", priority(
        F.col("exposure_score"), F.col("criticality"), F.col("fragility_score"))).drop("company_number")


def exposure_table(t: Tables, table: DataFrame, events: DataFrame) -> DataFrame:
    """Every supplier that the given events expose, with what a person needs to triage it.

    table: scored_suppliers(). events: event_id, footprint, severity of the events asked for.
    """
    com = t["commodity"].select(F.col("cn8_code").alias("driver_commodity"), "hs4_description")
    cty = t["country"].select(F.col("iso3").alias("driver_country"), F.col("name").alias("driver_country_name"))
    return (for_events(table, events)
            .join(latest_alert(t["alert"]), ["vendor_id", "event_id"], "left")
            .join(com, "driver_commodity", "left").join(cty, "driver_country", "left"))


def ranked(table: DataFrame) -> DataFrame:
    return table.orderBy("event_id", F.desc("priority"), "vendor_name", "vendor_id")


KIND = ("footprint", "severity")


def top_rows(table: DataFrame, events: DataFrame, threshold: float = THRESHOLD, k: int = 60) -> DataFrame:
    """First k material rows per event by priority: k per footprint and severity first, then per event."""
    w = W.partitionBy(*KIND).orderBy(F.desc("priority"), "vendor_name", "vendor_id")
    top = (table.filter(F.col("exposure_score") >= threshold).withColumn("position", F.row_number().over(w))
           .filter(F.col("position") <= k))
    return for_events(top, events)


def hidden_counts(table: DataFrame, events: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return for_events(table.groupBy(*KIND).agg(
        F.count_if(F.col("exposure_score") < threshold).alias("hidden")), events)


def event_kpis(t: Tables, table: DataFrame, events: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per event: reached, material, high-criticality material, exposure-weighted spend, alerts in flight.

    All but the alerts are counted per footprint and severity. Only (event, supplier) pairs with an alert are met
    with their score.
    """
    material = F.col("exposure_score") >= threshold
    weighted = F.floor(F.col("spend_12m_gbp") * F.col("exposure_score") * F.lit(1e4) + F.lit(0.5)).cast("bigint")
    kinds = table.groupBy(*KIND).agg(
        F.count(F.lit(1)).alias("reached"), F.count_if(material).alias("material"),
        F.count_if(material & (F.col("criticality") == "high")).alias("high_material"),
        (total_units(F.when(material, weighted)).cast("double") / F.lit(1e4)).alias("weighted_spend"))
    flying = latest_alert(t["alert"]).filter(F.col("alert_status").isin(list(IN_FLIGHT))).join(events, "event_id")
    in_flight = flying.join(table.filter(material).select(*KIND, "vendor_id"), [*KIND, "vendor_id"]).groupBy(
        "event_id").agg(F.count(F.lit(1)).alias("in_flight"))
    return for_events(kinds, events).join(in_flight, "event_id", "left").na.fill(0, ["in_flight"])


def _top(table: DataFrame) -> DataFrame:
    return table.groupBy(*KIND).agg(F.min_by("vendor_id", F.struct(
        (-F.col("priority")).alias("p"), "vendor_name", "vendor_id")).alias("vendor_id"),
        F.count_if(F.col("exposure_score") >= THRESHOLD).alias("m"))


def top_supplier(table: DataFrame, events: DataFrame) -> DataFrame:
    """Per event its supplier of highest priority."""
    return for_events(_top(table), events).select("event_id", "vendor_id")


def default_focus(t: Tables, table: DataFrame, events: DataFrame) -> DataFrame:
    """One row: the current event (any event when none is current) with most material suppliers, and its top one."""
    pool = t["risk_event"].select("event_id", "is_current").join(for_events(_top(table), events), "event_id", "left")
    rank = F.struct((~F.col("is_current")).alias("c"), (-F.coalesce("m", F.lit(0))).alias("m"), "event_id")
    return pool.agg(F.min_by(F.struct("event_id", "vendor_id"), rank).alias("f")).select("f.*")


def supplier_detail(t: Tables) -> DataFrame:
    """Supplier page: match evidence, company, and how many other vendors resolve to the same company."""
    r = t["link_supplier_resolves_to"]
    same = r.filter(F.col("company_number").isNotNull()).groupBy("company_number").agg(
        (F.count(F.lit(1)) - 1).alias("duplicate_vendors"))
    c = t["company"].select("company_number", F.col("name").alias("company_name"),
                            F.col("status").alias("company_status"), "incorporated_on", "sic_codes",
                            "fragility_score", "fragility_reasons")
    return (t["erp_supplier"].join(r, "vendor_id", "left").join(c, "company_number", "left")
            .join(same, "company_number", "left")
            .withColumn("duplicate_vendors", F.coalesce("duplicate_vendors", F.lit(0))))


def supplier_alerts(t: Tables) -> DataFrame:
    """Alerts of each supplier, newest first, with the event's name if the event is still listed."""
    ev = t["risk_event"].select("event_id", F.col("name").alias("event_name"))
    return t["alert"].join(ev, "event_id", "left").orderBy("vendor_id", F.desc("created_at"), F.desc("alert_id"))


def alert_queue(t: Tables) -> DataFrame:
    """Open work first, last touched first."""
    s = t["erp_supplier"].select("vendor_id", "vendor_name", "criticality")
    ev = t["risk_event"].select("event_id", F.col("name").alias("event_name"), "alert_level")
    return (t["alert"].join(s, "vendor_id").join(ev, "event_id", "left")
            .orderBy(F.col("status") == "closed", F.desc("updated_at"), "alert_id"))


def review_queue(t: Tables) -> DataFrame:
    """Matches a person should look at, least certain first."""
    s = t["erp_supplier"].select("vendor_id", "vendor_name", "postcode", "stated_company_number")
    c = t["company"].select("company_number", F.col("name").alias("company_name"),
                            F.col("postcode").alias("company_postcode"))
    return (t["link_supplier_resolves_to"].filter("needs_review").join(s, "vendor_id")
            .join(c, "company_number", "left")
            .select("vendor_id", "vendor_name", "postcode", "stated_company_number", "company_number",
                    "company_name", "company_postcode", "match_method", "match_score", "confidence")
            .orderBy("confidence", "vendor_name", "vendor_id"))


def health(t: Tables, log: DataFrame, checks: DataFrame, metrics: DataFrame, n: int = 25) -> DataFrame:
    """(section, name, value): the checks with their outcome, the quality metrics and the last n log rows."""
    section = lambda df, name, key, value: df.select(
        F.lit(name).alias("section"), key.alias("name"), value.cast("string").alias("value"))
    parts = [section(checks, "check", F.col("check"), F.concat_ws(": ", F.col("passed").cast("string"), "detail")),
             section(metrics, "metric", F.col("metric"), F.col("value").cast("bigint")),
             section(recent_log(log, n), "log", F.col("request_id"), F.col("action"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def recent_log(log: DataFrame, n: int = 25) -> DataFrame:
    return log.orderBy(F.desc("logged_at"), "action", "params", "request_id").limit(n)


def freshness(import_flow: DataFrame, label) -> DataFrame:
    """First and last month of the trade data as labels; `label` turns a yyyymm column into text."""
    p = import_flow.agg(F.min("period_start").alias("s"), F.max("period_end").alias("e"))
    return p.select(label(F.col("s")).alias("first_month"), label(F.col("e")).alias("last_month"))
