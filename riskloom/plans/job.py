"""The whole pipeline as one job: raw files -> clean -> resolution -> ontology -> meta, each layer written to storage.

Writeback tables live beside the rebuilt layers and are only read here, so what people decided survives a rebuild.
"""
from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.operators import actions, contract, matching
from riskloom.plans import build
from riskloom.sources import companies, erp, events, importers, layers, sanctions, trade

RAW = ("companies", "importers", "commodity", "country", "iso", "trade", "events", "sanctions", "vendors", "po_lines")
ALERT = ("alert_id string, vendor_id string, event_id string, status string, owner string, note string, "
         "created_at timestamp, updated_at timestamp")
MATCH = ("vendor_id string, company_number string, decision string, decided_by string, decided_at timestamp, "
         "request_id string")
CRITICALITY = "vendor_id string, criticality string, decided_by string, decided_at timestamp, request_id string"


class ContractBroken(RuntimeError):
    """Raised when a check fails; the results are written before."""


def clean_layer(spark: SparkSession, raw: Mapping[str, str], company_lines: DataFrame) -> dict[str, DataFrame]:
    iso = trade.read_iso(spark, raw["iso"])
    lines = importers.split_lines(importers.read_lines(spark, raw["importers"]))
    feats = events.read(spark, raw["events"])
    country = trade.read_country(spark, raw["country"], iso)
    vendors = erp.clean_vendors(erp.read_vendors(spark, raw["vendors"]))
    codes = iso.select(F.col("alpha2").alias("country"), F.col("iso3").alias("country_iso3"))
    return {
        "clean_companies": companies.clean(companies.split_lines(company_lines)),
        "clean_trader": importers.traders(lines),
        "clean_trader_commodity": importers.trader_commodity(lines),
        "clean_commodity": trade.read_commodity(spark, raw["commodity"]),
        "clean_country": country,
        "clean_imports": trade.clean(trade.read_trade(spark, raw["trade"]), country),
        "clean_risk_event": events.risk_event(feats),
        "clean_event_country": events.event_country(feats),
        "clean_sanctions": sanctions.by_country(sanctions.with_iso3(sanctions.read(spark, raw["sanctions"]), iso)),
        "clean_erp_supplier": vendors.join(codes, "country", "left"),
        "clean_po_line": erp.clean_po_lines(erp.read_po_lines(spark, raw["po_lines"])),
    }


def country_names(spark: SparkSession, iso_path: str) -> DataFrame:
    from riskloom.functions import fixed
    extra = spark.createDataFrame(list(fixed.EXTRA_COUNTRY_NAMES.items()), "iso3 string, name string")
    return trade.read_iso(spark, iso_path).select("iso3", "name").unionByName(extra)


def writeback(spark: SparkSession, warehouse: str) -> dict[str, DataFrame]:
    """Alert state and the decisions that stand, folded from their append-only tables."""
    alert = layers.read(spark, warehouse, "writeback", "alert", ALERT)
    match = layers.read(spark, warehouse, "writeback", "match_override", MATCH)
    crit = layers.read(spark, warehouse, "writeback", "criticality_override", CRITICALITY)
    # An alert is appended on every change; its newest row is its state.
    state = alert.groupBy("alert_id").agg(F.max_by(F.struct(*[c for c in alert.columns if c != "alert_id"]),
                                                   F.struct("updated_at", _progress())).alias("r")).select(
        "alert_id", "r.*")
    return {"alert": state, "match_override": actions.latest_wins(match, "vendor_id", "decided_at"),
            "criticality_override": actions.latest_wins(crit, "vendor_id", "decided_at")}


def _progress() -> Column:
    """Statuses only move forward, which orders changes within one second."""
    out = F.lit(0)
    for i, s in enumerate(("open", "acknowledged", "mitigating", "closed")):
        out = F.when(F.col("status") == s, F.lit(i)).otherwise(out)
    return out


def run(spark: SparkSession, raw: Mapping[str, str], warehouse: str, as_of: Column,
        strict: bool = True) -> dict[str, DataFrame]:
    company_lines = companies.read_lines(spark, raw["companies"])  # cut once, also counted below
    clean = layers.write_all(clean_layer(spark, raw, company_lines), warehouse, "clean")
    resolution = layers.write_all({
        "trader_company": matching.resolve(
            matching.trader_records(clean["clean_trader"], clean["clean_trader_commodity"]),
            clean["clean_companies"]),
        "supplier_company": matching.resolve(
            clean["clean_erp_supplier"].withColumnRenamed("vendor_id", "rec_id"), clean["clean_companies"]),
    }, warehouse, "resolution")
    t = {**clean, **resolution, **writeback(spark, warehouse), "country_names": country_names(spark, raw["iso"])}
    t = {**t, **layers.write_all({k: v for k, v in build.build(t, as_of).items() if k != "alert"}, warehouse,
                                 "ontology")}
    now = F.current_timestamp()
    checks = layers.write(contract.validate(t).withColumn("run_at", now), warehouse, "meta", "validation")
    t["validation"] = checks
    t["data_quality"] = layers.write(build.data_quality_report(t).unionByName(
        companies.open_quotes(company_lines)).withColumn("run_at", now),
        warehouse, "meta", "data_quality")
    failed = checks.filter(~F.col("passed")).collect()  # 49 checks in all
    if failed and strict:
        raise ContractBroken("; ".join(f"{r['check']} ({r['detail']})" for r in failed))
    return t


LOG = "request_id string, action string, params string, actor string, logged_at timestamp"


def act(spark: SparkSession, requests: DataFrame, t: Mapping[str, DataFrame], warehouse: str, as_of: Column,
        batch: str | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Judge a batch, append what was accepted, and rebuild the editable tables: (judged, rebuilt tables).

    Exactly once: requests whose id another batch has logged are dropped, as are repeats of an id within the batch.
    The judged rows are staged first; every table then takes the batch under its id, the log before the others. A
    retry under the same id finds the staged rows and writes the same again.
    """
    batch = batch if batch is not None else uuid.uuid4().hex
    staged = {a: f"{warehouse}/staging/{a}/batch={batch}" for a in [*actions.LOGGED, "alert_after"]}
    if not layers.exists(spark, f"{warehouse}/staging/done/batch={batch}"):
        before = writeback(spark, warehouse)
        logged = layers.read(spark, warehouse, "writeback", "action_log", LOG).select("request_id")
        fresh = requests.dropDuplicates(["request_id"]).join(logged, "request_id", "left_anti")
        judged, after = actions.judge_all(fresh, t["erp_supplier"], t["risk_event"], t["clean_companies"],
                                          before["alert"])
        # What is appended must not change while it is appended: everything is judged against the state before.
        for a, df in [*judged.items(), ("alert_after", after)]:
            df.write.mode("overwrite").parquet(staged[a])
        spark.range(1).write.mode("overwrite").parquet(f"{warehouse}/staging/done/batch={batch}")
    judged = {a: spark.read.parquet(staged[a]) for a in actions.LOGGED}
    after = spark.read.parquet(staged["alert_after"])
    touched = after.join(judged["raise_alert"].filter("accepted").select("alert_id").union(
        judged["update_alert_status"].filter("accepted").select("alert_id")).distinct(), "alert_id", "left_semi")
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    decided = actions.match_overrides(judged["confirm_match"], judged["reject_match"])
    crit = actions.criticality_overrides(judged["set_criticality"])
    for table, df in (("action_log", actions.action_log(judged).select(*names(LOG))),
                      ("alert", touched.select(*names(ALERT))), ("match_override", decided.select(*names(MATCH))),
                      ("criticality_override", crit.select(*names(CRITICALITY)))):
        layers.put(df, warehouse, "writeback", table, batch)
    return judged, build.apply_edits({**t, **writeback(spark, warehouse)}, as_of)
