import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import actions, contract, exposure as ex, graph
from riskloom.plans import build, standins, views
from riskloom.plans.spec import LINKS, OBJECTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return standins.Standins(spark, SF)


def test_priority_never_null(spark):
    df = spark.createDataFrame([(0.5, "high", None), (0.5, "odd", float("nan")), (0.5, "low", 1.0)],
                               "e double, c string, f double")
    got = [r[0] for r in df.select(ex.priority(F.col("e"), F.col("c"), F.col("f"))).collect()]
    assert got == pytest.approx([0.25, 0.15, 0.15])


def test_exposure_by_hand(spark):
    po = spark.createDataFrame([("h", "c1", 75.0), ("h", "c2", 25.0), ("a", "c1", 10.0), ("z", "c1", 0.0)],
                               "vendor_id string, cn8_code string, amount_gbp double")
    sup = ex.with_home(spark.createDataFrame([("h", "GBR"), ("a", "TWN"), ("z", None)],
                                             "vendor_id string, country_iso3 string"))
    flow = spark.createDataFrame([("c1", "TWN", 0.5), ("c1", "CHN", 0.3), ("c2", "CHN", 1.0)],
                                 "cn8_code string, iso3 string, share_of_uk_imports double")
    ev = spark.createDataFrame([("e1", 1.0), ("e2", 0.6), ("e3", 0.0)], "event_id string, severity double")
    aff = spark.createDataFrame([("e1", "TWN"), ("e2", "TWN"), ("e2", "CHN"), ("e3", "TWN")],
                                "event_id string, iso3 string")
    fp, countries = ex.footprints(aff)
    events = fp.join(ev, "event_id")
    got = {(r.event_id, r.vendor_id): (round(r.exposure_score, 9), r.driver_commodity, r.driver_country, r.path_type)
           for r in ex.for_events(ex.supplier_exposure(ex.spend_weights(po, sup), flow, events, countries), events)
           .collect()}
    assert got == {
        ("e1", "h"): (0.375, "c1", "TWN", "inferred"), ("e1", "a"): (1.0, "c1", "TWN", "direct"),
        ("e2", "h"): (round(0.6 * (0.75 * 0.8 + 0.25), 9), "c1", "TWN", "inferred"),
        ("e2", "a"): (0.6, "c1", "TWN", "direct")}


def test_shares_stay_under_one(given):
    rows = given.import_flow.groupBy("cn8_code").agg(F.sum("share_of_uk_imports").alias("s")).collect()
    assert rows and max(r.s for r in rows) <= 1.0001 and any(r.s < 0.999 for r in rows)  # unmapped value stays below


def test_walk_equals_joins(spark, given):
    """Two independent ways, for all events of the smallest tables."""
    t = {**given.ontology, "erp_supplier": given.clean_vendors}
    a = {(r.event_id, r.vendor_id): r for r in ex.for_events(given.scored, given.events).collect()}
    walked = graph.event_impact(t, given.vendor_home.filter("is_home"), given.risk_event)
    b = {(r.event_id, r.vendor_id): r for r in walked.collect()}
    assert a.keys() == b.keys() and a
    for k in a:
        assert abs(a[k].exposure_score - b[k].exposure_score) < 1e-9
        assert (a[k].driver_commodity, a[k].driver_country) == (b[k].driver_commodity, b[k].driver_country)


def test_registered_walk_covers_every_event(spark, given):
    """The registered walk holds every footprint and severity that exposes a supplier, not only the latest ones."""
    import __spark_entry__ as e
    got = e.queries()["graph_footprint_impact"](spark, SF)
    keys = ["footprint", "severity", "vendor_id"]
    assert got.select(keys).exceptAll(given.scored.select(keys)).count() == 0
    assert given.scored.select(keys).exceptAll(got.select(keys)).count() == 0
    impacted = ex.for_events(got, given.events).select("event_id").distinct().count()
    assert impacted == ex.for_events(given.scored, given.events).select("event_id").distinct().count() > 5


def test_nested_breakdown(given):
    import __spark_entry__ as e
    flat = e._breakdown(given)
    nested = graph.breakdown_nested(flat).collect()
    assert sum(len(r.countries) or 1 for r in nested) == flat.count()
    assert all(r.countries == sorted(r.countries, key=lambda c: -c.share) for r in nested)


def test_contract_finds_every_defect(spark):
    t = {o.table: spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in o.properties.items()))
         for o in OBJECTS.values()}
    t["link_company_imports"] = spark.createDataFrame([("x", "c1")], "company_number string, cn8_code string")
    t["link_event_affects"] = spark.createDataFrame([], "event_id string, iso3 string")
    t["link_supplier_resolves_to"] = spark.createDataFrame(
        [("v1", "1"), ("v1", "2"), ("v2", None)], "vendor_id string, company_number string")
    t["commodity"] = spark.createDataFrame([("c1",), ("c1",), (None,)], "cn8_code string")
    got = {r["check"]: r for r in contract.validate(t).collect()}
    assert len(got) == 3 * len(OBJECTS) + 2 * len(LINKS) + sum(l.many_to_one for l in LINKS.values()) == 49
    bad = {k for k, v in got.items() if not v["passed"]}
    assert bad == {"Commodity: declared properties exist", "Commodity: primary key unique",
                   "Commodity: primary key not null", "link imports: from endpoints exist",
                   "link resolves_to: from endpoints exist", "link resolves_to: to endpoints exist",
                   "link resolves_to: many_to_one respected"}


def test_fragility_unknown_signals(spark):
    c = spark.createDataFrame(
        [("1", None, None, None), ("2", "Liquidation", dt.date(2020, 1, 1), 3)],
        "company_number string, status string, accounts_next_due date, mortgages_outstanding int").withColumns({
            "confstmt_next_due": F.lit(None).cast("date"), "incorporated_on": F.lit(None).cast("date"),
            "name": F.lit("n"), "category": F.lit("c"), "postcode": F.lit("p"), "sic_codes": F.array()})
    got = {r.company_number: r for r in build.fragility(c, F.lit("2021-01-01").cast("date")).collect()}
    assert got["1"].fragility_score == 0.0 and got["1"].fragility_reasons == []
    assert got["2"].fragility_score == 1.0 and len(got["2"].fragility_reasons) == 3


def test_alert_chain_and_reasons(spark):
    at = dt.datetime(2026, 1, 1)
    alerts = spark.createDataFrame([("A", "v", "e", "open", "o", "", at, at)],
                                   "alert_id string, vendor_id string, event_id string, status string, owner string, "
                                   "note string, created_at timestamp, updated_at timestamp")
    steps = [("A", "mitigating", "x"), ("A", "acknowledged", "x"), ("A", "acknowledged", "x"), ("A", "closed", " "),
             ("A", "mitigating", "y"), ("A", "closed", "done"), ("A", "open", "z"), ("B", "closed", "x")]
    req = spark.createDataFrame([(f"r{i}", "update_alert_status", a, s, n, "me", at + dt.timedelta(minutes=i))
                                 for i, (a, s, n) in enumerate(steps)],
                                "request_id string, action string, alert_id string, status string, note string, "
                                "actor string, requested_at timestamp")
    judged, after = actions.update_alert_status(req, alerts)
    got = {r.request_id: r for r in judged.collect()}
    assert [got[f"r{i}"].accepted for i in range(8)] == [False, True, False, False, True, True, False, False]
    assert got["r3"].reason.startswith("Closing") and got["r6"].reason.endswith("none (closed)")
    final = after.collect()[0]
    assert final.status == "closed" and final.note.count("\n") == 2


def test_raise_alert_duplicates(spark):
    at = dt.datetime(2026, 1, 1)
    req = spark.createDataFrame(
        [("r1", "v", "e", " ", at), ("r2", "v", "e", "o", at), ("r3", "v", "e", "o", at), ("r4", "x", "e", "o", at),
         ("r5", "v", "y", "o", at), ("r6", "w", "e", "o", at)],
        "request_id string, vendor_id string, event_id string, owner string, requested_at timestamp").withColumns({
            "action": F.lit("raise_alert"), "note": F.lit(None).cast("string"), "alert_id": F.lit(None).cast("string")})
    sup = spark.createDataFrame([("v",), ("w",)], "vendor_id string")
    ev = spark.createDataFrame([("e",)], "event_id string")
    alerts = spark.createDataFrame([("A", "w", "e", "closed"), ("B", "v", "e", "closed")],
                                   "alert_id string, vendor_id string, event_id string, status string")
    got = {r.request_id: r.accepted for r in actions.raise_alert(req, sup, ev, alerts).collect()}
    assert got == {"r1": False, "r2": True, "r3": False, "r4": False, "r5": False, "r6": True}


def _batch(spark, *rows):
    at = dt.datetime(2026, 1, 1)
    cols = ("request_id string, action string, vendor_id string, event_id string, alert_id string, status string, "
            "company_number string, criticality string, owner string, note string, actor string, requested_at timestamp")
    full = [(i, a, "v", "e", alert, to, None, None, owner, note, "me", at + dt.timedelta(minutes=m))
            for i, a, alert, to, owner, note, m in rows]
    one = spark.createDataFrame([("v",)], "vendor_id string")
    ev = spark.createDataFrame([("e",)], "event_id string")
    co = spark.createDataFrame([("1",)], "company_number string")
    old = spark.createDataFrame([("A", "v", "e", "open", "o", "", at, at)],
                                "alert_id string, vendor_id string, event_id string, status string, owner string, "
                                "note string, created_at timestamp, updated_at timestamp")
    judged, after = actions.judge_all(spark.createDataFrame(full, cols), one, ev, co, old)
    accepted = {r.request_id: r.accepted for k in ("raise_alert", "update_alert_status") for r in judged[k].collect()}
    return accepted, {r.alert_id: r.status for r in after.collect()}, judged


def _id(spark, request):
    return spark.range(1).select(actions.alert_id(F.lit(request))).first()[0]


def test_close_then_raise_in_one_batch(spark):
    new, newer = _id(spark, "r2"), _id(spark, "r6")
    accepted, after, judged = _batch(
        spark, ("r0", "raise_alert", None, None, "o", None, 1), ("r1", "update_alert_status", "A", "closed", None, "n", 2),
        ("r2", "raise_alert", None, None, " o\t", None, 3), ("r3", "raise_alert", None, None, "o", None, 4),
        ("r4", "update_alert_status", new, "acknowledged", None, "x", 2), ("r5", "update_alert_status", new, "closed",
                                                                           None, "y", 5),
        ("r6", "raise_alert", None, None, "o", None, 6), ("r7", "raise_alert", None, None, "\t\u00a0", None, 7),
        ("r8", "update_alert_status", newer, "acknowledged", None, None, 8))
    assert accepted == {"r0": False, "r1": True, "r2": True, "r3": False, "r4": False, "r5": True, "r6": True,
                        "r7": False, "r8": True}
    assert after == {"A": "closed", new: "closed", newer: "acknowledged"}
    reasons = {r.request_id: r.reason for r in judged["raise_alert"].collect()}
    assert "owner" in reasons["r7"] and reasons["r0"].endswith("(A))") is False and "(A)" in reasons["r0"]


def test_chain_length_follows_the_table():
    assert actions.longest_chain({"a": ("b", "d"), "b": ("c",), "c": ("d",), "d": ()}) == 3
    with pytest.raises(ValueError):
        actions.longest_chain({"a": ("b",), "b": ("a",)})


QUICK = ["norm_name", "po_line_id", "date_formats", "import_flow_share", "supplier_criticality", "resolves_to_override",
         "supplier_exposure", "action_alert_transitions", "alert_after_updates", "event_kpis", "er_best_match", "action_log"]


@pytest.mark.parametrize("name", QUICK)
def test_same_answer_in_sql(spark, name):
    import __spark_entry__ as e
    from oracle.compare import database, difference
    assert difference(e.queries()[name](spark, SF), database(SF), e.oracle_sql()[name])[1] == ""


def test_every_query_has_sql():
    import __spark_entry__ as e
    from oracle.sql import ORACLES
    assert set(ORACLES) == set(e.QUERIES)


def test_requests_without_values_are_rejected_with_a_reason(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    at = dt.datetime(2026, 1, 1)
    cols = ("action", "vendor_id", "event_id", "alert_id", "status", "company_number", "criticality", "owner", "note")
    rows = [(a, *[None] * 8, f"{a}{i}", "me", at) for a in actions.LOGGED for i in (0,)]
    rows += [(a, "v", *[None] * 7, f"{a}1", "me", at) for a in actions.LOGGED if a != "reject_match"]
    req = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)
                                + ", request_id string, actor string, requested_at timestamp")
    vendors = spark.createDataFrame([("v",)], "vendor_id string")
    alerts = empty("alert_id string, vendor_id string, event_id string, status string, owner string, note string, "
                   "created_at timestamp, updated_at timestamp")
    judged, after = actions.judge_all(req, vendors, empty("event_id string"), empty("company_number string"), alerts)
    got = {r.request_id: r for df in judged.values() for r in df.select("request_id", "accepted", "reason").collect()}
    assert len(got) == len(rows) and not any(r.accepted for r in got.values()) and all(r.reason for r in got.values())
    assert got["confirm_match1"].reason.endswith("not a registered company number") and after.count() == 0


def test_priority_covers_every_event(spark):
    """A footprint's suppliers come once for every event of it, not once for the footprint."""
    from types import SimpleNamespace

    import __spark_entry__ as entry
    suppliers = spark.createDataFrame([("f", 1.0, 7, 0.5), ("f", 1.0, 8, 0.2), ("g", 0.6, 7, 0.1)],
                                      "footprint string, severity double, vendor_id int, priority double")
    events = spark.createDataFrame([("a", "f", 1.0, True), ("b", "f", 1.0, False), ("c", "g", 0.6, False),
                                    ("d", "f", 0.6, True)], "event_id string, footprint string, severity double, is_current boolean")
    got = entry.priority(SimpleNamespace(suppliers=suppliers, events=events))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 7, 0.5), ("a", 8, 0.2), ("b", 7, 0.5), ("b", 8, 0.2),
                                                       ("c", 7, 0.1)]


def test_picture_of_a_kind_is_drawn_for_all_its_events(spark):
    from riskloom.operators import graph
    kinds = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "kind string, event_id string")
    lines = [(v, c, f"{c}-{i}" if v < 3 else None, i, c / 10, 1 / (i + c)) for v in (1, 3) for c in (1, 2, 3, 4)
             for i in (5, 6, 7, 8)]
    schema = "event_id string, vendor_id int, cn8_code int, flow_id string, iso3 int, contribution double, share double"
    of = {"a": [x for x in lines if x[0] == 1], "c": [x for x in lines if x[0] == 3]}
    whole = [(e, *x) for k, e in (("a", "a"), ("a", "b"), ("c", "c")) for x in of[k]]
    resolves = spark.createDataFrame([(1, "00000009", 0.95)], "vendor_id int, company_number string, confidence double")
    want = graph.path_subgraph(spark.createDataFrame(whole, schema), {}, resolves)
    once = spark.createDataFrame([x for x in whole if x[0] != "b"], schema)
    got = graph.path_subgraph(once, {}, resolves, events=kinds)
    rows = lambda df: sorted(tuple(r) for r in df.select("event_id", "vendor_id", "src", "dst", "link_type").collect())
    assert rows(got) == rows(want) and any(r[0] == "b" and r[2] == "RiskEvent:b" for r in rows(got))
    assert sorted(tuple(r) for r in graph.for_all(once, kinds).collect()) == sorted(
        tuple(r) for r in spark.createDataFrame(whole, schema).collect())


def test_a_hop_from_few_nodes_is_dealt_over_tasks(spark):
    """Two countries hold all suppliers: the hop makes a row for each event and supplier there."""
    there = spark.range(400).selectExpr("concat('e', id) as event", "concat('c', id % 2) as country").distinct()
    e = spark.range(5000).selectExpr("concat('s', id) as src", "concat('c', id % 2) as dst",
                                     "'located_in' as link_type").distinct()
    hop = graph.step(there, e, "located_in", "country", "supplier", forward=False)
    assert hop.columns == ["country", "event", "supplier"]
    per_task = [r["count"] for r in hop.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert sum(per_task) == 400 * 2500 and len(per_task) > 1
    assert hop.distinct().count() == 400 * 2500
    assert hop.join(there, ["event", "country"], "left_anti").isEmpty()


def test_tables_that_nobody_reads_are_not_planned(spark):
    """Matches are resolved for the tables that need them, and only when one of these is asked for."""
    parts = spark.createDataFrame([("c1", "steel", "72", "7201", "pig iron")],
                                  "cn8_code string, description string, hs2_code string, hs4_code string, "
                                  "hs4_description string")
    event = spark.createDataFrame([("e1", 1.0, True)], "event_id string, severity double, is_current boolean")
    hits = spark.createDataFrame([("e1", "TWN"), ("e1", "TWN")], "event_id string, iso3 string")
    asked = []

    def of(name, table=None):
        def plan():
            asked.append(name)
            assert table is not None, f"{name} was planned"
            return table
        return plan

    iso = spark.createDataFrame([("TWN",)], "iso3 string")
    t = build.Planned({
        "clean_commodity": of("clean_commodity", parts), "clean_risk_event": of("clean_risk_event", event),
        "clean_event_country": of("clean_event_country", hits), "clean_imports": of("clean_imports", iso),
        "clean_sanctions": of("clean_sanctions", spark.createDataFrame([("TWN", 2)], "iso3 string, designations int")),
        "clean_erp_supplier": of("clean_erp_supplier", iso.withColumnRenamed("iso3", "country_iso3")),
        "country_names": of("country_names", spark.createDataFrame([("TWN", "Taiwan")], "iso3 string, name string")),
        **{name: of(name) for name in ("trader_company", "supplier_company", "match_override", "clean_companies",
                                       "clean_trader_commodity", "clean_po_line", "criticality_override", "alert")}})
    out = build.build(t, F.current_date())
    assert asked == [] and "company" in out and "company" not in asked
    assert [tuple(r) for r in out["country"].select("iso3", "name", "country_risk").collect()] == [("TWN", "Taiwan", 1.0)]
    assert out["link_event_affects"].count() == 1 and out["commodity"].count() == 1
    with pytest.raises(AssertionError, match="trader_company was planned"):
        out["link_company_imports"]


def test_names_of_one_file_are_normalised_in_many_tasks(spark):
    few = spark.range(200).coalesce(1).selectExpr("id as c_custkey", "concat('Name ', id, ' Ltd') as name",
                                                  "'N 1' as postcode")
    named = standins._named(few, "c_custkey").withColumn("task", F.spark_partition_id())
    assert named.select("task").distinct().count() > 1
    assert named.select("c_custkey").distinct().count() == named.count() == 200


def test_suppliers_spend_is_summed_once(spark):
    s = spark.createDataFrame([("v1", "A", "1", "x", "N", None), ("v2", "B", "1", "x", "N", None)],
                              "vendor_id string, vendor_name string, postcode string, country string, "
                              "country_iso3 string, stated_company_number string")
    po = spark.createDataFrame([("v1", 2.0), ("v1", 3.5)], "vendor_id string, amount_gbp double")
    none = spark.createDataFrame([], "vendor_id string, criticality string")
    out = build.erp_supplier(s, po, none)
    assert any("supplier-spend" in f for f in out.inputFiles())
    assert {(r.vendor_id, r.spend_12m_gbp, r.criticality) for r in out.collect()} == {
        ("v1", 5.5, "high"), ("v2", 0.0, "low")}


def test_exposure_table_scores_only_what_it_is_asked_for(spark):
    """The same rows as from the scores of all events, and none of these are put at rest."""
    own = standins.Standins(spark, SF)
    got = own.exposure_table
    assert not {"scored", "suppliers"} & set(vars(own))
    keys = ["event_id", "vendor_id", "exposure_score", "priority"]
    want = views.exposure_table(own.ontology, own.suppliers, own.current).select(keys)
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, want.collect())) != []
