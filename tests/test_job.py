"""Raw files of every source through the whole job, actions on top, and a rebuild that keeps them."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from riskloom.plans import job
from riskloom.sources import companies, events, importers, layers, sanctions, trade
from riskloom.streaming import requests as stream


def company_line(name, number, postcode, sics, extra=()):
    cells = [""] * 26
    for i, v in {0: name, 1: number, 9: postcode, 10: "PLC", 11: "Active", 14: "01/02/2001", 17: "31/02/2020",
                 23: "2"}.items():
        cells[i] = v
    cells += list(sics) + list(extra) + ["/b/x"] + ["", "", "15/06/2020", ""]
    return ",".join('"' + c.replace('"', '""') + '"' if "," in c or '"' in c else c for c in cells)


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")

    def put(name, text, encoding="utf-8"):
        (d / name).write_bytes(text.encode(encoding))
        return str(d / name)

    lines = ["CompanyName, CompanyNumber" + ",h" * 40,
             company_line('Acme, "Best" Steel Ltd', "00000001", "M1 1AA", ["24100 - Steel", "None Supplied", "", ""]),
             company_line("Beta Wire Limited", "00000002", "M2 2BB",
                          [f"{i}{i}{i}{i}{i} - x" for i in range(1, 6)]),
             "too,short", company_line("Gamma Pumps Ltd", "00000003", "M3 3CC", ["None Supplied", "", "", ""])]
    imp = ["\t".join(["202607", "2", "CAF\xc9 Wire", "", "", "", "", "", "M2 2BB", "72000002", "11111111"]),
           "\t".join(["202607", "1", "CAF\xc9 Wire", "a", "", "b", "", "", "M2 2BB", "72000001"]),
           "\t".join(["202607", "1", "Beta Wire Ltd", "r", "", "", "", "", "M2 2BB", "72000001", "72000001"]),
           "head\tx", "1\t2\t3"]
    feats = [{"properties": p} for p in (
        {"eventtype": "EQ", "eventid": 1, "name": "", "description": "Quake", "alertlevel": "Red",
         "fromdate": "2026-01-02T00:00:00", "todate": "2026-01-03T00:00:00", "iscurrent": "True",
         "url": {"report": "/r"}, "iso3": "TWN", "affectedcountries": [{"iso3": "TWN"}, {"iso3": "CHN"}, {"iso3": ""}]},
        {"eventtype": "EQ", "eventid": 1, "name": "again", "alertlevel": "Green", "fromdate": "2026-01-02",
         "todate": "2026-01-02", "affectedcountries": []},
        {"eventtype": "FL", "eventid": 2, "name": "Flood", "alertlevel": "Odd", "fromdate": "2026-01-02",
         "todate": "2026-01-02", "iscurrent": "false", "iso3": "CHN", "affectedcountries": []})]
    sanc = ('﻿Report Date: 1-Jan-2026\nLast Updated,Unique ID,Regime Name,Name 1,Designation Type\n'
            'x,R1,The Russia (Sanctions) (EU Exit) Regulations 2019,"two\nlines",Person\n'
            'x,R1,The Russia (Sanctions) (EU Exit) Regulations 2019,alias,Person\n'
            'x,C1,The china (Sanctions) Regulations,n,Entity\nx,T1,The Cyber Regulations 2020,n,Person\n')
    return {
        "companies": put("companies.csv", "\n".join(lines) + "\n"),
        "importers": put("importers.tsv", "\r\n".join(imp) + "\r\n", "latin-1"),
        "commodity": put("commodity.json", json.dumps(
            [{"Cn8Code": c, "Cn8LongDescription": f"steel {c}", "Hs2Code": "72", "Hs4Code": "7200",
              "Hs4Description": "iron"} for c in ("72000001", "72000002", "7200")])),
        "country": put("country.json", json.dumps(
            [{"CountryId": i, "CountryCodeAlpha": a, "CountryName": f" {a} "} for i, a in
             enumerate(["CN", "TW", "XS", "QQ", None, "DU", "HA"])])),
        "iso": put("iso.csv", "alpha2,iso3,name,official_name,common_name\nCN,CHN,China,,\nTW,TWN,Taiwan,,\n"
                              "GB,GBR,United Kingdom,,\n"),
        "trade": put("trade.json", json.dumps({"start": 202508, "end": 202607, "rows": [
            {"CommodityId": 72000001, "CountryId": 0, "Value": 30.0}, {"CommodityId": 72000001, "CountryId": 1,
                                                                       "Value": 50.0},
            {"CommodityId": 72000001, "CountryId": 3, "Value": 20.0}, {"CommodityId": 72000002, "CountryId": 0,
                                                                       "Value": 0.0}]})),
        "events": put("events.json", json.dumps({"features": feats})),
        "sanctions": put("sanctions.csv", sanc),
        "vendors": put("vendors.csv", "VENDOR_ID,VENDOR_NAME,SEGMENT1,ADDRESS_LINE1,ZIP,COUNTRY,REGISTRATION_NUMBER,"
                                      "CREATION_DATE,ENABLED_FLAG\nV1,Acme Best Steel,S,,M1 1AA,GB,1,14-MAR-16,Y\n"
                                      "V2,TAIWAN CHIPS,S,,,TW,,01-JAN-20,Y\nV3,Gamma Pmps Ltd,S,,m33cc,GB,,01-JAN-20,Y\n"),
        "po_lines": put("po.csv", "PO_NUMBER,LINE_NUM,VENDOR_ID,CATEGORY_CODE,ITEM_DESCRIPTION,QUANTITY,UNIT_PRICE,"
                                  "CURRENCY_CODE,CREATION_DATE\nP1,1,V1,72000001,x,2,10,GBP,14-MAR-26\n"
                                  "P1,1,V1,72000001,x,2,10,GBP,14-MAR-26\nP2,1,V2,72000001,y,1,100,USD,14-MAR-26\n"
                                  "P3,1,V3,72000001,y,1,5,XXX,14-MAR-26\nP3,1,V3,99,z,1,5,EUR,14-MAR-26\n"),
    }


def test_readers(spark, raw):
    c = {r.company_number: r for r in companies.read(spark, raw["companies"]).collect()}
    assert len(c) == 3 and c["00000001"].name == 'Acme, "Best" Steel Ltd' and c["00000001"].sic_codes == ["24100"]
    assert c["00000002"].sic_codes == ["11111", "22222", "33333", "44444", "55555"]
    assert c["00000001"].accounts_next_due is None and c["00000003"].confstmt_next_due == dt.date(2020, 6, 15)
    lines = importers.split_lines(importers.read_lines(spark, raw["importers"]))
    t = {r.name: r for r in importers.traders(lines).collect()}
    assert t["CAF\xc9 Wire"].address == "a, b" and len(t) == 2
    assert importers.trader_commodity(lines).count() == 3
    iso = trade.read_iso(spark, raw["iso"])
    assert {r.hmrc_alpha: r.iso3 for r in trade.read_country(spark, raw["country"], iso).collect()} == {
        "CN": "CHN", "TW": "TWN", "XS": "SRB", "QQ": None, None: None, "DU": "ARE", "HA": "ARE"}
    f = events.read(spark, raw["events"])
    ev = {r.event_id: r for r in events.risk_event(f).collect()}
    assert ev["GDACS-EQ-1"].name == "Quake" and ev["GDACS-EQ-1"].is_current and ev["GDACS-FL-2"].severity == 0.0
    assert {tuple(r) for r in events.event_country(f).collect()} == {
        ("GDACS-EQ-1", "TWN"), ("GDACS-EQ-1", "CHN"), ("GDACS-FL-2", "CHN")}
    s = sanctions.by_country(sanctions.with_iso3(sanctions.read(spark, raw["sanctions"]), iso)).collect()
    assert {r.iso3: r.designations for r in s} == {"RUS": 1, "CHN": 1}


def test_company_with_quoted_line_breaks(spark, tmp_path):
    """Breaks in the first, a middle and a late field; files past the parser's buffer; both line ends."""
    sics = ["24100 - Steel", "None Supplied", "", ""]
    for end in ("\n", "\r\n"):
        odd = [company_line('Delta\n"Tubes" Ltd', "00000004", "M4 4DD", sics),
               company_line("Eta Rods Ltd", "00000005", '"M5\n5EE"', sics).replace('"""', '"'), company_line(
                   "Theta Ltd", "00000006", "M6 6FF", sics, ["two\nlines, late"])]
        many = [company_line(f"Plain {i} Ltd", f"{i:08d}", "M1 1AA", sics) for i in range(100, 15_100)]
        folder = tmp_path / str(len(end))
        folder.mkdir()
        lines = ["CompanyName, CompanyNumber" + ",h" * 40, *many[:9_000], *odd, *many[9_000:], "too,short"]
        (folder / "a.csv").write_bytes((end.join(lines) + end).encode())
        (folder / "b.csv").write_bytes((company_line("Iota,\nLtd", "00000007", "M7 7GG", sics)).encode())
        c = {r.company_number: r for r in companies.read(spark, str(folder)).collect()}
        assert len(c) == 15_004 and c["00000004"].name == 'Delta\n"Tubes" Ltd' and c["00000007"].name == "Iota,\nLtd"
        assert all(r.sic_codes == ["24100"] and r.confstmt_next_due == dt.date(2020, 6, 15) for r in c.values())
        assert all(c[f"{i:08d}"].name == f"Plain {i} Ltd" for i in range(100, 15_100))
        assert (c["00000005"].postcode_norm, c["00000006"].postcode_norm) == ("M55EE", "M66FF")
        assert companies.open_quotes(companies.read_lines(spark, str(folder))).first().value == 0


def test_rollup_window(spark):
    m = spark.createDataFrame([(72000001, 1, mon, flow, 1.0) for mon in (202412, 202501, 202512) for flow in (1, 2, 3)]
                              + [(11000000, 1, 202512, 1, 9.0)],
                              "commodity_id long, country_id int, month_id int, flow_type_id int, value double")
    assert [tuple(r) for r in trade.trailing12(m).collect()] == [(72000001, 1, 4.0, 202501, 202512)]
    assert [r.period_start for r in trade.trailing12(m, end=202511).collect()] == [202412]


def test_whole_job_actions_and_rebuild(spark, raw, tmp_path):
    wh, as_of = str(tmp_path / "wh"), F.lit("2026-08-01").cast("date")
    t = job.run(spark, raw, wh, as_of)
    assert t["validation"].count() == 49
    match = {r.vendor_id: (r.company_number, r.match_method) for r in t["link_supplier_resolves_to"].collect()}
    assert match == {"V1": ("00000001", "registration_number"), "V3": ("00000003", "postcode_name")}
    flows = {r.iso3: r.share_of_uk_imports for r in t["import_flow"].collect()}
    assert flows == {"CHN": 0.3, "TWN": 0.5}
    assert sorted(r.po_line_id for r in t["po_line"].collect()) == ["P1-1", "P1-2", "P2-1", "P3-1"]

    rows = [("q1", "raise_alert", "V1", "GDACS-EQ-1", None, None, None, None, "me", "n"),
            ("q2", "confirm_match", "V2", None, None, None, "2", None, None, None),
            ("q3", "reject_match", "V3", None, None, None, None, None, None, None),
            ("q4", "set_criticality", "V3", None, None, None, None, "high", None, None),
            ("q5", "set_criticality", "V3", None, None, None, None, "urgent", None, None)]
    folder = tmp_path / "requests"
    folder.mkdir()
    names = [c.split()[0] for c in stream.SCHEMA.split(", ")]
    text = "\n".join(json.dumps(dict(zip(names, (*r, "me", f"2026-08-01T00:00:0{i}")))) for i, r in enumerate(rows))
    (folder / "a.json").write_text(text + "\n" + text.splitlines()[0])  # the first one twice
    seen = []

    def handle(batch, name):
        judged, rebuilt = job.act(spark, batch, t, wh, as_of, name)
        seen.append((sum(d.count() for d in judged.values()), rebuilt["erp_supplier"].count()))

    stream.start(stream.read(spark, str(folder)), handle, str(tmp_path / "ckpt")).awaitTermination(120)
    assert seen[0] == (5, 3)
    log = layers.read(spark, wh, "writeback", "action_log")
    done = [("q1", "raise_alert"), ("q2", "confirm_match"), ("q3", "reject_match"), ("q4", "set_criticality")]
    assert sorted((r.request_id, r.action) for r in log.collect()) == done
    # The same requests again, two hours old, in a later file and by hand: judged once and for all.
    (folder / "b.json").write_text(text)
    stream.start(stream.read(spark, str(folder)), handle, str(tmp_path / "ckpt")).awaitTermination(120)
    job.act(spark, spark.read.schema(stream.SCHEMA).json(str(folder)), t, wh, as_of)
    log = layers.read(spark, wh, "writeback", "action_log", job.LOG)
    assert sorted((r.request_id, r.action) for r in log.collect()) == done
    again = job.run(spark, raw, wh, as_of)  # decisions survive the rebuild
    match = {r.vendor_id: (r.company_number, r.confidence) for r in again["link_supplier_resolves_to"].collect()}
    assert match == {"V1": ("00000001", 0.99), "V2": ("00000002", 1.0)}
    assert {r.vendor_id: r.criticality for r in again["erp_supplier"].collect()}["V3"] == "high"
    assert [r.status for r in again["alert"].collect()] == ["open"]


def test_a_retry_after_any_append_adds_nothing(spark, tmp_path, monkeypatch):
    as_of, known = F.lit("2026-08-01").cast("date"), "vendor_id string"
    t = {"erp_supplier": spark.createDataFrame([("V1",)], known), "risk_event": spark.createDataFrame(
        [("E",)], "event_id string"), "clean_companies": spark.createDataFrame([("00000001",)], "company_number string")}
    rows = [("q1", "raise_alert", "V1", "E", None, None, None, None, "me", None, "me", dt.datetime(2026, 8, 1)),
            ("q2", "reject_match", "V1", None, None, None, None, None, None, None, "me", dt.datetime(2026, 8, 1))]
    requests = spark.createDataFrame(rows, stream.SCHEMA)
    monkeypatch.setattr(job.build, "apply_edits", lambda *_: {})
    real = layers.put
    for broken in range(4):
        wh, calls = str(tmp_path / f"wh{broken}"), iter(range(100))

        def put(*args, calls=calls, broken=broken):
            if next(calls) == broken:
                raise OSError("lost")
            real(*args)

        monkeypatch.setattr(layers, "put", put)
        with pytest.raises(OSError):
            job.act(spark, requests, t, wh, as_of, "7")
        monkeypatch.setattr(layers, "put", real)
        for _ in range(2):
            judged, _ = job.act(spark, requests, t, wh, as_of, "7")
        log = layers.read(spark, wh, "writeback", "action_log", job.LOG)
        assert sorted(r.request_id for r in log.collect()) == ["q1", "q2"]
        assert layers.read(spark, wh, "writeback", "alert", job.ALERT).count() == 1
        assert layers.read(spark, wh, "writeback", "match_override", job.MATCH).count() == 1
        assert judged["raise_alert"].filter("accepted").count() == 1


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    wh = str(tmp_path)
    layers.write(spark.range(3), wh, "clean", "t")
    with pytest.raises(Exception):
        layers.write(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), wh, "clean", "t")
    assert layers.read(spark, wh, "clean", "t").count() == 3
    layers.write(spark.range(5), wh, "clean", "t")
    assert layers.read(spark, wh, "clean", "t").count() == 5


def test_json_lines_and_wide_sanctions(spark, raw, tmp_path):
    doc = json.loads(open(raw["events"]).read())
    (tmp_path / "pages").mkdir()
    for i, f in enumerate(doc["features"]):
        (tmp_path / "pages" / f"{i}.json").write_text(json.dumps(f) + "\n")
    a = {tuple(r) for r in events.event_country(events.read(spark, raw["events"])).collect()}
    assert a == {tuple(r) for r in events.event_country(events.read(spark, str(tmp_path / "pages"), True)).collect()}
    t = json.loads(open(raw["trade"]).read())
    (tmp_path / "t.json").write_text("\n".join(json.dumps({"start": t["start"], "end": t["end"], **r}) for r in t["rows"]))
    want = sorted(map(tuple, trade.read_trade(spark, raw["trade"]).collect()))
    assert sorted(map(tuple, trade.read_trade(spark, str(tmp_path / "t.json"), True).collect())) == want
    wide = ",".join(f"n{i}" for i in range(150))
    (tmp_path / "s.csv").write_text(f"Report Date: x\n{wide},Unique ID,Regime Name,Designation Type\n"
                                    + "," * 150 + "U1,The Russia (Sanctions) Regulations,Person\n")
    assert [tuple(r) for r in sanctions.read(spark, str(tmp_path / "s.csv")).collect()] == [
        ("U1", "The Russia (Sanctions) Regulations", "Person")]
