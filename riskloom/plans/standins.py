"""The given star-schema tables read as the domain's tables (README lists the mapping).

Every table is a lazy DataFrame over whole inputs; keys stay numeric where the inputs have numbers.
"""
from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions import normalize as nz
from riskloom.operators import actions, exposure, matching
from riskloom.operators.spread import at_rest
from riskloom.plans import build, views
from riskloom.sources import erp, trade

# Fixed values of the stand-in: brands in scope, the nation whose trade is not mapped, the date of the run.
SCOPE = tuple(f"Brand#{i}" for i in range(1, 21))
UNMAPPED = 24
AS_OF = "2001-08-01"
HOME_REGION = 0


def band(value: Column, *steps: tuple[float, str], low: str | None) -> Column:
    """Label of the highest step reached."""
    out = F.lit(low)
    for at, label in sorted(steps):
        out = F.when(value >= at, F.lit(label)).otherwise(out)
    return out


def hour_of(ts: str) -> Column:
    """The hour that names an event."""
    return F.date_format(ts, "yyyy-MM-dd-HH")


def alert_level(value: Column) -> Column:
    return band(value, (200, "Red"), (100, "Orange"), low="Green")


def name_letters(key: Column) -> Column:
    """Ten letters that a number stands for; neighbouring numbers have nothing in common."""
    return F.substring(F.translate(F.md5(key.cast("string").cast("binary")), "0123456789abcdef", "ABCDEFGHIJKLMNOP"),
                       1, 10)


def _named(df: DataFrame, *columns) -> DataFrame:
    """The name and postcode columns that matching needs. The file is small and the names cost much: customers are dealt
    over all tasks first."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    named = df.repartition(tasks, "c_custkey").withColumn("name_norm", nz.norm_name(F.col("name")))
    return named.select(*columns, "name", "name_norm", nz.core_of(F.col("name_norm")).alias("name_core"),
                        nz.norm_postcode(F.col("postcode")).alias("postcode_norm"))


class AtRest(Mapping):
    """Tables by name, each written to the shared folder when it is first asked for."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables, self.kept = tables, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = at_rest(self.tables[name], name)
        return self.kept[name]

    def __contains__(self, name: object) -> bool:
        return name in self.tables

    def __iter__(self):
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


_BUILT: dict[tuple[str, str], Standins] = {}


def of(spark: SparkSession, sf_dir: str) -> Standins:
    """The domain's tables over a folder; what is put at rest is built once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = Standins(spark, sf_dir)
    return _BUILT[key]


class Standins:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def as_of(self) -> Column:
        return F.lit(AS_OF).cast("date")

    # ---- events ----------------------------------------------------------------------------------------------

    @cached_property
    def readings(self) -> DataFrame:
        """Event readings with the hour they belong to and the nation they hit."""
        ev = self.given("events").select(
            "user_id", "value", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
            F.concat_ws("-", "event_type", hour_of("ts")).alias("event_id"))
        who = self.given("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("iso3"))
        return ev.join(who, "user_id")

    @cached_property
    def risk_event(self) -> DataFrame:
        last = self.given("events").agg(F.to_date(F.max("ts")).alias("d")).scalar()
        level = alert_level(F.col("worst"))
        day = F.to_date("hour")
        return (self.readings.groupBy("event_id", "event_type", "hour").agg(F.max("value").alias("worst"))
                .select("event_id", F.lit("readings").alias("source"), "event_type",
                        F.concat(F.col("event_type"), F.lit(" at "), F.date_format("hour", "yyyy-MM-dd HH"))
                        .alias("name"), level.alias("alert_level"), nz.severity(level).alias("severity"),
                        day.alias("start_date"), day.alias("end_date"),
                        (day >= F.date_sub(last, 2)).alias("is_current"),
                        F.lit(None).cast("string").alias("url")))

    @cached_property
    def event_country(self) -> DataFrame:
        return self.readings.select("event_id", "iso3").distinct()

    @cached_property
    def features(self) -> DataFrame:
        """Events in the shape of GeoJSON properties; the id comes out of the JSON column."""
        e, v = self.given("events"), F.col("value")
        who = self.given("customer").select(F.col("c_custkey").alias("user_id"),
                                            F.col("c_nationkey").cast("string").alias("nation"))
        country = F.struct(F.col("nation").alias("iso3"))
        none = F.lit(None).cast("array<struct<iso3:string>>")
        return e.join(who, "user_id").select(
            F.col("event_id").alias("position"), F.col("event_type").alias("eventtype"),
            F.from_json("props", "k int")["k"].cast("string").alias("eventid"),
            F.when(v < 20, F.lit("")).otherwise(F.concat(F.lit("reading "), F.col("event_id"))).alias("name"),
            F.concat(F.lit("unnamed "), F.col("event_id")).alias("description"),
            band(v, (100, "Red"), (50, "Orange"), (10, "Green"), low="White").alias("alertlevel"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("fromdate"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("todate"),
            band(v, (50, "True"), (10, "false"), low=None).alias("iscurrent"),
            F.struct(F.concat(F.lit("/report/"), F.col("event_id")).alias("report")).alias("url"),
            F.when(v >= 5, F.col("nation")).alias("iso3"),
            F.when(v >= 30, F.array(country)).when(v >= 3, F.array().cast("array<struct<iso3:string>>"))
            .otherwise(none).alias("affectedcountries"))

    # ---- sanctions -------------------------------------------------------------------------------------------

    @cached_property
    def sanction_rows(self) -> DataFrame:
        return self.given("customer").filter("c_acctbal < 0").select(
            F.col("c_custkey").alias("unique_id"), F.col("c_mktsegment").alias("regime"),
            F.col("c_nationkey").alias("iso3"))

    @cached_property
    def sanctions(self) -> DataFrame:
        from riskloom.sources import sanctions
        return sanctions.by_country(self.sanction_rows)

    # ---- commodities and trade -------------------------------------------------------------------------------

    @cached_property
    def commodity(self) -> DataFrame:
        return self.given("part").filter(F.col("p_brand").isin(list(SCOPE))).select(
            F.col("p_partkey").alias("cn8_code"), F.col("p_name").alias("description"),
            F.col("p_brand").alias("hs2_code"), F.col("p_type").alias("hs4_code"),
            F.concat(F.col("p_type"), F.lit(" goods")).alias("hs4_description"))

    @cached_property
    def monthly(self) -> DataFrame:
        """One row per traded line: month, flow type by order status, nation of the buyer."""
        o = self.given("orders").select(
            F.col("o_orderkey").alias("k"), "o_custkey",
            (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("month_id"),
            nz.lookup(F.col("o_orderstatus"), {"O": 1, "P": 2, "F": 3}).alias("flow_type_id"))
        c = self.given("customer").select(F.col("c_custkey").alias("o_custkey"),
                                          F.nullif(F.col("c_nationkey"), F.lit(UNMAPPED)).alias("country_id"))
        l = self.given("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("commodity_id"),
                                          (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
        return l.join(o.join(c, "o_custkey"), "k")

    @cached_property
    def last_month(self) -> Column:
        return self.given("orders").agg(F.max(F.year("o_orderdate") * 100 + F.month("o_orderdate"))
                                        .alias("m")).scalar()

    @cached_property
    def imports(self) -> DataFrame:
        t = trade.trailing12(self.monthly, end=self.last_month, chapters=None)
        return t.withColumnsRenamed({"commodity_id": "cn8_code", "country_id": "iso3"})

    @cached_property
    def import_flow(self) -> DataFrame:
        return build.import_flow(self.imports, self.commodity)

    # ---- vendors and purchases -------------------------------------------------------------------------------

    @cached_property
    def raw_vendors(self) -> DataFrame:
        """Vendor master as a buying system writes it. Vendor i is company 7 i + 3 and shows it in one of four ways: by
        number and a misspelt name, by postcode and a misspelt name, by the exact name, or by neither. One in ten is
        nobody and states another's number."""
        i = F.col("s_suppkey")
        true = self.registered.select(F.col("c_custkey").alias("j"), "segment", F.col("postcode").alias("zip"))
        n = self.given("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        way, stray, letters = i % 4, i % 10 == 9, name_letters(i * 7 + 3)
        after = lambda word, end: F.concat(word, F.lit(" "), F.coalesce("segment", F.lit("none")), F.lit(end))
        without = lambda k: F.concat(F.substring(letters, 1, k - 1), F.substring(letters, k + 1, 10))
        return (self.given("supplier").withColumn("j", i * 7 + 3).join(true, "j", "left").join(n, "s_nationkey", "left")
                .select(i.alias("VENDOR_ID"), F.when(stray, F.concat(F.lit("Stray "), name_letters(i + 1_000_000),
                                                                      F.lit(" GmbH")))
                        .when(way == 0, F.concat(F.lit("The "), after(without(5), " Limited")))
                        .when(way == 1, after(without(8), " Ltd")).when(way == 2, after(letters, " ltd"))
                        .otherwise(after(F.reverse(letters), " Ltd")).alias("VENDOR_NAME"),
                        F.when(way.isin(1, 3), F.lower("zip")).when(way == 0, F.col("n_name")).alias("ZIP"),
                        F.col("n_name").alias("COUNTRY"),
                        F.when(stray, (F.col("j") + 1).cast("string")).when(way == 0, F.col("j").cast("string"))
                        .otherwise("").alias("REGISTRATION_NUMBER"), F.lit("01-JAN-20").alias("CREATION_DATE")))

    @cached_property
    def clean_vendors(self) -> DataFrame:
        s = self.given("supplier").select(F.col("s_suppkey").alias("vendor_id"), "s_nationkey", "s_acctbal")
        n = self.given("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        return erp.clean_vendors(self.raw_vendors).join(s.join(n, "s_nationkey", "left"), "vendor_id").select(
            "vendor_id", "vendor_name", "name_norm", "name_core", "postcode", "postcode_norm", "country",
            F.col("s_nationkey").alias("country_iso3"), "stated_company_number",
            F.coalesce(F.col("n_regionkey") == HOME_REGION, F.lit(False)).alias("is_home"), "s_acctbal")

    @cached_property
    def vendor_home(self) -> DataFrame:
        return self.clean_vendors.select("vendor_id", "country_iso3", "is_home")

    @cached_property
    def raw_po_lines(self) -> DataFrame:
        """Purchase lines as a buying system writes them, all text."""
        currency = F.when(F.col("l_returnflag") == "N", "GBP").when(F.col("l_returnflag") == "A", "EUR").when(
            F.col("l_linestatus") == "F", "USD").otherwise("JPY")
        as_text = lambda c: F.col(c).cast("string")
        return self.given("lineitem").select(
            as_text("l_orderkey").alias("PO_NUMBER"), as_text("l_linenumber").alias("LINE_NUM"),
            as_text("l_suppkey").alias("VENDOR_ID"), as_text("l_partkey").alias("CATEGORY_CODE"),
            F.concat(F.lit("part "), "l_partkey").alias("ITEM_DESCRIPTION"),
            F.col("l_quantity").cast("double").cast("string").alias("QUANTITY"),
            F.col("l_extendedprice").cast("double").cast("string").alias("UNIT_PRICE"),
            currency.alias("CURRENCY_CODE"), F.upper(F.date_format("l_shipdate", "dd-MMM-yy")).alias("CREATION_DATE"))

    @cached_property
    def purchases(self) -> DataFrame:
        """Purchase lines without their ids: enough for every sum."""
        currency = F.when(F.col("l_returnflag") == "N", "GBP").when(F.col("l_returnflag") == "A", "EUR").when(
            F.col("l_linestatus") == "F", "USD").otherwise("JPY")
        l = self.given("lineitem").withColumn("currency", currency)
        return l.select(
            F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("cn8_code"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount")) * nz.fx_rate(F.col("currency")))
            .alias("amount_gbp"), F.col("currency").alias("original_currency"))

    @cached_property
    def po(self) -> DataFrame:
        """Purchases of known commodities."""
        return build.known(self.purchases, self.commodity)

    @cached_property
    def clean_po_line(self) -> DataFrame:
        lines = erp.number_lines(self.given("lineitem"), "l_orderkey", ["l_suppkey", "l_partkey"])
        currency = F.when(F.col("l_returnflag") == "N", "GBP").when(F.col("l_returnflag") == "A", "EUR").when(
            F.col("l_linestatus") == "F", "USD").otherwise("JPY")
        return lines.withColumn("currency", currency).select(
            "po_line_id", F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("cn8_code"),
            F.concat(F.lit("part "), F.col("l_partkey")).alias("item_description"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount")) * nz.fx_rate(F.col("currency")))
            .alias("amount_gbp"), F.col("currency").alias("original_currency"),
            F.to_date("l_shipdate").alias("order_date"))

    @cached_property
    def country_names(self) -> DataFrame:
        """Names of all nations but the unmapped one, which falls back to its code."""
        return self.given("nation").filter(F.col("n_nationkey") != UNMAPPED).select(
            F.col("n_nationkey").alias("iso3"), F.col("n_name").alias("name"))

    # ---- companies -------------------------------------------------------------------------------------------

    @cached_property
    def registered(self) -> DataFrame:
        """Customers as the company register knows them: ten letters and the segment as name, nation and a number as
        postcode."""
        n = self.given("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        k, segment = F.col("c_custkey"), F.lower("c_mktsegment")
        status = F.when(segment == "building", "Liquidation").when(segment != "furniture", "Active")
        return self.given("customer").join(n, "c_nationkey", "left").select(
            "c_custkey", F.lpad(k.cast("string"), 8, "0").alias("company_number"), segment.alias("segment"),
            F.concat(name_letters(k), F.lit(" "), segment, F.lit(" ltd")).alias("name"),
            F.concat_ws(" ", F.col("n_name"), (k % 97).cast("string")).alias("postcode"), status.alias("status"))

    @cached_property
    def company_register(self) -> DataFrame:
        """What records are matched against; at rest, as normalising the names costs more than matching them."""
        return at_rest(_named(self.registered, "company_number", "status"), "register")

    @cached_property
    def companies(self) -> DataFrame:
        o = self.given("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
        seg = F.upper("segment")
        return (self.registered.join(o, "c_custkey", "left").select(
            "company_number", "name", "status", seg.alias("category"), "postcode",
            F.date_add("first", 1461).alias("incorporated_on"), F.date_add("last", 60).alias("accounts_next_due"),
            F.date_add("last", 30).alias("confstmt_next_due"), F.array(seg).alias("sic_codes"),
            F.col("urgent").cast("int").alias("mortgages_outstanding")))

    @cached_property
    def trader_commodity(self) -> DataFrame:
        """(customer, part) it ordered."""
        o = self.given("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("trader_id"))
        l = self.given("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("cn8_code"))
        return l.join(o, "k").select("trader_id", "cn8_code").distinct()

    @cached_property
    def trader_company(self) -> DataFrame:
        """Importers matched to companies: every second one writes its name with a letter missing."""
        k = F.col("c_custkey")
        letters = name_letters(k)
        short = F.concat(F.substring(letters, 1, 7), F.substring(letters, 9, 2), F.lit(" "), F.col("segment"),
                         F.lit(" ltd"))
        own = self.registered.withColumn("name", F.when(k % 2 == 0, F.col("name")).otherwise(short)).withColumn(
            "stated_company_number", F.lit(None).cast("string"))
        records = at_rest(_named(own, F.col("c_custkey").alias("rec_id"), "stated_company_number"), "trader-names")
        return at_rest(matching.resolve(records, self.company_register), "trader-company")

    @cached_property
    def supplier_company(self) -> DataFrame:
        """Vendors matched to companies by the resolver."""
        # At rest, as the names are normalised once for the three ways to match.
        records = at_rest(self.clean_vendors.select(F.col("vendor_id").alias("rec_id"), "name_norm", "name_core",
                                                    "postcode_norm", "stated_company_number"), "vendor-names")
        return at_rest(matching.resolve(records, self.company_register), "supplier-company")

    # ---- actions ---------------------------------------------------------------------------------------------

    @cached_property
    def requests(self) -> DataFrame:
        e, v = self.given("events"), F.col("value")
        k = F.from_json("props", "k int")["k"].cast("string")
        day = F.date_format("ts", "yyyy-MM-dd")
        return e.select(
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"),
            nz.lookup(F.col("event_type"), {"click": "raise_alert", "view": "update_alert_status",
                                            "purchase": "confirm_match", "signup": "reject_match",
                                            "error": "set_criticality"}).alias("action"),
            F.col("user_id").alias("vendor_id"),
            F.concat(F.when(v < 5, "none-").otherwise("click-"), hour_of("ts")).alias("event_id"),
            F.concat_ws("-", F.lit("ALT"), "user_id", day).alias("alert_id"),
            band(v, (25, "closed"), (10, "mitigating"), low="acknowledged").alias("status"), k.alias("company_number"),
            band(v, (60, "urgent"), (25, "high"), (10, "medium"), low="low").alias("criticality"),
            F.when(v >= 8, F.concat(F.lit(" owner "), k)).otherwise(F.lit(" ")).alias("owner"),
            F.when(v < 60, F.concat(F.lit("note "), k)).alias("note"),
            F.concat(F.lit("user "), F.col("user_id")).alias("actor"),
            F.date_trunc("second", "ts").cast("timestamp_ntz").alias("requested_at"))

    @cached_property
    def alert(self) -> DataFrame:
        """Alerts on file: one per signing-up user and day."""
        e = self.given("events").filter("event_type = 'signup'")
        day = F.date_format("ts", "yyyy-MM-dd")
        at = F.date_trunc("second", "ts").cast("timestamp_ntz")
        return (e.groupBy("user_id", day.alias("day"))
                .agg(F.max("value").alias("v"), F.min(at).alias("created_at"), F.max(at).alias("updated_at"))
                .select(F.concat_ws("-", F.lit("ALT"), "user_id", "day").alias("alert_id"),
                        F.col("user_id").alias("vendor_id"), F.concat(F.lit("click-"), hour_of("created_at")).alias("event_id"),
                        band(F.col("v"), (100, "closed"), (70, "mitigating"), (40, "acknowledged"), low="open")
                        .alias("status"), F.lit("desk").alias("owner"),
                        F.when(F.col("v") < 20, F.lit("")).otherwise("seen").alias("note"), "created_at",
                        "updated_at"))

    @cached_property
    def confirmed(self) -> DataFrame:
        return actions.confirm_match(self.requests, self.clean_vendors, self.companies)

    @cached_property
    def rejected(self) -> DataFrame:
        return actions.reject_match(self.requests, self.clean_vendors)

    @cached_property
    def criticality_judged(self) -> DataFrame:
        return actions.set_criticality(self.requests, self.clean_vendors)

    @cached_property
    def match_override(self) -> DataFrame:
        return actions.match_overrides(self.confirmed, self.rejected)

    @cached_property
    def criticality_override(self) -> DataFrame:
        return actions.criticality_overrides(self.criticality_judged)

    @cached_property
    def first_day(self) -> Mapping[str, DataFrame]:
        """Suppliers, matches and companies as they stood after the first day's decisions, with the trade of one
        chapter: most suppliers are undecided, so the machine's match and the spend's rank stand, and companies without
        trade in the chapter are out of scope."""
        end = self.requests.agg(F.date_add(F.min("requested_at").cast("date"), 1).cast("timestamp_ntz")).scalar()
        until = lambda df: df.filter(F.col("requested_at") < end)
        chapter = self.commodity.filter("hs2_code = 'Brand#7'")
        return AtRest(build.apply_edits(build.Planned({
            "supplier_company": lambda: self.supplier_company, "po_line": lambda: self.po,
            "clean_companies": lambda: self.companies,
            "match_override": lambda: actions.match_overrides(until(self.confirmed), until(self.rejected)),
            "criticality_override": lambda: actions.criticality_overrides(until(self.criticality_judged)),
            "clean_erp_supplier": lambda: self.clean_vendors,
            "link_company_imports": lambda: build.company_imports(self.trader_company, self.trader_commodity, chapter),
        }), self.as_of))

    # ---- ontology --------------------------------------------------------------------------------------------

    @cached_property
    def imports_link(self) -> DataFrame:
        return build.company_imports(self.trader_company, self.trader_commodity, self.commodity)

    def _built(self, clean_po_line: DataFrame) -> Mapping[str, DataFrame]:
        t = build.Planned({
            "clean_commodity": lambda: self.commodity, "clean_po_line": lambda: clean_po_line,
            "trader_company": lambda: self.trader_company, "clean_trader_commodity": lambda: self.trader_commodity,
            "clean_erp_supplier": lambda: self.clean_vendors, "clean_companies": lambda: self.companies,
            "supplier_company": lambda: self.supplier_company, "match_override": lambda: self.match_override,
            "criticality_override": lambda: self.criticality_override, "clean_risk_event": lambda: self.risk_event,
            "clean_event_country": lambda: self.event_country, "clean_imports": lambda: self.imports,
            "clean_sanctions": lambda: self.sanctions, "country_names": lambda: self.country_names,
            "alert": lambda: self.alert,
        })
        return ChainMap(build.build(t, self.as_of, purchases=lambda: self.po), t)

    @cached_property
    def ontology(self) -> Mapping[str, DataFrame]:
        """Every ontology table, at rest once it is read. Reading one does not compute the others."""
        return AtRest(self._built(self.clean_po_line))

    @cached_property
    def weights(self) -> DataFrame:
        return at_rest(exposure.spend_weights(self.po, self.vendor_home), "weights")

    @cached_property
    def _footprints(self) -> tuple[DataFrame, DataFrame]:
        events, countries = exposure.footprints(self.event_country)
        severity = self.risk_event.select("event_id", "severity", "is_current")
        return at_rest(events.join(severity, "event_id"), "events"), at_rest(countries, "footprints")

    @property
    def events(self) -> DataFrame:
        """(event_id, footprint, severity, is_current) of every event."""
        return self._footprints[0]

    @cached_property
    def kinds(self) -> DataFrame:
        """(kind, event_id): the first event of the same footprint and severity stands for every event."""
        one = self.events.groupBy("footprint", "severity").agg(F.min("event_id").alias("kind"))
        return at_rest(self.events.join(one, ["footprint", "severity"]).select("kind", "event_id"), "kinds")

    @property
    def current(self) -> DataFrame:
        """The events that the per-event views are asked for."""
        return self.events.filter("is_current")

    @property
    def countries(self) -> DataFrame:
        return self._footprints[1]

    @cached_property
    def flow_at_rest(self) -> DataFrame:
        return at_rest(self.import_flow, "flows")

    @cached_property
    def scored(self) -> DataFrame:
        """Exposure per footprint, severity and supplier."""
        return at_rest(exposure.supplier_exposure(self.weights, self.flow_at_rest, self.events, self.countries), "scored")

    @cached_property
    def suppliers(self) -> DataFrame:
        """The same with the suppliers' facts."""
        return at_rest(views.scored_suppliers(self.ontology, self.scored), "suppliers")

    @property
    def exposure_table(self) -> DataFrame:
        """Scored for the kinds of the events that it is asked for; nothing of the other events is made."""
        asked = self.current
        hit = self.countries.join(asked.select("footprint").distinct(), "footprint", "left_semi")
        scored = exposure.supplier_exposure(self.weights, self.flow_at_rest, asked, hit)
        return views.exposure_table(self.ontology, views.scored_suppliers(self.ontology, scored), asked)

    # ---- names for entity resolution -------------------------------------------------------------------------

    @cached_property
    def records(self) -> DataFrame:
        """Every line of every document as a record: its text is the name, the language the postcode."""
        lines = self.given("documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias(
            "line", "name"))
        named = lines.withColumn("name_norm", nz.norm_name(F.col("name")))
        return named.select(
            F.concat_ws("-", "doc_id", "line").alias("rec_id"), "name_norm",
            nz.core_of(F.col("name_norm")).alias("name_core"), nz.norm_postcode(F.col("lang")).alias("postcode_norm"),
            nz.regno(F.col("doc_id").cast("string")).alias("stated_company_number"))

    @cached_property
    def kept_records(self) -> DataFrame:
        """The records at rest, for what reads them several times: normalising every line costs more than matching."""
        return at_rest(self.records, "records")

    @cached_property
    def kept_registry(self) -> DataFrame:
        return at_rest(self.registry, "registry")

    @cached_property
    def registry(self) -> DataFrame:
        """Every web page as a company: its title is the name, its language the postcode."""
        pages = self.given("pages").select(
            "page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("name"),
            F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))
        named = pages.withColumn("name_norm", nz.norm_name(F.col("name")))
        return named.select(
            nz.regno(F.col("page_id").cast("string")).alias("company_number"), "name", "name_norm",
            nz.core_of(F.col("name_norm")).alias("name_core"), nz.norm_postcode(F.col("lang")).alias("postcode_norm"),
            F.when(F.startswith("url", F.lit("https")), "Active").otherwise("Dissolved").alias("status"))
