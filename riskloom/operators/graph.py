"""The ontology as node and edge tables, and walks over them as joins."""
from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.functions import fixed
from riskloom.functions.normalize import SHARE, units
from riskloom.operators.spread import at_rest, skew_join, spread_join
from riskloom.plans.spec import LINKS, OBJECTS

Tables = Mapping[str, DataFrame]


def node_id(object_type: str, key: Column) -> Column:
    return F.concat(F.lit(f"{object_type}:"), key.cast("string"))


def key_of(node: Column) -> Column:
    """The primary key inside a node id."""
    return F.regexp_replace(node, "^[^:]*:", "")


def nodes(t: Tables, types: list[str] | None = None) -> DataFrame:
    """(node_id, object_type, title, properties) of every declared object type."""
    parts = []
    for name in types or OBJECTS:
        o = OBJECTS[name]
        df = t[o.table]
        parts.append(df.select(node_id(name, F.col(o.key)).alias("node_id"), F.lit(name).alias("object_type"),
                               F.col(o.title).cast("string").alias("title"),
                               F.to_json(F.struct(*df.columns)).alias("properties")))
    return reduce(DataFrame.unionByName, parts)


def edges(t: Tables, types: list[str] | None = None) -> DataFrame:
    """(src, dst, link_type, properties) of every declared link; parallel links of one type are one edge."""
    parts = []
    for name in types or LINKS:
        l = LINKS[name]
        src, dst = F.col(l.source_key), F.col(l.target_key)
        e = t[l.table].filter(src.isNotNull() & dst.isNotNull()).select(
            node_id(l.source, src).alias("src"), node_id(l.target, dst).alias("dst"), F.lit(name).alias("link_type"),
            (F.to_json(F.struct(*l.properties)) if l.properties else F.lit("{}")).alias("properties"))
        if not l.many_to_one:
            e = e.groupBy("src", "dst", "link_type").agg(F.max("properties").alias("properties"))
        parts.append(e)
    return reduce(DataFrame.unionByName, parts)


def _values(properties: Mapping[str, str]) -> Column:
    """Structs (property, text, number) of the columns that have a value, by their declared types."""
    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        is_number = kind in ("boolean", "int", "bigint", "double")
        text = (F.array_join(c, ",") if kind.startswith("array") else F.date_format(c, "yyyy-MM-dd HH:mm:ss")
                if kind == "timestamp" else c.cast("string"))
        value = F.struct(F.lit(name).alias("property"),
                         (F.lit(None).cast("string") if is_number else text).alias("text"),
                         (c.cast("double") if is_number else F.lit(None).cast("double")).alias("number"))
        return F.when(c.isNotNull(), value)

    return F.array_compact(F.array(*[one(n, k) for n, k in properties.items()]))


def node_properties(t: Tables, types: list[str] | None = None) -> DataFrame:
    """(node_id, property, text, number): the declared properties of every node, typed, one pass over each table."""
    return reduce(DataFrame.unionByName, [
        t[OBJECTS[n].table].select(node_id(n, F.col(OBJECTS[n].key)).alias("node_id"), F.inline(
            _values(OBJECTS[n].properties))) for n in types or OBJECTS])


def edge_properties(t: Tables, types: list[str] | None = None) -> DataFrame:
    """(src, dst, link_type, property, text, number) of every link that carries properties."""
    parts = []
    for name in types or [n for n, l in LINKS.items() if l.properties]:
        l, kinds = LINKS[name], dict(t[LINKS[name].table].dtypes)
        linked = t[l.table].filter(F.col(l.source_key).isNotNull() & F.col(l.target_key).isNotNull())
        parts.append(linked.select(
            node_id(l.source, F.col(l.source_key)).alias("src"), node_id(l.target, F.col(l.target_key)).alias("dst"),
            F.lit(name).alias("link_type"), F.inline(_values({p: kinds[p] for p in l.properties}))))
    return reduce(DataFrame.unionByName, parts)


#: Rows of the frontier, and edges, that meet at one node in one task.
STEP_BLOCK = 2_048


def step(frontier: DataFrame, edge: DataFrame, link_type: str, node: str, reached: str,
         forward: bool = True) -> DataFrame:
    """One hop from column `node` along a link type (or against it); adds column `reached`.

    A node with many edges (a country) makes a row for each of them and each row of the frontier there: both are cut.
    """
    here, there = ("src", "dst") if forward else ("dst", "src")
    hop = edge.filter(F.col("link_type") == link_type).select(F.col(here).alias(node), F.col(there).alias(reached))
    return skew_join(frontier, hop, [node], left_by=frontier.columns, right_by=[reached], block=STEP_BLOCK)


#: Events whose countries are sent to the tasks at once, and commodities of a supplier that one task holds.
WALK_EVENTS = 16_384
WALK_COMMODITIES = 4_096
#: Commodities that are tried at once against the events that are still open.
WALK_STEP = 64


def event_impact(t: Tables, home: DataFrame, asked: DataFrame) -> DataFrame:
    """Suppliers that each asked event touches, by messages along typed edges, one sum at every step and node.

    A home supplier is reached against the purchases: over the countries hit, the flows that come from them, their
    commodities and the lines that buy those. Any other supplier is reached where it is located. Shares no scoring
    code with the relational exposure, which it must equal.

    The walk starts from the supplier side: lines are summed to what a supplier buys, these meet the flows once, and
    each supplier keeps a message for each commodity and country. Events come to these messages in groups of
    WALK_EVENTS, as the countries that each hits: no rows of event and commodity are made. The commodity that adds most
    is found by bounds: commodities are tried by their sum over all countries, and an event is closed when none that
    is left can beat its best one.
    asked: event_id. home: vendor_id of home-country suppliers.
    """
    edge = lambda table, a, b, *more: t[table].filter(
        F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b, *more)
    event = t["risk_event"].join(asked.select("event_id"), "event_id", "left_semi").filter("severity > 0").select(
        "event_id", "severity")
    hit = at_rest(event.join(edge("link_event_affects", "event_id", "iso3").distinct(), "event_id"), "hit")

    # Step from the lines to what each supplier buys, before anything else.
    cents = F.floor(F.col("amount_gbp") * F.lit(1e4) + F.lit(0.5))
    bought = edge("po_line", "vendor_id", "cn8_code", "amount_gbp").groupBy("vendor_id", "cn8_code").agg(
        F.coalesce(F.sum(cents.cast("decimal(28,0)")), F.lit(0)).alias("spend"))
    total = bought.groupBy("vendor_id").agg(F.sum("spend").alias("total"), F.count(F.lit(1)).alias("kinds"))
    share = F.coalesce(F.try_divide(F.col("spend").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    weight = at_rest(bought.join(total, "vendor_id").select("vendor_id", "cn8_code", "total", "kinds",
                                                            share.alias("w")), "bought")

    # Step from the commodities to the countries that they come from.
    mine = weight.filter("w <> 0").join(home.select("vendor_id"), "vendor_id", "left_semi")
    part = F.floor(F.col("w") * F.col("share_of_uk_imports") * F.lit(1e12) + F.lit(0.5)).cast("double")
    flows = edge("import_flow", "cn8_code", "iso3", "share_of_uk_imports")
    messages = spread_join(mine, flows, ["cn8_code"], spread_by=["vendor_id"]).withColumn(
        "block", F.pmod(F.xxhash64("cn8_code"), F.ceil(F.col("kinds") / WALK_COMMODITIES)))
    carried = at_rest(messages.groupBy("vendor_id", "block").agg(F.collect_list(F.struct(
        "cn8_code", "iso3", part.alias("part"), F.col("share_of_uk_imports").alias("share"))).alias("m")), "messages")
    met = [at_rest(_met(carried, group, hit.schema), "met") for group in _groups_of_events(hit)]
    columns = ["event_id", "vendor_id", F.least(F.lit(1.0), F.col("severity") * F.col("unit")).alias("exposure_score"),
               F.col("d.cn8_code").alias("driver_commodity"), F.col("d.iso3").alias("driver_country"), "path_type"]

    main = weight.filter("total <> 0").join(home.select("vendor_id"), "vendor_id", "left_anti").groupBy("vendor_id").agg(
        F.min(F.struct((-F.col("w")).alias("p"), "cn8_code")).alias("m"))
    located = edge("erp_supplier", "vendor_id", "country_iso3").withColumnRenamed("country_iso3", "iso3")
    out = main.join(located, "vendor_id").join(hit, "iso3").select(
        "event_id", "severity", "vendor_id", F.lit(1.0).alias("unit"),
        F.struct(F.lit(0).alias("p"), F.col("m.cn8_code").alias("cn8_code"), "iso3").alias("d"),
        F.lit("direct").alias("path_type")).select(*columns)
    for found in met:
        # A supplier's blocks of commodities: their sums add up, the best one of any is the best.
        whole = found.groupBy("event_id", "severity", "vendor_id").agg(
            (F.sum("units") / F.lit(1e12)).alias("unit"),
            F.min(F.struct((-F.col("best")).alias("p"), "cn8_code", "iso3")).alias("d"))
        out = out.unionByName(whole.withColumn("path_type", F.lit("inferred")).select(*columns))
    return out.filter("exposure_score > 0")


def _groups_of_events(hit: DataFrame) -> Iterator[list]:
    """(event_id, severity, countries) of every event, WALK_EVENTS at a time; an event hits the world's countries at
    most."""
    rows = hit.groupBy("event_id", "severity").agg(F.collect_list("iso3").alias("isos"))
    held: list = []
    for r in rows.toLocalIterator():
        held.append((r["event_id"], r["severity"], r["isos"]))
        if len(held) == WALK_EVENTS:
            yield held
            held = []
    if held:
        yield held


def _met(carried: DataFrame, group: list, hit_schema: T.StructType) -> DataFrame:
    """(event_id, severity, vendor_id, units, best, cn8_code, iso3): where the messages meet the events of a group.

    units: what the supplier's commodities of a block add. best: the largest of them, of the least code on a tie, with
    the country of its largest share.
    """
    countries = {c: i for i, c in enumerate(sorted({c for _, _, isos in group for c in isos}))}
    hits = np.zeros((len(countries), len(group)), np.uint8)
    for e, (_, _, isos) in enumerate(group):
        hits[[countries[c] for c in isos], e] = 1
    sent = carried.sparkSession.sparkContext.broadcast(  # WALK_EVENTS x countries bits
        (np.packbits(hits, axis=1), len(group), countries, [g[0] for g in group], [float(g[1]) for g in group]))
    step = WALK_STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, n, number, event_ids, severities = sent.value
        ids, severity = pa.array(event_ids), pa.array(severities, pa.float64())
        for batch in batches:
            for i in range(batch.num_rows):
                lists = batch.column(1).slice(i, 1).flatten()
                code, iso = lists.field(0).to_pylist(), lists.field(1).to_pylist()
                known = np.array([c in number for c in iso], bool)
                part, share = lists.field(2).to_numpy(), lists.field(3).to_numpy()
                codes = sorted(set(code))
                isos = sorted({c for c in iso if c in number})
                if not isos:
                    continue
                at_code = {c: k for k, c in enumerate(codes)}
                at_iso = {c: k for k, c in enumerate(isos)}
                row = np.array([at_code[c] for c in code])[known]
                col = np.array([at_iso[c] for c in iso if c in number])
                value, of = np.zeros((len(codes), len(isos))), np.full((len(codes), len(isos)), -1.0)
                np.add.at(value, (row, col), part[known])
                np.maximum.at(of, (row, col), share[known])
                struck = np.unpackbits(packed[[number[c] for c in isos]], axis=1)[:, :n].astype(np.float64)
                units = value.sum(axis=0) @ struck
                open_ = np.flatnonzero(units > 0)
                most = np.maximum(value, 0).sum(axis=1)
                order = np.argsort(-most, kind="stable")
                best, chosen = np.full(n, -np.inf), np.zeros(n, np.int64)
                for k in range(0, len(order), step):
                    own = np.sort(order[k:k + step])
                    score = value[own] @ struck[:, open_]
                    top = score.argmax(axis=0)
                    high, which = score[top, np.arange(len(open_))], own[top]
                    better = (high > best[open_]) | ((high == best[open_]) & (which < chosen[open_]))
                    best[open_[better]], chosen[open_[better]] = high[better], which[better]
                    if k + step >= len(order):
                        break
                    open_ = open_[best[open_] <= most[order[k + step]]]
                    if not len(open_):
                        break
                seen = np.flatnonzero(units > 0)
                via = np.where(struck[:, seen].T > 0, of[chosen[seen]], -1.0).argmax(axis=1)
                take = pa.array(seen)
                yield pa.record_batch(
                    [ids.take(take), severity.take(take), pa.concat_arrays([batch.column(0).slice(i, 1)]).take(
                        pa.array(np.zeros(len(seen), np.int64))), pa.array(units[seen]), pa.array(best[seen]),
                     pa.array(codes).take(pa.array(chosen[seen])), pa.array(isos).take(pa.array(via))],
                    ["event_id", "severity", "vendor_id", "units", "best", "cn8_code", "iso3"])

    item = carried.schema["m"].dataType.elementType
    schema = T.StructType([hit_schema["event_id"], T.StructField("severity", T.DoubleType()),
                           carried.schema["vendor_id"], T.StructField("units", T.DoubleType()),
                           T.StructField("best", T.DoubleType()), item["cn8_code"], item["iso3"]])
    arrow = to_arrow_schema(schema)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.record_batch([c.cast(f.type) for c, f in zip(b.columns, arrow, strict=True)], arrow.names)

    return carried.select("vendor_id", "m").mapInArrow(cast, schema)


def footprint_impact(t: Tables, home: DataFrame, events: DataFrame) -> DataFrame:
    """(footprint, severity, vendor_id) of every event: the walk taken once from one event of each kind.

    Events that share footprint and severity have the same edges to countries. events: event_id, footprint, severity.
    """
    kinds = events.groupBy("footprint", "severity").agg(F.min("event_id").alias("event_id"))
    return event_impact(t, home, kinds).join(kinds, "event_id").drop("event_id")


def reached(po: DataFrame, suppliers: DataFrame, import_flow: DataFrame, countries: DataFrame) -> DataFrame:
    """(footprint, reached): how many suppliers are on any path before scoring, located in a country that it hits or
    selling a commodity imported from there.

    Both ends are cut down first: countries per commodity and commodities per supplier become suppliers per country,
    kept as bitmaps. A footprint's bitmaps are or-ed and counted; no row is made for a footprint and a supplier.
    """
    from_country = import_flow.select("cn8_code", "iso3").distinct()
    buys = po.select("vendor_id", "cn8_code").distinct().join(suppliers.select("vendor_id"), "vendor_id", "left_semi")
    via_flow = spread_join(buys, from_country, ["cn8_code"], spread_by=["vendor_id"]).select("vendor_id", "iso3")
    located = suppliers.filter(F.col("country_iso3").isNotNull()).select(
        "vendor_id", F.col("country_iso3").alias("iso3"))
    number = at_rest(suppliers.select("vendor_id").distinct().withColumn(
        "n", F.monotonically_increasing_id() + 1), "numbers")
    touch = via_flow.union(located).distinct().join(number, "vendor_id")
    maps = touch.groupBy("iso3", F.bitmap_bucket_number("n").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("suppliers"))
    return (countries.select("footprint", "iso3").join(maps, "iso3").groupBy("footprint", "bucket")
            .agg(F.bitmap_count(F.bitmap_or_agg("suppliers")).alias("n"))
            .groupBy("footprint").agg(F.sum("n").alias("reached")))


# ---- explanation ---------------------------------------------------------------------------------------------

def _said(text: str, *values: Column) -> Column:
    """A part of the sentence; none where a value is missing."""
    there = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    return F.when(there, F.format_string(fixed.PATH_TEXTS[text], *values))


def explain_path(exposure: DataFrame, t: Tables, home: Column) -> DataFrame:
    """The chain behind each exposure as text steps joined by ' > '."""
    ev = t["risk_event"].select("event_id", F.concat(F.col("name"), F.lit(" ("), F.col("alert_level"), F.lit(")"))
                                .alias("_event"))
    ven = t["erp_supplier"].select("vendor_id", "vendor_name", home.alias("_home"))
    cty = t["country"].select(F.col("iso3").alias("driver_country"),
                              _said("country", F.col("name")).alias("_country"))
    com = t["commodity"].select(F.col("cn8_code").alias("driver_commodity"),
                                F.substring("description", 1, 50).alias("_what"))
    flow = t["import_flow"].select(F.col("cn8_code").alias("driver_commodity"), F.col("iso3").alias("driver_country"),
                                   F.col("share_of_uk_imports").alias("_share"))
    pct = F.floor(F.coalesce("_share", F.lit(0.0)) * 100 + 0.5).cast("bigint").cast("string")
    inferred = _said("inferred", pct, F.col("driver_commodity").cast("string"), F.col("_what"), F.col("vendor_name"))
    direct = _said("direct", F.col("vendor_name"))
    return (exposure.join(ev, "event_id").join(ven, "vendor_id").join(cty, "driver_country", "left")
            .join(com, "driver_commodity", "left").join(flow, ["driver_commodity", "driver_country"], "left")
            .select("event_id", "vendor_id", F.concat_ws(
                " > ", "_event", "_country", F.when(F.col("_home"), inferred).otherwise(direct)).alias("path")))


def breakdown(pairs: DataFrame, t: Tables, weights: DataFrame) -> DataFrame:
    """Why each (event_id, vendor_id) pair is exposed: one row per commodity and driving country.

    Commodities without risk keep one row with null country.
    """
    ev = t["risk_event"].select("event_id", "severity")
    affects = t["link_event_affects"].select("event_id", "iso3").distinct().withColumn("_hit", F.lit(True))
    lines = pairs.select("event_id", "vendor_id").distinct().join(ev, "event_id").join(
        weights.select("vendor_id", "cn8_code", "country_iso3", "is_home", "spend", "w", "po_lines"), "vendor_id")
    flows = t["import_flow"].select("cn8_code", "iso3", "flow_id", F.col("share_of_uk_imports").alias("share"),
                                    "value_gbp")
    # One row per (pair, commodity, candidate country): all source countries, or the supplier's own.
    home = lines.filter("is_home").join(flows, "cn8_code", "left")
    abroad = lines.filter(~F.col("is_home")).withColumns({
        "iso3": F.col("country_iso3"), "flow_id": F.lit(None).cast("string"), "share": F.lit(1.0),
        "value_gbp": F.lit(None).cast("double")})
    sourced = home.unionByName(abroad, allowMissingColumns=True)
    marked = sourced.join(affects, ["event_id", "iso3"], "left")
    # A commodity comes from at most the world's countries, so these groups are short.
    group = W.partitionBy("event_id", "vendor_id", "cn8_code")
    struck = F.coalesce("_hit", F.lit(False))
    total = F.coalesce(F.sum(F.when(struck, units(F.col("share"), SHARE))).over(group), F.lit(0))
    kept = (marked.withColumn("risk", total / F.lit(SHARE) * F.col("severity"))
            .withColumn("_pos", F.row_number().over(group.orderBy("iso3")))
            .withColumn("_any", F.max(struck).over(group))
            .filter(struck | (~F.col("_any") & (F.col("_pos") == 1))))
    names = t["country"].select("iso3", F.col("name").alias("country"))
    what = t["commodity"].select("cn8_code", "description")
    shown = lambda c: F.when(struck, F.col(c)).alias(c)
    return (kept.select("event_id", "vendor_id", "cn8_code", "is_home", "spend", F.col("w").alias("weight"),
                        "po_lines", "risk", (F.col("w") * F.col("risk")).alias("contribution"), shown("iso3"),
                        shown("flow_id"), shown("share"), shown("value_gbp"))
            .join(what, "cn8_code", "left").join(names, "iso3", "left"))


def breakdown_nested(flat: DataFrame) -> DataFrame:
    """One row per commodity with its countries as a list, largest share first (a list of countries is short)."""
    entry = F.struct((-F.col("share")).alias("rank"), "iso3", "country", "flow_id", "share", "value_gbp")
    keys = ["event_id", "vendor_id", "cn8_code", "description", "spend", "weight", "po_lines", "risk", "contribution"]
    return flat.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("iso3").isNotNull(), entry))).alias("c")).select(
        *keys, F.transform("c", lambda x: x.dropFields("rank")).alias("countries"))


def for_all(table: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows of the event that stands for a kind as rows of all its events. kinds: kind, event_id."""
    return table.withColumnRenamed("event_id", "kind").join(kinds, "kind").select(*table.columns)


def path_subgraph(flat: DataFrame, t: Tables, resolves: DataFrame, commodities: int = 3,
                  countries: int = 3, events: DataFrame | None = None) -> DataFrame:
    """Edges (event_id, vendor_id, src, dst, link_type) of the picture behind each pair of a breakdown.

    Top contributing commodities, top countries of each; one label per (src, dst), first in reading order. With events
    (kind, event_id) the breakdown holds one event of each kind, and what is kept of it is drawn for all of them.
    """
    pair = ["event_id", "vendor_id"]
    top = (flat.filter(F.col("contribution") > 0).select(*pair, "cn8_code", "contribution").distinct()
           .withColumn("_r", F.row_number().over(
               W.partitionBy(*pair).orderBy(F.col("contribution").desc(), "cn8_code")))
           .filter(F.col("_r") <= commodities).select(*pair, "cn8_code"))
    kept = (flat.filter(F.col("iso3").isNotNull()).join(top, pair + ["cn8_code"])
            .withColumn("_r", F.row_number().over(
                W.partitionBy(*pair, "cn8_code").orderBy(F.col("share").desc(), "iso3")))
            .filter(F.col("_r") <= countries).select(*pair, "cn8_code", "iso3", "flow_id"))
    pairs = flat.select(*pair).distinct()
    if events is not None:
        kept, pairs = for_all(kept, events), for_all(pairs, events)
    com = node_id("Commodity", F.col("cn8_code"))
    po = node_id("PurchaseOrderLine", F.col("cn8_code"))
    sup = node_id("ERPSupplier", F.col("vendor_id"))
    ev = node_id("RiskEvent", F.col("event_id"))
    cty = node_id("Country", F.col("iso3"))
    flow = node_id("ImportFlow", F.col("flow_id"))

    def edge(order: int, src: Column, dst: Column, label, on=F.lit(True)) -> Column:
        lab = F.lit(label) if isinstance(label, str) else label
        return F.when(on, F.struct(F.lit(order).alias("o"), src.alias("src"), dst.alias("dst"),
                                   lab.alias("link_type")))

    inferred = F.col("flow_id").isNotNull()
    per_country = kept.select(*pair, F.explode(F.array_compact(F.array(
        edge(0, po, com, "po_commodity"), edge(1, po, sup, "ordered_from"), edge(2, ev, cty, "affects"),
        edge(3, sup, cty, "located_in", ~inferred), edge(4, flow, cty, "flow_from_country", inferred),
        edge(5, flow, com, "flow_of_commodity", inferred)))).alias("e"))
    label = F.concat(F.lit("resolves_to"), F.when(F.col("confidence").isNotNull(), F.format_string(
        " (%s)", F.format_number("confidence", 2))).otherwise(F.lit("")))
    matched = (pairs
               .join(resolves.filter(F.col("company_number").isNotNull())
                     .select("vendor_id", "company_number", "confidence"), "vendor_id")
               .select(*pair, edge(6, sup, node_id("Company", F.col("company_number")), label).alias("e")))
    return (per_country.unionByName(matched).groupBy(*pair, F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))
            .agg(F.min_by("e.link_type", "e.o").alias("link_type")))


def counts(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(kind, type, n) of nodes and edges."""
    n = node.groupBy(F.col("object_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    e = edge.groupBy(F.col("link_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return (n.select(F.lit("node").alias("kind"), "type", "n")
            .unionByName(e.select(F.lit("edge").alias("kind"), "type", "n")))
