"""Scenarios (sets of countries hit) against tables by country: scenarios are sent to the tasks as bits, in groups, so
that no row is made for a scenario and a commodity unless it is part of the answer."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.operators.spread import at_rest, spread_join

#: Scenarios that are sent at once: as many bits for each country of the world.
GROUP = 16_384
#: Commodities of a supplier that one task holds.
BLOCK = 4_096
#: Entries of each sorted list that are taken at once.
DEPTH = 8


def _groups(hits: DataFrame, scenario: str) -> Iterator[tuple]:
    """(bits, scenarios, countries): GROUP scenarios at a time, bits by country; none is held longer than its turn."""
    rows = hits.filter(F.col("iso3").isNotNull()).groupBy(scenario).agg(F.collect_set("iso3").alias("isos"))

    def packed(held: list) -> tuple:
        countries = {c: i for i, c in enumerate(sorted({c for _, isos in held for c in isos}))}
        bits = np.zeros((len(countries), len(held)), np.uint8)
        for at, (_, isos) in enumerate(held):
            bits[[countries[c] for c in isos], at] = 1
        return np.packbits(bits, axis=1), [name for name, _ in held], countries

    held: list = []
    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == GROUP:
            yield packed(held)
            held = []
    if held:
        yield packed(held)


def _each_group(rows: DataFrame, hits: DataFrame, scenario: str, kernel: Callable, schema: T.StructType) -> DataFrame:
    """kernel(row, struck, isos, names) over packed rows (key..., m: structs with iso3), once for each group.

    struck: countries x scenarios of 0 and 1, for the countries that the row has and the group hits (isos, ascending).
    The kernel gives arrays for the columns of schema after the row's own keys.
    """
    keys = [c for c in rows.columns if c != "m"]
    item = rows.schema["m"].dataType.elementType
    at_iso = item.names.index("iso3")
    arrow = to_arrow_schema(schema)
    out = []
    for bits, names, countries in _groups(hits, scenario):
        sent = rows.sparkSession.sparkContext.broadcast((bits, names, countries))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bits, names, countries = sent.value
            ids = pa.array(names)
            for batch in batches:
                m = batch.column(len(keys))
                for i in range(batch.num_rows):
                    fields = m.slice(i, 1).flatten()
                    iso = fields.field(at_iso).to_pylist()
                    isos = sorted({c for c in iso if c in countries})
                    if not isos:
                        continue
                    struck = np.unpackbits(bits[[countries[c] for c in isos]], axis=1)[:, :len(names)].astype(
                        np.float64)
                    place = {c: k for k, c in enumerate(isos)}
                    col = np.array([place.get(c, -1) for c in iso])
                    found = kernel(fields, col, struck, isos)
                    if found is None:
                        continue
                    seen, columns = found
                    none = pa.array(np.zeros(len(seen), np.int64))
                    own = [batch.column(k).slice(i, 1).take(none) for k in range(len(keys))]
                    columns = [ids.take(pa.array(seen)), *own, *columns]
                    yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], arrow.names)

        out.append(rows.select(*keys, "m").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, out) if out else rows.sparkSession.createDataFrame([], schema)


def risk_of_commodities(import_flow: DataFrame, hits: DataFrame, scenario: str, unit: float) -> DataFrame:
    """(scenario, cn8_code, risk_units, top_country): what each commodity inherits from each scenario's countries, in
    units of a share, and the hit country of the largest share (the least on a tie)."""
    share = F.col("share_of_uk_imports")
    rows = import_flow.filter(F.col("iso3").isNotNull() & share.isNotNull()).groupBy("cn8_code").agg(F.collect_list(
        F.struct("iso3", share.alias("share"))).alias("m"))  # a commodity comes from the world's countries at most

    def kernel(fields, col, struck, isos):
        share = fields.field(1).to_numpy()
        whole, of = np.zeros(len(isos)), np.full(len(isos), -np.inf)
        np.add.at(whole, col[col >= 0], np.floor(share[col >= 0] * unit + 0.5))
        np.maximum.at(of, col[col >= 0], share[col >= 0])
        seen = np.flatnonzero(struck.any(axis=0))
        via = np.where(struck[:, seen] > 0, of[:, None], -np.inf).argmax(axis=0)
        return seen, [pa.array((whole @ struck[:, seen]).astype(np.int64)), pa.array(isos).take(pa.array(via))]

    schema = T.StructType([hits.schema[scenario], import_flow.schema["cn8_code"], T.StructField("risk_units", T.LongType()),
                           T.StructField("top_country", import_flow.schema["iso3"].dataType)])
    return _each_group(rows, hits, scenario, kernel, schema)


def inherited(lines: DataFrame, flows: DataFrame, hits: DataFrame, scenario: str, unit: float) -> DataFrame:
    """(scenario, vendor_id, units, driver_commodity, driver_country): the sum over the countries hit of w x share.

    lines: vendor_id, cn8_code, w. flows: cn8_code, iso3, share. hits: scenario, iso3.

    A supplier's parts stand in one list for each country, largest first. The driver - the commodity that adds most,
    of the least code on a tie - is found by the threshold algorithm: all lists are read to the same depth, what is met
    is summed for the scenarios that are still open, and a scenario is closed when its best sum exceeds the sum of the
    parts that its lists have reached, which no commodity further down can. A supplier of very many commodities is cut
    into blocks, whose sums add up and whose best drivers meet.
    """
    met = spread_join(lines.filter("w <> 0"), flows.filter(F.col("iso3").isNotNull() & F.col("share").isNotNull()),
                      ["cn8_code"], spread_by=["vendor_id"])
    part = F.floor(F.col("w") * F.col("share") * F.lit(unit) + F.lit(0.5))
    kinds = lines.groupBy("vendor_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    packed = (met.join(kinds, "vendor_id")
              .groupBy("vendor_id", F.pmod(F.xxhash64("cn8_code"), F.col("blocks")).alias("block"))
              .agg(F.collect_list(F.struct("iso3", "cn8_code", part.cast("double").alias("part"), "share")).alias("m")))
    packed = at_rest(packed.drop("block"), "sourced")
    depth = DEPTH

    def kernel(fields, col, struck, isos):
        known = col >= 0
        code = fields.field(1).to_pylist()
        codes = sorted(set(code))
        number = {c: k for k, c in enumerate(codes)}
        row, col = np.array([number[c] for c in code])[known], col[known]
        parts, shares = np.zeros((len(codes), len(isos))), np.full((len(codes), len(isos)), -np.inf)
        np.add.at(parts, (row, col), fields.field(2).to_numpy()[known])
        np.maximum.at(shares, (row, col), fields.field(3).to_numpy()[known])
        units = parts.sum(axis=0) @ struck
        seen = np.flatnonzero(units > 0)
        if not len(seen):
            return None
        # Every list is as long as there are codes: what a country does not supply is a part of 0.
        lists = np.argsort(-parts, axis=0, kind="stable")
        best, chosen = np.full(struck.shape[1], -np.inf), np.full(struck.shape[1], len(codes))
        open_, tried = seen, np.zeros(len(codes), bool)
        for at in range(0, len(codes), depth):
            new = np.unique(lists[at:at + depth])
            new = new[~tried[new]]
            tried[new] = True
            if len(new):
                sums = parts[new] @ struck[:, open_]
                top = sums.argmax(axis=0)
                high, which = sums[top, np.arange(len(open_))], new[top]
                better = (high > best[open_]) | ((high == best[open_]) & (which < chosen[open_]))
                best[open_[better]], chosen[open_[better]] = high[better], which[better]
            last = min(at + depth, len(codes)) - 1
            reached = np.maximum(parts[lists[last], np.arange(len(isos))], 0) @ struck[:, open_]
            open_ = open_[best[open_] <= reached]
            if not len(open_):
                break
        via = np.where(struck[:, seen].T > 0, shares[chosen[seen]], -np.inf).argmax(axis=1)
        return seen, [pa.array(units[seen]), pa.array(best[seen]), pa.array(codes).take(pa.array(chosen[seen])),
                      pa.array(isos).take(pa.array(via))]

    item = packed.schema["m"].dataType.elementType
    schema = T.StructType([hits.schema[scenario], packed.schema["vendor_id"], T.StructField("units", T.DoubleType()),
                           T.StructField("best", T.DoubleType()), item["cn8_code"], item["iso3"]])
    found = _each_group(packed, hits, scenario, kernel, schema)
    return found.groupBy(scenario, "vendor_id").agg(
        F.sum("units").alias("units"),
        F.min(F.struct((-F.col("best")).alias("b"), "cn8_code", "iso3")).alias("d")).select(
        scenario, "vendor_id", "units", F.col("d.cn8_code").alias("driver_commodity"),
        F.col("d.iso3").alias("driver_country"))
