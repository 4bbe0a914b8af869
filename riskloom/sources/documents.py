"""One large JSON document read by many tasks.

The file is read as text cut after each "}", which Spark splits by byte ranges. A split doesn't know where it starts:
inside a string or not, how deep, in which container. So each split is scanned once for what it does from either start
(quotes, change of depth, last container opened at each depth), sums over the splits before it give its start, and a
second scan cuts the records. A record that crosses splits is put together from its pieces.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from riskloom.operators.spread import at_rest

#: What the tasks are sent is a row for each split; more need larger splits (spark.sql.files.maxPartitionBytes).
MOST_SPLITS = 1 << 18


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _by_split() -> tuple:
    """Functions for the tasks, held here so that they are sent by value: splits of batches, and marks of a text."""
    marks = re.compile(rb'\\.|["{}\[\]]', re.DOTALL)

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        """(file, split, text) of each split of a partition; a split's rows follow each other."""
        now, held = None, []
        for b in batches:
            for file, split, value in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if now != (file, split):
                    if held:
                        yield *now, b"".join(held)
                    now, held = (file, split), []
                held.append(value.encode())
                held.append(b"}")
        if held:
            yield *now, b"".join(held)

    def found(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and bytes of quotes and brackets, and how many quotes are before each."""
        place = np.fromiter((m.start() for m in marks.finditer(text)), np.int64)
        mark = np.frombuffer(text, np.uint8)[place] if len(place) else np.zeros(0, np.uint8)
        keep = mark != 92
        place, mark = place[keep], mark[keep]
        return place, mark, np.cumsum(mark == 34) - (mark == 34)

    return splits, found


def _starts(pieces: DataFrame, level: int) -> DataFrame:
    """(file, split, inside, depth, listed) of every split: whether it starts in a string, how deep, and whether the
    container that holds records at `level`, if one is open, is a list."""
    splits, found = _by_split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, text in splits(batches):
            _, mark, before = found(text)
            rows = []
            for inside in (0, 1):
                own = mark[(mark != 34) & ((before + inside) % 2 == 0)]
                up = (own == 123) | (own == 91)
                depth = np.cumsum(np.where(up, 1, -1))
                opened = {int(d) - 1: int(m) for d, m in zip(depth[up], own[up])}
                rows.append((int(depth[-1]) if len(depth) else 0, list(opened.items())))
            yield pa.record_batch(
                [pa.array([file]), pa.array([split], pa.int64()), pa.array([int((mark == 34).sum())], pa.int64()),
                 *[pa.array([r[0]], pa.int64()) for r in rows],
                 *[pa.array([r[1]], pa.map_(pa.int32(), pa.int32())) for r in rows]],
                ["file", "split", "quotes", "delta0", "delta1", "opened0", "opened1"])

    scanned = at_rest(pieces.mapInArrow(
        run, "file string, split long, quotes long, delta0 long, delta1 long, opened0 map<int,int>, "
             "opened1 map<int,int>"), "splits")
    order = W.partitionBy("file").orderBy("split")  # a row for each split
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    known = scanned.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    pick = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    deep = known.withColumns({"delta": pick("delta"), "opened": pick("opened")}).withColumn(
        "depth", F.coalesce(F.sum("delta").over(earlier), F.lit(0)))
    opener = F.element_at("opened", (F.lit(level - 1) - F.col("depth")).cast("int"))
    return deep.withColumn("last", F.last(opener, ignorenulls=True).over(earlier)).select(
        "file", "split", "inside", "depth", F.coalesce(F.col("last") == 91, F.lit(False)).alias("listed"))


def records(spark: SparkSession, path: str, level: int) -> tuple[DataFrame, DataFrame]:
    """(file, position, record) and (file, outer) of JSON documents.

    A record is an object in a list that is `level` containers deep: 1 for [{..}, ..], 2 for {"rows": [{..}, ..]}.
    position ascends within a file. outer is the document without its records. Empty files and documents without
    records give no records.
    """
    pieces = _pieces(spark, path)
    starts = _starts(pieces, level).collect()
    if len(starts) > MOST_SPLITS:
        raise ValueError(f"{len(starts)} splits: raise spark.sql.files.maxPartitionBytes")
    sent = spark.sparkContext.broadcast({(r["file"], r["split"]): (r["inside"], r["depth"], r["listed"])
                                         for r in starts})
    splits, found = _by_split()
    between = re.compile(rb"[\s,]*\Z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, text in splits(batches):
            inside, depth, listed = sent.value[file, split]
            place, mark, before = found(text)
            own = (mark != 34) & ((before + inside) % 2 == 0)
            out, outer, seq = [], [], 0
            # Where what is open begins: a record that an earlier split began, or text outside of records.
            in_record, at = listed and depth > level, 0
            kind = "rest"
            for p, m in zip(place[own].tolist(), mark[own].tolist(), strict=True):
                if m in (123, 91):
                    if depth == level and listed and m == 123:
                        if not between.match(text[at:p]):
                            outer.append(text[at:p])
                        in_record, at, kind = True, p, "whole"
                    elif depth == level - 1:
                        listed = m == 91
                    depth += 1
                elif depth == 0:  # the mark put after a document's end closes nothing
                    outer.append(text[at:p])
                    at = p + 1
                else:
                    depth -= 1
                    if in_record and depth == level:
                        out.append((split + seq, kind, text[at:p + 1]))
                        seq += kind == "whole"
                        in_record, at = False, p + 1
            if in_record:
                out.append((split + seq, "begun" if kind == "whole" else "rest", text[at:]))
            elif not between.match(text[at:]):
                outer.append(text[at:])
            out.append((split, "outer", b"".join(outer)))
            position, kinds, texts = zip(*out, strict=True)
            yield pa.record_batch([pa.array([file] * len(out)), pa.array([split] * len(out), pa.int64()),
                                   pa.array(position, pa.int64()), pa.array(kinds),
                                   pa.array([t.decode() for t in texts])],
                                  ["file", "split", "position", "kind", "text"])

    cut = at_rest(pieces.mapInArrow(run, "file string, split long, position long, kind string, text string"), "cut")
    whole = cut.filter("kind = 'whole'").select("file", "position", F.col("text").alias("record"))
    # Two pieces a split at most: the rest of a record belongs to the last one begun before.
    begun = F.when(F.col("kind") == "begun", F.col("position"))
    loose = cut.filter("kind in ('begun', 'rest')").withColumn("owner", F.last(begun, ignorenulls=True).over(
        W.partitionBy("file").orderBy("split", F.col("kind").desc()).rowsBetween(W.unboundedPreceding, 0)))
    crossing = loose.groupBy("file", F.col("owner").alias("position")).agg(_joined().alias("record"))
    outer = at_rest(cut.filter("kind = 'outer'").groupBy("file").agg(_joined().alias("outer")), "outer")
    return whole.unionByName(crossing), outer


def _joined() -> Column:
    parts = F.array_sort(F.collect_list(F.struct("split", F.col("kind") == "begun", "text")))
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")
