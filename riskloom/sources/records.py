"""One large CSV file read by many tasks, quoted line breaks included.

Spark splits the file by byte ranges at line breaks. A split doesn't know whether it starts inside a quoted field, so
each is scanned once from either start. What it does to the start is one of four maps (keep, swap, end outside, end
inside); composing the maps of the splits before it gives its start, and a second scan cuts the records. A record that
crosses splits is put together from its pieces.

A quote opens a field only at the field's beginning, a doubled one stands for itself, and text after a closing quote
belongs to the field: a quote in the middle of an unquoted field is a character like any other.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from riskloom.operators.spread import at_rest
from riskloom.sources.documents import MOST_SPLITS

#: A record's share of one split must be shorter, else its quotes are taken for broken and the reader stops.
LONGEST_PIECE = 64 << 20

Splits = Iterator[tuple[str, int, Iterator[bytes]]]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, as broken characters must not stop a task."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"))


def _by_split() -> tuple[Callable[[Iterator[pa.RecordBatch]], Splits], Callable[[bytes, bool], bool]]:
    """Functions for the tasks, held here so that they are sent by value."""
    quoted = rb'"[^"]*+(?:""[^"]*+)*+'
    open_at_end = re.compile(rb'(?:(?:' + quoted + rb'"[^,]*+|(?!")[^,]*+),)*+' + quoted + rb"\Z")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
        """(file, split, lines) for every run of rows of one split in a batch."""
        for b in batches:
            file, split, value = (c.to_pylist() for c in b.columns)
            at = 0
            for i in range(1, len(file) + 1):
                if i == len(file) or (file[i], split[i]) != (file[at], split[at]):
                    yield file[at], split[at], value[at:i]
                    at = i

    def after(line: bytes, inside: bool) -> bool:
        """Is a quoted field open at the end of the line?"""
        if b'"' not in line:
            return inside
        return open_at_end.match(b'"' + line if inside else line) is not None

    return runs, after


def _starts(lines: DataFrame) -> DataFrame:
    """(file, split, inside) of every split that holds a line's beginning."""
    runs, after = _by_split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], tuple[bool, bool]] = {}  # a task has few splits
        for file, split, values in runs(batches):
            a, b = ends.get((file, split), (False, True))
            for line in values:
                a, b = (after(line, a), after(line, b)) if a != b else (after(line, a),) * 2
            ends[file, split] = a, b
        if ends:
            yield pa.record_batch([pa.array([k[0] for k in ends]), pa.array([k[1] for k in ends], pa.int64()),
                                   pa.array([e[0] for e in ends.values()]), pa.array([e[1] for e in ends.values()])],
                                  ["file", "split", "from_out", "from_in"])

    scanned = at_rest(lines.mapInArrow(run, "file string, split long, from_out boolean, from_in boolean"), "splits")
    order = W.partitionBy("file").orderBy("split")  # a row for each split
    # The start is what the last constant map before it gives, swapped by every swap after that one.
    constant = F.col("from_out") == F.col("from_in")
    swaps = scanned.withColumn("swaps", F.sum((F.col("from_out") & ~F.col("from_in")).cast("long")).over(
        order.rowsBetween(W.unboundedPreceding, 0)))
    fixed = F.when(constant, F.struct(F.col("from_out").cast("long").alias("value"), "swaps"))
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    state = swaps.withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier)).withColumn(
        "swapped", F.coalesce(F.lag("swaps").over(order), F.lit(0)))
    start = (F.coalesce("fixed.value", F.lit(0)) + F.col("swapped") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    return state.select("file", "split", start.alias("inside"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """line: each record as written, without its final line break; the line breaks of quoted fields stay.

    Blank lines between records are left out, as are a byte-order mark and the CR of a CR LF. A record that never
    closes its quotes goes on to the end of its file; if it covers LONGEST_PIECE bytes of a split, reading fails and
    names the place.
    """
    lines = _lines(spark, path)
    starts = _starts(lines).limit(MOST_SPLITS + 1).collect()
    if len(starts) > MOST_SPLITS:
        raise ValueError(f"over {MOST_SPLITS} splits: raise spark.sql.files.maxPartitionBytes")
    sent = spark.sparkContext.broadcast({(r["file"], r["split"]): r["inside"] for r in starts})
    runs, after = _by_split()
    longest = LONGEST_PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(file: str, split: int, rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([file] * len(rows)), pa.array([split] * len(rows), pa.int64()),
                 pa.array([kind for kind, _ in rows]), pa.array([t.decode(errors="replace") for _, t in rows])],
                ["file", "split", "kind", "text"])

        now, held, size, kind, inside = None, [], 0, "whole", False
        for file, split, values in runs(batches):
            out = []
            if now != (file, split):
                if held:
                    yield batch(*now, [("begun" if kind == "whole" else "rest", b"\n".join(held))])
                now, held, size, inside = (file, split), [], 0, sent.value[file, split]
                kind = "rest" if inside else "whole"
            for line in values:
                inside = after(line, inside)
                held.append(line)
                if inside:
                    size += len(line)
                    if size > longest:
                        raise ValueError(f"{file}: quotes are open for {size} bytes of the split at {split}")
                else:
                    text = b"\n".join(held) if len(held) > 1 else line
                    held, size = [], 0
                    if text.strip() or kind == "rest":
                        out.append((kind, text))
                    kind = "whole"
            if out:
                yield batch(file, split, out)
        if held:
            yield batch(*now, [("begun" if kind == "whole" else "rest", b"\n".join(held))])

    cut = at_rest(lines.mapInArrow(run, "file string, split long, kind string, text string"), "cut")
    # Two pieces a split at most: the rest of a record belongs to the last one begun before.
    begun = F.when(F.col("kind") == "begun", F.col("split"))
    loose = cut.filter("kind != 'whole'").withColumn("owner", F.last(begun, ignorenulls=True).over(
        W.partitionBy("file").orderBy("split", F.col("kind").desc()).rowsBetween(W.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.struct("split", "text")))
    crossing = loose.groupBy("file", "owner").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"))
    return cut.filter("kind = 'whole'").select("text").unionByName(crossing.select("text")).select(
        F.rtrim("text", F.lit("\r\n")).alias("line"))
