"""Best-two-fit packing: bins are planned on the histogram of lengths, documents take their places by rank."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskloom.llm.common import at_rest, mapped, partitions, running, table
from riskloom.llm.encoding import library_ids, slices

END = 0
CAPACITY = 2048


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(how many bins, lengths in each bin) for counts[length] documents, all lengths below capacity.

    A bin takes the longest document that fits, again and again; then its shortest one gives way to two unpacked ones
    that fill the widened gap better, the best two first. The same bin is made as often as the counts allow, so the
    work depends on the number of lengths, not of documents.
    """
    left = counts.astype(np.int64).copy()
    made = []
    lengths = np.arange(capacity + 1)
    while left.any():
        own = np.zeros_like(left)
        items: list[int] = []
        room = capacity
        while room > 0:
            fit = np.flatnonzero((left - own)[: room + 1])
            if not len(fit):
                break
            length = int(fit[-1])
            take = int(min(room // length, left[length] - own[length]))
            own[length] += take
            items += [length] * take
            room -= take * length
        if room:
            gap = room + items[-1]
            free = left - own
            # The longest free length at or below each length.
            at_most = np.maximum.accumulate(np.where(free > 0, lengths, 0))
            a = lengths[1:gap][free[1:gap] > 0]
            b = at_most[np.minimum(gap - a, a)]
            alone = (b == a) & (free[a] < 2)
            b = np.where(alone, at_most[a - 1], b)
            good = b > 0
            if good.any():
                both = np.where(good, a + b, 0)
                best = int(np.argmax(both))
                if both[best] > items[-1]:
                    own[items.pop()] -= 1
                    items += [int(a[best]), int(b[best])]
                    own[items[-1]] += 1
                    own[items[-2]] += 1
        used = np.flatnonzero(own)
        times = int((left[used] // own[used]).min())
        left[used] -= times * own[used]
        made.append((times, items))
    return made


def slots(bins: list[tuple[int, list[int]]]) -> tuple[dict[str, np.ndarray], int]:
    """Runs of ranks: documents of `length` ranked from `rank` on lie at `offset` of sequence `sequence` on."""
    rows, first, used = [], 0, {}
    for times, items in bins:
        offset = 0
        for length in items:
            rank = used.get(length, 0)
            rows.append((length, rank, first, offset))
            used[length] = rank + times
            offset += length
        first += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns, strict=True)), first


def placed(pieces: DataFrame, order: list[Column], spread: Column, length: str = "length",
           capacity: int = CAPACITY) -> DataFrame:
    """pieces (at rest, lengths 1 to capacity) with `sequence_id` and `offset`.

    The histogram, at most `capacity` rows, is all that reaches the driver. Every piece gets its rank among those of
    its length: first within a hash bucket, then by the buckets' totals, so a length that most rows share is spread.
    """
    spark = pieces.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy(length).count().collect():
        histogram[row[length]] = row["count"]
    whole = int(histogram[capacity])
    histogram[capacity] = 0
    table_, bins = slots(plan(histogram, capacity))
    # Full pieces need no plan: each is a sequence of its own after the others.
    runs = {n: np.append(c, x).astype(np.int64) for (n, c), x in zip(table_.items(), (capacity, 0, bins, 0),
                                                                     strict=True)}
    starts = (runs["length"] << 48) | runs["rank"]
    assert whole < 1 << 48
    ranked = running(pieces.withColumn("_spread", F.pmod(F.xxhash64(spread), F.lit(4 * partitions(spark)))),
                     "_spread", order, {"_rank": F.lit(1).cast("long")}, [length]).drop("_spread")
    names = ranked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(names.index(length)).to_numpy().astype(np.int64)
            rank = batch.column(names.index("_rank")).to_numpy()
            at = np.searchsorted(starts, (own << 48) | rank, side="right") - 1
            yield pa.record_batch([*batch.columns, pa.array(runs["sequence"][at] + rank - runs["rank"][at]),
                                   pa.array(runs["offset"][at])], [*names, "sequence_id", "offset"])

    schema = T.StructType([*ranked.schema.fields]).add("sequence_id", "long").add("offset", "long")
    return ranked.transform(mapped, run, schema).drop("_rank")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones at the end, so that the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces_of(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
              capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every whole text, each text ended by id 0."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_ids(path)
        for batch in batches:
            for keys, texts in slices(batch.columns):
                rows = []
                for k, ids in zip(keys, encoder.ids([t or "" for t in texts]), strict=True):
                    raw = ids.tobytes() + END.to_bytes(4, "little")
                    for i, (at, n) in enumerate(cut(len(raw) // 4, capacity)):
                        own = raw[4 * at:4 * (at + n)]
                        rows.append((k, i, at, n, zlib.crc32(own), own)[:6 if with_ids else 5])
                columns = list(zip(*rows, strict=True)) or [[]] * (6 if with_ids else 5)
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)],
                                      ["key", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    schema = f"key {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select(key, text).transform(mapped, run, schema + ", ids binary" * with_ids)


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there, sequences gapless from 0.

    Null and empty texts are one piece, the end id. Null and repeated keys stay; rows equal in key and ids may trade
    places. An empty table gives no rows. With `with_ids` the ids travel along as little-endian 32-bit numbers.
    """
    pieces = at_rest(pieces_of(docs, key, text, path, capacity, with_ids), "pieces")
    order = [F.col("key").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")]
    return placed(pieces, order, F.struct("key", "piece", "ids_crc32"), capacity=capacity).withColumnRenamed(
        "key", key)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
