"""Token files: a concatenated id array, and document boundaries in Elias-Fano form with a select structure.

A folder of segments, written through Spark's own committed writer so that lost executors leave no half files. One
segment holds documents that follow each other in key order:

| column | meaning |
|---|---|
| bucket, part | order of the segments |
| n_docs, n_tokens | sizes |
| keys | keys of the documents, 8 bytes each |
| ids | all ids, 2 bytes each (4 if the vocabulary needs it), little-endian |
| low, low_bits, high, samples | the ends of the documents: low bits packed, high bits unary, a sample for each 64th one |
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from riskloom.llm.common import bounds_of, bucket_of, mapped, partitions, shared_folder, table
from riskloom.llm.encoding import library_ids, load_tokenizer, slices

END = 0
SAMPLE = 64
SEGMENT = ("bucket int, part int, n_docs long, n_tokens long, keys binary, null_keys binary, id_bytes int, ids binary, "
           "low_bits int, low binary, high binary, samples binary")


class EliasFano:
    """A non-decreasing sequence of n values up to `top` in about 2 + log2(top / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)  # the i-th one stands at high part + i
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        first, last = at // 8, (at + self.low_bits + 7) // 8
        word = int.from_bytes(self.low[first:last].tobytes(), "little")
        return (word >> (at - 8 * first)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: the sample before it gives the place, at most 63 ones are counted from there."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, gone = at // 8, at % 8
        word = int(self.high[byte]) >> gone << gone
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i begins and ends, if the values are the ends of documents."""
        return self.select(i - 1) if i else 0, self.select(i)

    def all(self) -> np.ndarray:
        """Every value at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return ((ones - np.arange(self.n)) << self.low_bits) | low

    def columns(self) -> list:
        return [self.low_bits, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]


def bytes_for(path: str | None) -> int:
    """2 where every id of the vocabulary file fits, else 4."""
    return 2 if load_tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def packed(ids: np.ndarray, id_bytes: int) -> bytes:
    """Ids as little-endian bytes; an id that does not fit is an error."""
    if len(ids) and int(ids.max()) >> (8 * id_bytes):
        raise ValueError(f"id {int(ids.max())} does not fit {id_bytes} bytes")
    return ids.astype(f"<u{id_bytes}").tobytes()


def tokenised(docs: DataFrame, key: str, text: str, path: str | None, id_bytes: int) -> DataFrame:
    """(_key, _n, _ids): the ids of each text with the end id, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_ids(path)
        for batch in batches:
            for keys, texts in slices(batch.columns):
                ids = [np.append(x, END) for x in encoder.ids([t or "" for t in texts])]
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(
                    [packed(x, id_bytes) for x in ids], pa.binary())], ["_key", "_n", "_ids"])

    return docs.select(F.col(key).cast("long"), text).transform(mapped, run, "_key long, _n long, _ids binary")


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None,
          id_bytes: int | None = None, segment_tokens: int = 4_000_000) -> None:
    """Writes the token files of all texts in ascending key order.

    Texts are encoded where they are read; only ids are shuffled, once, to buckets that are quantile ranges of the
    key. A segment ends after segment_tokens ids, or after one document that is longer. Null texts are empty, so
    they hold the end id alone; null keys come first; equal keys follow each other in the order of their ids.
    Without id_bytes, the vocabulary's size decides.
    """
    spark = docs.sparkSession
    id_bytes = id_bytes or bytes_for(path)
    narrow = docs.select(F.col(key).cast("long").alias("_key"))
    bounds = bounds_of(narrow, "_key", 4 * partitions(spark))
    rows = tokenised(docs, key, text, path, id_bytes).withColumn("_bucket", bucket_of("_key", bounds))
    order = ["_bucket", F.col("_key").asc_nulls_first(), "_ids"]

    def segment(bucket: int, part: int, keys: list, counts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        ends = EliasFano.of(np.cumsum(np.array(counts, np.int64)))
        row = [bucket, part, len(keys), sum(counts), np.array([k or 0 for k in keys], "<i8").tobytes(),
               np.packbits([k is None for k in keys]).tobytes(), id_bytes, b"".join(blobs), *ends.columns()]
        return pa.RecordBatch.from_pylist([dict(zip(NAMES, row, strict=True))], ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, keys, counts, blobs, held = None, 0, [], [], [], 0
        for batch in batches:
            for rows_ in slices(batch.columns):
                for bucket, k, n, ids in zip(*rows_, strict=True):
                    if keys and (bucket != at or held + n > segment_tokens):
                        yield segment(at, part, keys, counts, blobs)
                        part, keys, counts, blobs, held = part + 1 if bucket == at else 0, [], [], [], 0
                    at, held = bucket, held + n
                    keys.append(k)
                    counts.append(n)
                    blobs.append(ids)
        if keys:
            yield segment(at, part, keys, counts, blobs)

    (rows.repartition(partitions(spark), "_bucket").sortWithinPartitions(*order)
     .select("_bucket", "_key", "_n", "_ids").transform(mapped, run, SEGMENT)
     .write.option("compression", "none").parquet(folder))


ARROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                   ("keys", pa.binary()), ("null_keys", pa.binary()), ("id_bytes", pa.int32()), ("ids", pa.binary()),
                   ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
NAMES = ARROW.names


def read(spark: SparkSession, folder: str, key: int | None = None) -> DataFrame:
    """(key, start, n_tokens, ids): the documents of a folder, start counted over all documents before.

    With a key, only the documents that have it; only their ends are then selected and only their ids are cut out.
    Segment sizes are summed in segment order: a row for each segment, read without the ids. These rows of three numbers
    are broadcast, so that the ids are not shuffled again.
    """
    segments = spark.read.schema(SEGMENT).parquet(folder)
    sizes = segments.select("bucket", "part", "n_tokens")
    # Buckets are few (four for each partition); parts of one bucket follow each other.
    by_bucket = sizes.groupBy("bucket").agg(F.sum("n_tokens").alias("_n"))
    earlier = W.unboundedPreceding, -1
    bucket_start = by_bucket.select("bucket", F.coalesce(F.sum("_n").over(
        W.orderBy("bucket").rowsBetween(*earlier)), F.lit(0)).alias("_bucket_start"))
    starts = sizes.join(bucket_start, "bucket").select("bucket", "part", (F.col("_bucket_start") + F.coalesce(
        F.sum("n_tokens").over(W.partitionBy("bucket").orderBy("part").rowsBetween(*earlier)), F.lit(0)))
        .alias("_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                ends = EliasFano(n, *[row[c] for c in ("low_bits", "low", "high", "samples")])
                null = np.unpackbits(np.frombuffer(row["null_keys"], np.uint8))[:n].astype(bool)
                keys = np.frombuffer(row["keys"], "<i8")
                chosen = range(n) if key is None else np.flatnonzero((keys == key) & ~null).tolist()
                places = [ends.bounds(i) for i in chosen]
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
                at = np.array(chosen, np.int64)
                yield pa.record_batch([
                    pa.array(keys[at], pa.int64(), mask=null[at]),
                    pa.array([a + row["_start"] for a, _ in places], pa.int64()),
                    pa.array([b - a for a, b in places], pa.int64()),
                    pa.array([ids[a:b].astype("<u4").tobytes() for a, b in places], pa.binary())],
                    ["key", "start", "n_tokens", "ids"])

    return segments.join(F.broadcast(starts), ["bucket", "part"]).drop("n_tokens").transform(mapped,
        run, "key long, start long, n_tokens long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder).select(F.col("key").alias("doc_id"), "start", "n_tokens",
                                      F.crc32("ids").alias("ids_crc32"))
