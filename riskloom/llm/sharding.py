"""Contiguous shards of equal bytes from global prefix sums of document sizes. DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm.common import at_rest, bounds_of, bucket_of, partitions, running, table


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot): runs of the key order, cut at equal byte targets.

    Only (key, size, crc) are shuffled, never the texts. The key order is cut into buckets by its quantiles; the
    buckets' totals give every document the bytes before it, and the target its middle byte falls into is its shard.
    slot counts from 0 within the shard.

    A null text has no bytes and size 1. A null key sorts first; equal keys sort by checksum, then size, and rows
    equal in all three may trade places. An empty table gives no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("long").alias("size"),
                         F.crc32(body.cast("binary")).alias("text_crc32"))
    bounds = bounds_of(docs.select(F.col(key).alias("_key")), "_key", 4 * partitions(spark))
    rows = at_rest(narrow.withColumn("_bucket", bucket_of("_key", bounds)), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 1
    order = [F.col("_key").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    placed = running(rows, "_bucket", order, {"_start": F.col("size"), "_row": F.lit(1).cast("long")})
    middle = 2 * F.col("_start") + F.col("size")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr("0").cast("int") + F.floor(
        middle.cast("decimal(38,0)") * shards / F.lit(2 * total).cast("decimal(38,0)")).cast("int")))
    placed = at_rest(placed.select("_key", "size", "text_crc32", "shard", "_row"), "placed")
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("_row").alias("_first")))  # a row for each shard
    return placed.join(firsts, "shard").select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
