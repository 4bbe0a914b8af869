"""Joins, numbering and ranking that hold when one key owns a large part of the rows."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A temporary one only where none is named and one local JVM does everything."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        found = tempfile.mkdtemp(prefix="riskloom-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def at_rest(df: DataFrame, name: str) -> DataFrame:
    """df written once to the session's shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of one key that meet in one task, from either side of a join.
BLOCK = 20_000


def grid(left: DataFrame, right: DataFrame, on: Sequence[str], left_by: Sequence[str], right_by: Sequence[str],
         block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides of an inner equi-join with the cells (_i, _j) that their rows meet in, `block` rows of either side.

    Both sides' counts per key join them, so nothing is decided at plan time; a key that fits a block on both sides is
    one cell. Rows take their row or column of the grid by the hash of left_by / right_by, and are repeated across it.
    """
    on = list(on)
    n = lambda df, c: df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(c))
    cells = n(left, "_rows").join(n(right, "_columns"), on)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda by, c: F.pmod(F.xxhash64(*by), F.col(c)).cast("int")
    a = left.join(cells, on).withColumn("_i", place(left_by, "_rows")).withColumn("_j", every("_columns"))
    b = right.join(cells, on).withColumn("_j", place(right_by, "_columns")).withColumn("_i", every("_rows"))
    return a.drop("_rows", "_columns"), b.drop("_rows", "_columns")


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_by: Sequence[str], right_by: Sequence[str],
              block: int = BLOCK) -> DataFrame:
    """Inner equi-join whose hot keys are cut on both sides: a grid of cells, each with `block` rows of either side.

    Cells are dealt over all tasks by count: few rows that make many would otherwise be put together in one task.
    """
    cell = [*on, "_i", "_j"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    a, b = (side.repartition(tasks, *cell) for side in grid(left, right, on, left_by, right_by, block))
    return a.join(b, cell).drop("_i", "_j")


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                salts: int = 16) -> DataFrame:
    """Inner equi-join on a key with few values (a country): every key is hot, so every key is cut by `salts`.

    `small` is repeated per salt; Spark broadcasts it instead whenever its size allows.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def number_within(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """row_number() per key, in one lazy plan: rows are numbered within (key, first order column), and the numbers
    before come from a window over those groups' counts. So a key with very many rows is cut by its first order
    column, whatever its size. Null order values come first."""
    key, first = list(key), order[0]
    inner = W.partitionBy(*key, first).orderBy(*[F.col(c) for c in order[1:]] or [F.lit(0)])
    before = W.partitionBy(*key).orderBy(F.col(first)).rowsBetween(W.unboundedPreceding, -1)
    groups = df.groupBy(*key, first).agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*key, first])],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for i, c in enumerate([*key, first]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return (df.withColumn("_row", F.row_number().over(inner)).join(groups, same)
            .withColumn(name, (F.col("_row") + F.col("_before")).cast("int")).select(*df.columns, name))


DIGIT_BITS = 21


def rows_below(df: DataFrame, value: str) -> DataFrame:
    """For each distinct long `value`: how many rows hold a smaller one (`below`), and how many it (`n`).

    Exact global ranking without a global window: counts are summed digit by digit (three 21-bit digits), so each
    window partition holds at most two million rows, whatever the number of rows or ties.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    shifts = (42, 21, 0)
    parent = None
    for shift in shifts:
        prefix = f"_p{shift}"
        up = f"_p{shift + DIGIT_BITS}"
        if shift:
            level = counts.groupBy(F.shiftright(F.col(value), shift).alias(prefix)).agg(F.sum("n").alias("n"))
        else:
            level = counts.withColumnRenamed(value, prefix)
        level = level.withColumn(up, F.shiftright(F.col(prefix), DIGIT_BITS) if parent is not None else F.lit(0))
        before = W.partitionBy(up).orderBy(prefix).rowsBetween(W.unboundedPreceding, -1)
        level = level.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
        if parent is not None:
            level = (level.join(parent, up)
                     .withColumn("below", F.col("below") + F.col("_base")).drop("_base"))
        parent = level.select(F.col(prefix), F.col("below").alias("_base")) if shift else None
        counts_at = level
    return counts_at.select(F.col("_p0").alias(value), "n", "below")
