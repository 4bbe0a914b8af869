"""Helpers of this subpackage: tables at rest, ordered buckets, running sums without a global window."""
from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A temporary one is set only where none is named and the one JVM is local."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-checkpoint-"))
        found = sc.getCheckpointDir()
    return found


def at_rest(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends, lost executors cost nothing, no row is made twice."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this subpackage to the executors once, so that their workers import it and keep what they have loaded."""
    sc = spark.sparkContext
    if getattr(sc, "_riskloom_llm", False):
        return
    here = Path(__file__).parent
    packed = Path(tempfile.mkdtemp(prefix="riskloom-code-")) / "riskloom_llm.zip"  # read by the driver, which serves it
    with zipfile.ZipFile(packed, "w") as z:
        for f in [here.parent / "__init__.py", *sorted(here.glob("*.py"))]:
            z.write(f, f.relative_to(here.parent.parent))
    sc.addPyFile(str(packed))
    sc._riskloom_llm = True


def mapped(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow, with this subpackage at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row. Without it a lambda would compute it again for each element."""
    return F.transform(F.array(value), body)[0]


def bounds_of(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 ascending cuts of a whole-number column into about equal counts: one row comes to the driver."""
    if n < 2:
        return []
    row = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], F.lit(20 * n)).alias("b")).first()
    return sorted(set(row["b"] or []))


def bucket_of(column: str, bounds: Sequence[int]) -> Column:
    """How many bounds are at or below the value (null: 0), by binary search. Buckets ascend with the value."""
    if not bounds:
        return F.lit(0)
    n, x = len(bounds), F.col(column)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & (F.element_at(cuts, F.least(at + step, F.lit(n))) <= x), at + step).otherwise(at))
    return F.when(x.isNull(), F.lit(0)).otherwise(found)


def running(df: DataFrame, bucket: str, order: Sequence[Column], sums: dict[str, Column],
            keys: Sequence[str] = ()) -> DataFrame:
    """Adds, per key, the sums over all earlier rows: rows are ordered by bucket, then by `order` within a bucket.

    Windows hold one bucket of one key; a second window runs over the totals, one row for each key and bucket. So a
    key that owns a third of the rows is cut by its buckets. Give it a table at rest: it is read twice.
    """
    keys = list(keys)
    earlier = W.unboundedPreceding, -1
    inner = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(*earlier)
    across = W.partitionBy(*keys).orderBy(bucket).rowsBetween(*earlier)
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = totals.select(*keys, bucket, *[
        F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_b_{n}") for n in sums])
    out = df.withColumns({n: F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()})
    return (out.join(before, [*keys, bucket])
            .withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop(*[f"_b_{n}" for n in sums]))


def spare(name: str, taken: Sequence[str]) -> str:
    """A column name that the table does not have (Spark ignores case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name
