"""Tables on shared storage: <warehouse>/<layer>/<table> as parquet."""
from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _current(spark: SparkSession, path: str) -> str | None:
    """The folder that the table's pointer names."""
    fs, pointer = _fs(spark, f"{path}/current")
    return spark.read.text(f"{path}/current").first()["value"] if fs.exists(pointer) else None


def write(df: DataFrame, warehouse: str, layer: str, table: str) -> DataFrame:
    """Replace a table and go on from the written copy, so later steps neither recompute nor lose it.

    The new version is written beside the old one; then the pointer, a file of one line, is replaced by a rename. A
    reader finds a whole version at any time, and a failed write changes nothing.
    """
    spark, path, version = df.sparkSession, f"{warehouse}/{layer}/{table}", f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm = spark.sparkContext._jvm
    fs, new = _fs(spark, f"{path}/new-{version}")
    stream = fs.create(new)
    stream.write(bytearray(version.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
                                                        ).rename(new, _fs(spark, f"{path}/current")[1], options)
    return spark.read.schema(df.schema).parquet(f"{path}/{version}")


def write_all(tables: Mapping[str, DataFrame], warehouse: str, layer: str) -> dict[str, DataFrame]:
    return {name: write(df, warehouse, layer, name) for name, df in tables.items()}


def put(df: DataFrame, warehouse: str, layer: str, table: str, batch: str) -> None:
    """One batch of an append-only table. Written again, the same batch replaces itself: retries add nothing."""
    df.write.mode("overwrite").parquet(f"{warehouse}/{layer}/{table}/batch={batch}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop)


def read(spark: SparkSession, warehouse: str, layer: str, table: str, schema: str | None = None) -> DataFrame:
    """The table: its current version, or all its batches; an empty one of the given schema before the first write."""
    path = f"{warehouse}/{layer}/{table}"
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    version = _current(spark, path)
    found = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/{version}" if version else path)
    return found.select([c.split()[0] for c in schema.split(", ")]) if schema else found
