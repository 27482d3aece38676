"""Cutting lineage: intermediate tables written under ``spark.checkpoint.dir``.

A reused intermediate (prepared training rows, fold table, medians, OOF
predictions, range buckets) is written once as Parquet into the shared
checkpoint folder and read back. Compared with ``RDD.checkpoint`` this
computes the input once (no second pass for the write), stores columns
compressed, lets later scans prune columns, gives AQE exact sizes, and
survives the loss of any executor.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.session import ensure_checkpoint_dir


def table_path(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/nightjar/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


class Tables:
    """Owner of the intermediate tables of one computation; deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, {}, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = table_path(self.spark, label)
        df.write.mode("error").parquet(path)
        table = self.spark.read.parquet(path)
        self.paths[id(table)] = path, table
        return table

    def write_bucketed(self, df: DataFrame, label: str, *keys: str) -> DataFrame:
        """Kept as it is dealt out by the keys, so that a later join on them shuffles only the other side."""
        path = table_path(self.spark, label)
        name = f"nightjar_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.mode("error").format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
        table = self.spark.table(name)
        self.paths[id(table)], self.names[id(table)] = (path, table), name
        return table

    def drop(self, *tables: DataFrame) -> None:
        """The caller has no use for these any more, nor for any plan that reads them."""
        for table in tables:
            path, _ = self.paths.pop(id(table))
            if id(table) in self.names:
                self.spark.sql(f"DROP TABLE {self.names.pop(id(table))}")
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        # Spark deletes the shuffle files of plans that are no longer referred to, on either side, at a collection.
        gc.collect()
        self.spark._jvm.System.gc()

    def drop_all(self) -> None:
        self.drop(*[table for _, table in self.paths.values()])

    @contextmanager
    def dropped_at_end(self) -> Iterator[Tables]:
        """For tables that nothing reads after a block, whether it ends well or not."""
        try:
            yield self
        finally:
            self.drop_all()


def filter_derived(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns derived by a long projection chain.

    A plain filter is pushed below the projections with every alias
    replaced by its definition; definitions that use an input twice make the
    pushed condition grow with each layer and it is evaluated on top of the
    projections themselves. Pairing the condition with a trivially true,
    non-deterministic term keeps it above the projection that computes it,
    so it reads the already computed column.
    """
    keep = condition & (F.spark_partition_id() >= 0)
    return df.withColumn("__keep", keep).filter(F.col("__keep")).drop("__keep")
