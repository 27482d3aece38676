"""Distributed ordering without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.
Instead the (pre-aggregated) keys are range-partitioned into B buckets,
written once (``lineage.materialize``) so that every consumer sees the same
buckets, and each row's
position is the weight of all earlier buckets (a B-row table) plus a window
*inside* its bucket. Equal keys always land in the same bucket, so ties are
never split; the result does not depend on B.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightjar.operators.lineage import materialize

BUCKET = "_bucket"


def default_buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))


def checkpointed(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage: write under the session's checkpoint dir and read back."""
    return materialize(df, label)


def range_buckets(df: DataFrame, order: Sequence[Column], num_buckets: int | None = None) -> DataFrame:
    """Keys with their range bucket, written once so every consumer sees the same buckets."""
    b = num_buckets or default_buckets(df)
    return checkpointed(df.repartitionByRange(b, *order).withColumn(BUCKET, F.spark_partition_id()), "buckets")


def rows_before(bucketed: DataFrame, order: Sequence[Column], weights: Sequence[str],
                groups: Sequence[str] = ()) -> DataFrame:
    """Add ``_before_<w>``: summed weight of rows strictly earlier in the global order.

    ``groups`` restarts the count per group; the range partitioning must
    then be ordered by the group columns first.
    """
    grp = [F.col(g) for g in groups]
    totals = bucketed.groupBy(BUCKET, *groups).agg(*[F.sum(w).alias(f"_bt_{w}") for w in weights])
    prior = Window.partitionBy(*grp).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(BUCKET, *groups, *[
        F.coalesce(F.sum(f"_bt_{w}").over(prior), F.lit(0)).alias(f"_off_{w}") for w in weights])
    # offsets has at most B x |groups| rows: a bounded broadcast.
    joined = bucketed.join(F.broadcast(offsets), on=[BUCKET, *groups], how="inner")
    inside = Window.partitionBy(BUCKET, *grp).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select("*", *[
        (F.col(f"_off_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"_before_{w}")
        for w in weights]).drop(*[f"_off_{w}" for w in weights])


def row_positions(df: DataFrame, order: Sequence[Column], num_buckets: int | None = None) -> DataFrame:
    """Add ``position`` (1-based row number in the global order); keys should be unique."""
    bucketed = range_buckets(df.withColumn("_one", F.lit(1)), order, num_buckets)
    out = rows_before(bucketed, order, ["_one"])
    return out.withColumn("position", F.col("_before__one") + 1).drop("_one", "_before__one", BUCKET)


def average_ranks(keys: DataFrame, value: str, count: str, groups: Sequence[str] = (),
                  num_buckets: int | None = None) -> DataFrame:
    """Tie-averaged rank of distinct ``value`` per group, given each key's row ``count``.

    ``keys`` must already be distinct on (groups, value).
    """
    order = [F.col(g) for g in groups] + [F.col(value)]
    bucketed = range_buckets(keys, order, num_buckets)
    out = rows_before(bucketed, order, [count], groups)
    return out.withColumn(
        "avg_rank", F.col(f"_before_{count}") + (F.col(count) + F.lit(1.0)) / F.lit(2.0)
    ).drop(f"_before_{count}", BUCKET)
