"""Distributed running positions: no group is numbered by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize


def running_sum(rows: DataFrame, group: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` (long) over the rows of the same group up to and with this one.

    Rows are dealt by range of (group, order), so a large group lies on many partitions. Each partition
    sums its own rows; what earlier partitions hold of the group is added afterwards, from one row a
    partition and group. Rows that tie in ``order`` need equal amounts or a tiebreak in ``order``.
    """
    part = f"{name}_part"
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    dealt = rows.withColumn(f"{name}_amount", amount.cast("long")).repartitionByRange(*keys).withColumn(part, F.spark_partition_id())
    inside = Window.partitionBy(part, *group).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = materialize(dealt.withColumn(f"{name}_here", F.sum(f"{name}_amount").over(inside)), "running")
    totals = local.groupBy(part, *group).agg(F.sum(f"{name}_amount").alias("total"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    other = {c: f"{name}_{c}" for c in [part, *group]}
    offset = totals.withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0)))
    offset = offset.select(F.col("offset").alias(f"{name}_offset"), *[F.col(c).alias(o) for c, o in other.items()])
    on = F.lit(True)
    for c, o in other.items():
        on = on & F.col(c).eqNullSafe(F.col(o))
    joined = local.join(offset, on, "left")
    kept = [c for c in rows.columns if c != name]
    return joined.select(*kept, (F.col(f"{name}_here") + F.coalesce(f"{name}_offset", F.lit(0))).alias(name))
