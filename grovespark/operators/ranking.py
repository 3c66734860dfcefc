"""Numbers along a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows up to this one, in an order that tells all rows apart.

    Rows are dealt to partitions by ranges of the order and summed within each;
    what the partitions before hold is added, one number a partition.
    """
    from grovespark.plans.state import cut

    parted = cut(rows.repartitionByRange(*order).withColumns({"part_": F.spark_partition_id(), "value_": value.cast("long")}))
    sums = parted.groupBy("part_").agg(F.sum("value_").alias("sum_"))
    # one row a partition
    before = sums.select("part_", F.coalesce(F.sum("sum_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    within = F.sum("value_").over(Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parted.withColumn(name, within).join(F.broadcast(before), "part_").withColumn(name, F.col(name) + F.col("before_")).drop("part_", "value_", "before_")
