"""Running totals over a whole table without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readq.session import materialise


def prefix_sum(df: DataFrame, order: list[Column], weight: Column, name: str = "before") -> DataFrame:
    """Add the total weight of all rows that come earlier in the order.

    Rows are range partitioned and written; the totals of the partitions (one row each) give each partition its start,
    and the running total inside a partition is a window over that partition only. Ties in the order are put in an
    order of their own, any one. An empty table gives an empty one.
    """
    part, start, own = "__part", "__start", "__weight"
    ranged = df.withColumn(own, weight).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    rows = materialise(ranged, "ranged")
    totals = rows.groupBy(part).agg(F.sum(own).alias(start))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(part, F.coalesce(F.sum(start).over(ahead), F.lit(0)).alias(start))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(F.broadcast(starts), part)  # one row for each partition
        .withColumn(name, F.col(start) + F.coalesce(F.sum(own).over(inside), F.lit(0)))
        .drop(part, start, own)
    )
