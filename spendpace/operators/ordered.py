"""Positions and running sums over a long order, without a task that holds a
whole group.

A window over a group sorts all of its rows in one task. Here rows are first
range-partitioned on the group and the order and stored with the number of
their range; one small aggregate gives each range of a group its count and
sums, a window over those (one row per range) the offsets, and only the rows of
one range are sorted together. AQE merges small ranges, so a small table is one
range. The stored table fixes the ranges: a task that runs again reads the same
numbers.

Rows equal in the whole order lie in one range, in no defined order. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendpace.session import materialize


def running(df: DataFrame, keys: list[str], order: list[Column], position: str,
            sums: dict[str, Column] | None = None, stop: Column | None = None) -> DataFrame:
    """``df`` with ``position`` (1 for a group's first row) and, for each of
    ``sums``, the sum over the group's earlier rows (0 for the first).

    ``stop``, over the columns of ``df`` and ``sums``, drops whole ranges: it
    is asked with the sums before a range, and must stay true once it is.
    """
    sums = sums or {}
    ranged = materialize(df.select("*", *[c.alias(f"{n}_value") for n, c in sums.items()])
                         .repartitionByRange(*keys, *order).withColumn("range", F.spark_partition_id()))
    per_range = ranged.groupBy(*keys, "range").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(f"{n}_value").alias(f"{n}_total") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)

    def before(total: str) -> Column:
        return F.coalesce(F.sum(total).over(earlier), F.lit(0))

    offsets = per_range.select(*keys, "range", before("rows").alias("rows_before"),
                               *[before(f"{n}_total").alias(n) for n in sums])
    rows = ranged.join(offsets, [*keys, "range"], "inner")
    if stop is not None:
        rows = rows.filter(~F.coalesce(stop, F.lit(False)))
    inside = Window.partitionBy(*keys, "range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = [(F.col(n) + F.coalesce(F.sum(f"{n}_value").over(upto), F.lit(0))).alias(n) for n in sums]
    return rows.select(*df.columns, (F.col("rows_before") + F.row_number().over(inside)).cast("int").alias(position), *out)
