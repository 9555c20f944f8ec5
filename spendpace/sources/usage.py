"""Metered usage priced by time-ranged list prices.

``usage``: budget_id, usage_start_time (timestamp), sku_name, cloud,
usage_quantity, billing_origin_product, usage_metadata struct<job_id,
warehouse_id, cluster_id>.
``prices``: sku_name, cloud, currency_code, price_start_time, price_end_time
(NULL = open), pricing struct<effective_list struct<default>>.

The price join has equality keys (sku, cloud), so it plans as a hash join
with the validity interval as a residual condition; the price list is a
small catalogue that Spark broadcasts by its measured size.

Dollars stay exact: a row is quantity times price at 21 places, and no sum is
rounded here. Amounts far below a cent count, however many rows they come in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendpace.functions.tags import QUANTITY, UNIT_PRICE, USAGE_MONEY, exact_amount

USAGE_HOURLY_COLUMNS = ["budget_id", "hour_start", "compute_type", "workload_type", "workload_id", "dbu_dollars"]


def priced_usage(usage: DataFrame, prices: DataFrame, start=None, end=None) -> DataFrame:
    """Usage rows in ``[start, end)`` with their USD list price. Unpriced
    usage is dropped (inner join); overlapping price rows each match."""
    u = usage
    if start is not None:
        u = u.filter(F.col("usage_start_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        u = u.filter(F.col("usage_start_time") < F.lit(end).cast("timestamp"))
    p = (prices.filter(F.col("currency_code") == "USD")
         .select(F.col("sku_name").alias("p_sku"), F.col("cloud").alias("p_cloud"),
                 F.col("price_start_time").alias("p_start"), F.col("price_end_time").alias("p_end"),
                 exact_amount(F.col("pricing.effective_list.default"), UNIT_PRICE).alias("list_price")))
    cond = ((u["sku_name"] == p["p_sku"]) & (u["cloud"] == p["p_cloud"])
            & (u["usage_start_time"] >= p["p_start"])
            & (p["p_end"].isNull() | (u["usage_start_time"] < p["p_end"])))
    return u.join(p, cond, "inner").withColumn(
        "dbu_dollars", (exact_amount(F.col("usage_quantity"), QUANTITY) * F.col("list_price")).cast(USAGE_MONEY))


def classify(priced: DataFrame) -> DataFrame:
    """Workload type and id from the first non-empty id: JOB > WAREHOUSE >
    CLUSTER > OTHER (id '' for OTHER)."""
    job = F.coalesce(F.col("usage_metadata.job_id").cast("string"), F.lit(""))
    wh = F.coalesce(F.col("usage_metadata.warehouse_id").cast("string"), F.lit(""))
    cl = F.coalesce(F.col("usage_metadata.cluster_id").cast("string"), F.lit(""))
    wtype = (F.when(F.length(job) > 0, F.lit("JOB"))
             .when(F.length(wh) > 0, F.lit("WAREHOUSE"))
             .when(F.length(cl) > 0, F.lit("CLUSTER"))
             .otherwise(F.lit("OTHER")))
    wid = (F.when(F.length(job) > 0, job).when(F.length(wh) > 0, wh)
           .when(F.length(cl) > 0, cl).otherwise(F.lit("")))
    return priced.withColumn("workload_type", wtype).withColumn("workload_id", wid)


def hourly_usage(usage: DataFrame, prices: DataFrame, start=None, end=None) -> DataFrame:
    """Hourly usage dollars by (budget, hour, compute type, workload).

    Classification happens before the one aggregation (sums associate), and
    groups with a NULL hour or compute type are dropped.
    """
    priced = classify(priced_usage(usage, prices, start, end))
    return (priced
            .withColumn("hour_start", F.date_trunc("hour", "usage_start_time"))
            .withColumn("compute_type", F.col("billing_origin_product").cast("string"))
            .filter(F.col("hour_start").isNotNull() & F.col("compute_type").isNotNull())
            .groupBy("budget_id", "hour_start", "compute_type", "workload_type", "workload_id")
            .agg(F.sum("dbu_dollars").cast(USAGE_MONEY).alias("dbu_dollars")))


def daily_usage(usage: DataFrame, prices: DataFrame, start=None, end=None) -> DataFrame:
    """Usage dollars per (budget, UTC day)."""
    priced = priced_usage(usage, prices, start, end)
    return (priced.withColumn("usage_date", F.to_date("usage_start_time"))
            .groupBy("budget_id", "usage_date")
            .agg(F.sum("dbu_dollars").cast(USAGE_MONEY).alias("dbu_dollars")))


def unpriced_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Quality count of usage rows no USD price covers (they are dropped)."""
    p = (prices.filter(F.col("currency_code") == "USD")
         .select(F.col("sku_name").alias("p_sku"), F.col("cloud").alias("p_cloud"),
                 F.col("price_start_time").alias("p_start"), F.col("price_end_time").alias("p_end")))
    cond = ((usage["sku_name"] == p["p_sku"]) & (usage["cloud"] == p["p_cloud"])
            & (usage["usage_start_time"] >= p["p_start"])
            & (p["p_end"].isNull() | (usage["usage_start_time"] < p["p_end"])))
    return (usage.join(p, cond, "left_anti").groupBy("budget_id")
            .agg(F.count(F.lit(1)).alias("unpriced_rows")))
