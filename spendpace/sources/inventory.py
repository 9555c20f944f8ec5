"""Workspace inventory snapshots: jobs, warehouses, all-purpose clusters.

Inputs are snapshot tables keyed by ``budget_id``:
``jobs_raw(budget_id, job_id, name, tags map, schedule struct<pause_status>)``,
``warehouses_raw(budget_id, id, name, cluster_size, auto_stop_mins,
max_num_clusters, state, custom_tags array<struct<key,value>>)``,
``clusters_raw(budget_id, cluster_id, cluster_name, state, cluster_source,
custom_tags map, last_activity_time bigint epoch ms)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendpace.functions.tags import priority_from_tags


def _falsy_default(c: Column, default: Column) -> Column:
    """``c or default`` for text (NULL and '' fall back)."""
    return F.when(c.isNull() | (c.cast("string") == ""), default).otherwise(c)


def _falsy_int(c: Column, default: int) -> Column:
    """``c or default`` for numbers (NULL and 0 fall back)."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c).cast("int")


def _dedup_entries(entries: Column) -> Column:
    """Keep the last entry of each key, so a map can be built without the
    duplicate-key error."""
    return F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
        lambda x: x["key"] == e["key"]))


def jobs(jobs_raw: DataFrame, tag_key: str) -> DataFrame:
    job_id = F.col("job_id").cast("string")
    return jobs_raw.select(
        "budget_id",
        job_id.alias("job_id"),
        _falsy_default(F.col("name"), F.concat(F.lit("job-"), job_id)).alias("name"),
        F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>")).alias("tags"),
        F.col("schedule").isNotNull().alias("has_schedule"),
        F.coalesce(F.col("schedule.pause_status") == "PAUSED", F.lit(False)).alias("schedule_paused"),
    ).withColumn("priority", priority_from_tags(F.col("tags"), tag_key))


def warehouses(warehouses_raw: DataFrame, tag_key: str) -> DataFrame:
    wid = F.col("id").cast("string")
    entries = F.coalesce(F.col("custom_tags"), F.array().cast("array<struct<key:string,value:string>>"))
    return warehouses_raw.select(
        "budget_id",
        wid.alias("warehouse_id"),
        _falsy_default(F.col("name"), wid).alias("name"),
        _falsy_default(F.col("cluster_size"), F.lit("X-Small")).alias("cluster_size"),
        F.coalesce(F.col("auto_stop_mins"), F.lit(0)).cast("int").alias("auto_stop_mins"),
        _falsy_int(F.col("max_num_clusters"), 1).alias("max_num_clusters"),
        F.col("state").cast("string").alias("state"),
        F.map_from_entries(_dedup_entries(entries)).alias("tags"),
    ).withColumn("priority", priority_from_tags(F.col("tags"), tag_key))


def clusters(clusters_raw: DataFrame, tag_key: str) -> DataFrame:
    cid = F.col("cluster_id").cast("string")
    return (clusters_raw
            .filter(~F.coalesce(F.col("cluster_source") == "JOB", F.lit(False)))
            .select(
                "budget_id",
                cid.alias("cluster_id"),
                _falsy_default(F.col("cluster_name"), cid).alias("name"),
                F.col("state").cast("string").alias("state"),
                F.coalesce(F.col("custom_tags"), F.create_map().cast("map<string,string>")).alias("tags"),
                F.col("last_activity_time").cast("bigint").alias("last_activity_time"),
            ).withColumn("priority", priority_from_tags(F.col("tags"), tag_key)))


def workload_meta(jobs_df: DataFrame, warehouses_df: DataFrame, clusters_df: DataFrame) -> DataFrame:
    """(budget_id, workload_type, workload_id) -> (name, priority)."""
    def proj(df, wtype, id_col):
        return df.select("budget_id", F.lit(wtype).alias("workload_type"),
                         F.col(id_col).alias("workload_id"), "name", "priority")
    return (proj(jobs_df, "JOB", "job_id")
            .unionByName(proj(warehouses_df, "WAREHOUSE", "warehouse_id"))
            .unionByName(proj(clusters_df, "CLUSTER", "cluster_id")))


def inventory_summary(jobs_df: DataFrame, warehouses_df: DataFrame, clusters_df: DataFrame) -> DataFrame:
    """Counts per budget: jobs (scheduled, paused), warehouses, clusters."""
    j = jobs_df.groupBy("budget_id").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if("has_schedule").alias("scheduled_jobs"),
        F.count_if("schedule_paused").alias("paused_jobs"))
    w = warehouses_df.groupBy("budget_id").agg(F.count(F.lit(1)).alias("warehouses"))
    c = clusters_df.groupBy("budget_id").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(F.col("state") == "RUNNING").alias("running_clusters"))
    out = j.join(w, "budget_id", "full").join(c, "budget_id", "full")
    return out.select("budget_id", *[F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x) for x in
                                     ["jobs", "scheduled_jobs", "paused_jobs", "warehouses",
                                      "clusters", "running_clusters"]])
