"""State between runs as tables: versioned plans, calibrations, active
actions and queues, plus an append-only audit log.

Every write adds or replaces one ``as_of`` partition (dynamic partition
overwrite), so a retried job rewrites only its own version. Readers meet the
version in force by date, in an equi-join.
Retention is by partition date instead of an entry cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendpace.operators.forecast import stored_overrides


def write_version(df: DataFrame, path: str, version_col: str = "as_of") -> None:
    """Add (or replace) the versions present in ``df`` under ``path``."""
    (df.withColumn("version", F.col(version_col).cast("string"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version").parquet(path))


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All stored versions; they may carry different columns (merged by name)."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop("version")


def plan_in_force(plans: DataFrame, checks: DataFrame) -> DataFrame:
    """For each check (budget_id, as_of timestamp): the latest stored plan
    built on or before the check's date whose budget week holds that date.
    Checks without one get no row (the caller builds a plan for them)."""
    # a plan holds for the days of its week from its own on: a week's dates at
    # most, so each version becomes its days and meets checks by equi-join
    rest = [c for c in plans.columns if c not in ("budget_id", "as_of")]
    first = F.greatest("as_of", "week_start")
    days = (plans.filter(first < F.col("week_end"))
            .select("budget_id", F.explode(F.sequence(first, F.date_sub("week_end", 1))).alias("check_date"),
                    F.struct(F.col("as_of").alias("plan_as_of"), "week_start", "week_end",
                             *[c for c in rest if c not in ("week_start", "week_end")]).alias("plan"))
            .groupBy("budget_id", "check_date").agg(F.max_by("plan", "plan.plan_as_of").alias("plan")))
    c = checks.select("budget_id", "as_of", F.to_date("as_of").alias("check_date"))
    return c.join(days, ["budget_id", "check_date"], "inner").select("budget_id", "as_of", "plan.*")


def with_overrides(calibration: DataFrame, overrides: DataFrame) -> DataFrame:
    """A calibration with the overrides set for its budgets (``overrides``:
    budget_id, compute_type, multiplier, set_seq; of several for a compute type
    the one of the largest ``set_seq`` counts), as one map per budget. A
    missing type or multiplier sets nothing."""
    last = (overrides.where("compute_type is not null and multiplier is not null").groupBy("budget_id", "compute_type")
            .agg(F.max_by(F.col("multiplier").cast("double"), "set_seq").alias("multiplier")))
    maps = last.groupBy("budget_id").agg(F.map_from_entries(F.collect_list(F.struct("compute_type", "multiplier"))).alias("overrides"))
    return calibration.drop("overrides").join(maps, "budget_id", "left")


def calibration_in_force(stored: DataFrame | None, checks: DataFrame, default_multiplier: float) -> DataFrame:
    """Latest stored calibration on or before each check's date, with the
    overrides stored beside it, else the configured default (window 0)."""
    c = checks.select("budget_id", "as_of").withColumn("check_date", F.to_date("as_of"))
    if stored is None:
        return c.select("budget_id", "as_of", F.lit(default_multiplier).alias("global_multiplier"),
                        F.lit(0).alias("window_days"), F.lit(None).cast("date").alias("calibrated_on"),
                        F.lit(None).cast("map<string,double>").alias("overrides"))
    # one row for each date with a version or a check (a calendar's dates at
    # most, whatever the number of versions and checks), then the last version
    # up to it; checks read their date's by equi-join
    version = F.struct(F.col("as_of").alias("calibrated_on"), "global_multiplier", "window_days", stored_overrides(stored))
    versions = stored.select("budget_id", F.to_date("as_of").alias("check_date"), F.col("as_of").alias("at"), version.alias("version"))
    asked = c.select("budget_id", "check_date").distinct()
    dates = (versions.unionByName(asked, allowMissingColumns=True).groupBy("budget_id", "check_date")
             .agg(F.max_by("version", "at").alias("version")))
    upto = Window.partitionBy("budget_id").orderBy("check_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dates = dates.select("budget_id", "check_date", F.last("version", ignorenulls=True).over(upto).alias("version"))
    out = c.join(dates, ["budget_id", "check_date"], "left")
    return out.select("budget_id", "as_of",
                      F.coalesce("version.global_multiplier", F.lit(default_multiplier)).alias("global_multiplier"),
                      F.coalesce("version.window_days", F.lit(0)).alias("window_days"),
                      F.col("version.calibrated_on").alias("calibrated_on"), F.col("version.overrides").alias("overrides"))


def audit_events(plan: DataFrame | None = None, calibration: DataFrame | None = None,
                 status: DataFrame | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Audit rows (budget_id, event_at, event, fields...) for plan and check runs."""
    parts = []
    if plan is not None:
        p = plan.select("budget_id", F.col("as_of").cast("timestamp").alias("event_at"), F.lit("plan").alias("event"),
                        "week_start", "weekly_allowance")
        if calibration is not None:
            p = p.join(calibration.select("budget_id", F.col("as_of").cast("timestamp").alias("event_at"),
                                          "global_multiplier"), ["budget_id", "event_at"], "left")
        parts.append(p)
    if status is not None:
        s = status.select("budget_id", F.col("as_of").alias("event_at"), F.lit("check").alias("event"), "severity",
                          "pace_ratio", "required_reduction_today")
        if summary is not None:
            s = s.join(summary.select("budget_id", F.col("as_of").alias("event_at"), "actions",
                                      "total_estimated_savings"), ["budget_id", "event_at"], "left")
        parts.append(s)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("event_date", F.to_date("event_at"))


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").partitionBy("event_date").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit log; appends may carry different fields (merged by name)."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def audit_tail(audit: DataFrame, n: int) -> DataFrame:
    """Last ``n`` audit entries per budget (a top-k per group)."""
    w = Window.partitionBy("budget_id").orderBy(F.col("event_at").desc(), F.col("event").desc())
    return audit.withColumn("recent_rank", F.row_number().over(w)).filter(F.col("recent_rank") <= n)
