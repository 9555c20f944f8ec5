"""Pace status per (budget_id, as_of): spend to date against the plan's day
targets, the pace ratio, severity, required reduction and day headroom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendpace.config import Thresholds

INF = float("inf")


def target_sums(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """Per check: today's target, targets through yesterday, targets after
    today. ``targets(budget_id, as_of date, day, target)`` of the plan in
    force (built for the check's date)."""
    t = targets.select("budget_id", F.col("as_of").alias("today"), "day", "target")
    j = keys.select("budget_id", "as_of", "today").join(t, ["budget_id", "today"], "left")
    s = j.groupBy("budget_id", "as_of").agg(
        F.sum(F.when(F.col("day") == F.col("today"), F.col("target"))).alias("day_target"),
        F.sum(F.when(F.col("day") < F.col("today"), F.col("target"))).alias("target_through_yesterday"),
        F.sum(F.when(F.col("day") > F.col("today"), F.col("target"))).alias("future_targets"))
    return s.select("budget_id", "as_of", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in
                                            ("day_target", "target_through_yesterday", "future_targets")])


def status(keys: DataFrame, plan: DataFrame, sums: DataFrame, fraction: DataFrame, fill: DataFrame,
           obs: DataFrame, forecasts: DataFrame, th: Thresholds) -> DataFrame:
    k = ["budget_id", "as_of"]
    p = plan.select("budget_id", F.col("as_of").alias("today"), "weekly_allowance")
    fc = forecasts.groupBy(*k).agg(F.sum("forecast_usd").alias("forecast_remaining_today"))
    j = (keys.select(*k, "today").join(p, ["budget_id", "today"], "inner")
         .join(sums, k, "left").join(fraction, k, "left").join(fill, k, "left")
         .join(obs, k, "left").join(fc, k, "left")
         .fillna(0.0, ["forecast_remaining_today", "lag_fill", "observed_week", "observed_today"]))
    spend_week = F.col("observed_week") + F.col("lag_fill")
    spend_today = F.col("observed_today") + F.col("lag_fill")
    j = (j.withColumn("spend_week_to_date", spend_week)
         .withColumn("spend_today", spend_today)
         .withColumn("expected_week_to_date",
                     F.col("target_through_yesterday") + F.col("day_target") * F.col("intraday_fraction")))
    exp, sw = F.col("expected_week_to_date"), F.col("spend_week_to_date")
    pace = F.when(exp > 0, sw / exp).when(sw == 0, F.lit(1.0)).otherwise(F.lit(INF))
    j = j.withColumn("pace_ratio", pace)
    fr, st, dt = F.col("forecast_remaining_today"), F.col("spend_today"), F.col("day_target")
    j = (j.withColumn("required_reduction_today", F.greatest(F.lit(0.0), st + fr - dt))
         .withColumn("projected_week_end",
                     sw + fr + F.col("future_targets") * F.least(F.col("pace_ratio"), F.lit(2.0)))
         .withColumn("day_headroom", F.greatest(F.lit(0.0), dt - st - fr)))
    pr = F.col("pace_ratio")
    sev = (F.when((sw >= F.col("weekly_allowance")) | (pr >= th.critical), F.lit("CRITICAL"))
           .when(pr >= th.throttle, F.lit("THROTTLE"))
           .when(pr >= th.ok, F.lit("WARN")).otherwise(F.lit("OK")))
    return j.withColumn("severity", sev).select(
        "budget_id", "as_of", "severity", "pace_ratio", "weekly_allowance", "spend_week_to_date",
        "expected_week_to_date", "day_target", "spend_today", "forecast_remaining_today",
        "required_reduction_today", "projected_week_end", "day_headroom", "intraday_fraction",
        "lag_fill", "observed_week", "observed_today")
