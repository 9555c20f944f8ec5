"""Weekly plan: FY-to-date spend, day-of-week profile, allowance, day targets.

Every operator is keyed by (budget_id, as_of): one call plans one budget
today, a fleet, or every week of a past year. Windows over the ledger are
taken by exploding each key's window into its dates and equi-joining the
daily ledger on (budget_id, date): the exploded side is bounded by keys x
window length, the ledger is daily grain, and the join partitions on both
columns, so a budget with a huge history does not land in one task.
Distinct keys are computed once: instants in the same week share their
FY-to-date and profile rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendpace.functions import fiscal
from spendpace.functions.tags import MONEY, usage_double
from spendpace.operators.ledger import blended_cost


def _ledger_keys(ledger: DataFrame) -> list[str]:
    """What a ledger's costs depend on beside the date: the budget, for daily
    blended rows the fiscal year also (usage counts from its start), and for a
    ledger of one instant the instant."""
    if "usage_cost" in ledger.columns:
        return ["budget_id", "fy_start"]
    return ["budget_id", "as_of"] if "as_of" in ledger.columns else ["budget_id"]


def _costs(dates: DataFrame, ledger: DataFrame, how: str = "inner") -> DataFrame:
    """``dates`` (ledger keys, usage_date, ...) with the ledger's ``cost``; only
    dates before the instant are asked for, so all their usage is known."""
    if "usage_cost" not in ledger.columns:
        lk = _ledger_keys(ledger)
        return dates.join(ledger.select(*lk, "usage_date", "cost"), lk + ["usage_date"], how)
    rows = dates.join(ledger.select("budget_id", "usage_date", "cost", "usage_cost"), ["budget_id", "usage_date"], how)
    rows = rows.withColumn("cost", blended_cost(F.col("usage_date") >= F.col("fy_start"))).drop("usage_cost")
    return rows.filter("cost is not null") if how == "inner" else rows


def plan_keys(instants: DataFrame) -> DataFrame:
    """``instants(budget_id, as_of date, annual_budget, fy_start_month,
    fy_start_day, week_start_weekday)`` + every calendar fact of as_of."""
    d = F.col("as_of")
    cols = fiscal.calendar_columns(d)
    return instants.select("budget_id", "as_of", "annual_budget", "fy_start_month",
                           "fy_start_day", "week_start_weekday",
                           *[c.alias(n) for n, c in cols.items()])


def _window_join(keys: DataFrame, key_cols: list[str], start: str, end: str,
                 ledger: DataFrame) -> DataFrame:
    """Ledger rows of each key whose date lies in ``[start, end)``."""
    lk = _ledger_keys(ledger)
    sel = list(dict.fromkeys(key_cols + [c for c in lk if c not in key_cols]))
    exploded = keys.select(*sel, F.explode(fiscal.week_dates(F.col(start), F.col(end))).alias("usage_date"))
    return _costs(exploded, ledger)


def fy_to_date(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """Spend in ``[fy_start, week_start)``; unreported days count 0.

    One running total per (ledger key, fiscal year) over the dates up to
    the last week start asked for (at most a year of daily rows), read at
    the day before each week start by equi-join: every week of a fleet
    history shares it, instead of re-summing the year to date per week.
    """
    lk = _ledger_keys(ledger)
    kc = list(dict.fromkeys(lk + ["fy_start", "week_start"]))
    fy = list(dict.fromkeys(lk + ["fy_start"]))
    distinct_keys = keys.select(*kc).distinct()
    span = distinct_keys.groupBy(*fy).agg(F.max("week_start").alias("last_week_start"))
    dates = span.select(*fy, F.explode(fiscal.week_dates(F.col("fy_start"), F.col("last_week_start")))
                        .alias("usage_date"))
    # dense dates (unreported days are NULL), so the day before every week
    # start has a running total to read
    daily = _costs(dates, ledger, "left")
    upto = Window.partitionBy(*fy).orderBy("usage_date").rowsBetween(Window.unboundedPreceding,
                                                                      Window.currentRow)
    running = daily.select(*fy, F.col("usage_date").alias("day_before"), F.sum("cost").over(upto).alias("fytd"))
    latest = (distinct_keys.withColumn("day_before", F.date_sub("week_start", 1))
              .join(running, fy + ["day_before"], "inner").select(*kc, "fytd"))
    return (distinct_keys.join(latest, kc, "left")
            .select(*kc, F.coalesce(F.col("fytd"), F.lit(0)).cast(MONEY).alias("fy_to_date_spend")))


def dow_profile(ledger: DataFrame, keys: DataFrame, trailing_weeks: int) -> DataFrame:
    """Fraction of a week's spend per weekday (0 = Monday).

    Complete natural weeks (exactly 7 dated rows, positive total) among the
    ``trailing_weeks`` before the current one are turned into per-week
    fractions, averaged by weekday and renormalised. Fewer than two complete
    weeks -> uniform 1/7. Output: key columns, natural_week_start, weekday,
    weight, complete_weeks.
    """
    lk = _ledger_keys(ledger)
    kc = list(dict.fromkeys(lk + ["natural_week_start", "week_start_weekday"]))
    k = keys.select(*kc).distinct().withColumn(
        "window_start", F.date_sub("natural_week_start", 7 * trailing_weeks))
    rows = _window_join(k, kc, "window_start", "natural_week_start", ledger)
    rows = rows.withColumn("wk", fiscal.natural_week_start(F.col("usage_date"), F.col("week_start_weekday")))
    wk = Window.partitionBy(*kc, "wk")
    rows = (rows.withColumn("n", F.count(F.lit(1)).over(wk))
            .withColumn("total", F.sum("cost").over(wk))
            .filter((F.col("n") == 7) & (F.col("total") > 0))
            .withColumn("fraction", F.col("cost").cast("double") / F.col("total").cast("double"))
            .withColumn("weekday", F.weekday("usage_date")))
    means = rows.groupBy(*kc, "weekday").agg(
        F.avg("fraction").alias("mean_fraction"), F.countDistinct("wk").alias("weeks"))
    per_key = Window.partitionBy(*kc)
    means = (means.withColumn("complete_weeks", F.max("weeks").over(per_key))
             .withColumn("mean_total", F.sum("mean_fraction").over(per_key)))
    # all seven weekdays for every key (generator, no join fan-out)
    grid = k.select(*kc, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    out = grid.join(means.select(*kc, "weekday", "mean_fraction", "complete_weeks", "mean_total"),
                    kc + ["weekday"], "left")
    cw = F.coalesce(F.max("complete_weeks").over(per_key), F.lit(0))
    total = F.max("mean_total").over(per_key)
    weight = F.when(cw < 2, F.lit(1.0 / 7.0)).otherwise(
        F.coalesce(F.col("mean_fraction"), F.lit(0.0)) / total)
    return out.select(*kc, "weekday", weight.alias("weight"), cw.cast("int").alias("complete_weeks"))


def weekly_plan(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """Plan row per key: FY label, week bounds, FY-to-date, remaining budget,
    remaining weeks and this week's allowance."""
    lk = _ledger_keys(ledger)
    fytd = fy_to_date(ledger, keys)
    j = keys.join(fytd, list(dict.fromkeys(lk + ["fy_start", "week_start"])), "left")
    remaining = F.greatest(F.col("annual_budget").cast("double")
                           - F.col("fy_to_date_spend").cast("double"), F.lit(0.0))
    return (j.withColumn("remaining_budget", remaining)
            .withColumn("weekly_allowance",
                        fiscal.weekly_allowance(F.col("remaining_budget"), F.col("days_in_week"),
                                                F.col("remaining_fy_days"))))


def day_targets(plan: DataFrame, profile: DataFrame) -> DataFrame:
    """Allowance split over the budget week's dates by the profile weights,
    renormalised over the days present (stub weeks); all-zero weights ->
    even split. Adds the cumulative target through each day."""
    kc = [c for c in profile.columns if c not in ("weekday", "weight", "complete_weeks")]
    days = plan.select("budget_id", "as_of", *[c for c in kc if c not in ("budget_id", "as_of")],
                       "weekly_allowance",
                       F.explode(fiscal.week_dates(F.col("week_start"), F.col("week_end"))).alias("day"))
    days = days.withColumn("weekday", F.weekday("day"))
    j = days.join(profile.select(*kc, "weekday", "weight"), kc + ["weekday"], "left")
    w = Window.partitionBy("budget_id", "as_of")
    j = (j.withColumn("weight", F.coalesce(F.col("weight"), F.lit(0.0)))
         .withColumn("total_weight", F.sum("weight").over(w))
         .withColumn("n_days", F.count(F.lit(1)).over(w)))
    use_even = F.col("total_weight") <= 0
    target = F.when(use_even, F.col("weekly_allowance") * F.lit(1.0) / F.col("n_days").cast("double")) \
        .otherwise(F.col("weekly_allowance") * F.col("weight") / F.col("total_weight"))
    out = j.select("budget_id", "as_of", "day", "weekday", target.alias("target"))
    cum = Window.partitionBy("budget_id", "as_of").orderBy("day").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("cumulative_target", F.sum("target").over(cum))


def calibration(ledger: DataFrame, usage_hourly: DataFrame, keys: DataFrame,
                default_multiplier: float, window_days: int, lag_days: int,
                min_days: int, bounds: tuple[float, float]) -> DataFrame:
    """All-in cost per usage dollar over the days both sources report in
    ``[as_of - lag - window, as_of - lag)``. Fewer than ``min_days`` shared
    days, or no usage dollars -> the default multiplier; else the ratio
    clamped to ``bounds``."""
    lk = _ledger_keys(ledger)
    kc = list(dict.fromkeys(lk + ["as_of"]))
    k = keys.select(*kc).distinct()
    k = (k.withColumn("w_end", F.date_sub("as_of", lag_days))
         .withColumn("w_start", F.date_sub("w_end", window_days)))
    dates = k.select(*kc, F.explode(fiscal.week_dates(F.col("w_start"), F.col("w_end"))).alias("usage_date"))
    usage_daily = (usage_hourly.withColumn("usage_date", F.to_date("hour_start"))
                   .groupBy("budget_id", "usage_date").agg(F.sum("dbu_dollars").alias("dbu")))
    shared = _costs(dates, ledger).join(usage_daily, ["budget_id", "usage_date"], "inner")
    agg = shared.groupBy("budget_id", "as_of").agg(
        F.count(F.lit(1)).alias("window_days"),
        F.sum("cost").alias("cur_sum"), F.sum("dbu").alias("dbu_sum"))
    j = k.select("budget_id", "as_of").join(agg, ["budget_id", "as_of"], "left")
    days = F.coalesce(F.col("window_days"), F.lit(0))
    enough = (days >= min_days) & (F.col("dbu_sum") > 0)
    lo, hi = bounds
    ratio = F.col("cur_sum").cast("double") / usage_double(F.col("dbu_sum"))
    zero = F.lit(0).cast(MONEY)
    return j.select(
        "budget_id", "as_of",
        F.when(enough, F.least(F.greatest(ratio, F.lit(lo)), F.lit(hi)))
        .otherwise(F.lit(default_multiplier)).alias("global_multiplier"),
        days.cast("int").alias("window_days"),
        F.when(enough, F.col("cur_sum")).otherwise(zero).cast(MONEY).alias("cur_total"),
        F.when(enough, F.col("dbu_sum")).otherwise(zero).cast(MONEY).alias("dbu_total"),
    )
