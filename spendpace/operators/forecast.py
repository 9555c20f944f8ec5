"""Rest-of-day forecasts and the intraday measures the pace status needs.

History for a check on day D is the hourly usage of the ``trailing_days``
complete days before D. The sample pool is the same-weekday days of that
history when there are at least two, else all its days; it is shared by all
workloads of the budget. A day with no row for a workload counts as zero.
The pool is decided on the small (budget, date) presence table; hourly rows
are then joined only to the pool dates of each check day (usually two).

Everything that depends on the day but not on the hour is computed once per
(budget_id, today): pooled dollars per (workload, hour-of-day) on a dense
24-hour grid, turned into suffix sums with a window. A check at hour h then
reads its rest-of-day figure with an equi-join on (budget_id, today, h), so
a history of hourly checks costs one day-level pass per day, not one pass
over 14 days of usage per check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendpace.config import MIN_WEEKDAY_SAMPLES, Forecasting
from spendpace.functions import fiscal
from spendpace.functions.tags import usage_double
from spendpace.operators.ordered import running
from spendpace.session import materialize

DAY_KEY = ["budget_id", "today"]


def check_keys(instants: DataFrame, lag_hours: int) -> DataFrame:
    """``instants(budget_id, as_of timestamp, ...)`` -> as_of truncated to
    the hour, today, hour, weekday, the lag cutoff and the lag hours."""
    as_of = F.date_trunc("hour", F.col("as_of").cast("timestamp"))
    k = instants.withColumn("as_of", as_of)
    return (k.withColumn("today", F.to_date("as_of"))
            .withColumn("now_hour", F.hour("as_of"))
            .withColumn("today_wd", F.weekday("today"))
            .withColumn("cutoff", F.col("as_of") - F.make_interval(hours=F.lit(lag_hours)))
            .withColumn("lag_hours", F.transform(
                F.sequence(F.lit(1), F.lit(max(lag_hours, 1))),
                lambda i: F.hour(F.col("as_of") - F.make_interval(hours=i))))
            .withColumn("lag_hours", F.col("lag_hours") if lag_hours > 0
                        else F.array().cast("array<int>")))


def _with_date(usage_hourly: DataFrame) -> DataFrame:
    return (usage_hourly.withColumn("usage_date", F.to_date("hour_start"))
            .withColumn("hour", F.hour("hour_start")))


def pool_days(usage_hourly: DataFrame, keys: DataFrame, trailing_days: int) -> DataFrame:
    """(budget_id, today, usage_date, in_pool, pool_size) for every date of
    the trailing window that has any usage. Built from the tiny
    (budget, date) presence table, so it never touches the hourly rows."""
    presence = usage_hourly.select("budget_id", F.to_date("hour_start").alias("usage_date")).distinct()
    day_keys = keys.select(*DAY_KEY, "today_wd").distinct()
    dates = day_keys.select(*DAY_KEY, "today_wd", F.explode(fiscal.week_dates(
        F.date_sub("today", trailing_days), F.col("today"))).alias("usage_date"))
    days = dates.join(presence, ["budget_id", "usage_date"], "inner")
    per_key = Window.partitionBy(*DAY_KEY)
    same = F.weekday("usage_date") == F.col("today_wd")
    return (days.withColumn("n_same", F.count_if(same).over(per_key))
            .withColumn("in_pool", (F.col("n_same") < MIN_WEEKDAY_SAMPLES) | same)
            .withColumn("pool_size", F.count_if(F.col("in_pool")).over(per_key))
            .select(*DAY_KEY, "usage_date", "in_pool", "pool_size"))


def history(usage_hourly: DataFrame, keys: DataFrame, trailing_days: int,
            days: DataFrame | None = None) -> DataFrame:
    """Hourly usage rows of the **pool** days of every (budget_id, today),
    with ``pool_size``. Each hourly row is joined only to the check days
    whose pool holds its date (two same-weekday dates in the usual case),
    by an equi-join on (budget_id, date)."""
    days = days if days is not None else pool_days(usage_hourly, keys, trailing_days)
    pool = days.filter("in_pool").select(*DAY_KEY, "usage_date", "pool_size")
    return pool.join(_with_date(usage_hourly), ["budget_id", "usage_date"], "inner")


def modal_compute_type(usage_hourly: DataFrame, days: DataFrame) -> DataFrame:
    """Most frequent compute type per (budget_id, today, workload) over the
    whole trailing window (hourly rows counted; smallest name on a tie).
    Counts are pre-aggregated per (budget, date, workload, type) first, those
    of the window's days only."""
    day = ["budget_id", "usage_date"]
    daily = (_with_date(usage_hourly).join(days.select(*day), day, "left_semi")
             .groupBy("budget_id", "usage_date", "workload_type", "workload_id", "compute_type")
             .agg(F.count(F.lit(1)).alias("n")))
    win = days.select(*DAY_KEY, "usage_date").join(daily, day, "inner")
    wk = DAY_KEY + ["workload_type", "workload_id"]
    counts = win.groupBy(*wk, "compute_type").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*wk).orderBy(F.col("n").desc(), F.col("compute_type"))
    return (counts.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
            .select(*wk, "compute_type"))


def _hour_slots(value: str = "dbu_dollars") -> Column:
    """Dollars by hour of day as an array of 24 sums, in one aggregate."""
    return F.array(*[F.sum(F.when(F.col("hour") == h, F.col(value))) for h in range(24)])


def _slot_sum(df: DataFrame, hours, first, count):
    """Exact sum of ``count`` slots of the array ``hours`` from hour ``first``
    on; empty slots count 0. One digit before the point is kept free, so that
    an addition never gives up digits after it."""
    scale = df.schema["hours"].dataType.elementType.scale
    term, total = f"decimal(37,{scale})", f"decimal(38,{scale})"
    return F.aggregate(F.slice(hours, F.lit(first) + 1, F.lit(count)), F.lit(0).cast(total),
                       lambda a, x: (a.cast(term) + F.coalesce(x, F.lit(0)).cast(term)).cast(total))


def pooled_hours(hist: DataFrame) -> DataFrame:
    """Pooled dollars per (budget_id, today, workload): ``hours``, an array of
    24 sums by hour of day, with the pool size. The one aggregate of the
    history that both the forecasts and the intraday measures read (a stage
    table in a check)."""
    return (hist.groupBy(*DAY_KEY, "workload_type", "workload_id")
            .agg(_hour_slots().alias("hours"), F.max("pool_size").alias("pool_size")))


def forecasts(keys: DataFrame, pooled: DataFrame, modes: DataFrame, multipliers: DataFrame,
              meta: DataFrame | None, queue: DataFrame | None, cfg: Forecasting) -> DataFrame:
    """Rest-of-day all-in forecast per workload and check instant.

    ``multipliers(budget_id, today, global_multiplier[, overrides])``: a
    budget's stored overrides win over those of ``cfg``. ``meta(budget_id, workload_type, workload_id, name,
    priority)``; unknown workloads get a default name and ``normal``.
    Jobs waiting in ``queue(budget_id, job_id)`` are removed. ``pooled``
    is ``pooled_hours`` of the history.
    """
    prof = pooled.join(modes, DAY_KEY + ["workload_type", "workload_id"], "inner")
    rest_of_day = _slot_sum(pooled, F.col("hours"), F.col("now_hour"), 24 - F.col("now_hour"))
    f = (keys.select("budget_id", "as_of", "today", "now_hour").join(prof, DAY_KEY, "inner")
         .withColumn("dbu_forecast", usage_double(rest_of_day) / F.col("pool_size"))
         .filter(F.col("dbu_forecast") > 0))
    f = f.join(multipliers.select(*DAY_KEY, "global_multiplier", stored_overrides(multipliers)), DAY_KEY, "left")
    f = f.withColumn("multiplier", multiplier_for(F.col("compute_type"), F.col("global_multiplier"), cfg, F.col("overrides")))
    f = f.withColumn("forecast_usd", F.col("dbu_forecast") * F.col("multiplier"))
    default_name = F.when(F.col("workload_id") != "", F.concat(
        F.lower("workload_type"), F.lit("-"), F.col("workload_id"))).otherwise(F.col("compute_type"))
    if meta is not None:
        f = f.join(meta.select("budget_id", "workload_type", "workload_id",
                               F.col("name").alias("m_name"), F.col("priority").alias("m_priority")),
                   ["budget_id", "workload_type", "workload_id"], "left")
        name = F.when(F.col("m_priority").isNotNull(), F.col("m_name")).otherwise(default_name)
        priority = F.coalesce(F.col("m_priority"), F.lit("normal"))
    else:
        name, priority = default_name, F.lit("normal")
    f = f.withColumn("name", name).withColumn("priority", priority)
    if queue is not None:
        queued = queue.select("budget_id", F.col("job_id").alias("workload_id"),
                              F.lit("JOB").alias("workload_type")).distinct()
        f = f.join(queued, ["budget_id", "workload_type", "workload_id"], "left_anti")
    f = f.select("budget_id", "as_of", "workload_type", "workload_id", "name", "priority",
                 "compute_type", "dbu_forecast", "multiplier",
                 F.col("pool_size").alias("sample_days"), "forecast_usd")
    return running(f, ["budget_id", "as_of"], [F.col("forecast_usd").desc(), F.col("workload_type"), F.col("workload_id")],
                   "forecast_rank")


def stored_overrides(multipliers: DataFrame) -> Column:
    """The column ``overrides`` (compute type -> multiplier) of a calibration;
    null where it was stored without one."""
    given = F.col("overrides") if "overrides" in multipliers.columns else F.lit(None)
    return given.cast("map<string,double>").alias("overrides")


def multiplier_for(compute_type, global_multiplier, cfg: Forecasting, overrides: Column | None = None):
    """The budget's stored override of a compute type, else the configured
    one, else the calibrated multiplier."""
    expr = global_multiplier
    for ctype, mult in reversed(cfg.multiplier_overrides):
        expr = F.when(compute_type == ctype, F.lit(float(mult))).otherwise(expr)
    return expr if overrides is None else F.coalesce(F.try_element_at(overrides, compute_type), expr)


def day_hour_totals(pooled: DataFrame) -> DataFrame:
    """Pooled dollars of all workloads per (budget_id, today) by hour of day
    (``hours``), with the pool size. ``pooled`` is ``pooled_hours``."""
    slots = F.array(*[F.sum(F.col("hours")[h]) for h in range(24)])
    return pooled.groupBy(*DAY_KEY).agg(slots.alias("hours"), F.max("pool_size").alias("pool_size"))


def intraday_fraction(keys: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of a day's pooled dollars accrued before the current hour;
    no history or no dollars -> ``min(hour / 24, 1)``."""
    j = keys.select("budget_id", "as_of", "today", "now_hour").join(totals, DAY_KEY, "left")
    linear = F.least(F.col("now_hour") / F.lit(24.0), F.lit(1.0))
    j = (j.withColumn("before_hour", _slot_sum(totals, F.col("hours"), 0, F.col("now_hour")))
         .withColumn("day_total", _slot_sum(totals, F.col("hours"), 0, 24)))
    frac = F.when(F.col("day_total").isNull() | (F.col("day_total") <= 0), linear).otherwise(
        usage_double(F.col("before_hour")) / usage_double(F.col("day_total")))
    return j.select("budget_id", "as_of", frac.alias("intraday_fraction"))


def lag_fill(keys: DataFrame, totals: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Expected dollars in the lag hours (hour-of-day set of the last
    ``lag`` hours) = pooled mean x the **global** multiplier."""
    in_lag = F.transform(F.col("hours"), lambda x, h: F.when(F.array_contains("lag_hours", h), x))
    s = (keys.select("budget_id", "as_of", "today", "lag_hours").join(totals, DAY_KEY, "inner")
         .withColumn("dbu", _slot_sum(totals, in_lag, 0, 24)))
    s = s.join(multipliers.select(*DAY_KEY, "global_multiplier"), DAY_KEY, "left")
    fill = usage_double(F.col("dbu")) / F.col("pool_size") * F.col("global_multiplier")
    out = keys.select("budget_id", "as_of").join(s.select("budget_id", "as_of", fill.alias("lag_fill")),
                                                 ["budget_id", "as_of"], "left")
    return out.select("budget_id", "as_of", F.coalesce("lag_fill", F.lit(0.0)).alias("lag_fill"))


def observed(keys: DataFrame, usage_hourly: DataFrame, week_start: DataFrame,
             multipliers: DataFrame, cfg: Forecasting) -> DataFrame:
    """All-in observed dollars before the lag cutoff: this budget week and
    today (from the later of midnight and the week start). Sums by compute
    type, each times its multiplier.

    ``week_start(budget_id, today, week_start)`` comes from the plan.

    The window ``[week_start, cutoff)`` is its dates; each takes all 24 slots
    of its day, the cutoff's own date those before the cutoff's hour. A check
    thus touches at most 7 day rows per compute type, never the hourly rows of
    its week, and only days of an asked week are summed. The asked days are a
    small stage table: hourly rows are filtered by it where they are read.
    """
    k = keys.select("budget_id", "as_of", "today", "cutoff").join(week_start, DAY_KEY, "inner")
    cut_date = F.to_date("cutoff")
    asked = k.select("budget_id", "as_of", "today", cut_date.alias("cut_date"), F.hour("cutoff").alias("cut_hour"),
                     F.explode(fiscal.week_dates(F.col("week_start"), F.date_add(F.least(cut_date, "today"), 1)))
                     .alias("usage_date"))
    asked = materialize(asked)
    day = ["budget_id", "usage_date"]
    slots = (_with_date(usage_hourly).join(asked.select(*day).distinct(), day, "left_semi")
             .groupBy(*day, "compute_type").agg(_hour_slots().alias("hours")))
    count = F.when(F.col("usage_date") == F.col("cut_date"), F.col("cut_hour")).otherwise(24)
    d = asked.join(slots, day, "inner").withColumn("dbu", _slot_sum(slots, F.col("hours"), 0, count))
    t = d.groupBy("budget_id", "as_of", "today", "compute_type").agg(
        F.sum("dbu").alias("week_dbu"), F.sum(F.when(F.col("usage_date") == F.col("today"), F.col("dbu"))).alias("today_dbu"))
    t = t.join(multipliers.select(*DAY_KEY, "global_multiplier", stored_overrides(multipliers)), DAY_KEY, "left")
    m = multiplier_for(F.col("compute_type"), F.col("global_multiplier"), cfg, F.col("overrides"))
    s = t.groupBy("budget_id", "as_of").agg(
        F.sum(usage_double(F.col("week_dbu")) * m).alias("observed_week"),
        F.sum(usage_double(F.coalesce(F.col("today_dbu"), F.lit(0))) * m).alias("observed_today"))
    out = keys.select("budget_id", "as_of").join(s, ["budget_id", "as_of"], "left")
    return out.select("budget_id", "as_of", F.coalesce("observed_week", F.lit(0.0)).alias("observed_week"),
                      F.coalesce("observed_today", F.lit(0.0)).alias("observed_today"))
