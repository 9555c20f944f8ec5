"""Composite plan build, per (budget_id, as_of): ledger -> profile -> plan ->
day targets, plus calibration. One lazy DataFrame graph; Catalyst sees it
whole, shuffles only at the aggregations and windows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendpace import config as C
from spendpace.config import PaceConfig
from spendpace.operators import ledger as L
from spendpace.operators import plan as P
from spendpace.session import materialize
from spendpace.sources import adapter, cur as cur_src, inventory as INV, usage as usage_src


class Inputs:
    """The pipeline's input tables.

    Each table is given as a DataFrame or as a zero-argument function that
    builds it; a function runs (and may materialize) only when the table is
    first used, so a query pays only for the inputs it reads. The functions
    of the facts ``cur`` and ``usage`` take (start, end) dates, None for no
    bound, and apply them to the raw time column; given as DataFrames, the
    facts are filtered on their canonical time column.

    ``recent_ledger`` is a daily ledger that holds every day from
    ``recent_from`` on, when such a stage table exists.
    """

    _NAMES = ("cur", "usage", "prices", "budgets", "jobs_raw", "warehouses_raw", "clusters_raw",
              "vendor_ledger", "recent_ledger")

    def __init__(self, cur, usage, prices, budgets, jobs_raw, warehouses_raw, clusters_raw,
                 vendor_ledger=None, recent_ledger=None, recent_from: date | None = None):
        self._given = dict(zip(self._NAMES, (cur, usage, prices, budgets, jobs_raw, warehouses_raw,
                                              clusters_raw, vendor_ledger, recent_ledger)))
        self._built: dict[str, DataFrame | None] = {}
        self._inventory: dict[tuple[str, str], DataFrame] = {}
        self.recent_from = recent_from

    def _get(self, name: str) -> DataFrame | None:
        if name not in self._built:
            v = self._given[name]
            self._built[name] = v() if callable(v) else v
        return self._built[name]

    cur = property(lambda self: self._get("cur"))                        # canonical line items
    usage = property(lambda self: self._get("usage"))                    # raw metered usage
    prices = property(lambda self: self._get("prices"))
    budgets = property(lambda self: self._get("budgets"))                # amount + calendar params
    jobs_raw = property(lambda self: self._get("jobs_raw"))
    warehouses_raw = property(lambda self: self._get("warehouses_raw"))
    clusters_raw = property(lambda self: self._get("clusters_raw"))
    #: daily vendor-attributed ledger, when available as a stage table
    vendor_ledger = property(lambda self: self._get("vendor_ledger"))

    #: the same from ``recent_from`` on
    recent_ledger = property(lambda self: self._get("recent_ledger"))

    def _fact(self, name: str, column: str, start: date | None, end: date | None) -> DataFrame:
        v = self._given[name]
        if callable(v):
            return v(start, end) if start or end else self._get(name)
        if start is not None:
            v = v.filter(F.col(column) >= F.lit(start).cast("timestamp"))
        if end is not None:
            v = v.filter(F.col(column) < F.lit(end).cast("timestamp"))
        return v

    def flagged(self, cfg: PaceConfig) -> DataFrame:
        return L.attribute(self.cur, cfg)

    def attributed(self, cfg: PaceConfig, start: date | None = None, end: date | None = None) -> DataFrame:
        return L.attributed_rows(self._fact("cur", "usage_start", start, end), cfg)

    def inventory(self, kind: str, tag_key: str) -> DataFrame:
        """Jobs, warehouses or clusters as a stage table that all checks over
        these inputs share."""
        if (kind, tag_key) not in self._inventory:
            self._inventory[kind, tag_key] = materialize(getattr(INV, kind)(self._get(f"{kind}_raw"), tag_key))
        return self._inventory[kind, tag_key]

    def usage_hourly(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return usage_src.hourly_usage(self._fact("usage", "usage_start_time", start, end), self.prices)

    def usage_daily(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return usage_src.daily_usage(self._fact("usage", "usage_start_time", start, end), self.prices)


def adapter_inputs(spark: SparkSession, sf_dir: str, cfg: PaceConfig | None = None) -> Inputs:
    """Inputs derived from the driver's test tables (built on first use)."""
    cfg = cfg or PaceConfig()
    inputs: Inputs

    def cur(start: date | None = None, end: date | None = None) -> DataFrame:
        return L.assign_budgets(cur_src.normalize(adapter.cur_raw(spark, sf_dir, start, end), cfg),
                                adapter.budget_accounts(spark, sf_dir))

    def vendor_ledger(start: date | None = None) -> DataFrame:
        # budget amounts come from the vendor-attributed ledger, whatever the mode
        return materialize(L.daily_costs(inputs.attributed(PaceConfig(), start)))

    recent_from = date.fromisoformat(adapter.BUDGET_BASE_START)

    inputs = Inputs(
        cur=cur,
        usage=lambda start=None, end=None: adapter.usage(spark, sf_dir, start, end),
        # the price list is a small catalogue: materialized, its measured
        # size lets Spark broadcast it into the usage join (no SKU shuffle)
        prices=lambda: materialize(adapter.prices(spark, sf_dir)),
        budgets=lambda: materialize(adapter.budgets(spark, sf_dir, inputs.recent_ledger)),
        jobs_raw=lambda: adapter.jobs_raw(spark, sf_dir, cfg.priority_tag_key),
        warehouses_raw=lambda: adapter.warehouses_raw(spark, sf_dir, cfg.priority_tag_key),
        clusters_raw=lambda: adapter.clusters_raw(spark, sf_dir, cfg.priority_tag_key),
        vendor_ledger=vendor_ledger,
        recent_ledger=lambda: vendor_ledger(recent_from),
        recent_from=recent_from,
    )
    return inputs


def plan_instants(check_instants: DataFrame) -> DataFrame:
    """The plan in force at a check is the one built for the check's date."""
    return (check_instants.withColumn("as_of", F.to_date("as_of"))
            .select("budget_id", "as_of", "annual_budget", "fy_start_month", "fy_start_day",
                    "week_start_weekday").distinct())


@dataclass
class PlanTables:
    keys: DataFrame
    ledger: DataFrame
    profile: DataFrame
    plan: DataFrame
    targets: DataFrame
    calibration: DataFrame


def days_back(cfg: PaceConfig) -> int:
    """Days before its own that a check's usage goes back."""
    return max(cfg.forecast.trailing_days, C.CALIBRATION_WINDOW_DAYS + C.CUR_LAG_DAYS, 7)


def usage_window(instants: DataFrame, cfg: PaceConfig) -> tuple[date | None, date | None]:
    """The days ``[start, end)`` of usage that the plans and checks at
    ``instants`` can read: the forecast history, the calibration window and
    the budget week before the first, up to the last. One row reaches the
    driver; no instants give no bounds."""
    day = F.to_date("as_of")
    return tuple(instants.agg(F.date_sub(F.min(day), days_back(cfg)), F.date_add(F.max(day), 1)).first())


def ledger_window(keys: DataFrame, cfg: PaceConfig) -> tuple[date | None, date | None]:
    """The days ``[start, end)`` of billing that plans for ``keys`` can read:
    the fiscal year so far, the profile's weeks and the calibration window."""
    first = F.least("fy_start", F.date_sub("natural_week_start", 7 * cfg.forecast.trailing_weeks),
                    F.date_sub("as_of", C.CALIBRATION_WINDOW_DAYS + C.CUR_LAG_DAYS))
    return tuple(keys.agg(F.min(first), F.date_add(F.max("as_of"), 1)).first())


def ledger_for(inputs: Inputs, cfg: PaceConfig, keys: DataFrame) -> DataFrame:
    """Attributed ledger, or the blended one when usage is invoiced apart."""
    if not cfg.include_usage_invoice:
        start, end = ledger_window(keys, cfg)
        if inputs.recent_ledger is not None and start is not None and start >= inputs.recent_from \
                and cfg.attribution == "vendor" \
                and cfg.vendor == PaceConfig().vendor and cfg.tag_names == PaceConfig().tag_names \
                and cfg.excluded_line_item_types == PaceConfig().excluded_line_item_types:
            return inputs.recent_ledger
        return materialize(L.daily_costs(inputs.attributed(cfg, start, end)))
    start, end = keys.agg(F.min("fy_start"), F.date_add(F.max("as_of"), 1)).first()
    return materialize(L.blended_days(inputs.attributed(cfg, *ledger_window(keys, cfg)), inputs.usage_daily(start, end)))


def build_plan(inputs: Inputs, cfg: PaceConfig, instants: DataFrame,
               usage_hourly: DataFrame | None = None) -> PlanTables:
    """``instants``: budget rows with an ``as_of`` date column."""
    keys = P.plan_keys(instants)
    ledger = ledger_for(inputs, cfg, keys)
    profile = P.dow_profile(ledger, keys, cfg.forecast.trailing_weeks)
    plan = P.weekly_plan(ledger, keys)
    targets = P.day_targets(plan, profile)
    if usage_hourly is None:
        usage_hourly = inputs.usage_hourly(*usage_window(instants, cfg))
    calib = P.calibration(ledger, usage_hourly, keys,
                          cfg.forecast.default_infra_multiplier, C.CALIBRATION_WINDOW_DAYS,
                          C.CUR_LAG_DAYS, C.CALIBRATION_MIN_DAYS, C.MULTIPLIER_BOUNDS)
    return PlanTables(keys, ledger, profile, plan, targets, calib)


def plan_columns(plan: DataFrame) -> DataFrame:
    """The published plan row."""
    return plan.select("budget_id", "as_of", "fy_label", "week_start", "week_end",
                       F.col("annual_budget").cast("double").alias("annual_budget"),
                       "fy_to_date_spend", "remaining_budget", "remaining_weeks", "weekly_allowance")

