"""Composite hourly check per (budget_id, as_of): forecasts -> pace status
-> lever options -> allocation -> release plan. The plan in force at a check
is the one built for the check's date (``weekly.plan_instants``)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendpace.config import PaceConfig
from spendpace.operators import allocate as AL
from spendpace.operators import forecast as FC
from spendpace.operators import levers as LV
from spendpace.operators import plan as P
from spendpace.operators import status as ST
from spendpace.plans import weekly as W
from spendpace.session import materialize
from spendpace.sources import inventory as INV


class CheckTables:
    """The stages of a check, each built (and materialized where it is
    reused) on first access, so a query pays only for what it reads."""

    def __init__(self, inputs: W.Inputs, cfg: PaceConfig, instants: DataFrame,
                 queue: DataFrame | None, active: DataFrame | None,
                 pt: W.PlanTables | None, usage_hourly: DataFrame | None):
        self.inputs, self.cfg, self.instants = inputs, cfg, instants
        self.queue, self.active = queue, active
        self._pt, self._uh = pt, usage_hourly

    @cached_property
    def usage_hourly(self) -> DataFrame:
        """The given hourly table as is (the caller's table or stage), else
        the priced rollup of the days this check can read, materialized."""
        if self._uh is not None:
            return self._uh
        return materialize(self.inputs.usage_hourly(*W.usage_window(self.instants, self.cfg)))

    @cached_property
    def plan(self) -> W.PlanTables:
        """The given plan tables as is (see ``plan_tables``), else the plan
        for the dates of this check's instants."""
        return self._pt or plan_tables(self.inputs, self.cfg, self.instants, self.usage_hourly)

    @cached_property
    def keys(self) -> DataFrame:
        return FC.check_keys(self.instants, self.cfg.forecast.usage_lag_hours)

    @cached_property
    def pool_days(self) -> DataFrame:
        """A stage table: two joins with the hourly rows read it, by its size
        without a shuffle of those rows."""
        return materialize(FC.pool_days(self.usage_hourly, self.keys, self.cfg.forecast.trailing_days))

    @cached_property
    def history(self) -> DataFrame:
        return FC.history(self.usage_hourly, self.keys, self.cfg.forecast.trailing_days, self.pool_days)

    @cached_property
    def pooled(self) -> DataFrame:
        return materialize(FC.pooled_hours(self.history))

    @cached_property
    def modes(self) -> DataFrame:
        return FC.modal_compute_type(self.usage_hourly, self.pool_days)

    @cached_property
    def multipliers(self) -> DataFrame:
        return multipliers(self.plan)

    @cached_property
    def jobs(self) -> DataFrame:
        return self.inputs.inventory("jobs", self.cfg.priority_tag_key)

    @cached_property
    def warehouses(self) -> DataFrame:
        return self.inputs.inventory("warehouses", self.cfg.priority_tag_key)

    @cached_property
    def clusters(self) -> DataFrame:
        return self.inputs.inventory("clusters", self.cfg.priority_tag_key)

    @cached_property
    def meta(self) -> DataFrame:
        return INV.workload_meta(self.jobs, self.warehouses, self.clusters)

    @cached_property
    def forecasts(self) -> DataFrame:
        return materialize(FC.forecasts(self.keys, self.pooled, self.modes, self.multipliers, self.meta,
                                        self.queue, self.cfg.forecast))

    @cached_property
    def totals(self) -> DataFrame:
        return FC.day_hour_totals(self.pooled)

    @cached_property
    def fraction(self) -> DataFrame:
        return FC.intraday_fraction(self.keys, self.totals)

    @cached_property
    def fill(self) -> DataFrame:
        return FC.lag_fill(self.keys, self.totals, self.multipliers)

    @cached_property
    def observed(self) -> DataFrame:
        ws = self.plan.plan.select("budget_id", F.col("as_of").alias("today"), "week_start")
        return FC.observed(self.keys, self.usage_hourly, ws, self.multipliers, self.cfg.forecast)

    @cached_property
    def status(self) -> DataFrame:
        sums = ST.target_sums(self.keys, self.plan.targets)
        return materialize(ST.status(self.keys, self.plan.plan, sums, self.fraction, self.fill,
                                     self.observed, self.forecasts, self.cfg.thresholds))

    @cached_property
    def options(self) -> DataFrame:
        return materialize(LV.options(self.forecasts, self.status, self.jobs, self.warehouses,
                                      self.clusters, self.active, self.cfg.levers))

    @cached_property
    def gap(self) -> DataFrame:
        return AL.gaps(self.status, AL.active_credit(self.keys, self.active))

    @cached_property
    def chosen(self) -> DataFrame:
        return AL.allocate(self.options, self.gap)

    @cached_property
    def summary(self) -> DataFrame:
        return AL.summary(self.gap, self.chosen)

    @cached_property
    def coverage(self) -> DataFrame:
        return AL.coverage(self.forecasts, self.status, self.options, self.jobs, self.warehouses,
                           self.clusters, self.active)


def plan_tables(inputs: W.Inputs, cfg: PaceConfig, instants: DataFrame,
                usage_hourly: DataFrame) -> W.PlanTables:
    """Plan, day targets and calibration for the dates of ``instants``,
    materialized as stage tables. Checks at different instants can share
    one: every check reads its own (budget_id, date) rows by equi-join."""
    pt = W.build_plan(inputs, cfg, W.plan_instants(instants), usage_hourly)
    plan = materialize(pt.plan)
    # targets split the stored plan row's allowance: the plan is not recomputed
    targets = materialize(P.day_targets(plan, pt.profile))
    return W.PlanTables(pt.keys, pt.ledger, pt.profile, plan, targets, materialize(pt.calibration))


def multipliers(pt: W.PlanTables) -> DataFrame:
    return pt.calibration.select("budget_id", F.col("as_of").alias("today"), "global_multiplier", FC.stored_overrides(pt.calibration))


def build_check(inputs: W.Inputs, cfg: PaceConfig, instants: DataFrame,
                queue: DataFrame | None = None, active: DataFrame | None = None,
                pt: W.PlanTables | None = None, usage_hourly: DataFrame | None = None) -> CheckTables:
    """``instants``: budget rows with an ``as_of`` timestamp column.
    ``queue(budget_id, job_id, ...)``: jobs held by the deferral queue;
    ``active(budget_id, kind, target_id, estimated_savings, ...)``: actions
    in force. ``pt`` (from ``plan_tables``) and ``usage_hourly`` are used as
    given, so pass stage tables (``materialize``) when they are shared by
    several checks; when omitted they are built and materialized here."""
    return CheckTables(inputs, cfg, instants, queue, active, pt, usage_hourly)
