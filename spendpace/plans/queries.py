"""Registered queries: one per operator (or per pair of operators that are
one expression), each with its Spark form and its SQL twin.

A query's output columns are declared once (name, kind); the same list
finalises the Spark DataFrame and the SQL statement, so names and types
match on both sides. Money that went through floating point is rounded to
4 places, ratios to 6.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendpace.config import PaceConfig
from spendpace.plans import oracle as O
from spendpace.plans import weekly as W
from spendpace.session import materialize
from spendpace.sources import adapter

def _fixed(places: int):
    """Round half up with the same IEEE operations in both engines:
    floor(x * 10^k + 0.5) / 10^k (infinities and NaN pass through)."""
    scale = 10 ** places

    def spark(c: Column) -> Column:
        d = c.cast("double")
        return F.when(d.isNull() | d.isNaN() | (F.abs(d) == float("inf")), d).otherwise(
            F.floor(d * scale + F.lit(0.5)) / scale)

    sql = ("CASE WHEN isnan(CAST({0} AS DOUBLE)) OR isinf(CAST({0} AS DOUBLE)) THEN CAST({0} AS DOUBLE) "
           f"ELSE floor(CAST({{0}} AS DOUBLE) * {scale} + 0.5) / {scale} END")
    return spark, sql


KINDS = {
    # kind: (spark cast/expression, SQL template)
    "money": _fixed(4),
    "ratio": _fixed(6),
    "dec": (lambda c: c.cast("decimal(18,4)"), "CAST({} AS DECIMAL(18,4))"),
    "usage": (lambda c: c.cast("decimal(28,9)"), "CAST({} AS DECIMAL(28,9))"),
    "int": (lambda c: c.cast("int"), "CAST({} AS INTEGER)"),
    "long": (lambda c: c.cast("bigint"), "CAST({} AS BIGINT)"),
    "str": (lambda c: c.cast("string"), "CAST({} AS VARCHAR)"),
    "date": (lambda c: c.cast("date"), "CAST({} AS DATE)"),
    "ts": (lambda c: c.cast("timestamp_ntz"), "CAST({} AS TIMESTAMP)"),
    "bool": (lambda c: c.cast("boolean"), "CAST({} AS BOOLEAN)"),
}


@dataclass
class Query:
    name: str
    columns: list[tuple[str, str]]
    build: Callable[[SparkSession, str], DataFrame]
    ctes: list[str] | None = None   # CTEs the SQL needs
    sql_from: str | None = None      # inner SELECT producing the columns
    sql_builder: Callable[[str], str] | None = None  # custom WITH-builder

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # calendar math is UTC
        df = self.build(spark, sf_dir)
        return df.select(*[KINDS[k][0](F.col(n)).alias(n) for n, k in self.columns])

    def sql(self) -> str | None:
        if self.sql_from is None:
            return None
        proj = ", ".join(f"{KINDS[k][1].format(n)} AS {n}" for n, k in self.columns)
        select = f"SELECT {proj} FROM ({self.sql_from}) q"
        if self.sql_builder is not None:
            return self.sql_builder(select)
        return O.with_ctes(self.ctes or [], select)


REGISTRY: dict[str, Query] = {}


def register(name: str, columns: list[tuple[str, str]], ctes: list[str] | None = None,
             sql_from: str | None = None, sql_builder=None):
    def deco(fn):
        REGISTRY[name] = Query(name, columns, fn, ctes, sql_from, sql_builder)
        return fn
    return deco


# ------------------------------------------------------------- shared build --
CFG = _CFG = PaceConfig()  # the configuration every registered query runs with


def inputs(spark: SparkSession, sf_dir: str, cfg: PaceConfig = _CFG) -> W.Inputs:
    return W.adapter_inputs(spark, sf_dir, cfg)


def plan_tables(spark: SparkSession, sf_dir: str, cfg: PaceConfig = _CFG) -> tuple[W.Inputs, W.PlanTables]:
    inp = inputs(spark, sf_dir, cfg)
    inst = adapter.check_instants(inp.budgets)
    return inp, W.build_plan(inp, cfg, W.plan_instants(inst))


# ------------------------------------------------------------------ ingest --
CUR_COLS = [("budget_id", "int"), ("usage_start", "ts"), ("usage_date", "date"), ("cost", "dec"),
            ("line_item_type", "str"), ("usage_account_id", "str"), ("legal_entity", "str"),
            ("billing_entity", "str"), ("product_name", "str"), ("tag_user_vendor", "str"),
            ("tag_user_clusterid", "str")]


@register("cur_normalized", CUR_COLS, ["cur"], "SELECT * FROM cur")
def q_cur_normalized(spark, sf_dir):
    """SRC1, SRC3, PRJ1-PRJ7, FLT2: canonical line items with their budget."""
    return inputs(spark, sf_dir).cur


@register("cur_attributed", CUR_COLS + [("is_marketplace", "bool")], ["attributed"],
          "SELECT * FROM attributed")
def q_cur_attributed(spark, sf_dir):
    """FLT1, FLT3, FLT4, FLT5: rows attributed to the platform."""
    return inputs(spark, sf_dir).attributed(_CFG)


@register("attribution_summary",
          [("budget_id", "int"), ("kept_rows", "long"), ("kept_cost", "dec"), ("dropped_cost", "dec"),
           ("marketplace_cost", "dec")],
          ["flagged"], """
  SELECT budget_id, COUNT(*) FILTER (WHERE attributed) AS kept_rows,
    coalesce(SUM(cost) FILTER (WHERE attributed), 0) AS kept_cost,
    coalesce(SUM(cost) FILTER (WHERE NOT attributed), 0) AS dropped_cost,
    coalesce(SUM(cost) FILTER (WHERE attributed AND is_marketplace), 0) AS marketplace_cost
  FROM flagged GROUP BY budget_id""")
def q_attribution_summary(spark, sf_dir):
    """AGG2, AGG4: kept rows and dollars, dropped dollars, marketplace dollars."""
    from spendpace.operators.ledger import attribution_summary
    return attribution_summary(inputs(spark, sf_dir).flagged(_CFG))


@register("ledger_daily", [("budget_id", "int"), ("usage_date", "date"), ("cost", "dec")],
          ["ledger"], "SELECT * FROM ledger")
def q_ledger_daily(spark, sf_dir):
    """AGG1: daily attributed cost per budget."""
    return inputs(spark, sf_dir).vendor_ledger


@register("ledger_open_accounts", REGISTRY["ledger_daily"].columns, ["ledger"], """
  SELECT * FROM ledger
  UNION ALL SELECT 99, usage_date, CAST(SUM(cost) AS DECIMAL(18,4)) FROM ledger GROUP BY usage_date""")
def q_ledger_open_accounts(spark, sf_dir):
    """FLT2: a further budget, 99, lists no account and takes every line item."""
    from spendpace.operators import ledger as L
    from spendpace.sources import cur as CUR
    accounts = adapter.budget_accounts(spark, sf_dir)
    budgets = accounts.select("budget_id").union(spark.range(99, 100).select(F.col("id").cast("int")))
    cur = L.assign_budgets(CUR.normalize(adapter.cur_raw(spark, sf_dir), _CFG), accounts, budgets)
    return L.daily_costs(L.attributed_rows(cur, _CFG))


@register("cur_csv_ledger", REGISTRY["ledger_daily"].columns, ["ledger"], "SELECT * FROM ledger")
def q_cur_csv_ledger(spark, sf_dir):
    """SRC2, SET1, PRJ1 (legacy names): the line items exported as gzip CSV
    in the slash-named layout, two billing-period folders whose headers
    list the columns in different orders; read back per header group,
    unioned by name, normalised and attributed. Equals the parquet ledger."""
    import uuid
    from spendpace.operators import ledger as L
    from spendpace.session import checkpoint_dir
    from spendpace.sources import cur as CUR
    root = adapter.write_cur_csv(spark, sf_dir, f"{checkpoint_dir(spark)}/cur-csv-{uuid.uuid4().hex}")
    cur = L.assign_budgets(CUR.normalize(CUR.read_csv(spark, root), _CFG), adapter.budget_accounts(spark, sf_dir))
    return L.daily_costs(L.attributed_rows(cur, _CFG))


@register("cur_parquet_ledger", REGISTRY["ledger_daily"].columns, ["ledger"], "SELECT * FROM ledger")
def q_cur_parquet_ledger(spark, sf_dir):
    """SRC1, PRJ3: the line items as a parquet export of two billing periods with
    tags in one text column, one period delivered anew; the assemblies in force
    give the ledger of the line items."""
    import uuid
    from spendpace.operators import ledger as L
    from spendpace.session import checkpoint_dir
    from spendpace.sources import cur as CUR
    root = adapter.write_cur_parquet(spark, sf_dir, f"{checkpoint_dir(spark)}/cur-parquet-{uuid.uuid4().hex}")
    cur = L.assign_budgets(CUR.normalize(CUR.read_parquet(spark, root), _CFG), adapter.budget_accounts(spark, sf_dir))
    return L.daily_costs(L.attributed_rows(cur, _CFG))


@register("cur_delivery_duplicates",
          [("file_name", "str"), ("billing_period", "str"), ("copies", "long"), ("first_path", "str"),
           ("last_path", "str")])
def q_cur_delivery_duplicates(spark, sf_dir):
    """SRC4: versioned-delivery detector over the files of a CSV export of all
    billing periods whose second one was delivered twice (same file names in
    two assembly folders). No SQL twin: the input is a file listing."""
    import uuid
    from spendpace.session import checkpoint_dir
    from spendpace.sources import cur as CUR
    root = adapter.write_cur_redelivery(spark, sf_dir, f"{checkpoint_dir(spark)}/cur-redelivery-{uuid.uuid4().hex}")
    return CUR.delivery_duplicates(CUR.delivery_paths(spark, root))


@register("granularity_check",
          [("budget_id", "int"), ("n_dates", "long"), ("first_date", "date"), ("last_date", "date"),
           ("span_days", "int"), ("looks_monthly", "bool")],
          ["ledger"], """
  SELECT budget_id, n_dates, first_date, last_date, span_days,
         (n_dates >= 2 AND span_days >= 28 AND n_dates <= floor(span_days / 25)) AS looks_monthly
  FROM (SELECT budget_id, COUNT(*) AS n_dates, MIN(usage_date) AS first_date, MAX(usage_date) AS last_date,
               MAX(usage_date) - MIN(usage_date) + 1 AS span_days FROM ledger GROUP BY budget_id)""")
def q_granularity_check(spark, sf_dir):
    """AGG5: monthly-export detector over each budget's ledger."""
    from spendpace.operators.ledger import granularity_check
    return granularity_check(inputs(spark, sf_dir).vendor_ledger)


@register("usage_hourly",
          [("budget_id", "int"), ("hour_start", "ts"), ("compute_type", "str"), ("workload_type", "str"),
           ("workload_id", "str"), ("dbu_dollars", "usage")],
          ["usage_hourly"], "SELECT * FROM usage_hourly")
def q_usage_hourly(spark, sf_dir):
    """SRC5, JOIN1, PRJ8, AGG3: hourly priced usage by workload."""
    return inputs(spark, sf_dir).usage_hourly()


@register("usage_daily", [("budget_id", "int"), ("usage_date", "date"), ("dbu_dollars", "usage")],
          ["usage_daily"], "SELECT * FROM usage_daily")
def q_usage_daily(spark, sf_dir):
    """SRC6: daily priced usage."""
    return inputs(spark, sf_dir).usage_daily()


# -------------------------------------------------------------------- plan --
@register("fiscal_calendar",
          [("budget_id", "int"), ("usage_date", "date"), ("fy_start", "date"), ("fy_end", "date"),
           ("fy_label", "str"), ("week_start", "date"), ("week_end", "date"), ("days_in_week", "int"),
           ("remaining_fy_days", "int"), ("remaining_weeks", "ratio"), ("natural_week_start", "date")],
          ["ledger", "budgets"], f"""
  SELECT *, fy_end - week_start AS remaining_fy_days,
         CAST(fy_end - week_start AS DOUBLE) / 7.0 AS remaining_weeks,
         week_end - week_start AS days_in_week
  FROM (SELECT *, 'FY' || CAST(year(fy_end) AS VARCHAR) AS fy_label,
          least(CAST(week_start + CAST(CASE WHEN {O._pmod7('wsw - ' + O._wd('week_start'))} = 0 THEN 7
                ELSE {O._pmod7('wsw - ' + O._wd('week_start'))} END AS INTEGER) AS DATE), fy_end) AS week_end
   FROM (SELECT *, greatest(natural_week_start, fy_start) AS week_start
    FROM (SELECT *, make_date(year(fy_start) + 1, m, d) AS fy_end,
            CAST(usage_date - CAST({O._pmod7(O._wd('usage_date') + ' - wsw')} AS INTEGER) AS DATE) AS natural_week_start
     FROM (SELECT l.budget_id, l.usage_date, b.fy_start_month AS m, b.fy_start_day AS d, b.week_start_weekday AS wsw,
             CASE WHEN l.usage_date < make_date(year(l.usage_date), b.fy_start_month, b.fy_start_day)
                  THEN make_date(year(l.usage_date) - 1, b.fy_start_month, b.fy_start_day)
                  ELSE make_date(year(l.usage_date), b.fy_start_month, b.fy_start_day) END AS fy_start
           FROM ledger l JOIN budgets b ON l.budget_id = b.budget_id))))""")
def q_fiscal_calendar(spark, sf_dir):
    """CAL1-CAL8, CAL11: calendar facts of every ledger date."""
    from spendpace.functions import fiscal
    from spendpace.operators.ledger import daily_costs
    inp = inputs(spark, sf_dir)
    led = daily_costs(inp.attributed(_CFG)).join(inp.budgets, "budget_id")
    cols = fiscal.calendar_columns(F.col("usage_date"))
    return led.select("budget_id", "usage_date", *[c.alias(n) for n, c in cols.items()])


PLAN_COLS = [("budget_id", "int"), ("as_of", "date"), ("fy_label", "str"), ("week_start", "date"),
             ("week_end", "date"), ("annual_budget", "money"), ("fy_to_date_spend", "dec"),
             ("remaining_budget", "money"), ("remaining_weeks", "ratio"), ("weekly_allowance", "money")]


@register("weekly_plan", PLAN_COLS, ["weekly_plan"], "SELECT * FROM weekly_plan")
def q_weekly_plan(spark, sf_dir):
    """PLN2, AGG8, CAL9: the plan row per budget and plan date."""
    return W.plan_columns(plan_tables(spark, sf_dir)[1].plan)


@register("dow_profile",
          [("budget_id", "int"), ("natural_week_start", "date"), ("weekday", "int"), ("weight", "ratio"),
           ("complete_weeks", "int")],
          ["profile"], "SELECT * FROM profile")
def q_dow_profile(spark, sf_dir):
    """AGG7, CAL11: day-of-week profile of complete trailing weeks."""
    return plan_tables(spark, sf_dir)[1].profile


@register("day_targets",
          [("budget_id", "int"), ("as_of", "date"), ("day", "date"), ("weekday", "int"),
           ("weekday_name", "str"), ("target", "money"), ("cumulative_target", "money")],
          ["targets"], """
  SELECT *, strftime(day, '%a') AS weekday_name,
         SUM(target) OVER (PARTITION BY budget_id, as_of ORDER BY day
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_target
  FROM targets""")
def q_day_targets(spark, sf_dir):
    """PLN3, PLN4, CAL10, WIN1, RPT1: day targets of each plan week."""
    t = plan_tables(spark, sf_dir)[1].targets
    return t.withColumn("weekday_name", F.date_format("day", "EEE"))


@register("calibration",
          [("budget_id", "int"), ("as_of", "date"), ("global_multiplier", "ratio"), ("window_days", "int"),
           ("cur_total", "dec"), ("dbu_total", "dec")],
          ["calibration"], "SELECT * FROM calibration")
def q_calibration(spark, sf_dir):
    """AGG6, JOIN3: all-in / usage multiplier over shared trailing days."""
    return plan_tables(spark, sf_dir)[1].calibration


# --------------------------------------------------------------- inventory --
def check_tables(spark: SparkSession, sf_dir: str, cfg: PaceConfig = _CFG, queue=None):
    from spendpace.plans import check as CK
    inp = inputs(spark, sf_dir, cfg)
    return inp, CK.build_check(inp, cfg, adapter.check_instants(inp.budgets), queue=queue)


def _inventory(spark, sf_dir):
    from spendpace.sources import inventory as INV
    inp = inputs(spark, sf_dir)
    key = _CFG.priority_tag_key
    return (INV.jobs(inp.jobs_raw, key), INV.warehouses(inp.warehouses_raw, key),
            INV.clusters(inp.clusters_raw, key))


@register("inventory_jobs",
          [("budget_id", "int"), ("job_id", "str"), ("name", "str"), ("has_schedule", "bool"),
           ("schedule_paused", "bool"), ("priority", "str")], ["jobs"], "SELECT * FROM jobs")
def q_inventory_jobs(spark, sf_dir):
    """SRC7, PRJ9: jobs with name fallback, schedule state and priority."""
    return _inventory(spark, sf_dir)[0]


@register("inventory_warehouses",
          [("budget_id", "int"), ("warehouse_id", "str"), ("name", "str"), ("cluster_size", "str"),
           ("auto_stop_mins", "int"), ("max_num_clusters", "int"), ("state", "str"), ("priority", "str")],
          ["warehouses"], "SELECT * FROM warehouses")
def q_inventory_warehouses(spark, sf_dir):
    """SRC8, PRJ9: warehouses with defaults and tag-list priority."""
    return _inventory(spark, sf_dir)[1]


@register("inventory_clusters",
          [("budget_id", "int"), ("cluster_id", "str"), ("name", "str"), ("state", "str"),
           ("last_activity_time", "long"), ("priority", "str")], ["clusters"], "SELECT * FROM clusters")
def q_inventory_clusters(spark, sf_dir):
    """SRC9, PRJ9: all-purpose clusters (job clusters dropped)."""
    return _inventory(spark, sf_dir)[2]


@register("workload_meta",
          [("budget_id", "int"), ("workload_type", "str"), ("workload_id", "str"), ("name", "str"),
           ("priority", "str"), ("throttle_order", "int")],
          ["workload_meta"], """
  SELECT *, CASE priority WHEN 'low' THEN 0 WHEN 'normal' THEN 1 WHEN 'critical' THEN 2 END AS throttle_order
  FROM workload_meta""")
def q_workload_meta(spark, sf_dir):
    """SET5, PRJ10: workload -> name, priority, throttle order."""
    from spendpace.functions.tags import throttle_order
    from spendpace.sources import inventory as INV
    j, w, c = _inventory(spark, sf_dir)
    return INV.workload_meta(j, w, c).withColumn("throttle_order", throttle_order(F.col("priority")))


@register("inventory_summary",
          [("budget_id", "int"), ("jobs", "long"), ("scheduled_jobs", "long"), ("paused_jobs", "long"),
           ("warehouses", "long"), ("clusters", "long"), ("running_clusters", "long")],
          ["jobs", "warehouses", "clusters"], """
  SELECT coalesce(j.budget_id, w.budget_id, c.budget_id) AS budget_id,
    coalesce(j.n, 0) AS jobs, coalesce(j.s, 0) AS scheduled_jobs, coalesce(j.p, 0) AS paused_jobs,
    coalesce(w.n, 0) AS warehouses, coalesce(c.n, 0) AS clusters, coalesce(c.r, 0) AS running_clusters
  FROM (SELECT budget_id, COUNT(*) n, COUNT(*) FILTER (WHERE has_schedule) s,
               COUNT(*) FILTER (WHERE schedule_paused) p FROM jobs GROUP BY ALL) j
  FULL JOIN (SELECT budget_id, COUNT(*) n FROM warehouses GROUP BY ALL) w ON w.budget_id = j.budget_id
  FULL JOIN (SELECT budget_id, COUNT(*) n, COUNT(*) FILTER (WHERE state = 'RUNNING') r
             FROM clusters GROUP BY ALL) c ON c.budget_id = coalesce(j.budget_id, w.budget_id)""")
def q_inventory_summary(spark, sf_dir):
    """AGG16: inventory counts per budget."""
    from spendpace.sources import inventory as INV
    return INV.inventory_summary(*_inventory(spark, sf_dir))


# ------------------------------------------------------------- forecasting --
FORECAST_COLS = [("budget_id", "int"), ("as_of", "ts"), ("workload_type", "str"), ("workload_id", "str"),
                 ("name", "str"), ("priority", "str"), ("compute_type", "str"), ("dbu_forecast", "money"),
                 ("multiplier", "ratio"), ("sample_days", "long"), ("forecast_usd", "money"),
                 ("forecast_rank", "int")]


@register("workload_forecast", FORECAST_COLS, ["forecasts"], "SELECT * FROM forecasts")
def q_workload_forecast(spark, sf_dir):
    """AGG9, AGG10, AGG11, FLT7, FLT9, JOIN4, JOIN8, SRT1: rest-of-day
    forecast per workload at every check instant."""
    return check_tables(spark, sf_dir)[1].forecasts


@register("pace_inputs",
          [("budget_id", "int"), ("as_of", "ts"), ("intraday_fraction", "ratio"), ("lag_fill", "money"),
           ("observed_week", "money"), ("observed_today", "money")],
          ["pace_inputs"], "SELECT * FROM pace_inputs")
def q_pace_inputs(spark, sf_dir):
    """AGG12, AGG13, AGG14, FLT8: intraday fraction, lag fill, observed."""
    ct = check_tables(spark, sf_dir)[1]
    return (ct.fraction.join(ct.fill, ["budget_id", "as_of"]).join(ct.observed, ["budget_id", "as_of"]))


def _overridden_check(spark, sf_dir):
    """The checks with the budgets' overrides stored beside the calibration
    and read back."""
    import uuid
    from spendpace.plans import check as CK
    from spendpace.session import checkpoint_dir
    from spendpace.sources import state as SS
    inp = inputs(spark, sf_dir)
    inst = adapter.check_instants(inp.budgets)
    uh = materialize(inp.usage_hourly(*W.usage_window(inst, _CFG)))
    pt = CK.plan_tables(inp, _CFG, inst, uh)
    path = f"{checkpoint_dir(spark)}/calibration-{uuid.uuid4().hex}"
    SS.write_version(SS.with_overrides(pt.calibration, adapter.multiplier_overrides(spark, sf_dir)), path)
    pt.calibration = SS.read_versions(spark, path)
    return CK.build_check(inp, _CFG, inst, pt=pt, usage_hourly=uh)


@register("forecast_overrides", FORECAST_COLS, ["forecasts_overridden"], "SELECT * FROM forecasts_overridden")
def q_forecast_overrides(spark, sf_dir):
    """JOIN8, AGG17: forecasts with stored multipliers by compute type."""
    return _overridden_check(spark, sf_dir).forecasts


@register("observed_overrides",
          [("budget_id", "int"), ("as_of", "ts"), ("observed_week", "money"), ("observed_today", "money")],
          ["observed_overridden"], "SELECT * FROM observed_overridden")
def q_observed_overrides(spark, sf_dir):
    """JOIN8, AGG14: observed dollars with stored multipliers by compute type."""
    return _overridden_check(spark, sf_dir).observed


STATUS_COLS = [("budget_id", "int"), ("as_of", "ts"), ("severity", "str"), ("pace_ratio", "ratio"),
               ("weekly_allowance", "money"), ("spend_week_to_date", "money"),
               ("expected_week_to_date", "money"), ("day_target", "money"), ("spend_today", "money"),
               ("forecast_remaining_today", "money"), ("required_reduction_today", "money"),
               ("projected_week_end", "money"), ("day_headroom", "money")]


@register("budget_status", STATUS_COLS, ["status"], "SELECT * FROM status")
def q_budget_status(spark, sf_dir):
    """PAC1-PAC7, WIN1, WIN2, WIN5: pace status per budget and instant."""
    return check_tables(spark, sf_dir)[1].status


# ---------------------------------------------------------------- decisions --
OPTION_OUT = [("budget_id", "int"), ("as_of", "ts"), ("target_key", "str"), ("kind", "str"),
              ("target_id", "str"), ("target_name", "str"), ("priority", "str"), ("disruption", "int"),
              ("option_seq", "int"), ("estimated_savings", "dec"), ("spot", "bool"),
              ("max_workers_factor", "ratio"), ("min_workers", "int"), ("spot_bid_percent", "int"),
              ("cluster_size", "str"), ("auto_stop_mins", "int"), ("max_num_clusters", "int"),
              ("orig_cluster_size", "str"), ("orig_auto_stop_mins", "int"), ("orig_max_num_clusters", "int")]


@register("lever_options", OPTION_OUT, ["options"], "SELECT * FROM options")
def q_lever_options(spark, sf_dir):
    """LEV1-LEV7, SET2, FLT10, JOIN6, JOIN7, SRT3: every lever option."""
    return check_tables(spark, sf_dir)[1].options


@register("throttle_allocation",
          OPTION_OUT + [("pick_order", "int"), ("left_before", "dec"), ("gap", "dec")],
          ["chosen"], "SELECT * FROM chosen")
def q_throttle_allocation(spark, sf_dir):
    """WIN3, SRT2, DEC1, DEC2, LEV9: the options the greedy allocator takes."""
    return check_tables(spark, sf_dir)[1].chosen


@register("allocation_summary",
          [("budget_id", "int"), ("as_of", "ts"), ("severity", "str"), ("gap", "dec"),
           ("total_estimated_savings", "dec"), ("actions", "long"), ("gap_closed", "bool"),
           ("gap_left", "dec")],
          ["alloc_summary"], "SELECT * FROM alloc_summary")
def q_allocation_summary(spark, sf_dir):
    """DEC4, AGG15: modelled savings against the gap per check."""
    return check_tables(spark, sf_dir)[1].summary


@register("coverage_notes",
          [("budget_id", "int"), ("as_of", "ts"), ("workload_type", "str"), ("workload_id", "str"),
           ("name", "str"), ("forecast_usd", "money"), ("reason", "str"), ("kind", "str"),
           ("option_count", "long"), ("option_savings", "str"), ("detail", "str")],
          ["coverage"], "SELECT * FROM coverage")
def q_coverage_notes(spark, sf_dir):
    """DEC5, RPT3: per forecast workload, its candidates or why none."""
    return check_tables(spark, sf_dir)[1].coverage


# -------------------------------------------------------------- FIFO queue --
@register("release_plan",
          [("budget_id", "int"), ("as_of", "ts"), ("job_id", "str"), ("name", "str"), ("priority", "str"),
           ("est_run_cost", "dec"), ("paused_at", "ts"), ("seq", "long"), ("queue_pos", "int"),
           ("running_cost", "dec"), ("day_headroom", "money"), ("released", "bool")],
          sql_from="SELECT * FROM release_2", sql_builder=O.release_plan_sql)
def q_release_plan(spark, sf_dir):
    """QUE1, QUE2, WIN4, SRT4, JOIN5, JOIN7, AGG15: a live check at the first
    instant pauses jobs into the FIFO queue; every later 6-hourly check
    (with the queued jobs' forecasts removed) decides what the strict-FIFO
    gate would release."""
    from spendpace.operators import queue as QU
    inp = inputs(spark, sf_dir)
    queue, _, later = _live_then(inp, adapter.first_check_instants(inp.budgets),
                                 adapter.release_instants(inp.budgets))
    return QU.release_plan(later.status, queue, _CFG.levers.fifo_release)


REPLAY_COLS = [("budget_id", "int"), ("as_of", "ts"), ("job_id", "str"), ("paused_at", "ts"), ("seq", "long"), ("queue_pos", "int"),
               ("est_run_cost", "dec"), ("running_cost", "dec"), ("day_headroom", "dec"), ("released", "bool")]


def _replayed(spark, sf_dir):
    """Two freezes put scheduled jobs into the queue; the 6-hourly checks after
    the first carry it on."""
    from spendpace.operators import queue as QU
    from spendpace.plans import check as CK
    inp = inputs(spark, sf_dir)
    freezes, checks = adapter.freeze_instants(inp.budgets), adapter.release_instants(inp.budgets)
    ct = CK.build_check(inp, _CFG, freezes.unionByName(checks))
    at_checks = checks.select("budget_id", "as_of")
    entries = materialize(adapter.frozen(QU.freeze(ct.forecasts, ct.jobs)))
    return QU, entries, QU.replay(ct.status.join(at_checks, ["budget_id", "as_of"], "left_semi"),
                                  ct.forecasts.join(at_checks, ["budget_id", "as_of"], "left_semi"), entries, _CFG.levers.fifo_release)


@register("queue_replay", REPLAY_COLS, sql_from="SELECT * FROM replay_rows", sql_builder=O.replay_sql)
def q_queue_replay(spark, sf_dir):
    """WIN4, SRT4, QUE2, QUE3: the queue carried from check to check: the jobs
    that wait at each open gate, those released there gone at the next."""
    return _replayed(spark, sf_dir)[2]


@register("queue_after_replay", [("budget_id", "int"), ("job_id", "str"), ("name", "str"), ("priority", "str"), ("est_run_cost", "dec"),
                                 ("paused_at", "ts"), ("seq", "long")],
          sql_from="SELECT * FROM replay_left", sql_builder=O.replay_sql)
def q_queue_after_replay(spark, sf_dir):
    """SET4, QUE2, QUE3: what still waits after the last check of the replay."""
    QU, entries, told = _replayed(spark, sf_dir)
    return QU.next_queue(entries, entries.limit(0), told, dry_run=False)


def _live_then(inp, first_at, later_at):
    """A live check at ``first_at``, then checks at ``later_at`` that see its
    queue (queued jobs' forecasts removed) and its reversible actions
    (credited against the gap, their targets not offered again). One hourly
    stage and one plan build serve both. Returns (queue, active, later)."""
    from spendpace import config as C
    from spendpace.operators import queue as QU
    from spendpace.plans import check as CK
    both = first_at.unionByName(later_at)
    uh = materialize(inp.usage_hourly(*W.usage_window(both, _CFG)))
    pt = CK.plan_tables(inp, _CFG, both, uh)
    first = CK.build_check(inp, _CFG, first_at, pt=pt, usage_hourly=uh)
    queue = materialize(QU.enqueue(first.chosen))
    active = materialize(QU.applied(first.chosen).filter(
        F.col("kind").isin(*[k for k, r in C.REVERSIBLE.items() if r])))
    later = CK.build_check(inp, _CFG, later_at, queue=queue, active=active, pt=pt, usage_hourly=uh)
    return queue, active, later


def _two_checks(spark, sf_dir):
    """Live checks at TRANSITION_INSTANTS[0] and [1]: two runs over one store,
    the second reading what the first has committed. Returns (module, store,
    the second run)."""
    import uuid
    from spendpace.plans import check as CK
    from spendpace.plans import run as R
    from spendpace.session import checkpoint_dir
    from spendpace.sources.store import StateStore
    inp = inputs(spark, sf_dir)
    first, second = (adapter.transition_instants(inp.budgets, k) for k in (0, 1))
    both = first.unionByName(second)
    uh = materialize(inp.usage_hourly(*W.usage_window(both, _CFG)))
    pt = CK.plan_tables(inp, _CFG, both, uh)
    store = StateStore(spark, f"{checkpoint_dir(spark)}/state-{uuid.uuid4().hex}")
    R.run_check(store, inp, _CFG, first, pt=_of_day(pt, first), usage_hourly=uh)
    return R, store, R.run_check(store, inp, _CFG, second, pt=_of_day(pt, second), usage_hourly=uh)


def _of_day(pt: W.PlanTables, instants: DataFrame) -> W.PlanTables:
    """The plan tables of the instants' own days (a run stores its own plan)."""
    days = W.plan_instants(instants).select("budget_id", "as_of")
    own = lambda df: df.join(days, ["budget_id", "as_of"], "left_semi")
    return W.PlanTables(pt.keys, pt.ledger, pt.profile, own(pt.plan), own(pt.targets), own(pt.calibration))


@register("next_active",
          [("budget_id", "int"), ("kind", "str"), ("target_id", "str"), ("target_name", "str"),
           ("priority", "str"), ("estimated_savings", "dec"), ("applied_at", "ts"), ("seq", "long")],
          sql_from="SELECT * FROM next_active_2", sql_builder=O.transition_sql("next_active_2"))
def q_next_active(spark, sf_dir):
    """SET3, DEC3, QUE3: actions in force after the second check = active -
    reverted at OK (pauses stay with the FIFO queue) - pauses of released
    jobs + the second check's reversible choices."""
    R, store, _ = _two_checks(spark, sf_dir)
    return store.read("active", R.ACTIVE)


@register("next_queue",
          [("budget_id", "int"), ("job_id", "str"), ("name", "str"), ("priority", "str"),
           ("est_run_cost", "dec"), ("paused_at", "ts"), ("seq", "long")],
          sql_from="SELECT * FROM next_queue_2", sql_builder=O.transition_sql("next_queue_2"))
def q_next_queue(spark, sf_dir):
    """SET4, QUE1, QUE2: the deferral queue after the second check = queue +
    the second check's pauses - jobs released by the strict-FIFO gate."""
    R, store, _ = _two_checks(spark, sf_dir)
    return store.read("queue", R.QUEUE)


@register("status_from_log",
          [("budget_id", "int"), ("checked_at", "ts"), ("severity", "str"), ("pace_ratio", "ratio"), ("weekly_allowance", "money"),
           ("global_multiplier", "ratio"), ("shortfall", "dec"), ("applies", "long"), ("reverts", "long"), ("releases", "long"),
           ("open_actions", "long"), ("open_savings", "dec"), ("queued_jobs", "long"), ("queued_cost", "dec")],
          sql_from="SELECT * FROM status_log_2", sql_builder=O.transition_sql("status_log_2"))
def q_status_from_log(spark, sf_dir):
    """SNK2, RPT5, SRC10: the status read model, folded from the events of both
    checks: latest plan, calibration and check, open actions, queue."""
    R, store, _ = _two_checks(spark, sf_dir)
    return R.status_model(R.log(store)).withColumnRenamed("applys", "applies")


@register("check_report",
          [("budget_id", "int"), ("as_of", "ts"), ("severity", "str"), ("gap", "dec"), ("actions", "long"), ("planned_savings", "dec"),
           ("shortfall", "dec"), ("reverted", "long"), ("released_jobs", "str"), ("queue_jobs", "str"), ("queue_cost", "dec")],
          sql_from="SELECT * FROM check_report_2", sql_builder=O.transition_sql("check_report_2"))
def q_check_report(spark, sf_dir):
    """RPT2, RPT3: the second check with its shortfall, reverts, released jobs
    and the queue it leaves."""
    R, store, run = _two_checks(spark, sf_dir)
    return R.check_report(store, run)


# --------------------------------------------------------------- streaming --
def _usage_stream(spark: SparkSession, sf_dir: str):
    """The events as a usage stream, the stored prices, a new output folder."""
    import uuid
    from spendpace.session import checkpoint_dir
    from spendpace.streaming import usage_stream as US
    schema = adapter.table(spark, sf_dir, "events").schema
    events = US.file_stream(spark, sf_dir, schema, glob="events.parquet")
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return US, adapter.usage_from_events(events), materialize(adapter.prices(spark, sf_dir)), base


@register("usage_hourly_stream", REGISTRY["usage_hourly"].columns, ["usage_hourly"], f"""
  SELECT * FROM usage_hourly
  WHERE hour_start + INTERVAL 1 HOUR <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events)
                                        - INTERVAL {_CFG.forecast.usage_lag_hours} HOUR""")
def q_usage_hourly_stream(spark, sf_dir):
    """STR1: streaming hourly rollup (watermark = usage lag, 1-hour windows,
    stream-static price join), run to completion with availableNow. Append
    mode: hours that the watermark has not passed never come out."""
    US, usage, prices, base = _usage_stream(spark, sf_dir)
    US.run_available_now(US.hourly_rollup(usage, prices, _CFG.forecast.usage_lag_hours), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


@register("stream_budget_status", STATUS_COLS, ["status"], "SELECT * FROM status")
def q_stream_budget_status(spark, sf_dir):
    """STR2: the batch pace status of each check instant, once, in the epoch
    whose watermark closes its inputs (event-time timers); all epochs' outputs
    are read."""
    from spendpace.plans import check as CK
    inp = inputs(spark, sf_dir)
    instants = adapter.check_instants(inp.budgets)
    US, usage, prices, base = _usage_stream(spark, sf_dir)

    def status_for(due, hours):
        return CK.build_check(inp, _CFG, due, usage_hourly=hours).status

    US.run_pace(spark, usage, prices, instants, status_for, base, _CFG.forecast.usage_lag_hours, W.days_back(_CFG))
    # every epoch's checks, by partition discovery on the shared file system
    return spark.read.parquet(f"{base}/status").drop("epoch")


# ------------------------------------------------- proposed changes, reports --
@register("job_cluster_changes",
          [("budget_id", "int"), ("as_of", "ts"), ("job_id", "str"), ("origin", "str"), ("key", "str"),
           ("orig_num_workers", "int"), ("num_workers", "int"), ("orig_min_workers", "int"),
           ("min_workers", "int"), ("orig_max_workers", "int"), ("max_workers", "int"),
           ("orig_availability", "str"), ("availability", "str"), ("first_on_demand", "int"),
           ("spot_bid_price_percent", "int")],
          ["spec_changes"], "SELECT * FROM spec_changes")
def q_job_cluster_changes(spark, sf_dir):
    """LEV7, LEV8: nested job-cluster spec rewrites of the chosen throttles
    (flattened: one row per rewritten cluster)."""
    from spendpace.operators import specs as SP
    inp, ct = check_tables(spark, sf_dir)
    return SP.flatten_changes(SP.job_cluster_changes(ct.chosen, adapter.job_specs(spark, sf_dir)))


@register("job_cluster_absolute_caps", REGISTRY["job_cluster_changes"].columns, ["spec_changes_absolute"],
          "SELECT * FROM spec_changes_absolute")
def q_job_cluster_absolute_caps(spark, sf_dir):
    """LEV7, LEV8: the rewrites where most jobs have an absolute worker cap,
    which wins over the factor and never scales a cluster up."""
    from spendpace.operators import specs as SP
    chosen = check_tables(spark, sf_dir)[1].chosen
    job = F.col("target_id").try_cast("bigint")
    chosen = chosen.withColumn("max_workers", F.when(job % 8 != 4, 2 + job % 3))
    return SP.flatten_changes(SP.job_cluster_changes(chosen, adapter.job_specs(spark, sf_dir)))


@register("warehouse_changes",
          [("budget_id", "int"), ("as_of", "ts"), ("warehouse_id", "str"), ("target_name", "str"),
           ("orig_cluster_size", "str"), ("cluster_size", "str"), ("orig_auto_stop_mins", "int"),
           ("auto_stop_mins", "int"), ("orig_max_num_clusters", "int"), ("max_num_clusters", "int"),
           ("estimated_savings", "dec")],
          ["chosen"], """
  SELECT budget_id, as_of, target_id AS warehouse_id, target_name, orig_cluster_size, cluster_size,
         orig_auto_stop_mins, auto_stop_mins, orig_max_num_clusters, max_num_clusters, estimated_savings
  FROM chosen WHERE kind = 'warehouse_throttle'""")
def q_warehouse_changes(spark, sf_dir):
    """LEV9: proposed warehouse settings with the originals."""
    from spendpace.operators import specs as SP
    return SP.warehouse_changes(check_tables(spark, sf_dir)[1].chosen)


@register("check_summary",
          [("budget_id", "int"), ("as_of", "ts"), ("severity", "str"), ("pace_ratio", "ratio"),
           ("spend_week_to_date", "money"), ("expected_week_to_date", "money"), ("spend_today", "money"),
           ("forecast_remaining_today", "money"), ("day_target", "money"),
           ("required_reduction_today", "money"), ("projected_week_end", "money"), ("gap", "dec"),
           ("actions", "long"), ("total_estimated_savings", "dec"), ("gap_closed", "bool")],
          ["status", "alloc_summary"], """
  SELECT s.*, a.gap, a.actions, a.total_estimated_savings, a.gap_closed
  FROM status s JOIN alloc_summary a ON a.budget_id = s.budget_id AND a.as_of = s.as_of""")
def q_check_summary(spark, sf_dir):
    """RPT2: status with the decision summary per check."""
    ct = check_tables(spark, sf_dir)[1]
    return ct.status.join(ct.summary.drop("severity"), ["budget_id", "as_of"])


@register("action_descriptions",
          [("budget_id", "int"), ("as_of", "ts"), ("pick_order", "int"), ("kind", "str"),
           ("target_id", "str"), ("description", "str")],
          ["chosen"], """
  SELECT *, concat_ws('; ', target_name, 'spot=' || CAST(spot AS VARCHAR),
    'max_workers_factor=' || CAST(max_workers_factor AS VARCHAR), 'spot_bid_percent=' || CAST(spot_bid_percent AS VARCHAR),
    'cluster_size=' || cluster_size, 'auto_stop_mins=' || CAST(auto_stop_mins AS VARCHAR),
    'max_num_clusters=' || CAST(max_num_clusters AS VARCHAR),
    'saves=' || CAST(estimated_savings AS VARCHAR)) AS description
  FROM chosen""")
def q_action_descriptions(spark, sf_dir):
    """RPT4: one line per chosen action."""
    from spendpace.operators import specs as SP
    return SP.describe(check_tables(spark, sf_dir)[1].chosen)


# ------------------------------------------------------------------- state --
@register("plan_in_force",
          [("budget_id", "int"), ("as_of", "ts"), ("plan_as_of", "date"), ("fy_label", "str"),
           ("week_start", "date"), ("week_end", "date"), ("weekly_allowance", "money")],
          ["plan_in_force"], "SELECT * FROM plan_in_force")
def q_plan_in_force(spark, sf_dir):
    """SNK1, SRC10, WIN5: plans stored as versions for the check dates are
    read back; each later 6-hourly check takes the latest plan built on or
    before its date whose budget week holds it."""
    import uuid
    from spendpace.session import checkpoint_dir
    from spendpace.sources import state as SS
    inp, pt = plan_tables(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/plans-{uuid.uuid4().hex}"
    SS.write_version(W.plan_columns(pt.plan), path)
    stored = SS.read_versions(spark, path)
    return SS.plan_in_force(stored, adapter.release_instants(inp.budgets))


@register("audit_tail",
          [("budget_id", "int"), ("event_at", "ts"), ("event", "str"), ("weekly_allowance", "money"),
           ("global_multiplier", "ratio"), ("severity", "str"), ("pace_ratio", "ratio"), ("actions", "long"),
           ("recent_rank", "int")],
          ["audit"], """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY budget_id ORDER BY event_at DESC, event DESC) AS recent_rank
                 FROM audit) WHERE recent_rank <= 4""")
def q_audit_tail(spark, sf_dir):
    """SNK2, SRT5, RPT5: plan and check events appended to the audit log
    (partitioned by date), then the last 4 entries per budget."""
    import uuid
    from spendpace.session import checkpoint_dir
    from spendpace.sources import state as SS
    inp, ct = check_tables(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    SS.append_audit(SS.audit_events(plan=ct.plan.plan, calibration=ct.plan.calibration,
                                    status=ct.status, summary=ct.summary), path)
    return SS.audit_tail(SS.read_audit(spark, path), 4)


@register("calibration_in_force",
          [("budget_id", "int"), ("as_of", "ts"), ("global_multiplier", "ratio"), ("window_days", "int"),
           ("calibrated_on", "date")],
          ["calibration_in_force"], "SELECT * FROM calibration_in_force")
def q_calibration_in_force(spark, sf_dir):
    """AGG17, JOIN8: calibrations stored for the check dates are read back;
    each later check uses the latest one made on or before its date, else
    the configured default."""
    import uuid
    from spendpace.session import checkpoint_dir
    from spendpace.sources import state as SS
    inp, pt = plan_tables(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/calibration-{uuid.uuid4().hex}"
    SS.write_version(pt.calibration, path)
    return SS.calibration_in_force(SS.read_versions(spark, path), adapter.release_instants(inp.budgets),
                                   _CFG.forecast.default_infra_multiplier)


@register("ledger_blended", [("budget_id", "int"), ("as_of", "date"), ("usage_date", "date"), ("cost", "dec")],
          ["ledger_blended"], "SELECT * FROM ledger_blended")
def q_ledger_blended(spark, sf_dir):
    """PLN1, JOIN2, FLT6, SRC6: ledger when usage is invoiced separately:
    non-marketplace line items plus priced usage from the FY start through
    each plan date (full outer join on the date)."""
    from spendpace.operators import ledger as L
    from spendpace.operators import plan as P
    cfg = PaceConfig(include_usage_invoice=True)
    inp = inputs(spark, sf_dir, cfg)
    keys = P.plan_keys(W.plan_instants(adapter.check_instants(inp.budgets)))
    return L.blended_ledger(inp.attributed(cfg), inp.usage_daily(), keys)


BLENDED = PaceConfig(include_usage_invoice=True)  # usage is invoiced separately


@register("weekly_plan_blended", PLAN_COLS, ["plan_blended"], "SELECT * FROM plan_blended")
def q_weekly_plan_blended(spark, sf_dir):
    """PLN1, PLN2, FLT6, JOIN2: plan rows where usage is invoiced separately,
    from daily rows that all instants share."""
    return W.plan_columns(plan_tables(spark, sf_dir, BLENDED)[1].plan)


@register("day_targets_blended", REGISTRY["day_targets"].columns, ["targets_blended"], """
  SELECT *, strftime(day, '%a') AS weekday_name,
         SUM(target) OVER (PARTITION BY budget_id, as_of ORDER BY day
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_target
  FROM targets_blended""")
def q_day_targets_blended(spark, sf_dir):
    """PLN3, PLN4, FLT6, JOIN2: day targets where usage is invoiced
    separately; a profile week before the fiscal year holds billing only."""
    t = plan_tables(spark, sf_dir, BLENDED)[1].targets
    return t.withColumn("weekday_name", F.date_format("day", "EEE"))


@register("calibration_blended", REGISTRY["calibration"].columns, ["calibration_blended"], "SELECT * FROM calibration_blended")
def q_calibration_blended(spark, sf_dir):
    """AGG6, JOIN3, FLT6: the multiplier where usage is invoiced separately."""
    return plan_tables(spark, sf_dir, BLENDED)[1].calibration


@register("cur_quality",
          [("rows", "long"), ("rows_with_start", "long"), ("rows_with_cost", "long")],
          ["cur"], """
  SELECT COUNT(*) AS rows, COUNT(l_shipdate) AS rows_with_start,
         COUNT(*) FILTER (l_linestatus <> 'F' OR l_returnflag NOT IN ('A', 'N')) AS rows_with_cost
  FROM lineitem""")
def q_cur_quality(spark, sf_dir):
    """PRJ4: required-column counts over the raw line items, from a delivery
    whose untyped lines have no cost and whose tax lines have text for it."""
    from spendpace.sources import cur as CUR
    kind = F.col("line_item_line_item_type")
    cost = F.when(kind == "Tax", F.lit("n/a")).when(kind.isNotNull(), F.col("line_item_unblended_cost").cast("string"))
    return CUR.required_column_check(adapter.cur_raw(spark, sf_dir).withColumn("line_item_unblended_cost", cost))


@register("revert_all",
          [("budget_id", "int"), ("operation", "str"), ("kind", "str"), ("target_id", "str"),
           ("target_name", "str")],
          sql_from="SELECT * FROM revert_all_1", sql_builder=O.revert_all_sql)
def q_revert_all(spark, sf_dir):
    """QUE4, SET3: after a live check at the first instant (its reversible
    actions become active, its pauses enter the queue), the manual escape
    hatch lists every reversible action to revert and every queued job."""
    from spendpace.operators import queue as QU
    from spendpace.plans import check as CK
    inp = inputs(spark, sf_dir)
    first = CK.build_check(inp, _CFG, adapter.first_check_instants(inp.budgets))
    chosen = first.chosen
    empty = QU.applied(chosen).filter(F.lit(False))
    active = QU.next_active(empty, empty.select("budget_id", "kind", "target_id"), QU.applied(chosen),
                            chosen.select("budget_id", F.col("target_id").alias("job_id"),
                                          F.lit(False).alias("released")), dry_run=False)
    queue = QU.enqueue(chosen)
    return QU.revert_all(active, queue)
