"""End to end over a synthetic fiscal year: $240/day, a hot Tuesday."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import NOW, hourly_history, usage_df
from spendpace.config import PaceConfig
from spendpace.operators import ledger as L
from spendpace.operators import plan as P
from spendpace.plans import check as CK
from spendpace.plans import weekly as W
from spendpace.sources import cur as CUR

FY_START = dt.date(2025, 10, 1)
# Schedules, amounts and names of known totals.
# One row per workload: compute type, kind, id, then dollars an hour and the hours
# of an ordinary day, and the same of the hot day.
SCHEDULE = """
JOBS         JOB        101  60  2,20                       120  2
SQL          WAREHOUSE  wh1  20  13,14,15,16                 40  13,14
ALL_PURPOSE  CLUSTER    c1    4  9,10,11,12,13,14,15,16,17,18  8  9,10,11,12,13,14
"""


def day_of(first_column):
    """The schedule's (compute, kind, id, hour, dollars) from the columns of one
    of its days."""
    out = []
    for line in SCHEDULE.strip().splitlines():
        cell = line.split()
        out += [(*cell[:3], int(h), float(cell[first_column])) for h in cell[first_column + 1].split(",")]
    return out


NORMAL_DAY, HOT_TODAY = day_of(3), day_of(5)


def usage_rows():
    return hourly_history(NOW, 15, NORMAL_DAY) + hourly_history(NOW + dt.timedelta(days=1), 1, HOT_TODAY)


@pytest.fixture(scope="module")
def world(spark):
    raw = spark.sql(f"""
      SELECT timestamp(day) AS line_item_usage_start_date, 240D AS line_item_unblended_cost,
             'Usage' AS line_item_line_item_type, '111122223333' AS line_item_usage_account_id,
             'Databricks, Inc.' AS line_item_legal_entity, 'AWS Marketplace' AS bill_billing_entity,
             'Databricks Lakehouse' AS product_product_name, CAST(NULL AS STRING) AS resource_tags_user_Vendor
      FROM (SELECT explode(sequence(DATE'{FY_START}', DATE'{NOW.date()}' - INTERVAL 3 DAYS)) AS day)""")
    cfg = PaceConfig()
    cur = CUR.normalize(raw, cfg).withColumn("budget_id", F.lit(0))
    budgets = spark.createDataFrame([(0, 79000.0, 10, 1, 6)], "budget_id int, annual_budget double,"
                                    " fy_start_month int, fy_start_day int, week_start_weekday int")
    now_ms = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    inputs = W.Inputs(
        cur=cur, usage=None, prices=None, budgets=budgets,
        jobs_raw=spark.createDataFrame([(0, "101", "nightly-etl", {"budget-priority": "low"}, ("UNPAUSED",))],
                                       "budget_id int, job_id string, name string, tags map<string,string>,"
                                       " schedule struct<pause_status:string>"),
        warehouses_raw=spark.createDataFrame([(0, "wh1", "analytics", "Large", 120, 3, "RUNNING", [])],
                                             "budget_id int, id string, name string, cluster_size string,"
                                             " auto_stop_mins int, max_num_clusters int, state string,"
                                             " custom_tags array<struct<key:string,value:string>>"),
        clusters_raw=spark.createDataFrame([(0, "c1", "adhoc", "RUNNING", "UI", {}, now_ms - 90 * 60000)],
                                           "budget_id int, cluster_id string, cluster_name string, state string,"
                                           " cluster_source string, custom_tags map<string,string>,"
                                           " last_activity_time bigint"))
    uh = usage_df(spark, usage_rows())
    instants = budgets.withColumn("as_of", F.lit(NOW).cast("timestamp"))
    ct = CK.build_check(inputs, cfg, instants, usage_hourly=uh)
    return inputs, ct, uh, cfg


def test_plan(world):
    _, ct, _, _ = world
    p = ct.plan.plan.first()
    assert float(p.fy_to_date_spend) == 277 * 240.0
    assert p.remaining_budget == 12520.0
    assert abs(p.weekly_allowance - 12520.0 * 7 / 88) < 1e-9
    t = ct.plan.targets.collect()
    assert all(abs(r.target - p.weekly_allowance / 7) < 1e-9 for r in t)
    assert abs(ct.plan.calibration.first().global_multiplier - 1.0) < 1e-12


def test_status(world):
    _, ct, _, _ = world
    s = ct.status.first()
    assert s.severity == "CRITICAL"
    assert abs(s.spend_today - 196.0) < 1e-9
    assert abs(s.spend_week_to_date - 676.0) < 1e-9
    assert abs(s.forecast_remaining_today - 116.0) < 1e-9
    assert abs(s.required_reduction_today - (196 + 116 - 12520.0 / 88)) < 1e-9
    expected = 2 * 12520.0 / 88 + 12520.0 / 88 * 124 / 240
    assert abs(s.expected_week_to_date - expected) < 1e-9
    assert abs(s.pace_ratio - 676.0 / expected) < 1e-12
    fc = {r.workload_id: r.forecast_usd for r in ct.forecasts.collect()}
    assert fc == {"101": 60.0, "wh1": 40.0, "c1": 16.0}


def test_options_and_allocation(world):
    _, ct, _, _ = world
    opts = {}
    for r in ct.options.orderBy("target_key", "option_seq").collect():
        opts.setdefault(r.kind, []).append(float(r.estimated_savings))
    assert opts["job_cluster_throttle"] == [31.2, 34.14, 37.08, 40.356]
    assert opts["warehouse_throttle"] == [4.0, 22.0, 31.0, 35.5, 37.75]
    assert opts["idle_cluster_terminate"] == [16.0]
    assert opts["job_schedule_pause"] == [60.0]
    chosen = [(r.kind, float(r.estimated_savings)) for r in ct.chosen.orderBy("pick_order").collect()]
    assert chosen == [("job_cluster_throttle", 40.356), ("job_schedule_pause", 60.0),
                      ("idle_cluster_terminate", 16.0), ("warehouse_throttle", 37.75)]
    s = ct.summary.first()
    assert float(s.total_estimated_savings) == 154.106
    assert abs(float(s.gap_left) - 15.6213) < 1e-4 and s.gap_closed is False
    wh = ct.chosen.filter("kind = 'warehouse_throttle'").first()
    assert (wh.cluster_size, wh.auto_stop_mins, wh.max_num_clusters) == ("2X-Small", 10, 1)


def test_coverage(world):
    _, ct, _, _ = world
    reasons = sorted((r.workload_id, r.reason, r.kind) for r in ct.coverage.collect())
    assert reasons == [("101", "candidate", "job_cluster_throttle"), ("101", "candidate", "job_schedule_pause"),
                       ("c1", "candidate", "idle_cluster_terminate"), ("wh1", "candidate", "warehouse_throttle")]


def test_active_throttles_are_credited(world, spark):
    inputs, _, uh, cfg = world
    active = spark.createDataFrame(
        [(0, "job_cluster_throttle", "101", "nightly-etl", "low", Decimal("100"), NOW, 1)],
        "budget_id int, kind string, target_id string, target_name string, priority string,"
        " estimated_savings decimal(18,4), applied_at timestamp, seq bigint")
    instants = inputs.budgets.withColumn("as_of", F.lit(NOW).cast("timestamp"))
    ct = CK.build_check(inputs, cfg, instants, active=active, usage_hourly=uh)
    kinds = {r.kind for r in ct.options.collect()}
    assert "job_cluster_throttle" not in kinds
    assert abs(float(ct.gap.first().gap) - (196 + 116 - 12520.0 / 88 - 100)) < 1e-4


def test_queued_job_forecast_removed(world, spark):
    inputs, _, uh, cfg = world
    queue = spark.createDataFrame([(0, "101")], "budget_id int, job_id string")
    instants = inputs.budgets.withColumn("as_of", F.lit(NOW).cast("timestamp"))
    ct = CK.build_check(inputs, cfg, instants, queue=queue, usage_hourly=uh)
    assert {r.workload_id for r in ct.forecasts.collect()} == {"wh1", "c1"}


def test_blended_ledger(world, spark):
    inputs, _, uh, _ = world
    cfg = PaceConfig(include_usage_invoice=True)
    usage_daily = (uh.withColumn("usage_date", F.to_date("hour_start")).groupBy("budget_id", "usage_date")
                   .agg(F.sum("dbu_dollars").alias("dbu_dollars")))
    keys = P.plan_keys(inputs.budgets.withColumn("as_of", F.lit(NOW.date())))
    led = L.blended_ledger(inputs.attributed(cfg), usage_daily, keys)
    plan = P.weekly_plan(led, keys).first()
    assert float(plan.fy_to_date_spend) == 13 * 240.0
    mk = L.attribution_summary(L.attribute(inputs.cur, cfg)).first()
    assert float(mk.marketplace_cost) == 277 * 240.0
