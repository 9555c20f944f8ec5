"""What a check and the streaming pace read, write and share."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from spendpace.config import PaceConfig
from spendpace.operators import forecast as FC
from spendpace.plans import check as CK
from spendpace.plans import weekly as W
from spendpace.session import materialize
from spendpace.sources.store import StateStore
from spendpace.streaming import usage_stream as US

HOURS = "budget_id int, hour_start timestamp, compute_type string, workload_type string, workload_id string, dbu_dollars decimal(38,21)"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_an_epoch_writes_a_date_by_few_tasks_and_stages_its_checks(spark):
    """Files number tasks plus dates, not their product; the checks given to the
    status are stored rows, not a scan of the epoch's batch."""
    first, days, parts = dt.datetime(2026, 6, 1), 30, 8
    rows = [(k % 5, first + dt.timedelta(days=k % days, hours=k % 24), "JOBS", "JOB", str(k), Decimal(k)) for k in range(3000)]
    hours = spark.createDataFrame(rows, HOURS).withColumn("as_of", F.lit(None).cast("timestamp")).repartition(parts, "workload_id")
    at = first + dt.timedelta(days=20, hours=15)
    instants = spark.createDataFrame([(b, at, 100.0 + b) for b in range(7)], "budget_id int, as_of timestamp, annual_budget double")
    due = instants.filter("budget_id < 6").select(*[F.lit(None).cast(hours.schema[c].dataType).alias(c) if c not in ("budget_id", "as_of") else c
                                                    for c in hours.columns])
    base, seen = tempfile.mkdtemp(prefix="spendpace-epoch-"), []

    def status_for(checks, stored):
        seen.append((checks.inputFiles(), stored.agg(F.min("usage_date"), F.max("usage_date")).first()))
        return checks

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in the session of a stream
    try:
        handle = US.foreach_batch_pace(spark, instants, status_for, base, 14)
        for _ in range(2):  # a retried epoch replaces its own output
            handle(hours.unionByName(due), 3)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    files = [f for _, _, names in os.walk(f"{base}/hours") for f in names if f.endswith(".parquet")]
    assert days <= len(files) <= parts + days
    kept = spark.read.parquet(f"{base}/hours").select(*[f.split()[0] for f in HOURS.split(", ")])
    assert sorted(map(tuple, kept.collect())) == sorted(rows)
    assert sorted(r.budget_id for r in spark.read.parquet(f"{base}/status").collect()) == list(range(6))
    for files, bounds in seen:
        assert files and tuple(bounds) == (dt.date(2026, 6, 7), dt.date(2026, 6, 21))


def checked(spark):
    """A check of two budgets over stored hours, its queue empty in a store."""
    at = dt.datetime(2026, 7, 7, 15)
    rows = [(b, at - dt.timedelta(days=d, hours=h), t, "JOB", str(w), Decimal(w + h)) for b in (0, 1) for d in range(1, 40) for h in (1, 6)
            for w in range(4) for t in (("JOBS",) if d < 20 else ("JOBS", "SQL", "SQL2"))]
    raw = spark.createDataFrame([(0, "1", None, None, None), (1, "2", "two", {"budget-priority": "low"}, ("PAUSED",))],
                                "budget_id int, job_id string, name string, tags map<string,string>, schedule struct<pause_status:string>")
    inp = W.Inputs(None, None, None, None, lambda: raw, None, None)
    instants = spark.createDataFrame([(0, at), (1, at)], "budget_id int, as_of timestamp")
    return inp, materialize(spark.createDataFrame(rows, HOURS)), instants


def test_checks_share_inventory_and_read_days_without_shuffling_hours(spark):
    inp, hours, instants = checked(spark)
    one, two = (CK.build_check(inp, PaceConfig(), instants, usage_hourly=hours) for _ in range(2))
    assert one.jobs is two.jobs and one.jobs.count() == 2 and one.jobs.inputFiles()
    assert one.pool_days.inputFiles()
    for df in (one.history, one.modes):
        assert "SortMergeJoin" not in plan(df) and "BroadcastHashJoin" in plan(df)
    # other types were more frequent only before the window
    assert {r.compute_type for r in one.modes.collect()} == {"JOBS"} and one.modes.count() == 8
    assert "LeftSemi" in plan(one.modes)  # days out of the window are not counted at all


def test_observed_filters_hours_where_they_are_read(spark):
    inp, hours, instants = checked(spark)
    keys = FC.check_keys(instants, 3)
    # a plan may be taken for large by its inputs, whatever it holds
    big = spark.range(100_000).select((F.col("id") % 2).cast("int").alias("budget_id"), F.lit("2026-07-07").cast("date").alias("today"),
                                      F.date_sub(F.lit("2026-07-07").cast("date"), 2).alias("week_start"))
    week = big.distinct()
    rates = week.select("budget_id", "today", F.lit(2.0).alias("global_multiplier"))
    got = FC.observed(keys, hours, week, rates, PaceConfig().forecast)
    semi = [line for line in plan(got).splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
    # 5 and 6 July: four workloads (0 to 3) at two hours, w + h dollars each, at the multiplier of 2
    dollars = 2.0 * 2 * sum(w + h for w in range(4) for h in (1, 6))
    assert sorted(tuple(r) for r in got.select("budget_id", "observed_week").collect()) == [(0, dollars), (1, dollars)]


def test_an_empty_state_table_costs_no_tasks(spark):
    store = StateStore(spark, tempfile.mkdtemp(prefix="spendpace-store-"))
    schema = "budget_id int, job_id string, est_run_cost decimal(18,4), paused_at timestamp"
    empty = store.read("queue", schema)
    assert empty.schema == spark.createDataFrame([], schema).schema and empty.collect() == []
    joined = spark.range(5).select(F.col("id").cast("int").alias("budget_id")).join(empty, "budget_id", "left_anti")
    assert "Join" not in plan(joined) and joined.count() == 5
