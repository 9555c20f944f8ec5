"""Plan-shape checks: pruned scans, no Python UDFs, partitioned windows,
and the driver contract."""

import datetime as dt
import re

import pytest

import __spark_entry__ as E
from spendpace.plans import queries as Q

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_registry_contract():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 30
    assert set(Q.REGISTRY) <= set(qs)
    for name, query in Q.REGISTRY.items():
        cols = [c for c, _ in query.columns]
        assert len(cols) == len(set(cols)), name


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert [f.name for f in df.schema.fields][:3] == ["budget_id", "as_of", "day"]


def test_billing_scan_is_pruned(spark):
    inp = Q.inputs(spark, SF)
    from spendpace.operators.ledger import daily_costs
    plan = _plan(daily_costs(inp.attributed(Q._CFG)))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan) or re.findall(r"struct<([^>]*)>", plan)
    assert all("l_comment" not in s and "l_tax" not in s and "l_quantity" not in s for s in schemas)


def test_time_bounds_reach_the_scans(spark):
    inp = Q.inputs(spark, SF)
    days = dt.date(2024, 1, 3), dt.date(2024, 1, 5)
    for df, column in ((inp.usage_hourly(*days), "ts"), (inp.attributed(Q._CFG, *days), "l_shipdate")):
        plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        pushed = [p for p in re.findall(r"PushedFilters: \[(.*)\]", plan) if column in p]
        assert pushed and all(f"GreaterThanOrEqual({column}," in p and f"LessThan({column}," in p for p in pushed)
    whole = inp.usage_hourly().where("hour_start >= '2024-01-03' and hour_start < '2024-01-05'")
    assert _rows(inp.usage_hourly(*days)) == _rows(whole)
    whole = inp.attributed(Q._CFG).where("usage_date >= '2024-01-03' and usage_date < '2024-01-05'")
    assert inp.attributed(Q._CFG, *days).count() == whole.count() > 0


@pytest.mark.parametrize("name", ["day_targets", "budget_status"])
def test_plans_and_checks_bound_their_facts(spark, monkeypatch, name):
    from spendpace.sources import adapter
    bounds = []
    for reader in ("usage", "cur_raw"):
        read = getattr(adapter, reader)
        monkeypatch.setattr(adapter, reader, lambda s, d, start=None, end=None, read=read:
                            bounds.append(start) or read(s, d, start, end))
    Q.REGISTRY[name].spark(spark, SF).collect()
    assert len(bounds) == 2 and all(bounds)


@pytest.mark.parametrize("name", ["usage_hourly", "ledger_daily", "weekly_plan", "budget_status"])
def test_no_python_udf(spark, name):
    plan = _plan(Q.REGISTRY[name].spark(spark, SF))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "PythonUDF" not in plan


def test_windows_are_partitioned(spark):
    df = Q.REGISTRY["throttle_allocation"].build(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
        assert spec.split(",")[0].strip().startswith("budget_id"), spec


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_export_round_trip_equals_parquet_ledger(spark):
    """Legacy-layout gzip CSV deliveries with differing header orders give
    the parquet ledger exactly."""
    assert _rows(Q.REGISTRY["cur_csv_ledger"].spark(spark, SF)) == _rows(Q.REGISTRY["ledger_daily"].spark(spark, SF))


def test_redelivered_period_is_flagged(spark):
    rows = Q.REGISTRY["cur_delivery_duplicates"].spark(spark, SF).collect()
    assert rows and all(r.copies == 2 and r.billing_period == "20240101-20240201" for r in rows)
    assert all("assembly=1" in r.first_path and "assembly=2" in r.last_path for r in rows)


def test_redelivery_exports_every_period(spark, tmp_path):
    from spendpace.sources import adapter
    from spendpace.sources import cur as CUR
    root = adapter.write_cur_redelivery(spark, SF, str(tmp_path))
    counts = [spark.read.option("header", "true").csv(f"{root}/{p}").groupBy("assembly").count().collect() for p in adapter.CSV_PERIODS]
    first, second = ({r["assembly"]: r["count"] for r in rows} for rows in counts)
    assert set(first) == {1} and set(second) == {1, 2} and second[1] == second[2]
    assert first[1] + second[1] == adapter.cur_raw(spark, SF).count()
    paths = [r["path"].split(root)[1] for r in CUR.delivery_paths(spark, root).collect()]
    assert sorted(paths) == sorted(f.split(root)[1] for f in CUR.list_csv_files(spark, root))


def test_state_after_two_checks(spark):
    """Next queue = queue + new pauses - released; next actions never hold a
    revert target or a released job's pause."""
    act = Q.REGISTRY["next_active"].spark(spark, SF).collect()
    keys = [(r.budget_id, r.kind, r.target_id) for r in act]
    assert len(keys) == len(set(keys))
    assert all(r.kind != "idle_cluster_terminate" for r in act)  # not reversible: never held
    q = Q.REGISTRY["next_queue"].spark(spark, SF).collect()
    assert len({(r.budget_id, r.job_id) for r in q}) == len(q)


def test_scale_settings_bounds():
    from spendpace.session import MAX_SHUFFLE_PARTITIONS, scale_settings
    big = scale_settings(100 * 1024 ** 4)
    assert int(big["spark.sql.shuffle.partitions"]) == MAX_SHUFFLE_PARTITIONS
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 256 * 1024 ** 2
    assert int(scale_settings(10 ** 6)["spark.sql.shuffle.partitions"]) == 200
    assert int(scale_settings(10 * 1024 ** 4)["spark.sql.shuffle.partitions"]) == 2560


def test_scale_settings_keep_explicit_shuffle_count(spark):
    """A session that chose its shuffle partition count keeps it, and AQE's
    initial count is not raised behind its back."""
    from spendpace.session import apply_scale_settings
    before = spark.conf.get("spark.sql.shuffle.partitions")
    applied = apply_scale_settings(spark, 100 * 1024 ** 4)
    assert "spark.sql.shuffle.partitions" not in applied
    assert "spark.sql.adaptive.coalescePartitions.initialPartitionNum" not in applied
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
