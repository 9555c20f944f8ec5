"""Nested job-cluster spec rewrites, state tables, streaming rollup."""

import datetime as dt
import tempfile
import time
from decimal import Decimal

from pyspark.sql import functions as F

from spendpace.operators import specs as SP
from spendpace.sources import state as SS

SPEC = ("struct<num_workers:int, autoscale:struct<min_workers:int,max_workers:int>,"
        " aws_attributes:struct<availability:string,first_on_demand:int,spot_bid_price_percent:int>>")


def rewrite(spark, spec, spot=None, factor=None, min_workers=None, bid=None):
    df = spark.createDataFrame([(spec, spot, factor, min_workers, bid)],
                               f"s {SPEC}, spot boolean, f double, m int, b int")
    out = df.select(SP.throttle_spec(F.col("s"), F.col("spot"), F.col("f"), F.col("m"), F.col("b")).alias("o"))
    return out.first().o


def test_fixed_size_cap(spark):
    o = rewrite(spark, (8, None, ("ON_DEMAND", None, None)), spot=True, factor=0.5, min_workers=1)
    assert o.num_workers == 4
    assert o.aws_attributes.availability == "SPOT" and o.aws_attributes.first_on_demand == 1


def test_autoscale_cap(spark):
    o = rewrite(spark, (None, (2, 10), None), factor=0.5, min_workers=1)
    assert (o.autoscale.min_workers, o.autoscale.max_workers) == (2, 5)


def test_cap_never_scales_up(spark):
    o = rewrite(spark, (2, None, None), factor=0.5, min_workers=3)
    assert o.num_workers == 2


def test_absolute_cap_wins_and_never_scales_up(spark):
    df = spark.createDataFrame([((8, None, None), 0.5, 3), ((2, None, None), 0.5, 3), ((None, (6, 10), None), None, 4),
                                ((8, None, None), 0.25, None)], f"s {SPEC}, f double, a int")
    out = [r.o for r in df.select(SP.throttle_spec(F.col("s"), F.lit(None).cast("boolean"), F.col("f"), F.lit(1),
                                                   F.lit(None).cast("int"), F.col("a")).alias("o")).collect()]
    assert [o.num_workers for o in out] == [3, 2, None, 2]
    assert (out[2].autoscale.min_workers, out[2].autoscale.max_workers) == (4, 4)


def test_overrides_stored_with_their_calibration(spark):
    path = tempfile.mkdtemp(prefix="spendpace-cal-") + "/calibration"
    calib = lambda day, m: spark.createDataFrame([(b, dt.date(2026, 7, day), m, 28) for b in (0, 1)],
                                                 "budget_id int, as_of date, global_multiplier double, window_days int")
    given = spark.createDataFrame([(0, "SQL", 2.0, 1), (0, "SQL", 2.5, 2), (0, None, 9.0, 3), (0, "JOBS", None, 4)],
                                  "budget_id int, compute_type string, multiplier double, set_seq long")
    SS.write_version(calib(5, 1.5), path)
    SS.write_version(SS.with_overrides(calib(7, 1.7), given), path)
    checks = spark.createDataFrame([(b, dt.datetime(2026, 7, d, 9)) for b in (0, 1, 2) for d in (6, 8)], "budget_id int, as_of timestamp")
    got = {(r.budget_id, r.as_of.day): (r.global_multiplier, r.overrides) for r in SS.calibration_in_force(SS.read_versions(spark, path), checks, 1.6).collect()}
    assert got == {(0, 6): (1.5, None), (0, 8): (1.7, {"SQL": 2.5}), (1, 6): (1.5, None), (1, 8): (1.7, None),
                   (2, 6): (1.6, None), (2, 8): (1.6, None)}


def test_bid_forces_spot_and_keeps_first_on_demand(spark):
    o = rewrite(spark, (4, None, ("ON_DEMAND", 2, None)), bid=60)
    assert o.aws_attributes.availability == "SPOT"
    assert o.aws_attributes.spot_bid_price_percent == 60
    assert o.aws_attributes.first_on_demand == 2 and o.num_workers == 4


def test_job_cluster_changes_arrays(spark):
    chosen = spark.createDataFrame(
        [(0, dt.datetime(2026, 7, 7, 15), "job_cluster_throttle", "101", True, 0.75, 1, None)],
        "budget_id int, as_of timestamp, kind string, target_id string, spot boolean,"
        " max_workers_factor double, min_workers int, spot_bid_percent int")
    specs = spark.createDataFrame(
        [(0, "101", [("main", (8, None, ("ON_DEMAND", None, None)))],
          [("a", None), ("b", (None, (2, 10), None))])],
        f"budget_id int, job_id string, job_clusters array<struct<job_cluster_key:string, new_cluster:{SPEC}>>,"
        f" tasks array<struct<task_key:string, new_cluster:{SPEC}>>")
    flat = {(r.origin, r.key): r for r in SP.flatten_changes(SP.job_cluster_changes(chosen, specs)).collect()}
    assert flat[("job_cluster", "main")].num_workers == 6
    assert flat[("job_cluster", "main")].orig_num_workers == 8
    assert flat[("task", "b")].max_workers == 7 and flat[("task", "b")].min_workers == 2
    assert ("task", "a") not in flat


def test_versions_and_plan_in_force(spark):
    path = tempfile.mkdtemp(prefix="spendpace-plans-") + "/plans"
    rows = [(0, dt.date(2026, 7, 5), dt.date(2026, 7, 5), dt.date(2026, 7, 12), 100.0),
            (0, dt.date(2026, 7, 7), dt.date(2026, 7, 5), dt.date(2026, 7, 12), 120.0),
            (0, dt.date(2026, 7, 12), dt.date(2026, 7, 12), dt.date(2026, 7, 19), 90.0)]
    schema = "budget_id int, as_of date, week_start date, week_end date, weekly_allowance double"
    SS.write_version(spark.createDataFrame(rows[:2], schema), path)
    SS.write_version(spark.createDataFrame(rows[2:], schema), path)
    # rewriting one version replaces only that version
    SS.write_version(spark.createDataFrame([(0, dt.date(2026, 7, 7), dt.date(2026, 7, 5),
                                             dt.date(2026, 7, 12), 125.0)], schema), path)
    stored = SS.read_versions(spark, path)
    assert stored.count() == 3
    checks = spark.createDataFrame([(0, dt.datetime(2026, 7, 6, 9)), (0, dt.datetime(2026, 7, 8, 9)),
                                    (0, dt.datetime(2026, 7, 13, 9)), (0, dt.datetime(2026, 7, 20, 9))],
                                   "budget_id int, as_of timestamp")
    got = {r.as_of.day: r.weekly_allowance for r in SS.plan_in_force(stored, checks).collect()}
    assert got == {6: 100.0, 8: 125.0, 13: 90.0}


def test_calibration_in_force_and_audit(spark):
    stored = spark.createDataFrame([(0, dt.date(2026, 7, 5), 1.3, 20)],
                                   "budget_id int, as_of date, global_multiplier double, window_days int")
    checks = spark.createDataFrame([(0, dt.datetime(2026, 7, 4, 9)), (0, dt.datetime(2026, 7, 6, 9))],
                                   "budget_id int, as_of timestamp")
    got = {r.as_of.day: r.global_multiplier for r in SS.calibration_in_force(stored, checks, 1.6).collect()}
    assert got == {4: 1.6, 6: 1.3}
    status = spark.createDataFrame([(0, dt.datetime(2026, 7, 6, h), "OK", 0.5, 0.0) for h in range(6)],
                                   "budget_id int, as_of timestamp, severity string, pace_ratio double,"
                                   " required_reduction_today double")
    path = tempfile.mkdtemp(prefix="spendpace-audit-") + "/audit"
    SS.append_audit(SS.audit_events(status=status), path)
    SS.append_audit(SS.audit_events(status=status.withColumn("as_of", F.col("as_of") + F.expr("INTERVAL 1 DAY"))),
                    path)
    tail = SS.audit_tail(SS.read_audit(spark, path), 3).orderBy("recent_rank").collect()
    assert [r.event_at.hour for r in tail] == [5, 4, 3] and all(r.event_at.day == 7 for r in tail)


def test_streaming_rollup_matches_batch_for_closed_hours(spark):
    from spendpace.sources import adapter
    from spendpace.sources import usage as U
    from spendpace.streaming import usage_stream as US
    sf = "/root/testdata/sf0.001"
    schema = adapter.table(spark, sf, "events").schema
    stream = US.file_stream(spark, sf, schema, glob="events.parquet")
    prices = adapter.prices(spark, sf)
    rollup = US.hourly_rollup(adapter.usage_from_events(stream), prices, 3)
    base = tempfile.mkdtemp(prefix="spendpace-stream-")
    US.run_available_now(rollup, f"{base}/out", f"{base}/ckpt")
    streamed = spark.read.parquet(f"{base}/out")
    max_ts = adapter.table(spark, sf, "events").agg(F.max("ts")).first()[0]
    cutoff = max_ts - dt.timedelta(hours=3)
    batch = (U.hourly_usage(adapter.usage(spark, sf), prices)
             .filter(F.col("hour_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(cutoff).cast("timestamp")))
    cols = ["budget_id", "hour_start", "compute_type", "workload_type", "workload_id", "dbu_dollars"]
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and len(a) > 0
    assert all(isinstance(r[5], Decimal) for r in a[:3])


def test_stream_status_computes_each_check_once_across_epochs(spark):
    """Events arrive as three time-ordered files, one per trigger, so the
    watermark advances over several epochs. Every check's status is written
    exactly once, in the epoch that closes its inputs, and equals the batch
    status computed from all usage."""
    import os
    from spendpace.plans import check as CK
    from spendpace.plans.queries import CFG, inputs
    from spendpace.sources import adapter
    from spendpace.streaming import usage_stream as US
    sf = "/root/testdata/sf0.001"
    ev = adapter.table(spark, sf, "events")
    base = tempfile.mkdtemp(prefix="spendpace-stream-epochs-")
    ts = F.col("ts").cast("timestamp")
    cuts = [F.lit(d).cast("timestamp") for d in ("2024-01-20", "2024-01-26")]
    for i, cond in enumerate([ts < cuts[0], (ts >= cuts[0]) & (ts < cuts[1]), ts >= cuts[1]]):
        ev.filter(cond).coalesce(1).write.parquet(os.path.join(base, "in", f"chunk={i}"))
        time.sleep(1.1)  # file modification order = arrival order
    stream = US.file_stream(spark, os.path.join(base, "in"), ev.schema, max_files=1)
    inp = inputs(spark, sf)
    instants = adapter.check_instants(inp.budgets)
    read = []

    def status_for(due, hours):
        read.append(hours.agg(F.min("usage_date"), F.max("usage_date")).first())
        return CK.build_check(inp, CFG, due, usage_hourly=hours).status

    usage = adapter.usage_from_events(stream)
    US.run_pace(spark, usage, adapter.prices(spark, sf), instants, status_for, os.path.join(base, "out"), 3, 14)
    out = spark.read.parquet(os.path.join(base, "out", "status"))
    per_epoch = {r.epoch: r.n for r in out.groupBy("epoch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(per_epoch) >= 2  # checks became ready in different epochs
    cols = ["budget_id", "as_of", "severity", "pace_ratio", "spend_week_to_date", "forecast_remaining_today",
            "observed_week", "lag_fill"]
    got = sorted((r[0], r[1], r[2], *[round(x, 6) for x in r[3:]]) for r in out.select(*cols).collect())
    # 14 days of hours are what the batch has here, too
    hours = inp.usage_hourly(dt.date(2024, 1, 9), dt.date(2024, 1, 29))
    batch = CK.build_check(inp, CFG, instants, usage_hourly=hours).status
    want = {r[:2]: (*r[:3], *[round(x, 6) for x in r[3:]]) for r in map(tuple, batch.select(*cols).collect())}
    assert len(got) == len(want) == instants.count()
    assert [r[:3] for r in got] == sorted(r[:3] for r in want.values())
    assert min(r[0] for r in read) >= dt.date(2024, 1, 9)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_checks_fire_by_watermark_without_later_usage(spark):
    """A quiet stretch: nothing is used after 02:10 until one row next day. Each
    check fires when the watermark passes its inputs, for the budget without
    usage as well; a check beyond the watermark waits."""
    import os
    from spendpace.streaming import usage_stream as US
    base = tempfile.mkdtemp(prefix="spendpace-stream-quiet-")
    t = lambda *x: dt.datetime(2026, 7, *x)
    schema = "budget_id int, usage_start_time timestamp"
    for i, part in enumerate([[(0, t(7, 1)), (0, t(7, 2, 10))], [(0, t(8, 9))], [(0, t(8, 9, 5))]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(base, "in", f"chunk={i}"))
        time.sleep(1.1)
    stream = US.file_stream(spark, os.path.join(base, "in"), spark.createDataFrame([], schema).schema, max_files=1)
    instants = spark.createDataFrame([(b, t(*x)) for b in (0, 7) for x in ((7, 1), (7, 12), (7, 20), (8, 8), (8, 20))], "budget_id int, as_of timestamp")
    before = spark.conf.get(US._STATE_STORE[0], None)
    spark.conf.set(*US._STATE_STORE)
    try:
        q = US.due_checks(stream, instants, 3).writeStream.outputMode("append").format("parquet").option("path", f"{base}/due")
        q.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(US._STATE_STORE[0], before) if before else spark.conf.unset(US._STATE_STORE[0])
    got = sorted(tuple(r) for r in spark.read.parquet(f"{base}/due").collect())
    assert got == [(b, t(*x)) for b in (0, 7) for x in ((7, 1), (7, 12), (7, 20), (8, 8))]
