"""Commits of state between runs, and the status folded from the event log."""

from __future__ import annotations

import collections
import datetime as dt
import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendpace.plans import run as R
from spendpace.sources.store import Conflict, StateStore

AT = dt.datetime(2026, 7, 7)


@pytest.fixture()
def store(spark):
    return StateStore(spark, tempfile.mkdtemp(prefix="spendpace-store-"))


def table(spark, *rows):
    return spark.createDataFrame(rows, "a int, b string")


def test_commits_follow_each_other(spark, store):
    assert store.current() == 0 and store.read("t", "a int, b string").count() == 0
    assert store.commit({"t": table(spark, (1, "x")), "log": table(spark, (1, "one"))}, 0) == 1
    assert store.commit({"t": table(spark, (2, "y")), "log": table(spark, (2, "two"))}, 1) == 2
    assert store.commit({"log": table(spark, (3, "three"))}, 2) == 3
    assert [tuple(r) for r in store.read("t", "a int, b string", 2).collect()] == [(2, "y")]
    assert store.read("t", "a int, b string").count() == 0  # the last commit has no such table
    assert sorted(r["b"] for r in store.history("log", "a int, b string").collect()) == ["one", "three", "two"]


def test_the_second_of_two_runs_fails(spark, store):
    store.commit({"t": table(spark, (1, "x"))}, 0)
    base = store.current()
    store.commit({"t": table(spark, (2, "first"))}, base)
    with pytest.raises(Conflict):
        store.commit({"t": table(spark, (3, "second"))}, base)
    assert [r["b"] for r in store.read("t", "a int, b string").collect()] == ["first"]


def test_a_crash_between_writes_leaves_the_old_state(spark, store):
    store.commit({"active": table(spark, (1, "old")), "queue": table(spark, (1, "old"))}, 0)
    broken = table(spark, (1, "x")).select("a", F.raise_error(F.lit("lost")).cast("string").alias("b"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"active": table(spark, (2, "new")), "queue": broken}, 1)
    assert store.current() == 1
    assert [r["b"] for n in ("active", "queue") for r in store.read(n, "a int, b string").collect()] == ["old", "old"]
    assert store.commit({"active": table(spark, (3, "next")), "queue": table(spark, (3, "next"))}, 1) == 2


def test_revert_all_is_logged_and_empties_the_state(spark, store):
    active = spark.createDataFrame([(0, "job_schedule_pause", "7", "j7", "low", Decimal(5), AT, 1), (0, "idle_cluster_terminate", "c", "c", "low", Decimal(2), AT, 2),
                                    (1, "warehouse_throttle", "w", "w", "low", Decimal(3), AT, 1)], R.ACTIVE)
    queue = spark.createDataFrame([(0, "7", "j7", "low", Decimal(5), AT, 1)], R.QUEUE)
    given = [R._event(active, "apply", F.col("applied_at"), **R._same("kind", "target_id", "target_name"), amount=F.col("estimated_savings")),
             R._event(queue, "enqueue", F.col("paused_at"), kind=F.lit("job_schedule_pause"), target_id=F.col("job_id"), amount=F.col("est_run_cost"))]
    store.commit({"active": active, "queue": queue, "events": given[0].unionByName(given[1])}, 0)
    before = {r["budget_id"]: r for r in R.status_model(R.log(store)).collect()}
    assert (before[0]["open_actions"], before[0]["queued_jobs"], before[0]["queued_cost"], before[1]["open_savings"]) == (2, 1, 5, 3)
    R.run_revert_all(store, F.lit(AT + dt.timedelta(hours=1)))
    assert [r["kind"] for r in store.read("active", R.ACTIVE).collect()] == ["idle_cluster_terminate"]
    assert store.read("queue", R.QUEUE).count() == 0
    after = {r["budget_id"]: r for r in R.status_model(R.log(store)).collect()}
    assert (after[0]["open_actions"], after[0]["queued_jobs"], after[1]["open_actions"]) == (1, 0, 0)
    assert [r["event"] for r in R.log_tail(R.log(store), 2).orderBy("budget_id", "recent_rank").collect()] == ["revert_all", "revert_all", "revert_all", "apply"]


def test_status_model_against_a_loop(spark):
    rng = random.Random(2)
    rows, opened, waiting, last = [], collections.defaultdict(dict), collections.defaultdict(dict), {}
    for k in range(400):
        b, t, n = rng.randint(0, 3), f"t{rng.randint(0, 5)}", rng.randint(1, 9)
        event = rng.choice(["check", "apply", "revert", "release", "enqueue"])
        kind = "job_schedule_pause" if event in ("release", "enqueue") else rng.choice(["job_schedule_pause", "warehouse_throttle"])
        row = dict.fromkeys(R.EVENT_FIELDS) | {"budget_id": b, "at": AT + dt.timedelta(minutes=k), "step": R._STEPS.index(event), "event": event, "amount": Decimal(n)}
        if event == "check":
            row["severity"] = last[b] = rng.choice(["OK", "WARN"])
        else:
            row |= {"kind": kind, "target_id": t}
            if event == "apply":
                opened[b][kind, t] = n
            if event in ("revert", "release"):
                opened[b].pop((kind, t), None)
            if event == "enqueue":
                waiting[b][t] = n
            if event == "release":
                waiting[b].pop(t, None)
        rows.append(tuple(row.values()))
    for r in R.status_model(spark.createDataFrame(rows, R.EVENT).repartition(7)).collect():
        b = r["budget_id"]
        assert (r["severity"], r["open_actions"], r["open_savings"], r["queued_jobs"], r["queued_cost"]) == (
            last[b], len(opened[b]), sum(opened[b].values()), len(waiting[b]), sum(waiting[b].values()))
