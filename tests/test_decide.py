"""Greedy allocator and strict-FIFO release, against plain loops."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from spendpace.operators import allocate as AL
from spendpace.operators import queue as QU

AS_OF = dt.datetime(2026, 7, 7, 15)
ORDER = {"low": 0, "normal": 1, "critical": 2}


def options_df(spark, cases):
    """cases: list of (gap, groups); group = (target, priority, disruption, savings list)."""
    rows, gaps = [], []
    for case, (gap, groups) in enumerate(cases):
        gaps.append((case, AS_OF, "THROTTLE", Decimal(gap)))
        for gi, (target, prio, disr, savings) in enumerate(groups):
            ordered = sorted(enumerate(savings), key=lambda t: (t[1], t[0]))
            for seq, (tpl, s) in enumerate(ordered, start=1):
                rows.append((case, AS_OF, f"k:{target}", "k", target, prio, disr, 1, f"{gi:04d}", tpl,
                             Decimal(s), seq))
    schema = ("budget_id int, as_of timestamp, target_key string, kind string, target_id string,"
              " priority string, disruption int, lever_seq int, emit_seq string, template_seq int,"
              " estimated_savings decimal(18,4), option_seq int")
    opts = spark.createDataFrame(rows, schema)
    gap = spark.createDataFrame(gaps, "budget_id int, as_of timestamp, severity string, gap decimal(18,4)")
    return opts, gap


def greedy(gap, groups):
    if gap <= 0:
        return []
    ordered = sorted(enumerate(groups), key=lambda t: (ORDER[t[1][1]], t[1][2], -max(t[1][3]), t[0]))
    chosen, remaining = [], gap
    for _, (target, _p, _d, savings) in ordered:
        if remaining <= 0:
            break
        opts = sorted(savings)
        pick = next((o for o in opts if o >= remaining), opts[-1])
        if pick <= 0:
            continue
        chosen.append((target, pick))
        remaining -= pick
    return chosen


def picks(spark, cases):
    opts, gap = options_df(spark, cases)
    got = {}
    for r in AL.allocate(opts, gap).orderBy("budget_id", "pick_order").collect():
        got.setdefault(r.budget_id, []).append((r.target_id, int(r.estimated_savings)))
    return [got.get(i, []) for i in range(len(cases))]


def test_smallest_sufficient(spark):
    assert picks(spark, [(12, [("a", "normal", 1, [5, 15, 40])])]) == [[("a", 15)]]


def test_escalation_and_order(spark):
    cases = [
        (14, [("a", "normal", 1, [5, 10]), ("b", "normal", 1, [5, 10])]),
        (5, [("n", "normal", 1, [5]), ("l", "low", 1, [5])]),
        (5, [("p", "normal", 3, [5]), ("i", "normal", 0, [5])]),
        (100, [("a", "normal", 1, [5])]),
        (1000, [("a", "normal", 1, [5, 10, 20])]),
        (0, [("a", "normal", 1, [5])]),
    ]
    assert picks(spark, cases) == [[("a", 10), ("b", 5)], [("l", 5)], [("i", 5)], [("a", 5)], [("a", 20)], []]


def test_allocator_matches_loop(spark):
    rnd = random.Random(7)
    cases = []
    for _ in range(150):
        groups = [(f"t{g}", rnd.choice(["low", "normal"]), rnd.randint(0, 3),
                   [rnd.randint(-2, 40) for _ in range(rnd.randint(1, 4))]) for g in range(rnd.randint(1, 6))]
        cases.append((rnd.randint(-5, 120), groups))
    got = picks(spark, cases)
    want = [greedy(gap, groups) for gap, groups in cases]
    assert got == want


def fifo_loop(queue, headroom):
    out, remaining = [], headroom
    for job, cost in queue:
        if cost > remaining:
            break
        out.append(job)
        remaining -= cost
    return out


def release(spark, cases):
    q_rows, s_rows = [], []
    for case, (queue, headroom) in enumerate(cases):
        s_rows.append((case, AS_OF, "OK", float(headroom)))
        for seq, (job, cost) in enumerate(queue):
            q_rows.append((case, job, job, "normal", Decimal(cost), AS_OF + dt.timedelta(minutes=seq // 2), seq))
    status = spark.createDataFrame(s_rows, "budget_id int, as_of timestamp, severity string, day_headroom double")
    queue = spark.createDataFrame(q_rows, "budget_id int, job_id string, name string, priority string,"
                                          " est_run_cost decimal(18,4), paused_at timestamp, seq bigint")
    got = {}
    for r in QU.release_plan(status, queue).filter("released").orderBy("budget_id", "queue_pos").collect():
        got.setdefault(r.budget_id, []).append(r.job_id)
    return [got.get(i, []) for i in range(len(cases))]


def test_fifo_examples(spark):
    cases = [([("1", 20), ("2", 30), ("3", 10)], 55), ([("big", 100), ("small", 1)], 50)]
    assert release(spark, cases) == [["1", "2"], []]


def test_fifo_matches_loop(spark):
    rnd = random.Random(11)
    cases = [([(f"j{i}", rnd.randint(0, 30)) for i in range(rnd.randint(0, 6))], rnd.randint(0, 60))
             for _ in range(150)]
    assert release(spark, cases) == [fifo_loop(q, h) for q, h in cases]


def test_gate_closed_when_throttling(spark):
    status = spark.createDataFrame([(0, AS_OF, "THROTTLE", 100.0)],
                                   "budget_id int, as_of timestamp, severity string, day_headroom double")
    queue = spark.createDataFrame([(0, "1", "a", "low", Decimal(1), AS_OF, 0)],
                                  "budget_id int, job_id string, name string, priority string,"
                                  " est_run_cost decimal(18,4), paused_at timestamp, seq bigint")
    assert QU.release_plan(status, queue).count() == 0


def test_state_transitions(spark):
    active = spark.createDataFrame(
        [(0, "warehouse_throttle", "wh1", "a", "normal", Decimal(5), AS_OF, 1),
         (0, "job_schedule_pause", "101", "b", "low", Decimal(7), AS_OF, 2)],
        "budget_id int, kind string, target_id string, target_name string, priority string,"
        " estimated_savings decimal(18,4), applied_at timestamp, seq bigint")
    status = spark.createDataFrame([(0, AS_OF, "OK")], "budget_id int, as_of timestamp, severity string")
    rev = AL.reverts(status, active, fifo_release=True).collect()
    assert [r.target_id for r in rev] == ["wh1"]  # pauses stay with the FIFO queue
    assert len(AL.reverts(status, active, fifo_release=False).collect()) == 2
    released = spark.createDataFrame([(0, "101", True)], "budget_id int, job_id string, released boolean")
    empty = active.filter(F.lit(False))
    nxt = QU.next_active(active, AL.reverts(status, active, True), empty, released, dry_run=False)
    assert nxt.count() == 0
    assert QU.next_active(active, AL.reverts(status, active, True), empty, released, dry_run=True).count() == 2
    queue = spark.createDataFrame([(0, "101", "b", "low", Decimal(7), AS_OF, 0)],
                                  "budget_id int, job_id string, name string, priority string,"
                                  " est_run_cost decimal(18,4), paused_at timestamp, seq bigint")
    assert QU.next_queue(queue, queue.filter(F.lit(False)), released, dry_run=False).count() == 0
    assert QU.next_queue(queue, queue.filter(F.lit(False)), released, dry_run=True).count() == 1
    assert sorted(r.operation for r in QU.revert_all(active, queue).collect()) == ["release", "revert", "revert"]
