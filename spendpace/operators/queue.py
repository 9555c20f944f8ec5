"""FIFO deferral queue of paused jobs, and the next active-action state.

Release is strict FIFO: walking the queue in pause order, a job is released
while the running sum of estimated run costs fits the day's headroom; the
first job that does not fit holds everyone behind it: running costs over
ranges of the queue, and the place of the first job that does not fit. Ties on
``paused_at`` keep ``seq``.

``release_plan`` asks one queue at many checks. ``replay`` carries the queue
from check to check: what one check releases is gone at the next, whose headroom
then pays for the released job's forecast again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendpace import config as C
from spendpace.functions.tags import MONEY
from spendpace.operators.levers import money4
from spendpace.operators.ordered import running

KEY = ["budget_id", "as_of"]
QUEUE_COLUMNS = ["budget_id", "job_id", "name", "priority", "est_run_cost", "paused_at", "seq"]
ACTIVE_COLUMNS = ["budget_id", "kind", "target_id", "target_name", "priority", "estimated_savings",
                  "applied_at", "seq"]


def enqueue(chosen: DataFrame) -> DataFrame:
    """Newly applied schedule pauses become queue entries (cost = saving),
    in application order."""
    p = chosen.filter(F.col("kind") == C.KIND_PAUSE)
    return p.select("budget_id", F.col("target_id").alias("job_id"), F.col("target_name").alias("name"),
                    "priority", F.col("estimated_savings").cast(MONEY).alias("est_run_cost"),
                    F.col("as_of").alias("paused_at"), F.col("pick_order").cast("bigint").alias("seq"))


def applied(chosen: DataFrame) -> DataFrame:
    """Chosen options as active actions (applied at the check instant)."""
    return chosen.select("budget_id", "kind", "target_id", "target_name", "priority",
                         F.col("estimated_savings").cast(MONEY).alias("estimated_savings"),
                         F.col("as_of").alias("applied_at"), F.col("pick_order").cast("bigint").alias("seq"))


def release_plan(status: DataFrame, queue: DataFrame, fifo_release: bool = True) -> DataFrame:
    """Queue entries of each check with ``released``: the gate is open when
    FIFO release is on and severity is OK or WARN; headroom is the day's
    target minus spend and forecast (never negative)."""
    gate = status.filter(F.col("severity").isin("OK", "WARN") & F.lit(fifo_release)).select(*KEY, "day_headroom")
    q = queue.join(gate, "budget_id", "inner")
    cost = F.col("est_run_cost")
    q = running(q, KEY, [F.col("paused_at"), F.col("seq")], "queue_pos", {"running_cost": cost})
    q = (q.withColumn("running_cost", (F.col("running_cost") + cost).cast("decimal(28,4)"))
         .withColumn("blocked", F.col("running_cost").cast("double") > F.col("day_headroom")))
    first = q.filter("blocked").groupBy(*KEY).agg(F.min("queue_pos").alias("first_blocked"))
    q = q.join(first, KEY, "left")
    return q.withColumn("released", F.col("first_blocked").isNull() | (F.col("queue_pos") < F.col("first_blocked"))).drop("first_blocked")


def freeze(forecasts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queue entries of a freeze at the forecasts' instants: every job with a
    live schedule, a positive forecast and a priority that is not critical is
    paused, dearest first; its cost is its forecast."""
    live = jobs.filter(F.col("has_schedule") & ~F.col("schedule_paused")).select("budget_id", "job_id", F.col("name").alias("job_name"))
    f = forecasts.filter((F.col("workload_type") == "JOB") & (F.col("priority") != "critical") & (F.col("forecast_usd") > 0))
    j = f.join(live, (f["workload_id"] == live["job_id"]) & (f["budget_id"] == live["budget_id"]))
    return j.select(f["budget_id"], "job_id", F.col("job_name").alias("name"), "priority", money4(F.col("forecast_usd")).alias("est_run_cost"),
                    F.col("as_of").alias("paused_at"), F.col("forecast_rank").cast("bigint").alias("seq"))


_UNIT = 10_000  # money of the replay is counted in ten-thousandths
_ENTRY, _FORECAST, _CHECK = 0, 1, 2


def replay(status: DataFrame, forecasts: DataFrame, entries: DataFrame, fifo_release: bool = True) -> DataFrame:
    """The queue through the checks of ``status`` in order of time, one state
    per budget: (budget_id, as_of, job_id, paused_at, seq, queue_pos,
    est_run_cost, running_cost, day_headroom, released) for every job that waits
    at a check whose gate is open (severity OK or WARN, FIFO release on).

    ``status`` and ``forecasts`` are those of all workloads, as if nothing were
    queued; ``entries`` are pauses, which wait from ``paused_at`` on (a check at
    that instant sees them). A check's headroom is the day's target less spend
    and the forecasts of the workloads that do not wait, never negative. Money
    is summed at four places, so results do not depend on the order of sums. A
    job paused again while it waits keeps its first place.

    Rows are dealt by budget, sorted by time and streamed; a task holds the
    queue of one budget, not its rows. Severity does not depend on the queue:
    pace compares what was spent with what was planned.
    """
    import pyarrow as pa

    units = lambda c: (money4(c) * _UNIT).cast("bigint")
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    waits = entries.select("budget_id", "job_id").distinct()
    asked = forecasts.filter(F.col("workload_type") == "JOB").select(
        "budget_id", F.col("workload_id").alias("job_id"), F.col("as_of").alias("at"), units(F.col("forecast_usd")).alias("amount"))
    asked = asked.join(waits, ["budget_id", "job_id"], "left_semi")
    total = forecasts.groupBy(*KEY).agg(F.sum(units(F.col("forecast_usd"))).alias("total"))
    room = status.join(total, KEY, "left").select(
        "budget_id", F.col("as_of").alias("at"), (F.col("severity").isin("OK", "WARN") & F.lit(fifo_release)).cast("bigint").alias("seq"),
        (units(F.col("day_target") - F.col("spend_today")) - F.coalesce("total", F.lit(0))).alias("amount"))
    rows = (entries.select("budget_id", F.col("paused_at").alias("at"), F.lit(_ENTRY).alias("kind"), "job_id", "seq",
                           (F.col("est_run_cost") * _UNIT).cast("bigint").alias("amount"))
            .unionByName(asked.select("budget_id", "at", F.lit(_FORECAST).alias("kind"), "job_id", none.alias("seq"), "amount"))
            .unionByName(room.select("budget_id", "at", F.lit(_CHECK).alias("kind"), text.alias("job_id"), "seq", "amount")))
    dealt = (rows.withColumn("at", F.unix_micros("at")).repartition("budget_id")
             .sortWithinPartitions("budget_id", "at", "kind", "seq", "job_id"))
    names = ["budget_id", "at", "job_id", "paused", "seq", "queue_pos", "cost", "running", "headroom", "released"]

    def run(batches):
        budget, queue, now = None, {}, {}  # job -> (paused, seq, cost); job -> forecast at this check
        for b in batches:
            out = []
            for budget_id, at, kind, job, seq, amount in zip(*(b.column(c).to_pylist() for c in ("budget_id", "at", "kind", "job_id", "seq", "amount"))):
                if budget_id != budget:
                    budget, queue, now = budget_id, {}, {}
                if kind == _ENTRY:
                    queue.setdefault(job, (at, seq, amount))
                elif kind == _FORECAST:
                    if job in queue:
                        now[job] = amount
                else:
                    if seq:
                        headroom, running, fits = max(0, amount + sum(now.values())), 0, True
                        for pos, (job, (paused, n, cost)) in enumerate(list(queue.items()), 1):
                            running += cost
                            fits = fits and running <= headroom
                            out.append((budget, at, job, paused, n, pos, cost, running, headroom, fits))
                            if fits:
                                del queue[job]
                    now = {}
            if out:
                kinds = [b.column("budget_id").type, pa.int64(), pa.string(), *[pa.int64()] * 6, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    kind = entries.schema["budget_id"].dataType.simpleString()
    told = dealt.mapInArrow(run, f"budget_id {kind}, at long, job_id string, paused long, seq long, queue_pos long, cost long, running long, headroom long, released boolean")
    money = lambda c: (F.col(c).cast("decimal(38,0)") / _UNIT).cast(MONEY)
    return told.select("budget_id", F.timestamp_micros("at").alias("as_of"), "job_id", F.timestamp_micros("paused").alias("paused_at"), "seq",
                       F.col("queue_pos").cast("int").alias("queue_pos"), money("cost").alias("est_run_cost"), money("running").alias("running_cost"),
                       money("headroom").alias("day_headroom"), "released")


def next_queue(queue: DataFrame, new_entries: DataFrame, released: DataFrame, dry_run: bool) -> DataFrame:
    """(queue + new pauses) - released. A dry run changes nothing."""
    if dry_run:
        return queue
    both = queue.select(*QUEUE_COLUMNS).unionByName(new_entries.select(*QUEUE_COLUMNS))
    gone = released.filter("released").select("budget_id", "job_id").distinct()
    return both.join(gone, ["budget_id", "job_id"], "left_anti")


def next_active(active: DataFrame, reverted: DataFrame, new_actions: DataFrame, released: DataFrame,
                dry_run: bool) -> DataFrame:
    """(active - reverted - pauses of released jobs) + newly applied
    reversible actions. A dry run changes nothing."""
    if dry_run:
        return active
    keep = active.select(*ACTIVE_COLUMNS).join(
        reverted.select("budget_id", "kind", "target_id").distinct(), ["budget_id", "kind", "target_id"],
        "left_anti")
    rel = (released.filter("released")
           .select("budget_id", F.col("job_id").alias("target_id"), F.lit(C.KIND_PAUSE).alias("kind")).distinct())
    keep = keep.join(rel, ["budget_id", "kind", "target_id"], "left_anti")
    reversible = [k for k, r in C.REVERSIBLE.items() if r]
    new = new_actions.filter(F.col("kind").isin(*reversible)).select(*ACTIVE_COLUMNS)
    return keep.unionByName(new)


def revert_all(active: DataFrame, queue: DataFrame) -> DataFrame:
    """Manual escape hatch: every reversible active action to revert and
    every queued job to release, as one list."""
    reversible = [k for k, r in C.REVERSIBLE.items() if r]
    a = active.filter(F.col("kind").isin(*reversible)).select(
        "budget_id", F.lit("revert").alias("operation"), "kind", "target_id", "target_name")
    q = queue.select("budget_id", F.lit("release").alias("operation"), F.lit(C.KIND_PAUSE).alias("kind"),
                     F.col("job_id").alias("target_id"), F.col("name").alias("target_name"))
    return a.unionByName(q)
