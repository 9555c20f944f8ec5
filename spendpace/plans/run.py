"""One run of the check with state between runs: the stored actions and queue
go in; plan, calibration, actions, queue and the run's events come out as one
commit.

Events are typed rows, one per plan, check, applied action, revert, queue entry,
release, and per item of a manual revert of everything. ``status_model`` folds
the log of all commits into what is in force; it reads nothing but events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendpace import config as C
from spendpace.config import PaceConfig
from spendpace.functions.tags import MONEY
from spendpace.operators import allocate as AL
from spendpace.operators import queue as QU
from spendpace.plans import check as CK
from spendpace.plans import weekly as W
from spendpace.session import materialize
from spendpace.sources.store import StateStore

_ID = "budget_id int"
ACTIVE = f"{_ID}, kind string, target_id string, target_name string, priority string, estimated_savings {MONEY}, applied_at timestamp, seq bigint"
QUEUE = f"{_ID}, job_id string, name string, priority string, est_run_cost {MONEY}, paused_at timestamp, seq bigint"
PLAN = (f"{_ID}, as_of date, fy_label string, week_start date, week_end date, annual_budget double, fy_to_date_spend {MONEY}, "
        "remaining_budget double, remaining_weeks double, weekly_allowance double")
CALIBRATION = f"{_ID}, as_of date, global_multiplier double, window_days int"
#: ``step`` orders the events of one instant.
EVENT_FIELDS = {"budget_id": "int", "at": "timestamp", "step": "int", "event": "string", "kind": "string", "target_id": "string",
                "target_name": "string", "amount": MONEY, "severity": "string", "pace_ratio": "double", "weekly_allowance": "double",
                "global_multiplier": "double", "window_days": "int", "actions": "bigint", "shortfall": MONEY}
EVENT = ", ".join(f"{n} {k}" for n, k in EVENT_FIELDS.items())
_STEPS = ("plan", "check", "revert", "release", "apply", "enqueue", "revert_all")


def _event(df: DataFrame, event: str, at, **fields) -> DataFrame:
    given = {"at": at, "step": F.lit(_STEPS.index(event)), "event": F.lit(event), "budget_id": F.col("budget_id")} | fields
    return df.select(*[(given[n] if n in given else F.lit(None)).cast(k).alias(n) for n, k in EVENT_FIELDS.items()])


@dataclass
class Run:
    """What a run decided; its tables are stored as commit ``number``."""

    number: int
    check: CK.CheckTables
    chosen: DataFrame
    released: DataFrame
    reverted: DataFrame


def run_check(store: StateStore, inp: W.Inputs, cfg: PaceConfig, instants: DataFrame, dry_run: bool = False,
              pt: W.PlanTables | None = None, usage_hourly: DataFrame | None = None) -> Run:
    """Check every budget of ``instants`` (one instant each) against the stored
    state and commit the next one. A dry run logs its check and changes neither
    actions nor queue."""
    base, fifo = store.current(), cfg.levers.fifo_release
    active, queue = store.read("active", ACTIVE, base), store.read("queue", QUEUE, base)
    check = CK.build_check(inp, cfg, instants, queue=queue, active=active, pt=pt, usage_hourly=usage_hourly)
    chosen = materialize(check.chosen)
    released = materialize(QU.release_plan(check.status, queue, fifo))
    reverted = materialize(AL.reverts(check.status, active, fifo))
    applied, entries = QU.applied(chosen), QU.enqueue(chosen)
    plan = W.plan_columns(check.plan.plan)
    calibration = check.plan.calibration.select(*[f.split()[0] for f in CALIBRATION.split(", ")])
    summary = AL.summary(check.gap, chosen).select("budget_id", "as_of", "actions", F.greatest(F.col("gap_left"), F.lit(0)).alias("shortfall"))
    checks = check.status.select("budget_id", "as_of", "severity", "pace_ratio").join(summary, ["budget_id", "as_of"])
    day = F.col("as_of").cast("timestamp")
    plans = plan.join(calibration, ["budget_id", "as_of"], "left")
    events = _event(plans, "plan", day, amount=F.col("annual_budget"), **_same("weekly_allowance", "global_multiplier", "window_days"))
    events = events.unionByName(_event(checks, "check", F.col("as_of"), **_same("severity", "pace_ratio", "actions", "shortfall")))
    if not dry_run:
        now = F.col("as_of")
        for more in (
                _event(reverted, "revert", now, **_same("kind", "target_id", "target_name"), amount=F.col("estimated_savings")),
                _event(released.filter("released"), "release", now, kind=F.lit(C.KIND_PAUSE), target_id=F.col("job_id"),
                       target_name=F.col("name"), amount=F.col("est_run_cost")),
                _event(applied.filter(F.col("kind").isin(_reversible())), "apply", F.col("applied_at"), **_same("kind", "target_id", "target_name"),
                       amount=F.col("estimated_savings")),
                _event(entries, "enqueue", F.col("paused_at"), kind=F.lit(C.KIND_PAUSE), target_id=F.col("job_id"), target_name=F.col("name"),
                       amount=F.col("est_run_cost"))):
            events = events.unionByName(more)
    number = store.commit({
        "plan": plan, "calibration": calibration,
        "active": QU.next_active(active, reverted, applied, released, dry_run),
        "queue": QU.next_queue(queue, entries, released, dry_run), "events": events}, base)
    return Run(number, check, chosen, released, reverted)


def check_report(store: StateStore, run: Run) -> DataFrame:
    """Per check of a run: severity, gap, actions, their savings, what they
    leave open, and the jobs released and still waiting, in queue order."""
    key = ["budget_id", "as_of"]
    jobs = lambda name, *order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, name))), lambda x: x[name]), ",")
    out = run.check.status.select(*key, "severity").join(AL.summary(run.check.gap, run.chosen).drop("severity"), key)
    gone = run.released.filter("released").groupBy(*key).agg(jobs("job_id", "queue_pos").alias("released_jobs"))
    back = run.reverted.groupBy(*key).agg(F.count(F.lit(1)).alias("reverted"))
    left = store.read("queue", QUEUE, run.number).groupBy("budget_id").agg(
        jobs("job_id", "paused_at", "seq").alias("queue_jobs"), F.sum("est_run_cost").alias("queue_cost"))
    out = out.join(gone, key, "left").join(back, key, "left").join(left, "budget_id", "left")
    return out.select(*key, "severity", "gap", "actions", F.col("total_estimated_savings").alias("planned_savings"),
                      F.greatest(F.col("gap_left"), F.lit(0)).alias("shortfall"), F.coalesce("reverted", F.lit(0)).alias("reverted"),
                      F.coalesce("released_jobs", F.lit("")).alias("released_jobs"), F.coalesce("queue_jobs", F.lit("")).alias("queue_jobs"),
                      F.coalesce("queue_cost", F.lit(0)).cast(MONEY).alias("queue_cost"))


def _reversible() -> list[str]:
    return [k for k, r in C.REVERSIBLE.items() if r]


def _same(*names: str) -> dict:
    return {n: F.col(n) for n in names}


def run_revert_all(store: StateStore, at) -> int:
    """Revert every reversible action and drain the queue, as one commit; ``at``
    is a timestamp Column."""
    base = store.current()
    active, queue = store.read("active", ACTIVE, base), store.read("queue", QUEUE, base)
    listed = QU.revert_all(active, queue)
    kept = active.filter(~F.col("kind").isin(_reversible()))
    events = _event(listed, "revert_all", at, **_same("kind", "target_id", "target_name"), severity=F.col("operation"))
    return store.commit({"plan": store.read("plan", PLAN, base), "calibration": store.read("calibration", CALIBRATION, base),
                         "active": kept, "queue": queue.limit(0), "events": events}, base)


def log(store: StateStore) -> DataFrame:
    return store.history("events", EVENT)


def log_tail(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events of each budget, the latest first."""
    order = Window.partitionBy("budget_id").orderBy(F.col("at").desc(), F.col("step").desc(), "kind", "target_id")
    return events.withColumn("recent_rank", F.row_number().over(order)).filter(F.col("recent_rank") <= n)


def status_model(events: DataFrame) -> DataFrame:
    """Per budget, from the log alone: the latest plan and calibration, the last
    check, and what is open. An action is open if its last event applied it, a
    job waits if its last event put it into the queue. All groups combine before
    their shuffle (latest value by order of events)."""
    order = F.struct("at", "step")

    def latest(event: str, column: str):
        return F.max_by(F.when(F.col("event") == event, F.col(column)), F.when(F.col("event") == event, order)).alias(column)

    whole = events.groupBy("budget_id").agg(
        latest("plan", "weekly_allowance"), latest("plan", "global_multiplier"), latest("check", "severity"), latest("check", "pace_ratio"),
        latest("check", "shortfall"), F.max(F.when(F.col("event") == "check", F.col("at"))).alias("checked_at"),
        *[F.count_if(F.col("event") == e).alias(f"{e}s") for e in ("apply", "revert", "release")])

    def last(of: tuple[str, ...], opens: str) -> DataFrame:
        mine = events.filter(F.col("event").isin(*of)).groupBy("budget_id", "kind", "target_id").agg(
            F.max_by("event", order).alias("event"), F.max_by("amount", order).alias("amount"))
        return mine.filter(F.col("event") == opens).groupBy("budget_id")

    open_actions = last(("apply", "revert", "release", "revert_all"), "apply").agg(
        F.count(F.lit(1)).alias("open_actions"), F.sum("amount").alias("open_savings"))
    waiting = last(("enqueue", "release", "revert_all"), "enqueue").agg(F.count(F.lit(1)).alias("queued_jobs"), F.sum("amount").alias("queued_cost"))
    out = whole.join(open_actions, "budget_id", "left").join(waiting, "budget_id", "left")
    zeros = {"open_actions": "bigint", "open_savings": MONEY, "queued_jobs": "bigint", "queued_cost": MONEY}
    return out.select(*whole.columns, *[F.coalesce(F.col(n), F.lit(0)).cast(k).alias(n) for n, k in zeros.items()])
