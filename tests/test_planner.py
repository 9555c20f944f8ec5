"""Day-of-week profile, weekly plan, day targets, calibration."""

import datetime as dt

from spendpace import config as C
from spendpace.operators import forecast as FC
from spendpace.operators import plan as P

AS_OF = dt.date(2026, 7, 7)
WEEK = dt.date(2026, 7, 5)  # Sunday, start of the budget week


def ledger(spark, weeks):
    rows = []
    for w in range(1, weeks + 1):
        start = WEEK - dt.timedelta(weeks=w)
        for i in range(7):
            d = start + dt.timedelta(days=i)
            rows.append((0, d, 50.0 if d.weekday() >= 5 else 200.0))
    return spark.createDataFrame(rows, "budget_id int, usage_date date, cost double")


def keys(spark, budget=100000.0):
    inst = spark.createDataFrame([(0, AS_OF, budget, 10, 1, 6)],
                                 "budget_id int, as_of date, annual_budget double, fy_start_month int,"
                                 " fy_start_day int, week_start_weekday int")
    return P.plan_keys(inst)


def profile(spark, weeks):
    k = keys(spark)
    return {r.weekday: r.weight for r in P.dow_profile(ledger(spark, weeks), k, 8).collect()}


def test_profile_six_weeks(spark):
    p = profile(spark, 6)
    assert abs(p[0] - 200 / 1100) < 1e-12
    assert abs(p[6] - 50 / 1100) < 1e-12
    assert abs(sum(p.values()) - 1.0) < 1e-12


def test_profile_one_week_uniform(spark):
    p = profile(spark, 1)
    assert all(abs(v - 1 / 7) < 1e-15 for v in p.values()) and len(p) == 7


def test_profile_empty_uniform(spark):
    k = keys(spark)
    empty = spark.createDataFrame([], "budget_id int, usage_date date, cost double")
    p = {r.weekday: r.weight for r in P.dow_profile(empty, k, 8).collect()}
    assert len(p) == 7 and all(abs(v - 1 / 7) < 1e-15 for v in p.values())


def test_incomplete_week_ignored(spark):
    led = ledger(spark, 3).filter("usage_date <> date'2026-06-30'")  # breaks one week
    p = {r.weekday: (r.weight, r.complete_weeks) for r in P.dow_profile(led, keys(spark), 8).collect()}
    assert p[0][1] == 2


def test_plan_allowance_and_targets(spark):
    k = keys(spark)
    led = ledger(spark, 8)
    plan = P.weekly_plan(led, k).first()
    assert float(plan.fy_to_date_spend) == 8800.0
    assert plan.remaining_budget == 91200.0
    assert abs(plan.weekly_allowance - 91200.0 * 7 / 88) < 1e-9
    targets = P.day_targets(P.weekly_plan(led, k), P.dow_profile(led, k, 8)).collect()
    assert len(targets) == 7
    assert abs(sum(t.target for t in targets) - plan.weekly_allowance) < 1e-6
    mon = [t for t in targets if t.day == dt.date(2026, 7, 6)][0]
    assert abs(mon.target - plan.weekly_allowance * 200 / 1100) < 1e-9
    last = max(targets, key=lambda t: t.day)
    assert abs(last.cumulative_target - plan.weekly_allowance) < 1e-6


def test_budget_exhausted(spark):
    plan = P.weekly_plan(ledger(spark, 8), keys(spark, budget=1000.0)).first()
    assert plan.remaining_budget == 0.0 and plan.weekly_allowance == 0.0


def _calibrate(spark, cur_per_day, days, usage_per_day=200.0):
    end = AS_OF - dt.timedelta(days=2)
    cur_rows = [(0, end - dt.timedelta(days=i), cur_per_day) for i in range(1, days + 1)]
    use_rows = [(0, dt.datetime.combine(end - dt.timedelta(days=i), dt.time(10)), "JOBS", "JOB", "1",
                 usage_per_day) for i in range(1, days + 1)]
    led = spark.createDataFrame(cur_rows, "budget_id int, usage_date date, cost double")
    uh = spark.createDataFrame(use_rows, "budget_id int, hour_start timestamp, compute_type string,"
                                         " workload_type string, workload_id string, dbu_dollars double")
    return P.calibration(led, uh, keys(spark), 1.7, C.CALIBRATION_WINDOW_DAYS, C.CUR_LAG_DAYS,
                         C.CALIBRATION_MIN_DAYS, C.MULTIPLIER_BOUNDS).first()


def test_calibration_ratio(spark):
    c = _calibrate(spark, 320.0, 20)
    assert abs(c.global_multiplier - 1.6) < 1e-12 and c.window_days == 20


def test_calibration_clamped(spark):
    assert _calibrate(spark, 10000.0, 20).global_multiplier == 4.0
    assert _calibrate(spark, 100.0, 20).global_multiplier == 1.0


def test_calibration_too_few_days(spark):
    c = _calibrate(spark, 320.0, 3)
    assert c.global_multiplier == 1.7 and c.window_days == 3


def test_override_wins(spark):
    from pyspark.sql import functions as F
    cfg = C.Forecasting(multiplier_overrides=(("SQL", 1.2),))
    df = spark.createDataFrame([("SQL", 1.6), ("JOBS", 1.6)], "t string, g double")
    got = dict(df.select("t", FC.multiplier_for(F.col("t"), F.col("g"), cfg).alias("m")).collect())
    assert got == {"SQL": 1.2, "JOBS": 1.6}


def test_blended_days_give_what_each_instant_sees(spark):
    """Plans from the shared daily rows equal plans from a ledger per instant,
    also where the profile's weeks begin before the fiscal year."""
    import random
    from spendpace.functions.tags import MONEY
    from spendpace.operators import ledger as L
    rng = random.Random(5)
    days = [dt.date(2025, 7, 1) + dt.timedelta(days=i) for i in range(140)]
    lines = [(b, d, rng.randint(1, 90) / 4, rng.random() < 0.2) for b in (0, 1) for d in days if rng.random() < 0.97 for _ in range(2)]
    used = [(b, d, rng.randint(1, 90) / 8) for b in (0, 1) for d in days if rng.random() < 0.97]
    cur = spark.createDataFrame(lines, "budget_id int, usage_date date, cost double, is_marketplace boolean")
    usage = spark.createDataFrame(used, "budget_id int, usage_date date, dbu_dollars double")
    usage = usage.selectExpr("budget_id", "usage_date", f"cast(dbu_dollars as {MONEY}) as dbu_dollars")
    instants = [(b, dt.date(2025, 9, 24) + dt.timedelta(days=5 * i), 90000.0, 10, 1, 6) for b in (0, 1, 2) for i in range(9)]
    keys = P.plan_keys(spark.createDataFrame(instants, "budget_id int, as_of date, annual_budget double, fy_start_month int,"
                                                       " fy_start_day int, week_start_weekday int"))
    hourly = usage.selectExpr("budget_id", "cast(usage_date as timestamp) as hour_start", "dbu_dollars")
    got = []
    for led in (L.blended_days(cur, usage), L.blended_ledger(cur, usage, keys)):
        plan = P.weekly_plan(led, keys)
        targets = P.day_targets(plan, P.dow_profile(led, keys, 8))
        calib = P.calibration(led, hourly, keys, 1.6, 28, 2, 7, (1.0, 4.0))
        got.append([sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in part.collect())
                    for part in (plan.select("budget_id", "as_of", "fy_to_date_spend", "weekly_allowance"),
                                 targets.select("budget_id", "as_of", "day", "target"),
                                 calib.select("budget_id", "as_of", "window_days", "cur_total"))])
    assert got[0] == got[1] and len(got[0][0]) == 27
    spent = {(r[0], r[1]): r[2] for r in got[0][0]}
    for b, at, *_ in instants:
        k = [r for r in keys.where(f"budget_id = {b} and as_of = date'{at}'").select("fy_start", "week_start").collect()][0]
        inside = lambda d: k.fy_start <= d < k.week_start
        want = sum(c for x, d, c, m in lines if x == b and not m and inside(d)) + sum(c for x, d, c in used if x == b and inside(d))
        assert float(spent[b, at]) == want
