"""Rest-of-day forecasts, intraday fraction, lag fill, pace status."""

import datetime as dt

from conftest import NOW, hourly_history, usage_df
from spendpace.config import Forecasting
from spendpace.operators import forecast as FC

SCHEDULE = ([("JOBS", "JOB", "101", h, 10.0) for h in (6, 18)]
            + [("SQL", "WAREHOUSE", "wh1", h, 2.0) for h in (13, 14, 15, 16)])


def _run(spark, rows, now=NOW, mult=1.0, lag=3, cfg=Forecasting()):
    inst = spark.createDataFrame([(0, now)], "budget_id int, as_of timestamp")
    keys = FC.check_keys(inst, lag)
    uh = usage_df(spark, rows)
    days = FC.pool_days(uh, keys, cfg.trailing_days)
    hist = FC.pooled_hours(FC.history(uh, keys, cfg.trailing_days, days))
    modes = FC.modal_compute_type(uh, days)
    m = spark.createDataFrame([(0, now.date(), mult)], "budget_id int, today date, global_multiplier double")
    fc = {(r.workload_type, r.workload_id): r
          for r in FC.forecasts(keys, hist, modes, m, None, None, cfg).collect()}
    totals = FC.day_hour_totals(hist)
    frac = FC.intraday_fraction(keys, totals).first().intraday_fraction
    fill = FC.lag_fill(keys, totals, m).first().lag_fill
    return fc, frac, fill


def test_remaining_day(spark):
    fc, frac, fill = _run(spark, hourly_history(NOW, 14, SCHEDULE))
    assert fc[("JOB", "101")].forecast_usd == 10.0
    assert fc[("WAREHOUSE", "wh1")].forecast_usd == 4.0
    assert fc[("JOB", "101")].sample_days == 2  # two earlier Tuesdays
    assert fc[("JOB", "101")].name == "job-101"
    assert abs(frac - 14 / 28) < 1e-12
    assert fill == 4.0  # hours 12, 13, 14 -> wh1 at 13 and 14


def test_multiplier_applies(spark):
    fc, _, fill = _run(spark, hourly_history(NOW, 14, SCHEDULE), mult=2.0)
    assert fc[("JOB", "101")].forecast_usd == 20.0
    assert fill == 8.0


def test_empty_history(spark):
    fc, frac, fill = _run(spark, [(0, NOW - dt.timedelta(days=30), "JOBS", "JOB", "1", 1.0)])
    assert fc == {}
    assert abs(frac - 15 / 24) < 1e-12 and fill == 0.0


def test_lag_crosses_midnight(spark):
    now = NOW.replace(hour=1)
    rows = hourly_history(now, 14, [("JOBS", "JOB", "1", h, 1.0) for h in range(24)])
    _, _, fill = _run(spark, rows, now=now)
    assert fill == 3.0  # hours 22, 23 and 0 of the sampled days


def test_modal_compute_type_smallest_on_tie(spark):
    rows = hourly_history(NOW, 14, [("SQL", "JOB", "7", 20, 1.0), ("JOBS", "JOB", "7", 21, 1.0)])
    fc, _, _ = _run(spark, rows)
    assert fc[("JOB", "7")].compute_type == "JOBS"


def test_observed_matches_brute_force_every_hour(spark):
    """Observed week/today dollars from day totals + intraday prefix equal a
    plain filter-and-sum over the hourly rows, for every hour of a week
    (lag windows crossing midnight and the week start included)."""
    import random
    from decimal import Decimal

    from spendpace.config import Forecasting as Fc
    rnd = random.Random(7)
    start = dt.datetime(2026, 7, 1)
    rows = [(b, start + dt.timedelta(hours=h), rnd.choice(["JOBS", "SQL", "DLT"]), "JOB", str(rnd.randrange(4)),
             round(rnd.uniform(0, 5), 2))
            for b in (0, 1) for h in range(24 * 12) if rnd.random() < 0.6]
    uh = usage_df(spark, rows)
    lag, week_start = 3, dt.date(2026, 7, 4)  # a Saturday: week boundary inside the grid
    instants = [(b, start + dt.timedelta(days=3, hours=h)) for b in (0, 1) for h in range(24 * 8)]
    keys = FC.check_keys(spark.createDataFrame(instants, "budget_id int, as_of timestamp"), lag)
    ws = spark.createDataFrame(
        [(b, d, week_start + dt.timedelta(days=7 * ((d - week_start).days // 7)))
         for b in (0, 1) for d in {t.date() for _, t in instants}],
        "budget_id int, today date, week_start date")
    mult = spark.createDataFrame([(b, d, 1.5) for b, d, _ in ws.collect()],
                                 "budget_id int, today date, global_multiplier double")
    cfg = Fc(multiplier_overrides=(("SQL", 2.0),))
    got = {(r.budget_id, r.as_of): (r.observed_week, r.observed_today)
           for r in FC.observed(keys, uh, ws, mult, cfg).collect()}
    wsd = {(r.budget_id, r.today): r.week_start for r in ws.collect()}
    m = {"SQL": 2.0}
    for b, t in instants:
        cutoff = t - dt.timedelta(hours=lag)
        wk = dt.datetime.combine(wsd[(b, t.date())], dt.time())
        today = dt.datetime.combine(t.date(), dt.time())
        week, day = {}, {}
        for rb, ts, ct, _, _, d in rows:
            if rb == b and wk <= ts < cutoff and ts < today + dt.timedelta(days=1):
                week[ct] = week.get(ct, Decimal(0)) + Decimal(str(d))
                if ts >= today:
                    day[ct] = day.get(ct, Decimal(0)) + Decimal(str(d))
        exp_w = sum(float(v) * m.get(c, 1.5) for c, v in week.items())
        exp_d = sum(float(v) * m.get(c, 1.5) for c, v in day.items())
        gw, gd = got[(b, t)]
        assert abs(gw - exp_w) < 1e-6 and abs(gd - exp_d) < 1e-6, (b, t, gw, exp_w, gd, exp_d)
