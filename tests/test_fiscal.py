import datetime as dt

from pyspark.sql import functions as F

from spendpace.functions import fiscal


def _cal(spark, d: str, month=10, day=1, wsw=6):
    df = spark.createDataFrame([(dt.date.fromisoformat(d), month, day, wsw)],
                               "d date, fy_start_month int, fy_start_day int, week_start_weekday int")
    cols = fiscal.calendar_columns(F.col("d"))
    return df.select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_mid_year(spark):
    c = _cal(spark, "2026-07-07")
    assert c["fy_start"] == dt.date(2025, 10, 1)
    assert c["fy_end"] == dt.date(2026, 10, 1)
    assert c["fy_label"] == "FY2026"
    assert c["week_start"] == dt.date(2026, 7, 5)
    assert c["week_end"] == dt.date(2026, 7, 12)
    assert c["days_in_week"] == 7
    assert c["remaining_fy_days"] == 88


def test_stub_week_at_fy_start(spark):
    c = _cal(spark, "2025-10-02")
    assert (c["week_start"], c["week_end"]) == (dt.date(2025, 10, 1), dt.date(2025, 10, 5))
    assert c["days_in_week"] == 4
    assert c["natural_week_start"] == dt.date(2025, 9, 28)


def test_stub_week_at_fy_end(spark):
    c = _cal(spark, "2026-09-30")
    assert (c["week_start"], c["week_end"]) == (dt.date(2026, 9, 27), dt.date(2026, 10, 1))
    assert c["days_in_week"] == 4
    assert abs(c["remaining_weeks"] - 4 / 7) < 1e-12


def test_before_fy_start_is_previous_year(spark):
    c = _cal(spark, "2026-09-30", month=10, day=1)
    assert c["fy_label"] == "FY2026"
    c = _cal(spark, "2026-10-01")
    assert c["fy_label"] == "FY2027"
    assert c["week_start"] == dt.date(2026, 10, 1)


def test_week_start_monday(spark):
    c = _cal(spark, "2026-07-07", wsw=0)
    assert c["week_start"] == dt.date(2026, 7, 6)
    assert c["week_end"] == dt.date(2026, 7, 13)


def test_weekly_allowance(spark):
    df = spark.createDataFrame([(1000.0, 7, 88), (1000.0, 7, 0)], "r double, d int, left int")
    got = [r[0] for r in df.select(fiscal.weekly_allowance(F.col("r"), F.col("d"), F.col("left"))).collect()]
    assert abs(got[0] - 1000.0 * 7 / 88) < 1e-9
    assert got[1] == 0.0
