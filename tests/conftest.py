"""Shared Spark session and small-frame builders for the operator tests."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spendpace.session import get_spark  # noqa: E402

HOURLY_SCHEMA = ("hour_start timestamp, compute_type string, workload_type string, "
                 "workload_id string, dbu_dollars decimal(18,4)")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", 8, app_name="spendpace-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


def hourly_history(end_day: dt.datetime, days: int, schedule, budget_id: int = 0):
    """Rows of ``schedule`` (compute, type, id, hour, dollars) on each of the
    ``days`` dates before ``end_day``, oldest first."""
    first = end_day.date().toordinal() - days
    dates = map(dt.date.fromordinal, range(first, first + days))
    return [(budget_id, dt.datetime.combine(date, dt.time(item[3])), *item[:3], item[4])
            for date in dates for item in schedule]


def usage_df(spark, rows):
    from decimal import Decimal
    return spark.createDataFrame(
        [(b, t, c, w, i, Decimal(str(d))) for b, t, c, w, i, d in rows],
        "budget_id int, " + HOURLY_SCHEMA)


NOW = dt.datetime(2026, 7, 7, 15, 0)  # a Tuesday, mid fiscal year, UTC
