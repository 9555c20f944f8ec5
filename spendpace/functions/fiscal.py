"""Fiscal-year and budget-week date algebra as Column expressions.

Every function takes Columns (or names) so the calendar parameters can differ
per row (per budget). Weekday numbering is Monday = 0 .. Sunday = 6, as
returned by ``F.weekday``. All of it is plain Catalyst date arithmetic and
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def fy_start(d, month, day) -> Column:
    """Start of the fiscal year containing date ``d``."""
    d, month, day = _c(d), _c(month), _c(day)
    this_year = F.make_date(F.year(d), month, day)
    return F.when(d < this_year, F.make_date(F.year(d) - 1, month, day)).otherwise(this_year)


def fy_end(d, month, day) -> Column:
    """Exclusive end of the fiscal year containing ``d``."""
    return F.make_date(F.year(fy_start(d, month, day)) + 1, _c(month), _c(day))


def fy_label(d, month, day) -> Column:
    """The fiscal year is named for the calendar year it ends in."""
    return F.concat(F.lit("FY"), F.year(fy_end(d, month, day)).cast("string"))


def natural_week_start(d, week_start_weekday) -> Column:
    """Most recent configured weekday on or before ``d`` (no clamping)."""
    d = _c(d)
    return F.date_sub(d, F.pmod(F.weekday(d) - _c(week_start_weekday), F.lit(7)).cast("int"))


def week_start(d, month, day, week_start_weekday) -> Column:
    """Budget-week start: the natural week start, clamped to the FY start."""
    return F.greatest(natural_week_start(d, week_start_weekday), fy_start(d, month, day))


def week_end(d, month, day, week_start_weekday) -> Column:
    """Exclusive end of the budget week: the next natural boundary after the
    week start, clamped to the FY end (stub weeks at both FY ends)."""
    ws = week_start(d, month, day, week_start_weekday)
    fwd = F.pmod(_c(week_start_weekday) - F.weekday(ws), F.lit(7))
    fwd = F.when(fwd == 0, F.lit(7)).otherwise(fwd).cast("int")
    return F.least(F.date_add(ws, fwd), fy_end(d, month, day))


def days_in_week(d, month, day, week_start_weekday) -> Column:
    return F.datediff(week_end(d, month, day, week_start_weekday),
                      week_start(d, month, day, week_start_weekday))


def remaining_fy_days(d, month, day, week_start_weekday) -> Column:
    """Days from the current week's start through the FY end."""
    return F.datediff(fy_end(d, month, day), week_start(d, month, day, week_start_weekday))


def remaining_weeks(d, month, day, week_start_weekday) -> Column:
    return remaining_fy_days(d, month, day, week_start_weekday) / F.lit(7.0)


def weekly_allowance(remaining_budget, days_week, days_left) -> Column:
    """Remaining budget spread per day over the rest of the FY, times the
    current week's day count; zero when no days are left."""
    days_left = _c(days_left)
    return F.when(days_left <= 0, F.lit(0.0)).otherwise(
        _c(remaining_budget).cast("double") * _c(days_week) / days_left)


def week_dates(ws, we) -> Column:
    """Array of the dates in ``[ws, we)``."""
    ws, we = _c(ws), _c(we)
    return F.when(we > ws, F.sequence(ws, F.date_sub(we, 1))).otherwise(
        F.array().cast("array<date>"))


def calendar_columns(d, month="fy_start_month", day="fy_start_day",
                     wsw="week_start_weekday") -> dict[str, Column]:
    """All calendar facts for date ``d`` as named columns."""
    return {
        "fy_start": fy_start(d, month, day),
        "fy_end": fy_end(d, month, day),
        "fy_label": fy_label(d, month, day),
        "week_start": week_start(d, month, day, wsw),
        "week_end": week_end(d, month, day, wsw),
        "days_in_week": days_in_week(d, month, day, wsw),
        "remaining_fy_days": remaining_fy_days(d, month, day, wsw),
        "remaining_weeks": remaining_weeks(d, month, day, wsw),
        "natural_week_start": natural_week_start(d, wsw),
    }
