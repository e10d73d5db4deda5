"""Interval predicates. Each boundary convention has its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR_FUTURE = "9999-12-31"


def open_end(end: Column) -> Column:
    """An absent end means the interval is still open."""
    return F.coalesce(end, F.to_date(F.lit(FAR_FUTURE)))


def active_on(start: Column, end: Column, on: Column) -> Column:
    """``on`` lies in [start, end], both ends included."""
    return (start <= on) & (end.isNull() | (end >= on))


def active_on_bounded(start: Column, end: Column, outer_end: Column, on: Column) -> Column:
    """As active_on, with the earlier of two optional ends."""
    return active_on(start, F.least(end, outer_end), on)


def in_window(on: Column, start: Column, end: Column) -> Column:
    """``on`` lies in [start, end): the end belongs to the next window."""
    return (on >= start) & (on < end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """[a] and [b] share a day, all ends included."""
    return (a_start <= open_end(b_end)) & (b_start <= open_end(a_end))


def overlaps_window(start: Column, end: Column, w_start: Column, w_end: Column) -> Column:
    """[start, end] shares a day with the half-open window [w_start, w_end)."""
    return (start < w_end) & (end.isNull() | (end >= w_start))


def touches(on: Column, start: Column, end: Column) -> Column:
    """``on`` lies in [start, end] or is the day after the end."""
    return (on >= start) & (end.isNull() | (on <= F.date_add(end, 1)))


def adjoins(left_end: Column, right_start: Column) -> Column:
    """The right interval starts on the left one's last day or the day after."""
    return F.coalesce(
        (left_end == right_start) | (F.date_add(left_end, 1) == right_start), F.lit(False)
    )


def year_month_range(year: int, month: int | None = None) -> tuple[str, str]:
    """Half-open date range of a year, or of one month of it."""
    if month is None:
        return f"{year}-01-01", f"{year + 1}-01-01"
    following = f"{year + 1}-01-01" if month == 12 else f"{year}-{month + 1:02d}-01"
    return f"{year}-{month:02d}-01", following


def in_year(on: Column, year: int, month: int | None = None) -> Column:
    start, end = year_month_range(year, month)
    return in_window(on, F.to_date(F.lit(start)), F.to_date(F.lit(end)))


def next_day(on: Column) -> Column:
    return F.date_add(on, 1)


def previous_day(on: Column) -> Column:
    return F.date_sub(on, 1)


def days_inclusive(start: Column, end: Column) -> Column:
    """Days from start to end, both counted, never below zero."""
    return F.greatest(F.datediff(end, start) + 1, F.lit(0))


def earliest(*dates: Column) -> Column:
    """Least of the dates that are present."""
    return F.least(*dates)


def latest(*dates: Column) -> Column:
    """Greatest of the dates that are present."""
    return F.greatest(*dates)
