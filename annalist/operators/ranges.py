"""Joins on time ranges as equi joins on calendar bins.

A plain range condition leaves Spark only a nested loop. Here each interval is
spread over the calendar bins it covers, so the join has a hash key, the work
splits by (key, bin) even when one key holds a large share of the rows, and
Spark picks broadcast or sort-merge by size. Bins are clamped to [LOW, HIGH]:
whatever lies outside shares the edge bin, so an open-ended interval spreads
over a bounded number of bins and the result stays exact for any date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.intervals import FAR_FUTURE, in_window, overlaps

LOW, HIGH = "1990-01-01", "2040-01-01"
BIN = "__bin"


def bin_of(on: Column, grain: str = "year") -> Column:
    """First day of the calendar bin that holds ``on``."""
    low, high = F.to_date(F.lit(LOW)), F.to_date(F.lit(HIGH))
    # least() and greatest() skip nulls: a missing date must have no bin at all
    clamped = F.least(F.greatest(on.cast("date"), low), high)
    return F.trunc(F.when(on.isNotNull(), clamped), grain)


def spread(df: DataFrame, start: Column, end: Column, grain: str = "year") -> DataFrame:
    """One row per bin that [start, end] covers; an absent end is open."""
    last = F.coalesce(end, F.to_date(F.lit(FAR_FUTURE)))
    step = F.expr("INTERVAL 1 MONTH" if grain == "month" else "INTERVAL 1 YEAR")
    bins = F.sequence(bin_of(start, grain), F.greatest(bin_of(last, grain), bin_of(start, grain)), step)
    return df.withColumn(BIN, F.explode(F.when(start.isNotNull() & (last >= start), bins)))


def _keys(keys: Sequence[str | tuple[str, str]]) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else k for k in keys]


def join_in_window(
    facts: DataFrame,
    windows: DataFrame,
    on: str,
    start: str,
    end: str,
    keys: Sequence[str | tuple[str, str]] = (),
    how: str = "inner",
    grain: str = "month",
) -> DataFrame:
    """Facts with the half-open windows that hold their date.

    Column names of the two sides must differ, but for ``keys``.
    """
    left = facts.withColumn(BIN, bin_of(F.col(on), grain))
    right = spread(windows, F.col(start), F.date_sub(F.col(end), 1), grain)
    for index, (_, r) in enumerate(_keys(keys)):
        right = right.withColumnRenamed(r, f"__k{index}")
    right = right.withColumnRenamed(BIN, "__wbin")
    condition = (F.col(BIN) == F.col("__wbin")) & in_window(F.col(on), F.col(start), F.col(end))
    for index, (l, _) in enumerate(_keys(keys)):
        condition = condition & (F.col(l) == F.col(f"__k{index}"))
    joined = left.join(right, condition, how)
    extra = [f"__k{index}" for index in range(len(keys))]
    return joined.drop(BIN, "__wbin", *extra)


def join_overlapping(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str | tuple[str, str]],
    a_range: tuple[str, str],
    b_range: tuple[str, str],
    grain: str = "year",
    b_half_open: bool = False,
) -> DataFrame:
    """Pairs of intervals with equal keys that share a day.

    Each pair meets in several bins but is kept only in the bin of the later
    start, so no dedupe is needed. Column names must differ, but for ``keys``.
    ``b_half_open``: b's end is the first day after it.
    """
    b_last = F.date_sub(F.col(b_range[1]), 1) if b_half_open else F.col(b_range[1])
    left = spread(a, F.col(a_range[0]), F.col(a_range[1]), grain)
    right = spread(b.withColumn("__last", b_last), F.col(b_range[0]), F.col("__last"), grain)
    for index, (_, r) in enumerate(_keys(keys)):
        right = right.withColumnRenamed(r, f"__k{index}")
    right = right.withColumnRenamed(BIN, "__wbin")
    condition = (
        (F.col(BIN) == F.col("__wbin"))
        & overlaps(F.col(a_range[0]), F.col(a_range[1]), F.col(b_range[0]), F.col("__last"))
        & (F.col(BIN) == bin_of(F.greatest(F.col(a_range[0]), F.col(b_range[0])), grain))
    )
    for index, (l, _) in enumerate(_keys(keys)):
        condition = condition & (F.col(l) == F.col(f"__k{index}"))
    extra = [f"__k{index}" for index in range(len(keys))]
    return left.join(right, condition, "inner").drop(BIN, "__wbin", "__last", *extra)
