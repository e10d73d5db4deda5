"""As-of lookups: the best interval of a key on a date or in a period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.intervals import active_on
from annalist.operators.ranges import BIN, bin_of, join_overlapping, spread


def best_per_key(df: DataFrame, keys: Sequence[str], rank: Sequence[Column], take: Sequence[str]) -> DataFrame:
    """One row per key: that with the greatest ``rank``.

    An aggregate, so each task sends one row per key: a key that holds a third
    of all rows costs no more than any other. Every rank needs a final id.
    """
    best = F.max_by(F.struct(*take), F.struct(*rank)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in take])


def latest_on(
    facts: DataFrame,
    intervals: DataFrame,
    key: str,
    on: str,
    start: str,
    end: str,
    take: Sequence[str],
    rank: Sequence[str],
    grain: str = "year",
) -> DataFrame:
    """Every fact with ``take`` of the greatest-``rank`` interval of its key
    that is active on its date (both ends included), null where there is none.

    Only the distinct (key, date) pairs are looked up, and intervals are spread
    over calendar bins, so a popular key costs at most its days per bin.
    """
    probes = facts.select(key, F.col(on).alias("__on")).where(F.col(on).isNotNull()).distinct()
    probes = probes.withColumn(BIN, bin_of(F.col("__on"), grain))
    payload = list(dict.fromkeys([*take, *rank]))
    spans = spread(
        intervals.select(
            F.col(key).alias("__key"), F.col(start).alias("__s"), F.col(end).alias("__e"),
            F.struct(*payload).alias("__row"),
        ),
        F.col("__s"), F.col("__e"), grain,
    ).withColumnRenamed(BIN, "__sbin")
    found = probes.join(
        spans,
        (F.col(key) == F.col("__key")) & (F.col(BIN) == F.col("__sbin"))
        & active_on(F.col("__s"), F.col("__e"), F.col("__on")),
    )
    winner = (
        found.groupBy(key, BIN, "__on")
        .agg(F.max_by(F.struct(*[F.col(f"__row.{c}") for c in take]),
                      F.struct(*[F.col(f"__row.{c}") for c in rank])).alias("__best"))
        .select(F.col(key).alias("__key"), "__on", "__best")
    )
    joined = facts.join(winner, (F.col(key) == F.col("__key")) & (F.col(on) == F.col("__on")), "left")
    return joined.select(*[F.col(c) for c in facts.columns], *[F.col(f"__best.{c}").alias(c) for c in take])


def latest_on_or_any(
    facts: DataFrame, intervals: DataFrame, key: str, on: str, start: str, end: str,
    take: Sequence[str], rank: Sequence[str], grain: str = "year",
) -> DataFrame:
    """As latest_on; a fact without an active interval gets the key's greatest
    ``rank`` interval of any date."""
    dated = latest_on(
        facts, intervals.withColumn("__hit", F.lit(True)), key, on, start, end,
        [*take, "__hit"], rank, grain,
    )
    any_date = best_per_key(intervals, [key], [F.col(c) for c in rank], take)
    any_date = any_date.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__any_{c}") for c in take])
    joined = dated.join(any_date, F.col(key) == F.col("__key"), "left")
    chosen = [F.when(F.col("__hit"), F.col(c)).otherwise(F.col(f"__any_{c}")).alias(c) for c in take]
    return joined.select(*[F.col(c) for c in facts.columns], *chosen)


def latest_overlapping(
    periods: DataFrame, intervals: DataFrame, keys: Sequence[str], period_id: str,
    period: tuple[str, str], span: tuple[str, str], take: Sequence[str], rank: Sequence[str],
) -> DataFrame:
    """Every period with ``take`` of the greatest-``rank`` interval that shares
    a day with it, null where there is none."""
    payload = list(dict.fromkeys([*take, *rank]))
    spans = intervals.select(
        *[F.col(k) for k in keys], F.col(span[0]).alias("__s"), F.col(span[1]).alias("__e"),
        F.struct(*payload).alias("__row"),
    )
    slim = periods.select(F.col(period_id).alias("__pid"), *keys, F.col(period[0]).alias("__ps"), F.col(period[1]).alias("__pe"))
    pairs = join_overlapping(slim, spans, keys, ("__ps", "__pe"), ("__s", "__e"))
    winner = pairs.groupBy("__pid").agg(
        F.max_by(F.struct(*[F.col(f"__row.{c}") for c in take]),
                 F.struct(*[F.col(f"__row.{c}") for c in rank])).alias("__best")
    )
    joined = periods.join(winner, F.col(period_id) == F.col("__pid"), "left")
    return joined.select(*[F.col(c) for c in periods.columns], *[F.col(f"__best.{c}").alias(c) for c in take])


def open_first(start: Column, end: Column) -> list[Column]:
    """Rank for 'current': open-ended before closed, then the later start."""
    return [end.isNull(), start]
