"""Ordered scans over a key (lag, running sum, running max, carry forward)
that do not put a whole key into one task.

A window over a key sorts all its rows in one task. Here a key's rows are cut
into slices that follow the order (a month of the start date, say). Windows run
inside (key, slice); what a slice passes on is one aggregated row, and only
those rows, as many as there are slices, are scanned per key. The sliced rows are
written once and read for both, so that stacked scans plan their input once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.session import cut_lineage

SLICE = "__slice"


def _same(left: Sequence[str]) -> Column:
    condition = F.col(SLICE).eqNullSafe(F.col(f"__c_{SLICE}"))
    for name in left:
        condition = condition & F.col(name).eqNullSafe(F.col(f"__c_{name}"))
    return condition


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, previous: dict[str, str]) -> DataFrame:
    """Add columns with the value of the preceding row: {new name: column}.

    ``slice_by`` must never fall along ``order``.
    """
    sliced = cut_lineage(df.withColumn(SLICE, slice_by))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    values = F.struct(F.lit(True).alias("__present"), *[F.col(c).alias(n) for n, c in previous.items()])
    local = sliced.withColumn("__prev", F.lag(values).over(inside))
    ends = sliced.groupBy(*keys, SLICE).agg(F.max_by(values, F.struct(*order)).alias("__last"))
    along = Window.partitionBy(*keys).orderBy(SLICE)
    carried = ends.select(
        *[F.col(k).alias(f"__c_{k}") for k in [*keys, SLICE]], F.lag("__last").over(along).alias("__carry")
    )
    joined = local.join(carried, _same(keys), "left")
    prior = F.coalesce(F.col("__prev"), F.col("__carry"))
    return joined.select(*df.columns, *[prior[n].alias(n) for n in previous])


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column,
    measures: dict[str, tuple[str, str]], before: bool = False,
) -> DataFrame:
    """Add running values: {new name: (column, 'sum' | 'max' | 'last')}.

    'last' carries the newest non-null value forward. ``before`` leaves the
    row itself out.
    """
    sliced = cut_lineage(df.withColumn(SLICE, slice_by))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    along = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole, local, merged = [], sliced, []
    passed = [F.col(k).alias(f"__c_{k}") for k in [*keys, SLICE]]
    for name, (column, kind) in measures.items():
        value = F.col(column)
        if kind == "last":
            whole.append(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(f"__w_{name}"))
            passed.append(F.last(f"__w_{name}", ignorenulls=True).over(along).alias(f"__p_{name}"))
            local = local.withColumn(f"__l_{name}", F.last(value, ignorenulls=True).over(frame))
            merged.append(F.coalesce(F.col(f"__l_{name}"), F.col(f"__p_{name}")).alias(name))
        elif kind == "max":
            whole.append(F.max(value).alias(f"__w_{name}"))
            passed.append(F.max(f"__w_{name}").over(along).alias(f"__p_{name}"))
            local = local.withColumn(f"__l_{name}", F.max(value).over(frame))
            merged.append(F.greatest(F.col(f"__l_{name}"), F.col(f"__p_{name}")).alias(name))
        else:
            whole.append(F.sum(value).alias(f"__w_{name}"))
            passed.append(F.sum(f"__w_{name}").over(along).alias(f"__p_{name}"))
            local = local.withColumn(f"__l_{name}", F.sum(value).over(frame))
            merged.append((F.coalesce(F.col(f"__l_{name}"), F.lit(0)) + F.coalesce(F.col(f"__p_{name}"), F.lit(0))).alias(name))
    carried = sliced.groupBy(*keys, SLICE).agg(*whole).select(*passed)
    return local.join(carried, _same(keys), "left").select(*df.columns, *merged)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, opens: str, name: str = "island") -> DataFrame:
    """Number-free island label: the order values of the row that opened it."""
    marked = df.withColumn("__open", F.when(F.col(opens), F.struct(*order)))
    return running(marked, keys, order, slice_by, {name: ("__open", "last")}).drop("__open")
