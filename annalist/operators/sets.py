"""Set operations, deduplication and top-k per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each key, with their ``rank`` from 1 if it is named.
    Spark keeps ``k`` rows per key and input partition before the shuffle, so a
    hot key arrives already cut down."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn(rank or "__rn", number).where(F.col(rank or "__rn") <= k)
    return kept if rank else kept.drop("__rn")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first along ``order``."""
    return _one(df, keys, F.min_by, order)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last along ``order``."""
    return _one(df, keys, F.max_by, order)


def _one(df, keys, pick, order):
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    one = pick(F.struct(*rest), F.struct(*order)).alias("__one")
    return df.groupBy(*keys).agg(one).select(*keys, *[F.col(f"__one.{c}").alias(c) for c in rest]).select(*df.columns)


def merge_tables(parts: Sequence[DataFrame], keys: Sequence[str], position: str = "position") -> DataFrame:
    """Union of several parses of one table; a later part replaces an earlier
    row with the same key."""
    tagged = None
    for number, part in enumerate(parts):
        one = part.withColumn("__part", F.lit(number))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    order = ["__part"] + ([position] if position in tagged.columns else [])
    return last_wins(tagged, keys, order).drop("__part")


def number_slugs(df: DataFrame, slug: str, ident: str, owner: str | None = None, by: str = "id", slice_rows: int = 4096) -> DataFrame:
    """Keep the slug of its first owner and extend the others by ``-id`` or by
    ``-n``. An existing owner (boolean column) ranks first.

    Numbers come from counts of (slug, hash slice) groups plus a rank inside the
    slice. A slug has as many slices as its rows ask for, so one shared by very
    many rows is still numbered in parallel.
    """
    taken = F.coalesce(F.col(owner), F.lit(False)) if owner else F.lit(False)
    first = df.groupBy(slug).agg(
        F.min_by(F.col(ident), F.struct(~taken, F.col(ident))).alias("__first"), F.ceil(F.count(F.lit(1)) / slice_rows).alias("__slots"))
    joined = df.join(first, slug)
    if by == "id":
        extended = F.concat_ws("-", F.col(slug), F.col(ident).cast("string"))
        return joined.withColumn(
            "unique_slug", F.when(F.col(ident) == F.col("__first"), F.col(slug)).otherwise(extended)
        ).drop("__first", "__slots")
    placed = joined.withColumn("__own", F.col(ident) == F.col("__first")).withColumn(
        "__slot", F.when(F.col("__own"), F.lit(-1)).otherwise(F.pmod(F.xxhash64(ident), F.col("__slots")).cast("int")))
    sizes = placed.groupBy(slug, "__slot").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(slug).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(slug).alias("__s"), F.col("__slot").alias("__t"), F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(slug, "__slot").orderBy(ident))
    numbered = placed.withColumn("__in", inside).join(offsets, (F.col(slug) == F.col("__s")) & (F.col("__slot") == F.col("__t")))
    number = F.col("__off") + F.col("__in")
    return numbered.withColumn(
        "unique_slug", F.when(number == 1, F.col(slug)).otherwise(F.concat_ws("-", F.col(slug), number.cast("string")))
    ).select(*df.columns, "unique_slug")


def changed_only(df: DataFrame, stored: str, computed: Column) -> DataFrame:
    """Rows whose computed value differs from the stored one, null included."""
    return df.withColumn("computed", computed).where(~F.col("computed").eqNullSafe(F.col(stored)))


def distinct_members_of(memberships: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct members of a set of groups(id)."""
    return memberships.join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi").select("member_id").distinct()


def batch_of_urls(items: DataFrame, url: str, position: str, offset: int, limit: int) -> DataFrame:
    """All items of ``limit`` distinct URLs, in order of first occurrence,
    after skipping ``offset`` URLs."""
    firsts = items.groupBy(url).agg(F.min(position).alias("__first"))
    batch = firsts.orderBy("__first", url).offset(offset).limit(limit)
    return items.join(batch.select(url), url, "left_semi")
