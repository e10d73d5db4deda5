"""Continuously arriving facts as Structured Streaming jobs.

Checkpoint locations are the caller's and must be on storage all executors
share. Jobs that merge keep no state in the stream: what they know is in their
table (see ``annalist.streaming.buckets``), of which a batch touches a part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.ingest import merge_placed, place_discoveries
from annalist.operators.sets import top_per_key
from annalist.session import cut_lineage
from annalist.streaming.buckets import BUCKET, GONE, bucket_of, replace_partitions, stored, touched


def append_events(stream: DataFrame, path: str, checkpoint: str, event_types: Sequence[str] = ("page_view", "search")):
    """Page views and searches appended as they arrive, by day."""
    kept = stream.where(F.col("event_type").isin(*event_types)).withColumn("day", F.to_date("occurred_at"))
    return kept.writeStream.format("parquet").outputMode("append").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)


REACTION_KEYS = ("entity_type", "entity_id", "reaction", "visitor")


def once_per_visitor(stream: DataFrame, at: str = "created_at", horizon: str = "30 days") -> DataFrame:
    """One reaction per (entity, reaction, visitor) within the horizon: state is
    bounded, and a repeat later than that counts again."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(list(REACTION_KEYS))


def keep_once(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = REACTION_KEYS, buckets: int = 64):
    """One row per key for good. What was seen is the table itself: a batch looks
    into the buckets of its keys and adds a folder of its own with those that are
    new. Rows of one key in one batch: any one. A batch that runs again replaces
    its folder."""
    batch_of = "batch"

    def keep(batch: DataFrame, number: int) -> None:
        fresh = cut_lineage(batch.dropDuplicates(list(keys)).withColumn(BUCKET, bucket_of(keys, buckets)))
        if number > 0:
            known = fresh.withColumn(batch_of, F.lit(number).cast("int")).schema
            seen = batch.sparkSession.read.schema(known).parquet(path).where(F.col(BUCKET).isin(*touched(fresh, BUCKET)) & (F.col(batch_of) < number))
            fresh = fresh.join(seen.select(*keys), list(keys), "left_anti")
        replace_partitions(fresh.withColumn(batch_of, F.lit(number).cast("int")), path, [batch_of, BUCKET])

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def keep_monthly_top(stream: DataFrame, at: str, keys: Sequence[str], root: str, checkpoint: str, k: int = 5):
    """The top ``k`` keys of each month under ``root/top``, day counts under ``root/daily``.

    Both tables are folders of months, and a batch rewrites the months it has
    rows of. Its own counts carry its number until the next batch of the month,
    which adds them to the settled ones: a batch that runs again replaces its
    rows, a late row, however late, still counts, and the table holds at most two
    rows a day and key.
    """

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        month = F.date_format(F.col("day"), "yyyy-MM").alias("month")
        fresh = batch.groupBy(F.to_date(at).alias("day"), *keys).agg(F.count(F.lit(1)).alias("n")).where("day IS NOT NULL")
        fresh = cut_lineage(fresh.select("day", *keys, "n", F.lit(number).cast("long").alias("batch"), month))
        months = touched(fresh, "month")
        daily = fresh
        if number > 0:
            held = spark.read.schema(fresh.schema).parquet(f"{root}/daily").where(F.col("month").isin(*months) & (F.col("batch") < number))
            settled = held.groupBy("month", "day", *keys).agg(F.sum("n").alias("n")).withColumn("batch", F.lit(-1).cast("long"))
            daily = fresh.unionByName(settled)
        daily = cut_lineage(daily)
        counted = daily.groupBy("month", *keys).agg(F.sum("n").alias("count"))
        top = top_per_key(counted, ["month"], [F.desc("count"), *[F.asc(c) for c in keys]], k)
        replace_partitions(daily, f"{root}/daily", ["month"])
        replace_partitions(top, f"{root}/top", ["month"])

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)


def merge_discoveries(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Discovery upserts per micro-batch into a table of buckets by id (made by
    ``buckets.create``). Addresses and numbers of all stored rows are looked up;
    only the buckets of rows that match, and of new ones, are rewritten."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        placed = cut_lineage(place_discoveries(stored(spark, path), batch).withColumn(BUCKET, bucket_of(["id"], buckets)))
        part = stored(spark, path, touched(placed, BUCKET))
        merged = merge_placed(part, placed.drop(BUCKET))
        replace_partitions(merged.withColumn(GONE, F.lit(False)).withColumn(BUCKET, bucket_of(["id"], buckets)), path, [BUCKET])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def refresh_touched(stream: DataFrame, key: str, path: str, rebuild, checkpoint: str, buckets: int = 64):
    """Recompute a read model for the keys each micro-batch touches and put them
    in place of the old rows, in the buckets of these keys alone.
    ``rebuild(keys)`` gives the model's rows for a DataFrame of keys."""

    def refresh(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keys = cut_lineage(batch.select(key).distinct().withColumn(BUCKET, bucket_of([key], buckets)))
        part = stored(spark, path, touched(keys, BUCKET))
        fresh = cut_lineage(rebuild(keys.select(key)).select(*part.columns))
        kept = part.join(keys.select(key), key, "left_anti").unionByName(fresh).withColumn(GONE, F.lit(False))
        gone = keys.select(key).join(fresh.select(key), key, "left_anti").withColumn(GONE, F.lit(True))
        after = kept.unionByName(gone, allowMissingColumns=True).withColumn(BUCKET, bucket_of([key], buckets))
        replace_partitions(after, path, [BUCKET])

    return stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
