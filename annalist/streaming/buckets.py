"""Tables that streams change: folders of buckets, of which a batch rewrites those it touches.

A row's bucket is a hash of its key. A micro-batch reads the buckets of its keys,
writes the new rows beside the table (the shared folder), and puts them in place
by a dynamic overwrite of those partitions alone; other buckets stay as they are.
A batch that runs again after a failure finds its buckets as they were, or as it
left them; the merges below give the same rows from both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.session import cut_lineage

BUCKET = "bucket"
#: Marks a key whose rows are gone, so that a bucket is never left without a row.
GONE = "gone"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, column: str) -> list:
    """The partitions that rows fall into: at most as many values as there are partitions."""
    return [r[0] for r in rows.select(column).distinct().collect()]


def replace_partitions(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Put ``rows`` in place of the partitions they fall into. They are written
    aside first, as they may be read from the same table."""
    held = cut_lineage(rows)
    held.write.partitionBy(*columns).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """A new table of buckets with the given rows."""
    rows.withColumn(GONE, F.lit(False)).withColumn(BUCKET, bucket_of(keys, buckets)).write.partitionBy(BUCKET).parquet(path)


def stored(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table's rows, of some buckets or of all; other buckets' files are not read."""
    rows = spark.read.parquet(path)
    if buckets is not None:
        rows = rows.where(F.col(BUCKET).isin(*buckets))
    return rows.where(~F.col(GONE)).drop(GONE, BUCKET)
