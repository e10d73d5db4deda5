"""Queries that run the streaming jobs to the end of the given events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from annalist.plans.registry import query
from annalist.session import shared_dir
from annalist.streaming import jobs


def table_stream(t, name: str):
    """A table's own path as a stream, whether it is a file or a folder of files."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet").schema
    path = f"{t.sf_dir}/{name}.parquet"
    # a stream's source is a folder: the table's own, or that of its one file, by name
    files = t.spark.read.format("binaryFile").load(path).select("path").limit(1).first()
    if files is not None and files["path"].endswith(f"/{name}.parquet"):
        return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)
    return t.spark.readStream.schema(schema).parquet(path)


def event_stream(t):
    return table_stream(t, "events")


def reaction_stream(t):
    rows = event_stream(t).where("event_type = 'click'")
    return rows.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "vote").otherwise("bill").alias("entity_type"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("entity_id"), F.lit("hot").alias("reaction"),
        F.col("user_id").alias("visitor"), F.col("ts").cast("timestamp").alias("created_at"))


@query("u2_reactions_once_per_visitor", "U2", "SELECT entity_type, entity_id, count(DISTINCT visitor) AS visitors FROM reactions GROUP BY 1, 2")
def _(t):
    root = f"{shared_dir(t.spark)}/annalist/{uuid.uuid4().hex}"
    jobs.keep_once(reaction_stream(t), f"{root}/out", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{root}/out").groupBy("entity_type", "entity_id").agg(F.count(F.lit(1)).alias("visitors"))


@query("u1_engagement_appended", "U1", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2")
def _(t):
    root = f"{shared_dir(t.spark)}/annalist/{uuid.uuid4().hex}"
    stream = event_stream(t).withColumn("occurred_at", F.col("ts").cast("timestamp"))
    jobs.append_events(stream, f"{root}/out", f"{root}/state", ("view", "purchase")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{root}/out").groupBy("event_type", F.col("day").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("u3_month_top", "U3 G8", """
    SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, entity_type, entity_id, count(*) AS count FROM reactions GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY month ORDER BY count DESC, entity_type, entity_id) <= 5""")
def _(t):
    root = f"{shared_dir(t.spark)}/annalist/{uuid.uuid4().hex}"
    jobs.keep_monthly_top(reaction_stream(t), "created_at", ["entity_type", "entity_id"], f"{root}/table", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{root}/table/top").select(F.to_date(F.concat(F.date_format("month", "yyyy-MM"), F.lit("-01"))).alias("month"), "entity_type", "entity_id", "count")
