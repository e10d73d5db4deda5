"""The ledger of ingestion runs, replayed from an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.scan import running
from annalist.session import cut_lineage

COUNTS = ("discovered", "imported", "partial", "failed", "skipped", "expected")


def run_ledger(log: DataFrame, hours: int = 6) -> DataFrame:
    """The state of every run after the whole log.

    log(event_id, run_id, kind, event, at, discovered, imported, partial, failed,
    skipped, expected, read_models, error). Events: ``start``, ``step`` (a partial
    summary) and ``finish``, or ``fail`` for a run that broke off. An event that
    is logged again counts once, whatever order the log has.

    The summaries of a run add up; ``read_models`` is the last one that is given,
    errors are joined in order of time. A finished run failed if it failed without
    finding or importing anything; failures, partial imports and errors make it
    partial, else it is completed. A run that is still running when another run
    of its kind starts more than ``hours`` later is stale: it failed at that
    moment, unless it still finishes afterwards. What else has not finished is
    running. A run without a start is left out.
    """
    events = log.dropDuplicates(["event_id"])
    at = lambda *kinds: F.when(F.col("event").isin(*kinds), F.col("at"))
    errors = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("at", "event_id", "error"))))
    runs = events.groupBy("run_id").agg(
        F.min_by("kind", at("start")).alias("kind"),
        F.min(at("start")).alias("started_at"),
        F.max(at("finish", "fail")).alias("ended_at"),
        F.max_by("event", F.struct(at("finish", "fail"), "event_id")).alias("last_event"),
        F.max_by("read_models", F.when(F.col("read_models").isNotNull(), F.struct("at", "event_id"))).alias("read_models"),
        F.count("error").alias("errors"),
        F.array_join(F.transform(errors, lambda e: e["error"]), "; ").alias("error"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS],
    ).where("started_at IS NOT NULL")
    runs = cut_lineage(runs)
    # the next start of the kind after a run's limit: a scan from late to early,
    # a limit before the starts of the same moment, which are not later
    late = lambda c: -F.unix_micros(c)
    limit = F.col("started_at") + F.expr(f"INTERVAL {hours} HOURS")
    probes = runs.select("kind", "run_id", late(limit).alias("back"), F.lit(0).alias("turn"), F.lit(None).cast("timestamp").alias("start"))
    starts = runs.select("kind", F.lit(None).cast(runs.schema["run_id"].dataType).alias("run_id"), late(F.col("started_at")).alias("back"), F.lit(1).alias("turn"), F.col("started_at").alias("start"))
    scanned = running(probes.unionByName(starts).withColumn("tie", F.coalesce(F.col("run_id").cast("string"), F.lit(""))), ["kind"], ["back", "turn", "tie"],
                      F.floor(F.col("back") / F.lit(86_400_000_000)), {"stale_at": ("start", "last")})
    stale = scanned.where("turn = 0").select("run_id", "stale_at")
    joined = runs.join(stale, "run_id")
    cut_off = F.col("stale_at").isNotNull() & F.col("ended_at").isNull()
    summed = F.when((F.col("imported") == 0) & (F.col("discovered") == 0) & (F.col("failed") > 0), "failed").when(
        (F.col("failed") > 0) | (F.col("partial") > 0) | (F.col("errors") > 0), "partial").otherwise("completed")
    status = F.when(cut_off, "failed").when(F.col("ended_at").isNull(), "running").when(F.col("last_event") == "fail", "failed").otherwise(summed)
    return joined.select(
        "run_id", "kind", status.alias("status"), "started_at", F.coalesce("ended_at", F.when(cut_off, F.col("stale_at"))).alias("finished_at"),
        *COUNTS, "read_models", "errors", F.nullif(F.concat_ws("; ", F.nullif("error", F.lit("")), F.when(cut_off, F.lit(f"still running after {hours} hours"))), F.lit("")).alias("error"))
