"""Procedure steps around a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.sets import top_per_key


def last_steps(facts: DataFrame, fact_id: str, on: str, steps: DataFrame, key: str, step_id: str, at: str, k: int) -> DataFrame:
    """Last ``k`` steps of the fact's key on or before its date, newest first.

    Facts of one (key, date) share the answer, so only distinct pairs are
    looked up. Per key and step, only the dates from the step's own on can use
    it; ranking steps first and keeping, per looked-up date, the ``k`` steps
    right before it avoids pairing all steps of a busy key with all its facts.
    """
    probes = facts.where(F.col(key).isNotNull() & F.col(on).isNotNull()).select(key, F.col(on).alias("__on")).distinct()
    found = _window_before(probes, steps.select(key, step_id, at), key, step_id, at, k)
    joined = facts.select(fact_id, key, F.col(on).alias("__on")).join(found, [key, "__on"])
    return joined.select(fact_id, step_id, at, "rn")


def _window_before(probes: DataFrame, steps: DataFrame, key: str, step_id: str, at: str, k: int) -> DataFrame:
    """For each (key, date): the k newest steps up to it. Steps are reduced to
    the k newest per (key, day), days are ranked per key, and a probe meets
    only the last k days up to its own."""
    from annalist.operators.scan import running

    daily = top_per_key(steps, [key, at], [F.desc(step_id)], k)
    days = daily.select(key, F.col(at).alias("__day")).distinct().withColumn("__new", F.lit(1))
    marks = probes.select(key, F.col("__on").alias("__day"), F.lit(0).alias("__new"), F.lit(1).alias("__probe"))
    both = days.withColumn("__probe", F.lit(0)).unionByName(marks)
    # order: a day's own mark counts for a probe on that day
    ranked = running(both, [key], ["__day", "__probe"], F.trunc("__day", "month"), {"__seq": ("__new", "sum")})
    day_seq = ranked.where("__probe = 0").select(F.col(key).alias("__k"), F.col("__day").alias("__d"), F.col("__seq").alias("__dseq"))
    want = ranked.where("__probe = 1").select(
        key, F.col("__day").alias("__on"), F.explode(F.sequence(F.greatest(F.col("__seq") - (k - 1), F.lit(1)), F.col("__seq"))).alias("__want")
    ).where("__want >= 1")
    near = want.join(day_seq, (F.col(key) == F.col("__k")) & (F.col("__want") == F.col("__dseq"))).select(key, "__on", "__d")
    hits = near.join(daily.withColumnRenamed(at, "__d"), [key, "__d"]).withColumnRenamed("__d", at)
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(key, "__on").orderBy(F.desc(at), F.desc(step_id)))
    return hits.withColumn("rn", rn).where(F.col("rn") <= k)
