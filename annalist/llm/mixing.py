"""Mixing sources to target weights by entropy balancing.

A document's rate is the factor by which the mix takes it. Of all rates that
give each source its target number of tokens, entropy balancing wants the ones
closest to the documents' base rates in relative entropy, each weighed by the
document's size:

    minimise  sum size_d * (r_d log(r_d / b_d) - r_d + b_d)
    where     sum over d in s of size_d * r_d = target_s,   0 <= r_d <= cap

A second family of token constraints runs across the sources: each class of
documents (of length, here) should keep its share of the tokens. The two
families overlap, and with the cap they may contradict each other; so the
sources' constraints are exact, and those of the classes give way, at a price
that grows with the square of the gap.

The dual is convex, with one multiplier per source and one per class, and the
solution is the exponentially tilted rate ``r_d = min(cap, b_d * exp(tilt_s +
tilt_c))``. Its gradient and Hessian are sums over documents. The Hessian is
diagonal among the sources, of which there may be many, and small and dense among
the classes, which are few: a Newton step eliminates the sources, so that two
aggregates and a system of one equation per class give all multipliers. Rates
are rounded into whole copies by carrying the rounding error from document to
document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.ranks import placed
from annalist.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
_KEY, _SALT = "__mix_key", "__mix_salt"
#: Classes of length: each holds four times the words of the one before.
CLASSES = 8
#: The tilt of a source whose documents are all taken at the cap.
FULL = 200.0


def word_count(text: Column) -> Column:
    """Maximal runs of other characters than ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A key that is never null, so that a plain equi join serves null sources."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def length_class(size: Column) -> Column:
    """The class of a document by its words, 0 to CLASSES - 1."""
    return F.least(F.floor(F.log2(size + 1.0) / 2), F.lit(CLASSES - 1)).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size: one row per source) with ``target`` added.

    Sources in code-point order, null last, get the weights in turn and share
    the sum of all sizes by weight. No target exceeds ``cap`` times its source's
    size; what is over goes to the others by weight. In the solution every
    target is ``min(weight * level, cap * size)`` for one level; it rises from the
    even share as sources reach their cap, an aggregate a step. Empty input gives
    no rows; sources without words get target 0.
    """
    ranked = placed(sizes.select(F.col("source").isNull().alias("__none"), "source", "source_size"), ["__none", "source"], "__nth")
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.pmod("__nth", F.lit(len(weights))) + 1).cast("int"))
    weighed = cut_lineage(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")))
    level = -1.0
    while True:
        open_ = F.col("weight") * F.lit(level) < F.col("most")
        told = weighed.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(~open_, F.col("most"))).alias("full"), F.sum(F.when(open_, F.col("weight"))).alias("weights")
        ).first()
        if not told["weights"]:
            level = float("inf")  # every source is at its cap
            break
        raised = (told["total"] - (told["full"] or 0.0)) / told["weights"]
        if raised <= level:
            break
        level = raised
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), "most").alias("target"))


def tilts(
    cells: DataFrame, targets: DataFrame, cap: float = 3.0, softness: float = 0.2, tolerance: float = 1e-9, most_steps: int = 60
) -> tuple[DataFrame, list[float], int]:
    """The dual multipliers: ``targets`` (key, target) with ``tilt`` added, the
    tilts of the classes, and the number of Newton steps.

    ``cells`` (key, kind, base, size) holds the documents' sizes summed by source,
    class (0 to CLASSES - 1) and base rate. Of the sources that need not take every
    document at the cap, each class aims at its share of the base tokens; ``softness`` is the price of missing it: a tilt of t stands for a
    gap of ``softness * t`` of its target. Newton runs until every source's
    constraint is met to ``tolerance``, or no document of it is left below the cap.
    """
    start = cells.groupBy("key").agg(
        F.sum(F.col("size") * F.col("base")).alias("mass"), F.sum(F.when(F.col("base") > 0, F.col("size") * F.lit(float(cap)))).alias("most")
    )
    # a source that needs every document at the cap has no choice left
    full = F.col("target") >= F.col("most") * (1 - 1e-12)
    state = cut_lineage(
        targets.join(start, "key").select(
            "key", "target", F.when((F.col("target") > 0) & (F.col("mass") > 0), F.when(full, F.lit(FULL)).otherwise(F.log(F.col("target") / F.col("mass")))).alias("tilt")
        )
    )
    cells = cut_lineage(cells.join(state.where(F.col("tilt") < FULL).select("key"), "key"))
    shares = {r["kind"]: r["mass"] for r in cells.groupBy("kind").agg(F.sum(F.col("size") * F.col("base")).alias("mass")).collect()}  # CLASSES rows
    aimed = state.where(F.col("tilt") < FULL).agg(F.sum("target")).first()[0] or 0.0
    whole = sum(shares.values()) or 1.0
    goal = np.array([aimed * (shares.get(k) or 0.0) / whole for k in range(CLASSES)])
    price = np.maximum(softness * goal, 1e-12)
    kinds = np.zeros(CLASSES)
    for step in range(1, most_steps + 1):
        tilt = F.col("tilt") + F.element_at(F.lit([float(x) for x in kinds]), F.col("kind") + 1)
        free = F.col("base") * F.exp(tilt)
        slopes = [F.sum(F.when((F.col("kind") == k) & (free < cap), F.col("size") * free).otherwise(0.0)).alias(f"h{k}") for k in range(CLASSES)]
        taken = [F.sum(F.when(F.col("kind") == k, F.col("size") * F.least(free, F.lit(float(cap)))).otherwise(0.0)).alias(f"t{k}") for k in range(CLASSES)]
        by_source = cells.join(state, "key").groupBy("key", "target", "tilt").agg(*slopes, *taken)
        every = lambda name: sum((F.col(f"{name}{k}") for k in range(1, CLASSES)), F.col(f"{name}0"))
        by_source = cut_lineage(by_source.withColumn("gap", F.col("target") - every("t")).withColumn("slope", every("h")))
        moves = (F.col("slope") > F.col("target") * 1e-12) & (F.col("target") > 0)
        part = lambda value: F.sum(F.when(moves, value / F.col("slope")).otherwise(0.0))
        pairs = [(k, m) for k in range(CLASSES) for m in range(k, CLASSES)]
        told = by_source.agg(
            *[F.sum(f"t{k}").alias(f"t{k}") for k in range(CLASSES)],
            *[F.sum(F.when(moves, F.col(f"h{k}"))).alias(f"h{k}") for k in range(CLASSES)],
            *[part(F.col(f"h{k}") * F.col(f"h{m}")).alias(f"a{k}_{m}") for k, m in pairs],
            *[part(F.col(f"h{k}") * F.col("gap")).alias(f"b{k}") for k in range(CLASSES)],
            F.count_if(moves & (F.abs("gap") > F.col("target") * tolerance)).alias("open"),
        ).first()
        if told["open"] is None or told["t0"] is None:
            break  # no source is left to move
        value = lambda name: np.array([told[f"{name}{k}"] or 0.0 for k in range(CLASSES)])
        gradient = goal - value("t") - price * kinds
        if not told["open"] and np.all(np.abs(gradient) <= np.maximum(goal, 1.0) * 1e-7):
            break
        schur = np.diag(value("h") + price)
        for k, m in pairs:
            schur[k, m] -= told[f"a{k}_{m}"]
            if m > k:
                schur[m, k] -= told[f"a{k}_{m}"]
        change = np.clip(np.linalg.solve(schur, gradient - value("b")), -2.0, 2.0)
        shift = sum((F.col(f"h{k}") * F.lit(float(change[k])) for k in range(CLASSES)), F.lit(0.0))
        moved = F.when(moves, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("gap") - shift) / F.col("slope")))).otherwise(0.0)
        kinds = kinds + change
        following = by_source.select("key", (F.col("tilt") + moved).alias("next"))
        state = cut_lineage(state.join(following, "key", "left").select("key", "target", F.coalesce("next", "tilt").alias("tilt")))
    return state, [float(x) for x in kinds], step


def _rounded(frame: pd.DataFrame, cap: float) -> list[int]:
    """Copies for the documents of one group, largest first: each is rounded to
    one of the whole numbers next to its rate, whichever leaves the smaller
    error to carry on. Ends within half of a small document."""
    copies, carried, most = [], 0.0, int(cap)
    for size, rate in zip(frame["__size"].tolist(), frame["__rate"].tolist(), strict=True):
        low = int(rate + 1e-9)
        more = size > 0 and rate - low > 1e-9 and low < most and (rate - low) * size + carried >= size / 2
        copies.append(low + more)
        carried += (rate - low - more) * size
    return copies


def mix(
    docs: DataFrame,
    source: str = "source",
    identity: str = "doc_id",
    text: str = "text",
    base: str | None = None,
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    carry: Sequence[str] | None = None,
    group_rows: int = 1024,
    softness: float = 0.2,
) -> DataFrame:
    """Every row of ``docs``, with its size in words, its source's size and
    target, its ``rate``, its ``copies`` and the words ``taken`` (copies * size).

    ``base`` names a column of non-negative base rates; without it all are 1. The
    sources' targets are exact; each length class keeps its share of the words as
    far as they and the cap allow (see ``tilts``), so rates differ within a
    source by class. ``carry`` are the columns to keep
    (all, by default). Null text counts as empty, null sources are one source
    that comes last, null or negative base rates count as 0. Repeated rows are
    rounded each on its own; ties between equal sizes are settled by a hash of
    the identity, so reruns agree. Extra columns pass through untouched unless
    they are named like one of the results, which replace them. Empty input
    gives an empty result.

    A source's rows are split by hash into groups of about ``group_rows``, so a
    source with a third of the corpus is many small tasks.
    """
    made = ["size", "source_size", "target", "rate", "copies", "taken"]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in made]
    rate_base = F.lit(1.0) if base is None else F.greatest(F.coalesce(F.col(base).cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = docs.select(
        *kept,
        F.col(source).alias("__source"),
        word_count(F.col(text)).alias("__size"),
        rate_base.alias("__base"),
        F.xxhash64(F.col(identity), F.lit(7)).alias("__spot"),
    ).withColumn(_KEY, _source_key(F.col("__source"))).withColumn("__kind", length_class(F.col("__size")))
    cells = cut_lineage(
        sized.groupBy(F.col(_KEY).alias("key"), F.col("__kind").alias("kind"), F.col("__base").alias("base"))
        .agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("rows"), F.first("__source").alias("source"))
    )
    totals = cells.groupBy("key").agg(F.sum("size").alias("source_size"), F.sum("rows").alias("rows"), F.first("source").alias("source"))
    aims = cut_lineage(totals.join(source_targets(totals.select("source", "source_size"), weights, cap).select(_source_key(F.col("source")).alias("key"), "target"), "key"))
    by_source, kinds, _ = tilts(cells, aims.select("key", "target"), cap, softness)
    by_kind = [float(x) for x in np.exp(kinds)]
    solved = cut_lineage(
        aims.join(by_source.drop("target"), "key").select(
            F.col("key").alias(_KEY), "source_size", "target", F.exp("tilt").alias("__tilt"), F.ceil(F.col("rows") / group_rows).alias("__groups")
        )
    )
    grouped = sized.join(solved, _KEY).select(
        *kept,
        "__size",
        "__spot",
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
        F.coalesce(F.least(F.col("__base") * F.col("__tilt") * F.element_at(F.lit(by_kind), F.col("__kind") + 1), F.lit(float(cap))), F.lit(0.0)).alias("__rate"),
        _KEY,
        F.pmod("__spot", "__groups").alias(_SALT),
    )
    schema = grouped.select(*kept, "__size", "__source_size", "__target", "__rate", F.lit(0).alias("__copies")).schema

    def round_group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__size", "__spot"], ascending=[False, True], kind="stable")
        frame["__copies"] = _rounded(frame, cap)
        return frame[[*kept, "__size", "__source_size", "__target", "__rate", "__copies"]]

    rounded = grouped.groupBy(_KEY, _SALT).applyInPandas(round_group, schema)
    return rounded.select(
        *kept,
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__rate").alias("rate"),
        F.col("__copies").alias("copies"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )
