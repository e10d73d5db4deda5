"""Approximate nearest neighbours by inner product: a hierarchical k-means tree.

A bounded sample is split by k-means into branches, again and again, down to
small leaves. Every row is then sent down the tree to its leaf, which is the
index. A query walks the tree best bin first: a priority queue holds the nodes
seen so far by the distance of their centres, the nearest is opened next, and
leaves come out in the order in which they are worth a visit. How many leaves a
query visits is calibrated: a bounded set of queries is also compared with every
row, and the visits widen until the wanted part of the true neighbours is found.

For the tree, vectors get one more coordinate, so that all have the same length
and the largest inner product is the smallest distance.

Rows of one subtree are a task's work; a subtree with many rows (one vector may
hold a third of them) is split by hash into several, and each of them returns a
query's best only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows that shape the tree, ``trials`` the queries
    that calibrate it, ``recall`` is what calibration has to reach."""

    neighbours: int = 20
    branches: int = 8
    leaf_rows: int = 64
    sample: int = 16_000
    rounds: int = 8
    trials: int = 200
    recall: float = 0.96
    group_leaves: int = 8
    task_rows: int = 8_192
    seed: int = 17


@dataclass
class Tree:
    """Nodes in the order of a walk; leaves are numbered in that order, so near
    numbers are near in the tree. ``leaf`` is -1 for inner nodes."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.square(centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def k_means(rows: np.ndarray, count: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster numbers. The first centres are different rows; empty clusters stay empty."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[rng.choice(len(distinct), min(count, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = _nearest(rows, centres)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return _nearest(rows, centres)


def grow(rows: np.ndarray, settings: Settings) -> Tree:
    """The tree of a sample. A node is a leaf if it is small or all its rows are equal."""
    rng = np.random.default_rng(settings.seed)
    centres: list[np.ndarray] = []
    tree = Tree(rows[:0])

    def add(own: np.ndarray) -> int:
        number = len(centres)
        centres.append(own.mean(axis=0))
        tree.children.append([])
        tree.leaf.append(-1)
        parts = []
        if len(own) > settings.leaf_rows and (own != own[0]).any():
            cluster = k_means(own, settings.branches, settings.rounds, rng)
            parts = [own[cluster == c] for c in np.unique(cluster)]
        if len(parts) > 1:
            tree.children[number] = [add(p) for p in parts]
        else:
            tree.leaf[number] = max(tree.leaf) + 1
        return number

    add(rows)
    tree.centres = np.array(centres)
    return tree


def leaf_of(rows: np.ndarray, tree: Tree) -> np.ndarray:
    """Each row's leaf: from the root, always to the nearest child."""
    found = np.zeros(len(rows), np.int64)
    todo = [(0, np.arange(len(rows)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if tree.leaf[node] >= 0:
            found[own] = tree.leaf[node]
            continue
        children = tree.children[node]
        near = _nearest(rows[own], tree.centres[children])
        todo.extend((child, own[near == k]) for k, child in enumerate(children))
    return found


def best_bins(query: np.ndarray, tree: Tree) -> Iterator[int]:
    """Leaves in the order of a best-bin-first walk."""
    distance = np.square(tree.centres - query).sum(axis=1)
    queue = [(float(distance[0]), 0)]
    while queue:
        _, node = heapq.heappop(queue)
        if tree.leaf[node] >= 0:
            yield tree.leaf[node]
        for child in tree.children[node]:
            heapq.heappush(queue, (float(distance[child]), child))


def visited(query: np.ndarray, tree: Tree, visits: int, rows: np.ndarray, least: int) -> list[int]:
    """The leaves a query visits: ``visits``, and on until they hold ``least`` rows."""
    chosen, held = [], 0
    for leaf in best_bins(query, tree):
        if len(chosen) >= visits and held >= least:
            break
        chosen.append(leaf)
        held += rows[leaf]
    return chosen


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """With the coordinate that makes all as long as the longest."""
    rest = np.sqrt(np.maximum(longest - np.square(rows).sum(axis=1), 0.0))
    return np.hstack([rows, rest[:, None]])


def _flat(query: np.ndarray) -> np.ndarray:
    return np.append(query, 0.0)


def best_of(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, scores) of its best rows, by score and then id,
    without the row of its own id. A product finds those that may be among
    them; their scores are then summed in one fixed order, so equal vectors
    have equal scores wherever they stand."""
    step = max(1, 8_000_000 // max(1, len(rows)))
    for at in range(0, len(queries), step):
        product = queries[at : at + step] @ rows.T
        for k, line in enumerate(product, at):
            line[ids == own[k]] = -np.inf
            if len(line) > count:
                bound = np.partition(line, len(line) - count)[len(line) - count]
                near = np.flatnonzero(line >= bound - 1e-9 * (1 + abs(bound))) if np.isfinite(bound) else np.flatnonzero(np.isfinite(line))
            else:
                near = np.flatnonzero(np.isfinite(line))
            score = (rows[near] * queries[k]).sum(axis=1)
            order = np.lexsort((ids[near], -score))[:count]
            yield k, ids[near][order], score[order]


def taking_part(vectors: DataFrame, identity: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that can be compared: identity and vector not
    null, components neither null, infinite nor NaN, not all zero, and as many
    of them as most rows have (of equally frequent lengths the smallest)."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(identity).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), "size").first()
    return rows.where(F.size("vector") == (usual["size"] if usual else 0))


def search(vectors: DataFrame, asked: Column, identity: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """The rows for which ``asked`` holds, each with its nearest other rows:
    query_id, rank (from 1), vec_id, score (inner product in double precision),
    by score and then the smaller id.

    Rows that can't be compared (see ``taking_part``) are neither queries nor
    candidates. A query row repeated under one id is asked once, with the
    smallest of its vectors; repeated candidate rows are candidates each. With
    fewer candidates than wanted all are returned. Other columns are not read.
    Empty input gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sound = taking_part(vectors, identity, vector)
    norm = F.aggregate("vector", F.lit(0.0), lambda n, x: n + x * x)
    whole = sound.agg(F.max(norm).alias("longest"), F.count(F.lit(1)).alias("rows")).first()
    if not whole["rows"]:
        return spark.createDataFrame([], schema)
    longest = whole["longest"]

    spot = F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(1 << 30))
    share = min(1.0, settings.sample / whole["rows"])
    drawn = sound.where(spot < int(share * (1 << 30)) + 1).orderBy(spot, "id", "vector").limit(settings.sample).select("vector").toArrow()
    tree = grow(_lifted(_matrix(drawn["vector"]), longest), settings)  # at most ``sample`` rows on the driver
    shared = spark.sparkContext.broadcast((tree, longest))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, top = shared.value
        for batch in batches:
            if len(batch):
                leaf = leaf_of(_lifted(_matrix(batch.column(1)), top), own)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), batch.column(0), batch.column(1)], names=["leaf", "id", "vector"])

    index = cut_lineage(sound.mapInArrow(place, "leaf long, id long, vector array<double>"))
    asking = vectors.where(asked).select(F.col(identity).cast("long").alias("id")).distinct()
    queries = cut_lineage(index.join(asking, "id").groupBy("id").agg(F.min("vector").alias("vector")))

    rows_of = np.zeros(tree.leaves, np.int64)
    for row in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")).collect():  # one number per leaf
        rows_of[row["leaf"]] = row["rows"]
    visits = calibrated(index, queries, tree, settings)

    # a group is some leaves next to each other, cut by hash where they hold many rows
    groups = -(-tree.leaves // settings.group_leaves)
    held = [int(rows_of[g * settings.group_leaves : (g + 1) * settings.group_leaves].sum()) for g in range(groups)]
    parts = F.lit([max(1, -(-n // settings.task_rows)) for n in held])
    group = F.floor(F.col("leaf") / settings.group_leaves).cast("int")
    dealt = index.withColumn("group", group).withColumn("part", F.pmod(F.xxhash64("id"), F.get(parts, F.col("group"))).cast("int"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = shared.value
        for batch in batches:
            ids, found = [], []
            for k, query in enumerate(_matrix(batch.column(1)) if len(batch) else []):
                ids.append(k)
                found.append(visited(_flat(query), own, visits, rows_of, settings.neighbours + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "vector", "leaves"])

    walked = queries.mapInArrow(walk, "id long, vector array<double>, leaves array<long>")
    sent = (
        walked.select("id", "vector", F.explode("leaves").alias("leaf"))
        .groupBy("id", group.alias("group"))
        .agg(F.first("vector").alias("vector"), F.collect_list("leaf").alias("leaves"))
        .select("id", "vector", "leaves", "group", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("group")) - 1)).alias("part"))
    )

    def compare(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if asks.num_rows and rows.num_rows:
            ids, leaf, matrix = rows["id"].to_numpy(), rows["leaf"].to_numpy(), _matrix(rows["vector"])
            query_ids, points = asks["id"].to_numpy(), _matrix(asks["vector"])
            wanted = asks["leaves"].to_pylist()
            for number in np.unique(leaf):
                who = np.array([k for k, w in enumerate(wanted) if number in w], np.int64)
                mine = np.flatnonzero(leaf == number)
                for k, near, score in best_of(points[who], ids[mine], matrix[mine], query_ids[who], settings.neighbours):
                    out["query_id"].append(np.full(len(near), query_ids[who[k]]))
                    out["vec_id"].append(near)
                    out["score"].append(score)
        if not out["query_id"]:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        frame = pd.DataFrame({k: np.concatenate(v) for k, v in out.items()}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return pa.Table.from_pandas(frame.groupby("query_id", sort=False).head(settings.neighbours), preserve_index=False)

    some = sent.groupBy("group", "part").cogroup(dealt.groupBy("group", "part")).applyInArrow(compare, "query_id long, vec_id long, score double")
    return _ranked(some, settings.neighbours).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, count: int) -> DataFrame:
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= count)


def against_all(index: DataFrame, queries: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, vec_id, score, leaf, rank): the true neighbours of a bounded
    set of queries, by comparing them with every row, block by block. Each
    block returns its best only."""
    table = queries.select("id", "vector").toArrow()
    shared = index.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), _matrix(table["vector"]) if table.num_rows else np.empty((0, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, points = shared.value
        for batch in batches:
            if not len(batch) or not len(own):
                continue
            leaf, ids, matrix = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            leaf_by_id = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
            for k, near, score in best_of(points, ids, matrix, own, settings.neighbours):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(near), own[k]), pa.int64()), pa.array(near, pa.int64()), pa.array(score), pa.array([leaf_by_id[i] for i in near.tolist()], pa.int64())],
                    names=["query_id", "vec_id", "score", "leaf"],
                )

    return _ranked(index.mapInArrow(run, "query_id long, vec_id long, score double, leaf long"), settings.neighbours)


def calibrated(index: DataFrame, queries: DataFrame, tree: Tree, settings: Settings) -> int:
    """The least number of leaf visits that finds the wanted part of the true
    neighbours of ``settings.trials`` queries."""
    trial = queries.orderBy(F.xxhash64("id", F.lit(settings.seed)), "id").limit(settings.trials)
    truth = against_all(index, trial, settings).select("query_id", "leaf").toPandas()  # trials * neighbours rows
    place = {}
    for row in trial.collect():
        place[row["id"]] = {leaf: k for k, leaf in enumerate(best_bins(_flat(np.array(row["vector"])), tree))}
    needed = np.sort([place[q][leaf] + 1 for q, leaf in zip(truth["query_id"], truth["leaf"], strict=True)])
    if not len(needed):
        return 1
    return int(needed[min(len(needed) - 1, int(np.ceil(settings.recall * len(needed))) - 1)])
