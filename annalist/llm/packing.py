"""Packing documents into sequences of a fixed number of tokens.

A grouping genetic algorithm on islands. Documents are cut into pieces no longer
than a sequence. Pieces that fill a sequence alone are done. The others are
dealt by hash into blocks of a bounded size, and each block is packed by
several islands, one Spark task row each. An island holds a population of
packings; an epoch is a number of crossovers:

- whole, well-filled bins of one parent are injected into the other,
- bins of the other that share a piece with them are dissolved, the duplicates
  go, and the pieces that lost their bin are best-fitted, longest first, into
  the room that is left,
- the child replaces the worst packing if it is better.

Between epochs each island's best packings go to the next island of the block's
ring, through a written table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm.tokens import encode_texts
from annalist.session import cut_lineage


def token_pieces(docs: DataFrame, tokenizer_path: str, identity: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The documents' pieces: identity, ``piece`` (from 0), ``start``,
    ``length``, ``ids_crc32`` of the ids as little-endian unsigned 32-bit
    numbers, and with ``with_ids`` the ids themselves.

    A document is the ids of its text (null: empty) and then ``end_id``; longer
    ones are cut every ``window`` ids, the last piece may be shorter. Every
    document has a piece. Repeated rows are documents of their own.
    """
    kind = docs.schema[identity].dataType
    fields = [T.StructField(identity, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end_id], dtype="<u4")
        for batch in batches:
            for ids, offsets, rows in encode_texts(batch.column(1), tokenizer_path):
                which, piece, start, length, crc, kept = [], [], [], [], [], []
                for k in range(len(rows)):
                    own = np.concatenate([ids[offsets[k] : offsets[k + 1]], tail])
                    raw = own.tobytes()
                    for n, at in enumerate(range(0, len(own), window)):
                        which.append(rows[k])
                        piece.append(n)
                        start.append(at)
                        length.append(min(window, len(own) - at))
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + window)]))
                        if with_ids:
                            kept.append(own[at : at + window].astype(np.int32))
                columns = [
                    batch.column(0).take(pa.array(which, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names=names)

    return docs.select(F.col(identity), F.col(text).cast("string")).mapInArrow(cut, T.StructType(fields))


def best_fit(lengths: list[int], room: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the given order: the fullest bin that still has
    room, else a new one. ``room`` holds the room of the bins there are and is
    extended. The set of rooms that occur is one integer's bits, so that the
    smallest sufficient one is found by a shift."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k, left in enumerate(room):
        if left:
            by_room[left].append(k)
            mask |= 1 << left
    placed = []
    for n in lengths:
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            stack = by_room[left]
            k = stack.pop()
            if not stack:
                mask ^= 1 << left
        else:
            k, left = len(room), capacity
            room.append(capacity)
        placed.append(k)
        left -= n
        room[k] = left
        if left:
            by_room[left].append(k)
            mask |= 1 << left
    return placed


def _renumbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """To be made small: the number of bins, then how evenly they are filled."""
    fill = np.bincount(bins, weights=lengths)
    return int(np.count_nonzero(fill)), -float(np.square(fill / capacity).sum())


def first_packing(lengths: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> np.ndarray:
    """Best fit, longest first, with the order blurred by ``noise``."""
    order = np.argsort(-lengths * (1 + noise * rng.standard_normal(len(lengths))), kind="stable")
    bins = np.empty(len(lengths), np.int32)
    bins[order] = best_fit(lengths[order].tolist(), [], capacity)
    return bins


def crossover(giver: np.ndarray, taker: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of two packings. Its injected bins are a random part of the
    giver's fuller half."""
    fill = np.bincount(giver, weights=lengths)
    injected = (fill >= np.median(fill)) & (rng.random(len(fill)) < rng.uniform(0.1, 0.6))
    inside = injected[giver]
    broken = np.zeros(int(taker.max()) + 1, bool)
    broken[taker[inside]] = True
    displaced = np.flatnonzero(broken[taker] & ~inside)
    child = np.where(inside, giver + len(broken), taker)
    settled = np.ones(len(lengths), bool)
    settled[displaced] = False
    child[settled] = _renumbered(child[settled])
    room = (capacity - np.bincount(child[settled], weights=lengths[settled])).astype(int).tolist() if settled.any() else []
    displaced = displaced[np.argsort(-lengths[displaced], kind="stable")]
    child[displaced] = best_fit(lengths[displaced].tolist(), room, capacity)
    return child.astype(np.int32)


def evolve(lengths: np.ndarray, guests: list[np.ndarray], capacity: int, population: int, crossovers: int, seed: int) -> list[np.ndarray]:
    """An epoch on one island: the population, best first. Guests come first,
    the rest of the population is made anew from the seed."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    held = [(fitness(g, lengths, capacity), g) for g in guests]
    while len(held) < population:
        made = first_packing(lengths, capacity, rng, 0.0 if seed % 2 == 0 and not held else 0.02 * len(held))
        held.append((fitness(made, lengths, capacity), made))
    held.sort(key=lambda x: x[0])
    for _ in range(crossovers):
        if held[0][0][0] <= least:
            break  # no packing has fewer bins
        a, b = rng.choice(len(held), 2, replace=False)
        a, b = min(a, b), max(a, b)
        child = crossover(held[a][1], held[b][1], lengths, capacity, rng)
        score = fitness(child, lengths, capacity)
        if score < held[-1][0] and all(score != h[0] for h in held):
            held[-1] = (score, child)
            held.sort(key=lambda x: x[0])
    return [h[1] for h in held]


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    length: str = "length",
    block_rows: int = 4096,
    islands: int = 3,
    epochs: int = 2,
    population: int = 4,
    crossovers: int = 10,
    elites: int = 2,
    seed: int = 11,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most
    ``capacity`` tokens, offsets gapless from 0.

    Lengths must be 1 to ``capacity``: a null length or another one raises.
    Repeated rows are pieces of their own. Extra columns pass through, except
    columns named like the two results, which are replaced. Empty input gives
    an empty result. A block holds about ``block_rows`` pieces, dealt by a hash
    of a row number of the written input, so no key makes a block large.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    fits = F.coalesce(F.col(length).between(1, capacity), F.lit(False))
    checked = F.when(fits, F.col(length)).otherwise(F.raise_error(F.lit(f"{length} must be 1 to {capacity}")).cast("long"))
    rows = cut_lineage(pieces.select(*own, checked.cast("int").alias("__length"), F.monotonically_increasing_id().alias("__uid")))
    small = rows.where(F.col("__length") < capacity)
    whole = rows.where(F.col("__length") == capacity)
    count = max(1, -(-small.count() // block_rows))
    # one row per block: bounded lists, ordered, so that a recomputed task sees the same block
    by_uid = lambda a, b: F.when(a["__uid"] < b["__uid"], -1).otherwise(1)
    blocks = cut_lineage(
        small.groupBy(F.pmod(F.xxhash64("__uid", F.lit(seed)), F.lit(count)).alias("__block")).agg(
            F.array_sort(F.collect_list(F.struct("__uid", "__length", *own)), by_uid).alias("__pieces")
        )
    )
    state = blocks.select("__block", F.col("__pieces.__length").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast("array<binary>").alias("guests"))
    schema = "__block long, island int, bins array<binary>, count int, even double"
    for epoch in range(epochs):

        def run(frames: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for block, island, lengths, guests in zip(frame["__block"], frame["island"], frame["lengths"], frame["guests"], strict=True):
                    sizes = np.asarray(lengths, np.int64)
                    came = [np.frombuffer(g, np.int32) for g in guests] if guests is not None else []
                    held = evolve(sizes, came, capacity, population, crossovers, ((seed * 1009 + int(block)) * 64 + int(island)) * 16 + epoch * 8 + int(island))
                    used, even = fitness(held[0], sizes, capacity)
                    yield pd.DataFrame({"__block": [block], "island": [island], "bins": [[h.tobytes() for h in held]], "count": [used], "even": [even]})

        spread = state.repartition(max(1, count * islands // 4), "__block", "island")
        evolved = cut_lineage(spread.mapInPandas(run, schema))
        # each island keeps its own population and gets the elite of the island before it
        own_best = evolved.select("__block", "island", "bins")
        elite = evolved.select("__block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.slice("bins", 1, elites).alias("elite"))
        state = (
            own_best.join(elite, ["__block", "island"])
            .join(blocks.select("__block", F.col("__pieces.__length").alias("lengths")), "__block")
            .select("__block", "lengths", "island", F.concat("elite", F.slice("bins", 1, max(1, population - elites))).alias("guests"))
        )
    best = evolved.groupBy("__block").agg(F.min_by(F.get("bins", F.lit(0)), F.struct("count", "even", "island")).alias("bins"))
    placed_type = "array<struct<bin:int,offset:int>>"

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, raw, lengths in zip(frame["__block"], frame["bins"], frame["lengths"], strict=True):
                bins, sizes = _renumbered(np.frombuffer(raw, np.int32)), np.asarray(lengths, np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.r_[True, bins[order][1:] != bins[order][:-1]]
                base = np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
                offset = np.empty(len(sizes), np.int64)
                offset[order] = ends - sizes[order] - base
                yield pd.DataFrame({"__block": [block], "places": [[{"bin": int(b), "offset": int(o)} for b, o in zip(bins, offset, strict=True)]]})

    places = best.join(blocks.select("__block", F.col("__pieces.__length").alias("lengths")), "__block").select("__block", "bins", "lengths").mapInPandas(place, f"__block long, places {placed_type}")
    packed = (
        blocks.join(places, "__block")
        .select("__block", F.explode(F.arrays_zip(F.col("__pieces").alias("p"), F.col("places").alias("q"))).alias("x"))
        .select(*[F.col(f"x.p.{c}").alias(c) for c in own], (F.col("__block") * F.lit(1 << 20) + F.col("x.q.bin")).alias("sequence_id"), F.col("x.q.offset").cast("long").alias("offset"))
    )
    alone = whole.select(*own, (-1 - F.col("__uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
