"""Runs of words that repeat with a period, found by minimizers on several scales.

A run is a stretch of consecutive words in which words ``q`` apart are identical,
at least four periods and six words long, that neither neighbour extends; ``q``
is its smallest period.

Periods up to 8 are found by comparing the words with themselves at each lag. A
scale covers the periods above ``2**(s-1)`` up to ``2**s``, with blocks of
``2**s`` words and windows of ``2**(s-1)`` blocks; the minimizers are the blocks
that are least in some window. Why no run is missed: of a run with period q in
that range, the first window and the one q places on lie inside (``q + window +
block <= 4 * q``) and hold the same blocks, so a minimizer and the same block q
places on are both selected; a block is at least a period long, so the run has
no equal one between the two. Neighbouring equal minimizers are thus seeds for
every run; a seed's lag is extended to both sides by doubled blocks.

All documents of a slice are scanned together, the longest first, so that each
scale reads only the documents that are long enough for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20
DIRECT_SCALE = 3
LEAST_PERIODS, LEAST_WORDS = 4, 6
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs; order matters."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xC2B2AE3D27D4EB4F) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _slid(values: np.ndarray, window: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``window`` values, a power of two: as many results as windows."""
    reach = 1
    while reach < window:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    return values


def _minimizers(blocks: np.ndarray, window: int) -> np.ndarray:
    """Places of the blocks that are least in at least one window."""
    if len(blocks) < window:
        return np.empty(0, np.int64)
    least = _slid(blocks, window, np.minimum)
    edge = np.zeros(window - 1, blocks.dtype)
    return np.flatnonzero(_slid(np.concatenate([edge, least, edge]), window, np.maximum) == blocks)


def _direct(words: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the longest stretches with period ``lag``."""
    same = np.concatenate([[False], words[lag:] == words[:-lag], [False]])
    turn = np.flatnonzero(same[1:] != same[:-1])
    return turn[0::2], turn[1::2] - turn[0::2] + lag


def _seeds(blocks: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of neighbouring equal minimizers whose lag the scale covers,
    the first of each chain of equal lags: a run of many periods has few seeds."""
    at = _minimizers(blocks, 1 << (scale - 1))
    order = np.lexsort((at, blocks[at]))
    at, name = at[order], blocks[at][order]
    lag = np.append(at[1:] - at[:-1], 0)
    same = np.append(name[1:] == name[:-1], False)
    covered = same & (lag > 1 << (scale - 1)) & (lag <= 1 << scale)
    goes_on = np.append(False, covered[:-1] & (lag[1:] == lag[:-1]))
    taken = covered & ~goes_on
    return at[taken], lag[taken]


def _extended(levels: list[np.ndarray], at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, past the last) place of the stretch around ``at`` where words
    equal those ``lag`` on: steps of each doubled size, the greatest first."""
    left, right = at.copy(), at.copy()
    for scale in range(len(levels) - 1, -1, -1):
        step, blocks = 1 << scale, levels[scale]
        moving = np.arange(len(at))
        while len(moving):
            moving = moving[right[moving] + lag[moving] < len(blocks)]
            moving = moving[blocks[right[moving]] == blocks[right[moving] + lag[moving]]]
            right[moving] += step
        moving = np.arange(len(at))
        while len(moving):
            moving = moving[(left[moving] >= step) & (left[moving] + lag[moving] - step < len(blocks))]
            moving = moving[blocks[left[moving] - step] == blocks[left[moving] + lag[moving] - step]]
            left[moving] -= step
    return left, right


def find_runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of several documents, by start then
    period. ``words`` holds the documents' word numbers one after another, each
    document followed by a number used nowhere else, ``counts`` the numbers of
    words, which must not increase."""
    starts, lengths, periods = [], [], []

    def keep(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> None:
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        starts.append(start[long])
        lengths.append(length[long])
        periods.append(period[long])

    ends = np.cumsum(counts + 1)

    def reach(least: int) -> int:
        """The end of the documents with at least so many words."""
        enough = int(np.searchsorted(-counts, -least, side="right"))
        return int(ends[enough - 1]) if enough else 0

    for lag in range(1, (1 << DIRECT_SCALE) + 1):
        part = words[: reach(max(LEAST_WORDS, LEAST_PERIODS * lag))]
        if len(part) > lag:
            start, length = _direct(part, lag)
            keep(start, length, np.full(len(start), lag))
    levels = [_mixed(words.astype(np.uint64), np.uint64(0))]
    found, scale = [(np.empty(0, np.int64), np.empty(0, np.int64))], 1
    while size := reach(LEAST_PERIODS * ((1 << (scale - 1)) + 1)):
        half = 1 << (scale - 1)
        below = levels[-1][:size]
        levels.append(_mixed(below[:-half], below[half:]))
        if scale > DIRECT_SCALE:
            found.append(_seeds(levels[scale], scale))
        scale += 1
    place, lag = (np.concatenate(x) for x in zip(*found))
    left, right = _extended(levels, place, lag)
    keep(left, right - left + lag, lag)
    start, length, period = np.concatenate(starts), np.concatenate(lengths), np.concatenate(periods)
    # a run is also found with multiples of its period: the smallest one is its own
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    own = np.ones(len(start), bool)
    own[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[own], length[own], period[own]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _slice_runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(numbers of words, runs, collapsed text) of a slice of texts, in its order."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split), np.int64))
    solid = np.asarray(pc.binary_length(flat), np.int64) > 0
    flat, owner = flat.filter(pa.array(solid)), owner[solid]
    counts = np.bincount(owner, minlength=len(texts))
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy()
    base = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    placed = np.empty(len(texts), np.int64)  # where each text's words begin in the scanned array
    placed[order] = np.cumsum(counts[order] + 1) - (counts[order] + 1)
    words = np.arange(len(code) + len(texts), dtype=np.int64) + len(coded.dictionary)  # a number of its own behind each text
    inside = np.repeat(placed - base, counts) + np.arange(len(code))
    words[inside] = code
    start, length, period = find_runs(words, counts[order])
    of = order[np.searchsorted(placed[order], start, side="right") - 1]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = (np.cumsum(change) == 0)[inside]
    lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(owner[kept], minlength=len(texts)))], pa.int64()), flat.filter(pa.array(kept)))
    back = np.lexsort((period, start, of))
    columns = [pa.array(x[back], pa.int64()) for x in (start - placed[of], length, period)]
    runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(texts)))], pa.int32()), pa.StructArray.from_arrays(columns, names=["start", "length", "period"]))
    return counts, runs, pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def periodic_runs(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(identity, ``n_words``, ``runs`` array<struct<start, length, period>> by
    start and period, ``collapsed``: the words, joined by one space, that no run
    holds after its first period).

    Words are what ASCII white space separates. Null and blank texts have no
    words, no runs and an empty collapsed text. Rows are independent: repeated
    rows and null identities give a row each. Other columns are left out; an
    identity named like a result raises. Memory is bounded by an Arrow batch and
    the scales of a slice of about 2 MB (a longer text is a slice of its own).
    Blocks are compared by 64-bit hashes.
    """
    names = [identity, "n_words", "runs", "collapsed"]
    if identity in names[1:]:
        raise ValueError(f"the identity must not be named {identity}")
    schema = T.StructType([docs.schema[identity], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)) // SLICE_BYTES
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                if len(rows):
                    which = pa.array(rows)
                    counts, runs, collapsed = _slice_runs(texts.take(which))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(counts, pa.int64()), runs, collapsed.cast(pa.string())], names=names)

    return docs.select(F.col(identity), F.col(text).cast("string")).mapInArrow(run, schema)
