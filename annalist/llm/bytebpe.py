"""Byte-level BPE: pre-tokenisation by scans of transition functions, cached merging, decoding.

A slice of texts becomes one array of code points. Each is mapped to its class,
and, with the class after it, to a symbol; the one look-ahead of the pattern and
its two-letter contractions need no more. A symbol stands for a function from
the scanner's state to its next one. All functions that compositions of them can
give are few, so that each has a number and composing two is one look-up in a
table. Composition is associative, so prefixes of the whole slice are found
block by block side by side: no regular expression, no loop over characters.

The pieces between boundaries are slices of the texts' own bytes. Each distinct
one is merged once per slice, all of one length together.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
SLICE_IDS = 1 << 18
#: Longer pieces are merged one by one with a heap, shorter ones as rows of a matrix.
MATRIX_BYTES = 96
NONE = np.int32(0x7FFFFFFF)

# Classes of a code point.
OTHER, LETTER, NUMBER, WHITE, BLANK, TICK, SINGLE, R, V, LL, E, END = range(12)
# Symbols: what a code point does to the scanner.
_RUN_WHITE, _LAST_BLANK, _LAST_WHITE, _S_NUMBER, _S_OTHER, _S_TICK, _S_LETTER, _S_SINGLE, _S_DOUBLE = range(9)
# States: which token is open after a code point.
_FRESH, _IN_WHITE, _AFTER_BLANK, _IN_LETTERS, _IN_NUMBER, _IN_OTHER, _AFTER_TICK, _IN_CONTRACTION = range(8)

_SYMBOL_OF = np.array([_S_OTHER, _S_LETTER, _S_NUMBER, _RUN_WHITE, _RUN_WHITE, _S_TICK, _S_SINGLE, _S_LETTER, _S_LETTER, _S_LETTER, _S_LETTER], np.uint8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token begins at the symbol)."""
    if symbol == _RUN_WHITE:
        return _IN_WHITE, state != _IN_WHITE
    if symbol == _LAST_WHITE:
        return _FRESH, True
    if symbol == _LAST_BLANK:
        return _AFTER_BLANK, True
    joined = state == _AFTER_BLANK
    if symbol == _S_NUMBER:
        return _IN_NUMBER, not (joined or state == _IN_NUMBER)
    if symbol == _S_OTHER:
        return _IN_OTHER, not (joined or state in (_IN_OTHER, _AFTER_TICK))
    if symbol == _S_TICK:
        if joined or state in (_IN_OTHER, _AFTER_TICK):
            return _IN_OTHER, False
        return _AFTER_TICK, True
    if state == _IN_CONTRACTION:
        return _FRESH, False
    if state == _AFTER_TICK and symbol == _S_SINGLE:
        return _FRESH, False
    if state == _AFTER_TICK and symbol == _S_DOUBLE:
        return _IN_CONTRACTION, False
    return _IN_LETTERS, not (joined or state == _IN_LETTERS)


@dataclass(frozen=True)
class Scanner:
    """``numbers[symbol, first]``: the function of a symbol, ``first`` where a
    text begins; ``compose[f, g]``: first f, then g; ``apply[f, state]``;
    ``begins[state, symbol]``."""

    numbers: np.ndarray
    compose: np.ndarray
    apply: np.ndarray
    begins: np.ndarray


def built(step: Callable[[int, int], tuple[int, bool]], states: int, symbols: int, fresh: int) -> Scanner:
    """The scanner of a step function (state, symbol) -> (next state, begins):
    all functions that compositions of the symbols' give, by number."""
    own = [tuple(step(q, s)[0] for q in range(states)) for s in range(symbols)]
    first = [(f[fresh],) * states for f in own]
    known = {f: k for k, f in enumerate(dict.fromkeys([tuple(range(states)), *own, *first]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in own + first:
            both = tuple(g[q] for q in f)
            if both not in known:
                known[both] = len(known)
                todo.append(both)
    functions = list(known)
    compose = np.array([[known[tuple(g[q] for q in f)] for g in functions] for f in functions], np.uint8)
    begins = np.array([[step(q, s)[1] for s in range(symbols)] for q in range(states)], bool)
    return Scanner(np.array([[known[a], known[b]] for a, b in zip(own, first)], np.uint8), compose, np.array(functions, np.uint8), begins)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return built(_step, 8, 9, _FRESH)


def prefixes(functions: np.ndarray, compose: np.ndarray, width: int = 64) -> np.ndarray:
    """The composition of all functions up to each place. Blocks of ``width``
    places are scanned side by side, then their totals the same way."""
    n = len(functions)
    flat, m = compose.ravel(), len(compose)
    if n <= width:
        out = functions.copy()
        for k in range(1, n):
            out[k] = flat[int(out[k - 1]) * m + int(out[k])]
        return out
    rows = -(-n // width)
    block = np.zeros(rows * width, np.uint8)  # function 0 leaves the state as it is
    block[:n] = functions
    block = np.ascontiguousarray(block.reshape(rows, width).T)
    for k in range(1, width):
        block[k] = flat[block[k - 1].astype(np.intp) * m + block[k]]
    before = np.r_[np.uint8(0), prefixes(block[-1], compose, width)[:-1]]
    return np.ascontiguousarray(flat[before.astype(np.intp) * m + block].T).reshape(-1)[:n]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point. Letters, numbers and white space are the
    tokenizer library's own, so that both know the same Unicode version."""
    import tiktoken

    table = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for kind, code in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        listed = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        for low in range(0, 0x110000, 0x8000):  # by small stretches, so that little memory is touched
            stretch = np.arange(low, low + 0x8000, dtype="<u4")
            text = stretch[(stretch < 0xD800) | (stretch > 0xDFFF)].tobytes().decode("utf-32-le")
            found = bytes(listed.encode_ordinary(text)).decode()
            table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = code
    for letters, code in ((" ", BLANK), ("'", TICK), ("stmd", SINGLE), ("r", R), ("v", V), ("l", LL), ("e", E)):
        table[[ord(c) for c in letters]] = code
    return table


def doubles(own: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where, by the classes of code points and of those after them, a
    contraction of two letters may begin."""
    return (((own == R) | (own == V)) & (after == E)) | ((own == LL) & (after == LL))


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places at which a piece begins. ``first``: the places at which a text begins."""
    if not len(points):
        return np.empty(0, np.int64)
    own = classes()[points]
    starts = np.zeros(len(points), np.uint8)
    starts[first] = 1
    after = np.append(own[1:], np.uint8(END))
    after[first[first > 0] - 1] = END
    white = (own == WHITE) | (own == BLANK)
    last = white & (after != WHITE) & (after != BLANK) & (after != END)
    symbol = _SYMBOL_OF[own]
    symbol[last] = np.where(own[last] == BLANK, _LAST_BLANK, _LAST_WHITE)
    symbol[doubles(own, after)] = _S_DOUBLE
    held = scanner()
    state = held.apply[prefixes(held.numbers[symbol, starts], held.compose), _FRESH]
    before = np.append(np.uint8(_FRESH), state[:-1])
    return np.flatnonzero(held.begins[before, symbol] | (starts > 0))


@dataclass(frozen=True)
class Tokens:
    """``tokens``: bytes in the order of their ``ranks``; ``places``: a rank's
    place there; ``sizes``: a rank's number of bytes, 0 for no token."""

    tokens: pa.Array
    ranks: np.ndarray
    places: np.ndarray
    sizes: np.ndarray


@dataclass(frozen=True)
class Vocabulary:
    """``of_byte``: rank of each single byte; ``pairs``/``merged``: sorted keys
    ``left << 32 | right`` of ranks and the rank of what they make."""

    listed: Tokens
    of_byte: np.ndarray
    pairs: np.ndarray
    merged: np.ndarray


def _read(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def _listed(known: dict[bytes, int]) -> Tokens:
    ordered = sorted(known, key=known.__getitem__)
    ranks = np.array([known[t] for t in ordered], np.int32)
    places = np.zeros(int(ranks.max()) + 1, np.int32)
    places[ranks] = np.arange(len(ranks))
    sizes = np.zeros(len(places), np.int32)
    sizes[ranks] = [len(t) for t in ordered]
    return Tokens(pa.array(ordered, pa.large_binary()), ranks, places, sizes)


@lru_cache(maxsize=1)
def token_table(path: str) -> Tokens:
    """What decoding needs."""
    return _listed(_read(path))


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    known = _read(path)
    found: dict[int, int] = {}
    for token, rank in known.items():
        for cut in range(1, len(token)):
            left, right = known.get(token[:cut]), known.get(token[cut:])
            if left is not None and right is not None:
                found[left << 32 | right] = rank
    keys = np.fromiter(found, np.int64, len(found))
    order = np.argsort(keys)
    merged = np.fromiter(found.values(), np.int32, len(found))
    return Vocabulary(_listed(known), np.array([known[bytes([b])] for b in range(256)], np.int32), keys[order], merged[order])


def _merge_long(ids: np.ndarray, pair_ranks: Callable, made: np.ndarray) -> list[int]:
    """Merge one long piece: a heap of (rank, place), a list linked both ways."""
    first = pair_ranks(ids[:-1], ids[1:]).tolist()
    ids = ids.tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    now = [*first, int(NONE)]
    heap = [(r, k) for k, r in enumerate(first) if r != NONE]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        if now[k] != rank:
            continue  # one of the two has been merged since
        gone = after[k]
        ids[k], ids[gone], now[gone] = int(made[rank]), -1, -1
        after[k] = after[gone]
        if after[k] < n:
            before[after[k]] = k
        for a in (before[k], k):
            if a >= 0:
                now[a] = int(pair_ranks(np.array([ids[a]]), np.array([ids[after[a]]]))[0]) if after[a] < n else int(NONE)
                if now[a] != NONE:
                    heapq.heappush(heap, (now[a], a))
    return [i for i in ids if i >= 0]


def merge_rows(pieces: pa.Array, first_ids: Callable, pair_ranks: Callable, made: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, offsets by piece) of distinct non-empty pieces.

    ``first_ids`` gives the ids of pieces' bytes, ``pair_ranks`` the ranks of
    pairs of ids (NONE for a pair that does not merge) and ``made[rank]`` the id of
    the merged pair; ``whole`` holds the ids of pieces that are not merged at all,
    else -1. All pieces of one length are rows of a matrix: each row merges its
    leftmost pair of least rank and joins the rows that are one shorter; a row
    without a pair left is done.
    """
    n = len(pieces)
    alone = np.zeros(n, bool) if whole is None else whole >= 0
    counts = np.ones(n, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = [] if whole is None else [(np.flatnonzero(alone), whole[alone][:, None])]
    bounds = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(pieces.buffers()[2], np.uint8) if n and pieces.buffers()[2] is not None else np.empty(0, np.uint8)
    size = np.where(alone, 0, np.diff(bounds))
    for k in np.flatnonzero(size > MATRIX_BYTES):
        ids = np.array(_merge_long(first_ids(raw[bounds[k] : bounds[k + 1]]), pair_ranks, made), np.int32)
        counts[k] = len(ids)
        done.append((np.array([k]), ids[None, :]))
    size[size > MATRIX_BYTES] = 0
    who, ids = np.empty(0, np.int64), np.empty((0, 0), np.int32)
    ranks = ids
    for length in range(int(size.max(initial=0)), 0, -1):
        fresh = np.flatnonzero(size == length)
        if len(fresh):
            own = first_ids(raw[bounds[fresh][:, None] + np.arange(length)])
            theirs = pair_ranks(own[:, :-1], own[:, 1:]).astype(np.int32)
            who, ids, ranks = (np.r_[who, fresh], np.r_[ids, own], np.r_[ranks, theirs]) if len(who) else (fresh, own, theirs)
        if not len(who):
            continue
        if length == 1:
            break
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(who)), at]
        ended = best == NONE
        done.append((who[ended], ids[ended]))
        counts[who[ended]] = length
        who, ids, ranks, at, best = who[~ended], ids[~ended], ranks[~ended], at[~ended], best[~ended]
        rows = np.arange(len(who))
        ids[rows, at] = made[best]
        kept = np.ones(ids.shape, bool)
        kept[rows, at + 1] = False
        ids = ids[kept].reshape(len(who), length - 1)
        kept = np.ones(ranks.shape, bool)
        kept[rows, at] = False
        ranks = ranks[kept].reshape(len(who), length - 2)
        for left, here in ((at - 1, at > 0), (at, at < length - 2)):
            r, c = rows[here], left[here]
            ranks[r, c] = pair_ranks(ids[r, c], ids[r, c + 1])
    done.append((who, ids))
    offsets = np.r_[0, np.cumsum(counts)]
    flat = np.empty(int(offsets[-1]), np.int32)
    for which, rows in done:
        if len(which):
            flat[offsets[which][:, None] + np.arange(rows.shape[1])] = rows
    return flat, offsets


def merge_pieces(pieces: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, offsets by piece) of distinct non-empty pieces; a
    piece that is a token is that token."""
    place = np.asarray(pc.fill_null(pc.index_in(pieces, value_set=vocab.listed.tokens), -1), np.int64)
    whole = np.where(place >= 0, vocab.listed.ranks[place], -1)

    def pair_ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(vocab.pairs):
            return np.full(left.shape, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(vocab.pairs, key), len(vocab.pairs) - 1)
        return np.where(vocab.pairs[at] == key, vocab.merged[at], NONE)

    # a merged pair's id is its rank
    return merge_rows(pieces, lambda raw: vocab.of_byte[raw], pair_ranks, np.arange(len(vocab.listed.places), dtype=np.int32), whole)


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches ``flat[start : start + count]`` one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - counts), counts)] if total else flat[:0]


def encode_slice(texts: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, byte offset of each id in its text, offsets by text) of a
    ``large_string`` array that starts at its buffers' begin and has no nulls."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = texts.buffers()[2]
    raw = data.slice(0, int(bounds[-1])) if data is not None else pa.py_buffer(b"")
    points = np.frombuffer(raw.to_pybytes().decode().encode("utf-32-le"), "<u4")
    chars = np.asarray(pc.utf8_length(texts), np.int64)
    first = (np.cumsum(chars) - chars)[chars > 0]
    starts = piece_starts(points, first)
    width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width, dtype=np.int64) - width
    cuts = np.append(at[starts], bounds[-1]).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), raw]).dictionary_encode()
    flat, offsets = merge_pieces(pieces.dictionary, vocab)
    code = pieces.indices.to_numpy()
    ids = gather(flat, offsets[code], np.diff(offsets)[code])
    size = vocab.listed.sizes[ids]
    begin = np.cumsum(size, dtype=np.int64) - size
    by_text = np.searchsorted(begin, bounds)
    by_text[-1] = len(ids)
    return ids, begin - np.repeat(bounds[:-1], np.diff(by_text)), by_text


def encode(docs: DataFrame, ranks_path: str, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(identity, ``ids`` array<int>, ``starts`` array<int>): the tokens of each
    whole text and the byte at which each begins.

    A null or empty text has no tokens. Bytes that are no UTF-8 are read as
    U+FFFD. Each row is encoded by itself: repeated rows and null identities give
    a row each, in any order. Other columns are left out; an identity named like
    a result raises. Memory is bounded by an Arrow batch and a slice of about 1 MB
    (a longer text is a slice of its own).
    """
    if identity in ("ids", "starts"):
        raise ValueError("the identity must not be named ids or starts")
    schema = T.StructType([docs.schema[identity], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)) // SLICE_BYTES
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                if len(rows):
                    which = pa.array(rows)
                    ids, starts, by_text = encode_slice(texts.take(which), vocab)
                    bounds = pa.array(by_text, pa.int32())
                    lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (ids, starts)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(which), *lists], names=[identity, "ids", "starts"])

    return docs.select(F.col(identity), F.make_valid_utf8(F.col(text).cast("string"))).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", starts: str = "starts", decoded: str = "decoded") -> DataFrame:
    """``encoded`` without ``ids`` and ``starts``, with ``decoded``: the bytes of
    the ids, or of a stretch of a text's ids with the stretch of their offsets.

    The offsets tell where each token's bytes go; offsets that leave a gap or
    overlap, and unknown ids, raise. Null or empty ids give no bytes. Other columns
    pass through; one named like the result is replaced.
    """
    kept = [c for c in encoded.columns if c not in (ids, starts, decoded)]
    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField(decoded, T.BinaryType())])

    def slice_bytes(flat: np.ndarray, begin: np.ndarray, counts: np.ndarray, listed: Tokens) -> pa.Array:
        if len(flat) and (flat.min() < 0 or flat.max() >= len(listed.sizes) or not listed.sizes[flat].all()):
            raise ValueError("an id is not in the vocabulary")
        size = listed.sizes[flat]
        ends = np.cumsum(counts)
        last = np.zeros(len(flat), bool)
        last[ends[counts > 0] - 1] = True
        if len(begin) != len(flat) or np.any((begin[1:] != (begin + size)[:-1]) & ~last[:-1]):
            raise ValueError("offsets do not follow the tokens")
        data = listed.tokens.take(pa.array(listed.places[flat]))
        bounds = np.r_[0, np.cumsum(size, dtype=np.int64)][np.r_[0, ends]]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), data.buffers()[2] or pa.py_buffer(b"")]).cast(pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = token_table(ranks_path)
        for batch in batches:
            counts = np.asarray(pc.fill_null(pc.list_value_length(batch.column(len(kept))), 0), np.int64)
            ends = np.cumsum(counts) // SLICE_IDS
            for rows in np.split(np.arange(len(counts)), np.flatnonzero(np.diff(ends)) + 1):
                if len(rows):
                    part = batch.slice(rows[0], len(rows))
                    flat, begin = (part.column(len(kept) + k).flatten().to_numpy() for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], slice_bytes(flat, begin, counts[rows], listed)], names=[*kept, decoded])

    return encoded.select(*kept, ids, starts).mapInArrow(run, schema)
