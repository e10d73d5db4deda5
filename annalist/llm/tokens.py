"""Word-wise tokenization in Arrow batches.

The vocabulary drops white space, splits lower-case text into words and merges
inside words only. So a slice of texts becomes one array of code points, word
boundaries are found by a scan over their classes, and each distinct word of the
slice is merged once, all words of a length together. Nothing is kept between
slices but the vocabulary's own tables.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from annalist.llm import bytebpe
from annalist.llm.bytebpe import END, NONE, gather, merge_rows

SLICE_BYTES = 1 << 20
#: Letters newer than one of the libraries, and the one whose lower case is two:
#: texts with one of these are lowered by the vocabulary's own library.
NEW_LETTERS = r"[\x{130}\x{1c89}\x{a7cb}-\x{a7dc}\x{10d50}-\x{10d65}\x{16ea0}-\x{16eb8}]"
#: What may be a special token: such texts are encoded as a whole.
SPECIAL = r"<\|"

# Symbols of the word scan, and its states: which word is open after a code point.
_WHITE, _NUMBER, _OTHER, _TICK, _LETTER, _SINGLE, _DOUBLE = range(7)
_FRESH, _IN_LETTERS, _IN_OTHER, _AFTER_TICK, _IN_CONTRACTION = range(5)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a word or white space begins at the symbol). Each
    number is a word; an apostrophe that begins a word takes one of a few endings."""
    if symbol in (_WHITE, _NUMBER):
        return _FRESH, True
    if symbol == _OTHER:
        return _IN_OTHER, state not in (_IN_OTHER, _AFTER_TICK)
    if symbol == _TICK:
        return (_IN_OTHER, False) if state in (_IN_OTHER, _AFTER_TICK) else (_AFTER_TICK, True)
    if state == _IN_CONTRACTION or (state == _AFTER_TICK and symbol == _SINGLE):
        return _FRESH, False
    if state == _AFTER_TICK and symbol == _DOUBLE:
        return _IN_CONTRACTION, False
    return _IN_LETTERS, state != _IN_LETTERS


@lru_cache(maxsize=1)
def _scanner() -> bytebpe.Scanner:
    return bytebpe.built(_step, 5, 7, _FRESH)


def _symbols() -> np.ndarray:
    table = np.full(16, _LETTER, np.uint8)
    for code, symbol in ((bytebpe.OTHER, _OTHER), (bytebpe.NUMBER, _NUMBER), (bytebpe.WHITE, _WHITE), (bytebpe.BLANK, _WHITE), (bytebpe.TICK, _TICK), (bytebpe.SINGLE, _SINGLE)):
        table[code] = symbol
    return table


def _word_starts(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places at which a word or a white space begins, whether it is white)."""
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, bool)
    own = bytebpe.classes()[points]
    starts = np.zeros(len(points), np.uint8)
    starts[first] = 1
    after = np.append(own[1:], np.uint8(END))
    after[first[first > 0] - 1] = END
    symbol = _symbols()[own]
    symbol[bytebpe.doubles(own, after)] = _DOUBLE
    held = _scanner()
    state = held.apply[bytebpe.prefixes(held.numbers[symbol, starts], held.compose), _FRESH]
    before = np.append(np.uint8(_FRESH), state[:-1])
    begins = np.flatnonzero(held.begins[before, symbol] | (starts > 0))
    return begins, symbol[begins] == _WHITE


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable
    Latin-1 stands for itself, the others come after the 256th letter."""
    plain = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordTokenizer:
    """The vocabulary's tables: ids of single bytes inside and at the end of a
    word, and the pairs that merge, by rank."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inside = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.ending = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in model["merges"]], np.int64)
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], np.int32)
        order = np.argsort(keys, kind="stable")
        self.pairs, self.ranks = keys[order], order.astype(np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def first_ids(self, raw: np.ndarray) -> np.ndarray:
        """Ids of words' bytes; the last axis is a word."""
        ids = self.inside[raw]
        ids[..., -1] = self.ending[raw[..., -1]]
        return ids

    def lowered(self, texts: pa.Array) -> pa.Array:
        """The texts as the vocabulary normalizes them, white space aside."""
        plain = np.asarray(pc.string_is_ascii(texts).to_numpy(zero_copy_only=False), bool)
        if plain.all():
            return pc.utf8_lower(texts)
        shown = texts.to_pylist()
        new = np.asarray(pc.match_substring_regex(texts, NEW_LETTERS).to_numpy(zero_copy_only=False), bool)
        composed = [s if p or unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s) for s, p in zip(shown, plain)]
        low = pc.utf8_lower(pa.array(composed, pa.large_string()))
        if new.any():
            low = pa.array([self.library.normalizer.normalize_str(s) if n else x for s, n, x in zip(shown, new, low.to_pylist())], pa.large_string())
        return low

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, offsets by text) of a ``large_string`` array
        that starts at its buffers' begin and has no nulls."""
        special = np.asarray(pc.match_substring_regex(texts, SPECIAL).to_numpy(zero_copy_only=False), bool)
        low = self.lowered(texts)
        bounds = np.frombuffer(low.buffers()[1], np.int64)[: len(low) + 1]
        raw = low.buffers()[2].slice(0, int(bounds[-1])) if low.buffers()[2] is not None else pa.py_buffer(b"")
        points = np.frombuffer(raw.to_pybytes().decode().encode("utf-32-le"), "<u4")
        chars = np.asarray(pc.utf8_length(low), np.int64)
        starts, white = _word_starts(points, (np.cumsum(chars) - chars)[chars > 0])
        width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        at = (np.cumsum(width, dtype=np.int64) - width)[starts]
        cuts = np.append(at, bounds[-1])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), raw]).filter(pa.array(~white)).dictionary_encode()
        flat, offsets = merge_rows(words.dictionary, self.first_ids, self.pair_ranks, self.made)
        code = words.indices.to_numpy()
        ids = gather(flat, offsets[code], np.diff(offsets)[code])
        sizes = np.r_[0, np.cumsum(np.diff(offsets)[code])]
        by_text = sizes[np.searchsorted(at[~white], bounds)]
        if special.any():
            own = [ids[by_text[k] : by_text[k + 1]] for k in range(len(texts))]
            for k in np.flatnonzero(special):
                own[k] = np.array(self.library.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.int32)
            ids, by_text = np.concatenate(own), np.r_[0, np.cumsum([len(x) for x in own])]
        return ids.astype("<u4"), by_text


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode_texts(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, offsets, row numbers) by slices of about 1 MB of text; null is empty."""
    held = word_tokenizer(path)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)) // SLICE_BYTES
    for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
        if len(rows):
            ids, offsets = held.encode_slice(texts.take(pa.array(rows)))
            yield ids, offsets, rows
