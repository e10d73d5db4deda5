"""Hashed word n-grams of Arrow text arrays, without a Python loop over words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
WORDS_KEPT = 50_000
#: What stands before and after a word: anything but letters, marks and digits.
_EDGES = re.compile(r"^([\W_]*)(.*?)([\W_]*)$", re.S)
_REPEAT = np.uint32(0x9E3779B9)
_seen: dict[tuple[str, bool, int], tuple[int, int, int]] = {}


@dataclass(frozen=True)
class Grams:
    """Which n-grams a model reads. ``marks`` adds the punctuation around words
    as grams of its own and reads a word that repeats its predecessor as a sign
    of repetition; ``lower`` folds case; ``skips`` adds pairs with up to that
    many words between them; ``stem`` adds words cut to that many letters, which
    stand for a word's inflected forms."""

    bits: int = 20
    lower: bool = True
    marks: bool = False
    skips: int = 0
    stem: int = 0


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).astype(np.uint32)


def _parts(chunk: str, lower: bool, stem: int) -> tuple[int, int, int]:
    """Hashes of a chunk's word, of the marks around it and of its stem, 0 for none."""
    found = _seen.get((chunk, lower, stem))
    if found is None:
        if len(_seen) >= WORDS_KEPT:
            _seen.clear()
        before, word, after = _EDGES.match(chunk).groups()
        word = word.lower() if lower else word
        found = (
            zlib.crc32(word.encode()) | 1 if word else 0,
            zlib.crc32(f"{before} {after}".encode()) | 1 if before or after else 0,
            zlib.crc32(word[:stem].encode()) | 1 if stem and word else 0,
        )
        _seen[(chunk, lower, stem)] = found
    return found


def features(texts: pa.Array, grams: Grams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, documents, rows) by slices of about 1 MB of text: each gram's
    code below 2**bits, the place of its document in ``rows``, and the row numbers.
    Null and blank texts have no grams."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)) // SLICE_BYTES
    for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
        split = pc.utf8_split_whitespace(texts.take(pa.array(rows)))
        found = split.flatten().dictionary_encode()
        code = found.indices.to_numpy()
        doc = np.repeat(np.arange(len(rows)), np.diff(split.offsets.to_numpy()))
        parts = np.array([_parts(c, grams.lower, grams.stem) for c in found.dictionary.to_pylist()], np.uint32).reshape(-1, 3)
        word, mark = parts[code, 0], parts[code, 1]
        marked = mark > 0
        marks, marks_doc = mark[marked], doc[marked]
        stems, stems_doc = parts[code, 2][word > 0], doc[word > 0]
        word, doc = word[word > 0], doc[word > 0]
        if grams.marks and len(word):
            again = np.r_[False, (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])]
            word = np.where(again, _REPEAT, word)
        codes, docs = [_mixed(word, word, 1)], [doc]
        if grams.marks:
            codes.append(_mixed(marks, marks, 2))
            docs.append(marks_doc)
        if grams.stem:
            codes.append(_mixed(stems, stems, 99))
            docs.append(stems_doc)
        for gap in range(grams.skips + 1):
            near = doc[gap + 1 :] == doc[: max(0, len(doc) - gap - 1)]
            codes.append(_mixed(word[: len(near)][near], word[gap + 1 :][near], 3 + gap))
            docs.append(doc[gap + 1 :][near])
        yield np.concatenate(codes) & np.uint32((1 << grams.bits) - 1), np.concatenate(docs), rows
