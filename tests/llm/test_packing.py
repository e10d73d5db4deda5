"""Pieces against the tokenizer itself, packings against bounds and brute force."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from annalist.llm import packing, queries
from annalist.llm.tokens import encode_texts

TEXTS = [
    "", " \n ", "It's a TEST, isn't it?  12 345\u00a0x\u2003y", "caf\u00e9 CAFE\u0301 na\u00efve \u00dfe \u00c4\u00d6", "\u03a3\u03a3 \u0130x", "a\x1cb\x85c\u200bd",
    "<|endoftext|> in <|start", "\u65e5\u672c\u8a9e \ud55c\uad6d\uc5b4 \U0001f600\U0001f600!!", "... ... '' 's't 'RE don't", "e\u0301 \u0301a", "word " * 50,
    "don't we'll I've they're 's's 'S ''s !'s 'll'll'l 'r 'v x'", "a1b22c333 ١½Ⅸ", "x" * 3000, "\U00016ea0꟎ Ᲊ", "a b᠎c d　e﻿f g",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_one_by_one_give_the_tokenizers_ids(tokenizer, spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {}
    for ids, offsets, rows in encode_texts(pa.array(texts), queries.tokenizer_path()):
        for k, row in enumerate(rows):
            got[int(row)] = ids[offsets[k] : offsets[k + 1]].tolist()
    for row, text in enumerate(texts):
        assert got[row] == plain_ids(tokenizer, text), repr(text[:60])


def test_any_letters_in_any_order(tokenizer):
    rng = random.Random(5)
    letters = "aabbesttmdrvvlle@@@@@ @  \n\t \u0085 123½éÉΣİ漢\U0001f642!?.-_".replace("@", "'")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(3000)]
    for ids, offsets, rows in encode_texts(pa.array(texts), queries.tokenizer_path()):
        for k, row in enumerate(rows):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == plain_ids(tokenizer, texts[row]), repr(texts[row])


def test_pieces_cover_documents_and_sequences_have_no_gaps(tokenizer, spark):
    rows = [(1, None, 0), (2, "", 0), (3, "one two " * 40, 0), (3, "one two " * 40, 0), (None, "x", 0), (5, "a b c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    pieces = packing.token_pieces(docs, queries.tokenizer_path(), window=16, with_ids=True)
    packed = packing.pack(pieces, capacity=16, block_rows=3).collect()
    for doc, text, _ in set(rows):
        ids = plain_ids(tokenizer, text) + [0]
        want = [(n, at, len(ids[at : at + 16]), zlib.crc32(np.array(ids[at : at + 16], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 16))]
        times = sum(r[:2] == (doc, text) for r in rows)
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in packed if r.doc_id == doc)
        assert own == sorted(want * times)
        assert all(r.ids == ids[r.start : r.start + r.length] for r in packed if r.doc_id == doc)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 16


def test_empty_table_and_bad_lengths(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.token_pieces(none, queries.tokenizer_path())).collect() == []
    for bad in (None, 0, 17):
        with pytest.raises(Exception, match="length must be"):
            packing.pack(spark.createDataFrame([(1, bad)], "doc_id long, length long"), capacity=16).collect()


def fewest(lengths, capacity):
    for count in range(1, len(lengths) + 1):
        for bins in itertools.product(range(count), repeat=len(lengths)):
            if max(np.bincount(bins, weights=lengths, minlength=count)) <= capacity:
                return count


def test_small_packings_are_optimal():
    rng = random.Random(3)
    for seed in range(25):
        lengths = np.array([rng.randint(1, 10) for _ in range(6)])
        best = packing.evolve(lengths, [], 10, 4, 10, seed)[0]
        assert np.bincount(best, weights=lengths).max() <= 10
        assert packing.fitness(best, lengths, 10)[0] == fewest(lengths.tolist(), 10)


def test_crossover_keeps_every_piece_and_the_capacity():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 300)
    a, b = (packing.first_packing(lengths, 64, rng, 0.3) for _ in range(2))
    for _ in range(20):
        child = packing.crossover(a, b, lengths, 64, rng)
        assert len(child) == 300 and np.bincount(child, weights=lengths).max() <= 64
        a, b = b, child


def test_query_is_near_the_bound(spark, sf):
    rows = queries.QUERIES["op1_packed_sequences"](spark, sf).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) * 1.02 + 1
