"""Byte-level BPE against the tokenizer library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from annalist.llm import bytebpe, queries

LETTERS = "aabbesttmdrvvlle'''' '  \n\t  123½é漢字🙂!?.-_Ᲊ\U00010d40　​"


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens_of(texts, path):
    ids, starts, by_text = bytebpe.encode_slice(pa.array(texts, pa.large_string()), bytebpe.vocabulary(path))
    return [(ids[a:b].tolist(), starts[a:b].tolist()) for a, b in zip(by_text, by_text[1:])]


def test_same_ids_as_the_library_on_mixed_letters(path, library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 3000, "'" * 777, "abcdefgh" * 300, "漢" * 500, "<|endoftext|>I'll we've 's 'Ll ''s !'s \r\n\r\n x ", "", "\x00"]
    for text, (ids, starts) in zip(texts, tokens_of(texts, path)):
        assert ids == library.encode_ordinary(text), text
        sizes = [len(library.decode_single_token_bytes(i)) for i in ids]
        assert starts == [sum(sizes[:k]) for k in range(len(ids))] or len(ids) > 100


def test_boundaries_by_blocks_are_those_of_a_plain_walk():
    rng = np.random.default_rng(3)
    held = bytebpe.scanner()
    functions = rng.integers(0, len(held.compose), 10_000).astype(np.uint8)
    walked, state = [], 0
    for f in functions:
        state = int(held.compose[state, f])
        walked.append(state)
    assert bytebpe.prefixes(functions, held.compose, width=7).tolist() == walked


def test_edge_rows(spark, path):
    rows = [(1, None, "x"), (2, "", "y"), (None, "It's\n\n  so", "z"), (4, "dup dup", "a"), (4, "dup dup", "a"), (5, "word " * 40_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    back = bytebpe.decode(bytebpe.encode(docs, path), path).collect()
    assert sorted((r["doc_id"] or -1, bytes(r["decoded"]).decode()) for r in back) == sorted((a or -1, b or "") for a, b, _ in rows)
    assert bytebpe.encode(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError, match="identity"):
        bytebpe.encode(docs.withColumnRenamed("doc_id", "ids"), path, identity="ids")


def test_invalid_bytes_are_replaced(spark, path, library):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert bytebpe.encode(docs, path).first()["ids"] == library.encode_ordinary("a�b")


def test_a_stretch_of_tokens_decodes_and_false_offsets_raise(spark, path):
    docs = spark.createDataFrame([(1, "Some words, 123 and 漢字 here")], "doc_id long, text string")
    part = bytebpe.encode(docs, path).select("doc_id", F.slice("ids", 2, 5).alias("ids"), F.slice("starts", 2, 5).alias("starts"))
    row = part.first()
    text = "Some words, 123 and 漢字 here".encode()
    got = bytes(bytebpe.decode(part, path).first()["decoded"])
    assert got == text[row["starts"][0] : row["starts"][0] + len(got)] and len(got) > 0
    false = part.withColumn("starts", F.transform("starts", lambda s: s * 2))
    with pytest.raises(Exception, match="offsets"):
        bytebpe.decode(false, path).collect()


def test_query_on_all_documents(spark, sf, library):
    want = {}
    for row in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        ids = library.encode_ordinary(row["text"] or "")
        want[row["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest())
    got = queries.QUERIES["op11_byte_bpe_round_trip"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
