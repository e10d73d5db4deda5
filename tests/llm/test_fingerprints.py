"""Fingerprints against plain sets and a plain hash."""

import base64
import hashlib
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from annalist.llm import fingerprints as fp
from annalist.llm import queries


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_sketch(text, k=fp.K):
    def chained(words):
        seed = 42
        for w in words:
            own = signed(xxhash.xxh64_intdigest(w.encode(), seed=42))
            seed = xxhash.xxh64_intdigest(struct.pack("<q", own), seed=seed)
        return signed(seed)

    return sorted({chained(s) for s in shingles(text)})[:k]


def check(rows, texts):
    order = sorted(range(len(texts)), key=lambda i: texts[i][0])
    by_id = {r.doc_id: r for r in rows}
    assert len(by_id) == len(rows) == len(texts)
    for n, i in enumerate(order):
        own, follows = texts[i][1] or "", texts[order[(n + 1) % len(order)]][1] or ""
        half = len(own) // 2
        new = own[: len(own) - half] + follows[:half]
        r = by_id[texts[i][0]]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        sketch = plain_sketch(own)
        assert base64.b64decode(r.fingerprint) == b"".join(struct.pack(">q", h) for h in sketch)
        for value, other in ((r.near_edited, new), (r.near_next, follows)):
            a, b = shingles(own), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(value - true) <= (0.2 if len(a | b) > fp.K else 1e-9)
        assert abs(r.shingles - len(shingles(own))) <= 0.4 * len(shingles(own))


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(queries.QUERIES["op6_bottom_k_fingerprints"](spark, sf).collect(), docs)


@pytest.mark.parametrize("slice_rows", [1, 3, 1000])
def test_edge_texts_and_slices(spark, slice_rows, monkeypatch):
    texts = [(-9, "a b c d e f"), (0, None), (3, ""), (4, "one"), (1000, "\U0001f600 é " * 7), (1001, "w " * 5000), (5_000_000_000, "x y\n\tz  x y z x"), (7, " lead and trail ")]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in texts], "doc_id long, text string, sketch string, __slice int")
    plain = fp.with_next_text
    monkeypatch.setattr(fp, "with_next_text", lambda d, i, t: plain(d, i, t, slice_rows))
    check(fp.edited_fingerprints(docs).collect(), texts)


def test_one_row_none_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    (only,) = fp.edited_fingerprints(docs).collect()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"a b c d" + b"a b c ").hexdigest()
    assert fp.edited_fingerprints(docs.where("false")).collect() == []
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "q"), (2, "c")], "doc_id long, text string")
    rows = fp.edited_fingerprints(twice).collect()
    assert len(rows) == 4 and sorted(r.near_next for r in rows if r.doc_id == 1) == [0.0, 1.0]


def test_parts_merge_and_texts_round_trip(spark):
    words = [f"w{i}" for i in range(900)]
    frame = spark.createDataFrame([(" ".join(words[:600]), " ".join(words[300:]), " ".join(words[:604]))], "a string, b string, c string")
    for c in "abc":
        frame = fp.with_bottom_k(frame, c, f"{c}k")
    a, b, c = F.col("ak"), F.col("bk"), F.col("ck")
    row = frame.select(
        fp.merged(a, b).alias("both"), fp.distinct_shingles(fp.merged(a, b)).alias("n"), fp.resemblance(a, b).alias("r"), fp.containment(a, c).alias("c"),
        (fp.from_text(fp.as_text(a)) == a).alias("same"), F.size(fp.from_text(F.lit(""))).alias("none"),
    ).first()
    union = {tuple(words[i : i + 5]) for i in range(596)} | {tuple(words[i : i + 5]) for i in range(300, 896)}
    assert len(row.both) == fp.K and abs(row.n - len(union)) < 0.25 * len(union)
    assert abs(row.r - 296 / 896) < 0.13 and row.c > 0.9 and row.same and row.none == 0
