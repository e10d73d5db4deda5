"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from annalist.llm import periodic, queries


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_texts(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                words += rng.choices("ab", k=rng.randint(0, 12))
            elif kind < 0.6:
                words += rng.choices("abcdefgh", k=rng.randint(0, 30))
            else:
                part = rng.choices("abc", k=rng.randint(1, 60))
                words += (part * 8)[: int(len(part) * rng.uniform(3, 7))]
        yield "\n ".join(words)


def test_all_runs_of_made_texts():
    texts = [*made_texts(1500, 2), "", "   ", "a " * 700, ("x y z " * 3 + "q ") * 60, " ".join(random.Random(4).choices("ab", k=900))]
    _, runs, collapsed = periodic._slice_runs(pa.array(texts, pa.large_string()))
    total = 0
    for text, found, rest in zip(texts, runs.to_pylist(), collapsed.to_pylist()):
        want = plain_runs(text.split())
        assert [(r["start"], r["length"], r["period"]) for r in found] == want, text
        assert rest == plain_collapsed(text.split(), want)
        total += len(want)
    assert total > 2000


@pytest.mark.parametrize("period", [8, 9, 16, 17, 100, 128, 129, 1000, 1025])
def test_every_scale_finds_a_run_of_exactly_four_periods(period):
    rng = random.Random(period)
    part = [f"w{rng.randint(0, 5)}" for _ in range(period)]
    part[0] = "only"  # so that no smaller period fits
    words = [f"a{k}" for k in range(37)] + part * 4 + [f"b{k}" for k in range(11)]
    _, runs, _ = periodic._slice_runs(pa.array([" ".join(words)], pa.large_string()))
    assert {"start": 37, "length": 4 * period, "period": period} in runs.to_pylist()[0]


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b " * 4, "z"), (4, "c " * 6, "n"), (4, "c " * 6, "n"), (5, "d " * 5, "n"), (6, "u v w " * 50_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect())
    one = (4, 6, [(0, 6, 1)], "c")
    assert got == [(0, 8, [(0, 8, 2)], "a b"), (1, 0, [], ""), (2, 0, [], ""), one, one, (5, 5, [], "d d d d d"), (6, 150_000, [(0, 150_000, 3)], "u v w")]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="identity"):
        periodic.periodic_runs(docs, identity="runs")


def test_other_white_space_and_marks_belong_to_words(spark):
    docs = spark.createDataFrame([(1, "a b c\x1c d\x0be")], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert (row["n_words"], row["collapsed"]) == (3, "a b c\x1c d e")


def test_query_on_all_documents(spark, sf):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for row in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        words = re.findall("[^\x20\x09-\x0d]+", row["text"] or "")
        h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((row["doc_id"], len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(plain_collapsed(words, runs))))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = queries.QUERIES["op12_periodic_runs"](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(1 for r in want if r[4] is not None and r[4] > 8) > 3
