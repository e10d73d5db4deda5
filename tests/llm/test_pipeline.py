"""Each stage on what its predecessor kept, against what the operator promises."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from annalist.llm import mixing, neardup
from annalist.session import cut_lineage


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(cut_lineage(stage(spark, kept[-1], sf)))
    assert all(k.columns == docs.columns for k in kept[:-1])
    start, good, single, hidden, mixed, packed = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in clean) >= 0.98 * len(clean) and len(left) < start.count()
    classes = neardup.near_duplicates(good).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.class_id for r in classes})
    before, after = ({r.doc_id: r for r in f.collect()} for f in (single, hidden))
    assert before.keys() == after.keys() and any(before[i].text != after[i].text for i in before)
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
    copies = {r.doc_id: r.copies for r in mixing.mix(hidden).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    rows = packed.collect()
    assert {r.doc_id for r in rows} == {i for i, n in copies.items() if n}
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) * 1.05 + 1
    run = corpus_pipeline.run(spark, sf).collect()
    told = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert told(run) == told(rows)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


def test_empty_documents(spark, sf, docs_schema):
    docs = spark.createDataFrame([], docs_schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


EDGES = [
    (1, "one two three four five six seven", "en", "a", 33), (1, "one two three four five six seven", "en", "a", 33), (2, "one two three four five six seven", None, None, None),
    (3, None, "en", "a", None), (4, None, None, None, None), (5, "", "en", "b", 0), (6, "", "en", "b", 0), (None, "a text without a number and a card 4111 1111 1111 1111", "en", "b", 1),
    (7, "long " * 60_000, "en", "b", 300_000), (8, "mail me at 10.20.30.40 on 2001-02-03", "de", "", 5),
]


@pytest.fixture
def edge_docs(spark, docs_schema):
    docs = spark.createDataFrame(EDGES, docs_schema)
    # extra columns, some named like what the stages make
    return docs.withColumns({c: F.lit("x") for c in ("size", "copies", "score", "__score", "__node", "piece", "sequence_id", "found")})


def texts_of(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)


def test_quality_stage_on_edge_rows(spark, sf, edge_docs):
    # none of these is labelled, so all have the prior of 0.5
    kept = corpus_pipeline.keep_quality(spark, edge_docs.withColumn("doc_id", F.col("doc_id") + 10**9), sf)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.collect() == []


def test_near_duplicate_stage_on_edge_rows(spark, sf, edge_docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, edge_docs, sf)
    assert kept.columns == corpus_pipeline.COLUMNS
    want = [(1, EDGES[0][1]), (3, None), (4, None), (5, ""), (None, EDGES[7][1]), (7, EDGES[8][1]), (8, EDGES[9][1])]
    assert texts_of(kept) == sorted(want, key=repr)


def test_personal_data_stage_on_edge_rows(spark, sf, edge_docs):
    got = corpus_pipeline.hide_personal_data(spark, edge_docs, sf)
    assert got.columns == corpus_pipeline.COLUMNS and got.count() == len(EDGES)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[3].text is None and by_id[3].n_chars is None and by_id[5].text == "" and by_id[7].text == EDGES[8][1]
    assert "4111 1111 1111 1111" not in by_id[None].text and "10.20.30.40" not in by_id[8].text
    assert all(r.n_chars == len(r.text) for r in by_id.values() if r.text is not None)


def test_mixing_stage_on_edge_rows(spark, sf, edge_docs):
    got = corpus_pipeline.mix_sources(spark, edge_docs, sf)
    assert got.columns == corpus_pipeline.COLUMNS
    times = {}
    for r in got.collect():
        times[(r.doc_id, r.text)] = times.get((r.doc_id, r.text), 0) + 1
    known = {(d, x) for d, x, *_ in EDGES}
    assert set(times) <= known and all(n <= 3 * sum((d, x) == k for d, x, *_ in EDGES) for k, n in times.items())


def test_packing_stage_on_edge_rows(spark, sf, edge_docs):
    rows = corpus_pipeline.pack_sequences(spark, edge_docs, sf).collect()
    assert {r.doc_id for r in rows} == {d for d, *_ in EDGES}
    assert sum(r.length for r in rows if r.doc_id in (3, 4, 5, 6)) == 4 and sum(r.length for r in rows if r.doc_id == 7) == 60_001
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in own) <= 2048 for own in places.values())
