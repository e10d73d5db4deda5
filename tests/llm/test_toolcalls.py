"""Links, levels and validation against a small chat and plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from annalist.llm import queries, toolcalls
from tests.compare import duck, rows_of

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after string, level string"
RESULTS = "conv_id long, turn long, call_id string, content string, status string"
SCHEMAS = [("t", "q", "string", True), ("t", "n", "integer", False), ("t", "x", "number", False), ("t", "o", "object", False), ("t", "a", "array", False), ("t", "b", "boolean", False)]


@pytest.fixture(scope="module")
def schemas(spark):
    return spark.createDataFrame(SCHEMAS, "tool string, field string, type string, required boolean")


def test_a_chat(spark, schemas):
    calls = [
        (1, 0, "a", "t", '{"q":"x", "n":3}', None, ""), (1, 0, "a", "t", '{"q":"x", "n":3}', None, "other"), (1, 2, "b", "t", '{"n":"3","z":1}', "a", ""), (1, 4, "c", "u", "{}", "b", ""),
        (1, 6, "b", "t", "{}", None, ""), (2, 0, "x", "t", "nojson", "y", ""), (2, 1, "y", "t", '{"q":null}', "x", ""), (2, 2, "w", "t", "[1]", "y", ""), (None, 0, "a", "t", "{}", None, ""), (3, 0, None, "t", None, "gone", ""),
        (3, 1, "e", None, None, "gone", ""),
    ]
    results = [(1, 1, "a", "ok", ""), (1, 3, "zz", None, ""), (1, 5, "b", 'say "hi"\n', ""), (1, 7, "b", "late", ""), (2, 5, "x", "r", ""), (4, 0, None, "", "")]
    rows = toolcalls.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas).collect()
    got = {(r.conv_id, r.turn, r.kind, r.call_id): (r.level, r.status, r.errors, r.copies, r.json) for r in rows}
    assert len(got) == len(rows) == 16
    assert got[1, 0, "call", "a"] == (0, "answered", [], 2, '{"arguments":{"n":3,"q":"x"},"id":"a","name":"t","type":"call"}')
    assert got[1, 1, "result", "a"][:2] == (1, "answer")
    assert got[1, 2, "call", "b"][:3] == (2, "answered", ["missing q", "type n", "unknown z"])
    assert got[1, 5, "result", "b"] == (3, "answer", [], 1, '{"content":"say \\"hi\\"\\n","id":"b","type":"result"}')
    assert got[1, 7, "result", "b"][1] == got[1, 6, "call", "b"][1] == "duplicate"
    assert got[1, 4, "call", "c"][:3] == (4, "unanswered", ["tool"])
    assert got[1, 3, "result", "zz"] == (None, "orphan", [], 1, '{"content":null,"id":"zz","type":"result"}')
    assert {got[2, t, "call", i][:2] for t, i in ((0, "x"), (1, "y"), (2, "w"))} == {(None, "circular")}
    assert got[2, 0, "call", "x"][2] == got[2, 2, "call", "w"][2] == ["json"] and got[2, 1, "call", "y"][2] == ["missing q"]
    assert got[None, 0, "call", "a"][1] == got[3, 0, "call", None][1] == got[4, 0, "result", None][1] == "nameless"
    assert got[3, 1, "call", "e"][:3] == (0, "unanswered", ["json", "tool"])
    for value in got.values():
        json.loads(value[4])


def test_types_and_canonical_form(spark, schemas):
    texts = ['{"b":1.50,"a":{"z":null,"é":"x\\n","A":[1,{"d":1,"c":2}]}}', '{"a":1,"a":2}', "nope", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(toolcalls.canonical(F.col("t"))).collect()]
    assert got[1:] == [None] * 3 and got[0].startswith('{"a":{"A":[1,{"c":2,"d":1}],"z":null,"é":"x\\n"},"b":1.5')
    good = '{"q":"s","n":1,"x":1.5,"o":{},"a":[],"b":true}'
    bad = '{"q":1,"n":1.5,"x":"1","o":[],"a":{},"b":"true"}'
    calls = spark.createDataFrame([(1, "g", "t", good), (1, "w", "t", bad), (1, "i", "t", '{"q":"","x":3}')], "conv_id long, call_id string, name string, arguments string")
    errors = {r.call_id: r.errors for r in toolcalls.argument_errors(calls, schemas).collect()}
    assert errors == {"w": [f"type {f}" for f in "abnoqx"]}


def test_levels_of_random_forests(spark):
    rng = random.Random(5)
    parent = {(c, i): (rng.randrange(i) if i and rng.random() < 0.9 else None) for c in range(4) for i in range(40)}
    parent |= {(9, i): i - 1 if i else None for i in range(70)}  # one long chain
    rows = [(c, str(i), None if p is None else str(p)) for (c, i), p in parent.items()]
    got = {(r.conv_id, int(r.call_id)): r.depth for r in toolcalls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after string")).collect()}

    def depth(c, i):
        return 0 if parent[c, i] is None else 1 + depth(c, parent[c, i])

    assert got == {k: depth(*k) for k in parent}


def test_query_and_empty(spark, sf, schemas):
    name = "op4_linked_calls"
    frame = queries.QUERIES[name](spark, sf)
    result = duck(sf).execute(queries.SQL[name])
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of([d[0] for d in result.description], result.fetchall())
    assert toolcalls.linked(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), schemas).collect() == []
