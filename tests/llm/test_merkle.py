"""The manifest against a tree built in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from annalist.llm import merkle

SCHEMA = "doc_id long, source string, leaf string, root_of string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def steps_of(levels, at):
    steps = []
    for level in levels[:-1]:
        base = at // 16 * 16
        steps.append(("".join(level[base:at]), "".join(level[at + 1 : base + 16])))
        at //= 16
    return steps


def plain(rows):
    groups = {}
    for doc_id, source, leaf, *_ in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([leaf for _, _, leaf in sorted(groups[s])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    found = []
    for k, name in enumerate(names):
        for at, (there, doc_id, leaf) in enumerate(sorted(groups[name])):
            found.append((doc_id if there else None, leaf, trees[name][-1][0], top[-1][0], steps_of(trees[name], at) + steps_of(top, k)))
    return found


def shown(frame):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in frame.collect()), key=repr)


def check(spark, rows):
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), "leaf")
    assert shown(got) == sorted(plain(rows), key=repr)
    assert got.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [1] * 20, [300, 1, 16, 17], [5000] + [3] * 40])
def test_groups_of_many_sizes(spark, sizes):
    check(spark, [(n, f"é{k:03d}" if k % 2 else f"s{k}", sha(f"{k} {n}"), "x") for k, size in enumerate(sizes) for n in range(size)])


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, sha("a"), "x"), (1, None, sha("b"), None), (1, None, sha("b"), None), (1, None, sha("c"), None), (None, "", sha("d"), "x")] * 9
    check(spark, rows)


def test_a_common_ancestor_is_spread_over_units(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPREAD", 64)
    check(spark, [(n, "hot" if n % 3 else f"s{n % 40}", sha(str(n)), "x") for n in range(3000)])


def test_empty_tables_names_and_null_digests(spark):
    rows = spark.createDataFrame([(1, "s", sha("a"), "x")], SCHEMA)
    assert merkle.manifest(rows.limit(0), "leaf").count() == 0
    with pytest.raises(ValueError, match="named"):
        merkle.manifest(rows.withColumnRenamed("root_of", "root"), "leaf", carry=["root"])
    with pytest.raises(Exception, match="null"):
        merkle.manifest(rows.withColumn("leaf", F.lit(None).cast("string")), "leaf").collect()
    assert merkle.manifest(rows, "leaf", carry=["root_of"]).first()["root_of"] == "x"


def test_encoding_counts_bytes_and_marks_nulls(spark):
    row = spark.sql("SELECT 'é:' AS a, CAST(NULL AS STRING) AS b, -12L AS c, '' AS d")
    assert row.select(merkle.leaf_digest([F.col(c) for c in "abcd"]).alias("h")).first()["h"] == sha("3:é:-3:-120:")
