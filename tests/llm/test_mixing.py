"""Targets, rates and copies against plain loops."""

import math
import re

import pytest

from annalist.llm import mixing, queries


def plain_targets(sizes, weights=(1, 2, 3), cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_names = {}, float(sum(sizes.values())), set(names)
    while open_names:
        whole = sum(weight[s] for s in open_names)
        over = [s for s in open_names if left * weight[s] / whole > cap * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / whole for s in open_names})
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_names -= set(over)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + words(d.text)
    target = plain_targets(sizes)
    source = {d.doc_id: d.source for d in docs}
    rows = queries.QUERIES["op2_entropy_mix"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(source)
    taken = {}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, want in target.items():
        assert abs(taken[s] - want) <= max(0.05 * want, max(words(d.text) for d in docs if d.source == s) / 2)
    again = queries.QUERIES["op2_entropy_mix"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_targets_stop_at_the_cap_and_the_excess_is_shared(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, "\u00e9": 300, "z": 0, None: 40}
    got = mixing.source_targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()
    want = plain_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == want
    assert mixing.source_targets(spark.createDataFrame([], "source string, source_size long")).collect() == []


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c", None, 9), (1, "a b c", None, 9), (2, None, "x", 9), (3, "", "x", 9), (None, "w " * 30, "x", 9), (4, "q", "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == 6 and sorted(r.size for r in got) == [0, 0, 1, 3, 3, 30]
    assert all(r.taken == r.copies * r.size <= 3 * r.size for r in got)
    assert {r.source_size for r in got if r.source is None} == {6}
    assert mixing.mix(docs.where("false")).collect() == []


def test_base_rates_tilt_together_and_stop_at_the_cap(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], [0.5, 1.0, 4.0, None, -1.0][i % 5]) for i in range(200)], "doc_id long, text string, source string, prior double")
    got = mixing.mix(docs, base="prior", weights=(1, 4)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        target = own[0].target
        assert math.isclose(sum(r.rate * r.size for r in own), target, rel_tol=1e-6)
        tilt = {r.rate / r.prior for r in own if (r.prior or 0) > 0 and r.rate < 3 - 1e-9}
        assert max(tilt) - min(tilt) < 1e-9 and all(r.rate == 0 for r in own if (r.prior or -1) <= 0)
        assert abs(sum(r.taken for r in own) - target) <= 10


def mixed_lengths():
    """Three sources with very different lengths of documents."""
    sizes = {"a": [3] * 300 + [200] * 4, "b": [200] * 20 + [3000], "c": [20] * 40 + [3] * 10}
    return [(i, n, s) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]


def solved(rows, targets, softness, cap=3.0):
    """The dual by plain descent on one multiplier after the other."""
    kind = lambda n: min(int(math.log2(n + 1) / 2), mixing.CLASSES - 1)
    full = {s for s, t in targets.items() if t >= cap * sum(n for _, n, x in rows if x == s) * (1 - 1e-12)}
    done, rows = {i: cap for i, _, s in rows if s in full}, [r for r in rows if r[2] not in full]
    targets = {s: t for s, t in targets.items() if s not in full}
    total = sum(n for _, n, _ in rows)
    goal = {k: sum(targets.values()) * sum(n for _, n, _ in rows if kind(n) == k) / total for k in {kind(n) for _, n, _ in rows}}
    source, across = {s: 0.0 for s in targets}, {k: 0.0 for k in goal}
    taken = lambda s, k: sum(n * min(cap, math.exp(source[x] + across[kind(n)])) for _, n, x in rows if (s is None or x == s) and (k is None or kind(n) == k))

    def root(low, high, f):
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) > 0 else (low, mid)
        return (low + high) / 2

    for _ in range(60):
        for s in source:
            def gap(x, s=s):
                source[s] = x
                return targets[s] - taken(s, None)
            source[s] = root(-8, 8, gap)
        for k in across:
            def slack(x, k=k):
                across[k] = x
                return goal[k] - taken(None, k) - softness * goal[k] * x
            across[k] = root(-8, 8, slack)
    for s in source:
        def last(x, s=s):
            source[s] = x
            return targets[s] - taken(s, None)
        source[s] = root(-8, 8, last)
    return done | {i: min(cap, math.exp(source[s] + across[kind(n)])) for i, n, s in rows}


def test_classes_tilt_the_rates_within_a_source(spark):
    rows = mixed_lengths()
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
    got = mixing.mix(docs, softness=0.2).collect()
    targets = {r.source: r.target for r in got}
    want = solved(rows, targets, 0.2)
    assert all(abs(r.rate - want[r.doc_id]) < 1e-3 for r in got)
    for s, target in targets.items():
        own = [r for r in got if r.source == s]
        assert math.isclose(sum(r.rate * r.size for r in own), target, rel_tol=1e-6)
        assert len({round(r.rate, 9) for r in own}) >= 2 or target == 3 * own[0].source_size
    assert sum(t < 3 * sum(n for _, n, x in rows if x == s) for s, t in targets.items()) == 2


def test_newton_takes_several_steps(spark):
    cells = {}
    for _, n, s in mixed_lengths():
        key = (s, min(int(math.log2(n + 1) / 2), mixing.CLASSES - 1), 1.0)
        cells[key] = cells.get(key, 0) + n
    total = sum(cells.values())
    held = spark.createDataFrame([(*k, v) for k, v in cells.items()], "key string, kind int, base double, size long")
    aims = spark.createDataFrame([("a", total / 6), ("b", total / 3), ("c", total / 2)], "key string, target double")
    _, kinds, steps = mixing.tilts(held, aims, cap=100.0)
    assert 3 <= steps <= 40 and max(kinds) - min(kinds) > 0.1
