"""Classes against all pairs of a small corpus; the alignment against a full table."""

import random

import numpy as np
import pytest

from annalist.llm import neardup, queries

S = neardup.Settings()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def shingles(text):
    w = text.lower().split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    both = lcs(x, y)
    return both / (len(x) + len(y) - both) if x and y else 0.0


def plain_classes(texts):
    """text -> (class number, links), all pairs compared."""
    texts = sorted(set(texts))
    sets = [set(shingles(t)) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5 and similarity(texts[i], texts[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    return {t: (find(i), links[i]) for i, t in enumerate(texts)}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = plain_classes(t for _, t, _ in rows if t is not None)
    least, size = {}, {}
    for i, t, _ in rows:
        if t is not None:
            c = want[t][0]
            least[c], size[c] = min(least.get(c, i), i), size.get(c, 0) + 1
    text = {i: t for i, t, _ in rows}
    for r in got:
        t = text[r.doc_id]
        if t is None:
            assert (r.class_id, r.class_size, r.verified_links) == (r.doc_id, 1, 0)
        else:
            c = want[t][0]
            assert (r.class_id, r.class_size) == (least[c], size[c]), t[:50]
            assert min(1, want[t][1]) <= r.verified_links <= want[t][1]
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()) | {i for i, t, _ in rows if t is None})


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [f"new{rng.random()}"], [words[k], f"in{rng.random()}"]])
    return words


def test_planted_copies_and_passages(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, passage = [], " ".join(word() for _ in range(60))
    for _ in range(6):
        base = [word() for _ in range(rng.choice([8, 40, 150, 400]))]
        for edits in (0, 0, 1, 1, 2, 3, 5, 9):
            rows.append(" ".join(edited(rng, base, edits if len(base) > 20 else min(edits, 1))))
    rows += [passage + " " + " ".join(word() for _ in range(90)) for _ in range(30)]
    rows += ["", "", " ", "a b", "a b", "a  b", None, None, "One two three four five", "one TWO three four five", "x " * 3000, "x " * 3001]
    check(spark, [(100 + 7 * i, t, "clash") for i, t in enumerate(rows)])


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text + " end"), (None, "alone here"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, 5, 4, 1, 5), (5, 5, 4, 1, 5), (None, 5, 4, 1, 5), (7, 5, 4, 1, 7), (None, None, 1, 0, None), (None, None, 1, 0, None)], key=repr)
    assert sorted(map(tuple, neardup.deduplicated(docs).collect()), key=repr) == sorted([(5, text), (None, "alone here"), (None, None)], key=repr)
    none = docs.where("false")
    assert neardup.near_duplicates(none).collect() == [] == neardup.deduplicated(none).collect()


def test_query(spark, sf):
    docs = [(r.doc_id, r.text, "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_classes(t for _, t, _ in docs if t is not None)
    got = queries.QUERIES["op5_near_duplicates"](spark, sf).collect()
    text = {i: t for i, t, _ in docs}
    assert len(got) == len(docs) and all(min(1, want[text[r.doc_id]][1]) <= r.verified_links <= want[text[r.doc_id]][1] for r in got)
    assert len({r.class_id for r in got}) == len({c for c, _ in want.values()})


def test_alignment():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.randint(0, rng.choice([3, 30])) for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.randint(0, 30))
        most, distance = rng.randint(0, 30), len(a) + len(b) - 2 * lcs(a, b)
        assert neardup.indel_distance(a, b, most) == (distance if distance <= most else None)


def test_order_matters_and_occurrences_count():
    words = np.arange(100, dtype=np.uint32)
    turned = np.r_[words[50:], words[:50]]
    assert neardup.compared(words, words, S)[0] and not neardup.compared(words, turned, S)[0]
    keys = lambda w: set(neardup.band_keys(neardup.kmers(w, 5), S).tolist())
    assert len(keys(words) & keys(words)) == S.bands and len(keys(words) & keys(turned)) < S.bands / 2
    again = np.zeros(50, np.uint32)
    assert len(set(neardup.labelled(neardup.kmers(again, 5)).tolist())) == 46


@pytest.mark.parametrize("wanted", [0.85, 0.5])
def test_collisions_follow_the_similarity(wanted):
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(150):
        a = rng.integers(0, 2**32, 300, dtype=np.uint32)
        b = a.copy()
        cut = int(300 * (1 - wanted) / (1 + wanted))
        b[:cut] = rng.integers(0, 2**32, cut, dtype=np.uint32)
        met += bool(set(neardup.band_keys(neardup.kmers(a, 5), S).tolist()) & set(neardup.band_keys(neardup.kmers(b, 5), S).tolist()))
    assert met >= 149 if wanted > 0.8 else met <= 40


def test_every_pair_of_short_texts_is_found(spark):
    rng = random.Random(11)
    texts = set()
    while len(texts) < 1000:
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 15))]
        texts.add(" ".join(words))
        for _ in range(rng.randint(0, 2)):
            near = list(words)
            if rng.random() < 0.5:
                near.append(f"w{rng.randrange(400)}")
            else:
                near = near[1:]
            if len(near) >= 5:
                texts.add(" ".join(near))
    texts = sorted(texts)
    grams = [[tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)] for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = 0
    for a in range(len(texts)):
        for b in range(a):
            if set(grams[a]) & set(grams[b]):
                small, large = sorted((grams[a], grams[b]), key=len)
                # one is the other without an end, or they are compared as they stand
                common = max(sum(x == y for x, y in zip(small, large[shift:])) for shift in range(len(large) - len(small) + 1))
                if common / (len(small) + len(large) - common) >= 0.8:
                    links += 1
                    parent[root(a)] = root(b)
    classes = {}
    for k in range(len(texts)):
        classes.setdefault(root(k), []).append(k)
    want = {k: min(own) for own in classes.values() for k in own}
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert links > 200 and got == want


def test_full_buckets_and_leaders_are_met_in_slots(spark):
    rows = [(k, f"a common opening of many words that all texts share here {k // 3} " + " ".join(f"t{k // 3}x{n}" for n in range(30)) + f" tail{k}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, neardup.near_duplicates(docs).collect()))
    slotted = sorted(map(tuple, neardup.near_duplicates(docs, settings=neardup.Settings(side=2)).collect()))
    assert plain == slotted and all(r[1] == 3 * (r[0] // 3) for r in plain)
