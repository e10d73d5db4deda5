"""Pseudonyms against a plain Feistel network, and what has to hold for any key."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from annalist.llm import pseudonyms

KEY = "k"


def plain_feistel(left, right, wide, high, tweak, back=False):
    steps = range(pseudonyms.ROUNDS)
    for i in reversed(steps) if back else steps:
        told = int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{right if i % 2 == 0 else left}".encode()).hexdigest()[:15], 16)
        told = -told if back else told
        if i % 2 == 0:
            left = (left + told) % wide
        else:
            right = (right + told) % high
    return left, right


def plain_digits(digits, tweak):
    short = len(digits) // 2
    long = len(digits) - short
    a, b = plain_feistel(int(digits[:short] or 0), int(digits[short:] or 0), 10**short, 10**long, f"{tweak}:{len(digits)}")
    return (f"{a:0{short}d}" if short else "") + f"{b:0{long}d}"


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10


def run(spark, texts, key=KEY):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    return [(r.text, [(f.kind, f.value, f.pseudonym) for f in r.found]) for r in pseudonymised(docs, key).orderBy("doc_id").collect()]


def pseudonymised(docs, key):
    return pseudonyms.pseudonymised(docs, key, found="found")


def test_values_are_permuted_as_by_hand(spark):
    card = "4041894974608795"
    text, found = run(spark, [f"card {card}, 4041-8949-7460-8795 ip 70.123.182.155 on 1985-02-28 or 28.02.1985; ssn 123-45-6789 tel +1 (988) 555-2485"])[0]
    by_kind = {}
    for kind, value, new in found:
        by_kind.setdefault(kind, []).append((value, new))
    body = "4" + plain_digits(card[1:-1], "card|4".replace("|", ""))
    want = next(body + str(d) for d in range(10) if luhn(body + str(d)) == 0)
    assert by_kind["card"] == [(card, want), ("4041-8949-7460-8795", "-".join(want[i : i + 4] for i in range(0, 16, 4)))]
    a, b = plain_feistel(70 * 256 + 123, 182 * 256 + 155, 65536, 65536, "ip")
    assert by_kind["ip"][0][1] == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    assert plain_feistel(a, b, 65536, 65536, "ip", back=True) == (70 * 256 + 123, 182 * 256 + 155)
    first = datetime.date(1900, 1, 1)
    day = (datetime.date(1985, 2, 28) - first).days
    a, b = plain_feistel(day // 229, day % 229, 319, 229, "date")
    new = first + datetime.timedelta(a * 229 + b)
    assert [n for _, n in by_kind["date"]] == [new.isoformat(), new.strftime("%d.%m.%Y")]
    assert by_kind["phone"][0][1] == "+1 ({}) {}-{}".format(*re.match(r"(...)(...)(....)", plain_digits("9885552485", "phone+1")).groups())
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", by_kind["ssn"][0][1])
    for values in by_kind.values():
        for value, new in values:
            assert value not in text and new in text


def test_invalid_values_and_plain_text_stay(spark):
    texts = [None, "", "no data", "4041894974608796 999.1.1.1 2021-02-30 000-12-3456 v4.0. a@b 12345", "x" * 200_000, "1.2.3.4.5 " * 3]
    assert [(t, f) for t, f in run(spark, texts)] == [(t, []) for t in texts]
    docs = spark.createDataFrame([], "doc_id long, text string, kind string")
    assert pseudonymised(docs, KEY).collect() == []


IBANS_IN_TEXT = [
    ("pay RO49AAAA1B31007593840000 BIC AAAAROBU now", ["RO49AAAA1B31007593840000"]),
    ("BE68 5390 0754 7034 EUR 20", ["BE68 5390 0754 7034"]),
    ("to ES9121000418450200051332 1234", ["ES9121000418450200051332"]),
    ("AT61 1904 3002 3457 3201 BIC BKAUATWW, DE89 3704 0044 0532 0130 00 AB.", ["AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00"]),
    ("NR12 4111 1111 1111 1111 is one", ["4111 1111 1111 1111"]),
    ("RO12 ABCD EFGH 4111 1111 1111 1111.", ["4111 1111 1111 1111"]),
    ("BE12 RO49 AAAA 1B31 0075 9384 0000 ok", ["RO49 AAAA 1B31 0075 9384 0000"]),
    ("DE89370400440532013000@x.org, x-DE89370400440532013000@x.org", ["DE89370400440532013000@x.org", "x-DE89370400440532013000@x.org"]),
    ("RO49AAAA1B31007593840000", ["RO49AAAA1B31007593840000"]),
    ("é RO49AAAA1B31007593840000 é 1985-02-28 BE68539007547034", ["RO49AAAA1B31007593840000", "1985-02-28", "BE68539007547034"]),
    ("BE69 5390 0754 7034 EUR 20", []),
]


def test_ibans_end_where_their_country_says(spark):
    told = run(spark, [text for text, _ in IBANS_IN_TEXT])
    for (text, want), (new, found) in zip(IBANS_IN_TEXT, told, strict=True):
        assert [v for _, v, _ in found] == want
        at, out = 0, []
        for _, value, other in found:
            k = text.index(value, at)
            out += [text[at:k], other]
            at = k + len(value)
            assert other != value
        assert new == "".join([*out, text[at:]])


def test_long_texts_and_many_values(spark):
    text = "bosbt.42@mail8.example.com or BosBt.42@mail8.example.com. " * 300
    new, found = run(spark, [text])[0]
    assert len(found) == 600 and len({n for _, _, n in found}) == 2 and len(new) == len(text)
    assert found[0][2].lower() == found[1][2].lower() and found[0][2].endswith("@mail8.example.com")


@pytest.mark.parametrize("kind, values", [
    ("date", [(datetime.date(1999, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(400)]),
    ("ssn", [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in (1, 9999)]),
    ("phone", [f"555-010-{i:04d}" for i in range(200)]),
    ("email", [f"{a}{b}@x.org" for a in "abcxyz" for b in ("", "1", "22", "q.w", "-Z9", "m" * 30)]),
    ("card", [next(f"411111{i:09d}{d}" for d in range(10) if luhn(f"411111{i:09d}{d}") == 0) for i in range(100)]),
    ("iban", ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"]),
])
def test_one_to_one_and_valid(spark, kind, values):
    docs = spark.createDataFrame([(v,) for v in values], "value string")
    value = F.col("value")
    rows = docs.select("value", pseudonyms.kind_of(value).alias("kind"), pseudonyms.pseudonym(value, F.lit(kind), KEY).alias("new"), pseudonyms.pseudonym(value, F.lit(kind), "other").alias("other"))
    rows = rows.withColumn("again", pseudonyms.kind_of(F.col("new"))).collect()
    assert {r.kind for r in rows} == {r.again for r in rows} == {kind}
    assert len({r.new for r in rows}) == len(values)
    form = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
    assert all(form(r.new) == form(r.value) for r in rows)
    assert sum(r.new != r.other for r in rows) > len(rows) * 0.6


def test_equal_values_are_linked_across_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = pseudonymised(docs, KEY).select(F.explode("found").alias("x")).select("x.*").distinct().collect()
    assert len({(r.kind, r.value) for r in told}) == len(told) == len({(r.kind, r.pseudonym) for r in told}) > 20
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in pseudonymised(docs, KEY).collect():
        want = before[r.doc_id]
        at, out = 0, []
        for f in r.found:
            k = want.index(f.value, at)
            out += [want[at:k], f.pseudonym]
            at = k + len(f.value)
        assert r.text == (None if want is None else "".join([*out, want[at:]]))
