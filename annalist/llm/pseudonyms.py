"""Format-preserving pseudonyms for personal data, as column expressions.

Numbers and dates that pass their own check (calendar, Luhn, mod 97, ranges) are
replaced by other valid values of the same format. Each value is a point of a
domain of two factors, and a keyed Feistel network permutes the domain: equal
values get equal pseudonyms in all documents, different ones different ones, and
who has the key can go back. In e-mail addresses the letters and digits before
the at sign are permuted, the rest of the form stays.

| kind | what is permuted |
| --- | --- |
| email | letters and digits of the local part, each within its kind |
| iban | digits behind the check digits, which are computed anew |
| ip | the 32 bits of a dotted address |
| date | the day among those of 1900 to 2099, in the same notation |
| ssn | the number among those that can be issued |
| phone | the digits behind the country code |
| card | digits behind the first; the Luhn digit is computed anew |
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
ROUNDS = 10
LETTERS_AT_ONCE = 22

EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d{1,2}([./])\d{1,2}\1(?:19|20)\d\d)(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d)"
CARD = r"(?<![\d.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
OTHERS = "|".join((EMAIL, IP, DATE, SSN, PHONE, CARD))

IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


OWN_IBAN = "^(?:" + "|".join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
# where an IBAN may start, and as group 1 as much as may belong to it; not the local part of an e-mail address
IBAN_START = rf"(?<![A-Za-z0-9])(?=({IBAN}))(?![A-Za-z0-9._%+-]++@[A-Za-z0-9-]+\.[A-Za-z0-9-])"

FIRST_DAY, DAY_FACTORS = "1900-01-01", (319, 229)  # 319 * 229 days up to 2099-12-31
AREAS, GROUPS, SERIALS = 898, 99, 9999  # areas 001-899 but 666


def _lit(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _secret(key: str, tweak: Column, step: Column, value: Column) -> Column:
    """60 bits that depend on the key, the tweak, the round and one half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, step.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, wide: Column, high: Column, key: str, tweak: Column) -> Column:
    """A permutation of the pairs (l, r) with 0 <= l < wide, 0 <= r < high: in
    turn each half is shifted, modulo its size, by a keyed hash of the other."""

    def turn(pair: Column, step: Column) -> Column:
        even = step % 2 == 0
        told = _secret(key, tweak, step, F.when(even, pair["r"]).otherwise(pair["l"]))
        return F.struct(
            F.when(even, F.pmod(pair["l"] + told, wide)).otherwise(pair["l"]).alias("l"),
            F.when(even, pair["r"]).otherwise(F.pmod(pair["r"] + told, high)).alias("r"),
        )

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)


def _then(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _power(base: int, exponent: Column) -> Column:
    return F.get(F.array(*[_lit(base**k) for k in range(12)]), exponent.cast("int"))


def _read(symbols: Column, radix: int) -> Column:
    """The number that a string of digits or of lower-case letters spells."""
    if radix == 10:
        return F.when(symbols == "", _lit(0)).otherwise(symbols.try_cast("bigint"))
    return F.aggregate(F.split(symbols, ""), _lit(0), lambda n, c: F.when(c == "", n).otherwise(n * radix + (F.ascii(c) - 97)))


def _spell(number: Column, length: Column, radix: int) -> Column:
    if radix == 10:
        return F.when(length > 0, F.lpad(number.cast("string"), length, F.lit("0"))).otherwise(F.lit(""))
    start = F.struct(number.alias("n"), F.lit("").alias("s"))
    exact = lambda acc, _: F.struct(F.call_function("div", acc["n"], _lit(radix)).alias("n"), F.concat(F.char(_lit(97) + acc["n"] % radix), acc["s"]).alias("s"))
    return F.when(length > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), start, exact, lambda acc: acc["s"])).otherwise(F.lit(""))


def _permuted(symbols: Column, key: str, tweak: Column, radix: int = 10) -> Column:
    """Another string of the same length and alphabet."""

    def halves(s: Column) -> Column:
        short = F.floor(F.length(s) / 2).cast("int")
        long = F.length(s) - short
        named = F.concat_ws(":", tweak, F.length(s).cast("string"))
        pair = feistel(_read(F.substring(s, F.lit(1), short), radix), _read(F.substring(s, short + 1, long), radix), _power(radix, short), _power(radix, long), key, named)
        return _then(pair, lambda p: F.concat(_spell(p["l"], short, radix), _spell(p["r"], long, radix)))

    return _then(symbols, halves)


def _filled(form: Column, signs: Column, pattern: str) -> Column:
    """``form`` with its characters of the class replaced, in turn, by ``signs``;
    capitals stay capitals."""

    def put(acc: Column, c: Column) -> Column:
        new = F.substring(signs, acc["k"], F.lit(1))
        hit = c.rlike(pattern)
        return F.struct(
            F.concat(acc["s"], F.when(~hit, c).when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)).alias("s"),
            (acc["k"] + hit.cast("int")).alias("k"),
        )

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), put, lambda acc: acc["s"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum; a valid number's ends in 0."""
    spot = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    add = lambda n, i: n + F.when(i % 2 == 0, spot(i)).when(spot(i) > 4, 2 * spot(i) - 9).otherwise(2 * spot(i))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN (no spaces), country and check digits moved to the end."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    sign = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    add = lambda n, c: F.when(c == "", n).otherwise((n * F.when(c.rlike("[0-9]"), 10).otherwise(100) + sign(c)) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def _date_parts(value: Column) -> Column:
    """(year, month, day) as text; with slashes and a second number above 12, month first."""
    iso = value.rlike(r"^\d{4}-")
    numbers = F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0))
    first, second, third = (F.get(numbers, F.lit(i)) for i in range(3))
    month_first = value.contains("/") & (second.cast("int") > 12)
    return F.struct(
        F.when(iso, first).otherwise(third).alias("y"),
        F.when(iso | ~month_first, second).otherwise(first).alias("m"),
        F.when(iso, third).when(month_first, second).otherwise(first).alias("d"),
    )


def _date(value: Column) -> Column:
    parts = _date_parts(value)
    return F.concat_ws("-", parts["y"], F.lpad(parts["m"], 2, "0"), F.lpad(parts["d"], 2, "0")).try_cast("date")


def kind_of(value: Column) -> Column:
    """The kind of a matched string, null if it fails its check."""
    octets = F.transform(F.split(value, r"\."), lambda o: o.try_cast("int"))
    dense = F.regexp_replace(value, " ", "")
    number = _digits(value)
    issued = (~F.substring(number, 1, 3).isin("000", "666")) & (F.substring(number, 1, 1) != "9") & (F.substring(number, 4, 2) != "00") & (F.substring(number, 6, 4) != "0000")
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(rf"^{IBAN}$"), F.when(_mod97(dense) == 1, "iban"))
        .when(value.rlike(rf"^{IP}$"), F.when(F.forall(octets, lambda o: o <= 255), "ip"))
        .when(value.rlike(rf"^{DATE}$"), F.when(_date(value).isNotNull(), "date"))
        .when(value.rlike(rf"^{SSN}$"), F.when(issued, "ssn"))
        .when(value.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(F.length(number).between(13, 19), F.when(luhn_sum(number) % 10 == 0, "card"))
    )


def _email(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    letters, numbers = F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), _digits(local)
    step = LETTERS_AT_ONCE
    parts = F.sequence(F.lit(0), F.floor(F.greatest(F.length(letters) - 1, F.lit(0)) / step).cast("int"))
    new_letters = F.array_join(F.transform(parts, lambda k: _permuted(F.substring(letters, k * step + 1, F.lit(step)), key, F.concat(F.lit("email"), k.cast("string")), 26)), "")
    number_parts = F.sequence(F.lit(0), F.floor(F.greatest(F.length(numbers) - 1, F.lit(0)) / 18).cast("int"))
    new_numbers = F.array_join(F.transform(number_parts, lambda k: _permuted(F.substring(numbers, k * 18 + 1, F.lit(18)), key, F.concat(F.lit("email"), k.cast("string"), letters))), "")
    return F.concat(_filled(_filled(local, new_letters, "[A-Za-z]"), new_numbers, "[0-9]"), F.substring(value, F.length(local) + 1, F.length(value)))


def _iban(value: Column, key: str) -> Column:
    dense = F.regexp_replace(value, " ", "")
    inner = F.substring(dense, F.lit(5), F.length(dense))
    numbers = _digits(inner)
    parts = F.sequence(F.lit(0), F.floor(F.greatest(F.length(numbers) - 1, F.lit(0)) / 18).cast("int"))
    new = F.array_join(F.transform(parts, lambda k: _permuted(F.substring(numbers, k * 18 + 1, F.lit(18)), key, F.concat(F.lit("iban"), k.cast("string"), F.substring(dense, 1, 2)))), "")
    body = _filled(inner, new, "[0-9]")
    country = F.substring(dense, 1, 2)
    check = _then(body, lambda b: F.lpad((F.lit(98) - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"))
    spaced = lambda s: F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), lambda acc, c: F.struct(F.concat(acc["s"], F.when(c == " ", c).otherwise(F.substring(s, acc["k"], F.lit(1)))).alias("s"), (acc["k"] + (c != " ").cast("int")).alias("k")), lambda acc: acc["s"])
    return _then(F.concat(country, check, body), spaced)


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    pair = feistel(F.get(octets, F.lit(0)) * 256 + F.get(octets, F.lit(1)), F.get(octets, F.lit(2)) * 256 + F.get(octets, F.lit(3)), _lit(65536), _lit(65536), key, F.lit("ip"))
    half = lambda n: (F.call_function("div", n, _lit(256)).cast("string"), (n % 256).cast("string"))
    return _then(pair, lambda p: F.concat_ws(".", *half(p["l"]), *half(p["r"])))


def _new_date(value: Column, key: str) -> Column:
    wide, high = DAY_FACTORS
    day = F.datediff(_date(value), F.lit(FIRST_DAY).cast("date"))
    pair = feistel(F.call_function("div", day, _lit(high)), day % high, _lit(wide), _lit(high), key, F.lit("date"))
    numbers = F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0))
    sign = F.regexp_extract(value, r"[./-]", 0)
    short = lambda i, n: F.when(F.length(F.get(numbers, F.lit(i))) == 1, n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))
    month_first = value.contains("/") & (F.get(numbers, F.lit(1)).cast("int") > 12)

    def written(date: Column) -> Column:
        year, month, day_of = F.lpad(F.year(date).cast("string"), 4, "0"), F.month(date), F.day(date)
        return (
            F.when(value.rlike(r"^\d{4}-"), F.date_format(date, "yyyy-MM-dd"))
            .when(month_first, F.concat(short(0, month), sign, short(1, day_of), sign, year))
            .otherwise(F.concat(short(0, day_of), sign, short(1, month), sign, year))
        )

    return _then(pair, lambda p: _then(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * high + p["r"]).cast("int")), written))


def _ssn(value: Column, key: str) -> Column:
    number = _digits(value)
    area = F.substring(number, 1, 3).cast("int")
    left = (area - 1 - (area > 666).cast("int")) * GROUPS + F.substring(number, 4, 2).cast("int") - 1
    pair = feistel(left, F.substring(number, 6, 4).cast("int") - 1, _lit(AREAS * GROUPS), _lit(SERIALS), key, F.lit("ssn"))
    place = lambda p: F.call_function("div", p["l"], _lit(GROUPS)) + 1
    return _then(
        pair,
        lambda p: F.concat_ws(
            "-",
            F.lpad((place(p) + (place(p) >= 666).cast("int")).cast("string"), 3, "0"),
            F.lpad((p["l"] % GROUPS + 1).cast("string"), 2, "0"),
            F.lpad((p["r"] + 1).cast("string"), 4, "0"),
        ),
    )


def _phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    own = F.substring(value, F.length(country) + 1, F.length(value))
    return F.concat(country, _filled(own, _permuted(_digits(own), key, F.concat(F.lit("phone"), country)), "[0-9]"))


def _card(value: Column, key: str) -> Column:
    number = _digits(value)
    first = F.substring(number, 1, 1)
    body = F.concat(first, _permuted(F.substring(number, F.lit(2), F.length(number) - 2), key, F.concat(F.lit("card"), first)))
    checked = _then(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    return _then(checked, lambda c: _filled(value, c, "[0-9]"))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of a kind; what has no kind stays."""
    made = {"email": _email, "iban": _iban, "ip": _ip, "date": _new_date, "ssn": _ssn, "phone": _phone, "card": _card}
    result = F.when(F.lit(False), value)
    for name, of in made.items():
        result = result.when(kind == name, of(value, key))
    return result.otherwise(value)


def _iban_in(candidate: Column) -> Column:
    """The IBAN that a candidate starts with, null if none passes its check: as
    long as its country says, else the whole."""
    valid = lambda v: F.when((v != "") & (_mod97(F.regexp_replace(v, " ", "")) == 1), v)
    return F.coalesce(_then(F.regexp_extract(candidate, OWN_IBAN, 0), valid), valid(candidate))


def _around_ibans(text: Column) -> Column:
    """``text`` as an array of (plain, iban): the text up to a valid IBAN and the
    IBAN, null after the last. A candidate that fails its check stays in the
    plain text, so that it hides no value that begins inside it."""
    candidates = F.regexp_extract_all(text, F.lit(IBAN_START), F.lit(1))
    # the space makes the first piece one without a candidate
    pieces = F.split(F.concat(F.lit(" "), text), IBAN_START, -1)
    starts = F.zip_with(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), candidates, lambda p, c: F.struct(p.alias("piece"), _iban_in(c).alias("iban")))
    done = F.lit([]).cast("array<struct<plain:string,iban:string>>")
    part = lambda plain, iban: F.array(F.struct(plain.alias("plain"), iban.cast("string").alias("iban")))

    def put(acc: Column, x: Column) -> Column:
        new = x["iban"].isNotNull() & (acc["skip"] == 0)
        skip = F.when(new, F.length(x["iban"])).otherwise(acc["skip"])
        rest = F.substring(x["piece"], skip + 1, F.length(x["piece"]))
        return F.struct(
            F.when(new, F.concat(acc["done"], part(acc["plain"], x["iban"]))).otherwise(acc["done"]).alias("done"),
            F.when(new, rest).otherwise(F.concat(acc["plain"], rest)).alias("plain"),
            F.greatest(skip - F.length(x["piece"]), F.lit(0)).alias("skip"),
        )

    start = F.struct(done.alias("done"), F.substring(F.get(pieces, F.lit(0)), F.lit(2), F.length(text)).alias("plain"), F.lit(0).alias("skip"))
    cut = F.aggregate(starts, start, put, lambda acc: F.concat(acc["done"], part(acc["plain"], F.lit(None))))
    return F.when(F.regexp_like(text, F.lit(IBAN_START)), cut).otherwise(part(text, F.lit(None)))


def pseudonymised(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced.

    With ``found`` a column of that name is added: an array of (kind, value,
    pseudonym) in the order of the text, which is the link table's material and
    as secret as the text. Null texts stay null, with an empty array; texts
    without personal data stay as they are. Other columns, whatever their
    names, pass through; repeated rows get equal results.

    ``key`` is a literal of the plan: whoever may read plans can read it.
    """
    hits = lambda s: F.concat(F.regexp_extract_all(s["plain"], F.lit(OTHERS), F.lit(0)), F.filter(F.array(s["iban"]), lambda v: v.isNotNull()))
    told = F.transform("__hits", lambda m: _then(kind_of(m), lambda k: F.struct(k.alias("kind"), m.alias("value"), pseudonym(m, k, key).alias("pseudonym"))))
    pieces = F.flatten(F.transform("__parts", lambda s: F.split(s["plain"], OTHERS, -1)))
    woven = F.array_join(F.flatten(F.zip_with(pieces, F.col("__told"), lambda p, t: F.array(p, t["pseudonym"]))), "")
    out = docs.withColumn("__parts", _around_ibans(F.col(text)))
    out = out.withColumn("__hits", F.coalesce(F.flatten(F.transform("__parts", hits)), F.lit([]).cast("array<string>"))).withColumn("__told", told)
    out = out.withColumn(text, F.when(F.size("__told") > 0, woven).otherwise(F.col(text)))
    if found:
        out = out.withColumn(found, F.filter("__told", lambda t: t["kind"].isNotNull()))
    return out.drop("__parts", "__hits", "__told")
