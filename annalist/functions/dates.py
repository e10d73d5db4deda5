"""Dates written in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.text import bound, fold_marks

# Month names and their numbers.
MONTHS = ("ianuarie", "februarie", "martie", "aprilie", "mai", "iunie", "iulie", "august", "septembrie", "octombrie", "noiembrie", "decembrie")
_S, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
NUMERIC = rf"{_S}(\d{{1,2}})[./](\d{{1,2}})[./](\d{{4}}){_E}"
LONG = rf"{_S}(\d{{1,2}})\s+([A-Za-zĂÂÎȘŞȚŢăâîșşțţ]+)\s+(\d{{4}}){_E}"
BARE_YEAR = rf"{_S}(19[89]\d|20\d{{2}}){_E}"


def month_number(name: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), fold_marks(name))
    return F.nullif(position, F.lit(0)).cast("int")


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("int").cast("string"), 2, "0"))


def _date_of(year: Column, month: Column, day: Column) -> Column:
    return F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def _first_match(text: Column, pattern: str, apart: str, make) -> Column:
    """``make`` of the three parts of the first match; null without one."""
    return bound(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", bound(F.split(m, apart), make)))


def parse_date(text: Column) -> Column:
    """First date in the text: numeric, else with a month name."""
    return bound(text, lambda t: F.coalesce(
        _first_match(t, NUMERIC, "[./]", lambda p: _date_of(p[2], p[1], p[0])),
        _first_match(t, LONG, r"\s+", lambda p: _date_of(p[2], month_number(p[1]), p[0]))))


def date_candidates(text: Column) -> Column:
    """All dates as text: long forms, numeric forms, then years that begin none
    of them."""

    def found(t: Column) -> Column:
        long = F.transform(F.regexp_extract_all(t, F.lit(LONG), F.lit(0)), lambda m: bound(F.split(m, r"\s+"), lambda p: bound(
            month_number(p[1]), lambda n: F.when(n.isNotNull(), _iso(p[2], n, p[0])))))
        numeric = F.transform(F.regexp_extract_all(t, F.lit(NUMERIC), F.lit(0)), lambda m: bound(F.split(m, "[./]"), lambda p: _iso(p[2], p[1].cast("int"), p[0])))
        years = F.array_distinct(F.regexp_extract_all(t, F.lit(BARE_YEAR), F.lit(1)))
        return bound(F.array_distinct(F.concat(F.array_compact(long), numeric)), lambda full: F.concat(
            full, F.filter(years, lambda y: ~F.exists(full, lambda d: d.startswith(y)))))

    return bound(text, found)


def date_after(text: Column, phrase: str) -> Column:
    """ISO text of the numeric date that follows a phrase (a pattern)."""
    found = F.nullif(F.regexp_extract(text, rf"(?i)(?:{phrase})(\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}})", 1), F.lit(""))
    return bound(F.split(found, "[./]"), lambda p: F.when(p.isNotNull(), _iso(p[2], p[1].cast("int"), p[0])))


# Short month names next to the full ones.
SHORT_MONTHS = {
    "ian": 1, "feb": 2, "mar": 3, "apr": 4, "iun": 6, "iul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "noi": 11, "dec": 12,
}


FROM, UNTIL = r"din\s+([a-z.]+)\s+(\d{4})", r"pana(?:\s+in)?\s+([a-z.]+)\s+(\d{4})"


def period_start(text: Column) -> Column:
    """First day of the month after 'din'."""
    return bound(fold_marks(text), lambda folded: _month_start(folded, FROM))


def period_end(text: Column) -> Column:
    """Last day of the month before the one after 'până (în)'; null where that
    lies before the start."""
    ends = lambda start, end: F.when(start.isNull() | (end >= start), end)
    return bound(fold_marks(text), lambda folded: bound(F.struct(
        _month_start(folded, FROM).alias("start"), F.date_sub(_month_start(folded, UNTIL), 1).alias("end")), lambda p: ends(p["start"], p["end"])))


def _month_start(folded: Column, pattern: str) -> Column:
    numbers = {month: n for n, month in enumerate(MONTHS, 1)} | SHORT_MONTHS
    known = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    month = known[F.replace(F.regexp_extract(folded, _S + pattern, 1), F.lit("."))]
    year = F.nullif(F.regexp_extract(folded, _S + pattern, 2), F.lit("")).cast("int")
    return bound(F.struct(month.alias("month"), year.alias("year")), lambda p: F.when(
        p["month"].isNotNull() & p["year"].isNotNull(), F.make_date(p["year"], p["month"], F.lit(1))))
