"""Whole vote pages: one parse feeds votes, groups, members, totals and ballots.

Two forms: pages of the senate say the facts in a heading and a list and mark
choices by column; pages of the deputies say them in table rows and the page's
text, and name choices. What a page leaves out is null, never today's date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import classify as cl
from annalist.functions.identifiers import bill_id, canonical, find_identifiers, identifier_record
from annalist.functions.text import bound, capitalised, clean, fold_marks, slug
from annalist.functions.urls import query_param
from annalist.operators.pages import parse
from annalist.operators.sets import last_wins
from annalist.session import cut_lineage

# Sections and marks of the two page forms.
HEADING, TOTALS, PLENARY = "section-title", "total-votes", "plenary-votes"
SUBJECT = r"(?i)Subiect\s+vot"
ACTION = r"(?i)(?<![A-Za-z0-9_])(Adoptare|Respingere|Retrimitere|Procedur[ăa]|Amendament|Vot final)(?![A-Za-z0-9_])"
OFFICIAL = {"for_count": r"Pentru\s*\(DA\):", "against": r"Contra\s*\(NU\):", "abstention": r"Abtineri\s*\(AB\):", "present_not_voting": r"Nu au votat\s*\(-\):"}
LABELS = {"present": "prezenti", "for_count": "pentru", "against": "contra", "abstention": "abtineri", "present_not_voting": "prezentnuauvotat"}
GROUP_COLORS = (("psd", "#d71920"), ("pnl", "#f2c230"), ("usr", "#1d71b8"), ("aur", "#111827"), ("udmr", "#159447"), ("pace", "#7c3aed"))

CHOICES = {"for_count": "for", "against": "against", "abstention": "abstention", "present_not_voting": "present_not_voting"}


@dataclass(frozen=True)
class VoteTables:
    """votes (a row per page), groups, members and ballots of all pages, group
    totals (senate pages) and bills (deputies' pages)."""

    votes: DataFrame
    groups: DataFrame
    members: DataFrame
    totals: DataFrame
    ballots: DataFrame
    bills: DataFrame | None = None


def _none(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _key(text: Column) -> Column:
    return F.regexp_replace(fold_marks(text), "[^a-z0-9]+", "")


def count_in(text: Column) -> Column:
    """The first number of a text, spaces between digits left out; 0 without any."""
    return F.coalesce(_none(F.regexp_extract(F.regexp_replace(text, r"\s+", ""), r"(\d+)", 1)).cast("long"), F.lit(0))


def _first(items: Column, wanted) -> Column:
    return F.get(F.filter(items, wanted), F.lit(0))


def _opening(label: str):
    return lambda b: _key(b["text"]).startswith(label)


def _text(cells: Column, n: int) -> Column:
    return clean(F.coalesce(F.get(cells, F.lit(n))["text"], F.lit("")))


def _date(text: Column, pattern: str) -> Column:
    part = lambda g: F.regexp_extract(text, pattern, g)
    return F.to_date(F.try_to_timestamp(_none(F.concat_ws("-", part(3), part(2), part(1)))))


def _made(rows: DataFrame) -> DataFrame:
    """The same rows; a filter on them does not make their columns again below."""
    return rows.select(F.explode_outer(F.array(F.struct(*rows.columns))).alias("__made")).select("__made.*")


def group_short(name: Column) -> Column:
    """Short name of a senate group."""
    def of(folded):
        unaffiliated = folded.contains("neafilia") | folded.contains("fara apartenenta")
        pace = bound(F.regexp_replace(folded, "[^a-z0-9]+", ""), lambda key: (key == "pir") | key.contains("intairomania") | key.contains("pace"))
        return F.when(unaffiliated, "Neafiliați").when(pace, "PACE").otherwise(name)

    return bound(fold_marks(name), of)


def _colored(short: Column) -> Column:
    def of(key):
        color = F.lit("#64748b")
        for part, value in reversed(GROUP_COLORS):
            color = F.when(key.contains(part), value).otherwise(color)
        return color

    return bound(_key(short), of)


def senate_votes(pages: DataFrame) -> VoteTables:
    """pages(page_id, url, html) in the senate's form.

    A vote is named by the heading's bill code, else the title, with day, month
    and kind of vote; a heading without a date gives a null date and an empty day
    in the name. Members without an official number are named by their slug. A
    row needs both names. The count of those who did not vote is read from its
    own label."""
    parsed = cut_lineage(parse(pages, "blocks", "plain_rows").withColumnRenamed("plain_rows", "rows"))
    head = _first("blocks", lambda b: (b["kind"] == "h2") & b["section"].contains(HEADING))
    named = _first("blocks", lambda b: (b["kind"] == "h5") & b["section"].contains(PLENARY))["text"]
    items = F.filter("blocks", lambda b: (b["kind"] == "li") & b["section"].contains(TOTALS))
    tabs = F.array_sort(F.array_distinct(F.transform(F.filter("rows", lambda r: r["section"].contains(PLENARY)), lambda r: r["tab"])))
    text = F.coalesce(head["text"], F.lit(""))
    facts = parsed.select(
        "page_id", "rows",
        _none(F.regexp_extract(text, r"(L\d+/\d{4})", 1)).alias("code"),
        _date(text, r"(\d{2})/(\d{2})/(\d{4})").alias("held_on"),
        F.coalesce(F.try_element_at(head["lines"], F.lit(-1)), F.lit("unknown")).alias("vote_type"),
        _none(named).alias("named"),
        *[count_in(F.coalesce(_first(items, _opening(label))["text"], F.lit(""))).alias(n) for n, label in LABELS.items()],
        F.get(tabs, F.lit(0)).alias("group_tab"), F.get(tabs, F.lit(1)).alias("member_tab"),
    )
    kind = F.coalesce(_none(F.regexp_replace(fold_marks(clean(F.col("vote_type"))), r"^vot\s+", "")), F.lit("unknown"))
    title = F.coalesce("named", "code", F.lit("Senate vote"))
    about = F.concat_ws("-", F.coalesce("code", title), F.date_format("held_on", "MM-dd"), kind)
    votes = facts.withColumn("vote_id", F.concat(F.lit("vote-senate-"), slug(about)))
    rows = votes.select("page_id", "vote_id", "group_tab", "member_tab", F.explode("rows").alias("r")).withColumn(
        "cells", F.filter("r.cells", lambda c: ~c["header"])).withColumn("line", F.col("r.line"))
    grouped = lambda df: df.withColumn("short_name", group_short(F.col("name"))).withColumn("group_id", F.concat(F.lit("group-senate-"), slug(F.col("short_name"))))
    counted = grouped(_made(rows.where("r.tab = group_tab").select("page_id", "vote_id", "cells", _text(F.col("cells"), 0).alias("name"))).where("name <> ''"))
    totals = counted.select(
        "page_id", "vote_id", F.concat_ws("-", F.lit("gvt"), "vote_id", "group_id").alias("id"), "group_id",
        *[count_in(_text(F.col("cells"), n + 1)).alias(c) for n, c in enumerate(CHOICES)])
    seated = rows.where("r.tab = member_tab").select(
        "page_id", "vote_id", "line", "cells", _text(F.col("cells"), 0).alias("family"), _text(F.col("cells"), 1).alias("first_name"))
    voting = _made(seated).where("family <> '' AND first_name <> ''").select(
        "page_id", "vote_id", "line", "cells", "family", "first_name",
        F.coalesce(_none(_text(F.col("cells"), 2)), F.lit("unknown")).alias("name"),
        _none(F.regexp_extract(F.coalesce(F.get("cells", F.lit(0))["href"], F.lit("")), r"ParlamentarID=([^&']+)", 1)).alias("source_key"))
    voting = grouped(voting).withColumn("last_name", capitalised(F.col("family"))).withColumn("display_name", F.concat_ws(" ", "first_name", "last_name"))
    voting = voting.withColumn("member_id", F.coalesce(F.concat(F.lit("member-senate-"), "source_key"), F.concat(F.lit("member-"), slug(F.col("display_name")))))
    ballots = voting.select(
        "page_id", "vote_id", F.concat_ws("-", F.lit("iv"), "vote_id", "member_id").alias("id"), "member_id", "group_id",
        cl.choice_from_marks(*[_text(F.col("cells"), n) for n in (3, 4, 5, 6)]).alias("choice"), _none(_text(F.col("cells"), 7)).alias("method"))
    members = last_wins(voting.select("page_id", "member_id", "line", slug(F.col("display_name")).alias("slug"), "first_name", "last_name", "display_name", "source_key"),
                        ["page_id", "member_id"], ["line"]).drop("line")
    groups = counted.select("page_id", "group_id", "short_name", "name").unionByName(voting.select("page_id", "group_id", "short_name", "name"))
    groups = groups.groupBy("page_id", "group_id").agg(F.min("short_name").alias("short_name"), F.min("name").alias("name")).withColumn("color", _colored(F.col("short_name")))
    shown = F.when(F.col("code").isNotNull(), F.concat("code", F.lit(" — "), "vote_type")).otherwise(title)
    votes = votes.select("page_id", "vote_id", F.concat(F.lit("bill-"), slug(F.col("code"))).alias("bill_id"), shown.alias("title"), "held_on", "vote_type", *LABELS)
    return VoteTables(votes, groups, members, totals, ballots)


def deputies_group(label: Column) -> Column:
    bare = F.trim(F.regexp_replace(label, r"(?i)\(afiliat\)", ""))
    named = lambda text, key: F.when(key == "", F.lit(None)).when(text.rlike("(?i)neafili"), "group-deputies-unaffiliated").when(
        text.rlike("(?i)minorit"), "group-deputies-minoritati").when(text.rlike(r"(?i)^SOS(?![A-Za-z0-9_])"), "group-deputies-sos-ro").otherwise(
        F.concat(F.lit("group-deputies-"), key))
    return bound(bare, lambda text: bound(slug(text), lambda key: named(text, key)))


def deputies_votes(pages: DataFrame) -> VoteTables:
    """pages(page_id, url, html) in the deputies' form.

    A ballot is a row with a running number, a profile link, a name and a choice
    that is known. Warnings: a joint sitting (its rows are not read), no rows, no
    subject, and counts of the page that differ from its rows. Status: parsed
    without warnings, partial with rows, else failed."""
    parsed = cut_lineage(parse(pages, "blocks", "rows", "text"))
    every = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r["cells"], lambda c: c["text"]), " ")), " ")
    whole = lambda text, word: text.rlike(rf"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")
    joint = bound(every, lambda text: whole(text, "Parlamentar") & text.rlike("(?i)Camera Deputat") & whole(text, "Senat"))
    body = lambda r: F.filter(r["cells"], lambda c: ~c["header"])
    subject = _first("rows", lambda r: F.coalesce(F.get(body(r), F.lit(0))["text"], F.lit("")).rlike(SUBJECT))
    official = [_none(F.regexp_extract("text", rf"(?is){mark}.*?(?<![A-Za-z0-9_])(\d+)(?![A-Za-z0-9_])", 1)).cast("long").alias(f"official_{n}") for n, mark in OFFICIAL.items()]
    facts = parsed.select(
        "page_id", "url", "rows", _date(F.col("text"), r"(\d{2})[./-](\d{2})[./-](\d{4})").alias("held_on"), joint.alias("joint"),
        F.get(body(subject), F.lit(1)).alias("cell"), _first("blocks", lambda b: b["kind"] == "title")["text"].alias("page_title"), *official,
        F.concat(F.lit("vote-deputies-"), slug(F.col("url"))).alias("vote_id"))
    rows = facts.where(~F.col("joint")).select("page_id", "vote_id", F.explode("rows").alias("r")).select(
        "page_id", "vote_id", F.col("r.tab").alias("tab"), F.col("r.line").alias("line"), F.filter("r.cells", lambda c: ~c["header"]).alias("cells"))
    profile = _first("cells", lambda c: c["href"].contains("structura2015.mp"))["href"]
    read = rows.select("page_id", "vote_id", "tab", "line", "cells", query_param(profile, "idm").alias("source_key"), _text(F.col("cells"), 0).alias("number"), _text(F.col("cells"), 1).alias("name"),
                       _text(F.col("cells"), 3).alias("said"))
    listed = _made(read).where(r"number RLIKE '^\\d+\\.$' AND source_key RLIKE '^\\d+$' AND name <> '' AND said <> ''")
    voting = _made(listed.select("*", cl.choice(F.col("said")).alias("choice"))).where("choice <> 'unknown'").withColumn("group_id", deputies_group(_text(F.col("cells"), 2)))
    voting = voting.withColumn("member_id", F.concat(F.lit("member-deputies-"), "source_key")).withColumn("display_name", capitalised(F.col("name")))
    ballots = voting.select("page_id", "vote_id", F.concat_ws("-", F.lit("iv"), "vote_id", "member_id").alias("id"), "member_id", "group_id", "choice")
    names = F.split("display_name", " ")
    front = F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), " ")
    members = last_wins(voting.select("page_id", "member_id", "tab", "line", slug(F.col("display_name")).alias("slug"), F.coalesce(_none(front), "display_name").alias("first_name"),
                                      F.element_at(names, -1).alias("last_name"), "display_name", "source_key"), ["page_id", "member_id"], ["tab", "line"]).drop("tab", "line")
    groups = voting.where("group_id IS NOT NULL").select("page_id", "group_id").distinct()
    tally = ballots.groupBy("page_id").agg(F.count(F.lit(1)).alias("present"), *[F.count_if(F.col("choice") == c).alias(n) for n, c in CHOICES.items()])
    found = facts.drop("rows").join(tally, "page_id", "left").na.fill(0, ["present", *CHOICES])
    said, bold = clean(F.col("cell.text")), clean(F.col("cell.bold"))
    told = F.coalesce(said, F.lit("")) != ""
    action = _none(F.regexp_extract(clean(F.col("cell.rest")), ACTION, 1))
    identifiers = find_identifiers(F.concat_ws(" ", said, bold))
    address = F.when(F.col("cell.href").contains("upl_pck2015.proiect"), F.col("cell.href"))
    # bound here, as each is used several times
    found = found.select("*", told.alias("told"), said.alias("said"), bold.alias("bold"), action.alias("action"), identifiers.alias("ids"), address.alias("address"),
                         F.when(address.isNotNull(), F.col("cell.link")).alias("linked"))
    tail = F.when(F.col("action").isNotNull() & ~F.col("bold").contains(F.col("action")), F.col("action"))
    title = F.coalesce(_none(clean(F.concat_ws(" - ", _none(F.col("bold")), tail))), F.substr("said", F.lit(1), F.lit(180)))
    rest = F.col("said")
    for part in ("bold", "action", "linked"):
        cut = F.expr(f"overlay(__t PLACING ' ' FROM locate({part}, __t) FOR length({part}))")
        found = found.withColumn("__t", rest).withColumn("__t", F.when(F.expr(f"coalesce({part}, '') <> '' AND locate({part}, __t) > 0"), cut).otherwise(F.col("__t")))
        rest = F.col("__t")
    bare = clean(F.regexp_replace(F.regexp_replace(rest, r"^\s*[-–—]\s*", ""), r"(?i)\s*[-–—]\s*lege\s+(?:ordinar[ăa]|organic[ăa])\s*$", ""))
    chosen = canonical(F.col("ids"))
    bill = F.when(F.col("told"), F.coalesce(bill_id(chosen["value"]), F.concat(F.lit("bill-deputies-"), slug(F.col("address")))))
    differs = F.lit(False)
    for n in CHOICES:
        differs = differs | (F.col(n) != F.col(f"official_{n}"))
    warnings = F.array_compact(F.array(
        F.when(F.col("joint"), "joint sitting"), F.when(F.col("present") == 0, "no ballots"), F.when(~F.col("told"), "no subject"),
        F.when((F.col("present") > 0) & F.coalesce(differs, F.lit(False)), "counts differ")))
    found = found.withColumn("bill_id", bill).withColumn("warnings", warnings).withColumn("bill_title", F.coalesce(_none(bare), "said"))
    status = F.when(F.col("present") == 0, "failed").when(F.size("warnings") > 0, "partial").otherwise("parsed")
    votes = found.select("page_id", "vote_id", "bill_id", F.when(F.col("told"), title).otherwise(F.coalesce(_none(F.col("page_title")), F.lit("Chamber nominal vote"))).alias("title"),
                         "held_on", "present", *CHOICES, status.alias("status"), "warnings")
    billed = _made(found.select("page_id", "bill_id", F.col("bill_title").alias("title"), "ids")).where("bill_id IS NOT NULL")
    bills = billed.select("page_id", "bill_id", "title", identifier_record(F.col("ids")).alias("identifiers"))
    return VoteTables(votes, groups, members, ballots.limit(0), ballots, bills)
