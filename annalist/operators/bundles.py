"""Page bundles, timeline filters and look-ups by an old address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import dates as fd
from annalist.functions.text import clean
from annalist.operators.pages import parse, records
from annalist.operators.readmodels import CHOICES, count_choice

# Event types a composition timeline shows.
TIMELINE_EVENTS = (
    "legislature_start", "legislature_end", "government_designated", "government_invested", "government_ended",
    "no_confidence_motion", "confidence_vote", "coalition_change", "reshuffle",
)


def timeline_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*TIMELINE_EVENTS))


def registry_subset(rows: DataFrame, kind: str, positions: Sequence[int]) -> DataFrame:
    """Registry rows of a kind ('all' for any) at the given positions (none: any)."""
    kept = rows if kind == "all" else rows.where(F.col("kind") == kind)
    return kept.where(F.col("position").isin(*positions)) if positions else kept


def activity_from_rows(ballots: DataFrame, sponsors: DataFrame, history: DataFrame) -> DataFrame:
    """Activity of each member counted from detail rows."""
    votes = ballots.groupBy("member_id").agg(*[count_choice(F.col("choice"), c).alias(f"n_{c}") for c in CHOICES])
    proposals = sponsors.groupBy("member_id").agg(F.countDistinct("bill_id").alias("proposals"))
    terms = history.groupBy("member_id").agg(
        F.count(F.when(F.col("type") == "committee", 1)).alias("committees"), F.count(F.when(F.col("type") == "role", 1)).alias("roles"))
    joined = votes.join(proposals, "member_id", "full_outer").join(terms, "member_id", "full_outer")
    return joined.select("member_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in joined.columns if c != "member_id"])


def by_legacy_slug(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """Member behind each old slug(slug): the part before '-chamber-…' is a
    member's slug or its start up to a dash. The newest window wins, then the
    shorter slug. Members(id, slug, rank) are matched on each dash-prefix of
    their slug, an equi join."""
    base = F.regexp_replace("slug", r"(?i)-(deputies|senate)-[a-z0-9-]+$", "")
    old = wanted.select(F.col("slug").alias("legacy"), base.alias("base")).where((F.col("base") != "") & (F.col("base") != F.col("legacy")))
    parts = F.split("slug", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    keyed = members.select("id", "slug", "rank", F.explode(F.array_distinct(prefixes)).alias("base"))
    # equal bases are answered once
    best = keyed.groupBy("base").agg(F.max_by("id", F.struct("rank", -F.length("slug"), -F.col("id"))).alias("id"))
    return old.join(best, "base").select("legacy", "id")


def sections(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Bundle rows: {section: DataFrame(key, item, on)} as one long table."""
    out = None
    for name, rows in parts.items():
        part = rows.select(key, F.lit(name).alias("section"), F.col("item").cast("string").alias("item"), F.col("on").alias("on"))
        out = part if out is None else out.unionByName(part)
    return out


def member_sections(
    members: DataFrame, mandates: DataFrame, legislatures: DataFrame, memberships: DataFrame, affiliations: DataFrame, committees: DataFrame, roles: DataFrame,
    ballots: DataFrame, votes: DataFrame, sponsors: DataFrame, events: DataFrame,
) -> DataFrame:
    """Every member page as rows (person, section, item, on). A page is a
    person's: all members with one person key, a member without one alone. The
    selected window is the newest one with a mandate; its latest mandate, the
    latest membership during it, and the votes and sponsored bills of the window
    are sections of their own."""
    key = F.coalesce(F.concat(F.lit("p"), F.col("person_id").cast("string")), F.concat(F.lit("m"), F.col("id").cast("string")))
    people = members.select(F.col("id").alias("member_id"), key.alias("person"))
    w = legislatures.select(F.col("id").alias("legislature_id"), F.col("starts_on").alias("l_s"), F.col("ends_on").alias("l_e"))
    held = mandates.join(people, "member_id").join(w, "legislature_id")
    selected = held.groupBy("person").agg(F.max_by(F.struct("legislature_id", "l_s", "l_e"), "l_s").alias("w")).select("person", "w.*")
    chosen = held.drop("l_s", "l_e").join(selected, ["person", "legislature_id"])
    current = chosen.groupBy("person").agg(F.max_by(F.struct("id", "member_id", "starts_on", F.least("ends_on", "l_e").alias("until")), F.struct("starts_on", "id")).alias("m")).select("person", "m.*")
    terms = memberships.select("member_id", F.col("id").alias("term"), F.col("starts_on").alias("t_s"), F.col("ends_on").alias("t_e"))
    during = current.join(terms, "member_id").where((F.col("t_s") <= F.col("until")) & (F.col("t_e").isNull() | (F.col("t_e") >= F.col("starts_on"))))
    membership = during.groupBy("person").agg(F.max_by(F.struct("term", "t_s"), F.struct("t_s", "term")).alias("m")).select("person", "m.*")
    in_window = lambda day: (F.col(day) >= F.col("l_s")) & (F.col(day) < F.col("l_e"))
    days = votes.select(F.col("id").alias("vote_id"), "held_on")
    cast_rows = ballots.select("id", "vote_id", "member_id").join(people, "member_id").join(days, "vote_id").join(selected, "person").where(in_window("held_on"))
    steps = events.select("bill_id", "occurred_on").distinct()
    brought = sponsors.join(people, "member_id").select("person", "bill_id").distinct().join(selected, "person").join(steps, "bill_id").where(in_window("occurred_on")).select("person", "bill_id").distinct()
    dated = lambda rows: rows.join(people, "member_id").select("person", F.col("id").alias("item"), F.col("starts_on").alias("on"))
    none = F.lit(None).cast("date").alias("on")
    return sections({
        "related": people.select("person", F.col("member_id").alias("item"), none), "mandates": dated(mandates), "memberships": dated(memberships), "affiliations": dated(affiliations),
        "committees": dated(committees), "roles": dated(roles), "selected_legislature": selected.select("person", F.col("legislature_id").alias("item"), F.col("l_s").alias("on")),
        "mandate": current.select("person", F.col("id").alias("item"), F.col("starts_on").alias("on")), "membership": membership.select("person", F.col("term").alias("item"), F.col("t_s").alias("on")),
        "votes": cast_rows.select("person", F.col("id").alias("item"), F.col("held_on").alias("on")), "sponsored": brought.select("person", F.col("bill_id").alias("item"), none)}, "person")


def profiles(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profile pages to members(page_id, display_name, starts_on) and
    memberships(page_id, group_name, starts_on, ends_on), the name from the
    heading, the validation date from the text, periods from a table."""
    parsed = parse(pages, "blocks", "cells")
    heads = parsed.select("page_id", F.explode_outer("blocks").alias("b")).select("page_id", "b.*")
    date = fd.date_after(F.col("text"), r"data valid[ăa]rii:\s*")
    members = heads.groupBy("page_id").agg(
        F.min_by(F.when(F.col("kind") == "h1", clean(F.col("text"))), F.when(F.col("kind") == "h1", F.col("position"))).alias("display_name"),
        F.max(F.to_date(date)).alias("starts_on"))
    cells = parsed.select("page_id", F.explode("cells").alias("x")).select("page_id", "x.*")
    rows = records(cells, {"grp": "^(grup|formatiune)", "period": "^perioada"})
    memberships = rows.select("page_id", F.col("grp").alias("group_name"), fd.period_start(F.col("period")).alias("starts_on"), fd.period_end(F.col("period")).alias("ends_on"))
    return members, memberships
