"""Directories: composed filters, enrichment joins, keyset pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.intervals import in_year
from annalist.functions.text import fold, folded_key, like_literal
from annalist.operators.ranges import join_in_window, join_overlapping

SENTINEL_DATE = "0001-01-01"


@dataclass(frozen=True)
class DirectoryFilter:
    year: int | None = None
    month: int | None = None
    chamber: str | None = None
    legislature: str | None = None
    status: str | None = None
    text: str | None = None
    group: str | None = None
    # last (date, id) of the page before
    cursor: tuple[str, object] | None = field(default=None)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_text(text: str, *columns: Column) -> Column:
    """Case-insensitive substring of any column; wildcards are literal."""
    pattern = like_literal(text)
    return any_of([F.coalesce(c.ilike(pattern), F.lit(False)) for c in columns])


def before_cursor(on: Column, ident: Column, cursor: tuple[str, object]) -> Column:
    """Rows after the cursor in (date desc, id desc) order."""
    date = F.to_date(F.lit(cursor[0]))
    return (on < date) | ((on == date) & (ident < F.lit(cursor[1])))


def keyset_page(df: DataFrame, on: str, ident: str, limit: int, cursor: tuple[str, object] | None = None) -> DataFrame:
    """``limit`` + 1 rows after the cursor: the extra row tells there is more."""
    if cursor is not None:
        df = df.where(before_cursor(F.col(on), F.col(ident), cursor))
    return df.orderBy(F.desc_nulls_last(on), F.desc_nulls_last(ident)).limit(limit + 1)


def hot_counts(reactions: DataFrame, entity_type: str, reaction: str = "hot") -> DataFrame:
    """Reactions per entity."""
    return (
        reactions.where((F.col("entity_type") == entity_type) & (F.col("reaction") == reaction))
        .groupBy(F.col("entity_id"))
        .agg(F.count(F.lit(1)).alias("hot_count"))
    )


def facts_in_named_window(facts: DataFrame, windows: DataFrame, on: str, window_id: str) -> DataFrame:
    """Facts dated inside one named window; each fact at most once."""
    w = windows.where(F.col("id") == window_id).select(F.col("starts_on").alias("__ws"), F.col("ends_on").alias("__we"))
    return join_in_window(facts, w, on, "__ws", "__we").drop("__ws", "__we")


def with_group_or_party(facts_groups: DataFrame, groups: DataFrame, wanted: str) -> DataFrame:
    """Rows whose group, or whose group's party, is ``wanted``."""
    g = groups.select(F.col("id").alias("group_id"), "party_id")
    return facts_groups.join(g, "group_id", "left").where(
        (F.col("group_id") == wanted) | F.coalesce(F.col("party_id") == wanted, F.lit(False))
    )


def votes_with_group(votes: DataFrame, totals: DataFrame, groups: DataFrame, wanted: str) -> DataFrame:
    hit = with_group_or_party(totals.select("vote_id", "group_id"), groups, wanted)
    return votes.join(hit.select(F.col("vote_id").alias("id")), "id", "left_semi")


def bills_with_group(
    bills: DataFrame, on: str, sponsors: DataFrame, memberships: DataFrame, groups: DataFrame, wanted: str
) -> DataFrame:
    """Bills with a sponsor who was in the group on the bill's date."""
    member = with_group_or_party(
        memberships.select("member_id", "group_id", F.col("starts_on").alias("m_s"), F.col("ends_on").alias("m_e")), groups, wanted
    ).select("member_id", "m_s", "m_e").distinct()
    dated = bills.select(F.col("id").alias("bill_id"), F.col(on).alias("__on")).where(F.col("__on").isNotNull())
    probes = sponsors.select("bill_id", "member_id").join(dated, "bill_id")
    # distinct (member, date) pairs meet the member's terms, not every bill
    days = probes.select("member_id", F.col("__on").alias("d_s"), F.col("__on").alias("d_e")).distinct()
    hits = join_overlapping(days, member, ["member_id"], ("d_s", "d_e"), ("m_s", "m_e")).select(
        "member_id", F.col("d_s").alias("__on")
    ).distinct()
    found = probes.join(hits, ["member_id", "__on"], "left_semi").select(F.col("bill_id").alias("id"))
    return bills.join(found, "id", "left_semi")


def vote_directory(
    votes: DataFrame, bills: DataFrame, sources: DataFrame, reactions: DataFrame, windows: DataFrame,
    totals: DataFrame, groups: DataFrame, limit: int | None, flt: DirectoryFilter = DirectoryFilter(),
) -> DataFrame:
    """Votes with their bill, source and reaction count, newest first."""
    kept = votes
    simple = []
    if flt.year is not None:
        simple.append(in_year(F.col("held_on"), flt.year, flt.month))
    if flt.chamber:
        simple.append(F.col("chamber") == flt.chamber)
    if flt.cursor:
        simple.append(before_cursor(F.col("held_on"), F.col("id"), flt.cursor))
    kept = kept.where(all_of(simple))
    if flt.legislature:
        kept = facts_in_named_window(kept, windows, "held_on", flt.legislature)
    if flt.group:
        kept = votes_with_group(kept, totals, groups, flt.group)
    b = bills.select(F.col("id").alias("bill_id"), F.col("title").alias("bill_title"), F.to_json("identifiers").alias("bill_identifiers"))
    s = sources.select(F.col("id").alias("source_id"), "source_url", F.col("status").alias("source_status"))
    rows = (
        kept.join(b, "bill_id", "left").join(s, "source_id", "left")
        .join(hot_counts(reactions, "vote").withColumnRenamed("entity_id", "id"), "id", "left")
    )
    if flt.status:
        rows = rows.where(F.col("source_status") == flt.status)
    if flt.text:
        rows = rows.where(contains_text(flt.text, F.col("title"), F.col("bill_title"), F.col("bill_identifiers")))
    rows = rows.select("id", "held_on", "chamber", "title", "bill_id", "bill_title", "source_status",
                       F.coalesce("hot_count", F.lit(0)).cast("long").alias("hot_count"))
    return rows if limit is None else keyset_page(rows, "held_on", "id", limit)


def bill_directory(
    bills: DataFrame, summaries: DataFrame, sources: DataFrame, reactions: DataFrame, windows: DataFrame,
    sponsors: DataFrame, memberships: DataFrame, groups: DataFrame, limit: int | None, flt: DirectoryFilter = DirectoryFilter(),
) -> DataFrame:
    """Bills on their submission date, else the latest event, else a sentinel.
    The source is the first of the bill's sources."""
    sums = summaries.select(F.col("bill_id").alias("id"), "submitted_on", "latest_event_on", "vote_count")
    rows = bills.join(sums, "id", "left").withColumn(
        "sort_on", F.coalesce("submitted_on", "latest_event_on", F.to_date(F.lit(SENTINEL_DATE)))
    )
    simple = []
    if flt.year is not None:
        simple.append(in_year(F.col("sort_on"), flt.year, flt.month))
    if flt.chamber:
        simple.append(F.col("chamber_of_origin") == flt.chamber)
    if flt.text:
        simple.append(contains_text(flt.text, F.col("title"), F.to_json("identifiers")))
    if flt.cursor:
        simple.append(before_cursor(F.col("sort_on"), F.col("id"), flt.cursor))
    rows = rows.where(all_of(simple))
    if flt.legislature:
        rows = facts_in_named_window(rows, windows, "sort_on", flt.legislature)
    if flt.group:
        rows = bills_with_group(rows, "sort_on", sponsors, memberships, groups, flt.group)
    first_source = F.get(F.col("source_ids"), F.lit(0))
    s = sources.select(F.col("id").alias("__sid"), "source_url", F.col("status").alias("source_status"))
    rows = rows.join(s, first_source == F.col("__sid"), "left").join(
        hot_counts(reactions, "bill").withColumnRenamed("entity_id", "id"), "id", "left"
    )
    if flt.status:
        rows = rows.where(F.col("source_status") == flt.status)
    rows = rows.select(
        "id", "sort_on", "title", "chamber_of_origin", "submitted_on", "latest_event_on", "source_status",
        F.coalesce("vote_count", F.lit(0)).cast("long").alias("vote_count"),
        F.coalesce("hot_count", F.lit(0)).cast("long").alias("hot_count"),
    )
    return rows if limit is None else keyset_page(rows, "sort_on", "id", limit)


def month_top(events: DataFrame, at: str, keys: Sequence[str], as_of: str, k: int = 5) -> DataFrame:
    """Most frequent keys since the first of the month of ``as_of``; the keys
    break ties."""
    since = F.date_trunc("month", F.to_timestamp(F.lit(as_of)))
    present = all_of([F.col(key).isNotNull() for key in keys])
    return (
        events.where((F.col(at) >= since) & present)
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), *[F.asc(key) for key in keys]).limit(k)
    )


def titles_of(rows: DataFrame, dimensions: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Add the title of (entity_type, entity_id), the id where there is none.
    ``dimensions``: {type: (table, id column, title column)}."""
    tagged = None
    for kind, (df, ident, title) in dimensions.items():
        part = df.select(F.lit(kind).alias("entity_type"), F.col(ident).cast("string").alias("__id"), F.col(title).alias("__title"))
        tagged = part if tagged is None else tagged.unionByName(part)
    left = rows.withColumn("__id", F.col("entity_id").cast("string"))
    return left.join(tagged, ["entity_type", "__id"], "left").withColumn(
        "title", F.coalesce("__title", "__id")
    ).drop("__id", "__title")


def parse_group_filter(value: str | None) -> list[str]:
    return [part.strip() for part in (value or "").split(",") if part.strip()]


def group_condition(wanted: str, group_id: Column, party_id: Column, short_name: Column) -> Column:
    """Id of the group or party, or ``group-name:`` and a folded name."""
    if wanted.startswith("group-name:"):
        return folded_key(short_name) == wanted.removeprefix("group-name:")
    return (group_id == wanted) | F.coalesce(party_id == wanted, F.lit(False))


def member_directory(
    members: DataFrame, latest_mandates: DataFrame, latest_memberships: DataFrame, groups: DataFrame, parties: DataFrame,
    stats: dict[str, DataFrame] | None = None, index: DataFrame | None = None, chamber: str | None = None,
    legislature: str | None = None, text: str | None = None, group: str | None = None,
    sort: str = "name", limit: int | None = 500,
) -> DataFrame:
    """One row per person. ``latest_mandates``: one per person_key with member_id,
    chamber, legislature_id; ``latest_memberships``: one per member_id with
    group_id; ``stats``: {sort name: (person_key, value)}; ``index``: search
    index rows of members."""
    person = F.coalesce(F.concat(F.lit("p"), F.col("person_id").cast("string")), F.concat(F.lit("m"), F.col("id").cast("string")))
    g = groups.select(F.col("id").alias("group_id"), F.col("short_name").alias("g_short"), "party_id")
    p = parties.select(F.col("id").alias("party_id"), F.col("short_name").alias("p_short"))
    rows = (
        members.select(F.col("id").alias("member_id"), person.alias("person_key"), "display_name", "slug")
        .join(latest_mandates.select("person_key", "member_id", "chamber", "legislature_id"), ["person_key", "member_id"])
        .join(latest_memberships, "member_id", "left").join(g, "group_id", "left").join(p, "party_id", "left")
    )
    if chamber:
        rows = rows.where(F.col("chamber") == chamber)
    if legislature:
        rows = rows.where(F.col("legislature_id") == legislature)
    if text:
        pattern = like_literal(text.lower())
        label = fold(F.concat_ws(" ", "display_name", "slug", F.coalesce("g_short", F.lit("")), F.coalesce("p_short", F.lit(""))))
        hit = label.like(pattern)
        if index is not None:
            found = index.where((F.col("entity_type") == "member") & F.col("search_text").like(pattern)).select(
                F.col("entity_id").alias("__mid")).distinct().withColumn("__hit", F.lit(True))
            rows = rows.join(found, F.col("member_id").cast("string") == F.col("__mid"), "left").drop("__mid")
            hit = hit | F.coalesce(F.col("__hit"), F.lit(False))
        rows = rows.where(hit)
    wanted = parse_group_filter(group)
    if wanted:
        rows = rows.where(any_of([
            F.coalesce(group_condition(w, F.col("group_id"), F.col("party_id"), F.coalesce("p_short", "g_short")), F.lit(False))
            for w in wanted
        ]))
    order = [F.asc("display_name"), F.asc("member_id")]
    if stats and sort in stats:
        rows = rows.join(stats[sort], "person_key", "left").withColumn("stat", F.coalesce("value", F.lit(0)).cast("long"))
        order.insert(0, F.desc("stat"))
    else:
        rows = rows.withColumn("stat", F.lit(0).cast("long"))
    rows = rows.select("member_id", "person_key", "display_name", "chamber", "legislature_id", "group_id", "party_id", "stat")
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def groups_in_window(
    groups: DataFrame, memberships: DataFrame, mandates: DataFrame, legislature: str, chamber: str | None = None,
) -> DataFrame:
    """Groups with a member whose membership overlapped a mandate in the
    window, in the group's chamber."""
    kept = groups.where(F.col("chamber") == chamber) if chamber else groups
    g = kept.select(F.col("id").alias("group_id"), F.col("chamber").alias("g_chamber"))
    ms = memberships.select("member_id", "group_id", F.col("starts_on").alias("a_s"), F.col("ends_on").alias("a_e")).join(g, "group_id")
    mm = mandates.where(F.col("legislature_id") == legislature).select(
        "member_id", F.col("chamber").alias("g_chamber"), F.col("starts_on").alias("b_s"), F.col("ends_on").alias("b_e"))
    used = join_overlapping(ms, mm, ["member_id", "g_chamber"], ("a_s", "a_e"), ("b_s", "b_e")).select(
        F.col("group_id").alias("id")).distinct()
    return kept.join(used, "id", "left_semi")


# Declaration order of chambers and alignments.
CHAMBER_ORDER = ("senate", "deputies")
ALIGNMENT_ORDER = ("government", "support", "mixed", "opposition", "unaffiliated", "unknown")


def ordinal(value: Column, order: Sequence[str]) -> Column:
    """Position in a declared order; unlisted values come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), value), F.lit(0)), F.lit(len(order) + 1))
