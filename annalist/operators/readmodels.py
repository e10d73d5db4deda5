"""Read models: summaries rebuilt from the facts.

Each side is aggregated on its own key before any join, so nothing fans out and
a popular key is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import fold
from annalist.operators.asof import best_per_key
from annalist.operators.ranges import join_in_window, join_overlapping

CHOICES = ("for", "against", "abstention", "present_not_voting", "absent", "unknown")


def count_choice(choice: Column, value: str) -> Column:
    return F.count(F.when(choice == value, F.lit(1)))


def worst_status(status: Column) -> Column:
    """failed over partial over parsed; parsed where there is no source."""
    return (
        F.when(status == "failed", "failed").when(status == "partial", "partial").otherwise("parsed")
    )


def bill_summary(bills: DataFrame, events: DataFrame, votes: DataFrame, sources: DataFrame) -> DataFrame:
    """bills(id, source_id), events(bill_id, occurred_on), votes(id, bill_id),
    sources(id, status)."""
    dated = events.groupBy("bill_id").agg(
        F.min("occurred_on").alias("submitted_on"), F.max("occurred_on").alias("latest_event_on")
    )
    counted = votes.where(F.col("bill_id").isNotNull()).groupBy("bill_id").agg(F.count("id").alias("vote_count"))
    status = sources.select(F.col("id").alias("source_id"), "status")
    return (
        bills.select(F.col("id").alias("bill_id"), "source_id")
        .join(dated, "bill_id", "left")
        .join(counted, "bill_id", "left")
        .join(status, "source_id", "left")
        .select(
            "bill_id", "submitted_on", "latest_event_on",
            F.coalesce("vote_count", F.lit(0)).cast("long").alias("vote_count"),
            worst_status(F.col("status")).alias("source_status"),
        )
    )


def vote_coverage(votes: DataFrame, ballots: DataFrame, totals: DataFrame, sources: DataFrame) -> DataFrame:
    """How much is known of each vote: ballots, group totals, a result, or only
    a source."""
    nominal = ballots.groupBy("vote_id").agg(F.count("id").alias("nominal_votes"))
    grouped = totals.groupBy("vote_id").agg(F.count("id").alias("group_totals"))
    status = sources.select(F.col("id").alias("source_id"), "status")
    counts = ["present", "for_count", "against", "abstention", "present_not_voting"]
    any_result = F.lit(False)
    for name in counts:
        any_result = any_result | (F.coalesce(F.col(name), F.lit(0)) > 0)
    return (
        votes.select(F.col("id").alias("vote_id"), "source_id", *counts)
        .join(nominal, "vote_id", "left")
        .join(grouped, "vote_id", "left")
        .join(status, "source_id", "left")
        .select(
            "vote_id",
            F.when(F.col("nominal_votes") > 0, "nominal")
            .when(F.col("group_totals") > 0, "group_totals")
            .when(any_result, "result_only")
            .otherwise("source_only")
            .alias("coverage_level"),
            F.coalesce("nominal_votes", F.lit(0)).cast("long").alias("nominal_votes"),
            F.coalesce("group_totals", F.lit(0)).cast("long").alias("group_totals"),
            F.coalesce("status", F.lit("partial")).alias("source_status"),
        )
    )


def proposals_by_window(sponsors: DataFrame, events: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct bills per (member, window). Events shrink to one row per (bill,
    window) first, so sponsors of a busy bill do not meet each of its events."""
    w = windows.select(F.col("id").alias("legislature_id"), F.col("starts_on").alias("w_s"), F.col("ends_on").alias("w_e"))
    dated = (
        join_in_window(events.select("bill_id", "occurred_on"), w, "occurred_on", "w_s", "w_e")
        .groupBy("bill_id", "legislature_id")
        .agg(F.min("occurred_on").alias("first_on"), F.max("occurred_on").alias("last_on"))
    )
    return (
        sponsors.select("member_id", "bill_id")
        .join(dated, "bill_id")
        .groupBy("member_id", "legislature_id")
        .agg(
            F.countDistinct("bill_id").alias("proposals"),
            F.min("first_on").alias("first_proposal_on"),
            F.max("last_on").alias("last_proposal_on"),
        )
    )


def terms_by_window(terms: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    """Terms(id, member_id, chamber, starts_on, ends_on) that touch each window."""
    w = windows.select(F.col("id").alias("legislature_id"), F.col("starts_on").alias("w_s"), F.col("ends_on").alias("w_e"))
    slim = terms.select("id", "member_id", "chamber", "starts_on", "ends_on")
    return (
        join_overlapping(slim, w, [], ("starts_on", "ends_on"), ("w_s", "w_e"), b_half_open=True)
        .groupBy("member_id", "legislature_id", "chamber")
        .agg(F.countDistinct("id").alias(name))
    )


def member_activity(
    mandates: DataFrame, members: DataFrame, windows: DataFrame, votes: DataFrame, ballots: DataFrame,
    sponsors: DataFrame, events: DataFrame, committees: DataFrame, roles: DataFrame,
) -> DataFrame:
    """Counts per (member, window, chamber). The first and last dates are those
    of the chamber's votes in the window, present or not; two mandates in one
    (member, window, chamber) count once."""
    w = windows.select(F.col("id").alias("legislature_id"), F.col("starts_on").alias("w_s"), F.col("ends_on").alias("w_e"))
    base = (
        mandates.select("member_id", "legislature_id", "chamber").distinct()
        .join(members.select(F.col("id").alias("member_id"), "person_id"), "member_id")
        .join(windows.select(F.col("id").alias("legislature_id")), "legislature_id", "left_semi")
    )
    dated = join_in_window(votes.select(F.col("id").alias("vote_id"), "chamber", "held_on"), w, "held_on", "w_s", "w_e")
    span = dated.groupBy("legislature_id", "chamber").agg(
        F.min("held_on").alias("first_vote_on"), F.max("held_on").alias("last_vote_on")
    )
    names = {"for": "votes_for", "against": "votes_against", "abstention": "abstentions"}
    counts = (
        ballots.select("vote_id", "member_id", "choice")
        .join(dated.select("vote_id", "chamber", "legislature_id"), "vote_id")
        .groupBy("member_id", "legislature_id", "chamber")
        .agg(*[count_choice(F.col("choice"), c).alias(names.get(c, c)) for c in CHOICES])
    )
    key = ["member_id", "legislature_id", "chamber"]
    measures = [names.get(c, c) for c in CHOICES] + ["proposals", "committees", "roles"]
    return (
        base.join(counts, key, "left")
        .join(proposals_by_window(sponsors, events, windows), ["member_id", "legislature_id"], "left")
        .join(terms_by_window(committees, windows, "committees"), key, "left")
        .join(terms_by_window(roles, windows, "roles"), key, "left")
        .join(span, ["legislature_id", "chamber"], "left")
        .select(
            F.concat_ws("-", F.lit("member-activity"), "member_id", "legislature_id", "chamber").alias("id"),
            *key, "person_id",
            *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in measures],
            F.least("first_vote_on", "first_proposal_on").alias("first_activity_on"),
            F.greatest("last_vote_on", "last_proposal_on").alias("last_activity_on"),
        )
    )


INDEX_COLUMNS = ["id", "entity_type", "entity_id", "title", "subtitle", "search_text", "chamber", "legislature_id", "source_date"]


def _index_rows(df: DataFrame, kind: str) -> DataFrame:
    shown = df.select(
        F.concat(F.lit(kind + "-"), F.col("entity_id").cast("string")).alias("id"),
        F.lit(kind).alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"),
        "title", "subtitle", fold(F.col("search")).alias("search_text"),
        *[c for c in ("chamber", "legislature_id", "source_date") if c in df.columns],
    )
    return shown


def search_index(
    members: DataFrame, mandates: DataFrame, memberships: DataFrame, groups: DataFrame, parties: DataFrame,
    bills: DataFrame, summaries: DataFrame, votes: DataFrame, windows: DataFrame,
) -> DataFrame:
    """One schema over members, bills, votes and parties; one row per id, the
    newest first. Members without a mandate are left out."""
    mandate = best_per_key(mandates, ["member_id"], [F.col("starts_on"), F.col("id")],
                           ["chamber", "legislature_id", "starts_on"])
    membership = best_per_key(memberships, ["member_id"], [F.col("starts_on"), F.col("id")], ["group_id"])
    g = groups.select(F.col("id").alias("group_id"), F.col("short_name").alias("g_short"), F.col("name").alias("g_name"), "party_id")
    p = parties.select(F.col("id").alias("party_id"), F.col("short_name").alias("p_short"), F.col("name").alias("p_name"))
    w = windows.select(F.col("id").alias("legislature_id"), F.col("starts_on").alias("w_s"), F.col("ends_on").alias("w_e"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    member_rows = (
        members.select(F.col("id").alias("member_id"), "display_name", "first_name", "last_name", "slug")
        .join(mandate, "member_id").join(membership, "member_id", "left")
        .join(g, "group_id", "left").join(p, "party_id", "left")
        .select(
            F.col("member_id").alias("entity_id"), F.col("display_name").alias("title"),
            F.coalesce("g_short", "chamber").alias("subtitle"),
            F.concat_ws(" ", "display_name", "first_name", "last_name", "slug", blank("g_short"), blank("g_name"),
                        blank("p_short"), blank("p_name")).alias("search"),
            "chamber", "legislature_id", F.col("starts_on").alias("source_date"),
        )
    )
    dated_bills = bills.join(summaries.select(F.col("bill_id").alias("id"), "submitted_on"), "id", "left")
    bill_rows = join_in_window(dated_bills, w, "submitted_on", "w_s", "w_e", how="left").select(
        F.col("id").alias("entity_id"), "title",
        F.coalesce(F.col("identifiers")["deputies"], F.col("identifiers")["senate"], "status").alias("subtitle"),
        F.concat_ws(" ", "title", "slug", F.to_json("identifiers"), "status").alias("search"),
        F.when(F.col("chamber_of_origin").isin("senate", "deputies"), F.col("chamber_of_origin")).alias("chamber"),
        "legislature_id", F.col("submitted_on").alias("source_date"),
    )
    titled = votes.join(
        bills.select(F.col("id").alias("bill_id"), F.col("title").alias("b_title"), F.to_json("identifiers").alias("b_ids")),
        "bill_id", "left",
    )
    vote_rows = join_in_window(titled, w, "held_on", "w_s", "w_e", how="left").select(
        F.col("id").alias("entity_id"), "title", F.col("vote_type").alias("subtitle"),
        F.concat_ws(" ", "title", F.col("id").cast("string"), blank("b_title"), blank("b_ids")).alias("search"),
        "chamber", "legislature_id", F.col("held_on").alias("source_date"),
    )
    party_rows = parties.select(
        F.col("id").alias("entity_id"), F.col("short_name").alias("title"), F.col("name").alias("subtitle"),
        F.concat_ws(" ", "short_name", "name", "slug").alias("search"),
    )
    everything = _index_rows(member_rows, "member")
    for rows, kind in ((bill_rows, "bill"), (vote_rows, "vote"), (party_rows, "party")):
        everything = everything.unionByName(_index_rows(rows, kind), allowMissingColumns=True)
    # newest per id; the text breaks ties, an absent date loses
    return best_per_key(
        everything, ["id"],
        [F.coalesce("source_date", F.to_date(F.lit("0001-01-01"))), F.col("search_text")],
        [c for c in INDEX_COLUMNS if c != "id"],
    ).select(*INDEX_COLUMNS)


def row_counts(**models: DataFrame) -> DataFrame:
    """One row per model with its row count."""
    parts = [df.groupBy().agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("model"), "row_count")
             for name, df in models.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
