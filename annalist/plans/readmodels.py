"""Queries over the read models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators import readmodels as rm
from annalist.plans.bindings import Tables
from annalist.plans.registry import query


def with_identifiers(bills: DataFrame) -> DataFrame:
    """Bills with their identifiers as one map, absent ones left out."""
    entries = F.filter(
        F.array(
            F.struct(F.lit("senate").alias("key"), F.col("senate_identifier").alias("value")),
            F.struct(F.lit("deputies").alias("key"), F.col("deputies_identifier").alias("value")),
        ),
        lambda e: e["value"].isNotNull(),
    )
    return bills.withColumn("identifiers", F.map_from_entries(entries))


def summaries(t: Tables) -> DataFrame:
    return rm.bill_summary(t.bills, t.bill_events, t.votes, t.sources)


def coverage(t: Tables) -> DataFrame:
    return rm.vote_coverage(t.votes, t.ballots, t.group_totals, t.sources)


def activity(t: Tables) -> DataFrame:
    return rm.member_activity(t.mandates, t.members, t.legislatures, t.votes, t.ballots, t.sponsors,
                              t.bill_events, t.committee_terms, t.role_terms)


def index(t: Tables) -> DataFrame:
    return rm.search_index(
        t.members, t.mandates, t.memberships, t.party_groups, t.parties, with_identifiers(t.bills), summaries(t),
        t.votes.withColumn("vote_type", F.lit("nominal")), t.legislatures,
    )


SUMMARY_SQL = """
    SELECT b.id AS bill_id, e.submitted_on, e.latest_event_on, coalesce(v.n, 0) AS vote_count,
      CASE WHEN s.status IN ('failed', 'partial') THEN s.status ELSE 'parsed' END AS source_status
    FROM bills b
    LEFT JOIN (SELECT bill_id, min(occurred_on) AS submitted_on, max(occurred_on) AS latest_event_on
               FROM bill_events GROUP BY bill_id) e ON e.bill_id = b.id
    LEFT JOIN (SELECT bill_id, count(DISTINCT id) AS n FROM votes GROUP BY bill_id) v ON v.bill_id = b.id
    LEFT JOIN sources s ON s.id = b.source_id"""

COVERAGE_SQL = """
    SELECT v.id AS vote_id,
      CASE WHEN n.n > 0 THEN 'nominal' WHEN g.n > 0 THEN 'group_totals'
        WHEN v.present > 0 OR v.for_count > 0 OR v.against > 0 OR v.abstention > 0 OR v.present_not_voting > 0
          THEN 'result_only' ELSE 'source_only' END AS coverage_level,
      coalesce(n.n, 0) AS nominal_votes, coalesce(g.n, 0) AS group_totals,
      coalesce(s.status, 'partial') AS source_status
    FROM votes v
    LEFT JOIN (SELECT vote_id, count(*) AS n FROM ballots GROUP BY vote_id) n ON n.vote_id = v.id
    LEFT JOIN (SELECT vote_id, count(*) AS n FROM group_totals GROUP BY vote_id) g ON g.vote_id = v.id
    LEFT JOIN sources s ON s.id = v.source_id"""

ACTIVITY_SQL = """
  SELECT 'member-activity-' || b.member_id || '-' || b.legislature_id || '-' || b.chamber AS id, b.member_id,
    b.legislature_id, b.chamber, m.person_id,
    coalesce(vc.f, 0) AS votes_for, coalesce(vc.a, 0) AS votes_against, coalesce(vc.ab, 0) AS abstentions,
    coalesce(vc.p, 0) AS present_not_voting, coalesce(vc.abs, 0) AS absent, coalesce(vc.u, 0) AS unknown,
    coalesce(pc.n, 0) AS proposals, coalesce(cc.n, 0) AS committees, coalesce(rc.n, 0) AS roles,
    least(sp.lo, pc.lo) AS first_activity_on, greatest(sp.hi, pc.hi) AS last_activity_on
  FROM (SELECT DISTINCT member_id, legislature_id, chamber FROM mandates) b
  JOIN members m ON m.id = b.member_id
  JOIN legislatures l ON l.id = b.legislature_id
  LEFT JOIN (SELECT l.id AS legislature_id, v.chamber, min(held_on) AS lo, max(held_on) AS hi FROM votes v
      JOIN legislatures l ON held_on >= starts_on AND held_on < ends_on GROUP BY ALL) sp
    ON sp.legislature_id = b.legislature_id AND sp.chamber = b.chamber
  LEFT JOIN (SELECT i.member_id, l.id AS legislature_id, v.chamber,
      count(*) FILTER (choice = 'for') AS f, count(*) FILTER (choice = 'against') AS a,
      count(*) FILTER (choice = 'abstention') AS ab, count(*) FILTER (choice = 'present_not_voting') AS p,
      count(*) FILTER (choice = 'absent') AS abs, count(*) FILTER (choice = 'unknown') AS u
      FROM ballots i JOIN votes v ON v.id = i.vote_id
      JOIN legislatures l ON held_on >= starts_on AND held_on < ends_on GROUP BY ALL) vc
    ON vc.member_id = b.member_id AND vc.legislature_id = b.legislature_id AND vc.chamber = b.chamber
  LEFT JOIN (SELECT s.member_id, l.id AS legislature_id, count(DISTINCT e.bill_id) AS n,
      min(occurred_on) AS lo, max(occurred_on) AS hi
      FROM sponsors s JOIN bill_events e ON e.bill_id = s.bill_id
      JOIN legislatures l ON occurred_on >= starts_on AND occurred_on < ends_on GROUP BY ALL) pc
    ON pc.member_id = b.member_id AND pc.legislature_id = b.legislature_id
  LEFT JOIN (SELECT c.member_id, l.id AS legislature_id, c.chamber, count(DISTINCT c.id) AS n FROM committee_terms c
      JOIN legislatures l ON c.starts_on < l.ends_on AND (c.ends_on IS NULL OR c.ends_on >= l.starts_on) GROUP BY ALL) cc
    ON cc.member_id = b.member_id AND cc.legislature_id = b.legislature_id AND cc.chamber = b.chamber
  LEFT JOIN (SELECT c.member_id, l.id AS legislature_id, c.chamber, count(DISTINCT c.id) AS n FROM role_terms c
      JOIN legislatures l ON c.starts_on < l.ends_on AND (c.ends_on IS NULL OR c.ends_on >= l.starts_on) GROUP BY ALL) rc
    ON rc.member_id = b.member_id AND rc.legislature_id = b.legislature_id AND rc.chamber = b.chamber"""

FOLD_SQL = "lower(translate({x}, 'ăâîșşțţĂÂÎȘŞȚŢ', 'aaissttAAISSTT'))"
IDS_SQL = """('{{' || concat_ws(',', '"senate":"' || {b}.senate_identifier || '"', '"deputies":"' || {b}.deputies_identifier || '"') || '}}')"""

INDEX_SQL = f"""
  SELECT 'member-' || m.id AS id, 'member' AS entity_type, CAST(m.id AS VARCHAR) AS entity_id, m.display_name AS title,
    coalesce(g.short_name, mm.chamber) AS subtitle,
    {FOLD_SQL.format(x="m.display_name || ' ' || m.first_name || ' ' || m.last_name || ' ' || m.slug || ' ' || coalesce(g.short_name, '') || ' ' || coalesce(g.name, '') || ' ' || coalesce(p.short_name, '') || ' ' || coalesce(p.name, '')")} AS search_text,
    mm.chamber, mm.legislature_id, mm.starts_on AS source_date
  FROM members m
  JOIN (SELECT * FROM mandates QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY starts_on DESC, id DESC) = 1) mm
    ON mm.member_id = m.id
  LEFT JOIN (SELECT * FROM memberships QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY starts_on DESC, id DESC) = 1) ms
    ON ms.member_id = m.id
  LEFT JOIN party_groups g ON g.id = ms.group_id LEFT JOIN parties p ON p.id = g.party_id
  UNION ALL
  SELECT 'bill-' || b.id, 'bill', CAST(b.id AS VARCHAR), b.title, coalesce(b.deputies_identifier, b.senate_identifier, b.status),
    {FOLD_SQL.format(x="b.title || ' ' || b.slug || ' ' || " + IDS_SQL.format(b='b') + " || ' ' || b.status")},
    CASE WHEN b.chamber_of_origin IN ('senate', 'deputies') THEN b.chamber_of_origin END, l.id, s.submitted_on
  FROM bills b LEFT JOIN (SELECT bill_id, min(occurred_on) AS submitted_on FROM bill_events GROUP BY bill_id) s ON s.bill_id = b.id
  LEFT JOIN legislatures l ON s.submitted_on >= l.starts_on AND s.submitted_on < l.ends_on
  UNION ALL
  SELECT 'vote-' || v.id, 'vote', CAST(v.id AS VARCHAR), v.title, 'nominal',
    {FOLD_SQL.format(x="v.title || ' ' || v.id || ' ' || coalesce(b.title, '') || ' ' || CASE WHEN b.id IS NULL THEN '' ELSE " + IDS_SQL.format(b='b') + " END")},
    v.chamber, l.id, v.held_on
  FROM votes v LEFT JOIN bills b ON b.id = v.bill_id
  LEFT JOIN legislatures l ON v.held_on >= l.starts_on AND v.held_on < l.ends_on
  UNION ALL
  SELECT 'party-' || p.id, 'party', p.id, p.short_name, p.name, {FOLD_SQL.format(x="p.short_name || ' ' || p.name || ' ' || p.slug")},
    NULL, NULL, NULL FROM parties p"""


@query("g1_bill_summary", "G1 A1", SUMMARY_SQL)
def _(t):
    return summaries(t)


@query("g2_vote_coverage", "G2", COVERAGE_SQL)
def _(t):
    return coverage(t)


@query("g3_member_activity", "G3 G4 G5 J11 J12 F17 F43", ACTIVITY_SQL)
def _(t):
    return activity(t)


@query("s1_search_index", "S1 J5 J10 W2 F2", INDEX_SQL)
def _(t):
    return index(t)


@query("g6_model_row_counts", "G6", f"""
    SELECT 'bills' AS model, count(*) AS row_count FROM ({SUMMARY_SQL})
    UNION ALL SELECT 'votes', count(*) FROM ({COVERAGE_SQL})
    UNION ALL SELECT 'activity', count(*) FROM ({ACTIVITY_SQL})""")
def _(t):
    return rm.row_counts(bills=summaries(t), votes=coverage(t), activity=activity(t))


@query("g26_coverage_levels_by_window", "G26 J10", f"""
    SELECT l.id AS legislature_id, count(*) AS votes, count(*) FILTER (c.coverage_level = 'nominal') AS nominal,
      count(*) FILTER (c.coverage_level = 'group_totals') AS group_totals,
      count(*) FILTER (c.coverage_level = 'result_only') AS result_only,
      count(*) FILTER (c.coverage_level = 'source_only') AS source_only
    FROM votes v JOIN ({COVERAGE_SQL}) c ON c.vote_id = v.id
    JOIN legislatures l ON v.held_on >= l.starts_on AND v.held_on < l.ends_on GROUP BY l.id""")
def _(t):
    w = t.legislatures.select(F.col("id").alias("legislature_id"), "starts_on", "ends_on")
    dated = rm.join_in_window(t.votes.select(F.col("id").alias("vote_id"), "held_on"), w, "held_on", "starts_on", "ends_on")
    levels = ["nominal", "group_totals", "result_only", "source_only"]
    return (
        dated.join(coverage(t).select("vote_id", "coverage_level"), "vote_id")
        .groupBy("legislature_id")
        .agg(F.count(F.lit(1)).alias("votes"),
             *[F.count(F.when(F.col("coverage_level") == x, 1)).alias(x) for x in levels])
    )


@query("g18_activity_by_person", "G18", f"""
    SELECT coalesce(CAST(person_id AS VARCHAR), 'm' || member_id) AS person_key, legislature_id, chamber,
      CAST(sum(votes_for) AS BIGINT) AS votes_for, CAST(sum(votes_against) AS BIGINT) AS votes_against,
      CAST(sum(proposals) AS BIGINT) AS proposals, min(first_activity_on) AS first_activity_on,
      max(last_activity_on) AS last_activity_on
    FROM ({ACTIVITY_SQL}) GROUP BY 1, 2, 3""")
def _(t):
    key = F.coalesce(F.col("person_id").cast("string"), F.concat(F.lit("m"), F.col("member_id").cast("string")))
    return activity(t).groupBy(key.alias("person_key"), "legislature_id", "chamber").agg(
        F.sum("votes_for").alias("votes_for"), F.sum("votes_against").alias("votes_against"),
        F.sum("proposals").alias("proposals"), F.min("first_activity_on").alias("first_activity_on"),
        F.max("last_activity_on").alias("last_activity_on"),
    )
