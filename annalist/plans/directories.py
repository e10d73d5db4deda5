"""Queries over the directories and the dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import directory as d
from annalist.operators.asof import best_per_key
from annalist.operators.ranges import join_in_window
from annalist.plans.readmodels import IDS_SQL, SUMMARY_SQL, index, summaries, with_identifiers, INDEX_SQL
from annalist.plans.registry import query


def vote_rows(t, limit=None, **flt):
    return d.vote_directory(t.votes, with_identifiers(t.bills), t.sources, t.reactions, t.legislatures, t.group_totals,
                            t.party_groups, limit, d.DirectoryFilter(**flt))


def bill_rows(t, limit=None, **flt):
    bills = with_identifiers(t.bills).withColumn("source_ids", F.array("source_id"))
    return d.bill_directory(bills, summaries(t), t.sources, t.reactions, t.legislatures, t.sponsors, t.memberships,
                            t.party_groups, limit, d.DirectoryFilter(**flt))


IDS_B = IDS_SQL.format(b="b").replace("{{", "{").replace("}}", "}")
VOTE_ROWS_SQL = f"""
    SELECT v.id, v.held_on, v.chamber, v.title, v.bill_id, b.title AS bill_title, s.status AS source_status,
      coalesce(h.n, 0) AS hot_count, CASE WHEN b.id IS NULL THEN NULL ELSE {IDS_B} END AS ids
    FROM votes v LEFT JOIN bills b ON b.id = v.bill_id LEFT JOIN sources s ON s.id = v.source_id
    LEFT JOIN (SELECT entity_id, count(*) AS n FROM reactions WHERE entity_type = 'vote' AND reaction = 'hot' GROUP BY 1) h
      ON h.entity_id = v.id"""
BILL_ROWS_SQL = f"""
    SELECT b.id, coalesce(m.submitted_on, m.latest_event_on, DATE '0001-01-01') AS sort_on, b.title, b.chamber_of_origin,
      m.submitted_on, m.latest_event_on, s.status AS source_status, m.vote_count, coalesce(h.n, 0) AS hot_count,
      {IDS_B} AS ids
    FROM bills b LEFT JOIN ({SUMMARY_SQL}) m ON m.bill_id = b.id LEFT JOIN sources s ON s.id = b.source_id
    LEFT JOIN (SELECT entity_id, count(*) AS n FROM reactions WHERE entity_type = 'bill' AND reaction = 'hot' GROUP BY 1) h
      ON h.entity_id = b.id"""


@query("j1_vote_directory", "J1 G7", f"SELECT * EXCLUDE ids FROM ({VOTE_ROWS_SQL})")
def _(t):
    return vote_rows(t)


@query("j2_bill_directory", "J2 G7", f"SELECT * EXCLUDE ids FROM ({BILL_ROWS_SQL})")
def _(t):
    return bill_rows(t)


@query("t1_vote_directory_page", "T1 B2 B3", f"""
    SELECT * EXCLUDE ids FROM ({VOTE_ROWS_SQL})
    WHERE held_on < DATE '1998-05-10' OR (held_on = DATE '1998-05-10' AND id < 9000)
    ORDER BY held_on DESC, id DESC LIMIT 51""")
def _(t):
    return vote_rows(t, 50, cursor=("1998-05-10", 9000))


@query("t2_bill_directory_page", "T2 B4", f"""
    SELECT * EXCLUDE ids FROM ({BILL_ROWS_SQL}) ORDER BY sort_on DESC, id DESC LIMIT 51""")
def _(t):
    return bill_rows(t, 50)


@query("b3_votes_filtered", "B2 B3 B5 J15", f"""
    SELECT * EXCLUDE ids FROM ({VOTE_ROWS_SQL})
    WHERE held_on >= DATE '1998-03-01' AND held_on < DATE '1998-04-01' AND chamber = 'senate' AND source_status = 'partial'
      AND held_on >= (SELECT starts_on FROM legislatures WHERE id = 'L1997')
      AND held_on < (SELECT ends_on FROM legislatures WHERE id = 'L1997')
      AND (title ILIKE '%dezbatere%' OR bill_title ILIKE '%dezbatere%' OR ids ILIKE '%dezbatere%')""")
def _(t):
    return vote_rows(t, year=1998, month=3, chamber="senate", status="partial", legislature="L1997", text="DEZBATERE")


@query("b4_bills_filtered", "B4 B5", f"""
    SELECT * EXCLUDE ids FROM ({BILL_ROWS_SQL})
    WHERE sort_on >= DATE '1995-01-01' AND sort_on < DATE '1996-01-01' AND chamber_of_origin = 'deputies'
      AND (title ILIKE '%pl-x 1%' OR ids ILIKE '%pl-x 1%')""")
def _(t):
    return bill_rows(t, year=1995, chamber="deputies", text="pl-x 1")


@query("j16_votes_with_group_totals", "J16", f"""
    SELECT * EXCLUDE ids FROM ({VOTE_ROWS_SQL}) r WHERE EXISTS (SELECT 1 FROM group_totals g
      LEFT JOIN party_groups pg ON pg.id = g.group_id
      WHERE g.vote_id = r.id AND (g.group_id = 'PROMO' OR pg.party_id = 'PROMO'))""")
def _(t):
    return vote_rows(t, group="PROMO")


@query("j17_bills_with_sponsor_in_group", "J17", f"""
    SELECT * EXCLUDE ids FROM ({BILL_ROWS_SQL}) r WHERE EXISTS (SELECT 1 FROM sponsors s
      JOIN memberships m ON m.member_id = s.member_id LEFT JOIN party_groups pg ON pg.id = m.group_id
      WHERE s.bill_id = r.id AND m.starts_on <= r.sort_on AND (m.ends_on IS NULL OR m.ends_on >= r.sort_on)
        AND (m.group_id = 'SMALL' OR pg.party_id = 'SMALL'))""")
def _(t):
    return bill_rows(t, group="SMALL")


@query("j18_groups_active_in_window", "J18 J15", """
    SELECT g.* FROM party_groups g WHERE EXISTS (SELECT 1 FROM memberships ms JOIN mandates mm
      ON mm.member_id = ms.member_id AND mm.chamber = g.chamber
      WHERE ms.group_id = g.id AND mm.legislature_id = 'L1999' AND ms.starts_on <= coalesce(mm.ends_on, DATE '9999-12-31')
        AND coalesce(ms.ends_on, DATE '9999-12-31') >= mm.starts_on)""")
def _(t):
    return d.groups_in_window(t.party_groups, t.memberships, t.mandates, "L1999")


@query("g8_dashboard_month_top", "G8 J28", """
    WITH v AS (SELECT entity_type, entity_id, count(*) AS count FROM engagement
        WHERE event_type = 'page_view' AND occurred_at >= TIMESTAMP '2024-01-01' AND entity_id IS NOT NULL
        GROUP BY 1, 2 ORDER BY count DESC, entity_type, entity_id LIMIT 5),
      s AS (SELECT 'search' AS entity_type, query_text, count(*) AS count FROM engagement
        WHERE event_type = 'search' AND entity_type = 'member' AND occurred_at >= TIMESTAMP '2024-01-01'
        GROUP BY 2 ORDER BY count DESC, query_text LIMIT 5),
      h AS (SELECT entity_type, entity_id, count(*) AS count FROM reactions WHERE entity_type = 'vote'
        AND reaction = 'hot' AND created_at >= TIMESTAMP '2024-01-01' GROUP BY 1, 2 ORDER BY count DESC, entity_type, entity_id LIMIT 5),
      titled AS (SELECT 'vote' AS entity_type, CAST(id AS VARCHAR) AS k, title FROM votes UNION ALL
        SELECT 'bill', CAST(id AS VARCHAR), title FROM bills UNION ALL
        SELECT 'member', CAST(id AS VARCHAR), display_name FROM members UNION ALL SELECT 'party', id, short_name FROM parties),
      rows AS (SELECT 'viewed' AS panel, entity_type, CAST(entity_id AS VARCHAR) AS entity_id, count FROM v UNION ALL
        SELECT 'searched', entity_type, query_text, count FROM s UNION ALL
        SELECT 'trending', entity_type, CAST(entity_id AS VARCHAR), count FROM h)
    SELECT r.panel, r.entity_type, r.entity_id, r.count, coalesce(t.title, r.entity_id) AS title
    FROM rows r LEFT JOIN titled t ON t.entity_type = r.entity_type AND t.k = r.entity_id""")
def _(t):
    at = "2024-01-31"
    views = d.month_top(t.engagement.where("event_type = 'page_view'"), "occurred_at", ["entity_type", "entity_id"], at)
    searches = d.month_top(
        t.engagement.where("event_type = 'search' AND entity_type = 'member'").select("occurred_at", "query_text"),
        "occurred_at", ["query_text"], at)
    hot = d.month_top(t.reactions.where("entity_type = 'vote' AND reaction = 'hot'"), "created_at", ["entity_type", "entity_id"], at)
    shown = lambda df, panel, kind, ident: df.select(
        F.lit(panel).alias("panel"), kind.alias("entity_type"), F.col(ident).cast("string").alias("entity_id"), "count")
    rows = (
        shown(views, "viewed", F.col("entity_type"), "entity_id")
        .unionByName(shown(searches, "searched", F.lit("search"), "query_text"))
        .unionByName(shown(hot, "trending", F.col("entity_type"), "entity_id"))
    )
    return d.titles_of(rows, {"vote": (t.votes, "id", "title"), "bill": (t.bills, "id", "title"),
                              "member": (t.members, "id", "display_name"), "party": (t.parties, "id", "short_name")})


@query("j28_polymorphic_titles", "J28 G7", """
    WITH c AS (SELECT entity_type, entity_id, count(*) AS n FROM engagement GROUP BY 1, 2),
      titled AS (SELECT 'vote' AS entity_type, CAST(id AS VARCHAR) AS k, title FROM votes UNION ALL
        SELECT 'bill', CAST(id AS VARCHAR), title FROM bills UNION ALL
        SELECT 'member', CAST(id AS VARCHAR), display_name FROM members UNION ALL SELECT 'party', id, short_name FROM parties)
    SELECT c.entity_type, c.entity_id, c.n, coalesce(t.title, CAST(c.entity_id AS VARCHAR)) AS title
    FROM c LEFT JOIN titled t ON t.entity_type = c.entity_type AND t.k = CAST(c.entity_id AS VARCHAR)""")
def _(t):
    counts = t.engagement.groupBy("entity_type", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return d.titles_of(counts, {"vote": (t.votes, "id", "title"), "bill": (t.bills, "id", "title"),
                                "member": (t.members, "id", "display_name"), "party": (t.parties, "id", "short_name")})


def person_key():
    return F.coalesce(F.concat(F.lit("p"), F.col("person_id").cast("string")), F.concat(F.lit("m"), F.col("id").cast("string")))


PERSON_SQL = "coalesce('p' || {m}.person_id, 'm' || {m}.id)"


def latest_mandates(t):
    persons = t.members.select(F.col("id").alias("member_id"), person_key().alias("person_key"))
    return best_per_key(t.mandates.join(persons, "member_id"), ["person_key"], [F.col("starts_on"), F.col("id")],
                        ["member_id", "chamber", "legislature_id", "starts_on"])


def latest_memberships(t):
    return best_per_key(t.memberships, ["member_id"], [F.col("starts_on"), F.col("id")], ["group_id"])


def absence_stats(t):
    persons = t.members.select(F.col("id").alias("member_id"), person_key().alias("person_key"))
    return (t.ballots.where("choice = 'absent'").groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))
            .join(persons, "member_id").groupBy("person_key").agg(F.sum("n").alias("value")))


def switch_stats(t):
    persons = t.members.select(F.col("id").alias("member_id"), person_key().alias("person_key"))
    return (t.memberships.join(persons, "member_id").groupBy("person_key")
            .agg(F.greatest(F.countDistinct("group_id") - 1, F.lit(0)).alias("value")))


def seniority_stats(t, as_of):
    """Days in office up to ``as_of``; overlapping mandates count twice."""
    today = F.to_date(F.lit(as_of))
    persons = t.members.select(F.col("id").alias("member_id"), person_key().alias("person_key"))
    windows = t.legislatures.select(F.col("id").alias("legislature_id"), F.col("ends_on").alias("w_e"))
    days = F.greatest(F.datediff(F.least(F.coalesce("ends_on", today), F.coalesce("w_e", today), today), "starts_on"), F.lit(0))
    return (t.mandates.join(persons, "member_id").join(windows, "legislature_id", "left")
            .groupBy("person_key").agg(F.sum(days).alias("value")))


LATEST_SQL = f"""
    SELECT m.id AS member_id, {PERSON_SQL.format(m='m')} AS person_key, m.display_name, m.slug, lm.chamber, lm.legislature_id,
      ms.group_id, g.party_id, g.short_name AS g_short, p.short_name AS p_short
    FROM members m
    JOIN (SELECT mm.*, {PERSON_SQL.format(m='x')} AS person_key FROM mandates mm JOIN members x ON x.id = mm.member_id
          QUALIFY row_number() OVER (PARTITION BY person_key ORDER BY mm.starts_on DESC, mm.id DESC) = 1) lm
      ON lm.member_id = m.id AND lm.person_key = {PERSON_SQL.format(m='m')}
    LEFT JOIN (SELECT * FROM memberships QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY starts_on DESC, id DESC) = 1) ms
      ON ms.member_id = m.id
    LEFT JOIN party_groups g ON g.id = ms.group_id LEFT JOIN parties p ON p.id = g.party_id"""
SHOWN = "member_id, person_key, display_name, chamber, legislature_id, group_id, party_id"
ABSENT_SQL = f"SELECT {PERSON_SQL.format(m='m')} AS person_key, count(*) AS value FROM ballots b JOIN members m ON m.id = b.member_id WHERE choice = 'absent' GROUP BY 1"
SWITCH_SQL = f"SELECT {PERSON_SQL.format(m='m')} AS person_key, greatest(count(DISTINCT s.group_id) - 1, 0) AS value FROM memberships s JOIN members m ON m.id = s.member_id GROUP BY 1"
SENIOR_SQL = f"""SELECT {PERSON_SQL.format(m='m')} AS person_key, CAST(sum(greatest(least(coalesce(s.ends_on, DATE '2002-06-30'),
      coalesce(l.ends_on, DATE '2002-06-30'), DATE '2002-06-30') - s.starts_on, 0)) AS BIGINT) AS value
      FROM mandates s JOIN members m ON m.id = s.member_id LEFT JOIN legislatures l ON l.id = s.legislature_id GROUP BY 1"""


def directory_of(t, **kw):
    return d.member_directory(t.members, latest_mandates(t), latest_memberships(t), t.party_groups, t.parties, **kw)


@query("w1_latest_mandate_per_person", "W1", f"""
    SELECT {PERSON_SQL.format(m='x')} AS person_key, mm.member_id, mm.chamber, mm.legislature_id, mm.starts_on
    FROM mandates mm JOIN members x ON x.id = mm.member_id
    QUALIFY row_number() OVER (PARTITION BY person_key ORDER BY mm.starts_on DESC, mm.id DESC) = 1""")
def _(t):
    return latest_mandates(t)


for _sort, _ids, _stats_sql in (("absent", "G15 T5", ABSENT_SQL), ("switches", "G16 T5", SWITCH_SQL), ("seniority", "G17 T5", SENIOR_SQL)):
    @query(f"t5_member_directory_by_{_sort}", _ids, f"""
        SELECT {SHOWN.replace('person_key', 'r.person_key')}, coalesce(s.value, 0) AS stat FROM ({LATEST_SQL}) r
        LEFT JOIN ({_stats_sql}) s ON s.person_key = r.person_key
        ORDER BY stat DESC, display_name, member_id LIMIT 500""")
    def _(t, sort=_sort):
        stats = {"absent": absence_stats(t), "switches": switch_stats(t), "seniority": seniority_stats(t, "2002-06-30")}
        return directory_of(t, sort=sort, stats=stats)


@query("g15_absence_counts", "G15", ABSENT_SQL)
def _(t):
    return absence_stats(t)


@query("g16_group_switches", "G16", SWITCH_SQL)
def _(t):
    return switch_stats(t)


@query("g17_seniority_days", "G17", SENIOR_SQL)
def _(t):
    return seniority_stats(t, "2002-06-30")


@query("b6_member_search", "B6", f"""
    SELECT {SHOWN}, 0 AS stat FROM ({LATEST_SQL}) r
    WHERE lower(translate(display_name || ' ' || slug || ' ' || coalesce(g_short, '') || ' ' || coalesce(p_short, ''),
        'ăâîșşțţĂÂÎȘŞȚŢ', 'aaissttAAISSTT')) LIKE '%anvil%'
      OR EXISTS (SELECT 1 FROM ({INDEX_SQL}) e WHERE e.entity_type = 'member' AND e.entity_id = CAST(r.member_id AS VARCHAR)
                 AND e.search_text LIKE '%anvil%')""")
def _(t):
    return directory_of(t, text="Anvil", index=index(t), limit=None)


@query("b7_member_group_filter", "B7", f"""
    SELECT {SHOWN}, 0 AS stat FROM ({LATEST_SQL}) r
    WHERE group_id = 'Brand#3' OR party_id = 'Brand#3' OR group_id = 'PROMO' OR party_id = 'PROMO'
      OR regexp_replace(lower(coalesce(p_short, g_short)), '[^a-z0-9]', '', 'g') = 'sma'""")
def _(t):
    return directory_of(t, group="Brand#3, PROMO, group-name:sma", limit=None)


@query("b8_identifier_map_predicate", "B8", """
    SELECT id, senate_identifier AS senate, deputies_identifier AS deputies FROM bills
    WHERE senate_identifier IS NOT NULL AND (deputies_identifier IS NULL OR deputies_identifier LIKE 'PL-x 1%')""")
def _(t):
    ids = F.col("identifiers")
    return with_identifiers(t.bills).where(
        F.map_contains_key(ids, "senate") & (~F.map_contains_key(ids, "deputies") | ids["deputies"].startswith("PL-x 1"))
    ).select("id", ids["senate"].alias("senate"), ids["deputies"].alias("deputies"))


@query("j33_audit_vote_rows", "J33", """
    SELECT v.id, v.chamber, v.title, v.held_on, v.bill_id, s.source_url, s.status AS source_status, c.n AS nominal_votes
    FROM votes v LEFT JOIN sources s ON s.id = v.source_id
    LEFT JOIN (SELECT vote_id, count(*) AS n FROM ballots GROUP BY 1) c ON c.vote_id = v.id
    WHERE v.held_on >= DATE '1997-01-01' AND v.held_on < DATE '1999-01-01' AND v.chamber = 'deputies'""")
def _(t):
    from annalist.operators.audit import vote_audit_rows
    counts = t.ballots.groupBy("vote_id").agg(F.count(F.lit(1)).alias("nominal_votes"))
    return vote_audit_rows(t.votes, t.sources, counts, "1997-01-01", "1999-01-01", "deputies")


@query("t13_member_votes_newest", "T13 J10", """
    SELECT member_id, vote_id, choice, held_on, legislature_id FROM (
      SELECT b.member_id, b.vote_id, b.choice, v.held_on, l.id AS legislature_id,
        row_number() OVER (PARTITION BY b.member_id, l.id ORDER BY v.held_on DESC, v.id DESC) AS rn
      FROM ballots b JOIN votes v ON v.id = b.vote_id JOIN legislatures l ON v.held_on >= l.starts_on AND v.held_on < l.ends_on)
    WHERE rn <= 100""")
def _(t):
    from annalist.operators.sets import top_per_key
    w = t.legislatures.select(F.col("id").alias("legislature_id"), "starts_on", "ends_on")
    dated = join_in_window(t.votes.select(F.col("id").alias("vote_id"), "held_on"), w, "held_on", "starts_on", "ends_on")
    rows = t.ballots.select("member_id", "vote_id", "choice").join(dated.select("vote_id", "held_on", "legislature_id"), "vote_id")
    return top_per_key(rows, ["member_id", "legislature_id"], [F.desc("held_on"), F.desc("vote_id")], 100)


@query("t6_alignments_by_priority", "T6 B16", """
    SELECT id, government_id, party_id, alignment,
      CASE alignment WHEN 'government' THEN 1 WHEN 'support' THEN 2 WHEN 'mixed' THEN 3 WHEN 'opposition' THEN 4
        WHEN 'unaffiliated' THEN 5 ELSE 6 END AS weight
    FROM government_party_alignments WHERE alignment NOT IN ('opposition', 'unknown')""")
def _(t):
    rows = t.government_party_alignments.where(~F.col("alignment").isin("opposition", "unknown"))
    return rows.select("id", "government_id", "party_id", "alignment",
                       d.ordinal(F.col("alignment"), d.ALIGNMENT_ORDER).alias("weight")).orderBy("weight", "government_id", "party_id")


@query("b17_ballots_by_group_and_choice", "B17", """
    SELECT id, vote_id, member_id, group_id, choice FROM ballots
    WHERE group_id IN ('Brand#1', 'Brand#7') AND choice IN ('for', 'abstention')""")
def _(t):
    groups, choices = ["Brand#1", "Brand#7"], ["for", "abstention"]
    chosen = [F.col(c).isin(v) for c, v in (("group_id", groups), ("choice", choices)) if v]
    return t.ballots.where(d.all_of(chosen)).select("id", "vote_id", "member_id", "group_id", "choice")
