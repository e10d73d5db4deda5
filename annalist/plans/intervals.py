"""Queries over as-of joins, rosters, compositions and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import intervals as iv
from annalist.operators import asof, parties, timeline as tl
from annalist.operators import composition as cp
from annalist.operators.directory import ordinal
from annalist.operators.ranges import join_in_window, join_overlapping
from annalist.operators.sets import number_slugs, top_per_key
from annalist.plans.directories import PERSON_SQL, person_key
from annalist.plans.registry import query


def persons(t):
    return t.members.select(F.col("id").alias("member_id"), person_key().alias("person_key"), "display_name")


def dated_ballots(t):
    return t.ballots.join(t.votes.select(F.col("id").alias("vote_id"), "held_on", "chamber"), "vote_id")


MS = lambda t: t.memberships.select("member_id", F.col("id").alias("membership_id"), F.col("group_id").alias("on_group"),
                                    F.col("starts_on").alias("s"), F.col("ends_on").alias("e"))


@query("j3_ballot_group_on_vote_date", "J3 J8 B9", """
    SELECT b.vote_id, b.member_id, v.held_on, m.group_id AS on_group, m.id AS membership_id
    FROM ballots b JOIN votes v ON v.id = b.vote_id
    LEFT JOIN memberships m ON m.member_id = b.member_id AND m.starts_on <= v.held_on AND (m.ends_on IS NULL OR m.ends_on >= v.held_on)
    QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY m.starts_on DESC NULLS LAST, m.id DESC) = 1""")
def _(t):
    return asof.latest_on(dated_ballots(t).select("vote_id", "member_id", "held_on"), MS(t), "member_id", "held_on", "s", "e",
                          ["on_group", "membership_id"], ["s", "membership_id"])


@query("j4_membership_during_mandate", "J4 B11", """
    SELECT mm.id, mm.member_id, mm.chamber, g.group_id AS on_group
    FROM mandates mm LEFT JOIN (SELECT ms.*, pg.chamber FROM memberships ms JOIN party_groups pg ON pg.id = ms.group_id) g
      ON g.member_id = mm.member_id AND g.chamber = mm.chamber AND g.starts_on <= coalesce(mm.ends_on, DATE '9999-12-31')
      AND coalesce(g.ends_on, DATE '9999-12-31') >= mm.starts_on
    QUALIFY row_number() OVER (PARTITION BY mm.id ORDER BY g.starts_on DESC NULLS LAST, g.id DESC) = 1""")
def _(t):
    g = t.party_groups.select(F.col("id").alias("on_group"), "chamber")
    spans = MS(t).join(g, "on_group")
    return asof.latest_overlapping(t.mandates.select("id", "member_id", "chamber", "starts_on", "ends_on"), spans, ["member_id", "chamber"],
                                   "id", ("starts_on", "ends_on"), ("s", "e"), ["on_group"], ["s", "membership_id"]).drop("starts_on", "ends_on")


ROSTER_SQL = """
    SELECT mm.id, mm.member_id, mm.chamber, mm.legislature_id, mm.constituency, coalesce(a.party_id, pg.party_id) AS party_id,
      CASE WHEN a.party_id IS NOT NULL THEN 'affiliation' WHEN pg.party_id IS NOT NULL THEN 'group' END AS origin
    FROM mandates mm
    LEFT JOIN (SELECT m2.id AS mid, x.party_id FROM mandates m2 JOIN affiliations x ON x.member_id = m2.member_id
        AND x.starts_on <= m2.starts_on AND (x.ends_on IS NULL OR x.ends_on >= m2.starts_on)
        QUALIFY row_number() OVER (PARTITION BY m2.id ORDER BY x.starts_on DESC, x.id DESC) = 1) a ON a.mid = mm.id
    LEFT JOIN (SELECT m2.id AS mid, x.group_id FROM mandates m2 JOIN memberships x ON x.member_id = m2.member_id
        AND x.starts_on <= m2.starts_on AND (x.ends_on IS NULL OR x.ends_on >= m2.starts_on)
        QUALIFY row_number() OVER (PARTITION BY m2.id ORDER BY x.starts_on DESC, x.id DESC) = 1) g ON g.mid = mm.id
    LEFT JOIN party_groups pg ON pg.id = g.group_id"""


def official_roster(t):
    aff = t.affiliations.select("member_id", F.col("id").alias("aid"), F.col("party_id").alias("a_party"), F.col("starts_on").alias("s"), F.col("ends_on").alias("e"))
    rows = t.mandates.select("id", "member_id", "chamber", "legislature_id", "constituency", "starts_on")
    rows = asof.latest_on(rows, aff, "member_id", "starts_on", "s", "e", ["a_party"], ["s", "aid"])
    rows = asof.latest_on(rows, MS(t), "member_id", "starts_on", "s", "e", ["on_group"], ["s", "membership_id"])
    g = t.party_groups.select(F.col("id").alias("on_group"), F.col("party_id").alias("g_party"))
    return rows.join(g, "on_group", "left").select(
        "id", "member_id", "chamber", "legislature_id", "constituency", F.coalesce("a_party", "g_party").alias("party_id"),
        F.when(F.col("a_party").isNotNull(), "affiliation").when(F.col("g_party").isNotNull(), "group").alias("origin"))


@query("j6_roster_party_with_fallback", "J6", ROSTER_SQL)
def _(t):
    return official_roster(t)


@query("j7_sponsor_group_on_bill_date", "J7", """
    SELECT s.bill_id, s.member_id, e.d AS submitted_on, m.group_id AS on_group
    FROM sponsors s JOIN (SELECT bill_id, min(occurred_on) AS d FROM bill_events GROUP BY 1) e ON e.bill_id = s.bill_id
    LEFT JOIN memberships m ON m.member_id = s.member_id AND m.starts_on <= e.d AND (m.ends_on IS NULL OR m.ends_on >= e.d)
    QUALIFY row_number() OVER (PARTITION BY s.bill_id, s.member_id ORDER BY m.starts_on DESC NULLS LAST, m.id DESC) = 1""")
def _(t):
    dated = t.sponsors.join(t.bill_events.groupBy("bill_id").agg(F.min("occurred_on").alias("submitted_on")), "bill_id")
    return asof.latest_on(dated, MS(t), "member_id", "submitted_on", "s", "e", ["on_group"], ["s", "membership_id"])


@query("j8_current_membership", "J8", """
    SELECT member_id, id, group_id, starts_on, ends_on FROM memberships
    QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY (ends_on IS NULL) DESC, starts_on DESC, id DESC) = 1""")
def _(t):
    rank = [*asof.open_first(F.col("starts_on"), F.col("ends_on")), F.col("id")]
    return asof.best_per_key(t.memberships, ["member_id"], rank, ["id", "group_id", "starts_on", "ends_on"])


@query("j9_mandate_on_date_or_latest", "J9", """
    SELECT c.id, c.member_id, m.id AS mandate_id, m.chamber AS m_chamber
    FROM role_terms c LEFT JOIN mandates m ON m.member_id = c.member_id
    QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY (m.starts_on <= c.starts_on AND (m.ends_on IS NULL OR m.ends_on >= c.starts_on)) DESC,
      m.starts_on DESC, m.id DESC) = 1""")
def _(t):
    held = t.mandates.select("member_id", F.col("id").alias("mandate_id"), F.col("chamber").alias("m_chamber"),
                             F.col("starts_on").alias("s"), F.col("ends_on").alias("e"))
    return asof.latest_on_or_any(t.role_terms.select("id", "member_id", "starts_on"), held, "member_id", "starts_on", "s", "e",
                                 ["mandate_id", "m_chamber"], ["s", "mandate_id"]).drop("starts_on")


@query("b10_mandates_active_on_dates", "B9 B10 B13 B23", """
    SELECT l.id AS stop_id, m.id AS mandate_id, m.chamber FROM legislatures l JOIN mandates m ON true
    JOIN legislatures w ON w.id = m.legislature_id
    WHERE m.starts_on <= l.starts_on + 400 AND least(m.ends_on, w.ends_on) >= l.starts_on + 400""")
def _(t):
    stops = t.legislatures.select(F.col("id").alias("stop_id"), F.date_add("starts_on", 400).alias("as_of"))
    return cp.active_mandates(stops, t.mandates, t.legislatures).select("stop_id", "mandate_id", "chamber")


@query("b12_terms_touching_windows", "B12 J12", """
    SELECT c.id, l.id AS legislature_id FROM committee_terms c JOIN legislatures l
      ON c.starts_on < l.ends_on AND (c.ends_on IS NULL OR c.ends_on >= l.starts_on)""")
def _(t):
    w = t.legislatures.select(F.col("id").alias("legislature_id"), F.col("starts_on").alias("w_s"), F.col("ends_on").alias("w_e"))
    return join_overlapping(t.committee_terms.select("id", "starts_on", "ends_on"), w, [], ("starts_on", "ends_on"), ("w_s", "w_e"),
                            b_half_open=True).select("id", "legislature_id")


EVIDENCE_SQL = f"""
    SELECT mm.id AS mandate_id, mm.member_id, mm.legislature_id, mm.chamber, e.party_id, e.logo_url, {PERSON_SQL.format(m='m')} AS person_key,
      m.display_name, (mm.starts_on <= l.starts_on AND coalesce(mm.ends_on, l.ends_on) >= l.starts_on
        AND e.starts_on <= l.starts_on AND coalesce(e.ends_on, l.ends_on) >= l.starts_on) AS at_start
    FROM mandates mm JOIN legislatures l ON l.id = mm.legislature_id JOIN members m ON m.id = mm.member_id
    JOIN (SELECT member_id, NULL AS chamber, party_id, logo_url, starts_on, ends_on FROM affiliations
          UNION ALL SELECT ms.member_id, pg.chamber, pg.party_id, NULL, ms.starts_on, ms.ends_on
          FROM memberships ms JOIN party_groups pg ON pg.id = ms.group_id) e
      ON e.member_id = mm.member_id AND (e.chamber IS NULL OR e.chamber = mm.chamber)
      AND e.starts_on <= coalesce(mm.ends_on, l.ends_on) AND coalesce(e.ends_on, DATE '9999-12-31') >= mm.starts_on"""


def evidence(t):
    return parties.party_evidence(t.mandates, t.legislatures, t.affiliations, t.memberships, t.party_groups)


@query("j13_party_window_summary", "J13 G13 R22", f"""
    SELECT legislature_id, chamber, party_id, count(DISTINCT person_key) AS member_count,
      count(DISTINCT person_key) FILTER (at_start) AS seat_count,
      coalesce(array_to_string(list_sort(list(DISTINCT logo_url) FILTER (logo_url IS NOT NULL)), ','), '') AS logo_urls
    FROM ({EVIDENCE_SQL}) GROUP BY 1, 2, 3""")
def _(t):
    return parties.party_window_summary(evidence(t), persons(t))


MEMBERS_SQL = f"""
    SELECT legislature_id, chamber, party_id, person_key, member_id, display_name FROM ({EVIDENCE_SQL})
    QUALIFY row_number() OVER (PARTITION BY legislature_id, chamber, party_id, person_key ORDER BY display_name, member_id) = 1"""


@query("j14_party_window_members", "J14 R22", MEMBERS_SQL)
def _(t):
    return parties.party_window_members(evidence(t), persons(t))


@query("g14_sample_members", "G14", f"""
    SELECT legislature_id, chamber, party_id, string_agg(member_id, ',' ORDER BY display_name, member_id) AS sample
    FROM (SELECT * FROM ({MEMBERS_SQL}) QUALIFY row_number() OVER (PARTITION BY legislature_id, chamber, party_id ORDER BY display_name, member_id) <= 12)
    GROUP BY 1, 2, 3""")
def _(t):
    return parties.sample_members(parties.party_window_members(evidence(t), persons(t)))


SEATS_SQL = """
    WITH roster AS (SELECT DISTINCT v.id AS vote_id, m.member_id, v.held_on FROM votes v JOIN mandates m
        ON m.chamber = v.chamber JOIN legislatures l ON l.id = m.legislature_id
        WHERE m.starts_on <= v.held_on AND least(m.ends_on, l.ends_on) >= v.held_on),
      everyone AS (SELECT vote_id, member_id, held_on FROM roster UNION
        SELECT b.vote_id, b.member_id, v.held_on FROM ballots b JOIN votes v ON v.id = b.vote_id),
      placed AS (SELECT e.vote_id, e.member_id, m.group_id FROM everyone e LEFT JOIN memberships m ON m.member_id = e.member_id
        AND m.starts_on <= e.held_on AND (m.ends_on IS NULL OR m.ends_on >= e.held_on)
        QUALIFY row_number() OVER (PARTITION BY e.vote_id, e.member_id ORDER BY m.starts_on DESC NULLS LAST, m.id DESC) = 1),
      seats AS (SELECT p.vote_id, p.member_id, coalesce(b.group_id, p.group_id) AS group_id, coalesce(b.choice, 'absent') AS choice,
        b.id IS NOT NULL AS voted FROM placed p LEFT JOIN ballots b ON b.vote_id = p.vote_id AND b.member_id = p.member_id)"""


def capped_seats(rows):
    # ids of one sign and as many digits sort as their texts, so only their first becomes one: a least text of all rows would have them sorted
    missing, member = ~F.col("voted"), F.col("member_id")
    few = rows.groupBy("vote_id", (member < 0).alias("below"), F.length(member.cast("string")).alias("digits")).agg(
        F.count(F.lit(1)).alias("seats"), F.count(F.when(missing, 1)).alias("absent"),
        F.min(F.when(missing, member)).alias("least"), F.max(F.when(missing, member)).alias("most"))
    return few.groupBy("vote_id").agg(
        F.sum("seats").alias("seats"), F.sum("absent").alias("absent"),
        F.coalesce(F.min(F.when(F.col("below"), F.col("most")).otherwise(F.col("least")).cast("string")), F.lit("")).alias("first_absent"))


@query("s3_seat_rows", "S3 R10", SEATS_SQL + " SELECT * FROM seats")
def _(t):
    return parties.seat_rows(t.votes, t.ballots, t.mandates, t.legislatures, t.memberships)


@query("t11_seat_rows_capped", "T11 R10", SEATS_SQL + """,
      n AS (SELECT vote_id, count(*) FILTER (voted) AS voters FROM seats GROUP BY 1)
    SELECT s.vote_id, count(*) AS seats, count(*) FILTER (NOT voted) AS absent,
      coalesce(min(CAST(member_id AS VARCHAR)) FILTER (NOT voted), '') AS first_absent
    FROM (SELECT *, row_number() OVER (PARTITION BY vote_id, voted ORDER BY coalesce(group_id, ''), CAST(member_id AS VARCHAR)) AS rn FROM seats) s
    LEFT JOIN n ON n.vote_id = s.vote_id WHERE voted OR voters > 6 OR rn <= 6 - coalesce(voters, 0) GROUP BY 1""")
def _(t):
    return capped_seats(parties.seat_rows(t.votes, t.ballots, t.mandates, t.legislatures, t.memberships, seat_count=6))


@query("g9_group_totals_or_derived", "G9", """
    SELECT vote_id, group_id, for_count, against, abstention, present_not_voting, 'published' AS origin FROM group_totals
    UNION ALL SELECT vote_id, group_id, count(*) FILTER (choice = 'for'), count(*) FILTER (choice = 'against'),
      count(*) FILTER (choice = 'abstention'), count(*) FILTER (choice = 'present_not_voting'), 'derived'
    FROM ballots WHERE vote_id NOT IN (SELECT vote_id FROM group_totals) GROUP BY 1, 2""")
def _(t):
    return parties.totals_or_derived(t.group_totals, t.ballots)


@query("g10_choice_breakdown", "G10", """
    SELECT vote_id, group_id, count(*) AS seats, count(*) FILTER (choice = 'for') AS n_for, count(*) FILTER (choice = 'against') AS n_against,
      count(*) FILTER (choice = 'abstention') AS n_abstention, count(*) FILTER (choice = 'present_not_voting') AS n_present_not_voting,
      count(*) FILTER (choice = 'absent') AS n_absent, count(*) FILTER (choice = 'unknown') AS n_unknown
    FROM ballots GROUP BY GROUPING SETS ((vote_id, group_id), (vote_id))""")
def _(t):
    return parties.choice_breakdown(t.ballots)


@query("g43_used_groups", "G43", """
    SELECT b.vote_id, b.group_id, g.short_name, g.color, count(*) AS seats, row_number() OVER (PARTITION BY b.vote_id ORDER BY count(*) DESC, g.short_name, b.group_id) AS place
    FROM ballots b JOIN party_groups g ON g.id = b.group_id GROUP BY 1, 2, 3, 4""")
def _(t):
    return parties.used_groups(t.ballots, t.party_groups)


@query("g12_totals_check", "G11 G12", """
    SELECT v.id AS vote_id, coalesce(c.n, 0) AS rows,
      CASE WHEN c.n IS NULL THEN 'failed' WHEN c.f = v.for_count AND c.a = v.against AND c.ab = v.abstention AND c.p = v.present_not_voting
        THEN 'parsed' ELSE 'partial' END AS status,
      CASE WHEN c.n IS NOT NULL AND NOT (c.f = v.for_count AND c.a = v.against AND c.ab = v.abstention AND c.p = v.present_not_voting)
        THEN 'totals_mismatch' END AS warning
    FROM votes v LEFT JOIN (SELECT vote_id, count(*) AS n, count(*) FILTER (choice = 'for') AS f, count(*) FILTER (choice = 'against') AS a,
      count(*) FILTER (choice = 'abstention') AS ab, count(*) FILTER (choice = 'present_not_voting') AS p FROM ballots GROUP BY 1) c ON c.vote_id = v.id""")
def _(t):
    return parties.check_totals(t.votes, t.ballots)


@query("j27_group_party_colour", "J27", """
    SELECT x.id, x.group_id, g.short_name AS group_name, p.short_name AS party_name, p.slug, g.color FROM group_totals x
    LEFT JOIN party_groups g ON g.id = x.group_id LEFT JOIN parties p ON p.id = g.party_id""")
def _(t):
    g = t.party_groups.select(F.col("id").alias("group_id"), F.col("short_name").alias("group_name"), "party_id", "color")
    p = t.parties.select(F.col("id").alias("party_id"), F.col("short_name").alias("party_name"), "slug")
    return t.group_totals.join(g, "group_id", "left").join(p, "party_id", "left").select("id", "group_id", "group_name", "party_name", "slug", "color")


@query("j32_alignments_with_known_party", "J32", """
    SELECT a.id, a.party_id, EXISTS (SELECT 1 FROM parties p WHERE p.id = a.party_id AND p.id <> 'SMALL') AS known FROM government_party_alignments a""")
def _(t):
    kept, skipped = parties.existing_only(t.government_party_alignments, t.parties.where("id <> 'SMALL'"), "party_id")
    return kept.select("id", "party_id", F.lit(True).alias("known")).unionByName(skipped.select("id", "party_id", F.lit(False).alias("known")))


@query("j34_counts_of_two_sources", "J34 G37", """
    SELECT coalesce(a.k, b.k) AS chamber, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference
    FROM (SELECT chamber AS k, count(*) AS n FROM mandates GROUP BY 1) a FULL JOIN (SELECT chamber AS k, count(*) AS n FROM committee_terms GROUP BY 1) b ON a.k = b.k""")
def _(t):
    return parties.compare_counts(t.mandates, t.committee_terms, ["chamber"])


@query("j30_asset_fallback_chain", "J30", """
    WITH assets AS (SELECT a.id, a.member_id, m.legislature_id, m.chamber, a.logo_url AS url FROM affiliations a JOIN mandates m ON m.id = a.id
        WHERE a.logo_url IS NOT NULL)
    SELECT r.id, a.url, CASE WHEN a.id IS NULL THEN NULL WHEN a.legislature_id = m.legislature_id AND a.chamber = r.chamber THEN 1
      WHEN a.legislature_id = m.legislature_id THEN 2 ELSE 3 END AS level
    FROM role_terms r JOIN mandates m ON m.id = r.id LEFT JOIN assets a ON a.member_id = r.member_id
    QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY level, a.id) = 1""")
def _(t):
    held = t.mandates.select("id", "legislature_id", "chamber")
    assets = t.affiliations.where("logo_url IS NOT NULL").join(held, "id").select(
        "id", F.col("member_id").alias("entity_id"), "legislature_id", "chamber", F.col("logo_url").alias("url"))
    wanted = t.role_terms.select("id", F.col("member_id").alias("entity_id"), "chamber").join(held.select("id", "legislature_id"), "id")
    return parties.stored_asset(wanted, assets).select("id", "url", "level")


# --- composition -----------------------------------------------------------

COUNTS = {"senate": 900, "deputies": 1000}


def party_alignments(t):
    return t.government_party_alignments.withColumnRenamed("party_id", "target_id")


def stops(t):
    return cp.window_stops(t.legislatures, t.mandates, "2001-05-01")


def seats(t, counts=COUNTS, mode="official"):
    return cp.composition(stops(t), t.mandates, t.legislatures, t.members, t.memberships, t.party_groups, t.member_alignments,
                          t.group_alignments, party_alignments(t), counts, mode)


STOPS_SQL = """
    SELECT l.id AS stop_id, CASE WHEN l.starts_on <= DATE '2001-05-01' AND DATE '2001-05-01' < l.ends_on THEN DATE '2001-05-01'
      ELSE greatest(l.starts_on, f.d) END AS as_of FROM legislatures l
    LEFT JOIN (SELECT legislature_id, max(d) AS d FROM (SELECT legislature_id, chamber, min(starts_on) AS d FROM mandates GROUP BY 1, 2) GROUP BY 1) f
      ON f.legislature_id = l.id"""

SEAT_SQL = f"""
    WITH stops AS ({STOPS_SQL}),
    base AS (SELECT s.stop_id, s.as_of, m.id AS mandate_id, m.member_id, m.chamber, x.display_name FROM stops s JOIN mandates m ON m.starts_on <= s.as_of
        JOIN legislatures l ON l.id = m.legislature_id JOIN members x ON x.id = m.member_id WHERE least(m.ends_on, l.ends_on) >= s.as_of),
    placed AS (SELECT b.*, g.group_id, g.party_id, g.short_name AS group_name FROM base b
        LEFT JOIN (SELECT ms.*, pg.chamber, pg.party_id, pg.short_name FROM memberships ms JOIN party_groups pg ON pg.id = ms.group_id) g
          ON g.member_id = b.member_id AND g.chamber = b.chamber AND g.starts_on <= b.as_of AND (g.ends_on IS NULL OR g.ends_on >= b.as_of)
        QUALIFY row_number() OVER (PARTITION BY b.stop_id, b.mandate_id ORDER BY g.starts_on DESC NULLS LAST, g.id DESC) = 1),
    al AS (SELECT 1 AS lvl, CAST(target_id AS VARCHAR) AS k, id, starts_on, ends_on, alignment, basis FROM member_alignments UNION ALL
        SELECT 2, target_id, id, starts_on, ends_on, alignment, basis FROM group_alignments UNION ALL
        SELECT 3, party_id, id, starts_on, ends_on, alignment, basis FROM government_party_alignments),
    usable AS (SELECT * FROM al WHERE basis <> 'computed_vote_support'),
    hit AS (SELECT p.stop_id, p.mandate_id, a.alignment, a.basis FROM placed p JOIN usable a ON
          ((a.lvl = 1 AND a.k = CAST(p.member_id AS VARCHAR)) OR (a.lvl = 2 AND a.k = p.group_id) OR (a.lvl = 3 AND a.k = p.party_id))
          AND a.starts_on <= p.as_of AND (a.ends_on IS NULL OR a.ends_on >= p.as_of)
        QUALIFY row_number() OVER (PARTITION BY p.stop_id, p.mandate_id ORDER BY a.lvl, a.starts_on DESC, a.id DESC) = 1),
    known AS (SELECT s.stop_id, bool_or(a.id IS NOT NULL) AS k FROM stops s LEFT JOIN usable a
        ON a.starts_on <= s.as_of AND (a.ends_on IS NULL OR a.ends_on >= s.as_of) GROUP BY 1),
    resolved AS (SELECT p.*, coalesce(h.alignment, CASE WHEN known.k AND (p.group_id IS NOT NULL OR p.party_id IS NOT NULL) THEN 'opposition' ELSE 'unknown' END) AS alignment,
        coalesce(h.basis, CASE WHEN known.k AND (p.group_id IS NOT NULL OR p.party_id IS NOT NULL) THEN 'manual_curation' ELSE 'unknown' END) AS basis
        FROM placed p JOIN known ON known.stop_id = p.stop_id LEFT JOIN hit h ON h.stop_id = p.stop_id AND h.mandate_id = p.mandate_id),
    capped AS (SELECT * FROM resolved QUALIFY row_number() OVER (PARTITION BY stop_id, chamber ORDER BY coalesce(group_name, 'zzzz'), display_name, mandate_id)
        <= CASE chamber WHEN 'senate' THEN 900 ELSE 1000 END)"""


@query("r8_composition_seats", "R5 R8 R9 T12", SEAT_SQL + " SELECT * FROM capped")
def _(t):
    return seats(t)


@query("g21_composition_groups", "G20 G21 R8", SEAT_SQL + """
    SELECT g.stop_id, g.chamber, g.group_id, g.seats, a.alignment FROM
      (SELECT stop_id, chamber, group_id, count(*) AS seats FROM capped WHERE group_id IS NOT NULL GROUP BY 1, 2, 3) g
    JOIN (SELECT stop_id, chamber, group_id, alignment FROM capped WHERE group_id IS NOT NULL GROUP BY 1, 2, 3, 4
      QUALIFY row_number() OVER (PARTITION BY stop_id, chamber, group_id ORDER BY count(*) DESC, min((display_name, mandate_id))) = 1) a
    USING (stop_id, chamber, group_id)""")
def _(t):
    return cp.group_summary(seats(t))


@query("r9_window_stops", "R9", STOPS_SQL)
def _(t):
    return stops(t)


@query("g22_prime_minister_days", "G22 F16", """
    SELECT l.id AS legislature_id, g.prime_minister_id, CAST(sum(greatest(coalesce(least(g.ends_on, l.ends_on), l.ends_on) - greatest(g.starts_on, l.starts_on) + 1, 0)) AS BIGINT) AS days
    FROM governments g JOIN legislatures l ON g.starts_on < l.ends_on AND (g.ends_on IS NULL OR g.ends_on >= l.starts_on)
    WHERE g.name NOT ILIKE '%interimar%' GROUP BY 1, 2""")
def _(t):
    return cp.prime_minister_days(t.legislatures, t.governments)


CONTEXT_SQL = """
    SELECT v.id, v.held_on, g.id AS government_id, g.name AS government_name FROM votes v
    LEFT JOIN governments g ON g.starts_on <= v.held_on AND (g.ends_on IS NULL OR g.ends_on >= v.held_on)
    QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY g.starts_on DESC NULLS LAST, g.id DESC) = 1"""


@query("r7_government_on_vote_date", "R7", CONTEXT_SQL)
def _(t):
    return cp.government_on(t.votes.select("id", "held_on"), t.governments, "held_on")


@query("r6_vote_group_alignment", "R6 R7 R10", f"""
    SELECT x.id, x.vote_id, pg.party_id, c.government_id,
      CASE WHEN pg.party_id IS NULL THEN 'unknown' WHEN a.alignment IS NOT NULL THEN a.alignment
        WHEN EXISTS (SELECT 1 FROM government_party_alignments y WHERE y.government_id = c.government_id AND y.starts_on <= c.held_on
          AND (y.ends_on IS NULL OR y.ends_on >= c.held_on)) THEN 'opposition' ELSE 'unknown' END AS alignment
    FROM group_totals x JOIN ({CONTEXT_SQL}) c ON c.id = x.vote_id LEFT JOIN party_groups pg ON pg.id = x.group_id
    LEFT JOIN government_party_alignments a ON a.government_id = c.government_id AND a.party_id = pg.party_id
      AND a.starts_on <= c.held_on AND (a.ends_on IS NULL OR a.ends_on >= c.held_on)
    QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY a.id) = 1""")
def _(t):
    context = cp.government_on(t.votes.select(F.col("id").alias("vote_id"), "held_on"), t.governments, "held_on")
    g = t.party_groups.select(F.col("id").alias("group_id"), "party_id", "short_name")
    facts = t.group_totals.select("id", "vote_id", "group_id").join(context, "vote_id").join(g, "group_id", "left")
    return cp.party_alignment_on(facts, "held_on", "party_id", "short_name", t.government_party_alignments).select(
        "id", "vote_id", "party_id", "government_id", "alignment")


# --- timelines -------------------------------------------------------------

def career_rows(t):
    held = t.mandates.select("member_id", F.col("id").alias("mid"), "chamber", "legislature_id", F.col("starts_on").alias("s"), F.col("ends_on").alias("e"))
    rows = t.affiliations.select("id", "member_id", F.col("party_id").alias("label"), "starts_on", "ends_on", "logo_url")
    return asof.latest_on_or_any(rows, held, "member_id", "starts_on", "s", "e", ["chamber", "legislature_id"], ["s", "mid"])


CAREER_SQL = """
    SELECT a.id, a.member_id, a.party_id AS label, a.starts_on, a.ends_on, a.logo_url, m.chamber, m.legislature_id
    FROM affiliations a LEFT JOIN mandates m ON m.member_id = a.member_id
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (m.starts_on <= a.starts_on AND (m.ends_on IS NULL OR m.ends_on >= a.starts_on)) DESC,
      m.starts_on DESC, m.id DESC) = 1"""

# Quarterly pieces of each membership: rows that touch, so that merging has work.
def pieces(t):
    long = t.memberships.where(F.col("ends_on").isNotNull() & (F.col("ends_on") >= F.col("starts_on")))
    cut = F.sequence(F.col("starts_on"), F.col("ends_on"), F.expr("INTERVAL 90 DAYS"))
    # what has no end is one piece without an end
    endless = t.memberships.where(F.col("ends_on").isNull() & F.col("starts_on").isNotNull()).select(
        F.concat_ws("/", "id", F.col("starts_on").cast("string")).alias("id"), "member_id", F.col("group_id").alias("label"), "starts_on", "ends_on")
    ended = long.select("id", "member_id", "group_id", "ends_on", F.explode(cut).alias("s")).select(
        F.concat_ws("/", "id", F.col("s").cast("string")).alias("id"), "member_id", F.col("group_id").alias("label"),
        F.col("s").alias("starts_on"), F.least("ends_on", F.date_add("s", 89)).alias("ends_on"))
    return ended.unionByName(endless)


PIECES_SQL = """
    SELECT id || '/' || CAST(s AS VARCHAR) AS id, member_id, group_id AS label, s AS starts_on, least(ends_on, CAST(s + 89 AS DATE)) AS ends_on
    FROM (SELECT id, member_id, group_id, ends_on, CAST(unnest(generate_series(starts_on, ends_on, INTERVAL 90 DAY)) AS DATE) AS s
          FROM memberships WHERE ends_on IS NOT NULL AND ends_on >= starts_on)
    UNION ALL SELECT id || '/' || CAST(starts_on AS VARCHAR), member_id, group_id, starts_on, ends_on FROM memberships WHERE ends_on IS NULL AND starts_on IS NOT NULL"""


@query("w3_merged_segments", "W3", f"""
    WITH p AS ({PIECES_SQL}), f AS (SELECT *, NOT coalesce(lag(label) OVER w = label AND (lag(ends_on) OVER w = starts_on OR lag(ends_on) OVER w + 1 = starts_on), false) AS o
        FROM p WINDOW w AS (PARTITION BY member_id ORDER BY starts_on, label, id)),
      g AS (SELECT *, sum(o::INT) OVER (PARTITION BY member_id ORDER BY starts_on, label, id ROWS UNBOUNDED PRECEDING) AS i FROM f)
    SELECT member_id, arg_min(label, (starts_on, label, id)) AS label, arg_min(id, (starts_on, label, id)) AS id, min(starts_on) AS starts_on,
      last(ends_on ORDER BY starts_on, label, id) AS ends_on, count(*) AS rows_merged FROM g GROUP BY member_id, i""")
def _(t):
    return tl.merge_touching(pieces(t), "member_id", ["label"], "id")


@query("w3_career_segments", "W3 J9", f"""
    WITH p AS ({CAREER_SQL}), f AS (SELECT *, NOT coalesce(lag(label) OVER w = label AND lag(chamber) OVER w = chamber AND lag(legislature_id) OVER w = legislature_id
        AND (lag(ends_on) OVER w = starts_on OR lag(ends_on) OVER w + 1 = starts_on), false) AS o
        FROM p WINDOW w AS (PARTITION BY member_id ORDER BY starts_on, label, id)),
      g AS (SELECT *, sum(o::INT) OVER (PARTITION BY member_id ORDER BY starts_on, label, id ROWS UNBOUNDED PRECEDING) AS i FROM f)
    SELECT member_id, arg_min(label, (starts_on, label, id)) AS label, arg_min(chamber, (starts_on, label, id)) AS chamber,
      arg_min(legislature_id, (starts_on, label, id)) AS legislature_id, arg_min(id, (starts_on, label, id)) AS id, min(starts_on) AS starts_on,
      (max((starts_on, label, id, ends_on)))[4] AS ends_on, count(*) AS rows_merged FROM g GROUP BY member_id, i""")
def _(t):
    return tl.merge_touching(career_rows(t), "member_id", ["label", "chamber", "legislature_id"], "id")


@query("w4_display_segments", "W4", """
    WITH p AS (SELECT id, member_id, CASE WHEN supp % 2 = 0 THEN 'A' ELSE 'B' END AS label, starts_on, ends_on FROM terms),
      f AS (SELECT *, coalesce(lag(label) OVER w <> label, true) AS o FROM p WINDOW w AS (PARTITION BY member_id ORDER BY starts_on, label, id)),
      g AS (SELECT *, sum(o::INT) OVER (PARTITION BY member_id ORDER BY starts_on, label, id ROWS UNBOUNDED PRECEDING) AS r FROM f),
      h AS (SELECT *, max(coalesce(ends_on, DATE '9999-12-31')) OVER (PARTITION BY member_id, r ORDER BY starts_on, label, id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
      k AS (SELECT *, sum(CASE WHEN reach IS NULL OR starts_on - 1 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY member_id, r ORDER BY starts_on, label, id
        ROWS UNBOUNDED PRECEDING) AS i FROM h)
    SELECT member_id, min(label) AS label, arg_min(id, (starts_on, label, id)) AS id, min(starts_on) AS starts_on,
      nullif(max(coalesce(ends_on, DATE '9999-12-31')), DATE '9999-12-31') AS ends_on, count(*) AS rows_merged FROM k GROUP BY member_id, r, i""")
def _(t):
    rows = t.terms.select("id", "member_id", F.when(F.col("supp") % 2 == 0, "A").otherwise("B").alias("label"), "starts_on", "ends_on")
    return tl.merge_display(rows, "member_id", ["label"], "id")


@query("w5_governance_contexts", "W5 W6 W7", """
    WITH g AS (SELECT * FROM governments g WHERE EXISTS (SELECT 1 FROM government_party_alignments a WHERE a.government_id = g.id)),
      w AS (SELECT r.id AS row_id, r.party_id, g.id AS government_id, greatest(r.starts_on, g.starts_on) AS w_s, least(r.ends_on, g.ends_on) AS w_e
        FROM affiliations r JOIN g ON r.starts_on <= coalesce(g.ends_on, DATE '9999-12-31') AND g.starts_on <= coalesce(r.ends_on, DATE '9999-12-31')
        WHERE r.ends_on IS NULL OR r.ends_on >= r.starts_on),
      h AS (SELECT w.*, a.alignment, a.basis, a.starts_on AS a_s, a.ends_on AS a_e FROM w JOIN government_party_alignments a
        ON a.government_id = w.government_id AND a.party_id = w.party_id AND a.starts_on <= coalesce(w_e, DATE '9999-12-31')
        AND w_s <= coalesce(a.ends_on, DATE '9999-12-31')),
      b AS (SELECT row_id, government_id, any_value(w_s) AS w_s, any_value(w_e) AS w_e, min(a_s) AS lo, max(a_e) AS hi FROM h GROUP BY 1, 2),
      u AS (SELECT row_id, government_id, alignment, basis, greatest(w_s, a_s) AS starts_on, least(w_e, a_e) AS ends_on FROM h
        UNION ALL SELECT row_id, government_id, 'opposition', 'manual_curation', w_s, w_e FROM w
          WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.row_id = w.row_id AND h.government_id = w.government_id)
        UNION ALL SELECT row_id, government_id, 'opposition', 'manual_curation', w_s, CAST(lo - 1 AS DATE) FROM b WHERE w_s < lo
        UNION ALL SELECT row_id, government_id, 'opposition', 'manual_curation', CAST(hi + 1 AS DATE), w_e FROM b
          WHERE hi IS NOT NULL AND (w_e IS NULL OR hi + 1 <= w_e))
    SELECT DISTINCT * FROM u WHERE ends_on IS NULL OR starts_on <= ends_on""")
def _(t):
    return tl.governance_contexts(t.affiliations, t.governments, t.government_party_alignments, "id", "party_id")


@query("w8_segments_deduplicated", "W8", """
    SELECT party_id AS label, starts_on, coalesce(array_to_string(list_sort(list(DISTINCT logo_url) FILTER (logo_url IS NOT NULL)), ','), '') AS logos,
      arg_min(logo_url, id) FILTER (logo_url IS NOT NULL) AS logo_url FROM affiliations GROUP BY 1, 2""")
def _(t):
    rows = t.affiliations.select("id", F.col("party_id").alias("label"), "starts_on", "logo_url", F.array_compact(F.array("logo_url")).alias("logos"))
    merged = tl.dedupe_segments(rows, ["label", "starts_on"], ["logo_url"], ["logos"], ["id"])
    return merged.select("label", "starts_on", F.array_join("logos", ",").alias("logos"), "logo_url")


HISTORY_SQL = """
    WITH parts AS (SELECT id, member_id, starts_on, ends_on, CAST(NULL AS VARCHAR) AS own, group_id AS label, 'Grup parlamentar' AS details, 'group' AS type FROM memberships
        UNION ALL SELECT id, member_id, starts_on, ends_on, NULL, party_id, 'Formatiune', 'party' FROM affiliations
        UNION ALL SELECT id, member_id, starts_on, ends_on, chamber, committee_name, 'Membru', 'committee' FROM committee_terms
        UNION ALL SELECT id, member_id, starts_on, ends_on, chamber, title, 'Rol parlamentar', 'role' FROM role_terms),
      placed AS (SELECT p.*, m.chamber AS mc, m.ends_on AS me, m.legislature_id FROM parts p LEFT JOIN mandates m ON m.member_id = p.member_id
        QUALIFY row_number() OVER (PARTITION BY p.type, p.id ORDER BY (m.starts_on <= p.starts_on AND (m.ends_on IS NULL OR m.ends_on >= p.starts_on)) DESC,
          m.starts_on DESC, m.id DESC) = 1)
    SELECT 'history-' || m.id AS id, m.member_id, m.starts_on, coalesce(m.ends_on, CASE WHEN l.ends_on < DATE '2002-06-30' THEN l.ends_on END) AS ends_on,
      m.legislature_id, m.chamber, 'mandate' AS type, 'Mandat parlamentar' AS label, coalesce(m.constituency, '') AS details
    FROM mandates m LEFT JOIN legislatures l ON l.id = m.legislature_id
    UNION ALL SELECT 'history-' || p.type || '-' || p.id, p.member_id, p.starts_on,
      coalesce(p.ends_on, p.me, CASE WHEN l.ends_on < DATE '2002-06-30' THEN l.ends_on END), p.legislature_id,
      coalesce(p.own, p.mc, 'deputies'), p.type, p.label, p.details FROM placed p LEFT JOIN legislatures l ON l.id = p.legislature_id"""


def history(t):
    take = ["id", "member_id", "starts_on", "ends_on"]
    parts = {
        "group": t.memberships.select(*take, F.col("group_id").alias("label"), F.lit("Grup parlamentar").alias("details")),
        "party": t.affiliations.select(*take, F.col("party_id").alias("label"), F.lit("Formatiune").alias("details")),
        "committee": t.committee_terms.select(*take, "chamber", F.col("committee_name").alias("label"), F.lit("Membru").alias("details")),
        "role": t.role_terms.select(*take, "chamber", F.col("title").alias("label"), F.lit("Rol parlamentar").alias("details")),
    }
    return tl.unified_history(t.mandates, t.legislatures, parts, "2002-06-30")


@query("w11_unified_history", "W11 J9", HISTORY_SQL)
def _(t):
    return history(t)


@query("w10_history_after_mergers", "W9 W10")
def _(t):
    mergers = tl.merger_list(t.formation_events, t.formation_entities)
    return tl.split_and_rewrite(history(t), "member_id", "label", mergers, "id")


@query("w12_events_of_affiliations", "W12 B14", """
    SELECT r.id AS row_id, e.id AS event_id, e.occurred_on, e.title FROM affiliations r JOIN formation_entities x ON x.entity_id = r.party_id AND x.entity_type = 'party'
    JOIN formation_events e ON e.id = x.event_id WHERE e.occurred_on >= r.starts_on AND (r.ends_on IS NULL OR e.occurred_on <= r.ends_on + 1)""")
def _(t):
    return tl.events_of_rows(t.affiliations, t.formation_events, t.formation_entities, "id", "party_id")


@query("w13_labels_shown", "W13", """
    SELECT id, member_id, party_id AS label, starts_on, CASE WHEN lag(party_id) OVER (PARTITION BY member_id ORDER BY starts_on, id) = party_id
      THEN '' ELSE party_id END AS shown FROM affiliations""")
def _(t):
    return tl.shown_labels(t.affiliations.select("id", "member_id", F.col("party_id").alias("label"), "starts_on"), "member_id", "label", "id")


@query("w14_last_steps_before_vote", "W14", """
    SELECT v.id AS vote_id, e.id AS event_id, e.occurred_on, row_number() OVER (PARTITION BY v.id ORDER BY e.occurred_on DESC, e.id DESC) AS rn
    FROM votes v JOIN bill_events e ON e.bill_id = v.bill_id AND e.occurred_on <= v.held_on
    QUALIFY rn <= 3""")
def _(t):
    from annalist.operators.steps import last_steps
    return last_steps(t.votes.select(F.col("id").alias("vote_id"), "bill_id", "held_on"), "vote_id", "held_on",
                      t.bill_events.select(F.col("id").alias("event_id"), "bill_id", "occurred_on"), "bill_id", "event_id", "occurred_on", 3)


@query("w15_unique_slugs", "W15", """
    SELECT id, slug, CASE WHEN rn = 1 THEN slug ELSE slug || '-' || id END AS unique_slug
    FROM (SELECT id, slug, row_number() OVER (PARTITION BY slug ORDER BY id) AS rn FROM members)""")
def _(t):
    return number_slugs(t.members.select("id", "slug"), "slug", "id")


@query("w16_role_rows_carried", "W16", """
    SELECT id, member_id, line, title, CASE WHEN lag(title) OVER w LIKE 'Rol 0%' THEN lag(title) OVER w END AS role
    FROM (SELECT r.id, r.member_id, t.line, r.title FROM role_terms r JOIN terms t ON t.id = r.id)
    WINDOW w AS (PARTITION BY member_id ORDER BY line) QUALIFY title NOT LIKE 'Rol 0%'""")
def _(t):
    rows = t.role_terms.join(t.terms.select("id", "line"), "id").select("id", "member_id", "line", "title").withColumn(
        "is_label", F.col("title") == "Rol 0")
    return tl.pending_label(rows, "member_id", "line", "title", "is_label").drop("is_label")


@query("w17_inferred_end_dates", "W17", """
    WITH rel AS (SELECT a.id AS mandate_id, b.id AS replaced_id, a.starts_on FROM terms a JOIN terms b ON b.member_id = a.member_id AND b.line = a.line - 1)
    SELECT m.id, m.member_id, m.starts_on, CASE WHEN r.u IS NOT NULL AND m.starts_on <= r.u AND (m.ends_on IS NULL OR m.ends_on > r.u) THEN r.u ELSE m.ends_on END AS ends_on
    FROM mandates m LEFT JOIN (SELECT replaced_id, CAST(min(starts_on) - 1 AS DATE) AS u FROM rel GROUP BY 1) r ON r.replaced_id = m.id""")
def _(t):
    later = t.terms.select(F.col("id").alias("mandate_id"), "member_id", (F.col("line") - 1).alias("line"))
    relations = later.join(t.terms.select(F.col("id").alias("replaced_id"), "member_id", "line"), ["member_id", "line"])
    return tl.inferred_ends(t.mandates.select("id", "member_id", "starts_on", "ends_on"), relations.select("mandate_id", "replaced_id"))


@query("j29_nearest_fitting_logo", "J29", """
    WITH a AS (SELECT *, coalesce(logo_url NOT LIKE '%3%', false) AS fits FROM affiliations)
    SELECT x.id, x.member_id, x.party_id, x.logo_url, CASE WHEN x.logo_url IS NULL OR x.fits THEN x.logo_url ELSE coalesce(y.logo_url, x.logo_url) END AS resolved
    FROM a x LEFT JOIN a y ON NOT x.fits AND x.logo_url IS NOT NULL AND y.fits AND y.member_id = x.member_id AND y.party_id = x.party_id
    QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY abs(y.starts_on - x.starts_on), y.starts_on, y.id) = 1""")
def _(t):
    rows = t.affiliations.select("id", "member_id", "party_id", "logo_url", "starts_on")
    return tl.nearest_attribute(rows, "member_id", "party_id", "logo_url", ~F.col("logo_url").contains("3"), "id").drop("starts_on")


@query("g40_history_sections", "G40 G41", f"""
    SELECT h.member_id, h.legislature_id, count(*) AS rows, coalesce(any_value(l.starts_on), min(h.starts_on)) AS section_starts_on, min(h.starts_on) AS first_row_on
    FROM ({HISTORY_SQL}) h LEFT JOIN legislatures l ON l.id = h.legislature_id GROUP BY 1, 2""")
def _(t):
    w = t.legislatures.select(F.col("id").alias("legislature_id"), F.col("starts_on").alias("w_s"))
    per = history(t).groupBy("member_id", "legislature_id").agg(F.count(F.lit(1)).alias("rows"), F.min("starts_on").alias("first_row_on"))
    return per.join(w, "legislature_id", "left").select("member_id", "legislature_id", "rows",
                                                       F.coalesce("w_s", "first_row_on").alias("section_starts_on"), "first_row_on")


@query("t8_formation_events_up_to_date", "T8", """
    SELECT g.id AS government_id, e.id AS event_id, e.occurred_on FROM governments g
    JOIN (SELECT DISTINCT government_id, party_id FROM government_party_alignments) a ON a.government_id = g.id
    JOIN formation_entities x ON x.entity_id = a.party_id JOIN formation_events e ON e.id = x.event_id AND e.occurred_on <= g.starts_on
    GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY g.id ORDER BY e.occurred_on DESC, e.id DESC) <= 6""")
def _(t):
    wanted = t.government_party_alignments.select("government_id", F.col("party_id").alias("entity_id")).distinct()
    g = t.governments.select(F.col("id").alias("government_id"), F.col("starts_on").alias("g_s"))
    e = t.formation_events.select(F.col("id").alias("event_id"), "occurred_on")
    hits = wanted.join(t.formation_entities, "entity_id").join(e, "event_id").join(g, "government_id").where(F.col("occurred_on") <= F.col("g_s"))
    return top_per_key(hits.select("government_id", "event_id", "occurred_on").distinct(), ["government_id"], [F.desc("occurred_on"), F.desc("event_id")], 6)


@query("g39_formation_events_nested", "G39", """
    SELECT e.id, e.occurred_on, e.event_type, e.title, string_agg(x.role || ':' || x.entity_id, ',' ORDER BY x.role, x.entity_id) AS entities
    FROM formation_events e JOIN formation_entities x ON x.event_id = e.id GROUP BY 1, 2, 3, 4""")
def _(t):
    nested = t.formation_entities.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("role", "entity_type", "entity_id"))).alias("x"))
    text = F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["role"], s["entity_id"])), ",")
    return t.formation_events.join(nested, "id").select("id", "occurred_on", "event_type", "title", text.alias("entities"))
