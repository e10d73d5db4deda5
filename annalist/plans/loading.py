"""Queries over loads: run ledger, rosters into normalised tables, nested records, cascades, seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import ingest as ig
from annalist.operators import ledger as lg
from annalist.operators import reports as rp
from annalist.operators import rosters as ro
from annalist.plans.registry import query

# --- run ledger -------------------------------------------------------------------


def run_log(t):
    """Ten events a run, each seventh logged twice: the first starts it, the next
    four report, the sixth ends two runs of three."""
    id_, run, turn = F.col("event_id"), F.floor(F.col("event_id") / 10), F.col("event_id") % 10
    begun = (run * 37) % 4001
    step = turn.between(1, 4)
    count = lambda c, n: F.when(step, c % n).otherwise(0).cast("long")
    minutes = F.when(turn == 5, begun + (run % 17) * 60).otherwise(begun + turn * 10)
    log = t.events.where("event_id % 10 < 6").select(
        id_, run.alias("run_id"), F.concat(F.lit("kind-"), (run % 5).cast("string")).alias("kind"),
        F.when(turn == 0, "start").when(step, "step").when(run % 11 == 7, "fail").otherwise("finish").alias("event"),
        F.timestamp_seconds(F.lit(978307200) + minutes * 60).alias("at"),
        count(id_, 3).alias("discovered"), F.when(step & (run % 4 != 1), (id_ % 2)).otherwise(0).cast("long").alias("imported"),
        F.when(step & (id_ % 29 == 0), 1).otherwise(0).cast("long").alias("partial"),
        F.when(step & (id_ % 31 == 0), 1).otherwise(0).cast("long").alias("failed"), F.lit(0).cast("long").alias("skipped"),
        F.when(step & (id_ % 3 == 0), id_ % 7).cast("long").alias("expected"),
        F.when(step & (id_ % 5 == 0), F.concat(F.lit("models-"), id_.cast("string"))).alias("read_models"),
        F.when(step & (id_ % 37 == 0), F.concat(F.lit("error "), id_.cast("string"))).alias("error"),
    ).where((F.col("event") != "finish") & (F.col("event") != "fail") | (run % 3 != 0))
    return log.unionByName(log.where("event_id % 7 = 0"))


@query("i8_run_ledger", "I8", """
    WITH log AS (SELECT *, event_id // 10 AS run, event_id % 10 AS turn, (event_id // 10) * 37 % 4001 AS begun FROM events WHERE event_id % 10 < 6),
      e AS (SELECT event_id, run, turn, turn BETWEEN 1 AND 4 AS step, 'kind-' || run % 5 AS kind, CASE WHEN turn = 0 THEN 'start' WHEN turn BETWEEN 1 AND 4 THEN 'step' WHEN run % 11 = 7 THEN 'fail' ELSE 'finish' END AS event,
        TIMESTAMP '2001-01-01' + to_minutes(CAST(CASE WHEN turn = 5 THEN begun + run % 17 * 60 ELSE begun + turn * 10 END AS BIGINT)) AS at_time FROM log WHERE turn <> 5 OR run % 3 <> 0),
      r AS (SELECT run AS run_id, any_value(kind) AS kind, min(at_time) FILTER (event = 'start') AS started_at, max(at_time) FILTER (event IN ('finish', 'fail')) AS ended_at, bool_or(event = 'fail') AS broke,
          CAST(sum(CASE WHEN step THEN event_id % 3 ELSE 0 END) AS BIGINT) AS discovered, CAST(sum(CASE WHEN step AND run % 4 <> 1 THEN event_id % 2 ELSE 0 END) AS BIGINT) AS imported,
          count(*) FILTER (step AND event_id % 29 = 0) AS partial, count(*) FILTER (step AND event_id % 31 = 0) AS failed, CAST(0 AS BIGINT) AS skipped,
          CAST(coalesce(sum(event_id % 7) FILTER (step AND event_id % 3 = 0), 0) AS BIGINT) AS expected,
          arg_max('models-' || event_id, event_id) FILTER (step AND event_id % 5 = 0) AS read_models, count(*) FILTER (step AND event_id % 37 = 0) AS errors,
          string_agg('error ' || event_id, '; ' ORDER BY event_id) FILTER (step AND event_id % 37 = 0) AS error FROM e GROUP BY run HAVING bool_or(event = 'start')),
      s AS (SELECT r.*, CASE WHEN ended_at IS NULL THEN (SELECT min(o.started_at) FROM r o WHERE o.kind = r.kind AND o.started_at > r.started_at + INTERVAL 6 HOUR) END AS stale_at FROM r)
    SELECT run_id, kind, CASE WHEN stale_at IS NOT NULL THEN 'failed' WHEN ended_at IS NULL THEN 'running' WHEN broke THEN 'failed' WHEN imported = 0 AND discovered = 0 AND failed > 0 THEN 'failed'
        WHEN failed > 0 OR partial > 0 OR errors > 0 THEN 'partial' ELSE 'completed' END AS status, started_at, coalesce(ended_at, stale_at) AS finished_at, discovered, imported, partial, failed, skipped, expected,
      read_models, errors, nullif(concat_ws('; ', error, CASE WHEN stale_at IS NOT NULL THEN 'still running after 6 hours' END), '') AS error FROM s""")
def _(t):
    return lg.run_ledger(run_log(t))


# --- rosters -----------------------------------------------------------------------

def group_number(c):
    return F.substr(c, F.lit(7)).cast("int")


def profiles(t):
    """One official profile per member, window and chamber, from the terms."""
    terms = t.mandates.join(t.memberships.select("id", "group_id"), "id").join(t.affiliations.select("id", "party_id", "logo_url"), "id").join(
        t.committee_terms.select("id", "committee_name"), "id")
    link = lambda label, url="": F.struct(label.alias("label"), (F.lit(url) if isinstance(url, str) else url).alias("url"))
    party = F.when(F.col("party_id") == "ECONOMY", "PSD").when(F.col("party_id") == "LARGE", " PNL ").otherwise(F.concat(F.lit("Formatiunea "), "party_id"))
    group = F.when(group_number("group_id") % 5 == 0, "Neafiliati").otherwise(F.concat(F.lit("Grupul "), "group_id"))
    address = F.concat(F.lit("https://x.example/gr?idg="), group_number("group_id").cast("string"))
    gathered = terms.groupBy("member_id", "legislature_id", "chamber").agg(
        F.min("starts_on").alias("first"), F.max("ends_on").alias("last"), F.max("constituency").alias("constituency"), F.max("logo_url").alias("logo"),
        F.array_sort(F.collect_set(link(party))).alias("party_links"), F.array_sort(F.collect_set(link(group, address))).alias("group_links"),
        F.array_sort(F.collect_set(link(F.col("committee_name")))).alias("committee_links"))
    m = t.members.select(F.col("id").alias("member_id"), F.col("display_name").alias("name"))
    w = t.legislatures.select(F.col("id").alias("legislature_id"), F.substr("label", F.lit(1), F.lit(4)).alias("year"))
    p = gathered.join(m, "member_id").join(w, "legislature_id")
    number = F.col("member_id").cast("string")
    key = lambda id_: F.concat(F.lit("leg"), "year", F.lit(":"), "chamber", F.lit(":idm"), id_.cast("string"))
    day = lambda c: F.date_format(c, "d.MM.yyyy")
    replaces = F.col("member_id") % 4 == 0
    return p.select(
        F.col("member_id").alias("position"), key(F.col("member_id")).alias("profile_key"), number.alias("official_id"), "year", "chamber", "name",
        F.concat(F.lit("https://x.example/mp?idm="), number).alias("url"), F.sha2(F.concat("year", "chamber", number), 256).alias("content_hash"),
        F.when(F.col("member_id") % 6 == 0, 404).otherwise(200).alias("http_status"),
        F.when(F.col("member_id") % 5 != 0, F.concat(F.lit("data validarii: "), day("first"))).otherwise("").alias("validation_text"),
        F.when(F.col("member_id") % 3 == 0, day("last")).otherwise("").alias("end_text"), "constituency", "party_links", "group_links", "committee_links",
        F.array_compact(F.array("logo")).alias("logo_urls"), F.when(replaces, "POPESCU ion").alias("related_name"),
        F.when(replaces, key(F.col("member_id") + F.when(F.col("member_id") % 8 == 0, 1).otherwise(0))).alias("related_key"), F.when(replaces, "https://x.example/alt").alias("related_url"))


LONG = ["id", "member_id", "ref_id", "label", "starts_on", "ends_on", "status"]
SLUG = "regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def shown(tables):
    """All tables in one long form."""
    named = {"sources": {"ref_id": "source_url", "label": "content_hash"}, "parties": {"ref_id": "short_name", "label": "name"}, "groups": {"ref_id": "party_id", "label": "short_name"},
             "members": {"ref_id": "profile_key", "label": "display_name"}, "mandates": {"ref_id": "legislature_id", "label": "constituency"},
             "mandate_relations": {"ref_id": "related_member_id", "label": "related_name", "status": "related_url"}, "memberships": {"ref_id": "group_id", "label": "logo_url"},
             "affiliations": {"ref_id": "party_id", "label": "logo_url"}, "committees": {"ref_id": "committee_name", "label": "chamber"}}
    return ro.tagged({name: rows.withColumns({to: F.col(c) for to, c in named[name].items() if c in rows.columns}) for name, rows in tables.items()}, LONG)


PROFILES_SQL = f"""
    held AS (SELECT m.id, m.member_id, m.legislature_id, m.chamber, m.starts_on, m.ends_on, m.constituency, s.group_id, a.party_id, a.logo_url, c.committee_name FROM mandates m
      JOIN memberships s ON s.id = m.id JOIN affiliations a ON a.id = m.id JOIN committee_terms c ON c.id = m.id),
    g AS (SELECT member_id, legislature_id, chamber, min(starts_on) AS first_day, max(ends_on) AS last_day, max(constituency) AS constituency, max(logo_url) AS logo_url FROM held GROUP BY ALL),
    pr AS (SELECT g.*, x.display_name, substr(l.label, 1, 4) AS year, l.label AS legislature, 'member-' || chamber || '-' || substr(l.label, 1, 4) || '-' || g.member_id AS mid,
        CASE WHEN g.member_id % 5 <> 0 THEN first_day ELSE l.starts_on END AS starts_on, CASE WHEN g.member_id % 3 = 0 THEN last_day END AS ends_on, l.ends_on AS w_e,
        'source-profile-' || substr(sha256(substr(l.label, 1, 4) || chamber || g.member_id), 1, 12) AS source_id
      FROM g JOIN members x ON x.id = g.member_id JOIN legislatures l ON l.id = g.legislature_id),
    pl AS (SELECT DISTINCT p.*, CASE t.party_id WHEN 'ECONOMY' THEN 'party-psd' WHEN 'LARGE' THEN 'party-pnl' ELSE 'party-formation-' || p.year || '-formatiunea-' || lower(t.party_id) END AS pid,
        CASE t.party_id WHEN 'ECONOMY' THEN 'PSD' WHEN 'LARGE' THEN 'PNL' ELSE 'Formatiunea ' || t.party_id END AS plabel FROM held t JOIN pr p USING (member_id, legislature_id, chamber)),
    gl AS (SELECT DISTINCT p.*, 'group-' || chamber || '-' || CASE WHEN CAST(substr(t.group_id, 7) AS INT) % 5 = 0 THEN 'unaffiliated' ELSE {SLUG.format(x="p.legislature || '-' || substr(t.group_id, 7)")} END AS gid,
        CASE WHEN CAST(substr(t.group_id, 7) AS INT) % 5 = 0 THEN 'Neafiliați' ELSE 'Grupul ' || t.group_id END AS glabel FROM held t JOIN pr p USING (member_id, legislature_id, chamber)),
    cl AS (SELECT DISTINCT p.*, t.committee_name FROM held t JOIN pr p USING (member_id, legislature_id, chamber)),
    rel AS (SELECT p.*, CASE WHEN member_id % 8 = 0 THEN o.mid END AS related FROM pr p LEFT JOIN (SELECT mid, member_id AS n, legislature_id AS lg, chamber AS ch FROM pr) o
      ON o.n = p.member_id + 1 AND o.lg = p.legislature_id AND o.ch = p.chamber WHERE member_id % 4 = 0),
    mandate_ids AS (SELECT *, 'mandate-' || mid || '-' || legislature || '-' || chamber AS mandate FROM pr)"""
PROFILE_ROWS_SQL = f"""
    SELECT 'sources' AS "table", source_id AS id, NULL AS member_id, 'https://x.example/mp?idm=' || member_id AS ref_id, sha256(year || chamber || member_id) AS label, NULL AS starts_on, NULL AS ends_on,
      CASE WHEN member_id % 6 = 0 THEN 'partial' ELSE 'parsed' END AS status FROM pr
    UNION ALL SELECT 'parties', pid, NULL, CASE WHEN length(plabel) <= 24 THEN any_value(plabel) ELSE 'F' END, any_value(plabel), NULL, NULL, NULL FROM pl GROUP BY pid, length(plabel)
    UNION ALL SELECT 'groups', gid, NULL, NULL, any_value(glabel), NULL, NULL, NULL FROM gl GROUP BY gid
    UNION ALL SELECT 'members', mid, NULL, 'leg' || year || ':' || chamber || ':idm' || member_id, display_name, NULL, NULL, NULL FROM pr
    UNION ALL SELECT 'mandates', mandate, mid, legislature_id, constituency, CAST(starts_on AS VARCHAR), CAST(ends_on AS VARCHAR), CASE WHEN ends_on IS NOT NULL OR w_e < DATE '2002-01-01' THEN 'ended' ELSE 'active' END FROM mandate_ids
    UNION ALL SELECT 'mandate_relations', 'mandate-relation-' || mandate || '-replaces-popescu-ion', r.mid, r.related, 'Popescu Ion', NULL, NULL, CASE WHEN r.member_id % 8 = 0 THEN 'https://x.example/alt' END
      FROM rel r JOIN mandate_ids i ON i.mid = r.mid
    UNION ALL SELECT 'memberships', 'group-membership-' || mid || '-' || gid || '-' || starts_on, mid, gid, logo_url, CAST(starts_on AS VARCHAR), CAST(ends_on AS VARCHAR), NULL FROM (SELECT DISTINCT mid, gid, starts_on, ends_on, logo_url FROM gl)
    UNION ALL SELECT 'affiliations', 'party-affiliation-' || mid || '-' || pid || '-' || starts_on, mid, pid, logo_url, CAST(starts_on AS VARCHAR), CAST(ends_on AS VARCHAR), NULL FROM pl
    UNION ALL SELECT 'committees', 'committee-membership-' || mid || '-' || {SLUG.format(x='committee_name')} || '-' || starts_on, mid, committee_name, chamber, CAST(starts_on AS VARCHAR), CAST(ends_on AS VARCHAR), NULL FROM cl"""


@query("i16_profile_tables", "I16", f"WITH {PROFILES_SQL} {PROFILE_ROWS_SQL}")
def _(t):
    return shown(ro.profile_tables(profiles(t), t.legislatures, "2002-01-01"))


@query("r19_roster_warnings", "R19", f"""WITH {PROFILES_SQL} SELECT 'missing_constituency' AS warning, count(*) AS rows FROM pr WHERE constituency IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'historical_formation', count(DISTINCT pid) FROM pl WHERE pid LIKE 'party-formation-%' HAVING count(*) > 0""")
def _(t):
    return ro.diagnosed(ro.profile_tables(profiles(t), t.legislatures, "2002-01-01"))


@query("i16_details_after_two_loads", "I16 I4", f"""WITH {PROFILES_SQL},
    again AS (SELECT DISTINCT mid FROM pr WHERE member_id % 2 = 0)
    SELECT 'members' AS "table", mid AS id, CAST(NULL AS VARCHAR) AS member_id, CASE WHEN mid IN (SELECT mid FROM again) THEN upper(display_name) ELSE display_name END AS label FROM pr
    UNION ALL SELECT 'committees', 'committee-membership-' || mid || '-' || {SLUG.format(x='committee_name')} || '-' || starts_on, mid, chamber FROM cl
      WHERE member_id % 2 = 1 OR committee_name = (SELECT min(o.committee_name) FROM cl o WHERE o.mid = cl.mid AND o.legislature_id = cl.legislature_id)""")
def _(t):
    """All profiles, then half of them again with other names and one committee each."""
    first = ro.profile_tables(profiles(t), t.legislatures, "2002-01-01")
    changed = profiles(t).where("position % 2 = 0").withColumn("name", F.upper("name")).withColumn("committee_links", F.slice("committee_links", 1, 1))
    second = ro.profile_tables(changed, t.legislatures, "2002-01-01")
    kept = ("members", "committees")
    loaded = ro.load_tables({k: first[k] for k in kept}, {k: second[k] for k in kept}, ["committees"])
    named = {"members": loaded["members"].withColumn("label", F.col("display_name")), "committees": loaded["committees"].withColumn("label", F.col("chamber"))}
    return ro.tagged(named, ["id", "member_id", "label"])


@query("g34_crawl_report", "G34", f"""WITH {PROFILES_SQL}
    SELECT 'profiles' AS section, year || ':' || chamber AS item, count(*) AS value FROM pr GROUP BY 2 UNION ALL SELECT 'missing', 'name', 0 UNION ALL SELECT 'missing', 'logo', count(*) FROM pr WHERE logo_url IS NULL
    UNION ALL SELECT 'missing', 'party', 0 UNION ALL SELECT 'missing', 'group', 0 UNION ALL SELECT 'missing', 'constituency', count(*) FROM pr WHERE constituency IS NULL
    UNION ALL SELECT 'with', 'replacement', count(*) FROM pr WHERE member_id % 4 = 0
    UNION ALL SELECT * FROM (SELECT 'shared_name', display_name, count(*) AS n FROM pr GROUP BY 2 HAVING count(*) > 1 ORDER BY n DESC, display_name LIMIT 50)
    UNION ALL SELECT 'without_constituency', 'leg' || year || ':' || chamber || ':idm' || member_id, 1 FROM pr WHERE constituency IS NULL""")
def _(t):
    return rp.crawl_report(profiles(t))


def secondary_rows(t):
    size = F.col("p_size")
    label = F.when(size % 6 == 0, "independent").when(size % 6 == 1, "—").when(size % 6 == 2, "").otherwise(F.concat(F.lit("Partidul "), "p_type"))
    return t.part.select(
        F.col("p_partkey").alias("position"), F.when(size % 2 == 0, "senate").otherwise("deputies").alias("chamber"), F.when(size % 3 == 0, "L1995").otherwise("L1997").alias("legislature_id"),
        F.concat("p_name", F.lit(" "), F.substr("p_brand", F.lit(7))).alias("name"), F.lit("").alias("normalized_name"), F.when(size > 25, F.concat(F.lit("Circ "), size.cast("string"))).alias("constituency"),
        label.alias("party_label"), F.when(size % 7 == 3, "psd").alias("party_key"), F.concat(F.lit("src-"), size.cast("string")).alias("source_id"))


FALLBACK_SQL = f"""
    r0 AS (SELECT p_partkey AS position, CASE WHEN p_size % 2 = 0 THEN 'senate' ELSE 'deputies' END AS chamber, CASE WHEN p_size % 3 = 0 THEN 'L1995' ELSE 'L1997' END AS lid, p_name || ' ' || substr(p_brand, 7) AS name,
        CASE WHEN p_size > 25 THEN 'Circ ' || p_size END AS constituency, CASE p_size % 6 WHEN 0 THEN 'independent' WHEN 1 THEN '—' WHEN 2 THEN 'Necunoscut' ELSE 'Partidul ' || p_type END AS label,
        CASE WHEN p_size % 7 = 3 THEN 'psd' END AS pk, 'src-' || p_size AS source_id FROM part),
    r1 AS (SELECT r0.*, l.starts_on, l.ends_on, substr(l.label, 1, 4) AS year, 'member-' || chamber || '-secondary-' || substr(l.label, 1, 4) || '-' || {SLUG.format(x='name')} AS base FROM r0 JOIN legislatures l ON l.id = r0.lid),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY position) AS n, coalesce(upper(pk), CASE WHEN label = '—' THEN 'Necunoscut' WHEN label = 'independent' THEN 'Neafiliați' ELSE substr(label, 1, 40) END) AS short FROM r1),
    r3 AS (SELECT *, CASE WHEN n > 1 THEN '-' || n ELSE '' END AS ending, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS mid,
        'group-' || chamber || '-' || CASE WHEN label = 'independent' THEN 'unaffiliated' ELSE coalesce(pk, {SLUG.format(x='short')}) END AS gid FROM r2)"""


@query("i17_fallback_tables", "I17", f"""WITH {FALLBACK_SQL}
    SELECT DISTINCT 'parties' AS "table", 'party-' || pk AS id, NULL AS member_id, NULL AS ref_id, short AS label, NULL AS starts_on, NULL AS ends_on, NULL AS status FROM r3 WHERE pk IS NOT NULL
    UNION ALL SELECT 'groups', gid, NULL, 'party-' || pk, CASE WHEN pk IS NOT NULL THEN 'Grup parlamentar ' || short ELSE label END, NULL, NULL, short FROM r3 QUALIFY row_number() OVER (PARTITION BY gid ORDER BY position) = 1
    UNION ALL SELECT 'members', mid, NULL, {SLUG.format(x='name')} || '-' || chamber || '-sec-' || year || ending, name, NULL, NULL, NULL FROM r3
    UNION ALL SELECT 'mandates', 'mandate-' || mid || '-' || lid || '-' || chamber, mid, lid, constituency, CAST(starts_on AS VARCHAR), CAST(ends_on AS VARCHAR), 'ended' FROM r3
    UNION ALL SELECT 'memberships', 'group-membership-' || mid || '-' || gid || '-' || lid, mid, gid, source_id, CAST(starts_on AS VARCHAR), CAST(ends_on AS VARCHAR), NULL FROM r3
    UNION ALL SELECT 'affiliations', 'party-affiliation-' || mid || '-party-' || pk || '-' || lid, mid, 'party-' || pk, source_id, CAST(starts_on AS VARCHAR), CAST(ends_on AS VARCHAR), NULL FROM r3 WHERE pk IS NOT NULL""")
def _(t):
    tables = ro.fallback_tables(secondary_rows(t), t.legislatures)
    named = {"parties": {"label": "short_name"}, "groups": {"ref_id": "party_id", "label": "name", "status": "short_name"}, "members": {"ref_id": "slug", "label": "display_name"},
             "mandates": {"ref_id": "legislature_id", "label": "constituency"}, "memberships": {"ref_id": "group_id", "label": "source_id"}, "affiliations": {"ref_id": "party_id", "label": "source_id"}}
    return ro.tagged({name: rows.withColumns({to: F.col(c) for to, c in named[name].items()}) for name, rows in tables.items()}, LONG)


# --- nested records ------------------------------------------------------------------

def nested_events(t, first, kept):
    """Events with their entities; ``kept`` tells which entities a load brings."""
    entities = t.formation_entities.where(kept).groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("entity_type", "entity_id", "role"))).alias("entities"))
    empty = F.array().cast("array<struct<entity_type:string,entity_id:string,role:string>>")
    return t.formation_events.where(first).join(entities, "id", "left").withColumn("entities", F.coalesce("entities", empty)).withColumn("position", F.col("id"))


@query("i19_events_after_two_loads", "I19", """
    SELECT 'events' AS "table", CAST(id AS VARCHAR) AS id, NULL AS event_id, CASE WHEN id % 2 = 0 THEN title || ' (2)' ELSE title END AS label FROM formation_events
    UNION ALL SELECT 'entities', event_id || '-' || entity_type || '-' || entity_id || '-' || role, CAST(event_id AS VARCHAR), role FROM formation_entities
      WHERE event_id % 2 = 1 OR (event_id % 6 <> 0 AND role = 'absorber')""")
def _(t):
    """All events, then the even ones with a new title, without their absorbed
    entities and, each third, without any."""
    child_id = lambda: F.concat_ws("-", F.col("event_id").cast("string"), "entity_type", "entity_id", "role")
    columns = t.formation_events
    events, entities = columns.where("false"), t.formation_entities.withColumn("id", child_id()).where("false")
    loads = [nested_events(t, F.lit(True), F.lit(True)),
             nested_events(t, F.col("id") % 2 == 0, (F.col("role") == "absorber") & (F.col("event_id") % 6 != 0)).withColumn("title", F.concat("title", F.lit(" (2)")))]
    for load in loads:
        events, entities = ro.merge_nested(events, entities, load, "id", "entities", child_id, "event_id", "position")
    return ro.tagged({"events": events.withColumn("label", F.col("title")), "entities": entities.withColumn("label", F.col("role"))}, ["id", "event_id", "label"])


# --- cascades and seeds ----------------------------------------------------------------

@query("i12_cascade_tables", "I12", """
    SELECT 'members' AS "table", CAST(id AS VARCHAR) AS id FROM members WHERE party_id <> 'PROMO' UNION ALL SELECT 'mandates', id FROM mandates WHERE member_id NOT IN (SELECT id FROM members WHERE party_id = 'PROMO')
    UNION ALL SELECT 'ballots', id FROM ballots WHERE member_id NOT IN (SELECT id FROM members WHERE party_id = 'PROMO')""")
def _(t):
    kept, children, _ = ig.cascade(t.members, t.members.where("party_id = 'PROMO'"), {"mandates": (t.mandates, "member_id"), "ballots": (t.ballots, "member_id")})
    return ro.tagged({"members": kept, **children}, ["id"])


@query("i14_obsolete_governments", "I14", """
    WITH gone AS (SELECT id FROM governments WHERE id NOT IN (SELECT id FROM governments WHERE name NOT LIKE '%interimar'))
    SELECT 'parents' AS "table", CAST(id AS VARCHAR) AS id FROM governments WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'alignments', id FROM government_party_alignments WHERE government_id NOT IN (SELECT id FROM gone)""")
def _(t):
    kept, children, _ = ig.drop_obsolete(t.governments, t.governments.where("name NOT LIKE '%interimar'"), {"alignments": (t.government_party_alignments, "government_id")})
    return ro.tagged({"parents": kept, **children}, ["id"])


@query("i13_reset_counts", "I13", """
    SELECT 'mandates' AS model, count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM mandates UNION ALL SELECT 'memberships', count(*), 0 FROM memberships""")
def _(t):
    emptied, before = ig.reset({"mandates": t.mandates, "memberships": t.memberships})
    after = ig.reset(emptied)[1].withColumnRenamed("row_count", "rows_after")
    return before.withColumnRenamed("row_count", "rows_before").join(after, "model")


@query("i18_seeded_tables", "I18", """
    SELECT 'governments' AS "table", CAST(id AS VARCHAR) AS id, name AS label, CAST(starts_on AS VARCHAR) AS starts_on, CAST(ends_on AS VARCHAR) AS ends_on FROM governments WHERE id IN (SELECT government_id FROM government_party_alignments)
    UNION ALL SELECT 'roles', id || '-PM', CAST(prime_minister_id AS VARCHAR), CAST(starts_on AS VARCHAR), CAST(ends_on AS VARCHAR) FROM governments WHERE id IN (SELECT government_id FROM government_party_alignments)
    UNION ALL SELECT 'events', id || '-government_invested', 'government_invested', CAST(starts_on AS VARCHAR), NULL FROM governments WHERE id IN (SELECT government_id FROM government_party_alignments)
    UNION ALL SELECT 'events', id || '-government_ended', 'government_ended', CAST(ends_on AS VARCHAR), NULL FROM governments WHERE ends_on IS NOT NULL AND id IN (SELECT government_id FROM government_party_alignments)
    UNION ALL SELECT 'alignments', a.government_id || '-' || a.party_id, a.alignment, CAST(CASE WHEN a.alignment = 'support' THEN g.starts_on ELSE a.starts_on END AS VARCHAR), CAST(coalesce(a.ends_on, g.ends_on) AS VARCHAR)
      FROM government_party_alignments a JOIN governments g ON g.id = a.government_id""")
def _(t):
    own = F.when(F.col("alignment") != "support", F.col("starts_on"))
    nested = t.government_party_alignments.groupBy(F.col("government_id").alias("id")).agg(
        F.collect_list(F.struct("party_id", "alignment", own.alias("starts_on"), "ends_on")).alias("alignments"))
    seeds = t.governments.join(nested, "id").withColumn("roles", F.array(F.struct(F.col("prime_minister_id").alias("person"), F.lit("PM").alias("title"))))
    governments, roles, aligned = ig.seed_governments(seeds)
    key = lambda c: F.concat_ws("-", F.col("government_id").cast("string"), c)
    return ro.tagged({
        "governments": governments.withColumn("label", F.col("name")), "roles": roles.select(key("title").alias("id"), F.col("person").alias("label"), "starts_on", "ends_on"),
        "events": ig.government_events(governments).select(key("event_type").alias("id"), F.col("event_type").alias("label"), F.col("occurred_on").alias("starts_on")),
        "alignments": aligned.select(key("party_id").alias("id"), F.col("alignment").alias("label"), "starts_on", "ends_on")}, ["id", "label", "starts_on", "ends_on"])
