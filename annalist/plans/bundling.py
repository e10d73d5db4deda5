"""Queries over bundles, files, seeds, versioned tables and merge streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from annalist.functions.dates import MONTHS
from annalist.operators import bundles as bd
from annalist.operators import ingest as ig
from annalist.operators.readmodels import bill_summary
from annalist.plans.intervals import HISTORY_SQL, history
from annalist.plans.readmodels import SUMMARY_SQL, summaries
from annalist.plans.registry import query
from annalist.session import shared_dir
from annalist.sources import files, versions
from annalist.plans.streams import table_stream
from annalist.streaming import buckets, jobs


def fresh_root(t):
    return f"{shared_dir(t.spark)}/annalist/{uuid.uuid4().hex}"


@query("b18_timeline_events", "B18", """
    SELECT id, starts_on AS on_day, 'government_invested' AS event_type FROM governments UNION ALL SELECT id, ends_on, 'government_ended' FROM governments WHERE ends_on IS NOT NULL""")
def _(t):
    g = t.governments
    events = g.select("id", F.col("starts_on").alias("on_day"), F.lit("government_invested").alias("event_type")).unionByName(
        g.where("ends_on IS NOT NULL").select("id", F.col("ends_on").alias("on_day"), F.lit("government_ended").alias("event_type"))).unionByName(
        t.formation_events.select("id", F.col("occurred_on").alias("on_day"), "event_type"))
    return bd.timeline_events(events)


@query("b22_registry_subset", "B22", "SELECT id, party_id AS kind, CAST(substr(last_name, 2) AS INT) AS position FROM members WHERE party_id = 'PROMO' AND last_name IN ('M3', 'M7', 'M11')")
def _(t):
    rows = t.members.select("id", F.col("party_id").alias("kind"), F.substr("last_name", F.lit(2)).cast("int").alias("position"))
    return bd.registry_subset(rows, "PROMO", [3, 7, 11])


@query("g19_activity_from_detail_rows", "G19", f"""
    SELECT member_id, CAST(sum(f) AS BIGINT) AS n_for, CAST(sum(a) AS BIGINT) AS n_against, CAST(sum(ab) AS BIGINT) AS n_abstention, CAST(sum(p) AS BIGINT) AS n_present_not_voting,
      CAST(sum(x) AS BIGINT) AS n_absent, CAST(sum(u) AS BIGINT) AS n_unknown, CAST(sum(pr) AS BIGINT) AS proposals, CAST(sum(c) AS BIGINT) AS committees, CAST(sum(r) AS BIGINT) AS roles FROM (
      SELECT member_id, (choice = 'for')::INT AS f, (choice = 'against')::INT AS a, (choice = 'abstention')::INT AS ab, (choice = 'present_not_voting')::INT AS p, (choice = 'absent')::INT AS x,
        (choice = 'unknown')::INT AS u, 0 AS pr, 0 AS c, 0 AS r FROM ballots
      UNION ALL SELECT member_id, 0, 0, 0, 0, 0, 0, 1, 0, 0 FROM sponsors
      UNION ALL SELECT member_id, 0, 0, 0, 0, 0, 0, 0, (type = 'committee')::INT, (type = 'role')::INT FROM ({HISTORY_SQL})) GROUP BY 1""")
def _(t):
    return bd.activity_from_rows(t.ballots, t.sponsors, history(t))


@query("r20_members_by_legacy_slug", "R20", """
    WITH w AS (SELECT DISTINCT slug || '-deputies-x' AS legacy, slug AS base FROM members)
    SELECT w.legacy, m.id FROM w JOIN members m ON m.slug = w.base OR starts_with(m.slug, w.base || '-')
    QUALIFY row_number() OVER (PARTITION BY w.legacy ORDER BY m.id % 5 DESC, length(m.slug), m.id) = 1""")
def _(t):
    wanted = t.members.select(F.concat("slug", F.lit("-deputies-x")).alias("slug")).distinct()
    return bd.by_legacy_slug(wanted, t.members.select("id", "slug", (F.col("id") % 5).alias("rank")))


@query("r21_bill_page_sections", "R21", """
    SELECT bill_id, 'events' AS section, CAST(id AS VARCHAR) AS item, occurred_on AS "on" FROM bill_events UNION ALL SELECT bill_id, 'votes', CAST(id AS VARCHAR), held_on FROM votes WHERE bill_id IS NOT NULL
    UNION ALL SELECT bill_id, 'sponsors', CAST(member_id AS VARCHAR), NULL FROM sponsors UNION ALL SELECT bill_no, 'documents', CAST(id AS VARCHAR), NULL FROM docs""")
def _(t):
    none = F.lit(None).cast("date").alias("on")
    return bd.sections({
        "events": t.bill_events.select("bill_id", F.col("id").alias("item"), F.col("occurred_on").alias("on")),
        "votes": t.votes.where("bill_id IS NOT NULL").select("bill_id", F.col("id").alias("item"), F.col("held_on").alias("on")),
        "sponsors": t.sponsors.select("bill_id", F.col("member_id").alias("item"), none),
        "documents": t.docs.select(F.col("bill_no").alias("bill_id"), F.col("id").alias("item"), none)}, "bill_id")


def profile_pages(t):
    """One page per term: heading, validation date, one group with its period."""
    month = lambda c: F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(c))
    period = F.concat_ws(" ", F.lit("din"), month("starts_on"), F.year("starts_on").cast("string"),
                         F.when(F.col("ends_on").isNotNull(), F.concat_ws(" ", F.lit("până în"), month("ends_on"), F.year("ends_on").cast("string"))))
    html = F.concat(F.lit("<html><body><h1>"), F.col("id"), F.lit("</h1><p>data validării: "), F.date_format("starts_on", "d.MM.yyyy"),
                    F.lit("</p><table><tr><th>Grup</th><th>Perioada</th></tr><tr><td>"), "group_id", F.lit("</td><td>"), period, F.lit("</td></tr></table></body></html>"))
    return t.memberships.select((F.col("member_id") * 10 + F.split("id", "-")[1].cast("int")).alias("page_id"), F.lit("https://www.chamber.example/profil").alias("url"), html.alias("html"))


@query("x20_profile_memberships", "X20 F13", """
    SELECT member_id * 10 + CAST(split_part(id, '-', 2) AS INT) AS page_id, group_id AS group_name, CAST(date_trunc('month', starts_on) AS DATE) AS starts_on,
      CASE WHEN CAST(date_trunc('month', ends_on) AS DATE) - 1 >= CAST(date_trunc('month', starts_on) AS DATE) THEN CAST(CAST(date_trunc('month', ends_on) AS DATE) - 1 AS DATE) END AS ends_on FROM memberships""")
def _(t):
    return bd.profiles(profile_pages(t))[1]


@query("x20_profile_members", "X20", "SELECT member_id * 10 + CAST(split_part(id, '-', 2) AS INT) AS page_id, id AS display_name, starts_on FROM memberships")
def _(t):
    return bd.profiles(profile_pages(t))[0]


@query("i20_published_bill_summary", "I20 G1", SUMMARY_SQL)
def _(t):
    root = fresh_root(t)
    versions.publish(root, {"bill_summary": summaries(t)})
    return versions.read(t.spark, root, "bill_summary")


@query("i22_assets_purged", "I22", """
    SELECT a.id, CASE WHEN m.legislature_id = 'L1997' AND a.logo_url IS NOT NULL THEN 'pending' ELSE 'stored' END AS fetch_status,
      CASE WHEN m.legislature_id = 'L1997' AND a.logo_url IS NOT NULL THEN NULL ELSE a.logo_url END AS storage_path FROM affiliations a JOIN mandates m ON m.id = a.id""")
def _(t):
    assets = t.affiliations.join(t.mandates.select("id", "legislature_id"), "id").select(
        "id", F.when(F.col("logo_url").isNotNull(), "party_logo").otherwise("photo").alias("asset_type"), "legislature_id", F.lit("stored").alias("fetch_status"), F.col("logo_url").alias("storage_path"))
    return ig.purge(assets, "party_logo", "L1997").select("id", "fetch_status", "storage_path")


@query("u4_discoveries_merged", "U4 I5", """
    WITH inc AS (SELECT CASE WHEN page_id % 3 = 1 THEN NULL ELSE url END AS source_url, CASE WHEN page_id % 3 = 1 AND page_id % 4 <> 0 THEN 'L' || page_id || '/1998' END AS official_id,
        CASE page_id % 2 WHEN 0 THEN 'senate' ELSE 'deputies' END AS chamber, CASE WHEN page_id % 7 = 1 THEN 'bill' WHEN page_id % 3 = 0 THEN 'bill' ELSE 'vote' END AS kind FROM pages),
      placed AS (SELECT i.*, coalesce((SELECT min(d.id) FROM discoveries d WHERE d.source_url = i.source_url),
        (SELECT min(d.id) FROM discoveries d WHERE d.official_id = i.official_id AND d.chamber = i.chamber AND d.kind = i.kind)) AS id FROM inc i),
      hit AS (SELECT id, max(kind) AS kind FROM placed WHERE id IS NOT NULL GROUP BY 1)
    SELECT d.id, d.source_url, d.official_id, d.chamber, CASE WHEN h.id IS NULL THEN d.status ELSE 'imported' END AS status, d.first_seen,
      CASE WHEN h.id IS NULL THEN d.last_seen ELSE greatest(d.last_seen, DATE '2001-01-01') END AS last_seen FROM discoveries d LEFT JOIN hit h ON h.id = d.id
    UNION ALL SELECT NULL, NULL, official_id, chamber, 'imported', DATE '2001-01-01', DATE '2001-01-01' FROM placed WHERE id IS NULL GROUP BY official_id, chamber, kind""")
def _(t):
    """Streamed pages by address, by chamber, kind and number, and by a hash of
    what there is; the whole table after the merge, new rows without their number."""
    root = fresh_root(t)
    n = F.col("page_id")
    incoming = table_stream(t, "pages").select(
        F.when(n % 3 != 1, F.col("url")).alias("source_url"), F.when((n % 3 == 1) & (n % 4 != 0), F.concat(F.lit("L"), n.cast("string"), F.lit("/1998"))).alias("official_id"),
        F.when(n % 2 == 0, "senate").otherwise("deputies").alias("chamber"), F.when((n % 7 == 1) | (n % 3 == 0), "bill").otherwise("vote").alias("kind"),
        F.lit("imported").alias("status"), F.to_date(F.lit("2001-01-01")).alias("seen_on"))
    buckets.create(t.discoveries, f"{root}/t", ["id"])
    jobs.merge_discoveries(incoming, f"{root}/t", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    merged = buckets.stored(t.spark, f"{root}/t")
    known = t.discoveries.select("id", F.lit(True).alias("known"))
    return merged.join(known, "id", "left").select(F.when(F.col("known"), F.col("id")).alias("id"), "source_url", "official_id", "chamber", "status", "first_seen", "last_seen")


@query("u5_bill_summary_refreshed", "U5 G1", SUMMARY_SQL)
def _(t):
    root = fresh_root(t)
    stale = summaries(t).withColumn("vote_count", F.lit(-1).cast("long"))
    buckets.create(stale, f"{root}/t", ["bill_id"])
    touched = table_stream(t, "customer").select(F.col("c_custkey").alias("bill_id"))

    def rebuild(keys):
        bills = t.bills.join(keys.select(F.col("bill_id").alias("id")), "id", "left_semi")
        return bill_summary(bills, t.bill_events.join(keys, "bill_id", "left_semi"), t.votes.join(keys, "bill_id", "left_semi"), t.sources)

    jobs.refresh_touched(touched, "bill_id", f"{root}/t", rebuild, f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return buckets.stored(t.spark, f"{root}/t")


@query("a2_json_lines_round_trip", "A2 A3 A5", "SELECT id, title, senate_identifier FROM bills WHERE senate_identifier IS NOT NULL")
def _(t):
    path = fresh_root(t)
    files.write_lines(t.bills.select("id", "title", "senate_identifier"), path)
    return files.read_lines(t.spark, path, "id long, title string, senate_identifier string", ["senate_identifier"])


@query("a7_warnings_round_trip", "A7", "SELECT CAST(id AS VARCHAR) AS id, title || ' \"x\"' AS title, status || '; ' || slug AS notes FROM bills")
def _(t):
    path = fresh_root(t)
    files.write_warnings(t.bills.select("id", F.concat("title", F.lit(' "x"')).alias("title"), F.array("status", "slug").alias("notes")), path, ["notes"])
    return t.spark.read.schema("id string, title string, notes string").options(header=True, quoteAll=True, escape='"').csv(path)


@query("a4_nested_document", "A4", """
    SELECT 'parent' AS "table", CAST(id AS VARCHAR) AS id, title AS label, NULL AS role FROM formation_events
    UNION ALL SELECT 'child', CAST(event_id AS VARCHAR), entity_id, role FROM formation_entities""")
def _(t):
    """The events and their entities as one curated document, read back as two tables."""
    path = fresh_root(t)
    nested = t.formation_entities.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("entity_id", "role"))).alias("entities"))
    whole = t.formation_events.select("id", "title").join(nested, "id").agg(F.to_json(F.collect_list(F.struct("id", "title", "entities"))).alias("value"))
    whole.write.text(path)
    parents, children = files.read_nested(t.spark, path, "id long, title string, entities array<struct<entity_id:string,role:string>>", "entities")
    text = lambda c: F.col(c).cast("string")
    return parents.select(F.lit("parent").alias("table"), text("id").alias("id"), F.col("title").alias("label"), F.lit(None).cast("string").alias("role")).unionByName(
        children.select(F.lit("child").alias("table"), text("parent_id").alias("id"), F.col("entity_id").alias("label"), "role"))


@query("a6_report_round_trip", "A6", "SELECT CAST(id AS VARCHAR) AS id, title || ' \"x\", y' AS title, title || ' \"x\", y' AS title_in_table FROM bills WHERE status = 'BUILDING'")
def _(t):
    path = fresh_root(t)
    files.write_report(t.bills.where("status = 'BUILDING'").select(F.col("id").cast("string").alias("id"), F.concat("title", F.lit(' "x", y')).alias("title")), path)
    rows = t.spark.read.schema("id string, title string").json(f"{path}/json")
    table = t.spark.read.schema("id string, title_in_table string").options(header=True, quoteAll=True, escape='"', enforceSchema=True).csv(f"{path}/table")
    return rows.join(table, "id")


@query("a9_pages_decoded", "A9", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'utf-8' WHEN page_id % 3 = 1 THEN 'utf-16be' ELSE 'iso-8859-2' END AS charset,
      CASE WHEN page_id % 3 = 0 THEN repeat(' ', 6000) || '<meta charset="utf-8">' || html WHEN page_id % 3 = 1 THEN html ELSE regexp_replace(replace(html, 'charset', 'chars'), '[^\x00-\x7f]', '', 'g') END AS html FROM pages""")
def _(t):
    """A meta tag far into the body, a content type, and neither."""
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" " * 6000 + '<meta charset="utf-8">'), "html")).when(
        F.col("page_id") % 3 == 1, F.col("html")).otherwise(F.regexp_replace(F.replace(F.col("html"), F.lit("charset"), F.lit("chars")), "[^\\x00-\\x7f]", ""))
    raw = t.pages.select("page_id", F.when(F.col("page_id") % 3 == 1, F.encode(text, "UTF-16BE")).otherwise(F.encode(text, "UTF-8")).alias("body"))
    named = raw.withColumn("charset", files.charset_of(F.when(F.col("page_id") % 3 == 1, "text/html; charset=UTF-16BE"), F.col("body")))
    return files.decode_bytes(named, "body", "charset").select("page_id", "charset", "html")


@query("x26_career_links", "X25 X26", """
    WITH e AS (SELECT DISTINCT l.l_partkey AS a, m.b FROM lineitem l JOIN (SELECT l_orderkey, l_suppkey, min(l_partkey) AS b FROM lineitem GROUP BY 1, 2) m ON m.l_orderkey = l.l_orderkey AND m.l_suppkey = l.l_suppkey WHERE l.l_partkey <> m.b)
    SELECT 'edge' AS kind, 'leg2000:cam2:idm' || a AS src, 'leg2000:cam2:idm' || b AS dst FROM e
    UNION ALL SELECT 'replaces', 'leg2000:cam2:idm' || a, 'leg2000:cam2:idm' || b FROM e WHERE b % 3 = 0
    UNION ALL SELECT DISTINCT 'photo', 'leg2000:cam2:idm' || a, 'https://www.chamber.example/foto/' || a || '.jpg' FROM e
    UNION ALL SELECT DISTINCT 'party_logo', 'leg2000:cam2:idm' || a, 'https://www.chamber.example/sigle/p.png?x=1' FROM e""")
def _(t):
    """Profile pages that link to the parts the same supplier delivers."""
    from annalist.operators import pages as pg
    from annalist.plans.resolving import career_edges
    address = lambda c: F.concat(F.lit("https://www.chamber.example/mp?leg=2000&cam=2&idm="), F.col(c).cast("string"))
    said = F.when(F.col("dst") % 3 == 0, "Înlocuiește pe").otherwise("alt mandat")
    anchors = career_edges(t).withColumn("a", F.concat(F.lit("<a href=\""), address("dst"), F.lit("\">"), said, F.lit("</a>")))
    images = F.concat(F.lit("<a href=\"/foto/"), F.col("src").cast("string"), F.lit(".jpg\">foto</a><a href=\"/sigle/p.png?x=1\">sigla</a>"))
    built = anchors.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("a")), "").alias("links"))
    pages = built.select(F.col("src").alias("page_id"), address("src").alias("url"), F.concat("links", images).alias("html"))
    edges, replaced, assets = pg.career_links(pages)
    tag = lambda rows, kind, dst: rows.select(kind.alias("kind"), "src", F.col(dst).alias("dst"))
    return tag(edges, F.lit("edge"), "dst").unionByName(tag(replaced, F.lit("replaces"), "replaced")).unionByName(tag(assets, F.col("asset_type"), "href"))


@query("r21_member_page_sections", "R21", """
    WITH p AS (SELECT id AS member_id, coalesce('p' || person_id, 'm' || id) AS person FROM members),
      md AS (SELECT p.person, m.*, l.starts_on AS l_s, l.ends_on AS l_e FROM mandates m JOIN p USING (member_id) JOIN legislatures l ON l.id = m.legislature_id),
      sel AS (SELECT person, arg_max(legislature_id, l_s) AS lid, max(l_s) AS l_s, arg_max(l_e, l_s) AS l_e FROM md GROUP BY 1),
      cur AS (SELECT md.person, md.member_id, md.id, md.starts_on, least(md.ends_on, md.l_e) AS until FROM md JOIN sel ON sel.person = md.person AND sel.lid = md.legislature_id
        QUALIFY row_number() OVER (PARTITION BY md.person ORDER BY md.starts_on DESC, md.id DESC) = 1)
    SELECT person, 'related' AS section, CAST(member_id AS VARCHAR) AS item, CAST(NULL AS DATE) AS "on" FROM p
    UNION ALL SELECT person, 'mandates', id, starts_on FROM md UNION ALL SELECT person, 'memberships', s.id, s.starts_on FROM memberships s JOIN p USING (member_id)
    UNION ALL SELECT person, 'affiliations', a.id, a.starts_on FROM affiliations a JOIN p USING (member_id) UNION ALL SELECT person, 'committees', c.id, c.starts_on FROM committee_terms c JOIN p USING (member_id)
    UNION ALL SELECT person, 'roles', r.id, r.starts_on FROM role_terms r JOIN p USING (member_id) UNION ALL SELECT person, 'selected_legislature', lid, l_s FROM sel UNION ALL SELECT person, 'mandate', id, starts_on FROM cur
    UNION ALL SELECT person, 'membership', sid, s_s FROM (SELECT cur.person, s.id AS sid, s.starts_on AS s_s FROM cur JOIN memberships s ON s.member_id = cur.member_id AND s.starts_on <= cur.until AND (s.ends_on IS NULL OR s.ends_on >= cur.starts_on)
      QUALIFY row_number() OVER (PARTITION BY cur.person ORDER BY s.starts_on DESC, s.id DESC) = 1)
    UNION ALL SELECT p.person, 'votes', b.id, v.held_on FROM ballots b JOIN p USING (member_id) JOIN votes v ON v.id = b.vote_id JOIN sel ON sel.person = p.person AND v.held_on >= sel.l_s AND v.held_on < sel.l_e
    UNION ALL SELECT DISTINCT p.person, 'sponsored', CAST(s.bill_id AS VARCHAR), NULL FROM sponsors s JOIN p USING (member_id) JOIN bill_events e ON e.bill_id = s.bill_id JOIN sel ON sel.person = p.person AND e.occurred_on >= sel.l_s AND e.occurred_on < sel.l_e""")
def _(t):
    return bd.member_sections(t.members, t.mandates, t.legislatures, t.memberships, t.affiliations, t.committee_terms, t.role_terms, t.ballots, t.votes, t.sponsors, t.bill_events)
