"""Queries over incremental ingest, reports and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import ingest as ig
from annalist.operators import reports as rp
from annalist.operators import sets as st
from annalist.plans.registry import query


def bill_changes(t):
    """Changed rows for even keys, and new rows in place of the odd ones."""
    moved = F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1000000)
    return t.bills.withColumn("status", F.concat(F.col("status"), F.lit("*"))).withColumn("id", moved)


CHANGES = "(SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN id ELSE id + 1000000 END AS id, status || '*' AS status) FROM bills)"
SHOWN = ["id", "title", "status"]


@query("i1_upsert_by_key", "I1", f"SELECT id, title, status FROM bills WHERE id NOT IN (SELECT id FROM {CHANGES}) UNION ALL SELECT id, title, status FROM {CHANGES}")
def _(t):
    return ig.upsert(t.bills.select(*SHOWN), bill_changes(t).select(*SHOWN), ["id"])


@query("i2_partial_upsert", "I2", f"""
    SELECT coalesce(b.id, c.id) AS id, CASE WHEN b.id IS NULL THEN c.title ELSE b.title END AS title, CASE WHEN c.id IS NULL THEN b.status ELSE c.status END AS status
    FROM bills b FULL JOIN (SELECT id, upper(title) AS title, status FROM {CHANGES}) c ON c.id = b.id""")
def _(t):
    return ig.partial_upsert(t.bills.select(*SHOWN), bill_changes(t).select("id", F.upper("title").alias("title"), "status"), ["id"], ["status"])


@query("i3_insert_missing", "I3", f"SELECT id, title, status FROM bills UNION ALL SELECT id, title, status FROM {CHANGES} WHERE id NOT IN (SELECT id FROM bills)")
def _(t):
    return ig.insert_missing(t.bills.select(*SHOWN), bill_changes(t).select(*SHOWN), ["id"])


@query("i4_children_replaced", "I4", """
    SELECT id, bill_id, label FROM bill_events WHERE bill_id NOT IN (SELECT bill_id FROM bill_events WHERE label = 'Adoptat')
    UNION ALL SELECT id, bill_id, 'Nou' FROM bill_events WHERE label = 'Adoptat'""")
def _(t):
    rows = t.bill_events.select("id", "bill_id", "label")
    return ig.replace_children(rows, rows.where("label = 'Adoptat'").withColumn("label", F.lit("Nou")), "bill_id")


@query("i5_discovery_upsert", "I5 F43", """
    WITH inc AS (SELECT CASE WHEN id % 3 = 0 THEN source_url || '&new' ELSE source_url END AS source_url, CASE WHEN id % 7 = 0 THEN NULL ELSE official_id END AS official_id,
        chamber, kind, 'imported' AS status, DATE '2001-01-01' AS seen_on FROM discoveries),
      placed AS (SELECT i.*, coalesce((SELECT min(d.id) FROM discoveries d WHERE d.source_url = i.source_url),
        (SELECT min(d.id) FROM discoveries d WHERE d.official_id = i.official_id AND d.chamber = i.chamber AND d.kind = i.kind)) AS id FROM inc i),
      m AS (SELECT id, arg_max(source_url, source_url) AS source_url, arg_max(official_id, source_url) FILTER (official_id IS NOT NULL) AS official_id FROM placed WHERE id IS NOT NULL GROUP BY 1)
    SELECT d.id, coalesce(m.source_url, d.source_url) AS source_url, coalesce(m.official_id, d.official_id) AS official_id, d.chamber, d.kind,
      CASE WHEN m.id IS NULL THEN d.status ELSE 'imported' END AS status, d.failure_count, d.first_seen, CASE WHEN m.id IS NULL THEN d.last_seen ELSE greatest(d.last_seen, DATE '2001-01-01') END AS last_seen
    FROM discoveries d LEFT JOIN m ON m.id = d.id
    UNION ALL SELECT NULL, source_url, max(official_id), any_value(chamber), any_value(kind), 'imported', 0, DATE '2001-01-01', DATE '2001-01-01' FROM placed WHERE id IS NULL GROUP BY source_url""")
def _(t):
    changed = t.discoveries.select(
        F.when(F.col("id") % 3 == 0, F.concat("source_url", F.lit("&new"))).otherwise(F.col("source_url")).alias("source_url"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("official_id")).alias("official_id"), "chamber", "kind",
        F.lit("imported").alias("status"), F.to_date(F.lit("2001-01-01")).alias("seen_on"))
    # a new row's number is a hash that SQL lacks; it is shown as null
    known = t.discoveries.select("id", F.lit(True).alias("known"))
    return ig.upsert_discoveries(t.discoveries, changed).join(known, "id", "left").withColumn("id", F.when(F.col("known"), F.col("id"))).drop("known")


OUTCOMES = "(SELECT id, CASE id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'imported' WHEN 2 THEN 'partial' ELSE 'skipped' END AS outcome FROM discoveries WHERE status <> 'skipped')"


def outcomes(t):
    kind = F.when(F.col("id") % 4 == 0, "failed").when(F.col("id") % 4 == 1, "imported").when(F.col("id") % 4 == 2, "partial").otherwise("skipped")
    return t.discoveries.where("status <> 'skipped'").select("id", kind.alias("outcome"))


@query("i6_outcomes_marked", "I6", f"""
    SELECT d.id, coalesce(o.outcome, d.status) AS status, CASE WHEN o.outcome = 'failed' THEN d.failure_count + 1 WHEN o.outcome IS NOT NULL THEN 0 ELSE d.failure_count END AS failure_count,
      CASE WHEN o.outcome IN ('imported', 'partial') THEN DATE '2001-02-03' END AS imported_on FROM discoveries d LEFT JOIN {OUTCOMES} o ON o.id = d.id""")
def _(t):
    queue = t.discoveries.select("id", "status", "failure_count", F.lit(None).cast("date").alias("imported_on"))
    return ig.mark_outcomes(queue, outcomes(t), "2001-02-03")


@query("i7_retry_gate", "I7", "SELECT id, failure_count, CASE WHEN failure_count < 3 THEN 'run' ELSE 'skipped' END AS gate FROM discoveries")
def _(t):
    return ig.retry_gate(t.discoveries.select("id", "failure_count"), 3)


@query("i8_run_summary", "I8", f"""
    SELECT run_id, count(*) FILTER (outcome <> 'failed') AS discovered, count(error) AS errors, count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'partial') AS partial,
      count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped,
      CASE WHEN count(*) FILTER (outcome = 'failed') > 0 AND count(*) FILTER (outcome = 'imported') = 0 AND count(*) FILTER (outcome <> 'failed') = 0 THEN 'failed'
        WHEN count(*) FILTER (outcome IN ('failed', 'partial')) > 0 OR count(error) > 0 THEN 'partial' ELSE 'completed' END AS status
    FROM (SELECT id % 12 AS run_id, outcome, CASE WHEN id % 24 = 13 THEN 'timeout' END AS error FROM {OUTCOMES}) GROUP BY 1""")
def _(t):
    return ig.run_summary(outcomes(t).select((F.col("id") % 12).alias("run_id"), "outcome", F.when(F.col("id") % 24 == 13, "timeout").alias("error")))


@query("i9_key_range", "I9", """
    SELECT y AS year, p AS prefix, n AS number, p || n || '/' || y AS key FROM (SELECT year(held_on) AS y, count(*) // 10 AS last FROM votes GROUP BY 1) s,
      (VALUES ('L'), ('B')) v(p), unnest(generate_series(1, s.last)) u(n)""")
def _(t):
    spans = t.votes.groupBy(F.year("held_on").alias("year")).agg(F.count(F.lit(1)).alias("n")).select(
        "year", F.lit(1).cast("long").alias("first"), F.floor(F.col("n") / 10).alias("last"))
    return ig.key_range(spans, ["L", "B"])


@query("i10_terms_from_ballots", "I10", "SELECT member_id, group_id, min(held_on) AS starts_on FROM ballots b JOIN votes v ON v.id = b.vote_id GROUP BY 1, 2")
def _(t):
    return ig.derived_terms(t.ballots.join(t.votes.select(F.col("id").alias("vote_id"), "held_on"), "vote_id"))


@query("i11_values_assigned", "I11", "SELECT m.id, coalesce(x.person_id, m.person_id) AS person_id FROM members m LEFT JOIN (SELECT p_partkey AS id, p_partkey AS person_id FROM part WHERE p_size > 25) x ON x.id = m.id")
def _(t):
    return ig.assign(t.members.select("id", "person_id"), t.part.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("person_id")), "id", "person_id")


@query("i12_cascade_counts", "I12", """
    WITH d AS (SELECT id FROM members WHERE party_id = 'PROMO')
    SELECT 'parents' AS child, count(*) AS deleted FROM d UNION ALL SELECT 'mandates', count(*) FROM mandates WHERE member_id IN (SELECT id FROM d)
    UNION ALL SELECT 'ballots', count(*) FROM ballots WHERE member_id IN (SELECT id FROM d)""")
def _(t):
    _, _, counts = ig.cascade(t.members, t.members.where("party_id = 'PROMO'"), {"mandates": (t.mandates, "member_id"), "ballots": (t.ballots, "member_id")})
    return counts


@query("i15_review_upsert", "I15", """
    SELECT 'ocr:' || doc_id AS issue_key, CASE quality WHEN 0 THEN 'open' ELSE 'accepted' END AS status, CASE WHEN quality = 0 THEN NULL ELSE DATE '2001-01-01' END AS reviewed_at FROM labels
    UNION ALL SELECT 'ocr:' || doc_id, 'open', NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    stored = t.documents.select(F.concat(F.lit("ocr:"), F.col("doc_id").cast("string")).alias("issue_key"), F.lit("open").alias("status"), F.lit(None).cast("date").alias("reviewed_at"))
    fresh = t.doc_reviews.select(F.concat(F.lit("ocr:"), F.col("doc_id").cast("string")).alias("issue_key"), "status", F.to_date(F.lit("2001-01-01")).alias("reviewed_at"))
    return ig.upsert_reviews(stored, fresh)


@query("i21_link_frontier", "I21", """
    WITH RECURSIVE e AS (SELECT DISTINCT l.l_partkey AS src, m.b AS dst FROM lineitem l JOIN (SELECT l_orderkey, l_suppkey, min(l_partkey) AS b FROM lineitem GROUP BY 1, 2) m
        ON m.l_orderkey = l.l_orderkey AND m.l_suppkey = l.l_suppkey WHERE l.l_partkey <> m.b),
      w(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 50 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node JOIN part p ON p.p_partkey = w.node AND p.p_size > 5 WHERE w.depth < 40)
    SELECT node, min(depth) AS depth, any_value(p.p_size > 5) AS fetched FROM w JOIN part p ON p.p_partkey = w.node GROUP BY 1""")
def _(t):
    from annalist.plans.resolving import career_edges
    node = F.col("p_partkey").alias("node")
    return ig.frontier(career_edges(t), t.part.where("p_size = 50").select(node), t.part.where("p_size > 5").select(node))


# --- reports and sets -------------------------------------------------------------

@query("g25_queue_by_status", "G25", """
    SELECT kind, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed,
      count(*) FILTER (status = 'imported') AS imported FROM discoveries GROUP BY 1""")
def _(t):
    return rp.status_pivot(t.discoveries, "kind", "status", ["pending", "partial", "failed", "imported"])


@query("g35_inventory_report", "G35 G36", """
    SELECT kind, chamber, count(*) AS rows, count(DISTINCT source_url) AS distinct_values FROM discoveries GROUP BY GROUPING SETS ((kind), (chamber), ())""")
def _(t):
    return rp.grouped_counts(t.discoveries, [["kind"], ["chamber"], []], "source_url")


@query("g34_missing_fields", "G34", """
    SELECT legislature_id, chamber, count(*) AS rows, count(*) FILTER (constituency IS NULL) AS missing_constituency, count(*) FILTER (ends_on IS NULL) AS missing_ends_on FROM mandates GROUP BY 1, 2""")
def _(t):
    return rp.missing_fields(t.mandates, ["legislature_id", "chamber"], ["constituency", "ends_on"])


@query("g30_refresh_candidates", "G30", """
    SELECT b.id, min(s.source_url) AS url FROM bills b JOIN sources s ON s.id = b.source_id WHERE b.id NOT IN (SELECT bill_id FROM bill_events WHERE label = 'Adoptat') GROUP BY 1""")
def _(t):
    urls = t.bills.join(t.sources.select(F.col("id").alias("source_id"), "source_url"), "source_id").select(F.col("id").alias("parent_id"), F.col("source_url").alias("url"))
    return rp.refresh_candidates(t.bills.select("id"), t.bill_events.where("label = 'Adoptat'").select(F.col("bill_id").alias("parent_id")), urls)


@query("g33_superseded_rows", "G33", """
    SELECT legislature_id, chamber, constituency, count(*) AS rows FROM mandates m WHERE EXISTS (SELECT 1 FROM mandates c WHERE c.legislature_id = m.legislature_id AND c.chamber = m.chamber AND c.constituency = 'Circ 8')
    GROUP BY 1, 2, 3""")
def _(t):
    return rp.superseded(t.mandates, t.mandates.where("constituency = 'Circ 8'"), ["legislature_id", "chamber"], "constituency")


DOUBLES = """(SELECT id FROM bills WHERE deputies_identifier IN (SELECT deputies_identifier FROM bills GROUP BY 1 HAVING count(*) > 1))"""


CHILDREN_SQL = {"events": "SELECT bill_id FROM bill_events", "procedure_steps": "SELECT bill_id FROM bill_events WHERE label = 'Raport'", "documents": "SELECT bill_no AS bill_id FROM docs",
                "sponsors": "SELECT bill_id FROM sponsors", "votes": "SELECT bill_id FROM votes WHERE bill_id IS NOT NULL", "text_chunks": "SELECT bill_no AS bill_id FROM docs WHERE length(text) > 500"}


def doubles(t):
    shared = t.bills.where("deputies_identifier IS NOT NULL").groupBy("deputies_identifier").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return t.bills.join(shared, "deputies_identifier", "left_semi")


def children(t):
    docs = t.docs.select(F.col("bill_no").alias("bill_id"), "text")
    return {"events": t.bill_events, "procedure_steps": t.bill_events.where("label = 'Raport'"), "documents": docs, "sponsors": t.sponsors,
            "votes": t.votes.where("bill_id IS NOT NULL"), "text_chunks": docs.where("length(text) > 500")}


@query("g29_dependent_rows", "G29", " UNION ALL ".join(
    f"SELECT '{name}' AS child, bill_id AS parent_id, count(*) AS rows FROM ({rows}) WHERE bill_id IN {DOUBLES} GROUP BY 2" for name, rows in CHILDREN_SQL.items()))
def _(t):
    return rp.dependents(doubles(t), children(t), "bill_id")


@query("g29_merge_plan", "G29", f"SELECT b.id, b.title, " + ", ".join(f"(SELECT count(*) FROM ({rows}) x WHERE x.bill_id = b.id) AS {name}" for name, rows in CHILDREN_SQL.items()) + f" FROM bills b WHERE b.id IN {DOUBLES}")
def _(t):
    return rp.merge_plan(doubles(t).select("id", "title"), children(t), "bill_id")


@query("g38_people_merged", "G38", """
    SELECT person_id, arg_min(display_name, id) AS display_name, arg_max(slug, id) AS slug, arg_max(big, id) FILTER (big IS NOT NULL) AS big
    FROM (SELECT *, CASE WHEN group_id LIKE 'Brand#1%' THEN group_id END AS big FROM members) WHERE person_id IS NOT NULL GROUP BY 1""")
def _(t):
    rows = t.members.withColumn("big", F.when(F.col("group_id").startswith("Brand#1"), F.col("group_id")))
    return rp.merged_people(rows, ["slug", "big"])


@query("w19_latest_historical_photos", "W19", """
    WITH p AS (SELECT a.member_id AS person, m.legislature_id AS w, a.starts_on AS fetched_at, a.id FROM affiliations a JOIN mandates m ON m.id = a.id WHERE a.logo_url IS NOT NULL)
    SELECT person, w AS "window", fetched_at, id FROM p WHERE person NOT IN (SELECT person FROM p WHERE w = 'L1999')
    QUALIFY row_number() OVER (PARTITION BY person ORDER BY w DESC, fetched_at DESC, id DESC) = 1""")
def _(t):
    photos = t.affiliations.where("logo_url IS NOT NULL").join(t.mandates.select("id", "legislature_id"), "id").select(
        F.col("member_id").alias("person"), F.col("legislature_id").alias("window"), F.col("starts_on").alias("fetched_at"), "id")
    return rp.latest_photos(photos, "L1999")


@query("w20_retention", "W20", """
    SELECT id, kind AS category, CASE WHEN row_number() OVER (PARTITION BY kind ORDER BY last_seen DESC, id DESC) <= 10 THEN 'kept_newest'
      WHEN last_seen < DATE '2000-06-01' - 365 THEN 'expired' ELSE 'kept_recent' END AS reason FROM discoveries""")
def _(t):
    return rp.retention(t.discoveries.select("id", F.col("kind").alias("category"), F.col("last_seen").alias("modified_on")), "2000-06-01", 10, 365)


@query("b19_work_queue_filtered", "B19", """
    SELECT id, kind, chamber, failure_count, first_seen, last_seen FROM discoveries WHERE status IN ('pending', 'partial', 'failed') AND chamber = 'senate' AND year(first_seen) IN (1998, 1999) AND failure_count < 3
    ORDER BY failure_count, last_seen DESC, id LIMIT 25""")
def _(t):
    ready, _ = rp.work_queue(t.discoveries.select("id", "kind", "chamber", "status", "failure_count", "first_seen", "last_seen"), 25, chamber="senate", years=[1998, 1999])
    return ready.drop("status")


@query("b20_asset_selection", "B20", """
    SELECT a.id, m.legislature_id, a.logo_url FROM affiliations a JOIN mandates m ON m.id = a.id WHERE a.logo_url IS NOT NULL AND starts_with(m.legislature_id, 'L199') ORDER BY a.member_id, a.id LIMIT 200""")
def _(t):
    items = t.affiliations.join(t.mandates.select("id", "legislature_id"), "id").select(
        "id", F.when(F.col("logo_url").isNotNull(), "party_logo").otherwise("photo").alias("asset_type"), "legislature_id", F.col("member_id").alias("position"), "logo_url")
    return rp.select_assets(items, "party_logo", "L199", 200).select("id", "legislature_id", "logo_url")


QUEUED_SQL = """SELECT d.id, d.bill_no AS bill_id, d.kind, d.text_status, coalesce(s.latest_event_on, s.submitted_on) AS event_on
    FROM (SELECT *, CASE kind_no WHEN 0 THEN 'proposal' WHEN 1 THEN 'adopted_form' ELSE 'other' END AS kind, CASE id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'missing' WHEN 3 THEN 'unsupported' ELSE 'stored' END AS text_status FROM docs) d
    LEFT JOIN (SELECT bill_id, min(occurred_on) AS submitted_on, max(occurred_on) AS latest_event_on FROM bill_events GROUP BY 1) s ON s.bill_id = d.bill_no WHERE """


def text_queue(t, **options):
    kind = F.when(F.col("kind_no") == 0, "proposal").when(F.col("kind_no") == 1, "adopted_form").otherwise("other")
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "failed", "missing", "unsupported", "stored", "stored", "stored")]), (F.col("id") % 7 + 1).cast("int"))
    documents = t.docs.select("id", F.col("bill_no").alias("bill_id"), kind.alias("kind"), status.alias("text_status"))
    dates = t.bill_events.groupBy("bill_id").agg(F.min("occurred_on").alias("submitted_on"), F.max("occurred_on").alias("latest_event_on"))
    return rp.text_queue(documents, dates, **options).select("id", "bill_id", "kind", "text_status", "event_on")


@query("b21_text_queue", "B21", QUEUED_SQL + "d.kind = 'proposal' AND d.text_status = 'pending' ORDER BY event_on DESC NULLS LAST, d.bill_no, d.id LIMIT 10")
def _(t):
    return text_queue(t)


@query("b21_text_queue_of_year", "B21", QUEUED_SQL + """d.kind = 'adopted_form' AND d.text_status IN ('pending', 'failed', 'missing', 'unsupported') AND year(coalesce(s.latest_event_on, s.submitted_on)) = 1998
    ORDER BY event_on DESC NULLS LAST, d.bill_no, d.id LIMIT 40""")
def _(t):
    return text_queue(t, kind="adopted_form", year=1998, unsupported=True, limit=40)


@query("b19_work_queue", "B19", """
    SELECT id, kind, failure_count, last_seen FROM discoveries WHERE status IN ('pending', 'partial', 'failed') AND kind = 'vote' AND failure_count < 3
    ORDER BY failure_count, last_seen DESC, id LIMIT 25""")
def _(t):
    ready, _ = rp.work_queue(t.discoveries.select("id", "kind", "status", "failure_count", "last_seen"), 25, kind="vote")
    return ready.drop("status")


@query("s4_first_wins", "S4", "SELECT first_name, id, last_name FROM members QUALIFY row_number() OVER (PARTITION BY first_name ORDER BY id) = 1")
def _(t):
    return st.first_wins(t.members.select("first_name", "id", "last_name"), ["first_name"], ["id"])


@query("s6_rosters_merged", "S5 S6 S7", """
    SELECT display_name, id, party_id FROM (SELECT 0 AS part, display_name, id, party_id FROM members UNION ALL SELECT 1, p_name || ' 7', p_partkey, 'NEW' FROM part WHERE p_size > 30)
    QUALIFY row_number() OVER (PARTITION BY display_name ORDER BY part DESC, id DESC) = 1""")
def _(t):
    second = t.part.where("p_size > 30").select(F.concat("p_name", F.lit(" 7")).alias("display_name"), F.col("p_partkey").alias("id"), F.lit("NEW").alias("party_id"))
    return st.merge_tables([t.members.select("display_name", "id", "party_id"), second], ["display_name"], "id")


@query("s8_inventory_deduplicated", "S8", """
    SELECT 'asset-' || substr(sha256(u), 1, 12) AS id, u AS url, min(page_id) AS page_id FROM (SELECT page_id, url AS u FROM pages UNION ALL SELECT page_id, split_part(url, '?', 1) FROM pages
      UNION ALL SELECT page_id, split_part(url, '#', 1) FROM pages) GROUP BY 2""")
def _(t):
    lists = F.array(F.col("url"), F.split("url", r"\?")[0], F.split("url", "#")[0])
    flat = t.pages.select("page_id", F.explode(lists).alias("url"))
    return st.first_wins(flat, ["url"], ["page_id"]).select(F.concat(F.lit("asset-"), F.substr(F.sha2("url", 256), F.lit(1), F.lit(12))).alias("id"), "url", "page_id")


@query("s9_members_of_groups", "S9", "SELECT DISTINCT member_id FROM memberships WHERE group_id IN (SELECT id FROM party_groups WHERE party_id = 'LARGE')")
def _(t):
    return st.distinct_members_of(t.memberships, t.party_groups.where("party_id = 'LARGE'"))


@query("s10_changed_only", "S10", "SELECT id, status, lower(source_url[1:5]) AS computed FROM discoveries WHERE lower(source_url[1:5]) IS DISTINCT FROM status")
def _(t):
    return st.changed_only(t.discoveries.select("id", "status", "source_url"), "status", F.lower(F.substr("source_url", F.lit(1), F.lit(5)))).drop("source_url")


@query("t10_batch_of_urls", "T10", """
    WITH f AS (SELECT u, min(page_id) AS p FROM (SELECT page_id, split_part(url, '/', 3) AS u FROM pages) GROUP BY 1 ORDER BY p, u LIMIT 20 OFFSET 5)
    SELECT page_id, split_part(url, '/', 3) AS host FROM pages WHERE split_part(url, '/', 3) IN (SELECT u FROM f)""")
def _(t):
    return st.batch_of_urls(t.pages.select("page_id", F.split("url", "/")[2].alias("host")), "host", "page_id", 5, 20)


@query("t7_steps_in_order", "T7", "SELECT bill_id, occurred_on, id, row_number() OVER (PARTITION BY bill_id ORDER BY occurred_on, id) AS n FROM bill_events")
def _(t):
    from annalist.operators.scan import running
    rows = t.bill_events.select("bill_id", "occurred_on", "id").withColumn("one", F.lit(1))
    return running(rows, ["bill_id"], ["occurred_on", "id"], F.trunc("occurred_on", "month"), {"n": ("one", "sum")}).drop("one")


@query("g42_group_chips", "G42", """
    SELECT regexp_replace(lower(party_id), '[^a-z0-9]', '', 'g') AS chip, min(party_id) AS label, count(*) AS groups FROM party_groups GROUP BY 1""")
def _(t):
    from annalist.functions.text import folded_key
    return t.party_groups.groupBy(folded_key(F.col("party_id")).alias("chip")).agg(F.min("party_id").alias("label"), F.count(F.lit(1)).alias("groups"))


@query("a8_page_snapshots", "A8", """
    SELECT 'source-page-' || substr(sha256(html), 1, 12) AS id, url AS source_url, sha256(html) AS content_hash, 'page' AS parser, 'v1' AS parser_version,
      CASE WHEN length(html) > 0 THEN 'parsed' ELSE 'failed' END AS status FROM pages""")
def _(t):
    from annalist.sources.files import snapshot
    return snapshot(t.pages, "page", "v1").drop("fetched_at")
