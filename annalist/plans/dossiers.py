"""Audits of one window: its issues, its counts, and its dossiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions.text import words
from annalist.operators import audit as au
from annalist.operators import dossier as ds
from annalist.operators import resolve as rs
from annalist.plans.readmodels import COVERAGE_SQL, SUMMARY_SQL, coverage, summaries
from annalist.plans.registry import query
from annalist.plans.resolving import WORDS_SQL

START, END = "1997-01-01", "1999-01-01"
IDENTIFIERS = {"senate": "senate_identifier", "deputies": "deputies_identifier"}
GENERIC_SQL = "('chamber vote', 'senate vote', 'vot', 'vot final', 'vot electronic', 'proiect de hotarare')"
WITHIN = f">= DATE '{START}' AND {{0}} < DATE '{END}'"
SAME = r"regexp_replace(regexp_replace(trim({x}), '^http://', 'https://'), '&idl=1\\b', '')"


def scope(t, chamber=None):
    return ds.window_scope(t.named_bills, summaries(t).select("bill_id", "submitted_on", "latest_event_on"), t.titled_votes, t.found_pages, t.sources,
                           IDENTIFIERS, START, END, chamber)


def _in(column):
    return f"{column} >= DATE '{START}' AND {column} < DATE '{END}'"


SCOPE_SQL = f"""
    bs AS (SELECT b.*, s.submitted_on, s.latest_event_on, coalesce(s.submitted_on, s.latest_event_on) AS day, u.source_url AS url
      FROM named_bills b JOIN ({SUMMARY_SQL}) s ON s.bill_id = b.id LEFT JOIN sources u ON u.id = b.source_id WHERE {_in('coalesce(s.submitted_on, s.latest_event_on)')}),
    vs AS (SELECT v.*, u.source_url AS url, {WORDS_SQL.format(x='v.title')} AS folded FROM titled_votes v LEFT JOIN sources u ON u.id = v.source_id WHERE {_in('v.held_on')}),
    fs AS (SELECT * FROM found_pages WHERE {_in('discovered_on')}),
    keys AS (SELECT 'senate:' || senate_identifier AS key, id FROM bs WHERE senate_identifier IS NOT NULL UNION ALL SELECT 'deputies:' || deputies_identifier, id FROM bs WHERE deputies_identifier IS NOT NULL),
    lost AS (SELECT * FROM fs WHERE status IN ('imported', 'partial') AND CASE WHEN kind = 'bill'
      THEN NOT EXISTS (SELECT 1 FROM bs WHERE fs.official_id IN (senate_identifier, deputies_identifier)) AND NOT EXISTS (SELECT 1 FROM bs WHERE {SAME.format(x='bs.url')} = {SAME.format(x='fs.source_url')})
      ELSE NOT EXISTS (SELECT 1 FROM vs WHERE {SAME.format(x='vs.url')} = {SAME.format(x='fs.source_url')}) END)"""


def _issue_sql(code, severity, rows, n=5):
    return f"""SELECT '{code}' AS code, '{severity}' AS severity, count(*) AS count, array_to_string((list(CAST(i AS VARCHAR) ORDER BY CAST(i AS VARCHAR)))[1:{n}], ',') AS samples
      FROM (SELECT i FROM ({rows})) HAVING count(*) > 0"""


def _shared(key, rows):
    return f"SELECT key AS i FROM (SELECT {key} AS key FROM {rows}) WHERE NOT contains(key, 'unknown') AND NOT ends_with(key, '|') GROUP BY key HAVING count(*) > 1"


@query("r17_window_audit", "R17 J33 G24 G25 B23", "WITH " + SCOPE_SQL + " " + " UNION ALL ".join([
    _issue_sql("imported_discovery_without_db_match", "warning", "SELECT id AS i FROM lost"),
    _issue_sql("duplicate_bill_identifier", "error", _shared("key", "keys")),
    _issue_sql("duplicate_bill_title_date_chamber", "warning", _shared(f"chamber_of_origin || '|' || day || '|' || {WORDS_SQL.format(x='title')}", "bs")),
    _issue_sql("duplicate_vote_title_date_chamber_totals", "warning", _shared(
        "chamber || '|' || held_on || '|' || folded || '|' || for_count || '|' || against || '|' || abstention || '|' || present_not_voting || '|' || coalesce(CAST(absent AS VARCHAR), 'unknown')", "vs")),
    _issue_sql("vote_without_linked_bill", "warning", "SELECT id AS i FROM vs WHERE bill_id IS NULL"),
    _issue_sql("weak_vote_title", "warning", f"SELECT id AS i FROM vs WHERE length(folded) < 18 OR folded IN {GENERIC_SQL}"),
    _issue_sql("non_nominal_vote_coverage", "info", f"SELECT vs.id AS i FROM vs LEFT JOIN ({COVERAGE_SQL}) c ON c.vote_id = vs.id WHERE c.coverage_level IS DISTINCT FROM 'nominal'"),
]))
def _(t):
    kept = scope(t)
    bill_prints = kept.bills.select("id", rs.fingerprint(F.col("chamber_of_origin"), F.col("day"), words(F.col("title"))).alias("key"))
    totals = [F.col(c) for c in ("for_count", "against", "abstention", "present_not_voting", "absent")]
    vote_prints = kept.votes.select("id", rs.fingerprint(F.col("chamber"), F.col("held_on"), words(F.col("title")), *totals).alias("key"))
    nominal = coverage(t).where("coverage_level = 'nominal'").select(F.col("vote_id").alias("id"))
    shared = lambda rows: rs.duplicate_keys(rows, "key", "id", skip_unknown=True)
    return au.audit_report([
        au.issue(ds.unmatched(kept), "imported_discovery_without_db_match", "warning", "id", 5),
        au.issue(shared(ds.identifier_keys(kept.bills, IDENTIFIERS)), "duplicate_bill_identifier", "error", "key", 5),
        au.issue(shared(bill_prints), "duplicate_bill_title_date_chamber", "warning", "key", 5),
        au.issue(shared(vote_prints), "duplicate_vote_title_date_chamber_totals", "warning", "key", 5),
        au.issue(kept.votes.where("bill_id IS NULL"), "vote_without_linked_bill", "warning", "id", 5),
        au.issue(kept.votes.where(au.weak_title(F.col("title"), "audit")), "weak_vote_title", "warning", "id", 5),
        au.issue(kept.votes.join(nominal, "id", "left_anti"), "non_nominal_vote_coverage", "info", "id", 5),
    ])


@query("r17_window_counts", "R17", "WITH " + SCOPE_SQL + f""",
    c AS (SELECT vs.*, coalesce(x.coverage_level, 'source_only') AS level FROM vs LEFT JOIN ({COVERAGE_SQL}) x ON x.vote_id = vs.id)
    """ + " UNION ALL ".join([
    *[f"SELECT '{name}' AS item, count(*) AS value FROM fs WHERE kind = '{kind}'" + (f" AND status = '{status}'" if status else "")
      for kind in ("bill", "vote") for status, name in ((None, f"found_{kind}s"), *[(s, f"{s}_{kind}s") for s in ("imported", "pending", "failed")])],
    "SELECT 'bills', count(*) FROM bs", "SELECT 'votes', count(*) FROM vs", "SELECT 'votes_without_bill', count(*) FROM vs WHERE bill_id IS NULL",
    *[f"SELECT 'votes_{level}', count(*) FROM c WHERE level = '{level}'" for level in ("nominal", "group_totals", "result_only", "source_only")],
]))
def _(t):
    return ds.window_counts(scope(t), coverage(t))


FOUND_IDS_SQL = """list_distinct(list_concat(
          list_transform(regexp_extract_all({x}, '(?i)\\b(?:BP|B|L)\\s*[-.]?\\s*\\d+(?:\\s*/\\s*\\d{{4}})\\b'), lambda m: upper(m)),
          regexp_extract_all({x}, '(?i)\\bPL\\s*[-.]?\\s*x\\s*\\d+\\s*/\\s*\\d{{4}}\\b')))"""
#: Dossier addresses among the addresses of the tables.
PAGES = r"chamber\.example/bill/\d$"


@query("r18_dossier_audit", "R18 J25 J26 J24 G23", "WITH " + SCOPE_SQL + f""",
    weak AS (SELECT id FROM vs WHERE length(folded) < 18 OR folded IN {GENERIC_SQL} OR regexp_matches(folded, '\\bama\\s*\\d+\\b')),
    full_bills AS (SELECT bs.*, coalesce(e.n, 0) AS steps, coalesce(d.n, 0) AS documents, coalesce(d.stored, 0) AS stored, concat_ws(',', senate_identifier, deputies_identifier) AS ids FROM bs
      LEFT JOIN (SELECT bill_id, count(*) AS n FROM bill_events WHERE label = 'Raport' GROUP BY 1) e ON e.bill_id = bs.id
      LEFT JOIN (SELECT bill_no, count(*) AS n, count(*) FILTER (length(text) > 0) AS stored FROM docs GROUP BY 1) d ON d.bill_no = bs.id),
    texts AS (SELECT 'v' || id AS text_id, title || ' ' || coalesce(url, '') AS text FROM vs WHERE bill_id IS NULL OR id IN (SELECT id FROM weak)
      UNION ALL SELECT 'd' || id, coalesce(official_id, '') || ' ' || coalesce(title, '') || ' ' || source_url FROM lost),
    heard AS (SELECT text_id, unnest({FOUND_IDS_SQL.format(x='text')}) AS value FROM texts),
    byid AS (SELECT text_id, b.id AS bill_id, CASE WHEN bool_or(value = senate_identifier) THEN senate_identifier ELSE deputies_identifier END AS detail
      FROM heard JOIN bs b ON value IN (b.senate_identifier, b.deputies_identifier) GROUP BY text_id, b.id, senate_identifier, deputies_identifier),
    needles AS (SELECT DISTINCT substr({WORDS_SQL.format(x='title')}, 1, 80) AS needle FROM bs WHERE length({WORDS_SQL.format(x='title')}) > 24),
    folded_texts AS (SELECT text_id, {WORDS_SQL.format(x='text')} AS folded FROM texts),
    hits AS (SELECT DISTINCT f.folded, needle FROM (SELECT DISTINCT folded FROM folded_texts) f JOIN needles ON contains(f.folded, needle)),
    bytitle AS (SELECT DISTINCT f.text_id, b.id AS bill_id FROM folded_texts f JOIN hits h ON h.folded = f.folded JOIN bs b ON substr({WORDS_SQL.format(x='b.title')}, 1, 80) = h.needle),
    cands AS (SELECT text_id, bill_id, 'identifier ' || detail AS reason FROM byid UNION ALL SELECT text_id, bill_id, 'title prefix' FROM bytitle t WHERE NOT EXISTS (SELECT 1 FROM byid i WHERE i.text_id = t.text_id AND i.bill_id = t.bill_id)),
    best AS (SELECT text_id, bill_id AS candidate, reason, row_number() OVER (PARTITION BY text_id ORDER BY day DESC NULLS LAST, bill_id) AS nth FROM cands JOIN bs ON bs.id = cands.bill_id QUALIFY nth <= 5),
    found AS (
      SELECT 'missing_dossier' AS section, CAST(id AS VARCHAR) AS item, CAST(id AS VARCHAR) AS bill_id, title, chamber_of_origin AS chamber, day AS happened_on, url AS source_url, ids AS identifiers, steps, documents,
        '{ds.ACTIONS["missing_dossier"]}' AS action, NULL AS text_id FROM full_bills WHERE (steps = 0 OR documents = 0) AND (deputies_identifier IS NOT NULL OR coalesce(regexp_matches(url, '{PAGES}'), FALSE))
      UNION ALL SELECT 'duplicate_identifier', key, CAST(k.id AS VARCHAR), title, chamber_of_origin, day, url, ids, NULL, NULL, '{ds.ACTIONS["duplicate_identifier"]}', NULL
        FROM (SELECT * FROM keys QUALIFY count(*) OVER (PARTITION BY key) > 1) k JOIN full_bills f ON f.id = k.id
      UNION ALL SELECT 'unmatched_discovery', CAST(id AS VARCHAR), NULL, title, chamber, discovered_on, source_url, official_id, NULL, NULL,
        CASE WHEN kind = 'bill' THEN '{ds.ACTIONS["unmatched_bill"]}' ELSE '{ds.ACTIONS["unmatched_vote"]}' END, 'd' || id FROM lost
      UNION ALL SELECT 'unlinked_vote', CAST(id AS VARCHAR), NULL, title, chamber, held_on, url, array_to_string({FOUND_IDS_SQL.format(x="title || ' ' || coalesce(url, '')")}, ','), NULL, NULL, NULL, 'v' || id FROM vs WHERE bill_id IS NULL
      UNION ALL SELECT 'weak_title', CAST(id AS VARCHAR), CAST(bill_id AS VARCHAR), title, chamber, held_on, url, array_to_string({FOUND_IDS_SQL.format(x="title || ' ' || coalesce(url, '')")}, ','), NULL, NULL,
        CASE WHEN bill_id IS NOT NULL THEN '{ds.ACTIONS["weak_linked"]}' ELSE '{ds.ACTIONS["weak_alone"]}' END, 'v' || id FROM vs WHERE id IN (SELECT id FROM weak)),
    counts AS (SELECT 'bills' AS item, count(*) AS value FROM bs UNION ALL SELECT 'bills_without_steps', count(*) FROM full_bills WHERE steps = 0
      UNION ALL SELECT 'bills_without_documents', count(*) FROM full_bills WHERE documents = 0 UNION ALL SELECT 'documents_with_text', CAST(coalesce(sum(stored), 0) AS BIGINT) FROM full_bills
      UNION ALL SELECT 'votes', count(*) FROM vs UNION ALL SELECT 'unlinked_votes', count(*) FROM vs WHERE bill_id IS NULL UNION ALL SELECT 'weak_titles', count(*) FROM weak
      UNION ALL SELECT 'imported_discoveries', count(*) FROM fs WHERE status IN ('imported', 'partial') UNION ALL SELECT 'unmatched_discoveries', count(*) FROM lost
      UNION ALL SELECT 'duplicate_identifiers', count(*) FROM (SELECT key FROM keys GROUP BY key HAVING count(*) > 1)
      UNION ALL SELECT 'unlinked_votes_with_candidates', count(DISTINCT vs.id) FROM vs JOIN best ON best.text_id = 'v' || vs.id WHERE bill_id IS NULL)
    SELECT section, item, found.bill_id, title, chamber, happened_on, source_url, identifiers, steps, documents,
      CASE WHEN section <> 'unlinked_vote' THEN action WHEN candidate IS NULL THEN '{ds.ACTIONS["unlinked_alone"]}' ELSE '{ds.ACTIONS["unlinked_candidates"]}' END AS action,
      nth AS candidate_no, CAST(candidate AS VARCHAR) AS candidate_id, reason, CAST(NULL AS BIGINT) AS value FROM found LEFT JOIN best ON best.text_id = found.text_id
    UNION ALL SELECT 'count', item, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, value FROM counts""")
def _(t):
    documents = t.docs.select(F.col("bill_no").alias("bill_id"), (F.length("text") > 0).alias("stored"))
    return ds.dossier_audit(scope(t), IDENTIFIERS, t.bill_events.where("label = 'Raport'").select("bill_id"), documents, PAGES)
