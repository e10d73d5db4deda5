"""Queries over reconciliation, candidates, fuzzy match, components, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import identifiers as ids
from annalist.functions.text import words
from annalist.operators import audit as au
from annalist.operators import documents as dx
from annalist.operators import resolve as rs
from annalist.operators.readmodels import join_in_window
from annalist.plans.documents import REASONS_SQL, SECTIONS_SQL, WARNINGS_SQL, legal, scored
from annalist.plans.readmodels import COVERAGE_SQL, coverage, summaries, with_identifiers, SUMMARY_SQL
from annalist.plans.registry import query

WORDS_SQL = "trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"
TOKENS_SQL = "array_to_string(list_sort(string_split(" + WORDS_SQL + ", ' ')), ' ')"


def roster_a(t):
    return t.members.select("id", F.col("party_id").alias("scope"), F.col("display_name").alias("name"), "group_id")


def roster_b(t):
    size = F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_name", size.cast("string"))).otherwise(F.concat_ws(" ", size.cast("string"), "p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("scope"), name.alias("name"),
                         F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("group_id"))


ROSTERS_SQL = f"""
    a AS (SELECT id AS a_id, party_id AS scope, {WORDS_SQL.format(x='display_name')} AS n, {TOKENS_SQL.format(x='display_name')} AS tk, group_id AS attr FROM members),
    b0 AS (SELECT p_partkey AS id, p_type AS scope, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || (p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END)
        ELSE (p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) || ' ' || p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS attr FROM part),
    b AS (SELECT id AS b_id, scope, {WORDS_SQL.format(x='name')} AS n, {TOKENS_SQL.format(x='name')} AS tk, attr FROM b0)"""


@query("j22_roster_reconciliation", "J22 F6 G37", f"""
    WITH {ROSTERS_SQL},
      e AS (SELECT scope, n, max(b_id) AS b_id, arg_max(coalesce(attr, '-'), b_id) AS attr FROM b GROUP BY 1, 2),
      u AS (SELECT scope, tk, max(b_id) AS b_id, arg_max(coalesce(attr, '-'), b_id) AS attr FROM b GROUP BY 1, 2 HAVING count(*) = 1),
      m AS (SELECT a.scope, a.a_id, coalesce(e.b_id, u.b_id) AS b_id, a.attr AS aa, nullif(CASE WHEN e.b_id IS NOT NULL THEN e.attr ELSE u.attr END, '-') AS ba
        FROM a LEFT JOIN e ON e.scope = a.scope AND e.n = a.n LEFT JOIN u ON u.scope = a.scope AND u.tk = a.tk)
    SELECT CASE WHEN b_id IS NULL THEN 'missing_b' WHEN aa IS NOT NULL AND ba IS NOT NULL AND aa <> ba THEN 'mismatch' ELSE 'matched' END AS status, scope, a_id, b_id FROM m
    UNION ALL SELECT 'missing_a', scope, NULL, b_id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.scope = b.scope AND (a.n = b.n OR a.tk = b.tk))""")
def _(t):
    return rs.reconcile(roster_a(t), roster_b(t), "scope", "name", "group_id")


@query("j23_name_differences", "J23", f"""
    WITH {ROSTERS_SQL}, d AS (SELECT 'left' AS side, tk AS k, min(m.display_name) AS name FROM a JOIN members m ON m.id = a.a_id WHERE tk NOT IN (SELECT tk FROM b) GROUP BY 2
      UNION ALL SELECT 'right', tk, min(b0.name) FROM b JOIN b0 ON b0.id = b.b_id WHERE tk NOT IN (SELECT tk FROM a) GROUP BY 2)
    SELECT side, k, name FROM d QUALIFY row_number() OVER (PARTITION BY side ORDER BY name, k) <= 100""")
def _(t):
    return rs.name_differences(roster_a(t), roster_b(t), "name", 100)


@query("j20_discoveries_without_match", "J20 B24 F23", r"""
    SELECT id, official_id, source_url FROM discoveries d WHERE status IN ('imported', 'partial')
      AND (official_id IS NULL OR official_id NOT IN (SELECT senate_identifier FROM bills WHERE senate_identifier IS NOT NULL))
      AND regexp_replace(source_url, '^http://', 'https://') NOT IN (SELECT regexp_replace(source_url, '^http://', 'https://') FROM discoveries WHERE status = 'skipped')""")
def _(t):
    found = t.discoveries.where(F.col("status").isin("imported", "partial"))
    known = t.bills.where("senate_identifier IS NOT NULL").select(F.col("senate_identifier").alias("value"))
    return rs.without_match(found, known, t.discoveries.where("status = 'skipped'").select(F.col("source_url").alias("url"))).select("id", "official_id", "source_url")


@query("j19_bills_without_procedure", "J19 R15", """
    SELECT o_custkey AS bill_id, count(*) AS documents FROM orders WHERE o_custkey NOT IN (SELECT bill_id FROM bill_events WHERE label = 'Adoptat') GROUP BY 1""")
def _(t):
    docs = t.bill_events.select("bill_id")
    return au.missing_procedure(docs, t.bill_events.where("label = 'Adoptat'"))


@query("j21_bill_source_urls", "J21", """
    SELECT DISTINCT b.id, s.source_url FROM bills b
    LEFT JOIN (SELECT id AS bill_id, source_id FROM bills WHERE source_id IS NOT NULL UNION SELECT bill_id, source_id FROM votes WHERE bill_id IS NOT NULL AND source_id IS NOT NULL) x ON x.bill_id = b.id
    LEFT JOIN sources s ON s.id = x.source_id""")
def _(t):
    links = t.bills.select("id", "source_id").unionByName(t.votes.where("bill_id IS NOT NULL AND source_id IS NOT NULL").select(F.col("bill_id").alias("id"), "source_id"))
    return rs.urls_of(links, t.sources)


IDENT_RE = r"'(?i)\b(?:PL-x|PLX|L|B|BP)\s*[-]?\s*\d+/\d{4}\b'"
KEYS_SQL = f"list_distinct(list_transform(regexp_extract_all({{x}}, {IDENT_RE.replace('{4}', '{{4}}')}), lambda m: replace(regexp_replace(lower(m), '\\s+', '', 'g'), 'plx', 'pl-x')))"


@query("j24_vote_bill_candidates", "J24 R14", f"""
    WITH k AS (SELECT id AS text_id, unnest({KEYS_SQL.format(x='title')}) AS key FROM votes),
      c AS (SELECT id AS bill_id, lower(replace(senate_identifier, ' ', '')) AS key FROM bills WHERE senate_identifier IS NOT NULL
        UNION SELECT id, lower(replace(deputies_identifier, ' ', '')) FROM bills WHERE deputies_identifier IS NOT NULL)
    SELECT text_id, bill_id FROM (SELECT DISTINCT text_id, bill_id FROM k JOIN c USING (key)) QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY bill_id) <= 5""")
def _(t):
    return rs.linked_candidates(t.votes.select("id", F.col("title").alias("text")), t.bills, ["senate_identifier", "deputies_identifier"])


# Texts that quote a bill's title every third time, and an identifier otherwise.
def quoting(t):
    b = t.bills.select(F.col("id").alias("bill_id"), F.col("title").alias("b_title"))
    return t.votes.join(b, "bill_id", "left").select(
        "id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Raport comun despre "), F.coalesce("b_title", F.lit("")), F.lit(" x")))
        .otherwise(F.col("title")).alias("text"))


@query("j25_bills_named_in_text", "J25 F19 F21", f"""
    WITH q AS (SELECT v.id, CASE WHEN v.id % 3 = 0 THEN 'Raport comun despre ' || coalesce(b.title, '') || ' x' ELSE v.title END AS text FROM votes v LEFT JOIN bills b ON b.id = v.bill_id),
      i AS (SELECT id AS text_id, unnest(list_concat(
          list_transform(regexp_extract_all(text, '(?i)\\b(?:BP|B|L)\\s*[-.]?\\s*\\d+(?:\\s*/\\s*\\d{{4}})\\b'), lambda m: upper(m)),
          list_transform(regexp_extract_all(text, '(?i)\\bPL\\s*[-.]?\\s*x\\s*\\d+\\s*/\\s*\\d{{4}}\\b'), lambda m: m))) AS value FROM q),
      c AS (SELECT id AS bill_id, senate_identifier AS value FROM bills UNION SELECT id, deputies_identifier FROM bills),
      byid AS (SELECT DISTINCT text_id, bill_id FROM i JOIN c USING (value)),
      tt AS (SELECT DISTINCT {WORDS_SQL.format(x='text')} AS f FROM q), bt AS (SELECT id AS bill_id, substr({WORDS_SQL.format(x='title')}, 1, 80) AS n FROM bills WHERE length({WORDS_SQL.format(x='title')}) > 24),
      hit AS (SELECT f, bill_id FROM tt JOIN bt ON contains(f, n)),
      bytitle AS (SELECT q.id AS text_id, hit.bill_id FROM q JOIN hit ON hit.f = {WORDS_SQL.format(x='q.text')})
    SELECT text_id, bill_id, 'identifier' AS reason FROM byid UNION ALL SELECT text_id, bill_id, 'title' FROM (SELECT * FROM bytitle EXCEPT SELECT * FROM byid)""")
def _(t):
    return rs.text_candidates(quoting(t), t.bills, ["senate_identifier", "deputies_identifier"])


@query("j26_discovery_candidates", "J26")
def _(t):
    rows = t.discoveries.select("id", "kind", "source_url", F.concat_ws(" ", "official_id", "source_url").alias("text"))
    linked = t.votes.where("bill_id IS NOT NULL").select(F.col("bill_id"), F.col("id").alias("n")).join(
        t.discoveries.where("kind = 'vote'").select(F.col("id").alias("n"), "source_url"), "n").select("source_url", "bill_id")
    return rs.discovery_candidates(rows, linked, t.bills, ["senate_identifier", "deputies_identifier"])


@query("r11_strong_links", "R11", f"""
    WITH k AS (SELECT id AS vote_id, {KEYS_SQL.format(x='title')} AS tk, bill_id AS current_bill_id, id % 1500 AS bill_id FROM votes),
      c AS (SELECT id AS bill_id, list_filter([lower(replace(senate_identifier, ' ', '')), lower(replace(deputies_identifier, ' ', ''))], lambda x: x IS NOT NULL) AS bk FROM bills)
    SELECT vote_id, bill_id, len(list_intersect(tk, bk)) AS shared, CASE WHEN current_bill_id IS NOT NULL AND current_bill_id <> bill_id THEN 'blocked_relink'
      WHEN len(list_intersect(tk, bk)) > 0 THEN 'linked' ELSE 'weak_evidence' END AS status FROM k JOIN c USING (bill_id)""")
def _(t):
    proposals = t.votes.select(F.col("id").alias("vote_id"), (F.col("id") % 1500).alias("bill_id"), F.col("bill_id").alias("current_bill_id"))
    return rs.strong_link(proposals, t.votes.select("id", F.col("title").alias("text")), t.bills, ["senate_identifier", "deputies_identifier"])


ENTRIES_SQL = """(SELECT 'senate:' || senate_identifier AS key, id FROM bills WHERE senate_identifier IS NOT NULL
      UNION ALL SELECT 'deputies:' || deputies_identifier, id FROM bills WHERE deputies_identifier IS NOT NULL)"""


def identifier_entries(t):
    return with_identifiers(t.bills).select("id", F.explode("identifiers").alias("kind", "value")).select(F.concat_ws(":", "kind", "value").alias("key"), "id")


@query("g23_duplicate_identifiers", "G23 S2 B8", f"""
    SELECT key, count(*) OVER (PARTITION BY key) AS rows, id FROM {ENTRIES_SQL} QUALIFY count(*) OVER (PARTITION BY key) > 1""")
def _(t):
    return rs.duplicate_rows(identifier_entries(t), "key", "id")


PRINT_SQL = f"""(SELECT chamber || '|' || held_on || '|' || {WORDS_SQL.format(x='title')} || '|' || for_count || '|' || against AS key, id FROM votes)"""


@query("g24_duplicate_fingerprints", "G24", f"""
    SELECT key, count(*) AS rows, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT key, id FROM {PRINT_SQL} QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) <= 3 AND count(*) OVER (PARTITION BY key) > 1)
    GROUP BY 1""".replace("count(*) AS rows, string_agg(id", "any_value(n) AS rows, string_agg(CAST(id AS VARCHAR)").replace("SELECT key, id FROM (SELECT chamber", "SELECT key, id, count(*) OVER (PARTITION BY key) AS n FROM (SELECT chamber"))
def _(t):
    key = rs.fingerprint(F.col("chamber"), F.col("held_on"), words(F.col("title")), F.col("for_count"), F.col("against"))
    return rs.duplicate_keys(t.votes.select("id", key.alias("key")), "key", "id", samples=3, skip_unknown=True)


@query("g32_labels_merged", "G31 G32", """
    WITH rows AS (SELECT 'party' AS kind, a.party_id AS entity_id, substr(a.party_id, 1, 3) AS label, count(DISTINCT a.member_id) AS member_count, count(*) AS row_count,
          list_sort(list(DISTINCT m.legislature_id)) AS legs, list_sort(list(DISTINCT m.chamber)) AS chs FROM affiliations a JOIN mandates m ON m.id = a.id GROUP BY 1, 2, 3
        UNION ALL SELECT 'group', s.group_id, CASE WHEN length(s.group_id) < 8 THEN 'Pro' ELSE s.group_id END, count(DISTINCT s.member_id), count(*),
          list_sort(list(DISTINCT m.legislature_id)), list_sort(list(DISTINCT m.chamber)) FROM memberships s JOIN mandates m ON m.id = s.id GROUP BY 1, 2, 3),
      k AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS key FROM rows),
      s AS (SELECT key, CAST(sum(m) AS BIGINT) AS member_count, CAST(sum(r) AS BIGINT) AS row_count, count(*) AS entities FROM (SELECT key, entity_id, max(member_count) AS m, max(row_count) AS r FROM k GROUP BY 1, 2) GROUP BY 1)
    SELECT k.key, arg_max(label, (k.member_count, label)) AS label, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS kind, any_value(s.entities) AS entities,
      any_value(s.member_count) AS member_count, any_value(s.row_count) AS row_count,
      array_to_string(list_reverse_sort(list_distinct(flatten(list(legs)))), ',') AS legislatures, array_to_string(list_sort(list_distinct(flatten(list(chs)))), ',') AS chambers
    FROM k JOIN s ON s.key = k.key GROUP BY k.key""")
def _(t):
    m = t.mandates.select("id", "legislature_id", "chamber")

    def usage(df, kind, entity, label):
        return df.join(m, "id").groupBy(F.lit(kind).alias("kind"), F.col(entity).alias("entity_id"), label.alias("label")).agg(
            F.countDistinct("member_id").alias("member_count"), F.count(F.lit(1)).alias("row_count"),
            F.array_sort(F.collect_set("legislature_id")).alias("legislatures"), F.array_sort(F.collect_set("chamber")).alias("chambers"))

    parties = usage(t.affiliations, "party", "party_id", F.substr("party_id", F.lit(1), F.lit(3)))
    groups = usage(t.memberships, "group", "group_id", F.when(F.length("group_id") < 8, "Pro").otherwise(F.col("group_id")))
    return rs.merge_labels(parties.unionByName(groups))


# --- scored names -------------------------------------------------------------

def name_registry(t):
    short = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.substr("p_type", F.lit(1), F.lit(3)))
    return t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.lit("Partidul"), "p_name", "p_type").alias("legal_name"), short.alias("short_name"))


def name_candidates(t):
    return t.part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("id")).select(
        "id", F.array(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws("", F.lit("Uniunea "), F.substr("p_type", F.lit(1), F.lit(3)))).alias("names"))


BARE = "list_filter(string_split({x}, ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in rs.BOILERPLATE) + "))"
SCORE_SQL = f"""
    WITH r0 AS (SELECT p_partkey AS r_id, lower('Partidul ' || p_name || ' ' || p_type) AS legal, lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_type, 1, 3) ELSE '' END) AS short FROM part),
      r AS (SELECT *, replace(legal, ' ', '') AS lc, replace(short, ' ', '') AS sc, {BARE.format(x='legal')} AS lb, {BARE.format(x='short')} AS sb FROM r0),
      c0 AS (SELECT min(p_partkey) AS c_id, lower(p_name || ' ' || p_type) AS n1, lower('Uniunea ' || substr(p_type, 1, 3)) AS n2 FROM part GROUP BY p_name, p_type),
      c AS (SELECT c_id, [n1, n2] AS ns, [replace(n1, ' ', ''), replace(n2, ' ', '')] AS cs, {BARE.format(x='n1')} AS b1, {BARE.format(x='n2')} AS b2 FROM c0),
      p AS (SELECT r_id, c_id, CASE WHEN list_contains(ns, legal) THEN 96 WHEN short <> '' AND list_contains(ns, short) THEN CASE WHEN length(sc) <= 3 THEN 88 ELSE 100 END
          WHEN list_contains(cs, lc) OR (sc <> '' AND list_contains(cs, sc)) THEN CASE WHEN least(length(lc), CASE WHEN sc = '' THEN 999 ELSE length(sc) END) <= 3 THEN 88 ELSE 94 END
          WHEN lb = b1 OR lb = b2 OR (len(sb) > 0 AND (sb = b1 OR sb = b2)) THEN 84
          ELSE greatest(""" + ", ".join(
    f"CASE WHEN len({x}) > 0 AND len(list_intersect(list_distinct({x}), list_distinct({y}))) >= 2 THEN CAST(floor(len(list_intersect(list_distinct({x}), list_distinct({y}))) / greatest(len(list_distinct({x})), len(list_distinct({y}))) * 80) AS INT) ELSE 0 END"
    for x in ("lb", "sb") for y in ("b1", "b2")) + """) END AS score,
        CASE WHEN list_contains(ns, legal) THEN 'exact_label_or_name' WHEN short <> '' AND list_contains(ns, short) THEN CASE WHEN length(sc) <= 3 THEN 'exact_short_name_needs_review' ELSE 'exact_short_name' END
          WHEN list_contains(cs, lc) OR (sc <> '' AND list_contains(cs, sc)) THEN CASE WHEN least(length(lc), CASE WHEN sc = '' THEN 999 ELSE length(sc) END) <= 3 THEN 'exact_compact_label_needs_review' ELSE 'exact_compact_label' END
          WHEN lb = b1 OR lb = b2 OR (len(sb) > 0 AND (sb = b1 OR sb = b2)) THEN 'exact_boilerplate_stripped' ELSE 'token_overlap' END AS reason
        FROM r CROSS JOIN c),
      scored AS (SELECT * FROM p WHERE score > 0)"""


@query("r3_scored_names", "R3 F37", SCORE_SQL + " SELECT * FROM scored")
def _(t):
    return rs.score_names(name_registry(t), name_candidates(t))


@query("r4_match_decisions", "R4 T9", SCORE_SQL + """,
      top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY r_id ORDER BY score DESC, c_id) <= 5)
    SELECT r.r_id, coalesce(max(score), 0) AS best_score, CASE WHEN coalesce(max(score), 0) >= 92 THEN 'auto_match' WHEN coalesce(max(score), 0) >= 65 THEN 'needs_review' ELSE 'no_match' END AS status,
      coalesce(string_agg(CAST(c_id AS VARCHAR), ',' ORDER BY score DESC, c_id), '') AS matches FROM r LEFT JOIN top ON top.r_id = r.r_id GROUP BY 1""")
def _(t):
    return rs.decide(name_registry(t), rs.score_names(name_registry(t), name_candidates(t), most=5))


# --- components ---------------------------------------------------------------

def career_edges(t):
    """Parts one supplier delivers in one order, each tied to the least of them."""
    low = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_partkey").alias("dst"))
    return t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_partkey").alias("src")).join(low, ["l_orderkey", "l_suppkey"]).select("src", "dst").where("src <> dst").distinct()


REACH_SQL = """
    WITH RECURSIVE e AS (SELECT DISTINCT l.l_partkey AS a, m.b FROM lineitem l JOIN (SELECT l_orderkey, l_suppkey, min(l_partkey) AS b FROM lineitem GROUP BY 1, 2) m
        ON m.l_orderkey = l.l_orderkey AND m.l_suppkey = l.l_suppkey WHERE l.l_partkey <> m.b),
      both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      reach(node, seen) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON x.a = r.seen)"""


def person_groups(t):
    return rs.components(career_edges(t), t.part.select(F.col("p_partkey").alias("node")))


@query("r1_connected_components", "R1", REACH_SQL + " SELECT node, min(seen) AS component FROM reach GROUP BY 1")
def _(t):
    return person_groups(t)


NAMED_SQL = REACH_SQL + """,
      c AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1),
      k AS (SELECT c.component, 'person-' || substr(sha1(CAST(c.component AS VARCHAR)), 1, 12) AS person_key, p.p_name AS name, p.p_partkey AS node, p.p_partkey % 3 = 0 AS have,
        p.p_partkey IN (SELECT b FROM e) AS linked FROM c JOIN part p ON p.p_partkey = c.node)"""


def named_components(t):
    named = person_groups(t).join(t.part.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name")), "node")
    return named, t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node")), career_edges(t)


@query("r2_person_candidates", "R2", NAMED_SQL + """
    SELECT component, count(*) AS profiles, min(name) AS name, count(*) FILTER (have) AS imported, count(*) FILTER (NOT have AND linked) AS missing_linked, any_value(person_key) AS person_key FROM k GROUP BY 1""")
def _(t):
    return rs.person_candidates(*named_components(t))


@query("r2_person_candidate_keys", "R2", NAMED_SQL + """
    SELECT DISTINCT person_key, 'name' AS role, name AS value FROM k UNION ALL SELECT person_key, 'imported', CAST(node AS VARCHAR) FROM k WHERE have
    UNION ALL SELECT person_key, 'missing_linked', CAST(node AS VARCHAR) FROM k WHERE NOT have AND linked""")
def _(t):
    return rs.person_candidate_keys(*named_components(t))


# --- health queues and audits -----------------------------------------------------

QUEUES_SQL = "WITH " + SECTIONS_SQL + f""",
    issues AS (SELECT 'ocr:' || document_id || ':' || unnest(rs) AS issue_key, 'ocr' AS issue_type, CAST(document_id AS VARCHAR) AS entity_id, unnest(rs) AS reason FROM ({REASONS_SQL})
      UNION ALL SELECT 'vote-unlinked:' || id, 'vote-unlinked', CAST(id AS VARCHAR), 'unlinked' FROM votes WHERE bill_id IS NULL
      UNION ALL SELECT 'weak-vote-title:' || id, 'weak-vote-title', CAST(id AS VARCHAR), 'weak title' FROM votes
        WHERE lower(title) = 'vot electronic' OR contains(lower(title), 'amendament') OR contains(lower(title), 'procedur') OR length(title) < 24
      UNION ALL SELECT 'duplicate-bill-identifier:' || key, 'duplicate-bill-identifier', key, 'same identifier' FROM {ENTRIES_SQL} GROUP BY key HAVING count(*) > 1
      UNION ALL SELECT DISTINCT 'missing-procedure:' || o_custkey, 'missing-procedure', CAST(o_custkey AS VARCHAR), 'no steps' FROM orders WHERE o_custkey NOT IN (SELECT bill_id FROM bill_events WHERE label = 'Adoptat')),
    reviewed AS (SELECT i.*, coalesce(r.status, 'open') AS status FROM issues i LEFT JOIN (SELECT 'ocr:' || doc_id || ':very_short_text' AS k, max(status) AS status FROM doc_reviews GROUP BY 1) r ON r.k = i.issue_key)"""


def queues(t):
    parts = [
        au.health_issues(scored(t)), au.vote_issues(t.votes),
        au.duplicate_issues(rs.duplicate_keys(identifier_entries(t), "key", "id"), "key"),
        au.procedure_issues(au.missing_procedure(t.bill_events.select("bill_id"), t.bill_events.where("label = 'Adoptat'"))),
    ]
    reviews = t.doc_reviews.select(F.concat_ws(":", F.lit("ocr"), F.col("doc_id").cast("string"), F.lit("very_short_text")).alias("issue_key"), "status")
    return au.with_review(au.audit_report(parts), reviews)


@query("r12_health_queue_issues", "R12 R14 R15 R16 B15", QUEUES_SQL + " SELECT * FROM reviewed")
def _(t):
    return queues(t)


@query("r16_open_issue_counts", "R16", QUEUES_SQL + """
    SELECT coalesce(issue_type, 'all') AS issue_type, count(*) AS issues, count(*) FILTER (status = 'open') AS open FROM reviewed GROUP BY GROUPING SETS ((issue_type), ())""")
def _(t):
    return au.open_counts(queues(t))


@query("r13_section_parse_issues", "R13", "WITH " + WARNINGS_SQL + """
    SELECT 'weak-section-parse:' || document_id AS issue_key, 'weak-section-parse' AS issue_type, CAST(document_id AS VARCHAR) AS entity_id, unnest(CASE WHEN sections = 0 THEN ['empty_text'] ELSE ws END) AS reason FROM w""")
def _(t):
    return au.section_issues(dx.parse_sections(legal(t)))


@query("b15_weak_title_variants", "B15", f"""
    SELECT id, (lower(title) = 'vot electronic' OR contains(lower(title), 'amendament') OR contains(lower(title), 'procedur') OR length(title) < 24) AS queue,
      (length({WORDS_SQL.format(x='title')}) < 18 OR {WORDS_SQL.format(x='title')} IN ('chamber vote', 'senate vote', 'vot', 'vot final', 'vot electronic', 'proiect de hotarare')) AS audit,
      (length({WORDS_SQL.format(x='title')}) < 18 OR {WORDS_SQL.format(x='title')} IN ('chamber vote', 'senate vote', 'vot', 'vot final', 'vot electronic', 'proiect de hotarare')
        OR regexp_matches({WORDS_SQL.format(x='title')}, '\\bama\\s*\\d+\\b')) AS dossier FROM votes""")
def _(t):
    return t.votes.select("id", *[au.weak_title(F.col("title"), v).alias(v) for v in ("queue", "audit", "dossier")])


@query("g27_dossier_completeness", "G27", """
    SELECT b.id, coalesce(e.n, 0) AS steps, coalesce(d.n, 0) AS documents, coalesce(v.n, 0) AS votes, (coalesce(e.n, 0) = 0 OR coalesce(d.n, 0) = 0) AS incomplete FROM bills b
    LEFT JOIN (SELECT bill_id, count(*) AS n FROM bill_events WHERE label = 'Raport' GROUP BY 1) e ON e.bill_id = b.id
    LEFT JOIN (SELECT bill_no, count(*) AS n FROM docs GROUP BY 1) d ON d.bill_no = b.id LEFT JOIN (SELECT bill_id, count(*) AS n FROM votes GROUP BY 1) v ON v.bill_id = b.id""")
def _(t):
    return rs_completeness(t)


def rs_completeness(t):
    from annalist.operators.reports import completeness
    return completeness(t.bills.select("id"), {
        "steps": t.bill_events.where("label = 'Raport'").select("bill_id"), "documents": t.docs.select(F.col("bill_no").alias("bill_id")),
        "votes": t.votes.where("bill_id IS NOT NULL").select("bill_id")}, "bill_id").withColumn("incomplete", (F.col("steps") == 0) | (F.col("documents") == 0))
