"""Logical tables over the test data.

Each view is one projection (or one pre-aggregate) of a given table. The text
is plain SQL that Spark and the checking engine both read; ``{name}`` marks the
tables it reads. Nothing here filters rows away to make a check cheap.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Tables whose rows cost far more to work on than to move.

PARTY_OF_NUMBER = (
    "CASE {n} WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM' "
    "WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END"
)

# name -> SQL text; later views may read earlier ones.
VIEWS: dict[str, str] = {
    "legislatures": """
        SELECT * FROM (VALUES
          ('L1995', '1995-1997', DATE '1995-01-01', DATE '1997-01-01'),
          ('L1997', '1997-1999', DATE '1997-01-01', DATE '1999-01-01'),
          ('L1999', '1999-2001', DATE '1999-01-01', DATE '2001-01-01'),
          ('L2001', '2001-2003', DATE '2001-01-01', DATE '2003-01-01')
        ) AS w(id, label, starts_on, ends_on)""",
    "votes": """
        SELECT o_orderkey AS id,
          CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS bill_id,
          CASE WHEN o_orderkey % 2 = 0 THEN 'senate' ELSE 'deputies' END AS chamber,
          CASE o_orderkey % 4
            WHEN 0 THEN o_orderpriority
            WHEN 1 THEN 'Vot final asupra PL-x ' || CAST(o_custkey AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
            WHEN 2 THEN 'Raport L' || CAST(o_custkey AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) || ' dezbatere generala'
            ELSE 'Vot final' END AS title,
          CAST(o_orderdate AS DATE) AS held_on,
          CAST(o_orderkey % 5 AS INT) AS present,
          CAST(o_orderkey % 3 AS INT) AS for_count,
          CAST(o_orderkey % 2 AS INT) AS against,
          CAST(0 AS INT) AS abstention,
          CAST(0 AS INT) AS present_not_voting,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'sv-' || CAST(o_orderkey AS STRING) END AS source_id
        FROM {orders}""",
    "sources": """
        SELECT 'sv-' || CAST(o_orderkey AS STRING) AS id,
          'http://www.chamber.example/pls/vot?idv=' || CAST(o_orderkey AS STRING) AS source_url,
          CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status
        FROM {orders}
        UNION ALL
        SELECT 'sb-' || CAST(c_custkey AS STRING),
          'https://www.chamber.example/bill/' || CAST(c_custkey % 700 AS STRING),
          CASE c_mktsegment WHEN 'FURNITURE' THEN 'failed' WHEN 'BUILDING' THEN 'partial' ELSE 'parsed' END
        FROM {customer}""",
    "bills": """
        SELECT c_custkey AS id, 'bill-' || CAST(c_custkey AS STRING) AS slug,
          c_name || ' ' || lower(c_mktsegment) AS title,
          CASE c_custkey % 3 WHEN 0 THEN 'senate' WHEN 1 THEN 'deputies' ELSE 'government' END AS chamber_of_origin,
          c_mktsegment AS status,
          CASE WHEN c_custkey % 4 = 3 THEN NULL
               ELSE 'L' || CAST(c_custkey AS STRING) || '/' || CAST(1995 + c_custkey % 7 AS STRING) END AS senate_identifier,
          CASE WHEN c_custkey % 5 = 4 THEN NULL
               ELSE 'PL-x ' || CAST(c_custkey % 700 AS STRING) || '/' || CAST(1995 + c_custkey % 7 AS STRING) END AS deputies_identifier,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'sb-' || CAST(c_custkey AS STRING) END AS source_id
        FROM {customer}""",
    "bill_events": """
        SELECT o_orderkey AS id, o_custkey AS bill_id, CAST(o_orderdate AS DATE) AS occurred_on,
          CASE o_orderstatus WHEN 'F' THEN 'Adoptat' WHEN 'O' THEN 'Inregistrat' ELSE 'Raport' END AS label
        FROM {orders}""",
    "sponsors": """
        SELECT DISTINCT o_custkey AS bill_id, l_partkey AS member_id
        FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey
        WHERE l_linenumber = 1""",
    "members": """
        SELECT p_partkey AS id,
          CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 1000 END AS person_id,
          p_name || ' ' || CAST(p_size AS STRING) AS display_name,
          p_name AS first_name, 'M' || CAST(p_size AS STRING) AS last_name,
          lower(replace(p_name, ' ', '-')) AS slug,
          p_brand AS group_id, p_type AS party_id
        FROM {part}""",
    "parties": """
        SELECT DISTINCT p_type AS id, substr(p_type, 1, 3) AS short_name,
          'Partidul ' || p_type AS name, lower(p_type) AS slug
        FROM {part}""",
    "party_groups": f"""
        SELECT id, 'Grup ' || id AS name, id AS short_name,
          CASE WHEN CAST(substr(id, 7) AS INT) % 2 = 0 THEN 'senate' ELSE 'deputies' END AS chamber,
          {PARTY_OF_NUMBER.replace('{n}', 'CAST(substr(id, 7) AS INT) % 6')} AS party_id,
          CASE WHEN CAST(substr(id, 7) AS INT) % 3 = 0 THEN NULL ELSE 'c' || substr(id, 7) END AS color
        FROM (SELECT DISTINCT p_brand AS id FROM {{part}}) AS b""",
    # One ballot per (vote, member): the greatest (choice, group) code.
    "ballots": """
        SELECT CAST(vote_id AS STRING) || '-' || CAST(member_id AS STRING) AS id, vote_id, member_id,
          CASE (code - code % 100) / 100 WHEN 1 THEN 'for' WHEN 2 THEN 'against' WHEN 3 THEN 'abstention'
            WHEN 4 THEN 'present_not_voting' WHEN 5 THEN 'absent' ELSE 'unknown' END AS choice,
          'Brand#' || CAST(code % 100 AS STRING) AS group_id
        FROM (SELECT l_orderkey AS vote_id, l_partkey AS member_id,
                max(100 * CASE l_returnflag || l_linestatus WHEN 'AF' THEN 1 WHEN 'AO' THEN 2 WHEN 'NF' THEN 3
                  WHEN 'NO' THEN 4 WHEN 'RF' THEN 5 ELSE 6 END + l_suppkey % 25 + 1) AS code
              FROM {lineitem} GROUP BY l_orderkey, l_partkey) AS c""",
    # Totals are published for the votes whose key is not a multiple of 3.
    "group_totals": """
        SELECT CAST(o_orderkey AS STRING) || '-t' AS id, o_orderkey AS vote_id,
          'Brand#' || CAST(o_custkey % 25 + 1 AS STRING) AS group_id,
          CAST(o_custkey % 9 AS INT) AS for_count, CAST(o_custkey % 4 AS INT) AS against,
          CAST(o_custkey % 3 AS INT) AS abstention, CAST(o_custkey % 2 AS INT) AS present_not_voting
        FROM {orders} WHERE o_orderkey % 3 <> 0""",
    # One term per (part, line number): the row with the least (date, order, supplier).
    "terms": "",
    "mandates": """
        SELECT id, member_id, starts_on, ends_on,
          CASE WHEN line % 2 = 0 THEN 'senate' ELSE 'deputies' END AS chamber,
          CASE WHEN starts_on < DATE '1997-01-01' THEN 'L1995' WHEN starts_on < DATE '1999-01-01' THEN 'L1997'
            WHEN starts_on < DATE '2001-01-01' THEN 'L1999' ELSE 'L2001' END AS legislature_id,
          CASE WHEN supp % 7 = 0 THEN NULL ELSE 'Circ ' || CAST(supp % 42 AS STRING) END AS constituency
        FROM {terms}""",
    "memberships": """
        SELECT id, member_id, CAST(starts_on + 10 * line AS DATE) AS starts_on,
          CAST(ends_on + 10 * line AS DATE) AS ends_on, 'Brand#' || CAST(supp % 25 + 1 AS STRING) AS group_id
        FROM {terms}""",
    "affiliations": f"""
        SELECT id, member_id, CAST(starts_on + 3 AS DATE) AS starts_on, CAST(ends_on - 20 AS DATE) AS ends_on,
          {PARTY_OF_NUMBER.replace('{n}', 'supp % 6')} AS party_id,
          CASE WHEN supp % 4 = 0 THEN NULL ELSE 'logo-' || CAST(supp % 5 AS STRING) || '.png' END AS logo_url
        FROM {{terms}}""",
    "committee_terms": """
        SELECT id, member_id, starts_on, ends_on,
          CASE WHEN supp % 2 = 0 THEN 'senate' ELSE 'deputies' END AS chamber,
          'Comisia ' || CAST(supp % 10 AS STRING) AS committee_name
        FROM {terms}""",
    "role_terms": """
        SELECT id, member_id, starts_on, CAST(starts_on + 60 * line AS DATE) AS ends_on,
          CASE WHEN line % 2 = 0 THEN 'senate' ELSE 'deputies' END AS chamber,
          'Rol ' || CAST(supp % 5 AS STRING) AS title
        FROM {terms}""",
    "governments": """
        SELECT n_nationkey AS id, n_name || CASE WHEN n_nationkey % 5 = 4 THEN ' interimar' ELSE '' END AS name,
          CAST(DATE '1995-01-01' + 110 * n_nationkey AS DATE) AS starts_on,
          CASE WHEN n_nationkey = 24 THEN NULL ELSE CAST(DATE '1995-01-01' + 110 * n_nationkey + 115 AS DATE) END AS ends_on,
          n_regionkey AS prime_minister_id
        FROM {nation}""",
    "government_party_alignments": "",
    "group_alignments": """
        SELECT CAST(n_nationkey AS STRING) || '-g' AS id,
          'Brand#' || CAST(n_nationkey % 25 + 1 AS STRING) AS target_id,
          CAST(DATE '1995-06-01' + 60 * n_nationkey AS DATE) AS starts_on,
          CAST(DATE '1996-12-01' + 60 * n_nationkey AS DATE) AS ends_on,
          CASE n_nationkey % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'government' ELSE 'mixed' END AS alignment,
          CASE n_nationkey % 2 WHEN 0 THEN 'official_source' ELSE 'computed_vote_support' END AS basis
        FROM {nation}""",
    "member_alignments": """
        SELECT CAST(s_suppkey AS STRING) || '-m' AS id, s_suppkey AS target_id,
          CAST(DATE '1996-01-01' + 5 * CAST(s_nationkey AS INT) AS DATE) AS starts_on,
          CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '1999-06-30' END AS ends_on,
          CASE s_suppkey % 2 WHEN 0 THEN 'unaffiliated' ELSE 'government' END AS alignment,
          'manual_curation' AS basis
        FROM {supplier}""",
    "reactions": """
        SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'vote' ELSE 'bill' END AS entity_type,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS entity_id, 'hot' AS reaction,
          user_id AS visitor, ts AS created_at
        FROM {events} WHERE event_type = 'click'""",
    "engagement": """
        SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'search' ELSE 'page_view' END AS event_type,
          CASE event_id % 4 WHEN 0 THEN 'vote' WHEN 1 THEN 'bill' WHEN 2 THEN 'member' ELSE 'party' END AS entity_type,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS entity_id,
          CASE WHEN event_type = 'purchase' THEN 'cautare ' || CAST(user_id % 40 AS STRING) END AS query_text,
          ts AS occurred_at
        FROM {events} WHERE event_type IN ('view', 'purchase')""",
    "docs": """
        SELECT doc_id AS id, CAST((doc_id - doc_id % 5) / 5 AS BIGINT) AS bill_no, CAST(doc_id % 5 AS INT) AS kind_no, lang, source, text
        FROM {documents}""",
    "doc_reviews": """
        SELECT doc_id, CASE quality WHEN 0 THEN 'open' ELSE 'accepted' END AS status FROM {labels}""",
    "discoveries": """
        SELECT page_id AS id, CASE page_id % 2 WHEN 0 THEN 'senate' ELSE 'deputies' END AS chamber,
          CASE page_id % 3 WHEN 0 THEN 'bill' ELSE 'vote' END AS kind, url AS source_url,
          CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'L' || CAST(page_id AS STRING) || '/1998' END AS official_id,
          CASE page_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' WHEN 3 THEN 'imported' ELSE 'skipped' END AS status,
          CAST(page_id % 4 AS INT) AS failure_count,
          CAST(DATE '1998-01-01' + CAST(page_id % 900 AS INT) AS DATE) AS first_seen,
          CAST(DATE '1999-01-01' + CAST(page_id % 700 AS INT) AS DATE) AS last_seen
        FROM {pages}""",
    # Bills that share titles, votes that quote them, and discoveries of votes' own addresses.
    "named_bills": """
        SELECT id, 'Proiect de lege privind ' || lower(status) || ' ' || CAST(id % 20 AS STRING) AS title, chamber_of_origin,
          senate_identifier, deputies_identifier, source_id FROM {bills}""",
    "titled_votes": """
        SELECT v.id, v.bill_id, v.chamber,
          CASE WHEN v.id % 3 = 0 THEN 'Raport comun despre ' || b.title || ' x' WHEN v.id % 31 = 1 THEN 'Vot asupra AMA ' || CAST(v.id AS STRING) || ' la proiect'
            ELSE v.title END AS title,
          v.held_on, v.present, v.for_count, v.against, v.abstention, v.present_not_voting,
          CASE WHEN v.id % 7 = 0 THEN NULL ELSE CAST(v.id % 4 AS INT) END AS absent, v.source_id
        FROM {votes} AS v JOIN {orders} AS o ON o.o_orderkey = v.id JOIN {named_bills} AS b ON b.id = o.o_custkey""",
    "found_pages": """
        SELECT id, chamber, kind,
          CASE WHEN id % 6 = 1 THEN 'https://www.chamber.example/pls/vot?idv=' || CAST(id AS STRING)
            WHEN id % 6 = 3 THEN 'http://www.chamber.example/bill/' || CAST(id % 700 AS STRING) ELSE source_url END AS source_url,
          official_id, CASE WHEN id % 4 = 1 THEN 'Despre proiect de lege privind building ' || CAST(id % 20 AS STRING) END AS title,
          CAST(DATE '1997-01-01' + CAST(id % 900 AS INT) AS DATE) AS discovered_on, status FROM {discoveries}""",
    "formation_events": """
        SELECT n_nationkey AS id, CAST(DATE '1995-04-01' + 90 * n_nationkey AS DATE) AS occurred_on,
          CASE n_nationkey % 4 WHEN 0 THEN 'party_merged' WHEN 1 THEN 'party_absorbed' WHEN 2 THEN 'party_renamed'
            ELSE 'party_founded' END AS event_type, 'Eveniment ' || n_name AS title
        FROM {nation}""",
    "formation_entities": f"""
        SELECT n_nationkey AS event_id, 'party' AS entity_type, 'absorbed' AS role,
          {PARTY_OF_NUMBER.replace('{n}', 'n_nationkey % 6')} AS entity_id
        FROM {{nation}}
        UNION ALL
        SELECT n_nationkey, 'party', 'absorber', {PARTY_OF_NUMBER.replace('{n}', '(n_nationkey + 1) % 6')} FROM {{nation}}""",
}

_SPARK_ONLY = {
    "terms": """
        SELECT CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, l_partkey AS member_id,
          l_linenumber AS line, CAST(r.l_shipdate AS DATE) AS starts_on,
          CASE WHEN r.l_quantity > 45 THEN NULL
               ELSE date_add(CAST(r.l_shipdate AS DATE), CAST(40 * r.l_quantity AS INT)) END AS ends_on,
          CAST(r.l_suppkey AS INT) AS supp
        FROM (SELECT l_partkey, l_linenumber,
                min(struct(l_shipdate, l_orderkey, l_suppkey, l_quantity)) AS r
              FROM {lineitem} GROUP BY l_partkey, l_linenumber)""",
    "government_party_alignments": f"""
        SELECT concat_ws('-', n_nationkey, k) AS id, n_nationkey AS government_id,
          {PARTY_OF_NUMBER.replace('{n}', '(n_nationkey + k) % 6')} AS party_id,
          CASE (n_nationkey + 2 * k) % 4 WHEN 0 THEN 'government' WHEN 1 THEN 'support' WHEN 2 THEN 'opposition'
            ELSE 'unknown' END AS alignment,
          'manual_curation' AS basis,
          date_add(DATE '1995-01-01', 110 * n_nationkey + 9 * k) AS starts_on,
          CASE WHEN k = 0 THEN NULL ELSE date_add(DATE '1995-01-01', 110 * n_nationkey + 9 * k + 40) END AS ends_on
        FROM (SELECT n_nationkey, explode(sequence(0, 3)) AS k FROM {{nation}})""",
}

_SQL_ONLY = {
    "terms": """
        SELECT CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, l_partkey AS member_id,
          l_linenumber AS line, CAST(l_shipdate AS DATE) AS starts_on,
          CASE WHEN l_quantity > 45 THEN NULL
               ELSE CAST(CAST(l_shipdate AS DATE) + CAST(40 * l_quantity AS INT) AS DATE) END AS ends_on,
          CAST(l_suppkey AS INT) AS supp
        FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey, l_linenumber
          ORDER BY l_shipdate, l_orderkey, l_suppkey, l_quantity) = 1""",
    "government_party_alignments": f"""
        SELECT CAST(n_nationkey AS STRING) || '-' || CAST(k AS STRING) AS id, n_nationkey AS government_id,
          {PARTY_OF_NUMBER.replace('{n}', '(n_nationkey + k) % 6')} AS party_id,
          CASE (n_nationkey + 2 * k) % 4 WHEN 0 THEN 'government' WHEN 1 THEN 'support' WHEN 2 THEN 'opposition'
            ELSE 'unknown' END AS alignment,
          'manual_curation' AS basis,
          CAST(DATE '1995-01-01' + CAST(110 * n_nationkey + 9 * k AS INT) AS DATE) AS starts_on,
          CASE WHEN k = 0 THEN NULL
            ELSE CAST(DATE '1995-01-01' + CAST(110 * n_nationkey + 9 * k + 40 AS INT) AS DATE) END AS ends_on
        FROM (SELECT n_nationkey, unnest(generate_series(0, 3)) AS k FROM nation)""",
}


def _for_check(name: str, text: str) -> str:
    text = _SQL_ONLY.get(name, text)
    text = re.sub(r"\{(\w+)\}", r"\1", text)
    # '/' divides whole numbers to a fraction in both engines; the operands here are exact.
    return text


SQL_VIEWS: dict[str, str] = {name: _for_check(name, text) for name, text in VIEWS.items()}


class Tables:
    """Lazy access: ``t.votes`` is the DataFrame of the view ``votes``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in VIEWS:
                text = _SPARK_ONLY.get(name, VIEWS[name])
                reads = {used: getattr(self, used) for used in set(re.findall(r"\{(\w+)\}", text))}
                self._cache[name] = self.spark.sql(text, **reads)
            elif name in BASE_TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._cache[name]
