"""Queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import documents as fd
from annalist.operators import documents as dx
from annalist.plans.registry import query

WS = r"\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def strip_sql(x):
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def lines_sql(x):
    return f"list_filter(list_transform(string_split_regex({x}, '[\\r\\n]+'), lambda l: {strip_sql('l')}), lambda l: length(l) > 0)"


CLEAN_SQL = strip_sql(r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


def legal(t):
    """Documents with article headings set between their lines: the third line
    of each six opens an article, the fifth an amendment."""
    lines = F.split("text", "\n")
    made = F.transform(lines, lambda x, i: F.when(i % 6 == 2, F.concat(F.lit("Art. "), (i % 24).cast("string"), F.lit("\n"), x)).when(
        i % 6 == 4, F.concat(F.lit("La articolul "), i.cast("string"), F.lit(" se modifica\n"), x)).otherwise(x))
    return t.docs.withColumn("text", F.array_join(made, "\n"))


LEGAL_SQL = """legal AS (SELECT * EXCLUDE text, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
      CASE WHEN (i - 1) % 6 = 2 THEN 'Art. ' || ((i - 1) % 24) || chr(10) || x
           WHEN (i - 1) % 6 = 4 THEN 'La articolul ' || (i - 1) || ' se modifica' || chr(10) || x ELSE x END), chr(10)) AS text FROM docs)"""

SECTIONS_SQL = LEGAL_SQL + f""",
    lines AS (SELECT id, unnest({lines_sql('text')}) AS line, generate_subscripts({lines_sql('text')}, 1) AS pos FROM legal),
    typed AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^art\\.?\\s+[0-9ivxlcdm]+[¹²³]?[.)]?$') THEN 'article'
        WHEN regexp_matches(line, '(?i)^la\\s+articolul\\s+[0-9ivxlcdm]+[¹²³]?.*$') THEN 'amendment' END AS kind FROM lines),
    numbered AS (SELECT *, sum(CASE WHEN kind IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS n FROM typed),
    parts AS (SELECT id AS document_id, n, coalesce(max(line) FILTER (kind IS NOT NULL), 'Document') AS heading,
        coalesce(max(kind), 'preamble') AS section_type, nullif(regexp_extract(max(line) FILTER (kind IS NOT NULL), '[0-9]+'), '') AS number,
        string_agg(line, chr(10) ORDER BY pos) AS text FROM numbered GROUP BY 1, 2),
    sections AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n) AS position,
        regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS key FROM parts)"""


@query("x2_text_chunks", "X1 X2", f"""
    WITH c AS (SELECT id, {CLEAN_SQL} AS t FROM docs),
      p AS (SELECT id, list_filter(list_transform(generate_series(0, greatest(CAST(ceil(length(t) / 1800) AS BIGINT) - 1, 0)),
        lambda i: {strip_sql("substr(t, CAST(i * 1800 + 1 AS BIGINT), 1800)")}), lambda x: length(x) > 0) AS a FROM c)
    SELECT id AS document_id, unnest(generate_series(0, len(a) - 1)) AS chunk_index, unnest(a) AS text FROM p WHERE len(a) > 0""")
def _(t):
    return dx.chunk_rows(t.docs)


@query("g28_assembled_text", "G28", f"""
    WITH c AS (SELECT id, {CLEAN_SQL} AS t FROM docs),
      p AS (SELECT id, list_filter(list_transform(generate_series(0, greatest(CAST(ceil(length(t) / 1800) AS BIGINT) - 1, 0)),
        lambda i: {strip_sql("substr(t, CAST(i * 1800 + 1 AS BIGINT), 1800)")}), lambda x: length(x) > 0) AS a FROM c)
    SELECT id AS document_id, len(a) AS chunk_count, array_to_string(a, chr(10)) AS text FROM p WHERE len(a) > 0""")
def _(t):
    return dx.assemble(dx.chunk_rows(t.docs))


# Offsets: raw lines by a running sum of their lengths, the heads among those that are not empty.
OFFSETS_SQL = SECTIONS_SQL + f""",
    raw AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM (SELECT id, replace(text, chr(13), chr(10)) AS text FROM legal)),
    placed AS (SELECT id, pos, {strip_sql('line')} AS line, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM raw),
    kept AS (SELECT id, off, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos FROM placed WHERE length(line) > 0),
    heads AS (SELECT k.id AS document_id, n, CAST(min(off) AS BIGINT) AS start_offset FROM kept k JOIN numbered t ON t.id = k.id AND t.pos = k.pos GROUP BY 1, 2),
    offsets AS (SELECT document_id, n, start_offset, coalesce(lead(start_offset) OVER (PARTITION BY document_id ORDER BY n), length(l.text)) AS end_offset FROM heads JOIN legal l ON l.id = document_id)"""


@query("x3_document_sections", "X3 X5", "WITH " + OFFSETS_SQL + """
    SELECT s.document_id, position, heading, section_type, number, key, key || '-' || position AS section_id, text, start_offset, end_offset
    FROM sections s JOIN offsets o ON o.document_id = s.document_id AND o.n = s.n""")
def _(t):
    return dx.section_rows(legal(t)).select("document_id", "position", "heading", "section_type", "number", "key", "section_id", "text", "start_offset", "end_offset")


WARNINGS_SQL = SECTIONS_SQL + r""",
    stats AS (SELECT document_id, count(*) FILTER (section_type <> 'preamble') AS own, count(*) AS total, max(length(text)) AS longest,
        count(DISTINCT key) FILTER (section_type <> 'preamble') AS keys, bool_and(section_type = 'amendment') FILTER (section_type <> 'preamble') AS minor,
        count(*) FILTER (section_type <> 'preamble' AND length(text) < 80) AS short FROM sections GROUP BY 1),
    w AS (SELECT l.id AS document_id, coalesce(s.total, 0) AS sections, coalesce(own, 0) AS own, list_filter([
        CASE WHEN coalesce(own, 0) = 0 AND length(text) > 700 THEN 'no_structural_headings' END,
        CASE WHEN (own > 0 AND minor) OR (coalesce(own, 0) = 0 AND regexp_matches(text, '(?i)\b(se\s+modific[ăa]|se\s+completeaz[ăa]|se\s+abrog[ăa]|va\s+avea\s+urm[ăa]torul\s+cuprins|dup[ăa]\s+.*se\s+introduce)\b')) THEN 'amendment_only_document' END,
        CASE WHEN longest > 8000 THEN 'huge_section' END, CASE WHEN keys < own THEN 'duplicate_section_heading' END,
        CASE WHEN own >= 8 AND short / own > 0.5 THEN 'too_many_short_sections' END], lambda x: x IS NOT NULL) AS ws, text
        FROM legal l LEFT JOIN stats s ON s.document_id = l.id)"""


@query("x4_section_warnings", "X4", "WITH " + WARNINGS_SQL + """
    SELECT document_id, sections, array_to_string(CASE WHEN sections = 0 THEN ['empty_text'] ELSE ws END, ',') AS warnings,
      CASE WHEN sections > 0 AND len(ws) = 0 THEN 'good' WHEN sections > 0 AND len(ws) <= 2 AND own > 0 THEN 'partial' ELSE 'weak' END AS quality FROM w""")
def _(t):
    return dx.parse_sections(legal(t)).select(
        "document_id", F.size("sections").alias("sections"), F.array_join("warnings", ",").alias("warnings"), "quality")


DIFF_SQL = SECTIONS_SQL + """,
    one AS (SELECT document_id, key, arg_max(heading, position) AS heading, arg_max(text, position) AS text FROM sections GROUP BY 1, 2),
    pairs AS (SELECT * FROM (SELECT bill_no, id AS from_id, lead(id) OVER (PARTITION BY bill_no ORDER BY kind_no) AS to_id FROM docs) WHERE to_id IS NOT NULL),
    b AS (SELECT p.from_id, p.to_id, o.* FROM pairs p JOIN one o ON o.document_id = p.from_id),
    a AS (SELECT p.from_id, p.to_id, o.* FROM pairs p JOIN one o ON o.document_id = p.to_id),
    diff AS (SELECT coalesce(a.from_id, b.from_id) AS from_id, coalesce(a.to_id, b.to_id) AS to_id, coalesce(a.key, b.key) AS key,
        coalesce(a.heading, b.heading) AS heading, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed'
        WHEN lower(trim(regexp_replace(a.text, '[""" + WS + """]+', ' ', 'g'))) = lower(trim(regexp_replace(b.text, '[""" + WS + """]+', ' ', 'g'))) THEN 'unchanged' ELSE 'changed' END AS status,
        b.text AS before, a.text AS after
        FROM a FULL JOIN b ON a.from_id = b.from_id AND a.to_id = b.to_id AND a.key = b.key)"""


def diff(t):
    docs = legal(t)
    return dx.section_diff(dx.consecutive_pairs(docs, "bill_no", "kind_no"), dx.section_rows(docs))


@query("w18_consecutive_documents", "W18", """
    SELECT * FROM (SELECT bill_no, id AS from_id, lead(id) OVER (PARTITION BY bill_no ORDER BY kind_no) AS to_id FROM docs) WHERE to_id IS NOT NULL""")
def _(t):
    return dx.consecutive_pairs(t.docs, "bill_no", "kind_no")


EX_SQL = "CASE WHEN length({x}) > 900 THEN trim(substr({x}, 1, 900)) || '...' ELSE {x} END"


@query("x6_section_diff", "X6 X8", "WITH " + DIFF_SQL + f"""
    SELECT from_id, to_id, key, heading, status, before, after, {EX_SQL.format(x='trim(before)')} AS before_excerpt, {EX_SQL.format(x='trim(after)')} AS after_excerpt FROM diff""")
def _(t):
    return dx.with_excerpts(diff(t))


@query("x12_changed_document_pairs", "X12 X6", "WITH " + DIFF_SQL + """
    SELECT from_id, to_id, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
      count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged FROM diff GROUP BY 1, 2
    HAVING count(*) FILTER (status <> 'unchanged') > 0""")
def _(t):
    return dx.changed_pairs(diff(t))


@query("x7_word_diff", "X7")
def _(t):
    return dx.word_diff(diff(t))


HEALTH_SQL = f"""
    SELECT id AS document_id, length(text) AS char_count, len(lines) AS line_count,
      len(regexp_extract_all(text, '(?i)\\b(lege|proiect|guvern|parlament|articol|art\\.|alin\\.|rom[aâ]niei)\\b')) AS vocabulary_hits,
      floor(CASE WHEN length(text) = 0 THEN 1.0 ELSE length(regexp_replace(text, '[\\p{{L}}\\p{{N}}{WS}.,;:!?''"()/\\-\\[\\]{{}}%+*=<>]', '', 'g')) / length(text) END * 1000 + 0.5) / 1000 AS odd_ratio,
      floor(CASE WHEN len(lines) = 0 THEN 0.0 ELSE (len(lines) - len(list_distinct(list_transform(lines, lambda l: lower(l))))) / len(lines) END * 1000 + 0.5) / 1000 AS repeated_ratio
    FROM (SELECT id, text, {lines_sql('text')} AS lines FROM docs)"""
REASONS_SQL = f"""
    SELECT *, list_filter([CASE WHEN char_count > 0 AND char_count < 500 THEN 'very_short_text' END,
      CASE WHEN char_count >= 500 AND vocabulary_hits < 3 THEN 'low_legal_vocabulary' END, CASE WHEN odd_ratio > 0.08 THEN 'high_noise_ratio' END,
      CASE WHEN repeated_ratio > 0.35 AND line_count >= 12 THEN 'high_repeated_line_ratio' END], lambda x: x IS NOT NULL) AS rs FROM ({HEALTH_SQL})"""


def scored(t):
    return dx.health(t.docs.withColumn("chunk_count", F.lit(1)).withColumnRenamed("id", "document_id"), "chunk_count")


@query("x9_text_health", "X9", f"SELECT * EXCLUDE rs, array_to_string(rs, ',') AS reasons FROM ({REASONS_SQL})")
def _(t):
    return scored(t).drop("chunk_count").withColumn("reasons", F.array_join("reasons", ","))


_B = r"\b"
AUDIT_SQL = f"""
    SELECT id AS document_id, length(text) AS char_count,
      len(list_filter(string_split_regex(text, '[{WS}]+'), lambda w: length(w) > 0)) AS word_count, len(lines) AS line_count,
      {' + '.join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in (
        r'\blege\b', r'\bproiect\b', r'\bord(onanta|onanța|onanţă|onan[țt]e)\b', r'\bart(icolul)?\.?\b', r'\balin\.?\b', r'\blit\.?\b',
        r'\bguvern', r'\bparlament', r'\bmonitorul oficial\b', r'\brom[aâ]niei\b'))} AS vocabulary_hits,
      CASE WHEN length(text) = 0 THEN 1.0 ELSE length(regexp_replace(text, '[\\p{{L}}\\p{{N}}{WS}.,;:!?''"()/\\-\\[\\]{{}}%+*=<>]', '', 'g')) / length(text) END AS odd,
      CASE WHEN len(lines) = 0 THEN 0.0 ELSE (len(lines) - len(list_distinct(list_transform(lines, lambda l: lower(l))))) / len(lines) END AS rep,
      substr(text, 1, 320) AS preview
    FROM (SELECT id, text, {lines_sql('text')} AS lines FROM docs)"""
AUDIT_ROWS_SQL = f"""
    SELECT document_id, char_count, word_count, line_count, vocabulary_hits, floor(odd * 10000 + 0.5) / 10000 AS odd_ratio,
      floor(rep * 10000 + 0.5) / 10000 AS repeated_ratio, preview,
      array_to_string(list_filter([CASE WHEN char_count > 0 AND char_count < 300 THEN 'very_short_text' END,
        CASE WHEN char_count >= 300 AND vocabulary_hits < 3 THEN 'low_legal_vocabulary' END, CASE WHEN odd > 0.08 THEN 'high_noise_ratio' END,
        CASE WHEN rep > 0.35 AND line_count >= 12 THEN 'high_repeated_line_ratio' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ({AUDIT_SQL})"""


def audited(t):
    return dx.quality_audit(t.docs.withColumn("chunk_count", F.lit(1)).withColumnRenamed("id", "document_id"), "chunk_count", 300)


@query("x10_text_quality_audit", "X10", AUDIT_ROWS_SQL)
def _(t):
    return audited(t).drop("chunk_count").withColumn("reasons", F.array_join("reasons", ","))


@query("x10_text_quality_counts", "X10", f"""
    SELECT count(*) AS scanned, count(*) FILTER (reasons <> '') AS suspicious, 0 AS missing_text_chunks,
      count(*) FILTER (reasons LIKE '%very_short%') AS very_short_text, count(*) FILTER (reasons LIKE '%low_legal%') AS low_legal_vocabulary,
      count(*) FILTER (reasons LIKE '%noise%') AS high_noise_ratio, count(*) FILTER (reasons LIKE '%repeated%') AS high_repeated_line_ratio
    FROM ({AUDIT_ROWS_SQL})""")
def _(t):
    return dx.reason_counts(audited(t))


def _hits_sql(word: str) -> str:
    """Non-overlapping hit positions, found by walking the text."""
    return f"""WITH RECURSIVE h AS (SELECT id, lower(text) AS low, text, CAST(strpos(lower(text), '{word}') AS BIGINT) AS p, 1 AS n FROM docs WHERE strpos(lower(text), '{word}') > 0
      UNION ALL SELECT id, low, text, p + {len(word)} - 1 + strpos(substr(low, p + {len(word)}), '{word}'), n + 1 FROM h
        WHERE strpos(substr(low, p + {len(word)}), '{word}') > 0)
    SELECT id AS document_id, count(*) AS hits, string_agg(CASE WHEN p > 121 THEN '...' ELSE '' END
      || {strip_sql(f"substr(text, greatest(p - 120, 1), least(p - 1, 120) + {len(word)} + 160)")}
      || CASE WHEN p - 1 + {len(word)} + 160 < length(text) THEN '...' ELSE '' END, '|' ORDER BY n) AS snippets FROM h GROUP BY 1"""


@query("x11_document_search", "X11", _hits_sql("ation"))
def _(t):
    return dx.search(t.docs, " Ation ").select("document_id", F.size("snippets").alias("hits"), F.array_join("snippets", "|").alias("snippets"))


@query("x11_searchable_documents", "X11", f"""
    SELECT d.id FROM docs d JOIN ({REASONS_SQL}) h ON h.document_id = d.id
    WHERE len(h.rs) = 0 OR d.id IN (SELECT doc_id FROM doc_reviews WHERE status IN ('accepted', 'reviewed'))""")
def _(t):
    return dx.searchable(t.docs.select("id"), scored(t), t.doc_reviews)


@query("x13_document_confidence", "X13 F41", "WITH " + SECTIONS_SQL.replace("FROM legal)", "FROM legal)") + f"""
    SELECT d.id AS document_id, CASE WHEN d.kind_no = 3 THEN 'missing_text' WHEN d.kind_no = 4 THEN 'unsupported_text'
      WHEN coalesce(r.ok, false) THEN 'accepted_ocr' WHEN len(h.rs) > 0 OR s.document_id IS NULL OR s.bad THEN 'needs_review' ELSE 'ocr_extracted' END AS confidence
    FROM docs d JOIN ({REASONS_SQL}) h ON h.document_id = d.id
    LEFT JOIN (SELECT doc_id, bool_or(status IN ('accepted', 'reviewed')) AS ok FROM doc_reviews GROUP BY 1) r ON r.doc_id = d.id
    LEFT JOIN (SELECT document_id, (count(*) FILTER (section_type <> 'preamble') > 0 AND bool_and(section_type = 'amendment') FILTER (section_type <> 'preamble'))
        OR max(length(text)) > 8000 OR count(DISTINCT key) FILTER (section_type <> 'preamble') < count(*) FILTER (section_type <> 'preamble')
        OR (count(*) FILTER (section_type <> 'preamble') >= 8 AND count(*) FILTER (section_type <> 'preamble' AND length(text) < 80) / count(*) FILTER (section_type <> 'preamble') > 0.5)
        OR (count(*) FILTER (section_type <> 'preamble') = 0 AND max(length(l.lt)) > 700) AS bad
      FROM sections JOIN (SELECT id, text AS lt FROM legal) l ON l.id = document_id GROUP BY 1) s ON s.document_id = d.id""")
def _(t):
    status = F.when(F.col("kind_no") == 3, "missing").when(F.col("kind_no") == 4, "failed").otherwise("stored")
    return dx.confidence(t.docs.withColumn("text_status", status), scored(t), dx.parse_sections(legal(t)), t.doc_reviews)
