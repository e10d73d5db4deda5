"""Queries that run the column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions import classify as cl
from annalist.functions import dates as fd
from annalist.functions import identifiers as ids
from annalist.functions import text as tx
from annalist.functions import urls as ur
from annalist.plans.documents import WS
from annalist.plans.registry import query

FOLD = "lower(translate({x}, 'ăâîșşțţĂÂÎȘŞȚŢ', 'aaissttAAISSTT'))"
MARKS = "lower(strip_accents({x}))"


@query("f1_text_folds", "F1 F2 F3 F4 F5 F6", f"""
    SELECT id, trim(regexp_replace(l, '[{WS}]+', ' ', 'g')) AS cleaned, {FOLD.format(x='l')} AS folded, {MARKS.format(x='l')} AS bare,
      regexp_replace(regexp_replace({MARKS.format(x='l')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
      array_to_string(list_sort(string_split(trim(regexp_replace({MARKS.format(x='l')}, '[^a-z0-9]+', ' ', 'g')), ' ')), ' ') AS tokens
    FROM (SELECT id, replace(replace(replace(text, 'œ', 'oe'), 'ß', 'ss'), 'æ', 'ae') AS l FROM docs)""")
def _(t):
    # ligatures fold differently everywhere: spelled out first
    line = F.replace(F.replace(F.replace("text", F.lit("œ"), F.lit("oe")), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    return t.docs.select("id", line.alias("l")).select(
        "id", tx.clean(F.col("l")).alias("cleaned"), tx.fold(F.col("l")).alias("folded"), tx.fold_marks(F.col("l")).alias("bare"),
        tx.slug(F.col("l")).alias("slug"), tx.token_key(F.col("l")).alias("tokens"))


@query("f8_names", "F7 F8 F9 F10 F28 F38", """
    WITH n AS (SELECT id, display_name AS d, upper(display_name) AS u, party_id, last_name FROM members)
    SELECT id, string_split(d, ' ')[-1] AS last_name, array_to_string(string_split(d, ' ')[:-2], ' ') AS first_names,
      array_to_string(list_transform(string_split(lower(u), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS titled, d AS kept,
      array_to_string(list_transform(list_filter(string_split(d, ' '), lambda w: length(w) > 2), lambda w: upper(w[1:1])), '') AS acronym,
      coalesce(TRY_CAST(nullif(regexp_extract(last_name, '[0-9]+'), '') AS INT), 0) AS counted, party_id AS short_group, 'group-senate-' || lower(party_id) AS group_key, d AS detail FROM n""")
def _(t):
    d = F.col("display_name")
    return t.members.select(
        "id", tx.last_name(d).alias("last_name"), tx.first_names(d).alias("first_names"), tx.title_case(F.upper(d)).alias("titled"), tx.title_case(d).alias("kept"),
        tx.acronym(d).alias("acronym"), tx.parse_count(F.col("last_name")).alias("counted"),
        cl.group_short_name(F.concat(F.lit("Grupul parlamentar al "), F.col("party_id"))).alias("short_group"),
        cl.group_key(F.lit("senate"), F.col("party_id")).alias("group_key"),
        cl.history_detail(F.concat(d, F.lit(" data validării 3 mai 1999"))).alias("detail"))


@query("f11_dates_in_text", "F11 F12 F13 F14 F15", """
    SELECT id, held_on AS numeric, held_on AS named, strftime(held_on, '%Y-%m-%d') AS candidates, strftime(held_on, '%Y-%m-%d') AS after_phrase,
      date_trunc('month', held_on)::DATE AS period_from, CAST(date_trunc('month', held_on + 60) - INTERVAL 1 DAY AS DATE) AS period_to FROM votes""")
def _(t):
    month = F.element_at(F.array(*[F.lit(m) for m in fd.MONTHS]), F.month("held_on"))
    later = F.date_add("held_on", 60)
    until = F.element_at(F.array(*[F.lit(m) for m in fd.MONTHS]), F.month(later))
    spoken = F.concat_ws(" ", F.lit("Vot la"), F.dayofmonth("held_on").cast("string"), month, F.year("held_on").cast("string"), F.lit("in plen"))
    numeric = F.concat(F.lit("sedinta publica din data de "), F.date_format("held_on", "d.M.yyyy"), F.lit(", ora 9"))
    period = F.concat_ws(" ", F.lit("din"), month, F.year("held_on").cast("string"), F.lit("până în"), until, F.year(later).cast("string"))
    return t.votes.select(
        "id", fd.parse_date(numeric).alias("numeric"), fd.parse_date(spoken).alias("named"), F.array_join(fd.date_candidates(F.concat_ws(" ", spoken, numeric)), ",").alias("candidates"),
        fd.date_after(numeric, r"data\s+de\s+").alias("after_phrase"), fd.period_start(period).alias("period_from"), fd.period_end(period).alias("period_to"))


@query("f18_identifiers_parsed", "F18 F19 F20 F21", r"""
    WITH x AS (SELECT id, title, regexp_extract(title, '(?i)\bPL-x (\d+)/(\d{4})', 1) AS dn, regexp_extract(title, '(?i)\bPL-x (\d+)/(\d{4})', 2) AS dy,
        regexp_extract(title, '\bL(\d+)/(\d{4})', 1) AS sn, regexp_extract(title, '\bL(\d+)/(\d{4})', 2) AS sy FROM votes)
    SELECT id, CASE WHEN dn <> '' THEN 'deputies' WHEN sn <> '' THEN 'senate' END AS kind, CASE WHEN dn <> '' THEN 'PL-x ' || dn || '/' || dy WHEN sn <> '' THEN 'L' || sn || '/' || sy END AS value,
      CASE WHEN dn <> '' THEN 'bill-pl-x-' || dn || '-' || dy WHEN sn <> '' THEN 'bill-l' || sn || '-' || sy END AS bill, CAST(nullif(coalesce(nullif(dy, ''), sy), '') AS VARCHAR) AS year,
      CASE WHEN dn <> '' THEN 'PL-x ' || dn || '/' || dy WHEN sn <> '' THEN 'L' || sn || '/' || sy END AS canonical,
      coalesce(CASE WHEN dn <> '' THEN 'deputies' WHEN sn <> '' THEN 'senate,senate_l' END, '') AS record_keys FROM x""")
def _(t):
    title = F.col("title")
    found = t.votes.select("id", "title", ids.parse_identifier(title).alias("i"), ids.find_identifiers(title, ids.first_year(title)).alias("all"))
    return found.select("id", "i.kind", "i.value", ids.bill_id(F.col("i.value")).alias("bill"), ids.first_year(title).alias("year"),
                        ids.canonical(F.col("all"))["value"].alias("canonical"),
                        F.array_join(F.array_sort(F.map_keys(ids.identifier_record(F.col("all")))), ",").alias("record_keys"))


@query("f22_urls", "F22 F23 F24 F25", r"""
    WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?', ['p', 'h', 'a', 'q']) AS r FROM pages)
    SELECT page_id, lower(r.p) || '://' || lower(r.h) || r.a || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS canonical,
      regexp_replace(url, '^http://', 'https://') AS matching, nullif(regexp_extract(r.q, '(?:^|&)page=([^&]*)', 1), '') AS page, CAST(NULL AS VARCHAR) AS profile, CAST(NULL AS INT) AS year
    FROM (SELECT *, list_sort(list_filter(string_split(r.q, '&'), lambda p: p <> '' AND string_split(p, '=')[1] <> 'ref')) AS k FROM u)""")
def _(t):
    u = F.col("url")
    return t.pages.select("page_id", ur.canonical_url(u, drop=("ref",), drop_on=".").alias("canonical"), ur.match_url(u).alias("matching"), ur.query_param(u, "page").alias("page"),
                          ur.profile_key(u).alias("profile"), ur.year_of(u).alias("year"))


PARTY_RULES = [("economy", "P-ECO"), ("promo", "P-PRO"), ("^partidul s", "P-S"), ("partidul", "P-OTHER")]


@query("f27_rule_classifiers", "F27 F31 F32", """
    SELECT id, CASE WHEN name LIKE '%ECONOMY' THEN 'P-ECO' WHEN name LIKE '%PROMO' THEN 'P-PRO' WHEN name LIKE 'Partidul S%' THEN 'P-S' ELSE 'P-OTHER' END AS party,
      CAST(NULL AS VARCHAR) AS coalition, 'senate' AS chamber FROM parties""")
def _(t):
    return t.parties.select("id", cl.party_of(F.col("name"), PARTY_RULES).alias("party"),
                            cl.party_of(F.concat("name", F.lit(" (USL)")), PARTY_RULES).alias("coalition"), cl.chamber_in(F.concat("name", F.lit(" la Senat"))).alias("chamber"))


@query("f30_steps_and_kinds", "F29 F30 F31 F33", """
    SELECT id, label, CASE label WHEN 'Adoptat' THEN 'final_vote' WHEN 'Raport' THEN 'committee_report_received' ELSE 'other' END AS step,
      CASE label WHEN 'Adoptat' THEN 'other' WHEN 'Raport' THEN 'committee_report' ELSE 'other' END AS document, 'history_context' AS hint FROM bill_events""")
def _(t):
    label = F.col("label")
    return t.bill_events.select("id", "label", cl.step_type(F.when(label == "Adoptat", F.lit("Adoptat de Cameră")).when(label == "Raport", F.lit("Raport de la comisie")).otherwise(label)).alias("step"), cl.document_kind(label, F.lit("http://x/y")).alias("document"), cl.event_hint(label).alias("hint"))


@query("f35_legal_metadata", "F35", """
    SELECT id, CAST(id AS VARCHAR) || '/3/' || year(held_on) AS case_number, CAST(id AS VARCHAR) AS decision_number, strftime(held_on, '%Y-%m-%d') AS hearing_date,
      strftime(held_on + 30, '%Y-%m-%d') AS definitive_date FROM votes""")
def _(t):
    text = F.concat(F.lit("Potrivit sentinței civile nr. "), F.col("id").cast("string"), F.lit(" pronunţată la şedinţa publică din data de "), F.date_format("held_on", "d.M.yyyy"),
                    F.lit(" în dosarul nr. "), F.col("id").cast("string"), F.lit("/3/"), F.year("held_on").cast("string"), F.lit(", definitivă la data de "),
                    F.date_format(F.date_add("held_on", 30), "dd.MM.yyyy"))
    return t.votes.select("id", cl.legal_metadata(text).alias("m")).select("id", "m.case_number", "m.decision_number", "m.hearing_date", "m.definitive_date")


@query("f39_tracked_searches", "F39 F40", """
    SELECT id, substr(lower(query_text), 1, 120) AS tracked, sha256(substr(lower(query_text), 1, 120)) AS query_hash, sha256('salt:' || entity_id) AS visitor
    FROM engagement WHERE event_type = 'search'""")
def _(t):
    tracked = tx.tracked_query(F.col("query_text"))
    return t.engagement.where("event_type = 'search'").select("id", tracked.alias("tracked"), F.sha2(tracked, 256).alias("query_hash"),
                                                               tx.pseudonym("salt", F.col("entity_id")).alias("visitor"))


@query("f41_source_confidence", "F41", """
    SELECT id, CASE WHEN status = 'failed' AND id LIKE 'sb%' THEN 'needs_review' WHEN status IN ('partial', 'failed') THEN 'partial_dossier' ELSE 'official_parsed' END AS confidence FROM sources""")
def _(t):
    issue = (F.col("status") == "failed") & F.col("id").startswith("sb")
    return t.sources.select("id", cl.source_confidence(F.col("status"), issue).alias("confidence"))


@query("f45_lenient_json", "F45 B8", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS keys, CASE WHEN event_id % 3 = 0 THEN NULL ELSE regexp_extract(props, '[0-9]+') END AS k FROM events""")
def _(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{bad "), "props")).otherwise(F.col("props"))
    parsed = F.coalesce(F.from_json(raw, T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))
    return t.events.select("event_id", parsed.alias("m")).select("event_id", F.size("m").alias("keys"), F.col("m")["k"].alias("k"))


# Labels and what they are read as: the rule tables met by real wordings.
PARTY_LABELS = (
    ("Partidul Social Democrat", "psd"), ("PNL", "pnl"), ("Uniunea Salvați România", "usr"), ("AUR", "aur"), ("U.D.M.R.", None), ("UDMR", "udmr"),
    ("Alianța Liberalilor și Democraților", "alde"), ("Partidul Democrației Sociale din România", "pdsr"), ("Uniunea Social Liberală", None),
    ("Convenția Democrată Română", None), ("Minoritățile naționale", "minoritati"), ("Frontul Salvării Naționale", "fsn"), ("S.O.S. România", "sos-ro"), ("Formațiune nouă", None),
)
STEP_LABELS = (
    ("Curtea Constituțională", "constitutional_review"), ("Adoptat de Senat", "adopted_by_senate"), ("Vot final", "final_vote"), ("Trimis la promulgare", "promulgation"),
    ("Dezbatere în plenul Camerei", "plenary_debate"), ("Primire raport", "committee_report_received"), ("Primire aviz", "committee_opinion_received"),
    ("Trimis pentru aviz", "committee_opinion_requested"), ("Trimis pentru raport", "sent_to_committee"), ("Înaintat la Senat", "sent_to_senate"),
    ("Înregistrat la Camera Deputaților", "sent_to_deputies"), ("Prezentare în plen", "registered"), ("Altceva", "other"),
)
DOCUMENT_LABELS = (
    ("Forma adoptată de Cameră", "adopted_form"), ("Forma pentru promulgare", "promulgation_form"), ("pl123_cd_1.pdf", "adopted_form"), ("Proiect de lege", "proposal"),
    ("Forma adoptată de Senat", "senate_adopted_form"), ("Raport", "committee_report"), ("av12.pdf", "committee_opinion"), ("Adresa", "other"),
)
HINT_LABELS = (
    ("A fost reînființat", "party_reestablished"), ("Fondat în 1990", "party_founded"), ("A fost absorbit", "party_absorbed"), ("A fuzionat", "party_merged"), ("Alianța", "alliance_context"),
    ("S-a dizolvat", "party_or_alliance_dissolved"), ("Redenumit", "party_renamed"), ("S-a desprins", "party_split"), ("Un congres", "history_context"),
)


def _picked(labels, number):
    return F.element_at(F.array(*[F.lit(said) for said, _ in labels]), (number % len(labels) + 1).cast("int"))


def _expected_sql(labels, number):
    cases = " ".join(f"WHEN {k} THEN " + ("NULL" if read is None else f"'{read}'") for k, (_, read) in enumerate(labels))
    return f"CASE {number} % {len(labels)} {cases} END"


@query("f27_party_labels", "F27", f"SELECT p_partkey AS id, {_expected_sql(PARTY_LABELS, 'p_partkey')} AS party FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), cl.party_of(_picked(PARTY_LABELS, F.col("p_partkey"))).alias("party"))


@query("f29_steps_documents_hints", "F29 F30 F33", f"""SELECT id, {_expected_sql(STEP_LABELS, 'id')} AS step, {_expected_sql(DOCUMENT_LABELS, 'id')} AS document, {_expected_sql(HINT_LABELS, 'id')} AS hint FROM votes""")
def _(t):
    n = F.col("id")
    return t.votes.select("id", cl.step_type(_picked(STEP_LABELS, n)).alias("step"), cl.document_kind(_picked(DOCUMENT_LABELS, n), F.lit("")).alias("document"),
                          cl.event_hint(_picked(HINT_LABELS, n)).alias("hint"))


@query("f31_bill_facts", "F31", """
    SELECT id, CASE id % 4 WHEN 0 THEN 'deputies' WHEN 1 THEN 'senate' WHEN 2 THEN 'deputies' ELSE 'unknown' END AS origin, CASE id % 3 WHEN 0 THEN 'deputies' WHEN 1 THEN 'senate' END AS decided_by,
      CASE WHEN id % 5 = 0 THEN 'unknown' ELSE 'la comisii ' || id END AS stage, CASE id % 3 WHEN 0 THEN 'Guvernul României' WHEN 1 THEN 'deputat ' || id ELSE 'Inițiator necunoscut' END AS sponsor,
      CASE id % 3 WHEN 0 THEN 'senate' WHEN 1 THEN 'deputies' END AS source, CASE WHEN id % 2 = 0 THEN 'Comisia pentru buget ' || id END AS committee FROM bills""")
def _(t):
    n, s = F.col("id"), F.col("id").cast("string")
    way = F.when(n % 4 == 0, "Înaintat la Senat").when(n % 4 == 1, "transmisă Camerei Deputaților").when(n % 4 == 2, "Camera Deputaților").otherwise("plen")
    decides = F.when(n % 3 == 0, " | Cameră decizională: Camera Deputaților |").when(n % 3 == 1, " | camera decizionala - Senat |").otherwise(" | fără |")
    stage = F.when(n % 5 != 0, F.concat(F.lit(" Stadiu: la comisii "), s, F.lit(" |"))).otherwise("")
    sponsor = F.when(n % 3 == 0, " Iniţiator: Guvern |").when(n % 3 == 1, F.concat(F.lit(" Initiator: deputat "), s, F.lit(" |"))).otherwise("")
    committee = F.when(n % 2 == 0, F.concat(F.lit("; Comisia pentru buget "), s, F.lit("; x"))).otherwise("")
    text = F.concat(way, decides, stage, sponsor, committee)
    origin = F.when(n % 3 == 0, "Adresa SE ").when(n % 3 == 1, "Adresa CD").otherwise("Adresa")
    return t.bills.select("id", cl.origin_chamber(way).alias("origin"), cl.decision_chamber(text).alias("decided_by"), cl.stage_of(text).alias("stage"), cl.sponsor_of(text).alias("sponsor"),
                          cl.source_chamber(origin).alias("source"), cl.committee_of(text).alias("committee"))


@query("f24_url_parameters", "F24 F25", """
    SELECT id, CASE id % 5 WHEN 0 THEN year(held_on) WHEN 1 THEN 1997 END AS year, CASE id % 5 WHEN 1 THEN '5' WHEN 2 THEN CAST(id AS VARCHAR) END AS member,
      CASE id % 5 WHEN 2 THEN 'leg2000:cam2:idm' || id END AS profile, CASE id % 5 WHEN 0 THEN 'bill' WHEN 4 THEN 'vote' END AS kind, CASE id % 5 WHEN 0 THEN 'senate' ELSE 'deputies' END AS chamber FROM votes""")
def _(t):
    n, s = F.col("id"), F.col("id").cast("string")
    address = F.when(n % 5 == 0, F.concat(F.lit("https://www.senat.ro/legis/lista.aspx?nr_cls=L"), s, F.lit("&an_cls="), F.year("held_on").cast("string"))).when(
        n % 5 == 1, F.lit("http://www.cdep.ro/pls/x?AN=1997&IDM=5#top")).when(
        n % 5 == 2, F.concat(F.lit("https://www.cdep.ro/pls/parlam/structura2015.mp?idm="), s, F.lit("&leg=2000"))).when(
        n % 5 == 3, F.lit("https://www.cdep.ro/pls/parlam/structura2015.mp?idm=&cam=1&leg=1996&an_cls=98")).otherwise(
        F.concat(F.lit("https://www.cdep.ro/ords/pls/steno/evot2015.Nominal?idv="), s))
    return t.votes.select("id", address.alias("u")).select(
        "id", ur.year_of(F.col("u")).alias("year"), ur.query_param(F.col("u"), "idm").alias("member"), ur.profile_key(F.col("u")).alias("profile"),
        ur.kind_of(F.col("u")).alias("kind"), ur.chamber_of(F.col("u")).alias("chamber"))
