"""Whole vote pages of both forms, made from the votes and ballots, and the tables read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import votepages as vp
from annalist.plans.registry import query

CHOICES = ("for", "against", "abstention", "present_not_voting")


def _text(*parts):
    """One text of literals and, as Columns, values."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _joined(rows, keys, line, order):
    """The lines of each key in order, as one text."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "").alias("body"))


def _count(choice):
    return F.count_if(F.col("choice") == choice)


def cast_ballots(t, chamber):
    kept = t.votes.where(F.col("chamber") == chamber).select(F.col("id").alias("vote_id"))
    names = t.members.select(F.col("id").alias("member_id"), "first_name", "last_name")
    return t.ballots.join(kept, "vote_id").join(names, "member_id")


def senate_pages(t):
    rows = cast_ballots(t, "senate")
    member, col = F.col("member_id"), F.col
    family = F.when(member % 10 == 0, F.upper("last_name")).otherwise(_text("<a href=\"/fisa.aspx?ParlamentarID=S", member, "\">", F.upper("last_name"), "</a>"))
    marks = F.concat(*[_text("<td>", F.when(col("choice") == c, "X").otherwise(""), "</td>") for c in CHOICES])
    method = F.when(member % 2 == 0, "electronic").otherwise("")
    people = _joined(rows, ["vote_id"], _text("<tr><td>", family, "</td><td>", col("first_name"), "</td><td>", col("group_id"), "</td>", marks, "<td>", method, "</td></tr>"), col("member_id"))
    counted = rows.groupBy("vote_id", "group_id").agg(*[_count(c).alias(c) for c in CHOICES])
    groups = _joined(counted, ["vote_id"], F.concat(_text("<tr><td>", col("group_id"), "</td>"), *[_text("<td>", col(c), "</td>") for c in CHOICES], F.lit("</tr>")), col("group_id"))
    all_counts = rows.groupBy("vote_id").agg(F.count(F.lit(1)).alias("n"), *[_count(c).alias(c) for c in CHOICES])
    code = F.when(col("bill_id").isNotNull(), _text("L", col("bill_id"), "/", F.year("held_on"), "<br>")).otherwise("")
    kind = F.when(col("id") % 4 == 0, "VOT secret").otherwise("Vot final")
    joined = t.votes.select("id", "bill_id", "held_on").join(people.withColumnRenamed("vote_id", "id").withColumnRenamed("body", "people"), "id").join(
        groups.withColumnRenamed("vote_id", "id").withColumnRenamed("body", "groups"), "id").join(all_counts.withColumnRenamed("vote_id", "id"), "id")
    html = _text(
        "<html><body><div class=\"new-page-voturi-plen-detaliu\"><div class=\"section-title\"><h2>", code, F.date_format("held_on", "dd/MM/yyyy"), "<br/>", kind, "</h2></div>",
        "<ul class=\"total-votes\"><li>Prezenți: ", col("n"), "</li><li>Pentru: ", col("for"), "</li><li>Contra: ", col("against"), "</li><li>Abțineri: ", col("abstention"),
        "</li><li>Prezent - Nu au votat: ", col("present_not_voting"), "</li></ul></div><div class=\"plenary-votes\"><h5>Subiect ", col("id"),
        "</h5><table><thead><tr><th>Grup</th><th>P</th></tr></thead><tbody>", col("groups"), "</tbody></table><table><thead><tr><th>Nume</th><th>Prenume</th></tr></thead><tbody>",
        col("people"), "</tbody></table></div><table><tbody><tr><td>Subsol</td></tr></tbody></table></body></html>")
    return joined.select(col("id").alias("page_id"), _text("https://www.senat.ro/VoturiPlenDetaliu.aspx?Cod=", col("id")).alias("url"), html.alias("html"))


def deputies_pages(t):
    rows, col = cast_ballots(t, "deputies"), F.col
    mark = F.when(col("choice") == "for", "DA").when(col("choice") == "against", "NU").when(col("choice") == "abstention", "AB").when(col("choice") == "present_not_voting", "-").otherwise("?")
    line = _text("<tr><td>", col("member_id"), ".</td><td><a href=\"/ords/pls/parlam/structura2015.mp?idm=", col("member_id"), "&cam=2&leg=2024\">", F.upper("first_name"), " ",
                 col("last_name"), "</a></td><td>", col("group_id"), F.when(col("member_id") % 3 == 0, "(afiliat)").otherwise(""), "</td><td>", mark, "</td></tr>")
    people = _joined(rows, ["vote_id"], line, col("member_id"))
    counts = rows.groupBy("vote_id").agg(*[_count(c).alias(c) for c in CHOICES])
    number = _text(F.coalesce("bill_id", F.lit(0)), "/", F.year("held_on"))
    subject = F.when(col("id") % 11 == 0, "").otherwise(_text(
        "<tr><td>Subiect vot:</td><td><b>Vot final - PL-x ", number, "</b><br>Adoptare <a href=\"/ords/pls/proiecte/upl_pck2015.proiect?idp=", col("id"), "\">PL ", number,
        "</a> privind tema ", col("id") % 50, "<br>- lege ordinară</td></tr>"))
    joint = F.when(col("id") % 13 == 0, "<tr><th>Parlamentar</th><th>Camera Deputatilor</th><th>Senat</th></tr>").otherwise("")
    off = F.when(col("id") % 5 == 0, 1).otherwise(0)
    joined = t.votes.select("id", "bill_id", "held_on").join(people.withColumnRenamed("vote_id", "id").withColumnRenamed("body", "people"), "id").join(counts.withColumnRenamed("vote_id", "id"), "id")
    html = _text(
        "<html><head><title>VOT ELECTRONIC</title></head><body><table><tr><td>Data:</td><td>", F.date_format("held_on", "dd.MM.yyyy"), "</td></tr>", subject, joint,
        "<tr><td>- Pentru (DA):</td><td>", col("for") + off, "</td></tr> <tr><td>- Contra (NU):</td><td>", col("against"), "</td></tr> <tr><td>- Abtineri (AB):</td><td>", col("abstention"),
        "</td></tr> <tr><td>- Nu au votat (-):</td><td>", col("present_not_voting"), "</td></tr> </table> <table><tr><td>#</td><td>Nume si prenume</td><td>Grup</td><td>Vot</td></tr>",
        col("people"), "</table></body></html>")
    return joined.select(col("id").alias("page_id"), _text("https://www.cdep.ro/ords/pls/steno/evot2015.Nominal?idv=", col("id")).alias("url"), html.alias("html"))


SLUG = "regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
COUNTS_SQL = ", ".join(f"count(*) FILTER (choice = '{c}') AS {n}" for n, c in vp.CHOICES.items())
SENATE_SQL = f"""WITH b AS (SELECT x.*, m.first_name, m.last_name FROM ballots x JOIN votes v ON v.id = x.vote_id AND v.chamber = 'senate' JOIN members m ON m.id = x.member_id),
    named AS (SELECT v.id AS page_id, v.held_on, CASE WHEN bill_id IS NOT NULL THEN 'L' || bill_id || '/' || year(held_on) END AS code,
        CASE WHEN v.id % 4 = 0 THEN 'VOT secret' ELSE 'Vot final' END AS vote_type, 'Subiect ' || v.id AS named FROM votes v WHERE chamber = 'senate' AND id IN (SELECT vote_id FROM b)),
    ids AS (SELECT *, 'vote-senate-' || {SLUG.format(x="coalesce(code, named) || '-' || strftime(held_on, '%m-%d') || '-' || CASE vote_type WHEN 'VOT secret' THEN 'secret' ELSE 'final' END")} AS vote_id FROM named),
    people AS (SELECT b.vote_id AS page_id, ids.vote_id, member_id AS n, CASE WHEN member_id % 10 = 0 THEN 'member-' || {SLUG.format(x="first_name || ' ' || last_name")} ELSE 'member-senate-S' || member_id END AS member_id,
        first_name, last_name, first_name || ' ' || last_name AS display_name, CASE WHEN member_id % 10 <> 0 THEN 'S' || member_id END AS source_key,
        'group-senate-' || {SLUG.format(x='group_id')} AS group_id, group_id AS name, choice FROM b JOIN ids ON ids.page_id = b.vote_id)"""


@query("x19_senate_votes", "X19", SENATE_SQL + f"""
    SELECT ids.page_id, ids.vote_id, 'bill-' || {SLUG.format(x='code')} AS bill_id, CASE WHEN code IS NOT NULL THEN code || ' — ' || vote_type ELSE named END AS title, held_on, vote_type,
      c.* EXCLUDE (page_id) FROM ids JOIN (SELECT vote_id AS page_id, count(*) AS present, {COUNTS_SQL} FROM b GROUP BY 1) c ON c.page_id = ids.page_id""")
def _(t):
    return vp.senate_votes(senate_pages(t)).votes


@query("x19_senate_members", "X19", SENATE_SQL + f"""
    SELECT DISTINCT page_id, member_id, {SLUG.format(x='display_name')} AS slug, first_name, last_name, display_name, source_key FROM people""")
def _(t):
    return vp.senate_votes(senate_pages(t)).members


@query("x19_senate_totals", "X19", SENATE_SQL + f"""
    SELECT page_id, vote_id, 'gvt-' || vote_id || '-' || group_id AS id, group_id, {COUNTS_SQL} FROM people GROUP BY ALL""")
def _(t):
    return vp.senate_votes(senate_pages(t)).totals


@query("x19_senate_ballots", "X19", SENATE_SQL + """
    SELECT page_id, vote_id, 'iv-' || vote_id || '-' || member_id AS id, member_id, group_id, CASE choice WHEN 'absent' THEN 'unknown' ELSE choice END AS choice,
      CASE WHEN n % 2 = 0 THEN 'electronic' END AS method FROM people""")
def _(t):
    return vp.senate_votes(senate_pages(t)).ballots


@query("x19_senate_groups", "X19", SENATE_SQL + """
    SELECT DISTINCT page_id, group_id, name AS short_name, name, '#64748b' AS color FROM people""")
def _(t):
    return vp.senate_votes(senate_pages(t)).groups


DEPUTIES_SQL = f"""WITH b AS (SELECT x.*, m.first_name, m.last_name, upper(m.first_name) || ' ' || m.last_name AS raw FROM ballots x JOIN votes v ON v.id = x.vote_id AND v.chamber = 'deputies' JOIN members m ON m.id = x.member_id),
    ids AS (SELECT v.id AS page_id, v.held_on, 'vote-deputies-https-www-cdep-ro-ords-pls-steno-evot2015-nominal-idv-' || v.id AS vote_id, coalesce(bill_id, 0) || '/' || year(held_on) AS number,
        v.id % 11 <> 0 AS told, v.id % 13 = 0 AS joint, v.id % 5 = 0 AS off FROM votes v WHERE chamber = 'deputies' AND id IN (SELECT vote_id FROM b)),
    people AS (SELECT b.vote_id AS page_id, ids.vote_id, 'member-deputies-' || member_id AS member_id, CAST(member_id AS VARCHAR) AS source_key, array_to_string(list_transform(string_split(lower(raw), ' '),
        lambda w: upper(w[1]) || w[2:]), ' ') AS display_name, 'group-deputies-' || {SLUG.format(x='group_id')} AS group_id, choice
      FROM b JOIN ids ON ids.page_id = b.vote_id WHERE NOT joint AND choice IN ('for', 'against', 'abstention', 'present_not_voting'))"""


@query("x19_deputies_votes", "X19", DEPUTIES_SQL + f""",
      c AS (SELECT ids.*, coalesce(n.present, 0) AS present, {', '.join(f'coalesce(n.{c}, 0) AS {c}' for c in vp.CHOICES)} FROM ids
        LEFT JOIN (SELECT page_id, count(*) AS present, {COUNTS_SQL} FROM people GROUP BY 1) n ON n.page_id = ids.page_id),
      w AS (SELECT *, list_filter([CASE WHEN joint THEN 'joint sitting' END, CASE WHEN present = 0 THEN 'no ballots' END, CASE WHEN NOT told THEN 'no subject' END,
        CASE WHEN present > 0 AND off THEN 'counts differ' END], lambda x: x IS NOT NULL) AS warnings FROM c)
    SELECT page_id, vote_id, CASE WHEN told THEN 'bill-pl-x-' || replace(number, '/', '-') END AS bill_id, CASE WHEN told THEN 'Vot final - PL-x ' || number || ' - Adoptare' ELSE 'VOT ELECTRONIC' END AS title,
      held_on, present, for_count, against, abstention, present_not_voting, CASE WHEN present = 0 THEN 'failed' WHEN len(warnings) > 0 THEN 'partial' ELSE 'parsed' END AS status,
      array_to_string(warnings, ', ') AS warnings FROM w""")
def _(t):
    return vp.deputies_votes(deputies_pages(t)).votes.withColumn("warnings", F.array_join("warnings", ", "))


@query("x19_deputies_members", "X19", DEPUTIES_SQL + f"""
    SELECT DISTINCT page_id, member_id, {SLUG.format(x='display_name')} AS slug, regexp_replace(display_name, ' [^ ]*$', '') AS first_name,
      regexp_extract(display_name, '[^ ]*$') AS last_name, display_name, source_key FROM people""")
def _(t):
    return vp.deputies_votes(deputies_pages(t)).members


@query("x19_deputies_ballots", "X19", DEPUTIES_SQL + """
    SELECT page_id, vote_id, 'iv-' || vote_id || '-' || member_id AS id, member_id, group_id, choice FROM people""")
def _(t):
    return vp.deputies_votes(deputies_pages(t)).ballots


@query("x19_deputies_bills", "X19", DEPUTIES_SQL + """
    SELECT page_id, 'bill-pl-x-' || replace(number, '/', '-') AS bill_id, 'privind tema ' || page_id % 50 AS title, '{"deputies":"PL-x ' || number || '"}' AS identifiers FROM ids WHERE told""")
def _(t):
    return vp.deputies_votes(deputies_pages(t)).bills.withColumn("identifiers", F.to_json("identifiers"))
