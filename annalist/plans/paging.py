"""Queries over pages: the given ones, and vote pages made from the ballots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.operators import pages as pg
from annalist.operators import rosters as ro
from annalist.plans.registry import query


def vote_pages(t):
    """One page per vote: a table of its ballots, a group cell spanning the
    rows of its members; and a table of dated steps."""
    mark = F.when(F.col("choice") == "for", "DA").when(F.col("choice") == "against", "NU").when(F.col("choice") == "abstention", "AB").when(
        F.col("choice") == "present_not_voting", "-").otherwise("?")
    rows = t.ballots.withColumn("tail", F.concat(F.lit("<td>"), F.col("member_id").cast("string"), F.lit("</td><td>"), mark, F.lit("</td></tr>")))
    grouped = rows.groupBy("vote_id", "group_id").agg(F.array_sort(F.collect_list("tail")).alias("tails")).select(
        "vote_id", F.concat(F.lit("<tr><td rowspan=\""), F.size("tails").cast("string"), F.lit("\">"), F.col("group_id"), F.lit("</td>"),
                            F.array_join("tails", "<tr>")).alias("part"))
    body = grouped.groupBy("vote_id").agg(F.array_join(F.array_sort(F.collect_list("part")), "").alias("body"))
    ident = F.concat(F.lit("PL-x "), F.coalesce("bill_id", F.lit(0)).cast("string"), F.lit("/"), F.year("held_on").cast("string"))
    steps = F.concat(F.lit("<table><tr><th>Nr</th><th>Data</th><th>Etapa</th></tr><tr><td><a href=\"/bill?idp="), F.col("id").cast("string"), F.lit("\">"), ident,
                     F.lit("</a></td><td>"), F.date_format("held_on", "dd.MM.yyyy"), F.lit("</td><td><a href=\"/doc/raport-"), F.col("id").cast("string"),
                     F.lit(".pdf\">Raport de la Senat</a></td></tr></table>"))
    return t.votes.join(body, F.col("id") == F.col("vote_id")).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://www.chamber.example/vot?idv="), F.col("id").cast("string")).alias("url"),
        F.concat(F.lit("<html><body><table><tr><th>Grup</th><th>Membru</th><th>Vot</th></tr>"), "body", F.lit("</table>"), steps, F.lit("</body></html>")).alias("html"))


@query("x14_page_links", "X14", """
    SELECT page_id, CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || h ELSE h END AS href
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS h FROM pages)""")
def _(t):
    return pg.links(t.pages).select("page_id", "href")


@query("x14_discovered_links", "X14 F22 F25 W2")
def _(t):
    return pg.discover(t.pages)


CAST_ROWS = """SELECT vote_id AS page_id, member_id, group_id, CASE choice WHEN 'absent' THEN 'unknown' ELSE choice END AS choice FROM ballots"""


def ballots_from_pages(t):
    rows = pg.records(pg.cells(vote_pages(t)), {"grp": "^grup", "member": "^membru", "choice": "^vot"})
    return pg.nominal_votes(rows)


@query("x16_table_cells", "X16", """
    SELECT vote_id AS page_id, count(*) * 3 AS cells, count(DISTINCT group_id) AS groups FROM ballots GROUP BY 1""")
def _(t):
    c = pg.cells(vote_pages(t)).where("tab = 0 AND NOT header")
    return c.groupBy("page_id").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct(F.when(F.col("col") == 0, F.col("text"))).alias("groups"))


@query("x19_ballots_from_pages", "X17 X19 F32", CAST_ROWS)
def _(t):
    return ballots_from_pages(t).select("page_id", "member_id", "group_id", "choice")


@query("x18_timeline_from_pages", "X18 F11 F30", """
    SELECT id AS page_id, held_on AS occurred_on, 'Raport de la Senat' AS label, 'committee_report_received' AS step_type, 'senate' AS chamber,
      'https://www.chamber.example/doc/raport-' || id || '.pdf' AS href FROM votes WHERE id IN (SELECT vote_id FROM ballots)""")
def _(t):
    rows = pg.records(pg.cells(vote_pages(t)), {"on": "^data", "label": "^etapa"})
    return pg.timeline(rows).drop("line")


@query("x15_listing_rows", "X15 F18 F26", """
    SELECT id AS page_id, 'PL-x ' || coalesce(bill_id, 0) || '/' || year(held_on) AS official_id, 1 AS expected FROM votes WHERE id IN (SELECT vote_id FROM ballots)""")
def _(t):
    rows = pg.records(pg.cells(vote_pages(t)), {"number": "^nr$", "title": "^etapa"})
    return pg.listing(rows).select("page_id", "official_id", "expected")


@query("x23_bill_documents", "X23 F29", """
    SELECT id AS page_id, 'https://www.chamber.example/doc/raport-' || id || '.pdf' AS href, 'Raport de la Senat' AS label, 'committee_report' AS kind,
      sha256('https://www.chamber.example/doc/raport-' || id || '.pdf') AS url_hash FROM votes WHERE id IN (SELECT vote_id FROM ballots)""")
def _(t):
    return pg.bill_documents(pg.links(vote_pages(t)))


def registry_pages(t):
    """Listing pages of fifty parts, a paragraph with a file link per part; the
    short name is quoted, at the paragraph's end, bare, or only announced."""
    name = F.concat(F.lit("Partidul "), F.col("p_name"), F.lit(" "), F.col("p_type"))
    short, form = F.substr("p_type", F.lit(1), F.lit(3)), F.col("p_partkey") % 4
    head = F.concat(F.lit("<p><a href=\"/registru/"), F.col("p_partkey").cast("string"), F.lit(".pdf\">"), F.col("p_partkey").cast("string"), F.lit(". "))
    line = F.when(form == 0, F.concat(head, F.lit("05.03.1998 – "), name, F.lit(", cu denumirea prescurtată „"), short, F.lit("”</a></p>"))).when(
        form == 1, F.concat(head, name, F.lit("</a> – "), short, F.lit("</p>"))).when(
        form == 2, F.concat(head, name, F.lit("</a> cu denumirea prescurtată: "), short, F.lit(", cu sediul</p>"))).otherwise(
        F.concat(head, name, F.lit(" – cu denumirea de bloc</a></p>")))
    return t.part.withColumn("line", line).groupBy(F.floor(F.col("p_partkey") / 50).alias("page_id")).agg(F.array_join(F.collect_list("line"), "").alias("html")).select(
        "page_id", F.lit("https://www.registru.example/index").alias("url"), "html")


@query("x21_registry_records", "X21 F36", """
    SELECT 'https://www.registru.example/registru/' || p_partkey || '.pdf' AS href, p_partkey AS position,
      'Partidul ' || p_name || ' ' || p_type || CASE WHEN p_partkey % 4 = 0 THEN ', cu denumirea prescurtată „' || substr(p_type, 1, 3) || '”' ELSE '' END AS legal_name,
      CASE WHEN p_partkey % 4 < 3 THEN substr(p_type, 1, 3) END AS short_name, CASE WHEN p_partkey % 4 = 0 THEN '1998-03-05' END AS listed_date FROM part""")
def _(t):
    return pg.registry(pg.blocks(registry_pages(t)), "/registru/").drop("page_id")


def article_pages(t):
    """An article per part: a fact box and paragraphs; each fifth says nothing."""
    n, name = F.col("p_partkey").cast("string"), F.col("p_name")
    told = F.col("p_partkey") % 5 != 0
    box = F.when(told, F.concat(F.lit("<table class=\"infobox vcard\"><tr><th>Președinte</th><td>"), name, F.lit("</td></tr><tr><th>Fondat</th><td>5 martie 1990</td></tr><tr><th>Dizolvată</th><td>în "),
                                (F.col("p_size") % 30 + 1991).cast("string"), F.lit("</td></tr></table>"))).otherwise("")
    sentence = F.when(told, F.concat(F.lit("Partidul x"), n, F.lit(" a fuzionat la 03.04.1999. Alianța a durat. A fuzionat cu altul. A fuzionat cu altul."))).otherwise("")
    html = F.concat(F.lit("<html><body>"), box, F.lit("<p>Un text despre "), name, F.lit(".</p><p>"), sentence, F.lit("</p></body></html>"))
    return t.part.select(F.col("p_partkey").alias("page_id"), F.lit("https://www.enciclopedie.example/articol").alias("url"), html.alias("html"))


@query("x22_article_candidates", "X22 F12 F33 F34", """
    WITH told AS (SELECT p_partkey AS page_id, p_size % 30 + 1991 AS y FROM part WHERE p_partkey % 5 <> 0)
    SELECT page_id, 1 AS n, 'infobox' AS kind, 'party_founded' AS hint, 'Fondat 5 martie 1990' AS text, '1990-03-05' AS dates, 'medium' AS confidence FROM told
    UNION ALL SELECT page_id, 2, 'infobox', 'party_or_alliance_dissolved', 'Dizolvată în ' || y, CAST(y AS VARCHAR), 'medium' FROM told
    UNION ALL SELECT page_id, 4, 'paragraph', 'party_merged', 'Partidul x' || page_id || ' a fuzionat la 03.04.1999.', '1999-04-03', 'medium' FROM told
    UNION ALL SELECT page_id, 5, 'paragraph', 'alliance_context', 'Alianța a durat.', '', 'low' FROM told
    UNION ALL SELECT page_id, 6, 'paragraph', 'party_merged', 'A fuzionat cu altul.', '', 'low' FROM told
    UNION ALL SELECT p_partkey, 0, 'no_candidate', 'no_candidate', NULL, '', 'none' FROM part WHERE p_partkey % 5 = 0""")
def _(t):
    return pg.article_candidates(article_pages(t)).withColumn("dates", F.array_join("dates", ","))


def group_label(c):
    """A label without digits: its first number is the number of members."""
    return F.concat(F.lit("Grupul parlamentar "), F.translate(c, "0123456789", "abcdefghij"))


def numbered_members(t):
    n = F.row_number().over(Window.partitionBy("group_id").orderBy("id"))
    return t.members.select("id", "display_name", "group_id", n.alias("n"))


def roster_pages(t):
    """An index page per five groups, and a page per group with its members."""
    number = F.regexp_extract("group_id", r"(\d+)", 1)
    address = F.concat(F.lit("https://www.cdep.ro/ords/pls/parlam/structura2015.gp?idg="), number)
    size = t.members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    off = F.when(number.cast("int") % 4 == 0, 1).otherwise(0)
    link = F.concat(F.lit("<a href=\""), address, F.lit("\" aria-label=\""), group_label(F.col("group_id")), F.lit(" - "), (F.col("size") + off).cast("string"), F.lit(" membri\"><h3>x</h3></a>"))
    indexes = size.withColumn("link", link).groupBy(F.floor(number.cast("int") / 5).alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list("link")), "").alias("html")).select(
        "page_id", F.lit("https://www.cdep.ro/ords/pls/parlam/structura2015.ab").alias("url"), "html")
    profile = F.concat(F.lit("<a href=\"structura2015.mp?idm="), F.col("id").cast("string"), F.lit("&cam=2\">"), F.col("display_name"), F.lit("</a>"))
    shown = F.when(F.col("id") % 9 == 0, profile).otherwise(F.concat(F.lit("<b>"), profile, F.lit("</b>")))
    role = F.when(F.col("n") == 2, "Vicelider").otherwise("")
    since = F.when(F.col("id") % 3 == 0, "din 5 martie 1998").otherwise("")
    row = F.concat(F.when(F.col("n") == 1, "<tr><td>Lider:</td></tr>").otherwise(""), F.lit("<tr><td>"), F.col("n").cast("string"), F.lit(".</td><td>"), role, F.lit("</td><td>"), shown,
                   F.lit("</td><td>"), since, F.lit("</td></tr>"))
    lines = numbered_members(t).withColumn("row", row).groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda x: x["row"]), "").alias("rows"))
    pages = lines.select(number.cast("long").alias("page_id"), address.alias("url"), F.concat(F.lit("<html><body><table><tr><th>Nr</th></tr>"), "rows", F.lit("</table></body></html>")).alias("html"))
    return indexes, pages


ROSTER_SQL = """WITH m AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY id) AS n, regexp_extract(group_id, '[0-9]+') AS idg FROM members),
    a AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n) AS nth FROM m WHERE id % 9 <> 0),
    f AS (SELECT group_id, bool_or(n = 1) AS has_one, bool_or(n = 2) AS has_two FROM a GROUP BY 1)"""


@query("x24_roster_groups", "X24", ROSTER_SQL + """
    SELECT 'https://www.cdep.ro/ords/pls/parlam/structura2015.gp?idg=' || idg AS url, 'group-deputies-1996-2000-' || idg AS group_id, 'Grupul parlamentar ' || translate(group_id, '0123456789', 'abcdefghij') AS name, translate(group_id, '0123456789', 'abcdefghij') AS short_name,
      NULL AS party, count(*) + CASE WHEN CAST(idg AS INT) % 4 = 0 THEN 1 ELSE 0 END AS expected FROM m GROUP BY group_id, idg""")
def _(t):
    return pg.roster_groups(roster_pages(t)[0], "1996-2000")


@query("x24_group_members", "X24 W16", ROSTER_SQL + """
    SELECT CAST(idg AS BIGINT) AS page_id, 'group-deputies-1996-2000-' || idg AS group_id, CAST(id AS VARCHAR) AS official_id, display_name, CASE WHEN id % 3 = 0 THEN DATE '1998-03-05' ELSE DATE '1996-11-27' END AS starts_on,
      CASE WHEN n = 2 THEN 'Vicelider grup parlamentar' WHEN nth = 1 AND n = 1 THEN 'Lider grup parlamentar' WHEN nth = 1 AND n > 2 THEN 'Vicelider grup parlamentar'
        WHEN nth = 2 AND has_one AND NOT has_two THEN 'Vicelider grup parlamentar' END AS role FROM a JOIN f USING (group_id)""")
def _(t):
    indexes, pages = roster_pages(t)
    return pg.group_members(pages, pg.roster_groups(indexes, "1996-2000"), "1996-11-27")


@query("g37_group_counts", "G37 X24", ROSTER_SQL + """
    SELECT 'group-deputies-1996-2000-' || idg AS group_id, count(*) + CASE WHEN CAST(idg AS INT) % 4 = 0 THEN 1 ELSE 0 END AS expected, count(*) FILTER (id % 9 <> 0) AS parsed,
      count(*) + CASE WHEN CAST(idg AS INT) % 4 = 0 THEN 1 ELSE 0 END = count(*) FILTER (id % 9 <> 0) AS agrees FROM m GROUP BY idg""")
def _(t):
    indexes, pages = roster_pages(t)
    groups = pg.roster_groups(indexes, "1996-2000")
    return ro.group_counts(pg.group_members(pages, groups, "1996-11-27"), groups.select("group_id", "expected"))


@query("j31_steps_with_document", "J31", """
    SELECT id AS page_id, 1 AS tab, 1 AS line, sha256('https://www.chamber.example/doc/raport-' || id || '.pdf') AS url_hash, 'committee_report' AS kind FROM votes WHERE id IN (SELECT vote_id FROM ballots)""")
def _(t):
    return pg.step_documents(vote_pages(t))


@query("x22_history_candidates", "X22 F12 F33 F34")
def _(t):
    # paragraphs of the documents, one block each
    lines = t.docs.select(F.col("id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    events = t.formation_events.select(F.col("id").alias("page_id"), F.lit(0).alias("position"), F.concat_ws(
        " ", F.lit("Partidul a fost fondat la"), F.date_format("occurred_on", "dd.MM.yyyy"), F.lit("si a fuzionat."), "title").alias("text"))
    return pg.history_candidates(lines.unionByName(events))
