"""Work done once: texts bound before they are used, pages read once."""

import datetime as dt
import random
import tracemalloc
from urllib.parse import urljoin

from pyspark.sql import functions as F

from annalist.functions import classify as cl
from annalist.functions import dates as fd
from annalist.functions import text as tx
from annalist.operators import documents as dx
from annalist.operators import pages as pg
from annalist.operators import parties
from annalist.operators import resolve as rs
from annalist.operators import timeline as tl
from annalist.operators import votepages as vp
from annalist.operators.asof import latest_on
from annalist.plans import intervals

BITS = ("<table class=\"infobox\">", "</table>", "<tr>", "</tr>", "<td rowspan=\"2\">", "<td colspan=\"2\">", "<td>", "</td>", "<th>", "a  b", "&amp;", "<b>", "</b>",
        "<a href=\"/x?a=1&b=2\" aria-label=\"L &amp; q\">", "<a href=\"/q&copy\">", "</a>", "<p>", "</p>", "<br>", "<br/>", "<div class=\"k\">", "</div>", "<title>", "</title>",
        "<script>", "</script>", "<!-- c -->", "<", "<td rowspan=2>", "<TD CLASS=\"q\">", "Ș")


def planned(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()


def test_period_folds_its_text_once(spark):
    assert planned(spark, fd.period_end(F.col("t")), "x").count("translate(") == 1
    row = spark.createDataFrame([("din mai 1999 până în sept. 2000",), ("din x 1999",), (None,)], "t string").select(
        fd.period_start(F.col("t")).cast("string"), fd.period_end(F.col("t")).cast("string")).collect()
    assert [tuple(r) for r in row] == [("1999-05-01", "2000-08-31"), (None, None), (None, None)]


def test_first_date_reads_its_text_once(spark):
    # what the text is made from must not be made again for each part of the date
    made = F.concat(F.lit("la "), F.reverse("t"))
    assert planned(spark, fd.parse_date(made), "x").count("reverse(") == 1
    rows = spark.createDataFrame([("3.2.1999",), ("31.2.1999 la 5 mai 2001",), ("5 Mai  2001",), ("5 luna 2001",), ("",), (None,)], "t string")
    assert [str(r[0]) for r in rows.select(fd.parse_date(F.col("t"))).collect()] == ["1999-02-03", "2001-05-05", "2001-05-05", "None", "None", "None"]


def test_legal_text_is_cleaned_once(spark):
    assert planned(spark, cl.legal_metadata(F.reverse("t")), "x").count("reverse(") == 1


def test_plain_pages_are_read_as_the_library_reads_them():
    draw, plain = random.Random(3), 0
    for _ in range(4000):
        html = "<table><tr>" + "".join(draw.choice(BITS) for _ in range(draw.randint(0, 12))) + "</tr></table>"
        quick, slow = pg.PageReader("http://b/c"), pg.PageReader("http://b/c")
        try:
            slow.feed(html), slow.close(), slow._close_block()
        except IndexError:
            continue
        if pg.feed_plain(quick, html):
            quick._close_block()
            plain += 1
            assert all(read([quick]).equals(read([slow])) for read in pg._READ.values()), html
    assert plain > 400


def test_pages_of_steps_and_listings_are_read_once(spark):
    html = "<table><tr><th>Nr</th><th>Etapa</th></tr><tr><td>PL-x 6/1999</td><td><a href=\"/doc/r.pdf\">Raport</a></td></tr></table>"
    pages = spark.createDataFrame([(1, "http://a/b", html), (2, "http://a/c", None)], "page_id long, url string, html string")
    steps = pg.step_documents(pages)
    assert "MapIn" not in steps._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.page_id, r.tab, r.line, r.kind) for r in steps.collect()] == [(1, 0, 1, "committee_report")]
    listed = pg.listing(pg.records(pg.cells(pages), {"number": "^nr$", "title": "^etapa"}))
    assert "MapIn" not in listed._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.official_id, r.title, r.expected) for r in listed.collect()] == [("PL-x 6/1999", "Raport", 1)]


def test_touching_rows_are_merged_in_two_shuffles(spark):
    draw, items = random.Random(5), []
    for member in range(20):
        day = dt.date(2000, 1, 1)
        for n in range(15):
            end = day + dt.timedelta(days=draw.choice((2, 9, 30, 45)))
            items.append((f"{member}-{n}", f"m{member}", draw.choice("AAAB"), day, None if draw.random() < 0.05 else end))
            day = end + dt.timedelta(days=draw.choice((0, 1, 1, 1, 3)))
    want, before = [], None
    for ident, member, label, start, end in sorted(items, key=lambda r: (r[1], r[3], r[2], r[0])):
        touches = before and before[:2] == (member, label) and before[2] and (start - before[2]).days in (0, 1)
        want = [*want[:-1], (*want[-1][:4], end, want[-1][5] + 1)] if touches else [*want, (member, label, ident, start, end, 1)]
        before = (member, label, end)
    got = tl.merge_touching(spark.createDataFrame(items, "id string, member_id string, label string, starts_on date, ends_on date"), "member_id", ["label"], "id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 2 and "FileScan" not in plan


def test_plain_rows_are_rows_without_their_parts():
    html = "<table><tr><td rowspan=\"2\">a</td><td><b>x</b> <a href=\"/q\">y</a> z</td></tr><tr></tr><tr><th>h</th></tr></table>"
    read = lambda part: pg._READ[part]([pg.read_page("http://b/c", html, (part,))]).to_pylist()[0]
    kept = ("text", "href", "header")
    assert read("plain_rows") == [{**r, "cells": [{k: c[k] for k in kept} for c in r["cells"]]} for r in read("rows")]


def test_filters_on_vote_pages_do_not_make_their_columns_again(spark):
    pages = spark.createDataFrame([(1, "http://a/b", None)], "page_id long, url string, html string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    deputies, senate = vp.deputies_votes(pages), vp.senate_votes(pages)
    assert plan(deputies.bills).count("Subiect") == 1
    # one for the short name of either table, one for its key, and one for the colours
    assert plan(senate.groups).count("neafilia") == 2 and plan(senate.groups).count("udmr") == 1
    assert deputies.bills.collect() == [] and senate.groups.collect() == []


def test_word_diff_keeps_bits_not_numbers():
    draw = random.Random(7)
    left, right = ([str(draw.randint(0, 50)) for _ in range(6000)] for _ in range(2))
    tracemalloc.start()
    runs = dx.word_runs(" ".join(left), " ".join(right))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_500_000
    assert [w for k, v in runs if k != "added" for w in v.split()] == left and [w for k, v in runs if k != "removed" for w in v.split()] == right
    assert dx.word_runs("", "") == [] and dx.word_runs("", "x y") == [("added", "x y")] and dx.word_runs("x x", "x") == [("same", "x"), ("removed", "x")]


def test_equal_names_are_scored_once_and_ids_with_several_names_settled(spark):
    registry = spark.sql("SELECT * FROM VALUES (1, 'Partidul red rod', 'rr'), (2, 'Partidul red rod', 'rr'), (2, 'Partidul red rod', 'rr'), (3, 'x', 'blue rod'), (3, 'green oak elm', null), (4, null, null) AS t(id, legal_name, short_name)")
    candidates = spark.sql("SELECT * FROM VALUES (7, array('red rod', 'Uniunea rr')), (8, array('blue rod')), (9, array('green oak ash')) AS t(id, names)")
    scored = rs.score_names(registry, candidates)
    want = [(1, 7, 84, "exact_boilerplate_stripped"), (2, 7, 84, "exact_boilerplate_stripped"), (3, 8, 100, "exact_short_name"), (3, 9, 53, "token_overlap")]
    assert sorted(map(tuple, scored.collect())) == want
    assert sorted(map(tuple, rs.score_names(registry, candidates, most=1).collect())) == want[:3]
    decided = lambda rows: sorted(map(tuple, rs.decide(registry.distinct(), rows, 1).collect()), key=repr)
    assert decided(scored) == decided(rs.score_names(registry, candidates, most=1))


def test_spans_of_a_row_are_made_distinct_where_they_are_made(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 'P', DATE '1999-01-01', DATE '1999-12-31'), ('a', 'Q', DATE '1999-01-01', DATE '1999-12-31'), (null, 'Q', DATE '1999-02-01', null) AS t(id, party_id, starts_on, ends_on)")
    governments = spark.sql("SELECT * FROM VALUES (1, DATE '1999-01-01', DATE '1999-06-30') AS t(id, starts_on, ends_on)")
    aligned = spark.sql("SELECT * FROM VALUES (1, 'R', 'support', 'x', DATE '1999-01-01', CAST(null AS DATE)) AS t(government_id, party_id, alignment, basis, starts_on, ends_on)")
    got = tl.governance_contexts(rows, governments, aligned, "id", "party_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(row_id") == 1 and "REPARTITION_BY_NUM" in plan
    assert sorted([(r.row_id, r.alignment, str(r.starts_on), str(r.ends_on)) for r in got.collect()], key=repr) == [
        ("a", "opposition", "1999-01-01", "1999-06-30"), (None, "opposition", "1999-02-01", "1999-06-30")]


def test_rosters_are_looked_up_once_a_day(spark, monkeypatch):
    day, other = dt.date(2000, 5, 5), dt.date(2000, 5, 6)
    held = [(n, "s", day) for n in range(40)] + [(1, "d", day), (2, "s", other), (3, "s", day), (50, "s", None), (51, None, day), (None, "s", day)]
    seated = [(m, "sd"[m % 2], day, None if m % 3 else day, "L") for m in range(9)] + [(4, "d", day, None, "L"), (None, "s", day, None, "L")]
    cast = [(0, m, f"G{m}", "for") for m in range(9)] + [(1, 4, None, "for"), (2, 0, None, None), (2, 2, "G", "for"), (2, 2, "G", "against"), (3, None, "G", "for"), (50, 77, "G", "for"), (99, 1, "G", "for")]
    votes = spark.createDataFrame(held, "id long, chamber string, held_on date")
    ballots = spark.createDataFrame(cast, "vote_id long, member_id long, group_id string, choice string")
    mandates = spark.createDataFrame(seated, "member_id long, chamber string, starts_on date, ends_on date, legislature_id string")
    windows = spark.createDataFrame([("L", dt.date(2001, 1, 1))], "id string, ends_on date")
    member_of = spark.createDataFrame([(m, m, f"G{m % 4}", day, day if m == 4 else None) for m in range(0, 9, 2)], "member_id long, id long, group_id string, starts_on date, ends_on date")
    looked_up = []
    monkeypatch.setattr(parties, "latest_on", lambda facts, *rest: looked_up.append(facts.count()) or latest_on(facts, *rest))

    active = {(v, m, d) for v, c, d in held if v is not None and c and d for m, k, s, e, _ in seated if c == k and s <= d <= (e or dt.date(2001, 1, 1))}
    group = lambda m, d: f"G{m % 4}" if m is not None and m in range(0, 9, 2) and d and not (m == 4 and d > day) else None
    want = []
    for copy in [v for v in held if v[0] is not None]:
        voters = {m for v, m, _, _ in cast if v == copy[0] and m is not None}
        want += [(v, m, group(m, d), "absent", False) for v, m, d in active if v == copy[0] and m not in voters]
        for v, m, g, choice in cast:
            if v == copy[0]:
                dates = [d for a, b, d in active if m is not None and (a, b) == (v, m)] or [copy[2]]
                want += [(v, m, g or group(m, d), choice or "absent", True) for d in dates]
    rows = lambda count=None: [tuple(r) for r in parties.seat_rows(votes, ballots, mandates, windows, member_of, count).collect()]
    assert sorted(rows(), key=repr) == sorted(want, key=repr)
    assert sum(looked_up) < 60
    for count in (3, 6):
        kept = []
        for vote in {r[0] for r in want}:
            voted = [r for r in want if r[0] == vote and r[4]]
            absent = sorted([r for r in want if r[0] == vote and not r[4]], key=lambda r: (r[2] or "", "" if r[1] is None else str(r[1])))
            kept += voted + (absent if len(voted) > count else absent[:count - len(voted)])
        assert sorted(rows(count), key=repr) == sorted(kept, key=repr)


def test_mergers_are_applied_in_one_shuffle(spark, monkeypatch):
    draw, days = random.Random(3), [dt.date(2000, 1, 1) + dt.timedelta(days=n) for n in range(40)]
    items = [(f"{n:03d}", draw.choice(("m", "n", None)), draw.choice("ABC"), "c", draw.choice(("L", "L", "L", None)), "party", draw.choice(days + [None]), draw.choice(days + [None]))
             for n in range(150)]
    mergers = [(days[9], "A", "B"), (days[15], "B", "C"), (days[22], "C", "A"), (days[30], "A", "A")]
    df = spark.createDataFrame(items, "id string, member_id string, label string, chamber string, legislature_id string, type string, starts_on date, ends_on date")
    far, current = dt.date(9999, 12, 31), [list(r) for r in items]
    for on, gone, into in mergers:
        old = [tuple(r) for r in current]
        for r, o in zip(current, old):
            s, e = o[6], o[7] or far
            reaches = s is not None and s < on <= e
            hit = reaches and any(g[2] == gone and None not in (o[1], o[4]) and (g[1], g[4]) == (o[1], o[4]) and (g[6] is None or g[6] <= e) and (g[7] or far) >= s for g in old)
            if r[2] == gone and reaches:
                r[7] = on - dt.timedelta(days=1)
            if r[2] == into and hit:
                r[6] = on
    want = {(r[1], r[2], r[4], r[6], r[7]) for r in current if r[7] is None or (r[6] is not None and r[6] <= r[7])}
    written = []
    monkeypatch.setattr(tl, "cut_lineage", lambda one: written.append(1) or one)
    got = tl.rewrite_mergers(df, "member_id", "label", mergers, "id")
    assert sorted([(r.member_id, r.label, r.legislature_id, r.starts_on, r.ends_on) for r in got.collect()], key=repr) == sorted(want, key=repr)
    assert not written
    monkeypatch.setattr(tl, "MERGERS_A_PLAN", 3)
    assert sorted(map(repr, tl.rewrite_mergers(df, "member_id", "label", mergers, "id").collect())) == sorted(map(repr, got.collect()))
    assert len(written) == 1


def test_rosters_are_kept_as_stretches_not_days(spark, monkeypatch):
    draw, first = random.Random(11), dt.date(2000, 1, 1)
    on = lambda n: first + dt.timedelta(days=n)
    span = lambda most: (lambda s: (on(s), draw.choice((None, on(s + draw.randrange(most))))))(draw.randrange(200))
    held = [(n, draw.choice("sd"), on(draw.randrange(240))) for n in range(150)]
    seated = [(m, draw.choice("sd"), *span(200), draw.choice("LLW")) for m in range(30) for _ in range(3)]
    moved = [(m, n, draw.choice(("A", "B", "C", None)), *span(90)) for n, m in enumerate(m for m in range(0, 30, 2) for _ in range(4))]
    cast = [(v, m, None, "for") for v in range(0, 150, 3) for m in draw.sample(range(30), draw.randrange(1, 7))]
    votes = spark.createDataFrame(held, "id long, chamber string, held_on date")
    mandates = spark.createDataFrame(seated, "member_id long, chamber string, starts_on date, ends_on date, legislature_id string")
    windows = spark.createDataFrame([("L", on(230))], "id string, ends_on date")
    member_of = spark.createDataFrame(moved, "member_id long, id long, group_id string, starts_on date, ends_on date")
    ballots = spark.createDataFrame(cast, "vote_id long, member_id long, group_id string, choice string")
    looked_up = []
    monkeypatch.setattr(parties, "latest_on", lambda facts, *rest: looked_up.append(facts.count()) or latest_on(facts, *rest))

    def group(m, day):
        return max([(s, n, g) for k, n, g, s, e in moved if k == m and s <= day and (e is None or day <= e)], default=(0, 0, None))[2]

    until = lambda e, w: min([x for x in (e, on(230) if w == "L" else None) if x], default=dt.date.max)
    want = []
    for v, c, day in held:
        voters = {m for x, m, _, _ in cast if x == v}
        want += [(v, m, group(m, day), m in voters) for m in {m for m, k, s, e, w in seated if k == c and s <= day <= until(e, w)} | voters]
    rows = lambda count=None: [(r.vote_id, r.member_id, r.group_id, r.voted) for r in parties.seat_rows(votes, ballots, mandates, windows, member_of, count).collect()]
    assert sorted(rows(), key=repr) == sorted(want, key=repr)
    # a member's stretches, of both chambers, are no more than the starts and ends of its rows
    assert sum(looked_up) <= len(cast) + 2 * 2 * (len(seated) + len(moved))
    kept = []
    for vote in range(150):
        voted = [r for r in want if r[0] == vote and r[3]]
        absent = sorted([r for r in want if r[0] == vote and not r[3]], key=lambda r: (r[2] or "", str(r[1])))
        kept += voted + (absent if len(voted) > 4 else absent[:4 - len(voted)])
    assert sorted(rows(4), key=repr) == sorted(kept, key=repr)


def test_counts_of_seats_sort_no_rows(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 10L, false), (1, 9L, false), (1, 100L, false), (2, -9L, false), (2, -10L, false), (2, -12L, false), (2, 5L, true), (3, 7L, true), (4, CAST(null AS LONG), false), (4, 9223372036854775807L, false) AS t(vote_id, member_id, voted)")
    counted = intervals.capped_seats(rows)
    assert sorted(map(tuple, counted.collect())) == [(1, 3, 3, "10"), (2, 4, 3, "-10"), (3, 1, 0, ""), (4, 2, 2, "9223372036854775807")]
    plan = counted._jdf.queryExecution().sparkPlan().toString()
    assert sum("HashAggregate(" in line for line in plan.splitlines()) == 2


def tolerant(base, html, parts):
    reader = pg.PageReader(base, parts)
    reader.feed(html)
    reader.close()
    reader._close_block()
    return reader


def test_plain_cells_are_read_a_run_at_a_time(monkeypatch):
    runs = ("<tr><td>1</td><td><a href=\"/p.aspx?ID=S1&cam=2\">x  y</a></td><td></td></tr>", "<td> q &lt; r</td>", "<td>é > \" b</td></tr>", "<td><a href=\"/q&copy=1\">l</a></td>", "<tr><td>k</td>\n",
            "<td><a href=\"http://u.ro/a/b.htm\"></a></td>", "<td><a href=\"a/../b\">t&amp;</a></td></tr>", "<tr><th>g</th><th>h</th></tr>", "<th>z</th><td>y</td>", "<table>", "<table>\n<tr>", "</table>",
            "<td rowspan=\"2\">", "</td>", "<b>", "</b>", "<p>", "</p>", "<a href=\"/o\">", "</a>", "<title>", "</title>", "x")
    draw, parts = random.Random(4), tuple(pg.PARTS)
    for _ in range(1500):
        html, base = "".join(draw.choice(runs) for _ in range(draw.randrange(1, 12))), draw.choice(("https://x.ro/a/b?c=d", "", "HTTP://x.ro/"))
        try:
            want = [pg._READ[p]([tolerant(base, html, parts)]) for p in parts]
        except IndexError:
            continue
        got = pg.read_page(base, html, parts)
        assert [pg._READ[p]([got]) for p in parts] == want, html
    started = []
    was = pg.PageReader.handle_starttag
    monkeypatch.setattr(pg.PageReader, "handle_starttag", lambda self, tag, attrs: started.append(tag) or was(self, tag, attrs))
    page = "<html><body><table>" + "<tr><td>1.</td><td><a href=\"/m?idm=1&cam=2\">A B</a></td><td></td></tr>" * 50 + "</table></body></html>"
    read = pg.read_page("https://x.ro/v", page, ("rows",))
    assert [row[1][:2] for row in read.tables[0]] == [("A B", "https://x.ro/m?idm=1&cam=2")] * 50
    assert started == ["table"]


def test_plain_addresses_are_joined_as_the_library_joins_them():
    draw = random.Random(9)
    for _ in range(4000):
        base = "".join(draw.choice(("http://", "https://", "x.ro", "/a", "?b", "#c", ":80", ".", "//", "HTTP:")) for _ in range(draw.randrange(5)))
        href = "".join(draw.choice(("http://", "https://x.ro", "/", "a", "..", ".", "b.aspx", "?", "c=d&e", "%20", "#f", ";g", " ", ":")) for _ in range(draw.randrange(1, 6)))
        try:
            want = urljoin(base, href)
        except ValueError:
            want = href
        assert pg.PageReader(base)._absolute(href) == want, (base, href)


def test_white_space_and_marks_fold_as_before(spark):
    draw, odd = random.Random(6), [" ", "\t", "\r", "\x0b", "\x1c", "\x85", "\u00a0", "\u1680", "\u180e", "\u2009", "\u3000", "\ufeff", "\uffff", "\U0001F600", "a", "B", "Ș", "é", "e\u0301", "İ"]
    texts = [(c + "x" + c + c + "y" + c,) for c in odd] + [("".join(draw.choice(odd) for _ in range(draw.randrange(9))),) for _ in range(3000)] + [(None,)]
    df, t = spark.createDataFrame(texts, "t string"), F.col("t")
    spaces = F.trim(F.regexp_replace(t, f"[{tx.WHITE}]+", " "))
    marks = F.lower(F.regexp_replace(F.translate(t, tx._NFD_FROM, tx._NFD_TO), r"\p{M}+", ""))
    assert df.where(~spaces.eqNullSafe(tx.clean(t)) | ~marks.eqNullSafe(tx.fold_marks(t))).count() == 0
    assert "octet_length" in df.select(tx.slug(t))._jdf.queryExecution().optimizedPlan().toString()
