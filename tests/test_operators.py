"""Operators against small fixtures and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from annalist.functions import classify as cl
from annalist.functions import dates as fd
from annalist.functions import documents as fdoc
from annalist.functions import identifiers as ids
from annalist.functions import text as tx
from annalist.functions import urls as ur
from annalist.operators import asof, directory, documents as dx, ingest as ig, pages as pg, ranges, resolve as rs, scan, sets, timeline as tl


def d(text):
    return dt.date.fromisoformat(text) if text else None


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(7)
    day = lambda: dt.date(1994, 1, 1) + dt.timedelta(days=rng.randrange(3000))
    made = []
    for i in range(300):
        start = day()
        key = "hot" if i % 3 else f"k{i % 7}"
        made.append((f"i{i}", key, start, None if i % 9 == 0 else start + dt.timedelta(days=rng.randrange(0, 900)), "AB"[i % 2]))
    return made


SPAN = "id string, k string, s date, e date, label string"


def active(row, on):
    return row[2] <= on and (row[3] is None or row[3] >= on)


def test_latest_on_matches_brute_force(spark, spans):
    rng = random.Random(3)
    facts = [(n, "hot" if n % 2 else f"k{n % 9}", dt.date(1994, 1, 1) + dt.timedelta(days=rng.randrange(3400))) for n in range(400)] + [(999, "hot", None)]
    got = asof.latest_on(spark.createDataFrame(facts, "n int, k string, on date"), spark.createDataFrame(spans, SPAN), "k", "on", "s", "e", ["id"], ["s", "id"])
    want = []
    for n, k, on in facts:
        hits = [r for r in spans if on and r[1] == k and active(r, on)]
        want.append((n, max(hits, key=lambda r: (r[2], r[0]))[0] if hits else None))
    assert rows(got, "n", "id") == sorted(want, key=repr)


def test_latest_on_end_day_open_end_and_fallback(spark):
    spans = [("a", "k", d("2000-01-01"), d("2000-02-01"), "A"), ("b", "k", d("2000-03-01"), None, "A"), ("c", "k", d("1960-01-01"), d("1970-01-01"), "A")]
    facts = [(1, "k", d("2000-02-01")), (2, "k", d("2000-02-02")), (3, "k", d("2090-01-01")), (4, "k", d("1965-05-05")), (5, "z", d("2000-01-01"))]
    f, s = spark.createDataFrame(facts, "n int, k string, on date"), spark.createDataFrame(spans, SPAN)
    assert rows(asof.latest_on(f, s, "k", "on", "s", "e", ["id"], ["s", "id"]), "n", "id") == [(1, "a"), (2, None), (3, "b"), (4, "c"), (5, None)]
    assert rows(asof.latest_on_or_any(f, s, "k", "on", "s", "e", ["id"], ["s", "id"]), "n", "id") == [(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)]


def test_join_overlapping_gives_each_pair_once(spark, spans):
    df = spark.createDataFrame(spans, SPAN)
    other = df.select(F.col("id").alias("id2"), "k", F.col("s").alias("s2"), F.col("e").alias("e2"))
    got = rows(ranges.join_overlapping(df, other, ["k"], ("s", "e"), ("s2", "e2")), "id", "id2")
    far = d("9999-12-31")
    want = sorted((a[0], b[0]) for a in spans for b in spans if a[1] == b[1] and a[2] <= (b[3] or far) and b[2] <= (a[3] or far))
    assert got == want


def test_window_boundary_day_belongs_to_the_next_window(spark):
    windows = spark.createDataFrame([("w1", d("2000-01-01"), d("2001-01-01")), ("w2", d("2001-01-01"), d("2002-01-01"))], "w string, ws date, we date")
    facts = spark.createDataFrame([(1, d("2000-12-31")), (2, d("2001-01-01")), (3, d("2002-01-01")), (4, None)], "n int, on date")
    assert rows(ranges.join_in_window(facts, windows, "on", "ws", "we", how="left"), "n", "w") == [(1, "w1"), (2, "w2"), (3, None), (4, None)]


def test_scans_do_not_depend_on_the_slices(spark, spans):
    df = spark.createDataFrame(spans, SPAN).withColumn("v", F.length("id"))
    fine, coarse = F.trunc("s", "month"), F.lit(1)
    for slice_by in (fine, coarse):
        got = scan.lagged(df, ["k"], ["s", "id"], slice_by, {"p": "id"})
        got = scan.running(got, ["k"], ["s", "id"], slice_by, {"total": ("v", "sum"), "top": ("e", "max"), "kept": ("e", "last")})
        want, seen = [], {}
        for r in sorted(spans, key=lambda r: (r[1], r[2], r[0])):
            p, total, top, kept = seen.get(r[1], (None, 0, None, None))
            total += len(r[0])
            top = max([x for x in (top, r[3]) if x], default=None)
            kept = r[3] or kept
            want.append((r[0], p, total, top, kept))
            seen[r[1]] = (r[0], total, top, kept)
        assert rows(got, "id", "p", "total", "top", "kept") == sorted(want, key=repr)


CAREER = "id string, member_id string, label string, chamber string, legislature_id string, type string, starts_on date, ends_on date"


def career(spark, *items):
    return spark.createDataFrame([(i, "m", label, "c", "L", "party", d(s), d(e)) for i, label, s, e in items], CAREER)


def test_merge_touching_takes_the_last_end_and_never_touches(spark):
    df = career(spark, ("1", "A", "2000-01-01", "2000-01-31"), ("2", "A", "2000-02-01", "2000-03-01"), ("3", "A", "2000-03-01", "2000-03-10"),
                ("4", "B", "2000-03-11", "2000-04-01"), ("5", "A", "2000-04-02", None))
    got = tl.merge_touching(df, "member_id", ["label", "chamber", "legislature_id"], "id")
    assert rows(got, "label", "starts_on", "ends_on", "rows_merged") == sorted(
        [("A", d("2000-01-01"), d("2000-03-10"), 3), ("B", d("2000-03-11"), d("2000-04-01"), 1), ("A", d("2000-04-02"), None, 1)], key=repr)


def test_merge_display_open_end_absorbs(spark):
    df = career(spark, ("1", "A", "2000-01-01", None), ("2", "A", "2005-01-01", "2006-01-01"), ("3", "B", "2007-01-01", "2007-02-01"),
                ("4", "B", "2007-02-02", "2007-03-01"), ("5", "B", "2007-05-01", "2007-06-01"))
    got = tl.merge_display(df, "member_id", ["label", "chamber"], "id")
    assert rows(got, "label", "starts_on", "ends_on") == sorted(
        [("A", d("2000-01-01"), None), ("B", d("2007-01-01"), d("2007-03-01")), ("B", d("2007-05-01"), d("2007-06-01"))], key=repr)


def brute_mergers(items, mergers):
    current = [dict(r) for r in items]
    far = d("9999-12-31")
    for on, gone, into in mergers:
        for r in current:
            hit = any(c is not r and c["label"] == gone and c["m"] == r["m"] and c["s"] <= (r["e"] or far) and r["s"] <= (c["e"] or far) for c in current)
            spans_day = r["s"] < on and (r["e"] is None or r["e"] >= on)
            if r["label"] == gone and spans_day:
                r["e"] = on - dt.timedelta(days=1)
            elif r["label"] == into and hit and spans_day:
                r["s"] = on
    return sorted({(r["m"], r["label"], r["s"], r["e"]) for r in current if r["e"] is None or r["s"] <= r["e"]}, key=repr)


def test_mergers_match_the_sequential_rewrite(spark):
    rng = random.Random(11)
    items = []
    for n in range(120):
        start = dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(900))
        items.append({"id": f"{n:03d}", "m": "hot" if n % 3 == 0 else f"m{n % 8}", "label": "ABC"[rng.randrange(3)], "s": start,
                      "e": None if n % 5 == 0 else start + dt.timedelta(days=rng.randrange(700))})
    mergers = [(d("2001-03-01"), "A", "B"), (d("2002-01-01"), "B", "C")]
    df = spark.createDataFrame([(r["id"], r["m"], r["label"], "c", "L", "party", r["s"], r["e"]) for r in items], CAREER)
    got = tl.rewrite_mergers(df, "member_id", "label", mergers, "id")
    assert rows(got, "member_id", "label", "starts_on", "ends_on") == brute_mergers(items, mergers)


def test_governance_fills_head_and_tail_but_not_gaps(spark):
    r = spark.createDataFrame([("r", "P", d("2000-01-01"), d("2000-12-31")), ("q", "Z", d("2000-06-01"), None)], "id string, party_id string, starts_on date, ends_on date")
    g = spark.createDataFrame([("g", "G", d("2000-01-10"), d("2000-11-30"))], "id string, name string, starts_on date, ends_on date")
    a = spark.createDataFrame([("g", "P", "government", "x", d("2000-02-01"), d("2000-03-01")), ("g", "P", "support", "x", d("2000-05-01"), d("2000-06-01"))],
                              "government_id string, party_id string, alignment string, basis string, starts_on date, ends_on date")
    got = tl.governance_contexts(r, g, a, "id", "party_id")
    assert rows(got, "row_id", "alignment", "starts_on", "ends_on") == sorted([
        ("r", "opposition", d("2000-01-10"), d("2000-01-31")), ("r", "government", d("2000-02-01"), d("2000-03-01")), ("r", "support", d("2000-05-01"), d("2000-06-01")),
        ("r", "opposition", d("2000-06-02"), d("2000-11-30")), ("q", "opposition", d("2000-06-01"), d("2000-11-30"))], key=repr)


LEGAL = "Proiect de lege\nArticol unic\nSe aproba.\nArt. 1\nText nou.\nLa articolul 2 se modifica\nalt text\nAnexa nr. 3\ntabel"


def test_sections_of_a_legal_text(spark):
    df = spark.createDataFrame([(1, LEGAL), (2, ""), (3, "fara titluri"), (4, "Art. 5.\nx")], "id long, text string")
    got = dx.section_rows(df).orderBy("document_id", "position").collect()
    first = [r for r in got if r["document_id"] == 1]
    assert [r["section_type"] for r in first] == ["preamble", "unique_article", "article", "amendment", "annex"]
    assert [r["number"] for r in first] == [None, None, "1", "2", "3"]
    assert first[2]["text"] == "Art. 1\nText nou." and first[2]["section_id"] == "art-1-3"
    assert [r["section_type"] for r in got if r["document_id"] == 4] == ["article"]
    parsed = {r["document_id"]: r for r in dx.parse_sections(df).collect()}
    assert parsed[2]["warnings"] == ["empty_text"] and parsed[2]["quality"] == "weak"
    assert parsed[1]["quality"] == "good"


def test_section_diff_counts_and_word_runs(spark):
    a, b = "Art. 1\nunu doi trei\nArt. 2\nla fel\nArt. 3\npleaca", "Art. 1\nunu patru trei\nArt. 2\nLA   fel\nArt. 4\nvine"
    docs = spark.createDataFrame([(1, 7, 0, a), (2, 7, 1, b)], "id long, bill_no long, kind_no int, text string")
    diff = dx.section_diff(dx.consecutive_pairs(docs, "bill_no", "kind_no"), dx.section_rows(docs))
    assert rows(dx.diff_counts(diff), "added", "removed", "changed", "unchanged") == [(1, 1, 1, 1)]
    changed = dx.word_diff(diff).where("key = 'art-1'").orderBy("position").collect()
    assert [(r["kind"], r["value"]) for r in changed] == [("same", "Art. 1 unu"), ("removed", "doi"), ("added", "patru"), ("same", "trei")]


def test_word_runs_remove_before_adding_and_rebuild_both_texts():
    rng = random.Random(5)
    for _ in range(60):
        left = [rng.choice("abcd") for _ in range(rng.randrange(9))]
        right = [rng.choice("abcd") for _ in range(rng.randrange(9))]
        runs = dx.word_runs(" ".join(left), " ".join(right))
        assert " ".join(v for k, v in runs if k != "added") == " ".join(left)
        assert " ".join(v for k, v in runs if k != "removed") == " ".join(right)
    assert dx.word_runs("a", "b") == [("removed", "a"), ("added", "b")]


def test_health_reasons(spark):
    long = "lege proiect guvern art.5 text curat. " * 20
    df = spark.createDataFrame([(1, "", 0), (2, "scurt", 1), (3, "x" * 600, 1), (4, long, 1), (5, "¤¤¤¤" + "a " * 10, 1), (6, "rand\n" * 20 + "lege " * 120, 1)],
                               "document_id long, text string, n int")
    got = {r["document_id"]: r["reasons"] for r in dx.health(df, "n").collect()}
    assert got == {1: ["missing_text_chunks", "high_noise_ratio"], 2: ["very_short_text"], 3: ["low_legal_vocabulary"], 4: [],
                   5: ["very_short_text", "high_noise_ratio"], 6: ["high_repeated_line_ratio"]}


def test_chunks_cover_the_whole_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000))
    got = dx.chunk_rows(spark.createDataFrame([(1, text), (2, "   ")], "id long, text string")).orderBy("chunk_index").collect()
    assert [len(r["text"]) for r in got] == [1800, 1800, 1400] and "".join(r["text"] for r in got) == text


def test_search_snippets_do_not_overlap(spark):
    text = "aaa" + "x" * 300 + "aAa"
    got = dx.search(spark.createDataFrame([(1, text), (2, "nimic")], "id long, text string"), "aa").collect()
    assert [len(r["snippets"]) for r in got] == [2]
    assert got[0]["snippets"][0] == text[:162] + "..." and got[0]["snippets"][1].startswith("...")


def test_identifier_forms(spark):
    value = lambda t, y=None: one(spark, t, ids.parse_identifier(F.col("x"), F.lit(y) if y else None)["value"])[0]
    assert value("PLX 012/2020") == "PL-x 12/2020"
    assert value("PL - x nr. 5/03.04.2021") == "PL-x 5/2021"
    assert value("bp 7 / 2019") == "BP7/2019"
    assert value("L316") is None and value("L316", 2024) == "L316/2024"
    found = one(spark, "L1/2020 si L1/2020, PL-x 2/2021; B9/2019", ids.identifier_values(F.col("x")))[0]
    assert found == ["L1/2020", "B9/2019", "PL-x 2/2021"]
    record = one(spark, "B9/2019 L1/2020 PL-x 2/2021", ids.identifier_record(ids.find_identifiers(F.col("x"))))[0]
    assert record == {"senate": "L1/2020", "deputies": "PL-x 2/2021", "senate_l": "L1/2020", "senate_b": "B9/2019"}


def test_text_dates_urls_and_rules(spark):
    x = F.col("x")
    assert one(spark, "Șerban  Ționescu-É", tx.slug(x), tx.words(x), tx.clean(x)) == ("serban-tionescu-e", "serban tionescu e", "Șerban Ționescu-É")
    assert one(spark, "POPESCU ION-VASILE", tx.title_case(x)) == ("Popescu Ion-Vasile",)
    assert one(spark, "12 mai 2004, 3.02.2001, 1999 si 2004", fd.date_candidates(x)) == (["2004-05-12", "2001-02-03", "1999"],)
    assert one(spark, "din decembrie 2004 până în februarie 2005", fd.period_start(x), fd.period_end(x)) == (d("2004-12-01"), d("2005-01-31"))
    assert one(spark, "din mai 2004 până în mai 2004", fd.period_end(x)) == (None,)
    assert one(spark, "31.02.2004", fd.parse_date(x)) == (None,)
    assert one(spark, "http://H.ro/p?b=2&idl=1&a=1#z", ur.canonical_url(x), ur.query_param(x, "B"), ur.match_url(x)) == ("http://h.ro/p?a=1&b=2&idl=1", "2", "https://H.ro/p?b=2&a=1#z")
    assert one(spark, "http://cdep.ro/pls/steno/evot2015.nominal?idv=7&idl=1", ur.canonical_url(x), ur.kind_of(x), ur.chamber_of(x)) == (
        "https://www.cdep.ro/ords/pls/steno/evot2015.Nominal?idv=7", "vote", "deputies")
    assert one(spark, "Grupul parlamentar al Partidului Social Democrat", cl.party_of(x), cl.group_key(F.lit("senate"), x)) == ("psd", "group-senate-psd")
    assert one(spark, "Alianţa politică PSD+PC", cl.party_of(x)) == (None,)
    assert one(spark, "A fost fondat. A fuzionat! Gata", cl.sentences(x)) == (["A fost fondat.", "A fuzionat!", "Gata"],)
    # 'nu' is looked for before 'nu a votat'
    assert one(spark, "Nu a votat", cl.choice(x)) == ("against",) and one(spark, "-", cl.choice(x)) == ("present_not_voting",)
    assert one(spark, "%_", directory.contains_text("%_", x)) == (True,) and one(spark, "ab", directory.contains_text("%_", x)) == (False,)


def test_table_spans_are_filled_in(spark):
    html = ("<table><tr><th>Grup</th><th>Membru</th><th>Vot</th></tr><tr><td rowspan='2'>G1</td><td><a href='/m?idm=1'>Ana</a></td><td>DA</td></tr>"
            "<tr><td>Ion</td><td>NU</td></tr><tr><td rowspan=9>G2</td><td>Vlad</td><td>AB</td></tr></table><p>x <a href='a.pdf'>Raport</a></p><script>var t='<td>';</script>")
    page = spark.createDataFrame([(1, "https://h.ro/p", html)], "page_id long, url string, html string")
    got = pg.records(pg.cells(page), {"grp": "^grup", "member": "^membru", "choice": "^vot"})
    assert rows(got, "grp", "member", "choice", "member_href") == [
        ("G1", "Ana", "DA", "https://h.ro/m?idm=1"), ("G1", "Ion", "NU", None), ("G2", "Vlad", "AB", None)]
    assert rows(pg.bill_documents(pg.links(page)), "href", "label", "kind") == [("https://h.ro/a.pdf", "Raport", "committee_report")]
    members, memberships = pg.roster(got)
    assert rows(members, "member_id") == [("1",), ("ion",), ("vlad",)] and memberships.count() == 3


def test_page_edges_and_windows(spark):
    base = "https://h.ro/structura/mp?leg=2020&cam=2&idm={}"
    html = f"<a href='{base.format(2)}'>alt mandat</a><a href='{base.format(3)}'>Înlocuiește pe X</a><a href='/foto/1.jpg'></a><a href='/l/2016-2020'>2016 – 2020</a>"
    page = spark.createDataFrame([(1, base.format(1), html)], "page_id long, url string, html string")
    edges, replaced, images = pg.career_links(page)
    assert rows(edges, "src", "dst") == [("leg2020:cam2:idm1", "leg2020:cam2:idm2"), ("leg2020:cam2:idm1", "leg2020:cam2:idm3")]
    assert rows(replaced, "replaced") == [("leg2020:cam2:idm3",)] and rows(images, "asset_type") == [("photo",)]
    assert rows(pg.window_links(pg.links(page)), "period") == [("2016-2020",)]


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(0, n) for n in range(1000, 1200)] + [(n, n + 1) for n in range(2000, 2080)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = rows(rs.components(spark.createDataFrame(edges, "src long, dst long")), "node", "component")
    assert got == sorted(((n, find(n)) for n in parent), key=repr)


def test_title_candidates_match_brute_force(spark):
    titles = ["lege privind organizarea activitatii de control", "supercalifragilistic documentatie", "mic titlu", "activitatii de control comercial si altele"]
    texts = ["vot pentru lege privind organizarea activitatii de control intern", "xsupercalifragilistic documentatiei", "mic titlu", "L5/2001 nimic"]
    b = spark.createDataFrame([(i, t, f"L{i + 4}/2001") for i, t in enumerate(titles)], "id long, title string, ident string")
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = rows(rs.text_candidates(t, b, ["ident"]), "text_id", "bill_id", "reason")
    want = [(ti, bi, "title") for ti, x in enumerate(texts) for bi, y in enumerate(titles) if len(y) > 24 and y[:80] in x] + [(3, 1, "identifier")]
    assert got == sorted(want, key=repr)


def test_reconcile_accepts_words_in_any_order_only_if_unique(spark):
    a = spark.createDataFrame([(1, "s", "Ana Pop", "X"), (2, "s", "Pop Ion", "X"), (3, "s", "Dan Radu", "Y"), (4, "s", "Nou Om", None)], "id long, scope string, name string, p string")
    b = spark.createDataFrame([(11, "s", "Ana Pop", "Z"), (12, "s", "Ion Pop", "X"), (13, "s", "Radu Dan", "Y"), (14, "s", "dan-radu", "Y"), (15, "s", "Alt Om", "Y")], "id long, scope string, name string, p string")
    got = rows(rs.reconcile(a, b, "scope", "name", "p"), "status", "a_id", "b_id")
    assert got == sorted([("mismatch", 1, 11), ("matched", 2, 12), ("matched", 3, 14), ("missing_b", 4, None), ("missing_a", None, 15)], key=repr)


def test_keyset_pages_join_to_the_full_order(spark):
    rng = random.Random(1)
    data = [(i, dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(9))) for i in range(47)]
    df = spark.createDataFrame(data, "id long, held_on date")
    seen, cursor = [], None
    while True:
        page = directory.keyset_page(df, "held_on", "id", 10, cursor).collect()
        seen += [(r["id"], r["held_on"]) for r in page[:10]]
        if len(page) <= 10:
            break
        cursor = (page[9]["held_on"].isoformat(), page[9]["id"])
    assert seen == sorted(data, key=lambda r: (r[1], r[0]), reverse=True)


def test_upserts_are_idempotent_and_partial_ones_keep_the_rest(spark):
    target = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "id long, title string, state string")
    source = spark.createDataFrame([(2, "B", "new"), (3, "C", "new")], "id long, title string, state string")
    once = ig.upsert(target, source, ["id"])
    assert rows(once, "id", "title") == rows(ig.upsert(once, source, ["id"]), "id", "title") == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(ig.partial_upsert(target, source, ["id"], ["title"]), "id", "title", "state") == [(1, "a", "old"), (2, "B", "old"), (3, "C", "new")]


def test_slugs_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i}", i == 50) for i in range(90)], "id long, slug string, owner boolean")
    got = sets.number_slugs(df, "slug", "id", owner="owner", by="n").where("slug = 'hot'").collect()
    assert sorted(r["unique_slug"] for r in got) == sorted(["hot"] + [f"hot-{n}" for n in range(2, 61)])
    assert [r["id"] for r in got if r["unique_slug"] == "hot"] == [50]


def test_frontier_records_pages_that_were_not_fetched(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "src string, dst string")
    got = ig.frontier(edges, spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a",), ("b",)], "node string"))
    assert rows(got, "node", "depth", "fetched") == [("a", 0, True), ("b", 1, True), ("c", 2, False)]


def test_seeds_resets_and_stale_runs(spark):
    seeds = spark.createDataFrame([("g", "G", d("2000-01-01"), d("2001-01-01"), [("p", "PM")], [("P", "government", None, d("2000-05-01"))])],
                                  "id string, name string, starts_on date, ends_on date, roles array<struct<person:string,title:string>>, "
                                  "alignments array<struct<party_id:string,alignment:string,starts_on:date,ends_on:date>>")
    _, roles, aligned = ig.seed_governments(seeds)
    assert rows(roles, "person", "starts_on") == [("p", d("2000-01-01"))] and rows(aligned, "starts_on", "ends_on") == [(d("2000-01-01"), d("2000-05-01"))]
    empty, counts = ig.reset({"roles": roles})
    assert empty["roles"].count() == 0 and dict(rows(counts, "model", "row_count")) == {"roles": 1}
    runs = spark.createDataFrame([(1, "running", dt.datetime(2001, 1, 1, 1)), (2, "running", dt.datetime(2001, 1, 1, 11))], "id int, status string, started_at timestamp")
    assert rows(ig.close_stale_runs(runs, "2001-01-01 12:00:00"), "id", "status") == [(1, "failed"), (2, "running")]
