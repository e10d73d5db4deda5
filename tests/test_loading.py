"""Rosters, nested loads, run ledgers, section offsets, dossiers and vote pages on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from annalist.functions import classify as cl
from annalist.operators import documents as dx
from annalist.operators import dossier as ds
from annalist.operators import ledger as lg
from annalist.operators import pages as pg
from annalist.operators import rosters as ro
from annalist.operators import votepages as vp


def d(text):
    return dt.date.fromisoformat(text)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- run ledger -----------------------------------------------------------------------

LOG = ("event_id long, run_id string, kind string, event string, at timestamp, discovered long, imported long, partial long, failed long, "
       "skipped long, expected long, read_models string, error string")


def log(spark, *events):
    base = dt.datetime(2001, 1, 1)
    return spark.createDataFrame(
        [(n, run, "k" if len(more) < 9 else more[8], event, base + dt.timedelta(hours=hour), *[more[k] if len(more) > k else 0 for k in range(6)], *(more[6:8] if len(more) > 6 else (None, None)))
         for n, (run, event, hour, *more) in enumerate(events)], LOG)


def test_ledger_sums_steps_and_names_the_status(spark):
    events = log(spark, ("a", "start", 0), ("a", "step", 1, 2, 1, 0, 0, 0, 5, "m1", None), ("a", "step", 2, 1, 1, 1, 0, 0, None, None, "e1"), ("a", "finish", 3),
                 ("b", "start", 0), ("b", "step", 1, 0, 0, 0, 4), ("b", "finish", 2), ("c", "start", 0), ("c", "step", 1, 1, 1), ("c", "finish", 2), ("d", "start", 0), ("d", "step", 1, 3, 3), ("d", "fail", 2))
    got = rows(lg.run_ledger(events), "run_id", "status", "discovered", "imported", "partial", "failed", "expected", "read_models", "errors", "error")
    assert got == [("a", "partial", 3, 2, 1, 0, 5, "m1", 1, "e1"), ("b", "failed", 0, 0, 0, 4, 0, None, 0, None), ("c", "completed", 1, 1, 0, 0, 0, None, 0, None),
                   ("d", "failed", 3, 3, 0, 0, 0, None, 0, None)]


def test_replays_change_nothing_and_stale_runs_end_with_a_later_start(spark):
    # a never finishes: b starts within six hours, c at six hours exactly, e later; z is of another kind
    events = log(spark, ("a", "start", 0), ("b", "start", 5), ("b", "finish", 7), ("c", "start", 6), ("c", "finish", 30), ("e", "start", 8), ("z", "start", 0, 0, 0, 0, 0, 0, 0, None, None, "other"))
    once = rows(lg.run_ledger(events), "run_id", "status", "finished_at")
    at = lambda h: dt.datetime(2001, 1, 1) + dt.timedelta(hours=h)
    assert once == [("a", "failed", at(8)), ("b", "completed", at(7)), ("c", "completed", at(30)), ("e", "running", None), ("z", "running", None)]
    assert rows(lg.run_ledger(events.unionByName(events).orderBy(F.rand(3))), "run_id", "status", "finished_at") == once
    assert lg.run_ledger(events.limit(0)).count() == 0


# --- nested loads -----------------------------------------------------------------------

NESTED = "id string, title string, position int, parts array<struct<kind:string,name:string>>"


def test_children_follow_their_parents_merge(spark):
    child_id = lambda: F.concat_ws("-", "parent", "kind", "name")
    parents = spark.createDataFrame([("p1", "old", 0), ("p2", "kept", 0)], "id string, title string, position int")
    children = spark.createDataFrame([("p1-a-x", "p1", "a", "x"), ("p2-a-y", "p2", "a", "y"), ("gone-a-z", "gone", "a", "z")], "id string, parent string, kind string, name string")
    load = spark.createDataFrame([("p1", "first", 1, [("a", "q")]), ("p1", "new", 2, [("b", "x"), ("b", "x")]), ("p3", "more", 1, [])], NESTED)
    merged, held = ro.merge_nested(parents, children, load, "id", "parts", child_id, "parent", "position")
    assert rows(merged, "id", "title") == [("p1", "new"), ("p2", "kept"), ("p3", "more")]
    assert rows(held, "id") == [("p1-b-x",), ("p2-a-y",)]
    _, kept = ro.merge_nested(parents, children, load, "id", "parts", child_id, "parent", "position", replace=False)
    assert rows(kept, "id") == [("p1-a-x",), ("p1-b-x",), ("p2-a-y",)]
    again, twice = ro.merge_nested(merged, held, load, "id", "parts", child_id, "parent", "position")
    assert rows(again, "id", "title") == rows(merged, "id", "title") and rows(twice, "id") == rows(held, "id")


def test_secondary_rows_number_equal_names(spark):
    windows = spark.createDataFrame([("L", "1990-1992", d("1990-05-20"), d("1992-09-27"))], "id string, label string, starts_on date, ends_on date")
    given = spark.createDataFrame([(1, "senate", "L", "Ion Pop", "", None, "PSD", "psd", "s"), (2, "senate", "L", "Ion  POP", "", None, "—", None, "s"), (3, "senate", "L", "Ana", "", None, "Independent", None, "s")],
                                  "position int, chamber string, legislature_id string, name string, normalized_name string, constituency string, party_label string, party_key string, source_id string")
    tables = ro.fallback_tables(given, windows)
    assert rows(tables["members"], "id", "first_name", "last_name") == [("member-senate-secondary-1990-ana", "Ana", ""), ("member-senate-secondary-1990-ion-pop", "Ion", "Pop"),
                                                                         ("member-senate-secondary-1990-ion-pop-2", "Ion", "POP")]
    assert rows(tables["groups"], "id", "short_name") == [("group-senate-necunoscut", "Necunoscut"), ("group-senate-psd", "PSD"), ("group-senate-unaffiliated", "Neafiliați")]
    counts = ro.group_counts(tables["memberships"], spark.createDataFrame([("group-senate-psd", 1), ("group-senate-x", 2)], "group_id string, expected int"))
    assert rows(counts, "group_id", "expected", "parsed", "agrees") == [("group-senate-necunoscut", None, 1, None), ("group-senate-psd", 1, 1, True), ("group-senate-unaffiliated", None, 1, None),
                                                                         ("group-senate-x", 2, 0, False)]


# --- documents --------------------------------------------------------------------------

def test_offsets_cut_each_section_out_of_its_text(spark):
    texts = ["  intro line\n\nArt. 1\n  first \n\nArt. 2.\nsecond\r\rLa articolul 5 se modifica\n x \n\n", "Art. 7\nonly", "\n\n no heading \n here", "", "Anexa\n😀 ă\nArt. 3\nend"]
    docs = spark.createDataFrame([(n, x) for n, x in enumerate(texts)], "id int, text string")
    found = dx.section_rows(docs).collect()
    assert len(found) == 8
    for r in found:
        cut = texts[r["document_id"]].replace("\r", "\n")[r["start_offset"] : r["end_offset"]]
        assert "\n".join(x.strip() for x in cut.split("\n") if x.strip()) == r["text"]
    for n in range(len(texts)):
        own = sorted((r["start_offset"], r["end_offset"]) for r in found if r["document_id"] == n)
        assert all(a[1] == b[0] for a, b in zip(own, own[1:])) and (not own or own[-1][1] == len(texts[n]))


# --- dossiers ---------------------------------------------------------------------------

def test_dossier_sections_candidates_and_counts(spark):
    bills = spark.createDataFrame([(1, "Lege privind bugetul de stat pe anul viitor", "senate", "L1/1998", "PL-x 9/1998", "s1"), (2, "Lege privind bugetul de stat pe anul viitor", "deputies", None, "PL-x 9/1998", None),
                                   (3, "Scurt", "senate", "L3/1998", None, "s3"), (4, "Lege din alt an despre ceva destul de lung", "senate", "L4/1990", None, None)],
                                  "id long, title string, chamber_of_origin string, senate_identifier string, deputies_identifier string, source_id string")
    dates = spark.createDataFrame([(1, d("1998-02-01"), None), (2, None, d("1998-03-01")), (3, d("1998-01-01"), None), (4, d("1990-01-01"), None)], "bill_id long, submitted_on date, latest_event_on date")
    votes = spark.createDataFrame([(10, None, "senate", "Raport la Legea privind bugetul, lege privind bugetul de stat pe anul viitor", d("1998-05-01"), "s10"), (11, 3, "senate", "Vot final", d("1998-05-01"), None),
                                   (12, None, "senate", "Vot asupra L3/1998 si PL-x 9/1998", d("1998-05-01"), None), (13, None, "deputies", "Vot final asupra ordinii de zi", d("1999-01-01"), None)],
                                  "id long, bill_id long, chamber string, title string, held_on date, source_id string")
    sources = spark.createDataFrame([("s1", "https://x.ro/b1"), ("s3", "https://www.cdep.ro/pls/proiecte/3"), ("s10", "http://x.ro/v10&idl=1")], "id string, source_url string")
    found = spark.createDataFrame([(20, "senate", "vote", "https://x.ro/v10", None, None, d("1998-01-01"), "imported"), (21, "senate", "bill", "https://x.ro/none", "L3/1998", None, d("1998-01-01"), "partial"),
                                   (22, "senate", "bill", "https://x.ro/other", "L77/1998", "despre L1/1998", d("1998-01-01"), "imported"), (23, "senate", "vote", "https://x.ro/v99", None, None, d("1998-01-01"), "pending")],
                                  "id long, chamber string, kind string, source_url string, official_id string, title string, discovered_on date, status string")
    ids = {"senate": "senate_identifier", "deputies": "deputies_identifier"}
    scope = ds.window_scope(bills, dates, votes, found, sources, ids, "1998-01-01", "1999-01-01")
    steps = spark.createDataFrame([(1,)], "bill_id long")
    documents = spark.createDataFrame([(1, True), (2, False)], "bill_id long, stored boolean")
    got = ds.dossier_audit(scope, ids, steps, documents).cache()
    section = lambda name, *columns: rows(got.where(F.col("section") == name), *columns)
    assert section("missing_dossier", "item", "steps", "documents") == [("2", 0, 1), ("3", 0, 0)]
    assert section("duplicate_identifier", "item", "bill_id") == [("deputies:PL-x 9/1998", "1"), ("deputies:PL-x 9/1998", "2")]
    assert section("unmatched_discovery", "item", "candidate_no", "candidate_id", "reason") == [("22", 1, "1", "identifier L1/1998")]
    assert section("unlinked_vote", "item", "candidate_no", "candidate_id", "reason") == [
        ("10", 1, "2", "title prefix"), ("10", 2, "1", "title prefix"), ("12", 1, "2", "identifier PL-x 9/1998"), ("12", 2, "1", "identifier PL-x 9/1998"), ("12", 3, "3", "identifier L3/1998")]
    assert section("weak_title", "item", "bill_id", "candidate_id") == [("11", "3", None)]
    assert dict(section("count", "item", "value")) == {
        "bills": 3, "bills_without_steps": 2, "bills_without_documents": 1, "documents_with_text": 1, "votes": 3, "unlinked_votes": 2, "weak_titles": 1,
        "imported_discoveries": 3, "unmatched_discoveries": 1, "duplicate_identifiers": 1, "unlinked_votes_with_candidates": 2}
    senate = ds.window_scope(bills, dates, votes, found, sources, ids, "1998-01-01", "1999-01-01", chamber="senate")
    assert rows(senate.bills, "id") == [(1,), (3,)]


# --- pages ------------------------------------------------------------------------------

DEPUTIES = """<html><head><title>VOT</title></head><body><table><tr><td>Data:</td><td>03.12.2025</td></tr>
 <tr><td>Subiect vot:</td><td><b>Vot final - PL-x 7/2025</b><br>Adoptare <a href="/pls/proiecte/upl_pck2015.proiect?idp=1">PL 7/2025</a> privind apele<br>- lege organică</td></tr>
 <tr><td>- Pentru (DA):</td><td>1</td></tr> <tr><td>- Contra (NU):</td><td>{against}</td></tr> <tr><td>- Abtineri (AB):</td><td>0</td></tr> <tr><td>- Nu au votat (-):</td><td>1</td></tr></table>
 <table><tr><td>#</td><td>Nume</td><td>Grup</td><td>Vot</td></tr>
 <tr><td>1.</td><td><a href="/structura2015.mp?idm=3&cam=2">POP-ION Ana</a></td><td>Neafiliati</td><td>DA</td></tr>
 <tr><td>2.</td><td><a href="/structura2015.mp?idm=4&cam=2">Radu</a></td><td>SOS RO</td><td>-</td></tr>
 <tr><td>x</td><td><a href="/structura2015.mp?idm=5&cam=2">Nu</a></td><td>A</td><td>DA</td></tr><tr><td>4.</td><td>Fara</td><td>A</td><td>DA</td></tr></table></body></html>"""


def test_deputies_pages_of_all_kinds(spark):
    joint = DEPUTIES.format(against=0).replace("<table>", "<table><tr><th>Parlamentar</th><th>Camera Deputatilor</th><th>Senat</th></tr>", 1)
    pages = spark.createDataFrame([(1, "https://c.ro/a?idv=1", DEPUTIES.format(against=0)), (2, "https://c.ro/a?idv=2", DEPUTIES.format(against=5)), (3, "https://c.ro/a?idv=3", joint),
                                   (4, "https://c.ro/a?idv=4", "<html></html>"), (5, "https://c.ro/a?idv=5", None)], "page_id long, url string, html string")
    tables = vp.deputies_votes(pages)
    votes = {r["page_id"]: r for r in tables.votes.collect()}
    one = votes[1]
    assert (one["title"], one["bill_id"], one["held_on"], one["status"], one["warnings"]) == ("Vot final - PL-x 7/2025 - Adoptare", "bill-pl-x-7-2025", d("2025-12-03"), "parsed", [])
    assert (one["present"], one["for_count"], one["present_not_voting"]) == (2, 1, 1)
    assert votes[2]["status"] == "partial" and votes[2]["warnings"] == ["counts differ"]
    assert votes[3]["status"] == "failed" and votes[3]["warnings"] == ["joint sitting", "no ballots"]
    assert votes[4]["warnings"] == ["no ballots", "no subject"] and votes[4]["held_on"] is None and votes[5]["title"] == "Chamber nominal vote"
    own = tables.members.where("page_id = 1")
    assert rows(own, "member_id", "display_name", "first_name", "last_name") == [("member-deputies-3", "Pop-Ion Ana", "Pop-Ion", "Ana"), ("member-deputies-4", "Radu", "Radu", "Radu")]
    assert rows(tables.ballots.where("page_id = 1"), "group_id", "choice") == [("group-deputies-sos-ro", "present_not_voting"), ("group-deputies-unaffiliated", "for")]
    assert rows(tables.bills.where("page_id = 1"), "title", "identifiers") == [("privind apele", {"deputies": "PL-x 7/2025"})]


def test_senate_page_with_marks_and_a_page_without_anything(spark):
    html = """<div class="new-page-voturi-plen-detaliu"><div class="section-title"><h2>L16/2025<br>19/11/2025<br>Vot final</h2></div><ul class="total-votes"><li>Prezenți: 1 21</li><li>Pentru: 116</li></ul></div>
      <h5>alt titlu</h5><div class="plenary-votes"><h5>Subiect</h5><table><tbody><tr><th>G</th></tr><tr><td>PSD</td><td>3</td><td>x</td><td></td><td>2</td></tr></tbody></table>
      <table><tr><td><a href="f?ParlamentarID=AB1&x">POP</a></td><td>Ana</td><td>Fără apartenență</td><td></td><td>x</td><td></td><td></td><td>electronic</td></tr>
      <tr><td>ION</td><td>Dan</td><td>PACE - Întâi România</td><td></td><td></td><td></td><td></td></tr><tr><td></td><td>fara</td></tr></table></div>"""
    pages = spark.createDataFrame([(1, "https://s.ro/v", html), (2, "https://s.ro/w", "<p>nimic</p>")], "page_id long, url string, html string")
    tables = vp.senate_votes(pages)
    votes = {r["page_id"]: r for r in tables.votes.collect()}
    assert (votes[1]["vote_id"], votes[1]["title"], votes[1]["bill_id"], votes[1]["present"], votes[1]["for_count"]) == ("vote-senate-l16-2025-11-19-final", "L16/2025 — Vot final", "bill-l16-2025", 121, 116)
    assert votes[2]["vote_id"] == "vote-senate-senate-vote-unknown" and votes[2]["held_on"] is None
    assert rows(tables.totals, "group_id", "for_count", "against", "present_not_voting") == [("group-senate-psd", 3, 0, 2)]
    assert rows(tables.ballots, "member_id", "group_id", "choice", "method") == [("member-dan-ion", "group-senate-pace", "unknown", None), ("member-senate-AB1", "group-senate-neafiliati", "against", "electronic")]
    assert rows(tables.groups, "group_id", "color") == [("group-senate-neafiliati", "#64748b"), ("group-senate-pace", "#7c3aed"), ("group-senate-psd", "#d71920")]


def test_registry_short_names_by_paragraph_then_link(spark):
    text = spark.createDataFrame([("Partidul X", 'denumirea prescurtată este „P.X.”'), ("Partidul Y – PY", "altceva"), ("1. 05.03.1998 – Partidul Z – PZ", "x"), ("Uniunea – cu denumirea de sus", "y"),
                                  ("A, denumirea prescurtată: ABC, sediu", "A")], "link string, paragraph string")
    assert [r[0] for r in text.select(cl.short_name(F.col("link"), F.col("paragraph"))).collect()] == ["P.X", "PY", None, None, "ABC"]


def test_role_rows_pass_to_the_next_member_that_counts(spark):
    row = lambda idm, name, bold=True, first="1.", second="": f'<tr><td>{first}</td><td>{second}</td><td>{"<b>" if bold else ""}<a href="structura2015.mp?idm={idm}">{name}</a>{"</b>" if bold else ""}</td></tr>'
    html = "<table><tr><td>Secretar</td></tr>" + row(1, "Ana") + "<tr><td>Lider</td></tr>" + row(2, "Dan", bold=False) + row(1, "Ana") + row(3, "Ion") + row(4, "CV complet") + row(5, "Eva", second="Vicelider") + "</table>"
    url = "https://c.ro/structura2015.gp?idg=1"
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    groups = spark.createDataFrame([(url, "g")], "url string, group_id string")
    got = rows(pg.group_members(pages, groups, "2000-01-01"), "official_id", "role", "starts_on")
    assert got == [("1", "Secretar grup parlamentar", d("2000-01-01")), ("3", "Lider grup parlamentar", d("2000-01-01")), ("5", "Vicelider grup parlamentar", d("2000-01-01"))]


@pytest.mark.parametrize("html, kinds", [("<p>Nimic aici.</p>", ["no_candidate"]), ('<table class="infobox"><tr><td>Fondat</td><td>1990</td></tr></table><p>S-a dizolvat. S-a dizolvat.</p>', ["infobox", "paragraph"])])
def test_articles_with_and_without_candidates(spark, html, kinds):
    pages = spark.createDataFrame([(1, "https://e.ro", html)], "page_id long, url string, html string")
    assert [r["kind"] for r in pg.article_candidates(pages).orderBy("n").collect()] == kinds
