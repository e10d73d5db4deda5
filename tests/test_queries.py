"""Every registered query on the smallest tables, against its SQL check."""

import os
import re

import pytest
from pyspark.sql import functions as F

from annalist.functions.documents import AMENDING
from annalist.operators import documents as dx
from annalist.plans import catalog
from annalist.plans.bindings import Tables
from annalist.plans.documents import legal
from tests.compare import duck, plain, rows_of

SF = os.environ.get("ANNALIST_TEST_SF", "/root/testdata/sf0.001")
SPARK, SQL = catalog.spark_queries(), catalog.check_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(SPARK))
def test_query(spark, con, name):
    frame = SPARK[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    if name not in SQL:
        assert frame.columns
        return
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    got, got_columns = rows_of(frame.columns, rows)
    want, want_columns = rows_of(columns, result.fetchall())
    assert got_columns == want_columns
    assert got == want


def test_every_active_member_of_the_chamber_has_a_seat(spark):
    t = Tables(spark, SF)
    ends = t.legislatures.select(F.col("id").alias("legislature_id"), F.col("ends_on").alias("w_e"))
    held = {}
    for m in t.mandates.join(ends, "legislature_id").select("member_id", "chamber", "starts_on", F.least("ends_on", "w_e").alias("e")).collect():
        held.setdefault(m.chamber, []).append(m)
    want = {(v.id, m.member_id) for v in t.votes.select("id", "chamber", "held_on").collect() for m in held.get(v.chamber, []) if v.held_on and m.starts_on <= v.held_on <= m.e}
    want |= {(b.vote_id, b.member_id) for b in t.ballots.select("vote_id", "member_id").collect()}
    seats = [(r.vote_id, r.member_id) for r in SPARK["s3_seat_rows"](spark, SF).collect()]
    assert len(set(seats)) == len(want) and set(seats) == want


def plain_warnings(text, sections):
    if not re.sub(r"\s+", "", text):
        return {"empty_text"}
    own = [s for s in sections if s.section_type != "preamble"]
    keys = [re.sub(r"[^a-z0-9]+", "-", s.heading.lower()).strip("-") or "document" for s in own]
    told = {
        "no_structural_headings": not own and len(text) > 700,
        "amendment_only_document": all(s.section_type in ("amendment", "point", "paragraph") for s in own) if own else bool(re.search(AMENDING.replace("(?iu)", "(?i)"), text)),
        "huge_section": any(len(s.text) > 8000 for s in sections),
        "duplicate_section_heading": len(set(keys)) < len(keys),
        "too_many_short_sections": len(own) >= 8 and sum(len(s.text) < 80 for s in own) / len(own) > 0.5,
    }
    return {k for k, v in told.items() if v}


def test_every_section_warning_is_an_issue(spark):
    parsed = dx.parse_sections(legal(Tables(spark, SF))).select("document_id", "text", "sections").collect()
    want = {(str(r.document_id), w) for r in parsed if r.text is not None for w in plain_warnings(r.text, r.sections)}
    got = [(r.entity_id, r.reason) for r in SPARK["r13_section_parse_issues"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    counts = {w: sum(x == w for _, x in got) for w in {x for _, x in got}}
    assert set(counts) - {"duplicate_section_heading"}
