"""Audits of one window: what its bills, votes and discoveries lack, and which bills a text may mean."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.identifiers import identifier_values
from annalist.operators.audit import unmatched_discoveries, weak_title
from annalist.operators.resolve import duplicate_rows, text_candidates
from annalist.operators.sets import top_per_key
from annalist.session import cut_lineage

#: Fixed value: addresses of bill dossiers.
DOSSIER_PAGES = r"(?i)cdep\.ro.*proiecte"

#: What each finding asks the reviewer to do.
ACTIONS = {
    "missing_dossier": "import the dossier page",
    "duplicate_identifier": "review as one lifecycle before merging",
    "unmatched_bill": "point at an existing bill or import its page",
    "unmatched_vote": "compare addresses, then link or import",
    "unlinked_candidates": "review the candidates before linking",
    "unlinked_alone": "keep unlinked",
    "weak_linked": "show the linked bill beside the title",
    "weak_alone": "link by identifier or treat as procedural",
}

#: What a finding tells besides its section and item.
FIELDS = {
    "bill_id": "string", "title": "string", "chamber": "string", "happened_on": "date", "source_url": "string",
    "identifiers": "string", "steps": "long", "documents": "long", "action": "string", "text_id": "string",
}


@dataclass(frozen=True)
class Scope:
    """What a window holds: bills (with ``day``), votes (with ``source_url``),
    discoveries, and the addresses of bills (id, source_url)."""

    bills: DataFrame
    votes: DataFrame
    discoveries: DataFrame
    bill_urls: DataFrame
    identifiers: Sequence[str]


def window_scope(
    bills: DataFrame, dates: DataFrame, votes: DataFrame, discoveries: DataFrame, sources: DataFrame,
    identifiers: dict[str, str], start: str, end: str, chamber: str | None = None,
) -> Scope:
    """The rows of the half-open window: bills by their first known day (dates:
    bill_id, submitted_on, latest_event_on), votes by ``held_on``, discoveries by
    ``discovered_on``. ``identifiers`` names the column of each kind. With a
    chamber: its votes and discoveries, and bills that begin there or carry its
    identifier."""
    within = lambda c: (c >= F.to_date(F.lit(start))) & (c < F.to_date(F.lit(end)))
    d = dates.select(F.col("bill_id").alias("id"), "submitted_on", "latest_event_on")
    b = bills.join(d, "id").withColumn("day", F.coalesce("submitted_on", "latest_event_on")).where(within(F.col("day")))
    v, f = votes.where(within(F.col("held_on"))), discoveries.where(within(F.col("discovered_on")))
    if chamber:
        own = F.col(identifiers[chamber]).isNotNull() if chamber in identifiers else F.lit(False)
        b = b.where((F.col("chamber_of_origin") == chamber) | own)
        v, f = v.where(F.col("chamber") == chamber), f.where(F.col("chamber") == chamber)
    s = sources.select(F.col("id").alias("source_id"), "source_url")
    # read by every section, so written once
    b = cut_lineage(b)
    v = cut_lineage(v.join(s, "source_id", "left"))
    urls = b.select("id", "source_id").join(s, "source_id").select("id", "source_url")
    return Scope(b, v, f, urls, list(identifiers.values()))


def identifier_keys(bills: DataFrame, identifiers: dict[str, str]) -> DataFrame:
    """(key ``kind:value``, id), a row per identifier."""
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{kind}:"), F.col(c))) for kind, c in identifiers.items()])
    return bills.select(F.explode(F.array_compact(pairs)).alias("key"), "id")


def unmatched(scope: Scope) -> DataFrame:
    """Imported and partial discoveries that no bill or vote of the window answers for."""
    known = scope.bills.select(F.explode(F.array_compact(F.array(*scope.identifiers))).alias("official_id"))
    ids = unmatched_discoveries(scope.discoveries, known, scope.bill_urls, scope.votes.where("source_url IS NOT NULL"))
    return scope.discoveries.join(ids, "id", "left_semi")


def ranked_candidates(texts: DataFrame, scope: Scope, k: int) -> DataFrame:
    """Up to ``k`` bills per text(id, text), the newest first: (id, candidate_no,
    candidate_id, reason). The reason names the first identifier that is found."""
    pairs = text_candidates(texts, scope.bills, scope.identifiers, detail=True)
    newest = scope.bills.select(F.col("id").alias("bill_id"), "day")
    best = top_per_key(pairs.join(newest, "bill_id"), ["text_id"], [F.desc_nulls_last("day"), F.asc("bill_id")], k, rank="candidate_no")
    reason = F.when(F.col("reason") == "identifier", F.concat(F.lit("identifier "), "detail")).otherwise("title prefix")
    return best.select(F.col("text_id").alias("id"), "candidate_no", F.col("bill_id").cast("string").alias("candidate_id"), reason.alias("reason"))


def _counts(rows: DataFrame, **counts: Column) -> DataFrame:
    one = rows.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in counts])).alias("x")).select("x.*")


def dossier_audit(
    scope: Scope, identifiers: dict[str, str], steps: DataFrame, documents: DataFrame, pages: str = DOSSIER_PAGES, k: int = 5
) -> DataFrame:
    """Five sections and their counts as rows of one table, tagged by ``section``.

    missing_dossier: bills of the deputies (by identifier or page address) without
    steps or documents; duplicate_identifier: a row per bill of a shared
    identifier, ``item`` is the identifier; unmatched_discovery, unlinked_vote,
    weak_title: a row per candidate bill, or one without. steps(bill_id),
    documents(bill_id, stored)."""
    tally = lambda rows, name, *more: rows.groupBy(F.col("bill_id").alias("id")).agg(F.count(F.lit(1)).alias(name), *more)
    urls = scope.bill_urls.groupBy("id").agg(F.min("source_url").alias("source_url"), F.max(F.col("source_url").rlike(pages)).alias("paged"))
    bills = scope.bills.join(tally(steps, "steps"), "id", "left").join(
        tally(documents, "documents", F.sum(F.col("stored").cast("long")).alias("stored")), "id", "left").join(urls, "id", "left")
    bills = cut_lineage(bills.select("*", *[F.coalesce(c, F.lit(0)).alias(f"__{c}") for c in ("steps", "documents", "stored")]))
    joined = F.array_join(F.array(*identifiers.values()), ",")

    def finding(rows: DataFrame, section: str, item: Column, **values: Column) -> DataFrame:
        filled = [values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()]
        return rows.select(F.lit(section).alias("section"), item.cast("string").alias("item"), *filled)

    col = F.col
    wanted = ((col("__steps") == 0) | (col("__documents") == 0)) & (col(identifiers["deputies"]).isNotNull() | F.coalesce("paged", F.lit(False)))
    about_bill = {"title": col("title"), "chamber": col("chamber_of_origin"), "happened_on": col("day"), "source_url": col("source_url"), "identifiers": joined}
    missing = finding(bills.where(wanted), "missing_dossier", item=col("id"), bill_id=col("id"), steps=col("__steps"), documents=col("__documents"),
                      action=F.lit(ACTIONS["missing_dossier"]), **about_bill)
    shared = duplicate_rows(identifier_keys(scope.bills, identifiers), "key", "id").select("key", "id").join(bills, "id")
    duplicates = finding(shared, "duplicate_identifier", item=col("key"), bill_id=col("id"), action=F.lit(ACTIONS["duplicate_identifier"]), **about_bill)
    lost = cut_lineage(unmatched(scope))
    lost_text = F.concat_ws(" ", F.coalesce("official_id", F.lit("")), F.coalesce("title", F.lit("")), "source_url")
    by_kind = F.when(col("kind") == "bill", ACTIONS["unmatched_bill"]).otherwise(ACTIONS["unmatched_vote"])
    discovered = finding(lost, "unmatched_discovery", item=col("id"), title=col("title"), chamber=col("chamber"), happened_on=col("discovered_on"),
                         source_url=col("source_url"), identifiers=col("official_id"), action=by_kind, text_id=F.concat(F.lit("d"), col("id").cast("string")))
    vote_text = F.concat_ws(" ", "title", F.coalesce("source_url", F.lit("")))
    weak = weak_title(col("title"), "dossier")
    doubtful = scope.votes.where(col("bill_id").isNull() | weak)
    vote_id = F.concat(F.lit("v"), col("id").cast("string"))

    def about_vote(rows: DataFrame, section: str, action: Column) -> DataFrame:
        return finding(rows, section, item=col("id"), bill_id=col("bill_id"), title=col("title"), chamber=col("chamber"), happened_on=col("held_on"),
                       source_url=col("source_url"), identifiers=F.array_join(identifier_values(vote_text), ","), action=action, text_id=vote_id)

    unlinked = about_vote(scope.votes.where("bill_id IS NULL"), "unlinked_vote", F.lit(None))  # told by the candidates below
    weak_rows = about_vote(scope.votes.where(weak), "weak_title", F.when(col("bill_id").isNotNull(), ACTIONS["weak_linked"]).otherwise(ACTIONS["weak_alone"]))
    texts = doubtful.select(vote_id.alias("id"), vote_text.alias("text")).unionByName(lost.select(F.concat(F.lit("d"), col("id").cast("string")).alias("id"), lost_text.alias("text")))
    candidates = cut_lineage(ranked_candidates(texts, scope, k))
    named = F.when(col("candidate_id").isNotNull(), ACTIONS["unlinked_candidates"]).otherwise(ACTIONS["unlinked_alone"])
    findings = missing.unionByName(duplicates).unionByName(discovered).unionByName(unlinked).unionByName(weak_rows)
    found = findings.join(candidates.withColumnRenamed("id", "text_id"), "text_id", "left").withColumn(
        "action", F.when(col("section") == "unlinked_vote", named).otherwise(col("action"))).withColumn("value", F.lit(None).cast("long")).drop("text_id")
    one = F.count(F.lit(1))
    with_candidates = scope.votes.where("bill_id IS NULL").select(vote_id.alias("id")).join(candidates.select("id"), "id", "left_semi")
    counted = [
        _counts(bills, bills=one, bills_without_steps=F.count_if(col("__steps") == 0), bills_without_documents=F.count_if(col("__documents") == 0),
                documents_with_text=F.sum("__stored")),
        _counts(scope.votes, votes=one, unlinked_votes=F.count_if(col("bill_id").isNull()), weak_titles=F.count_if(weak)),
        _counts(scope.discoveries, imported_discoveries=F.count_if(col("status").isin("imported", "partial"))),
        _counts(lost, unmatched_discoveries=one),
        _counts(identifier_keys(scope.bills, identifiers).groupBy("key").count().where("count > 1"), duplicate_identifiers=one),
        _counts(with_candidates, unlinked_votes_with_candidates=one),
    ]
    for rows in counted:
        found = found.unionByName(rows.withColumn("section", F.lit("count")), allowMissingColumns=True)
    return found


def window_counts(scope: Scope, coverage: DataFrame) -> DataFrame:
    """How many discoveries, bills and votes the window holds, by status and
    coverage: (item, value). coverage(vote_id, coverage_level)."""
    of = lambda kind, status=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if status is None else F.col("status") == status))
    found = {"found_bills": of("bill"), "found_votes": of("vote")}
    for status in ("imported", "pending", "failed"):
        found |= {f"{status}_bills": of("bill", status), f"{status}_votes": of("vote", status)}
    level = F.coalesce("coverage_level", F.lit("source_only"))
    levels = {f"votes_{name}": F.count_if(level == name) for name in ("nominal", "group_totals", "result_only", "source_only")}
    covered = scope.votes.join(coverage.select(F.col("vote_id").alias("id"), "coverage_level"), "id", "left")
    return _counts(scope.discoveries, **found).unionByName(_counts(scope.bills, bills=F.count(F.lit(1)))).unionByName(
        _counts(covered, votes=F.count(F.lit(1)), votes_without_bill=F.count_if(F.col("bill_id").isNull()), **levels))
