"""Data-health queues and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vote_audit_rows(
    votes: DataFrame, sources: DataFrame, coverage: DataFrame, start: str, end: str, chamber: str | None = None
) -> DataFrame:
    """Votes of a half-open date window with their source and coverage."""
    kept = votes.where((F.col("held_on") >= F.to_date(F.lit(start))) & (F.col("held_on") < F.to_date(F.lit(end))))
    if chamber:
        kept = kept.where(F.col("chamber") == chamber)
    s = sources.select(F.col("id").alias("source_id"), "source_url", F.col("status").alias("source_status"))
    c = coverage.withColumnRenamed("vote_id", "id")
    return kept.select("id", "chamber", "title", "held_on", "bill_id", "source_id").join(s, "source_id", "left").join(
        c, "id", "left").drop("source_id")


def issue(rows: DataFrame, code: str, severity: str, ident: str, samples: int) -> DataFrame:
    """One audit line: how many rows, and the first ids. No line without rows."""
    total = rows.groupBy().agg(F.count(F.lit(1)).alias("count"))
    few = rows.select(F.col(ident).cast("string").alias("i")).orderBy("i").limit(samples)
    listed = few.groupBy().agg(F.array_join(F.array_sort(F.collect_list("i")), ",").alias("samples"))
    tag = lambda df: df.withColumn("code", F.lit(code))
    return tag(total).join(tag(listed), "code").where("count > 0").select("code", F.lit(severity).alias("severity"), "count", "samples")


def unmatched_discoveries(discoveries: DataFrame, identifiers: DataFrame, bill_urls: DataFrame, vote_urls: DataFrame) -> DataFrame:
    """Imported and partial discoveries that no stored row answers for: bills by
    identifiers(official_id) or bill_urls(source_url), votes by
    vote_urls(source_url). Spellings of an address that agree are the same."""
    from annalist.functions.urls import match_url

    done = discoveries.where(F.col("status").isin("imported", "partial")).withColumn("address", match_url(F.col("source_url")))
    known = lambda urls: urls.select(match_url(F.col("source_url")).alias("address")).distinct()
    bills = done.where("kind = 'bill'").join(identifiers.select("official_id").distinct(), "official_id", "left_anti").join(known(bill_urls), "address", "left_anti")
    votes = done.where("kind <> 'bill'").join(known(vote_urls), "address", "left_anti")
    return bills.select("id").unionByName(votes.select("id"))


def audit_report(issues: list[DataFrame]) -> DataFrame:
    report = issues[0]
    for one in issues[1:]:
        report = report.unionByName(one)
    return report


# Titles that say nothing about the matter.
GENERIC_TITLES = ("chamber vote", "senate vote", "vot", "vot final", "vot electronic", "proiect de hotarare")


def weak_title(title, variant: str = "queue"):
    """Three variants: 'queue' looks at the lower-cased title, 'audit' at the
    folded one, 'dossier' also refuses titles that name an amendment number."""
    from annalist.functions.text import words

    if variant == "queue":
        low = F.lower(title)
        return (low == "vot electronic") | low.contains("amendament") | low.contains("procedur") | (F.length(low) < 24)
    folded = words(title)
    weak = (F.length(folded) < 18) | folded.isin(*GENERIC_TITLES)
    if variant == "dossier":
        weak = weak | folded.rlike(r"(?<![a-z0-9_])ama\s*\d+(?![a-z0-9_])")
    return weak


def issue_key(kind: str, entity, reason=None):
    """``ocr:id:reason`` for text health, ``kind:id`` for all other queues."""
    if kind == "ocr":
        return F.concat_ws(":", F.lit("ocr"), entity.cast("string"), F.coalesce(reason, F.lit("needs_review")))
    return F.concat_ws(":", F.lit(kind), entity.cast("string"))


def health_issues(scored: DataFrame) -> DataFrame:
    """One issue per document and reason."""
    rows = scored.select(F.col("document_id").alias("entity_id"), F.explode_outer("reasons").alias("reason")).where(F.col("reason").isNotNull())
    return _issues(rows, "ocr", issue_key("ocr", F.col("entity_id"), F.col("reason")))


def section_issues(parsed: DataFrame) -> DataFrame:
    """One issue per document and warning; those of a document share a key."""
    rows = parsed.select(F.col("document_id").alias("entity_id"), F.explode_outer("warnings").alias("reason")).where(F.col("reason").isNotNull())
    return _issues(rows, "weak-section-parse", issue_key("weak-section-parse", F.col("entity_id")))


def vote_issues(votes: DataFrame) -> DataFrame:
    """Votes without a bill, and votes with a weak title."""
    unlinked = votes.where(F.col("bill_id").isNull()).select(F.col("id").alias("entity_id"), F.lit("unlinked").alias("reason"))
    weak = votes.where(weak_title(F.col("title"))).select(F.col("id").alias("entity_id"), F.lit("weak title").alias("reason"))
    return _issues(unlinked, "vote-unlinked", issue_key("vote-unlinked", F.col("entity_id"))).unionByName(
        _issues(weak, "weak-vote-title", issue_key("weak-vote-title", F.col("entity_id"))))


def duplicate_issues(duplicates: DataFrame, key: str) -> DataFrame:
    rows = duplicates.select(F.col(key).alias("entity_id"), F.lit("same identifier").alias("reason"))
    return _issues(rows, "duplicate-bill-identifier", issue_key("duplicate-bill-identifier", F.col("entity_id")))


def missing_procedure(documents: DataFrame, steps: DataFrame) -> DataFrame:
    """Bills with documents but without procedure steps."""
    counted = documents.groupBy("bill_id").agg(F.count(F.lit(1)).alias("documents"))
    return counted.join(steps.select("bill_id").distinct(), "bill_id", "left_anti")


def procedure_issues(missing: DataFrame) -> DataFrame:
    rows = missing.select(F.col("bill_id").alias("entity_id"), F.lit("no steps").alias("reason"))
    return _issues(rows, "missing-procedure", issue_key("missing-procedure", F.col("entity_id")))


def _issues(rows: DataFrame, kind: str, key) -> DataFrame:
    return rows.select(key.alias("issue_key"), F.lit(kind).alias("issue_type"), F.col("entity_id").cast("string").alias("entity_id"), "reason")


def with_review(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """The reviewer's status replaces 'open'. reviews(issue_key, status)."""
    one = reviews.groupBy("issue_key").agg(F.max("status").alias("__status"))
    return issues.join(one, "issue_key", "left").withColumn("status", F.coalesce("__status", F.lit("open"))).drop("__status")


def open_counts(issues: DataFrame) -> DataFrame:
    """Issues and open issues per queue, and over all."""
    per = issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("issues"), F.count(F.when(F.col("status") == "open", 1)).alias("open"))
    total = per.groupBy().agg(F.sum("issues").alias("issues"), F.sum("open").alias("open")).select(F.lit("all").alias("issue_type"), "issues", "open")
    return per.unionByName(total)
