"""Counts, summaries and refresh candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def completeness(parents: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of each child table per parent(id); each child is counted on its own."""
    out = parents
    for name, rows in children.items():
        out = out.join(rows.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(f"__{name}")), "id", "left")
    return out.select("id", *[F.coalesce(f"__{n}", F.lit(0)).cast("long").alias(n) for n in children])


def status_pivot(queue: DataFrame, kind: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """Rows per kind, split by status."""
    return queue.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col(status) == s, 1)).alias(s) for s in statuses])


def grouped_counts(rows: DataFrame, sets: Sequence[Sequence[str]], distinct: str) -> DataFrame:
    """Rows and distinct values per grouping set; columns outside a set are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(distinct).alias("distinct_values"))


def missing_fields(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows per key and how many lack each field, in one pass."""
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(empty(c), 1)).alias(f"missing_{c}") for c in fields])


def refresh_candidates(parents: DataFrame, steps: DataFrame, urls: DataFrame) -> DataFrame:
    """Parents(id) without steps(parent_id) that have an address: urls(parent_id, url)."""
    least = urls.where(F.col("url").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.min("url").alias("url"))
    return parents.join(steps.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti").join(least, "id")


def superseded(rows: DataFrame, canonical: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Rows per (keys, by) whose keys also occur in a canonical source."""
    return rows.join(canonical.select(*keys).distinct(), list(keys), "left_semi").groupBy(*keys, by).agg(F.count(F.lit(1)).alias("rows"))


def dependents(parents: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of each child table that hang on each of the parents(id), as one
    would weigh them before merging duplicates."""
    ids = parents.select(F.col("id").alias(key)).distinct()
    out = None
    for name, rows in children.items():
        part = rows.join(ids, key, "left_semi").groupBy(F.col(key).alias("parent_id")).agg(F.count(F.lit(1)).alias("rows")).withColumn("child", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def merged_people(members: DataFrame, ids: Sequence[str]) -> DataFrame:
    """members(id, person_id, display_name, ids...) per person: the first name
    and, of each id kind, the last value that is present."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in ids]
    return members.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.min_by("display_name", "id").alias("display_name"), *last)


def latest_photos(photos: DataFrame, current: str) -> DataFrame:
    """photos(person, window, fetched_at, id) of people without one in the
    current window: the newest per person."""
    now = photos.where(F.col("window") == current).select("person").distinct()
    return photos.join(now, "person", "left_anti").groupBy("person").agg(
        F.max_by(F.struct("window", "fetched_at", "id"), F.struct("window", "fetched_at", "id")).alias("p")).select("person", "p.*")


def retention(files: DataFrame, as_of: str, keep: int, days: int) -> DataFrame:
    """files(id, category, modified_on): why each one stays or goes."""
    # newest ``keep`` per category; ranks beyond that are not needed
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("modified_on"), F.desc("id")))
    newest = files.withColumn("rn", rank).where(F.col("rn") <= keep).select("id", F.lit(True).alias("__newest"))
    old = F.col("modified_on") < F.date_sub(F.to_date(F.lit(as_of)), days)
    reason = F.when(F.col("__newest"), "kept_newest").when(old, "expired").otherwise("kept_recent")
    return files.join(newest, "id", "left").select("id", "category", reason.alias("reason"))


def work_queue(
    queue: DataFrame, limit: int, kind: str | None = None, most_failures: int = 3, chamber: str | None = None, official_id: str | None = None,
    source_url: str | None = None, years: Sequence[int] = (),
) -> tuple[DataFrame, DataFrame]:
    """Rows to import next (few failures first, then newest), and the rows left
    out because they failed too often. An address counts in its canonical form;
    ``years`` are years of discovery."""
    from annalist.functions.urls import canonical_url

    due = queue.where(F.col("status").isin("pending", "partial", "failed"))
    for column, value in (("kind", kind), ("chamber", chamber), ("official_id", official_id)):
        if value:
            due = due.where(F.col(column) == value)
    if source_url:
        due = due.where(F.col("source_url") == canonical_url(F.lit(source_url)))
    if years:
        due = due.where(F.year("first_seen").isin(*years))
    ready = due.where(F.col("failure_count") < most_failures)
    skipped = due.where(F.col("failure_count") >= most_failures)
    return ready.orderBy(F.asc("failure_count"), F.desc_nulls_last("last_seen"), F.asc("id")).limit(limit), skipped


def select_assets(items: DataFrame, asset_type: str | None = None, legislature: str | None = None, limit: int | None = None) -> DataFrame:
    """Inventory items(id, asset_type, legislature_id, position) of a type and a
    window, named by the start of its id, the first ``limit`` in their order."""
    if asset_type:
        items = items.where(F.col("asset_type") == asset_type)
    if legislature:
        items = items.where(F.coalesce(F.col("legislature_id"), F.lit("")).startswith(legislature))
    return items.orderBy("position", "id").limit(limit) if limit else items


def text_queue(
    documents: DataFrame, dates: DataFrame, kind: str = "proposal", year: int | None = None, failed: bool = False, unsupported: bool = False, limit: int = 10
) -> DataFrame:
    """Documents(id, bill_id, kind, text_status) whose text is to be read next,
    those of the latest bills first; dates(bill_id, submitted_on,
    latest_event_on). ``failed`` takes those that failed or are missing too,
    ``unsupported`` all that are not stored."""
    wanted = ["pending", *(["failed", "missing"] if failed or unsupported else []), *(["unsupported"] if unsupported else [])]
    day = dates.select("bill_id", F.coalesce("latest_event_on", "submitted_on").alias("event_on"))
    rows = documents.where((F.col("kind") == kind) & F.col("text_status").isin(*wanted)).join(day, "bill_id", "left")
    if year:
        rows = rows.where(F.year("event_on") == year)
    return rows.orderBy(F.desc_nulls_last("event_on"), "bill_id", "id").limit(limit)


def merge_plan(parents: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """Parents(id) with the number of rows of each child table, to weigh two
    rows before they are merged."""
    planned = parents
    for name, rows in children.items():
        counted = rows.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(name))
        planned = planned.join(counted, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return planned


def crawl_report(profiles: DataFrame, top: int = 50) -> DataFrame:
    """(section, item, value) of crawled profiles: counts by window and chamber,
    how many lack each field, how many have a replacement, the names that several
    profiles share (the ``top`` most frequent), and each profile without a constituency."""
    one = F.count(F.lit(1)).alias("value")
    by_place = profiles.groupBy(F.concat_ws(":", "year", "chamber").alias("item")).agg(one).withColumn("section", F.lit("profiles"))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    lacking = {"name": blank("name"), "logo": empty("logo_urls"), "party": empty("party_links"), "group": empty("group_links"), "constituency": blank("constituency")}
    counted = profiles.agg(*[F.count_if(c).alias(n) for n, c in lacking.items()], F.count_if(F.col("related_name").isNotNull()).alias("replacement"))
    unpivoted = counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in [*lacking, "replacement"]])).alias("x")).select("x.*")
    fields = unpivoted.withColumn("section", F.when(F.col("item") == "replacement", "with").otherwise("missing"))
    shared = profiles.where(~blank("name")).groupBy(F.col("name").alias("item")).agg(one).where("value > 1")
    names = shared.orderBy(F.desc("value"), "item").limit(top).withColumn("section", F.lit("shared_name"))
    places = profiles.where(blank("constituency")).select(F.col("profile_key").alias("item"), F.lit(1).cast("long").alias("value"), F.lit("without_constituency").alias("section"))
    return by_place.unionByName(fields).unionByName(names).unionByName(places).select("section", "item", "value")
