"""Rosters as normalised tables, and loading them into what is stored."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import classify as cl
from annalist.functions.dates import parse_date
from annalist.functions.text import acronym, clean, first_names, last_name, slug, truncate
from annalist.operators.ingest import replace_children, upsert
from annalist.operators.sets import first_wins, last_wins, number_slugs
from annalist.session import cut_lineage

UNALIGNED = r"(?i)neafili|independent|mixt"


def _none(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _names(name: Column) -> list[Column]:
    single = F.size(F.split(clean(name), " ")) == 1
    return [clean(name).alias("display_name"), F.when(single, clean(name)).otherwise(first_names(name)).alias("first_name"),
            F.when(single, "").otherwise(last_name(name)).alias("last_name")]


def _capitalised(name: Column) -> Column:
    return F.array_join(F.transform(F.split(clean(name), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def _is_name(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 5


def _formation(label: Column, year: Column) -> tuple[Column, Column]:
    """(id, short name) of a label that no canonical party is behind."""
    short = F.when(F.length(label) <= 24, label).otherwise(F.coalesce(_none(acronym(label)), truncate(label, 24)))
    return F.concat_ws("-", F.lit("party-formation"), year, slug(label)), short


def _last(rows: DataFrame) -> DataFrame:
    return last_wins(rows, ["id"], ["position"]).drop("position")


def _first(rows: DataFrame) -> DataFrame:
    return first_wins(rows, ["id"], ["position"]).drop("position")


def profile_tables(profiles: DataFrame, legislatures: DataFrame, today: str, current: str = "2024") -> dict[str, DataFrame]:
    """Official profiles as nine tables, each row once by id, the last profile
    (by ``position``) winning.

    profiles(position, profile_key, official_id, year, chamber, name, url,
    content_hash, http_status, validation_text, end_text, constituency,
    party_links, group_links, committee_links: array<struct<label, url>>,
    logo_urls: array<string>, related_name, related_key, related_url). Profiles
    without a name or a known window are left out. A mandate starts on the day in
    the validation text, else with its window; it has ended if it has an end or
    its window ended before ``today``. Members of windows other than ``current``
    carry the year in their id.
    """
    w = legislatures.select(F.substr("label", F.lit(1), F.lit(4)).alias("year"), F.col("id").alias("legislature_id"), F.col("label").alias("window"),
                            F.col("starts_on").alias("w_s"), F.col("ends_on").alias("w_e"))
    number = F.when(F.col("year") == current, F.col("official_id")).otherwise(F.concat_ws("-", "year", "official_id"))
    p = profiles.where("name <> ''").join(w, "year").withColumn("member_id", F.concat_ws("-", F.lit("member"), "chamber", F.lower(number)))
    p = p.withColumn("starts_on", F.coalesce(parse_date(F.col("validation_text")), "w_s")).withColumn("ends_on", parse_date(F.col("end_text")))
    p = p.withColumn("source_id", F.concat(F.lit("source-profile-"), F.substr("content_hash", F.lit(1), F.lit(12))))
    p = p.withColumn("mandate_id", F.concat_ws("-", F.lit("mandate"), "member_id", "window", "chamber")).withColumn("logo_url", F.get("logo_urls", F.lit(0)))
    p = cut_lineage(p)  # read by every table
    dated = ["member_id", "starts_on", "ends_on", "source_id", "position"]
    status = F.when(F.col("ends_on").isNotNull() | (F.col("w_e") < F.to_date(F.lit(today))), "ended").otherwise("active")

    def links(column: str, *more: str) -> DataFrame:
        rows = p.select("year", "chamber", "window", *dated, *more, F.explode(column).alias("x"))
        return rows.withColumn("label", clean(F.col("x.label"))).withColumn("url", F.col("x.url")).where("label <> ''")

    # written, so that the rules run once a link and not once a column
    about = cut_lineage(links("party_links", "logo_url").withColumn("known", cl.party_of(F.col("label"))))
    formation, formation_short = _formation(F.col("label"), F.col("year"))
    about = about.withColumn("party_id", F.coalesce(F.concat(F.lit("party-"), "known"), formation))
    held = cut_lineage(links("group_links", "logo_url").withColumn("known", cl.party_of(F.col("label"))).withColumn("short_name", cl.group_short_name(F.col("label"))))
    number = F.coalesce(_none(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)[?&]idg=([^&]+)", 1)), "label")
    named = F.coalesce("known", F.when(F.col("label").rlike("(?i)neafili"), "unaffiliated"), slug(F.concat_ws("-", "window", number)))
    held = held.withColumn("group_id", F.concat_ws("-", F.lit("group"), "chamber", named))
    known_parties = held.where("known IS NOT NULL").select(F.concat(F.lit("party-"), "known").alias("id"), F.upper("known").alias("short_name"), F.upper("known").alias("name"), "position")
    parties = about.select(F.col("party_id").alias("id"), F.coalesce(F.upper("known"), formation_short).alias("short_name"), F.coalesce(F.upper("known"), "label").alias("name"), "position")
    said = _none(clean(F.regexp_extract(clean(F.coalesce("validation_text", F.lit(""))), r"(?iu)inlocuieste pe:\s*(.+?)(?:\s+data incetarii|\s+data încetării|$)", 1)))
    given = clean(F.coalesce("related_name", F.lit("")))
    related = F.when(_is_name(given), given).when(_is_name(said), said)
    own = F.col("related_key") != F.col("profile_key")
    keys = p.groupBy(F.col("profile_key").alias("other_key"), F.col("legislature_id").alias("other_window"), F.col("chamber").alias("other_chamber")).agg(
        F.max_by("member_id", "position").alias("related_member_id"))
    replaced = p.where(F.col("related_name").isNotNull() | F.col("related_key").isNotNull()).withColumn("related", related).where("related IS NOT NULL").join(
        keys, own & (F.col("related_key") == F.col("other_key")) & (F.col("legislature_id") == F.col("other_window")) & (F.col("chamber") == F.col("other_chamber")), "left")
    child = lambda kind, what: F.concat_ws("-", F.lit(kind), "member_id", what, F.col("starts_on").cast("string")).alias("id")
    committees = links("committee_links")
    return {
        "sources": _last(p.select(F.col("source_id").alias("id"), F.col("url").alias("source_url"), "content_hash", F.when(F.col("http_status") == 200, "parsed").otherwise("partial").alias("status"), "position")),
        "parties": _last(parties.unionByName(known_parties)),
        "groups": _last(held.select(F.col("group_id").alias("id"), F.concat(F.lit("party-"), "known").alias("party_id"), "chamber", "short_name", F.col("label").alias("name"), "position")),
        "members": _last(p.select(F.col("member_id").alias("id"), slug(F.col("name")).alias("slug"), *_names(F.col("name")), "profile_key", "position")),
        "mandates": _last(p.select(F.col("mandate_id").alias("id"), "member_id", "legislature_id", "chamber", "starts_on", "ends_on", _none(clean(F.col("constituency"))).alias("constituency"), status.alias("status"), "source_id", "position")),
        "mandate_relations": _last(replaced.select(
            F.concat_ws("-", F.lit("mandate-relation"), "mandate_id", F.lit("replaces"), slug(F.col("related"))).alias("id"), "mandate_id", "member_id", "related_member_id",
            _capitalised(F.col("related")).alias("related_name"), F.when(own, F.col("related_url")).alias("related_url"), "position")),
        "memberships": _last(held.select(child("group-membership", "group_id"), "group_id", "logo_url", *dated)),
        "affiliations": _last(about.select(child("party-affiliation", "party_id"), "party_id", "logo_url", *dated)),
        "committees": _last(committees.select(child("committee-membership", slug(F.col("label"))), F.col("label").alias("committee_name"), "chamber", *dated)),
    }


def fallback_tables(rows: DataFrame, legislatures: DataFrame) -> dict[str, DataFrame]:
    """Roster rows of a secondary source as six tables, each row once by id, the first counts.

    rows(position, chamber, legislature_id, name, normalized_name, constituency,
    party_label, party_key, source_id): party_key is a canonical party or null.
    Members whose names agree within a chamber and window are numbered from the
    second on, in the order of ``position``. All rows cover their whole window.
    """
    w = legislatures.select(F.col("id").alias("legislature_id"), F.substr("label", F.lit(1), F.lit(4)).alias("year"), "starts_on", "ends_on")
    label = F.coalesce(_none(clean(F.coalesce("party_label", F.lit("")))), F.lit("Necunoscut"))
    r = rows.join(w, "legislature_id").withColumn("label", label)
    base = F.coalesce(_none(slug(F.col("normalized_name"))), slug(F.col("name")))
    r = r.withColumn("base", F.concat_ws("-", F.lit("member"), "chamber", F.lit("secondary"), "year", base))
    r = number_slugs(r, "base", "position", by="n").withColumnRenamed("unique_slug", "member_id")
    ending = F.substr("member_id", F.length("base") + 1)
    short = F.when(F.col("party_key").isNotNull(), F.upper("party_key")).when(F.col("label") == "—", "Necunoscut").when(
        F.col("label").rlike("(?i)independent|neafili"), "Neafiliați").otherwise(truncate(F.col("label"), 40))
    r = r.withColumn("short_name", short)
    key = F.when(F.col("label").rlike(UNALIGNED), "unaffiliated").otherwise(F.coalesce("party_key", slug(F.col("short_name"))))
    r = r.withColumn("group_id", F.concat_ws("-", F.lit("group"), "chamber", key)).withColumn("party_id", F.concat(F.lit("party-"), "party_key"))
    dated = ["member_id", "starts_on", "ends_on", "source_id", "position"]
    child = lambda kind, *what: F.concat_ws("-", F.lit(kind), "member_id", *what, "legislature_id").alias("id")
    shown = F.when(F.col("party_key").isNotNull(), F.concat(F.lit("Grup parlamentar "), "short_name")).otherwise(F.col("label"))
    public = F.concat(slug(F.col("name")), F.lit("-"), "chamber", F.lit("-sec-"), "year", ending)
    return {
        "parties": _first(r.where("party_id IS NOT NULL").select(F.col("party_id").alias("id"), "short_name", "position")),
        "groups": _first(r.select(F.col("group_id").alias("id"), "party_id", "chamber", "short_name", shown.alias("name"), "position")),
        "members": _first(r.select(F.col("member_id").alias("id"), public.alias("slug"), *_names(F.col("name")), "position")),
        "mandates": _first(r.select(F.concat_ws("-", F.lit("mandate"), "member_id", "legislature_id", "chamber").alias("id"), "legislature_id", "chamber", F.lit("ended").alias("status"), "constituency", *dated)),
        "memberships": _first(r.select(child("group-membership", "group_id"), "group_id", *dated)),
        "affiliations": _first(r.where("party_id IS NOT NULL").select(child("party-affiliation", "party_id"), "party_id", *dated)),
    }


def group_counts(memberships: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(group_id, expected, parsed, agrees) per group; expected(group_id, expected)
    may name groups that were not found and leave out groups that were."""
    parsed = memberships.groupBy("group_id").agg(F.count(F.lit(1)).alias("parsed"))
    if expected is None:
        return parsed.select("group_id", F.lit(0).cast("long").alias("expected"), "parsed", F.lit(None).cast("boolean").alias("agrees"))
    both = parsed.join(expected.select("group_id", F.col("expected").cast("long").alias("expected")), "group_id", "full_outer")
    return both.select("group_id", "expected", F.coalesce("parsed", F.lit(0)).alias("parsed")).withColumn("agrees", F.col("expected") == F.col("parsed"))


def diagnosed(tables: dict[str, DataFrame]) -> DataFrame:
    """(warning, rows): mandates without a constituency and labels kept as historical formations."""
    missing = tables["mandates"].where("constituency IS NULL").agg(F.count(F.lit(1)).alias("rows")).withColumn("warning", F.lit("missing_constituency"))
    formations = tables["parties"].where(F.col("id").startswith("party-formation-")).agg(F.count(F.lit(1)).alias("rows")).withColumn("warning", F.lit("historical_formation"))
    return missing.unionByName(formations).where("rows > 0").select("warning", "rows")


def load_tables(stored: dict[str, DataFrame], incoming: dict[str, DataFrame], children: Sequence[str], parent: str = "member_id") -> dict[str, DataFrame]:
    """The stored tables after a load: rows replace rows of their id; in the
    ``children`` tables the rows of every incoming parent go first, so that none
    is left that the load does not bring."""
    loaded = {}
    parents = incoming["members"].select(F.col("id").alias(parent))
    for name, rows in incoming.items():
        held = stored.get(name, rows.where(F.lit(False)))
        if name in children:
            held = held.join(parents, parent, "left_anti").select(*held.columns)
        loaded[name] = upsert(held, rows, ["id"])
    return {**stored, **loaded}


def merge_nested(
    parents: DataFrame, children: DataFrame, incoming: DataFrame, key: str, nested: str, child_id: Callable[[], Column], link: str,
    order: str, replace: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Parents with nested children merged into two tables, in one version.

    incoming(key, parent columns, ``nested``: array of structs, ``order``): the
    last row of a key counts, children included. A child's id is built by
    ``child_id`` from ``link`` (its parent's key after the merge) and its own
    fields; of equal ids the last one counts. With ``replace`` the children of
    incoming parents that the load does not bring are deleted; children whose
    parent is in neither table always are.
    """
    fresh = last_wins(incoming, [key], [order])
    merged = upsert(parents, fresh, [key])
    flat = fresh.select(F.col(key).alias(link), F.posexplode(nested).alias("__n", "x")).select(link, "__n", "x.*").withColumn("id", child_id())
    flat = last_wins(flat, ["id"], ["__n"]).drop("__n")
    held = replace_children(children, flat, link, fresh.select(F.col(key).alias(link))) if replace else upsert(children, flat, ["id"])
    return merged, held.join(merged.select(F.col(key).alias(link)), link, "left_semi").select(*children.columns)


def tagged(tables: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Tables as one long table, tagged by name; columns a table lacks are null."""
    long = None
    for name, rows in tables.items():
        part = rows.select(F.lit(name).alias("table"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in columns])
        long = part if long is None else long.unionByName(part)
    return long
