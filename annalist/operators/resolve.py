"""Entity resolution: reconciliation, candidate joins, fuzzy match, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.identifiers import identifier_values, link_keys
from annalist.functions.text import compact, loose_token_key, match_words, token_key, words
from annalist.functions.urls import match_url
from annalist.operators.sets import top_per_key
from annalist.session import cut_lineage

# Words that say what kind of entity a name is.
BOILERPLATE = (
    "partidul partid politic politica alianta uniunea miscarea frontul national nationala roman romana romaniei "
    "din de si pentru al a ai ale the"
).split()


def strip_boilerplate(text: Column) -> Column:
    kept = F.filter(F.split(match_words(text), " "), lambda w: (F.length(w) > 0) & ~w.isin(*BOILERPLATE))
    return F.array_join(kept, " ")


# --- two-source reconciliation ---------------------------------------------

def reconcile(a: DataFrame, b: DataFrame, scope: str, name: str, attribute: str) -> DataFrame:
    """Match two rosters(id, scope, name, attribute) on the name; what is left
    of ``a`` on the unordered words of the name, where exactly one row of ``b``
    has them. Rows: matched, mismatch (attributes differ), missing_b (only in
    a) and missing_a (only in b)."""
    left = a.select(F.col("id").alias("a_id"), scope, words(F.col(name)).alias("__name"), token_key(F.col(name)).alias("__tokens"),
                    F.col(attribute).alias("a_attr"))
    right = b.select(F.col("id").alias("b_id"), scope, words(F.col(name)).alias("__name"), token_key(F.col(name)).alias("__tokens"),
                     F.col(attribute).alias("b_attr"))
    last = lambda df, key: df.groupBy(scope, key).agg(
        F.max_by(F.struct("b_id", "b_attr"), "b_id").alias("hit"), F.count(F.lit(1)).alias("n"))
    exact = left.join(last(right, "__name"), [scope, "__name"], "left").withColumnRenamed("hit", "e").drop("n")
    single = last(right, "__tokens").where("n = 1").drop("n").withColumnRenamed("hit", "u")
    both = exact.join(single, [scope, "__tokens"], "left").withColumn("hit", F.coalesce("e", "u"))
    differs = F.col("a_attr").isNotNull() & F.col("hit.b_attr").isNotNull() & (F.col("a_attr") != F.col("hit.b_attr"))
    status = F.when(F.col("hit").isNull(), "missing_b").when(differs, "mismatch").otherwise("matched")
    rows = both.select(status.alias("status"), scope, "a_id", F.col("hit.b_id").alias("b_id"))
    names = left.select(scope, "__name").distinct()
    tokens = left.select(scope, "__tokens").distinct()
    only_b = right.join(names, [scope, "__name"], "left_anti").join(tokens, [scope, "__tokens"], "left_anti")
    return rows.unionByName(only_b.select(F.lit("missing_a").alias("status"), scope, F.lit(None).cast(rows.schema["a_id"].dataType).alias("a_id"), "b_id"))


def name_differences(a: DataFrame, b: DataFrame, name: str, samples: int | None = None) -> DataFrame:
    """Names found in one source only, compared without role words or order."""
    key = loose_token_key(F.col(name))
    la, lb = a.select(F.col(name).alias("name"), key.alias("k")), b.select(F.col(name).alias("name"), key.alias("k"))
    only = lambda x, y, side: x.join(y.select("k").distinct(), "k", "left_anti").groupBy("k").agg(
        F.min("name").alias("name")).select(F.lit(side).alias("side"), "k", "name")
    rows = only(la, lb, "left").unionByName(only(lb, la, "right"))
    return rows if samples is None else top_per_key(rows, ["side"], [F.asc("name"), F.asc("k")], samples)


# --- candidate joins --------------------------------------------------------

def without_match(discoveries: DataFrame, ids: DataFrame, urls: DataFrame) -> DataFrame:
    """Discoveries whose official id is not among ids(value) and whose address
    is not among urls(url): two anti joins, not one join on either key."""
    left = discoveries.withColumn("__url", match_url(F.col("source_url")))
    seen = urls.select(match_url(F.col("url")).alias("__url")).distinct()
    return left.join(ids.select(F.col("value").alias("official_id")).distinct(), "official_id", "left_anti").join(
        seen, "__url", "left_anti").drop("__url").select(*discoveries.columns)


def urls_of(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct source addresses per row, from links(id, source_id): one row
    per address, null for an id without any. Long form, as a busy id may have
    very many."""
    s = sources.select(F.col("id").alias("source_id"), "source_url")
    found = links.join(s, "source_id").select("id", "source_url").distinct()
    none = links.select("id").distinct().join(found, "id", "left_anti")
    return found.unionByName(none.withColumn("source_url", F.lit(None).cast("string")))


def linked_candidates(texts: DataFrame, bills: DataFrame, identifiers: Sequence[str], k: int = 5) -> DataFrame:
    """Up to ``k`` bills per text(id, text) that carry an identifier found in it."""
    # outer: a plain explode would evaluate the patterns twice
    found = texts.select(F.col("id").alias("text_id"), F.explode_outer(link_keys(F.col("text"))).alias("key")).where(F.col("key").isNotNull())
    carried = bills.select(
        F.col("id").alias("bill_id"),
        F.explode(F.array_compact(F.array(*[F.replace(F.regexp_replace(F.lower(c), r"\s+", ""), F.lit("plx"), F.lit("pl-x")) for c in identifiers]))).alias("key"),
    ).distinct()
    pairs = found.join(carried, "key").select("text_id", "bill_id").distinct()
    return top_per_key(pairs, ["text_id"], [F.asc("bill_id")], k)


def text_candidates(texts: DataFrame, bills: DataFrame, identifiers: Sequence[str], shortest: int = 24, prefix: int = 80, detail: bool = False) -> DataFrame:
    """Bills named in each text(id, text): by identifier, or because the first
    ``prefix`` folded characters of a title longer than ``shortest`` occur in it.
    With ``detail`` also the first of the bill's identifiers that the text has.

    Titles are blocked on their rarest inner word (an occurrence may cut the
    first and last word); a title with no inner word is blocked on each word
    that contains its only usable piece, found by a join on pieces of words.
    """
    t = texts.select(F.col("id").alias("text_id"), identifier_values(F.col("text")).alias("ids"), words(F.col("text")).alias("folded"))
    carried = bills.select(F.col("id").alias("bill_id"), F.posexplode(F.array_compact(F.array(*identifiers))).alias("nth", "value")).distinct()
    by_id = t.select("text_id", F.explode_outer("ids").alias("value")).where(F.col("value").isNotNull()).join(carried, "value").groupBy("text_id", "bill_id").agg(
        F.min_by("value", "nth").alias("detail")).withColumn("reason", F.lit("identifier"))
    b = bills.select(F.col("id").alias("bill_id"), words(F.col("title")).alias("full")).where(F.length("full") > shortest)
    titled = b.select("bill_id", F.substr("full", F.lit(1), F.lit(prefix)).alias("needle"))
    # equal titles are looked up once
    needles = titled.select("needle").distinct().withColumn("parts", F.split("needle", " "))
    inner = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 2, F.lit(0)))
    # words carry a hash of their text; the text itself joins in only to verify
    texts_once = t.select("folded").distinct().withColumn("h", F.xxhash64("folded"))
    tokens = texts_once.select("h", F.explode_outer(F.array_distinct(F.split("folded", " "))).alias("token"))
    heard = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    choices = needles.select("needle", F.explode(F.array_distinct(inner)).alias("token")).join(heard, "token", "left")
    rarest = choices.groupBy("needle").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    short = needles.where(F.size("parts") < 3)
    # one or two long words: the longer one is a piece of some word of the text
    longest = F.element_at(F.array_sort(F.transform("parts", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    size = shortest // 2
    gram = short.select("needle", F.substr(longest, F.lit(1), F.lit(size)).alias("gram"))
    grams = heard.where(F.length("token") >= size).select(
        "token", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - (size - 1)), lambda i: F.substr("token", i, F.lit(size)))).alias("gram"))
    blocks = rarest.unionByName(gram.join(grams.distinct(), "gram").select("needle", "token"))
    maybe = blocks.join(tokens, "token").select("needle", "h").distinct()
    found = maybe.join(texts_once, "h").where(F.col("folded").contains(F.col("needle"))).select("needle", "folded").distinct()
    by_title = titled.join(found, "needle").join(t.select("text_id", "folded"), "folded").select("text_id", "bill_id").distinct().join(
        by_id.select("text_id", "bill_id"), ["text_id", "bill_id"], "left_anti")
    found_by = by_id.unionByName(by_title.withColumn("reason", F.lit("title")), allowMissingColumns=True)
    return found_by.select("text_id", "bill_id", "reason", *(["detail"] if detail else []))


def discovery_candidates(discoveries: DataFrame, votes: DataFrame, bills: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """Bill already linked to the vote at a discovery's address, else the bills
    named in its text. votes(source_url, bill_id); discoveries(id, kind,
    source_url, text)."""
    linked = votes.where(F.col("bill_id").isNotNull()).select(match_url(F.col("source_url")).alias("__url"), F.col("bill_id"))
    linked = linked.groupBy("__url").agg(F.min("bill_id").alias("bill_id"))
    direct = discoveries.where("kind = 'vote'").withColumn("__url", match_url(F.col("source_url"))).join(linked, "__url").select(
        F.col("id").alias("text_id"), "bill_id", F.lit("linked vote").alias("reason"))
    rest = discoveries.join(direct.select(F.col("text_id").alias("id")), "id", "left_anti")
    return direct.unionByName(text_candidates(rest, bills, identifiers))


def strong_link(proposals: DataFrame, texts: DataFrame, bills: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """Decide proposed(vote_id, bill_id, current_bill_id) links: blocked when
    the vote is linked to another bill, linked on a shared identifier, else
    held back."""
    keys = texts.select(F.col("id").alias("vote_id"), link_keys(F.col("text")).alias("tk"))
    carried = bills.select(F.col("id").alias("bill_id"), F.array_compact(F.array(
        *[F.replace(F.regexp_replace(F.lower(c), r"\s+", ""), F.lit("plx"), F.lit("pl-x")) for c in identifiers])).alias("bk"))
    joined = proposals.join(keys, "vote_id").join(carried, "bill_id").withColumn("shared", F.size(F.array_intersect("tk", "bk")))
    status = F.when(F.col("current_bill_id").isNotNull() & (F.col("current_bill_id") != F.col("bill_id")), "blocked_relink").when(
        F.col("shared") > 0, "linked").otherwise("weak_evidence")
    return joined.select("vote_id", "bill_id", "shared", status.alias("status"))


# --- duplicates -------------------------------------------------------------

def duplicate_rows(entries: DataFrame, key: str, ident: str) -> DataFrame:
    """Every row whose key others carry too: (key, rows, id), a row per id, so
    no key's ids are gathered."""
    return duplicate_keys(entries, key, ident).join(entries.select(key, ident), key)


def duplicate_keys(entries: DataFrame, key: str, ident: str, samples: int | None = None, skip_unknown: bool = False) -> DataFrame:
    """Keys carried by more than one row, with the count and up to ``samples``
    row ids. Counts come from an aggregate; only sampled ids are gathered."""
    rows = entries.where(F.col(key).isNotNull() & (F.col(key) != ""))
    if skip_unknown:
        rows = rows.where(~F.col(key).contains("unknown") & ~F.col(key).endswith("|"))
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if samples is None:
        return many
    sampled = top_per_key(rows.join(many.select(key), key, "left_semi").select(key, ident), [key], [F.asc(ident)], samples)
    listed = sampled.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(ident)), lambda x: x.cast("string")), ",").alias("ids"))
    return many.join(listed, key)


def fingerprint(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("unknown")) for p in parts])


# --- labels -----------------------------------------------------------------

def merge_labels(rows: DataFrame) -> DataFrame:
    """rows(kind, entity_id, label, member_count, row_count, legislatures,
    chambers) merged by folded label: one kind or 'mixed', the most used label,
    and counts summed over the greatest per entity."""
    keyed = rows.withColumn("key", words(F.col("label"))).where(F.trim("label") != "")
    per_entity = keyed.groupBy("key", "entity_id").agg(F.max("member_count").alias("m"), F.max("row_count").alias("r"))
    sums = per_entity.groupBy("key").agg(F.sum("m").alias("member_count"), F.sum("r").alias("row_count"), F.count(F.lit(1)).alias("entities"))
    # sets of windows and chambers are small; labels and ids are not gathered
    about = keyed.groupBy("key").agg(
        F.min("kind").alias("lo"), F.max("kind").alias("hi"),
        F.max_by("label", F.struct("member_count", "label")).alias("label"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("legislatures")))).alias("legislatures"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("chambers")))).alias("chambers"))
    return about.join(sums, "key").select(
        "key", "label", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("kind"), "entities",
        "member_count", "row_count", F.array_join(F.reverse("legislatures"), ",").alias("legislatures"), F.array_join("chambers", ",").alias("chambers"))


# --- scored match -----------------------------------------------------------

def score_names(registry: DataFrame, candidates: DataFrame, most: int | None = None) -> DataFrame:
    """Score registry(id, legal_name, short_name) against candidates(id, names:
    array). Tiers: legal name 96; short name 100, or 88 when it is at most
    three characters; compact form 94 or 88; without boilerplate 84; else the
    share of common words times 80, with at least two in common.

    Every tier is an equi join on a derived key, and the word tier meets only
    names that share words; no pair is formed without a common key. Equal names
    are scored once; their rows join the scores, and only an id with several names
    is aggregated behind that. ``most``: the first so many of an id, best score first.
    """
    named = registry.select(
        F.col("id").alias("r_id"), match_words(F.col("legal_name")).alias("legal"), match_words(F.coalesce("short_name", F.lit(""))).alias("short")).distinct()
    listed = lambda made: F.array_distinct(F.filter(F.array(made(F.col("short")), made(F.col("legal"))), lambda x: x != ""))
    r = named.select("legal", "short").distinct().withColumn("compacts", listed(compact)).withColumn("strips", listed(strip_boilerplate))
    form = ["legal", "short"]
    c = candidates.select(F.col("id").alias("c_id"), F.explode("names").alias("name"))
    forms = lambda made, alias: c.select("c_id", made.alias(alias)).where(F.col(alias) != "").distinct()
    normal, packed, bare = forms(match_words(F.col("name")), "k"), forms(compact(F.col("name")), "k"), forms(strip_boilerplate(F.col("name")), "k")
    short_form = F.replace(F.col("short"), F.lit(" "))
    shortest = F.array_min(F.transform("compacts", lambda x: F.length(x)))
    tiers = [
        r.select(*form, F.col("legal").alias("k"), F.lit(1).alias("tier"), F.lit(96).alias("score"), F.lit("exact_label_or_name").alias("reason")).join(normal, "k"),
        r.select(*form, F.col("short").alias("k"), F.lit(2).alias("tier"), F.when(F.length(short_form) <= 3, 88).otherwise(100).alias("score"),
                 F.when(F.length(short_form) <= 3, "exact_short_name_needs_review").otherwise("exact_short_name").alias("reason")).join(normal, "k"),
        r.select(*form, F.explode("compacts").alias("k"), F.lit(3).alias("tier"), F.when(shortest <= 3, 88).otherwise(94).alias("score"),
                 F.when(shortest <= 3, "exact_compact_label_needs_review").otherwise("exact_compact_label").alias("reason")).join(packed, "k"),
        r.select(*form, F.explode("strips").alias("k"), F.lit(4).alias("tier"), F.lit(84).alias("score"), F.lit("exact_boilerplate_stripped").alias("reason")).join(bare, "k"),
    ]
    # equal bare names are scored once, whatever the number of rows behind them
    left = r.select(F.explode("strips").alias("l")).distinct().withColumn("lw", F.array_distinct(F.split("l", " ")))
    right = bare.select(F.col("k").alias("o")).distinct().withColumn("ow", F.array_distinct(F.split("o", " ")))
    # Prefix filter, exact: two names with two words in common share a pair of
    # words, so the pair is the join key and no single frequent word is.
    pairs_of = lambda w: F.flatten(F.transform(F.array_sort(w), lambda x, i: F.transform(
        F.slice(F.array_sort(w), i + 2, F.size(w)), lambda y: F.concat_ws(" ", x, y))))
    met = left.select("l", "lw", F.explode(pairs_of(F.col("lw"))).alias("pair")).join(
        right.select("o", "ow", F.explode(pairs_of(F.col("ow"))).alias("pair")), "pair").select("l", "lw", "o", "ow").distinct()
    share = F.floor(F.size(F.array_intersect("lw", "ow")) / F.greatest(F.size("lw"), F.size("ow")) * 80).cast("int")
    scored = met.select("l", "o", share.alias("score"))
    tiers.append(
        r.select(*form, F.explode("strips").alias("l")).join(scored, "l").join(bare.select("c_id", F.col("k").alias("o")), "o")
        .groupBy(*form, "c_id").agg(F.max("score").alias("score"))
        .select(*form, "c_id", F.lit(5).alias("tier"), "score", F.lit("token_overlap").alias("reason")))
    columns = [*form, "c_id", "tier", "score", "reason"]
    every = tiers[0].select(*columns)
    for tier in tiers[1:]:
        every = every.unionByName(tier.select(*columns))
    best = F.min_by(F.struct("tier", "score", "reason"), "tier").alias("b")
    once = every.groupBy(*form, "c_id").agg(best).where("b.score > 0").select(F.col("legal").alias("__l"), F.col("short").alias("__s"), "c_id", "b")
    counted = named.withColumn("__forms", F.count(F.lit(1)).over(Window.partitionBy("r_id")))
    same = F.col("legal").eqNullSafe(F.col("__l")) & (F.col("short") == F.col("__s"))
    order = [F.desc("score"), F.asc("c_id")]
    first = once if most is None else top_per_key(once.withColumn("score", F.col("b.score")), ["__l", "__s"], order, most).drop("score")
    single = counted.where("__forms = 1").join(first, same).select("r_id", "c_id", "b.score", "b.reason")
    several = counted.where("__forms > 1").join(once, same).groupBy("r_id", "c_id").agg(F.min_by("b", "b.tier").alias("b")).select("r_id", "c_id", "b.score", "b.reason")
    return single.unionByName(several if most is None else top_per_key(several, ["r_id"], order, most))


def decide(registry: DataFrame, scored: DataFrame, k: int = 5) -> DataFrame:
    """Best score, decision (auto from 92, review from 65) and top ``k``."""
    top = top_per_key(scored, ["r_id"], [F.desc("score"), F.asc("c_id")], k)
    listed = top.groupBy("r_id").agg(
        F.max("score").alias("best"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "c_id"))), lambda x: x["c_id"].cast("string")), ",").alias("matches"))
    joined = registry.select(F.col("id").alias("r_id")).join(listed, "r_id", "left")
    best = F.coalesce("best", F.lit(0))
    return joined.select("r_id", best.alias("best_score"), F.when(best >= 92, "auto_match").when(best >= 65, "needs_review").otherwise("no_match").alias("status"),
                         F.coalesce("matches", F.lit("")).alias("matches"))


# --- connected components ---------------------------------------------------

def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node of each connected component.

    Alternating star contraction. Each round is two aggregates and joins, so a
    node with a third of all edges is combined before the shuffle, and each
    round's edges are written out. Only a count and a checksum reach the driver.
    """
    current = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v")
    current = cut_lineage(_oriented(current))
    seen = None
    while True:
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if seen == (state["n"], state["h"]):
            break
        seen = (state["n"], state["h"])
        current = cut_lineage(_small_star(_large_star(current)))
    labelled = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    everyone = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    if nodes is not None:
        everyone = everyone.union(nodes)
    return everyone.distinct().join(labelled, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour to the least neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect the node and its smaller neighbours to the least of them."""
    down = _oriented(edges)
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _person_key(component: Column) -> Column:
    return F.concat(F.lit("person-"), F.substr(F.sha1(component.cast("string").cast("binary")), F.lit(1), F.lit(12)))


def _flagged(members: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
    have = known.select("node").distinct().withColumn("have", F.lit(True))
    linked = links.select(F.col("dst").alias("node")).distinct().withColumn("linked", F.lit(True))
    return members.join(have, "node", "left").join(linked, "node", "left")


def person_candidates(members: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
    """Per component: size, least name, profiles already imported and linked
    profiles not imported. members(component, node, name); known(node);
    links(src, dst)."""
    return _flagged(members, known, links).groupBy("component").agg(
        F.count(F.lit(1)).alias("profiles"), F.min("name").alias("name"), F.count("have").alias("imported"),
        F.count(F.when(F.col("linked") & F.col("have").isNull(), 1)).alias("missing_linked"),
    ).withColumn("person_key", _person_key(F.col("component")))


def person_candidate_keys(members: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
    """(person_key, role, value): the names of each component, its imported
    profiles and its linked profiles that are not imported, a row each, so that no
    component is gathered."""
    rows = _flagged(members, known, links).withColumn("person_key", _person_key(F.col("component")))
    tag = lambda kept, role, value: kept.select("person_key", F.lit(role).alias("role"), F.col(value).cast("string").alias("value"))
    return tag(rows.select("person_key", "name").distinct(), "name", "name").unionByName(tag(rows.where("have"), "imported", "node")).unionByName(
        tag(rows.where("linked AND have IS NULL"), "missing_linked", "node"))
