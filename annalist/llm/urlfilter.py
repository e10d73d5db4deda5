"""Allow and block rules for URLs: a blocked Bloom filter in front of a hash join.

A rule is a host and a path prefix. The keys of a URL are all pairs of a suffix
of its host (at label boundaries) and a prefix of its path whose length occurs
among the rules. Keys go through a blocked Bloom filter of the listed rules: one
64-bit block per key, so one look-up answers. Only keys that pass are joined
with the rules, and the join is exact, so a false positive of the filter costs
a join row and never a verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Slots over which a rule is joined.
SLOTS = 16


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower
    case. Empty for null or without ``://``."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end. Empty like the host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (rule, verdict) cut at the first slash into host (lower case)
    and path. Rules without a host are left out. Of rules named twice, a block
    goes before an allow."""
    at = F.instr("rule", "/")
    return (
        rules.where(F.col("rule").isNotNull())
        .select(
            F.translate(F.when(at > 0, F.substring("rule", 1, at - 1)).otherwise(F.col("rule")), UPPER, LOWER).alias("host"),
            F.when(at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("path"),
            F.col("verdict"),
        )
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks)).cast("int")


def _bits(key: Column, hashes: int) -> Column:
    """The bits of a key within its block."""
    each = (F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64)).cast("int")) for i in range(hashes))
    return reduce(lambda a, b: a.bitwiseOR(b), each)


def bloom_blocks(keys: DataFrame, blocks: int, hashes: int) -> str:
    """The filter of the listed keys (column ``key``) as text: its non-empty
    blocks, combined map-side. At most ``blocks`` numbers reach the driver,
    however long the list is."""
    made = keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("key"), hashes)).alias("bits"))
    filled = {row.block: row.bits for row in made.collect()}
    return ",".join(str(filled.get(i, 0)) for i in range(blocks))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    identity: str = "page_id",
    url: str = "url",
    otherwise: str = "allow",
    blocks: int = 4096,
    hashes: int = 4,
) -> DataFrame:
    """One row per row of ``pages``: the identity, host, path, the rule that
    decides (null if none) and the verdict (``otherwise`` if none).

    A rule fits its host and all subdomains if the path starts with its path.
    The longest rule wins; of equally long ones the first by text. Null URLs and
    URLs without ``://`` have an empty host and path and no rule. Repeated rows
    are judged each; other columns of ``pages`` are not read. Empty rules leave
    everything to ``otherwise``.

    ``blocks`` words of 64 bits are the filter's whole size, on the driver and
    in each task (32 kB by default); a list that is long for it passes more keys
    on to the join, which stays exact.
    """
    listed = canonical_rules(rules).withColumn("key", F.xxhash64("host", "path"))
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())  # path lengths that occur: bounded by the longest rule
    bloom = F.split(F.lit(bloom_blocks(listed, blocks, hashes)), ",").cast("array<bigint>")
    seen = pages.select(
        F.col(identity).alias("__id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.monotonically_increasing_id().alias("__row")
    )
    # suffixes of the host at label boundaries, the host itself first
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.struct(h.alias("host"), F.substring(F.col("path"), F.lit(1), n).alias("path")))))
    keyed = F.transform(pairs, lambda p: F.struct(p["host"].alias("host"), p["path"].alias("path"), F.xxhash64(p["host"], p["path"]).alias("key")))
    possible = F.filter("keyed", lambda p: F.get("bloom", _block(p["key"], blocks)).bitwiseAND(_bits(p["key"], hashes)) == _bits(p["key"], hashes))
    hits = (
        seen.withColumn("keyed", keyed)
        .withColumn("bloom", bloom)
        .select("__id", "host", "path", "__row", F.explode_outer(possible).alias("hit"))
    )
    # hits of one rule may be a third of all rows, and rows without a hit are many:
    # both are dealt to slots by row, rules go to all of them
    slot = F.pmod("__row", F.lit(SLOTS)).cast("int")
    hits = hits.withColumn("__slot", F.when(F.col("hit").isNull(), -1 - F.pmod("__row", F.lit(1 << 20)).cast("int")).otherwise(slot))
    hits = hits.withColumn("__hit_host", F.coalesce("hit.host", F.lit(""))).withColumn("__hit_path", F.coalesce("hit.path", F.lit("")))
    ruled = listed.select(F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("__in"), F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("verdict").alias("__verdict"), F.concat("host", "path").alias("__rule"))
    matched = hits.join(ruled, (F.col("__slot") == F.col("__in")) & (F.col("__hit_host") == F.col("__host")) & (F.col("__hit_path") == F.col("__path")), "left")
    order = F.when(F.col("__rule").isNotNull(), F.struct(-F.length("__rule"), F.col("__rule")))
    # a URL's keys are a handful, so the winner is an aggregate with map-side combine
    won = matched.groupBy("__row", "__id", "host", "path").agg(F.min_by(F.struct("__rule", "__verdict"), order).alias("won"))
    return won.select(
        F.col("__id").alias(identity),
        "host",
        "path",
        F.col("won.__rule").alias("rule"),
        F.coalesce("won.__verdict", F.lit(otherwise)).alias("verdict"),
    )
