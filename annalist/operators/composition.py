"""Point-in-time composition of chambers and its governance alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.intervals import active_on, days_inclusive
from annalist.operators.ranges import join_overlapping

COMPUTED = "computed_vote_support"


def active_mandates(stops: DataFrame, mandates: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of stops(stop_id, as_of) and mandates active on that day; a
    mandate ends with its window at the latest."""
    w = windows.select(F.col("id").alias("legislature_id"), F.col("ends_on").alias("__we"))
    m = mandates.join(w, "legislature_id", "left").withColumn("m_e", F.least("ends_on", "__we"))
    m = m.select(F.col("id").alias("mandate_id"), "member_id", "chamber", F.col("starts_on").alias("m_s"), "m_e")
    s = stops.select("stop_id", F.col("as_of").alias("s_s"), F.col("as_of").alias("s_e"))
    return join_overlapping(m, s, [], ("m_s", "m_e"), ("s_s", "s_e")).select(
        "stop_id", F.col("s_s").alias("as_of"), "mandate_id", "member_id", "chamber")


def best_at_stops(
    stops: DataFrame, intervals: DataFrame, keys: Sequence[str], span: tuple[str, str], take: Sequence[str], rank: Sequence[str]
) -> DataFrame:
    """Per (stop, key): ``take`` of the greatest-``rank`` interval active then.

    The stops are looked up, not the seats, so the seats are read once."""
    s = stops.select("stop_id", F.col("as_of").alias("d_s"), F.col("as_of").alias("d_e"))
    return join_overlapping(intervals, s, [], span, ("d_s", "d_e")).groupBy("stop_id", *keys).agg(
        F.max_by(F.struct(*take), F.struct(*rank)).alias("__best")
    ).select("stop_id", *keys, *[F.col(f"__best.{c}").alias(c) for c in take])


def with_group(seats: DataFrame, stops: DataFrame, memberships: DataFrame, groups: DataFrame) -> DataFrame:
    """Latest membership on the day, in a group of the seat's chamber."""
    g = groups.select(F.col("id").alias("group_id"), "party_id", F.col("short_name").alias("group_name"), "chamber")
    ms = memberships.join(g, "group_id").select(
        "member_id", "chamber", F.col("id").alias("ms_id"), "group_id", "party_id", "group_name",
        F.col("starts_on").alias("ms_s"), F.col("ends_on").alias("ms_e"))
    best = best_at_stops(stops, ms, ["member_id", "chamber"], ("ms_s", "ms_e"), ["group_id", "party_id", "group_name"], ["ms_s", "ms_id"])
    return seats.join(best, ["stop_id", "member_id", "chamber"], "left")


def _usable(alignments: DataFrame, mode: str) -> DataFrame:
    computed = F.col("basis") == COMPUTED
    return alignments.where(computed if mode == "computed" else ~computed)


def resolve_alignment(
    seats: DataFrame, stops: DataFrame, member: DataFrame, group: DataFrame, party: DataFrame, mode: str = "official"
) -> DataFrame:
    """Alignment of the member, else the group, else the party on the day; in
    official mode 'opposition' where that day has any official alignment and
    the seat has a party or group, else 'unknown'. Inputs: (id, target_id,
    starts_on, ends_on, alignment, basis)."""
    out, found = seats, []
    for rows, target in ((member, "member_id"), (group, "group_id"), (party, "party_id")):
        usable = _usable(rows, mode).select(
            F.col("target_id").alias(target), F.col("id").alias("a_id"), F.col("starts_on").alias("a_s"),
            F.col("ends_on").alias("a_e"), F.struct("alignment", "basis").alias(f"by_{target}"))
        best = best_at_stops(stops, usable, [target], ("a_s", "a_e"), [f"by_{target}"], ["a_s", "a_id"])
        out = out.join(best, ["stop_id", target], "left")
        found.append(f"by_{target}")
    hit = F.coalesce(*[F.col(c) for c in found])
    default, basis = F.lit("unknown"), F.lit("unknown")
    if mode == "official":
        days = stops.select("stop_id", F.col("as_of").alias("d_s"), F.col("as_of").alias("d_e"))
        known = None
        for rows in (member, group, party):
            part = _usable(rows, mode).select(F.col("starts_on").alias("k_s"), F.col("ends_on").alias("k_e"))
            known = part if known is None else known.unionByName(part)
        covered = join_overlapping(days, known.distinct(), [], ("d_s", "d_e"), ("k_s", "k_e")).select(
            "stop_id", F.lit(True).alias("__known")).distinct()
        out = out.join(covered, "stop_id", "left")
        opposed = F.coalesce(F.col("__known"), F.lit(False)) & (F.col("group_id").isNotNull() | F.col("party_id").isNotNull())
        default = F.when(opposed, "opposition").otherwise("unknown")
        basis = F.when(opposed, "manual_curation").otherwise("unknown")
    shown = out.withColumn("alignment", F.coalesce(hit["alignment"], default)).withColumn("basis", F.coalesce(hit["basis"], basis))
    return shown.drop(*found, "__known")


def cap_seats(seats: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Official number of seats per chamber, in (group, name, id) order; a
    seat without a group comes last. Only chambers with a count are seated."""
    ordered = [F.coalesce("group_name", F.lit("zzzz")).asc(), F.col("display_name").asc(), F.col("mandate_id").asc()]
    rank = F.row_number().over(Window.partitionBy("stop_id", "chamber").orderBy(*ordered))
    own = F.lit(0)
    for chamber, number in counts.items():
        own = F.when(F.col("chamber") == chamber, F.lit(number)).otherwise(own)
    # the literal bound lets Spark cut each chamber's rows before the shuffle
    return seats.withColumn("__rn", rank).where(F.col("__rn") <= max(counts.values())).where(F.col("__rn") <= own).drop("__rn")


def composition(
    stops: DataFrame, mandates: DataFrame, windows: DataFrame, members: DataFrame, memberships: DataFrame, groups: DataFrame,
    member_align: DataFrame, group_align: DataFrame, party_align: DataFrame, counts: dict[str, int], mode: str = "official",
) -> DataFrame:
    """Seats of every stop at once: group, party and alignment on its day."""
    named = active_mandates(stops, mandates, windows).join(
        members.select(F.col("id").alias("member_id"), "display_name"), "member_id")
    seated = with_group(named, stops, memberships, groups)
    return cap_seats(resolve_alignment(seated, stops, member_align, group_align, party_align, mode), counts)


def group_summary(seats: DataFrame) -> DataFrame:
    """Seats and most common alignment per group; of equally common ones the
    one seen first in name order."""
    keys = ["stop_id", "chamber", "group_id"]
    counted = seats.where(F.col("group_id").isNotNull()).groupBy(*keys, "alignment").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("display_name", "mandate_id")).alias("seen"))
    return counted.groupBy(*keys).agg(
        F.sum("n").alias("seats"), F.min_by("alignment", F.struct(-F.col("n"), F.col("seen"))).alias("alignment"))


def window_stops(windows: DataFrame, mandates: DataFrame, as_of: str) -> DataFrame:
    """One stop per window: ``as_of`` when it lies inside, else the latest of
    the window's start and each chamber's first mandate."""
    today = F.to_date(F.lit(as_of))
    firsts = mandates.groupBy("legislature_id", "chamber").agg(F.min("starts_on").alias("__f")).groupBy("legislature_id").agg(
        F.max("__f").alias("__f"))
    joined = windows.select(F.col("id").alias("legislature_id"), "starts_on", "ends_on").join(firsts, "legislature_id", "left")
    inside = (F.col("starts_on") <= today) & (today < F.col("ends_on"))
    return joined.select(F.col("legislature_id").alias("stop_id"), F.when(inside, today).otherwise(F.greatest("starts_on", "__f")).alias("as_of"))


def prime_minister_days(windows: DataFrame, governments: DataFrame) -> DataFrame:
    """Days per window and prime minister, both ends counted, interim
    governments left out."""
    w = windows.select(F.col("id").alias("legislature_id"), F.col("starts_on").alias("w_s"), F.col("ends_on").alias("w_e"))
    g = governments.where(F.col("prime_minister_id").isNotNull() & ~F.col("name").rlike("(?i)interimar")).select(
        "prime_minister_id", F.col("starts_on").alias("g_s"), F.col("ends_on").alias("g_e"))
    pairs = join_overlapping(g, w, [], ("g_s", "g_e"), ("w_s", "w_e"), b_half_open=True)
    days = days_inclusive(F.greatest("g_s", "w_s"), F.coalesce(F.least("g_e", "w_e"), F.col("w_e")))
    return pairs.groupBy("legislature_id", "prime_minister_id").agg(F.sum(days).alias("days"))


def government_on(facts: DataFrame, governments: DataFrame, on: str) -> DataFrame:
    """Latest government active on each fact's date; the name breaks ties."""
    days = facts.select(F.col(on).alias("__on")).where(F.col("__on").isNotNull()).distinct().select(
        F.col("__on").alias("d_s"), F.col("__on").alias("d_e"))
    g = governments.select(F.col("id").alias("government_id"), F.col("name").alias("government_name"), F.col("starts_on").alias("g_s"), F.col("ends_on").alias("g_e"))
    pairs = join_overlapping(days, g, [], ("d_s", "d_e"), ("g_s", "g_e"))
    best = pairs.groupBy("d_s").agg(
        F.max_by(F.struct("government_id", "government_name"), F.struct("g_s", F.col("government_id"))).alias("__g"))
    return facts.join(best, F.col(on) == F.col("d_s"), "left").select(*[F.col(c) for c in facts.columns], "__g.government_id", "__g.government_name")


def party_alignment_on(facts: DataFrame, on: str, party: str, label: str, alignments: DataFrame) -> DataFrame:
    """Alignment of a party under the government of the day. Facts carry
    government_id. Explicit, else 'opposition' once the government has any
    alignment that day; without a party, by label."""
    a = alignments.select(F.col("government_id").alias("__gid"), F.col("party_id").alias("__pid"), "alignment", "basis",
                          F.col("starts_on").alias("__s"), F.col("ends_on").alias("__e"), F.col("id").alias("__aid"))
    days = facts.select(F.col("government_id").alias("__gid"), F.col(on).alias("__on")).distinct()
    active = days.join(a, "__gid").where(active_on(F.col("__s"), F.col("__e"), F.col("__on")))
    explicit = active.groupBy("__gid", "__on", "__pid").agg(F.min_by(F.struct("alignment", "basis"), "__aid").alias("__hit"))
    curated = active.select("__gid", "__on").distinct().withColumn("__curated", F.lit(True))
    joined = (
        facts.join(explicit, (F.col("government_id") == F.col("__gid")) & (F.col(on) == F.col("__on")) & (F.col(party) == F.col("__pid")), "left")
        .drop("__gid", "__on", "__pid")
        .join(curated, (F.col("government_id") == F.col("__gid")) & (F.col(on) == F.col("__on")), "left").drop("__gid", "__on")
    )
    independent = F.lower(F.col(label)).contains("neafiliat")
    alignment = (
        F.when(F.col(party).isNull(), F.when(independent, "unaffiliated").otherwise("unknown"))
        .when(F.col("__hit").isNotNull(), F.col("__hit.alignment")).when(F.col("__curated"), "opposition").otherwise("unknown")
    )
    return joined.withColumn("alignment", alignment).drop("__hit", "__curated")
