"""Bottom-k fingerprints of documents.

A text's words are its runs of other characters than ASCII white space; its shingles
are the runs of five words in a row, or the whole text if it has one to four
words. The fingerprint is the k smallest distinct 64-bit hashes of the shingles,
as unsigned order would have them (a shift by the sign bit makes signed order the
same). Two fingerprints merge into the fingerprint of the union, and estimate

- the number of distinct shingles, from the k-th smallest hash,
- the resemblance (Jaccard) of two texts, from the union's k smallest,
- the containment of one in the other, from resemblance and counts.

All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.session import cut_lineage

SHINGLE_WORDS = 5
K = 128
_SPAN = 2.0**64


def with_bottom_k(docs: DataFrame, text: str, name: str, k: int = K, width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with the sorted array of the k smallest shingle hashes of
    ``text`` as ``name``. Null and blank texts have an empty one."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    own = F.col("__hashes")
    count = F.size(own)
    last = F.greatest(count - (width - 1), F.lit(1))
    shingle = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*[F.get(own, i + (j - 1)) for j in range(width)]))
    hashed = docs.withColumn("__hashes", F.transform(words, lambda w: F.xxhash64(w)))
    made = hashed.withColumn(name, F.when(count > 0, shingle).otherwise(F.lit([]).cast("array<bigint>")))
    return made.withColumn(name, F.slice(F.array_distinct(F.sort_array(name)), 1, k)).drop("__hashes")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two parts taken together (shingles across the seam apart)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Exact below k; else (k - 1) over the k-th smallest hash's place in the hash range."""
    place = (F.element_at(sketch, -1).cast("double") + F.lit(_SPAN / 2)) / F.lit(_SPAN)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / place)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The part of the union's k smallest hashes that both have. Two empty
    fingerprints are alike (1); an empty one is unlike any other (0)."""
    union = merged(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated part of a's shingles that b has. An empty a is contained in all."""
    alike = resemblance(a, b, k)
    common = alike * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    """A fingerprint as base64 of its hashes in ascending order, 8 bytes each."""
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))), r"\s", "")


def from_text(fingerprint: Column) -> Column:
    """The array that ``as_text`` was given."""
    raw = F.hex(F.unbase64(fingerprint))
    half = lambda at: F.conv(F.substring(raw, at, F.lit(8)), 16, 10).cast("bigint")
    whole = lambda i: F.call_function("shiftleft", half(i * 16 + 1), F.lit(32)).bitwiseOR(half(i * 16 + 9))
    return F.when(F.length(raw) >= 16, F.transform(F.sequence(F.lit(0), (F.length(raw) / 16 - 1).cast("int")), whole)).otherwise(F.lit([]).cast("array<bigint>"))


def with_next_text(docs: DataFrame, identity: str, text: str, slice_rows: int = 1024, buckets: int = 512) -> DataFrame:
    """``docs`` (identity, text) with ``next_text``, the text of the next row by
    ascending identity; the last row's next is the first. ``__bucket``,
    ``__slice`` and ``__tie`` stay as the order's columns, ``__ends`` marks the last
    of a slice.

    Quantiles of the identities cut the rows into ``buckets`` of about equal
    size, whatever the identities' spread. A bucket is cut evenly into slices of
    about ``slice_rows`` rows, by identity, or by a hash of the text where it holds
    one identity only (null ones, say). A window looks ahead within a slice, and
    the last row of a slice gets the first row of the next one by a join. Null
    identities come first; ties are ordered by that hash.
    """
    tied = docs.withColumn("__tie", F.xxhash64(text))
    told = docs.agg(F.percentile_approx(identity, [k / buckets for k in range(1, buckets)], 10 * buckets).alias("cuts")).first()
    cuts = sorted(set(told["cuts"] or []))  # at most one number a bucket
    above = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(identity))) if cuts else F.lit(0)
    placed = tied.withColumn("__bucket", F.when(F.col(identity).isNull(), -1).otherwise(above))
    spread = placed.groupBy("__bucket").agg(F.min(identity).alias("low"), F.max(identity).alias("high"), F.count(F.lit(1)).alias("rows")).collect()  # a row a bucket
    known = {r["__bucket"]: r for r in spread}

    def by_bucket(value) -> Column:
        """A value of each bucket, by its number."""
        return F.element_at(F.lit([value(known.get(k)) for k in range(-1, len(cuts) + 1)]), F.col("__bucket") + 2)

    pieces = lambda r: -(-r["rows"] // slice_rows) if r else 1
    one = by_bucket(lambda r: r is None or r["low"] is None or r["low"] == r["high"])
    low = by_bucket(lambda r: float(r["low"] or 0) if r else 0.0)
    range_ = by_bucket(lambda r: float((r["high"] or 0) - (r["low"] or 0) + 1) if r else 1.0)
    count = by_bucket(lambda r: int(pieces(r)))
    even = F.floor((F.col(identity) - low) / range_ * count)
    by_tie = F.floor((F.col("__tie").cast("double") / F.lit(_SPAN) + 0.5) * count)
    cut = placed.withColumn("__slice", F.greatest(F.lit(0), F.least(F.coalesce(F.when(one, by_tie).otherwise(even), F.lit(0)), count - 1)).cast("int"))
    # one narrow row per slice: its first row, and the slice before it, in the
    # bucket or at the end of the bucket before. Written, so that Spark knows the
    # size and broadcasts it only if it is small
    heads = cut_lineage(cut.groupBy("__bucket", "__slice").agg(F.min(F.struct(F.col(identity).alias("id"), F.col("__tie").alias("tie"))).alias("head")))
    ends = {r["__bucket"]: r["last"] for r in heads.groupBy("__bucket").agg(F.max("__slice").alias("last")).collect()}  # a row a bucket
    order = sorted(ends)
    before_of = {b: order[k - 1] for k, b in enumerate(order)}
    named = lambda values: F.element_at(F.lit([int(values.get(k, 0)) for k in range(-1, len(cuts) + 1)]), F.col("__bucket") + 2)
    inside = F.lag("__slice").over(Window.partitionBy("__bucket").orderBy("__slice"))
    linked = heads.withColumn("__inside", inside).select(
        F.when(F.col("__inside").isNotNull(), F.col("__bucket")).otherwise(named(before_of)).alias("__before_bucket"),
        F.coalesce("__inside", named({b: ends[before_of[b]] for b in order})).alias("__before"),
        F.col("__bucket").alias("__at_bucket"), F.col("__slice").alias("__at"), "head",
    )
    heads = cut_lineage(linked)
    is_head = (F.col("__bucket") == F.col("__at_bucket")) & (F.col("__slice") == F.col("__at")) & F.col(identity).eqNullSafe(F.col("head.id")) & (F.col("__tie") == F.col("head.tie"))
    first = cut.join(heads, is_head).select(F.col("__before_bucket").alias("__bucket"), F.col("__before").alias("__slice"), F.col(text).alias("__first")).dropDuplicates(["__bucket", "__slice"])
    ahead = next_order(identity)
    within = cut.select("*", F.lead(F.lit(True)).over(ahead).isNull().alias("__ends"), F.lead(text).over(ahead).alias("next_text"))
    joined = within.join(first, ["__bucket", "__slice"], "left")
    return joined.withColumn("next_text", F.when(F.col("__ends"), F.col("__first")).otherwise(F.col("next_text"))).drop("__first")


def next_order(identity: str):
    """The window of ``with_next_text``: what looks ahead over it again needs no other shuffle."""
    return Window.partitionBy("__bucket", "__slice").orderBy(F.col(identity).asc_nulls_first(), "__tie")


def edited_fingerprints(docs: DataFrame, identity: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text,
    and how much it resembles the edited text and the next document.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many (or all) of the next document's, by ascending identity; the last
    document's next is the first. Null text is the empty text; empty texts
    resemble only empty texts. Identities are whole numbers. Repeated rows are
    next to each other. Other columns are not read. Empty input gives no rows.
    """
    plain = docs.select(F.col(identity).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = with_bottom_k(with_next_text(plain, "doc_id", "text"), "text", "sketch", k)
    # only the last row of a slice needs its next text's hashes made anew
    own = with_bottom_k(own.withColumn("seam", F.when(F.col("__ends"), F.col("next_text"))), "seam", "seam_sketch", k)
    next_sketch = F.when(F.col("__ends"), F.col("seam_sketch")).otherwise(F.lead("sketch").over(next_order("doc_id")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = with_bottom_k(own.withColumn("next_sketch", next_sketch).withColumn("edited", edited), "edited", "edited_sketch", k)
    return both.select(
        F.col("doc_id").alias(identity),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("in_edited"),
    )
