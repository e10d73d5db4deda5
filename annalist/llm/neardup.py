"""Near-duplicate documents by order MinHash.

A text is its lower-case words (runs of non-white space); its k-mers are the runs
of five words. Each k-mer is labelled with its occurrence (the first, second, ...
of its kind in the text). A sketch takes the few labelled k-mers with the least
hash and keeps them in the order of the text, so two texts share a sketch only if
they share these k-mers in the same order. Several sketches in a row make a band;
texts that share a band's key are candidates.

Candidates are verified by alignment of the two k-mer sequences within a band of
diagonals: with LCS the longest common subsequence, the similarity is
``LCS / (n_a + n_b - LCS)``, a resemblance that minds the order. From 0.8 on two
texts are linked; classes are the connected components.

In a bucket every member is first verified against one leader, the member that
most buckets share. Members that end up in one class need no more comparisons,
so a group of near copies costs its members and not its pairs. What is left,
pairs of different classes in a bucket, is verified too. No bucket is capped.

Pairs that are proven apart are not formed: their lengths, their distances to the
leader (triangle inequality) or their bitmaps may show that the alignment can't
reach the similarity. A bitmap has a bit for each hash of a labelled k-mer; bits
that only one text has stand for different k-mers that only it has, so their
number is a lower bound of the distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.resolve import components
from annalist.session import cut_lineage

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Settings:
    """``bands`` of ``rows`` sketches of ``minima`` k-mers: a pair of long texts of
    similarity s shares a given band with probability s ** (rows * minima), so that
    at 0.8 a pair in 300 shares none. Minima are drawn without replacement, which
    short texts would feel: texts of fewer than ``long_from`` k-mers have sketches
    of one minimum instead, whose bands a pair of 0.8 shares with probability
    0.8 ** rows; none of 40 in 10 ** 12. Texts that can be similar to both kinds
    have both. Bitmaps have ``longs`` numbers of 64 bits. ``side`` bounds how many
    members of a bucket meet in one task, and how many pairs are verified there."""

    width: int = 5
    similarity: float = 0.8
    minima: int = 3
    rows: int = 3
    bands: int = 40
    long_from: int = 21
    longs: int = 64
    side: int = 1024
    seed: int = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """32-bit hashes of a text's lower-case words."""
    return np.array([xxhash.xxh32_intdigest(w) for w in text.lower().split()], np.uint32)


def kmers(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the runs of ``width`` words."""
    count = len(words) - width + 1
    if count < 1:
        return np.empty(0, np.uint64)
    wide = words.astype(np.uint64)
    made = np.zeros(count, np.uint64)
    for k in range(width):
        made = _mix(made * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + count])
    return made


def labelled(grams: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence in the text."""
    order = np.argsort(grams, kind="stable")
    found = grams[order]
    first = np.r_[True, found[1:] != found[:-1]]
    place = np.arange(len(grams))
    nth = np.empty(len(grams), np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return _mix(grams + nth * np.uint64(0xD6E8FEB86659FD93))


def band_keys(grams: np.ndarray, settings: Settings) -> np.ndarray:
    """The band keys of one text with at least one k-mer. Of two similar texts
    either both have keys of long texts or both have keys of short ones."""
    keys = []
    # the longest text that a short one can be similar to
    if len(grams) * settings.similarity < settings.long_from:
        keys.append(_keys_of(grams, settings, 1))
    if len(grams) >= settings.long_from:
        keys.append(_keys_of(grams, settings, settings.minima))
    return np.concatenate(keys)


def _keys_of(grams: np.ndarray, settings: Settings, minima: int) -> np.ndarray:
    rng = np.random.default_rng(settings.seed)
    sketches = settings.bands * settings.rows
    factor = rng.integers(1, 2**32, sketches, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 2**32, sketches, dtype=np.uint32)
    marks = labelled(grams)
    small = (marks >> np.uint64(32)).astype(np.uint32)
    taken = min(minima, len(grams))
    places = np.empty((sketches, taken), np.int64)
    step = max(1, 200_000 // len(small))
    for at in range(0, sketches, step):
        part = slice(at, at + step)
        hashed = (small[None, :] ^ shift[part, None]) * factor[part, None]
        rows = np.arange(len(hashed))
        for k in range(taken):
            least = hashed.argmin(axis=1)
            places[part, k] = least
            hashed[rows, least] = np.uint32(0xFFFFFFFF)
    places.sort(axis=1)
    chosen = marks[places].reshape(settings.bands, -1)
    # a key of a short text's band is never one of a long text's
    key = np.arange(settings.bands, dtype=np.uint64) + np.uint64(settings.bands * minima)
    for k in range(chosen.shape[1]):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + chosen[:, k])
    return key.view(np.int64)


def bitmap(grams: np.ndarray, settings: Settings) -> np.ndarray:
    """The bits of a text's labelled k-mers."""
    places = np.unique(labelled(grams) % np.uint64(64 * settings.longs)).astype(np.int64)
    made = np.zeros(settings.longs, np.uint64)
    np.bitwise_or.at(made, places // 64, np.uint64(1) << (places % 64).astype(np.uint64))
    return made.view(np.int64)


def _by_slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in lists of about 4 MB."""
    size = np.asarray(pc.binary_length(texts), np.int64)
    for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(np.cumsum(size) // (4 << 20))) + 1):
        yield texts.take(pa.array(rows)).to_pylist()


def sketched(docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """(node, size, keys) of the rows with a text: the text's 128-bit digest,
    the number of its k-mers and its band keys (none without a k-mer). A key
    is the key of one band only. Copies near each other are sketched once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _by_slices(batch.column(0)):
                nodes, sizes, keys = [], [], []
                for value in dict.fromkeys(texts):
                    grams = kmers(word_hashes(value), settings.width)
                    nodes.append(hashlib.md5(value.encode(), usedforsecurity=False).digest())
                    sizes.append(len(grams))
                    keys.append(band_keys(grams, settings) if len(grams) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "size", "keys"]
                )

    return docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string")).mapInArrow(run, "node binary, size int, keys array<long>")


def worded(texts: DataFrame, settings: Settings) -> DataFrame:
    """(node, words, bits) of ``texts`` (node, text): word hashes as bytes, and
    the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, at = batch.column(0), 0
            for part in _by_slices(batch.column(1)):
                words = [word_hashes(value) for value in part]
                bits = [bitmap(kmers(w, settings.width), settings) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [nodes.slice(at, len(part)), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(bits, pa.list_(pa.int64()))], names=["node", "words", "bits"]
                )
                at += len(part)

    return texts.mapInArrow(run, "node binary, words binary, bits array<long>")


def indel_distance(a: list[int], b: list[int], most: int) -> int | None:
    """Insertions and deletions that turn ``a`` into ``b``, if at most ``most``;
    such an alignment stays within ``most`` diagonals of the main one.

    Bit i of ``free`` says that the LCS row does not step at column i; the window
    of bits slides along the diagonal, so a row costs the band's width / 64 words.
    """
    start = 0
    least = min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if abs(len(a) - len(b)) > most:
        return None
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    band = min(most, 16)
    while True:
        low, high, free, steps = 0, min(len(a) - 1, band), (1 << (min(len(a) - 1, band) + 1)) - 1, 0
        for j, x in enumerate(b):
            if j > band and low < len(a):
                steps += not free & 1
                free >>= 1
                low += 1
            if j and high < len(a) - 1:
                high += 1
                free |= 1 << (high - low)
            met = 0
            for i in places.get(x, ()):
                if low <= i <= high:
                    met |= 1 << (i - low)
            met &= free
            if met:
                free = ((free + met) | (free - met)) & ((1 << (high - low + 1)) - 1)
        width = high - low + 1
        common = steps + (width - free.bit_count() if width > 0 else 0)
        distance = len(a) + len(b) - 2 * common
        if distance <= band:
            return distance
        if band >= most:
            return None
        band = min(most, band * 8)


def compared(a: np.ndarray, b: np.ndarray, settings: Settings) -> tuple[bool, int, int | None]:
    """Whether two word sequences are similar, and a lower and an upper bound of
    their k-mers' indel distance (None: unknown)."""
    x, y = kmers(a, settings.width), kmers(b, settings.width)
    total = len(x) + len(y)
    # LCS / (total - LCS) >= s means a distance of at most total * (1 - s) / (1 + s)
    most = int(total * (1 - settings.similarity) / (1 + settings.similarity) + 1e-9)
    _, code = np.unique(np.concatenate([x, y]), return_inverse=True)
    left, right = np.bincount(code[: len(x)], minlength=1), np.bincount(code[len(x) :], minlength=1)
    size = max(len(left), len(right))
    left, right = np.pad(left, (0, size - len(left))), np.pad(right, (0, size - len(right)))
    least = total - 2 * int(np.minimum(left, right).sum())
    if least > most:
        return False, least, None
    found = indel_distance(code[: len(x)].tolist(), code[len(x) :].tolist(), most)
    return (True, found, found) if found is not None else (False, max(least, most + 1), None)


def verified(pairs: DataFrame, words: DataFrame, settings: Settings) -> DataFrame:
    """``pairs`` (a, b) with ``link``, ``least`` and ``found`` (see ``compared``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                compared(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), settings)
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.bool_(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["a", "b", "link", "least", "found"])

    left = words.select(F.col("node").alias("a"), F.col("words").alias("a_words"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("b_words"))
    # the leader of a large class is one side of very many pairs: its words go to
    # as many slots as its pairs ask for
    slots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / settings.side).alias("slots"))
    dealt = pairs.select("a", "b").join(slots, "a").withColumn("slot", F.pmod(F.xxhash64("b"), F.col("slots")))
    spread = left.join(slots, "a").select("a", "a_words", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    both = dealt.join(spread, ["a", "slot"]).join(right, "b").select("a", "b", "a_words", "b_words")
    return both.mapInArrow(run, "a binary, b binary, link boolean, least int, found int")


def _node(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary")))


def _reach(total: Column, settings: Settings) -> Column:
    """The largest distance of two similar texts: LCS / (total - LCS) >= s."""
    return F.floor(total * F.lit((1 - settings.similarity) / (1 + settings.similarity)) + F.lit(1e-9))


def _differing(a: Column, b: Column, settings: Settings) -> Column:
    """The number of bits that only one of two bitmaps has."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(settings.longs)), F.lit(0))


def similar_texts(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(links, classes): the verified links (a, b) between different texts, and
    (node, component) of every linked text. Texts are named by their digest.

    Sketches, members of buckets, verified pairs and component rounds are
    written to the shared folder.
    """
    sketches = cut_lineage(sketched(docs, text, settings))
    rows = sketches.select("node", "size", F.explode("keys").alias("key"))
    # a bucket counts if it holds two texts; comparing hashes of their digests will do for that
    shared = rows.select("key", F.xxhash64("node").alias("spot")).groupBy("key").agg(F.min("spot").alias("low"), F.max("spot").alias("high")).where("low <> high").select("key")
    members = cut_lineage(rows.join(shared, "key").distinct())
    nodes = cut_lineage(members.select("node").distinct())
    # merged at any size: what is shuffled grows in proportion, and no side is broadcast
    named = docs.where(F.col(text).isNotNull()).select(_node(text).alias("node"), F.col(text).cast("string").alias("text"))
    # copies go before the shuffle, not after it: a text's copies may be a third of all rows
    single = named.dropDuplicates(["node"])
    words = cut_lineage(worded(single.join(nodes.hint("merge"), "node", "left_semi"), settings))

    # the leader of a bucket is its member that meets the most others in all its buckets
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("met"))
    fame = members.join(counts, "key").groupBy("node").agg(F.sum("met").alias("fame"))
    leaders = members.join(fame, "node").groupBy("key").agg(F.max_by(F.struct("node", "size"), F.struct("fame", "node")).alias("leader"))
    led = members.join(leaders, "key")
    reach = _reach(F.col("size") + F.col("leader.size"), settings)
    led = cut_lineage(led.select("key", "node", "size", F.col("leader.node").alias("leader"), F.abs(F.col("size") - F.col("leader.size")).alias("bound"), reach.alias("reach")))
    first = led.where((F.col("node") != F.col("leader")) & (F.col("bound") <= F.col("reach"))).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    tried = cut_lineage(verified(first, words, settings))
    links = tried.where("link").select("a", "b")
    classes = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    # pairs of a bucket that are still of different classes
    known = tried.select(F.col("a").alias("leader"), F.col("b").alias("node"), "least", "found")
    leads = F.col("node") == F.col("leader")
    placed = (
        led.join(known, ["leader", "node"], "left")
        .join(classes, "node", "left")
        .select("key", "node", "size", F.coalesce("component", "node").alias("class"), leads.alias("leads"), F.greatest("bound", "least").alias("least"), "found")
    )
    mixed = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    open_members = cut_lineage(placed.where("not leads").join(mixed, "key"))
    held = members.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # at most two keys per band
    still = cut_lineage(open_members.join(words.select("node", "bits"), "node").join(held, "node"))
    # a bucket is met by bands of sizes that can be similar, and a full one in slots:
    # the shorter text lies in one band and slot, the longer one goes to its own band
    # and the one below, in all slots
    ratio = F.log(F.lit(1 / settings.similarity + 1e-9))
    band = F.floor(F.log(F.col("size") + 0.5) / ratio).cast("int")
    full = still.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / settings.side).alias("slots"))
    still = still.join(full, "key").withColumn("band", band)
    x, y = (still.select("key", "band", "slots", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "size", "bits", "keys", "class", "least", "found")]) for side in "xy")
    # what the leader is close to and what it is far from are far from each other
    by_leader = F.greatest(F.col("x_least") - F.col("y_found"), F.col("y_least") - F.col("x_found"), F.lit(0))
    bound = F.greatest(by_leader, F.abs(F.col("x_size") - F.col("y_size")))
    reach = _reach(F.col("x_size") + F.col("y_size"), settings)
    shorter = (F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_node") < F.col("y_node")))
    open_pair = shorter & (F.col("x_class") != F.col("y_class")) & (bound <= reach) & (_differing(F.col("x_bits"), F.col("y_bits"), settings) <= reach)
    # a pair is formed in the first of the buckets that it shares
    first_met = F.col("key") == F.array_min(F.array_intersect("x_keys", "y_keys"))
    x = x.withColumn("slot", F.pmod(F.xxhash64("x_node"), F.col("slots"))).drop("slots")
    y = y.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).drop("slots")
    rest = x.join(y, ["key", "band", "slot"]).where(open_pair & first_met).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut_lineage(verified(rest.join(done, ["a", "b"], "left_anti"), words, settings))
    every = cut_lineage(links.unionByName(more.where("link").select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return every, components(every.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _texts(docs: DataFrame, identity: str, text: str, classes: DataFrame) -> DataFrame:
    """(node, component, text_id, rows) of every different text."""
    own = docs.where(F.col(text).isNotNull()).select(F.col(identity).alias("__id"), _node(text).alias("node"))
    counted = own.groupBy("node").agg(F.min("__id").alias("text_id"), F.count(F.lit(1)).alias("rows"))
    return counted.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, identity: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: the identity, ``class_id`` (the smallest
    identity of its class), ``class_size`` (rows in the class), ``verified_links``
    (other texts that were compared with this text and found similar; texts that
    others already join need not be compared) and ``text_id`` (the smallest
    identity with the same text).

    Equal texts share a class; texts of fewer than five words have no k-mer and
    are only compared as a whole, empty ones too. Rows without a text are
    classes of their own. Identities may be null or repeated: null ones sort
    last, and a class of rows without identity has a null ``class_id``. Other
    columns are not read. Empty input gives no rows.
    """
    links, classes = similar_texts(docs, text, settings)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    texts = cut_lineage(_texts(docs, identity, text, classes))
    by_class = texts.groupBy("component").agg(F.min("text_id").alias("class_id"), F.sum("rows").alias("class_size"))
    told = texts.join(by_class, "component").join(degree, "node", "left").select("node", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("verified_links"), "text_id")
    own = docs.select(F.col(identity).alias("__id"), _node(text).alias("node"))
    found = own.where("node is not null").join(told, "node").drop("node")
    alone = own.where("node is null").select("__id", F.col("__id").alias("class_id"), F.lit(1).alias("class_size"), F.lit(0).alias("verified_links"), F.col("__id").alias("text_id"))
    return found.unionByName(alone).withColumnRenamed("__id", identity)


def deduplicated(docs: DataFrame, identity: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each class (see
    ``near_duplicates``) one row with the smallest identity, and every row
    without a text."""
    _, classes = similar_texts(docs, text, settings)
    texts = _texts(docs, identity, text, classes)
    stays = cut_lineage(texts.groupBy("component").agg(F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "node")).alias("first")))
    stays = stays.select(F.col("first.node").alias("__stays"), F.col("first.text_id").alias("__first"))
    named = docs.withColumn("__node", _node(text))
    kept = named.join(stays, (F.col("__node") == F.col("__stays")) & F.col(identity).eqNullSafe(F.col("__first")))
    # repeated rows of one identity: the least by all columns, so that reruns agree
    once = Window.partitionBy("__node").orderBy(F.xxhash64(*docs.columns), F.to_json(F.struct(*docs.columns)))
    kept = kept.withColumn("__nth", F.row_number().over(once)).where("__nth = 1")
    return kept.select(*docs.columns).unionByName(docs.where(F.col(text).isNull()))
