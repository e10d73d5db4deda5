"""Document operators: chunks, sections, diffs, health, search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import documents as fd
from annalist.functions.text import excerpt
from annalist.operators.sets import first_wins, last_wins


def chunk_rows(docs: DataFrame, ident: str = "id", text: str = "text", width: int = 1800) -> DataFrame:
    """(document_id, chunk_index, text) of the cleaned text."""
    cleaned = docs.select(F.col(ident).alias("document_id"), fd.clean_extracted(F.col(text)).alias("t"))
    # the outer form: a plain explode makes Spark infer a size filter and
    # evaluate the whole expression once more below the scan
    pieces = cleaned.select("document_id", F.posexplode_outer(fd.chunks(F.col("t"), width)).alias("chunk_index", "text"))
    return pieces.where(F.col("text").isNotNull())


def assemble(chunks: DataFrame) -> DataFrame:
    """Chunks of each document joined in index order by line ends."""
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY chunk_index)").alias("text"))


def parse_sections(docs: DataFrame, ident: str = "id", text: str = "text") -> DataFrame:
    """One row per document: its sections, warnings and parse quality."""
    unified = docs.select(F.col(ident).alias("document_id"), F.regexp_replace(text, "\r", "\n").alias("text"))
    placed = unified.withColumn("placed", fd.placed_lines(F.col("text")))
    lined = placed.select("document_id", "text", F.col("placed.line").alias("lines"), F.col("placed.before").alias("before"))
    typed = lined.withColumn("types", F.transform("lines", lambda x: fd.heading_type(x)))
    opened = typed.withColumn("starts", fd.section_starts(F.col("types")))
    closed = opened.withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(1))), F.array(F.size("lines") + 1)))
    closed = closed.withColumn("ends", F.slice("ends", F.lit(1), F.size("starts")))
    parted = closed.withColumn("sections", fd.sections(*[F.col(c) for c in ("text", "lines", "before", "types", "starts", "ends")])).select(
        "document_id", "text", "sections")
    own = F.filter("sections", lambda s: s["section_type"] != "preamble")
    keyed = parted.withColumn("keys", F.transform(own, lambda s: fd.heading_key(s["heading"])))
    warned = keyed.withColumn("warnings", fd.section_warnings(F.col("text"), F.col("sections"), F.col("keys"))).drop("keys")
    return warned.withColumn("quality", fd.parse_quality(F.col("warnings"), F.col("sections")))


def section_rows(docs: DataFrame, ident: str = "id", text: str = "text") -> DataFrame:
    """One row per section, with its offsets in the text (line ends unified) and a section id."""
    parsed = parse_sections(docs, ident, text)
    rows = parsed.select("document_id", F.explode_outer("sections").alias("s")).where(F.col("s").isNotNull()).select("document_id", "s.*")
    key = fd.heading_key(F.col("heading"))
    return rows.withColumn("key", key).withColumn("section_id", F.concat_ws("-", "key", F.col("position").cast("string")))


def health(docs: DataFrame, chunk_count: str, ident: str = "document_id", text: str = "text") -> DataFrame:
    """Metrics and reasons per document; thresholds apply to ratios rounded to
    three places."""
    base = docs.select(F.col(ident).alias("document_id"), F.coalesce(text, F.lit("")).alias("t"), F.col(chunk_count).alias("chunk_count"))
    lined = base.withColumn("lines", fd.trimmed_lines(F.col("t")))
    scored = lined.select(
        "document_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.length("t").alias("char_count"),
        F.size("lines").alias("line_count"), fd.vocabulary_hits(F.col("t")).alias("vocabulary_hits"),
        fd.half_up(fd.odd_character_ratio(F.col("t")), 3).alias("odd_ratio"),
        fd.half_up(fd.repeated_line_ratio(F.col("lines")), 3).alias("repeated_ratio"))
    return scored.withColumn("reasons", fd.health_reasons(
        F.col("chunk_count"), F.col("char_count"), F.col("vocabulary_hits"), F.col("odd_ratio"), F.col("repeated_ratio"), F.col("line_count")))


def quality_audit(docs: DataFrame, chunk_count: str, min_chars: int = 500, ident: str = "document_id", text: str = "text") -> DataFrame:
    """As health, with the wider vocabulary, raw ratios against the limits,
    four places shown, word count and a preview."""
    base = docs.select(F.col(ident).alias("document_id"), F.coalesce(text, F.lit("")).alias("t"), F.col(chunk_count).alias("chunk_count"))
    lined = base.withColumn("lines", fd.trimmed_lines(F.col("t"))).withColumn("odd", fd.odd_character_ratio(F.col("t")))
    scored = lined.withColumn("repeated", fd.repeated_line_ratio(F.col("lines"))).withColumn("hits", fd.audit_hits(F.col("t")))
    words = F.size(F.filter(F.split("t", f"[{fd.WHITE}]+"), lambda w: F.length(w) > 0))
    return scored.select(
        "document_id", "chunk_count", F.length("t").alias("char_count"), words.alias("word_count"), F.size("lines").alias("line_count"),
        F.col("hits").alias("vocabulary_hits"), fd.half_up(F.col("odd"), 4).alias("odd_ratio"),
        fd.half_up(F.col("repeated"), 4).alias("repeated_ratio"),
        fd.health_reasons(F.col("chunk_count"), F.length("t"), F.col("hits"), F.col("odd"), F.col("repeated"), F.size("lines"), min_chars).alias("reasons"),
        F.substr("t", F.lit(1), F.lit(320)).alias("preview"))


def reason_counts(scored: DataFrame) -> DataFrame:
    """Documents scanned, flagged, and per reason, in one pass."""
    names = ["missing_text_chunks", "very_short_text", "low_legal_vocabulary", "high_noise_ratio", "high_repeated_line_ratio"]
    return scored.groupBy().agg(
        F.count(F.lit(1)).alias("scanned"), F.count(F.when(F.size("reasons") > 0, 1)).alias("suspicious"),
        *[F.count(F.when(F.array_contains("reasons", n), 1)).alias(n) for n in names])


def consecutive_pairs(docs: DataFrame, group: str, kind: str, ident: str = "id") -> DataFrame:
    """(group, from_id, to_id) of neighbouring kinds; one document per kind."""
    one = first_wins(docs.select(group, kind, ident), [group, kind], [ident])
    following = F.lead(ident).over(Window.partitionBy(group).orderBy(kind))
    return one.withColumn("to_id", following).where(F.col("to_id").isNotNull()).select(group, F.col(ident).alias("from_id"), "to_id")


def section_diff(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """Status of every section key of each (from_id, to_id): added, removed,
    changed or unchanged. The last section of a repeated heading counts;
    white space and case do not."""
    one = last_wins(sections.select("document_id", "key", "heading", "text", "position"), ["document_id", "key"], ["position"])
    side = lambda ident, p: pairs.join(one, F.col(ident) == F.col("document_id")).select(
        "from_id", "to_id", "key", F.col("heading").alias(f"{p}_heading"), F.col("text").alias(p))
    joined = side("from_id", "before").join(side("to_id", "after"), ["from_id", "to_id", "key"], "full_outer")
    same = fd.section_text_key(F.col("before")) == fd.section_text_key(F.col("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return joined.select("from_id", "to_id", "key", F.coalesce("after_heading", "before_heading").alias("heading"),
                         status.alias("status"), "before", "after")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("from_id", "to_id").agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("added", "removed", "changed", "unchanged")])


def changed_pairs(diff: DataFrame) -> DataFrame:
    """Pairs with at least one section that is not the same."""
    return diff_counts(diff).where(F.col("added") + F.col("removed") + F.col("changed") > 0)


def with_excerpts(diff: DataFrame, limit: int = 900) -> DataFrame:
    """The diff with an excerpt of each side on top of the whole texts."""
    return diff.withColumn("before_excerpt", excerpt(F.col("before"), limit)).withColumn("after_excerpt", excerpt(F.col("after"), limit))


def _common_rows(a: list[str], places: dict[str, int], full: int, start: int, top: int, low: int) -> Iterator[int]:
    """Rows top - 1 down to low of the table of longest common subsequences of
    what is left of both, from the row below them. A row is one number: bit p is
    clear where the subsequence grows by the word p places before the last."""
    row = start
    for i in range(top - 1, low - 1, -1):
        hits = row & places.get(a[i], 0)
        row = ((row + hits) | (row - hits)) & full
        yield row


def word_runs(before: str, after: str) -> list[tuple[str, str]]:
    """Longest-common-subsequence word diff as merged runs; on a tie a word is
    removed before one is added.

    A row of the table is a bit vector, made from the one below it by a few
    operations on whole numbers. Only every root(n)-th row is kept; the rows
    between two kept ones are made again when the walk comes there, so memory
    grows with the length times the root of the length, in bits.
    """
    a, b = before.split(), after.split()
    places: dict[str, int] = {}
    for p, word in enumerate(reversed(b)):
        places[word] = places.get(word, 0) | 1 << p
    full = (1 << len(b)) - 1
    step = max(1, int(len(a) ** 0.5))
    kept = {len(a): full}
    for i, row in zip(range(len(a) - 1, -1, -1), _common_rows(a, places, full, full, len(a), 0)):
        if i % step == 0:
            kept[i] = row
    runs: list[tuple[str, list[str]]] = []

    def put(kind: str, word: str) -> None:
        if runs and runs[-1][0] == kind:
            runs[-1][1].append(word)
        else:
            runs.append((kind, [word]))

    def common(row: int, j: int) -> int:
        rest = len(b) - j
        return rest - (row & ((1 << rest) - 1)).bit_count()

    i = j = 0
    block: dict[int, int] = {}
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            put("same", a[i])
            i, j = i + 1, j + 1
            continue
        if i < len(a) and j < len(b) and (i not in block or i + 1 not in block):
            low = i - i % step
            top = min(len(a), low + step)
            block = {top: kept[top], **dict(zip(range(top - 1, low - 1, -1), _common_rows(a, places, full, kept[top], top, low)))}
        if j == len(b) or (i < len(a) and common(block[i + 1], j) >= common(block[i], j + 1)):
            put("removed", a[i])
            i += 1
        else:
            put("added", b[j])
            j += 1
    return [(kind, " ".join(words)) for kind, words in runs]


def word_diff(diff: DataFrame, max_chars: int | None = None, max_runs: int | None = None) -> DataFrame:
    """Word runs of sections that differ. A display may leave out texts longer
    than ``max_chars`` together and runs behind the first ``max_runs``."""
    todo = diff.where(F.col("status") != "unchanged")
    if max_chars is not None:
        todo = todo.where(F.length(F.coalesce("before", F.lit(""))) + F.length(F.coalesce("after", F.lit(""))) <= max_chars)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for f, t, k, before, after in zip(frame["from_id"], frame["to_id"], frame["key"], frame["before"], frame["after"]):
                for n, (kind, value) in enumerate(word_runs(before or "", after or "")[:max_runs]):
                    rows.append((f, t, k, n, kind, value))
            yield pd.DataFrame(rows, columns=["from_id", "to_id", "key", "position", "kind", "value"])

    return todo.select("from_id", "to_id", "key", "before", "after").mapInPandas(
        batches, "from_id long, to_id long, key string, position int, kind string, value string")


def search(docs: DataFrame, wanted: str, ident: str = "id", text: str = "text", most: int | None = None) -> DataFrame:
    """Documents that contain ``wanted``, case ignored, with a snippet for each
    hit, or for the first ``most``: 120 characters before a hit and 160 after it."""
    needle = wanted.strip().lower()
    if len(needle) < 2:
        return docs.select(F.col(ident).alias("document_id"), F.array().cast("array<string>").alias("snippets")).where(F.lit(False))
    size = len(needle)
    found = docs.select(F.col(ident).alias("document_id"), F.col(text).alias("t"), F.lower(text).alias("low")).where(
        F.col("low").contains(needle))
    step = lambda acc, _: F.when(F.size(acc) == 0, F.array(F.locate(needle, F.col("low")))).when(
        F.element_at(acc, -1) == 0, acc).otherwise(
        F.concat(acc, F.array(F.call_function("locate", F.lit(needle), F.col("low"), F.element_at(acc, -1) + size))))
    every = ((F.length("low") - F.length(F.replace(F.col("low"), F.lit(needle), F.lit("")))) / size).cast("int")
    hits = F.aggregate(F.sequence(F.lit(1), every if most is None else F.least(every, F.lit(most))), F.array().cast("array<int>"), step)
    placed = found.withColumn("hits", F.filter(hits, lambda p: p > 0))
    cut = lambda p: F.concat(
        F.when(p > 121, "...").otherwise(""),
        fd.strip(F.substr("t", F.greatest(p - 120, F.lit(1)), F.least(p - 1, F.lit(120)) + size + 160)),
        F.when(p - 1 + size + 160 < F.length("t"), "...").otherwise(""))
    return placed.select("document_id", F.transform("hits", cut).alias("snippets"))


def searchable(docs: DataFrame, scored: DataFrame, reviews: DataFrame) -> DataFrame:
    """Healthy documents, and unhealthy ones a reviewer accepted."""
    accepted = reviews.where(F.col("status").isin("accepted", "reviewed")).select(F.col("doc_id").alias("document_id")).distinct()
    bad = scored.where(F.size("reasons") > 0).select("document_id").join(accepted, "document_id", "left_anti")
    return docs.join(bad.select(F.col("document_id").alias("id")), "id", "left_anti")


def confidence(docs: DataFrame, scored: DataFrame, parsed: DataFrame, reviews: DataFrame, status: str = "text_status") -> DataFrame:
    """Confidence label from text status, live issues and review state."""
    flags = scored.select("document_id", (F.size("reasons") > 0).alias("unhealthy")).join(
        parsed.select("document_id", (F.size("warnings") > 0).alias("warned")), "document_id", "full_outer")
    seen = reviews.groupBy(F.col("doc_id").alias("document_id")).agg(
        F.max(F.col("status").isin("accepted", "reviewed")).alias("reviewed"))
    joined = docs.select(F.col("id").alias("document_id"), F.col(status).alias("st")).join(flags, "document_id", "left").join(seen, "document_id", "left")
    done = F.coalesce("reviewed", F.lit(False))
    issue = (F.col("st") == "stored") & ~done & (F.coalesce("unhealthy", F.lit(False)) | F.coalesce("warned", F.lit(False)))
    label = (
        F.when(issue, "needs_review").when(F.col("st") == "missing", "missing_text")
        .when(F.col("st").isin("unsupported", "failed"), "unsupported_text")
        .when((F.col("st") == "stored") & done, "accepted_ocr").when(F.col("st") == "stored", "ocr_extracted").otherwise("official_parsed"))
    return joined.select("document_id", label.alias("confidence"))
