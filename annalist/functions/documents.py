"""Document text as Column expressions: cleaning, chunks, sections, health.

A document is one row, so all of this stays inside the row: no shuffle, and no
group of lines to gather.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.text import WHITE, fold_marks

# Heading patterns of legal text, by section type.
NUMBER = "[0-9IVXLCDM]+"
UNIQUE_ARTICLE = r"(?iu)^Articol\s+unic$"
ARTICLE = rf"(?iu)^Art\.?\s+({NUMBER})[¹²³]?[.)]?$"
ARTICLE_WORD = rf"(?iu)^Articolul\s+({NUMBER})[¹²³]?[.)]?$"
AMENDMENT = rf"(?iu)^La\s+articolul\s+({NUMBER})[¹²³]?.*$"
POINT = rf"(?iu)^Punctul\s+({NUMBER})[.)]?.*$"
PARAGRAPH = rf"(?iu)^Alineatul\s+\(?({NUMBER})\)?.*$"
ANNEX = r"(?iu)^Anexa(?:\s+nr\.?\s*[0-9IVXLCDM]+)?.*$"
ANNEX_NUMBER = rf"(?iu)^Anexa\s+nr\.?\s*({NUMBER})"
AMENDING = (
    r"(?iu)(?<![A-Za-z0-9_])(se\s+modific[ăa]|se\s+completeaz[ăa]|se\s+abrog[ăa]|"
    r"va\s+avea\s+urm[ăa]torul\s+cuprins|dup[ăa]\s+.*se\s+introduce)(?![A-Za-z0-9_])"
)

# Legal vocabulary, and the characters expected in clean text.
VOCABULARY = r"(?i)(?<![A-Za-z0-9_])(?:(?:lege|proiect|guvern|parlament|articol|rom[aâ]niei)(?![A-Za-z0-9_])|(?:art\.|alin\.)(?=[A-Za-z0-9_]))"
EXPECTED = rf"[\p{{L}}\p{{N}}{WHITE}.,;:!?'\"()/\-\[\]{{}}%+*=<>]"
_START, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
# The audit's vocabulary, each counted by itself.
AUDIT_VOCABULARY = tuple(
    f"(?i){_START}{word}{_EDGE if edge else ''}"
    for word, edge in (
        ("lege", True), ("proiect", True), ("ord(?:onanta|onanța|onanţă|onan[țt]e)", True), (r"art(?:icolul)?\.?", True),
        (r"alin\.?", True), (r"lit\.?", True), ("guvern", False), ("parlament", False), ("monitorul oficial", True),
        ("rom[aâ]niei", True),
    )
)


def strip(text: Column) -> Column:
    """Without white space at either edge."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def clean_extracted(text: Column) -> Column:
    """Line ends unified, runs of blanks and of empty lines shortened."""
    unified = F.regexp_replace(text, "\r", "\n")
    blanks = F.regexp_replace(unified, "[ \t]+", " ")
    edges = F.regexp_replace(blanks, " *\n *", "\n")
    return strip(F.regexp_replace(edges, "\n{3,}", "\n\n"))


def chunks(text: Column, width: int = 1800) -> Column:
    """Whole text in pieces of ``width`` characters, trimmed, empty ones left
    out: array of strings."""
    count = F.ceil(F.length(text) / F.lit(width)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: strip(F.substr(text, i * width + 1, F.lit(width)))
    )
    return F.filter(pieces, lambda p: F.length(p) > 0)


def trimmed_lines(text: Column) -> Column:
    """Lines without edge white space, empty ones left out."""
    return F.filter(
        F.transform(F.split(text, "[\r\n]+"), lambda x: strip(x)), lambda x: F.length(x) > 0
    )


def placed_lines(text: Column) -> Column:
    """As trimmed_lines of a text with unified line ends, each with the number
    of line ends before it: array<struct<line, before>>."""
    placed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(strip(x).alias("line"), i.alias("before")))
    return F.filter(placed, lambda x: F.length(x["line"]) > 0)


def line_offset(text: Column, before: Column) -> Column:
    """Where the line after so many line ends begins, from 0."""
    head = F.call_function("substring_index", text, F.lit("\n"), before)
    return F.when(before == 0, F.lit(0)).otherwise(F.length(head) + 1)


def heading_type(line: Column) -> Column:
    """Section type of a heading line, null for any other line."""
    return (
        F.when(line.rlike(UNIQUE_ARTICLE), "unique_article")
        .when(line.rlike(ARTICLE) | line.rlike(ARTICLE_WORD), "article")
        .when(line.rlike(AMENDMENT), "amendment")
        .when(line.rlike(POINT), "point")
        .when(line.rlike(PARAGRAPH), "paragraph")
        .when(line.rlike(ANNEX), "annex")
    )


def heading_number(line: Column) -> Column:
    found = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (ARTICLE, ARTICLE_WORD, AMENDMENT, POINT, PARAGRAPH, ANNEX_NUMBER)]
    return F.coalesce(*found)


def heading_key(heading: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(fold_marks(heading), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "document").otherwise(slug)


def section_starts(types: Column) -> Column:
    """Line numbers (from 1) that open a section: each heading, and the first
    line where it is no heading."""
    heads = F.filter(F.sequence(F.lit(1), F.size(types)), lambda i: F.element_at(types, i).isNotNull())
    none = F.array().cast("array<int>")
    return F.when(F.size(types) == 0, none).otherwise(
        F.concat(F.when(F.element_at(F.concat(types, F.array(F.lit(None))), 1).isNotNull(), none).otherwise(F.array(F.lit(1))), heads))


def sections(text: Column, lines: Column, before: Column, types: Column, starts: Column, ends: Column) -> Column:
    """Sections of a document: a heading with the lines up to the next one;
    what comes before the first is the preamble. Array of structs in document
    order. ``starts`` and ``ends`` (exclusive) are line numbers, ``before`` the
    line ends before each line. From ``start_offset`` to ``end_offset`` (from 0,
    exclusive) the text has the section, its lines untrimmed."""
    return F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda z, n: F.struct(
            F.coalesce(F.when(F.element_at(types, z["s"]).isNotNull(), F.element_at(lines, z["s"])), F.lit("Document")).alias("heading"),
            F.coalesce(F.element_at(types, z["s"]), F.lit("preamble")).alias("section_type"),
            F.when(F.element_at(types, z["s"]).isNotNull(), heading_number(F.element_at(lines, z["s"]))).alias("number"),
            F.array_join(F.slice(lines, z["s"], z["e"] - z["s"]), "\n").alias("text"),
            (n + 1).alias("position"),
            line_offset(text, F.element_at(before, z["s"])).alias("start_offset"),
            F.when(z["e"] > F.size(lines), F.length(text)).otherwise(line_offset(text, F.get(before, z["e"] - 1))).alias("end_offset"),
        ),
    )


def section_warnings(text: Column, parts: Column, keys: Column) -> Column:
    """Warnings of a parsed document. ``keys``: heading keys of the sections
    that are not the preamble."""
    own = F.filter(parts, lambda s: s["section_type"] != "preamble")
    none = F.size(own) == 0
    minor = F.forall(own, lambda s: s["section_type"].isin("amendment", "point", "paragraph"))
    short = F.size(F.filter(own, lambda s: F.length(s["text"]) < 80))
    listed = F.array(
        F.when(none & (F.length(text) > 700), "no_structural_headings"),
        F.when((~none & minor) | (none & text.rlike(AMENDING)), "amendment_only_document"),
        F.when(F.exists(parts, lambda s: F.length(s["text"]) > 8000), "huge_section"),
        F.when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_section_heading"),
        F.when((F.size(own) >= 8) & (short / F.size(own) > 0.5), "too_many_short_sections"),
    )
    empty = F.length(F.regexp_replace(text, r"\s+", "")) == 0
    return F.when(empty, F.array(F.lit("empty_text"))).otherwise(F.array_compact(listed))


def parse_quality(warnings: Column, parts: Column) -> Column:
    """good without warnings, partial with one or two and some structure, else weak."""
    own = F.size(F.filter(parts, lambda s: s["section_type"] != "preamble"))
    return F.when(F.size(warnings) == 0, "good").when((F.size(warnings) <= 2) & (own > 0), "partial").otherwise("weak")


def odd_character_ratio(text: Column) -> Column:
    """Share of characters outside the expected set; 1 for empty text."""
    length = F.length(text)
    return F.when(length == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(text, EXPECTED, "")) / length)


def repeated_line_ratio(lines: Column) -> Column:
    """Share of lines that repeat an earlier one, case ignored."""
    lower = F.transform(lines, lambda x: F.lower(x))
    return F.when(F.size(lines) == 0, F.lit(0.0)).otherwise((F.size(lines) - F.size(F.array_distinct(lower))) / F.size(lines))


def vocabulary_hits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(VOCABULARY))


def half_up(value: Column, places: int) -> Column:
    """Round half up, as floor(x * 10^n + 0.5) / 10^n."""
    scale = 10**places
    return F.floor(value * scale + 0.5) / scale


def health_reasons(chunk_count: Column, chars: Column, hits: Column, odd: Column, repeated: Column, lines: Column, min_chars: int = 500) -> Column:
    """Reasons why extracted text needs a look; ratios come already rounded."""
    return F.array_compact(
        F.array(
            F.when(chunk_count == 0, "missing_text_chunks"),
            F.when((chars > 0) & (chars < min_chars), "very_short_text"),
            F.when((chars >= min_chars) & (hits < 3), "low_legal_vocabulary"),
            F.when(odd > 0.08, "high_noise_ratio"),
            F.when((repeated > 0.35) & (lines >= 12), "high_repeated_line_ratio"),
        )
    )


def audit_hits(text: Column) -> Column:
    """Sum of the hits of each audit word."""
    total = F.lit(0)
    for pattern in AUDIT_VOCABULARY:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


def section_text_key(text: Column) -> Column:
    """Section text with white space and case evened out, for comparison."""
    return F.lower(F.trim(F.regexp_replace(text, f"[{WHITE}]+", " ")))
