"""Text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "ăâîșşțţĂÂÎȘŞȚŢ"
FOLDED = "aaissttAAISSTT"

# White space, Unicode spaces included.
WHITE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# White space that is no single space; a class is asked for its rare members only above the Latin letters.
_RARE = rf"[\u00a0-\uffff&&[{WHITE}]]"
CROWDED = rf"[ \t-\r{_RARE}]{{2,}}|[\t-\r{_RARE}]"


def _latin_table() -> tuple[str, str]:
    """Letters up to U+024F and U+1E00-U+1EFF whose NFD form is one base letter
    plus marks, with that base letter."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(parts) > 1 and len(base) == 1:
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_NFD_FROM, _NFD_TO = _latin_table()


def bound(value: Column, make) -> Column:
    """``make`` of ``value``, which is computed once however often ``make`` uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def clean(text: Column) -> Column:
    """Collapse white space and trim; single spaces stay as they are."""
    return F.trim(F.regexp_replace(text, CROWDED, " "))


def fold(text: Column) -> Column:
    """Lower case with the listed accents removed."""
    return F.lower(F.translate(text, ACCENTED, FOLDED))


def fold_marks(text: Column) -> Column:
    """Lower case with every Latin accent removed: precomposed letters by
    table, then loose combining marks. A text of as many bytes as characters has
    neither."""
    folded = lambda t: F.lower(F.regexp_replace(F.translate(t, _NFD_FROM, _NFD_TO), r"\p{M}+", ""))
    return bound(text, lambda t: F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(folded(t)))


def slug(text: Column) -> Column:
    """Folded words joined by dashes."""
    return F.regexp_replace(F.regexp_replace(fold_marks(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(text: Column) -> Column:
    """Folded words joined by one space."""
    return F.trim(F.regexp_replace(fold_marks(text), "[^a-z0-9]+", " "))


def match_words(text: Column) -> Column:
    """As words(), with the listed accents only."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(match_words(text), "[^a-z0-9]+", "")


def folded_key(text: Column) -> Column:
    """Folded text with nothing but letters and digits."""
    return F.regexp_replace(fold(text), "[^a-z0-9]", "")


def token_key(text: Column) -> Column:
    """Same words in any order give the same key."""
    return F.array_join(F.array_sort(F.split(words(text), " ")), " ")


# Words that describe a role, not a person.
ROLE_WORDS = ("senator", "deputat", "politician")


def loose_token_key(text: Column) -> Column:
    """token_key without role words."""
    kept = F.filter(F.split(words(text), " "), lambda w: ~w.isin(*ROLE_WORDS))
    return F.array_join(F.array_sort(kept), " ")


def capitalised(text: Column) -> Column:
    """First letter of every word and hyphen part upper, the rest lower."""
    first_up = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
    parts = F.split(clean(F.lower(text)), " ")
    return F.array_join(F.transform(parts, lambda w: F.array_join(F.transform(F.split(w, "-"), first_up), "-")), " ")


def title_case(text: Column) -> Column:
    """Capitalised where the text has a word all in capitals, else as it is."""
    return F.when(text.rlike(r"(^|[\s-])\p{Lu}{2,}($|[\s-])"), capitalised(text)).otherwise(text)


def last_name(text: Column) -> Column:
    return F.element_at(F.split(clean(text), " "), -1)


def first_names(text: Column) -> Column:
    parts = F.split(clean(text), " ")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")


# Words an acronym leaves out.
LEADING_WORDS = "^(?:uniunea|asociatia|comunitatea|federatia)"
MINOR_WORDS = ("din", "de", "si", "și", "ale", "al", "a", "ai", "cu", "pentru")


def acronym(text: Column) -> Column:
    """Initials of the words of three letters or more, twelve at most."""
    rest = F.regexp_replace(clean(text), f"(?i){LEADING_WORDS}", "")
    kept = F.filter(F.split(rest, " "), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*MINOR_WORDS))
    return truncate(F.array_join(F.transform(kept, lambda w: F.upper(F.substring(w, 1, 1))), ""), 12)


def parse_count(text: Column) -> Column:
    """First whole number in noisy text, 0 where there is none."""
    return F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("int"), F.lit(0))


def truncate(text: Column, limit: int) -> Column:
    return F.substr(text, F.lit(1), F.lit(limit))


def tracked_query(text: Column) -> Column:
    """Search text as it is logged: folded, clean, at most 120 characters; null if blank."""
    return F.nullif(truncate(clean(fold_marks(text)), 120), F.lit(""))


def pseudonym(salt: str, identity: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt + ":"), identity.cast("string")), 256)


def like_literal(text: str) -> str:
    """LIKE pattern that finds ``text`` itself, wildcards included."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{escaped}%"


def excerpt(text: Column, limit: int = 900) -> Column:
    whole = F.trim(text)
    return F.when(
        F.length(whole) > limit, F.concat(F.trim(truncate(whole, limit)), F.lit("..."))
    ).otherwise(whole)
