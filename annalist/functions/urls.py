"""URL normalisation and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Rewrites of official addresses, the address whose language
# parameter is dropped, and the addresses of bills and votes.
REWRITES = (
    (r"(?i)^https?://(?:www\.)?cdep\.ro/pls/steno/(?=evot2015\.)", "https://www.cdep.ro/ords/pls/steno/"),
    (r"(?i)^https://(?:www\.)?cdep\.ro/ords/pls/steno/evot2015\.nominal", "https://www.cdep.ro/ords/pls/steno/evot2015.Nominal"),
)
NO_LANGUAGE = r"(?i)cdep\.ro/ords/pls/steno/evot2015\.Nominal($|\?)"
BILL_PAGES = (
    r"senat\.ro/Legis/Lista\.aspx\?cod=\d+",
    r"senat\.ro/legis/lista\.aspx(?=.*[?&]nr_cls=(?:BP|B|L|PLX)\d+)(?=.*[?&]an_cls=\d{4})",
    r"cdep\.ro/(?:ords/)?pls/proiecte/upl_pck2015\.proiect",
)
VOTE_PAGES = (r"senat\.ro/VoturiPlenDetaliu\.aspx", r"cdep\.ro/(?:ords/)?pls/steno/evot2015\.Nominal")


def canonical_url(url: Column, rewrites: tuple = REWRITES, drop: tuple[str, ...] = ("idl",), drop_on: str = NO_LANGUAGE) -> Column:
    """Rewritten address without fragment, its parameters sorted; the ``drop``
    parameters left out on addresses that match ``drop_on``."""
    for pattern, replacement in rewrites:
        url = F.regexp_replace(url, pattern, replacement)
    query = F.try_parse_url(url, F.lit("QUERY"))
    dropped = F.regexp_replace(url, "#.*$", "").rlike(drop_on)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~(dropped & F.split(p, "=")[0].isin(*drop))))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    made = F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("HOST"))), path, tail)
    return F.coalesce(made, F.regexp_replace(url, "#.*$", ""))


def match_url(url: Column) -> Column:
    """Form in which two spellings of one address agree."""
    secure = F.regexp_replace(F.trim(url), "(?i)^http://", "https://")
    return F.regexp_replace(secure, r"(?i)&idl=1(?![A-Za-z0-9_])", "")


def query_param(url: Column, name: str) -> Column:
    """Parameter by name, else by the name in any case; null if absent."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    exact = F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    loose = F.regexp_extract(query, rf"(?i)(?:^|&){name}=([^&]*)", 1)
    return F.coalesce(F.nullif(exact, F.lit("")), F.nullif(loose, F.lit("")))


def profile_key(url: Column) -> Column:
    """leg{window}:cam{chamber}:idm{number} of a profile address; the chamber
    is 2 unless given."""
    window, chamber, number = (query_param(url, p) for p in ("leg", "cam", "idm"))
    key = F.concat(F.lit("leg"), window, F.lit(":cam"), F.coalesce(chamber, F.lit("2")), F.lit(":idm"), number)
    return F.when(window.isNotNull() & number.isNotNull(), key)


def year_of(url: Column) -> Column:
    """Year parameter under any of its names, if it has four digits."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), rf"(?:^|&){p}=([^&]*)", 1), F.lit(""))
                         for p in ("an_cls", "AN", "anp")])
    return F.when(found.rlike(r"^\d{4}$"), found.cast("int"))


def kind_of(url: Column) -> Column:
    """bill or vote by the address of its page, null for any other page."""
    any_of = lambda patterns: url.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    return F.when(any_of(BILL_PAGES), "bill").when(any_of(VOTE_PAGES), "vote")


def chamber_of(url: Column) -> Column:
    return F.when(url.rlike(r"(?i)senat\.ro"), "senate").when(url.rlike(r"(?i)cdep\.ro"), "deputies")
