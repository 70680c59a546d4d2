"""Dates found in headers, sitemaps and page text, parsed as columns. All results are UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions.text import let, lookup

_MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
]
_MONTH_NUMBERS = {m: f"{i:02d}" for i, m in enumerate(_MONTHS, 1)} | {m[:3]: f"{i:02d}" for i, m in enumerate(_MONTHS, 1)}
_WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_SHORT_DAY = "(?i)(?:" + "|".join(d[:3] for d in _WEEKDAYS) + ")"
_LONG_DAY = "(?i)(?:" + "|".join(_WEEKDAYS) + ")"
_TIME = r"(\d{1,2}:\d{1,2}:\d{1,2})"
_ZONE = r"(?:GMT|UTC)"


def _stamp(year: Column, month: Column, day: Column, time: Column | None = None) -> Column:
    date = F.concat_ws("-", year, month, F.lpad(day, 2, "0"))
    text = F.concat(date, F.lit(" "), F.lit("00:00:00") if time is None else time)
    ok = (year != "") & (month != "") & (day != "")
    return F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd H:m:s")))


def _full_year(two: Column) -> Column:
    """Two-digit year: 69–99 are 1900s, the rest 2000s."""
    return F.when(two != "", F.concat(F.when(two >= "69", F.lit("19")).otherwise(F.lit("20")), two)).otherwise("")


def _month(word: Column) -> Column:
    return F.coalesce(lookup(_MONTH_NUMBERS, F.lower(word)), F.lit(""))


def parse_http_date(text: Column) -> Column:
    """RFC 7231, RFC 850 and asctime dates; anything else is null."""
    def g(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    rfc7231 = rf"^{_SHORT_DAY},\s*(\d{{1,2}})\s+([A-Za-z]{{3}})\s+(\d{{4}})\s+{_TIME}\s+{_ZONE}$"
    rfc850 = rf"^{_LONG_DAY},\s*(\d{{1,2}})-([A-Za-z]{{3}})-(\d{{2}})\s+{_TIME}\s+{_ZONE}$"
    asctime = rf"^{_SHORT_DAY}\s+([A-Za-z]{{3}})\s+(\d{{1,2}})\s+{_TIME}\s+(\d{{4}})$"
    return F.coalesce(
        _stamp(g(rfc7231, 3), _month(g(rfc7231, 2)), g(rfc7231, 1), g(rfc7231, 4)),
        _stamp(_full_year(g(rfc850, 3)), _month(g(rfc850, 2)), g(rfc850, 1), g(rfc850, 4)),
        _stamp(g(asctime, 4), _month(g(asctime, 1)), g(asctime, 2), g(asctime, 3)),
    )


def parse_iso_date(text: Column) -> Column:
    """Date, date and time, or date and time with an offset."""
    t = F.trim(text)
    day = r"^\d{4}-\d{1,2}-\d{1,2}"
    spread = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    offset = F.when(t.rlike(day + r"T\d{1,2}:\d{1,2}:\d{1,2}(?:Z|[+-]\d{2}:?\d{2})$"), spread.try_cast("timestamp"))
    local = F.when(t.rlike(day + r"T\d{1,2}:\d{1,2}:\d{1,2}$"), t.try_cast("timestamp"))
    plain = F.when(t.rlike(day + "$"), t.try_cast("timestamp"))
    return F.coalesce(offset, local, plain)


def parse_page_date(text: Column) -> Column:
    """"March 5, 2023", "Mar 5 2023", "3/5/2023", "3-5-2023", "3/5/23" or "2023-03-05"."""
    def g(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    words = r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
    slashes, dashes = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    short, iso = r"^(\d{1,2})/(\d{1,2})/(\d{2})$", r"^(\d{4})-(\d{2})-(\d{2})$"
    pad = lambda c: F.when(c != "", F.lpad(c, 2, "0")).otherwise("")
    return F.coalesce(
        _stamp(g(words, 3), _month(g(words, 1)), g(words, 2)),
        _stamp(g(slashes, 3), pad(g(slashes, 1)), g(slashes, 2)),
        _stamp(g(dashes, 3), pad(g(dashes, 1)), g(dashes, 2)),
        _stamp(_full_year(g(short, 3)), pad(g(short, 1)), g(short, 2)),
        _stamp(g(iso, 1), g(iso, 2), g(iso, 3)),
    )


def page_timestamp(html: Column) -> Column:
    """Struct (stamp, method): an "updated on" date, else Jan 1 of the highest © year from 2020 to 2030.

    Each pattern scans the page once; the pieces it finds are parsed from the short match.
    """
    def dated(pattern: str) -> Column:
        return let(F.regexp_extract(html, "(?iU)" + cat.UPDATED_PREFIX + pattern, 1), parse_page_date)

    def copied(top: Column) -> Column:
        return F.when(top.between("2020", "2030"), F.try_to_timestamp(F.concat(top, F.lit("-01-01"))))

    year = let(F.array_max(F.regexp_extract_all(html, F.lit("(?U)" + cat.COPYRIGHT_PATTERN), F.lit(1))), copied)

    def chosen(found: Column) -> Column:
        method = F.when(found["dated"].isNotNull(), F.lit("page_timestamp")).when(found["year"].isNotNull(), F.lit("copyright"))
        return F.struct(F.coalesce(found["dated"], found["year"]).alias("stamp"), method.otherwise("none").alias("method"))

    updated = F.coalesce(*[dated(p) for p in cat.UPDATED_PATTERNS])
    return let(F.struct(updated.alias("dated"), year.alias("year")), chosen)


def sitemap_lastmod(xml: Column, first: int | None = None) -> Column:
    """Latest of the lastmod dates (of the first ``first``, if given) of a sitemap that is complete (ends with its closing tag)."""
    whole = xml.rlike(r"(?s)</(?:[\w.-]+:)?(?:urlset|sitemapindex)\s*>\s*$")
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:[\w.-]+:)?lastmod\b[^>]*>(.*?)</"), F.lit(1))
    return F.when(whole, F.array_max(F.transform(found if first is None else F.slice(found, 1, first), parse_iso_date)))
