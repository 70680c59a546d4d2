"""Column functions for names, addresses, URLs, slugs and display text (Column in, Column out, no UDFs).

Patterns run with ``(?U)`` so that word, space and case rules cover all of Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeledger import catalogs as cat


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(table: dict[str, str], key: Column) -> Column:
    """``table[key]``, null when the key is absent. The table becomes one literal map."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.create_map(*pairs)[key]


def matches_any(text: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """True if any pattern occurs in ``text``; one alternation, so the text is scanned once."""
    flags = "(?iU)" if ignore_case else "(?U)"
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def required_text(pattern: str) -> str:
    """The longest plain text (lower case) that every match of ``pattern`` holds; "" if there is none.

    Groups, classes and optional characters are left out, so the answer can only be too short.
    """
    runs, run, i, depth = [], "", 0, 0
    while i < len(pattern):
        ch, step, plain = pattern[i], 1, None
        if ch == "\\":
            step, plain = 2, pattern[i + 1] if not pattern[i + 1].isalnum() else None
        elif ch == "[":
            step = pattern.index("]", i + 2) - i + 1
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            return ""
        elif ch not in ".^$*+?{}|":
            plain = ch
        after = pattern[i + step:i + step + 1]
        if ch == "{":  # a counted repeat: the character before it may be missing
            step = pattern.index("}", i) - i + 1
        optional = after in ("?", "*", "{") and after != ""
        if plain is not None and depth == 0 and not optional:
            run += plain
        if plain is None or depth > 0 or optional or after == "+":
            runs.append(run)
            run = ""
        i += step
    return max([*runs, run], key=len).lower()


def folded(text: Column) -> Column:
    """Lower case, with the few letters that pattern matching takes for plain ones written as such."""
    return F.lower(F.translate(text, "ſıİ\u212a", "siik"))


def any_in_page(text: Column, plain: Column, patterns: list[str]) -> Column:
    """True if any pattern occurs in a long text. ``plain`` is ``folded(text)``.

    A pattern only runs where the plain text it needs occurs, which is a far cheaper search.
    """
    def one(pattern: str) -> Column:
        hit, needed = text.rlike("(?iU)" + pattern), required_text(pattern)
        return (F.contains(plain, F.lit(needed)) & hit) if needed.isascii() and len(needed) > 1 else hit

    return reduce(lambda a, b: a | b, [one(p) for p in patterns])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unpunctuate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\s]", " ")


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def head(values: Column, n: int | None) -> Column:
    """The first ``n`` values of an array; all of them without ``n``."""
    return values if n is None else F.slice(values, 1, n)


def present(text: Column) -> Column:
    """Not null and not the empty string."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def fixed(number: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded from the exact binary value, exact halves to even."""
    return F.call_function("format_number", number.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def fixed_up(number: Column, digits: int) -> Column:
    """The same for positive numbers, but exact halves are rounded up."""
    # Only multiples of 1/2 (no decimals) or 1/4 (one decimal) can be exact halves.
    steps = {0: 2, 1: 4}[digits]
    half = F.pmod(number * steps, F.lit(2.0)) == 1.0
    return fixed(F.when(half, number + 0.1 / steps).otherwise(number), digits)


# --- addresses and names -------------------------------------------------------------------------------------

def validate_address(street, city, state, zip_code) -> Column:
    """Struct of the cleaned address, or null if a part breaks the address rules.

    The state is cut to its first two letters ("Texas" gives "TE"); a short ZIP is zero-padded; ZIP+4 is cut.
    """
    st = F.trim(F.upper(col(state)))
    st = F.when(F.length(st) >= 2, F.substring(st, 1, 2)).otherwise(st)
    zp = F.trim(col(zip_code))
    zp = F.when((F.length(zp) > 0) & (F.length(zp) < 5), F.lpad(zp, 5, "0")).otherwise(zp)
    zp = F.substring_index(zp, "-", 1)
    return checked_address(F.trim(col(street)), F.trim(col(city)), st, zp)


def checked_address(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    ok = (
        F.length(street).between(1, 255)
        & F.length(city).between(1, 100)
        & state.rlike("^[A-Z]{2}$")
        & zip_code.rlike(r"^[0-9]{5}(-[0-9]{4})?$")
    )
    return F.when(
        ok,
        F.struct(street.alias("street"), city.alias("city"), state.alias("state"), zip_code.alias("zip_code")),
    )


def normalize_state(state) -> Column:
    """Two letters stay, a full state name becomes its code, anything else is null."""
    up = F.trim(F.upper(col(state)))
    return F.when(F.length(up) == 2, up).otherwise(lookup(cat.STATE_CODES, up))


def normalize_zip(zip_code) -> Column:
    cut = F.substring_index(F.trim(col(zip_code)), "-", 1)
    return F.when(F.length(cut) == 5, cut)


def _street_parts(street: Column) -> tuple[Column, Column]:
    """(street for matching, suite): the suite goes before words are expanded."""
    plain = unpunctuate(F.upper(street))
    suite = F.trim(F.regexp_extract(plain, "(?iU)" + cat.SUITE_PATTERN, 0))
    bare = collapse(F.regexp_replace(plain, "(?iU)" + cat.SUITE_PATTERN, ""))
    words = F.transform(F.split(bare, " "), lambda w: F.coalesce(lookup(cat.STREET_WORDS, w), w))
    return F.array_join(words, " "), F.when(suite != "", suite)


def normalize_address(street, city, state, zip_code) -> Column:
    """Struct (street, city, state, zip_code, suite) for matching; null where a part cannot be normalized."""
    norm_street, suite = _street_parts(col(street))
    norm_city = collapse(unpunctuate(F.upper(col(city))))
    norm_state, norm_zip = normalize_state(state), normalize_zip(zip_code)
    ok = present(col(street)) & present(col(city)) & norm_state.isNotNull() & norm_zip.isNotNull()
    return F.when(
        ok,
        F.struct(
            norm_street.alias("street"), norm_city.alias("city"), norm_state.alias("state"),
            norm_zip.alias("zip_code"), suite.alias("suite"),
        ),
    )


def normalize_name(name) -> Column:
    """Upper case, no punctuation, company and trade words dropped anywhere ("Games" alone becomes "")."""
    words = r"(?U)\b(?:" + "|".join(cat.NAME_SUFFIX_WORDS) + r")\b"
    return collapse(F.regexp_replace(unpunctuate(F.upper(col(name))), words, ""))


def parse_formatted_address(text) -> Column:
    """"street, city, ST 12345[-6789]" to a checked address struct, else null."""
    c = col(text)
    part = [F.trim(F.regexp_extract(c, "(?U)" + cat.GOOGLE_ADDRESS_PATTERN, i)) for i in (1, 2, 3, 4)]
    return checked_address(part[0], part[1], part[2], F.substring(part[3], 1, 5))


# --- URLs ----------------------------------------------------------------------------------------------------

def url_host(url) -> Column:
    """Lower-case host without user and port; null when the URL has no ``//host`` part."""
    host = F.lower(F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def bare_host(url) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def is_blocked_url(url, domains: list[str]) -> Column:
    """True if the host or any parent domain is listed; no host is not blocked."""
    listed = "|".join(d.replace(".", r"\.") for d in domains)
    return F.coalesce(bare_host(url).rlike(rf"(?:^|\.)(?:{listed})$"), F.lit(False))


def url_path(url) -> Column:
    """Path of an absolute URL; a value without a scheme is taken as a path."""
    c = col(url)
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), path).otherwise(c)


def clean_url(url) -> Column:
    """Scheme, lower-case host and path ("/" if none); query, fragment and path parameters dropped."""
    c = col(url)
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(c, r"^[^:/?#]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(c, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, path))


def base_url(url) -> Column:
    c = col(url)
    found = F.regexp_extract(c, r"^(.*?://[^/]*)", 1)
    return F.when(found != "", found).otherwise(c)


def same_site(a, b) -> Column:
    return F.coalesce(bare_host(a), F.lit("")) == F.coalesce(bare_host(b), F.lit(""))


def absolute_url(base, href) -> Column:
    """``href`` seen from page ``base``: absolute, protocol-relative, rooted or relative to the page's folder."""
    b, h = col(base), col(href)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*/|/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    page = F.regexp_extract(b, r"^([^?#]*)", 1)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("#") | h.startswith("?") | (h == ""), F.concat(page, h))
        .otherwise(F.concat(origin, folder, h))
    )


def classify_url_path(path) -> Column:
    """One of the URL buckets for a site path."""
    parts = F.filter(F.split(col(path), "/"), lambda p: p != "")
    n = F.size(parts)
    first, second, third = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return (
        F.when((n >= 2) & (first == "_next") & (second == "static"), "static_asset")
        .when((n >= 1) & (F.get(parts, n - 1) == "opengraph-image"), "opengraph_image")
        .when((n >= 3) & (first == "store") & (third == "claim"), "store_claim")
        .when((n >= 2) & (first == "store"),
              F.when(second.rlike("(?i)" + cat.UUID_PATTERN), "store_uuid").otherwise("store_slug"))
        .when((n == 2) & (first == "stores"), "state")
        .when((n >= 3) & (first == "stores"), "city")
        .when((n >= 1) & first.isin(cat.STATIC_SECTIONS), "category_static")
        .when((n >= 1) & (first == "guides"), "guide")
        .otherwise("unknown")
    )


# --- slugs ---------------------------------------------------------------------------------------------------

def slug_part(text) -> Column:
    quoteless = F.regexp_replace(F.lower(col(text)), "[" + cat.SLUG_QUOTES + "]", "")
    spaced = F.trim(F.regexp_replace(quoteless, "[^a-z0-9 -]", " "))
    dashed = F.regexp_replace(F.regexp_replace(spaced, r"\s+", "-"), "-{2,}", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def strip_legal_suffix(name) -> Column:
    raw = col(name)
    cut = reduce(lambda c, _: F.regexp_replace(c, "(?iU)" + cat.LEGAL_SUFFIX_PATTERN, ""), range(4), raw)
    cut = F.trim(cut)
    return F.when(cut != "", cut).otherwise(F.trim(raw))


def state_slug_part(state) -> Column:
    low = F.lower(F.trim(col(state)))
    codes = {name.lower(): code.lower() for name, code in cat.STATE_CODES.items()}
    return F.coalesce(
        F.when(F.length(low) == 2, low).otherwise(F.coalesce(lookup(codes, low), F.replace(low, F.lit(" "), F.lit("-")))),
        F.lit(""),
    )


def build_slug(name, city, state) -> Column:
    """``name-city-state`` in kebab case; a name that already ends in the city (and state) does not repeat it."""
    n, c, s = slug_part(strip_legal_suffix(name)), slug_part(col(city)), slug_part(state_slug_part(state))
    has_city, has_state = c != "", s != ""
    city_state = F.concat(c, F.lit("-"), s)
    ends_both = has_city & has_state & ((n == city_state) | F.endswith(n, F.concat(F.lit("-"), city_state)))
    ends_city = has_city & ((n == c) | F.endswith(n, F.concat(F.lit("-"), c)))
    keep_city = has_city & ~ends_both & ~ends_city
    keep_state = has_state & ~ends_both
    joined = F.concat_ws("-", F.when(n != "", n), F.when(keep_city, c), F.when(keep_state, s))
    joined = F.regexp_replace(F.regexp_replace(joined, "-{2,}", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(joined, 1, cat.MAX_STORE_SLUG), "^-+|-+$", "")


def disambiguate_slug(base: Column, store_id: Column, length: int | None = cat.SHORT_ID_LENGTH) -> Column:
    """Base slug plus the first characters of the id (all without ``length``), kept within the length limit."""
    whole = F.lower(F.replace(store_id, F.lit("-"), F.lit("")))
    short = whole if length is None else F.substring(whole, 1, length)
    room = F.lit(cat.MAX_STORE_SLUG - 1) - F.length(short)
    head = F.when(
        F.length(base) + 1 + F.length(short) > cat.MAX_STORE_SLUG,
        F.regexp_replace(F.substring(base, F.lit(1), room), "-+$", ""),
    ).otherwise(base)
    return F.concat(head, F.lit("-"), short)


def _state_slugs() -> dict[str, str]:
    return {code: name.lower().replace(" ", "-") for name, code in cat.STATE_CODES.items()}


def state_to_slug(state) -> Column:
    s = F.trim(col(state))
    known = lookup(_state_slugs(), F.upper(s))
    return F.coalesce(known, F.replace(F.lower(s), F.lit(" "), F.lit("-")))


def city_to_slug(city) -> Column:
    kept = F.regexp_replace(F.trim(col(city)), "[^a-zA-Z0-9 -]", "")
    dashed = F.regexp_replace(F.replace(F.lower(kept), F.lit(" "), F.lit("-")), "-{2,}", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


def slug_to_state(slug) -> Column:
    names = {s: " ".join(w.capitalize() for w in s.split("-")) for s in _state_slugs().values()}
    return lookup(names, col(slug))


def slug_to_abbrev(slug) -> Column:
    return lookup({s: code for code, s in _state_slugs().items()}, col(slug))


def abbrev_to_state(code) -> Column:
    names = {code: " ".join(w.capitalize() for w in s.split("-")) for code, s in _state_slugs().items()}
    return lookup(names, F.upper(col(code)))


def slug_to_city(slug) -> Column:
    """Dashes to spaces, first letters upper. Lossy: "st-louis" gives "St Louis"."""
    words = F.transform(
        F.split(col(slug), "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))
    )
    return F.array_join(words, " ")


# --- display text --------------------------------------------------------------------------------------------

def _title_part(w: Column) -> Column:
    tail = lambda i: F.lower(F.substring(w, i, 1000))
    return (
        F.when((F.length(w) >= 3) & w.startswith("MC"), F.concat(F.lit("Mc"), F.substring(w, 3, 1), tail(4)))
        .when((F.length(w) >= 5) & w.startswith("MAC"), F.concat(F.lit("Mac"), F.substring(w, 4, 1), tail(5)))
        .otherwise(F.concat(F.substring(w, 1, 1), tail(2)))
    )


def _title_word(word: Column) -> Column:
    def part(p: Column) -> Column:
        at = F.instr(p, "'")
        head, rest = F.substring(p, F.lit(1), at - 1), F.substring(p, at + 1, F.lit(1000))
        quoted = F.concat(
            _title_part(head), F.lit("'"), F.when(F.length(rest) <= 1, F.lower(rest)).otherwise(_title_part(rest))
        )
        return F.when(at > 0, quoted).otherwise(_title_part(p))

    return F.array_join(F.transform(F.split(word, "-"), part), "-")


def display_case(text) -> Column:
    """All-capitals text to title case (acronyms, Mc/Mac, apostrophes, hyphens); other text is left alone.

    ASCII letters decide whether a text is all capitals. Null gives the empty string.
    """
    t = F.coalesce(col(text), F.lit(""))
    shouting = t.rlike("[A-Z]") & ~t.rlike("[a-z]")
    tokens = F.split(t, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")
    cased = F.transform(tokens, lambda w: F.when(w.isin(cat.DISPLAY_ACRONYMS), w).otherwise(_title_word(w)))
    return F.when(shouting, F.array_join(cased, "")).otherwise(t)
