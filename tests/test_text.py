"""Golden cases of the name, address, URL, slug and display functions."""

import pytest
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions import text as tx
from placeledger.operators import filters as fl
from placeledger.operators import lifecycle as lc
from placeledger.sources import raw as rw


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()], F.lit(0).alias("_"))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("street", "city", "state", "zip_code", "want"), [
    ("123 Main St", "Portland", "OR", "97201", ("123 MAIN STREET", "PORTLAND", "OR", "97201", None)),
    ("100 NW Oak Ave", "Portland", "Oregon", "97201-1234", ("100 NORTHWEST OAK AVENUE", "PORTLAND", "OR", "97201", None)),
    ("200 N Main St", "St. Louis", "mo", "63101", ("200 NORTH MAIN STREET", "ST LOUIS", "MO", "63101", None)),
    ("300 Market St Suite 200", "X", "OR", "97201", ("300 MARKET STREET", "X", "OR", "97201", "SUITE 200")),
    ("9 S.W. 5th Ave.", "X", "OR", "97201", ("9 SOUTH WEST 5TH AVENUE", "X", "OR", "97201", None)),
    ("5 Floor Mats", "X", "OR", "97201", ("5", "X", "OR", "97201", "FLOOR MATS")),
])
def test_normalize_address(spark, street, city, state, zip_code, want):
    got = value(spark, tx.normalize_address("a", "b", "c", "d"), a=street, b=city, c=state, d=zip_code)
    assert tuple(got) == want


@pytest.mark.parametrize(("a", "b", "c", "d"), [("", "X", "OR", "97201"), ("1 A St", "X", "Nowhere", "97201"), ("1 A St", "X", "OR", "972")])
def test_unusable_address(spark, a, b, c, d):
    assert value(spark, tx.normalize_address("a", "b", "c", "d"), a=a, b=b, c=c, d=d) is None


def test_validate_address(spark):
    ok = lambda *p: value(spark, tx.validate_address("a", "b", "c", "d"), **dict(zip("abcd", p, strict=True)))
    assert tuple(ok(" 1 A St ", " X ", "Texas", "501")) == ("1 A St", "X", "TE", "00501")
    assert ok("1 A St", "X", "OR", "97201-1234")["zip_code"] == "97201"
    assert ok("1 A St", "X", "1R", "97201") is None and ok("", "X", "OR", "97201") is None


@pytest.mark.parametrize(("name", "want"), [
    ("card kingdom", "CARD KINGDOM"), ("Acme Games, LLC", "ACME"), ("Games", ""), ("Comics Inc.", ""), ("Pokémon Hut", "POKÉMON HUT"),
    ("Gaming  Cards Zone", "ZONE"),
])
def test_normalize_name(spark, name, want):
    assert value(spark, tx.normalize_name("n"), n=name) == want


@pytest.mark.parametrize(("text", "want"), [
    ("123 Main St, Portland, OR 97201, USA", ("123 Main St", "Portland", "OR", "97201")),
    ("123 Main St, Portland, OR 97201-1234, USA", ("123 Main St", "Portland", "OR", "97201")),
    ("Mall Level 2, 5 Elm St, Bend, OR 97701", ("Mall Level 2, 5 Elm St", "Bend", "OR", "97701")),
    ("Portland, OR", None), ("", None),
])
def test_parse_formatted_address(spark, text, want):
    got = value(spark, tx.parse_formatted_address("t"), t=text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("url", "want"), [
    ("https://wizards.com/x", True), ("https://www.wizards.com", True), ("http://locator.wizards.com/a", True),
    ("https://a.b.wizards.com", True), ("https://notwizards.com", False), ("", False), ("nonsense", False), (None, False),
])
def test_blocked_url(spark, url, want):
    assert value(spark, tx.is_blocked_url(F.lit(url).cast("string"), cat.INGEST_BLOCKED_DOMAINS)) is want


@pytest.mark.parametrize(("name", "city", "state", "want"), [
    ("Jan's Tropical Games LLC", "Portland", "OR", "jans-tropical-games-portland-or"),
    ("Game X Change Gainesville TX", "Gainesville", "TX", "game-x-change-gainesville-tx"),
    ("Foo Inc, LLC", "Bend", "Oregon", "foo-bend-or"), ("Shop Bend", "Bend", "OR", "shop-bend-or"), ("LLC", "Bend", "OR", "llc-bend-or"),
])
def test_build_slug(spark, name, city, state, want):
    assert value(spark, tx.build_slug("n", "c", "s"), n=name, c=city, s=state) == want


def test_disambiguated_slug_keeps_its_length(spark):
    got = value(spark, tx.disambiguate_slug(F.col("b"), F.col("i")), b="a" * 170, i="123456ab-0000")
    assert len(got) == 160 and got.endswith("-123456")


@pytest.mark.parametrize(("text", "want"), [
    ("MCDANIEL'S MTG SHOP", "McDaniel's MTG Shop"), ("O'BRIEN-SMITH", "O'Brien-Smith"), ("MACDONALD", "MacDonald"), ("MACE", "Mace"),
    ("Already Mixed", "Already Mixed"), ("123", "123"), (None, ""),
])
def test_display_case(spark, text, want):
    assert value(spark, tx.display_case(F.lit(text).cast("string"))) == want


def test_slug_tables(spark):
    assert value(spark, tx.state_to_slug("s"), s="ny") == "new-york"
    assert value(spark, tx.slug_to_state("s"), s="new-york") == "New York"
    assert value(spark, tx.slug_to_city("s"), s="st-louis") == "St Louis"
    assert value(spark, tx.city_to_slug("s"), s="St. Louis") == "st-louis"


@pytest.mark.parametrize(("address", "want"), [
    ("616 8th Ave S, Seattle, WA, 98104, United States", ("616 8th Ave S", "Seattle", "WA", "98104", "United States")),
    ("1 A St, Bend, OR, 97701", ("1 A St", "Bend", "OR", "97701", "")), ("1 A St, Bend, OR", ("1 A St", "Bend", "OR", "", "")),
    ("1 A St, Bend", ("1 A St", "", "", "", "")), ("1 A St", ("1 A St", "", "", "", "")),
    ("1 A St, Suite 4, Bend, OR, 97701, United States", ("1 A St", "Suite 4", "Bend", "OR", "97701")),
])
def test_wpn_address(spark, address, want):
    df = spark.createDataFrame(
        [("7", "Shop", address, None, None, True, None, None, None, None)],
        "id string, name string, postalAddress string, latitude double, longitude double, isPremium boolean,"
        " phoneNumber string, emailAddress string, website string, distance double",
    )
    r = rw.parse_wpn(df).first()
    assert (r.street, r.city, r.state, r.zip_code, r.country) == want and r.wpn_level == "premium"


def test_loose_address_takes_the_first_number(spark):
    got = value(spark, rw.address_parts("t"), t="12345 Long Rd, Bend, OR 97701")
    assert got["zip_code"] == "12345" and got["state"] == "OR"


def test_name_and_type_blocks(spark):
    assert value(spark, fl.name_blocked("n"), n="Corner Liquor") is True
    assert value(spark, fl.name_blocked("n"), n="Beer & Board Games") is False
    assert value(spark, fl.types_blocked(F.array(F.lit("bar")))) is True
    assert value(spark, fl.types_blocked(F.array(F.lit("bar"), F.lit("store")))) is False
    assert value(spark, fl.types_blocked(F.array().cast("array<string>"))) is False


@pytest.mark.parametrize(("code", "html", "error", "want"), [
    (200, "<p>hi</p>", None, ("active", None)), (404, "", None, ("dead", "HTTP 404")), (200, "Page  NOT found", None, ("dead", "Soft 404 detected")),
    (None, None, "timeout", ("unreachable", "Timeout")), (None, None, "connect", ("unreachable", "Connection refused")),
])
def test_check_status(spark, code, html, error, want):
    c = lc.check_status(F.lit(code).cast("int"), F.lit(html).cast("string"), F.lit(error).cast("string"))
    assert tuple(value(spark, c)) == want


def test_required_text_is_in_every_match():
    import re

    cases = {
        r"\bmtg\b": ["MTG"], r"pok[eé]mon": ["pokémon", "Pokemon"], r"yu[\-\s]?gi[\-\s]?oh": ["Yu-Gi-Oh", "yugioh"], r"ab?c+de{2}f": ["acdeef", "abccdeef"],
        r"(?:x|y)store": ["xstore"], r"a|b": ["a"], r"graphic\s+novels?": ["graphic novel"], r"js\.stripe\.com": ["js.stripe.com"], r"ab{0,1}cd": ["acd"],
    }
    for pattern, texts in cases.items():
        for t in texts:
            assert re.search(pattern, t, re.I) and tx.required_text(pattern) in t.lower()
    assert tx.required_text(r"\bpathfinder\b") == "pathfinder"


def test_number_text(spark):
    assert value(spark, tx.fixed(F.lit(3.65), 1)) == "3.6" and value(spark, tx.fixed(F.lit(0.25), 1)) == "0.2"
    assert value(spark, tx.fixed_up(F.lit(0.25), 1)) == "0.3" and value(spark, tx.fixed_up(F.lit(2.5), 0)) == "3"
