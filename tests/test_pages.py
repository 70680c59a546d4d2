"""Golden cases of the page evidence functions."""

import json

import pytest
from pyspark.sql import functions as F

from placeledger import session
from placeledger.functions import dates as dt
from placeledger.functions import hours as hr
from placeledger.functions import html as hm
from placeledger.operators import pages as pg


def one(spark, column, html):
    return spark.createDataFrame([(html, "https://shop.example.com/")], "html string, url string").select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("html", "headers", "url", "want"), [
    ("crystalcommerce.com", {}, "", "crystal_commerce"), ("x binderpos.com", {}, "", "binderpos"), ("cdn.shopify.com", {}, "", "shopify"),
    ("", {"x-shopid": "12"}, "", "shopify"), ("wc-add-to-cart", {}, "", "woocommerce"), ("static1.squarespace.com", {}, "", "squarespace"),
    ("wp-content js.stripe.com", {}, "", "wordpress_stripe"), ("wp-content", {}, "", "wordpress_stripe"), ("js.stripe.com", {}, "", "unknown"),
    ("", {}, "https://store.tcgplayer.com/x", "custom"), ("cdn.shopify.com binderpos.com", {}, "", "binderpos"),
    ("", {}, "https://a.example.com/products.json", "binderpos"), ("plain", {}, "", "unknown"),
])
def test_platform(spark, html, headers, url, want):
    df = spark.createDataFrame([(html, headers, url)], "h string, m map<string,string>, u string")
    assert df.select(pg.detect_platform("h", "m", "u")).first()[0] == want


def test_python_gets_small_batches_of_pages(spark, data):
    """A worker's memory must not grow with the table until 10,000 pages or 64 MB are in a batch."""
    import pandas as pd

    from placeledger.plans.registry import all_queries

    @F.pandas_udf("long")
    def batch_bytes(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum()] * len(texts))

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    all_queries()["extract_description"](spark, data)
    pages = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("html"))
    assert pages.select(F.max(batch_bytes("html"))).first()[0] < 2 * session.BATCH_BYTES


def test_singles(spark):
    assert one(spark, pg.singles_by_keywords("html"), "MTG singles, Magic the Gathering")["confidence"] == 0.85
    assert one(spark, pg.singles_by_keywords("html"), "Magic the\nGathering here")["size"] == "small"
    assert one(spark, pg.singles_by_keywords("html"), "board games") is None


def test_links(spark):
    html = "".join(f"<a class='x' href='/product/{i}'>P{i}</a>" for i in range(9)) + '<a href="item/1">rel</a>'
    links = one(spark, pg.product_links("html", "url"), html)
    assert len(links) == 9 and links[0] == "https://shop.example.com/product/0"
    assert len(one(spark, pg.product_links("html", "url", limit=5), html)) == 5
    html = '<a href="http://www.shop.example.com/x?a=1#b">Event <b>list</b></a><a href="/cal&amp;endar">c</a><a href=/calendar>d</a><a href="https://other.example.com/events">o</a>'
    assert one(spark, pg.event_links("html", "url"), html) == ["http://www.shop.example.com/x", "https://shop.example.com/calendar"]


def test_events(spark):
    got = one(spark, pg.detect_events("html", "url"), '<a href="/schedule?x">s</a>')
    assert got["has_events"] and got["event_url"] == "https://shop.example.com/schedule?x"
    assert tuple(one(spark, pg.detect_events("html", "url"), "Friday Night Magic")) == (True, None)
    assert tuple(one(spark, pg.detect_events("html", "url"), '<a href="events">relative</a>')) == (False, None)


def test_description(spark):
    para = hm.page_text("html")["tight"]
    pick = lambda html: one(spark, pg.extract_description("html", para), html)
    long = "A" * 150 + ". " + "b" * 400
    assert pick('<meta content="A fine shop with many games" name="description">') == "A fine shop with many games"
    assert pick('<meta name="description" content="short"><meta property="og:description" content="An open graph description">') == "An open graph description"
    assert pick(f"<p>no</p><p>{long}</p>") == "A" * 150 + "."
    assert pick("<p>" + "c" * 400 + "</p>") == "c" * 300 + "..."
    assert pick("<p>short</p>") is None


def test_page_text(spark):
    got = one(spark, hm.page_text("html"), "<title>T &amp; U</title><script>hidden()</script><p>a <b>b</b><!-- c --> d</p><style>x</style>")
    assert got["text"] == "T & U a b d"


def test_snippets_and_catalog(spark):
    got = one(spark, pg.scan_snippets("html"), "x" * 80 + " We  sell\nPOKÉMON cards " + "y" * 80)
    assert [s["category"] for s in got] == ["pokemon"]
    assert "We sell POKÉMON cards" in got[0]["snippet"] and len(got[0]["snippet"]) <= 127
    assert one(spark, pg.scan_categories("html"), "dungeons & dragons, Comics and 40K") == ["dnd", "miniatures", "comics"]


@pytest.mark.parametrize(("html", "want"), [
    ('Sol Ring <script type="application/ld+json">{"@type": "Product", "offers": [{"price": "4.5"}]}</script> $9.99', (True, 4.5, "json_ld")),
    ('Sol Ring <script type="application/ld+json">[{"@type": "Other"}, {"@type": "Product", "offers": {"price": 2}}]</script>', (True, 2.0, "json_ld")),
    ('Sol Ring <script type="application/ld+json">{bad</script><b class="a price b">$3.25</b>', (True, 3.25, "css_selector")),
    ("$1.00 SOL RING costs $0.00 or $7.50", (True, 7.5, "regex")), ("Sol Ring" + " " * 600 + "$5.00", (True, None, "none")),
    ("Counterspell $5.00", (False, None, "none")),
])
def test_price(spark, html, want):
    df = spark.createDataFrame([(html, "shopify")], "html string, platform string")
    r = pg.card_prices(df, ["Sol Ring"]).first()
    assert (r.found, r.store_price, r.method) == want


def test_json_ld_types(spark):
    html = '<script type="application/ld+json">[{"@type": ["B", "A"]}, {"@type": "C"}]</script><script type="application/ld+json">no</script>'
    assert one(spark, pg.json_ld_types("html"), html) == ["A", "B", "C"]


def test_contacts(spark):
    assert one(spark, pg.extract_phones("html"), "call (555) 010-1234 or +1 555.010.9999 or 555-010-1234") == ["(555) 010-1234", "+1 555.010.9999", "555-010-1234"]
    assert one(spark, pg.extract_hours("html"), "Open Mon: 10 am to 8 pm\nSunday closed") == ["Mon: 10 am", "Sunday closed"]


def test_page_dates(spark):
    stamp = lambda html: one(spark, dt.page_timestamp(F.col("html")), html)
    assert str(stamp("Prices updated: March 5, 2023 © 2020")["stamp"])[:10] == "2023-03-05"
    assert stamp("© 2019 © 2024")["method"] == "copyright" and stamp("© 2031")["method"] == "none"
    assert one(spark, dt.sitemap_lastmod(F.col("html")), "<urlset><lastmod>2024-01-01</lastmod>") is None


def test_hours(spark):
    lines = [f"{d}: 10:00 AM – 8:00 PM" for d in ("Monday", "Tuesday", "Wednesday")] + ["Thursday: Closed", "Friday: 6:00 PM – 2:00 AM", "Saturday: Closed", "Sunday: Closed"]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    at = lambda t: df.select(hr.status_from_lines(F.col("l"), F.lit(t).cast("timestamp_ntz"))).first()[0]
    assert tuple(at("2024-02-02 19:00:00")) == (True, "6:00 PM – 2:00 AM", None)
    assert tuple(at("2024-02-01 12:00:00")) == (False, "Closed", "Opens Friday at 6:00 PM")
    assert df.select(hr.open_run(F.col("l"))).first()[0] == "Open Mon-Wed"
    point = lambda d, h: {"day": d, "hour": h, "minute": 0}
    periods = json.dumps([{"open": point(5, 18), "close": point(6, 2)}, {"open": point(1, 9), "close": point(1, 9)}])
    p = F.from_json(F.lit(periods), "array<struct<open: struct<day: int, hour: int, minute: int>, close: struct<day: int, hour: int, minute: int>>>")
    got = lambda t: spark.range(1).select(hr.status_from_periods(p, F.lit(t).cast("timestamp_ntz"))).first()[0]
    assert got("2024-02-03 01:00:00")["is_open"] is True
    assert got("2024-02-05 09:00:00")["is_open"] is False  # opens and closes at the same time
    assert got("2024-02-03 03:00:00")["next_open"] == "Opens Monday at 9:00 AM"


def test_calendars(spark):
    html = 'window.cowEventCal3_config = {"_id": "c1", "timezone": "UTC"};window.cowEventCal3_services=[{"_id": "s", "title": "Draft"}, 5];'
    rows = pg.extract_calendars(spark.createDataFrame([("1", "https://a.example.com/e", html)], "store_id string, url string, html string")).collect()
    assert [(r.calendar_id, r.service_id, r.title) for r in rows] == [("c1", "s", "Draft")]


def test_price_near_a_later_place(spark):
    html = "Sol Ring " + "x" * 600 + " sol ring now $4.50"
    assert pg.card_prices(spark.createDataFrame([(html, "shopify")], "html string, platform string"), ["Sol Ring"]).first().store_price == 4.5


def test_nothing_is_cut(spark):
    phones = " ".join(f"555-010-{i:04d}" for i in range(30))
    assert len(one(spark, pg.extract_phones("html"), phones)) == 30
    links = "".join(f"<a href='/x{i}'>x</a>" for i in range(30)) + "<a href='/calendar'>c</a>"
    assert one(spark, pg.detect_events("html", "url"), links)["event_url"] == "https://shop.example.com/calendar"
