"""Evidence from tables of fetched pages: products, links, events, platform, singles, freshness, prices, contacts."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions import dates as dt
from placeledger.functions import html as hm
from placeledger.functions import text as tx


def _any(text: Column, patterns) -> Column:
    return tx.matches_any(text, patterns)


# --- catalogs ------------------------------------------------------------------------------------------------

def scan_categories(text, catalog=cat.PRODUCT_CATALOG) -> Column:
    """Keys of the catalog entries of which a pattern occurs, in catalog order."""
    c = tx.col(text)
    return tx.let(tx.folded(c), lambda plain: F.filter(
        F.array(*[F.when(tx.any_in_page(c, plain, ps), F.lit(k)) for k, ps in catalog]), lambda k: k.isNotNull()
    ))


def scan_snippets(text, catalog=cat.WIDE_PRODUCT_CATALOG, around: int = 60) -> Column:
    """Array of (category, snippet): the first match of the first pattern that occurs, with its surroundings."""
    c = tx.col(text)

    def around_match(pattern: str, start: Column) -> Column:
        left = F.greatest(start - around, F.lit(1))
        right = F.least(start + F.length(F.regexp_extract(c, "(?iU)" + pattern, 0)) + around - 1, F.length(c))
        return F.when(start > 0, tx.collapse(F.substring(c, left, right - left + 1)))

    def snippet(plain: Column, pattern: str) -> Column:
        at = F.when(tx.any_in_page(c, plain, [pattern]), F.regexp_instr(c, F.lit("(?iU)" + pattern)))
        return tx.let(at, lambda start: around_match(pattern, start))

    def entries(plain: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(k).alias("category"), F.coalesce(*[snippet(plain, p) for p in ps]).alias("snippet"))
            for k, ps in catalog
        ])

    return F.filter(tx.let(tx.folded(c), entries), lambda e: e["snippet"].isNotNull())


# --- description and links -----------------------------------------------------------------------------------

def _shorten(text: Column, room: int = 300, least: int = 100) -> Column:
    """At most ``room`` characters: up to the last period if that is late enough, else with dots."""
    head = F.substring(text, 1, room)
    last = F.length(head) - F.instr(F.reverse(head), ".")  # position of the last period, from 0
    has = F.contains(head, F.lit("."))
    cut = F.when(has & (last > least), F.substring(head, F.lit(1), (last + 1).cast("int"))).otherwise(
        F.concat(F.rtrim(head), F.lit("..."))
    )
    return F.when(F.length(text) <= room, text).otherwise(cut)


def extract_description(html, paragraph) -> Column:
    """Meta description, else the open-graph one (each over 20 characters), else the first long paragraph."""
    h = tx.col(html)
    long = lambda c: F.when(F.length(c) > 20, c)
    found = F.coalesce(
        long(hm.meta_content(h, "name", "description")), long(hm.meta_content(h, "property", "og:description")), tx.col(paragraph)
    )
    return tx.let(found, lambda t: _shorten(t))


def dossier_description(html, paragraph, room: int | None = None) -> Column:
    h = tx.col(html)
    long = lambda c: F.when(F.length(c) > 20, c)
    found = F.coalesce(
        long(hm.meta_content(h, "name", "description")), long(hm.meta_content(h, "property", "og:description")), tx.col(paragraph)
    )
    return found if room is None else F.substring(found, 1, room)


def product_links(html, url, limit: int | None = None, hints=cat.PRODUCT_LINK_HINTS) -> Column:
    """First links whose href holds a product hint; rooted ones are put behind the page URL, relative ones are left out."""
    base = F.regexp_replace(tx.col(url), "/+$", "")
    hit = lambda a: reduce(lambda x, y: x | y, [F.contains(F.lower(a["href"]), F.lit(h)) for h in hints])
    full = lambda a: F.when(a["href"].startswith("/"), F.concat(base, a["href"])).otherwise(a["href"])
    links = F.transform(F.filter(hm.anchors(tx.col(html)), hit), full)
    return tx.head(F.filter(links, lambda u: u.startswith("http")), limit)


def _hinted_links(html: Column, url: Column, hints, limit: int | None, links: Column | None = None) -> Column:
    found = hm.anchors(html) if links is None else links
    hay = lambda a: F.lower(F.concat(a["href"], F.lit(" "), a["text"]))
    hit = lambda a: tx.let(hay(a), lambda t: reduce(lambda x, y: x | y, [F.contains(t, F.lit(h)) for h in hints]))
    urls = F.transform(F.filter(found, hit), lambda a: tx.clean_url(tx.absolute_url(url, a["href"])))
    return tx.head(F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & tx.same_site(url, u))), limit)


def event_links(html, url, limit: int | None = None, links: Column | None = None) -> Column:
    """Same-site links that look like events or calendars, cleaned and distinct."""
    return _hinted_links(tx.col(html), tx.col(url), cat.EVENT_LINK_HINTS, limit, links)


def useful_links(html, url, limit: int | None = None, links: Column | None = None) -> Column:
    """Same-site links worth reading next."""
    return _hinted_links(tx.col(html), tx.col(url), cat.USEFUL_LINK_HINTS, limit, links)


def detect_events(html, url) -> Column:
    """Struct (has_events, event_url): the first event link, else event words in the page."""
    h, base = tx.col(html), F.regexp_replace(tx.col(url), "/+$", "")
    first = F.transform(hm.anchors(h), lambda a: a["href"])
    usable = F.filter(first, lambda u: _any(u, cat.EVENT_PATH_PATTERNS) & (u.startswith("/") | u.startswith("http")))
    link = F.get(F.transform(usable, lambda u: F.when(u.startswith("/"), F.concat(base, u)).otherwise(u)), F.lit(0))
    words = tx.let(tx.folded(h), lambda plain: tx.any_in_page(h, plain, cat.EVENT_TEXT_PATTERNS))
    return tx.let(link, lambda u: F.struct((u.isNotNull() | words).alias("has_events"), u.alias("event_url")))


def script_redirect(html, url) -> Column:
    """Same-site target of a simple script redirect."""
    target = F.regexp_extract(tx.col(html), "(?i)" + cat.SCRIPT_REDIRECT_PATTERN, 1)
    full = tx.clean_url(tx.absolute_url(tx.col(url), F.when(target != "", target)))
    return F.when(tx.same_site(tx.col(url), full), full)


# --- platform and singles ------------------------------------------------------------------------------------

def detect_platform(html, headers, url) -> Column:
    """First platform whose URL, HTML or header signature matches; marketplace URLs are custom, no match is unknown.

    URL patterns also run on the HTML, where the payment pattern needs the content folder next to it. A page with only
    the content folder still matches by its HTML signature.
    """
    return tx.let(tx.folded(tx.col(html)), lambda plain: _platform(tx.col(html), plain, tx.col(headers), tx.col(url)))


def _platform(h: Column, plain: Column, hd: Column, u: Column) -> Column:
    out = F.when(_any(u, [cat.MARKETPLACE_URL_PATTERN]), "custom")
    for platform, in_html, in_headers, in_url in cat.PLATFORM_SIGNATURES:
        body = tx.any_in_page(h, plain, in_html)
        hit = body
        if in_url:
            by_url = tx.any_in_page(h, plain, in_url) | _any(u, in_url)
            hit = hit | ((by_url & body) if platform == "wordpress_stripe" else by_url)
        for name, pattern in in_headers:
            value = hd[name]
            hit = hit | F.coalesce(tx.present(value) & value.rlike(pattern), F.lit(False))
        out = out.when(hit, platform)
    return out.otherwise("unknown")


def _hits(text: Column, patterns) -> Column:
    """How many of the patterns occur; ``patterns`` are texts or (text, ignore case) pairs."""
    pairs = [p if isinstance(p, tuple) else (p, True) for p in patterns]

    def one(plain: Column, pattern: str, ignore_case: bool) -> Column:
        hit = tx.any_in_page(text, plain, [pattern]) if ignore_case else tx.matches_any(text, [pattern], False)
        return F.coalesce(hit, F.lit(False)).cast("int")

    return tx.let(tx.folded(text), lambda plain: reduce(lambda a, b: a + b, [one(plain, p, i) for p, i in pairs]))


_VERDICT = "struct<sells: boolean, size: string, confidence: double, method: string>"


def _verdict(sells: bool, size, confidence, method: str) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(
        F.lit(sells).alias("sells"), size.cast("string").alias("size"), confidence.cast("double").alias("confidence"),
        F.lit(method).alias("method"),
    )


def singles_by_keywords(html) -> Column:
    """Verdict of two or more keyword patterns (sure), one (weak), or null."""
    hits = _hits(tx.col(html), [p.replace(".*", r"[^\n]*") for p in cat.SINGLES_KEYWORDS])
    return tx.let(hits, lambda n: F.when(n >= 2, _verdict(True, "medium", 0.85, "keyword")).when(
        n == 1, _verdict(True, "small", 0.60, "keyword")
    ))


def is_card_page(html) -> Column:
    """A product page shows card attributes: two kinds of them, or one and a set name."""
    attributes, sets = _hits(tx.col(html), cat.CARD_ATTRIBUTE_PATTERNS), _hits(tx.col(html), cat.CARD_SET_PATTERNS)
    return (attributes >= 2) | ((attributes >= 1) & (sets >= 1))


def singles_by_samples(product_pages: DataFrame, key: str = "store_id", order: str = "page_no", pages: int | None = None) -> DataFrame:
    """Verdict per site from its product pages (columns key, order, html, status_code); sites with none have no row.

    With ``pages``, only so many first pages of a site are looked at.
    """
    first = product_pages
    if pages is not None:
        w = Window.partitionBy(key).orderBy(order)
        first = product_pages.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= pages)
    counted = first.filter(F.coalesce(F.col("status_code") < 400, F.lit(False))).groupBy(key).agg(
        F.count("*").alias("checked"), F.count_if(is_card_page("html")).alias("cards")
    )
    ratio = F.col("cards") / F.col("checked")
    size = F.when(F.col("cards") >= 3, "medium").otherwise("small")
    confidence = F.least(F.lit(0.95), F.lit(0.70) + ratio * 0.25)
    return counted.filter((F.col("cards") > 0) & (ratio >= 0.5)).select(
        key, _verdict(True, size, confidence, "product_sample").alias("sample")
    )


def detect_singles(sites: DataFrame, product_pages: DataFrame, key: str = "store_id") -> DataFrame:
    """Singles verdict per site row (key, html, status_code, error): strong keywords, samples, weak keywords, none.

    ``escalate`` marks rows that neither strong keywords nor samples decide; they form the budgeted review queue.
    """
    failed = F.col("error").isNotNull() | F.coalesce(F.col("status_code") >= 400, F.lit(False))
    j = sites.withColumn("by_words", singles_by_keywords("html")).join(singles_by_samples(product_pages, key), key, "left")
    strong = F.when(F.col("by_words.confidence") >= 0.80, F.col("by_words"))
    verdict = F.when(failed, _verdict(False, None, 0.0, "none")).otherwise(
        F.coalesce(strong, F.col("sample"), F.col("by_words"), _verdict(False, "none", 0.5, "none"))
    )
    escalate = ~failed & strong.isNull() & F.col("sample").isNull()
    return j.withColumns({"singles": verdict, "escalate": escalate}).drop("by_words", "sample")


def extract_content(pages: DataFrame) -> DataFrame:
    """Description, products and events per page row (html, url, status_code, error), with confidence and method."""
    failed = F.col("error").isNotNull() | F.coalesce(F.col("status_code") >= 400, F.lit(False))
    rows = pages.withColumns({"products": scan_categories("html"), "events": detect_events("html", "url")})
    rows = rows.withColumn("paragraph", F.when(~failed, hm.page_text("html")["tight"]))
    n = F.size("products")
    keep = lambda c, other: F.when(failed, other).otherwise(c)
    return rows.withColumns({
        "description": keep(extract_description("html", "paragraph"), F.lit(None)),
        "has_events": keep(F.col("events.has_events"), F.lit(False)),
        "event_url": keep(F.col("events.event_url"), F.lit(None)),
        "confidence": F.when(failed, 0.0).when(n >= 2, 0.80).when(n == 1, 0.50).otherwise(0.30),
        "method": F.when(failed | (n == 0), "none").otherwise("keyword"),
        "escalate": ~failed & (n < 2),
        "products": keep(F.col("products"), F.array().cast("array<string>")),
    }).drop("events", "paragraph")


# --- freshness -----------------------------------------------------------------------------------------------

def freshness(last_modified, sitemap_xml, html) -> Column:
    """Struct (last_update, confidence, method) of the cheapest signal that holds a date: header, sitemap, page."""
    out = lambda at, c, m: F.struct(at.alias("last_update"), F.lit(c).alias("confidence"), m.alias("method"))
    header, site = dt.parse_http_date(tx.col(last_modified)), dt.sitemap_lastmod(tx.col(sitemap_xml))
    page = dt.page_timestamp(tx.col(html))
    return tx.let(F.struct(header.alias("header"), site.alias("site"), page.alias("page")), lambda s: (
        F.when(s["header"].isNotNull(), out(s["header"], 0.70, F.lit("http_header")))
        .when(s["site"].isNotNull(), out(s["site"], 0.60, F.lit("sitemap")))
        .when(s["page"]["method"] == "page_timestamp", out(s["page"]["stamp"], 0.50, F.lit("page_timestamp")))
        .when(s["page"]["method"] == "copyright", out(s["page"]["stamp"], 0.20, F.lit("copyright")))
        .otherwise(out(F.lit(None).cast("timestamp"), 0.0, F.lit("none")))
    ))


# --- prices --------------------------------------------------------------------------------------------------

_LD_ITEMS = "array<struct<`@type`: string, offers: string>>"


def json_ld_price(html) -> Column:
    """First product price of the page's JSON-LD blocks, whatever product it belongs to."""
    items = F.flatten(F.transform(hm.json_ld_blocks(tx.col(html)), lambda b: F.coalesce(
        F.from_json(b, _LD_ITEMS), F.array().cast(_LD_ITEMS)
    )))
    prices = F.transform(
        F.filter(items, lambda i: i["@type"] == "Product"),
        lambda i: F.get(F.from_json(i["offers"], "array<struct<price: string>>"), F.lit(0))["price"].try_cast("double"),
    )
    return F.get(F.filter(prices, lambda p: p.isNotNull()), F.lit(0))


def platform_price(html, platform) -> Column:
    """Price by the platform's own markup."""
    p, out = tx.col(platform), None
    for name, pattern in cat.PLATFORM_PRICE_PATTERNS.items():
        found = F.regexp_extract(tx.col(html), "(?i)" + pattern, 1).try_cast("double")
        out = F.when(p == name, found) if out is None else out.when(p == name, found)
    return out


def card_prices(pages: DataFrame, cards=cat.PROBE_CARDS, window: int = 500) -> DataFrame:
    """One row per page and card (page columns html, platform): found, price and how the price was read.

    The page-wide prices are worked out once per page; a price counts as a card's if it
    stands within ``window`` characters from one of the places that name it; the first such price is taken.
    """
    lower = F.lower("html")

    def one(card: str) -> Column:
        at = F.instr(F.col("lower_html"), card.lower())
        after = F.split("html", "(?i)" + re.escape(card))
        near = F.flatten(F.transform(F.slice(after, 2, F.size(after)), lambda p: F.regexp_extract_all(
            F.substring(p, 1, max(1, window - len(card))), F.lit(cat.PRICE_PATTERN), F.lit(1))))
        number = F.get(F.filter(F.transform(near, lambda v: v.try_cast("double")), lambda v: v.between(0.01, 999.99)), F.lit(0))
        found = at > 0
        ways = [(F.col("ld_price"), "json_ld"), (F.col("own_price"), "css_selector"), (number, "regex")]
        method = reduce(lambda a, w: a.when(found & w[0].isNotNull(), w[1]), ways[1:], F.when(found & ways[0][0].isNotNull(), ways[0][1]))
        return F.struct(
            F.lit(card).alias("card_name"), found.alias("found"),
            F.when(found, F.coalesce(*[w for w, _ in ways])).alias("store_price"),
            F.coalesce(method, F.lit("none")).alias("method"),
        )

    rows = pages.withColumns({"lower_html": lower, "ld_price": json_ld_price("html"), "own_price": platform_price("html", "platform")})
    keep = [c for c in pages.columns if c != "html"]
    return rows.select(*keep, F.explode(F.array(*[one(c) for c in cards])).alias("p")).select(*keep, "p.*")


def json_ld_types(html) -> Column:
    """Sorted distinct schema types of the page's JSON-LD blocks; blocks that are no JSON are skipped."""
    items = F.flatten(F.transform(hm.json_ld_blocks(tx.col(html)), lambda b: F.coalesce(
        F.from_json(b, _LD_ITEMS), F.array().cast(_LD_ITEMS)
    )))
    names = F.flatten(F.transform(items, lambda i: F.when(
        i["@type"].startswith("["), F.from_json(i["@type"], "array<string>")
    ).otherwise(F.array(i["@type"]))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull())))


def extract_phones(text, limit: int | None = None) -> Column:
    found = F.regexp_extract_all(tx.col(text), F.lit("(?U)" + cat.PHONE_PATTERN), F.lit(0))
    return tx.head(F.array_sort(F.array_distinct(found)), limit)


def extract_hours(text, limit: int | None = None) -> Column:
    found = F.regexp_extract_all(tx.col(text), F.lit("(?iU)" + cat.HOURS_TEXT_PATTERN), F.lit(0))
    return tx.head(F.array_sort(F.array_distinct(F.transform(found, lambda t: F.trim(t)))), limit)


# --- page evidence and dossiers ------------------------------------------------------------------------------

def page_extract(pages: DataFrame) -> DataFrame:
    """One evidence row per page (columns store_id, page_no, url, html, status_code).

    The scan text is the page text after its title and descriptions.
    """
    rows = pages.withColumn("t", hm.page_text("html")).withColumn("links", hm.anchors(F.col("html")))
    head = [hm.meta_content(F.col("html"), "name", "description"), hm.meta_content(F.col("html"), "name", "keywords"),
            hm.meta_content(F.col("html"), "property", "og:description")]
    shown = [F.when(c != "", c) for c in head]
    rows = rows.withColumn("scan", F.concat_ws(" ", hm.title(F.col("html")), *shown, F.col("t.text")))
    return rows.select(
        "store_id", "page_no", "url", "status_code", hm.title(F.col("html")).alias("title"),
        dossier_description("html", "t.spaced").alias("description"),
        F.array_sort(scan_categories("scan", cat.WIDE_PRODUCT_CATALOG)).alias("products"),
        F.array_sort(scan_categories("scan", cat.EVENT_CATALOG)).alias("event_types"),
        event_links("html", "url", links=F.col("links")).alias("event_urls"), extract_phones("scan").alias("phones"),
        extract_hours("scan").alias("hours_text"), json_ld_types("html").alias("json_ld_types"),
    )


def evidence_values(evidence: DataFrame) -> DataFrame:
    """Distinct (store_id, kind, value) rows of all lists of the page evidence.

    A site may have any number of pages, so phones, hours and types stay rows instead of one array per store.
    """
    def marked(kind: str) -> Column:
        return F.transform(kind, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    lists = ["products", "event_types", "phones", "hours_text", "json_ld_types"]
    rows = evidence.select("store_id", F.explode(F.concat(*[marked(c) for c in lists])).alias("m"))
    return rows.select("store_id", "m.kind", "m.value").distinct()


def collapse_page_evidence(evidence: DataFrame) -> DataFrame:
    """Page evidence to one row per store: products and event types, counts of the open-ended lists, and the first
    description and event link by page order. The values behind the counts are in ``evidence_values``.
    """
    kind = F.col("kind")
    listed = lambda k: F.array_sort(F.collect_set(F.when(kind == k, F.col("value")))).alias(k)
    counted = lambda k: F.count_if(kind == k).alias(k)
    # Products and event types come from catalogs, so their arrays are short.
    unions = evidence_values(evidence).groupBy("store_id").agg(
        listed("products"), listed("event_types"), counted("phones"), counted("hours_text"), counted("json_ld_types")
    )
    first = lambda value: F.min(F.when(value.isNotNull(), F.struct(F.col("page_no"), value.alias("v"))))["v"]
    single = evidence.groupBy("store_id").agg(
        F.count("*").alias("pages"), first(F.col("description")).alias("description"),
        first(F.get("event_urls", F.lit(0))).alias("event_url"),
    )
    empty, none = F.array().cast("array<string>"), F.lit(0).cast("bigint")
    return single.join(unions, "store_id", "left").withColumns({
        "products": F.coalesce("products", empty), "event_types": F.coalesce("event_types", empty),
        "phones": F.coalesce("phones", none), "hours_text": F.coalesce("hours_text", none),
        "json_ld_types": F.coalesce("json_ld_types", none),
    })


def dossier_confidence(pages, description, products, has_events, dated_events, phones, hours_text) -> Column:
    """Weight of the evidence, at most 1, in hundredths (whole numbers, so no rounding noise). The last three are counts."""
    points = (
        F.when(pages > 0, 20).otherwise(0) + F.when(tx.present(description), 10).otherwise(0)
        + F.least(F.lit(30), F.size(products) * 10) + F.when(has_events, 20).otherwise(0)
        + F.when(dated_events > 0, 10).otherwise(0) + F.when(phones > 0, 10).otherwise(0)
        + F.when(hours_text > 0, 10).otherwise(0)
    )
    return F.least(points, F.lit(100)) / 100


def recommend_next_step(confidence, products, has_events, pages) -> Column:
    return (
        F.when((confidence >= 0.65) & (F.size(products) > 0), "review_for_reactivation")
        .when((pages > 0) & ((F.size(products) > 0) | has_events), "keep_suppressed_enriched")
        .otherwise("manual_review")
    )


def dossiers(evidence: DataFrame, dated_events: DataFrame | None = None) -> DataFrame:
    """Store evidence with events, confidence and the recommended next step.

    ``dated_events`` has one row per event instance (store_id).
    """
    rows = collapse_page_evidence(evidence)
    if dated_events is None:
        rows = rows.withColumn("dated_events", F.lit(0).cast("bigint"))
    else:
        counts = dated_events.groupBy("store_id").agg(F.count("*").alias("dated_events"))
        rows = rows.join(counts, "store_id", "left").withColumn("dated_events", F.coalesce("dated_events", F.lit(0)))
    has = (F.size("event_types") > 0) | F.col("event_url").isNotNull() | (F.col("dated_events") > 0)
    rows = rows.withColumn("has_events", has)
    rows = rows.withColumn("confidence", dossier_confidence(
        F.col("pages"), F.col("description"), F.col("products"), F.col("has_events"), F.col("dated_events"), F.col("phones"),
        F.col("hours_text"),
    ))
    return rows.withColumn("next_step", recommend_next_step(
        F.col("confidence"), F.col("products"), F.col("has_events"), F.col("pages")
    ))


# --- event calendars -----------------------------------------------------------------------------------------

CALENDARS = (
    "store_id string, source_url string, calendar_id string, timezone string, service_id string, title string, location string,"
    " product_url string, description string"
)


def extract_calendars(pages: DataFrame) -> DataFrame:
    """Services of the event calendars that pages assign to numbered script variables: one row per service.

    The JSON ends where its value ends, so it is decoded by a JSON reader over Arrow batches.
    """
    def read(batches):
        import json
        import re

        decoder = json.JSONDecoder()

        def assigned(html: str, name: str):
            at = html.find(f"window.{name}")
            at = html.find("=", at) + 1 if at >= 0 else 0
            if not at:
                return None
            while at < len(html) and html[at].isspace():
                at += 1
            try:
                return decoder.raw_decode(html, at)[0]
            except json.JSONDecodeError:
                return None

        text = lambda v: v if isinstance(v, str) else None
        for batch in batches:
            out = []
            for store, url, html in zip(batch.store_id, batch.url, batch.html, strict=True):
                numbers = sorted(set(re.findall(r"window\.cowEventCal(\d+)_(?:config|services)\s*=", html or "")))
                for number in numbers:
                    config = assigned(html, f"cowEventCal{number}_config")
                    services = assigned(html, f"cowEventCal{number}_services")
                    if not isinstance(config, dict) or not isinstance(services, list) or not text(config.get("_id")):
                        continue
                    for s in services:
                        if isinstance(s, dict):
                            out.append((store, url, config["_id"], text(config.get("timezone")), text(s.get("_id")),
                                        str(s.get("title") or "Untitled event"), text(s.get("location")),
                                        text(s.get("product_url")) or None, text(s.get("description"))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CALENDARS.split(", ")])

    return pages.filter(F.contains("html", F.lit("cowEventCal"))).select("store_id", "url", "html").mapInPandas(read, CALENDARS)


def calendar_periods(calendars: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(calendar_id, period) months that the next ``days`` days of a calendar touch, in its own time zone."""
    local = _local_day(as_of)
    start, end = F.trunc(local, "month"), F.trunc(F.date_add(local, days), "month")
    months = F.sequence(start, end, F.expr("interval 1 month"))
    return calendars.select("calendar_id", F.explode(months).alias("m"), "timezone").distinct().select(
        "calendar_id", F.date_format("m", "yyyy-MM").alias("period")
    )


def _local_day(as_of: str) -> Column:
    """Today in the calendar's zone; unknown zones count as UTC."""
    known = F.coalesce(F.col("timezone"), F.lit("UTC"))
    known = F.when(known.rlike(r"^[A-Za-z_]+(/[A-Za-z_+\-0-9]+)*$"), known).otherwise("UTC")
    return F.to_date(F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), known))


def event_instances(calendars: DataFrame, raw_events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Dated events of the next ``days`` days, one per (calendar, service, start, end).

    ``raw_events`` has calendar_id, service_id, event_id, start_date, end_date, status, price, is_not_bookable; events
    of unknown services and without a readable date are left out.
    """
    services = calendars.groupBy("store_id", "calendar_id", "service_id").agg(
        F.min(F.struct("source_url", "timezone", "title", "location", "product_url", "description")).alias("s")
    ).select("store_id", "calendar_id", "service_id", "s.*")
    day = F.try_to_timestamp(F.substring("start_date", 1, 16), F.lit("yyyy-MM-dd HH:mm")).cast("date")
    dated = raw_events.withColumn("day", day).filter(F.col("day").isNotNull() & F.col("end_date").isNotNull())
    once = dated.groupBy("calendar_id", "service_id", "start_date", "end_date", "day").agg(
        F.min(F.struct("event_id", "status", "price", "is_not_bookable")).alias("e")
    ).select("calendar_id", "service_id", "start_date", "end_date", "day", "e.*")
    today = _local_day(as_of)
    j = once.join(services, ["calendar_id", "service_id"]).filter(F.col("day").between(today, F.date_add(today, days)))
    origin = tx.base_url(F.col("source_url"))
    return j.select(
        "store_id", "title", "start_date", "end_date", F.coalesce("timezone", F.lit("UTC")).alias("timezone"), "source_url",
        "service_id", "event_id", "status", "price", "location",
        F.when(F.col("product_url").isNotNull(), F.concat(origin, F.lit("/products/"), "product_url")).alias("product_url"),
        "description", "is_not_bookable",
    )
