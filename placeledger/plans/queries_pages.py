"""Registered queries for page evidence: catalogs, links, platform, singles, content, dates, prices, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions import dates as dt
from placeledger.functions import html as hm
from placeledger.operators import filters as fl
from placeledger.operators import pages as pg
from placeledger.plans.queries_directory import _re
from placeledger.plans.registry import query
from placeledger.plans.views import AS_OF
from placeledger.sources import raw as rw


def _scan(column: str, catalog) -> str:
    """Check SQL: catalog keys that occur, as one text."""
    keys = ", ".join(f"CASE WHEN regexp_matches({column}, {_re(ps)}) THEN '{k}' END" for k, ps in catalog)
    return f"array_to_string([x FOR x IN [{keys}] IF x IS NOT NULL], ',')"


def _product_pages(d):
    return d.site_pages.withColumn("page_no", F.col("page_id"))


@query(f"SELECT page_id, regexp_matches(html, {_re(cat.SOFT_404_PATTERNS)}) AS soft, regexp_matches(html, {_re(cat.PARKED_PATTERNS)}) AS parked FROM site_pages")
def dead_pages(d):
    return d.site_pages.select("page_id", fl.soft_404("html").alias("soft"), fl.parked("html").alias("parked"))


@query(f"SELECT page_id, {_scan('html', cat.PRODUCT_CATALOG)} AS products FROM site_pages")
def scan_categories(d):
    return d.site_pages.select("page_id", F.array_join(pg.scan_categories("html"), ",").alias("products"))


@query(f"SELECT doc_id, {_scan('text', cat.WIDE_PRODUCT_CATALOG)} AS products, {_scan('text', cat.EVENT_CATALOG)} AS events FROM documents")
def scan_documents(d):
    return d.documents.select(
        "doc_id", F.array_join(pg.scan_categories("text", cat.WIDE_PRODUCT_CATALOG), ",").alias("products"),
        F.array_join(pg.scan_categories("text", cat.EVENT_CATALOG), ",").alias("events"),
    )


def _snippets(column: str, catalog) -> str:
    """Check SQL: list of (category, first matching text) over a catalog."""
    def first(patterns) -> str:
        return "coalesce(" + ", ".join(f"nullif(regexp_extract({column}, '(?i){p}', 0), '')" for p in patterns) + ")"

    return "[" + ", ".join(f"{{'k': '{k}', 'm': {first(ps)}}}" for k, ps in catalog) + "]"


@query(f"""
SELECT page_id, s.k AS category, trim(regexp_replace(substr(html, lo, hi - lo + 1), '\\s+', ' ', 'g')) AS snippet FROM (
  SELECT *, greatest(pos - 60, 1) AS lo, least(pos + length(s.m) + 59, length(html)) AS hi FROM (
    SELECT page_id, html, s, strpos(lower(html), lower(s.m)) AS pos FROM (
      SELECT page_id, html, unnest({_snippets('html', cat.WIDE_PRODUCT_CATALOG)}) AS s FROM site_pages) WHERE s.m IS NOT NULL))
""")
def scan_snippets(d):
    return d.site_pages.select("page_id", F.explode(pg.scan_snippets("html")).alias("s")).select("page_id", "s.*")


@query("""
SELECT page_id, array_to_string([CASE WHEN starts_with(h, '/') THEN rtrim(url, '/') || h ELSE h END
  FOR h IN regexp_extract_all(html, '<a href="([^"]*)"', 1) IF regexp_matches(lower(h), '/product|/card|/item|/p/')], ' ') AS links
FROM site_pages
""")
def product_links(d):
    return d.site_pages.select("page_id", F.array_join(pg.product_links("html", "url"), " ").alias("links"))


_ORIGIN = "regexp_extract(url, '^([a-z]+://)', 1) || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query(f"""
SELECT page_id, array_to_string(list_sort(list_distinct([{_ORIGIN} || regexp_extract(a, '<a href="([^"?#]*)', 1)
  FOR a IN regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') IF regexp_matches(lower(a), 'href=".*(event|calendar|tournament).*</a>')])), ' ') AS links
FROM site_pages
""")
def event_links(d):
    return d.site_pages.select("page_id", F.array_join(F.array_sort(pg.event_links("html", "url")), " ").alias("links"))


@query(f"""
WITH tags AS (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS list FROM site_pages),
one AS (SELECT page_id, url, unnest(list) AS a, generate_subscripts(list, 1) AS i FROM tags),
found AS (SELECT page_id, {_ORIGIN} || regexp_extract(a, '<a href="([^"?#]*)', 1) AS link, min(i) AS i FROM one
  WHERE regexp_matches(lower(regexp_extract(a, 'href="(.*)</a>', 1)), '{"|".join(cat.USEFUL_LINK_HINTS)}') GROUP BY ALL)
SELECT page_id, link FROM found
""")
def useful_links(d):
    return d.site_pages.select("page_id", F.explode(pg.useful_links("html", "url")).alias("link"))


_EVENTS = f"""
  SELECT *, [CASE WHEN starts_with(h, '/') THEN rtrim(url, '/') || h ELSE h END FOR h IN
      regexp_extract_all(html, '<a href="([^"]*)"', 1) IF regexp_matches(h, {_re(cat.EVENT_PATH_PATTERNS)})][1] AS event_url,
    regexp_matches(html, {_re(cat.EVENT_TEXT_PATTERNS)}) AS event_words, error IS NOT NULL OR coalesce(status_code >= 400, false) AS failed FROM site_pages
"""


@query(f"SELECT page_id, event_url IS NOT NULL OR event_words AS has_events, event_url FROM ({_EVENTS})")
def detect_events(d):
    return d.site_pages.select("page_id", pg.detect_events("html", "url").alias("e")).select("page_id", "e.*")


@query(f"""
SELECT page_id, CASE WHEN contains(html, 'window.location.href') THEN {_ORIGIN} || '/home' END AS target FROM site_pages
""")
def script_redirect(d):
    return d.site_pages.select("page_id", pg.script_redirect("html", "url").alias("target"))


@query("""
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)crystalcommerce\\.com|cc-product-list') THEN 'crystal_commerce'
  WHEN regexp_matches(html || ' ' || url, '(?i)/products\\.json') OR regexp_matches(html, '(?i)binderpos\\.com') THEN 'binderpos'
  WHEN regexp_matches(html, '(?i)cdn\\.shopify\\.com|Shopify\\.theme') OR regexp_matches(x_shopid, '\\d') THEN 'shopify'
  WHEN regexp_matches(html, '(?i)wc-add-to-cart|wp-content/plugins/woocommerce') THEN 'woocommerce'
  WHEN regexp_matches(html, '(?i)squarespace\\.com') THEN 'squarespace' WHEN regexp_matches(html, '(?i)wp-content') THEN 'wordpress_stripe'
  ELSE 'unknown' END AS platform FROM site_pages
""")
def detect_platform(d):
    headers = F.create_map(F.lit("x-shopid"), F.col("x_shopid"))
    return d.site_pages.select("page_id", pg.detect_platform("html", headers, "url").alias("platform"))


def _count(column: str, patterns) -> str:
    one = lambda p, i: f"CASE WHEN regexp_matches({column}, '{'(?i)' if i else ''}{p}') THEN 1 ELSE 0 END"
    return "(" + " + ".join(one(*p) if isinstance(p, tuple) else one(p, True) for p in patterns) + ")"


_WORDS = f"SELECT *, {_count('html', cat.SINGLES_KEYWORDS)} AS n, error IS NOT NULL OR coalesce(status_code >= 400, false) AS failed FROM site_pages"


@query(f"SELECT page_id, CASE WHEN n >= 2 THEN 'medium' WHEN n = 1 THEN 'small' END AS size, CASE WHEN n >= 2 THEN 0.85e0 WHEN n = 1 THEN 0.6e0 END AS confidence FROM ({_WORDS})")
def singles_by_keywords(d):
    return d.site_pages.select("page_id", pg.singles_by_keywords("html").alias("v")).select("page_id", "v.size", "v.confidence")


_SAMPLED = f"""
  SELECT store_id, count(*) AS checked, count(*) FILTER (WHERE a >= 2 OR (a >= 1 AND s >= 1)) AS cards FROM (
    SELECT *, {_count('html', cat.CARD_ATTRIBUTE_PATTERNS)} AS a, {_count('html', cat.CARD_SET_PATTERNS)} AS s,
      row_number() OVER (PARTITION BY store_id ORDER BY page_id) AS r FROM site_pages) WHERE r <= 5 AND status_code < 400
  GROUP BY store_id HAVING cards > 0 AND cards / checked >= 0.5
"""


@query(f"SELECT store_id, CASE WHEN cards >= 3 THEN 'medium' ELSE 'small' END AS size, least(0.95e0, 0.7e0 + cards::DOUBLE / checked * 0.25e0) AS confidence FROM ({_SAMPLED})")
def singles_by_samples(d):
    out = pg.singles_by_samples(_product_pages(d))
    return out.select("store_id", "sample.size", "sample.confidence")


@query(f"""
SELECT w.page_id, CASE WHEN failed THEN 'none' WHEN n >= 2 THEN 'keyword' WHEN c.cards IS NOT NULL THEN 'product_sample'
    WHEN n = 1 THEN 'keyword' ELSE 'none' END AS method,
  NOT failed AND (n >= 1 OR c.cards IS NOT NULL) AS sells, NOT failed AND n < 2 AND c.cards IS NULL AS escalate
FROM ({_WORDS}) w LEFT JOIN ({_SAMPLED}) c ON c.store_id = w.store_id
""")
def detect_singles(d):
    out = pg.detect_singles(d.site_pages, _product_pages(d))
    return out.select("page_id", "singles.method", "singles.sells", "escalate")


@query(f"""
SELECT page_id, CASE WHEN failed THEN '' ELSE p END AS products, NOT failed AND (event_url IS NOT NULL OR event_words) AS has_events,
  CASE WHEN failed THEN 0e0 WHEN n >= 2 THEN 0.8e0 WHEN n = 1 THEN 0.5e0 ELSE 0.3e0 END AS confidence,
  CASE WHEN failed OR n = 0 THEN 'none' ELSE 'keyword' END AS method, NOT failed AND n < 2 AS escalate
FROM (SELECT *, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ',')) END AS n FROM (SELECT *, {_scan('html', cat.PRODUCT_CATALOG)} AS p FROM ({_EVENTS})))
""")
def extract_content(d):
    out = pg.extract_content(d.site_pages)
    return out.select("page_id", F.array_join("products", ",").alias("products"), "has_events", "confidence", "method", "escalate")


@query()
def extract_description(d):
    rows = d.site_pages.withColumn("t", hm.page_text("html"))
    return rows.select("page_id", pg.extract_description("html", "t.tight").alias("description"))


# --- dates ---------------------------------------------------------------------------------------------------

@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS http_day,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso_day,
  CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS page_day FROM orders
""")
def parse_dates(d):
    day = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey")
    http = (
        F.when(k % 5 == 0, F.concat(day("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(k % 5 == 1, F.concat(day("EEEE, dd-MMM-yy HH:mm:ss"), F.lit(" GMT")))
        .when(k % 5 == 2, day("EEE MMM d HH:mm:ss yyyy")).when(k % 5 == 3, F.concat(day("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" UTC")))
        .otherwise(day("yyyy/MM/dd"))
    )
    iso = (
        F.when(k % 4 == 0, day("yyyy-MM-dd")).when(k % 4 == 1, day("yyyy-MM-dd'T'HH:mm:ss"))
        .when(k % 4 == 2, F.concat(day("yyyy-MM-dd'T'12:00:00"), F.lit("+0200"))).otherwise(day("dd.MM.yyyy"))
    )
    page = (
        F.when(k % 6 == 0, day("MMMM d, yyyy")).when(k % 6 == 1, day("MMM d yyyy")).when(k % 6 == 2, day("M/d/yyyy"))
        .when(k % 6 == 3, day("MM-dd-yyyy")).when(k % 6 == 4, day("M/d/yy")).otherwise(day("yyyy.MM.dd"))
    )
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return d.orders.select(
        k.alias("id"), text(dt.parse_http_date(http)).alias("http_day"), text(dt.parse_iso_date(iso)).alias("iso_day"),
        text(dt.parse_page_date(page)).alias("page_day"),
    )


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(greatest(o_orderdate, TIMESTAMP '1995-06-15'), '%Y-%m-%d') END AS day FROM orders
""")
def sitemap_lastmod(d):
    xml = F.concat(
        F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><lastmod>'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("</lastmod></url><url><lastmod>1995-06-15</lastmod></url><url><lastmod>soon</lastmod></url>"),
        F.when(F.col("o_orderkey") % 7 != 0, "</urlset>\n").otherwise("<url><lastmod>1999-0"),
    )
    return d.orders.select(F.col("o_orderkey").alias("id"), F.date_format(dt.sitemap_lastmod(xml), "yyyy-MM-dd").alias("day"))


_STAMP = """
  SELECT *, CASE page_id % 9 WHEN 2 THEN '2023-03-05' WHEN 4 THEN '2022-03-15' WHEN 6 THEN '2021-07-04' END AS dated,
    CASE WHEN page_id % 3 = 0 THEN '2023-01-01' END AS copied FROM site_pages
"""


@query(f"""
SELECT page_id, coalesce(dated, copied) AS day, CASE WHEN dated IS NOT NULL THEN 'page_timestamp' WHEN copied IS NOT NULL THEN 'copyright' ELSE 'none' END AS method
FROM ({_STAMP})
""")
def page_timestamp(d):
    return d.site_pages.select("page_id", dt.page_timestamp(F.col("html")).alias("p")).select(
        "page_id", F.date_format("p.stamp", "yyyy-MM-dd").alias("day"), "p.method"
    )


@query(f"""
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '2022-11-15 08:12:31' WHEN page_id % 5 < 3 THEN '2022-11-06 08:49:37'
    ELSE coalesce(dated, copied) || ' 00:00:00' END AS last_update,
  CASE WHEN page_id % 5 < 3 THEN 0.7e0 WHEN dated IS NOT NULL THEN 0.5e0 WHEN copied IS NOT NULL THEN 0.2e0 ELSE 0e0 END AS confidence,
  CASE WHEN page_id % 5 < 3 THEN 'http_header' WHEN dated IS NOT NULL THEN 'page_timestamp' WHEN copied IS NOT NULL THEN 'copyright' ELSE 'none' END AS method
FROM ({_STAMP})
""")
def freshness(d):
    f = pg.freshness("last_modified", F.lit(None).cast("string"), "html")
    return d.site_pages.select("page_id", f.alias("f")).select(
        "page_id", F.date_format("f.last_update", "yyyy-MM-dd HH:mm:ss").alias("last_update"), "f.confidence", "f.method"
    )


# --- prices and structured data ------------------------------------------------------------------------------

@query("""
SELECT page_id, card_name, found, CASE WHEN NOT found THEN NULL WHEN page_id % 7 = 0 THEN 1.5e0 + page_id % 90
    WHEN page_id % 8 = 6 THEN 3.25e0 ELSE 1.75e0 END AS store_price,
  CASE WHEN NOT found THEN 'none' WHEN page_id % 7 = 0 THEN 'json_ld' WHEN page_id % 8 = 6 THEN 'regex' ELSE 'css_selector' END AS method
FROM (SELECT page_id, card_name, contains(lower(html), lower(card_name)) AS found FROM site_pages,
  (SELECT unnest(['Lightning Bolt', 'Counterspell', 'Sol Ring', 'Thoughtseize', 'Collected Company', 'Cyclonic Rift', 'Arid Mesa',
    'Ragavan, Nimble Pilferer']) AS card_name))
""")
def extract_price(d):
    rows = d.site_pages.select("page_id", "html", F.lit("shopify").alias("platform"))
    return pg.card_prices(rows).drop("platform")


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Product' ELSE '' END AS types FROM site_pages")
def json_ld_types(d):
    return d.site_pages.select("page_id", F.array_join(pg.json_ld_types("html"), ",").alias("types"))


@query(f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{cat.PHONE_PATTERN}'))), '|') AS phones FROM documents
""")
def extract_phones(d):
    return d.documents.select("doc_id", F.array_join(pg.extract_phones("text"), "|").alias("phones"))


@query(f"""
SELECT page_id, array_to_string(list_sort(list_distinct([trim(x) FOR x IN regexp_extract_all(html, '(?i){cat.HOURS_TEXT_PATTERN}')])), '|') AS lines
FROM site_pages
""")
def extract_hours(d):
    return d.site_pages.select("page_id", F.array_join(pg.extract_hours("html"), "|").alias("lines"))


def _evidence(d):
    return pg.page_extract(d.site_pages.withColumn("page_no", F.col("page_id")))


@query()
def page_extract(d):
    return _evidence(d)


@query("""
SELECT store_id, count(*) AS pages, max(CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END) AS types FROM site_pages GROUP BY store_id
""")
def collapse_page_evidence(d):
    out = pg.collapse_page_evidence(_evidence(d))
    return out.select("store_id", "pages", F.col("json_ld_types").alias("types"))


@query()
def evidence_values(d):
    return pg.evidence_values(_evidence(d))


@query()
def dossiers(d):
    return pg.dossiers(_evidence(d))


@query("""
SELECT id, confidence, CASE WHEN confidence >= 0.65 AND n > 0 THEN 'review_for_reactivation' WHEN pages > 0 AND (n > 0 OR has) THEN 'keep_suppressed_enriched'
    ELSE 'manual_review' END AS next_step,
  CASE WHEN confidence >= 0.65 AND n > 0 THEN 'auto_apply' WHEN pages = 0 THEN 'retry_or_debug' WHEN n = 0 AND NOT has THEN 'not_lgs_or_manual_review'
    ELSE 'manual_review' END AS action
FROM (SELECT *, (CASE WHEN pages > 0 THEN 20 ELSE 0 END + CASE WHEN description <> '' THEN 10 ELSE 0 END + least(30, 10 * n) + CASE WHEN has THEN 20 ELSE 0 END
    + CASE WHEN phone IS NOT NULL THEN 20 ELSE 0 END) / 100.0e0 AS confidence
  FROM (SELECT s.id, s.phone, CAST(s.id AS BIGINT) % 3 AS pages, coalesce(json_array_length(r.payload->'products'), 0) AS n,
          coalesce(r.payload->>'has_events' = 'true', false) AS has, r.payload->>'description' AS description
        FROM stores s LEFT JOIN (SELECT * FROM store_external_refs WHERE provider = 'website_content') r ON r.store_id = s.id))
""")
def dossier_scores(d):
    """Confidence, next step and action from the stored site content; a phone stands for phones and hours."""
    content = fl.content_refs(d.store_external_refs).select(F.col("store_id").alias("id"), "content")
    j = d.stores.select("id", "phone").join(content, "id", "left").withColumns({
        "pages": F.col("id").cast("bigint") % 3, "products": F.coalesce("content.products", F.array().cast("array<string>")),
        "has": F.coalesce("content.has_events", F.lit(False)),
    })
    lines = F.col("phone").isNotNull().cast("int")
    j = j.withColumn("confidence", pg.dossier_confidence(
        F.col("pages"), F.col("content.description"), F.col("products"), F.col("has"), F.lit(0), lines, lines
    ))
    return j.select(
        "id", "confidence", pg.recommend_next_step(F.col("confidence"), F.col("products"), F.col("has"), F.col("pages")).alias("next_step"),
        rw.dossier_action(F.col("confidence"), F.size("products"), F.col("pages"), F.col("has")).alias("action"),
    )


# --- calendars -----------------------------------------------------------------------------------------------

_CAL = """
  SELECT CAST(s_suppkey AS VARCHAR) AS store_id, 'cal' || s_suppkey AS calendar_id, unnest(['a', 'b']) AS service_id,
    CASE s_suppkey % 3 WHEN 0 THEN 'America/Chicago' WHEN 1 THEN 'UTC' END AS timezone FROM supplier
"""


@query(f"SELECT store_id, calendar_id, service_id, timezone, CASE service_id WHEN 'a' THEN 'Draft' ELSE 'Untitled event' END AS title FROM ({_CAL})")
def extract_calendars(d):
    return pg.extract_calendars(d.calendar_pages).select("store_id", "calendar_id", "service_id", "timezone", "title")


_CAL_AT = "2024-01-10 03:00:00"


@query(f"SELECT DISTINCT calendar_id, unnest(['2024-01', '2024-02']) AS period FROM ({_CAL})")
def calendar_periods(d):
    return pg.calendar_periods(pg.extract_calendars(d.calendar_pages), _CAL_AT)


@query(f"""
SELECT store_id, start_date, end_date, service_id, min(event_id) AS event_id,
  CASE service_id WHEN 'a' THEN 'https://www.shop' || store_id || '.example.com/products/draft' END AS product_url
FROM calendar_events e JOIN ({_CAL}) c USING (calendar_id, service_id)
WHERE end_date IS NOT NULL AND left(start_date, 10) >= CASE WHEN timezone = 'America/Chicago' THEN '2024-01-09' ELSE '2024-01-10' END
  AND left(start_date, 10) <= CASE WHEN timezone = 'America/Chicago' THEN '2024-01-16' ELSE '2024-01-17' END
GROUP BY store_id, start_date, end_date, service_id
""")
def event_instances(d):
    out = pg.event_instances(pg.extract_calendars(d.calendar_pages), d.calendar_events, _CAL_AT, days=7)
    return out.select("store_id", "start_date", "end_date", "service_id", "event_id", "product_url")
