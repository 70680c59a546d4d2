"""Registered queries for the record parsers and the name, address, URL, slug and display transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions import text as tx
from placeledger.operators import lifecycle as lc
from placeledger.plans.queries_directory import CITY_SLUG, STATE_SLUGS, _PUBLIC, sql_in, sql_map
from placeledger.plans.registry import query
from placeledger.sources import raw as rw


def wpn(d):
    """The locator view in the shape of the raw records."""
    return d.wpn_raw.select(
        "id", "name", F.col("postal_address").alias("postalAddress"), "latitude", "longitude",
        F.col("is_premium").alias("isPremium"), F.col("phone_number").alias("phoneNumber"),
        F.lit(None).cast("string").alias("emailAddress"), "website", F.col("id").cast("bigint").alias("seq"),
    )


def google(d):
    """The places view in the shape of the raw records."""
    return d.google_raw.select(
        "id", F.struct(F.col("display_name").alias("text")).alias("displayName"),
        F.col("formatted_address").alias("formattedAddress"), F.col("national_phone").alias("nationalPhoneNumber"),
        F.col("website_uri").alias("websiteUri"), F.struct("latitude", "longitude").alias("location"), "rating",
        F.filter(F.split("type_list", ","), lambda t: t != "").alias("types"),
    )


@query("""
SELECT id, name, p[1] AS street, CASE WHEN n >= 3 THEN p[2] ELSE '' END AS city, CASE WHEN n >= 3 THEN p[3] ELSE '' END AS state,
  CASE WHEN n >= 4 THEN p[4] ELSE '' END AS zip_code, CASE WHEN n >= 5 THEN p[5] ELSE '' END AS country,
  CASE WHEN is_premium THEN 'premium' ELSE 'core' END AS wpn_level
FROM (SELECT *, [trim(x) FOR x IN string_split(postal_address, ',')] AS p, len(string_split(postal_address, ',')) AS n FROM wpn_raw)
WHERE postal_address <> '' AND p[1] <> '' AND name <> ''
""")
def parse_wpn(d):
    return rw.parse_wpn(wpn(d)).select(
        F.col("external_id").alias("id"), "name", "street", "city", "state", "zip_code", "country", "wpn_level"
    )


_FORMATTED = "'^(.+?),\\s*([^,]+),\\s*([A-Z]{2})\\s+(\\d{5}(?:-\\d{4})?)'"


@query(f"""
SELECT id, display_name AS name, latitude, longitude,
  CASE WHEN ok THEN trim(regexp_extract(formatted_address, {_FORMATTED}, 1)) END AS street,
  CASE WHEN ok THEN trim(regexp_extract(formatted_address, {_FORMATTED}, 2)) END AS city,
  CASE WHEN ok THEN regexp_extract(formatted_address, {_FORMATTED}, 3) END AS state,
  CASE WHEN ok THEN left(regexp_extract(formatted_address, {_FORMATTED}, 4), 5) END AS zip_code
FROM (SELECT *, regexp_matches(formatted_address, {_FORMATTED}) AS ok FROM google_raw)
WHERE id <> '' AND display_name <> '' AND formatted_address <> ''
""")
def parse_google(d):
    return rw.parse_google(google(d)).select(
        F.col("external_id").alias("id"), "name", "latitude", "longitude", "street", "city", "state", "zip_code"
    )


@query(f"""
SELECT 'GW' || id AS id, name, street, city, state, CASE WHEN wpn_level = 'premium' THEN 'GW Store' ELSE 'Independent Retailer' END AS store_type
FROM stores WHERE length(state) = 2 AND CAST(id AS BIGINT) % 5 <> 4 AND CAST(id AS BIGINT) % 23 <> 5
""")
def parse_gw(d):
    k = F.col("id").cast("bigint")
    records = d.stores.select(
        F.concat(F.lit("GW"), "id").alias("objectID"), F.when(k % 2 == 0, F.col("name")).otherwise("").alias("displayName"),
        "name", F.col("street").alias("addressLine1"), F.when(k % 23 != 5, F.col("city")).otherwise("").alias("city"),
        F.col("state").alias("region"), F.col("zip_code").alias("postalCode"),
        F.when(k % 5 == 4, "CA").otherwise("US").alias("countryCode"), "phone", F.lit(None).cast("string").alias("websiteUrl"),
        F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lng")).alias("_geoloc"),
        (F.col("wpn_level") == "premium").alias("isWarHammerStore"),
    )
    return rw.parse_gw(records).select(F.col("external_id").alias("id"), "name", "street", "city", "state", "store_type")


@query("""
SELECT id, display_name AS name, p[1] AS street, p[2] AS city, regexp_extract(formatted_address, ',\\s*([A-Z]{2})\\s+\\d{5}', 1) AS state,
  regexp_extract(formatted_address, '\\b(\\d{5})(?:-\\d{4})?\\b', 1) AS zip_code
FROM (SELECT *, [trim(x) FOR x IN string_split(formatted_address, ',')] AS p FROM google_raw)
WHERE id <> '' AND display_name <> '' AND formatted_address <> '' AND p[1] <> '' AND p[2] <> ''
""")
def google_to_vertical(d):
    return rw.google_to_vertical(google(d), "comicbookstores").select(
        F.col("external_id").alias("id"), "name", "street", "city", "state", "zip_code"
    )


_WPN_PARTS = """
  SELECT id, [trim(x) FOR x IN string_split(postal_address, ',')] AS p FROM wpn_raw
"""


@query(f"""
SELECT id, CASE WHEN ok THEN street END AS street, CASE WHEN ok THEN city END AS city, CASE WHEN ok THEN state END AS state,
  CASE WHEN ok THEN zip_code END AS zip_code
FROM (SELECT *, length(street) BETWEEN 1 AND 255 AND length(city) BETWEEN 1 AND 100 AND regexp_matches(state, '^[A-Z]{{2}}$')
        AND regexp_matches(zip_code, '^[0-9]{{5}}$') AS ok
      FROM (SELECT id, p[1] AS street, p[2] AS city, left(upper(p[3]), 2) AS state,
              split_part(CASE WHEN length(p[4]) BETWEEN 1 AND 4 THEN lpad(p[4], 5, '0') ELSE p[4] END, '-', 1) AS zip_code
            FROM ({_WPN_PARTS})))
""")
def validate_address(d):
    parts = F.transform(F.split("postalAddress", ","), lambda p: F.trim(p))
    out = wpn(d).withColumn("p", parts).select("id", tx.validate_address(F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.get("p", F.lit(2)), F.get("p", F.lit(3))).alias("a"))
    return out.select("id", "a.street", "a.city", "a.state", "a.zip_code")


def _expanded(bare: str) -> str:
    """SQL that expands street words token by token."""
    table = sql_map(cat.STREET_WORDS)
    return f"array_to_string([coalesce({table}[w], w) FOR w IN string_split({bare}, ' ')], ' ')"


_SUITE = "'(?i)\\b(?:STE|SUITE|UNIT|APT|APARTMENT|#|BLDG|BUILDING|FLOOR|FLR|RM|ROOM)\\b\\.?\\s*\\S*'"
_COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _plain(c: str) -> str:
    return f"regexp_replace(upper({c}), '[^\\w\\s]', ' ', 'g')"


@query(f"""
SELECT id, {_expanded(_COLLAPSE.format(f"regexp_replace({_plain('street')}, {_SUITE}, '', 'g')"))} AS street,
  {_COLLAPSE.format(_plain('city'))} AS city, state, zip_code, nullif(trim(regexp_extract({_plain('street')}, {_SUITE}, 0)), '') AS suite
FROM stores
""")
def normalize_address(d):
    a = tx.normalize_address("street", "city", "state", "zip_code")
    return d.stores.select("id", a.alias("a")).select("id", "a.street", "a.city", "a.state", "a.zip_code", "a.suite")


@query(f"""
SELECT c_custkey AS id, CASE WHEN length(s) = 2 THEN s ELSE {sql_map(cat.STATE_CODES)}[s] END AS state
FROM (SELECT c_custkey, upper(trim(CASE c_custkey % 4 WHEN 0 THEN 'Texas' WHEN 1 THEN ' or ' WHEN 2 THEN 'new york' ELSE c_mktsegment END)) AS s FROM customer)
""")
def normalize_state(d):
    word = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'Texas' WHEN 1 THEN ' or ' WHEN 2 THEN 'new york' ELSE c_mktsegment END")
    return d.customer.select(F.col("c_custkey").alias("id"), tx.normalize_state(word).alias("state"))


@query(f"SELECT id, CASE WHEN length(z) = 5 THEN z END AS zip_code FROM (SELECT id, split_part(trim(p[4]), '-', 1) AS z FROM ({_WPN_PARTS}))")
def normalize_zip(d):
    return wpn(d).withColumn("p", F.split("postalAddress", ",")).select("id", tx.normalize_zip(F.get("p", F.lit(3))).alias("zip_code"))


_NAME_WORDS = "'\\b(?:" + "|".join(cat.NAME_SUFFIX_WORDS) + ")\\b'"
NORM_NAME = _COLLAPSE.format(f"regexp_replace({_plain('name')}, {_NAME_WORDS}, '', 'g')")


@query(f"SELECT id, {NORM_NAME} AS name FROM stores")
def normalize_name(d):
    return d.stores.select("id", tx.normalize_name("name").alias("name"))


@query(f"""
SELECT id, regexp_matches(formatted_address, {_FORMATTED}) AS parsed FROM google_raw
""")
def parse_formatted_address(d):
    return d.google_raw.select("id", tx.parse_formatted_address("formatted_address").isNotNull().alias("parsed"))


_HOSTS = """
  SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM (
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.notwizards.com/x' WHEN 1 THEN 'https://Locator.Wizards.com/store?a=1#b'
      WHEN 2 THEN 'wizards.com/no-scheme' ELSE url END AS url FROM pages)
"""
_URLS = "CASE page_id % 6 WHEN 0 THEN 'https://www.notwizards.com/x' WHEN 1 THEN 'https://Locator.Wizards.com/store?a=1#b' WHEN 2 THEN 'wizards.com/no-scheme' ELSE url END"


@query(f"SELECT page_id, regexp_matches(host, '(^|\\.)wizards\\.com$') AS blocked FROM ({_HOSTS})")
def is_blocked_url(d):
    return d.pages.select("page_id", tx.is_blocked_url(F.expr(_URLS), cat.INGEST_BLOCKED_DOMAINS).alias("blocked"))


@query(f"""
SELECT page_id, CASE WHEN host <> '' THEN regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) ||
    coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') END AS clean,
  coalesce(nullif(regexp_extract(url, '^(.*?://[^/]*)', 1), ''), url) AS base,
  regexp_replace(host, '^www\\.', '') = 'notwizards.com' AS same
FROM ({_HOSTS})
""")
def clean_url(d):
    u = F.expr(_URLS)
    return d.pages.select("page_id", tx.clean_url(u).alias("clean"), tx.base_url(u).alias("base"),
                          tx.same_site(u, F.lit("http://notwizards.com/")).alias("same"))


def _slug_part(c: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower({c}), '[''\"]', '', 'g'), '[^a-z0-9 -]', ' ', 'g')),"
        f" '\\s+', '-', 'g'), '-{{2,}}', '-', 'g'), '-')"
    )


_LEGAL = "'(?i)[,\\s]+(l\\.?l\\.?c\\.?|inc\\.?|incorporated|corp\\.?|corporation|ltd\\.?|limited|co\\.?|company)\\s*$'"
@query(f"""
SELECT id, CASE WHEN ends_with('-' || n, '-' || c || '-' || s) THEN n WHEN ends_with('-' || n, '-' || c) THEN n || '-' || s
  ELSE n || '-' || c || '-' || s END AS slug
FROM (SELECT id, {_slug_part(f"regexp_replace(name, {_LEGAL}, '')")} AS n, {_slug_part('city')} AS c, lower(state) AS s FROM (
  SELECT id, CASE WHEN CAST(id AS BIGINT) % 10 = 1 THEN name || ' ' || city || ' ' || state WHEN CAST(id AS BIGINT) % 10 = 2 THEN name || ' ' || city
    ELSE name END AS name, city, state FROM stores))
""")
def build_slug(d):
    k = F.col("id").cast("bigint") % 10
    name = F.when(k == 1, F.concat_ws(" ", "name", "city", "state")).when(k == 2, F.concat_ws(" ", "name", "city")).otherwise(F.col("name"))
    return d.stores.select("id", tx.build_slug(name, "city", "state").alias("slug"))


@query(f"""
WITH s AS (SELECT id, first_seen, CASE WHEN slug IS NULL OR trim(slug) = '' THEN NULL ELSE slug END AS slug,
             status IN ('active', 'verified', 'candidate') AS public, 'shop ' || city AS name, city, state FROM stores),
b AS (SELECT *, CASE WHEN public AND slug IS NULL THEN 'shop-' || lower(replace(city, ' ', '-')) || '-' || lower(state) END AS base FROM s)
SELECT id, CASE WHEN base IS NULL THEN slug WHEN row_number() OVER (PARTITION BY base ORDER BY first_seen, id) = 1
    AND base NOT IN (SELECT slug FROM s WHERE slug IS NOT NULL) THEN base ELSE base || '-' || left(id, 6) END AS slug FROM b
""")
def assign_slugs(d):
    # Names that repeat within a city, so that base slugs collide.
    rows = d.stores.withColumns({"name": F.concat(F.lit("shop "), "city"), "slug": F.when(~tx.blank(F.col("slug")), F.col("slug"))})
    return lc.assign_slugs(rows).select("id", "slug")


_STATE_NAMES = sql_map({code: " ".join(w.capitalize() for w in name.lower().split(" ")) for name, code in cat.STATE_CODES.items()})


@query(f"""
SELECT state, city, {STATE_SLUGS}[state] AS state_slug, {CITY_SLUG} AS city_slug, {_STATE_NAMES}[state] AS state_name, state AS abbrev,
  CASE WHEN city LIKE 'CITY%' THEN 'City' || substr(city, 5) ELSE city END AS city_again
FROM (SELECT DISTINCT state, city FROM stores)
""")
def slug_lookups(d):
    rows = d.stores.select("state", "city").distinct().withColumns(
        {"state_slug": tx.state_to_slug("state"), "city_slug": tx.city_to_slug("city")}
    )
    return rows.select(
        "state", "city", "state_slug", "city_slug", tx.slug_to_state("state_slug").alias("state_name"),
        tx.slug_to_abbrev("state_slug").alias("abbrev"), tx.slug_to_city("city_slug").alias("city_again"),
    )


@query("""
SELECT id, CASE WHEN city LIKE 'CITY%' THEN 'City' || substr(city, 5) ELSE city END AS city,
  array_to_string([CASE WHEN w IN ('MTG', 'LA', 'DC', 'D&D') THEN w ELSE left(w, 1) || lower(substr(w, 2)) END
    FOR w IN string_split(upper(p_type) || ' MTG', ' ')], ' ') AS kind
FROM stores JOIN part ON p_partkey = CAST(id AS BIGINT)
""")
def display_case(d):
    parts = d.part.select(F.col("p_partkey").cast("string").alias("id"), "p_type")
    return d.stores.join(parts, "id").select(
        "id", tx.display_case("city").alias("city"),
        tx.display_case(F.concat(F.upper("p_type"), F.lit(" MTG"))).alias("kind"),
    )
