"""Directory-shaped views over the driver's tables.

The given tables hold no stores, so each directory table is derived from them by plain expressions: ``stores`` from
``customer`` and ``part``, presences from ``orders``, check logs from ``lineitem``, and so on. Every view is one SQL
text in the dialect both engines share, with a few ``@token@`` spots where the spelling differs; the same text gives
the Spark DataFrame and the common table expression of the check SQL. ``k`` is the customer key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from placeledger.session import spread

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Tables whose rows hold whole texts: few bytes, much work.
TEXT_TABLES = ["pages", "documents", "site_pages", "presence_pages", "calendar_pages"]

# Fixed evaluation times of the views: directory views, and views on ship and order dates.
AS_OF = "2024-02-01 00:00:00"
AS_OF_ORDERS = "1998-12-01 00:00:00"

_STATES = [
    "AL", "AZ", "CA", "CO", "FL", "GA", "IL", "IN", "KS", "MA", "MI", "MN", "MO", "NC", "NJ", "NV", "NY", "OH",
    "OR", "PA", "TN", "TX", "UT", "VA", "WA",
]
_SOURCES = [
    "wpn", "google_places", "tcgplayer", "manual", "games_workshop", "comicbookstores", "league_comic_geeks",
    "video_game_sage",
]
_PRODUCTS = [
    "mtg", "pokemon", "yugioh", "fab", "board_games", "dnd", "miniatures", "warhammer", "games workshop", "comics",
    "comic", "retro", "vintage", "lorcana",
]
_CARDS = [
    "Lightning Bolt", "Counterspell", "Sol Ring", "Thoughtseize", "Collected Company", "Cyclonic Rift",
    "Arid Mesa", "Ragavan, Nimble Pilferer",
]


def pick(values: list[str], index: str) -> str:
    """A CASE expression: element ``index`` (from 0) of ``values``."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)
    )
    return f"CASE {index} {arms} END"


def quotient(value: str, by: int) -> str:
    return f"CAST(floor({value} / {by}) AS BIGINT)"


_TOKENS = {
    "spark": {
        "@hours@": "timestampadd(HOUR, CAST(k AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')",
        "@until@": "timestampadd(DAY, CAST(k % 400 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')",
        "@enriched@": "date_format(timestampadd(DAY, CAST(-(k % 60) AS INT), TIMESTAMP_NTZ'2024-02-01 00:00:00'),"
                      " \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
        "@products@": "array_join(transform(array_sort(array_distinct(collect_set(tag))), t -> '\"' || t || '\"'), ', ')",
        "@minute@": "date_format(date_trunc('HOUR', ts), 'yyyy-MM-dd HH:mm')",
        "@checked@": "TIMESTAMP_NTZ'1998-12-02 00:00:00'",
        "@cut@": "TIMESTAMP_NTZ'2024-01-20 00:00:00'",
    },
    "duckdb": {
        "@hours@": "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(k AS INT))",
        "@until@": "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(k % 400 AS INT))",
        "@enriched@": "strftime(TIMESTAMP '2024-02-01 00:00:00' - to_days(CAST(k % 60 AS INT)), '%Y-%m-%dT%H:%M:%SZ')",
        "@products@": "string_agg(DISTINCT '\"' || tag || '\"', ', ' ORDER BY '\"' || tag || '\"')",
        "@minute@": "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M')",
        "@checked@": "TIMESTAMP '1998-12-02 00:00:00'",
        "@cut@": "TIMESTAMP '2024-01-20 00:00:00'",
    },
}

VIEWS: dict[str, str] = {}

VIEWS["stores"] = f"""
SELECT CAST(k AS STRING) AS id,
       p_name || ' ' || lpad(CAST(k AS STRING), 6, '0') ||
         {pick(['', ' Games LLC', ', Inc.', ' Comics', ' Cards', ' Hobbies'], 'k % 6')} AS name,
       CAST(100 + k AS STRING) ||
         {pick([' Main St', ' NW Oak Ave', ' Sunset Blvd Suite 200', ' S.W. 5th Ave.', ' River Dr Unit B'], 'k % 5')} AS street,
       CASE WHEN k % 7 = 0 THEN 'CITY ' ELSE 'City ' END || CAST(k % 23 AS STRING) AS city,
       {pick(_STATES, 'c_nationkey')} AS state,
       CAST(10000 + k % 90000 AS STRING) AS zip_code,
       CASE WHEN k % 11 <> 0 THEN 30 + (k * 7919 % 1000) / 100.0e0 END AS latitude,
       CASE WHEN k % 11 <> 0 THEN -120 + (k * 104729 % 4000) / 100.0e0 END AS longitude,
       CASE WHEN k % 7 <> 1 THEN '555-' || lpad(CAST(k % 10000 AS STRING), 4, '0') END AS phone,
       CASE WHEN k % 3 = 0 THEN 'W' || CAST(k AS STRING) END AS wpn_id,
       CASE WHEN k % 6 = 0 THEN 'premium' WHEN k % 3 = 0 THEN 'core' END AS wpn_level,
       CASE WHEN k % 4 = 0 THEN 'G' || CAST(k AS STRING) END AS google_place_id,
       {pick(['candidate', 'verified', 'active', 'unresponsive', 'closed'], 'k % 5')} AS status,
       {pick(_SOURCES, quotient('k', 5) + ' % 8')} AS discovery_source,
       CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN ' '
            ELSE replace(p_name, ' ', '-') || '-' || lpad(CAST(k AS STRING), 6, '0') END AS slug,
       @hours@ AS first_seen,
       CASE WHEN {quotient('k', 7)} % 5 = 0 THEN 'premium' WHEN {quotient('k', 7)} % 5 = 1 THEN 'claimed' END AS premium_status,
       CASE WHEN {quotient('k', 7)} % 5 = 0 THEN @until@ END AS premium_until,
       CASE WHEN k % 2 = 0 THEN 'https://img.example.com/' || CAST(k AS STRING) || '.jpg' END AS hero_image_url,
       c_mktsegment AS segment
FROM (SELECT c_custkey AS k, c_nationkey, c_mktsegment, p_name
      FROM {{customer}} JOIN {{part}} ON p_partkey = c_custkey) AS keyed
"""

VIEWS["online_presences"] = f"""
SELECT CAST(o_orderkey AS STRING) AS id,
       CAST(o_custkey AS STRING) AS store_id,
       {pick(['website', 'tcgplayer', 'ebay', 'facebook', 'other'], 'o_orderkey % 5')} AS channel_type,
       CASE WHEN o_orderkey % 29 = 0 THEN 'https://m.facebook.com/shop' || CAST(o_custkey AS STRING)
            ELSE 'https://www.shop' || CAST(o_custkey AS STRING) || '.example.com/' END AS url,
       CASE WHEN o_orderkey % 9 <> 0 THEN
         {pick(['crystal_commerce', 'binderpos', 'shopify', 'squarespace', 'woocommerce', 'wordpress_stripe', 'custom',
                'unknown'], 'o_orderkey % 8')} END AS platform,
       CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS sells_mtg_singles,
       {pick(['none', 'small', 'medium', 'large'], 'o_orderkey % 4')} AS estimated_inventory_size,
       CASE WHEN o_custkey % 10 = 3 THEN 'dead' WHEN o_orderstatus = 'O' THEN 'active'
            WHEN o_orderstatus = 'F' THEN 'dead' ELSE 'unreachable' END AS status,
       o_orderdate AS last_checked
FROM {{orders}}
"""

VIEWS["validation_logs"] = f"""
SELECT CAST(o_custkey AS STRING) AS store_id,
       CAST(l_orderkey AS STRING) AS presence_id,
       CASE WHEN l_linenumber <= 5 THEN 'http_check' ELSE 'content_extract' END AS check_type,
       CASE WHEN l_linenumber <= 5 THEN
              '{{"status": "' || CASE l_returnflag WHEN 'A' THEN 'dead' WHEN 'R' THEN 'unreachable' ELSE 'active' END || '"}}'
            WHEN l_partkey % 5 = 0 THEN '{{"confidence": "unknown", "products_found": 2}}'
            WHEN l_partkey % 5 = 1 THEN '{{"confidence": 0.2, "products": ["mtg"]}}'
            WHEN l_partkey % 5 = 2 THEN '{{"confidence": 0.3, "products": []}}'
            WHEN l_partkey % 5 = 3 THEN '{{"confidence": 0.8, "products_found": 3}}'
            ELSE '{{"products_found": 1, "confidence": 0.5}}' END AS result,
       l_shipdate AS ts,
       CAST(CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS BIGINT) AS seq,
       CAST(l_quantity AS INT) AS seq2,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS seq3
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
"""

VIEWS["store_external_refs"] = f"""
SELECT store_id, provider, external_id, payload, seen FROM (
  SELECT CAST(k AS STRING) AS store_id, 'website_content' AS provider, CAST(k AS STRING) AS external_id,
         '{{"products": [' || CASE WHEN k % 8 = 0 THEN '' ELSE coalesce(tags, '') END || '], "confidence": 0.' ||
           CAST(1 + k % 9 AS STRING) || ', "has_events": ' || CASE WHEN k % 6 = 0 THEN 'true' ELSE 'false' END ||
           CASE WHEN k % 10 = 1 THEN ', "event_url": "https://www.shop' || CAST(k AS STRING) || '.example.com/events"' ELSE '' END ||
           CASE WHEN k % 12 = 5 THEN ', "description": "Shop number ' || CAST(k AS STRING) || '"' ELSE '' END ||
           ', "events_next_30_days": [' || CASE WHEN k % 14 = 3 THEN
             '{{"title": "Draft night", "start_date": "2024-02-0' || CAST(1 + k % 9 AS STRING) || ' 18:30", "end_date": "2024-02-0' ||
             CAST(1 + k % 9 AS STRING) || ' 21:00", "timezone": "UTC", "source_url": "https://www.shop' || CAST(k AS STRING) ||
             '.example.com/"}}, {{"title": "No dates"}}' ELSE '' END || ']}}' AS payload,
         @hours@ AS seen
  FROM (SELECT c_custkey AS k, c_mktsegment FROM {{customer}}) AS keyed
  LEFT JOIN (SELECT o_custkey, @products@ AS tags
             FROM (SELECT o_custkey, {pick(_PRODUCTS, 'l_partkey % 14')} AS tag
                   FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_quantity > 45) AS tagged
             GROUP BY o_custkey) AS by_store ON o_custkey = k
  WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')
  UNION ALL
  SELECT CAST(k AS STRING), 'games_workshop', 'GW' || CAST(k AS STRING), NULL, @hours@
  FROM (SELECT c_custkey AS k FROM {{customer}} WHERE c_nationkey < 4) AS keyed
  UNION ALL
  SELECT id, 'google_places', google_place_id,
         CASE WHEN k % 20 <> 0 THEN
           '{{' || CASE WHEN k % 12 = 0 THEN '"enriched_at": "yesterday", ' WHEN k % 28 = 0 THEN ''
                       ELSE '"enriched_at": "' || @enriched@ || '", ' END ||
           '"hours": {{"weekday_text": ["Monday: ' || CASE WHEN k % 8 = 4 THEN 'Closed' ELSE '10:00 AM – 8:00 PM' END ||
           '", "Tuesday: 10:00 AM – 8:00 PM", "Wednesday: 11:00 AM – 9:00 PM", "Thursday: ' ||
           CASE WHEN k % 16 = 0 THEN 'Closed' ELSE '4:00 PM – 1:00 AM' END ||
           '", "Friday: 10:00 AM – 11:00 PM", "Saturday: 9:30 AM – 11:00 PM", "Sunday: Closed"]' ||
           CASE WHEN k % 24 = 4 THEN '' ELSE
             ', "periods": [{{"open": {{"day": 1, "hour": 10, "minute": 0}}, "close": {{"day": 1, "hour": 20, "minute": 0}}}}, ' ||
             '{{"open": {{"day": 4, "hour": 16, "minute": ' || CAST(k % 60 AS STRING) || '}}, "close": {{"day": 5, "hour": 1, "minute": 0}}}}, ' ||
             '{{"open": {{"day": 6, "hour": 9, "minute": 30}}}}]' END ||
           '}}, "rating": ' || CAST({quotient('k % 50', 10)} AS STRING) || '.' || CAST(k % 10 AS STRING) ||
           ', "user_rating_count": ' || CAST(k % 321 AS STRING) ||
           ', "photo_refs": ["p' || CAST(k AS STRING) || 'a", "p' || CAST(k AS STRING) || 'b"]}}' END,
         @hours@
  FROM (SELECT c_custkey AS k, CAST(c_custkey AS STRING) AS id,
               CASE WHEN c_custkey % 4 = 0 THEN 'G' || CAST(c_custkey AS STRING) END AS google_place_id
        FROM {{customer}}) AS keyed
  WHERE google_place_id IS NOT NULL
) AS refs
"""

VIEWS["store_categories"] = f"""
SELECT DISTINCT store_id, category FROM (
  SELECT CAST(c_custkey AS STRING) AS store_id,
         CASE {quotient('c_custkey', 5)} % 8 WHEN 0 THEN 'lgs' WHEN 4 THEN 'hobby_miniatures' WHEN 5 THEN 'comic_shop'
              WHEN 6 THEN 'comic_shop' WHEN 7 THEN 'retro_games' END AS category
  FROM {{customer}}
  UNION ALL
  SELECT CAST(c_custkey AS STRING), {pick(['lgs', 'comic_shop', 'retro_games', 'hobby_miniatures'], 'c_custkey % 4')}
  FROM {{customer}} WHERE c_acctbal > 2000
) AS linked WHERE category IS NOT NULL
"""

VIEWS["city_descriptions"] = f"""
SELECT state, upper(city) AS city, 'Stores of ' || upper(city) || ' in ' || state AS description
FROM (SELECT DISTINCT {pick(_STATES, 'c_nationkey')} AS state, 'City ' || CAST(c_custkey % 23 AS STRING) AS city
      FROM {{customer}} WHERE c_mktsegment = 'FURNITURE') AS places
"""

VIEWS["store_events"] = """
SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS store_id,
       'Event ' || CAST(o_orderkey AS STRING) AS title, CAST(o_orderdate AS DATE) AS event_date
FROM {orders}
"""

# signup = claim or new subscription, error = subscription deleted, purchase = failed payment.
VIEWS["claims"] = """
SELECT event_id, CAST(user_id AS STRING) AS store_id,
       'user' || CAST(event_id % 3 AS STRING) || '@example.com' AS email,
       CASE WHEN value > 20 THEN 'pending' WHEN value > 10 THEN 'approved' ELSE 'denied' END AS status,
       ts AS created_at
FROM {events} WHERE event_type = 'signup'
"""

VIEWS["subscription_events"] = """
SELECT event_id, CAST(user_id * 3 AS STRING) AS store_id,
       CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'payment_failed' END AS kind,
       ts AS created_at
FROM {events} WHERE event_type IN ('signup', 'error', 'purchase')
"""

VIEWS["wpn_raw"] = f"""
SELECT CAST(k AS STRING) AS id, CASE WHEN k % 31 = 0 THEN '' ELSE name END AS name,
       CASE k % 8
         WHEN 0 THEN street || ', ' || city || ', ' || state || ', ' || zip_code || ', United States'
         WHEN 1 THEN street || ', ' || city || ', ' || state || ', ' || zip_code
         WHEN 2 THEN street || ', ' || city || ', ' || state
         WHEN 3 THEN street || ', ' || city
         WHEN 4 THEN street || ', Suite 4, ' || city || ', ' || state || ', ' || zip_code || ', United States'
         WHEN 5 THEN ', ' || city || ', ' || state || ', ' || zip_code || ', United States'
         WHEN 6 THEN CASE WHEN k % 16 = 6 THEN NULL ELSE '' END
         ELSE ' ' || street || ' ,' || city || ' , ' || lower(state) || ', ' || zip_code || '-1234,United States' END AS postal_address,
       latitude, longitude, k % 6 = 0 AS is_premium, phone AS phone_number,
       CASE WHEN k % 10 = 0 THEN 'https://locator.wizards.com/s/' || CAST(k AS STRING)
            WHEN k % 3 = 0 THEN 'https://www.shop' || CAST(k AS STRING) || '.example.com/' END AS website
FROM (SELECT *, CAST(id AS BIGINT) AS k FROM stores) AS keyed
"""

VIEWS["google_raw"] = f"""
SELECT CASE WHEN k % 41 = 0 THEN '' ELSE 'G' || CAST(k AS STRING) END AS id,
       CASE WHEN k % 9 = 0 THEN {pick(['Corner Liquor ', 'Beer & Board Games ', 'Target ', 'City Pharmacy '],
                                       quotient('k', 9) + ' % 4')} || CAST(k AS STRING) ELSE name END AS display_name,
       CASE k % 6 WHEN 0 THEN street || ', ' || city || ', ' || state || ' ' || zip_code || ', USA'
                  WHEN 1 THEN street || ', ' || city || ', ' || state || ' ' || zip_code || '-9876, USA'
                  WHEN 2 THEN '12345 Long Rd, ' || city || ', ' || state || ' ' || zip_code
                  WHEN 3 THEN 'Mall Level 2, ' || street || ', ' || city || ', ' || state || ' ' || zip_code || ', USA'
                  WHEN 4 THEN city || ', ' || state
                  ELSE street || ',' || city || ',' || state || ' ' || zip_code END AS formatted_address,
       phone AS national_phone, CASE WHEN k % 3 = 1 THEN 'https://shop' || CAST(k AS STRING) || '.example.com' END AS website_uri,
       latitude, longitude, {quotient('k % 50', 10)} * 1.0e0 AS rating,
       {pick(['store,establishment', 'bar,night_club', 'bar,store', 'liquor_store', 'book_store,pharmacy', ''], 'k % 6')} AS type_list
FROM (SELECT *, CAST(id AS BIGINT) AS k FROM stores) AS keyed
"""

_CASE = quotient("k", 4) + " % 5"
VIEWS["candidates"] = f"""
SELECT 'C' || CAST(k AS STRING) AS candidate_id, k AS seq, {_CASE} AS case_no,
       CASE {_CASE} WHEN 0 THEN 'zz other ' || lpad(CAST(k AS STRING), 6, '0')
                    WHEN 1 THEN name
                    WHEN 2 THEN 'qq alt ' || lpad(CAST(k AS STRING), 6, '0')
                    WHEN 3 THEN replace(name, ' 0', CASE WHEN {quotient('k', 20)} % 2 = 1 THEN 'xxxx 0' ELSE 's 0' END)
                    ELSE 'new shop ' || lpad(CAST({quotient('k', 20)} AS STRING), 6, '0') END AS name,
       CASE {_CASE} WHEN 0 THEN '9' || CAST(k AS STRING) || ' Elm Rd' WHEN 1 THEN '7' || CAST(k AS STRING) || ' Pine Ct'
                    WHEN 2 THEN street WHEN 3 THEN '8' || CAST(k AS STRING) || ' Oak Ln'
                    ELSE '6' || CAST(k AS STRING) || ' Ash Way' END AS street,
       city, state,
       CASE {_CASE} WHEN 0 THEN CAST(50000 + k % 5000 AS STRING) WHEN 2 THEN CAST(55000 + k % 5000 AS STRING)
                    WHEN 4 THEN CAST(60000 + {quotient('k', 20)} % 30000 AS STRING) ELSE zip_code END AS zip_code,
       CASE {_CASE} WHEN 1 THEN latitude WHEN 3 THEN latitude + 0.001e0 END AS latitude,
       CASE {_CASE} WHEN 1 THEN longitude WHEN 3 THEN longitude END AS longitude,
       CASE {_CASE} WHEN 0 THEN wpn_id END AS wpn_id,
       CASE {_CASE} WHEN 0 THEN google_place_id END AS google_place_id,
       '555-' || lpad(CAST((k + 1) % 10000 AS STRING), 4, '0') AS phone,
       CASE WHEN k % 5 = 0 THEN 'https://magic.wizards.com/s' || CAST(k AS STRING)
            WHEN k % 2 = 0 THEN 'https://cand' || CAST(k AS STRING) || '.example.com' END AS website
FROM (SELECT *, CAST(id AS BIGINT) AS k FROM stores) AS keyed
"""

# The given pages with store-site markup added per page, so that platform, price, date and calendar rules have hits.
VIEWS["site_pages"] = f"""
SELECT page_id, url, CAST(page_id % 150 AS STRING) AS store_id,
       CASE page_id % 11 WHEN 3 THEN 404 WHEN 7 THEN 500 ELSE 200 END AS status_code,
       CASE page_id % 13 WHEN 4 THEN 'timeout' WHEN 9 THEN 'connect' END AS error,
       CASE WHEN page_id % 8 = 3 THEN '12345' END AS x_shopid,
       CASE page_id % 5 WHEN 0 THEN 'Tue, 15 Nov 2022 08:12:31 GMT' WHEN 1 THEN 'Sunday, 06-Nov-22 08:49:37 GMT'
                        WHEN 2 THEN 'Sun Nov  6 08:49:37 2022' WHEN 3 THEN 'not a date' END AS last_modified,
       replace(replace(html, '</head>',
         {pick(['', '<link href="https://cdn.crystalcommerce.com/a.css">', '<script src="https://app.binderpos.com/x.js"></script>',
                '<script src="https://cdn.shopify.com/s.js"></script>', '<div class="wc-add-to-cart"></div>',
                '<img src="https://static1.squarespace.com/i.png">', '<link href="/wp-content/a.css">',
                '<script src="https://js.stripe.com/v3/"></script>'], 'page_id % 8')} ||
         CASE WHEN page_id % 6 = 0 THEN '<meta name="description" content="A friendly shop for Magic: The Gathering singles and board games in town.">' ELSE '' END ||
         CASE WHEN page_id % 7 = 0 THEN '<script type="application/ld+json">{{"@type": "Product", "offers": {{"price": ' ||
              CAST(1 + page_id % 90 AS STRING) || '.50}}}}</script>' ELSE '' END || '</head>'),
         '</footer>',
         {pick(['', ' Magic the Gathering and MTG singles. Friday Night Magic weekly!', ' Pokémon league. Warhammer 40k.',
                ' Dungeons & Dragons, tabletop games and comics.', ' This domain is for sale!', ' Yu-Gi-Oh and Flesh and Blood.',
                ' Single cards: Sol Ring $3.25 NM foil Commander', ' Lightning Bolt <span class="price">$1.75</span> rare LP'],
               'page_id % 8')} ||
         CASE WHEN page_id % 4 = 1 THEN ' Mon-Fri 10am to 8pm. Call (555) 010-' || lpad(CAST(page_id % 10000 AS STRING), 4, '0') ELSE '' END ||
         CASE WHEN page_id % 9 = 2 THEN ' Prices updated: March 5, 2023' WHEN page_id % 9 = 4 THEN ' Last updated 3/15/2022'
              WHEN page_id % 9 = 6 THEN ' Updated on 2021-07-04' ELSE '' END ||
         CASE WHEN page_id % 3 = 0 THEN ' © 2021 © 2023' ELSE '' END ||
         CASE WHEN page_id % 5 = 1 THEN '<a href="/events?m=1">Event list</a><a href="/product/7">Card 7</a><a href="/p/8">Buy</a>' ELSE '' END ||
         CASE WHEN page_id % 17 = 3 THEN '<script>window.location.href = "/home";</script>' ELSE '' END ||
         CASE WHEN page_id % 19 = 3 THEN '<script src="/adsense/domains/caf.js"></script>' ELSE '' END || '</footer>') AS html
FROM {{pages}}
"""

# The page fetched for a presence, where there is one.
VIEWS["presence_pages"] = """
SELECT id AS presence_id, site_pages.url, status_code, error, html, x_shopid, page_id
FROM site_pages JOIN online_presences ON id = CAST(page_id AS STRING)
"""

# Event calendars as store pages carry them, one page per supplier, and the events that the calendars list.
VIEWS["calendar_pages"] = f"""
SELECT CAST(s_suppkey AS STRING) AS store_id, 'https://www.shop' || CAST(s_suppkey AS STRING) || '.example.com/events?x=1' AS url,
       '<script>window.cowEventCal1_config = {{"_id": "cal' || CAST(s_suppkey AS STRING) || '"' ||
         CASE s_suppkey % 3 WHEN 0 THEN ', "timezone": "America/Chicago"' WHEN 1 THEN ', "timezone": "UTC"' ELSE '' END ||
         '}};window.cowEventCal1_services=[{{"_id": "a", "title": "Draft", "product_url": "draft", "location": "Hall"}}, {{"_id": "b"}}];' ||
         CASE WHEN s_suppkey % 4 = 0 THEN 'window.cowEventCal2_config = {{"_id": "bad"' ELSE '' END || '</script>' AS html
FROM {{supplier}}
"""
VIEWS["calendar_events"] = """
SELECT 'cal' || CAST(user_id AS STRING) AS calendar_id,
       CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'a' ELSE 'unknown' END AS service_id,
       CAST(event_id AS STRING) AS event_id, @minute@ AS start_date,
       CASE WHEN event_id % 13 <> 0 THEN @minute@ END AS end_date, 'open' AS status, '5.00' AS price, false AS is_not_bookable
FROM {events}
"""

VIEWS["found_prices"] = f"""
SELECT CAST(l_orderkey AS STRING) AS presence_id, {pick(_CARDS, 'l_partkey % 8')} AS card_name,
       CAST(l_quantity * 4 + l_linenumber AS INT) AS price_cents
FROM {{lineitem}}
"""

VIEWS["market_prices"] = f"""
SELECT {pick(_CARDS, 'slot')} AS card_name, CAST(round(avg_price / 10) AS INT) AS market_cents
FROM (SELECT p_partkey % 8 AS slot, avg(p_retailprice) AS avg_price FROM {{part}} GROUP BY p_partkey % 8) AS priced
WHERE slot <> 5
"""

# One requested path per order: store pages by id or slug, and the other page kinds.
VIEWS["requests"] = f"""
SELECT o_orderkey AS request_id,
  CASE o_orderkey % 12
    WHEN 0 THEN '/store/' || coalesce(slug, CAST(o_custkey AS STRING)) WHEN 1 THEN '/store/' || upper(coalesce(slug, 'none'))
    WHEN 2 THEN '/store/' || lpad(CAST(o_custkey AS STRING), 8, '0') || '-1111-4111-8111-111111111111'
    WHEN 3 THEN '/store/' || coalesce(slug, 'x') || '/claim' WHEN 4 THEN '/stores/' || lower(state)
    WHEN 5 THEN '/stores/' || lower(state) || '/' || replace(lower(city), ' ', '-') WHEN 6 THEN '/guides/starter-kit'
    WHEN 7 THEN '/comics' WHEN 8 THEN '/_next/static/chunk.js' WHEN 9 THEN '/store/x/opengraph-image'
    WHEN 10 THEN '/store/no-such-' || CAST(o_orderkey AS STRING) ELSE '/' || o_orderpriority END AS path
FROM {{orders}} JOIN stores ON id = CAST(o_custkey AS STRING)
"""

# A search-console export: one page per request, with formatted counts.
VIEWS["search_pages"] = """
SELECT request_id AS row_no,
       CASE WHEN request_id % 3 = 0 THEN path ELSE 'https://directory.example.com' || path || '?utm=1' END AS page,
       CASE WHEN request_id % 5 = 0 THEN '1,' || lpad(CAST(request_id % 1000 AS STRING), 3, '0')
            WHEN request_id % 7 = 0 THEN 'n/a' WHEN request_id % 11 = 0 THEN '0'
            ELSE CAST(request_id % 500 AS STRING) END AS impressions
FROM requests
"""

# Places to search around, one per supplier.
VIEWS["points"] = """
SELECT s_suppkey AS point_id, 30 + (s_suppkey * 6113 % 1000) / 100.0e0 AS latitude,
       -120 + (s_suppkey * 7723 % 4000) / 100.0e0 AS longitude
FROM {supplier}
"""

# Stores seen under a UUID id, for the id redirects.
VIEWS["uuid_stores"] = """
SELECT lpad(id, 8, '0') || '-1111-4111-8111-111111111111' AS id, slug, status FROM stores
"""


# One fetched page per presence for a health run, the place status service, and claims before and after a cut.
VIEWS["http_checks"] = """
SELECT CAST(o_orderkey AS STRING) AS presence_id, CASE WHEN o_orderkey % 6 <> 1 THEN CASE o_orderkey % 4
         WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END END AS status_code,
       CASE WHEN o_orderkey % 12 = 1 THEN 'timeout' WHEN o_orderkey % 12 = 7 THEN 'connect' END AS error,
       CASE WHEN o_orderkey % 10 = 5 THEN '<p>This  domain is for sale</p>' ELSE '<p>Welcome</p>' END AS html,
       @checked@ AS checked_at
FROM {orders}
"""

VIEWS["business_status"] = """
SELECT 'G' || CAST(c_custkey AS STRING) AS google_place_id,
       CASE c_custkey % 3 WHEN 0 THEN 'OPERATIONAL' WHEN 1 THEN 'CLOSED_TEMPORARILY' ELSE 'CLOSED_PERMANENTLY' END AS business_status
FROM {customer}
"""

VIEWS["claims_past"] = "SELECT * FROM claims WHERE created_at < @cut@"
VIEWS["claims_new"] = "SELECT * FROM claims WHERE created_at >= @cut@"


# Helpers that only the check SQL uses: the public and trusted stores, and products as rows.
CHECK_VIEWS: dict[str, str] = {
    "ref_products": """
SELECT store_id, unnest(from_json(payload, '{"products": ["VARCHAR"]}').products) AS product
FROM store_external_refs WHERE provider = 'website_content'
""",
    "trusted_refs": """
SELECT store_id FROM ref_products
UNION SELECT store_id FROM store_external_refs WHERE provider = 'games_workshop'
""",
    "visible": """
SELECT * FROM stores
WHERE status IN ('active', 'verified', 'candidate') AND slug IS NOT NULL AND trim(slug) <> ''
  AND NOT (status = 'candidate' AND wpn_id IS NULL AND id NOT IN (SELECT store_id FROM trusted_refs))
""",
    "online_ids": """
SELECT DISTINCT store_id FROM online_presences WHERE sells_mtg_singles AND status = 'active'
""",
}


def _needs(name: str, pool: dict[str, str]) -> list[str]:
    """Views that view ``name`` reads, in build order, itself last."""
    found: list[str] = []
    for other in pool:
        if other != name and re.search(rf"\b(?:FROM|JOIN) {other}\b", pool[name]):
            found += [v for v in _needs(other, pool) if v not in found]
    return found + [name]


def _text(name: str, engine: str, table, pool: dict[str, str]) -> str:
    text = pool[name]
    for token, spelling in _TOKENS[engine].items():
        text = text.replace(token, spelling)
    for base in BASE_TABLES:
        text = text.replace("{" + base + "}", table(base))
    return text


def check_ctes(sql: str) -> str:
    """Put the view definitions that ``sql`` reads in front of it, in the check engine's spelling."""
    pool = VIEWS | CHECK_VIEWS
    wanted: list[str] = []
    for name in pool:
        if re.search(rf"\b{name}\b", sql):
            wanted += [v for v in _needs(name, pool) if v not in wanted]
    if not wanted:
        return sql.strip()
    parts = [f"{name} AS ({_text(name, 'duckdb', lambda t: t, pool)})" for name in wanted]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        # RECURSIVE only allows a view to name itself; the others are not changed by it.
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Directory:
    """The views of one data folder as DataFrames: ``Directory(spark, sf_dir).stores``.

    With ``tables`` given, the directory tables are read from there (see ``store_tables``) instead of being derived.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, tables: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.tables = tables
        self.ready: set[str] = set()  # tables that are stored while others still have to be

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE_TABLES and name not in VIEWS:
            raise AttributeError(name)
        df = self._read(name)
        return spread(df) if name in TEXT_TABLES else df

    def _read(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if self.tables is not None and (not self.ready or name in self.ready):
            return self.spark.read.parquet(f"{self.tables}/{name}")
        parts = [
            f"{v} AS (SELECT * FROM parquet.`{self.tables}/{v}`)" if v in self.ready else
            f"{v} AS ({_text(v, 'spark', lambda t: f'parquet.`{self.sf_dir}/{t}.parquet`', VIEWS)})"
            for v in _needs(name, VIEWS)
        ]
        return self.spark.sql("WITH " + ", ".join(parts) + f" SELECT * FROM {name}")


def store_tables(spark: SparkSession, sf_dir: str, path: str) -> Directory:
    """Write every directory table once under ``path`` and give the directory that reads them.

    The tables are written in the order of their needs, each from the stored ones before it.
    """
    derived = Directory(spark, sf_dir)
    for name in VIEWS:
        # Small tables are stored in one file per core, so that their readers use all cores.
        spread(getattr(derived, name)).write.parquet(f"{path}/{name}")
        derived.tables = path
        derived.ready.add(name)
    return Directory(spark, sf_dir, tables=path)
