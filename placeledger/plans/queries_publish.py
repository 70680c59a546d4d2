"""Registered queries for radius searches, payload parsing and published outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions import geo
from placeledger.operators import directory as dr
from placeledger.operators import near
from placeledger.operators import publish as pb
from placeledger.plans.queries_directory import CITY_SLUG, STATE_SLUGS, sql_in, sql_map
from placeledger.plans.registry import query
from placeledger.plans.views import AS_OF

_AT = "2024-02-01 17:30:00"


def _arc(lat: str, lng: str) -> str:
    return (
        f"3958.8e0 * acos(least(1.0e0, greatest(-1.0e0, cos(radians({lat})) * cos(radians(latitude)) * "
        f"cos(radians(longitude) - radians({lng})) + sin(radians({lat})) * sin(radians(latitude)))))"
    )


def _haversine(a: str, b: str) -> str:
    h = (
        f"(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude))"
        f" * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))"
    )
    return f"2 * 3958.8e0 * atan2(sqrt({h}), sqrt(1 - {h}))"


_METROS = "(VALUES " + ", ".join(f"('{n}', {lat}e0, {lng}e0)" for n, lat, lng in cat.METRO_POINTS) + ") p(metro, latitude, longitude)"


def _from_metros(d):
    """Every placed store with its distance to each metro point."""
    points = F.array(*[F.struct(F.lit(n).alias("metro"), F.lit(lat).alias("lat"), F.lit(lng).alias("lng")) for n, lat, lng in cat.METRO_POINTS])
    rows = d.stores.filter(F.col("latitude").isNotNull()).select("id", "latitude", "longitude", F.explode(points).alias("p"))
    miles = geo.haversine_miles(F.col("p.lat"), F.col("p.lng"), F.col("latitude"), F.col("longitude"))
    return rows.select("id", "p.metro", miles.alias("miles"))


@query(f"SELECT s.id, p.metro, round({_haversine('p', 's')}, 3) AS miles FROM stores s, {_METROS} WHERE s.latitude IS NOT NULL")
def haversine_miles(d):
    return _from_metros(d).withColumn("miles", F.round("miles", 3))


@query(f"""
SELECT id, round(distance, 3) AS miles FROM (
  SELECT id, {_arc('33.94', '-112.07')} AS distance FROM visible
  WHERE latitude BETWEEN 33.94 - 500 / 69.0e0 AND 33.94 + 500 / 69.0e0
    AND longitude BETWEEN -112.07 - 500 / (69.0e0 * cos(radians(33.94))) AND -112.07 + 500 / (69.0e0 * cos(radians(33.94))))
WHERE distance <= 500 ORDER BY distance, id LIMIT 50
""")
def nearby(d):
    out = near.nearby(d.stores, d.store_external_refs, 33.94, -112.07, radius=500)
    return out.select("id", F.round("distance_miles", 3).alias("miles"))


@query(f"""
SELECT point_id, rank, id, round(distance, 3) AS miles FROM (
  SELECT point_id, id, distance, row_number() OVER (PARTITION BY point_id ORDER BY distance, id) AS rank FROM (
    SELECT p.point_id, s.id, {_arc('p.lat', 'p.lng')} AS distance
    FROM (SELECT point_id, latitude AS lat, longitude AS lng FROM points) p
    JOIN visible s ON s.latitude BETWEEN p.lat - 50 / 69.0e0 AND p.lat + 50 / 69.0e0
      AND s.longitude BETWEEN p.lng - 50 / 69.0e0 / cos(radians(p.lat)) AND p.lng + 50 / 69.0e0 / cos(radians(p.lat)))
  WHERE distance <= 50) WHERE rank <= 10
""")
def nearby_join(d):
    out = near.nearby_join(d.points, d.stores, d.store_external_refs, radius=50, limit=10)
    return out.select("point_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("distance_miles", 3).alias("miles"))


# --- payloads ------------------------------------------------------------------------------------------------

_PLACES = """
  SELECT store_id, payload, json_extract_string(payload, '$.hours.weekday_text[*]') AS lines,
    [p FOR p IN from_json(payload->'hours'->'periods', '[{"open": {"day": "INT", "hour": "INT", "minute": "INT"},
      "close": {"day": "INT", "hour": "INT", "minute": "INT"}}]') IF p.open.day IS NOT NULL AND p.close.day IS NOT NULL] AS periods
  FROM store_external_refs WHERE provider = 'google_places' AND payload IS NOT NULL
"""


@query(f"""
SELECT store_id AS id, array_to_string(lines, '|') AS weekday_text, coalesce(len(periods), 0) AS periods,
  CAST(payload->>'rating' AS DOUBLE) AS rating, CAST(payload->>'user_rating_count' AS BIGINT) AS user_rating_count,
  json_array_length(payload->'photo_refs') AS photos, payload->>'enriched_at' AS enriched_at FROM ({_PLACES})
""")
def parse_enrichment(d):
    j = pb.attach_payloads(d.stores.select("id"), d.store_external_refs).filter("enrichment IS NOT NULL")
    e = F.col("enrichment")
    return j.select(
        "id", F.array_join(e["weekday_text"], "|").alias("weekday_text"), F.coalesce(F.size(e["periods"]), F.lit(0)).alias("periods"),
        e["rating"].alias("rating"), e["user_rating_count"].alias("user_rating_count"),
        F.size(e["photo_refs"]).cast("bigint").alias("photos"), e["enriched_at"].alias("enriched_at"),
    ).withColumn("periods", F.col("periods").cast("bigint"))


_SITES = """
  SELECT store_id, payload->>'description' AS description, from_json(payload->'products', '["VARCHAR"]') AS products,
    payload->>'has_events' = 'true' OR json_array_length(payload->'events_next_30_days') > 0 AS has_events,
    payload->>'event_url' AS event_url, CASE WHEN json_array_length(payload->'events_next_30_days') > 0 THEN 1 ELSE 0 END AS events,
    payload->'events_next_30_days'->0->>'start_date' AS first_start
  FROM store_external_refs WHERE provider = 'website_content'
"""


@query(f"SELECT store_id AS id, description, array_to_string(products, ',') AS products, has_events, event_url, events, first_start FROM ({_SITES})")
def parse_content(d):
    j = pb.attach_payloads(d.stores.select("id"), d.store_external_refs).filter("content IS NOT NULL")
    c = F.col("content")
    return j.select(
        "id", c["description"].alias("description"), F.array_join(c["products"], ",").alias("products"),
        c["has_events"].alias("has_events"), c["event_url"].alias("event_url"), F.size(c["events"]).alias("events"),
        F.get(c["events"], F.lit(0))["start_date"].alias("first_start"),
    )


@query("SELECT s.id, g.payload IS NOT NULL AS has_places, w.payload IS NOT NULL AS has_site FROM stores s"
       " LEFT JOIN (SELECT * FROM store_external_refs WHERE provider = 'google_places') g ON g.store_id = s.id"
       " LEFT JOIN (SELECT * FROM store_external_refs WHERE provider = 'website_content') w ON w.store_id = s.id")
def attach_payloads(d):
    j = pb.attach_payloads(d.stores, d.store_external_refs)
    return j.select("id", F.col("enrichment").isNotNull().alias("has_places"), F.col("content").isNotNull().alias("has_site"))


@query(f"""
SELECT store_id AS id, rating, names, opens FROM (
  SELECT store_id, round(CAST(payload->>'rating' AS DOUBLE), 1) AS rating, array_to_string([x FOR x IN from_json(payload->'photo_refs', '["VARCHAR"]')], ',') AS names,
    CASE WHEN json_array_length(payload->'hours'->'periods') > 0 THEN json_array_length(payload->'hours'->'periods') ELSE 0 END AS opens
  FROM ({_PLACES}))
""")
def place_payload(d):
    """Raw place details built from the stored payloads, written back as payloads and read again."""
    refs = d.store_external_refs.filter("provider = 'google_places' AND payload IS NOT NULL")
    p = F.from_json("payload", "hours struct<weekday_text: array<string>, periods: " + pb.schemas.PERIODS + ">, rating double, photo_refs array<string>")
    details = refs.select("store_id", p.alias("p")).select("store_id", F.to_json(F.struct(
        F.struct(F.col("p.hours.weekday_text").alias("weekdayDescriptions"), F.col("p.hours.periods").alias("periods")).alias("regularOpeningHours"),
        F.col("p.rating").alias("rating"), F.transform("p.photo_refs", lambda n: F.struct(n.alias("name"))).alias("photos"),
    )).alias("details"))
    out = details.select("store_id", pb.place_payload("details", AS_OF).alias("payload"))
    back = F.from_json("payload", "hours struct<periods: array<struct<open: struct<day: int>>>>, rating double, photo_refs array<string>")
    return out.select("store_id", back.alias("b")).select(
        F.col("store_id").alias("id"), F.round("b.rating", 1).alias("rating"), F.array_join("b.photo_refs", ",").alias("names"),
        F.coalesce(F.size("b.hours.periods"), F.lit(0)).cast("bigint").alias("opens"),
    )


# --- hours ---------------------------------------------------------------------------------------------------
# The views hold these opening rules: Monday 10-20 unless its line says closed, Thursday 16:mm to Friday 1:00, Saturday
# has no closing time (dropped). At Thursday 17:30 a store with periods is open; the others follow their Thursday line.

@query(f"""
SELECT store_id AS id, CASE WHEN len(periods) > 0 THEN true ELSE NOT contains(lines[4], 'Closed') END AS is_open,
  CASE WHEN len(periods) > 0 THEN '4:' || lpad(CAST(periods[2].open.minute AS VARCHAR), 2, '0') || ' PM – 1:00 AM'
       ELSE split_part(lines[4], ': ', 2) END AS today_hours,
  CASE WHEN len(periods) > 0 OR NOT contains(lines[4], 'Closed') THEN NULL ELSE 'Opens Friday at 10:00 AM' END AS next_open,
  CASE WHEN contains(lines[1], 'Closed') AND contains(lines[4], 'Closed') THEN 'Open Tue-Wed'
       WHEN contains(lines[4], 'Closed') THEN 'Open Mon-Wed' WHEN contains(lines[1], 'Closed') THEN 'Open Tue-Sat' ELSE 'Open Mon-Sat' END AS open_days
FROM ({_PLACES})
""")
def opening_status(d):
    return pb.opening_status(d.stores, d.store_external_refs, _AT)


# --- display text --------------------------------------------------------------------------------------------

_CITY = "CASE WHEN city LIKE 'CITY%' THEN 'City' || substr(city, 5) ELSE city END"
_LABELS = sql_map(cat.PRODUCT_LABELS)


@query(f"""
SELECT s.id, s.name, street || ', ' || {_CITY} || ', ' || state || ' ' || zip_code AS address, {_CITY} || ', ' || state AS place,
  CASE WHEN g.payload IS NOT NULL THEN '★ ' || printf('%.1f', CAST(g.payload->>'rating' AS DOUBLE)) || ' (' || (g.payload->>'user_rating_count') || ')' END AS rating,
  CASE WHEN w.products IS NOT NULL THEN array_to_string([coalesce({_LABELS}[x], x) FOR x IN w.products], ', ') END AS products,
  strftime(strptime(first_start, '%Y-%m-%d %H:%M'), '%a, %b %-d') AS event_day,
  CASE WHEN first_start IS NOT NULL THEN '6:30 PM - 9:00 PM' END AS event_times
FROM stores s LEFT JOIN ({_SITES}) w ON w.store_id = s.id
LEFT JOIN (SELECT * FROM store_external_refs WHERE provider = 'google_places') g ON g.store_id = s.id
""")
def display_columns(d):
    return pb.display_columns(d.stores, d.store_external_refs)


@query(f"""
SELECT id, metro, CASE WHEN miles < 1 THEN printf('%.0f', miles * 5280) || ' ft' ELSE printf('%.1f', miles) || ' mi' END AS distance FROM (
  SELECT s.id, p.metro, round({_haversine('p', 's')}, 2) / 500 + 0.003e0 AS miles FROM stores s, {_METROS} WHERE s.latitude IS NOT NULL)
""")
def distance_text(d):
    rows = _from_metros(d).withColumn("miles", F.round("miles", 2) / 500 + F.lit(0.003))
    return rows.select("id", "metro", pb.distance_text(F.col("miles")).alias("distance"))


_CATS = "(SELECT store_id, list(category ORDER BY category) AS cats FROM store_categories GROUP BY store_id)"
_TITLES = f"""
  SELECT s.*, {_CITY} AS c, coalesce({sql_map(cat.TITLE_LABELS)}[cats[1]], 'Game') AS kind,
    coalesce({sql_map(cat.CATEGORY_PHRASES)}[cats[1]], 'local game store') AS phrase
  FROM stores s LEFT JOIN {_CATS} k ON k.store_id = s.id
"""


@query(f"""
SELECT id, CASE WHEN length(full_title) <= 60 THEN full_title WHEN length(compact) <= 60 THEN compact
  ELSE rtrim(left(name, CAST(59 - length(' — ' || kind || ' store') AS BIGINT))) || '… — ' || kind || ' store' END AS title
FROM (SELECT *, name || ' — ' || kind || ' store in ' || state AS compact,
        name || ' — ' || kind || ' store in ' || CASE WHEN contains(lower(name), lower(c)) THEN state ELSE c || ', ' || state END AS full_title
      FROM (SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 7 = 2 THEN name || ' of the very long and winding ' || city ELSE name END AS name) FROM ({_TITLES})))
""")
def store_title(d):
    pages = dr.attach_categories(d.stores, d.store_categories)
    long = F.concat("name", F.lit(" of the very long and winding "), "city")
    pages = pages.withColumn("name", F.when(F.col("id").cast("bigint") % 7 == 2, long).otherwise(F.col("name")))
    return pages.select("id", pb.store_title("name", "city", "state", "categories").alias("title"))


@query(f"""
SELECT id, CASE WHEN days IS NOT NULL AND length(base || ' ' || days || '.' || tail) <= 160 THEN base || ' ' || days || '.' || tail
  WHEN length(base || tail) <= 160 THEN base || tail ELSE rtrim(left(base || tail, 159)) || '…' END AS description
FROM (
  SELECT t.id, CASE WHEN contains(lower(name), lower(c)) THEN name || ', ' || state ELSE name || ' in ' || c || ', ' || state END || ' — ' || phrase || '.' AS base,
    ' See hours, address' || CASE WHEN w.has_events THEN ' & events' ELSE '' END || ' on Our Directory.' AS tail,
    CASE WHEN lines IS NULL THEN NULL WHEN contains(lines[1], 'Closed') AND contains(lines[4], 'Closed') THEN 'Open Tue-Wed'
       WHEN contains(lines[4], 'Closed') THEN 'Open Mon-Wed' WHEN contains(lines[1], 'Closed') THEN 'Open Tue-Sat' ELSE 'Open Mon-Sat' END AS days
  FROM ({_TITLES}) t LEFT JOIN ({_SITES}) w ON w.store_id = t.id LEFT JOIN ({_PLACES}) g ON g.store_id = t.id)
""")
def store_meta_description(d):
    pages = pb.store_pages(d.stores, d.online_presences, d.store_external_refs, d.store_categories)
    return pb.store_metadata(pages).select("id", "description")


_FAQ = f"""
  SELECT id, unnest([
    {{'n': 1, 'q': 'Where is ' || name || ' located?', 'a': name || ' is located at ' || street || ', ' || {_CITY} || ', ' || state || ' ' || zip_code || '.'}},
    CASE WHEN phone <> '' THEN {{'n': 2, 'q': 'What is ' || name || '''s phone number?', 'a': 'You can reach ' || name || ' by phone at ' || phone || '.'}} END,
    CASE WHEN lines IS NOT NULL THEN {{'n': 3, 'q': 'What are ' || name || '''s hours?', 'a': name || '''s hours are: ' || array_to_string(lines, ', ') || '.'}} END,
    CASE WHEN website IS NOT NULL THEN {{'n': 4, 'q': 'Does ' || name || ' have a website?', 'a': 'Yes, you can visit ' || name || '''s website at ' || website || '.'}} END,
    CASE WHEN len(products) > 0 THEN {{'n': 5, 'q': 'What games does ' || name || ' sell?',
      'a': name || ' carries ' || array_to_string([coalesce({_LABELS}[x], x) FOR x IN products], ', ') || '.'}} END,
    CASE WHEN list_contains(products, 'mtg') THEN {{'n': 6, 'q': 'Does ' || name || ' sell Magic: The Gathering cards?', 'a': 'Yes, ' || name || ' sells Magic: The Gathering cards.'}} END,
    CASE WHEN list_contains(products, 'pokemon') THEN {{'n': 7, 'q': 'Does ' || name || ' sell Pokemon cards?', 'a': 'Yes, ' || name || ' sells Pokemon TCG cards.'}} END,
    CASE WHEN list_contains(products, 'miniatures') THEN {{'n': 8, 'q': 'Does ' || name || ' have Warhammer products?', 'a': 'Yes, ' || name || ' carries Warhammer and miniatures products.'}} END,
    CASE WHEN has_events THEN {{'n': 9, 'q': 'Does ' || name || ' host events?',
      'a': 'Yes, ' || name || ' hosts in-store events.' || coalesce(' Check their events schedule at ' || event_url || '.', '')}} END,
    CASE WHEN id IN (SELECT store_id FROM online_presences WHERE sells_mtg_singles) THEN {{'n': 10, 'q': 'Can I buy Magic: The Gathering singles from ' || name || ' online?',
      'a': 'Yes, ' || name || ' sells Magic: The Gathering singles through their online presence.'}} END,
    CASE WHEN wpn_level <> '' THEN {{'n': 11, 'q': 'Is ' || name || ' a WPN store?', 'a': 'Yes, ' || name || ' is a ' ||
      CASE wpn_level WHEN 'premium' THEN 'WPN Premium' ELSE 'WPN Core' END || ' member of Wizards Play Network.'}} END,
    CASE WHEN lines IS NOT NULL THEN {{'n': 12, 'q': 'What is ' || name || '''s rating?', 'a': name || ' has a ' || printf('%.1f', rating) ||
      ' out of 5 star rating on Google based on ' || reviews || ' reviews.'}} END]) AS item
  FROM stores s LEFT JOIN ({_SITES}) w ON w.store_id = s.id
  LEFT JOIN (SELECT store_id, lines, CAST(payload->>'rating' AS DOUBLE) AS rating, payload->>'user_rating_count' AS reviews FROM ({_PLACES})) g ON g.store_id = s.id
  LEFT JOIN (SELECT store_id, arg_min(url, url || id) AS website FROM online_presences WHERE channel_type = 'website' AND status = 'active' GROUP BY store_id) o
    ON o.store_id = s.id
"""


@query(f"""
SELECT id, row_number() OVER (PARTITION BY id ORDER BY item.n) AS position, item.q AS question, item.a AS answer FROM ({_FAQ}) WHERE item IS NOT NULL
""")
def store_faq(d):
    out = pb.faq_rows(pb.store_pages(d.stores, d.online_presences, d.store_external_refs, d.store_categories))
    return out.withColumn("position", F.col("position").cast("bigint"))


@query(f"""
SELECT id, 'FAQPage' AS kind, count(*) AS questions, arg_max(item.a, item.n) AS last_answer FROM ({_FAQ}) WHERE item IS NOT NULL GROUP BY id
""")
def faq_jsonld(d):
    """The documents, read back."""
    pages = pb.store_pages(d.stores, d.online_presences, d.store_external_refs, d.store_categories)
    back = F.from_json(pb.faq_jsonld(pb.store_faq()), "`@type` string, mainEntity array<struct<acceptedAnswer: struct<text: string>>>")
    out = pages.select("id", back.alias("b")).select("id", F.col("b.@type").alias("kind"), F.col("b.mainEntity.acceptedAnswer.text").alias("texts"))
    return out.select("id", "kind", F.size("texts").cast("bigint").alias("questions"), F.element_at("texts", -1).alias("last_answer"))


@query(f"""
SELECT s.id, s.name, 'https://directory.example.com/store/' || CASE WHEN s.slug <> '' THEN s.slug ELSE s.id END AS url, s.phone,
  s.latitude, g.rating, coalesce(len(periods), 0) AS specs, coalesce(l.links, 0) AS links
FROM stores s LEFT JOIN (SELECT store_id, CAST(payload->>'rating' AS DOUBLE) AS rating, periods FROM ({_PLACES})) g ON g.store_id = s.id
LEFT JOIN (SELECT store_id, count(*) AS links FROM online_presences WHERE status = 'active' GROUP BY store_id) l ON l.store_id = s.id
""")
def business_jsonld(d):
    """The documents, read back to the fields that the check SQL can compute."""
    pages = pb.store_pages(d.stores, d.online_presences, d.store_external_refs, d.store_categories)
    back = F.from_json("document", "`@id` string, name string, telephone string, geo struct<latitude: double>,"
                       " sameAs array<string>, openingHoursSpecification array<struct<opens: string>>, aggregateRating struct<ratingValue: double>")
    return pages.select("id", pb.business_jsonld().alias("document")).select("id", back.alias("b")).select(
        "id", "b.name", F.col("b.@id").alias("url"), F.col("b.telephone").alias("phone"), F.col("b.geo.latitude").alias("latitude"),
        F.col("b.aggregateRating.ratingValue").alias("rating"),
        F.coalesce(F.size("b.openingHoursSpecification"), F.lit(0)).cast("bigint").alias("specs"),
        F.coalesce(F.size("b.sameAs"), F.lit(0)).cast("bigint").alias("links"),
    )


@query("""
SELECT state, city_key, count(*) AS total, string_agg(name, '|' ORDER BY position) FILTER (WHERE position <= 25) AS names FROM (
  SELECT *, upper(city) AS city_key, row_number() OVER (PARTITION BY state, upper(city)
    ORDER BY CASE WHEN premium_status = 'premium' THEN 0 ELSE 1 END, name, id) AS position FROM visible) GROUP BY state, city_key
""")
def city_jsonld(d):
    """The documents, read back to their item names."""
    out = pb.city_jsonld(d.stores, d.store_external_refs)
    back = F.from_json("document", "mainEntity struct<itemListElement: array<struct<item: struct<name: string>>>>")
    return out.select("state", "city_key", "total", F.array_join(back["mainEntity"]["itemListElement"]["item"]["name"], "|").alias("names"))


@query(f"""
SELECT count(*) AS items, string_agg(name || '=' || slug, '|' ORDER BY distance, id) AS listed FROM (
  SELECT id, name, slug, {_arc('33.94', '-112.07')} AS distance FROM visible
  WHERE latitude BETWEEN 33.94 - 500 / 69.0e0 AND 33.94 + 500 / 69.0e0
    AND longitude BETWEEN -112.07 - 500 / (69.0e0 * cos(radians(33.94))) AND -112.07 + 500 / (69.0e0 * cos(radians(33.94)))
  ORDER BY distance, id LIMIT 50) WHERE distance <= 500
""")
def nearby_jsonld(d):
    """The document, read back."""
    out = pb.nearby_jsonld(near.nearby(d.stores, d.store_external_refs, 33.94, -112.07, radius=500))
    back = F.from_json("document", "mainEntity struct<numberOfItems: bigint, itemListElement: array<struct<item: struct<name: string, url: string>>>>")
    names = F.transform("m.itemListElement.item", lambda e: F.concat(e["name"], F.lit("="), F.element_at(F.split(e["url"], "/"), -1)))
    return out.select(back["mainEntity"].alias("m")).select(F.col("m.numberOfItems").alias("items"), F.array_join(names, "|").alias("listed"))


@query("SELECT id, coalesce(strftime(last_checked, '%b %-d, %Y'), '—') AS checked FROM online_presences")
def display_dates(d):
    return d.online_presences.select("id", pb.day_text(F.col("last_checked")).alias("checked"))


@query(f"""
SELECT count(*) AS states, string_agg(state || '=' || {STATE_SLUGS}[state], ',' ORDER BY state) AS listed FROM (SELECT DISTINCT state FROM visible)
""")
def states_jsonld(d):
    """The document, read back."""
    out = pb.states_jsonld(dr.state_index(d.stores, d.online_presences, d.store_external_refs))
    back = F.from_json("document", "mainEntity string, numberOfItems bigint, itemListElement array<struct<name: string, url: string>>")
    names = F.transform("b.itemListElement", lambda e: F.concat(e["name"], F.lit("="), F.element_at(F.split(e["url"], "/"), -1)))
    return out.select(back.alias("b")).select(F.col("b.numberOfItems").alias("states"), F.array_join(names, ",").alias("listed"))


_SITEMAP = f"""
SELECT url, priority, change_frequency FROM (
  SELECT * FROM (VALUES ('https://directory.example.com', 1.0e0, 'weekly'), ('https://directory.example.com/affiliate-disclosure', 0.3e0, 'yearly'),
    ('https://directory.example.com/guides', 0.7e0, 'weekly'), ('https://directory.example.com/comics', 0.9e0, 'weekly'),
    ('https://directory.example.com/retro-games', 0.9e0, 'weekly'), ('https://directory.example.com/warhammer', 0.9e0, 'weekly')) v(url, priority, change_frequency)
  UNION ALL SELECT DISTINCT 'https://directory.example.com/guides/' || lower(p_type), 0.7e0, 'monthly' FROM part
  UNION ALL SELECT 'https://directory.example.com/stores/' || {STATE_SLUGS}[state], 0.8e0, 'weekly' FROM (SELECT DISTINCT state FROM visible)
  UNION ALL SELECT 'https://directory.example.com/stores/' || {STATE_SLUGS}[state] || '/' || {CITY_SLUG}, 0.6e0, 'weekly'
    FROM (SELECT state, city FROM visible GROUP BY state, city HAVING count(*) >= 2)
  UNION ALL SELECT 'https://directory.example.com/store/' || slug, 0.4e0, 'monthly' FROM (SELECT slug FROM visible ORDER BY id))
"""


@query(_SITEMAP)
def sitemap(d):
    guides = d.part.select(F.lower("p_type").alias("slug"), F.lit("2024-01-01").alias("updated")).distinct()
    return pb.sitemap(d.stores, d.store_external_refs, guides).select("url", "priority", "change_frequency")


@query(f"""
SELECT (r - 1) // 100 AS file_no, count(*) AS urls FROM (SELECT row_number() OVER () AS r FROM ({_SITEMAP})) GROUP BY 1
""")
def sitemap_index(d):
    """Files of a hundred rows, so that the given tables fill some."""
    guides = d.part.select(F.lower("p_type").alias("slug"), F.lit("2024-01-01").alias("updated")).distinct()
    files = pb.sitemap_files(pb.sitemap(d.stores, d.store_external_refs, guides), per_file=100)
    return pb.sitemap_index(files).select(F.col("file_no").cast("long").alias("file_no"), "urls")


@query(f"SELECT id, coalesce({sql_map(cat.PLATFORM_LABELS)}[platform], '') AS label FROM online_presences")
def platform_labels(d):
    return d.online_presences.select("id", F.coalesce(pb.platform_label("platform"), F.lit("")).alias("label"))
