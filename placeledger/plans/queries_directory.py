"""Registered queries for directory reads, filters and plain joins, each with its check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions import text as tx
from placeledger.operators import directory as dr
from placeledger.operators import filters as fl
from placeledger.plans.registry import query
from placeledger.plans.views import AS_OF, AS_OF_ORDERS

_PUBLIC = "status IN ('active', 'verified', 'candidate')"
_COUNTS = """count(*) AS store_count,
  count(*) FILTER (WHERE status IN ('active', 'verified')) AS active_count,
  count(*) FILTER (WHERE wpn_level = 'premium') AS wpn_premium_count,
  count(*) FILTER (WHERE id IN (SELECT store_id FROM online_ids)) AS online_count"""


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_map(table: dict[str, str]) -> str:
    """A map literal of the check engine."""
    q = lambda v: "'" + v.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"


STATE_SLUGS = sql_map({code: name.lower().replace(" ", "-") for name, code in cat.STATE_CODES.items()})
CITY_SLUG = (
    "regexp_replace(regexp_replace(replace(lower(regexp_replace(trim(city), '[^a-zA-Z0-9 -]', '', 'g')), ' ', '-'),"
    " '-{2,}', '-', 'g'), '^-|-$', '', 'g')"
)


@query(f"""
SELECT state, {STATE_SLUGS}[state] AS slug, {_COUNTS}
FROM visible WHERE state IS NOT NULL GROUP BY state ORDER BY store_count DESC, state
""")
def state_index(d):
    return dr.state_index(d.stores, d.online_presences, d.store_external_refs)


@query(f"SELECT state, count(*) AS store_count FROM stores WHERE {_PUBLIC} AND state IS NOT NULL GROUP BY state")
def plain_state_counts(d):
    return dr.plain_state_counts(d.stores)


@query(f"""
SELECT state, city, {CITY_SLUG} AS slug, {_COUNTS} FROM visible WHERE state IS NOT NULL AND city IS NOT NULL GROUP BY state, city
""")
def city_index(d):
    return dr.city_index(d.stores, d.online_presences, d.store_external_refs)


@query(f"""
WITH c AS (SELECT state, city, upper(city) AS city_key, {CITY_SLUG} AS slug, {_COUNTS} FROM visible
           WHERE state IS NOT NULL AND city IS NOT NULL GROUP BY state, city)
SELECT state, for_key, position, city, slug, store_count, active_count, wpn_premium_count, online_count FROM (
  SELECT t.state, t.for_key, c.*, row_number() OVER (PARTITION BY t.state, t.for_key ORDER BY store_count DESC, city) AS position
  FROM (SELECT DISTINCT state, city_key AS for_key FROM c) t JOIN c ON c.state = t.state AND c.city_key <> t.for_key)
WHERE position <= 8
""")
def nearby_cities(d):
    out = dr.nearby_cities(d.stores, d.online_presences, d.store_external_refs)
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("""
SELECT city, state, count(*) AS store_count FROM visible GROUP BY city, state
ORDER BY store_count DESC, state, city LIMIT 12
""")
def popular_cities(d):
    return dr.popular_cities(d.stores, d.store_external_refs)


@query(f"""
SELECT city, state, {STATE_SLUGS}[state] AS state_slug, {CITY_SLUG} AS city_slug FROM visible
GROUP BY city, state ORDER BY count(*) DESC, state, city LIMIT 500
""")
def top_city_slugs(d):
    return dr.top_city_slugs(d.stores, d.store_external_refs)


@query("""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY store_count DESC, state, city) AS rank FROM (
    SELECT category, state, city, count(*) AS store_count
    FROM visible JOIN store_categories ON store_id = id GROUP BY category, state, city)) WHERE rank <= 10
""")
def top_cities_for_category(d):
    out = dr.top_cities_for_category(d.stores, d.store_external_refs, d.store_categories)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT category, count(*) AS stores FROM store_categories GROUP BY category")
def category_stats(d):
    return dr.category_stats(d.store_categories)


@query("SELECT product AS tag, count(DISTINCT store_id) AS stores FROM ref_products GROUP BY product")
def game_tag_counts(d):
    return dr.game_tag_counts(d.store_external_refs)


@query("SELECT count(*) AS total, CAST(floor(count(*) / 100) * 100 AS BIGINT) AS rounded FROM visible")
def total_public(d):
    return dr.total_public(d.stores, d.store_external_refs)


@query("""
SELECT DISTINCT 'state' AS kind, state AS value FROM stores WHERE state IS NOT NULL
UNION ALL SELECT DISTINCT 'status', status FROM stores
UNION ALL SELECT DISTINCT 'wpn_level', wpn_level FROM stores WHERE wpn_level IS NOT NULL
UNION ALL SELECT DISTINCT 'category', category FROM store_categories
""")
def filter_options(d):
    return dr.filter_options(d.stores, d.store_categories)


_LISTED = ["id", "name", "city", "state", "status", "wpn_level", "premium_status"]
_ORDER = "CASE WHEN premium_status = 'premium' THEN 0 ELSE 1 END, name, id"


@query(f"SELECT {', '.join(_LISTED)} FROM visible ORDER BY {_ORDER} LIMIT 25 OFFSET 25")
def list_stores_page(d):
    return dr.page_of(dr.list_stores(d.stores, d.store_external_refs), page=2).select(*_LISTED)


@query(f"SELECT {', '.join(_LISTED)} FROM visible WHERE state = 'CA' ORDER BY {_ORDER} LIMIT 25")
def list_stores_by_state(d):
    return dr.page_of(dr.list_stores(d.stores, d.store_external_refs, state="ca")).select(*_LISTED)


@query(f"""SELECT {', '.join(_LISTED)} FROM visible WHERE state = 'TX' AND upper(city) = 'CITY 3' ORDER BY {_ORDER} LIMIT 25""")
def list_stores_by_city(d):
    return dr.page_of(dr.list_stores(d.stores, d.store_external_refs, state="TX", city="city 3")).select(*_LISTED)


@query(f"""
SELECT {', '.join(_LISTED)} FROM visible
WHERE id IN (SELECT store_id FROM online_presences WHERE sells_mtg_singles = false)
  AND id IN (SELECT store_id FROM store_categories WHERE category = 'comic_shop')
  AND id IN (SELECT store_id FROM ref_products WHERE product = 'mtg')
""")
def list_stores_having(d):
    rows = dr.list_stores(
        d.stores, d.store_external_refs, d.online_presences, d.store_categories,
        sells_singles=False, category="comic_shop", product="mtg",
    )
    return rows.select(*_LISTED)


@query("""
SELECT s.id, s.name, s.city, s.state FROM stores s
WHERE s.status = 'unresponsive' AND s.slug IS NOT NULL AND trim(s.slug) <> '' AND s.discovery_source = 'wpn'
  AND (s.name ILIKE '%city 1_, %' OR s.city ILIKE '%city 1_, %' OR s.state ILIKE '%city 1_, %'
       OR (s.city || ', ' || s.state) ILIKE '%city 1_, %')
""")
def search_stores(d):
    rows = dr.list_stores(d.stores, d.store_external_refs, status="unresponsive", source="wpn", search="city 1_, ")
    return rows.select("id", "name", "city", "state")


@query(f"""
SELECT {', '.join(_LISTED)} FROM visible WHERE id IN (SELECT store_id FROM store_categories WHERE category = 'retro_games')
ORDER BY {_ORDER} LIMIT 25
""")
def list_by_category(d):
    rows = dr.list_stores(d.stores, d.store_external_refs, categories=d.store_categories, category="retro_games")
    return dr.page_of(rows, page=1).select(*_LISTED)


@query(f"""
SELECT id, name, CAST(premium_until AS VARCHAR) AS premium_until FROM visible
WHERE premium_status = 'premium' AND premium_until > TIMESTAMP '{AS_OF}' AND hero_image_url IS NOT NULL
ORDER BY name, id LIMIT 8
""")
def featured(d):
    out = dr.featured(d.stores, d.store_external_refs, AS_OF)
    return out.select("id", "name", F.col("premium_until").cast("string").alias("premium_until"))


@query(f"""
SELECT id, store_id, title, strftime(event_date, '%Y-%m-%d') AS event_date, position FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY event_date, length(id), id) AS position
  FROM store_events WHERE event_date >= DATE '{AS_OF_ORDERS[:10]}') WHERE position <= 20
""")
def upcoming_events(d):
    out = dr.upcoming_events(d.store_events, AS_OF_ORDERS[:10])
    return out.select("id", "store_id", "title", F.col("event_date").cast("string").alias("event_date"),
                      F.col("position").cast("bigint").alias("position"))


@query("""
SELECT s.id, s.name, p.id AS presence_id, p.channel_type, p.url, p.status AS presence_status
FROM stores s LEFT JOIN online_presences p ON p.store_id = s.id
""")
def store_with_presences(d):
    return dr.store_with_presences(d.stores, d.online_presences).select(
        "id", "name", "presence_id", "channel_type", "url", "presence_status"
    )


@query("""
SELECT s.id AS store_id, s.slug AS store_slug, s.name AS store_name, s.state, s.city, p.id AS presence_id,
       p.url AS presence_url, p.channel_type, p.platform, p.estimated_inventory_size
FROM stores s JOIN online_presences p ON p.store_id = s.id
WHERE p.sells_mtg_singles AND s.slug IS NOT NULL AND trim(s.slug) <> ''
""")
def online_sellers(d):
    return dr.online_sellers(d.stores, d.online_presences)


@query("""
SELECT s.id,
  EXISTS (SELECT 1 FROM store_external_refs r WHERE r.store_id = s.id AND r.provider = 'games_workshop') AS has_games_workshop,
  EXISTS (SELECT 1 FROM ref_products r WHERE r.store_id = s.id) AS has_products,
  EXISTS (SELECT 1 FROM online_presences p WHERE p.store_id = s.id AND p.status = 'active') AS has_active_presence,
  EXISTS (SELECT 1 FROM online_presences p WHERE p.store_id = s.id AND p.status = 'active' AND p.sells_mtg_singles)
    AS sells_singles_online
FROM stores s
""")
def evidence_flags(d):
    return dr.evidence_flags(d.stores, d.store_external_refs, d.online_presences).select(
        "id", "has_games_workshop", "has_products", "has_active_presence", "sells_singles_online"
    )


@query("""
SELECT c.state, c.city, x.description FROM (SELECT DISTINCT state, city FROM stores) c
LEFT JOIN city_descriptions x ON upper(x.state) = upper(c.state) AND upper(x.city) = upper(c.city)
""")
def attach_city_text(d):
    return dr.attach_city_text(d.stores.select("state", "city").distinct(), d.city_descriptions)


@query("""
SELECT s.id, coalesce(string_agg(category, ',' ORDER BY category), '') AS categories
FROM stores s LEFT JOIN store_categories c ON c.store_id = s.id GROUP BY s.id
""")
def attach_categories(d):
    out = dr.attach_categories(d.stores, d.store_categories)
    return out.select("id", F.array_join("categories", ",").alias("categories"))


@query("""
SELECT store_id, position, other_id, other_name FROM (
  SELECT s.id AS store_id, v.id AS other_id, v.name AS other_name,
         row_number() OVER (PARTITION BY s.id ORDER BY v.name, v.id) AS position
  FROM stores s JOIN visible v ON upper(v.state) = upper(s.state) AND upper(v.city) = upper(s.city) AND v.id <> s.id)
WHERE position <= 6
""")
def other_in_city(d):
    out = dr.other_in_city(d.stores, d.store_external_refs)
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("""
SELECT id AS store_id, 'lgs' AS category FROM stores
WHERE discovery_source IN ('wpn', 'google_places', 'tcgplayer', 'manual')
  AND NOT EXISTS (SELECT 1 FROM store_categories c WHERE c.store_id = stores.id AND c.category = 'lgs')
""")
def backfill_category(d):
    return dr.backfill_category(d.stores, d.store_categories)


@query("""
SELECT r.request_id, r.path,
  CASE WHEN NOT starts_with(path, '/store/') THEN 'pass'
       WHEN regexp_matches(tok, '^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') THEN
         CASE WHEN u.id IS NULL THEN 'missing' WHEN u.slug IS NULL THEN 'pass' ELSE 'redirect' END
       WHEN tok IN (SELECT lower(slug) FROM uuid_stores WHERE slug <> '' AND status <> 'closed') THEN 'pass'
       ELSE 'missing' END AS outcome,
  CASE WHEN u.slug IS NOT NULL THEN '/store/' || u.slug END AS location
FROM (SELECT *, lower(regexp_extract(path, '^/store/([^/]*)', 1)) AS tok FROM requests) r
LEFT JOIN uuid_stores u ON u.id = r.tok AND starts_with(path, '/store/')
""")
def redirect_map(d):
    return dr.redirect_map(d.requests, d.uuid_stores)


# --- filters -------------------------------------------------------------------------------------------------

def _re(patterns) -> str:
    """Patterns as one check-engine alternation. Names and place texts of the views are ASCII."""
    return "'(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "'"


@query(f"""
SELECT id, display_name, regexp_matches(display_name, {_re(cat.NAME_BLOCK_PATTERNS)})
  AND NOT regexp_matches(display_name, {_re(cat.NAME_ALLOW_PATTERNS)}) AS blocked FROM google_raw
""")
def name_blocked(d):
    return d.google_raw.select("id", "display_name", fl.name_blocked("display_name").alias("blocked"))


@query(f"""
SELECT id, list_has_any(string_split(type_list, ','), [{sql_in(cat.BLOCKED_PLACE_TYPES)[1:-1]}])
  AND NOT list_has_any(string_split(type_list, ','), ['book_store', 'toy_store', 'store']) AS blocked FROM google_raw
""")
def types_blocked(d):
    return d.google_raw.select("id", fl.types_blocked(F.split("type_list", ",")).alias("blocked"))


@query("""
WITH c AS (SELECT store_id, CAST(payload->>'confidence' AS DOUBLE) AS conf,
                  store_id IN (SELECT store_id FROM ref_products) AS found
           FROM store_external_refs WHERE provider = 'website_content')
SELECT store_id, (NOT found AND conf < 0.5) AS should_reject,
  CASE WHEN NOT found AND conf < 0.5 THEN printf('0 products detected, confidence=%.2f (threshold=0.5)', conf) ELSE '' END AS reason
FROM c
""")
def content_gate(d):
    refs = fl.content_refs(d.store_external_refs)
    return refs.select("store_id", fl.content_gate(F.col("content.products"), F.col("confidence")).alias("g")).select(
        "store_id", "g.should_reject", "g.reason"
    )


@query("SELECT id, name, slug FROM visible")
def visible_stores(d):
    return fl.visible(d.stores, d.store_external_refs).select("id", "name", "slug")


@query("""
SELECT id FROM stores
WHERE NOT (status = 'candidate' AND wpn_id IS NULL AND id NOT IN (SELECT store_id FROM trusted_refs))
""")
def trusted_stores(d):
    return fl.trusted_only(d.stores, d.store_external_refs).select("id")


@query(f"SELECT id, status FROM stores WHERE {_PUBLIC} AND slug IS NOT NULL AND trim(slug) <> ''")
def public_stores(d):
    return fl.public_only(d.stores).select("id", "status")


@query(f"SELECT id, state FROM stores WHERE upper(trim(state)) IN {sql_in(cat.US_STATE_CODES)}")
def us_only(d):
    return fl.us_only(d.stores).select("id", "state")


@query("""
SELECT s.id, (NOT phoned AND NOT timed AND NOT reached) AS thin,
  (phoned OR timed OR reached) AND status IN ('active', 'verified', 'candidate') AND coalesce(slug, '') <> '' AS indexable
FROM (SELECT *, coalesce(phone, '') <> '' AS phoned,
        id IN (SELECT store_id FROM store_external_refs WHERE provider = 'google_places'
               AND json_array_length(payload->'hours'->'weekday_text') > 0) AS timed,
        id IN (SELECT store_id FROM online_presences WHERE status = 'active') AS reached
      FROM stores) s
""")
def thin_pages(d):
    out = fl.indexable(d.stores, d.online_presences, d.store_external_refs)
    return out.select("id", "thin", "indexable")


@query("""
SELECT 'platform' AS stage, id FROM online_presences WHERE status = 'active' AND platform IS NULL
UNION ALL SELECT 'singles', id FROM online_presences WHERE status = 'active' AND sells_mtg_singles IS NULL
UNION ALL SELECT 'pricing', p.id FROM online_presences p JOIN stores s ON s.id = p.store_id
  WHERE p.status = 'active' AND s.status = 'active' AND sells_mtg_singles AND channel_type = 'website'
UNION ALL SELECT 'freshness', p.id FROM online_presences p JOIN stores s ON s.id = p.store_id
  WHERE p.status = 'active' AND s.status = 'active' AND sells_mtg_singles AND channel_type = 'website'
    AND platform IN ('crystal_commerce', 'binderpos', 'shopify', 'squarespace', 'woocommerce', 'wordpress_stripe')
UNION ALL SELECT 'content', id FROM (
  SELECT id, row_number() OVER (PARTITION BY url ORDER BY length(id), id) AS r FROM online_presences
  WHERE status = 'active' AND channel_type = 'website' AND NOT contains(url, 'facebook.com')
    AND store_id NOT IN (SELECT store_id FROM store_external_refs WHERE provider = 'website_content')) WHERE r = 1
""")
def work_queues(d):
    parts = [
        fl.work_queue(d.online_presences, d.stores, d.store_external_refs, stage).select(F.lit(stage).alias("stage"), "id")
        for stage in ("platform", "singles", "pricing", "freshness", "content")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""
SELECT s.id, s.name, s.google_place_id FROM stores s
LEFT JOIN store_external_refs r ON r.store_id = s.id AND r.provider = 'google_places'
WHERE s.google_place_id <> '' AND (payload IS NULL OR coalesce(payload->>'enriched_at', '') = ''
  OR TRY_CAST(replace(payload->>'enriched_at', 'Z', '') AS TIMESTAMP) IS NULL
  OR TRY_CAST(replace(payload->>'enriched_at', 'Z', '') AS TIMESTAMP) < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)
""")
def needs_enrichment(d):
    return fl.needs_enrichment(d.stores, d.store_external_refs, AS_OF)


@query("SELECT id, name, city, state FROM stores WHERE coalesce(google_place_id, '') = '' AND status <> 'closed'")
def missing_place_id(d):
    return fl.missing_place_id(d.stores)


_CHOSEN = """
  SELECT store_id, id AS presence_id, url, channel_type FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY
      CASE WHEN channel_type = 'website' AND NOT contains(lower(url), 'facebook.com') AND NOT contains(lower(url), 'instagram.com')
           THEN 0 ELSE 1 END, length(id), id) AS r
    FROM online_presences WHERE status = 'active') WHERE r = 1
"""


@query(_CHOSEN)
def choose_presence(d):
    return fl.choose_presence(d.online_presences)


@query(f"""
SELECT s.id, s.name, s.state, s.status, c.presence_id, c.url FROM stores s JOIN ({_CHOSEN}) c ON c.store_id = s.id
WHERE s.status IN ('active', 'verified', 'candidate', 'unresponsive')
  AND s.id IN (SELECT store_id FROM online_presences WHERE status = 'active' AND channel_type = 'website')
  AND s.id NOT IN (SELECT store_id FROM store_external_refs WHERE provider = 'website_content')
  AND NOT contains(c.url, 'facebook.com')
""")
def enrichment_candidates(d):
    return fl.enrichment_candidates(d.stores, d.online_presences, d.store_external_refs)


@query("""
WITH listed AS (SELECT DISTINCT p_name AS fragment, city, state FROM stores JOIN part ON p_partkey = CAST(id AS BIGINT))
SELECT l.fragment, s.id, s.name, s.city, s.state, s.status
FROM listed l JOIN stores s ON s.name ILIKE '%' || upper(l.fragment) || '%'
  AND upper(s.city) = upper(l.city) AND upper(s.state) = upper(l.state)
WHERE s.status <> 'closed'
""")
def lookup_by_name_city(d):
    # The list to close: every part name seen in a city.
    names = d.part.select(F.col("p_partkey").cast("string").alias("id"), F.upper("p_name").alias("fragment"))
    listed = d.stores.join(names, "id").select("fragment", "city", "state").distinct()
    out = fl.lookup_by_name_city(d.stores, listed)
    return out.withColumn("fragment", F.lower("fragment"))
