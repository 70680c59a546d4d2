"""Registered queries for lifecycle, prices, set jobs and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.operators import audit as au
from placeledger.operators import lifecycle as lc
from placeledger.operators import pricing as pr
from placeledger.operators import sets as st
from placeledger.plans.queries_directory import _COUNTS, _PUBLIC, sql_in, sql_map
from placeledger.plans.registry import query
from placeledger.plans.views import AS_OF_ORDERS

_ORDERED = "ts DESC, seq DESC, seq2 DESC, seq3 DESC"


def _failing(n: int, logs: str = "validation_logs") -> str:
    return f"""
  SELECT presence_id FROM (
    SELECT presence_id, result->>'status' AS state, row_number() OVER (PARTITION BY presence_id ORDER BY {_ORDERED}) AS r
    FROM {logs} WHERE check_type = 'http_check')
  WHERE r <= {n} GROUP BY presence_id HAVING count(*) = {n} AND bool_and(state IN ('unreachable', 'dead'))
"""


@query(_failing(3))
def consecutive_failures(d):
    return lc.consecutive_failures(d.validation_logs)


@query(_failing(2))
def went_offline(d):
    return lc.consecutive_failures(d.validation_logs, 2)


@query("SELECT store_id, count(*) AS presences FROM online_presences GROUP BY store_id HAVING bool_and(status = 'dead')")
def all_dead(d):
    return lc.all_dead(d.online_presences)


def _evaluation(stores: str, presences: str, logs: str) -> str:
    return f"""
  SELECT id, status, target FROM (
    SELECT s.id, s.status, CASE
      WHEN s.status = 'candidate' AND s.id IN (SELECT store_id FROM {logs}) THEN 'verified'
      WHEN s.status = 'verified' AND s.id IN (SELECT store_id FROM {presences} WHERE sells_mtg_singles) THEN 'active'
      WHEN s.status = 'active' AND w.sites > 0 AND w.sites = w.bad THEN 'unresponsive'
      WHEN s.status = 'unresponsive' AND s.id IN (SELECT store_id FROM {presences} WHERE status = 'active') THEN 'active'
      END AS target
    FROM {stores} s LEFT JOIN (
      SELECT store_id, count(*) AS sites, count(*) FILTER (WHERE id IN ({_failing(3, logs)})) AS bad
      FROM {presences} WHERE channel_type = 'website' GROUP BY store_id) w ON w.store_id = s.id)
  WHERE target IS NOT NULL
"""


@query(_evaluation("stores", "online_presences", "validation_logs"))
def evaluate_status(d):
    return lc.evaluate_status(d.stores, d.online_presences, d.validation_logs)


@query(f"SELECT s.id, coalesce(t.target, s.status) AS status FROM stores s LEFT JOIN ({_evaluation('stores', 'online_presences', 'validation_logs')}) t ON t.id = s.id")
def apply_transition(d):
    targets = lc.evaluate_status(d.stores, d.online_presences, d.validation_logs)
    after, _ = lc.apply_transitions(d.stores, targets.select("id", "target"), AS_OF_ORDERS)
    return after.select("id", "status")


_RUN = """
  SELECT p.id, p.store_id, c.status_code, CASE WHEN c.error IS NOT NULL THEN 'unreachable' WHEN c.status_code >= 400 THEN 'dead'
    WHEN regexp_matches(c.html, '(?i)domain\\s+(is\\s+)?for\\s+sale') THEN 'dead' ELSE 'active' END AS status
  FROM online_presences p JOIN http_checks c ON c.presence_id = p.id
  WHERE p.channel_type = 'website' AND p.store_id IN (SELECT id FROM stores WHERE status IN ('active', 'unresponsive'))
"""


@query("""
SELECT page_id, CASE WHEN error IS NOT NULL THEN 'unreachable' WHEN status_code >= 400 THEN 'dead'
    WHEN regexp_matches(html, '(?i)domain\\s+(is\\s+)?for\\s+sale') THEN 'dead' ELSE 'active' END AS status,
  CASE WHEN error = 'timeout' THEN 'Timeout' WHEN error = 'connect' THEN 'Connection refused'
    WHEN status_code >= 400 THEN 'HTTP ' || status_code
    WHEN regexp_matches(html, '(?i)domain\\s+(is\\s+)?for\\s+sale') THEN 'Soft 404 detected' END AS reason
FROM site_pages
""")
def check_status(d):
    return d.site_pages.select("page_id", lc.check_status("status_code", "html", "error").alias("c")).select(
        "page_id", "c.status", "c.reason"
    )


@query(f"SELECT id AS presence_id, store_id, status_code, status FROM ({_RUN})")
def health_results(d):
    return lc.check_results(d.online_presences, d.stores, d.http_checks).select(
        "presence_id", "store_id", "status_code", "status"
    )


_RUN_CTES = f"""
WITH run AS ({_RUN}),
after_presences AS (SELECT p.* REPLACE (coalesce(r.status, p.status) AS status) FROM online_presences p LEFT JOIN run r ON r.id = p.id),
after_logs AS (
  SELECT store_id, presence_id, check_type, result, ts, seq, seq2, seq3 FROM validation_logs
  UNION ALL SELECT store_id, id, 'http_check', '{{"status": "' || status || '"}}', TIMESTAMP '1998-12-02', NULL, NULL, NULL FROM run),
seen AS (SELECT * FROM stores WHERE id IN (SELECT store_id FROM run))
"""


@query(_RUN_CTES + _evaluation("seen", "after_presences", "after_logs"))
def health_run(d):
    return lc.health_run(d.stores, d.online_presences, d.validation_logs, d.http_checks, "1998-12-02 00:00:00")["targets"]


@query(_RUN_CTES + "SELECT id, status, http_status FROM (SELECT a.id, a.status, r.status_code AS http_status FROM after_presences a LEFT JOIN run r ON r.id = a.id)")
def health_presences(d):
    out = lc.health_run(d.stores, d.online_presences, d.validation_logs, d.http_checks, "1998-12-02 00:00:00")["presences"]
    return out.select("id", "status", "http_status")


_CLOSURES = """
  SELECT s.id, coalesce(s.google_place_id, '') <> '' AS google_checked,
    CASE WHEN b.business_status <> 'OPERATIONAL' THEN 'google_business_status=' || b.business_status
      WHEN s.id IN (SELECT store_id FROM online_presences GROUP BY store_id HAVING bool_and(status = 'dead')) THEN 'all_presences_dead'
      ELSE 'no_closure_signals' END AS reason
  FROM stores s LEFT JOIN business_status b ON b.google_place_id = s.google_place_id WHERE s.status = 'unresponsive'
"""


@query(f"SELECT id, google_checked, reason <> 'no_closure_signals' AS is_closed, reason FROM ({_CLOSURES})")
def detect_closures(d):
    return lc.detect_closures(d.stores, d.online_presences, d.business_status)


@query(f"""
SELECT count(*) AS total_checked, count(*) FILTER (WHERE google_checked) AS google_checked,
  count(*) FILTER (WHERE starts_with(reason, 'google')) AS google_closed,
  count(*) FILTER (WHERE reason = 'all_presences_dead') AS all_dead,
  count(*) FILTER (WHERE reason <> 'no_closure_signals') AS confirmed_closures,
  count(*) FILTER (WHERE reason = 'no_closure_signals') AS still_unresponsive FROM ({_CLOSURES})
""")
def closure_report(d):
    return lc.closure_report(lc.detect_closures(d.stores, d.online_presences, d.business_status))


@query("""
SELECT store_id, id, platform, previous FROM (
  SELECT *, lag(platform) OVER (PARTITION BY store_id ORDER BY last_checked, id) AS previous FROM online_presences)
WHERE previous <> platform
""")
def platform_changes(d):
    return lc.platform_changes(d.online_presences).select("store_id", "id", "platform", "previous")


_BUDGET = 500


@query(f"""
SELECT seq, escalate FROM (
  SELECT o_orderkey AS seq, o_orderstatus = 'P' AND sum(CASE WHEN o_orderstatus = 'P' THEN 5 ELSE 0 END)
    OVER (ORDER BY o_orderkey) <= {_BUDGET} AS escalate FROM orders)
""")
def budget_gate(d):
    rows = d.orders.select(F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "P").alias("unsure"))
    return lc.budget_gate(rows, "unsure", "seq", _BUDGET).select("seq", "escalate")


@query(f"""
SELECT seq, spent, unsure AND spent <= {_BUDGET} AS escalate FROM (
  SELECT o_orderkey AS seq, o_orderstatus = 'P' AS unsure, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 + o_custkey % 9 ELSE 0 END)
    OVER (ORDER BY o_orderkey) AS BIGINT) AS spent FROM orders)
""")
def running_budget(d):
    rows = d.orders.select(
        F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "P").alias("unsure"), (1 + F.col("o_custkey") % 9).alias("cost")
    )
    return lc.running_budget(rows, "unsure", "seq", "cost", _BUDGET).select("seq", "spent", "escalate")


@query("""
SELECT c.cell, lat, lng, shard, coalesce(p.points, 0) AS points FROM (
  SELECT range AS cell, (range // 30) * 2 + 24 + 1.0e0 AS lat, (range % 30) * 2 - 125 + 1.0e0 AS lng, range % 4 AS shard
  FROM range(420)) c
LEFT JOIN (SELECT CAST(floor((latitude - 24) / 2) * 30 + floor((longitude + 125) / 2) AS BIGINT) AS cell, count(*) AS points
           FROM stores WHERE latitude >= 24 AND latitude < 52 AND longitude >= -125 AND longitude < -65 GROUP BY 1) p ON p.cell = c.cell
""")
def grid_coverage(d):
    out = lc.grid_coverage(d.stores, shards=4)
    return out.withColumns({"lat": F.col("lat").cast("decimal(10,1)"), "lng": F.col("lng").cast("decimal(10,1)")}).select(
        "cell", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), "shard", "points"
    )


@query("""
WITH past AS (SELECT store_id, email, bool_or(status = 'pending') AS pending, max(created_at) AS newest FROM claims_past GROUP BY ALL),
j AS (SELECT n.event_id, n.store_id, n.email, n.created_at, s.id IS NOT NULL AS known,
        s.id IS NOT NULL AND NOT coalesce(pending, false) AND NOT coalesce(newest > n.created_at - INTERVAL 24 HOUR, false) AS free
      FROM claims_new n LEFT JOIN stores s ON s.id = n.store_id LEFT JOIN past p ON p.store_id = n.store_id AND p.email = n.email)
SELECT event_id, CASE WHEN NOT known THEN 'unknown_store'
  WHEN free AND row_number() OVER (PARTITION BY store_id, email, free ORDER BY created_at, event_id) = 1 THEN 'accepted'
  ELSE 'duplicate' END AS outcome FROM j
""")
def claim_gate(d):
    return lc.claim_gate(d.claims_past, d.claims_new, d.stores).select("event_id", "outcome")


# --- prices --------------------------------------------------------------------------------------------------

_QUOTED = {c: c.replace(",", "%2C").replace(" ", "+") for c in cat.PROBE_CARDS}


@query(f"""
SELECT presence_id, card_name, CASE platform WHEN 'crystal_commerce' THEN root || '/products/search?q=' || q
  WHEN 'shopify' THEN root || '/search?q=' || q || '&type=product' WHEN 'binderpos' THEN root || '/search?q=' || q || '&type=product'
  WHEN 'woocommerce' THEN root || '/?s=' || q || '&post_type=product' ELSE root || '/search?q=' || q END AS search_url
FROM (SELECT id AS presence_id, platform, rtrim(url, '/') AS root, unnest([{sql_in(cat.PROBE_CARDS)[1:-1]}]) AS card_name,
        unnest([{sql_in(_QUOTED.values())[1:-1]}]) AS q FROM online_presences)
""")
def search_queue(d):
    return pr.search_queue(d.online_presences)


_SAMPLES = """
  SELECT f.presence_id, f.card_name, f.price_cents, m.market_cents,
    CAST(round_even(abs(f.price_cents - m.market_cents) / m.market_cents * 100.0e0 * 10, 0) AS BIGINT) AS delta_tenths
  FROM found_prices f JOIN market_prices m ON m.card_name = f.card_name
"""
_DELTAS = f"SELECT presence_id, count(*) AS cards_found, sum(delta_tenths)::DOUBLE / 10 / count(*) AS avg_delta_pct FROM ({_SAMPLES}) GROUP BY presence_id"


@query(_SAMPLES)
def price_join(d):
    return pr.price_samples(d.found_prices, d.market_prices).select(
        "presence_id", "card_name", "price_cents", "market_cents", "delta_tenths"
    )


@query(_DELTAS)
def price_delta(d):
    return pr.price_delta(pr.price_samples(d.found_prices, d.market_prices))


@query(f"SELECT * FROM ({_DELTAS}) WHERE avg_delta_pct > 30")
def price_divergence(d):
    return pr.price_divergence(pr.price_delta(pr.price_samples(d.found_prices, d.market_prices)))


@query(f"""
SELECT p.id AS presence_id, coalesce(x.cards_found, 0) AS cards_found, coalesce(x.avg_delta_pct, 0) AS avg_delta_pct,
  CASE WHEN coalesce(cards_found, 0) < 3 THEN 'unknown' WHEN avg_delta_pct <= 15 THEN 'synced'
    WHEN avg_delta_pct > 30 THEN 'manual' ELSE 'unknown' END AS pricing_method,
  CASE WHEN coalesce(cards_found, 0) < 3 THEN 0.3e0
    WHEN avg_delta_pct <= 10 AND date_diff('day', last_checked, TIMESTAMP '1995-07-01') <= 30 THEN 0.85e0
    WHEN avg_delta_pct <= 15 THEN 0.7e0 WHEN avg_delta_pct > 30 THEN 0.8e0 ELSE 0.4e0 END AS confidence
FROM online_presences p LEFT JOIN ({_DELTAS}) x ON x.presence_id = p.id
""")
def infer_pricing(d):
    updates = d.online_presences.select(F.col("id").alias("presence_id"), F.col("last_checked").alias("last_update"))
    return pr.detect_pricing(d.online_presences, d.found_prices, d.market_prices, updates, "1995-07-01 00:00:00")


@query(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE cards_found >= 3 AND avg_delta_pct <= 15) AS synced,
  count(*) FILTER (WHERE cards_found >= 3 AND avg_delta_pct > 30) AS manual,
  count(*) FILTER (WHERE cards_found IS NULL OR cards_found < 3 OR (avg_delta_pct > 15 AND avg_delta_pct <= 30)) AS unknown
FROM online_presences p LEFT JOIN ({_DELTAS}) x ON x.presence_id = p.id
""")
def pricing_report(d):
    return au.run_report(infer_pricing(d), ["synced", "manual", "unknown"], "pricing_method")


# --- set jobs ------------------------------------------------------------------------------------------------

@query("""
SELECT o_custkey, o_orderkey, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1
""")
def first_seen_dedup(d):
    rows = d.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return st.first_seen_dedup(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
SELECT coalesce(o.provider, n.provider) AS provider, coalesce(o.external_id, n.external_id) AS external_id,
  CASE WHEN n.store_id IS NOT NULL THEN n.store_id ELSE o.store_id END AS store_id,
  CASE WHEN o.external_id IS NULL THEN n.payload WHEN n.external_id IS NULL THEN o.payload ELSE coalesce(n.payload, o.payload) END AS payload
FROM (SELECT * FROM store_external_refs WHERE provider = 'google_places') o
FULL JOIN (SELECT id AS store_id, 'google_places' AS provider, 'G' || CAST(CAST(id AS BIGINT) * 2 AS VARCHAR) AS external_id,
             CASE WHEN wpn_id IS NOT NULL THEN '{"rating": 1}' END AS payload FROM stores) n
  ON n.provider = o.provider AND n.external_id = o.external_id
""")
def snapshot_upsert(d):
    target = d.store_external_refs.filter(F.col("provider") == "google_places").select(
        "provider", "external_id", "store_id", "payload"
    )
    updates = d.stores.select(
        F.lit("google_places").alias("provider"),
        F.concat(F.lit("G"), (F.col("id").cast("bigint") * 2).cast("string")).alias("external_id"),
        F.col("id").alias("store_id"), F.when(F.col("wpn_id").isNotNull(), '{"rating": 1}').alias("payload"),
    )
    return st.snapshot_upsert(
        target, updates, ["provider", "external_id"],
        {"store_id": F.col("new.store_id"), "payload": F.coalesce("new.payload", "old.payload")},
    )


_DIFF = """
  SELECT coalesce(a.wpn_id, b.wpn_id) AS wpn_id, a.id AS store_id,
    CASE WHEN a.wpn_id IS NULL THEN 'new' WHEN b.wpn_id IS NULL THEN 'delisted' ELSE 'unchanged' END AS status
  FROM (SELECT id, wpn_id FROM stores WHERE wpn_id IS NOT NULL) a
  FULL JOIN (SELECT DISTINCT 'W' || id AS wpn_id FROM wpn_raw WHERE is_premium OR phone_number IS NULL) b ON a.wpn_id = b.wpn_id
"""


@query(_DIFF)
def recrawl_diff(d):
    crawl = d.wpn_raw.filter("is_premium OR phone_number IS NULL").select(F.concat(F.lit("W"), "id").alias("wpn_id"))
    return st.recrawl_diff(d.stores, crawl, "wpn_id")


@query(f"SELECT * FROM ({_DIFF}) WHERE status <> 'delisted'")
def recrawl_diff_partial(d):
    crawl = d.wpn_raw.filter("is_premium OR phone_number IS NULL").select(F.concat(F.lit("W"), "id").alias("wpn_id"))
    return st.recrawl_diff(d.stores, crawl, "wpn_id", complete=False)


@query(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'delisted') AS delisted,
  count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM ({_DIFF})
""")
def recrawl_report(d):
    return au.run_report(recrawl_diff(d), ["new", "delisted", "unchanged"], "status")


@query(f"SELECT store_id, wpn_id FROM ({_DIFF}) WHERE status = 'delisted'")
def delisting_logs(d):
    logs = st.delisting_logs(recrawl_diff(d), "wpn_id", "absent_from_wpn_recrawl", AS_OF_ORDERS)
    return logs.select("store_id", F.get_json_object("result", "$.wpn_id").alias("wpn_id"))


@query("""
SELECT source, count(*) AS records, count(website) AS with_website, count(rating) AS with_rating FROM (
  SELECT 'wpn' AS source, name, website, NULL AS rating FROM wpn_raw
  UNION ALL SELECT 'google_places', display_name, website_uri, rating FROM google_raw) GROUP BY source
""")
def union_sources(d):
    out = st.union_sources({
        "wpn": d.wpn_raw.select("name", "website"),
        "google_places": d.google_raw.select(F.col("display_name").alias("name"), F.col("website_uri").alias("website"), "rating"),
    })
    return out.groupBy("source").agg(
        F.count("*").alias("records"), F.count("website").alias("with_website"), F.count("rating").alias("with_rating")
    )


_FOUND_CATS = f"""
  SELECT DISTINCT store_id, category FROM (SELECT store_id, {sql_map(cat.PRODUCT_CATEGORIES)}[product] AS category FROM ref_products)
  WHERE category IS NOT NULL
"""


@query(_FOUND_CATS)
def auto_categorize(d):
    return st.content_categories(d.store_external_refs)


@query(f"SELECT store_id, category FROM store_categories UNION SELECT * FROM ({_FOUND_CATS})")
def assign_categories(d):
    return st.assign_categories(d.store_categories, st.content_categories(d.store_external_refs))


@query(f"SELECT id, coalesce({sql_map({k: ','.join(v) for k, v in cat.DEFAULT_CATEGORIES.items()})}[discovery_source], '') AS categories FROM stores")
def default_categories(d):
    return d.stores.select("id", F.array_join(st.default_categories(F.col("discovery_source")), ",").alias("categories"))


# --- counts --------------------------------------------------------------------------------------------------

@query("SELECT status AS value, count(*) AS stores, printf('%.1f', count(*) / sum(count(*)) OVER () * 100) AS percent FROM stores GROUP BY status")
def lifecycle_status(d):
    return st.status_counts(d.stores)


@query("""
SELECT 'total' AS kind, 'stores' AS value, count(*) AS rows FROM stores
UNION ALL SELECT 'source', discovery_source, count(*) FROM stores GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM stores GROUP BY 2
UNION ALL SELECT 'wpn', CASE WHEN wpn_id IS NULL THEN 'without_wpn_id' ELSE 'with_wpn_id' END, count(*) FROM stores GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM store_categories GROUP BY 2
UNION ALL SELECT 'platform', platform, count(*) FROM online_presences GROUP BY 2
""")
def discovery_status(d):
    return st.discovery_status(d.stores, d.store_categories, d.online_presences)


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE is_premium) AS premium, count(*) FILTER (WHERE NOT is_premium) AS core,
  count(*) FILTER (WHERE website <> '') AS with_website, count(*) FILTER (WHERE phone_number <> '') AS with_phone FROM wpn_raw
""")
def source_stats(d):
    return st.source_stats(d.wpn_raw.withColumnRenamed("phone_number", "phone"))


@query("SELECT upper(trim(state)) AS state, count(*) AS records FROM candidates GROUP BY 1 ORDER BY records DESC, state LIMIT 15")
def raw_state_counts(d):
    return st.raw_state_counts(d.candidates)


@query(f"""
WITH p AS (SELECT *, upper(state) AS sk, upper(city) AS ck,
             id IN (SELECT store_id FROM online_presences WHERE status = 'active') AS has_online,
             id IN (SELECT store_id FROM online_ids) AS online FROM stores WHERE {_PUBLIC}),
f AS (SELECT *, row_number() OVER (PARTITION BY sk, ck ORDER BY name, id) AS r FROM p),
l AS (SELECT sk, ck, string_agg(name, ', ' ORDER BY r) AS names, string_agg(name, ', ' ORDER BY r) FILTER (WHERE wpn_level IS NOT NULL) AS wpn,
        string_agg(name, ', ' ORDER BY r) FILTER (WHERE wpn_level = 'premium') AS prem,
        count(*) FILTER (WHERE wpn_level IS NOT NULL) AS n1, count(*) FILTER (WHERE wpn_level = 'premium') AS n2,
        count(*) FILTER (WHERE has_online) AS n3, count(*) FILTER (WHERE online) AS n4 FROM f GROUP BY sk, ck)
SELECT c.state, c.city, c.store_count, c.active_count, c.wpn_premium_count, c.online_count,
  'City: ' || c.city || ', ' || c.state || chr(10) || 'Total game stores: ' || store_count || chr(10) ||
  'Active/verified stores: ' || active_count || chr(10) || 'Store names: ' || names ||
  CASE WHEN n1 > 0 THEN chr(10) || 'WPN-authorized stores: ' || n1 || ' (' || wpn || ')' ELSE '' END ||
  CASE WHEN n2 > 0 THEN chr(10) || 'WPN Premium stores: ' || n2 || ' (' || prem || ')' ELSE '' END ||
  CASE WHEN n3 > 0 THEN chr(10) || 'Stores with online presence: ' || n3 ELSE '' END ||
  CASE WHEN n4 > 0 THEN chr(10) || 'Stores selling MTG singles online: ' || n4 ELSE '' END AS context
FROM (SELECT state, city, sk, ck, {_COUNTS} FROM p GROUP BY ALL HAVING count(*) >= 2) c JOIN l ON l.sk = c.sk AND l.ck = c.ck
""")
def city_context(d):
    out = st.city_context(d.stores, d.online_presences)
    return out.select("state", "city", "store_count", "active_count", "wpn_premium_count", "online_count", "context")
