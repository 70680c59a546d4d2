"""Registered queries for validation runs and for the file sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.operators import audit as au
from placeledger.operators import lifecycle as lc
from placeledger.operators import validate as va
from placeledger.plans import queries_audit as qa
from placeledger.plans import queries_lifecycle as ql
from placeledger.plans import queries_pages as qp
from placeledger.plans import queries_text as qt
from placeledger.plans.registry import query
from placeledger.session import checkpoint_dir
from placeledger.sources import raw as rw


def _pages(d):
    return d.presence_pages.withColumn("headers", F.create_map(F.lit("x-shopid"), F.col("x_shopid")))


def _products(d):
    return d.presence_pages.select("presence_id", F.col("page_id").alias("page_no"), "html", "status_code")


_PLATFORM = """CASE WHEN regexp_matches(html, '(?i)crystalcommerce\\.com|cc-product-list') THEN 'crystal_commerce'
  WHEN regexp_matches(html || ' ' || url, '(?i)/products\\.json') OR regexp_matches(html, '(?i)binderpos\\.com') THEN 'binderpos'
  WHEN regexp_matches(html, '(?i)cdn\\.shopify\\.com|Shopify\\.theme') OR regexp_matches(x_shopid, '\\d') THEN 'shopify'
  WHEN regexp_matches(html, '(?i)wc-add-to-cart|wp-content/plugins/woocommerce') THEN 'woocommerce'
  WHEN regexp_matches(html, '(?i)squarespace\\.com') THEN 'squarespace' WHEN regexp_matches(html, '(?i)wp-content') THEN 'wordpress_stripe'
  ELSE 'unknown' END"""
_CARD = f"(({qp._count('html', cat.CARD_ATTRIBUTE_PATTERNS)}) >= 2 OR (({qp._count('html', cat.CARD_ATTRIBUTE_PATTERNS)}) >= 1 AND ({qp._count('html', cat.CARD_SET_PATTERNS)}) >= 1))"


def _seen(presences: str) -> str:
    """Check SQL: every fetched presence with its live flag, detected platform and singles."""
    return f"""
  SELECT *, {_PLATFORM} AS seen_platform, n >= 1 OR cards AS seen_singles, live AND n < 2 AND NOT cards AS undecided
  FROM (SELECT g.*, p.store_id, p.platform, p.sells_mtg_singles, {qp._count('html', cat.SINGLES_KEYWORDS)} AS n,
      {_CARD} AND status_code < 400 AS cards,
      error IS NULL AND status_code < 400 AND NOT regexp_matches(html, {qp._re(cat.SOFT_404_PATTERNS)}) AS live
    FROM presence_pages g JOIN {presences} p ON p.id = g.presence_id)
"""


@query(f"""
SELECT presence_id, CASE WHEN live AND platform IS NULL THEN seen_platform ELSE platform END AS platform,
  CASE WHEN live AND sells_mtg_singles IS NULL THEN seen_singles ELSE sells_mtg_singles END AS sells_mtg_singles,
  undecided AND sells_mtg_singles IS NULL AND
    sum(CASE WHEN undecided AND sells_mtg_singles IS NULL THEN 5 ELSE 0 END) OVER (ORDER BY length(presence_id), presence_id) <= 30 AS escalate
FROM ({_seen('online_presences')})
""")
def validate_presences(d):
    out = va.validate_presences(d.online_presences, _pages(d), _products(d), budget_cents=30)
    return out.select("presence_id", "platform", "sells_mtg_singles", "escalate")


@query(f"""
SELECT count(DISTINCT store_id) AS total_stores, count(*) AS presences_found, count(*) FILTER (WHERE live AND platform IS NULL) AS platforms_detected,
  count(*) FILTER (WHERE live AND sells_mtg_singles IS NULL AND seen_singles) AS singles_detected,
  least(6, count(*) FILTER (WHERE undecided AND sells_mtg_singles IS NULL)) AS reviews,
  least(6, count(*) FILTER (WHERE undecided AND sells_mtg_singles IS NULL)) * 5 AS review_cents
FROM ({_seen('online_presences')})
""")
def validation_report(d):
    return va.validation_report(va.validate_presences(d.online_presences, _pages(d), _products(d), budget_cents=30))


_CHOSEN = "(SELECT * FROM online_presences WHERE status = 'active' AND store_id IN (SELECT id FROM stores WHERE status IN ('active', 'verified')))"


@query(f"""
SELECT p.id, CASE WHEN s.live THEN s.seen_platform ELSE p.platform END AS platform,
  CASE WHEN s.live THEN s.seen_singles ELSE p.sells_mtg_singles END AS sells_mtg_singles
FROM online_presences p LEFT JOIN ({_seen(_CHOSEN)}) s ON s.presence_id = p.id
""")
def revalidate(d):
    out = va.revalidate(d.stores, d.online_presences, d.validation_logs, _pages(d), _products(d))
    return out["presences"].select("id", "platform", "sells_mtg_singles")


@query(f"""
WITH seen AS ({_seen(_CHOSEN)}),
after_presences AS (SELECT p.* REPLACE (CASE WHEN s.live THEN s.seen_singles ELSE p.sells_mtg_singles END AS sells_mtg_singles)
  FROM online_presences p LEFT JOIN seen s ON s.presence_id = p.id),
chosen AS (SELECT * FROM stores WHERE status IN ('active', 'verified')),
t AS ({ql._evaluation('chosen', 'after_presences', 'validation_logs')})
SELECT count(DISTINCT store_id) AS stores, count(*) FILTER (WHERE live AND platform IS NOT NULL) AS platforms_cleared,
  count(*) FILTER (WHERE live) AS platforms_detected, count(*) FILTER (WHERE live AND sells_mtg_singles IS NOT NULL) AS singles_cleared,
  count(*) FILTER (WHERE live AND seen_singles) AS singles_detected, (SELECT count(*) FROM t) AS transitions FROM seen
""")
def revalidation_report(d):
    out = va.revalidate(d.stores, d.online_presences, d.validation_logs, _pages(d), _products(d))
    return va.revalidation_report(out["results"], out["targets"])


@query(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'unreachable') AS unreachable,
  count(*) FILTER (WHERE status = 'dead') AS dead FROM ({ql._RUN})
""")
def health_report(d):
    results = lc.check_results(d.online_presences, d.stores, d.http_checks)
    return au.run_report(results, ["active", "unreachable", "dead"], "status")


# --- files ---------------------------------------------------------------------------------------------------

def _folder(d, kind: str) -> str:
    return f"{checkpoint_dir(d.spark).rstrip('/')}/{kind}-{uuid.uuid4()}"


@query("SELECT id, display_name AS name, formatted_address AS address, type_list AS types FROM google_raw")
def raw_files(d):
    """Raw records written as JSON and read back under their declared schema."""
    path = _folder(d, "raw")
    rw.write_raw(qt.google(d), path)
    back = rw.read_raw(d.spark, path, "google_places", multiline=False)
    return back.select("id", F.col("displayName.text").alias("name"), F.col("formattedAddress").alias("address"), F.array_join("types", ",").alias("types"))


@query("""
SELECT page, coalesce(TRY_CAST(TRY_CAST(replace(impressions, ',', '') AS DOUBLE) AS BIGINT), 0) AS impressions FROM search_pages
""")
def search_export(d):
    """Two CSV exports with different headers, read as one table."""
    path, odd = _folder(d, "export"), F.col("row_no") % 2 == 1
    plain = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    page, shown = F.col("page"), F.col("impressions").alias("Impressions")
    d.search_pages.filter(odd).select(page.alias("Top pages"), shown).write.options(**plain).csv(path + "/a")
    d.search_pages.filter(~odd).select(shown, page.alias("URL")).write.options(**plain).csv(path + "/b")
    back = rw.read_search_export(d.spark, [path + "/a", path + "/b"])
    return back.select("page", au.int_text("impressions").alias("impressions"))


@query(f"SELECT plan_action, count(*) AS rows FROM ({qa._PLAN}) GROUP BY plan_action")
def plan_files(d):
    """The cleanup plan written as one CSV folder per action, and counted from the files."""
    path = _folder(d, "plan")
    audit = au.quality_bucket(d.stores, d.store_external_refs, d.online_presences, d.search_pages)
    rw.write_report(au.cleanup_plan(audit), path, group="plan_action")
    return d.spark.read.option("header", True).csv(path).groupBy("plan_action").agg(F.count("*").alias("rows"))


@query("""
SELECT s.id AS store_id, s.name, s.city, s.state, printf('%.2f', CAST(r.payload->>'confidence' AS DOUBLE)) AS confidence,
  array_to_string(from_json(r.payload->'products', '["VARCHAR"]'), '|') AS products,
  CASE WHEN CAST(r.payload->>'confidence' AS DOUBLE) >= 0.65 AND json_array_length(r.payload->'products') > 0 THEN 'auto_apply' ELSE 'retry_or_debug' END AS action
FROM stores s JOIN store_external_refs r ON r.store_id = s.id WHERE r.provider = 'website_content'
""")
def dossier_files(d):
    """Dossiers written as JSON and read back as report rows."""
    path = _folder(d, "dossiers")
    site = F.from_json("payload", "products array<string>, confidence double")
    refs = d.store_external_refs.filter("provider = 'website_content'").select(F.col("store_id").alias("id"), site.alias("p"))
    rows = d.stores.join(refs, "id").select(F.to_json(F.struct(
        F.col("id").alias("store_id"), F.col("name").alias("store_name"), F.struct("city", "state").alias("address"),
        "p.confidence", "p.products",
    )).alias("value"))
    rows.write.text(path)
    # One document per line here; a folder with one document per file is read the same way.
    return rw.read_dossiers(d.spark, path, whole_files=False).select("store_id", "name", "city", "state", "confidence", "products", "action")


@query("SELECT id, lower(trim(segment)) IN ('building', 'machinery') AS known FROM stores")
def coerce_values(d):
    """Trimmed and lower-cased values, null outside the allowed list."""
    return d.stores.select("id", au.coerce(F.concat(F.lit(" "), "segment"), ["building", "machinery"]).isNotNull().alias("known"))
