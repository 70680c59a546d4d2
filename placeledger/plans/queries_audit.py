"""Registered queries for scores, audits, cleanup plans and rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.operators import audit as au
from placeledger.plans.queries_directory import _PUBLIC, _re, sql_in
from placeledger.plans.registry import query
from placeledger.plans.views import AS_OF

_SCORES = """
SELECT s.id AS store_id, s.name, s.city, s.state, s.status,
  CAST(greatest(0, least(100, p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8)) AS INT) AS trust_score,
  array_to_string([x FOR x IN [
    CASE WHEN p1 <> 0 THEN '+40 wpn_registered' END, CASE WHEN p2 <> 0 THEN '+25 content_products(' || n || ')' END,
    CASE WHEN p3 <> 0 THEN '+15 content_confidence(' || printf('%.2f', conf) || ')' END,
    CASE WHEN p4 <> 0 THEN '+10 has_website' END, CASE WHEN p5 <> 0 THEN '+5 has_phone' END,
    CASE WHEN p6 <> 0 THEN '+5 has_google_place_id' END,
    CASE WHEN p7 <> 0 THEN '-20 low_content_confidence(' || printf('%.2f', conf) || ')' END,
    CASE WHEN p8 <> 0 THEN '-10 google_places_only' END] IF x IS NOT NULL], '; ') AS signals
FROM (
  SELECT *, CASE WHEN wpn_id <> '' THEN 40 ELSE 0 END AS p1, CASE WHEN n > 0 THEN 25 ELSE 0 END AS p2,
    CASE WHEN conf >= 0.7 THEN 15 ELSE 0 END AS p3, CASE WHEN conf IS NOT NULL THEN 10 ELSE 0 END AS p4,
    CASE WHEN phone <> '' THEN 5 ELSE 0 END AS p5, CASE WHEN google_place_id <> '' THEN 5 ELSE 0 END AS p6,
    CASE WHEN conf < 0.5 AND n = 0 THEN -20 ELSE 0 END AS p7,
    CASE WHEN discovery_source = 'google_places' THEN -10 ELSE 0 END AS p8
  FROM stores LEFT JOIN (
    SELECT store_id, CAST(payload->>'confidence' AS DOUBLE) AS conf, json_array_length(payload->'products') AS n
    FROM store_external_refs WHERE provider = 'website_content') c ON c.store_id = stores.id) s
"""


@query(_SCORES)
def score_stores(d):
    return au.score_stores(d.stores, d.store_external_refs)


@query(f"""
SELECT count(*) AS stores, avg(trust_score) AS average, min(trust_score) AS lowest, max(trust_score) AS highest,
       count(*) FILTER (WHERE trust_score < 25) AS low_trust FROM ({_SCORES})
""")
def score_summary(d):
    return au.score_summary(au.score_stores(d.stores, d.store_external_refs))


_NEWEST = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY ts DESC, seq DESC, seq2 DESC, seq3 DESC) AS r
                 FROM validation_logs WHERE check_type = 'content_extract') WHERE r = 1
"""


@query(f"SELECT store_id, presence_id, result, strftime(ts, '%Y-%m-%d') AS day FROM ({_NEWEST})")
def latest_content_log(d):
    out = au.latest_logs(d.validation_logs, "content_extract")
    return out.select("store_id", "presence_id", "result", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query(f"""
SELECT id AS store_id, name, city, state, array_to_string([x FOR x IN [
    CASE WHEN regexp_matches(name, {_re(cat.NAME_BLOCK_PATTERNS)}) AND NOT regexp_matches(name, {_re(cat.NAME_ALLOW_PATTERNS)})
         THEN 'name_blocked: ''' || name || '''' END,
    CASE WHEN result IS NOT NULL AND n = 0 AND conf < 0.5 THEN
      printf('low_content_confidence: 0 products detected, confidence=%.2f (threshold=0.5)', conf) END]
    IF x IS NOT NULL], ' | ') AS reasons
FROM (SELECT s.*, l.result, TRY_CAST(l.result->>'confidence' AS DOUBLE) AS conf,
             coalesce(json_array_length(l.result->'products'), 0) AS n
      FROM stores s LEFT JOIN ({_NEWEST}) l ON l.store_id = s.id WHERE s.status = 'candidate')
WHERE (result IS NULL OR conf IS NOT NULL) AND reasons <> ''
""")
def audit_candidates(d):
    out = au.audit_candidates(d.stores, d.validation_logs)
    return out.withColumn("reasons", F.array_join("reasons", " | "))


_AUDIT = f"""
  SELECT s.id, coalesce(slug, '') AS slug, name, status, discovery_source AS source, coalesce(g.hits, 0) AS gsc_impressions,
    CASE WHEN coalesce(trim(slug), '') = '' THEN 'slugless_public_store'
      WHEN (regexp_matches(name, {_re(cat.NAME_BLOCK_PATTERNS)}) AND NOT regexp_matches(name, {_re(cat.NAME_ALLOW_PATTERNS)}))
        OR regexp_matches(name, {_re(cat.OFFTOPIC_NAME_PATTERNS)}) THEN 'blocked_or_obvious_offtopic_name'
      WHEN wpn_id IS NOT NULL OR s.id IN (SELECT store_id FROM trusted_refs) THEN 'trusted_local_signal'
      WHEN discovery_source = 'google_places'
        AND s.id NOT IN (SELECT store_id FROM online_presences WHERE status = 'active') THEN 'google_only_no_active_presence'
      WHEN discovery_source = 'google_places' OR coalesce(g.hits, 0) > 0 THEN 'weak_google_or_gsc_signal'
      ELSE 'no_negative_signal' END AS reason
  FROM stores s LEFT JOIN (
    SELECT regexp_extract(page, '/store/([^/?]+)', 1) AS token,
           arg_max(coalesce(TRY_CAST(TRY_CAST(replace(impressions, ',', '') AS DOUBLE) AS BIGINT), 0), row_no) AS hits
    FROM search_pages WHERE regexp_matches(page, '^(https://[^/]*)?/store/[^/?]') GROUP BY 1) g
    ON g.token = CASE WHEN slug <> '' THEN slug ELSE s.id END
  WHERE {_PUBLIC}
"""
_BUCKET = """CASE reason WHEN 'slugless_public_store' THEN 'suspect_noindex' WHEN 'weak_google_or_gsc_signal' THEN 'suspect_noindex'
  WHEN 'blocked_or_obvious_offtopic_name' THEN 'remove_or_pending_review'
  WHEN 'google_only_no_active_presence' THEN 'remove_or_pending_review' ELSE 'keep' END"""


@query(f"""
SELECT *, {_BUCKET} AS bucket, CASE {_BUCKET} WHEN 'keep' THEN 'keep' WHEN 'suspect_noindex' THEN 'noindex' ELSE 'manual_review' END
  AS action FROM ({_AUDIT})
""")
def quality_bucket(d):
    return au.quality_bucket(d.stores, d.store_external_refs, d.online_presences, d.search_pages)


_PLAN = f"""
  SELECT id, status, CASE WHEN {_BUCKET} = 'keep' THEN 'keep'
    WHEN reason = 'blocked_or_obvious_offtopic_name' AND (regexp_matches(name, {_re(cat.CHAIN_CLOSE_PATTERNS)})
      OR (source = 'google_places' AND NOT regexp_matches(name, {_re(cat.PROTECT_NAME_PATTERNS)})
          AND regexp_matches(name, {_re(cat.CLOSE_NAME_PATTERNS)}))) THEN 'close_high_confidence'
    ELSE 'suppress_from_public' END AS plan_action, reason FROM ({_AUDIT})
"""


@query(f"""
SELECT id, plan_action, CASE plan_action WHEN 'keep' THEN status WHEN 'close_high_confidence' THEN 'closed' ELSE 'unresponsive' END
  AS target_status, CASE plan_action WHEN 'keep' THEN 'trusted_by_audit' WHEN 'close_high_confidence' THEN
  'obvious_non_lgs_name_pattern' ELSE reason END AS plan_reason FROM ({_PLAN})
""")
def cleanup_plan(d):
    audit = au.quality_bucket(d.stores, d.store_external_refs, d.online_presences, d.search_pages)
    return au.cleanup_plan(audit).select("id", "plan_action", "target_status", "plan_reason")


def _outcomes(d):
    """The plan of the audit, plus plans for a store that is gone and for stores closed in the meantime."""
    audit = au.quality_bucket(d.stores, d.store_external_refs, d.online_presences, d.search_pages)
    plan = au.cleanup_plan(audit).select("id", "plan_action", "target_status", "plan_reason")
    late = d.stores.filter(~F.col("status").isin(cat.PUBLIC_STATUSES)).select(
        F.when(F.col("status") == "closed", F.concat(F.lit("gone"), "id")).otherwise(F.col("id")).alias("id"),
        F.lit("suppress_from_public").alias("plan_action"), F.lit("unresponsive").alias("target_status"),
        F.lit("late").alias("plan_reason"),
    )
    return au.plan_outcomes(d.stores, plan.unionByName(late))


_OUTCOMES = f"""
  SELECT id, plan_action AS outcome FROM ({_PLAN}) WHERE plan_action <> 'keep'
  UNION ALL SELECT CASE WHEN status = 'closed' THEN 'gone' || id ELSE id END,
    CASE WHEN status = 'closed' THEN 'missing' ELSE 'already_non_public' END FROM stores WHERE NOT ({_PUBLIC})
"""


@query(f"SELECT id, outcome FROM ({_OUTCOMES})")
def plan_outcomes(d):
    return _outcomes(d).select("id", "outcome")


@query(f"""
SELECT s.id, CASE o.outcome WHEN 'close_high_confidence' THEN 'closed' WHEN 'suppress_from_public' THEN 'unresponsive'
  ELSE s.status END AS status, o.outcome IN ('close_high_confidence', 'suppress_from_public') IS TRUE AS noted
FROM stores s LEFT JOIN ({_OUTCOMES}) o ON o.id = s.id
""")
def apply_plan(d):
    out = au.apply_outcomes(d.stores, _outcomes(d))
    return out.select("id", "status", F.col("notes").isNotNull().alias("noted"))


@query(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'missing') AS missing,
  count(*) FILTER (WHERE outcome = 'already_non_public') AS already_non_public,
  count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged,
  count(*) FILTER (WHERE outcome = 'close_high_confidence') AS close_high_confidence,
  count(*) FILTER (WHERE outcome = 'suppress_from_public') AS suppress_from_public FROM ({_OUTCOMES})
""")
def plan_report(d):
    names = ["missing", "already_non_public", "unchanged", "close_high_confidence", "suppress_from_public"]
    return au.run_report(_outcomes(d), names)


_OCS = f"""
  SELECT *, CASE WHEN status = 'closed' THEN 'closed_or_false_positive'
      WHEN status = 'unresponsive' THEN CASE WHEN trusted THEN 'review_for_reactivation'
        WHEN reached OR coalesce(trim(phone), '') <> '' THEN 'enrich_then_review' ELSE 'suppressed_pending_evidence' END
      WHEN trusted THEN 'public_keep' WHEN discovery_source = 'google_places' THEN 'suppress_or_enrich'
      ELSE 'manual_review' END AS ocs_action
  FROM (SELECT *, coalesce(trim(wpn_id), '') <> '' OR id IN (SELECT store_id FROM trusted_refs)
               OR discovery_source IN {sql_in(cat.TRUSTED_SOURCES)} AS trusted,
          id IN (SELECT store_id FROM online_presences WHERE status = 'active') AS reached FROM stores)
"""


@query(f"SELECT id, state, ocs_action FROM ({_OCS})")
def ocs_action(d):
    return au.ocs_action(d.stores, d.store_external_refs, d.online_presences).select("id", "state", "ocs_action")


@query(f"""
SELECT state, 'action' AS kind, ocs_action AS value, count(*) AS stores FROM ({_OCS}) GROUP BY ALL
UNION ALL SELECT state, 'status', status, count(*) FROM stores GROUP BY ALL
UNION ALL SELECT state, 'source', discovery_source, count(*) FROM stores GROUP BY ALL
""")
def ocs_counts(d):
    return au.ocs_counts(au.ocs_action(d.stores, d.store_external_refs, d.online_presences))


@query(f"""
SELECT state, position, ocs_action, id FROM (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY status, discovery_source, name, id) AS position FROM ({_OCS})
  WHERE ocs_action IN {sql_in(cat.OCS_PRIORITY_ACTIONS)}) WHERE position <= 20
""")
def ocs_samples(d):
    out = au.ocs_samples(au.ocs_action(d.stores, d.store_external_refs, d.online_presences))
    return out.select("state", F.col("position").cast("bigint").alias("position"), "ocs_action", "id")


_URL_BUCKET = f"""
  CASE WHEN n >= 2 AND p[1] = '_next' AND p[2] = 'static' THEN 'static_asset' WHEN n >= 1 AND p[n] = 'opengraph-image' THEN 'opengraph_image'
    WHEN n >= 3 AND p[1] = 'store' AND p[3] = 'claim' THEN 'store_claim'
    WHEN n >= 2 AND p[1] = 'store' THEN CASE WHEN regexp_matches(p[2], '{cat.UUID_PATTERN}', 'i') THEN 'store_uuid' ELSE 'store_slug' END
    WHEN n = 2 AND p[1] = 'stores' THEN 'state' WHEN n >= 3 AND p[1] = 'stores' THEN 'city'
    WHEN n >= 1 AND p[1] IN {sql_in(cat.STATIC_SECTIONS)} THEN 'category_static' WHEN n >= 1 AND p[1] = 'guides' THEN 'guide'
    ELSE 'unknown' END
"""
_BUCKETED = f"""
  SELECT row_no, path, {_URL_BUCKET} AS bucket FROM (SELECT *, len(p) AS n FROM (
    SELECT row_no, path, [x FOR x IN string_split(path, '/') IF x <> ''] AS p FROM (
      SELECT row_no, CASE WHEN contains(page, '://') THEN regexp_extract(page, '^https://[^/?#]*([^?#]*)', 1) ELSE page END AS path
      FROM search_pages)))
"""


@query(f"SELECT row_no, path, bucket FROM ({_BUCKETED})")
def classify_url(d):
    from placeledger.functions import text as tx

    path = tx.url_path("page")
    return d.search_pages.select("row_no", path.alias("path"), tx.classify_url_path(path).alias("bucket"))


@query(f"""
SELECT b.bucket, coalesce(c.n, 0) AS count, coalesce(c.samples, '') AS samples FROM (
  SELECT unnest([{sql_in(cat.URL_BUCKETS)[1:-1]}]) AS bucket) b
LEFT JOIN (SELECT bucket, any_value(n) AS n, string_agg(path, ' | ' ORDER BY row_no) FILTER (WHERE r <= 8) AS samples
           FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY row_no) AS r,
                   count(*) OVER (PARTITION BY bucket) AS n FROM ({_BUCKETED})) GROUP BY bucket) c ON c.bucket = b.bucket
""")
def bucket_counts(d):
    return au.bucket_counts(d.search_pages).select("bucket", "count", "samples")


@query(f"""
SELECT status, discovery_source, count(*) AS stores FROM stores
WHERE {_PUBLIC} AND coalesce(trim(slug), '') = '' GROUP BY ALL
""")
def slugless_counts(d):
    return au.slugless_counts(d.stores)


@query(f"""
SELECT id, name, status, discovery_source FROM stores WHERE {_PUBLIC} AND coalesce(trim(slug), '') = ''
ORDER BY first_seen DESC, id LIMIT 25
""")
def slugless_samples(d):
    return au.slugless_samples(d.stores)


@query(f"""
SELECT 'public_needs_slug' AS rule, count(*) AS violations, min(id) AS sample FROM stores
  WHERE {_PUBLIC} AND coalesce(trim(slug), '') = '' HAVING count(*) > 0
UNION ALL SELECT 'unique_slug', count(*), min(slug) FROM (SELECT slug FROM stores WHERE trim(slug) <> '' GROUP BY slug
  HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'presence_store', count(*), min(store_id) FROM online_presences
  WHERE store_id NOT IN (SELECT id FROM stores) HAVING count(*) > 0
UNION ALL SELECT 'log_store', count(*), min(store_id) FROM validation_logs
  WHERE store_id NOT IN (SELECT id FROM stores) HAVING count(*) > 0
""")
def conformance(d):
    return au.conformance(
        d.stores, d.online_presences, d.store_external_refs, d.store_categories, d.validation_logs
    )
