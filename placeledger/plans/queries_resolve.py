"""Registered queries for entity resolution and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.operators import ingest as ig
from placeledger.operators import resolve as rs
from placeledger.operators import sets as st
from placeledger.plans import queries_text as qt
from placeledger.plans.registry import query
from placeledger.plans.views import AS_OF
from placeledger.session import deal
from placeledger.sources import raw as rw

_ID = "CAST(substr(candidate_id, 2) AS BIGINT)"


@query("""
SELECT c.candidate_id, r.store_id FROM candidates c
JOIN store_external_refs r ON r.provider = 'games_workshop' AND r.external_id = 'GW' || CAST(c.seq AS VARCHAR)
WHERE r.store_id IN (SELECT id FROM stores)
""")
def match_external_ref(d):
    cands = d.candidates.select(
        "candidate_id", F.lit("games_workshop").alias("provider"), F.concat(F.lit("GW"), F.col("seq").cast("string")).alias("external_id")
    )
    return rs.match_external_ref(cands, d.store_external_refs, d.stores)


@query("""
SELECT candidate_id, id AS store_id, CASE WHEN c.google_place_id = s.google_place_id THEN 'google_place_id' ELSE 'wpn_id' END AS tier
FROM candidates c JOIN stores s ON c.google_place_id = s.google_place_id OR (c.google_place_id IS NULL AND c.wpn_id = s.wpn_id)
""")
def match_exact_ids(d):
    return rs.match_exact(d.candidates, d.stores, (1, 2)).select("candidate_id", "store_id", "tier")


_N = qt.NORM_NAME


@query(f"""
SELECT candidate_id, store_id, confidence FROM (
  SELECT c.candidate_id, s.id AS store_id, 0.95e0 AS confidence, row_number() OVER (PARTITION BY c.candidate_id ORDER BY s.first_seen, s.id) AS r
  FROM (SELECT candidate_id, zip_code, {_N} AS n FROM candidates) c
  JOIN (SELECT id, first_seen, zip_code, {_N} AS n FROM stores) s ON s.n = c.n AND s.zip_code = c.zip_code) WHERE r = 1
""")
def match_name_zip(d):
    return rs.match_exact(d.candidates, d.stores, (3,)).select("candidate_id", "store_id", "confidence")


def _street(t: str) -> str:
    return qt._expanded(qt._COLLAPSE.format(f"regexp_replace({qt._plain('street')}, {qt._SUITE}, '', 'g')"))


@query(f"""
SELECT candidate_id, store_id, confidence FROM (
  SELECT c.candidate_id, s.id AS store_id, 0.9e0 AS confidence, row_number() OVER (PARTITION BY c.candidate_id ORDER BY s.first_seen, s.id) AS r
  FROM (SELECT candidate_id, upper(city) AS city, state, {_street('c')} AS st FROM candidates) c
  JOIN (SELECT id, first_seen, upper(city) AS city, state, {_street('s')} AS st FROM stores) s
    ON s.st = c.st AND s.city = c.city AND s.state = c.state WHERE c.st <> '') WHERE r = 1
""")
def match_address(d):
    return rs.match_exact(d.candidates, d.stores, (4,)).select("candidate_id", "store_id", "confidence")


# Only cases 1 (the same name) and 3 (letters put in) keep a similar name at the same place or ZIP.
@query(f"""
SELECT candidate_id, store_id, confidence, confidence < 0.92e0 AS needs_review FROM (
  SELECT c.candidate_id, s.id AS store_id, CASE case_no WHEN 1 THEN 1e0 ELSE
    round_even(200.0e0 * length({_N.replace('name', 's.name')}) / (length({_N.replace('name', 's.name')}) + length({_N.replace('name', 'c.name')})), 0) / 100 END AS confidence
  FROM candidates c JOIN stores s ON s.id = substr(c.candidate_id, 2) WHERE case_no IN (1, 3))
""")
def match_fuzzy_geo(d):
    return rs.match_fuzzy_geo(d.candidates, d.stores).select("candidate_id", "store_id", "confidence", "needs_review")


_NEW_ID = """concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '4' || substr(h, 14, 3), '8' || substr(h, 18, 3), substr(h, 21, 12))"""


# The expected tier of every candidate follows from how the view makes it: an id, the same name and ZIP, the same address,
# letters put into the name, or nothing in common. Four neighbours share the name and ZIP of case 4, so the first of
# them becomes a store and the others match it. Letters put in leave the old name as the common subsequence.
@query(f"""
WITH c AS (SELECT c.*, {_N.replace('name', 's.name')} AS old_name, {_N.replace('name', 'c.name')} AS new_name,
    md5('C' || CAST(min(seq) OVER (PARTITION BY case_no, seq // 4) AS VARCHAR)) AS first_h, md5(c.candidate_id) AS own_h,
    min(seq) OVER (PARTITION BY case_no, seq // 4) AS first_seq, s.id
  FROM candidates c JOIN stores s ON s.id = substr(c.candidate_id, 2)),
t AS (SELECT *, CASE WHEN google_place_id IS NOT NULL THEN 'google_place_id' WHEN wpn_id IS NOT NULL THEN 'wpn_id'
    WHEN case_no = 1 THEN 'name_zip' WHEN case_no = 2 THEN 'address' WHEN case_no = 3 THEN 'fuzzy'
    WHEN case_no = 4 AND seq > first_seq THEN 'name_zip' ELSE 'new' END AS tier FROM c),
x AS (SELECT *, CASE tier WHEN 'fuzzy' THEN round_even(200.0e0 * length(old_name) / (length(old_name) + length(new_name)), 0) / 100
    WHEN 'name_zip' THEN 0.95e0 WHEN 'address' THEN 0.9e0 WHEN 'new' THEN 0e0 ELSE 1e0 END AS confidence,
    CASE WHEN case_no = 4 THEN first_h ELSE own_h END AS h FROM t)
SELECT candidate_id, tier, confidence, tier = 'fuzzy' AND confidence < 0.92e0 AS needs_review, tier = 'new' AS is_new,
  CASE WHEN tier = 'new' OR case_no = 4 THEN {_NEW_ID} ELSE id END AS store_id
FROM x
""")
def resolve_candidates(d):
    return rs.resolve_candidates(d.candidates, d.stores)


@query("""
SELECT s.id, coalesce(s.phone, nullif(c.phone, '')) AS phone, coalesce(s.latitude, c.longitude) AS latitude,
  coalesce(s.google_place_id, 'X' || s.id) AS google_place_id,
  s.phone IS NULL OR (s.latitude IS NULL AND c.longitude IS NOT NULL) OR s.google_place_id IS NULL AS updated
FROM stores s JOIN candidates c ON c.seq = CAST(s.id AS BIGINT)
""")
def fill_missing(d):
    new = d.candidates.select(
        F.col("seq").cast("string").alias("id"), F.col("phone").alias("new_phone"), F.col("longitude").alias("new_latitude"),
        F.concat(F.lit("X"), F.col("seq").cast("string")).alias("new_google_place_id"),
    )
    out = ig.fill_pairs(d.stores.select("id", "phone", "latitude", "google_place_id").join(new, "id"))
    return out.select("id", "phone", "latitude", "google_place_id", "updated")


def _crawl(d):
    """The locator and places records of the views as one crawl; the places come after the locator."""
    places = rw.parse_google(deal(qt.google(d))).withColumn("seq", F.substring("external_id", 2, 20).cast("bigint") + 10**9)
    return rw.parse_wpn(deal(qt.wpn(d))).unionByName(places)


def _ingest(d):
    return ig.ingest(_crawl(d), d.stores, d.store_external_refs, d.store_categories, AS_OF)


@query()
def ingest_outcomes(d):
    return _ingest(d)["outcomes"]


@query("SELECT id, name, status, coalesce(trim(slug), '') <> '' AS had_slug FROM stores")
def ingest_keeps_stores(d):
    """Ingest changes no name and no status of a known store, and loses none."""
    after = _ingest(d)["stores"].join(d.stores.select("id", F.col("slug").alias("old_slug")), "id")
    return after.select("id", "name", "status", (F.trim(F.coalesce("old_slug", F.lit(""))) != "").alias("had_slug"))


@query()
def ingest_report(d):
    return _ingest(d)["report"]
