"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an optional comma list
("all" for every query). The directory tables are first derived from the given tables and stored, as a directory keeps
them; that is timed as ``store_tables`` and part of the total. Then each query is run once and its whole result computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # the six reference reads
    "state_index", "popular_cities", "list_stores_by_state", "list_stores_by_city", "nearby", "game_tag_counts",
    # directory reads
    "city_index", "nearby_cities", "other_in_city", "list_stores_having", "top_cities_for_category", "evidence_flags",
    "redirect_map", "city_context", "sitemap", "store_meta_description",
    # radius join and entity resolution
    "nearby_join", "match_exact_ids", "match_name_zip", "match_address", "match_fuzzy_geo", "resolve_candidates",
    # logs, lifecycle, audits
    "consecutive_failures", "evaluate_status", "health_run", "detect_closures", "latest_content_log", "score_stores",
    "quality_bucket", "cleanup_plan", "conformance", "first_seen_dedup", "snapshot_upsert",
    # prices and pages
    "search_queue", "infer_pricing", "detect_platform", "extract_content", "extract_price", "page_extract", "scan_documents",
    "extract_phones", "extract_description", "dossiers",
    # the heaviest plans: validation runs, an ingest and a stream
    "validate_presences", "revalidate", "ingest_outcomes", "stream_failures",
]


def main() -> None:
    from placeledger.plans.registry import all_queries, use_tables
    from placeledger.plans.views import store_tables
    from placeledger.session import build_session, checkpoint_dir

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE

    seconds: dict[str, float] = {}
    started = time.perf_counter()
    tables = f"{checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4()}"
    store_tables(spark, sf_dir, tables)
    use_tables(sf_dir, tables)
    seconds["store_tables"] = round(time.perf_counter() - started, 3)
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "total wall seconds of the benchmarked queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
