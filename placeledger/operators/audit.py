"""Trust scores, quality audits, cleanup plans and rule checks over the directory tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger import schemas
from placeledger.functions import text as tx
from placeledger.operators import directory as dr
from placeledger.operators import filters as fl


def int_text(value) -> Column:
    """Integer from report text such as "1,234" or "12.7"; anything else is 0."""
    number = F.trim(F.replace(tx.col(value), F.lit(","), F.lit(""))).try_cast("double")
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))


# --- trust score ---------------------------------------------------------------------------------------------

def _signals(wpn_id, has_website, has_phone, place_id, source, products, confidence) -> list[tuple[Column, int, Column]]:
    """(condition, points, label) of every score part, in report order."""
    number = F.coalesce(F.size(products), F.lit(0))
    number = F.greatest(number, F.lit(0))
    two = tx.fixed(confidence, 2)
    w = cat.TRUST_WEIGHTS
    return [
        (tx.present(wpn_id), w["wpn"], F.lit("wpn_registered")),
        (number > 0, w["products"], F.concat(F.lit("content_products("), number.cast("string"), F.lit(")"))),
        (confidence >= cat.TRUST_HIGH_CONFIDENCE, w["confident"],
         F.concat(F.lit("content_confidence("), two, F.lit(")"))),
        (has_website, w["website"], F.lit("has_website")),
        (has_phone, w["phone"], F.lit("has_phone")),
        (tx.present(place_id), w["place_id"], F.lit("has_google_place_id")),
        ((confidence < cat.TRUST_LOW_CONFIDENCE) & (number == 0), w["low_content"],
         F.concat(F.lit("low_content_confidence("), two, F.lit(")"))),
        (source == "google_places", w["google_only"], F.lit("google_places_only")),
    ]


def trust_score(wpn_id, has_website, has_phone, place_id, source, products, confidence) -> Column:
    """Struct (score, signals): weighted evidence, clamped to 0..100."""
    parts = [
        (F.coalesce(cond, F.lit(False)), points, label)
        for cond, points, label in _signals(wpn_id, has_website, has_phone, place_id, source, products, confidence)
    ]
    total = reduce(lambda a, b: a + b, [F.when(c, points).otherwise(0) for c, points, _ in parts])
    texts = F.filter(
        F.array(*[F.when(c, F.concat(F.lit(f"{points:+d} "), label)) for c, points, label in parts]),
        lambda t: t.isNotNull(),
    )
    return F.struct(F.least(F.greatest(total, F.lit(0)), F.lit(100)).alias("score"), texts.alias("signals"))


def score_stores(stores: DataFrame, refs: DataFrame) -> DataFrame:
    """Trust score of every store; a content ref counts as the sign of a website."""
    content = fl.content_refs(refs).groupBy(F.col("store_id").alias("id")).agg(
        F.min_by(F.struct("content.products", "confidence"), "external_id").alias("c")
    )
    joined = stores.select(
        "id", "name", "city", "state", "status", "wpn_id", "phone", "google_place_id", "discovery_source"
    ).join(content, "id", "left")
    result = trust_score(
        F.col("wpn_id"), F.col("c").isNotNull(), tx.present(F.col("phone")), F.col("google_place_id"),
        F.col("discovery_source"), F.col("c.products"), F.col("c.confidence"),
    )
    scored = joined.withColumn("t", result)
    return scored.select(
        F.col("id").alias("store_id"), "name", "city", "state", "status", F.col("t.score").alias("trust_score"),
        F.array_join("t.signals", "; ").alias("signals"),
    )


def score_summary(scores: DataFrame, low: int = 25) -> DataFrame:
    return scores.agg(
        F.count("*").alias("stores"), F.avg("trust_score").alias("average"), F.min("trust_score").alias("lowest"),
        F.max("trust_score").alias("highest"), F.count_if(F.col("trust_score") < low).alias("low_trust"),
    )


# --- candidate audit -----------------------------------------------------------------------------------------

def latest_logs(logs: DataFrame, check_type: str, key: str = "store_id") -> DataFrame:
    """The newest log of one check type per key; equal times are settled by the remaining log columns."""
    order = [c for c in ("ts", "seq", "seq2", "seq3") if c in logs.columns]
    chosen = logs.filter(F.col("check_type") == check_type)
    row = F.struct(*[c for c in logs.columns if c != key])
    return chosen.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("log")).select(key, "log.*")


def audit_candidates(stores: DataFrame, logs: DataFrame, use_products_found: bool = False) -> DataFrame:
    """Candidate stores with a blocked name, or whose latest content log shows no products and low confidence.

    Scrape logs that only carry ``products_found`` count as having no products unless ``use_products_found`` is set.
    A confidence that is not a number drops the store from the report.
    """
    names = stores.filter(F.col("status") == "candidate").select("id", "name", "city", "state")
    newest = latest_logs(logs, "content_extract").select(F.col("store_id").alias("id"), "result")
    j = names.join(newest, "id", "left").withColumn("r", F.from_json("result", schemas.CHECK_RESULT))
    stated = F.array_contains(F.json_object_keys("result"), "confidence")
    confidence = F.when(stated, F.col("r.confidence").try_cast("double")).otherwise(F.lit(1.0))
    products = F.col("r.products")
    if use_products_found:
        held = F.coalesce(F.size(products) > 0, F.lit(False)) | (F.coalesce("r.products_found", F.lit(0)) > 0)
        products = F.when(held, F.array(F.lit("found")))
    gate = fl.content_gate(products, confidence)
    j = j.withColumn("confidence", confidence).filter(F.col("result").isNull() | F.col("confidence").isNotNull())
    rejected = F.col("result").isNotNull() & gate["should_reject"]
    reasons = F.filter(
        F.array(
            F.when(fl.name_blocked("name"), F.concat(F.lit("name_blocked: '"), F.col("name"), F.lit("'"))),
            F.when(rejected, F.concat(F.lit("low_content_confidence: "), gate["reason"])),
        ),
        lambda t: t.isNotNull(),
    )
    out = j.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
    return out.select(F.col("id").alias("store_id"), "name", "city", "state", "reasons")


# --- public quality audit and cleanup plan -------------------------------------------------------------------

def page_priorities(search_pages: DataFrame) -> DataFrame:
    """Impressions per store token of a search-console export; the last row of a token counts."""
    parts = F.filter(F.split(tx.url_path("page"), "/"), lambda p: p != "")
    rows = search_pages.withColumn("parts", parts).filter((F.size("parts") >= 2) & (F.get("parts", F.lit(0)) == "store"))
    return rows.groupBy(F.get("parts", F.lit(1)).alias("token")).agg(
        F.max_by(int_text("impressions"), "row_no").alias("gsc_impressions")
    )


def quality_bucket(stores: DataFrame, refs: DataFrame, presences: DataFrame, search_pages: DataFrame) -> DataFrame:
    """keep, suspect_noindex or remove_or_pending_review for every public-status store, with reason and action."""
    shown = stores.filter(F.col("status").isin(cat.PUBLIC_STATUSES)).select(
        "id", "slug", "name", "status", F.col("discovery_source").alias("source"), "wpn_id"
    )
    flagged = dr.evidence_flags(shown, refs, presences).withColumn(
        "token", F.when(tx.present(F.col("slug")), F.col("slug")).otherwise(F.col("id"))
    )
    j = flagged.join(page_priorities(search_pages), "token", "left").withColumn(
        "gsc_impressions", F.coalesce("gsc_impressions", F.lit(0))
    )
    offtopic = fl.name_blocked("name") | tx.matches_any(F.col("name"), cat.OFFTOPIC_NAME_PATTERNS)
    google = F.col("source") == "google_places"
    verdict = lambda b, r, a: F.struct(
        F.lit(b).alias("bucket"), F.lit(r).alias("reason"), F.lit(a).alias("action")
    )
    v = (
        F.when(tx.blank(F.col("slug")), verdict("suspect_noindex", "slugless_public_store", "noindex"))
        .when(offtopic, verdict("remove_or_pending_review", "blocked_or_obvious_offtopic_name", "manual_review"))
        .when(F.col("wpn_id").isNotNull() | F.col("has_games_workshop") | F.col("has_products"),
              verdict("keep", "trusted_local_signal", "keep"))
        .when(google & ~F.col("has_active_presence"),
              verdict("remove_or_pending_review", "google_only_no_active_presence", "manual_review"))
        .when(google | (F.col("gsc_impressions") > 0), verdict("suspect_noindex", "weak_google_or_gsc_signal", "noindex"))
        .otherwise(verdict("keep", "no_negative_signal", "keep"))
    )
    return j.withColumn("v", v).select(
        "v.bucket", "v.action", "v.reason", "gsc_impressions", "id", F.coalesce("slug", F.lit("")).alias("slug"),
        "name", "status", "source",
    )


def cleanup_plan(audit: DataFrame) -> DataFrame:
    """Adds plan_action, target_status and plan_reason to audit rows."""
    name = F.col("name")
    sure = tx.matches_any(name, cat.CHAIN_CLOSE_PATTERNS) | (
        (F.col("source") == "google_places")
        & ~tx.matches_any(name, cat.PROTECT_NAME_PATTERNS)
        & tx.matches_any(name, cat.CLOSE_NAME_PATTERNS)
    )
    close = (
        (F.col("bucket") == "remove_or_pending_review") & (F.col("reason") == "blocked_or_obvious_offtopic_name") & sure
    )
    step = lambda a, t, r: F.struct(
        F.lit(a).alias("plan_action"), t.alias("target_status"), r.alias("plan_reason")
    )
    plan = (
        F.when(F.col("bucket") == "keep", step("keep", F.col("status"), F.lit("trusted_by_audit")))
        .when(close, step("close_high_confidence", F.lit("closed"), F.lit("obvious_non_lgs_name_pattern")))
        .when(F.col("bucket").isin("remove_or_pending_review", "suspect_noindex"),
              step("suppress_from_public", F.lit("unresponsive"), F.col("reason")))
        .otherwise(step("manual_review", F.col("status"), F.concat(F.lit("unknown_bucket:"), F.col("bucket"))))
    )
    return audit.withColumn("p", plan).select("p.*", *audit.columns)


def ocs_action(stores: DataFrame, refs: DataFrame, presences: DataFrame, state: str | None = None) -> DataFrame:
    """Coverage sweep: action and reason per store, for one state or all."""
    if state is not None:
        stores = stores.filter(F.upper("state") == state.upper())
    rows = dr.evidence_flags(
        stores.select("id", "slug", "name", "city", "state", "status", "discovery_source", "wpn_id", "google_place_id", "phone"),
        refs, presences,
    )
    trusted = (
        ~tx.blank(F.col("wpn_id")) | F.col("has_games_workshop") | F.col("has_products")
        | F.col("discovery_source").isin(cat.TRUSTED_SOURCES)
    )
    status, public = F.col("status"), F.col("status").isin(cat.PUBLIC_STATUSES)
    act = lambda a, r: F.struct(F.lit(a).alias("ocs_action"), r.alias("ocs_reason"))
    verdict = (
        F.when(status == "closed", act("closed_or_false_positive", F.lit("already_closed")))
        .when((status == "unresponsive") & trusted,
              act("review_for_reactivation", F.lit("suppressed_but_has_trusted_signal")))
        .when((status == "unresponsive") & (F.col("has_active_presence") | ~tx.blank(F.col("phone"))),
              act("enrich_then_review", F.lit("suppressed_with_contact_signal")))
        .when(status == "unresponsive", act("suppressed_pending_evidence", F.lit("needs_corroborration")))
        .when(public & trusted, act("public_keep", F.lit("trusted_signal")))
        .when(public & (F.col("discovery_source") == "google_places"),
              act("suppress_or_enrich", F.lit("google_only_public_candidate")))
        .when(public, act("manual_review", F.lit("public_without_clear_trust_signal")))
        .otherwise(act("manual_review", F.concat(F.lit("unknown_status:"), status)))
    )
    return rows.withColumn("v", verdict).select("v.*", *rows.drop("sells_singles_online").columns)


def ocs_counts(actions: DataFrame) -> DataFrame:
    """Rows per state and action, status and source: the three count tables of the sweep in one pass."""
    kinds = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"))
        for k, c in (("action", "ocs_action"), ("status", "status"), ("source", "discovery_source"))
    ]))
    return actions.select("state", kinds.alias("k")).groupBy("state", "k.kind", "k.value").agg(F.count("*").alias("stores"))


def ocs_samples(actions: DataFrame, n: int = 20) -> DataFrame:
    """Per state the first ``n`` rows that need someone's attention, by status, source and name."""
    from pyspark.sql import Window

    urgent = actions.filter(F.col("ocs_action").isin(cat.OCS_PRIORITY_ACTIONS))
    w = Window.partitionBy("state").orderBy("status", "discovery_source", "name", "id")
    return urgent.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n).select(
        "state", "position", "ocs_action", "ocs_reason", "id", "name", "city"
    )


# --- guarded status changes ----------------------------------------------------------------------------------

def plan_outcomes(stores: DataFrame, plan: DataFrame, only=("close_high_confidence", "suppress_from_public"),
                  max_apply: int | None = None) -> DataFrame:
    """What applying a plan does to each planned store.

    ``outcome`` is missing, already_non_public, unchanged, or the applied action. With ``max_apply`` given, a plan with
    more eligible rows is refused.
    """
    eligible = plan.filter(F.col("plan_action").isin(*only)).groupBy("id").agg(
        F.max_by(F.struct("plan_action", "target_status", "plan_reason"), "plan_action").alias("p")
    ).select("id", "p.*")
    if max_apply is not None:
        number = eligible.count()
        if number > max_apply:
            raise ValueError(f"{number} planned changes are more than max_apply={max_apply}; review the plan first")
    known = stores.select("id", F.col("status").alias("old_status"))
    outcome = (
        F.when(F.col("old_status").isNull(), "missing")
        .when(~F.col("old_status").isin(cat.PUBLIC_STATUSES), "already_non_public")
        .when(F.col("old_status") == F.col("target_status"), "unchanged")
        .otherwise(F.col("plan_action"))
    )
    return eligible.join(known, "id", "left").withColumn("outcome", outcome)


def apply_outcomes(stores: DataFrame, outcomes: DataFrame, label: str = "cleanup") -> DataFrame:
    """The next stores snapshot: changed rows get their target status and a note, all others stay."""
    changed = outcomes.filter(F.col("outcome") == F.col("plan_action")).select(
        "id", "target_status",
        F.concat(F.lit(f"\n{label}: "), "plan_action", F.lit(" ("), "plan_reason", F.lit("); was "), "old_status",
                 F.lit(".")).alias("note"),
    )
    notes = F.col("notes") if "notes" in stores.columns else F.lit(None).cast("string")
    j = stores.withColumn("notes", notes).join(changed, "id", "left")
    return j.withColumns({
        "status": F.coalesce("target_status", "status"),
        "notes": F.when(F.col("note").isNotNull(), F.concat(F.coalesce("notes", F.lit("")), "note")).otherwise(F.col("notes")),
    }).drop("target_status", "note")


def outcome_logs(outcomes: DataFrame, as_of: str, source: str, check_type: str = "manual_review") -> DataFrame:
    """One log row per applied change."""
    result = F.to_json(F.struct(
        F.lit(source).alias("source"), "plan_action", "plan_reason",
        F.concat("old_status", F.lit(" -> "), "target_status").alias("transition"),
    ))
    return outcomes.filter(F.col("outcome") == F.col("plan_action")).select(
        F.col("id").alias("store_id"), F.lit(check_type).alias("check_type"), result.alias("result"),
        F.lit(as_of).cast("timestamp_ntz").alias("ts"),
    )


def closing_plan(ids: DataFrame, reason: str) -> DataFrame:
    """A plan that closes the given stores (column ``id``) for one reason."""
    return ids.select("id", F.lit("mark_closed").alias("plan_action"), F.lit("closed").alias("target_status"),
                      F.lit(reason.strip()).alias("plan_reason"))


def run_report(outcomes: DataFrame, names, column: str = "outcome") -> DataFrame:
    """One row: total and a counter per outcome name."""
    return outcomes.agg(
        F.count("*").alias("total"), *[F.count_if(F.col(column) == n).alias(n) for n in names]
    )


# --- URL buckets and slug checks -----------------------------------------------------------------------------

def bucket_counts(search_pages: DataFrame, samples: int = 8) -> DataFrame:
    """Per URL bucket the number of rows, the first samples and the action; empty buckets are shown with 0."""
    from pyspark.sql import Window

    spark = search_pages.sparkSession
    rows = search_pages.filter(tx.present(F.col("page"))).select(
        "row_no", tx.url_path("page").alias("path"), tx.classify_url_path(tx.url_path("page")).alias("bucket")
    )
    counts = rows.groupBy("bucket").agg(F.count("*").alias("count"))
    # row_number <= n is cut per task before the shuffle, so a hot bucket sends only its first rows.
    w = Window.partitionBy("bucket").orderBy("row_no")
    first = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= samples).groupBy("bucket").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda s: s["path"]).alias("samples")
    )
    info = spark.createDataFrame(
        [(b, *v) for b, v in cat.URL_BUCKETS.items()],
        "bucket string, likely_cause string, expected_indexability string, default_action string",
    )
    j = info.join(counts, "bucket", "left").join(first, "bucket", "left")
    has_uuid = F.coalesce(F.get("samples", F.lit(0)), F.lit("")).rlike("(?i)" + cat.UUID_PATTERN)
    action = F.when(F.col("bucket") == "store_uuid", F.when(has_uuid, "redirect").otherwise("noindex")).otherwise(
        F.col("default_action")
    )
    return j.select(
        "bucket", F.coalesce("count", F.lit(0)).alias("count"), "likely_cause", "expected_indexability",
        action.alias("action"), F.coalesce(F.array_join("samples", " | "), F.lit("")).alias("samples"),
    )


def slugless_counts(stores: DataFrame) -> DataFrame:
    bad = stores.filter(F.col("status").isin(cat.PUBLIC_STATUSES) & tx.blank(F.col("slug")))
    return bad.groupBy("status", "discovery_source").agg(F.count("*").alias("stores"))


def slugless_samples(stores: DataFrame, n: int = 25) -> DataFrame:
    """The newest public stores without a slug."""
    bad = stores.filter(F.col("status").isin(cat.PUBLIC_STATUSES) & tx.blank(F.col("slug")))
    return bad.orderBy(F.desc("first_seen"), "id").limit(n).select("id", "name", "status", "discovery_source")


def require_slugs(stores: DataFrame) -> None:
    """Fail when any public store lacks a slug."""
    if not slugless_counts(stores).isEmpty():
        raise ValueError("public stores without a slug exist")


# --- rule checks ---------------------------------------------------------------------------------------------

def coerce(value, allowed) -> Column:
    """Trimmed lower-case value if it is allowed, else null."""
    v = F.lower(F.trim(tx.col(value)))
    return F.when(v.isin(list(allowed)), v)


def _row_rules(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """One scan of ``df`` for all its row rules: (rule, key) of every broken one."""
    marks = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    broken = F.explode(F.filter(marks, lambda m: m.isNotNull()))
    return df.select(broken.alias("rule"), key.cast("string").alias("key"))


def _outside(column: str, allowed, optional: bool = False) -> Column:
    c = F.col(column)
    bad = coerce(c, allowed).isNull()
    return (c.isNotNull() & bad) if optional else bad


def conformance(stores, presences, refs, categories, logs) -> DataFrame:
    """One row per broken rule: number of violations and the smallest violating key."""
    ids = stores.select(F.col("id").alias("store_id"))

    def orphans(df: DataFrame, name: str) -> DataFrame:
        return df.join(ids, "store_id", "left_anti").select(F.lit(name).alias("rule"), F.col("store_id").alias("key"))

    def repeats(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        over = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        return over.select(F.lit(name).alias("rule"), F.concat_ws("/", *keys).alias("key"))

    address_ok = (
        F.length("street").between(1, 255) & F.length("city").between(1, 100)
        & F.col("state").rlike("^[A-Z]{2}$") & F.col("zip_code").rlike(r"^[0-9]{5}(-[0-9]{4})?$")
    )
    public = F.col("status").isin(cat.PUBLIC_STATUSES)
    parts = [
        _row_rules(stores, F.col("id"), {
            "store_status": _outside("status", cat.STORE_STATUSES),
            "discovery_source": _outside("discovery_source", cat.DISCOVERY_SOURCES),
            "wpn_level": _outside("wpn_level", cat.WPN_LEVELS, optional=True),
            "public_needs_slug": public & tx.blank(F.col("slug")),
            "address": ~F.coalesce(address_ok, F.lit(False)),
        }),
        repeats(stores.filter(F.col("slug").isNotNull() & (F.trim("slug") != "")), ["slug"], "unique_slug"),
        _row_rules(presences, F.col("id"), {
            "channel_type": _outside("channel_type", cat.CHANNEL_TYPES),
            "platform": _outside("platform", cat.PLATFORMS, optional=True),
            "presence_status": _outside("status", cat.PRESENCE_STATUSES),
            "inventory_size": _outside("estimated_inventory_size", cat.INVENTORY_SIZES, optional=True),
        }),
        orphans(presences, "presence_store"),
        repeats(refs, ["provider", "external_id"], "unique_external_ref"),
        orphans(refs, "ref_store"),
        _row_rules(categories, F.col("store_id"), {"category": _outside("category", cat.STORED_CATEGORIES)}),
        repeats(categories, ["store_id", "category"], "unique_store_category"),
        orphans(categories, "category_store"),
        _row_rules(logs, F.col("store_id"), {"check_type": _outside("check_type", cat.CHECK_TYPES)}),
        orphans(logs, "log_store"),
    ]
    broken = reduce(DataFrame.unionByName, parts)
    return broken.groupBy("rule").agg(F.count("*").alias("violations"), F.min("key").alias("sample"))
