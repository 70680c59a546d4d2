"""Row filters and predicates over directory tables. Each takes and returns DataFrames, or Columns where noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger import schemas
from placeledger.functions import text as tx
from placeledger.session import cut, small



def name_blocked(name, block=cat.NAME_BLOCK_PATTERNS, allow=cat.NAME_ALLOW_PATTERNS) -> Column:
    """A blocked word occurs and no allowed word does."""
    c = tx.col(name)
    return tx.matches_any(c, block) & ~tx.matches_any(c, allow)


def types_blocked(types, block=cat.BLOCKED_PLACE_TYPES, override=cat.OVERRIDE_PLACE_TYPES) -> Column:
    """The type list holds a blocked type and no overriding one; an empty or missing list is not blocked."""
    c = tx.col(types)
    hit = lambda values: F.arrays_overlap(c, F.array(*[F.lit(v) for v in values]))
    return F.coalesce(hit(block) & ~hit(override), F.lit(False))


def content_gate(products, confidence, threshold: float = 0.5) -> Column:
    """Struct (should_reject, reason): no products and confidence under the threshold."""
    p, c = tx.col(products), tx.col(confidence)
    reject = F.coalesce((F.coalesce(F.size(p), F.lit(0)) <= 0) & (c < threshold), F.lit(False))
    reason = F.concat(F.lit("0 products detected, confidence="), tx.fixed(c, 2), F.lit(f" (threshold={threshold})"))
    return F.struct(reject.alias("should_reject"), F.when(reject, reason).otherwise("").alias("reason"))


def content_refs(refs: DataFrame) -> DataFrame:
    """Website-content refs with the payload typed once, and confidence as a number."""
    typed = refs.filter(F.col("provider") == "website_content").withColumn(
        "content", F.from_json("payload", schemas.CONTENT_PAYLOAD)
    )
    return typed.withColumn("confidence", F.col("content.confidence").try_cast("double"))


def has_products() -> Column:
    return F.coalesce(F.size("content.products") > 0, F.lit(False))


def trusted_ids(refs: DataFrame) -> DataFrame:
    """Store ids with corroborating refs: found products, or a games_workshop locator hit. May hold repeats."""
    wanted = refs.filter(F.col("provider").isin("website_content", "games_workshop"))
    products = F.from_json("payload", "products array<string>")["products"]
    good = (F.col("provider") == "games_workshop") | (F.size(products) > 0)
    return wanted.filter(F.coalesce(good, F.lit(False))).select("store_id")


def public_only(stores: DataFrame) -> DataFrame:
    return stores.filter(F.col("status").isin(cat.PUBLIC_STATUSES) & ~tx.blank(F.col("slug")))


def trusted_only(stores: DataFrame, refs: DataFrame) -> DataFrame:
    """Drop candidates that no id, product or locator hit corroborates.

    Only such doubtful candidates depend on the refs, so the test is one existence join, not a null-aware anti join.
    """
    ids = trusted_ids(refs)
    hit = ids.where(F.col("store_id") == F.col("id").outer()).exists()
    doubtful = (F.col("status") == "candidate") & F.col("wpn_id").isNull()
    return stores.filter(~doubtful | hit)


def visible(stores: DataFrame, refs: DataFrame) -> DataFrame:
    """Public, with a slug, and trusted: what the directory shows."""
    return trusted_only(public_only(stores), refs)


def us_only(raw: DataFrame, state="state", country=None) -> DataFrame:
    """Rows of the 50 states and DC, or of country US when a country column is given."""
    if country is not None:
        return raw.filter(F.upper(tx.col(country)) == "US")
    return raw.filter(F.upper(F.trim(tx.col(state))).isin(cat.US_STATE_CODES))


def soft_404(html, patterns=cat.SOFT_404_PATTERNS, max_chars: int | None = None) -> Column:
    """A parked or dead page phrase occurs. The whole text is searched unless ``max_chars`` says otherwise."""
    c = tx.col(html)
    c = c if max_chars is None else F.substring(c, 1, max_chars)
    return tx.let(tx.folded(c), lambda plain: tx.any_in_page(c, plain, patterns))


def parked(html, patterns=cat.PARKED_PATTERNS) -> Column:
    return tx.let(tx.folded(tx.col(html)), lambda plain: tx.any_in_page(tx.col(html), plain, patterns))


def parse_enrichment_refs(refs: DataFrame) -> DataFrame:
    return refs.filter(F.col("provider") == "google_places").withColumn(
        "enrichment", F.from_json("payload", schemas.ENRICHMENT_PAYLOAD)
    )


def indexable(stores: DataFrame, presences: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``thin`` (no phone, no hours, no active presence) and ``indexable`` (not thin, public, with a slug)."""
    hours = parse_enrichment_refs(refs).select(
        "store_id",
        (
            F.coalesce(F.size("enrichment.hours.weekday_text") > 0, F.lit(False))
            | F.exists(
                F.coalesce(F.col("enrichment.hours.periods"), F.array()),
                lambda p: p["open"].isNotNull() & p["close"].isNotNull(),
            )
        ).alias("has_hours"),
    ).groupBy("store_id").agg(F.bool_or("has_hours").alias("has_hours"))
    active = presences.filter(F.col("status") == "active").select("store_id").distinct().withColumn(
        "has_presence", F.lit(True)
    )
    joined = stores.join(hours, stores["id"] == hours["store_id"], "left").drop("store_id")
    joined = joined.join(active, joined["id"] == active["store_id"], "left").drop("store_id")
    thin = ~tx.present(F.col("phone")) & ~F.coalesce("has_hours", F.lit(False)) & ~F.coalesce("has_presence", F.lit(False))
    ok = F.col("status").isin(cat.PUBLIC_STATUSES) & tx.present(F.col("slug"))
    return joined.withColumn("thin", thin).withColumn("indexable", ~F.col("thin") & ok)


def work_queue(presences: DataFrame, stores: DataFrame, refs: DataFrame, stage: str, limit: int | None = None) -> DataFrame:
    """Presences a stage still has to work on.

    ``platform`` and ``singles``: active, not yet detected. ``pricing`` and ``freshness``: active website of an active
    store that sells singles (freshness also needs a known shop platform). ``content``: active website not yet scraped,
    host not blocked, one presence per URL (the lowest id).
    """
    active = presences.filter(F.col("status") == "active")
    if stage == "platform":
        out = active.filter(F.col("platform").isNull())
    elif stage == "singles":
        out = active.filter(F.col("sells_mtg_singles").isNull())
    elif stage in ("pricing", "freshness"):
        shops = active.filter((F.col("channel_type") == "website") & F.col("sells_mtg_singles"))
        if stage == "freshness":
            shops = shops.filter(F.col("platform").isin(cat.ECOMMERCE_PLATFORMS))
        live = stores.filter(F.col("status") == "active").select(F.col("id").alias("store_id"))
        out = shops.join(live, "store_id", "left_semi")
    elif stage == "content":
        done = refs.filter(F.col("provider") == "website_content").select("store_id")
        todo = active.filter(
            (F.col("channel_type") == "website")
            & F.col("url").isNotNull()
            & ~tx.is_blocked_url("url", cat.SCRAPE_BLOCKED_DOMAINS)
        ).join(done, "store_id", "left_anti")
        row = F.struct(*[F.col(c) for c in todo.columns])
        out = todo.groupBy("url").agg(F.min_by(row, F.struct(F.length("id"), F.col("id"))).alias("row")).select("row.*")
    else:
        raise ValueError(f"unknown stage: {stage}")
    return out if limit is None else out.orderBy(F.length("id"), "id").limit(limit)


def needs_enrichment(
    stores: DataFrame, refs: DataFrame, as_of: str, days: int = 30, limit: int | None = None
) -> DataFrame:
    """Stores with a place id whose payload is missing, undated, badly dated or older than ``days``.

    ``limit`` keeps the first due stores by name.
    """
    base = stores.filter(tx.present(F.col("google_place_id"))).select("id", "name", "google_place_id")
    stamped = refs.filter(F.col("provider") == "google_places").groupBy("store_id").agg(
        F.min("payload").alias("payload")
    )
    joined = base.join(stamped, base["id"] == stamped["store_id"], "left")
    at = F.get_json_object("payload", "$.enriched_at")
    stamp = F.replace(at, F.lit("Z"), F.lit("+00:00")).try_cast("timestamp")
    stale = stamp < F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    due = F.col("payload").isNull() | ~tx.present(at) | stamp.isNull() | stale
    found = joined.filter(due).select("id", "name", "google_place_id")
    return found if limit is None else found.orderBy("name", "id").limit(limit)


def missing_place_id(stores: DataFrame, limit: int | None = None) -> DataFrame:
    out = stores.filter(~tx.present(F.col("google_place_id")) & (F.col("status") != "closed")).select(
        "id", "name", "city", "state"
    )
    return out if limit is None else out.orderBy("name", "id").limit(limit)


def choose_presence(presences: DataFrame) -> DataFrame:
    """Per store the presence to enrich from: an active website off the social networks, else any active one."""
    active = presences.filter(F.col("status") == "active")
    social = F.lower("url").contains("facebook.com") | F.lower("url").contains("instagram.com")
    rank = F.when((F.col("channel_type") == "website") & ~social, 0).otherwise(1)
    row = F.struct("id", "url", "channel_type")
    return active.groupBy("store_id").agg(
        F.min_by(row, F.struct(rank, F.length("id"), F.col("id"))).alias("chosen")
    ).select("store_id", F.col("chosen.id").alias("presence_id"), "chosen.url", "chosen.channel_type")


def enrichment_candidates(
    stores: DataFrame, presences: DataFrame, refs: DataFrame, state: str | None = None, limit: int | None = None,
    include_existing: bool = False, excluded=cat.ENRICH_EXCLUDED_HOSTS,
) -> DataFrame:
    """Stores with an active website whose chosen presence is not on an excluded host and that have no content yet."""
    eligible = stores.filter(F.col("status").isin("active", "verified", "candidate", "unresponsive"))
    if state is not None:
        eligible = eligible.filter(F.col("state") == state)
    sites = presences.filter((F.col("status") == "active") & (F.col("channel_type") == "website")).select(
        F.col("store_id").alias("id")
    )
    eligible = eligible.join(sites, "id", "left_semi")
    if not include_existing:
        done = refs.filter(F.col("provider") == "website_content").select(F.col("store_id").alias("id"))
        eligible = eligible.join(done, "id", "left_anti")
    chosen = choose_presence(presences)
    # A value without a scheme is read as https://value.
    full = F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.concat(F.lit("https://"), F.col("url")))
    usable = chosen.filter(~tx.is_blocked_url(full, excluded))
    out = eligible.join(usable, eligible["id"] == usable["store_id"]).select(
        "id", "name", "state", "status", "presence_id", "url"
    )
    return out if limit is None else out.orderBy(F.desc("status"), "name", "id").limit(limit)


def lookup_by_name_city(stores: DataFrame, closing: DataFrame) -> DataFrame:
    """Open stores whose name contains a listed fragment in the listed city and state (any case).

    A name that contains a fragment contains its first three letters, so names and fragments meet by city and those
    letters instead of all with all; fragments of one or two letters use their one or two. Only letters that begin some fragment
    are moved: of the many pieces of a name few do.
    """
    keys = {"city_key": F.upper("city"), "state_key": F.upper("state")}
    c = closing.select("fragment", F.lower("fragment").alias("needle"), "city", "state").withColumns(keys).drop("city", "state")
    c = cut(c.withColumn("piece", F.substring("needle", 1, 3)))
    begins = small(cut(c.select("piece").distinct()))
    s = stores.filter(F.col("status") != "closed").withColumns(keys)
    s = s.join(c.select("state_key", "city_key").distinct(), ["state_key", "city_key"], "left_semi")
    lower = F.lower("name")
    starts = F.sequence(F.lit(1), F.length(lower))
    pieces = F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(lower, i, F.lit(n)) for n in (1, 2, 3)])))
    pieces = F.when(F.length("name") > 0, F.array_append(F.array_distinct(pieces), F.lit(""))).otherwise(F.array(F.lit("")))
    s = s.select("id", "name", "city", "state", "status", "state_key", "city_key", F.explode(pieces).alias("piece"))
    met = s.join(begins, "piece", "left_semi").join(c, ["state_key", "city_key", "piece"]).filter(F.contains(F.lower("name"), F.col("needle")))
    return met.select("fragment", "id", "name", "city", "state", "status")
