"""Directory reads: counts per state and city, lists with filters and pages, featured stores, events, attached rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions import text as tx
from placeledger.operators import filters as fl
from placeledger.session import small


def _online_ids(presences: DataFrame) -> DataFrame:
    return presences.filter(F.col("sells_mtg_singles") & (F.col("status") == "active")).select("store_id").distinct()


def _counts() -> list[Column]:
    return [
        F.count("*").alias("store_count"),
        F.count_if(F.col("status").isin("active", "verified")).alias("active_count"),
        F.count_if(F.col("wpn_level") == "premium").alias("wpn_premium_count"),
        F.count_if(F.col("online")).alias("online_count"),
    ]


def _with_online(stores: DataFrame, presences: DataFrame) -> DataFrame:
    ids = _online_ids(presences).withColumn("online", F.lit(True))
    joined = stores.join(ids, stores["id"] == ids["store_id"], "left").drop("store_id")
    return joined.withColumn("online", F.coalesce("online", F.lit(False)))


def state_index(stores: DataFrame, presences: DataFrame, refs: DataFrame) -> DataFrame:
    """Visible stores per state, with active, premium and online-selling counts."""
    shown = fl.visible(stores, refs).filter(F.col("state").isNotNull()).select("id", "state", "status", "wpn_level")
    out = _with_online(shown, presences).groupBy("state").agg(*_counts())
    return out.withColumn("slug", tx.state_to_slug("state")).orderBy(F.desc("store_count"), "state")


def plain_state_counts(stores: DataFrame) -> DataFrame:
    """Public-status stores per state without the trust and slug rules."""
    rows = stores.filter(F.col("status").isin(cat.PUBLIC_STATUSES) & F.col("state").isNotNull())
    return rows.groupBy("state").agg(F.count("*").alias("store_count"))


def city_counts(stores: DataFrame, presences: DataFrame, refs: DataFrame) -> DataFrame:
    """Counts per (state, city) as spelled, for all states. The base of the city reports."""
    shown = fl.visible(stores, refs).filter(F.col("state").isNotNull() & F.col("city").isNotNull())
    out = _with_online(shown.select("id", "state", "city", "status", "wpn_level"), presences)
    return out.groupBy("state", "city").agg(*_counts()).withColumn("slug", tx.city_to_slug("city"))


def city_index(
    stores: DataFrame, presences: DataFrame, refs: DataFrame, state: str | None = None, limit: int | None = None
) -> DataFrame:
    """Cities of one state, or of every state, by number of stores; ranked by state, and cut there, if ``limit`` is given."""
    if state is not None:
        stores = stores.filter(F.upper("state") == state.upper())
    counts = city_counts(stores, presences, refs)
    if limit is None:
        return counts
    w = Window.partitionBy("state").orderBy(F.desc("store_count"), "city")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def nearby_cities(stores: DataFrame, presences: DataFrame, refs: DataFrame, limit: int = 8) -> DataFrame:
    """For every city, the other cities of its state with most stores.

    A city spelled in several cases is left out under each spelling, so the list is cut at ``limit`` plus the number of
    spellings before they are dropped.
    """
    counts = city_counts(stores, presences, refs).withColumn("city_key", F.upper("city"))
    w = Window.partitionBy("state").orderBy(F.desc("store_count"), "city")
    ranked = counts.select("state", "city", "city_key", "store_count", "active_count", "wpn_premium_count",
                           "online_count", "slug").withColumn("r", F.row_number().over(w))
    targets = ranked.groupBy("state", F.col("city_key").alias("for_key")).agg(
        F.count("*").alias("spellings"), F.sort_array(F.collect_list("r")).alias("own_ranks")
    )
    # A city needs the first ``limit`` ranks and one more per spelling of its own, so the rest never meets a city.
    deepest = targets.groupBy("state").agg((F.max("spellings") + limit).alias("deepest"))
    first = ranked.join(small(deepest), "state").filter(F.col("r") <= F.col("deepest")).drop("deepest")
    pairs = targets.join(first, "state").filter(
        (F.col("r") <= F.col("spellings") + limit) & (F.col("city_key") != F.col("for_key"))
    )
    before = F.size(F.filter("own_ranks", lambda x: x < F.col("r")))
    return pairs.withColumn("position", F.col("r") - before).filter(F.col("position") <= limit).select(
        "state", "for_key", "position", "city", "slug", "store_count", "active_count", "wpn_premium_count", "online_count"
    )


def popular_cities(stores: DataFrame, refs: DataFrame, n: int = 12) -> DataFrame:
    shown = fl.visible(stores, refs).filter(F.col("state").isNotNull() & F.col("city").isNotNull())
    counts = shown.groupBy("city", "state").agg(F.count("*").alias("store_count"))
    return counts.orderBy(F.desc("store_count"), "state", "city").limit(n)


def top_city_slugs(stores: DataFrame, refs: DataFrame, n: int = 500) -> DataFrame:
    return popular_cities(stores, refs, n).select(
        "city", "state", tx.state_to_slug("state").alias("state_slug"), tx.city_to_slug("city").alias("city_slug")
    )


def top_cities_for_category(stores: DataFrame, refs: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """The top cities of every category."""
    shown = fl.visible(stores, refs).filter(F.col("state").isNotNull() & F.col("city").isNotNull())
    counts = (
        shown.select("id", "state", "city")
        .join(categories.withColumnRenamed("store_id", "id"), "id")
        .groupBy("category", "state", "city")
        .agg(F.count("*").alias("store_count"))
    )
    w = Window.partitionBy("category").orderBy(F.desc("store_count"), "state", "city")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def category_stats(categories: DataFrame) -> DataFrame:
    return categories.groupBy("category").agg(F.count("*").alias("stores"))


def game_tag_counts(refs: DataFrame) -> DataFrame:
    """Distinct stores per product tag."""
    tags = fl.content_refs(refs).select("store_id", F.explode("content.products").alias("tag"))
    return tags.groupBy("tag").agg(F.count_distinct("store_id").alias("stores"))


def total_public(stores: DataFrame, refs: DataFrame) -> DataFrame:
    """Number of visible stores and that number rounded down to a hundred."""
    return fl.visible(stores, refs).agg(F.count("*").alias("total")).withColumn(
        "rounded", (F.floor(F.col("total") / 100) * 100).cast("bigint")
    )


def filter_options(stores: DataFrame, categories: DataFrame) -> DataFrame:
    """Distinct states, statuses, levels and categories as (kind, value) rows."""
    kinds = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"))
                  for k, c in (("state", "state"), ("status", "status"), ("wpn_level", "wpn_level"))])
    )
    own = stores.select(kinds.alias("o")).select("o.*").filter(F.col("value").isNotNull())
    cats = categories.select(F.lit("category").alias("kind"), F.col("category").alias("value"))
    return own.unionByName(cats).distinct()


def list_stores(
    stores: DataFrame, refs: DataFrame, presences: DataFrame | None = None, categories: DataFrame | None = None, *,
    status: str | None = None, state: str | None = None, city: str | None = None, wpn_level: str | None = None,
    source: str | None = None, sells_singles: bool | None = None, search: str | None = None,
    category: str | None = None, product: str | None = None,
) -> DataFrame:
    """Listed stores under any mix of filters, lazily and unordered; see ``page_of`` for one page."""
    rows = stores.filter(F.col("status") == status if status else F.col("status").isin(cat.PUBLIC_STATUSES))
    if state:
        rows = rows.filter(F.col("state") == state.upper())
    if city:
        rows = rows.filter(F.upper("city") == city.upper())
    if wpn_level:
        rows = rows.filter(F.col("wpn_level") == wpn_level)
    if source:
        rows = rows.filter(F.col("discovery_source") == source)
    if search:
        rows = rows.filter(product_search(search))
    rows = fl.trusted_only(rows.filter(~tx.blank(F.col("slug"))), refs)
    if sells_singles is not None:
        rows = having(rows, presences.filter(F.col("sells_mtg_singles") == sells_singles))
    if category:
        rows = having(rows, categories.filter(F.col("category") == category))
    if product:
        rows = having(rows, fl.content_refs(refs).filter(F.array_contains("content.products", product)))
    return rows


def having(stores: DataFrame, children: DataFrame) -> DataFrame:
    """Stores with at least one row in ``children`` (by ``store_id``)."""
    return stores.join(children.select(F.col("store_id").alias("id")), "id", "left_semi")


def product_search(search: str) -> Column:
    """Case-insensitive match on name, city, state or "city, state". ``%`` and ``_`` in the text stay wildcards."""
    like = f"%{search}%"
    both = F.concat(F.col("city"), F.lit(", "), F.col("state"))
    return F.coalesce(
        F.col("name").ilike(like) | F.col("city").ilike(like) | F.col("state").ilike(like) | both.ilike(like),
        F.lit(False),
    )


def premium_first() -> list[Column]:
    return [F.when(F.col("premium_status") == "premium", 0).otherwise(1).asc(), F.col("name").asc(), F.col("id").asc()]


def page_of(rows: DataFrame, page: int = 1, size: int = cat.PAGE_SIZE, total: int | None = None) -> DataFrame:
    """One page, premium stores first, then by name. With ``total`` given, a page past the end becomes the last one."""
    if total is not None:
        page = min(page, max(1, -(-total // size)))
    return rows.orderBy(*premium_first()).offset((page - 1) * size).limit(size)


def featured(stores: DataFrame, refs: DataFrame, as_of: str, n: int = 8) -> DataFrame:
    rows = fl.visible(stores, refs).filter(
        (F.col("premium_status") == "premium")
        & (F.col("premium_until") > F.lit(as_of).cast("timestamp_ntz"))
        & F.col("hero_image_url").isNotNull()
    )
    return rows.orderBy("name", "id").limit(n)


def upcoming_events(events: DataFrame, today: str, n: int = 20) -> DataFrame:
    """Per store the next ``n`` events on or after ``today``."""
    w = Window.partitionBy("store_id").orderBy("event_date", F.length("id"), "id")
    ahead = events.filter(F.col("event_date") >= F.lit(today).cast("date"))
    return ahead.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


# --- attached rows -------------------------------------------------------------------------------------------

def store_with_presences(stores: DataFrame, presences: DataFrame) -> DataFrame:
    """One row per store and presence (stores without any keep one row), to be read in (channel, url) order.

    Rows stay flat: a store with very many presences is split over tasks instead of becoming one huge array.
    """
    p = presences.select(
        "store_id", F.col("id").alias("presence_id"), "channel_type", "url", "platform", "sells_mtg_singles",
        F.col("status").alias("presence_status"),
    )
    return stores.join(p, stores["id"] == p["store_id"], "left").drop("store_id")


def online_sellers(stores: DataFrame, presences: DataFrame, state: str | None = None, city: str | None = None) -> DataFrame:
    """Presences that sell singles, of stores with a slug. Closed and untrusted stores are included."""
    s = stores.filter(~tx.blank(F.col("slug")))
    if state:
        s = s.filter(F.upper("state") == state.upper())
    if city:
        s = s.filter(F.upper("city") == city.upper())
    s = s.select(F.col("id").alias("store_id"), F.col("slug").alias("store_slug"), F.col("name").alias("store_name"),
                 "state", "city")
    p = presences.filter("sells_mtg_singles").select(
        "store_id", F.col("id").alias("presence_id"), F.col("url").alias("presence_url"), "channel_type", "platform",
        "estimated_inventory_size",
    )
    return s.join(p, "store_id")


def evidence_flags(stores: DataFrame, refs: DataFrame, presences: DataFrame) -> DataFrame:
    """Adds has_games_workshop, has_products, has_active_presence and sells_singles_online.

    The refs and the presences are each reduced to one row per store before they are joined.
    """
    products = F.from_json("payload", "products array<string>")["products"]
    by_ref = refs.groupBy(F.col("store_id").alias("id")).agg(
        F.bool_or(F.col("provider") == "games_workshop").alias("has_games_workshop"),
        F.bool_or((F.col("provider") == "website_content") & (F.size(products) > 0)).alias("has_products"),
    )
    by_presence = presences.groupBy(F.col("store_id").alias("id")).agg(
        F.bool_or(F.col("status") == "active").alias("has_active_presence"),
        F.bool_or((F.col("status") == "active") & F.coalesce("sells_mtg_singles", F.lit(False))).alias("sells_singles_online"),
    )
    out = stores.join(by_ref, "id", "left").join(by_presence, "id", "left")
    names = ["has_games_workshop", "has_products", "has_active_presence", "sells_singles_online"]
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in names})


def attach_city_text(cities: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Adds the description of each (state, city), matched in any case; null if there is none."""
    d = descriptions.groupBy(F.upper("state").alias("state_key"), F.upper("city").alias("city_key")).agg(
        F.min("description").alias("description")
    )
    keyed = cities.withColumns({"state_key": F.upper("state"), "city_key": F.upper("city")})
    return keyed.join(d, ["state_key", "city_key"], "left").drop("state_key", "city_key")


def attach_categories(stores: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds the sorted category list (a store has at most one row per category, so the list is short)."""
    known = categories.filter(F.col("category").isin(cat.STORED_CATEGORIES))
    lists = known.groupBy(F.col("store_id").alias("id")).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    out = stores.join(lists, "id", "left")
    return out.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def other_in_city(stores: DataFrame, refs: DataFrame, n: int = 6) -> DataFrame:
    """For every store, the first ``n`` other visible stores of its city by name.

    Each city keeps its first n + 1 stores; every store then reads that short list and skips itself.
    """
    keys = {"state_key": F.upper("state"), "city_key": F.upper("city")}
    top = (
        fl.visible(stores, refs).withColumns(keys)
        .select("state_key", "city_key", F.col("id").alias("other_id"), "name")
        .withColumnRenamed("name", "other_name")
        .withColumn("r", F.row_number().over(Window.partitionBy("state_key", "city_key").orderBy("other_name", "other_id")))
        .filter(F.col("r") <= n + 1)
    )
    lists = top.groupBy("state_key", "city_key").agg(
        F.array_sort(F.collect_list(F.struct("r", "other_id", "other_name"))).alias("others")
    )
    rows = stores.withColumns(keys).select("id", "state_key", "city_key").join(small(lists), ["state_key", "city_key"])
    kept = F.slice(F.filter("others", lambda o: o["other_id"] != F.col("id")), 1, n)
    return rows.select("id", F.posexplode(kept).alias("pos", "o")).select(
        F.col("id").alias("store_id"), (F.col("pos") + 1).alias("position"), "o.other_id", "o.other_name"
    )


def backfill_category(
    stores: DataFrame, categories: DataFrame,
    sources=("wpn", "google_places", "tcgplayer", "manual"), category: str = "lgs",
) -> DataFrame:
    """Category rows to add: stores of the given sources that lack the category."""
    held = categories.filter(F.col("category") == category).select(F.col("store_id").alias("id"))
    missing = stores.filter(F.col("discovery_source").isin(*sources)).join(held, "id", "left_anti")
    return missing.select(F.col("id").alias("store_id"), F.lit(category).alias("category"))


def redirect_map(requests: DataFrame, stores: DataFrame) -> DataFrame:
    """Outcome of each requested path: redirect to a slug, pass on, or missing.

    Only ``/store/<token>`` paths are looked up: a UUID token by id, other tokens by slug of stores that are not closed.
    """
    token = F.regexp_extract("path", r"^/store/([^/]*)", 1)
    is_store, is_uuid = F.col("path").startswith("/store/"), token.rlike("(?i)" + cat.UUID_PATTERN)
    kind = F.when(is_uuid, F.lit("id:")).otherwise(F.lit("slug:"))
    keyed = requests.filter(is_store).withColumn("key", F.concat(kind, F.lower(token)))
    by_id = stores.select(F.concat(F.lit("id:"), F.lower("id")).alias("key"), F.col("slug").alias("target"))
    slugs = stores.filter((F.col("status") != "closed") & tx.present(F.col("slug"))).select(
        F.concat(F.lit("slug:"), F.lower("slug")).alias("key"), F.col("slug").alias("target")
    )
    known = by_id.unionByName(slugs).groupBy("key").agg(F.min("target").alias("target"), F.lit(True).alias("known"))
    outcome = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("key").startswith("slug:") | F.col("target").isNull(), "pass")
        .otherwise("redirect")
    )
    looked_up = keyed.join(known, "key", "left").select(
        *requests.columns, outcome.alias("outcome"),
        F.when(outcome == "redirect", F.concat(F.lit("/store/"), F.col("target"))).alias("location"),
    )
    # Other paths need no lookup, so they skip the shuffle.
    other = requests.filter(~is_store).select(
        *requests.columns, F.lit("pass").alias("outcome"), F.lit(None).cast("string").alias("location")
    )
    return looked_up.unionByName(other)
