"""Set-like jobs: first-seen dedup, snapshot upserts, crawl diffs, categories, reports over sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions import text as tx
from placeledger.operators import directory as dr
from placeledger.operators import filters as fl
from placeledger.session import small


def first_seen_dedup(df: DataFrame, key, order) -> DataFrame:
    """The first record per key. A map-side minimum, so a key with very many copies sends one row per task."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def snapshot_upsert(target: DataFrame, updates: DataFrame, keys: list[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """The next snapshot: new keys are inserted; of known keys the columns in ``merge`` change.

    In ``merge`` expressions ``old.x`` and ``new.x`` name the two sides; by default every column takes the new value.
    ``updates`` must hold one row per key.
    """
    o = target.select(F.struct(*target.columns).alias("old"), *keys)
    n = updates.select(F.struct(*updates.columns).alias("new"), *keys)
    j = o.join(n, keys, "full")
    columns = []
    for c in target.columns:
        if c in keys:
            columns.append(F.col(c))
            continue
        fresh = F.col(f"new.{c}") if c in updates.columns else F.lit(None).cast(target.schema[c].dataType)
        if merge is not None and c in merge:
            change = merge[c]
        elif merge is None and c in updates.columns:
            change = fresh
        else:
            change = F.col(f"old.{c}")
        columns.append(
            F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNull(), fresh).otherwise(change).alias(c)
        )
    return j.select(*columns)


def union_sources(raws: dict[str, DataFrame]) -> DataFrame:
    """All sources as one table with a ``source`` column; missing columns are null."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in raws.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def recrawl_diff(existing: DataFrame, incoming: DataFrame, key: str, complete: bool = True) -> DataFrame:
    """Status of every external id: new, unchanged, or delisted (only if the crawl was complete)."""
    a = existing.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("store_id"))
    b = incoming.filter(tx.present(F.col(key))).select(key).distinct().withColumn("seen", F.lit(True))
    status = (
        F.when(F.col("store_id").isNull(), "new").when(F.col("seen").isNull(), "delisted").otherwise("unchanged")
    )
    out = a.join(b, key, "full").select(key, "store_id", status.alias("status"))
    return out if complete else out.filter(F.col("status") != "delisted")


def delisting_logs(diff: DataFrame, key: str, reason: str, as_of: str) -> DataFrame:
    payload = F.to_json(F.struct(F.lit(reason).alias("reason"), F.col(key)))
    return diff.filter(F.col("status") == "delisted").select(
        "store_id", F.lit("closure_detect").alias("check_type"), payload.alias("result"),
        F.lit(as_of).cast("timestamp_ntz").alias("ts"),
    )


# --- categories ----------------------------------------------------------------------------------------------

def default_categories(source: Column) -> Column:
    """Category list of a source; empty for sources without a default."""
    pairs = [x for k, v in cat.DEFAULT_CATEGORIES.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]
    return F.coalesce(F.create_map(*pairs)[source], F.array().cast("array<string>"))


def reject_categories(new: DataFrame, allowed=cat.STORE_CATEGORIES) -> DataFrame:
    return new.filter(~F.coalesce(F.col("category").isin(list(allowed)), F.lit(False)))


def new_categories(existing: DataFrame, new: DataFrame, allowed=cat.STORE_CATEGORIES) -> DataFrame:
    """Category rows to add: allowed, not repeated, not there yet."""
    wanted = new.select("store_id", "category").filter(F.col("category").isin(list(allowed))).distinct()
    return wanted.join(existing.select("store_id", "category"), ["store_id", "category"], "left_anti")


def assign_categories(existing: DataFrame, new: DataFrame, allowed=cat.STORE_CATEGORIES) -> DataFrame:
    return existing.select("store_id", "category").unionByName(new_categories(existing, new, allowed))


def content_categories(refs: DataFrame, first: int | None = None, mapping=cat.PRODUCT_CATEGORIES) -> DataFrame:
    """(store_id, category) pairs from the products found on store sites."""
    mapped = F.transform(tx.head(F.col("content.products"), first), lambda p: tx.lookup(mapping, p))
    rows = fl.content_refs(refs).select("store_id", F.explode(F.array_distinct(mapped)).alias("category"))
    return rows.filter(F.col("category").isNotNull()).distinct()


# --- counts --------------------------------------------------------------------------------------------------

def status_counts(stores: DataFrame, column: str = "status") -> DataFrame:
    """Stores per value with the percent of all, to one decimal."""
    counts = stores.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("stores"))
    # The window runs over the counts (a handful of rows), not over the stores.
    total = F.sum("stores").over(Window.partitionBy())
    return counts.withColumn("percent", tx.fixed(F.col("stores") / total * 100, 1))


def discovery_status(stores: DataFrame, categories: DataFrame, presences: DataFrame) -> DataFrame:
    """Counts as (kind, value, rows): stores by source, status and WPN id, rows by category, presences by platform."""
    has_wpn = F.when(F.col("wpn_id").isNotNull(), "with_wpn_id").otherwise("without_wpn_id")
    kinds = F.explode(F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("stores").alias("value")),
        F.struct(F.lit("source").alias("kind"), F.col("discovery_source").alias("value")),
        F.struct(F.lit("status").alias("kind"), F.col("status").alias("value")),
        F.struct(F.lit("wpn").alias("kind"), has_wpn.alias("value")),
    ))
    parts = [
        stores.select(kinds.alias("k")).select("k.*"),
        categories.select(F.lit("category").alias("kind"), F.col("category").alias("value")),
        presences.select(F.lit("platform").alias("kind"), F.col("platform").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "value").agg(F.count("*").alias("rows"))


def source_stats(raw: DataFrame) -> DataFrame:
    """Raw run figures: records, premium and core split, with website, with phone."""
    premium = F.coalesce("is_premium", F.lit(False))
    return raw.agg(
        F.count("*").alias("total"), F.count_if(premium).alias("premium"), F.count_if(~premium).alias("core"),
        F.count_if(tx.present(F.col("website"))).alias("with_website"), F.count_if(tx.present(F.col("phone"))).alias("with_phone"),
    )


def raw_state_counts(raw: DataFrame, n: int = 15) -> DataFrame:
    state = F.upper(F.trim("state"))
    return raw.groupBy(state.alias("state")).agg(F.count("*").alias("records")).orderBy(F.desc("records"), "state").limit(n)


def city_context(stores: DataFrame, presences: DataFrame, least: int = 2, names: int | None = None) -> DataFrame:
    """Facts per city with at least ``least`` public stores: counts, and lists of its stores by name.

    ``names`` cuts the lists (a city's texts), not the counts.
    """
    public = stores.filter(
        F.col("status").isin(cat.PUBLIC_STATUSES) & F.col("state").isNotNull() & F.col("city").isNotNull()
    ).select("id", "name", "state", "city", "status", "wpn_level")
    flags = presences.filter(F.col("status") == "active").groupBy(F.col("store_id").alias("id")).agg(
        F.lit(True).alias("has_online"), F.bool_or(F.coalesce("sells_mtg_singles", F.lit(False))).alias("online")
    )
    j = public.join(flags, "id", "left").withColumns({
        "has_online": F.coalesce("has_online", F.lit(False)), "online": F.coalesce("online", F.lit(False)),
        "state_key": F.upper("state"), "city_key": F.upper("city"),
    })
    cities = j.groupBy("state", "city", "state_key", "city_key").agg(*dr._counts()).filter(F.col("store_count") >= least)
    w = Window.partitionBy("state_key", "city_key").orderBy("name", "id")
    first = j
    if names is not None:
        first = j.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= names)
    lists = first.groupBy("state_key", "city_key").agg(
        F.array_sort(F.collect_list(F.struct("name", "id", "wpn_level"))).alias("listed")
    )
    totals = j.groupBy("state_key", "city_key").agg(F.count_if("has_online").alias("with_online"), F.count_if("online").alias("with_singles"))

    def pick(cond) -> Column:
        return F.transform(F.filter("listed", cond), lambda s: s["name"])

    out = cities.join(lists, ["state_key", "city_key"]).join(totals, ["state_key", "city_key"]).select(
        "state", "city", "store_count", "active_count", "wpn_premium_count", "online_count",
        pick(lambda s: F.lit(True)).alias("names"),
        pick(lambda s: s["wpn_level"].isNotNull()).alias("wpn_names"),
        pick(lambda s: s["wpn_level"] == "premium").alias("wpn_premium_names"),
        "with_online", "with_singles",
    )
    number = lambda c: F.col(c).cast("string")
    named = lambda label, c: F.when(
        F.size(c) > 0,
        F.concat(F.lit(label + ": "), F.size(c).cast("string"), F.lit(" ("), F.array_join(c, ", "), F.lit(")")),
    )
    context = F.concat_ws(
        "\n",
        F.concat(F.lit("City: "), "city", F.lit(", "), "state"),
        F.concat(F.lit("Total game stores: "), number("store_count")),
        F.concat(F.lit("Active/verified stores: "), number("active_count")),
        F.concat(F.lit("Store names: "), F.array_join("names", ", ")),
        named("WPN-authorized stores", "wpn_names"), named("WPN Premium stores", "wpn_premium_names"),
        F.when(F.col("with_online") > 0, F.concat(F.lit("Stores with online presence: "), number("with_online"))),
        F.when(F.col("with_singles") > 0, F.concat(F.lit("Stores selling MTG singles online: "), number("with_singles"))),
    )
    return out.withColumn("context", context)
