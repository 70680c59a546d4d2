"""Card prices: search queue, price samples against the market, and the inferred pricing method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions import text as tx
from placeledger.operators import audit as au
from placeledger.session import small


def quote_plus(text: Column) -> Column:
    """URL query form of a text: spaces become "+", and only ``_.-~`` stay besides letters and digits."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_url(base: Column, card: Column, platform: Column) -> Column:
    root, name = F.regexp_replace(base, "/+$", ""), quote_plus(card)
    return (
        F.when(platform == "crystal_commerce", F.concat(root, F.lit("/products/search?q="), name))
        .when(platform.isin("shopify", "binderpos"), F.concat(root, F.lit("/search?q="), name, F.lit("&type=product")))
        .when(platform == "woocommerce", F.concat(root, F.lit("/?s="), name, F.lit("&post_type=product")))
        .otherwise(F.concat(root, F.lit("/search?q="), name))
    )


def search_queue(presences: DataFrame, cards=cat.PROBE_CARDS) -> DataFrame:
    """One row per presence and probe card with its search URL. The short card list is exploded in place."""
    platform = au.coerce("platform", cat.PLATFORMS)
    rows = presences.select(
        F.col("id").alias("presence_id"), "url", platform.alias("platform"),
        F.explode(F.array(*[F.lit(c) for c in cards])).alias("card_name"),
    )
    return rows.select("presence_id", "card_name", search_url(F.col("url"), F.col("card_name"), F.col("platform")).alias("search_url"))


def price_samples(found: DataFrame, market: DataFrame) -> DataFrame:
    """Found prices with a known market price and the percent difference in tenths, rounded half to even."""
    j = found.join(small(market), "card_name").filter(F.col("price_cents").isNotNull())
    percent = F.abs(F.col("price_cents") - F.col("market_cents")) / F.col("market_cents") * 100.0
    return j.withColumn("delta_tenths", F.rint(percent * 10).cast("bigint"))


def price_delta(samples: DataFrame) -> DataFrame:
    """Per presence the number of samples and their mean difference. Tenths are summed, so the order cannot matter."""
    return samples.groupBy("presence_id").agg(
        F.count("*").alias("cards_found"), (F.sum("delta_tenths") / 10 / F.count("*")).alias("avg_delta_pct")
    )


def infer_pricing(avg_delta: Column, cards_found: Column, last_update: Column, as_of: str) -> Column:
    """Struct (pricing_method, confidence) from the mean difference and how fresh the site is."""
    now = F.lit(as_of).cast("timestamp_ntz")
    days = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last_update.cast("timestamp"))) / 86400)
    recent = F.coalesce(days <= 30, F.lit(False))
    out = lambda m, c: F.struct(F.lit(m).alias("pricing_method"), F.lit(c).alias("confidence"))
    return (
        F.when(F.coalesce(cards_found, F.lit(0)) < 3, out("unknown", 0.30))
        .when((avg_delta <= 10) & recent, out("synced", 0.85))
        .when(avg_delta <= 15, out("synced", 0.70))
        .when(avg_delta > 30, out("manual", 0.80))
        .otherwise(out("unknown", 0.40))
    )


def detect_pricing(presences: DataFrame, found: DataFrame, market: DataFrame, last_updates: DataFrame, as_of: str) -> DataFrame:
    """Pricing method of every given presence. ``last_updates`` holds (presence_id, last_update)."""
    deltas = price_delta(price_samples(found, market))
    j = (
        presences.select(F.col("id").alias("presence_id"))
        .join(deltas, "presence_id", "left")
        .join(last_updates, "presence_id", "left")
    )
    verdict = infer_pricing(F.col("avg_delta_pct"), F.col("cards_found"), F.col("last_update"), as_of)
    return j.withColumn("v", verdict).select(
        "presence_id", F.coalesce("cards_found", F.lit(0)).alias("cards_found"),
        F.coalesce("avg_delta_pct", F.lit(0.0)).alias("avg_delta_pct"), "v.pricing_method", "v.confidence",
    )


def price_divergence(deltas: DataFrame, percent: float = 30.0) -> DataFrame:
    """Presences whose mean price difference is above ``percent``."""
    return deltas.filter(F.col("avg_delta_pct") > percent)
