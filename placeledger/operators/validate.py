"""Validation of presences over fetched pages: reachability, platform, singles, review budget, and revalidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeledger.operators import lifecycle as lc
from placeledger.operators import pages as pg
from placeledger.session import cut

REVIEW_COST_CENTS = 5


def validate_presences(
    presences: DataFrame, pages: DataFrame, product_pages: DataFrame, budget_cents: int = 500, redo: bool = False
) -> DataFrame:
    """Presences with a fetched page, checked and completed.

    ``pages`` has presence_id, url, status_code, error, html, headers; ``product_pages`` has presence_id, page_no, html,
    status_code. Platform and singles are only worked out for pages that answered; what is known already stays unless
    ``redo`` is set. A row whose own page cannot be read has a status and nothing else, so one bad page stops nothing.
    ``escalate`` marks undecided rows that the review budget still covers, in order of presence.
    """
    known = presences.select(
        F.col("id").alias("presence_id"), "store_id", F.col("platform").alias("old_platform"),
        F.col("sells_mtg_singles").alias("old_singles"), F.col("estimated_inventory_size").alias("old_size"),
    )
    rows = pages.join(known, "presence_id").withColumn("check", lc.check_status("status_code", "html", "error"))
    rows = pg.detect_singles(rows, product_pages, "presence_id")
    live = F.col("check.status") == "active"
    keep_platform = ~live if redo else (~live | F.col("old_platform").isNotNull())
    keep_singles = ~live if redo else (~live | F.col("old_singles").isNotNull())
    out = rows.withColumns({
        "platform": F.when(keep_platform, F.col("old_platform")).otherwise(pg.detect_platform("html", "headers", "url")),
        "sells_mtg_singles": F.when(keep_singles, F.col("old_singles")).otherwise(F.col("singles.sells")),
        "estimated_inventory_size": F.when(keep_singles, F.col("old_size")).otherwise(F.coalesce("singles.size", "old_size")),
        "platform_done": ~keep_platform, "singles_done": ~keep_singles, "unsure": ~keep_singles & F.col("escalate"),
        "turn": F.struct(F.length("presence_id"), F.col("presence_id")),
    }).select(
        "presence_id", "store_id", "check.status", "check.reason", "old_platform", "old_singles", "platform",
        "sells_mtg_singles", "estimated_inventory_size", "platform_done", "singles_done", "unsure", "turn",
    )
    # The budget looks at the rows twice, and callers make several tables of them: the page work is done once.
    return cut(lc.budget_gate(cut(out), "unsure", "turn", budget_cents, REVIEW_COST_CENTS).drop("turn"))


def validation_report(results: DataFrame) -> DataFrame:
    done = F.col("singles_done")
    return results.agg(
        F.count_distinct("store_id").alias("total_stores"), F.count("*").alias("presences_found"),
        F.count_if("platform_done").alias("platforms_detected"),
        F.count_if(done & F.col("sells_mtg_singles")).alias("singles_detected"),
        F.count_if("escalate").alias("reviews"), (F.count_if("escalate") * REVIEW_COST_CENTS).alias("review_cents"),
    )


def apply_validation(presences: DataFrame, results: DataFrame) -> DataFrame:
    """The next presences snapshot."""
    new = results.select(
        F.col("presence_id").alias("id"), F.col("status").alias("n_status"), F.col("platform").alias("n_platform"),
        F.col("sells_mtg_singles").alias("n_singles"), F.col("estimated_inventory_size").alias("n_size"),
    ).withColumn("checked", F.lit(True))
    j = presences.join(new, "id", "left")
    pick = lambda n, old: F.when(F.col("checked"), F.col(n)).otherwise(F.col(old))
    return j.withColumns({
        "status": pick("n_status", "status"), "platform": pick("n_platform", "platform"),
        "sells_mtg_singles": pick("n_singles", "sells_mtg_singles"),
        "estimated_inventory_size": pick("n_size", "estimated_inventory_size"),
    }).drop("checked", "n_status", "n_platform", "n_singles", "n_size")


def revalidate(
    stores: DataFrame, presences: DataFrame, logs: DataFrame, pages: DataFrame, product_pages: DataFrame,
    budget_cents: int = 500,
) -> dict[str, DataFrame]:
    """Detect platform and singles again on the active presences of active and verified stores, then evaluate those stores.

    Gives the ``results`` per presence, the next ``presences`` and the ``targets`` of stores that change.
    """
    chosen = stores.filter(F.col("status").isin("active", "verified"))
    sites = presences.filter(F.col("status") == "active").join(chosen.select(F.col("id").alias("store_id")), "store_id", "left_semi")
    results = validate_presences(sites, pages, product_pages, budget_cents, redo=True)
    # A page that does not answer says nothing about the presence here: only health runs change the status.
    after = apply_validation(presences, results.withColumn("status", F.lit("active")))
    return {"results": results, "presences": after, "targets": lc.evaluate_status(chosen, after, logs)}


def revalidation_report(results: DataFrame, targets: DataFrame) -> DataFrame:
    counts = results.agg(
        F.count_distinct("store_id").alias("stores"), F.count_if(F.col("platform_done") & F.col("old_platform").isNotNull()).alias("platforms_cleared"),
        F.count_if("platform_done").alias("platforms_detected"),
        F.count_if(F.col("singles_done") & F.col("old_singles").isNotNull()).alias("singles_cleared"),
        F.count_if(F.col("singles_done") & F.col("sells_mtg_singles")).alias("singles_detected"),
    )
    return counts.withColumn("transitions", targets.agg(F.count("*").alias("n")).scalar())
