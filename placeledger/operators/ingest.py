"""Ingest of one source batch: filter, check, normalize, resolve, fill or insert, and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions import text as tx
from placeledger.operators import filters as fl
from placeledger.operators import lifecycle as lc
from placeledger.operators import resolve as rs
from placeledger.operators import sets as st
from placeledger.session import cut, deal

OUTCOMES = ["inserted", "updated", "skipped", "errors"]
# Fields that a match may fill: (store column, record column, whether an empty text counts as missing).
FILLS = [
    ("latitude", "latitude", False), ("longitude", "longitude", False), ("phone", "phone", True),
    ("wpn_id", "wpn_id", True), ("wpn_level", "wpn_level", True), ("google_place_id", "google_place_id", True),
]


def screen(raw: DataFrame) -> DataFrame:
    """Adds the checked ``address`` and a ``reject``: filtered (not an error), invalid_address, or null.

    Place records are screened by name and place type. Their address comes parsed; other sources' parts are cleaned here.
    """
    google = F.col("source") == "google_places"
    loose = tx.validate_address("street", "city", "state", "zip_code")
    strict = tx.checked_address(F.col("street"), F.col("city"), F.col("state"), F.col("zip_code"))
    rows = raw.withColumn("address", F.when(google, strict).otherwise(loose))
    usable = tx.normalize_address("address.street", "address.city", "address.state", "address.zip_code").isNotNull()
    unwanted = google & (fl.name_blocked("name") | fl.types_blocked("place_types"))
    return rows.withColumn(
        "reject",
        F.when(F.coalesce(unwanted, F.lit(False)), "filtered")
        .when(F.col("address").isNull() | ~usable | ~tx.present(F.col("name")), "invalid_address"),
    )


def _candidate_id() -> Column:
    return F.concat_ws(":", "source", F.coalesce("external_id", F.lit("")), F.col("seq").cast("string"))


def _once(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each candidate_id, the rows that repeat it).

    Records of one source, external id and turn are one record that came more than once; the least of them counts. They are put
    together in each task before the shuffle.
    """
    groups = cut(rows.groupBy("candidate_id").agg(F.min(F.struct(*rows.columns)).alias("r"), F.count("*").alias("times")))
    again = groups.filter("times > 1").select("r.*", F.explode(F.sequence(F.lit(2), F.col("times"))).alias("time")).drop("time")
    return groups.select("r.*"), again


def _refs_of(source: Column) -> Column:
    """Sources that are tracked by external id in the refs table; the others are found by their id column."""
    return ~source.isin("wpn", "google_places")


def fill_missing(stores: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stores with filled gaps, (store_id, seq) of the rows that filled something).

    ``rows`` are matched records with ``store_id`` and ``seq``. Of all records of a store the first one that has a value
    fills the gap; that is one pre-aggregated minimum per store and field.
    """
    def held(name: str, text: bool) -> Column:
        return tx.present(F.col(name)) if text else F.col(name).isNotNull()

    firsts = rows.groupBy(F.col("store_id").alias("id")).agg(*[
        F.min(F.when(held(r, text), F.struct("seq", F.col(r).alias("value")))).alias("f_" + s) for s, r, text in FILLS
    ])
    j = stores.join(firsts, "id", "left")
    gap = {s: (~held(s, text)) & F.col("f_" + s).isNotNull() for s, _, text in FILLS}
    turns = F.filter(
        F.array(*[F.when(gap[s], F.col(f"f_{s}.seq")) for s, _, _ in FILLS]), lambda t: t.isNotNull()
    )
    fillers = j.select(F.col("id").alias("store_id"), F.explode(F.array_distinct(turns)).alias("seq"))
    filled = j.withColumns({s: F.when(gap[s], F.col(f"f_{s}.value")).otherwise(F.col(s)) for s, _, _ in FILLS})
    return filled.select(*stores.columns), fillers


def fill_pairs(pairs: DataFrame) -> DataFrame:
    """Field rule alone: one matched record per store, old and new values side by side, with an ``updated`` flag."""
    changed, out = F.lit(False), {}
    for s, r, text in FILLS:
        old, new = F.col(s), F.col("new_" + r)
        if "new_" + r not in pairs.columns:
            continue
        missing = ~tx.present(old) if text else old.isNull()
        given = tx.present(new) if text else new.isNotNull()
        out[s] = F.when(missing & given, new).otherwise(old)
        changed = changed | (missing & given)
    return pairs.withColumn("updated", changed).withColumns(out)


def ingest(raw: DataFrame, stores: DataFrame, refs: DataFrame, categories: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Bring one batch of common records (of one or more sources) into the directory.

    Gives the next snapshots of ``stores``, ``categories`` and ``refs``, the ``presences`` to add, one ``outcomes`` row
    per record (inserted, updated, skipped or errors, with store id and review flag) and the ``report`` counters.
    ``seq`` in ``raw`` is the turn of a record; a record that comes again with its source, external id and turn is skipped
    (``tier`` is then "repeated").
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    rows, again = _once(screen(deal(raw)).withColumn("candidate_id", _candidate_id()))
    good = rows.filter(F.col("reject").isNull())
    tracked = _refs_of(F.col("source"))
    cands = good.select(
        "candidate_id", "seq", "name", "address.street", "address.city", "address.state", "address.zip_code", "latitude",
        "longitude", "wpn_id", "google_place_id", F.col("source").alias("provider"),
        F.when(tracked, F.col("external_id")).alias("external_id"),
    )
    decided = cut(rs.resolve_candidates(cands, stores, refs))
    joined = cut(good.join(decided, "candidate_id"))

    # New stores, and existing ones with their gaps filled.
    made = joined.filter("is_new").select(
        F.col("store_id").alias("id"), "name", "address.street", "address.city", "address.state", "address.zip_code",
        "latitude", "longitude", "phone", "wpn_id", "wpn_level", "google_place_id", F.lit("candidate").alias("status"),
        F.col("source").alias("discovery_source"), now.alias("first_seen"),
    )
    every = stores.unionByName(made, allowMissingColumns=True)
    matched = joined.filter(~F.col("is_new"))
    filled, fillers = fill_missing(every, matched)
    turns = joined.groupBy(F.col("store_id").alias("id")).agg(F.min("seq").alias("touched"))
    slugless = tx.blank(F.col("slug")) & F.col("status").isin(cat.PUBLIC_STATUSES)
    touched = cut(filled.join(turns, "id", "left"))
    next_stores = lc.assign_slugs(touched, order=("touched",), only=F.col("touched").isNotNull()).drop("touched")

    # The first record of a store without a slug updates it; inserted stores get theirs as they are made.
    named = touched.filter(slugless & F.col("touched").isNotNull()).select(
        F.col("id").alias("store_id"), F.col("touched").alias("seq")
    )
    active = fillers.unionByName(named).distinct().withColumn("changed", F.lit(True))
    done = joined.join(active, ["store_id", "seq"], "left").select(
        "candidate_id", "seq", "source", "external_id", "store_id", "tier", "needs_review",
        F.when(F.col("is_new"), "inserted").when(F.col("changed"), "updated").otherwise("skipped").alias("outcome"),
    )
    rejected = rows.filter(F.col("reject").isNotNull()).select(
        "candidate_id", "seq", "source", "external_id", F.lit(None).cast("string").alias("store_id"),
        F.col("reject").alias("tier"), F.lit(False).alias("needs_review"),
        F.when(F.col("reject") == "filtered", "skipped").otherwise("errors").alias("outcome"),
    )
    repeated = again.select(
        "candidate_id", "seq", "source", "external_id", F.lit(None).cast("string").alias("store_id"), F.lit("repeated").alias("tier"),
        F.lit(False).alias("needs_review"), F.lit("skipped").alias("outcome"),
    )
    outcomes = done.unionByName(rejected).unionByName(repeated)

    presences = joined.filter(
        F.col("is_new") & tx.present(F.col("website")) & ~tx.is_blocked_url("website", cat.INGEST_BLOCKED_DOMAINS)
    ).select(
        F.concat("store_id", F.lit(":website")).alias("id"), "store_id", F.lit("website").alias("channel_type"),
        F.col("website").alias("url"), F.lit("active").alias("status"),
    )
    wanted = joined.select("store_id", F.explode(st.default_categories(F.col("source"))).alias("category"))
    seen = joined.filter(tracked & F.col("external_id").isNotNull()).groupBy(
        F.col("source").alias("provider"), "external_id"
    ).agg(F.max_by("store_id", "seq").alias("store_id")).withColumn("seen", now)
    next_refs = st.snapshot_upsert(
        refs, seen, ["provider", "external_id"], {"store_id": F.col("new.store_id"), "seen": F.col("new.seen")}
    )
    report = outcomes.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("outcome") == n).alias(n) for n in OUTCOMES],
        F.count_if("needs_review").alias("needs_review"),
    )
    return {
        "stores": next_stores, "categories": st.assign_categories(categories, wanted), "refs": next_refs,
        "presences": presences, "outcomes": outcomes, "report": report,
    }
