"""Store lifecycle: check history, status rules, transitions, closures, claims and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.functions import text as tx
from placeledger.operators import filters as fl
from placeledger.session import cut

FAILED = ["unreachable", "dead"]


def check_status(status_code, html, error) -> Column:
    """Struct (status, reason) of one fetched page: dead, unreachable or active."""
    code, body, err = tx.col(status_code), tx.col(html), tx.col(error)
    out = lambda s, r: F.struct(F.lit(s).alias("status"), r.alias("reason"))
    return (
        F.when(err == "timeout", out("unreachable", F.lit("Timeout")))
        .when(err == "connect", out("unreachable", F.lit("Connection refused")))
        .when(err.isNotNull(), out("unreachable", err))
        .when(code >= 400, out("dead", F.concat(F.lit("HTTP "), code.cast("string"))))
        .when(F.coalesce(fl.soft_404(body), F.lit(False)), out("dead", F.lit("Soft 404 detected")))
        .otherwise(out("active", F.lit(None).cast("string")))
    )


def log_order(df: DataFrame) -> list[str]:
    return [c for c in ("ts", "seq", "seq2", "seq3") if c in df.columns]


def consecutive_failures(logs: DataFrame, n: int = 3) -> DataFrame:
    """Presences whose last ``n`` HTTP checks exist and all failed.

    ``rank <= n`` is applied per task before the shuffle, so a presence with a huge history sends n rows per task.
    """
    checks = logs.filter((F.col("check_type") == "http_check") & F.col("presence_id").isNotNull())
    w = Window.partitionBy("presence_id").orderBy(*[F.desc(c) for c in log_order(logs)])
    last = checks.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    bad = F.coalesce(F.get_json_object("result", "$.status").isin(FAILED), F.lit(False))
    return last.groupBy("presence_id").agg(F.count("*").alias("checks"), F.bool_and(bad).alias("failing")).filter(
        (F.col("checks") == n) & F.col("failing")
    ).select("presence_id")


def all_dead(presences: DataFrame) -> DataFrame:
    """Stores with at least one presence, all of them dead."""
    return presences.groupBy("store_id").agg(
        F.bool_and(F.coalesce(F.col("status") == "dead", F.lit(False))).alias("dead"), F.count("*").alias("presences")
    ).filter("dead").select("store_id", "presences")


def evaluate_status(stores: DataFrame, presences: DataFrame, logs: DataFrame, failures: int = 3) -> DataFrame:
    """Stores whose evidence calls for a new status: (id, status, target).

    Any log makes a candidate verified; any presence that sells singles makes a verified store active; an active store
    whose website presences all keep failing is unresponsive; an active presence brings an unresponsive store back.
    """
    logged = logs.select(F.col("store_id").alias("id")).distinct().withColumn("logged", F.lit(True))
    failing = consecutive_failures(logs, failures).withColumn("failing", F.lit(True))
    sites = presences.join(failing, presences["id"] == failing["presence_id"], "left")
    website = F.col("channel_type") == "website"
    flags = sites.groupBy(F.col("store_id").alias("id")).agg(
        F.bool_or(F.coalesce("sells_mtg_singles", F.lit(False))).alias("singles"),
        F.bool_or(F.coalesce(F.col("status") == "active", F.lit(False))).alias("reached"),
        F.count_if(website).alias("websites"),
        F.count_if(website & F.col("failing")).alias("failing"),
    )
    j = stores.select("id", "status").join(logged, "id", "left").join(flags, "id", "left")
    target = (
        F.when((F.col("status") == "candidate") & F.col("logged"), "verified")
        .when((F.col("status") == "verified") & F.col("singles"), "active")
        .when((F.col("status") == "active") & (F.col("websites") > 0) & (F.col("failing") == F.col("websites")), "unresponsive")
        .when((F.col("status") == "unresponsive") & F.col("reached"), "active")
    )
    return j.select("id", "status", target.alias("target")).filter(F.col("target").isNotNull())


def can_transition(current: Column, target: Column) -> Column:
    pairs = [f"{a}>{b}" for a, b in cat.STATUS_TRANSITIONS]
    return F.coalesce(F.concat(current, F.lit(">"), target).isin(pairs), F.lit(False))


def assign_slugs(stores: DataFrame, order=("first_seen", "id"), only: Column | None = None) -> DataFrame:
    """Fill empty slugs of public stores; slugs that exist never change.

    The earliest store (by ``order``) of a base slug gets it if no store holds it yet; the others get the base plus part
    of their id, or where that is held or given to an earlier store, the whole id. Who comes first is found by a pre-aggregated minimum per base, and joined back by store id, so a base
    that very many stores share is no hot join key. ``only`` limits the stores that may get a slug.
    """
    base = tx.build_slug("name", "city", "state")
    open_slug = tx.blank(F.col("slug")) & F.col("status").isin(cat.PUBLIC_STATUSES)
    if only is not None:
        open_slug = open_slug & F.coalesce(only, F.lit(False))
    todo = stores.filter(open_slug).select("id", F.struct(*order).alias("turn"), base.alias("base"))
    held = stores.filter(F.col("slug").isNotNull()).select(F.col("slug").alias("base"))
    first = todo.groupBy("base").agg(F.min_by("id", "turn").alias("id"))
    winners = first.join(held, "base", "left_anti").select("id", F.lit(True).alias("wins"))
    # A short id serves one store, and only where no store holds it or just got it as its base.
    losers = todo.join(winners, "id", "left_anti").withColumn("base", tx.disambiguate_slug(F.col("base"), F.col("id")))
    taken = held.unionByName(first.select("base"))
    short = losers.groupBy("base").agg(F.min_by("id", "turn").alias("id")).join(taken, "base", "left_anti").select("id", F.lit(True).alias("is_short"))
    out = stores.join(winners, "id", "left").join(short, "id", "left")
    unique = F.when(F.coalesce("wins", F.lit(False)), base).when(
        F.coalesce("is_short", F.lit(False)), tx.disambiguate_slug(base, F.col("id"))
    ).otherwise(tx.disambiguate_slug(base, F.col("id"), None))
    return out.withColumn("slug", F.when(open_slug, unique).otherwise(F.col("slug"))).drop("wins", "is_short")


def apply_transitions(stores: DataFrame, targets: DataFrame, as_of: str, reason="auto-evaluation") -> tuple[DataFrame, DataFrame]:
    """(next stores snapshot, log rows) for allowed status changes.

    ``targets`` has (id, target) and may bring its own ``reason`` column. Stores that become public get a slug.
    """
    why = F.col("reason") if "reason" in targets.columns else F.lit(reason)
    t = targets.select("id", "target", why.alias("reason"))
    now = F.lit(as_of).cast("timestamp_ntz")
    j = stores.join(t, "id", "left").withColumn("moves", can_transition(F.col("status"), F.col("target")))
    logs = j.filter("moves").select(
        F.col("id").alias("store_id"), F.lit("manual_review").alias("check_type"),
        F.to_json(F.struct(F.concat("status", F.lit(" → "), "target").alias("transition"), "reason")).alias("result"),
        now.alias("ts"),
    )
    validated = F.col("last_validated") if "last_validated" in stores.columns else F.lit(None).cast("timestamp_ntz")
    moved = j.withColumns({
        "status": F.when(F.col("moves"), F.col("target")).otherwise(F.col("status")),
        "last_validated": F.when(F.col("moves"), now).otherwise(validated),
    })
    return assign_slugs(moved, only=F.col("moves")).drop("target", "reason", "moves"), logs


def check_results(presences: DataFrame, stores: DataFrame, checks: DataFrame, limit: int | None = None) -> DataFrame:
    """Results of one health run: website presences of active and unresponsive stores with their fetched check."""
    live = stores.filter(F.col("status").isin("active", "unresponsive")).select(F.col("id").alias("store_id"))
    sites = presences.filter(F.col("channel_type") == "website").join(live, "store_id", "left_semi")
    if limit is not None:
        sites = sites.orderBy(F.length("id"), "id").limit(limit)
    results = checks.select(
        "presence_id", "status_code", check_status("status_code", "html", "error").alias("c"), "checked_at"
    )
    return sites.join(results, sites["id"] == results["presence_id"]).select(
        "presence_id", "store_id", "url", "checked_at", "status_code", "c.status", "c.reason"
    )


def result_logs(results: DataFrame) -> DataFrame:
    """The check results as log rows (they order after older logs by time)."""
    payload = F.to_json(F.struct("url", "status", F.col("status_code").alias("http_status"), F.col("reason").alias("error")))
    return results.select(
        "store_id", "presence_id", F.lit("http_check").alias("check_type"), payload.alias("result"),
        F.col("checked_at").alias("ts"),
    )


def update_presences(presences: DataFrame, results: DataFrame) -> DataFrame:
    """The next presences snapshot: checked rows take the new status, code and time."""
    new = results.select(
        F.col("presence_id").alias("id"), F.col("status").alias("new_status"), F.col("status_code").alias("new_code"),
        F.col("checked_at").alias("new_time"),
    )
    j = presences.join(new, "id", "left")
    checked = F.col("new_status").isNotNull()
    old_code = F.col("http_status") if "http_status" in presences.columns else F.lit(None).cast("int")
    return j.withColumns({
        "status": F.coalesce("new_status", "status"),
        "http_status": F.when(checked, F.col("new_code")).otherwise(old_code),
        "last_checked": F.when(checked, F.col("new_time")).otherwise(F.col("last_checked")),
    }).drop("new_status", "new_code", "new_time")


def health_run(stores: DataFrame, presences: DataFrame, logs: DataFrame, checks: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """One health run over fetched checks: all checks first, then every checked store is evaluated once.

    Gives the next ``stores`` and ``presences`` snapshots, the ``logs`` to append, and the ``targets`` that were applied.
    """
    results = cut(check_results(presences, stores, checks))  # read by four of the outputs
    next_presences = update_presences(presences, results)
    added = result_logs(results)
    seen = stores.join(results.select(F.col("store_id").alias("id")), "id", "left_semi")
    every = logs.unionByName(added, allowMissingColumns=True)
    targets = evaluate_status(seen, next_presences, every)
    next_stores, moves = apply_transitions(stores, targets.select("id", "target"), as_of)
    return {
        "stores": next_stores, "presences": next_presences, "targets": targets, "results": results,
        "logs": added.unionByName(moves, allowMissingColumns=True),
    }


def detect_closures(stores: DataFrame, presences: DataFrame, business: DataFrame) -> DataFrame:
    """Closure verdict of every unresponsive store: (id, google_checked, is_closed, reason).

    A business status other than OPERATIONAL closes (also a temporary one); else all presences dead closes.
    """
    waiting = stores.filter(F.col("status") == "unresponsive").select("id", "google_place_id")
    known = business.groupBy("google_place_id").agg(F.min("business_status").alias("business_status"))
    dead = all_dead(presences).select(F.col("store_id").alias("id"), F.lit(True).alias("dead"))
    j = waiting.join(known, "google_place_id", "left").join(dead, "id", "left")
    says_closed = F.col("business_status").isNotNull() & (F.col("business_status") != "OPERATIONAL")
    reason = (
        F.when(says_closed, F.concat(F.lit("google_business_status="), "business_status"))
        .when(F.col("dead"), "all_presences_dead")
    )
    return j.select(
        "id", tx.present(F.col("google_place_id")).alias("google_checked"), reason.isNotNull().alias("is_closed"),
        F.coalesce(reason, F.lit("no_closure_signals")).alias("reason"),
    )


def closure_report(verdicts: DataFrame) -> DataFrame:
    closed = F.col("is_closed")
    return verdicts.agg(
        F.count("*").alias("total_checked"), F.count_if("google_checked").alias("google_checked"),
        F.count_if(closed & F.col("reason").startswith("google_")).alias("google_closed"),
        F.count_if(F.col("reason") == "all_presences_dead").alias("all_dead"),
        F.count_if(closed).alias("confirmed_closures"), F.count_if(~closed).alias("still_unresponsive"),
    )


# --- history alerts ------------------------------------------------------------------------------------------

def previous_value(history: DataFrame, key: str, ts: str, value: str, tie: str, bucket: str = "month") -> DataFrame:
    """Adds ``previous``: the value before each row of its key, by (time, tie).

    Worked out within (key, month); the first row of a month takes the last value of the key's month before. A key
    with a very long history is so spread over tasks.
    """
    rows = history.withColumn("bucket", F.date_trunc(bucket, F.col(ts)))
    inside = Window.partitionBy(key, "bucket").orderBy(ts, tie)
    edges = rows.groupBy(key, "bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(ts, tie)).alias("last"))
    # One row per key and month.
    edges = edges.withColumn("before", F.lag("last").over(Window.partitionBy(key).orderBy("bucket"))).drop("last")
    mine = F.lag(F.struct(F.col(value).alias("v"))).over(inside)
    return rows.withColumn("mine", mine).join(edges, [key, "bucket"]).withColumn(
        "previous", F.coalesce("mine", "before")["v"]
    ).drop("mine", "before", "bucket")


def platform_changes(history: DataFrame, key: str = "store_id", ts: str = "last_checked", tie: str = "id") -> DataFrame:
    """Rows whose platform differs from the one seen before for the same key (both known)."""
    rows = previous_value(history, key, ts, "platform", tie)
    return rows.filter(F.col("previous").isNotNull() & F.col("platform").isNotNull() & (F.col("previous") != F.col("platform")))


# --- budgets, grid, claims -----------------------------------------------------------------------------------

def budget_gate(rows: DataFrame, flag: str, seq: str, budget: int, cost: int = 5) -> DataFrame:
    """Adds ``escalate``: flagged rows in run order, as long as the budget still covers one more.

    With one price per row that is the first ``budget // cost`` flagged rows; the cut is found by a distributed top-n.
    """
    cut = rows.filter(F.col(flag)).select(seq).orderBy(seq).limit(max(0, budget // cost)).agg(F.max(seq).alias("cut"))
    return rows.withColumn("escalate", F.coalesce(F.col(flag) & (F.col(seq) <= cut.scalar()), F.lit(False)))


def running_budget(rows: DataFrame, flag: str, seq: str, cost: str, budget: int) -> DataFrame:
    """Adds ``spent`` and ``escalate``: flagged rows in run order until the next one would go over the budget.

    Rows have costs of their own (null: 0, none negative). ``spent`` is the cost of the flagged rows up to the row. The rows
    are dealt by ranges of ``seq`` and written once; each range begins with the sum of the ranges before, one number each.
    Rows of one ``seq`` are paid for together. A null flag is not flagged; null turns come first.
    """
    price = F.when(F.col(flag), F.coalesce(F.col(cost), F.lit(0))).otherwise(F.lit(0)).cast("long")
    dealt = cut(rows.withColumn("__price", price).repartitionByRange(F.col(seq)).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(F.sum("__price").alias("__total"))
    before = totals.select(
        "__range", (F.sum("__total").over(Window.orderBy("__range")) - F.col("__total")).alias("__before")  # one row per range
    )
    inside = Window.partitionBy("__range").orderBy(seq)  # with ties, by value and not by row
    spent = F.col("__before") + F.sum("__price").over(inside)
    out = dealt.join(F.broadcast(before), "__range").withColumn("spent", spent)
    escalate = F.coalesce(F.col(flag), F.lit(False)) & (F.col("spent") <= budget)
    return out.withColumn("escalate", escalate).select(*rows.columns, "spent", "escalate")


def grid_coverage(points: DataFrame, shards: int = 1, grid=cat.GRID) -> DataFrame:
    """Cells of the search grid with their centre, shard and number of points; empty cells show 0."""
    step = grid["step"]
    rows = int((grid["lat_max"] - grid["lat_min"]) // step) + 1
    cols = int((grid["lng_max"] - grid["lng_min"]) // step) + 1
    cells = points.sparkSession.range(rows * cols).select(
        F.col("id").alias("cell"),
        (F.floor(F.col("id") / cols) * step + grid["lat_min"] + step / 2).alias("lat"),
        (F.col("id") % cols * step + grid["lng_min"] + step / 2).alias("lng"),
        (F.col("id") % shards).alias("shard"),
    )
    row = F.floor((F.col("latitude") - grid["lat_min"]) / step)
    col = F.floor((F.col("longitude") - grid["lng_min"]) / step)
    found = points.filter(row.between(0, rows - 1) & col.between(0, cols - 1)).groupBy((row * cols + col).alias("cell")).agg(
        F.count("*").alias("points")
    )
    return cells.join(found, "cell", "left").withColumn("points", F.coalesce("points", F.lit(0)))


def claim_gate(claims: DataFrame, new: DataFrame, stores: DataFrame) -> DataFrame:
    """Adds ``outcome`` to new claims: unknown_store, duplicate or accepted.

    A (store, email) pair with a pending claim, or one made within 24 hours, is a duplicate. An accepted claim is
    pending itself, so at most the earliest new claim of a pair is accepted.
    """
    past = claims.groupBy("store_id", "email").agg(
        F.bool_or(F.col("status") == "pending").alias("pending"), F.max("created_at").alias("newest")
    )
    known = stores.select(F.col("id").alias("store_id"), F.lit(True).alias("known"))
    j = new.join(past, ["store_id", "email"], "left").join(known, "store_id", "left")
    blocked = F.coalesce("pending", F.lit(False)) | F.coalesce(
        F.col("newest") > F.col("created_at") - F.expr("interval 24 hours"), F.lit(False)
    )
    j = j.withColumn("open", F.col("known").isNotNull() & ~blocked)
    first = j.filter("open").groupBy("store_id", "email").agg(
        F.min_by("event_id", F.struct("created_at", "event_id")).alias("event_id")
    ).select("event_id", F.lit(True).alias("first"))
    outcome = F.when(F.col("known").isNull(), "unknown_store").when(F.col("first"), "accepted").otherwise("duplicate")
    return j.join(first, "event_id", "left").withColumn("outcome", outcome).select(*new.columns, "outcome")
