"""Streaming forms of the check log, subscriptions, claims and crawl drops.

Each gives the result of the batch operator over the same rows. Outputs are written per epoch, so a replayed epoch
replaces its own files.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placeledger.operators import ingest as ig

FAILED = ("unreachable", "dead")
# State rows that the presences of a check stream share.
STATE_BUCKETS = 512


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write an append stream to parquet until all input that is there now is read."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


# --- check failures ------------------------------------------------------------------------------------------

def failure_changes(checks: DataFrame, n: int = 3, ttl_hours: int | None = None, buckets: int = STATE_BUCKETS) -> DataFrame:
    """(presence_id, change, failing, ts): a row whenever "the last ``n`` checks all failed" becomes true or false.

    ``checks`` has presence_id, status, ts and a tie column ``seq``. The state of a presence is its ``n`` newest outcomes by event
    time, so late checks take their right place. ``change`` counts the changes of a presence. Presences share ``buckets`` state rows
    by hash, since a call and a state row for each presence cost far more than its checks; only buckets with new checks are read
    and written. With ``ttl_hours`` the watermark is so much behind the newest check of all: older checks are not read any more, and
    presences whose newest check is older are forgotten.
    """
    timed = checks.filter(F.col("presence_id").isNotNull()).withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed if ttl_hours is None else timed.withWatermark("at", f"{ttl_hours} hours")
    rows = timed.select(
        F.pmod(F.xxhash64("presence_id"), F.lit(buckets)).cast("int").alias("bucket"), "presence_id", "at",
        F.unix_micros("at").alias("micros"), F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(F.col("status").isin(*FAILED), F.lit(False)).alias("bad"),
    )

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, touched = {}, set()  # presence: [failing, change, newest checks]
        if state.exists:
            names, was, changes, sizes, *checks_of = state.get
            flat = zip(*checks_of, strict=True)
            held = {p: [f, c, list(islice(flat, size))] for p, f, c, size in zip(names, was, changes, sizes, strict=True)}
        if not state.hasTimedOut:
            for f in frames:  # a frame is a bounded batch
                seen = f["presence_id"].tolist()
                for p, *check in zip(seen, f["micros"].tolist(), f["seq"].tolist(), f["bad"].tolist(), strict=True):
                    held.setdefault(p, [False, 0, []])[2].append(tuple(check))
                for p in set(seen):
                    held[p][2] = sorted(held[p][2])[-n:]
                touched.update(seen)
        out = []
        for p in touched:
            was, change, newest = held[p]
            failing = len(newest) == n and all(bad for _, _, bad in newest)
            if failing != was:
                held[p][:2] = failing, change + 1
                out.append((p, change + 1, failing, newest[-1][0]))
        if ttl_hours is not None:
            now = state.getCurrentWatermarkMs()
            held = {p: h for p, h in held.items() if h[2][-1][0] // 1000 + 1 >= now}
        if held:
            was, changes, lists = zip(*held.values(), strict=True)
            flat = [check for newest in lists for check in newest]
            state.update((list(held), list(was), list(changes), list(map(len, lists)), *map(list, zip(*flat, strict=True))))
            if ttl_hours is not None:
                state.setTimeoutTimestamp(max(min(newest[-1][0] for newest in lists) // 1000, now) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["presence_id", "change", "failing", "micros"])

    kind = dict(checks.dtypes)["presence_id"]
    out = rows.groupBy("bucket").applyInPandasWithState(
        update, f"presence_id {kind}, change bigint, failing boolean, micros bigint",
        f"names array<{kind}>, failing array<boolean>, changes array<bigint>, sizes array<int>, micros array<bigint>,"
        " seqs array<bigint>, bads array<boolean>", "append",
        GroupStateTimeout.NoTimeout if ttl_hours is None else GroupStateTimeout.EventTimeTimeout,
    )
    return out.select("presence_id", "change", "failing", F.timestamp_micros("micros").alias("ts"))


def stream_failures(checks: DataFrame, path: str, checkpoint: str, n: int = 3, ttl_hours: int | None = None) -> None:
    """Follow a check stream and append the changes under ``path``/changes."""
    run_available(failure_changes(checks, n, ttl_hours), f"{path}/changes", checkpoint)


def failing_now(changes: DataFrame) -> DataFrame:
    """Presences whose last change says failing."""
    last = changes.groupBy("presence_id").agg(F.max_by("failing", "change").alias("failing"))
    return last.filter("failing").select("presence_id")


# --- subscriptions -------------------------------------------------------------------------------------------

def premium_changes(events: DataFrame) -> DataFrame:
    """The last created or deleted event per store, as its premium state."""
    live = events.filter(F.col("kind").isin("created", "deleted"))
    last = live.groupBy("store_id").agg(
        F.max_by(F.struct("kind", "premium_until"), F.struct("created_at", "event_id")).alias("e"),
        F.max(F.struct("created_at", "event_id")).alias("at"),
    )
    made = F.col("e.kind") == "created"
    return last.select(
        "store_id", F.when(made, "premium").otherwise("claimed").alias("premium_status"),
        F.when(made, F.col("e.premium_until")).alias("premium_until"), "at",
    )


def apply_premium(stores: DataFrame, changes: DataFrame) -> DataFrame:
    """Stores with the newest premium state per store; an older event that came later does not count."""
    last = changes.groupBy(F.col("store_id").alias("id")).agg(
        F.max_by(F.struct("premium_status", "premium_until"), "at").alias("p")
    )
    j = stores.join(last, "id", "left")
    known = F.col("p").isNotNull()
    return j.withColumns({
        "premium_status": F.when(known, F.col("p.premium_status")).otherwise(F.col("premium_status")),
        "premium_until": F.when(known, F.col("p.premium_until")).otherwise(F.col("premium_until")),
    }).drop("p")


def stream_premium(events: DataFrame, stores: DataFrame, path: str, checkpoint: str) -> None:
    """Keep premium changes of a subscription stream as one small table per epoch under ``path``/changes.

    Events of unknown stores and failed payments go to ``path``/notices. Nothing is rewritten: an epoch adds the last
    state of the stores it saw, and ``apply_premium`` reads the newest.
    """
    known = stores.select(F.col("id").alias("store_id"))

    def keep(batch: DataFrame, epoch: int) -> None:
        seen = batch.join(known, "store_id", "left_semi")
        premium_changes(seen).write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")
        lost = batch.filter(F.col("kind").isin("created", "deleted")).join(known, "store_id", "left_anti").select(
            "event_id", "store_id", F.lit("store_not_found").alias("notice")
        )
        failed = batch.filter(F.col("kind") == "payment_failed").select("event_id", "store_id", F.lit("payment_failed").alias("notice"))
        lost.unionByName(failed).write.mode("overwrite").parquet(f"{path}/notices/epoch={epoch}")

    events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# --- claims --------------------------------------------------------------------------------------------------

def stream_claims(claims: DataFrame, hours: int = 24, delay: str = "7 days") -> DataFrame:
    """(event_id, store_id, email, outcome, revision): a claim is accepted when the last accepted one of its (store, email) is
    at least ``hours`` older, else it is a duplicate.

    Claims count by event time, whenever they arrive: a verdict is given at once, and if a claim that comes later but was made
    earlier changes it, it is given again with the next ``revision`` (see :func:`claim_verdicts`). Claims older than the
    watermark (``delay`` behind the newest) are dropped; what is older can't change any more, so a pair keeps its claims since the
    watermark and the time of the last accepted one before, and that for ``hours``. The pairs of a store share its state row, since
    a call and a row for each pair cost more than its claims.
    """
    room = hours * 3600 * 1_000_000
    rows = claims.select("store_id", "email", "event_id", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark(
        "created_at", delay).withColumn("micros", F.unix_micros("created_at"))
    columns = ["event_id", "store_id", "email", "outcome", "revision"]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pairs = {}  # email: (last accepted one that is settled, claims that are not)
        if state.exists:
            emails, lasts, sizes, *lists = state.get
            flat = zip(*lists, strict=True)
            pairs = {e: (last, list(islice(flat, size))) for e, last, size in zip(emails, lasts, sizes, strict=True)}
        if not state.hasTimedOut:
            for f in frames:
                for email, m, e in zip(f["email"].tolist(), f["micros"].tolist(), f["event_id"].tolist(), strict=True):
                    pairs.setdefault(email, (None, []))[1].append((m, e, False, 0))
        now, kept, turns, out = state.getCurrentWatermarkMs() * 1000, {}, [], []
        for email, (last, held) in pairs.items():
            accepted, judged = last, []
            for micros, event, was, revision in sorted(held):
                free = accepted is None or micros - accepted >= room
                if free:
                    accepted = micros
                if revision == 0 or free != was:
                    revision += 1
                    out.append((event, *key, email, "accepted" if free else "duplicate", revision))
                if micros < now:  # nothing older can come
                    last = accepted
                else:
                    judged.append((micros, event, free, revision))
            if last is not None and last + room <= now:
                last = None
            if last is not None or judged:
                kept[email] = last, judged
                turns.append(max(judged)[0] if judged else last + room)
        if kept:
            lasts, lists = zip(*kept.values(), strict=True)
            flat = [claim for judged in lists for claim in judged]
            state.update((list(kept), list(lasts), list(map(len, lists)), *(map(list, zip(*flat, strict=True)) if flat else ([], [], [], []))))
            state.setTimeoutTimestamp(max(min(turns), now) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return rows.groupBy("store_id").applyInPandasWithState(
        update, "event_id bigint, store_id string, email string, outcome string, revision int",
        "emails array<string>, lasts array<bigint>, sizes array<int>, micros array<bigint>, events array<bigint>,"
        " accepted array<boolean>, revisions array<int>", "append", GroupStateTimeout.EventTimeTimeout,
    )


def claim_verdicts(out: DataFrame) -> DataFrame:
    """The last verdict of each claim."""
    return out.groupBy("event_id", "store_id", "email").agg(F.max_by("outcome", "revision").alias("outcome"))


# --- crawl drops ---------------------------------------------------------------------------------------------

TABLES = ("stores", "categories", "refs")


def start_directory(path: str, stores: DataFrame, categories: DataFrame, refs: DataFrame) -> None:
    """Write the tables that the first crawl drop starts from."""
    for name, df in zip(TABLES, (stores, categories, refs), strict=True):
        df.write.mode("errorifexists").parquet(f"{path}/{name}/version=0")


def read_directory(spark: SparkSession, path: str, version: int) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}/version={version}") for name in TABLES}


def stream_ingest(raw: DataFrame, path: str, checkpoint: str, as_of: str) -> None:
    """Ingest each crawl drop of a stream of common records into the directory under ``path``.

    Epoch n reads version n and writes version n + 1 (with its outcomes), so a replayed epoch starts from the same tables.
    """
    def bring(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = read_directory(spark, path, epoch)
        out = ig.ingest(batch, now["stores"], now["refs"], now["categories"], as_of)
        for name in TABLES:
            out[name].write.mode("overwrite").parquet(f"{path}/{name}/version={epoch + 1}")
        out["outcomes"].write.mode("overwrite").parquet(f"{path}/outcomes/epoch={epoch}")

    raw.writeStream.foreachBatch(bring).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

