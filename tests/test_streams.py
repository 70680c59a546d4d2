"""Keyed stream state against plain Python: late, shuffled and repeated drops."""

import datetime
import random

from pyspark.sql import functions as F

from placeledger.streaming import jobs

START = datetime.datetime(2024, 1, 1)


def drops(spark, folder, parts, schema):
    """Each part as one file, read a file per trigger in the order of writing."""
    import os
    import time

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not name.startswith("drop"):
                os.rename(f"{folder}/{name}", f"{folder}/drop{k}.parquet")
                os.utime(f"{folder}/drop{k}.parquet", (time.time() + k - 100,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_failures_follow_event_time(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(9)}", rng.choice(["dead", "unreachable", "dead", "dead", "dead", "active", None]), START + datetime.timedelta(hours=rng.randrange(40)), i) for i in range(160)]
    rows += [("short", "dead", START, 1), ("short", "dead", START, 2), (None, "dead", START, 3)]
    parts = [rows[k::5] for k in range(5)]
    schema = "presence_id string, status string, ts timestamp, seq long"
    jobs.stream_failures(drops(spark, tmp_path / "in", parts, schema), str(tmp_path / "out"), str(tmp_path / "state"), ttl_hours=100)
    changes = spark.read.parquet(str(tmp_path / "out" / "changes"))
    seen, was, want = {}, {}, set()
    for part in parts:
        for p, status, ts, seq in part:
            if p:
                seen.setdefault(p, []).append((ts, seq, status in ("dead", "unreachable")))
        for p, checks in seen.items():
            last = sorted(checks)[-3:]
            failing = len(last) == 3 and all(bad for *_, bad in last)
            if failing != was.get(p, (False, 0))[0]:
                was[p] = (failing, was.get(p, (False, 0))[1] + 1)
                want.add((p, was[p][1], failing, last[-1][0]))
    assert {tuple(r) for r in changes.collect()} == want and len(want) > 6
    assert {r.presence_id for r in jobs.failing_now(changes).collect()} == {p for p, (failing, _) in was.items() if failing}


def test_failures_share_state_rows(spark, tmp_path):
    """State rows and calls are bounded by the buckets, not by the presences; a presence past the watermark is forgotten."""
    first = [(f"p{i}", "dead", START + datetime.timedelta(hours=h), h) for i in range(1500) for h in range(3)]
    second = [(f"p{i}", "active" if i % 2 else "dead", START + datetime.timedelta(hours=300), 9) for i in range(700)]
    last = [("p0", "dead", START + datetime.timedelta(hours=600), 10), ("p1400", "dead", START, 11)]
    schema = "presence_id string, status string, ts timestamp, seq long"
    jobs.stream_failures(drops(spark, tmp_path / "in", [first, second, last], schema), str(tmp_path / "out"), str(tmp_path / "state"), ttl_hours=100)
    changes = spark.read.parquet(str(tmp_path / "out" / "changes"))
    assert {r.presence_id for r in jobs.failing_now(changes).collect()} == {f"p{i}" for i in range(1500) if i >= 700 or i % 2 == 0}
    held = spark.read.format("statestore").load(str(tmp_path / "state"))
    assert held.count() == 1
    jobs.stream_failures(drops(spark, tmp_path / "in2", [first], schema), str(tmp_path / "out2"), str(tmp_path / "state2"))
    kept = spark.read.format("statestore").load(str(tmp_path / "state2"))
    assert kept.count() <= jobs.STATE_BUCKETS
    assert kept.select(F.explode("value.groupState.names")).count() == 1500


def throttle(rows):
    out, last = {}, {}
    for event, store, email, at in sorted(rows, key=lambda r: (r[3], r[0])):
        key = store, email
        free = key not in last or at - last[key] >= datetime.timedelta(hours=24)
        if free:
            last[key] = at
        out[event] = "accepted" if free else "duplicate"
    return out


def test_claims_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"s{rng.randrange(4)}", rng.choice(["a@x", "b@x"]), START + datetime.timedelta(hours=rng.randrange(24 * 20))) for i in range(200)]
    parts = [rows[k::4] for k in range(4)]
    schema = "event_id long, store_id string, email string, created_at timestamp"
    out = jobs.stream_claims(drops(spark, tmp_path / "in", parts, schema), delay="30 days")
    jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("revision > 1").count() > 10
    assert {r.event_id: r.outcome for r in jobs.claim_verdicts(got).collect()} == throttle(rows)


def test_claims_of_a_store_share_a_state_row(spark, tmp_path):
    rows = [(i, f"s{i % 5}", None if i % 7 == 0 else f"{i % 7}@x", START + datetime.timedelta(hours=i * 13 % 500)) for i in range(300)]
    schema = "event_id long, store_id string, email string, created_at timestamp"
    out = jobs.stream_claims(drops(spark, tmp_path / "in", [rows[::2], rows[1::2]], schema), delay="30 days")
    jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r.event_id: r.outcome for r in jobs.claim_verdicts(spark.read.parquet(str(tmp_path / "out"))).collect()} == throttle(rows)
    assert spark.read.format("statestore").load(str(tmp_path / "state")).count() == 5


def test_claims_forget_what_is_settled(spark, tmp_path):
    """With a short delay, drops by day: late claims within the delay count, older ones are dropped, and state stays small."""
    rng = random.Random(5)
    parts, event = [], 0
    for day in range(12):
        rows = []
        for _ in range(30):
            event += 1
            rows.append((event, f"s{rng.randrange(3)}", "a@x", START + datetime.timedelta(hours=day * 24 + rng.randrange(-20, 24))))
        parts.append(rows)
    parts.append([(9000, "s0", "a@x", START + datetime.timedelta(days=40)), (9001, "s0", "a@x", START + datetime.timedelta(days=40, hours=1))])
    parts.append([(9002, "s1", "a@x", START), (9003, "s0", "a@x", START + datetime.timedelta(days=41))])
    schema = "event_id long, store_id string, email string, created_at timestamp"
    out = jobs.stream_claims(drops(spark, tmp_path / "in", parts, schema), delay="3 days")
    jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.event_id: r.outcome for r in jobs.claim_verdicts(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = throttle([r for p in parts for r in p if r[0] != 9002])
    assert got == want
    held = spark.read.format("statestore").load(str(tmp_path / "state")).select(F.col("key.store_id")).collect()
    assert {r[0] for r in held} <= {"s0"}
