"""Registered queries for the streaming jobs: the view is dropped as files, read as a stream to its end, and returned.

The check SQL is the one of the batch form.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeledger.plans import queries_resolve as qr
from placeledger.plans.queries_lifecycle import _failing
from placeledger.plans.registry import query
from placeledger.plans.views import AS_OF
from placeledger.session import checkpoint_dir, cut
from placeledger.streaming import jobs


#: Files of a drop; a drop of a real crawl has as many as its writers make.
_FILES = 4


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4()}"


def _as_stream(df: DataFrame, folder: str, order: str, files: int = 3) -> DataFrame:
    """``df`` written in ``order`` as drops of several files, one drop after the other, and read back about a drop per trigger."""
    cuts = [i / files for i in range(1, files)]
    turn = F.col(order).cast("timestamp").cast("double") if dict(df.dtypes)[order].startswith("timestamp") else F.col(order).cast("double")
    bounds = df.agg(F.percentile_approx(turn, cuts).alias("b")).select("b")
    number = sum(((turn > F.get(bounds.scalar(), F.lit(i))).cast("int") for i in range(len(cuts))), F.lit(0))
    numbered = cut(df.withColumn("drop_no", number))
    for drop in range(files):
        numbered.filter(F.col("drop_no") == drop).drop("drop_no").repartition(_FILES).write.mode("append").parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", _FILES).parquet(f"{folder}/in")


@query(_failing(3))
def stream_failures(d):
    folder = _folder(d.spark)
    logs = d.validation_logs.filter("check_type = 'http_check'")
    # One number that settles equal times the way the log order does.
    rank = F.col("seq") * 1000 + F.col("seq2")
    rows = logs.select("presence_id", F.get_json_object("result", "$.status").alias("status"), "ts", rank.alias("seq"))
    jobs.stream_failures(_as_stream(rows, folder, "ts"), f"{folder}/out", f"{folder}/state")
    return jobs.failing_now(d.spark.read.parquet(f"{folder}/out/changes"))


@query("""
SELECT s.id, CASE e.kind WHEN 'created' THEN 'premium' WHEN 'deleted' THEN 'claimed' ELSE s.premium_status END AS premium_status,
  strftime(CASE e.kind WHEN 'created' THEN e.created_at + INTERVAL 30 DAY WHEN 'deleted' THEN NULL ELSE s.premium_until END, '%Y-%m-%d') AS until
FROM stores s LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY created_at DESC, event_id DESC) AS r
                 FROM subscription_events WHERE kind <> 'payment_failed') WHERE r = 1) e ON e.store_id = s.id
""")
def stream_premium(d):
    folder = _folder(d.spark)
    events = d.subscription_events.withColumn("premium_until", F.col("created_at") + F.expr("interval 30 days"))
    # Dropped against their time order, so that old events arrive late.
    late = events.withColumn("turn", -F.unix_micros(F.col("created_at").cast("timestamp")))
    jobs.stream_premium(_as_stream(late, folder, "turn"), d.stores, f"{folder}/out", f"{folder}/state")
    after = jobs.apply_premium(d.stores, d.spark.read.parquet(f"{folder}/out/changes"))
    return after.select("id", "premium_status", F.date_format("premium_until", "yyyy-MM-dd").alias("until"))


@query("""
SELECT event_id, store_id, CASE WHEN kind = 'payment_failed' THEN 'payment_failed' ELSE 'store_not_found' END AS notice FROM subscription_events
WHERE kind = 'payment_failed' OR store_id NOT IN (SELECT id FROM stores)
""")
def premium_notices(d):
    folder = _folder(d.spark)
    events = d.subscription_events.withColumn("premium_until", F.col("created_at") + F.expr("interval 30 days"))
    jobs.stream_premium(_as_stream(events, folder, "created_at"), d.stores, f"{folder}/out", f"{folder}/state")
    return d.spark.read.parquet(f"{folder}/out/notices").select("event_id", "store_id", "notice")


# Greedy throttle in plain SQL: from each accepted claim, the next accepted is the first one at least a day later.
@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY store_id, email ORDER BY created_at, event_id) AS n FROM claims),
walk AS (
  SELECT store_id, email, n, event_id, created_at AS last, true AS ok FROM r WHERE n = 1
  UNION ALL
  SELECT r.store_id, r.email, r.n, r.event_id, CASE WHEN r.created_at - w.last >= INTERVAL 24 HOUR THEN r.created_at ELSE w.last END,
         r.created_at - w.last >= INTERVAL 24 HOUR
  FROM walk w JOIN r ON r.store_id = w.store_id AND r.email = w.email AND r.n = w.n + 1)
SELECT event_id, CASE WHEN ok THEN 'accepted' ELSE 'duplicate' END AS outcome FROM walk
""")
def stream_claims(d):
    """Claims come in drops dealt by hash, so that many arrive after claims that were made later."""
    folder = _folder(d.spark)
    rows = d.claims.select("event_id", "store_id", "email", "created_at", F.pmod(F.xxhash64("event_id"), F.lit(1000)).alias("turn"))
    out = jobs.stream_claims(_as_stream(rows, folder, "turn"), delay="60 days")
    jobs.run_available(out, f"{folder}/out", f"{folder}/state")
    return jobs.claim_verdicts(d.spark.read.schema(out.schema).parquet(f"{folder}/out")).select("event_id", "outcome")


@query()
def stream_ingest(d):
    """Two crawl drops, the locator and the places, one after the other."""
    folder = _folder(d.spark)
    jobs.start_directory(f"{folder}/dir", d.stores, d.store_categories, d.store_external_refs)
    raw = qr._crawl(d)
    drops = _as_stream(raw, folder, "seq", files=2)
    jobs.stream_ingest(drops, f"{folder}/dir", f"{folder}/state", AS_OF)
    return d.spark.read.parquet(f"{folder}/dir/outcomes").select("candidate_id", "source", "store_id", "tier", "outcome")
