"""Ingest of a small batch, row by row expected; and snapshots, slugs, claims, budgets."""

import datetime
import json
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeledger import schemas
from placeledger.operators import audit as au
from placeledger.operators import ingest as ig
from placeledger.operators import lifecycle as lc
from placeledger.operators import resolve as rs
from placeledger.operators import sets as st
from placeledger.sources import raw as rw

STORES = (
    "id string, name string, street string, city string, state string, zip_code string, latitude double, longitude double,"
    " phone string, wpn_id string, wpn_level string, google_place_id string, status string, discovery_source string, slug string,"
    " first_seen timestamp"
)
COMMON = ", ".join(f"{n} {k}" for n, k in schemas.RAW_COMMON)


def raw(spark, *rows):
    base = dict.fromkeys(n for n, _ in schemas.RAW_COMMON) | {"country": "US"}
    return spark.createDataFrame([tuple((base | r | {"seq": i}).values()) for i, r in enumerate(rows)], COMMON)


def known(spark):
    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([
        ("s1", "Dragon Den", "1 Main St", "Bend", "OR", "97701", None, None, None, None, None, None, "active", "wpn", None, t),
        ("s2", "Mox Shop", "2 Elm St", "Bend", "OR", "97702", 44.0, -121.0, "555", None, None, None, "closed", "wpn", None, t),
    ], STORES)


def run(spark, rows):
    refs = spark.createDataFrame(
        [("s2", "games_workshop", "GW2", None, datetime.datetime(2024, 1, 1))],
        "store_id string, provider string, external_id string, payload string, seen timestamp_ntz",
    )
    cats = spark.createDataFrame([("s1", "lgs")], "store_id string, category string")
    return ig.ingest(rows, known(spark), refs, cats, "2024-02-01 00:00:00")


def place(**more):
    return {"source": "games_workshop", "name": "X", "street": "9 Far Rd", "city": "Bend", "state": "OR", "zip_code": "97799"} | more


def test_ingest(spark):
    out = run(spark, raw(
        spark,
        place(external_id="a", name="Dragon Den LLC", street="7 New Rd", zip_code="97701", phone="111", latitude=44.1, longitude=-121.1),
        place(external_id="b", name="Dragon Den", street="8 New Rd", zip_code="97701", phone="222"),
        place(external_id="GW2", name="Renamed", zip_code="97703"),
        place(external_id="c", name="New Place", website="https://new.example.com"),
        place(external_id="c", name="New Place again", zip_code="97705", phone="333"),
        place(external_id="d", name="Bad", zip_code="x"),
        {"source": "google_places", "external_id": "G1", "google_place_id": "G1", "name": "Corner Liquor", "street": "1 A St", "city": "Bend", "state": "OR", "zip_code": "97701"},
        {"source": "wpn", "external_id": "W1", "wpn_id": "W1", "wpn_level": "core", "name": "Mox Shops", "street": "2 Elm Street", "city": "Bend", "state": "OR", "zip_code": "97709", "website": "https://wizards.com/w"},
    ))
    got = {r.seq: (r.outcome, r.tier) for r in out["outcomes"].collect()}
    assert got == {
        0: ("updated", "name_zip"), 1: ("skipped", "name_zip"), 2: ("skipped", "external_ref"), 3: ("inserted", "new"),
        4: ("updated", "external_ref"), 5: ("errors", "invalid_address"), 6: ("skipped", "filtered"), 7: ("updated", "address"),
    }
    stores = {r.name: r for r in out["stores"].collect()}
    assert stores["Dragon Den"].phone == "111" and stores["Dragon Den"].latitude == 44.1
    assert stores["Dragon Den"].slug == "dragon-den-bend-or"
    assert stores["Mox Shop"].wpn_id == "W1" and stores["Mox Shop"].slug is None and stores["Mox Shop"].phone == "555"
    new = stores["New Place"]
    assert (new.phone, new.status, new.discovery_source, new.slug) == ("333", "candidate", "games_workshop", "new-place-bend-or")
    assert {(r.store_id, r.url) for r in out["presences"].collect()} == {(new.id, "https://new.example.com")}
    assert {(r.store_id, r.category) for r in out["categories"].collect()} == {
        ("s1", "lgs"), ("s1", "hobby_miniatures"), ("s2", "hobby_miniatures"), ("s2", "lgs"), (new.id, "hobby_miniatures")}
    assert {r.external_id: r.store_id for r in out["refs"].collect()} == {"GW2": "s2", "a": "s1", "b": "s1", "c": new.id}
    r = out["report"].first()
    assert (r.total, r.inserted, r.updated, r.skipped, r.errors, r.needs_review) == (8, 1, 3, 3, 1, 0)


RECORDS = {
    "wpn": {"id": "W1", "name": "Mox Shop", "postalAddress": "2 Elm St, Bend, OR, 97702, US"},
    "google_places": {"id": "P1", "displayName": {"text": "Mox Shop"}, "formattedAddress": "2 Elm St, Bend, OR 97702, USA"},
    "games_workshop": {"objectID": "GW7", "name": "Mox Shop", "addressLine1": "2 Elm St", "city": "Bend", "region": "OR", "postalCode": "97702", "countryCode": "US"},
    "vertical": {"source_id": "V1", "source": "comicbookstores", "name": "Mox Shop", "street": "2 Elm St", "city": "Bend", "state": "OR", "zip_code": "97702"},
}


def test_sources_without_turns(spark, tmp_path):
    """Files of every source: a record that names a known store finds it, equal new ones make one store, whatever their turns."""
    numbered, hashed = [], []
    for k, (source, record) in enumerate(RECORDS.items()):
        new = json.loads(json.dumps(record).replace("Mox Shop", "New Place").replace("2 Elm", f"{k} Oak").replace("97702", f"9778{k}"))
        new["id" if source in ("wpn", "google_places") else "objectID" if source == "games_workshop" else "source_id"] = f"N{k}"
        (tmp_path / source).mkdir()
        for name, records in (("b.json", [new, new, record]), ("a.json", [record])):
            (tmp_path / source / name).write_text(json.dumps(records))
        rows = rw.load_source(spark, str(tmp_path / source), source)
        assert [(r.seq, r.name) for r in rows.orderBy("seq").collect()] == [(0, "Mox Shop"), (1, "New Place"), (2, "New Place"), (3, "Mox Shop")]
        numbered.append(rows.withColumn("seq", F.col("seq") + 10 * k))
        hashed.append(rw.PARSERS[source](rw.read_raw(spark, str(tmp_path / source), source)))
    out = run(spark, reduce(DataFrame.unionByName, numbered))
    got = {r.seq: (r.outcome, r.store_id, r.tier) for r in out["outcomes"].collect()}
    for k in range(4):
        made = got[10 * k + 1][1]
        assert got[10 * k][1] == got[10 * k + 3][1] == "s2" and got[10 * k + 1][0] == "inserted" and got[10 * k + 2][:2] == ("skipped", made)
    assert out["stores"].count() == 6
    # By hash of the record: never before the known stores, and equal records are one. A negative turn is a turn.
    plain = reduce(DataFrame.unionByName, hashed)
    assert plain.filter("seq < 0").isEmpty()
    out = run(spark, plain.withColumn("seq", F.when(F.col("source") == "wpn", -F.col("seq")).otherwise(F.col("seq"))))
    tiers = [r.tier for r in out["outcomes"].collect()]
    assert tiers.count("repeated") == 8 and tiers.count("new") == 4 and out["stores"].count() == 6
    report = out["report"].first()
    assert (report.total, report.inserted, report.errors) == (16, 4, 0)


def test_number_records(spark, tmp_path):
    for name, n in (("c", 40), ("a", 7), ("b", 300)):
        (tmp_path / f"{name}.json").write_text("".join(json.dumps({"id": f"{name}{i}", "name": "x" * 30}) + "\n" for i in range(n)))
    want = [f"{name}{i}" for name, n in (("a", 7), ("b", 300), ("c", 40)) for i in range(n)]
    for size in ("2k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = rw.number_records(rw.read_raw(spark, str(tmp_path), "wpn", multiline=False)).collect()
        assert [r.id for r in sorted(rows, key=lambda r: r.seq)] == want and sorted(r.seq for r in rows) == list(range(347))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tiers(spark):
    cand = "candidate_id string, seq long, name string, street string, city string, state string, zip_code string, latitude double, longitude double, wpn_id string, google_place_id string"
    far = spark.createDataFrame([("c", 1, "Mox Shopp", "9 Far Rd", "Bend", "OR", "97702", 46.0, -121.0, None, None)], cand)
    near = far.withColumn("latitude", F.lit(44.003))
    assert rs.match_fuzzy_geo(far, known(spark)).count() == 0
    hit = rs.match_fuzzy_geo(near, known(spark)).first()
    assert hit.store_id == "s2" and hit.confidence == 0.94 and hit.needs_review is False
    none = spark.createDataFrame([], STORES)
    assert rs.resolve_candidates(near, none).first().tier == "new"


def test_transitions(spark):
    pairs = spark.createDataFrame([("candidate", "verified"), ("candidate", "active"), ("closed", "active"), ("active", "closed")], "a string, b string")
    assert [r[0] for r in pairs.select(lc.can_transition(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]
    after, logs = lc.apply_transitions(known(spark), spark.createDataFrame([("s1", "unresponsive"), ("s2", "active")], "id string, target string"), "2024-02-01 00:00:00")
    assert {r.id: r.status for r in after.collect()} == {"s1": "unresponsive", "s2": "closed"}
    assert [r.store_id for r in logs.collect()] == ["s1"]


def test_plan_guard(spark):
    plan = spark.createDataFrame([("s1", "suppress_from_public", "unresponsive", "why"), ("gone", "suppress_from_public", "unresponsive", "why")],
                                 "id string, plan_action string, target_status string, plan_reason string")
    with pytest.raises(ValueError, match="max_apply"):
        au.plan_outcomes(known(spark), plan, max_apply=1)
    out = au.plan_outcomes(known(spark), plan, max_apply=2)
    assert {r.id: r.outcome for r in out.collect()} == {"s1": "suppress_from_public", "gone": "missing"}
    log = au.outcome_logs(out, "2024-02-01 00:00:00", "cleanup").first()
    assert "active -> unresponsive" in log.result
    closing = au.plan_outcomes(known(spark), au.closing_plan(known(spark), " gone "), only=("mark_closed",))
    assert {r.id: r.status for r in au.apply_outcomes(known(spark), closing).collect()} == {"s1": "closed", "s2": "closed"}


def test_conformance_finds_each_rule(spark):
    bad = known(spark).withColumn("status", F.lit("weird")).withColumn("state", F.lit("Oregon")).withColumn("slug", F.lit("same"))
    p = spark.createDataFrame([("p1", "nobody", "pigeon", None, "gone", None)],
                              "id string, store_id string, channel_type string, platform string, status string, estimated_inventory_size string")
    refs = spark.createDataFrame([("s1", "x", "1"), ("s1", "x", "1")], "store_id string, provider string, external_id string")
    cats = spark.createDataFrame([("s1", "lgs"), ("s1", "lgs"), ("s1", "odd")], "store_id string, category string")
    logs = spark.createDataFrame([("s9", "guess")], "store_id string, check_type string")
    got = {r.rule: r.violations for r in au.conformance(bad, p, refs, cats, logs).collect()}
    assert got == {
        "store_status": 2, "address": 2, "unique_slug": 1, "channel_type": 1, "presence_status": 1, "presence_store": 1,
        "unique_external_ref": 1, "category": 1, "unique_store_category": 1, "check_type": 1, "log_store": 1,
    }


def test_budget(spark):
    rows = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "seq long, unsure boolean")
    cut = lambda cents: sorted(r.seq for r in lc.budget_gate(rows, "unsure", "seq", cents).filter("escalate").collect())
    assert cut(12) == [0, 2] and cut(4) == [] and cut(1000) == [0, 2, 4, 6, 8]


def test_previous_value_over_months(spark):
    """Two-level lag equals a plain one, also for a key with nearly all rows."""
    from pyspark.sql import Window

    rows = spark.range(4000).select(
        F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(99).alias("key"), F.col("id").alias("tie"),
        F.timestamp_seconds((F.col("id") * 7919 % 4000) * 20000 + 1700000000).alias("ts"),
        F.when(F.col("id") % 5 != 0, F.md5(F.col("id").cast("string"))).alias("v"),
    )
    plain = rows.withColumn("previous", F.lag("v").over(Window.partitionBy("key").orderBy("ts", "tie")))
    got = lc.previous_value(rows, "key", "ts", "v", "tie").select(*plain.columns)
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_recrawl_and_categories(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "id string, k string")
    new = spark.createDataFrame([("b",), ("c",), ("c",), ("",)], "k string")
    assert {(r.k, r.status) for r in st.recrawl_diff(old, new, "k").collect()} == {("a", "delisted"), ("b", "unchanged"), ("c", "new")}
    assert "delisted" not in {r.status for r in st.recrawl_diff(old, new, "k", complete=False).collect()}
    held = spark.createDataFrame([("1", "lgs")], "store_id string, category string")
    more = spark.createDataFrame([("1", "lgs"), ("1", "comic_shop"), ("1", "comic_shop"), ("1", "nonsense")], "store_id string, category string")
    assert [(r.store_id, r.category) for r in st.new_categories(held, more).collect()] == [("1", "comic_shop")]
    assert [r.category for r in st.reject_categories(more).collect()] == ["nonsense"]


def test_raw_files(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        rw.read_raw(spark, str(tmp_path / "none"), "wpn").count()
    (tmp_path / "good.json").write_text('[{"id": "1", "name": "A", "postalAddress": "x", "isPremium": true}]')
    assert rw.read_raw(spark, str(tmp_path / "good.json"), "wpn").first().isPremium is True
    (tmp_path / "bad.json").write_text('[{"id": "1", "isPremium": "maybe"}]')
    with pytest.raises(Exception):  # noqa: B017
        rw.read_raw(spark, str(tmp_path / "bad.json"), "wpn").collect()


def test_search_export_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Top pages,Impressions\n/store/x,\"1,234\"\n,5\n")
    (tmp_path / "b.csv").write_text("Page,URL,Clicks\n,https://a.example.com/store/y,3\n")
    got = {(r.page, r.n) for r in rw.read_search_export(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).select(
        "page", au.int_text("impressions").alias("n")).collect()}
    assert got == {("/store/x", 1234), ("https://a.example.com/store/y", 0)}


def test_dossier_files(spark, tmp_path):
    (tmp_path / "1.json").write_text('{\n "store_id": "s1", "confidence": 0.7,\n "products": ["mtg"], "pages_fetched": ["u"], "has_events": true}')
    (tmp_path / "2.json").write_text('{"store_id": "s2", "pages_fetched": ["u"]}')
    got = {r.store_id: (r.action, r.confidence, r.products) for r in rw.read_dossiers(spark, str(tmp_path)).collect()}
    assert got == {"s1": ("auto_apply", "0.70", "mtg"), "s2": ("not_lgs_or_manual_review", "0.00", "")}


def test_rows_of_one_file_are_dealt_to_all_cores(spark):
    from placeledger.session import deal

    out = deal(spark.range(0, 800, 1, 1))
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in out.collect()) == list(range(800))
