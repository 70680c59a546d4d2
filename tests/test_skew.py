"""A third of all rows share one key: results stay whole and equal to plain forms."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from placeledger.functions import geo
from placeledger.operators import audit as au
from placeledger.operators import lifecycle as lc
from placeledger.operators import near
from placeledger.operators import sets as st

N = 6000


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string"))
    return spark.range(N).select(
        "id", key.alias("key"), F.timestamp_seconds(F.col("id") * 7919 % N * 60).cast("timestamp_ntz").alias("ts"),
        (F.col("id") * 31 % 7).alias("v"),
    )


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_first_seen(rows):
    w = Window.partitionBy("key").orderBy("ts", "id")
    plain = rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    assert same(st.first_seen_dedup(rows, "key", ["ts", "id"]).select(*rows.columns), plain)


def test_last_checks(rows):
    logs = rows.select(
        F.col("key").alias("presence_id"), F.col("key").alias("store_id"), "ts", F.col("id").alias("seq"), F.lit("http_check").alias("check_type"),
        F.concat(F.lit('{"status": "'), F.when(F.col("v") < 5, "dead").otherwise("active"), F.lit('"}')).alias("result"),
    )
    last = logs.groupBy("presence_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("ts", "seq", "result")), asc=False), 1, 3).alias("l"))
    plain = last.filter((F.size("l") == 3) & F.forall("l", lambda x: F.contains(x["result"], F.lit("dead")))).select("presence_id")
    assert same(lc.consecutive_failures(logs), plain) and plain.count() > 50
    newest = logs.groupBy("store_id").agg(F.max(F.struct("ts", "seq")).alias("m")).select("store_id", "m.seq")
    assert same(au.latest_logs(logs, "http_check").select("store_id", "seq"), newest)


def test_slugs_are_unique(spark):
    stores = spark.range(N).select(
        F.format_string("%06x-0000", F.col("id")).alias("id"), F.when(F.col("id") % 3 == 0, "Hot Shop").otherwise(F.concat(F.lit("Shop "), F.col("id") % 900)).alias("name"),
        F.lit("Bend").alias("city"), F.lit("OR").alias("state"), F.lit("candidate").alias("status"),
        F.when(F.col("id") == 3, "hot-shop-bend-or").alias("slug"), F.timestamp_seconds(-F.col("id")).alias("first_seen"),
    )
    out = lc.assign_slugs(stores)
    assert out.count() == N and out.select("slug").distinct().count() == N and out.filter("slug IS NULL").isEmpty()
    assert out.filter("slug = 'hot-shop-bend-or'").first().id == "000003-0000"


def test_radius_join_in_one_cell(spark):
    """Grid join equals all pairs, with a third of the stores at nearly one place, near a pole and across the date line."""
    hot = F.col("id") % 3 == 0
    stores = spark.range(900).select(
        F.col("id").cast("string").alias("id"), F.lit("active").alias("status"), F.lit("x").alias("slug"), F.lit("W").alias("wpn_id"),
        F.when(hot, 34.0 + (F.col("id") % 90) / 1000).otherwise(F.col("id") * 37 % 1790 / 10 - 89.5).alias("latitude"),
        F.when(hot, -118.0).otherwise(F.col("id") * 53 % 3600 / 10 - 180).alias("longitude"),
    )
    refs = spark.createDataFrame([], "store_id string, provider string, payload string")
    points = spark.createDataFrame([(1, 34.05, -118.0), (2, 0.0, 0.0), (3, 60.0, 30.0), (4, -33.0, 151.0)], "point_id int, latitude double, longitude double")
    got = near.nearby_join(points, stores, refs, radius=200, limit=200).select("point_id", "id")
    dlat = 200 / geo.MILES_PER_DEGREE
    p = points.select("point_id", F.col("latitude").alias("a"), F.col("longitude").alias("b"))
    pairs = p.join(stores, F.abs(F.col("latitude") - F.col("a")) <= dlat).filter(
        F.abs(F.col("longitude") - F.col("b")) <= dlat / F.cos(F.radians("a"))
    ).withColumn("miles", geo.arc_miles(F.col("a"), F.col("b"), F.col("latitude"), F.col("longitude"))).filter("miles <= 200")
    w = Window.partitionBy("point_id").orderBy("miles", "id")
    plain = pairs.withColumn("r", F.row_number().over(w)).filter("r <= 200").select("point_id", "id")
    assert same(got, plain) and plain.count() >= 200


def test_radius_join_meets_positions(spark, monkeypatch):
    """Copies of a position meet once, with the first stores of it; dense places are answered by the narrow search, thin ones by the wide."""
    stores = spark.range(3000).select(
        F.col("id").cast("string").alias("id"), F.lit("active").alias("status"), F.lit("x").alias("slug"), F.lit("W").alias("wpn_id"),
        F.when(F.col("id") < 2400, 34.0 + F.col("id") % 12 / 50).otherwise(20.0 + F.col("id") % 600 / 60).alias("latitude"),
        F.when(F.col("id") < 2400, -118.0).otherwise(-100.0 + F.col("id") % 7).alias("longitude"),
    )
    refs = spark.createDataFrame([], "store_id string, provider string, payload string")
    points = spark.range(400).select(F.col("id").alias("point_id"), (20.0 + F.col("id") % 20).alias("latitude"), F.when(
        F.col("id") % 20 == 14, -118.0).otherwise(-98.0).alias("longitude"))
    met, real = [], near._nearest

    def watched(spots, held, *rest):
        met.append((spots.count(), held.groupBy("s_lat", "s_lng").count().agg(F.max("count")).first()[0]))
        return real(spots, held, *rest)

    monkeypatch.setattr(near, "_nearest", watched)
    got = near.nearby_join(points, stores, refs, radius=100, limit=9).select("point_id", "rank", "id")
    assert [n for n, _ in met] == [20, 19, 19] and max(m for _, m in met) == 9
    p = points.select("point_id", F.col("latitude").alias("a"), F.col("longitude").alias("b"))
    miles = geo.arc_miles(F.col("a"), F.col("b"), F.col("latitude"), F.col("longitude"))
    dlat = 100 / geo.MILES_PER_DEGREE
    pairs = p.crossJoin(stores).withColumn("miles", miles).filter("miles <= 100").filter(
        (F.abs(F.col("latitude") - F.col("a")) <= dlat) & (F.abs(F.col("longitude") - F.col("b")) <= dlat / F.cos(F.radians("a"))))
    w = Window.partitionBy("point_id").orderBy("miles", "id")
    plain = pairs.withColumn("rank", F.row_number().over(w)).filter("rank <= 9").select("point_id", "rank", "id")
    assert same(got, plain) and plain.count() > 400


def test_running_budget_is_the_loop(spark):
    made = [(None if i == 7 else i * 37 % 1000, None if i % 11 == 0 else i % 3 == 0, None if i % 13 == 0 else i * 7 % 10, "x") for i in range(1000)]
    made += [(500, True, 4, "tie")]
    table = spark.createDataFrame(made, "seq int, flag boolean, cost int, spent_on string").repartition(9)
    for budget in (-1, 0, 90, 10**6):
        want, total = {}, {}
        for seq, flag, cost, _ in made:
            total[seq] = total.get(seq, 0) + (cost or 0 if flag else 0)
        run = 0
        for seq in sorted(total, key=lambda k: -1 if k is None else k):
            run += total[seq]
            want[seq] = run
        got = lc.running_budget(table, "flag", "seq", "cost", budget).collect()
        expected = sorted((str(a), str(b), want[a], bool(b) and want[a] <= budget) for a, b, _, _ in made)
        assert sorted((str(r.seq), str(r.flag), r.spent, r.escalate) for r in got) == expected
    assert lc.running_budget(table.limit(0), "flag", "seq", "cost", 5).collect() == []


def test_look_up_moves_only_beginnings(spark):
    """Of a name's pieces only those that begin a fragment are moved."""
    from placeledger.operators import filters as fl

    stores = spark.createDataFrame(
        [(str(i), f"Dragon Cave {i:05d} of Many Long Words", "Bend", "or", "active") for i in range(300)]
        + [("x", "ab", "BEND", "OR", "active"), ("y", None, "Bend", "OR", "active"), ("z", "Dragon Cave", "Bend", "OR", "closed")],
        "id string, name string, city string, state string, status string")
    closing = spark.createDataFrame([("dragon cave 0001", "bend", "OR"), ("B", "Bend", "OR"), ("", "Bend", "OR"), ("Cave", "Salem", "OR")],
                                    "fragment string, city string, state string")
    got = fl.lookup_by_name_city(stores, closing)
    found = {(r.fragment, r.id) for r in got.collect()}
    names = [(str(i), f"dragon cave {i:05d} of many long words") for i in range(300)] + [("x", "ab")]
    assert found == {(f, i) for f in ("dragon cave 0001", "B", "") for i, n in names if f.lower() in n}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2
