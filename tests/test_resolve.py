"""Entity resolution against a plain sequential brute force on small random batches."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from placeledger import catalogs as cat
from placeledger.operators import resolve as rs

STORE = (
    "id string, first_seen timestamp, name string, street string, city string, state string, zip_code string,"
    " latitude double, longitude double, wpn_id string, google_place_id string"
)
CAND = (
    "candidate_id string, seq long, name string, street string, city string, state string, zip_code string,"
    " latitude double, longitude double, wpn_id string, google_place_id string, provider string, external_id string"
)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 100 if not a and not b else round(200 * lcs(a, b) / (len(a) + len(b)))


def norm_name(n):
    words = r"\b(?:" + "|".join(cat.NAME_SUFFIX_WORDS) + r")\b"
    return " ".join(re.sub(words, "", re.sub(r"[^\w\s]", " ", n.upper())).split())


def norm_street(s):
    bare = re.sub(cat.SUITE_PATTERN, "", re.sub(r"[^\w\s]", " ", s.upper()), flags=re.I)
    return " ".join(cat.STREET_WORDS.get(w, w) for w in bare.split())


def miles(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * cat.EARTH_RADIUS_MILES * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def one_by_one(cands, stores, refs):
    """candidate_id -> (store_id, tier, score), taking candidates strictly in turn."""
    held = [dict(s) for s in sorted(stores, key=lambda s: (s["first_seen"], s["id"]))]
    refs, out = dict(refs), {}

    def find(c):
        n, st, z = norm_name(c["name"]), norm_street(c["street"]), c["zip_code"]
        for tier, key in (("google_place_id", "google_place_id"), ("wpn_id", "wpn_id")):
            for s in held:
                if c[key] and s[key] == c[key]:
                    return s, tier, None
        for s in held:
            if norm_name(s["name"]) == n and s["zip_code"] == z:
                return s, "name_zip", None
        for s in held:
            if st and norm_street(s["street"]) == st and s["city"] == c["city"] and s["state"] == c["state"]:
                return s, "address", None
        for s in held:
            r = ratio(n, norm_name(s["name"]))
            if r < 85:
                continue
            both = None not in (c["latitude"], c["longitude"], s["latitude"], s["longitude"])
            if miles(c["latitude"], c["longitude"], s["latitude"], s["longitude"]) <= 0.5 if both else z == s["zip_code"]:
                return s, "fuzzy", r
        return None, "new", None

    for c in sorted(cands, key=lambda c: c["seq"]):
        ref = (c["provider"], c["external_id"])
        known = next((s for s in held if s["id"] == refs.get(ref)), None) if c["external_id"] else None
        s, tier, score = (known, "external_ref", None) if known else find(c)
        if s is None:
            s = {k: c.get(k) for k in held[0]} | {"id": "new:" + c["candidate_id"]}
            held.append(s)
        else:
            for k in ("latitude", "longitude"):
                if s[k] is None:
                    s[k] = c[k]
            for k in ("wpn_id", "google_place_id"):
                if not s[k] and c[k]:
                    s[k] = c[k]
        if c["external_id"]:
            refs[ref] = s["id"]
        out[c["candidate_id"]] = (s["id"], tier, score)
    return out


def random_batch(rng, n_stores, n_cands):
    names = ["Dragon Den", "Dragon's Den", "Dragn Den", "Dragon Dens", "Games", "Comics LLC", "Mox Hobby", "Moxx", "Card Kingdom 7",
             "Card Kingdoms 7", "Kards Kingdom 7", "Ye Olde Shoppe", "Ye Old Shoppe", "Zq", "Qz", "A", "Pokémon Hut", "Pokemon Hut"]
    streets = ["1 Main St", "1 Main Street", "22 NW Oak Ave Suite 4", "22 NW Oak Ave", "Suite 9", "7 Elm Rd.", "9 Pine Ct"]

    def place():
        if rng.random() < 0.35:
            return None, None
        spot = (45.0 + rng.randrange(4) * 0.004, -120.0 + rng.randrange(4) * 0.005)
        return (spot[0], None) if rng.random() < 0.1 else spot

    def row():
        lat, lng = place()
        return {
            "name": rng.choice(names), "street": rng.choice(streets) if rng.random() < 0.4 else f"{rng.randrange(999)} Far Rd",
            "city": rng.choice(["Salem", "Bend"]), "state": "OR", "zip_code": rng.choice(["97001", "97002", "97003"]),
            "latitude": lat, "longitude": lng, "wpn_id": rng.choice([None, "", "W1", "W2", "W3", "W4"]) if rng.random() < 0.3 else None,
            "google_place_id": rng.choice(["G1", "G2", "G3", "G4"]) if rng.random() < 0.2 else None,
        }

    start = datetime.datetime(2024, 1, 1)
    stores = [row() | {"id": f"s{i}", "first_seen": start + datetime.timedelta(hours=rng.randrange(50))} for i in range(n_stores)]
    cands = [row() | {"candidate_id": f"c{i}", "seq": i * 3 + 5, "provider": "p",
                      "external_id": rng.choice(["e1", "e2", "e3", "e4", "gone"]) if rng.random() < 0.25 else None} for i in range(n_cands)]
    refs = [(("p", "e1"), "s0"), (("p", "gone"), "s999")]
    return stores, cands, refs


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(",")) for r in rows], schema)


def resolved(spark, cands, stores, refs=(), **options):
    """candidate_id -> (store_id, tier, score), new stores named after their candidate."""
    ref_frame = spark.createDataFrame([(p, e, s) for (p, e), s in refs], "provider string, external_id string, store_id string")
    c = frame(spark, cands, CAND)
    got = rs.resolve_candidates(c, frame(spark, stores, STORE), ref_frame, **options).collect()
    ids = {r["i"]: "new:" + r["c"] for r in c.select(rs.new_store_id(F.col("candidate_id")).alias("i"), F.col("candidate_id").alias("c")).collect()}
    return {r["candidate_id"]: (ids.get(r["store_id"], r["store_id"]), r["tier"],
                                round(r["confidence"] * 100) if r["tier"] == "fuzzy" else None) for r in got}


# Components of more than ``settle_rows`` rows are settled by joins; 0 sends all that way.
@pytest.mark.parametrize(("seed", "size", "settle_rows"), [(1, 60, 2000), (8, 60, 2000), (3, 30, 0)])
def test_same_as_one_by_one(spark, seed, size, settle_rows):
    rng = random.Random(seed)
    stores, cands, refs = random_batch(rng, 14, size)
    want = one_by_one(cands, stores, refs)
    assert len({v[1] for v in want.values()}) >= 6
    assert resolved(spark, cands, stores, refs, settle_rows=settle_rows) == want


def _row(**more):
    base = {f.split()[0]: None for f in CAND.split(",")} | {"street": "1 Far Rd", "city": "Bend", "state": "OR", "zip_code": "97001"}
    return base | more


def test_chain_takes_few_rounds(spark, monkeypatch):
    """Fifty candidates, each like its neighbours: as one by one, in rounds by the logarithm, and no table is left but the result."""
    import os

    from placeledger.operators import graph
    from placeledger.session import checkpoint_dir

    rng = random.Random(2)
    letters = "".join(rng.choice("BCDFGHJKLMNPQRSTVWXZ") for _ in range(140))
    cands = [_row(candidate_id=f"c{i}", seq=i, name=letters[2 * i : 2 * i + 20], street=f"{i} Far Rd") for i in range(50)]
    store = {f.split()[0]: None for f in STORE.split(",")} | {"id": "s0", "first_seen": datetime.datetime(2024, 1, 1), "name": "Elsewhere", "street": "9 X", "city": "Salem", "state": "OR", "zip_code": "97009"}
    rounds = []
    monkeypatch.setattr(graph, "_small_star", lambda links, real=graph._small_star: rounds.append(1) or real(links))
    folder = checkpoint_dir(spark)
    before = set(os.listdir(folder))
    want = one_by_one(cands, [store], [])
    assert resolved(spark, cands, [store]) == want
    assert [v[1] for v in want.values()] == ["new", "fuzzy"] * 25
    assert len(rounds) <= 12
    assert len({x for x in os.listdir(folder) if x.startswith("cut-")} - before) == 1


def test_positions_join_components(spark):
    """A store that gets its position from a match is found by a candidate of another ZIP there, and not before."""
    t = datetime.datetime(2024, 1, 1)
    store = {f.split()[0]: None for f in STORE.split(",")} | {"id": "s0", "first_seen": t, "name": "Dragon Castle Den", "street": "9 X St", "city": "Salem", "state": "OR", "zip_code": "97009"}
    spot = {"latitude": 45.0, "longitude": -120.0, "zip_code": "97002"}
    cands = [
        _row(candidate_id="early", seq=1, name="Dragon Castle Denn", street="1 A Rd", **spot),
        _row(candidate_id="giver", seq=2, name="Dragon Castle Den", street="2 B Rd", zip_code="97009", latitude=45.001, longitude=-120.0),
        _row(candidate_id="late", seq=3, name="Dragon Castles Den", street="3 C Rd", **spot),
        _row(candidate_id="far", seq=4, name="Dragon Castles Den", street="4 D Rd", zip_code="97003", latitude=46.0, longitude=-120.0),
    ]
    want = one_by_one(cands, [store], [])
    assert resolved(spark, cands, [store]) == want
    assert want["late"][0] == "s0" and want["early"][0] != "s0"


def test_components(spark):
    from placeledger.operators.graph import components

    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 300)] + [(5, 7000 + i) for i in range(300)] + [(-9, -3), (42, 42)] + [(rng.randrange(9000, 9200), rng.randrange(9000, 9200)) for _ in range(150)]
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        group[y] = x
    want = {n: find(n) for pair in links for n in pair if pair[0] != pair[1]}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ratio_is_lcs_based():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("ABC ") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("ABC ") for _ in range(rng.randrange(12)))
        assert rs.indel_ratio(a, b) == ratio(a, b)
    assert rs.indel_ratio("", "") == 100 and rs.indel_ratio("", "A") == 0


def test_similar_names_finds_every_pair(spark):
    """The signature filter loses no pair: all pairs of a block are checked."""
    rng = random.Random(9)
    words = ["RED DRAGON", "BLUE MOX", "KNIGHT", "CASTLE", "ZQ", "é"]
    names = set()
    while len(names) < 140:
        base = list(rng.choice(words) + " " + rng.choice(words) + rng.choice(["", " 12", " 123"]))
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(base))
            base[i:i + 1] = rng.choice([[], [rng.choice("ABXZ9 ")], [base[i], rng.choice("EQ7")]])
        names.add("".join(base).strip())
    names |= {"", "A", "AB", "BA", "ABC", "ABCD"}
    rows = spark.createDataFrame([("b", n) for n in names], "block string, name string")
    got = {(r.l_name, r.r_name, r.score) for r in rs.similar_names(rows, rows).collect()}
    want = {(a, b, ratio(a, b)) for a in names for b in names if ratio(a, b) >= 85}
    assert len(want) > len(names) + 50
    assert got == want


@pytest.mark.parametrize("few", [0, 10**6])
def test_linking_names_link_the_same(spark, monkeypatch, few):
    """Fewer pairs than all similar ones, but the same names hang together; names of one side only meet through the other."""
    rng = random.Random(11)
    words = ["RED DRAGON", "BLUE MOX", "KNIGHT", "ZQ"]
    sides = []
    for _ in range(2):
        names = {(b, f"{rng.choice(words)} {rng.choice(words)} {rng.randrange(10**n):0{n}d}") for b in "xy" for n in (2, 4, 6) for _ in range(40)}
        sides.append(sorted(names | {("x", ""), ("y", "A"), ("x", "AB"), ("z", "ALONE HERE")}))
    sides[1].remove(("z", "ALONE HERE"))

    def groups(pairs):
        group = {}

        def find(x):
            while group.setdefault(x, x) != x:
                x = group[x]
            return x

        for block, a, b in pairs:
            low, high = sorted((find((block, a)), find((block, b))))
            group[high] = low
        return {x: find(x) for x in group}

    monkeypatch.setattr(rs, "ALL_PAIRS", few)
    left, right = (spark.createDataFrame(s, "block string, name string") for s in sides)
    want = {(b, x, y) for b, x in sides[0] for c, y in sides[1] if b == c and ratio(x, y) >= 85}
    got = [tuple(r) for r in rs.linking_names(left, right, 85).collect()]
    assert set(got) <= want and groups(got) == groups(want)
    assert len(set(groups(want).values())) > 20
    assert len(got) < len(want) if few == 0 else set(got) == want


def test_links_of_similar_names_stay_linear(spark, monkeypatch):
    """Three hundred names of one ZIP that are all alike have 90,000 pairs, but are linked by few; the result is as one by one."""
    cands = [_row(candidate_id=f"c{i}", seq=i, name=f"Golden Dragon Castle {i:03d}", street=f"{i} Far Rd") for i in range(300)]
    store = {f.split()[0]: None for f in STORE.split(",")} | {"id": "s0", "first_seen": datetime.datetime(2024, 1, 1), "name": "Elsewhere", "street": "9 X", "city": "Salem", "state": "OR", "zip_code": "97009"}
    seen = []
    monkeypatch.setattr(rs, "components", lambda links, real=rs.components: seen.append(links.count()) or real(links))
    assert resolved(spark, cands, [store]) == one_by_one(cands, [store], [])
    assert 300 <= max(seen) < 9000


def test_hot_name_and_zip_stays_linear(spark):
    """A third of all rows share one empty name and ZIP; they meet one holder each, not one another."""
    n = 3000
    rows = spark.range(n).select(
        F.concat(F.lit("c"), "id").alias("candidate_id"), F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "Games").otherwise(F.concat(F.lit("Shop "), F.md5(F.col("id").cast("string")))).alias("name"),
        F.concat("id", F.lit(" Main St")).alias("street"), F.lit("Bend").alias("city"), F.lit("OR").alias("state"),
        F.when(F.col("id") % 3 == 0, "97001").otherwise(F.lpad((F.col("id") % 90000).cast("string"), 5, "1")).alias("zip_code"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        F.lit(None).cast("string").alias("wpn_id"), F.lit(None).cast("string").alias("google_place_id"),
    )
    empty = spark.createDataFrame([], STORE)
    got = {r.tier: r["count"] for r in rs.resolve_candidates(rows, empty).groupBy("tier").count().collect()}
    assert got == {"new": 2001, "name_zip": 999}


def test_low_thresholds_are_refused(spark):
    rows = spark.createDataFrame([("b", "AB")], "block string, name string")
    with pytest.raises(ValueError):
        rs.similar_names(rows, rows, 80)


def test_ratio_is_taken_once_for_a_pair(spark):
    rows = spark.createDataFrame([("b", f"GOLDEN DRAGON {i:06d}") for i in range(40)], "block string, name string")
    plan = rs.similar_names(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [_ratios(") == 1  # and not once more for each signature that the names share


@pytest.mark.parametrize("first", [1, 3])
def test_first_similar_store_in_steps(spark, monkeypatch, first):
    rng = random.Random(first)
    name = lambda: rng.choice(["GOLDEN DRAGON", "SILVER CRANE", "OLD MILL"]) + f" {rng.randrange(10**4):04d}"
    seen = [datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(60)) for _ in range(120)]
    stores = [(f"s{i}", t, name(), "1 A St", "X", "TX", "75001", None, None, None, None) for i, t in enumerate(seen)]
    stores[7] = (stores[7][0], None, *stores[7][2:])
    cands = [(f"c{i}", i, name(), "2 B St", "X", "TX", "75001", None, None, None, None, None, None) for i in range(80)]
    want = {}
    for c in cands:
        similar = [s for s in stores if ratio(norm_name(c[2]), norm_name(s[2])) >= cat.FUZZY_NAME_THRESHOLD]
        if similar:
            want[c[0]] = min(similar, key=lambda s: (s[1] is not None, s[1], s[0]))[0]
    monkeypatch.setattr(rs, "FIRST_LOOK", first)
    monkeypatch.setattr(rs, "FURTHER", 3)
    s, c = spark.createDataFrame(stores, STORE), spark.createDataFrame(cands, CAND)
    assert len(rs._looks(rs._fuzzy_offers(rs._holders(s), 0.5, ("zip",)))) > 2
    assert {r.candidate_id: r.store_id for r in rs.match_fuzzy_geo(c, s).collect()} == want
    assert 0 < len(want)
