"""Entity resolution: raw candidates against the stores table and against each other.

The result is what processing the candidates one by one would give: each candidate takes the best match among the
stores that exist at its turn (lowest tier, then store order), fills empty fields of that store, or becomes a store
itself. Here that is done with joins:

* Exact tiers are equality joins. Per key only the first store counts, so keys are reduced to one row before the join
  and a key that very many rows share costs no pairs.
* The fuzzy tier compares distinct names inside a block (grid cell or ZIP). Names meet only if they share two of their
  rarest characters, which every pair above the threshold must (prefix filtering); no block is compared all with all.
* Names that are alike by the hundred in a block are linked by few pairs: which pairs there are does not matter to what follows.
* Matches against the given stores are found once. What is left depends on the batch itself: stores that candidates become, and
  ids and positions that they bring to stores. Candidates that could meet in such a way are linked, and each connected
  component is settled on its own, in turn, within a task; the others are settled at once. A chain of candidates costs as many
  rounds as the logarithm of its length, those of the components.
* Components of more than ``SETTLE_ROWS`` rows (a name and ZIP that a third of the batch share, say) are settled by joins in rounds:
  a candidate depends only on earlier ones, so the state that no longer changes is the sequential result.
* Positions that a store gets can bring it near candidates of other components. Such pairs are looked for afterwards; their
  components are put together and settled again until there are none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeledger import catalogs as cat
from placeledger.functions import geo
from placeledger.functions import text as tx
from placeledger.operators.graph import components
from placeledger.session import cut, deal, scratch

# Before and after every turn.
ALWAYS = -(2**63)
NEVER = 2**63 - 1
# Rows of a component that one task settles in turn.
SETTLE_ROWS = 2000
# Stores of a block that candidates are compared with at first, and how many times as many at each further step.
FIRST_LOOK, FURTHER = 16, 8
# With more pairs of names in blocks than so many, and than so many times the names, only what links them is looked for.
ALL_PAIRS, FEW_PAIRS = 20_000, 8
# Tier numbers order the matches; names and confidence are what callers see.
TIERS = {0: ("external_ref", 1.0), 1: ("google_place_id", 1.0), 2: ("wpn_id", 1.0), 3: ("name_zip", 0.95), 4: ("address", 0.90)}
FUZZY = 5
REVIEW_BELOW = 0.92
# Fixed order of characters from rare to common; any fixed order keeps the filter exact, this one makes it sharp.
RARE_FIRST = "ZQJX9876543210KVBYWGPFMUCDLHRSNIOATE "


# --- name similarity -----------------------------------------------------------------------------------------

def indel_ratio(a: str, b: str) -> int:
    """100 · 2·LCS / (len a + len b), rounded half to even; two empty texts give 100.

    The longest common subsequence is computed on bit rows: one integer holds a whole row of the table.
    """
    total = len(a) + len(b)
    if total == 0:
        return 100
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    lcs = len(a) - row.bit_count()
    return round(200 * lcs / total)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


# The optimizer would move a deterministic test on the ratio before the removal of repeated pairs, and run it for each of them.
name_ratio = F.pandas_udf(_ratios, T.IntegerType()).asNondeterministic()


def _least_share(threshold: int) -> float:
    """Pairs reach ``threshold`` after rounding only if LCS > share · (len a + len b)."""
    return (threshold - 0.5) / 200


def name_tokens(name: str) -> list[int]:
    """Characters numbered by occurrence ("B", second "B", ...), sorted from rare to common; each is one integer of 28 bits."""
    count, keyed = {}, []
    for ch in name:
        nth = count[ch] = min(count.get(ch, 0) + 1, 99)
        keyed.append((-nth, RARE_FIRST.find(ch), ord(ch) << 7 | nth))
    keyed.sort()
    return [token for _, _, token in keyed]


def name_marks(name: str, threshold: int) -> tuple[list[int], int, int]:
    """(signatures, low, high): the keys of a name, each a pair out of its first tokens, and a set of all its tokens in 126 bits.

    A partner has at least ``share / (1 - share)`` of this name's length, so at most ``spare`` characters of the name
    are not shared. Two names above the threshold then have two common tokens among their first ``spare + 2``. Names of
    at most two characters can only be equal.
    """
    share, tokens, bits = _least_share(threshold), name_tokens(name), 0
    for token in tokens:
        bits |= 1 << (token * 0x9E3779B1 >> 8) % 126
    if len(name) <= 2:
        signatures = [-1 - sum(ord(ch) + 1 << 21 * i for i, ch in enumerate(name))]
    else:
        spare = len(name) - (math.floor(len(name) * (share / (1 - share))) + 1)
        signatures = list({t << 28 | u for t, u in combinations(tokens[: max(spare, 0) + 2], 2)})
    return signatures, bits & 2**63 - 1, bits >> 63


def _marks(threshold: int):
    def marks(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([name_marks(n, threshold) for n in names], columns=["sigs", "low", "high"])

    return F.pandas_udf(marks, "sigs array<bigint>, low bigint, high bigint")


def _marked(df: DataFrame, threshold: int) -> DataFrame:
    """(block, name, sigs, low, high): the distinct names of blocks with their marks."""
    if threshold <= 80:
        raise ValueError("the threshold must be over 80")
    rows = df.select("block", "name").distinct().withColumn("m", _marks(threshold)("name"))
    return rows.select("block", "name", "m.sigs", "m.low", "m.high")


def _signed(names: DataFrame, side: str, *more: str) -> DataFrame:
    """A row for each signature of a name."""
    # Every name has a signature; the outer form spares the optimizer's extra test of the array.
    return names.select("block", *more, *[F.col(c).alias(f"{side}_{c}") for c in ("name", "low", "high")], F.explode_outer("sigs").alias("sig"))


def _alike(met: DataFrame, threshold: int) -> DataFrame:
    """(block, l_name, r_name, score) of the pairs of ``met`` with a ratio of at least ``threshold``."""
    share = _least_share(threshold)

    def shared(side: str, other: str) -> Column:
        """At most so many characters of a name are in the other: each bit that only this one has is a character of it alone."""
        lacks = [F.bit_count(F.col(side + half).bitwiseAND(F.bitwise_not(F.col(other + half)))) for half in ("_low", "_high")]
        return F.length(side + "_name") - lacks[0] - lacks[1]

    total = F.length("l_name") + F.length("r_name")
    least = total * share
    enough = ((shared("l", "r") > least) & (shared("r", "l") > least)) | (F.col("l_name") == F.col("r_name"))
    pairs = met.filter(enough).select("block", "l_name", "r_name").distinct().filter(F.levenshtein("l_name", "r_name") <= total - 2 * least)
    return pairs.withColumn("score", name_ratio("l_name", "r_name")).filter(F.col("score") >= threshold)


def _shared_blocks(left: DataFrame, right: DataFrame) -> tuple[DataFrame, ...]:
    """Only blocks that both sides have get signatures: most cells around a candidate are empty, most ZIPs have no unplaced candidate."""
    return tuple(df.join(other.select("block").distinct(), "block", "left_semi") for df, other in ((left, right), (right, left)))


def similar_names(left: DataFrame, right: DataFrame, threshold: int = cat.FUZZY_NAME_THRESHOLD) -> DataFrame:
    """(block, l_name, r_name, score) for all names of a block with a ratio of at least ``threshold``.

    Both inputs have (block, name). Names meet by signature; common characters and the edit distance are bounds that hold for
    every pair above the threshold and run as expressions; the ratio itself runs on what is left. Two characters and three
    can reach a ratio of 80, but short names only meet equal ones: ``threshold`` must be over 80.
    """
    left, right = (_marked(df, threshold) for df in _shared_blocks(left, right))
    return _alike(_signed(left, "l").join(_signed(right, "r"), ["block", "sig"]), threshold)


def linking_names(left: DataFrame, right: DataFrame, threshold: int = cat.FUZZY_NAME_THRESHOLD) -> DataFrame:
    """(block, l_name, r_name): pairs of :func:`similar_names` that link all names which its pairs link, a name of both sides being one.

    Where blocks have many names, each is compared with the first name of the other side that has its signature. Others with
    that signature are compared only if those pairs have not linked the two, so names that are all alike do not cost their square.
    """
    left, right = (cut(_marked(df, threshold)) for df in _shared_blocks(left, right))
    crowds = left.groupBy("block").agg(F.count("*").alias("l")).join(right.groupBy("block").agg(F.count("*").alias("r")), "block")
    pairs, names = crowds.agg(F.sum(F.col("l") * F.col("r")), F.sum(F.col("l") + F.col("r"))).first()
    by = ["block", "sig"]
    if not names or pairs <= max(ALL_PAIRS, FEW_PAIRS * names):
        return _alike(_signed(left, "l").join(_signed(right, "r"), by), threshold).drop("score")
    first = lambda df, side: _signed(df, side).groupBy(by).agg(
        F.min(F.struct(*[f"{side}_{c}" for c in ("name", "low", "high")])).alias("f")).select(*by, "f.*")
    met = _signed(left, "l").join(first(right, "r"), by).unionByName(first(left, "l").join(_signed(right, "r"), by))
    linked = cut(_alike(met.filter("l_name <> r_name"), threshold).drop("score"))
    groups = components(linked.select(_node("name", "block", "l_name").alias("a"), _node("name", "block", "r_name").alias("b")))
    left, right = (
        cut(df.withColumn("node", _node("name", "block", "name")).join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")))
        for df in (left, right)
    )
    l_rows, r_rows = _signed(left, "l", "group"), _signed(right, "r", "group")
    others = l_rows.withColumnRenamed("group", "own").join(r_rows.select(*by, "group").distinct(), by).filter("own <> group")
    same = left.select("block", "name").join(right.select("block", "name"), ["block", "name"]).select("block", F.col("name").alias("l_name"), F.col("name").alias("r_name"))
    return same.unionByName(linked).unionByName(_alike(others.join(r_rows, [*by, "group"]), threshold).drop("score"))


# --- inputs --------------------------------------------------------------------------------------------------

def normalized(df: DataFrame) -> DataFrame:
    """Adds n_name, n_street, n_city, n_state and n_zip; address parts are null where the address is unusable."""
    a = tx.normalize_address("street", "city", "state", "zip_code")
    rows = df.withColumn("_a", a).withColumn("n_name", tx.normalize_name("name"))
    return rows.withColumns({
        "n_street": F.col("_a.street"), "n_city": F.col("_a.city"), "n_state": F.col("_a.state"), "n_zip": F.col("_a.zip_code"),
    }).drop("_a")


_NAMES = ["n_name", "n_street", "n_city", "n_state", "n_zip"]


def _candidates(cands: DataFrame) -> DataFrame:
    for c in ("provider", "external_id"):
        if c not in cands.columns:
            cands = cands.withColumn(c, F.lit(None).cast("string"))
    return normalized(deal(cands)).select(
        F.col("candidate_id").alias("cid"), F.col("seq").cast("bigint").alias("seq"), *_NAMES, "latitude", "longitude",
        "wpn_id", "google_place_id", "provider", "external_id",
    )


def _holders(stores: DataFrame) -> DataFrame:
    """The given stores as holders: ``ord`` is the store order, born before every candidate."""
    order = F.struct(
        F.lit(0).alias("kind"), F.unix_micros(F.col("first_seen").cast("timestamp")).alias("at"), F.col("id").alias("id")
    )
    return normalized(deal(stores)).select(
        F.col("id").alias("store"), order.alias("ord"), F.lit(ALWAYS).cast("bigint").alias("born"), *_NAMES, "latitude",
        "longitude", "wpn_id", "google_place_id",
    )


def new_store_id(cid: Column) -> Column:
    """Id of a store made from a candidate: the same run gives the same id."""
    h = F.md5(cid)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)),
                       F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


# --- exact tiers ---------------------------------------------------------------------------------------------

def _key(tier: int, *parts: Column) -> Column:
    usable = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    if tier != 3:  # an empty name is a name like any other; empty ids and streets match nothing
        usable = usable & tx.present(parts[0])
    return F.when(usable, F.struct(F.lit(tier).alias("tier"), F.concat_ws("\u0001", *parts).alias("key")))


def _exact_keys(tiers=(1, 2, 3, 4)) -> Column:
    keys = {
        1: _key(1, F.col("google_place_id")), 2: _key(2, F.col("wpn_id")), 3: _key(3, F.col("n_name"), F.col("n_zip")),
        4: _key(4, F.col("n_street"), F.col("n_city"), F.col("n_state")),
    }
    return F.explode(F.filter(F.array(*[keys[t] for t in tiers]), lambda k: k.isNotNull()))


def _exact_entries(holders: DataFrame, tiers=(1, 2, 3, 4)) -> DataFrame:
    """(tier, key, store, ord, since): per key the first holder of its own value."""
    rows = holders.select("store", "ord", "born", _exact_keys(tiers).alias("k")).select("k.tier", "k.key", "store", "ord", "born")
    first = rows.groupBy("tier", "key").agg(F.min(F.struct("ord", "store", "born")).alias("f"))
    return first.select("tier", "key", "f.store", "f.ord", F.col("f.born").alias("since"))


def _exact_matches(cands: DataFrame, entries: DataFrame, tiers=(1, 2, 3, 4)) -> DataFrame:
    keyed = cands.select("cid", "seq", _exact_keys(tiers).alias("k")).select("cid", "seq", "k.tier", "k.key")
    met = keyed.join(entries, ["tier", "key"]).filter(F.col("seq") > F.col("since"))
    return met.select("cid", "tier", "ord", "store", F.lit(None).cast("int").alias("score"))


def _best(matches: DataFrame) -> DataFrame:
    """One match per candidate: lowest tier, then store order."""
    m = matches.groupBy("cid").agg(F.min(F.struct("tier", "ord", "store", "score")).alias("m"))
    return m.select("cid", "m.tier", "m.ord", "m.store", "m.score")


# --- fuzzy tier ----------------------------------------------------------------------------------------------

def _placed() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def _zip_block(kind: str) -> Column:
    return F.when(F.col("n_zip").isNotNull(), F.concat(F.lit(kind), "n_zip"))


def _cell_block(c: Column) -> Column:
    return F.concat_ws(":", F.lit("cell"), c["band"].cast("string"), c["cell"].cast("string"))


def _fuzzy_asks(cands: DataFrame, miles: float) -> DataFrame:
    """Blocks a candidate looks into.

    With a position: the grid cells around it, and its ZIP among stores without a position. Without: its ZIP.
    """
    cells = F.transform(geo.nearby_cells(F.col("latitude"), F.col("longitude"), miles), _cell_block)
    blocks = F.when(_placed(), F.array_append(cells, _zip_block("zip-unplaced:"))).otherwise(F.array(_zip_block("zip:")))
    return cands.select("cid", "seq", F.col("n_name").alias("name"), "latitude", "longitude", F.explode(blocks).alias("block")).filter(
        F.col("block").isNotNull() & F.col("name").isNotNull()
    )


def _own_cell(miles: float) -> Column:
    return F.when(_placed(), _cell_block(geo.own_cell(F.col("latitude"), F.col("longitude"), miles)))


def _first_of(rows: DataFrame) -> DataFrame:
    """Per block, name and position the first holder: the others can never win. (``block`` says what must agree.)"""
    kept = rows.groupBy("block", "name", "latitude", "longitude").agg(F.min(F.struct("ord", "store", "since")).alias("f"))
    return kept.select("block", "name", "latitude", "longitude", "f.ord", "f.store", "f.since", F.lit(NEVER).alias("until"))


def _fuzzy_offers(holders: DataFrame, miles: float, kinds) -> DataFrame:
    """(block, name, position, store, ord, since, until) of holders with their own values.

    ``kinds``: "zip" for candidates without a position, "unplaced" for holders without one, "cell" for the rest.
    """
    nowhere = F.lit(None).cast("double")
    base = holders.filter(F.col("n_name").isNotNull())
    parts = []
    if "zip" in kinds:
        parts.append(base.withColumn("block", _zip_block("zip:")).withColumns({"latitude": nowhere, "longitude": nowhere}))
    if "unplaced" in kinds:
        parts.append(base.filter(~_placed()).withColumn("block", _zip_block("zip-unplaced:")).withColumns({"latitude": nowhere, "longitude": nowhere}))
    if "cell" in kinds:
        parts.append(base.filter(_placed()).withColumn("block", _own_cell(miles)))
    rows = reduce(DataFrame.unionByName, parts).filter(F.col("block").isNotNull())
    return _first_of(rows.select("block", F.col("n_name").alias("name"), "latitude", "longitude", "ord", "store", F.col("born").alias("since")))


def _fuzzy_matches(asks: DataFrame, offers: DataFrame, threshold: int, miles: float) -> DataFrame:
    # Both are read twice: their names for the pairs, their rows for the matches.
    offers = cut(offers)
    pairs = similar_names(asks.select("block", "name"), offers.select("block", "name"), threshold)
    a = asks.select("block", F.col("name").alias("l_name"), "cid", "seq", F.col("latitude").alias("a_lat"), F.col("longitude").alias("a_lng"))
    o = offers.withColumnRenamed("name", "r_name")
    met = pairs.join(a, ["block", "l_name"]).join(o, ["block", "r_name"])
    near = geo.haversine_miles(F.col("a_lat"), F.col("a_lng"), F.col("latitude"), F.col("longitude")) <= miles
    ok = (F.col("seq") > F.col("since")) & (F.col("seq") <= F.col("until")) & (~F.col("block").startswith("cell:") | near)
    return met.filter(ok).select("cid", F.lit(FUZZY).alias("tier"), "ord", "store", "score")


def _looks(offers: DataFrame) -> list[int]:
    """Times in store order up to which candidates look, one step after the other; the last step has no end.

    The first step has about ``FIRST_LOOK`` offers of the block that an offer is in on average, each further one ``FURTHER`` times as many.
    """
    crowd = offers.groupBy("block").count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0
    shares, share = [], FIRST_LOOK / max(crowd, 1)
    while share < 1 / 2:
        shares.append(share)
        share *= FURTHER
    times = offers.agg(F.percentile_approx(_born(), shares, 10000)).first()[0] if shares else []
    return sorted(set(times or []))


def _born() -> Column:
    return F.coalesce(F.col("ord.at"), F.lit(ALWAYS))


def _first_similar(asks: DataFrame, offers: DataFrame, threshold: int, miles: float) -> DataFrame:
    """The best match of each candidate among given stores (all of one ``kind`` of order).

    Stores come in steps of their order, and a candidate that has found one looks no further. Where very many stores share a place
    or ZIP, the pairs to compare then grow with the candidates, but for those that have no similar store at all.
    """
    offers = cut(offers)
    found, ends = [], [*_looks(offers), None]
    for start, end in zip([None, *ends], ends, strict=False):
        some = offers if start is None else offers.filter(_born() > start)
        some = some if end is None else some.filter(_born() <= end)
        found.append(cut(_best(_fuzzy_matches(asks, some, threshold, miles))))
        if end is not None:
            asks = cut(asks.join(found[-1].select("cid"), "cid", "left_anti"))
    return reduce(DataFrame.unionByName, found)


# --- public tiers --------------------------------------------------------------------------------------------

def _public(best: DataFrame) -> DataFrame:
    tier = F.col("tier")
    name, sure = F.lit("fuzzy"), F.col("score") / 100
    for number, (label, confidence) in TIERS.items():
        name = F.when(tier == number, label).otherwise(name)
        sure = F.when(tier == number, confidence).otherwise(sure)
    return best.select(
        F.col("cid").alias("candidate_id"), F.col("store").alias("store_id"), name.alias("tier"), sure.alias("confidence"),
        ((tier == FUZZY) & (sure < REVIEW_BELOW)).alias("needs_review"),
    )


def match_external_ref(cands: DataFrame, refs: DataFrame, stores: DataFrame) -> DataFrame:
    """(candidate_id, store_id) by (provider, external_id), where that store still exists."""
    known = refs.groupBy("provider", "external_id").agg(F.min("store_id").alias("store_id"))
    alive = stores.select(F.col("id").alias("store_id"))
    return cands.select("candidate_id", "provider", "external_id").join(known, ["provider", "external_id"]).join(
        alive, "store_id", "left_semi"
    ).select("candidate_id", "store_id")


def match_exact(cands: DataFrame, stores: DataFrame, tiers) -> DataFrame:
    """Best match per candidate over some exact tiers (1 place id, 2 WPN id, 3 name and ZIP, 4 address)."""
    c, h = _candidates(cands), _holders(stores)
    return _public(_best(_exact_matches(c, _exact_entries(h, tiers), tiers)))


def match_fuzzy_geo(cands: DataFrame, stores: DataFrame, threshold: int = cat.FUZZY_NAME_THRESHOLD,
                    miles: float = cat.PROXIMITY_MILES) -> DataFrame:
    """First store per candidate with a similar name within ``miles``, or in the same ZIP if a position is missing."""
    offers = _fuzzy_offers(_holders(stores), miles, ("zip", "unplaced", "cell"))
    return _public(_first_similar(cut(_fuzzy_asks(_candidates(cands), miles)), offers, threshold, miles))


# --- the whole batch -----------------------------------------------------------------------------------------

_FILLED = ("latitude", "longitude", "wpn_id", "google_place_id")


def _gap(column: str) -> Column:
    c = F.col(column)
    return c.isNull() if column in ("latitude", "longitude") else ~tx.present(c)


def _fills(assigned: DataFrame, cands: DataFrame) -> DataFrame:
    """Per store the first candidate value and its turn, for every field a match can fill."""
    rows = assigned.select("cid", "store").join(cands, "cid")
    held = lambda c: F.col(c).isNotNull() if c in ("latitude", "longitude") else tx.present(F.col(c))
    return rows.groupBy("store").agg(*[
        F.min(F.when(held(c), F.struct("seq", F.col(c).alias("value")))).alias("f_" + c) for c in _FILLED
    ])


def _with_fills(holders: DataFrame, fills: DataFrame) -> DataFrame:
    """Holders with a fill for at least one of their gaps. ``placed_at`` is when a position is complete."""
    j = holders.join(fills, "store")
    turn = {c: F.when(_gap(c), F.col(f"f_{c}.seq")) for c in _FILLED}
    new = {f"x_{c}": F.when(_gap(c), F.col(f"f_{c}.value")).otherwise(F.col(c)) for c in _FILLED}
    j = j.withColumns({f"t_{c}": t for c, t in turn.items()} | new)
    moved = F.col("t_latitude").isNotNull() | F.col("t_longitude").isNotNull()
    placed = F.col("x_latitude").isNotNull() & F.col("x_longitude").isNotNull()
    return j.withColumn("placed_at", F.when(
        moved & placed, F.greatest(F.coalesce("t_latitude", F.lit(ALWAYS)), F.coalesce("t_longitude", F.lit(ALWAYS)))
    )).filter(F.col("placed_at").isNotNull() | F.col("t_wpn_id").isNotNull() | F.col("t_google_place_id").isNotNull())


def _same_fills(a: DataFrame, b: DataFrame) -> bool:
    columns = ["store", "placed_at", *[p + c for c in _FILLED for p in ("t_", "x_")]]
    x = a.select("store", F.struct(*columns).alias("a"))
    y = b.select("store", F.struct(*columns).alias("b"))
    return x.join(y, "store", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def _filled_entries(filled: DataFrame) -> DataFrame:
    """Ids that holders got during the batch, valid after the turn that brought them."""
    parts = [
        filled.filter(F.col(f"t_{c}").isNotNull()).select(
            F.lit(tier).alias("tier"), F.col(f"x_{c}").alias("key"), "store", "ord", F.col(f"t_{c}").alias("since")
        )
        for tier, c in ((1, "google_place_id"), (2, "wpn_id"))
    ]
    return parts[0].unionByName(parts[1])


def _filled_offers(filled: DataFrame, miles: float) -> DataFrame:
    """Completed positions: found by ZIP until the completing turn, by grid cell after it."""
    rows = filled.filter(F.col("placed_at").isNotNull() & F.col("n_name").isNotNull())
    nowhere = F.lit(None).cast("double")
    before = rows.select(
        _zip_block("zip-unplaced:").alias("block"), F.col("n_name").alias("name"), nowhere.alias("latitude"),
        nowhere.alias("longitude"), "ord", "store", F.col("born").alias("since"), F.col("placed_at").alias("until"),
    )
    after = rows.select(
        "n_name", "ord", "store", "placed_at", F.col("x_latitude").alias("latitude"), F.col("x_longitude").alias("longitude")
    ).select(
        _own_cell(miles).alias("block"), F.col("n_name").alias("name"), "latitude", "longitude", "ord", "store",
        F.col("placed_at").alias("since"), F.lit(NEVER).alias("until"),
    )
    return before.unionByName(after).filter(F.col("block").isNotNull())


def _by_external_id(c: DataFrame, h: DataFrame, refs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(cid, store) of candidates with a known external id, and (cid, owner) of those that repeat one of this batch."""
    ids = ["provider", "external_id"]
    keyed = c.filter(F.col("external_id").isNotNull() & F.col("provider").isNotNull()).select("cid", "seq", *ids)
    if refs is None:
        by_ref = h.sparkSession.createDataFrame([], "cid string, store string")
    else:
        known = refs.groupBy(*ids).agg(F.min("store_id").alias("store"))
        by_ref = cut(keyed.join(known, ids).join(h.select("store"), "store", "left_semi").select("cid", "store"))
    rest = keyed.join(by_ref, "cid", "left_anti")
    first = rest.groupBy(*ids).agg(F.min_by("cid", "seq").alias("owner"))
    follows = rest.join(first, ids).filter(F.col("cid") != F.col("owner")).select("cid", "owner")
    return by_ref, cut(follows)


# --- the batch by components ---------------------------------------------------------------------------------

def _node(kind: str, *columns) -> Column:
    """A number for a node. Equal numbers of different nodes would only put two components together."""
    return F.xxhash64(F.lit(kind), *columns)


def _links(c: DataFrame, free: DataFrame, h: DataFrame, static: DataFrame, unsure: DataFrame, by_ref: DataFrame | None,
           follows: DataFrame | None, threshold: int) -> DataFrame:
    """(a, b): candidates, stores and keys through which one candidate's outcome can bear on another's."""
    own = _node("candidate", "cid")
    tiers = static.select("cid", F.col("tier").alias("s_tier"))
    known = free.join(tiers, "cid", "left")
    loose = known.filter(F.col("s_tier").isNull())

    # Ids travel with every candidate. A group whose members all match the given holder of the id needs no care.
    ids = c.join(known.select("cid", "s_tier", F.lit(True).alias("free")), "cid", "left").select(
        "cid", (F.col("free") & F.col("s_tier").isNotNull()).alias("sure"), "s_tier", _exact_keys((1, 2)).alias("k")
    ).select("cid", "k.tier", "k.key", (F.col("sure") & (F.col("s_tier") == F.col("k.tier"))).alias("held"))
    open_ids = ids.groupBy("tier", "key").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("held", F.lit(False))).alias("held"))
    id_links = ids.drop("held").join(open_ids.filter("n > 1 and not held").select("tier", "key"), ["tier", "key"])

    # Names and addresses count where one of the group may become a store.
    keyed = known.select("cid", "s_tier", _exact_keys((3, 4)).alias("k")).select("cid", "s_tier", "k.tier", "k.key").filter(
        F.col("s_tier").isNull() | (F.col("s_tier") > F.col("tier"))
    )
    open_keys = keyed.groupBy("tier", "key").agg(F.count("*").alias("n"), F.bool_or(F.col("s_tier").isNull()).alias("loose"))
    key_links = keyed.select("cid", "tier", "key").join(open_keys.filter("n > 1 and loose").select("tier", "key"), ["tier", "key"])
    links = [id_links.unionByName(key_links).select(own.alias("a"), _node("key", "tier", "key").alias("b"))]

    # Similar names: those who look, and candidates that may become stores or stores that may get a position.
    spots = F.array(_zip_block("zip:"), F.when(~_placed(), _zip_block("zip-unplaced:")), F.when(_placed(), F.col("cell")))
    offered = loose.withColumn("cell", _own_cell(cat.PROXIMITY_MILES)).select(own.alias("node"), F.col("n_name").alias("name"), F.explode(spots).alias("block"))
    waiting = h.filter(~_placed()).select(_node("store", "store").alias("node"), F.col("n_name").alias("name"), _zip_block("zip-unplaced:").alias("block"))
    offers = cut(offered.unionByName(waiting).filter(F.col("name").isNotNull() & F.col("block").isNotNull()))
    asks = unsure.select(own.alias("node"), "name", "block")
    pairs = linking_names(asks.select("block", "name"), offers.select("block", "name"), threshold)
    ends = lambda df, side: df.groupBy("block", F.col("name").alias(side)).agg(
        F.min("node").alias(side + "_lo"), F.max("node").alias(side + "_hi"))
    met = pairs.join(ends(asks, "l_name"), ["block", "l_name"]).join(ends(offers, "r_name"), ["block", "r_name"])
    alone = (F.col("l_name_lo") == F.col("l_name_hi")) & (F.col("r_name_lo") == F.col("r_name_hi")) & (F.col("l_name_lo") == F.col("r_name_lo"))
    met = cut(met.filter(~alone).select("block", "l_name", "r_name"))
    links.append(met.select(_node("name", "block", "l_name").alias("a"), _node("name", "block", "r_name").alias("b")))
    for rows, side in ((asks, "l_name"), (offers, "r_name")):
        there = met.select("block", F.col(side).alias("name")).distinct()
        links.append(rows.join(there, ["block", "name"], "left_semi").select(F.col("node").alias("a"), _node("name", "block", "name").alias("b")))

    # A match that brings something to its store.
    to_store = static.select("cid", "store") if by_ref is None else static.select("cid", "store").unionByName(by_ref)
    given = [F.col("c." + f).isNotNull() if f in ("latitude", "longitude") else tx.present(F.col("c." + f)) for f in _FILLED]
    lacks = [F.col("h." + f).isNull() if f in ("latitude", "longitude") else ~tx.present(F.col("h." + f)) for f in _FILLED]
    brings = reduce(lambda x, y: x | y, [g & m for g, m in zip(given, lacks, strict=True)])
    filling = to_store.join(c.alias("c"), "cid").join(h.alias("h"), "store").filter(brings)
    links.append(filling.select(own.alias("a"), _node("store", "store").alias("b")))
    if follows is not None:
        links.append(follows.select(own.alias("a"), _node("candidate", "owner").alias("b")))
    return reduce(DataFrame.unionByName, links)


def _near(lat1, lng1, lat2, lng2, miles: float) -> bool:
    """The distance test of :func:`geo.haversine_miles` for two positions."""
    if not (abs(lat1) <= 90 and abs(lat2) <= 90 and abs(lng1) <= 180 and abs(lng2) <= 180):
        return False
    half = lambda x, y: math.sin(math.radians(y - x) / 2) ** 2
    a = min(half(lat1, lat2) + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half(lng1, lng2), 1.0)
    return 2 * cat.EARTH_RADIUS_MILES * math.atan2(math.sqrt(a), math.sqrt(1 - a)) <= miles


def _in_turn(rows: list[dict], threshold: int, miles: float) -> Iterator[tuple]:
    """(cid, tier, store, score) of the candidates of one component; its stores come first, then the candidates by turn."""
    holders, keys, went = [], {}, {}
    share = _least_share(threshold)

    def learn(s: dict) -> None:
        for tier in TIERS:
            key = s.get(f"k{tier}")
            if key is not None and ((tier, key) not in keys or s["ord"] < keys[tier, key]["ord"]):
                keys[tier, key] = s

    def similar(r: dict, before) -> tuple | None:
        found = None
        for s in holders:
            if s["n_name"] is None or (before is not None and s["ord"] >= before) or (found and s["ord"] >= found[0]):
                continue
            if None not in (r["latitude"], r["longitude"], s["latitude"], s["longitude"]):
                if not _near(r["latitude"], r["longitude"], s["latitude"], s["longitude"], miles):
                    continue
            elif r["n_zip"] is None or r["n_zip"] != s["n_zip"]:
                continue
            a, b = len(r["n_name"]), len(s["n_name"])
            if a + b and min(a, b) <= share * (a + b) and r["n_name"] != s["n_name"]:
                continue
            score = indel_ratio(r["n_name"], s["n_name"])
            if score >= threshold:
                found = (s["ord"], s, score)
        return found

    for r in rows:
        if r["cid"] is None:
            r["ord"] = (0, r["at"] is not None, r["at"] or 0, r["store"])
            holders.append(r)
            learn(r)
            continue
        if r["ref"] is not None:
            match = (0, None, r["ref"], None)
        elif r["owner"] is not None:
            match = (0, None, went[r["owner"]], None)
        else:
            best = r["s_tier"], (0, r["at"] is not None, r["at"] or 0, r["s_store"]), r["s_store"], r["s_score"]
            match = best if r["s_tier"] is not None else None
            for tier in TIERS:
                s = keys.get((tier, r[f"k{tier}"])) if tier and r[f"k{tier}"] is not None else None
                if s is not None and (match is None or (tier, s["ord"]) < match[:2]):
                    match = (tier, s["ord"], s["store"], None)
                    break
            if r["n_name"] is not None and (match is None or match[0] == FUZZY):
                found = similar(r, match[1] if match else None)
                match = (FUZZY, found[0], found[1]["store"], found[2]) if found else match
        if match is None:
            s = r | {"store": r["new_id"], "ord": (1, True, r["seq"], r["new_id"])}
            holders.append(s)
            learn(s)
            match = (None, None, s["store"], None)
        else:
            s = next((s for s in holders if s["store"] == match[2]), None)
            if s is not None:  # a store that isn't here has no gap that this component could fill
                for f in ("latitude", "longitude", "k1", "k2"):
                    if s[f] is None:
                        s[f] = r[f]
                learn(s)
        went[r["cid"]] = match[2]
        yield r["cid"], match[0], match[2], match[3]


_DECIDED = "cid string, tier int, store string, score int"


def _settled(rows: DataFrame, threshold: int, miles: float) -> DataFrame:
    """Settle each component of ``rows`` (with ``comp``) in turn. A task holds one component of :data:`SETTLE_ROWS` rows at most."""
    names = rows.columns

    def work(batches):
        comp, held, out = None, [], []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                if row["comp"] != comp:
                    out += _in_turn(held, threshold, miles)
                    comp, held = row["comp"], []
                held.append(row)
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=columns)
                out = []
        out += _in_turn(held, threshold, miles)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=columns)

    kinds, columns = (pa.string(), pa.int32(), pa.string(), pa.int32()), ["cid", "tier", "store", "score"]
    ordered = rows.repartition(F.col("comp")).sortWithinPartitions("comp", F.col("cid").isNotNull(), "seq")
    return ordered.mapInArrow(work, _DECIDED)


def _component_rows(c: DataFrame, h: DataFrame, static: DataFrame, by_ref: DataFrame | None, follows: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What settling needs of candidates and of stores, in the same columns."""
    keys = {f"k{t}": k["key"] for t, k in {
        1: _key(1, F.col("google_place_id")), 2: _key(2, F.col("wpn_id")), 3: _key(3, F.col("n_name"), F.col("n_zip")),
        4: _key(4, F.col("n_street"), F.col("n_city"), F.col("n_state")),
    }.items()}
    shared = ["n_name", "n_zip", "latitude", "longitude", *keys]
    none = lambda kind: F.lit(None).cast(kind)
    best = static.select("cid", F.col("tier").alias("s_tier"), F.col("ord.at").alias("at"), F.col("store").alias("s_store"), F.col("score").alias("s_score"))
    ref = by_ref.select("cid", F.col("store").alias("ref")) if by_ref is not None else c.limit(0).select("cid", none("string").alias("ref"))
    owner = follows if follows is not None else c.limit(0).select("cid", none("string").alias("owner"))
    cands = c.withColumns(keys).join(best, "cid", "left").join(ref, "cid", "left").join(owner, "cid", "left").select(
        "cid", "seq", none("string").alias("store"), "at", *shared, "s_tier", "s_store", "s_score", "ref", "owner", new_store_id(F.col("cid")).alias("new_id")
    )
    stores = h.withColumns(keys).select(
        none("string").alias("cid"), none("bigint").alias("seq"), "store", F.col("ord.at").alias("at"), *shared, none("int").alias("s_tier"),
        none("string").alias("s_store"), none("int").alias("s_score"), none("string").alias("ref"), none("string").alias("owner"), none("string").alias("new_id"),
    )
    return cands, stores


def resolve_candidates(
    cands: DataFrame, stores: DataFrame, refs: DataFrame | None = None, threshold: int = cat.FUZZY_NAME_THRESHOLD,
    miles: float = cat.PROXIMITY_MILES, max_rounds: int | None = None, settle_rows: int = SETTLE_ROWS,
) -> DataFrame:
    """One row per candidate: (candidate_id, store_id, tier, confidence, needs_review, is_new).

    ``cands`` has candidate_id, seq (turn, unique), name, street, city, state, zip_code, latitude, longitude, wpn_id,
    google_place_id, and optionally provider and external_id. Candidates without a match get the id of the store they
    become. ``max_rounds`` only guards callers that want an error instead of a long run; the result is never cut. The tables that
    the run writes are removed at its end, but the result.
    """
    with scratch(cands.sparkSession) as own:
        return own.keep(cut(_resolve(own, cands, stores, refs, threshold, miles, max_rounds, settle_rows)))


def _resolve(own, cands, stores, refs, threshold, miles, max_rounds, settle_rows) -> DataFrame:
    identified = "external_id" in cands.columns
    c = cut(_candidates(cands))
    h = cut(_holders(stores))

    # Candidates whose external id is known, or was seen earlier in the batch, follow that and are not compared.
    free, by_ref, follows = c, None, None
    if identified:
        by_ref, follows = _by_external_id(c, h, refs)
        free = cut(c.join(by_ref, "cid", "left_anti").join(follows, "cid", "left_anti"))

    # Against the given stores, once.
    exact = cut(_best(_exact_matches(free, _exact_entries(h))))
    unsure = cut(_fuzzy_asks(free.join(exact, "cid", "left_anti"), miles))
    fuzzy = _first_similar(unsure, _fuzzy_offers(h, miles, ("zip", "cell")), threshold, miles)
    static = cut(exact.unionByName(fuzzy))

    # Components of candidates that can bear on each other; a candidate without links is one of its own.
    linked = components(_links(c, free, h, static, unsure, by_ref, follows, threshold))
    comp_of = cut(c.select("cid", _node("candidate", "cid").alias("node")).join(linked, "node", "left").select(
        "cid", F.coalesce("component", "node").alias("comp")))
    stores_in = cut(h.select("store", _node("store", "store").alias("node")).join(linked, "node").select("store", F.col("component").alias("comp")))
    cand_rows, store_rows = _component_rows(c, h, static, by_ref, follows)
    cand_rows = cut(cand_rows)

    def settle(members: DataFrame, stores_of: DataFrame) -> DataFrame:
        """Decide all candidates of ``members`` (cid, comp)."""
        sizes = members.groupBy("comp").count().unionByName(stores_of.groupBy("comp").count()).groupBy("comp").agg(F.sum("count").alias("n"))
        small_ones = sizes.filter(F.col("n") <= settle_rows).select("comp")
        rows = cand_rows.join(members, "cid").unionByName(store_rows.join(stores_of, "store"))
        done = cut(_settled(rows.join(small_ones, "comp", "left_semi"), threshold, miles))
        rest = members.join(small_ones, "comp", "left_anti").select("cid")
        if rest.isEmpty():
            return done
        mine = cut(rest)
        some = lambda df: df if df is None else cut(df.join(mine, "cid", "left_semi"))
        rounds = _in_rounds(own, some(c), h, some(free), some(by_ref), some(follows), some(exact), some(unsure), some(static), threshold, miles, max_rounds)
        return cut(done.unionByName(rounds))

    decided = settle(comp_of, stores_in)
    while True:
        # Stores that got a position, near candidates of other components.
        order = F.struct(F.lit(1).alias("kind"), F.col("seq").alias("at"), F.col("store").alias("id"))
        leaders = free.join(decided.filter(F.col("tier").isNull()).select("cid", "store"), "cid").select(
            "cid", "store", order.alias("ord"), F.col("seq").alias("born"), *_NAMES, "latitude", "longitude", "wpn_id", "google_place_id"
        )
        every = h.unionByName(leaders.drop("cid"))
        moved = cut(_with_fills(every, _fills(decided.filter(F.col("tier").isNotNull()), c)).filter(F.col("placed_at").isNotNull()))
        if moved.isEmpty():
            break
        homes = stores_in.unionByName(leaders.select("cid", "store").join(comp_of, "cid").select("store", "comp"))
        # Pairs of one component are settled already; names of one block are paired only for what is left.
        near = _fuzzy_matches(unsure, _filled_offers(moved, miles).filter(F.col("block").startswith("cell:")), threshold, miles)
        across = near.select("cid", "store").join(comp_of, "cid").join(homes.withColumnRenamed("comp", "home"), "store").filter("comp <> home")
        met = cut(across.select(F.col("comp").alias("a"), F.col("home").alias("b")).distinct())
        own.drop(moved)
        if met.isEmpty():
            break
        joined = components(met).select(F.col("node").alias("comp"), F.col("component").alias("to"))
        old = comp_of, stores_in, decided
        relabel = lambda df, key: cut(df.join(joined, "comp", "left").select(
            key, F.coalesce("to", "comp").alias("comp"), F.col("to").isNotNull().alias("again")))
        comp_again, stores_again = relabel(comp_of, "cid"), relabel(stores_in, "store")
        again = comp_again.filter("again").select("cid", "comp")
        redone = settle(again, stores_again.filter("again").select("store", "comp"))
        decided = cut(decided.join(again, "cid", "left_anti").unionByName(redone))
        comp_of, stores_in = cut(comp_again.select("cid", "comp")), cut(stores_again.select("store", "comp"))
        own.drop(*old, comp_again, stores_again, redone, met)
    out = _public(decided.filter(F.col("tier").isNotNull())).withColumn("is_new", F.lit(False))
    made = decided.filter(F.col("tier").isNull()).select(
        F.col("cid").alias("candidate_id"), F.col("store").alias("store_id"), F.lit("new").alias("tier"),
        F.lit(0.0).alias("confidence"), F.lit(False).alias("needs_review"), F.lit(True).alias("is_new"),
    )
    return out.unionByName(made)


def _in_rounds(own, c, h, free, by_ref, follows, exact, unsure, static, threshold, miles, max_rounds) -> DataFrame:
    """(cid, tier, store, score) of components that no task should hold: all at once by joins, until nothing changes."""

    def everyone(best: DataFrame) -> DataFrame:
        """(cid, tier, store) of all matched candidates and of those that became stores (tier null)."""
        made = free.join(best, "cid", "left_anti").select("cid", F.lit(None).cast("int").alias("tier"), new_store_id(F.col("cid")).alias("store"))
        decided = best.select("cid", "tier", "store").unionByName(made)
        if by_ref is None:
            return decided
        decided = decided.unionByName(by_ref.select("cid", F.lit(0).alias("tier"), "store"))
        followers = follows.join(decided.select(F.col("cid").alias("owner"), "store"), "owner").select(
            "cid", F.lit(0).alias("tier"), "store"
        )
        return decided.unionByName(followers)

    def holders_of(decided: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(stores made so far, all holders, holders with filled gaps)."""
        made = decided.filter(F.col("tier").isNull()).select("cid", "store")
        order = F.struct(F.lit(1).alias("kind"), F.col("seq").alias("at"), F.col("store").alias("id"))
        leaders = free.join(made, "cid").select(
            "store", order.alias("ord"), F.col("seq").alias("born"), *_NAMES, "latitude", "longitude", "wpn_id", "google_place_id"
        )
        every = h.unionByName(leaders)
        return leaders, every, cut(_with_fills(every, _fills(decided.filter(F.col("tier").isNotNull()), c)))

    # Stores made or completed by the batch, until they stay the same.
    best, number = static, 0
    decided = cut(everyone(best))
    leaders, holders, filled = holders_of(decided)
    while True:
        number += 1
        entries = _exact_entries(leaders).unionByName(_filled_entries(filled))
        exact_now = cut(_best(exact.unionByName(_exact_matches(free, entries))))
        asks = unsure.join(exact_now, "cid", "left_anti")
        still = holders.join(filled.filter(F.col("placed_at").isNotNull()).select("store"), "store", "left_anti")
        offers = (
            _fuzzy_offers(leaders, miles, ("zip", "cell"))
            .unionByName(_fuzzy_offers(still, miles, ("unplaced",)))
            .unionByName(_filled_offers(filled, miles))
        )
        fuzzy_now = static.filter(F.col("tier") == FUZZY).unionByName(_fuzzy_matches(asks, offers, threshold, miles))
        fuzzy_now = fuzzy_now.join(exact_now, "cid", "left_anti")
        best = cut(_best(exact_now.unionByName(fuzzy_now)))
        before, decided = decided, cut(everyone(best))
        old_filled = filled
        leaders, holders, filled = holders_of(decided)
        superseded = [before, old_filled, exact_now]
        # Another round would see the same unless a store was added, a store that someone matched is gone, or a fill
        # changed. Stores that are gone and that nobody matched cannot change a match.
        old, new = (x.filter(F.col("tier").isNull()).select("store") for x in (before, decided))
        gone, added = old.join(new, "store", "left_anti"), new.join(old, "store", "left_anti")
        missed = decided.filter(F.col("tier").isNotNull()).join(gone, "store", "left_semi")
        stable = added.isEmpty() and missed.isEmpty() and _same_fills(old_filled, filled)
        own.drop(*superseded)
        if stable:
            break
        if max_rounds is not None and number >= max_rounds:
            raise RuntimeError(f"no stable result after {number} rounds")
    return decided.join(best.select("cid", "score"), "cid", "left")
