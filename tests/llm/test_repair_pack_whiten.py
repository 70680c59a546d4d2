"""Conversation repair, packing and whitening against brute-force versions, with nulls, ties, repeated rows and clashing columns."""

import bisect
import hashlib
import heapq
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placeledger.llm import packing, repair, whitening
from placeledger.llm.queries import QUERIES

SOLID = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?\Z")


# --- conversation repair -------------------------------------------------------------------------------------

def cheapest(letters, kinds):
    """(cost, audit) by a search over all edit sequences in order of (cost, audit); at most two inserts in a row."""
    heap, seen = [(0, "", 0, "", 0)], set()
    while heap:
        cost, audit, i, out, inserts = heapq.heappop(heap)
        if (i, out, inserts) in seen:
            continue
        seen.add((i, out, inserts))
        if i == len(letters) and GOOD.match(out):
            return cost, audit
        if not GOOD.match(out + "a") and not GOOD.match(out + "ua") and not GOOD.match(out):
            continue
        if inserts < 2:
            for c in "ua":
                heapq.heappush(heap, (cost + 2, audit + "I", i, out + c, inserts + 1))
        if i < len(letters):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out, 0))
            if kinds[i] != 1:
                late = int(kinds[i] == 2)
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, out + letters[i], 0))
                for c in "ua":
                    heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, out + c, 0))


def coded(letters, kinds):
    return bytes("sua?".index(c) + 4 * k for c, k in zip(letters, kinds, strict=True))


def test_search_is_optimal():
    rng = random.Random(3)
    cases = [(ls, ks) for n in range(4) for ls in itertools.product("sua?", repeat=n) for ks in itertools.product((0, 1, 2), repeat=n)]
    cases += [("".join(rng.choices("suuaa?", k=n)), rng.choices((0, 0, 0, 1, 2), k=n)) for n in range(4, 9) for _ in range(40)]
    for letters, kinds in cases:
        assert repair.search(coded(letters, kinds)) == cheapest(letters, kinds), (letters, kinds)


def test_bounds_and_prunes():
    """No bound is above the real cost, and the search opens few nodes: 5,000 rows take no more than some per row."""
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(0, 7)
        codes = coded(rng.choices("suuaa?", k=n), rng.choices((0, 0, 1, 2), k=n))
        for exits in (repair.FINAL, (repair.START,), (repair.SYSTEM,), (repair.USER,), (repair.ASSISTANT,)):
            bound = repair.bounds(codes, exits)
            for i, q in itertools.product(range(n + 1), range(4)):
                best = repair.search(codes[i:], q, exits)
                assert best is None or bound[i][q] <= best[0]


def test_stretches_join(monkeypatch):
    rng = random.Random(5)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(repair, "SEGMENT", size)
        for _ in range(60):
            n = rng.randint(size + 1, 24)
            codes = coded(rng.choices("suuaa?", k=n), rng.choices((0, 0, 1, 2), k=n))
            assert repair.repair_codes(codes) == repair.search(codes)


def brute_repair(rows):
    """conv_id -> report, for (conv_id, turn, role, text) rows after damage."""
    def order(r):
        return (r[1] is not None, r[1] or 0, r[2], r[3])

    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv), key=order)
        seen, faults = set(), []
        for _, _, role, text in own:
            solid = SOLID.findall(text)
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        letters = [r[2][:1] if r[2][:1] in ("s", "u", "a") and r[2] else "?" for r in own]
        codes = coded(letters, [1 if f in (1, 2) else 2 if f == 3 else 0 for f in faults])
        cost, audit = cheapest(letters, [1 if f in (1, 2) else 2 if f == 3 else 0 for f in faults]) if len(own) < 9 else repair.search(codes)
        n_out, lines, at = len(audit) - audit.count("D"), [], iter(own)
        place = 0
        for c in audit:
            row = None if c == "I" else next(at)
            if c == "D":
                continue
            role = row[2] if c == "K" else "user" if (place - n_out % 2) % 2 == 0 else "assistant"
            lines.append(role + ":" + (row[3] if row else ""))
            place += 1
        turns = {r[1] for r in own} - {None}
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def conversation_rows():
    rng = random.Random(6)
    rows = [(None, 0, "user", "Hi."), (None, None, None, None), (None, 1, "assistant", "Yes"), (1, None, "user", "a."), (1, None, "user", "a."),
            (2, 0, "system", "S."), (3, 5, "user", "q?"), (3, 5, "assistant", "x!"), (3, 5, "assistant", "w!"), (3, 2**62, "User", "z."), (4, 0, "", ""),
            (5, 0, "user", "é . \t\n"), (5, 1, "assistant", "long. " * 50_000), (5, 2, "user", " ")]
    for conv in range(10, 60):
        for turn in range(rng.randint(1, 8)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool"])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, rng.choice(["Yes.", "No", " ", "Why?", "Yes."])))
    rows += [(99, k, ("user", "assistant")[k * k % 7 % 2], f"line {k}" + ".!x"[k % 3]) for k in range(1500)]
    return rows


def test_repair_jobs(spark, monkeypatch):
    rows = conversation_rows()
    schema = "conv_id long, turn long, role string, text string, row_id long, place string, audit long"
    turns = spark.createDataFrame([(*r, 3, "x", 4) for r in rows], schema).repartition(5)
    want = brute_repair(rows)
    for table in (turns, turns.coalesce(1)):
        planned, repaired = repair.repair(table)
        got = {r[0]: tuple(r[1:]) for r in repair.with_all(planned, repaired, table).collect()}
        assert got == want
    text = {(r.conv_id, r.place): r for r in repaired.filter("conv_id = 5").collect()}
    assert text[5, 1].text == "long. " * 50_000 and text[5, 0].edit == "K"
    none = spark.createDataFrame([], schema)
    assert repair.with_all(*repair.repair(none), none).collect() == []


def test_repair_query(spark, data):
    rows = []
    turns = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case:
            row = (conv, turn, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)
            rows += [row] * (2 if case == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in turns} | brute_repair(rows)
    got = QUERIES["op11_conversation_repair"](spark, data)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


# --- packing -------------------------------------------------------------------------------------------------

def best_fit(lengths, capacity):
    """Remaining capacities after best-fit decreasing, piece by piece."""
    open_bins, closed = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(open_bins, length)
        left = (open_bins.pop(k) if k < len(open_bins) else capacity) - length
        if left:
            bisect.insort(open_bins, left)
        else:
            closed += 1
    return sorted(open_bins + [0] * closed)


@pytest.mark.parametrize("capacity", [1, 7, 64, 1024])
def test_runs_are_best_fit(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 40, 3000):
        lengths = [min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(n)]
        counts = {x: lengths.count(x) for x in set(lengths)}
        bins, seen = {}, dict.fromkeys(counts, 0)
        for length, rank, take, first, per, offset in packing.best_fit_runs(counts, capacity).tolist():
            assert rank == seen[length]
            seen[length] += take
            for j in range(take):
                bins.setdefault(first + j // per, []).append((offset + j % per * length, length))
        assert seen == counts
        for places in bins.values():
            end = 0
            for start, length in sorted(places):
                assert start == end
                end += length
            assert end <= capacity
        assert sorted(capacity - sum(x for _, x in p) for p in bins.values()) == best_fit(lengths, capacity)


def check_packing(got, texts, capacity):
    """Every piece is there once, holds its ids, and sequences have neither gaps nor overlaps."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want, lengths = [], []
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        start, piece = 0, 0
        while start < len(ids):
            length = (len(ids) - start) % capacity or capacity
            want.append((doc, piece, start, length, zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))))
            lengths.append(length)
            start, piece = start + length, piece + 1
    order = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=order) == sorted(want, key=order)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    left = []
    for places in sequences.values():
        end = 0
        for start, length in sorted(places):
            assert start == end
            end += length
        left.append(capacity - end)
    assert sorted(left) == best_fit(lengths, capacity) and min(left) >= 0


def test_pack(spark):
    from tests.llm.test_operators import ROWS, SCHEMA

    rows = [*ROWS, (None, "a null id", "x", "s", 1, 7, "k", "l", 5, 6, "no", "x"), (10**6, "word and " * 700_000, "x", "s", 1, 7, "k", "l", 5, 6, "no", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("piece", "length", "part", "nth", "offset")}).repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    for capacity in (1024, 50):
        packed = packing.pack(docs, path, 2, capacity)
        got = packed.collect()
        check_packing(got, [(r[0], r[1]) for r in rows], capacity)
        assert all(zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4")) == r.ids_crc32 for r in got)
    assert packing.pack(docs.limit(0), path, 2, 1024).collect() == []


def test_pack_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check_packing(QUERIES["op12_best_fit_packing"](spark, data).collect(), docs, 1024)


# --- whitening -----------------------------------------------------------------------------------------------

def check_whitening(got, vectors, keep=8, rank=None):
    """``vectors``: (vec_id, usable entries)."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in vectors], dtype=np.int64)
    n, d = x.shape
    sums, count = x.sum(axis=0), min(keep, d)
    centred = x - sums / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    assert len(got) == n * count
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert sorted(k[1] for k, v in rows.items() for _ in v[1]) == sorted(deviation)
    rank = count if rank is None else rank
    for k in range(count):
        mine = sorted([r for v in rows.values() for r in v[k + 1]], key=lambda r: (r.vec_id or -1, r.deviation, r.whitened))
        assert {r.n for r in mine} == {n} and len({(r.explained, r.identity_error) for r in mine}) == 1
        assert mine[0].identity_error <= 1e-4
        if k >= rank:
            assert all(r.whitened == 0 for r in mine) and mine[0].explained == 0
            continue
        assert abs(mine[0].explained - values[k] / values.sum()) <= 1e-4 * mine[0].explained
        own = centred @ parts[:, k] / math.sqrt(values[k])
        signs = []
        for sign in (1, -1):
            want = sorted(((v[0] or -1, dev, sign * w) for v, dev, w in zip(vectors, deviation, own, strict=True)))
            signs.append(max(abs(r.whitened - w[2]) for r, w in zip(mine, want, strict=True)))
        assert min(signs) < 1e-6


SHAPE = "vec_id long, embedding array<float>, label int, x string, part string, g int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "p", 2) for i, v in rows], SHAPE).repartition(4)


def test_whiten(spark):
    rng = np.random.default_rng(8)
    base = (rng.normal(size=(300, 12)) * np.geomspace(3, 1e-2, 12) + 5).astype(np.float32).tolist()
    good = [(i, v) for i, v in enumerate(base)] + [(7, base[7]), (7, base[7]), (None, base[3])]
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] + [0.0] * 11), (1003, [float("inf")] * 12), (1004, []), (1005, [1.0] * 5)]
    check_whitening(whitening.whiten(frame(spark, good + bad)).collect(), good)
    assert whitening.whiten(frame(spark, bad[:5])).collect() == []
    assert whitening.whiten(frame(spark, []).limit(0)).collect() == []


def test_whiten_without_variance(spark):
    rng = np.random.default_rng(9)
    low = (rng.integers(-9, 9, size=(60, 2)) @ rng.integers(-3, 4, size=(2, 6)) / 1024 * 8).tolist()
    check_whitening(whitening.whiten(frame(spark, list(enumerate(low)))).collect(), list(enumerate(low)), rank=2)
    same = [(i, [0.5, 0.25, 3.0]) for i in range(9)]
    got = whitening.whiten(frame(spark, same)).collect()
    assert len(got) == 27 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in got} == {(0.0, 0.0, 0, 0.0)}
    huge = whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 0.0])])).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id == 1} == {None}


def test_whiten_query(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check_whitening(QUERIES["op13_embedding_whitening"](spark, data).collect(), rows)
