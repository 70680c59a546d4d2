"""Each operator against a brute-force version, on texts with nulls, empty and long ones, copies, ties and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placeledger.llm import bpe, chat, components, decontaminate, language_id, line_dedup, near_dedup, ngrams, outliers, suffix_dedup, token_files
from placeledger.session import checkpoint_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, `key` string, lines string, component long, block long, kept string, x string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    shared, passage = "One line THAT many have", prose(rng, 60)
    texts = [None, "", " ", "\n\n", "word", "Two words", "one two three four", "é ü ß  x\t\ty", "🙂 <|endoftext|> don't 12 345\r\n", "aaaa" * 40, "ab " * 3000]
    base = prose(rng, 200)
    texts += [base, base, base.upper(), base + " tail", base.replace(" a", " b", 3)]
    for i in range(24):
        own = prose(rng, rng.randint(60, 200), "abcdefghij" if i % 2 else "klmnopqrst")
        texts.append("\n".join([own[:50], f"  {shared}\t" if i < 14 else "", own[50:], passage if i % 6 == 0 else "", own[50:80]]))
    words = base.split()
    for i in range(40):  # near copies, like some of each other and unlike others
        copy = list(words)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(len(copy))] = "zz" + str(rng.randint(0, 9999))
        texts.append(" ".join(copy))
    rows = [(i * 3, t, [None, "aj", "kt"][i % 3], "s" + str(i % 2), 1, 7, "k", "l", 5, 6, "no", "x") for i, t in enumerate(texts)]
    return rows + [rows[12], rows[0]]  # rows that are repeated as a whole


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def hexed(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


def test_lines(docs, empty):
    keys = [[x.strip(" \t\n\v\f\r").translate(LOW) for x in (r[1] or "").split("\n")] for r in ROWS]
    count = collections.Counter(k for ks in keys for k in set(ks))
    want = []
    for r, ks in zip(ROWS, keys, strict=True):
        kept = [x for x, k in zip((r[1] or "").split("\n"), ks, strict=True) if not (k and count[k] >= 10)]
        want.append((r[0], len(ks), len(ks) - len(kept), "\n".join(kept)))
    got = line_dedup.line_report(docs, min_docs=10).collect()
    same([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got], want)
    assert sum(w[2] for w in want) >= 14
    out = line_dedup.dedup_lines(docs, min_docs=10)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert line_dedup.dedup_lines(empty).collect() == []


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def test_near_groups(spark, docs, empty):
    sets = {r[0]: shingles(r[1]) for r in ROWS}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    got = near_dedup.near_groups(docs).collect()
    same([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], [(r[0], len(sets[r[0]]), find(r[0]), find(r[0]) == r[0]) for r in ROWS])
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in sets if find(i) == i}
    assert near_dedup.near_groups(empty).collect() == []
    nothing = spark.createDataFrame([(None, "same words in both of these texts"), (4, "same words in both of these texts"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup.near_groups(nothing).collect()) == [("4", 3, "None"), ("None", 0, "None"), ("None", 3, "None")]


def test_rows_without_words_displace_none(spark):
    texts = ["one two three", "four five six", "seven eight", "nine ten eleven"]
    rows = [(i, t) for i, t in enumerate(texts) for t in (t, " ", "", None, "\n\n")]
    kept = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    same([tuple(r) for r in kept.collect()], rows)


def test_unlike_sets_of_a_bucket(spark):
    """Texts that share a long passage but are not similar do not meet; no task gets more than two blocks of the others."""
    rng = random.Random(2)
    passage = prose(rng, 70)
    rows = [(i, f"{passage} {prose(rng, 30)}") for i in range(300)]
    core = prose(rng, 80)
    rows += [(1000 + i, f"{core} {prose(rng, 20)}") for i in range(90)]  # 0.67: common shingles are among their rarest
    words = rows[305][1].split()
    rows += [(2000 + i, " ".join(words[: 80 + 4 * i] + prose(rng, 20 - 4 * i).split())) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    sets = near_dedup._wanted_sets(docs, docs.select(F.col("doc_id").alias("node")), 5).cache()
    rare = near_dedup._rare(sets, 75, 32).collect()
    met = collections.Counter(r.token for r in rare if r.node < 1000)
    assert None not in met and not any(met[r.token] > 1 for r in rare)
    assert {r.node for r in rare if r.token is None} >= set(range(1000, 1090))
    marks = near_dedup.signatures(docs).select(F.col("doc_id").alias("node"), "signature")
    one = docs.select(F.lit(1).cast("long").alias("key"), F.col("doc_id").alias("node"))
    labels = spark.createDataFrame([], "node long, component long")
    exact = {r[0]: shingles(r[1]) for r in rows}
    want = {(a, b) for a in exact for b in exact if a < b and 100 * len(exact[a] & exact[b]) >= 75 * len(exact[a] | exact[b])}
    assert want
    for hot in (1, 32, 254):
        got = near_dedup._rest(one, labels, sets, marks, 75, hot=hot, block_rows=16)
        assert {tuple(sorted(r)) for r in got.collect()} == want
    dealt = near_dedup._meetings(one.withColumn("component", F.when(F.col("node") < 200, 0).otherwise(F.col("node"))), 16).cache()
    assert dealt.groupBy("key", "lo", "hi").count().agg(F.max("count")).first()[0] < 4 * 16
    pairs = dealt.alias("x").join(dealt.alias("y"), ["key", "lo", "hi"]).filter("x.node < y.node and x.component <> y.component and (x.lo = x.hi or x.block <> y.block)")
    met = collections.Counter((r[0], r[1]) for r in pairs.select("x.node", "y.node").collect())
    n = len(rows)
    assert len(met) == n * (n - 1) // 2 - 200 * 199 // 2 and set(met.values()) == {1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 90), (95, 100), (95, 90), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {95: 90, 100: 90}


def test_leaks(spark, docs, empty):
    text = ROWS[20][1]
    words = text.split()
    items = [(1, " ".join(words[3:30])), (2, " ".join(words[5:30] + ["other", "end"])), (3, None), (4, ""), (5, "not there at all in any text"), (6, "Two words"), (7, " ".join(words[3:12] + words[40:49])), (1, text[:90]), (8, " ".join(words[7:9]).upper()), (9, words[50]), (10, " ".join(words[60:64])), (11, words[7] + " absent")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for r in ROWS:
        for i, t in items:
            a, b = shingles(r[1]), shingles(t)
            short = len(WORD.findall(t or ""))
            if 0 < short < 5:  # one shingle, of so many words
                w = WORD.findall((r[1] or "").translate(LOW))
                a = {tuple(w[k : k + short]) for k in range(len(w) - short + 1)}
                b = {tuple(WORD.findall(t.translate(LOW)))}
            if b and 100 * len(a & b) >= 75 * len(b):
                want[r[0], i] = max(want.get((r[0], i), (0, 0, 0)), (len(a & b) / len(b), len(a & b), len(b)))
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id): (r.n_shared / r.n_shingles, r.n_shared, r.n_shingles) for r in got} == want and len(got) == len(want) > 2
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    same([r.doc_id for r in left.collect()], [r[0] for r in ROWS if r[0] not in {d for d, _ in want}])
    assert decontaminate.find_leaks(empty, bench).collect() == []
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(ROWS)


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_sketch_length(percent):
    for n in range(1, 400):
        assert decontaminate.sketch_length(n, percent) >= min(n, n - -(-n * percent // 100) + 1)


@pytest.mark.parametrize("length", [50, 17])
def test_repeats(docs, empty, length):
    where = {}
    for r in ROWS:
        raw = (r[1] or "").encode()
        for i in range(len(raw) - length + 1):
            where[raw[i : i + length]] = min(r[0], where.get(raw[i : i + length], r[0]))
    want = []
    for r in ROWS:
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if where[raw[i : i + length]] < r[0]:
                gone[i : i + length] = b"\1" * length
        want.append((r[0], len(raw), len(re.findall(b"\1+", gone)), hexed(bytes(x for x, g in zip(raw, gone, strict=True) if not g))))
    got = suffix_dedup.remove_repeats(docs, length=length, filter_bits=1 << 16).collect()
    same([(r.doc_id, r.n_bytes, len(r.removed), hexed(bytes(r.kept))) for r in got], want)
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_repeats_of_hot_anchors(spark, docs):
    """Different ends of one passage are dealt by window: no bucket gets them all, and the result is the same."""
    import numpy as np

    rng = random.Random(4)
    passage = prose(rng, 20)
    texts = [f"{prose(rng, 12)} {passage} {prose(rng, 12)}".encode() for _ in range(200)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found = suffix_dedup.anchors(data, offsets, 50)
    names, different = np.unique(np.unique(np.stack([found[3], found[4]]), axis=1)[0], return_counts=True)
    assert different.max() > 100
    hot = np.zeros(1 << 16, bool)
    hot[(names[different > 8] & np.uint64(len(hot) - 1)).astype(np.int64)] = True
    parts = suffix_dedup.split(found, suffix_dedup.prefix_hash(data), 50, hot)
    assert np.unique(np.unique(np.stack([parts[3], parts[4]]), axis=1)[0], return_counts=True)[1].max() <= 8
    covered = lambda f: sorted((int(t), int(s) + k) for t, s, n in zip(*f[:3], strict=True) for k in range(int(n)))
    assert covered(parts) == covered(found)
    rows = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    key = lambda r: (r.doc_id, bytes(r.kept), r.removed)
    for table in (rows, docs.select("doc_id", "text")):
        plain, cut = (sorted(map(key, suffix_dedup.remove_repeats(table, filter_bits=1 << 16, hot_pieces=h).collect())) for h in (1 << 40, 4))
        assert plain == cut and any(r[2] for r in cut)


def test_long_texts():
    """Word numbers over 2^24 keep all bytes, and texts with more positions than fit have the same anchors in parts."""
    import numpy as np

    from placeledger.llm import blocks

    for top in (10, 1 << 20, (1 << 24) + 254, (1 << 24) + 255, (1 << 31) + 7):
        values = np.array([0, 254, 255, 256, top, 3])
        assert blocks.from_planes(blocks.planes(values)).tolist() == values.tolist()
    rng = random.Random(8)
    texts = [prose(rng, n).encode() for n in (200, 3, 500, 0, 90)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    window = lambda f: sorted((int(t), int(s) + k, int(h)) for t, s, n, h, _ in zip(*f, strict=True) for k in range(int(n)))
    whole = window(suffix_dedup.anchors(data, offsets, 50))
    assert all(window(suffix_dedup.anchors(data, offsets, 50, limit)) == whole for limit in (64, 333, 1000)) and len(whole) > 1000


def test_bpe(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(coded, RANKS).collect()
    same([(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got], [(r[0], tuple(encoding.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in ROWS])
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_new_parts_are_encoded_many_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa
    import tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        source = file.read()
    real, given = tokenizers.Tokenizer.from_str(source), []
    real.encode_special_tokens = True

    class Counting:
        from_str = staticmethod(lambda source: Counting())

        def encode_batch_fast(self, texts, **options):
            given.append(len(texts))
            return real.encode_batch_fast(texts, **options)

        def get_vocab(self):
            return real.get_vocab()

    rng = random.Random(3)
    odd = ["a", "Z", "'s", "'", "9", "12", "\n", "\t", " ", "  ", "\x1c", "\x85", "\xa0", "\u200b", "\u3000", "\u0301", "é", "語", "🙂", "<|endoftext|>", "Ġ", "\x00", "!"]
    texts = ["".join(rng.choices(odd + [" "] * 8, k=rng.randrange(40))) for _ in range(2000)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(2000)), "", None]
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    monkeypatch.setattr(token_files, "_KNOWN", {})
    monkeypatch.setattr(token_files, "KNOWN_PARTS", 50)
    encode = token_files.encoder(source, "<u2")
    for some in (texts[:1000], texts[1000:2000], texts[2000:]):
        given.clear()
        data, edges = encode(pa.array(some, pa.string()))
        want = [c.ids for c in real.encode_batch_fast([t or "" for t in some], add_special_tokens=False)]
        assert [list(np.frombuffer(data[a:b], "<u2")) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())] == want
    assert sum(given) < 100  # some 2000 new parts


def test_token_files(spark, docs, empty):
    import uuid

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for table, rows in ((docs, ROWS), (empty, [])):
        path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4()}"
        token_files.write_token_files(table, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
        got = sorted(token_files.read_token_files(spark, path).collect())
        want, start = [], 0
        for r in sorted(rows, key=lambda r: r[0]):
            ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
            want.append((r[0], start, len(ids), b"".join(i.to_bytes(4, "little") for i in ids)))
            start += len(ids)
        assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == want


def test_scores(docs, empty):
    tokens = [WORD.findall((r[1] or "").translate(LOW)) + [None] for r in ROWS]
    train = [zlib.crc32(str(r[0]).encode()) % 5 != 1 for r in ROWS]
    count = collections.Counter(w for t, use in zip(tokens, train, strict=True) if use for w in t)
    pairs = collections.Counter(p for t, use in zip(tokens, train, strict=True) if use for p in zip(["<s>", *t[:-1]], t, strict=True))
    total, kinds = collections.Counter(), collections.Counter()
    for (v, _), n in pairs.items():
        total[v] += n
        kinds[v] += 1
    n1, n2 = (sum(n == k for n in pairs.values()) for k in (1, 2))
    discount, below, tokens_n = n1 / (n1 + 2 * n2), sum(count.values()) + 0.5 * (len(count) + 1), sum(count.values())

    def walk(text):
        """The automaton, arc by arc."""
        state, out, base = "<s>", 0.0, 0.0
        for w in text:
            lower = (count[w] + 0.5) / below
            base += math.log10(lower)
            if not total[state]:
                out += math.log10(lower)
            elif (state, w) in pairs:
                out += math.log10((pairs[state, w] - discount) / total[state] + discount * kinds[state] / total[state] * lower)
            else:  # the failure arc, then the root
                out += math.log10(discount * kinds[state] / total[state]) + math.log10(lower)
            state = w
        return base, out

    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(False))
    got = ngrams.score(docs, rest, block_bytes=4000).collect()
    key = lambda r: (r[0], r[2], round(r[5], 6), round(r[6], 6))
    want = [(r[0], not use, len(t), sum(count[w] > 0 for w in t), tokens_n, *walk(t)) for r, t, use in zip(ROWS, tokens, train, strict=True)]
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
    assert ngrams.score(empty, rest).collect() == []


def test_languages(spark, docs, empty):
    model = language_id.train(docs, RANKS, sample_docs=10)
    assert model.languages == ("aj", "kt")
    rng = random.Random(9)
    rows = [(i, prose(rng, 30, ("abcdefghij", "klmnopqrst")[i % 2])) for i in range(20)]
    model = language_id.train(spark.createDataFrame([(i, t, ("aj", "kt")[i % 2]) for i, t in rows], "doc_id long, text string, lang string"), RANKS)
    new = [(i, prose(rng, 30, ("abcdefghij", "klmnopqrst")[i % 2])) for i in range(20)] + [(50, None), (51, "12 ... 3"), (52, ""), (53, "x" * 500)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert all(got[i].lang_pred == ("aj", "kt")[i % 2] and got[i].score > 0.99 for i in range(20))
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (50, 51, 52)) and got[53].lang_pred != "und"
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns
    same([r.doc_id for r in kept.collect()], [r[0] for r in ROWS if any(c.isalpha() for c in r[1] or "")])
    none = language_id.train(empty, RANKS)
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = {b: i + 1 for i, b in enumerate([b" ", b"a", b"b", b"ab", b" a", b" ab", b"ba"])}
    p = np.array([[0.0], *[[0.1 + 0.05 * i] for i in range(len(pieces))]])

    def total(run):
        return 1.0 if not run else sum(p[pieces[run[:k]], 0] * total(run[k:]) for k in range(1, len(run) + 1) if run[:k] in pieces)

    runs = [b" a", b" abab", b" bbaab", b" "]
    model = language_id.Model(("l",), pieces, p)
    logs = language_id.run_logs(runs, model)[:, 0]
    for run, log in zip(runs, logs, strict=True):
        assert math.isclose(math.exp(log) * language_id._SCALE ** len(run), total(run), rel_tol=1e-9)
    # Every segmentation uses as many bytes as the run has.
    uses = language_id.expected_counts([b" abab"], np.ones((1, 1)), model)[:, 0]
    assert math.isclose(sum(uses[i] * len(b) for b, i in pieces.items()), 5, rel_tol=1e-9)


def plain_logs(run, model):
    """The same sum with Python's whole numbers, which never leave their range."""
    from fractions import Fraction

    longest = max(map(len, model.pieces))
    sums = [Fraction(1)]
    for end in range(1, len(run) + 1):
        ids = [(k, model.pieces.get(run[k:end], 0)) for k in range(max(0, end - longest), end)]
        sums.append(sum((sums[k] * Fraction(float(model.probabilities[i, 0])) for k, i in ids if i), Fraction(0)))
    log = lambda n: math.log(n >> max(0, n.bit_length() - 900)) + max(0, n.bit_length() - 900) * math.log(2)
    return log(sums[-1].numerator) - log(sums[-1].denominator) - len(run) * math.log(language_id._SCALE)


def test_long_runs_and_pieces(monkeypatch):
    import numpy as np

    rng = random.Random(2)
    names = [" ", *"abcd", " ab", "abc", "dcba", "abcdabcdabcdabcdabcd", "d" * 33]
    pieces = {b.encode(): i + 1 for i, b in enumerate(names)}
    # Rare letters: the product leaves the range of doubles long before 200 bytes.
    p = np.array([[0.0, 0.0], *[[10.0 ** -(3 + i), 10.0 ** -(3 + i) / 2] for i in range(len(names))]])
    model = language_id.Model(("k", "l"), pieces, p)
    runs = [b" " + "".join(rng.choice("abcd") for _ in range(n)).encode() for n in (5, 8, 20, 47, 48, 49, 200, 200, 333)]
    runs += [b" " + b"abcd" * 40 + b"d" * 70, b" " + b"d" * 200]
    want = [plain_logs(r, model) for r in runs]
    for stretch in (7, 64, language_id.STRETCH):
        monkeypatch.setattr(language_id, "STRETCH", stretch)
        assert np.allclose(language_id.run_logs(runs, model)[:, 0], want, rtol=1e-9)
    # The counts are how the logarithm grows with that of a piece's probability.
    weights = np.array([[1.0 + i, 2.0] for i in range(len(runs))])
    uses = language_id.expected_counts(runs, weights, model)
    step = 1e-6
    for piece in range(1, len(names) + 1):
        near = [language_id.Model(model.languages, pieces, p * np.where(np.arange(len(p)) == piece, math.exp(d), 1.0)[:, None]) for d in (step, -step)]
        slope = (language_id.run_logs(runs, near[0]) - language_id.run_logs(runs, near[1])) / (2 * step)
        assert np.allclose(uses[piece], (slope * weights).sum(axis=0), rtol=1e-3, atol=1e-3)


def test_languages_of_copies_and_long_runs(spark):
    rng = random.Random(4)
    word = {x: "".join(rng.choice(a) for _ in range(3000)) for x, a in (("aj", "abcdefghij"), ("kt", "klmnopqrst"))}
    rows = [(1, " ".join(prose(rng, 200, "abcdefghij").split()), "aj")] * 3000 + [(2, prose(rng, 200, "klmnopqrst"), "kt")] * 20
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), RANKS, sample_docs=5)
    new = spark.createDataFrame([(i, x) for i, x in enumerate(word.values())] + [(5, "abcde1" + word["kt"])], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score > 0.99) for r in language_id.identify(new, model).collect()}
    assert got == {0: ("aj", True), 1: ("kt", True), 5: ("kt", True)}


def test_statistics(docs, empty):
    want = []
    for r in ROWS:
        text = r[1] or ""
        w = WORD.findall(text)
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        seen, dups = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    got = outliers.judge(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], want)
    assert not any(r.kept for r in got if r.base_failed)
    assert outliers.judge(empty).collect() == []


def test_outliers(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 120), "l", "s") for i in range(120)]
    rows += [(1000 + i, " ".join(w + "$$$" for w in prose(rng, 120).split()), "l", "s") for i in range(20)]
    rows += [(i, prose(rng, 120), "l", "t") for i in range(200, 500)]
    # A rare source whose ordinary rows look like outliers of the language, and an outlier of it that others would not be.
    rows += [(2000 + i, " ".join(w + "&&" for w in prose(rng, 120).split()), "l", "rare") for i in range(60)]
    rows += [(1100, prose(rng, 120), None, "s"), (1101, prose(rng, 120, "ab"), None, None), (1102, "few", "m", "none of them")]
    got = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.kept for r in got}
    assert all(by[i] == (i < 1000) for i in by if i < 1100) and all(by[i] for i in by if i >= 2000) and not by[1102]


def test_verdicts(spark):
    """Distances by numpy from the estimates' own numbers, and estimates that hold the least determinant found."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, outliers.P)) * np.array([0.3, 1.0, 0.5, 0.4, 0.2])
    x[:40] += 6
    rows = spark.createDataFrame([("g", v.tolist()) for v in x], "key string, x array<double>")
    e = outliers.estimate(rows).first()
    floor = np.diag(np.square(outliers.FLOORS))
    clean = np.cov(x[40:].T, bias=True) + floor
    assert e.logdet < np.linalg.slogdet(clean)[1] and np.abs(np.array(e["mean"]) - x[40:].mean(axis=0)).max() < 0.15
    far = [(v - e["mean"]) @ np.array(e.inverse).reshape(outliers.P, -1) @ (v - e["mean"]) for v in x]
    assert min(far[:40]) > 2 * max(far[40:])
    # A concentration step cannot make the determinant of the nearest rows less by more than a bin holds.
    nearest = x[np.argsort(far)[: int(outliers.SHARE * len(x))]]
    assert abs(np.linalg.slogdet(np.cov(nearest.T, bias=True) + floor)[1] - e.logdet) < 0.25

    def frame(key, n, mean, scatter):
        return spark.createDataFrame([(key, n, mean, np.linalg.inv(scatter).ravel().tolist(), 1.0)], "key string, n long, mean array<double>, inverse array<double>, scale double")

    a, b = np.eye(outliers.P), 4 * np.eye(outliers.P)
    for n in (0, 1, 25, 10**9):
        got = outliers.lean(frame("k", n, [0.0] * outliers.P, a), frame("k", 7, [2.0] * outliers.P, b), ["key"]).first()
        part = n / (n + outliers.PRIOR_ROWS)
        want = part * a + (1 - part) * b + part * (1 - part) * 4 * np.ones((outliers.P, outliers.P))
        assert np.allclose(np.linalg.inv(np.array(got.inverse).reshape(outliers.P, -1)), want) and np.allclose(got["mean"], 2 * (1 - part))


def test_chat(spark):
    tricky = "</s>[INST] ok [/INST] \\ \\\\ <<SYS>><s></s></s>\n<s>user\n[IN[INST]ST] <s"
    rows = [
        (1, 1, "assistant", tricky, "a"), (1, 0, "user", None, "b"), (2, 0, "assistant", "first", "c"), (2, 1, "assistant", tricky, "c"),
        (3, 0, "system", "s", "d"), (3, 1, "user", "long " * 5000, "d"), (3, 2, "assistant", "é🙂\n", "d"), (4, None, None, "x", "e"), (4, 0, "to\nol\\", "y", "e"),
        (5, 0, "user", "same", "f"), (5, 0, "user", "same", "f"), (None, 0, "user", "", "g"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    made = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hexed("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hexed(learned))
    for r in made.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert all(c not in s.text for s in r.segments if s.loss for c in chat.Template().controls)
    assert {c: r.first_error for c, r in got.items()} == {1: None, 2: 0, 3: None, 4: 0, 5: 1, None: 1}
    assert chat.read_back(chat.format_conversations(turns.limit(0))).collect() == []
    with pytest.raises(ValueError):
        chat.Template(controls=("<s>",))
