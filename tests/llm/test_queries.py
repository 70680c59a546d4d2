"""Registered queries on the smallest data, and the pipeline against its brute-force version."""

import pytest

import corpus_pipeline
from placeledger.llm.queries import CHECKS, QUERIES
from tests import check


@pytest.fixture(scope="module")
def con(data):
    return check.connect(data)


def test_every_operator_has_a_query():
    assert sorted(int(name.split("_")[0][2:]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    assert check.compare(spark, con, data, QUERIES[name], CHECKS.get(name)) is None


def test_language_held_out(spark, data):
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, data).filter("held_out").collect()}
    rows = [r for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect() if r.doc_id in got and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) >= 0.95 * len(rows)


def test_model_is_better_than_base(spark, data):
    got = QUERIES["op3_lm_scoring"](spark, data).filter("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def test_pipeline(spark, data):
    """The kept documents, by plain Python over the whole table."""
    from tests.llm.test_operators import LOW, shingles

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items() if any(c.isalpha() for c in t)}
    keys = {i: [x.strip(" \t\n\v\f\r").translate(LOW) for x in t.split("\n")] for i, t in docs.items()}
    count: dict[str, int] = {}
    for ks in keys.values():
        for k in set(ks) - {""}:
            count[k] = count.get(k, 0) + 1
    docs = {i: "\n".join(x for x, k in zip(t.split("\n"), keys[i], strict=True) if count.get(k, 0) < 10) for i, t in docs.items()}
    sets = {i: shingles(t) for i, t in docs.items()}
    group = {i: i for i in docs}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    items = [shingles(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = {i for i in docs if find(i) == i and not any(s and 100 * len(sets[i] & s) >= 75 * len(s) for s in items)}
    got = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in got.collect()} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
