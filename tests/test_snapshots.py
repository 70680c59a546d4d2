"""Versions of tables: only touched buckets are written, and killed or doubled writers leave one readable version."""

import pytest

from placeledger.sources import snapshots as sn


@pytest.fixture
def root(spark, tmp_path):
    rows = [(i, f"s{i}", None if i % 3 else i) for i in range(200)]
    path = str(tmp_path / "dir")
    sn.commit(spark, path, {"stores": spark.createDataFrame(rows, "id long, name string, n long")}, -1, {"stores": ["id"]}, buckets=16)
    return path


def rows_of(spark, root, version=None):
    return sorted(map(tuple, sn.read(spark, root, "stores", version).collect()), key=lambda r: r[0])


def test_upsert_rewrites_touched_buckets_only(spark, root):
    before = sn.manifest(spark, root, 0)["tables"]["stores"]
    updates = spark.createDataFrame([(3, "new 3", 1), (999, "s999", None)], "id long, name string, n long")
    assert sn.upsert(spark, root, "stores", updates) == 1
    after = sn.manifest(spark, root, 1)["tables"]["stores"]
    moved = {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)}
    assert 1 <= len(moved) <= 2 and len(after["folders"]) == 16
    want = {r[0]: r for r in rows_of(spark, root, 0)} | {3: (3, "new 3", 1), 999: (999, "s999", None)}
    assert rows_of(spark, root) == sorted(want.values(), key=lambda r: r[0])
    assert len(rows_of(spark, root, 0)) == 200


def test_commit_writes_what_changed(spark, root):
    table = sn.read(spark, root, "stores")
    assert sn.commit(spark, root, {"stores": table}, 0) == 1
    assert sn.manifest(spark, root, 1)["tables"] == sn.manifest(spark, root, 0)["tables"]
    assert sn.commit(spark, root, {"stores": table.filter("id <> 7")}, 1) == 2
    a, b = (sn.manifest(spark, root, v)["tables"]["stores"]["folders"] for v in (1, 2))
    assert len([k for k in a if a[k] != b.get(k)]) == 1
    assert [r[0] for r in rows_of(spark, root)] == [i for i in range(200) if i != 7]
    assert sn.commit(spark, root, {"stores": table.filter("false")}, 2) == 3
    assert rows_of(spark, root) == []


def test_two_writers(spark, root, monkeypatch):
    one = spark.createDataFrame([(1, "one", None)], "id long, name string, n long")
    two = spark.createDataFrame([(1, "two", None)], "id long, name string, n long")
    sn.upsert(spark, root, "stores", one, base=0, writer="a")
    with pytest.raises(sn.Conflict):
        sn.upsert(spark, root, "stores", two, base=0, writer="b")
    # Both looked before either wrote: the name of the version decides.
    monkeypatch.setattr(sn, "_done", lambda *_: False)
    with pytest.raises(sn.Conflict):
        sn.upsert(spark, root, "stores", two, base=0, writer="b")
    monkeypatch.undo()
    assert sn.latest(spark, root) == 1 and rows_of(spark, root)[1] == (1, "one", None)
    # The same writer once more is done already.
    assert sn.upsert(spark, root, "stores", one, base=0, writer="a") == 1
    assert sn.latest(spark, root) == 1


def test_killed_writer(spark, root, monkeypatch):
    before = rows_of(spark, root)
    updates = spark.createDataFrame([(1, "one", None)], "id long, name string, n long")

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(sn, "_put", die)
    with pytest.raises(KeyboardInterrupt):
        sn.upsert(spark, root, "stores", updates)
    monkeypatch.undo()
    assert sn.latest(spark, root) == 0 and rows_of(spark, root) == before
    assert sn.upsert(spark, root, "stores", updates) == 1
    assert rows_of(spark, root)[1] == (1, "one", None)
