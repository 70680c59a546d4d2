"""Versions of a set of tables that change by key: untouched buckets of rows are carried over, the others are written anew.

Each table is dealt into buckets by a hash of its ``keys``. A version is a small JSON file, ``versions/<n>.json``, that names the
Parquet folder of every bucket of every table, with a digest of its rows. It is written last, under a name that must not exist
yet: a writer that dies before leaves the last version as it was, and of two writers that start from one version the second
gets a :class:`Conflict`. A writer that is run again with its own ``writer`` name finds its version there and is done.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placeledger.operators import sets as st

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has written this version."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last version, -1 if there is none."""
    at, fs = _path(spark, f"{root}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    if version < 0:
        return {"tables": {}, "writer": None}
    return json.loads(spark.read.text(f"{root}/versions/{version}.json", wholetext=True).first()[0])


def _put(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Write a version's file in full under another name, then give it its own, which must be free."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    draft, fs = _path(spark, f"{root}/versions/.draft-{uuid.uuid4()}")
    out = fs.create(draft, False)
    out.write(json.dumps(content).encode())
    out.close()
    files = jvm.org.apache.hadoop.fs
    how = getattr(files, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.NONE
    try:
        files.FileContext.getFileContext(draft.toUri(), conf).rename(draft, _path(spark, f"{root}/versions/{version}.json")[0], options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise Conflict(f"version {version} of {root} is there already") from e
        raise


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _digests(rows: DataFrame) -> dict[str, str]:
    """For each bucket the number of its rows and the sum of their hashes, in no order."""
    own = F.to_json(F.struct(*[c for c in rows.columns if c != BUCKET]), {"ignoreNullFields": "false"})
    sums = rows.groupBy(BUCKET).agg(F.count("*").alias("n"), F.sum(F.xxhash64(own).cast("decimal(38,0)")).alias("sum"))
    return {str(r[0]): f"{r[1]}:{r[2]}" for r in sums.collect()}


def _folders(table: dict, root: str, buckets: Iterable[str] | None = None) -> list[str]:
    some = table["folders"] if buckets is None else [b for b in buckets if b in table["folders"]]
    return [f"{root}/data/{table['folders'][b]}/{BUCKET}={b}" for b in some]


def _read(spark: SparkSession, table: dict, paths: list[str]) -> DataFrame:
    schema = StructType.fromJson(table["schema"])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the last by default."""
    version = latest(spark, root) if version is None else version
    table = manifest(spark, root, version)["tables"][name]
    return _read(spark, table, _folders(table, root))


def _rewritten(table: dict, rows: DataFrame, root: str, digests: dict[str, str], touched: set[str]) -> dict:
    """The table with ``touched`` buckets as in ``rows``; a bucket without a digest has no rows left."""
    folder = str(uuid.uuid4())
    live = sorted(int(b) for b in touched if b in digests)
    if live:
        own = rows.filter(F.col(BUCKET).isin(live)) if len(live) < table["buckets"] else rows
        own.repartition(len(live), BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/data/{folder}")
    kept = {b: f for b, f in table["folders"].items() if b not in touched}
    return table | {
        "folders": kept | {str(b): folder for b in live},
        "digests": {b: d for b, d in table["digests"].items() if b not in touched} | {b: digests[b] for b in map(str, live)},
    }


def _done(spark: SparkSession, root: str, base: int, writer: str | None) -> bool:
    """Whether this writer's version is there; a conflict if another's is."""
    if latest(spark, root) <= base:
        return False
    if writer is None or manifest(spark, root, base + 1)["writer"] != writer:
        raise Conflict(f"version {base + 1} of {root} is there already")
    return True


def commit(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], base: int, keys: dict[str, list[str]] | None = None,
    buckets: int = 64, writer: str | None = None,
) -> int:
    """Write whole tables as version ``base`` + 1 and give its number; only buckets with another digest than before are written.

    Each table is evaluated twice, for the digests and for the rows that changed. ``keys`` and ``buckets`` are for tables that
    are new; tables that are not given stay as they are.
    """
    if _done(spark, root, base, writer):
        return base + 1
    content = manifest(spark, root, base)
    for name, df in tables.items():
        table = content["tables"].get(name) or {"keys": keys[name], "buckets": buckets, "folders": {}, "digests": {}}
        table = table | {"schema": df.schema.jsonValue()}
        rows = _bucketed(df, table["keys"], table["buckets"])
        new, old = _digests(rows), table["digests"]
        touched = {b for b in new.keys() | old.keys() if new.get(b) != old.get(b)}
        content["tables"][name] = _rewritten(table, rows, root, new, touched)
    _put(spark, root, base + 1, content | {"writer": writer})
    return base + 1


def upsert(
    spark: SparkSession, root: str, name: str, updates: DataFrame, base: int | None = None,
    merge: dict[str, Column] | None = None, writer: str | None = None,
) -> int:
    """Bring ``updates`` (one row per key) into a table, as :func:`sets.snapshot_upsert` does, and give the new version's number.

    Only the buckets that the updates fall into are read and written. ``updates`` is evaluated three times; cut it if it is costly.
    """
    base = latest(spark, root) if base is None else base
    if _done(spark, root, base, writer):
        return base + 1
    content = manifest(spark, root, base)
    table = content["tables"][name]
    hit = _bucketed(updates, table["keys"], table["buckets"]).select(BUCKET).distinct()
    touched = {str(r[0]) for r in hit.collect()}
    old = _read(spark, table, _folders(table, root, touched))
    rows = _bucketed(st.snapshot_upsert(old, updates, table["keys"], merge), table["keys"], table["buckets"])
    content["tables"][name] = _rewritten(table, rows, root, _digests(rows), touched)
    _put(spark, root, base + 1, content | {"writer": writer})
    return base + 1
