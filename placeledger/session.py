"""Session settings and the two guards every wide job here uses: written cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when the optimizer's own size estimate is under this many bytes.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

# Bytes of a batch that Python gets at once. A batch of page texts takes many times its bytes there, on each core; Spark's own
# limits (10,000 rows, 64 MB) let a worker's memory grow with the table until batches are full.
BATCH_BYTES = 2 * 1024 * 1024


def build_session(app: str = "placeledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for. A cluster passes its own master and sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        # Keyed stream state on the executors' disks, not in their heaps.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and streaming state.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="placeledger-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from there.

    A lost executor then replays little, and later joins know the real size of the table.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4()}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _open_scratch():
        _open_scratch()[-1].tables[id(out)] = (out, path)
    return out


_LOCAL = threading.local()


def _open_scratch() -> list[Scratch]:
    if not hasattr(_LOCAL, "open"):
        _LOCAL.open = []
    return _LOCAL.open


class Scratch:
    """The tables that :func:`cut` wrote within a ``with scratch(...)`` block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[int, tuple[DataFrame, str]] = {}

    def drop(self, *superseded: DataFrame) -> None:
        """Remove tables that nothing is read from any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in superseded:
            _, path = self.tables.pop(id(df), (None, None))
            if path:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """Let a table outlive the block; an outer block then has to drop it."""
        held = self.tables.pop(id(df), None)
        outer = _open_scratch()[:-1]
        if held and outer:
            outer[-1].tables[id(df)] = held
        return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables cut within the block are removed at its end, but those that are kept. Results must be cut and kept."""
    own = Scratch(spark)
    _open_scratch().append(own)
    try:
        yield own
    finally:
        _open_scratch().remove(own)
        own.drop(*[df for df, _ in list(own.tables.values())])


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; reads statistics only, runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its estimate is under ``limit``; otherwise leave the join strategy to Spark."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spread(df: DataFrame, per_core: int = 32 * 1024 * 1024) -> DataFrame:
    """Give every core a part of a small table that costs much work per byte (page texts, say).

    A table of fewer bytes than ``per_core`` for each core may sit in a single file, and so in a single task; it is cheap
    to move. A larger one already comes in enough tasks and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < per_core * cores else df


def deal(df: DataFrame) -> DataFrame:
    """Deal rows that cost much work each evenly over the cores: a table derived from a file or two comes in as many tasks."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
