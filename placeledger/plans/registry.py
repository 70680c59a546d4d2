"""The table of registered queries: name -> (function over the directory views, check SQL or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placeledger.plans.views import Directory, check_ctes
from placeledger.session import BATCH_BYTES

_QUERIES: dict[str, Callable[[Directory], DataFrame]] = {}
_CHECKS: dict[str, str] = {}
_STORED: dict[str, str] = {}


def use_tables(sf_dir: str, path: str) -> None:
    """Let the queries over ``sf_dir`` read the directory tables stored under ``path``."""
    _STORED[sf_dir.rstrip("/")] = path


def query(check: str | None = None, name: str | None = None):
    """Register a query function. ``check`` is the equivalent SQL over the views, where SQL can express it."""

    def add(fn):
        key = name or fn.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = fn
        if check is not None:
            _CHECKS[key] = check
        return fn

    return add


def _load() -> None:
    import importlib
    import pkgutil

    from placeledger import plans

    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"placeledger.plans.{module.name}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Times in the views have no zone; results must not depend on the machine's.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # Nor may a worker's memory grow with the table, whoever made the session.
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
            return fn(Directory(spark, sf_dir, tables=_STORED.get(sf_dir.rstrip("/"))))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_checks() -> dict[str, str]:
    _load()
    return {name: check_ctes(sql) for name, sql in _CHECKS.items()}
