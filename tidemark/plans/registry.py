"""All registered queries of the library: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query under name, with its DuckDB SQL."""

    def add(f: Query) -> Query:
        if name in _ALL:
            raise ValueError(f"{name} is registered twice")
        _ALL[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _ALL.items()}


def oracles() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _ALL.items() if s}


def _load() -> None:
    """Importing these modules registers their queries; done when they are asked for, as the modules import this one."""
    from . import aggregate, governance, graph, knowledge, learner, models, more, retrieval, select, stream  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_rrf"](spark, sf_dir)
