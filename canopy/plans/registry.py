"""Registry of named queries (one per operator ID) and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .slice import min_slice

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


register("a8_median_predictor_cv", oracle.MIN_SLICE_SQL)(min_slice)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_slice(spark, sf_dir)


def queries() -> dict[str, Query]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def _load_all() -> None:
    """Import the modules that register further queries."""
    from . import queries_clean  # noqa: F401
    from . import queries_boost  # noqa: F401
    from . import queries_select  # noqa: F401
    from . import queries_stumps  # noqa: F401
    from . import queries_trees  # noqa: F401
    from . import queries_study  # noqa: F401
