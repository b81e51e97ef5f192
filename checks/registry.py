"""Where every module of this folder registers its queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_shared: dict[tuple, DataFrame] = {}


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def shared(name: str):
    """Stage a result once per session and input folder, for the queries that build on it."""
    def wrap(fn):
        def get(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _shared:
                _shared[key] = staged(fn(spark, sf_dir), name)
            return _shared[key]

        get.fresh = fn
        return get

    return wrap


def forget() -> None:
    """Drop staged results, so that a benchmark measures whole queries."""
    _shared.clear()


def stamp(c):
    """Stamp as text."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def flat(arr, sep: str = ";"):
    return F.array_join(arr.cast("array<string>"), sep)
