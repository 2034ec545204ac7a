"""Registration of queries with their SQL texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for an exact comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def off_ties(df: DataFrame, *columns: str) -> DataFrame:
    """Means of few five-decimal values often end in a 5 exactly where the comparison rounds, and
    the engines add in different orders; both sides are nudged by the same tiny amount."""
    return df.withColumns({c: F.col(c) + F.lit(1e-9) for c in columns})


def query(name: str, sql: str | None = None, using: Sequence[str] = ("assess",), digits: int = 6):
    """Register ``fn(spark, folder)``; ``sql`` reads the views named in ``using``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: rounded(fn(spark, folder), digits)
        if sql is not None:
            ORACLES[name] = views.sql(sql, *using)
        return fn

    return add
