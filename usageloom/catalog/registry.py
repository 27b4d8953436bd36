"""Registry of runnable queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usageloom.sources.adapters import DriverLedger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(ledger) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[DriverLedger], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(DriverLedger(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def usd(c) -> Column:
    """Money as compared between engines: float sums depend on the order of addition."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 8)


def r6(c) -> Column:
    """Ratios, means and medians as compared between engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


def us(c) -> Column:
    return F.unix_micros(c)


def count(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(
        *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns]
    )
