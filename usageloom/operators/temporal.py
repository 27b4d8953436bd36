"""Ordered look-back and temporal joins that do not depend on small groups.

A window function handles each partition key in one task.  Because one session
or lineage may hold a large share of all rows, keys are split into time
buckets.  What a bucket must know of earlier ones is taken from the last row of
each bucket, a table with one row per key and bucket.

Rows are shuffled once: the branch that looks at the edges of buckets keeps the
same columns as the main one, so that Spark reuses the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOUR_US = 3_600_000_000
_KEYS = ("_k", "_b")


def _bucket(us: Column, width_us: int) -> Column:
    return F.floor(us / F.lit(float(width_us))).cast("bigint")


def _keyed(df: DataFrame, key: str, us: Column, bucket_us: int) -> DataFrame:
    return (
        df.withColumn("_us", us)
        .withColumn("_k", F.col(key))
        .withColumn("_b", _bucket(F.col("_us"), bucket_us))
    )


def _neighbour(
    df: DataFrame, key: str, us: Column, tie: str, columns: Sequence[str], bucket_us: int,
    name: str, step: int,
) -> DataFrame:
    """Struct of the row ``step`` (-1 or 1) away in the order of a key.

    Inside a bucket that is a window function.  The rows at the edges of buckets
    are ordered once more per key: there the neighbour of a bucket's first row
    is the last row of the bucket before it, and the other way round.
    """
    payload = F.struct(*columns)
    inside = W.partitionBy(*_KEYS).orderBy("_us", tie)
    along = W.partitionBy("_k").orderBy("_us", tie)
    near, far = (F.lag, F.lead) if step < 0 else (F.lead, F.lag)
    marked = (
        _keyed(df, key, us, bucket_us)
        .withColumn("_near", near(payload).over(inside))
        .withColumn("_edge", far(F.lit(1)).over(inside).isNull())
    )
    within = marked.where(F.col("_near").isNotNull()).withColumn(name, F.col("_near"))
    edges = (
        marked.where(F.col("_near").isNull() | F.col("_edge"))
        .withColumn(name, near(payload).over(along))
        .where(F.col("_near").isNull())
    )
    return within.unionByName(edges).drop("_us", "_near", "_edge", *_KEYS)


def with_previous(
    df: DataFrame, key: str, us: Column, tie: str, columns: Sequence[str],
    bucket_us: int = HOUR_US, name: str = "prev",
) -> DataFrame:
    """Add struct ``name`` with ``columns`` of the preceding row of the same key.

    Order is (``us``, ``tie``); the struct is NULL on a key's first row.
    """
    return _neighbour(df, key, us, tie, columns, bucket_us, name, -1)


def with_next(
    df: DataFrame, key: str, us: Column, tie: str, columns: Sequence[str],
    bucket_us: int = HOUR_US, name: str = "next",
) -> DataFrame:
    """Add struct ``name`` with ``columns`` of the following row of the same key."""
    return _neighbour(df, key, us, tie, columns, bucket_us, name, 1)


def _with_ghosts(df: DataFrame, key: str, us: Column, flag: Column, within_us: int) -> DataFrame:
    """Keyed rows with ``_hit`` (time of a flagged row), and each hit once more in the next bucket.

    A look-back of one bucket width sees its own bucket and the one before, so
    the repeated hits, which carry only key and time, replace any other lookup.
    """
    rows = _keyed(df, key, us, within_us).withColumn("_real", F.lit(True)).withColumn(
        "_hit", F.when(flag, F.col("_us"))
    )
    ghosts = _keyed(df.where(flag), key, us, within_us).select(
        "_us", "_k", (F.col("_b") + 1).alias("_b"), F.lit(False).alias("_real"), F.col("_us").alias("_hit")
    )
    return rows.unionByName(ghosts, allowMissingColumns=True)


def _last_hit() -> Column:
    earlier = W.partitionBy(*_KEYS).orderBy("_us").rangeBetween(W.unboundedPreceding, -1)
    return F.max("_hit").over(earlier)


def with_seen_within(
    df: DataFrame, key: str, us: Column, flag: Column, within_us: int, name: str = "seen"
) -> DataFrame:
    """Whether ``flag`` held for the key strictly before the row and less than ``within_us`` ago."""
    marked = _with_ghosts(df, key, us, flag, within_us).withColumn("_last", _last_hit())
    seen = F.coalesce(F.col("_us") - F.col("_last") < within_us, F.lit(False))
    return marked.where("_real").withColumn(name, seen).drop("_us", "_real", "_hit", "_last", *_KEYS)


def with_previous_and_seen(
    df: DataFrame, key: str, us: Column, tie: str, columns: Sequence[str], flag: Column,
    within_us: int,
) -> DataFrame:
    """``with_previous`` (as ``prev``) and ``with_seen_within`` (as ``seen``) in one pass."""
    payload = F.when(F.col("_real"), F.struct(*columns))
    order = W.partitionBy(*_KEYS).orderBy("_us", tie)
    along = W.partitionBy("_k").orderBy("_us", tie)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    marked = (
        _with_ghosts(df, key, us, flag, within_us)
        .withColumn("_near", F.last(payload, ignorenulls=True).over(before))
        .withColumn("_edge", F.lead(F.lit(1)).over(order).isNull())
        .withColumn("_last", _last_hit())
        .where("_real")
        .withColumn("seen", F.coalesce(F.col("_us") - F.col("_last") < within_us, F.lit(False)))
    )
    within = marked.where(F.col("_near").isNotNull()).withColumn("prev", F.col("_near"))
    edges = (
        marked.where(F.col("_near").isNull() | F.col("_edge"))
        .withColumn("prev", F.lag(payload).over(along))
        .where(F.col("_near").isNull())
    )
    return within.unionByName(edges).drop("_us", "_real", "_hit", "_near", "_edge", "_last", *_KEYS)


def _fill_from_earlier(marked: DataFrame, order: Sequence[str], running: Sequence[str]) -> DataFrame:
    """Complete running values of a bucket with those of the buckets before it.

    ``marked`` holds ``_row`` and, per row, values running within its bucket;
    ``running`` become running values of the whole key.
    """
    last_in_bucket = F.lead(F.lit(1)).over(W.partitionBy(*_KEYS).orderBy(*order)).isNull()
    # The condition on _row is always true; it keeps this branch on the columns of the other.
    same_columns = F.col("_row").isNotNull() | F.col("_b").isNotNull()
    tails = marked.withColumn("_tail", last_in_bucket).where(F.col("_tail") & same_columns)
    earlier = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = tails.select(
        *_KEYS, *[F.last(c, ignorenulls=True).over(earlier).alias(f"_c{c}") for c in running]
    )
    filled = marked.where(F.col("_row").isNotNull()).join(carry, list(_KEYS), "left")
    for c in running:
        filled = filled.withColumn(c, F.coalesce(c, f"_c{c}"))
    return filled


def last_non_null(
    df: DataFrame, key: str, order: Sequence[str], bucket: Sequence[str], value: str, name: str,
) -> DataFrame:
    """Forward fill of ``value`` along ``order`` within ``key``, the current row included.

    ``bucket`` are the leading columns of ``order`` (such as the file and block a
    row came from) that split a key into pieces of bounded size.
    """
    rows = df.select(
        F.col(key).alias("_k"), F.struct(*bucket).alias("_b"), F.struct(*order).alias("_us"),
        F.col(value).alias("_value"), F.struct(*df.columns).alias("_row"),
    )
    inside = W.partitionBy(*_KEYS).orderBy("_us").rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("_in", F.last("_value", ignorenulls=True).over(inside))
    return _fill_from_earlier(marked, ["_us"], ["_in"]).select("_row.*", F.col("_in").alias(name))


def _stack(
    left: DataFrame, right: DataFrame, by: str, left_us: Column, right_us: Column,
    extra: Sequence[Column], bucket_us: int,
) -> DataFrame:
    """Both sides of a temporal join as one frame; ``_row`` holds a left row, else NULL."""
    a = left.select(
        F.col(by).alias("_k"), left_us.alias("_us"), F.struct(*left.columns).alias("_row")
    )
    b = right.where(F.col(by).isNotNull()).select(F.col(by).alias("_k"), right_us.alias("_us"), *extra)
    return a.unionByName(b, allowMissingColumns=True).withColumn(
        "_b", _bucket(F.col("_us"), bucket_us)
    )


def asof_backward(
    left: DataFrame, right: DataFrame, by: str, left_us: Column, right_us: Column, tie: str,
    columns: Sequence[str], name: str = "match", bucket_us: int = HOUR_US,
) -> DataFrame:
    """Attach to each left row the latest right row at or before it.

    Both sides are merged and sorted once, so the work is linear in their sizes
    however many rows share a key.  Of equal right times the largest ``tie``
    wins.  Left rows without a match get a NULL struct.
    """
    taken = F.struct(*[F.col(c) for c in columns], right_us.alias("match_us"))
    both = _stack(
        left, right, by, left_us, right_us,
        [F.col(tie).cast("string").alias("_tie"), taken.alias("_take")], bucket_us,
    ).withColumn("_side", F.col("_row").isNotNull().cast("int"))
    order = ["_us", "_side", "_tie"]
    inside = W.partitionBy(*_KEYS).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    marked = both.withColumn("_in", F.last("_take", ignorenulls=True).over(inside))
    return _fill_from_earlier(marked, order, ["_in"]).select("_row.*", F.col("_in").alias(name))


def latest_per_channel(
    left: DataFrame, right: DataFrame, by: str, left_us: Column, right_us: Column,
    channels: dict[str, Column], bucket_us: int = HOUR_US,
) -> DataFrame:
    """For each left row and channel, the largest channel value among right rows at or before it.

    ``channels`` maps output names to expressions on ``right`` that do not fall
    over time, NULL where a row does not belong to the channel.  All channels
    share one sort of both sides.
    """
    names = list(channels)
    values = [c.alias(f"_v_{n}") for n, c in channels.items()]
    both = _stack(left, right, by, left_us, right_us, values, bucket_us)
    # A range frame includes right rows of the same instant wherever they sort.
    inside = W.partitionBy(*_KEYS).orderBy("_us").rangeBetween(W.unboundedPreceding, 0)
    marked = both
    for n in names:
        marked = marked.withColumn(f"_in_{n}", F.max(f"_v_{n}").over(inside))
    filled = _fill_from_earlier(marked, ["_us"], [f"_in_{n}" for n in names])
    return filled.select("_row.*", *[F.col(f"_in_{n}").alias(n) for n in names])


def band_join(
    intervals: DataFrame, points: DataFrame, by: str, start_us: Column, width_us: int,
    point_us: Column,
) -> DataFrame:
    """Points with ``start < point <= start + width`` of the same key, one row per pair.

    An interval of fixed width touches two time buckets, so the equi join is on
    key and bucket and a pair is only formed within twice the width.
    """
    first = _bucket(start_us, width_us)
    a = intervals.withColumn("_start", start_us).withColumn(
        "_b", F.explode(F.array(first, first + 1))
    )
    b = points.withColumn("_point", point_us).withColumn("_b", _bucket(F.col("_point"), width_us))
    return (
        a.join(b, [by, "_b"])
        .where((F.col("_point") > F.col("_start")) & (F.col("_point") <= F.col("_start") + width_us))
        .drop("_b")
    )
