"""Exact quantiles and ranks without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from usageloom.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _magnitude_bucket(value: Column) -> Column:
    """Order-preserving bucket about 0.2 % wide; at most some 40,000 of them exist."""
    size = F.floor(F.log1p(F.abs(value) * F.lit(1e6)) * F.lit(512.0))
    return (F.signum(value) * size).cast("bigint")


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for name in names:
        cond = cond & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return cond


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, ps: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Linearly interpolated quantiles per group, plus ``n`` (NULL values are left out).

    The builtin ``percentile`` keeps every distinct value of a group in one
    buffer, which a hot group cannot afford.  Here equal values are counted
    first, a histogram of bounded size locates the ranks that are needed, and
    only the buckets holding them are sorted.
    """
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", _magnitude_bucket(F.col("_v")))
    )
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    below = group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    hist = (
        counts.groupBy(*by, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("_before", F.coalesce(F.sum("_bc").over(below), F.lit(0)))
        .withColumn("_n", F.sum("_bc").over(group))
    )

    def point(p: float) -> Column:
        return (F.col("_n") - 1) * F.lit(float(p))

    wanted = []
    for i, p in enumerate(ps):
        low = F.floor(point(p)).cast("bigint")
        high = F.least(low + 1, F.col("_n") - 1)
        for side, rank in ((0, low), (1, high)):
            wanted.append(F.struct(F.lit(2 * i + side).alias("slot"), rank.alias("rank")))
    hist = hist.withColumn(
        "_need",
        F.filter(
            F.array(*wanted),
            lambda x: (x["rank"] >= F.col("_before"))
            & (x["rank"] < F.col("_before") + F.col("_bc")),
        ),
    ).where(F.size("_need") > 0)

    inside = W.partitionBy(*by, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    hits = (
        counts.alias("c")
        .join(hist.alias("h"), _same("c", "h", by + ["_b"]))
        .select("c.*", "h._before", "h._n", "h._need")
        .withColumn("_first", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
        .withColumn(
            "_hit",
            F.explode(
                F.filter(
                    "_need",
                    lambda x: (x["rank"] >= F.col("_first"))
                    & (x["rank"] < F.col("_first") + F.col("_c")),
                )
            ),
        )
    )
    slots = [
        F.max(F.when(F.col("_hit.slot") == s, F.col("_v"))).alias(f"_s{s}")
        for s in range(2 * len(ps))
    ]
    found = hits.groupBy(*by).agg(F.max("_n").alias("_n"), *slots)
    out = []
    for i, (p, name) in enumerate(zip(ps, names)):
        low, high = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        out.append((low + (high - low) * (point(p) - F.floor(point(p)))).alias(name))
    return found.select(*by, F.col("_n").alias("n"), *out)


def approx_quantiles(
    df: DataFrame, by: Sequence[str], value: str, ps: Sequence[float], names: Sequence[str],
    accuracy: int = 10_000,
) -> DataFrame:
    """Sketch-based alternative for dashboards that may be off by ``1/accuracy`` in rank."""
    q = F.percentile_approx(value, [float(p) for p in ps], accuracy)
    out = df.groupBy(*by).agg(F.count(value).alias("n"), q.alias("_q"))
    return out.select(*by, "n", *[F.get("_q", F.lit(i)).alias(a) for i, a in enumerate(names)])


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based rank over the whole frame in a total order, and the row count ``total``.

    Range partitioning spreads the sort over all executors; the partition sizes
    (one row each) give the offsets.  ``order`` must end in a unique key.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftright("_id", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    everything = W.partitionBy(F.lit(0))
    sizes = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_size").over(
                everything.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
        F.sum("_size").over(everything).alias("total"),
    )
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(sizes, "_part")
        .withColumn(name, row + F.col("_offset") + 1)
        .drop("_part", "_offset", "_id")
    )
