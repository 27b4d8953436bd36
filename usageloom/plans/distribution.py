"""Distribution of cost over prompts (A-21, A-22, A-23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from usageloom.functions.quantiles import approx_quantiles, exact_quantiles, global_rank
from usageloom.functions.scalar import share
from usageloom.operators.rollups import top_k_others

PS = (0.5, 0.9, 0.95, 0.99)
P_NAMES = ("p50", "p90", "p95", "p99")
BANDS = ((0, "<200k"), (200_000, "≥200k–<500k"), (500_000, "≥500k"))
MIN_STABLE = 20


def priced_prompts(prompts: DataFrame) -> DataFrame:
    """Prompts with a known cost; the others are counted by ``unpriced_prompts``."""
    return prompts.where(F.col("cost_usd").isNotNull())


def unpriced_prompts(prompts: DataFrame) -> DataFrame:
    return prompts.agg(F.count_if(F.col("cost_usd").isNull()).alias("unpriced_prompts"))


def cost_quantiles(
    prompts: DataFrame, top: int = 7, min_n: int = MIN_STABLE, approximate: bool = False
) -> DataFrame:
    """Cost quantiles of the ``top`` projects, the rest, all prompts and those of people (A-21).

    For a single project with fewer than ``min_n`` prompts the upper quantiles
    are left NULL.
    """
    known = priced_prompts(prompts).select("project", "cost_usd", "automatic")
    projects = known.groupBy("project").agg(F.sum("cost_usd").alias("total"))
    labels = top_k_others(projects, "project", "total", top).select(
        F.col("project").alias("_project"), "label", "is_top"
    )
    tagged = known.join(labels, F.col("project").eqNullSafe(F.col("_project")))
    groups = F.array(
        F.struct(F.when(F.col("is_top") == 1, F.lit("project")).otherwise(F.lit("others")).alias("scope"),
                 F.col("label").alias("label")),
        F.struct(F.lit("all").alias("scope"), F.lit("all").alias("label")),
        F.struct(F.when(F.col("automatic") == 0, F.lit("interactive")).alias("scope"),
                 F.lit("interactive").alias("label")),
    )
    rows = tagged.select("cost_usd", F.explode(groups).alias("g")).where(
        F.col("g.scope").isNotNull()
    ).select("g.scope", "g.label", "cost_usd")
    quantiles = approx_quantiles if approximate else exact_quantiles
    found = quantiles(rows, ["scope", "label"], "cost_usd", PS, P_NAMES)
    totals = rows.groupBy("scope", "label").agg(F.sum("cost_usd").alias("cost_usd"))
    unstable = (F.col("scope") == "project") & (F.col("n") < min_n)
    return found.join(totals, ["scope", "label"]).select(
        "scope", "label", "n", "cost_usd", "p50",
        *[F.when(~unstable, F.col(p)).alias(p) for p in P_NAMES[1:]],
    )


def _band(peak: Column) -> Column:
    out = F.lit(BANDS[0][1])
    for low, name in BANDS[1:]:
        out = F.when(peak >= low, F.lit(name)).otherwise(out)
    return out


def context_bands(prompts: DataFrame) -> DataFrame:
    """Prompts by peak main-thread context, for all and for those of people (A-22)."""
    known = priced_prompts(prompts).where(F.col("peak_context").isNotNull())
    rows = known.select(
        "prompt_id", "cost_usd", "peak_family", _band(F.col("peak_context")).alias("band"),
        F.explode(
            F.when(F.col("automatic") == 0, F.array(F.lit("all"), F.lit("interactive"))).otherwise(
                F.array(F.lit("all"))
            )
        ).alias("scope"),
    )
    keys = ["scope", "band"]
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_prompts"), F.sum("cost_usd").alias("cost_usd")
    )
    whole = W.partitionBy("scope")  # three rows per scope
    totals = totals.withColumn(
        "count_share_pct", share(F.col("n_prompts"), F.sum("n_prompts").over(whole))
    ).withColumn("cost_share_pct", share(F.col("cost_usd"), F.sum("cost_usd").over(whole)))
    median = exact_quantiles(rows, keys, "cost_usd", (0.5,), ("median_usd",)).drop("n")

    by_family = rows.groupBy(*keys, "peak_family").agg(F.count(F.lit(1)).alias("n"))
    families = _joined_top(
        by_family, keys, [F.desc("n"), F.asc("peak_family")],
        F.concat_ws(" ", "peak_family", F.col("n").cast("string")), "main_families",
    )
    # row_number <= 2 is pushed below the shuffle, so each task sends two rows per band.
    examples = _joined_top(
        rows, keys, [F.desc("cost_usd"), F.asc("prompt_id")], F.col("prompt_id"), "examples"
    )
    return totals.join(median, keys).join(families, keys).join(examples, keys)


def _joined_top(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], text: Column, name: str, k: int = 2
) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    top = df.withColumn("_rn", rank).where(F.col("_rn") <= k)
    entries = F.array_sort(F.collect_list(F.struct("_rn", text.alias("t"))))  # k entries
    return top.groupBy(*keys).agg(
        F.array_join(F.transform(entries, lambda e: e["t"]), ", ").alias(name)
    )


def missing_peaks(prompts: DataFrame) -> DataFrame:
    """Prompts without a main-thread request, and those above a million tokens (A-22)."""
    return priced_prompts(prompts).agg(
        F.count_if(F.col("peak_context").isNull()).alias("without_main_lane"),
        F.count_if(F.col("peak_context") >= 1_000_000).alias("over_1m"),
    )


def top_decile_profile(prompts: DataFrame) -> DataFrame:
    """How the costliest tenth of the prompts differs from the rest (A-23)."""
    known = priced_prompts(prompts).select(
        "prompt_id", "cost_usd", "n_requests", "span_s", "interrupted", "delegated_usd"
    )
    ranked = global_rank(known, [F.desc("cost_usd"), F.asc("prompt_id")])
    high = F.col("rank") <= F.ceil(F.col("total") * F.lit(0.1))
    rows = ranked.select(
        "*",
        F.explode(
            F.array(F.when(high, F.lit("top 10%")).otherwise(F.lit("rest")), F.lit("all"))
        ).alias("part"),
    )
    totals = rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_prompts"),
        F.sum("cost_usd").alias("cost_usd"),
        share(F.sum("interrupted"), F.count(F.lit(1))).alias("interrupted_pct"),
        F.coalesce(share(F.sum("delegated_usd"), F.sum("cost_usd")), F.lit(0.0)).alias("delegated_pct"),
    )
    requests = exact_quantiles(
        rows, ["part"], "n_requests", (0.5, 0.9), ("median_requests", "p90_requests")
    ).drop("n")
    spans = exact_quantiles(rows, ["part"], "span_s", (0.5,), ("median_span_s",)).drop("n")
    return totals.join(requests, "part").join(spans, "part")


def decile_ratios(profile: DataFrame) -> DataFrame:
    """Top decile against the rest: ratios of medians and difference of delegated share (A-23)."""
    def pick(part: str, c: str) -> Column:
        return F.max(F.when(F.col("part") == part, F.col(c)))

    def ratio(c: str) -> Column:
        return F.coalesce(pick("top 10%", c) / F.nullif(pick("rest", c), F.lit(0.0)), F.lit(0.0))

    return profile.agg(
        ratio("median_requests").alias("requests_ratio"),
        ratio("median_span_s").alias("span_ratio"),
        (pick("top 10%", "delegated_pct") - pick("rest", "delegated_pct")).alias("delegated_diff_pt"),
    )


def attribution_coverage(cost: DataFrame) -> DataFrame:
    """Share of the period's cost that belongs to a prompt (A-21 header)."""
    attributed = F.coalesce(
        F.sum(F.when(F.col("prompt_id").isNotNull(), F.col("cost_usd"))), F.lit(0.0)
    )
    total = F.coalesce(F.sum("cost_usd"), F.lit(0.0))
    return cost.agg(
        F.countDistinct("prompt_id").alias("n_prompts"),
        attributed.alias("attributed_usd"),
        F.coalesce(share(attributed, total), F.lit(0.0)).alias("coverage_pct"),
        F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost_requests"),
    )
