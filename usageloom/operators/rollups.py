"""Rollups of priced requests (A-01 … A-13, K-*, D-01)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from usageloom.functions.scalar import (
    context_tokens, in_days, in_window, is_automatic, local_day, micros, model_family, nz, share,
)
from usageloom.model import Page, Window
from usageloom.operators.pricing import component_usd, join_project


def period_filter(
    df: DataFrame, w: Window, tz: str, session: DataFrame | None = None, ts: str = "ts"
) -> DataFrame:
    """Rows of the local dates in ``w``; with ``w.project`` only that project's sessions (F-01)."""
    out = (in_days(df, w, tz) if ts == "ts" else df).where(in_window(ts, w, tz))
    if w.project is None:
        return out
    if session is None:
        raise ValueError("a project filter needs the session table")
    wanted = session.where(F.col("project") == w.project).select("session_id")
    return out.join(wanted, "session_id", "left_semi")


def unknown_count(cost: str = "cost_usd") -> Column:
    return F.count_if(F.col(cost).isNull())


def prompt_cost(cost: DataFrame) -> DataFrame:
    """Cost and volume per prompt (A-01)."""
    return (
        cost.where(F.col("prompt_id").isNotNull())
        .groupBy("prompt_id")
        .agg(
            F.min("ts").alias("ts"),
            F.count(F.lit(1)).alias("n_requests"),
            F.count("agent_id").alias("n_agent_requests"),
            F.countDistinct("agent_id").alias("n_agents"),
            F.sum("input_tok").alias("input_tok"),
            F.sum(nz("output_tok")).alias("output_tok"),
            F.sum("cache_read_tok").alias("cache_read_tok"),
            F.sum(F.col("cache_w5m_tok") + F.col("cache_w1h_tok")).alias("cache_creation_tok"),
            F.sum("cost_usd").alias("cost_usd"),
            F.max("is_interrupted").alias("interrupted"),
        )
    )


def daily(cost: DataFrame, tz: str) -> DataFrame:
    """Totals per local day, unattributed requests included (A-02)."""
    return cost.groupBy(local_day("ts", tz).alias("day")).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("cache_read_tok").alias("cache_read_tok"),
        F.sum(F.col("cache_w5m_tok") + F.col("cache_w1h_tok")).alias("cache_creation_tok"),
        F.sum("input_tok").alias("input_tok"),
        F.sum(nz("output_tok")).alias("output_tok"),
    )


def background_cost(cost: DataFrame, tz: str) -> DataFrame:
    """Cost of requests known from telemetry only, per day and source (A-03)."""
    return (
        cost.where(F.col("source") == "otel")
        .groupBy(local_day("ts", tz).alias("day"), "query_source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("cost_usd"))
    )


def _with_share(grouped: DataFrame) -> DataFrame:
    total = grouped.agg(F.sum("cost_usd")).scalar()
    return grouped.withColumn("share_pct", share(F.col("cost_usd"), total))


def model_mix(cost: DataFrame) -> DataFrame:
    """Requests, cost and cost share per model (A-04)."""
    return _with_share(
        cost.groupBy("model").agg(
            F.count(F.lit(1)).alias("n_requests"), F.sum("cost_usd").alias("cost_usd")
        )
    )


def main_vs_agent(cost: DataFrame) -> DataFrame:
    """Cost of the main thread against delegated work (A-05)."""
    lane = F.when(F.col("agent_id").isNull(), F.lit("main")).otherwise(F.lit("agent"))
    return _with_share(
        cost.groupBy(lane.alias("lane")).agg(
            F.count(F.lit(1)).alias("n_requests"),
            F.countDistinct("agent_id").alias("n_agents"),
            F.sum("cost_usd").alias("cost_usd"),
        )
    )


def session_rollup(cost: DataFrame, session: DataFrame) -> DataFrame:
    """Cost, span and prompts per known session (A-06)."""
    grouped = cost.groupBy("session_id").agg(
        F.sum("cost_usd").alias("cost_usd"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.countDistinct("prompt_id").alias("n_prompts"),
        F.count(F.lit(1)).alias("n_requests"),
        unknown_count().alias("unknown_cost_requests"),
    )
    return (
        join_project(grouped, session, "inner")
        .withColumn("duration_s", (micros("last_ts") - micros("first_ts")) / F.lit(1e6))
        .withColumn("usd_per_prompt", F.col("cost_usd") / F.nullif(F.col("n_prompts"), F.lit(0)))
    )


def peak_context(cost: DataFrame) -> DataFrame:
    """Largest main-thread context per session and prompt (A-12, first level)."""
    return (
        cost.where(F.col("agent_id").isNull() & F.col("prompt_id").isNotNull())
        .groupBy("session_id", "prompt_id")
        .agg(F.max(context_tokens()).alias("peak_context"))
    )


def average_peak(cost: DataFrame, session: DataFrame, key: str = "session_id") -> DataFrame:
    """Average of the prompts' peaks per session or per project (A-12)."""
    peaks = join_project(peak_context(cost), session, "inner")
    return peaks.groupBy(key).agg(
        F.avg("peak_context").alias("avg_peak_context"), F.count(F.lit(1)).alias("n_peaks")
    )


def top_keys(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The ``k`` keys of largest value (ties: key ascending); at most ``k`` rows by construction."""
    return (
        df.orderBy(F.col(value).desc_nulls_last(), F.col(key).asc_nulls_first())
        .limit(k)
        .select(F.col(key).alias("_top"), F.lit(True).alias("_is_top"))
    )


def top_k_others(
    df: DataFrame, key: str, value: str, k: int, others: str = "others"
) -> DataFrame:
    """Add ``label``: the key as text for the top ``k``, else ``others``; ``is_top`` tells (K-04)."""
    top = F.broadcast(top_keys(df, key, value, k))
    return (
        df.join(top, F.col(key).eqNullSafe(F.col("_top")), "left")
        .withColumn("is_top", F.coalesce("_is_top", F.lit(False)).cast("int"))
        .withColumn(
            "label",
            F.when(F.col("is_top") == 1, F.coalesce(F.col(key), F.lit("—"))).otherwise(
                F.lit(others)
            ),
        )
        .drop("_top", "_is_top")
    )


def project_rollup(cost: DataFrame, session: DataFrame, keep: int = 20) -> DataFrame:
    """Cost, volume and average peak context of the costliest projects and the rest (A-07).

    Requests are first reduced to one row per session and prompt; only those
    rows meet the session table.
    """
    total = cost.agg(F.sum("cost_usd")).scalar()
    main_peak = F.max(F.when(F.col("agent_id").isNull(), context_tokens()))
    reduced = cost.groupBy("session_id", "prompt_id").agg(
        F.sum("cost_usd").alias("cost_usd"),
        F.count(F.lit(1)).alias("n"),
        main_peak.alias("peak"),
    )
    peak = F.when(F.col("prompt_id").isNotNull(), F.col("peak"))
    projects = (
        join_project(reduced, session, "inner")
        .groupBy("project")
        .agg(
            F.sum("cost_usd").alias("cost_usd"),
            F.countDistinct("session_id").alias("n_sessions"),
            F.countDistinct("prompt_id").alias("n_prompts"),
            F.sum("n").alias("n_requests"),
            F.sum(peak).alias("_peaks"),
            F.count(peak).alias("_n_peaks"),
        )
    )
    return (
        top_k_others(projects, "project", "cost_usd", keep)
        .groupBy("label", "is_top")
        .agg(
            F.count(F.lit(1)).alias("n_projects"),
            F.sum("cost_usd").alias("cost_usd"),
            F.sum("n_sessions").alias("n_sessions"),
            F.sum("n_prompts").alias("n_prompts"),
            F.sum("n_requests").alias("n_requests"),
            (F.sum("_peaks") / F.nullif(F.sum("_n_peaks"), F.lit(0))).alias("avg_peak_context"),
        )
        .withColumn("share_pct", share(F.col("cost_usd"), total))
        .withColumn("usd_per_prompt", F.col("cost_usd") / F.nullif(F.col("n_prompts"), F.lit(0)))
    )


def period_totals(cost: DataFrame, session: DataFrame) -> DataFrame:
    """One row of totals and counts (A-08)."""
    by_session = cost.groupBy("session_id").agg(
        F.sum("cost_usd").alias("c"), F.count(F.lit(1)).alias("n"), unknown_count().alias("u")
    )
    return join_project(by_session, session, "left").agg(
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("request_count"),
        F.count("session_id").alias("session_count"),
        F.countDistinct("project").alias("project_count"),
        F.coalesce(F.sum("u"), F.lit(0)).alias("unknown_cost_request_count"),
    )


def prompt_kpi(cost: DataFrame) -> DataFrame:
    """Number of prompts that caused at least one non-synthetic request (A-09)."""
    return cost.agg(F.countDistinct("prompt_id").alias("prompt_count"))


def cost_components(cost: DataFrame) -> DataFrame:
    """Money per component, in long form (A-10)."""
    parts = component_usd()
    row = cost.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in parts.items()])
    return row.unpivot([], list(parts), "component", "cost_usd")


def dominant_sums() -> list[Column]:
    """Component sums (in micro-dollars) behind the dominant component, unknown rates as zero."""
    factor = F.coalesce("price_factor", F.lit(1.0))
    rate = F.coalesce("in_usd", F.lit(0.0))
    values = {
        "cache_read": nz("cache_read_tok") * rate * nz("cache_read_x") * factor,
        "cache_creation": (
            nz("cache_w5m_tok") * nz("cache_w5m_x") + nz("cache_w1h_tok") * nz("cache_w1h_x")
        ) * rate * factor,
        "output": nz("output_tok") * nz("out_usd") * factor,
        "input": nz("input_tok") * rate * factor,
        "server_tool": F.col("server_tool_usd") * F.lit(1e6),
    }
    return [F.sum(value).alias(f"_d_{name}") for name, value in values.items()]


DOMINANT_ORDER = ("cache_read", "cache_creation", "output", "input", "server_tool")


def pick_dominant(cost: str = "cost_usd") -> tuple[Column, Column]:
    """(name, share) of the largest component sum; earlier names win ties."""
    best = F.array_max(
        F.array(
            *[
                F.struct(F.col(f"_d_{n}").alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("n"))
                for i, n in enumerate(DOMINANT_ORDER)
            ]
        )
    )
    total = F.coalesce(F.col(cost), F.lit(0.0)) * F.lit(1e6)
    pct = F.when(total == 0, F.lit(0.0)).otherwise(best["v"] / total * 100)
    return best["n"], pct


def dominant_component(cost: DataFrame, keys: list[str]) -> DataFrame:
    """The component that drives the cost of each group (A-11)."""
    name, pct = pick_dominant()
    return (
        cost.groupBy(*keys)
        .agg(F.sum("cost_usd").alias("cost_usd"), *dominant_sums())
        .select(*keys, "cost_usd", name.alias("dominant"), pct.alias("dominant_share_pct"))
    )


def startup_context(session: DataFrame, req: DataFrame, tz: str) -> DataFrame:
    """What each session pays up front: context of its first main-thread request (A-13)."""
    total = (
        F.col("input_tok") + F.col("cache_read_tok")
        + F.col("cache_w5m_tok") + F.col("cache_w1h_tok")
    )
    first = (
        req.where(F.col("agent_id").isNull() & (F.col("is_synthetic") == 0))
        .groupBy("session_id")
        .agg(
            F.min_by(
                F.struct("model", total.alias("tok")), F.struct("ts", "request_id")
            ).alias("f")
        )
    )
    return session.join(first, "session_id").select(
        "session_id", "project", "first_ts",
        local_day("first_ts", tz).alias("day"),
        F.col("f.model").alias("model"),
        F.col("f.tok").alias("startup_context_tok"),
    )


def startup_summary(overhead: DataFrame, w: Window, tz: str) -> DataFrame:
    """Average start-up context of the period's most used model, and of the period before (A-13)."""
    current = overhead.where(in_window("first_ts", w, tz))
    modal = (
        current.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_first("model")).limit(1)
    )
    lo, hi = w.instants(tz)
    both = overhead.where(
        (F.col("first_ts") >= F.lit(lo - dt.timedelta(days=w.days))) & (F.col("first_ts") < F.lit(hi))
    )
    now = F.col("first_ts") >= F.lit(lo)
    tok = F.col("startup_context_tok")
    return (
        both.join(F.broadcast(modal.select("model")), "model")
        .groupBy("model")
        .agg(
            F.count(F.when(now, tok)).alias("sessions"),
            F.avg(F.when(now, tok)).alias("avg_tok"),
            F.count(F.when(~now, tok)).alias("previous_sessions"),
            F.avg(F.when(~now, tok)).alias("previous_avg_tok"),
        )
    )


def startup_by_day(overhead: DataFrame) -> DataFrame:
    """Average start-up context per local day and model (A-13)."""
    return overhead.groupBy("day", "model").agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("startup_context_tok").alias("avg_tok")
    )


def prompt_facts(cost: DataFrame, session: DataFrame, how: str = "inner") -> DataFrame:
    """One row per prompt with project, span and main-thread peak.

    Requests are reduced per session and prompt before they meet the session table.
    """
    ctx = F.when(F.col("agent_id").isNull(), context_tokens())
    family = F.max_by(
        model_family("model"), F.struct(ctx, (-micros("ts")).alias("t"), "request_id")
    )
    reduced = (
        cost.where(F.col("prompt_id").isNotNull())
        .groupBy("session_id", "prompt_id")
        .agg(
            F.sum("cost_usd").alias("cost_usd"),
            F.count(F.lit(1)).alias("n_requests"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.max("is_interrupted").alias("interrupted"),
            F.sum(F.when(F.col("agent_id").isNotNull(), F.col("cost_usd"))).alias("delegated_usd"),
            F.max(ctx).alias("peak_context"),
            family.alias("peak_family"),
        )
    )
    return (
        join_project(reduced, session, how)
        .groupBy("prompt_id")
        .agg(
            F.min("session_id").alias("session_id"),
            F.min("project").alias("project"),
            F.sum("cost_usd").alias("cost_usd"),
            F.sum("n_requests").alias("n_requests"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.max("interrupted").alias("interrupted"),
            F.sum("delegated_usd").alias("delegated_usd"),
            F.max("peak_context").alias("peak_context"),
            F.max_by("peak_family", "peak_context").alias("peak_family"),
        )
        .withColumn("peak_family", F.when(F.col("peak_context").isNotNull(), F.col("peak_family")))
        .withColumn("span_s", (micros("last_ts") - micros("first_ts")) / F.lit(1e6))
        .withColumn("automatic", is_automatic("project").cast("int"))
    )


def top_n(df: DataFrame, value: str, ties: list[Column], n: int) -> DataFrame:
    """Largest values first, unknown last, ties broken as given (K-01)."""
    return df.orderBy(F.col(value).desc_nulls_last(), *ties).limit(n)


def page(df: DataFrame, value: str, ties: list[Column], page: Page = Page()) -> DataFrame:
    """One page of the ranking (K-02)."""
    first = F.col(value).desc_nulls_last() if page.order == "desc" else F.col(value).asc_nulls_first()
    return df.orderBy(first, *ties).offset(page.offset).limit(page.limit)


def cumulative_share(
    ranked: DataFrame, value: str, ties: list[Column], total: Column, n: int
) -> DataFrame:
    """Rank and running share of ``total`` within the top ``n`` (W-02).

    The window has no partition key; it sees the ``n`` rows of the report only.
    """
    top = top_n(ranked, value, ties, n)
    order = W.partitionBy(F.lit(0)).orderBy(F.col(value).desc_nulls_last(), *ties)
    running = F.sum(nz(value)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return top.withColumn("rank", F.row_number().over(order)).withColumn(
        "cumulative_pct", F.coalesce(share(running, total), F.lit(0.0))
    )


def date_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per date, both ends included (D-01)."""
    days = F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 1 DAY"))
    return spark.range(1).select(F.explode(days).alias("day"))


def spine_costs(cost: DataFrame, start: dt.date, end: dt.date, tz: str) -> DataFrame:
    """Cost of every day: 0 without requests, NULL when no request of the day has a price (D-01)."""
    found = (
        cost.where(in_window("ts", Window(start, end), tz))
        .groupBy(local_day("ts", tz).alias("day"))
        .agg(
            F.sum("cost_usd").alias("_cost"),
            F.count(F.lit(1)).alias("_n"),
            F.count("cost_usd").alias("_known"),
        )
    )
    spine = date_spine(cost.sparkSession, start, end)
    return spine.join(found, "day", "left").select(
        "day",
        F.when(F.col("_n").isNull(), F.lit(0.0)).otherwise(F.col("_cost")).alias("cost_usd"),
        nz("_n").alias("n_requests"),
        nz("_known").alias("n_known"),
    )


def moving_average_7d(days: DataFrame, value: str = "cost_usd") -> DataFrame:
    """Trailing mean of up to seven zero-filled days, shorter while warming up (W-04)."""
    order = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(-6, 0)
    return days.withColumn("moving_avg", F.avg(nz(value)).over(order))


def union_rows(*parts: DataFrame) -> DataFrame:
    """UNION ALL by column name (K-05)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def known_prompt_ids(prompt: DataFrame, req: DataFrame) -> DataFrame:
    """Prompt ids from either source, once each (K-05)."""
    a = prompt.select("prompt_id")
    b = req.where(F.col("prompt_id").isNotNull()).select("prompt_id")
    return a.union(b).distinct()


def resolve_prefix(ids: DataFrame, key: str, prefix: str) -> DataFrame:
    """One row ``(status, id)``: an exact match wins, else the prefix must be unique (F-06)."""
    hit = ids.where(F.col(key).startswith(prefix)).select(key).distinct()
    return hit.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col(key) == prefix, F.col(key))).alias("exact"),
        F.min(key).alias("first"),
    ).select(
        F.when(F.col("exact").isNotNull() | (F.col("n") == 1), F.lit("found"))
        .when(F.col("n") == 0, F.lit("missing"))
        .otherwise(F.lit("ambiguous"))
        .alias("status"),
        F.coalesce("exact", F.when(F.col("n") == 1, F.col("first"))).alias("id"),
    )
