"""Text-report counterparts: today, week, one prompt, one session (A-36, A-38 … A-40)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from usageloom.functions.periods import monday_of
from usageloom.functions.scalar import clip_text, context_tokens, in_window, local_day, nz
from usageloom.model import Window
from usageloom.operators import rollups as A
from usageloom.functions.quantiles import exact_quantiles


def _entries(df: DataFrame, section: str, label: Column, n: Column, usd: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), label.cast("string").alias("label"),
        n.cast("bigint").alias("n"), usd.cast("double").alias("value"),
    )


def of_prompts_in(cost: DataFrame, facts: DataFrame) -> DataFrame:
    """All requests of the prompts that occur in ``facts``: only these are worth adding up."""
    return cost.join(facts.select("prompt_id").distinct(), "prompt_id", "left_semi")


def today(cost: DataFrame, prompt: DataFrame, day: dt.date, tz: str, top: int = 5) -> DataFrame:
    """The day's total, its models and the costliest prompts that began on it (A-36)."""
    facts = A.period_filter(cost, Window(day, day), tz)
    total = A.daily(facts, tz)
    models = A.model_mix(facts)
    begun = A.prompt_cost(of_prompts_in(cost, facts)).where(local_day("ts", tz) == F.lit(day))
    best = F.broadcast(A.top_n(begun, "cost_usd", [F.asc("prompt_id")], top))
    return A.union_rows(
        _entries(total, "total", F.col("day"), F.col("n_requests"), F.col("cost_usd")),
        _entries(models, "model", F.col("model"), F.col("n_requests"), F.col("cost_usd")),
        _entries(best, "prompt", F.col("prompt_id"), F.col("n_requests"), F.col("cost_usd")),
    )


def week(
    cost: DataFrame, breaks: DataFrame, overhead: DataFrame, day: dt.date, tz: str, top: int = 5
) -> DataFrame:
    """The last seven days: totals, break causes, start-up context, prompts, models (A-36)."""
    w = Window(day - dt.timedelta(days=6), day)
    facts = A.period_filter(cost, w, tz)
    lo, hi = w.instants(tz)
    begun = A.prompt_cost(of_prompts_in(cost, facts)).where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi)))
    causes = breaks.where(in_window("ts", w, tz)).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    startup = overhead.where(in_window("first_ts", w, tz)).agg(
        F.count("startup_context_tok").alias("n"), F.avg("startup_context_tok").alias("v")
    )
    none = F.lit(None)
    return A.union_rows(
        _entries(A.daily(facts, tz), "day", F.col("day"), F.col("n_requests"), F.col("cost_usd")),
        _entries(causes, "cause", F.col("cause"), F.col("n"), none),
        _entries(startup, "startup", F.lit("avg_tok"), F.col("n"), F.col("v")),
        _entries(
            A.top_n(begun, "cost_usd", [F.asc("prompt_id")], top), "prompt",
            F.col("prompt_id"), F.col("n_requests"), F.col("cost_usd"),
        ),
        _entries(A.model_mix(facts), "model", F.col("model"), F.col("n_requests"), F.col("cost_usd")),
    )


def prompt_detail(
    cost: DataFrame, prompt: DataFrame, tool_calls: DataFrame, prompt_id: str
) -> DataFrame:
    """The requests of one prompt with tool counts; totals repeat on each row (A-38)."""
    rows = cost.where(F.col("prompt_id") == prompt_id)
    tools = (
        tool_calls.where(F.col("prompt_id") == prompt_id)
        .groupBy("request_id").agg(F.count(F.lit(1)).alias("tools"))
    )
    whole = A.dominant_component(rows, ["prompt_id"]).select(
        "prompt_id", F.col("cost_usd").alias("total_usd"), "dominant", "dominant_share_pct"
    )
    text = prompt.where(F.col("prompt_id") == prompt_id).select(
        "prompt_id", clip_text("text", 80).alias("text")
    )
    return (
        rows.join(tools, "request_id", "left")
        .join(whole, "prompt_id")
        .join(text, "prompt_id", "left")
        .select(
            "prompt_id", "request_id", "ts", "model", "agent_id", "input_tok", "cache_read_tok",
            "cache_w5m_tok", "cache_w1h_tok", "output_tok", "is_interrupted", nz("tools").alias("tools"),
            "cost_usd", "total_usd", "dominant", "dominant_share_pct", "text",
        )
    )


def last_prompt_id(cost: DataFrame) -> DataFrame:
    """The prompt that began last (A-38, "last")."""
    return A.prompt_cost(cost).orderBy(F.desc("ts"), F.asc("prompt_id")).limit(1).select("prompt_id")


def session_tree(
    cost: DataFrame, prompt: DataFrame, agents: DataFrame, breaks: DataFrame, session_id: str
) -> DataFrame:
    """One session as rows: the session, its prompts, and each prompt's lanes (A-39).

    ``level`` is session, prompt, or lane (main thread or one agent).  Rows stay
    flat, so a long session is never gathered into one nested value.
    """
    mine = F.col("session_id") == session_id
    flags = breaks.where(mine).select("request_id", F.lit(1).alias("broke"))
    rows = cost.where(mine).join(flags, "request_id", "left")
    tokens = context_tokens() + nz("output_tok")
    lanes = rows.groupBy("prompt_id", "agent_id").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.sum(tokens).alias("tokens"),
        F.count("broke").alias("breaks"),
    )

    def level(df: DataFrame, name: str, *keys: str) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("n_requests", "cost_usd", "tokens", "breaks")]
        grouped = df.groupBy(*keys).agg(*sums)
        for key in ("prompt_id", "agent_id"):
            if key not in keys:
                grouped = grouped.withColumn(key, F.lit(None).cast("string"))
        return grouped.withColumn("level", F.lit(name))

    known = prompt.where(mine).select("prompt_id")
    lanes_known = lanes.join(known, "prompt_id", "left_semi")
    out = A.union_rows(
        level(lanes, "session").withColumn("session_id", F.lit(session_id)),
        level(lanes_known, "prompt", "prompt_id").withColumn("session_id", F.lit(session_id)),
        level(lanes_known, "lane", "prompt_id", "agent_id").withColumn("session_id", F.lit(session_id)),
    )
    types = agents.where(mine).select("agent_id", "agent_type", "resolved_model")
    return out.join(types, "agent_id", "left")


def label_candidates(
    prompt: DataFrame, cost: DataFrame, w: Window, tz: str, n: int = 20
) -> DataFrame:
    """Costliest prompts of a week that nobody has labelled yet (A-40)."""
    begun = prompt.where(in_window("ts", w, tz) & F.col("task_label").isNull())
    priced = A.prompt_cost(of_prompts_in(cost, begun)).select("prompt_id", "cost_usd", "n_requests")
    rows = begun.select("prompt_id", "session_id", clip_text("text", 200).alias("text")).join(
        priced, "prompt_id"
    )
    return A.top_n(rows, "cost_usd", [F.asc("prompt_id")], n)


def week_over_week(cost: DataFrame, w: Window, tz: str) -> DataFrame:
    """Macro figures of a week and the week before (A-40)."""
    both = cost.where(in_window("ts", Window(w.previous().start, w.end), tz))
    label = F.when(in_window("ts", w, tz), F.lit("current")).otherwise(F.lit("previous"))
    rows = both.withColumn("period", label)
    totals = rows.groupBy("period").agg(
        F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("n_requests"),
        (F.lit(100.0) * F.sum(F.when(F.col("agent_id").isNotNull(), F.col("cost_usd")))
         / F.nullif(F.sum("cost_usd"), F.lit(0.0))).alias("agent_share_pct"),
    )
    daily = rows.groupBy("period", local_day("ts", tz).alias("day")).agg(F.sum("cost_usd").alias("c"))
    per_prompt = rows.where(F.col("prompt_id").isNotNull()).groupBy("period", "prompt_id").agg(
        F.sum("cost_usd").alias("c")
    )
    a = exact_quantiles(daily, ["period"], "c", (0.5, 0.9), ("daily_p50", "daily_p90")).drop("n")
    b = exact_quantiles(per_prompt, ["period"], "c", (0.5, 0.9), ("prompt_p50", "prompt_p90")).drop("n")
    return totals.join(a, "period", "left").join(b, "period", "left")


def last_iso_week(day: dt.date) -> Window:
    monday = monday_of(day)
    return Window(monday - dt.timedelta(days=7), monday - dt.timedelta(days=1))
