"""Timelines of sessions: request spans, prompt strips, tool waits (W-05 … W-09)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from usageloom.functions.quantiles import exact_quantiles
from usageloom.functions.scalar import micros
from usageloom.operators.temporal import with_next, with_previous


def median_by_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact median, the mean of the two middle values for even counts (W-05)."""
    return exact_quantiles(df, by, value, (0.5,), ("median",))


def request_spans(req: DataFrame) -> DataFrame:
    """Start and end of each request on its lane, a session's main thread or one agent (W-06).

    The start is measured where the API duration is known; after a request that
    stopped for a tool the lane was busy since its end; else only the request's
    own instant is known.
    """
    lanes = req.select(
        "request_id", "session_id", "agent_id", "ts", "api_duration_ms", "stop_reason", "is_synthetic",
        F.concat_ws("/", "session_id", "agent_id").alias("lane"),
        micros(F.coalesce("end_ts", "ts")).alias("end_us"),
    )
    seq = with_previous(
        lanes, "lane", micros("ts"), "request_id", ("end_us", "stop_reason", "is_synthetic")
    )
    measured = F.col("api_duration_ms").isNotNull()
    start = (
        F.when(measured, F.col("end_us") - F.round(F.col("api_duration_ms") * 1000).cast("bigint"))
        .when(
            (F.col("prev.stop_reason") == "tool_use") & (F.col("prev.is_synthetic") == 0),
            F.col("prev.end_us"),
        )
        .otherwise(micros("ts"))
    )
    return seq.select(
        "request_id", "session_id", "agent_id",
        F.least(start, "end_us").alias("start_us"), "end_us", measured.cast("int").alias("measured"),
    )


def session_bounds(req: DataFrame, tools: DataFrame) -> DataFrame:
    """First and last instant of a session seen in requests and tool calls."""
    end = micros(F.coalesce("end_ts", "ts"))
    measured = end - F.round(F.col("api_duration_ms") * 1000).cast("bigint")
    a = req.select(
        "session_id", F.least(micros("ts"), measured).alias("lo"),
        F.greatest(micros("ts"), micros("end_ts")).alias("hi"),
    )
    b = tools.select(
        "session_id", F.least(micros("ts"), micros("result_ts")).alias("lo"),
        F.greatest(micros("ts"), micros("result_ts")).alias("hi"),
    )
    return a.unionByName(b).groupBy("session_id").agg(
        F.min("lo").alias("t0_us"), F.max("hi").alias("t1_us")
    )


def prompt_strip(prompt: DataFrame, cost: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each active prompt holds its session from its start to the start of the next one (W-07)."""
    work = (
        cost.where(F.col("prompt_id").isNotNull())
        .groupBy("session_id", "prompt_id")
        .agg(
            F.min(micros("ts")).alias("first_us"),
            F.count(F.lit(1)).alias("n_requests"),
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        )
    )
    active = (
        prompt.select("session_id", "prompt_id", micros("ts").alias("prompt_us"))
        .join(work, ["session_id", "prompt_id"])
        .join(bounds, "session_id")
    )
    start = F.greatest("t0_us", F.least("t1_us", F.coalesce("prompt_us", "first_us")))
    active = active.withColumn("start_us", start)
    seq = with_next(active, "session_id", F.col("start_us"), "prompt_id", ("start_us",))
    end = F.coalesce("next.start_us", "t1_us")
    return seq.select(
        "session_id", "prompt_id", "start_us", F.greatest("start_us", end).alias("end_us"),
        "n_requests", "cost_usd",
    )


def story_gaps(prompt: DataFrame, req: DataFrame) -> DataFrame:
    """Idle seconds between the work of one prompt and that of the next in its session (W-07)."""
    end = micros(F.coalesce("end_ts", "ts"))
    work = (
        req.where(F.col("prompt_id").isNotNull())
        .groupBy("session_id", "prompt_id")
        .agg(F.min(micros("ts")).alias("t0"), F.max(end).alias("t1"))
    )
    active = prompt.select("session_id", "prompt_id", micros("ts").alias("us")).join(
        work, ["session_id", "prompt_id"]
    )
    seq = with_next(
        active, "session_id", F.coalesce("us", "t0"), "prompt_id", ("prompt_id", "t0")
    )
    gap = F.greatest(F.lit(0), F.col("next.t0") - F.col("t1")) / F.lit(1e6)
    return seq.where(F.col("next.t0").isNotNull()).select(
        "session_id", "prompt_id", F.col("next.prompt_id").alias("next_prompt_id"),
        gap.alias("gap_s"),
    )


def latest_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """First ``n`` rows per group in ``order`` (W-08); the limit is applied before the shuffle too."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rank).where(F.col("rn") <= n)


def tool_wait(tools: DataFrame) -> DataFrame:
    """Seconds from call to result, NULL while a call is open (W-09)."""
    wait = (micros("result_ts") - micros("ts")) / F.lit(1e6)
    return tools.select(
        "tool_use_id", "session_id", "name", wait.alias("wait_s"),
        F.col("result_ts").isNull().cast("int").alias("is_open"), "is_error",
    )


def tool_wait_summary(tools: DataFrame) -> DataFrame:
    """Waiting time per session and tool (W-09)."""
    return tool_wait(tools).groupBy("session_id", "name").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("is_open").alias("open_calls"),
        F.sum("is_error").alias("errors"),
        F.sum("wait_s").alias("wait_s"),
    )
