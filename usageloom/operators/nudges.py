"""Whether a nudge was followed, judged by what was observed afterwards (T-20)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from usageloom.fixed_values import BUDGET_RULES, EFFORT_RANK, MEASURED_RULES
from usageloom.functions.scalar import micros
from usageloom.operators.temporal import asof_backward, band_join

HORIZON_S = 600
CONTINUED_USD = 0.25
NUDGE_KEY = ("rule", "fired_ts", "session_id")


def effort_rank(effort: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in EFFORT_RANK.items():
        out = F.when(effort == name, F.lit(rank)).otherwise(out)
    return out


def _flags(fired: DataFrame, points: DataFrame, horizon_us: int, *aggs: Column) -> DataFrame:
    pairs = band_join(
        fired, points, "session_id", micros("fired_ts"), horizon_us, F.col("point_us")
    )
    return pairs.groupBy(*NUDGE_KEY).agg(*aggs)


def classify_nudges(
    fired: DataFrame, hooks: DataFrame, cost: DataFrame, req: DataFrame, as_of: dt.datetime,
    horizon_s: int = HORIZON_S,
) -> DataFrame:
    """Add outcome, reason and evidence to fired nudges ``(rule, fired_ts, session_id)``.

    ``hooks`` has ``kind``, ``prompt`` (submitted text) and ``total_cost_usd``.
    Nudges whose horizon is not over at ``as_of`` stay undecided (NULL).  All
    evidence comes from band joins over the horizon, reduced to one row of flags
    per nudge; the state before the nudge is an as-of lookup.
    """
    horizon = horizon_s * 1_000_000
    fired = fired.dropDuplicates(list(NUDGE_KEY))
    due = fired.where(F.col("fired_ts") <= F.lit(as_of - dt.timedelta(seconds=horizon_s)))

    submitted = hooks.where(F.col("kind") == "UserPromptSubmit").select(
        "session_id", micros("ts").alias("point_us"),
        F.coalesce(F.ltrim("prompt").startswith("/handoff"), F.lit(False)).alias("handoff"),
    )
    prompts = _flags(
        due, submitted, horizon,
        F.count(F.lit(1)).alias("n_prompts"), F.max(F.col("handoff").cast("int")).alias("handoff"),
    )

    # Budget nudges: a cheaper model or less effort than right before.
    rank = effort_rank(F.col("effort"))
    spend = cost.select("session_id", "request_id", "ts", "in_usd", rank.alias("rank"))
    before = asof_backward(
        due.where(F.col("rule").isin(*BUDGET_RULES)), spend, "session_id",
        micros("fired_ts"), micros("ts"), "request_id", ("in_usd", "rank"), "before",
    )
    later = req.select(
        "session_id", micros("ts").alias("point_us"), rank.alias("rank"), F.lit(None).cast("double").alias("in_usd")
    ).unionByName(
        cost.select("session_id", micros("ts").alias("point_us"), F.lit(None).cast("int").alias("rank"), "in_usd")
    )
    saved = _flags(
        before, later, horizon,
        F.max((F.col("in_usd") < F.col("before.in_usd")).cast("int")).alias("cheaper"),
        F.max((F.col("rank") < F.col("before.rank")).cast("int")).alias("lower_effort"),
    )

    # Runaway nudges: interruption, new agents, or cost that kept growing.
    runaway = due.where(F.col("rule") == "runaway_guard")
    cut = _flags(
        runaway,
        req.where(F.col("is_interrupted") == 1).select(
            "session_id", micros(F.coalesce("end_ts", "ts")).alias("point_us")
        ),
        horizon, F.lit(1).alias("interrupted"),
    )
    with_agent = req.where(F.col("agent_id").isNotNull())
    births = with_agent.groupBy("session_id", "agent_id").agg(F.min(micros("ts")).alias("point_us"))
    oldest = births.groupBy("agent_id").agg(F.min("point_us").alias("born_us"))
    fan = _flags(
        runaway, births.join(oldest, "agent_id"), horizon,
        F.max((F.col("born_us") > micros("fired_ts")).cast("int")).alias("fanout"),
    )
    samples = hooks.where(
        (F.col("kind") == "statusline_sample") & F.col("total_cost_usd").isNotNull()
    ).select("session_id", micros("ts").alias("point_us"), "total_cost_usd")
    grown = _flags(
        runaway, samples, horizon,
        (
            (F.count(F.lit(1)) >= 2)
            & (F.max_by("total_cost_usd", "point_us") - F.min_by("total_cost_usd", "point_us") >= CONTINUED_USD)
        ).cast("int").alias("continued"),
    )

    keys = list(NUDGE_KEY)
    rows = due
    for part in (prompts, saved, cut, fan, grown):
        rows = rows.join(part, keys, "left")

    def on(name: str) -> Column:
        return F.coalesce(F.col(name) == 1, F.lit(False))

    any_prompt = F.coalesce(F.col("n_prompts") > 0, F.lit(False))
    measured = F.col("rule").isin(*MEASURED_RULES)
    budget = F.col("rule").isin(*BUDGET_RULES)
    guard = F.col("rule") == "runaway_guard"
    reason = (
        F.when(~measured, F.lit("rule_not_measured"))
        .when(on("handoff"), F.lit("explicit_handoff"))
        .when(budget & on("cheaper"), F.lit("cheaper_model"))
        .when(budget & on("lower_effort"), F.lit("lower_effort"))
        .when(budget & any_prompt, F.lit("continued_without_observed_reduction"))
        .when(guard & on("interrupted"), F.lit("request_interrupted"))
        .when(guard & on("fanout"), F.lit("new_agent_fanout"))
        .when(guard & on("continued"), F.lit("cost_continued"))
        .when(~budget & ~guard & any_prompt, F.lit("continued_without_handoff"))
        .otherwise(F.lit("no_observable_action"))
    )
    followed_for = ("explicit_handoff", "cheaper_model", "lower_effort", "request_interrupted")
    unknown_for = ("rule_not_measured", "no_observable_action")
    decided = rows.withColumn("outcome_reason", reason).withColumn(
        "outcome",
        F.when(F.col("outcome_reason").isin(*followed_for), F.lit("followed"))
        .when(F.col("outcome_reason").isin(*unknown_for), F.lit("unknown"))
        .otherwise(F.lit("not_followed")),
    )
    observed = F.when(~measured, F.lit("{}")).otherwise(
        F.to_json(
            F.struct(
                F.coalesce("n_prompts", F.lit(0)).alias("next_prompt_count"),
                on("handoff").alias("handoff"),
                F.when(budget & ~on("handoff"), on("cheaper")).alias("cheaper_model"),
                F.when(budget & ~on("handoff"), on("lower_effort")).alias("lower_effort"),
                F.when(guard & ~on("handoff"), on("interrupted")).alias("interrupted"),
                F.when(guard & ~on("handoff"), on("fanout")).alias("new_fanout"),
                F.when(guard & ~on("handoff"), on("continued")).alias("continued_cost"),
            )
        )
    )
    verdict = decided.select(
        *keys, "outcome", "outcome_reason", observed.alias("observed_json"),
        (F.col("fired_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(horizon_s)))).alias("decided_ts"),
        F.when(F.col("outcome") == "followed", F.lit(1))
        .when(F.col("outcome") == "not_followed", F.lit(0)).alias("followed"),
    )
    return fired.join(verdict, keys, "left")
