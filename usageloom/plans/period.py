"""Period report: ranked prompts, sessions and projects with their context."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usageloom.functions.scalar import clip_text, context_tokens, micros
from usageloom.operators import rollups as A


def top_prompts(
    cost: DataFrame, session: DataFrame, prompt: DataFrame, n: int = 40
) -> DataFrame:
    """Costliest prompts of known sessions with dominant component and text.

    Texts and projects are looked up for the ``n`` winners only.
    """
    name, pct = A.pick_dominant()
    grouped = (
        cost.where(F.col("prompt_id").isNotNull())
        .join(session.select("session_id"), "session_id", "left_semi")
        .groupBy("prompt_id")
        .agg(
            F.min("session_id").alias("session_id"),
            F.min("ts").alias("ts"),
            F.sum("cost_usd").alias("cost_usd"),
            F.count(F.lit(1)).alias("n_requests"),
            F.countDistinct("agent_id").alias("n_agents"),
            F.max("is_interrupted").alias("interrupted"),
            F.max(context_tokens()).alias("peak_context"),
            ((micros(F.max("ts")) - micros(F.min("ts"))) / F.lit(1e6)).alias("span_s"),
            *A.dominant_sums(),
        )
    )
    top = F.broadcast(A.top_n(grouped, "cost_usd", [F.asc("prompt_id")], n))
    winners = top.select(
        "prompt_id", "session_id", "ts", "cost_usd", "n_requests", "n_agents", "interrupted",
        "peak_context", "span_s", name.alias("dominant"), pct.alias("dominant_share_pct"),
    )
    texts = prompt.select("prompt_id", clip_text("text").alias("text"))
    found = texts.join(winners.select("prompt_id"), "prompt_id", "left_semi")
    return A.join_project(winners.join(found, "prompt_id", "left"), session, "left")
