"""The whole write path: raw lines to ledger tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from usageloom.fixed_values import SECRET_PATTERNS
from usageloom.operators import merge as M
from usageloom.operators.attribution import causal_attribution
from usageloom.session import cut_lineage
from usageloom.sources.transcripts import (
    parse_records, quarantine_split, read_agent_meta, readable,
)


@dataclass
class Parsed:
    """Frames between parsing and merging, shared by several tables."""

    parsed: DataFrame
    good: DataFrame
    bad: DataFrame

    @cached_property
    def usage(self) -> DataFrame:
        """Usage rows with their prompts; stored when first asked for."""
        return M.carried_usage(self.good)


def parse(raw: DataFrame, patterns=SECRET_PATTERNS, store: bool = False, contents: bool = True) -> Parsed:
    """Parsed records and what is taken from them.

    With ``store`` each line is read and parsed once, into the shared folder, and
    the tables read only their columns of it; the text is kept where it is rejected.
    Requests need no ``contents``: without them records have no texts, tools and results.
    """
    parsed = parse_records(raw)
    if not contents:
        parsed = parsed.withColumn("rec", F.col("rec").dropFields("message.content", "toolUseResult"))
    if store:
        parsed = cut_lineage(parsed.withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value"))))
    good, bad = quarantine_split(parsed, patterns)
    return Parsed(parsed, good, bad)


def merged_requests(p: Parsed) -> DataFrame:
    """Merged once, since marking looks at them twice; it needs no prompts, so these are not carried again for it."""
    return M.mark_interrupted(cut_lineage(M.merge_requests(p.usage)), M.normalize_usage(p.good), p.good)


def build_ledger(
    raw: DataFrame, price: DataFrame, otel: DataFrame | None = None,
    sidecars: DataFrame | None = None, patterns=SECRET_PATTERNS,
) -> dict[str, DataFrame]:
    """Ledger tables as a pure function of the raw lines.

    Replaying everything and adding what is new therefore give the same state.
    """
    p = parse(raw, patterns, store=True)
    spark = raw.sparkSession
    meta = (
        read_agent_meta(sidecars)[0] if sidecars is not None
        else spark.createDataFrame([], "agent_id string, session_id string, agent_type string, "
                                   "parent_tool_use_id string, spawn_depth bigint, workflow_run_id string, path string")
    )
    tools = M.merge_tool_calls(M.tool_uses(p.good), M.tool_results(p.good))
    agents = M.merge_agents(M.spawn_results(p.good), meta, tools)
    prompts = M.extract_prompts(p.good, patterns)
    requests, tools = causal_attribution(merged_requests(p), tools, agents, prompts)
    sessions = M.merge_sessions(readable(p.parsed))
    if otel is not None:
        requests = M.converge_otel(requests, otel)
        sessions = M.telemetry_sessions(sessions, otel)
    return {
        "request": requests, "tool_call": tools, "agent": agents, "prompt": prompts,
        "session": sessions, "quarantine": p.bad,
        "regime_event": M.regime_events(readable(p.parsed), p.usage, price),
    }
