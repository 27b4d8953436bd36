"""Which prompt caused which work (T-10, T-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from usageloom.functions.scalar import salted_null_key
from usageloom.session import cut_lineage

NOTIFICATION_HEAD = r"(?s)\A\s*(?:\[SYSTEM NOTIFICATION[^\]]*\]\s*)?<task-notification>(.*)\z"
CLOSING_TAG = "</task-notification>"


def parse_notification(prompt: DataFrame) -> DataFrame:
    """Pseudo-prompts that announce a finished task, with the call or agent they name (T-11).

    Ids are only looked for at the head, before the closing tag.
    """
    text = F.col("text")
    rest = F.regexp_extract(text, NOTIFICATION_HEAD, 1)
    body = F.substring_index(rest, CLOSING_TAG, 1)

    def tag(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(body, pattern, 1), F.lit(""))

    return (
        prompt.where(F.regexp_like(text, F.lit(NOTIFICATION_HEAD)))
        .select(
            "prompt_id",
            tag("<tool-use-id>([^<]+)</tool-use-id>").alias("tool_use_id"),
            tag("<task-id>([0-9a-f]+)</task-id>").alias("agent_id"),
        )
        .where(F.col("tool_use_id").isNotNull() | F.col("agent_id").isNotNull())
    )


def _links(agents: DataFrame, notes: DataFrame, tool_calls: DataFrame, req: DataFrame) -> DataFrame:
    """Nodes of the causal graph: each agent and notification with the request it hangs on.

    Facts are touched here once; the search that follows works on as many rows
    as there are agents and notifications.
    """
    wanted = (
        agents.where(F.col("parent_tool_use_id").isNotNull())
        .select(F.lit("agent").alias("kind"), F.col("agent_id").alias("node"), F.col("parent_tool_use_id").alias("tool_use_id"))
        .unionByName(
            notes.where(F.col("tool_use_id").isNotNull())
            .select(F.lit("note").alias("kind"), F.col("prompt_id").alias("node"), "tool_use_id")
        )
    )
    calls = tool_calls.select(
        "tool_use_id", "request_id", F.col("prompt_id").alias("call_prompt")
    )
    requests = req.select(
        "request_id", F.col("prompt_id").alias("seen_prompt"), F.col("agent_id").alias("on_agent"),
        F.lit(True).alias("has_request"),
    )
    linked = wanted.hint("merge").join(calls, "tool_use_id")
    return linked.hint("merge").join(requests, "request_id", "left").select(
        "kind", "node", "on_agent", F.coalesce("has_request", F.lit(False)).alias("has_request"),
        F.col("seen_prompt").alias("work"), F.col("call_prompt").alias("call"),
        F.lit(None).cast("string").alias("moved"),
    )


def _origins(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where each notification folds to now: by its call, else by the agent it names."""
    by_call = nodes.where("kind = 'note'").select(F.col("node").alias("prompt_id"), F.col("call").alias("a"))
    by_agent = nodes.where("kind = 'agent'").select(F.col("node").alias("agent_id"), F.col("call").alias("b"))
    found = (
        notes.select("prompt_id", "agent_id")
        .join(by_call.hint("merge"), "prompt_id", "left")
        .join(by_agent.hint("merge"), "agent_id", "left")
        .select(F.col("prompt_id").alias("_note"), F.coalesce("a", "b").alias("_origin"))
    )
    return found.where(F.col("_origin").isNotNull() & (F.col("_origin") != F.col("_note")))


def _fold(rows: DataFrame, column: str, origins: DataFrame) -> DataFrame:
    """Replace a notification's id in ``column`` by the prompt it came from, where that is known."""
    return (
        rows.join(origins.hint("merge"), F.col(column) == F.col("_note"), "left")
        .withColumn(column, F.coalesce("_origin", column))
        .drop("_note", "_origin")
    )


def _round(nodes: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over all nodes; ``changed`` tells where something moved.

    ``work`` is the prompt of the request a node hangs on, ``call`` that of the
    tool call, and ``moved`` the prompt an agent's own requests were given.
    Work folds first and then follows its spawning call; calls follow their request.
    The joins merge, as a broadcast would send its table through the driver once a round.
    """
    origins = _origins(notes, nodes)
    parents = nodes.where("kind = 'agent'").select(
        F.col("node").alias("_agent"), F.col("call").alias("_parent_call")
    )
    before = nodes.select("*", F.struct("work", "call", "moved").alias("_old"))
    folded = _fold(_fold(before, "work", origins), "moved", origins)
    stepped = (
        folded.join(parents.hint("merge"), F.col("on_agent") == F.col("_agent"), "left")
        .withColumn("work", F.coalesce("_parent_call", "work"))
        .withColumn("moved", F.when(F.col("kind") == "agent", F.coalesce("call", "moved")))
        .withColumn("call", F.when(F.col("has_request"), F.col("work")).otherwise(F.col("call")))
        .withColumn("changed", ~F.struct("work", "call", "moved").eqNullSafe(F.col("_old")))
        .drop("_agent", "_parent_call", "_old")
    )
    told = _fold(notes.withColumn("_was", F.col("at")), "at", origins)
    told = told.withColumn("changed", F.col("at") != F.col("_was")).drop("_was")
    return stepped, told


def _state(df: DataFrame) -> tuple[int, int]:
    """How many rows moved in the round, and a fingerprint of all rows."""
    columns = [c for c in df.columns if c != "changed"]
    whole = F.sum(F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(38,0)"))
    moved, mark = df.agg(F.count_if("changed"), whole).first()
    return moved, int(mark or 0)


def causal_attribution(
    req: DataFrame, tool_calls: DataFrame, agents: DataFrame, prompt: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Move requests and calls to the prompt that caused them, to a fixed point (T-10).

    An agent's work belongs to the prompt of the call that spawned it, the work
    on a notification to the prompt of the task it reports.  Chains that do not
    resolve keep the observed prompt.  Each round moves every chain one link;
    rounds go on until nothing changes, however long the chains are, or, if links
    form a circle, until a state comes back.  The search runs on one row per agent and
    notification, and its state is checkpointed to the shared folder between
    rounds, as an executor may be lost at any time.
    """
    notes = cut_lineage(parse_notification(prompt).withColumn("at", F.col("prompt_id")))
    nodes = cut_lineage(_links(agents, notes, tool_calls, req))
    seen: set[tuple] = set()
    while True:
        stepped, told = (cut_lineage(df) for df in _round(nodes, notes))
        (moved, mark), (told_moved, told_mark) = _state(stepped), _state(told)
        nodes, notes = stepped.drop("changed"), told.drop("changed")
        if not moved and not told_moved or (mark, told_mark) in seen:
            break
        seen.add((mark, told_mark))
    spawned = nodes.where((F.col("kind") == "agent") & F.col("moved").isNotNull()).select(
        F.col("node").alias("_agent"), F.col("moved").alias("_cause")
    )
    folded = notes.where(F.col("at") != F.col("prompt_id")).select(
        F.col("prompt_id").alias("_note"), F.col("at").alias("_at")
    )
    moved = (
        req.withColumn("_key", salted_null_key("agent_id", "request_id"))
        .join(spawned.hint("merge"), F.col("_key") == F.col("_agent"), "left")
        .withColumn("_seen", salted_null_key("prompt_id", "request_id"))
        .join(folded.hint("merge"), F.col("_seen") == F.col("_note"), "left")
        .withColumn("prompt_id", F.coalesce("_cause", "_at", "prompt_id"))
        .drop("_key", "_agent", "_cause", "_seen", "_note", "_at")
    )
    owners = moved.select(
        F.col("request_id").alias("_rid"), F.col("prompt_id").alias("_owner"), F.lit(True).alias("_has")
    )
    calls = (
        tool_calls.withColumn("_key", salted_null_key("request_id", "tool_use_id"))
        .join(owners.hint("merge"), F.col("_key") == F.col("_rid"), "left")
        .withColumn("prompt_id", F.when(F.col("_has"), F.col("_owner")).otherwise(F.col("prompt_id")))
        .drop("_key", "_rid", "_owner", "_has")
    )
    return moved, calls
