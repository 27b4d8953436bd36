"""Transcript records: reading, path context, parsing, quarantine (S-01 … S-03, S-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usageloom.fixed_values import METADATA_RECORD_TYPES, SECRET_PATTERNS
from usageloom.functions.redaction import redact

RECORD_SCHEMA = (
    "type string, sessionId string, agentId string, timestamp string, version string, "
    "gitBranch string, slug string, promptId string, requestId string, "
    "interruptedMessageId string, isApiErrorMessage boolean, isSidechain boolean, "
    "toolUseResult variant, "
    "message struct<id: string, model: string, stop_reason: string, content: variant, "
    "usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, "
    "cache_creation_input_tokens: bigint, cache_creation: struct<ephemeral_5m_input_tokens: bigint, "
    "ephemeral_1h_input_tokens: bigint>, server_tool_use: variant, service_tier: string, "
    "speed: string, inference_geo: string>>, "
    "_corrupt string"
)


def relative_path(uri: Column, root: str) -> Column:
    """Part of a file path below ``root``."""
    root = root.rstrip("/") + "/"
    bare = root.split(":", 1)[-1].lstrip("/")
    return F.substring(uri, F.locate(bare, uri) + len(bare), F.length(uri))


def read_lines(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Non-blank lines under ``root`` with ``path`` and arrival order ``seq`` (S-01).

    ``seq`` is (path, block, line): the file, the start of the split the line was
    read from and its place in that split.  Files stay splittable, and the
    order within a file is kept without numbering its lines globally.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(root).select(
        relative_path(F.col("_metadata.file_path"), root).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    return lines.where(F.length(F.trim("value")) > 0).select(
        "path", F.struct("path", "block", "line").alias("seq"), "value"
    )


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    return read_lines(spark, root, "*.jsonl")


def path_context(path: Column) -> Column:
    """``struct(project, session_id, agent_id)`` from a path relative to the root (S-02)."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "subagents")
    name = F.element_at(parts, -1)
    delegated = F.when(at > 1, F.get(parts, at.cast("int") - 2))
    main = F.when(
        (F.size(parts) == 2) & name.endswith(".jsonl"), F.regexp_replace(name, r"\.jsonl$", "")
    )
    agent = F.when(at > 0, F.nullif(F.regexp_extract(name, "^agent-([0-9a-f]+)", 1), F.lit("")))
    return F.struct(
        F.get(parts, F.lit(0)).alias("project"),
        F.when(at > 0, delegated).otherwise(main).alias("session_id"),
        agent.alias("agent_id"),
    )


def _text(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def parse_records(raw: DataFrame) -> DataFrame:
    """One row per line with the typed record ``rec``, its identity and a ``reason`` if it is bad.

    A record's own ids win over those of its path.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    record = F.struct(F.from_json("value", RECORD_SCHEMA, options).alias("rec"), path_context(F.col("path")).alias("ctx"))
    # Filters on a record stay above the generator; below it each of their terms would parse the line again.
    parsed = raw.select("path", "seq", "value", F.explode(F.array(record)).alias("r")).select("path", "seq", "value", "r.rec", "r.ctx")
    rows = parsed.select(
        "*",
        F.col("ctx.project").alias("project"),
        F.coalesce(_text("rec.sessionId"), "ctx.session_id").alias("session_id"),
        F.coalesce(_text("rec.agentId"), "ctx.agent_id").alias("agent_id"),
        F.try_to_timestamp("rec.timestamp").alias("ts"),
        F.coalesce(_text("rec.requestId"), _text("rec.message.id")).alias("request_id"),
    ).withColumn("lineage_id", F.concat_ws("/", "session_id", "agent_id"))
    kind = F.col("rec.type")
    unreadable = kind.isNull() & F.col("rec._corrupt").isNotNull()
    incomplete = (kind == "assistant") & (
        F.col("request_id").isNull() | F.col("rec.message.usage").isNull()
    )
    known = F.coalesce(kind.isin("assistant", "user", *METADATA_RECORD_TYPES), F.lit(False))
    reason = (
        F.when(unreadable, F.lit("invalid JSON"))
        .when(incomplete, F.lit("assistant record missing request id or usage"))
        .when(~known, F.concat(F.lit("unknown transcript record type: "), F.coalesce(kind, F.lit("none"))))
    )
    return rows.withColumn("reason", reason).drop("ctx")


def quarantine_row(reason: Column, src: Column, text: Column, patterns=SECRET_PATTERNS) -> list[Column]:
    """The whole rejected text, redacted; a display may clip it (``clip_text``)."""
    return [src.alias("src"), reason.alias("reason"), redact(text, patterns)["text"].alias("raw")]


def quarantine_split(parsed: DataFrame, patterns=SECRET_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """Usable records, and the rejected lines with reason and redacted text (S-03).

    Records of ignored kinds are in neither; unreadable lines are in the second.
    """
    good = parsed.where(F.col("reason").isNull() & F.col("rec.type").isin("assistant", "user"))
    bad = parsed.where(F.col("reason").isNotNull()).select(
        *quarantine_row(F.col("reason"), F.col("path"), F.col("value"), patterns)
    )
    return good, bad


def readable(parsed: DataFrame) -> DataFrame:
    """Every record that is JSON at all: sessions and versions are taken from all of them."""
    return parsed.where(F.coalesce(F.col("reason") != "invalid JSON", F.lit(True)))


SIDECAR_SCHEMA = "agentType string, toolUseId string, spawnDepth bigint, _corrupt string"


def read_sidecar_files(spark: SparkSession, root: str) -> DataFrame:
    """Whole sidecar files; each holds one small JSON object."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "agent-*.meta.json")
    return reader.text(root, wholetext=True).select(
        relative_path(F.col("_metadata.file_path"), root).alias("path"), "value"
    )


def read_agent_meta(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Agent descriptions from sidecar files ``(path, value)``, and unreadable ones (S-06)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = files.select(
        "path", "value",
        F.from_json("value", SIDECAR_SCHEMA, options).alias("m"),
        path_context(F.col("path")).alias("ctx"),
        F.regexp_extract("path", r"(?:^|/)subagents/workflows/(wf_[^/]+)/", 1).alias("wf"),
        F.nullif(
            F.regexp_extract(F.element_at(F.split("path", "/"), -1), "^agent-([0-9a-f]+)", 1), F.lit("")
        ).alias("agent_id"),
    )
    broken = F.col("m._corrupt").isNotNull()
    good = rows.where(~broken & F.col("agent_id").isNotNull()).select(
        "agent_id",
        F.col("ctx.session_id").alias("session_id"),
        F.col("m.agentType").alias("agent_type"),
        F.col("m.toolUseId").alias("parent_tool_use_id"),
        F.col("m.spawnDepth").alias("spawn_depth"),
        F.nullif("wf", F.lit("")).alias("workflow_run_id"),
        "path",
    )
    bad = rows.where(broken).select(
        *quarantine_row(F.lit("invalid JSON"), F.col("path"), F.col("value"))
    )
    return good, bad
