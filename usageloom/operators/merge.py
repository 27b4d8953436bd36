"""From parsed records to ledger tables (T-02 … T-09, T-12, T-14, T-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from usageloom.fixed_values import CHANGE_TOOLS, SECRET_PATTERNS
from usageloom.functions.jsontext import spaced_ascii_json_length
from usageloom.functions.redaction import redact
from usageloom.functions.scalar import normalize_model, nz
from usageloom.operators.temporal import last_non_null
from usageloom.session import cut_lineage

INTERRUPTION_TEXT = "[Request interrupted"


def first_known(c: str | Column, order: str | Column) -> Column:
    """First non-NULL value in ``order``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.min_by(c, F.when(c.isNotNull(), F.col(order) if isinstance(order, str) else order))


def last_known(c: str | Column, order: str | Column) -> Column:
    """Last non-NULL value in ``order``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.max_by(c, F.when(c.isNotNull(), F.col(order) if isinstance(order, str) else order))


def own_prompt() -> Column:
    return F.nullif(F.col("rec.promptId"), F.lit(""))


def named_prompt() -> Column:
    """Prompt id that a user record announces to its lineage."""
    return F.when(F.col("rec.type") == "user", own_prompt())


def carry_prompt(rows: DataFrame) -> DataFrame:
    """Add ``prompt_id``: the row's own, else the last one named before it on its lineage (T-09).

    ``rows`` has lineage_id, seq, own_prompt and named_prompt, and only those
    further columns that are needed afterwards: all of them are shuffled.  Order
    is arrival order.  A lineage is cut at file blocks, so no task sees more
    than one block of it.  The ends of blocks are looked up apart, so the rows
    are stored first: otherwise every line would be read and parsed again for them.
    """
    marked = cut_lineage(rows).withColumn("_path", F.col("seq.path")).withColumn("_block", F.col("seq.block"))
    filled = last_non_null(
        marked, "lineage_id", ("seq",), ("_path", "_block"), "named_prompt", "_carried"
    )
    return filled.withColumn("prompt_id", F.coalesce("own_prompt", "_carried")).drop(
        "own_prompt", "named_prompt", "_carried", "_path", "_block"
    )


def usage_columns() -> list[Column]:
    """Request columns of an assistant record (T-02).

    Without a split by lifetime all cache creation counts as one-hour writes.
    """
    u = "rec.message.usage."
    w5m, w1h = F.col(u + "cache_creation.ephemeral_5m_input_tokens"), F.col(
        u + "cache_creation.ephemeral_1h_input_tokens"
    )
    unsplit = w5m.isNull() & w1h.isNull()
    model = F.col("rec.message.model")
    synthetic = F.coalesce(model == "<synthetic>", F.lit(False)) | F.coalesce(
        F.col("rec.isApiErrorMessage"), F.lit(False)
    )
    return [
        F.col("seq"), F.col("path"), F.col("request_id"),
        F.col("rec.message.id").alias("message_id"),
        F.col("session_id"), F.col("agent_id"), F.col("lineage_id"), F.col("ts"),
        normalize_model(model).alias("model"),
        nz(u + "input_tokens").alias("input_tok"),
        nz(u + "output_tokens").alias("output_tok"),
        nz(u + "cache_read_input_tokens").alias("cache_read_tok"),
        F.when(unsplit, F.lit(0)).otherwise(nz(w5m)).cast("bigint").alias("cache_w5m_tok"),
        F.when(unsplit, nz(u + "cache_creation_input_tokens")).otherwise(nz(w1h)).cast("bigint").alias("cache_w1h_tok"),
        F.nullif(F.to_json(u + "server_tool_use"), F.lit("{}")).alias("server_tool_use"),
        F.col(u + "service_tier").alias("service_tier"),
        F.col(u + "speed").alias("speed"),
        F.col(u + "inference_geo").alias("geo"),
        F.col("rec.message.stop_reason").alias("stop_reason"),
        synthetic.cast("int").alias("is_synthetic"),
    ]


def normalize_usage(records: DataFrame) -> DataFrame:
    """Usage rows of assistant records, without a prompt (T-02)."""
    return records.where(F.col("rec.type") == "assistant").select(*usage_columns())


def carried_usage(records: DataFrame) -> DataFrame:
    """Usage rows with the prompt they belong to (T-02, T-09).

    Contents are dropped first; user records take part only if they name a prompt.
    """
    is_use = F.col("rec.type") == "assistant"
    rows = records.where(is_use | named_prompt().isNotNull()).select(
        *usage_columns(), own_prompt().alias("own_prompt"), named_prompt().alias("named_prompt"),
        is_use.alias("_use"),
    )
    return carry_prompt(rows).where("_use").drop("_use")


FIRST_COLUMNS = (
    "message_id", "session_id", "agent_id", "lineage_id", "prompt_id", "ts", "model", "input_tok",
    "cache_read_tok", "cache_w5m_tok", "cache_w1h_tok", "server_tool_use", "service_tier", "speed",
    "geo", "is_synthetic",
)


def part_columns(fields: tuple[str, ...] = FIRST_COLUMNS) -> list[Column]:
    """What the records of a request in one file add up to; parts of it add up in ``joined_parts``."""
    return [
        F.min("seq").alias("first_seq"),
        F.min_by(F.struct(*fields), "seq").alias("first"),
        F.max("ts").alias("end_ts"),
        F.max("output_tok").alias("output_tok"),
        last_known("stop_reason", "seq").alias("stop_reason"),
        F.max(F.when(F.col("stop_reason").isNotNull(), F.col("seq"))).alias("stop_seq"),
        F.min(F.when(F.col("stop_reason").isNotNull(), F.col("seq"))).alias("first_stop_seq"),
    ]


def joined_parts(parts: DataFrame) -> DataFrame:
    """One row per request and file from parts of it, in any number and order."""
    return parts.groupBy("request_id", "path").agg(
        F.min("first_seq").alias("first_seq"),
        F.min_by("first", "first_seq").alias("first"),
        F.max("end_ts").alias("end_ts"),
        F.max("output_tok").alias("output_tok"),
        F.max_by("stop_reason", "stop_seq").alias("stop_reason"),
        F.max("stop_seq").alias("stop_seq"),
        F.min("first_stop_seq").alias("first_stop_seq"),
    )


def merge_requests(usage: DataFrame) -> DataFrame:
    """One row per request id from the records a streamed response was split into (T-03).

    The first record counts, except: the last known stop reason, the largest
    output, and the latest end within the first record's file.  Copies are
    reduced per file first, so that a request id repeated everywhere is spread.
    """
    return merge_parts(usage.groupBy("request_id", "path").agg(*part_columns()))


def merge_parts(per_file: DataFrame) -> DataFrame:
    """One row per request id from one row per request and file."""
    merged = per_file.groupBy("request_id").agg(
        F.min_by(F.struct("first", "end_ts", "path"), "first_seq").alias("f"),
        F.min("first_seq").alias("first_seq"),
        F.max("output_tok").alias("output_tok"),
        F.max_by("stop_reason", "stop_seq").alias("stop_reason"),
        F.min("first_stop_seq").alias("first_stop_seq"),
    )
    return merged.select(
        "request_id", "f.first.*", "output_tok", "stop_reason",
        F.col("f.end_ts").alias("end_ts"), F.col("f.path").alias("raw_path"),
        "first_seq", "first_stop_seq",
    )


def mark_interrupted(requests: DataFrame, usage: DataFrame, records: DataFrame) -> DataFrame:
    """Flag requests that a later user record reports as interrupted (T-04).

    Output of a request that never got a stop reason is a placeholder and
    becomes NULL.  If the stop reason arrived after the report, only output
    from then on counts.
    """
    marker_id = F.nullif(F.col("rec.interruptedMessageId"), F.lit(""))
    markers = records.where((F.col("rec.type") == "user") & marker_id.isNotNull()).select(
        marker_id.alias("message_id"), F.col("seq").alias("marker_seq")
    )
    keys = requests.where(F.col("message_id").isNotNull()).select(
        "request_id", "message_id", "first_seq", "first_stop_seq"
    )
    hit = (
        keys.join(markers, "message_id")
        .where(F.col("marker_seq") > F.col("first_seq"))
        .groupBy("request_id", "first_stop_seq")
        .agg(F.min("marker_seq").alias("marker_seq"))
    )
    reset = hit.where(F.col("marker_seq") < F.col("first_stop_seq")).select("request_id", "first_stop_seq")
    trusted = (
        usage.join(reset, "request_id").where(F.col("seq") >= F.col("first_stop_seq"))
        .groupBy("request_id").agg(F.max("output_tok").alias("_trusted"))
    )
    flags = hit.select("request_id", F.lit(1).alias("_hit")).join(trusted, "request_id", "left")
    output = (
        F.when(F.col("_hit").isNull(), F.col("output_tok"))
        .when(F.col("stop_reason").isNull(), F.lit(None))
        .otherwise(F.coalesce("_trusted", "output_tok"))
    )
    return (
        requests.join(flags, "request_id", "left")
        .withColumn("output_tok", output)
        .withColumn("is_interrupted", nz("_hit"))
        .withColumn("source", F.lit("transcript"))
        .drop("_hit", "_trusted", "first_seq", "first_stop_seq")
    )


def merge_sessions(records: DataFrame) -> DataFrame:
    """One row per session from all readable records (T-05)."""
    return (
        records.where(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            first_known("project", "seq").alias("project"),
            last_known("rec.slug", "seq").alias("slug"),
            last_known("rec.gitBranch", "seq").alias("git_branch"),
            last_known("rec.version", "seq").alias("cc_version"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


BLOCKS = (
    "array<struct<type: string, id: string, name: string, input: variant, text: string, "
    "tool_use_id: string, content: variant, is_error: boolean>>"
)


def content_blocks() -> Column:
    """Content as an array of typed blocks; NULL when it is plain text."""
    return F.try_variant_get("rec.message.content", "$", BLOCKS)


def content_text() -> Column:
    content = F.col("rec.message.content")
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))


def _lines(value: Column) -> Column:
    return F.size(F.split(F.coalesce(value, F.lit("")), "\n", -1)).cast("bigint")


def tool_change_lines(name: Column, tool_input: Column) -> Column:
    """``struct(file_path, lines_changed)`` of a tool that edits files, else NULLs (T-07)."""
    def field(*keys: str) -> Column:
        return F.coalesce(
            *[F.nullif(F.try_variant_get(tool_input, f"$.{k}", "string"), F.lit("")) for k in keys]
        )

    edits = F.try_variant_get(tool_input, "$.edits", "array<struct<old_string: string, new_string: string>>")
    edited = F.greatest(_lines(field("old_string", "old_source")), _lines(field("new_string", "new_source")))
    several = F.aggregate(
        F.coalesce(edits, F.array().cast("array<struct<old_string: string, new_string: string>>")),
        F.lit(0).cast("bigint"),
        lambda acc, e: acc + F.greatest(_lines(e["old_string"]), _lines(e["new_string"])),
    )
    changes = name.isin(*CHANGE_TOOLS) & F.schema_of_variant(tool_input).startswith("OBJECT")
    lines = (
        F.when(name == "Write", _lines(field("content")))
        .when(name == "MultiEdit", several)
        .otherwise(edited)
    )
    return F.struct(
        F.when(changes, field("file_path", "notebook_path")).alias("file_path"),
        F.when(changes, lines).alias("lines_changed"),
    )


def tool_uses(records: DataFrame) -> DataFrame:
    """Calls: the tool_use blocks of assistant records, with the prompt carried to them.

    A block is reduced to the call's name and change before it is shuffled.
    """
    is_use = F.col("rec.type") == "assistant"

    def call(b: Column, pos: Column) -> Column:
        change = tool_change_lines(b["name"], b["input"])
        return F.when(
            (b["type"] == "tool_use") & (F.coalesce(b["id"], F.lit("")) != ""),
            F.struct(
                b["id"].alias("id"), b["name"].alias("name"), pos.alias("pos"),
                change["file_path"].alias("file_path"), change["lines_changed"].alias("lines_changed"),
            ),
        )

    calls = F.filter(F.transform(content_blocks(), call), lambda c: c.isNotNull())
    rows = records.select(
        "seq", "request_id", "session_id", "agent_id", "lineage_id", "ts",
        own_prompt().alias("own_prompt"), named_prompt().alias("named_prompt"),
        F.when(is_use, calls).alias("calls"),
    ).where(F.col("named_prompt").isNotNull() | (F.size("calls") > 0))
    return carry_prompt(rows).withColumn("b", F.explode("calls")).select(
        F.col("b.id").alias("tool_use_id"), F.struct("seq", "b.pos").alias("ord"),
        "request_id", "session_id", "agent_id", "prompt_id", "b.name", "ts", "b.file_path", "b.lines_changed",
    )


def tool_results(records: DataFrame) -> DataFrame:
    """Results: the tool_result blocks of user records that carry a time."""
    run = F.nullif(F.try_variant_get("rec.toolUseResult", "$.runId", "string"), F.lit(""))
    rows = records.where((F.col("rec.type") == "user") & F.col("ts").isNotNull()).select(
        "seq", "session_id", "agent_id", "ts", run.alias("run"),
        F.filter(
            content_blocks(),
            lambda b: (b["type"] == "tool_result") & (F.coalesce(b["tool_use_id"], F.lit("")) != ""),
        ).alias("bs"),
    )
    blocks = rows.select(
        "seq", "session_id", "agent_id", "ts",
        F.when(F.size("bs") == 1, F.col("run")).alias("workflow_run_id"),
        F.posexplode("bs").alias("pos", "b"),
    )
    body = F.nullif(F.to_json("b.content"), F.lit("null"))
    return blocks.select(
        F.col("b.tool_use_id").alias("tool_use_id"), F.struct("seq", "pos").alias("ord"),
        "session_id", "agent_id",
        F.struct(
            F.coalesce("b.is_error", F.lit(False)).cast("int").alias("is_error"),
            F.coalesce(spaced_ascii_json_length(body), F.lit(0)).alias("result_bytes"),
            F.col("ts").alias("result_ts"),
        ).alias("result"),
        "workflow_run_id",
    )


def merge_tool_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per tool call; call and result may arrive in any order (T-06).

    Both sides are stacked and merged in a single aggregation: the first known
    value counts, and a result is taken as a whole.
    """
    both = calls.unionByName(results, allowMissingColumns=True)
    names = ("request_id", "session_id", "agent_id", "prompt_id", "name", "ts", "file_path", "lines_changed")
    merged = both.groupBy("tool_use_id").agg(
        *[first_known(n, "ord").alias(n) for n in names],
        first_known("result", "ord").alias("result"),
        first_known("workflow_run_id", "ord").alias("workflow_run_id"),
    )
    return merged.select(
        "tool_use_id", *names[:6],
        F.coalesce("result.is_error", F.lit(0)).alias("is_error"),
        F.col("result.result_bytes").alias("result_bytes"),
        "file_path", "lines_changed",
        F.col("result.result_ts").alias("result_ts"), "workflow_run_id",
    )


def spawn_results(records: DataFrame) -> DataFrame:
    """Agents named in the results of the calls that spawned them."""
    def field(name: str) -> Column:
        return F.nullif(F.try_variant_get("rec.toolUseResult", f"$.{name}", "string"), F.lit(""))

    return records.where(F.col("rec.type") == "user").select(
        "seq", "session_id", field("agentId").alias("agent_id"),
        field("agentType").alias("agent_type"), field("resolvedModel").alias("resolved_model"),
    ).where(F.col("agent_id").isNotNull())


def merge_agents(spawns: DataFrame, meta: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """One row per agent; last known values win, workflow children hang on their run's first call (T-08)."""
    patches = meta.withColumn(
        "seq", F.struct("path", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("line"))
    ).drop("path")
    rows = spawns.unionByName(patches, allowMissingColumns=True)
    merged = rows.groupBy("agent_id").agg(
        F.min_by("session_id", "seq").alias("session_id"),
        *[
            last_known(n, "seq").alias(n)
            for n in ("agent_type", "parent_tool_use_id", "spawn_depth", "resolved_model", "workflow_run_id")
        ],
    )
    first_calls = (
        tool_calls.where(F.col("workflow_run_id").isNotNull())
        .groupBy("workflow_run_id")
        .agg(F.min_by("tool_use_id", F.struct("ts", "tool_use_id")).alias("_first_call"))
    )
    parent = F.when(F.col("workflow_run_id").isNotNull(), F.col("_first_call")).otherwise(
        F.col("parent_tool_use_id")
    )
    return (
        merged.join(first_calls, "workflow_run_id", "left")
        .withColumn("parent_tool_use_id", parent)
        .drop("_first_call")
    )


def extract_prompts(records: DataFrame, patterns=SECRET_PATTERNS) -> DataFrame:
    """First text a person sent under each prompt id on the main thread (T-12).

    Texts are redacted as a whole before they are cut to the stored length.
    """
    texts = F.filter(
        F.transform(
            F.filter(content_blocks(), lambda b: b["type"] == "text"), lambda b: b["text"]
        ),
        lambda t: F.coalesce(t, F.lit("")) != "",
    )
    text = F.coalesce(content_text(), F.when(F.size(texts) > 0, F.array_join(texts, "\n")))
    pid = F.nullif(F.col("rec.promptId"), F.lit(""))
    users = records.where((F.col("rec.type") == "user") & pid.isNotNull()).select(
        pid.alias("prompt_id"), "seq", "session_id", "agent_id", "ts", text.alias("text"),
        F.coalesce("rec.isSidechain", F.lit(False)).alias("side"),
        F.nullif(F.col("rec.interruptedMessageId"), F.lit("")).alias("interrupted"),
    )
    human = (
        F.col("agent_id").isNull() & ~F.col("side") & (F.coalesce("text", F.lit("")) != "")
        & ~F.coalesce(F.col("text").startswith(INTERRUPTION_TEXT), F.lit(False))
    )
    grouped = users.groupBy("prompt_id").agg(
        F.min_by(F.struct("seq", "session_id", "ts", "text"), F.when(human, F.col("seq"))).alias("p"),
        F.max_by(
            F.struct("seq", "interrupted"), F.when(F.col("interrupted").isNotNull(), F.col("seq"))
        ).alias("m"),
    ).where(F.col("p").isNotNull())
    return grouped.select(
        "prompt_id", F.col("p.session_id").alias("session_id"), F.col("p.ts").alias("ts"),
        redact(F.col("p.text"), patterns)["text"].alias("text"),
        F.when(F.col("m.seq") > F.col("p.seq"), F.col("m.interrupted")).alias("interrupted_message_id"),
    )


def converge_otel(req: DataFrame, otel: DataFrame) -> DataFrame:
    """Telemetry fills gaps of known requests and adds unknown ones (T-14).

    The result does not depend on which side arrived first.
    """
    at = F.struct("ts", "dedup_key")
    fill = ("query_source", "effort", "cost_usd_sdk", "duration_ms")
    first = ("session_id", "prompt_id", "ts", "model", "input_tok", "output_tok", "cache_read_tok", "cache_creation_tok", "speed")
    events = (
        otel.where((F.col("kind") == "api_request") & F.col("request_id").isNotNull())
        .groupBy("request_id")
        .agg(
            F.min_by(F.struct(*first), at).alias("o"),
            *[first_known(n, at).alias(f"o_{n}") for n in fill],
        )
    )
    known = req.withColumn("_known", F.lit(True))
    joined = known.join(events, "request_id", "full_outer")
    is_known = F.coalesce("_known", F.lit(False))
    new = {
        "session_id": F.col("o.session_id"), "lineage_id": F.col("o.session_id"),
        "prompt_id": F.col("o.prompt_id"), "ts": F.col("o.ts"), "end_ts": F.col("o.ts"),
        "model": normalize_model("o.model"), "input_tok": nz("o.input_tok"),
        "output_tok": nz("o.output_tok"), "cache_read_tok": nz("o.cache_read_tok"),
        "cache_w5m_tok": F.lit(0).cast("bigint"), "cache_w1h_tok": nz("o.cache_creation_tok"),
        "speed": F.col("o.speed"), "is_synthetic": F.lit(0), "is_interrupted": F.lit(0),
        "source": F.lit("otel"),
    }
    filled = {
        "query_source": "o_query_source", "effort": "o_effort", "cost_usd_sdk": "o_cost_usd_sdk",
        "api_duration_ms": "o_duration_ms",
    }
    out = [F.col("request_id")]
    for name in req.columns:
        if name == "request_id":
            continue
        value = F.when(is_known, F.col(name)).otherwise(new.get(name, F.lit(None)))
        if name in filled:
            value = F.coalesce(F.col(name), F.col(filled[name]))
        out.append(value.alias(name))
    for name, source in filled.items():
        if name not in req.columns:
            out.append(F.col(source).alias(name))
    return joined.select(*out)


def telemetry_sessions(session: DataFrame, otel: DataFrame) -> DataFrame:
    """Sessions, with those known from telemetry only added without a project (T-14)."""
    seen = (
        otel.where((F.col("kind") == "api_request") & F.col("request_id").isNotNull() & F.col("session_id").isNotNull())
        .groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    fresh = seen.join(session.select("session_id"), "session_id", "left_anti")
    return session.unionByName(fresh, allowMissingColumns=True)


def regime_events(records: DataFrame, usage: DataFrame, price: DataFrame) -> DataFrame:
    """First sighting of each client version and of each model without a price (T-15)."""
    versions = records.where(F.col("rec.version").isNotNull()).select(
        F.lit("cc_version").alias("kind"), F.col("rec.version").alias("detail"), "ts", "seq"
    )
    models = usage.where((F.col("is_synthetic") == 0) & F.col("model").isNotNull()).select(
        F.lit("model_new").alias("kind"), F.col("model").alias("detail"), "ts", "seq"
    )
    new = models.join(price.select(F.col("model").alias("detail")).distinct(), "detail", "left_anti")
    return versions.unionByName(new).groupBy("kind", "detail").agg(F.min_by("ts", "seq").alias("ts"))
