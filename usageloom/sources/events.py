"""Hook events and telemetry (S-04, S-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from usageloom.fixed_values import SECRET_PATTERNS, TELEMETRY_ATTRIBUTES, TELEMETRY_KINDS
from usageloom.functions.redaction import redact
from usageloom.sources.transcripts import quarantine_row


def read_hooks(
    raw: DataFrame, event_field: str = "hook_event", ts_field: str = "hook_ts",
    patterns=SECRET_PATTERNS,
) -> tuple[DataFrame, DataFrame]:
    """Hook events from envelope lines ``(path, seq, value)``, and the rejected lines (S-04).

    The whole redacted line identifies an event, so that copies count once.
    """
    v = F.try_parse_json("value")
    rows = raw.select("path", "value", v.alias("v")).select(
        "path", "value", "v",
        F.try_variant_get("v", f"$.{event_field}", "string").alias("kind"),
        F.try_variant_get("v", f"$.{ts_field}", "double").alias("ts_s"),
        F.schema_of_variant(F.try_variant_get("v", "$.payload", "variant")).alias("shape"),
    )
    shape = F.coalesce("shape", F.lit("VOID"))
    payload_ok = (shape == "VOID") | shape.startswith("OBJECT")
    reason = (
        F.when(F.col("v").isNull(), F.lit("invalid JSON"))
        .when(~payload_ok | (F.coalesce("kind", F.lit("")) == ""), F.lit("invalid hook envelope"))
        .when(F.col("ts_s").isNull(), F.lit("invalid hook time"))
    )
    rows = rows.withColumn("reason", reason)
    good = (
        rows.where(F.col("reason").isNull())
        .select(
            F.timestamp_micros(F.round(F.col("ts_s") * 1e6).cast("bigint")).alias("ts"),
            "kind",
            F.try_variant_get("v", "$.payload.session_id", "string").alias("session_id"),
            F.try_variant_get("v", "$.payload.prompt_id", "string").alias("prompt_id"),
            redact("value", patterns)["text"].alias("payload_json"),
        )
        .dropDuplicates(["payload_json"])
    )
    bad = rows.where(F.col("reason").isNotNull()).select(
        *quarantine_row(F.col("reason"), F.col("path"), F.col("value"), patterns)
    )
    return good, bad


def hook_payload(hooks: DataFrame) -> DataFrame:
    """Hook events with the fields that the operators read from the payload."""
    v = F.try_parse_json("payload_json")
    return hooks.withColumn("_v", v).select(
        *hooks.columns,
        F.try_variant_get("_v", "$.payload.prompt", "string").alias("prompt"),
        F.try_variant_get("_v", "$.payload.rule", "string").alias("rule"),
        F.coalesce(
            F.try_variant_get("_v", "$.payload.experiment_group", "string"), F.lit("treatment")
        ).alias("experiment_group"),
        F.coalesce(
            F.to_json(F.try_variant_get("_v", "$.payload.detail", "variant")), F.lit("{}")
        ).alias("detail_json"),
        F.try_variant_get("_v", "$.payload.cost.total_cost_usd", "double").alias("total_cost_usd"),
        F.try_variant_get("_v", "$.payload.context_window.used_percentage", "double").alias("context_pct"),
    )


def fired_nudges(hooks: DataFrame) -> DataFrame:
    """Fired nudges from hook events with payload fields, one per rule, time and session."""
    return (
        hooks.where((F.col("kind") == "nudge_fired") & F.col("rule").isNotNull())
        .select(
            "rule", F.col("ts").alias("fired_ts"),
            F.coalesce("session_id", F.lit("")).alias("session_id"), "detail_json", "experiment_group",
        )
        .dropDuplicates(["rule", "fired_ts", "session_id"])
    )


_VALUE = "struct<stringValue: string, intValue: string, doubleValue: string, boolValue: string>"
_ATTRIBUTES = f"array<struct<key: string, value: {_VALUE}>>"
ENVELOPE_SCHEMA = (
    f"resourceLogs array<struct<resource: struct<attributes: {_ATTRIBUTES}>, scopeLogs: array<struct<"
    f"logRecords: array<struct<timeUnixNano: string, attributes: {_ATTRIBUTES}>>>>>>, _corrupt string"
)


def read_otlp(raw: DataFrame, allowed=TELEMETRY_ATTRIBUTES) -> tuple[DataFrame, DataFrame]:
    """Telemetry events from envelope lines ``(path, seq, value)``, and the rejected ones (S-05).

    A record's attributes override those of its resource, and of repeated keys
    the last counts; both follow from taking the last entry of the joined lists.
    Of several events with one identity the first to arrive is kept.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = raw.select("path", "seq", "value", F.from_json("value", ENVELOPE_SCHEMA, options).alias("e"))
    shaped = F.col("e.resourceLogs").isNotNull() & ~F.exists(
        "e.resourceLogs",
        lambda r: r["scopeLogs"].isNull() | F.exists(r["scopeLogs"], lambda s: s["logRecords"].isNull()),
    )
    shaped = F.coalesce(shaped, F.lit(False))
    empty = F.array().cast(_ATTRIBUTES)
    records = (
        lines.where(shaped)
        .select("path", "seq", F.posexplode("e.resourceLogs").alias("i", "r"))
        .select("path", "seq", "i", "r.resource", F.posexplode("r.scopeLogs").alias("j", "s"))
        .select("path", "seq", "i", "j", "resource", F.posexplode("s.logRecords").alias("k", "rec"))
        .select(
            "path", F.struct("seq", "i", "j", "k").alias("ord"), "rec",
            F.concat(
                F.coalesce("resource.attributes", empty), F.coalesce("rec.attributes", empty)
            ).alias("attrs"),
        )
    )

    def attr(*names: str) -> Column:
        found = []
        for name in names:
            last = F.try_element_at(F.filter("attrs", lambda a: a["key"] == name), F.lit(-1))
            value = last["value"]
            found.append(
                F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"], value["boolValue"])
            )
        return F.coalesce(*found)

    def whole(name: str) -> Column:
        return F.coalesce(
            attr(name).try_cast("bigint"), F.floor(attr(name).try_cast("double")).cast("bigint")
        )

    stored = F.map_from_entries(
        F.filter(F.array(*[F.struct(F.lit(n), attr(n).alias("v")) for n in allowed]), lambda e: e["v"].isNotNull())
    )
    rows = records.select(
        "path", "ord", "rec",
        attr("event.name").alias("kind"),
        attr("request_id").alias("request_id"),
        F.coalesce(F.nullif(attr("session.id"), F.lit("")), attr("session_id")).alias("session_id"),
        attr("event.sequence", "event_sequence").alias("sequence"),
        F.coalesce(F.nullif(attr("prompt.id"), F.lit("")), attr("prompt_id")).alias("prompt_id"),
        *[attr(n).alias(n) for n in ("model", "effort", "query_source", "speed", "error", "status_code")],
        whole("input_tokens").alias("input_tok"),
        whole("output_tokens").alias("output_tok"),
        whole("cache_read_tokens").alias("cache_read_tok"),
        whole("cache_creation_tokens").alias("cache_creation_tok"),
        attr("cost_usd").try_cast("double").alias("cost_usd_sdk"),
        attr("duration_ms").try_cast("double").alias("duration_ms"),
        F.timestamp_micros(F.expr("try_cast(rec.timeUnixNano AS BIGINT) div 1000")).alias("ts"),
        F.to_json(F.struct(F.col("rec.timeUnixNano").alias("timeUnixNano"), stored.alias("attributes"))).alias("raw_json"),
    ).where(F.col("kind").isin(*TELEMETRY_KINDS))
    nameless = F.col("request_id").isNull() & (
        (F.coalesce("session_id", F.lit("")) == "") | F.col("sequence").isNull()
    )
    reason = F.when(nameless, F.lit("telemetry event without request id or session and sequence")).when(
        F.col("ts").isNull(), F.lit("telemetry event without time")
    )
    rows = rows.withColumn("reason", reason).withColumn(
        "dedup_key",
        F.coalesce("request_id", F.concat_ws(":", "session_id", "sequence", "kind")),
    )
    columns = [
        "ts", "kind", "session_id", "request_id", "prompt_id", "model", "effort", "query_source",
        "speed", "input_tok", "output_tok", "cache_read_tok", "cache_creation_tok", "cost_usd_sdk",
        "duration_ms", "error", "status_code", "raw_json",
    ]
    good = (
        rows.where(F.col("reason").isNull())
        .groupBy("dedup_key")
        .agg(F.min_by(F.struct(*columns), "ord").alias("e"))
        .select("e.*", "dedup_key")
    )
    bad = F.lit("telemetry envelope without log records")
    rejected = lines.where(~shaped).select(*quarantine_row(bad, F.col("path"), F.col("value"))).unionByName(
        rows.where(F.col("reason").isNotNull()).select(
            *quarantine_row(F.col("reason"), F.col("path"), F.to_json("rec"))
        )
    )
    return good, rejected
