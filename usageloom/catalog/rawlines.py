"""Raw transcript, hook and telemetry lines derived from the driver's events.

Each event becomes the records an agent would have written: a response split
over one to three records, sometimes a prompt, a tool result or an
interruption, and now and then something that must be rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usageloom.sources.adapters import DriverLedger, _MODEL_NO, _PROMPT_NO, _SESSION_NO

# Columns shared by both engines, on top of the ``base`` table.
EVENT = {
    "id": "id", "us": "us", "v": "v", "usr": "usr", "et": "et",
    "n": "id % 3 + 1",
    "sess": f"concat('s', CAST({_SESSION_NO} AS STRING))",
    "hexid": f"CASE WHEN id % 5 = 0 THEN concat('ab', CAST({_SESSION_NO} AS STRING), CAST(id % 3 AS STRING)) END",
    "pid": f"concat('p', CAST({_PROMPT_NO} AS STRING))",
    "mid": "concat('m', lpad(CAST(id AS STRING), 9, '0'))",
    "rid": "CASE WHEN id % 13 = 5 THEN concat('m', lpad(CAST(id AS STRING), 9, '0')) ELSE "
    "concat('r', lpad(CAST(id AS STRING), 9, '0')) END",
    "tid": "concat('t', CAST(id AS STRING))",
    "model": f"CASE WHEN id % 41 = 0 THEN '<synthetic>' WHEN {_MODEL_NO} = 0 THEN 'px-haiku-1' WHEN "
    f"{_MODEL_NO} = 1 THEN 'px-sonnet-2' ELSE 'px-new-9' END",
    "version": "concat('1.', CAST(CAST(floor(id / 3e3) AS BIGINT) AS STRING))",
    "ask": "concat('ask ', et, CASE WHEN id % 12 = 1 THEN concat(' AKIA', lpad(CAST(id AS STRING), 16, '0'), "
    "' end') ELSE '' END)",
    "has_ask": "(id % 4 = 1 AND id % 5 <> 0) OR id % 20 = 0",
    "has_cut": "id % 37 = 0 OR id % 43 = 0",
    "cut_part": "CASE WHEN id % 43 = 0 THEN 25 ELSE 80 END",
    "valid": "id % 107 <> 3",
}
EVENT_SQL = "SELECT *, CASE WHEN hexid IS NULL THEN concat('proj-', CAST(usr AS STRING), '/', sess, '.jsonl') ELSE " \
    "concat('proj-', CAST(usr AS STRING), '/', sess, '/subagents/agent-', hexid, '.jsonl') END AS path, " \
    "CASE WHEN hexid IS NULL THEN sess ELSE concat(sess, '/', hexid) END AS lineage_id FROM (SELECT " \
    + ", ".join(f"{e} AS {n}" for n, e in EVENT.items()) + " FROM base)"


def _iso(us: str) -> str:
    text = f"CAST(timestampadd(MICROSECOND, {us}, TIMESTAMP_NTZ'1970-01-01 00:00:00') AS STRING)"
    return f"concat(replace({text}, ' ', 'T'), 'Z')"


def _record(kind: str, us: str, *fields: str) -> str:
    common = (
        f"'type', '{kind}', 'timestamp', {_iso(us)}, 'version', version, "
        "'sessionId', CASE WHEN id % 2 = 0 THEN sess END, "
        "'gitBranch', CASE WHEN id % 7 = 0 THEN concat('b', CAST(id % 10 AS STRING)) END"
    )
    return f"to_json(named_struct({', '.join((common, *fields))}))"


def _assistant(j: int) -> str:
    usage = (
        f"named_struct('input_tokens', v % 97, 'output_tokens', v % 1009 + {10 * j}, "
        "'cache_read_input_tokens', v % 90001, 'cache_creation_input_tokens', v % 777, "
        "'cache_creation', CASE WHEN id % 4 <> 3 THEN named_struct('ephemeral_5m_input_tokens', v % 4001, "
        "'ephemeral_1h_input_tokens', CASE WHEN id % 8 <> 0 THEN v % 11 END) END, "
        "'server_tool_use', CASE WHEN id % 3 = 0 THEN named_struct('search', v % 3) END, "
        "'service_tier', 'standard', 'speed', CASE WHEN id % 31 = 0 THEN 'fast' END)"
    )
    call = (
        "CASE WHEN id % 2 = 0 THEN named_struct('type', 'tool_use', 'id', tid, 'name', CASE WHEN id % 4 = 0 "
        "THEN 'Edit' ELSE 'Bash' END, 'input', named_struct('file_path', concat('/f', tid), 'old_string', "
        "'a\\nb', 'new_string', CASE WHEN id % 8 = 0 THEN 'x\\ny\\nz' ELSE 'x' END), 'text', "
        "CAST(NULL AS STRING)) ELSE named_struct('type', 'text', 'id', CAST(NULL AS STRING), 'name', "
        "CAST(NULL AS STRING), 'input', CAST(NULL AS STRUCT<file_path: STRING, old_string: STRING, "
        "new_string: STRING>), 'text', 'working') END"
    )
    message = (
        f"named_struct('id', mid, 'role', 'assistant', 'model', CASE WHEN model LIKE '<%' THEN model ELSE "
        f"concat(model, '-20240101') END, 'stop_reason', CASE WHEN n = {j} AND id % 37 <> 0 THEN 'end_turn' END, "
        f"'usage', CASE WHEN valid THEN {usage} END, 'content', array({call}))"
    )
    fields = (
        "'requestId', CASE WHEN id % 13 <> 5 THEN rid END",
        "'promptId', CASE WHEN id % 29 = 0 THEN pid END",
        f"'message', {message}",
    )
    return _record("assistant", f"us + {j} * 1000000", *fields)


_ASK = _record(
    "user", "us - 1000000", "'promptId', pid", "'isSidechain', id % 20 = 0",
    "'message', named_struct('role', 'user', 'content', parse_json(CASE WHEN id % 8 = 1 THEN to_json(named_struct('c', "
    "ask)):c ELSE to_json(array(named_struct('type', 'text', 'text', ask), named_struct('type', 'text', 'text', 'thanks'))) "
    "END))",
).replace("to_json(named_struct('c', ask)):c", "concat('\"', ask, '\"')")
_CUT = _record("user", "us + 5000000", "'promptId', pid", "'interruptedMessageId', mid",
               "'message', named_struct('role', 'user', 'content', '[Request interrupted by user]')")
_RESULT = _record(
    "user", "us + 6000000",
    "'toolUseResult', CASE WHEN id % 10 = 0 THEN named_struct('agentId', concat('ab', CAST(id AS STRING)), 'agentType', "
    "'worker', 'resolvedModel', CASE WHEN id % 20 = 0 THEN 'px-haiku-1' END, 'runId', CAST(NULL AS STRING)) WHEN id % 18 = 4 "
    "THEN named_struct('agentId', CAST(NULL AS STRING), 'agentType', CAST(NULL AS STRING), 'resolvedModel', "
    "CAST(NULL AS STRING), 'runId', concat('wf_', CAST(id % 5 AS STRING))) END",
    "'message', named_struct('role', 'user', 'content', array(named_struct('type', 'tool_result', 'tool_use_id', tid, "
    "'is_error', id % 33 = 0, 'content', concat('line ', CAST(v AS STRING), '\\n', 'é'))))",
)
_PARTS = (
    ("id % 103 = 2", "5", "'not json {'"),
    ("has_ask", "10", _ASK),
    ("n >= 1", "20", _assistant(1)),
    ("n >= 2", "30", _assistant(2)),
    ("n >= 3", "40", _assistant(3)),
    ("has_cut", "cut_part", _CUT),
    ("id % 2 = 0", "60", _RESULT),
    ("id % 97 = 0", "90", "to_json(named_struct('type', 'summary', 'version', version))"),
    ("id % 101 = 1", "95", "to_json(named_struct('type', 'mystery', 'version', '9.9'))"),
)


def _with_path(base: DataFrame) -> DataFrame:
    return base.selectExpr(*[f"{e} AS {n}" for n, e in EVENT.items()]).selectExpr(
        "*",
        "CASE WHEN hexid IS NULL THEN concat('proj-', CAST(usr AS STRING), '/', sess, '.jsonl') ELSE concat('proj-', "
        "CAST(usr AS STRING), '/', sess, '/subagents/agent-', hexid, '.jsonl') END AS path",
    )


def line_paths(L: DriverLedger) -> DataFrame:
    """Path of each event; every event leaves a line there at least."""
    return _with_path(L.base).select("path")


def transcript_lines(L: DriverLedger) -> DataFrame:
    """Lines with the path they would be stored under and their arrival order."""
    # Spread the events before they become text; by number, since slim events would be joined into a few tasks again.
    tasks = int(L.spark.conf.get("spark.sql.shuffle.partitions"))
    events = _with_path(L.base.repartition(tasks, "id"))
    entries = ", ".join(
        f"CASE WHEN {when} THEN named_struct('part', CAST({part} AS BIGINT), 'value', {value}) END"
        for when, part, value in _PARTS
    )
    rows = events.selectExpr("id", "path", f"explode(filter(array({entries}), x -> x IS NOT NULL)) AS r")
    return rows.select(
        "path",
        F.struct(
            "path", F.floor(F.col("id") / F.lit(1000.0)).cast("bigint").alias("block"),
            (F.col("id") * 100 + F.col("r.part")).alias("line"),
        ).alias("seq"),
        F.col("r.value").alias("value"),
    )


def sidecar_files(L: DriverLedger) -> DataFrame:
    """One sidecar per agent lane; some lie in a workflow folder."""
    rows = L.base.where("id % 5 = 0").selectExpr(*[f"{e} AS {n}" for n, e in EVENT.items()])
    lanes = rows.groupBy("hexid").agg(F.min("sess").alias("sess"), F.min("usr").alias("usr"), F.min("id").alias("id"))
    return lanes.selectExpr(
        "concat('proj-', CAST(usr AS STRING), '/', sess, '/subagents/', CASE WHEN id % 3 = 0 THEN concat('workflows/wf_', "
        "CAST(id % 5 AS STRING), '/') ELSE '' END, 'agent-', hexid, '.meta.json') AS path",
        "CASE WHEN id % 19 = 0 THEN 'oops' ELSE to_json(named_struct('agentType', CASE WHEN id % 2 = 0 THEN 'explore' END, "
        "'toolUseId', concat('t', CAST(id % 50 AS STRING)), 'spawnDepth', id % 3)) END AS value",
    )


def hook_lines(L: DriverLedger) -> DataFrame:
    """Hook envelopes, every third twice, and some that are broken."""
    hooks = L.hook_event.selectExpr("unix_micros(ts) AS us", "kind", "session_id", "prompt", "total_cost_usd")
    text = (
        "CASE WHEN us % 41 = 0 THEN 'no json' WHEN us % 43 = 0 THEN to_json(named_struct('hook_ts', us / 1e6)) ELSE "
        "to_json(named_struct('hook_event', kind, 'hook_ts', us / 1e6, 'payload', named_struct('session_id', session_id, "
        "'prompt', prompt, 'cost', named_struct('total_cost_usd', total_cost_usd)))) END"
    )
    return hooks.selectExpr(
        "'hooks.ndjson' AS path",
        "named_struct('path', 'hooks.ndjson', 'block', 0L, 'line', us) AS seq",
        f"{text} AS value",
        "explode(CASE WHEN us % 3 = 0 THEN array(1, 2) ELSE array(1) END) AS copy",
    ).drop("copy")


def telemetry_lines(L: DriverLedger) -> DataFrame:
    """Telemetry envelopes of every fourth event; the session id sits on the resource."""
    ev = L.base.where("id % 4 = 0").selectExpr(*[f"{e} AS {n}" for n, e in EVENT.items()])
    def kv(key: str, kind: str, value: str) -> str:
        names = ("stringValue", "intValue", "doubleValue")
        vals = ", ".join(f"'{n}', " + (value if n == kind else "CAST(NULL AS STRING)") for n in names)
        return f"named_struct('key', '{key}', 'value', named_struct({vals}))"

    attrs = ", ".join((
        kv("event.name", "stringValue", "CASE WHEN id % 28 = 0 THEN 'other' WHEN id % 20 = 0 THEN 'api_error' ELSE 'api_request' END"),
        kv("event.sequence", "intValue", "CAST(id AS STRING)"),
        kv("request_id", "stringValue", "CASE WHEN id % 12 <> 0 THEN concat('r', lpad(CAST(id AS STRING), 9, '0')) END"),
        kv("model", "stringValue", "concat(model, '-20240101')"),
        kv("effort", "stringValue", "CASE WHEN id % 8 = 0 THEN 'low' ELSE 'high' END"),
        kv("input_tokens", "intValue", "CAST(v % 97 AS STRING)"),
        kv("cache_creation_tokens", "stringValue", "CAST(v % 777 AS STRING)"),
        kv("cost_usd", "doubleValue", "CAST((v % 500) / 1e4 AS STRING)"),
        kv("secret.attribute", "stringValue", "'hidden'"),
    ))
    resource = kv("session.id", "stringValue", "CASE WHEN id % 36 <> 0 THEN sess END")
    envelope = (
        f"to_json(named_struct('resourceLogs', array(named_struct('resource', named_struct('attributes', array({resource})), "
        "'scopeLogs', array(named_struct('logRecords', array(named_struct('timeUnixNano', CAST(us * 1000 AS STRING), "
        f"'attributes', array({attrs})))))))))"
    )
    return ev.selectExpr(
        "'otel.ndjson' AS path",
        "named_struct('path', 'otel.ndjson', 'block', 0L, 'line', id) AS seq",
        f"CASE WHEN id % 92 = 0 THEN '{{\"resourceLogs\": 3}}' ELSE {envelope} END AS value",
        "explode(CASE WHEN id % 3 = 0 THEN array(1, 2) ELSE array(1) END) AS copy",
    ).drop("copy")
