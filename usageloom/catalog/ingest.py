"""The write path on derived raw lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from usageloom.catalog import rawlines as RL
from usageloom.catalog.registry import query, rounded, us
from usageloom.fixed_values import SECRET_PATTERNS
from usageloom.operators import attribution as AT, merge as M
from usageloom.sources import events as E, ingest as I, prices as PR, sinks, transcripts as S
from usageloom.sources.adapters import with_tables
from usageloom.session import cut_lineage, shared_dir

EV = (("ev", RL.EVENT_SQL),)
WITH_EV = with_tables("base", extra=EV)


def parsed(L):
    return I.parse(RL.transcript_lines(L))


def stored(L):
    """For queries that take several tables from the records."""
    return I.parse(RL.transcript_lines(L), store=True)


@query("s02_path_context", WITH_EV + "SELECT DISTINCT path, concat('proj-', CAST(usr AS STRING)) AS project, sess AS session_id, hexid AS agent_id FROM ev")
def _(L):
    lines = RL.transcript_lines(L).select("path").distinct()
    return lines.select("path", S.path_context(F.col("path")).alias("c")).select("path", "c.*")


@query("s01_read_transcripts", WITH_EV + """SELECT count(*) + count(*) FILTER (n >= 2) + count(*) FILTER (n >= 3) + count(*) FILTER (has_ask) +
count(*) FILTER (has_cut) + count(*) FILTER (id % 2 = 0) + count(*) FILTER (id % 97 = 0) + count(*) FILTER (id % 101 = 1) + count(*) FILTER (id % 103 = 2)
AS n_lines, count(DISTINCT path) AS n_paths FROM ev""")
def _(L):
    """Lines written to text files, one folder per project, and read back."""
    root = f"{shared_dir(L.spark)}/usageloom/s01-{uuid.uuid4().hex}"
    lines = RL.transcript_lines(L).select(F.substring_index("path", "/", 1).alias("project"), "value")
    # The lines of a project meet first, else each task would leave a file in every folder.
    lines.hint("rebalance", "project").write.partitionBy("project").text(root)
    back = S.read_lines(L.spark, root, "*.txt")
    paths = RL.line_paths(L).agg(F.countDistinct("path")).scalar()
    return back.agg(F.count(F.lit(1)).alias("n_lines")).withColumn("n_paths", paths)


@query("s03_quarantine_split", WITH_EV + """SELECT reason, src, count(*) AS n FROM (SELECT 'invalid JSON' AS reason, path AS src FROM ev WHERE id % 103 = 2 UNION
ALL SELECT 'unknown transcript record type: mystery', path FROM ev WHERE id % 101 = 1 UNION ALL SELECT 'assistant record missing request id or usage', path
FROM ev, generate_series(1, n) g(j) WHERE NOT valid) GROUP BY 1, 2""")
def _(L):
    return parsed(L).bad.groupBy("reason", "src").agg(F.count(F.lit(1)).alias("n"))


USAGE = f"""SELECT id, j, path, rid AS request_id, mid AS message_id, sess AS session_id, hexid AS agent_id, lineage_id, us + j * 1000000 AS us, CASE WHEN model LIKE
'<%' THEN model ELSE model END AS model, v % 97 AS input_tok, v % 1009 + 10 * j AS output_tok, v % 90001 AS cache_read_tok, CASE WHEN id % 4 = 3 THEN 0 ELSE v % 4001
END AS cache_w5m_tok, CASE WHEN id % 4 = 3 THEN v % 777 WHEN id % 8 <> 0 THEN v % 11 ELSE 0 END AS cache_w1h_tok, CASE WHEN id % 3 = 0 THEN concat('{{"search":', v % 3,
'}}') END AS server_tool_use, CASE WHEN j = n AND id % 37 <> 0 THEN 'end_turn' END AS stop_reason, CAST(model LIKE '<%' AS INT) AS is_synthetic FROM ev,
generate_series(1, n) g(j) WHERE valid"""


@query("t02_normalize_usage", with_tables("base", extra=EV + (("u", USAGE),)) + "SELECT * EXCLUDE (id, j) FROM u")
def _(L):
    out = M.normalize_usage(parsed(L).good)
    return out.withColumn("us", us("ts")).drop("ts", "seq", "service_tier", "speed", "geo")


CARRY = """SELECT id, last_value(CASE WHEN has_cut OR has_ask THEN pid END IGNORE NULLS) OVER (PARTITION BY lineage_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND
1 PRECEDING) AS before_pid FROM ev"""
PROMPTED = "SELECT ev.*, CASE WHEN id % 29 = 0 THEN pid WHEN has_ask THEN pid ELSE before_pid END AS prompt_id FROM ev JOIN ca USING (id)"
EVP = EV + (("ca", CARRY), ("ep", PROMPTED))


@query("t09_carry_prompt", with_tables("base", extra=EVP) + "SELECT rid AS request_id, prompt_id FROM ep WHERE valid")
def _(L):
    p = parsed(L)
    return p.usage.groupBy("request_id").agg(F.min_by("prompt_id", "seq").alias("prompt_id"))


MERGED = f"""SELECT u.request_id, u.message_id, u.session_id, u.agent_id, u.lineage_id, e.prompt_id, u.us, u.model, u.input_tok, CASE WHEN e.has_cut AND id % 37 = 0
THEN NULL ELSE e.v % 1009 + 10 * e.n END AS output_tok, u.cache_read_tok, u.cache_w5m_tok, u.cache_w1h_tok, u.server_tool_use, CASE WHEN id % 37 <> 0 THEN 'end_turn'
END AS stop_reason, u.is_synthetic, e.us + e.n * 1000000 AS end_us, CAST(e.has_cut AS INT) AS is_interrupted FROM u JOIN ep e USING (id) WHERE u.j = 1"""


@query("t03_merge_requests", with_tables("base", extra=EVP + (("u", USAGE), ("mg", MERGED))) +
       "SELECT * EXCLUDE (is_interrupted, output_tok), (SELECT max(output_tok) FROM u WHERE u.request_id = mg.request_id) AS output_tok FROM mg")
def _(L):
    out = M.merge_requests(parsed(L).usage)
    return out.withColumn("us", us("ts")).withColumn("end_us", us("end_ts")).drop(
        "ts", "end_ts", "raw_path", "first_seq", "first_stop_seq", "service_tier", "speed", "geo")


@query("t04_mark_interrupted", with_tables("base", extra=EVP + (("u", USAGE), ("mg", MERGED))) +
       "SELECT request_id, stop_reason, output_tok, is_interrupted FROM mg")
def _(L):
    return I.merged_requests(stored(L)).select("request_id", "stop_reason", "output_tok", "is_interrupted")


_TIMES = """SELECT sess, us - 1000000 AS t FROM ev WHERE has_ask UNION ALL SELECT sess, us + j * 1000000 FROM ev, generate_series(1, n) g(j) UNION ALL SELECT sess, us +
5000000 FROM ev WHERE has_cut UNION ALL SELECT sess, us + 6000000 FROM ev WHERE id % 2 = 0"""


@query("t05_merge_sessions", with_tables("base", extra=EV + (("t", _TIMES),)) + """SELECT session_id, project, git_branch, cc_version, first_us, last_us FROM (SELECT sess AS
session_id, min(concat('proj-', CAST(usr AS STRING))) AS project, arg_max(CASE WHEN id % 7 = 0 THEN concat('b', CAST(id % 10 AS STRING)) END, path || lpad(CAST(id AS
STRING), 12, '0')) FILTER (id % 7 = 0) AS git_branch, arg_max(CASE WHEN id % 101 = 1 THEN '9.9' ELSE version END, path || lpad(CAST(id AS STRING), 12, '0')) AS cc_version
FROM ev GROUP BY 1) JOIN (SELECT sess AS session_id, min(t) AS first_us, max(t) AS last_us FROM t GROUP BY 1) USING (session_id)""")
def _(L):
    out = M.merge_sessions(S.readable(parsed(L).parsed)).drop("slug")
    return out.withColumn("first_us", us("first_ts")).withColumn("last_us", us("last_ts")).drop("first_ts", "last_ts")


@query("t06_merge_tool_calls", with_tables("base", extra=EVP) + """SELECT tid AS tool_use_id, CASE WHEN valid THEN rid END AS request_id, sess AS session_id, hexid AS agent_id,
CASE WHEN valid THEN coalesce(prompt_id, CASE WHEN id % 43 = 0 AND n >= 2 THEN pid END) END AS prompt_id, CASE WHEN valid THEN CASE WHEN id % 4 = 0 THEN 'Edit'
ELSE 'Bash' END END AS name, CASE WHEN valid THEN us + 1000000 END AS us, CAST(id % 33 = 0 AS INT) AS is_error, 15 + length(CAST(v AS STRING)) AS result_bytes, us + 6000000 AS
result_us, CASE WHEN valid AND id % 4 = 0 THEN concat('/f', tid) END AS file_path, CASE WHEN valid AND id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 3 ELSE 2 END END::BIGINT AS
lines_changed, CASE WHEN id % 10 <> 0 AND id % 18 = 4 THEN concat('wf_', CAST(id % 5 AS STRING)) END AS workflow_run_id FROM ep WHERE id % 2 = 0""")
def _(L):
    p = stored(L)
    out = M.merge_tool_calls(M.tool_uses(p.good), M.tool_results(p.good))
    return out.withColumn("us", us("ts")).withColumn("result_us", us("result_ts")).drop("ts", "result_ts")


@query("t07_tool_change_lines", with_tables("base", extra=EV) + """SELECT tid AS tool_use_id, CASE WHEN id % 6 <> 5 THEN concat('/n', tid) END AS file_path, CASE id % 6 WHEN 0
THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 1 WHEN 4 THEN 2 END::BIGINT AS lines_changed FROM ev""")
def _(L):
    rows = L.base.selectExpr("concat('t', CAST(id AS STRING)) AS tool_use_id", "id").selectExpr("*", """CASE id % 6
WHEN 0 THEN to_json(named_struct('file_path', concat('/n', tool_use_id), 'content', 'a\\nb')) WHEN 1 THEN to_json(named_struct('file_path', concat('/n', tool_use_id),
'old_string', 'a\\nb\\nc', 'new_string', 'x')) WHEN 2 THEN to_json(named_struct('file_path', concat('/n', tool_use_id), 'edits', array(named_struct('old_string', 'a',
'new_string', 'b\\nc'), named_struct('old_string', 'a\\nb\\nc', 'new_string', '')))) WHEN 3 THEN to_json(named_struct('notebook_path', concat('/n', tool_use_id))) WHEN 4 THEN
to_json(named_struct('notebook_path', concat('/n', tool_use_id), 'old_source', 'q', 'new_source', 'q\\nr')) ELSE to_json(named_struct('file_path', 'x')) END AS input""",
        "CASE id % 6 WHEN 0 THEN 'Write' WHEN 1 THEN 'Edit' WHEN 2 THEN 'MultiEdit' WHEN 3 THEN 'NotebookEdit' WHEN 4 THEN 'NotebookEdit' ELSE 'Read' END AS name")
    return rows.select("tool_use_id", M.tool_change_lines(F.col("name"), F.parse_json("input")).alias("c")).select("tool_use_id", "c.*")


_META = """SELECT hexid, sess, usr, id FROM (SELECT hexid, min(sess) AS sess, min(usr) AS usr, min(id) AS id FROM ev WHERE id % 5 = 0 GROUP BY 1)"""


@query("s06_read_agent_meta", with_tables("base", extra=EV + (("me", _META),)) + """SELECT hexid AS agent_id, sess AS session_id, CASE WHEN id % 2 = 0 THEN 'explore' END AS
agent_type, concat('t', CAST(id % 50 AS STRING)) AS parent_tool_use_id, id % 3 AS spawn_depth, CASE WHEN id % 3 = 0 THEN concat('wf_', CAST(id % 5 AS STRING)) END AS
workflow_run_id FROM me WHERE id % 19 <> 0""")
def _(L):
    return S.read_agent_meta(RL.sidecar_files(L))[0].drop("path")


@query("t08_merge_agents", with_tables("base", extra=EV + (
    ("me", _META),
    ("pa", "SELECT concat('ab', CAST(id AS STRING)) AS agent_id, sess AS session_id, 'worker' AS agent_type, CAST(NULL AS STRING) AS par, CAST(NULL AS BIGINT) AS depth, CASE WHEN "
           "id % 20 = 0 THEN 'px-haiku-1' END AS rm, CAST(NULL AS STRING) AS wf, path AS ord FROM ev WHERE id % 10 = 0 UNION ALL SELECT hexid, sess, CASE WHEN id % 2 = 0 THEN "
           "'explore' END, concat('t', CAST(id % 50 AS STRING)), id % 3, NULL, CASE WHEN id % 3 = 0 THEN concat('wf_', CAST(id % 5 AS STRING)) END, concat('proj-', CAST(usr AS "
           "STRING), '/', sess, '/subagents/', CASE WHEN id % 3 = 0 THEN concat('workflows/wf_', CAST(id % 5 AS STRING), '/') ELSE '' END, 'agent-', hexid, '.meta.json') FROM me "
           "WHERE id % 19 <> 0"),
    ("ag", "SELECT agent_id, arg_min(session_id, ord) AS session_id, arg_max(agent_type, ord) FILTER (agent_type IS NOT NULL) AS agent_type, max(par) AS par, max(depth) AS "
           "spawn_depth, max(rm) AS resolved_model, max(wf) AS workflow_run_id FROM pa GROUP BY 1"),
    ("fc", "SELECT concat('wf_', CAST(id % 5 AS STRING)) AS workflow_run_id, arg_min(tid, lpad(CAST(CASE WHEN valid THEN us ELSE 0 END AS STRING), 20, '0') || tid) AS tid FROM ev "
           "WHERE id % 10 <> 0 AND id % 18 = 4 GROUP BY 1"),
)) + """SELECT agent_id, session_id, agent_type, spawn_depth, resolved_model, workflow_run_id, CASE WHEN workflow_run_id IS NOT NULL THEN fc.tid ELSE par END AS
parent_tool_use_id FROM ag LEFT JOIN fc USING (workflow_run_id)""")
def _(L):
    p = stored(L)
    tools = M.merge_tool_calls(M.tool_uses(p.good), M.tool_results(p.good))
    return M.merge_agents(M.spawn_results(p.good), S.read_agent_meta(RL.sidecar_files(L))[0], tools)


_ASKS = """SELECT pid AS prompt_id, sess AS session_id, us - 1000000 AS us, ask || CASE WHEN id % 8 = 1 THEN '' ELSE chr(10) || 'thanks' END AS raw, id, path, row_number() OVER
(PARTITION BY pid ORDER BY path, id) AS rn FROM ev WHERE has_ask AND hexid IS NULL AND id % 20 <> 0"""


@query("t12_extract_prompts", with_tables("base", extra=EV + (
    ("a", _ASKS),
    ("c", "SELECT pid AS prompt_id, arg_max(mid, path || lpad(CAST(id AS STRING), 12, '0')) AS mid, max(path || lpad(CAST(id AS STRING), 12, '0')) AS pos FROM ev WHERE has_cut "
          "GROUP BY 1"),
)) + """SELECT prompt_id, session_id, us, CASE WHEN id % 12 = 1 THEN replace(raw, 'AKIA' || lpad(CAST(id AS STRING), 16, '0'), '[REDACTED:aws_access_key:' || substr(sha256('AKIA'
|| lpad(CAST(id AS STRING), 16, '0')), 1, 12) || ']') ELSE raw END AS text, CASE WHEN c.pos >= path || lpad(CAST(id AS STRING), 12, '0') THEN c.mid END AS interrupted_message_id
FROM a LEFT JOIN c USING (prompt_id) WHERE rn = 1""")
def _(L):
    return M.extract_prompts(parsed(L).good).withColumn("us", us("ts")).drop("ts")


@query("t15_regime_events", with_tables("base", extra=EV) + """SELECT 'cc_version' AS kind, CASE WHEN o = 9 THEN '9.9' ELSE version END AS detail, arg_min(t, pos) AS us FROM (SELECT
version, 0 AS o, t, path || lpad(CAST(id AS STRING), 12, '0') || p AS pos FROM (SELECT version, path, id, us - 1000000 AS t, '10' AS p FROM ev WHERE has_ask UNION ALL SELECT version,
path, id, us + 1000000, '20' FROM ev)) GROUP BY 1, 2 UNION ALL SELECT 'cc_version', '9.9', NULL FROM ev WHERE id % 101 = 1 GROUP BY 1, 2 UNION ALL SELECT 'model_new', model, arg_min(us
+ 1000000, path || lpad(CAST(id AS STRING), 12, '0')) FROM ev WHERE valid AND model = 'px-new-9' GROUP BY 1, 2""")
def _(L):
    p = stored(L)
    out = M.regime_events(S.readable(p.parsed), p.usage, L.price)
    return out.withColumn("us", us("ts")).drop("ts")


# ---- hooks and telemetry ----

@query("s04_read_hooks", with_tables("hook_event") + """SELECT DISTINCT us, kind, session_id, prompt, total_cost_usd FROM (SELECT us, kind, session_id, prompt, round(total_cost_usd, 6)
AS total_cost_usd FROM hook_event) WHERE us % 41 <> 0 AND us % 43 <> 0""")
def _(L):
    good, _bad = E.read_hooks(RL.hook_lines(L))
    out = E.hook_payload(good).withColumn("us", us("ts"))
    return rounded(out.select("us", "kind", "session_id", "prompt", "total_cost_usd").distinct(), total_cost_usd=6)


@query("s04_rejected_hooks", with_tables("hook_event") + """SELECT CASE WHEN us % 41 = 0 THEN 'invalid JSON' ELSE 'invalid hook envelope' END AS reason, CAST(sum(CASE WHEN us % 3 = 0
THEN 2 ELSE 1 END) AS BIGINT) AS n FROM hook_event WHERE us % 41 = 0 OR us % 43 = 0 GROUP BY 1""")
def _(L):
    return E.read_hooks(RL.hook_lines(L))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


OTEL = """SELECT us, CASE WHEN id % 20 = 0 THEN 'api_error' ELSE 'api_request' END AS kind, CASE WHEN id % 36 <> 0 THEN sess END AS session_id, CASE WHEN id % 12 <> 0 THEN
concat('r', lpad(CAST(id AS STRING), 9, '0')) END AS request_id, concat(model, '-20240101') AS model, CASE WHEN id % 8 = 0 THEN 'low' ELSE 'high' END AS effort, v % 97 AS input_tok,
v % 777 AS cache_creation_tok, (v % 500) / 1e4 AS cost_usd_sdk FROM ev WHERE id % 4 = 0 AND id % 28 <> 0 AND id % 92 <> 0 AND id % 36 <> 0"""


@query("s05_read_otlp", with_tables("base", extra=EV + (("o", OTEL),)) + """SELECT us, kind, session_id, request_id, model, effort, input_tok, cache_creation_tok, cost_usd_sdk,
coalesce(request_id, concat_ws(':', session_id, CAST(id AS STRING), kind)) AS dedup_key FROM (SELECT o.*, ev.id FROM o JOIN ev USING (us))""")
def _(L):
    out = E.read_otlp(RL.telemetry_lines(L))[0].withColumn("us", us("ts"))
    return out.select("us", "kind", "session_id", "request_id", "model", "effort", "input_tok", "cache_creation_tok", "cost_usd_sdk", "dedup_key")


@query("s05_rejected_otlp", with_tables("base", extra=EV) + """SELECT CASE WHEN id % 92 = 0 THEN 'telemetry envelope without log records' ELSE
'telemetry event without request id or session and sequence' END AS reason, CAST(sum(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM ev WHERE id % 4 = 0 AND (id % 92 = 0 OR
(id % 36 = 0 AND id % 28 <> 0)) GROUP BY 1""")
def _(L):
    return E.read_otlp(RL.telemetry_lines(L))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("t14_converge_otel", with_tables("base", "request", extra=EV + (
    ("o", OTEL),
    ("q", "SELECT request_id, prompt_id, session_id, us, model, input_tok, cache_w1h_tok, source, query_source, effort, cost_usd_sdk FROM request WHERE input_tok % 5 <> 0"),
    ("e", "SELECT * FROM o WHERE kind = 'api_request' AND request_id IS NOT NULL"),
)) + """SELECT coalesce(q.request_id, e.request_id) AS request_id, CASE WHEN q.request_id IS NULL THEN e.session_id ELSE q.session_id END AS session_id, coalesce(q.us, e.us) AS us,
CASE WHEN q.request_id IS NULL THEN regexp_replace(e.model, '-[0-9]{8}$', '') ELSE q.model END AS model, CASE WHEN q.request_id IS NULL THEN e.input_tok ELSE q.input_tok END AS
input_tok, CASE WHEN q.request_id IS NULL THEN e.cache_creation_tok ELSE q.cache_w1h_tok END AS cache_w1h_tok, CASE WHEN q.request_id IS NULL THEN 'otel' ELSE q.source END AS source,
coalesce(q.effort, e.effort) AS effort, round(coalesce(q.cost_usd_sdk, e.cost_usd_sdk), 8) AS cost_usd_sdk FROM q FULL JOIN e ON q.request_id = e.request_id""")
def _(L):
    known = L.request.where("input_tok % 5 <> 0")
    out = M.converge_otel(known, E.read_otlp(RL.telemetry_lines(L))[0]).withColumn("us", us("ts"))
    return rounded(out.select("request_id", "session_id", "us", "model", "input_tok", "cache_w1h_tok", "source", "effort", "cost_usd_sdk"), cost_usd_sdk=8)


# ---- redaction ----

CORPUS_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("hex40", r"\b[0-9a-f]{40}\b"),
    ("ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
)


def _duck(pattern: str) -> str:
    """The pattern for DuckDB's expressions: word boundaries there are ASCII, long repeats have no bound."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("{0,15000}?", "*?")


def _redact_sql(patterns=CORPUS_PATTERNS) -> str:
    steps, text, found = [], "text", []
    for i, (name, pattern) in enumerate((n, _duck(p)) for n, p in patterns):
        matches = f"regexp_extract_all({text}, '{pattern}')"
        steps.append((f"d{i}", (
            f"SELECT doc_id, list_transform(list_zip(string_split_regex({text}, '{pattern}'), list_append({matches}, '')), lambda z: z[1] || CASE WHEN z[2] = '' THEN '' ELSE "
            f"'[REDACTED:{name}:' || substr(sha256(z[2]), 1, 12) || ']' END).array_to_string('') AS t, list_concat({found[-1] if found else '[]::VARCHAR[]'}, list_transform({matches}, "
            f"lambda m: '{name}:' || substr(sha256(m), 1, 12))) AS f FROM {'documents' if i == 0 else f'd{i - 1}'}")))
        text, found = "t", ["f"]
    return with_tables(extra=tuple(steps)) + f"SELECT doc_id, sha256(t) AS text_sha, len(f) AS n_found, sha256(array_to_string(f, ',')) AS found_sha FROM d{len(patterns) - 1}"


def _redacted(L, patterns):
    from usageloom.functions.redaction import redact

    out = L.table("documents").select("doc_id", redact("text", patterns).alias("r"))
    return out.select("doc_id", F.sha2("r.text", 256).alias("text_sha"), F.size("r.detections").cast("bigint").alias("n_found"),
                      F.sha2(F.array_join("r.detections", ","), 256).alias("found_sha"))


@query("t13_redact", _redact_sql())
def _(L):
    return _redacted(L, CORPUS_PATTERNS)


@query("t13_redact_secrets", _redact_sql(SECRET_PATTERNS))
def _(L):
    """All patterns of secrets, one after the other, over the documents and the secrets planted there."""
    return _redacted(L, SECRET_PATTERNS)


# ---- causal attribution ----

NOTE_TEXT = ("CASE WHEN {n} % 9 = 0 THEN concat('<task-notification><tool-use-id>t', CAST(2 * CAST(floor({n} / 6e0) AS BIGINT) AS STRING), "
             "'</tool-use-id></task-notification>') WHEN {n} % 9 = 1 AND us > 1704326400000000 THEN concat('[SYSTEM NOTIFICATION x] <task-notification><task-id>', {a}, "
             "'</task-id></task-notification> <task-id>ffff</task-id>') ELSE concat('plain <task-notification> ', {n}) END")
_NOTE_AGENT = "concat('a', substr(session_id, 2), 'b', CAST({n} % 3 AS STRING))"


def note_prompts(L):
    base = L.prompt_base.selectExpr("prompt_id", "session_id", "n", "unix_micros(ts) AS us")
    return base.selectExpr("prompt_id", "session_id", NOTE_TEXT.format(n="n", a=_NOTE_AGENT.format(n="n")) + " AS text")


NOTES = (f"SELECT prompt_id, CASE WHEN n % 9 = 0 THEN concat('t', CAST(2 * CAST(floor(n / 6e0) AS BIGINT) AS STRING)) END AS tool_use_id, CASE WHEN n % 9 = 1 THEN "
         f"{_NOTE_AGENT.format(n='n')} END AS agent_id FROM prompt_base WHERE n % 9 = 0 OR (n % 9 = 1 AND us > 1704326400000000)")


@query("t11_parse_notification", with_tables("prompt_base", extra=(("nt", NOTES),)) + "SELECT * FROM nt")
def _(L):
    return AT.parse_notification(note_prompts(L))


def _rounds(k: int) -> tuple[tuple[str, str], ...]:
    steps = [("nt", "MATERIALIZED " + NOTES), ("r0", "MATERIALIZED SELECT request_id, agent_id, prompt_id FROM request"),
             ("t0", "MATERIALIZED SELECT tool_use_id, request_id, prompt_id FROM tool_call")]
    for i in range(1, k + 1):
        p = i - 1
        steps += [
            (f"o{i}", f"MATERIALIZED SELECT nt.prompt_id, coalesce(a.prompt_id, b.prompt_id) AS origin FROM nt LEFT JOIN t{p} a ON a.tool_use_id = nt.tool_use_id LEFT JOIN agent g ON "
                      f"g.agent_id = nt.agent_id LEFT JOIN t{p} b ON b.tool_use_id = g.parent_tool_use_id"),
            (f"x{i}", f"MATERIALIZED SELECT r.request_id, r.agent_id, coalesce(o.origin, r.prompt_id) AS prompt_id FROM r{p} r LEFT JOIN o{i} o ON o.prompt_id = r.prompt_id"),
            (f"r{i}", f"MATERIALIZED SELECT x.request_id, x.agent_id, coalesce(t.prompt_id, x.prompt_id) AS prompt_id FROM x{i} x LEFT JOIN agent g ON g.agent_id = x.agent_id LEFT "
                      f"JOIN t{p} t ON t.tool_use_id = g.parent_tool_use_id"),
            (f"t{i}", f"MATERIALIZED SELECT t.tool_use_id, t.request_id, CASE WHEN r.request_id IS NULL THEN t.prompt_id ELSE r.prompt_id END AS prompt_id FROM t{p} t LEFT JOIN r{i} r "
                      "ON r.request_id = t.request_id"),
        ]
    return tuple(steps)


_T10 = with_tables("request", "tool_call", "agent", "prompt_base", extra=_rounds(16))


@query("t10_causal_attribution", _T10 + "SELECT request_id, prompt_id FROM r16")
def _(L):
    req, _tools = AT.causal_attribution(L.request, L.tool_call, L.agent, note_prompts(L))
    return req.select("request_id", "prompt_id")


@query("t10_tool_attribution", _T10 + "SELECT tool_use_id, prompt_id FROM t16")
def _(L):
    _req, tools = AT.causal_attribution(L.request, L.tool_call, L.agent, note_prompts(L))
    return tools.select("tool_use_id", "prompt_id")


# ---- price lists ----

_PART_PRICE = """named_struct('model', concat('m', CAST(p_partkey AS STRING)), 'valid_from', concat('2024-01-', lpad(CAST(p_size % 28 + 1 AS STRING), 2, '0')),
'valid_to', CASE WHEN p_size % 3 = 0 THEN '2025-01-01' END, 'in_usd', p_retailprice / 1e2, 'out_usd', p_retailprice / 2e1,
'fast_x', CASE WHEN p_size % 2 = 0 THEN 4.0D END, 'source_url', CASE WHEN p_size % 5 = 0 THEN p_type END)"""


@query("s07_load_prices", """SELECT concat('m', CAST(p_partkey AS VARCHAR)) AS model, CAST(concat('2024-01-', lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0')) AS DATE) AS valid_from,
CASE WHEN p_size % 3 = 0 THEN DATE '2025-01-01' END AS valid_to, p_retailprice / 1e2 AS in_usd, p_retailprice / 2e1 AS out_usd, 0.2::DOUBLE AS cache_read_x, 1.25::DOUBLE AS cache_w5m_x,
2.0::DOUBLE AS cache_w1h_x, 0.5::DOUBLE AS batch_x, CASE WHEN p_size % 2 = 0 THEN 4.0 ELSE 3.0 END::DOUBLE AS fast_x, 1.0::DOUBLE AS geo_us_x, CASE WHEN p_size % 5 = 0 THEN p_type ELSE
'parts' END AS source_url FROM part""")
def _(L):
    """Every part as a model in price files of a few hundred models; defaults of the file, then of the library, fill the gaps."""
    root = f"{shared_dir(L.spark)}/usageloom/s07-{uuid.uuid4().hex}"
    rows = L.table("part").selectExpr("CAST(floor(p_partkey / 3e2) AS BIGINT) AS file", f"{_PART_PRICE} AS m")
    files = rows.groupBy("file").agg(F.collect_list("m").alias("models"))
    document = F.to_json(F.struct(F.lit("parts").alias("source_url"), F.struct(F.lit(0.2).alias("cache_read_x"), F.lit(3.0).alias("fast_x")).alias("defaults"), "models",
                                  F.array().cast("array<struct<tool: string>>").alias("server_tools")))
    files.select("file", document.alias("value")).repartition("file").write.partitionBy("file").text(root)
    return PR.load_prices(L.spark, f"{root}/*/*.txt")[0]


# ---- whole path, sinks, manifest ----

def stored_requests(L):
    """One row per request, in files."""
    return cut_lineage(I.merged_requests(I.parse(RL.transcript_lines(L), store=True, contents=False)))


@query("s10_write_ledger", with_tables("base", extra=EVP + (("u", USAGE), ("mg", MERGED))) + """SELECT count(*) AS n, CAST(sum(output_tok) AS BIGINT) AS output_tok, CAST(sum(is_interrupted)
AS BIGINT) AS interrupted FROM mg""")
def _(L):
    """Written twice to the shared folder and read back: the second write changes nothing."""
    target = f"{shared_dir(L.spark)}/usageloom/s10-{uuid.uuid4().hex}"
    requests = stored_requests(L)
    for _ in range(2):
        sinks.write_ledger({"request": requests}, target, stored=True)
    back = sinks.read_ledger(L.spark, target, "request")
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("output_tok").alias("output_tok"), F.sum("is_interrupted").cast("bigint").alias("interrupted"))


@query("s10_incremental", with_tables("base", extra=EVP + (("u", USAGE), ("mg", MERGED))) + """SELECT request_id, output_tok, is_interrupted,
us, strftime(make_timestamp(us), '%Y-%m-%d') AS day FROM mg""")
def _(L):
    """Three overlapping batches, in the first of which a quarter of the requests stand a day late; the end state is one full build."""
    target = f"{shared_dir(L.spark)}/usageloom/s10-{uuid.uuid4().hex}"
    requests = stored_requests(L)
    slot = F.pmod(F.xxhash64("request_id"), F.lit(4))
    late = F.when(slot == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    for batch in (requests.where(slot <= 1).withColumn("ts", late).withColumn("output_tok", F.lit(None).cast("bigint")),
                  requests.where(slot <= 2), requests.where("pmod(xxhash64(request_id), 4) IN (0, 3)"), requests.where(slot == 3)):
        sinks.write_ledger({"request": batch}, target, stored=True)
    back = sinks.read_ledger(L.spark, target, "request")
    return back.select("request_id", "output_tok", "is_interrupted", us("ts").alias("us"), F.col("utc_day").cast("string").alias("day"))


@query("s11_export_json", with_tables("work_task") + """SELECT '{"task_id":"' || task_id || '","category":"' || category || '"' || CASE WHEN outcome IS NULL THEN '' ELSE ',"outcome":"' ||
outcome || '"' END || '}' AS value FROM work_task""")
def _(L):
    return sinks.as_json(L.work_task.select("task_id", "category", "outcome"))


_SEGMENTS = """SELECT concat('f', CAST(o_custkey AS STRING)) AS path, o_orderkey % 2 AS gen, CAST(100 * (row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) - 1) + CASE WHEN
o_orderkey % 97 = 0 THEN 7 ELSE 0 END AS BIGINT) AS start, CAST(100 * row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS BIGINT) AS "end", concat('g', CAST(o_orderkey AS STRING)) AS seg
FROM orders"""


@query("s09_manifest_audit", with_tables(extra=(
    ("m", _SEGMENTS),
    ("l", "SELECT * FROM m WHERE gen = (SELECT max(gen) FROM m x WHERE x.path = m.path)"),
    ("p", 'SELECT *, coalesce(lag("end") OVER (PARTITION BY path ORDER BY start, seg), 0) AS expected_start FROM l'),
)) + "SELECT path, gen, seg, 'gap' AS problem, expected_start, start FROM p WHERE start <> expected_start")
def _(L):
    from usageloom.sources.manifest import manifest_audit

    L.table("orders").createOrReplaceTempView("usageloom_orders")
    segments = L.spark.sql(_SEGMENTS.replace("FROM orders", "FROM usageloom_orders").replace('"end"', "`end`"))
    return manifest_audit(segments)
