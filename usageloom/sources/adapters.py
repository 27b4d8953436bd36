"""Ledger tables derived from the generic driver tables.

The same scalar expressions are used for Spark and for the comparison SQL, so
that both sides start from equal rows.  Only the spelling of "epoch
microseconds of a timestamp" differs between the engines.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

SPARK_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
DUCK_US = "epoch_us(ts)"

BASE = {
    "id": "event_id",
    "us": "{us}",
    "v": "CAST(floor(value * 100) AS BIGINT)",
    "usr": "CAST(floor(user_id / 1e1) AS BIGINT)",
    "et": "event_type",
    "props": "props",
}

_SESSION_NO = "(usr * 1000 + CAST(floor(us / 1.728e11) AS BIGINT) % 1000)"
_PROMPT_NO = "(usr * 100000 + CAST(floor(us / 1.08e10) AS BIGINT) % 100000)"
_MODEL_NO = "((CAST(floor(us / 4.32e10) AS BIGINT) + usr) % 3)"
_SESSION = f"concat('s', CAST({_SESSION_NO} AS STRING))"
_AGENT = (
    f"CASE WHEN id % 5 = 0 THEN concat('a', CAST({_SESSION_NO} AS STRING), 'b', "
    "CAST(id % 3 AS STRING)) END"
)

REQUEST = {
    "request_id": "concat('r', lpad(CAST(id AS STRING), 9, '0'))",
    "message_id": "concat('m', lpad(CAST(id AS STRING), 9, '0'))",
    "session_id": _SESSION,
    "agent_id": _AGENT,
    "lineage_id": f"concat({_SESSION}, CASE WHEN id % 5 = 0 THEN concat('/a', "
    f"CAST({_SESSION_NO} AS STRING), 'b', CAST(id % 3 AS STRING)) ELSE '' END)",
    "prompt_id": f"CASE WHEN id % 23 <> 0 THEN concat('p', CAST({_PROMPT_NO} AS STRING)) END",
    "us": "us",
    "model": "CASE WHEN et = 'error' AND id % 4 = 0 THEN 'px-new-9' "
    f"WHEN {_MODEL_NO} = 0 THEN 'px-haiku-1' WHEN {_MODEL_NO} = 1 THEN 'px-sonnet-2' "
    "ELSE 'px-opus-3' END",
    "input_tok": "v % 97",
    "output_tok": "CASE WHEN id % 37 <> 0 THEN v % 1009 END",
    "cache_read_tok": "CASE WHEN id % 50 = 7 THEN 200000 + (v * 13) % 600000 "
    "WHEN id % 4 = 0 THEN (v * 7) % 200003 ELSE 40000 + usr * 100 END",
    "cache_w5m_tok": "CASE WHEN id % 6 = 0 THEN v % 4001 ELSE 0 END",
    "cache_w1h_tok": "CASE WHEN id % 7 = 1 THEN v % 8009 ELSE 0 END",
    "server_tool_use": "CASE WHEN id % 101 = 0 THEN 'not json' WHEN id % 3 = 0 THEN "
    "concat('{\"search\": ', CAST(v % 3 AS STRING), ', \"fetch\": ', CAST(v % 2 AS STRING), "
    "', \"crawl\": ', CAST(id % 2 AS STRING), '}') END",
    "service_tier": "CASE WHEN id % 29 = 0 THEN 'batch' ELSE 'standard' END",
    "speed": "CASE WHEN id % 31 = 0 THEN 'fast' END",
    "geo": "CASE WHEN id % 19 = 0 THEN 'us-east' WHEN id % 19 = 1 THEN 'eu-west' END",
    "stop_reason": "CASE WHEN id % 37 = 0 THEN NULL WHEN id % 3 = 0 THEN 'tool_use' "
    "ELSE 'end_turn' END",
    "is_synthetic": "CAST(CASE WHEN id % 41 = 0 THEN 1 ELSE 0 END AS INT)",
    "is_interrupted": "CAST(CASE WHEN id % 37 = 0 OR id % 43 = 0 THEN 1 ELSE 0 END AS INT)",
    "source": "CASE WHEN id % 40 = 0 THEN 'otel' ELSE 'transcript' END",
    "raw_path": f"concat(CAST(usr AS STRING), '/', {_SESSION}, '.jsonl')",
    "query_source": "CASE WHEN id % 80 = 0 THEN 'title' WHEN id % 40 = 0 THEN 'summary' END",
    "effort": "CASE WHEN id % 5 = 4 THEN NULL WHEN id % 4 = 0 THEN 'low' WHEN id % 4 = 1 THEN "
    "'medium' WHEN id % 4 = 2 THEN 'high' ELSE 'max' END",
    "cost_usd_sdk": "CASE WHEN id % 4 = 1 THEN (v % 500) / 1e4 + 1e-2 END",
    "end_us": "CASE WHEN id % 53 <> 0 THEN us + (v % 30000) * 1000 END",
    "api_duration_ms": "CASE WHEN id % 4 = 2 THEN CAST(v % 20000 AS DOUBLE) END",
}

TOOL_CALL = {
    "tool_use_id": "concat('t', CAST(id AS STRING))",
    "request_id": "concat('r', lpad(CAST(id AS STRING), 9, '0'))",
    "session_id": _SESSION,
    "agent_id": _AGENT,
    "prompt_id": f"CASE WHEN id % 46 <> 0 THEN concat('p', CAST({_PROMPT_NO} AS STRING)) END",
    "name": "CASE WHEN id % 4 = 0 THEN 'Edit' WHEN id % 6 = 2 THEN 'Read' ELSE 'Bash' END",
    "us": "us + 1000000",
    "is_error": "CAST(CASE WHEN id % 33 = 0 THEN 1 ELSE 0 END AS INT)",
    "result_bytes": "v % 9001",
    "result_us": "CASE WHEN id % 26 <> 0 THEN us + 1000000 + (v % 60000) * 1000 END",
}
TOOL_CALL_FILTER = "id % 2 = 0"

# Hook events: (filter, kind, seconds after the event, cost sample).
HOOKS = (
    ("id % 33 = 0", "PreCompact", 2, "NULL"),
    ("id % 33 = 11", "SessionStart", -3, "NULL"),
    ("id % 6 = 5", "UserPromptSubmit", -1, "NULL"),
    ("id % 9 = 8", "Stop", 20, "NULL"),
    ("id % 7 = 3", "statusline_sample", 4, "(us % 86400000000) / 1e10 + (v % 100) / 1e3"),
    ("id % 47 = 7", "nudge_fired", 1, "NULL"),
)
# The text of a submitted prompt; a few of them are hand-offs.
HOOK_PROMPT = (
    "CASE WHEN id % 6 <> 5 THEN NULL WHEN id % 42 = 5 THEN '  /handoff now' ELSE "
    "concat('do ', et) END"
)
NUDGE_RULE = (
    "CASE WHEN id % 47 <> 7 THEN NULL WHEN id % 5 = 0 THEN 'runaway_guard' WHEN id % 5 = 1 THEN "
    "'budget_warn_80' WHEN id % 5 = 2 THEN 'ctx_warn' WHEN id % 5 = 3 THEN 'budget_warn_50' "
    "ELSE 'ttl_prenotify' END"
)

PROJECT = (
    "CASE WHEN {n} % 40 = 11 THEN NULL WHEN {n} % 40 = 3 THEN '-private-tmp-job' "
    "WHEN {n} % 40 = 5 THEN 'lab-sandbox-experiments' ELSE "
    "concat('proj-', CAST({n} % 40 AS STRING)) END"
)

PRICE_ROWS = (
    ("px-haiku-1", "2023-01-01", "2024-01-15", 0.8, 4.0),
    ("px-haiku-1", "2024-01-15", None, 1.2, 6.0),
    ("px-sonnet-2", "2023-01-01", None, 4.0, 20.0),
    ("px-opus-3", "2023-01-01", None, 16.0, 80.0),
    ("px-opus-3", "2024-01-20", "2024-01-25", 12.0, 60.0),  # overlaps: the later start wins
)
PRICE_X = "0.1D, 1.25D, 2.0D, 0.5D, 2.0D, 1.2D"
TOOL_PRICE_ROWS = (
    ("search", "2023-01-01", "2024-01-12", 0.01),
    ("search", "2024-01-12", None, 0.02),
    ("fetch", "2024-01-10", None, 0.004),
)


def _date(value: str | None) -> str:
    return f"DATE'{value}'" if value else "CAST(NULL AS DATE)"


def price_values(engine: str) -> tuple[str, str]:
    """VALUES clauses of the price tables in the given SQL dialect."""
    d = "D" if engine == "spark" else "::DOUBLE"
    x = ", ".join(f"{n}{d}" for n in (0.1, 1.25, 2.0, 0.5, 2.0, 1.2))
    price = ", ".join(
        f"('{m}', {_date(a)}, {_date(b)}, {i}{d}, {o}{d}, {x}, 'list')"
        for m, a, b, i, o in PRICE_ROWS
    )
    tool = ", ".join(
        f"('{t}', {_date(a)}, {_date(b)}, {u}{d}, 'list')" for t, a, b, u in TOOL_PRICE_ROWS
    )
    return price, tool


def _select(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}" for name, e in exprs.items()]


def _instants(df: DataFrame, names: dict[str, str]) -> DataFrame:
    for source, target in names.items():
        df = df.withColumn(target, F.timestamp_micros(source)).drop(source)
    return df


class DriverLedger:
    """Lazily derived ledger tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, stream: bool = False):
        self.spark, self.dir, self.stream = spark, sf_dir, stream

    def table(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        if self.stream:
            schema = self.spark.read.parquet(path).schema
            return self.spark.readStream.schema(schema).parquet(path + "*")
        return self.spark.read.parquet(path)

    def streaming(self) -> "DriverLedger":
        """The same tables as streams over the files."""
        return DriverLedger(self.spark, self.dir, stream=True)

    @property
    def base(self) -> DataFrame:
        return self.table("events").selectExpr(
            *_select({k: e.format(us=SPARK_US) for k, e in BASE.items()})
        )

    @property
    def request(self) -> DataFrame:
        rows = self.base.selectExpr(
            *_select({k: e for k, e in REQUEST.items()})
        )
        return _instants(rows, {"us": "ts", "end_us": "end_ts"})

    @property
    def tool_call(self) -> DataFrame:
        rows = self.base.where(TOOL_CALL_FILTER).selectExpr(*_select(TOOL_CALL))
        return _instants(rows, {"us": "ts", "result_us": "result_ts"}).withColumn(
            "workflow_run_id", F.lit(None).cast("string")
        )

    @property
    def session(self) -> DataFrame:
        rows = self.base.groupBy(F.expr(_SESSION).alias("session_id")).agg(
            F.min("usr").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
        )
        rows = rows.where("(n * 7 + CAST(floor(first_us / 1.728e11) AS BIGINT)) % 17 <> 0")
        rows = rows.withColumn("project", F.expr(PROJECT.format(n="n"))).drop("n")
        return _instants(rows, {"first_us": "first_ts", "last_us": "last_ts"})

    @property
    def prompt(self) -> DataFrame:
        rows = (
            self.base.where("id % 23 <> 0")
            .groupBy(F.expr(f"concat('p', CAST({_PROMPT_NO} AS STRING))").alias("prompt_id"))
            .agg(
                F.min(F.expr(_SESSION)).alias("session_id"),
                F.min("us").alias("us"),
                F.min("id").alias("n"),
            )
        )
        rows = rows.selectExpr(*_select(PROMPT))
        return _instants(rows, {"us": "ts"})

    @property
    def agent(self) -> DataFrame:
        rows = (
            self.base.where("id % 5 = 0 AND id % 105 <> 0")
            .groupBy(F.expr(_AGENT).alias("agent_id"))
            .agg(F.min(F.expr(_SESSION)).alias("session_id"), F.min("id").alias("n"))
        )
        return rows.selectExpr(*_select(AGENT))

    @property
    def hook_event(self) -> DataFrame:
        parts = None
        for where, kind, after, cost in HOOKS:
            part = self.base.where(where).selectExpr(
                f"us + {after} * 1000000 AS us", f"'{kind}' AS kind",
                f"{_SESSION} AS session_id", "CAST(NULL AS STRING) AS prompt_id",
                f"CAST({cost} AS DOUBLE) AS total_cost_usd",
                f"CASE WHEN '{kind}' = 'UserPromptSubmit' THEN {HOOK_PROMPT} END AS prompt",
                f"CASE WHEN '{kind}' = 'nudge_fired' THEN {NUDGE_RULE} END AS rule",
                f"CASE WHEN '{kind}' = 'statusline_sample' THEN CAST(v % 100 AS DOUBLE) END AS context_pct",
            )
            parts = part if parts is None else parts.unionByName(part)
        return _instants(parts, {"us": "ts"})

    def _derived(self, name: str) -> DataFrame:
        source, where, exprs, *grouped = DERIVED[name]
        if source == "base":
            rows = self.base
        elif source in DERIVED:
            rows = self._derived(source)
        else:
            rows = self.table(source)
        rows = rows.where(where)
        if not grouped:
            return rows.selectExpr(*_select(exprs))
        (key, expr), *aggs = exprs.items()
        return rows.groupBy(F.expr(expr).alias(key)).agg(*[F.expr(e).alias(n) for n, e in aggs])

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DERIVED:
            raise AttributeError(name)
        rows = self._derived(name)
        return _instants(rows, {a: b for a, b in _US_NAMES.items() if a in rows.columns})

    @property
    def fired(self) -> DataFrame:
        return self.hook_event.where("kind = 'nudge_fired'").selectExpr(
            "rule", "ts AS fired_ts", "session_id"
        )

    @property
    def price(self) -> DataFrame:
        return self.spark.sql(
            f"SELECT * FROM VALUES {price_values('spark')[0]} AS t(model, valid_from, valid_to, "
            "in_usd, out_usd, cache_read_x, cache_w5m_x, cache_w1h_x, batch_x, fast_x, geo_us_x, "
            "source_url)"
        )

    @property
    def price_tool(self) -> DataFrame:
        return self.spark.sql(
            f"SELECT * FROM VALUES {price_values('spark')[1]} AS t(tool, valid_from, valid_to, "
            "usd_per_unit, source_url)"
        )

    @property
    def cost(self) -> DataFrame:
        from usageloom.operators.pricing import cost_requests

        return cost_requests(self.request, self.price, self.price_tool)


_ORDER_US = "1704067200000000 + (o_orderkey % 2900) * 900000000"
_ORDER_END = f"CASE WHEN o_orderkey % 150 <> 0 THEN {_ORDER_US} + (o_custkey % 500) * 60000000 END"

# Judgment tables: source, filter, columns.
DERIVED = {
    "prompt_base": (
        "base", "id % 23 <> 0",
        {
            "prompt_id": f"concat('p', CAST({_PROMPT_NO} AS STRING))",
            "session_id": f"min({_SESSION})", "us": "min(us)", "n": "min(id)",
        },
        "GROUP",
    ),
    "outcome": (
        "prompt_base", "n % 6 < 3",
        {
            "prompt_id": "prompt_id", "us": "us + 3600000000",
            "label": "CASE WHEN n % 6 = 1 THEN 'reverted' ELSE 'completed' END",
            "source": "CASE WHEN n % 12 = 1 THEN 'manual' ELSE 'auto' END",
        },
    ),
    "work_task": (
        "orders", "o_orderkey % 50 = 0",
        {
            "task_id": "concat('k', CAST(o_orderkey AS STRING))",
            "title": "concat('task ', o_orderpriority)",
            "category": "CASE WHEN o_orderkey % 100 = 0 THEN 'feature' ELSE 'chore' END",
            "us_start": _ORDER_US,
            "us_end": _ORDER_END,
            "outcome": "CASE WHEN o_orderkey % 150 <> 0 THEN CASE WHEN o_orderstatus = 'F' THEN "
            "'completed' ELSE 'partial' END END",
            "quality_score": "CASE WHEN o_orderkey % 200 <> 0 THEN o_custkey % 5 + 1 END",
        },
    ),
    "task_prompt": (
        "prompt_base", "n % 4 = 0",
        {
            "task_id": "concat('k', CAST(CAST(floor(n / 2e2) AS BIGINT) * 50 AS STRING))",
            "prompt_id": "prompt_id", "us": "us",
        },
    ),
    "marker": (
        "orders", "TRUE",
        {
            "marker_id": "concat('v', CAST(o_orderkey AS STRING))",
            "category": "o_orderpriority",
            "us_start": _ORDER_US,
            "us_end": f"CASE WHEN o_orderkey % 300 <> 7 THEN {_ORDER_US} + (1 + o_custkey % 500) * 600000000 END",
            "verdict": "CASE WHEN o_orderkey % 3 = 0 THEN 'win' WHEN o_orderkey % 3 = 1 THEN 'loss' END",
            "us_verdict": f"CASE WHEN o_orderkey % 2 = 1 THEN {_ORDER_US} + 864000000000 END",
            "saving_usd": "o_totalprice / 1e4",
            "saving_low_usd": "CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice / 2e4 END",
            "saving_high_usd": "CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice / 5e3 END",
        },
    ),
    "roi_cost": (
        "orders", "o_orderkey % 60 = 3",
        {
            "cost_id": "concat('c', CAST(o_orderkey AS STRING))", "us": _ORDER_US,
            "kind": "CASE WHEN o_custkey % 2 = 0 THEN 'review' ELSE 'setup' END",
            "minutes": "CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey % 50 AS DOUBLE) END",
            "usd": "CASE WHEN o_custkey % 3 <> 1 THEN o_totalprice / 1e5 END",
        },
    ),
    "quarantine": (
        "base", "id % 997 = 3",
        {"us": "us", "src": "'transcript'", "reason": "concat('bad record of kind ', et)"},
    ),
    "ingest_log": ("base", "id % 1000 = 999", {"us": "us + 60000000", "records": "id"}),
    "otel_event": ("base", "id % 4 = 0", {"us": "us", "kind": "'api_request'", "session_id": _SESSION}),
}
_US_NAMES = {"us": "ts", "us_start": "ts_start", "us_end": "ts_end", "us_verdict": "verdict_ts"}

PROMPT = {
    "prompt_id": "prompt_id",
    "session_id": "session_id",
    "us": "us - 5000000",
    "text": "concat('task ', CAST(n % 1000 AS STRING), chr(10), 'please look at item number ', "
    "CAST(n AS STRING), ' and then report what was found there')",
    "interrupted_message_id": "CASE WHEN n % 13 = 0 THEN concat('lost', CAST(n AS STRING)) WHEN "
    "n % 13 = 1 THEN concat('m', lpad(CAST(n AS STRING), 9, '0')) END",
    "task_label": "CASE WHEN n % 5 = 0 THEN 'feature' WHEN n % 5 = 1 THEN 'refactor' END",
}
AGENT = {
    "agent_id": "agent_id",
    "session_id": "session_id",
    "agent_type": "CASE WHEN n % 2 = 0 THEN 'explore' ELSE 'worker' END",
    "parent_tool_use_id": "CASE WHEN n % 35 <> 0 THEN concat('t', CAST(2 * "
    "CAST(floor(n / 4e0) AS BIGINT) AS STRING)) END",
    "spawn_depth": "n % 3",
    "resolved_model": "CASE WHEN n % 4 = 0 THEN 'px-haiku-1' END",
    "workflow_run_id": "CAST(NULL AS STRING)",
}


# ---- the same tables as common table expressions of the comparison SQL ----

def _cte(name: str, body: str) -> str:
    if body.startswith("MATERIALIZED "):
        return f"{name} AS MATERIALIZED ({body.removeprefix('MATERIALIZED ')})"
    return f"{name} AS ({body})"


@lru_cache(maxsize=None)
def sql_tables() -> dict[str, str]:
    """Body of each derived table in DuckDB SQL."""
    base = ", ".join(_select({k: e.format(us=DUCK_US) for k, e in BASE.items()}))
    request = ", ".join(
        _select({k: e for k, e in REQUEST.items()})
    )
    price, tool = price_values("duckdb")
    hooks = " UNION ALL ".join(
        f"SELECT us + {after} * 1000000 AS us, '{kind}' AS kind, {_SESSION} AS session_id, "
        f"CAST(NULL AS STRING) AS prompt_id, CAST({cost} AS DOUBLE) AS total_cost_usd, "
        f"CASE WHEN '{kind}' = 'UserPromptSubmit' THEN {HOOK_PROMPT} END AS prompt, "
        f"CASE WHEN '{kind}' = 'nudge_fired' THEN {NUDGE_RULE} END AS rule, CASE WHEN '{kind}' = "
        f"'statusline_sample' THEN CAST(v % 100 AS DOUBLE) END AS context_pct FROM base WHERE {where}"
        for where, kind, after, cost in HOOKS
    )
    derived = {
        name: f"SELECT {', '.join(_select(exprs))} FROM {source} WHERE {where}"
        + (" GROUP BY 1" if grouped else "")
        for name, (source, where, exprs, *grouped) in DERIVED.items()
    }
    return derived | {
        "base": f"SELECT {base} FROM events",
        "request": f"SELECT {request} FROM base",
        "tool_call": f"SELECT {', '.join(_select(TOOL_CALL))} FROM base WHERE {TOOL_CALL_FILTER}",
        "session": f"SELECT session_id, {PROJECT.format(n='n')} AS project, first_us, last_us FROM "
        f"(SELECT {_SESSION} AS session_id, min(usr) AS n, min(us) AS first_us, max(us) AS last_us "
        "FROM base GROUP BY 1) WHERE (n * 7 + CAST(floor(first_us / 1.728e11) AS BIGINT)) "
        "% 17 <> 0",
        "prompt": f"SELECT {', '.join(_select(PROMPT))} FROM (SELECT concat('p', "
        f"CAST({_PROMPT_NO} AS STRING)) AS prompt_id, min({_SESSION}) AS session_id, min(us) AS us, "
        "min(id) AS n FROM base WHERE id % 23 <> 0 GROUP BY 1)",
        "agent": f"SELECT {', '.join(_select(AGENT))} FROM (SELECT {_AGENT} AS agent_id, "
        f"min({_SESSION}) AS session_id, min(id) AS n FROM base WHERE id % 5 = 0 AND id % 105 <> 0 "
        "GROUP BY 1)",
        "hook_event": hooks,
        "price": f"SELECT * FROM (VALUES {price}) t(model, valid_from, valid_to, in_usd, out_usd, "
        "cache_read_x, cache_w5m_x, cache_w1h_x, batch_x, fast_x, geo_us_x, source_url)",
        "price_tool": f"SELECT * FROM (VALUES {tool}) t(tool, valid_from, valid_to, usd_per_unit, "
        "source_url)",
        "priced": "SELECT r.*, p.in_usd, p.out_usd, p.cache_read_x, p.cache_w5m_x, p.cache_w1h_x, "
        "(CASE WHEN r.service_tier = 'batch' THEN p.batch_x ELSE 1.0::DOUBLE END) * (CASE WHEN "
        "r.speed = 'fast' THEN p.fast_x ELSE 1.0::DOUBLE END) * (CASE WHEN r.geo LIKE 'us%' THEN "
        "p.geo_us_x ELSE 1.0::DOUBLE END) AS price_factor FROM (SELECT *, "
        "CAST(make_timestamp(us) AS DATE) AS utc_day FROM request WHERE is_synthetic = 0) r "
        "LEFT JOIN LATERAL (SELECT * FROM price c WHERE c.model = r.model AND r.utc_day >= "
        "c.valid_from AND (c.valid_to IS NULL OR r.utc_day < c.valid_to) ORDER BY c.valid_from "
        "DESC LIMIT 1) p ON true",
        "units": "SELECT request_id, CAST(make_timestamp(us) AS DATE) AS utc_day, tool, "
        "CAST(json_extract(server_tool_use, '$.' || tool) AS DOUBLE) AS units FROM request, "
        "(VALUES ('search'), ('fetch'), ('crawl')) k(tool) WHERE is_synthetic = 0 AND "
        "server_tool_use IS NOT NULL AND json_valid(server_tool_use)",
        "tool_usd": "SELECT request_id, sum(units * usd_per_unit) AS server_tool_usd FROM (SELECT "
        "u.*, p.usd_per_unit, row_number() OVER (PARTITION BY u.request_id, u.tool ORDER BY "
        "p.valid_from DESC) AS rn FROM units u JOIN price_tool p ON p.tool = u.tool AND u.utc_day "
        ">= p.valid_from AND (p.valid_to IS NULL OR u.utc_day < p.valid_to)) WHERE rn = 1 "
        "GROUP BY request_id",
        "cost": "SELECT *, token_cost_usd + server_tool_usd AS cost_usd FROM (SELECT p.*, "
        "(coalesce(input_tok,0)*in_usd + coalesce(cache_read_tok,0)*in_usd*cache_read_x + "
        "coalesce(cache_w5m_tok,0)*in_usd*cache_w5m_x + coalesce(cache_w1h_tok,0)*in_usd*"
        "cache_w1h_x + coalesce(output_tok,0)*out_usd) / 1e6 * price_factor AS token_cost_usd, "
        "coalesce(s.server_tool_usd, 0.0) AS server_tool_usd, (coalesce(cache_w5m_tok,0)*in_usd*"
        "cache_w5m_x + coalesce(cache_w1h_tok,0)*in_usd*cache_w1h_x) / 1e6 * price_factor AS "
        "cache_write_usd FROM priced p LEFT JOIN tool_usd s USING (request_id))",
    }


DEPENDS = {
    **{n: (d[0],) if d[0] == "base" or d[0] in DERIVED else () for n, d in DERIVED.items()},
    "base": (),
    "request": ("base",),
    "tool_call": ("base",),
    "session": ("base",),
    "prompt": ("base",),
    "agent": ("base",),
    "hook_event": ("base",),
    "price": (),
    "price_tool": (),
    "priced": ("request", "price"),
    "units": ("request",),
    "tool_usd": ("units", "price_tool"),
    "cost": ("priced", "tool_usd"),
}


def with_tables(*names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """``WITH`` clause defining the named tables and everything they need."""
    bodies, done = sql_tables(), []

    def add(name: str):
        for needed in DEPENDS[name]:
            add(needed)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    parts = [_cte(n, bodies[n]) for n in done] + [_cte(n, b) for n, b in extra]
    return "WITH RECURSIVE " + ", ".join(parts) + " "
