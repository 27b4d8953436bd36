"""Streaming forms, run to completion over the derived ledger as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from usageloom.catalog import rawlines as RL
from usageloom.catalog.ingest import EVP, MERGED, USAGE
from usageloom.catalog import state as C
from usageloom.catalog.registry import SQL, query, rounded, us
from usageloom.operators import merge as M, pointintime as P
from usageloom.session import cut_lineage, shared_dir
from usageloom.sources import sinks, transcripts as S
from usageloom.sources.adapters import with_tables
from usageloom.streaming import budgets as SB, requests as SR, state as ST, windows as SW

_DAY = 86_400_000_000


@query("r11_stream_daily", with_tables("cost") + f"""SELECT day_us, count(*) AS n_requests, round(sum(cost_usd), 8) AS cost_usd FROM (SELECT cost_usd, CAST(floor((us - 54000000000) / 86400e6)
AS BIGINT) * {_DAY} + 54000000000 AS day_us FROM cost) WHERE day_us + {_DAY} <= (SELECT max(us) FROM cost) - {_DAY} GROUP BY 1""")
def _(L):
    """Days of UTC+9 start at 15:00 UTC; only days the watermark has passed are compared."""
    out = SW.run_available(SW.stream_daily(L.streaming().cost, "1 day", "15 hours"), "daily")
    return rounded(out.withColumn("day_us", us("day_start")).drop("day_start"), cost_usd=8)


def dealt_files(df, name, slot, files):
    """The rows of ``df`` dealt into ``files`` folders by ``slot``; returns ``stream(n)`` over the first ``n`` of them.

    A stream restarted with one folder more takes it as one batch, of however many files it is; else the
    watermark could pass rows of a folder before they are read.
    """
    root = f"{shared_dir(df.sparkSession)}/usageloom/files-{name}-{uuid.uuid4().hex}"
    df.withColumn("_file", slot.cast("int")).hint("rebalance", "_file").write.partitionBy("_file").parquet(root)

    def stream(n):
        shown = "{" + ",".join(map(str, range(n))) + "}"
        return SW.stream_parquet(df.sparkSession, f"{root}/_file={shown}/*.parquet", df.schema, max_files=2**31 - 1)

    return stream


def by_time(df, files=3, late_us=6 * 3_600_000_000):
    """Slot of a row that arrives up to ``late_us`` too early or too late for its instant."""
    lo, hi = df.agg(F.min(us("ts")), F.max(us("ts"))).first()
    moved = us("ts") + F.pmod(F.xxhash64(us("ts"), "session_id"), F.lit(2 * late_us)) - late_us
    return F.greatest(F.lit(0), F.least(F.lit(files - 1), F.floor((moved - (lo or 0)) * files / ((hi or 0) - (lo or 0) + 1))))


def over_restarts(stream, build, name, files=3, **options):
    """Run ``build(stream)`` to the end of 1, 2, ... files, each time restarted from its checkpoint."""
    target = f"{shared_dir(stream(1).sparkSession)}/usageloom/runs-{name}-{uuid.uuid4().hex}"
    for n in range(1, files + 1):
        out = SW.run_available(build(stream(n)), name, target, **options)
    return out


@query("r10_stream_requests", with_tables("base", extra=EVP + (("u", USAGE), ("mg", MERGED))) + """SELECT * EXCLUDE (is_interrupted, output_tok, prompt_id), (SELECT
max(output_tok) FROM u WHERE u.request_id = mg.request_id) AS output_tok FROM mg""")
def _(L):
    """Records dealt over four folders in any order, one folder per batch, with a restart after each."""
    usage = M.normalize_usage(S.parse_records(RL.transcript_lines(L)).where(F.col("reason").isNull()))
    files = dealt_files(usage, "usage", F.pmod(F.xxhash64("request_id", "seq"), F.lit(4)), 4)
    target = f"{shared_dir(L.spark)}/usageloom/r10-{uuid.uuid4().hex}"
    for shown in (1, 2, 3, 4):
        parts = SR.stream_request_parts(files(shown), "90 days", "10 days")
        SW.for_each_batch(parts, SR.request_writer(f"{target}/ledger"), f"{target}/checkpoint", "update").awaitTermination()
    out = sinks.read_ledger(L.spark, f"{target}/ledger", "request")
    return out.withColumn("us", us("ts")).withColumn("end_us", us("end_ts")).drop(
        "ts", "end_ts", "utc_day", "raw_path", "first_seq", "first_stop_seq", "service_tier", "speed", "geo", "prompt_id")


@query("r12_stream_sessions", with_tables("request", extra=(
    ("f", "SELECT session_id, us, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w >= 1800000000 THEN 1 ELSE 0 END AS st FROM request WINDOW w AS (PARTITION BY session_id ORDER BY us)"),
    ("g", "SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS grp FROM f"),
    ("s", "SELECT session_id, count(*) AS n_events, min(us) AS start_us, max(us) AS end_us FROM g GROUP BY session_id, grp"),
)) + "SELECT * FROM s WHERE end_us + 1800000000 <= (SELECT max(us) FROM request) - 600000000")
def _(L):
    out = SW.run_available(SW.stream_sessions(L.streaming().request, "session_id", "30 minutes"), "sessions")
    return out.select("session_id", "n_events", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"))


@query("t09_carry_prompt_stream", with_tables("base", extra=EVP) + "SELECT rid AS request_id, prompt_id FROM ep WHERE valid")
def _(L):
    """The first half of the events is in the ledger, the rest arrives in three files with a restart after each."""
    good = S.parse_records(RL.transcript_lines(L)).where("reason IS NULL AND rec.type IN ('user', 'assistant')")
    records = cut_lineage(good.select("seq", "lineage_id", "request_id", F.struct("rec.type", "rec.promptId").alias("rec")))
    half = records.agg(F.max("seq.line")).first()[0] // 2
    early, later = records.where(F.col("seq.line") < half), records.where(F.col("seq.line") >= half)
    rows = ST.carry_rows(later, F.col("seq.line"))
    files = dealt_files(rows, "records", F.least(F.lit(2), F.floor((F.col("ord") - half) * 3 / half)), 3)
    carried = cut_lineage(ST.carried_prompts(early))
    streamed = over_restarts(files, lambda df: ST.carry_prompt_stream(df, carried), "carry", idle_batches=False)
    named = early.select("seq", "lineage_id", "request_id", M.own_prompt().alias("own_prompt"), M.named_prompt().alias("named_prompt"), (F.col("rec.type") == "assistant").alias("_use"))
    before = M.carry_prompt(named).where("_use AND request_id IS NOT NULL").select("request_id", F.col("seq.line").alias("ord"), "prompt_id")
    return before.union(streamed).groupBy("request_id").agg(F.min_by("prompt_id", "ord").alias("prompt_id"))


@query("r09_throttle_stream", with_tables("hook_event", extra=(
    ("s", "SELECT DISTINCT session_id, CAST(floor(us / 1e6) AS BIGINT) AS s FROM hook_event WHERE kind = 'statusline_sample'"),
    ("k", "SELECT session_id, min(s) AS s FROM s GROUP BY 1 UNION ALL SELECT k.session_id, (SELECT min(x.s) FROM s x WHERE x.session_id = k.session_id AND x.s >= k.s + 1500) FROM k WHERE k.s IS "
          "NOT NULL"),
)) + "SELECT session_id, s AS kept_s FROM k WHERE s <= (SELECT max(us) FROM hook_event WHERE kind = 'statusline_sample') // 1000000 - 46800")
def _(L):
    """Samples up to the watermark, which arrive up to six hours early or late over three files."""
    samples = L.hook_event.where("kind = 'statusline_sample'")
    files = dealt_files(samples, "samples", by_time(samples), 3)
    return over_restarts(files, lambda df: ST.throttle_stream(df, 1500, "13 hours"), "throttle")


@query("r07_fire_nudges_stream", with_tables("hook_event", extra=(
    ("c", "SELECT rule, session_id, us, CAST(make_timestamp(us + 32400000000) AS DATE) AS d FROM hook_event WHERE kind = 'nudge_fired'"),
    ("r", "SELECT *, row_number() OVER (PARTITION BY rule, d ORDER BY us) AS rn FROM c"),
)) + "SELECT rule, session_id, rule || ':' || CAST(us AS STRING) AS key, us AS fired_us FROM r WHERE rn <= 1")
def _(L):
    rows = L.streaming().hook_event.where("kind = 'nudge_fired'").selectExpr(
        "rule", "session_id", "concat(rule, ':', CAST(unix_micros(ts) AS STRING)) AS key", "ts")
    return SW.run_available(ST.fire_nudges_stream(rows, "Asia/Tokyo", daily_cap=1), "nudges")


_CTX = "coalesce(input_tok,0) + coalesce(cache_read_tok,0) + coalesce(cache_w5m_tok,0) + coalesce(cache_w1h_tok,0)"


@query("r04_cache_state_stream", with_tables("request", extra=(
    ("mn", f"SELECT *, {_CTX} AS ctx FROM request WHERE agent_id IS NULL"),
    ("l", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, request_id DESC) AS rn FROM mn) WHERE rn = 1"),
    ("w", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, request_id DESC) AS rn FROM mn WHERE cache_w5m_tok > 0 OR cache_w1h_tok > 0) WHERE rn = 1"),
    ("k", "SELECT l.session_id, l.ctx AS context_tok, CASE WHEN w.us IS NULL THEN 'unknown' WHEN w.cache_w5m_tok > 0 AND w.cache_w1h_tok > 0 THEN 'mixed' WHEN w.cache_w1h_tok > 0 THEN '1h' ELSE "
          "'5m' END AS ttl_kind, CASE WHEN w.us IS NOT NULL THEN CASE WHEN l.cache_read_tok > 0 OR l.cache_w5m_tok > 0 OR l.cache_w1h_tok > 0 THEN l.us ELSE w.us END END AS a FROM l LEFT JOIN w "
          "USING (session_id)"),
    ("x", "SELECT *, a + CASE WHEN ttl_kind = '5m' THEN 300000000 ELSE 3600000000 END AS expires_us FROM k"),
)) + """SELECT session_id, CASE WHEN a IS NULL THEN 'none' WHEN (expires_us + 999) // 1000 <= (SELECT max(us) FROM mn) // 1000 - 46800000 THEN 'expired' ELSE 'live' END AS status, ttl_kind,
context_tok, expires_us FROM x""")
def _(L):
    """State of each session after three files whose rows arrive up to six hours early or late."""
    req = L.request
    files = dealt_files(req, "requests", by_time(req), 3)
    return ST.latest_of(over_restarts(files, lambda df: ST.cache_state_stream(df, "13 hours", 90 * 86_400), "cache"))


@query("r05_inflight_stream", with_tables("hook_event", extra=(
    ("sp", "SELECT * FROM hook_event WHERE kind = 'statusline_sample'"),
    ("pp", "SELECT session_id, max(us) FILTER (kind = 'UserPromptSubmit') AS prompt_us, max(us) FILTER (kind = 'Stop') AS stop_us FROM hook_event WHERE kind IN ('UserPromptSubmit', 'Stop', "
           "'statusline_sample') GROUP BY 1"),
    ("op", "SELECT session_id, prompt_us, coalesce(prompt_us IS NOT NULL AND (stop_us IS NULL OR stop_us < prompt_us), false) AS is_open FROM pp"),
    ("i", "SELECT op.*, (SELECT total_cost_usd FROM sp WHERE sp.session_id = op.session_id ORDER BY us DESC LIMIT 1) AS cur, (SELECT total_cost_usd FROM sp WHERE sp.session_id = op.session_id AND "
          "us <= prompt_us ORDER BY us DESC LIMIT 1) AS ini FROM op"),
)) + """SELECT session_id, prompt_us, CAST(is_open AS INT) AS is_open, CASE WHEN is_open AND cur >= ini THEN round(cur - ini, 6) END AS inflight_usd FROM i""")
def _(L):
    """State of each session after three files whose rows arrive up to six hours early or late."""
    hooks = L.hook_event
    files = dealt_files(hooks, "hooks", by_time(hooks), 3)
    out = ST.latest_of(over_restarts(files, lambda df: ST.inflight_stream(df, "13 hours", 90 * 86_400), "inflight"))
    return out.withColumn("is_open", F.col("is_open").cast("int"))


def live_budgets(L, name):
    """Priced requests in three files, one batch each, up to six hours early or late, restarted; every batch is written twice."""
    priced = L.cost.select("session_id", "ts", "cost_usd")
    files = dealt_files(priced, name, by_time(priced), 3)
    target = f"{shared_dir(L.spark)}/usageloom/{name}-{uuid.uuid4().hex}"
    write = SB.budget_writer(f"{target}/live", C._BUDGET, C.TZ)

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    for shown in (1, 2, 3):
        SW.for_each_batch(files(shown), twice, f"{target}/checkpoint").awaitTermination()
    return f"{target}/live"


@query("r02_pace_stream", SQL["r02_pace_landing"])
def _(L):
    sums = SB.live_sums(L.spark, live_budgets(L, "pace"))
    return rounded(P.pace_landing(sums, sums, C.AS_OF, C.TZ), today_usd=8, pace_ratio=6, landing_usd=6)


@query("r03_budget_stream", SQL["r03_budget_usage"])
def _(L):
    sums = SB.live_sums(L.spark, live_budgets(L, "budget"))
    return rounded(P.budget_usage(sums, C._BUDGET, C.AS_OF, C.TZ), cost_usd=8, used_ratio=6)


_LOCAL = "CAST(make_timestamp(us + 32400000000) AS DATE)"
_CROSSED = with_tables("cost", extra=(
    ("d", f"SELECT {_LOCAL} AS d, sum(cost_usd) AS c FROM cost GROUP BY 1"),
    ("p", f"SELECT 'day' AS period, d AS start, c, {C._BUDGET['day']}::DOUBLE AS b FROM d UNION ALL SELECT 'week', CAST(date_trunc('week', d) AS DATE), sum(c), {C._BUDGET['week']}::DOUBLE FROM d "
          f"GROUP BY 2 UNION ALL SELECT 'month', CAST(date_trunc('month', d) AS DATE), sum(c), {C._BUDGET['month']}::DOUBLE FROM d GROUP BY 2"),
)) + "SELECT period, start, CAST(level AS INT) AS level FROM p, (VALUES (50), (80), (100)) v(level) WHERE c * 100 >= level * b"


@query("r03_budget_crossings", _CROSSED)
def _(L):
    return P.budget_crossings(L.cost, C._BUDGET, C.TZ)


@query("r03_crossings_stream", _CROSSED)
def _(L):
    return SB.crossings(L.spark, live_budgets(L, "crossings")).drop("batch")
