"""Rollups, rankings and projections on the derived ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from usageloom.catalog.registry import count, query, r6, rounded, us, usd
from usageloom.functions import scalar as S
from usageloom.model import Page, Window
from usageloom.operators import pricing, rollups as A
from usageloom.sources.adapters import with_tables

TZ = "Asia/Tokyo"
W14 = Window(dt.date(2024, 1, 10), dt.date(2024, 1, 23))
LOCAL_DAY = "CAST(make_timestamp(us + 32400000000) AS DATE)"


def between(w: Window = W14, us_col: str = "us") -> str:
    """SQL twin of the local-date window (the zone is UTC+9 all year)."""
    nine = 9 * 3600 * 1_000_000
    lo = int(dt.datetime(w.start.year, w.start.month, w.start.day, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 - nine
    hi = lo + w.days * 86_400_000_000
    return f"({us_col} >= {lo} AND {us_col} < {hi})"


def scoped(L, w: Window = W14):
    return A.period_filter(L.cost, w, TZ)


COST = with_tables("cost")
COST_S = with_tables("cost", "session")
COST_P = with_tables("cost", "session", "prompt")
CTX = ("coalesce(input_tok,0) + coalesce(cache_read_tok,0) + coalesce(cache_w5m_tok,0) + "
       "coalesce(cache_w1h_tok,0)")

COST_COLUMNS = (
    "request_id, in_usd, round(price_factor, 6) AS price_factor, "
    "round(token_cost_usd, 8) AS token_cost_usd, round(server_tool_usd, 8) AS server_tool_usd, "
    "round(cost_usd, 8) AS cost_usd, round(cache_write_usd, 8) AS cache_write_usd"
)


@query("j01_cost_requests", f"{COST} SELECT {COST_COLUMNS} FROM cost")
def _(L):
    names = ("token_cost_usd", "server_tool_usd", "cost_usd", "cache_write_usd")
    return L.cost.select("request_id", "in_usd", r6("price_factor").alias("price_factor"),
                         *[usd(c).alias(c) for c in names])


@query("j02_server_tool_cost", with_tables("tool_usd") +
       "SELECT request_id, round(server_tool_usd, 8) AS server_tool_usd FROM tool_usd")
def _(L):
    req = L.request.where("is_synthetic = 0")
    return rounded(pricing.server_tool_cost(req, L.price_tool), server_tool_usd=8)


@query("j03_join_project", COST_S + """
SELECT 'left' AS how, count(*) AS n, count(project) AS known FROM cost LEFT JOIN session USING (session_id)
UNION ALL SELECT 'inner', count(*), count(project) FROM cost JOIN session USING (session_id)""")
def _(L):
    parts = [
        A.join_project(L.cost, L.session, how).agg(
            F.lit(how).alias("how"), F.count(F.lit(1)).alias("n"), F.count("project").alias("known"))
        for how in ("left", "inner")
    ]
    return A.union_rows(*parts)


# A price list as long as the table of parts: a few periods per kind of part, some open, empty or overlapping.
PRICE_LIST = """SELECT concat(p_brand, '/', CAST(p_partkey % 40 AS STRING)) AS model, DATE'2023-01-01' + CAST(p_partkey * 7 % 600 AS INT) AS valid_from,
CASE WHEN p_size % 7 > 0 THEN DATE'2023-01-01' + CAST(p_partkey * 7 % 600 + p_size * 5 - 10 AS INT) END AS valid_to,
p_retailprice / 1e2 AS in_usd, p_retailprice / 2e1 AS out_usd, CAST(1 + p_size % 3 AS DOUBLE) AS fast_x, p_type AS source_url FROM part"""


def price_list(L):
    L.table("part").createOrReplaceTempView("usageloom_part")
    return L.spark.sql(PRICE_LIST.replace("FROM part", "FROM usageloom_part"))


@query("a34_effective_prices", f"""WITH p AS ({PRICE_LIST})
SELECT * FROM p WHERE DATE'2024-01-22' >= valid_from AND DATE'2024-01-22' < coalesce(valid_to, DATE'9999-01-01')""")
def _(L):
    from usageloom.sources.prices import effective_prices

    return effective_prices(price_list(L), dt.date(2024, 1, 22))


PROMPT_COST = ("SELECT prompt_id, min(us) AS us, count(*) AS n_requests, count(agent_id) AS n_agent_requests, "
               "count(DISTINCT agent_id) AS n_agents, CAST(sum(input_tok) AS BIGINT) AS input_tok, "
               "CAST(sum(coalesce(output_tok,0)) AS BIGINT) AS output_tok, CAST(sum(cache_read_tok) AS BIGINT) "
               "AS cache_read_tok, CAST(sum(cache_w5m_tok + cache_w1h_tok) AS BIGINT) AS cache_creation_tok, "
               "sum(cost_usd) AS cost_usd, max(is_interrupted) AS interrupted FROM cost "
               "WHERE prompt_id IS NOT NULL GROUP BY prompt_id")


@query("a01_prompt_cost", with_tables("cost", extra=(("pc", PROMPT_COST),)) +
       "SELECT * REPLACE (round(cost_usd, 8) AS cost_usd) FROM pc")
def _(L):
    return rounded(A.prompt_cost(L.cost).withColumn("us", us("ts")).drop("ts"), cost_usd=8)


@query("a02_daily", f"""{COST} SELECT {LOCAL_DAY} AS day, count(*) AS n_requests, round(sum(cost_usd), 8) AS cost_usd,
CAST(sum(cache_read_tok) AS BIGINT) AS cache_read_tok,
CAST(sum(cache_w5m_tok + cache_w1h_tok) AS BIGINT) AS cache_creation_tok,
CAST(sum(input_tok) AS BIGINT) AS input_tok, CAST(sum(coalesce(output_tok, 0)) AS BIGINT) AS output_tok
FROM cost GROUP BY 1""")
def _(L):
    return rounded(A.daily(L.cost, TZ), cost_usd=8)


@query("a03_background_cost", f"""{COST} SELECT {LOCAL_DAY} AS day, query_source, count(*) AS n,
round(sum(cost_usd), 8) AS cost_usd FROM cost WHERE source = 'otel' GROUP BY 1, 2""")
def _(L):
    return rounded(A.background_cost(L.cost, TZ), cost_usd=8)


@query("a04_model_mix", f"""{COST} SELECT model, count(*) AS n_requests, round(sum(cost_usd), 8) AS cost_usd,
round(100.0 * sum(cost_usd) / sum(sum(cost_usd)) OVER (), 6) AS share_pct FROM cost WHERE {between()} GROUP BY model""")
def _(L):
    return rounded(A.model_mix(scoped(L)), cost_usd=8, share_pct=6)


@query("a05_main_vs_agent", f"""{COST} SELECT CASE WHEN agent_id IS NULL THEN 'main' ELSE 'agent' END AS lane,
count(*) AS n_requests, count(DISTINCT agent_id) AS n_agents, round(sum(cost_usd), 8) AS cost_usd,
round(100.0 * sum(cost_usd) / sum(sum(cost_usd)) OVER (), 6) AS share_pct FROM cost WHERE {between()} GROUP BY 1""")
def _(L):
    return rounded(A.main_vs_agent(scoped(L)), cost_usd=8, share_pct=6)


SESSION_ROLLUP = f"""SELECT session_id, project, sum(cost_usd) AS cost_usd, min(us) AS first_us, max(us) AS last_us,
count(DISTINCT prompt_id) AS n_prompts, count(*) AS n_requests,
count(*) FILTER (cost_usd IS NULL) AS unknown_cost_requests, (max(us) - min(us)) / 1e6 AS duration_s,
sum(cost_usd) / nullif(count(DISTINCT prompt_id), 0) AS usd_per_prompt
FROM cost JOIN session s USING (session_id) WHERE {between()} GROUP BY session_id, project"""


@query("a06_session_rollup", with_tables("cost", "session", extra=(("sr", SESSION_ROLLUP),)) +
       "SELECT * REPLACE (round(cost_usd, 8) AS cost_usd, round(duration_s, 6) AS duration_s, "
       "round(usd_per_prompt, 12) AS usd_per_prompt) FROM sr")
def _(L):
    out = A.session_rollup(scoped(L), L.session)
    out = out.withColumn("first_us", us("first_ts")).withColumn("last_us", us("last_ts"))
    return rounded(out.drop("first_ts", "last_ts"), cost_usd=8, duration_s=6, usd_per_prompt=12)


@query("a07_project_rollup", with_tables("cost", "session", extra=(
    ("sc", f"SELECT c.*, s.project FROM cost c JOIN session s USING (session_id) WHERE {between()}"),
    ("pk", f"SELECT session_id, prompt_id, project, max({CTX}) AS peak FROM sc WHERE agent_id IS NULL AND "
           "prompt_id IS NOT NULL GROUP BY ALL"),
    ("pj", "SELECT project, sum(cost_usd) AS cost_usd, count(DISTINCT session_id) AS ns, "
           "count(DISTINCT prompt_id) AS np, count(*) AS nr FROM sc GROUP BY project"),
    ("rk", "SELECT *, row_number() OVER (ORDER BY cost_usd DESC NULLS LAST, project NULLS FIRST) AS rn FROM pj"),
    ("lb", "SELECT *, CASE WHEN rn <= 8 THEN coalesce(project, '—') ELSE 'others' END AS label FROM rk"),
)) + f"""SELECT l.label, CAST(CASE WHEN max(l.rn) <= 8 THEN 1 ELSE 0 END AS INT) AS is_top, count(*) AS n_projects,
round(sum(cost_usd), 8) AS cost_usd, CAST(sum(ns) AS BIGINT) AS n_sessions, CAST(sum(np) AS BIGINT) AS n_prompts,
CAST(sum(nr) AS BIGINT) AS n_requests, round(max(a.avg_peak), 6) AS avg_peak_context,
round(100.0 * sum(cost_usd) / (SELECT sum(cost_usd) FROM cost WHERE {between()}), 6) AS share_pct,
round(sum(cost_usd) / nullif(sum(np), 0), 12) AS usd_per_prompt
FROM lb l LEFT JOIN (SELECT label, avg(peak) AS avg_peak FROM pk JOIN lb ON pk.project IS NOT DISTINCT FROM lb.project
GROUP BY label) a USING (label) GROUP BY l.label""")
def _(L):
    return rounded(A.project_rollup(scoped(L), L.session, keep=8),
                   cost_usd=8, avg_peak_context=6, share_pct=6, usd_per_prompt=12)


TOTALS = f"""SELECT coalesce(sum(cost_usd), 0) AS cost_usd, count(*) AS request_count,
count(DISTINCT session_id) AS session_count, count(DISTINCT project) AS project_count,
count(*) FILTER (cost_usd IS NULL) AS unknown_cost_request_count
FROM cost LEFT JOIN session USING (session_id) WHERE {between()}"""


@query("a08_period_totals", with_tables("cost", "session", extra=(("t", TOTALS),)) +
       "SELECT * REPLACE (round(cost_usd, 8) AS cost_usd) FROM t")
def _(L):
    return rounded(A.period_totals(scoped(L), L.session), cost_usd=8)


@query("a09_prompt_kpi", f"{COST} SELECT count(DISTINCT prompt_id) AS prompt_count FROM cost WHERE {between()}")
def _(L):
    return A.prompt_kpi(scoped(L))


PARTS = {
    "input": "input_tok * in_usd * price_factor / 1e6",
    "output": "coalesce(output_tok, 0) * out_usd * price_factor / 1e6",
    "cache_read": "cache_read_tok * in_usd * cache_read_x * price_factor / 1e6",
    "cache_w5m": "cache_w5m_tok * in_usd * cache_w5m_x * price_factor / 1e6",
    "cache_w1h": "cache_w1h_tok * in_usd * cache_w1h_x * price_factor / 1e6",
    "server_tool": "server_tool_usd",
}


@query("a10_cost_components", COST + " UNION ALL ".join(
    f"SELECT '{n}' AS component, round(coalesce(sum({e}), 0), 8) AS cost_usd FROM cost WHERE {between()}"
    for n, e in PARTS.items()))
def _(L):
    return rounded(A.cost_components(scoped(L)), cost_usd=8)


DOM = {
    "cache_read": "coalesce(cache_read_tok,0)*coalesce(in_usd,0)*coalesce(cache_read_x,0)*coalesce(price_factor,1)",
    "cache_creation": "(coalesce(cache_w5m_tok,0)*coalesce(cache_w5m_x,0)+coalesce(cache_w1h_tok,0)*"
                      "coalesce(cache_w1h_x,0))*coalesce(in_usd,0)*coalesce(price_factor,1)",
    "output": "coalesce(output_tok,0)*coalesce(out_usd,0)*coalesce(price_factor,1)",
    "input": "coalesce(input_tok,0)*coalesce(in_usd,0)*coalesce(price_factor,1)",
    "server_tool": "server_tool_usd*1e6",
}


def dominant_sql(keys: str, where: str) -> str:
    sums = ", ".join(f"sum({e}) AS d{i}" for i, e in enumerate(DOM.values()))
    big = "greatest(d0, d1, d2, d3, d4)"
    name = " ".join(f"WHEN d{i} = {big} THEN '{n}'" for i, n in enumerate(DOM))
    return (f"SELECT *, CASE {name} END AS dominant, CASE WHEN coalesce(cost_usd, 0) = 0 THEN 0.0::DOUBLE ELSE "
            f"{big} / (cost_usd * 1e6) * 100 END AS dominant_share_pct FROM (SELECT {keys}, sum(cost_usd) AS cost_usd, "
            f"count(*) AS n_requests, min(us) AS us, {sums} FROM cost WHERE {where} GROUP BY {keys})")


@query("a11_dominant_component", with_tables("cost", extra=(
    ("d", dominant_sql("prompt_id", f"prompt_id IS NOT NULL AND {between()}")),)) +
    "SELECT prompt_id, round(cost_usd, 8) AS cost_usd, dominant, round(dominant_share_pct, 6) AS dominant_share_pct FROM d")
def _(L):
    facts = scoped(L).where("prompt_id IS NOT NULL")
    return rounded(A.dominant_component(facts, ["prompt_id"]), cost_usd=8, dominant_share_pct=6)


PEAK = (f"SELECT session_id, prompt_id, project, max({CTX}) AS peak_context FROM cost JOIN session USING (session_id) "
        f"WHERE agent_id IS NULL AND prompt_id IS NOT NULL AND {between()} GROUP BY ALL")


@query("a12_peak_context", with_tables("cost", "session", extra=(("pk", PEAK),)) +
       "SELECT session_id, round(avg(peak_context), 6) AS avg_peak_context, count(*) AS n_peaks FROM pk GROUP BY 1")
def _(L):
    return rounded(A.average_peak(scoped(L), L.session), avg_peak_context=6)


@query("a12_peak_context_project", with_tables("cost", "session", extra=(("pk", PEAK),)) +
       "SELECT project, round(avg(peak_context), 6) AS avg_peak_context, count(*) AS n_peaks FROM pk GROUP BY 1")
def _(L):
    return rounded(A.average_peak(scoped(L), L.session, "project"), avg_peak_context=6)


STARTUP = ("SELECT s.session_id, s.project, s.first_us, CAST(make_timestamp(s.first_us + 32400000000) AS DATE) AS day, "
           "f.model, f.tok AS startup_context_tok FROM session s JOIN (SELECT session_id, model, "
           "input_tok + cache_read_tok + cache_w5m_tok + cache_w1h_tok AS tok, row_number() OVER (PARTITION BY "
           "session_id ORDER BY us, request_id) AS rn FROM request WHERE agent_id IS NULL AND is_synthetic = 0) f "
           "ON f.session_id = s.session_id AND f.rn = 1")
WITH_STARTUP = with_tables("session", "request", extra=(("st", STARTUP),))


@query("a13_startup_context", WITH_STARTUP + "SELECT * FROM st")
def _(L):
    out = A.startup_context(L.session, L.request, TZ)
    return out.withColumn("first_us", us("first_ts")).drop("first_ts")


@query("a13_startup_by_day", WITH_STARTUP +
       "SELECT day, model, count(*) AS sessions, round(avg(startup_context_tok), 6) AS avg_tok FROM st GROUP BY 1, 2")
def _(L):
    return rounded(A.startup_by_day(A.startup_context(L.session, L.request, TZ)), avg_tok=6)


_W7 = Window(dt.date(2024, 1, 17), dt.date(2024, 1, 23))


@query("a13_startup_summary", WITH_STARTUP + f"""
SELECT model, count(startup_context_tok) FILTER ({between(_W7, 'first_us')}) AS sessions,
round(avg(startup_context_tok) FILTER ({between(_W7, 'first_us')}), 6) AS avg_tok,
count(startup_context_tok) FILTER ({between(_W7.previous(), 'first_us')}) AS previous_sessions,
round(avg(startup_context_tok) FILTER ({between(_W7.previous(), 'first_us')}), 6) AS previous_avg_tok
FROM st WHERE model = (SELECT model FROM st WHERE {between(_W7, 'first_us')} GROUP BY model
ORDER BY count(*) DESC, model LIMIT 1) GROUP BY model""")
def _(L):
    out = A.startup_summary(A.startup_context(L.session, L.request, TZ), _W7, TZ)
    return rounded(out, avg_tok=6, previous_avg_tok=6)


# ---- projections and scalar expressions ----

@query("f01_period_filter", f"""{COST_S} SELECT request_id FROM cost JOIN session USING (session_id)
WHERE {between()} AND project = 'proj-1'""")
def _(L):
    w = Window(W14.start, W14.end, "proj-1")
    return A.period_filter(L.cost, w, TZ, L.session).select("request_id")


@query("f02_previous_period", f"""{COST} SELECT CASE WHEN {between()} THEN 'current' ELSE 'previous' END AS period,
count(*) AS n FROM cost WHERE {between()} OR {between(W14.previous())} GROUP BY 1""")
def _(L):
    both = Window(W14.previous().start, W14.end)
    period = F.when(S.in_window("ts", W14, TZ), F.lit("current")).otherwise(F.lit("previous"))
    return scoped(L, both).groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("f03_resolve_period", COST + " UNION ALL ".join(
    f"SELECT '{n}' AS option, count(*) AS n FROM cost WHERE {between(Window(dt.date.fromisoformat(a), dt.date.fromisoformat(b)))}"
    for n, a, b in (("today", "2024-01-24", "2024-01-24"), ("last_week", "2024-01-15", "2024-01-21"),
                    ("week", "2024-01-22", "2024-01-24"), ("month", "2024-01-01", "2024-01-24"),
                    ("days", "2024-01-18", "2024-01-24"))))
def _(L):
    from usageloom.functions.periods import iso_week, last_days, month_of

    day = "2024-01-24"
    windows = {"today": last_days(day, 1), "last_week": iso_week(day, back=1), "week": iso_week(day), "month": month_of(day), "days": last_days(day, 7)}
    counts = scoped(L, windows["month"]).agg(
        *[F.count_if(S.in_window("ts", w, TZ)).alias(n) for n, w in windows.items()])
    return counts.unpivot([], list(windows), "option", "n")


@query("f04_project_and_model_names", COST_S + """
SELECT CASE WHEN model LIKE '%opus%' THEN 'opus' WHEN model LIKE '%sonnet%' THEN 'sonnet' WHEN model LIKE '%haiku%'
THEN 'haiku' ELSE 'other' END AS family, replace(coalesce(project, '—'), '-private-tmp-', '~') AS project,
CAST(CASE WHEN project LIKE '%sandbox-experiments%' OR project LIKE '-private-tmp-%' THEN 1 ELSE 0 END AS INT) AS automatic,
count(*) AS n FROM cost LEFT JOIN session USING (session_id) GROUP BY 1, 2, 3""")
def _(L):
    return (A.join_project(L.cost, L.session)
            .groupBy(S.model_family("model").alias("family"),
                     S.project_display("project", "/private/tmp").alias("project"),
                     S.is_automatic("project").cast("int").alias("automatic"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("f05_price_factor", f"""{with_tables("priced")} SELECT service_tier, speed, geo,
round(price_factor, 6) AS price_factor, count(*) AS n FROM priced GROUP BY ALL""")
def _(L):
    return (L.cost.groupBy("service_tier", "speed", "geo", r6("price_factor").alias("price_factor"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("f06_resolve_prefix", with_tables("prompt", "request") + """
SELECT CASE WHEN max(CASE WHEN prompt_id = 'p1' THEN 1 END) = 1 OR count(DISTINCT prompt_id) = 1 THEN 'found' WHEN
count(*) = 0 THEN 'missing' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT prompt_id) = 1 THEN min(prompt_id)
END AS id FROM (SELECT prompt_id FROM prompt UNION SELECT prompt_id FROM request) WHERE starts_with(prompt_id, 'p1')""")
def _(L):
    return A.resolve_prefix(A.known_prompt_ids(L.prompt, L.request), "prompt_id", "p1")


@query("f07_context_tokens", f"{with_tables('request')} SELECT request_id, {CTX} AS context_tok FROM request")
def _(L):
    return L.request.select("request_id", S.context_tokens().alias("context_tok"))


@query("f08_clip_text", with_tables("prompt") + """SELECT prompt_id, substr(replace(text, chr(10), ' '), 1, 60) ||
CASE WHEN length(text) > 60 THEN '…' ELSE '' END AS text FROM prompt""")
def _(L):
    return L.prompt.select("prompt_id", S.clip_text("text").alias("text"))


@query("f09_calendar", with_tables("request") + """SELECT strftime(make_timestamp(us + 32400000000), '%G-W%V') AS iso_week,
strftime(make_timestamp(us), '%Y-%m') AS month_utc, count(*) AS n FROM request GROUP BY 1, 2""")
def _(L):
    return (L.request.groupBy(S.iso_week("ts", TZ).alias("iso_week"), S.utc_month("ts").alias("month_utc"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("t01_normalize_model", with_tables("base") + """SELECT regexp_replace(nullif(CASE WHEN id % 5 = 0 THEN '' ELSE
'px-' || et || CASE WHEN id % 2 = 0 THEN '-20240131' ELSE '' END END, ''), '-[0-9]{8}$', '') AS model, count(*) AS n
FROM base GROUP BY 1""")
def _(L):
    raw = F.expr("CASE WHEN id % 5 = 0 THEN '' ELSE concat('px-', et, CASE WHEN id % 2 = 0 THEN '-20240131' ELSE '' END) END")
    return L.base.groupBy(S.normalize_model(raw).alias("model")).agg(F.count(F.lit(1)).alias("n"))


# ---- rankings ----

@query("k01_top_prompts", with_tables("cost", "prompt", "session", extra=(
    ("d", dominant_sql("prompt_id", f"prompt_id IS NOT NULL AND session_id IN (SELECT session_id FROM session) AND {between()}")),)) + """
SELECT prompt_id, round(cost_usd, 8) AS cost_usd, n_requests, dominant, round(dominant_share_pct, 6) AS dominant_share_pct,
substr(replace(text, chr(10), ' '), 1, 60) || CASE WHEN length(text) > 60 THEN '…' ELSE '' END AS text
FROM d LEFT JOIN prompt USING (prompt_id) ORDER BY cost_usd DESC NULLS LAST, prompt_id LIMIT 40""")
def _(L):
    from usageloom.plans.period import top_prompts

    out = top_prompts(scoped(L), L.session, L.prompt, n=40)
    return rounded(out.select("prompt_id", "cost_usd", "n_requests", "dominant", "dominant_share_pct", "text"),
                   cost_usd=8, dominant_share_pct=6)


@query("k01_top_sessions", with_tables("cost", "session", extra=(("sr", SESSION_ROLLUP),)) + """
SELECT session_id, project, round(cost_usd, 8) AS cost_usd, n_prompts FROM sr
ORDER BY cost_usd DESC NULLS LAST, session_id DESC LIMIT 30""")
def _(L):
    out = A.top_n(A.session_rollup(scoped(L), L.session), "cost_usd", [F.desc("session_id")], 30)
    return rounded(out.select("session_id", "project", "cost_usd", "n_prompts"), cost_usd=8)


@query("k01_top_projects", COST_S + f"""SELECT project, round(sum(cost_usd), 8) AS cost_usd FROM cost JOIN session
USING (session_id) WHERE {between()} GROUP BY 1 ORDER BY sum(cost_usd) DESC NULLS LAST, project NULLS FIRST LIMIT 5""")
def _(L):
    grouped = A.session_rollup(scoped(L), L.session).groupBy("project").agg(F.sum("cost_usd").alias("cost_usd"))
    return rounded(A.top_n(grouped, "cost_usd", [F.asc_nulls_first("project")], 5), cost_usd=8)


@query("k02_page", with_tables("cost", "session", extra=(("sr", SESSION_ROLLUP),)) + """
SELECT session_id, round(cost_usd, 8) AS cost_usd FROM sr ORDER BY cost_usd DESC NULLS LAST, session_id DESC LIMIT 10 OFFSET 20""")
def _(L):
    out = A.page(A.session_rollup(scoped(L), L.session), "cost_usd", [F.desc("session_id")], Page(limit=10, page=3))
    return rounded(out.select("session_id", "cost_usd"), cost_usd=8)


@query("k04_top_k_others", COST_S + f"""SELECT CASE WHEN rn <= 6 THEN coalesce(project, '—') ELSE 'others' END AS label,
round(sum(c), 8) AS cost_usd FROM (SELECT project, sum(cost_usd) AS c, row_number() OVER (ORDER BY sum(cost_usd) DESC
NULLS LAST, project NULLS FIRST) AS rn FROM cost JOIN session USING (session_id) WHERE {between()} GROUP BY 1) GROUP BY 1""")
def _(L):
    grouped = A.session_rollup(scoped(L), L.session).groupBy("project").agg(F.sum("cost_usd").alias("cost_usd"))
    out = A.top_k_others(grouped, "project", "cost_usd", 6)
    return rounded(out.groupBy("label").agg(F.sum("cost_usd").alias("cost_usd")), cost_usd=8)


@query("k05_set_operations", with_tables("prompt", "request") + """
SELECT 'all' AS source, count(*) AS n FROM (SELECT prompt_id FROM prompt UNION SELECT prompt_id FROM request WHERE
prompt_id IS NOT NULL) UNION ALL SELECT 'prompt', count(*) FROM prompt""")
def _(L):
    a = A.known_prompt_ids(L.prompt, L.request).agg(F.lit("all").alias("source"), F.count(F.lit(1)).alias("n"))
    b = L.prompt.agg(F.lit("prompt").alias("source"), F.count(F.lit(1)).alias("n"))
    return A.union_rows(a, b)


@query("w02_cumulative_share", with_tables("cost", extra=(("pc", PROMPT_COST),)) + """
SELECT prompt_id, rank, round(cost_usd, 8) AS cost_usd, round(100.0 * run / total, 6) AS cumulative_pct FROM (SELECT
prompt_id, cost_usd, CAST(row_number() OVER o AS INT) AS rank, sum(coalesce(cost_usd, 0)) OVER (o ROWS UNBOUNDED
PRECEDING) AS run, sum(cost_usd) OVER () AS total FROM pc WINDOW o AS (ORDER BY cost_usd DESC NULLS LAST, prompt_id))
WHERE rank <= 50""")
def _(L):
    prompts = A.prompt_cost(L.cost)
    total = prompts.agg(F.sum("cost_usd")).scalar()
    out = A.cumulative_share(prompts, "cost_usd", [F.asc("prompt_id")], total, 50)
    return rounded(out.select("prompt_id", "rank", "cost_usd", "cumulative_pct"), cost_usd=8, cumulative_pct=6)


SPINE = (f"SELECT CAST(d AS DATE) AS day FROM generate_series(DATE'2023-12-25', DATE'2024-02-05', INTERVAL 1 DAY) g(d)")
SPINE_COST = (f"SELECT s.day, CASE WHEN c.n IS NULL THEN 0.0::DOUBLE ELSE c.cost END AS cost_usd, coalesce(c.n, 0) AS n_requests, "
              f"coalesce(c.known, 0) AS n_known FROM spine s LEFT JOIN (SELECT {LOCAL_DAY} AS day, sum(cost_usd) AS cost, "
              "count(*) AS n, count(cost_usd) AS known FROM cost GROUP BY 1) c USING (day)")
WITH_SPINE = with_tables("cost", extra=(("spine", SPINE), ("sc", SPINE_COST)))
_SPAN = (dt.date(2023, 12, 25), dt.date(2024, 2, 5))


@query("d01_date_spine", WITH_SPINE + "SELECT day, round(cost_usd, 8) AS cost_usd, n_requests, n_known FROM sc")
def _(L):
    return rounded(A.spine_costs(L.cost, *_SPAN, TZ), cost_usd=8)


@query("w04_moving_average_7d", WITH_SPINE + """SELECT day, round(avg(coalesce(cost_usd, 0)) OVER (ORDER BY day ROWS 6 PRECEDING), 6)
AS moving_avg FROM sc""")
def _(L):
    return rounded(A.moving_average_7d(A.spine_costs(L.cost, *_SPAN, TZ)).select("day", "moving_avg"), moving_avg=6)
