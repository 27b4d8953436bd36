"""Distribution, trend and overview reports on the derived ledger."""

from __future__ import annotations

import datetime as dt

from usageloom.catalog.cache import EXTRA, breaks_of, priced_breaks_of
from usageloom.catalog.registry import query, rounded, us
from usageloom.catalog.rollups import (
    CTX, LOCAL_DAY, PARTS, TZ, W14, between, scoped,
)
from usageloom.model import Window
from usageloom.operators import rollups as A
from usageloom.plans import distribution as D, overview as O, trend as T
from usageloom.plans.period import top_prompts
from usageloom.sources.adapters import with_tables

AUTO = "(coalesce(project, '') LIKE '%sandbox-experiments%' OR coalesce(project, '') LIKE '-private-tmp-%')"
FAMILY = ("CASE WHEN model LIKE '%opus%' THEN 'opus' WHEN model LIKE '%sonnet%' THEN 'sonnet' WHEN model LIKE "
          "'%haiku%' THEN 'haiku' ELSE 'other' END")


def facts_sql(w: Window) -> tuple[tuple[str, str], ...]:
    return (
        ("sc", f"SELECT c.*, s.project, {CTX} AS ctx, {FAMILY} AS family FROM cost c JOIN session s USING (session_id) "
               f"WHERE {between(w)}"),
        ("pk", "SELECT prompt_id, family FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY ctx DESC, us, "
               "request_id DESC) AS rn FROM sc WHERE agent_id IS NULL AND prompt_id IS NOT NULL) WHERE rn = 1"),
        ("pf", f"SELECT *, CAST({AUTO} AS INT) AS automatic FROM (SELECT prompt_id, min(session_id) AS session_id, min(project) "
               "AS project, sum(cost_usd) AS cost_usd, count(*) AS n_requests, min(us) AS first_us, max(us) AS last_us, "
               "max(is_interrupted) AS interrupted, sum(cost_usd) FILTER (agent_id IS NOT NULL) AS delegated_usd, "
               "max(ctx) FILTER (agent_id IS NULL) AS peak_context, (max(us) - min(us)) / 1e6 AS span_s FROM sc "
               "WHERE prompt_id IS NOT NULL GROUP BY prompt_id) LEFT JOIN (SELECT prompt_id, family AS peak_family FROM pk) "
               "USING (prompt_id)"),
        ("kp", "SELECT * FROM pf WHERE cost_usd IS NOT NULL"),
    )


WITH_FACTS = with_tables("cost", "session", extra=facts_sql(W14))


def facts(L):
    return A.prompt_facts(scoped(L), L.session)


@query("prompt_facts", WITH_FACTS + """SELECT prompt_id, session_id, project, round(cost_usd, 8) AS cost_usd, n_requests, first_us,
last_us, interrupted, round(delegated_usd, 8) AS delegated_usd, peak_context, peak_family, round(span_s, 6) AS span_s,
automatic FROM pf""")
def _(L):
    out = facts(L).withColumn("first_us", us("first_ts")).withColumn("last_us", us("last_ts"))
    return rounded(out.drop("first_ts", "last_ts"), cost_usd=8, delegated_usd=8, span_s=6)


Q4 = ", ".join(f"round(quantile_cont(cost_usd, {p}), 6) AS {n}" for p, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))


@query("a21_cost_quantiles", with_tables("cost", "session", extra=facts_sql(W14) + (
    ("rk", "SELECT project AS pr, row_number() OVER (ORDER BY sum(cost_usd) DESC NULLS LAST, project NULLS FIRST) AS rn FROM kp GROUP BY 1"),
    ("tg", "SELECT kp.*, rn FROM kp JOIN rk ON kp.project IS NOT DISTINCT FROM rk.pr"),
    ("g", "SELECT CASE WHEN rn <= 7 THEN 'project' ELSE 'others' END AS scope, CASE WHEN rn <= 7 THEN coalesce(project, '—') ELSE "
          "'others' END AS label, cost_usd FROM tg UNION ALL SELECT 'all', 'all', cost_usd FROM tg UNION ALL SELECT 'interactive', "
          "'interactive', cost_usd FROM tg WHERE automatic = 0"),
    ("q", f"SELECT scope, label, count(*) AS n, round(sum(cost_usd), 8) AS cost_usd, {Q4} FROM g GROUP BY 1, 2"),
)) + """SELECT scope, label, n, cost_usd, p50, CASE WHEN scope <> 'project' OR n >= 20 THEN p90 END AS p90,
CASE WHEN scope <> 'project' OR n >= 20 THEN p95 END AS p95, CASE WHEN scope <> 'project' OR n >= 20 THEN p99 END AS p99 FROM q""")
def _(L):
    return rounded(D.cost_quantiles(facts(L)), cost_usd=8, p50=6, p90=6, p95=6, p99=6)


@query("a21_unpriced_prompts", WITH_FACTS + "SELECT count(*) FILTER (cost_usd IS NULL) AS unpriced_prompts FROM pf")
def _(L):
    return D.unpriced_prompts(facts(L))


@query("a21_attribution_coverage", with_tables("cost") + f"""SELECT count(DISTINCT prompt_id) AS n_prompts,
round(sum(cost_usd) FILTER (prompt_id IS NOT NULL), 8) AS attributed_usd, round(100.0 * sum(cost_usd) FILTER (prompt_id IS NOT NULL)
/ sum(cost_usd), 6) AS coverage_pct, count(*) FILTER (cost_usd IS NULL) AS unknown_cost_requests FROM cost WHERE {between()}""")
def _(L):
    return rounded(D.attribution_coverage(scoped(L)), attributed_usd=8, coverage_pct=6)


@query("a22_context_bands", with_tables("cost", "session", extra=facts_sql(W14) + (
    ("b", "SELECT *, CASE WHEN peak_context >= 500000 THEN '≥500k' WHEN peak_context >= 200000 THEN '≥200k–<500k' ELSE '<200k' END "
          "AS band FROM kp WHERE peak_context IS NOT NULL"),
    ("r", "SELECT 'all' AS scope, * FROM b UNION ALL SELECT 'interactive', * FROM b WHERE automatic = 0"),
    ("t", "SELECT scope, band, count(*) AS n_prompts, sum(cost_usd) AS c, round(quantile_cont(cost_usd, 0.5), 6) AS median_usd "
          "FROM r GROUP BY 1, 2"),
    ("f", "SELECT scope, band, string_agg(peak_family || ' ' || n, ', ' ORDER BY rn) AS main_families FROM (SELECT scope, band, "
          "peak_family, count(*) AS n, row_number() OVER (PARTITION BY scope, band ORDER BY count(*) DESC, peak_family) AS rn FROM r "
          "GROUP BY 1, 2, 3) WHERE rn <= 2 GROUP BY 1, 2"),
    ("e", "SELECT scope, band, string_agg(prompt_id, ', ' ORDER BY rn) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY "
          "scope, band ORDER BY cost_usd DESC, prompt_id) AS rn FROM r) WHERE rn <= 2 GROUP BY 1, 2"),
)) + """SELECT scope, band, n_prompts, round(c, 8) AS cost_usd, round(100.0 * n_prompts / sum(n_prompts) OVER (PARTITION BY scope), 6)
AS count_share_pct, round(100.0 * c / sum(c) OVER (PARTITION BY scope), 6) AS cost_share_pct, median_usd, main_families, examples
FROM t JOIN f USING (scope, band) JOIN e USING (scope, band)""")
def _(L):
    return rounded(D.context_bands(facts(L)), cost_usd=8, count_share_pct=6, cost_share_pct=6, median_usd=6)


@query("a22_missing_peaks", WITH_FACTS + """SELECT count(*) FILTER (peak_context IS NULL) AS without_main_lane,
count(*) FILTER (peak_context >= 1000000) AS over_1m FROM kp""")
def _(L):
    return D.missing_peaks(facts(L))


PROFILE = (
    ("rk", "SELECT *, row_number() OVER (ORDER BY cost_usd DESC, prompt_id) AS rn, count(*) OVER () AS total FROM kp"),
    ("pt", "SELECT CASE WHEN rn <= ceil(total * 0.1::DOUBLE) THEN 'top 10%' ELSE 'rest' END AS part, * FROM rk UNION ALL SELECT 'all', * FROM rk"),
    ("pr", "SELECT part, count(*) AS n_prompts, sum(cost_usd) AS c, 100.0 * sum(interrupted) / count(*) AS i, "
           "coalesce(100.0 * sum(delegated_usd) / sum(cost_usd), 0) AS d, quantile_cont(n_requests, 0.5) AS mr, "
           "quantile_cont(n_requests, 0.9) AS p90, quantile_cont(span_s, 0.5) AS ms FROM pt GROUP BY 1"),
)


@query("a23_top_decile_profile", with_tables("cost", "session", extra=facts_sql(W14) + PROFILE) + """SELECT part, n_prompts,
round(c, 8) AS cost_usd, round(i, 6) AS interrupted_pct, round(d, 6) AS delegated_pct, round(mr, 6) AS median_requests,
round(p90, 6) AS p90_requests, round(ms, 6) AS median_span_s FROM pr""")
def _(L):
    return rounded(D.top_decile_profile(facts(L)), cost_usd=8, interrupted_pct=6, delegated_pct=6, median_requests=6,
                   p90_requests=6, median_span_s=6)


@query("a23_decile_ratios", with_tables("cost", "session", extra=facts_sql(W14) + PROFILE) + """SELECT round(coalesce(a.mr /
nullif(b.mr, 0), 0), 6) AS requests_ratio, round(coalesce(a.ms / nullif(b.ms, 0), 0), 6) AS span_ratio, round(a.d - b.d, 6) AS
delegated_diff_pt FROM pr a, pr b WHERE a.part = 'top 10%' AND b.part = 'rest'""")
def _(L):
    return rounded(D.decile_ratios(D.top_decile_profile(facts(L))), requests_ratio=6, span_ratio=6, delegated_diff_pt=6)


def _grain(grain: str, day: str) -> str:
    if grain == "daily":
        return day
    return f"CAST(date_trunc('{'week' if grain == 'weekly' else 'month'}', {day}) AS DATE)"


_FEE_VALUES = " UNION ALL ".join(
    f"SELECT {LOCAL_DAY} AS day, '{n}' AS series, coalesce({e}, 0) AS usd FROM cost WHERE {between()}" for n, e in PARTS.items())
_AXES = {
    "fee": _FEE_VALUES,
    "model": f"SELECT {LOCAL_DAY} AS day, {FAMILY} AS series, coalesce(cost_usd, 0) AS usd FROM cost WHERE {between()}",
    "project": f"SELECT day, CASE WHEN rn <= 6 THEN coalesce(project, '—') ELSE 'others' END AS series, usd FROM (SELECT {LOCAL_DAY} "
               f"AS day, project, coalesce(cost_usd, 0) AS usd FROM cost LEFT JOIN session USING (session_id) WHERE {between()}) x JOIN "
               "(SELECT project AS pr, row_number() OVER (ORDER BY sum(coalesce(cost_usd, 0)) DESC, project NULLS FIRST) AS rn FROM cost "
               f"LEFT JOIN session USING (session_id) WHERE {between()} GROUP BY 1) y ON x.project IS NOT DISTINCT FROM y.pr",
}


def _series(axis: str, grain: str):
    lo, hi = W14.start.isoformat(), W14.end.isoformat()
    sql = with_tables("cost", "session", extra=(("v", _AXES[axis]),)) + f"""SELECT {_grain(grain, 'sp.day')} AS period, sp.series,
round(sum(coalesce(v.usd, 0)), 8) AS usd FROM (SELECT series, CAST(d AS DATE) AS day FROM (SELECT DISTINCT series FROM v),
generate_series(DATE'{lo}', DATE'{hi}', INTERVAL 1 DAY) g(d)) sp LEFT JOIN v ON v.day = sp.day AND v.series = sp.series GROUP BY 1, 2"""

    @query(f"a24_trend_{axis}_{grain}", sql)
    def _(L):
        return rounded(T.trend_series(L.cost, L.session, W14, TZ, axis, grain), usd=8)


for _axis, _g in (("fee", "daily"), ("model", "weekly"), ("project", "daily"), ("project", "monthly")):
    _series(_axis, _g)


W28 = Window(dt.date(2024, 1, 2), dt.date(2024, 1, 29))
DAYS = (
    ("sc", f"SELECT c.*, s.project, {AUTO} AS automatic, {CTX} AS ctx, {FAMILY} AS family, {LOCAL_DAY} AS day FROM cost c JOIN session s "
           f"USING (session_id) WHERE {between(W28)}"),
    ("gr", " UNION ALL ".join(f"SELECT '{g}' AS grain, {_grain(g, 'day')} AS period, * FROM sc" for g in T.GRAINS)),
    ("gp", "SELECT grain, period, prompt_id, sum(coalesce(cost_usd, 0)) AS usd, count(*) AS n_requests, max(is_interrupted) AS interrupted, "
           "(max(us) - min(us)) / 60e6 AS span_min, max(ctx) FILTER (agent_id IS NULL) AS peak, bool_or(automatic) AS automatic FROM gr "
           "WHERE prompt_id IS NOT NULL GROUP BY 1, 2, 3"),
)


def _dist_sql() -> str:
    parts = []
    for measure, value in (("cost_usd", "usd"), ("context_k", "CASE WHEN peak > 0 THEN peak / 1000.0 END"), ("span_min", "span_min")):
        mean = "avg(usd)" if measure == "cost_usd" else "CAST(NULL AS DOUBLE)"
        p95 = "CAST(NULL AS DOUBLE)" if measure == "context_k" else "quantile_cont(v, 0.95)"
        parts.append(f"SELECT grain, period, '{measure}' AS measure, count(*) AS n_prompts, {mean} AS mean, quantile_cont(v, 0.5) AS p50, "
                     f"quantile_cont(v, 0.9) AS p90, {p95} AS p95, count(v) AS nv FROM (SELECT *, {value} AS v FROM gp WHERE NOT automatic) "
                     "GROUP BY 1, 2 HAVING count(v) > 0")
    ok = "grain <> 'daily' OR n_prompts >= 20"
    return " UNION ALL ".join(
        f"SELECT grain, period, measure, n_prompts, " + ", ".join(
            f"CASE WHEN {ok} THEN round({c}, 6) END AS {c}" for c in ("mean", "p50", "p90", "p95")) + f" FROM ({p})" for p in parts)


@query("a25_trend_distribution", with_tables("cost", "session", extra=DAYS) + _dist_sql())
def _(L):
    out = T.trend_distribution(scoped(L, W28), L.session, TZ)
    return rounded(out, mean=6, p50=6, p90=6, p95=6)


RESUMES = ("SELECT session_id, request_id, us, (us - lag(us) OVER (PARTITION BY session_id ORDER BY us, request_id)) / 1e6 AS gap_s FROM "
           "cost WHERE agent_id IS NULL")


@query("w03_resume_gaps", with_tables("cost", extra=(("rg", RESUMES),)) +
       "SELECT session_id, request_id, us, round(gap_s, 6) AS gap_s FROM rg WHERE gap_s > 3600")
def _(L):
    return rounded(T.resume_gaps(L.cost).withColumn("us", us("ts")).drop("ts"), gap_s=6)


@query("a26_trend_events", with_tables("cost", "session", "request", "hook_event", extra=EXTRA + DAYS + (
    ("rg", RESUMES),
    ("ev", f"SELECT {LOCAL_DAY} AS day, 'resumed' AS event FROM rg WHERE gap_s > 3600 AND {between(W28)} UNION ALL SELECT {LOCAL_DAY}, "
           f"'compaction' FROM breaks WHERE cause = 'compaction' AND {between(W28)}"),
    ("al", " UNION ALL ".join(f"SELECT '{g}' AS grain, {_grain(g, 'day')} AS period, event, 1 AS n FROM ev" for g in T.GRAINS) +
           " UNION ALL SELECT grain, period, 'interrupted', interrupted FROM gp"),
)) + """SELECT grain, period, CAST(coalesce(sum(n) FILTER (event = 'resumed'), 0) AS BIGINT) AS resumed, CAST(coalesce(sum(n) FILTER
(event = 'interrupted'), 0) AS BIGINT) AS interrupted, CAST(coalesce(sum(n) FILTER (event = 'compaction'), 0) AS BIGINT) AS compaction
FROM al GROUP BY 1, 2""")
def _(L):
    return T.trend_events(L.cost, L.session, breaks_of(L), W28, TZ)


_PREV = {"daily": "CAST(period - 1 AS DATE)", "weekly": "CAST(period - 7 AS DATE)", "monthly": "CAST(period - INTERVAL 1 MONTH AS DATE)"}
_LEN = {"daily": "1", "weekly": "7", "monthly": "CAST(day(last_day(period)) AS INT)"}
CHANGE = DAYS + (
    ("pe", " UNION ALL ".join(
        f"SELECT DISTINCT '{g}' AS grain, period, {_PREV[g]} AS previous, {_LEN[g]} AS length FROM (SELECT {_grain(g, 'CAST(d AS DATE)')} AS "
        "period FROM generate_series(DATE'2024-01-02', DATE'2024-01-29', INTERVAL 1 DAY) g(d))" for g in T.GRAINS)),
    ("p2", "SELECT *, CAST(least(length, date_diff('day', period, DATE'2024-01-29') + 1) AS INT) AS elapsed FROM pe"),
    ("dp", "SELECT day, project, sum(coalesce(cost_usd, 0)) AS usd FROM sc GROUP BY 1, 2"),
    ("bp", "SELECT grain, period, project, sum(CASE WHEN day >= period AND day < period + elapsed THEN usd ELSE 0 END) AS cur, sum(CASE WHEN "
           "day >= previous AND day < previous + elapsed THEN usd ELSE 0 END) AS old FROM p2 JOIN dp ON (day >= period AND day < period + "
           "elapsed) OR (day >= previous AND day < previous + elapsed) GROUP BY 1, 2, 3"),
    ("tt", "SELECT grain, period, sum(cur) AS cur_t, sum(old) AS old_t FROM bp GROUP BY 1, 2"),
    ("dr", "SELECT grain, period, project AS driver, cur - old AS driver_delta_usd FROM (SELECT bp.*, row_number() OVER (PARTITION BY grain, "
           "period ORDER BY abs(cur - old) DESC, coalesce(project, '') DESC) AS rn FROM bp JOIN tt USING (grain, period) WHERE (cur - old) * "
           "(cur_t - old_t) > 0) WHERE rn = 1"),
    ("wh", "SELECT grain, period, sum(coalesce(cost_usd, 0)) AS total_usd, count(DISTINCT day) AS active_days, 100.0 * sum(coalesce(cost_usd, "
           "0)) FILTER (agent_id IS NOT NULL) / nullif(sum(coalesce(cost_usd, 0)), 0) AS delegated_pct, 100.0 * sum(coalesce(cost_usd, 0)) FILTER "
           "(family IN ('fable', 'opus')) / nullif(sum(coalesce(cost_usd, 0)), 0) AS premium_pct, count(*) FILTER (cost_usd IS NULL) AS "
           "unknown_cost_requests, sum(coalesce(cost_usd, 0)) FILTER (NOT automatic) / sum(ctx + coalesce(output_tok, 0)) FILTER (NOT automatic) "
           "* 1e6 AS blended FROM gr GROUP BY 1, 2"),
    ("pp", "SELECT grain, period, count(*) FILTER (NOT automatic) AS ip, 100.0 * sum(CASE WHEN peak >= 200000 THEN usd ELSE 0 END) / "
           "nullif(sum(usd), 0) AS large_pct, count(*) FILTER (NOT automatic AND n_requests >= 20) AS hr FROM gp GROUP BY 1, 2"),
)


@query("a27_period_change", with_tables("cost", "session", extra=CHANGE) + f"""SELECT grain, period, round(total_usd, 8) AS total_usd,
round(cur_t, 8) AS aligned_usd, round(old_t, 8) AS previous_usd, CASE WHEN previous >= (SELECT min({LOCAL_DAY}) FROM cost) AND NOT (grain =
'daily' AND period >= DATE'2024-01-29') AND old_t <> 0 THEN round((cur_t / old_t - 1) * 100, 6) END AS change_pct, active_days, CAST(length AS
INT) AS period_days, driver, round(driver_delta_usd, 8) AS driver_delta_usd, coalesce(ip, 0) AS interactive_prompts, round(delegated_pct, 6) AS
delegated_pct, round(premium_pct, 6) AS premium_pct, round(large_pct, 6) AS large_context_pct, round(blended, 6) AS blended_usd_per_mtok,
coalesce(hr, 0) AS high_request_prompts, unknown_cost_requests FROM p2 JOIN wh USING (grain, period) LEFT JOIN tt USING (grain, period) LEFT
JOIN dr USING (grain, period) LEFT JOIN pp USING (grain, period)""")
def _(L):
    out = T.period_change(L.cost, L.session, W28, TZ, dt.date(2024, 1, 29))
    return rounded(out, total_usd=8, aligned_usd=8, previous_usd=8, change_pct=6, driver_delta_usd=8, delegated_pct=6, premium_pct=6,
                   large_context_pct=6, blended_usd_per_mtok=6)


# ---- overview ----

W7 = Window(dt.date(2024, 1, 17), dt.date(2024, 1, 23))
TODAY = dt.date(2024, 1, 24)
_K = {"cost_usd": "coalesce(sum(cost_usd), 0)", "prompt_count": "count(DISTINCT prompt_id)", "request_count": "count(*)",
      "session_count": "count(DISTINCT session_id)", "project_count": "count(DISTINCT project)",
      "unknown_cost_request_count": "count(*) FILTER (cost_usd IS NULL)"}


def _overview(L):
    return O.overview(L.cost, L.session, L.prompt, priced_breaks_of(L), W7, TZ, TODAY)


@query("a28_overview_kpis", with_tables("cost", "session", extra=(
    ("cs", "SELECT * FROM cost LEFT JOIN session USING (session_id)"),
    ("k", " UNION ALL ".join(f"SELECT '{n}' AS kpi, (SELECT {e} FROM cs WHERE {between(W7)})::DOUBLE AS c, (SELECT {e} FROM cs WHERE "
                             f"{between(W7.previous())})::DOUBLE AS p" for n, e in _K.items())),
)) + """SELECT kpi, round(c, 8) AS "current", round(p, 8) AS previous, round(CASE WHEN p <> 0 THEN (c - p) / p * 100 END, 6) AS change_pct FROM k""")
def _(L):
    return rounded(O.kpis(L.cost, L.session, W7, TZ), current=8, previous=8, change_pct=6)


@query("a28_overview_daily", with_tables("cost") + f"""SELECT s.day, round(CASE WHEN c.n IS NULL THEN 0 ELSE c.cost END, 8) AS cost_usd,
coalesce(c.n, 0) AS n_requests, coalesce(c.known, 0) AS n_known, CAST(CASE WHEN s.day BETWEEN DATE'2024-01-17' AND DATE'2024-01-23' THEN 1 ELSE 0
END AS INT) AS selected FROM (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE'2023-12-25', DATE'2024-01-24', INTERVAL 1 DAY) g(d)) s
LEFT JOIN (SELECT {LOCAL_DAY} AS day, sum(cost_usd) AS cost, count(*) AS n, count(cost_usd) AS known FROM cost GROUP BY 1) c USING (day)""")
def _(L):
    return rounded(_overview(L)["daily"], cost_usd=8)


@query("a28_overview_components", with_tables("cost") + " UNION ALL ".join(
    f"SELECT '{n}' AS component, round(coalesce(sum({e}), 0), 8) AS cost_usd FROM cost WHERE {between(W7)}" for n, e in PARTS.items()))
def _(L):
    return rounded(_overview(L)["components"], cost_usd=8)


@query("a28_overview_top_prompts", with_tables("cost", "session") + f"""SELECT prompt_id, min(session_id) AS session_id, min(project) AS project,
count(*) AS n_requests, max({CTX}) AS peak_context, round(sum(cost_usd), 8) AS cost_usd FROM cost JOIN session USING (session_id)
WHERE prompt_id IS NOT NULL AND {between(W7)} GROUP BY 1 ORDER BY sum(cost_usd) DESC NULLS LAST, prompt_id LIMIT 40""")
def _(L):
    out = _overview(L)["top_prompts"]
    return rounded(out.select("prompt_id", "session_id", "project", "n_requests", "peak_context", "cost_usd"), cost_usd=8)


@query("a28_overview_top_sessions", with_tables("cost", "session") + f"""SELECT session_id, project, round(sum(cost_usd), 8) AS cost_usd,
count(DISTINCT prompt_id) AS n_prompts FROM cost JOIN session USING (session_id) WHERE {between(W7)} GROUP BY 1, 2
ORDER BY sum(cost_usd) DESC NULLS LAST, session_id DESC LIMIT 40""")
def _(L):
    return rounded(_overview(L)["top_sessions"].select("session_id", "project", "cost_usd", "n_prompts"), cost_usd=8)


@query("a28_overview_rebuilds", with_tables("request", "hook_event", "cost", "session", extra=EXTRA) + f"""SELECT cause, count(*) AS n_requests,
round(coalesce(sum(cache_write_usd), 0), 8) AS cost_usd FROM breaks b JOIN cost c USING (request_id) WHERE b.session_id IN (SELECT session_id
FROM session) AND {between(W7, 'b.us')} GROUP BY 1""")
def _(L):
    return rounded(_overview(L)["rebuilds"], cost_usd=8)


_SNAP = ", ".join((
    "round(coalesce(sum(cost_usd), 0), 8) AS total_usd", "count(*) AS request_count",
    "count(DISTINCT prompt_id) AS cost_bearing_prompt_count", "count(DISTINCT session_id) AS session_count",
    "count(DISTINCT project) AS project_count", "count(*) FILTER (cost_usd IS NULL) AS unknown_cost_request_count"))
_WIN = {"latest_day": "= (SELECT d FROM mx)", "latest_7_days": "BETWEEN (SELECT d FROM mx) - 6 AND (SELECT d FROM mx)", "all_observed": "IS NOT NULL"}


@query("a37_value_snapshot", with_tables("cost", "session", "prompt", extra=(
    ("cs", f"SELECT *, {LOCAL_DAY} AS day FROM cost LEFT JOIN session USING (session_id)"),
    ("mx", "SELECT max(day) AS d FROM cs"),
)) + " UNION ALL ".join(f"""SELECT '{n}' AS "window", {_SNAP}, (SELECT count(*) FROM prompt WHERE {LOCAL_DAY} {c}) AS prompt_table_rows FROM cs
WHERE day {c}""" for n, c in _WIN.items()))
def _(L):
    return rounded(O.value_snapshot(L.cost, L.session, L.prompt, TZ), total_usd=8)
