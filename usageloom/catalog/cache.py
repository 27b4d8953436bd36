"""Cache diagnosis on the derived ledger."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from usageloom.catalog.registry import SQL, query, rounded, us
from usageloom.catalog.rollups import LOCAL_DAY, TZ, W14, between, scoped
from usageloom.fixed_values import CAUSES
from usageloom.functions.scalar import micros
from usageloom.operators import breakfacts as BF, cache as C, rollups as A
from usageloom.session import shared_dir
from usageloom.sources.adapters import with_tables
from usageloom.sources.sinks import read_ledger, write_ledger

AS_OF = dt.datetime(2024, 1, 29, 6, 30, tzinfo=dt.timezone.utc)
AS_OF_US = int(AS_OF.timestamp()) * 1_000_000

# Numbered requests meet the one numbered before; what happened near them is looked up by ASOF joins.
_MIN = 60_000_000
NUMBERED = """SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY us, request_id) AS nr, cache_w5m_tok + cache_w1h_tok AS written
FROM request WHERE source = 'transcript' AND is_synthetic = 0"""
STEPS = """SELECT now.*, now.cache_read_tok - old.cache_read_tok - old.written AS gap, old.cache_read_tok + old.written AS expected,
now.us - old.us AS pause, now.us - old.end_us AS idle, old.us AS old_us, old.model AS old_model, old.is_interrupted AS cut_off,
old.cache_w5m_tok > 0 AND old.cache_w1h_tok = 0 AS short_lived FROM numbered old JOIN numbered now
ON now.lineage_id IS NOT DISTINCT FROM old.lineage_id AND now.nr = old.nr + 1 WHERE abs(gap) > 16 + coalesce(old.input_tok, 0)"""
COMPACTED = f"""SELECT s.request_id, h.us >= s.old_us - {10 * _MIN} AS hit FROM steps s ASOF JOIN (SELECT session_id, us FROM hook_event
WHERE kind LIKE '%Compact') h ON h.session_id = s.session_id AND s.us + {10 * _MIN} >= h.us"""
RESTARTED = """SELECT s.request_id, h.us >= s.old_us AS hit FROM steps s ASOF JOIN (SELECT session_id, us FROM hook_event
WHERE kind = 'SessionStart') h ON h.session_id = s.session_id AND s.us >= h.us"""
KEPT = f"""SELECT s.request_id, s.us - q.us < {60 * _MIN} AS hit FROM steps s ASOF JOIN (SELECT lineage_id, us FROM numbered
WHERE cache_w1h_tok > 0) q ON q.lineage_id = s.lineage_id AND s.us > q.us"""
BREAKS = f"""SELECT lineage_id, session_id, request_id, us, gap, coalesce(
if(cut_off = 1, 'interruption', NULL), if(c.hit, 'compaction', NULL), if(model <> old_model, 'model_switch', NULL), if(r.hit, 'config_change', NULL),
if(pause > {60 * _MIN} OR (short_lived AND idle > {5 * _MIN} AND cache_read_tok * 10 < expected AND NOT coalesce(k.hit, FALSE)), 'ttl_expiry', NULL),
'unknown') AS cause, pause / 1e6 AS gap_seconds
FROM steps LEFT JOIN compacted c USING (request_id) LEFT JOIN restarted r USING (request_id) LEFT JOIN kept k USING (request_id)"""
EXTRA = (("numbered", NUMBERED), ("steps", STEPS), ("compacted", COMPACTED), ("restarted", RESTARTED), ("kept", KEPT), ("breaks", BREAKS))
WITH_BREAKS = with_tables("request", "hook_event", extra=EXTRA)
PRICED = (f"SELECT b.*, c.cache_write_usd, s.project FROM breaks b JOIN cost c USING (request_id) JOIN session s ON "
          f"s.session_id = b.session_id WHERE {between(us_col='b.us')}")
WITH_PRICED = with_tables("request", "hook_event", "cost", "session", extra=EXTRA + (("pb", PRICED),))


def breaks_of(L):
    return C.cache_identity(L.request, L.hook_event)


def priced_breaks_of(L):
    return C.cache_identity(L.cost, L.hook_event, keep=("cache_write_usd",))


def priced(L):
    return A.join_project(A.period_filter(priced_breaks_of(L), W14, TZ), L.session, "inner")


@query("w01_cache_identity", WITH_BREAKS + "SELECT * REPLACE (round(gap_seconds, 6) AS gap_seconds) FROM breaks")
def _(L):
    return rounded(breaks_of(L).withColumn("us", us("ts")).drop("ts"), gap_seconds=6)


@query("j04_exists_hook_near", with_tables("request", "hook_event") + """SELECT request_id, CAST(EXISTS (SELECT 1 FROM
hook_event h WHERE h.session_id = r.session_id AND h.kind = 'PreCompact' AND h.us BETWEEN r.us - 600000000 AND
r.us + 600000000) AS INT) AS near FROM request r""")
def _(L):
    out = C.exists_hook_near(L.request, L.hook_event, ("PreCompact",),
                             micros("ts") - 600_000_000, micros("ts"), 600_000_000, "near")
    return out.select("request_id", "near")


@query("j05_anti_live_1h", with_tables("request") + """SELECT request_id, CAST(EXISTS (SELECT 1 FROM request q WHERE
q.lineage_id = r.lineage_id AND q.us < r.us AND q.cache_w1h_tok > 0 AND r.us - q.us < 3600000000) AS INT) AS live_1h
FROM request r""")
def _(L):
    return C.anti_live_1h(L.request).select("request_id", "live_1h")


@query("a18_rebuild_by_cause", WITH_PRICED + """SELECT cause, count(*) AS n_requests,
round(coalesce(sum(cache_write_usd), 0), 8) AS cost_usd FROM pb GROUP BY cause""")
def _(L):
    return rounded(C.rebuild_by_cause(priced(L)), cost_usd=8)


_CLASS = ("CASE WHEN gap > 0 THEN 'growth' WHEN gap_seconds >= 300 THEN 'idle' ELSE 'active' END")


@query("a18_cache_rebuild_daily", WITH_PRICED + f"""SELECT {LOCAL_DAY} AS day, {_CLASS} AS class, """ + ", ".join(
    f"count(*) FILTER (cause = '{c}') AS {c}_n, round(coalesce(sum(cache_write_usd) FILTER (cause = '{c}'), 0), 8) AS {c}_usd"
    for c in CAUSES) + " FROM pb GROUP BY 1, 2")
def _(L):
    return rounded(C.cache_rebuild_daily(priced(L), TZ), **{f"{c}_usd": 8 for c in CAUSES})


@query("a18_break_coverage", WITH_PRICED + """SELECT count(*) AS n_breaks, round(100.0 * count(*) FILTER (cause <> 'unknown')
/ count(*), 6) AS classified_pct, count(*) FILTER (us < (SELECT min(us) FROM hook_event)) AS n_before_hooks,
CAST(CASE WHEN (SELECT min(us) FROM hook_event) IS NULL THEN 1 ELSE 0 END AS INT) AS hooks_missing FROM pb""")
def _(L):
    return rounded(C.break_coverage(priced(L), L.hook_event), classified_pct=6)


_END = W14.instants(TZ)[1]
_END_US = int(_END.timestamp()) * 1_000_000


@query("a18_repeat_expiry", with_tables("request", "hook_event", "session", extra=EXTRA) + f"""SELECT project, count(*) AS
n_expiries FROM breaks JOIN session USING (session_id) WHERE cause = 'ttl_expiry' AND us >= {_END_US - 28 * 86400000000}
AND us < {_END_US} GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 1""")
def _(L):
    return C.repeat_expiry(breaks_of(L), L.session, _END)


MONEY = ("sum(cache_read_tok*in_usd*price_factor/1e6*cache_read_x) AS rd, sum(cache_w5m_tok*in_usd*price_factor/1e6*"
         "cache_w5m_x) AS w5, sum(cache_w1h_tok*in_usd*price_factor/1e6*cache_w1h_x) AS w1, "
         "sum(cache_read_tok*in_usd*price_factor/1e6*(1-cache_read_x)) AS sv")


@query("a20_cache_balance", with_tables("cost", "session") + f"""SELECT round(rd, 8) AS read_usd, round(w5 + w1, 8) AS write_usd,
round(sv, 8) AS saving_usd, read_tok, write_tok, round(read_tok / write_tok, 6) AS read_write_ratio,
round(greatest(0.0, w5 + w1 - sv), 8) AS unoffset_write_usd, unknown_cost_requests FROM (SELECT {MONEY},
CAST(sum(cache_read_tok) AS BIGINT) AS read_tok, CAST(sum(cache_w5m_tok + cache_w1h_tok) AS BIGINT) AS write_tok,
count(*) FILTER (cost_usd IS NULL) AS unknown_cost_requests FROM cost JOIN session USING (session_id) WHERE {between()})""")
def _(L):
    known = scoped(L).join(L.session.select("session_id"), "session_id", "left_semi")
    return rounded(C.cache_balance(known), read_usd=8, write_usd=8, saving_usd=8, read_write_ratio=6, unoffset_write_usd=8)


@query("a20_cache_balance_daily", with_tables("cost") + f"""SELECT {LOCAL_DAY} AS day, round(coalesce(rd, 0), 8) AS read_usd,
round(coalesce(w5, 0), 8) AS w5m_usd, round(coalesce(w1, 0), 8) AS w1h_usd, round(coalesce(sv, 0), 8) AS saving_usd FROM
(SELECT {LOCAL_DAY} AS d, min(us) AS us, {MONEY} FROM cost WHERE {between()} GROUP BY 1)""")
def _(L):
    return rounded(C.cache_balance_daily(scoped(L), TZ), read_usd=8, w5m_usd=8, w1h_usd=8, saving_usd=8)


@query("a19_cache_sessions", with_tables("request", "hook_event", "cost", "session", extra=EXTRA + (
    ("pb", PRICED),
    ("m", f"SELECT session_id, model, {MONEY}, sum(cache_read_tok) AS cr, sum(input_tok + cache_read_tok + cache_w5m_tok + "
          f"cache_w1h_tok) AS side, sum(coalesce(output_tok, 0)) AS outp, sum(cost_usd) AS cost_usd FROM cost WHERE "
          f"{between()} GROUP BY ALL"),
    ("s1", "SELECT session_id, project, coalesce(sum(rd), 0) AS rd, coalesce(sum(w5), 0) AS w5, coalesce(sum(w1), 0) AS w1, "
           "sum(cr) AS cr, sum(side) AS side, sum(outp) AS outp, coalesce(sum(cost_usd), 0) AS cost_usd, max(side) AS main_tok "
           "FROM m JOIN session USING (session_id) GROUP BY session_id, project"),
    ("s2", "SELECT * FROM s1 ORDER BY w5 + w1 DESC, session_id LIMIT 15"),
    ("mm", "SELECT session_id, model FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY side DESC, "
           "lower(coalesce(model, '')) DESC) AS rn FROM m) WHERE rn = 1"),
    ("cs", "SELECT session_id, string_agg(cause || ' ' || n, ', ' ORDER BY rn) AS causes FROM (SELECT session_id, cause, "
           "count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, cause) AS rn FROM pb GROUP BY 1, 2) "
           "WHERE rn <= 2 GROUP BY 1"),
)) + """SELECT session_id, project, causes, round(w5, 8) AS w5m_usd, round(w1, 8) AS w1h_usd, round(w5 + w1, 8) AS write_usd,
round(rd, 8) AS read_usd, round(cr / side, 6) AS hit_ratio, CASE WHEN model LIKE '%opus%' THEN 'opus' WHEN model LIKE '%sonnet%'
THEN 'sonnet' WHEN model LIKE '%haiku%' THEN 'haiku' ELSE 'other' END AS main_family,
CAST(CASE WHEN main_tok / side < 0.9 THEN 1 ELSE 0 END AS INT) AS mixed, round(cost_usd / (side + outp) * 1e6, 6) AS
blended_usd_per_mtok, round(cost_usd, 8) AS cost_usd, CAST(CASE WHEN main_tok / side >= 0.9 AND cr / side < 0.9 AND
cost_usd >= 1 THEN 1 ELSE 0 END AS INT) AS highlight FROM s2 JOIN mm USING (session_id) LEFT JOIN cs USING (session_id)""")
def _(L):
    out = C.cache_sessions(scoped(L), priced(L), L.session, 15)
    return rounded(out, w5m_usd=8, w1h_usd=8, write_usd=8, read_usd=8, hit_ratio=6, blended_usd_per_mtok=6, cost_usd=8)


@query("k03_top_losses", WITH_PRICED + """SELECT CASE WHEN gap_seconds >= 300 THEN 'idle' ELSE 'active' END AS class, session_id,
project, cause, round(gap_seconds, 6) AS gap_seconds, -gap AS lost_tok, round(coalesce(cache_write_usd, 0), 8) AS rebuild_usd,
request_id FROM pb WHERE gap <= 0 ORDER BY coalesce(cache_write_usd, 0) DESC, request_id LIMIT 15""")
def _(L):
    return rounded(C.top_losses(priced(L), 15), gap_seconds=6, rebuild_usd=8)


def ttl_sql(days: int) -> str:
    lo = AS_OF_US - days * 86400000000
    return with_tables("request", "hook_event", "cost", extra=EXTRA + (
        ("e", f"SELECT count(DISTINCT {LOCAL_DAY}) AS active_days, CAST(date_diff('day', min({LOCAL_DAY}), max({LOCAL_DAY})) + 1 "
              f"AS INT) AS evidence_span_days, sum(cache_write_usd) AS w FROM cost WHERE us >= {lo}"),
        ("x", f"SELECT count(*) AS n, coalesce(sum(c.cache_write_usd), 0) AS usd FROM breaks b JOIN cost c USING (request_id) "
              f"WHERE b.us >= {lo} AND cause = 'ttl_expiry'"),
    )) + f"""SELECT active_days, evidence_span_days, round(w, 8) AS all_cache_write_usd, n AS ttl_expiry_events,
round(usd, 8) AS ttl_expiry_rebuild_usd, round(100.0 * usd / w, 6) AS ttl_share_pct,
round(usd / evidence_span_days, 6) AS avoidable_usd_per_calendar_day, CASE WHEN evidence_span_days < {min(days, 28)} OR
active_days < 10 THEN 'insufficient_data' WHEN usd / evidence_span_days < 5 OR 100.0 * usd / w < 10 THEN 'deprioritize' ELSE
'continue_experiment' END AS decision FROM e, x"""


@query("a32_ttl_review", ttl_sql(14))
def _(L):
    out = C.ttl_review(L.cost, priced_breaks_of(L), AS_OF, 14, TZ)
    return rounded(out, all_cache_write_usd=8, ttl_expiry_rebuild_usd=8, ttl_share_pct=6, avoidable_usd_per_calendar_day=6)


# ---- breaks as facts, built in batches of days ----

def built_breaks(L):
    """Requests and hooks written by day; breaks built in three batches of days, the second of them twice."""
    root = f"{shared_dir(L.spark)}/usageloom/breaks-{uuid.uuid4().hex}"
    write_ledger({"request": L.request.drop("prompt_id"), "hook_event": L.hook_event}, root, {})
    req, hooks = read_ledger(L.spark, root, "request"), read_ledger(L.spark, root, "hook_event")
    first, last = req.agg(F.min("utc_day"), F.max("utc_day")).first()
    days = (last - first).days + 1
    edges = [first + dt.timedelta(days=days * k // 3) for k in range(4)]
    spans = [(a, b - dt.timedelta(days=1)) for a, b in zip(edges[:-1], edges[1:]) if a < b]
    for a, b in [*spans[:2], spans[min(1, len(spans) - 1)], *spans[2:]]:
        BF.build_breaks(req, hooks, root, a, b)
    return BF.break_facts(L.spark, root)


def facts_priced(L):
    """Breaks of the period by their days, the money from the period's requests, known sessions."""
    return C.priced_breaks(A.period_filter(built_breaks(L), W14, TZ), scoped(L), L.session)


@query("w01_break_facts", SQL["w01_cache_identity"])
def _(L):
    return rounded(built_breaks(L).withColumn("us", us("ts")).drop("ts", "utc_day"), gap_seconds=6)


@query("a18_rebuild_from_facts", SQL["a18_rebuild_by_cause"])
def _(L):
    return rounded(C.rebuild_by_cause(facts_priced(L)), cost_usd=8)


@query("a19_sessions_from_facts", SQL["a19_cache_sessions"])
def _(L):
    out = C.cache_sessions(scoped(L), facts_priced(L), L.session, 15)
    return rounded(out, w5m_usd=8, w1h_usd=8, write_usd=8, read_usd=8, hit_ratio=6, blended_usd_per_mtok=6, cost_usd=8)


@query("k03_losses_from_facts", SQL["k03_top_losses"])
def _(L):
    return rounded(C.top_losses(facts_priced(L), 15), gap_seconds=6, rebuild_usd=8)


@query("a32_ttl_from_facts", SQL["a32_ttl_review"])
def _(L):
    out = C.ttl_review(L.cost, built_breaks(L), AS_OF, 14, TZ)
    return rounded(out, all_cache_write_usd=8, ttl_expiry_rebuild_usd=8, ttl_share_pct=6, avoidable_usd_per_calendar_day=6)
