"""Judgments, task links and commits on events derived from the driver's orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from usageloom.catalog.registry import query, rounded, us
from usageloom.operators import judgments as J
from usageloom.sources.adapters import with_tables

# One judgment per order; the kind follows from the last two digits of the key.
_G = "CAST(CAST(floor(o_orderkey / 1e2) AS BIGINT) AS STRING)"
_TS = "1704067200 + o_orderkey"
KINDS = {
    10: ("marker_start", "'marker_id', concat('v', {g}), 'ts_start', {t}, 'category', 'cache', 'hypothesis', o_orderpriority"),
    20: ("marker_start", "'marker_id', concat('v', {g}), 'ts_start', {t}, 'category', 'late', 'hypothesis', o_orderpriority"),
    30: ("marker_end", "'marker_id', concat('v', {g}), 'ts_end', {t}"),
    40: ("marker_end", "'marker_id', concat('v', {g}), 'ts_end', {t} + 5"),
    50: ("marker_verdict", "'marker_id', concat('v', {g}), 'verdict', CASE WHEN o_custkey % 5 = 0 THEN 'maybe' ELSE 'win' END, 'decided_by', "
         "CASE WHEN o_custkey % 7 = 0 THEN 'robot' ELSE 'human' END, 'verdict_ts', {t}, 'saving_usd', o_totalprice"),
    60: ("marker_end", "'marker_id', concat('x', {g}), 'ts_end', {t}"),
    5: ("marker_end", "'marker_id', concat('v', {g}), 'ts_end', {t}"),  # before its start
    11: ("task_start", "'task_id', concat('k', {g}), 'title', 'do', 'category', CASE WHEN o_custkey % 7 = 0 THEN 'fun' ELSE 'chore' END, 'ts_start', {t}"),
    12: ("task_attach", "'task_id', concat('k', {g}), 'prompt_id', CASE WHEN o_custkey % 6 = 0 THEN 'zz' ELSE concat('q', {g}) END, 'attached_ts', {t}"),
    13: ("task_attach", "'task_id', concat('k', {g}), 'prompt_id', concat('q', {g}), 'attached_ts', {t}, 'confidence', 0.5D"),
    14: ("task_finish", "'task_id', concat('k', {g}), 'ts_end', {t}, 'outcome', CASE WHEN o_custkey % 11 = 0 THEN 'bogus' ELSE 'completed' END, "
         "'quality_score', o_custkey % 7, 'rework_minutes', o_custkey % 9 - 1"),
    15: ("task_label", "'prompt_id', concat('q', {g}), 'label', CASE WHEN o_custkey % 9 = 0 THEN 'other' ELSE 'design' END"),
    16: ("task_label", "'prompt_id', concat('q', {g}), 'label', CASE WHEN o_custkey % 2 = 0 THEN 'chore' ELSE 'nope' END"),
    17: ("outcome", "'prompt_id', concat('q', {g}), 'ts', {t}, 'label', 'partial', 'source', CASE WHEN o_custkey % 8 = 0 THEN 'guess' ELSE 'manual' END"),
    18: ("roi_cost", "'cost_id', concat('c', {g}), 'ts', {t}, 'cost_kind', 'review', 'minutes', CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 30 END"),
    19: ("regime", "'ts', {t}, 'regime_kind', 'config_change', 'detail', concat('d', CAST(o_custkey % 20 AS STRING))"),
    21: ("invoice", "'month', concat('2024-0', CAST(1 + o_custkey % 3 AS STRING)), 'billed_usd', o_totalprice, 'ts', {t}"),
    22: ("bogus", "'x', 1"),
    23: ("marker_start", "'marker_id', concat('w', {g})"),
}


def judgment_hooks(L):
    payload = "CASE o_orderkey % 100 " + " ".join(
        f"WHEN {k} THEN to_json(named_struct('payload', named_struct('kind', '{kind}', {fields.format(g=_G, t=_TS)})))" for k, (kind, fields) in KINDS.items()) + " END"
    rows = L.table("orders").selectExpr(f"timestamp_seconds({_TS}) AS ts", "'judgment' AS kind", f"{payload} AS payload_json")
    return rows.where("payload_json IS NOT NULL")


def judged_prompts(L):
    return L.table("orders").where("o_orderkey % 100 = 0").selectExpr(f"concat('q', {_G}) AS prompt_id")


def replay(L):
    return J.replay_judgments(judgment_hooks(L), judged_prompts(L))


O = (("o", f"SELECT *, {_G} AS g, {_TS} AS t, o_orderkey % 100 AS k FROM orders"),
     ("ks", "SELECT g, t FROM o WHERE k = 11 AND o_custkey % 7 <> 0"))
WITH_O = with_tables(extra=O)
_VALID_VERDICT = "k = 50 AND o_custkey % 5 <> 0 AND o_custkey % 7 <> 0 AND g IN (SELECT g FROM o WHERE k = 10)"


@query("t16_marker", WITH_O + f"""SELECT 'v' || s.g AS marker_id, s.t * 1000000 AS start_us, 'cache' AS category, coalesce(f.t + 5, e.t) * 1000000 AS end_us, CASE WHEN v.t IS NOT
NULL THEN 'win' END AS verdict, v.o_totalprice AS saving_usd FROM (SELECT * FROM o WHERE k = 10) s LEFT JOIN (SELECT * FROM o WHERE k = 30) e USING (g) LEFT JOIN (SELECT * FROM o WHERE
k = 40) f USING (g) LEFT JOIN (SELECT * FROM o WHERE {_VALID_VERDICT}) v USING (g)""")
def _(L):
    m = replay(L)["marker"]
    return m.select("marker_id", us("ts_start").alias("start_us"), "category", us("ts_end").alias("end_us"), "verdict", "saving_usd")


@query("t16_work_task", WITH_O + """SELECT 'k' || s.g AS task_id, s.t * 1000000 AS start_us, CASE WHEN f.t IS NULL THEN 'active' ELSE 'finished' END AS status, f.t * 1000000 AS end_us,
CASE WHEN f.t IS NOT NULL THEN 'completed' END AS outcome, CAST(f.o_custkey % 7 AS INT) AS quality_score FROM ks s LEFT JOIN (SELECT * FROM o WHERE k = 14 AND o_custkey % 11 <> 0 AND
o_custkey % 7 BETWEEN 1 AND 5 AND o_custkey % 9 <> 0) f USING (g)""")
def _(L):
    t = replay(L)["work_task"]
    return t.select("task_id", us("ts_start").alias("start_us"), "status", us("ts_end").alias("end_us"), "outcome", "quality_score")


@query("t16_task_prompt", WITH_O + """SELECT 'q' || g AS prompt_id, 'k' || g AS task_id, t * 1000000 AS attached_us, 0.5::DOUBLE AS confidence FROM o WHERE k = 13 AND g IN (SELECT g FROM
ks) UNION ALL SELECT 'q' || g, 'k' || g, t * 1000000, 1.0::DOUBLE FROM o WHERE k = 12 AND o_custkey % 6 <> 0 AND g IN (SELECT g FROM ks) AND g NOT IN (SELECT g FROM o WHERE k = 13)""")
def _(L):
    t = replay(L)["task_prompt"]
    return t.select("prompt_id", "task_id", us("attached_ts").alias("attached_us"), "confidence")


@query("t16_labels", WITH_O + """SELECT 'q' || g AS prompt_id, CASE WHEN bool_or(k = 16) THEN 'chore' ELSE 'design' END AS task_label FROM o WHERE (k = 15 AND o_custkey % 9 <> 0) OR (k = 16
AND o_custkey % 2 = 0) GROUP BY 1""")
def _(L):
    return J.label_prompts(judged_prompts(L), replay(L)["task_label"]).where("task_label IS NOT NULL")


@query("t16_facts", WITH_O + """SELECT 'outcome' AS what, count(*) AS n FROM o WHERE k = 17 AND o_custkey % 8 <> 0 UNION ALL SELECT 'roi_cost', count(*) FROM o WHERE k = 18 AND o_custkey % 5
<> 0 UNION ALL SELECT 'regime_event', count(DISTINCT o_custkey % 20) FROM o WHERE k = 19 UNION ALL SELECT 'invoice', count(DISTINCT o_custkey % 3) FROM o WHERE k = 21""")
def _(L):
    tables = replay(L)
    out = None
    for name in ("outcome", "roi_cost", "regime_event", "invoice"):
        part = tables[name].agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("t16_invoice", WITH_O + """SELECT month, billed_usd FROM (SELECT '2024-0' || (1 + o_custkey % 3) AS month, o_totalprice AS billed_usd, row_number() OVER (PARTITION BY o_custkey % 3
ORDER BY t DESC) AS rn FROM o WHERE k = 21) WHERE rn = 1""")
def _(L):
    return replay(L)["invoice"].select("month", "billed_usd")


@query("t16_rejected", WITH_O + """SELECT reason, count(DISTINCT u) AS n FROM (SELECT CASE k WHEN 22 THEN 0 ELSE o_orderkey END AS u, CASE k WHEN 5 THEN 'marker not found' WHEN 60 THEN 'marker not found' WHEN 30 THEN CASE WHEN g NOT IN (SELECT g
FROM o WHERE k = 10) THEN 'marker not found' END WHEN 40 THEN CASE WHEN g NOT IN (SELECT g FROM o WHERE k = 10) THEN 'marker not found' END WHEN 50 THEN CASE WHEN o_custkey % 5 = 0 THEN
'invalid verdict' WHEN o_custkey % 7 = 0 THEN 'invalid decided_by' WHEN g NOT IN (SELECT g FROM o WHERE k = 10) THEN 'marker not found' END WHEN 11 THEN CASE WHEN o_custkey % 7 = 0 THEN
'invalid task category' END WHEN 12 THEN CASE WHEN g NOT IN (SELECT g FROM ks) THEN 'task not found' WHEN o_custkey % 6 = 0 THEN 'prompt not found' END WHEN 13 THEN CASE WHEN g NOT IN
(SELECT g FROM ks) THEN 'task not found' END WHEN 14 THEN CASE WHEN o_custkey % 11 = 0 THEN 'invalid task outcome' WHEN o_custkey % 7 NOT BETWEEN 1 AND 5 THEN
'quality_score must be 1..5' WHEN o_custkey % 9 = 0 THEN 'rework_minutes must be non-negative' WHEN g NOT IN (SELECT g FROM ks) THEN 'task not found' END WHEN 15 THEN CASE WHEN o_custkey
% 9 = 0 THEN 'invalid task label' END WHEN 16 THEN CASE WHEN o_custkey % 2 <> 0 THEN 'invalid task label' END WHEN 17 THEN CASE WHEN o_custkey % 8 = 0 THEN 'invalid outcome' END WHEN 18
THEN CASE WHEN o_custkey % 5 = 0 THEN 'roi cost requires minutes or usd' END WHEN 22 THEN 'unknown judgment kind: bogus' WHEN 23 THEN 'missing keys: ts_start,category,hypothesis' END AS
reason FROM o) WHERE reason IS NOT NULL GROUP BY 1""")
def _(L):
    return replay(L)["rejected"].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- task links ----

_TASK = "concat('k', CAST((us % 400) * 50 AS STRING))"


@query("t17_link_tasks", with_tables("hook_event", "prompt", "work_task", "task_prompt", extra=(
    ("h", f"SELECT us, session_id, {_TASK} AS task_id FROM hook_event WHERE kind = 'UserPromptSubmit' AND {_TASK} IN (SELECT task_id FROM work_task)"),
    ("n", "SELECT h.*, (SELECT p.prompt_id FROM prompt p WHERE p.session_id = h.session_id AND abs(p.us - h.us) <= 120000000 ORDER BY abs(p.us - h.us), p.us, p.prompt_id DESC LIMIT 1) AS "
          "prompt_id FROM h"),
    ("d", "SELECT n.task_id, n.prompt_id, n.us, greatest(0.5::DOUBLE, 1.0::DOUBLE - abs(p.us - n.us) / 240e6) AS confidence, row_number() OVER (PARTITION BY n.prompt_id ORDER BY n.us, "
          "n.task_id) AS rn FROM n JOIN prompt p USING (prompt_id) WHERE n.prompt_id NOT IN (SELECT prompt_id FROM task_prompt)"),
)) + "SELECT task_id, prompt_id, us AS attached_us, 'active_task_hook' AS source, round(confidence, 6) AS confidence FROM d WHERE rn = 1")
def _(L):
    hooks = L.hook_event.where("kind = 'UserPromptSubmit'").selectExpr("ts", "session_id", "prompt_id", f"{_TASK.replace('us', 'unix_micros(ts)')} AS task_id")
    out = J.link_tasks(hooks, L.prompt, L.work_task, L.task_prompt).withColumn("attached_us", us("attached_ts")).drop("attached_ts")
    return rounded(out, confidence=6)


# ---- commits ----

COMMIT = {
    "sha": "md5(CAST(o_orderkey AS STRING))",
    "us": "1704067200000000 + (o_orderkey % 2900) * 900000000",
    "repo_path": "concat('proj/', CAST(o_custkey % 40 AS STRING))",
    "body": "CASE WHEN o_orderkey % 10 = 0 AND o_orderkey > 0 THEN concat('undo. This reverts commit ', upper(substr(md5(CAST(o_orderkey - 1 AS STRING)), 1, CAST(4 + o_orderkey % 60 / 10 AS "
            "INT))), '.') ELSE 'work' END",
    "insertions": "o_custkey % 100",
    "deletions": "o_custkey % 10",
}
COMMIT_WHERE = "o_orderkey % 10 IN (0, 4, 9)"
_COMMITS = f"SELECT {', '.join(f'{e} AS {n}' for n, e in COMMIT.items())} FROM orders WHERE {COMMIT_WHERE}"


def commit_hooks(L):
    rows = L.table("orders").where(COMMIT_WHERE).selectExpr(*[f"{e} AS {n}" for n, e in COMMIT.items()])
    return rows.selectExpr("timestamp_micros(us) AS ts", "'git_commit' AS kind",
                           "to_json(named_struct('payload', named_struct('sha', sha, 'repo_path', repo_path, 'body', body, 'insertions', insertions, 'deletions', deletions))) AS payload_json")


ATTRIBUTED = (
    ("c", _COMMITS),
    ("pp", "SELECT p.prompt_id, p.us, s.project FROM prompt p JOIN session s USING (session_id)"),
    ("atr", "SELECT c.*, (SELECT prompt_id FROM pp WHERE pp.project = replace(c.repo_path, '/', '-') AND pp.us <= c.us AND c.us - pp.us <= 21600000000 ORDER BY pp.us DESC, pp.prompt_id DESC "
           "LIMIT 1) AS prompt_id FROM c"),
)
REVERTED = (
    ("rv", "SELECT us, lower(regexp_extract(body, 'This reverts commit ([0-9a-fA-F]+)', 1)) AS px FROM c WHERE body LIKE '%This reverts commit%'"),
    ("ro", "SELECT DISTINCT us, (SELECT prompt_id FROM atr WHERE starts_with(sha, px) AND prompt_id IS NOT NULL ORDER BY length(sha), sha LIMIT 1) AS prompt_id FROM rv"),
    ("oc", "SELECT prompt_id, us, arg_min(insertions, sha) AS ins, arg_min(deletions, sha) AS del FROM atr WHERE prompt_id IS NOT NULL GROUP BY 1, 2"),
)


def attributed(L):
    commits = J.commit_events(commit_hooks(L))
    return commits, J.attribute_commits(commits, L.prompt, L.session)


@query("t18_attribute_commits", with_tables("prompt", "session", extra=ATTRIBUTED) + "SELECT sha, us, prompt_id FROM atr")
def _(L):
    return attributed(L)[1].select("sha", us("ts").alias("us"), "prompt_id")


@query("t18_commit_outcomes", with_tables("prompt", "session", extra=ATTRIBUTED + REVERTED) +
       "SELECT prompt_id, us, 'completed' AS label, ins AS lines_added, del AS lines_removed, 'auto' AS source FROM oc")
def _(L):
    return J.commit_outcomes(attributed(L)[1]).withColumn("us", us("ts")).drop("ts", "commits")


@query("t19_detect_reverts", with_tables("prompt", "session", extra=ATTRIBUTED + REVERTED) + """SELECT coalesce(r.prompt_id, oc.prompt_id) AS prompt_id, coalesce(r.us, oc.us) AS us, CASE WHEN
r.us IS NOT NULL THEN 'reverted' ELSE 'completed' END AS label, CASE WHEN r.us IS NULL THEN ins END AS lines_added FROM (SELECT * FROM ro WHERE prompt_id IS NOT NULL) r FULL JOIN oc ON
oc.prompt_id = r.prompt_id AND oc.us = r.us""")
def _(L):
    commits, found = attributed(L)
    completed = J.commit_outcomes(found)
    nobody = completed.where("false")
    out = J.merge_outcomes(nobody, completed, J.detect_reverts(commits, found))
    return out.select("prompt_id", us("ts").alias("us"), "label", "lines_added")
