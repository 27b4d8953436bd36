"""Data-quality checks and what the ledger cannot see (A-14 … A-17, A-33, A-35, J-06 … J-08)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from usageloom.fixed_values import HEALTH_TEXTS as TEXT
from usageloom.functions.scalar import iso_week, local_day, micros, nz, share, utc_day, utc_month
from usageloom.functions.quantiles import exact_quantiles
from usageloom.operators.pricing import covers, price_segments, tool_units
from usageloom.operators.rollups import prompt_cost, union_rows
from usageloom.operators.temporal import asof_backward
from usageloom.sources.prices import price_overlaps

DAY_S = 86_400


def orphan_agents(req: DataFrame, agents: DataFrame) -> DataFrame:
    """Agents that made requests but were never described (J-06)."""
    seen = req.where(F.col("agent_id").isNotNull()).select("agent_id").distinct()
    return seen.join(agents.select("agent_id"), "agent_id", "left_anti")


def unknown_models(req: DataFrame, price: DataFrame) -> DataFrame:
    """Models used on a date without a price, with the number of requests (J-06).

    Requests are first counted per model and date; only those counts meet the price list.
    """
    used = (
        req.where((F.col("is_synthetic") == 0) & F.col("model").isNotNull())
        .groupBy("model", utc_day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    )
    segments = price_segments(price, "model", ("in_usd",)).withColumnRenamed("model", "_model")
    lost = used.join(
        segments, (F.col("model") == F.col("_model")) & covers(F.col("day")), "left_anti"
    )
    return lost.groupBy("model").agg(F.sum("n").alias("n_requests"))


def unpriced_tools(req: DataFrame, price_tool: DataFrame) -> DataFrame:
    """Server tools with billed units on a date without a rate (J-06)."""
    used = (
        req.select(
            utc_day("ts").alias("day"), F.explode(tool_units("server_tool_use")).alias("tool", "units")
        )
        .where(F.col("units").try_cast("double") > 0)
        .groupBy("tool", "day").agg(F.count(F.lit(1)).alias("n"))
    )
    segments = price_segments(price_tool, "tool", ("usd_per_unit",)).withColumnRenamed("tool", "_tool")
    lost = used.join(segments, (F.col("tool") == F.col("_tool")) & covers(F.col("day")), "left_anti")
    return lost.groupBy("tool").agg(F.sum("n").alias("n_requests"))


def lost_interruptions(prompt: DataFrame, req: DataFrame, columns: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """Interrupted prompts whose request never arrived, with the request before them (J-07).

    ``columns`` of that request come in struct ``before``.
    """
    missing = (
        prompt.where(F.col("interrupted_message_id").isNotNull())
        .join(
            req.where(F.col("message_id").isNotNull()).select(
                F.col("message_id").alias("interrupted_message_id")
            ),
            "interrupted_message_id", "left_anti",
        )
        .select("prompt_id", "session_id", "ts")
    )
    earlier = req.where(F.col("is_synthetic") == 0)
    return asof_backward(
        missing, earlier, "session_id", micros("ts"), micros("ts"), "request_id", columns, "before"
    )


def unaccounted(prompt: DataFrame, req: DataFrame, cost: DataFrame, tz: str) -> DataFrame:
    """Lower bound of what lost interruptions cost, per local day (A-16).

    ``cost`` is the priced form of ``req``; the anti join looks at all of ``req``.
    """
    priced = cost.select(
        "request_id", "session_id", "ts", "message_id", "is_synthetic",
        (
            (nz("cache_read_tok") * F.col("in_usd") * F.col("cache_read_x")
             + nz("input_tok") * F.col("in_usd")) / F.lit(1e6)
        ).alias("input_side_usd"),
    )
    missing = (
        prompt.where(F.col("interrupted_message_id").isNotNull())
        .join(
            req.where(F.col("message_id").isNotNull()).select(
                F.col("message_id").alias("interrupted_message_id")
            ),
            "interrupted_message_id", "left_anti",
        )
        .select("prompt_id", "session_id", "ts")
    )
    found = asof_backward(
        missing, priced, "session_id", micros("ts"), micros("ts"), "request_id",
        ("input_side_usd",), "before",
    )
    return found.groupBy(local_day("ts", tz).alias("day"), utc_month("ts").alias("month_utc")).agg(
        F.count(F.lit(1)).alias("n_lost_interruptions"),
        F.sum(F.coalesce("before.input_side_usd", F.lit(0.0))).alias("input_side_lower_usd"),
    )


def label_coverage(prompt: DataFrame, outcome: DataFrame, cost: DataFrame, tz: str) -> DataFrame:
    """Labelled share of prompts and of cost per ISO week (A-14)."""
    judged = outcome.select("prompt_id").distinct().withColumn("_judged", F.lit(True))
    rows = (
        prompt.select("prompt_id", "ts", "task_label")
        .join(prompt_cost(cost).select("prompt_id", "cost_usd"), "prompt_id", "left")
        .join(judged, "prompt_id", "left")
    )
    labelled = F.col("task_label").isNotNull()
    spent = nz("cost_usd")
    grouped = rows.groupBy(iso_week("ts", tz).alias("iso_week")).agg(
        F.countDistinct("prompt_id").alias("prompts"),
        F.countDistinct(F.when(labelled, F.col("prompt_id"))).alias("labeled_prompts"),
        F.countDistinct(F.when(F.col("_judged"), F.col("prompt_id"))).alias("outcome_prompts"),
        F.sum(F.when(labelled, spent).otherwise(F.lit(0.0))).alias("labeled_cost_usd"),
        F.sum(spent).alias("total_cost_usd"),
    )
    return (
        grouped.withColumn("coverage_pct", share(F.col("labeled_prompts"), F.col("prompts")))
        .withColumn("outcome_coverage_pct", share(F.col("outcome_prompts"), F.col("prompts")))
        .withColumn("cost_coverage_pct", share(F.col("labeled_cost_usd"), F.col("total_cost_usd")))
    )


def weeks_outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two weekly frames on ``week`` (J-08)."""
    return a.join(b, "week", "full_outer")


def counter_metrics(req: DataFrame, outcome: DataFrame, tz: str) -> DataFrame:
    """Signs of over-optimising per ISO week: interruptions and reverts (A-15)."""
    requests = (
        req.where(F.col("is_synthetic") == 0)
        .groupBy(iso_week("ts", tz).alias("week"))
        .agg(share(F.sum("is_interrupted"), F.count(F.lit(1))).alias("interrupted_rate_pct"))
    )

    def prompts_with(label: str) -> Column:
        return F.countDistinct(F.when(F.col("label") == label, F.col("prompt_id")))

    outcomes = (
        outcome.where(F.col("source") == "auto")
        .groupBy(iso_week("ts", tz).alias("week"))
        .agg(prompts_with("reverted").alias("r"), prompts_with("completed").alias("c"))
    )
    return weeks_outer(requests, outcomes).select(
        "week", "interrupted_rate_pct",
        share(nz("r"), F.col("c")).alias("revert_rate_pct"),
        nz("r").alias("reverted_n"), nz("c").alias("completed_n"),
    )


def task_efficiency(task: DataFrame, task_prompt: DataFrame, cost: DataFrame) -> DataFrame:
    """What each work task took in prompts, agents, requests and money (A-17).

    Requests are reduced per prompt and agent before they meet the tasks.
    """
    per_prompt = cost.where(F.col("prompt_id").isNotNull()).groupBy("prompt_id", "agent_id").agg(
        F.sum("cost_usd").alias("c"), F.count(F.lit(1)).alias("n")
    )
    linked = task_prompt.select("task_id", "prompt_id").join(per_prompt, "prompt_id", "left")
    sums = linked.groupBy("task_id").agg(
        F.countDistinct("prompt_id").alias("n_prompts"),
        F.countDistinct("agent_id").alias("n_agents"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_requests"),
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("cost_usd"),
    )
    out = task.join(sums, "task_id", "left")
    for name in ("n_prompts", "n_agents", "n_requests"):
        out = out.withColumn(name, nz(name))
    return (
        out.withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))
        .withColumn("elapsed_minutes", (micros("ts_end") - micros("ts_start")) / F.lit(60e6))
        .withColumn("cost_per_quality_point", F.col("cost_usd") / F.nullif(F.col("quality_score"), F.lit(0)))
        .withColumn("cost_per_prompt", F.col("cost_usd") / F.nullif(F.col("n_prompts"), F.lit(0)))
    )


def session_gaps(cost: DataFrame, as_of: dt.datetime, hours: int = 48) -> DataFrame:
    """Per session, by how many per cent our cost differs from the client's own estimate."""
    recent = cost.where(
        (F.col("ts") >= F.lit(as_of - dt.timedelta(hours=hours))) & (F.col("cost_usd_sdk") > 0)
    )
    sdk = F.sum("cost_usd_sdk")
    return recent.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("matched_requests"),
        (F.lit(100.0) * (F.sum("cost_usd") - sdk) / sdk).alias("gap_pct"),
    )


def estimator_gap(cost: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Median gap over sessions of the last two days (A-33)."""
    gaps = session_gaps(cost, as_of)
    median = exact_quantiles(gaps, [], "gap_pct", (0.5,), ("value",)).select("value")
    return gaps.agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum("matched_requests"), F.lit(0)).alias("matched_requests"),
    ).withColumn("value", median.scalar())


def _check(df: DataFrame, name: str, status: Column, value: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("check_name"), status.alias("status"),
        value.cast("string").alias("value"), detail.cast("string").alias("detail"),
    )


def _level(x: Column, ok: Column, warn: Column) -> Column:
    return F.when(ok, F.lit("ok")).when(warn, F.lit("warn")).otherwise(F.lit("fail"))


def _age(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    now = int(as_of.timestamp() * 1_000_000)
    return df.agg(
        F.count("ts").alias("n"), ((F.lit(now) - micros(F.max("ts"))) / F.lit(1e6)).alias("age")
    )


def _freshness(df, as_of, name, ok_s, warn_s, detail, skip_empty=False) -> DataFrame:
    age = F.col("age")
    status = _level(age, age < ok_s, age < warn_s)
    if skip_empty:
        status = F.when(F.col("n") == 0, F.lit("skip")).otherwise(status)
    missing = "no events" if skip_empty else "missing"
    value = F.when(age.isNull(), F.lit(missing)).otherwise(F.format_string("%.0f", age))
    return _check(_age(df, as_of), name, status, value, F.lit(detail))


def _names(df: DataFrame, column: str) -> DataFrame:
    """Count and sorted list of distinct names."""
    listed = F.array_join(F.array_sort(F.collect_set(column)), ",")
    return df.agg(F.count(F.lit(1)).alias("n"), listed.alias("names"))


def health_checks(tables: dict[str, DataFrame], as_of: dt.datetime) -> DataFrame:
    """Seventeen checks as rows ``(check_name, status, value, detail)`` (A-35).

    ``tables``: request, cost, prompt, tool_call, agent, hook_event, ingest_log,
    quarantine, nudge, work_task, otel_event, price, price_tool.
    """
    def since(df: DataFrame, days: int, ts: str = "ts") -> DataFrame:
        return df.where(F.col(ts) >= F.lit(as_of - dt.timedelta(days=days)))

    def pct_text(x: Column) -> Column:
        return F.format_string("%.2f%%", x)

    req, cost = tables["request"], tables["cost"]
    checks = [
        _freshness(req, as_of, "ledger_freshness", 1800, 7200, TEXT["ledger_freshness"]),
        _freshness(tables["hook_event"], as_of, "hook_freshness", 1800, 7200, TEXT["hook_freshness"]),
        _freshness(tables["ingest_log"], as_of, "ingest_recent", 900, 3600, TEXT["ingest_recent"]),
        _freshness(tables["otel_event"], as_of, "otel_freshness", 7200, 86_400,
                   TEXT["otel_freshness"], skip_empty=True),
    ]
    bad = since(tables["quarantine"], 7).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("reason", F.struct("ts", "reason")).alias("reason")
    )
    n = F.col("n")
    ok_if_none = F.when(n == 0, F.lit("ok"))
    checks.append(_check(bad, "quarantine_7d", ok_if_none.otherwise(F.lit("fail")), n,
                         F.coalesce("reason", F.lit(TEXT["quarantine_7d"]))))

    def coverage(df: DataFrame, column: str, name: str, detail: str) -> DataFrame:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("k"))
        pct = F.lit(100.0) * F.col("k") / F.nullif(n, F.lit(0))
        status = F.when(n == 0, F.lit("skip")).otherwise(_level(pct, pct >= 98, pct >= 85))
        return _check(row, name, status, F.when(n > 0, F.format_string("%.1f", pct)), F.lit(detail))

    checks.append(coverage(since(req, 7), "end_ts", "request_end_coverage_7d", TEXT["request_end_coverage_7d"]))
    checks.append(coverage(since(tables["tool_call"], 7), "result_ts", "tool_result_coverage_7d",
                           TEXT["tool_result_coverage_7d"]))
    checks.append(_check(_names(unknown_models(req, tables["price"]), "model"), "unknown_models",
                         ok_if_none.otherwise(F.lit("fail")), n,
                         F.coalesce(F.nullif("names", F.lit("")), F.lit("none"))))
    overlaps = union_rows(
        price_overlaps(tables["price"], "model"), price_overlaps(tables["price_tool"], "tool")
    ).agg(F.count(F.lit(1)).alias("n"))
    checks.append(_check(overlaps, "price_range_overlap", ok_if_none.otherwise(F.lit("fail")), n,
                         F.lit(TEXT["price_range_overlap"])))
    checks.append(_check(_names(unpriced_tools(req, tables["price_tool"]), "tool"), "unpriced_server_tools",
                         ok_if_none.otherwise(F.lit("warn")), n,
                         F.coalesce(F.nullif("names", F.lit("")), F.lit("none"))))
    tasks = since(tables["work_task"], 28, "ts_start").agg(
        F.count(F.lit(1)).alias("n"), F.count("outcome").alias("o"), F.count("quality_score").alias("q")
    )
    done = F.lit(100.0) * F.col("o") / F.nullif(n, F.lit(0))
    checks.append(_check(
        tasks, "task_outcome_coverage_28d",
        F.when(n == 0, F.lit("skip")).otherwise(_level(done, done >= 80, done >= 40)),
        F.when(n == 0, F.lit("no tasks")).otherwise(pct_text(done)),
        F.format_string(TEXT["task_outcome_coverage_28d"], n, F.col("q"))))
    gap = estimator_gap(cost, as_of)
    size = F.abs(F.col("value"))
    checks.append(_check(
        gap, "estimator_gap",
        F.when(F.col("samples") == 0, F.lit("skip")).otherwise(_level(size, size <= 10, size <= 20)),
        F.when(F.col("samples") == 0, F.lit("no samples")).otherwise(pct_text(F.col("value"))),
        F.format_string(TEXT["estimator_gap"],
                        F.col("samples"), F.col("matched_requests"))))
    spent = nz("cost_usd")
    recent = since(tables["prompt"], 28).select("prompt_id", "task_label").join(
        prompt_cost(cost).select("prompt_id", "cost_usd"), "prompt_id", "left"
    ).agg(
        F.sum(F.when(F.col("task_label").isNotNull(), spent).otherwise(F.lit(0.0))).alias("labelled"),
        F.sum(spent).alias("total"),
    )
    lab = share(F.col("labelled"), F.col("total"))
    checks.append(_check(
        recent, "label_coverage_cost",
        F.when(lab.isNull(), F.lit("skip")).otherwise(_level(lab, lab >= 80, lab >= 40)),
        F.when(lab.isNull(), F.lit("no cost")).otherwise(pct_text(lab)), F.lit(TEXT["label_coverage_cost"])))
    checks.append(_check(orphan_agents(req, tables["agent"]).agg(F.count(F.lit(1)).alias("n")), "orphan_agents",
                         ok_if_none.otherwise(F.lit("warn")), n, F.lit(TEXT["orphan_agents"])))
    nudges = since(tables["nudge"], 14, "fired_ts").agg(
        F.count("followed").alias("d"), (F.avg("followed") * 100.0).alias("rate"),
        F.count("outcome").alias("c"),
        share(F.count_if(F.col("outcome").isin("followed", "not_followed")), F.count("outcome")).alias("seen"),
    )
    d, c = F.col("d"), F.col("c")
    checks.append(_check(
        nudges, "nudge_conversion_14d",
        F.when(d == 0, F.lit("skip")).when(F.col("rate") >= 10, F.lit("ok")).otherwise(F.lit("warn")),
        F.when(d == 0, F.lit("no decisions")).otherwise(pct_text(F.col("rate"))),
        F.format_string(TEXT["nudge_conversion_14d"], d)))
    seen = F.col("seen")
    checks.append(_check(
        nudges, "nudge_observability_14d",
        F.when(c == 0, F.lit("skip")).otherwise(_level(seen, seen >= 60, seen >= 30)),
        F.when(c == 0, F.lit("no decisions")).otherwise(pct_text(seen)),
        F.format_string(TEXT["nudge_observability_14d"], c)))
    cut = since(req.where(F.col("is_synthetic") == 0), 7).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("is_interrupted") * 100.0).alias("rate")
    )
    rate = F.col("rate")
    checks.append(_check(
        cut, "interrupted_share_7d",
        F.when(n == 0, F.lit("skip")).otherwise(_level(rate, rate < 2, rate < 5)),
        F.when(n == 0, F.lit("no requests")).otherwise(pct_text(rate)), F.format_string(TEXT["interrupted_share_7d"], n)))
    return union_rows(*checks)
