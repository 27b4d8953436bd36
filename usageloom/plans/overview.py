"""Overview: the whole dashboard page as a set of small frames (A-28, A-37)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from usageloom.functions.scalar import in_window, local_day
from usageloom.model import Page, Window
from usageloom.operators import cache as C, rollups as A
from usageloom.plans.period import top_prompts

KPIS = ("cost_usd", "prompt_count", "request_count", "session_count", "project_count")
CONTEXT_DAYS = 31


def context_window(w: Window, today: dt.date) -> tuple[dt.date, dt.date]:
    """31 days around the middle of the selection, shifted left where they would pass today."""
    middle = w.start + dt.timedelta(days=(w.end - w.start).days // 2)
    end = min(today, middle + dt.timedelta(days=CONTEXT_DAYS // 2))
    return end - dt.timedelta(days=CONTEXT_DAYS - 1), end


def percent_change(current: Column, previous: Column) -> Column:
    """NULL when there is nothing to compare with."""
    return F.when(previous != 0, (current - previous) / previous * 100)


def kpis(cost: DataFrame, session: DataFrame, w: Window, tz: str) -> DataFrame:
    """Totals of the period and the one before from a single scan (A-28)."""
    both = cost.where(in_window("ts", Window(w.previous().start, w.end), tz))
    period = F.when(in_window("ts", w, tz), F.lit("current")).otherwise(F.lit("previous"))
    reduced = both.groupBy(period.alias("period"), "session_id", "prompt_id").agg(
        F.sum("cost_usd").alias("c"),
        F.count(F.lit(1)).alias("n"),
        A.unknown_count().alias("u"),
    )
    known = A.join_project(reduced, session, "left")
    if w.project is not None:
        known = known.where(F.col("project") == w.project)
    rows = known.groupBy("period").agg(
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("cost_usd"),
        F.countDistinct("prompt_id").alias("prompt_count"),
        F.sum("n").alias("request_count"),
        F.countDistinct("session_id").alias("session_count"),
        F.countDistinct("project").alias("project_count"),
        F.sum("u").alias("unknown_cost_request_count"),
    )
    long = rows.select(
        "period", *[F.col(c).cast("double").alias(c) for c in (*KPIS, "unknown_cost_request_count")]
    ).unpivot(["period"], [*KPIS, "unknown_cost_request_count"], "kpi", "value")

    def of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("period") == name, F.col("value"))), F.lit(0.0))

    return long.groupBy("kpi").agg(of("current").alias("current"), of("previous").alias("previous")).withColumn(
        "change_pct", percent_change(F.col("current"), F.col("previous"))
    )


def overview(
    cost: DataFrame, session: DataFrame, prompt: DataFrame, breaks: DataFrame, w: Window,
    tz: str, today: dt.date, page: Page | None = None,
) -> dict[str, DataFrame]:
    """Frames of the overview page; ``breaks`` carries ``cache_write_usd``."""
    current = A.period_filter(cost, w, tz, session)
    scope = cost
    if w.project is not None:
        scope = cost.join(
            session.where(F.col("project") == w.project).select("session_id"), "session_id", "left_semi"
        )
    start, end = context_window(w, today)
    selected = (F.col("day") >= F.lit(w.start)) & (F.col("day") <= F.lit(w.end))
    sessions = A.session_rollup(current, session)
    ties = [F.desc("session_id")]
    known = session.select("session_id")
    rebuilds = A.period_filter(breaks, w, tz, session).join(known, "session_id", "left_semi")
    limit = 40 if page is None else page.limit
    return {
        "kpis": kpis(cost, session, w, tz),
        "daily": A.spine_costs(scope, start, end, tz).withColumn("selected", selected.cast("int")),
        "components": A.cost_components(current),
        "top_prompts": top_prompts(current, session, prompt, limit),
        "top_sessions": A.top_n(sessions, "cost_usd", ties, limit) if page is None
        else A.page(sessions, "cost_usd", ties, page),
        "rebuilds": C.rebuild_by_cause(rebuilds),
    }


def value_snapshot(cost: DataFrame, session: DataFrame, prompt: DataFrame, tz: str) -> DataFrame:
    """Totals without identifiers for the latest day, the latest seven days and all time (A-37).

    One pass over the requests: each is reduced per day, session and prompt, and
    then counted in every window that contains its day.
    """
    day = local_day("ts", tz)
    latest = cost.agg(F.max(day)).scalar()

    def windows() -> Column:
        return F.filter(
            F.array(
                F.when(F.col("day") == F.col("latest"), F.lit("latest_day")),
                F.when(
                    (F.col("day") > F.date_sub("latest", 7)) & (F.col("day") <= F.col("latest")),
                    F.lit("latest_7_days"),
                ),
                F.lit("all_observed"),
            ),
            lambda x: x.isNotNull(),
        )

    reduced = cost.groupBy(day.alias("day"), "session_id", "prompt_id").agg(
        F.sum("cost_usd").alias("c"), F.count(F.lit(1)).alias("n"), A.unknown_count().alias("u")
    )
    requests = (
        A.join_project(reduced, session, "left")
        .withColumn("latest", latest)
        .withColumn("window", F.explode(windows()))
        .groupBy("window")
        .agg(
            F.coalesce(F.sum("c"), F.lit(0.0)).alias("total_usd"),
            F.sum("n").alias("request_count"),
            F.countDistinct("prompt_id").alias("cost_bearing_prompt_count"),
            F.countDistinct("session_id").alias("session_count"),
            F.countDistinct("project").alias("project_count"),
            F.sum("u").alias("unknown_cost_request_count"),
        )
    )
    prompts = (
        prompt.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("latest", latest)
        .withColumn("window", F.explode(windows()))
        .groupBy("window").agg(F.sum("n").alias("prompt_table_rows"))
    )
    return requests.join(prompts, "window", "left").withColumn(
        "prompt_table_rows", F.coalesce("prompt_table_rows", F.lit(0))
    )
