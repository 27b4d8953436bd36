"""Trends over days, weeks and months (A-24 … A-27)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from usageloom.fixed_values import PREMIUM_FAMILIES
from usageloom.functions.quantiles import exact_quantiles
from usageloom.functions.scalar import (
    context_tokens, in_window, is_automatic, local_day, micros, model_family, nz, share,
)
from usageloom.model import Window
from usageloom.operators.pricing import component_usd, join_project
from usageloom.operators.rollups import top_k_others, union_rows
from usageloom.operators.temporal import with_previous

GRAINS = ("daily", "weekly", "monthly")
FEES = ("cache_read", "cache_w5m", "cache_w1h", "input", "output", "server_tool")
RESUME_GAP_S = 3600
MIN_DAILY = 20
LARGE_CONTEXT = 200_000
HIGH_REQUESTS = 20


def period_start(day: Column, grain: str) -> Column:
    if grain == "daily":
        return day
    return F.trunc(day, "week" if grain == "weekly" else "month")


def all_grains(day: Column) -> Column:
    """Array of (grain, period) a local day belongs to; explode it for one pass over all grains."""
    return F.array(
        *[F.struct(F.lit(g).alias("grain"), period_start(day, g).alias("period")) for g in GRAINS]
    )


def _spine(series: DataFrame, w: Window) -> DataFrame:
    days = F.sequence(F.lit(w.start), F.lit(w.end), F.expr("INTERVAL 1 DAY"))
    return series.select("series", F.explode(days).alias("day"))


def trend_series(
    cost: DataFrame, session: DataFrame, w: Window, tz: str, axis: str, grain: str = "daily",
    top: int = 6,
) -> DataFrame:
    """Zero-filled cost series by fee, model family or project (A-24)."""
    scoped = cost.where(in_window("ts", w, tz))
    day = local_day("ts", tz).alias("day")
    if axis == "fee":
        parts = component_usd()
        sums = scoped.groupBy(day).agg(
            *[F.coalesce(F.sum(parts[n]), F.lit(0.0)).alias(n) for n in FEES]
        )
        values = sums.unpivot(["day"], list(FEES), "series", "usd")
    elif axis == "model":
        values = scoped.groupBy(day, model_family("model").alias("series")).agg(
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("usd")
        )
    elif axis == "project":
        daily = scoped.groupBy("session_id", day).agg(F.sum("cost_usd").alias("c"))
        daily = join_project(daily, session, "left").groupBy("project", "day").agg(
            F.coalesce(F.sum("c"), F.lit(0.0)).alias("usd")
        )
        totals = daily.groupBy("project").agg(F.sum("usd").alias("total"))
        labels = top_k_others(totals, "project", "total", top).select(
            F.col("project").alias("_project"), F.col("label").alias("series")
        )
        values = daily.join(labels, F.col("project").eqNullSafe(F.col("_project"))).select(
            "day", "series", "usd"
        )
    else:
        raise ValueError(f"unknown axis: {axis}")
    grouped = values.groupBy("series", period_start(F.col("day"), grain).alias("period")).agg(
        F.sum("usd").alias("usd")
    )
    spine = _spine(values.select("series").distinct(), w).select(
        "series", period_start(F.col("day"), grain).alias("period")
    ).distinct()
    return spine.join(grouped, ["series", "period"], "left").select(
        "period", "series", nz("usd").alias("usd")
    )


def _prompt_days(cost: DataFrame, session: DataFrame, tz: str) -> DataFrame:
    """Requests reduced to one row per local day, session and prompt, with project."""
    main_ctx = F.when(F.col("agent_id").isNull(), context_tokens())
    family = model_family("model")
    tokens = context_tokens() + nz("output_tok")
    spent = nz("cost_usd")
    reduced = cost.groupBy(local_day("ts", tz).alias("day"), "session_id", "prompt_id").agg(
        F.sum(spent).alias("usd"),
        F.count(F.lit(1)).alias("n_requests"),
        F.max("is_interrupted").alias("interrupted"),
        F.min(micros("ts")).alias("first_us"),
        F.max(micros("ts")).alias("last_us"),
        F.max(main_ctx).alias("peak"),
        F.sum(F.when(F.col("agent_id").isNotNull(), spent).otherwise(F.lit(0.0))).alias("delegated"),
        F.sum(F.when(family.isin(*PREMIUM_FAMILIES), spent).otherwise(F.lit(0.0))).alias("premium"),
        F.count_if(F.col("cost_usd").isNull()).alias("unknown"),
        F.sum(tokens).alias("tokens"),
    )
    return join_project(reduced, session, "inner").withColumn("automatic", is_automatic("project"))


def _grain_prompts(days: DataFrame) -> DataFrame:
    """One row per grain, period and prompt."""
    return (
        days.where(F.col("prompt_id").isNotNull())
        .withColumn("g", F.explode(all_grains(F.col("day"))))
        .groupBy(F.col("g.grain").alias("grain"), F.col("g.period").alias("period"), "prompt_id")
        .agg(
            F.sum("usd").alias("usd"),
            F.sum("n_requests").alias("n_requests"),
            F.max("interrupted").alias("interrupted"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.max("peak").alias("peak"),
            F.max("automatic").alias("automatic"),
        )
    )


def trend_distribution(
    cost: DataFrame, session: DataFrame, tz: str, min_n: int = MIN_DAILY
) -> DataFrame:
    """Quantiles of cost, peak context and span of people's prompts per period (A-25).

    Days with fewer than ``min_n`` prompts are too unstable and stay NULL.
    """
    prompts = _grain_prompts(_prompt_days(cost, session, tz)).where(~F.col("automatic"))
    measures = F.array(
        F.struct(F.lit("cost_usd").alias("measure"), F.col("usd").alias("value")),
        F.struct(
            F.lit("context_k").alias("measure"),
            F.when(F.col("peak") > 0, F.col("peak") / F.lit(1000.0)).alias("value"),
        ),
        F.struct(
            F.lit("span_min").alias("measure"),
            ((F.col("last_us") - F.col("first_us")) / F.lit(60e6)).alias("value"),
        ),
    )
    rows = prompts.select("grain", "period", F.explode(measures).alias("m")).select(
        "grain", "period", "m.measure", "m.value"
    )
    keys = ["grain", "period", "measure"]
    found = exact_quantiles(rows, keys, "value", (0.5, 0.9, 0.95), ("p50", "p90", "p95"))
    counts = prompts.groupBy("grain", "period").agg(
        F.count(F.lit(1)).alias("n_prompts"), F.avg("usd").alias("mean_usd")
    )
    stable = (F.col("grain") != "daily") | (F.col("n_prompts") >= min_n)
    return found.join(counts, ["grain", "period"]).select(
        *keys, "n_prompts",
        F.when(stable & (F.col("measure") == "cost_usd"), F.col("mean_usd")).alias("mean"),
        *[F.when(stable, F.col(p)).alias(p) for p in ("p50", "p90")],
        F.when(stable & (F.col("measure") != "context_k"), F.col("p95")).alias("p95"),
    )


def resume_gaps(cost: DataFrame, gap_s: int = RESUME_GAP_S) -> DataFrame:
    """Main-thread requests more than ``gap_s`` after the one before in the session (W-03)."""
    main = cost.where(F.col("agent_id").isNull()).select("session_id", "request_id", "ts")
    seq = with_previous(main, "session_id", micros("ts"), "request_id", ("ts",))
    gap = (micros("ts") - micros("prev.ts")) / F.lit(1e6)
    return seq.select("session_id", "request_id", "ts", gap.alias("gap_s")).where(
        F.col("gap_s") > gap_s
    )


def trend_events(
    cost: DataFrame, session: DataFrame, breaks: DataFrame, w: Window, tz: str
) -> DataFrame:
    """Resumed sessions, interrupted prompts and compactions per period (A-26)."""
    inside = in_window("ts", w, tz)

    def per_period(events: DataFrame, name: str) -> DataFrame:
        daily = events.groupBy(local_day("ts", tz).alias("day")).agg(F.count(F.lit(1)).alias("n"))
        return daily.select(F.explode(all_grains(F.col("day"))).alias("g"), "n").select(
            "g.grain", "g.period", F.lit(name).alias("event"), "n"
        )

    resumed = resume_gaps(cost).where(inside)
    compacted = breaks.where((F.col("cause") == "compaction") & inside)
    prompts = _grain_prompts(_prompt_days(cost.where(inside), session, tz))
    interrupted = prompts.select(
        "grain", "period", F.lit("interrupted").alias("event"),
        F.col("interrupted").cast("bigint").alias("n"),
    )
    rows = union_rows(per_period(resumed, "resumed"), per_period(compacted, "compaction"), interrupted)
    return (
        rows.groupBy("grain", "period")
        .pivot("event", ["resumed", "interrupted", "compaction"])
        .agg(F.sum("n"))
        .na.fill(0)
    )


def _periods(cost: DataFrame, w: Window) -> DataFrame:
    """Each period of the window with its predecessor and the days elapsed so far.

    A period that contains the end of the window is compared on its elapsed days only.
    """
    spark = cost.sparkSession
    days = F.sequence(F.lit(w.start), F.lit(w.end), F.expr("INTERVAL 1 DAY"))
    periods = (
        spark.range(1).select(F.explode(days).alias("day"))
        .select(F.explode(all_grains(F.col("day"))).alias("g"))
        .select("g.grain", "g.period").distinct()
    )
    end = F.lit(w.end)
    length = (
        F.when(F.col("grain") == "daily", F.lit(1))
        .when(F.col("grain") == "weekly", F.lit(7))
        .otherwise(F.day(F.last_day("period")))
    )
    before = (
        F.when(F.col("grain") == "daily", F.date_sub("period", 1))
        .when(F.col("grain") == "weekly", F.date_sub("period", 7))
        .otherwise(F.add_months("period", F.lit(-1)))
    )
    return (
        periods.withColumn("length", length)
        .withColumn("previous", before)
        .withColumn("elapsed", F.least(F.col("length"), F.datediff(end, "period") + 1))
    )


def period_change(
    cost: DataFrame, session: DataFrame, w: Window, tz: str, as_of: dt.date,
    measured_from: dt.date | None = None,
) -> DataFrame:
    """Elapsed-aligned change against the period before, and what the period was made of (A-27).

    ``as_of`` is today: days not over yet are not compared.  ``measured_from`` is
    the first day with data (by default taken from ``cost``).
    """
    days = _prompt_days(cost.where(in_window("ts", w, tz)), session, tz)
    daily = days.groupBy("day", "project").agg(F.sum("usd").alias("usd"))
    measured = (
        F.lit(measured_from) if measured_from else cost.agg(F.min(local_day("ts", tz))).scalar()
    )
    periods = _periods(cost, w).withColumn("measured_from", measured)

    offsets = periods.select(
        "grain", "period", "previous",
        F.explode(F.sequence(F.lit(0), F.col("elapsed") - 1)).alias("i"),
    )
    roles = offsets.select(
        "grain", "period",
        F.explode(
            F.array(
                F.struct(F.date_add("period", F.col("i")).alias("day"), F.lit(1.0).alias("now")),
                F.struct(F.date_add("previous", F.col("i")).alias("day"), F.lit(0.0).alias("now")),
            )
        ).alias("r"),
    ).select("grain", "period", "r.day", "r.now")
    keys = ["grain", "period"]
    by_project = roles.join(daily, "day").groupBy(*keys, "project").agg(
        F.sum(F.col("usd") * F.col("now")).alias("cur"),
        F.sum(F.col("usd") * (1 - F.col("now"))).alias("old"),
    )
    totals = by_project.groupBy(*keys).agg(
        F.sum("cur").alias("aligned_usd"), F.sum("old").alias("previous_usd")
    )
    delta = F.col("cur") - F.col("old")
    same = delta * (F.col("aligned_usd") - F.col("previous_usd")) > 0
    weight = F.when(same, F.struct(F.abs(delta).alias("d"), F.coalesce("project", F.lit("")).alias("p")))
    drivers = by_project.join(totals, keys).groupBy(*keys).agg(
        F.max("aligned_usd").alias("aligned_usd"),
        F.max("previous_usd").alias("previous_usd"),
        F.max_by("project", weight).alias("driver"),
        F.max_by(delta, weight).alias("driver_delta_usd"),
    )
    whole = (
        days.withColumn("g", F.explode(all_grains(F.col("day"))))
        .groupBy("g.grain", "g.period")
        .agg(
            F.sum("usd").alias("total_usd"),
            F.countDistinct("day").alias("active_days"),
            share(F.sum("delegated"), F.sum("usd")).alias("delegated_pct"),
            share(F.sum("premium"), F.sum("usd")).alias("premium_pct"),
            F.sum("unknown").alias("unknown_cost_requests"),
            (
                F.sum(F.when(~F.col("automatic"), F.col("usd")))
                / F.nullif(F.sum(F.when(~F.col("automatic"), F.col("tokens"))), F.lit(0))
                * F.lit(1e6)
            ).alias("blended_usd_per_mtok"),
        )
    )
    per_prompt = _grain_prompts(days).groupBy(*keys).agg(
        F.count_if(~F.col("automatic")).alias("interactive_prompts"),
        share(
            F.sum(F.when(F.col("peak") >= LARGE_CONTEXT, F.col("usd")).otherwise(F.lit(0.0))),
            F.sum("usd"),
        ).alias("large_context_pct"),
        F.count_if(~F.col("automatic") & (F.col("n_requests") >= HIGH_REQUESTS)).alias("high_request_prompts"),
    )
    today = F.lit(as_of)
    comparable = (F.col("previous") >= F.col("measured_from")) & ~(
        (F.col("grain") == "daily") & (F.col("period") >= today)
    )
    change = F.when(
        comparable & (F.col("previous_usd") != 0),
        (F.col("aligned_usd") / F.col("previous_usd") - 1) * 100,
    )
    return (
        periods.join(whole, keys)
        .join(drivers, keys, "left")
        .join(per_prompt, keys, "left")
        .select(
            *keys, "total_usd", "aligned_usd", "previous_usd", change.alias("change_pct"),
            "active_days", F.col("length").alias("period_days"), "driver", "driver_delta_usd",
            nz("interactive_prompts").alias("interactive_prompts"), "delegated_pct", "premium_pct",
            "large_context_pct", "blended_usd_per_mtok",
            nz("high_request_prompts").alias("high_request_prompts"), "unknown_cost_requests",
        )
    )


def _count_up_to(points: DataFrame, asked: DataFrame, at: str, inclusive: bool, name: str) -> DataFrame:
    """Add to ``asked`` how many ``points`` (us, n) lie before its column ``at`` (or at it, if ``inclusive``).

    Both go into hours: inside an hour a running sum, before it the sum of the
    hours so far.  The only frame that is summed without a key has one row per hour.
    """
    from pyspark.sql import Window as W

    hour = F.floor(F.col("us") / 3_600_000_000)
    mine = asked.select(F.col(at).alias("us"), F.lit(0).cast("long").alias("n"), F.struct(*asked.columns).alias("asked"))
    grouped = points.groupBy("us").agg(F.sum("n").cast("long").alias("n"))  # equal instants count as one row
    rows = grouped.withColumn("asked", F.lit(None).cast(mine.schema["asked"].dataType)).unionByName(mine).withColumn("hour", hour)
    order = W.partitionBy("hour").orderBy("us", F.col("asked").isNull().cast("int") * (-1 if inclusive else 1))
    inside = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    hours = grouped.groupBy(hour.alias("hour")).agg(F.sum("n").alias("n"))
    asked_hours = mine.select(hour.alias("hour"), "n").distinct()
    so_far = hours.union(asked_hours).groupBy("hour").agg(F.sum("n").alias("n")).select(
        "hour", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counted = rows.withColumn("inside", inside).where(F.col("asked").isNotNull()).join(so_far, "hour")
    return counted.select("asked.*", (F.col("inside") + F.col("before")).alias(name))


def marker_overlap(marker: DataFrame, w: Window, tz: str, days: int = 7) -> DataFrame:
    """Markers of the period whose after-window another marker disturbs (J-09).

    The after-window ends ``days`` after the start, at the marker's end or with the
    period.  Another one disturbs it by starting before the after-window closes and
    ending after it began.  Of those that start in time, the ones that had ended by
    then are subtracted (they all start in time, but for one of no length that
    starts where an empty after-window lies): two counts, no pairs.
    """
    lo, hi = w.instants(tz)
    top = F.lit(hi)
    rows = (
        marker.where((F.col("ts_start") < top) & (F.coalesce("ts_end", top) >= F.lit(lo)))
        .withColumn("start_us", micros("ts_start"))
        .withColumn("end_us", micros(F.coalesce("ts_end", top)))
        .withColumn("after_end", F.least(F.coalesce("ts_end", top), F.col("ts_start") + F.expr(f"INTERVAL {days} DAYS"), top))
        .withColumn("after_us", micros("after_end"))
        .select("marker_id", "category", "ts_start", "after_end", "start_us", "end_us", "after_us")
    )
    one = F.lit(1)
    starts = rows.select(F.col("start_us").alias("us"), one.alias("n"))
    ends = rows.select(F.col("end_us").alias("us"), one.alias("n"))
    points = rows.where("start_us = end_us").groupBy("start_us").agg(F.count(one).alias("same"))
    counted = _count_up_to(ends, _count_up_to(starts, rows, "after_us", False, "started"), "start_us", True, "ended")
    counted = counted.join(points, "start_us", "left")
    ended = F.col("ended") - F.when(F.col("after_us") <= F.col("start_us"), F.coalesce("same", F.lit(0))).otherwise(0)
    itself = ((F.col("start_us") < F.col("after_us")) & (F.col("end_us") > F.col("start_us"))).cast("int")
    return counted.select(
        "marker_id", "category", "ts_start", "after_end",
        F.greatest(F.lit(0.0), (F.col("after_us") - F.col("start_us")) / F.lit(86_400e6)).alias("elapsed_days"),
        (F.col("started") - ended - itself > 0).cast("int").alias("overlaps"),
    )
