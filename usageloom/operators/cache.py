"""Prompt-cache diagnosis: identity breaks, their causes and what they cost."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from usageloom.fixed_values import CAUSES
from usageloom.functions.scalar import local_day, micros, model_family, nz, share
from usageloom.operators.pricing import join_project
from usageloom.operators.temporal import (
    latest_per_channel, with_previous_and_seen, with_seen_within,
)

SECOND_US = 1_000_000
TOLERANCE_TOK = 16
HOUR_S, FIVE_MINUTES_S, COMPACTION_SLACK_S = 3600, 300, 600
COMPACTION_KINDS = ("PreCompact", "PostCompact")


def exists_hook_near(
    rows: DataFrame, hooks: DataFrame, kinds: tuple[str, ...], low_us: Column, at_us: Column,
    after_us: int, name: str,
) -> DataFrame:
    """Flag rows with a hook event of the same session in ``[low, at + after]`` (J-04).

    Such an event exists exactly if the latest one up to the upper bound is not
    earlier than ``low``: an as-of lookup, which forms no pairs.
    """
    wanted = hooks.where(F.col("kind").isin(*kinds))
    found = latest_per_channel(
        rows.withColumn("_low", low_us).withColumn("_at", at_us), wanted, "session_id",
        F.col("_at"), micros("ts") - after_us, {"_hook_us": micros("ts")},
    )
    hit = F.coalesce(F.col("_hook_us") >= F.col("_low"), F.lit(False))
    return found.withColumn(name, hit.cast("int")).drop("_low", "_at", "_hook_us")


def anti_live_1h(req: DataFrame) -> DataFrame:
    """``live_1h``: a one-hour cache write less than an hour ago on this lineage (J-05)."""
    out = with_seen_within(
        req, "lineage_id", micros("ts"), F.col("cache_w1h_tok") > 0, HOUR_S * SECOND_US, "_live"
    )
    return out.withColumn("live_1h", F.col("_live").cast("int")).drop("_live")


def cache_identity(
    req: DataFrame, hooks: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Requests whose cache read is not what the request before left behind, with cause (W-01).

    Causes in order of precedence: interruption, compaction, model switch,
    configuration change, expiry, unknown.  ``keep`` names further columns of
    ``req`` to pass through, so that a priced frame needs no join afterwards.
    """
    usable = (
        req.where((F.col("is_synthetic") == 0) & (F.col("source") == "transcript"))
        .withColumn("cc", F.col("cache_w5m_tok") + F.col("cache_w1h_tok"))
        .select(
            "lineage_id", "session_id", "request_id", "ts", "end_ts", "model", "is_interrupted",
            "cache_read_tok", "cc", "input_tok", "cache_w5m_tok", "cache_w1h_tok", *keep,
        )
    )
    lagged = (
        "cache_read_tok", "cc", "cache_w5m_tok", "cache_w1h_tok", "input_tok", "model", "ts",
        "end_ts", "is_interrupted",
    )
    seq = with_previous_and_seen(
        usable, "lineage_id", micros("ts"), "request_id", lagged, F.col("cache_w1h_tok") > 0,
        HOUR_S * SECOND_US,
    )
    left = F.col("prev.cache_read_tok") + F.col("prev.cc")
    breaks = seq.where(
        F.col("prev.cache_read_tok").isNotNull()
        & (F.abs(F.col("cache_read_tok") - left) > nz("prev.input_tok") + TOLERANCE_TOK)
    )
    # Compaction counts until some minutes after the request: its events are looked up earlier.
    slack = COMPACTION_SLACK_S * SECOND_US
    compaction = F.col("kind").isin(*COMPACTION_KINDS)
    hook_us = micros("ts")
    breaks = latest_per_channel(
        breaks,
        hooks.where(compaction | (F.col("kind") == "SessionStart")),
        "session_id", micros("ts"), F.when(compaction, hook_us - slack).otherwise(hook_us),
        {
            "_compacted_us": F.when(compaction, hook_us),
            "_started_us": F.when(~compaction, hook_us),
        },
    )
    compacted = F.coalesce(F.col("_compacted_us") >= micros("prev.ts") - slack, F.lit(False))
    restarted = F.coalesce(F.col("_started_us") >= micros("prev.ts"), F.lit(False))
    idle_us = micros("ts") - micros("prev.ts")
    short_lived = (
        (F.col("prev.cache_w5m_tok") > 0)
        & (F.col("prev.cache_w1h_tok") == 0)
        & (micros("ts") - micros("prev.end_ts") > FIVE_MINUTES_S * SECOND_US)
        & (F.col("cache_read_tok") < left * F.lit(0.1))
        & ~F.col("seen")
    )
    cause = (
        F.when(F.col("prev.is_interrupted") == 1, F.lit("interruption"))
        .when(compacted, F.lit("compaction"))
        .when(F.col("model") != F.col("prev.model"), F.lit("model_switch"))
        .when(restarted, F.lit("config_change"))
        .when((idle_us > HOUR_S * SECOND_US) | short_lived, F.lit("ttl_expiry"))
        .otherwise(F.lit("unknown"))
    )
    return breaks.select(
        "lineage_id", "session_id", "request_id", "ts",
        (F.col("cache_read_tok") - left).alias("gap"),
        cause.alias("cause"),
        (idle_us / F.lit(1e6)).alias("gap_seconds"),
        *keep,
    )


def priced_breaks(breaks: DataFrame, cost: DataFrame, session: DataFrame | None = None) -> DataFrame:
    """Breaks with the money spent on rewriting the cache; with ``session`` known ones only.

    Breaks found on a priced frame with ``keep=("cache_write_usd",)`` have it already.
    """
    out = breaks
    if "cache_write_usd" not in breaks.columns:
        out = breaks.join(cost.select("request_id", "cache_write_usd"), "request_id")
    return out if session is None else join_project(out, session, "inner")


def rebuild_by_cause(priced: DataFrame) -> DataFrame:
    """Breaks and rewrite cost per cause (A-18)."""
    return priced.groupBy("cause").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.coalesce(F.sum("cache_write_usd"), F.lit(0.0)).alias("cost_usd"),
    )


def break_class() -> Column:
    """growth: more was read than expected; idle: lost after a pause; active: lost at work."""
    return (
        F.when(F.col("gap") > 0, F.lit("growth"))
        .when(F.col("gap_seconds") >= FIVE_MINUTES_S, F.lit("idle"))
        .otherwise(F.lit("active"))
    )


def cache_rebuild_daily(priced: DataFrame, tz: str) -> DataFrame:
    """Per day and class one count and cost column for each cause (A-18)."""
    return (
        priced.groupBy(local_day("ts", tz).alias("day"), break_class().alias("class"))
        .pivot("cause", list(CAUSES))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("cache_write_usd"), F.lit(0.0)).alias("usd"),
        )
        .na.fill(0)
    )


def _cache_money() -> dict[str, Column]:
    unit = F.col("in_usd") * F.col("price_factor") / F.lit(1e6)
    return {
        "read_usd": F.col("cache_read_tok") * unit * F.col("cache_read_x"),
        "w5m_usd": F.col("cache_w5m_tok") * unit * F.col("cache_w5m_x"),
        "w1h_usd": F.col("cache_w1h_tok") * unit * F.col("cache_w1h_x"),
        "saving_usd": F.col("cache_read_tok") * unit * (F.lit(1.0) - F.col("cache_read_x")),
    }


def cache_balance(cost: DataFrame) -> DataFrame:
    """What reading from the cache saved against what writing it cost (A-20)."""
    money = {n: F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in _cache_money().items()}
    row = cost.agg(
        *money.values(),
        F.sum(nz("cache_read_tok")).alias("read_tok"),
        F.sum(nz("cache_w5m_tok") + nz("cache_w1h_tok")).alias("write_tok"),
        F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost_requests"),
    )
    write = F.col("w5m_usd") + F.col("w1h_usd")
    return row.select(
        "read_usd", write.alias("write_usd"), "saving_usd", "read_tok", "write_tok",
        F.coalesce(F.col("read_tok") / F.nullif(F.col("write_tok"), F.lit(0)), F.lit(0.0)).alias(
            "read_write_ratio"
        ),
        F.greatest(F.lit(0.0), write - F.col("saving_usd")).alias("unoffset_write_usd"),
        "unknown_cost_requests",
    )


def cache_balance_daily(cost: DataFrame, tz: str) -> DataFrame:
    """Read and write cost per local day (A-20)."""
    money = [F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in _cache_money().items()]
    return cost.groupBy(local_day("ts", tz).alias("day")).agg(*money)


def _top_causes(breaks: DataFrame, k: int = 2) -> DataFrame:
    """Text of the ``k`` most frequent causes per session; there are six causes at most."""
    order = W.partitionBy("session_id").orderBy(F.desc("n"), F.asc("cause"))
    ranked = (
        breaks.groupBy("session_id", "cause").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= k)
    )
    entry = F.struct("rn", F.concat_ws(" ", "cause", F.col("n").cast("string")).alias("t"))
    return ranked.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), ", ")
        .alias("causes")
    )


def cache_sessions(
    cost: DataFrame, breaks: DataFrame, session: DataFrame, top: int = 15
) -> DataFrame:
    """Sessions that wrote most to the cache, with hit rate, model mix and causes (A-19)."""
    money = _cache_money()
    side = (
        nz("input_tok") + nz("cache_read_tok") + nz("cache_w5m_tok") + nz("cache_w1h_tok")
    )
    by_model = cost.groupBy("session_id", "model").agg(
        *[F.coalesce(F.sum(money[n]), F.lit(0.0)).alias(n) for n in ("read_usd", "w5m_usd", "w1h_usd")],
        F.sum(nz("cache_read_tok")).alias("read_tok"),
        F.sum(side).alias("side_tok"),
        F.sum(nz("output_tok")).alias("output_tok"),
        F.sum("cost_usd").alias("cost_usd"),
    )
    best = F.max_by("model", F.struct(F.col("side_tok"), F.lower(F.coalesce("model", F.lit("")))))
    grouped = by_model.groupBy("session_id").agg(
        *[F.sum(n).alias(n) for n in ("read_usd", "w5m_usd", "w1h_usd", "read_tok", "side_tok", "output_tok")],
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        best.alias("main_model"),
        F.max("side_tok").alias("main_tok"),
    )
    known = join_project(grouped, session, "inner").withColumn(
        "write_usd", F.col("w5m_usd") + F.col("w1h_usd")
    )
    winners = F.broadcast(
        known.orderBy(F.desc("write_usd"), F.asc("session_id")).limit(top)
    )
    causes = _top_causes(breaks.join(winners.select("session_id"), "session_id", "left_semi"))
    side_tok = F.nullif(F.col("side_tok").cast("double"), F.lit(0.0))
    hit = F.coalesce(F.col("read_tok") / side_tok, F.lit(0.0))
    mixed = F.coalesce(F.col("main_tok") / side_tok, F.lit(0.0)) < 0.9
    tokens = F.nullif((F.col("side_tok") + F.col("output_tok")).cast("double"), F.lit(0.0))
    return winners.join(causes, "session_id", "left").select(
        "session_id", "project", "causes", "w5m_usd", "w1h_usd", "write_usd", "read_usd",
        hit.alias("hit_ratio"),
        model_family("main_model").alias("main_family"),
        mixed.cast("int").alias("mixed"),
        F.coalesce(F.col("cost_usd") / tokens * F.lit(1e6), F.lit(0.0)).alias("blended_usd_per_mtok"),
        "cost_usd",
        (~mixed & (hit < 0.9) & (F.col("cost_usd") >= 1)).cast("int").alias("highlight"),
    )


def top_losses(priced: DataFrame, n: int = 15) -> DataFrame:
    """Costliest cache losses (K-03)."""
    lost = priced.where(nz("gap") <= 0).withColumn("rebuild_usd", nz("cache_write_usd"))
    return (
        lost.orderBy(F.desc("rebuild_usd"), F.asc("request_id")).limit(n)
        .select(
            F.when(F.col("gap_seconds") >= FIVE_MINUTES_S, F.lit("idle"))
            .otherwise(F.lit("active")).alias("class"),
            "session_id", "project", "cause", "gap_seconds",
            (-nz("gap")).alias("lost_tok"), "rebuild_usd", "request_id",
        )
    )


def ttl_review(
    cost: DataFrame, breaks: DataFrame, as_of: dt.datetime, days: int, tz: str
) -> DataFrame:
    """Whether cache expiry costs enough to keep experimenting with it (A-32)."""
    start = F.lit(as_of - dt.timedelta(days=days))
    recent = cost.where(F.col("ts") >= start)
    evidence = recent.agg(
        F.countDistinct(local_day("ts", tz)).alias("active_days"),
        F.coalesce(
            F.datediff(F.max(local_day("ts", tz)), F.min(local_day("ts", tz))) + 1, F.lit(0)
        ).alias("evidence_span_days"),
        F.coalesce(F.sum("cache_write_usd"), F.lit(0.0)).alias("all_cache_write_usd"),
    )
    expired = breaks.where((F.col("ts") >= start) & (F.col("cause") == "ttl_expiry"))
    expiry = priced_breaks(expired, cost).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("cache_write_usd"), F.lit(0.0)).alias("usd"),
    )
    row = evidence.withColumn("ttl_expiry_events", expiry.select("n").scalar()).withColumn(
        "ttl_expiry_rebuild_usd", expiry.select("usd").scalar()
    )
    need = min(days, 28)
    pct = share(F.col("ttl_expiry_rebuild_usd"), F.col("all_cache_write_usd"))
    per_day = F.coalesce(
        F.col("ttl_expiry_rebuild_usd") / F.nullif(F.col("evidence_span_days"), F.lit(0)), F.lit(0.0)
    )
    return (
        row.withColumn("ttl_share_pct", pct)
        .withColumn("avoidable_usd_per_calendar_day", per_day)
        .withColumn(
            "decision",
            F.when(
                (F.col("evidence_span_days") < need) | (F.col("active_days") < 10),
                F.lit("insufficient_data"),
            )
            .when(
                (F.col("avoidable_usd_per_calendar_day") < 5.0) | (F.col("ttl_share_pct") < 10.0),
                F.lit("deprioritize"),
            )
            .otherwise(F.lit("continue_experiment")),
        )
    )


def repeat_expiry(breaks: DataFrame, session: DataFrame, end: dt.datetime) -> DataFrame:
    """The project hit most often by expiry and its number of expiries in four weeks (A-18)."""
    expired = join_project(
        breaks.where(
            (F.col("cause") == "ttl_expiry")
            & (F.col("ts") >= F.lit(end - dt.timedelta(days=28)))
            & (F.col("ts") < F.lit(end))
        ),
        session, "inner",
    )
    return (
        expired.groupBy("project").agg(F.count(F.lit(1)).alias("n_expiries"))
        .orderBy(F.desc("n_expiries"), F.asc_nulls_first("project")).limit(1)
    )


def break_coverage(priced: DataFrame, hooks: DataFrame) -> DataFrame:
    """Share of breaks with a known cause, and breaks older than the first hook event (A-18).

    Compaction and configuration changes can only be told apart once hook
    events are recorded.
    """
    first = hooks.agg(F.min("ts")).scalar()
    return priced.select("cause", "ts", first.alias("first_hook")).agg(
        F.count(F.lit(1)).alias("n_breaks"),
        share(F.count_if(F.col("cause") != "unknown"), F.count(F.lit(1))).alias("classified_pct"),
        F.count_if(F.col("ts") < F.col("first_hook")).alias("n_before_hooks"),
        F.max(F.col("first_hook").isNull().cast("int")).alias("hooks_missing"),
    )
