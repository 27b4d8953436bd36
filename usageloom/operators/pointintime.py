"""State as of an instant: burn rate, pace, budgets, cache state, nudges to fire (R-01 … R-08, R-12)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from usageloom import fixed_values as fixed
from usageloom.functions.scalar import context_tokens, local_day, micros, nz, utc_day
from usageloom.model import local_midnight
from usageloom.operators.pricing import covers, price_segments
from usageloom.operators.rollups import prompt_cost, union_rows
from usageloom.operators.temporal import asof_backward

SECOND_US = 1_000_000


def _instant_us(as_of: dt.datetime) -> Column:
    return F.lit(int(as_of.timestamp() * SECOND_US))


def _between(lo: dt.datetime, hi: dt.datetime, ts: str = "ts") -> Column:
    return (F.col(ts) >= F.lit(lo)) & (F.col(ts) < F.lit(hi))


def burn_rate(cost: DataFrame, as_of: dt.datetime, window_s: int = fixed.BURN_WINDOW_S) -> DataFrame:
    """Cost per hour over the last half hour; NULL without requests (R-01)."""
    recent = cost.where(_between(as_of - dt.timedelta(seconds=window_s), as_of))
    rate = F.coalesce(F.sum("cost_usd"), F.lit(0.0)) * F.lit(3600.0) / F.lit(float(window_s))
    return recent.agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.when(F.count(F.lit(1)) > 0, rate).alias("burn_rate_usd_h"),
    )


def _median(values: Column) -> Column:
    """Median of a short array."""
    v = F.array_sort(values)
    n = F.size(v)
    lower = F.get(v, F.floor((n - 1) / 2).cast("int"))
    upper = F.get(v, F.floor(n / 2).cast("int"))
    return (lower + upper) / F.lit(2.0)


def pace_landing(
    cost: DataFrame, req: DataFrame, as_of: dt.datetime, tz: str, weeks: int = 3
) -> DataFrame:
    """Today against the same weekday and time of the last weeks, and where today will land (R-02).

    A week counts if any request (``req``) was made on that day; at least two must.
    """
    today = as_of.astimezone(ZoneInfo(tz)).date()
    start, end = local_midnight(today, tz), local_midnight(today + dt.timedelta(days=1), tz)
    elapsed = as_of - start
    sums = [
        F.coalesce(F.sum(F.when(_between(start, end), F.col("cost_usd"))), F.lit(0.0)).alias("today_usd")
    ]
    active = []
    for k in range(1, weeks + 1):
        day = today - dt.timedelta(days=7 * k)
        lo, hi = local_midnight(day, tz), local_midnight(day + dt.timedelta(days=1), tz)
        for name, upper in (("partial", min(lo + elapsed, hi)), ("full", hi)):
            part = F.sum(F.when(_between(lo, upper), F.col("cost_usd")))
            sums.append(F.coalesce(part, F.lit(0.0)).alias(f"{name}_{k}"))
        active.append(F.max(_between(lo, hi).cast("int")).alias(f"active_{k}"))
    first = local_midnight(today - dt.timedelta(days=7 * weeks), tz)
    span = _between(first, end)
    row = cost.where(span).agg(*sums)
    seen = req.where(span).agg(*active)
    for k in range(1, weeks + 1):
        row = row.withColumn(f"active_{k}", seen.select(f"active_{k}").scalar())
    ks = range(1, weeks + 1)

    def of_active(value) -> Column:
        return F.filter(
            F.array(*[F.when(F.col(f"active_{k}") == 1, value(k)) for k in ks]),
            lambda x: x.isNotNull(),
        )

    partial = of_active(lambda k: F.col(f"partial_{k}"))
    rest = of_active(lambda k: F.greatest(F.lit(0.0), F.col(f"full_{k}") - F.col(f"partial_{k}")))
    enough = F.size(partial) >= 2
    return row.select(
        "today_usd",
        F.size(partial).alias("baseline_days"),
        F.when(enough, F.col("today_usd") / F.nullif(_median(partial), F.lit(0.0))).alias("pace_ratio"),
        F.when(enough, F.col("today_usd") + _median(rest)).alias("landing_usd"),
    )


def budget_usage(
    cost: DataFrame, budgets: dict[str, float | None], as_of: dt.datetime, tz: str
) -> DataFrame:
    """Cost of today, this week (from Monday) and this month against budgets (R-03).

    ``level`` is the highest of 50, 80 and 100 per cent that was reached.
    """
    today = as_of.astimezone(ZoneInfo(tz)).date()
    end = local_midnight(today + dt.timedelta(days=1), tz)
    starts = {
        "day": local_midnight(today, tz),
        "week": local_midnight(today - dt.timedelta(days=today.weekday()), tz),
        "month": local_midnight(today.replace(day=1), tz),
    }
    row = cost.where(_between(min(starts.values()), end)).agg(
        *[
            F.coalesce(F.sum(F.when(_between(lo, end), F.col("cost_usd"))), F.lit(0.0)).alias(name)
            for name, lo in starts.items()
        ]
    )
    budget = F.lit(None).cast("double")
    for name in starts:
        if budgets.get(name) is not None:
            budget = F.when(F.col("period") == name, F.lit(float(budgets[name]))).otherwise(budget)
    used = F.col("cost_usd") / F.when(F.col("budget_usd") > 0, F.col("budget_usd"))
    level = F.when(used >= 1, F.lit(100)).when(used >= 0.8, F.lit(80)).when(used >= 0.5, F.lit(50))
    return (
        row.unpivot([], list(starts), "period", "cost_usd")
        .withColumn("budget_usd", budget)
        .withColumn("used_ratio", used)
        .withColumn("level", level)
    )


BUDGET_LEVELS = (50, 80, 100)


def budget_crossings(cost: DataFrame, budgets: dict[str, float | None], tz: str) -> DataFrame:
    """Every day, week (from Monday) and month with the levels of its budget that its cost has reached (R-03).

    One row per period, its first local day and level; rows of ``cost`` may be
    requests or sums of them.
    """
    day = local_day("ts", tz)
    starts = {"day": day, "week": F.date_trunc("week", day).cast("date"), "month": F.trunc(day, "month")}
    known = [F.struct(F.lit(name).alias("period"), start.alias("start"), F.lit(float(budgets[name])).alias("budget_usd"))
             for name, start in starts.items() if budgets.get(name)]
    per_day = cost.groupBy(F.array(*known).alias("periods")).agg(F.sum("cost_usd").alias("cost_usd"))
    spent = per_day.select(F.explode("periods").alias("p"), "cost_usd").groupBy("p").agg(F.sum("cost_usd").alias("cost_usd"))
    reached = spent.withColumn("level", F.explode(F.array(*[F.lit(x) for x in BUDGET_LEVELS])))
    return reached.where(F.col("cost_usd") * 100 >= F.col("level") * F.col("p.budget_usd")).select("p.period", "p.start", "level")


def session_cache_state(
    req: DataFrame, price: DataFrame, as_of: dt.datetime, active_s: int = 43_200
) -> DataFrame:
    """Cache of each session with main-thread requests in the last hours (R-04).

    The latest cache write tells how long the cache lives; the latest request
    that touched the cache tells since when.
    """
    main = req.where(F.col("agent_id").isNull() & (F.col("ts") <= F.lit(as_of)))
    at = F.struct("ts", "request_id")
    wrote = (nz("cache_w5m_tok") > 0) | (nz("cache_w1h_tok") > 0)
    touched = wrote | (nz("cache_read_tok") > 0)
    grouped = main.groupBy("session_id").agg(
        F.max("ts").alias("last_ts"),
        F.max_by(
            F.struct("model", "ts", context_tokens().alias("ctx"), touched.alias("touched")), at
        ).alias("l"),
        F.max_by(
            F.struct(
                "ts", (nz("cache_w5m_tok") > 0).alias("w5m"), (nz("cache_w1h_tok") > 0).alias("w1h")
            ),
            F.when(wrote, at),
        ).alias("w"),
    ).where(F.col("last_ts") >= F.lit(as_of - dt.timedelta(seconds=active_s)))
    rates = price_segments(price, "model", ("in_usd", "cache_w1h_x"))
    rows = grouped.join(
        rates, (F.col("l.model") == rates["model"]) & covers(utc_day("l.ts")), "left"
    )
    million = F.col("l.ctx") / F.lit(1e6) * F.col("in_usd")
    low, high = F.round(million * F.lit(1.25), 2), F.round(million * F.col("cache_w1h_x"), 2)
    has = F.col("w").isNotNull()
    both = F.col("w.w5m") & F.col("w.w1h")
    kind = (
        F.when(has & both, F.lit("mixed")).when(has & F.col("w.w1h"), F.lit("1h"))
        .when(has, F.lit("5m")).otherwise(F.lit("unknown"))
    )
    anchor = F.when(has, F.when(F.col("l.touched"), F.col("l.ts")).otherwise(F.col("w.ts")))
    hour, minutes = F.lit(3600).cast("bigint"), F.lit(300).cast("bigint")
    ttl_min = F.when(F.col("ttl_kind") == "1h", hour).when(F.col("ttl_kind") != "unknown", minutes)
    ttl_max = F.when(F.col("ttl_kind").isin("1h", "mixed"), hour).when(F.col("ttl_kind") == "5m", minutes)
    anchor_us = micros("cache_ts")
    out = rows.select(
        "session_id", "last_ts", F.col("l.ctx").alias("context_tok"), F.col("l.model").alias("model"),
        anchor.alias("cache_ts"), kind.alias("ttl_kind"), low.alias("_low"), high.alias("_high"),
    )
    return out.select(
        "session_id", "last_ts", "context_tok", "model", "cache_ts", "ttl_kind",
        F.timestamp_micros(anchor_us + ttl_min * SECOND_US).alias("min_expires_at"),
        F.timestamp_micros(anchor_us + ttl_max * SECOND_US).alias("max_expires_at"),
        F.greatest(
            F.lit(0),
            F.floor((anchor_us + ttl_max * SECOND_US - _instant_us(as_of)) / F.lit(1e6)).cast("bigint"),
        ).alias("ttl_remaining_s"),
        F.when(F.col("ttl_kind") == "1h", F.col("_high")).otherwise(F.col("_low")).alias("rebuild_low_usd"),
        F.when(F.col("ttl_kind") == "5m", F.col("_low")).otherwise(F.col("_high")).alias("rebuild_high_usd"),
    )


def inflight_cost(hooks: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Sessions with a submitted prompt that has not stopped, and what it cost so far (R-05).

    The cost is the rise of the sampled session total since submission; NULL
    without samples or when the total went down.
    """
    seen = hooks.where(F.col("ts") <= F.lit(as_of))

    def latest(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("ts")))

    sample = F.col("kind") == "statusline_sample"
    order = F.struct("ts", F.coalesce("total_cost_usd", F.lit(-1.0)))
    open_prompts = (
        seen.groupBy("session_id")
        .agg(
            latest("UserPromptSubmit").alias("prompt_ts"),
            latest("Stop").alias("stop_ts"),
            F.max_by("total_cost_usd", F.when(sample, order)).alias("now_usd"),
        )
        .where(
            F.col("prompt_ts").isNotNull()
            & (F.col("stop_ts").isNull() | (F.col("stop_ts") < F.col("prompt_ts")))
        )
        .drop("stop_ts")
    )
    found = asof_backward(
        open_prompts, seen.where(sample), "session_id", micros("prompt_ts"), micros("ts"),
        "total_cost_usd", ("total_cost_usd",), "start",
    )
    rise = F.col("now_usd") - F.col("start.total_cost_usd")
    return found.select(
        "session_id", "prompt_ts", F.when(rise >= 0, F.round(rise, 6)).alias("inflight_usd")
    )


def recent_prompts(
    cost: DataFrame, prompt: DataFrame, inflight: DataFrame, n: int = 3
) -> DataFrame:
    """The last priced prompts of each session, without the one in flight (W-08)."""
    ends = cost.where(F.col("prompt_id").isNotNull()).groupBy("prompt_id").agg(
        F.sum("cost_usd").alias("cost_usd"), F.min("ts").alias("first_ts"),
        F.max(F.coalesce("end_ts", "ts")).alias("completed_ts"),
        F.max("is_interrupted").alias("interrupted"),
    ).where(F.col("cost_usd").isNotNull())
    rows = (
        prompt.select("prompt_id", "session_id", F.col("ts").alias("asked_ts"))
        .join(ends, "prompt_id")
        .join(inflight.select("session_id", "prompt_ts"), "session_id", "left")
        .where(
            F.col("prompt_ts").isNull()
            | (micros("asked_ts") < micros("prompt_ts") - 2 * SECOND_US)
        )
    )
    order = W.partitionBy("session_id").orderBy(F.desc("first_ts"), F.asc("prompt_id"))
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).select(
        "session_id", "prompt_id", "cost_usd", "interrupted", "completed_ts", "rn"
    )


def staleness(
    req: DataFrame, hooks: DataFrame, log: DataFrame, as_of: dt.datetime, sync_failed: bool = False
) -> DataFrame:
    """Whether the ledger can be trusted right now, with reasons (R-06)."""
    now = _instant_us(as_of)

    def newest(df: DataFrame) -> Column:
        return df.agg(F.max(micros("ts"))).scalar()

    row = req.sparkSession.range(1).select(
        newest(req).alias("request_us"), newest(hooks).alias("hook_us"), newest(log).alias("ingest_us")
    )

    def active(c: str) -> Column:
        return F.coalesce(now - F.col(c) < 1800 * SECOND_US, F.lit(False))

    r, h = active("request_us"), active("hook_us")
    gap = F.abs(F.col("request_us") - F.col("hook_us")) >= 900 * SECOND_US
    late = F.coalesce(now - F.col("ingest_us") >= 900 * SECOND_US, F.lit(True))
    reasons = F.filter(
        F.array(
            F.when(r & ~h, F.lit("hooks_missing_during_request_activity"))
            .when(h & ~r, F.lit("ledger_missing_during_hook_activity"))
            .when(r & h & gap, F.lit("request_hook_clock_gap")),
            F.when(late, F.lit("ingest_not_recent")),
            F.when(F.lit(sync_failed), F.lit("last_sync_failed")),
        ),
        lambda x: x.isNotNull(),
    )
    return row.withColumn("reasons", F.array_join(reasons, ",")).withColumn(
        "stale", (F.col("reasons") != "").cast("int")
    )


def nudge_candidates(
    state: DataFrame, budgets: DataFrame, samples: DataFrame, as_of: dt.datetime, tz: str,
    runaway_usd: float = fixed.RUNAWAY_USD,
    ttl_gap_s: int = fixed.TTL_PRENOTIFY_GAP_S,
    coldcache_min_usd: float = fixed.COLDCACHE_MIN_USD,
    context_pct: float = fixed.CONTEXT_WARN_PCT,
) -> DataFrame:
    """Rules that hold now, each with the key under which it may fire once (R-07).

    ``state``: session_id, last_ts, cache_ts, ttl_kind, max_expires_at,
    rebuild_high_usd, inflight_usd, prompt_ts.  ``budgets``: output of
    ``budget_usage``.  ``samples``: session_id, context_pct (latest).
    """
    now = _instant_us(as_of)
    day = F.lit(as_of.astimezone(ZoneInfo(tz)).date().isoformat())
    idle = now - micros("cache_ts")
    rebuild = F.col("rebuild_high_usd") >= coldcache_min_usd

    def second(ts: str) -> Column:
        return F.floor(micros(ts) / F.lit(1e6)).cast("bigint").cast("string")

    def rule(df: DataFrame, name, when: Column, key: Column, sid: Column, value: Column) -> DataFrame:
        label = F.lit(name) if isinstance(name, str) else name
        return df.where(when).select(
            label.alias("rule"), sid.alias("session_id"), key.alias("key"), value.cast("double").alias("value")
        )

    sid = F.col("session_id")
    runaway = rule(
        state, "runaway_guard", F.col("inflight_usd") >= runaway_usd,
        F.concat_ws(":", F.lit("runaway"), sid, second("prompt_ts")), sid, F.col("inflight_usd"),
    )
    expiring = rule(
        state, "ttl_prenotify",
        F.col("ttl_kind").isin("1h", "mixed") & (idle >= ttl_gap_s * SECOND_US)
        & (idle < 3600 * SECOND_US) & rebuild & F.col("prompt_ts").isNull(),
        F.concat_ws(":", F.lit("ttl"), sid, second("last_ts")), sid, F.col("rebuild_high_usd"),
    )
    cold = rule(
        state, "coldcache_warn",
        (now > F.coalesce(micros("max_expires_at"), micros("last_ts") + 3600 * SECOND_US)) & rebuild,
        F.concat_ws(":", F.lit("coldcache"), sid, second("last_ts")), sid, F.col("rebuild_high_usd"),
    )
    context = rule(
        samples, "ctx_warn", F.col("context_pct") >= context_pct,
        F.concat_ws(":", F.lit("ctx"), sid), sid, F.col("context_pct"),
    )
    budget = rule(
        budgets, F.concat(F.lit("budget_warn_"), F.col("level").cast("string")),
        (F.col("period") == "day") & F.col("level").isNotNull(),
        F.concat_ws(":", F.lit("budget"), F.col("level").cast("string"), day), F.lit(""), F.col("used_ratio"),
    )
    return union_rows(runaway, expiring, cold, context, budget)


def fire_nudges(
    candidates: DataFrame, fired: DataFrame, as_of: dt.datetime, tz: str,
    daily_cap: int = fixed.NUDGE_DAILY_CAP,
) -> DataFrame:
    """Candidates not fired before under their key, at most ``daily_cap`` per rule and day (R-07).

    ``fired``: earlier nudges ``(rule, key, fired_ts)``.  The cap is the rule's
    own feature.  Of equal rank the smallest key goes first.
    """
    today = F.lit(as_of.astimezone(ZoneInfo(tz)).date())
    fresh = candidates.dropDuplicates(["key"]).join(fired.select("key"), "key", "left_anti")
    used = (
        fired.where(local_day("fired_ts", tz) == today)
        .groupBy("rule").agg(F.count(F.lit(1)).alias("used"))
    )
    # The rank limit is applied before the shuffle too: a task sends a few rows per rule.
    order = W.partitionBy("rule").orderBy("key")
    ranked = fresh.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= daily_cap)
    return (
        ranked.join(used, "rule", "left")
        .where(F.col("rn") + nz("used") <= daily_cap)
        .select("rule", "session_id", "key", "value", F.lit(as_of).alias("fired_ts"))
    )


def receipts(
    cost: DataFrame, prompt: DataFrame, inflight: DataFrame, sent: DataFrame, as_of: dt.datetime,
    min_usd: float = fixed.PROMPT_CRIT_USD, within_s: int = 600,
) -> DataFrame:
    """Costly prompts whose last request ended a moment ago and that were not reported yet (R-08)."""
    lo = as_of - dt.timedelta(seconds=within_s)
    recent = cost.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") <= F.lit(as_of))).select("prompt_id").distinct()
    cost = cost.join(recent, "prompt_id", "left_semi")
    last = cost.groupBy("prompt_id").agg(F.max("ts").alias("last_ts"))
    rows = (
        prompt_cost(cost).select("prompt_id", "cost_usd", "n_requests")
        .where(F.col("cost_usd") >= min_usd)
        .join(last.where((F.col("last_ts") >= F.lit(lo)) & (F.col("last_ts") <= F.lit(as_of))), "prompt_id")
        .join(prompt.select("prompt_id", "session_id"), "prompt_id")
    )
    return (
        rows.join(inflight.select("session_id"), "session_id", "left_anti")
        .join(sent.select("prompt_id"), "prompt_id", "left_anti")
    )


def sessionize(df: DataFrame, key: str, gap_s: int, ts: str = "ts") -> DataFrame:
    """Activity periods split by idle gaps, with Spark's session window (R-12)."""
    window = F.session_window(ts, f"{gap_s} seconds")
    return (
        df.groupBy(key, window.alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
        .drop("w")
    )


def latest_context_pct(hooks: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Context use in the latest status sample of each session."""
    rows = hooks.where((F.col("kind") == "statusline_sample") & (F.col("ts") <= F.lit(as_of)))
    return rows.groupBy("session_id").agg(
        F.max_by("context_pct", F.struct("ts", F.coalesce("context_pct", F.lit(-1.0)))).alias("context_pct")
    )


def throttle_seconds(samples: DataFrame, every_s: int = 15) -> DataFrame:
    """Status samples kept when at most one per session and ``every_s`` seconds may pass (R-09).

    Instants are whole seconds, so samples are first reduced to one row per
    session and second.  A pause of ``every_s`` always starts afresh, which cuts
    a session into independent bursts; inside one the choice is sequential.
    """
    from usageloom.operators.temporal import last_non_null, with_previous

    seconds = (
        samples.select("session_id", F.floor(micros("ts") / F.lit(1e6)).cast("bigint").alias("s"))
        .groupBy("session_id", "s").agg(F.count(F.lit(1)).alias("n_samples"))
    )
    seq = with_previous(
        seconds, "session_id", F.col("s") * SECOND_US, "n_samples", ("s",)
    )
    starts = F.col("prev.s").isNull() | (F.col("s") - F.col("prev.s") >= every_s)
    marked = seq.select(
        "session_id", "s", F.when(starts, F.col("s")).alias("start"),
        F.floor(F.col("s") / F.lit(3600.0)).cast("bigint").alias("hour"),
    )
    bursts = last_non_null(marked, "session_id", ("hour", "s"), ("hour",), "start", "burst")
    # Rows of a burst pass by in order, so a task holds one batch of integers and the last second it kept.
    ordered = bursts.select("session_id", "burst", "s").repartition("session_id", "burst").sortWithinPartitions("session_id", "burst", "s")
    return ordered.mapInArrow(_greedy(every_s), "session_id string, kept_s bigint")


def _greedy(every_s: int):
    """Of the ascending seconds of each (session, burst), the first and then each that is ``every_s`` after the last one kept."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            sessions, burst, s = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            codes = sessions.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (burst[1:] != burst[:-1])]) if len(s) else []
            kept = []
            for a, b in zip(starts, [*starts[1:], len(s)]):
                key = (sessions[a].as_py(), burst[a])
                at = a if key != now else a + int(np.searchsorted(s[a:b], last + every_s))
                now = key
                while at < b:
                    kept.append(at)
                    last = s[at]
                    at += int(np.searchsorted(s[at:b], last + every_s))
            yield pa.RecordBatch.from_arrays([sessions.take(pa.array(kept, pa.int64())), pa.array(s[kept] if kept else [], pa.int64())], ["session_id", "kept_s"])

    return keep
