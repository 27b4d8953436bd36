"""Streams with state of their own per key (T-09, R-04, R-05, R-07, R-09).

State consists of registers: a value with the instant it was set, which only
moves forward in event time.  So any order of rows inside the watermark ends in
the same state.  Timers free a key when nothing can come for it any more.  The
per-key programs are small; Spark partitions the keys, keeps their state in
RocksDB and restores it after a failure.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from usageloom.fixed_values import NUDGE_DAILY_CAP
from usageloom.functions.scalar import context_tokens, local_day, micros, nz
from usageloom.operators.merge import named_prompt, own_prompt

HOUR_US = 3_600_000_000


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows of one key as tuples, one Arrow batch at a time."""
    for batch in batches:
        yield from zip(*(batch[c].tolist() for c in batch.columns))


def _missing(value: Any) -> bool:
    return value is None or value != value


class _Kept(StatefulProcessor):
    """A state of named registers, stored as one JSON text, with timers in event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("registers", "text string")

    def load(self) -> dict:
        kept = self.stored.get()
        return json.loads(kept[0]) if kept else {}

    def save(self, state: dict) -> None:
        self.stored.update((json.dumps(state),))

    def remind(self, state: dict, name: str, at_us: int | None) -> None:
        """Move the timer of this name to an instant (a timer is known by its millisecond)."""
        timers = state.setdefault("timers", {})
        old, new = timers.get(name), None if at_us is None else -(-at_us // 1000)
        if old != new:
            if new is not None and new not in timers.values():
                self.handle.registerTimer(new)
            timers[name] = new
            if old is not None and old not in timers.values():
                self.handle.deleteTimer(old)

    def due(self, state: dict, info: Any) -> list[str]:
        """Names of the timers that go off now."""
        now = info.getExpiryTimeInMs()
        names = [name for name, at in state.get("timers", {}).items() if at is not None and at <= now]
        for name in names:
            state["timers"][name] = None
        return names

    def close(self) -> None:
        pass


class _CarryPrompt(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("prompt", "prompt_id string", self.ttl_ms)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        if initialState.prompt_id is not None:
            self.current.update((initialState.prompt_id,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        kept = self.current.get()
        prompt = kept[0] if kept else None
        # The micro-batch of a lineage, in arrival order: texts are gone, three short columns are left.
        for ord_, is_user, own, request_id in sorted((r.ord, r.is_user, r.own_prompt, r.request_id) for r in rows):
            if is_user:
                prompt = own or prompt
            else:
                yield Row(request_id=request_id, ord=ord_, prompt_id=own or prompt)
        if prompt is not None:
            self.current.update((prompt,))

    def close(self) -> None:
        pass


def carry_prompt_stream(records: DataFrame, carried: DataFrame | None = None, keep_days: int = 30) -> DataFrame:
    """Prompt of each assistant record, carried per lineage across batches (T-09).

    ``records``: lineage_id, ord (arrival order), is_user, own_prompt, request_id.
    ``carried`` (``carried_prompts`` of what the ledger already holds) is the state a
    new query starts from.  A lineage that is silent for ``keep_days`` is forgotten; by
    processing time, so run it without ``idle_batches``.
    """
    start = carried.select("lineage_id", "prompt_id").groupBy("lineage_id") if carried is not None else None
    # By rows: most lineages have a few rows in a batch, for which a pandas frame each costs more than the work.
    return records.groupBy("lineage_id").transformWithState(
        _CarryPrompt(keep_days * 86_400_000), "request_id string, ord bigint, prompt_id string", "append", "ProcessingTime", start
    )


def carried_prompts(records: DataFrame) -> DataFrame:
    """Per lineage the prompt that parsed ``records`` leave in force: the last one a user record named."""
    named = records.select("lineage_id", "seq", named_prompt().alias("prompt_id")).where(F.col("prompt_id").isNotNull())
    return named.groupBy("lineage_id").agg(F.max_by("prompt_id", "seq").alias("prompt_id"))


def carry_rows(records: DataFrame, ord_column) -> DataFrame:
    """Parsed records as ``carry_prompt_stream`` takes them."""
    rows = records.where(F.col("rec.type").isin("user", "assistant")).select(
        "lineage_id", ord_column.alias("ord"), (F.col("rec.type") == "user").alias("is_user"), own_prompt().alias("own_prompt"), "request_id")
    return rows.where("is_user OR request_id IS NOT NULL")


class _Throttle(_Kept):
    """Samples wait until the watermark has passed them and are then chosen in order."""

    def __init__(self, every_s: int):
        self.every_s = every_s

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.load()
        waiting = sorted({*state.get("waiting", []), *(int(s) for (s,) in _records(r[["s"]] for r in rows))})
        state["waiting"] = waiting
        self.remind(state, "choose", waiting[0] * 1_000_000)
        self.save(state)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self.load()
        if "choose" in self.due(state, expiredTimerInfo):
            passed = timerValues.getCurrentWatermarkInMs() // 1000
            kept, last = [], state.get("last")
            for s in state["waiting"]:
                if s <= passed and (last is None or s - last >= self.every_s):
                    last = s
                    kept.append((key[0], s))
            waiting = [s for s in state["waiting"] if s > passed]
            state |= {"waiting": waiting, "last": last}
            self.remind(state, "choose", waiting[0] * 1_000_000 if waiting else None)
            self.remind(state, "forget", (last + self.every_s) * 1_000_000)
            self.save(state)
            yield pd.DataFrame(kept, columns=["session_id", "kept_s"])
        elif not state.get("waiting"):
            self.stored.clear()
        else:
            self.save(state)


def throttle_stream(samples: DataFrame, every_s: int = 15, watermark: str = "1 minute") -> DataFrame:
    """At most one status sample per session and ``every_s`` seconds (R-09).

    A choice is made when the watermark has passed a sample, so late ones within
    it count as in the batch operator; only seconds newer than the watermark wait.
    """
    seconds = samples.withWatermark("ts", watermark).select("session_id", "ts", F.floor(micros("ts") / F.lit(1e6)).cast("bigint").alias("s"))
    return seconds.groupBy("session_id").transformWithStateInPandas(
        _Throttle(every_s), "session_id string, kept_s bigint", "append", "EventTime"
    )


class _Inflight(_Kept):
    """Registers: latest prompt, latest stop; samples as far back as a prompt may still ask for one."""

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.load()
        prompt, stop, seen = state.get("prompt"), state.get("stop"), state.get("seen")
        samples = {int(us): usd for us, usd in state.get("samples", [])}
        for us, kind, usd in _records(r[["us", "kind", "total_cost_usd"]] for r in rows):
            us, usd = int(us), None if _missing(usd) else float(usd)
            seen = us if seen is None else max(seen, us)
            if kind == "UserPromptSubmit":
                prompt = us if prompt is None else max(prompt, us)
            elif kind == "Stop":
                stop = us if stop is None else max(stop, us)
            elif us not in samples or samples[us] is None or (usd is not None and usd > samples[us]):
                samples[us] = usd
        order = sorted(samples)
        start_at = max((us for us in order if prompt is not None and us <= prompt), default=None)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        last_passed = max((us for us in order if us <= passed), default=None)
        # A prompt to come is not older than the watermark, so older samples but the last of them are of no use.
        useful = [us for us in order if us > passed or us in (last_passed, start_at)]
        state |= {"prompt": prompt, "stop": stop, "seen": seen, "n": state.get("n", 0) + 1, "samples": [(us, samples[us]) for us in useful]}
        self.remind(state, "forget", seen + self.keep_us)
        self.save(state)
        start, now = samples.get(start_at), samples[order[-1]] if order else None
        is_open = prompt is not None and (stop is None or stop < prompt)
        known = is_open and start is not None and now is not None and now >= start
        yield pd.DataFrame({
            "session_id": [key[0]], "prompt_us": pd.array([prompt], dtype="Int64"), "is_open": [is_open],
            "inflight_usd": pd.array([round(now - start, 6) if known else None], dtype="Float64"), "as_of_us": [seen], "version": [state["n"]],
        })

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.stored.clear()
        return iter(())


def inflight_stream(hooks: DataFrame, watermark: str = "10 minutes", keep_s: int = 43_200) -> DataFrame:
    """After each batch, the open prompt of every session heard from and its cost so far (R-05).

    Of the rows of a session the one of the largest (as_of_us, version) counts
    (``latest_of``).  A session that is silent for ``keep_s`` is forgotten.
    """
    rows = hooks.where(F.col("kind").isin("UserPromptSubmit", "Stop", "statusline_sample")).withWatermark("ts", watermark).select(
        "session_id", "ts", "kind", micros("ts").alias("us"), "total_cost_usd")
    return rows.groupBy("session_id").transformWithStateInPandas(
        _Inflight(keep_s * 1_000_000), "session_id string, prompt_us bigint, is_open boolean, inflight_usd double, as_of_us bigint, version bigint",
        "append", "EventTime",
    )


class _CacheState(_Kept):
    """Registers: the latest request and the latest cache write of a session."""

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    @staticmethod
    def _row(key: Any, status: str, state: dict, as_of: int) -> pd.DataFrame:
        latest, write = state["latest"], state.get("write")
        kind = write[2] if write else "unknown"
        anchor = None if write is None else latest[0] if latest[3] else write[0]
        expires = None if anchor is None else anchor + (300_000_000 if kind == "5m" else HOUR_US)
        state["n"] = state.get("n", 0) + 1
        return pd.DataFrame({
            "session_id": [key[0]], "status": [status if expires is not None else "none"], "ttl_kind": [kind], "context_tok": [latest[2]],
            "expires_us": pd.array([expires], dtype="Int64"), "as_of_us": [as_of], "version": [state["n"]],
        })

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.load()
        names = ["us", "request_id", "context_tok", "w5m", "w1h", "touched"]
        for us, request_id, context, w5m, w1h, touched in _records(r[names] for r in rows):
            at = [int(us), request_id]
            if "latest" not in state or at > state["latest"][:2]:
                state["latest"] = [*at, int(context), bool(touched)]
            if (w5m or w1h) and ("write" not in state or at > state["write"][:2]):
                state["write"] = [*at, "mixed" if w5m and w1h else "1h" if w1h else "5m"]
        row = self._row(key, "live", state, state["latest"][0])
        expires = row["expires_us"][0]
        self.remind(state, "expire", None if pd.isna(expires) else int(expires))
        self.remind(state, "forget", state["latest"][0] + self.keep_us)
        self.save(state)
        yield row

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self.load()
        due = self.due(state, expiredTimerInfo)
        if "expire" in due:
            row = self._row(key, "expired", state, state["latest"][0])
            # A latest request that touched no cache may be younger than the expiry.
            row["as_of_us"] = row["expires_us"].astype("int64").clip(lower=state["latest"][0])
            yield row
        if "forget" in due:
            self.stored.clear()
        else:
            self.save(state)


def cache_state_stream(req: DataFrame, watermark: str = "1 minute", keep_s: int = 43_200) -> DataFrame:
    """Cache state of each session after a batch, and a row when event time passes its expiry (R-04).

    Of the rows of a session the one of the largest (as_of_us, version) counts
    (``latest_of``).  A session is forgotten ``keep_s`` after its last request (an
    expiry further away is told then).
    """
    wrote5, wrote1 = nz("cache_w5m_tok") > 0, nz("cache_w1h_tok") > 0
    rows = req.where(F.col("agent_id").isNull()).withWatermark("ts", watermark).select(
        "session_id", "ts", micros("ts").alias("us"), "request_id", context_tokens().alias("context_tok"),
        wrote5.alias("w5m"), wrote1.alias("w1h"),
        (wrote5 | wrote1 | (nz("cache_read_tok") > 0)).alias("touched"),
    )
    return rows.groupBy("session_id").transformWithStateInPandas(
        _CacheState(max(keep_s * 1_000_000, HOUR_US)),
        "session_id string, status string, ttl_kind string, context_tok bigint, expires_us bigint, as_of_us bigint, version bigint",
        "append", "EventTime",
    )


def latest_of(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """The state that counts: per key the row of the largest (as_of_us, version)."""
    columns = [c for c in rows.columns if c not in (key, "as_of_us", "version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("as_of_us", "version")).alias("row")).select(key, "row.*")


class _DailyCap(StatefulProcessor):
    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getMapState("keys", "key string", "fired_us bigint")
        self.used = handle.getValueState("used", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = self.used.get()
        used = int(kept[0]) if kept else 0
        if not kept:  # the day is over for good when the watermark is two days past its start
            self.handle.registerTimer(int(pd.Timestamp(key[1]).timestamp() * 1000) + 2 * 86_400_000)
        first: dict[str, tuple] = {}
        for rule, session_id, nudge, us in _records(r[["rule", "session_id", "key", "us"]] for r in rows):
            if nudge not in first or us < first[nudge][3]:
                first[nudge] = (rule, session_id, nudge, int(us))
            if len(first) > 8 * self.cap + 64:  # only the earliest can count
                first = dict(sorted(first.items(), key=lambda x: (x[1][3], x[0]))[:4 * self.cap + 32])
        out = []
        for row in sorted(first.values(), key=lambda r: (r[3], r[2])):
            if used < self.cap and not self.keys.containsKey((row[2],)):
                self.keys.updateValue((row[2],), (row[3],))
                used += 1
                out.append(row)
        self.used.update((used,))
        yield pd.DataFrame(out, columns=["rule", "session_id", "key", "fired_us"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.keys.clear()
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def fire_nudges_stream(
    candidates: DataFrame, tz: str, daily_cap: int = NUDGE_DAILY_CAP, watermark: str = "2 days"
) -> DataFrame:
    """Each candidate key once, at most ``daily_cap`` per rule and local day (R-07).

    ``candidates``: rule, session_id, key, ts.  Copies of a key are dropped by
    Spark's own deduplication, spread over keys; only what is left meets the
    counter of its rule and day, whose state holds ``daily_cap`` keys and is freed
    when the watermark has left the day behind.
    """
    fresh = candidates.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["key"])
    rows = fresh.select("rule", local_day("ts", tz).alias("day"), "ts", "session_id", "key", micros("ts").alias("us"))
    return rows.groupBy("rule", "day").transformWithStateInPandas(
        _DailyCap(daily_cap), "rule string, session_id string, key string, fired_us bigint", "append", "EventTime"
    )
