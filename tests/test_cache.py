"""Cache-break causes, one small lineage each."""

import datetime as dt
import random

import pytest

from test_pricing import requests
from usageloom.model import utc
from usageloom.operators.breakfacts import break_facts, build_breaks
from usageloom.operators.cache import cache_identity
from usageloom.operators.rollups import period_filter
from usageloom.plans.overview import context_window
from usageloom.functions.periods import PRESETS, between, iso_week, last_days, month_of
from usageloom.model import Page, Window
from usageloom.sources.sinks import read_ledger, write_ledger

T0 = utc("2026-07-20T12:00:00")


def after(s):
    return T0 + dt.timedelta(seconds=s)


def hooks(spark, *rows):
    return spark.createDataFrame([(after(s), kind, sid) for s, kind, sid in rows], "ts timestamp, kind string, session_id string")


FIRST = dict(request_id="a", ts=T0, end_ts=T0, cache_read_tok=1000, cache_w1h_tok=9000)


@pytest.mark.parametrize("gap_s, first, second, events, cause", [
    (10, {}, dict(cache_read_tok=10_000), [], None),                                             # identity holds
    (10, {}, dict(cache_read_tok=0), [], "unknown"),
    (10, dict(is_interrupted=1), dict(cache_read_tok=0, model="b"), [], "interruption"),          # precedence
    (10, {}, dict(cache_read_tok=0, model="b"), [(-600, "PreCompact", "s")], "compaction"),       # lower bound included
    (10, {}, dict(cache_read_tok=0), [(610, "PostCompact", "s")], "compaction"),                  # upper bound included
    (10, {}, dict(cache_read_tok=0), [(611, "PostCompact", "s")], "unknown"),
    (10, {}, dict(cache_read_tok=0), [(5, "PreCompact", "other")], "unknown"),
    (10, {}, dict(cache_read_tok=0, model="b"), [(5, "SessionStart", "s")], "model_switch"),
    (10, {}, dict(cache_read_tok=0), [(10, "SessionStart", "s")], "config_change"),
    (10, {}, dict(cache_read_tok=0), [(11, "SessionStart", "s")], "unknown"),
    (3600, {}, dict(cache_read_tok=0), [], "unknown"),
    (3601, {}, dict(cache_read_tok=0), [], "ttl_expiry"),
    (301, dict(cache_w1h_tok=0, cache_w5m_tok=9000), dict(cache_read_tok=0), [], "ttl_expiry"),
    (300, dict(cache_w1h_tok=0, cache_w5m_tok=9000), dict(cache_read_tok=0), [], "unknown"),      # not long enough
    (301, dict(cache_w1h_tok=0, cache_w5m_tok=9000), dict(cache_read_tok=1000), [], "unknown"),   # a tenth survived
    (301, dict(cache_w1h_tok=1, cache_w5m_tok=9000), dict(cache_read_tok=0), [], "unknown"),      # an hour-long write too
    (301, dict(cache_w1h_tok=0, cache_w5m_tok=9000, end_ts=None), dict(cache_read_tok=0), [], "unknown"),
])
def test_causes(spark, gap_s, first, second, events, cause):
    rows = requests(spark, {**FIRST, **first}, dict(request_id="b", ts=after(gap_s), **second))
    got = [r.cause for r in cache_identity(rows, hooks(spark, *events)).collect()]
    assert got == ([cause] if cause else [])


def test_live_one_hour_write_keeps_the_cache(spark):
    rows = requests(
        spark,
        dict(request_id="w", ts=after(-3000), end_ts=after(-3000), cache_w1h_tok=10),
        dict(request_id="a", ts=T0, end_ts=T0, cache_read_tok=10, cache_w5m_tok=9000),
        dict(request_id="b", ts=after(400), cache_read_tok=0),
    )
    assert [r.cause for r in cache_identity(rows, hooks(spark)).collect()] == ["unknown"]


def test_periods():
    D = dt.date
    last_week = iso_week("2026-07-22", back=1)
    assert (last_week.start, last_week.end) == (D(2026, 7, 13), D(2026, 7, 19))
    assert (iso_week("2027-01-02").start, iso_week("2027-01-02").end) == (D(2026, 12, 28), D(2027, 1, 2))
    assert last_days("2026-07-22").days == 14
    assert month_of("2026-03-31", back=1).end == D(2026, 2, 28)
    assert PRESETS["last-month"](D(2026, 1, 5)).start == D(2025, 12, 1)
    assert month_of("2026-07-22").days == 22 and PRESETS["yesterday"](D(2026, 7, 22)).end == D(2026, 7, 21)
    w = Window(D(2026, 7, 20), D(2026, 7, 22))
    assert (w.previous().start, w.previous().end) == (D(2026, 7, 17), D(2026, 7, 19))
    assert context_window(w, D(2026, 7, 25)) == (D(2026, 6, 25), D(2026, 7, 25))
    for bad in (lambda: last_days("2026-07-22", 0), lambda: between("2026-07-02", "2026-07-01"), lambda: last_days("2026-W30-3")):
        with pytest.raises(ValueError):
            bad()
    for bad in (dict(limit=0), dict(limit=201), dict(page=0), dict(order="up"), dict(sort="name")):
        with pytest.raises(ValueError):
            Page(**bad)


@pytest.mark.parametrize("seed", [1, 2])
def test_breaks_built_by_days_equal_one_build(spark, tmp_path, seed):
    """Any split into batches of days, with a batch built twice; periods open only their days."""
    pick = random.Random(seed)
    rows = [dict(request_id=f"r{k}", lineage_id=f"l{k % 4}" if k % 9 else None, session_id=f"s{k % 4}", ts=T0 + dt.timedelta(minutes=pick.randrange(6 * 1440)), model=pick.choice("aab"),
                 cache_read_tok=pick.choice([0, 900, 1000]), cache_w5m_tok=pick.choice([0, 100]), cache_w1h_tok=pick.choice([0, 0, 100]), is_interrupted=int(k % 11 == 0),
                 is_synthetic=int(k % 13 == 0)) for k in range(150)]
    for r in rows:
        r["end_ts"] = r["ts"]
    req = requests(spark, *rows)
    events = spark.createDataFrame([(T0 + dt.timedelta(minutes=pick.randrange(6 * 1440)), pick.choice(["PreCompact", "SessionStart"]), f"s{pick.randrange(4)}") for _ in range(40)],
                                   "ts timestamp, kind string, session_id string")
    whole = sorted(map(str, cache_identity(req, events).collect()))
    days = [T0.date() + dt.timedelta(days=k) for k in range(7)]
    edges = sorted(pick.sample(range(1, 7), 2))
    spans = [(days[0], days[edges[0] - 1]), (days[edges[0]], days[edges[1] - 1]), (days[edges[1]], days[6])]
    path = str(tmp_path)
    write_ledger({"request": req}, path)
    stored = read_ledger(spark, path, "request")
    for first, last in (spans[0], spans[1], spans[1], spans[2]):
        build_breaks(stored, events, path, first, last)
    facts = break_facts(spark, path)
    assert sorted(map(str, facts.drop("utc_day").collect())) == whole and whole
    plan = period_filter(facts, Window(days[2], days[3]), "UTC")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(utc_day" in plan
