import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from usageloom.model import PRICE, PRICE_TOOL, REQUEST, Window, utc
from usageloom.operators import rollups as A
from usageloom.operators.pricing import MOST_TOOL_RATES, cost_requests, server_tool_cost
from usageloom.sources.prices import load_prices, price_overlaps, validate_price_ranges

D = dt.date


def request(**kw):
    row = dict(
        request_id="r", message_id="m", session_id="s", agent_id=None, lineage_id="s", prompt_id="p",
        ts=utc("2026-07-20T12:00:00"), model="a", input_tok=0, output_tok=0, cache_read_tok=0, cache_w5m_tok=0,
        cache_w1h_tok=0, server_tool_use=None, service_tier=None, speed=None, geo=None, stop_reason="end_turn",
        is_synthetic=0, is_interrupted=0, source="transcript", raw_path=None, query_source=None, effort=None,
        cost_usd_sdk=None, end_ts=None, api_duration_ms=None)
    row.update(kw)
    return row


def requests(spark, *rows):
    return spark.createDataFrame([request(**r) for r in rows], REQUEST)


def price(spark, *rows):
    base = dict(valid_from=D(2025, 1, 1), valid_to=None, in_usd=3.0, out_usd=15.0, cache_read_x=0.1, cache_w5m_x=1.25,
                cache_w1h_x=2.0, batch_x=0.5, fast_x=1.0, geo_us_x=1.1, source_url=None)
    return spark.createDataFrame([{**base, **r} for r in rows], PRICE)


def tools(spark, *rows):
    base = dict(valid_from=D(2025, 1, 1), valid_to=None, source_url=None)
    return spark.createDataFrame([{**base, **r} for r in rows], PRICE_TOOL)


def costs(df):
    return {r.request_id: r.cost_usd for r in df.collect()}


@pytest.mark.parametrize("joined", [False, True])
def test_price_periods_and_factors(spark, joined):
    p = price(
        spark,
        dict(model="s", valid_from=D(2026, 1, 1), valid_to=D(2026, 9, 1), in_usd=2.0),
        dict(model="s", valid_from=D(2026, 9, 1), in_usd=3.0),
        dict(model="o", valid_from=D(2025, 1, 1), valid_to=D(2026, 7, 24), in_usd=5.0, fast_x=6.0),
        dict(model="o", valid_from=D(2026, 7, 24), in_usd=5.0),
    )
    t = tools(spark, dict(tool="search", usd_per_unit=0.01))
    m = dict(input_tok=1_000_000)
    rows = requests(
        spark,
        dict(request_id="before", model="s", ts=utc("2026-08-31T23:59:59"), **m),
        dict(request_id="on", model="s", ts=utc("2026-09-01T00:00:00"), **m),
        dict(request_id="fast", model="o", speed="fast", ts=utc("2026-07-23T10:00:00"), **m),
        dict(request_id="not_fast", model="o", speed="fast", ts=utc("2026-07-24T10:00:00"), **m),
        dict(request_id="batch", model="o", service_tier="batch", geo="us-east", **m),
        dict(request_id="tool", model="s", server_tool_use=json.dumps({"search": 2, "other": 9}), **m),
        dict(request_id="broken_tool", model="s", server_tool_use="nope", **m),
        dict(request_id="unpriced", model="zzz", **m),
        dict(request_id="synthetic", model="s", is_synthetic=1, **m),
    )
    got = costs(cost_requests(rows, p, t, server_tool_cost(rows, t) if joined else None))
    assert got == {
        "before": 2.0, "on": 3.0, "fast": 30.0, "not_fast": 5.0, "batch": pytest.approx(2.75), "tool": pytest.approx(2.02),
        "broken_tool": 2.0, "unpriced": None,
    }


def test_overlap_takes_the_later_start_and_resumes_after_it(spark):
    p = price(
        spark, dict(model="a", in_usd=1.0),
        dict(model="a", valid_from=D(2026, 1, 1), valid_to=D(2026, 2, 1), in_usd=99.0),
    )
    rows = requests(spark, *[
        dict(request_id=d, ts=utc(f"{d}T12:00:00"), input_tok=1_000_000) for d in ("2025-12-31", "2026-01-15", "2026-02-01")])
    got = costs(cost_requests(rows, p, tools(spark, dict(tool="t", usd_per_unit=1.0))))
    assert got == {"2025-12-31": 1.0, "2026-01-15": 99.0, "2026-02-01": 1.0}
    assert price_overlaps(p, "model").count() == 1
    assert [r.problem for r in validate_price_ranges(p, "model").collect()] == ["overlap"]


def test_view_ledger_values(spark):
    """Two requests with hand-computed costs: 0.946755 in total, 0.61617 the second."""
    p = price(spark, dict(model="a"))
    rows = requests(
        spark,
        dict(request_id="r1", session_id="s1", prompt_id="p1", input_tok=100_000, output_tok=10, cache_read_tok=100_000, cache_w5m_tok=100, cache_w1h_tok=10),
        dict(request_id="r2", session_id="s2", prompt_id="p2", input_tok=200_000, output_tok=20, cache_read_tok=50_000, cache_w5m_tok=200, cache_w1h_tok=20),
    )
    cost = cost_requests(rows, p, tools(spark, dict(tool="t", usd_per_unit=1.0)))
    got = costs(cost)
    assert got["r2"] == pytest.approx(0.61617) and sum(got.values()) == pytest.approx(0.946755)
    parts = sum(r.cost_usd for r in A.cost_components(cost).collect())
    assert parts == pytest.approx(0.946755)
    assert sum(r.cost_usd for r in A.daily(cost, "UTC").collect()) == pytest.approx(0.946755)


def test_time_zone_decides_the_day(spark):
    p = price(spark, dict(model="a"))
    rows = requests(
        spark, dict(request_id="r1", ts=utc("2026-07-19T16:00:00")), dict(request_id="r2", ts=utc("2026-07-20T15:00:00")))
    w = Window(D(2026, 7, 20), D(2026, 7, 20))
    def ids(tz):
        return [r.request_id for r in A.period_filter(rows, w, tz).collect()]
    assert ids("UTC") == ["r2"] and ids("Asia/Tokyo") == ["r1"]


def test_load_prices_fills_defaults(spark, tmp_path):
    doc = {
        "source_url": "list", "defaults": {"cache_read_x": 0.1, "cache_w5m_x": 1.25, "cache_w1h_x": 2.0, "batch_x": 0.5, "fast_x": 1.0, "geo_us_x": 1.0},
        "models": [{"model": "a", "valid_from": "2026-01-01", "in_usd": 1.0, "out_usd": 2.0, "fast_x": 6.0}],
        "server_tools": [{"tool": "t", "valid_from": "2026-01-01", "valid_to": "2026-02-01", "usd_per_unit": 0.5}],
    }
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    models, tool = load_prices(spark, str(tmp_path / "p.json"))
    m, t = models.first(), tool.first()
    assert (m.model, m.fast_x, m.cache_w1h_x, m.valid_to, m.source_url) == ("a", 6.0, 2.0, None, "list")
    assert (t.tool, t.valid_to, t.usd_per_unit) == ("t", D(2026, 2, 1), 0.5)


@pytest.mark.parametrize("models,problem", [
    ([], "no model prices"),
    ([("a", "2026-01-01", "2026-03-01"), ("a", "2026-02-01", None)], "overlap"),
    ([("a", "2026-01-01", "2026-01-01")], "a from 2026-01-01"),
])
def test_load_prices_refuses_wrong_lists(spark, tmp_path, models, problem):
    doc = {"models": [{"model": m, "valid_from": a, "valid_to": b, "in_usd": 1.0, "out_usd": 2.0} for m, a, b in models], "server_tools": []}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match=problem):
        load_prices(spark, str(tmp_path / "p.json"))


def test_a_long_list_of_tool_rates_is_refused_inside_the_scan_and_joined_on_request(spark):
    p, rows = price(spark, dict(model="s")), requests(spark, dict(model="s", server_tool_use=json.dumps({"t7": 2})))
    long = tools(spark, *[dict(tool=f"t{k}", usd_per_unit=0.01) for k in range(MOST_TOOL_RATES + 1)])
    with pytest.raises(Exception, match="tool rates"):
        cost_requests(rows, p, long).collect()
    assert costs(cost_requests(rows, p, long, server_tool_cost(rows, long))) == {"r": pytest.approx(0.02)}


def test_overlaps_pair_counted_periods_and_repeat_each_pair(spark):
    early, late, apart = (D(2026, 1, 1), None), (D(2026, 2, 1), D(2026, 2, 5)), (D(2026, 3, 1), D(2026, 3, 2))
    rows = [("a", *early)] * 70 + [("a", *late)] * 80 + [("b", *late)] * 3 + [("b", *apart)] * 3
    found = price_overlaps(spark.createDataFrame(rows, "model string, valid_from date, valid_to date"), "model")
    assert [tuple(r) for r in found.groupBy(*found.columns).count().collect()] == [("a", early[0], late[0], 5600)]
    joined = found._jdf.queryExecution().optimizedPlan().toString().split("Join ", 1)[1]
    assert joined.count("Aggregate") == 2  # equal periods are counted before they meet
