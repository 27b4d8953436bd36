"""Registered queries against their DuckDB twins.

By default a selection runs on the smallest tables; ``USAGELOOM_PARITY=all`` runs
every query, ``USAGELOOM_SF_DIR`` chooses the folder.
"""

import os
import pathlib

import duckdb
import parity
import pytest

from usageloom.catalog import load

FOLDER = os.environ.get("USAGELOOM_SF_DIR", "/root/testdata/sf0.001")
CORE = (
    "j01_cost_requests", "a01_prompt_cost", "a07_project_rollup", "a13_startup_summary", "k01_top_prompts",
    "w01_cache_identity", "a19_cache_sessions", "a21_cost_quantiles", "a23_top_decile_profile",
    "a25_trend_distribution", "a27_period_change", "a28_overview_kpis", "t04_mark_interrupted",
    "t06_merge_tool_calls", "t12_extract_prompts", "t13_redact", "t10_causal_attribution", "t16_rejected",
    "t18_attribute_commits", "t20_classify_nudges", "r02_pace_landing", "r07_fire_nudges", "r10_stream_requests",
    "r11_stream_daily", "s05_read_otlp",
)
REGISTRY = load()
NAMES = list(REGISTRY.QUERIES) if os.environ.get("USAGELOOM_PARITY") == "all" else CORE
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return parity.connect(FOLDER)


def test_every_query_has_sql():
    assert set(REGISTRY.QUERIES) == set(REGISTRY.SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, message = parity.compare(spark, name, REGISTRY.QUERIES[name], REGISTRY.SQL.get(name), FOLDER, con)
    assert ok, message


def test_cache_state_of_requests_at_one_instant_equals_sql(spark, tmp_path):
    """Every event stands three times at its instant: the largest request id counts on both sides."""
    copies = duckdb.sql(f"SELECT e.* REPLACE (event_id + k * 1000 AS event_id) FROM '{FOLDER}/events.parquet' e, range(3) r(k)")
    copies.write_parquet(str(tmp_path / "events.parquet"))
    name = "r04_cache_state_stream"
    ok, message = parity.compare(spark, name, REGISTRY.QUERIES[name], REGISTRY.SQL[name], str(tmp_path), parity.connect(str(tmp_path)))
    assert ok, message


def test_cache_state_of_requests_that_touch_no_cache_equals_sql(spark, tmp_path):
    """A session whose cache expired before its last request, which neither read nor wrote, has expired."""
    rows = duckdb.sql(f"SELECT e.* REPLACE (CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS value) FROM '{FOLDER}/events.parquet' e")
    rows.write_parquet(str(tmp_path / "events.parquet"))
    name = "r04_cache_state_stream"
    ok, message = parity.compare(spark, name, REGISTRY.QUERIES[name], REGISTRY.SQL[name], str(tmp_path), parity.connect(str(tmp_path)))
    assert ok, message
