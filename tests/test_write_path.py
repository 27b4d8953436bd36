"""The write path on derived lines: files per project, lines parsed once."""

import pathlib

import pytest

from usageloom import session
from usageloom.catalog import load

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no driver tables")
QUERIES = load().QUERIES


def test_a_project_is_written_by_one_task(spark, tmp_path, monkeypatch):
    from usageloom.catalog import ingest

    monkeypatch.setattr(ingest, "shared_dir", lambda _spark: str(tmp_path))
    QUERIES["s01_read_transcripts"](spark, FOLDER).collect()
    folders = list(tmp_path.glob("usageloom/s01*/project=*"))
    assert folders and all(len(list(f.glob("*.txt"))) == 1 for f in folders)


@pytest.mark.parametrize("name", ["t04_mark_interrupted", "t06_merge_tool_calls", "t08_merge_agents", "t15_regime_events"])
def test_tables_read_the_stored_records_instead_of_parsing_again(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json(StructField(type" not in plan and "StructsToJsonEvaluator(Map(),StructType(StructField(type" not in plan


def test_a_filter_on_records_parses_no_line_again(spark):
    from usageloom.operators import merge as M
    from usageloom.sources import ingest as I

    raw = spark.createDataFrame([("p/s.jsonl", ("p/s.jsonl", 0, 1), "{}")], "path string, seq struct<path: string, block: bigint, line: bigint>, value string")
    plan = M.normalize_usage(I.parse(raw).good)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(type") == 1


def test_carrying_prompts_parses_no_line_again(spark):
    from usageloom.sources import ingest as I

    raw = spark.createDataFrame([("p/s.jsonl", ("p/s.jsonl", 0, 1), "{}")], "path string, seq struct<path: string, block: bigint, line: bigint>, value string")
    plan = I.parse(raw).usage._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json(StructField(type" not in plan


def test_causal_rounds_send_no_table_through_the_driver(spark):
    from usageloom.operators import attribution as AT

    nodes = spark.createDataFrame([("agent", "a1", None, True, "p1", "p2", None)], "kind string, node string, on_agent string, has_request boolean, work string, call string, moved string")
    notes = spark.createDataFrame([("p1", "t1", "a1", "p1")], "prompt_id string, tool_use_id string, agent_id string, at string")
    for df in AT._round(nodes, notes):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["s10_write_ledger", "s10_incremental"])
def test_requests_of_the_ledger_are_stored_once_and_without_contents(spark, monkeypatch, name):
    """Batches of merged requests go into the ledger as they are, and no step before them stores texts of records."""
    import parity

    from usageloom.sources import ingest, sinks

    registry = load()
    kept = {"sinks": [], "ingest": []}
    for module, stored in ((sinks, kept["sinks"]), (ingest, kept["ingest"])):
        monkeypatch.setattr(module, "cut_lineage", lambda df, stored=stored: stored.append(df.schema.simpleString()) or session.cut_lineage(df))
    ok, message = parity.compare(spark, name, QUERIES[name], registry.SQL[name], FOLDER, parity.connect(FOLDER))
    assert ok, message
    assert not any("output_tok" in schema for schema in kept["sinks"])
    assert kept["ingest"] and not any("content:" in schema or "toolUseResult" in schema for schema in kept["ingest"])
