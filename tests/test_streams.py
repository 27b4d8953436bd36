"""Streams over several files, out of order and restarted, against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row, functions as F

from usageloom.operators import merge as M
from usageloom.operators.pricing import cost_requests
from usageloom.sources import sinks
from usageloom.streaming import requests as SR, state as ST, windows as SW

AT = dt.datetime(2024, 1, 1, 12)
USAGE = ("seq struct<path: string, block: bigint, line: bigint>, path string, request_id string, message_id string, session_id string, agent_id string, lineage_id string, "
         "ts timestamp, model string, input_tok bigint, output_tok bigint, cache_read_tok bigint, cache_w5m_tok bigint, cache_w1h_tok bigint, server_tool_use string, "
         "service_tier string, speed string, geo string, stop_reason string, is_synthetic int")


def add_file(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def test_records_far_apart_become_one_priced_request(spark, tmp_path):
    """Ten minutes apart, shuffled over four files, one file per batch, a restart, and a batch that is written twice."""
    pick = random.Random(5)
    rows = []
    for k in range(12):
        for j in range(pick.choice([1, 2, 3, 5])):
            path = f"p/{k % 3}.jsonl" if j < 3 else "p/copy.jsonl"
            rows.append(((path, 0, 100 * k + j), path, f"r{k}", f"m{k}", "s", None, "s", AT + dt.timedelta(minutes=10 * j + k, days=k % 3), "x-1",
                         100 + j, pick.randrange(50), 7, 5, 3, '{"search": 2}' if j == 0 else None, "standard", "fast" if k % 2 else None, "us-east", pick.choice([None, "end_turn", "tool_use"]), 0))
    pick.shuffle(rows)
    source, target = f"{tmp_path}/in", f"{tmp_path}/ledger"
    write = SR.request_writer(target)

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    for run in range(2):
        for part in range(2):
            add_file(spark, source, rows[2 * run + part::4], USAGE, f"{run}{part}")
        parts = SR.stream_request_parts(SW.stream_parquet(spark, f"{source}/*", spark.createDataFrame([], USAGE).schema, 1), "10 days")
        SW.for_each_batch(parts, twice, f"{tmp_path}/checkpoint", "update").awaitTermination()
    prices = spark.createDataFrame([("x-1", dt.date(2023, 1, 1), None, 3.0, 15.0, 0.1, 1.25, 2.0, 0.5, 2.0, 1.2)],
                                   "model string, valid_from date, valid_to date, in_usd double, out_usd double, cache_read_x double, cache_w5m_x double, cache_w1h_x double, "
                                   "batch_x double, fast_x double, geo_us_x double")
    tools = spark.createDataFrame([("search", dt.date(2023, 1, 1), None, 0.01)], "tool string, valid_from date, valid_to date, usd_per_unit double")
    batch = M.merge_requests(spark.createDataFrame(rows, USAGE).withColumn("prompt_id", F.lit(None).cast("string")))
    live = sinks.read_ledger(spark, target, "request").select(batch.columns)
    columns = [*batch.columns, "cost_usd"]
    want, got = (sorted(map(str, cost_requests(df, prices, tools).select(columns).collect())) for df in (batch, live))
    assert len(want) == 12 and got == want and "cost_usd=None" not in " ".join(want)


HOOKS = "session_id string, ts timestamp, kind string, total_cost_usd double"


def run_over_files(spark, tmp_path, slices, schema, build, **options):
    for k, rows in enumerate(slices):
        add_file(spark, f"{tmp_path}/in", rows, schema, f"{k}")
        stream = SW.stream_parquet(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, 1)
        out = SW.run_available(build(stream), "test", f"{tmp_path}/run", **options)
    return out


def seconds(n):
    return AT + dt.timedelta(seconds=n)


def test_inflight_in_any_order_inside_the_watermark(spark, tmp_path):
    """An older sample or prompt never overwrites newer state."""
    rows = [("s", seconds(0), "statusline_sample", 1.0), ("s", seconds(10), "UserPromptSubmit", None), ("s", seconds(12), "statusline_sample", 1.5),
            ("s", seconds(20), "Stop", None), ("s", seconds(29), "statusline_sample", 2.0), ("s", seconds(30), "UserPromptSubmit", None), ("s", seconds(40), "statusline_sample", 2.75)]
    order = [6, 5, 0, 3, 1, 4, 2]
    out = run_over_files(spark, tmp_path, [[rows[k] for k in order[:3]], [rows[k] for k in order[3:5]], [rows[k] for k in order[5:]]], HOOKS, ST.inflight_stream)
    got = ST.latest_of(out).collect()
    assert [(r.session_id, r.is_open, r.inflight_usd) for r in got] == [("s", True, 0.75)]


def test_inflight_state_is_gone_after_silence(spark, tmp_path):
    first = [("s", seconds(0), "statusline_sample", 1.0), ("s", seconds(1), "UserPromptSubmit", None)]
    other = [("t", seconds(7200), "UserPromptSubmit", None)]
    again = [("s", seconds(7300), "statusline_sample", 9.0), ("t", seconds(9000), "Stop", None)]
    out = run_over_files(spark, tmp_path, [first, other, again], HOOKS, lambda df: ST.inflight_stream(df, "1 minute", 1800))
    last = {r.session_id: r for r in ST.latest_of(out).collect()}
    assert (last["s"].prompt_us, last["s"].is_open) == (None, False) and not last["t"].is_open


REQ = "session_id string, request_id string, agent_id string, ts timestamp, input_tok bigint, cache_read_tok bigint, cache_w5m_tok bigint, cache_w1h_tok bigint"


def test_cache_state_in_any_order_then_expiry_then_forgotten(spark, tmp_path):
    def request(n, at, read, w5, w1):
        return ("s", f"r{n}", None, seconds(at), 10, read, w5, w1)

    newer, older, oldest = request(3, 200, 50, 0, 0), request(2, 100, 0, 7, 0), request(1, 0, 0, 0, 9)
    tick = ("other", "x", None, seconds(500), 1, 0, 0, 0)
    late = ("other", "y", None, seconds(20_000), 1, 0, 0, 0)
    out = run_over_files(spark, tmp_path, [[newer], [oldest], [older], [tick], [late], [request(9, 20_100, 5, 0, 0)]], REQ, lambda df: ST.cache_state_stream(df, "4 minutes", 3600))
    mine = [(r.status, r.ttl_kind, r.context_tok, r.expires_us) for r in out.where("session_id = 's'").orderBy("as_of_us", "version").collect()]
    base = int(AT.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    # The 5-minute write counts from the request that used it last; once forgotten, nothing is known of it.
    assert mine[-4:] == [("live", "1h", 60, base + 3_800_000_000), ("live", "5m", 60, base + 500_000_000), ("expired", "5m", 60, base + 500_000_000), ("none", "unknown", 15, None)]


def test_throttle_equals_the_loop_over_late_samples(spark, tmp_path):
    pick = random.Random(2)
    every = sorted(pick.sample(range(0, 600), 120))
    rows = [("s", seconds(n), "statusline_sample", 1.0) for n in every]
    slices = [[], [], [], [("t", seconds(2000), "statusline_sample", 1.0)]]
    for n, row in zip(every, rows):
        slices[min(2, max(0, (n + pick.randrange(-80, 80)) // 200))].append(row)
    out = run_over_files(spark, tmp_path, slices, HOOKS, lambda df: ST.throttle_stream(df, 15, "3 minutes"))
    kept, last = [], None
    for n in every:
        if last is None or n - last >= 15:
            last = n
            kept.append(n)
    base = int(AT.replace(tzinfo=dt.timezone.utc).timestamp())
    assert sorted(r.kept_s - base for r in out.where("session_id = 's'").collect()) == kept


@pytest.mark.parametrize("carried", [None, [("a", "p0")]])
def test_carry_starts_from_the_ledger(spark, tmp_path, carried):
    schema = "lineage_id string, ord bigint, is_user boolean, own_prompt string, request_id string"
    start = None if carried is None else spark.createDataFrame(carried, "lineage_id string, prompt_id string")
    slices = [[("a", 1, False, None, "r1"), ("b", 1, False, "px", "r2")], [("a", 2, True, "p1", None), ("a", 3, False, None, "r3")], [("a", 4, False, None, "r4"), ("b", 2, False, None, "r5")]]
    out = run_over_files(spark, tmp_path, slices, schema, lambda df: ST.carry_prompt_stream(df, start), idle_batches=False)
    first = None if carried is None else "p0"
    assert sorted((r.request_id, r.prompt_id) for r in out.collect()) == [("r1", first), ("r2", "px"), ("r3", "p1"), ("r4", "p1"), ("r5", None)]


def test_carry_takes_and_gives_plain_rows():
    """No pandas frame per lineage and batch."""
    class Kept:
        now = ("p0",)

        def get(self):
            return self.now

        def update(self, value):
            self.now = value

    carry = ST._CarryPrompt(1)
    carry.current = Kept()
    given = [Row(lineage_id="a", ord=3, is_user=False, own_prompt=None, request_id="r3"), Row(lineage_id="a", ord=1, is_user=False, own_prompt=None, request_id="r1"),
             Row(lineage_id="a", ord=2, is_user=True, own_prompt="p1", request_id=None)]
    assert [tuple(r) for r in carry.handleInputRows(("a",), iter(given), None)] == [("r1", 1, "p0"), ("r3", 3, "p1")]
    assert carry.current.now == ("p1",)
