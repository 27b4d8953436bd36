"""Raw records on disk through the write path."""

import gzip
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from test_pricing import price
from usageloom.fixed_values import SECRET_PATTERNS
from usageloom.functions.jsontext import spaced_ascii_json_length
from usageloom.functions.redaction import redact
from usageloom.operators import merge as M
from usageloom.sources import ingest as I, manifest as MF, sinks, transcripts as S
from usageloom.streaming import windows as SW


def at(s):
    return f"2026-07-20T12:00:{s:02d}.000Z"


def assistant(rid, s, out, stop=None, **kw):
    usage = {"input_tokens": 3, "output_tokens": out, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 7}
    return {"type": "assistant", "timestamp": at(s), "requestId": rid, "version": "1.0", **kw,
            "message": {"id": "m" + rid, "model": "a-20260101", "usage": usage, "stop_reason": stop, "content": []}}


def user(s, **kw):
    content = kw.pop("content", "hello")
    return {"type": "user", "timestamp": at(s), "message": {"role": "user", "content": content}, **kw}


def write(root, name, records):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n"
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)


@pytest.fixture
def root(tmp_path):
    write(tmp_path, "proj/s1.jsonl", [
        user(1, promptId="p1", content="fix it"),
        assistant("r1", 2, 10), "", assistant("r1", 3, 50, "end_turn"),
        user(4, interruptedMessageId="mr1", promptId="p1", content="[Request interrupted by user]"),  # after its stop reason
        assistant("r2", 5, 200),
        user(6, interruptedMessageId="mr2"),  # never stopped
        assistant("r3", 7, 100), user(8, interruptedMessageId="mr3"), assistant("r3", 9, 200, "end_turn"),
        {"type": "summary"}, {"type": "strange"}, "{broken",
        {"type": "assistant", "timestamp": at(10), "message": {"id": "x"}},
    ])
    write(tmp_path, "proj/s1/subagents/agent-abc1.jsonl", [assistant("r4", 11, 5, "end_turn")])
    write(tmp_path, "proj/s2.jsonl", [assistant("r1", 30, 60, "end_turn")])  # a copy in another file
    return tmp_path


def test_merge_and_interruption(spark, root):
    p = I.parse(S.read_transcripts(spark, str(root)))
    got = {r.request_id: r for r in I.merged_requests(p).collect()}
    assert {k: (r.output_tok, r.is_interrupted) for k, r in got.items()} == {
        "r1": (60, 1), "r2": (None, 1), "r3": (200, 1), "r4": (5, 0)}
    r1 = got["r1"]
    assert (r1.session_id, r1.prompt_id, r1.model, r1.cache_w1h_tok, r1.raw_path) == ("s1", "p1", "a", 7, "proj/s1.jsonl")
    assert r1.end_ts.second == 3  # the copy's later time belongs to another file
    assert (got["r4"].agent_id, got["r4"].lineage_id, got["r4"].prompt_id) == ("abc1", "s1/abc1", None)
    reasons = sorted(r.reason for r in p.bad.collect())
    assert reasons == ["assistant record missing request id or usage", "invalid JSON", "unknown transcript record type: strange"]


def test_whole_path_is_a_function_of_the_lines(spark, root, tmp_path):
    raw = S.read_transcripts(spark, str(root))
    prices = price(spark, dict(model="b"))
    once = I.build_ledger(raw, prices)
    shuffled = I.build_ledger(raw.repartition(7), prices)
    for name in ("request", "session", "prompt", "regime_event"):
        a, b = (sorted(map(str, t[name].collect())) for t in (once, shuffled))
        assert a == b and a
    sinks.write_ledger({"request": once["request"]}, str(tmp_path / "out"))
    first = sorted(map(str, sinks.read_ledger(spark, str(tmp_path / "out"), "request").collect()))
    sinks.write_ledger({"request": once["request"]}, str(tmp_path / "out"))
    assert first == sorted(map(str, sinks.read_ledger(spark, str(tmp_path / "out"), "request").collect()))


def test_prompt_text_and_late_marker(spark, root):
    p = I.parse(S.read_transcripts(spark, str(root)))
    r = M.extract_prompts(p.good).first()
    assert (r.prompt_id, r.text, r.interrupted_message_id) == ("p1", "fix it", "mr1")


def test_compressed_lines_and_line_order(spark, tmp_path):
    write(tmp_path, "q/s.jsonl.gz", [user(i, promptId=f"p{i}") for i in range(50)])
    lines = S.read_lines(spark, str(tmp_path), "*.gz").orderBy("seq").collect()
    assert [json.loads(r.value)["promptId"] for r in lines] == [f"p{i}" for i in range(50)]
    assert lines[0].path == "q/s.jsonl.gz"


def test_quarantine_stream(spark, root, tmp_path):
    lines = SW.stream_lines(spark, str(root), "*.jsonl")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    SW.for_each_batch(lines, SW.quarantine_writer(good, bad), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(good).count() == 11 and spark.read.parquet(bad).count() == 3


def test_redaction_equals_sequential_replacement(spark):
    rng = random.Random(1)
    secrets = ["sk-ant-" + "a" * 24, "sk-proj-" + "B" * 30, "ghp_" + "c" * 36, "AKIA" + "D" * 16, "xoxb-1234567890ab", "AIza" + "e" * 35,
               "Authorization: Bearer " + "f" * 20 + "==", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
               "aws_secret_access_key = " + "g" * 40, "eyJ" + "h" * 12 + "." + "i" * 12 + "." + "j" * 12, "plain", "é ", "sk-" + "a" * 20 + "BBB"]
    texts = [" ".join(rng.choices(secrets, k=6)) + rng.choice(["", "\n"]) for _ in range(60)] + ["", "nothing here"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", redact("t").alias("r")).collect()
    for row in got:
        out, found = row.t, []
        for name, pattern in SECRET_PATTERNS:
            def token(m):
                tag = f"{name}:{hashlib.sha256(m.group(0).encode()).hexdigest()[:12]}"
                found.append(tag)
                return f"[REDACTED:{tag}]"
            out = re.sub(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""), token, out)
        assert (row.r.text, list(row.r.detections)) == (out, found)
    assert spark.createDataFrame([(None,)], "t string").select(redact("t")["text"].alias("x")).first().x is None


def test_json_length_counts_separators_and_escapes(spark):
    values = ["a b", "éÿ", "😀x", 'q"\\\n', ["a, b", {"k": 1, "z": [1, 2]}], {"a": None}]
    texts = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(spaced_ascii_json_length(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [len(json.dumps(v)) for v in values]


def test_manifest_hashes(spark, tmp_path):
    (tmp_path / "seg").mkdir()
    (tmp_path / "seg" / "a").write_bytes(b"one")
    (tmp_path / "seg" / "b").write_bytes(b"two")
    sha = hashlib.sha256
    rows = [("f", 1, 0, 3, "a", sha(b"one").hexdigest()), ("f", 1, 3, 6, "b", sha(b"bad").hexdigest()),
            ("f", 1, 7, 9, "c", "x"), ("f", 0, 5, 9, "old", "x")]
    m = spark.createDataFrame(rows, "path string, gen bigint, start bigint, end bigint, seg string, sha256 string")
    got = sorted((r.seg, r.problem) for r in MF.manifest_audit(m, MF.segment_hashes(spark, str(tmp_path / "seg"))).collect())
    assert got == [("b", "sha mismatch"), ("c", "gap"), ("c", "missing")]


def test_telemetry_fills_and_adds(spark):
    from test_pricing import requests

    req = requests(spark, dict(request_id="r1", effort="low"))
    otel = spark.createDataFrame(
        [("api_request", "r1", "s9", "high", 0.5, "2026-07-20 12:00:00", "r1"), ("api_request", "r2", "s9", "high", 0.7, "2026-07-20 12:00:00", "r2")],
        "kind string, request_id string, session_id string, effort string, cost_usd_sdk double, t string, dedup_key string",
    ).withColumn("ts", F.to_timestamp("t"))
    for c in ("prompt_id", "model", "query_source", "speed"):
        otel = otel.withColumn(c, F.lit(None).cast("string"))
    for c in ("input_tok", "output_tok", "cache_read_tok"):
        otel = otel.withColumn(c, F.lit(1).cast("bigint"))
    otel = otel.withColumn("cache_creation_tok", F.lit(9).cast("bigint")).withColumn("duration_ms", F.lit(4.0))
    got = {r.request_id: r for r in M.converge_otel(req, otel).collect()}
    assert (got["r1"].source, got["r1"].effort, got["r1"].cost_usd_sdk, got["r1"].api_duration_ms) == ("transcript", "low", 0.5, 4.0)
    assert (got["r2"].source, got["r2"].session_id, got["r2"].cache_w1h_tok, got["r2"].effort) == ("otel", "s9", 9, "high")
