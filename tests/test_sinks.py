"""Keyed batches into the ledger."""

import datetime as dt
import random

from pyspark.sql import functions as F

from usageloom.sources import sinks

AT = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
SCHEMA = "request_id string, session_id string, ts timestamp, output_tok bigint"


def rows(spark, *own):
    return spark.createDataFrame([(k, "s", AT + dt.timedelta(days=day), n) for k, day, n in own], SCHEMA)


def state(spark, path):
    back = sinks.read_ledger(spark, str(path), "request")
    assert back.where(F.col("utc_day") != F.to_date("ts")).count() == 0
    return sorted((r.request_id, (r.ts.replace(tzinfo=dt.timezone.utc) - AT.replace(hour=0)).days, r.output_tok) for r in back.collect())


def test_a_row_that_moves_leaves_its_day(spark, tmp_path):
    sinks.write_ledger({"request": rows(spark, ("r1", 0, 1), ("r2", 1, 2))}, str(tmp_path))
    sinks.write_ledger({"request": rows(spark, ("r2", 0, 2))}, str(tmp_path))
    assert state(spark, tmp_path) == [("r1", 0, 1), ("r2", 0, 2)]


def test_other_rows_of_a_day_stay(spark, tmp_path):
    sinks.write_ledger({"request": rows(spark, ("r1", 0, 1))}, str(tmp_path))
    sinks.write_ledger({"request": rows(spark, ("r2", 0, 2))}, str(tmp_path))
    sinks.write_ledger({"request": rows(spark).limit(0)}, str(tmp_path))
    assert state(spark, tmp_path) == [("r1", 0, 1), ("r2", 0, 2)]


def test_random_batches_end_like_one_write(spark, tmp_path):
    rnd, last = random.Random(1), {}
    for _ in range(4):
        batch = [(f"r{k}", rnd.randrange(4), rnd.randrange(99)) for k in rnd.sample(range(20), 8)]
        last |= {k: (k, day, n) for k, day, n in batch}
        for _ in range(rnd.choice([1, 2])):
            sinks.write_ledger({"request": rows(spark, *batch)}, str(tmp_path))
        assert state(spark, tmp_path) == sorted(last.values())


def test_columns_added_later_and_tables_without_time(spark, tmp_path):
    sinks.write_ledger({"request": rows(spark, ("r1", 0, 1)), "agent": spark.createDataFrame([("s", "a", 1)], "session_id string, agent_id string, x int")}, str(tmp_path))
    sinks.write_ledger({"request": rows(spark, ("r2", 1, 2)).withColumn("geo", F.lit("us")),
                        "agent": spark.createDataFrame([("s", "b", 2), ("s", "a", 3)], "session_id string, agent_id string, x int")}, str(tmp_path))
    back = sinks.read_ledger(spark, str(tmp_path), "request")
    assert sorted((r.request_id, r.geo) for r in back.collect()) == [("r1", None), ("r2", "us")]
    assert sorted((r.agent_id, r.x) for r in sinks.read_ledger(spark, str(tmp_path), "agent").collect()) == [("a", 3), ("b", 2)]


def test_a_key_twice_in_a_batch_leaves_its_latest_row(spark, tmp_path):
    batch = rows(spark, ("r1", 0, 1), ("r1", 2, 3), ("r1", 1, 2), ("r2", 0, 5), (None, 0, 7), (None, 0, 7))
    for _ in range(2):
        sinks.write_ledger({"request": batch.repartition(3)}, str(tmp_path))
        back = sinks.read_ledger(spark, str(tmp_path), "request").select("request_id", "output_tok", F.dayofmonth("utc_day")).collect()
        assert sorted(map(tuple, back), key=str) == [("r1", 3, 3), ("r2", 5, 1), (None, 7, 1)]


def test_an_emptied_day_is_empty_and_can_fill_again(spark, tmp_path):
    for day in (0, 3, 0):
        sinks.write_ledger({"request": rows(spark, ("r1", day, day))}, str(tmp_path))
        assert state(spark, tmp_path) == [("r1", day, day)]


def test_only_touched_days_are_read_and_rewritten(spark, tmp_path):
    sinks.write_ledger({"request": rows(spark, *[(f"r{d}", d, d) for d in range(5)])}, str(tmp_path))
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("rows/*/*.parquet")}
    sinks.write_ledger({"request": rows(spark, ("r1", 2, 9))}, str(tmp_path))
    left = {p.parent.name for p in files if p.exists() and p.stat().st_mtime_ns == files[p]}
    assert left == {"utc_day=2024-01-01", "utc_day=2024-01-04", "utc_day=2024-01-05"}
    assert state(spark, tmp_path) == [("r0", 0, 0), ("r1", 2, 9), ("r2", 2, 2), ("r3", 3, 3), ("r4", 4, 4)]


def test_a_stored_batch_is_not_stored_again(spark, tmp_path, monkeypatch):
    stores = []
    monkeypatch.setattr(sinks, "cut_lineage", lambda df, own=sinks.cut_lineage: stores.append(df.columns) or own(df))
    for day, n in ((0, 1), (0, 2), (3, 3)):
        sinks.write_ledger({"request": rows(spark, ("r1", day, n))}, str(tmp_path), stored=True)
        assert state(spark, tmp_path) == [("r1", day, n)]
    assert not [c for c in stores if "output_tok" in c]


def test_a_table_without_key_is_written_without_being_stored_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "cut_lineage", None)
    sinks.write_ledger({"request": rows(spark, ("r1", 0, 1), ("r1", 0, 1), ("r2", 3, 2))}, str(tmp_path), {})
    sinks.write_ledger({"request": rows(spark, ("r3", 0, 3))}, str(tmp_path), {})
    assert state(spark, tmp_path) == [("r2", 3, 2), ("r3", 0, 3)]
