"""Temporal operators against brute force, with keys split into many small buckets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from usageloom.functions.quantiles import exact_quantiles, global_rank
from usageloom.operators import temporal as T

BUCKET = 50


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # One key holds a third of the rows; times repeat.
    return [(rng.choice(["hot", "hot", "hot"] + [f"k{i}" for i in range(6)]), rng.randrange(2000), f"r{i:04d}", rng.random() < 0.1)
            for i in range(900)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, t bigint, id string, flag boolean").repartition(5).cache()


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_previous_and_next(frame, rows):
    prev = {r.id: r.prev.id if r.prev else None for r in T.with_previous(frame, "key", F.col("t"), "id", ["id"], BUCKET).collect()}
    nxt = {r.id: r.next.id if r.next else None for r in T.with_next(frame, "key", F.col("t"), "id", ["id"], BUCKET).collect()}
    want_prev, want_next = {}, {}
    for seq in by_key(rows).values():
        for i, r in enumerate(seq):
            want_prev[r[2]] = seq[i - 1][2] if i else None
            want_next[r[2]] = seq[i + 1][2] if i + 1 < len(seq) else None
    assert prev == want_prev and nxt == want_next


def test_seen_within(frame, rows):
    got = {r.id: r.seen for r in T.with_seen_within(frame, "key", F.col("t"), F.col("flag"), 60).collect()}
    both = {r.id: (r.seen, r.prev.id if r.prev else None)
            for r in T.with_previous_and_seen(frame, "key", F.col("t"), "id", ["id"], F.col("flag"), 60).collect()}
    groups = by_key(rows)
    for k, t, i, _ in rows:
        want = any(f and u < t and t - u < 60 for _, u, _, f in groups[k])
        seq = [r[2] for r in groups[k]]
        at = seq.index(i)
        assert got[i] == want and both[i] == (want, seq[at - 1] if at else None)


def test_last_non_null(frame, rows):
    df = frame.withColumn("v", F.when(F.col("flag"), F.col("id"))).withColumn("b", F.floor(F.col("t") / 100))
    got = {r.id: r.filled for r in T.last_non_null(df, "key", ("b", "t", "id"), ("b",), "v", "filled").collect()}
    for seq in by_key(rows).values():
        last = None
        for r in seq:
            last = r[2] if r[3] else last
            assert got[r[2]] == last


def test_asof_and_channels(spark, frame, rows):
    rng = random.Random(9)
    right = [(rng.choice(["hot", "k0", "k1", None]), rng.randrange(2000), f"x{i:03d}", i % 2) for i in range(150)]
    r = spark.createDataFrame(right, "key string, u bigint, name string, odd int")
    got = {x.id: x.match.name if x.match else None
           for x in T.asof_backward(frame, r, "key", F.col("t"), F.col("u"), "name", ["name"], bucket_us=BUCKET).collect()}
    both = {x.id: (x.a, x.b) for x in T.latest_per_channel(
        frame, r, "key", F.col("t"), F.col("u"),
        {"a": F.when(F.col("odd") == 1, F.col("u")), "b": F.when(F.col("odd") == 0, F.col("u"))}, BUCKET).collect()}
    for k, t, i, _ in rows:
        seen = [x for x in right if x[0] == k and x[1] <= t]
        assert got[i] == (max(seen, key=lambda x: (x[1], x[2]))[2] if seen else None)
        assert both[i] == tuple(max((x[1] for x in seen if x[3] == odd), default=None) for odd in (1, 0))


def test_band_join(spark, frame, rows):
    starts = [("hot", 100), ("hot", 777), ("k1", 1500)]
    s = spark.createDataFrame(starts, "key string, s bigint")
    pairs = T.band_join(s, frame.select("key", "t", "id"), "key", F.col("s"), 60, F.col("t")).collect()
    got = sorted((p.key, p.s, p.id) for p in pairs)
    assert got == sorted((k, a, i) for k, a in starts for kk, t, i, _ in rows if kk == k and a < t <= a + 60)


def test_exact_quantiles_with_a_hot_group(spark):
    rng = random.Random(3)
    data = [("hot", round(rng.expovariate(1.0), 6)) for _ in range(3000)] + [("hot", 0.25)] * 1500
    data += [("small", v) for v in (-3.0, 1.0, 10.0)] + [("one", 4.0), ("none", None), (None, 7.0)]
    df = spark.createDataFrame(data, "g string, v double")
    ps = (0.0, 0.5, 0.9, 0.99, 1.0)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", ps, [f"q{i}" for i in range(5)]).collect()}
    assert set(got) == {"hot", "small", "one", None}
    for g in got:
        values = sorted(v for k, v in data if k == g and v is not None)
        for i, p in enumerate(ps):
            point = (len(values) - 1) * p
            lo = int(point)
            hi = min(lo + 1, len(values) - 1)
            assert got[g][f"q{i}"] == pytest.approx(values[lo] + (values[hi] - values[lo]) * (point - lo))
        assert got[g].n == len(values)


def test_global_rank(spark):
    data = [(i % 7 * 1.0, f"p{i:03d}") for i in range(200)]
    df = spark.createDataFrame(data, "v double, id string").repartition(6)
    got = {r.id: (r["rank"], r.total) for r in global_rank(df, [F.desc("v"), F.asc("id")]).collect()}
    order = sorted(data, key=lambda r: (-r[0], r[1]))
    assert got == {r[1]: (n + 1, 200) for n, r in enumerate(order)}


@pytest.mark.parametrize("batch_rows", [7, 10_000])
def test_throttle_of_a_long_burst_equals_the_loop(spark, batch_rows):
    """Two days of samples every five seconds without a pause, in small batches too; repeated and unordered rows."""
    from usageloom.operators.pointintime import throttle_seconds

    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    seconds = [k * 5 + (k * k) % 3 for k in range(34_560)] if batch_rows > 7 else [k * 5 + (k * k) % 3 for k in range(500)]
    rows = [("s", start + dt.timedelta(seconds=n)) for n in seconds] + [("t", start), ("t", start + dt.timedelta(seconds=14)), ("t", start + dt.timedelta(seconds=15)), ("t", start)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        got = throttle_seconds(spark.createDataFrame(rows[::-1], "session_id string, ts timestamp"), 15).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, last = [], None
    for n in seconds:
        if last is None or n - last >= 15:
            last = n
            want.append(n)
    base = int(start.timestamp())
    assert sorted(r.kept_s - base for r in got if r.session_id == "s") == want
    assert sorted(r.kept_s - base for r in got if r.session_id == "t") == [0, 15]
