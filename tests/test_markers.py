"""Marker overlap against trying all pairs."""

import datetime as dt
import random

import pytest

from usageloom.model import Window
from usageloom.plans.trend import marker_overlap

UTC = dt.timezone.utc
DAY0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


def expected(rows, w):
    lo, hi = w.instants("UTC")
    kept = [(k, s, e or hi) for k, s, e in rows if s < hi and (e or hi) >= lo]
    out = {}
    for k, s, e in kept:
        after = min(e, s + dt.timedelta(days=7), hi)
        out[k] = int(any(o != k and s2 < after and e2 > s for o, s2, e2 in kept))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_overlap(spark, seed):
    rnd = random.Random(seed)
    at = lambda h: DAY0 + dt.timedelta(hours=h)
    rows = [("a", at(24), at(72)), ("b", at(24), at(24)), ("c", at(240), at(288))] if not seed else []
    for k in range(60 if seed else 0):
        start = rnd.randrange(0, 480, 6)
        rows.append((f"m{k}", at(start), None if rnd.random() < 0.1 else at(start + rnd.choice([0, 0, 0, 1, 6, 30, 300]))))
    w = Window(dt.date(2024, 1, 2), dt.date(2024, 1, 18))
    frame = spark.createDataFrame([(k, "x", s, e) for k, s, e in rows], "marker_id string, category string, ts_start timestamp, ts_end timestamp")
    assert {r.marker_id: r.overlaps for r in marker_overlap(frame, w, "UTC").collect()} == expected(rows, w)
