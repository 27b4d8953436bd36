"""Nearest neighbours, mixing and license scans against plain Python."""

import math
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, clashing, empty, words  # noqa: E402

from usageloom.llm import licenses, mixing, neighbours  # noqa: E402


def _nearest(rows, queries, k):
    usable = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in sorted({i: v for i, v in reversed(usable) if i in queries}.items()):
        found = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, v))), i) for i, v in usable if i != q and len(v) == len(x))
        out[q] = found[:k]
    return out


@pytest.mark.parametrize("chunk", [2_048, 7])
def test_nearest_against_all_pairs(spark, chunk):
    rng = np.random.default_rng(4)
    rows = [(int(k), rng.normal(size=8).astype(np.float32).tolist()) for k in range(400)]
    rows += [(400 + k, rows[k][1]) for k in range(60)]  # ties
    rows += [(600 + k, [float(x) * 10 ** (k - 3) for x in rng.normal(size=8)]) for k in range(8)]
    rows += [(700, None), (701, []), (702, [0.0] * 8), (703, [1.0] * 7 + [None]), (704, [float("nan")] * 8), (705, [float("inf")] * 8), (706, [1.0, 2.0]), (710, [1.0, 3.0])]
    docs = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(6)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    asked = {i for i, _ in rows if i % 10 == 0}
    out = neighbours.nearest(docs, docs.where("vec_id % 10 = 0"), k=10, chunk=chunk).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(found.setdefault(r["query_id"], [])) + 1
        found[r["query_id"]].append((r["score"], r["vec_id"]))
    expected = _nearest(exact, asked, 10)
    assert set(found) == {q for q, own in expected.items() if own}
    for q, own in found.items():
        assert [i for _, i in own] == [i for _, i in expected[q]]
        assert [s for s, _ in own] == pytest.approx([s for s, _ in expected[q]], rel=1e-12)
    assert neighbours.nearest(docs.limit(0), docs.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for dim in (1, 3, 64, 1_500):
        x, y = rng.normal(size=(20, dim)) * rng.lognormal(0, 3, (20, 1)), rng.normal(size=(30, dim)) * rng.lognormal(0, 3, (30, 1))
        low, high = neighbours.bounds(neighbours.Block(np.arange(20), x), neighbours.Block(np.arange(30), y))
        true = ((x[:, None] - y) ** 2).sum(axis=2)
        assert (low <= true).all() and (true <= high).all()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.floats(0, 1), st.sampled_from([3, 30, 1_000]))
def test_budget_is_met_as_well_as_any_subset_can(counts, part, window):
    lengths, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    budget = int(part * (lengths * n).sum())
    taken = mixing.fit_budget(lengths, n, budget, window)
    assert (0 <= taken).all() and (taken <= n).all() and (taken * lengths).sum() <= budget
    if window == 1_000:  # the share of every length is fixed, the programme is exact for the rest
        floor = np.minimum(n, np.floor(n * (budget / (lengths * n).sum() * (1 - 1e-12))).astype(int))
        reach = {int((floor * lengths).sum())}
        for length, more in zip(lengths, n - floor):
            reach = {s + int(length) * k for s in reach for k in range(int(more) + 1)}
        assert (taken * lengths).sum() == max(s for s in reach if s <= budget)


def _targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        free = sum(weight[s] for s in names if s not in full)
        level = (total - sum(most * sizes[s] for s in full)) / free if free else 0
        more = {s for s in names if s not in full and level * weight[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def test_mix_against_plain_python(spark):
    rnd = random.Random(7)
    rows = [(k, rnd.choice(["b", "a", "a", "a", "é", "z", "𝒳", "￿", "", None]), rnd.choice([0, 1, 2, 7, 7, 7, 40, rnd.randint(1, 300)])) for k in range(1_200)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    out = mixing.mix(docs, bucket_rows=20).collect()
    again = mixing.mix(docs.repartition(9), bucket_rows=20).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert len(out) == len(rows) and out[0]["rank"] == "clash"
    sizes, taken = {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    target = _targets(sizes)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1


def test_mix_of_awkward_rows(spark):
    from pyspark.sql import functions as F

    docs = awkward(spark).withColumn("size", mixing.word_count(F.col("text")))
    out = mixing.mix(docs).collect()
    assert len(out) == 14
    for r in out:
        assert r["size"] == len(words(r["text"])) and r["taken"] <= 2 * r["size"]
    assert mixing.mix(empty(spark).withColumn("size", F.lit(0).cast("long"))).count() == 0
    nothing = mixing.mix(docs.withColumn("size", F.lit(0).cast("long"))).collect()
    assert {(r["taken"], r["target"]) for r in nothing} == {(0, 0.0)}


def _edits(pattern, text):
    row = [0] * (len(text) + 1)
    for k, p in enumerate(pattern, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), max_size=12))
def test_wording_is_the_least_edit_of_any_stretch(pattern, text):
    n, a, b = licenses.wording(pattern, text)
    assert n == _edits(pattern, text) and 0 <= a <= b <= len(text)
    assert _edits(pattern, text[a:b]) == n


def test_scan_against_trying_every_template(spark):
    rnd = random.Random(3)
    names = list(licenses.TEMPLATES)
    rows = []
    for k in range(200):
        lines = [" ".join(rnd.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(8)) for _ in range(rnd.randint(0, 6))]
        if k % 2:
            text = licenses.TEMPLATES[rnd.choice(names)].split()
            if k % 3 == 0:
                text[rnd.randrange(len(text))] = "changed"
            lines.insert(rnd.randint(0, len(lines)), " ".join(text))
        rows.append((k, "\n".join(lines)))
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    cue = re.compile(licenses.CUE)
    plain = lambda text: [licenses._plain(w) for w in text.split()]
    for k, text in rows:
        hits = [j for j, line in enumerate(text.split("\n")) if cue.search(line)]
        assert (k in out) == bool(hits)
        if hits:
            block = "\n".join(text.split("\n")[hits[0]:hits[-1] + 1])
            share = {name: _edits(plain(t), plain(block)) / len(plain(t)) for name, t in licenses.TEMPLATES.items()}
            r = out[k]
            if r["license"] is not None and min(share.values()) <= 0.2:
                assert r["confirmed"] and share[r["license"]] == min(share.values())
                assert r["differences"] == _edits(plain(licenses.TEMPLATES[r["license"]]), plain(r["wording"]))
            ranked = [x["reduction"] for x in r["ranked"]]
            assert ranked == sorted(ranked, reverse=True)
    exact = [k for k, text in rows if k % 2 and k % 3]
    assert sum(k in out and out[k]["confirmed"] and out[k]["differences"] == 0 for k in exact) == len([k for k in exact if k in out])


def test_scan_of_awkward_rows(spark):
    assert licenses.scan_licenses(awkward(spark)).count() == 0
    assert licenses.scan_licenses(empty(spark)).count() == 0
    long = spark.createDataFrame([(None, "licensed " * 300_000), (2, "License\n\n\n\nAll rights reserved.")], "doc_id long, text string")
    out = licenses.scan_licenses(long).collect()
    assert sorted((r["doc_id"] or 0, r["block"]) for r in out) == [(0, 0), (2, 0), (2, 1)]


@pytest.mark.parametrize("size", [1_000, 10_000, 100_000])
def test_exact_statements_in_long_lines(spark, size):
    rnd = random.Random(size)
    names = list(licenses.TEMPLATES)
    filler = lambda n: " ".join(rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rnd.randrange(999)) for _ in range(n // 8))
    rows = [(k, f"{filler(size - at)} {licenses.TEMPLATES[name]} {filler(at)}") for k, (name, at) in enumerate((n, a) for n in names for a in (0, size // 3))]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    for r in out:
        name = names[r["doc_id"] // 2]
        assert (r["license"], r["confirmed"], r["differences"]) == (name, True, 0)
        assert r["wording"] == licenses.TEMPLATES[name] and r["reduction"] >= 0.05


def test_wrapped_statements(spark):
    rows = []
    for name, template in licenses.TEMPLATES.items():
        own = template.split()
        cuts = [{k} for k in range(1, len(own))] + [set(range(1, len(own)))]
        for cut in cuts:
            text = "".join(("\n" if k in cut else " ") + w for k, w in enumerate(own))[1:]
            rows.append((len(rows), name, f"lorem ipsum\n\n{text}\ndolor sit", text))
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, name string, text string, own string")).collect()
    assert sorted(r["doc_id"] for r in out) == [k for k, *_ in rows]
    for r in out:
        _, name, _, text = rows[r["doc_id"]]
        assert (r["license"], r["confirmed"], r["differences"], r["wording"], r["block"]) == (name, True, 0, text, 0)
        assert (r["first_line"], r["n_lines"]) == (2, text.count("\n") + 1)


@pytest.mark.parametrize("between", [" ", "\n", "\n\n\n", " and also "])
def test_every_statement_of_a_block_has_a_row(spark, between):
    rnd = random.Random(8)
    rows = []
    for k, n in enumerate([2, 2, 3, 40, 1_500]):
        rows.append((k, [rnd.choice(list(licenses.TEMPLATES)) for _ in range(n)]))
    docs = spark.createDataFrame([(k, between.join(licenses.TEMPLATES[x] for x in own)) for k, own in rows], "doc_id long, text string")
    out = licenses.scan_licenses(docs).collect()
    for k, own in rows:
        found = [r for r in out if r["doc_id"] == k]
        assert [(r["license"], r["differences"], r["wording"]) for r in found] == [(x, 0, licenses.TEMPLATES[x]) for x in own]
        assert {r["block"] for r in found} == {0}


def test_a_block_without_a_statement_keeps_its_row(spark):
    text = "Copyright 2020 nobody.\n\n\n\n\nReleased under the MIT License."
    out = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r["block"], r["first_line"], r["confirmed"]) for r in out] == [(0, 0, False), (1, 5, True)]
    assert out[1]["license"] == "MIT"
