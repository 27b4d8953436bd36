"""Exact dedup, line dedup and the Jaccard join against plain Python."""

import hashlib
import random
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers  # noqa: E402
from helpers import awkward, clashing, empty  # noqa: E402

from usageloom.llm.components import connected_components  # noqa: E402
from usageloom.llm.exactdedup import directory, exact_groups  # noqa: E402
from usageloom.llm import jaccard  # noqa: E402
from usageloom.llm.jaccard import jaccard_groups, search_block, verified_links  # noqa: E402
from usageloom.llm.linededup import dedup_lines  # noqa: E402


def test_directory_splits_only_overfull_buckets():
    counts = {k: 1 for k in range(8)} | {13: 50}
    owner = directory(counts, 4, 4)
    load = np.bincount(owner, [counts.get(k, 0) for k in range(16)])
    assert len(set(owner[:4])) == 1 and len(set(owner[4:8])) == 1 and owner[0] != owner[4]
    assert sorted(load[load > 0]) == [4, 4, 50] and (np.diff(np.flatnonzero(np.diff(owner))) > 0).all()
    assert directory({}, 3, 4).tolist() == [0] * 8


def _exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))].append(doc_id)
    return {(d, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids}


@pytest.mark.parametrize("collide", [False, True])
def test_exact_groups(spark, collide):
    rnd = random.Random(3)
    rows = [(k, rnd.choice(["A b", "a B", "É", "é", "", None, f"own {k}", f"pair {k // 2}"])) for k in range(600)]
    rows += [(r["doc_id"], r["text"]) for r in awkward(spark).collect() if r["doc_id"] is None or r["doc_id"] == 10]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(7)
    few = lambda column: F.shiftleft(F.pmod(F.length(column), F.lit(3)).cast("long"), 62)  # noqa: E731  many texts to a hash
    out = exact_groups(docs, capacity=5, bits=4, hashed=few if collide else F.xxhash64).collect()
    assert len(out) == len(rows)
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out} == _exact(rows)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out)
    assert exact_groups(empty(spark)).count() == 0


def test_dedup_lines_against_plain_python(spark):
    rnd = random.Random(5)
    passages = [[f"passage {p} line {k} {rnd.random()}" for k in range(rnd.randint(2, 12))] for p in range(12)]
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, helpers.LONG.replace(". ", ".\n")), (5, helpers.LONG.replace(". ", ".\n"))]
    for k in range(10, 160):
        lines = [f"own {k} {j}" for j in range(rnd.randint(0, 8))]
        for p in rnd.sample(passages, rnd.randint(0, 3)):
            at = rnd.randint(0, len(lines))
            lines[at:at] = p
        rows.append((k, "\n".join(lines)))
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r["doc_id"]: (r["text"], r["removed_chunks"]) for r in dedup_lines(docs).collect()}
    expected = helpers.dedup_lines(rows)
    assert out == expected
    assert sum(n for _, n in expected.values()) > 50  # passages are found wherever they stand
    assert [out[k] for k in (1, 2, 3)] == [(None, 0), ("", 0), ("\n\n\n", 0)]


def test_dedup_lines_of_awkward_rows(spark):
    docs = awkward(spark)
    out = dedup_lines(docs)
    assert out.columns[:5] == ["doc_id", "lang", "source", "n_chars", "text"] and out.count() == 14
    assert dedup_lines(empty(spark)).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1_000, 1_060)] + [(2_000, 2_001 + k) for k in range(50)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert out == {x: find(x) for x in joined}


@pytest.mark.parametrize("seed", range(30))
def test_divide_skip_finds_every_group(seed):
    rnd = random.Random(seed)
    bases = [[rnd.randrange(1 << 60) for _ in range(rnd.randint(1, 60))] for _ in range(4)]
    sets = []
    for _ in range(60):
        own = set(rnd.choice(bases))
        for _ in range(rnd.randint(0, max(1, len(own) // 5))):
            own.discard(rnd.choice(list(own) or [0]))
            own.add(rnd.randrange(1 << 60))
        own |= set(rnd.sample(rnd.choice(bases), 1))
        sets.append(np.array(sorted(own), np.uint64))

    def groups(links):
        parent = list(range(len(sets)))
        find = lambda x: x if parent[x] == x else find(parent[x])
        for a, b in links:
            parent[find(a)] = find(b)
        return [min(k for k in range(len(sets)) if find(k) == find(j)) for j in range(len(sets))]

    both = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    assert groups(search_block(sets, 75)) == groups(both)


def near_copies(seed=2, n=250):
    """Groups of near copies around the threshold, chains, shared passages, exact copies."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5_000)}"
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rnd.choice([3, 5, 8, 40, 120]))] for _ in range(12)]
    rows = []
    for k in range(n):
        own = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 3) if len(own) > 20 else rnd.randint(0, 1)):
            own[rnd.randrange(len(own))] = word()
        if rnd.random() < 0.2:
            own = [word() for _ in range(60)] + passage
        if rnd.random() < 0.2:
            own = [w.upper() for w in own]
        rows.append((1_000 - k, rnd.choice([" ", "\n", "\t "]).join(own)))
    return rows + [(2_000, None), (2_001, ""), (2_002, " \n"), (2_003, "one two"), (2_004, "ONE two"), (2_005, helpers.LONG), (2_006, helpers.LONG + " x")]


@pytest.mark.parametrize("options", [{}, {"block": 2_000, "more_than": 2}, {"most": 3, "more_than": 1, "block": 500}])
def test_jaccard_groups_against_all_pairs(spark, options):
    rows = near_copies()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(docs, **options).collect()}
    expected = helpers.jaccard_groups(rows)
    assert out == expected
    assert sum(k != v[1] for k, v in expected.items()) > 50


def test_jaccard_groups_of_awkward_rows(spark):
    out = jaccard_groups(awkward(spark)).collect()
    assert len(out) == 14
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in out}
    n = len(helpers.shingles(awkward(spark).where("doc_id = 2").first()["text"]))
    assert by[2, n] == 1 and by[11, 1] == 10 and by[10, 1] == 10 and by[3, 0] == 3 and by[4, 0] == 4 and by[None, 0] is None
    assert jaccard_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("copies", [1, 6])
def test_jaccard_candidates_do_not_hang_together_by_chance(spark, monkeypatch, copies):
    """Every phrase stands in several documents and more of them than the exact table holds, but no two documents are alike."""
    rnd = random.Random(5)
    phrases = [" ".join(f"p{k}w{j}" for j in range(5)) for k in range(600)]
    texts = [" ".join(rnd.sample(phrases, 12)) for _ in range(400)]
    rows = [(400 * c + k, text) for c in range(copies) for k, text in enumerate(texts)]
    seen = []
    monkeypatch.setattr(jaccard, "verified_links", lambda members, *rest: seen.append(members.count()) or verified_links(members, *rest))
    out = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), most=3).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(k, k % 400) for k, _ in rows}
    assert seen[0] < 20
