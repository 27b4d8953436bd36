"""The pipeline against plain Python, stage by stage, and the package's place in the repository."""

import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers

ROOT = Path(__file__).parents[2]
sys.path[:0] = [str(Path(__file__).parent), str(ROOT)]
import corpus_pipeline  # noqa: E402
import helpers  # noqa: E402

from usageloom.llm.packing import tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "123 !!", "en", "src1", 6), (10_003, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns

    named = stages["language_id"](spark, docs, SF)
    assert named.columns == columns
    kept = {r["doc_id"] for r in named.select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")}

    cleaned = stages["line_dedup"](spark, named, SF)
    assert cleaned.columns == columns
    expected = helpers.dedup_lines([(r["doc_id"], r["text"]) for r in named.collect()])
    rows = cleaned.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {d: t for d, (t, n) in expected.items() if not (n and not t.strip(" "))}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    single = stages["ngram_jaccard"](spark, cleaned, SF)
    assert single.columns == columns
    groups = helpers.jaccard_groups([(r["doc_id"], r["text"]) for r in rows])
    assert {r["doc_id"] for r in single.collect()} == {d for d, (_, least) in groups.items() if d == least}

    mixed = stages["mix_sources"](spark, single, SF)
    assert mixed.columns == columns
    sizes = {r["doc_id"]: len(helpers.words(r["text"])) for r in single.collect()}
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= set(sizes) and max(times.values()) <= 2
    total = sum(sizes.values())
    assert abs(sum(n * sizes[d] for d, n in times.items()) - 1.5 * total) <= 0.005 * total

    packed = stages["best_fit_packing"](spark, mixed, SF).collect()
    found, seats = Counter(), defaultdict(list)
    for r in packed:
        found[r["doc_id"], r["piece"], r["length"], r["ids_crc32"]] += 1
        seats[r["sequence_id"]].append((r["offset"], r["length"]))
    whole = Counter()
    own = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for r in mixed.collect():
        ids = own.tokenizer.encode(r["text"], add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            piece = np.array(ids[k:k + 2048], "<u4")
            whole[r["doc_id"], k // 2048, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert found == whole
    for own_seats in seats.values():
        at = 0
        for offset, length in sorted(own_seats):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seats) <= 1.02 * -(-sum(n * key[2] for key, n in whole.items()) // 2048) + 1


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    text = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"other{k}" for k in range(40))
    alone = " ".join(f"alone{k}" for k in range(40))
    rows = [(5, text, "x"), (5, text, "x"), (5, text + " more", "x"), (None, text, "x"), (9, text, "x"),  # one group: a row of id 5
            (None, other, "n"), (None, other + " more", "n"),  # null ids only: one of both
            (7, alone, "y"), (7, text + " too", "y"), (8, alone, "y"),  # id 7 has an unlinked text, which stays
            (11, "", "e"), (11, "", "e"), (None, None, "e")]  # linked with nothing
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], helpers.DOCS).repartition(4)
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, SF)
    assert out.columns == docs.columns
    found = Counter((r["source"], r["doc_id"]) for r in out.collect())
    assert found == {("x", 5): 1, ("n", None): 1, ("y", 7): 1, ("e", 11): 2, ("e", None): 1}


def test_stages_take_empty_and_awkward_tables(spark):
    for docs in (helpers.empty(spark), helpers.awkward(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            out.collect()


def test_entry_works_without_the_package(tmp_path):
    import shutil

    shutil.copytree(ROOT / "usageloom", tmp_path / "usageloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))


def test_unlike_documents_do_not_meet_in_the_stage_of_near_copies(spark, monkeypatch):
    """Phrases stand in many documents; a table of 3 keys stands for one that a large corpus outgrows."""
    import random

    from usageloom.llm import jaccard

    rnd = random.Random(5)
    phrases = [" ".join(f"p{k}w{j}" for j in range(5)) for k in range(600)]
    rows = [(k, " ".join(rnd.sample(phrases, 12)), "en", "s", 1) for k in range(400)]
    seen, verified = [], jaccard.verified_links
    monkeypatch.setattr(jaccard, "verified_links", lambda members, *rest: seen.append(members.count()) or verified(members, *rest))
    monkeypatch.setattr(corpus_pipeline, "jaccard_groups", lambda docs: jaccard.jaccard_groups(docs, most=3))
    docs = spark.createDataFrame([*rows, rows[7]], helpers.DOCS).repartition(4)
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(400))
    assert seen[0] < 20
