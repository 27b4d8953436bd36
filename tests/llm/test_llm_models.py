"""Language ID and quality: the arithmetic against plain versions, and held-out accuracy."""

import sys
from collections import Counter
from itertools import product
from math import log
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, clashing, empty  # noqa: E402

from usageloom.llm import langid, quality  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_naive_bayes_against_counting(spark):
    texts = {"en": ["the cat and the dog", "with that thing"], "fr": ["le chat et le chien", "avec ça"], "de": ["der hund und die katze", None]}
    docs = spark.createDataFrame([(t, lang) for lang, own in texts.items() for t in own] + [("never seen", None)], "text string, lang string")
    model = langid.train(docs, buckets=512)
    counts = {lang: Counter(int(h) for hashed, _ in langid._grams(own, 512, 3) for h in hashed.ravel()) for lang, own in texts.items()}
    asked = ["the hund", "le chat", "12 34", None, "", "x" * 5_000_000]
    names, share = langid.score_texts(model, asked)
    for text, name, p in zip(asked[:2], names, share):
        grams = [int(h) for hashed, _ in langid._grams([text], 512, 3) for h in hashed.ravel()]
        logs = {lang: log(1 / 3) + sum(log((counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 256)) for g in grams) for lang in counts}
        best = max(sorted(logs), key=logs.get)
        assert name == best and p == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()))
    assert names[2:5] == ["und"] * 3 and share[2:5].tolist() == [0, 0, 0] and names[5] != "und"


def test_grams_do_not_depend_on_neighbours_or_slices():
    texts = ["Abc dé, f", "", "zz", "日本 ab" * 50, None]
    alone = [sorted(int(h) for hashed, _ in langid._grams([t], 1024, 3) for h in hashed.ravel()) for t in texts]
    for limit in (3, 40, 1 << 20):
        found = [[] for _ in texts]
        for hashed, owner in langid._grams(texts, 1024, 3, limit):
            for row in hashed:
                for h, k in zip(row, owner):
                    found[k].append(int(h))
        assert [sorted(x) for x in found] == alone


def test_language_id_of_awkward_rows(spark):
    docs = clashing(awkward(spark))
    out = langid.predict(docs, langid.train(docs)).collect()
    assert len(out) == 14
    by = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in out}
    assert by[3] == by[4] == by[5] == by[6] == ("und", 0.0) and by[7][0] == "en" and 0 <= by[9][1] <= 1
    nothing = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.predict(awkward(spark), nothing).collect()} == {"und"}
    assert langid.predict(empty(spark), nothing).count() == 0
    with pytest.raises(ValueError):
        langid.train(docs, max_languages=1)


def test_language_id_held_out(spark):
    out = langid.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    own = out[out["held_out"]]
    assert len(own) > 200 and (own["lang"] == own["lang_pred"]).mean() > 0.99


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    n_lines = np.array([1, 4, 2, 5])
    emission, move = rng.normal(size=12), rng.normal(size=(2, 2))
    good, moves, total = quality.marginals(emission, move, n_lines)
    at, sums, expected = 0, 0.0, np.zeros((2, 2))
    for n in n_lines:
        weight = {ys: np.exp(sum(y * emission[at + k] for k, y in enumerate(ys)) + sum(move[a, b] for a, b in zip(ys, ys[1:]))) for ys in product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        sums += np.log(z)
        for k in range(n):
            assert good[at + k] == pytest.approx(sum(w for ys, w in weight.items() if ys[k]) / z)
        for ys, w in weight.items():
            for a, b in zip(ys, ys[1:]):
                expected[a, b] += w / z
        at += n
    assert total == pytest.approx(sums) and moves == pytest.approx(expected)


def test_line_features_do_not_depend_on_neighbours():
    texts = ["One line. Two words\nHELLO!! THERE!!\n\nOne line. Two words", "", None, "a|b|c\n" * 3, "ends&&& here&&&"]
    own, length, n_lines = quality.line_features(texts)
    assert n_lines.tolist() == [4, 1, 1, 4, 1] and len(own) == 11 and length[0] == 19
    alone = [quality.line_features([t])[0] for t in texts]
    assert np.allclose(own, np.concatenate(alone))
    assert quality.line_features([])[0].shape == (0, quality.N_OWN)


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 1), (10, 0), (10, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.score(clashing(docs), model).collect()
    assert len(out) == 14 and all(0 <= r["quality_score"] <= 1 for r in out)
    by = {r["doc_id"]: r["quality_score"] for r in out}
    assert by[3] == by[4]
    unlearned = quality.train(empty(spark), labels.limit(0))
    assert {round(r["quality_score"], 6) for r in quality.score(docs, unlearned).collect()} == {0.5}
    assert quality.score(empty(spark), unlearned).count() == 0


def test_quality_held_out(spark):
    out = quality.op6_quality_crf(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    own = out[out["held_out"]]
    assert len(own) > 50 and (own["predicted"] == own["quality"]).mean() > 0.95
