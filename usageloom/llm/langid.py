"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counting and scoring both run on the executors, one Arrow batch at a time, in
numpy.  The only thing that is broadcast is the table of log probabilities:
``languages x buckets`` floats, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm.common import crc_of_id, read_table

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


@dataclass
class LanguageModel:
    """Log probability of each hashed n-gram (rows) in each language (columns), in order of name."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: int


def _grams(texts: list[str | None], buckets: int, orders: int, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of lower-cased letters and the index of the text that each belongs to.

    Runs of anything but letters count as one space; every text is padded, so
    its n-grams do not depend on its neighbours.  A long text comes in slices.
    """
    pieces: list[np.ndarray] = []
    owners: list[tuple[int, int]] = []
    size = 0

    def flush():
        data = np.concatenate(pieces)
        owner = np.repeat([k for k, _ in owners], [n + orders - 1 for _, n in owners])
        usable = np.ones(len(data), bool)
        at = 0
        for _, n in owners:  # the tail of a slice only completes n-grams
            usable[at + n:at + n + orders - 1] = False
            at += n + orders - 1
        places = np.flatnonzero(usable)
        hashed = np.zeros(len(places), np.uint32)
        out = []
        for k in range(orders):
            hashed = hashed * np.uint32(0x01000193) + (data[places + k] + np.uint32(1)) * np.uint32(0x9E3779B1)
            spread = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((spread >> np.uint32(9)) % np.uint32(buckets))
        return np.stack(out), owner[places]

    for i, text in enumerate(texts):
        clean = _OTHER.sub(" ", (text or "").lower())
        if not any(map(str.isalpha, clean)):
            continue
        codes = np.frombuffer((" " + clean.strip() + " " * orders).encode("utf-32-le", "surrogatepass"), np.uint32)
        usable = len(codes) - orders + 1
        for a in range(0, usable, limit):
            n = min(limit, usable - a)
            pieces.append(codes[a:a + n + orders - 1])
            owners.append((i, n))
            size += n
            if size >= limit:
                yield flush()
                pieces, owners, size = [], [], 0
    if pieces:
        yield flush()


def train(docs: DataFrame, buckets: int = 1 << 15, orders: int = 3, max_languages: int = 1024) -> LanguageModel:
    """Fit on all rows of ``docs`` (``text``, ``lang``) whose language is not null.

    Each task counts into one vector per language; the sums reach the driver as
    at most ``languages x buckets`` numbers.  More than ``max_languages`` labels
    raise an error, since the table is broadcast.  Texts without letters teach nothing.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            by: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                seen[lang] = seen.get(lang, 0) + len(texts)
                total = sums.setdefault(lang, np.zeros(buckets, np.int64))
                for hashed, _ in _grams(texts, buckets, orders):
                    total += np.bincount(hashed.ravel(), minlength=buckets)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1)), pa.array(np.append(total[used], seen[lang]))],
                ["lang", "bucket", "n"])

    labelled = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    sums = labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = sums.limit(max_languages * (buckets + 1) + 1).toPandas()
    languages = sorted(rows["lang"].unique())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts, documents = np.zeros((buckets, len(languages))), np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        grams = own[own["bucket"] >= 0]
        counts[grams["bucket"].to_numpy(), k] = grams["n"].to_numpy()
        documents[k] = own.loc[own["bucket"] < 0, "n"].sum()
    smooth = counts + 0.5
    log_prob = np.log(smooth) - np.log(smooth.sum(axis=0, keepdims=True))
    return LanguageModel(languages, log_prob, np.log(np.maximum(documents, 1) / max(documents.sum(), 1)), orders)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Best language of each text and its posterior probability.

    A batch is a sparse matrix of n-gram counts times the table of log
    probabilities.  Null texts and texts without a letter, or a model that saw
    no language, give ``und`` with 0; ties go to the first name.
    """
    n, found = len(texts), len(model.languages)
    if not found:
        return [UNKNOWN] * n, np.zeros(n)
    sums, letters = np.zeros((n, found)), np.zeros(n, bool)
    for hashed, owner in _grams(texts, len(model.log_prob), model.orders):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        letters[owner[first]] = True
        for k in range(found):
            column = np.ascontiguousarray(model.log_prob[:, k])
            sums[owner[first], k] += np.add.reduceat(column[hashed].sum(axis=0), first)
    sums += model.log_prior
    best = sums.argmax(axis=1)
    share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, share, 0.0)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` to every row (replacing such columns); only ``text`` is looked at."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        names, share = score_texts(known.value, texts.tolist())
        return pd.DataFrame({"lang_pred": names, "lang_score": share})

    rest = F.struct(*[c for c in docs.columns if c not in ("lang_pred", "lang_score")])
    return docs.select(rest.alias("_rest"), scored(F.col("text")).alias("_scored")).select("_rest.*", "_scored.*")


def held_out() -> Column:
    return crc_of_id("doc_id") % 3 == 1


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
