"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its features are its own and those of the lines
around it.  Forward-backward gives each line's marginal probability of being
good; weighted by length they add up to the document's, which a one-variable
logistic curve maps to the label.  The model is fitted on a bounded sample of
labelled documents (their lines' features, made on the executors); scoring reads
every line of every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm.common import crc_of_id, read_table

LETTER, UPPER, DIGIT, SPACE, OTHER = 1, 2, 4, 8, 16
N_OWN = 16


@cache
def _kinds() -> np.ndarray:
    """Kind of each character of the basic plane; characters beyond it count as other."""
    out = np.full(0x10000, OTHER, np.uint8)
    for k in range(0x10000):
        c = chr(k)
        if c.isalpha():
            out[k] = LETTER | (UPPER if c.isupper() else 0)
        elif c.isdigit():
            out[k] = DIGIT
        elif c.isspace():
            out[k] = SPACE
    return out


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, their lengths, and how many lines each text has (at least one)."""
    n_lines, repeats, same, again = [], [], [], []
    for text in texts:
        lines = (text or "").split("\n")
        n_lines.append(len(lines))
        times = Counter(lines)
        repeats += [times[x] for x in lines]
        same.append(False)
        same += [a == b for a, b in zip(lines, lines[1:])]
        again += [sum(map(eq, words, words[1:])) for words in map(str.split, lines)]
    if not texts:
        return np.empty((0, N_OWN)), np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer("".join((t or "") + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 10)
    starts = np.r_[0, ends[:-1] + 1]
    kinds = np.where(codes < 0x10000, _kinds()[np.minimum(codes, 0xFFFF)], OTHER).astype(np.uint8)

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), starts).astype(float)

    length = (ends - starts).astype(np.int64)
    size = np.maximum(length, 1)
    inside = codes != 10
    letters = per_line(kinds & LETTER > 0)
    other = kinds == OTHER
    blank = kinds == SPACE
    doubled = np.r_[False, (codes[1:] == codes[:-1]) & other[1:]]
    word_end = ~blank & np.r_[blank[1:], True]
    words = np.maximum(per_line(word_end & inside), 1)
    upper = per_line(kinds & UPPER > 0)
    marked = np.r_[False, word_end[1:] & doubled[1:]]  # words that end in a doubled sign
    repeats = np.array(repeats, float)
    last = codes[np.maximum(ends - 1, starts)]
    # The share of a text's lines that occur more than once in it, for each of its lines.
    owner = np.repeat(np.arange(len(n_lines)), n_lines)
    share = np.bincount(owner, repeats > 1) / np.array(n_lines)
    own = np.stack([
        np.log1p(length), letters / size, upper / np.maximum(letters, 1), per_line(kinds == DIGIT) / size, per_line(other) / size,
        per_line(doubled) / size, per_line(codes == ord("|")) / words, per_line(codes == ord("!")) / words, per_line(marked & inside) / words,
        letters / words / 10, np.log1p(words), np.minimum(np.log(repeats), 5), np.array(same, float), np.isin(last, [ord(c) for c in ".!?"]).astype(float),
        share[owner], np.array(again) / words,
    ], axis=1)
    return own, length, np.array(n_lines, np.int64)


def with_neighbours(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Own features beside those of the line before and the line after, and flags where there is none."""
    ends = np.cumsum(n_lines)
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[ends - n_lines], last[ends - 1] = True, True
    before = np.where(first[:, None], 0.0, np.roll(own, 1, axis=0))
    after = np.where(last[:, None], 0.0, np.roll(own, -1, axis=0))
    return np.concatenate([own, before, after, first[:, None], last[:, None]], axis=1)


def marginals(emission: np.ndarray, move: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected moves (2 x 2, over all chains) and the log partition sum.

    ``emission`` is the log odds of good by the line's own features; all chains
    go forward and backward together, the longest first, in log space.
    """
    order = np.argsort(-n_lines, kind="stable")
    starts, lengths = (np.cumsum(n_lines) - n_lines)[order], n_lines[order]
    at = np.zeros((len(emission), 2))
    at[:, 1] = emission
    alpha, beta = at.copy(), np.zeros_like(at)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")  # chains with more than t lines
    for t in range(1, longest):
        now = starts[:active[t]] + t
        prev = alpha[now - 1]
        for y in (0, 1):
            alpha[now, y] += np.logaddexp(prev[:, 0] + move[0, y], prev[:, 1] + move[1, y])
    for t in range(longest - 1, 0, -1):
        now = starts[:active[t]] + t
        ahead = beta[now] + at[now]
        for y in (0, 1):
            beta[now - 1, y] = np.logaddexp(move[y, 0] + ahead[:, 0], move[y, 1] + ahead[:, 1])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    later = np.ones(len(emission), bool)
    later[starts] = False
    now = np.flatnonzero(later)
    moves = np.array([[np.exp(alpha[now - 1, x] + move[x, y] + at[now, y] + beta[now, y] - total[now]).sum() for y in (0, 1)] for x in (0, 1)])
    return np.exp(both[:, 1] - total), moves, float(total[starts].sum())


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last one is the constant
    move: np.ndarray
    curve: tuple[float, float]

    def lines(self, own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        x = (with_neighbours(own, n_lines) - self.mean) / self.spread
        return marginals(x @ self.weights[:-1] + self.weights[-1], self.move, n_lines)[0]

    def documents(self, own: np.ndarray, length: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        return self.curved(weighted(self.lines(own, n_lines), length, n_lines))

    def curved(self, share: np.ndarray) -> np.ndarray:
        odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * odds + self.curve[1], -50, 50)))


def weighted(good: np.ndarray, length: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(n_lines)), n_lines)
    return np.bincount(owner, good * (length + 1)) / np.bincount(owner, length + 1.0)


def _descend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam: ascent on a mean log likelihood."""
    at, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(at)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        at += rate * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.99 ** k)) + 1e-8)
    return at


def fit(own: np.ndarray, length: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, rounds: int = 2, steps: int = 120, decay: float = 1e-3) -> QualityModel:
    """Fit on documents whose lines first carry the document's label.

    In further rounds those lines of bad documents that the field holds good
    are relabelled, unless it would leave no bad one.  Without both labels the
    model gives every document the share of good ones (0.5 without any).
    """
    x = with_neighbours(own, n_lines) if len(own) else np.zeros((1, 3 * N_OWN + 2))
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    width = x.shape[1]
    if len(set(labels.tolist())) < 2:
        share = labels.mean() if len(labels) else 0.5
        return QualityModel(mean, spread, np.zeros(width + 1), np.zeros((2, 2)), (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))))
    x = (x - mean) / spread
    owner = np.repeat(np.arange(len(n_lines)), n_lines)
    y = labels[owner].astype(float)
    later = np.ones(len(y), bool)
    later[np.cumsum(n_lines) - n_lines] = False
    now = np.flatnonzero(later)
    theta = np.zeros(width + 5)
    for _ in range(rounds):
        seen = np.array([[((y[now - 1] == a) & (y[now] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)

        def gradient(at: np.ndarray) -> np.ndarray:
            good, moves, _ = marginals(x @ at[:width] + at[width], at[width + 1:].reshape(2, 2), n_lines)
            rest = y - good
            return np.concatenate([x.T @ rest, [rest.sum()], (seen - moves).ravel()]) / len(y) - decay * at

        theta = _descend(gradient, theta, steps, 0.1)
        model = QualityModel(mean, spread, theta[:width + 1], theta[width + 1:].reshape(2, 2), (1.0, 0.0))
        good = marginals(x @ theta[:width] + theta[width], model.move, n_lines)[0]
        worst = np.minimum.reduceat(good, np.cumsum(n_lines) - n_lines)[owner]
        y = np.where(labels[owner] == 1, 1.0, ((good > 0.5) & (good > worst)).astype(float))
    share = weighted(good, length, n_lines)
    odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))

    def curve_gradient(at: np.ndarray) -> np.ndarray:
        rest = labels - 1 / (1 + np.exp(-np.clip(at[0] * odds + at[1], -50, 50)))
        return np.array([(rest * odds).mean(), rest.mean()]) - 1e-4 * at

    model.curve = tuple(_descend(curve_gradient, np.array([1.0, 0.0]), 400, 0.05).tolist())
    return model


def train(docs: DataFrame, labels: DataFrame, max_documents: int = 6_000, max_lines: int = 500) -> QualityModel:
    """Fit on at most ``max_documents`` labelled documents, none of more than ``max_lines`` lines.

    The sample is taken from ``labels`` (``doc_id``, ``quality``) by the smallest
    id hashes before it meets ``docs`` (``doc_id``, ``text``), so what is broadcast
    has that bound.  Null labels are left out; a null text is an empty line.
    """
    lines = F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")), F.lit(0)) + 1
    some = labels.where(F.col("quality").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_documents)
    sample = docs.where(lines <= max_lines).select("doc_id", "text").join(F.broadcast(some), "doc_id").limit(max_documents)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, length, n_lines = line_features(batch.column(0).to_pylist())
            starts = np.cumsum(n_lines) - n_lines
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([own[a:a + n].astype(np.float32).tobytes() for a, n in zip(starts, n_lines)], pa.binary()),
                 pa.array([length[a:a + n].tobytes() for a, n in zip(starts, n_lines)], pa.binary())], ["quality", "own", "length"])

    found = sample.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(describe, "quality int, own binary, length binary").toPandas()
    own = [np.frombuffer(x, np.float32).reshape(-1, N_OWN).astype(float) for x in found["own"]]
    length = [np.frombuffer(x, np.int64) for x in found["length"]]
    n_lines = np.array([len(x) for x in length], np.int64)
    if not len(own):
        return fit(np.empty((0, N_OWN)), np.empty(0), n_lines, np.empty(0))
    return fit(np.concatenate(own), np.concatenate(length), n_lines, found["quality"].to_numpy())


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Add ``quality_score`` (0 to 1) to every row (replacing such a column); only ``text`` is looked at.

    Null and empty texts are scored as one empty line, texts of any length whole.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out, batch, size = [], [], 0
        for text in [*texts, None]:
            batch.append(text)
            size += len(text or "")
            if size > 1 << 21:
                out.append(known.value.documents(*line_features(batch)))
                batch, size = [], 0
        if batch:
            out.append(known.value.documents(*line_features(batch)))
        return pd.Series(np.concatenate(out)[:len(texts)])

    return docs.select(*[docs[c] for c in docs.columns if c != "quality_score"], scored(docs["text"]).alias("quality_score"))


def held_out() -> Column:
    return crc_of_id("doc_id") % 5 == 0


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    model = train(docs, labels)
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
                      (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
