"""Mixing sources to target weights by fitting a word budget with a subset sum over lengths.

Nothing but histograms is planned on: per source, how many documents have each
exact length.  A source repeats all its documents as often as its target holds
its whole size; the rest of the budget takes a proportional share of every
length, then single documents from the longest down, and a bounded-knapsack
dynamic programme closes what is left to the word if any subset does.
Documents are then chosen by a seeded rank within their source and length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions.quantiles import global_rank
from usageloom.llm.common import cut_lineage, rank_within, read_table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 16_384) -> np.ndarray:
    """How many documents of each length (> 0) to take so that their words come close to ``budget``.

    Takes ``floor(budget share * count)`` of each length, then whole documents
    from the longest down while more than ``window`` words are missing, then the
    subset (each length at most its remaining count) whose sum is the largest
    within what is missing.  Bit sets hold the reachable sums, one per item of
    the binary split of a length's count.  Fewer words than ``budget`` in all
    take everything.
    """
    part = budget / max(1, int((lengths * counts).sum()))
    taken = np.minimum(counts, np.floor(counts * (part * (1 - 1e-12))).astype(np.int64))  # never above the share by rounding
    missing = budget - int((taken * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for k in order:
        if missing <= window:
            break
        n = min(int(counts[k] - taken[k]), -(-(missing - window) // int(lengths[k])), missing // int(lengths[k]))
        taken[k] += n
        missing -= n * int(lengths[k])
    if missing <= 0:
        return taken
    full = (1 << (missing + 1)) - 1
    reach, steps = 1, []
    for k in order:
        length = int(lengths[k])
        left = min(int(counts[k] - taken[k]), missing // length)
        size = 1
        while left > 0 and not reach >> missing & 1:
            n = min(size, left)
            steps.append((k, n, reach))
            reach |= reach << n * length & full
            left -= n
            size *= 2
    at = reach.bit_length() - 1
    for k, n, before in reversed(steps):
        if not before >> at & 1:
            taken[k] += n
            at -= n * int(lengths[k])
    return taken


def source_targets(histogram: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source its size and target: ``min(most * size, level * weight)``.

    Weights repeat over the sources by code point, null last.  The level is
    raised until the targets add up to ``share`` of all sizes: what is cut off a
    full source is shared again by weight among the others.  Each round is one
    aggregate; at least one more source is full after it.
    """
    sizes = histogram.groupBy("source").agg(F.sum(F.col("length") * F.col("n")).alias("source_size"))
    named = sizes.select("source", "source_size", F.hex(F.encode("source", "UTF-8")).alias("_point"))
    # In hexadecimal, the order of UTF-8 bytes is that of code points.
    placed = global_rank(named, [F.col("_point").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = cut_lineage(placed.select("source", "source_size", weight.alias("_weight")))
    level, full = 0.0, F.lit(False)
    size, bound = F.col("source_size").cast("double"), F.col("source_size") * F.lit(float(most))
    while True:
        r = weighed.agg(F.sum(size).alias("all"), F.sum(F.when(full, bound)).alias("full"), F.sum(F.when(~full, F.col("_weight"))).alias("weight"),
                        F.sum(F.when(full, 1)).alias("n_full"), F.count("*").alias("n")).first()
        if not r["weight"]:
            break
        level = (share * r["all"] - (r["full"] or 0.0)) / r["weight"]
        grown = full | (F.lit(level) * F.col("_weight") > bound)
        if weighed.where(grown & ~full).isEmpty():
            break
        full = F.lit(level) * F.col("_weight") > bound  # the level only rises, so what was full stays so
    return weighed.select("source", "source_size", F.least(F.lit(level) * F.col("_weight"), bound).alias("target")
                          if level else F.least(bound, F.lit(0.0)).alias("target"))


PLAN = "source string, length long, n long, n_more long, copies int, source_size long, target double"


def _plan_source(rows: pd.DataFrame) -> pd.DataFrame:
    """The plan of one source from its histogram; a source has at most one row per distinct length."""
    rows = rows.sort_values("length", ignore_index=True)
    size, target = int(rows["source_size"][0]), float(rows["target"][0])
    lengths, counts = rows["length"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    copies = int(target // size) if size else 0
    rows["copies"], rows["n_more"] = copies, np.zeros(len(rows), np.int64)
    some = lengths > 0
    if size:
        rows.loc[some, "n_more"] = fit_budget(lengths[some], counts[some], round(target - copies * size))
    return rows[["source", "length", "n", "n_more", "copies", "source_size", "target"]]


ADDED = ("source_size", "target", "times", "taken")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0,
        bucket_rows: int = 50_000) -> DataFrame:
    """Add to each row of ``docs`` (``doc_id``, ``source``, ``size``, others) what the mix takes of it.

    Adds ``source_size, target, times, taken`` (columns of these names are
    replaced); ``times`` is how often the document goes in (0 up to ``most``),
    ``taken`` its words.  Null sources are a source of their own, documents
    without words take no part (0), rows of equal (doc_id, size) are
    interchangeable.  A histogram has at most one row per distinct length of a
    source (their number is below the root of twice its words), so a task gets a
    bounded group even of a hot source.
    """
    own = [c for c in docs.columns if c not in ADDED]
    rest = F.struct(*[F.col(c) for c in own]) if own else F.struct()
    slim = docs.select("doc_id", "source", "size", rest.alias("_rest"))
    histogram = cut_lineage(slim.groupBy("source", F.col("size").alias("length")).agg(F.count("*").alias("n")))
    targets = source_targets(histogram, weights, share, most)
    both = histogram.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    planned = both.groupBy("source").applyInPandas(_plan_source, PLAN)
    keyed = lambda df: df.select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key"))  # noqa: E731  null has a key too
    counts = cut_lineage(keyed(planned).drop("source").withColumnRenamed("length", "size"))
    ranked = rank_within(keyed(slim), ["_key", "size"], ["doc_id"], counts, seed, bucket_rows)
    times = F.when(F.col("size") > 0, F.col("copies") + (F.col("rank") < F.col("n_more")).cast("int")).otherwise(0)
    return ranked.select("_rest.*", "source_size", "target", times.alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")
