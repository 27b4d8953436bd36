"""A training-data pipeline: from ``documents`` to packed sequences.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet to
the shared folder and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm.common import cut_lineage, read_table
from usageloom.llm.jaccard import held_by, jaccard_groups
from usageloom.llm.langid import UNKNOWN, held_out, predict, train
from usageloom.llm.linededup import dedup_lines
from usageloom.llm.mixing import mix, word_count
from usageloom.llm.packing import packed_documents

#: SQL has no model to train and no way to pack: tests compare with a plain Python version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; those without a letter and undecided ones go."""
    judged = predict(docs, train(docs.where(~held_out())))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= 0.5)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go, and documents of which nothing is left."""
    out = dedup_lines(docs)
    emptied = (F.col("removed_chunks") > 0) & (F.trim("text") == "")
    counted = out.where(~emptied).withColumn("n_chars", F.when(F.col("removed_chunks") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return counted.select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row of the smallest id stays (a null id is behind all others).

    Every row is a document of its own here: of rows that repeat an id, linked
    texts are reduced to the one of the smallest hash, others stay.  Texts
    without words link with nothing and all stay.
    """
    rows = cut_lineage(docs.select(F.monotonically_increasing_id().alias("_row"), *docs.columns))
    groups = jaccard_groups(rows.select(F.col("_row").alias("doc_id"), "text"))
    linked = cut_lineage(groups.where("doc_id != component_id").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")))
    members = linked.union(linked.select(F.col("_group").alias("_row"), "_group").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", F.xxhash64("text").alias("_text"), F.xxhash64(*docs.columns).alias("_hash"), "_row")
    placed = cut_lineage(rows.select("_row", place.alias("_place")).join(members, "_row"))
    first = placed.groupBy("_group").agg(F.min("_place").alias("_first"))
    dropped = cut_lineage(placed.join(first, "_group").where("_row != _first._row").select("_row"))
    # Only rows that may be dropped are shuffled with their texts.
    known = held_by(dropped, "_row")
    stay = rows.where(~known("_row")).union(rows.where(known("_row")).join(dropped, "_row", "left_anti"))
    return stay.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("document")))
    return mixed.select("document", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("document.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens and their places in sequences."""
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
