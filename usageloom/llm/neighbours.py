"""Nearest neighbours as a block matrix join on int8 tiles, corrected in double precision.

Queries go out in chunks of a bounded number of vectors; for each chunk one job
reads all candidates.  A task turns its batch into int8 blocks, multiplies them
with the query block tile by tile, and from the quantisation errors gets a lower
and an upper bound of each distance.  Only pairs whose lower bound does not
exceed the query's present k-th distance are computed again from the original
vectors; heaps keep the best, in tasks and again across tasks.  The result is
exact: recall is 1 whatever the data.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm.common import cut_lineage, read_table

#: Components per product: sums of 1,024 products of two int8 fit a float's 24-bit mantissa exactly.
TILE = 1_024
FOUND = "query_id long, vec_id long, score double"


class Block:
    """Vectors of one dimension with their int8 form: ``x = scale * code + rest``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        top = np.abs(vectors).max(axis=1)
        self.scale = np.where(top > 0, top / 127, 1.0)
        self.codes = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        rough = self.codes * self.scale[:, None]
        self.rest = np.sqrt(((vectors - rough) ** 2).sum(axis=1))
        self.rough = np.sqrt((rough ** 2).sum(axis=1))
        self.square = (vectors ** 2).sum(axis=1)


def bounds(queries: Block, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances.

    ``x.y = xr.yr + xr.ey + ex.y``, so by Cauchy-Schwarz the product of the
    codes is off by at most ``|xr| |ey| + |ex| |y|``; a little is added for
    rounding.
    """
    dot = np.zeros((len(queries.ids), len(block.ids)))
    for a in range(0, queries.codes.shape[1], TILE):
        dot += queries.codes[:, a:a + TILE].astype(np.float32) @ block.codes[:, a:a + TILE].astype(np.float32).T
    dot *= queries.scale[:, None] * block.scale
    error = queries.rough[:, None] * block.rest + queries.rest[:, None] * np.sqrt(block.square)
    sums = queries.square[:, None] + block.square
    error = 2 * error + 1e-12 * sums
    near = sums - 2 * dot
    return near - error, near + error


class Nearest:
    """The ``k`` best candidates of each query seen so far, as heaps of (-distance, -id)."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.limit = np.full(len(queries.ids), np.inf)  # k-th squared distance, a little widened

    def add(self, block: Block) -> None:
        low, high = bounds(self.queries, block)
        own = self.queries.ids[:, None] == block.ids
        low[own], high[own] = np.inf, np.inf
        if high.shape[1] >= self.k:
            self.limit = np.minimum(self.limit, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
        rows, columns = np.nonzero((low <= self.limit[:, None]) & ~own)
        for a in range(0, len(rows), 1 << 16):
            r, c = rows[a:a + (1 << 16)], columns[a:a + (1 << 16)]
            exact = np.sqrt(((self.queries.vectors[r] - block.vectors[c]) ** 2).sum(axis=1))
            for query, distance, vec in zip(r.tolist(), exact.tolist(), block.ids[c].tolist()):
                heap = self.heaps[query]
                if len(heap) < self.k:
                    heapq.heappush(heap, (-distance, -vec))
                else:
                    heapq.heappushpop(heap, (-distance, -vec))
        for query in np.unique(rows):
            heap = self.heaps[query]
            if len(heap) == self.k:
                self.limit[query] = min(self.limit[query], heap[0][0] ** 2 * (1 + 1e-12))


def _blocks(batch: pa.RecordBatch, rows: int = 4_096) -> Iterator[Block]:
    """Blocks of equal dimension from a batch (id, array<double>)."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for dim in np.unique(lengths):
        own = np.flatnonzero(lengths == dim)
        step = max(1, min(rows, (1 << 22) // max(1, int(dim))))
        for a in range(0, len(own), step):
            some = own[a:a + step]
            yield Block(ids[some], flat[starts[some][:, None] + np.arange(dim)])


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 10, chunk: int = 2_048, salts: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of each query, both given as (``vec_id``, ``embedding``).

    Unusable vectors take no part.  A query meets vectors of its own dimension
    only, and none that bears its id.  Ids that repeat among the queries count
    once (the vector that sorts first), among the candidates each time.  Equal
    distances go to the smaller id.  ``chunk`` bounds what is broadcast: about so
    many queries, spread by a hash of their ids, for each job over the candidates.
    """
    spark = candidates.sparkSession
    vector = F.col("embedding").cast("array<double>")
    ready = candidates.select("vec_id", vector.alias("embedding")).where(usable(F.col("embedding")))
    asked = cut_lineage(queries.select("vec_id", vector.alias("embedding")).where(usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    chunks = -(-asked.count() // chunk)
    parts = []
    for number in range(chunks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == number).toArrow()
        by_dimension: dict[int, Block] = {}
        for batch in own.combine_chunks().to_batches():
            for block in _blocks(batch, chunk * 4):
                by_dimension[block.vectors.shape[1]] = block
        parts.append(ready.mapInArrow(_search(spark.sparkContext.broadcast(by_dimension), k), FOUND))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.union, parts)
    # Each task hands on k rows per query; a first round of merges keeps a query's last one small.
    some = found.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("query_id", "_salt").applyInPandas(_best(k, False), FOUND)
    return some.groupBy("query_id").applyInPandas(_best(k, True), "query_id long, rank int, vec_id long, score double")


def _search(known, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Nearest(queries, k) for dim, queries in known.value.items()}
        for batch in batches:
            for block in _blocks(batch):
                if (own := best.get(block.vectors.shape[1])) is not None:
                    own.add(block)
        rows = [(int(q), -vec, -distance) for own in best.values() for q, heap in zip(own.queries.ids, own.heaps) for distance, vec in heap]
        columns = zip(*rows) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return search


def _best(k: int, ranked: bool):
    def best(key, rows: pd.DataFrame) -> pd.DataFrame:
        top = heapq.nsmallest(k, zip(rows["score"], rows["vec_id"]))
        out = pd.DataFrame({"query_id": key[0], "vec_id": [v for _, v in top], "score": [s for s, _ in top]})
        if ranked:
            out.insert(1, "rank", np.arange(1, len(out) + 1, dtype=np.int32))
        return out

    return best


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
