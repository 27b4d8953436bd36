"""Exact de-duplication with an extendible-hash index on shared files.

1. Hashes of all texts are counted; texts of a hash that occurs once are done.
2. The others form the index.  Its directory is doubled until no bucket holds
   more than ``capacity`` hashes (buckets differ in local depth).  Each task
   first merges the equal texts of its own rows; then the owner of a bucket
   reads its key range, chains different texts of one hash and compares bytes.
   A bucket that is overfull for its rows but not for its hashes (copies) is
   read by several first owners, each of which hands on one entry per text.
3. The index (one row per text) is written to the shared folder and documents
   look up their text's row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm.common import cut_lineage, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTRY = "hash long, sha string, text string, keep_id long, n long"


def normalised(text: Column) -> Column:
    """Null is empty; only A-Z are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def directory(counts: dict[int, int], bits: int, capacity: int) -> np.ndarray:
    """Bucket of each ``bits``-bit prefix: directory entries after all splits.

    Starts with one bucket of depth 0.  While a bucket holds more than
    ``capacity`` hashes, it is split by its next bit, and the directory doubles
    when that bit is beyond its depth; at ``bits`` it stays as it is.
    """
    load = np.zeros(1 << bits, np.int64)
    for prefix, n in counts.items():
        load[prefix] = n
    sums = np.concatenate(([0], np.cumsum(load)))
    owner, depth = np.zeros(1, np.int64), 0  # entries of the directory, global depth
    local, waiting, buckets = {0: (0, 0)}, [0], 1  # bucket -> (prefix, local depth)
    while waiting:
        bucket = waiting.pop()
        prefix, deep = local[bucket]
        wide = bits - deep
        if sums[(prefix + 1) << wide] - sums[prefix << wide] <= capacity or deep == bits:
            continue
        if deep == depth:
            owner, depth = np.repeat(owner, 2), depth + 1
        shift = depth - deep - 1
        owner[(2 * prefix + 1) << shift:(2 * prefix + 2) << shift] = buckets
        local[bucket], local[buckets] = (2 * prefix, deep + 1), (2 * prefix + 1, deep + 1)
        waiting += [bucket, buckets]
        buckets += 1
    return np.repeat(owner, 1 << (bits - depth))


class Chains:
    """Entries by hash; different texts of one hash follow each other in a chain."""

    def __init__(self):
        self.by_hash: dict[int, list[list]] = {}
        self.size = 0

    def add(self, key: int, sha: str, text: str, keep_id, n: int) -> None:
        chain = self.by_hash.setdefault(key, [])
        for entry in chain:
            if entry[1] == text:
                entry[2] = keep_id if entry[2] is None or (keep_id is not None and keep_id > entry[2]) else entry[2]
                entry[3] += n
                return
            if entry[0] == sha:
                raise ValueError("two texts share a SHA-256")
        chain.append([sha, text, keep_id, n])
        self.size += len(text)

    def flush(self) -> pa.RecordBatch:
        rows = [(key, *entry) for key, chain in self.by_hash.items() for entry in chain]
        self.by_hash, self.size = {}, 0
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = zip(*rows) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["hash", "sha", "text", "keep_id", "n"])


def _merge(limit: int):
    """Merge equal texts; beyond ``limit`` characters of different texts, hand on and go on (never in an owner's last pass)."""
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = Chains()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                chains.add(*row)
                if limit and chains.size > limit:
                    yield chains.flush()
        yield chains.flush()

    return merged


def build_index(entries: DataFrame, capacity: int = 20_000, bits: int | None = None, salts: int = 16, limit: int = 32_000_000) -> DataFrame:
    """One row per different text of ``entries`` (hash, sha, text, keep_id, n), merged by the owners of its bucket.

    ``bits`` bounds the directory (``2**bits`` numbers on the driver and in the
    tasks); by default it follows the number of hashes, up to 20.
    """
    spark = entries.sparkSession
    local = cut_lineage(entries.mapInArrow(_merge(limit), ENTRY))
    rows = local.count()
    bits = bits if bits is not None else int(np.clip(np.ceil(np.log2(max(rows, 1) / capacity + 1)) + 2, 1, 20))
    prefix = F.shiftrightunsigned("hash", 64 - bits)
    loads = local.groupBy(prefix.cast("int").alias("prefix")).agg(
        F.approx_count_distinct("hash").alias("hashes"), F.count("*").alias("rows")).collect()  # at most 2**bits rows
    owner = directory({r["prefix"]: r["hashes"] for r in loads}, bits, capacity)
    read = np.zeros(int(owner.max()) + 1, np.int64)
    for r in loads:
        read[owner[r["prefix"]]] += r["rows"]
    known = spark.sparkContext.broadcast((owner, read > 2 * capacity))

    @F.pandas_udf("bucket int, crowded boolean")
    def look_up(prefixes):
        import pandas as pd
        buckets = known.value[0][prefixes.to_numpy()]
        return pd.DataFrame({"bucket": buckets.astype("int32"), "crowded": known.value[1][buckets]})

    placed = local.withColumn("_at", look_up(prefix.cast("int"))).select(*local.columns, "_at.bucket", "_at.crowded")
    first = placed.where("crowded").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    columns = local.columns
    merged = (first.repartition("bucket", "_salt").select(*columns).mapInArrow(_merge(limit), ENTRY)
              .withColumn("_at", look_up(prefix.cast("int"))).select(*columns, "_at.bucket"))
    owned = placed.where(~F.col("crowded")).select(*columns, "bucket").union(merged).repartition("bucket")
    return owned.select(*columns).mapInArrow(_merge(0), ENTRY)


def exact_groups(docs: DataFrame, capacity: int = 20_000, bits: int | None = None, hashed=F.xxhash64) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal normalised texts the largest ``doc_id`` stays.  Null and empty texts
    are one group.  Rows that repeat a doc_id count each; those of the largest
    one all count as kept.  A null doc_id never beats another.  ``hashed`` is a
    parameter so that tests can make collisions.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    keyed = rows.select("doc_id", "text", hashed("text").alias("hash"))
    repeated = cut_lineage(keyed.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1").select("hash"))
    shared = keyed.join(repeated, "hash", "left_semi")
    entries = shared.select("hash", F.sha2("text", 256).alias("sha"), "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    index = cut_lineage(build_index(entries, capacity, bits).select("hash", "sha", "keep_id", "n"))
    members = keyed.select("doc_id", "hash", F.sha2("text", 256).alias("sha"))
    found = members.join(index, ["hash", "sha"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM t
"""
