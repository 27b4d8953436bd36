"""Trie of conversation prefixes on a minimal-perfect-hash node table.

Rows are slim from the start: a turn is two 64-bit hashes, a SHA-256 and a
length; texts are never moved.

1. A prefix is known by its depth and two numbers, the exclusive-or of the
   hashes of (place, turn) up to there.  Such digests of a long conversation are
   made in blocks of turns and joined, so no task needs a conversation whole.
2. The distinct digests are enumerated.  Each is verified: all its members must
   come from one parent and end in one turn (SHA-256), else everything is done
   again with another seed.  A node belongs to its smallest member.
3. Blocks of turns are dealt over shards.  A shard assigns its digests slots by a
   minimal perfect hash (the key is kept in the slot, a look-up compares it),
   scatters counts into flat arrays and adds them to parent slots from the
   deepest depth upwards.  What later blocks of a conversation hand up enters at
   the last turn of a block.
4. What a shard knows about a node is partial, all of it sums: nodes are added
   up over shards.

A subtree's sum over nodes counts a node once, in the shard of its smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usageloom.llm.common import crc_of_id, crc_sql, cut_lineage, mix64, places, read_table

NODE = ["depth", "x", "y"]
PARENT = ["above_x", "above_y"]


class SlotTable:
    """Minimal perfect hash of distinct keys (rows of three 64-bit numbers).

    Level by level, keys that are alone at their place of a bit array stay there
    and the others go to the next level; a key's slot is the number of bits before its own.
    """

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.bits: list[np.ndarray] = []
        left = np.arange(len(keys))
        slots = np.empty(len(keys), np.int64)
        used = 0
        while len(left):
            size = max(8, int(room * len(left)))
            at = self._place(keys[left], len(self.bits), size)
            alone = np.bincount(at, minlength=size) == 1
            own = alone[at]
            slots[left[own]] = used + np.cumsum(alone)[at[own]] - 1
            self.bits.append(alone)
            used += int(own.sum())
            left = left[~own]
        self.keys = np.empty_like(keys)
        self.keys[slots] = keys
        self.starts = np.cumsum([0, *(int(b.sum()) for b in self.bits)])
        self.ranks = [np.cumsum(b) for b in self.bits]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mix64(keys[:, 1] + np.uint64(level)) ^ mix64(keys[:, 2] + np.uint64(3 * level + 1)) ^ mix64(keys[:, 0] + np.uint64(7 * level))
        return (mix64(h) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots, -1 for keys that are not in the table."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            at = self._place(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.starts[level] + self.ranks[level][at[hit]] - 1
            left = left[~hit]
        known = out >= 0
        known[known] = (self.keys[out[known]] == keys[known]).all(axis=1)
        return np.where(known, out, -1)


def _keys(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([rows.column(n).to_numpy() for n in names], 1).astype(np.int64).view(np.uint64)


PARTIAL = ("depth long, x long, y long, above_x long, above_y long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")


def _accumulate(rows: pa.Table, told: pa.Table, block: int) -> pa.Table:
    """Partial sums of the nodes of a shard.

    ``rows``: members (conv_id, node, parent, n_bytes).  ``told``: nodes that the
    shard owns (kind 0, ``leaves`` is 1 for a childless one), and what the later
    blocks of a conversation hand up at the last turn of a block (kind 1).
    Nothing passes from one block to another here.
    """
    members = _keys(rows, NODE)
    distinct, first = np.unique(members, axis=0, return_index=True)
    table = SlotTable(distinct)
    n = len(distinct)
    slot = table(members)
    to_slot = table(distinct)

    def flat(name: str) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[to_slot] = rows.column(name).to_numpy()[first]
        return out

    depth, above_x, above_y, size = (flat(name) for name in ("depth", *PARENT, "n_bytes"))
    parent = table(np.stack([depth - 1, above_x, above_y], 1).view(np.uint64))
    inner = depth % block > 0
    if (slot < 0).any() or (parent[inner] < 0).any():
        raise ValueError("a digest without a slot")
    n_convs = np.bincount(slot, minlength=n)
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, slot, rows.column("conv_id").to_numpy())

    owned, leaves, children, saved = (np.zeros(n, np.int64) for _ in range(4))
    if told.num_rows:
        at = table(_keys(told, NODE))
        if (at < 0).any():
            raise ValueError("told of a node without a member here")
        owned[at[told.column("kind").to_numpy() == 0]] = 1
        for into, name in ((leaves, "leaves"), (children, "children"), (saved, "saved")):
            np.add.at(into, at, told.column(name).to_numpy())
    saved += (n_convs - owned) * size
    np.add.at(children, parent[inner], owned[inner])
    by_depth = np.argsort(depth, kind="stable")
    starts = np.append(_starts(depth[by_depth]), n)
    for a, b in zip(starts[-2::-1], starts[:0:-1]):  # the deepest first
        here = by_depth[a:b][inner[by_depth[a:b]]]
        np.add.at(leaves, parent[here], leaves[here])
        np.add.at(saved, parent[here], saved[here])
    found = [depth, table.keys[:, 1].view(np.int64), table.keys[:, 2].view(np.int64), above_x, above_y, smallest, n_convs, children, leaves, saved]
    return pa.table(dict(zip([c.split()[0] for c in PARTIAL.split(", ")], map(pa.array, found))))


def _starts(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, turn``, ``v1`` to ``v4`` (240 bits of a turn's SHA-256) and ``n_bytes``; null role or text counts as empty."""
    role, text = (F.coalesce(turns[c], F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    slim = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), sha.alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"))
    return slim.select("conv_id", "turn", *[F.conv(F.substring("sha", 15 * k + 1, 15), 16, 10).cast("long").alias(f"v{k + 1}") for k in range(4)], "n_bytes")


def _prefixes(turns: DataFrame, lengths: DataFrame, seed: int, block: int) -> DataFrame:
    """A row per conversation and depth, from depth 0: node, parent, verification and whether it goes on."""
    content = ["v1", "v2", "v3", "v4"]
    own = [F.xxhash64(F.lit(2 * seed + k), "depth", *content) for k in range(2)]
    part = (F.col("depth") / block).cast("long")
    hashed = turns.select("*", part.alias("block"), own[0].alias("hx"), own[1].alias("hy"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.where(F.col("length") >= block).groupBy("conv_id", "block").agg(F.bit_xor("hx").alias("tx"), F.bit_xor("hy").alias("ty"))
    starts = sums.select("conv_id", "block", F.bit_xor("tx").over(before).alias("tx"), F.bit_xor("ty").over(before).alias("ty"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = hashed.withColumns({"x": F.bit_xor("hx").over(inside), "y": F.bit_xor("hy").over(inside)}).join(starts, ["conv_id", "block"], "left")
    x, y = (F.col(n).bitwiseXOR(F.coalesce(f"t{n}", F.lit(0))) for n in "xy")
    nodes = rolled.select("conv_id", "depth", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("hx")).alias("above_x"), y.bitwiseXOR(F.col("hy")).alias("above_y"),
                          *content, "n_bytes", (F.col("depth") < F.col("length")).alias("goes_on"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "x", "y", *PARENT, *content, "n_bytes")]
    return lengths.select("conv_id", *zero, (F.col("length") > 0).alias("goes_on")).unionByName(nodes)


def _ends(prefixes: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ascending ids of the conversations that end there, joined by commas.

    Ranges of (node, id) become pieces of text first, so that the one task which
    hashes a node reads a hot node's pieces and not its ids, and holds one at a time.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], batch.column(3).to_pylist()
            new = np.zeros(len(ids), bool)
            new[::4096] = True
            for c in node:
                new[1:] |= c[1:] != c[:-1]
            edges = [*np.flatnonzero(new).tolist(), len(ids)]
            first = edges[:-1]
            pieces = [",".join(map(str, ids[a:b])) for a, b in zip(first, edges[1:])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[first]) for c in node), pa.array([ids[a] for a in first], pa.int64()), pa.array(pieces, pa.string())], [*NODE, "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for *node, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if node == now:
                    sha.update(b"," + piece.encode())
                    continue
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(piece.encode())
            yield _end_rows(done)
        if now is not None:
            yield _end_rows([(*now, sha.hexdigest())])

    by = [*NODE, "conv_id"]
    ends = prefixes.where("not goes_on").select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    pieces = ends.mapInArrow(packed, "depth long, x long, y long, first long, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").drop("first").mapInArrow(hashed, "depth long, x long, y long, ends_sha256 string")


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], [*NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame, lengths: DataFrame, block: int = 4096, shard_rows: int = 16_384) -> DataFrame:
    """The nodes of the trie of all prefixes; ``turns``: conv_id, depth (from 1), v1 to v4, n_bytes, length; ``lengths``: conv_id, length.

    Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.  Every row of
    ``lengths`` is a member of the root, turnless ones too; no rows, no root.
    Give written tables: they are read twice.  ``block`` turns of a conversation
    and about ``shard_rows`` prefixes are what a task holds.
    """
    for seed in count():
        prefixes = cut_lineage(_prefixes(turns, lengths, seed, block))
        checked = [*PARENT, "v1", "v2", "v3", "v4"]
        nodes = prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.max("goes_on").alias("inner"), *[F.min(c).alias(f"lo_{c}") for c in checked], *[F.max(c).alias(f"hi_{c}") for c in checked])
        same = F.lit(True)
        for c in checked:
            same = same & (F.col(f"lo_{c}") == F.col(f"hi_{c}"))
        nodes = cut_lineage(nodes.select(*NODE, "rep", "inner", same.alias("same")))
        if nodes.where("not same").isEmpty():
            break

    shards = max(1, -(-prefixes.count() // shard_rows))

    def shard(conv_id: Column) -> Column:
        """Neighbouring conversations together (they share beginnings), at most 50 blocks of turns."""
        return F.pmod(F.xxhash64(F.floor(conv_id / 50), (F.col("depth") / block).cast("long")), F.lit(shards)).alias("shard")

    owned = nodes.select(shard(F.col("rep")), *NODE, F.lit(0).alias("kind"), F.when(F.col("inner"), 0).otherwise(1).cast("long").alias("leaves"),
                         F.lit(0).cast("long").alias("children"), F.lit(0).cast("long").alias("saved"))
    # What the later blocks of long conversations add to their earlier ones.
    later = prefixes.where(F.col("depth") >= block).join(nodes, NODE)
    mine = F.col("rep") == F.col("conv_id")
    blocks = later.groupBy("conv_id", (F.col("depth") / block).cast("long").alias("block")).agg(
        F.sum(F.when(mine & ~F.col("inner"), 1).otherwise(0)).alias("leaves"), F.sum(F.when(mine, 0).otherwise(F.col("n_bytes"))).alias("saved"),
        F.sum(F.when(mine & (F.col("depth") % block == 0), 1).otherwise(0)).alias("children"))
    onwards = Window.partitionBy("conv_id").orderBy("block").rowsBetween(0, Window.unboundedFollowing)
    sums = blocks.select("conv_id", (F.col("block") * block - 1).alias("depth"), F.sum("leaves").over(onwards).alias("leaves"), "children", F.sum("saved").over(onwards).alias("saved"))
    tails = prefixes.where((F.col("depth") % block == block - 1) & F.col("goes_on")).select("conv_id", *NODE)
    handed = tails.join(sums, ["conv_id", "depth"]).select(shard(F.col("conv_id")), *NODE, F.lit(1).alias("kind"), "leaves", "children", "saved")

    members = prefixes.select(shard(F.col("conv_id")), "conv_id", *NODE, *PARENT, "n_bytes")
    told = owned.unionByName(handed)
    partial = members.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(lambda rows, known: _accumulate(rows, known, block), PARTIAL)
    whole = cut_lineage(partial.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.min("above_x").alias("above_x"), F.min("above_y").alias("above_y"),
                                                   *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]))
    parents = whole.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("above_x"), F.col("y").alias("above_y"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(parents, ["depth", *PARENT], "left").join(_ends(prefixes), NODE, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of the conversations with their beginnings exchanged, for ``prefix_trie``.

    Turns are ordered by ``turn`` (null first; equal ones by their digest).  The
    first h turns of conversation c (h: crc32 of c in decimal, modulo ``most + 1``)
    come from conversation ``c - c % family``: all it has if fewer, none if there
    is no such conversation; own turns follow after the first h.  Rows without
    a conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    """
    slim = turn_digests(conversations).where(F.col("conv_id").isNotNull())
    placed = cut_lineage(places(slim, "conv_id", [F.col("turn").asc_nulls_first(), F.col("v1"), F.col("v2")]))
    had = placed.groupBy("conv_id").agg(F.count("*").alias("had"))
    wants = had.select("conv_id", "had", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (crc_of_id("conv_id") % (most + 1)).alias("h"))
    bases = had.select(F.col("conv_id").alias("base"), F.col("had").alias("base_had"))
    lengths = wants.join(bases, "base", "left").withColumn("shift", F.least("h", F.coalesce("base_had", F.lit(0))))
    lengths = cut_lineage(lengths.select("conv_id", "base", "h", "shift", (F.col("shift") + F.greatest(F.col("had") - F.col("h"), F.lit(0))).alias("length")))
    content = ["v1", "v2", "v3", "v4", "n_bytes", "length"]
    own = placed.join(lengths, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("shift") + 1).alias("depth"), *content)
    heads = placed.where(F.col("place") < most).withColumnRenamed("conv_id", "base").join(lengths, "base").where("place < h").select(
        "conv_id", (F.col("place") + 1).alias("depth"), *content)
    return own.union(heads), lengths.select("conv_id", "length")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(read_table(spark, sf_dir, "conversations")))


_TURN = "octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')"
OP13_SQL = f"""WITH had AS (SELECT conv_id, sha256({_TURN}) AS turn_sha, octet_length(encode(coalesce(text, ''))) AS n_bytes,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, CAST({crc_sql('CAST(conv_id AS VARCHAR)')} % 9 AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM had)),
own AS (SELECT c.conv_id, t.turn_sha, t.n_bytes, t.place, 0 AS part FROM convs c JOIN had t ON t.conv_id = c.base AND t.place < c.h
  UNION ALL SELECT c.conv_id, t.turn_sha, t.n_bytes, t.place, 1 FROM convs c JOIN had t ON t.conv_id = c.conv_id AND t.place >= c.h),
turns AS MATERIALIZED (SELECT conv_id, turn_sha, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM own),
prefixes AS MATERIALIZED (SELECT conv_id, depth, sha256(string_agg(turn_sha, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node, n_bytes FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM prefixes GROUP BY 1),
nodes AS MATERIALIZED (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(n_bytes) AS n_bytes, count(*) AS n_convs,
  bool_and(depth = length) AS childless, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length) AS ends FROM prefixes JOIN lengths USING (conv_id) GROUP BY node),
above AS (SELECT n.node AS below, p.node AS node, p.depth FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
sums AS (SELECT a.node, CAST(count(*) FILTER (n.childless) AS BIGINT) AS n_leaves, CAST(sum((n.n_convs - 1) * n.n_bytes) AS BIGINT) AS saved_tokens,
  CAST(count(*) FILTER (n.depth = a.depth + 1) AS BIGINT) AS n_children FROM above a JOIN nodes n ON n.node = a.below GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN (SELECT a.below, m.conv_id FROM above a JOIN nodes m ON m.node = a.node JOIN nodes n ON n.node = a.below WHERE a.depth = n.depth - 1) p ON p.below = n.node"""
