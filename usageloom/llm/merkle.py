"""Merkle manifest of a dataset: a root, and for every row a leaf with its witness.

Rows get their place within their tree (one tree per language), and aligned
blocks of places become tasks.  A task appends the leaves of its block one by
one.  The open subtrees are those whose sibling has not come yet; each leaf
under them holds a partial witness, which every later completion of a sibling
extends.  The roots of blocks are appends of the next round, and so on to one
root per tree; the roots of trees are once more leaves, of the tree at the top.
On the way down, each block receives the witness of its own root, so that no
witness is ever stored or shuffled before it is complete.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm.common import crc_of_id, crc_sql, cut_lineage, places, read_table

#: 2 ** BLOCK_LEVELS rows are one append task.
BLOCK_LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<left: boolean, digest: string>>"


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Appender:
    """Aligned append of leaves with incremental witnesses.

    ``witness[k]`` lists, from the leaf upwards, ``(left, digest)`` of the
    siblings of leaf ``k``: whether it stands to the left, and its digest, or
    None where a node is alone in its run.
    """

    def __init__(self):
        self.open: list[tuple[int, int, int, str]] = []  # level, first leaf, end, digest; levels fall from left to right
        self.witness: list[list[tuple[bool, str | None]]] = []

    def append(self, digest: str) -> None:
        k = len(self.witness)
        self.witness.append([])
        self.open.append((0, k, k + 1, digest))
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        level, middle, end, right = self.open.pop()
        _, first, _, left = self.open.pop()
        for own in self.witness[first:middle]:
            own.append((False, right))
        for own in self.witness[middle:end]:
            own.append((True, left))
        self.open.append((level + 1, first, end, digest_of(left, right)))

    def seal(self, height: int) -> str:
        """Close what is open to one root at ``height``; a node without a sibling is hashed alone."""
        while len(self.open) > 1 or self.open[-1][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._join()
                continue
            level, first, end, digest = self.open.pop()
            for own in self.witness[first:end]:
                own.append((False, None))
            self.open.append((level + 1, first, end, digest_of(digest)))
        return self.open[-1][3]


def _height(nodes: int, levels: int) -> int:
    """Levels from ``nodes`` nodes up to their one root, at most ``levels`` of them in a block."""
    return min(levels, (nodes - 1).bit_length())


def _appended(rows: pa.Table, levels: int) -> tuple[pa.Table, Appender, str]:
    rows = rows.sort_by("place")
    appender = Appender()
    for digest in rows.column("digest").to_pylist():
        appender.append(digest)
    return rows, appender, appender.seal(_height(rows.column("nodes")[0].as_py(), levels))


def _block(levels: int) -> Column:
    return F.shiftright("place", levels).alias("block")


def climb(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """``nodes`` (``tree, place, digest, nodes``: how many the tree has, and more columns), then the
    roots of their blocks, and so on until each tree has one node.  Each step is written.
    """
    def root(key: tuple, rows: pa.Table) -> pa.Table:
        count = rows.column("nodes")[0].as_py()
        _, _, digest = _appended(rows, levels)
        tree, block = (k.as_py() for k in key)
        return pa.table({"tree": [tree], "place": pa.array([block], pa.int64()), "digest": [digest], "nodes": pa.array([-(-count >> levels)], pa.int64())})

    steps = [nodes]
    while (steps[-1].agg(F.max("nodes")).first()[0] or 1) > 1:
        slim = steps[-1].select("tree", "place", "digest", "nodes", _block(levels))
        steps.append(cut_lineage(slim.groupBy("tree", "block").applyInArrow(root, "tree string, place long, digest string, nodes long")))
    return steps


def descend(steps: list[DataFrame], above: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The first of ``steps`` with ``siblings``, from the leaf to the root, and ``subroot``.

    ``above`` (``tree, place, siblings, subroot``) belongs to the last step, one row per tree.
    """
    for nodes in reversed(steps[:-1]):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)

        def witnessed(rows: pa.Table, upper: pa.Table) -> pa.Table:
            if not upper.num_rows:
                raise ValueError("a block without a root")
            rows, appender, _ = _appended(rows.drop_columns(["block"]), levels)
            rest = [(s["left"], s["digest"]) for s in upper.column("siblings")[0].as_py()]
            flat = [s for own in appender.witness for s in (*own, *rest)]
            ends = [0]
            for own in appender.witness:
                ends.append(ends[-1] + len(own) + len(rest))
            pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.bool_()), pa.array([s[1] for s in flat], pa.string())], ["left", "digest"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            subroot = pa.array([upper.column("subroot")[0].as_py()] * rows.num_rows, pa.string())
            return rows.append_column("siblings", lists).append_column("subroot", subroot)

        blocks = nodes.withColumn("block", _block(levels)).groupBy("tree", "block")
        upper = above.withColumnRenamed("place", "block").groupBy("tree", "block")
        above = blocks.cogroup(upper).applyInArrow(witnessed, f"{schema}, siblings {SIBLINGS}, subroot string")
    if len(steps) == 1:
        return steps[0].join(above.select("tree", "siblings", "subroot"), "tree")
    return above


def fold(digest: Column, siblings: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    def up(node: Column, s: Column) -> Column:
        other = F.coalesce(s["digest"], F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(siblings, digest, up)


def leaf(row: dict[str, Column]) -> Column:
    """Digest of a row's fields, each as its length in UTF-8, a colon and its value, or ``-`` if null."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(row[name]) for name in FIELDS]), 256)


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row of ``docs`` (columns ``FIELDS``): ``doc_id, leaf, tampered_leaf, subroot, root, siblings``.

    One tree per ``lang``, leaves ascending by ``doc_id`` (null first; equal ids by
    leaf, so that repeated rows are leaves of their own with equal digests).  Trees
    ascend by ``lang`` (null first, bytewise).  ``siblings`` goes level by level from
    the leaf over its subroot to the root; ``digest`` is null where a node is alone.
    ``tampered_leaf`` is the leaf of the row with 1 added to ``n_chars`` (null stays
    null).  Nulls in any column, empty and long texts are plain values; an empty
    table has no rows.  The root does not depend on ``levels`` or on partitions.
    """
    columns = {name: docs[name] for name in FIELDS}
    changed = columns | {"n_chars": docs["n_chars"] + F.lit(1)}
    # "-" stands before "=", so null languages come first and bytewise order stays.
    tree = F.coalesce(F.concat(F.lit("="), docs["lang"]), F.lit("-"))
    leaves = docs.select(tree.alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), leaf(columns).alias("digest"), leaf(changed).alias("tampered_leaf"))
    placed = places(leaves, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    counts = placed.groupBy("tree").agg(F.count("*").alias("nodes"))
    below = climb(cut_lineage(placed.join(counts, "tree")), levels)

    named = below[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = places(named, "tree", [F.col("name")])
    over = climb(cut_lineage(tops.join(tops.groupBy("tree").agg(F.count("*").alias("nodes")), "tree")), levels)
    found = over[-1].first()
    root = found["digest"] if found else None
    start = over[-1].select("tree", "place", F.array().cast(SIBLINGS).alias("siblings"), F.lit("").alias("subroot"))
    trees = descend(over, start, levels).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "siblings", F.col("digest").alias("subroot"))
    out = descend(below, cut_lineage(trees), levels)
    return out.select("doc_id", F.col("digest").alias("leaf"), "tampered_leaf", "subroot", F.lit(root).alias("root"), "siblings")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest(read_table(spark, sf_dir, "documents"))
    tampered = F.coalesce(crc_of_id("doc_id") % 7 == 0, F.lit(False))
    folded = made.withColumn("folded_root", fold(F.when(tampered, F.col("tampered_leaf")).otherwise(F.col("leaf")), F.col("siblings")))
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: s["digest"]), ""), 256)
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _fields(chars: str) -> str:
    columns = ("doc_id", "source", "lang", chars, "text")
    return " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


OP12_SQL = f"""WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang, sha256({_fields('n_chars')}) AS leaf,
    sha256({_fields('n_chars + 1')}) AS other,
    coalesce({crc_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0, false) AS tampered FROM documents),
placed AS MATERIALIZED (SELECT *, coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows_),
low AS (
  SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (min(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, level, place // 2),
subs AS MATERIALIZED (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, place, subroot AS digest, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (min(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, place // 2),
paths AS MATERIALIZED (
  SELECT p.tree, p.place, h.level AS step, (p.place >> h.level) % 2 = 1 AS on_right, s.digest FROM placed p JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) h USING (tree)
  LEFT JOIN low s ON s.tree = p.tree AND s.level = h.level AND s.place = xor(p.place >> h.level, 1)
  UNION ALL
  SELECT p.tree, p.place, 1000 + h.level, (t.place >> h.level) % 2 = 1, s.digest FROM placed p JOIN subs t USING (tree) CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) h
  LEFT JOIN high s ON s.level = h.level AND s.place = xor(t.place >> h.level, 1)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree, place ORDER BY step) AS k FROM paths),
folds AS (
  SELECT tree, place, 0::BIGINT AS k, CASE WHEN tampered THEN other ELSE leaf END AS node FROM placed
  UNION ALL
  SELECT f.tree, f.place, s.k, sha256(CASE WHEN s.on_right THEN coalesce(s.digest, '') || f.node ELSE f.node || coalesce(s.digest, '') END) FROM folds f JOIN numbered s
  ON s.tree = f.tree AND s.place = f.place AND s.k = f.k + 1),
ends AS (SELECT tree, place, arg_max(node, k) AS folded_root FROM folds GROUP BY 1, 2),
proofs AS (SELECT tree, place, sha256(string_agg(coalesce(digest, ''), '' ORDER BY k)) AS proof_sha256 FROM numbered GROUP BY 1, 2)
SELECT doc_id, leaf, subroot, digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = digest AS verified
FROM placed JOIN subs USING (tree) JOIN ends ON ends.tree = placed.tree AND ends.place = placed.place LEFT JOIN proofs ON proofs.tree = placed.tree AND proofs.place = placed.place,
(SELECT digest FROM high WHERE n = 1)"""
