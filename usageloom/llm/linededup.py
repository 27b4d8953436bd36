"""Removal of multi-line passages that repeat across the corpus, cut at content-defined places.

Native throughout: line arrays and higher-order functions inside the row, joins
and partial aggregates between rows; no Python runs on the executors.

A rolling hash over the hashes of the last ``window`` lines decides after which
lines a chunk ends, so the chunks of a passage are the same wherever it stands.
Only hashes of chunks are counted over the corpus; texts move for chunks whose
hash repeats, where grouping by the text itself compares the bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm.common import cut_lineage, read_table

_MODULUS, _FACTOR = 2_147_483_647, 1_000_003


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def _chunks(text: Column, window: int, every: int) -> Column:
    """The chunks of a text, its lines written with an ``x`` before each.

    No line is empty then, so an empty line after each last line of a chunk
    (but the text's last one) makes one split of the whole text give its
    chunks: every step takes time in proportion to the text.
    """
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, _line_hash)
    rolled = hashes
    for back in range(1, window):
        factor = F.lit(pow(_FACTOR, back, _MODULUS) % 1_000_000_007)
        earlier = F.concat(F.array_repeat(F.lit(0).cast("long"), back), hashes)
        rolled = F.zip_with(rolled, earlier, _rolling(factor))
    marked = F.zip_with(lines, rolled, lambda line, r: F.concat(F.lit("x"), line, F.when(r % every == 0, "\n").otherwise("")))
    return F.split(F.rtrim(F.array_join(marked, "\n"), F.lit("\n")), "\n\n", -1)


def _rolling(factor: Column):
    return lambda total, h: (total + h * factor) % _MODULUS


def _plain(written: Column) -> Column:
    """Lines as they were."""
    return F.substring(F.replace(written, F.lit("\nx"), F.lit("\n")), 2, 2_147_483_647)


def _n_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", "")) + 1


def _is_in(numbers: Column, some: Column) -> Column:
    """For each of ``numbers`` (sorted) whether it is among ``some``: both are sorted together, a mark before its number."""
    both = F.array_sort(F.concat(F.transform(numbers, lambda n: n * 2), F.transform(some, lambda n: n * 2 - 1)))
    flags = F.zip_with(both, F.concat(F.array(F.lit(-2)), both), lambda n, before: F.when(n % 2 == 0, before == n - 1))
    return F.filter(flags, lambda flag: flag.isNotNull())


ADDED = ("n_lines", "removed_lines", "removed_chunks")


def dedup_lines(docs: DataFrame, window: int = 2, every: int = 3, min_lines: int = 2) -> DataFrame:
    """Rows and columns of ``docs`` (``doc_id``, ``text`` and others) with repeated chunks cut out of ``text``.

    Of chunks with the same text and at least ``min_lines`` lines that are not
    empty, the first by (doc_id, place in the text) stays; a null id is before
    all others.  Adds ``n_lines``, ``removed_lines`` and ``removed_chunks`` (columns
    of these names are replaced).  Null texts stay null; a text of repeated
    chunks only becomes empty.  Rows that repeat both id and text count as one
    and share their fate.  Time grows with the length of a text.  Both joins
    that texts pass are merge joins at every size, since what they meet has no bound.
    """
    own = [c for c in docs.columns if c not in ("text", *ADDED)]
    keyed = docs.select(F.struct(*own).alias("_rest"), "doc_id", "text", F.xxhash64("text").alias("_text_hash"))
    each = keyed.where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("_id"), "_text_hash", F.posexplode(_chunks(F.col("text"), window, every)).alias("_at", "_chunk"))
    several = r"(?s)(?:\A|\n)x[^\n]" + r".*?\nx[^\n]" * (min_lines - 1)
    chunks = each.where(F.col("_chunk").rlike(several)).withColumn("_hash", F.xxhash64("_chunk"))

    repeated = cut_lineage(chunks.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash"))
    shared = cut_lineage(chunks.join(repeated.hint("merge"), "_hash", "left_semi"))
    place = F.struct("_id", "_text_hash", "_at")
    first = shared.groupBy("_hash", "_chunk").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = shared.join(first, ["_hash", "_chunk"]).where(~place.eqNullSafe(F.col("_first")))
    dropped = cut_lineage(later.groupBy("_id", "_text_hash").agg(F.collect_set("_at").alias("_dropped")))

    found = keyed.join(dropped.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (keyed["_text_hash"] == dropped["_text_hash"]), "left")
    all_ = F.when(F.col("_dropped").isNotNull(), _chunks(F.col("text"), window, every))
    cut = found.select("_rest", "text", "_dropped", all_.alias("_all"))
    gone = _is_in(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_dropped"))
    left = F.array_join(F.zip_with("_all", gone, lambda chunk, g: F.when(~g, chunk)), "\n")
    cut = cut.select("_rest", "text", F.coalesce(F.size("_dropped"), F.lit(0)).alias("_n"), F.size("_all").alias("_of"), left.alias("_left"))
    n_lines = F.coalesce(_n_lines(F.col("text")), F.lit(0))
    kept_lines = F.when(F.col("_n") == F.col("_of"), 0).otherwise(_n_lines(F.col("_left")))
    touched = F.col("_left").isNotNull()
    return cut.select("_rest.*", F.when(touched, _plain(F.col("_left"))).otherwise(F.col("text")).alias("text"), n_lines.cast("long").alias("n_lines"),
                      F.when(touched, n_lines - kept_lines).otherwise(0).cast("long").alias("removed_lines"),
                      F.when(touched, F.col("_n")).otherwise(0).cast("long").alias("removed_chunks"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def line_dedup_ctes(table: str) -> str:
    """``WITH`` clauses whose last, ``cleaned``, has the rows of :func:`dedup_lines` with its defaults."""
    return f"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
          FROM {table} WHERE text IS NOT NULL),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM lines),
marked AS (SELECT doc_id, i, line, ((h + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {pow(_FACTOR, 1, _MODULUS) % 1_000_000_007})
                                    % {_MODULUS}) % 3 = 0 AS ends FROM hashed),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
             FROM marked),
chunks AS (SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n, count(*) FILTER (line <> '') AS full_lines
           FROM numbered GROUP BY doc_id, c),
judged AS (SELECT *, full_lines >= 2 AND row_number() OVER (PARTITION BY chunk, full_lines >= 2 ORDER BY doc_id, c) > 1 AS gone FROM chunks),
cleaned AS (SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(j.kept, '') END AS text, coalesce(j.n_lines, 0)::BIGINT AS n_lines,
                   coalesce(j.removed_lines, 0)::BIGINT AS removed_lines, coalesce(j.removed_chunks, 0)::BIGINT AS removed_chunks
            FROM {table} d LEFT JOIN (
              SELECT doc_id, string_agg(chunk, chr(10) ORDER BY c) FILTER (NOT gone) AS kept, sum(n) AS n_lines,
                     coalesce(sum(n) FILTER (gone), 0) AS removed_lines, count(*) FILTER (gone) AS removed_chunks
              FROM judged GROUP BY doc_id) j USING (doc_id))"""


OP4_SQL = f"WITH {line_dedup_ctes('documents')} SELECT doc_id, text, n_lines, removed_lines, removed_chunks FROM cleaned"
