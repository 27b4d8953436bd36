"""What several operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usageloom.session import cut_lineage, shared_dir  # noqa: F401  (re-exported to the operators)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str) -> Column:
    """crc32 of the id written as text, from which training and held-out rows are told apart."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def crc_sql(text: str) -> str:
    """DuckDB SQL for the crc32 of ASCII ``text``, which it has no function for: bit by bit over the characters."""
    bit = "lambda a, i: xor(a >> 1, 3988292384::UBIGINT * (a & 1))"
    byte = f"lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)::UBIGINT[]), {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), {byte}), 4294967295::UBIGINT)"


def text_bytes(text: Column) -> Column:
    """Length in UTF-8; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def rank_within(df: DataFrame, keys: list[str], order: list[str], counts: DataFrame, seed: int = 0,
                bucket_rows: int = 50_000) -> DataFrame:
    """Add ``rank``: a seeded, repeatable numbering from 0 of the rows of each key.

    ``counts`` has one row per key with its number of rows in ``n`` (its other
    columns are carried along).  A hot key is dealt over ``n / bucket_rows``
    hash buckets, so no task sorts more than about ``bucket_rows`` rows of it;
    the buckets' sizes, summed up, give each bucket the first rank of its rows.
    Keys must not be null.  Rows that are equal in ``order`` are interchangeable.
    """
    rows = df.join(counts, keys)
    buckets = F.ceil(F.col("n") / F.lit(bucket_rows))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), *order)).withColumn("_part", F.pmod("_hash", buckets))
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_hash", *order)
    ranked = rows.withColumn("_row", F.row_number().over(inside)).join(first, [*keys, "_part"])
    return ranked.withColumn("rank", (F.col("_first") + F.col("_row") - 1).cast("long")).drop(
        "_hash", "_part", "_first", "_row")


class Memo(dict):
    """Values of recent short keys (text or bytes), computed on demand; emptied when they take about ``limit`` bytes."""

    def __init__(self, compute, limit: int = 64 << 20, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.used = compute, limit, longest, 0

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            self.used += 200 + 2 * len(key)  # both objects and their place in the table, about
            if self.used > self.limit:
                self.clear()
            self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.used = 0


def segment_pattern(pieces: Iterable[str], space: str) -> re.Pattern:
    """Matches the stretches of a text that no merge can leave, given all ``pieces`` of a vocabulary.

    Characters that stand side by side in a piece belong to one class; between
    two classes no piece passes.  A stretch is a run of one class (or one
    character that joins no other) with the spaces before it.
    """
    parent: dict[str, str] = {}

    def find(c: str) -> str:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    for piece in pieces:
        own = piece.lstrip(space)
        if space in own:
            raise ValueError("a piece passes over a space: stretches are not independent")
        for a, b in zip(own, own[1:]):
            parent[find(a)] = find(b)
        if len(own) > 1 and len(set(own)) == 1:
            parent.setdefault(own[0], own[0])
    classes: dict[str, list[str]] = {}
    for c in sorted(parent):
        classes.setdefault(find(c), []).append(c)
    runs = "|".join(f"[{re.escape(''.join(own))}]+" for own in sorted(classes.values(), key=len, reverse=True))
    return re.compile(f"{space}*(?:{runs}|[^{space}])|{space}+", re.DOTALL)


# The 64-bit word and shingle hashes below are polynomials over bytes and words, mixed at the end.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SLICE = 1 << 19
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for ``n`` bytes; those for one slice are kept, a longer word brings its own."""
    if n <= len(_POWERS[0]) if _POWERS else False:
        return _POWERS[0][:n], _POWERS[1][:n]
    size = max(n, _SLICE + 2)
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    made = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    if size == _SLICE + 2:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes, A-Z lower-cased.

    Long texts are hashed in slices that end at a blank.
    """
    if len(data) <= _SLICE:
        return _word_hashes(data)
    found, at = [], 0
    while at < len(data):
        to = min(at + _SLICE, len(data))
        while to < len(data):
            gap = np.flatnonzero(_blank(data[to - _SLICE // 8:to]))
            if len(gap):
                to = to - _SLICE // 8 + int(gap[-1]) + 1
                break
            to = min(to + _SLICE // 8, len(data))
        hashes, starts = _word_hashes(data[at:to])
        found.append((hashes, starts + at))
        at = to
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = _blank(data)
    inside = np.concatenate(([False], ~blank, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lower = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((lower + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], width: int = 5, limit: int = 1 << 18) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A text with fewer words than ``width`` has its whole word sequence as its
    one shingle; one without words has none.  Texts are hashed together in
    pieces of about ``limit`` bytes; a longer text alone.
    """
    batch: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if batch and size + len(raw) > limit:
            yield from _shingles(batch, width)
            batch, size = [], 0
        batch.append(raw)
        size += len(raw) + 1
    if batch:
        yield from _shingles(batch, width)


def _shingles(batch: list[bytes], width: int) -> Iterator[np.ndarray]:
    words, starts = word_hashes(np.frombuffer(b"\n".join(batch), np.uint8))
    ends = np.cumsum([len(x) + 1 for x in batch])
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    total = max(0, len(words) - width + 1)
    rolled = np.zeros(total, np.uint64)
    for k in range(width):
        rolled = rolled * _BASE + words[k:k + total]
    rolled = mix64(rolled)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            yield np.unique(rolled[a:b - width + 1])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in words[a:b]:
                    whole = whole * _BASE + x
            yield mix64(np.array([whole], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def places(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``df``, written, with ``place`` (long): a numbering from 0 of the rows of each ``key`` in ``order``.

    Rows are dealt by ranges of (key, order), so a hot key spreads over tasks; the
    counts of each key per partition, summed up, give the first number there.
    Rows that are equal in ``order`` take any numbers.  Keys must not be null.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(key), *order, F.col("_tie")]
    dealt = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    dealt = cut_lineage(dealt)
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    found = dealt.groupBy(key, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = found.select(key, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = dealt.withColumn("_part", part).join(starts, [key, "_part"])
    return numbered.select(*df.columns, (F.col("_at") + F.col("_shift")).alias("place"))
