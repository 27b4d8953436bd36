"""N-gram Jaccard join by T-occurrence search, as groups of linked documents.

Two sets of shingles link when ``100 * |both| >= percent * |either|``.  All links
matter for the groups, but a link inside a group that is known need not be found
again; this is what keeps big groups of near copies from growing as their square.

1. Documents with equal sets form a class; its smallest id stands for it.
2. How many documents have each shingle is counted over all of them.  The most
   frequent ones (a bounded number, broadcast) come last in the order of
   shingles, before them others that are not rare (an array of bits); the order
   only decides how much work there is, never the result.
3. Linked sets have several shingles in common among the first ones in that
   order, a prefix of about a third.  Documents that do, and are not too
   different in size, belong to one cluster (not yet verified).
4. The texts of clusters meet, in blocks of bounded size.  There, inverted lists
   are searched by DivideSkip: the short ones are merged by a heap, the long ones
   probed, and whoever reaches the required overlap is a link.  In a cluster
   beyond one block, what links with a pivot is known to hang together; all
   others meet every block.
5. Links are joined to components.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm.common import cut_lineage, mix64, read_table, shingle_sets
from usageloom.llm.components import connected_components

#: Weight of a probe against a step of the merge, for the number of lists to skip.
PROBE = 0.5
#: Document numbers that the merge of short lists takes at a time.
WINDOW = 1 << 14
#: Bytes of text that a task hashes at a time.
SLICE = 4 << 20
#: Longest list of documents whose pairs are formed and counted; beyond, a list is chained.
PAIRED = 32
#: Pairs that a task holds before it counts them.
HELD = 1 << 21
#: Most bits of an array of hashed keys, and those that a task puts together at a time.
BITS, CHUNK = 1 << 29, 1 << 20


def required(n, percent: int):
    """Smallest overlap of a set of ``n`` with any set it links with."""
    return (percent * n + 99) // 100


def overlap_needed(n: int, m: int, percent: int) -> int:
    """Smallest overlap of linked sets of ``n`` and ``m`` shingles."""
    return -(-percent * (n + m) // (100 + percent))


def _batches_of(sets: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    arrays = list(sets)
    sizes = np.array([len(x) for x in arrays], np.int64)
    return (np.concatenate(arrays) if len(arrays) else np.empty(0, np.uint64)), sizes


def _sliced(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of about ``SLICE`` bytes of text (a longer text alone), so that a task's arrays do not follow its batches."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // SLICE
        edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(sizes)]
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a)


def _dealt(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each shingle by its upper half, and what is kept of it there."""
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32), values.astype(np.uint32)


def _order_key(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bucket and 24 bits more, by which shingles are counted and known to be frequent."""
    return bucket.astype(np.uint64) << np.uint64(24) | (low >> np.uint32(8)).astype(np.uint64)


def _steps(values: np.ndarray) -> bytes:
    """Sorted numbers as their differences, in 2 bytes each where that is enough."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    wide = len(steps) and int(steps.max()) > 0xFFFF
    return (b"4" if wide else b"2") + steps.astype(np.uint32 if wide else np.uint16).tobytes()


def _unstepped(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint32 if raw[:1] == b"4" else np.uint16, offset=1), dtype=np.uint64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


class HashedKeys:
    """A set of 64-bit keys as an array of bits: holds every key put in, and by chance some others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # 8 to a byte, a power of two of them

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys, len(self.bits) * 8)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)).astype(bool)

    @staticmethod
    def place(keys: np.ndarray, size: int) -> np.ndarray:
        return (mix64(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)

    @staticmethod
    def size_for(n: int) -> int:
        return min(BITS, max(CHUNK, 1 << (8 * n).bit_length()))

    @classmethod
    def of(cls, keys: DataFrame, size: int) -> HashedKeys:
        """The one column of ``keys``; each chunk of bits is put together by a task, so the driver gets ``size`` bits however many keys there are."""
        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(cls.place(batch.column(0).to_numpy(zero_copy_only=False), size))
                yield pa.RecordBatch.from_arrays([pa.array(at // CHUNK), pa.array((at % CHUNK).astype(np.int32))], ["chunk", "at"])

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunks: dict[int, np.ndarray] = {}
            for batch in batches:
                chunk, at = (c.to_numpy() for c in batch.columns)
                for k in np.unique(chunk).tolist():
                    chunks.setdefault(k, np.zeros(CHUNK, bool))[at[chunk == k]] = True
            for k, bits in chunks.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["chunk", "bits"])

        bits = np.zeros(size // 8, np.uint8)
        rows = keys.mapInArrow(placed, "chunk long, at int").repartition("chunk").mapInArrow(put, "chunk long, bits binary")
        for k, part in zip(*(c.to_pylist() for c in rows.toArrow().columns)):
            bits[k * (CHUNK // 8):][:CHUNK // 8] = np.frombuffer(part, np.uint8)
        return cls(bits)


def held_by(ids: DataFrame, column: str):
    """A function that says of a column of ids whether it is one of ``column`` (or, by chance, another): what a join would drop need not be shuffled for it."""
    known = ids.sparkSession.sparkContext.broadcast(HashedKeys.of(ids.select(column), HashedKeys.size_for(2 * ids.count())))

    @F.pandas_udf("boolean")
    def held(values: pd.Series) -> pd.Series:
        return pd.Series(known.value(values.to_numpy()))

    return held


def describe(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles`` and a 128-bit digest of each document's set."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            rows = []
            for values in shingle_sets(batch.column(1).to_pylist(), width):
                one, two = mix64(values).sum(dtype=np.uint64), mix64(~values).sum(dtype=np.uint64)
                rows.append((len(values), int(one.astype(np.int64)), int(two.astype(np.int64))))
            n, one, two = (pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, one, two], ["doc_id", "n_shingles", "set_a", "set_b"])

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_shingles long, set_a long, set_b long")


def frequent_shingles(docs: DataFrame, width: int, buckets: int, more_than: int, most: int) -> tuple[np.ndarray, HashedKeys | None]:
    """Keys of the most frequent shingles (at most ``most``) of more than ``more_than`` documents, rarest first.

    If there are more of them than ``most``, also those below as hashed keys: as many of
    the most frequent ones as leave their array of ``BITS`` sparse.
    Tasks send each bucket's distinct values as packed arrays, so a shingle
    arrives at its owner once per batch however frequent it is.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            values, _ = _batches_of(shingle_sets(batch.column(0).to_pylist(), width))
            keys = np.sort(_order_key(*_dealt(values, buckets)))
            first = _runs(keys)
            times = np.diff(np.append(first, len(keys)))
            keys = keys[first]
            edges = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(24))
            low = keys & np.uint64(0xFFFFFF)
            rows = [(b, _steps(low[x:y][times[x:y] == 1]), _steps(low[x:y][times[x:y] > 1]), times[x:y][times[x:y] > 1].astype(np.uint32).tobytes())
                    for b, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                             ["bucket", "once", "more", "times"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = defaultdict(list), defaultdict(list)
        for batch in batches:
            for b, single, values, times in zip(*(c.to_pylist() for c in batch.columns)):
                once[b].append(_unstepped(single).astype(np.uint32))
                more[b].append((_unstepped(values).astype(np.uint32), np.frombuffer(times, np.uint32)))
        for b in once:
            values = np.concatenate([*once[b], *(v for v, _ in more[b])])
            times = np.concatenate([np.ones(sum(map(len, once[b])), np.uint32), *(t for _, t in more[b])])
            order = np.argsort(values, kind="stable")
            values, times = values[order], times[order]
            first = _runs(values)
            total = np.add.reduceat(times.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
            many = total > more_than
            yield pa.RecordBatch.from_arrays([pa.array(b << 24 | values[first][many].astype(np.int64)), pa.array(total[many])], ["key", "documents"])

    packed = docs.select("text").mapInArrow(count, "bucket int, once binary, more binary, times binary")
    counted = cut_lineage(packed.repartition(buckets, "bucket").mapInArrow(own, "key long, documents long"))
    # The least frequency at which no more than ``most`` are left, from how many shingles have each power of 1.1.
    step = F.floor(F.log(1.1, "documents"))
    kept, least, hashed, hashed_least = 0, None, 0, None
    steps = counted.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    for r in sorted(steps, key=lambda r: -r["step"]):
        if hashed_least is None and kept + r["n"] <= most:
            kept, least = kept + r["n"], r["step"]
        elif hashed + r["n"] <= BITS // 8 or hashed_least is None:
            hashed, hashed_least = hashed + r["n"], r["step"]
        else:
            break
    exact = F.lit(False) if least is None else step >= least
    rest = None if hashed_least is None else HashedKeys.of(counted.where((step >= hashed_least) & ~exact).select("key"), HashedKeys.size_for(hashed))
    if least is None:
        return np.empty(0, np.uint64), rest
    top = counted.where(exact).toArrow()
    keys, documents = (top.column(c).to_numpy() for c in ("key", "documents"))
    return keys[np.lexsort((keys, documents))].astype(np.uint64), rest


class ShingleOrder:
    """Place of a shingle in the common order: by hash, then hashed ones by hash, then the frequent ones, rarest first (those of one key by hash)."""

    def __init__(self, frequent: np.ndarray, hashed: HashedKeys | None):
        self.hashed = hashed
        by_key = np.argsort(frequent)
        self.keys, self.places = frequent[by_key], by_key.astype(np.uint64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(frequent)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64((1 << 22) - 1)).astype(np.int64)

    def __call__(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = mix64(values) >> np.uint64(2)
        if self.hashed is not None:
            out += self.hashed(keys).astype(np.uint64) << np.uint64(62)
        some = np.flatnonzero(self.maybe[self._slot(keys)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            hit = self.keys[at] == keys[some]
            out[some[hit]] = np.uint64(1 << 63) + (self.places[at[hit]] << np.uint64(8)) + (values[some[hit]] & np.uint64(0xFF))
        return out


def _size_class(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of one class are within the ratio that a link allows."""
    return np.floor(np.log(np.maximum(sizes, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def _in_common(n, percent: int):
    """How many leading shingles linked sets of at least ``n`` have in common at least, of ``_leading(n)`` each."""
    return n // 16 + 1


def _leading(n, percent: int):
    """Length of the prefix that shows so many common shingles: an overlap of ``o`` leaves at least ``l`` of them in the first ``n - o + l``."""
    return np.where(n > 0, np.minimum(n, n - required(n, percent) + _in_common(n, percent)), 0)


def candidate_edges(docs: DataFrame, frequent: np.ndarray, hashed: HashedKeys | None, width: int, percent: int, buckets: int, short: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair of documents that link.

    Linked sets have ``_in_common`` leading shingles in common.  The owner of a
    shingle forms the pairs of a list of at most ``short`` documents and counts
    them; longer lists are chained by size instead, without pairs.  So a linked
    pair either meets in a long list, or its pairs add up to the number needed.
    Chance puts unlike documents on a list, so chains of lists that are not long
    would hang most of a large corpus together.
    Before, tasks join those of their own batch that share a frequent shingle
    and a size class: one member goes on for them, with the smallest and the
    largest size.  Chains have ``common`` null.
    """
    known = docs.sparkSession.sparkContext.broadcast(ShingleOrder(frequent, hashed))
    entry = "bucket int, low binary, ids binary, sizes binary, long binary, a long, b long"

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = known.value
        for batch in _sliced(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, sizes = _batches_of(shingle_sets(batch.column(1).to_pylist(), width))
            bucket, low = _dealt(values, buckets)
            keys = bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
            places, ends = order(_order_key(bucket, low), values), np.cumsum(sizes)
            count = _leading(sizes, percent)
            lead = np.concatenate([a + np.argpartition(places[a:b], n - 1)[:n] for a, b, n in zip(ends - sizes, ends, count) if n] or [np.empty(0, np.int64)])
            owner = np.repeat(np.arange(len(sizes)), count)
            often = places[lead] >> np.uint64(63) > 0
            rare_keys, rare = keys[lead[~often]], owner[~often]
            keys, owner = keys[lead[often]], owner[often]
            kind = _size_class(sizes, percent)[owner]
            sort = np.lexsort((ids[owner], kind, keys))
            keys, owner, kind = keys[sort], owner[sort], kind[sort]
            first = _runs(keys, kind)
            length = np.diff(np.append(first, len(keys)))
            leader = ids[owner[first]]
            pairs = _forest(ids[owner], np.repeat(leader, length))
            small = np.minimum.reduceat(sizes[owner], first) if len(first) else np.empty(0, np.int64)
            big = np.maximum.reduceat(sizes[owner], first) if len(first) else np.empty(0, np.int64)
            wide = big > small
            out_keys = np.concatenate([rare_keys, keys[first], keys[first][wide]])
            out_ids, out_sizes = np.concatenate([ids[rare], leader, leader[wide]]), np.concatenate([sizes[rare], small, big[wide]])
            merged = np.concatenate([np.zeros(len(rare), bool), length > 1, np.ones(int(wide.sum()), bool)])
            sort = np.argsort(out_keys, kind="stable")
            out_keys, out_ids, out_sizes, merged = out_keys[sort], out_ids[sort], out_sizes[sort].astype(np.int32), merged[sort]
            edges = np.searchsorted(out_keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            packed = [(b, out_keys[x:y].astype(np.uint32).tobytes(), out_ids[x:y].tobytes(), out_sizes[x:y].tobytes(), np.packbits(merged[x:y]).tobytes(), None, None)
                      for b, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
            packed += [(k % buckets, None, None, None, None, a, b) for k, (a, b) in enumerate(pairs.tolist())]
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packed) if packed else [()] * 7, types)],
                                             ["bucket", "low", "ids", "sizes", "long", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, chained, met = defaultdict(list), [], []
        names = ["a", "b", "smaller", "common"]

        def counted() -> Iterator[pa.RecordBatch]:
            a, b, smaller = np.concatenate(met, axis=1)
            met.clear()
            sort = np.lexsort((b, a))
            a, b, smaller = a[sort], b[sort], smaller[sort]
            first = _runs(a, b)
            columns = a[first], b[first], np.minimum.reduceat(smaller, first), np.diff(np.append(first, len(a)))
            for x in range(0, len(first), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[x:x + (1 << 16)]) for c in columns], names)

        for batch in batches:
            direct = batch.filter(batch.column("a").is_valid())
            if direct.num_rows:
                chained.append(np.stack([direct.column(c).to_numpy() for c in ("a", "b")], 1))
            rest = batch.filter(batch.column("low").is_valid())
            for b, low, ids, sizes, merged in zip(*(rest.column(c).to_pylist() for c in ("bucket", "low", "ids", "sizes", "long"))):
                low = np.frombuffer(low, np.uint32)
                parts[b].append((low, np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int32), np.unpackbits(np.frombuffer(merged, np.uint8), count=len(low)).astype(bool)))
        for b in list(parts):
            low, ids, sizes, merged = (np.concatenate(x) for x in zip(*parts.pop(b)))
            sort = np.lexsort((ids, sizes, low))
            low, ids, sizes, merged = low[sort], ids[sort], sizes[sort].astype(np.int64), merged[sort]
            first = _runs(low)
            length = np.diff(np.append(first, len(low)))
            # A member that stands for others makes its list a long one.
            chain = (length > short) | np.logical_or.reduceat(merged, first) if len(first) else np.empty(0, bool)
            for n in np.unique(length[~chain & (length > 1)]).tolist():
                own = first[(length == n) & ~chain]
                i, j = np.triu_indices(n, 1)
                some = max(1, HELD // len(i))
                for x in range(0, len(own), some):
                    left, right = ((own[x:x + some, None] + k).ravel() for k in (i, j))
                    near = (100 * sizes[left] >= percent * sizes[right]) & (ids[left] != ids[right])
                    left, right = left[near], right[near]
                    if len(left):
                        met.append(np.stack([np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right]), sizes[left]]))
                    if sum(m.shape[1] for m in met) > HELD:
                        yield from counted()
            inside = np.repeat(chain, length)
            low, ids, sizes = low[inside], ids[inside], sizes[inside]
            if len(low):
                starts = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])])
                chained.append(_forest(ids, np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(ids))))))
        pairs = _forest(*np.concatenate(chained).T) if chained else np.empty((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int64())], names)
        if met:
            yield from counted()

    packed = docs.select("doc_id", "text").mapInArrow(leading, entry)
    met = packed.repartition(buckets, "bucket").mapInArrow(meet, "a long, b long, smaller long, common long")
    counted = met.groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("smaller").alias("smaller"), F.count_if(F.col("common").isNull()).alias("chains"))
    return counted.where((F.col("chains") > 0) | (F.col("common") >= F.floor(F.col("smaller") / 16) + 1)).select("a", "b")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node of the edges (a, b) with the smallest of its component, where that is another."""
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for x, y in pairs.tolist():
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([(x, find(x)) for x in parent], np.int64).reshape(-1, 2)


class Linker:
    """Components of the documents of one block, with a label per document."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = [[k] for k in range(n)]

    def union(self, x: int, y: int) -> None:
        x, y = self.label[x], self.label[y]
        if x == y:
            return
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.label[self.members[y]] = x  # the smaller one is renamed
        self.members[x] += self.members[y]
        self.members[y] = []


def search_block(sets: list[np.ndarray], percent: int, together: list[int] = ()) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``sets``, as pairs of indices.

    ``together`` are known to be one component and are not compared with each
    other.  Documents query the inverted lists for those before them; documents
    already joined with the query are passed over.
    """
    known = set(together)
    order = sorted(range(len(sets)), key=lambda k: k not in known)
    values, sizes = _batches_of(iter([sets[k] for k in order]))
    _, token, times = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = times[token] > 1
    token, owner = token[shared], owner[shared]
    ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
    by_token = np.argsort(token, kind="stable")
    holders = owner[by_token]  # each token's list, ascending
    starts = np.searchsorted(token[by_token], np.arange(len(times) + 1))
    place = np.empty(len(token), np.int64)
    place[by_token] = np.arange(len(token))  # where a document stands on its token's list
    joined = Linker(len(sets))
    links: list[tuple[int, int]] = []
    for k in range(1, len(known)):
        joined.union(k - 1, k)
    for q in range(len(known), len(sizes)):
        mine = slice(ends[q], ends[q + 1])
        first, last = starts[token[mine]], place[mine]  # the part of a list before q
        some = last > first
        need = int(required(sizes[q], percent))
        if int(some.sum()) < max(need, 1):
            continue
        lists = [holders[a:b] for a, b in zip(first[some], last[some])]
        for d in _divide_skip(lists, need, q, sizes, percent, joined.label):
            if joined.label[d] != joined.label[q]:
                joined.union(q, d)
                links.append((order[q], order[d]))
    return links


def _divide_skip(lists: list[np.ndarray], need: int, q: int, sizes: np.ndarray, percent: int, label: np.ndarray) -> list[int]:
    """Documents of other components that occur on enough of the sorted ``lists`` to link with ``q``.

    A heap holds the heads of the short lists and yields them window by window
    of document numbers; what occurs often enough there is probed in the long lists.
    """
    lists.sort(key=len)
    longest = len(lists[-1])
    skip = min(need - 1, int(need / (PROBE * log2(max(longest, 2)) + 1)))
    short, long = lists[:len(lists) - skip], lists[len(lists) - skip:]
    heap = [(int(x[0]), k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    found: list[int] = []
    while heap:
        window = heap[0][0]
        parts = []
        while heap and heap[0][0] < window + WINDOW:
            _, k, at = heapq.heappop(heap)
            to = at + int(np.searchsorted(short[k][at:], window + WINDOW))
            parts.append(short[k][at:to])
            if to < len(short[k]):
                heapq.heappush(heap, (int(short[k][to]), k, to))
        counts = np.bincount(np.concatenate(parts) - window)
        d = np.flatnonzero(counts >= max(1, need - skip))
        n = counts[d]
        d = d + window
        # A link of sizes x and y needs an overlap of percent * (x + y) / (100 + percent).
        enough = np.maximum(need, -(-percent * (sizes[q] + sizes[d]) // (100 + percent)))
        open_ = (label[d] != label[q]) & (n + skip >= enough)
        d, n, enough = d[open_], n[open_], enough[open_]
        for k, members in enumerate(long):
            at = np.minimum(np.searchsorted(members, d), len(members) - 1)
            n = n + (members[at] == d)
            if k % 8 == 7:
                left = n + (len(long) - k - 1) >= enough
                d, n, enough = d[left], n[left], enough[left]
            if not len(d):
                break
        found += d[n >= enough].tolist()
    return found


def _search_group(width: int, percent: int):
    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        ids = rows.column("doc_id").to_pylist()
        sets = list(shingle_sets(rows.column("text").to_pylist(), width))
        together = [k for k, x in enumerate(rows.column("hangs").to_pylist()) if x]
        links = np.array([(ids[q], ids[d]) for q, d in search_block(sets, percent, together)], np.int64).reshape(-1, 2)
        a, b = _forest(links[:, 0], links[:, 1]).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return search


def verified_links(members: DataFrame, texts: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) that span the groups of each cluster; ``members``: cluster, doc_id, n_shingles; ``texts``: doc_id, text.

    A cluster of at most ``block`` shingles is one block.  A larger one is split:
    those that link with its pivot (their links are returned) hang together, and
    only the others meet all blocks: ``others x all`` comparisons of blocks.
    """
    sizes = cut_lineage(members.groupBy("cluster").agg(F.sum("n_shingles").alias("total"), F.min(F.struct(F.xxhash64("doc_id"), "doc_id"))["doc_id"].alias("pivot")))
    # Members have no bound, so texts meet them in a merge join at every size; texts of others are not shuffled for it.
    placed = cut_lineage(texts.where(held_by(members, "doc_id")("doc_id")).join(members.join(sizes, "cluster").hint("merge"), "doc_id"))
    small = placed.where(F.col("total") <= block).select("cluster", "doc_id", "text", F.lit(0).alias("task"), F.lit(False).alias("hangs"))
    output = "a long, b long"
    links = small.groupBy("cluster", "task").applyInArrow(_search_group(width, percent), output)
    if sizes.where(F.col("total") > block).isEmpty():
        return links

    large = placed.where(F.col("total") > block)
    pivots = large.where(F.col("doc_id") == F.col("pivot")).select("cluster", F.col("text").alias("pivot_text"))

    @F.pandas_udf("boolean")
    def hangs(texts: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        kept: dict[str, np.ndarray] = {}
        for mine, other in zip(shingle_sets(texts.tolist(), width), others):
            if other not in kept:
                kept = {other: next(shingle_sets([other], width))}
            both = len(np.intersect1d(mine, kept[other], assume_unique=True))
            out.append(100 * both >= percent * (len(mine) + len(kept[other]) - both))
        return pd.Series(out, dtype=bool)

    tested = cut_lineage(large.join(pivots, "cluster").withColumn("hangs", hangs("text", "pivot_text")).drop("pivot_text"))
    parts = tested.groupBy("cluster").agg(*[F.ceil(F.sum(F.when(F.col("hangs") == x, F.col("n_shingles")).otherwise(0)) / block).cast("int").alias(n) for n, x in (("tied", True), ("loose", False))])
    part = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.greatest(F.when(F.col("hangs"), F.col("tied")).otherwise(F.col("loose")), F.lit(1))).cast("int")
    dealt = tested.join(parts, "cluster").withColumn("part", part)
    # Task numbers: loose parts x <= y meet in x * (loose + tied) + y, loose part x and tied part y in x * (loose + tied) + loose + y.
    span = F.col("loose") + F.col("tied")
    all_loose = F.sequence(F.lit(0), F.col("loose") - 1)
    tasks = F.when(F.col("loose") == 0, F.array().cast("array<int>")).when(
        F.col("hangs"), F.transform(all_loose, lambda x: x * span + F.col("loose") + F.col("part"))).otherwise(
        F.concat(F.transform(all_loose, lambda x: F.least(x, F.col("part")) * span + F.greatest(x, F.col("part"))),
                 F.when(F.col("tied") > 0, F.transform(F.sequence(F.lit(0), F.col("tied") - 1), lambda y: F.col("part") * span + F.col("loose") + y)).otherwise(F.array().cast("array<int>"))))
    blocks = dealt.select("cluster", "doc_id", "text", "hangs", F.explode(tasks).alias("task"))
    others = blocks.groupBy("cluster", "task").applyInArrow(_search_group(width, percent), output)
    tied = tested.where("hangs").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    return links.union(others).union(tied)


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 75, more_than: int = 3, most: int = 2_000_000, block: int = 2_000_000) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_shingles, component_id``.

    The component is the smallest doc_id reachable over links, the row's own
    included.  Null texts and texts without words have no shingles and link with
    nothing, not even each other; a text of fewer words than ``width`` is one
    shingle.  Rows that repeat a doc_id are versions of one document; rows with
    a null id are looked at as members of their class only.  Equal 64-bit hashes count as equal shingles.
    ``most`` bounds what is broadcast (8 bytes each), ``block`` the shingles of one task's search.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = cut_lineage(describe(docs, width))
    identity = ["set_a", "set_b", "n_shingles"]
    classes = cut_lineage(described.where("n_shingles > 0").groupBy(*identity).agg(F.min("doc_id").alias("stands"), F.count("*").alias("copies")))
    named = docs.where(F.col("doc_id").isNotNull())
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A copy shares every list with the one that stands for it.
    standing_for = named.where(held_by(classes.where(F.col("stands").isNotNull()), "stands")("doc_id"))
    frequent, hashed = frequent_shingles(standing_for, width, buckets, more_than, most)
    near = candidate_edges(standing_for, frequent, hashed, width, percent, buckets, max(more_than, PAIRED))
    found = cut_lineage(described.join(classes, identity, "left").drop("set_a", "set_b"))
    copies = found.where("copies > 1 AND doc_id != stands").select(F.col("doc_id").alias("a"), F.col("stands").alias("b"))
    clusters = cut_lineage(connected_components(near.union(copies)))
    standing = classes.where(F.col("stands").isNotNull()).join(clusters, F.col("stands") == F.col("node")).select(
        F.col("component").alias("cluster"), "stands", *identity)
    several = standing.groupBy("cluster").agg(F.count("*").alias("sets")).where("sets > 1").select("cluster")
    active = cut_lineage(standing.join(several, "cluster", "left_semi").select("cluster", F.col("stands").alias("doc_id"), *identity))
    # A doc_id that repeats comes with all its texts.
    members = active.groupBy("cluster", "doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    links = cut_lineage(verified_links(members, named, width, percent, block))
    groups = connected_components(links)
    out = found.join(groups, F.col("stands") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "stands", "doc_id").alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents"))


#: All pairs of sets that share a shingle, and a closure over the links: for small tables.
OP10_SQL = r"""WITH RECURSIVE split_ AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split_),
classes AS MATERIALIZED (SELECT list_sort(s) AS s, min(doc_id) AS doc_id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY 1, 3),
shingles AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS x FROM classes),
links AS MATERIALIZED (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_, any_value(a.n) + any_value(b.n) AS n FROM shingles a JOIN shingles b
  ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2) WHERE 100 * both_ >= 75 * (n - both_)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
groups_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(g.component_id, t.doc_id) AS component_id FROM sets t LEFT JOIN classes c ON c.s = list_sort(t.s) LEFT JOIN groups_ g ON g.a = c.doc_id"""
