"""Best-fit packing planned on a histogram of lengths.

1. Texts become pieces of at most ``capacity`` tokens (only longer ones are cut); one slim row per piece.
2. Pieces are counted per length: at most ``capacity`` numbers, which the driver packs best-fit
   decreasing, a whole run of equal sequences at a time.  The plan says which ranks of a length go
   to which sequences; its size depends on the capacity, not on the corpus.
3. Pieces take a rank within their length (hot lengths are dealt over hash buckets) and look up their slot.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageloom.llm.common import Memo, cut_lineage, rank_within, read_table

_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_MARK = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])([.,])(?= |\Z)")


class ChunkTokenizer:
    """Ids of a text as little-endian bytes, by way of its chunks between blanks and line ends.

    For a lower-casing byte-level tokenizer that drops white space before it
    merges, so that chunks do not influence each other.  Texts of Latin letters
    (already in normal form) are lower-cased as a whole, and a full stop or
    comma between a letter and a blank becomes a chunk of its own, as the
    tokenizer's splitter has it; that makes most chunks frequent words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Byte-level models spell each byte as a visible character.
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.spelt = {b: b if b in visible else next(rest) for b in range(256)}
        self.chunks = Memo(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.islower() and chunk.isalpha() and not _BEYOND_LATIN.search(chunk):
            # Letters only: past normaliser and splitter, straight to the merges.
            spelt = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.spelt)
            return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        text = text.replace("\n", " ")
        if "<|" not in text and not _BEYOND_LATIN.search(text):
            text = _MARK.sub(r" \1", text.lower())
        return b"".join(map(self.chunks.__getitem__, text.split(" ")))


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece of each document of ``docs`` (``doc_id``, ``text``).

    A document is its ids, then ``end_id``; null and empty texts are that one id.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = own.ids(text) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 5, schema.types)], schema=schema)
        finally:
            own.chunks.clear()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over counts: rows ``(length, first rank, first sequence, offset)``.

    The pieces of ``length`` from ``first rank`` up to the next row's take
    consecutive sequences from ``first sequence`` on, each at ``offset``.  A
    piece goes to the open sequence with the least room that still holds it; of
    equal sequences (a range of numbers with the same room) as many as needed
    are filled at once.  Lengths must lie between 1 and ``capacity``.
    """
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> ranges of sequences
    rooms: list[int] = []
    out: list[tuple[int, int, int, int]] = []
    new = 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(room: int, first: int, n: int, each: int) -> None:
            """``each`` pieces one after the other into each of ``n`` sequences."""
            nonlocal left, rank
            for k in range(each):
                out.append((length, rank, first, capacity - room + k * length))
                rank += n
            left -= n * each
            leave(room - each * length, first, n)

        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, first, n = capacity, new, -(-left // (capacity // length))
                new += n
            each = room // length
            full = min(n, left // each)
            if full:
                place(room, first, full, each)
            if full < n and left:
                place(room, first + full, 1, min(left, each))
                full += 1
            leave(room, first + full, n - full)
    return out


def pack(pieces: DataFrame, capacity: int, seed: int = 0, bucket_rows: int = 50_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id``, ``piece``, ``length``).

    ``pieces`` is read twice, so give a written table.  Pieces of equal length
    are interchangeable: their ranks follow a hash of (doc_id, piece).  Sequences
    are gapless from offset 0.  An empty table gives no rows.
    """
    counts = pieces.groupBy("length").agg(F.count("*").alias("n"))
    planned = sorted(plan({r["length"]: r["n"] for r in counts.collect()}, capacity))  # at most one row per length
    table = np.array(planned, np.int64).reshape(-1, 4)
    known = pieces.sparkSession.sparkContext.broadcast(table)  # its size depends on the capacity alone
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = known.value
        lengths = slots[:, 0]
        for rows in batches:
            length, rank = rows["length"].to_numpy(), rows["rank"].to_numpy()
            at = np.zeros(len(rows), np.int64)
            for one in np.unique(length):
                a, b = np.searchsorted(lengths, [one, one + 1])
                own = length == one
                at[own] = a + np.searchsorted(slots[a:b, 1], rank[own], side="right") - 1
            rows["sequence_id"] = slots[at, 2] + rank - slots[at, 1]
            rows["offset"] = slots[at, 3]
            yield rows[schema.names]

    ranked = rank_within(pieces, ["length"], ["doc_id", "piece"], counts, seed, bucket_rows).drop("n")
    return ranked.select(*pieces.columns, "rank").mapInPandas(seat, schema)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


def packed_documents(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    return pack(cut_lineage(token_pieces(docs, path, capacity)), capacity)
