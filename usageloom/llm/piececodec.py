"""SentencePiece encoding and decoding with a score-ordered agenda of adjacent symbol pairs.

For merge-type vocabularies with byte fallback, no normalisation and a dummy
prefix.  Every Arrow batch is encoded and decoded here and then checked against
the sentencepiece library; a difference is an error, not a result.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageloom.llm.common import Memo, read_table, segment_pattern

SPACE = "▁"
#: Bytes of text that are encoded, decoded and checked at a time (a longer text alone).
SLICE = 1 << 19
#: Symbols up to which a plain list is the faster agenda.
SHORT = 32
_NEVER = 1 << 62
_TIED = -1
_BITS = 24
_MASK = (1 << _BITS) - 1


class PieceCodec:
    """Ids of a text and text of ids, for one model file."""

    def __init__(self, path: str):
        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        if any(model.is_unused(k) for k in every):
            raise ValueError("unused pieces are not supported")
        plain = [k for k in every if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        self.id = {model.id_to_piece(k): k for k in plain}
        order = {score: k for k, score in enumerate(sorted({model.get_score(k) for k in plain}, reverse=True))}
        self.place = {model.id_to_piece(k): order[model.get_score(k)] for k in plain}
        # For short segments: symbols as ids, pairs as numbers.  Of pieces that share a score the leftmost goes first, which the heap sees to.
        self.char = {c: k for c, k in self.id.items() if len(c) == 1}
        longer = [p for p in self.id if len(p) > 1]
        often = Counter(self.place[p] for p in longer)
        splits = ((p, p[:k], p[k:]) for p in longer for k in range(1, len(p)))
        self.merged = {self.id[a] << _BITS | self.id[b]: self.place[p] << _BITS | self.id[p] if often[self.place[p]] == 1 else _TIED
                       for p, a, b in splits if a in self.id and b in self.id}
        self.byte = {int(model.id_to_piece(k)[3:5], 16): k for k in every if model.is_byte(k)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.segments = segment_pattern(self.id, SPACE)
        self.memo = Memo(self._segment)
        self.raw = {k: v for v, k in self.byte.items()}
        unknown = [k for k in every if model.is_unknown(k)]
        self.surface = {k: piece.replace(SPACE, " ").encode() for piece, k in self.id.items()} | {
            k: bytes([v]) for k, v in self.raw.items()} | {k: model.decode([k]).encode() for k in unknown} | {
            k: b"" for k in every if model.is_control(k)}

    def _segment(self, segment: str) -> bytes:
        """Ids of one segment: the agenda yields the adjacent pair of the best score, of equal ones the leftmost."""
        if len(segment) <= SHORT:
            try:
                return array("i", self._by_list([self.char[c] for c in segment])).tobytes()
            except KeyError:  # a character that needs its bytes, or scores that tie
                pass
        ids = array("i")
        for s in self._by_heap(segment):
            if s in self.id:
                ids.append(self.id[s])
            else:
                ids.extend(self.byte[b] for b in s.encode("utf-8", "surrogatepass"))
        return ids.tobytes()

    def _by_list(self, symbol: list[int]) -> list[int]:
        """The agenda of a short segment is the list of its pairs in the order of the text: score place and merged id as one number."""
        merged = self.merged.get
        agenda = [merged(a << _BITS | b, _NEVER) for a, b in zip(symbol, symbol[1:])]
        while agenda and (best := min(agenda)) != _NEVER:
            if best == _TIED:
                raise KeyError("pieces of one score")
            k = agenda.index(best)
            symbol[k] = best & _MASK
            del symbol[k + 1], agenda[k]
            if k < len(agenda):
                agenda[k] = merged(symbol[k] << _BITS | symbol[k + 1], _NEVER)
            if k:
                agenda[k - 1] = merged(symbol[k - 1] << _BITS | symbol[k], _NEVER)
        return symbol

    def _by_heap(self, segment: str) -> list[str]:
        """The agenda of a long segment is a heap of (score place, left symbol) over a linked list of symbols."""
        place = self.place.get
        symbol: list[str | None] = list(segment)
        size = len(symbol)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda = [(own, k) for k in range(size - 1) if (own := place(segment[k:k + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            best, left = heapq.heappop(agenda)
            own, right = symbol[left], after[left]
            if own is None or right >= size or place(pair := own + symbol[right]) != best:
                continue  # one of the two has been merged meanwhile
            symbol[left], symbol[right] = pair, None
            after[left] = beyond = after[right]
            if beyond < size:
                before[beyond] = left
                if (own := place(pair + symbol[beyond])) is not None:
                    heapq.heappush(agenda, (own, left))
            if (ahead := before[left]) >= 0 and (own := place(symbol[ahead] + pair)) is not None:
                heapq.heappush(agenda, (own, ahead))
        return [s for s in symbol if s is not None]

    def encode(self, text: str | None) -> array:
        """Ids without begin or end; null and empty texts have none."""
        ids = array("i")
        if text:
            spaced = SPACE + text.replace(" ", SPACE)
            ids.frombytes(b"".join(map(self.memo.__getitem__, self.segments.findall(spaced))))
        return ids

    def decode(self, ids) -> str:
        """Text of any ids: control ids are silent, byte ids join to characters, the dummy prefix goes."""
        spelt = list(map(self.surface.__getitem__, ids))
        first = next((k for k, own in enumerate(spelt) if own), None)
        if first is not None and spelt[first][:1] == b" " and ids[first] not in self.raw and not self.library.is_unknown(ids[first]):
            spelt[first] = spelt[first][1:]  # the dummy prefix
        if all(spelt):
            runs = [b"".join(spelt)]
        else:  # bytes do not join over a silent id
            runs = [b"".join(own) for heard, own in groupby(spelt, key=bool) if heard]
        try:
            return "".join([run.decode() for run in runs])
        except UnicodeDecodeError:
            return "".join(map(self._mended, runs))

    @staticmethod
    def _mended(data: bytes) -> str:
        """Each byte that does not begin a whole character becomes a replacement character."""
        out, at = [], 0
        while at < len(data):
            width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            try:
                out.append(data[at:at + width].decode())
                at += width
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per worker and model, kept from task to task (its memo is emptied after each partition)."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > SLICE:
            yield start, k
            start, size = k, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (string) to every row of ``docs``; only ``text`` is looked at.

    Null and empty texts have no ids and decode to the empty text.  Other
    columns, nulls and repeated rows are carried along; columns of these two
    names are replaced.  Nothing is shuffled, and a worker holds one Arrow batch
    and a memo of bounded size.  Raises an error where the library gives others.
    """
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        try:
            for batch in batches:
                texts = [t or "" for t in batch.column(place).to_pylist()]
                for a, b in _slices(texts):
                    ids = [own.encode(t) for t in texts[a:b]]
                    decoded = [own.decode(x) for x in ids]
                    listed = [x.tolist() for x in ids]
                    if listed != own.library.encode(texts[a:b], num_threads=1):
                        raise ValueError("ids differ from those of the sentencepiece library")
                    if decoded != own.library.decode(listed, num_threads=1):
                        raise ValueError("decoded text differs from that of the sentencepiece library")
                    flat, ends = array("i"), array("i", [0])
                    for x in ids:
                        flat.extend(x)
                        ends.append(len(flat))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, lists, pa.array(decoded, pa.string())], [*kept, "ids", "decoded"])
        finally:
            own.memo.clear()

    return docs.select(kept).mapInArrow(run, schema)


def op11_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
