"""Token counts by byte-pair merging with a heap over a linked list of symbols."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm.common import Memo, read_table, segment_pattern, text_bytes

SPACE = "▁"


class MergeCounter:
    """Counts the tokens of a piece model without emitting identifiers.

    The text is cut where no merge can pass (``segment_pattern``).  Each segment starts as one
    symbol per character; a heap yields the adjacent pair of the lowest rank
    (highest score, then leftmost), and merging it relinks its neighbours.  The
    count is initial symbols minus merges; a character without a piece of its
    own that stays unmerged is spelled in bytes.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(model.get_piece_size())
                 if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.rank = {model.id_to_piece(k): -model.get_score(k) for k in plain}
        self.segments = segment_pattern(self.rank, SPACE)
        self.memo = Memo(self.merge)

    def merge(self, segment: str) -> int:
        rank = self.rank
        count = len(segment)
        symbol: list[str | None] = list(segment)
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        heap = [(rank[pair], k, pair) for k in range(count - 1) if (pair := segment[k:k + 2]) in rank]
        heapq.heapify(heap)
        size = count
        while heap:
            _, left, pair = heapq.heappop(heap)
            if symbol[left] is None or (right := after[left]) >= size or symbol[left] + symbol[right] != pair:
                continue  # one of the two has been merged meanwhile
            symbol[left], symbol[right] = pair, None
            count -= 1
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
                longer = pair + symbol[after[left]]
                if longer in rank:
                    heapq.heappush(heap, (rank[longer], left, longer))
            if before[left] >= 0:
                longer = symbol[before[left]] + pair
                if longer in rank:
                    heapq.heappush(heap, (rank[longer], before[left], longer))
        return count + sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in symbol if s is not None and s not in rank)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        spaced = SPACE + text.replace(" ", SPACE)
        if len(spaced) < 1 << 20:
            return sum(map(self.memo.__getitem__, self.segments.findall(spaced)))
        return sum(self.memo[m[0]] for m in self.segments.finditer(spaced))


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter per worker and model, kept from task to task (its memo is emptied after each partition)."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """Add ``n_tokens`` to every row of ``docs``; only ``text`` is looked at.

    Null and empty texts have no tokens.  Nothing is shuffled; a worker's memory
    holds one batch and a bounded memo of segments.
    """
    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(model_path)
        try:
            for texts in batches:
                yield pd.Series([own.count(t) for t in texts.tolist()], dtype="int64")
        finally:
            own.memo.clear()

    return docs.select(*[docs[c] for c in docs.columns if c != "n_tokens"], counted(docs["text"]).alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", text_bytes(F.col("text")).alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
