"""Token counts and packing against the tokenizers themselves and a packer of single pieces."""

import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, clashing, empty  # noqa: E402

from usageloom.llm.packing import pack, packed_documents, plan, tokenizer  # noqa: E402
from usageloom.llm.tokencount import count_tokens, counter  # noqa: E402

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a  b", "  a b ", "\ta\nb\r\n", "<s> hi</s>", "<unk>", "<0x41>", "a▁b", "é é", "\x00a", "日本語 ☃ 𝒳", "ﬁ x", "     x    y\n\n   z",
       "b'S x's it's ", "ΑΣ. ΑΣ, İx.", "\x1c a!\x1c! \x85b c", "<|endoftext|> x <|startoftext|>y", "e ́x", "ǅ. ſ, ẞ. K. ª, ²."]


@pytest.fixture(scope="module")
def pieces_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_equal_the_model(pieces_model):
    count = counter(PIECES).count
    assert [count(t) for t in ODD] == [len(pieces_model.encode(t)) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text(" \nabcdeth.▁é", max_size=60))
def test_counts_of_any_text(text):
    import sentencepiece

    model = test_counts_of_any_text.__dict__.setdefault("model", sentencepiece.SentencePieceProcessor(model_file=PIECES))
    assert counter(PIECES).count(text) == len(model.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text(" \nabcde'sTH.,1é", max_size=60))
def test_ids_of_any_text(text):
    own = tokenizer(WORDS)
    assert own.ids(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_count_tokens_of_awkward_rows(spark, pieces_model):
    rows = count_tokens(clashing(awkward(spark)), PIECES).collect()
    assert len(rows) == 14 and "n_tokens" in rows[0].__fields__
    for r in rows:
        assert r["n_tokens"] == len(pieces_model.encode(r["text"] or ""))
    assert count_tokens(empty(spark), PIECES).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_plan_packs_as_single_pieces_would(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 16, 50, 2048])
    counts = {rnd.randint(1, capacity): rnd.randint(1, 60) for _ in range(rnd.randint(1, 20))}
    rows = sorted(plan(counts, capacity))
    taken = defaultdict(list)
    for k, (length, rank, first, offset) in enumerate(rows):
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts[length]
        for i in range(end - rank):
            taken[first + i].append((offset, length))
    for slots in taken.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(map(len, taken.values())) == sum(counts.values())
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [b for b in range(len(room)) if room[b] >= length]
            if fit:
                room[min(fit, key=room.__getitem__)] -= length
            else:
                room.append(capacity - length)
    assert len(room) == len(taken)


def test_packing_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = packed_documents(clashing(docs.drop("length", "piece")), WORDS, 64).collect()
    whole = defaultdict(list)
    for d in docs.collect():
        ids = tokenizer(WORDS).ids(d["text"]) + bytes(4)
        for piece, a in enumerate(range(0, len(ids), 256)):
            own = ids[a:a + 256]
            whole[d["doc_id"]].append((piece, a // 4, len(own) // 4, zlib.crc32(own)))
    found = defaultdict(list)
    seats = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        seats[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in found.items()}
    for own in seats.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packed_documents(empty(spark), WORDS, 64).count() == 0


def test_ranks_of_a_hot_length_over_many_buckets(spark):
    from pyspark.sql import functions as F

    pieces = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 10 == 0, 3).otherwise(5).cast("long").alias("length"))
    rows = pack(pieces, 8, bucket_rows=50).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 2_000
    assert len({r["sequence_id"] for r in rows}) == 1_800
