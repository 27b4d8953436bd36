"""Piece codec against the library, Merkle manifest and prefix trie against plain Python."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from math import fmod
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import LONG, awkward, clashing, empty  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from usageloom.llm.merkle import Appender, digest_of, fold, manifest  # noqa: E402
from usageloom.llm.piececodec import codec, encode_decode  # noqa: E402
from usageloom.llm.prefixtrie import SlotTable, prefix_trie, rebuilt  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a  b", "  a b ", "\ta\nb\r\n", "<s> hi</s>", "<unk>", "<0x41>", "a▁b", "▁", "é é", "\x00a", "日本語 ☃ 𝒳", "ﬁ x", "     x    y\n\n   z", LONG]


def text_key(row):
    return tuple(map(str, row))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text(" \nabcdeth.▁é", max_size=60))
def test_codec_of_any_text(text):
    own = codec(MODEL)
    ids = own.encode(text).tolist()
    assert ids == own.library.encode(text) and own.decode(ids) == own.library.decode(ids)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 258) | st.sampled_from([28705, 259, 260, 195, 227, 131]), max_size=9))
def test_decoding_of_any_ids(ids):
    """Broken byte runs, control and unknown ids, leading spaces."""
    own = codec(MODEL)
    assert own.decode(ids) == own.library.decode(ids)


def test_encode_decode_of_awkward_rows(spark):
    own = codec(MODEL).library
    docs = clashing(awkward(spark)).withColumns({"ids": F.lit("clash"), "decoded": F.lit(1)})
    rows = encode_decode(docs, MODEL).collect()
    assert len(rows) == 14 and set(rows[0].__fields__) == set(docs.columns)
    for r in rows:
        ids = own.encode(r["text"] or "")
        assert r["ids"] == ids and r["decoded"] == own.decode(ids)
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in encode_decode(odd, MODEL).collect()} == {k: own.encode(t) for k, t in enumerate(ODD)}
    assert encode_decode(empty(spark), MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("▁abcdetho'sing. ,é", max_size=80))
def test_both_agendas_merge_alike(segment):
    own = codec(MODEL)
    try:
        got = own._by_list([own.char[c] for c in segment])
    except KeyError:  # scores that tie are left to the heap
        return
    assert got == [own.id[x] for x in own._by_heap(segment)]


def test_a_difference_from_the_library_shows():
    from usageloom.llm import piececodec

    own = piececodec.PieceCodec(MODEL)
    own.merged = {pair: k for pair, k in own.merged.items() if k & 0xFFFFFF != own.id["▁the"]}  # another vocabulary than the library's
    assert own.encode("the the").tolist() != own.library.encode("the the")


def merkle_rows(rows):
    """Level by level, as the definition has it."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        chars = None if r["n_chars"] is None else r["n_chars"] + more
        return digest_of(*map(field, (r["doc_id"], r["source"], r["lang"], chars, r["text"])))

    def tree(nodes):
        paths, members, now = [[] for _ in nodes], [[k] for k in range(len(nodes))], list(nodes)
        while len(now) > 1:
            above, owners = [], []
            for k in range(0, len(now), 2):
                run = now[k:k + 2]
                for j in range(len(run)):
                    for m in members[k + j]:
                        paths[m].append((j, run[:j] + run[j + 1:]))
                above.append(digest_of(*run))
                owners.append(sum(members[k:k + 2], []))
            now, members = above, owners
        return now[0], paths

    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(r, 1)))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {x: tree([t[2] for t in sorted(trees[x])]) for x in order}
    root, top = tree([made[x][0] for x in order])
    out = []
    for x, over in zip(order, top):
        for (named, doc_id, own, other), path in zip(sorted(trees[x]), made[x][1]):
            path = path + over
            tampered = named and zlib.crc32(str(doc_id).encode()) % 7 == 0
            node = other if tampered else own
            for j, siblings in path:
                node = digest_of(*([node] + siblings if j == 0 else siblings + [node]))
            out.append((doc_id if named else None, own, made[x][0], root, digest_of(*[s for _, own_run in path for s in own_run]), node, node == root))
    return sorted(out, key=text_key)


def merkle_query(docs, levels):
    made = manifest(docs, levels)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    node = fold(F.when(tampered, F.col("tampered_leaf")).otherwise(F.col("leaf")), F.col("siblings"))
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: s["digest"]), ""), 256)
    return sorted((tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", proof, node, node == F.col("root")).collect()), key=text_key)


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest_of_awkward_rows(spark, levels):
    plain = [r.asDict() for r in awkward(spark).collect()]
    assert merkle_query(clashing(awkward(spark)), levels) == merkle_rows(plain)
    assert manifest(empty(spark), levels).count() == 0
    one = awkward(spark).where("doc_id = 1")
    assert merkle_query(one, levels) == merkle_rows([r.asDict() for r in one.collect()])


def test_manifest_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = merkle_rows([r.asDict() for r in docs.collect()])
    assert merkle_query(docs, 3) == want == merkle_query(docs.repartition(7), 12)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 70), st.integers(0, 3))
def test_appender_witnesses_lead_to_the_root(n, more):
    appender = Appender()
    leaves = [digest_of(str(k)) for k in range(n)]
    for x in leaves:
        appender.append(x)
    root = appender.seal((n - 1).bit_length() + more)
    for node, witness in zip(leaves, appender.witness):
        for left, other in witness:
            node = digest_of(other or "", node) if left else digest_of(node, other or "")
        assert node == root


def trie_rows(rows):
    had = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            had[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in had.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(turns.get(c - int(fmod(c, 5)), [])[:h] + own[h:])
    members, below = defaultdict(list), defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[x] for x in below[node])
        ends = ",".join(str(c) for c in sorted(members[node]) if made[c] == node)
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=text_key)


TURNS = "conv_id long, turn long, role string, text string"


def trie_query(df, *sizes):
    return sorted((tuple(r) for r in prefix_trie(*rebuilt(df), *sizes).collect()), key=text_key)


@pytest.mark.parametrize("sizes", [(4096, 16_384), (3, 20), (1, 7)])
def test_trie_against_plain_python(spark, sizes):
    """Nulls everywhere, few different turns, long conversations over many blocks and shards."""
    pick = random.Random(3)
    rows = [(c, t, pick.choice("ua"), pick.choice(["x", "yy", "é", None])) for c in range(60) for t in range(pick.choice([0, 1, 2, 3, 9, 12, 30]))]
    rows += [(c, t, "u", "same") for c in range(100, 140) for t in range(7)]  # a group of copies
    rows += [(3, None, None, None), (None, 1, "u", "x"), (7, None, "u", ""), (-7, 1, "u", "x"), (-5, 1, "a", "x")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"shard": F.lit("clash"), "depth": F.lit("clash"), "x": F.lit(0)})
    assert trie_query(df, *sizes) == trie_rows(rows)


def test_trie_of_the_table_and_of_nothing(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert trie_query(df) == trie_rows([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert trie_query(spark.createDataFrame([], TURNS)) == []
    turnless = trie_query(spark.createDataFrame([(6, 0, "u", "x")], TURNS))  # its base is absent and its own turn within the exchanged ones
    assert turnless == trie_rows([(6, 0, "u", "x")]) and len(turnless) in (1, 2)


def test_slots_are_minimal_and_verified():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, (5000, 3), dtype=np.uint64), axis=0)
    table = SlotTable(keys)
    assert sorted(table(keys).tolist()) == list(range(len(keys)))
    assert (table(keys + np.uint64(1)) == -1).all()
    assert len(SlotTable(keys[:0])(keys)) == len(keys)


@pytest.mark.parametrize("name", ["op10_ngram_jaccard_join", "op12_merkle_manifest", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    import parity

    from usageloom.llm import queries

    folder = "/root/testdata/sf0.001"
    ok, message = parity.compare(spark, name, queries.QUERIES[name], queries.SQL[name], folder, parity.connect(folder))
    assert ok, message
