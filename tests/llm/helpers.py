"""Plain Python versions of the operators and small tables of awkward rows."""

from __future__ import annotations

import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} next{k % 31}." for k in range(60_000))


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rows = [
        (1, "The cat sat on the mat and looked at the dog.\nIt was not amused at all.", "en", "a", 70),
        (2, "the cat sat on the mat and looked at the dog.\nit was not amused at all.", "en", "a", 70),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t ", "de", "b", 4), (6, "12 34 !!", None, "b", 8),
        (7, LONG, "en", "a", len(LONG)), (8, LONG, "en", None, len(LONG)), (9, "é ü 日本語 ☃ 𝒳", "fr", "b", 12),
        (10, "x", "de", "c", 1), (10, "x", "de", "c", 1), (11, "x", "de", "c", 1), (None, "y z", "de", "c", 3), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """More columns, with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["n", "rank", "hash", "_hash", "_part", "_rest", "_key", "size_", "bucket", "_lines", "_id", "_dropped", "n_lines", "lang_pred", "score",
             "component", "node", "times", "taken", "target", "source_size", "_scored", "keep_id", "quality_score", "n_tokens", "length", "piece"]
    return df.select("*", *[F.lit("clash").alias(c) for c in names])


def words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard_groups(docs, percent=75):
    """doc_id -> (number of shingles, smallest linked id), by counting shared shingles of all pairs."""
    ids, sets = [d for d, _ in docs], [shingles(t) for _, t in docs]
    holders = {}
    for k, own in enumerate(sets):
        for s in own:
            holders.setdefault(s, []).append(k)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in enumerate(sets):
        for j, n in Counter(j for s in own for j in holders[s] if j > k).items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    least = {}
    for k in range(len(ids)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return {ids[k]: (len(sets[k]), least[find(k)]) for k in range(len(ids))}


def dedup_lines(docs, every=3):
    """doc_id -> (text, removed chunks); ids must differ."""
    import hashlib

    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        if text is None:
            out[doc_id] = (None, 0)
            continue
        lines = text.split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        chunks, now = [], []
        for k, line in enumerate(lines):
            now.append(line)
            rolled = (hashes[k] + (hashes[k - 1] if k else 0) * 1_000_003) % 2_147_483_647
            if rolled % every == 0 or k == len(lines) - 1:
                chunks.append(now)
                now = []
        kept, gone = [], 0
        for chunk in chunks:
            joined = "\n".join(chunk)
            if sum(x != "" for x in chunk) >= 2 and joined in seen:
                gone += 1
                continue
            kept.append(joined)
            if sum(x != "" for x in chunk) >= 2:
                seen.add(joined)
        out[doc_id] = ("\n".join(kept), gone)
    return out
