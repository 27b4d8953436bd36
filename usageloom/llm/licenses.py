"""License scans by conditional compression.

A block is a run of lines that speak of licensing, with as many words around it
as a statement may have.  Windows of some dozen words of it are compressed alone
and with each template as a raw zstandard dictionary; templates are ranked by the
bytes that saves, as a share of the template's own, so the length of a block does
not matter.  Licenses are confirmed by their exact wording: the least number of
words to insert, delete or replace to find the template somewhere in the block.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm.common import read_table

CUE = r"(?i)licen[sc]|copyright|spdx|warrant|redistribut|permission is hereby|public domain|all rights reserved"

#: Common license statements.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files, to deal in the Software without restriction.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                "the following conditions are met:",
    "proprietary": "All rights reserved.",
}

FOUND = ("doc_id long, block int, first_line int, n_lines int, license string, reduction double, differences int, "
         "confirmed boolean, wording string, ranked array<struct<license: string, reduction: double>>")
_WORD = re.compile(r"\S+")


class Text:
    """Words of a text, their places and lines."""

    def __init__(self, text: str):
        self.text, self.lines = text, text.split("\n")
        self.spans = [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.spans]
        self.words = [_plain(text[a:b]) for a, b in self.spans]
        self.begins = [0]
        for line in self.lines:
            self.begins.append(self.begins[-1] + len(line) + 1)

    def line(self, word: int) -> int:
        return bisect_right(self.begins, self.starts[word]) - 1

    def words_of(self, first: int, last: int) -> tuple[int, int]:
        """The words (from, to) of some lines."""
        return bisect_left(self.starts, self.begins[first]), bisect_left(self.starts, self.begins[last + 1])

    def piece(self, a: int, b: int) -> str:
        return self.text[self.spans[a][0]:self.spans[b - 1][1]] if b > a else ""

    def blocks(self, cue: re.Pattern, gap: int) -> list[list[int]]:
        """First and last line of runs of lines with a cue (or a part of a wrapped one), over at most ``gap`` lines without."""
        hits = {k for k, line in enumerate(self.lines) if cue.search(line)}
        places = [0]
        for a, b in self.spans:
            places.append(places[-1] + b - a + 1)
        for m in cue.finditer(" ".join(self.text[a:b] for a, b in self.spans)):
            if m.end() > m.start():
                a, b = (self.line(bisect_right(places, at) - 1) for at in (m.start(), m.end() - 1))
                hits.update(range(a, b + 1) if b > a else ())
        out: list[list[int]] = []
        for k in sorted(hits):
            if out and k - out[-1][1] <= gap + 1:
                out[-1][1] = k
            else:
                out.append([k, k])
        return out


def _plain(word: str) -> str:
    return word.lower().strip(".,;:!?()\"'")


def _last_row(pattern: list[str], words: list[str], anchored: bool = False) -> np.ndarray:
    """Least edits between the pattern and a stretch up to each place among the words (``anchored``: all words up to it)."""
    codes = {w: k for k, w in enumerate(dict.fromkeys(pattern))}
    coded = np.array([codes.get(w, -1) for w in words], np.int64)
    steps = np.arange(len(words) + 1)
    row = steps if anchored else np.zeros(len(words) + 1, np.int64)
    for w in pattern:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (coded != codes[w]))
        row = np.minimum.accumulate(new - steps) + steps
    return row


def _start(template: list[str], words: list[str]) -> tuple[int, int]:
    """Least edits between the template and a stretch that ends with the last of ``words``, and its longest start."""
    back = _last_row(template[::-1], words[::-1], anchored=True)
    return int(back.min()), len(words) - int(np.flatnonzero(back == back.min())[-1])


def wording(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """Least word edits between the template and any stretch of the block, and the stretch (from, to).

    The edit table has one row per word of the template, a whole row at a time;
    of equally good stretches the one that ends first, then the longest start.
    """
    row = _last_row(template, block)
    end = int(row.argmin())
    n, a = _start(template, block[:end])
    return n, a, end


class Scanner:
    def __init__(self, templates: Mapping[str, str], level: int, allowed: float):
        self.allowed = allowed
        self.alone = zstandard.ZstdCompressor(level=level)
        self.words = {name: [_plain(w) for w in _WORD.findall(text)] for name, text in templates.items()}
        self.size = {name: len(self.alone.compress(text.encode())) for name, text in templates.items()}
        #: No stretch that confirms a license has more words than this.
        self.reach = max((int(len(own) * (1 + allowed)) for own in self.words.values()), default=0) + 1
        self.given = {}
        for name, text in templates.items():
            known = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = zstandard.ZstdCompressor(level=level, dict_data=known)

    def saved(self, window: str) -> dict[str, float]:
        """Of each template the share of its compressed bytes that it saves in a window."""
        raw = window.encode("utf-8", "surrogatepass")
        alone = len(self.alone.compress(raw))
        return {name: (alone - len(c.compress(raw))) / self.size[name] for name, c in self.given.items()}

    def stretches(self, text: Text, lo: int, hi: int, least: float) -> list[tuple]:
        """Confirmed statements among the words ``lo`` to ``hi``, none overlapping: from, to and the columns of a row.

        One edit table per template gives all places where a close wording ends.
        They are taken from the smallest share of changed words on (ties: larger
        reduction, then the earlier); what a taken one leaves is judged anew.
        """
        words, windows = text.words[lo:hi], {}
        present = set(words)

        def saved(end: int) -> dict[str, float]:
            # Windows overlap by half, so any stretch of up to ``reach`` words lies whole in one.
            a = max(0, end - self.reach) // self.reach * self.reach
            if a not in windows:
                windows[a] = self.saved(text.piece(lo + a, min(hi, lo + a + 2 * self.reach)))
            return windows[a]

        heap = []
        for name, own in self.words.items():
            if sum(w not in present for w in own) / len(own) <= self.allowed:
                row = _last_row(own, words)
                heap += [(row[end] / len(own), -saved(end)[name], end, name) for end in np.flatnonzero(row / len(own) <= self.allowed).tolist() if end]
        heapq.heapify(heap)
        taken: list[tuple[int, int]] = []
        out = []
        while heap:
            share, reduction, end, name = heapq.heappop(heap)
            k = bisect_left(taken, (end,))
            left = max(taken[k - 1][1] if k else 0, end - self.reach)
            if left >= end:
                continue
            own = self.words[name]
            n, a = _start(own, words[left:end])
            if n / len(own) > share:  # a statement taken before has some of its words
                if n / len(own) <= self.allowed:
                    heapq.heappush(heap, (n / len(own), reduction, end, name))
            elif left + a < end:
                a += left
                insort(taken, (a, end))
                out.append((lo + a, lo + end, name, -reduction, n, True, text.piece(lo + a, lo + end), self.ranking(saved(end), least)))
        return out

    def closest(self, text: Text, lo: int, hi: int, least: float) -> tuple:
        """The columns of a row for words without a confirmed statement: what the template that fits best would need."""
        reductions: dict[str, float] = {}
        for a in range(lo, max(lo + 1, hi - self.reach), self.reach):
            for name, r in self.saved(text.piece(a, min(hi, a + 2 * self.reach))).items():
                reductions[name] = max(r, reductions.get(name, r))
        ranking = self.ranking(reductions, least)
        best = None
        for name, reduction in ((x["license"], x["reduction"]) for x in ranking):
            n, a, b = wording(self.words[name], text.words[lo:hi])
            if best is None or n / len(self.words[name]) < best[0]:
                best = (n / len(self.words[name]), name, reduction, n, False, text.piece(lo + a, lo + b))
        return (*(best[1:] if best else (None, None, None, False, None)), ranking)

    @staticmethod
    def ranking(reductions: dict[str, float], least: float) -> list[dict]:
        ranked = sorted(((r, name) for name, r in reductions.items() if r >= least), key=lambda x: (-x[0], x[1]))
        return [{"license": name, "reduction": r} for r, name in ranked]

    def scan(self, text: str, cue: re.Pattern, gap: int, least: float) -> list[tuple]:
        """Rows of a text: block, its first line and number of lines, then license, reduction, differences, confirmed, wording, ranking."""
        own = Text(text)
        runs = own.blocks(cue, gap)
        wide: list[list[int]] = []
        for first, last in runs:
            a, b = own.words_of(first, last)
            a, b = max(0, a - self.reach), min(len(own.words), b + self.reach)
            if wide and a <= wide[-1][1]:
                wide[-1][1] = b
            else:
                wide.append([a, b])
        found = sorted(x for a, b in wide for x in self.stretches(own, a, b, least))
        # A statement belongs to the runs that it touches, which become one block, or else to the nearest.
        firsts, lasts = [a for a, _ in runs], [b for _, b in runs]
        whole = [[a, b, []] for a, b in runs]
        for row in found:
            a, b = own.line(row[0]), own.line(row[1] - 1)
            k, end = bisect_left(lasts, a), bisect_right(firsts, b)
            if k >= end and (k == len(runs) or k and a - lasts[k - 1] < firsts[k] - b):
                k -= 1
            whole[k][0], whole[k][1] = min(a, whole[k][0]), max(b, whole[k][1])
            whole[k][2].append(row)
        blocks: list[list] = []
        for first, last, rows in whole:
            if blocks and first <= blocks[-1][1]:
                blocks[-1][1] = max(last, blocks[-1][1])
                blocks[-1][2] += rows
            else:
                blocks.append([first, last, rows])
        out = []
        for k, (first, last, rows) in enumerate(blocks):
            if rows:
                out += [(k, first, last - first + 1, *row[2:]) for row in rows]
                continue
            a, b = own.words_of(first, last)
            a = max(a - self.reach, own.words_of(0, blocks[k - 1][1])[1] if k else 0)
            b = min(b + self.reach, own.words_of(0, blocks[k + 1][0] - 1)[1] if k + 1 < len(blocks) else len(own.words))
            out.append((k, first, last - first + 1, *self.closest(own, a, b, least)))
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, cue: str = CUE, gap: int = 2, least: float = 0.05,
                  allowed: float = 0.2, level: int = 3) -> DataFrame:
    """One row per license statement of each block of ``docs`` (``doc_id``, ``text``), or one for a block without.

    Statements are stretches that differ from a template in at most ``allowed``
    of its words; those of the smallest share of changed words come first (ties:
    larger reduction), and none overlaps another.  They may be wrapped over lines
    in any way and stand anywhere within a statement's length of the block, which
    grows by their lines.  ``reduction`` is what the template saves in a window of
    the block, as a share of the template's own compressed bytes.  A block without
    a statement has one row that is not ``confirmed``: of the templates that save
    ``least``, the one that would need the smallest share of changes, or a null
    license.  Null texts and texts without a cue have no row; blocks may be of any
    length.  Nothing is shuffled.
    """
    pattern = re.compile(cue)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, level, allowed)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc_id, *row) for row in scanner.scan(text, pattern, gap, least)]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_(), pa.string(),
                     pa.list_(pa.struct([("license", pa.string()), ("reduction", pa.float64())])))
            names = ["doc_id", "block", "first_line", "n_lines", "license", "reduction", "differences", "confirmed", "wording", "ranked"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    # Whether any cue occurs is found out in the scan already; most texts never reach Python.
    wrapped = F.regexp_replace("text", r"(?U)\s+", " ").rlike(cue)
    speaking = docs.where(F.col("text").rlike(cue) | wrapped).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return speaking.mapInArrow(scan, FOUND)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "block", "first_line", "n_lines", "license", "reduction", "differences", "confirmed", "wording")
