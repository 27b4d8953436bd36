"""Helpers around JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def spaced_ascii_json_length(compact: Column) -> Column:
    """Length that compact JSON would have with ``", "``/``": "`` separators and ASCII escapes.

    Result sizes are measured on that form.  Separators are counted outside of
    string literals; a character above U+007E takes six places, one outside the
    basic plane twelve.
    """
    outside = F.regexp_replace(compact, r'"(?:\\.|[^"\\])*"', '""')
    separators = F.length(F.regexp_replace(outside, "[^,:]", ""))
    wide = F.length(F.regexp_replace(compact, r"[^\x{7f}-\x{ffff}]", ""))
    astral = F.length(F.regexp_replace(compact, r"[^\x{10000}-\x{10ffff}]", ""))
    return (F.length(compact) + separators + 5 * wide + 11 * astral).cast("bigint")
