"""Secret redaction as a Catalyst expression (T-13)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from usageloom.fixed_values import SECRET_PATTERNS


def _apply(state: Column, name: str, pattern: str) -> Column:
    """Replace the matches of one pattern in ``state.text`` and note them."""
    regex = F.lit(pattern)

    def rewrite(s: Column) -> Column:
        text = s["text"]
        tokens = F.transform(
            F.regexp_extract_all(text, regex, F.lit(0)),
            lambda m: F.concat(F.lit(name + ":"), F.substring(F.sha2(m, 256), 1, 12)),
        )
        # The pieces between the matches, with the i-th token put back after piece i.
        joined = F.transform(
            F.array(F.struct(F.split(text, pattern, -1).alias("p"), tokens.alias("t"))),
            lambda b: F.struct(
                F.array_join(
                    F.transform(
                        b["p"],
                        lambda piece, i: F.concat(
                            piece,
                            F.when(
                                i < F.size(b["t"]),
                                F.concat(F.lit("[REDACTED:"), F.get(b["t"], i), F.lit("]")),
                            ).otherwise(F.lit("")),
                        ),
                    ),
                    "",
                ).alias("text"),
                F.concat(s["detections"], b["t"]).alias("detections"),
            ),
        )
        return F.when(F.regexp_like(text, regex), joined[0]).otherwise(s)

    # One-element arrays bind the intermediate value, so that it is evaluated once.
    return F.transform(F.array(state), rewrite)[0]


def redact(text, patterns=SECRET_PATTERNS) -> Column:
    """``struct(text, detections)``; patterns apply in order, each to the result so far."""
    col = F.col(text) if isinstance(text, str) else text
    state = F.struct(
        col.alias("text"), F.array().cast("array<string>").alias("detections")
    )
    for name, pattern in patterns:
        state = _apply(state, name, pattern)
    return state
