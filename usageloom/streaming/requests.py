"""Split responses merged across micro-batches, files and restarts (R-10).

Spark's own streaming aggregation holds, per request, file and span of event
time, what the records add up to so far.  All of it is associative (first by
arrival, last stop reason, maxima), so parts of a request may come in any order
and lie any time apart.  Each batch upserts the parts it touched and the
requests they belong to into the ledger; a correction simply replaces its row.
State is freed when the watermark has passed a span; the parts stay in the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usageloom.operators.merge import FIRST_COLUMNS, joined_parts, merge_parts, part_columns
from usageloom.session import cut_lineage
from usageloom.sources.sinks import KEYS, rows_of, write_ledger

PART_KEYS = KEYS | {"request_part": ["request_id", "path", "span"]}


def stream_request_parts(usage: DataFrame, watermark: str = "1 day", span: str = "1 day") -> DataFrame:
    """Parts of requests, each as often as it changes; run in update mode.

    ``usage`` has T-02's columns (``prompt_id`` may be absent).  Records later
    than the watermark are dropped, as in any stream; the daily batch repairs that.
    """
    if "prompt_id" not in usage.columns:
        usage = usage.withColumn("prompt_id", F.lit(None).cast("string"))
    parts = usage.withWatermark("ts", watermark).groupBy("request_id", "path", F.window("ts", span).alias("w")).agg(*part_columns(FIRST_COLUMNS))
    # Parts lie on the day their span begins, which never changes.
    return parts.select("request_id", "path", F.col("w.start").alias("span"), F.col("w.start").alias("ts"), *[c for c in parts.columns if c not in ("request_id", "path", "w")])


def request_writer(path: str):
    """Batch writer for ``for_each_batch``: upserts ``request_part`` and ``request`` of the ledger under ``path``.

    A row of a batch holds the whole part so far, so writing a batch again, or a
    part of one after a failure, ends in the same state.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parts = cut_lineage(batch)
        if parts.isEmpty():
            return
        write_ledger({"request_part": parts}, path, PART_KEYS, stored=True)
        own = rows_of(batch.sparkSession, path, "request_part", parts.select("request_id"))
        write_ledger({"request": cut_lineage(merge_parts(joined_parts(own)))}, path, PART_KEYS, stored=True)

    return write
