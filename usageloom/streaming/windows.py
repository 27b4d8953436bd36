"""Event-time streams built from Spark's own windows (R-01, R-11, R-12).

Batch recomputation is exact for ever; a stream drops what arrives later than
its watermark, which the daily batch then repairs.  Windows are emitted once,
when they are closed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from usageloom.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_parquet(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_lines(spark: SparkSession, root: str, glob: str, max_files: int = 1000) -> DataFrame:
    """New files under ``root`` as lines with ``path`` and ``block``; order them inside a batch."""
    from usageloom.sources.transcripts import relative_path

    reader = (
        spark.readStream.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
    )
    return reader.text(root).where(F.length(F.trim("value")) > 0).select(
        relative_path(F.col("_metadata.file_path"), root).alias("path"),
        F.col("_metadata.file_block_start").alias("block"), "value",
    )


def run_available(df: DataFrame, name: str, target: str | None = None, idle_batches: bool = True) -> DataFrame:
    """Process what is there now, append the result to files in the shared folder, and read it.

    With a ``target`` the stream resumes from its checkpoint on the next call.
    State that expires by processing time asks for batches without rows for ever,
    so such streams run without ``idle_batches``.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", idle_batches)
    root = target or f"{shared_dir(spark)}/usageloom/stream-{name}-{uuid.uuid4().hex}"
    query = (
        df.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start(f"{root}/data")
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/data")


def for_each_batch(df: DataFrame, write, checkpoint: str, mode: str = "append"):
    """Start a query that hands each micro-batch to ``write(batch, batch_id)``.

    Used where a result depends on the ledger as a whole (pace, budgets), is
    corrected later (requests) or has several outputs (usable and rejected
    records).  ``write`` must be idempotent.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def quarantine_writer(good_path: str, bad_path: str):
    """Batch writer that parses lines and stores usable and rejected records apart (S-03)."""
    from usageloom.sources.transcripts import parse_records, quarantine_split

    def write(batch: DataFrame, batch_id: int) -> None:
        raw = batch.withColumn(
            "seq", F.struct("path", "block", F.monotonically_increasing_id().alias("line"))
        ).drop("block")
        good, bad = quarantine_split(parse_records(raw))
        # A batch has a folder of its own, so that a retry replaces its first attempt.
        good.select("path", "seq", "value").write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")

    return write


def stream_daily(cost: DataFrame, watermark: str = "1 day", local_midnight: str = "0 hours") -> DataFrame:
    """Requests and cost per day of event time (R-11); ``local_midnight`` shifts the day's start."""
    day = F.window("ts", "1 day", startTime=local_midnight)
    return (
        cost.withWatermark("ts", watermark).groupBy(day.alias("w"))
        .agg(F.count(F.lit(1)).alias("n_requests"), F.sum("cost_usd").alias("cost_usd"))
        .select(F.col("w.start").alias("day_start"), "n_requests", "cost_usd")
    )


def stream_burn_rate(
    cost: DataFrame, watermark: str = "10 minutes", width: str = "30 minutes", every: str = "5 minutes"
) -> DataFrame:
    """Cost per hour in a sliding window (R-01)."""
    return (
        cost.withWatermark("ts", watermark).groupBy(F.window("ts", width, every).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_requests"), F.sum("cost_usd").alias("usd"))
        .select(
            F.col("w.end").alias("as_of"), "n_requests",
            (F.col("usd") * F.lit(3.6e9) / (F.unix_micros("w.end") - F.unix_micros("w.start"))).alias("burn_rate_usd_h"),
        )
    )


def stream_first_seen(df: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    """First row per key while copies arrive within the watermark (R-08)."""
    return df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def stream_sessions(df: DataFrame, key: str, gap: str, watermark: str = "10 minutes") -> DataFrame:
    """Activity periods per key, emitted when closed (R-12)."""
    return (
        df.withWatermark("ts", watermark)
        .groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
        .drop("w")
    )
