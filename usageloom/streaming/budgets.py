"""Pace and budgets that follow a stream (R-02, R-03).

Each micro-batch leaves the sums of its own rows, in a folder named by its
number: a batch that is run again replaces them, so every row counts exactly
once.  The point-in-time operators read the sums like requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from usageloom.functions.scalar import micros
from usageloom.operators.pointintime import budget_crossings

SUMS = "ts timestamp, cost_usd double, n_requests bigint, batch bigint"
CROSSINGS = "period string, start date, level int, batch bigint"


def budget_writer(path: str, budgets: dict[str, float | None], tz: str, grain_s: int = 60):
    """Batch writer for ``for_each_batch`` over priced requests (``ts``, ``cost_usd``).

    Leaves sums per ``grain_s`` seconds and the budget levels that this batch was
    the first to reach; each (period, start, level) is told once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, grain = batch.sparkSession, grain_s * 1_000_000
        start = F.timestamp_micros((F.floor(micros("ts") / grain) * grain).cast("bigint"))
        sums = batch.groupBy(start.alias("ts")).agg(F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("n_requests"))
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={batch_id}")
        so_far = live_sums(spark, path).where(F.col("batch") <= batch_id)
        told = _read(spark, path, "crossings", CROSSINGS).where(F.col("batch") < batch_id)
        new = budget_crossings(so_far, budgets, tz).join(told, ["period", "start", "level"], "left_anti")
        new.coalesce(1).write.mode("overwrite").parquet(f"{path}/crossings/batch={batch_id}")  # at most a few levels

    return write


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    folder = f"{path}/{name}"
    spark.createDataFrame([], schema).drop("batch").coalesce(1).write.mode("ignore").parquet(f"{folder}/batch=-1")  # so that there is a folder to read
    return spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/batch=*")


def live_sums(spark: SparkSession, path: str) -> DataFrame:
    """Cost per span of time and batch, for ``pace_landing`` (as cost and as requests) and ``budget_usage``.

    An ``as_of`` on the grain gives what the requests themselves would give.
    """
    return _read(spark, path, "sums", SUMS)


def crossings(spark: SparkSession, path: str) -> DataFrame:
    """The budget levels reached so far, with the batch that reached each."""
    return _read(spark, path, "crossings", CROSSINGS)
