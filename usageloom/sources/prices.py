"""Price lists: loading, validation and lookup by date (S-07, S-08, A-34, J-10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from usageloom.fixed_values import PRICE_DEFAULTS

_MULTIPLIERS = ", ".join(f"{name}: double" for name in PRICE_DEFAULTS)
PRICE_FILE_SCHEMA = (
    f"source_url string, defaults struct<{_MULTIPLIERS}>, "
    "models array<struct<model: string, valid_from: string, valid_to: string, in_usd: double, "
    f"out_usd: double, {_MULTIPLIERS}, source_url: string>>, "
    "server_tools array<struct<tool: string, valid_from: string, valid_to: string, "
    "usd_per_unit: double, source_url: string>>"
)


def read_price_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICE_FILE_SCHEMA).option("multiLine", True).json(path)


def model_prices(price_file: DataFrame) -> DataFrame:
    """Price rows per model; a multiplier missing in a row comes from the file's defaults (S-07)."""
    rows = price_file.select(
        "defaults", "source_url", F.explode("models").alias("m")
    )
    multipliers = [
        F.coalesce(f"m.{name}", f"defaults.{name}", F.lit(value)).alias(name)
        for name, value in PRICE_DEFAULTS.items()
    ]
    return rows.select(
        "m.model",
        F.col("m.valid_from").cast("date").alias("valid_from"),
        F.col("m.valid_to").cast("date").alias("valid_to"),
        "m.in_usd", "m.out_usd", *multipliers,
        F.coalesce("m.source_url", "source_url").alias("source_url"),
    )


def tool_prices(price_file: DataFrame) -> DataFrame:
    """Price rows per server tool (S-07)."""
    rows = price_file.select("source_url", F.explode("server_tools").alias("t"))
    return rows.select(
        "t.tool",
        F.col("t.valid_from").cast("date").alias("valid_from"),
        F.col("t.valid_to").cast("date").alias("valid_to"),
        "t.usd_per_unit",
        F.coalesce("t.source_url", "source_url").alias("source_url"),
    )


def load_prices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Model and tool prices of a list (S-07), of one file or a folder of them.

    Raises an error for a list without models and for periods that are empty or
    overlap (S-08), naming the first of them.
    """
    file = read_price_file(spark, path)
    models, tools = model_prices(file), tool_prices(file)
    if models.isEmpty():
        raise ValueError(f"no model prices in {path}")
    for price, key in ((models, "model"), (tools, "tool")):
        wrong = validate_price_ranges(price, key).orderBy("identity", "valid_from").first()
        if wrong:
            raise ValueError(f"prices of {wrong['identity']} from {wrong['valid_from']}: {wrong['problem']}")
    return models, tools


def validate_price_ranges(price: DataFrame, key: str) -> DataFrame:
    """Rows that make the list ambiguous: empty ranges, and overlaps with the next period (S-08)."""
    order = W.partitionBy(key).orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    rows = price.withColumn("next_from", F.lead("valid_from").over(order))
    problem = F.when(F.col("valid_to") <= F.col("valid_from"), F.lit("empty_range")).when(
        F.col("next_from").isNotNull()
        & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("next_from"))),
        F.lit("overlap"),
    )
    return rows.select(
        F.col(key).alias("identity"), "valid_from", "valid_to", problem.alias("problem")
    ).where(F.col("problem").isNotNull())


def _repeated(df: DataFrame, count: str, slice_rows: int = 4096) -> DataFrame:
    """Each row ``count`` times; no array holds more than ``slice_rows`` values."""
    slices = F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1, F.lit(slice_rows).cast("bigint"))
    cut = df.withColumn("_from", F.explode(slices))
    size = F.least(F.lit(slice_rows), F.col(count) - F.col("_from")).cast("int")
    return cut.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), size))).drop("_from", "_copy", count)


def price_overlaps(price: DataFrame, key: str) -> DataFrame:
    """Overlapping pairs of periods of one key, one row per pair (J-10).

    Equal periods are counted before they are paired, so the join grows with
    the different periods of a key; its rows are then dealt over all tasks and repeated.
    """
    open_end = F.lit(dt.date(9999, 12, 31))
    a = price.groupBy(F.col(key).alias("identity"), "valid_from", F.coalesce("valid_to", open_end).alias("_end")).agg(F.count(F.lit(1)).alias("_n"))
    b = price.groupBy(F.col(key).alias("_key"), F.col("valid_from").alias("other_from")).agg(F.count(F.lit(1)).alias("_m"))
    pairs = a.join(b, (F.col("identity") == F.col("_key")) & (F.col("valid_from") < F.col("other_from")) & (F.col("_end") > F.col("other_from")))
    counted = pairs.groupBy("identity", "valid_from", "other_from").agg(F.sum(F.col("_n") * F.col("_m")).alias("_pairs"))
    tasks = 4 * int(price.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _repeated(counted.repartition(tasks), "_pairs")


def valid_on(day: Column | dt.date) -> Column:
    day = F.lit(day) if isinstance(day, dt.date) else day
    return (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))


def effective_prices(price: DataFrame, day: dt.date) -> DataFrame:
    """Price rows valid on a UTC date (A-34)."""
    return price.where(valid_on(day))
