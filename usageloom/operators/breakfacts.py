"""Cache breaks as facts of the ledger, maintained day by day (W-01, A-18, A-19, A-32, K-03).

Whether a request breaks the cache depends on the requests before it on its
lineage, but only on two of them: the last one, and the last one that wrote for
an hour.  These tails are kept with each build, so the days that follow need
their own requests only, and a report over a period reads the facts of its days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from usageloom.functions.scalar import UTC_DAY as DAY, utc_day
from usageloom.operators.cache import COMPACTION_SLACK_S, cache_identity
from usageloom.session import cut_lineage
from usageloom.sources.sinks import stored_table

COLUMNS = (
    "lineage_id", "session_id", "request_id", "ts", "end_ts", "model", "is_interrupted", "is_synthetic", "source",
    "cache_read_tok", "cache_w5m_tok", "cache_w1h_tok", "input_tok",
)
#: Marks the row that each built day has, so that a day without breaks replaces an older build too.
_BUILT = "_built"


def lineage_tails(req: DataFrame) -> DataFrame:
    """Per lineage its last usable request and the last one that wrote for an hour: at most two rows."""
    usable = req.where((F.col("is_synthetic") == 0) & (F.col("source") == "transcript"))
    at, row = F.struct("ts", "request_id"), F.struct(*COLUMNS)
    last = usable.groupBy("lineage_id").agg(F.max_by(row, at).alias("a"), F.max_by(row, F.when(F.col("cache_w1h_tok") > 0, at)).alias("b"))
    kept = F.filter(F.array_distinct(F.array("a", "b")), lambda r: r.isNotNull())
    return last.select(F.explode(kept).alias("r")).select("r.*")


def next_breaks(req: DataFrame, hooks: DataFrame, tails: DataFrame) -> DataFrame:
    """Breaks among ``req``, which continue the lineages that ``tails`` end."""
    rows = req.select(*COLUMNS, F.lit(True).alias("_new")).unionByName(tails.select(*COLUMNS, F.lit(False).alias("_new")))
    return cache_identity(rows, hooks, keep=("_new",)).where("_new").drop("_new")


def _midnight(day: dt.date) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(), dt.timezone.utc)


def build_breaks(req: DataFrame, hooks: DataFrame, path: str, first: dt.date, last: dt.date) -> None:
    """Build the breaks of the UTC days ``first`` to ``last`` under ``path``.

    Reads these days of ``req`` (a ledger table prunes by its day) and the tails
    of earlier builds.  Building days again replaces them.  Days are built in
    their order; after late rows, build again from their day on.
    """
    spark = req.sparkSession
    days = req.where((F.col("ts") >= F.lit(_midnight(first))) & (F.col("ts") < F.lit(_midnight(last + dt.timedelta(days=1)))))
    if DAY in req.columns:
        days = days.where(F.col(DAY).between(F.lit(first), F.lit(last)))
    batch = cut_lineage(days.select(*COLUMNS))
    lineages = batch.select(F.col("lineage_id").alias("_lineage")).distinct()
    before = _tails_before(spark, path, first)
    if before is None:
        tails = batch.limit(0)
    else:
        tails = cut_lineage(before.join(lineages, F.col("lineage_id").eqNullSafe(F.col("_lineage")), "left_semi").select(*COLUMNS))
    oldest = tails.agg(F.min("ts")).first()[0]
    slack = dt.timedelta(seconds=COMPACTION_SLACK_S)
    since = min(x for x in (oldest and oldest.replace(tzinfo=oldest.tzinfo or dt.timezone.utc), _midnight(first)) if x) - slack
    near = hooks.where((F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(_midnight(last + dt.timedelta(days=1)) + slack)))
    facts = next_breaks(batch, near, tails).withColumn(DAY, utc_day("ts")).withColumn(_BUILT, F.lit(None).cast("boolean"))
    built = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(DAY), F.lit(True).alias(_BUILT))
    rows = facts.unionByName(built, allowMissingColumns=True)
    rows.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{path}/cache_break")
    ends = lineage_tails(batch.unionByName(tails)).withColumn("upto", F.lit(last))
    ends.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upto").parquet(f"{path}/cache_break_tail")


def _tails_before(spark: SparkSession, path: str, day: dt.date) -> DataFrame | None:
    """The tails of each lineage as its last build before ``day`` left them."""
    stored = stored_table(spark, f"{path}/cache_break_tail")
    if stored is None:
        return None
    earlier = stored.where(F.col("upto") < F.lit(day))
    newest = earlier.groupBy(F.col("lineage_id").alias("_lineage")).agg(F.max("upto").alias("_upto"))
    return earlier.join(newest, F.col("lineage_id").eqNullSafe(F.col("_lineage")) & (F.col("upto") == F.col("_upto"))).drop("_lineage", "_upto", "upto")


def break_facts(spark: SparkSession, path: str) -> DataFrame:
    """The breaks built so far with their UTC day, by which period filters prune."""
    stored = stored_table(spark, f"{path}/cache_break")
    if stored is None:
        raise FileNotFoundError(f"no cache breaks under {path}")
    return stored.where(F.col(_BUILT).isNull()).drop(_BUILT).withColumn(DAY, F.col(DAY).cast("date"))
