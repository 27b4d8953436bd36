"""Writing ledger tables and JSON reports (S-10, S-11).

A ledger table is a Parquet folder partitioned by UTC day.  Beside it lies a slim
table of the days on which a key has ever stood, so that a batch finds the days
it has to rewrite without reading the facts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usageloom.functions.scalar import UTC_DAY as DAY, utc_day
from usageloom.session import cut_lineage

#: What identifies a row; a table without an entry is replaced day by day.
KEYS = {
    "request": ["request_id"], "tool_call": ["tool_use_id"], "prompt": ["prompt_id"], "session": ["session_id"],
    "agent": ["session_id", "agent_id"],
}
#: Marks the row that keeps the place of a day which a batch has rewritten and perhaps emptied; readers leave it out.
_GONE = "_emptied"
_SLOTS = 64


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A written table with all columns it ever had, or None if there is none yet."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _same_key(left: DataFrame, right: DataFrame, key: list[str]) -> Column:
    same = F.lit(True)
    for k in key:
        same = same & left[k].eqNullSafe(right[k])
    return same


def latest_of_key(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the latest by ``ts`` (null first), of equally late ones the one of the largest row hash."""
    late = [F.col("ts")] if "ts" in df.columns else []
    order = F.struct(*late, F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]))
    return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(F.max_by(F.struct(*df.columns), order).alias("row")).select("row.*")


def write_ledger(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]] = KEYS, stored: bool = False) -> None:
    """Add a batch to the ledger (S-10): its rows replace those of the same key, wherever they stand.

    Writing a batch again changes nothing, and overlapping batches end in the
    state that one write of all their rows would give: of rows with one key the
    later batch counts, within a batch the latest row (``latest_of_key``); a row
    that moves to another day leaves its old one, other rows of a touched day
    stay.  Only touched days are read and rewritten, by a dynamic partition
    overwrite; files follow the size of a day and are sorted by session and time.
    Tables without ``ts`` are one day without a date; tables without a key are
    replaced day by day.  One writer at a time; a batch that failed half-way is
    put right by writing it again.  ``stored`` says that the tables were read from
    files and hold each key once: they are neither reduced nor stored again.
    """
    for name, df in tables.items():
        _write(df, f"{path}/{name}", keys.get(name), stored)


def _write(df: DataFrame, target: str, key: list[str] | None, stored: bool) -> None:
    spark, data = df.sparkSession, f"{target}/rows"
    dated = utc_day("ts") if "ts" in df.columns else F.lit(None).cast("date")
    given = df.drop(DAY).withColumn(DAY, dated)
    # Without a key the batch is read only once, by the write itself.
    batch = given if stored or not key else cut_lineage(latest_of_key(given, key))
    old = stored_table(spark, data)
    if key:
        pairs = batch.select(F.pmod(F.xxhash64(*key), F.lit(_SLOTS)).cast("int").alias("slot"), *key, DAY)
        days = stored_table(spark, f"{target}/days")
        if days is not None:
            own = pairs.select(F.col("slot").alias("_slot"), *[F.col(k).alias(f"_{k}") for k in key]).distinct()
            same = (days["slot"] == F.col("_slot"))
            for k in key:
                same = same & days[k].eqNullSafe(F.col(f"_{k}"))
            known = cut_lineage(days.join(own, same, "left_semi"))
            both = _same_key(pairs, known, [*key, DAY])
            _append_days(pairs.join(known, both, "left_anti"), target)
            touched = {r[0] for r in known.select(DAY).union(batch.select(DAY)).distinct().collect()}  # dates only
        else:
            _append_days(pairs, target)
            touched = set()
        if old is not None and touched:
            of_day = F.col(DAY).isin([d for d in touched if d]) | (F.col(DAY).isNull() if None in touched else F.lit(False))
            before = _whole(old).where(of_day)
            stay = before.join(batch.select(*key), _same_key(before, batch, key), "left_anti")
            # Any of these days may end up empty.  A dynamic overwrite moves files when all are written, so the table may be read by it.
            gone = spark.createDataFrame([(d, True) for d in touched], f"{DAY} date, {_GONE} boolean")
            batch = stay.unionByName(batch, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
    if _GONE not in batch.columns:
        batch = batch.withColumn(_GONE, F.lit(None).cast("boolean"))
    order = [c for c in ("session_id", "ts") if c in batch.columns]
    batch.hint("rebalance", DAY).sortWithinPartitions(DAY, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(data)


def _append_days(pairs: DataFrame, target: str) -> None:
    pairs.hint("rebalance", "slot").write.mode("append").partitionBy("slot").parquet(f"{target}/days")


def _whole(stored: DataFrame) -> DataFrame:
    return stored.where(F.col(_GONE).isNull()).drop(_GONE).withColumn(DAY, F.col(DAY).cast("date"))


def read_ledger(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A ledger table with its UTC day, by which period filters prune; columns added later are NULL in older days."""
    stored = stored_table(spark, f"{path}/{name}/rows")
    if stored is None:
        raise FileNotFoundError(f"no ledger table {name} under {path}")
    return _whole(stored)


def rows_of(spark: SparkSession, path: str, name: str, wanted: DataFrame) -> DataFrame | None:
    """Ledger rows whose columns equal a row of ``wanted`` (some or all of the key); only the days they stand on are read."""
    days = stored_table(spark, f"{path}/{name}/days")
    if days is None:
        return None
    wanted = wanted.distinct()
    found = [r[0] for r in days.join(wanted, _same_key(days, wanted, wanted.columns), "left_semi").select(DAY).distinct().collect()]
    rows = read_ledger(spark, path, name)
    rows = rows.where(F.col(DAY).isin([d for d in found if d]) | (F.col(DAY).isNull() if None in found else F.lit(False)))
    return rows.join(wanted, _same_key(rows, wanted, wanted.columns), "left_semi")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row (S-11)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
