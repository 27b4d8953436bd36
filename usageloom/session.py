"""Session defaults and the few places where lineage has to be cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    n = str(shuffle_partitions or (os.cpu_count() if cores == "*" else cores))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("usageloom")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call-site capture makes every Column operation a slow round trip.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("USAGELOOM_DRIVER_MEMORY", "8g"))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Temporary folder of each local application that names no shared folder.
_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine
    (one per application): on a cluster that folder would be lost together with
    its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.conf.get("spark.app.id")
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="usageloom-")
    return _own_folders[application]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so a lost executor costs a re-read only.

    A written table is computed once, while a checkpoint computes its input
    twice; and its file sizes tell the planner when a side is small enough to
    broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/usageloom/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows
