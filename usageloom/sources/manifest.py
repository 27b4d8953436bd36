"""Audit of archived segments (S-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from usageloom.operators.temporal import with_previous
from usageloom.sources.transcripts import relative_path

MANIFEST_SCHEMA = (
    "ts double, path string, gen bigint, start bigint, end bigint, bytes bigint, sha256 string, "
    "seg string, kind string, codec string"
)
STRETCH = 1 << 30  # offsets per bucket of one path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def segment_hashes(spark: SparkSession, root: str) -> DataFrame:
    """Hash of each stored segment that is kept uncompressed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        relative_path(F.col("path"), root).alias("seg"), F.sha2("content", 256).alias("found_sha256")
    )


def latest_generation(manifest: DataFrame) -> DataFrame:
    """Segments of the newest generation of each path."""
    newest = manifest.groupBy("path").agg(F.max("gen").alias("gen"))
    return manifest.join(newest, ["path", "gen"], "left_semi")


def manifest_audit(manifest: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Gaps and overlaps between segments of a path's newest generation, and wrong contents (S-09)."""
    parts = latest_generation(manifest)
    seq = with_previous(parts, "path", F.col("start"), "seg", ("end",), bucket_us=STRETCH)
    expected = F.coalesce("prev.end", F.lit(0).cast("bigint"))
    holes = seq.where(F.col("start") != expected).select(
        "path", "gen", "seg", F.lit("gap").alias("problem"), expected.alias("expected_start"), "start"
    )
    if hashes is None:
        return holes
    nothing = F.lit(None).cast("bigint")
    wrong = parts.join(hashes, "seg", "left").where(
        ~F.col("sha256").eqNullSafe(F.col("found_sha256"))
    ).select(
        "path", "gen", "seg",
        F.when(F.col("found_sha256").isNull(), F.lit("missing")).otherwise(F.lit("sha mismatch")).alias("problem"),
        nothing.alias("expected_start"), nothing.alias("start"),
    )
    return holes.unionByName(wrong)
