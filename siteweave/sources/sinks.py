"""Writers: refuse to overwrite, versioned snapshots, split-partitioned labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_new(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, **options: str | int) -> None:
    """Write once; an existing output is an error. The job's commit protocol keeps partial files out of sight."""
    writer = df.write.mode("errorifexists").format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_snapshot(df: DataFrame, path: str, version: int, parent: int | None) -> None:
    """Append one version with a pointer to its parent; a version is written once."""
    spark = df.sparkSession
    target = f"{path}/version={version}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        raise FileExistsError(f"version {version} exists: {target}")
    df.withColumn("parent_version", F.lit(parent).cast("int")).write.mode("errorifexists").parquet(target)


def read_snapshot(spark, path: str, version: int | None = None) -> DataFrame:
    """One version (partition-pruned), or all with their ``version`` column."""
    df = spark.read.parquet(path)
    return df if version is None else df.filter(F.col("version") == version)


def write_proposals(df: DataFrame, path: str, detector: str, confidence: float, nms_iou: float) -> None:
    """Proposal cache with the settings that made it beside every row."""
    settings = F.struct(
        F.lit(detector).alias("detector"), F.lit(confidence).alias("detector_confidence"), F.lit(nms_iou).alias("box_nms_iou")
    )
    write_new(df.withColumn("generator", settings), path)


def write_labels(df: DataFrame, path: str) -> None:
    """Label lines ``class cx cy w h``, one folder per split."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("class", "cx", "cy", "w", "h")])
    write_new(df.select("split", "image_id", line.alias("line")), path, "json", ["split"])


def select_entries(catalogue: DataFrame, choices: DataFrame, path: str) -> None:
    """Selection table: chosen catalogue rows in sequence with their image hash; must not exist yet."""
    write_new(choices.join(catalogue, "id"), path)
