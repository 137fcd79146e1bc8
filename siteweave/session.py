"""Session helpers: builder defaults, reliable checkpoints, scratch tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benches; on a cluster the submitter configures the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siteweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Where it is unset, a folder below ``spark.sql.warehouse.dir``, which executors share as well, takes its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages")
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and go on from the written table.

    The lineage ends there, lost executors cost nothing that came before, and
    the reader knows the size of the table when it picks a join. (A reliable
    ``checkpoint`` would run the last stage twice and hide the size.)
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGES: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder; :func:`drop_stages` removes what was written there."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    _STAGES.append(path)
    return path


def drop_stages(spark: SparkSession, keep: Iterable[str] = ()) -> int:
    """Remove the stage tables this process has written, once no result that reads them is needed any more.

    Returns how many were removed. Frames built on them cannot be evaluated afterwards.
    """
    kept, jvm, removed = set(keep), spark.sparkContext._jvm, 0
    for path in [p for p in _STAGES if p not in kept]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))
        _STAGES.remove(path)
    return removed


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches sent to Python, not only their rows, unless the session has a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def for_python(df: DataFrame, *keys: str, grouped: bool = True) -> DataFrame:
    """Partition by ``keys`` into ``spark.sql.shuffle.partitions`` parts ahead of Python work.

    Adaptive execution merges partitions by their bytes; work done in Python per
    row costs far more than its bytes tell, so the number is fixed here. A
    grouped map on the same keys needs no further shuffle. For row-wise maps
    (``grouped=False``) the rows go by the hash of the keys: a plain repartition
    would be dropped as redundant after a join on the same keys.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if grouped else df.repartition(n, F.xxhash64(*keys))
