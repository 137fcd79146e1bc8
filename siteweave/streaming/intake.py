"""Incremental answer intake and live tallies with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.intake import gate


def answer_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", max_files: int = 1000) -> DataFrame:
    """New run files of a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def accept_once(
    runs: DataFrame, sink: str, checkpoint: str, keys: Sequence[str] = ("image_id", "stage", "label"), buckets: int = 64
) -> None:
    """Accept at most one answer per request over the life of the sink.

    Within a micro-batch the earliest accepted run wins; requests that earlier
    batches answered are skipped by an anti join with the sink, of which only the
    hash buckets that the batch has are read. A batch writes its own folder and
    replaces it when replayed, so restarts add nothing twice.
    """
    keys = list(keys)
    spark = runs.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        ok = gate(batch).filter(F.col("refused").isNull()).select(*keys, "run_id", "ts")
        first = (
            ok.groupBy(*keys).agg(F.min_by("run_id", F.struct("ts", "run_id")).alias("run_id"), F.min("ts").alias("ts"))
        )
        if batch_id > 0:
            mine = [r[0] for r in first.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
            parts = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
            seen = spark.read.schema(T.StructType([*first.schema.fields, *parts])).parquet(sink)
            seen = seen.filter((F.col("batch") < batch_id) & F.col("bucket").isin(mine))
            first = first.join(seen.select(*keys), keys, "left_anti")
        first.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/batch={batch_id}")

    query = (
        runs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


PARTIAL = "window_start timestamp, window_end timestamp, reason string, n bigint, latest timestamp, batch bigint"


def tally_rejections(runs: DataFrame, sink: str, checkpoint: str, window: str = "1 day") -> None:
    """Counts of answers per window and refusal reason, one partial count per micro-batch.

    A batch writes its own folder and replaces it when replayed. No row is late:
    whatever order files come in, :func:`rejection_windows` adds the parts up.
    """
    gated = gate(runs).withColumn("reason", F.coalesce("refused", F.lit("accepted")))
    timed = gated.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_w", F.window("ts", window))

    def write(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "reason").agg(
            F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest")
        )
        part.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = (
        timed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def rejection_windows(spark: SparkSession, sink: str, delay: str = "1 hour") -> DataFrame:
    """Sums of the partial counts: ``window_start, reason, n, open``.

    A window is open while it ends within ``delay`` of the latest answer seen.
    """
    parts = spark.read.schema(PARTIAL).parquet(sink)
    tally = parts.groupBy("window_start", "window_end", "reason").agg(F.sum("n").alias("n"))
    last = parts.agg(F.max("latest") - F.expr(f"interval {delay}")).first()[0]
    return tally.select("window_start", "reason", "n", (F.col("window_end") > F.lit(last)).alias("open"))
