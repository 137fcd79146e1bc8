"""At most one accepted answer per request over many micro-batches, with state per request."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.intake import gate

#: State store that keeps requests on disk with their changes logged, instead of in the executors' memory.
HEAP = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """Settings that a stream takes over when it starts; the session has its own again afterwards.

    State is kept on disk, unless the session names a store itself. A watermark that
    moved starts no batch of its own: what has expired goes with the next input.
    A new stream has a state store per core at most: every store is opened, committed
    and looked through in every batch, whatever it holds, and it may outgrow memory.
    """
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": str(min(shuffled, max(spark.sparkContext.defaultParallelism, 4)))}
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", HEAP) == HEAP:
        wanted |= {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def half(keep: str) -> timedelta:
    """Half of ``keep``, up to whole milliseconds: how far the watermark stays behind the latest run."""
    return timedelta(milliseconds=-(-pd.Timedelta(keep).value // 2_000_000))


def first_answers(runs: DataFrame, keys: Sequence[str], keep: str = "7 days") -> DataFrame:
    """Stream of accepted runs: ``keys, run_id, ts, fresh``; of a request that state does not know one is there once more, as ``fresh``.

    State is a row for each request, in the engine's own store. The watermark is half
    of ``keep`` behind the latest run, and a request's state goes once the watermark is
    as long past its run: ``keep`` after it. So state is bounded by the requests of that
    time. State passes over runs behind the watermark; they are here without ``fresh``,
    none is dropped.
    """
    keys = list(keys)
    ok = gate(runs).filter(F.col("refused").isNull()).select(*keys, F.col("run_id").cast("long").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"))
    # dealt out as state wants it, so that runs are read and gated once for both sides of the union
    timed = ok.repartition(*keys).withWatermark("ts", f"{half(keep) // timedelta(milliseconds=1)} milliseconds")
    return timed.dropDuplicatesWithinWatermark(keys).withColumn("fresh", F.lit(True)).unionByName(timed.withColumn("fresh", F.lit(False)))


def accept_keyed(
    runs: DataFrame, sink: str, checkpoint: str, keys: Sequence[str] = ("image_id", "stage", "label"), *, keep: str = "7 days", check_ms: int = 60_000, buckets: int = 64
) -> int:
    """Accept at most one answer per request over the life of the sink, by state for recent requests.

    Of the runs of a request that come in one batch the earliest is taken. A request
    that state does not know may have lost its state, or have been accepted by a run
    behind the watermark: it is looked up in rows of earlier batches up to the watermark,
    in the hash buckets of this batch; the scan skips files without such rows. Only where
    a batch has requests whose runs are all behind the watermark, which state passes over,
    all rows of those buckets are looked at. A batch writes its own folder and replaces it
    when replayed; after a restart the state continues from the checkpoint, which has
    the time of the latest run so far as well, for each batch. State is looked through in every
    batch, whatever ``check_ms``. Returns how many requests have state at the end.
    """
    keys, spark, behind = list(keys), runs.sparkSession, half(keep) // timedelta(microseconds=1)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    clock = f"{checkpoint}/clock"

    def write(batch: DataFrame, batch_id: int) -> None:
        # a run without a time comes last
        order = F.struct(F.col("ts").isNull().alias("untimed"), "ts", "run_id")
        asked = batch.groupBy(*keys).agg(
            F.min_by("run_id", order).alias("run_id"), F.min("ts").alias("ts"), F.bool_or("fresh").alias("fresh"), F.max("ts").alias("last")
        ).withColumn("bucket", bucket).persist()
        try:
            # the watermark of a batch comes from the batches before, and is not below the epoch
            latest = spark.read.schema("latest long").parquet(f"{clock}/batch={batch_id - 1}").first()["latest"] if batch_id > 0 else None
            mark = F.timestamp_micros(F.lit(max(0, (latest or 0) - behind)))
            late = ~F.col("fresh") & (F.col("last") <= mark)
            first = asked.filter(F.col("fresh") | late)
            there = asked.agg(F.unix_micros(F.max("last")).alias("last"), F.bool_or(late).alias("late"), F.collect_set(F.when(F.col("fresh") | late, F.col("bucket"))).alias("mine")).first()  # at most ``buckets`` numbers
            if batch_id > 0 and there["mine"]:
                parts = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
                seen = spark.read.schema(T.StructType([*(f for f in first.schema.fields if f.name in [*keys, "ts"]), *parts])).parquet(sink)
                seen = seen.filter((F.col("batch") < batch_id) & F.col("bucket").isin(there["mine"]))
                if not there["late"]:
                    seen = seen.filter(F.col("ts").isNull() | (F.col("ts") <= mark))
                same = reduce(and_, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in keys])
                first = first.alias("a").join(seen.select(*keys).alias("s"), same, "left_anti")
            # a bucket is one file of the batch; else every task would write one into every bucket
            first.drop("fresh", "last").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/batch={batch_id}")
            times = [t for t in (latest, there["last"]) if t is not None]
            spark.range(1).select(F.lit(max(times) if times else None).cast("long").alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{clock}/batch={batch_id}")
        finally:
            asked.unpersist()

    found = first_answers(runs, keys, keep)
    with stream_settings(spark):
        query = found.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return kept[-1] if kept else 0
