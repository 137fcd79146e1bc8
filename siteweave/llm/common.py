"""Helpers shared by the operators: lower case of A-Z, word cutting, bounded slices of Arrow batches."""

from __future__ import annotations

import os
import string
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of Python work holds at once; a longer text is a step of its own.
SLICE_BYTES = 1 << 20

#: Setting that bounds the bytes of an Arrow batch sent to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Bytes of a text to what word cutting reads: A-Z lowered, everything that is no digit, letter or non-ASCII byte a blank.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def lower_az(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def cut_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after lower-casing A-Z.

    UTF-8 keeps bytes from 128 up for non-ASCII letters, so cutting bytes and cutting characters agree.
    """
    return text.translate(WORD_TABLE).split()


def offsets(texts: pa.Array) -> np.ndarray:
    """Byte offsets of the strings in the array's data buffer."""
    if len(texts) == 0:
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``limit`` text bytes, or one longer row."""
    for batch in batches:
        at = offsets(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this library from where the driver has it, unless they have it already."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), root)))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes.

    Batches are bounded in rows by default, so that their bytes, which the JVM holds in buffers outside its heap,
    follow the lengths of the texts. A session that sets the bound itself keeps it.
    """
    importable(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, "4m")
    return df.mapInArrow(run, schema)


def parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` into the session's number of shuffle partitions.

    The number is stated because adaptive execution merges partitions by bytes,
    while Python work per byte is far dearer than a scan.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
