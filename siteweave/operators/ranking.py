"""Top-k, latest attempt, cell ownership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33


def top_groups(groups: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k best groups per key; Spark prunes to k rows per task before the shuffle."""
    if not 1 <= k <= 4:
        raise ValueError("between one and four groups per image")
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "component")
    return groups.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row per key; an aggregate, so that hot keys combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    stamp = F.struct(*[(o if isinstance(o, Column) else F.col(o)).alias(f"o{i}") for i, o in enumerate(order)])
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), stamp).alias("_r"))
    return last.select(*keys, "_r.*")


def cell_of(x: Column, y: Column) -> tuple[Column, Column]:
    """3×3 cell of a 0–1000 point; the outer edge belongs to the last cell."""
    return (
        F.least(F.lit(2), F.floor(x * 3 / 1000).cast("int")),
        F.least(F.lit(2), F.floor(y * 3 / 1000).cast("int")),
    )


def accepted_first(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key with accepted ones first, otherwise in input order; globally sorted."""
    return rows.orderBy(*keys, F.col("accepted").desc(), "pos")


def ordered_parts(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows in sorted ranges, written once, with ``_at`` (rises in ``order``) and ``_part`` (the range)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", ROW_BITS))


def _with_totals(rows: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the totals of their range and group; null keys are a group."""
    named = totals.withColumnsRenamed({"_part": "_total_part", **{k: f"_total_{k}" for k in keys}})
    same = F.col("_part") == F.col("_total_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_total_{k}"))
    return rows.join(named, same)


def running_total(df: DataFrame, order: Sequence[str | Column], value: str | Column, group: Sequence[str], into: str) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows of the same ``group`` that come before a row in ``order``.

    ``order`` starts with the columns of ``group`` (none: one total over all rows).
    Sums run inside sorted ranges, and the totals of the ranges before are added,
    one row a range and group; so a group that holds most rows is spread. Rows equal
    in ``order`` stand in any order among themselves.
    """
    ordered = ordered_parts(df, order)
    totals = ordered.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    here = W.partitionBy("_part", *group).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    summed = ordered.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0)))
    total = (F.col("_here") + F.col("_before")).cast("long").alias(into)
    return _with_totals(summed, totals, group).select(*df.columns, total)


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Rank from 1 within ``keys`` that never sorts a hot group in one task.

    Rows are written once, in sorted ranges; a row's rank is its place behind the
    group's first row of the same range, and the group's rows in the ranges before.
    """
    keys = list(keys)
    ordered = ordered_parts(df, [*keys, *order])
    totals = ordered.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    rank = (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name)
    return _with_totals(ordered, totals, keys).select(*df.columns, rank)


#: Hot keys that are sent to every task; more of them are joined like any table.
SENT_KEYS = 1 << 16


def spread_join(big: DataFrame, small: DataFrame, keys: Sequence[str], limit: int = 1 << 16) -> DataFrame:
    """Inner equi join in which a key with more than ``limit`` rows of ``big`` is dealt out over parts.

    The hot keys are counted out and written by one aggregate of ``big`` (best written
    before). Without any, this is a plain join. Else their rows of ``small`` are
    repeated, once a part. Up to ``SENT_KEYS`` hot keys are broadcast, so that ``big``
    is shuffled by key and part only.
    """
    hot = cut(big.groupBy(*keys).agg(F.expr(f"count(1) div {limit} + 1").alias("_parts")).filter("_parts > 1"))
    found = hot.count()
    if not found:
        return big.join(small, list(keys))
    hot = F.broadcast(hot) if found <= SENT_KEYS else hot
    dealt = big.join(hot, list(keys), "left").withColumn("_part", F.pmod(F.xxhash64(*big.columns), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1)
    repeated = small.join(hot, list(keys), "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return dealt.join(repeated, [*keys, "_part"]).drop("_part")
