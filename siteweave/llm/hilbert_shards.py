"""Sharding along a Hilbert curve over several metadata columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Bits of each dimension.
BITS = 8


def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state for every state and cell of one level of the curve.

    A state is the entry corner of a cube and the direction of its axes. A cell's
    place in the cube is the rank, in Gray code, of its corner as seen from that
    frame; the sub-cube's frame follows from the corner where the curve enters it
    and the axis along which it leaves.
    """
    size, mask = 1 << dims, (1 << dims) - 1
    left = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & mask
    right = lambda x, k: left(x, dims - k % dims)
    gray = lambda i: i ^ (i >> 1)
    rank = {gray(i): i for i in range(size)}
    trailing_ones = lambda i: ((i + 1) & -(i + 1)).bit_length() - 1
    enters = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    leaves = lambda i: 0 if i == 0 else trailing_ones(i - 1 if i % 2 == 0 else i) % dims
    digits, states = [], []
    for entry in range(size):
        for axis in range(dims):
            for cell in range(size):
                digit = rank[right(cell ^ entry, axis + 1)]
                digits.append(digit)
                states.append((entry ^ left(enters(digit), axis + 1)) * dims + (axis + leaves(digit) + 1) % dims)
    return digits, states


def hilbert_index(coordinates: Sequence[str], bits: int = BITS) -> Column:
    """Place on the curve of whole coordinates in ``[0, 2**bits)``, by one fold over their bits."""
    dims = len(coordinates)
    digits, states = curve_table(dims)
    cell = " + ".join(f"shiftleft(cast(shiftright({c}, b) & 1 as int), {k})" for k, c in enumerate(coordinates))
    at = f"a.state * {1 << dims} + {cell}"
    array = lambda values: f"array({', '.join(map(str, values))})"
    return F.expr(
        f"aggregate(sequence({bits - 1}, 0, -1), named_struct('place', 0L, 'state', 0), (a, b) -> named_struct("
        f"'place', shiftleft(a.place, {dims}) + get({array(digits)}, {at}), 'state', get({array(states)}, {at})), a -> a.place)"
    )


def level(column: Column, bits: int = BITS) -> Column:
    """Level of a value without an order to keep (a name): its hash; null is level 0."""
    return F.when(column.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(column), F.lit(1 << bits))).cast("int")


def log_level(column: Column, bits: int = BITS) -> Column:
    """Level of a size: eight steps a doubling, in the order of sizes; null is level 0."""
    step = F.floor(8 * F.log2(F.greatest(column, F.lit(0)).cast("double") + 1))
    return F.least(F.coalesce(step, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def shard_documents(
    documents: DataFrame,
    *,
    shards: int = 24,
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    names: Sequence[str] = ("lang", "source"),
) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` and the levels and place on the curve.

    The dimensions are the columns ``names`` (those that exist), the size and the
    text's checksum. Rows are ordered by their place on the curve, then checksum
    and id, so that copies lie together, and cut into runs whose row counts differ
    by one at most (law ``rows``). A reader prunes shards by the range of levels
    that ``shard_manifest`` states for each.

    Only slim rows are sorted: a range partition by (place, checksum, id), which
    splits any number of equal texts; each partition's rows are numbered where they
    lie, and the counts of the partitions before (one row a partition) are added.

    A null text has no bytes and the checksum of none. Repeated rows have places of
    their own; their order among themselves does not show. With fewer rows than
    shards some shards stay empty; an empty table gives no rows. Columns other than
    those named are not read.
    """
    spark = documents.sparkSession
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    have = [n for n in names if n in documents.columns]
    slim = documents.select(
        F.col(id_col).alias("_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        *(level(F.col(n), bits).alias(f"level_{k}") for k, n in enumerate(have)),
    )
    slim = slim.withColumns(
        {
            f"level_{len(have)}": log_level(F.col("size"), bits),
            f"level_{len(have) + 1}": F.shiftrightunsigned(F.col("text_crc32").cast("long"), 32 - bits).cast("int"),
        }
    )
    levels = [f"level_{k}" for k in range(len(have) + 2)]
    keys = ["place", "text_crc32", "_id", "size"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.withColumn("place", hilbert_index(levels, bits)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # partition number in the upper bits, row number in the partition in the lower 33
    ordered = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)

    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    so_far = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy()).alias("_all"),
    )
    row = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    ranked = ordered.withColumn("_part", part).join(counts, "_part").withColumn("_row", row)
    # the first _all % shards runs have one row more
    short, longer = F.expr(f"_all div {shards}"), F.col("_all") % shards
    in_longer = F.col("_row") < longer * (short + 1)
    shard = F.when(in_longer, F.expr(f"_row div (_all div {shards} + 1)")).otherwise(
        F.expr(f"_all % {shards} + (_row - (_all % {shards}) * (_all div {shards} + 1)) div greatest(_all div {shards}, 1)")
    )
    ranked = ranked.withColumn("shard", shard.cast("int"))
    start = F.col("shard") * short + F.least(F.col("shard"), longer)
    return ranked.select(
        F.col("_id").alias(id_col),
        "size",
        F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_row") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "place",
        *levels,
    )


def shard_manifest(sharded: DataFrame) -> DataFrame:
    """Rows, bytes and the range of every level per shard: what a reader needs to skip shards."""
    levels = [c for c in sharded.columns if c.startswith("level_")]
    ranges = [f(c).alias(f"{c}_{n}") for c in levels for f, n in ((F.min, "min"), (F.max, "max"))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ranges)
