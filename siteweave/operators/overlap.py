"""Pairs of overlapping boxes inside one image, without per-image hot spots.

The image id is the equi key. An image whose box count passes ``limit`` is cut
into grids of doubling cell size. A box lies in the few cells of the grid whose
cells are as large as itself, and looks for larger boxes in the coarser grids,
so that a box as large as the image is not copied into every cell. A cell that
is still too full is salted. Each pair is produced in exactly one place: the
grid of its larger box, the cell that holds the lower-left corner of the
intersection, and the salt of its smaller box. Images of ordinary size are
joined on the image id alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BOX, box
from ..session import cut

PAIR_LIMIT = 4096


def hot_images(boxes: DataFrame, keys: Sequence[str], limit: int, bounds: Sequence[str] = BOX) -> DataFrame:
    """Images beyond ``limit`` boxes with the cell edge ``_step`` of their finest grid and the level ``_top`` of
    their coarsest; at most rows/limit rows."""
    x0, y0, x1, y1 = (F.col(c) for c in bounds)
    divisions = F.ceil(F.sqrt(F.col("_n") / limit)) + 1
    return (
        boxes.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max(F.greatest(x1, y1)).alias("_high"),
            F.min(F.least(x0, y0)).alias("_low"),
        )
        .filter((F.col("_n") > limit) & (F.col("_high") > F.col("_low")))
        .select(*keys, ((F.col("_high") - F.col("_low")) / divisions).alias("_step"), F.ceil(F.log2(divisions)).cast("int").alias("_top"))
    )


def gridded(
    boxes: DataFrame, hot: DataFrame, keys: Sequence[str], upward: bool, bounds: Sequence[str] = BOX
) -> DataFrame:
    """One row per (box, cell): adds ``_step``, the box's own level ``_own``, the level ``_lv`` and cell ``_cx, _cy``.

    A box has the cells of its own level only, or with ``upward`` also those of all coarser ones. In ordinary
    images ``_step`` is null and everything lies in cell (0, 0) of level 0. Whether the lookup table is broadcast
    is left to the size-based rule of the engine.
    """
    x0, y0, x1, y1 = (F.col(c) for c in bounds)
    size = F.greatest(x1 - x0, y1 - y0)
    level = F.when(size > F.col("_step"), F.least(F.ceil(F.log2(size / F.col("_step"))).cast("int"), F.col("_top"))).otherwise(F.lit(0))
    out = boxes.join(hot, list(keys), "left").withColumn("_own", level)
    top = F.greatest(F.coalesce("_top", F.lit(0)), F.col("_own")) if upward else F.col("_own")
    out = out.withColumn("_lv", F.explode(F.sequence("_own", top)))

    def cell(v: Column) -> Column:
        return F.coalesce(F.floor(v / (F.col("_step") * F.pow(F.lit(2.0), F.col("_lv")))), F.lit(0)).cast("int")

    out = out.withColumn("_cx", F.explode(F.sequence(cell(x0), cell(x1))))
    return out.withColumn("_cy", F.explode(F.sequence(cell(y0), cell(y1)))).drop("_top")


def box_pairs(
    left: DataFrame,
    right: DataFrame | None = None,
    keys: Sequence[str] = ("image_id",),
    condition: Column | None = None,
    limit: int = PAIR_LIMIT,
    bounds: Sequence[str] = BOX,
) -> DataFrame:
    """Join boxes that intersect with positive area; columns under aliases ``a`` and ``b``.

    With one input every unordered pair appears once, ``a.id < b.id``. With two
    inputs every combination of a left and a right box appears once; ``id`` is
    unique per key on either side. ``condition`` is a residual on the aliases.

    One aggregate over the key and box columns looks for images beyond ``limit``.
    Without any, the plan is a plain merge join on the keys. Else ``a`` and ``b`` are
    structs, which are read by the same names. Boxes are never broadcast: those made
    out of a table (rows of a raster, cells) look as small as the table's file.
    """
    keys = list(keys)
    self_join = right is None
    sides = left.select(*keys, "id", *bounds)
    if not self_join:
        sides = sides.withColumn("_side", F.lit(0)).unionByName(
            right.select(*keys, "id", *bounds).withColumn("_side", F.lit(1))
        )
    hot = cut(hot_images(sides, keys, limit, bounds))
    ba = tuple(F.col(f"a.{c}") for c in bounds)
    bb = tuple(F.col(f"b.{c}") for c in bounds)
    rest = (F.least(ba[2], bb[2]) > F.greatest(ba[0], bb[0])) & (F.least(ba[3], bb[3]) > F.greatest(ba[1], bb[1]))
    if self_join:
        rest = rest & (F.col("a.id") < F.col("b.id"))
    if condition is not None:
        rest = rest & condition
    right = left if self_join else right
    if hot.isEmpty():
        return left.alias("a").join(right.alias("b").hint("merge"), [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys), rest])

    cell = [*keys, "_lv", "_cx", "_cy"]
    rising = gridded(sides, hot, keys, True, bounds)
    full = (
        rising.filter(F.col("_step").isNotNull())
        .groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_m"))
        .filter(F.col("_m") > limit)
        .select(*cell, F.ceil(F.col("_m") / limit).cast("int").alias("_salts"))
    )
    full = cut(full)

    def small(df: DataFrame) -> DataFrame:
        """Every box in its own and all coarser grids, in one salt of a full cell."""
        out = gridded(df, hot, keys, True, bounds).join(full, cell, "left")
        return out.withColumn("_salt", F.pmod(F.xxhash64("id"), F.coalesce("_salts", F.lit(1))).cast("int"))

    def large(df: DataFrame) -> DataFrame:
        """Every box in its own grid, in all salts of a full cell."""
        out = gridded(df, hot, keys, False, bounds).join(full, cell, "left")
        return out.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))

    edge = F.col("a._step") * F.pow(F.lit(2.0), F.col("a._lv"))
    home = (F.floor(F.greatest(ba[0], bb[0]) / edge) == F.col("a._cx")) & (F.floor(F.greatest(ba[1], bb[1]) / edge) == F.col("a._cy"))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*cell, "_salt"]] + [rest, F.col("a._step").isNull() | home]
    one = small(left).alias("a").join(large(right).alias("b").hint("merge"), [*on, F.col("a._own") <= F.col("b._own")])
    two = large(left).alias("a").join(small(right).alias("b").hint("merge"), [*on, F.col("b._own") < F.col("a._own")])
    sides_of = lambda df: df.select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))
    return sides_of(one).unionByName(sides_of(two))


def overlapping_pairs(
    boxes: DataFrame,
    measure: Column,
    threshold: float,
    strict: bool = False,
    keys: Sequence[str] = ("image_id",),
    keep: Sequence[str] = (),
    limit: int = PAIR_LIMIT,
) -> DataFrame:
    """``keys, id_a, id_b, overlap`` (+ ``keep`` columns as ``*_a``/``*_b``) at or above the threshold.

    ``measure`` is written on the aliases ``a`` and ``b``.
    """
    needed = dict.fromkeys([*keys, "id", *BOX, *keep])
    passed = measure > threshold if strict else measure >= threshold
    pairs = box_pairs(boxes.select(*needed), keys=keys, condition=passed, limit=limit)
    extra = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in keep for s in ("a", "b")]
    return pairs.select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        F.col("a.id").alias("id_a"),
        F.col("b.id").alias("id_b"),
        measure.alias("overlap"),
        *extra,
    )


def ab() -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    return box(alias="a"), box(alias="b")


def coincident_pairs(boxes: DataFrame, first: str, second: str, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Identical boxes labelled once ``first`` and once ``second``: an equi join on the box."""
    on = [*keys, *BOX]
    a = boxes.filter(F.col("category") == first).select(*on, F.col("id").alias("id_a"))
    b = boxes.filter(F.col("category") == second).select(*on, F.col("id").alias("id_b"))
    return a.join(b, on).select(
        *keys,
        F.least("id_a", "id_b").alias("id_a"),
        F.greatest("id_a", "id_b").alias("id_b"),
    )
