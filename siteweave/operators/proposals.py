"""Detector proposals: normalisation, size gates, variants, mask choice, structure filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import BOX, box, dlit
from ..session import cut
from .ranking import rank_in_group

# fixed values: name, left, up, right, down as shares of the box
CONTEXT_VARIANTS = (
    ("original", 0.0, 0.0, 0.0, 0.0),
    ("roof_wall_recovery", 0.08, 0.80, 0.08, 0.12),
    ("balanced_context", 0.18, 0.45, 0.18, 0.28),
)


def normalize_proposals(rows: DataFrame, area: tuple[float, float] = (0.001, 0.16)) -> DataFrame:
    """Tile-1000 boxes to canvas pixels.

    Needs ``tx0…ty1`` (tile), ``width, height`` (canvas) and ``confidence``.
    Boxes are held in the frame; empty ones and those of unlikely size go.
    """
    held = {c: F.greatest(dlit(0), F.least(dlit(1000), F.col(c))) for c in BOX}
    tw, th = F.col("tx1") - F.col("tx0"), F.col("ty1") - F.col("ty0")
    out = (
        rows.dropna(subset=list(BOX))
        .withColumns(held)
        .filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
        .withColumns(
            {
                "x0": F.col("tx0") + F.col("x0") * tw / 1000,
                "y0": F.col("ty0") + F.col("y0") * th / 1000,
                "x1": F.col("tx0") + F.col("x1") * tw / 1000,
                "y1": F.col("ty0") + F.col("y1") * th / 1000,
            }
        )
    )
    share = (
        (F.col("x1") - F.col("x0"))
        * (F.col("y1") - F.col("y0"))
        / F.greatest(F.col("width") * F.col("height"), dlit(1))
    )
    score = F.greatest(dlit(0.01), F.least(dlit(1), F.coalesce(F.col("confidence"), dlit(0.5))))
    return out.filter(share.between(*area)).withColumn("score", F.round(score, 6))


def plausible_size(
    boxes: DataFrame, area: tuple[float, float] = (0.0015, 0.14), width: float = 0.48, height: float = 0.38
) -> DataFrame:
    """Keep boxes neither brush-mark small nor landscape large."""
    bw = F.greatest(dlit(0), F.col("x1") - F.col("x0"))
    bh = F.greatest(dlit(0), F.col("y1") - F.col("y0"))
    share = bw * bh / F.greatest(F.col("width") * F.col("height"), dlit(1))
    return boxes.filter(share.between(*area) & (bw <= F.col("width") * width) & (bh <= F.col("height") * height))


def context_variants(boxes: DataFrame) -> DataFrame:
    """Three variants per box; ``family`` is the id of the source box."""
    w = F.greatest(F.col("x1") - F.col("x0"), dlit(1))
    h = F.greatest(F.col("y1") - F.col("y0"), dlit(1))

    def variant(name, left, up, right, down) -> Column:
        return F.struct(
            F.lit(name).alias("variant"),
            F.round(F.greatest(dlit(0), F.col("x0") - dlit(left) * w), 2).alias("x0"),
            F.round(F.greatest(dlit(0), F.col("y0") - dlit(up) * h), 2).alias("y0"),
            F.round(F.least(F.col("width"), F.col("x1") + dlit(right) * w), 2).alias("x1"),
            F.round(F.least(F.col("height"), F.col("y1") + dlit(down) * h), 2).alias("y1"),
        )

    rest = [c for c in boxes.columns if c not in BOX]
    out = boxes.withColumn("_v", F.explode(F.array(*[variant(*v) for v in CONTEXT_VARIANTS])))
    return out.select(*rest, F.col("id").alias("family"), "_v.*")


def load_proposals(cache: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached proposals bound to their image by hash: (usable, stale).

    ``score`` stands in for a missing ``detector_score``; rows without box or
    score are dropped; a missing source gets its default.
    """
    joined = cache.join(images.select("image_id", F.col("sha256").alias("_now")), "image_id", "left")
    same = F.col("image_sha256").isNull() | F.col("image_sha256").eqNullSafe(F.col("_now"))
    usable = (
        joined.filter(same)
        .withColumn("detector_score", F.coalesce("detector_score", "score"))
        .fillna({"proposal_source": "cached_automatic_detector"})
        .dropna(subset=[*BOX, "detector_score"])
        .drop("_now", "score")
    )
    return usable, joined.filter(~same).drop("_now")


def best_mask(candidates: DataFrame, keys: Sequence[str], minimum: float = 0.40) -> DataFrame:
    """The best of several masks per item; ``rejection_reason`` marks weak ones.

    Empty masks are ignored only when they are the best ones, as the item then has no region.
    """
    rest = [c for c in candidates.columns if c not in keys]
    best = (
        candidates.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(-F.col("quality"), F.col("mask_no"))).alias("_m"))
        .select(*keys, "_m.*")
        .filter(F.col("mask_area") > 0)
    )
    return best.withColumn(
        "rejection_reason", F.when(F.col("quality") < minimum, F.lit("low_sam_mask_quality"))
    )


def classify(items: DataFrame, threshold: float) -> DataFrame:
    """Threshold split of the classifier score."""
    ok = F.col("classifier_score") >= threshold
    return items.withColumn("decision", F.when(ok, F.lit("building")).otherwise(F.lit("not_building")))


def structure_reason(
    small_area: float = 0.006, small_fill: float = 0.38, awning_aspect: float = 2.4, awning_fill: float = 0.48
) -> Column:
    """Null for a whole building, else why the mask is only a part of one.

    Needs the mask box ``x0…y1``, ``mask_area`` (pixels) and ``mask_share`` (of the image).
    """
    b = box()
    w, h = F.greatest(b[2] - b[0], dlit(1)), F.greatest(b[3] - b[1], dlit(1))
    fill, aspect = F.col("mask_area") / (w * h), w / h
    return F.when(
        (F.col("mask_share") < small_area) & (fill < small_fill),
        F.lit("small_fragment_without_whole_building_support"),
    ).when((aspect > awning_aspect) & (fill < awning_fill), F.lit("shallow_awning_or_canopy"))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Running ``name`` from 0 over the whole table in ``order``: sorted ranges, each numbered where it lies.

    The written numbers hold the range in the upper bits and the row in the lower 33; a range adds the count of
    those before it (one row a range). No task sorts more than its range, however the rows are keyed.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    row = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return ordered.withColumn("_part", part).join(counts, "_part").withColumn(name, row).drop("_part", "_at", "_before")


def renumber(items: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Names ``House_01…`` by top edge, then left edge."""
    ranked = rank_in_group(items, keys, ["y0", "x0", "id"], "_rank")
    return ranked.withColumn("house", F.format_string("House_%02d", F.col("_rank"))).drop("_rank")


def rejection_tally(rejected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rejected.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))
