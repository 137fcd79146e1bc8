"""Facing directions from line evidence and grounded vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import circular_difference, clock_label, clock_of_angle
from ..functions.camera import ground_angle
from ..functions.geometry import dlit
from .rules import all_of, duplicates, flagged, row_issues, unknown


def rectified_segments(segments: DataFrame, minimum: float = 10.0) -> DataFrame:
    """Line segments with their ground angle in 15° buckets of [0, 180].

    Needs ``xa, ya, xb, yb, pitch_deg, azimuth_deg``. Short ones go; the others
    point to the near half-plane, or right when level.
    """
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    length = F.hypot(dx, dy)
    df = segments.withColumn("length", length).filter(F.col("length") >= minimum)
    turn = (dy < 0) | ((F.abs(dy) < 1e-6) & (dx < 0))
    df = df.withColumn("_s", F.when(turn, dlit(-1)).otherwise(dlit(1)))
    angle = ground_angle(dx * F.col("_s"), dy * F.col("_s"), F.radians("pitch_deg"), F.radians("azimuth_deg"))
    df = df.withColumn("_angle", angle)
    folded = F.when(F.col("_angle") > 180, F.pmod(F.col("_angle") + 180, dlit(360))).otherwise(F.col("_angle"))
    bucket = F.least(dlit(180), F.greatest(dlit(0), F.bround(folded / 15) * 15))
    swap = (F.col("_s") < 0) != (F.col("_angle") > 180)
    out = df.withColumns(
        {
            "bucket": bucket,
            "lx0": F.when(swap, F.col("xb")).otherwise(F.col("xa")),
            "ly0": F.when(swap, F.col("yb")).otherwise(F.col("ya")),
            "lx1": F.when(swap, F.col("xa")).otherwise(F.col("xb")),
            "ly1": F.when(swap, F.col("ya")).otherwise(F.col("yb")),
        }
    )
    return out.drop("_s", "_angle")


def bucket_support(rectified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total length per bucket and the longest segment in it."""
    return (
        rectified.groupBy(*keys, "bucket")
        .agg(
            F.sum("length").alias("support"),
            F.max_by(F.struct("lx0", "ly0", "lx1", "ly1"), F.struct(F.col("length"), -F.col("seg_id"))).alias("_l"),
        )
        .select(*keys, "bucket", "support", "_l.*")
    )


def directions(items: DataFrame, support: DataFrame, keys: Sequence[str]) -> DataFrame:
    """24 half-hour directions per item with the evidence of their axis.

    Direction and opposite share an axis; 0° also looks at the 180° bucket and
    the better supported one wins.
    """
    keys = list(keys)
    grid = items.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(345), F.lit(15))).alias("step"))
    grid = grid.withColumn("angle", F.col("step").cast("double"))
    axis = F.pmod(F.col("angle"), dlit(180))
    probe = grid.withColumn("bucket", F.explode(F.when(axis == 0, F.array(dlit(0), dlit(180))).otherwise(F.array(axis))))
    best = (
        probe.join(support, [*keys, "bucket"], "left")
        .groupBy(*keys, "step", "angle")
        .agg(F.max_by(F.struct("support", "lx0", "ly0", "lx1", "ly1"), F.struct(F.coalesce("support", dlit(-1)), -F.col("bucket"))).alias("_e"))
        .select(*keys, "step", "angle", "_e.*")
    )
    hour = clock_of_angle(F.col("angle"))
    return best.withColumns(
        {
            "candidate": F.char((F.lit(65) + F.col("step") / 15).cast("int")),
            "clock_hour": hour,
            "clock": clock_label(hour),
            "support": F.round(F.coalesce("support", dlit(0)), 3),
        }
    ).drop("step")


def choose_direction(candidates: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best candidate in the quadrant of the grounded vector.

    ``vectors``: keys, dx, dy (image), pitch_deg, azimuth_deg. Score: support
    relative to the best in the quadrant plus 1.1·cos of the deviation; ties go
    to the smaller deviation, then the larger support.
    """
    keys = list(keys)
    v = vectors.withColumn("top_angle", ground_angle(F.col("dx"), F.col("dy"), F.radians("pitch_deg"), F.radians("azimuth_deg")))
    joined = candidates.join(v.select(*keys, "dx", "dy", "top_angle"), keys)
    rad = F.radians("angle")
    side = F.when(F.col("dx") >= 0, dlit(1)).otherwise(dlit(-1))
    inside = joined.filter((F.cos(rad) * side >= -1e-6) & (F.sin(rad) * F.col("dy") >= -1e-6))
    top = inside.groupBy(*keys).agg(F.max("support").alias("_top"))
    off = circular_difference(F.col("angle"), F.col("top_angle"))
    scored = inside.join(top, keys).withColumn("deviation", off)
    score = F.col("support") / F.greatest(F.col("_top"), dlit(1)) + dlit(1.1) * F.cos(F.radians("deviation"))
    scored = scored.withColumn("score", score)
    return (
        scored.groupBy(*keys)
        .agg(
            F.max_by(
                F.struct("candidate", "angle", "clock", "support", "deviation", "score"),
                F.struct(F.col("score"), -F.col("deviation"), F.col("support"), -F.col("angle")),
            ).alias("_c")
        )
        .select(*keys, "_c.*")
    )


def side_of(angle: Column) -> tuple[Column, Column]:
    """Left/right (null inside the dead band) and near/far of a top-view angle."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    horizontal = F.when(F.abs(c) >= 0.2, F.when(c > 0, "right").otherwise("left"))
    depth = F.when(s > 0.2, "nearer").when(s < -0.2, "farther").otherwise("same_depth")
    return horizontal, depth


def orientation_issues(rows: DataFrame, candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """Orientation answers: known ids once each, valid letter, sides agreeing with the angle.

    ``rows``: doc_id, id, candidate, horizontal, depth. ``candidates``: doc_id, id,
    candidate, angle. Rows of unknown ids are ignored, as extra answers are harmless.

    Candidates meet the answers by house and are told apart there, so that those of one
    house stay together in the shuffle and the answers are dealt out once. They are
    never broadcast: a list made out of the expected ids looks as small as these.
    """
    on = ["doc_id", "id"]
    known = rows.join(expected, on, "left_semi").withColumn(
        "candidate", F.regexp_replace(F.upper(F.trim("candidate")), r"^CANDIDATE\s+", "")
    )
    offered = candidates.select(*(F.col(c).alias("_" + c) for c in [*on, "candidate"]), "angle").hint("merge")
    house = [F.col(c) == F.col("_" + c) for c in on]
    # two bounds instead of an equality, which would become a key of the shuffle
    letter = (F.col("candidate") >= F.col("_candidate")) & (F.col("candidate") <= F.col("_candidate"))
    with_angle = known.join(offered, [*house, letter], "left").drop("_doc_id", "_id", "_candidate")
    h, d = F.lower(F.trim("horizontal")), F.lower(F.trim("depth"))
    want_h, want_d = side_of(F.col("angle"))
    valid = F.col("angle").isNotNull()
    return all_of(
        duplicates(known, "duplicate_orientation", on),
        flagged(with_angle.filter(~valid), "invalid_candidate"),
        row_issues(
            with_angle,
            {
                "invalid_side": ~F.coalesce(h.isin("left", "right"), F.lit(False)),
                "invalid_depth": ~F.coalesce(d.isin("nearer", "same_depth", "farther"), F.lit(False)),
                "side_contradicts": valid & h.isin("left", "right") & want_h.isNotNull() & (h != want_h),
                "depth_contradicts": valid & d.isin("nearer", "same_depth", "farther") & (d != want_d),
            },
        ),
        unknown(expected, rows, on, "omitted", "id"),
    )
