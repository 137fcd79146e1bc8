"""Projective map between an image quad and a ratio×1 rectangle, in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import dlit

COEFFICIENTS = tuple("abcdefgh")


def with_plane_to_image(df: DataFrame, quad, ratio: Column, prefix: str = "m_") -> DataFrame:
    """Adds the eight coefficients (the ninth is 1) of (u, v) → image; null for degenerate quads.

    ``quad`` lists the images of (0,0), (ratio,0), (ratio,1), (0,1).
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = quad
    dx1, dx2, dx3 = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, dy3 = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    det = dx1 * dy2 - dx2 * dy1
    det = F.when(F.abs(det) >= 1e-12, det)
    g, h = (dx3 * dy2 - dx2 * dy3) / det, (dx1 * dy3 - dx3 * dy1) / det
    df = df.withColumns({prefix + "g0": g, prefix + "h": h})
    g, h = F.col(prefix + "g0"), F.col(prefix + "h")
    return df.withColumns(
        {
            prefix + "a": (x1 - x0 + g * x1) / ratio,
            prefix + "b": x3 - x0 + h * x3,
            prefix + "c": x0,
            prefix + "d": (y1 - y0 + g * y1) / ratio,
            prefix + "e": y3 - y0 + h * y3,
            prefix + "f": y0,
            prefix + "g": g / ratio,
        }
    ).drop(prefix + "g0")


def to_image(u: Column, v: Column, prefix: str = "m_") -> tuple[Column, Column]:
    a, b, c, d, e, f, g, h = (F.col(prefix + n) for n in COEFFICIENTS)
    w = g * u + h * v + 1
    w = F.when(F.abs(w) >= 1e-12, w)
    return (a * u + b * v + c) / w, (d * u + e * v + f) / w


def to_plane(x: Column, y: Column, prefix: str = "m_") -> tuple[Column, Column]:
    """Inverse map by the adjugate matrix."""
    a, b, c, d, e, f, g, h = (F.col(prefix + n) for n in COEFFICIENTS)
    w = (d * h - e * g) * x + (b * g - a * h) * y + (a * e - b * d)
    w = F.when(F.abs(w) >= 1e-12, w)
    u = ((e - f * h) * x + (c * h - b) * y + (b * f - c * e)) / w
    v = ((f * g - d) * x + (a - c * g) * y + (c * d - a * f)) / w
    return u, v


def fit_error(quad, ratio: Column, prefix: str = "m_") -> Column:
    """Largest distance of a mapped corner from its rectangle corner."""
    targets = ((dlit(0), dlit(0)), (ratio, dlit(0)), (ratio, dlit(1)), (dlit(0), dlit(1)))
    errors = []
    for (x, y), (u, v) in zip(quad, targets):
        pu, pv = to_plane(x, y, prefix)
        errors.append(F.hypot(pu - u, pv - v))
    return F.greatest(*errors)


def grid_lines(df: DataFrame, ratio: Column, divisions: int = 4, prefix: str = "m_") -> DataFrame:
    """One row per interior grid line: ``along`` (u or v), ``station``, and its image end points."""
    cross = F.sequence(F.lit(1), F.lit(divisions - 1))
    steps = F.least(F.lit(120), F.ceil(ratio * divisions).cast("int"))
    down = F.when(steps > 1, F.sequence(F.lit(1), F.greatest(steps - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    lines = F.concat(
        F.transform(cross, lambda i: F.struct(F.lit("v").alias("along"), (i / divisions).alias("station"))),
        F.transform(down, lambda i: F.struct(F.lit("u").alias("along"), (i / divisions).alias("station"))),
    )
    df = df.withColumn("_r", ratio).withColumn("_l", F.explode(lines)).filter("_l.along = 'v' or _l.station < _r")
    is_v = F.col("_l.along") == "v"
    start = to_image(F.when(is_v, dlit(0)).otherwise(F.col("_l.station")), F.when(is_v, F.col("_l.station")).otherwise(dlit(0)), prefix)
    end = to_image(F.when(is_v, F.col("_r")).otherwise(F.col("_l.station")), F.when(is_v, F.col("_l.station")).otherwise(dlit(1)), prefix)
    return df.withColumns(
        {"along": F.col("_l.along"), "station": F.col("_l.station"), "ix0": start[0], "iy0": start[1], "ix1": end[0], "iy1": end[1]}
    ).drop("_l", "_r")
