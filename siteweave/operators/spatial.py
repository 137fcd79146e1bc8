"""Footprints against each other, zones, water and the boundary of their plan.

Buildings: ``plan_id, id, cx, cy, w, d, clock``; polygons: ``poly`` columns.
Every join is an equi join on the plan with a geometric residual; footprint
pairs go through the spread pair join on their bounding boxes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut
from .cover import inside_polygons
from .overlap import PAIR_LIMIT, box_pairs
from .ranking import running_total, spread_join

CORNERS = [f"c{i}{a}" for i in range(4) for a in "xy"]


def footprints(buildings: DataFrame) -> DataFrame:
    """Corners ``c0x…c3y`` and the bounding box ``x0…y1`` of each footprint."""
    df = G.with_rect_corners(buildings)
    return df.withColumns(dict(zip(G.BOX, G.quad_box(G.quad("c")))))


def collisions(
    shapes: DataFrame,
    keys: Sequence[str] = ("plan_id",),
    tolerance: float = 1e-6,
    unit_axes: bool = False,
    limit: int = PAIR_LIMIT,
) -> DataFrame:
    """Pairs of footprints (output of :func:`footprints`) that overlap: ``keys, id_a, id_b``.

    A negative tolerance asks for clearance, so the boxes are grown by it first.
    """
    slim = shapes.select(*keys, "id", *CORNERS, *G.BOX)
    if tolerance < 0:
        slim = slim.withColumns(
            {c: F.col(c) + (tolerance if c.endswith("0") else -tolerance) for c in G.BOX}
        )
    hit = G.quads_overlap(G.quad("c", "a"), G.quad("c", "b"), tolerance, unit_axes, rectangles=True)
    return box_pairs(slim, keys=keys, condition=hit, limit=limit).select(
        *[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")
    )


def corner_inside(edges: Column, corners: str = "c") -> list[Column]:
    return [G.contains_edges(x, y, edges) for x, y in G.quad(corners)]


def zone_checks(shapes: DataFrame, zones: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """Support-zone and boundary findings: ``plan_id, id, kind, other, corners, severity``.

    ``zones``: plan_id, zone_id, poly. ``boundaries``: plan_id, poly.
    """
    z = shapes.join(zones.select("plan_id", "zone_id", G.polygon_edges(F.col("poly")).alias("_edges")), ["plan_id", "zone_id"])
    outside = reduce(lambda s, c: s + (~c).cast("int"), corner_inside(F.col("_edges")), F.lit(0))
    z = z.withColumns({"_out": outside, "_centre": G.contains_edges(F.col("cx"), F.col("cy"), F.col("_edges"))})
    finding = F.array_compact(
        F.array(
            F.when(~F.col("_centre"), F.struct(F.lit("center_outside_support_zone").alias("kind"), F.lit(None).cast("int").alias("corners"), F.lit("major").alias("severity"))),
            F.when(F.col("_out") > 0, F.struct(F.lit("corners_outside_support_zone").alias("kind"), F.col("_out").alias("corners"), F.lit("minor").alias("severity"))),
        )
    )
    out = z.select("plan_id", "id", F.col("zone_id").alias("other"), F.explode(finding).alias("_f")).select(
        "plan_id", "id", "_f.kind", "other", "_f.corners", "_f.severity"
    )
    if boundaries is None:
        return out
    b = shapes.join(boundaries.select("plan_id", G.polygon_edges(F.col("poly")).alias("_edges")), "plan_id")
    crossing = reduce(lambda s, c: s | ~c, corner_inside(F.col("_edges")), F.lit(False))
    edge = b.filter(crossing).select(
        "plan_id", "id", F.lit("outside_plan_boundary").alias("kind"), F.lit(None).cast("string").alias("other"),
        F.lit(None).cast("int").alias("corners"), F.lit("major").alias("severity"),
    )
    return out.unionByName(edge)


def water_hits(buildings: DataFrame, waters: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """Building centres inside a water area: ``plan_id, id, water_id``."""
    centres = buildings.select("plan_id", "id", "cx", "cy")
    return inside_polygons(centres, waters.select("plan_id", "water_id", "poly"), [("cx", "cy")], limit=limit).select("plan_id", "id", "water_id")


def footprint_in_water(shapes: DataFrame, waters: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """Footprints with any corner inside a water area."""
    corners = [(f"c{i}x", f"c{i}y") for i in range(4)]
    found = inside_polygons(shapes.select("plan_id", "id", *CORNERS), waters.select("plan_id", "water_id", "poly"), corners, limit=limit)
    return found.select("plan_id", "id", "water_id")


def geometry_checks(
    buildings: DataFrame, zones: DataFrame, waters: DataFrame, boundaries: DataFrame
) -> DataFrame:
    """All findings of a plan: ``plan_id, id, kind, other, corners, severity``."""
    shapes = footprints(buildings)
    none = F.lit(None).cast("int")
    pairs = collisions(shapes).select(
        "plan_id", F.col("id_a").alias("id"), F.lit("building_overlap").alias("kind"),
        F.col("id_b").cast("string").alias("other"), none.alias("corners"), F.lit("major").alias("severity"),
    )
    wet = water_hits(buildings, waters).select(
        "plan_id", "id", F.lit("center_in_water").alias("kind"), F.col("water_id").alias("other"),
        none.alias("corners"), F.lit("major").alias("severity"),
    )
    return pairs.unionByName(zone_checks(shapes, zones, boundaries)).unionByName(wet)


def z_order(df: DataFrame, x: Column, y: Column, into: str) -> DataFrame:
    """Adds ``into``: the Morton code of two whole numbers below 2**31, spread bit by bit in five steps."""
    df = df.withColumns({"_bx": x.cast("long"), "_by": y.cast("long")})
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        df = df.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask)) for c in ("_bx", "_by")})
    return df.withColumn(into, F.col("_bx").bitwiseOR(F.shiftleft("_by", 1))).drop("_bx", "_by")


def on_curve(df: DataFrame) -> DataFrame:
    """Adds ``_code, _fine``: the place of ``x, y`` on the Z-order curve over the frame ``_x, _y, _edge``.

    62 bits an axis, more than a double has: one far anchor leaves the others apart.
    """
    unit = lambda v, low: F.least(F.greatest((F.col(v) - F.col(low)) / F.col("_edge"), G.dlit(0)), G.dlit(2**31 - 1))
    df = df.withColumns({"_ux": unit("x", "_x"), "_uy": unit("y", "_y")})
    df = z_order(df, F.floor("_ux"), F.floor("_uy"), "_code")
    rest = lambda u: F.floor((F.col(u) - F.floor(u)) * 2**31)
    return z_order(df, rest("_ux"), rest("_uy"), "_fine").drop("_ux", "_uy", "_x", "_y", "_edge")


def nearest_in_plan(points: DataFrame, anchors: DataFrame, leaf: int = 64, fanout: int = 16) -> DataFrame:
    """Nearest anchor of the same plan for each point: ``plan_id, id, nearest, distance``; ties by smaller id.

    ``points``/``anchors``: plan_id, id, ax, ay. A tree adapts to the anchors of each
    plan: along a Z-order curve, runs of ``leaf`` anchors are leaves, runs of
    ``fanout`` leaves nodes, and so on; each knows the box of its anchors. So leaves
    are small where anchors are dense, and a far anchor makes no empty squares.

    A point is placed on the same curve; the anchors of the leaf there give a first
    bound. From the root down, a point goes on to the nodes whose box is not beyond
    its bound, and the farthest point of a box lowers the bound, before it meets the
    anchors of the leaves that are left. The bounds are exact, so nothing is missed.
    Numbers on the curve come from sorted ranges; a plan, node or leaf with very many
    points is dealt out over parts.
    """
    where = points.select("plan_id", F.col("id").alias("point"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(0).alias("one"))
    there = anchors.select("plan_id", F.col("id").alias("nearest"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(1).alias("one"))
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), G.dlit(1e-6))
    frames = cut(there.groupBy("plan_id").agg(F.min("x").alias("_x"), F.min("y").alias("_y"), (extent / (2**31 - 1)).alias("_edge"), F.count(F.lit(1)).alias("_n")))
    both = where.unionByName(there, allowMissingColumns=True).join(frames, "plan_id")
    placed = running_total(on_curve(both), ["plan_id", "_code", "_fine"], "one", ["plan_id"], "before")
    own = F.expr(f"least(before, _n - 1) div {leaf}")
    placed = cut(placed.select("plan_id", "point", "nearest", "x", "y", own.alias("node")))
    held = placed.filter("nearest is not null").select("plan_id", "node", "nearest", F.col("x").alias("ax"), F.col("y").alias("ay"))
    asked = placed.filter("point is not null").select("plan_id", "point", F.col("x").alias("px"), F.col("y").alias("py"), "node")
    asked = asked.withColumn("_row", F.monotonically_increasing_id())

    distance = F.hypot(F.col("ax") - F.col("px"), F.col("ay") - F.col("py"))
    best = F.min(F.struct(distance.alias("distance"), "nearest")).alias("best")
    point = ["plan_id", "point", "_row", "px", "py"]
    first = spread_join(asked, held, ["plan_id", "node"]).groupBy(*point).agg(best)
    most = -(-(frames.agg(F.max("_n")).first()[0] or 1) // leaf)
    if most > 1:
        boxes = held.groupBy("plan_id", "node").agg(*(f(f"a{c}").alias(f"{c}{k}") for k, f in ((0, F.min), (1, F.max)) for c in "xy"))
        levels = [cut(boxes)]
        while most > 1:
            up = levels[-1].withColumn("node", F.expr(f"node div {fanout}"))
            levels.append(cut(up.groupBy("plan_id", "node").agg(*(f(f"{c}{k}").alias(f"{c}{k}") for k, f in ((0, F.min), (1, F.max)) for c in "xy"))))
            most = -(-most // fanout)
        reached = cut(first.select(*point, F.col("best.distance").alias("bound"), F.lit(0).cast("long").alias("node")))
        for children in reversed(levels[:-1]):
            reached = cut(_next_level(reached, children, point, fanout))
        first = spread_join(reached.drop("bound"), held, ["plan_id", "node"]).groupBy(*point).agg(best)
    return first.select("plan_id", F.col("point").alias("id"), "best.nearest", "best.distance")


def _next_level(reached: DataFrame, children: DataFrame, point: list[str], fanout: int) -> DataFrame:
    """For each point the children of its nodes that can hold its nearest anchor."""
    met = spread_join(reached, children.withColumnRenamed("node", "_child").withColumn("node", F.expr(f"_child div {fanout}")), ["plan_id", "node"])
    px, py, zero = F.col("px"), F.col("py"), G.dlit(0)
    low = F.hypot(F.greatest(F.col("x0") - px, px - F.col("x1"), zero), F.greatest(F.col("y0") - py, py - F.col("y1"), zero))
    high = F.hypot(F.greatest(F.abs(F.col("x0") - px), F.abs(F.col("x1") - px)), F.greatest(F.abs(F.col("y0") - py), F.abs(F.col("y1") - py)))
    # a box's edge may be one rounding error off the distance to an anchor on it
    slack = 1 + 1e-12
    met = met.withColumns({"_low": low, "_high": high}).filter(F.col("_low") <= F.col("bound") * slack)
    bound = F.least("bound", F.min("_high").over(W.partitionBy(*point)))
    return met.withColumn("bound", bound).filter(F.col("_low") <= F.col("bound") * slack).select(*point, "bound", F.col("_child").alias("node"))


def content_bounds(parts: Sequence[DataFrame], margin: float = 24) -> DataFrame:
    """Frame around all points ``plan_id, x, y`` of a plan."""
    points = reduce(lambda a, b: a.unionByName(b), [p.select("plan_id", "x", "y") for p in parts])
    return points.groupBy("plan_id").agg(
        (F.min("x") - margin).alias("x0"),
        (F.min("y") - margin).alias("y0"),
        (F.max("x") + margin).alias("x1"),
        (F.max("y") + margin).alias("y1"),
    )
