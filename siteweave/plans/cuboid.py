"""Coarse cuboids from image spans: observation, solve, constraints, contract, documents."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.camera import Camera
from ..functions.geometry import dlit
from ..operators.rules import all_of, bad, flagged, not_in, row_issues
from ..operators.spatial import collisions, footprint_in_water
from ..session import cut

CORNER_SOURCE = "vlm_visible_short_end_ground_corners"
FIT_SOURCE = "sam_silhouette_fixed_yaw_ratio_fit"
FALLBACK = "fallback_3_to_1_unresolved_short_end"


def contour_yaw(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Conservative in-plane yaw of the largest outline (by points): second moments, ±45° fold, ±12° clamp.

    The moments are rounded to six digits before the angle is taken: outlines on
    the fold, where both moments agree or the mixed one vanishes, then fall on its
    one side instead of on that of a rounding error.
    """
    largest = polygons.groupBy(*keys).agg(F.max_by("poly", F.struct(F.size("poly"), -F.col("pos"))).alias("_p"))
    p = F.col("_p")
    n = F.size(p)

    def total(f) -> Column:
        return F.aggregate(p, dlit(0), lambda acc, v: acc + f(v))

    df = largest.withColumns({"_cx": total(lambda v: v["x"]) / n, "_cy": total(lambda v: v["y"]) / n})
    cx, cy = F.col("_cx"), F.col("_cy")
    sxx = total(lambda v: (v["x"] - cx) * (v["x"] - cx))
    syy = total(lambda v: (v["y"] - cy) * (v["y"] - cy))
    sxy = total(lambda v: (v["x"] - cx) * (v["y"] - cy))
    # adding zero turns a negative zero, which atan2 tells apart, into zero
    even = lambda moment: F.round(moment, 6) + dlit(0)
    angle = F.degrees(dlit(0.5) * F.atan2(even(2 * sxy), even(sxx - syy)))
    df = df.withColumn("_a", angle)
    a = F.col("_a")
    folded = F.when(a > 45, a - 90).when(a < -45, a + 90).otherwise(a)
    yaw = F.round(F.greatest(dlit(-12), F.least(dlit(12), folded)), 3)
    return df.select(*keys, F.when(n >= 3, yaw).otherwise(dlit(0)).alias("yaw_deg"))


def foot_lines(items: DataFrame, polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inferred ground line of a mask: bottom of its broad parts, completed for roof-only ones.

    ``items``: keys and the mask box; ``polygons``: keys, poly.
    """
    keys = list(keys)
    spans = polygons.filter(F.size("poly") > 0).select(
        *keys,
        (F.array_max(F.transform("poly", lambda p: p["x"])) - F.array_min(F.transform("poly", lambda p: p["x"]))).alias("_w"),
        F.array_max(F.transform("poly", lambda p: p["y"])).alias("_b"),
    )
    width = F.greatest(dlit(1), F.col("x1") - F.col("x0"))
    height = F.greatest(dlit(1), F.col("y1") - F.col("y0"))
    broad = (
        spans.join(items.select(*keys, width.alias("_full")), keys)
        .filter(F.col("_w") >= F.col("_full") * 0.25)
        .groupBy(*keys)
        .agg(F.max("_b").alias("_bottom"))
    )
    b = F.col("_bottom")
    completed = F.when(b < F.col("y1") - height * 0.25, b + height * 0.15).otherwise(b)
    out = items.join(broad, keys, "left")
    return out.withColumn("ground_y", F.when(b.isNull(), F.col("y1")).otherwise(F.least(F.col("y1"), completed))).drop("_bottom")


def observe(items: DataFrame) -> DataFrame:
    """Image measurements of a house and the source of its depth.

    Needs the mask box, ``ground_y``, ``yaw_deg``, the camera, the short-end corner
    pair ``e0x…e1y`` (nullable) with ``corner_confidence``, and the ratio fit
    ``fit_accepted, fit_ratio``.
    """
    cam = Camera()
    visible = F.greatest(dlit(12), F.col("x1") - F.col("x0"))
    tall = F.greatest(dlit(12), F.col("ground_y") - F.col("y0"))
    yaw = F.col("yaw_deg")
    df = items.withColumns(
        {
            "broad_span": F.greatest(cam.width * 0.08, visible * 0.78),
            "wall_height": F.greatest(dlit(12), tall * 0.32),
            "centre_px": (F.col("x0") + F.col("x1")) / 2,
            "centre_py": F.least(cam.height - 1, F.col("ground_y")),
            "_long": cam.long_scale(yaw),
            "_deep": cam.depth_scale(yaw),
        }
    )
    axis = cam.ground_axis(yaw + 90)
    dx, dy = F.col("e1x") - F.col("e0x"), F.col("e1y") - F.col("e0y")
    df = df.withColumn("_length", F.col("broad_span") / F.col("_long"))
    df = df.withColumns(
        {
            "corner_span": F.coalesce(F.abs(dx * axis[0] + dy * axis[1]), dlit(0)),
            "_norm": F.coalesce(F.hypot(dx, dy), dlit(0)),
        }
    )
    inferred = F.col("corner_span") / F.col("_deep")
    df = df.withColumn("detected_ratio", F.when(inferred > 1e-9, F.col("_length") / inferred))
    by_corners = F.coalesce(
        (F.coalesce("corner_confidence", dlit(0)) >= 0.45)
        & (F.col("corner_span") >= F.greatest(dlit(6), visible * 0.04))
        & (F.col("corner_span") / F.greatest(F.col("_norm"), dlit(1e-9)) >= math.cos(math.radians(35)))
        & F.col("detected_ratio").between(1.15, 5.0),
        F.lit(False),
    )
    df = df.withColumn("_corners", by_corners)
    fit = F.coalesce("fit_accepted", F.lit(False))
    source = F.when(F.col("_corners"), CORNER_SOURCE).when(fit, FIT_SOURCE).otherwise(FALLBACK)
    ratio = F.when(F.col("_corners"), F.col("detected_ratio")).when(fit, F.col("fit_ratio")).otherwise(dlit(3))
    df = df.withColumns({"depth_source": source, "solved_ratio": ratio})
    recede = F.when(F.col("_corners"), F.col("corner_span")).otherwise(F.col("_length") / F.col("solved_ratio") * F.col("_deep"))
    return df.withColumn("top_recede", recede).drop("_length", "_norm", "_corners", "_long", "_deep")


def solve(observations: DataFrame) -> DataFrame:
    """World length, depth, height and ground centre of each observation."""
    cam = Camera()
    yaw = F.col("yaw_deg")
    gx, gy = cam.ground(F.col("centre_px"), F.col("centre_py"))
    return observations.withColumns(
        {
            "length": F.col("broad_span") / cam.long_scale(yaw),
            "depth": F.col("top_recede") / cam.depth_scale(yaw),
            "height_world": F.col("wall_height") / cam.height_scale(),
            "cx": gx,
            "cy": gy,
        }
    )


def house_shapes(houses: DataFrame) -> DataFrame:
    """Footprint corners ``c0x…c3y`` of ``cx, cy, length, depth, yaw_deg`` and their bounding box."""
    c, s = F.cos(F.radians("yaw_deg")), F.sin(F.radians("yaw_deg"))
    hl, hd = F.col("length") / 2, F.col("depth") / 2
    cols = {}
    for i, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))):
        cols[f"c{i}x"] = F.col("cx") + a * hl * c - b * hd * s
        cols[f"c{i}y"] = F.col("cy") + a * hl * s + b * hd * c
    out = houses.withColumns(cols)
    return out.withColumns(dict(zip(G.BOX, G.quad_box(G.quad("c")))))


def visible_faces() -> Column:
    """The broad face, one side by the sign of the yaw, and the top."""
    return F.array(F.lit("front"), F.when(F.col("yaw_deg") > 0, "left").otherwise("right"), F.lit("top"))


def projected_faces(houses: DataFrame) -> DataFrame:
    """Image quads of the visible faces: one row per face corner."""
    shapes = house_shapes(houses)
    cam = Camera()
    corners = {"front": (0, 1), "left": (3, 0), "right": (1, 2)}
    rows = []
    for name, (i, j) in corners.items():
        quad = [(i, 0), (j, 0), (j, 1), (i, 1)]
        rows += [(name, k, c, z) for k, (c, z) in enumerate(quad)]
    rows += [("top", k, k, 1) for k in range(4)]
    faces = []
    for name, k, c, z in rows:
        sx, sy = cam.project(F.col(f"c{c}x"), F.col(f"c{c}y"), dlit(z) * F.col("height_world"))
        shown = F.array_contains(visible_faces(), name)
        faces.append(F.when(shown, F.struct(F.lit(name).alias("face"), F.lit(k).alias("corner"), sx.alias("sx"), sy.alias("sy"))))
    out = shapes.withColumn("_f", F.explode(F.array_compact(F.array(*faces))))
    return out.select("scene_id", "id", "_f.*")


def far_to_near(houses: DataFrame) -> DataFrame:
    cam = Camera()
    return houses.withColumn("view_depth", cam.depth(F.col("cx"), F.col("cy"), dlit(0))).orderBy(
        "scene_id", F.col("view_depth").desc(), "id"
    )


def cut_stage(houses: DataFrame) -> DataFrame:
    """Solved houses as a stage table: every check reads columns instead of solving again."""
    return cut(houses)


def water_footprints(waters: DataFrame) -> DataFrame:
    """Normalised water outlines to world polygons; needs the camera columns beside ``poly``."""
    cam = Camera()

    def to_world(p: Column) -> Column:
        gx, gy = cam.ground(p["x"] * cam.width, p["y"] * cam.height)
        return F.struct(gx.alias("x"), gy.alias("y"))

    return waters.withColumn("poly", F.transform("poly", to_world))


def hard_constraints(houses: DataFrame, waters: DataFrame) -> DataFrame:
    """Violations ``doc_id, entity_id, rule`` of solved houses (scene_id as document)."""
    shapes = house_shapes(houses.withColumn("doc_id", F.col("scene_id")))
    own = row_issues(
        shapes.withColumn("_faces", visible_faces()),
        {
            "length_not_above_depth": bad(F.col("length") > F.col("depth")),
            "off_ground": F.abs(F.col("cz")) > 1e-9,
            "front_and_back": F.array_contains("_faces", "front") & F.array_contains("_faces", "back"),
            "left_and_right": F.array_contains("_faces", "left") & F.array_contains("_faces", "right"),
        },
    )
    pairs = collisions(shapes, ("scene_id",), 0.01, unit_axes=True)
    pairs = pairs.select(F.col("scene_id").alias("doc_id"), F.concat_ws("<->", "id_a", "id_b").alias("id"))
    w = waters.withColumnRenamed("scene_id", "plan_id")
    wet = footprint_in_water(shapes.withColumnRenamed("scene_id", "plan_id"), w)
    wet = wet.select(F.col("plan_id").alias("doc_id"), F.concat_ws("<->", "id", "water_id").alias("id"))
    return all_of(own, flagged(pairs, "solid_overlap"), flagged(wet, "footprint_in_water"))


def is_close(a: Column, b: Column, rel: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(dlit(rel) * F.greatest(F.abs(a), F.abs(b)), dlit(absolute))


def contract_issues(houses: DataFrame, metrics: DataFrame) -> DataFrame:
    """Output contract: locked ratio, uniform body scale, audited depth source, agreeing gates.

    ``houses``: doc_id, id, length, depth, solved_ratio, recorded_ratio, body_scale,
    uniform, locked, cz, depth_source, fit_accepted. ``metrics``: doc_id, accepted,
    houses, detected, oriented, violations, silhouette_iou.
    """
    ratio = F.col("length") / F.col("depth")
    return all_of(
        row_issues(
            houses,
            {
                "length_not_above_depth": bad(F.col("length") > F.col("depth")),
                "off_ground": bad(F.col("cz") == 0),
                "not_locked": bad(F.col("locked")),
                "ratio_drifted": bad(is_close(ratio, F.col("solved_ratio"), 1e-9, 1e-9)),
                "ratio_stale": bad(is_close(F.col("recorded_ratio"), ratio, 1e-6, 1e-6)),
                "scale_not_uniform": bad(F.col("uniform")),
                "body_scale": bad((F.col("body_scale") > 0) & (F.col("body_scale") <= 1)),
                "depth_source": not_in("depth_source", (CORNER_SOURCE, FIT_SOURCE, FALLBACK)),
                "rejected_fit_used": (F.col("depth_source") == FIT_SOURCE) & bad(F.col("fit_accepted")),
                "fallback_ratio": (F.col("depth_source") == FALLBACK) & bad(F.abs(F.col("solved_ratio") - 3) <= 1e-9),
            },
        ),
        row_issues(
            metrics.withColumn("id", F.lit("metrics")),
            {
                "not_accepted": bad(F.col("accepted")),
                "detected_count": bad(F.col("detected") == F.col("houses")),
                "oriented_count": bad(F.col("oriented") == F.col("houses")),
                "violations": bad(F.col("violations") == 0),
                "silhouette_iou": bad(F.col("silhouette_iou") >= 0.99),
            },
        ),
    )


def missing_files(required: DataFrame, found: DataFrame) -> DataFrame:
    """``scene_id, name`` of required outputs that are absent or empty."""
    return required.join(found.filter("length > 0").select("scene_id", "name"), ["scene_id", "name"], "left_anti")


def scene_metrics(houses: DataFrame, violations: DataFrame, fits: DataFrame) -> DataFrame:
    """Roll-up per scene: counts, geometry gate (change < 0.16), acceptance (IoU > 0.99, no violations).

    ``fits``: scene_id, change, silhouette_iou.
    """
    h = houses.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("houses"), F.bool_and(F.col("length") > F.col("depth")).alias("length_above_depth")
    )
    v = violations.groupBy(F.col("doc_id").alias("_d")).agg(F.count(F.lit(1)).alias("violations"))
    out = h.join(v, F.col("scene_id").cast("string") == F.col("_d"), "left").drop("_d").join(fits, "scene_id", "left")
    out = out.fillna(0, ["violations"]).withColumn("geometry_gate", F.col("change") < 0.16)
    ok = F.col("geometry_gate") & (F.col("violations") == 0) & (F.col("silhouette_iou") > 0.99)
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def exact_cover(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids on one side only: ``keys, side``."""
    a = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    b = right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    m = a.unionByName(b).groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when(F.col("_l") == 0, "right_only").when(F.col("_r") == 0, "left_only")
    return m.select(*keys, side.alias("side")).filter("side is not null")


def scene_documents(parts: DataFrame, chunk: int = 1000, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Nested documents per scene and kind, cut into parts of about ``chunk`` entries.

    ``parts``: keys, kind, id and further columns. Rows ``keys, kind, part,
    parts, entries`` (JSON array); a scene of any size never becomes one row.
    """
    keys = list(keys)
    sizes = parts.groupBy(*keys, "kind").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    body = [c for c in parts.columns if c not in (*keys, "kind")]
    numbered = parts.join(sizes, [*keys, "kind"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return numbered.groupBy(*keys, "kind", "parts", "part").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(*body)))).alias("entries")
    )


def chosen_ratio(hypotheses: DataFrame, keys: Sequence[str] = ("scene_id", "id"), fallback: float = 3.0) -> DataFrame:
    """Aspect ratio of each house out of a table of tried ones: ``keys, ratio, accepted, best_ratio, best_iou, fallback_iou, gain``.

    ``hypotheses``: keys, ratio, iou, observability (of the depth axis, the same in
    all rows of a house). The best overlap wins, ties go to the ratio nearest
    ``fallback``, then to the smaller one. It is accepted where the depth axis can be
    seen, the overlap is good enough and better than the fallback's by a margin;
    otherwise the fallback stands. A house without a row of the fallback has no gain
    and keeps the fallback.
    """
    order = F.struct("iou", -F.abs(F.col("ratio") - fallback), -F.col("ratio"))
    best = hypotheses.groupBy(*keys).agg(
        F.max_by("ratio", order).alias("best_ratio"),
        F.max("iou").alias("best_iou"),
        F.max(F.when(F.col("ratio") == fallback, F.col("iou"))).alias("fallback_iou"),
        F.max("observability").alias("_seen"),
    )
    gain = F.col("best_iou") - F.col("fallback_iou")
    # fixed values: gates of visibility, overlap and gain
    accepted = F.coalesce((F.col("_seen") >= 0.35) & (F.col("best_iou") >= 0.38) & (gain >= 0.05), F.lit(False))
    return best.withColumns({"gain": gain, "accepted": accepted}).select(
        *keys, F.when(F.col("accepted"), F.col("best_ratio")).otherwise(F.lit(fallback)).alias("ratio"), "accepted", "best_ratio", "best_iou", "fallback_iou", "gain"
    )
