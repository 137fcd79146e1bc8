"""Rule sets as issue rows ``doc_id, entity_id, rule``; no rows means the document passed.

Row rules of one table are evaluated in one pass; set rules (duplicates,
unknown references, coverage) are aggregates and semi/anti joins on the
document id plus the entity, so that no document is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut

# fixed values: the enums of the answer formats
CATEGORIES = ("house", "tree", "mountain", "water", "flat", "other")
REVIEW_STATUS = ("supported", "uncertain")
STRUCTURE_STATUS = ("proposed", "deferred")
FOOTPRINT_KINDS = ("point", "polyline", "polygon", "unknown")
EDGE_STATES = ("visible", "inferred", "unknown")
AUDIT_VERDICTS = ("plausible", "needs_review", "reject")
IDENTITY_STATUS = ("supported", "uncertain")
GROUND_STATUS = ("visible_partial", "occluded", "outside_crop", "uncertain")
SEGMENT_ROLES = ("ground_edge", "occlusion_boundary", "upper_structure", "unknown")
CHECK_VERDICTS = ("usable_hypothesis", "needs_revision", "reject")
BUILDING_CATEGORIES = ("house", "other")
CONFIDENCES = ("high", "medium", "low")
LEVELS = ("low", "middle", "high")
TERRAIN_CATEGORIES = ("mountain", "water", "flat", "other")
ANCHOR_STATUS = ("visible_partial", "inferred", "outside_crop")
DETAIL_STATUS = ("keep", "uncertain", "merge", "reject")
FEATURE_LEVELS = {
    "wall_ground_corner": "ground",
    "column_ground_foot": "ground",
    "plinth_ground_corner": "ground",
    "wall_occluder_contact": "occlusion",
    "upper_floor_corner": "upper",
    "eave_corner": "upper",
    "uncertain_feature": "unknown",
}
INDEPENDENCE = {
    "keep": ("independent",),
    "uncertain": ("independent", "unresolved"),
    "merge": ("shared",),
    "reject": ("nonbuilding",),
}


def bad(condition: Column) -> Column:
    """True where the condition is false or unknown."""
    return ~F.coalesce(condition, F.lit(False))


def not_in(col: str | Column, allowed: Sequence[str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return bad(c.isin(*allowed))


def row_issues(rows: DataFrame, rules: Mapping[str, Column], doc: str = "doc_id", entity: str = "id") -> DataFrame:
    flags = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    return rows.select(
        F.col(doc).cast("string").alias("doc_id"),
        F.col(entity).cast("string").alias("entity_id"),
        F.explode(F.array_compact(flags)).alias("rule"),
    )


def flagged(rows: DataFrame, rule: str, doc: str = "doc_id", entity: str = "id") -> DataFrame:
    """One issue per distinct (document, entity) of the rows."""
    return (
        rows.select(F.col(doc).cast("string").alias("doc_id"), F.col(entity).cast("string").alias("entity_id"))
        .distinct()
        .withColumn("rule", F.lit(rule))
    )


def duplicates(rows: DataFrame, rule: str, on: Sequence[str], entity: str = "id", doc: str = "doc_id") -> DataFrame:
    repeated = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return flagged(repeated, rule, doc, entity)


def unknown(rows: DataFrame, known: DataFrame, on: Sequence[str], rule: str, entity: str, doc: str = "doc_id") -> DataFrame:
    """Rows whose ``on`` columns (same names on both sides) have no partner in ``known``."""
    return flagged(rows.join(known.select(*on), list(on), "left_anti"), rule, doc, entity)


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- exactly-once accounting -------------------------------------------------------------


def accounting(expected: DataFrame, claims: DataFrame, keys: Sequence[str] = ("plan_id", "source_id")) -> DataFrame:
    """Per candidate: how often it is claimed and whether that is right.

    ``status`` is ``ok``, ``missing``, ``repeated`` or ``unexpected``. Both inputs
    are reduced by partial aggregation; there is no join to skew.
    """
    keys = list(keys)
    marks = expected.select(*keys, F.lit(1).alias("want"), F.lit(0).alias("got")).unionByName(
        claims.select(*keys, F.lit(0).alias("want"), F.lit(1).alias("got"))
    )
    counts = marks.groupBy(*keys).agg(F.max("want").alias("want"), F.sum("got").alias("claims"))
    status = (
        F.when(F.col("want") == 0, "unexpected")
        .when(F.col("claims") == 0, "missing")
        .when(F.col("claims") > 1, "repeated")
        .otherwise("ok")
    )
    return counts.select(*keys, "claims", status.alias("status"))


def accounting_issues(expected: DataFrame, claims: DataFrame, doc: str = "plan_id", rule: str = "accounting") -> DataFrame:
    wrong = accounting(expected, claims, (doc, "source_id")).filter("status <> 'ok'")
    return wrong.select(
        F.col(doc).cast("string").alias("doc_id"),
        F.col("source_id").cast("string").alias("entity_id"),
        F.concat(F.lit(rule + "_"), "status").alias("rule"),
    )


# ---- stage rule sets ------------------------------------------------------------------------


def inventory_issues(objects: DataFrame) -> DataFrame:
    """``doc_id, id, category, x0…y1, occluder`` (null: none); booleans already became numbers."""
    b = G.box()
    in_range = (b[0] >= 0) & (b[0] < b[2]) & (b[2] <= 1000) & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= 1000)
    named = objects.select("doc_id", F.col("id").alias("occluder"))
    return all_of(
        row_issues(
            objects,
            {
                "missing_id": bad(F.length("id") > 0),
                "unsupported_category": not_in("category", CATEGORIES),
                "bbox_range": bad(in_range),
            },
        ),
        duplicates(objects, "duplicate_id", ["doc_id", "id"]),
        unknown(objects.filter(F.col("occluder").isNotNull()), named, ["doc_id", "occluder"], "unknown_occluder", "id"),
    )


def review_issues(objects: DataFrame, refs: DataFrame, rejected: DataFrame, sources: DataFrame) -> DataFrame:
    """A source may back several objects; every source is backed or rejected, not both.

    ``objects``: doc_id, id, status. ``refs``: doc_id, id, source_id. ``rejected``
    and ``sources``: doc_id, source_id.
    """
    on = ["doc_id", "source_id"]
    wrong = refs.join(sources, on, "left_anti").select("doc_id", "id").distinct()
    retained = refs.join(wrong, ["doc_id", "id"], "left_anti").select(*on).distinct()
    known = rejected.join(sources, on, "left_semi")
    freed = known.join(retained, on, "left_anti").select(*on)
    return all_of(
        row_issues(objects, {"review_status": not_in("status", REVIEW_STATUS)}),
        flagged(wrong, "invalid_source_ids"),
        unknown(rejected, sources, on, "rejected_unknown", "source_id"),
        duplicates(rejected, "rejected_duplicate", on, "source_id"),
        flagged(known.join(retained, on, "left_semi"), "rejected_retained", entity="source_id"),
        unknown(sources, retained.unionByName(freed), on, "unaccounted_source", "source_id"),
    )


def structure_issues(entries: DataFrame, prior: DataFrame, planes: DataFrame) -> DataFrame:
    """Structure answers against the reviewed objects they must cover exactly.

    ``entries``: doc_id, id, category, status, kind, poly, edge_states (array),
    hidden (count), reference, plane. ``prior``: doc_id, id, category.
    """
    n = F.size("poly")
    count_ok = (
        F.when(F.col("kind") == "point", n == 1)
        .when(F.col("kind") == "polyline", n >= 2)
        .when(F.col("kind") == "polygon", n >= 3)
        .otherwise(n == 0)
    )
    edges = (
        F.when(F.col("kind") == "point", F.lit(1))
        .when(F.col("kind") == "polyline", F.greatest(F.lit(0), n - 1))
        .when(F.col("kind") == "polygon", n)
        .otherwise(F.lit(0))
    )
    first, last = F.try_element_at("poly", F.lit(1)), F.try_element_at("poly", F.lit(-1))
    degenerate = (first == last) | (F.abs(G.shoelace2(F.col("poly"))) < 1e-6)
    states_ok = (F.size("edge_states") == edges) & F.forall("edge_states", lambda s: s.isin(*EDGE_STATES))
    kind_ok = F.coalesce(F.col("kind").isin(*FOOTPRINT_KINDS), F.lit(False))
    points_ok = kind_ok & F.forall("poly", lambda p: G.point_ok(p["x"], p["y"]))
    known = prior.select("doc_id", "id", F.col("category").alias("_was"))
    # named once, used by many rules: the engine keeps shared expressions apart
    checked = entries.join(known, ["doc_id", "id"]).withColumn("_kind", kind_ok)
    checked = checked.withColumn("_points", F.coalesce(points_ok, F.lit(False)))
    kind_ok, points_ok = F.col("_kind"), F.col("_points")
    refs = entries.filter(F.col("reference").isNotNull())
    ids = prior.select("doc_id", F.col("id").alias("reference"))
    plane_ids = planes.select("doc_id", F.col("id").alias("plane"))
    return all_of(
        row_issues(
            checked,
            {
                "category_changed": bad(F.col("category") == F.col("_was")),
                "structure_status": not_in("status", STRUCTURE_STATUS),
                "self_reference": F.coalesce(F.col("reference") == F.col("id"), F.lit(False)),
                "footprint_kind": ~kind_ok,
                "footprint_points": kind_ok & ~points_ok,
                "footprint_count": points_ok & bad(count_ok),
                "degenerate_polygon": points_ok & (F.col("kind") == "polygon") & (n >= 3) & degenerate,
                "edge_provenance": points_ok & bad(states_ok),
                "deferred_geometry": points_ok
                & (F.col("status") == "deferred")
                & ((F.col("kind") != "unknown") | (F.col("hidden") > 0)),
            },
        ),
        unknown(entries, prior, ["doc_id", "id"], "unknown_id", "id"),
        duplicates(entries, "duplicate_id", ["doc_id", "id"]),
        unknown(refs, ids, ["doc_id", "reference"], "unknown_reference", "id"),
        unknown(entries.filter(F.col("plane").isNotNull()), plane_ids, ["doc_id", "plane"], "unknown_plane", "id"),
        duplicates(planes, "duplicate_plane", ["doc_id", "id"]),
        unknown(prior, entries, ["doc_id", "id"], "not_covered", "id"),
    )


def audit_issues(audits: DataFrame, prior: DataFrame) -> DataFrame:
    """``audits``: doc_id, id, verdict, safe; ``prior``: doc_id, id, status, kind."""
    merged = audits.join(prior.select("doc_id", "id", "status", "kind"), ["doc_id", "id"])
    safe = F.coalesce(F.col("safe"), F.lit(False))
    unsafe = safe & (
        bad(F.col("verdict") == "plausible") | (F.col("status") == "deferred") | (F.col("kind") == "unknown")
    )
    return all_of(
        row_issues(
            merged,
            {
                "audit_verdict": not_in("verdict", AUDIT_VERDICTS) | F.col("safe").isNull(),
                "unsafe_projection": F.coalesce(unsafe, F.lit(False)),
            },
        ),
        unknown(audits, prior, ["doc_id", "id"], "unknown_id", "id"),
        duplicates(audits, "duplicate_id", ["doc_id", "id"]),
        unknown(prior, audits, ["doc_id", "id"], "not_covered", "id"),
    )


def landmark_issues(
    instances: DataFrame, sources: DataFrame, rejected: DataFrame, landmarks: DataFrame, segments: DataFrame, expected: DataFrame
) -> DataFrame:
    """Landmark answers: candidates used exactly once, features at their level, edges on ground.

    ``instances``: doc_id, id, identity_status, ground_status. ``sources``: doc_id,
    id, source_id. ``landmarks``: doc_id, instance_id, id, x, y, feature, level.
    ``segments``: doc_id, instance_id, id, src, dst, role.
    """
    level_of = F.create_map(*[F.lit(v) for pair in FEATURE_LEVELS.items() for v in pair])
    on = ["doc_id", "instance_id"]
    # a repeated id is an issue of its own; its greatest level stands for it here
    points = landmarks.groupBy(*on, F.col("id").alias("_p")).agg(F.max("level").alias("_level"))
    with_ends = (
        segments.join(points.withColumnsRenamed({"_p": "src", "_level": "_sl"}), [*on, "src"], "left")
        .join(points.withColumnsRenamed({"_p": "dst", "_level": "_dl"}), [*on, "dst"], "left")
    )
    broken = F.col("_sl").isNull() | F.col("_dl").isNull() | bad(F.col("src") != F.col("dst"))
    claims = sources.select("doc_id", "source_id").unionByName(rejected.select("doc_id", "source_id"))
    return all_of(
        row_issues(
            instances,
            {"instance_status": not_in("identity_status", IDENTITY_STATUS) | not_in("ground_status", GROUND_STATUS)},
        ),
        duplicates(instances, "duplicate_instance", ["doc_id", "id"]),
        unknown(instances, sources, ["doc_id", "id"], "missing_sources", "id"),
        accounting_issues(expected, claims, "doc_id", "candidate"),
        row_issues(
            landmarks,
            {
                "landmark_point": ~G.point_ok(F.col("x"), F.col("y")),
                "feature_level": bad(F.try_element_at(level_of, F.col("feature")) == F.col("level")),
            },
        ),
        duplicates(landmarks, "duplicate_landmark", ["doc_id", "id"]),
        row_issues(
            with_ends,
            {
                "segment_references": broken,
                "segment_role": ~broken & not_in("role", SEGMENT_ROLES),
                "non_ground_edge": ~broken
                & (F.col("role") == "ground_edge")
                & ((F.col("_sl") != "ground") | (F.col("_dl") != "ground")),
            },
        ),
    )


def hypothesis_issues(instances: DataFrame, alternatives: DataFrame, prior: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Footprint hypotheses of an instance.

    ``instances``: doc_id, id, status. ``alternatives``: doc_id, instance_id, id,
    placement, corners ``q0x…q3y`` (null when shape-only), ``v0…v3`` vertex
    states, ``r0…r3`` landmark ids, ``e0…e3`` edge states, ratio_low, ratio_high,
    reference. ``landmarks``: doc_id, instance_id, id, x, y, level.
    """
    on = ["doc_id", "instance_id"]
    q = G.quad("q")
    placed = F.col("q0x").isNotNull()
    shape_only = F.coalesce(F.col("placement") == "shape_only", F.lit(False))
    in_frame = reduce(lambda s, p: s & G.point_ok(*p), q, F.lit(True))
    quad_ok = F.col("placement").isin("anchored", "inferred") & in_frame & G.convex_quad(q)
    quad_ok = F.coalesce(quad_ok, F.lit(False))
    v, e = [F.col(f"v{i}") for i in range(4)], [F.col(f"e{i}") for i in range(4)]
    states_ok = reduce(lambda s, c: s & c.isin("visible", "inferred"), v + e, F.lit(True))
    loose = reduce(
        lambda s, i: s | ((e[i] == "visible") & ((v[i] != "visible") | (v[(i + 1) % 4] != "visible"))), range(4), F.lit(False)
    )
    no_visible = reduce(lambda s, c: s & (c != "visible"), v, F.lit(True))
    name = F.concat_ws("/", "instance_id", "id")
    # the quad test is long and used by many rules: write its result once
    alt = cut(alternatives.withColumns({"_name": name, "_quad": quad_ok}))
    quad_ok = F.col("_quad")
    counts = alternatives.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("instance_id", "id")
    sized = instances.join(counts, ["doc_id", "id"], "left").fillna(0, ["_n"])
    corner = F.posexplode(F.array(*[F.struct(q[i][0].alias("x"), q[i][1].alias("y"), v[i].alias("state"), F.col(f"r{i}").alias("ref")) for i in range(4)]))
    corners = (
        alt.filter(F.col("_quad") & ~shape_only)
        .select(*on, "id", corner.alias("_i", "_c"))
        .select(*on, "id", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), F.col("_c.state").alias("state"), F.col("_c.ref").alias("ref"))
    )
    own = landmarks.select(*on, F.col("id").alias("ref"), F.col("x").alias("_lx"), F.col("y").alias("_ly"), F.col("level").alias("_level"))
    met = corners.join(own, [*on, "ref"], "left")
    displaced = (F.col("state") == "visible") & (
        F.col("_level").isNull() | (F.col("_level") != "ground") | (F.col("_lx") != F.col("x")) | (F.col("_ly") != F.col("y"))
    )
    met = met.withColumn("_name", name)
    ids = prior.select("doc_id", F.col("id").alias("reference"))
    return all_of(
        row_issues(
            sized,
            {
                "proposal_status": (F.col("_n") > 2) | not_in("status", ("proposed", "insufficient")),
                "status_disagrees": (F.col("status") == "proposed") != (F.col("_n") > 0),
            },
        ),
        unknown(instances, prior, ["doc_id", "id"], "unknown_instance", "id"),
        unknown(prior, instances, ["doc_id", "id"], "not_covered", "id"),
        duplicates(alt, "duplicate_alternative", [*on, "id", "_name"], "_name"),
        row_issues(
            alt,
            {
                "ratio_interval": bad((F.col("ratio_low") > 0) & (F.col("ratio_low") <= F.col("ratio_high"))),
                "shape_only_geometry": shape_only & placed,
                "placement_or_quad": ~shape_only & ~quad_ok,
                "vertex_edge_states": ~shape_only & quad_ok & ~states_ok,
                "visible_edge_inferred_end": ~shape_only & quad_ok & loose,
                "anchored_without_visible": quad_ok & (F.col("placement") == "anchored") & no_visible,
            },
            entity="_name",
        ),
        unknown(alt.filter(F.col("reference").isNotNull()), ids, ["doc_id", "reference"], "unknown_reference", "_name"),
        flagged(met.filter(F.col("ref").isNotNull() & F.col("_level").isNull()), "foreign_vertex", entity="_name"),
        flagged(met.filter(displaced), "displaced_visible_vertex", entity="_name"),
    )


def ground_check_issues(decisions: DataFrame, alternatives: DataFrame, echo: bool = True) -> DataFrame:
    """Decisions cover (instance, alternative) exactly; accepted ones echo the corners.

    ``decisions``: doc_id, instance_id, alternative_id, verdict, corners (string),
    consistent (boolean), front (array of int). ``alternatives``: doc_id,
    instance_id, alternative_id, corners, placement.
    """
    on = ["doc_id", "instance_id", "alternative_id"]
    name = F.concat_ws("/", "instance_id", "alternative_id").alias("id")
    d = decisions.select("*", name)
    a = alternatives.select(*on, F.col("corners").alias("_given"), "placement").dropDuplicates(on)
    merged = d.join(a, on)
    front = F.col("front")
    front_bad = front.isNull() | (
        (F.size(front) > 0)
        & (
            (F.size(front) != 2)
            | F.exists(front, lambda i: ~i.between(0, 3))
            | (F.try_element_at(front, F.lit(1)) == F.try_element_at(front, F.lit(2)))
        )
    )
    wanted = F.when(F.col("placement") == "shape_only", F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(1)))
    parts = [
        row_issues(d, {"check_verdict": not_in("verdict", CHECK_VERDICTS)}),
        unknown(d, a, on, "unknown_pair", "id"),
        duplicates(d, "duplicate_pair", [*on, "id"]),
        unknown(alternatives.select("*", name), d, on, "not_decided", "id"),
    ]
    if echo:
        parts.append(
            row_issues(
                merged,
                {
                    "corner_echo": bad(F.col("corners") == F.col("_given")),
                    "order_consistency": F.col("consistent").isNull(),
                    "front_edge": F.coalesce(front_bad, F.lit(False)),
                    "accepted_front_edge": (F.col("verdict") == "usable_hypothesis")
                    & (bad(front == wanted) | bad(F.col("consistent"))),
                },
            )
        )
    return all_of(*parts)


def terrain_issues(elements: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Terrain, zones, trees and routes share one id space.

    ``elements``: doc_id, collection, id, source_poly, plan_poly, level, category,
    axes (array of points). ``boundaries``: doc_id, source_poly, plan_poly.
    """
    area = F.col("collection").isin("terrain", "zones")
    least = F.when(F.col("collection") == "trees", 1).when(F.col("collection") == "routes", 2).otherwise(3)

    def shape(c: str) -> Column:
        return F.coalesce(
            (F.size(c) >= least) & F.forall(c, lambda p: G.point_ok(p["x"], p["y"])), F.lit(False)
        )

    axes_ok = (F.size("axes") == 2) & F.forall("axes", lambda a: F.hypot(a["x"], a["y"]) >= 1e-6)
    zone = F.col("collection") == "zones"
    return all_of(
        row_issues(
            boundaries.withColumn("id", F.lit("scene")),
            {"scene_boundary": ~G.polygon_ok(F.col("source_poly")) | ~G.polygon_ok(F.col("plan_poly"))},
        ),
        duplicates(elements, "duplicate_id", ["doc_id", "id"]),
        row_issues(
            elements,
            {
                "missing_id": F.col("id").isNull(),
                "polygon": ~shape("source_poly") | ~shape("plan_poly"),
                "level": area & not_in("level", LEVELS),
                "category": (F.col("collection") == "terrain") & not_in("category", TERRAIN_CATEGORIES),
                "axes": zone & bad(axes_ok),
            },
        ),
    )


def candidate_issues(candidates: DataFrame) -> DataFrame:
    """Building candidates of a tile: box, anchor ``ax, ay``, quad ``q0x…q3y``, ratio, enums."""
    q = G.quad("q")
    in_frame = reduce(lambda s, p: s & G.point_ok(*p), q, F.lit(True))
    geometry_ok = (
        G.box_ok(G.box())
        & G.point_ok(F.col("ax"), F.col("ay"))
        & in_frame
        & G.convex_quad(q)
        & G.ratio_ok(F.col("ratio_low"), F.col("ratio_high"))
    )
    return all_of(
        row_issues(
            candidates,
            {
                "candidate_geometry": ~geometry_ok,
                "semantic_fields": not_in("category", BUILDING_CATEGORIES) | not_in("anchor_status", ANCHOR_STATUS),
            },
        ),
        duplicates(candidates, "duplicate_id", ["doc_id", "id"]),
    )


def building_rules(lock: bool = False) -> dict[str, Column]:
    """Row rules of a plan building (source box ``sx0…``, anchor ``ax, ay``, quad ``q0x…``)."""
    q = G.quad("q")
    in_frame = reduce(lambda s, p: s & G.point_ok(*p), q, F.lit(True))
    source = G.box_ok(G.box("s")) & G.point_ok(F.col("ax"), F.col("ay")) & in_frame & G.convex_quad(q)
    ratio = G.ratio_ok(F.col("ratio_low"), F.col("ratio_high"))
    size = F.coalesce((F.col("w") > 0) & (F.col("w") < 500) & (F.col("d") > 0) & (F.col("d") < 500), F.lit(False))
    shape = F.col("w") / F.nullif(F.col("d"), F.lit(0.0))
    rules = {
        "category_confidence": not_in("category", BUILDING_CATEGORIES) | not_in("confidence", CONFIDENCES),
        "source_geometry": ~source,
        "plan_or_ratio": ~G.point_ok(F.col("cx"), F.col("cy")) | ~ratio,
        "plan_size": ~size,
        "ratio_outside_interval": size & ratio & ~shape.between(F.col("ratio_low") - 0.01, F.col("ratio_high") + 0.01),
        "facing": bad(F.col("clock").between(0, 12)),
    }
    for name in ("evidence", "assumption", "label", "subtype"):
        rules[f"missing_{name}"] = bad(F.length(name) > 0)
    return rules


def building_issues(buildings: DataFrame, zones: DataFrame | None = None, locks: DataFrame | None = None) -> DataFrame:
    """``zones``: doc_id, zone_id. ``locks``: doc_id, id and locked copies of the observed columns."""
    from ..plans.revision import OBSERVED

    parts = [row_issues(buildings, building_rules()), duplicates(buildings, "duplicate_id", ["doc_id", "id"])]
    if zones is not None:
        parts.append(unknown(buildings, zones, ["doc_id", "zone_id"], "unknown_zone", "id"))
    if locks is not None:
        kept = locks.select("doc_id", "id", *[F.col(c).alias("_" + c) for c in OBSERVED])
        moved = reduce(lambda s, c: s | ~F.col(c).eqNullSafe(F.col("_" + c)), OBSERVED, F.lit(False))
        parts.append(flagged(buildings.join(kept, ["doc_id", "id"]).filter(moved), "locked_observation_changed"))
    return all_of(*parts)


def layout_issues(
    buildings: DataFrame, zones: DataFrame, claims: DataFrame, expected: DataFrame, relations: DataFrame, places: DataFrame
) -> DataFrame:
    """Layout answer: building rules, exactly-once ownership, documented additions, relation ends.

    ``claims``: doc_id, owner (null: rejected), source_id. ``places``: doc_id, id of
    terrain, trees and routes. ``relations``: doc_id, src, dst.
    """
    owned = claims.filter(F.col("owner").isNotNull()).select("doc_id", F.col("owner").alias("id")).distinct()
    unowned = buildings.join(owned, ["doc_id", "id"], "left_anti")
    ids = buildings.select("doc_id", "id")
    zone_ids = zones.select("doc_id", F.col("zone_id").alias("id"))
    targets = ids.unionByName(zone_ids).unionByName(places.select("doc_id", "id"))
    edge = F.concat_ws(">", "src", "dst")
    rel = relations.withColumn("_e", edge)
    lost = rel.join(ids.withColumnRenamed("id", "src"), ["doc_id", "src"], "left_anti").select("doc_id", "_e").unionByName(
        rel.join(targets.withColumnRenamed("id", "dst"), ["doc_id", "dst"], "left_anti").select("doc_id", "_e")
    )
    return all_of(
        building_issues(buildings, zones),
        accounting_issues(expected, claims, "doc_id", "source"),
        flagged(unowned.filter(~F.col("evidence").contains("newly_observed")), "undocumented_addition"),
        flagged(lost, "unknown_relation_end", entity="_e"),
    )


def critique_issues(changes: DataFrame, buildings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Id algebra of a change set: replace known, add unknown, remove known into living targets.

    ``changes``: doc_id, op (replace/add/remove), id, merge_into, owns (count of
    source ids), evidence. ``verdicts``: doc_id, verdict.
    """
    ids = buildings.select("doc_id", "id").distinct()
    part = {op: changes.filter(F.col("op") == op) for op in ("replace", "add", "remove")}
    removed = part["remove"].select("doc_id", "id").distinct()
    replaced = part["replace"].select("doc_id", "id").distinct()
    added = part["add"].select("doc_id", "id").distinct()
    alive = ids.unionByName(replaced).unionByName(added).distinct().join(removed, ["doc_id", "id"], "left_anti")
    merges = part["remove"].filter(F.col("merge_into").isNotNull())
    return all_of(
        row_issues(verdicts.withColumn("id", F.lit("verdict")), {"critique_verdict": not_in("verdict", ("reasonable_approximation", "revise"))}),
        unknown(part["replace"], ids, ["doc_id", "id"], "replace_unknown", "id"),
        duplicates(part["replace"], "replace_repeated", ["doc_id", "id"]),
        flagged(replaced.join(removed, ["doc_id", "id"], "left_semi"), "replace_removed"),
        flagged(added.join(ids.unionByName(replaced), ["doc_id", "id"], "left_semi"), "add_existing"),
        duplicates(part["add"], "add_repeated", ["doc_id", "id"]),
        row_issues(part["add"], {"add_undocumented": (F.col("owns") > 0) | ~F.col("evidence").contains("newly_observed")}),
        unknown(part["remove"], ids, ["doc_id", "id"], "remove_unknown", "id"),
        unknown(merges, alive.withColumnRenamed("id", "merge_into"), ["doc_id", "merge_into"], "merge_target", "id"),
    )


def allowed_pairs(spark) -> DataFrame:
    """The status ⇔ independence matrix as a table of five rows."""
    rows = [(s, i) for s, many in INDEPENDENCE.items() for i in many]
    return spark.createDataFrame(rows, "status string, independence string")


def detail_issues(decisions: DataFrame, missing: DataFrame, expected: DataFrame, identity_audit: bool = True) -> DataFrame:
    """Detail decisions: geometry, identity matrix, reflections, merge targets, exact cover.

    ``decisions``: doc_id, id, status, merge_into, box, anchor ``ax, ay``, quad
    ``q0x…``, ratio, independence, ground_contact, appearance_kind,
    foundation_trace, bbox_reason. ``missing`` has the geometry columns.
    """
    q = G.quad("q")
    in_frame = reduce(lambda s, p: s & G.point_ok(*p), q, F.lit(True))
    geometry = {
        "detail_geometry": ~(
            G.box_ok(G.box()) & G.point_ok(F.col("ax"), F.col("ay")) & in_frame & G.convex_quad(q)
            & G.ratio_ok(F.col("ratio_low"), F.col("ratio_high"))
        )
    }
    retained = decisions.filter(F.col("status").isin("keep", "uncertain")).select("doc_id", F.col("id").alias("merge_into")).distinct()
    merges = decisions.filter("status = 'merge'")
    rules = {**geometry, "detail_verdict": not_in("status", DETAIL_STATUS)}
    parts = []
    if identity_audit:
        kind = F.col("appearance_kind")
        for name in ("foundation_trace", "bbox_reason"):
            rules[f"missing_{name}"] = bad(F.length(F.trim(name)) > 0)
        rules |= {
            "ground_contact": not_in("ground_contact", ("visible_partial", "inferred")),
            "appearance_kind": kind.isNotNull() & not_in(kind, ("physical", "reflection", "unclear")),
            "reflection_owns": F.coalesce(
                (kind == "reflection") & (bad(F.col("status") == "reject") | F.col("merge_into").isNotNull()), F.lit(False)
            ),
            "unconfirmed_physical": kind.isNotNull() & (F.col("status") == "keep") & bad(kind == "physical"),
        }
        matrix = F.broadcast(allowed_pairs(decisions.sparkSession))  # five fixed rows
        parts.append(
            flagged(decisions.join(matrix, ["status", "independence"], "left_anti"), "inconsistent_identity")
        )
    # a null target is as wrong as an unknown one; the anti join keeps it
    return all_of(
        row_issues(decisions, rules),
        row_issues(missing, geometry),
        unknown(merges, retained, ["doc_id", "merge_into"], "merge_target", "id"),
        accounting_issues(
            expected.select("doc_id", F.col("id").alias("source_id")),
            decisions.select("doc_id", F.col("id").alias("source_id")),
            "doc_id",
            "decision",
        ),
        *parts,
    )


def assignment_issues(assignments: DataFrame, expected: DataFrame, buildings: DataFrame) -> DataFrame:
    """``assignments``: doc_id, source_id, target (null: rejected)."""
    owned = assignments.filter(F.col("target").isNotNull())
    ids = buildings.select("doc_id", F.col("id").alias("target"))
    return all_of(
        unknown(owned, ids, ["doc_id", "target"], "unknown_target", "source_id"),
        accounting_issues(expected, assignments, "doc_id", "assignment"),
    )


def final_check_issues(checks: DataFrame, facts: DataFrame) -> DataFrame:
    """``checks``: doc_id, verdict, blockers (count), regions, pending; ``facts``: doc_id, regions, pending."""
    now = facts.select("doc_id", F.col("regions").alias("_r"), F.col("pending").alias("_p"))
    merged = checks.join(now, "doc_id", "left").fillna(0, ["_r", "_p"]).withColumn("id", F.lit("check"))
    return row_issues(
        merged,
        {
            "final_verdict": not_in("verdict", ("ready_for_confirmation", "needs_revision")),
            "ready_with_blockers": (F.col("verdict") == "ready_for_confirmation") & (F.col("blockers") > 0),
            "stale_regions": ~F.col("regions").eqNullSafe(F.col("_r")),
            "stale_pending": ~F.col("pending").eqNullSafe(F.col("_p")),
        },
    )


def pending_issues(pending: DataFrame, buildings: DataFrame) -> DataFrame:
    """Pending candidates are markers: no area, no sources, own ids, texts present."""
    ids = buildings.select("doc_id", "id").distinct()
    rules = {
        "pending_geometry": ~(G.box_ok(G.box()) & G.point_ok(F.col("mx"), F.col("my"))),
        "claims_foundation": bad(F.col("candidate_only")) | bad(~F.col("marker_is_foundation")),
        "owns_area": F.col("plan_size").isNotNull() | F.col("source_ids").isNotNull() | F.col("zone_id").isNotNull(),
    }
    for name in ("label", "evidence", "uncertainty", "source_run"):
        rules[f"missing_{name}"] = bad(F.length(name) > 0)
    return all_of(
        row_issues(pending, rules),
        flagged(pending.join(ids, ["doc_id", "id"], "left_semi"), "pending_is_building"),
        duplicates(pending, "duplicate_pending", ["doc_id", "id"]),
    )


def shape_diagnostics(entries: DataFrame) -> DataFrame:
    """Wrong corner counts and ratios outside the declared interval, for a correction request."""
    wrong = entries.filter(F.col("corners") != 4).select(
        "doc_id", "id", F.lit("corner_count").alias("kind"), F.col("corners").cast("double").alias("actual")
    )
    shape = F.col("w") / F.nullif(F.col("d"), F.lit(0.0))
    outside = entries.filter((F.col("d") > 0) & ~shape.between(F.col("ratio_low"), F.col("ratio_high"))).select(
        "doc_id", "id", F.lit("ratio").alias("kind"), shape.alias("actual")
    )
    return wrong.unionByName(outside)


def issue_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Issues under former and present rules side by side: ``was``, ``now``."""
    on = ["doc_id", "entity_id", "rule"]
    marks = old.select(*on, F.lit(True).alias("was"), F.lit(False).alias("now")).unionByName(
        new.select(*on, F.lit(False).alias("was"), F.lit(True).alias("now"))
    )
    return marks.groupBy(*on).agg(F.bool_or("was").alias("was"), F.bool_or("now").alias("now"))


def issue_counts(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """Issues per document; documents without any count 0."""
    n = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("issues"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(n, "doc_id", "left").fillna(0, ["issues"])
