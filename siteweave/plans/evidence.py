"""Reviewed evidence applied to plans: identity, shape, missing candidates, lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.spatial import nearest_in_plan
from ..session import cut
from .revision import OBSERVED, move_ownership

KEEP = ("keep", "uncertain")


def load_evidence(
    decisions: DataFrame, runs: DataFrame, plans: DataFrame, selection: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(usable decisions, refused ones with a reason).

    ``decisions``: plan_id, run_id, id. ``runs``: run_id, complete (accepted and
    valid), crop, meta_crop, source_sha256, plan_sha256. ``plans``: plan_id,
    source_sha256, plan_sha256. ``selection``: run_id, id pairs to use; without
    it all decisions of a run count. A run whose selection names an id twice or one
    that it has not decided is refused with all its decisions. A plan id decided
    twice is ambiguous.
    """
    wrong = None
    if selection is not None:
        wrong = selection_issues(selection, decisions.select("run_id", "id").distinct(), ["run_id"]).select("run_id").distinct().withColumn("_wrong", F.lit(True))
        chosen = selection.select("run_id", "id").distinct().withColumn("_chosen", F.lit(True))
        marked = decisions.join(chosen, ["run_id", "id"], "left").join(wrong, "run_id", "left")
        # written, because the repeats are counted over the same rows
        marked = cut(marked.filter("_chosen or _wrong").select(*decisions.columns, "_wrong"))
        decisions, wrong = marked.drop("_wrong"), marked
    r = runs.select(
        "run_id", "complete", F.col("crop").alias("_crop"), F.col("meta_crop").alias("_meta"),
        F.col("source_sha256").alias("_source"), F.col("plan_sha256").alias("_plan"),
    )
    joined = (decisions.withColumn("_wrong", F.lit(None).cast("boolean")) if wrong is None else wrong).join(r, "run_id", "left").join(
        plans.select("plan_id", "source_sha256", "plan_sha256"), "plan_id", "left"
    )
    repeats = decisions.groupBy("plan_id", "id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    joined = joined.join(repeats, ["plan_id", "id"], "left")
    reason = (
        F.when(F.col("_wrong"), "invalid_selection")
        .when(~F.coalesce("complete", F.lit(False)), "incomplete_run")
        .when(~F.coalesce(F.col("_source") == F.col("source_sha256"), F.lit(False)), "source_changed")
        .when(~F.coalesce(F.col("_plan") == F.col("plan_sha256"), F.lit(False)), "other_snapshot")
        .when(~F.coalesce(F.col("_crop") == F.col("_meta"), F.lit(False)), "crop_differs")
        .when(F.col("_n").isNotNull(), "ambiguous")
    )
    judged = joined.withColumn("reason", reason)
    columns = decisions.columns
    return judged.filter("reason is null").select(*columns), judged.filter("reason is not null").select(*columns, "reason")


def selection_issues(selected: DataFrame, known: DataFrame, keys: Sequence[str] = ("plan_id",)) -> DataFrame:
    """``keys, id, rule``: ids chosen more than once, and ids that do not exist.

    A choice with an issue must not be worked on; nothing is dropped in silence.
    """
    keys = list(keys)
    ids = selected.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = ids.filter("_n > 1").select(*keys, "id", F.lit("repeated_selection").alias("rule"))
    unknown = ids.join(known.select(*keys, "id"), [*keys, "id"], "left_anti")
    return repeated.unionByName(unknown.select(*keys, "id", F.lit("unknown_selection").alias("rule")))


def box_moved(audited: DataFrame, known: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Audited boxes that differ from the plan's box by more than the tolerance."""
    k = known.select("plan_id", "id", *[F.col("s" + c).alias("_" + c) for c in G.BOX])
    near = F.lit(True)
    for c in G.BOX:
        near = near & (F.abs(F.col(c) - F.col("_" + c)) <= tolerance)
    return audited.join(k, ["plan_id", "id"]).filter(~near).select("plan_id", "id")


def corner_mean(q) -> tuple[Column, Column]:
    return tuple(F.round((q[0][i] + q[1][i] + q[2][i] + q[3][i]) / 4, 3) for i in (0, 1))


def apply_identity(
    buildings: DataFrame, claims: DataFrame, evidence: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new buildings, new claims, refused merges).

    Keep and uncertain overwrite the observed columns, set the confidence and
    lock them; an anchor outside its own footprint becomes the mean of the
    corners. A physical building of unresolved independence is a group. Merge
    and reject remove the building and move its sources; a merge target must be
    reviewed and alive. Evidence never adds a building.
    """
    keys = ["plan_id", "id"]
    cols = [*OBSERVED, "category", "clock"]
    ev = evidence.select(
        *keys, "status", "merge_into", "independence", "appearance_kind", *[F.col(c).alias("_" + c) for c in cols]
    )
    alive = evidence.filter(F.col("status").isin(*KEEP)).select("plan_id", F.col("id").alias("merge_into"))
    removed = evidence.filter(F.col("status").isin("merge", "reject")).select(*keys, "status", "merge_into")
    refused = removed.filter("status = 'merge'").join(alive, ["plan_id", "merge_into"], "left_anti").select(*keys)
    moves = (
        removed.join(refused, keys, "left_anti")
        .withColumn("target", F.when(F.col("status") == "merge", F.col("merge_into")))
        .select(*keys, "target")
    )
    kept = buildings.join(moves, keys, "left_anti").join(
        ev.filter(F.col("status").isin(*KEEP)), keys, "left"
    )
    hit = F.col("status").isNotNull()
    out = kept.withColumns({c: F.when(hit, F.col("_" + c)).otherwise(F.col(c)) for c in cols})
    q = G.quad("q")
    floating = hit & ~G.contains(F.col("ax"), F.col("ay"), G.polygon_of(q))
    mean = corner_mean(q)
    out = out.withColumn("_float", floating)
    out = out.withColumns(
        {
            "reported_ax": F.when(F.col("_float"), F.col("ax")),
            "reported_ay": F.when(F.col("_float"), F.col("ay")),
            "ax": F.when(F.col("_float"), mean[0]).otherwise(F.col("ax")),
            "ay": F.when(F.col("_float"), mean[1]).otherwise(F.col("ay")),
            "confidence": F.when(F.col("status") == "uncertain", "low").when(hit, "medium").otherwise(F.col("confidence")),
            "grouped": F.col("grouped")
            | F.coalesce(hit & (F.col("appearance_kind") == "physical") & (F.col("independence") == "unresolved"), F.lit(False)),
            "locked": hit,
        }
    )
    extra = ["reported_ax", "reported_ay", "locked"]
    return out.select(*buildings.columns, *extra), move_ownership(claims, moves), refused


def constrain_shapes(buildings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Depth follows the independently observed ratio interval; width is kept.

    Adds ``shape_changed``. Grouped envelopes and buildings without kept evidence stay.
    """
    ev = evidence.filter(F.col("status").isin(*KEEP)).select(
        "plan_id", "id", F.col("ratio_low").alias("_low"), F.col("ratio_high").alias("_high")
    )
    joined = buildings.join(ev, ["plan_id", "id"], "left")
    use = F.col("_low").isNotNull() & ~F.coalesce("grouped", F.lit(False))
    shape = F.col("w") / F.nullif(F.col("d"), G.dlit(0))
    outside = use & ~F.coalesce(shape.between(F.col("_low"), F.col("_high")), F.lit(False))
    depth = F.round(F.col("w") / ((F.col("_low") + F.col("_high")) / 2), 4)
    changed = outside | (use & ((F.col("ratio_low") != F.col("_low")) | (F.col("ratio_high") != F.col("_high"))))
    return joined.withColumns(
        {
            "shape_changed": changed,
            "d": F.when(outside, depth).otherwise(F.col("d")),
            "ratio_low": F.when(use, F.col("_low")).otherwise(F.col("ratio_low")),
            "ratio_high": F.when(use, F.col("_high")).otherwise(F.col("ratio_high")),
        }
    ).drop("_low", "_high")


def single_observation(requests: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests matched by exactly one missing observation, ambiguous or empty ones)."""
    on = ["plan_id", "run_id", "missing_id"]
    n = observations.groupBy(*on).agg(F.count(F.lit(1)).alias("matches"))
    marked = requests.join(n, on, "left").fillna(0, ["matches"])
    one = marked.filter("matches = 1").drop("matches").join(observations, on)
    return one, marked.filter("matches <> 1")


def stage_missing(candidates: DataFrame) -> DataFrame:
    """Provisional records of missing observations; marked as review-only, so never published."""
    return candidates.withColumns(
        {
            "review_only": F.lit(True),
            "confidence": F.lit("low"),
            "w": G.dlit(10),
            "d": G.dlit(10),
            "ratio_low": G.dlit(1),
            "ratio_high": G.dlit(1),
        }
    )


def placed(candidates: DataFrame, buildings: DataFrame, limit: float = 50) -> DataFrame:
    """Plan position of candidates: their source point shifted like the nearest building.

    Adds ``nearest, shift_x, shift_y, cx, cy``. A shift beyond ``limit`` is dropped.
    """
    near = nearest_in_plan(candidates, buildings).select("plan_id", "id", "nearest")
    ref = buildings.select(
        "plan_id", F.col("id").alias("nearest"), (F.col("cx") - F.col("ax")).alias("_dx"), (F.col("cy") - F.col("ay")).alias("_dy")
    )
    joined = candidates.join(near, ["plan_id", "id"]).join(ref, ["plan_id", "nearest"])
    far = F.hypot("_dx", "_dy") > limit
    out = joined.withColumns(
        {
            "shift_x": F.when(far, G.dlit(0)).otherwise(F.col("_dx")),
            "shift_y": F.when(far, G.dlit(0)).otherwise(F.col("_dy")),
        }
    ).drop("_dx", "_dy")
    return out.withColumns(
        {"cx": F.round(F.col("ax") + F.col("shift_x"), 3), "cy": F.round(F.col("ay") + F.col("shift_y"), 3)}
    )


def promote(evidence: DataFrame, buildings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(promoted buildings, their support zones) from candidates confirmed as physical.

    Width is the larger image span of the footprint, depth comes from the middle
    of the ratio interval; the zone is an envelope of the footprint.
    """
    confirmed = evidence.filter((F.col("status") == "keep") & (F.col("appearance_kind") == "physical"))
    at = placed(confirmed, buildings)
    box = G.quad_box(G.quad("q"))
    width = F.greatest(box[2] - box[0], box[3] - box[1])
    out = at.withColumns(
        {
            "w": F.round(width, 3),
            "d": F.round(width / ((F.col("ratio_low") + F.col("ratio_high")) / 2), 3),
            "zone_id": F.concat(F.lit("Z_"), F.col("id").cast("string")),
            "confidence": F.lit("low"),
        }
    )
    shapes = G.with_rect_corners(out)

    def envelope(b, pad: float) -> list[Column]:
        return [
            F.greatest(G.dlit(0), b[0] - pad), F.greatest(G.dlit(0), b[1] - pad),
            F.least(G.dlit(1000), b[2] + pad), F.least(G.dlit(1000), b[3] + pad),
        ]

    src, plan = envelope(box, 4), envelope(G.quad_box(G.quad("c")), 10)
    zones = shapes.select(
        "plan_id", "zone_id", F.lit("middle").alias("level"),
        *[c.alias("src_" + n) for c, n in zip(src, G.BOX)], *[c.alias("plan_" + n) for c, n in zip(plan, G.BOX)],
        (F.col("q1x") - F.col("q0x")).alias("axis1_x"), (F.col("q1y") - F.col("q0y")).alias("axis1_y"),
        (F.col("q3x") - F.col("q0x")).alias("axis2_x"), (F.col("q3y") - F.col("q0y")).alias("axis2_y"),
    )
    return out, zones


def record_pending(evidence: DataFrame, buildings: DataFrame) -> DataFrame:
    """Unresolved candidates as markers without any area, at the shifted corner mean."""
    open_ = evidence.filter(F.col("status") == "uncertain")
    q = G.quad("q")
    centre = [(q[0][i] + q[1][i] + q[2][i] + q[3][i]) / 4 for i in (0, 1)]
    at = placed(open_.withColumns({"ax": centre[0], "ay": centre[1]}), buildings)
    return at.select(
        "plan_id", "id", F.col("cx").alias("mx"), F.col("cy").alias("my"), F.lit(True).alias("candidate_only"),
        F.lit(False).alias("marker_is_foundation"),
    )


def audit_changes(audits: DataFrame) -> DataFrame:
    """Flat view of nested audits: plan_id, id, action, evidence (falls back to the after-state's)."""
    c = audits.select("plan_id", F.explode("changes").alias("c"))
    return c.select("plan_id", "c.id", "c.action", F.coalesce("c.evidence", "c.after_evidence").alias("evidence"))
