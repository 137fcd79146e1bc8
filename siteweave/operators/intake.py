"""Answer intake: gate, prior runs, stage order, normalisation with a change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.answers import model_matches, with_strict_json
from .ranking import latest

# fixed values: each stage needs exactly one prior stage
STAGE_ORDER = (
    ("review", "inventory"),
    ("structure", "review"),
    ("audit", "structure"),
    ("ground_hypotheses", "landmarks"),
    ("ground_check", "ground_hypotheses"),
)
ANCHOR_ALIAS = ("partial_visible", "visible_partial")
ROLE_ALIAS = ("visible_ground_line", "ground_edge")
ORIENTATION_STAGE = "automatic_building_orientation_inference"
CATEGORY_ALIAS = ("tree_group", "tree")


def gate(runs: DataFrame) -> DataFrame:
    """Runs with ``refused``: why an answer is not accepted (null: accepted).

    Needs finish_reason, model_requested, model_returned, issues (count), answer.
    An answer is one JSON object, at most inside one code fence; prose around it is refused.
    """
    reason = (
        F.when(~F.coalesce(F.col("finish_reason") == "stop", F.lit(False)), "truncated")
        .when(~model_matches(F.col("model_requested"), F.col("model_returned")), "wrong_model")
        .when(F.col("parsed").isNull(), "not_json")
        .when(F.col("issues") > 0, "invalid")
    )
    return with_strict_json(runs, "answer", "parsed").withColumn("refused", reason)


def latest_accepted(gated: DataFrame, keys: Sequence[str] = ("image_id", "stage", "label")) -> DataFrame:
    """The last accepted run per request."""
    ok = gated.filter(F.col("refused").isNull()).select(*keys, "run_id", "ts")
    return latest(ok, keys, ["ts", "run_id"])


def attempt_history(gated: DataFrame, keys: Sequence[str] = ("image_id", "stage", "label")) -> DataFrame:
    """Attempts per request: how many, how many refused, first and last run."""
    stamp = F.struct("ts", "run_id")
    return gated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count("refused").alias("refused_attempts"),
        F.min_by("run_id", stamp).alias("first_run"),
        F.max_by("run_id", stamp).alias("last_run"),
    )


def load_prior(runs: DataFrame, normalized: DataFrame, validated: DataFrame) -> DataFrame:
    """Which document stands for a run: ``source`` (validated, normalised, raw) and ``stale``.

    ``runs``: run_id, stage, sha256. ``normalized``: run_id. ``validated``: run_id,
    source_sha256. Normal forms count for their own stages only; a validation of
    other bytes is stale and blocks the run.
    """
    n = normalized.select("run_id", F.lit(True).alias("_n")).distinct()
    v = validated.groupBy("run_id").agg(F.max("source_sha256").alias("_v"))
    out = runs.join(n, "run_id", "left").join(v, "run_id", "left")
    by_check = F.col("_v").isNotNull() & F.col("stage").isin("landmarks", "ground_hypotheses", "ground_check")
    by_norm = F.col("_n").isNotNull() & F.col("stage").isin("inventory", "structure", "landmarks")
    source = F.when(by_check, "validated").when(by_norm, "normalized").otherwise("raw")
    return out.withColumns(
        {"source": source, "stale": by_check & ~F.col("_v").eqNullSafe(F.col("sha256"))}
    ).drop("_n", "_v")


def refused_priors(priors: DataFrame, runs: DataFrame) -> DataFrame:
    """Prior runs that no stage may build on: ``run_id, reason``.

    ``priors`` as from :func:`load_prior`; ``runs``: run_id, finish_reason, issues
    (left in the document that stands for it), model_requested, model_returned.
    """
    j = priors.select("run_id", "stale").join(runs, "run_id", "left")
    reason = (
        F.when(F.col("stale"), "stale_validation")
        .when(~F.coalesce(F.col("finish_reason") == "stop", F.lit(False)), "incomplete")
        .when(F.coalesce(F.col("issues") > 0, F.lit(True)), "invalid")
        .when(~model_matches(F.col("model_requested"), F.col("model_returned")), "wrong_model")
    )
    return j.select("run_id", reason.alias("reason")).filter("reason is not null")


def stale_orientations(cached: DataFrame, images: DataFrame, detections: DataFrame) -> DataFrame:
    """Cached orientations that may not be used: ``image_id, reason``.

    ``cached``: image_id, stage, width, height, image_sha256, detection_sha256;
    ``images``: image_id, width, height, sha256; ``detections``: image_id, sha256.
    A cache is bound to its image and to the detections it was made from.
    """
    j = cached.join(
        images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("sha256").alias("_image")), "image_id", "left"
    ).join(detections.select("image_id", F.col("sha256").alias("_detection")), "image_id", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("stage") == ORIENTATION_STAGE, F.lit(False)), "stage")
        .when(~(same("width", "_w") & same("height", "_h")), "image_size")
        .when(~same("image_sha256", "_image"), "image_changed")
        .when(~same("detection_sha256", "_detection"), "detections_changed")
    )
    return j.select("image_id", reason.alias("reason")).filter("reason is not null")


def stage_violations(runs: DataFrame) -> DataFrame:
    """Runs whose prior run has the wrong stage: run_id, stage, prior_stage."""
    spark = runs.sparkSession
    order = F.broadcast(spark.createDataFrame(STAGE_ORDER, "stage string, prior_stage string"))  # five fixed rows
    staged = runs.filter(F.col("stage").isin([s for s, _ in STAGE_ORDER]))
    return staged.join(order, ["stage", "prior_stage"], "left_anti").select("run_id", "stage", "prior_stage")


def blocked_images(jobs: DataFrame) -> DataFrame:
    """Per image of a survey manifest: jobs, failed ones, and whether any failure blocks it."""
    return jobs.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("exit_code") != 0).alias("failed"),
        F.bool_or(F.col("exit_code") != 0).alias("blocked"),
    )


def normalize_category(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects with the tree-group alias resolved, change log)."""
    hit = F.col("category") == CATEGORY_ALIAS[0]
    changed = objects.filter(hit).select(
        "run_id", "id", F.lit(CATEGORY_ALIAS[0]).alias("was"), F.lit(CATEGORY_ALIAS[1]).alias("now")
    )
    out = objects.withColumns(
        {
            "grouped": F.when(hit, F.lit(True)),
            "category": F.when(hit, F.lit(CATEGORY_ALIAS[1])).otherwise(F.col("category")),
        }
    )
    return out, changed


def normalize_roles(segments: Column) -> Column:
    """Segment array with the role alias resolved."""
    return F.transform(
        segments,
        lambda s: s.withField("role", F.when(s["role"] == ROLE_ALIAS[0], F.lit(ROLE_ALIAS[1])).otherwise(s["role"])),
    )


def decode_path(text: Column) -> Column:
    """JSON text of a path to points; null unless every point is valid and there are two."""
    raw = F.from_json(text, "array<array<double>>")
    good = (F.size(raw) >= 2) & F.forall(raw, lambda p: (F.size(p) == 2) & G.point_ok(p[0], p[1]))
    return F.when(F.coalesce(good, F.lit(False)), raw)


def normalization_report(gated: DataFrame, objects: DataFrame, stage: str = "inventory") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row for each run that can be normalised, its objects per category, refused runs with the reason).

    ``gated``: run_id, stage, refused (see :func:`gate`); ``objects``: run_id, id,
    category, box, occluder. A refused answer, or one of another stage, is not touched.
    The others get their category alias resolved; the report counts those changes,
    the issues left afterwards, and the boxes that are labelled both tree and
    mountain, which is a matter for a reviewer and not for a rule.
    """
    from .overlap import coincident_pairs
    from .rules import inventory_issues

    why = F.coalesce("refused", F.when(~F.coalesce(F.col("stage") == stage, F.lit(False)), F.lit("wrong_stage")))
    judged = gated.select("run_id", why.alias("reason"))
    good = judged.filter("reason is null").select("run_id")
    normal, changes = normalize_category(objects.join(good, "run_id", "left_semi"))
    issues = inventory_issues(normal.withColumn("doc_id", F.col("run_id"))).select(F.col("doc_id").alias("run_id"))
    out = good
    for name, rows in (("changes", changes), ("issues", issues), ("warnings", coincident_pairs(normal, "tree", "mountain", ["run_id"]))):
        out = out.join(rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name)), "run_id", "left")
    counts = normal.groupBy("run_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return out.fillna(0), counts, judged.filter("reason is not null")


def gather_candidates(tiles: DataFrame, answers: DataFrame) -> DataFrame:
    """Accepted tile answers as candidates: namespaced ids, source coordinates.

    ``answers``: image_id, label, id, box in tile-1000; ``tiles``: image_id, label,
    width, height, ``tx0…ty1``.
    """
    from ..functions.coords import to_source

    j = answers.join(tiles, ["image_id", "label"])
    crop, size = tuple(F.col(c) for c in ("tx0", "ty0", "tx1", "ty1")), (F.col("width"), F.col("height"))
    lo = to_source((F.col("x0"), F.col("y0")), crop, size)
    hi = to_source((F.col("x1"), F.col("y1")), crop, size)
    return j.select(
        "image_id", F.concat_ws(":", "label", "id").alias("id"), lo[0].alias("x0"), lo[1].alias("y0"), hi[0].alias("x1"), hi[1].alias("y1")
    )


def detection_issues(docs: DataFrame, instances: DataFrame, images: DataFrame) -> DataFrame:
    """Cached detections: stage, image size, unique non-empty ids, declared count.

    ``docs``: image_id, stage, width, height, count. One row per problem.
    """
    n = instances.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("id").alias("_d"), F.count_if(F.length("id") == 0).alias("_e")
    )
    j = docs.join(n, "image_id", "left").join(
        images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id", "left"
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("stage") != "automatic_whole_building_instance_parsing", F.lit("stage")),
            F.when(~(F.col("width").eqNullSafe(F.col("_w")) & F.col("height").eqNullSafe(F.col("_h"))), F.lit("image_size")),
            F.when(F.col("_n").isNull() | (F.col("_n") != F.col("_d")) | (F.col("_e") > 0), F.lit("ids")),
            F.when(~F.col("count").eqNullSafe(F.coalesce("_n", F.lit(0))), F.lit("count")),
        )
    )
    return j.select("image_id", F.explode(flags).alias("problem"))
