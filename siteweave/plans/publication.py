"""Publication gate, manifest, acceptance of hypotheses, recovery of failed answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules

EDITS = ("replace", "remove", "add")


def schema_issues(buildings: DataFrame, zones: DataFrame, elements: DataFrame, boundaries: DataFrame, pending: DataFrame) -> DataFrame:
    """What the rules of a plan object to, for the gate: ``doc_id, entity_id, rule``.

    The rule sets of buildings (with their zones), terrain and boundary, and pending
    markers, each in one pass; see :mod:`siteweave.operators.rules` for the columns.
    """
    return rules.all_of(rules.building_issues(buildings, zones), rules.terrain_issues(elements, boundaries), rules.pending_issues(pending, buildings))


def publication_gate(
    plans: DataFrame, reviews: DataFrame, pending_edits: DataFrame, issues: DataFrame, findings: DataFrame
) -> DataFrame:
    """One row per plan: every condition and ``publishable``.

    ``plans``: plan_id, review_only, sha256. ``reviews``: plan_id, stage, verdict,
    plan_sha256. ``pending_edits``: plan_id per unapplied edit. ``issues``:
    doc_id. ``findings``: plan_id, severity.
    """
    edits = pending_edits.groupBy("plan_id").agg(F.count(F.lit(1)).alias("open_edits"))
    bad = issues.groupBy(F.col("doc_id").alias("_doc")).agg(F.count(F.lit(1)).alias("schema_issues"))
    major = findings.groupBy("plan_id").agg(F.count_if(F.col("severity") == "major").alias("major_findings"))
    wanted = F.when(F.col("stage") == "plan_final_check", "ready_for_confirmation").otherwise("reasonable_approximation")
    out = (
        plans.join(reviews, "plan_id", "left")
        .join(edits, "plan_id", "left")
        .join(bad, F.col("plan_id").cast("string") == F.col("_doc"), "left")
        .join(major, "plan_id", "left")
        .fillna(0, ["open_edits", "schema_issues", "major_findings"])
        .withColumns(
            {
                "hash_ok": F.coalesce(F.col("plan_sha256") == F.col("sha256"), F.lit(False)),
                "verdict_ok": F.coalesce(F.col("verdict") == wanted, F.lit(False)),
            }
        )
    )
    ok = (
        ~F.col("review_only")
        & F.col("hash_ok")
        & F.col("verdict_ok")
        & (F.col("open_edits") == 0)
        & (F.col("schema_issues") == 0)
        & (F.col("major_findings") == 0)
    )
    return out.select(
        "plan_id", "review_only", "hash_ok", "verdict_ok", "open_edits", "schema_issues", "major_findings", ok.alias("publishable")
    )


def manifest(gate: DataFrame, plans: DataFrame, images: DataFrame, pending: DataFrame, findings: DataFrame) -> DataFrame:
    """Publication rows of the plans that pass: hashes, counts of what stays open, status; :func:`open_items` names it."""
    p = pending.groupBy("plan_id").agg(F.count(F.lit(1)).alias("pending"))
    f = findings.groupBy("plan_id").agg(F.count(F.lit(1)).alias("findings"))
    return (
        gate.filter("publishable")
        .select("plan_id")
        .join(plans.select("plan_id", F.col("sha256").alias("plan_sha256")), "plan_id")
        .join(images.select(F.col("image_id").alias("plan_id"), F.col("sha256").alias("source_sha256")), "plan_id")
        .join(p, "plan_id", "left")
        .join(f, "plan_id", "left")
        .fillna(0, ["pending", "findings"])
        .withColumn("status", F.lit("ready_for_user_confirmation"))
    )


def open_items(gate: DataFrame, pending: DataFrame, findings: DataFrame) -> DataFrame:
    """What a published plan leaves open, a row each: ``plan_id, section, id, text``.

    Pending candidates by id, findings by building with their kind and what they
    meet. Rows, not one list a plan: a plan may have any number of them.
    """
    passed = gate.filter("publishable").select("plan_id")
    text = F.concat_ws(" ", "severity", "kind", "other")
    rows = pending.select("plan_id", F.lit("pending").alias("section"), F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("text")).unionByName(
        findings.select("plan_id", F.lit("finding").alias("section"), F.col("id").cast("string").alias("id"), text.alias("text"))
    )
    return rows.join(passed, "plan_id", "left_semi")


def accepted_hypotheses(alternatives: DataFrame, decisions: DataFrame) -> DataFrame:
    """Alternatives with ``accepted``: usable, and corners echoed in order or shape-only."""
    on = ["doc_id", "instance_id", "alternative_id"]
    d = decisions.groupBy(*on).agg(
        F.bool_or((F.col("verdict") == "usable_hypothesis")).alias("_usable"),
        F.bool_and(F.coalesce("consistent", F.lit(False))).alias("_echo"),
    )
    ok = F.coalesce(F.col("_usable") & (F.col("_echo") | (F.col("placement") == "shape_only")), F.lit(False))
    return alternatives.join(d, on, "left").withColumn("accepted", ok).drop("_usable", "_echo")


def recovery(jobs: DataFrame, issues_now: DataFrame, allow_cloud: bool = True, budget: int = 1) -> DataFrame:
    """What becomes of failed jobs: ``action`` per job.

    ``jobs``: job_id, exit_code, finish_reason, model_ok, parsed, stage_ok,
    corrections. ``issues_now``: job_id per issue left after metadata
    normalisation. The raw answer is never changed.
    """
    left = issues_now.groupBy("job_id").agg(F.count(F.lit(1)).alias("_issues"))
    whole = (F.col("finish_reason") == "stop") & F.col("model_ok") & F.col("parsed") & F.col("stage_ok")
    action = (
        F.when(F.col("exit_code") == 0, "keep")
        .when(~whole, "refuse")
        .when(F.col("_issues") == 0, "revalidated")
        .when(F.lit(not allow_cloud), "needs_correction")
        .when(F.col("corrections") >= budget, "exhausted")
        .otherwise("request_correction")
    )
    return jobs.join(left, "job_id", "left").fillna(0, ["_issues"]).withColumn("action", action).drop("_issues")
