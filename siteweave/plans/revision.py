"""Versioned plan snapshots: keyed upserts, ownership moves, locks, diffs, history.

Ownership is a table of claims ``plan_id, source_id, owner`` (null owner: the
source is rejected), so that merges and removals are joins on the owner and a
source stays accounted for exactly once through any number of revisions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_in_group

OBSERVED = tuple(["sx0", "sy0", "sx1", "sy1", "ax", "ay"] + [f"q{i}{a}" for i in range(4) for a in "xy"])
CARRIED = ("identity_audit", "reported_anchor", "anchor_derivation", "grouped", "unit_count_range")


def upsert(old: DataFrame, new: DataFrame, removed: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; ``removed`` keys go."""
    keys = list(keys)
    kept = old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    return kept if removed is None else kept.join(removed.select(*keys), keys, "left_anti")


def apply_review(
    buildings: DataFrame, claims: DataFrame, changes: DataFrame, change_claims: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Replace, add and remove buildings; (new buildings, new claims).

    ``changes``: plan_id, id, op, merge_into and the columns of a building.
    A removal with ``merge_into`` hands its sources over, otherwise they become
    rejections. ``change_claims`` lists the sources of replaced buildings; when
    given, it supersedes what these owned.
    """
    payload = [c for c in buildings.columns]
    new = changes.filter(F.col("op").isin("replace", "add")).select(*payload)
    gone = changes.filter(F.col("op") == "remove").select("plan_id", "id", "merge_into")
    out = upsert(buildings, new, gone, ["plan_id", "id"])
    if change_claims is not None:
        replaced = changes.filter(F.col("op") == "replace").select("plan_id", F.col("id").alias("owner"))
        claims = claims.join(replaced, ["plan_id", "owner"], "left_anti").unionByName(change_claims)
    return out, move_ownership(claims, gone.withColumnRenamed("merge_into", "target"))


def move_ownership(claims: DataFrame, removed: DataFrame) -> DataFrame:
    """``removed``: plan_id, id, target; sources follow the target, or are rejected.

    A source that a merge target ends up with several times is one claim of it.
    All other repeats stay, and the exactly-once check reports them.
    """
    # a moved source has a target by what moved it, any other if its owner is one: both are known of the old owner,
    # so that claims are dealt out once; removals grow with the plans and are dealt out too. A part of them is looked up
    # by hash: there is one removal an owner, and the many more claims need no sorting, which would spill
    m = removed.select("plan_id", F.col("id").alias("owner"), "target", F.lit(True).alias("_gone")).hint("shuffle_hash")
    targets = removed.filter(F.col("target").isNotNull()).select("plan_id", F.col("target").alias("owner"), F.lit(True).alias("_merged")).distinct().hint("shuffle_hash")
    met = claims.select("plan_id", "source_id", "owner").join(m, ["plan_id", "owner"], "left").join(targets, ["plan_id", "owner"], "left")
    owner = F.when(F.col("_gone"), F.col("target")).otherwise(F.col("owner"))
    merged = F.when(F.col("_gone"), F.col("target").isNotNull()).otherwise(F.coalesce("_merged", F.lit(False)))
    flagged = met.select("plan_id", "source_id", owner.alias("owner"), merged.alias("_to"))
    return flagged.filter("_to").drop("_to").distinct().unionByName(flagged.filter("not _to").drop("_to"))


def merged_sources(claims: DataFrame, part_size: int = 1000) -> DataFrame:
    """Sorted unique sources per owner for the written document: ``plan_id, owner, part, parts, source_ids``.

    A list comes in parts of at most ``part_size`` in order, so that an owner onto whom everything was merged does
    not meet in one row.
    """
    owned = claims.filter(F.col("owner").isNotNull()).select("plan_id", "owner", "source_id").distinct()
    place = F.floor((F.col("rank") - 1) / part_size).cast("int")
    ranked = rank_in_group(owned, ["plan_id", "owner"], ["source_id"]).withColumn("part", place)
    lists = ranked.groupBy("plan_id", "owner", "part").agg(F.sort_array(F.collect_list("source_id")).alias("source_ids"))
    sizes = ranked.groupBy("plan_id", "owner").agg((F.max("part") + 1).alias("parts"))
    return lists.join(sizes, ["plan_id", "owner"]).select("plan_id", "owner", "part", "parts", "source_ids")


def apply_elements(old: DataFrame, upserts: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert and delete in terrain, zones, trees, routes: (new elements, invalid removals).

    A removal needs a known id and a reason.
    """
    keys = ["plan_id", "collection", "id"]
    merged = upsert(old, upserts, None, keys)
    known = removals.join(merged.select(*keys).withColumn("_known", F.lit(True)), keys, "left")
    valid = F.col("_known") & (F.length(F.coalesce("reason", F.lit(""))) > 0)
    good = known.filter(F.coalesce(valid, F.lit(False))).select(*keys)
    return merged.join(good, keys, "left_anti"), known.filter(~F.coalesce(valid, F.lit(False))).drop("_known")


def gate(plans: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans without issues, plans with their number of issues); the latter are drafts, never accepted."""
    bad = issues.groupBy(F.col("doc_id").alias("_doc")).agg(F.count(F.lit(1)).alias("draft_issues"))
    joined = plans.join(bad, F.col("plan_id").cast("string") == F.col("_doc"), "left").drop("_doc")
    return joined.filter("draft_issues is null").drop("draft_issues"), joined.filter("draft_issues is not null")


def lock_violations(locks: DataFrame, buildings: DataFrame) -> DataFrame:
    """Locked observations a layout edit moved: ``plan_id, id, fields`` (how many)."""
    now = buildings.select("plan_id", "id", *OBSERVED)
    then = locks.select("plan_id", "id", *[F.col(c).alias("_" + c) for c in OBSERVED])
    moved = reduce(lambda s, c: s + (~F.col(c).eqNullSafe(F.col("_" + c))).cast("int"), OBSERVED, F.lit(0))
    return now.join(then, ["plan_id", "id"]).select("plan_id", "id", moved.alias("fields")).filter("fields > 0")


def carry_locks(old: DataFrame, new: DataFrame, carried: Sequence[str] = CARRIED) -> DataFrame:
    """Locked buildings keep their lock and, where the edit left them out, the audit columns."""
    names = [c for c in carried if c in old.columns]
    was = old.filter("locked").select("plan_id", "id", F.lit(True).alias("_locked"), *[F.col(c).alias("_" + c) for c in names])
    out = new.join(was, ["plan_id", "id"], "left")
    now = set(new.columns)
    filled = {c: F.coalesce(F.col(c), F.col("_" + c)) if c in now else F.col("_" + c) for c in names}
    out = out.withColumns({**filled, "locked": F.coalesce("_locked", F.lit(False))})
    return out.drop("_locked", *["_" + c for c in names])


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """``keys, change`` (added, removed, changed) between two snapshots."""
    keys = list(keys)

    a = before.select(*keys, F.lit(1).alias("_a"), *[F.col(c).alias("a_" + c) for c in compare])
    b = after.select(*keys, F.lit(1).alias("_b"), *[F.col(c).alias("b_" + c) for c in compare])
    differs = reduce(lambda s, c: s | ~F.col("a_" + c).eqNullSafe(F.col("b_" + c)), compare, F.lit(False))
    change = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(differs, "changed")
    )
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).filter("change is not null")


def fingerprint(rows: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Order-free content hash of the rows of a key, each as often as it occurs.

    A row is the JSON text of its columns, null ones left out and values quoted, so
    that no two rows share a text. Two sums of row hashes, taken from both ends of
    a SHA-256, aggregate partially: a plan of any size is hashed without being
    gathered, and equal rows add up where an exclusive or would cancel them.
    """
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in content]))
    digest = F.sha2(text, 256)
    part = lambda start: F.sum(F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(38,0)"))
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), part(1).alias("x"), part(53).alias("y"))
        .select(*keys, F.sha2(F.concat_ws(":", "n", F.col("x").cast("string"), F.col("y").cast("string")), 256).alias("content_sha256"))
    )


def stale(bound: DataFrame, current: DataFrame, keys: Sequence[str], hashes: Sequence[str]) -> DataFrame:
    """Rows bound to hashes that are no longer the current ones of their key."""
    return bound.join(current.select(*keys, *hashes), [*keys, *hashes], "left_anti")


def next_round(states: DataFrame, reset: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(history rows to append, states of the next review round).

    Only plans whose review and final check exist can be scheduled again; the
    reviewed plan becomes the fitted one and derived columns start empty.
    """
    done = states.filter(F.col("reviewed_plan").isNotNull() & F.col("final_check").isNotNull())
    fresh = done.withColumns(
        {
            "fitted_plan": F.col("reviewed_plan"),
            "round": F.col("round") + 1,
            "ready": F.lit(False),
        }
    ).withColumns({c: F.lit(None).cast(states.schema[c].dataType) for c in reset})
    return done, fresh


def context_rows(sections: dict[str, DataFrame], keys: Sequence[str] = ("plan_id",)) -> DataFrame:
    """Request context as rows ``keys, section, payload`` (JSON), one per fact.

    A reader streams the rows of its plan; no task has to hold a whole plan.
    """
    parts = [
        df.select(*keys, F.lit(name).alias("section"), F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("payload"))
        for name, df in sections.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
