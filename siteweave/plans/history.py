"""State out of a log of changes, and whole lists that a revision replaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the fields of a plan building that a reviewer sees
CURRENT_FIELDS = (
    "category", "subtype", "label", "zone_id", "cx", "cy", "w", "d", "clock", "ratio_low", "ratio_high", "confidence", "evidence", "assumption", "grouped",
)


def current_state(log: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str = "seq") -> DataFrame:
    """What a log of changes leaves of each entity: ``keys``, ``fields`` and ``version`` (the last change).

    A row of ``log`` has ``op`` ("set" or "remove"), the names it states in ``stated``
    (array) and their values in columns of those names; null may be stated. A field
    has its last stated value since the entity was last removed, null where it was
    never stated. Entities whose last word is a removal are left out.

    One aggregate: for each field the largest (order, value), and the last removal
    and setting. It combines before the shuffle and needs no order of the rows.
    """
    put = F.col("op") == "set"
    last = [
        F.max(F.when(put & F.array_contains("stated", f), F.struct(F.col(order).alias("at"), F.col(f).alias("value")))).alias(f"_{f}") for f in fields
    ]
    folded = log.groupBy(*keys).agg(
        F.max(F.when(F.col("op") == "remove", F.col(order))).alias("_gone"), F.max(F.when(put, F.col(order))).alias("version"), *last
    )
    since = lambda at: F.col("_gone").isNull() | (at > F.col("_gone"))
    alive = folded.filter(F.col("version").isNotNull() & since(F.col("version")))
    return alive.select(*keys, *(F.when(since(F.col(f"_{f}.at")), F.col(f"_{f}.value")).alias(f) for f in fields), "version")


def replaced_lists(old: DataFrame, patches: DataFrame, name: str, schema: str, key: str = "plan_id") -> tuple[DataFrame, DataFrame]:
    """(rows of a list after the patches, how each patch speaks of the list).

    ``old``: key and the columns of ``schema``; ``patches``: key and ``patch``
    (VARIANT), one a key. A list under ``name`` replaces all rows of the key, an empty
    one leaves none; where the patch says null, says nothing, or is itself missing,
    the rows stay. Anything else than a list under the name is not applied; the second
    result tells the five cases apart: list, empty, null, absent, not_a_list.
    """
    said = F.try_variant_get("patch", f"$.{name}", "variant")
    kind = F.schema_of_variant(said)
    items = F.try_variant_get(said, "$", f"array<struct<{schema}>>")
    case = (
        F.when(said.isNull(), "absent").when(F.is_variant_null(said), "null").when(~kind.startswith("ARRAY"), "not_a_list").when(F.size(items) == 0, "empty").when(items.isNotNull(), "list").otherwise("not_a_list")
    )
    spoken = patches.select(key, case.alias("says"), items.alias("_items"))
    replaced = spoken.filter(F.col("says").isin("list", "empty"))
    kept = old.join(replaced.select(key), key, "left_anti")
    new = replaced.select(key, F.explode("_items").alias("_i")).select(key, "_i.*")
    return kept.select(*new.columns).unionByName(new), spoken.drop("_items")


def review_rejections(old: DataFrame, patches: DataFrame, removed: DataFrame, claims: DataFrame) -> DataFrame:
    """Rejected sources after a review: ``plan_id, source_id, reason``.

    A replaced list takes the place of the old one first; then the sources of
    buildings that the same review removes without a target are added to it.
    ``removed``: plan_id, id, merge_into, reason; ``claims``: plan_id, source_id, owner.
    """
    kept, _ = replaced_lists(old, patches, "replace_rejected", "source_id string, reason string")
    gone = removed.filter(F.col("merge_into").isNull()).select("plan_id", F.col("id").alias("owner"), "reason")
    return kept.unionByName(claims.join(gone, ["plan_id", "owner"]).select("plan_id", "source_id", "reason"))


def rebuilt_ownership(assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ownership from assignments (plan_id, source_id, target, reason) alone: (claims, rejections with their reason).

    What buildings owned and what was rejected before is forgotten.
    """
    owned = assignments.filter(F.col("target").isNotNull()).select("plan_id", "source_id", F.col("target").alias("owner"))
    return owned, assignments.filter(F.col("target").isNull()).select("plan_id", "source_id", "reason")
