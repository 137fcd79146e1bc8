"""Greedy suppression in rank order: box NMS and containment de-duplication.

The greedy pass keeps an item when no better kept item conflicts with it. That
is decided twice over, with the same result:

* groups up to ``group_limit`` items fold over their ranked array inside the JVM;
* larger groups never meet in one task. Their conflict graph comes from the
  spread pair join and is settled in rounds: an item without an undecided better
  rival is kept, and every item that loses to a kept one is dropped. What is left
  of a group after a few rounds is settled by one pass over its conflicts, as long
  as there is a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import BOX, iou_clamped
from ..session import cut
from .overlap import box_pairs

GROUP_LIMIT = 2000

#: Rounds before what is left is looked at, and the conflicts of a group that one task then settles.
ROUNDS, FOLD_EDGES = 3, 1 << 20

# conflict(worse, better) on two structs holding the fields of an item
Conflict = Callable[[Column, Column], Column]


def struct_box(s: Column, prefix: str = "") -> tuple[Column, ...]:
    return tuple(s[prefix + c] for c in BOX)


def nms_conflict(threshold: float) -> Conflict:
    return lambda worse, better: iou_clamped(struct_box(worse), struct_box(better)) >= threshold


def greedy_groups(
    items: DataFrame, keys: Sequence[str], rank: Sequence[Column], fields: Sequence[str], conflict: Conflict
) -> DataFrame:
    """Fold of the ranked items of each group; ``keys``, ``id``, ``duplicate_of`` (null: kept).

    ``duplicate_of`` names the best-ranked kept item in conflict.
    """
    payload = list(dict.fromkeys(["id", *fields]))
    order = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])
    ranked = items.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(order.alias("_order"), *payload))).alias("_items")
    )
    item_type = ranked.schema["_items"].dataType.simpleString()
    id_type = items.schema["id"].dataType.simpleString()
    start = F.struct(
        F.array().cast(item_type).alias("kept"),
        F.array().cast(f"array<struct<id:{id_type},duplicate_of:{id_type}>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        hits = F.filter(acc["kept"], lambda k: conflict(x, k))
        winner = F.try_element_at(hits, F.lit(1))["id"]
        verdict = F.struct(x["id"].alias("id"), winner.alias("duplicate_of"))
        return F.struct(
            F.when(F.size(hits) == 0, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
            F.concat(acc["out"], F.array(verdict)).alias("out"),
        )

    folded = ranked.select(*keys, F.explode(F.aggregate("_items", start, step)["out"]).alias("_o"))
    return folded.select(*keys, F.col("_o.id").alias("id"), F.col("_o.duplicate_of").alias("duplicate_of"))


def beaten_in_order(open_edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, id`` of the items that a greedy pass over each group's conflicts throws out, one group after the other.

    Conflicts come in the order of their better item: when its turn comes, whatever
    could beat it has been decided.
    """
    keys = list(keys)
    seq = F.row_number().over(W.partitionBy(*keys).orderBy("_rank", "worse")).alias("_seq")
    slim = open_edges.select(*keys, "better", "worse", seq)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        beaten, edges = set(), edges.sort_values("_seq")
        for better, worse in zip(edges["better"].tolist(), edges["worse"].tolist(), strict=True):
            if better not in beaten:
                beaten.add(worse)
        gone = edges[edges["worse"].isin(beaten)].drop_duplicates("worse")
        return gone[[*keys, "worse"]].rename(columns={"worse": "id"})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"id {kinds['worse']}"])
    return slim.groupBy(*keys).applyInPandas(run, schema)


def greedy_rounds(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], fold_edges: int = FOLD_EDGES) -> DataFrame:
    """Same verdicts from a conflict graph, for groups of any size.

    ``nodes``: keys, id. ``edges``: keys, better, worse, ``_rank`` (rank of the
    better item). A round settles, all over the group, the undecided items that no
    undecided one beats, and what they beat. After ``ROUNDS`` of them, groups with at
    most ``fold_edges`` conflicts left are settled by one pass each, so that a long
    chain of conflicts does not take a round a link; larger ones go on in rounds.
    """
    keys = list(keys)
    edges = cut(edges.select(*keys, "better", "worse", "_rank"))
    open_edges = edges
    undecided = cut(nodes.select(*keys, "id"))
    kept_parts: list[DataFrame] = []
    rounds = 0
    while not undecided.isEmpty():
        if rounds == ROUNDS:
            rounds = 0
            large = cut(open_edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > fold_edges).select(*keys))
            beaten = beaten_in_order(open_edges.join(large, keys, "left_anti"), keys)
            kept_parts.append(cut(undecided.join(large, keys, "left_anti").join(beaten, [*keys, "id"], "left_anti")))
            undecided = cut(undecided.join(large, keys, "left_semi"))
            open_edges = cut(open_edges.join(large, keys, "left_semi"))
            continue
        rounds += 1
        blocked = open_edges.select(*keys, F.col("worse").alias("id")).distinct()
        kept = cut(undecided.join(blocked, [*keys, "id"], "left_anti"))
        kept_parts.append(kept)
        beaten = (
            open_edges.join(kept.withColumnRenamed("id", "better"), [*keys, "better"], "left_semi")
            .select(*keys, F.col("worse").alias("id"))
            .distinct()
        )
        gone = cut(kept.unionByName(beaten))
        undecided = cut(undecided.join(gone, [*keys, "id"], "left_anti"))
        open_edges = cut(
            open_edges.join(gone.withColumnRenamed("id", "better"), [*keys, "better"], "left_anti").join(
                gone.withColumnRenamed("id", "worse"), [*keys, "worse"], "left_anti"
            )
        )
    if not kept_parts:
        return nodes.select(*keys, "id", F.col("id").alias("duplicate_of")).limit(0)
    kept_all = kept_parts[0]
    for part in kept_parts[1:]:
        kept_all = kept_all.unionByName(part)
    # the greedy pass stops at the first, that is the best-ranked, kept rival
    first = (
        edges.join(kept_all.withColumnRenamed("id", "better"), [*keys, "better"], "left_semi")
        .groupBy(*keys, F.col("worse").alias("id"))
        .agg(F.min_by("better", "_rank").alias("duplicate_of"))
    )
    return nodes.select(*keys, "id").join(first, [*keys, "id"], "left")


def greedy_suppress(
    items: DataFrame,
    rank: Sequence[Column],
    fields: Sequence[str],
    conflict: Conflict,
    keys: Sequence[str] = ("image_id",),
    group_limit: int = GROUP_LIMIT,
    edges: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Verdict per item: ``keys, id, duplicate_of``; kept items have a null there.

    ``rank`` columns ascend, best first, and end in a unique column. ``edges``
    may supply the conflicting pairs of big groups (aliases ``a``/``b`` joined);
    by default pairs whose boxes meet are tested with ``conflict``.
    """
    keys = list(keys)
    sizes = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.filter(F.col("_n") > group_limit).select(*keys)
    if big.isEmpty():
        return greedy_groups(items, keys, rank, fields, conflict)
    small = items.join(big, keys, "left_anti")
    large = cut(
        items.join(big, keys, "left_semi").withColumn(
            "_rank", F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])
        )
    )
    payload = list(dict.fromkeys(["id", *fields]))
    if edges is None:
        sa = F.struct(*[F.col(f"a.{c}") for c in payload])
        sb = F.struct(*[F.col(f"b.{c}") for c in payload])
        a_better = F.col("a._rank") < F.col("b._rank")
        hit = (a_better & conflict(sb, sa)) | (~a_better & conflict(sa, sb))
        joined = box_pairs(large, keys=keys, condition=hit)
    else:
        joined = edges(large)
        a_better = F.col("a._rank") < F.col("b._rank")
    pairs = joined.select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        F.when(a_better, F.col("a.id")).otherwise(F.col("b.id")).alias("better"),
        F.when(a_better, F.col("b.id")).otherwise(F.col("a.id")).alias("worse"),
        F.when(a_better, F.col("a._rank")).otherwise(F.col("b._rank")).alias("_rank"),
    )
    return greedy_groups(small, keys, rank, fields, conflict).unionByName(greedy_rounds(large, pairs, keys))


def box_nms(
    boxes: DataFrame,
    threshold: float = 0.25,
    keys: Sequence[str] = ("image_id",),
    score: str = "score",
    tiebreak: str = "id",
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Boxes that survive non-maximum suppression (kept while IoU < threshold to all kept).

    Copies of one box share their fate, so that only the best copy enters the
    greedy pass; the rest lose to it, or to whatever beats it.
    """
    keys = list(keys)
    rank = [-F.col(score), F.col(tiebreak)]
    best = boxes.groupBy(*keys, *BOX).agg(
        F.min_by(F.struct("id", score, *({tiebreak} - {"id", score})), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("_b")
    ).select(*keys, *BOX, "_b.*")
    verdict = greedy_suppress(best, rank, [*BOX], nms_conflict(threshold), keys, group_limit)
    kept = verdict.filter(F.col("duplicate_of").isNull()).select(*keys, "id")
    return boxes.join(kept, [*keys, "id"], "left_semi")
