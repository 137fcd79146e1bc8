"""Connected components over overlap edges and edge clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


GROUP_LIMIT = 1000


def components(
    edges: DataFrame, keys: Sequence[str] = ("image_id",), group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """``keys, id, component`` for every end of an edge; the label is the smallest id.

    Images with up to ``group_limit`` edges merge their node sets inside the JVM;
    the others contract stars over the whole cluster.
    """
    keys = list(keys)
    edges = edges.select(*keys, "id_a", "id_b")
    big = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group_limit).select(*keys)
    if big.isEmpty():
        return merged_sets(edges, keys)
    return merged_sets(edges.join(big, keys, "left_anti"), keys).unionByName(
        propagated_labels(edges.join(big, keys, "left_semi"), keys)
    )


def merged_sets(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold of the edges of one key: every edge merges the sets that hold its ends."""
    id_type = edges.schema["id_a"].dataType.simpleString()

    def merge(sets, e):
        touched = lambda s: F.array_contains(s, e["id_a"]) | F.array_contains(s, e["id_b"])
        joined = F.array_union(F.flatten(F.filter(sets, touched)), F.array(e["id_a"], e["id_b"]))
        return F.concat(F.filter(sets, lambda s: ~touched(s)), F.array(joined))

    start = F.array().cast(f"array<array<{id_type}>>")
    sets = edges.groupBy(*keys).agg(
        F.aggregate(F.collect_list(F.struct("id_a", "id_b")), start, merge).alias("_sets")
    )
    one = sets.select(*keys, F.explode("_sets").alias("_set"))
    return one.select(*keys, F.explode("_set").alias("id"), F.array_min("_set").alias("component"))


def propagated_labels(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest id that can be reached, for every end of an edge, by contracting stars.

    Every round ties each node's larger neighbours to its smallest one, then each
    node and its smaller neighbours to the smallest of them, until nothing
    changes: long chains settle in logarithmic rounds, and a giant component ends
    as a star whose rows are keyed by their own ids, not by its label. Every round
    writes its edges to the shared folder; minima are combined before they are
    shuffled.
    """
    keys = list(keys)
    u, v = F.col("u"), F.col("v")
    ends = edges.select(*keys, F.col("id_a").alias("id")).unionByName(edges.select(*keys, F.col("id_b").alias("id"))).distinct()
    stars = edges.select(*keys, F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v"))
    stars, state = cut(stars.filter(u != v).distinct()), None
    while True:
        both = stars.unionByName(stars.select(*keys, v.alias("u"), u.alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter(v > u).join(least, [*keys, "u"]).select(*keys, v.alias("u"), F.col("m").alias("v")).filter(u != v).distinct()
        down = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(down, [*keys, "u"]).select(*keys, v.alias("u"), F.col("m").alias("v"))
        small = small.unionByName(down.select(*keys, "u", F.col("m").alias("v")))
        stars = cut(small.filter(u != v).distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = stars.select(*keys, u.alias("id"), v.alias("component"))
    return ends.join(roots, [*keys, "id"], "left").withColumn("component", F.coalesce("component", "id"))


def component_groups(boxes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per component: members, union box and the strongest overlap inside it."""
    keys = list(keys)
    member = components(edges, keys)
    shape = (
        boxes.join(member, [*keys, "id"])
        .groupBy(*keys, "component")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min("x0").alias("x0"),
            F.min("y0").alias("y0"),
            F.max("x1").alias("x1"),
            F.max("y1").alias("y1"),
        )
    )
    score = (
        edges.join(member.withColumnRenamed("id", "id_a"), [*keys, "id_a"])
        .groupBy(*keys, "component")
        .agg(F.max("overlap").alias("score"))
    )
    return shape.join(score, [*keys, "component"])


def redirect_edges(edges: DataFrame, merges: DataFrame, keys: Sequence[str] = ("plan_id",)) -> DataFrame:
    """Move edge ends along ``merges`` (keys, id, target); a null target deletes the end.

    Edges that lose an end or become loops are dropped.
    """
    keys = list(keys)
    m = merges.select(*keys, "id", "target", F.lit(True).alias("hit"))

    def end(name: str):
        return m.select(*keys, F.col("id").alias(name), F.col("target").alias(f"_{name}_t"), F.col("hit").alias(f"_{name}_h"))

    out = edges.join(end("src"), [*keys, "src"], "left").join(end("dst"), [*keys, "dst"], "left")
    for name in ("src", "dst"):
        out = out.withColumn(name, F.when(F.col(f"_{name}_h"), F.col(f"_{name}_t")).otherwise(F.col(name)))
    out = out.drop("_src_t", "_src_h", "_dst_t", "_dst_h")
    return out.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))


def edges_with_ends(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("plan_id",)) -> DataFrame:
    """Edges whose two ends exist."""
    keys = list(keys)
    ids = nodes.select(*keys, "id")
    return edges.join(ids.withColumnRenamed("id", "src"), [*keys, "src"], "left_semi").join(
        ids.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_semi"
    )
