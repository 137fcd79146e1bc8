"""Counts and reports, one row per document; plain partial aggregates throughout."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import resolve_path


def counts(rows: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    return rows.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(rows: DataFrame, keys: Sequence[str], by: str, values: Sequence[str]) -> DataFrame:
    """One column per listed value; listing them spares the scan that would look for them."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(by) == v).alias(f"n_{v}") for v in values])


def review_summary(objects: DataFrame, refs: DataFrame, rejected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per review run: objects by category, uncertain, merged groups, rejected; the union box.

    ``refs`` counts sources per object; an object over several sources is a merged group.
    """
    keys = list(keys)
    sizes = refs.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_n"))
    merged = sizes.groupBy(*keys).agg(F.count_if(F.col("_n") > 1).alias("merged_groups"))
    gone = rejected.groupBy(*keys).agg(F.count(F.lit(1)).alias("rejected"))
    main = objects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if(F.col("category") == "house").alias("houses"),
        F.count_if(F.col("status") == "uncertain").alias("uncertain"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
    )
    return main.join(merged, keys, "left").join(gone, keys, "left").fillna(0, ["merged_groups", "rejected"])


def mixed_sources(runs: DataFrame, batch: str = "batch", image: str = "image_id") -> DataFrame:
    """Batches that combine runs of different images."""
    return runs.groupBy(batch).agg(F.count_distinct(image).alias("images")).filter("images > 1")


def gallery_summary(structure: DataFrame, audits: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Structure entries with their audit: hidden-path objects, polygon houses, verdicts, safe houses."""
    keys = list(keys)
    house = F.col("category") == "house"
    s = structure.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if(house).alias("houses"),
        F.count_if(F.col("hidden") > 0).alias("with_hidden_paths"),
        F.count_if(house & (F.col("kind") == "polygon")).alias("polygon_houses"),
    )
    ids = structure.filter(house).select(*keys, "id").distinct().withColumn("_house", F.lit(True))
    a = (
        audits.join(ids, [*keys, "id"], "left")
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("verdict") == "plausible").alias("plausible"),
            F.count_if(F.col("verdict") == "needs_review").alias("needs_review"),
            F.count_if(F.col("verdict") == "reject").alias("rejected"),
            F.count_if(F.col("safe") & F.coalesce("_house", F.lit(False))).alias("safe_houses"),
        )
    )
    return s.join(a, keys)


def ground_summary(landmarks: DataFrame, sources: DataFrame, rejected: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per tile: landmark levels, merged groups, rejected candidates."""
    keys = list(keys)
    levels = pivot_counts(landmarks, keys, "level", ["ground", "occlusion", "upper", "unknown"])
    groups = (
        sources.groupBy(*keys, "id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("instances"), F.count_if(F.col("_n") > 1).alias("merged_groups"))
    )
    gone = rejected.groupBy(*keys).agg(F.count(F.lit(1)).alias("rejected"))
    return levels.join(groups, keys, "left").join(gone, keys, "left").fillna(0)


def batch_status(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All runs valid? How many candidates in all?"""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.bool_and("valid").alias("all_valid"),
        F.sum(F.when(F.col("valid"), F.col("candidates")).otherwise(0)).alias("candidates"),
    )


def plan_report(
    buildings: DataFrame, terrain: DataFrame, trees: DataFrame, pending: DataFrame, findings: DataFrame
) -> DataFrame:
    """Counts by kind, grouped regions, pending candidates, tree groups and roots, findings by severity.

    Every row of every table adds its marks to its plan in one aggregate over their union. Plans without
    buildings have no report.
    """
    one, flag = F.lit(1), lambda c: F.coalesce(c, F.lit(False)).cast("int")
    tables = [
        (buildings, {"regions": one, "houses": flag(F.col("category") == "house"), "grouped": flag(F.col("grouped"))}),
        (terrain, {"terrain": one, "waters": flag(F.col("category") == "water")}),
        (trees, {"tree_groups": one, "tree_roots": F.coalesce(F.col("roots"), F.lit(0))}),
        (pending, {"pending": one}),
        (findings, {"major": flag(F.col("severity") == "major"), "minor": flag(F.col("severity") == "minor")}),
    ]
    names = [n for _, marks in tables for n in marks]
    rows = [df.select("plan_id", *(marks.get(n, F.lit(0)).alias(n) for n in names)) for df, marks in tables]
    union = reduce(lambda a, b: a.unionByName(b), rows)
    return union.groupBy("plan_id").agg(*(F.sum(n).alias(n) for n in names)).filter("regions > 0")


def distinct_sorted(rows: DataFrame, keys: Sequence[str], value: str | Column, name: str) -> DataFrame:
    """Sorted set of a low-cardinality attribute such as the model name."""
    v = F.col(value) if isinstance(value, str) else value
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(v)).alias(name))


def run_matches(structures: DataFrame, audits: DataFrame) -> DataFrame:
    """Structure runs with the audit that names them as its prior: ``output_dir, audit_dir``.

    ``structures``: output_dir; ``audits``: pos (their order), prior_dir, output_dir,
    exit_code. Paths are compared resolved, so that ``a/./b``, ``a//b`` and ``a/c/../b``
    are one. Failed audits do not count; of several the last one does. Structures
    without an audit are left out.
    """
    good = audits.filter(F.col("exit_code") == 0).select(resolve_path(F.col("prior_dir")).alias("_path"), "pos", F.col("output_dir").alias("audit_dir"))
    last = good.groupBy("_path").agg(F.max_by("audit_dir", "pos").alias("audit_dir"))
    return structures.withColumn("_path", resolve_path(F.col("output_dir"))).join(last, "_path").drop("_path")
