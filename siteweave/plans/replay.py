"""Replay of stored snapshots: rules, geometry and counts for all plans at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(report: DataFrame, issues: DataFrame, claims: DataFrame, plans: DataFrame, current: DataFrame) -> DataFrame:
    """One row per plan: its report, schema issues, accounted sources and whether its bytes are unchanged.

    ``report``: output of ``summary.plan_report``. ``issues``: doc_id. ``claims``:
    plan_id, source_id. ``plans``: plan_id, sha256 on record. ``current``: plan_id, sha256 now.
    """
    bad = issues.groupBy(F.col("doc_id").alias("_doc")).agg(F.count(F.lit(1)).alias("schema_issues"))
    once = (
        claims.groupBy("plan_id", "source_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("plan_id")
        .agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("_n") > 1).alias("repeated"))
    )
    now = current.select("plan_id", F.col("sha256").alias("_now"))
    out = (
        plans.join(report, "plan_id")
        .join(bad, F.col("plan_id").cast("string") == F.col("_doc"), "left")
        .drop("_doc")
        .join(once, "plan_id", "left")
        .join(now, "plan_id", "left")
        .fillna(0, ["schema_issues", "sources", "repeated"])
        .withColumn("unchanged", F.coalesce(F.col("_now") == F.col("sha256"), F.lit(False)))
    )
    passed = F.col("unchanged") & (F.col("schema_issues") == 0) & (F.col("repeated") == 0) & (F.col("major") == 0)
    return out.withColumn("passed", passed).drop("_now", "sha256")
