"""Rows made out of a small table look as small as it; they must not be broadcast."""

from pyspark.sql import functions as F

from siteweave.operators import masks, orientation


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def runs(spark):
    rows = spark.range(20).select(F.lit(1).alias("image_id"), "id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("y"))
    return rows.withColumns({"x0": F.col("id").cast("int"), "x1": F.col("id").cast("int") + 2})


def test_mask_intersections(spark):
    """F1"""
    out = masks.mask_intersections(runs(spark))
    assert "BroadcastHashJoin" not in plan_of(out)
    assert sorted(map(tuple, out.collect())) == [(1, k, k + 1, 10) for k in range(19)]


def test_mask_comparison(spark):
    """F2"""
    moved = runs(spark).withColumns({"x0": F.col("x0") + 1, "x1": F.col("x1") + 1})
    out = masks.mask_comparison(runs(spark), moved)
    met = [line for line in plan_of(out).splitlines() if "Join" in line and " y#" in line]
    assert met and all("SortMergeJoin" in line for line in met)
    assert {(r.area_a, r.area_b, r.shared) for r in out.collect()} == {(20, 20, 10)}


def test_orientation_candidates(spark, rows):
    """F3"""
    expected = spark.range(3).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("H"), "id").alias("id"))
    letters = expected.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(23)))).select(
        "doc_id", "id", F.char(F.col("k") + 65).alias("candidate"), (F.col("k") * 15).cast("double").alias("angle")
    )
    given = rows(
        "doc_id long, id string, candidate string, horizontal string, depth string",
        (1, "H0", " candidate  a ", "left", "same_depth"), (1, "H1", "AA", "left", "nearer"), (1, "H2", None, "left", "nearer"), (1, "X", "A", "up", "up"),
    )
    out = orientation.orientation_issues(given, letters, expected)
    joins = [line for line in plan_of(out).splitlines() if "Join" in line and "candidate" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert sorted(map(tuple, out.collect())) == [("1", "H0", "side_contradicts"), ("1", "H1", "invalid_candidate"), ("1", "H2", "invalid_candidate")]
