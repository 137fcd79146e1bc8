from pyspark.sql import functions as F

from siteweave.plans import centers


def test_buildings_of_a_task_are_bounded(spark, monkeypatch):
    """parts follow the number of buildings, not the bytes that adaptive execution sees"""
    square = "array(named_struct('ax', 0D, 'ay', 0D, 'bx', 9D, 'by', 9D), named_struct('ax', 9D, 'ay', 9D, 'bx', 0D, 'by', 9.5D))"
    base = spark.range(10).select(
        F.col("id").alias("no"), F.lit(1).alias("plan_id"), "id", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"),
        F.expr(f"array({square})").alias("outlines"), F.expr("array(named_struct('x', 1D, 'y', 2D))").alias("corners"),
    )
    monkeypatch.setattr(centers, "TASK_BUILDINGS", 2, raising=False)
    out = centers.row_masks(base, centers.grid_axis(4), 2)
    assert out.rdd.getNumPartitions() == 5
    assert out.count() == 10
