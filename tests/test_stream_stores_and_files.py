"""A stream has a state store per core and a file per bucket and batch, whatever the shuffles of the session."""

import os
from pathlib import Path

from siteweave.session import scratch_path
from siteweave.streaming import answered
from siteweave.streaming import intake as live


def test_accept_keyed(spark, tmp_path):
    """F4"""
    src, sink, state = str(tmp_path / "in"), scratch_path(spark, "sink"), scratch_path(spark, "state")
    runs = spark.range(24).selectExpr(
        "id div 2 as image_id", "'s' as stage", "'l' as label", "id as run_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts", "'stop' as finish_reason",
        "'m' as model_requested", "'m' as model_returned", "0 as issues", "'{}' as answer",
    )
    runs.coalesce(1).write.parquet(src)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert answered.accept_keyed(live.answer_stream(spark, src, runs.schema), sink, state, buckets=2) == 12
        assert spark.conf.get("spark.sql.shuffle.partitions") == "23"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.image_id, r.run_id) for r in spark.read.parquet(sink).collect()) == [(k, 2 * k) for k in range(12)]
    folder = lambda p: Path(p.removeprefix("file:"))
    assert sorted(f.parent.name for f in folder(sink).rglob("part-*.parquet")) == ["bucket=0", "bucket=1"]
    assert len([n for n in os.listdir(folder(state) / "state" / "0") if n.isdigit()]) <= max(4, spark.sparkContext.defaultParallelism)
