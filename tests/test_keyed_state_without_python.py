"""Requests have their state in the engine; runs behind its watermark are looked up in the sink."""

from pyspark.sql import functions as F

from siteweave.session import scratch_path
from siteweave.streaming import answered
from siteweave.streaming import intake as live

RUN = "image_id int, run_id int, day int"


def runs(spark, *data):
    return spark.createDataFrame(data, RUN).selectExpr(
        "image_id", "'s' as stage", "'l' as label", "run_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,day) as ts", "'stop' as finish_reason",
        "'m' as model_requested", "'m' as model_returned", "0 as issues", "'{}' as answer",
    )


def test_no_call_of_python_per_request(spark, tmp_path):
    """F1"""
    src = str(tmp_path / "in")
    part = runs(spark, (1, 1, 0))
    part.write.parquet(src)
    found = answered.first_answers(live.answer_stream(spark, src, part.schema), ["image_id", "stage", "label"])
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark" in plan and "Pandas" not in plan and "Python" not in plan


def test_runs_behind_the_watermark_and_without_a_time(spark, tmp_path):
    """none is dropped, none accepted twice"""
    src, sink, state = str(tmp_path / "in"), scratch_path(spark, "sink"), scratch_path(spark, "state")

    def put(*data):
        part = runs(spark, *data)
        part.coalesce(1).write.mode("append").parquet(src)
        answered.accept_keyed(live.answer_stream(spark, src, part.schema), sink, state, keep="10 days")
        return {r.image_id: r.run_id for r in spark.read.parquet(sink).collect()}

    assert put((1, 1, 30), (4, 6, None), (4, 5, None), (5, 0, -20_000), (6, 20, None), (6, 21, 29), (None, 60, 29)) == {1: 1, 4: 5, 5: 0, 6: 21, None: 60}
    all_of = {1: 1, 2: 2, 3: 9, 4: 5, 5: 0, 6: 21, 7: 30, None: 60}
    assert put((2, 2, 22), (3, 9, -20_000), (3, 3, -19_999), (7, 30, 24), (7, 31, 26)) == all_of
    # 2 came behind the watermark, which state does not see; 1 and 7 are asked for behind it; 4 had no time
    assert put((2, 10, 31), (1, 11, 10), (7, 12, 3), (4, 13, 41), (5, 14, 31), (None, 61, 3), (8, 40, 60)) == all_of | {8: 40}
    assert put((1, 50, 61), (2, 51, 61), (3, 52, 61), (6, 53, 20), (7, 54, 60), (8, 55, 1), (None, 62, 61)) == all_of | {8: 40}
    assert spark.read.parquet(sink).agg(F.count(F.lit(1))).first()[0] == 9


def test_half_is_rounded_up():
    assert [answered.half(k).total_seconds() for k in ("10 days", "3 milliseconds", "1 nanosecond")] == [432_000, 0.002, 0.001]
