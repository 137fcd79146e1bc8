"""Claims meet removals and merge targets in one shuffle; neither is broadcast."""

from siteweave.plans import evidence, revision

CLAIMS = [(1, "a", "B1"), (1, "a", "B1"), (1, "b", "B2"), (1, "b", "B3"), (1, "c", "B3"), (1, "c", "B4"), (1, "d", "B5"), (1, "d", "B5"), (1, "e", None), (1, "e", None), (2, "a", "B2")]
#: B2 goes into B3, B4 is rejected; repeats at the target B3 fall together, all others stay.
MOVED = [(1, "a", "B1"), (1, "a", "B1"), (1, "b", "B3"), (1, "c", "B3"), (1, "c", None), (1, "d", "B5"), (1, "d", "B5"), (1, "e", None), (1, "e", None), (2, "a", "B2")]


def whole(df):
    found = sorted(map(tuple, df.collect()), key=str)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return found, plan


def test_move_ownership(spark, rows):
    """F8: as apply_identity uses it"""
    assert evidence.move_ownership is revision.move_ownership
    claims = rows("plan_id long, source_id string, owner string", *CLAIMS)
    gone = rows("plan_id long, id string, target string", (1, "B2", "B3"), (1, "B4", None))
    found, plan = whole(revision.move_ownership(claims.repartition(2), gone.coalesce(1)))
    assert found == sorted(MOVED, key=str)
    assert "BroadcastHashJoin" not in plan and "ReusedExchange" in plan


def test_apply_review(spark, rows):
    """F9"""
    claims = rows("plan_id long, source_id string, owner string", *CLAIMS)
    old = spark.sql("select 1L as plan_id, concat('B', id) as id, 0D as cx from range(1, 6)")
    changes = spark.sql("select 1L as plan_id, concat('B', id) as id, 'remove' as op, case when id = 2 then 'B3' end as merge_into, 0D as cx from range(2, 5, 2)")
    found, plan = whole(revision.apply_review(old, claims, changes)[1])
    assert found == sorted(MOVED, key=str)
    assert "BroadcastHashJoin" not in plan and "ReusedExchange" in plan
