"""Claims are looked up in their part of the removals by hash: a sort of all claims would spill."""

from siteweave.plans import revision


def test_move_ownership(spark, rows):
    """F9"""
    claims = rows("plan_id long, source_id string, owner string", (1, "a", "B1"), (1, "b", "B2"), (1, "b", "B3"), (1, "c", "B4"), (1, "d", None))
    gone = rows("plan_id long, id string, target string", (1, "B2", "B3"), (1, "B4", None))
    out = revision.move_ownership(claims.repartition(2), gone.coalesce(1))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a", "B1"), (1, "b", "B3"), (1, "c", None), (1, "d", None)], key=str)
