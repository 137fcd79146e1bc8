"""Scan lines are no rows of Spark, and the vectorised scan is the point test of SQL, whatever the numbers."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteweave.plans import centers


def test_scan_lines_are_not_rows(spark):
    """F2"""
    square = "array(named_struct('ax', 0D, 'ay', 0D, 'bx', 9D, 'by', 9D), named_struct('ax', 9D, 'ay', 9D, 'bx', 0D, 'by', 9.5D))"
    base = spark.range(10).select(
        F.col("id").alias("no"), F.lit(1).alias("plan_id"), F.concat(F.lit("B"), "id").alias("id"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"),
        F.expr(f"array({square}, {square})").alias("outlines"), F.expr("array(named_struct('x', 1D, 'y', 2D))").alias("corners"),
    )
    out = centers.row_masks(base, centers.grid_axis(4), 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan and "Sort" not in plan
    assert sorted(r.id for r in out.collect()) == [f"B{k}" for k in range(10)]


def above(a, b):
    """As in SQL: NaN is above all numbers."""
    return a > b or (math.isnan(a) and not math.isnan(b))


def inside(x, y, edges):
    odd = False
    for ax, ay, bx, by in edges:
        if above(ay, y) != above(by, y):
            odd ^= above((bx - ax) * (y - ay) / (by - ay) + ax, x)
    return odd


@pytest.mark.parametrize("tested", [256, 5])
def test_scan_is_the_point_test(monkeypatch, tested):
    """edges across, beside and on places, of very large numbers, infinite or no number; pieces of outlines; outlines and buildings without any"""
    monkeypatch.setattr(centers, "WRITTEN_OUT", tested)
    monkeypatch.setattr(centers, "HELD_BUILDINGS", 7)
    rng, axis = random.Random(3), centers.grid_axis(12)
    rare = [math.nan, math.inf, -math.inf, 1e17, -1e17, 1e200]

    def number(share):
        return rng.choice(rare) if rng.random() < share else rng.choice([rng.uniform(-60, 60), float(rng.randrange(-30, 31, 2))])

    def ring(share):
        p = [(number(share), number(share)) for _ in range(rng.choice([0, 3, 4, 5, 13]))]
        far = rng.choice([0.0, 0.0, 200.0, 1e17])
        edges = [(ax + far, ay, bx + far, by) for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True)]
        return [e for e in edges if e[1] != e[3] and not (math.isnan(e[1]) and math.isnan(e[3]))]

    rows = []
    for k in range(120):
        share = rng.choice([0, 0, 0.1])
        # a ring around all, so that some shifts are left
        wide = [(-900.0, -900.0, 900.0, 900.0), (900.0, 900.0, 901.0, -900.0)] if k % 3 else ring(share)
        x, y = rng.choice([0.0, 0.0, 0.0, 200.0, 1e17, number(1)]), rng.choice([0.0, 0.0, number(0.5)])
        rows.append({"no": k, "outlines": [wide, ring(share)][: rng.choice([0, 1, 1, 2, 2])], "corners": [(x + number(0), y + number(0)) for _ in range(2)]})
    named = lambda names, v: dict(zip(names, v, strict=True))
    batch = pa.table(
        {
            "no": pa.array([r["no"] for r in rows]),
            "outlines": pa.array([[[named(("ax", "ay", "bx", "by"), e) for e in o] for o in r["outlines"]] for r in rows], pa.list_(pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")])))),
            "corners": pa.array([[named("xy", c) for c in r["corners"]] for r in rows]),
        }
    ).to_batches()[0]
    got = [(no, a) for b in centers.shift_finder(axis, 2, ["no"])(iter([batch.slice(0, 50), batch.slice(50)])) for no, a in zip(b.column("no").to_pylist(), b.column("allowed").to_pylist(), strict=True)]
    assert [no for no, _ in got] == list(range(len(rows)))
    found = 0
    for r, (_, codes) in zip(rows, got, strict=True):
        want = [
            k << 6 | i for i, k in centers.ranked_shifts(axis)
            if r["outlines"] and all(inside(x + axis[i], y + axis[k], o) for o in r["outlines"] for x, y in r["corners"])
        ]
        assert codes == want, r
        found += len(want)
    assert found > 500
