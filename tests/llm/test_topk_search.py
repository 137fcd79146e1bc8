import math
import random
import struct

import pytest

from siteweave.llm.topk_search import exact_top_k

ROW = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20, scale=64):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 512), (50, 3)])
def test_lists_equal_brute_force(spark, clashing, blocks):
    rng = random.Random(4)
    grid = [-2.0, -0.5, -1 / 128, 0.0, 0.0, 0.0, 0.015625, 0.25, 3.0]
    rows = [(i, [rng.choice(grid) for _ in range(12)]) for i in range(200)]
    rows += [(i, rows[7][1]) for i in range(300, 330)]  # ties
    rows += [(40, rows[3][1]), (40, rows[40][1]), (41, rows[41][1]), (400, None), (420, [1.0, None]), (440, [math.nan]), (460, [math.inf]),
             (480, []), (500, [2.0, 1.0]), (520, [1e6] * 12), (None, [1.0]), (-20, [0.5] * 12)]
    table = clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], ROW), "w", "q", "r", "rank", "query_id")
    found = exact_top_k(table, candidate_block=blocks[0], query_block=blocks[1])
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows)


def test_fewer_rows_than_k_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0], 0), (1, [0.5], 0)], ROW)
    assert [tuple(r) for r in exact_top_k(table).collect()] == [(0, 1, 1, 64 * 32)]
    assert exact_top_k(table.filter("vec_id = 0")).count() == 0
    assert exact_top_k(table.filter("false")).count() == 0


def test_one_id_with_a_third_of_the_rows(spark):
    """Repeated rows and one id with many vectors are dealt over blocks; each counts as a candidate, each distinct vector as a query."""
    rng = random.Random(9)
    rows = [(60, [1.0, -1.0, 0.5])] * 150 + [(60, [rng.uniform(-1, 1) for _ in range(3)]) for _ in range(5)] + [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(1, 300)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], ROW)
    found = exact_top_k(table, candidate_block=16, query_block=4)
    exact = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute(exact)
