"""Pair joins, suppression and components against brute force, ordinary and hot images alike."""

import random

import pytest
from pyspark.sql import functions as F

from siteweave.functions import geometry as G
from siteweave.operators import graph, masks, overlap, proposals, suppress

SCHEMA = "image_id int, id int, x0 double, y0 double, x1 double, y1 double, score double"


def make(n, images=2, seed=1, extent=300, size=60):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.randint(0, extent), rnd.randint(0, extent)
        # image 0 holds most boxes
        image = 0 if i % 3 else i % images
        out.append((image, i, float(x), float(y), float(x + rnd.randint(5, size)), float(y + rnd.randint(5, size)), rnd.randint(0, 9) / 10))
    return out


def iou(a, b):
    i = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
    return i / max((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - i, 1e-9)


def pairs_of(data, t):
    return {(a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[1] < b[1] and iou(a, b) >= t}


@pytest.mark.parametrize("limit", [10_000, 20, 5])
@pytest.mark.parametrize("parts", [1, 7])
def test_pairs_with_grid_and_salt(spark, rows, limit, parts):
    data = make(150)
    random.Random(5).shuffle(data)
    df = rows(SCHEMA, *data).repartition(parts)
    got = overlap.overlapping_pairs(df, G.iou(*overlap.ab()), 0.1, limit=limit).collect()
    assert len(got) == len({(r.id_a, r.id_b) for r in got})
    assert {(r.id_a, r.id_b) for r in got} == pairs_of(data, 0.1)


@pytest.mark.parametrize("limit", [10_000, 8])
def test_two_sided_pairs(spark, rows, limit):
    left, right = make(60, seed=2), make(70, seed=3)
    got = overlap.box_pairs(rows(SCHEMA, *left), rows(SCHEMA, *right), limit=limit).select("a.image_id", F.col("a.id").alias("i"), F.col("b.id").alias("j")).collect()
    want = {(a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and iou(a, b) > 0}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("limit", [10_000, 6])
def test_pairs_with_boxes_as_large_as_the_image(rows, limit):
    data = make(120, images=3, seed=9) + [(0, 900 + k, -5.0 * k, 0.0, 360.0, 350.0 + k, 0.5) for k in range(12)] + [(0, 950, 7.0, 7.0, 7.5, 7.5, 0.1)]
    got = overlap.overlapping_pairs(rows(SCHEMA, *data), G.iou(*overlap.ab()), 0.0001, limit=limit).collect()
    assert len(got) == len({(r.id_a, r.id_b) for r in got})
    assert {(r.id_a, r.id_b) for r in got} == pairs_of(data, 0.0001)


def test_a_large_box_lies_in_few_cells(rows):
    hot = overlap.hot_images(rows(SCHEMA, *make(400, images=1)), ["image_id"], 5)
    big = rows(SCHEMA, (0, 1, 0.0, 0.0, 360.0, 360.0, 0.0))
    assert overlap.gridded(big, hot, ["image_id"], True).count() <= 9


def brute_nms(data, t):
    kept = []
    for x in sorted(data, key=lambda r: (-r[6], r[1])):
        if all(k[0] != x[0] or iou(k, x) < t for k in kept):
            kept.append(x)
    return {k[1] for k in kept}


@pytest.mark.parametrize("group_limit", [10_000, 10, 0])
def test_nms_fold_and_rounds_agree(spark, rows, group_limit):
    data = make(90, seed=4) + [(0, 1000, 10.0, 10.0, 50.0, 50.0, 0.5), (0, 1001, 10.0, 10.0, 50.0, 50.0, 0.5)]
    got = suppress.box_nms(rows(SCHEMA, *data), 0.25, group_limit=group_limit)
    assert {r.id for r in got.collect()} == brute_nms(data, 0.25)


@pytest.mark.parametrize("group_limit", [10_000, 0])
def test_components_small_and_hot(spark, rows, group_limit):
    chain = [(0, i, i + 1, 0.5) for i in range(40)] + [(0, 100, 101, 0.7), (1, 3, 9, 0.3), (1, 9, 5, 0.2)]
    df = rows("image_id int, id_a int, id_b int, overlap double", *chain)
    got = {(r.image_id, r.id): r.component for r in graph.components(df, group_limit=group_limit).collect()}
    assert all(got[0, i] == 0 for i in range(41)) and got[0, 101] == 100
    assert got[1, 9] == got[1, 5] == got[1, 3] == 3 and len(got) == 46


def test_component_box_and_score(spark, rows):
    b = rows(SCHEMA, (1, 1, 0.0, 0.0, 20.0, 20.0, 0.0), (1, 2, 10.0, 0.0, 30.0, 20.0, 0.0), (1, 3, 100.0, 100.0, 120.0, 120.0, 0.0))
    g = graph.component_groups(b, overlap.overlapping_pairs(b, G.iou(*overlap.ab()), 0.05)).collect()
    assert len(g) == 1 and tuple(g[0][c] for c in G.BOX) == (0.0, 0.0, 30.0, 20.0)
    assert g[0].members == 2 and g[0].score == pytest.approx(1 / 3)


@pytest.mark.parametrize("group_limit", [10_000, 0])
def test_containment_dedupe_against_brute_force(spark, rows, group_limit):
    data = make(40, seed=7, extent=60, size=30)
    rnd = random.Random(8)
    items, spans, pixels = [], [], {}
    for im, i, x0, y0, x1, y1, _ in data:
        px = set()
        for y in range(int(y0), int(y1)):
            a, b = int(x0) + rnd.randint(0, 1), int(x1) - rnd.randint(0, 1)
            spans.append((im, i, y, a, b))
            px |= {(x, y) for x in range(a, b)}
        pixels[i] = px
        items.append((im, i, i, x0, y0, x1, y1, rnd.randint(1, 9) / 10, rnd.randint(1, 9) / 10, rnd.randint(1, 9) / 10, len(px)))
    df = rows("image_id int, id int, pos int, x0 double, y0 double, x1 double, y1 double, detector_score double, classifier_score double, quality double, mask_area int", *items)
    sp = rows("image_id int, id int, y int, x0 int, x1 int", *spans)
    got = {r.id: r.duplicate_of for r in masks.containment_dedupe(df, sp, group_limit=group_limit).collect()}

    def box_share(a, b):
        i = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
        return i / min(max(1, (a[5] - a[3]) * (a[6] - a[4])), max(1, (b[5] - b[3]) * (b[6] - b[4])))

    kept, want = [], {}
    for it in sorted(items, key=lambda r: (-(r[7] * r[8] * max(r[9], 0.05)), -r[10], r[2])):
        dup = next((k[1] for k in kept if k[0] == it[0] and (len(pixels[k[1]] & pixels[it[1]]) / max(1, min(k[10], it[10])) >= 0.60 or box_share(it, k) >= 0.68)), None)
        want[it[1]] = dup
        if dup is None:
            kept.append(it)
    assert got == want


def test_rank_in_group_equals_window(spark, rows):
    data = make(200, seed=9)
    got = proposals.renumber(rows(SCHEMA, *data)).collect()
    for image in (0, 1):
        order = [r[1] for r in sorted((d for d in data if d[0] == image), key=lambda d: (d[3], d[2], d[1]))]
        assert [r.id for r in sorted((r for r in got if r.image_id == image), key=lambda r: int(r.house[6:]))] == order


def test_context_variants_clamped(spark, rows):
    b = rows("image_id int, id int, x0 double, y0 double, x1 double, y1 double, width double, height double", (1, 5, 10.0, 10.0, 110.0, 60.0, 115.0, 100.0))
    v = {r.variant: r for r in proposals.context_variants(b).collect()}
    assert set(v) == {"original", "roof_wall_recovery", "balanced_context"}
    r = v["roof_wall_recovery"]
    assert (r.x0, r.y0, r.x1, r.y1) == (2.0, 0.0, 115.0, 66.0) and r.family == 5


def test_parent_split(spark, rows):
    schema = "image_id int, id int, pos int, is_group boolean, x0 double, y0 double, x1 double, y1 double"
    items = rows(schema, (1, 1, 1, True, 0.0, 0.0, 100.0, 50.0), (1, 2, 2, False, 0.0, 0.0, 45.0, 50.0), (1, 3, 3, False, 55.0, 0.0, 100.0, 50.0),
                 (1, 4, 4, True, 5.0, 5.0, 40.0, 40.0), (1, 5, 5, False, 200.0, 0.0, 220.0, 20.0), (2, 6, 6, False, 0.0, 0.0, 5.0, 5.0))
    kids = items.filter("not is_group").withColumn("rank", F.col("id"))
    splits, verdict = masks.split_parents(items, kids)
    assert [(r.id, r.child_a, r.child_b) for r in splits.collect()] == [(1, 2, 3)]
    why = {r.id: (r.reason or "kept")[:12] for r in verdict.collect()}
    assert why == {1: "vlm_group_bo", 2: "kept", 3: "kept", 4: "redundant_vl", 5: "local_propos", 6: "kept"}


def test_mask_comparison_of_empty_pairs(spark, rows):
    s = "image_id int, id int, y int, x0 int, x1 int"
    a, b = rows(s, (1, 1, 0, 0, 4), (1, 1, 1, 0, 4)), rows(s, (1, 1, 0, 2, 6), (1, 2, 0, 0, 3))
    m = {r.id: (r.iou, r.changed) for r in masks.mask_comparison(a, b).collect()}
    assert m[1] == (pytest.approx(2 / 10), pytest.approx(8 / 10)) and m[2] == (0.0, 1.0)


@pytest.mark.parametrize("fold", [1 << 20, 5])
def test_long_chains_of_conflicts_take_few_rounds(spark, rows, monkeypatch, fold):
    """Each box meets the next one only; image 1 is one chain by falling score, image 2 has chains in any order."""
    rnd = random.Random(4)
    n = 3_000 if fold > 5 else 24
    data = [(1, k, 5.0 * k, 0.0, 5.0 * k + 10, 10.0, 1.0 - k / (2 * n)) for k in range(n)]
    data += [(2, k, 5.0 * (k + k // 7), 0.0, 5.0 * (k + k // 7) + 10, 10.0, rnd.random()) for k in range(n)]
    cuts, plain = [], suppress.cut

    def counted(df):
        cuts.append(1)
        return plain(df)

    monkeypatch.setattr(suppress, "cut", counted)
    monkeypatch.setattr(suppress, "FOLD_EDGES", fold)
    whole = suppress.greedy_rounds
    monkeypatch.setattr(suppress, "greedy_rounds", lambda *a: whole(*a, fold_edges=fold))
    boxes = rows("image_id int, id int, x0 double, y0 double, x1 double, y1 double, score double", *data)
    got = {(r.image_id, r.id) for r in suppress.box_nms(boxes, 0.25, group_limit=10).collect()}
    want = set()
    for image in (1, 2):
        kept = []
        for r in sorted((r for r in data if r[0] == image), key=lambda r: (-r[6], r[1])):
            if all(min(r[4], k[4]) - max(r[2], k[2]) < 4 for k in kept):  # neighbours share 5 of 15
                kept.append(r)
        want |= {(image, r[1]) for r in kept}
    assert got == want
    assert fold == 5 or len(cuts) < 25
