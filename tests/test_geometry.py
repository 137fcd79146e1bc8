import math
import random

import pytest
from pyspark.sql import functions as F

from siteweave.functions import angles, camera, coords, quadmap
from siteweave.functions import geometry as G
from siteweave.operators import spatial, tiles


def lits(*values):
    return tuple(F.lit(float(v)) for v in values)


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"v{i}") for i, c in enumerate(cols)]).first()


def test_map_point(spark):
    x, y = coords.to_source(lits(500, 500), lits(100, 200, 300, 600), lits(1000, 1000))
    assert tuple(one(spark, x, y)) == (200.0, 400.0)


def test_round_trip_and_clamp(spark):
    crop, size = lits(100, 200, 300, 600), lits(1000, 1000)
    out = coords.to_crop(lits(200, 400), crop, size)
    held = coords.to_crop(lits(900, 10), crop, size, clamp=True)
    assert tuple(one(spark, *out, *held)) == (500.0, 500.0, 1000.0, 0.0)


def test_to_pixels(spark):
    px = coords.to_pixels(lits(100, 200, 500, 800), lits(20, 50, 220, 250))
    assert tuple(one(spark, *px)) == (40.0, 90.0, 120.0, 210.0)


def test_expanded_crop(spark):
    crop = coords.expanded_crop(lits(100, 100, 300, 200), lits(1000, 1000))
    assert tuple(one(spark, *crop)) == (76.0, 85.0, 324.0, 245.0)


def test_audit_crop(spark):
    size = lits(1000, 1000)
    crop = coords.padded_crop(lits(755, 400, 1000, 500), size, (45, 45), (0.25, 0.5), clamp_first=True, high="ceil")
    assert tuple(one(spark, *crop)) == (693.0, 350.0, 1000.0, 550.0)


def test_clock_six_faces_down(spark):
    quad = G.rect_quad(*lits(100, 100, 40, 20, 6))
    got = [round(v, 9) for v in one(spark, *[c for p in quad for c in p])]
    assert got[1] == got[3] == 110.0 and abs(got[0] - got[2]) == 40.0


@pytest.mark.parametrize("gap,hit", [(-0.5, True), (0.0, False), (3.0, False)])
def test_touching_is_no_collision(spark, rows, gap, hit):
    b = rows("plan_id int, id int, cx double, cy double, w double, d double, clock double",
             (1, 1, 100.0, 100.0, 40.0, 20.0, 0.0), (1, 2, 140.0 + gap, 100.0, 40.0, 20.0, 0.0))
    assert (spatial.collisions(spatial.footprints(b)).count() == 1) is hit


def test_clearance_and_forgiveness(spark, rows):
    b = rows("plan_id int, id int, cx double, cy double, w double, d double, clock double",
             (1, 1, 100.0, 100.0, 40.0, 20.0, 0.0), (1, 2, 140.005, 100.0, 40.0, 20.0, 0.0), (2, 1, 0.0, 0.0, 10.0, 10.0, 0.0), (2, 2, 9.995, 0.0, 10.0, 10.0, 0.0))
    s = spatial.footprints(b)
    assert [r.plan_id for r in spatial.collisions(s, tolerance=-0.01, unit_axes=True).orderBy("plan_id").collect()] == [1, 2]
    assert spatial.collisions(s, tolerance=0.01, unit_axes=True).count() == 0


def test_contains_half_open(spark):
    square = F.expr("array(named_struct('x',0D,'y',0D),named_struct('x',10D,'y',0D),named_struct('x',10D,'y',10D),named_struct('x',0D,'y',10D))")
    pts = [(5, 5), (0, 5), (10, 5), (5, 0), (5, 10), (11, 5)]
    assert list(one(spark, *[G.contains(*lits(x, y), square) for x, y in pts])) == [True, True, False, True, False, False]


def test_convex_quad(spark):
    ok = [lits(0, 0), lits(10, 0), lits(10, 10), lits(0, 10)]
    bow = [ok[0], ok[1], ok[3], ok[2]]
    flat = [lits(0, 0), lits(5, 0), lits(10, 0), lits(0, 10)]
    assert list(one(spark, *[G.convex_quad(q) for q in (ok, ok[::-1], bow, flat)])) == [True, True, False, False]


def test_iou_denominators(spark):
    z = lits(0, 0, 0, 0)
    assert tuple(one(spark, G.iou(z, z), G.iou_clamped(z, z), G.iou_pixels(z, z))) == (0.0, 0.0, 0.0)
    a, b = lits(0, 0, 10, 10), lits(5, 0, 15, 10)
    assert one(spark, G.iou(a, b)).v0 == pytest.approx(1 / 3)
    assert one(spark, G.smaller_fraction(a, b)).v0 == 0.5


def test_tiles_cover_image(spark, rows):
    im = rows("image_id int, width double, height double", (1, 3946.0, 3716.0))
    t = {r.label: r for r in tiles.quadrant_tiles(im).collect()}
    assert set(t) == {"nw", "ne", "sw", "se"}
    assert t["nw"].tx0 == 0 and t["se"].tx1 == 3946 and t["se"].ty1 == 3716
    assert t["nw"].tx1 > t["ne"].tx0 and t["nw"].ty1 > t["sw"].ty0
    assert t["nw"].tx1 == 2210 and t["ne"].tx0 == 1736


def test_spaced_positions(spark):
    pos = tiles.spaced_positions(*lits(0, 1000, 430, 185))
    assert one(spark, pos).v0 == [0.0, 185.0, 370.0, 570.0]
    assert one(spark, tiles.spaced_positions(*lits(5, 100, 200, 10))).v0 == [5.0]


def test_quad_map_round_trip(spark):
    q = [lits(0.1, 0.2), lits(0.5, 0.15), lits(0.6, 0.5), lits(0.05, 0.45)]
    df = quadmap.with_plane_to_image(spark.range(1), q, F.lit(2.5))
    r = df.select(quadmap.fit_error(q, F.lit(2.5)).alias("e"), *quadmap.to_image(F.lit(2.5), F.lit(1.0))).first()
    assert r.e < 1e-8 and (r[1], r[2]) == (pytest.approx(0.6), pytest.approx(0.5))
    flat = [lits(0, 0), lits(0.1, 0), lits(0.2, 0), lits(0.3, 0)]
    assert quadmap.with_plane_to_image(spark.range(1), flat, F.lit(1.0)).first().m_h is None


def test_camera_round_trip(spark):
    cam = spark.range(1).select(
        F.lit(1200.0).alias("width"), F.lit(1000.0).alias("height"), F.lit(42.0).alias("pitch_deg"),
        F.lit(0.0).alias("azimuth_deg"), F.lit(80.0).alias("scale"), F.lit(0.88).alias("offset_ratio"))
    c = camera.Camera()
    df = cam.withColumns(dict(zip(("sx", "sy"), c.project(*lits(1.5, 2.5, 0)))))
    g = df.select(*c.ground(F.col("sx"), F.col("sy"))).first()
    assert (g[0], g[1]) == (pytest.approx(1.5, abs=1e-9), pytest.approx(2.5, abs=1e-9))


@pytest.mark.parametrize("angle,clock,yaw", [(0, "3:00", 0.0), (90, "6:00", -90.0), (180, "9:00", 180.0), (270, "12:00", 90.0), (285, "12:30", 75.0)])
def test_clock_and_yaw(spark, angle, clock, yaw):
    a = F.lit(float(angle))
    r = one(spark, angles.clock_label(angles.clock_of_angle(a)), angles.yaw_of_angle(a))
    assert (r.v0, r.v1) == (clock, yaw)


def test_parse_clock(spark, rows):
    df = rows("t string", ("3:30",), (" 12 ",), ("0",), ("4:15",), ("x",))
    assert [r[0] for r in df.select(angles.parse_clock(F.col("t"))).collect()] == [3.5, 12.0, 12.0, None, None]


def test_circular_difference(spark):
    assert one(spark, angles.circular_difference(*lits(350, 10))).v0 == 20.0


def test_nearest_matches_brute_force(spark, rows):
    rnd = random.Random(3)
    pts = [(p, i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for p in (1, 2) for i in range(40)]
    anc = [(p, i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for p in (1, 2) for i in range(25)]
    schema = "plan_id int, id int, ax double, ay double"
    got = {(r.plan_id, r.id): r.nearest for r in spatial.nearest_in_plan(rows(schema, *pts), rows(schema, *anc)).collect()}
    for p, i, x, y in pts:
        assert got[p, i] == min((math.hypot(a[2] - x, a[3] - y), a[1]) for a in anc if a[0] == p)[1]


def test_nearest_of_far_points_from_a_dense_plan(rows):
    rnd = random.Random(11)
    anc = [(1, k, rnd.gauss(500, 3), rnd.gauss(500, 3)) for k in range(400)] + [(1, 900 + k, 40.0 * k, 0.0) for k in range(20)] + [(2, 1, 5.0, 5.0)]
    pts = [(1, k, rnd.uniform(-2000, 3000), rnd.uniform(-2000, 3000)) for k in range(60)] + [(1, 100 + k, rnd.gauss(500, 4), rnd.gauss(500, 4)) for k in range(60)] + [(2, 1, 900.0, 0.0), (3, 1, 0.0, 0.0)]
    schema = "plan_id int, id int, ax double, ay double"
    got = {(r.plan_id, r.id): (r.nearest, r.distance) for r in spatial.nearest_in_plan(rows(schema, *pts), rows(schema, *anc)).collect()}
    for plan, i, x, y in pts:
        own = sorted((math.hypot(a[2] - x, a[3] - y), a[1]) for a in anc if a[0] == plan)
        assert ((plan, i) in got) == bool(own)
        if own:
            assert got[plan, i][0] == own[0][1] and abs(got[plan, i][1] - own[0][0]) < 1e-9


def test_nearest_with_one_outlier_and_a_dense_cluster(spark, rows, monkeypatch):
    """A third of all rows in one plan, one anchor far off, equal points and equal anchors; pairs stay in proportion to the rows."""
    rnd = random.Random(7)
    anc = [(1, k, rnd.gauss(0, 1), rnd.gauss(0, 1)) for k in range(3_000)] + [(1, 5_000, 1e7, 1e7)] + [(1, 6_000 + k, 0.25, 0.25) for k in range(40)]
    anc += [(2 + k % 50, k, rnd.random(), rnd.random()) for k in range(200)]
    pts = [(1, k, rnd.gauss(0, 2), rnd.gauss(0, 2)) for k in range(1_500)] + [(1, 2_000 + k, 9e6, 8e6) for k in range(50)] + [(1, 3_000 + k, 0.25, 0.25) for k in range(300)]
    pts += [(2 + k % 50, 9_000 + k, rnd.random(), rnd.random()) for k in range(300)]
    pairs, plain = [], spatial.spread_join

    def counted(big, small, keys, limit=1 << 16):
        out = plain(big, small, keys, 100)  # so that hot nodes are dealt out
        pairs.append(out.count())
        return out

    monkeypatch.setattr(spatial, "spread_join", counted)
    schema = "plan_id int, id int, ax double, ay double"
    found = spatial.nearest_in_plan(rows(schema, *pts), rows(schema, *anc), leaf=16)
    got = {(r.plan_id, r.id): (r.nearest, r.distance) for r in found.collect()}
    assert len(got) == len(pts) and sum(pairs) < 150 * len(pts)
    for plan, i, x, y in pts:
        d, k = min((math.hypot(a[2] - x, a[3] - y), a[1]) for a in anc if a[0] == plan)
        assert got[plan, i][0] == k and abs(got[plan, i][1] - d) <= 1e-9 * max(1, d)
    assert spatial.nearest_in_plan(rows(schema, (1, 1, 0.0, 0.0)), rows(schema)).count() == 0


def _inside(x, y, ring):
    return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def test_points_in_polygons_of_a_hot_plan_equal_brute_force(spark, rows):
    """One plan holds most points and polygons: tiny and huge ones, notches, points on edges and corners."""
    rnd = random.Random(17)
    rings = []
    for k in range(60):
        cx, cy, r = rnd.uniform(-500, 500), rnd.uniform(-500, 500), rnd.choice([0.5, 3, 40, 300])
        n = rnd.choice([3, 4, 9])
        rings.append((1 if k < 50 else 2, f"w{k}", [(cx + r * rnd.uniform(0.3, 1) * math.cos(6.283 * j / n), cy + r * rnd.uniform(0.3, 1) * math.sin(6.283 * j / n)) for j in range(n)]))
    rings += [(1, "square", [(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)]), (1, "line", [(0.0, 0.0), (9.0, 0.0)]), (1, "flat", [(0.0, 5.0), (9.0, 5.0), (4.0, 5.0)]), (3, "alone", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])]
    pts = [(1 if k < 500 else 2, k, rnd.uniform(-500, 500), rnd.uniform(-500, 500)) for k in range(600)]
    pts += [(1, 1_000 + k, float(x), float(y)) for k, (x, y) in enumerate((x, y) for x in (0, 16, 32, 64) for y in (0, 16, 40, 64))]
    pts += [(1, 2_000 + k, *ring[k % len(ring)]) for k, (p, _, ring) in enumerate(rings) if p == 1]
    b = rows("plan_id int, id int, cx double, cy double", *pts)
    waters = spark.createDataFrame([(p, n, [{"x": x, "y": y} for x, y in ring]) for p, n, ring in rings], "plan_id int, water_id string, poly array<struct<x:double,y:double>>")
    want = sorted((p, i, n) for p, i, x, y in pts for q, n, ring in rings if p == q and len(ring) > 2 and _inside(x, y, ring))
    for limit in (10**6, 100, 1):
        assert sorted(tuple(r) for r in spatial.water_hits(b, waters, limit).collect()) == want, limit
    quads = [(p, i, *(v for u, w in ((-5, -5), (5, -5), (5, 5), (-5, 5)) for v in (x + u, y + w))) for p, i, x, y in pts]
    shapes = rows("plan_id int, id int, " + ", ".join(f"c{i}{a} double" for i in range(4) for a in "xy"), *quads)
    wet = sorted((q[0], q[1], n) for q in quads for p, n, ring in rings if p == q[0] and len(ring) > 2 and any(_inside(q[2 + 2 * i], q[3 + 2 * i], ring) for i in range(4)))
    for limit in (10**6, 100):
        assert sorted(tuple(r) for r in spatial.footprint_in_water(shapes, waters, limit).collect()) == wet, limit
