"""Footprints, zones, water, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import ranking, spatial, summary
from . import recipes as R
from .registry import query, with_
from .rulesets import AUDIT_PRIOR, AUDITS, LANDMARKS, _claims  # noqa: F401


@query(
    "footprint_corners",
    with_(R.BUILDINGS, R.CORNERS) + "SELECT plan_id, id, " + ", ".join(f"round({c},6) AS {c}" for c in spatial.CORNERS) + " FROM corners",
)
def footprint_corners(spark, d):
    f = spatial.footprints(R.buildings(spark, d))
    return f.select("plan_id", "id", *[F.round(c, 6).alias(c) for c in spatial.CORNERS])


COLLIDE = f"SELECT a.plan_id, a.id AS id_a, b.id AS id_b FROM corners a JOIN corners b ON a.plan_id=b.plan_id AND a.id<b.id WHERE {R.sql_quads_overlap('a', 'b', '1e-6::DOUBLE')}"


@query("plan_collisions", with_(R.BUILDINGS, R.CORNERS) + COLLIDE)
def plan_collisions(spark, d):
    return spatial.collisions(spatial.footprints(R.buildings(spark, d)))


@query(
    "clearance_collisions",
    with_(R.BUILDINGS, R.CORNERS)
    + f"SELECT a.plan_id, a.id AS id_a, b.id AS id_b FROM corners a JOIN corners b ON a.plan_id=b.plan_id AND a.id<b.id WHERE {R.sql_quads_overlap('a', 'b', '(-5.0::DOUBLE)', True)}",
)
def clearance_collisions(spark, d):
    """Footprints closer than five units along some edge normal."""
    return spatial.collisions(spatial.footprints(R.buildings(spark, d)), tolerance=-5.0, unit_axes=True)


ZC = f"""zc AS (SELECT b.plan_id, b.id, b.zone_id, NOT {R.sql_contains("b.cx", "b.cy", R.sql_poly("z", 4))} AS off,
  {" + ".join(f"(NOT {R.sql_contains(f'b.c{i}x', f'b.c{i}y', R.sql_poly('z', 4))})::INT" for i in range(4))} AS n
  FROM corners b JOIN plan_zones z ON z.plan_id=b.plan_id AND z.zone_id=b.zone_id)"""
BOUND = [("20::DOUBLE", "20::DOUBLE"), ("980::DOUBLE", "30::DOUBLE"), ("970::DOUBLE", "980::DOUBLE"), ("10::DOUBLE", "960::DOUBLE")]
OUTSIDE = " OR ".join(f"NOT {R.sql_contains(f'c{i}x', f'c{i}y', BOUND)}" for i in range(4))
FINDINGS = f"""findings AS (
  SELECT plan_id, id_a AS id, 'building_overlap' AS kind, CAST(id_b AS VARCHAR) AS other, NULL::INT AS corners, 'major' AS severity FROM ({COLLIDE})
  UNION ALL SELECT plan_id, id, 'center_outside_support_zone', zone_id, NULL, 'major' FROM zc WHERE off
  UNION ALL SELECT plan_id, id, 'corners_outside_support_zone', zone_id, n, 'minor' FROM zc WHERE n>0
  UNION ALL SELECT plan_id, id, 'outside_plan_boundary', NULL, NULL, 'major' FROM corners WHERE {OUTSIDE}
  UNION ALL SELECT b.plan_id, b.id, 'center_in_water', w.water_id, NULL, 'major' FROM buildings b JOIN plan_waters w ON w.plan_id=b.plan_id WHERE {R.sql_contains("b.cx", "b.cy", R.sql_poly("w", 5))})"""
GEO = (R.BUILDINGS, R.CORNERS, R.ZONES, R.WATERS, R.PLAN_NATION, R.PLAN_ZONES, R.PLAN_WATERS, ZC, FINDINGS)


# small buildings in the zone of their quadrant: plans that can pass every geometric check
CALM = "buildings AS (SELECT * REPLACE ('Z'||((CASE WHEN cx>490 THEN 1 ELSE 0 END)+(CASE WHEN cy>490 THEN 2 ELSE 0 END)) AS zone_id) FROM (SELECT * REPLACE (w/20 AS w, d/20 AS d, cx*0.8::DOUBLE+80 AS cx, cy*0.8::DOUBLE+80 AS cy) FROM ("
CALM_BUILDINGS = CALM + R.BUILDINGS.removeprefix("buildings AS (").removesuffix(")") + ")))"
CALM_GEO = (CALM_BUILDINGS, *GEO[1:])


def calm_buildings(spark, d):
    b = R.buildings(spark, d)
    b = b.withColumns({"w": F.col("w") / 20, "d": F.col("d") / 20, "cx": F.col("cx") * 0.8 + 80, "cy": F.col("cy") * 0.8 + 80})
    zone = F.when(F.col("cx") > 490, 1).otherwise(0) + F.when(F.col("cy") > 490, 2).otherwise(0)
    return b.withColumn("zone_id", F.concat(F.lit("Z"), zone.cast("string")))


def calm_findings(spark, d):
    return spatial.geometry_checks(calm_buildings(spark, d), R.plan_zones(spark, d), R.plan_waters(spark, d), boundaries(spark, d))


def boundaries(spark, d):
    b = "array(named_struct('x',20D,'y',20D),named_struct('x',980D,'y',30D),named_struct('x',970D,'y',980D),named_struct('x',10D,'y',960D))"
    return R.plan_nation(spark, d).select("plan_id", F.expr(b).alias("poly"))


def findings(spark, d):
    return spatial.geometry_checks(R.buildings(spark, d), R.plan_zones(spark, d), R.plan_waters(spark, d), boundaries(spark, d))


@query("zone_containment", with_(*GEO) + "SELECT plan_id, id, kind, other, corners, severity FROM findings WHERE kind NOT IN ('building_overlap','center_in_water')")
def zone_containment(spark, d):
    return spatial.zone_checks(spatial.footprints(R.buildings(spark, d)), R.plan_zones(spark, d), boundaries(spark, d))


@query("water_hits", with_(*GEO) + "SELECT plan_id, id, other AS water_id FROM findings WHERE kind='center_in_water'")
def water_hits(spark, d):
    return spatial.water_hits(R.buildings(spark, d), R.plan_waters(spark, d))


@query("geometry_checks", with_(*GEO) + "SELECT plan_id, id, kind, other, corners, severity FROM findings")
def geometry_checks(spark, d):
    return findings(spark, d)


TERRAIN = "select o_custkey as plan_id, o_orderkey as id, case o_orderkey%3 when 0 then 'water' when 1 then 'mountain' else 'flat' end as category from {orders}"
TREES = "select o_custkey as plan_id, o_orderkey as id, cast(1 + o_orderkey%6 as bigint) as roots from {orders}"
PEND = "select o_custkey as plan_id, o_orderkey as id from {orders} where o_orderstatus = 'P' and o_totalprice > 250000"


@query(
    "geometry_report",
    with_(*GEO, R.cte("terrain", TERRAIN), R.cte("trees", TREES), R.cte("pend", PEND))
    + """SELECT plan_id, regions, houses, grouped, coalesce(terrain,0) AS terrain, coalesce(waters,0) AS waters, coalesce(tree_groups,0) AS tree_groups, coalesce(tree_roots,0) AS tree_roots,
  coalesce(pending,0) AS pending, coalesce(major,0) AS major, coalesce(minor,0) AS minor
FROM (SELECT plan_id, count(*) AS regions, count(*) FILTER (category='house') AS houses, count(*) FILTER (grouped) AS grouped FROM buildings GROUP BY 1) b
LEFT JOIN (SELECT plan_id, count(*) AS terrain, count(*) FILTER (category='water') AS waters FROM terrain GROUP BY 1) t USING (plan_id)
LEFT JOIN (SELECT plan_id, count(*) AS tree_groups, CAST(sum(roots) AS BIGINT) AS tree_roots FROM trees GROUP BY 1) r USING (plan_id)
LEFT JOIN (SELECT plan_id, count(*) AS pending FROM pend GROUP BY 1) p USING (plan_id)
LEFT JOIN (SELECT plan_id, count(*) FILTER (severity='major') AS major, count(*) FILTER (severity='minor') AS minor FROM findings GROUP BY 1) f USING (plan_id)""",
)
def geometry_report(spark, d):
    return summary.plan_report(
        R.buildings(spark, d), R.derive(spark, d, TERRAIN), R.derive(spark, d, TREES), R.derive(spark, d, PEND), findings(spark, d)
    )


PROBES = "select o_custkey as plan_id, o_orderkey as id, cast(o_orderkey*61%1000 as double) as ax, cast(o_orderkey*83%1000 as double) as ay from {orders}"


@query(
    "nearest_anchor",
    with_(R.BUILDINGS, R.cte("pr", PROBES))
    + """SELECT p.plan_id, p.id, min_by(b.id, sqrt((b.ax-p.ax)*(b.ax-p.ax)+(b.ay-p.ay)*(b.ay-p.ay))*1000000+b.id/1000000.0) AS nearest,
  round(min(sqrt((b.ax-p.ax)*(b.ax-p.ax)+(b.ay-p.ay)*(b.ay-p.ay))),6) AS distance FROM pr p JOIN buildings b ON b.plan_id=p.plan_id GROUP BY 1,2""",
)
def nearest_anchor(spark, d):
    out = spatial.nearest_in_plan(R.derive(spark, d, PROBES), R.buildings(spark, d))
    return out.select("plan_id", "id", "nearest", F.round("distance", 6).alias("distance"))


@query(
    "cell_partition",
    with_(R.BUILDINGS)
    + """SELECT plan_id, CAST(least(2, floor(ax*3/1000)) AS INTEGER) AS cell_x, CAST(least(2, floor(ay*3/1000)) AS INTEGER) AS cell_y, count(*) AS n,
  min(sx0) AS x0, min(sy0) AS y0, max(sx1) AS x1, max(sy1) AS y1 FROM buildings GROUP BY 1,2,3""",
)
def cell_partition(spark, d):
    """3×3 ownership cells with the union box of their buildings."""
    cx, cy = ranking.cell_of(F.col("ax"), F.col("ay"))
    b = R.buildings(spark, d)
    return b.groupBy("plan_id", cx.alias("cell_x"), cy.alias("cell_y")).agg(
        F.count(F.lit(1)).alias("n"), *G.union_box_aggs(G.box("s"))
    )


@query(
    "content_bounds",
    with_(R.BUILDINGS, R.CORNERS, R.ZONES, R.PLAN_NATION, R.PLAN_ZONES, R.cte("pr", PROBES))
    + ", pts AS ("
    + " UNION ALL ".join(f"SELECT plan_id, c{i}x AS x, c{i}y AS y FROM corners" for i in range(4))
    + "".join(f" UNION ALL SELECT plan_id, p{i}x, p{i}y FROM plan_zones" for i in range(4))
    + " UNION ALL SELECT plan_id, ax, ay FROM pr) SELECT plan_id, round(min(x)-24,6) AS x0, round(min(y)-24,6) AS y0, round(max(x)+24,6) AS x1, round(max(y)+24,6) AS y1 FROM pts GROUP BY 1",
)
def content_bounds(spark, d):
    shapes = spatial.footprints(R.buildings(spark, d)).select("plan_id", F.explode(G.polygon_of(G.quad("c"))).alias("p")).select("plan_id", "p.*")
    zones = R.plan_zones(spark, d).select("plan_id", F.explode("poly").alias("p")).select("plan_id", "p.*")
    roots = R.derive(spark, d, PROBES).select("plan_id", F.col("ax").alias("x"), F.col("ay").alias("y"))
    out = spatial.content_bounds([shapes, zones, roots])
    return out.select("plan_id", *[F.round(c, 6).alias(c) for c in G.BOX])


@query(
    "quad_edge_lengths",
    with_(R.cte("bl", R.BUILDING_TEXT_ROWS))
    + "SELECT doc_id, id, " + ", ".join(f"round(sqrt(((q{(i + 1) % 4}x-q{i}x)*1.6)**2+((q{(i + 1) % 4}y-q{i}y)*1.2)**2),6) AS e{i}" for i in range(4)) + " FROM bl",
)
def quad_edge_lengths(spark, d):
    """Pixel lengths of the footprint edges on a 1600×1200 view."""
    b = R.derive(spark, d, R.BUILDING_TEXT_ROWS)
    q = [(x * 1600 / 1000, y * 1200 / 1000) for x, y in G.quad("q")]
    return b.select("doc_id", "id", *[F.round(e, 6).alias(f"e{i}") for i, e in enumerate(G.quad_edges(q))])


@query(
    "category_counts",
    with_(R.OBJECTS) + "SELECT run_id, category, count(*) AS n FROM objects GROUP BY 1,2",
)
def category_counts(spark, d):
    return summary.counts(R.objects(spark, d), ["run_id"], "category")


@query(
    "review_summary",
    with_(R.OBJECTS, R.CLAIMS)
    + """, o AS (SELECT image_id, count(*) AS objects, count(*) FILTER (category='house') AS houses, count(*) FILTER (review_status='uncertain') AS uncertain,
    min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM objects GROUP BY 1),
m AS (SELECT plan_id AS image_id, count(*) FILTER (n>1) AS merged_groups FROM (SELECT plan_id, owner, count(*) AS n FROM claims WHERE owner IS NOT NULL GROUP BY 1,2) GROUP BY 1),
r AS (SELECT plan_id AS image_id, count(*) AS rejected FROM claims WHERE owner IS NULL GROUP BY 1)
SELECT image_id, objects, houses, uncertain, x0, y0, x1, y1, coalesce(merged_groups,0) AS merged_groups, coalesce(rejected,0) AS rejected FROM o LEFT JOIN m USING (image_id) LEFT JOIN r USING (image_id)""",
)
def review_summary(spark, d):
    c = R.claims(spark, d).withColumnRenamed("plan_id", "image_id")
    o = R.objects(spark, d).withColumnRenamed("review_status", "status")
    refs = c.filter("owner is not null").withColumnRenamed("owner", "id")
    return summary.review_summary(o, refs, c.filter("owner is null"), ["image_id"])


@query(
    "gallery_summary",
    with_(R.cte("st", "select o_custkey as doc_id, concat('o', o_orderkey) as id, case when o_orderkey%3=0 then 'house' else 'tree' end as category, o_orderkey%2 as hidden, case when o_orderkey%5=3 then 'unknown' else 'polygon' end as kind from {orders}"), R.cte("au", AUDITS))
    + """SELECT * FROM (SELECT doc_id, count(*) AS objects, count(*) FILTER (category='house') AS houses, count(*) FILTER (hidden>0) AS with_hidden_paths, count(*) FILTER (category='house' AND kind='polygon') AS polygon_houses FROM st GROUP BY 1)
JOIN (SELECT au.doc_id, count(*) FILTER (verdict='plausible') AS plausible, count(*) FILTER (verdict='needs_review') AS needs_review, count(*) FILTER (verdict='reject') AS rejected, count(*) FILTER (safe AND coalesce(category='house',FALSE)) AS safe_houses
  FROM au LEFT JOIN st ON st.doc_id=au.doc_id AND st.id=au.id GROUP BY 1) USING (doc_id)""",
)
def gallery_summary(spark, d):
    st = R.derive(spark, d, "select o_custkey as doc_id, concat('o', o_orderkey) as id, case when o_orderkey%3=0 then 'house' else 'tree' end as category, o_orderkey%2 as hidden, case when o_orderkey%5=3 then 'unknown' else 'polygon' end as kind from {orders}")
    return summary.gallery_summary(st, R.derive(spark, d, AUDITS))


@query(
    "ground_summary",
    with_(R.CLAIMS, R.cte("lm", LANDMARKS))
    + """SELECT l.doc_id, ground AS n_ground, occlusion AS n_occlusion, upper_ AS n_upper, unk AS n_unknown, coalesce(instances,0) AS instances, coalesce(merged_groups,0) AS merged_groups, coalesce(rejected,0) AS rejected
FROM (SELECT doc_id, count(*) FILTER (level='ground') AS ground, count(*) FILTER (level='occlusion') AS occlusion, count(*) FILTER (level='upper') AS upper_, count(*) FILTER (level='unknown') AS unk FROM lm GROUP BY 1) l
LEFT JOIN (SELECT plan_id AS doc_id, count(*) AS instances, count(*) FILTER (n>1) AS merged_groups FROM (SELECT plan_id, owner, count(*) AS n FROM claims WHERE owner IS NOT NULL GROUP BY 1,2) GROUP BY 1) g ON g.doc_id=l.doc_id
LEFT JOIN (SELECT plan_id AS doc_id, count(*) AS rejected FROM claims WHERE owner IS NULL GROUP BY 1) r ON r.doc_id=l.doc_id""",
)
def ground_summary(spark, d):
    c = _claims(spark, d)
    return summary.ground_summary(
        R.derive(spark, d, LANDMARKS), c.filter("owner is not null").withColumnRenamed("owner", "id"), c.filter("owner is null")
    )
