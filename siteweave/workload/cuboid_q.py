"""Angles, camera, quad maps, orientation, cuboids, searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angles, camera, quadmap
from ..functions import geometry as G
from ..operators import orientation as O
from ..plans import centers, cuboid
from . import recipes as R
from .registry import query, with_

# ---- scalars ------------------------------------------------------------------------------

CLOCKS = """select event_id, concat(case when event_id%9=0 then ' ' else '' end, cast(event_id%14 as string), case event_id%5 when 0 then ':30' when 1 then ':00' when 2 then ':15' else '' end) as clock_text,
  cast(event_id*7%720-360 as double)/2 as angle, case event_id%6 when 0 then 'high' when 1 then ' Medium ' when 2 then cast(null as string) when 3 then 'low' else cast(value/40 as string) end as word,
  cast(event_id%1100-50 as double) as px, cast(event_id%7 as double) as py from {events}"""


@query(
    "clock_scalars",
    with_(R.cte("ev", CLOCKS))
    + """, p AS (SELECT *, CASE WHEN regexp_full_match(clock_text, '\\s*(\\d{1,2})(:(00|30))?\\s*') THEN regexp_extract(clock_text,'(\\d+)',1)::INT % 12 END AS h FROM ev),
q AS (SELECT *, round_even((((angle%360)+360)%360)/15,0)*15 % 360 AS sn FROM p),
r AS (SELECT *, CASE WHEN (3+sn/30)%12 <= 0.5 THEN (3+sn/30)%12+12 ELSE (3+sn/30)%12 END AS ch, ((-angle%360)+360)%360 AS yw FROM q)
SELECT event_id, CAST(CASE WHEN h=0 THEN 12 ELSE h END + CASE WHEN contains(clock_text,':30') THEN 0.5 ELSE 0 END AS DOUBLE) AS clock_hour, ch AS clock_of_angle,
  CAST(floor(ch) AS INTEGER)||':'||CASE WHEN abs(ch-floor(ch)-0.5)<1e-6 THEN '30' ELSE '00' END AS label, CASE WHEN yw>180 THEN yw-360 ELSE yw END AS yaw,
  CASE WHEN word IS NULL THEN 0.5 WHEN trim(lower(word))='high' THEN 0.9 WHEN trim(lower(word))='medium' THEN 0.6 WHEN trim(lower(word))='low' THEN 0.3 ELSE round(greatest(0::DOUBLE, least(1::DOUBLE, TRY_CAST(word AS DOUBLE))),9) END::DOUBLE AS confidence,
  CASE WHEN sqrt((greatest(0,least(1000,px))-greatest(0,least(1000,px+py-3)))**2+py*py) >= 3 THEN greatest(0,least(1000,px+py-3)) END AS pair_x1 FROM r""",
)
def clock_scalars(spark, d):
    e = R.derive(spark, d, CLOCKS)
    hour = angles.clock_of_angle(F.col("angle"))
    pair = angles.optional_pair((F.col("px"), G.dlit(0)), (F.col("px") + F.col("py") - 3, F.col("py")))
    return e.select(
        "event_id", angles.parse_clock(F.col("clock_text")).alias("clock_hour"), hour.alias("clock_of_angle"),
        angles.clock_label(hour).alias("label"), angles.yaw_of_angle(F.col("angle")).alias("yaw"),
        F.round(angles.confidence(F.col("word")), 9).alias("confidence"), pair["x1"].alias("pair_x1"),
    )


CAMERA = "select c_custkey as scene_id, cast(800+c_custkey*13%1700 as double) as width, cast(600+c_custkey*29%1500 as double) as height, cast(30+c_custkey%30 as double) as pitch_deg, cast(c_custkey%21-10 as double) as azimuth_deg, cast(60+c_custkey%50 as double) as scale, cast(88 as double)/100 as offset_ratio from {customer}"
POINTS = "select o_custkey as scene_id, o_orderkey as id, cast(o_orderkey*37%1000-500 as double)/100 as wx, cast(o_orderkey*53%900 as double)/100 as wy, cast(o_orderkey%7 as double)/10 as wz, cast(o_orderkey%360-180 as double) as yaw_deg from {orders}"


@query(
    "ground_projection",
    with_(R.cte("cam", CAMERA), R.cte("pt", POINTS))
    + """, t AS (SELECT *, radians(pitch_deg) AS p, radians(azimuth_deg) AS a FROM pt JOIN cam USING (scene_id)),
s AS (SELECT *, width/2+scale*(cos(a)*wx-sin(a)*wy) AS sx, height*offset_ratio-scale*(sin(p)*(sin(a)*wx+cos(a)*wy)+cos(p)*wz) AS sy FROM t),
g AS (SELECT *, (sx-width/2)/scale AS sh, (height*offset_ratio-sy)/(scale*sin(p)) AS fh FROM s)
SELECT scene_id, id, round(sx,6) AS sx, round(sy,6) AS sy, round(cos(p)*(sin(a)*wx+cos(a)*wy)-sin(p)*wz,6) AS depth, round(cos(a)*sh+sin(a)*fh,6) AS gx, round(-sin(a)*sh+cos(a)*fh,6) AS gy,
  round(cos(radians(yaw_deg-azimuth_deg))/greatest(sqrt(cos(radians(yaw_deg-azimuth_deg))**2+(sin(p)*sin(radians(yaw_deg-azimuth_deg)))**2),1e-9),6) AS axis_x FROM g""",
)
def ground_projection(spark, d):
    """World points through the camera and back to the ground."""
    t = R.derive(spark, d, POINTS).join(R.derive(spark, d, CAMERA), "scene_id")
    cam = camera.Camera()
    sx, sy = cam.project(F.col("wx"), F.col("wy"), F.col("wz"))
    t = t.withColumns({"sx": sx, "sy": sy, "depth": cam.depth(F.col("wx"), F.col("wy"), F.col("wz"))})
    gx, gy = cam.ground(F.col("sx"), F.col("sy"))
    axis = cam.ground_axis(F.col("yaw_deg"))[0]
    t = t.withColumns({"gx": gx, "gy": gy, "axis_x": axis})
    return t.select("scene_id", "id", *[F.round(c, 6).alias(c) for c in ("sx", "sy", "depth", "gx", "gy", "axis_x")])


# ---- quad mapping ----------------------------------------------------------------------------

QUADS = """select o_custkey as plan_id, o_orderkey as id, cast(100+o_orderkey%50 as double)/1000 as q0x, cast(100+o_orderkey%40 as double)/1000 as q0y, cast(400+o_orderkey%90 as double)/1000 as q1x, cast(120+o_orderkey%30 as double)/1000 as q1y,
  cast(420+o_orderkey%70 as double)/1000 as q2x, cast(350+o_orderkey%80 as double)/1000 as q2y, cast(90+o_orderkey%60 as double)/1000 as q3x, cast(330+o_orderkey%55 as double)/1000 as q3y, cast(2+o_orderkey%9 as double)/2 as ratio from {orders}"""
MAP_SQL = """, k0 AS (SELECT *, q1x-q2x AS dx1, q3x-q2x AS dx2, q0x-q1x+q2x-q3x AS dx3, q1y-q2y AS dy1, q3y-q2y AS dy2, q0y-q1y+q2y-q3y AS dy3 FROM qs),
k1 AS (SELECT *, (dx3*dy2-dx2*dy3)/(dx1*dy2-dx2*dy1) AS g0, (dx1*dy3-dx3*dy1)/(dx1*dy2-dx2*dy1) AS h FROM k0),
k2 AS (SELECT *, (q1x-q0x+g0*q1x)/ratio AS a, q3x-q0x+h*q3x AS b, q0x AS c, (q1y-q0y+g0*q1y)/ratio AS dd, q3y-q0y+h*q3y AS e, q0y AS f, g0/ratio AS g FROM k1)"""


def mapped(spark, d):
    q = R.derive(spark, d, QUADS)
    return quadmap.with_plane_to_image(q, G.quad("q"), F.col("ratio"))


@query(
    "quad_mapping",
    with_(R.cte("qs", QUADS)) + MAP_SQL
    + """ SELECT plan_id, id, round((a*ratio/2+b*0.5::DOUBLE+c)/(g*ratio/2+h*0.5::DOUBLE+1),6) AS mid_x, round((dd*ratio/2+e*0.5::DOUBLE+f)/(g*ratio/2+h*0.5::DOUBLE+1),6) AS mid_y,
  round(((e-f*h)*q2x+(c*h-b)*q2y+(b*f-c*e))/((dd*h-e*g)*q2x+(b*g-a*h)*q2y+(a*e-b*dd)),6) AS back_u, TRUE AS fits FROM k2""",
)
def quad_mapping(spark, d):
    """Rectangle centre in the image, a corner mapped back, and the fit error below 1e-8."""
    m = mapped(spark, d)
    mid = quadmap.to_image(F.col("ratio") / 2, G.dlit(0.5))
    back = quadmap.to_plane(F.col("q2x"), F.col("q2y"))
    return m.select(
        "plan_id", "id", F.round(mid[0], 6).alias("mid_x"), F.round(mid[1], 6).alias("mid_y"), F.round(back[0], 6).alias("back_u"),
        (quadmap.fit_error(G.quad("q"), F.col("ratio")) < 1e-8).alias("fits"),
    )


@query(
    "quad_grid_lines",
    with_(R.cte("qs", QUADS)) + MAP_SQL
    + """, ln AS (SELECT *, 'v' AS along, CAST(i AS DOUBLE)/4 AS station FROM k2, (SELECT unnest([1,2,3]) AS i) UNION ALL SELECT *, 'u', CAST(i AS DOUBLE)/4 FROM k2, (SELECT unnest(range(1,120)) AS i) WHERE i < least(120, ceil(ratio*4)) AND i/4.0 < ratio),
ep AS (SELECT *, CASE WHEN along='v' THEN 0 ELSE station END AS u0, CASE WHEN along='v' THEN station ELSE 0 END AS v0, CASE WHEN along='v' THEN ratio ELSE station END AS u1, CASE WHEN along='v' THEN station ELSE 1 END AS v1 FROM ln)
SELECT plan_id, id, along, station, CAST(floor((a*u0+b*v0+c)/(g*u0+h*v0+1)*1e9+0.5::DOUBLE) AS BIGINT) AS ix0, CAST(floor((dd*u0+e*v0+f)/(g*u0+h*v0+1)*1e9+0.5::DOUBLE) AS BIGINT) AS iy0, CAST(floor((a*u1+b*v1+c)/(g*u1+h*v1+1)*1e9+0.5::DOUBLE) AS BIGINT) AS ix1, CAST(floor((dd*u1+e*v1+f)/(g*u1+h*v1+1)*1e9+0.5::DOUBLE) AS BIGINT) AS iy1 FROM ep""",
)
def quad_grid_lines(spark, d):
    """Ends of the grid lines in billionths; both sides round by the same arithmetic, so ties agree."""
    g = quadmap.grid_lines(mapped(spark, d), F.col("ratio"))
    return g.select("plan_id", "id", "along", "station", *[F.floor(F.col(c) * 1e9 + 0.5).alias(c) for c in ("ix0", "iy0", "ix1", "iy1")])


# ---- orientation ---------------------------------------------------------------------------------

SEGS = """select event_id as seg_id, user_id as id, cast(event_id*37%311 as double) as xa, cast(event_id*53%293 as double) as ya, cast(event_id*71%307 as double) as xb, cast(event_id*89%283 as double) as yb,
  cast(30+user_id%30 as double) as pitch_deg, cast(user_id%21-10 as double) as azimuth_deg from {events}"""
VECS = """select distinct user_id as id, cast(user_id*37%200-100 as double) as dx, cast(user_id*53%200-99 as double) as dy, cast(30+user_id%30 as double) as pitch_deg, cast(user_id%21-10 as double) as azimuth_deg from {events}"""
SEG_SQL = """, l0 AS (SELECT *, xb-xa AS ddx, yb-ya AS ddy, sqrt((xb-xa)**2+(yb-ya)**2) AS length FROM sg WHERE sqrt((xb-xa)**2+(yb-ya)**2)>=10),
l1 AS (SELECT *, CASE WHEN ddy<0 OR (abs(ddy)<1e-6 AND ddx<0) THEN -1 ELSE 1 END AS s, radians(pitch_deg) AS p, radians(azimuth_deg) AS az FROM l0),
l2 AS (SELECT *, ddx*s AS ux, -(ddy*s)/greatest(sin(p),1e-6) AS fh FROM l1),
l3 AS (SELECT *, (degrees(atan2(-(-sin(az)*ux+cos(az)*fh), cos(az)*ux+sin(az)*fh))%360+360)%360 AS an FROM l2),
l4 AS (SELECT *, least(180, greatest(0, round_even((CASE WHEN an>180 THEN (an+180)%360 ELSE an END)/15,0)*15)) AS bucket FROM l3),
sup AS (SELECT id, bucket, sum(length) AS support, max_by(seg_id, length*100000000-seg_id) AS longest FROM l4 GROUP BY 1,2)"""


@query("segment_buckets", with_(R.cte("sg", SEGS)) + SEG_SQL + " SELECT id, bucket, round(support,4) AS support, longest FROM sup")
def segment_buckets(spark, d):
    r = O.rectified_segments(R.derive(spark, d, SEGS))
    s = r.groupBy("id", "bucket").agg(
        F.sum("length").alias("support"), F.max_by("seg_id", F.struct(F.col("length"), -F.col("seg_id"))).alias("longest")
    )
    return s.withColumn("support", F.round("support", 4))


def direction_table(spark, d):
    s = O.bucket_support(O.rectified_segments(R.derive(spark, d, SEGS)), ["id"])
    return O.directions(R.derive(spark, d, VECS), s, ["id"])


DIR_SQL = SEG_SQL + """, gr AS (SELECT id, CAST(k*15 AS DOUBLE) AS angle, chr(CAST(65+k AS INTEGER)) AS candidate FROM vc, (SELECT unnest(range(0,24)) AS k)),
pb AS (SELECT *, angle%180 AS bucket FROM gr UNION ALL SELECT *, 180 FROM gr WHERE angle%180=0),
dr AS (SELECT id, angle, candidate, round(coalesce(max(support),0),3) AS support FROM pb LEFT JOIN sup USING (id,bucket) GROUP BY 1,2,3)"""


@query("direction_candidates", with_(R.cte("sg", SEGS), R.cte("vc", VECS)) + DIR_SQL
       + ", c AS (SELECT *, CASE WHEN (3+angle/30)%12<=0.5 THEN (3+angle/30)%12+12 ELSE (3+angle/30)%12 END AS clock_hour FROM dr) SELECT id, angle, candidate, clock_hour, CAST(floor(clock_hour) AS INTEGER)||CASE WHEN clock_hour<>floor(clock_hour) THEN ':30' ELSE ':00' END AS clock, support FROM c")
def direction_candidates(spark, d):
    return direction_table(spark, d).select("id", "angle", "candidate", "clock_hour", "clock", "support")


@query(
    "direction_choice",
    with_(R.cte("sg", SEGS), R.cte("vc", VECS)) + DIR_SQL
    + """, v AS (SELECT *, -dy/greatest(sin(radians(pitch_deg)),1e-6) AS fh, radians(azimuth_deg) AS az FROM vc),
t AS (SELECT *, (degrees(atan2(-(-sin(az)*dx+cos(az)*fh), cos(az)*dx+sin(az)*fh))%360+360)%360 AS top FROM v),
i AS (SELECT dr.*, abs(((angle-top+180)%360+360)%360-180) AS deviation FROM dr JOIN t USING (id) WHERE cos(radians(angle))*(CASE WHEN dx>=0 THEN 1 ELSE -1 END) >= -1e-6 AND sin(radians(angle))*dy >= -1e-6),
s AS (SELECT *, support/greatest(max(support) OVER (PARTITION BY id),1)+1.1::DOUBLE*cos(radians(deviation)) AS score FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, deviation, support DESC, angle) AS rn FROM s)
SELECT id, candidate, angle, support, round(deviation,6) AS deviation, round(score,6) AS score FROM r WHERE rn=1""",
)
def direction_choice(spark, d):
    c = O.choose_direction(direction_table(spark, d), R.derive(spark, d, VECS), ["id"])
    return c.select("id", "candidate", "angle", "support", F.round("deviation", 6).alias("deviation"), F.round("score", 6).alias("score"))


ORI = """select o_custkey as doc_id, case when o_orderkey%31=0 then 'H0' else concat('H', o_orderkey) end as id, case when o_orderkey%13=0 then ' candidate  b ' when o_orderkey%29=0 then 'Z' else chr(cast(65+o_orderkey%24 as int)) end as candidate,
  case when o_orderkey%17=0 then 'up' when o_orderkey%2=0 then 'Right' else 'left' end as horizontal, case o_orderkey%4 when 0 then 'nearer' when 1 then 'farther' when 2 then 'same_depth' else 'far' end as depth from {orders}"""
ORI_EX = "select o_custkey as doc_id, concat('H', o_orderkey) as id from {orders}"


@query(
    "orientation_issues",
    with_(R.cte("rw", ORI), R.cte("ex", ORI_EX))
    + """, kn AS (SELECT *, regexp_replace(upper(trim(candidate)),'^CANDIDATE\\s+','') AS cn, lower(horizontal) AS h FROM rw WHERE (doc_id,id) IN (SELECT (doc_id,id) FROM ex)),
wa AS (SELECT *, CASE WHEN ascii(cn) BETWEEN 65 AND 88 THEN radians((ascii(cn)-65)*15) END AS rad FROM kn)
"""
    + "\nUNION ALL\n".join(
        [
            R.sql_duplicates("duplicate_orientation", "kn", "doc_id, id"),
            R.sql_issue("invalid_candidate", "wa WHERE rad IS NULL", distinct=True),
            R.sql_issue("invalid_side", "wa WHERE h NOT IN ('left','right')"),
            R.sql_issue("invalid_depth", "wa WHERE depth NOT IN ('nearer','same_depth','farther')"),
            R.sql_issue("side_contradicts", "wa WHERE h IN ('left','right') AND abs(cos(rad))>=0.2 AND h<>(CASE WHEN cos(rad)>0 THEN 'right' ELSE 'left' END)"),
            R.sql_issue("depth_contradicts", "wa WHERE depth<>'far' AND depth<>(CASE WHEN sin(rad)>0.2 THEN 'nearer' WHEN sin(rad)<-0.2 THEN 'farther' WHEN rad IS NOT NULL THEN 'same_depth' END)"),
            R.sql_issue("omitted", "ex WHERE (doc_id,id) NOT IN (SELECT (doc_id,id) FROM rw)", distinct=True),
        ]
    ).replace("CAST(doc_id AS VARCHAR), CAST(id AS VARCHAR), 'duplicate_orientation'", "CAST(doc_id AS VARCHAR) AS doc_id, CAST(id AS VARCHAR) AS entity_id, 'duplicate_orientation' AS rule"),
)
def orientation_issues(spark, d):
    ex = R.derive(spark, d, ORI_EX)
    letters = ex.select("doc_id", "id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("k")).select(
        "doc_id", "id", F.char(F.col("k") + 65).alias("candidate"), (F.col("k") * 15).cast("double").alias("angle")
    )
    return O.orientation_issues(R.derive(spark, d, ORI), letters, ex)


# ---- cuboids -----------------------------------------------------------------------------------------

ITEMS = """select o_custkey as scene_id, concat('H', o_orderkey) as id, o_orderkey as k, o_orderkey as pos, cast(o_orderkey*37%600 as double) as x0, cast(o_orderkey*53%400 as double) as y0, cast(o_orderkey*37%600+100+o_orderkey*17%300 as double) as x1, cast(o_orderkey*53%400+60+o_orderkey*29%180 as double) as y1,
  cast(o_orderkey*15%360-170 as double) as yaw_deg, cast(o_orderkey*37%600+20 as double) as e0x, cast(o_orderkey*53%400+90 as double) as e0y,
  cast(case when o_orderkey%3=0 then null else o_orderkey*37%600+20+o_orderkey%70 end as double) as e1x, cast(case when o_orderkey%3=0 then null else o_orderkey*53%400+90+o_orderkey%41-20 end as double) as e1y,
  cast(o_orderkey%10 as double)/10 as corner_confidence, o_orderkey%4=0 as fit_accepted, cast(6+o_orderkey%13 as double)/4 as fit_ratio from {orders}"""
PARTS = """select o_custkey as scene_id, concat('H', l_orderkey) as id, l_linenumber as pos, cast(l_orderkey*37%600+l_partkey%50 as double) as px, cast(10+l_suppkey%190 as double) as plen, cast(l_orderkey*53%400+l_partkey%40 as double) as py, cast(20+l_partkey%140 as double) as ph
  from {lineitem} join {orders} on l_orderkey=o_orderkey"""


def parts(spark, d):
    p = R.derive(spark, d, PARTS)
    return p.withColumn("poly", F.expr("array(named_struct('x',px,'y',py), named_struct('x',px+plen,'y',py+5), named_struct('x',px,'y',py+ph))"))


FOOT_SQL = with_(R.cte("it", ITEMS), R.cte("pa", PARTS)) + """, br AS (SELECT it.scene_id, it.id, max(greatest(py+5,py+ph)) AS bottom FROM it JOIN pa ON pa.scene_id=it.scene_id AND pa.id=it.id WHERE plen >= greatest(1,x1-x0)*0.25 GROUP BY 1,2),
fl AS (SELECT it.*, CASE WHEN bottom IS NULL THEN y1 ELSE least(y1, CASE WHEN bottom < y1-greatest(1,y1-y0)*0.25 THEN bottom+greatest(1,y1-y0)*0.15 ELSE bottom END) END AS ground_y FROM it LEFT JOIN br USING (scene_id,id))"""


@query("foot_lines", FOOT_SQL + " SELECT scene_id, id, round(ground_y,6) AS ground_y FROM fl")
def foot_lines(spark, d):
    f = cuboid.foot_lines(R.derive(spark, d, ITEMS), parts(spark, d), ["scene_id", "id"])
    return f.select("scene_id", "id", F.round("ground_y", 6).alias("ground_y"))


@query(
    "yaw_moments",
    with_(R.BUILDINGS, R.CORNERS)
    + ", m AS (SELECT plan_id, id, " + ", ".join(f"c{i}x, c{i}y" for i in range(4)) + ", (c0x+c1x+c2x+c3x)/4 AS mx, (c0y+c1y+c2y+c3y)/4 AS my FROM corners), v AS (SELECT plan_id, id, "
    + "+".join(f"(c{i}x-mx)**2" for i in range(4)) + " AS sxx, " + "+".join(f"(c{i}y-my)**2" for i in range(4)) + " AS syy, " + "+".join(f"(c{i}x-mx)*(c{i}y-my)" for i in range(4))
    + """ AS sxy FROM m), a AS (SELECT *, degrees(0.5::DOUBLE*atan2(round(2*sxy,6)+0.0::DOUBLE, round(sxx-syy,6)+0.0::DOUBLE)) AS an FROM v), f AS (SELECT *, CASE WHEN an>45 THEN an-90 WHEN an<-45 THEN an+90 ELSE an END AS fo FROM a)
SELECT plan_id, id, round(greatest(-12,least(12,fo)),3) AS yaw_deg FROM f""",
)
def yaw_moments(spark, d):
    """In-plane yaw of all footprint outlines."""
    from ..operators import spatial

    s = spatial.footprints(R.buildings(spark, d)).select("plan_id", "id", F.lit(0).alias("pos"), G.polygon_of(G.quad("c")).alias("poly"))
    return cuboid.contour_yaw(s, ["plan_id", "id"])


def observed(spark, d):
    f = cuboid.foot_lines(R.derive(spark, d, ITEMS), parts(spark, d), ["scene_id", "id"])
    return cuboid.observe(f.join(R.derive(spark, d, CAMERA), "scene_id"))


HOUSE_SQL = FOOT_SQL + ", " + R.cte("cam", CAMERA) + """, o0 AS (SELECT fl.*, width, height, scale, offset_ratio, azimuth_deg, radians(pitch_deg) AS p, radians(azimuth_deg) AS az, radians(yaw_deg-azimuth_deg) AS rl, radians(yaw_deg+90-azimuth_deg) AS rd FROM fl JOIN cam USING (scene_id)),
o1 AS (SELECT *, greatest(width*0.08, greatest(12,x1-x0)*0.78) AS broad, greatest(12, greatest(12,ground_y-y0)*0.32) AS wall, scale*sqrt(cos(rl)**2+(sin(p)*sin(rl))**2) AS ls, scale*sqrt(sin(rl)**2+(sin(p)*cos(rl))**2) AS ds,
  greatest(sqrt(cos(rd)**2+(sin(p)*sin(rd))**2),1e-9) AS an, least(height-1, ground_y) AS cpy FROM o0),
o2 AS (SELECT *, broad/ls AS len, coalesce(abs((e1x-e0x)*cos(rd)/an+(e1y-e0y)*(-sin(p)*sin(rd))/an),0) AS span, coalesce(sqrt((e1x-e0x)**2+(e1y-e0y)**2),0) AS nrm FROM o1),
o3 AS (SELECT *, CASE WHEN span/ds>1e-9 THEN len/(span/ds) END AS dr FROM o2),
o4 AS (SELECT *, coalesce(corner_confidence>=0.45 AND span>=greatest(6,greatest(12,x1-x0)*0.04) AND span/greatest(nrm,1e-9)>=cos(radians(35)) AND dr BETWEEN 1.15 AND 5.0, FALSE) AS by_corner FROM o3),
o5 AS (SELECT *, CASE WHEN by_corner THEN 'vlm_visible_short_end_ground_corners' WHEN fit_accepted THEN 'sam_silhouette_fixed_yaw_ratio_fit' ELSE 'fallback_3_to_1_unresolved_short_end' END AS depth_source, CASE WHEN by_corner THEN dr WHEN fit_accepted THEN fit_ratio ELSE 3 END AS ratio FROM o4),
hs AS (SELECT scene_id, id, k, yaw_deg, depth_source, ratio, len AS length, CASE WHEN by_corner THEN span ELSE len/ratio*ds END/ds AS depth, wall/(scale*cos(p)) AS hw, cpy,
  cos(az)*(((x0+x1)/2-width/2)/scale)+sin(az)*((height*offset_ratio-cpy)/(scale*sin(p))) AS cx, -sin(az)*(((x0+x1)/2-width/2)/scale)+cos(az)*((height*offset_ratio-cpy)/(scale*sin(p))) AS cy, width, height, scale, offset_ratio, p, az FROM o5)"""


@query("depth_source", HOUSE_SQL + " SELECT scene_id, id, depth_source, round(ratio,6) AS solved_ratio, round(span,6) AS corner_span FROM o5")
def depth_source(spark, d):
    o = observed(spark, d)
    return o.select("scene_id", "id", "depth_source", F.round("solved_ratio", 6).alias("solved_ratio"), F.round("corner_span", 6).alias("corner_span"))


@query("solved_houses", HOUSE_SQL + " SELECT scene_id, id, round(length,6) AS length, round(depth,6) AS depth, round(hw,6) AS height_world, round(cx,6) AS cx, round(cy,6) AS cy FROM hs")
def solved_houses(spark, d):
    h = cuboid.solve(observed(spark, d))
    return h.select("scene_id", "id", *[F.round(c, 6).alias(c) for c in ("length", "depth", "height_world", "cx", "cy")])


HSHAPE = ", sh AS (SELECT *, " + ", ".join(
    f"cx+({a})*length/2*cos(radians(yaw_deg))-({b})*depth/2*sin(radians(yaw_deg)) AS c{i}x, cy+({a})*length/2*sin(radians(yaw_deg))+({b})*depth/2*cos(radians(yaw_deg)) AS c{i}y"
    for i, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))
) + " FROM hs)"


@query(
    "visible_face_quads",
    HOUSE_SQL + HSHAPE + ", fc AS ("
    + " UNION ALL ".join(
        f"SELECT *, '{name}' AS face, {k} AS corner, c{c}x AS wx, c{c}y AS wy, {z}*hw AS wz FROM sh" + (f" WHERE yaw_deg {'>' if name == 'left' else '<='} 0" if name in ("left", "right") else "")
        for name, quad in {"front": [(0, 0), (1, 0), (1, 1), (0, 1)], "left": [(3, 0), (0, 0), (0, 1), (3, 1)], "right": [(1, 0), (2, 0), (2, 1), (1, 1)], "top": [(0, 1), (1, 1), (2, 1), (3, 1)]}.items()
        for k, (c, z) in enumerate(quad)
    )
    + ") SELECT scene_id, id, face, corner, round(width/2+scale*(cos(az)*wx-sin(az)*wy),4) AS sx, round(height*offset_ratio-scale*(sin(p)*(sin(az)*wx+cos(az)*wy)+cos(p)*wz),4) AS sy FROM fc",
)
def visible_face_quads(spark, d):
    f = cuboid.projected_faces(cuboid.solve(observed(spark, d)))
    return f.select("scene_id", "id", "face", "corner", F.round("sx", 4).alias("sx"), F.round("sy", 4).alias("sy"))


POND = "select c_custkey as scene_id, concat('W', c_custkey) as water_id, cast(20+c_custkey%30 as double)/100 as u from {customer}"


def ponds(spark, d):
    w = R.derive(spark, d, POND).join(R.derive(spark, d, CAMERA), "scene_id")
    w = w.withColumn("poly", F.expr("array(named_struct('x',u,'y',0.3D), named_struct('x',u+0.2D,'y',0.35D), named_struct('x',u+0.15D,'y',0.6D))"))
    return cuboid.water_footprints(w).select("scene_id", "water_id", "poly")


def _ground(x: str, y: str, n: int) -> str:
    sh, fh = f"(({x})*width-width/2)/scale", f"(height*offset_ratio-({y})*height)/(scale*sin(p))"
    return f"cos(az)*{sh}+sin(az)*{fh} AS p{n}x, -sin(az)*{sh}+cos(az)*{fh} AS p{n}y"


POND_SQL = ", " + R.cte("po", POND) + f", wf AS (SELECT po.scene_id, water_id, {_ground('u', '0.3::DOUBLE', 0)}, {_ground('u+0.2::DOUBLE', '0.35::DOUBLE', 1)}, {_ground('u+0.15::DOUBLE', '0.6::DOUBLE', 2)} FROM po JOIN (SELECT *, radians(pitch_deg) AS p, radians(azimuth_deg) AS az FROM cam) c USING (scene_id))"


@query("water_footprints", FOOT_SQL + ", " + R.cte("cam", CAMERA) + POND_SQL + " SELECT scene_id, water_id, round(p0x,6) AS p0x, round(p0y,6) AS p0y, round(p2x,6) AS p2x, round(p2y,6) AS p2y FROM wf")
def water_footprints(spark, d):
    p = ponds(spark, d)
    at = lambda i, c: F.round(F.col("poly")[i][c], 6)
    return p.select("scene_id", "water_id", at(0, "x").alias("p0x"), at(0, "y").alias("p0y"), at(2, "x").alias("p2x"), at(2, "y").alias("p2y"))


VIOL_SQL = HOUSE_SQL + HSHAPE + POND_SQL + f""", vi AS (SELECT CAST(scene_id AS VARCHAR) AS doc_id, id AS entity_id, 'length_not_above_depth' AS rule FROM hs WHERE NOT length>depth
UNION ALL SELECT CAST(a.scene_id AS VARCHAR), a.id||'<->'||b.id, 'solid_overlap' FROM sh a JOIN sh b ON a.scene_id=b.scene_id AND a.id<b.id WHERE {R.sql_quads_overlap('a', 'b', '0.01::DOUBLE', True)}
UNION ALL SELECT CAST(s.scene_id AS VARCHAR), s.id||'<->'||w.water_id, 'footprint_in_water' FROM sh s JOIN wf w ON w.scene_id=s.scene_id WHERE {' OR '.join(R.sql_contains(f's.c{i}x', f's.c{i}y', R.sql_poly('w', 3)) for i in range(4))})"""


def solved(spark, d):
    return cuboid.solve(observed(spark, d)).withColumn("cz", G.dlit(0))


@query("hard_constraints", VIOL_SQL + " SELECT doc_id, entity_id, rule FROM vi")
def hard_constraints(spark, d):
    return cuboid.hard_constraints(cuboid.cut_stage(solved(spark, d)), ponds(spark, d))


@query(
    "scene_metrics",
    VIOL_SQL
    + """, ft AS (SELECT c_custkey AS scene_id, CAST(c_custkey%20 AS DOUBLE)/100 AS change, 1-CAST(c_custkey%3 AS DOUBLE)/100 AS iou FROM customer)
SELECT h.scene_id, houses, above AS length_above_depth, coalesce(n,0) AS violations, change<0.16 AS geometry_gate, coalesce(change<0.16 AND coalesce(n,0)=0 AND iou>0.99, FALSE) AS accepted
FROM (SELECT scene_id, count(*) AS houses, bool_and(length>depth) AS above FROM hs GROUP BY 1) h LEFT JOIN (SELECT doc_id, count(*) AS n FROM vi GROUP BY 1) v ON v.doc_id=h.scene_id::VARCHAR LEFT JOIN ft USING (scene_id)""",
)
def scene_metrics(spark, d):
    h = cuboid.cut_stage(solved(spark, d))
    fits = R.table(spark, d, "customer").select(
        F.col("c_custkey").alias("scene_id"), F.expr("cast(c_custkey%20 as double)/100").alias("change"), F.expr("1-cast(c_custkey%3 as double)/100").alias("silhouette_iou")
    )
    m = cuboid.scene_metrics(h, cuboid.hard_constraints(h, ponds(spark, d)), fits)
    return m.select("scene_id", "houses", "length_above_depth", "violations", "geometry_gate", "accepted")


CON = """select o_custkey as doc_id, concat('H', o_orderkey) as id, cast(3+o_orderkey%4 as double) as length, cast(case when o_orderkey%23=0 then 9 else 1 end as double) as depth, cast(case when o_orderkey%29=0 then 4 else 3+o_orderkey%4 end as double) as solved_ratio,
  cast(case when o_orderkey%31=0 then 2 else 3+o_orderkey%4 end as double) as recorded_ratio, cast(o_orderkey%12 as double)/10 as body_scale, o_orderkey%37<>0 as uniform, o_orderkey%41<>0 as locked, cast(case when o_orderkey%43=0 then 1 else 0 end as double) as cz,
  case o_orderkey%5 when 0 then 'vlm_visible_short_end_ground_corners' when 1 then 'sam_silhouette_fixed_yaw_ratio_fit' when 2 then 'guess' else 'fallback_3_to_1_unresolved_short_end' end as depth_source, o_orderkey%2=0 as fit_accepted from {orders}"""
MET = "select c_custkey as doc_id, c_custkey%5<>0 as accepted, 4+c_custkey%2 as houses, 4 as detected, 4+c_custkey%3 as oriented, c_custkey%4 as violations, 1-cast(c_custkey%3 as double)/100 as silhouette_iou from {customer}"


@query(
    "contract_issues",
    with_(R.cte("h", CON), R.cte("m", MET))
    + "\nUNION ALL\n".join(
        [
            R.sql_issue("length_not_above_depth", "h WHERE NOT length>depth"), R.sql_issue("off_ground", "h WHERE cz<>0"), R.sql_issue("not_locked", "h WHERE NOT locked"),
            R.sql_issue("ratio_drifted", "h WHERE abs(length/depth-solved_ratio) > greatest(1e-9*greatest(length/depth,solved_ratio),1e-9)"),
            R.sql_issue("ratio_stale", "h WHERE abs(length/depth-recorded_ratio) > greatest(1e-6*greatest(length/depth,recorded_ratio),1e-6)"),
            R.sql_issue("scale_not_uniform", "h WHERE NOT uniform"), R.sql_issue("body_scale", "h WHERE NOT (body_scale>0 AND body_scale<=1)"), R.sql_issue("depth_source", "h WHERE depth_source='guess'"),
            R.sql_issue("rejected_fit_used", "h WHERE depth_source='sam_silhouette_fixed_yaw_ratio_fit' AND NOT fit_accepted"), R.sql_issue("fallback_ratio", "h WHERE depth_source='fallback_3_to_1_unresolved_short_end' AND abs(solved_ratio-3)>1e-9"),
            R.sql_issue("not_accepted", "m WHERE NOT accepted", entity="'metrics'"), R.sql_issue("detected_count", "m WHERE detected<>houses", entity="'metrics'"), R.sql_issue("oriented_count", "m WHERE oriented<>houses", entity="'metrics'"),
            R.sql_issue("violations", "m WHERE violations<>0", entity="'metrics'"), R.sql_issue("silhouette_iou", "m WHERE silhouette_iou<0.99", entity="'metrics'"),
        ]
    ),
)
def contract_issues(spark, d):
    return cuboid.contract_issues(R.derive(spark, d, CON), R.derive(spark, d, MET))


@query(
    "missing_outputs",
    "SELECT c_custkey AS scene_id, f.name FROM customer, (VALUES (0,'scene.json'),(1,'metrics.json'),(2,'top_view.png')) f(i,name) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderkey%3=f.i AND o_totalprice>50000)",
)
def missing_outputs(spark, d):
    """Required files without a non-empty listing entry."""
    names = F.array(F.lit("scene.json"), F.lit("metrics.json"), F.lit("top_view.png"))
    need = R.table(spark, d, "customer").select(F.col("c_custkey").alias("scene_id"), F.explode(names).alias("name"))
    found = R.table(spark, d, "orders").select(
        F.col("o_custkey").alias("scene_id"), F.element_at(names, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("name"),
        F.when(F.col("o_totalprice") > 50000, F.lit(10)).otherwise(0).alias("length"),
    )
    return cuboid.missing_files(need, found)


@query(
    "orientation_cover",
    with_(R.cte("a", ORI), R.cte("b", ORI_EX))
    + "SELECT DISTINCT doc_id, id, 'left_only' AS side FROM a WHERE (doc_id,id) NOT IN (SELECT (doc_id,id) FROM b) UNION ALL SELECT DISTINCT doc_id, id, 'right_only' FROM b WHERE (doc_id,id) NOT IN (SELECT (doc_id,id) FROM a)",
)
def orientation_cover(spark, d):
    return cuboid.exact_cover(R.derive(spark, d, ORI), R.derive(spark, d, ORI_EX), ["doc_id", "id"])


@query(
    "scene_documents",
    "SELECT o_custkey AS scene_id, 'houses' AS kind, 1 AS parts, 0 AS part, '['||string_agg('{\"id\":\"H'||lpad(o_orderkey::VARCHAR,8,'0')||'\",\"status\":\"'||o_orderstatus||'\"}', ',' ORDER BY o_orderkey)||']' AS entries FROM orders GROUP BY 1",
)
def scene_documents(spark, d):
    h = R.table(spark, d, "orders").select(
        F.col("o_custkey").alias("scene_id"), F.lit("houses").alias("kind"),
        F.format_string("H%08d", "o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
    )
    return cuboid.scene_documents(h)


@query("far_to_near", HOUSE_SQL + " SELECT scene_id, id, round(cos(p)*(sin(az)*cx+cos(az)*cy),6) AS view_depth FROM hs")
def far_to_near(spark, d):
    return cuboid.far_to_near(cuboid.solve(observed(spark, d))).select("scene_id", "id", F.round("view_depth", 6).alias("view_depth"))


# ---- centres to choose from ----------------------------------------------------------------------------


def fit_inputs(spark, d):
    from .spatial_q import boundaries

    b = R.buildings(spark, d)
    b = b.withColumns({"w": F.col("w") / 3, "d": F.col("d") / 3, "cx": F.col("cx") * 0.8 + 80, "cy": F.col("cy") * 0.8 + 80})
    # the zone whose quadrant holds the centre
    zone = F.concat(F.lit("Z"), (F.when(F.col("cx") > 490, 1).otherwise(0) + F.when(F.col("cy") > 490, 2).otherwise(0)).cast("string"))
    return b.withColumn("zone_id", zone), R.plan_zones(spark, d), boundaries(spark, d)


@query(
    "feasible_centers",
    with_(R.BUILDINGS, R.ZONES, R.PLAN_NATION, R.PLAN_ZONES)
    + """, b0 AS (SELECT * REPLACE (w/3 AS w, d/3 AS d, cx*0.8::DOUBLE+80 AS cx, cy*0.8::DOUBLE+80 AS cy) FROM buildings),
b1 AS (SELECT * REPLACE ('Z'||((CASE WHEN cx>490 THEN 1 ELSE 0 END)+(CASE WHEN cy>490 THEN 2 ELSE 0 END)) AS zone_id) FROM b0),
b2 AS (SELECT *, """ + R.sql_corners() + """ FROM b1),
sh AS (SELECT CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, CAST(dx*dx+dy*dy AS DOUBLE) AS distance, row_number() OVER (ORDER BY dx*dx+dy*dy, dx, dy) AS nr
  FROM (SELECT unnest(range(-40,41,2)) AS dx), (SELECT unnest(range(-40,41,2)) AS dy) WHERE dx*dx+dy*dy<=1600),
op AS (SELECT b2.plan_id, id, nr, distance, cx+dx AS ox, cy+dy AS oy FROM b2 JOIN plan_zones z ON z.plan_id=b2.plan_id AND z.zone_id=b2.zone_id, sh WHERE """
    + " AND ".join(
        f"{R.sql_contains(f'(c{i}x+dx)', f'(c{i}y+dy)', R.sql_poly('z', 4))} AND {R.sql_contains(f'(c{i}x+dx)', f'(c{i}y+dy)', [('20::DOUBLE', '20::DOUBLE'), ('980::DOUBLE', '30::DOUBLE'), ('970::DOUBLE', '980::DOUBLE'), ('10::DOUBLE', '960::DOUBLE')])}"
        for i in range(4)
    )
    + """), rk AS (SELECT *, row_number() OVER (PARTITION BY plan_id, id ORDER BY nr) AS rank FROM op)
SELECT plan_id, id, count(*) AS options, max(CASE WHEN rank=1 THEN ox END) AS nearest_x, max(CASE WHEN rank=1 THEN oy END) AS nearest_y, max(distance) AS farthest,
  CAST(sum(rank*distance) AS DOUBLE) AS ranked FROM rk GROUP BY 1,2""",
)
def feasible_centers(spark, d):
    """All feasible centres of every building in one row: how many, the nearest, the farthest, and a sum that holds every rank."""
    o = centers.feasible_centers(*fit_inputs(spark, d))
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    return o.groupBy("plan_id", "id").agg(
        F.count(F.lit(1)).alias("options"), first("ox").alias("nearest_x"), first("oy").alias("nearest_y"),
        F.max("distance").alias("farthest"), F.sum(F.col("rank") * F.col("distance")).alias("ranked"),
    )
