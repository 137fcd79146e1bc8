"""Tiles, coordinate maps, crops, pair joins, suppression, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords
from ..functions import geometry as G
from ..operators import graph, masks, overlap, proposals, ranking, suppress, tiles
from . import recipes as R
from .registry import query, with_

# ---- tiles and coordinates -----------------------------------------------------------

TILES_SQL = """tiles AS (
  SELECT image_id, width, height, 'nw' AS label, 0::DOUBLE AS tx0, 0::DOUBLE AS ty0, round_even(width/2+width*0.06,0) AS tx1, round_even(height/2+height*0.06,0) AS ty1 FROM images
  UNION ALL SELECT image_id, width, height, 'ne', round_even(width/2-width*0.06,0), 0, width, round_even(height/2+height*0.06,0) FROM images
  UNION ALL SELECT image_id, width, height, 'sw', 0, round_even(height/2-height*0.06,0), round_even(width/2+width*0.06,0), height FROM images
  UNION ALL SELECT image_id, width, height, 'se', round_even(width/2-width*0.06,0), round_even(height/2-height*0.06,0), width, height FROM images)"""


@query(
    "tile_explode",
    with_(R.IMAGES, TILES_SQL) + "SELECT image_id, label, tx0, ty0, tx1, ty1 FROM tiles",
)
def tile_explode(spark, d):
    return tiles.quadrant_tiles(R.images(spark, d)).select("image_id", "label", "tx0", "ty0", "tx1", "ty1")


@query(
    "corner_views",
    with_(R.IMAGES)
    + """, v AS (SELECT *, round_even(width*0.68,0) AS tw, round_even(height*0.68,0) AS th FROM images)
SELECT image_id, 'full' AS label, 0::DOUBLE AS tx0, 0::DOUBLE AS ty0, width AS tx1, height AS ty1 FROM v
UNION ALL SELECT image_id, 'tile_r'||r||'_c'||c, c*(width-tw), r*(height-th), c*(width-tw)+tw, r*(height-th)+th
FROM v, (SELECT unnest([0,1]) AS r), (SELECT unnest([0,1]) AS c)""",
)
def corner_views(spark, d):
    return tiles.corner_views(R.images(spark, d)).select("image_id", "label", "tx0", "ty0", "tx1", "ty1")


@query(
    "sliding_tiles",
    with_(R.IMAGES, recursive=True)
    + """, s AS (SELECT image_id, width, height, least(width, greatest(256, round_even(width*0.43,0))) AS tw,
  least(height, greatest(256, round_even(height*0.50,0))) AS th, greatest(64, round_even(width*0.185,0)) AS sx,
  greatest(48, round_even(height*0.08,0)) AS sy, greatest(0, round_even(height*0.30,0)) AS top,
  least(height, round_even(height*0.88,0)) AS bottom FROM images),
xs AS (
  SELECT image_id, 0 AS c, 0::DOUBLE AS x FROM s
  UNION ALL SELECT xs.image_id, c+1, CASE WHEN x+sx+tw+sx<=width THEN x+sx ELSE width-tw END
  FROM xs JOIN s USING (image_id) WHERE tw<width AND x<width-tw),
ys AS (
  SELECT image_id, 0 AS r, CASE WHEN th>=bottom-top THEN top WHEN top+th+sy<=bottom THEN top ELSE bottom-th END AS y FROM s
  UNION ALL SELECT ys.image_id, r+1, CASE WHEN y+sy+th+sy<=bottom THEN y+sy ELSE bottom-th END
  FROM ys JOIN s USING (image_id) WHERE th<bottom-top AND y<bottom-th)
SELECT image_id, 'full' AS label, 0::DOUBLE AS tx0, 0::DOUBLE AS ty0, width AS tx1, height AS ty1 FROM s
UNION ALL SELECT image_id, printf('tile_r%02d_c%02d', r, c), x, y, x+tw, y+th FROM s JOIN xs USING (image_id) JOIN ys USING (image_id)""",
)
def sliding_tiles(spark, d):
    return tiles.sliding_tiles(R.images(spark, d)).select("image_id", "label", "tx0", "ty0", "tx1", "ty1")


def tiled_boxes(spark, d):
    """Every box answered in one of the four tiles of its image."""
    t = tiles.quadrant_tiles(R.images(spark, d))
    b = R.boxes(spark, d).withColumn("label", F.expr("element_at(array('nw','ne','sw','se'), cast(id % 4 as int) + 1)"))
    return b.join(t, ["image_id", "label"])


TILED_SQL = "tiled AS (SELECT b.*, t.* EXCLUDE (image_id) FROM (SELECT *, ['nw','ne','sw','se'][CAST(id%4 AS INT)+1] AS lb FROM boxes) b JOIN tiles t ON t.image_id=b.image_id AND t.label=b.lb)"


@query(
    "tile_to_source",
    with_(R.IMAGES, R.BOXES, TILES_SQL, TILED_SQL)
    + """SELECT image_id, id, label,
  round((tx0 + x0*(tx1-tx0)/1000)/width*1000, 3) AS src_x0, round((ty0 + y0*(ty1-ty0)/1000)/height*1000, 3) AS src_y0,
  round((tx0 + x1*(tx1-tx0)/1000)/width*1000, 3) AS src_x1, round((ty0 + y1*(ty1-ty0)/1000)/height*1000, 3) AS src_y1,
  tx0 + x0*(tx1-tx0)/1000 AS px_x0, ty0 + y1*(ty1-ty0)/1000 AS px_y1 FROM tiled""",
)
def tile_to_source(spark, d):
    t = tiled_boxes(spark, d)
    crop = tuple(F.col(c) for c in ("tx0", "ty0", "tx1", "ty1"))
    size = (F.col("width"), F.col("height"))
    lo = coords.to_source((F.col("x0"), F.col("y0")), crop, size)
    hi = coords.to_source((F.col("x1"), F.col("y1")), crop, size)
    px = coords.to_pixels(G.box(), crop)
    return t.select(
        "image_id", "id", "label",
        lo[0].alias("src_x0"), lo[1].alias("src_y0"), hi[0].alias("src_x1"), hi[1].alias("src_y1"),
        px[0].alias("px_x0"), px[3].alias("px_y1"),
    )


@query(
    "source_to_tile",
    with_(R.IMAGES, R.BOXES, TILES_SQL, TILED_SQL)
    + """, l AS (SELECT image_id, id, label, round((x0*width/1000-tx0)*1000/(tx1-tx0),3) AS lx, round((y0*height/1000-ty0)*1000/(ty1-ty0),3) AS ly FROM tiled)
SELECT *, greatest(0, least(1000, lx)) AS held_x, greatest(0, least(1000, ly)) AS held_y FROM l""",
)
def source_to_tile(spark, d):
    t = tiled_boxes(spark, d)
    crop = tuple(F.col(c) for c in ("tx0", "ty0", "tx1", "ty1"))
    p, size = (F.col("x0"), F.col("y0")), (F.col("width"), F.col("height"))
    free, held = coords.to_crop(p, crop, size), coords.to_crop(p, crop, size, clamp=True)
    return t.select(
        "image_id", "id", "label", free[0].alias("lx"), free[1].alias("ly"),
        held[0].alias("held_x"), held[1].alias("held_y"),
    )


@query(
    "remapped_boxes",
    with_(R.IMAGES, R.BOXES, TILES_SQL, TILED_SQL)
    + """, e AS (SELECT *, greatest(0, round_even(tx0-(tx1-tx0)*0.12,0)) AS n0, greatest(0, round_even(ty0-(ty1-ty0)*0.15,0)) AS n1,
    least(width, round_even(tx1+(tx1-tx0)*0.12,0)) AS n2, least(height, round_even(ty1+(ty1-ty0)*0.45,0)) AS n3 FROM tiled)
SELECT image_id, id, n0, n1, n2, n3, round((tx0+x0*(tx1-tx0)/1000-n0)*1000/(n2-n0),6) AS r0, round((ty0+y0*(ty1-ty0)/1000-n1)*1000/(n3-n1),6) AS r1,
  round((tx0+x1*(tx1-tx0)/1000-n0)*1000/(n2-n0),6) AS r2, round((ty0+y1*(ty1-ty0)/1000-n1)*1000/(n3-n1),6) AS r3 FROM e""",
)
def remapped_boxes(spark, d):
    """Tile boxes moved to a wider crop around the tile."""
    t = tiled_boxes(spark, d)
    crop = tuple(F.col(c) for c in ("tx0", "ty0", "tx1", "ty1"))
    wide = coords.expanded_crop(crop, (F.col("width"), F.col("height")))
    t = t.withColumns({f"n{i}": c for i, c in enumerate(wide)})
    new = coords.remap(G.box(), crop, tuple(F.col(f"n{i}") for i in range(4)))
    return t.select("image_id", "id", "n0", "n1", "n2", "n3", *[F.round(c, 6).alias(f"r{i}") for i, c in enumerate(new)])


# ---- crops ----------------------------------------------------------------------------

GROUPED_SQL = """g AS (SELECT image_id, id%3 AS grp, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM boxes GROUP BY 1,2), gs AS (SELECT g.*, width, height FROM g JOIN images USING (image_id))"""


def grouped_boxes(spark, d):
    g = R.boxes(spark, d).groupBy("image_id", (F.col("id") % 3).alias("grp")).agg(*G.union_box_aggs())
    return g.join(R.images(spark, d).select("image_id", "width", "height"), "image_id")


def _crop_cols(crop):
    return [c.alias(n) for n, c in zip(("c0", "c1", "c2", "c3"), crop)]


@query(
    "audit_crop",
    with_(R.IMAGES, R.BOXES, GROUPED_SQL)
    + """SELECT image_id, grp, floor(greatest(0, x0-greatest(45,(x1-x0)*0.25))*width/1000) AS c0,
  floor(greatest(0, y0-greatest(45,(y1-y0)*0.5))*height/1000) AS c1,
  ceil(least(1000, x1+greatest(45,(x1-x0)*0.25))*width/1000) AS c2,
  ceil(least(1000, y1+greatest(45,(y1-y0)*0.5))*height/1000) AS c3 FROM gs""",
)
def audit_crop(spark, d):
    """Union box of a group with context for the whole support chain."""
    size = (F.col("width"), F.col("height"))
    crop = coords.padded_crop(G.box(), size, (45, 45), (0.25, 0.5), clamp_first=True, high="ceil")
    return grouped_boxes(spark, d).select("image_id", "grp", *_crop_cols(crop))


@query(
    "cell_crop",
    with_(R.IMAGES, R.BOXES, GROUPED_SQL)
    + """SELECT image_id, grp, greatest(0, trunc((x0-greatest(20,(x1-x0)*0.1))*width/1000)) AS c0,
  greatest(0, trunc((y0-greatest(20,(y1-y0)*0.15))*height/1000)) AS c1,
  least(width, floor((x1+greatest(20,(x1-x0)*0.1))*width/1000)) AS c2,
  least(height, floor((y1+greatest(20,(y1-y0)*0.15))*height/1000)) AS c3 FROM gs""",
)
def cell_crop(spark, d):
    crop = coords.padded_crop(G.box(), (F.col("width"), F.col("height")), (20, 20), (0.1, 0.15))
    return grouped_boxes(spark, d).select("image_id", "grp", *_crop_cols(crop))


@query(
    "focus_crop",
    with_(R.IMAGES, R.BOXES, GROUPED_SQL)
    + """SELECT image_id, grp, floor(greatest(0, x0-25)*width/1000) AS c0, floor(greatest(0, y0-25)*height/1000) AS c1,
  least(width, ceil(least(1000, x1+25)*width/1000)) AS c2, least(height, ceil(least(1000, y1+25)*height/1000)) AS c3 FROM gs""",
)
def focus_crop(spark, d):
    crop = coords.padded_crop(G.box(), (F.col("width"), F.col("height")), (25, 25), (0, 0), clamp_first=True, high="ceil")
    return grouped_boxes(spark, d).select("image_id", "grp", *_crop_cols(crop))


@query(
    "building_crop",
    with_(R.IMAGES, R.BOXES)
    + """SELECT image_id, id, greatest(0, trunc((x0-(x1-x0)*0.25)*width/1000)) AS c0, greatest(0, trunc((y0-(y1-y0)*0.3)*height/1000)) AS c1,
  least(width, ceil((x1+(x1-x0)*0.25)*width/1000)) AS c2, least(height, ceil((y1+(y1-y0)*0.3)*height/1000)) AS c3
FROM boxes JOIN images USING (image_id)""",
)
def building_crop(spark, d):
    b = R.boxes(spark, d).join(R.images(spark, d).select("image_id", "width", "height"), "image_id")
    crop = coords.padded_crop(G.box(), (F.col("width"), F.col("height")), (0, 0), (0.25, 0.3), high="ceil")
    return b.select("image_id", "id", *_crop_cols(crop))


@query(
    "context_crop",
    with_(R.IMAGES, R.BOXES)
    + """, c AS (SELECT image_id, id, x0, y0, x1, y1, greatest(0, floor(x0-greatest(40,(x1-x0)*0.35))) AS c0, greatest(0, floor(y0-greatest(40,(y1-y0)*0.45))) AS c1,
  least(width, ceil(x1+greatest(40,(x1-x0)*0.35))) AS c2, least(height, ceil(y1+greatest(40,(y1-y0)*0.45))) AS c3
FROM boxes JOIN images USING (image_id))
SELECT image_id, id, c0, c1, c2, c3, round((x0-c0)/greatest(c2-c0,1),6) AS t0, round((y0-c1)/greatest(c3-c1,1),6) AS t1,
  round((x1-c0)/greatest(c2-c0,1),6) AS t2, round((y1-c1)/greatest(c3-c1,1),6) AS t3 FROM c""",
)
def context_crop(spark, d):
    """Pixel crop around a mask box and the box in its frame."""
    b = R.boxes(spark, d).join(R.images(spark, d).select("image_id", "width", "height"), "image_id")
    crop = coords.padded_crop(
        G.box(), (F.col("width"), F.col("height")), (40, 40), (0.35, 0.45), scale=None, high="ceil"
    )
    b = b.withColumns({f"c{i}": c for i, c in enumerate(crop)})
    w, h = F.greatest(F.col("c2") - F.col("c0"), G.dlit(1)), F.greatest(F.col("c3") - F.col("c1"), G.dlit(1))
    t = [(F.col("x0") - F.col("c0")) / w, (F.col("y0") - F.col("c1")) / h, (F.col("x1") - F.col("c0")) / w, (F.col("y1") - F.col("c1")) / h]
    return b.select("image_id", "id", "c0", "c1", "c2", "c3", *[F.round(v, 6).alias(f"t{i}") for i, v in enumerate(t)])


# ---- proposals -------------------------------------------------------------------------


@query(
    "normalized_proposals",
    with_(R.IMAGES, R.BOXES, TILES_SQL, TILED_SQL)
    + """, h AS (SELECT *, greatest(0, least(1000, x0*1.4-200)) AS h0, greatest(0, least(1000, y0*1.4-200)) AS h1,
      greatest(0, least(1000, x1*1.4-200)) AS h2, greatest(0, least(1000, y1*1.4-200)) AS h3 FROM tiled),
p AS (SELECT *, tx0+h0*(tx1-tx0)/1000 AS q0, ty0+h1*(ty1-ty0)/1000 AS q1, tx0+h2*(tx1-tx0)/1000 AS q2, ty0+h3*(ty1-ty0)/1000 AS q3 FROM h WHERE h2>h0 AND h3>h1)
SELECT image_id, id, label, round(q0,6) AS x0, round(q1,6) AS y0, round(q2,6) AS x1, round(q3,6) AS y1,
  round(greatest(0.01, least(1, coalesce(CASE WHEN id%7=0 THEN NULL ELSE score*1.2 END, 0.5))),6) AS score
FROM p WHERE (q2-q0)*(q3-q1)/greatest(width*height,1) BETWEEN 0.001 AND 0.16""",
)
def normalized_proposals(spark, d):
    raw = tiled_boxes(spark, d).withColumns({c: F.col(c) * 1.4 - 200 for c in G.BOX})
    raw = raw.withColumn("confidence", F.when(F.col("id") % 7 != 0, F.col("score") * 1.2))
    out = proposals.normalize_proposals(raw)
    return out.select("image_id", "id", "label", *[F.round(c, 6).alias(c) for c in G.BOX], "score")


@query(
    "plausible_proposals",
    with_(R.IMAGES, R.BOXES)
    + """SELECT image_id, id FROM boxes JOIN images USING (image_id)
WHERE (x1-x0)*(y1-y0)/greatest(width*height,1) BETWEEN 0.0015 AND 0.14 AND x1-x0 <= width*0.48 AND y1-y0 <= height*0.38""",
)
def plausible_proposals(spark, d):
    b = R.boxes(spark, d).join(R.images(spark, d).select("image_id", "width", "height"), "image_id")
    return proposals.plausible_size(b).select("image_id", "id")


@query(
    "context_variants",
    with_(R.IMAGES, R.BOXES)
    + """SELECT image_id, id AS family, variant, round(greatest(0, x0-l*greatest(x1-x0,1)),2) AS x0, round(greatest(0, y0-u*greatest(y1-y0,1)),2) AS y0,
  round(least(width, x1+r*greatest(x1-x0,1)),2) AS x1, round(least(height, y1+dn*greatest(y1-y0,1)),2) AS y1
FROM boxes JOIN images USING (image_id),
 (VALUES ('original',0::DOUBLE,0::DOUBLE,0::DOUBLE,0::DOUBLE), ('roof_wall_recovery',0.08::DOUBLE,0.80::DOUBLE,0.08::DOUBLE,0.12::DOUBLE), ('balanced_context',0.18::DOUBLE,0.45::DOUBLE,0.18::DOUBLE,0.28::DOUBLE)) v(variant,l,u,r,dn)""",
)
def context_variants(spark, d):
    b = R.boxes(spark, d).join(R.images(spark, d).select("image_id", "width", "height"), "image_id")
    return proposals.context_variants(b).select("image_id", "family", "variant", *G.BOX)


# ---- pair joins --------------------------------------------------------------------------


@query(
    "overlap_review_pairs",
    with_(R.OBJECTS)
    + f"""SELECT a.image_id, a.id AS id_a, b.id AS id_b, round({R.sql_iou()}, 4) AS iou, a.run_id <> b.run_id AS cross_tile, 'unresolved' AS decision
FROM objects a JOIN objects b ON a.image_id=b.image_id AND a.id<b.id
WHERE a.category='house' AND b.category='house' AND {R.sql_iou()} >= 0.12""",
)
def overlap_review_pairs(spark, d):
    """House boxes of one image that overlap enough to be looked at; never merged here."""
    houses = R.objects(spark, d).filter("category = 'house' AND x1 > x0")
    pairs = overlap.overlapping_pairs(houses, G.iou(*overlap.ab()), 0.12, keep=["run_id"])
    return pairs.select(
        "image_id", "id_a", "id_b", F.round("overlap", 4).alias("iou"),
        (F.col("run_id_a") != F.col("run_id_b")).alias("cross_tile"), F.lit("unresolved").alias("decision"),
    )


@query(
    "overlap_min_area_hints",
    with_(R.OBJECTS)
    + f""", k AS (SELECT image_id, CAST(id AS VARCHAR) AS id, x0,y0,x1,y1, FALSE AS is_new FROM objects WHERE x1>x0 AND review_status<>'maybe'
  UNION ALL SELECT image_id, run_id||':'||id, x0,y0,x1,y1, TRUE FROM objects WHERE x1>x0 AND category='water')
SELECT a.image_id, a.id AS id_a, b.id AS id_b, round({R.sql_inter()}/least((a.x1-a.x0)*(a.y1-a.y0),(b.x1-b.x0)*(b.y1-b.y0)),3) AS fraction
FROM k a JOIN k b ON a.image_id=b.image_id AND a.id<b.id
WHERE {R.sql_inter()}/least((a.x1-a.x0)*(a.y1-a.y0),(b.x1-b.x0)*(b.y1-b.y0)) > 0.4""",
)
def overlap_min_area_hints(spark, d):
    """Kept or uncertain decisions and namespaced new observations that cover one another."""
    o = R.objects(spark, d).filter("x1 > x0")
    kept = o.filter("review_status <> 'maybe'").withColumn("id", F.col("id").cast("string"))
    new = o.filter("category = 'water'").withColumn("id", F.concat_ws(":", "run_id", "id"))
    pairs = overlap.overlapping_pairs(
        kept.select("image_id", "id", *G.BOX).unionByName(new.select("image_id", "id", *G.BOX)),
        G.smaller_fraction(*overlap.ab()), 0.4, strict=True,
    )
    return pairs.select("image_id", "id_a", "id_b", F.round("overlap", 3).alias("fraction"))


COARSE_SQL = """coarse AS (SELECT image_id, id, category, x0-x0%200 AS x0, y0-y0%200 AS y0, x0-x0%200+100 AS x1, y0-y0%200+100 AS y1 FROM objects)"""


@query(
    "coincident_boxes",
    with_(R.OBJECTS, COARSE_SQL)
    + """SELECT a.image_id, least(a.id,b.id) AS id_a, greatest(a.id,b.id) AS id_b FROM coarse a JOIN coarse b
ON a.image_id=b.image_id AND a.x0=b.x0 AND a.y0=b.y0 AND a.x1=b.x1 AND a.y1=b.y1 WHERE a.category='tree' AND b.category='mountain'""",
)
def coincident_boxes(spark, d):
    o = R.objects(spark, d)
    snapped = o.withColumns(
        {
            "x0": F.col("x0") - F.col("x0") % 200,
            "y0": F.col("y0") - F.col("y0") % 200,
            "x1": F.col("x0") - F.col("x0") % 200 + 100,
            "y1": F.col("y0") - F.col("y0") % 200 + 100,
        }
    )
    return overlap.coincident_pairs(snapped, "tree", "mountain")


# ---- suppression --------------------------------------------------------------------------

NMS_SQL = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, id) AS rn FROM boxes),
walk AS (
  SELECT image_id, 1::BIGINT AS rn, [{'id':id,'x0':x0,'y0':y0,'x1':x1,'y1':y1}] AS kept FROM ranked WHERE rn=1
  UNION ALL
  SELECT w.image_id, r.rn, CASE WHEN len(list_filter(w.kept, lambda k:
      (greatest(0,least(r.x1,k.x1)-greatest(r.x0,k.x0))*greatest(0,least(r.y1,k.y1)-greatest(r.y0,k.y0)))
      / greatest((r.x1-r.x0)*(r.y1-r.y0)+(k.x1-k.x0)*(k.y1-k.y0)-greatest(0,least(r.x1,k.x1)-greatest(r.x0,k.x0))*greatest(0,least(r.y1,k.y1)-greatest(r.y0,k.y0)),1e-9) >= THR))=0
    THEN list_append(w.kept, {'id':r.id,'x0':r.x0,'y0':r.y0,'x1':r.x1,'y1':r.y1}) ELSE w.kept END
  FROM walk w JOIN ranked r ON r.image_id=w.image_id AND r.rn=w.rn+1),
last AS (SELECT image_id, max_by(kept, rn) AS kept FROM walk GROUP BY image_id)
SELECT image_id, k.id AS id FROM (SELECT image_id, unnest(kept) AS k FROM last)"""


@query("nms_boxes", with_(R.BOXES, recursive=True) + NMS_SQL.replace("THR", "0.25"))
def nms_boxes(spark, d):
    return suppress.box_nms(R.boxes(spark, d), 0.25).select("image_id", "id")


@query("nms_loose", with_(R.BOXES, recursive=True) + NMS_SQL.replace("THR", "0.58"))
def nms_loose(spark, d):
    return suppress.box_nms(R.boxes(spark, d), 0.58).select("image_id", "id")


def detection_items(spark, d):
    """Segmented proposals with scores; the mask raster is a quarter of a hundredth of the canvas."""
    b = R.boxes(spark, d)
    return b.select(
        "image_id", "id", F.col("id").alias("pos"), *G.BOX,
        F.col("score").alias("detector_score"),
        F.expr("cast(id*31%1000 as double)/1000").alias("classifier_score"),
        F.expr("cast(id*71%1000 as double)/1000").alias("quality"),
        (F.col("id") % 6 == 0).alias("is_group"),
    )


def mask_runs(spark, d):
    """Masks as arrays of runs."""
    run = "named_struct('y', y, 'x0', cast(floor(x0 / 25) + (id + y) % 2 as int), 'x1', cast(floor(x1 / 25) - (id * y) % 2 as int))"
    runs = F.expr(f"transform(sequence(cast(floor(y0 / 25) as int), cast(floor(y1 / 25) as int) - 1), y -> {run})")
    return R.boxes(spark, d).select("image_id", "id", runs.alias("runs"))


def mask_spans(spark, d):
    return mask_runs(spark, d).select("image_id", "id", F.inline("runs"))


SPANS_SQL = """items AS (SELECT *, id AS pos, score AS detector_score, CAST(id*31%1000 AS DOUBLE)/1000 AS classifier_score,
    CAST(id*71%1000 AS DOUBLE)/1000 AS quality, id%6=0 AS is_group FROM boxes),
spans AS (SELECT image_id, id, y, CAST(floor(x0/25) + (id+y)%2 AS INTEGER) AS x0, CAST(floor(x1/25) - (id*y)%2 AS INTEGER) AS x1
  FROM (SELECT *, unnest(range(CAST(floor(y0/25) AS INTEGER), CAST(floor(y1/25) AS INTEGER))) AS y FROM boxes)),
area AS (SELECT image_id, id, sum(x1-x0) AS mask_area FROM spans GROUP BY 1,2)"""


@query(
    "mask_stats",
    with_(R.BOXES, SPANS_SQL)
    + """SELECT image_id, id, CAST(sum(x1-x0) AS BIGINT) AS mask_area, min(x0) AS x0, CAST(min(y) AS INTEGER) AS y0, max(x1) AS x1, CAST(max(y)+1 AS INTEGER) AS y1
FROM spans GROUP BY 1,2""",
)
def mask_stats(spark, d):
    return masks.mask_stats(mask_spans(spark, d))


@query(
    "mask_change",
    with_(R.BOXES, SPANS_SQL)
    + """, moved AS (SELECT image_id, id, y, x0+CAST(id%5 AS INTEGER)-2 AS x0, x1+CAST(id%5 AS INTEGER)-2 AS x1 FROM spans),
m AS (SELECT a.image_id, a.id, sum(least(a.x1,b.x1)-greatest(a.x0,b.x0)) AS shared FROM spans a JOIN moved b
  ON a.image_id=b.image_id AND a.id=b.id AND a.y=b.y AND a.x0<b.x1 AND b.x0<a.x1 GROUP BY 1,2),
u AS (SELECT image_id, id, mask_area*2-coalesce(shared,0) AS un, coalesce(shared,0) AS shared FROM area LEFT JOIN m USING (image_id,id))
SELECT image_id, id, CASE WHEN un=0 THEN 1 ELSE round(shared/un,6) END AS iou, CASE WHEN un=0 THEN 0 ELSE round((un-shared)/un,6) END AS changed FROM u""",
)
def mask_change(spark, d):
    """IoU and changed-pixel share of each mask against a shifted copy."""
    s = mask_spans(spark, d)
    shift = F.expr("cast(id % 5 - 2 as int)")
    moved = s.withColumns({"x0": F.col("x0") + shift, "x1": F.col("x1") + shift})
    c = masks.mask_comparison(s, moved)
    return c.select("image_id", "id", F.round("iou", 6).alias("iou"), F.round("changed", 6).alias("changed"))


CONFLICT_SQL = """, inter AS (SELECT a.image_id, a.id AS ia, b.id AS ib, sum(least(a.x1,b.x1)-greatest(a.x0,b.x0)) AS shared FROM spans a JOIN spans b
  ON a.image_id=b.image_id AND a.y=b.y AND a.id<b.id AND a.x0<b.x1 AND b.x0<a.x1 GROUP BY 1,2,3),
it AS (SELECT i.*, mask_area, detector_score*classifier_score*greatest(quality,0.05::DOUBLE) AS agreement FROM items i JOIN area USING (image_id,id)),
pr AS (SELECT a.image_id, a.id AS ia, b.id AS ib, coalesce(shared,0)/greatest(least(a.mask_area,b.mask_area),1)::DOUBLE AS ms,
   greatest(0,least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0))/least(greatest(1,(a.x1-a.x0)*(a.y1-a.y0)),greatest(1,(b.x1-b.x0)*(b.y1-b.y0))) AS bs
   FROM it a JOIN it b ON a.image_id=b.image_id AND a.id<b.id LEFT JOIN inter i ON i.image_id=a.image_id AND i.ia=a.id AND i.ib=b.id),
hit AS (SELECT image_id, ia, ib, greatest(ms,bs) AS contained FROM pr WHERE ms>=0.60 OR bs>=0.68),
sym AS (SELECT image_id, ia AS x, ib AS y, contained FROM hit UNION ALL SELECT image_id, ib, ia, contained FROM hit),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY agreement DESC, mask_area DESC, pos) AS rn FROM it WHERE KEEPIF),
riv AS (SELECT rk.image_id, rk.id, rk.rn, list(sym.y) FILTER (sym.y IS NOT NULL) AS riv FROM rk LEFT JOIN sym ON sym.image_id=rk.image_id AND sym.x=rk.id GROUP BY 1,2,3),
walk AS (SELECT image_id, 1::BIGINT AS rn, [id] AS kept FROM riv WHERE rn=1
  UNION ALL SELECT w.image_id, r.rn, CASE WHEN len(list_intersect(w.kept, coalesce(r.riv,[])))=0 THEN list_append(w.kept, r.id) ELSE w.kept END
  FROM walk w JOIN riv r ON r.image_id=w.image_id AND r.rn=w.rn+1),
fin AS (SELECT image_id, max_by(kept, rn) AS kept FROM walk GROUP BY 1),
keptids AS (SELECT image_id, unnest(kept) AS id FROM fin)"""


@query(
    "containment_dedupe",
    with_(R.BOXES, SPANS_SQL, recursive=True)
    + CONFLICT_SQL.replace("KEEPIF", "TRUE")
    + """, win AS (SELECT l.image_id, l.id, min_by(sym.y, k.rn) AS duplicate_of FROM rk l JOIN sym ON sym.image_id=l.image_id AND sym.x=l.id
   JOIN keptids ki ON ki.image_id=l.image_id AND ki.id=sym.y JOIN rk k ON k.image_id=ki.image_id AND k.id=ki.id AND k.rn<l.rn
   WHERE (l.image_id,l.id) NOT IN (SELECT (image_id,id) FROM keptids) GROUP BY 1,2)
SELECT rk.image_id, rk.id, win.duplicate_of, round(sym.contained,6) AS contained, round(rk.agreement,6) AS agreement
FROM rk LEFT JOIN win USING (image_id,id) LEFT JOIN sym ON sym.image_id=rk.image_id AND sym.x=rk.id AND sym.y=win.duplicate_of""",
)
def containment_dedupe(spark, d):
    spans = mask_spans(spark, d)
    area = masks.mask_stats(spans).select("image_id", "id", "mask_area")
    items = detection_items(spark, d).join(area, ["image_id", "id"])
    out = masks.containment_dedupe(items, mask_runs(spark, d))
    return out.select(
        "image_id", "id", "duplicate_of", F.round("contained", 6).alias("contained"), F.round("agreement", 6).alias("agreement")
    )


@query(
    "parent_split",
    with_(R.BOXES, SPANS_SQL, recursive=True)
    + CONFLICT_SQL.replace("KEEPIF", "NOT is_group AND classifier_score >= 0.3")
    + """, kids AS (SELECT k.image_id, k.id, rk.x0,rk.y0,rk.x1,rk.y1, row_number() OVER (PARTITION BY k.image_id ORDER BY rk.y0, rk.x0, rk.id) AS rank
    FROM keptids k JOIN rk ON rk.image_id=k.image_id AND rk.id=k.id),
par AS (SELECT image_id, id, x0-(x1-x0)/8 AS x0, y0-(y1-y0)/8 AS y0, x1+(x1-x0)/8 AS x1, y1+(y1-y0)/8 AS y1 FROM items WHERE is_group),
el AS (SELECT p.image_id, p.id AS parent, greatest(p.x1-p.x0,1) AS pw, greatest(p.y1-p.y0,1) AS ph, k.* EXCLUDE (image_id) FROM par p JOIN kids k USING (image_id)
   WHERE greatest((k.x1-k.x0)*(k.y1-k.y0),1)/(greatest(p.x1-p.x0,1)*greatest(p.y1-p.y0,1)) <= 0.82
     AND greatest(0,least(p.x1,k.x1)-greatest(p.x0,k.x0))*greatest(0,least(p.y1,k.y1)-greatest(p.y0,k.y0))/greatest((k.x1-k.x0)*(k.y1-k.y0),1) >= 0.74),
pick AS (SELECT a.image_id, a.parent AS id, min_by({'a':a.id,'b':b.id}, a.rank*100000+b.rank) AS p FROM el a JOIN el b ON a.image_id=b.image_id AND a.parent=b.parent AND a.rank<b.rank
   WHERE """
    + R.sql_iou("a", "b", "1e-9")
    + """ <= 0.32 AND greatest(abs((a.x0+a.x1)/2-(b.x0+b.x1)/2)/a.pw, abs((a.y0+a.y1)/2-(b.y0+b.y1)/2)/a.ph) >= 0.18
   AND (greatest((a.x1-a.x0)*(a.y1-a.y0),1)+greatest((b.x1-b.x0)*(b.y1-b.y0),1))/(a.pw*a.ph) >= 0.65 GROUP BY 1,2),
sub AS (SELECT DISTINCT p.image_id, o.id FROM par p JOIN pick USING (image_id,id) JOIN par o ON o.image_id=p.image_id AND o.id<>p.id
   WHERE greatest((o.x1-o.x0)*(o.y1-o.y0),1)/(greatest(p.x1-p.x0,1)*greatest(p.y1-p.y0,1)) <= 0.82
     AND greatest(0,least(p.x1,o.x1)-greatest(p.x0,o.x0))*greatest(0,least(p.y1,o.y1)-greatest(p.y0,o.y0))/greatest((o.x1-o.x0)*(o.y1-o.y0),1) >= 0.74),
ch AS (SELECT image_id, p.a AS id FROM pick UNION SELECT image_id, p.b FROM pick)
SELECT i.image_id, i.id, CASE WHEN NOT EXISTS (SELECT 1 FROM par WHERE par.image_id=i.image_id) THEN NULL
  WHEN EXISTS (SELECT 1 FROM pick WHERE pick.image_id=i.image_id AND pick.id=i.id) THEN 'vlm_group_box_split_by_distinct_complete_children'
  WHEN EXISTS (SELECT 1 FROM sub WHERE sub.image_id=i.image_id AND sub.id=i.id) THEN 'redundant_vlm_subbox_after_parent_decomposition'
  WHEN NOT is_group AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.image_id=i.image_id AND ch.id=i.id) THEN 'local_proposal_not_needed_for_vlm_parent_decomposition' END AS reason
FROM items i""",
)
def parent_split(spark, d):
    """Group boxes that two distinct local children explain; group boxes are a quarter wider here."""
    spans = mask_spans(spark, d)
    area = masks.mask_stats(spans).select("image_id", "id", "mask_area")
    items = detection_items(spark, d).join(area, ["image_id", "id"])
    local = items.filter("NOT is_group AND classifier_score >= 0.3")
    kept = masks.containment_dedupe(local, mask_runs(spark, d)).filter(F.col("duplicate_of").isNull())
    children = ranking.rank_in_group(kept, ["image_id"], ["y0", "x0", "id"])
    w, h = (F.col("x1") - F.col("x0")) / 8, (F.col("y1") - F.col("y0")) / 8
    grown = {"x0": F.col("x0") - w, "y0": F.col("y0") - h, "x1": F.col("x1") + w, "y1": F.col("y1") + h}
    items = items.withColumns({k: F.when(F.col("is_group"), v).otherwise(F.col(k)) for k, v in grown.items()})
    _, verdict = masks.split_parents(items, children)
    return verdict


STRUCT_SQL = """st AS (SELECT b.image_id, b.id, x0,y0,x1,y1, CAST((x1-x0)*(y1-y0)*(20+id*7%70)/100 AS DOUBLE) AS mask_area, width*height AS whole FROM boxes b JOIN images USING (image_id)),
sr AS (SELECT *, CASE WHEN mask_area/whole < 0.006 AND mask_area/(greatest(x1-x0,1)*greatest(y1-y0,1)) < 0.38 THEN 'small_fragment_without_whole_building_support'
   WHEN greatest(x1-x0,1)/greatest(y1-y0,1) > 2.4 AND mask_area/(greatest(x1-x0,1)*greatest(y1-y0,1)) < 0.48 THEN 'shallow_awning_or_canopy' END AS reason FROM st)"""


def structured(spark, d):
    b = R.boxes(spark, d).join(R.images(spark, d).select("image_id", "width", "height"), "image_id")
    b = b.withColumn("mask_area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * F.expr("20 + id*7%70") / 100)
    b = b.withColumn("mask_share", F.col("mask_area") / (F.col("width") * F.col("height")))
    return b.withColumn("reason", proposals.structure_reason())


@query(
    "structure_filter",
    with_(R.BOXES, R.IMAGES, STRUCT_SQL) + "SELECT image_id, id, reason FROM sr",
)
def structure_filter(spark, d):
    return structured(spark, d).select("image_id", "id", "reason")


@query(
    "renumber_instances",
    with_(R.BOXES, R.IMAGES, STRUCT_SQL)
    + "SELECT image_id, id, printf('House_%02d', row_number() OVER (PARTITION BY image_id ORDER BY y0, x0, id)) AS house FROM sr WHERE reason IS NULL",
)
def renumber_instances(spark, d):
    kept = structured(spark, d).filter(F.col("reason").isNull())
    return proposals.renumber(kept.select("image_id", "id", "x0", "y0")).select("image_id", "id", "house")


MASKS3_SQL = """cand AS (SELECT image_id, id, k AS mask_no, CAST((id*71+k*379)%1000 AS DOUBLE)/1000 AS quality, (id*13+k*7)%5*100 AS mask_area FROM boxes, (SELECT unnest([0,1,2]) AS k)),
best AS (SELECT image_id, id, min_by({'n':mask_no,'q':quality,'a':mask_area}, -quality*1000+mask_no/10.0) AS m FROM cand GROUP BY 1,2),
bm AS (SELECT image_id, id, m.n AS mask_no, m.q AS quality, CASE WHEN m.q < 0.40 THEN 'low_sam_mask_quality' END AS rejection_reason FROM best WHERE m.a > 0)"""


def mask_candidates(spark, d):
    b = R.boxes(spark, d).withColumn("mask_no", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return b.select(
        "image_id", "id", "mask_no",
        F.expr("cast((id*71 + mask_no*379) % 1000 as double)/1000").alias("quality"),
        F.expr("(id*13 + mask_no*7) % 5 * 100").alias("mask_area"),
    )


@query(
    "best_mask",
    with_(R.BOXES, MASKS3_SQL) + "SELECT image_id, id, mask_no, quality, rejection_reason FROM bm",
)
def best_mask(spark, d):
    return proposals.best_mask(mask_candidates(spark, d), ["image_id", "id"]).select(
        "image_id", "id", "mask_no", "quality", "rejection_reason"
    )


@query(
    "classifier_split",
    with_(R.BOXES)
    + "SELECT image_id, id, CASE WHEN CAST(id*31%1000 AS DOUBLE)/1000 >= 0.62 THEN 'building' ELSE 'not_building' END AS decision FROM boxes",
)
def classifier_split(spark, d):
    return proposals.classify(detection_items(spark, d), 0.62).select("image_id", "id", "decision")


@query(
    "rejection_tally",
    with_(R.BOXES, R.IMAGES, STRUCT_SQL, MASKS3_SQL)
    + """SELECT reason, count(*) AS n FROM (SELECT reason FROM sr WHERE reason IS NOT NULL UNION ALL SELECT rejection_reason FROM bm WHERE rejection_reason IS NOT NULL
 UNION ALL SELECT 'not_building' FROM boxes WHERE CAST(id*31%1000 AS DOUBLE)/1000 < 0.62) GROUP BY 1""",
)
def rejection_tally(spark, d):
    """Why items went, over the structure filter, mask choice and classifier."""
    weak = proposals.best_mask(mask_candidates(spark, d), ["image_id", "id"])
    parts = [
        structured(spark, d).select("reason"),
        weak.select(F.col("rejection_reason").alias("reason")),
        proposals.classify(detection_items(spark, d), 0.62).filter("decision = 'not_building'").select(F.col("decision").alias("reason")),
    ]
    rejected = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("reason").isNotNull())
    return proposals.rejection_tally(rejected)


@query(
    "proposal_cache",
    with_(R.BOXES, R.IMAGES)
    + """, c AS (SELECT *, CASE WHEN b.id%5=0 THEN NULL WHEN b.id%7=0 THEN 'old' ELSE sha256 END AS h, CASE WHEN id%3=0 THEN NULL ELSE score END AS ds,
   CASE WHEN id%11=0 THEN NULL ELSE score/2 END AS sc, CASE WHEN id%4=0 THEN NULL ELSE 'tile' END AS src FROM boxes b JOIN images USING (image_id))
SELECT image_id, id, coalesce(ds, sc) AS detector_score, coalesce(src,'cached_automatic_detector') AS proposal_source FROM c
WHERE (h IS NULL OR h=sha256) AND coalesce(ds,sc) IS NOT NULL""",
)
def proposal_cache(spark, d):
    """Cached proposals of unchanged images, with defaults filled in."""
    im = R.images(spark, d)
    cache = R.boxes(spark, d).join(im.select("image_id", "sha256"), "image_id").select(
        "image_id", "id", *G.BOX,
        F.expr("case when id%5=0 then null when id%7=0 then 'old' else sha256 end").alias("image_sha256"),
        F.expr("case when id%3=0 then null else score end").alias("detector_score"),
        F.expr("case when id%11=0 then null else score/2 end").alias("score"),
        F.expr("case when id%4=0 then null else 'tile' end").alias("proposal_source"),
    )
    usable, _ = proposals.load_proposals(cache, im)
    return usable.select("image_id", "id", "detector_score", "proposal_source")


# ---- components ---------------------------------------------------------------------------

COMP_SQL = f""", edges AS (SELECT a.image_id, a.id AS ia, b.id AS ib, {R.sql_iou()} AS ov FROM boxes a JOIN boxes b ON a.image_id=b.image_id AND a.id<b.id WHERE {R.sql_iou()} >= 0.25),
sym AS (SELECT image_id, ia AS u, ib AS v FROM edges UNION ALL SELECT image_id, ib, ia FROM edges),
reach AS (SELECT image_id, u AS id, v AS other FROM sym UNION SELECT r.image_id, r.id, s.v FROM reach r JOIN sym s ON s.image_id=r.image_id AND s.u=r.other),
member AS (SELECT image_id, id, least(id, min(other)) AS component FROM reach GROUP BY image_id, id),
shape AS (SELECT image_id, component, count(*) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes JOIN member USING (image_id,id) GROUP BY 1,2),
sc AS (SELECT e.image_id, component, max(ov) AS score FROM edges e JOIN member m ON m.image_id=e.image_id AND m.id=e.ia GROUP BY 1,2),
groups AS (SELECT * FROM shape JOIN sc USING (image_id,component))"""


def box_components(spark, d):
    b = R.boxes(spark, d)
    edges = overlap.overlapping_pairs(b, G.iou(*overlap.ab()), 0.25)
    return graph.component_groups(b, edges)


@query(
    "overlap_components",
    with_(R.BOXES, recursive=True)
    + COMP_SQL
    + "SELECT image_id, component, members, x0, y0, x1, y1, round(score,6) AS score FROM groups",
)
def overlap_components(spark, d):
    """Groups of boxes chained by IoU ≥ 0.25, with union box and strongest overlap."""
    return box_components(spark, d).withColumn("score", F.round("score", 6))


@query(
    "top_components",
    with_(R.BOXES, R.IMAGES, recursive=True)
    + COMP_SQL
    + """, t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, component) AS rank FROM groups)
SELECT t.image_id, component, CAST(rank AS INTEGER) AS rank, greatest(0, trunc(x0*width/1000-(x1-x0)*width/1000*0.18)) AS c0, greatest(0, trunc(y0*height/1000-(y1-y0)*height/1000*0.18)) AS c1,
  least(width, round_even(x1*width/1000+(x1-x0)*width/1000*0.18,0)) AS c2, least(height, round_even(y1*height/1000+(y1-y0)*height/1000*0.18,0)) AS c3
FROM t JOIN images USING (image_id) WHERE rank <= 3""",
)
def top_components(spark, d):
    """The three most ambiguous groups per image and the crop around each."""
    from ..operators.ranking import top_groups

    top = top_groups(box_components(spark, d), ["image_id"], 3)
    t = top.join(R.images(spark, d).select("image_id", "width", "height"), "image_id")
    px = {c: F.col(c) * F.col("width" if c[0] == "x" else "height") / 1000 for c in G.BOX}
    t = t.withColumns(px)
    pw, ph = (F.col("x1") - F.col("x0")) * 0.18, (F.col("y1") - F.col("y0")) * 0.18
    return t.select(
        "image_id", "component", "rank",
        F.greatest(G.dlit(0), F.floor(F.col("x0") - pw).cast("double")).alias("c0"),
        F.greatest(G.dlit(0), F.floor(F.col("y0") - ph).cast("double")).alias("c1"),
        F.least("width", F.bround(F.col("x1") + pw)).alias("c2"),
        F.least("height", F.bround(F.col("y1") + ph)).alias("c3"),
    )
