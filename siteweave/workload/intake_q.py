"""Answers, normalisation, corpus jobs, sources and sinks, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import corpus, intake, tiles
from ..session import scratch_path
from ..sources import readers, sinks
from ..streaming import answered
from ..streaming import intake as live
from . import recipes as R
from .boxes import TILES_SQL
from .registry import query, with_

GATED = """, ext AS (SELECT *, regexp_extract(regexp_replace(trim(answer),'<think>.*?</think>','','gis'),'\\{.*\\}',0,'s') AS body,
  regexp_replace(answer,'^\\s+|\\s+$','','g') AS plain FROM runs),
fen AS (SELECT *, CASE WHEN regexp_matches(plain,'^```[^\\n]*\\n(.*\\n)?[ \\t]*```$','s') THEN regexp_extract(plain,'^```[^\\n]*\\n(.*\\n)?[ \\t]*```$',1,'s') ELSE plain END AS whole FROM ext),
gated AS (SELECT *, CASE WHEN finish_reason<>'stop' THEN 'truncated' WHEN NOT (model_returned=model_requested OR starts_with(model_returned, model_requested||'-')) THEN 'wrong_model'
  WHEN NOT (starts_with(ltrim(whole),'{') AND json_valid(whole)) THEN 'not_json' WHEN issues>0 THEN 'invalid' END AS refused FROM fen)"""


@query("response_gate", with_(R.RUNS) + GATED + " SELECT run_id, image_id, stage, label, refused FROM gated")
def response_gate(spark, d):
    return intake.gate(R.runs(spark, d)).select("run_id", "image_id", "stage", "label", "refused")


@query(
    "extracted_answers",
    with_(R.RUNS) + GATED + " SELECT run_id, CAST(json_extract(body,'$.k') AS BIGINT) AS k FROM gated WHERE body<>'' AND json_valid(body)",
)
def extracted_answers(spark, d):
    parsed = R.runs(spark, d).withColumn("v", A.parse_object(F.col("answer"))).filter("v is not null")
    return parsed.select("run_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query(
    "array_answers",
    """SELECT conv_id, turn, CASE WHEN role='assistant' THEN to_json([text, CAST(turn AS VARCHAR)])::VARCHAR
  WHEN contains(text,'[') AND contains(substr(text, strpos(text,'[')),']') THEN regexp_extract(text,'\\[.*\\]',0,'s') ELSE '' END AS body FROM conversations""",
)
def array_answers(spark, d):
    """Turns of the answering side as a fenced array after a reasoning block; other roles as they are."""
    c = R.table(spark, d, "conversations")
    listed = F.to_json(F.array("text", F.col("turn").cast("string")))
    text = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>why</think>```JSON\n"), listed, F.lit("\n```"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", A.outer_array(text).alias("body"))


@query(
    "latest_accepted",
    with_(R.RUNS) + GATED + " SELECT image_id, stage, label, max_by(run_id, epoch_us(ts)*1000000::HUGEINT+run_id) AS run_id FROM gated WHERE refused IS NULL GROUP BY 1,2,3",
)
def latest_accepted(spark, d):
    return intake.latest_accepted(intake.gate(R.runs(spark, d))).select("image_id", "stage", "label", "run_id")


@query(
    "attempt_history",
    with_(R.RUNS) + GATED
    + " SELECT image_id, stage, label, count(*) AS attempts, count(refused) AS refused_attempts, min_by(run_id, epoch_us(ts)*1000000::HUGEINT+run_id) AS first_run, max_by(run_id, epoch_us(ts)*1000000::HUGEINT+run_id) AS last_run FROM gated GROUP BY 1,2,3",
)
def attempt_history(spark, d):
    return intake.attempt_history(intake.gate(R.runs(spark, d)))


PRIOR_RUN = "select event_id as run_id, case event_type when 'click' then 'inventory' when 'view' then 'landmarks' when 'purchase' then 'structure' when 'signup' then 'ground_check' else 'review' end as stage, concat('x', event_id) as sha256 from {events}"
NORMED = "select event_id as run_id from {events} where value > 20"
CHECKED = "select event_id as run_id, concat('x', case when event_id%7=0 then -1 else event_id end) as source_sha256 from {events} where value < 60"


@query(
    "prior_documents",
    with_(R.cte("r", PRIOR_RUN), R.cte("n", NORMED), R.cte("v", CHECKED))
    + """SELECT run_id, CASE WHEN vc AND stage IN ('landmarks','ground_hypotheses','ground_check') THEN 'validated' WHEN nc AND stage IN ('inventory','structure','landmarks') THEN 'normalized' ELSE 'raw' END AS source,
  vc AND stage IN ('landmarks','ground_hypotheses','ground_check') AND source_sha256<>sha256 AS stale FROM (SELECT r.*, n.run_id IS NOT NULL AS nc, v.run_id IS NOT NULL AS vc, coalesce(source_sha256,'') AS source_sha256 FROM r LEFT JOIN n USING (run_id) LEFT JOIN v USING (run_id))""",
)
def prior_documents(spark, d):
    out = intake.load_prior(R.derive(spark, d, PRIOR_RUN), R.derive(spark, d, NORMED), R.derive(spark, d, CHECKED))
    return out.select("run_id", "source", "stale")


STAGED = "select event_id as run_id, case event_type when 'click' then 'review' when 'view' then 'structure' when 'purchase' then 'audit' when 'signup' then 'ground_check' else 'inventory' end as stage, case event_id%5 when 0 then 'inventory' when 1 then 'review' when 2 then 'structure' when 3 then 'ground_hypotheses' else 'landmarks' end as prior_stage from {events}"


@query(
    "stage_violations",
    with_(R.cte("s", STAGED)) + "SELECT run_id, stage, prior_stage FROM s WHERE stage<>'inventory' AND stage||'<'||prior_stage NOT IN ('review<inventory','structure<review','audit<structure','ground_check<ground_hypotheses')",
)
def stage_violations(spark, d):
    return intake.stage_violations(R.derive(spark, d, STAGED))


@query(
    "blocked_images",
    "SELECT user_id AS image_id, count(*) AS jobs, count(*) FILTER (event_type='error' AND value>90) AS failed, bool_or(event_type='error' AND value>90) AS blocked FROM events GROUP BY 1",
)
def blocked_images(spark, d):
    e = R.table(spark, d, "events")
    jobs = e.select(F.col("user_id").alias("image_id"), F.expr("case when event_type='error' and value>90 then 2 else 0 end").alias("exit_code"))
    return intake.blocked_images(jobs)


@query(
    "batch_status",
    "SELECT user_id AS image_id, count(*) AS runs, bool_and(value<95) AS all_valid, CAST(coalesce(sum(event_id%30) FILTER (value<95),0) AS BIGINT) AS candidates FROM events GROUP BY 1",
)
def batch_status(spark, d):
    from ..operators.summary import batch_status as roll_up

    e = R.table(spark, d, "events")
    runs = e.select(F.col("user_id").alias("image_id"), (F.col("value") < 95).alias("valid"), (F.col("event_id") % 30).alias("candidates"))
    return roll_up(runs, ["image_id"])


@query(
    "model_sets",
    with_(R.RUNS) + "SELECT image_id, string_agg(DISTINCT model_returned, ',' ORDER BY model_returned) AS models FROM runs GROUP BY 1",
)
def model_sets(spark, d):
    from ..operators.summary import distinct_sorted

    m = distinct_sorted(R.runs(spark, d), ["image_id"], "model_returned", "models")
    return m.select("image_id", F.concat_ws(",", "models").alias("models"))


@query("normalized_categories", with_(R.OBJECTS) + "SELECT run_id, id, CASE WHEN category='tree_group' THEN 'tree' ELSE category END AS category, CASE WHEN category='tree_group' THEN TRUE END AS grouped FROM objects")
def normalized_categories(spark, d):
    return intake.normalize_category(R.objects(spark, d))[0].select("run_id", "id", "category", "grouped")


@query(
    "decoded_paths",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey%3<>1 AND o_orderkey%7<>0 AND o_orderkey%1100<=1000 THEN CAST(2 AS INTEGER) END AS points, CASE WHEN o_orderkey%3<>1 AND o_orderkey%7<>0 AND o_orderkey%1100<=1000 THEN CAST(o_orderkey%1100 AS DOUBLE) END AS first_x FROM orders",
)
def decoded_paths(spark, d):
    """JSON text paths: whole ones decode, cut-off or out-of-frame ones stay undecoded."""
    o = R.table(spark, d, "orders")
    text = F.expr(
        """case when o_orderkey%3=1 then concat('[[', o_orderkey%1100, ',1]]') when o_orderkey%7=0 then concat('[[', o_orderkey%1100, ',1],[true,4]]') else concat('[[', o_orderkey%1100, ',1],[3.5,4]]') end"""
    )
    path = intake.decode_path(text)
    return o.select(F.col("o_orderkey").alias("id"), F.when(path.isNotNull(), F.size(path)).alias("points"), path[0][0].alias("first_x"))


SEGROLE = "select o_custkey as doc_id, o_orderkey as id, case when l_partkey%3=0 then 'visible_ground_line' else 'upper_structure' end as role, l_linenumber, l_partkey from {lineitem} join {orders} on l_orderkey=o_orderkey"


@query(
    "normalized_roles",
    with_(R.cte("s", SEGROLE)) + "SELECT doc_id, id, l_linenumber, l_partkey, CASE WHEN role='visible_ground_line' THEN 'ground_edge' ELSE role END AS role FROM s",
)
def normalized_roles(spark, d):
    s = R.derive(spark, d, SEGROLE).withColumn("segs", F.array(F.struct("l_linenumber", "l_partkey", "role")))
    return s.select("doc_id", "id", F.explode(intake.normalize_roles(F.col("segs"))).alias("s")).select("doc_id", "id", "s.*")


COARSE_OBJECTS = "coarse AS (SELECT * REPLACE (name AS id, x0-x0%500 AS x0, y0-y0%500 AS y0, x0-x0%500+100 AS x1, y0-y0%500+100 AS y1) FROM objects)"
SURVEYS = """select run_id, case when k%11=0 then 'length' else 'stop' end as finish_reason, 'm-1' as model_requested, case when k%13=0 then 'n' else 'm-1-2024' end as model_returned, cast(0 as bigint) as issues,
  case when k%17=0 then '[]' else concat(chr(123), chr(125)) end as answer, case when k%7=0 then 'review' else 'inventory' end as stage from (select concat(cast(o_custkey as string), ':', o_orderstatus) as run_id, min(o_orderkey) as k from {orders} group by 1) t"""
REPORTED = (
    R.OBJECTS,
    COARSE_OBJECTS,
    R.cte("sv", SURVEYS),
    "jd AS (SELECT run_id, CASE WHEN finish_reason<>'stop' THEN 'truncated' WHEN model_returned='n' THEN 'wrong_model' WHEN answer='[]' THEN 'not_json' WHEN stage<>'inventory' THEN 'wrong_stage' END AS reason FROM sv)",
    "nm AS (SELECT c.* REPLACE (CASE WHEN category='tree_group' THEN 'tree' ELSE category END AS category), category='tree_group' AS aliased FROM coarse c JOIN jd USING (run_id) WHERE reason IS NULL)",
    """bad AS (SELECT run_id FROM nm WHERE category NOT IN ('house','tree','mountain','water','flat','other')
  UNION ALL SELECT run_id FROM nm WHERE NOT (0<=x0 AND x0<x1 AND x1<=1000 AND 0<=y0 AND y0<y1 AND y1<=1000) UNION ALL SELECT run_id FROM nm GROUP BY run_id, id HAVING count(*)>1
  UNION ALL SELECT run_id FROM (SELECT DISTINCT run_id, id FROM nm a WHERE occluder IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nm b WHERE b.run_id=a.run_id AND b.id=a.occluder)))""",
    "wn AS (SELECT a.run_id FROM nm a JOIN nm b ON a.run_id=b.run_id AND a.x0=b.x0 AND a.y0=b.y0 AND a.x1=b.x1 AND a.y1=b.y1 AND a.category='tree' AND b.category='mountain')",
)


def _report(spark, d):
    o = R.objects(spark, d)
    snapped = {"x0": F.expr("x0 - x0 % 500"), "y0": F.expr("y0 - y0 % 500"), "x1": F.expr("x0 - x0 % 500 + 100"), "y1": F.expr("y0 - y0 % 500 + 100")}
    o = o.withColumns(snapped).withColumn("id", F.col("name"))
    return intake.normalization_report(intake.gate(R.derive(spark, d, SURVEYS)), o)


@query(
    "normalization_report",
    with_(*REPORTED)
    + """SELECT jd.run_id, coalesce(c.n,0) AS changes, coalesce(i.n,0) AS issues, coalesce(w.n,0) AS warnings FROM jd LEFT JOIN (SELECT run_id, count(*) AS n FROM nm WHERE aliased GROUP BY 1) c ON c.run_id=jd.run_id
LEFT JOIN (SELECT run_id, count(*) AS n FROM bad GROUP BY 1) i ON i.run_id=jd.run_id LEFT JOIN (SELECT run_id, count(*) AS n FROM wn GROUP BY 1) w ON w.run_id=jd.run_id WHERE reason IS NULL""",
)
def normalization_report(spark, d):
    """Changes, issues left and warnings of every survey answer that can be normalised."""
    return _report(spark, d)[0]


@query("normalized_counts", with_(*REPORTED) + "SELECT run_id, category, count(*) AS n FROM nm GROUP BY 1,2")
def normalized_counts(spark, d):
    return _report(spark, d)[1]


@query("refused_normalizations", with_(*REPORTED) + "SELECT run_id, reason FROM jd WHERE reason IS NOT NULL")
def refused_normalizations(spark, d):
    """Cut-off, foreign and malformed answers, and those of another stage."""
    return _report(spark, d)[2]


@query(
    "gathered_candidates",
    with_(R.IMAGES, R.BOXES, TILES_SQL)
    + """SELECT t.image_id, label||':'||b.id AS id, round((tx0+x0*(tx1-tx0)/1000)/width*1000,3) AS x0, round((ty0+y0*(ty1-ty0)/1000)/height*1000,3) AS y0, round((tx0+x1*(tx1-tx0)/1000)/width*1000,3) AS x1, round((ty0+y1*(ty1-ty0)/1000)/height*1000,3) AS y1
FROM boxes b JOIN tiles t ON t.image_id=b.image_id AND t.label=['nw','ne','sw','se'][CAST(b.id%4 AS INT)+1]""",
)
def gathered_candidates(spark, d):
    b = R.boxes(spark, d).withColumn("label", F.expr("element_at(array('nw','ne','sw','se'), cast(id % 4 as int) + 1)"))
    return intake.gather_candidates(tiles.quadrant_tiles(R.images(spark, d)), b)


@query(
    "detection_cache_issues",
    with_(R.IMAGES, R.BOXES)
    + """, dc AS (SELECT image_id, CASE WHEN image_id%17=0 THEN 'draft' ELSE 'automatic_whole_building_instance_parsing' END AS stage, width+CASE WHEN image_id%19=0 THEN 1 ELSE 0 END AS width, height, 8+image_id%4 AS cnt FROM images),
n AS (SELECT image_id, count(*) AS n, count(DISTINCT id%97) AS dd FROM boxes GROUP BY 1), j AS (SELECT dc.*, images.width AS w2, n, dd FROM dc JOIN images USING (image_id) LEFT JOIN n USING (image_id))
SELECT image_id, 'stage' AS problem FROM j WHERE stage='draft' UNION ALL SELECT image_id, 'image_size' FROM j WHERE width<>w2 UNION ALL SELECT image_id, 'ids' FROM j WHERE n IS NULL OR n<>dd UNION ALL SELECT image_id, 'count' FROM j WHERE cnt<>coalesce(n,0)""",
)
def detection_cache_issues(spark, d):
    im = R.images(spark, d)
    docs = im.select(
        "image_id", F.expr("case when image_id%17=0 then 'draft' else 'automatic_whole_building_instance_parsing' end").alias("stage"),
        F.expr("width + case when image_id%19=0 then 1 else 0 end").alias("width"), "height", F.expr("8 + image_id%4").alias("count"),
    )
    inst = R.boxes(spark, d).select("image_id", F.expr("cast(id % 97 as string)").alias("id"))
    return intake.detection_issues(docs, inst, im)


# ---- corpus -----------------------------------------------------------------------------------


def _named(spark, d):
    return R.images(spark, d).withColumnRenamed("path", "name")


SPLIT_SQL = """sp AS (SELECT image_id, path AS name, CASE WHEN row_number() OVER (ORDER BY md5(path||'20260807')) <= round_even((SELECT count(*) FROM images)*0.18::DOUBLE,0) THEN 'val' ELSE 'train' END AS split FROM images)"""


@query("split_dataset", with_(R.IMAGES, SPLIT_SQL) + "SELECT image_id, name, split FROM sp")
def split_dataset(spark, d):
    return corpus.split_dataset(_named(spark, d)).select("image_id", "name", "split")


LINES = "select o_custkey as image_id, o_orderkey as id, concat(case when o_orderkey%3=0 then '1' else '2' end, ' 0.', 200+o_orderkey%600, ' 0.', 200+o_orderkey*7%600, ' 0.', 100+o_orderkey%150, '  0.', 100+o_orderkey%170, case when o_orderkey%11=0 then ' 9' else '' end) as line from {orders}"
LAB_SQL = """lab AS (SELECT image_id, id, CAST('0.'||(200+id%600) AS DOUBLE) AS cx, CAST('0.'||(200+id*7%600) AS DOUBLE) AS cy, CAST('0.'||(100+id%150) AS DOUBLE) AS w, CAST('0.'||(100+id%170) AS DOUBLE) AS h FROM (SELECT o_custkey AS image_id, o_orderkey AS id FROM orders) WHERE id%3=0 AND id%11<>0)"""


def _labels(spark, d):
    return corpus.label_rows(R.derive(spark, d, LINES))


def _pixel_sql(exp: str) -> str:
    e = f"(1+2*{exp}::DOUBLE)"
    return f"greatest(0,round_even((cx-w*{e}/2)*width,0)) AS x0, greatest(0,round_even((cy-h*{e}/2)*height,0)) AS y0, least(width,round_even((cx+w*{e}/2)*width,0)) AS x1, least(height,round_even((cy+h*{e}/2)*height,0)) AS y1"


@query("label_rows", with_(LAB_SQL) + "SELECT image_id, id, cx, cy, w, h FROM lab")
def label_rows(spark, d):
    return _labels(spark, d).drop("class")


@query("dataset_stats", with_(R.IMAGES, SPLIT_SQL, LAB_SQL)
       + "SELECT split, count(*) AS images, count(*) FILTER (n>0) AS positive, count(*) FILTER (n=0) AS negative, CAST(sum(n) AS BIGINT) AS instances FROM (SELECT sp.*, coalesce(n,0) AS n FROM sp LEFT JOIN (SELECT image_id, count(*) AS n FROM lab GROUP BY 1) USING (image_id)) GROUP BY 1")
def dataset_stats(spark, d):
    return corpus.dataset_stats(corpus.split_dataset(_named(spark, d)), _labels(spark, d))


def _label_boxes(spark, d, expansion):
    j = _labels(spark, d).join(R.images(spark, d).select("image_id", "width", "height"), "image_id")
    return j.withColumns(corpus.pixel_box(expansion)).select("image_id", "id", "width", "height", "x0", "y0", "x1", "y1")


@query(
    "positive_crops",
    with_(R.IMAGES, LAB_SQL)
    + f", a AS (SELECT image_id, id, 'body' AS kind, {_pixel_sql('0.10')} FROM lab JOIN images USING (image_id) UNION ALL SELECT image_id, id, 'context', {_pixel_sql('0.22')} FROM lab JOIN images USING (image_id)) SELECT * FROM a WHERE x1-x0>=12 AND y1-y0>=12",
)
def positive_crops(spark, d):
    a = _label_boxes(spark, d, 0.10).withColumn("kind", F.lit("body"))
    b = _label_boxes(spark, d, 0.22).withColumn("kind", F.lit("context"))
    return corpus.large_enough(a.unionByName(b)).drop("width", "height")


@query(
    "partial_crops",
    with_(R.IMAGES, LAB_SQL, f"b AS (SELECT image_id, id, {_pixel_sql('0.02')} FROM lab JOIN images USING (image_id))")
    + """SELECT image_id, id, 'roof_only' AS kind, x0, y0, x1, round_even(y0+0.48::DOUBLE*(y1-y0),0) AS y1 FROM b UNION ALL SELECT image_id, id, 'eave_band', x0, round_even(y0+0.18::DOUBLE*(y1-y0),0), x1, round_even(y0+0.62::DOUBLE*(y1-y0),0) FROM b
UNION ALL SELECT image_id, id, 'left_fragment', x0, y0, round_even(x0+0.54::DOUBLE*(x1-x0),0), y1 FROM b UNION ALL SELECT image_id, id, 'right_fragment', round_even(x0+0.46::DOUBLE*(x1-x0),0), y0, x1, y1 FROM b""",
)
def partial_crops(spark, d):
    return corpus.partial_crops(_label_boxes(spark, d, 0.02)).drop("width", "height")


def _uni(salt: str) -> str:
    return f"(CAST('0x'||substr(md5(id||'{salt}'),1,8) AS BIGINT)/4294967296.0::DOUBLE)"


BG_SQL = f"""bg0 AS (SELECT image_id, image_id||'/'||n AS id, width, height FROM images, (SELECT unnest([0,1,2]) AS n)),
bg1 AS (SELECT *, round_even(width*0.14::DOUBLE,0)+floor({_uni('w')}*(round_even(width*0.38::DOUBLE,0)-round_even(width*0.14::DOUBLE,0)+1)) AS bw, round_even(height*0.09::DOUBLE,0)+floor({_uni('h')}*(round_even(height*0.26::DOUBLE,0)-round_even(height*0.09::DOUBLE,0)+1)) AS bh FROM bg0),
bg2 AS (SELECT *, floor({_uni('x')}*(width-bw+1)) AS x0, floor({_uni('y')}*(height-bh+1)) AS y0 FROM bg1), bg AS (SELECT image_id, id, x0, y0, x0+bw AS x1, y0+bh AS y1 FROM bg2)"""


@query("background_boxes", with_(R.IMAGES, BG_SQL) + "SELECT image_id, id, x0, y0, x1, y1 FROM bg")
def background_boxes(spark, d):
    return corpus.background_boxes(R.images(spark, d)).select("image_id", "id", "x0", "y0", "x1", "y1")


LB = f"lb AS (SELECT image_id, id, {_pixel_sql('0.02')} FROM lab JOIN images USING (image_id))"
CLEAR = f"cl AS (SELECT * FROM bg a WHERE NOT EXISTS (SELECT 1 FROM lb b WHERE b.image_id=a.image_id AND {R.sql_iou('a', 'b', '1')} >= 0.02))"


def _clear(spark, d):
    bg = corpus.background_boxes(R.images(spark, d)).select("image_id", "id", "x0", "y0", "x1", "y1")
    lab = _label_boxes(spark, d, 0.02).withColumn("id", F.col("id").cast("string"))
    return corpus.clear_of(bg, lab.select("image_id", "id", "x0", "y0", "x1", "y1"))


@query("background_antijoin", with_(R.IMAGES, BG_SQL, LAB_SQL, LB, CLEAR) + "SELECT image_id, id, x0, y0, x1, y1 FROM cl")
def background_antijoin(spark, d):
    return _clear(spark, d)


@query(
    "negative_cap",
    with_(R.IMAGES, SPLIT_SQL, BG_SQL, LAB_SQL, LB, CLEAR)
    + """, ng AS (SELECT split, id FROM cl JOIN sp USING (image_id)), lim AS (SELECT split, count(*) AS n FROM labels l JOIN sp ON sp.image_id=l.doc_id WHERE quality=1 GROUP BY 1)
SELECT split, id FROM (SELECT ng.*, row_number() OVER (PARTITION BY split ORDER BY md5(id||'20260807')) AS rn FROM ng) JOIN lim USING (split) WHERE rn<=n""",
)
def negative_cap(spark, d):
    """Negatives up to the number of good labelled documents of the split."""
    sp = corpus.split_dataset(_named(spark, d)).select("image_id", "split")
    ng = _clear(spark, d).join(sp, "image_id").select("split", "id")
    good = R.table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("image_id")).join(sp, "image_id")
    return corpus.cap_negatives(ng, good)


def texts(spark, d):
    """Documents as release files; some carry planted secrets, paths, suffixes and links."""
    t = R.table(spark, d, "documents")
    plant = F.expr(
        """case doc_id%9 when 0 then concat(' sk-', md5(cast(doc_id as string))) when 1 then ' see /home/someone/notes' when 2 then concat(' ghp_', md5(cast(doc_id as string)))
           when 3 then ' https://ws-abc1.example.org' when 4 then concat(' [a](doc_', doc_id+1, '.md#part) ![b](../x/doc_', doc_id, '.md) [c](https://x.org) [d](#top)') else ' sk-short' end"""
    )
    name = F.expr("concat('docs/doc_', doc_id, case when doc_id%13=0 then '.env' else '.md' end)")
    return t.select("doc_id", name.alias("file"), F.concat("text", plant).alias("text"), (F.col("n_chars") * 600).alias("size"))


TEXT_SQL = """tx AS (SELECT doc_id, 'docs/doc_'||doc_id||CASE WHEN doc_id%13=0 THEN '.env' ELSE '.md' END AS file, text||CASE doc_id%9 WHEN 0 THEN ' sk-'||md5(doc_id::VARCHAR) WHEN 1 THEN ' see /home/someone/notes' WHEN 2 THEN ' ghp_'||md5(doc_id::VARCHAR)
   WHEN 3 THEN ' https://ws-abc1.example.org' WHEN 4 THEN ' [a](doc_'||(doc_id+1)||'.md#part) ![b](../x/doc_'||doc_id||'.md) [c](https://x.org) [d](#top)' ELSE ' sk-short' END AS text, n_chars*600 AS size FROM documents)"""


@query(
    "leak_scan",
    with_(TEXT_SQL)
    + """SELECT file, 'private_or_model_file' AS "check" FROM tx WHERE file LIKE '%.env' UNION ALL SELECT file, 'file_exceeds_10_MiB' FROM tx WHERE size>10485760
UNION ALL SELECT file, 'private_home_path' FROM tx WHERE regexp_matches(text,'/home/[A-Za-z0-9_\\-]+/') UNION ALL SELECT file, 'workspace_endpoint' FROM tx WHERE regexp_matches(text,'https://ws-[a-z0-9]+\\.')
UNION ALL SELECT file, 'api_key_shape' FROM tx WHERE regexp_matches(text,'\\bsk-(?:ws-)?[A-Za-z0-9._-]{18,}') UNION ALL SELECT file, 'github_token_shape' FROM tx WHERE regexp_matches(text,'\\bgh[pousr]_[A-Za-z0-9]{20,}')""",
)
def leak_scan(spark, d):
    return corpus.leak_scan(texts(spark, d))


@query("redact_text", with_(TEXT_SQL) + "SELECT doc_id, md5(regexp_replace(replace(text,'ghp_','[REDACTED]'),'\\bsk-[A-Za-z0-9_-]{8,}\\b','[REDACTED]','g')) AS redacted FROM tx")
def redact_text(spark, d):
    return texts(spark, d).select("doc_id", F.md5(A.redact(F.col("text"), F.lit("ghp_"))).alias("redacted"))


@query(
    "broken_links",
    with_(TEXT_SQL)
    + """, l AS (SELECT file, unnest(regexp_extract_all(text,'!?\\[[^\\]]*\\]\\(([^)]+)\\)',1)) AS target FROM tx), k AS (SELECT file, target, regexp_replace('docs/'||split_part(target,'#',1),'docs/\\.\\./','') AS path FROM l WHERE NOT regexp_matches(target,'^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT starts_with(target,'#'))
SELECT file, target FROM k WHERE path NOT IN (SELECT file FROM tx)""",
)
def broken_links(spark, d):
    t = texts(spark, d)
    return corpus.broken_links(t, t)


@query(
    "page_links",
    "SELECT page_id, count(*) AS links, count(*) FILTER (starts_with(t,'/')) AS local_links FROM (SELECT page_id, unnest(regexp_extract_all(html,'href=\"([^\"]+)\"',1)) AS t FROM pages) GROUP BY 1",
)
def page_links(spark, d):
    """Links per raw page, whole documents."""
    p = R.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("t"))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.startswith("t", F.lit("/"))).alias("local_links"))


# ---- sinks read back, streams --------------------------------------------------------------------


@query("snapshot_versions", "SELECT v AS version, CASE WHEN v=1 THEN NULL ELSE 1 END AS parent_version, count(*) AS n, CAST(sum(o_orderkey*v) AS BIGINT) AS keys FROM orders, (SELECT unnest([1,2]::INT[]) AS v) GROUP BY 1,2")
def snapshot_versions(spark, d):
    """Two written versions of a table, read back with their parent pointers."""
    path = scratch_path(spark, "snapshots")
    o = R.table(spark, d, "orders").select("o_orderkey")
    sinks.write_snapshot(o, path, 1, None)
    sinks.write_snapshot(o.withColumn("o_orderkey", F.col("o_orderkey") * 2), path, 2, 1)
    s = sinks.read_snapshot(spark, path)
    return s.groupBy("version", "parent_version").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("label_sink", with_(R.IMAGES, SPLIT_SQL, LAB_SQL) + "SELECT split, image_id, '0 '||cx||' '||cy||' '||w||' '||h AS line FROM lab JOIN sp USING (image_id)")
def label_sink(spark, d):
    path = scratch_path(spark, "labels")
    sp = corpus.split_dataset(_named(spark, d)).select("image_id", "split")
    sinks.write_labels(_labels(spark, d).join(sp, "image_id"), path)
    return spark.read.schema("split string, image_id bigint, line string").json(path)


@query("proposal_sink", with_(R.BOXES) + "SELECT image_id, id, score, 'yard' AS detector, 0.25::DOUBLE AS box_nms_iou FROM boxes")
def proposal_sink(spark, d):
    path = scratch_path(spark, "proposals")
    sinks.write_proposals(R.boxes(spark, d), path, "yard", 0.1, 0.25)
    p = spark.read.parquet(path)
    return p.select("image_id", "id", "score", "generator.detector", "generator.box_nms_iou")


@query("json_documents", "SELECT event_id AS run_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events")
def json_documents(spark, d):
    """Documents written as JSON text and read back as VARIANT."""
    path = scratch_path(spark, "documents")
    e = R.table(spark, d, "events")
    e.select(F.to_json(F.struct("event_id", F.from_json("props", "k bigint").alias("props"))).alias("value")).write.text(path)
    docs = spark.read.text(path).select(F.try_parse_json("value").alias("doc"))
    return docs.select(F.variant_get("doc", "$.event_id", "bigint").alias("run_id"), F.variant_get("doc", "$.props.k", "bigint").alias("k"))


@query("combined_caches", with_(R.BOXES) + "SELECT 'a' AS cache, count(*) AS n, CAST(count(score) AS BIGINT) AS scored FROM boxes UNION ALL SELECT 'b', count(*), 0 FROM boxes")
def combined_caches(spark, d):
    b = R.boxes(spark, d)
    u = readers.combine([b.withColumn("cache", F.lit("a")), b.drop("score").withColumn("cache", F.lit("b"))])
    return u.groupBy("cache").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))


@query("selection_table", with_(R.IMAGES) + "SELECT image_id, row_number() OVER (ORDER BY path) AS sequence, sha256 FROM images")
def selection_table(spark, d):
    """Catalogue rows numbered in path order, with their hash."""
    im = R.images(spark, d)
    return readers.number_files(im.select("image_id", "path", "sha256")).select("image_id", F.col("id").alias("sequence"), "sha256")


def _run_stream(spark, d, pattern="events.parquet", schema=None):
    raw = live.answer_stream(spark, d, schema or R.table(spark, d, "events").schema, pattern)
    return raw.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("image_id"), "ts",
        *[F.expr(x).alias(n) for n, x in R.RUN_EXPR.items()], F.lit(R.MODEL).alias("model_requested"),
        F.expr("case event_id%4 when 0 then concat('```json\\n', props, '\\n```') when 1 then concat('<think>maybe {1}</think> ', props) when 2 then substr(props, 1, length(props)-1) else props end").alias("answer"),
    )


@query("stream_intake", with_(R.RUNS) + GATED + " SELECT image_id, stage, label, min_by(run_id, epoch_us(ts)*1000000::HUGEINT+run_id) AS run_id FROM gated WHERE refused IS NULL GROUP BY 1,2,3")
def stream_intake(spark, d):
    sink, state = scratch_path(spark, "accepted"), scratch_path(spark, "accepted-state")
    live.accept_once(_run_stream(spark, d), sink, state)
    return spark.read.parquet(sink).select("image_id", "stage", "label", "run_id")


@query("stream_keyed_intake", with_(R.RUNS) + GATED + " SELECT image_id, stage, label, min_by(run_id, epoch_us(ts)*1000000::HUGEINT+run_id) AS run_id FROM gated WHERE refused IS NULL GROUP BY 1,2,3")
def stream_keyed_intake(spark, d):
    """All events as files in the order of time, a micro-batch and a restart for each sixth; most requests outlive their state."""
    e = R.table(spark, d, "events")
    low, high = e.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    step = ((high or 0) - (low or 0)) // 6 + 1
    source, sink, state = (scratch_path(spark, n) for n in ("keyed-source", "keyed", "keyed-state"))
    part = F.expr(f"(unix_micros(cast(ts as timestamp)) - {low or 0}) div {step}")
    for k in range(6):
        e.filter(part == k).write.mode("append").parquet(source)
        answered.accept_keyed(_run_stream(spark, source, "*.parquet", schema=e.schema), sink, state, keep="5 days", check_ms=1)
    return spark.read.parquet(sink).select("image_id", "stage", "label", "run_id")


@query(
    "stream_tally",
    with_(R.RUNS) + GATED
    + """ SELECT strftime(date_trunc('day', ts),'%Y-%m-%d') AS day, coalesce(refused,'accepted') AS reason, count(*) AS n,
  date_trunc('day',ts) + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS open FROM gated GROUP BY 1,2,4""",
)
def stream_tally(spark, d):
    """Daily tally, windows that may still grow marked."""
    sink, state = scratch_path(spark, "tally"), scratch_path(spark, "tally-state")
    live.tally_rejections(_run_stream(spark, d), sink, state)
    t = live.rejection_windows(spark, sink)
    return t.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "reason", "n", "open")
