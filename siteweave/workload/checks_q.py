"""Choices, priors and caches that must be refused; documents written and read back by the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, intake
from ..operators.proposals import numbered
from ..plans import evidence
from ..session import cut, scratch_path
from ..sources import readers, sinks
from . import recipes as R
from .intake_q import CHECKED, NORMED, PRIOR_RUN
from .registry import query, with_

CHOSEN = "select o_custkey as plan_id, case when l_partkey%41=0 then concat('X', l_orderkey) else concat('B', l_orderkey, '-', l_linenumber%5) end as id from {lineitem} join {orders} on l_orderkey=o_orderkey"
KNOWN = "select o_custkey as plan_id, concat('B', o_orderkey, '-', k) as id from {orders}, (select 0 as k union all select 1 union all select 2 union all select 3) n"


@query(
    "selection_issues",
    with_(R.cte("ch", CHOSEN), R.cte("kn", KNOWN))
    + """SELECT plan_id, id, 'repeated_selection' AS rule FROM ch GROUP BY 1,2 HAVING count(*)>1
UNION ALL SELECT DISTINCT plan_id, id, 'unknown_selection' FROM ch WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.plan_id=ch.plan_id AND kn.id=ch.id)""",
)
def selection_issues(spark, d):
    return evidence.selection_issues(R.derive(spark, d, CHOSEN), R.derive(spark, d, KNOWN))


@query(
    "refused_priors",
    with_(R.RUNS, R.cte("r", PRIOR_RUN), R.cte("n", NORMED), R.cte("v", CHECKED))
    + """, p AS (SELECT r.run_id, v.run_id IS NOT NULL AND r.stage IN ('landmarks','ground_hypotheses','ground_check') AND v.source_sha256<>r.sha256 AS stale FROM r LEFT JOIN v USING (run_id)),
j AS (SELECT p.run_id, CASE WHEN stale THEN 'stale_validation' WHEN finish_reason<>'stop' THEN 'incomplete' WHEN issues>0 THEN 'invalid'
  WHEN NOT (model_returned=model_requested OR starts_with(model_returned, model_requested||'-')) THEN 'wrong_model' END AS reason FROM p JOIN runs USING (run_id))
SELECT run_id, reason FROM j WHERE reason IS NOT NULL""",
)
def refused_priors(spark, d):
    priors = intake.load_prior(R.derive(spark, d, PRIOR_RUN), R.derive(spark, d, NORMED), R.derive(spark, d, CHECKED))
    return intake.refused_priors(priors, R.runs(spark, d).select("run_id", "finish_reason", "issues", "model_requested", "model_returned"))


CACHED = f"""select c_custkey as image_id, case when c_custkey%19=0 then 'other' else '{intake.ORIENTATION_STAGE}' end as stage, cast(800 + c_custkey*13%1700 + case when c_custkey%17=0 then 1 else 0 end as double) as width,
  cast(600 + c_custkey*29%1500 as double) as height, concat('i', case when c_custkey%13=0 then -1 else c_custkey end) as image_sha256, concat('d', case when c_custkey%11=0 then -1 else c_custkey end) as detection_sha256 from {{customer}}"""
PAINTED = "select c_custkey as image_id, cast(800 + c_custkey*13%1700 as double) as width, cast(600 + c_custkey*29%1500 as double) as height, concat('i', c_custkey) as sha256 from {customer}"
DETECTED = "select o_custkey as image_id, concat('d', o_custkey) as sha256 from {orders} group by o_custkey"


@query(
    "stale_orientations",
    with_(R.cte("ca", CACHED), R.cte("im", PAINTED), R.cte("de", DETECTED))
    + f""", j AS (SELECT ca.image_id, CASE WHEN stage<>'{intake.ORIENTATION_STAGE}' THEN 'stage' WHEN ca.width<>im.width OR ca.height<>im.height THEN 'image_size'
  WHEN image_sha256<>im.sha256 THEN 'image_changed' WHEN de.sha256 IS NULL OR detection_sha256<>de.sha256 THEN 'detections_changed' END AS reason FROM ca JOIN im USING (image_id) LEFT JOIN de USING (image_id))
SELECT image_id, reason FROM j WHERE reason IS NOT NULL""",
)
def stale_orientations(spark, d):
    return intake.stale_orientations(R.derive(spark, d, CACHED), R.derive(spark, d, PAINTED), R.derive(spark, d, DETECTED))


# ---- documents written as text and read back ---------------------------------------------------------


#: Entries that one written document holds at most.
ENTRIES = 10_000


def _documents(rows, order, before, after, path):
    """JSON documents in folders ``part=.../chunk=...``, of at most ``ENTRIES`` rows each: columns part, entry.

    Rows are numbered over the whole table, so that a hot part, or one without name, comes in as many documents as it needs.
    """
    dealt = numbered(rows, ["part", order], "_row").withColumn("chunk", F.floor(F.col("_row") / ENTRIES).cast("bigint"))
    value = F.concat(F.lit(before), F.array_join(F.collect_list("entry"), ","), F.lit(after)).alias("value")
    dealt.groupBy("part", "chunk").agg(value).repartition("part", "chunk").write.partitionBy("part", "chunk").text(path)


@query(
    "manifest_reader",
    "SELECT user_id%25 AS part, event_type AS stage, count(*) AS jobs, count(*) FILTER (event_id%9=0) AS failed FROM events GROUP BY 1,2",
)
def manifest_reader(spark, d):
    """Survey manifests of 25 users' groups, in files of bounded size that are read as whole documents."""
    path = scratch_path(spark, "manifests")
    e = R.table(spark, d, "events")
    code = F.when(F.col("event_id") % 9 == 0, F.lit(2)).otherwise(F.lit(0))
    job = F.to_json(F.struct(F.col("event_type").alias("stage"), F.lit("whole").alias("label"), code.alias("exit_code"), F.col("event_id").cast("string").alias("run")))
    _documents(e.select((F.col("user_id") % 25).alias("part"), "event_id", job.alias("entry")), "event_id", '{"jobs":[', "]}", path)
    jobs = readers.manifest_jobs(readers.json_documents(spark, path, "*.txt"))
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint")
    return jobs.groupBy(part.alias("part"), "stage").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("exit_code") != 0).alias("failed"))


def _priors(spark, d):
    path = scratch_path(spark, "priors")
    c = R.table(spark, d, "customer").withColumns({"part": F.col("c_nationkey"), "scene_id": F.col("c_custkey")})
    camera = F.struct(
        (30 + F.col("scene_id") % 30).alias("pitch_deg"), (F.col("scene_id") % 21 - 10).alias("azimuth_deg"),
        (60 + F.col("scene_id") % 50).alias("scale"), F.lit(0.5).alias("offset_y"),
    )
    houses = F.when(F.col("scene_id") % 7 == 0, F.array().cast("array<string>"))
    pair = F.format_string('[["H%d","H%d",0.5]]', "scene_id", F.col("scene_id") + 1)
    body = F.to_json(F.struct(camera.alias("camera"), houses.alias("houses")))
    # the mixed array of an occlusion has no type of its own, so it is put in as text
    rows = c.withColumn("body", F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"occlusion":'), pair, F.lit("}")))
    entry = F.concat(F.lit('"S'), F.col("scene_id").cast("string"), F.lit('":'), F.col("body"))
    _documents(rows.select("part", "scene_id", entry.alias("entry")), "scene_id", '{"scenes":{', "}}", path)
    return readers.scene_priors(readers.json_documents(spark, path, "*.txt"))


@query(
    "prior_cameras",
    "SELECT 'S'||c_custkey AS scene_id, CAST(30+c_custkey%30 AS DOUBLE) AS pitch_deg, CAST(c_custkey%21-10 AS DOUBLE) AS azimuth_deg, CAST(60+c_custkey%50 AS DOUBLE) AS scale, 0.5::DOUBLE AS offset_ratio FROM customer WHERE c_custkey%7<>0",
)
def prior_cameras(spark, d):
    """Cameras of scene priors; scenes that carry house coordinates are refused."""
    return _priors(spark, d)[0].drop("body")


@query("prior_occlusion", "SELECT 'S'||c_custkey AS scene_id, 'H'||c_custkey AS src, 'H'||(c_custkey+1) AS dst, 0.5::DOUBLE AS confidence FROM customer WHERE c_custkey%7<>0")
def prior_occlusion(spark, d):
    return readers.occlusion_edges(_priors(spark, d)[0])


@query(
    "missing_priors",
    "SELECT DISTINCT 'S'||o_custkey AS scene_id FROM orders WHERE o_custkey%7=0",
)
def missing_priors(spark, d):
    """Scenes with buildings that have no usable prior."""
    scenes = R.table(spark, d, "orders").select(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("scene_id")).distinct()
    return scenes.join(_priors(spark, d)[0].select("scene_id"), "scene_id", "left_anti")


@query(
    "typed_answers",
    with_(R.RUNS) + "SELECT CAST(run_id AS VARCHAR) AS run_id, CASE WHEN json_valid(answer) THEN CAST(json_extract(answer,'$.k') AS BIGINT) END AS k, CASE WHEN json_valid(answer) THEN NULL ELSE 'malformed' END AS rule FROM runs",
)
def typed_answers(spark, d):
    """Answers as typed rows, malformed ones as one issue each."""
    typed, bad = readers.typed_answers(R.runs(spark, d).select("run_id", "answer"), "k bigint")
    good = typed.select(F.col("run_id").cast("string").alias("run_id"), F.col("data.k").alias("k"), F.lit(None).cast("string").alias("rule"))
    return good.unionByName(bad.select(F.col("doc_id").alias("run_id"), F.lit(None).cast("bigint").alias("k"), "rule"))


URGENT = "select distinct o_custkey as image_id from {orders} where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"


@query("selection_sink", with_(R.IMAGES, R.cte("urgent", URGENT)) + "SELECT image_id, id, sha256 FROM (SELECT image_id, row_number() OVER (ORDER BY path) AS id, sha256 FROM images) JOIN urgent USING (image_id)")
def selection_sink(spark, d):
    """The whole catalogue numbered; the images of urgent orders chosen by number, written with their hash, and read back."""
    path = scratch_path(spark, "selection")
    catalogue = cut(readers.number_files(R.images(spark, d).select("image_id", "path", "sha256")))
    choices = R.derive(spark, d, URGENT).join(catalogue, "image_id").select("id", "image_id")
    sinks.select_entries(catalogue.select("id", "sha256"), choices, path)
    return spark.read.parquet(path).select("image_id", "id", "sha256")


STAGED = "select o_custkey as plan_id, o_orderkey as id, cast(o_orderkey%900 as double) as ax, cast(o_orderkey%700 as double) as ay from {orders} where o_orderstatus='P'"


@query(
    "staged_missing",
    with_(R.cte("st", STAGED)) + "SELECT plan_id, id, ax, ay, TRUE AS review_only, 'low' AS confidence, 10::DOUBLE AS w, 10::DOUBLE AS d, 1::DOUBLE AS ratio_low, 1::DOUBLE AS ratio_high FROM st",
)
def staged_missing(spark, d):
    """Provisional records of missing observations, which publication refuses."""
    return evidence.stage_missing(R.derive(spark, d, STAGED))
