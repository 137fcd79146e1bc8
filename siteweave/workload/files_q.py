"""Files written from the given tables and read back: catalogues, labels, typed answers, look-ups by path and slug."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, summary
from ..plans import cuboid
from ..session import scratch_path
from ..sources import readers
from . import recipes as R
from .registry import query, with_


@query(
    "image_catalogue",
    """SELECT f.name, f.n AS expected_rows, b.bytes, b.sha256, b.bytes IS NOT NULL AS present
FROM (SELECT CAST(o_custkey//32 AS VARCHAR) AS name, count(*) AS n FROM orders GROUP BY 1) f
LEFT JOIN (SELECT CAST(c_custkey//32 AS VARCHAR) AS name, CAST(sum(length(c_name)+1) AS BIGINT) AS bytes, sha256(string_agg(c_name||chr(10), '' ORDER BY c_name)) AS sha256
  FROM customer GROUP BY 1 HAVING min(c_custkey)%64<>0) b USING (name)""",
)
def image_catalogue(spark, d):
    """Files of up to 32 names found by a scan with their size and content hash; expected ones that are not there."""
    path = scratch_path(spark, "catalogue")
    c = R.table(spark, d, "customer").withColumn("part", F.expr("c_custkey div 32"))
    absent = c.groupBy("part").agg(F.min("c_custkey").alias("least")).filter("least % 64 = 0")
    held = c.join(absent, "part", "left_anti").select("part", "c_name").repartition("part").sortWithinPartitions("part", "c_name")
    held.write.partitionBy("part").text(path)
    files = readers.image_catalogue(spark, path, "*.txt").withColumn("name", F.regexp_extract("path", r"part=(\d+)/", 1))
    expected = R.table(spark, d, "orders").groupBy(F.expr("o_custkey div 32").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("expected_rows"))
    return readers.match_files(expected, files).select("name", "expected_rows", "bytes", "sha256", "present")


@query(
    "label_reader",
    """SELECT CAST(n_nationkey AS VARCHAR) AS image_id, count(c_custkey) AS n, sum(CASE WHEN c_custkey IS NULL THEN NULL WHEN c_custkey%3=0 THEN 0.25 ELSE 0.5 END)::DOUBLE AS cx, count(c_custkey)>0 AS labelled
FROM nation LEFT JOIN customer ON c_nationkey=n_nationkey AND c_custkey%5<>0 AND n_nationkey%4<>1 GROUP BY 1""",
)
def label_reader(spark, d):
    """Label lines of the building class with five fields, from text files; others are left out, a missing file is an empty one."""
    path = scratch_path(spark, "label-lines")
    c = R.table(spark, d, "customer").filter("c_nationkey % 4 <> 1")
    line = F.expr("concat(case when c_custkey%5=0 then '0' else '1' end, ' ', case when c_custkey%3=0 then '0.25' else '0.5' end, ' 0.5 0.2 0.2')")
    c.select(F.col("c_nationkey").alias("part"), line.alias("value")).write.partitionBy("part").text(path)
    rows = corpus.label_rows(readers.label_lines(spark, path, r"part=(\d+)/"))
    images = R.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("image_id"))
    found = readers.labels_of_images(images, rows)
    return found.groupBy("image_id").agg(F.count("cx").alias("n"), F.sum("cx").alias("cx"), F.bool_or("labelled").alias("labelled"))


SCHEMAS = {
    "review": {"$.k": "bigint", "$.objects": "array<struct<id:string>>"},
    "structure": {"$.paths": "array<array<double>>"},
    "audit": {"$.verdict.kind": "string", "$.k": "bigint"},
}
STAGE = "case event_id%5 when 1 then 'structure' when 2 then 'audit' when 3 then 'poetry' else 'review' end"
ANSWER = """case event_id%7 when 0 then concat('{"k":', cast(event_id as string), ',"objects":[{"id":"a"}],"paths":[[1,2.5]],"verdict":{"kind":"ok"}}')
  when 1 then concat('{"k":', cast(event_id as string), ',"objects":3,"paths":"x","verdict":{"kind":"ok"}}') when 2 then '{"k":"many","objects":[],"paths":[],"verdict":{}}'
  when 3 then '[1]' when 4 then '{"k":1' when 5 then '{"verdict":null,"paths":[null]}' else '{"k":2,"objects":[],"paths":[[]],"verdict":{"kind":"no"}}' end"""
# what each of the seven answers lacks, by stage
LACKS = """CASE WHEN stage='poetry' THEN NULL WHEN form IN (3,4) THEN '$' WHEN stage='review' THEN CASE form WHEN 1 THEN '$.objects' WHEN 2 THEN '$.k' WHEN 5 THEN '$.k' END
  WHEN stage='structure' THEN CASE form WHEN 1 THEN '$.paths' END ELSE CASE form WHEN 2 THEN '$.verdict.kind' WHEN 5 THEN '$.verdict.kind' END END"""
STAGED_SQL = f"st AS (SELECT event_id AS run_id, event_id%7 AS form, {STAGE} AS stage FROM events), lk AS (SELECT *, {LACKS} AS path FROM st)"


def _dispatched(spark, d):
    e = R.table(spark, d, "events")
    runs = e.select(F.col("event_id").alias("run_id"), F.expr(STAGE).alias("stage"), F.expr(ANSWER).alias("answer"))
    return readers.dispatch_answers(runs, SCHEMAS)


@query("dispatch_issues", with_(STAGED_SQL) + "SELECT run_id, CASE WHEN stage='poetry' THEN 'unknown_stage' ELSE 'malformed' END AS rule, path FROM lk WHERE stage='poetry' OR path IS NOT NULL")
def dispatch_issues(spark, d):
    """Each answer against the schema of its own stage; one issue with the first path that does not fit."""
    return _dispatched(spark, d)[1]


@query(
    "dispatched_answers",
    with_(STAGED_SQL) + "SELECT run_id, CASE WHEN form IN (0,1) THEN run_id ELSE 2 END AS k, CASE WHEN form IN (0,1) THEN 'ok' ELSE 'no' END AS kind FROM lk WHERE stage='audit' AND path IS NULL",
)
def dispatched_answers(spark, d):
    """Typed columns of the answers of one stage."""
    return readers.stage_fields(_dispatched(spark, d)[0], SCHEMAS, "audit").select("run_id", "k", "kind")


SLUGS = "select c_custkey as sequence, lower(replace(c_name, '#', '-')) as slug, c_mktsegment as title from {customer}"
CREDITS = "select lower(concat('customer-', lpad(cast(s_suppkey as string), 9, '0'))) as slug, s_name as title, s_nationkey as museum from {supplier}"


@query(
    "slug_lookup",
    "SELECT c_custkey AS sequence, 'customer-'||lpad(CAST(c_custkey AS VARCHAR),9,'0') AS slug, CASE WHEN s_suppkey IS NULL THEN c_mktsegment ELSE s_name END AS title, s_nationkey AS museum FROM customer LEFT JOIN supplier ON s_suppkey=c_custkey",
)
def slug_lookup(spark, d):
    """Entries with the credits of their slug; those without any beside them."""
    found, none = readers.by_slug(R.derive(spark, d, SLUGS), R.derive(spark, d, CREDITS))
    return found.unionByName(none, allowMissingColumns=True)


AUDIT_RUNS = """select o_orderkey as pos, case o_orderkey%3 when 0 then concat('runs/', o_custkey, '/./structure') when 1 then concat('runs//x/../', o_custkey, '/structure') else concat('runs/', o_custkey, '/structure/') end as prior_dir,
  concat('audit/', o_orderkey) as output_dir, o_orderkey%5 as exit_code from {orders}"""


@query(
    "run_matches",
    "SELECT 'runs/'||c_custkey||'/a/../structure' AS output_dir, 'audit/'||max(o_orderkey) AS audit_dir FROM customer JOIN orders ON o_custkey=c_custkey AND o_orderkey%5=0 GROUP BY c_custkey",
)
def run_matches(spark, d):
    """Structure runs with their last good audit, matched by resolved path."""
    runs = R.table(spark, d, "customer").select(F.concat(F.lit("runs/"), "c_custkey", F.lit("/a/../structure")).alias("output_dir"))
    return summary.run_matches(runs, R.derive(spark, d, AUDIT_RUNS))


RATIOS = """select l_orderkey as scene_id, 'H' as id, cast(l_linenumber as double)/2+cast(3 as double)/2 as ratio, max(cast(cast(l_discount*100 as int) as double)/10) as iou,
  cast(l_orderkey%10 as double)/10 as observability from {lineitem} group by 1, 2, 3, 5"""


@query(
    "chosen_ratio",
    with_(
        R.cte("ra", RATIOS),
        """b AS (SELECT scene_id, id, max(iou) AS best_iou, max(CASE WHEN ratio=3 THEN iou END) AS fallback_iou, max(observability) AS seen FROM ra GROUP BY 1,2),
r AS (SELECT scene_id, id, ratio AS best_ratio, row_number() OVER (PARTITION BY scene_id, id ORDER BY iou DESC, abs(ratio-3), ratio) AS place FROM ra),
j AS (SELECT b.*, best_ratio, best_iou-fallback_iou AS gain, coalesce(seen>=0.35::DOUBLE AND best_iou>=0.38::DOUBLE AND best_iou-fallback_iou>=0.05::DOUBLE, FALSE) AS accepted FROM b JOIN r USING (scene_id, id) WHERE place=1)""",
    )
    + "SELECT scene_id, id, CASE WHEN accepted THEN best_ratio ELSE 3::DOUBLE END AS ratio, accepted, best_ratio, best_iou, fallback_iou, gain FROM j",
)
def chosen_ratio(spark, d):
    """Best aspect ratio a house, ties nearest three, three gates."""
    return cuboid.chosen_ratio(R.derive(spark, d, RATIOS))
