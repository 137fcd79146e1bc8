"""Normalised against raw answers, stored against present rules, logs of changes, replaced lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..plans import history, versions
from . import recipes as R
from .plans_q import CL, EDIT, EDITS_SQL, USED
from .registry import query, with_
from .rulesets import BUILDING_ISSUES, CANDS, ZONE_IDS, union

# answers of one to three candidates, some without their stage or with another one
ANSWER_ROWS = CANDS.replace("o_custkey as doc_id", "o_custkey*8+o_orderkey%8 as doc_id")
ANSWERS = """select doc_id, 'plan_buildings' as requested_stage, case when doc_id%3=0 then cast(null as string) when doc_id%7=0 then 'landmarks' else 'plan_buildings' end as stage
  from (select distinct o_custkey*8+o_orderkey%8 as doc_id from {orders}) o"""
GEOMETRY = f"({R.sql_box_ok()} AND {R.sql_point('ax', 'ay')} AND {R.sql_quad_ok()} AND {R.SQL_RATIO_OK})"
SEMANTIC = "category NOT IN ('house','other') OR anchor_status NOT IN ('visible_partial','inferred','outside_crop')"
JUDGED = (
    R.cte("ca", ANSWER_ROWS),
    R.cte("an", ANSWERS),
    f"""per AS (SELECT doc_id, count(*) FILTER (NOT {GEOMETRY}) AS g, count(*) FILTER ({SEMANTIC}) AS s0,
    count(*) FILTER ({SEMANTIC.replace("anchor_status", "replace(anchor_status,'partial_visible','visible_partial')")}) AS s1, count(*) FILTER (anchor_status='partial_visible') AS al FROM ca GROUP BY 1),
  dup AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, id FROM ca GROUP BY 1,2 HAVING count(*)>1) GROUP BY 1),
  judged AS (SELECT an.*, al+(stage IS NULL)::INT AS wanted, g+s0+coalesce(n,0)+(stage IS DISTINCT FROM requested_stage)::INT AS b, g+s1+coalesce(n,0)+(coalesce(stage,requested_stage)<>requested_stage)::INT AS a
    FROM an JOIN per USING (doc_id) LEFT JOIN dup USING (doc_id)),
  c0 AS (SELECT * FROM ca), c1 AS (SELECT * REPLACE (replace(anchor_status,'partial_visible','visible_partial') AS anchor_status) FROM ca WHERE doc_id IN (SELECT doc_id FROM judged WHERE wanted>0))""",
)


def _normalized(spark, d):
    return versions.normalize_answers(R.derive(spark, d, ANSWERS), R.derive(spark, d, ANSWER_ROWS), rules.candidate_issues)


@query(
    "normalized_envelope",
    with_(*JUDGED)
    + """SELECT doc_id, CASE WHEN wanted>0 AND a=0 AND stage IS NULL THEN requested_stage ELSE stage END AS stage, CASE WHEN wanted>0 AND a=0 THEN wanted ELSE 0 END::INT AS changes,
  b AS issues_before, CASE WHEN wanted>0 THEN a END AS issues_after FROM judged""",
)
def normalized_envelope(spark, d):
    """Answers with metadata filled in where the whole result then passes the rules; issues of either version counted."""
    return _normalized(spark, d)[0].select("doc_id", "stage", "changes", "issues_before", "issues_after")


@query(
    "normalized_rows",
    with_(*JUDGED)
    + "SELECT ca.doc_id, id, CASE WHEN wanted>0 AND a=0 THEN replace(anchor_status,'partial_visible','visible_partial') ELSE anchor_status END AS anchor_status FROM ca JOIN judged USING (doc_id)",
)
def normalized_rows(spark, d):
    return _normalized(spark, d)[1].select("doc_id", "id", "anchor_status")


def _sql_version(v: int) -> str:
    stage = "stage IS DISTINCT FROM requested_stage" if v == 0 else "wanted>0 AND coalesce(stage,requested_stage)<>requested_stage"
    parts = union(
        R.sql_issue("candidate_geometry", f"c{v} WHERE NOT {GEOMETRY}"),
        R.sql_issue("semantic_fields", f"c{v} WHERE {SEMANTIC}"),
        R.sql_duplicates("duplicate_id", f"c{v}", "doc_id, id"),
        R.sql_issue("wrong_stage", f"judged WHERE {stage}", entity="'document'"),
    )
    return f"SELECT doc_id, {v} AS version, entity_id, rule FROM ({parts})"


@query("version_issues", with_(*JUDGED) + _sql_version(0) + " UNION ALL " + _sql_version(1))
def version_issues(spark, d):
    """Issues of the answers as given (0) and as normalised (1), from one pass of the rules."""
    return _normalized(spark, d)[2].select("doc_id", "version", "entity_id", "rule")


WHOLE = "(k%41<>0 AND k%43<>0)"


def _stored_runs(spark, d):
    """One stored answer a building, as JSON text; some cut off, some marked so."""
    b = R.derive(spark, d, R.BUILDING_TEXT_ROWS)
    text = F.to_json(F.struct(*b.columns))
    return b, b.select(
        F.concat_ws("/", "doc_id", "id").alias("run_id"),
        F.expr("case when k%41=0 then 'length' else 'stop' end").alias("finish_reason"),
        F.when(F.col("k") % 43 == 0, F.substring(text, 1, 40)).otherwise(text).alias("answer"),
    )


def _revalidated(spark, d):
    b, runs = _stored_runs(spark, d)
    zones = R.derive(spark, d, ZONE_IDS)
    former = {"plan_size": rules.bad((F.col("w") > 0) & (F.col("w") < 150) & (F.col("d") > 0) & (F.col("d") < 150))}
    return versions.revalidate(runs, b.schema.simpleString(), lambda rows: rules.building_issues(rows, zones), rules.row_issues(b, former))


@query(
    "revalidation_change",
    with_(R.cte("every", R.BUILDING_TEXT_ROWS), R.cte("zo", ZONE_IDS), f"bl AS (SELECT * FROM every WHERE {WHOLE})")
    + f""", old AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, id AS entity_id, 'plan_size' AS rule FROM every WHERE NOT (w>0 AND w<150 AND d>0 AND d<150)),
new AS ({BUILDING_ISSUES})
SELECT doc_id, entity_id, rule, bool_or(w) AS was, bool_or(n) AS now FROM (SELECT *, TRUE AS w, FALSE AS n FROM old UNION ALL SELECT *, FALSE, TRUE FROM new) GROUP BY 1,2,3""",
)
def revalidation_change(spark, d):
    """Issues stored under a stricter former size rule against all present rules, which run on the stored texts again."""
    return _revalidated(spark, d)[0]


@query(
    "revalidation_refused",
    with_(R.cte("every", R.BUILDING_TEXT_ROWS)) + f"SELECT doc_id||'/'||id AS run_id, 'incomplete' AS refused FROM every WHERE NOT {WHOLE}",
)
def revalidation_refused(spark, d):
    return _revalidated(spark, d)[1]


LOG = """select user_id%50 as plan_id, user_id as id, event_id as seq, case when event_type='error' and event_id%3=0 then 'remove' else 'set' end as op,
  case when event_id%5=0 then cast(null as double) else value end as score, event_type as label, event_id%4 as level,
  case event_id%4 when 0 then array('score') when 1 then array('label','level') when 2 then array('score','label') else array('level') end as stated from {events}"""


@query(
    "current_state",
    with_(
        R.cte("lg", LOG.replace("array(", "list_value(")),
        "gone AS (SELECT plan_id, id, max(seq) AS gone_at FROM lg WHERE op='remove' GROUP BY 1,2)",
        "live AS (SELECT lg.*, row_number() OVER (PARTITION BY lg.plan_id, lg.id ORDER BY seq DESC) AS back FROM lg LEFT JOIN gone USING (plan_id, id) WHERE op='set' AND (gone_at IS NULL OR seq>gone_at))",
    )
    + "SELECT l.plan_id, l.id, "
    + ", ".join(f"(SELECT {f} FROM live s WHERE s.plan_id=l.plan_id AND s.id=l.id AND list_contains(s.stated,'{f}') ORDER BY seq DESC LIMIT 1) AS {f}" for f in ("score", "label", "level"))
    + ", l.seq AS version FROM live l WHERE back=1",
)
def current_state(spark, d):
    """Last stated value of each field since the last removal, out of a log of changes."""
    return history.current_state(R.derive(spark, d, LOG), ["plan_id", "id"], ["score", "label", "level"])


PATCH = """case c_custkey%6 when 0 then '{}' when 1 then '{"replace_rejected":null}' when 2 then '{"replace_rejected":[]}'
  when 3 then '{"replace_rejected":[{"source_id":"s1","reason":"seen twice"},{"source_id":"s2","reason":"shadow"}]}' when 4 then '{"replace_rejected":"all"}' else '{"replace_rejected":[{"source_id":"s3"}],"note":1}' end"""
SAYS = """CASE plan_id%6 WHEN 0 THEN 'absent' WHEN 1 THEN 'null' WHEN 2 THEN 'empty' WHEN 4 THEN 'not_a_list' ELSE 'list' END"""


def _rejections(spark, d):
    cl = R.derive(spark, d, CL)
    old = cl.filter("owner is null").select("plan_id", "source_id", F.lit("before").alias("reason"))
    reviewed = R.table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'")
    patches = reviewed.select(F.col("c_custkey").alias("plan_id"), F.try_parse_json(F.expr(PATCH)).alias("patch"))
    removed = spark.sql(USED, edits=R.derive(spark, d, EDIT)).filter("op = 'remove'").select("plan_id", "id", "merge_into", F.lit("gone").alias("reason"))
    return old, patches, removed, cl.filter("owner is not null")


@query(
    "replaced_rejections",
    with_(*EDITS_SQL, "pt AS (SELECT c_custkey AS plan_id FROM customer WHERE c_mktsegment<>'BUILDING')")
    + """SELECT plan_id, source_id, 'before' AS reason FROM cl WHERE owner IS NULL AND plan_id NOT IN (SELECT plan_id FROM pt WHERE plan_id%6 IN (2,3,5))
UNION ALL SELECT plan_id, unnest(['s1','s2']), unnest(['seen twice','shadow']) FROM pt WHERE plan_id%6=3
UNION ALL SELECT plan_id, 's3', NULL FROM pt WHERE plan_id%6=5
UNION ALL SELECT cl.plan_id, source_id, 'gone' FROM cl JOIN rm ON rm.plan_id=cl.plan_id AND rm.id=cl.owner WHERE merge_into IS NULL""",
)
def replaced_rejections(spark, d):
    """Rejections after a review that may replace the whole list: list, empty list, null and silence told apart."""
    return history.review_rejections(*_rejections(spark, d))


@query("patch_says", f"SELECT c_custkey AS plan_id, {SAYS.replace('plan_id', 'c_custkey')} AS says FROM customer WHERE c_mktsegment<>'BUILDING'")
def patch_says(spark, d):
    old, patches, *_ = _rejections(spark, d)
    return history.replaced_lists(old, patches, "replace_rejected", "source_id string, reason string")[1]


@query(
    "repaired_ownership",
    with_(R.cte("cl", CL)) + "SELECT plan_id, source_id, owner, CASE WHEN owner IS NULL THEN 'no building '||plan_id%3 END AS reason FROM cl",
)
def repaired_ownership(spark, d):
    """Ownership rebuilt from assignments; those without a target are rejections with their reason."""
    why = F.expr("concat('no building ', plan_id % 3)").alias("reason")
    owned, rejected = history.rebuilt_ownership(R.derive(spark, d, CL).select("plan_id", "source_id", F.col("owner").alias("target"), why))
    return owned.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected.withColumn("owner", F.lit(None).cast("string")))
