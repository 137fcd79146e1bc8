"""Rule-set queries: one issue row per broken rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..session import cut
from . import recipes as R
from .registry import query, with_

UNION = "\nUNION ALL\n"


def union(*parts: str) -> str:
    return UNION.join(parts)


# ---- inventory and review ----------------------------------------------------------------

INV = f"""select concat(cast(o_custkey as string), ':', o_orderstatus) as doc_id, case when o_orderkey%83=0 then '' else concat('b', o_orderkey%60) end as id,
  {R.CATEGORY} as category, cast(o_orderkey*37%600 as double) as x0, cast(o_orderkey*53%600 as double) as y0,
  cast(o_orderkey*37%600+o_orderkey*17%450 as double) as x1, cast(o_orderkey*53%600+100+o_orderkey*29%300 as double) as y1,
  case when o_orderkey%3=0 then concat('b', (o_orderkey*7)%60) end as occluder from {{orders}}"""


@query(
    "inventory_issues",
    with_(R.cte("inv", INV))
    + union(
        R.sql_issue("missing_id", "inv WHERE length(id)=0"),
        R.sql_issue("unsupported_category", "inv WHERE category NOT IN ('house','tree','mountain','water','flat','other')"),
        R.sql_issue("bbox_range", "inv WHERE NOT (0<=x0 AND x0<x1 AND x1<=1000 AND 0<=y0 AND y0<y1 AND y1<=1000)"),
        R.sql_duplicates("duplicate_id", "inv", "doc_id, id"),
        R.sql_issue("unknown_occluder", "inv a WHERE occluder IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inv b WHERE b.doc_id=a.doc_id AND b.id=a.occluder)", distinct=True),
    ),
)
def inventory_issues(spark, d):
    return rules.inventory_issues(R.derive(spark, d, INV))


REVIEWED = """select o_custkey as doc_id, concat('B', o_orderkey) as id, case when o_orderkey%7=0 then 'uncertain' when o_orderkey%41=0 then 'maybe' else 'supported' end as status from {orders}"""


def _claims(spark, d):
    return R.claims(spark, d).withColumnRenamed("plan_id", "doc_id")


CLAIMS_DOC = "cl AS (SELECT plan_id AS doc_id, source_id, owner FROM claims)"
EXPECTED_DOC = "ex AS (SELECT plan_id AS doc_id, source_id FROM expected)"


@query(
    "review_issues",
    with_(R.CLAIMS, R.EXPECTED, CLAIMS_DOC, EXPECTED_DOC, R.cte("ob", REVIEWED))
    + """, refs AS (SELECT doc_id, owner AS id, source_id FROM cl WHERE owner IS NOT NULL), rej AS (SELECT doc_id, source_id FROM cl WHERE owner IS NULL),
wrong AS (SELECT DISTINCT doc_id, id FROM refs r WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.doc_id=r.doc_id AND ex.source_id=r.source_id)),
ret AS (SELECT DISTINCT doc_id, source_id FROM refs WHERE (doc_id,id) NOT IN (SELECT (doc_id,id) FROM wrong)),
known AS (SELECT * FROM rej r WHERE EXISTS (SELECT 1 FROM ex WHERE ex.doc_id=r.doc_id AND ex.source_id=r.source_id)),
done AS (SELECT doc_id, source_id FROM ret UNION SELECT doc_id, source_id FROM known)
"""
    + union(
        R.sql_issue("review_status", "ob WHERE status NOT IN ('supported','uncertain')"),
        R.sql_issue("invalid_source_ids", "wrong"),
        R.sql_issue("rejected_unknown", "rej r WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.doc_id=r.doc_id AND ex.source_id=r.source_id)", entity="source_id", distinct=True),
        R.sql_duplicates("rejected_duplicate", "rej", "doc_id, source_id", "source_id"),
        R.sql_issue("rejected_retained", "known k WHERE EXISTS (SELECT 1 FROM ret WHERE ret.doc_id=k.doc_id AND ret.source_id=k.source_id)", entity="source_id", distinct=True),
        R.sql_issue("unaccounted_source", "ex WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.doc_id=ex.doc_id AND done.source_id=ex.source_id)", entity="source_id", distinct=True),
    ),
)
def review_issues(spark, d):
    c = _claims(spark, d)
    return rules.review_issues(
        R.derive(spark, d, REVIEWED),
        c.filter("owner is not null").select("doc_id", F.col("owner").alias("id"), "source_id"),
        c.filter("owner is null").select("doc_id", "source_id"),
        R.expected_candidates(spark, d).withColumnRenamed("plan_id", "doc_id"),
    )


@query(
    "exactly_once_accounting",
    with_(R.CLAIMS, R.EXPECTED)
    + """SELECT plan_id, source_id, CAST(sum(g) AS BIGINT) AS claims, CASE WHEN max(w)=0 THEN 'unexpected' WHEN sum(g)=0 THEN 'missing' WHEN sum(g)>1 THEN 'repeated' ELSE 'ok' END AS status
FROM (SELECT plan_id, source_id, 1 AS w, 0 AS g FROM expected UNION ALL SELECT plan_id, source_id, 0, 1 FROM claims) GROUP BY 1,2""",
)
def exactly_once_accounting(spark, d):
    return rules.accounting(R.expected_candidates(spark, d), R.claims(spark, d))


# ---- structure and audit -------------------------------------------------------------------

ENTRIES = f"""select o_custkey as doc_id, k, case when k%37=0 then concat('x', k) when k%101=0 then 'twin' else concat('o', k) end as id, category,
  case when k%6=0 then 'deferred' when k%43=0 then 'odd' else 'proposed' end as status,
  case when k%67=0 then 'blob' when k%5=0 then 'point' when k%5=1 then 'polyline' when k%5=3 then 'unknown' else 'polygon' end as kind,
  cast(case when k%5=0 then 1 when k%5=3 then 0 when k%14=0 then 2 else 3+k%3 end as int) as n, k%2 as hidden,
  case when k%8=0 then concat('o', k) when k%4=0 then concat('o', k+1) end as reference,
  case when k%3=0 then concat('P', k%5) end as plane
  from (select o_custkey, o_orderkey as k, {R.CATEGORY} as category from {{orders}}) o"""
PRIOR = f"""select o_custkey as doc_id, concat('o', o_orderkey) as id, case when o_orderkey%47=0 then 'flat' else {R.CATEGORY} end as category from {{orders}}"""
PLANES = """select c_custkey as doc_id, concat('P', case when c_custkey%17=0 then 1 else n end) as id from {customer}, (select 0 as n union all select 1 union all select 2 union all select 3) p"""


def _px(i):
    return f"(case when k%29=0 then 100 when k%73=0 then k%1500+{i} else (k*(37+{i}*13)+{i}*211)%1000 end)"


def _py(i):
    return f"(case when k%29=0 then 100 else (k*(53+{i}*17)+{i}*307)%1000 end)"


def entries(spark, d):
    e = R.derive(spark, d, ENTRIES)
    pts = ", ".join(f"named_struct('x', cast({_px(i)} as double), 'y', cast({_py(i)} as double))" for i in range(5))
    e = e.withColumn("poly", F.expr(f"slice(array({pts}), 1, n)"))
    want = "case when kind='point' then 1 when kind='polyline' then greatest(0, n-1) when kind='polygon' then n else 0 end"
    return e.withColumn(
        "edge_states",
        F.expr(f"array_repeat(case when k%59=0 then 'bogus' else 'visible' end, cast({want} + (case when k%10=0 then 1 else 0 end) as int))"),
    )


STRUCT_ORACLE = (
    with_(R.cte("en", ENTRIES), R.cte("pr", PRIOR), R.cte("pl", PLANES))
    + ", pts AS (SELECT doc_id, k, id, n, i, CAST(CASE i "
    + " ".join(f"WHEN {i} THEN {_px(i)}" for i in range(5))
    + " END AS DOUBLE) AS x, CAST(CASE i "
    + " ".join(f"WHEN {i} THEN {_py(i)}" for i in range(5))
    + """ END AS DOUBLE) AS y FROM en, (SELECT unnest([0,1,2,3,4]) AS i) WHERE i<n),
geo AS (SELECT a.doc_id, a.k, sum(a.x*b.y-b.x*a.y) AS a2, bool_and(a.x BETWEEN 0 AND 1000 AND a.y BETWEEN 0 AND 1000) AS inside,
   bool_or(a.i=0 AND l.x=a.x AND l.y=a.y) AS closed FROM pts a JOIN pts b ON a.k=b.k AND b.i=(a.i+1)%a.n JOIN pts l ON l.k=a.k AND l.i=a.n-1 GROUP BY 1,2),
ck AS (SELECT en.*, pr.category AS was, coalesce(inside, TRUE) AS inside, coalesce(closed,FALSE) AS closed, coalesce(a2,0) AS a2,
   kind IN ('point','polyline','polygon','unknown') AS kok, en.k%10=0 OR (en.k%59=0 AND (CASE kind WHEN 'point' THEN 1 WHEN 'polyline' THEN greatest(0,n-1) WHEN 'polygon' THEN n ELSE 0 END)>0) AS badstates
   FROM en JOIN pr ON pr.doc_id=en.doc_id AND pr.id=en.id LEFT JOIN geo ON geo.k=en.k),
ok AS (SELECT * FROM ck WHERE kok AND inside)
"""
    + union(
        R.sql_issue("category_changed", "ck WHERE category<>was"),
        R.sql_issue("structure_status", "ck WHERE status NOT IN ('proposed','deferred')"),
        R.sql_issue("self_reference", "ck WHERE reference=id"),
        R.sql_issue("footprint_kind", "ck WHERE NOT kok"),
        R.sql_issue("footprint_points", "ck WHERE kok AND NOT inside"),
        R.sql_issue("footprint_count", "ok WHERE NOT (CASE kind WHEN 'point' THEN n=1 WHEN 'polyline' THEN n>=2 WHEN 'polygon' THEN n>=3 ELSE n=0 END)"),
        R.sql_issue("degenerate_polygon", "ok WHERE kind='polygon' AND n>=3 AND (closed OR abs(a2)<1e-6)"),
        R.sql_issue("edge_provenance", "ok WHERE badstates"),
        R.sql_issue("deferred_geometry", "ok WHERE status='deferred' AND (kind<>'unknown' OR hidden>0)"),
        R.sql_issue("unknown_id", "en WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.doc_id=en.doc_id AND pr.id=en.id)", distinct=True),
        R.sql_duplicates("duplicate_id", "en", "doc_id, id"),
        R.sql_issue("unknown_reference", "en WHERE reference IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.doc_id=en.doc_id AND pr.id=en.reference)", distinct=True),
        R.sql_issue("unknown_plane", "en WHERE plane IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.doc_id=en.doc_id AND pl.id=en.plane)", distinct=True),
        R.sql_duplicates("duplicate_plane", "pl", "doc_id, id"),
        R.sql_issue("not_covered", "pr WHERE NOT EXISTS (SELECT 1 FROM en WHERE pr.doc_id=en.doc_id AND pr.id=en.id)", distinct=True),
    )
)


@query("structure_issues", STRUCT_ORACLE)
def structure_issues(spark, d):
    return rules.structure_issues(cut(entries(spark, d)), R.derive(spark, d, PRIOR), R.derive(spark, d, PLANES))


AUDITS = """select o_custkey as doc_id, case when o_orderkey%37=0 then concat('x', o_orderkey) when o_orderkey%103=0 then 'twin' else concat('o', o_orderkey) end as id,
  case o_orderkey%7 when 0 then 'reject' when 1 then 'needs_review' when 2 then 'fine' else 'plausible' end as verdict,
  case when o_orderkey%71=0 then cast(null as boolean) else o_orderkey%3=0 end as safe from {orders}"""
AUDIT_PRIOR = """select o_custkey as doc_id, concat('o', o_orderkey) as id, case when o_orderkey%6=0 then 'deferred' else 'proposed' end as status,
  case when o_orderkey%5=3 then 'unknown' else 'polygon' end as kind from {orders}"""


@query(
    "audit_issues",
    with_(R.cte("au", AUDITS), R.cte("pr", AUDIT_PRIOR), "m AS (SELECT au.*, status, kind FROM au JOIN pr ON pr.doc_id=au.doc_id AND pr.id=au.id)")
    + union(
        R.sql_issue("audit_verdict", "m WHERE verdict NOT IN ('plausible','needs_review','reject') OR safe IS NULL"),
        R.sql_issue("unsafe_projection", "m WHERE safe AND (verdict<>'plausible' OR status='deferred' OR kind='unknown')"),
        R.sql_issue("unknown_id", "au WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.doc_id=au.doc_id AND pr.id=au.id)", distinct=True),
        R.sql_duplicates("duplicate_id", "au", "doc_id, id"),
        R.sql_issue("not_covered", "pr WHERE NOT EXISTS (SELECT 1 FROM au WHERE pr.doc_id=au.doc_id AND pr.id=au.id)", distinct=True),
    ),
)
def audit_issues(spark, d):
    return rules.audit_issues(R.derive(spark, d, AUDITS), R.derive(spark, d, AUDIT_PRIOR))


# ---- landmarks, hypotheses, ground check ------------------------------------------------------

INSTANCES = """select o_custkey as doc_id, case when o_orderkey%107=0 then 'B' else concat('B', o_orderkey) end as id, case when o_orderkey%23=0 then 'guess' else 'supported' end as identity_status,
  case o_orderkey%5 when 0 then 'occluded' when 1 then 'hidden' else 'visible_partial' end as ground_status from {orders}"""
LANDMARKS = """select o_custkey as doc_id, concat('B', l_orderkey) as instance_id, concat('m', l_orderkey, '_', l_linenumber) as id,
  cast(l_partkey*37%1020 as double) as x, cast(l_suppkey*53%1000 as double) as y,
  case (l_orderkey+l_linenumber)%8 when 0 then 'wall_ground_corner' when 1 then 'column_ground_foot' when 2 then 'plinth_ground_corner' when 3 then 'wall_occluder_contact'
    when 4 then 'upper_floor_corner' when 5 then 'eave_corner' when 6 then 'uncertain_feature' else 'ridge' end as feature,
  case when (l_orderkey+l_linenumber)%8 in (0,1,2) then 'ground' when (l_orderkey+l_linenumber)%8=3 then 'occlusion' when (l_orderkey+l_linenumber)%16=4 then 'ground'
    when (l_orderkey+l_linenumber)%8 in (4,5) then 'upper' else 'unknown' end as level
  from {lineitem} join {orders} on l_orderkey=o_orderkey"""
SEGMENTS = """select o_custkey as doc_id, concat('B', l_orderkey) as instance_id, concat('s', l_orderkey, '_', l_linenumber) as id,
  concat('m', l_orderkey, '_', l_linenumber) as src, concat('m', l_orderkey, '_', case when l_partkey%17=0 then l_linenumber else l_linenumber%7+1 end) as dst,
  case l_partkey%6 when 0 then 'ground_edge' when 1 then 'ground_edge' when 2 then 'visible_ground_line' when 3 then 'unknown' else 'upper_structure' end as role
  from {lineitem} join {orders} on l_orderkey=o_orderkey"""


@query(
    "landmark_issues",
    with_(R.CLAIMS, R.EXPECTED, CLAIMS_DOC, EXPECTED_DOC, R.cte("ins", INSTANCES), R.cte("lm", LANDMARKS), R.cte("sg", SEGMENTS))
    + """, src AS (SELECT doc_id, owner AS id, source_id FROM cl WHERE owner IS NOT NULL),
pt AS (SELECT doc_id, instance_id, id, max(level) AS level FROM lm GROUP BY 1,2,3),
se AS (SELECT sg.*, a.level AS sl, b.level AS dl, a.level IS NULL OR b.level IS NULL OR src=dst AS broken FROM sg LEFT JOIN pt a ON a.doc_id=sg.doc_id AND a.instance_id=sg.instance_id AND a.id=src
  LEFT JOIN pt b ON b.doc_id=sg.doc_id AND b.instance_id=sg.instance_id AND b.id=dst)
"""
    + union(
        R.sql_issue("instance_status", "ins WHERE identity_status NOT IN ('supported','uncertain') OR ground_status NOT IN ('visible_partial','occluded','outside_crop','uncertain')"),
        R.sql_duplicates("duplicate_instance", "ins", "doc_id, id"),
        R.sql_issue("missing_sources", "ins WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.doc_id=ins.doc_id AND src.id=ins.id)", distinct=True),
        R.sql_account("candidate", "ex", "cl"),
        R.sql_issue("landmark_point", "lm WHERE x>1000"),
        R.sql_issue("feature_level", "lm WHERE level <> coalesce(CASE WHEN feature IN ('wall_ground_corner','column_ground_foot','plinth_ground_corner') THEN 'ground' WHEN feature='wall_occluder_contact' THEN 'occlusion' WHEN feature IN ('upper_floor_corner','eave_corner') THEN 'upper' WHEN feature='uncertain_feature' THEN 'unknown' END, '?')"),
        R.sql_duplicates("duplicate_landmark", "lm", "doc_id, id"),
        R.sql_issue("segment_references", "se WHERE broken"),
        R.sql_issue("segment_role", "se WHERE NOT broken AND role NOT IN ('ground_edge','occlusion_boundary','upper_structure','unknown')"),
        R.sql_issue("non_ground_edge", "se WHERE NOT broken AND role='ground_edge' AND (sl<>'ground' OR dl<>'ground')"),
    ),
)
def landmark_issues(spark, d):
    c = _claims(spark, d)
    return rules.landmark_issues(
        R.derive(spark, d, INSTANCES),
        c.filter("owner is not null").select("doc_id", F.col("owner").alias("id"), "source_id"),
        c.filter("owner is null").select("doc_id", "source_id"),
        R.derive(spark, d, LANDMARKS),
        R.derive(spark, d, SEGMENTS),
        R.expected_candidates(spark, d).withColumnRenamed("plan_id", "doc_id"),
    )


HYP_INST = """select o_custkey as doc_id, case when o_orderkey%43=0 then concat('X', o_orderkey) else concat('B', o_orderkey) end as id,
  case when o_orderkey%5=0 then 'insufficient' when o_orderkey%47=0 then 'odd' else 'proposed' end as status from {orders}"""
HYP_PRIOR = "select o_custkey as doc_id, concat('B', o_orderkey) as id from {orders}"
_LM = QUAD = [("k*37%600", "k*53%600"), ("k*37%600+100+k*17%300", "k*53%600"), ("k*37%600+100+k*17%300", "k*53%600+100+k*29%300"), ("k*37%600", "k*53%600+100+k*29%300")]
HYP_LM = " union all ".join(
    f"select doc_id, concat('B', k) as instance_id, 'm{i}' as id, cast({x} as double) as x, cast({y} as double) as y, case when k%11=0 then 'upper' else 'ground' end as level from (select o_custkey as doc_id, o_orderkey as k from {{orders}}) o{i}"
    for i, (x, y) in enumerate(_LM)
)


def _hyp_alts():
    cols = []
    for i in range(4):
        j = {2: 3, 3: 2}.get(i, i)
        gone = "l_partkey%4=0 and l_partkey%8<>0"
        shift = "+1" if i == 0 else ""
        x = f"case when l_partkey%19=0 then {_LM[j][0]} when l_partkey%7=0 then {_LM[i][0]}{shift} else {_LM[i][0]} end"
        y = f"case when l_partkey%19=0 then {_LM[j][1]} else {_LM[i][1]} end"
        cols.append(f"cast(case when {gone} then null else {x} end as double) as q{i}x, cast(case when {gone} then null else {y} end as double) as q{i}y")
        cols.append(f"case when (l_partkey+{i})%3=0 then 'visible' when l_suppkey%23=0 then 'maybe' else 'inferred' end as v{i}")
        cols.append(f"case when (l_partkey+{i})%6=0 then 'visible' else 'inferred' end as e{i}")
        cols.append(f"case when l_suppkey%13=0 then 'm9' when (l_partkey+{i})%3=0 then 'm{i}' end as r{i}")
    return ", ".join(cols)


HYP_ALT = f"""select o_custkey as doc_id, concat('B', k) as instance_id, concat('a', l_linenumber) as id, {_hyp_alts()},
  case l_partkey%4 when 0 then 'shape_only' when 1 then 'anchored' when 2 then 'inferred' else case when l_partkey%5=0 then 'floating' else 'anchored' end end as placement,
  cast(l_suppkey%4 as double) as ratio_low, cast(l_partkey%5 as double) as ratio_high,
  case when l_suppkey%31=0 then 'B?' when l_linenumber=1 then concat('B', k) end as reference
  from (select o_custkey, o_orderkey as k, l_partkey, l_suppkey, l_linenumber from {{lineitem}} join {{orders}} on l_orderkey=o_orderkey) o"""


@query(
    "hypothesis_issues",
    with_(R.cte("ins", HYP_INST), R.cte("pr", HYP_PRIOR), R.cte("lm", HYP_LM), R.cte("al0", HYP_ALT))
    + f""", al AS (SELECT *, instance_id||'/'||id AS nm, coalesce(placement IN ('anchored','inferred') AND {R.sql_quad_ok()}, FALSE) AS qok, placement='shape_only' AS so FROM al0),
cnt AS (SELECT ins.*, coalesce(n,0) AS n FROM ins LEFT JOIN (SELECT doc_id, instance_id, count(*) AS n FROM al GROUP BY 1,2) c ON c.doc_id=ins.doc_id AND c.instance_id=ins.id),
co AS ("""
    + " UNION ALL ".join(f"SELECT doc_id, instance_id, nm, q{i}x AS x, q{i}y AS y, v{i} AS state, r{i} AS ref FROM al WHERE qok AND NOT so" for i in range(4))
    + """), me AS (SELECT co.*, lm.level, lm.x AS lx, lm.y AS ly FROM co LEFT JOIN lm ON lm.doc_id=co.doc_id AND lm.instance_id=co.instance_id AND lm.id=co.ref)
"""
    + union(
        R.sql_issue("proposal_status", "cnt WHERE n>2 OR status NOT IN ('proposed','insufficient')"),
        R.sql_issue("status_disagrees", "cnt WHERE (status='proposed') <> (n>0)"),
        R.sql_issue("unknown_instance", "ins WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.doc_id=ins.doc_id AND pr.id=ins.id)", distinct=True),
        R.sql_issue("not_covered", "pr WHERE NOT EXISTS (SELECT 1 FROM ins WHERE pr.doc_id=ins.doc_id AND pr.id=ins.id)", distinct=True),
        R.sql_duplicates("duplicate_alternative", "al", "doc_id, instance_id, id, nm", "nm"),
        R.sql_issue("ratio_interval", "al WHERE NOT (ratio_low>0 AND ratio_low<=ratio_high)", entity="nm"),
        R.sql_issue("shape_only_geometry", "al WHERE so AND q0x IS NOT NULL", entity="nm"),
        R.sql_issue("placement_or_quad", "al WHERE NOT so AND NOT qok", entity="nm"),
        R.sql_issue("vertex_edge_states", "al WHERE NOT so AND qok AND NOT (" + " AND ".join(f"v{i} IN ('visible','inferred') AND e{i} IN ('visible','inferred')" for i in range(4)) + ")", entity="nm"),
        R.sql_issue("visible_edge_inferred_end", "al WHERE NOT so AND qok AND (" + " OR ".join(f"(e{i}='visible' AND (v{i}<>'visible' OR v{(i + 1) % 4}<>'visible'))" for i in range(4)) + ")", entity="nm"),
        R.sql_issue("anchored_without_visible", "al WHERE qok AND placement='anchored' AND v0<>'visible' AND v1<>'visible' AND v2<>'visible' AND v3<>'visible'", entity="nm"),
        R.sql_issue("unknown_reference", "al WHERE reference IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.doc_id=al.doc_id AND pr.id=al.reference)", entity="nm", distinct=True),
        R.sql_issue("foreign_vertex", "me WHERE ref IS NOT NULL AND level IS NULL", entity="nm", distinct=True),
        R.sql_issue("displaced_visible_vertex", "me WHERE state='visible' AND (level IS NULL OR level<>'ground' OR lx<>x OR ly<>y)", entity="nm", distinct=True),
    ),
)
def hypothesis_issues(spark, d):
    # a stage table, as answers are: its eight readers do not repeat the derivation
    alternatives = cut(R.derive(spark, d, HYP_ALT))
    return rules.hypothesis_issues(
        R.derive(spark, d, HYP_INST), alternatives, R.derive(spark, d, HYP_PRIOR), R.derive(spark, d, HYP_LM)
    )


GC_ALT = """select o_custkey as doc_id, concat('B', l_orderkey) as instance_id, concat('a', l_linenumber) as alternative_id,
  concat(l_orderkey%97, ',', l_linenumber) as corners, case when (l_orderkey+l_linenumber)%4=0 then 'shape_only' else 'anchored' end as placement
  from {lineitem} join {orders} on l_orderkey=o_orderkey"""
GC_DEC = """select o_custkey as doc_id, concat('B', l_orderkey) as instance_id, concat('a', case when l_suppkey%17=0 then l_linenumber+7 else l_linenumber end) as alternative_id,
  case l_partkey%4 when 0 then 'reject' when 1 then 'shrug' else 'usable_hypothesis' end as verdict,
  concat(case when l_partkey%7=0 then 98 else l_orderkey%97 end, ',', l_linenumber) as corners,
  case when l_partkey%23=0 then cast(null as boolean) else l_partkey%5<>0 end as consistent,
  cast(case when l_partkey%3=0 then null when l_partkey%29=0 then 4 else 0 end as int) as f0, cast(case when l_partkey%3=0 then null when l_partkey%13=0 then 0 else 1 end as int) as f1
  from {lineitem} join {orders} on l_orderkey=o_orderkey"""


@query(
    "ground_check_issues",
    with_(R.cte("al", GC_ALT), R.cte("de0", GC_DEC))
    + """, de AS (SELECT *, instance_id||'/'||alternative_id AS id FROM de0), au AS (SELECT DISTINCT * FROM al),
m AS (SELECT de.*, au.corners AS given, placement FROM de JOIN au ON au.doc_id=de.doc_id AND au.instance_id=de.instance_id AND au.alternative_id=de.alternative_id)
"""
    + union(
        R.sql_issue("check_verdict", "de WHERE verdict NOT IN ('usable_hypothesis','needs_revision','reject')"),
        R.sql_issue("unknown_pair", "de WHERE NOT EXISTS (SELECT 1 FROM au WHERE au.doc_id=de.doc_id AND au.instance_id=de.instance_id AND au.alternative_id=de.alternative_id)", distinct=True),
        R.sql_duplicates("duplicate_pair", "de", "doc_id, instance_id, alternative_id, id"),
        R.sql_issue("not_decided", "au WHERE NOT EXISTS (SELECT 1 FROM de WHERE au.doc_id=de.doc_id AND au.instance_id=de.instance_id AND au.alternative_id=de.alternative_id)", entity="instance_id||'/'||alternative_id", distinct=True),
        R.sql_issue("corner_echo", "m WHERE corners<>given"),
        R.sql_issue("order_consistency", "m WHERE consistent IS NULL"),
        R.sql_issue("front_edge", "m WHERE f0 IS NOT NULL AND (f0 NOT BETWEEN 0 AND 3 OR f1 NOT BETWEEN 0 AND 3 OR f0=f1)"),
        R.sql_issue("accepted_front_edge", "m WHERE verdict='usable_hypothesis' AND (NOT (CASE WHEN placement='shape_only' THEN f0 IS NULL ELSE coalesce(f0=0 AND f1=1, FALSE) END) OR NOT coalesce(consistent,FALSE))"),
    ),
)
def ground_check_issues(spark, d):
    dec = R.derive(spark, d, GC_DEC)
    front = F.when(F.col("f0").isNull(), F.array().cast("array<int>")).otherwise(F.array("f0", "f1"))
    return rules.ground_check_issues(dec.withColumn("front", front), R.derive(spark, d, GC_ALT))


# ---- plan stages ---------------------------------------------------------------------------------

ELEMENTS = """select doc_id, k, case k%4 when 0 then 'terrain' when 1 then 'zones' when 2 then 'trees' else 'routes' end as collection, concat('t', k%70) as id,
  cast(1+k%5 as int) as n, case when k%17=0 then 'top' when k%2=0 then 'low' else 'high' end as level, case k%5 when 0 then 'mountain' when 1 then 'water' when 2 then 'lake' else 'flat' end as category,
  cast(case when k%19=0 then 0 else k%10 end as double) as adx, cast(case when k%19=0 then 0 else 1 end as double) as ady
  from (select o_custkey as doc_id, o_orderkey as k from {orders}) o"""


def _pt(i, broken):
    x = f"cast((k*(37+{i}*13))%1000 as double)"
    y = f"cast((k*(53+{i}*17))%1000 as double)"
    return f"named_struct('x', {'case when k%' + str(broken) + f'=0 then cast(1001 as double) else {x} end' if i == 0 else x}, 'y', {y})"


def elements(spark, d):
    e = R.derive(spark, d, ELEMENTS)
    for name, broken in (("source_poly", 31), ("plan_poly", 37)):
        e = e.withColumn(name, F.expr("slice(array(" + ", ".join(_pt(i, broken) for i in range(5)) + "), 1, n)"))
    return e.withColumn("axes", F.expr("array(named_struct('x', adx, 'y', ady), named_struct('x', 1D, 'y', 0D))"))


@query(
    "terrain_issues",
    with_(R.cte("el", ELEMENTS))
    + union(
        R.sql_issue("scene_boundary", "customer WHERE c_custkey%19=0", doc="c_custkey", entity="'scene'"),
        R.sql_duplicates("duplicate_id", "el", "doc_id, id"),
        R.sql_issue("polygon", "el WHERE n < (CASE collection WHEN 'trees' THEN 1 WHEN 'routes' THEN 2 ELSE 3 END) OR k%31=0 OR k%37=0"),
        R.sql_issue("level", "el WHERE collection IN ('terrain','zones') AND level NOT IN ('low','middle','high')"),
        R.sql_issue("category", "el WHERE collection='terrain' AND category NOT IN ('mountain','water','flat','other')"),
        R.sql_issue("axes", "el WHERE collection='zones' AND k%19=0"),
    ),
)
def terrain_issues(spark, d):
    c = R.table(spark, d, "customer")
    square = "array(named_struct('x', case when c_custkey%19=0 then -1D else 0D end, 'y', 0D), named_struct('x', 1000D, 'y', 0D), named_struct('x', 1000D, 'y', 1000D))"
    bounds = c.select(F.col("c_custkey").alias("doc_id"), F.expr(square).alias("source_poly"), F.expr(square).alias("plan_poly"))
    return rules.terrain_issues(elements(spark, d), bounds)


CANDS = f"""select doc_id, concat('c', k%70) as id, {R.QUAD_TEXT}, cast(k*37%600 as double) as x0, cast(k*53%600 as double) as y0,
  cast(case when k%61=0 then 0 else k*37%600+100+k*17%300 end as double) as x1, cast(k*53%600+100+k*29%300 as double) as y1, cast(k%1000 as double) as ax, cast(k*3%1001 as double) as ay,
  cast(k%20 as double)/10 as ratio_low, cast(k%25 as double)/8 as ratio_high, case when k%53=0 then 'barn' else 'house' end as category,
  case k%6 when 0 then 'inferred' when 1 then 'partial_visible' else 'visible_partial' end as anchor_status
  from (select o_custkey as doc_id, o_orderkey as k from {{orders}}) o"""


@query(
    "candidate_issues",
    with_(R.cte("ca", CANDS))
    + union(
        R.sql_issue("candidate_geometry", f"ca WHERE NOT ({R.sql_box_ok()} AND {R.sql_point('ax', 'ay')} AND {R.sql_quad_ok()} AND {R.SQL_RATIO_OK})"),
        R.sql_issue("semantic_fields", "ca WHERE category NOT IN ('house','other') OR anchor_status NOT IN ('visible_partial','inferred','outside_crop')"),
        R.sql_duplicates("duplicate_id", "ca", "doc_id, id"),
    ),
)
def candidate_issues(spark, d):
    return rules.candidate_issues(R.derive(spark, d, CANDS))


ZONE_IDS = "select c_custkey as doc_id, concat('Z', n) as zone_id from {customer}, (select 0 as n union all select 1 union all select 2 union all select 3) z"

BUILDING_ISSUES = union(
    R.sql_issue("category_confidence", "bl WHERE category NOT IN ('house','other') OR confidence NOT IN ('high','medium','low')"),
    R.sql_issue("source_geometry", f"bl WHERE NOT ({R.sql_box_ok('s')} AND {R.sql_point('ax', 'ay')} AND {R.sql_quad_ok()})"),
    R.sql_issue("plan_or_ratio", f"bl WHERE NOT ({R.sql_point('cx', 'cy')} AND {R.SQL_RATIO_OK})"),
    R.sql_issue("plan_size", "bl WHERE NOT (w>0 AND w<500 AND d>0 AND d<500)"),
    R.sql_issue("ratio_outside_interval", f"bl WHERE w>0 AND w<500 AND d>0 AND d<500 AND {R.SQL_RATIO_OK} AND w/d NOT BETWEEN ratio_low-0.01::DOUBLE AND ratio_high+0.01::DOUBLE"),
    R.sql_issue("facing", "bl WHERE clock NOT BETWEEN 0 AND 12"),
    R.sql_issue("missing_evidence", "bl WHERE coalesce(length(evidence),0)=0"),
    R.sql_issue("missing_label", "bl WHERE coalesce(length(label),0)=0"),
    R.sql_issue("missing_subtype", "bl WHERE coalesce(length(subtype),0)=0"),
    R.sql_duplicates("duplicate_id", "bl", "doc_id, id"),
    R.sql_issue("unknown_zone", "bl WHERE NOT EXISTS (SELECT 1 FROM zo WHERE zo.doc_id=bl.doc_id AND zo.zone_id=bl.zone_id)", distinct=True),
)


@query("building_issues", with_(R.cte("bl", R.BUILDING_TEXT_ROWS), R.cte("zo", ZONE_IDS)) + BUILDING_ISSUES
       + UNION + R.sql_issue("locked_observation_changed", "bl WHERE category='other' AND k%7=0", distinct=True))
def building_issues(spark, d):
    b = R.derive(spark, d, R.BUILDING_TEXT_ROWS)
    locks = b.filter("category = 'other'").withColumn("ax", F.expr("case when k%7=0 then ax + 1 else ax end"))
    return rules.building_issues(b, R.derive(spark, d, ZONE_IDS), locks)


RELATIONS = """select o_custkey as doc_id, concat('B', o_orderkey) as src, case o_orderkey%3 when 0 then concat('B', o_orderkey+1) when 1 then concat('Z', o_orderkey%5) else concat('T', o_orderkey%4) end as dst from {orders}"""
PLACES = "select c_custkey as doc_id, concat('T', n) as id from {customer}, (select 0 as n union all select 1 union all select 2) z"


@query(
    "layout_issues",
    with_(R.CLAIMS, R.EXPECTED, CLAIMS_DOC, EXPECTED_DOC, R.cte("bl", R.BUILDING_TEXT_ROWS), R.cte("zo", ZONE_IDS), R.cte("re", RELATIONS), R.cte("pl", PLACES))
    + ", tg AS (SELECT doc_id, id FROM bl UNION SELECT doc_id, zone_id FROM zo UNION SELECT doc_id, id FROM pl)\n"
    + union(
        BUILDING_ISSUES,
        R.sql_account("source", "ex", "cl"),
        R.sql_issue("undocumented_addition", "bl WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.doc_id=bl.doc_id AND cl.owner=bl.id) AND NOT contains(evidence,'newly_observed')", distinct=True),
        R.sql_issue("unknown_relation_end", "re WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.doc_id=re.doc_id AND tg.id=re.dst) OR NOT EXISTS (SELECT 1 FROM bl WHERE bl.doc_id=re.doc_id AND bl.id=re.src)", entity="src||'>'||dst", distinct=True),
    ),
)
def layout_issues(spark, d):
    return rules.layout_issues(
        R.derive(spark, d, R.BUILDING_TEXT_ROWS), R.derive(spark, d, ZONE_IDS), _claims(spark, d),
        R.expected_candidates(spark, d).withColumnRenamed("plan_id", "doc_id"), R.derive(spark, d, RELATIONS), R.derive(spark, d, PLACES),
    )


CHANGES = """select o_custkey as doc_id, case l_partkey%7 when 0 then 'add' when 1 then 'remove' else 'replace' end as op,
  concat(case when l_partkey%7=0 and l_suppkey%5<>0 then 'N' when l_suppkey%29=0 then 'X' else 'B' end, l_orderkey) as id,
  case when l_partkey%7=1 and l_suppkey%2=0 then concat('B', l_orderkey + l_suppkey%3) end as merge_into, l_suppkey%8 as owns,
  case when l_suppkey%3=0 then 'newly_observed' else 'seen' end as evidence from {lineitem} join {orders} on l_orderkey=o_orderkey"""
CRIT = "select c_custkey as doc_id, case c_custkey%4 when 0 then 'fine' when 1 then 'revise' else 'reasonable_approximation' end as verdict from {customer}"


@query(
    "critique_issues",
    with_(R.cte("ch", CHANGES), R.cte("ve", CRIT), R.cte("ib", HYP_PRIOR))
    + """, rp AS (SELECT * FROM ch WHERE op='replace'), ad AS (SELECT * FROM ch WHERE op='add'), rm AS (SELECT * FROM ch WHERE op='remove'),
alive AS (SELECT doc_id, id FROM ib UNION SELECT doc_id, id FROM rp UNION SELECT doc_id, id FROM ad EXCEPT SELECT doc_id, id FROM rm)
"""
    + union(
        R.sql_issue("critique_verdict", "ve WHERE verdict NOT IN ('reasonable_approximation','revise')", entity="'verdict'"),
        R.sql_issue("replace_unknown", "rp WHERE (doc_id,id) NOT IN (SELECT (doc_id,id) FROM ib)", distinct=True),
        R.sql_duplicates("replace_repeated", "rp", "doc_id, id"),
        R.sql_issue("replace_removed", "rp WHERE (doc_id,id) IN (SELECT (doc_id,id) FROM rm)", distinct=True),
        R.sql_issue("add_existing", "ad WHERE (doc_id,id) IN (SELECT (doc_id,id) FROM ib UNION SELECT (doc_id,id) FROM rp)", distinct=True),
        R.sql_duplicates("add_repeated", "ad", "doc_id, id"),
        R.sql_issue("add_undocumented", "ad WHERE owns>0 OR NOT contains(evidence,'newly_observed')"),
        R.sql_issue("remove_unknown", "rm WHERE (doc_id,id) NOT IN (SELECT (doc_id,id) FROM ib)", distinct=True),
        R.sql_issue("merge_target", "rm WHERE merge_into IS NOT NULL AND (doc_id,merge_into) NOT IN (SELECT (doc_id,id) FROM alive)", distinct=True),
    ),
)
def critique_issues(spark, d):
    return rules.critique_issues(R.derive(spark, d, CHANGES), R.derive(spark, d, HYP_PRIOR), R.derive(spark, d, CRIT))


DETAILS = f"""select doc_id, case when k%67=0 then concat('X', k) else concat('B', k) end as id, {R.QUAD_TEXT}, cast(k*37%600 as double) as x0, cast(k*53%600 as double) as y0,
  cast(k*37%600+100+k*17%300 as double) as x1, cast(k*53%600+100+k*29%300 as double) as y1, cast(k%1000 as double) as ax, cast(k*3%1001 as double) as ay,
  cast(k%20+1 as double)/10 as ratio_low, cast(k%25+3 as double)/8 as ratio_high,
  case k%9 when 0 then 'merge' when 1 then 'reject' when 2 then 'uncertain' when 3 then 'drop' else 'keep' end as status,
  case when k%18=0 then concat('B', k+1) when k%9=0 and k%2=1 then concat('B', k-(k%1500)) when k%27=1 then 'B1' end as merge_into,
  case k%5 when 0 then 'shared' when 1 then 'unresolved' when 2 then 'nonbuilding' else 'independent' end as independence,
  case when k%21=0 then 'guess' else 'inferred' end as ground_contact, case k%6 when 0 then 'reflection' when 1 then 'unclear' when 2 then cast(null as string) when 3 then 'mirror' else 'physical' end as appearance_kind,
  case when k%31=0 then ' ' else 'trace' end as foundation_trace, case when k%33=0 then cast(null as string) else 'why' end as bbox_reason
  from (select o_custkey as doc_id, o_orderkey as k from {{orders}}) o"""


@query(
    "detail_issues",
    with_(R.cte("de", DETAILS), R.cte("ib", HYP_PRIOR), "ms AS (SELECT * REPLACE ('M'||id AS id, x1-x0-150 AS x1) FROM de WHERE appearance_kind='unclear')")
    + ", keepers AS (SELECT doc_id, id FROM de WHERE status IN ('keep','uncertain'))\n"
    + union(
        R.sql_issue("detail_geometry", f"de WHERE NOT ({R.sql_box_ok()} AND {R.sql_point('ax', 'ay')} AND {R.sql_quad_ok()} AND {R.SQL_RATIO_OK})"),
        R.sql_issue("detail_geometry", f"ms WHERE NOT ({R.sql_box_ok()} AND {R.sql_point('ax', 'ay')} AND {R.sql_quad_ok()} AND {R.SQL_RATIO_OK})"),
        R.sql_issue("detail_verdict", "de WHERE status='drop'"),
        R.sql_issue("missing_foundation_trace", "de WHERE length(trim(foundation_trace))=0"),
        R.sql_issue("missing_bbox_reason", "de WHERE bbox_reason IS NULL"),
        R.sql_issue("ground_contact", "de WHERE ground_contact NOT IN ('visible_partial','inferred')"),
        R.sql_issue("appearance_kind", "de WHERE appearance_kind='mirror'"),
        R.sql_issue("reflection_owns", "de WHERE appearance_kind='reflection' AND (status<>'reject' OR merge_into IS NOT NULL)"),
        R.sql_issue("unconfirmed_physical", "de WHERE appearance_kind IS NOT NULL AND status='keep' AND appearance_kind<>'physical'"),
        R.sql_issue("merge_target", "de WHERE status='merge' AND NOT EXISTS (SELECT 1 FROM keepers k WHERE k.doc_id=de.doc_id AND k.id=de.merge_into)", distinct=True),
        R.sql_account("decision", "(SELECT doc_id, id AS source_id FROM ib)", "(SELECT doc_id, id AS source_id FROM de)"),
        R.sql_issue("inconsistent_identity", "de WHERE NOT ((status='keep' AND independence='independent') OR (status='uncertain' AND independence IN ('independent','unresolved')) OR (status='merge' AND independence='shared') OR (status='reject' AND independence='nonbuilding'))", distinct=True),
    ),
)
def detail_issues(spark, d):
    """Missing ones come from the unclear decisions, with boxes that are partly inside out."""
    dec = R.derive(spark, d, DETAILS)
    missing = dec.filter("appearance_kind = 'unclear'").withColumns({"id": F.concat(F.lit("M"), "id"), "x1": F.col("x1") - F.col("x0") - 150})
    return rules.detail_issues(dec, missing, R.derive(spark, d, HYP_PRIOR))


ASSIGN = """select o_custkey as doc_id, concat(l_orderkey, '-', l_linenumber) as source_id, case when l_returnflag='R' then null when l_suppkey%9=0 then 'B?' else concat('B', l_orderkey) end as target
  from {lineitem} join {orders} on l_orderkey=o_orderkey"""


@query(
    "assignment_issues",
    with_(R.EXPECTED, EXPECTED_DOC, R.cte("sg", ASSIGN), R.cte("ib", HYP_PRIOR))
    + union(
        R.sql_issue("unknown_target", "sg WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ib WHERE ib.doc_id=sg.doc_id AND ib.id=sg.target)", entity="source_id", distinct=True),
        R.sql_account("assignment", "ex", "sg"),
    ),
)
def assignment_issues(spark, d):
    return rules.assignment_issues(
        R.derive(spark, d, ASSIGN), R.expected_candidates(spark, d).withColumnRenamed("plan_id", "doc_id"), R.derive(spark, d, HYP_PRIOR)
    )


CHECKS = """select c_custkey as doc_id, case c_custkey%3 when 0 then 'needs_revision' when 1 then 'ready_for_confirmation' else case when c_custkey%5=0 then 'ok' else 'ready_for_confirmation' end end as verdict,
  c_custkey%4 as blockers, cast(6+c_custkey%8 as bigint) as regions, cast(c_custkey%2 as bigint) as pending from {customer}"""
FACTS = "select o_custkey as doc_id, count(*) as regions, cast(sum(case when o_orderkey%15=0 then 1 else 0 end) as bigint) as pending from {orders} group by o_custkey"


@query(
    "final_check_issues",
    with_(R.cte("ck", CHECKS), R.cte("fa", FACTS))
    + ", m AS (SELECT ck.*, coalesce(fa.regions,0) AS r, coalesce(fa.pending,0) AS p FROM ck LEFT JOIN fa USING (doc_id))\n"
    + union(
        R.sql_issue("final_verdict", "m WHERE verdict='ok'", entity="'check'"),
        R.sql_issue("ready_with_blockers", "m WHERE verdict='ready_for_confirmation' AND blockers>0", entity="'check'"),
        R.sql_issue("stale_regions", "m WHERE regions<>r", entity="'check'"),
        R.sql_issue("stale_pending", "m WHERE pending<>p", entity="'check'"),
    ),
)
def final_check_issues(spark, d):
    return rules.final_check_issues(R.derive(spark, d, CHECKS), R.derive(spark, d, FACTS))


PENDING = """select doc_id, case when k%3=0 then concat('B', k) when k%5=0 then 'H0' else concat('H', k) end as id, cast(k*37%600 as double) as x0, cast(k*53%600 as double) as y0,
  cast(k*37%600+k%4 as double) as x1, cast(k*53%600+100 as double) as y1, cast(k%1010 as double) as mx, cast(k%900 as double) as my,
  k%13<>0 as candidate_only, k%17=0 as marker_is_foundation, case when k%19=0 then 'size' end as plan_size, case when k%23=0 then 's' end as source_ids, case when k%29=0 then 'Z1' end as zone_id,
  case when k%31=0 then '' else 'l' end as label, 'e' as evidence, case when k%37=0 then cast(null as string) else 'u' end as uncertainty, 'r' as source_run
  from (select o_custkey as doc_id, o_orderkey as k from {orders}) o"""


@query(
    "pending_issues",
    with_(R.cte("pe", PENDING), R.cte("ib", HYP_PRIOR))
    + union(
        R.sql_issue("pending_geometry", f"pe WHERE NOT ({R.sql_box_ok()} AND {R.sql_point('mx', 'my')})"),
        R.sql_issue("claims_foundation", "pe WHERE NOT candidate_only OR marker_is_foundation"),
        R.sql_issue("owns_area", "pe WHERE plan_size IS NOT NULL OR source_ids IS NOT NULL OR zone_id IS NOT NULL"),
        R.sql_issue("missing_label", "pe WHERE label=''"),
        R.sql_issue("missing_uncertainty", "pe WHERE uncertainty IS NULL"),
        R.sql_issue("pending_is_building", "pe WHERE EXISTS (SELECT 1 FROM ib WHERE ib.doc_id=pe.doc_id AND ib.id=pe.id)", distinct=True),
        R.sql_duplicates("duplicate_pending", "pe", "doc_id, id"),
    ),
)
def pending_issues(spark, d):
    return rules.pending_issues(R.derive(spark, d, PENDING), R.derive(spark, d, HYP_PRIOR))


@query(
    "shape_diagnostics",
    with_(R.cte("bl", R.BUILDING_TEXT_ROWS))
    + """SELECT doc_id, id, 'corner_count' AS kind, CAST(3+k%3 AS DOUBLE) AS actual FROM bl WHERE 3+k%3<>4
UNION ALL SELECT doc_id, id, 'ratio', round(w/d,9) FROM bl WHERE d>0 AND w/d NOT BETWEEN ratio_low AND ratio_high""",
)
def shape_diagnostics(spark, d):
    b = R.derive(spark, d, R.BUILDING_TEXT_ROWS).withColumn("corners", F.expr("3 + k % 3"))
    return rules.shape_diagnostics(b).withColumn("actual", F.round("actual", 9))
