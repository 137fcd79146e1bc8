"""Revisions, evidence, promotion, publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords
from ..functions import geometry as G
from ..operators import graph
from ..plans import evidence as E
from ..plans import publication as P
from ..plans import revision as V
from . import recipes as R
from .registry import ORACLES, query, with_
from .rulesets import CHANGES as CHANGE_ROWS  # noqa: F401
from .rulesets import BUILDING_ISSUES, GC_ALT, GC_DEC, UNION, ZONE_IDS
from .spatial_q import CALM_GEO, FINDINGS, GEO, calm_findings, findings

# plan buildings of the snapshot before a revision
OLD = "select o_custkey as plan_id, concat('B', o_orderkey) as id, cast(o_orderkey*37%900+50 as double) as cx, cast(o_orderkey*53%900+50 as double) as cy, cast(40+o_orderkey*17%160 as double) as w from {orders}"
# the smallest building of a plan is never removed, so that it can take over sources
EDIT = """select plan_id, case when k%11=2 then concat('N', k) else concat('B', k) end as id, case when k%11=2 then 'add' when k%11=0 and k<>mn then 'remove' else 'replace' end as op,
  case when k%11=0 and k<>mn and k%2=0 then concat('B', mn) end as merge_into, cast(k*37%900+51 as double) as cx, cast(k*53%900+50 as double) as cy, cast(40+k*17%160 as double) as w
  from (select o_custkey as plan_id, o_orderkey as k, min(o_orderkey) over (partition by o_custkey) as mn from {orders}) o"""
USED = "select plan_id, id, op, merge_into, cx, cy, w from {edits} where op='remove' or id like 'N%' or cx % 3 = 0"
CL = "select o_custkey as plan_id, concat(l_orderkey, '-', l_linenumber, '-', l_partkey) as source_id, case when l_returnflag='R' then null else concat('B', l_orderkey) end as owner from {lineitem} join {orders} on l_orderkey=o_orderkey"
EDITS_SQL = (R.cte("old", OLD), R.cte("edits", EDIT), "ch AS (" + USED.replace("{edits}", "edits") + ")", R.cte("cl", CL),
    "nw AS (SELECT plan_id, id, cx, cy, w FROM ch WHERE op<>'remove'), rm AS (SELECT plan_id, id, merge_into FROM ch WHERE op='remove'), "
    "after AS (SELECT * FROM (SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.plan_id=o.plan_id AND nw.id=o.id) UNION ALL SELECT * FROM nw) u WHERE NOT EXISTS (SELECT 1 FROM rm WHERE rm.plan_id=u.plan_id AND rm.id=u.id))")


def revised(spark, d):
    old = R.derive(spark, d, OLD)
    changes = spark.sql(USED, edits=R.derive(spark, d, EDIT))
    return old, changes, V.apply_review(old, R.derive(spark, d, CL), changes)


@query("apply_changes", with_(*EDITS_SQL) + "SELECT plan_id, id, cx, cy, w FROM after")
def apply_changes(spark, d):
    return revised(spark, d)[2][0]


@query(
    "ownership_after_changes",
    with_(*EDITS_SQL)
    + ", mv AS MATERIALIZED (SELECT cl.plan_id, source_id, CASE WHEN rm.id IS NOT NULL THEN merge_into ELSE owner END AS owner FROM cl LEFT JOIN rm ON rm.plan_id=cl.plan_id AND rm.id=cl.owner), "
    + "tg AS MATERIALIZED (SELECT DISTINCT plan_id, merge_into FROM rm WHERE merge_into IS NOT NULL), "
    + "mk AS MATERIALIZED (SELECT mv.*, tg.merge_into IS NOT NULL AS target FROM mv LEFT JOIN tg ON tg.plan_id=mv.plan_id AND tg.merge_into=mv.owner) "
    + "SELECT DISTINCT plan_id, source_id, owner FROM mk WHERE target UNION ALL SELECT plan_id, source_id, owner FROM mk WHERE NOT target",
)
def ownership_after_changes(spark, d):
    return revised(spark, d)[2][1]


@query(
    "merged_source_lists",
    with_(*EDITS_SQL)
    + """, ls AS (SELECT *, CAST((row_number() OVER (PARTITION BY plan_id, owner ORDER BY source_id) - 1) // 3 AS INTEGER) AS part FROM
  (SELECT DISTINCT cl.plan_id, source_id, CASE WHEN rm.id IS NOT NULL THEN merge_into ELSE owner END AS owner FROM cl LEFT JOIN rm ON rm.plan_id=cl.plan_id AND rm.id=cl.owner) WHERE owner IS NOT NULL)
SELECT plan_id, owner, part, max(max(part)) OVER (PARTITION BY plan_id, owner) + 1 AS parts, string_agg(source_id, ',' ORDER BY source_id) AS source_ids, count(*) AS n FROM ls GROUP BY 1,2,3""",
)
def merged_source_lists(spark, d):
    """Source lists in parts of three."""
    m = V.merged_sources(revised(spark, d)[2][1], part_size=3)
    return m.select("plan_id", "owner", "part", "parts", F.concat_ws(",", "source_ids").alias("source_ids"), F.size("source_ids").cast("long").alias("n"))


@query(
    "snapshot_diff",
    with_(*EDITS_SQL)
    + """SELECT coalesce(a.plan_id,b.plan_id) AS plan_id, coalesce(a.id,b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old a FULL JOIN after b ON a.plan_id=b.plan_id AND a.id=b.id WHERE a.id IS NULL OR b.id IS NULL OR a.cx<>b.cx OR a.cy<>b.cy OR a.w<>b.w""",
)
def snapshot_diff(spark, d):
    old, _, (new, _) = revised(spark, d)
    return V.snapshot_diff(old, new, ["plan_id", "id"], ["cx", "cy", "w"])


REL = "select o_custkey as plan_id, concat('B', o_orderkey) as src, concat('B', min(o_orderkey) over (partition by o_custkey)) as dst, o_orderstatus as relation from {orders}"


@query(
    "edge_redirect",
    with_(*EDITS_SQL, R.cte("rel", REL))
    + """SELECT plan_id, src, dst, relation FROM (SELECT rel.plan_id, CASE WHEN a.id IS NOT NULL THEN a.merge_into ELSE src END AS src, CASE WHEN b.id IS NOT NULL THEN b.merge_into ELSE dst END AS dst, relation
 FROM rel LEFT JOIN rm a ON a.plan_id=rel.plan_id AND a.id=src LEFT JOIN rm b ON b.plan_id=rel.plan_id AND b.id=dst) WHERE src IS NOT NULL AND dst IS NOT NULL AND src<>dst""",
)
def edge_redirect(spark, d):
    _, ch, _ = revised(spark, d)
    merges = ch.filter("op = 'remove'").select("plan_id", "id", F.col("merge_into").alias("target"))
    return graph.redirect_edges(R.derive(spark, d, REL), merges)


@query(
    "edges_with_ends",
    with_(*EDITS_SQL, R.cte("rel", REL))
    + "SELECT plan_id, src, dst, relation FROM rel WHERE (plan_id,src) IN (SELECT (plan_id,id) FROM after) AND (plan_id,dst) IN (SELECT (plan_id,id) FROM after)",
)
def edges_with_ends(spark, d):
    return graph.edges_with_ends(R.derive(spark, d, REL), revised(spark, d)[2][0])


ELEM = "select o_custkey as plan_id, case o_orderkey%4 when 0 then 'terrain' when 1 then 'zones' when 2 then 'trees' else 'routes' end as collection, o_orderkey as id, 'old' as tag from {orders}"
ELEM_UP = "select o_custkey as plan_id, case o_orderkey%4 when 0 then 'terrain' when 1 then 'zones' when 2 then 'trees' else 'routes' end as collection, case when o_orderkey%3=0 then o_orderkey else o_orderkey+1000000 end as id, 'new' as tag from {orders} where o_totalprice > 200000"
ELEM_RM = "select o_custkey as plan_id, case o_orderkey%4 when 0 then 'terrain' when 1 then 'zones' when 2 then 'trees' else 'routes' end as collection, case when o_orderkey%7=0 then -o_orderkey else o_orderkey end as id, case when o_orderkey%5=0 then '' else 'gone' end as reason from {orders} where o_orderstatus='F'"
ELEM_SQL = (R.cte("el", ELEM), R.cte("up", ELEM_UP), R.cte("rm", ELEM_RM),
    "mg AS (SELECT * FROM el e WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.plan_id=e.plan_id AND up.collection=e.collection AND up.id=e.id) UNION ALL SELECT * FROM up), "
    "good AS (SELECT rm.* FROM rm JOIN mg ON mg.plan_id=rm.plan_id AND mg.collection=rm.collection AND mg.id=rm.id WHERE reason<>'')")


def _elements(spark, d):
    return V.apply_elements(R.derive(spark, d, ELEM), R.derive(spark, d, ELEM_UP), R.derive(spark, d, ELEM_RM))


@query("apply_elements", with_(*ELEM_SQL) + "SELECT plan_id, collection, id, tag FROM mg WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.plan_id=mg.plan_id AND g.collection=mg.collection AND g.id=mg.id)")
def apply_elements(spark, d):
    return _elements(spark, d)[0]


@query("invalid_removals", with_(*ELEM_SQL) + "SELECT plan_id, collection, id, reason FROM rm WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.plan_id=rm.plan_id AND g.collection=rm.collection AND g.id=rm.id)")
def invalid_removals(spark, d):
    return _elements(spark, d)[1]


# ---- locks and evidence ------------------------------------------------------------------

BLD = R.BUILDING_TEXT_ROWS.replace("select doc_id,", "select doc_id as plan_id,")
BL = R.cte("bl", BLD)
MOVED = "case when k%7=0 then ax+1 else ax end"


def _moved(spark, d):
    b = R.derive(spark, d, BLD)
    return b, b.withColumns({"ax": F.expr(MOVED), "q2y": F.expr("case when k%35=0 then q2y - 2 else q2y end")})


@query("lock_violations", with_(BL) + "SELECT plan_id, id, CAST(1 + (CASE WHEN k%35=0 THEN 1 ELSE 0 END) AS INTEGER) AS fields FROM bl WHERE category='other' AND k%7=0")
def lock_violations(spark, d):
    b, now = _moved(spark, d)
    return V.lock_violations(b.filter("category = 'other'"), now)


@query(
    "carried_locks",
    with_(BL)
    + "SELECT plan_id, id, CASE WHEN k%5=0 THEN 'edited' WHEN k%3=0 THEN 'audit' END AS identity_audit, CASE WHEN k%3=0 THEN k%9=0 END AS grouped, k%3=0 AS locked FROM bl",
)
def carried_locks(spark, d):
    b = R.derive(spark, d, BLD)
    old = b.select("plan_id", "id", F.expr("k%3=0").alias("locked"), F.lit("audit").alias("identity_audit"), "grouped")
    new = b.select("plan_id", "id", F.expr("case when k%5=0 then 'edited' end").alias("identity_audit"))
    return V.carry_locks(old, new).select("plan_id", "id", "identity_audit", "grouped", "locked")


EV = f"""select plan_id, concat('B', k) as id, {R.QUAD_TEXT},
  cast(k*37%600 as double) as sx0, cast(k*53%600 as double) as sy0, cast(k*37%600+90 as double) as sx1, cast(k*53%600+95 as double) as sy1,
  cast(k*37%600+k%200 as double) as ax, cast(k*53%600+k%300 as double) as ay, 'house' as category, cast(k%24 as double)/2 as clock,
  case when k=mn then 'keep' when k%9=0 then 'merge' when k%9=1 then 'reject' when k%9=2 then 'uncertain' else 'keep' end as status,
  case when k%9=0 then concat('B', case when k%2=0 then mn else k+1 end) end as merge_into,
  case when k%4=0 then 'unresolved' else 'independent' end as independence, case when k%6=0 then 'unclear' else 'physical' end as appearance_kind,
  cast(k%13+2 as double)/4 as ratio_low, cast(k%13+4 as double)/4 as ratio_high
  from (select o_custkey as plan_id, o_orderkey as k, min(o_orderkey) over (partition by o_custkey) as mn, o_orderpriority as prio from {{orders}}) o where prio <> '5-LOW'"""
EVC = R.cte("ev", EV)
ID_SQL = """, alive AS (SELECT plan_id, id FROM ev WHERE status IN ('keep','uncertain')),
refused AS (SELECT plan_id, id FROM ev WHERE status='merge' AND NOT EXISTS (SELECT 1 FROM alive a WHERE a.plan_id=ev.plan_id AND a.id=ev.merge_into)),
moves AS (SELECT plan_id, id, CASE WHEN status='merge' THEN merge_into END AS target FROM ev WHERE status IN ('merge','reject') AND NOT EXISTS (SELECT 1 FROM refused r WHERE r.plan_id=ev.plan_id AND r.id=ev.id))"""


def _identity(spark, d):
    b = R.derive(spark, d, BLD)
    return E.apply_identity(b, R.derive(spark, d, CL), R.derive(spark, d, EV))


@query(
    "apply_identity",
    with_(BL, EVC)
    + ID_SQL
    + f""", j AS (SELECT bl.plan_id, bl.id, bl.ax AS oax, bl.ay AS oay, bl.sx1 AS osx1, bl.confidence, bl.grouped, ev.* EXCLUDE (plan_id, id) FROM bl LEFT JOIN (SELECT * FROM ev WHERE status IN ('keep','uncertain')) ev ON ev.plan_id=bl.plan_id AND ev.id=bl.id
  WHERE NOT EXISTS (SELECT 1 FROM moves m WHERE m.plan_id=bl.plan_id AND m.id=bl.id)),
f AS (SELECT *, status IS NOT NULL AS hit, status IS NOT NULL AND NOT {R.sql_contains("ax", "ay", [(f"q{i}x", f"q{i}y") for i in range(4)])} AS fl FROM j)
SELECT plan_id, id, CASE WHEN hit THEN sx1 ELSE osx1 END AS sx1, CASE WHEN fl THEN round((q0x+q1x+q2x+q3x)/4,3) WHEN hit THEN ax ELSE oax END AS ax, CASE WHEN fl THEN round((q0y+q1y+q2y+q3y)/4,3) WHEN hit THEN ay ELSE oay END AS ay,
  CASE WHEN fl THEN ax END AS reported_ax, CASE WHEN status='uncertain' THEN 'low' WHEN hit THEN 'medium' ELSE confidence END AS confidence,
  grouped OR coalesce(hit AND appearance_kind='physical' AND independence='unresolved', FALSE) AS grouped, hit AS locked FROM f""",
)
def apply_identity(spark, d):
    return _identity(spark, d)[0].select("plan_id", "id", "sx1", "ax", "ay", "reported_ax", "confidence", "grouped", "locked")


@query(
    "identity_ownership",
    with_(EVC, R.cte("cl", CL)) + ID_SQL
    + ", mv AS (SELECT cl.plan_id, source_id, CASE WHEN m.id IS NOT NULL THEN m.target ELSE owner END AS owner FROM cl LEFT JOIN moves m ON m.plan_id=cl.plan_id AND m.id=cl.owner), tg AS (SELECT DISTINCT plan_id, target FROM moves WHERE target IS NOT NULL) "
    + "SELECT DISTINCT mv.* FROM mv JOIN tg ON tg.plan_id=mv.plan_id AND tg.target=mv.owner UNION ALL SELECT mv.* FROM mv WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.plan_id=mv.plan_id AND tg.target=mv.owner)",
)
def identity_ownership(spark, d):
    return _identity(spark, d)[1]


@query("refused_merges", with_(EVC) + ID_SQL + "SELECT plan_id, id FROM refused")
def refused_merges(spark, d):
    return _identity(spark, d)[2]


@query(
    "shape_constrain",
    with_(BL, EVC)
    + """, j AS (SELECT bl.plan_id, bl.id, bl.w, bl.d, bl.ratio_low, bl.ratio_high, ev.ratio_low AS lo, ev.ratio_high AS hi, ev.id IS NOT NULL AND NOT bl.grouped AS u FROM bl LEFT JOIN (SELECT * FROM ev WHERE status IN ('keep','uncertain')) ev ON ev.plan_id=bl.plan_id AND ev.id=bl.id),
o AS (SELECT *, u AND NOT coalesce(w/nullif(d,0) BETWEEN lo AND hi, FALSE) AS outside FROM j)
SELECT plan_id, id, w, CASE WHEN outside THEN round(w/((lo+hi)/2),4) ELSE d END AS d, CASE WHEN u THEN lo ELSE ratio_low END AS ratio_low, CASE WHEN u THEN hi ELSE ratio_high END AS ratio_high,
  outside OR (u AND (ratio_low<>lo OR ratio_high<>hi)) AS shape_changed FROM o""",
)
def shape_constrain(spark, d):
    out = E.constrain_shapes(R.derive(spark, d, BLD), R.derive(spark, d, EV))
    return out.select("plan_id", "id", "w", "d", "ratio_low", "ratio_high", "shape_changed")


AUD_RUN = """select o_orderkey as run_id, o_orderkey%13<>0 as complete, concat(o_orderkey%7, ',', o_orderkey%9) as crop, concat(case when o_orderkey%17=0 then 8 else o_orderkey%7 end, ',', o_orderkey%9) as meta_crop,
  concat('s', case when o_orderkey%19=0 then -1 else o_custkey end) as source_sha256, concat('p', case when o_orderkey%23=0 then -1 else o_custkey end) as plan_sha256 from {orders}"""
AUD_DEC = "select o_custkey as plan_id, l_orderkey as run_id, concat('B', l_orderkey%8) as id, l_linenumber, l_suppkey from {lineitem} join {orders} on l_orderkey=o_orderkey"
AUD_PLAN = "select c_custkey as plan_id, concat('s', c_custkey) as source_sha256, concat('p', c_custkey) as plan_sha256 from {customer}"
AUD_SEL = "select distinct l_orderkey as run_id, concat('B', l_orderkey%8) as id from {lineitem} where l_linenumber = 1"
AUD_SQL = with_(R.cte("ru", AUD_RUN), R.cte("de", AUD_DEC), R.cte("pl", AUD_PLAN), R.cte("se", AUD_SEL)) + """, ds AS (SELECT * FROM de WHERE (run_id,id) IN (SELECT (run_id,id) FROM se)),
j AS (SELECT ds.*, CASE WHEN NOT complete THEN 'incomplete_run' WHEN ru.source_sha256<>pl.source_sha256 THEN 'source_changed' WHEN ru.plan_sha256<>pl.plan_sha256 THEN 'other_snapshot' WHEN crop<>meta_crop THEN 'crop_differs' WHEN n>1 THEN 'ambiguous' END AS reason
 FROM ds JOIN ru USING (run_id) JOIN pl USING (plan_id) JOIN (SELECT plan_id, id, count(*) AS n FROM ds GROUP BY 1,2) c USING (plan_id,id))"""


def _evidence(spark, d):
    return E.load_evidence(R.derive(spark, d, AUD_DEC), R.derive(spark, d, AUD_RUN), R.derive(spark, d, AUD_PLAN), R.derive(spark, d, AUD_SEL))


@query("usable_evidence", AUD_SQL + "SELECT plan_id, run_id, id, l_linenumber, l_suppkey FROM j WHERE reason IS NULL")
def usable_evidence(spark, d):
    return _evidence(spark, d)[0]


@query("refused_evidence", AUD_SQL + "SELECT plan_id, run_id, id, l_linenumber, l_suppkey, reason FROM j WHERE reason IS NOT NULL")
def refused_evidence(spark, d):
    return _evidence(spark, d)[1]


PICKED = """select run_id, id from (select l_orderkey as run_id, concat('B', case when l_orderkey%9=0 then 99 else l_orderkey%8 end) as id, l_linenumber as n, l_orderkey as k from {lineitem} group by 1, 2, 3, 4) t where n = 1 or (n = 2 and k%4 = 0)"""


def _selected(spark, d):
    return E.load_evidence(R.derive(spark, d, AUD_DEC), R.derive(spark, d, AUD_RUN), R.derive(spark, d, AUD_PLAN), R.derive(spark, d, PICKED))


PICKED_SQL = with_(R.cte("ru", AUD_RUN), R.cte("de", AUD_DEC), R.cte("pl", AUD_PLAN), R.cte("se", PICKED)) + """, wrong AS (SELECT run_id FROM se GROUP BY run_id, id HAVING count(*)>1 UNION SELECT run_id FROM se WHERE (run_id, id) NOT IN (SELECT (run_id, id) FROM de)),
ds AS (SELECT * FROM de WHERE run_id IN (SELECT run_id FROM wrong) OR (run_id,id) IN (SELECT (run_id,id) FROM se)),
j AS (SELECT ds.*, CASE WHEN run_id IN (SELECT run_id FROM wrong) THEN 'invalid_selection' WHEN NOT complete THEN 'incomplete_run' WHEN ru.source_sha256<>pl.source_sha256 THEN 'source_changed' WHEN ru.plan_sha256<>pl.plan_sha256 THEN 'other_snapshot' WHEN crop<>meta_crop THEN 'crop_differs' WHEN n>1 THEN 'ambiguous' END AS reason
 FROM ds JOIN ru USING (run_id) JOIN pl USING (plan_id) JOIN (SELECT plan_id, id, count(*) AS n FROM ds GROUP BY 1,2) c USING (plan_id,id))"""


@query("selected_evidence", PICKED_SQL + "SELECT plan_id, run_id, id, l_linenumber, l_suppkey, reason FROM j")
def selected_evidence(spark, d):
    """Chosen decisions; a run whose choice names an id twice, or one that is not there, is refused whole."""
    good, refused = _selected(spark, d)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(refused)


@query("audited_box_moved", with_(BL) + "SELECT plan_id, id FROM bl WHERE abs(k%5-2) > 1")
def audited_box_moved(spark, d):
    """Boxes audited 0 or 0.008 away are the same, 2 away belong to another snapshot."""
    b = R.derive(spark, d, BLD)
    delta = F.expr("case when abs(k%5-2) > 1 then 2D when k%5=1 then 0.008D else 0D end")
    audited = b.select("plan_id", "id", *[(F.col("s" + c) + delta).alias(c) for c in G.BOX])
    return E.box_moved(audited, b)


@query(
    "stale_bindings",
    with_(R.cte("ru", AUD_RUN), R.cte("pl", AUD_PLAN), "b AS (SELECT run_id, o_custkey AS plan_id, source_sha256, plan_sha256 FROM ru JOIN orders ON o_orderkey=run_id)")
    + "SELECT run_id, plan_id FROM b WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.plan_id=b.plan_id AND pl.source_sha256=b.source_sha256 AND pl.plan_sha256=b.plan_sha256)",
)
def stale_bindings(spark, d):
    runs = R.derive(spark, d, AUD_RUN).join(R.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("plan_id")), "run_id")
    return V.stale(runs, R.derive(spark, d, AUD_PLAN), ["plan_id"], ["source_sha256", "plan_sha256"]).select("run_id", "plan_id")


@query(
    "plan_fingerprint",
    with_(BL)
    + """, h AS (SELECT plan_id, sha256('{"id":"'||id||'","cx":"'||CAST(CAST(cx AS BIGINT) AS VARCHAR)||'"'||CASE WHEN label IS NULL THEN '' ELSE ',"label":"'||label||'"' END||'}') AS s FROM bl)
SELECT plan_id, sha256(count(*)::VARCHAR||':'||CAST(sum(CAST('0x'||substr(s,1,12) AS BIGINT)) AS VARCHAR)||':'||CAST(sum(CAST('0x'||substr(s,53,12) AS BIGINT)) AS VARCHAR)) AS content_sha256 FROM h GROUP BY 1""",
)
def plan_fingerprint(spark, d):
    b = R.derive(spark, d, BLD).withColumn("cx", F.col("cx").cast("long"))
    return V.fingerprint(b, ["plan_id"], ["id", "cx", "label"])


# ---- missing candidates ---------------------------------------------------------------------

MISS = f"""select plan_id, k as id, {R.QUAD_TEXT}, cast(k*61%1000 as double) as ax, cast(k*83%1000 as double) as ay, cast(k%24 as double)/2 as clock,
  case k%3 when 0 then 'keep' when 1 then 'uncertain' else 'reject' end as status, case when k%5=0 then 'reflection' else 'physical' end as appearance_kind,
  cast(k%13+2 as double)/4 as ratio_low, cast(k%13+4 as double)/4 as ratio_high from (select o_custkey as plan_id, o_orderkey as k from {{orders}}) o"""
NEAR_SQL = """, n0 AS (SELECT p.plan_id, p.id, min_by(b.id, sqrt((b.ax-p.ax)**2+(b.ay-p.ay)**2)*1000000+b.id/1000000.0) AS nearest FROM PTS p JOIN buildings b ON b.plan_id=p.plan_id GROUP BY 1,2),
pl AS (SELECT p.*, n0.nearest, CASE WHEN sqrt((b.cx-b.ax)**2+(b.cy-b.ay)**2)>50 THEN 0 ELSE b.cx-b.ax END AS shx, CASE WHEN sqrt((b.cx-b.ax)**2+(b.cy-b.ay)**2)>50 THEN 0 ELSE b.cy-b.ay END AS shy
  FROM PTS p JOIN n0 USING (plan_id,id) JOIN buildings b ON b.plan_id=p.plan_id AND b.id=n0.nearest)"""
PROMO_SQL = with_(R.BUILDINGS, R.cte("ms", MISS), "kp AS (SELECT * FROM ms WHERE status='keep' AND appearance_kind='physical')") + NEAR_SQL.replace("PTS", "kp") + """,
bx AS (SELECT *, least(q0x,q1x,q2x,q3x) AS b0, least(q0y,q1y,q2y,q3y) AS b1, greatest(q0x,q1x,q2x,q3x) AS b2, greatest(q0y,q1y,q2y,q3y) AS b3 FROM pl),
pm AS (SELECT *, round(ax+shx,3) AS cx, round(ay+shy,3) AS cy, round(greatest(b2-b0,b3-b1),3) AS w, round(greatest(b2-b0,b3-b1)/((ratio_low+ratio_high)/2),3) AS d, 'Z_'||id AS zone_id FROM bx)"""


@query("promoted_buildings", PROMO_SQL + "SELECT plan_id, id, nearest, cx, cy, w, d, zone_id FROM pm")
def promoted_buildings(spark, d):
    out, _ = E.promote(R.derive(spark, d, MISS), R.buildings(spark, d))
    return out.select("plan_id", "id", "nearest", "cx", "cy", "w", "d", "zone_id")


@query(
    "promoted_zones",
    PROMO_SQL
    + f""", co AS (SELECT *, {R.sql_corners()} FROM pm)
SELECT plan_id, zone_id, greatest(0,b0-4) AS src_x0, least(1000,b3+4) AS src_y1, round(greatest(0,least(c0x,c1x,c2x,c3x)-10),6) AS plan_x0, round(least(1000,greatest(c0y,c1y,c2y,c3y)+10),6) AS plan_y1, q1x-q0x AS axis1_x, q3y-q0y AS axis2_y FROM co""",
)
def promoted_zones(spark, d):
    _, z = E.promote(R.derive(spark, d, MISS), R.buildings(spark, d))
    return z.select("plan_id", "zone_id", "src_x0", "src_y1", F.round("plan_x0", 6).alias("plan_x0"), F.round("plan_y1", 6).alias("plan_y1"), "axis1_x", "axis2_y")


@query(
    "pending_markers",
    with_(R.BUILDINGS, R.cte("ms", MISS), "un AS (SELECT * REPLACE ((q0x+q1x+q2x+q3x)/4 AS ax, (q0y+q1y+q2y+q3y)/4 AS ay) FROM ms WHERE status='uncertain')")
    + NEAR_SQL.replace("PTS", "un")
    + " SELECT plan_id, id, round(ax+shx,3) AS mx, round(ay+shy,3) AS my, TRUE AS candidate_only, FALSE AS marker_is_foundation FROM pl",
)
def pending_markers(spark, d):
    return E.record_pending(R.derive(spark, d, MISS), R.buildings(spark, d))


OBS = "select o_custkey as plan_id, o_orderkey%10 as run_id, concat('m', l_linenumber) as missing_id, l_partkey from {lineitem} join {orders} on l_orderkey=o_orderkey"
REQ = "select c_custkey as plan_id, cast(n as bigint) as run_id, concat('m', 1 + c_custkey%7) as missing_id from {customer}, (select 0 as n union all select 3 union all select 6) r"


@query(
    "single_observations",
    with_(R.cte("ob", OBS), R.cte("rq", REQ))
    + "SELECT plan_id, run_id, missing_id, min(l_partkey) AS l_partkey FROM rq JOIN ob USING (plan_id, run_id, missing_id) GROUP BY 1,2,3 HAVING count(*)=1",
)
def single_observations(spark, d):
    return E.single_observation(R.derive(spark, d, REQ), R.derive(spark, d, OBS))[0]


@query(
    "ambiguous_observations",
    with_(R.cte("ob", OBS), R.cte("rq", REQ))
    + "SELECT rq.plan_id, rq.run_id, rq.missing_id, count(l_partkey) AS matches FROM rq LEFT JOIN ob USING (plan_id, run_id, missing_id) GROUP BY 1,2,3 HAVING count(l_partkey)<>1",
)
def ambiguous_observations(spark, d):
    return E.single_observation(R.derive(spark, d, REQ), R.derive(spark, d, OBS))[1]


@query(
    "audit_changes",
    with_(EVC) + "SELECT plan_id, id, status AS action, CASE WHEN status IN ('merge','reject') THEN independence ELSE 'after '||independence END AS evidence FROM ev",
)
def audit_changes(spark, d):
    """Nested audit documents of a plan, a few changes each, flattened again."""
    ev = R.derive(spark, d, EV)
    removed = F.col("status").isin("merge", "reject")
    change = F.struct(
        "id", F.col("status").alias("action"), F.when(removed, F.col("independence")).alias("evidence"),
        F.when(~removed, F.concat(F.lit("after "), "independence")).alias("after_evidence"),
    )
    return E.audit_changes(ev.select("plan_id", F.array(change).alias("changes")))


# ---- surveys: local coordinates out, answers mapped back ------------------------------------------


@query(
    "focus_round_trip",
    with_(BL, R.IMAGES)
    + """, s AS (SELECT bl.plan_id, bl.id, bl.k, width, height, sx0, sy0, ax, ay, min(sx0) OVER w AS gx0, min(sy0) OVER w AS gy0, max(sx1) OVER w AS gx1, max(sy1) OVER w AS gy1 FROM bl JOIN images ON image_id=plan_id WINDOW w AS (PARTITION BY bl.plan_id, bl.k%3)),
c AS (SELECT *, floor(greatest(0,gx0-25)*width/1000) AS c0, floor(greatest(0,gy0-25)*height/1000) AS c1, least(width, ceil(least(1000,gx1+25)*width/1000)) AS c2, least(height, ceil(least(1000,gy1+25)*height/1000)) AS c3 FROM s),
l AS (SELECT *, round((sx0*width/1000-c0)*1000/(c2-c0),3) AS lx, round((sy0*height/1000-c1)*1000/(c3-c1),3) AS ly FROM c)
SELECT plan_id, id, lx, ly, round((c0+lx*(c2-c0)/1000)/width*1000,2) AS back_x, round((c1+ly*(c3-c1)/1000)/height*1000,2) AS back_y FROM l""",
)
def focus_round_trip(spark, d):
    b = R.derive(spark, d, BLD).withColumn("grp", F.expr("k % 3"))
    crops = b.groupBy("plan_id", "grp").agg(*G.union_box_aggs(G.box("s"))).join(
        R.images(spark, d).select(F.col("image_id").alias("plan_id"), "width", "height"), "plan_id"
    )
    size = (F.col("width"), F.col("height"))
    crop = coords.padded_crop(G.box(), size, (25, 25), (0, 0), clamp_first=True, high="ceil")
    crops = crops.withColumns({f"c{i}": c for i, c in enumerate(crop)}).drop(*G.BOX)
    c = tuple(F.col(f"c{i}") for i in range(4))
    local = coords.to_crop((F.col("sx0"), F.col("sy0")), c, size)
    out = b.join(crops, ["plan_id", "grp"]).withColumns({"lx": local[0], "ly": local[1]})
    back = coords.to_source((F.col("lx"), F.col("ly")), c, size, digits=2)
    return out.select("plan_id", "id", "lx", "ly", back[0].alias("back_x"), back[1].alias("back_y"))


# ---- publication ----------------------------------------------------------------------------------

PLANS = "select c_custkey as plan_id, c_custkey%29=0 as review_only, concat('h', c_custkey) as sha256 from {customer}"
REVIEWS = "select c_custkey as plan_id, case when c_custkey%2=0 then 'plan_final_check' else 'plan_critique' end as stage, case when c_custkey%7=0 then 'revise' when c_custkey%2=0 then 'ready_for_confirmation' else 'reasonable_approximation' end as verdict, concat('h', case when c_custkey%11=0 then 0 else c_custkey end) as plan_sha256 from {customer}"
OPEN = "select o_custkey as plan_id, o_orderkey as id from {orders} where o_orderstatus='P' and o_totalprice < 20000"
# plan buildings of which most keep every rule; what is wrong with the others comes with the rows they are made of
SOUND = f"""select doc_id, id, sx0 as q0x, sy0 as q0y, sx1 as q1x, sy0 as q1y, sx1 as q2x, sy1 as q2y, sx0 as q3x, sy1 as q3y, sx0, sy0, sx1, sy1, ax, ay, cx, cy, d*(ratio_low+ratio_high)/2 as w, d, clock, ratio_low, ratio_high,
  category, confidence, concat(subtype, 'x') as subtype, coalesce(label, 'label') as label, concat(evidence, ' seen') as evidence, assumption, concat('Z', k%4) as zone_id from ({R.BUILDING_TEXT_ROWS}) t"""
MARKERS = """select o_custkey as doc_id, concat('H', o_orderkey) as id, cast(o_orderkey*37%600 as double) as x0, cast(o_orderkey*53%600 as double) as y0, cast(o_orderkey*37%600+90 as double) as x1, cast(o_orderkey*53%600+80 as double) as y1,
  cast(o_orderkey%900 as double) as mx, cast(o_orderkey%900 as double) as my, o_orderkey%5<>0 as candidate_only, false as marker_is_foundation, cast(null as string) as plan_size, cast(null as string) as source_ids, cast(null as string) as zone_id,
  'l' as label, 'e' as evidence, case when o_orderkey%3=0 then '' else 'u' end as uncertainty, 'r' as source_run from {orders} where o_orderstatus='P' and o_totalprice < 20000"""
ISSUE_PARTS = (
    R.cte("bl", SOUND),
    R.cte("zo", ZONE_IDS),
    R.cte("mk", MARKERS),
    "iss AS (" + BUILDING_ISSUES + UNION + R.sql_issue("claims_foundation", "mk WHERE NOT candidate_only") + UNION + R.sql_issue("missing_uncertainty", "mk WHERE uncertainty=''")
    + UNION + R.sql_issue("level", "zo WHERE doc_id%23=0 AND zone_id='Z1'", entity="zone_id") + UNION + R.sql_issue("scene_boundary", "customer WHERE c_custkey%31=0", doc="c_custkey", entity="'scene'") + ")",
)
GATE_PARTS = (R.cte("ps", PLANS), R.cte("rv", REVIEWS), R.cte("op", OPEN), *ISSUE_PARTS)
GATE_BODY = """, gate AS (SELECT ps.plan_id, review_only, coalesce(plan_sha256=sha256,FALSE) AS hash_ok, coalesce(verdict = CASE WHEN stage='plan_final_check' THEN 'ready_for_confirmation' ELSE 'reasonable_approximation' END,FALSE) AS verdict_ok,
  coalesce(o.n,0) AS open_edits, coalesce(i.n,0) AS schema_issues, coalesce(f.n,0) AS major_findings FROM ps LEFT JOIN rv USING (plan_id) LEFT JOIN (SELECT plan_id, count(*) AS n FROM op GROUP BY 1) o USING (plan_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM iss GROUP BY 1) i ON i.doc_id=ps.plan_id::VARCHAR LEFT JOIN (SELECT plan_id, count(*) FILTER (severity='major') AS n FROM findings GROUP BY 1) f ON f.plan_id=ps.plan_id),
gt AS (SELECT *, NOT review_only AND hash_ok AND verdict_ok AND open_edits=0 AND schema_issues=0 AND major_findings=0 AS publishable FROM gate)"""
GATE_SQL = with_(*GEO, *GATE_PARTS) + GATE_BODY
CALM_GATE_SQL = with_(*CALM_GEO, *GATE_PARTS) + GATE_BODY


def plan_issues(spark, d):
    """Issues of every plan from the rule sets themselves: buildings, zones and boundary, pending markers."""
    zones = R.plan_zones(spark, d).select(
        F.col("plan_id").alias("doc_id"), F.col("zone_id").alias("id"), F.lit("zones").alias("collection"), F.col("poly").alias("source_poly"), F.col("poly").alias("plan_poly"),
        F.expr("case when plan_id%23=0 and zone_id='Z1' then 'top' else 'low' end").alias("level"), F.lit(None).cast("string").alias("category"),
        F.expr("array(named_struct('x', 1D, 'y', 0D), named_struct('x', 0D, 'y', 1D))").alias("axes"),
    )
    square = F.expr("array(named_struct('x', case when c_custkey%31=0 then -1D else 0D end, 'y', 0D), named_struct('x', 1000D, 'y', 0D), named_struct('x', 1000D, 'y', 1000D))")
    bounds = R.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), square.alias("source_poly"), square.alias("plan_poly"))
    b = R.derive(spark, d, SOUND)
    return P.schema_issues(b, R.derive(spark, d, ZONE_IDS), zones, bounds, R.derive(spark, d, MARKERS))


def _gate(spark, d):
    f, i = calm_findings(spark, d), plan_issues(spark, d)
    return P.publication_gate(R.derive(spark, d, PLANS), R.derive(spark, d, REVIEWS), R.derive(spark, d, OPEN), i, f), f


@query("publication_gate", CALM_GATE_SQL + "SELECT plan_id, review_only, hash_ok, verdict_ok, open_edits, schema_issues, major_findings, publishable FROM gt")
def publication_gate(spark, d):
    return _gate(spark, d)[0]


@query(
    "publication_manifest",
    with_(R.IMAGES) + ", " + CALM_GATE_SQL[5:]
    + """SELECT gt.plan_id, 'h'||gt.plan_id AS plan_sha256, images.sha256 AS source_sha256, coalesce(p.n,0) AS pending, coalesce(f.n,0) AS findings, 'ready_for_user_confirmation' AS status
FROM gt JOIN images ON image_id=gt.plan_id LEFT JOIN (SELECT plan_id, count(*) AS n FROM op GROUP BY 1) p ON p.plan_id=gt.plan_id LEFT JOIN (SELECT plan_id, count(*) AS n FROM findings GROUP BY 1) f ON f.plan_id=gt.plan_id WHERE publishable""",
)
def publication_manifest(spark, d):
    """Manifest rows of the plans that pass the gate."""
    g, f = _gate(spark, d)
    return P.manifest(g, R.derive(spark, d, PLANS), R.images(spark, d), R.derive(spark, d, OPEN), f)


UNCLEAR = "select o_custkey as plan_id, o_orderkey as id from {orders} where o_orderstatus = 'P' or o_totalprice > 200000"


@query(
    "publication_open_items",
    CALM_GATE_SQL.replace("gate AS (", UNCLEAR.join(("un AS (", "), gate AS (")).replace("{orders}", "orders"), 1)
    + """SELECT gt.plan_id, 'pending' AS section, CAST(un.id AS VARCHAR) AS id, NULL AS text FROM gt JOIN un ON un.plan_id=gt.plan_id WHERE publishable
UNION ALL SELECT gt.plan_id, 'finding', CAST(f.id AS VARCHAR), concat_ws(' ', severity, kind, other) FROM gt JOIN findings f ON f.plan_id=gt.plan_id WHERE publishable""",
)
def publication_open_items(spark, d):
    """Pending candidates and findings by name of the plans that pass the gate."""
    g, f = _gate(spark, d)
    return P.open_items(g, R.derive(spark, d, UNCLEAR), f)


@query(
    "accepted_hypotheses",
    with_(R.cte("al", GC_ALT), R.cte("de", GC_DEC))
    + """, dd AS (SELECT doc_id, instance_id, alternative_id, bool_or(verdict='usable_hypothesis') AS u, bool_and(coalesce(consistent,FALSE)) AS e FROM de GROUP BY 1,2,3)
SELECT al.doc_id, al.instance_id, al.alternative_id, coalesce(u AND (e OR placement='shape_only'), FALSE) AS accepted FROM al LEFT JOIN dd USING (doc_id, instance_id, alternative_id)""",
)
def accepted_hypotheses(spark, d):
    out = P.accepted_hypotheses(R.derive(spark, d, GC_ALT), R.derive(spark, d, GC_DEC))
    return out.select("doc_id", "instance_id", "alternative_id", "accepted")


JOBS = "select event_id as job_id, case when event_id%3=0 then 0 else 2 end as exit_code, case when event_id%11=0 then 'length' else 'stop' end as finish_reason, event_id%13<>0 as model_ok, event_id%7<>0 as parsed, event_id%17<>0 as stage_ok, event_id%2 as corrections from {events}"
LEFT = "select event_id as job_id from {events} where event_type in ('click','view','error')"


@query(
    "recovery_actions",
    with_(R.cte("jb", JOBS), R.cte("lf", LEFT))
    + """SELECT jb.job_id, CASE WHEN exit_code=0 THEN 'keep' WHEN NOT (finish_reason='stop' AND model_ok AND parsed AND stage_ok) THEN 'refuse' WHEN lf.job_id IS NULL THEN 'revalidated' WHEN corrections>=1 THEN 'exhausted' ELSE 'request_correction' END AS action
FROM jb LEFT JOIN lf ON lf.job_id=jb.job_id""",
)
def recovery_actions(spark, d):
    return P.recovery(R.derive(spark, d, JOBS), R.derive(spark, d, LEFT)).select("job_id", "action")


STATES = "select c_custkey as plan_id, cast(c_custkey%3 as bigint) as round, concat('f', c_custkey) as fitted_plan, case when c_custkey%4=0 then null else concat('r', c_custkey) end as reviewed_plan, case when c_custkey%5=0 then null else 'ok' end as final_check, 'c' as critique, c_custkey%2=0 as ready from {customer}"


@query(
    "next_review_round",
    with_(R.cte("st", STATES))
    + """SELECT plan_id, round, fitted_plan, reviewed_plan, critique, ready, 'history' AS part FROM st WHERE reviewed_plan IS NOT NULL AND final_check IS NOT NULL
UNION ALL SELECT plan_id, round+1, reviewed_plan, NULL, NULL, FALSE, 'next' FROM st WHERE reviewed_plan IS NOT NULL AND final_check IS NOT NULL""",
)
def next_review_round(spark, d):
    history, fresh = V.next_round(R.derive(spark, d, STATES), ["reviewed_plan", "final_check", "critique"])
    cols = ["plan_id", "round", "fitted_plan", "reviewed_plan", "critique", "ready"]
    return history.select(*cols, F.lit("history").alias("part")).unionByName(fresh.select(*cols, F.lit("next").alias("part")))


@query(
    "draft_routing",
    with_(R.cte("ps", PLANS), *ISSUE_PARTS) + "SELECT plan_id, coalesce(n,0) AS draft_issues, coalesce(n,0)=0 AS accepted FROM ps LEFT JOIN (SELECT doc_id, count(*) AS n FROM iss GROUP BY 1) i ON i.doc_id=plan_id::VARCHAR",
)
def draft_routing(spark, d):
    """Plans without issues are accepted, the others kept as marked drafts."""
    good, drafts = V.gate(R.derive(spark, d, PLANS), plan_issues(spark, d))
    return good.select("plan_id", F.lit(0).cast("long").alias("draft_issues"), F.lit(True).alias("accepted")).unionByName(
        drafts.select("plan_id", "draft_issues", F.lit(False).alias("accepted"))
    )


@query(
    "review_context",
    with_(BL, R.cte("cl", CL))
    + """SELECT plan_id, 'building' AS section, '{"id":"'||id||'","zone_id":"'||zone_id||'"}' AS payload FROM bl UNION ALL SELECT plan_id, 'claim', '{"source_id":"'||source_id||'"'||CASE WHEN owner IS NULL THEN '' ELSE ',"owner":"'||owner||'"' END||'}' FROM cl""",
)
def review_context(spark, d):
    return V.context_rows({"building": R.derive(spark, d, BLD).select("plan_id", "id", "zone_id"), "claim": R.derive(spark, d, CL)})


# ---- replay, orders, small checks --------------------------------------------------------------------

# what a plan holds now: one building moved in every tenth plan since its hash was recorded
SHIFTED = "CASE WHEN plan_id%10=0 AND id%2=0 THEN 1 ELSE 0 END"
PRINT_SQL = """SELECT plan_id, sha256(count(*)::VARCHAR||':'||CAST(sum(CAST('0x'||substr(s,1,12) AS BIGINT)) AS VARCHAR)||':'||CAST(sum(CAST('0x'||substr(s,53,12) AS BIGINT)) AS VARCHAR)) AS sha256
  FROM (SELECT plan_id, sha256('{"id":"'||id||'","cx":"'||CAST(CAST(cx AS BIGINT) + MOVE AS VARCHAR)||'","zone_id":"'||zone_id||'"}') AS s FROM buildings) GROUP BY 1"""


@query(
    "plan_replay",
    GATE_SQL + ", rec AS (" + PRINT_SQL.replace("MOVE", "0") + "), nw AS (" + PRINT_SQL.replace("MOVE", SHIFTED) + "), ti AS (SELECT doc_id, count(*) AS n FROM (" + ORACLES["terrain_issues"] + ") GROUP BY 1), " + R.cte("cl", CL)
    + """, so AS (SELECT plan_id, count(*) AS sources, count(*) FILTER (n>1) AS repeated FROM (SELECT plan_id, source_id, count(*) AS n FROM cl GROUP BY 1,2) GROUP BY 1),
rp AS (SELECT plan_id, count(*) AS regions, count(*) FILTER (grouped) AS grouped FROM buildings GROUP BY 1)
SELECT gt.plan_id, regions, grouped, coalesce(ti.n,0) AS schema_issues, coalesce(sources,0) AS sources, coalesce(repeated,0) AS repeated, major_findings AS major, nw.sha256=rec.sha256 AS unchanged,
  nw.sha256=rec.sha256 AND coalesce(ti.n,0)=0 AND coalesce(repeated,0)=0 AND major_findings=0 AS passed FROM gt JOIN rp USING (plan_id) JOIN rec USING (plan_id) JOIN nw USING (plan_id) LEFT JOIN so USING (plan_id) LEFT JOIN ti ON ti.doc_id=gt.plan_id::VARCHAR""",
)
def plan_replay(spark, d):
    """Stored plans run again: terrain rules, geometry, accounting, and the hash of the rows against the one on record."""
    from ..operators.summary import plan_report
    from ..plans.replay import replay
    from .rulesets import terrain_issues
    from .spatial_q import PEND, TERRAIN, TREES

    b = R.buildings(spark, d)
    report = plan_report(b, R.derive(spark, d, TERRAIN), R.derive(spark, d, TREES), R.derive(spark, d, PEND), findings(spark, d))

    def hashed(shift):
        rows = b.select("plan_id", "id", (F.col("cx").cast("long") + shift).alias("cx"), "zone_id")
        return V.fingerprint(rows, ["plan_id"], ["id", "cx", "zone_id"]).withColumnRenamed("content_sha256", "sha256")

    moved = F.when((F.col("plan_id") % 10 == 0) & (F.col("id") % 2 == 0), 1).otherwise(0)
    out = replay(
        report.select("plan_id", "regions", "grouped", "major"), terrain_issues(spark, d), R.derive(spark, d, CL), hashed(F.lit(0)), hashed(moved)
    )
    return out.select("plan_id", "regions", "grouped", "schema_issues", "sources", "repeated", "major", "unchanged", "passed")


OUTLINES = """select l_suppkey as id, l_orderkey*8+l_linenumber as pos, cast(l_quantity as double) as area, 2 + l_partkey % 5 as corners,
  cast(l_orderkey*37%900 as double) as px, cast(l_partkey*53%900 as double) as py, cast(l_quantity as double) as side from {lineitem}"""


@query(
    "largest_outlines",
    with_(R.cte("ol", OUTLINES))
    + "SELECT id, pos, area, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY area DESC, pos) AS rank FROM ol WHERE area>=24 AND corners>=3) WHERE rank<=12",
)
def largest_outlines(spark, d):
    """The twelve largest outlines of each supplier's items that have an area and three corners."""
    from ..operators.masks import largest_polygons

    corner = lambda k: f"named_struct('x', px + side * {k % 2}, 'y', py + side * {k} / 4)"
    ring = f"slice(array({', '.join(corner(k) for k in range(6))}), 1, cast(corners as int))"
    o = R.derive(spark, d, OUTLINES).withColumn("poly", F.expr(ring))
    return largest_polygons(o, ["id"]).select("id", "pos", "area", "rank")


@query(
    "accepted_first",
    with_(R.cte("al", GC_ALT), R.cte("de", GC_DEC))
    + """, dd AS (SELECT doc_id, instance_id, alternative_id, bool_or(verdict='usable_hypothesis') AS u, bool_and(coalesce(consistent,FALSE)) AS e FROM de GROUP BY 1,2,3)
SELECT al.doc_id, al.instance_id, alternative_id AS pos, coalesce(u AND (e OR placement='shape_only'), FALSE) AS accepted FROM al LEFT JOIN dd USING (doc_id, instance_id, alternative_id)""",
)
def accepted_first(spark, d):
    """Alternatives in reading order: accepted ones first within each instance."""
    from ..operators.ranking import accepted_first as order

    out = P.accepted_hypotheses(R.derive(spark, d, GC_ALT), R.derive(spark, d, GC_DEC))
    rows = out.select("doc_id", "instance_id", F.col("alternative_id").alias("pos"), "accepted")
    return order(rows, ["doc_id", "instance_id"])


@query(
    "mixed_sources",
    "SELECT CAST(event_id//100 AS BIGINT) AS batch, count(DISTINCT user_id) AS images FROM events GROUP BY 1 HAVING count(DISTINCT user_id)>1",
)
def mixed_sources(spark, d):
    """Batches that combine runs of different images."""
    from ..operators.summary import mixed_sources as mixed

    e = R.table(spark, d, "events")
    return mixed(e.select(F.expr("event_id div 100").alias("batch"), F.col("user_id").alias("image_id")))
