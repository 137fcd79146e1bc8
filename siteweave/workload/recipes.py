"""Domain tables derived from the retail/event/text tables, in Spark and in SQL.

Integer arithmetic on keys gives the same boxes, buildings and answers in both
engines. Each recipe comes as a function ``(spark, dir) -> DataFrame`` and a CTE
text of the same name and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dbl(sql: str):
    return F.expr(f"cast({sql} as double)")


# ---- boxes: one image per customer -------------------------------------------------

BOX_EXPR = {
    "x0": "o_orderkey*37%600",
    "y0": "o_orderkey*53%600",
    "x1": "o_orderkey*37%600+100+o_orderkey*17%300",
    "y1": "o_orderkey*53%600+100+o_orderkey*29%300",
}


def boxes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("image_id"),
        F.col("o_orderkey").alias("id"),
        *[_dbl(e).alias(n) for n, e in BOX_EXPR.items()],
        (_dbl("o_orderkey*7919%1000") / 1000).alias("score"),
    )


BOXES = """boxes AS (
  SELECT o_custkey AS image_id, o_orderkey AS id,
         CAST(o_orderkey*37%600 AS DOUBLE) AS x0, CAST(o_orderkey*53%600 AS DOUBLE) AS y0,
         CAST(o_orderkey*37%600+100+o_orderkey*17%300 AS DOUBLE) AS x1,
         CAST(o_orderkey*53%600+100+o_orderkey*29%300 AS DOUBLE) AS y1,
         CAST(o_orderkey*7919%1000 AS DOUBLE)/1000 AS score
  FROM orders)"""


# ---- objects: boxes with a category and an answer (run) they belong to -------------

CATEGORY = """CASE WHEN o_orderkey%13=0 THEN 'tree_group' WHEN o_orderkey%41=0 THEN 'castle'
  WHEN o_orderpriority='1-URGENT' THEN 'house' WHEN o_orderpriority='2-HIGH' THEN 'tree'
  WHEN o_orderpriority='3-MEDIUM' THEN 'mountain' WHEN o_orderpriority='4-NOT SPECIFIED' THEN 'water'
  ELSE 'house' END"""

RUN = "concat(cast(o_custkey as string), ':', o_orderstatus)"


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Inventory objects; local ids repeat inside a run now and then, boxes may leave the frame."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("image_id"),
        F.expr(RUN).alias("run_id"),
        F.col("o_orderkey").alias("id"),
        F.expr("concat('b', o_orderkey % 60)").alias("name"),
        F.expr(CATEGORY).alias("category"),
        *[_dbl(e).alias(n) for n, e in BOX_EXPR.items() if n != "x1"],
        _dbl("o_orderkey*37%600+o_orderkey*17%450").alias("x1"),
        F.expr("case when o_orderkey%3=0 then concat('b', (o_orderkey*7) % 60) end").alias("occluder"),
        F.expr("case when o_orderkey%4=0 then 'uncertain' when o_orderkey%97=0 then 'maybe' else 'supported' end").alias(
            "review_status"
        ),
    )


OBJECTS = f"""objects AS (
  SELECT o_custkey AS image_id, CAST(o_custkey AS VARCHAR)||':'||o_orderstatus AS run_id, o_orderkey AS id,
         'b'||(o_orderkey%60) AS name, {CATEGORY} AS category,
         CAST(o_orderkey*37%600 AS DOUBLE) AS x0, CAST(o_orderkey*53%600 AS DOUBLE) AS y0,
         CAST(o_orderkey*37%600+o_orderkey*17%450 AS DOUBLE) AS x1,
         CAST(o_orderkey*53%600+100+o_orderkey*29%300 AS DOUBLE) AS y1,
         CASE WHEN o_orderkey%3=0 THEN 'b'||((o_orderkey*7)%60) END AS occluder,
         CASE WHEN o_orderkey%4=0 THEN 'uncertain' WHEN o_orderkey%97=0 THEN 'maybe' ELSE 'supported' END AS review_status
  FROM orders)"""


# ---- images -----------------------------------------------------------------------


def images(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("image_id"),
        F.expr("cast(800 + c_custkey*13%1700 as double)").alias("width"),
        F.expr("cast(600 + c_custkey*29%1500 as double)").alias("height"),
        F.sha2("c_name", 256).alias("sha256"),
        F.concat(F.lit("scans/"), F.col("c_name"), F.lit(".jpg")).alias("path"),
    )


IMAGES = """images AS (
  SELECT c_custkey AS image_id, CAST(800+c_custkey*13%1700 AS DOUBLE) AS width,
         CAST(600+c_custkey*29%1500 AS DOUBLE) AS height, sha256(c_name) AS sha256,
         'scans/'||c_name||'.jpg' AS path
  FROM customer)"""


# ---- buildings: one plan per customer ----------------------------------------------

BUILDING_EXPR = {
    "cx": "o_orderkey*37%900+50",
    "cy": "o_orderkey*53%900+50",
    "w": "40+o_orderkey*17%160",
    "d": "30+o_orderkey*29%120",
    "sx0": "o_orderkey*37%600",
    "sy0": "o_orderkey*53%600",
    "sx1": "o_orderkey*37%600+100+o_orderkey*17%300",
    "sy1": "o_orderkey*53%600+100+o_orderkey*29%300",
    "ax": "o_orderkey*37%600+o_orderkey*11%150",
    "ay": "o_orderkey*53%600+100+o_orderkey*7%90",
}
BUILDING_TEXT = {
    "category": "case when o_orderkey%5=0 then 'other' when o_orderkey%53=0 then 'barn' else 'house' end",
    "confidence": "case o_orderstatus when 'F' then 'high' when 'O' then 'medium' else 'low' end",
    "zone_id": "concat('Z', o_orderkey % 4)",
    "subtype": "case when o_orderkey%31=0 then '' else 'hall' end",
}


def buildings(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("plan_id"),
        F.col("o_orderkey").alias("id"),
        *[_dbl(e).alias(n) for n, e in BUILDING_EXPR.items()],
        (_dbl("o_orderkey%24") / 2).alias("clock"),
        (_dbl("o_orderkey%20") / 10 + 0.5).alias("ratio_low"),
        (_dbl("o_orderkey%20") / 10 + 0.5 + _dbl("o_orderkey%7") / 4).alias("ratio_high"),
        *[F.expr(e).alias(n) for n, e in BUILDING_TEXT.items()],
        F.expr("o_orderkey % 9 = 0").alias("grouped"),
    )


BUILDINGS = (
    "buildings AS (SELECT o_custkey AS plan_id, o_orderkey AS id,\n"
    + ",\n".join(f"  CAST({e} AS DOUBLE) AS {n}" for n, e in BUILDING_EXPR.items())
    + """,
  CAST(o_orderkey%24 AS DOUBLE)/2 AS clock,
  CAST(o_orderkey%20 AS DOUBLE)/10 + 0.5::DOUBLE AS ratio_low,
  CAST(o_orderkey%20 AS DOUBLE)/10 + 0.5::DOUBLE + CAST(o_orderkey%7 AS DOUBLE)/4 AS ratio_high,
  """
    + ",\n".join(f"  {e} AS {n}" for n, e in BUILDING_TEXT.items())
    + ",\n  o_orderkey%9=0 AS grouped FROM orders)"
)


# ---- zones and water: rectangles and pentagons from nation keys ---------------------
# Every plan shares the layout of its customer's nation; the zone table is keyed by nation.


def zone_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Four support zones per nation, each a slanted quad."""
    n = table(spark, d, "nation")
    k = "cast(n_nationkey as double)"
    return (
        n.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .withColumn("bx", F.expr("cast((z % 2) * 480 as double)"))
        .withColumn("by", F.expr("cast((z div 2) * 480 as double)"))
        .select(
            F.col("n_nationkey").alias("nation"),
            F.expr("concat('Z', z)").alias("zone_id"),
            F.expr(
                f"""array(named_struct('x', bx+{k}, 'y', by), named_struct('x', bx+520, 'y', by+{k}/2),
                    named_struct('x', bx+520-{k}, 'y', by+520), named_struct('x', bx, 'y', by+520-{k}/2))"""
            ).alias("poly"),
        )
    )


# corner lists for unrolled SQL; bx/by/k are columns of the CTE
ZONES = """zones AS (
  SELECT nation, zone_id, zx+k AS p0x, zy AS p0y, zx+520 AS p1x, zy+k/2 AS p1y,
         zx+520-k AS p2x, zy+520 AS p2y, zx AS p3x, zy+520-k/2 AS p3y
  FROM (SELECT n_nationkey AS nation, 'Z'||z AS zone_id, CAST(n_nationkey AS DOUBLE) AS k,
               CAST((z%2)*480 AS DOUBLE) AS zx, CAST((z//2)*480 AS DOUBLE) AS zy
        FROM nation, (SELECT unnest([0,1,2,3]) AS z)))"""


def water_shapes(spark: SparkSession, d: str) -> DataFrame:
    """One pond per nation, a pentagon."""
    n = table(spark, d, "nation")
    k = "cast(n_nationkey as double)"
    return n.select(
        F.col("n_nationkey").alias("nation"),
        F.concat(F.lit("W"), F.col("n_nationkey")).alias("water_id"),
        F.expr(
            f"""array(named_struct('x', 100+10*{k}, 'y', 200D), named_struct('x', 350+10*{k}, 'y', 180+{k}),
                named_struct('x', 420+10*{k}, 'y', 400D), named_struct('x', 260+10*{k}, 'y', 600-{k}),
                named_struct('x', 80+10*{k}, 'y', 450D))"""
        ).alias("poly"),
    )


WATERS = """waters AS (
  SELECT n_nationkey AS nation, 'W'||n_nationkey AS water_id,
         100+10*k AS p0x, 200::DOUBLE AS p0y, 350+10*k AS p1x, 180+k AS p1y, 420+10*k AS p2x, 400::DOUBLE AS p2y,
         260+10*k AS p3x, 600-k AS p3y, 80+10*k AS p4x, 450::DOUBLE AS p4y
  FROM (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS k FROM nation))"""


def plan_nation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("plan_id"), F.col("c_nationkey").alias("nation"))


PLAN_NATION = "plan_nation AS (SELECT c_custkey AS plan_id, c_nationkey AS nation FROM customer)"


def plan_zones(spark: SparkSession, d: str) -> DataFrame:
    return plan_nation(spark, d).join(zone_shapes(spark, d), "nation").drop("nation")


def plan_waters(spark: SparkSession, d: str) -> DataFrame:
    return plan_nation(spark, d).join(water_shapes(spark, d), "nation").drop("nation")


PLAN_ZONES = "plan_zones AS (SELECT plan_id, z.* EXCLUDE (nation) FROM plan_nation JOIN zones z USING (nation))"
PLAN_WATERS = "plan_waters AS (SELECT plan_id, w.* EXCLUDE (nation) FROM plan_nation JOIN waters w USING (nation))"


# ---- answers (runs) -----------------------------------------------------------------

RUN_EXPR = {
    "stage": "CASE event_type WHEN 'click' THEN 'inventory' WHEN 'view' THEN 'review' WHEN 'purchase' THEN 'structure' WHEN 'signup' THEN 'audit' ELSE 'landmarks' END",
    "label": "CASE event_id%5 WHEN 0 THEN 'whole' WHEN 1 THEN 'nw' WHEN 2 THEN 'ne' WHEN 3 THEN 'sw' ELSE 'se' END",
    "finish_reason": "CASE WHEN event_id%11=0 THEN 'length' ELSE 'stop' END",
    "model_returned": "CASE event_id%6 WHEN 0 THEN 'atlas-2.5' WHEN 1 THEN 'atlas-2.5-2024-01' WHEN 2 THEN 'atlas-2.50' ELSE 'atlas-2.5' END",
    "issues": "CASE WHEN event_id%17=0 THEN 1 ELSE 0 END",
}
MODEL = "atlas-2.5"


def runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("image_id"),
        "ts",
        *[F.expr(x).alias(n) for n, x in RUN_EXPR.items()],
        F.lit(MODEL).alias("model_requested"),
        F.col("value").alias("elapsed_seconds"),
        # answers come fenced, with a reasoning block, cut off, or as plain JSON
        F.expr(
            """CASE event_id%4 WHEN 0 THEN concat('```json\\n', props, '\\n```')
                 WHEN 1 THEN concat('<think>maybe {1}</think> ', props)
                 WHEN 2 THEN substr(props, 1, length(props)-1) ELSE props END"""
        ).alias("answer"),
    )


RUNS = (
    "runs AS (SELECT event_id AS run_id, user_id AS image_id, ts,\n"
    + ",\n".join(f"  {x} AS {n}" for n, x in RUN_EXPR.items())
    + f""",
  '{MODEL}' AS model_requested, value AS elapsed_seconds,
  CASE event_id%4 WHEN 0 THEN '```json'||chr(10)||props||chr(10)||'```' WHEN 1 THEN '<think>maybe {{1}}</think> '||props
       WHEN 2 THEN substr(props, 1, length(props)-1) ELSE props END AS answer,
  props FROM events)"""
)


# ---- candidates and owners ------------------------------------------------------------


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Who accounts for which source candidate: an owner building or a rejection.

    A line item is one claim of candidate (order, part%8) in the plan of its
    order's customer; repeats and gaps come from the data itself.
    """
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("plan_id"),
        F.expr("concat(l_orderkey, '-', l_linenumber)").alias("source_id"),
        F.expr("case when l_returnflag = 'R' then null else concat('B', l_orderkey) end").alias("owner"),
    )


CLAIMS = """claims AS (
  SELECT o_custkey AS plan_id, l_orderkey||'-'||l_linenumber AS source_id,
         CASE WHEN l_returnflag='R' THEN NULL ELSE 'B'||l_orderkey END AS owner
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""


def expected_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Four numbered candidates per order."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("plan_id"),
        F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"),
        "o_orderkey",
    ).select("plan_id", F.expr("concat(o_orderkey, '-', n)").alias("source_id"))


EXPECTED = """expected AS (
  SELECT o_custkey AS plan_id, o_orderkey||'-'||n AS source_id
  FROM orders, (SELECT unnest([1,2,3,4]) AS n))"""


# ---- SQL text helpers ------------------------------------------------------------------


def sql_contains(x: str, y: str, corners: list[tuple[str, str]]) -> str:
    """Even-odd rule, unrolled over the closed outline."""
    parts = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        parts.append(
            f"CASE WHEN ({ay}>{y}) <> ({by}>{y}) AND {x} < ({bx}-{ax})*({y}-{ay})/nullif({by}-{ay},0)+{ax} THEN 1 ELSE 0 END"
        )
    return "((" + "+".join(parts) + ")%2=1)"


def sql_poly(alias: str, n: int) -> list[tuple[str, str]]:
    return [(f"{alias}.p{i}x", f"{alias}.p{i}y") for i in range(n)]


def sql_corners(b: str = "") -> str:
    """Select list of the eight corner columns of a facing rectangle."""
    p = f"{b}." if b else ""
    out = []
    for i, (sr, sf) in enumerate(((-1, 1), (1, 1), (1, -1), (-1, -1))):
        a = f"(pi()*{p}clock/6)"
        out.append(f"{p}cx + {sr}*{p}w/2*(-cos{a}) + {sf}*{p}d/2*sin{a} AS c{i}x")
        out.append(f"{p}cy + {sr}*{p}w/2*(-sin{a}) + {sf}*{p}d/2*(-cos{a}) AS c{i}y")
    return ", ".join(out)


CORNERS = f"corners AS (SELECT *, {sql_corners()} FROM buildings)"


def sql_quads_overlap(a: str, b: str, tol: str, unit: bool = False) -> str:
    """Separating axes over eight edges, unrolled."""
    terms = []
    for owner in (a, b):
        for i in range(4):
            j = (i + 1) % 4
            nx = f"(-({owner}.c{j}y-{owner}.c{i}y))"
            ny = f"({owner}.c{j}x-{owner}.c{i}x)"
            pa = [f"({a}.c{k}x*{nx}+{a}.c{k}y*{ny})" for k in range(4)]
            pb = [f"({b}.c{k}x*{nx}+{b}.c{k}y*{ny})" for k in range(4)]
            t = f"{tol}*sqrt({nx}*{nx}+{ny}*{ny})" if unit else tol
            terms.append(
                f"NOT (greatest({','.join(pa)}) <= least({','.join(pb)})+{t} OR greatest({','.join(pb)}) <= least({','.join(pa)})+{t})"
            )
    return "(" + " AND ".join(terms) + ")"


def sql_iou(a: str = "a", b: str = "b", floor: str | None = None) -> str:
    inter = (
        f"(greatest(0,least({a}.x1,{b}.x1)-greatest({a}.x0,{b}.x0))*greatest(0,least({a}.y1,{b}.y1)-greatest({a}.y0,{b}.y0)))"
    )
    union = f"(({a}.x1-{a}.x0)*({a}.y1-{a}.y0)+({b}.x1-{b}.x0)*({b}.y1-{b}.y0)-{inter})"
    if floor:
        return f"({inter}/greatest({union},{floor}))"
    return f"(CASE WHEN {union}=0 THEN 0 ELSE {inter}/{union} END)"


def sql_inter(a: str = "a", b: str = "b") -> str:
    return (
        f"(greatest(0,least({a}.x1,{b}.x1)-greatest({a}.x0,{b}.x0))*greatest(0,least({a}.y1,{b}.y1)-greatest({a}.y0,{b}.y0)))"
    )


# ---- derived tables whose text both engines accept -----------------------------------------
# ``{orders}`` etc. name the given tables; casts keep the types equal.


def derive(spark: SparkSession, d: str, text: str) -> DataFrame:
    names = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
    return spark.sql(text, **{n: table(spark, d, n) for n in names if "{" + n + "}" in text})


class _Plain(dict):
    def __missing__(self, key):
        return key


def cte(name: str, text: str) -> str:
    return f"{name} AS ({text.format_map(_Plain())})"


def sql_issue(rule: str, source: str, doc: str = "doc_id", entity: str = "id", distinct: bool = False) -> str:
    return (
        f"SELECT {'DISTINCT ' if distinct else ''}CAST({doc} AS VARCHAR) AS doc_id, CAST({entity} AS VARCHAR) AS entity_id, '{rule}' AS rule FROM {source}"
    )


def sql_duplicates(rule: str, source: str, on: str, entity: str = "id") -> str:
    return f"SELECT CAST(doc_id AS VARCHAR), CAST({entity} AS VARCHAR), '{rule}' FROM {source} GROUP BY {on} HAVING count(*)>1"


def sql_account(rule: str, expected: str, claims: str) -> str:
    """Expected and claims are relations with doc_id, source_id."""
    return f"""SELECT CAST(doc_id AS VARCHAR), source_id, '{rule}_'||CASE WHEN w=0 THEN 'unexpected' WHEN g=0 THEN 'missing' ELSE 'repeated' END
FROM (SELECT doc_id, source_id, max(w) AS w, sum(g) AS g FROM (SELECT doc_id, source_id, 1 AS w, 0 AS g FROM {expected} UNION ALL SELECT doc_id, source_id, 0, 1 FROM {claims}) GROUP BY 1,2) WHERE NOT (w=1 AND g=1)"""


def sql_convex(q: str = "q") -> str:
    turns = []
    for i in range(4):
        a, b, c = f"{q}{i}", f"{q}{(i + 1) % 4}", f"{q}{(i + 2) % 4}"
        turns.append(f"(({b}x-{a}x)*({c}y-{b}y)-({b}y-{a}y)*({c}x-{b}x))")
    return "((" + " AND ".join(f"{t}>1e-5" for t in turns) + ") OR (" + " AND ".join(f"{t}<-1e-5" for t in turns) + "))"


def sql_point(x: str, y: str) -> str:
    return f"({x} BETWEEN 0 AND 1000 AND {y} BETWEEN 0 AND 1000)"


def sql_quad_ok(q: str = "q") -> str:
    return "(" + " AND ".join(sql_point(f"{q}{i}x", f"{q}{i}y") for i in range(4)) + f" AND {sql_convex(q)})"


def sql_box_ok(p: str = "") -> str:
    return f"({sql_point(p + 'x0', p + 'y0')} AND {sql_point(p + 'x1', p + 'y1')} AND {p}x0<{p}x1 AND {p}y0<{p}y1)"


SQL_RATIO_OK = "(ratio_low>0 AND ratio_low<=ratio_high AND ratio_high<=30)"

QUAD_TEXT = """cast(k*37%600 as double) as q0x, cast(k*53%600 as double) as q0y, cast(k*37%600+100+k*17%300 as double) as q1x, cast(k*53%600 as double) as q1y,
  cast(case when k%19=0 then k*37%600 else k*37%600+100+k*17%300 end as double) as q2x, cast(k*53%600+100+k*29%300 as double) as q2y,
  cast(case when k%19=0 then k*37%600+100+k*17%300 else k*37%600 end as double) as q3x, cast(k*53%600+100+k*29%300 as double) as q3y"""

# a full plan building per order; every rule is broken by some residue class
BUILDING_TEXT_ROWS = f"""select doc_id, concat('B', k) as id, {QUAD_TEXT},
  cast(k*37%600 as double) as sx0, cast(k*53%600 as double) as sy0, cast(case when k%61=0 then k*37%600 else k*37%600+100+k*17%300 end as double) as sx1, cast(k*53%600+100+k*29%300 as double) as sy1,
  cast(k*37%600+k*11%150 as double) as ax, cast(case when k%71=0 then -1 else k*53%600+100+k*7%90 end as double) as ay,
  cast(k*37%900+50 as double) as cx, cast(case when k%73=0 then 1001 else k*53%900+50 end as double) as cy,
  cast(case when k%79=0 then 500 else 40+k*17%160 end as double) as w, cast(case when k%83=0 then 0 else 30+k*29%120 end as double) as d,
  cast(case when k%89=0 then 25 else k%25 end as double)/2 as clock,
  cast(k%20 as double)/10+cast(case when k%13=0 then 0 else 1 end as double)/2 as ratio_low, cast(k%20 as double)/10+cast(1 as double)/2+cast(k%7 as double)/4 as ratio_high,
  case when k%5=0 then 'other' when k%53=0 then 'barn' else 'house' end as category, case when k%97=0 then 'sure' when k%2=0 then 'high' else 'low' end as confidence,
  case when k%31=0 then '' else 'hall' end as subtype, case when k%29=0 then cast(null as string) else 'label' end as label,
  case when k%6=0 then 'newly_observed roof' when k%37=0 then '' else 'roof and wall' end as evidence, 'assumed' as assumption,
  concat('Z', k%5) as zone_id, k%9=0 as grouped, k
  from (select o_custkey as doc_id, o_orderkey as k from {{orders}}) o"""
