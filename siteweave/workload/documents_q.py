"""Nested documents written in parts, read back and taken apart again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import documents
from ..session import scratch_path
from ..sources import sinks
from . import recipes as R
from .plans_q import BL, BLD, CL, REVIEWS
from .registry import query, with_
from .spatial_q import CALM_GEO, calm_findings

HOUSES = """select o_custkey as scene_id, concat('H', o_orderkey) as id, o_orderstatus as status, o_orderkey%7 as long_side,
  named_struct('detected_first', o_orderkey%2=0, 'face', case when o_orderkey%3=0 then cast(null as string) else 'front' end) as evidence from {orders}"""
OCCLUSION = "select o_custkey as scene_id, concat('H', o_orderkey) as front_id, concat('H', o_orderkey + o_orderkey%4) as behind_id, cast(o_orderkey%10 as double)/10 as confidence from {orders}"
#: Bytes of the entries in one file: a compressed one is read by one task.
FILE_BYTES = 1 << 27
SCHEMAS = {
    "houses": "id string, status string, long_side bigint, evidence struct<detected_first: boolean, face: string>",
    "areas": "id string, points bigint, poly array<struct<x: double, y: double>>",
    "occlusion": "front_id string, behind_id string, confidence double",
}


def scene_tables(spark, d):
    """Houses with their evidence, water areas with their outline, occlusion between houses that are there."""
    houses = R.derive(spark, d, HOUSES)
    waters = R.plan_waters(spark, d).select(F.col("plan_id").alias("scene_id"), F.col("water_id").alias("id"), F.size("poly").cast("long").alias("points"), "poly")
    ids = houses.select("scene_id", "id").distinct()
    edges = R.derive(spark, d, OCCLUSION)
    for end in ("front_id", "behind_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), ["scene_id", end], "left_semi")
    return {"houses": houses, "areas": waters, "occlusion": edges.select("scene_id", "front_id", "behind_id", "confidence")}


def read_back(spark, sections, schemas, keys, part_bytes):
    """Written as compressed JSON lines in parts, read again and taken apart."""
    path = scratch_path(spark, "nested")
    sinks.write_new(documents.nested(sections, keys, part_bytes), path, "json", compression="gzip", maxRecordsPerFile=-(-FILE_BYTES // part_bytes))
    kinds = {c: next(iter(sections.values())).schema[c].dataType.simpleString() for c in keys}
    named = ", ".join(f"{c} {t}" for c, t in kinds.items())
    return documents.unnested(spark.read.schema(f"{named}, kind string, part long, parts long, entries string").json(path), schemas, keys)


@query(
    "scene_package",
    with_(R.PLAN_NATION, R.WATERS, R.PLAN_WATERS)
    + """, hs AS (SELECT o_custkey AS scene_id, 'H'||o_orderkey AS id FROM orders)
SELECT o_custkey AS scene_id, 'houses' AS kind, 'H'||o_orderkey AS id, o_orderstatus||'/'||o_orderkey%7||'/'||(o_orderkey%2=0)::VARCHAR||'/'||CASE WHEN o_orderkey%3=0 THEN 'none' ELSE 'front' END AS text FROM orders
UNION ALL SELECT plan_id, 'areas', water_id, '5/'||CAST(CAST(round(p0x*1000) AS BIGINT) AS VARCHAR) FROM plan_waters
UNION ALL SELECT o_custkey, 'occlusion', 'H'||o_orderkey, 'H'||(o_orderkey+o_orderkey%4)||'/'||o_orderkey%10 FROM orders WHERE (o_custkey, 'H'||(o_orderkey+o_orderkey%4)) IN (SELECT (scene_id, id) FROM hs)""",
)
def scene_package(spark, d):
    """Scenes with houses, evidence, areas and occlusion, in parts of 400 bytes; every row as it comes back."""
    back, _ = read_back(spark, scene_tables(spark, d), SCHEMAS, ["scene_id"], 400)
    row = lambda df, kind, ident, *text: df.select("scene_id", F.lit(kind).alias("kind"), F.col(ident).alias("id"), F.concat_ws("/", *text).alias("text"))
    houses = row(back["houses"], "houses", "id", "status", "long_side", F.col("evidence.detected_first").cast("string"), F.coalesce("evidence.face", F.lit("none")))
    areas = row(back["areas"], "areas", "id", "points", F.round(F.col("poly")[0]["x"] * 1000).cast("long"))
    occlusion = row(back["occlusion"], "occlusion", "front_id", "behind_id", F.round(F.col("confidence") * 10).cast("long"))
    return houses.unionByName(areas).unionByName(occlusion)


CONTEXT = {
    "building": "id string, zone_id string, grouped boolean",
    "claim": "source_id string, owner string",
    "finding": "id string, kind_of string, other string, severity string",
    "verdict": "stage string, verdict string",
}


@query(
    "review_package",
    with_(*CALM_GEO, BL, R.cte("cl", CL), R.cte("rv", REVIEWS))
    + """SELECT plan_id, 'building' AS kind, id||'/'||zone_id||'/'||grouped::VARCHAR AS text FROM bl UNION ALL SELECT plan_id, 'claim', concat_ws('/', source_id, owner) FROM cl
UNION ALL SELECT plan_id, 'finding', concat_ws('/', CAST(id AS VARCHAR), kind, other, severity) FROM findings UNION ALL SELECT plan_id, 'verdict', stage||'/'||verdict FROM rv""",
)
def review_package(spark, d):
    """What a reviewer is given of a plan: buildings, claims, geometry findings with overlaps, the last verdict; as it comes back."""
    f = calm_findings(spark, d)
    sections = {
        "building": R.derive(spark, d, BLD).select("plan_id", "id", "zone_id", "grouped"),
        "claim": R.derive(spark, d, CL).select("plan_id", "source_id", "owner"),
        "finding": f.select("plan_id", F.col("id").cast("string").alias("id"), F.col("kind").alias("kind_of"), F.col("other").cast("string").alias("other"), "severity"),
        "verdict": R.derive(spark, d, REVIEWS).select("plan_id", "stage", "verdict"),
    }
    back, _ = read_back(spark, sections, CONTEXT, ["plan_id"], 1_000)
    text = lambda df: F.concat_ws("/", *(F.col(c).cast("string") for c in df.columns if c != "plan_id"))
    rows = [df.select("plan_id", F.lit(kind).alias("kind"), text(df).alias("text")) for kind, df in back.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
