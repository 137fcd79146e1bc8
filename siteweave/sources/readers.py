"""Readers: image catalogue, JSON documents, label text, scene priors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.proposals import numbered
from ..session import cut


def image_catalogue(spark: SparkSession, root: str, pattern: str = "*.jpg") -> DataFrame:
    """All images below a folder with path, byte size and content hash; the scan passes over files without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def number_files(files: DataFrame) -> DataFrame:
    """Running ``id`` (from 1) in path order; folders, nested or full, play no part."""
    return numbered(files, ["path"], "_row").withColumn("id", F.col("_row") + 1).drop("_row")


def json_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One row per document: path, raw text, and the VARIANT (null when malformed)."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return raw.select(
        F.input_file_name().alias("path"), F.col("value").alias("text"), F.try_parse_json("value").alias("doc")
    )


def typed_answers(runs: DataFrame, schema: str, column: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(runs with a typed ``data`` column, malformed ones as a single issue each)."""
    parsed = runs.withColumn("data", F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))
    whole = F.try_parse_json(F.col(column)).isNotNull() & F.col("data").isNotNull()
    bad = parsed.filter(~whole).select(
        F.col("run_id").cast("string").alias("doc_id"), F.lit("document").alias("entity_id"), F.lit("malformed").alias("rule")
    )
    return parsed.filter(whole), bad


def dispatch_answers(runs: DataFrame, schemas: Mapping[str, Mapping[str, str]], column: str = "answer", stage: str = "stage") -> tuple[DataFrame, DataFrame]:
    """(runs with their answer as VARIANT ``doc``, malformed ones as one issue each: ``run_id, rule, path``).

    ``schemas``: for each stage the paths an answer must have and their types. An
    answer is parsed once and checked, in the same pass, against the schema of its own
    stage. The issue names the first path that is absent, null or of another type:
    ``$`` for text that is no object; a stage without a schema is ``unknown_stage``.
    """
    parsed = runs.withColumn("doc", F.try_parse_json(column))
    parsed = parsed.withColumn("_kind", F.schema_of_variant("doc"))
    found = F.lit(None).cast("string")
    for name, paths in schemas.items():
        wrong = [F.when(F.try_variant_get("doc", path, kind).isNull(), F.lit(path)) for path, kind in paths.items()]
        found = F.when(F.col(stage) == name, F.coalesce(*wrong, F.lit(None).cast("string"))).otherwise(found)
    known = F.coalesce(F.col(stage).isin(*schemas), F.lit(False))
    path = F.when(~known, F.lit(None)).when(~F.coalesce(F.startswith("_kind", F.lit("OBJECT")), F.lit(False)), F.lit("$")).otherwise(found)
    # written, because both results need what one pass finds
    judged = cut(parsed.withColumns({"_path": path, "_bad": ~known | path.isNotNull()}).drop("_kind"))
    issues = judged.filter("_bad").select("run_id", F.when(F.col("_path").isNull(), "unknown_stage").otherwise("malformed").alias("rule"), F.col("_path").alias("path"))
    return judged.filter("not _bad").drop("_path", "_bad"), issues


def stage_fields(dispatched: DataFrame, schemas: Mapping[str, Mapping[str, str]], name: str, stage: str = "stage") -> DataFrame:
    """Answers of one stage with a typed column for each path of its schema, named by the path's last step."""
    own = dispatched.filter(F.col(stage) == name)
    return own.withColumns({path.rsplit(".", 1)[-1]: F.try_variant_get("doc", path, kind) for path, kind in schemas[name].items()})


def match_files(expected: DataFrame, catalogue: DataFrame, name: str = "name") -> DataFrame:
    """``expected`` (name and more) with path, bytes and hash of the file of that name; ``present`` tells where there is none.

    ``catalogue`` is the output of :func:`image_catalogue`. Several files of one name
    give a row each.
    """
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    files = catalogue.withColumn(name, stem) if name not in catalogue.columns else catalogue
    return expected.join(files, name, "left").withColumn("present", F.col("path").isNotNull())


def label_lines(spark: SparkSession, path: str, name: str = r"([^/]+)\.txt$") -> DataFrame:
    """Lines of the label text files with their image, which ``name`` takes from the file's path."""
    image = F.regexp_extract(F.input_file_name(), name, 1)
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path).select(
        image.alias("image_id"), F.col("value").alias("line")
    )


def labels_of_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (image_id and more) of each image; an image without a file, or without a valid line, has one row of nulls and ``labelled`` false."""
    held = labels.withColumn("labelled", F.lit(True))
    return images.join(held, "image_id", "left").fillna(False, ["labelled"])


def by_slug(rows: DataFrame, credits: DataFrame, key: str = "slug") -> tuple[DataFrame, DataFrame]:
    """(rows with what their slug says, rows whose slug says nothing).

    Columns of ``credits`` take precedence over those of the same name in ``rows``. Of
    a repeated slug the entry that is largest in all its columns counts.
    """
    rest = [c for c in credits.columns if c != key]
    one = credits.groupBy(key).agg(F.max(F.struct(*rest)).alias("_credit"))
    met = rows.join(one, key, "left")
    kept = [c for c in rows.columns if c not in rest]
    return met.filter("_credit is not null").select(*kept, "_credit.*"), met.filter("_credit is null").select(*rows.columns)


def manifest_jobs(documents: DataFrame) -> DataFrame:
    """Jobs of survey manifests: path, stage, label, exit_code."""
    jobs = F.from_json(F.get_json_object("text", "$.jobs"), "array<struct<stage:string,label:string,exit_code:int,run:string>>")
    return documents.select("path", F.explode(jobs).alias("j")).select("path", "j.*")


def scene_priors(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(camera rows per scene, scenes that carry house coordinates and are refused)."""
    scenes = F.from_json(F.get_json_object("text", "$.scenes"), "map<string,string>")
    rows = documents.select(F.explode(scenes).alias("scene_id", "body"))
    cam = F.from_json(
        F.get_json_object("body", "$.camera"),
        "struct<pitch_deg:double,azimuth_deg:double,scale:double,offset_y:double>",
    )
    refused = rows.filter(F.get_json_object("body", "$.houses").isNotNull()).select("scene_id")
    cameras = rows.select("scene_id", cam.alias("c"), "body").select(
        "scene_id", "c.pitch_deg", "c.azimuth_deg", "c.scale", F.col("c.offset_y").alias("offset_ratio"), "body"
    )
    return cameras.join(refused, "scene_id", "left_anti"), refused


def occlusion_edges(priors: DataFrame) -> DataFrame:
    """Front/behind/confidence triples of a prior; the mixed array is read as VARIANT."""
    v = F.try_parse_json(F.get_json_object("body", "$.occlusion"))
    triples = priors.select("scene_id", F.explode(F.variant_get(v, "$", "array<array<string>>")).alias("t"))
    return triples.select(
        "scene_id", F.col("t")[0].alias("src"), F.col("t")[1].alias("dst"), F.col("t")[2].cast("double").alias("confidence")
    )


def combine(caches: Sequence[DataFrame]) -> DataFrame:
    """Several caches as one; columns a cache lacks stay null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), caches)
