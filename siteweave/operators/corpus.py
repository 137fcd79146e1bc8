"""Corpus jobs: splits, crops for a classifier, negatives, leak scan, links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import geometry as G
from ..functions.geometry import dlit
from .overlap import box_pairs


def hash_order(name: Column, seed: str) -> Column:
    """Stable pseudo-random order in place of a seeded shuffle."""
    return F.md5(F.concat(name.cast("string"), F.lit(seed)))


def first_n(rows: DataFrame, order: str, keys: Sequence[str], limits: DataFrame, prefix: int = 4) -> DataFrame:
    """Rows among the first ``take`` of their key by the hash column ``order``.

    ``limits``: keys, take. Counts per hash prefix tell which prefix the cut
    falls into; only that one bucket per key is ranked, all others are decided by
    their prefix. Returns the rows with a boolean ``chosen``.
    """
    from pyspark.sql import Window as W

    keys = list(keys)
    b = rows.withColumn("_p", F.substring(order, 1, prefix))
    n = b.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    n = n.join(limits, keys)
    n = n.withColumn("_left", F.col("take") - F.col("_before")).select(*keys, "_p", "_n", "_left")
    j = b.join(n, [*keys, "_p"])
    edge = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    rest = [c for c in rows.columns]
    sure = j.filter(~edge).select(*rest, (F.col("_left") >= F.col("_n")).alias("chosen"))
    rank = F.row_number().over(W.partitionBy(*keys, "_p").orderBy(order))
    cut_bucket = j.filter(edge).withColumn("_r", rank).select(*rest, (F.col("_r") <= F.col("_left")).alias("chosen"))
    return sure.unionByName(cut_bucket)


def split_dataset(images: DataFrame, fraction: float = 0.18, seed: str = "20260807") -> DataFrame:
    """``split`` per image: the first round(n·fraction) by hash are validation."""
    keyed = images.withColumns({"_h": hash_order(F.col("name"), seed), "_set": F.lit(0)})
    take = keyed.groupBy("_set").agg(F.bround(F.count(F.lit(1)) * fraction).cast("long").alias("take"))
    out = first_n(keyed, "_h", ["_set"], take)
    return out.withColumn("split", F.when(F.col("chosen"), "val").otherwise("train")).drop("_h", "_set", "chosen")


def label_rows(lines: DataFrame) -> DataFrame:
    """``image_id, cx, cy, w, h`` of building labels (source class 1) from text lines."""
    f = F.split(F.trim("line"), r"\s+")
    cut = lines.withColumn("_f", f).filter((F.size("_f") == 5) & (F.col("_f")[0] == "1"))
    num = [F.col("_f")[i].cast("double").alias(n) for i, n in ((1, "cx"), (2, "cy"), (3, "w"), (4, "h"))]
    return cut.select(*[c for c in lines.columns if c != "line"], F.lit(0).alias("class"), *num)


def pixel_box(expansion: float) -> dict[str, Column]:
    """Centre label to a pixel box, grown by ``expansion`` per side; needs cx, cy, w, h, width, height."""
    w, h = F.col("w") * (1 + 2 * expansion), F.col("h") * (1 + 2 * expansion)
    return {
        "x0": F.greatest(dlit(0), F.bround((F.col("cx") - w / 2) * F.col("width"))),
        "y0": F.greatest(dlit(0), F.bround((F.col("cy") - h / 2) * F.col("height"))),
        "x1": F.least(F.col("width"), F.bround((F.col("cx") + w / 2) * F.col("width"))),
        "y1": F.least(F.col("height"), F.bround((F.col("cy") + h / 2) * F.col("height"))),
    }


def large_enough(crops: DataFrame, minimum: float = 12) -> DataFrame:
    return crops.filter((F.col("x1") - F.col("x0") >= minimum) & (F.col("y1") - F.col("y0") >= minimum))


def partial_crops(boxes: DataFrame) -> DataFrame:
    """Four hard negatives of each whole-building box."""
    b = G.box()
    w, h = b[2] - b[0], b[3] - b[1]

    def crop(kind, x0, y0, x1, y1) -> Column:
        return F.struct(F.lit(kind).alias("kind"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    kinds = F.array(
        crop("roof_only", b[0], b[1], b[2], F.bround(b[1] + dlit(0.48) * h)),
        crop("eave_band", b[0], F.bround(b[1] + dlit(0.18) * h), b[2], F.bround(b[1] + dlit(0.62) * h)),
        crop("left_fragment", b[0], b[1], F.bround(b[0] + dlit(0.54) * w), b[3]),
        crop("right_fragment", F.bround(b[0] + dlit(0.46) * w), b[1], b[2], b[3]),
    )
    rest = [c for c in boxes.columns if c not in G.BOX]
    return boxes.withColumn("_k", F.explode(kinds)).select(*rest, "_k.*")


def uniform(name: Column, salt: str) -> Column:
    """Uniform number in [0, 1) from a hash, the same on every run."""
    part = F.conv(F.substring(F.md5(F.concat(name.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double")
    return part / dlit(4294967296.0)


def background_boxes(images: DataFrame, per_image: int = 3) -> DataFrame:
    """Boxes of building-like size at hash-derived places; ids are ``image/number``."""
    rows = images.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(per_image - 1))))
    rows = rows.withColumn("id", F.concat_ws("/", F.col("image_id").cast("string"), "number"))

    def between(low: Column, high: Column, salt: str) -> Column:
        return low + F.floor(uniform(F.col("id"), salt) * (high - low + 1))

    w, h = F.col("width"), F.col("height")
    rows = rows.withColumns(
        {
            "_w": between(F.bround(w * 0.14), F.bround(w * 0.38), "w"),
            "_h": between(F.bround(h * 0.09), F.bround(h * 0.26), "h"),
        }
    )
    rows = rows.withColumns(
        {"x0": between(dlit(0), w - F.col("_w"), "x"), "y0": between(dlit(0), h - F.col("_h"), "y")}
    )
    return rows.withColumns({"x1": F.col("x0") + F.col("_w"), "y1": F.col("y0") + F.col("_h")}).drop("_w", "_h", "number")


def clear_of(candidates: DataFrame, labelled: DataFrame, limit: float = 0.02) -> DataFrame:
    """Candidates below the overlap limit with every labelled box of their image."""
    a, b = G.box(alias="a"), G.box(alias="b")
    touched = box_pairs(candidates, labelled, condition=G.iou_pixels(a, b) >= limit).select("a.image_id", "a.id").distinct()
    return candidates.join(touched, ["image_id", "id"], "left_anti")


def cap_negatives(negatives: DataFrame, positives: DataFrame, seed: str = "20260807") -> DataFrame:
    """As many negatives per split as there are positives, chosen by hash; no positives, no negatives."""
    limits = positives.groupBy("split").agg(F.count(F.lit(1)).alias("take"))
    keyed = negatives.withColumn("_h", hash_order(F.col("id"), seed))
    return first_n(keyed, "_h", ["split"], limits).filter("chosen").drop("_h", "chosen")


def dataset_stats(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images by split, positive and negative ones, label instances."""
    n = labels.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    j = images.join(n, "image_id", "left").fillna(0, ["_n"])
    return j.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("_n") > 0).alias("positive"),
        F.count_if(F.col("_n") == 0).alias("negative"),
        F.sum("_n").alias("instances"),
    )


def leak_scan(files: DataFrame) -> DataFrame:
    """``file, check`` for every finding over whole texts.

    ``files``: file, text, size (bytes). Patterns run side by side in one pass.
    """
    suffix = F.lit(False)
    for s in A.BLOCKED_SUFFIXES:
        suffix = suffix | F.endswith("file", F.lit(s))
    meta = F.array(
        F.when(suffix | (F.substring_index("file", "/", -1) == "config.local.json"), F.lit("private_or_model_file")),
        F.when(F.col("size") > A.SIZE_LIMIT, F.lit("file_exceeds_10_MiB")),
    )
    found = F.array_compact(F.concat(meta, A.leaks(F.col("text"))))
    return files.select("file", F.explode(found).alias("check"))


def broken_links(files: DataFrame, known: DataFrame) -> DataFrame:
    """Local links of markdown files without a target: ``file, target``.

    External and in-page links are left out; targets resolve from the file's
    folder. ``known``: file.
    """
    links = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(A.LINK), F.lit(1))).alias("target"))
    links = links.withColumn("target", F.regexp_replace("target", r"^<+|>+$", ""))
    local = links.filter(~F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.startswith("target", F.lit("#")))
    folder = F.regexp_extract("file", r"^(.*/)?[^/]*$", 1)
    path = F.concat(folder, F.url_decode(F.substring_index("target", "#", 1)))
    resolved = local.withColumn("_path", resolve_path(path))
    return resolved.join(known.select(F.col("file").alias("_path")), "_path", "left_anti").select("file", "target")


def resolve_path(path: Column) -> Column:
    """Path without ``.``, empty and ``..`` steps, of any depth; what climbs out of the root keeps its ``..``."""
    start = F.array().cast("array<string>")

    def step(done: Column, name: Column) -> Column:
        climbs = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        up = F.when(climbs, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(name)))
        return F.when(name.isin("", "."), done).when(name == "..", up).otherwise(F.concat(done, F.array(name)))

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
