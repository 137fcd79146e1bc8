"""View rectangles of an image, one row per tile. Input columns: width, height (pixels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dlit


def _rect(label: Column | str, x0, y0, x1, y1) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    values = [v if isinstance(v, Column) else dlit(v) for v in (x0, y0, x1, y1)]
    return F.struct(
        label.alias("label"), *[v.cast("double").alias(n) for v, n in zip(values, ("tx0", "ty0", "tx1", "ty1"))]
    )


def _unfold(images: DataFrame, tiles: Column) -> DataFrame:
    return images.withColumn("_t", F.explode(tiles)).select(*images.columns, "_t.*")


def quadrant_tiles(images: DataFrame, overlap: float = 0.06) -> DataFrame:
    """2×2 tiles; each reaches ``overlap`` of the extent past the midlines."""
    w, h = F.col("width"), F.col("height")
    px, py = w * overlap, h * overlap
    right, left = F.bround(w / 2 + px), F.bround(w / 2 - px)
    low, high = F.bround(h / 2 + py), F.bround(h / 2 - py)
    return _unfold(
        images,
        F.array(
            _rect("nw", 0, 0, right, low),
            _rect("ne", left, 0, w, low),
            _rect("sw", 0, high, right, h),
            _rect("se", left, high, w, h),
        ),
    )


def corner_views(images: DataFrame, share: float = 0.68) -> DataFrame:
    """The full view and four corner tiles of ``share`` of the extent."""
    w, h = F.col("width"), F.col("height")
    tw, th = F.bround(w * share), F.bround(h * share)
    views = [_rect("full", 0, 0, w, h)]
    for r, y in enumerate((dlit(0), h - th)):
        for c, x in enumerate((dlit(0), w - tw)):
            views.append(_rect(f"tile_r{r}_c{c}", x, y, x + tw, y + th))
    return _unfold(images, F.array(*views))


def spaced_positions(start: Column, stop: Column, window: Column, stride: Column) -> Column:
    """Array of window starts that cover the interval; the last one is flush with its end."""
    steps = F.greatest(F.lit(0), F.floor((stop - start - window) / stride)).cast("int")
    several = F.transform(
        F.sequence(F.lit(0), steps),
        lambda i: F.when(i < steps, start + i * stride).otherwise(stop - window).cast("double"),
    )
    return F.when(window >= stop - start, F.array(start.cast("double"))).otherwise(several)


def sliding_tiles(images: DataFrame) -> DataFrame:
    """Overlapping tiles over the middle and lower band, plus the full view."""
    w, h = F.col("width"), F.col("height")
    df = images.withColumns(
        {
            "_tw": F.least(w, F.greatest(dlit(256), F.bround(w * 0.43))),
            "_th": F.least(h, F.greatest(dlit(256), F.bround(h * 0.50))),
            "_sx": F.greatest(dlit(64), F.bround(w * 0.185)),
            "_sy": F.greatest(dlit(48), F.bround(h * 0.08)),
            "_top": F.greatest(dlit(0), F.bround(h * 0.30)),
            "_bottom": F.least(h, F.bround(h * 0.88)),
        }
    )
    xs = spaced_positions(dlit(0), w, F.col("_tw"), F.col("_sx"))
    ys = spaced_positions(F.col("_top"), F.col("_bottom"), F.col("_th"), F.col("_sy"))
    df = df.withColumns({"_xs": xs, "_ys": ys})
    grid = F.flatten(
        F.transform(
            "_ys",
            lambda y, r: F.transform(
                "_xs",
                lambda x, c: _rect(
                    F.format_string("tile_r%02d_c%02d", r, c), x, y, x + F.col("_tw"), y + F.col("_th")
                ),
            ),
        )
    )
    out = df.withColumn("_t", F.explode(F.concat(F.array(_rect("full", 0, 0, w, h)), grid)))
    return out.select(*images.columns, "_t.*")
