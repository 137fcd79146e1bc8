"""Points against the polygons of their plan, by cells that cover each polygon."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut
from .overlap import PAIR_LIMIT
from .ranking import spread_join

LOW, HIGH = ("_x0", "_y0"), ("_x1", "_y1")


def outline_box(poly: str = "poly") -> list[Column]:
    """``_x0, _y0, _x1, _y1`` of an outline: what lies outside needs no look at its edges."""
    axis = lambda c: F.transform(poly, lambda p: p[c])
    return [f(axis(c)).alias(f"_{c}{k}") for k, f in ((0, F.array_min), (1, F.array_max)) for c in "xy"]


def in_outline_box(x: Column, y: Column) -> Column:
    return (x >= F.col("_x0")) & (x <= F.col("_x1")) & (y >= F.col("_y0")) & (y <= F.col("_y1"))


def covering_cells(outlines: DataFrame) -> DataFrame:
    """One row for each cell that a polygon crosses or fills: adds ``_level, _cx, _cy`` and ``_filled``.

    ``outlines`` has ``_edges`` and the outline's box. Cells are squares whose edge
    is a power of two between a quarter and a half of the longer side of the box, so
    that a polygon of any size has 25 at most. A cell that no edge touches lies
    inside or outside as a whole, which its centre tells.
    """
    longer = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    out = outlines.filter(longer > 0).withColumn("_level", (F.floor(F.log2(longer)) - 1).cast("int"))
    out = out.withColumn("_edge", F.pow(G.dlit(2), F.col("_level")))
    for c in "xy":
        out = out.withColumn(f"_c{c}", F.explode(F.sequence(F.floor(F.col(f"_{c}0") / F.col("_edge")), F.floor(F.col(f"_{c}1") / F.col("_edge")))))
    slack = F.col("_edge") * 1e-6
    out = out.withColumns({f"_{c}low": F.col(f"_c{c}") * F.col("_edge") - slack for c in "xy"})
    out = out.withColumns({f"_{c}high": (F.col(f"_c{c}") + 1) * F.col("_edge") + slack for c in "xy"})

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        near = [(F.least(a[c], b[c]) <= F.col(f"_{c}high")) & (F.greatest(a[c], b[c]) >= F.col(f"_{c}low")) for c in "xy"]
        side = lambda x, y: (b["x"] - a["x"]) * (F.col(y) - a["y"]) - (b["y"] - a["y"]) * (F.col(x) - a["x"])
        sides = [side(x, y) for x in ("_xlow", "_xhigh") for y in ("_ylow", "_yhigh")]
        return near[0] & near[1] & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    middle = [(F.col(f"_c{c}") + 0.5) * F.col("_edge") for c in "xy"]
    out = out.withColumns({"_crossed": F.exists("_edges", touches), "_centre": G.contains_edges(*middle, F.col("_edges"))})
    out = out.filter("_crossed or _centre").withColumn("_filled", ~F.col("_crossed"))
    return out.drop("_edge", "_xlow", "_ylow", "_xhigh", "_yhigh", "_crossed", "_centre")


def inside_polygons(
    rows: DataFrame, polygons: DataFrame, at: Sequence[tuple[str, str]], keys: Sequence[str] = ("plan_id",), limit: int = PAIR_LIMIT
) -> DataFrame:
    """``rows`` with each polygon of the same ``keys`` that holds one of its points ``at``, once a row and polygon.

    ``polygons``: keys, ``poly`` and columns of other names, which are added. One
    aggregate looks for keys with more than ``limit`` points and polygons. All others
    meet in a plain join, boxes first. In the hot ones polygons are covered by cells
    of their own size and a point meets the polygons of its cell, once for each size
    of cell in its plan; cells with very many points are dealt out over parts. Where
    the polygon fills the cell, no edge is tested.
    """
    keys, added = list(keys), [c for c in polygons.columns if c not in (*keys, "poly")]
    outlines = polygons.filter(F.size("poly") > 2).select(*keys, *added, G.polygon_edges(F.col("poly")).alias("_edges"), *outline_box())
    both = rows.select(*keys).unionAll(polygons.select(*keys))
    hot = cut(both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys))
    if hot.isEmpty():
        return _plain(rows, outlines, at, keys).select(*rows.columns, *added)
    plain = _plain(rows.join(hot, keys, "left_anti"), outlines.join(hot, keys, "left_anti"), at, keys).select(*rows.columns, *added)
    cells = cut(covering_cells(outlines.join(hot, keys, "left_semi")))
    points = rows.join(hot, keys, "left_semi").withColumn("_row", F.monotonically_increasing_id())
    points = cut(points.withColumn("_p", F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in at)))))
    placed = points.join(cells.select(*keys, "_level").distinct(), keys).withColumns(
        {f"_c{c}": F.floor(F.col(f"_p.{c}") / F.pow(G.dlit(2), F.col("_level"))) for c in "xy"}
    )
    met = spread_join(placed, cells, [*keys, "_level", "_cx", "_cy"])
    px, py = F.col("_p.x"), F.col("_p.y")
    met = met.filter(F.col("_filled") | (in_outline_box(px, py) & G.contains_edges(px, py, F.col("_edges"))))
    met = met.select(*rows.columns, "_row", *added)
    return plain.unionByName((met.distinct() if len(at) > 1 else met).drop("_row"))


def _plain(rows: DataFrame, outlines: DataFrame, at: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    named = outlines.withColumnsRenamed({k: f"_outline_{k}" for k in keys})
    points = [(F.col(x), F.col(y)) for x, y in at]
    near = reduce(lambda s, p: s | in_outline_box(*p), points, F.lit(False))
    held = reduce(lambda s, p: s | (in_outline_box(*p) & G.contains_edges(*p, F.col("_edges"))), points, F.lit(False))
    same = reduce(lambda s, k: s & (F.col(k) == F.col(f"_outline_{k}")), keys, F.lit(True))
    return rows.join(named, same & near).filter(held)
