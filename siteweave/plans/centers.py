"""Centres that a layout edit may choose from: grid shifts that keep a building inside its zone and boundary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..session import bounded_batches, cut

#: Edges of outlines that are tested at once; an outline may have more.
WRITTEN_OUT = 256

#: Buildings whose shifts are held at once.
HELD_BUILDINGS = 512

#: Buildings of a task; its work follows their number, not their bytes.
TASK_BUILDINGS = 1 << 13


def grid_axis(max_shift: int = 40, step: int = 2) -> list[int]:
    if not 0 <= max_shift <= 50 or max_shift % 2:
        raise ValueError("max_shift is even and between 0 and 50")
    axis = list(range(-max_shift, max_shift + 1, step))
    if len(axis) > 63:
        raise ValueError("a row of the grid has more shifts than a long has bits")
    return axis


def ranked_shifts(axis: list[int]) -> list[tuple[int, int]]:
    """Places (in x and in y) of the shifts of a square grid inside its disc: by distance, then by centre."""
    inside = [(x * x + y * y, x, y, i, k) for i, x in enumerate(axis) for k, y in enumerate(axis) if x * x + y * y <= axis[-1] ** 2]
    return [(i, k) for _, _, _, i, k in sorted(inside)]


def sloping_edges(poly: Column) -> Column:
    """Edges of a closed outline that a horizontal line can cross, as ``ARRAY<STRUCT<ax, ay, bx, by>>``; those without a coordinate are none."""
    flat = F.transform(G.polygon_edges(poly), lambda e: F.struct(e["a"]["x"].alias("ax"), e["a"]["y"].alias("ay"), e["b"]["x"].alias("bx"), e["b"]["y"].alias("by")))
    return F.filter(flat, lambda e: (e["ay"] != e["by"]) & e["ax"].isNotNull() & e["bx"].isNotNull())


def shift_finder(axis: list[int], step: int, kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map over Arrow batches of buildings: the columns ``kept`` and ``allowed``, the codes of all allowed shifts by rank.

    For each corner, outline and row of the grid a long has the shifts of that row as
    bits. An edge that the scan line crosses holds the shifts left of the crossing, which
    are the first bits; even-odd, the shifts inside are the exclusive or of those runs.
    The division finds the end of a run up to one place, the comparison of the point test
    settles it. The scan lines of all corners and outlines of a building are intersected,
    and the bits are taken in the order of ranks. A point test is as in SQL: NaN is above all numbers.
    """
    n, first, tested, held = len(axis), axis[0], WRITTEN_OUT, HELD_BUILDINGS
    ranked = ranked_shifts(axis)
    codes = np.array([k << 6 | i for i, k in ranked], dtype=np.int16)
    bits = np.array([k * 64 + i for i, k in ranked])
    moves = np.array(axis, dtype=np.float64)
    prefix = np.array([(1 << k) - 1 for k in range(n + 1)], dtype=np.int64)

    def crossings(edges: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """First bits by edge, corner and row; ``x`` and ``y`` are the corners by edge.

        Where an edge is beside all places of a corner, its runs are none or whole
        and no crossing is worked out. Comparisons with NaN leave that to the others.
        """
        ax, ay, bx, by = (v[:, None] for v in edges)
        # rounding moves a crossing out of its edge by less; NaN where a product overflows
        slack = 1e-9 * (np.abs(ax) + np.abs(bx)) + 0 * ((bx - ax) * (by - ay))
        low, high, top, bottom = np.minimum(ay, by), np.maximum(ay, by), y + moves[-1], y + moves[0]
        none = (high <= bottom) | (low > top) | (np.maximum(ax, bx) + slack < x + moves[0])
        whole = (low <= bottom) & (high > top) & (np.minimum(ax, bx) - slack > x + moves[-1])
        out = np.zeros((*x.shape, n), dtype=np.int64)
        out[whole] = prefix[n]
        rest = ~(none | whole)
        edge = np.nonzero(rest)[0]
        if len(edge):
            out[rest] = runs(tuple(v[edge] for v in edges), x[rest], y[rest])
        return out

    def runs(edges: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """First bits by pair of edge and corner, and row."""
        ax, ay, bx, by = edges
        rows = y[:, None] + moves
        above = lambda v: (v[:, None] > rows) | (np.isnan(v)[:, None] & ~np.isnan(rows))
        crossed = above(ay) != above(by)
        each = lambda v: np.repeat(v, crossed.sum(axis=1))
        start, x = each(ax), each(x)
        at = each(bx - ax) * (rows[crossed] - each(ay)) / each(by - ay) + start
        end = np.minimum(np.fmax(np.ceil((at - x - first) / step), 0), n)
        less = lambda k: x + (first + step * k) < at
        end += less(end) & (end < n)
        end -= ~less(end - 1) & (end > 0)
        # no crossing to divide, or steps near the rounding of the place itself: all places are compared
        odd = np.isnan(at) | (np.abs(x) > 1e12)
        if odd.any():
            at, x = at[odd], x[odd]
            end[odd] = np.where(np.isnan(at) & ~np.isnan(x), n, (x[:, None] + moves < at[:, None]).sum(axis=1))
        out = np.zeros(rows.shape, dtype=np.int64)
        out[crossed] = prefix[end.astype(np.intp)]
        return out

    def masks(outlines: np.ndarray, ends: np.ndarray, edges: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Long by building and row; ``outlines`` and ``ends`` are offsets of outlines and edges, from those of the first building."""
        inside = np.zeros((outlines[-1], x.shape[1], n), dtype=np.int64)
        owner = np.repeat(np.arange(outlines[-1]), np.diff(ends))
        building = np.repeat(np.arange(len(x)), np.diff(outlines))
        for k in range(0, len(owner), tested):
            own = owner[k : k + tested]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            of = building[own]
            found = crossings(tuple(v[k : k + tested] for v in edges), x[of], y[of])
            inside[own[starts]] ^= np.bitwise_xor.reduceat(found, starts, axis=0)
        lines = np.bitwise_and.reduce(inside, axis=1)
        out = np.zeros((len(x), n), dtype=np.int64)
        some = np.flatnonzero(np.diff(outlines))
        if len(some):
            out[some] = np.bitwise_and.reduceat(lines, outlines[some], axis=0)
        return out

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        outlines, corners = batch.column("outlines"), batch.column("corners")
        rings = outlines.flatten()
        flat, points = rings.flatten(), corners.flatten()
        coordinate = lambda of, c: of.field(c).to_numpy(zero_copy_only=False)
        offsets = lambda lists: np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        x, y = (coordinate(points, c).astype(np.float64).reshape(batch.num_rows, -1) for c in "xy")
        with np.errstate(invalid="ignore", over="ignore"):
            found = masks(offsets(outlines), offsets(rings), tuple(coordinate(flat, c) for c in ("ax", "ay", "bx", "by")), x, y)
        allowed = np.unpackbits(found.astype("<i8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")[:, bits].astype(bool)
        ends = np.concatenate(([0], np.cumsum(allowed.sum(axis=1)))).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.broadcast_to(codes, allowed.shape)[allowed]))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), listed], names=[*kept, "allowed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, held):
                yield find(batch.slice(k, held))

    return run


def row_masks(base: DataFrame, axis: list[int], step: int) -> DataFrame:
    """``no, plan_id, id, cx, cy, allowed``: codes of the grid shifts that keep all ``corners`` inside all ``outlines``, by rank.

    Buildings have their scan lines intersected row by row of the grid, see
    :func:`shift_finder`; all have the same number of corners. They are dealt out by
    number, and by a number of them to a task: parts of even bytes would leave most
    of the work to few tasks, as equal outlines take few bytes in files.
    """
    kept = ["no", "plan_id", "id", "cx", "cy"]
    found = base.count()
    dealt = base.repartition(-(-found // TASK_BUILDINGS) or 1, "no").select(*kept, "outlines", "corners")
    bounded_batches(base.sparkSession)
    schema = T.StructType([*(dealt.schema[c] for c in kept), T.StructField("allowed", T.ArrayType(T.ShortType(), False))])
    return dealt.mapInArrow(shift_finder(axis, step, kept), schema)


def feasible_centers(
    buildings: DataFrame, zones: DataFrame, boundaries: DataFrame, max_shift: int = 40, step: int = 2
) -> DataFrame:
    """``plan_id, id, rank, distance`` (squared), ``ox, oy`` (the centre): every grid shift inside the disc
    that keeps all four corners in zone and boundary, ranked by distance, then centre.

    Edges are made once an outline; a building meets its zone and boundary in a join and gets its allowed shifts
    by :func:`row_masks`, many buildings at a time. They come in the order of all shifts, so that ranks are their
    places and no sort follows. They become rows in the JVM.
    """
    axis = grid_axis(max_shift, step)
    edged = lambda df, *keys: df.filter(F.size("poly") > 2).select(*keys, sloping_edges(F.col("poly")).alias("_edges"))
    base = G.with_rect_corners(buildings.select("plan_id", "id", "cx", "cy", "w", "d", "clock", "zone_id"))
    base = base.join(edged(zones, "plan_id", "zone_id").withColumnRenamed("_edges", "_zone"), ["plan_id", "zone_id"])
    base = base.join(edged(boundaries, "plan_id").withColumnRenamed("_edges", "_edge"), "plan_id")
    outlines, corners = F.array("_zone", "_edge").alias("outlines"), G.polygon_of(G.quad("c")).alias("corners")
    base = cut(base.select("plan_id", "id", "cx", "cy", outlines, corners)).withColumn("no", F.monotonically_increasing_id())
    shifts = row_masks(base, axis, step).select("plan_id", "id", "cx", "cy", F.posexplode("allowed").alias("pos", "code"))
    by = lambda place: (F.lit(axis[0]) + F.lit(step) * place).cast("double")
    code = F.col("code").cast("int")
    dx, dy = by(code.bitwiseAND(63)), by(F.shiftright(code, 6))
    return shifts.select(
        "plan_id", "id", (F.col("pos") + 1).alias("rank"), (dx * dx + dy * dy).alias("distance"), (F.col("cx") + dx).alias("ox"), (F.col("cy") + dy).alias("oy")
    )
