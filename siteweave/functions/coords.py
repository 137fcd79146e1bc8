"""Coordinate maps between crop-1000, source-1000 and source pixels.

``crop`` is a 4-tuple of columns in source pixels, ``size`` the image (w, h).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import dlit


def to_source(p, crop, size, digits: int | None = 3) -> tuple[Column, Column]:
    """Crop-1000 point to source-1000."""
    x = (crop[0] + p[0] * (crop[2] - crop[0]) / 1000) / size[0] * 1000
    y = (crop[1] + p[1] * (crop[3] - crop[1]) / 1000) / size[1] * 1000
    return (x, y) if digits is None else (F.round(x, digits), F.round(y, digits))


def to_crop(p, crop, size, clamp: bool = False, digits: int | None = 3) -> tuple[Column, Column]:
    """Source-1000 point to crop-1000, optionally held inside the frame."""
    x = (p[0] * size[0] / 1000 - crop[0]) * 1000 / (crop[2] - crop[0])
    y = (p[1] * size[1] / 1000 - crop[1]) * 1000 / (crop[3] - crop[1])
    if digits is not None:
        x, y = F.round(x, digits), F.round(y, digits)
    if clamp:
        x = F.greatest(dlit(0), F.least(dlit(1000), x))
        y = F.greatest(dlit(0), F.least(dlit(1000), y))
    return x, y


def to_pixels(box, crop) -> tuple[Column, ...]:
    """Crop-1000 box to source pixels."""
    w, h = crop[2] - crop[0], crop[3] - crop[1]
    return (
        crop[0] + box[0] * w / 1000,
        crop[1] + box[1] * h / 1000,
        crop[0] + box[2] * w / 1000,
        crop[1] + box[3] * h / 1000,
    )


def remap(box, old, new) -> tuple[Column, ...]:
    """Box given in one crop's frame, expressed in another crop's frame."""
    px = to_pixels(box, old)
    w, h = new[2] - new[0], new[3] - new[1]
    return (
        (px[0] - new[0]) * 1000 / w,
        (px[1] - new[1]) * 1000 / h,
        (px[2] - new[0]) * 1000 / w,
        (px[3] - new[1]) * 1000 / h,
    )


def expanded_crop(crop, size, side: float = 0.12, top: float = 0.15, bottom: float = 0.45) -> tuple[Column, ...]:
    """Wider crop with more room below, whole pixels, inside the image."""
    w, h = crop[2] - crop[0], crop[3] - crop[1]
    return (
        F.greatest(dlit(0), F.bround(crop[0] - w * side)),
        F.greatest(dlit(0), F.bround(crop[1] - h * top)),
        F.least(size[0], F.bround(crop[2] + w * side)),
        F.least(size[1], F.bround(crop[3] + h * bottom)),
    )


def padded_crop(
    box,
    size,
    pad: tuple[float, float],
    share: tuple[float, float],
    scale: float | None = 1000,
    clamp_first: bool = False,
    low: str = "floor",
    high: str = "floor",
) -> tuple[Column, ...]:
    """Pixel crop around a box: pad by max(pad, share·extent), then clamp and snap.

    ``scale`` is 1000 for normalised boxes and None for boxes already in pixels.
    """
    snap = {"floor": F.floor, "ceil": F.ceil, "round": F.bround}
    px = F.greatest(dlit(pad[0]), (box[2] - box[0]) * share[0])
    py = F.greatest(dlit(pad[1]), (box[3] - box[1]) * share[1])
    lo = [box[0] - px, box[1] - py]
    hi = [box[2] + px, box[3] + py]
    if clamp_first:
        edge = [dlit(scale), dlit(scale)] if scale else size
        lo = [F.greatest(dlit(0), v) for v in lo]
        hi = [F.least(edge[i], v) for i, v in enumerate(hi)]
    if scale:
        lo = [v * size[i] / scale for i, v in enumerate(lo)]
        hi = [v * size[i] / scale for i, v in enumerate(hi)]
    lo = [F.greatest(dlit(0), snap[low](v).cast("double")) for v in lo]
    hi = [F.least(size[i], snap[high](v).cast("double")) for i, v in enumerate(hi)]
    return lo[0], lo[1], hi[0], hi[1]
