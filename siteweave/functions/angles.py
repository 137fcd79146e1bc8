"""Clock and angle scalars. Facing of a plan is a clock hour; top-view angles run clockwise from right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import dlit

CONFIDENCE_WORDS = {"high": 0.9, "medium": 0.6, "low": 0.3}


def wrap360(a: Column) -> Column:
    return F.pmod(a, dlit(360))


def circular_difference(a: Column, b: Column) -> Column:
    """Unsigned difference in degrees, 0–180."""
    return F.abs(F.pmod(a - b + 180, dlit(360)) - 180)


def parse_clock(text: Column) -> Column:
    """``h``, ``h:00`` or ``h:30`` to an hour in (0, 12.5]; null for anything else."""
    shape = r"^\s*(\d{1,2})(?::(00|30))?\s*$"
    hour = F.pmod(F.regexp_extract(text, shape, 1).try_cast("int"), F.lit(12))
    hour = F.when(hour == 0, 12).otherwise(hour).cast("double")
    half = F.when(F.regexp_extract(text, shape, 2) == "30", dlit(0.5)).otherwise(dlit(0))
    return F.when(text.rlike(shape), hour + half)


def clock_label(hour: Column) -> Column:
    whole = F.floor(hour).cast("int")
    minute = F.when(F.abs(hour - whole - 0.5) < 1e-6, 30).otherwise(0)
    return F.format_string("%d:%02d", whole, minute)


def clock_of_angle(angle: Column) -> Column:
    """Half-hour clock of a top-view angle, in (0.5, 12.5]."""
    snapped = F.pmod(F.bround(wrap360(angle) / 15) * 15, dlit(360))
    hour = F.pmod(dlit(3) + snapped / 30, dlit(12))
    return F.when(hour <= 0.5, hour + 12).otherwise(hour)


def yaw_of_angle(angle: Column) -> Column:
    """World yaw (+y far) of a clockwise top-view angle, in (−180, 180]."""
    yaw = F.pmod(-angle, dlit(360))
    return F.round(F.when(yaw > 180, yaw - 360).otherwise(yaw), 3)


def confidence(text: Column, default: float = 0.5) -> Column:
    """Words or numbers to [0, 1]; null takes the default, other text is null."""
    word = F.lower(F.trim(text))
    value = F.when(text.isNull(), dlit(default))
    for name, number in CONFIDENCE_WORDS.items():
        value = value.when(word == name, dlit(number))
    number = text.try_cast("double")
    return value.when(number.isNotNull(), F.greatest(dlit(0), F.least(dlit(1), number)))


def optional_pair(a, b, minimum: float = 3.0) -> Column:
    """Two held points as a struct, null where missing or nearly coincident."""
    held = [F.greatest(dlit(0), F.least(dlit(1000), v)) for v in (*a, *b)]
    apart = F.hypot(held[2] - held[0], held[3] - held[1]) >= minimum
    return F.when(apart, F.struct(*[h.alias(n) for h, n in zip(held, ("x0", "y0", "x1", "y1"))]))
