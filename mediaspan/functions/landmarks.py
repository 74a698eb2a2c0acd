"""Face measures from landmarks: a map from a point's number to its (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspan.functions.scores import clip

# Numbers of the 68-point scheme; pairs across an eye or the mouth, and the pair along it.
LEFT_EYE = (((37, 41), (38, 40)), (36, 39))
RIGHT_EYE = (((43, 47), (44, 46)), (42, 45))
MOUTH = (((51, 57),), (48, 54))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def aspect(points: Column, across: tuple[tuple[int, int], ...], along: tuple[int, int]) -> Column:
    """Mean distance across over the distance along; 0 if a point is missing or the latter is 0."""
    length = lambda pair: distance(*[F.try_element_at(points, F.lit(k)) for k in pair])
    total = sum((length(p) for p in across[1:]), length(across[0]))
    ratio = total / (len(across) * F.nullif(length(along), F.lit(0.0)))
    return F.coalesce(F.nanvl(ratio, F.lit(0.0)), F.lit(0.0))


def bounding_box(points: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """(x, y, width, height) around the points that are numbers, as shares of the frame (sizes of 0 or less and none at all: as they are), clamped to 0..1."""

    def side(name: str, whole: Column | None) -> tuple[Column, Column]:
        seen = F.filter(F.transform(F.map_values(points), lambda p: p[name]), lambda v: v.isNotNull() & ~F.isnan(v))
        scale = F.lit(1.0) if whole is None else F.when(whole > 0, whole.cast("double")).otherwise(1.0)
        return clip(F.array_min(seen) / scale), clip(F.array_max(seen) / scale)

    (x0, x1), (y0, y1) = side("x", width), side("y", height)
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))


def measures(points: Column, width: Column | None = None, height: Column | None = None, closed: float = 0.12, opened: float = 0.35, least_open: float = 0.25, rest: float = 0.15, wide: float = 0.45) -> Column:
    """(detected, eye_openness, eyes_closed, mouth_articulation, expression_intensity, box) of a face; without points only ``detected`` is set.

    The narrower eye counts. Expression is 0.65 mouth and 0.35 eyes.
    """
    eyes = clip((F.least(aspect(points, *LEFT_EYE), aspect(points, *RIGHT_EYE)) - closed) / (opened - closed))
    mouth = clip((aspect(points, *MOUTH) - rest) / (wide - rest))
    found = F.coalesce(F.size(points) > 0, F.lit(False))
    named = {"eye_openness": eyes, "eyes_closed": eyes < least_open, "mouth_articulation": mouth, "expression_intensity": clip(0.65 * mouth + 0.35 * eyes), "box": bounding_box(points, width, height)}
    return F.struct(found.alias("detected"), *[F.when(found, c).alias(k) for k, c in named.items()])
