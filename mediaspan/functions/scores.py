"""Frame quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def lighting(mean: Column, std: Column, low: float = 35.0, high: float = 225.0) -> Column:
    """0 outside the luminance window, else 0.7 for a centred mean and 0.3 for contrast."""
    x = (mean - low) / (high - low)
    return F.when((mean < low) | (mean > high), 0.0).otherwise(clip(0.7 * (1 - 2 * F.abs(x - 0.5)) + 0.3 * F.least(std / 80, F.lit(1.0))))


def sharpness(variance: Column, least: float = 80.0) -> Column:
    return clip((variance - least) / (2 * least))


def rejections(blurry: Column, closed: Column, no_face: Column, dark: Column, over: Column) -> Column:
    """Reasons, in a fixed order."""
    named = {"BLURRY": blurry, "CLOSED_EYES": closed, "NO_FACE_DETECTED": no_face, "DARK": dark, "OVEREXPOSED": over}
    return F.array_compact(F.array(*[F.when(c, k) for k, c in named.items()]))


def composite(variance: Column, expression: Column, light: Column, face: Column, confidence: Column, area: Column, least: float = 80.0, weights: tuple[float, float, float, float] = (0.35, 0.35, 0.15, 0.15)) -> Column:
    """Weighted mean of sharpness, expression, light and, where there is a face, its prominence (confidence times twice its area)."""
    total = sharpness(variance, least) * weights[0] + expression * weights[1] + light * weights[2]
    three = sum(weights[:3])
    seen = F.coalesce(face & area.isNotNull(), F.lit(False))
    with_face = (total + clip(confidence * area * 2.0) * weights[3]) / (three + weights[3])
    return clip(F.when(seen, with_face).otherwise(total / three))


def luminance_stats(value: Column) -> tuple[Column, Column]:
    """Aggregates over pixels: mean and population deviation."""
    return F.avg(value), F.stddev_pop(value)
