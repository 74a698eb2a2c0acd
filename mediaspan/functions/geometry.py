"""Frame geometry, time grids and windows, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_even(c: Column) -> Column:
    """Rounded (half to even), then down to an even number, at least 0."""
    return F.greatest(F.lit(0).cast("bigint"), (F.floor(F.rint(c) / 2) * 2).cast("bigint"))


def is_vertical(width: Column, height: Column, target: tuple[int, int] = (1080, 1920)) -> Column:
    """At most a tenth wider than the target's proportion; no for sizes of 0 or less."""
    return F.coalesce((width > 0) & (height > 0) & (width / F.nullif(height, F.lit(0)) <= target[0] / target[1] * 1.1), F.lit(False))


def smart_crop(width: Column, height: Column, target: tuple[int, int] = (1080, 1920)) -> Column:
    """The largest crop of the target's proportion, as (width, height)."""
    aspect = target[0] / target[1]
    wide = width / height >= aspect
    return F.struct(F.when(wide, to_even(height * aspect)).otherwise(width).alias("width"), F.when(wide, height).otherwise(to_even(width / aspect)).alias("height"))


def zoom_crop(width: Column, height: Column, scale: Column, anchor_x: Column, anchor_y: Column) -> Column:
    """Even crop of 1/scale about the anchor, moved into the frame, as (width, height, x, y)."""
    down = lambda c: F.rint(c).cast("bigint") - F.pmod(F.rint(c).cast("bigint"), F.lit(2))
    w, h = down(width / scale), down(height / scale)
    inside = lambda side, crop, at: F.greatest(F.lit(0.0), F.least((side - crop).cast("double"), at * side - crop / 2))
    return F.struct(w.alias("width"), h.alias("height"), down(inside(width, w, anchor_x)).alias("x"), down(inside(height, h, anchor_y)).alias("y"))


def clamp_window(start: Column, end: Column, total: Column) -> Column:
    """(start_ms, end_ms) within 0..total; a missing side is the total's; null for an empty window."""
    a, b = F.greatest(F.lit(0), F.coalesce(start, F.lit(0))), F.least(total, F.coalesce(end, total))
    return F.when((b > a) & (a < total), F.struct(a.alias("start_ms"), b.alias("end_ms")))


def uniform_times(total: Column, step: int, head: int, tail: int, least: int = 3) -> Column:
    """Evenly spaced times between the offsets (a tenth of the total each, if they leave nothing), ``least`` at least, below the total, each once; empty for a total of 0 or less."""
    tenth = F.rint(total * 0.10).cast("bigint")
    tight = F.lit(head + tail) >= total
    a, b = F.when(tight, tenth).otherwise(F.lit(head)), total - F.when(tight, tenth).otherwise(F.lit(tail))
    top = F.greatest(F.lit(0), total - 1)
    empty = b - a <= 0
    a, b = F.when(empty, F.least(a, top)).otherwise(a), F.when(empty, total).otherwise(b)
    count = F.greatest(F.rint((b - a) / step).cast("bigint") + 1, F.lit(least))
    gap = (b - a) / F.greatest(count - 1, F.lit(1))
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda k: F.rint(F.least(F.greatest(k * gap + a, F.lit(0.0)), top.cast("double"))).cast("bigint"))
    return F.when((total > 0) & F.lit(step > 0), F.array_distinct(at)).otherwise(F.array().cast("array<bigint>"))


def sample_times(start: Column, end: Column, step: int) -> Column:
    """Every ``step`` ms from the start to before the end, the start at least."""
    return F.when(end > start, F.sequence(start, end - 1, F.lit(step).cast("bigint"))).otherwise(F.array(start))


def sample_span(start_ms: Column, end_ms: Column, rate: int, total: Column) -> Column:
    """(first, end) in samples within 0..total, rounded half to even; null if empty."""
    at = lambda c: F.least(F.greatest(F.rint(c * rate / 1000).cast("bigint"), F.lit(0)), total)
    return F.when(at(end_ms) > at(start_ms), F.struct(at(start_ms).alias("first"), at(end_ms).alias("end")))
