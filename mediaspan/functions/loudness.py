"""Loudness measurements found in logs, their compliance and the filter text of a second pass."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELDS = ("input_i", "input_tp", "input_lra", "input_thresh", "target_offset")
_BROKEN = "_broken"


def json_block(log: Column, key: str = "input_i") -> Column:
    """The JSON object of a log that holds the last ``"key"``, objects within it one deep; null if there is none or it has no end."""
    # the log is named once, as a filter on the result makes it anew for each place where it is named: the last "{" with a key before the next one, its last key, the rest of the object
    mark = rf'"\Q{key}\E"'
    block = rf'(?s)^(?>.*(?=\{{[^{{]*?{mark}))(\{{(?>[^{{]*{mark})(?:[^{{}}"]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"|\{{[^{{}}]*+\}})*+\}})'
    return F.nullif(F.regexp_extract(log, block, 1), F.lit(""))


def stats(block: Column) -> Column:
    """The five measurements (target_offset 0 if missing) and ``error``: ``missing`` for a field that is absent or no number, ``short`` for one without bounds (audio too short to measure), null for none."""
    # one parse for all fields: a broken text is told by its own field, for with options the optimizer doesn't parse once for each field
    got = F.from_json(block, ", ".join(f"{f} string" for f in (*_FIELDS, _BROKEN)), {"columnNameOfCorruptRecord": _BROKEN})
    whole = got[_BROKEN].isNull()
    raw = {f: got[f] for f in _FIELDS}
    raw["target_offset"] = F.coalesce(raw["target_offset"], F.lit("0.0"))
    value = {f: c.try_cast("double") for f, c in raw.items()}
    any_of = lambda test: F.array_max(F.array(*[test(v) for v in value.values()]))
    endless = lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == math.inf), F.lit(False))
    error = F.when(any_of(lambda v: v.isNull()) | ~whole, "missing").when(any_of(endless), "short")
    broken = {f: F.lit(0.0 if f == "target_offset" else None) for f in _FIELDS}
    return F.struct(*[F.when(whole, v).otherwise(broken[f]).alias(f) for f, v in value.items()], error.alias("error"))


def compliant(measured_i: Column, measured_tp: Column, target_i: float = -14.0, target_tp: float = -1.0, tolerance: float = 0.5, slack: float = 0.05) -> Column:
    return (F.abs(measured_i - target_i) <= tolerance) & (measured_tp <= target_tp + slack)


def second_pass(s: Column, target_i: float = -14.0, target_tp: float = -1.0, target_lra: float = 11.0, headroom: float = 0.3) -> Column:
    """Filter text with the measurements to two decimals and a limiter below the lowered peak."""
    peak = target_tp - headroom
    shape = f"loudnorm=I={target_i}:TP={peak}:LRA={target_lra}:measured_I=%.2f:measured_TP=%.2f:measured_LRA=%.2f:measured_thresh=%.2f:offset=%.2f:linear=true"
    limit = f",alimiter=level_in=1.0:level_out=1.0:limit={10 ** (peak / 20.0)}:attack=5:release=50:level=disabled:asc=true"
    return F.concat(F.format_string(shape, *[F.bround(s[f], 2) for f in _FIELDS]), F.lit(limit))
