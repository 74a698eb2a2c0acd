"""Sampled audio as blocks: low-pass and resampling, splicing with fades, looping by overlap-add.

A block is a row: media_id, channel, rate (samples a second), n (samples of the channel), block and samples (array of doubles; all blocks but the last have
the same length). Every operation cuts blocks into pieces for the blocks that need them, exchanges the pieces and builds the new blocks, so that no task holds a channel as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediaspan.operators.intervals import merge_strict

BLOCK = 1 << 16
#: Samples in a batch of pieces; copies of a loop that one row makes.
BATCH, COPIES = 1 << 20, 64
#: The cut-off as a share of the target rate, where the filter's slope ends, and the shortest signal that is filtered.
CUTOFF, SLOPE, SHORTEST = 0.45, 1.3, 64
CHANNEL = ["media_id", "channel", "rate", "n"]


def to_blocks(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of ``samples`` (media_id, channel, rate, pos, value); positions from 0 without gaps, or it is an error. Null values are 0."""
    own = Window.partitionBy("media_id", "channel")
    rows = samples.groupBy("media_id", "channel", "rate", F.floor(F.col("pos") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")))).alias("s"))
    rows = rows.withColumn("n", F.sum(F.size("s").cast("long")).over(own))
    length = F.least(F.lit(block), F.col("n") - F.col("block") * block)
    whole = (F.size("s") == length) & (F.col("s")[0]["pos"] == F.col("block") * block) & (F.element_at("s", -1)["pos"] == F.col("block") * block + length - 1)
    checked = F.when(whole & (F.col("rate") > 0), F.col("s")["value"]).otherwise(F.raise_error(F.lit("positions must run from 0 without gaps, rates must be positive")))
    return rows.select(*CHANNEL, "block", checked.alias("samples"))


def to_samples(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """media_id, channel, pos, value."""
    rows = blocks.select("media_id", "channel", "block", F.posexplode("samples").alias("i", "value"))
    return rows.select("media_id", "channel", (F.col("block") * block + F.col("i")).alias("pos"), "value")


def _exchange(rows: DataFrame, carried: list[str], cut: Callable, build: Callable) -> DataFrame:
    """Rows of ``carried``, block, samples: ``cut(info, block, samples)`` yields (new block, at, values), ``build(info, block, pieces)`` makes the new block's samples of its (at, values).

    ``info`` holds the carried values; columns whose name begins with ``_`` are for ``cut`` only.
    """
    kept = [c for c in carried if not c.startswith("_")]
    first = StructType([*(rows.schema[c] for c in kept), *StructType.fromDDL("block long, at long, samples array<double>").fields])
    values = pa.list_(pa.float64())

    def cutting(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            kinds = [batch.schema.field(c).type for c in kept]
            out: list[list] = [[] for _ in range(len(kept) + 3)]
            held = 0
            samples = batch.column("samples")
            for k, info in enumerate(batch.select([*carried, "block"]).to_pylist()):
                for piece in cut(info, info["block"], samples[k].values.to_numpy(zero_copy_only=False)):
                    for column, v in zip(out, (*(info[c] for c in kept), *piece)):
                        column.append(v)
                    held += len(piece[2])
                    if held > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, [*kinds, pa.int64(), pa.int64(), values])], [*kept, "block", "at", "samples"])
                        out, held = [[] for _ in out], 0
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, [*kinds, pa.int64(), pa.int64(), values])], [*kept, "block", "at", "samples"])

    def building(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            pieces = batch.column("pieces")
            made = []
            for k, info in enumerate(batch.select([*kept, "block"]).to_pylist()):
                own = pieces[k].values
                at, lists = own.field(0).to_pylist(), own.field(1)
                made.append(build(info, info["block"], [(a, lists[i].values.to_numpy(zero_copy_only=False)) for i, a in enumerate(at)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*kept, "block"]), pa.array(made, values)], [*kept, "block", "samples"])

    grouped = rows.select(*carried, "block", "samples").mapInArrow(cutting, first).groupBy(*kept, "block").agg(F.collect_list(F.struct("at", "samples")).alias("pieces"))
    return grouped.mapInArrow(building, StructType([f for f in first.fields if f.name != "at"]))


class _Transform:
    """The Fourier transform of a channel as a matrix: sample ``width * i + j`` is in row i, column j; columns are transformed, turned, then rows."""

    def __init__(self, n: int, block: int) -> None:
        self.size = 1 << (n - 1).bit_length()
        bits = self.size.bit_length() - 1
        self.height, self.width = 1 << (bits + 1) // 2, 1 << bits // 2
        #: columns (rows) that one group holds, powers of two, too
        share = lambda other: 1 << max(1, block // other).bit_length() - 1
        self.columns, self.rows = min(self.width, share(self.height)), min(self.height, share(self.width))

    def inside(self, begin: int, end: int, group: int) -> np.ndarray:
        """Positions in ``begin`` .. ``end`` whose column is in the group."""
        at = np.arange(begin, end)
        return at[at % self.width // self.columns == group]

    def turn(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi * (np.outer(rows, columns) % self.size) / self.size)


def _flat(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix, complex).reshape(-1).view(float)


def _gains(size: int, cutoff: float, rate: int) -> Callable[[np.ndarray], np.ndarray]:
    """Gain of each frequency number: 1, a slope from the cut-off to SLOPE times it, 0."""
    half = size // 2
    start = int(np.round(cutoff / (rate / 2) * half))
    stop = min(int(np.round(cutoff * SLOPE / (rate / 2) * half)), half)
    if stop <= start:
        return lambda f: (f < start).astype(float)
    step = max(1, stop - start - 1)
    return lambda f: np.where(f < start, 1.0, np.where(f < stop, 1 - (f - start) / step, 0.0))


def low_pass(blocks: DataFrame, cutoff: float, block: int = BLOCK) -> DataFrame:
    """Blocks without the frequencies above ``cutoff`` Hz, as one transform of the whole channel (filled up with zeros to a power of two) would leave them.

    The transform is exact: columns, one exchange, rows; the filter; rows and columns back. Channels of fewer than SHORTEST samples stay.
    """
    plan = lambda info: _Transform(info["n"], block)
    length = lambda info, k: min(block, info["n"] - k * block)

    def to_columns(info: dict, k: int, x: np.ndarray) -> Iterator[tuple]:
        t = plan(info)
        for g in range(t.width // t.columns):
            at = t.inside(k * block, k * block + len(x), g)
            if len(at):
                yield g, k, x[at - k * block]

    def columns(info: dict, g: int, pieces: list) -> np.ndarray:
        t = plan(info)
        m = np.zeros((t.height, t.columns))
        for k, values in pieces:
            at = t.inside(k * block, k * block + length(info, k), g)
            m[at // t.width, at % t.width - g * t.columns] = values
        return _flat(np.fft.fft(m, axis=0) * t.turn(np.arange(t.height), g * t.columns + np.arange(t.columns)))

    def to_rows(info: dict, g: int, x: np.ndarray) -> Iterator[tuple]:
        t = plan(info)
        m = x.view(complex).reshape(t.height, t.columns)
        for r in range(t.height // t.rows):
            yield r, g, _flat(m[r * t.rows : (r + 1) * t.rows])

    def rows(info: dict, r: int, pieces: list) -> np.ndarray:
        t = plan(info)
        m = np.zeros((t.rows, t.width), complex)
        for g, values in pieces:
            m[:, g * t.columns : (g + 1) * t.columns] = values.view(complex).reshape(t.rows, t.columns)
        own = r * t.rows + np.arange(t.rows)
        f = own[:, None] + t.height * np.arange(t.width)
        m = np.fft.fft(m, axis=1) * _gains(t.size, cutoff, info["rate"])(np.minimum(f, t.size - f))
        return _flat(np.fft.ifft(m, axis=1) * t.turn(own, np.arange(t.width)).conj())

    def back_to_columns(info: dict, r: int, x: np.ndarray) -> Iterator[tuple]:
        t = plan(info)
        m = x.view(complex).reshape(t.rows, t.width)
        for g in range(t.width // t.columns):
            yield g, r, _flat(m[:, g * t.columns : (g + 1) * t.columns])

    def columns_back(info: dict, g: int, pieces: list) -> np.ndarray:
        t = plan(info)
        m = np.zeros((t.height, t.columns), complex)
        for r, values in pieces:
            m[r * t.rows : (r + 1) * t.rows] = values.view(complex).reshape(t.rows, t.columns)
        return np.fft.ifft(m, axis=0).real.reshape(-1)

    def to_place(info: dict, g: int, x: np.ndarray) -> Iterator[tuple]:
        t = plan(info)
        m = x.reshape(t.height, t.columns)
        for k in range(-(-info["n"] // block)):
            at = t.inside(k * block, k * block + length(info, k), g)
            if len(at):
                yield k, g, m[at // t.width, at % t.width - g * t.columns]

    def placed(info: dict, k: int, pieces: list) -> np.ndarray:
        t, out = plan(info), np.zeros(length(info, k))
        for g, values in pieces:
            out[t.inside(k * block, k * block + len(out), g) - k * block] = values
        return out

    long = blocks.where(F.col("n") >= SHORTEST)
    for cut, build in ((to_columns, columns), (to_rows, rows), (back_to_columns, columns_back), (to_place, placed)):
        long = _exchange(long, CHANNEL, cut, build)
    return blocks.where(F.col("n") < SHORTEST).select(*CHANNEL, "block", "samples").unionByName(long.select(*CHANNEL, "block", "samples"))


def resample(blocks: DataFrame, target: int, block: int = BLOCK, filtered: bool = True) -> DataFrame:
    """Blocks at ``target`` samples a second: linear interpolation, after a low-pass where the rate falls (unless not ``filtered``). The last sample is held past the end."""
    same, other = blocks.where(F.col("rate") == target), blocks.where(F.col("rate") != target)
    if filtered:
        falling = F.col("rate") > target
        other = other.where(~falling).select(*CHANNEL, "block", "samples").unionByName(low_pass(other.where(falling), target * CUTOFF, block))
    rows = other.withColumn("m", F.greatest(F.lit(1), F.rint(F.col("n") * target / F.col("rate"))).cast("long"))

    def cut(info: dict, k: int, x: np.ndarray) -> Iterator[tuple]:
        n, m, begin = info["n"], info["m"], k * block
        end = begin + len(x)
        last = m - 1 if end == n else (end * m - 1) // n
        for d in range(max(0, -(-(begin - 1) * m // n)) // block, last // block + 1):
            low, high = d * block * n // m, min((min(m, d * block + block) - 1) * n // m + 1, n - 1) + 1
            low, high = max(low, begin), min(high, end)
            if low < high:
                yield d, low, x[low - begin : high - begin]

    def build(info: dict, d: int, pieces: list) -> np.ndarray:
        n, m = info["n"], info["m"]
        j = np.arange(d * block, min(m, d * block + block))
        left = j * n // m
        x = np.zeros(left[-1] + 2 - left[0])
        for at, values in pieces:
            x[at - left[0] : at - left[0] + len(values)] = values
        right = np.minimum(left + 1, n - 1) - left[0]
        return x[left - left[0]] + (x[right] - x[left - left[0]]) * (j * n % m / m)

    made = _exchange(rows, [*CHANNEL, "m"], cut, build).select("media_id", "channel", F.lit(target).alias("rate"), F.col("m").alias("n"), "block", "samples")
    return same.select("media_id", "channel", F.lit(target).alias("rate"), "n", "block", "samples").unionByName(made)


def fade_gain(length: int, curve: str = "equal_power", out: bool = False) -> np.ndarray:
    """Gains of a fade of ``length`` samples; curve: equal_power (quarter of a sine) or linear. A fade of one sample is silence."""
    if length == 1:
        return np.zeros(1)
    t = np.linspace(0.0, 1.0, length)
    if curve == "linear":
        return 1 - t if out else t
    return np.cos(np.pi / 2 * t) if out else np.sin(np.pi / 2 * t)


def _items(blocks: DataFrame) -> DataFrame:
    """media_id, rate, n of items; their channels have equal length."""
    return blocks.where("block = 0").groupBy("media_id").agg(F.max("rate").alias("rate"), F.max("n").alias("n"))


def splice_spans(items: DataFrame, segments: DataFrame, crossfade_ms: float = 15.0) -> DataFrame:
    """Pieces that a splice keeps: media_id, span, spans, start, end (samples), offset (in the output), fade, total.

    ``segments`` (media_id, start_ms, end_ms) are merged where they overlap (touching ones stay apart), rounded half to even to samples of ``items`` (media_id, rate, n) and kept
    within them; empty ones go. A fade is no longer than half its piece.
    """
    at = lambda c: F.greatest(F.lit(0), F.least(F.col("n"), F.rint(F.col(c) * F.col("rate") / 1000.0).cast("long")))
    rows = merge_strict(segments).join(items, "media_id").select("media_id", "rate", at("start_ms").alias("start"), at("end_ms").alias("end")).where("end > start")
    size, own = F.col("end") - F.col("start"), Window.partitionBy("media_id")
    before = own.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fade_ms = F.least(F.lit(float(crossfade_ms)), 1000.0 * size / F.col("rate") / 2)
    fade = F.least(F.rint(fade_ms * F.col("rate") / 1000.0).cast("long"), F.floor(size / 2))
    return rows.select(
        "media_id",
        (F.row_number().over(own.orderBy("start", "end")) - 1).alias("span"),
        F.count("*").over(own).alias("spans"),
        "start",
        "end",
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias("offset"),
        fade.alias("fade"),
        F.sum(size).over(own).alias("total"),
    )


def splice(blocks: DataFrame, segments: DataFrame, crossfade_ms: float = 15.0, curve: str = "equal_power", block: int = BLOCK) -> DataFrame:
    """Blocks of the segments one after another, each faded in but for the first and faded out but for the last; nothing overlaps. Items without a piece give no rows (see ``splice_errors``)."""
    spans = splice_spans(_items(blocks), segments, crossfade_ms)
    met = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    met = met.groupBy("media_id", "block", "total").agg(F.collect_list(F.struct("span", "spans", "start", "end", "offset", "fade")).alias("_spans"))

    def cut(info: dict, k: int, x: np.ndarray) -> Iterator[tuple]:
        begin = k * block
        for s in info["_spans"]:
            low, high = max(begin, s["start"]), min(begin + len(x), s["end"])
            values, fade = x[low - begin : high - begin].copy(), s["fade"]
            at = np.arange(low, high)
            if fade > 0 and s["span"] > 0:
                head = at < s["start"] + fade
                values[head] *= fade_gain(fade, curve)[at[head] - s["start"]]
            if fade > 0 and s["span"] < s["spans"] - 1:
                tail = at >= s["end"] - fade
                values[tail] *= fade_gain(fade, curve, True)[at[tail] - s["end"] + fade]
            yield from _dealt(s["offset"] + low - s["start"], values, block)

    rows = blocks.join(met, ["media_id", "block"])
    made = _exchange(rows, ["media_id", "channel", "rate", "total", "_spans"], cut, lambda info, d, pieces: _added(info["total"], d, pieces, block))
    return made.select("media_id", "channel", "rate", F.col("total").alias("n"), "block", "samples")


def _dealt(at: int, values: np.ndarray, block: int) -> Iterator[tuple]:
    """(block, position, values) of samples that begin at a position."""
    for d in range(at // block, (at + len(values) - 1) // block + 1):
        low, high = max(at, d * block), min(at + len(values), (d + 1) * block)
        yield d, low, values[low - at : high - at]


def _added(n: int, d: int, pieces: list, block: int) -> np.ndarray:
    out = np.zeros(min(block, n - d * block))
    for at, values in sorted(pieces, key=lambda p: p[0]):
        out[at - d * block : at - d * block + len(values)] += values
    return out


def splice_errors(items: DataFrame, segments: DataFrame, crossfade_ms: float = 15.0) -> DataFrame:
    """media_id, error of the items (media_id, rate, n) that cannot be spliced; the first reason counts."""
    some = segments.groupBy("media_id").agg(F.lit(True).alias("some"))
    valid = splice_spans(items.where("rate > 0 and n > 0"), segments, crossfade_ms).groupBy("media_id").agg(F.lit(True).alias("valid"))
    rows = items.join(some, "media_id", "left").join(valid, "media_id", "left")
    error = (
        F.when(F.col("rate").isNull() | (F.col("rate") <= 0), "sample_rate must be greater than zero")
        .when(F.col("n").isNull() | (F.col("n") <= 0), "audio array cannot be empty")
        .when(F.col("some").isNull(), "Segments list cannot be empty")
        .when(F.col("valid").isNull(), "No valid segments remaining after rounding to samples")
    )
    return rows.select("media_id", error.alias("error")).where("error is not null")


def loop_plan(target_ms: Column, crossfade_ms: float) -> dict[str, Column]:
    """fade, step (samples between the begins of two copies) and loops (copies after the first), from rate and n; loops is 0 where the audio is long enough."""
    n, rate = F.col("n"), F.col("rate")
    fade = F.greatest(F.lit(1), F.least(F.rint(F.lit(float(crossfade_ms)) * rate / 1000.0).cast("long"), F.floor(n / 2)))
    need = F.ceil(target_ms * rate / 1000.0) - n
    # one sample has no room for a fade: its copies follow each other
    step = F.greatest(F.lit(1), n - fade)
    loops = F.when(n * 1000.0 / rate >= target_ms, 0).otherwise(F.greatest(F.lit(1), F.ceil(need / step)))
    return {"fade": fade, "step": step, "loops": loops.cast("long")}


def loop(blocks: DataFrame, target_ms: int, crossfade_ms: float = 500.0, block: int = BLOCK) -> DataFrame:
    """Blocks of each item repeated until ``target_ms``, with loops: each copy begins ``fade`` samples before the last one ends, and both are faded by equal power and added.

    The end is not cut to the target. Items that are long enough stay, with loops 0.
    """
    rows = blocks.withColumns(loop_plan(F.lit(target_ms), crossfade_ms)).withColumn("total", F.col("n") + F.col("loops") * F.col("step"))
    rows = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("loops"), F.lit(COPIES).cast("long"))))

    def cut(info: dict, k: int, x: np.ndarray) -> Iterator[tuple]:
        n, fade, loops, begin = info["n"], info["fade"], info["loops"], k * block
        at = np.arange(begin, begin + len(x))
        rise = fade_gain(fade) if fade > 1 else np.ones(1)
        fall = fade_gain(fade, out=True) if fade > 1 else np.zeros(1)
        head, tail = at < fade, at >= n - fade
        for i in range(info["_from"], min(loops, info["_from"] + COPIES - 1) + 1):
            values = x.copy()
            if i > 0:
                values[head] *= rise[at[head]]
            if i < loops:
                values[tail] *= fall[at[tail] - n + fade]
            yield from _dealt(i * info["step"] + begin, values, block)

    carried = ["media_id", "channel", "rate", "n", "fade", "step", "loops", "total", "_from"]
    made = _exchange(rows, carried, cut, lambda info, d, pieces: _added(info["total"], d, pieces, block))
    return made.select("media_id", "channel", "rate", F.col("total").alias("n"), "loops", "block", "samples")
