"""Frames as tiles: pixel stencils, masks and layers over frames of any size.

A tile is a row: frame_id, height, width (of the frame), ty, tx and one array for each plane, row by row. Whatever needs a pixel's neighbourhood goes through
``stencil``: tiles send the strips that their neighbours need (the halo), each tile is put together with its halo and one function makes its new
planes. So no task holds more than a batch of tiles, and results don't depend on the tile size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from mediaspan.functions import scores

TILE = 128
PLACE = ["frame_id", "height", "width", "ty", "tx"]
#: Luminance weights in thousandths.
LUMA = {"r": 299, "g": 587, "b": 114}
#: Layers of one tile that are blended before their results are; pieces of tiles in a batch.
LAYERS, BATCH = 16, 256


def _span(at: Column, size: Column, tile: int) -> Column:
    """Rows (or columns) of a tile."""
    return F.least(F.lit(tile), size - at * tile)


def to_tiles(pixels: DataFrame, planes: list[str], tile: int = TILE) -> DataFrame:
    """Tiles of ``pixels``: frame_id, height, width, y, x and planes. A pixel that is missing, repeated or outside its frame is an error."""
    pixels = pixels.withColumn("ty", F.floor(F.col("y") / tile).cast("int")).withColumn("tx", F.floor(F.col("x") / tile).cast("int"))
    rows = pixels.groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("y", "x", *planes))).alias("p"))
    h, w = _span(F.col("ty"), F.col("height"), tile), _span(F.col("tx"), F.col("width"), tile)
    place = lambda p: (p["y"] - F.col("ty") * tile) * w + p["x"] - F.col("tx") * tile
    whole = (F.size("p") == h * w) & F.forall(F.transform("p", lambda p, i: place(p) == i), lambda ok: ok)
    checked = F.when(whole, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("pixels are missing, repeated or outside of frame "), F.col("frame_id").cast("string"))))
    rows = rows.withColumn("p", checked)
    return rows.select(*PLACE, *[F.col("p")[c].alias(c) for c in planes])


def to_pixels(tiles: DataFrame, planes: list[str], tile: int = TILE) -> DataFrame:
    """frame_id, y, x and planes of every pixel."""
    w = _span(F.col("tx"), F.col("width"), tile)
    rows = tiles.select("frame_id", "ty", "tx", w.alias("w"), F.posexplode(F.arrays_zip(*planes)).alias("i", "p"))
    y, x = F.col("ty") * tile + F.floor(F.col("i") / F.col("w")), F.col("tx") * tile + F.col("i") % F.col("w")
    return rows.select("frame_id", y.cast("int").alias("y"), x.cast("int").alias("x"), *[F.col("p")[c].alias(c) for c in planes])


def _values(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def _cut(planes: list[str], reach: int, tile: int) -> Callable:
    """Pieces of tiles for every tile whose halo meets them, the tile itself included."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            place = [batch.column(c).to_pylist() for c in range(5)]
            kinds = [*(batch.schema.field(c).type for c in range(5)), *[pa.int32()] * 4, *(batch.schema.field(5 + c).type for c in range(len(planes)))]
            rows: list[list] = [[] for _ in kinds]
            for k, (frame, height, width, ty, tx) in enumerate(zip(*place)):
                y0, x0 = ty * tile, tx * tile
                h, w = min(tile, height - y0), min(tile, width - x0)
                blocks = [_values(batch.column(5 + c), k).reshape(h, w) for c in range(len(planes))]
                for to_y in range(max(0, (y0 - reach) // tile), min((height - 1) // tile, (y0 + h - 1 + reach) // tile) + 1):
                    for to_x in range(max(0, (x0 - reach) // tile), min((width - 1) // tile, (x0 + w - 1 + reach) // tile) + 1):
                        top, bottom = max(y0, to_y * tile - reach), min(y0 + h, to_y * tile + tile + reach)
                        left, right = max(x0, to_x * tile - reach), min(x0 + w, to_x * tile + tile + reach)
                        if top >= bottom or left >= right:
                            continue
                        for column, v in zip(rows, (frame, height, width, to_y, to_x, top, left, bottom - top, right - left)):
                            column.append(v)
                        for column, b in zip(rows[9:], blocks):
                            column.append(b[top - y0 : bottom - y0, left - x0 : right - x0].reshape(-1))
                if len(rows[0]) > BATCH or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds)], [*PLACE, "y", "x", "h", "w", *planes])
                    rows = [[] for _ in kinds]

    return work


def stencil(tiles: DataFrame, planes: list[str], reach: int, made: str, function: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], tile: int = TILE, edge: bool = True) -> DataFrame:
    """Tiles with the planes that ``function`` makes of a tile and ``reach`` pixels around it.

    ``function`` gets each of ``planes`` as a matrix that is ``reach`` larger on all four sides and returns matrices of the tile's own size (or scalars), as the
    schema ``made`` names them. Outside the frame the nearest pixel of the frame is repeated, or, without ``edge``, there is 0. One exchange; a tile's row holds its halo only.
    """
    at = [tiles.schema[c] for c in (*PLACE, *planes)]
    pieces_schema = StructType([*at[:5], *StructType.fromDDL("y int, x int, h int, w int").fields, *at[5:]])
    pieces = tiles.select(*PLACE, *planes).mapInArrow(_cut(planes, reach, tile), pieces_schema)
    grouped = pieces.groupBy(*PLACE).agg(F.collect_list(F.struct("y", "x", "h", "w", *planes)).alias("pieces"))
    out = StructType.fromDDL(made).fields
    schema = StructType([*at[:5], *out])
    names = [f.name for f in out]
    scalar = {f.name: not f.dataType.simpleString().startswith("array") for f in out}

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            place = [batch.column(c).to_pylist() for c in range(5)]
            results: list[list] = [[] for _ in names]
            for k, (_, height, width, ty, tx) in enumerate(zip(*place)):
                y0, x0 = ty * tile - reach, tx * tile - reach
                y1, x1 = min(height, ty * tile + tile) + reach, min(width, tx * tile + tile) + reach
                blocks: dict[str, np.ndarray] = {}
                struct = batch.column(5)[k].values
                where = [struct.field(c).to_pylist() for c in range(4)]
                for c, plane in enumerate(planes):
                    column = struct.field(4 + c)
                    for i, (y, x, h, w) in enumerate(zip(*where)):
                        piece = _values(column, i).reshape(h, w)
                        if plane not in blocks:
                            blocks[plane] = np.zeros((y1 - y0, x1 - x0), piece.dtype)
                        blocks[plane][y - y0 : y - y0 + h, x - x0 : x - x0 + w] = piece
                if edge:
                    top, left, bottom, right = max(0, -y0), max(0, -x0), max(0, y1 - height), max(0, x1 - width)
                    inner = lambda b, t=top, m=left, u=bottom, r=right: b[t : b.shape[0] - u, m : b.shape[1] - r]
                    blocks = {p: np.pad(inner(b), ((top, bottom), (left, right)), mode="edge") for p, b in blocks.items()}
                new = function(blocks)
                for column, name in zip(results, names):
                    column.append(new[name] if scalar[name] else new[name].reshape(-1))
            kinds = [to_arrow_type(f.dataType) for f in out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), *(pa.array(v, t) for v, t in zip(results, kinds))], [*PLACE, *names])

    return grouped.mapInArrow(work, schema)


def _core(block: np.ndarray, reach: int, by: tuple[int, int] = (0, 0)) -> np.ndarray:
    """The tile itself, or what lies ``by`` (rows, columns) from it."""
    h, w = block.shape[0] - 2 * reach, block.shape[1] - 2 * reach
    return block[reach + by[0] : reach + by[0] + h, reach + by[1] : reach + by[1] + w]


def luma(r: Column, g: Column, b: Column) -> Column:
    """Luminance of a plane's pixels in thousandths: exact integers."""
    return F.zip_with(F.zip_with(r, g, lambda x, y: x * LUMA["r"] + y * LUMA["g"]), b, lambda xy, z: xy + z * LUMA["b"])


def frame_measures(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """frame_id, height, width, luminance, contrast (mean and population deviation), sharpness (variance of the Laplacian) of r, g, b planes.

    The sums of tiles are exact integers that add up in any order; a frame of under three rows or columns has sharpness 0.
    """

    def sums(planes: dict[str, np.ndarray]) -> dict[str, int]:
        y = planes["luma"].astype(np.int64)
        own = _core(y, 1)
        around = _core(y, 1, (-1, 0)) + _core(y, 1, (1, 0)) + _core(y, 1, (0, -1)) + _core(y, 1, (0, 1)) - 4 * own
        return {"n": own.size, "s": int(own.sum()), "ss": int((own * own).sum()), "e": int(around.sum()), "ee": int((around * around).sum())}

    parts = stencil(tiles.select(*PLACE, luma(F.col("r"), F.col("g"), F.col("b")).alias("luma")), ["luma"], 1, "n long, s long, ss long, e long, ee long", sums, tile)
    whole = parts.groupBy("frame_id", "height", "width").agg(*[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("n", "s", "ss", "e", "ee")])
    double = lambda c: F.col(c).cast("double")
    variance = lambda one, two: F.greatest(F.lit(0.0), (F.col(two) - F.col(one) * (F.col(one) / F.col("n"))).cast("double") / double("n") / 1e6)
    sharp = F.when((F.col("height") < 3) | (F.col("width") < 3), 0.0).otherwise(variance("e", "ee"))
    return whole.select("frame_id", "height", "width", (double("s") / double("n") / 1000).alias("luminance"), F.sqrt(variance("s", "ss")).alias("contrast"), sharp.alias("sharpness"))


def evaluated_frames(tiles: DataFrame, tile: int = TILE, least: float = 80.0, low: float = 35.0, high: float = 225.0) -> DataFrame:
    """``frame_measures`` with light, reasons and score of frames in which no face was looked for."""
    rows = frame_measures(tiles, tile)
    mean, none = F.col("luminance"), F.lit(None).cast("double")
    light = scores.lighting(mean, F.col("contrast"), low, high)
    reasons = scores.rejections(F.col("sharpness") < least, F.lit(False), F.lit(False), mean < low, mean > high)
    return rows.select("*", light.alias("light"), reasons.alias("reasons"), scores.composite(F.col("sharpness"), F.lit(0.0), light, F.lit(False), none, none, least).alias("score"))


def gaussian(radius: int, sigma: float | None = None) -> list[float]:
    """Weights of a normalised Gaussian over 2 * radius + 1 places; sigma is radius / 2.5 and 0.8 at least, where not given or not positive."""
    if radius <= 0:
        return [1.0]
    sigma = sigma if sigma and sigma > 0 else max(radius / 2.5, 0.8)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return (weights / weights.sum()).tolist()


def _along(block: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    size = block.shape[axis] - len(weights) + 1
    total = np.zeros([size if a == axis else n for a, n in enumerate(block.shape)])
    for k, weight in enumerate(weights):
        total += weight * block.take(range(k, k + size), axis)
    return total


def _blurred(block: np.ndarray, weights: list[float], reach: int) -> np.ndarray:
    """Columns, then rows; a block that reaches further than the weights is trimmed."""
    spare = reach - len(weights) // 2
    block = block[spare : block.shape[0] - spare, spare : block.shape[1] - spare].astype(float)
    return _along(_along(block, weights, 1), weights, 0)


def _whole(values: np.ndarray) -> np.ndarray:
    """Rounded half to even and kept in 0 to 255."""
    return np.clip(np.round(values), 0, 255).astype(np.int32)


def _furthest(block: np.ndarray, radius: int, reach: int) -> np.ndarray:
    """Maximum over a disc: each row of the disc is a running maximum, whose spans grow by doubling."""
    h, w = block.shape[0] - 2 * reach, block.shape[1] - 2 * reach
    out = _core(block, reach).copy()
    for half in sorted({int((radius * radius - dy * dy) ** 0.5) for dy in range(radius + 1)}):
        running, span = block, 1
        while span < 2 * half + 1:
            step = min(span, 2 * half + 1 - span)
            running = np.maximum(running[:, : running.shape[1] - step], running[:, step:])
            span += step
        running = running[:, reach - half : reach - half + w]
        for dy in range(-radius, radius + 1):
            if int((radius * radius - dy * dy) ** 0.5) == half:
                np.maximum(out, running[reach + dy : reach + dy + h], out=out)
    return out


def blur(tiles: DataFrame, plane: str, radius: int, sigma: float | None = None, tile: int = TILE) -> DataFrame:
    """Tiles with ``plane`` convolved with a Gaussian along rows and columns, as doubles; the frame's edges are repeated."""
    weights, reach = gaussian(radius, sigma), max(0, radius)
    return stencil(tiles, [plane], reach, f"{plane} array<double>", lambda p: {plane: _blurred(p[plane], weights, reach)}, tile)


def dilate(tiles: DataFrame, plane: str = "mask", radius: int = 8, tile: int = TILE) -> DataFrame:
    """Tiles with each value the greatest within ``radius`` pixels (a disc)."""
    reach = max(0, radius)
    return stencil(tiles, [plane], reach, f"{plane} array<int>", lambda p: {plane: _furthest(p[plane], reach, reach)}, tile, edge=False)


def feather(tiles: DataFrame, plane: str = "mask", radius: int = 2, tile: int = TILE) -> DataFrame:
    """Tiles with a mask's edges blurred and rounded."""
    weights, reach = gaussian(radius), max(0, radius)
    return stencil(tiles, [plane], reach, f"{plane} array<int>", lambda p: {plane: _whole(_blurred(p[plane], weights, reach))}, tile)


def _ring(block: np.ndarray, width: int, reach: int) -> np.ndarray:
    own = _core(block, reach)
    return np.clip(_furthest(block, width, reach) - own, 0, 255) if width > 0 else np.zeros_like(own)


def _glow(block: np.ndarray, radius: int, intensity: float, reach: int) -> np.ndarray:
    own = _core(block, reach)
    if radius <= 0 or intensity <= 0:
        return np.zeros_like(own)
    return _whole(_blurred(block, gaussian(radius, radius / 2), reach) * (1 - own / 255) * intensity)


def outlines(tiles: DataFrame, plane: str = "mask", width: int = 8, radius: int = 16, intensity: float = 0.8, tile: int = TILE) -> DataFrame:
    """Tiles with ``stroke`` (the mask grown by ``width`` without the mask) and ``glow`` (the mask blurred, outside of it): one exchange for both.

    Edges are repeated for both, which changes no stroke: a repeated pixel is further away than the one it repeats.
    """
    reach = max(0, width, radius)
    return stencil(tiles, [plane], reach, "stroke array<int>, glow array<int>", lambda p: {"stroke": _ring(p[plane], width, reach), "glow": _glow(p[plane], radius, intensity, reach)}, tile)


def over(layers: DataFrame, order: str = "layer", count: int = LAYERS) -> DataFrame:
    """Tiles of all layers blended, higher ``order`` (0 to ``count`` - 1, each once a tile) on top: r, g, b, a arrays of doubles in 0 to 1, colours not multiplied by a.

    ``layers``: place, ``order`` and r, g, b, a. Colours times a, and a, are blended by an associative rule: LAYERS neighbours at a time, then their results.
    """
    rows = layers.select(*PLACE, F.col(order).alias("z"), *[F.zip_with(c, "a", lambda v, a: v * a).alias(c) for c in "rgb"], "a")
    plain = lambda s: F.struct(*[s[c].alias(c) for c in "rgba"])
    pair = lambda low, top: F.struct(*[F.zip_with(top[c], F.zip_with(low[c], top["a"], lambda v, a: v * (1 - a)), lambda t, v: t + v).alias(c) for c in "rgba"])
    while count > 0:
        rows = rows.groupBy(*PLACE, F.floor(F.col("z") / LAYERS).alias("up")).agg(F.sort_array(F.collect_list(F.struct("z", "r", "g", "b", "a"))).alias("s"))
        done = F.aggregate(F.slice("s", F.lit(2), F.size("s")), plain(F.col("s")[0]), lambda low, top: pair(low, top))
        rows = rows.select(*PLACE, F.col("up").alias("z"), done.alias("d")).select(*PLACE, "z", *[F.col("d")[c].alias(c) for c in "rgba"])
        count = (count - 1) // LAYERS
    colour = lambda c: F.zip_with(c, "a", lambda v, a: F.when(a > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / a))).otherwise(0.0)).alias(c)
    return rows.select(*PLACE, *[colour(c) for c in "rgb"], "a")


def stroke_and_glow(tiles: DataFrame, width: int = 8, stroke: tuple[int, int, int] = (255, 255, 255), opacity: float = 1.0, radius: int = 16, glow: tuple[int, int, int] = (255, 255, 255), intensity: float = 0.8, tile: int = TILE) -> DataFrame:
    """Tiles of r, g, b, a (0 to 255) with a glow behind a stroke behind the subject; pixels with a = 255 stay as they are. Width or radius 0: without that layer."""
    if width <= 0 and radius <= 0:
        return tiles.select(*PLACE, "r", "g", "b", "a")
    flat = lambda a, colour: [F.array_repeat(F.lit(v / 255), F.size(a)).alias(c) for c, v in zip("rgb", colour)]
    alpha = lambda c, k=1.0: F.transform(c, lambda v: v / 255.0 * k).alias("a")
    mask = F.transform("a", lambda v: F.when(v > 0, 255).otherwise(0)).alias("mask")
    lines = outlines(tiles.select(*PLACE, mask), "mask", width, radius, intensity, tile)
    layers = tiles.select(*PLACE, F.lit(3).alias("layer"), *[F.transform(c, lambda v: v / 255.0).alias(c) for c in "rgb"], alpha("a"))
    if radius > 0:
        layers = layers.unionByName(lines.select(*PLACE, F.lit(1).alias("layer"), *flat("glow", glow), alpha("glow")))
    if width > 0:
        layers = layers.unionByName(lines.select(*PLACE, F.lit(2).alias("layer"), *flat("stroke", stroke), alpha("stroke", opacity)))
    whole = lambda c: F.transform(c, lambda v: F.rint(v * 255).cast("int")).alias(f"new_{c}")
    blended = over(layers).select(*PLACE, *[whole(c) for c in "rgba"])
    kept = lambda c: F.zip_with(F.arrays_zip(c, "a").alias("z"), F.col(f"new_{c}"), lambda old, new: F.when(old["a"] == 255, old[c]).otherwise(new)).alias(c)
    joined = tiles.join(blended, PLACE)
    return joined.select(*PLACE, kept("r"), kept("g"), kept("b"), F.zip_with("a", "new_a", lambda old, new: F.when(old == 255, old).otherwise(new)).alias("a"))


def gradient(frames: DataFrame, start: tuple[int, int, int], end: tuple[int, int, int], direction: str = "vertical", tile: int = TILE) -> DataFrame:
    """Tiles of r, g, b between two colours over frames (frame_id, height, width); direction: horizontal, vertical or diagonal."""
    count = lambda c: F.sequence(F.lit(0), F.floor((F.col(c) - 1) / tile).cast("int"))
    rows = frames.where("height > 0 and width > 0").select("frame_id", "height", "width", F.explode(count("height")).alias("ty")).select("*", F.explode(count("width")).alias("tx"))
    h, w = _span(F.col("ty"), F.col("height"), tile), _span(F.col("tx"), F.col("width"), tile)
    share = lambda at, size: at / F.greatest(size - 1, F.lit(1))

    def part(i: Column) -> Column:
        down = share(F.col("ty") * tile + F.floor(i / w), F.col("height"))
        across = share(F.col("tx") * tile + i % w, F.col("width"))
        return {"horizontal": across, "vertical": down}.get(direction, (across + down) / 2)

    parts = rows.withColumn("t", F.transform(F.sequence(F.lit(0), (h * w - 1).cast("int")), part))
    mixed = lambda a, b: F.transform("t", lambda t: F.rint(a * (1 - t) + b * t).cast("int"))
    return parts.select(*PLACE, *[mixed(a, b).alias(c) for c, a, b in zip("rgb", start, end)])
