"""Stencils, masks and layers on tiles against whole frames in numpy, for several tile sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaspan.operators import tiles as T

SIZES = (7, 128)


def frame(height, width, seed):
    rng = np.random.default_rng(seed)
    return {c: rng.integers(0, 256, (height, width)) for c in "rgb"} | {"a": rng.choice([0, 0, 90, 255, 255], (height, width))}


def disc(size, radius):
    y, x = np.mgrid[0:size, 0:size] - size // 2
    return np.where(y * y + x * x <= radius * radius, 255, 0)


def table(spark, frames, tile):
    rows = [(f, *p.shape, y, x, *(int(v[y, x]) for v in planes.values())) for f, planes in frames.items() for p in [next(iter(planes.values()))] for y in range(p.shape[0]) for x in range(p.shape[1])]
    planes = list(next(iter(frames.values())))
    pixels = spark.createDataFrame(rows, "frame_id int, height int, width int, y int, x int, " + ", ".join(f"{c} int" for c in planes)).repartition(5)
    return T.to_tiles(pixels, planes, tile)


def matrices(df, planes, tile):
    out = {}
    for r in T.to_pixels(df, planes, tile).collect():
        for c in planes:
            out.setdefault((r.frame_id, c), {})[r.y, r.x] = r[c]
    shape = lambda cells: [1 + max(k[i] for k in cells) for i in (0, 1)]
    return {k: np.array([[cells[y, x] for x in range(shape(cells)[1])] for y in range(shape(cells)[0])]) for k, cells in out.items()}


def whole_blur(m, radius, sigma=None):
    k = np.array(T.gaussian(radius, sigma))
    wide = np.pad(m.astype(float), ((0, 0), (radius, radius)), mode="edge")
    m = sum(k[i] * wide[:, i : i + m.shape[1]] for i in range(len(k)))
    tall = np.pad(m, ((radius, radius), (0, 0)), mode="edge")
    return sum(k[i] * tall[i : i + m.shape[0]] for i in range(len(k)))


def whole_dilate(m, radius):
    out = m.copy()
    h, w = m.shape
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius:
                for y in range(max(0, dy), min(h, h + dy)):
                    for x in range(max(0, dx), min(w, w + dx)):
                        out[y, x] = max(out[y, x], m[y - dy, x - dx])
    return out


def u8(m):
    return np.clip(np.round(m), 0, 255).astype(int)


FRAMES = {1: frame(23, 30, 1), 2: frame(1, 1, 2), 3: frame(2, 40, 3), 4: frame(16, 16, 4)}


@pytest.mark.parametrize("tile", SIZES)
def test_measures(spark, tile):
    got = {r.frame_id: r for r in T.frame_measures(table(spark, FRAMES, tile), tile).collect()}
    for f, p in FRAMES.items():
        y = 0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"]
        e = np.pad(y, 1, mode="edge")
        lap = e[:-2, 1:-1] + e[2:, 1:-1] + e[1:-1, :-2] + e[1:-1, 2:] - 4 * y
        want = y.mean(), y.std(), lap.var() if min(y.shape) >= 3 else 0.0
        assert (got[f].luminance, got[f].contrast, got[f].sharpness) == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_sharp_blurred_and_flat_frames(spark):
    """A chessboard is sharp, less so when blurred; a flat frame has no variance and a tiny one counts as none."""
    grid = (np.indices((60, 60)) // 6).sum(0) % 2 * 255
    soft = u8(whole_blur(grid, 3, 3.0))
    frames = {k: dict.fromkeys("rgb", m) for k, m in {1: grid, 2: soft, 3: np.full((60, 60), 128), 4: np.ones((2, 2), int)}.items()}
    got = {r.frame_id: r for r in T.evaluated_frames(table(spark, frames, 16), 16).collect()}
    assert got[1].sharpness > 500 and got[1].sharpness > 5 * got[2].sharpness
    assert got[3].sharpness == got[4].sharpness == 0.0
    assert got[3].reasons == ["BLURRY"] and got[4].reasons == ["BLURRY", "DARK"] and got[1].reasons == []
    assert got[3].light == pytest.approx(0.7 * (1 - abs((128 - 35) / 190 - 0.5) * 2))


@pytest.mark.parametrize("tile", SIZES)
@pytest.mark.parametrize("radius", [0, 1, 3, 9])
def test_blur_and_feather(spark, tile, radius):
    made = table(spark, FRAMES, tile)
    soft, rounded = matrices(T.blur(made, "a", radius, tile=tile), ["a"], tile), matrices(T.feather(made, "a", radius, tile), ["a"], tile)
    for f, p in FRAMES.items():
        assert np.array_equal(soft[f, "a"], whole_blur(p["a"], radius) if radius else p["a"])
        assert np.array_equal(rounded[f, "a"], u8(whole_blur(p["a"], radius)) if radius else p["a"])


@pytest.mark.parametrize("radius", range(17))
def test_dilation_by_every_radius(spark, radius):
    frames = {1: {"mask": frame(21, 26, radius)["a"]}, 2: {"mask": disc(9, 1)}}
    tile = SIZES[radius % 2]
    got = matrices(T.dilate(table(spark, frames, tile), "mask", radius, tile), ["mask"], tile)
    for f, p in frames.items():
        assert np.array_equal(got[f, "mask"], whole_dilate(p["mask"], radius))


def blended(p, width, colour, opacity, radius, glow, intensity):
    """The layers one after another, colours divided by alpha each time."""
    mask = np.where(p["a"] > 0, 255, 0)
    soft = u8(whole_blur(mask, radius, radius / 2) * (1 - mask / 255) * intensity) if radius else mask * 0
    ring = np.clip(whole_dilate(mask, width) - mask, 0, 255) if width else mask * 0
    rgb, alpha = np.zeros((*mask.shape, 3)), np.zeros(mask.shape)
    layers = [(np.array(glow) / 255 + rgb, soft / 255), (np.array(colour) / 255 + rgb, ring / 255 * opacity), (np.dstack([p[c] for c in "rgb"]) / 255, p["a"] / 255)]
    for top, a in layers:
        out = a + alpha * (1 - a)
        rgb = (top * a[..., None] + rgb * (alpha * (1 - a))[..., None]) / np.maximum(out, 1e-9)[..., None]
        alpha = out
    out = {c: u8(rgb[..., k] * 255) for k, c in enumerate("rgb")} | {"a": u8(alpha * 255)}
    return {c: np.where(p["a"] == 255, p[c], v) for c, v in out.items()}


@pytest.mark.parametrize("tile", SIZES)
@pytest.mark.parametrize("width,radius", [(5, 10), (4, 0), (0, 12), (0, 0)])
def test_stroke_and_glow(spark, tile, width, radius):
    got = matrices(T.stroke_and_glow(table(spark, FRAMES, tile), width, (255, 250, 3), 0.7, radius, (255, 200, 0), 0.8, tile), list("rgba"), tile)
    for f, p in FRAMES.items():
        want = blended(p, width, (255, 250, 3), 0.7, radius, (255, 200, 0), 0.8) if width or radius else p
        for c in "rgba":
            assert np.array_equal(got[f, c], want[c])


def test_masks_of_a_disc(spark):
    """A stroke is outside of the subject and next to it; a glow fades with the distance."""
    mask = disc(60, 15)
    got = matrices(T.outlines(table(spark, {1: {"mask": mask}}, 16), "mask", 6, 12, 0.9, 16), ["stroke", "glow"], 16)
    stroke, glow = got[1, "stroke"], got[1, "glow"]
    assert (stroke[mask == 255] == 0).all() and (glow[mask == 255] == 0).all() and (stroke > 0).any()
    assert glow[30, 46] > glow[30, 52] >= 0


def test_many_layers_in_any_grouping(spark):
    """40 layers: blending by groups gives what one fold gives."""
    rng = np.random.default_rng(9)
    layers = [{c: rng.random((4, 5)) for c in "rgba"} for _ in range(40)]
    rows = [(1, 4, 5, 0, 0, z, *(p[c].reshape(-1).tolist() for c in "rgba")) for z, p in enumerate(layers)]
    df = spark.createDataFrame(rows, "frame_id int, height int, width int, ty int, tx int, layer int, r array<double>, g array<double>, b array<double>, a array<double>").repartition(4)
    got = T.over(df, count=40).collect()
    rgb, alpha = np.zeros((3, 4, 5)), np.zeros((4, 5))
    for p in layers:
        top = np.stack([p[c] for c in "rgb"])
        out = p["a"] + alpha * (1 - p["a"])
        rgb, alpha = (top * p["a"] + rgb * alpha * (1 - p["a"])) / out, out
    assert len(got) == 1 and got[0].a == pytest.approx(alpha.reshape(-1).tolist(), rel=1e-12)
    for k, c in enumerate("rgb"):
        assert got[0][c] == pytest.approx(rgb[k].reshape(-1).tolist(), rel=1e-9)


@pytest.mark.parametrize("direction", ["horizontal", "vertical", "diagonal"])
def test_gradient(spark, direction):
    df = spark.createDataFrame([(1, 9, 20), (2, 1, 1), (3, 0, 5)], "frame_id int, height int, width int")
    got = matrices(T.gradient(df, (0, 10, 255), (255, 20, 1), direction, 8), list("rgb"), 8)
    assert {k[0] for k in got} == {1, 2}
    for f, (h, w) in {1: (9, 20), 2: (1, 1)}.items():
        y, x = np.mgrid[0:h, 0:w] / np.array([max(h - 1, 1), max(w - 1, 1)])[:, None, None]
        t = {"horizontal": x, "vertical": y}.get(direction, (x + y) / 2)
        for c, a, b in zip("rgb", (0, 10, 255), (255, 20, 1)):
            assert np.array_equal(got[f, c], u8(a * (1 - t) + b * t))


def test_broken_frames_are_errors(spark):
    rows = [(1, 2, 2, 0, 0, 5), (1, 2, 2, 0, 1, 5), (1, 2, 2, 1, 0, 5)]
    for extra in ([], [(1, 2, 2, 1, 0, 5)]):
        df = spark.createDataFrame(rows + extra, "frame_id int, height int, width int, y int, x int, mask int")
        with pytest.raises(Exception, match="pixels are missing"):
            T.to_tiles(df, ["mask"]).collect()
    assert T.dilate(T.to_tiles(df.where(F.lit(False)), ["mask"]), "mask", 3).count() == 0
