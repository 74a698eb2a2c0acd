"""Filter texts of media tools, put together from tables: splices, ducked music, zooms, vertical frames. One text an item, as long as the item's pieces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediaspan.functions import geometry
from mediaspan.functions.text import seconds_text
from mediaspan.operators.intervals import KEY, merge_strict

# The tools' names of the curves (in, out), the audio form, and the texts around what varies.
CURVES = {"linear": ("tri", "tri"), "equal_power": ("qsin", "iqsin")}
FORM = "aformat=channel_layouts=stereo:sample_rates=44100"
RESET, RESET_VIDEO = "asetpts=PTS-STARTPTS", "setpts=PTS-STARTPTS"


def _text(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _in_order(rows: DataFrame, order: str, text: str, between: str, **more: Column) -> DataFrame:
    """An item's texts joined in order."""
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), between)
    return rows.groupBy(KEY).agg(said.alias("said"), *[c.alias(n) for n, c in more.items()])


def splice_scripts(segments: DataFrame, items: DataFrame, crossfade_ms: float = 15.0, curve: str = "equal_power") -> DataFrame:
    """media_id, script: trims of an item's merged segments with fades where two of them meet, and their concatenation. ``items``: media_id, has_video.

    Segments that overlap are merged, touching ones stay apart, empty ones go; items without a segment give no row.
    """
    own = W.partitionBy(KEY)
    rows = merge_strict(segments).where("end_ms > start_ms").join(items.select(KEY, "has_video"), KEY)
    rows = rows.select(KEY, "has_video", "start_ms", "end_ms", (F.row_number().over(own.orderBy("start_ms", "end_ms")) - 1).alias("i"), F.count("*").over(own).alias("n"))
    length = (F.col("end_ms") - F.col("start_ms")).cast("double")
    fade = F.least(F.lit(float(crossfade_ms)), length / 2)
    ramp = lambda kind, at, name: _text(f",afade=t={kind}:st=", at, ":d=", seconds_text(fade), f":c={name}")
    cut = _text("start=", seconds_text(F.col("start_ms").cast("double")), ":end=", seconds_text(F.col("end_ms").cast("double")))
    last, first = F.col("i") == F.col("n") - 1, F.col("i") == 0
    to, since = CURVES[curve][1], CURVES[curve][0]
    heard = _text("[0:a]atrim=", cut, f",{RESET}", F.when(~last & (fade > 0), ramp("out", seconds_text(length - fade), to)).otherwise(""), F.when(~first & (fade > 0), ramp("in", "0.000000", since)).otherwise(""), "[a", F.col("i").cast("string"), "]")
    seen = _text(";\n[0:v]trim=", cut, f",{RESET_VIDEO}[v", F.col("i").cast("string"), "]")
    label = _text(F.when(F.col("has_video"), _text("[v", F.col("i").cast("string"), "]")).otherwise(""), "[a", F.col("i").cast("string"), "]")
    rows = rows.select(KEY, "has_video", "i", "n", F.when(F.col("has_video"), _text(heard, seen)).otherwise(heard).alias("line"), label.alias("label"))
    labels = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]), "")
    out = _in_order(rows, "i", "line", ";\n", labels=labels, n=F.max("n"), video=F.max("has_video"))
    end = F.when(F.col("video"), ":v=1:a=1[outv][outa]\n").otherwise(":v=0:a=1[outa]\n")
    return out.select(KEY, _text(F.col("said"), ";\n", F.col("labels"), "concat=n=", F.col("n").cast("string"), end).alias("script"))


@dataclass(frozen=True)
class Ducking:
    """Music under speech: its level, the compressor and its fades (ms)."""

    volume_db: float = -18.0
    threshold: float = 0.03
    ratio: float = 10.0
    attack_ms: float = 30.0
    release_ms: float = 500.0
    knee: float = 2.8
    fade_in_ms: float = 1000.0
    fade_out_ms: float = 1500.0


def ducking_script(total_ms: Column, d: Ducking = Ducking()) -> Column:
    """The filter text that lowers music (second input) under speech (first input) for an item's length."""
    three = lambda c: F.format_string("%.3f", c)
    seconds = total_ms / 1000.0
    begin = F.greatest(F.lit(0.0), seconds - d.fade_out_ms / 1000.0)
    rise = f",afade=t=in:ss=0:d={d.fade_in_ms / 1000.0:.3f}" if d.fade_in_ms > 0 else ""
    fall = F.when(begin < seconds, _text(",afade=t=out:st=", three(begin), f":d={d.fade_out_ms / 1000.0:.3f}")).otherwise("") if d.fade_out_ms > 0 else ""
    music = _text(f"[1:a]{FORM},volume={d.volume_db}dB{rise}", fall, ",atrim=0:", three(seconds), f",{RESET}[bgm_prep];")
    squeeze = f"[bgm_prep][voice]sidechaincompress=threshold={d.threshold}:ratio={d.ratio}:attack={d.attack_ms}:release={d.release_ms}:knee={d.knee}[ducked_bgm];"
    return _text(f"[0:a]{FORM}[voice];", music, squeeze, "[voice][ducked_bgm]amix=inputs=2:duration=first:dropout_transition=0:normalize=0[aout]")


def zoom_scripts(shots: DataFrame, frames: DataFrame, scale: float = 1.2, anchor: tuple[float, float] = (0.5, 0.4), scaling: str = "lanczos") -> DataFrame:
    """media_id, script of ``frames`` (media_id, width, height): the zoomed picture laid over the plain one while a zoom of ``shots`` (start_ms, end_ms, mode) lasts; only scaled where there is none."""
    three = lambda c: F.format_string("%.3f", F.col(c) / 1000.0)
    zooms = shots.where((F.col("mode") == "ZOOM") & F.lit(scale > 1)).select(KEY, "start_ms", _text("between(t,", three("start_ms"), ",", three("end_ms"), ")").alias("line"))
    rows = frames.join(_in_order(zooms, "start_ms", "line", "+"), KEY, "left")
    size = _text(F.col("width").cast("string"), ":", F.col("height").cast("string"), f":flags={scaling}")
    crop = geometry.zoom_crop(F.col("width"), F.col("height"), F.lit(scale), F.lit(anchor[0]), F.lit(anchor[1]))
    cut = F.concat_ws(":", *[crop[c].cast("string") for c in ("width", "height", "x", "y")])
    zoomed = _text("[0:v]split[base][for_zoom];[for_zoom]crop=", cut, ",scale=", size, "[zoomed];[base][zoomed]overlay=0:0:enable='", F.col("said"), "'[vout]")
    return rows.select(KEY, F.when(F.col("said").isNull(), _text("[0:v]scale=", size, "[vout]")).otherwise(zoomed).alias("script"))


def reframe_script(width: Column, height: Column, mode: Column, path: Column, target: tuple[int, int] = (1080, 1920), blur: int = 20, scaling: str = "lanczos") -> Column:
    """The filter text of a vertical picture: scaled where it is vertical or the mode is unknown, on its own blurred picture (AESTHETIC_FILL), or cropped along ``path`` (SMART_CROP)."""
    size = f"{target[0]}:{target[1]}"
    plain = F.lit(f"[0:v]scale={size}:flags={scaling}[vout]")
    back = f"[bg]scale={size}:force_original_aspect_ratio=increase,crop={size},boxblur=lr={blur}:lp={blur}[bgblur];"
    fill = F.lit(f"[0:v]split=2[bg][fg];{back}[fg]scale={size}:force_original_aspect_ratio=decrease[fgfit];[bgblur][fgfit]overlay=(W-w)/2:(H-h)/2[vout]")
    crop = geometry.smart_crop(width, height, target)
    top = F.floor((height - crop["height"]) / 2).cast("bigint")
    smart = _text("[0:v]crop=", crop["width"].cast("string"), ":", crop["height"].cast("string"), ":'", path, "':", top.cast("string"), f",scale={size}:flags={scaling}[vout]")
    return F.when(geometry.is_vertical(width, height, target), plain).when(mode == "AESTHETIC_FILL", fill).when(mode == "SMART_CROP", smart).otherwise(plain)
