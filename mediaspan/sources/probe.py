"""Media probe output (JSON text of streams and format) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspan.functions import text

_STREAM = (
    "struct<codec_type: string, codec_name: string, width: string, height: string, r_frame_rate: string, avg_frame_rate: string, "
    "duration: string, sample_rate: string, channels: string, disposition: struct<attached_pic: string>>"
)


def frame_rate(c: Column) -> Column:
    """``num/den`` to six decimals; null without a slash, for a den of 0 and for 0 or less."""
    value = F.round(F.try_divide(F.substring_index(c, "/", 1).try_cast("double"), F.substr(c, F.instr(c, "/") + 1).try_cast("double")), 6)
    return F.when(F.contains(c, F.lit("/")) & (value > 0), value)


def media_info(raw: Column) -> Column:
    """First video stream (cover pictures are none) and first audio stream; the duration is the format's, else the longer stream's, else 0. Null for text that isn't JSON."""
    # the streams are parsed once, as what is folded; named in each field, they would be parsed for each
    streams = F.coalesce(F.from_json(raw, f"streams array<{_STREAM}>")["streams"], F.array().cast(f"array<{_STREAM}>"))
    whole = F.from_json(raw, "format struct<duration: string>")["format"]
    none = F.lit(None).cast(_STREAM)
    first = lambda kind, got, s: F.coalesce(got[kind], F.when(s["codec_type"] == kind, s)).alias(kind)
    long = lambda s: text.to_ms(s["duration"])
    number = lambda c: F.trim(c).try_cast("int")

    def described(got: Column) -> Column:
        video, audio = got["video"], got["audio"]
        film = F.coalesce(video["disposition"]["attached_pic"], F.lit("0")) != "1"
        shown = lambda c: F.when(film, c)
        return F.struct(
            (video.isNotNull() & film).alias("has_video"), audio.isNotNull().alias("has_audio"), shown(F.coalesce(frame_rate(video["r_frame_rate"]), frame_rate(video["avg_frame_rate"]))).alias("fps"),
            shown(number(video["width"])).alias("width"), shown(number(video["height"])).alias("height"), shown(video["codec_name"]).alias("video_codec"), audio["codec_name"].alias("audio_codec"),
            number(audio["sample_rate"]).alias("sample_rate"), number(audio["channels"]).alias("channels"),
            F.coalesce(long(whole), F.greatest(shown(long(video)), long(audio)), F.lit(0)).alias("duration_ms"), shown(long(video)).alias("video_ms"), long(audio).alias("audio_ms"),
        )

    info = F.aggregate(streams, F.struct(none.alias("video"), none.alias("audio")), lambda got, s: F.struct(first("video", got, s), first("audio", got, s)), described)
    return F.when(F.try_parse_json(raw).isNotNull(), info)
