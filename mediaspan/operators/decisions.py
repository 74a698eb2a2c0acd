"""Choices between sources, summaries of jobs and frames, and frame selection from scores to ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.operators.intervals import neighbours
from mediaspan.operators.selection import diverse_frames

KEY = "media_id"


def captioned(cuts: DataFrame, words: DataFrame) -> DataFrame:
    """Cuts (media_id, span_id, start_ms, end_ms) with ``captions``: whether a word is left in them. A word that ends at or before its start lasts 50 ms.

    The latest end among the words that start before a cut's end tells, so no pairs are made.
    """
    ends = F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 50).otherwise(F.col("end_ms"))
    probes = cuts.select(KEY, "span_id", "start_ms", "end_ms", (F.col("end_ms") - 1).alias("at_ms"))
    rows = neighbours(probes, words.select(KEY, F.col("start_ms").alias("at_ms"), ends.alias("v")))
    return rows.select(KEY, "span_id", "start_ms", "end_ms", F.coalesce(F.col("floor") > F.col("start_ms"), F.lit(False)).alias("captions"))


def preferred(first: DataFrame, other: DataFrame, first_label: str, other_label: str) -> DataFrame:
    """Rows of ``first``, and those of ``other`` for media items that ``first`` has none of, with the ``strategy`` they come from."""
    missing = other.join(first.select(KEY).distinct(), KEY, "left_anti").withColumn("strategy", F.lit(other_label))
    return first.withColumn("strategy", F.lit(first_label)).unionByName(missing)


def enclosing_boxes(boxes: DataFrame, *keys: str) -> DataFrame:
    """The box around the boxes (x0, y0, x1, y1) of each key."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def job_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Jobs by outcome (status: succeeded, failed or timed_out); a job that timed out has failed, too."""
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    return results.groupBy(*keys).agg(F.count("*").alias("processed"), of("succeeded").alias("succeeded"), of("failed", "timed_out").alias("failed"), of("timed_out").alias("timed_out"))


def frame_counts(frames: DataFrame, reasons: Column) -> DataFrame:
    """Frames of each media item, those without a reason against them, and those with each kind of reason (a frame may have several)."""
    has = lambda *names: F.count_if(F.arrays_overlap(reasons, F.array(*map(F.lit, names))))
    named = {"blurry": has("BLURRY"), "closed_eyes": has("CLOSED_EYES"), "lighting": has("DARK", "OVEREXPOSED"), "no_face": has("NO_FACE_DETECTED")}
    return frames.groupBy(KEY).agg(F.count("*").alias("sampled"), F.count_if(F.size(reasons) == 0).alias("valid"), *[c.alias(k) for k, c in named.items()])


def select_keyframes(frames: DataFrame, reasons: Column, score: Column, apart_ms: int, keep: int) -> DataFrame:
    """Frames (at_ms, frame_id) without a reason against them, best score first, each at least ``apart_ms`` from every kept one, up to ``keep``."""
    return diverse_frames(frames.where(F.size(reasons) == 0).withColumn("score", score), apart_ms, keep)


def frames_at(stamps: DataFrame, frames: DataFrame) -> DataFrame:
    """``stamps`` (media_id, at_ms) with the columns of the frame (media_id, at_ms, others) at just that time; null where there is none. Frames are unique by item and time."""
    return stamps.join(frames, [KEY, "at_ms"], "left")
