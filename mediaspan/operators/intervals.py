"""Interval algebra over (media_id, start_ms, end_ms) rows, with windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = "media_id"


def _islands(rows: DataFrame, touching: bool) -> DataFrame:
    """Unions of intervals; those that only touch are one island if ``touching``. One shuffle by media."""
    order = W.partitionBy(KEY).orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = before.isNull() | ((F.col("start_ms") > before) if touching else (F.col("start_ms") >= before))
    rows = rows.withColumn("new", new.cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(KEY, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def pad_and_merge(speech: DataFrame, totals: DataFrame, padding_ms: int) -> DataFrame:
    """Widen by ``padding_ms`` within 0 and the media's total_ms; overlapping and touching intervals merge."""
    padded = speech.join(totals, KEY).select(KEY, F.greatest(F.lit(0), F.col("start_ms") - padding_ms).alias("start_ms"), F.least(F.col("total_ms"), F.col("end_ms") + padding_ms).alias("end_ms"))
    return _islands(padded, True)


def merge_strict(rows: DataFrame) -> DataFrame:
    """Overlapping intervals merge; touching ones stay apart."""
    return _islands(rows.select(KEY, "start_ms", "end_ms"), False)


def silence_gaps(speech: DataFrame, totals: DataFrame, least_ms: int) -> DataFrame:
    """Gaps of at least ``least_ms`` in 0..total_ms; media without speech give one gap."""
    tail = totals.select(KEY, F.col("total_ms").alias("start_ms"), F.col("total_ms").alias("end_ms"))
    order = W.partitionBy(KEY).orderBy("start_ms", "end_ms").rowsBetween(W.unboundedPreceding, -1)
    rows = speech.select(KEY, "start_ms", "end_ms").unionByName(tail).withColumn("open", F.coalesce(F.max("end_ms").over(order), F.lit(0)))
    return rows.where(F.col("start_ms") - F.col("open") >= least_ms).select(KEY, F.col("open").alias("start_ms"), F.col("start_ms").alias("end_ms"))


def speech_totals(islands: DataFrame, totals: DataFrame) -> DataFrame:
    """Number of segments, speech and removed silence of each media item."""
    sums = islands.groupBy(KEY).agg(F.count("*").alias("segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    out = totals.join(sums, KEY, "left").na.fill(0, ["segments", "speech_ms"])
    return out.select(KEY, "segments", "speech_ms", F.greatest(F.lit(0), F.col("total_ms") - F.col("speech_ms")).alias("silence_removed_ms"))


def overlap_ms(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    both = overlap_ms(a0, a1, b0, b1)
    union = (a1 - a0) + (b1 - b0) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlapping_pairs(spans: DataFrame, key: str, bucket_ms: int) -> DataFrame:
    """Pairs of spans of a media item that overlap, by their ``key`` (a_id < b_id), with their overlap ratio and its whole parts, ``overlap_ms`` and ``union_ms``. Each pair is made once, in the time bucket in which its overlap begins."""
    rows = spans.where("end_ms > start_ms").select(KEY, key, "start_ms", "end_ms", F.explode(F.expr(f"sequence(start_ms div {bucket_ms}, (end_ms - 1) div {bucket_ms})")).alias("bucket"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, [KEY, "bucket"]).where(f"a.{key} < b.{key} and least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms) and bucket = greatest(a.start_ms, b.start_ms) div {bucket_ms}")
    sides = [F.col(c) for c in ("a.start_ms", "a.end_ms", "b.start_ms", "b.end_ms")]
    both = overlap_ms(*sides)
    union = (sides[1] - sides[0]) + (sides[3] - sides[2]) - both
    return pairs.select(KEY, F.col(f"a.{key}").alias("a_id"), F.col(f"b.{key}").alias("b_id"), temporal_iou(*sides).alias("iou"), both.alias("overlap_ms"), union.alias("union_ms"))


def interval_join(points: DataFrame, spans: DataFrame, bucket_ms: int, at: str = "at_ms") -> DataFrame:
    """Points within start_ms <= at < end_ms of the same media. Spans are dealt to time buckets, so the join key is (media, bucket) and a long or hot media item is spread."""
    left = points.withColumn("bucket", F.expr(f"{at} div {bucket_ms}"))
    right = spans.where("end_ms > start_ms").withColumn("bucket", F.explode(F.expr(f"sequence(start_ms div {bucket_ms}, (end_ms - 1) div {bucket_ms})")))
    return left.join(right, [KEY, "bucket"]).where(f"{at} >= start_ms and {at} < end_ms").drop("bucket")


def first_segments(points: DataFrame, segments: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """``points`` (media_id, at_ms, others; each row once) with ``seg``, the first segment (seg_idx, start_ms, end_ms) by seg_idx that holds them; null for none. A point lies in one time bucket, so the join's shuffle serves the aggregate, too."""
    left = points.withColumn("bucket", F.expr(f"at_ms div {bucket_ms}"))
    right = segments.where("end_ms > start_ms").select(F.col(KEY).alias("_media"), F.explode(F.expr(f"sequence(start_ms div {bucket_ms}, (end_ms - 1) div {bucket_ms})")).alias("_bucket"), F.struct("seg_idx", "start_ms", "end_ms").alias("_seg"))
    held = left.join(right, F.expr(f"{KEY} = _media and bucket = _bucket and at_ms >= _seg.start_ms and at_ms < _seg.end_ms"), "left")
    return held.groupBy(*points.columns, "bucket").agg(F.min("_seg").alias("seg")).drop("bucket")


def point_in_segment(points: DataFrame, segments: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """First segment (by seg_idx) that holds each point; null where none does. ``points``: media_id, point_id, at_ms, each once."""
    return first_segments(points, segments, bucket_ms).withColumn("seg_idx", F.col("seg.seg_idx")).drop("seg")


def contained(items: DataFrame, cuts: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Items (item_start_ms, item_end_ms) that lie wholly in a cut (start_ms, end_ms) of the same media."""
    return interval_join(items, cuts, bucket_ms, "item_start_ms").where("item_end_ms <= end_ms")


def boundary_asof(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Largest boundary before and smallest after each point, strictly. Sorted once in each direction, as frames that only grow: linear in an item's rows, and no pairs are made."""
    rows = points.select(KEY, "at_ms", "point_id", F.lit(None).cast("bigint").alias("b")).unionByName(bounds.select(KEY, F.col("at_ms"), F.lit(None).cast("bigint").alias("point_id"), F.col("at_ms").alias("b")))
    order, back = W.partitionBy(KEY).orderBy("at_ms"), W.partitionBy(KEY).orderBy(F.desc("at_ms"))
    rows = rows.withColumns({"previous_ms": F.max("b").over(order.rangeBetween(W.unboundedPreceding, -1)), "next_ms": F.min("b").over(back.rangeBetween(W.unboundedPreceding, -1))})
    return rows.where("point_id is not null").select(KEY, "point_id", "at_ms", "previous_ms", "next_ms")


def neighbours(probes: DataFrame, bounds: DataFrame, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """For each probe (``by``, at_ms, others): ``floor``, the largest ``v`` of the bounds (``by``, at_ms, v) at or before it, and ``ceiling``, the smallest at or after it.

    Null where there is none or the probe has no time. Sorted once in each direction, as frames that only grow: linear in an item's rows.
    """
    rest = [c for c in probes.columns if c not in (*by, "at_ms")]
    left = probes.select(*by, "at_ms", F.struct(*rest).alias("probe"), F.lit(None).cast(bounds.schema["v"].dataType).alias("v"))
    right = bounds.where("at_ms is not null").select(*by, "at_ms", F.lit(None).cast(left.schema["probe"].dataType).alias("probe"), "v")
    up = W.partitionBy(*by).orderBy("at_ms").rangeBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*by).orderBy(F.desc("at_ms")).rangeBetween(W.unboundedPreceding, 0)
    rows = left.unionByName(right).withColumns({"floor": F.max("v").over(up), "ceiling": F.min("v").over(down)})
    timed = F.col("at_ms").isNotNull()
    return rows.where("probe is not null").select(*by, "at_ms", "probe.*", F.when(timed, F.col("floor")).alias("floor"), F.when(timed, F.col("ceiling")).alias("ceiling"))


def align_to_pauses(windows: DataFrame, pauses: DataFrame, totals: DataFrame, tolerance_ms: int) -> DataFrame:
    """Windows (media_id, span_id, start_ms, end_ms): the start moves back to the nearest pause's end, the end on to the nearest pause's start, each within the tolerance; a window that would turn round stays."""
    sides = windows.where(f"{KEY} is not null and span_id is not null").select(KEY, "span_id", "start_ms", "end_ms", F.explode(F.array(F.struct(F.lit("in").alias("kind"), F.col("start_ms").alias("at_ms")), F.struct(F.lit("out").alias("kind"), F.col("end_ms").alias("at_ms")))).alias("p")).select(KEY, "span_id", "start_ms", "end_ms", "p.*")
    bounds = pauses.select(KEY, F.explode(F.array(F.struct(F.lit("in").alias("kind"), F.col("end_ms").alias("at_ms")), F.struct(F.lit("out").alias("kind"), F.col("start_ms").alias("at_ms")))).alias("p")).select(KEY, "p.*", F.col("p.at_ms").alias("v"))
    # both sides of a window carry it, so the windows aren't made again for a join; rows of one span_id share their sides
    span = W.partitionBy(KEY, "span_id")
    near = neighbours(sides, bounds, (KEY, "kind")).withColumns({
        "a": F.max(F.when((F.col("kind") == "in") & (F.col("at_ms") - F.col("floor") <= tolerance_ms), F.col("floor"))).over(span),
        "b": F.max(F.when((F.col("kind") == "out") & (F.col("ceiling") - F.col("at_ms") <= tolerance_ms), F.col("ceiling"))).over(span),
    })
    rows = near.where("kind = 'in'").join(totals.select(KEY, "total_ms"), KEY)
    a = F.when(F.col("a").isNull(), F.col("start_ms")).otherwise(F.greatest(F.lit(0), F.col("a")))
    b = F.when(F.col("b").isNull(), F.col("end_ms")).otherwise(F.least("total_ms", "b"))
    return rows.select(KEY, "span_id", F.when(b > a, a).otherwise(F.col("start_ms")).alias("start_ms"), F.when(b > a, b).otherwise(F.col("end_ms")).alias("end_ms"))
