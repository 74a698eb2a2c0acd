"""Window statistics and segmentation of sampled signals (media_id, pos, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = "media_id"


def rms_windows(samples: DataFrame, size: int) -> DataFrame:
    """Root mean square of tumbling windows of ``size`` samples (the last may be shorter), over the media's largest one; 0 for a silent item."""
    rms = samples.groupBy(KEY, F.expr(f"pos div {size}").alias("win")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    most = F.max("rms").over(W.partitionBy(KEY))
    return rms.select(KEY, "win", F.when(most > 0, F.col("rms") / most).otherwise(0.0).alias("energy"))


def energy_peaks(energy: DataFrame, step_ms: int, totals: DataFrame, floor: float = 0.30) -> DataFrame:
    """Local maxima (not below the left neighbour, above the right one, and at least the larger of ``floor`` and the mean) and the global maximum; they end at total_ms at the latest.

    ``intensity`` is the energy to six decimals, as reported; ``energy`` is the energy itself, for those who round it otherwise.
    """
    order, whole = W.partitionBy(KEY).orderBy("win"), W.partitionBy(KEY)
    left, right = F.lag("energy", 1, 0.0).over(order), F.lead("energy", 1, 0.0).over(order)
    rows = energy.withColumns({"left": left, "right": right, "mean": F.avg("energy").over(whole), "top": F.max("energy").over(whole)})
    local = (F.col("energy") >= F.col("left")) & (F.col("energy") > F.col("right")) & (F.col("energy") >= F.greatest(F.lit(floor), F.col("mean")))
    rows = rows.where(local | ((F.col("energy") == F.col("top")) & (F.col("top") > 0)))
    rows = rows.join(totals.select(KEY, "total_ms"), KEY)
    start, end = F.col("win") * step_ms, F.least("total_ms", (F.col("win") + 1) * step_ms)
    return rows.select(KEY, "win", start.alias("start_ms"), end.alias("end_ms"), F.floor((start + end) / 2).alias("peak_ms"), F.round("energy", 6).alias("intensity"), "energy")


def bound_confidence(spans: DataFrame, probs: DataFrame, step_ms: int = 32) -> DataFrame:
    """Mean probability (media_id, win, prob) of the windows that each span meets; null where it meets none."""
    wins = spans.withColumn("win", F.explode_outer(F.expr(f"if(end_ms > start_ms, sequence(start_ms div {step_ms}, (end_ms + {step_ms - 1}) div {step_ms} - 1), null)")))
    return wins.join(probs, [KEY, "win"], "left").groupBy(KEY, "span_id").agg(F.avg("prob").alias("confidence"))


def span_energy(spans: DataFrame, energy: DataFrame, step_ms: int) -> DataFrame:
    """``spans`` (span_id, start_ms, end_ms, others) with the mean and largest energy of the windows that each meets, from time 0 on; both 0 where it meets none."""
    wins = spans.withColumn("win", F.explode_outer(F.expr(f"if(end_ms > greatest(0, start_ms), sequence(greatest(0, start_ms) div {step_ms}, (end_ms + {step_ms - 1}) div {step_ms} - 1), null)")))
    hit = wins.join(energy, [KEY, "win"], "left")
    return hit.groupBy(*spans.columns).agg(F.coalesce(F.avg("energy"), F.lit(0.0)).alias("mean_energy"), F.coalesce(F.max("energy"), F.lit(0.0)).alias("max_energy"))


def hysteresis(probs: DataFrame, totals: DataFrame, on: float, off: float, step_ms: int, least_speech_ms: int, least_silence_ms: int) -> DataFrame:
    """Speech segments of a probability series (win, prob): they begin at prob >= on and break where windows below ``off`` between two
    speech windows span at least the least silence; the end is the first of those. An unbroken tail ends at the total.
    """
    order = W.partitionBy(KEY).orderBy("win")
    rows = probs.withColumn("speech", F.col("prob") >= on).withColumn("low", F.col("prob") < off)
    rows = rows.withColumn("run", F.sum(F.col("speech").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("run > 0")
    runs = rows.groupBy(KEY, "run").agg(F.min(F.when(F.col("speech"), F.col("win"))).alias("at"), F.min(F.when(F.col("low"), F.col("win"))).alias("n1"), F.max(F.when(F.col("low"), F.col("win"))).alias("nk"))
    breaks = F.coalesce((F.col("nk") - F.col("n1")) * step_ms >= least_silence_ms, F.lit(False))
    by_run = W.partitionBy(KEY).orderBy("run")
    runs = runs.withColumn("break", breaks).withColumn("seg", F.coalesce(F.sum(F.col("break").cast("int")).over(by_run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    segs = runs.groupBy(KEY, "seg").agg((F.min("at") * step_ms).alias("start_ms"), F.max(F.when(F.col("break"), F.col("n1") * step_ms)).alias("stop"))
    segs = segs.join(totals, KEY).withColumn("end_ms", F.coalesce("stop", "total_ms"))
    return segs.where(F.col("end_ms") - F.col("start_ms") >= least_speech_ms).select(KEY, "start_ms", "end_ms")
