"""Fixed values of colours, hashtags, energies, boundaries and tracks."""

import numpy as np

from mediaspan.functions import text
from mediaspan.operators import intervals, selection, signal
from pyspark.sql import functions as F


def test_colours(spark):
    given = {"#FFFFFF": "&H00FFFFFF&", "#FFF200": "&H0000F2FF&", "FFF200": "&H0000F2FF&", "#80FF00AA": "&H80AA00FF&", "&H0000F2FF&": "&H0000F2FF&", " &h80ffffff& ": "&h80ffffff&", "\t#a0b1c2\n": "&H00c2b1a0&", "#12": None, "": None, None: None}
    rows = spark.createDataFrame([(c,) for c in given], "c string").select("c", text.ass_colour(F.col("c")).alias("v")).collect()
    assert {r.c: r.v for r in rows} == given


def test_hashtags(spark):
    tags = [" a b\t", "#a b", "\n", "#", " über ", "x", "#x"]
    assert spark.createDataFrame([(tags,)], "t array<string>").select(text.hashtags(F.col("t"))).first()[0] == ["#a_b", "#über", "#x"]


def test_span_energy_without_windows(spark):
    energy = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.0)], "media_id long, win long, energy double")
    spans = spark.createDataFrame([(1, 0, 0, 500), (1, 1, 9000, 9500), (1, 2, 300, 300), (1, 3, -700, 100), (1, 4, -90, -20)], "media_id long, span_id long, start_ms long, end_ms long")
    got = {r.span_id: (r.mean_energy, r.max_energy) for r in signal.span_energy(spans, energy, 250).collect()}
    assert got == {0: (0.75, 1.0), 1: (0.0, 0.0), 2: (0.0, 0.0), 3: (0.5, 0.5), 4: (0.0, 0.0)}


def test_tracks(spark):
    kind = "media_id long, sample_id long, at_ms long, x double, y double, detected boolean"
    def path(samples, **options):
        out = selection.smooth_track(spark.createDataFrame([(1, k, k, *s) for k, s in enumerate(samples)], kind), **options)
        return [(r.hold, r.hold_y) for r in out.orderBy("sample_id").collect()]

    assert path([(0.7, 0.4, True), (None, None, False), (None, None, True)], alpha=0.5, deadband=0.0) == [(0.7, 0.4)] * 3
    clamped = path([(-0.5, 0.4, True), (0.0, -0.2, True), (1.5, 1.2, True)], alpha=1.0, deadband=0.0)
    assert clamped == [(0.0, 0.4), (0.0, 0.0), (1.0, 1.0)]
    xs = [x for x, _ in path([(0.5, 0.4, True)] * 12 + [(0.9, 0.4, True)] * 18, alpha=0.3, deadband=0.0)]
    assert xs[0] == 0.5 and xs == sorted(xs) and xs[-1] > 0.85 and max(np.diff(xs)) <= 0.3


def test_boundaries_of_a_long_item(spark):
    """One item with most rows: both directions are linear in its rows."""
    points = spark.range(60_000).selectExpr("1L as media_id", "id as point_id", "id * 7 as at_ms")
    bounds = spark.range(60_000).selectExpr("1L as media_id", "id * 5 as at_ms")
    rows = intervals.boundary_asof(points, bounds)
    wrong = rows.where("not (previous_ms <=> if(at_ms > 0, (least(at_ms, 300000) - 1) div 5 * 5, null)) or not (next_ms <=> if(at_ms < 299995, (at_ms div 5 + 1) * 5, null))")
    assert rows.count() == 60_000 and wrong.count() == 0


def test_intensities_are_rounded_once(spark):
    """0.6764997 is 0.6765 to six decimals, but 676 thousandths."""
    energy = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.1), (1, 2, 0.6764997), (1, 3, 0.2)], "media_id long, win long, energy double")
    peaks = signal.energy_peaks(energy, 250, spark.createDataFrame([(1, 1000)], "media_id long, total_ms long"))
    got = {r.win: (r.intensity, r.thousandths) for r in peaks.withColumn("thousandths", F.round(F.col("energy") * 1000).cast("int")).collect()}
    assert got == {0: (1.0, 1000), 2: (0.6765, 676)}


def test_query_rounds_intensities_once(spark, tmp_path):
    """Item 1 has a second peak whose energy is 0.6764997 of the first one's."""
    from mediaspan.plans import catalogue

    vector = [1.0] * 4 + [0.1] * 4 + [0.6764997] * 4 + [0.2] * 4
    spark.createDataFrame([(1, vector)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r.intensity for r in catalogue.energy_peaks(spark, str(tmp_path)).orderBy("start_ms").collect()] == [1000, 676]


def test_overlap_ratios_in_whole_parts(spark, tmp_path):
    """0.125625 times a million is 125624.99999999999 in doubles."""
    from datetime import datetime, timedelta

    from mediaspan.plans import catalogue

    at = datetime(2024, 1, 1)
    rows = [(1, 7, at, "view", 0.201), (2, 7, at, "view", 1.6)]  # 201 of 1600 ms
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in catalogue.temporal_iou_pairs(spark, str(tmp_path)).collect()] == [(1, 2, 125_625)]
    spans = spark.createDataFrame([(7, 1, 0, 201), (7, 2, 0, 1600)], "media_id long, event_id long, start_ms long, end_ms long")
    got = intervals.overlapping_pairs(spans, "event_id", 200_000).first()
    assert (got.overlap_ms, got.union_ms) == (201, 1600)


def test_numbers_by_their_binary_value(spark):
    """As Python prints them, also where the decimal form seems to lie in the middle."""
    import random

    rng = random.Random(3)
    values = [k / 10**p + 5 / 10 ** (p + 1) for p in (2, 3, 4, 6) for k in (0, 1, 12, 606187, 123456)] + [rng.uniform(-2000, 2000) for _ in range(200)]
    values += [-x for x in values] + [0.0, -0.0, 0.125, 0.375, 2.5, 1163.88, 643.56, 335220.0, 2.0**40 + 0.5, 0.99996, 9.99995, -0.00001]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (2, 3, 4, 6):
        assert [r[0] for r in df.select(text.fixed(F.col("v"), places)).collect()] == [f"{v:.{places}f}" for v in values]
    assert spark.createDataFrame([(None,)], "v double").select(text.fixed(F.col("v"), 2)).first()[0] is None


def test_slopes_by_their_binary_value(spark):
    """A slope of 60.61875, as a double a little less than that."""
    points = spark.createDataFrame([(1, 1, 0, 0.0), (1, 2, 102_044, 0.0), (1, 3, 121_244, 0.764)], "media_id long, sample_id long, at_ms long, hold double")
    assert selection.crop_path(points, 1920, 606).first().path == "if(between(t,0.000,102.044),(0.00+0.0000*(t-0.000)),if(between(t,102.044,121.244),(0.00+60.6187*(t-102.044)),1163.88))"
