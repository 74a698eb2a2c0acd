"""Edge cases of intervals, selection, text and the job stream."""

import json

from pyspark.sql import functions as F

from mediaspan.functions import text
from mediaspan.operators import intervals, selection
from mediaspan.streaming.jobs import read_queue, run_queue


def spans(spark, rows):
    return spark.createDataFrame(rows, "media_id long, start_ms long, end_ms long")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_touching(spark):
    rows = spans(spark, [(1, 0, 10), (1, 10, 20), (1, 30, 40)])
    totals = spark.createDataFrame([(1, 100), (2, 50)], "media_id long, total_ms long")
    assert got(intervals.pad_and_merge(rows, totals, 0)) == [(1, 0, 20), (1, 30, 40)]
    assert got(intervals.merge_strict(rows)) == [(1, 0, 10), (1, 10, 20), (1, 30, 40)]
    assert got(intervals.silence_gaps(rows, totals, 10)) == [(1, 20, 30), (1, 40, 100), (2, 0, 50)]


def test_empty(spark):
    totals = spark.createDataFrame([], "media_id long, total_ms long")
    assert got(intervals.merge_strict(spans(spark, []))) == []
    assert got(intervals.silence_gaps(spans(spark, []), totals, 1)) == []


def test_suppression_keeps_the_first_of_equals(spark):
    cuts = spark.createDataFrame([(1, 0, 10, 5), (1, 1, 11, 5), (1, 50, 60, 1)], "media_id long, start_ms long, end_ms long, score long")
    assert [(r.rank, r.start_ms) for r in selection.suppress_overlaps(cuts, 0.3, 3).orderBy("rank").collect()] == [(1, 0), (2, 50)]


def test_short_media_is_one_shot(spark):
    totals = spark.createDataFrame([(1, 7000)], "media_id long, total_ms long")
    assert [(r.start_ms, r.end_ms, r["mode"]) for r in selection.plan_shots(totals, spans(spark, [])).collect()] == [(0, 7000, "NORMAL")]


def test_text(spark):
    row = spark.range(1).select(
        text.ass_time(F.lit(3_661_005)).alias("t"), text.ass_colour(F.lit("#80FF0001")).alias("c"), text.ass_colour(F.lit("red")).alias("bad"), text.truncate_words(F.lit("abcdefgh ij"), 4).alias("cut"),
        text.hashtags(F.array(F.lit(" a b"), F.lit("#"), F.lit("#a_b"), F.lit(""))).alias("tags"), text.headline(F.lit("one")).alias("one"), text.flag(F.lit(" TRUE ")).alias("yes"),
    ).first()
    assert (row.t, row.c, row.bad, row.cut, row.tags, row.one, row.yes) == ("1:01:01.00", "&H800100FF&", None, "", ["#a_b"], None, True)


def test_stream_quarantines_bad_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"jobId": "j", "uploadId": "u", "filePath": "/f", "createdAt": "t", "attempts": "3"}), json.dumps({"data": {"jobId": "k", "uploadId": "v", "filePath": "/f", "createdAt": "t"}}), "{", "[]"]
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    run_queue(read_queue(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    jobs = spark.read.parquet(str(tmp_path / "out/jobs")).select("job_id", "upload_id", "attempts")
    assert got(jobs) == [("j", "u", 3), ("k", "v", 1)]
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 2


def test_shots_of_a_long_item(spark):
    """One item of many pauses, some of them long and overlapping, against a walk over all pauses at each cut; 100,000 pauses take seconds."""
    import random
    import time

    def plain(total, pauses):
        cuts, at = [0], 0
        while at < total:
            if total - at <= 8000:
                cuts = [*cuts[:-1], total] if len(cuts) > 1 else [0, total]
                break
            low, high, ideal = at + 8000, min(total, at + 15000), min(total, at + 10000)
            near = [(abs((s + e) / 2 - ideal), s, e) for s, e in pauses if low <= e <= high or low <= s <= high]
            cut = min(max(min(near)[2], low), high) if near else ideal
            if total - cut < 8000 and total - at <= 15000:
                cut = total
            cuts.append(cut)
            at = cut
        return list(zip(cuts, cuts[1:]))

    rng = random.Random(2)
    items = {m: (rng.randint(1, 400_000), [(s, s + rng.choice([0, 300, 9_000, 40_000])) for s in (rng.randint(-5_000, 420_000) for _ in range(rng.choice([0, 3, 200])))]) for m in range(40)}
    totals = spark.createDataFrame([(m, t) for m, (t, _) in items.items()], "media_id int, total_ms long")
    pauses = spark.createDataFrame([(m, *p) for m, (_, ps) in items.items() for p in ps], "media_id int, start_ms long, end_ms long")
    got = {}
    for r in selection.plan_shots(totals, pauses).orderBy("media_id", "shot_idx").collect():
        got.setdefault(r.media_id, []).append((r.start_ms, r.end_ms))
    assert got == {m: plain(*x) for m, x in items.items()}
    total = 300_000_000
    many = spark.range(100_000).selectExpr("1 as media_id", "id * 3000 as start_ms", "id * 3000 + 400 as end_ms")
    began = time.perf_counter()
    n = selection.plan_shots(spark.createDataFrame([(1, total)], "media_id int, total_ms long"), many).count()
    assert n > 25_000 and time.perf_counter() - began < 60
