"""Transcripts with missing fields, words with and without segments, frames by time, plans with their strategy."""

from mediaspan.operators import captions, decisions, selection


def test_transcripts(spark):
    segments = spark.createDataFrame([(1, 7, "  b \n c ", "2.0005", "1.0"), (1, 3, "a", None, None), (1, 9, None, "3", "4"), (2, 0, " ", "-1", "0.5")], "media_id int, seg_idx int, text string, start string, end string")
    raw = spark.createDataFrame([(1, 2, 7, "c", "2.5", "2.7", "0.5"), (1, 1, 7, "b", "2.1", None, None), (1, 5, 8, "lost", "1", "2", "1"), (1, 6, 7, " ", "1", "2", "1")], "media_id int, word_idx int, seg_idx int, word string, start string, end string, probability string")
    words = captions.clean_words(raw).join(raw.select("media_id", "word_idx", "seg_idx"), ["media_id", "word_idx"])
    got = {r.media_id: r for r in captions.transcripts(segments, words).collect()}
    assert (got[1].text, got[2].text) == ("a\nb c", "")
    assert [(s.id, s.text, s.start_ms, s.end_ms, [w.word for w in s.words]) for s in got[1].segments] == [(0, "a", 0, 0, []), (1, "b c", round(2.0005 * 1000), round(2.0005 * 1000), ["b", "c"]), (2, "", 3000, 4000, [])]
    assert [w.word for w in got[1].words] == ["b", "c"] and got[2].words == []
    assert [(s.start_ms, s.end_ms) for s in got[2].segments] == [(0, 500)]
    rows = captions.transcripts(segments, words)
    flat = rows.select("media_id", captions.flat_words(rows.words, rows.segments).alias("a"), captions.flat_words(captions.F.slice(rows.words, 1, 0), rows.segments).alias("b")).where("media_id = 1").first()
    assert [w.word for w in flat.a] == [w.word for w in flat.b] == ["b", "c"]
    assert captions.transcripts(segments.limit(0), words).count() == 0


def test_frames_and_strategies(spark):
    stamps = spark.createDataFrame([(1, 0), (1, 200), (2, 0), (None, 0)], "media_id int, at_ms long")
    frames = spark.createDataFrame([(1, 200, "x"), (2, 100, "y")], "media_id int, at_ms long, frame string")
    assert sorted((r.media_id or 0, r.at_ms, r.frame or "") for r in decisions.frames_at(stamps, frames).collect()) == [(0, 0, ""), (1, 0, ""), (1, 200, "x"), (2, 0, "")]
    totals = spark.createDataFrame([(1, 40_000), (2, 40_000), (3, 7_000)], "media_id int, total_ms long")
    windows = spark.createDataFrame([(1, 10_000, 20_000), (3, 0, 7_000)], "media_id int, start_ms long, end_ms long")
    rows = selection.planned_shots(totals, windows, windows.limit(0)).collect()
    assert {(r.media_id, r.strategy) for r in rows} == {(1, "gemini"), (2, "heuristic"), (3, "heuristic")}
    assert sorted((r.start_ms, r.end_ms, r["mode"]) for r in rows if r.media_id == 1) == [(0, 10_000, "NORMAL"), (10_000, 20_000, "ZOOM"), (20_000, 35_000, "NORMAL")][:2] + [(20_000, 40_000, "NORMAL")]
    assert [(r.start_ms, r.end_ms) for r in rows if r.media_id == 3] == [(0, 7_000)]
