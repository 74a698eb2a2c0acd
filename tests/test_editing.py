"""Cuts, zoom shots, probes and payloads against plain loops and fixed values."""

import json
import random
from bisect import bisect_left, bisect_right

import pytest
from mediaspan.functions import geometry, loudness, text
from mediaspan.operators import captions, hooks, selection
from mediaspan.sources import jobs, probe
from pyspark.sql import functions as F

SPANS = "media_id long, span_id long, start_ms long, end_ms long"


def walked(a, b, starts, ends, least, most):
    """Step from bound to bound; null if the span cannot be fitted."""
    while not least <= b - a <= most:
        if b - a < least:
            i, j = bisect_left(starts, a) - 1, bisect_right(ends, b)
            if i >= 0 and b - starts[i] <= most:
                a = starts[i]
            elif j < len(ends) and ends[j] - a <= most:
                b = ends[j]
            else:
                return None
        else:
            i, j = bisect_left(ends, b) - 1, bisect_right(starts, a)
            if i >= 0 and ends[i] - a >= least:
                b = ends[i]
            elif j < len(starts) and b - starts[j] >= least:
                a = starts[j]
            else:
                return None
    return a, b


def test_fit(spark):
    rnd, spans, starts, ends, want = random.Random(3), [], [], [], {}
    for media in range(40):
        s, e = (sorted(rnd.sample(range(2000), rnd.randint(0, 12))) for _ in "ab")
        starts += [(media, x) for x in s]
        ends += [(media, x) for x in e]
        for k in range(12):
            a = rnd.randint(0, 1900)
            b = a + rnd.randint(1, 900)
            spans.append((media, k, a, b))
            want[media, k] = walked(a, b, s, e, 200, 400)
    bounds = lambda rows: spark.createDataFrame(rows, "media_id long, at_ms long")
    got = hooks.fit(spark.createDataFrame(spans, SPANS), bounds(starts), bounds(ends), 200, 400).collect()
    assert {(r.media_id, r.span_id): (r.start_ms, r.end_ms) for r in got} == {k: v for k, v in want.items() if v}
    assert any(v is None for v in want.values())


def test_fit_without_bounds(spark):
    none = spark.createDataFrame([], "media_id long, at_ms long")
    got = hooks.fit(spark.createDataFrame([(1, 0, 0, 300), (1, 1, 0, 30)], SPANS), none, none, 200, 400).collect()
    assert [(r.span_id, r.start_ms, r.end_ms) for r in got] == [(0, 0, 300)]


def shots(total, windows, least, most):
    """The shots of one item, one decision at a time."""
    if total <= least:
        return [(0, total, "NORMAL")]
    out, at, queue = [], 0, sorted(windows)
    if not queue:
        return []
    while at < total:
        if total - at <= least:
            if out:
                out[-1] = (out[-1][0], total, out[-1][2])
            else:
                out = [(0, total, "NORMAL")]
            break
        if not queue:
            out.append((at, min(total, at + most), "NORMAL"))
            at = out[-1][1]
            continue
        a, b = max(at, queue[0][0]), min(total, queue[0][1])
        b = min(b, a + most)
        if b <= a:
            queue.pop(0)
            continue
        if a - at < least:
            a = at
            if b - a < least:
                b = min(total, a + least)
        if a > at:
            out.append((at, min(a, at + most), "NORMAL"))
            at = out[-1][1]
            if at < a:
                continue
        if total - b < least:
            b = total
        out.append((a, b, "ZOOM"))
        at = b
        queue.pop(0)
    return out


def test_shots(spark):
    rnd, windows, totals, want = random.Random(5), [], [], {}
    for media in range(120):
        total = rnd.choice([0, 5, 8, 9, 40, 100, 300])
        own = []
        for _ in range(rnd.randint(0, 7)):
            a = rnd.randint(0, max(total, 1))
            own.append((a, a + rnd.randint(1, 20)))
        totals.append((media, total))
        windows += [(media, *w) for w in own]
        want[media] = shots(total, own, 8, 15) if total else []
    got = {media: [] for media in want}
    rows = selection.interleave_shots(spark.createDataFrame(windows, "media_id long, start_ms long, end_ms long"), spark.createDataFrame(totals, "media_id long, total_ms long"), 8, 15)
    for r in rows.orderBy("media_id", "shot_idx").collect():
        got[r.media_id].append((r.start_ms, r.end_ms, r.mode))
    assert got == want


def test_hooks(spark):
    said = "Você sabia ? Mas ninguém te conta o SEGREDO é simples e bom".split()
    words = spark.createDataFrame([(1, k, w, k * 1000, k * 1000 + 900) for k, w in enumerate(said)], "media_id long, word_idx long, word string, start_ms long, end_ms long")
    segments = spark.createDataFrame([(1, 0, 0, 2900), (1, 1, 3000, 6900), (1, 2, 8000, 12000)], "media_id long, seg_idx long, start_ms long, end_ms long")
    got = {r.word_idx: (r.score, r.reason, r.seg_idx) for r in hooks.anchors(words, segments).collect()}
    assert got == {
        0: (0.8, "frase provocativa ('voce sabia')", 0),
        1: (0.65, "palavra de alto impacto ('sabia')", 0),
        2: (0.75, "interrogacao retorica", 0),
        3: (0.75, "quebra adversativa ('mas')", 1),
        4: (0.95, "palavra de alto impacto ('ninguem'); frase provocativa ('ninguem te conta')", 1),
        7: (0.8, "frase provocativa ('o segredo e')", None),
        8: (0.65, "palavra de alto impacto ('segredo')", 2),
    }
    totals = spark.createDataFrame([(1, 13000)], "media_id long, total_ms long")
    cuts = hooks.cuts(words, segments, totals, least_ms=3000, most_ms=8000).orderBy("rank").collect()
    assert [(r.rank, r.start_ms, r.end_ms, r.score) for r in cuts] == [(1, 3000, 6900, 0.815), (2, 8000, 12000, 0.605)]


def test_hooks_of_nothing(spark):
    words = spark.createDataFrame([], "media_id long, word_idx long, word string, start_ms long, end_ms long")
    segments = spark.createDataFrame([], "media_id long, seg_idx long, start_ms long, end_ms long")
    assert hooks.candidates(words, segments).count() == 0 and hooks.snap(spark.createDataFrame([(1, 0, 0, 9)], SPANS), words).count() == 0


def column(spark, values, kind, f):
    return [r.v for r in spark.createDataFrame([(k, x) for k, x in enumerate(values)], f"k int, c {kind}").select("k", f(F.col("c")).alias("v")).orderBy("k").collect()]


def test_text_values(spark):
    assert column(spark, ["Porém,", "ÁÉÎõç!", "a\u0301b", "x-Y 9"], "string", text.fragment) == ["porem", "aeioc", "ab", "xy 9"]
    assert column(spark, ["1.0005", "0.5", "x", None, "-2"], "string", text.to_ms) == [round(1.0005 * 1000), 500, None, None, -2000]
    assert column(spark, ["0.5", "7", "-1", "x", None], "string", text.probability) == [0.5, 1.0, 0.0, 0.0, 0.0]
    assert column(spark, ["x" * 220, "x" * 221], "string", text.clip_text) == ["x" * 220, "x" * 217 + "..."]
    assert column(spark, ["C:\\a'b"], "string", text.filter_path) == ["'C\\:/a”b'"]
    assert column(spark, [5.0, 4.9, 3.0, -3.0], "double", geometry.to_even) == [4, 4, 2, 0]


def test_probe_values(spark):
    assert column(spark, ["30000/1001", "25/1", "0/0", "30", "-5/1", None], "string", probe.frame_rate) == [29.97003, 25.0, None, None, None, None]
    got = column(spark, ["{", "{}", '{"streams":[],"format":{"duration":"x"}}'], "string", probe.media_info)
    assert got[0] is None and [(r.has_video, r.has_audio, r.duration_ms) for r in got[1:]] == [(False, False, 0)] * 2


def test_loudness_values(spark):
    log = 'x {"input_i":"1"} y {"input_i" : "-14.2", "a":"}\\"{","input_tp":"-1.0","input_lra":"3","input_thresh":"-24","o":{"p":1}} z }'
    block = column(spark, [log, "none", '{"input_i": 1', None], "string", loudness.json_block)
    assert json.loads(block[0])["o"] == {"p": 1} and block[1:] == [None] * 3
    assert column(spark, [block[0], '{"input_i":"-inf","input_tp":"1","input_lra":"1","input_thresh":"1"}', '{"input_i":"1"}'], "string", lambda c: loudness.stats(c)["error"]) == [None, "short", "missing"]


def test_job_values(spark):
    job = {"jobId": "j", "uploadId": "u", "filePath": "/f", "createdAt": "t"}
    cases = [
        ({**job, "attempts": "3"}, True, 3), ({**job, "attempts": 3.7}, True, 3), ({**job, "attempts": "3.7", "opts": {"attempts": 2}}, True, 2), ({"data": job, "attempts": None}, True, 1),
        ({**job, "attempts": True}, True, 1), ({**job, "jobId": 5}, False, 1), ({**job, "jobId": None, "data": job}, False, 1), ({"data": "x"}, False, 1), ({**job, "metadata": []}, False, 1), ({**job, "metadata": {}}, True, 1), ([], False, 1),
        ({k: v for k, v in job.items() if k != "filePath"}, False, 1),
    ]
    raw = spark.createDataFrame([(k, json.dumps(c)) for k, (c, _, _) in enumerate(cases)] + [(99, "{"), (100, None)], "k int, payload string")
    got = [(r.valid, r.attempts, r.job_id) for r in jobs.decode_jobs(raw).orderBy("k").collect()]
    assert got == [(ok, n, "j" if ok else None) for _, ok, n in cases] + [(False, 1, None)] * 2


def test_publish_package(spark):
    row = spark.range(1).select(jobs.publish_package(F.lit(""), F.lit("sum"), F.lit(""), F.lit("t"), F.array(F.lit("a b"))).alias("p")).first().p
    assert (row.title, row.description, row.hashtags) == ("sum", "sum\n\nsum\n\n#a_b", ["#a_b"])


@pytest.mark.parametrize("end, counts", [("\n", (1, 3)), ("\r\nDialogue: 1,2\n", (2, 3))])
def test_document_counts(spark, end, counts):
    assert tuple(column(spark, ["Comment: x\nDialogue: 0,a,b,c,,0,0,0,,{\\k5}x y, z"[:-3] + end], "string", captions.document_counts)[0]) == counts
