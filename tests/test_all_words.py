"""The queries over all words against a plain loop at sf0.001."""

from mediaspan.plans import adapters as A
from mediaspan.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_word_is_a_point(spark):
    words = [tuple(r) for r in A.words(spark, SF).select("media_id", "word_idx", "start_ms").collect()]
    segs = {}
    for r in A.segments(spark, SF).collect():
        segs.setdefault(r.media_id, []).append((r.seg_idx, r.start_ms, r.end_ms))
    inside, around = {}, {}
    for m, k, at in words:
        at += 175
        ends = [x for s in segs[m] for x in s[1:]]
        inside[m, k, at] = min((i for i, a, b in segs[m] if a <= at < b), default=None)
        around[m, k, at] = (max((x for x in ends if x < at), default=None), min((x for x in ends if x > at), default=None))
    assert {(r.media_id, r.point_id, r.at_ms): r.seg_idx for r in QUERIES["point_in_segment_all"](spark, SF).collect()} == inside
    assert {(r.media_id, r.point_id, r.at_ms): (r.previous_ms, r.next_ms) for r in QUERIES["boundary_asof_all"](spark, SF).collect()} == around
