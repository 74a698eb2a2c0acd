"""Logs and probe texts are made and parsed once for all of a row's fields; odd texts give what they gave when each field had a parse of its own."""

import json
import re

import pytest
from mediaspan.functions import loudness
from mediaspan.sources import probe
from pyspark.sql import functions as F

FIELDS = ("input_i", "input_tp", "input_lra", "input_thresh", "target_offset")


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def values(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, c string").select("k", f(F.col("c")).alias("v"))
    return [r.v for r in rows.orderBy("k").collect()]


def test_log_is_named_once(spark):
    log = F.concat(F.lit("made here"), F.col("id").cast("string"))
    rows = spark.range(3).select(loudness.json_block(log).alias("block")).where("block is not null")
    named = [line.count("made here") for line in plan(rows).splitlines() if "made here" in line]
    assert named and max(named) == 1


def test_block_is_parsed_once(spark):
    rows = spark.createDataFrame([("{}",)], "c string").select(loudness.stats(F.col("c")).alias("s"))
    parses = set(re.findall(r"from_json\(.*?, c#", plan(rows)))
    assert len(parses) == 1 and all(f in next(iter(parses)) for f in FIELDS)


@pytest.mark.parametrize("log, block", [
    (None, None), ("", None), ('"input_i"', None), ('"input_i" {}', None), ('{"input_i":1', None), ('{"input_i" {"input_i":1} } z', '{"input_i":1}'),
    ('{"input_i":1, "input_i":2}', '{"input_i":1, "input_i":2}'), ('{"input_i":1} {"input_i"', None), ('{ "input_i"input_i"}', '{ "input_i"input_i"}'), ('a {b "input_i"\n"}\\"" {x} }}', '{b "input_i"\n"}\\"" {x} }'),
    ('{"input_i":"é😀"} {done}', '{"input_i":"é😀"}'), ('{"input_i": {"a": {}} }', None), ('{"input_i":1} ' * 2000 + "{" * 2000, '{"input_i":1}'),
])
def test_blocks_of_odd_logs(spark, log, block):
    assert values(spark, [log], loudness.json_block) == [block]


def test_key_is_no_pattern(spark):
    assert values(spark, ['{"k.*":1}', '{"kxx":1}'], lambda c: loudness.json_block(c, "k.*")) == ['{"k.*":1}', None]


def test_stats_of_odd_blocks(spark):
    whole = '"input_i":"-14.2","input_tp":"-1","input_lra":3,"input_thresh":"-24"'
    cases = {
        "{" + whole + "}": (-14.2, -1.0, 3.0, -24.0, 0.0, None), "{" + whole + ',"target_offset":"0.5"} rest': (-14.2, -1.0, 3.0, -24.0, 0.5, None), "{" + whole + ',"target_offset":null}': (-14.2, -1.0, 3.0, -24.0, 0.0, None),
        "{" + whole + ',"target_offset":"x"}': (-14.2, -1.0, 3.0, -24.0, None, "missing"), "{" + whole + ',"input_i":"inf"}': (float("inf"), -1.0, 3.0, -24.0, 0.0, "short"), "{" + whole + ',"input_i":true}': (None, -1.0, 3.0, -24.0, 0.0, "missing"),
        # broken texts have no fields, wherever they break; a field named as the parser's own changes nothing
        "{" + whole + ',"target_offset":abc}': (None, None, None, None, 0.0, "missing"), "{" + whole + ',"note":abc}': (None, None, None, None, 0.0, "missing"), "{" + whole: (None, None, None, None, 0.0, "missing"),
        "{" + whole + ',"_broken":"x"}': (-14.2, -1.0, 3.0, -24.0, 0.0, None), "": (None, None, None, None, 0.0, "missing"), "[1]": (None, None, None, None, 0.0, "missing"),
    }
    assert [tuple(r) for r in values(spark, [*cases, None], loudness.stats)] == [*cases.values(), (None, None, None, None, 0.0, "missing")]


def test_streams_are_parsed_once(spark):
    text = plan(spark.createDataFrame([("{}",)], "c string").select(probe.media_info(F.col("c")).alias("i")))
    assert text.count("from_json(StructField(streams") == text.count("from_json(StructField(format") == 1


def test_probes_of_odd_texts(spark):
    film = {"codec_type": "video", "codec_name": "h264", "width": " 7 ", "height": "x", "r_frame_rate": "0/0", "avg_frame_rate": "25/1", "duration": "1.2345"}
    sound = {"codec_type": "audio", "codec_name": "aac", "sample_rate": 48000, "channels": "2", "duration": ""}
    cover = {**film, "disposition": {"attached_pic": 1}}
    nothing = (False, False, *[None] * 7, 0, None, None)
    seen, heard = (True, False, 25.0, 7, None, "h264", None, None, None, 1234, 1234, None), (False, True, None, None, None, None, "aac", 48000, 2, 0, None, None)
    cases = [
        ({"streams": [film, cover, {**film, "width": 9}]}, seen), ({"streams": [sound, {**sound, "channels": 9}], "format": {"duration": ""}}, heard), ({"streams": [cover, film]}, nothing),
        ({"streams": [film, sound], "format": {"duration": "2.5"}}, (True, True, 25.0, 7, None, "h264", "aac", 48000, 2, 2500, 1234, None)), ({"streams": [None, {"codec_type": None}, {}, sound]}, heard), ({"streams": None, "format": "x"}, nothing),
        ({"streams": [1, film], "format": {"duration": "2"}}, (*nothing[:9], 2000, None, None)), ({"streams": {}, "format": {"duration": 3}}, (*nothing[:9], 3000, None, None)), (5, nothing), ([], nothing), (None, nothing),
    ]
    assert [tuple(r) for r in values(spark, [json.dumps(c) for c, _ in cases], probe.media_info)] == [want for _, want in cases]
    assert values(spark, [None, "", " ", "{", '{"streams":[}'], probe.media_info) == [None] * 5
