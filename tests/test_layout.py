"""Headline layout against plain Python: wrapping, sizes, zones, the corner that stays free."""

import math
import random

from pyspark.sql import functions as F

from mediaspan.functions import layout

FONT = layout.Font({"a": 500, "b": 700, "W": 1_000, " ": 250}, other=600)


def units(text):
    return sum(FONT.advances.get(c, FONT.other) for c in text)


def wrap(text, size, width):
    lines, current = [], ""
    for word in text.split():
        trial = f"{current} {word}" if current else word
        if not current or units(trial) <= width * 1000 // size:
            current = trial
        else:
            lines.append(current)
            current = word
    return [*lines, current] if current or not lines else lines


def lay(text, zone, largest):
    left, width, top, height = zone
    for size in [*range(largest, 35, -2), 36]:
        lines = wrap(text, size, width)
        high = math.ceil(size * 930 / 1000) + math.ceil(size * 240 / 1000)
        gap = max(1, int(high * 0.18))
        block = high * len(lines) + gap * (len(lines) - 1)
        if max(map(units, lines)) <= width * 1000 // size and block <= height:
            break
    begin = max(0, top + (height - block) // 2)
    wide = [math.ceil(units(x) * size / 1000) for x in lines]
    boxes = [(left + (width - w) // 2, begin + i * (high + gap), left + (width - w) // 2 + w, begin + i * (high + gap) + high) for i, w in enumerate(wide)]
    if max(b[2] for b in boxes) > 1050 and boxes[-1][3] > 600:
        up = boxes[-1][3] - 600
        boxes = [(a, b - up, c, d - up) for a, b, c, d in boxes]
    return size, lines, boxes


def test_layouts(spark):
    rng = random.Random(6)
    rows = [(k, " ".join("".join(rng.choice("abWx") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 14))), (rng.randint(40, 900), rng.randint(1, 700), rng.randint(0, 500), rng.randint(1, 400)), rng.choice([20, 36, 37, 60, 120])) for k in range(150)]
    rows += [(200, "  a \t b\n", (40, 300, 80, 300), 90), (201, "", (40, 300, 80, 300), 90), (202, "W" * 60, (40, 300, 80, 300), 90), (203, "W W W W W W W", (900, 290, 500, 300), 60)]
    df = spark.createDataFrame(rows, "k int, text string, zone struct<left:int,width:int,top:int,height:int>, largest int")
    df = df.withColumn("f", layout.fit_headline(F.col("text"), FONT, F.col("zone"), F.col("largest"))).withColumn("b", layout.headline_boxes(F.col("f"), FONT, F.col("zone")))
    df = df.withColumn("wrapped", layout.wrap_lines(F.col("text"), FONT, F.col("f.size"), F.col("zone.width")))
    for r in df.collect():
        size, lines, boxes = lay(r.text, tuple(r.zone), r.largest)
        assert (r.f["size"], [x.text for x in r.f.lines], r.wrapped) == (size, lines, lines)
        assert [tuple(b) for b in r.b.boxes] == boxes
        assert tuple(r.b.bbox) == (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))


def test_sizes_are_searched_by_halves(spark):
    """A name is measured and wrapped once: from 3,000 down, 1,483 sizes are too large, and a size takes no more than 30 tries. Trying them one by one took minutes."""
    import time

    rows = [(k, " ".join(["abWx"[k % 4] * (k % 9 + 1)] * 40), (40, 400, 80, 300), 3_000) for k in range(3_000)]
    df = spark.createDataFrame(rows, "k int, text string, zone struct<left:int,width:int,top:int,height:int>, largest int").repartition(4)
    began = time.time()
    got = df.select("k", layout.fit_headline(F.col("text"), FONT, F.col("zone"), F.col("largest")).alias("f")).collect()
    assert time.time() - began < 60
    for r in got[::100]:
        size, lines, _ = lay(rows[r.k][1], rows[r.k][2], 3_000)
        assert (r.f["size"], [x.text for x in r.f.lines]) == (size, lines)


def test_layouts_of_nothing(spark):
    """No words, no largest size and a largest one below the smallest."""
    rows = [(None, 90), ("a b", None), ("a b", 20), (" ", 36)]
    df = spark.createDataFrame([(t, (40, 300, 80, 300), n) for t, n in rows], "text string, zone struct<left:int,width:int,top:int,height:int>, largest int")
    got = [r.f["size"] for r in df.select(layout.fit_headline(F.col("text"), FONT, F.col("zone"), F.col("largest")).alias("f")).collect()]
    assert got == [36, 36, 36, 36]


def test_headlines_are_dealt_to_all_cores(spark):
    from mediaspan.plans import headlines

    assert headlines.headline_layout(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_zones_and_places(spark):
    rows = [("right", 600, 300), ("right", None, None), ("right", 20, 300), ("left", 30, 280), ("left", None, None), ("left", 30, None), ("left", 1_200, 500)]
    df = spark.createDataFrame(rows, "side string, x int, w int")
    zone = layout.headline_zone(F.lit(1280), F.lit(720), F.col("side"), F.col("x"), F.col("w"))
    got = [tuple(r[0]) for r in df.select(zone).collect()]
    assert got == [(40, 520, 86, 360), (40, 773, 86, 360), (40, 1, 86, 360), (350, 660, 86, 360), (435, 575, 86, 360), (435, 575, 86, 360), (1740, 1, 86, 360)]
    sizes = spark.createDataFrame([("right", 500), ("left", 500), ("right", 1_400), ("left", 1_400)], "side string, w int")
    at = layout.place_subject(F.col("side"), F.col("w"), F.lit(700), F.lit(1280), F.lit(720), F.lit(60))
    assert [tuple(r[0]) for r in sizes.select(at).collect()] == [(720, 20), (60, 20), (0, 20), (0, 20)]
