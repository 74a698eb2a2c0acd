"""Streams against their batch results, for several cuts into micro-batches and after a restart."""

import json
import os
import random
import time

import pandas as pd
import pytest

from mediaspan.operators.selection import smooth_track
from mediaspan.streaming.tracks import smooth_stream

SCHEMA = "media_id string, at_ms long, sample_id long, x double, y double, detected boolean"


def samples(seed):
    rng = random.Random(seed)
    rows = []
    for t in range(90):
        for m in ("a", "b", None):
            if rng.random() < 0.8:
                x = rng.choice([None, 0.2, 0.5, 0.51, 0.9, 1.4, -0.3])
                rows.append({"media_id": m, "at_ms": t * 200 // 3, "sample_id": t, "x": x, "y": rng.random(), "detected": rng.choice([True, True, True, False, None])})
    return rows


def run(spark, folder, out, checkpoint):
    stream = smooth_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder)))
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert not query.isActive and query.exception() is None


def put(folder, k, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{k:04d}.json").write_text("\n".join(json.dumps({a: v for a, v in r.items() if v is not None}) for r in rows))


@pytest.mark.parametrize("cuts", [[], [40, 41, 150]])
def test_smoothing_in_micro_batches(spark, tmp_path, cuts):
    """Any cut gives what one batch gives; the second part comes after a restart from the checkpoint."""
    rows = samples(3)
    edges = [0, *cuts, len(rows)]
    parts = [rows[a:b] for a, b in zip(edges, edges[1:])]
    out, checkpoint = tmp_path / "out", tmp_path / "checkpoint"
    for k, part in enumerate(parts):
        random.Random(k).shuffle(part)
        put(tmp_path / "in", k, part)
        os.utime(tmp_path / "in" / f"{k:04d}.json", (1_000 + k, 1_000 + k))  # files are read by age
        if k in (1, len(parts) - 1):
            run(spark, tmp_path / "in", out, checkpoint)
    got = spark.read.parquet(str(out)).toPandas()
    want = smooth_track(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)).toPandas()
    both = pd.merge(got.fillna({"media_id": ""}), want.fillna({"media_id": ""}), how="outer", on=["sample_id", "media_id"], suffixes=("", "_batch"))
    assert len(both) == len(rows) and not got.late.any()
    assert (both.hold == both.hold_batch).all() and (both.hold_y == both.hold_y_batch).all()


def test_late_samples_change_nothing(spark, tmp_path):
    base = [{"media_id": "a", "at_ms": t, "sample_id": t, "x": 0.5 + t / 100, "y": 0.5, "detected": True} for t in range(20)]
    late = {"media_id": "a", "at_ms": 3, "sample_id": 3, "x": 0.0, "y": 0.0, "detected": True}
    put(tmp_path / "in", 0, base[:10])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint")
    put(tmp_path / "in", 1, [late, *base[10:]])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint")
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("at_ms", "late").collect()
    want = {r.sample_id: r.hold for r in smooth_track(spark.createDataFrame([tuple(r.values()) for r in base], SCHEMA)).collect()}
    assert [r.late for r in got].count(True) == 1
    assert {r.sample_id: r.hold for r in got if not r.late} == want
    assert next(r.hold for r in got if r.late) == want[9]


def test_idle_tracks_begin_anew(spark, tmp_path):
    sample = lambda t, x: {"media_id": "a", "at_ms": t, "sample_id": t, "x": x, "y": 0.5, "detected": True}
    put(tmp_path / "in", 0, [sample(1, 0.9)])
    rows = smooth_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), idle_ms=500)
    query = rows.writeStream.format("memory").queryName("idle_tracks").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        for k in (1, 2):
            end = time.monotonic() + 40
            while spark.table("idle_tracks").count() < k and time.monotonic() < end:
                time.sleep(0.3)
            time.sleep(4)  # several batches without samples
            put(tmp_path / "in", k, [sample(0, 0.1)])
    finally:
        query.stop()
    got = [(r.hold, r.late) for r in spark.table("idle_tracks").orderBy("hold").collect()][:2]
    assert got == [(0.1, False), (0.9, False)]
