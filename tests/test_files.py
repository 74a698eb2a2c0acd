"""WAV files read by ranges against the wave module; files written in two phases."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaspan.operators import audio
from mediaspan.sources.files import keyframe_name, write_files
from mediaspan.sources.wav import WavSource, audio_blocks


def put(path, values, rate, width):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(values.shape[1])
        f.setsampwidth(width)
        f.setframerate(rate)
        raw = values.astype("<i4").tobytes() if width == 4 else values.astype("<i2").tobytes() if width == 2 else values.astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(3, "little", signed=True) for v in values.reshape(-1))
        f.writeframes(raw)


def whole(path):
    """The samples as the wave module gives them."""
    with wave.open(str(path)) as f:
        raw, width, channels = f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels()
    if width == 1:
        v = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        v = np.array([int.from_bytes(raw[i : i + 3], "little", signed=True) for i in range(0, len(raw), 3)]) / 2**23
    else:
        v = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    return v.reshape(-1, channels)


def read(spark, path, **options):
    spark.dataSource.register(WavSource)
    return spark.read.format("pcm_wav").options(**options).load(str(path))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("wav"), np.random.default_rng(1)
    for k, (width, channels, n) in enumerate([(2, 1, 5_000), (1, 2, 777), (3, 2, 1_234), (4, 1, 99), (2, 2, 1)]):
        low, high = (0, 256) if width == 1 else (-(2 ** (8 * width - 1)), 2 ** (8 * width - 1))
        put(at / f"f{k}.wav", rng.integers(low, high, (n, channels)), 8_000 + k, width)
    return at


@pytest.mark.parametrize("split,block", [(500, 100), (1_000, 64), (1 << 25, 1 << 16)])
def test_ranges_of_files(spark, folder, split, block):
    rows = read(spark, folder, splitBytes=split, blockSamples=block)
    assert rows.rdd.getNumPartitions() > (10 if split < 2_000 else 0)
    got = {}
    for r in rows.collect():
        assert r.error is None and (r.media_id, r.channel, r.block) not in got
        got[r.media_id, r.channel, r.block] = r
    for path in sorted(folder.glob("*.wav")):
        want = whole(path)
        for c in range(want.shape[1]):
            own = [got[k] for k in sorted(got) if k[:2] == (str(path), c)]
            assert [r.block for r in own] == list(range(-(-len(want) // block)))
            assert np.array_equal(np.concatenate([r.samples for r in own]), want[:, c])
            assert {(r.n, r.rate) for r in own} == {(len(want), 8_000 + int(path.stem[1:]))}


def test_one_file_is_read_by_several_tasks(spark, folder):
    rows = read(spark, folder / "f0.wav", splitBytes=1_000, blockSamples=100)
    assert rows.where("samples is not null").select(F.spark_partition_id().alias("p")).distinct().count() >= 5


def test_bad_files_give_an_error_row(spark, folder, tmp_path):
    good = (folder / "f0.wav").read_bytes()
    odd = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + good[12:]
    floats = np.array([0.5, -0.25], "<f4").tobytes()
    as_float = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 1, 100, 400, 4, 32) + b"data" + struct.pack("<I", 8) + floats
    mulaw = bytearray(good)
    mulaw[20:22] = struct.pack("<H", 7)
    files = {"empty": b"", "text": b"hello, this is not audio at all", "cut": good[:30], "mulaw": bytes(mulaw), "nodata": good[:44], "truncated": good[: 44 + 200 * 2 + 1], "odd": odd, "float": as_float}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    blocks, errors = audio_blocks(read(spark, tmp_path, splitBytes=64, blockSamples=50))
    assert {r.media_id.rsplit("/", 1)[1]: r.error for r in errors.collect()} == {"empty": "not a RIFF WAVE file", "text": "not a RIFF WAVE file", "cut": "no samples", "mulaw": "format 7 of 16 bits is not PCM", "nodata": "no samples"}
    n = {r.media_id.rsplit("/", 1)[1]: (r.n, r.s) for r in blocks.groupBy("media_id").agg(F.max("n").alias("n"), F.sum(F.size("samples")).alias("s")).collect()}
    assert n == {"truncated": (200, 200), "odd": (5_000, 5_000), "float": (2, 2)}
    with pytest.raises(Exception, match="nowhere"):
        read(spark, tmp_path / "nowhere").collect()


def test_files_go_through_the_operators(spark, folder):
    blocks, _ = audio_blocks(read(spark, folder / "f1.wav", blockSamples=100, mono="true"))
    out = audio.to_samples(audio.resample(blocks, 4_000, 100, filtered=False), 100).orderBy("pos").collect()
    x = whole(folder / "f1.wav").mean(axis=1)
    m = round(len(x) * 4_000 / 8_001)
    assert np.allclose([r.value for r in out], np.interp(np.arange(m) / m, np.arange(len(x)) / len(x), x), atol=1e-12)


def test_one_file_a_row(spark, tmp_path):
    rows = spark.range(30).repartition(4)
    write_files(rows, F.concat(F.lit("cut-"), F.col("id").cast("string"), F.lit(".ass")), F.when(F.col("id") > 0, F.concat(F.lit("é "), F.col("id").cast("string"))), f"file://{tmp_path}/out")
    got = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert got == {f"cut-{i}.ass": f"é {i}" if i else "" for i in range(30)}
    write_files(rows.limit(1), F.lit("cut-0.ass"), F.lit(b"new"), str(tmp_path / "out"), replace=True)
    assert (tmp_path / "out/cut-0.ass").read_text() == "new"
    with pytest.raises(Exception, match="already in"):
        write_files(rows.limit(2), F.concat(F.lit("cut-"), F.col("id").cast("string"), F.lit(".ass")), F.lit("x"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 30


def test_failed_writes_leave_no_file(spark, tmp_path):
    """A task that fails after others have finished, a repeated name within and across tasks, a name that leaves the folder."""
    bad = F.when(F.col("id") == 77, F.raise_error(F.lit("broken row"))).otherwise(F.lit("x"))
    named = F.concat(F.lit("n"), F.col("id").cast("string"))
    cases = [(named, bad), (F.concat(F.lit("n"), (F.col("id") % 50).cast("string")), F.lit("x")), (F.when(F.col("id") == 5, "../up").otherwise(named), F.lit("x")), (F.when(F.col("id") != 5, named), F.lit("x"))]
    for name, content in cases:
        with pytest.raises(Exception):
            write_files(spark.range(100).repartition(5), name, content, str(tmp_path / "out"))
        # tasks that still run when a job fails may leave their staging folder, which Spark's readers ignore
        assert not (tmp_path / "out").exists() or {p.name for p in (tmp_path / "out").iterdir()} <= {"_staging"}
        assert not (tmp_path / "up").exists()


def test_keyframe_names(spark):
    assert spark.range(1).select(keyframe_name(F.lit(1234)), keyframe_name(F.lit(123_456_789))).first()[:] == ("keyframe_0001234ms.png", "keyframe_123456789ms.png")
