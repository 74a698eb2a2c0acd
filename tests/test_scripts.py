"""Filter texts word for word on small items."""

from pyspark.sql import functions as F

from mediaspan.operators import scripts


def test_splices(spark):
    segments = spark.createDataFrame([(1, 0, 500), (1, 1000, 1510), (1, 1500, 2000), (1, 3000, 3012), (2, 700, 900), (3, 5, 5)], "media_id int, start_ms long, end_ms long")
    items = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "media_id int, has_video boolean")
    got = {r.media_id: r.script for r in scripts.splice_scripts(segments, items).collect()}
    assert set(got) == {1, 2}
    assert got[2] == "[0:a]atrim=start=0.700000:end=0.900000,asetpts=PTS-STARTPTS[a0];\n[a0]concat=n=1:v=0:a=1[outa]\n"
    assert got[1].split(";\n") == [
        "[0:a]atrim=start=0.000000:end=0.500000,asetpts=PTS-STARTPTS,afade=t=out:st=0.485000:d=0.015000:c=iqsin[a0]",
        "[0:v]trim=start=0.000000:end=0.500000,setpts=PTS-STARTPTS[v0]",
        "[0:a]atrim=start=1.000000:end=2.000000,asetpts=PTS-STARTPTS,afade=t=out:st=0.985000:d=0.015000:c=iqsin,afade=t=in:st=0.000000:d=0.015000:c=qsin[a1]",
        "[0:v]trim=start=1.000000:end=2.000000,setpts=PTS-STARTPTS[v1]",
        "[0:a]atrim=start=3.000000:end=3.012000,asetpts=PTS-STARTPTS,afade=t=in:st=0.000000:d=0.006000:c=qsin[a2]",
        "[0:v]trim=start=3.000000:end=3.012000,setpts=PTS-STARTPTS[v2]",
        "[v0][a0][v1][a1][v2][a2]concat=n=3:v=1:a=1[outv][outa]\n",
    ]
    linear = scripts.splice_scripts(segments, items, 0.0, "linear").where("media_id = 1").first().script
    assert "afade" not in linear
    assert scripts.splice_scripts(segments.limit(0), items).count() == 0


def test_more_than_ten_pieces_stay_in_order(spark):
    segments = spark.range(12).select(F.lit(1).alias("media_id"), (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 50).alias("end_ms"))
    text = scripts.splice_scripts(segments, spark.createDataFrame([(1, False)], "media_id int, has_video boolean")).first().script
    assert text.endswith("".join(f"[a{i}]" for i in range(12)) + "concat=n=12:v=0:a=1[outa]\n")


def test_zooms_music_and_frames(spark):
    shots = spark.createDataFrame([(1, 0, 9000, "NORMAL"), (1, 9000, 19500, "ZOOM"), (1, 30000, 40001, "ZOOM"), (2, 0, 5000, "NORMAL")], "media_id int, start_ms long, end_ms long, mode string")
    frames = spark.createDataFrame([(1, 1920, 1080), (2, 1280, 720)], "media_id int, width int, height int")
    got = {r.media_id: r.script for r in scripts.zoom_scripts(shots, frames, 1.2).collect()}
    assert got[1] == "[0:v]split[base][for_zoom];[for_zoom]crop=1600:900:160:0,scale=1920:1080:flags=lanczos[zoomed];[base][zoomed]overlay=0:0:enable='between(t,9.000,19.500)+between(t,30.000,40.001)'[vout]"
    assert got[2] == "[0:v]scale=1280:720:flags=lanczos[vout]"
    assert scripts.zoom_scripts(shots, frames, 1.0).where("media_id = 1").first().script == "[0:v]scale=1920:1080:flags=lanczos[vout]"
    music = spark.createDataFrame([(10_000,), (1_000,)], "t long").select(scripts.ducking_script(F.col("t"), scripts.Ducking(fade_in_ms=0))).collect()
    assert ",afade=t=out:st=8.500:d=1.500,atrim=0:10.000," in music[0][0] and "afade=t=in" not in music[0][0]
    assert ",afade=t=out:st=0.000:d=1.500,atrim=0:1.000," in music[1][0]
    sizes = spark.createDataFrame([(1080, 1920, "SMART_CROP"), (1920, 1080, "SMART_CROP"), (1920, 1080, "AUTO")], "w int, h int, mode string")
    vertical, smart, auto = (r[0] for r in sizes.select(scripts.reframe_script(F.col("w"), F.col("h"), F.col("mode"), F.lit("100.0"))).collect())
    assert vertical == auto == "[0:v]scale=1080:1920:flags=lanczos[vout]"
    assert smart == "[0:v]crop=608:1080:'100.0':0,scale=1080:1920:flags=lanczos[vout]"
