"""Queries of filter texts over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.operators import scripts
from mediaspan.plans import adapters as A
from mediaspan.plans.catalogue import _PLAN, _SPEECH, _islands, _zoom, query


@query(f"""with {_SPEECH}, {_islands('speech', '>=')}, k as (select media_id, start_ms, end_ms, row_number() over w - 1 as i, count(*) over (partition by media_id) as n, least(15.0::double, (end_ms - start_ms) / 2) as fade, media_id % 2 = 0 as video from islands where end_ms > start_ms window w as (partition by media_id order by start_ms, end_ms)),
l as (select *, printf('start=%.6f:end=%.6f', start_ms / 1000, end_ms / 1000) as cut from k),
t as (select media_id, i, n, video, '[0:a]atrim=' || cut || ',asetpts=PTS-STARTPTS' || case when i < n - 1 then printf(',afade=t=out:st=%.6f:d=%.6f:c=iqsin', (end_ms - start_ms - fade) / 1000, fade / 1000) else '' end
 || case when i > 0 then printf(',afade=t=in:st=0.000000:d=%.6f:c=qsin', fade / 1000) else '' end || '[a' || i || ']' || case when video then ';' || chr(10) || '[0:v]trim=' || cut || ',setpts=PTS-STARTPTS[v' || i || ']' else '' end as line, case when video then '[v' || i || ']' else '' end || '[a' || i || ']' as label from l)
select media_id, string_agg(line, ';' || chr(10) order by i) || ';' || chr(10) || string_agg(label, '' order by i) || 'concat=n=' || any_value(n) || case when any_value(video) then ':v=1:a=1[outv][outa]' else ':v=0:a=1[outa]' end || chr(10) as script from t group by 1""")
def splice_scripts(spark: SparkSession, d: str) -> DataFrame:
    return scripts.splice_scripts(A.speech(spark, d), A.totals(spark, d).select("media_id", (F.col("media_id") % 2 == 0).alias("has_video")))


@query(f"""with {_SPEECH} select media_id, '[0:a]{scripts.FORM}[voice];[1:a]{scripts.FORM},volume=-18.0dB,afade=t=in:ss=0:d=1.000' || case when greatest(0, total_ms / 1000 - 1.5) < total_ms / 1000 then printf(',afade=t=out:st=%.3f:d=1.500', greatest(0, total_ms / 1000 - 1.5)) else '' end
 || printf(',atrim=0:%.3f', total_ms / 1000) || ',asetpts=PTS-STARTPTS[bgm_prep];[bgm_prep][voice]sidechaincompress=threshold=0.03:ratio=10.0:attack=30.0:release=500.0:knee=2.8[ducked_bgm];[voice][ducked_bgm]amix=inputs=2:duration=first:dropout_transition=0:normalize=0[aout]' as script from totals""")
def ducking_scripts(spark: SparkSession, d: str) -> DataFrame:
    return A.totals(spark, d).select("media_id", scripts.ducking_script(F.col("total_ms")).alias("script"))


@query(f"""{_PLAN}, f as (select media_id, 640 + media_id % 7 * 101 as w, 360 + media_id % 5 * 77 as h from totals), b as (select media_id, string_agg(printf('between(t,%.3f,%.3f)', start_ms / 1000, end_ms / 1000), '+' order by start_ms) as said from shots where mode = 'ZOOM' group by 1),
c as (select f.*, said, floor(round_even(w / 1.2, 0) / 2)::int * 2 as cw, floor(round_even(h / 1.2, 0) / 2)::int * 2 as ch from f left join b using (media_id))
select media_id, case when said is null then '[0:v]scale=' || w || ':' || h || ':flags=lanczos[vout]' else '[0:v]split[base][for_zoom];[for_zoom]crop=' || cw || ':' || ch || ':' || (floor(round_even(greatest(0, least(w - cw, 0.5::double * w - cw / 2)), 0) / 2)::int * 2) || ':' || (floor(round_even(greatest(0, least(h - ch, 0.4::double * h - ch / 2)), 0) / 2)::int * 2)
 || ',scale=' || w || ':' || h || ':flags=lanczos[zoomed];[base][zoomed]overlay=0:0:enable=' || chr(39) || said || chr(39) || '[vout]' end as script from c""")
def zoom_scripts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("media_id")
    frames = A.totals(spark, d).select("media_id", (640 + k % 7 * 101).alias("width"), (360 + k % 5 * 77).alias("height"))
    return scripts.zoom_scripts(_zoom(spark, d), frames)


_SIZES = "s as (select o_orderkey, 100 + o_orderkey % 1900 as w, 100 + o_custkey % 1900 as h, case o_orderkey % 4 when 0 then 'SMART_CROP' when 1 then 'AESTHETIC_FILL' when 2 then 'AUTO' else 'SMART_CROP' end as mode from orders), t as (select *, w / h >= 0.5625 as wide, greatest(0, floor(round_even(h * 0.5625, 0) / 2)::bigint * 2) as cw, greatest(0, floor(round_even(w / 0.5625, 0) / 2)::bigint * 2) as ch from s)"


@query(f"""with {_SIZES} select o_orderkey, case when w / h <= 0.5625 * 1.1 then '[0:v]scale=1080:1920:flags=lanczos[vout]' when mode = 'AESTHETIC_FILL' then '[0:v]split=2[bg][fg];[bg]scale=1080:1920:force_original_aspect_ratio=increase,crop=1080:1920,boxblur=lr=20:lp=20[bgblur];[fg]scale=1080:1920:force_original_aspect_ratio=decrease[fgfit];[bgblur][fgfit]overlay=(W-w)/2:(H-h)/2[vout]'
when mode = 'SMART_CROP' then '[0:v]crop=' || case when wide then cw else w end || ':' || case when wide then h else ch end || ':' || chr(39) || (o_orderkey % 100) || chr(39) || ':' || ((h - case when wide then h else ch end) // 2) || ',scale=1080:1920:flags=lanczos[vout]' else '[0:v]scale=1080:1920:flags=lanczos[vout]' end as script from t""")
def reframe_scripts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    mode = F.when(k % 4 == 1, "AESTHETIC_FILL").when(k % 4 == 2, "AUTO").otherwise("SMART_CROP")
    return A.table(spark, d, "orders").select("o_orderkey", scripts.reframe_script(k % 1900 + 100, F.col("o_custkey") % 1900 + 100, mode, (k % 100).cast("string")).alias("script"))
