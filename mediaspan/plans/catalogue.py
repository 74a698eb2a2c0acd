"""Queries of the media-timeline operators over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.functions import scores, text
from mediaspan.operators import captions, intervals, selection, signal
from mediaspan.plans import adapters as A
from mediaspan.sources import jobs

QUERIES: dict = {}
SQL: dict = {}

_SPEECH = """speech as (select user_id as media_id, event_id, cast(floor(epoch(ts)) as bigint) - 1704067200 as start_ms,
  cast(floor(epoch(ts)) as bigint) - 1704067200 + cast(floor(value * 1000) as bigint) as end_ms, event_type, value from events),
 totals as (select media_id, max(end_ms) + 1000 as total_ms from speech group by 1)"""
_WORDS = """raw as (select conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') as w from conversations),
 words as (select conv_id as media_id, turn as seg_idx, turn * 1000 + k - 1 as word_idx, w[k] as word, (turn * 1000 + k - 1) * 400 as start_ms, (turn * 1000 + k - 1) * 400 + 350 as end_ms
   from raw, unnest(generate_series(1, len(w))) as t(k)),
 segments as (select media_id, seg_idx, min(start_ms) as start_ms, max(end_ms) as end_ms from words group by all)"""
_SAMPLES = "samples as (select vec_id as media_id, k - 1 as pos, cast(embedding[k] as double) as value from embeddings, unnest(generate_series(1, len(embedding))) as t(k))"
_PADDED = """padded as (select media_id, greatest(0, start_ms - 2000) as start_ms, least(total_ms, end_ms + 2000) as end_ms from speech join totals using (media_id))"""


def _islands(source: str, sign: str) -> str:
    return f"""m as (select *, max(end_ms) over (partition by media_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as b from {source}),
 g as (select *, sum(case when b is null or start_ms {sign} b then 1 else 0 end) over (partition by media_id order by start_ms, end_ms rows unbounded preceding) as i from m),
 islands as (select media_id, min(start_ms) as start_ms, max(end_ms) as end_ms from g group by media_id, i)"""


def query(sql: str | None = None):
    """Register a query, and its SQL if there is one."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {_SPEECH}, {_PADDED}, {_islands('padded', '>')} select * from islands")
def pad_merge(spark: SparkSession, d: str) -> DataFrame:
    return intervals.pad_and_merge(A.speech(spark, d), A.totals(spark, d), 2000)


@query(f"with {_SPEECH}, {_islands('speech', '>=')} select * from islands")
def merge_strict(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_strict(A.speech(spark, d))


_GAPS = """cursor as (select media_id, start_ms, coalesce(max(end_ms) over (partition by media_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding), 0) as b
  from (select media_id, start_ms, end_ms from speech union all select media_id, total_ms, total_ms from totals)), gaps as (select media_id, b as start_ms, start_ms as end_ms from cursor where start_ms - b >= 5000)"""


@query(f"with {_SPEECH}, {_GAPS} select * from gaps")
def silence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return intervals.silence_gaps(A.speech(spark, d), A.totals(spark, d), 5000)


@query(f"""with {_SPEECH}, {_PADDED}, {_islands('padded', '>')}
select media_id, count(*) as segments, sum(end_ms - start_ms)::bigint as speech_ms, greatest(0, any_value(total_ms) - sum(end_ms - start_ms))::bigint as silence_removed_ms from islands join totals using (media_id) group by 1""")
def speech_totals(spark: SparkSession, d: str) -> DataFrame:
    return intervals.speech_totals(pad_merge(spark, d), A.totals(spark, d))


@query(f"""with {_SAMPLES}, probs as (select media_id, pos as win, least(1, greatest(0, 0.5 + 3 * value)) as prob from samples), f as (select *, prob >= 0.6 as on_, prob < 0.45 as low from probs),
r as (select *, sum(on_::int) over (partition by media_id order by win) as run from f), q as (select media_id, run, min(win) filter (on_) as a, min(win) filter (low) as n1, max(win) filter (low) as nk from r where run > 0 group by all),
s as (select *, coalesce((nk - n1) * 32 >= 64, false) as br from q), t as (select *, coalesce(sum(br::int) over (partition by media_id order by run rows between unbounded preceding and 1 preceding), 0) as seg from s),
u as (select media_id, min(a) * 32 as start_ms, coalesce(max(case when br then n1 * 32 end), 2048) as end_ms from t group by media_id, seg) select * from u where end_ms - start_ms >= 96""")
def vad_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    rows = A.samples(spark, d)
    probs = rows.select("media_id", F.col("pos").alias("win"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 3 * F.col("value"))).alias("prob"))
    return signal.hysteresis(probs, rows.select("media_id", F.lit(2048).alias("total_ms")).distinct(), 0.6, 0.45, 32, 96, 64)


_ENERGY = f"""{_SAMPLES}, rms as (select media_id, pos // 4 as win, sqrt(avg(value * value)) as rms from samples group by all),
energy as (select media_id, win, case when max(rms) over (partition by media_id) > 0 then rms / max(rms) over (partition by media_id) else 0 end as energy from rms)"""


def _energy(spark: SparkSession, d: str) -> DataFrame:
    return signal.rms_windows(A.samples(spark, d), 4)


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    totals = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("media_id"), F.lit(3900).alias("total_ms"))
    return signal.energy_peaks(_energy(spark, d), 250, totals)


@query(f"with {_ENERGY} select media_id, win, cast(round(energy * 1000000) as bigint) as energy_millionths from energy")
def rms_energy(spark: SparkSession, d: str) -> DataFrame:
    return _energy(spark, d).select("media_id", "win", F.round(F.col("energy") * 1_000_000).cast("bigint").alias("energy_millionths"))


@query(f"""with {_ENERGY}, n as (select *, lag(energy, 1, 0.0) over w as l, lead(energy, 1, 0.0) over w as r, avg(energy) over p as mean, max(energy) over p as top from energy window w as (partition by media_id order by win), p as (partition by media_id))
select media_id, win * 250 as start_ms, least(3900, (win + 1) * 250) as end_ms, (win * 250 + least(3900, (win + 1) * 250)) // 2 as peak_ms, cast(round(energy * 1000) as bigint) as intensity from n where (energy >= l and energy > r and energy >= greatest(0.30, mean)) or (energy = top and top > 0)""")
def energy_peaks(spark: SparkSession, d: str) -> DataFrame:
    return _peaks(spark, d).select("media_id", "start_ms", "end_ms", "peak_ms", F.round(F.col("energy") * 1000).cast("bigint").alias("intensity"))


@query(f"""with {_ENERGY}, spans as (select distinct media_id, s as span_id, s * 500 as start_ms, s * 500 + 900 as end_ms from samples, unnest(generate_series(0, 6)) as t(s))
select s.media_id, span_id, cast(round(coalesce(avg(energy), 0) * 1000) as bigint) as mean_energy, cast(round(coalesce(max(energy), 0) * 1000) as bigint) as max_energy from spans s left join energy e on e.media_id = s.media_id and e.win >= s.start_ms // 250 and e.win < (s.end_ms + 249) // 250 group by all""")
def window_energy(spark: SparkSession, d: str) -> DataFrame:
    spans = A.samples(spark, d).select("media_id").distinct().withColumn("span_id", F.explode(F.sequence(F.lit(0), F.lit(6)))).selectExpr("media_id", "span_id", "span_id * 500 as start_ms", "span_id * 500 + 900 as end_ms")
    out = signal.span_energy(spans, _energy(spark, d), 250)
    return out.select("media_id", "span_id", F.round(F.col("mean_energy") * 1000).cast("bigint").alias("mean_energy"), F.round(F.col("max_energy") * 1000).cast("bigint").alias("max_energy"))


_POINTS = "points as (select media_id, word_idx as point_id, start_ms + 175 as at_ms from words)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return A.words(spark, d).selectExpr("media_id", "word_idx as point_id", "start_ms + 175 as at_ms")


@query(f"with {_WORDS}, {_POINTS} select p.media_id, point_id, at_ms, min(seg_idx) as seg_idx from points p left join segments s on s.media_id = p.media_id and at_ms >= s.start_ms and at_ms < s.end_ms group by all")
def point_in_segment(spark: SparkSession, d: str) -> DataFrame:
    return intervals.point_in_segment(_points(spark, d), A.segments(spark, d))


@query(f"with {_WORDS} select s.media_id, s.seg_idx, count(*) as words_inside from segments s join words w on w.media_id = s.media_id and w.start_ms >= s.start_ms + 1000 and w.end_ms <= s.end_ms - 1000 group by all")
def word_containment(spark: SparkSession, d: str) -> DataFrame:
    items = A.words(spark, d).selectExpr("media_id", "start_ms as item_start_ms", "end_ms as item_end_ms")
    cuts = A.segments(spark, d).selectExpr("media_id", "seg_idx", "start_ms + 1000 as start_ms", "end_ms - 1000 as end_ms")
    return intervals.contained(items, cuts).groupBy("media_id", "seg_idx").agg(F.count("*").alias("words_inside"))


@query(f"""with {_WORDS}, {_POINTS}, b as (select distinct media_id, start_ms as at_ms from segments union select media_id, end_ms from segments)
select p.media_id, point_id, p.at_ms, x.at_ms as previous_ms, y.at_ms as next_ms from points p
asof left join b x on x.media_id = p.media_id and p.at_ms > x.at_ms asof left join b y on y.media_id = p.media_id and p.at_ms < y.at_ms""")
def boundary_asof(spark: SparkSession, d: str) -> DataFrame:
    segs = A.segments(spark, d)
    bounds = segs.select("media_id", F.col("start_ms").alias("at_ms")).union(segs.select("media_id", "end_ms"))
    return intervals.boundary_asof(_points(spark, d), bounds)


@query(f"""with {_SPEECH} select a.event_id as a_id, b.event_id as b_id, cast(floor(1000000.0 * (least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) / (a.end_ms - a.start_ms + b.end_ms - b.start_ms - (least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)))) as bigint) as iou_millionths
from speech a join speech b on a.media_id = b.media_id and a.event_id < b.event_id and least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms)""")
def temporal_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = intervals.overlapping_pairs(A.speech(spark, d), "event_id", 200_000)
    return pairs.select("a_id", "b_id", F.expr("1000000 * overlap_ms div union_ms").alias("iou_millionths"))  # the ratio times a million may fall below a whole number


def _greedy_sql(source: str, fits: str, keep: int, out: str) -> str:
    """A recursive walk down each item's ranking that carries the kept list."""
    return f"""with recursive {_SPEECH}, c as ({source}), walk as (
 select media_id, 0::bigint as rn, []::struct(s bigint, e bigint, i bigint, score bigint)[] as kept from totals
 union all select w.media_id, c.rn, case when len(kept) < {keep} and len(list_filter(kept, lambda y: not ({fits}))) = 0 then list_append(kept, {{'s': c.s, 'e': c.e, 'i': c.i, 'score': c.score}}) else kept end
 from walk w join c on c.media_id = w.media_id and c.rn = w.rn + 1), last as (select media_id, arg_max(kept, rn) as kept from walk group by 1)
select {out} from last, unnest(generate_series(1, len(kept))) as t(k)"""


@query(_greedy_sql("select media_id, start_ms as s, end_ms as e, event_id as i, cast(floor(value * 100) as bigint) as score, row_number() over (partition by media_id order by floor(value * 100) desc, start_ms, end_ms) as rn from speech",
    "greatest(0, least(y.e, c.e) - greatest(y.s, c.s)) <= 0.3 * ((y.e - y.s) + (c.e - c.s) - greatest(0, least(y.e, c.e) - greatest(y.s, c.s)))", 5, "media_id, k as rank, kept[k].s as start_ms, kept[k].e as end_ms, kept[k].score as score"))
def nms_cuts(spark: SparkSession, d: str) -> DataFrame:
    cuts = A.speech(spark, d).withColumn("score", F.floor(F.col("value") * 100))
    return selection.suppress_overlaps(cuts, 0.3, 5)


@query(_greedy_sql("select media_id, start_ms as s, start_ms as e, event_id as i, cast(floor(value * 100) as bigint) as score, row_number() over (partition by media_id order by floor(value * 100) desc, start_ms, event_id) as rn from speech",
    "abs(y.s - c.s) >= 100000", 4, "media_id, k as rank, kept[k].i as frame_id, kept[k].s as at_ms, kept[k].score as score"))
def keyframe_topn(spark: SparkSession, d: str) -> DataFrame:
    return selection.diverse_frames(A.frames(spark, d).withColumn("score", F.floor(F.col("sharpness") * 100)), 100_000, 4)


@query("""select conv_id, turn, array_to_string(list_slice(w, 1, 4), ' ') as headline from (select conv_id, turn, list_filter(string_split(replace(upper(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))), 'ẞ', 'SS'), ' '), lambda x: x <> '') as w from conversations) where len(w) >= 2""")
def headline_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "conversations").select("conv_id", "turn", text.headline(F.col("text")).alias("headline")).where("headline is not null")


@query(r"""with c as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from conversations) select conv_id, turn, case when length(t) <= 60 then t else regexp_replace(substr(t, 1, 61), '\s*\S*$', '') end as title from c""")
def truncate_title(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "conversations").select("conv_id", "turn", text.truncate_words(F.col("text"), 60).alias("title"))


@query("""select user_id, list_aggregate(list_distinct(list('#' || replace(trim(event_type), ' ', '_'))), 'min') as first_tag, len(list_distinct(list(event_type))) as tags from events group by 1""")
def hashtags(spark: SparkSession, d: str) -> DataFrame:
    tags = A.table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return tags.select("user_id", F.array_min(text.hashtags(F.col("t"))).alias("first_tag"), F.size(text.hashtags(F.col("t"))).cast("bigint").alias("tags"))


@query(r"select page_id, regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g') as name from pages")
def safe_basename(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


_ASS = "cast(cs // 360000 as varchar) || ':' || lpad(cast(cs // 6000 % 60 as varchar), 2, '0') || ':' || lpad(cast(cs // 100 % 60 as varchar), 2, '0') || '.' || lpad(cast(cs % 100 as varchar), 2, '0')"


@query(f"with {_SPEECH}, t as (select event_id, cast(round_even(end_ms / 10, 0) as bigint) as cs from speech) select event_id, {_ASS} as stamp from t")
def ass_time(spark: SparkSession, d: str) -> DataFrame:
    return A.speech(spark, d).select("event_id", text.ass_time(F.col("end_ms")).alias("stamp"))


@query("select o_orderkey, '&H00' || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '&' as colour from (select o_orderkey, lpad(to_hex(o_orderkey * 7919 % 16777216), 6, '0') as h from orders)")
def ass_colour(spark: SparkSession, d: str) -> DataFrame:
    h = F.concat(F.lit("#"), F.lpad(F.hex(F.col("o_orderkey") * 7919 % 16777216), 6, "0"))
    return A.table(spark, d, "orders").select("o_orderkey", text.ass_colour(h).alias("colour"))


@query(f"""with {_WORDS}, n as (select *, (row_number() over (partition by media_id order by word_idx) - 1) // 4 as cue from words)
select media_id, cue, min(start_ms) as start_ms, max(end_ms) as end_ms, string_agg(word, ' ' order by word_idx) as text from n group by all""")
def cue_partition(spark: SparkSession, d: str) -> DataFrame:
    return captions.cues(A.words(spark, d), 4)


@query(f"with {_WORDS} select media_id, word_idx, greatest(0, start_ms - 5000) as start_ms, greatest(greatest(0, start_ms - 5000), end_ms - 5000) as end_ms from words where end_ms > 5000 and start_ms < 60000")
def reindex_words(spark: SparkSession, d: str) -> DataFrame:
    return captions.reindex_words(A.words(spark, d), 5000, 60_000).select("media_id", "word_idx", "start_ms", "end_ms")


_TIME = lambda x: _ASS.replace("cs", f"(cast(round_even({x} / 10, 0) as bigint))")


@query(f"with {_WORDS} select media_id, word_idx, 'Dialogue: 0,' || {_TIME('start_ms')} || ',' || {_TIME('end_ms')} || ',Default,,0,0,0,,' || translate(replace(word, '\\', '\\\\'), '{{}}', '｛｝') as line from words")
def dialogue_lines(spark: SparkSession, d: str) -> DataFrame:
    return A.words(spark, d).select("media_id", "word_idx", text.dialogue(F.col("start_ms"), F.col("end_ms"), text.ass_escape(F.col("word"))).alias("line"))


@query(f"""with {_SPEECH}, f as (select event_id, value as v, event_id * 37 % 256 as lum, event_type from speech)
select event_id, cast(floor(greatest(0, least(1, (v - 80) / 160)) * 1000 + 1e-6) as bigint) as sharp, cast(floor(case when lum < 35 or lum > 225 then 0 else greatest(0, least(1, 0.7 * (1 - 2 * abs((lum - 35) / 190 - 0.5)) + 0.3 * least(v / 80, 1))) end * 1000 + 1e-6) as bigint) as light,
array_to_string(list_filter([case when v < 80 then 'BLURRY' end, case when event_type = 'error' then 'NO_FACE_DETECTED' end, case when lum < 35 then 'DARK' end, case when lum > 225 then 'OVEREXPOSED' end], lambda x: x is not null), ',') as reasons from f""")
def frame_scores(spark: SparkSession, d: str) -> DataFrame:
    lum = F.col("luminance")
    reasons = scores.rejections(F.col("sharpness") < 80, F.lit(False), ~F.col("face"), lum < 35, lum > 225)
    part = lambda c: F.floor(c * 1000 + 1e-6)
    return A.frames(spark, d).select(F.col("frame_id").alias("event_id"), part(scores.sharpness(F.col("sharpness"))).alias("sharp"), part(scores.lighting(lum, F.col("sharpness"))).alias("light"), F.array_join(reasons, ",").alias("reasons"))


@query(f"with {_SPEECH} select media_id, count(*) filter (value < 80) as blurry, count(*) filter (event_type = 'error') as no_face, count(*) filter (event_id * 37 % 256 < 35 or event_id * 37 % 256 > 225) as lighting from speech group by 1")
def rejection_counts(spark: SparkSession, d: str) -> DataFrame:
    lum = F.col("luminance")
    return A.frames(spark, d).groupBy("media_id").agg(F.count_if(F.col("sharpness") < 80).alias("blurry"), F.count_if(~F.col("face")).alias("no_face"), F.count_if((lum < 35) | (lum > 225)).alias("lighting"))


@query(f"with {_SPEECH} select media_id, count(*) as samples, count(*) filter (event_type <> 'error') as detected, cast(coalesce(sum(event_id * 7919 % 1000) filter (event_type <> 'error'), 0) as bigint) as x_thousandths from speech group by 1")
def face_trajectory(spark: SparkSession, d: str) -> DataFrame:
    x = F.round(F.col("x") * 1000).cast("bigint")
    return A.faces(spark, d).groupBy("media_id").agg(F.count("*").alias("samples"), F.count_if("detected").alias("detected"), F.coalesce(F.sum(F.when(F.col("detected"), x)), F.lit(0)).alias("x_thousandths"))


@query(f"""with recursive {_SPEECH}, f as (select media_id, event_id as sample_id, event_id * 7919 % 1000 / 1000.0 as x, event_type <> 'error' as d, row_number() over (partition by media_id order by start_ms, event_id) as rn from speech),
w as (select media_id, 0::bigint as rn, -1::bigint as sample_id, 0::double as ema, 0.5::double as hold, false as seen from totals
 union all select media_id, rn, sample_id, case when d then ne else ema end, case when d and abs(ne - hold) >= 0.03 then ne else hold end, d from (select w.media_id, f.rn, f.sample_id, f.d, w.ema, w.hold, case when w.seen then 0.15 * f.x + 0.85 * w.ema else f.x end as ne from w join f on f.media_id = w.media_id and f.rn = w.rn + 1))
select media_id, sample_id, cast(floor(hold * 1000000 + 1e-4) as bigint) as hold_millionths from w where rn > 0""")
def face_smooth(spark: SparkSession, d: str) -> DataFrame:
    return selection.smooth_track(A.faces(spark, d)).select("media_id", "sample_id", F.floor(F.col("hold") * 1_000_000 + 1e-4).alias("hold_millionths"))


_SHORT = "short as (select media_id, total_ms from totals), pauses as (select media_id, start_ms, start_ms + 400 + event_id % 500 as end_ms from speech)"


def _zoom(spark: SparkSession, d: str) -> DataFrame:
    pauses = A.speech(spark, d).selectExpr("media_id", "start_ms", "start_ms + 400 + event_id % 500 as end_ms")
    return selection.plan_shots(A.totals(spark, d), pauses)


_PLAN = f"""with recursive {_SPEECH}, {_SHORT}, w as (select media_id, total_ms, -1 as idx, 0::bigint as a, 0::bigint as b from short
 union all select media_id, total_ms, idx + 1, b, case when total_ms - b <= 8000 then total_ms when total_ms - c2 <= 8000 then total_ms else c2 end
 from (select *, case when total_ms - c < 8000 and total_ms - b <= 15000 then total_ms else c end as c2 from (select *, case when p is null then least(total_ms, b + 10000) else least(greatest(p, b + 8000), least(total_ms, b + 15000)) end as c from (
  select w.*, (select q.end_ms from pauses q where q.media_id = w.media_id and (q.end_ms between w.b + 8000 and least(total_ms, w.b + 15000) or q.start_ms between w.b + 8000 and least(total_ms, w.b + 15000))
   order by abs((q.start_ms + q.end_ms) / 2 - least(total_ms, w.b + 10000)), q.start_ms, q.end_ms limit 1) as p from w where w.b < w.total_ms)))),
shots as (select media_id, idx as shot_idx, a as start_ms, b as end_ms, case when idx % 2 = 0 then 'NORMAL' else 'ZOOM' end as mode from w where idx >= 0)"""


@query(f"{_PLAN} select * from shots")
def zoom_plan(spark: SparkSession, d: str) -> DataFrame:
    return _zoom(spark, d)


@query(f"{_PLAN} select media_id, count(*) filter (mode = 'ZOOM') as zooms, count(*) filter (mode = 'NORMAL') as normals from shots group by 1")
def zoom_counts(spark: SparkSession, d: str) -> DataFrame:
    return selection.shot_counts(_zoom(spark, d))


_JOBS = """jobs as (select o_orderkey, o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 as valid, 'j' || o_orderkey as j, 'u' || o_orderkey as u,
 case when o_orderkey % 7 = 0 then 1 when o_orderkey % 2 = 0 then o_custkey % 4 else o_custkey % 3 + 1 end::int as n from orders)"""


@query(f"with {_JOBS} select o_orderkey, case when valid then j end as job_id, case when valid then u end as upload_id, case when valid then '/in/' || o_orderkey || '.mp4' end as file_path, case when valid then '2024-01-01T00:00:00Z' end as created_at, n as attempts, valid from jobs")
def job_decode(spark: SparkSession, d: str) -> DataFrame:
    return jobs.decode_jobs(A.jobs(spark, d)).drop("payload")


@query(f"""with {_JOBS} select o_orderkey, '{{{{"to":"AUTO_QA","reason":"{jobs.DONE}","metadata":{{{{"processedVideoPath":"/out/' || u || '.mp4","duration":' || o_orderkey || '.5,"speechSegmentsCount":' || n || ',"silenceRemovedMs":' || o_orderkey * 3
 || ',"loudness":{{{{"integratedLufs":-14.5,"truePeakDbtp":-1.25,"lra":6.5}}}},"dynamicZoomApplied":' || case when n > 1 then 'true' else 'false' end || ',"zoomShotsCount":' || n || case when n > 1 then ',"zoomStrategy":"pauses"' else '' end
 || case when n > 2 then ',"shorts":[{{{{"id":"' || j || '"}}}}]' else '' end || '}}}}}}}}' as payload, 'http://host/api/uploads/' || u || '/transition' as url, cast(500 * pow(2, n - 1) as bigint) as wait_ms from jobs where valid""".replace("{{", "{").replace("}}", "}"))
def success_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.decode_jobs(A.jobs(spark, d)).where("valid")
    n, key = F.col("attempts"), F.col("o_orderkey")
    loud = F.struct(F.lit(-14.5).alias("integratedLufs"), F.lit(-1.25).alias("truePeakDbtp"), F.lit(6.5).alias("lra"))
    shorts = F.when(n > 2, F.array(F.struct(F.col("job_id").alias("id"))))
    report = jobs.success_metadata(F.concat(F.lit("/out/"), F.col("upload_id"), F.lit(".mp4")), (key + 0.5).cast("decimal(20,1)"), n, key * 3, loud, n > 1, n, F.when(n > 1, "pauses"), F.lit(None).cast("string"), F.lit(None).cast("double"), shorts)
    return rows.select("o_orderkey", jobs.success_payload(report).alias("payload"), jobs.transition_url(F.lit("http://host/api//"), F.col("upload_id")).alias("url"), jobs.backoff_ms(n).alias("wait_ms"))


@query(f"""with {_JOBS} select o_orderkey, '{{"to":"FAILED","reason":"{jobs.FAILED}' || o_orderkey || '","metadata":{{"errorCode":"BAD_JOB"' || case when o_orderkey % 2 = 0 then ',"errorType":"WorkerError"' else '' end || ',"errorDetails":"' || o_orderkey || '"'
 || case when o_orderkey % 2 = 0 then '' else ',"errorType":"Parse","stage":"decode"' end || '}}}}' as payload, '{{"orderKey":' || o_orderkey || ',"priority":"' || o_orderpriority || '","attempts":2}}' as again from jobs join orders using (o_orderkey) where not valid""")
def failure_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs.decode_jobs(A.jobs(spark, d)).where("not valid").join(A.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    key = F.col("o_orderkey")
    details = F.when(key % 2 != 0, F.create_map(F.lit("errorType"), F.lit("Parse"), F.lit("stage"), F.lit("decode")))
    job = F.struct(key.alias("orderKey"), F.col("o_orderpriority").alias("priority"))
    return rows.select("o_orderkey", jobs.failure_payload(F.lit("BAD_JOB"), key.cast("string"), details).alias("payload"), jobs.enqueue_payload(job, F.lit(2)).alias("again"))


# The same two by other names, tested against a loop.
def _all_points(spark: SparkSession, d: str) -> DataFrame:
    return A.words(spark, d).selectExpr("media_id", "word_idx as point_id", "start_ms + 175 as at_ms")


def point_in_segment_all(spark: SparkSession, d: str) -> DataFrame:
    return intervals.point_in_segment(_all_points(spark, d), A.segments(spark, d))


def boundary_asof_all(spark: SparkSession, d: str) -> DataFrame:
    segs = A.segments(spark, d)
    return intervals.boundary_asof(_all_points(spark, d), segs.select("media_id", F.col("start_ms").alias("at_ms")).union(segs.select("media_id", "end_ms")))


QUERIES.update({f.__name__: f for f in (point_in_segment_all, boundary_asof_all)})
