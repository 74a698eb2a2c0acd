"""Queries of cut, zoom, caption, probe and frame operators over the test tables, and the same in DuckDB's SQL. The SQL walks, where the operators look up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.functions import geometry, loudness, scores, text
from mediaspan.operators import captions, hooks, intervals, selection, signal
from mediaspan.plans import adapters as A
from mediaspan.plans.catalogue import SQL, _ENERGY, _GAPS, _SAMPLES, _SPEECH, _TIME, _WORDS, _energy, _peaks, query
from mediaspan.sources import probe

#: Words of the test texts in the place of the hook words.
LISTS = {"adversatives": ("and", "of", "to"), "impact": ("that", "was", "haat", "tion"), "phrases": ("of the", "in the", "is to", "to the end", "that it was a")}
_IN = {k: "(" + ", ".join(f"'{w}'" for w in v) + ")" for k, v in LISTS.items()}
_PHRASE = " ".join(f"when len(a) >= {k} and array_to_string(list_slice(a, 1, {k}), ' ') in {_IN['phrases']} then array_to_string(list_slice(a, 1, {k}), ' ')" for k in (2, 3, 4))
_ANCHORS = f"""tok as (select *, list_filter(regexp_split_to_array(lower(regexp_replace(strip_accents(word), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')), '\\s+'), lambda x: x <> '') as t from words),
 ahead as (select *, list_concat(t, list_concat(coalesce(lead(t, 1) over o, []), list_concat(coalesce(lead(t, 2) over o, []), coalesce(lead(t, 3) over o, [])))) as a from tok window o as (partition by media_id order by word_idx)),
 marks as (select *, contains(word, '?') as q, case when t[1] in {_IN['adversatives']} then t[1] end as adv, list_filter(t, lambda x: x in {_IN['impact']})[1] as imp, case {_PHRASE} end as phr from ahead),
 anchors as (select m.media_id, m.word_idx, m.word, m.start_ms, m.end_ms, round(least(1, 0.5 + case when q then 0.25 else 0 end + case when adv is null then 0 else 0.25 end + case when imp is null then 0 else 0.15 end + case when phr is null then 0 else 0.3 end), 6) as score,
  concat_ws('; ', case when q then 'interrogacao retorica' end, 'quebra adversativa (''' || adv || ''')', 'palavra de alto impacto (''' || imp || ''')', 'frase provocativa (''' || phr || ''')') as reason, s.seg_idx
  from marks m left join segments s on s.media_id = m.media_id and m.start_ms >= s.start_ms and m.start_ms < s.end_ms where q or adv is not null or imp is not null or phr is not null)"""
_micro = lambda c, name: F.round(c * 1_000_000).cast("bigint").alias(name)


@query(f"with {_WORDS}, {_ANCHORS} select media_id, word_idx, word, start_ms, end_ms, cast(round(score * 1000000) as bigint) as score, reason, seg_idx from anchors")
def hook_anchors(spark: SparkSession, d: str) -> DataFrame:
    return hooks.anchors(A.words(spark, d), A.segments(spark, d), **LISTS).withColumn("score", F.round(F.col("score") * 1_000_000).cast("bigint"))


_MEETS = "e.win >= s.start_ms // 250 and e.win < (s.end_ms + 249) // 250"


@query(f"""with {_WORDS}, {_ANCHORS}, {_ENERGY}, best as (select *, row_number() over (partition by media_id, seg_idx order by score desc, word_idx) as k from anchors),
top as (select b.media_id, b.seg_idx as span_id, s.start_ms, s.end_ms, b.reason, b.score, coalesce(max(energy), 0) as e from best b join segments s using (media_id, seg_idx) left join energy e on e.media_id = b.media_id and {_MEETS} where k = 1 group by all)
select media_id, span_id, start_ms, end_ms, reason, cast(round(least(1, score + case when e >= 0.85 then 0.15 when e >= 0.6 then 0.1 else 0 end) * 1000000) as bigint) as confidence from top""")
def hook_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = hooks.candidates(A.words(spark, d), A.segments(spark, d), _energy(spark, d), **LISTS)
    return rows.withColumn("confidence", F.round(F.col("confidence") * 1_000_000).cast("bigint"))


_SPANS = "spans as (select media_id, seg_idx as span_id, start_ms + 137 as start_ms, start_ms + 137 + (seg_idx + 1) * 2500 as end_ms from segments)"
_SNAP = """near as (select s.media_id, span_id, min(w.start_ms) filter (w.end_ms > s.start_ms) as a, max(w.start_ms) as z, max(w.start_ms) filter (w.start_ms < s.end_ms) as b from spans s join words w using (media_id) group by all),
 snapped as (select media_id, span_id, coalesce(a, z) as a, greatest(coalesce(a, z), coalesce(b, 0)) as b from near)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return A.segments(spark, d).selectExpr("media_id", "seg_idx as span_id", "start_ms + 137 as start_ms", "start_ms + 137 + (seg_idx + 1) * 2500 as end_ms")


@query(f"""with {_WORDS}, {_SPANS}, {_SNAP} select n.media_id, span_id, coalesce(x.start_ms, n.a) as start_ms, coalesce(y.end_ms, n.b + 350) as end_ms from snapped n
left join segments x on x.media_id = n.media_id and n.a >= x.start_ms and n.a < x.end_ms left join segments y on y.media_id = n.media_id and n.b >= y.start_ms and n.b < y.end_ms""")
def snap_spans(spark: SparkSession, d: str) -> DataFrame:
    return hooks.snap(_spans(spark, d), A.words(spark, d), A.segments(spark, d))


@query(f"""with recursive {_WORDS}, {_SPANS}, {_SNAP}, walk as (select media_id, span_id, a, b + 350 as b, 0 as k from snapped
 union all select media_id, span_id, case when b - a < 4000 then case when b - ps <= 7000 then ps else a end when pe - a >= 4000 then a else ns end,
  case when b - a < 4000 then case when b - ps <= 7000 then b else ne end when pe - a >= 4000 then pe else b end, k + 1 from (select w.*,
  (select max(x.start_ms) from words x where x.media_id = w.media_id and x.start_ms < w.a) as ps, (select min(x.end_ms) from words x where x.media_id = w.media_id and x.end_ms > w.b) as ne,
  (select max(x.end_ms) from words x where x.media_id = w.media_id and x.end_ms < w.b) as pe, (select min(x.start_ms) from words x where x.media_id = w.media_id and x.start_ms > w.a) as ns from walk w)
 where (b - a < 4000 and (b - ps <= 7000 or ne - a <= 7000)) or (b - a > 7000 and (pe - a >= 4000 or b - ns >= 4000)))
select media_id, span_id, a as start_ms, b as end_ms from walk where b - a between 4000 and 7000""")
def fit_spans(spark: SparkSession, d: str) -> DataFrame:
    words = A.words(spark, d)
    starts, ends = words.select("media_id", F.col("start_ms").alias("at_ms")), words.select("media_id", F.col("end_ms").alias("at_ms"))
    return hooks.fit(hooks.snap(_spans(spark, d), words), starts.distinct(), ends.distinct(), 4000, 7000)


@query(f"""with {_WORDS}, {_ENERGY}, s as (select media_id, seg_idx as span_id, start_ms, end_ms, 0.5 + seg_idx % 5 / 10.0 as c from segments),
held as (select s.media_id, span_id, s.start_ms, s.end_ms, c, count(*) as n_words, string_agg(word, ' ' order by word_idx) as t, coalesce(string_agg(word, ' ' order by word_idx) filter (w.end_ms <= s.start_ms + 5000), '') as hook_text from s join words w on w.media_id = s.media_id and w.start_ms >= s.start_ms and w.end_ms <= s.end_ms group by all),
e as (select s.media_id, span_id, coalesce(max(energy), 0) as e from s left join energy e on e.media_id = s.media_id and {_MEETS} group by all)
select media_id, span_id, start_ms, end_ms, n_words, case when length(t) > 220 then substr(t, 1, 217) || '...' else t end as text, hook_text, cast(round(c * 1000000) as bigint) as semantic, cast(round((0.7 * c + 0.3 * e) * 1000000) as bigint) as score from held join e using (media_id, span_id) where 0.7 * c + 0.3 * e >= 0.6""")
def cut_scores(spark: SparkSession, d: str) -> DataFrame:
    spans = A.segments(spark, d).select("media_id", F.col("seg_idx").alias("span_id"), "start_ms", "end_ms", (F.lit(0.5) + F.col("seg_idx") % 5 / 10.0).alias("confidence"))
    rows = hooks.scored(spans, A.words(spark, d), _energy(spark, d))
    return rows.select("media_id", "span_id", "start_ms", "end_ms", "n_words", "text", "hook_text", _micro(F.col("semantic_score"), "semantic"), _micro(F.col("score"), "score"))


# Tested against a loop on a small fixture.
@query()
def hook_cuts(spark: SparkSession, d: str) -> DataFrame:
    words, segments = A.words(spark, d), A.segments(spark, d)
    totals = words.groupBy("media_id").agg(F.max("end_ms").alias("total_ms"))
    return hooks.cuts(words, segments, totals, _energy(spark, d), least_ms=4000, most_ms=30_000, **LISTS)


@query(f"""with {_ENERGY}, n as (select *, lag(energy, 1, 0.0) over w as l, lead(energy, 1, 0.0) over w as r, avg(energy) over p as mean, max(energy) over p as top from energy window w as (partition by media_id order by win), p as (partition by media_id)),
peaks as (select media_id, win * 250 as a, least(3900, (win + 1) * 250) as b, round(energy, 6) as i from n where (energy >= l and energy > r and energy >= greatest(0.30, mean)) or (energy = top and top > 0)),
spans as (select vec_id as media_id, s as span_id, s * 600 as x, s * 600 + 1500 as y from embeddings, unnest(generate_series(0, 5)) as t(s))
select media_id, span_id, (a + b) // 2 as peak_ms from (select p.media_id, span_id, a, b, row_number() over (partition by p.media_id, span_id order by i desc, a) as k from spans s join peaks p on p.media_id = s.media_id and a >= x and b <= y) where k = 1""")
def strongest_peaks(spark: SparkSession, d: str) -> DataFrame:
    spans = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("media_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("span_id")).selectExpr("*", "span_id * 600 as start_ms", "span_id * 600 + 1500 as end_ms")
    return hooks.strongest_peak(spans, _peaks(spark, d)).drop("intensity")


@query(f"""with {_SAMPLES}, spans as (select vec_id as media_id, s as span_id, s * 500 - 100 as a, s * 500 + 333 as b from embeddings, unnest(generate_series(1, 6)) as t(s))
select s.media_id, span_id, coalesce(cast(round(avg(prob) * 1000) as bigint), -1) as confidence from spans s left join (select media_id, pos, least(1, greatest(0, 0.5 + 3 * value)) as prob from samples) p on p.media_id = s.media_id and pos >= a // 32 and pos < (b + 31) // 32 group by all""")
def bound_confidence(spark: SparkSession, d: str) -> DataFrame:
    probs = A.samples(spark, d).select("media_id", F.col("pos").alias("win"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 3 * F.col("value"))).alias("prob"))
    spans = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("media_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("span_id")).selectExpr("*", "span_id * 500 - 100 as start_ms", "span_id * 500 + 333 as end_ms")
    return signal.bound_confidence(spans, probs).select("media_id", "span_id", F.coalesce(F.round(F.col("confidence") * 1000).cast("bigint"), F.lit(-1)).alias("confidence"))


_WINDOWS = """w0 as (select media_id, total_ms, greatest(0, start_ms) as s, least(total_ms, end_ms) as e from speech join totals using (media_id)),
 w1 as (select *, case when e - s < 8000 then greatest(0, (s + e) // 2 - 4000) when e - s > 15000 then greatest(0, (s + e) // 2 - 7500) else s end as a from w0 where e > s),
 w2 as (select *, case when e - s < 8000 then least(total_ms, a + 8000) when e - s > 15000 then least(total_ms, a + 15000) else e end as b from w1),
 w3 as (select media_id, case when e - s < 8000 and b - a < 8000 and a > 0 then greatest(0, total_ms - 8000) else a end as a, case when e - s < 8000 and b - a < 8000 and a = 0 then least(total_ms, 8000) else b end as b from w2),
 w4 as (select *, row_number() over (partition by media_id order by a, b) as rn from w3 where b - a >= 8000),
 fold as (select media_id, rn, a, b from w4 where rn = 1 union all select f.media_id, f.rn, case when f.a < w.b then w.a else f.a end, case when f.a < w.b then least(greatest(w.b, f.b), w.a + 15000) else f.b end from fold w join w4 f on f.media_id = w.media_id and f.rn = w.rn + 1),
 windows as (select media_id, a as start_ms, max(b) as end_ms from fold group by all)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return selection.fit_windows(A.speech(spark, d), A.totals(spark, d), 8000, 15_000)


@query(f"with recursive {_SPEECH}, {_WINDOWS} select * from windows")
def zoom_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    pauses = intervals.silence_gaps(A.speech(spark, d), A.totals(spark, d), 5000)
    return intervals.align_to_pauses(_windows(spark, d).withColumn("span_id", F.col("start_ms")), pauses, A.totals(spark, d), 8000)


@query(f"""with recursive {_SPEECH}, {_WINDOWS}, {_GAPS}, near as (select w.media_id, w.start_ms, w.end_ms, total_ms, max(g.end_ms) filter (w.start_ms - g.end_ms between 0 and 8000) as a, min(g.start_ms) filter (g.start_ms - w.end_ms between 0 and 8000) as b
 from windows w join totals using (media_id) left join gaps g on g.media_id = w.media_id group by all), moved as (select *, coalesce(a, start_ms) as x, case when b is null then end_ms else least(total_ms, b) end as y from near)
select media_id, start_ms as span_id, case when y > x then x else start_ms end as start_ms, case when y > x then y else end_ms end as end_ms from moved""")
def zoom_aligned(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d)


# A walk from shot to shot: each row of ``w`` is a shot and the number of the window that is next.
@query(f"""with recursive {_SPEECH}, al as ({SQL["zoom_aligned"]}), win as (select media_id, start_ms as a, end_ms as b, row_number() over (partition by media_id order by start_ms, end_ms) as n from al),
it as (select media_id, total_ms as t, count(n) as m from totals left join win using (media_id) group by all),
w as (select media_id, t, m, 1 as n, 0::bigint as pos, null::bigint as a, null::bigint as b, '' as mode from it where m > 0 and t > 8000
 union all select media_id, t, m, case when kind in ('skip', 'zoom') then n + 1 else n end, case kind when 'skip' then pos when 'lead' then least(s, pos + 15000) when 'fill' then least(t, pos + 15000) else case when t - z < 8000 then t else z end end,
  case when kind = 'skip' then null else pos end, case kind when 'skip' then null when 'lead' then least(s, pos + 15000) when 'fill' then least(t, pos + 15000) else case when t - z < 8000 then t else z end end, case when kind = 'zoom' then 'ZOOM' else 'NORMAL' end
 from (select *, case when s - pos < 8000 and e - pos < 8000 then least(t, pos + 8000) else e end as z, case when wa is null then 'fill' when e <= s then 'skip' when s - pos >= 8000 then 'lead' else 'zoom' end as kind
  from (select w.*, win.a as wa, greatest(pos, win.a) as s, least(t, win.b, greatest(pos, win.a) + 15000) as e from w left join win on win.media_id = w.media_id and win.n = w.n) where t - pos > 8000 or (wa is not null and pos = wa and mode = 'NORMAL' and pos < t))),
sh as (select media_id, t, a, b, mode from w where a is not null union all select media_id, t, 0, t, 'NORMAL' from it where t <= 8000 and t > 0)
select media_id, row_number() over (partition by media_id order by a) - 1 as shot_idx, a as start_ms, case when lead(a) over (partition by media_id order by a) is null then t else b end as end_ms, mode from sh""")
def semantic_shots(spark: SparkSession, d: str) -> DataFrame:
    return selection.interleave_shots(_aligned(spark, d), A.totals(spark, d), 8000, 15_000)


# Every third item has no zoom window.
@query(f"""with sem as ({SQL["semantic_shots"]}), heu as ({SQL["zoom_plan"]})
select *, 'gemini' as strategy from sem where media_id % 3 > 0 and media_id in (select media_id from ({SQL["zoom_aligned"]})) and media_id not in (select user_id from events group by 1 having max(floor(epoch(ts))::bigint - 1704067200 + floor(value * 1000)::bigint) + 1000 <= 8000)
union all select *, 'heuristic' from heu where media_id % 3 = 0 or media_id not in (select media_id from ({SQL["zoom_aligned"]})) or media_id in (select user_id from events group by 1 having max(floor(epoch(ts))::bigint - 1704067200 + floor(value * 1000)::bigint) + 1000 <= 8000)""")
def zoom_strategies(spark: SparkSession, d: str) -> DataFrame:
    pauses = A.speech(spark, d).selectExpr("media_id", "start_ms", "start_ms + 400 + event_id % 500 as end_ms")
    return selection.planned_shots(A.totals(spark, d), _aligned(spark, d).where("media_id % 3 > 0"), pauses)


@query("""with t as (select conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as said, greatest(0, (turn * 1500 - 700))::bigint as a, case when turn % 3 > 0 then turn * 1500 + 200 end as b from conversations),
s as (select *, row_number() over (partition by conv_id order by turn) - 1 as i, greatest(a, coalesce(b, a))::bigint as e from t)
select conv_id as media_id, coalesce(string_agg(said, chr(10) order by turn) filter (said <> ''), '') as text, string_agg(i || ':' || a || '-' || e, ',' order by turn) as spans, sum(case when said = '' or turn % 2 = 1 then 0 else 1 end)::bigint as words from s group by 1""")
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcripts: every other turn has one word, its text as a whole."""
    turns = A.table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_idx"), "text", (F.col("turn") * 1.5 - 0.7).alias("start"), F.when(F.col("turn") % 3 > 0, F.col("turn") * 1.5 + 0.2).alias("end"))
    spoken = turns.where("seg_idx % 2 = 0").select("media_id", F.col("seg_idx").alias("word_idx"), F.col("text").alias("word"), F.abs("start").alias("start"), "end", F.lit(1.0).alias("probability"))
    words = captions.clean_words(spoken).withColumn("seg_idx", F.col("word_idx"))
    rows = captions.transcripts(turns, words)
    spans = F.array_join(F.transform("segments", lambda s: F.concat_ws("", s["id"], F.lit(":"), s["start_ms"], F.lit("-"), s["end_ms"])), ",")
    return rows.select("media_id", "text", spans.alias("spans"), F.size(captions.flat_words(F.col("words"), F.col("segments"))).cast("bigint").alias("words"))


def _probes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    k, when, say = key.cast("string"), F.when, F.lit
    video = F.concat(say('{"codec_type":"video","codec_name":"h264","width":'), (key % 1900 + 100).cast("string"), say(',"height":720,"r_frame_rate":"'), when(key % 4 == 1, "0/0").otherwise("30000/1001"), say('","avg_frame_rate":"25/1","duration":"'), k, say('.25","disposition":{"attached_pic":'), (key % 9 == 1).cast("int").cast("string"), say("}}"))
    audio = F.concat(say('{"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":2,"duration":"'), (key + 1).cast("string"), say('.0005"}'))
    streams = F.array_join(F.array_compact(F.array(when(key % 3 != 0, video), when(key % 5 != 0, audio))), ",")
    raw = F.concat(say('{"streams":['), streams, say('],"format":{"format_name":"mp4"'), when(key % 2 == 0, F.concat(say(',"duration":"'), k, say('.1234"'))).otherwise(""), say("}}"))
    return A.table(spark, d, "orders").select("o_orderkey", when(key % 17 == 0, F.left(raw, F.lit(12))).otherwise(raw).alias("raw"))


@query("""with b as (select o_orderkey as k, o_orderkey % 3 <> 0 and o_orderkey % 9 <> 1 as v, o_orderkey % 5 <> 0 as s from orders where o_orderkey % 17 <> 0),
t as (select *, case when v then k * 1000 + 250 end as vd, case when s then cast(round_even(((k + 1) || '.0005')::double * 1000, 0) as bigint) end as ad from b)
select k as o_orderkey, v as has_video, s as has_audio, case when v then case when k % 4 = 1 then 25000000 else 29970030 end else -1 end as fps, case when v then k % 1900 + 100 else -1 end as width, case when v then 720 else -1 end as height, case when v then 'h264' end as video_codec, case when s then 'aac' end as audio_codec,
case when s then 48000 else -1 end as sample_rate, case when s then 2 else -1 end as channels, case when k % 2 = 0 then cast(round_even((k || '.1234')::double * 1000, 0) as bigint) else coalesce(greatest(vd, ad), 0) end as duration_ms, coalesce(vd, -1) as video_ms, coalesce(ad, -1) as audio_ms from t""")
def media_info(spark: SparkSession, d: str) -> DataFrame:
    rows = _probes(spark, d).select("o_orderkey", probe.media_info(F.col("raw")).alias("i")).where("i is not null").select("o_orderkey", "i.*")
    return rows.withColumn("fps", F.round(F.col("fps") * 1_000_000).cast("bigint")).na.fill(-1)


@query("""with v as (select o_orderkey as k, -14 - o_custkey % 100 / 100.0 as i, -1 - o_custkey % 30 / 100.0 as tp from orders where o_orderkey % 11 <> 0),
e as (select *, case when k % 7 = 0 then 'missing' when k % 10 = 0 then 'short' end as error from v)
select k as o_orderkey, error, error is null and abs(i + 14) <= 0.5 and tp <= -0.95 as compliant, case when error is null then 'loudnorm=I=-14.0:TP=-1.3:LRA=11.0:measured_I=' || printf('%.2f', i::double) || ':measured_TP=' || printf('%.2f', tp::double) || ':measured_LRA=6.50:measured_thresh=-24.10:offset=0.00:linear=true,alimiter=level_in=1.0:level_out=1.0:limit="""
       + str(10 ** (-1.3 / 20.0)) + """:attack=5:release=50:level=disabled:asc=true' end as filter from e""")
def loudness_stats(spark: SparkSession, d: str) -> DataFrame:
    key, cents = F.col("o_orderkey"), lambda base, mod: F.format_string("%.2f", F.lit(-base).cast("double") - F.col("o_custkey") % mod / 100)
    body = F.concat(F.lit('{\n "input_i" : "'), F.when(key % 10 == 0, "-inf").otherwise(cents(14, 100)), F.lit('",\n "input_tp" : "'), cents(1, 30), F.lit('",'), F.when(key % 7 == 0, "").otherwise(' "input_lra" : "6.50",'), F.lit(' "input_thresh" : "-24.10", "note" : "a } brace" }'))
    log = F.concat(F.lit('frame {0} "input_i" {"input_i" : "1"} '), F.when(key % 11 == 0, F.left(body, F.lit(40))).otherwise(body), F.lit("\n[out] {done}"))
    rows = A.table(spark, d, "orders").select("o_orderkey", loudness.json_block(log).alias("block")).where("block is not null").select("o_orderkey", loudness.stats(F.col("block")).alias("s"))
    good = F.col("s.error").isNull()
    return rows.select("o_orderkey", F.col("s.error").alias("error"), (good & F.coalesce(loudness.compliant(F.col("s.input_i"), F.col("s.input_tp")), F.lit(False))).alias("compliant"), F.when(good, loudness.second_pass(F.col("s"))).alias("filter"))


_CUES = """n as (select *, (row_number() over (partition by media_id order by word_idx) - 1) // 4 as cue, (row_number() over (partition by media_id order by word_idx) - 1) % 4 as k, translate(replace(word, '\\', '\\\\'), '{}', '｛｝') as said from words)"""
_KARAOKE = f"""karaoke as (select media_id, cue, 0 as k, 'Dialogue: 0,' || {_TIME('min(start_ms)')} || ',' || {_TIME('max(end_ms)')} || ',Default,,0,0,0,,' || string_agg('{{\\k' || cast(round_even(greatest(50, end_ms - start_ms) / 10, 0) as bigint) || '}}' || said, ' ' order by word_idx) as line from n group by media_id, cue)"""


@query(f"with {_WORDS}, {_CUES}, {_KARAOKE} select * from karaoke")
def karaoke_dialogues(spark: SparkSession, d: str) -> DataFrame:
    return captions.karaoke_dialogues(captions.cue_words(A.words(spark, d), 4))


@query(f"""with {_WORDS}, {_CUES} select a.media_id, a.cue, a.k, 'Dialogue: 0,' || {_TIME('a.start_ms')} || ',' || {_TIME('a.end_ms')} || ',Default,,0,0,0,,{{\\r}} ' || string_agg(case when b.k = a.k then '{{\\c&H0000F2FF&\\fscx105\\fscy105}}' else '{{\\c&H00FFFFFF&\\fscx100\\fscy100}}' end || b.said, ' ' order by b.k) as line
from n a join n b on b.media_id = a.media_id and b.cue = a.cue group by a.media_id, a.cue, a.k, a.start_ms, a.end_ms""")
def highlight_dialogues(spark: SparkSession, d: str) -> DataFrame:
    return captions.highlight_dialogues(captions.cue_words(A.words(spark, d), 4))


@query(f"""with {_WORDS}, {_CUES}, {_KARAOKE}, c as (select media_id, count(*) as cues, string_agg(line, chr(10) order by cue) as body from karaoke group by 1)
select media_id, cues::int as cues, (select count(*) from words w where w.media_id = c.media_id)::int + (select count(*) from words w where w.media_id = c.media_id)::int as words,
'[Script Info]' || chr(10) || 'ScriptType: v4.00+' || chr(10) || 'PlayResX: 1080' || chr(10) || 'PlayResY: 1920' || chr(10) || 'ScaledBorderAndShadow: yes' || chr(10) || 'WrapStyle: 0' || chr(10) || chr(10) || '[V4+ Styles]' || chr(10) || 'Format: {captions.STYLE_FIELDS}' || chr(10)
|| 'Style: Default,Montserrat,52,&H00FFFFFF&,&H0000F2FF&,&H00000000&,&H80000000&,1,0,0,0,100,100,0,0,1,3.5,1.5,2,50,50,160,1' || chr(10) || chr(10) || '[Events]' || chr(10) || 'Format: {captions.EVENT_FIELDS}' || chr(10) || body || chr(10) as document from c""")
def caption_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = captions.documents(captions.karaoke_dialogues(captions.cue_words(A.words(spark, d), 4)))
    return rows.select("media_id", captions.document_counts(F.col("document")).alias("n"), "document").select("media_id", "n.cues", "n.words", "document")


@query(f"""with {_SPEECH}, t as (select media_id, event_id as word_idx, event_type || ' x' as word, greatest(0, cast(round_even((value - 20) * 1000, 0) as bigint)) as a, case when event_id % 5 <> 0 then cast(round_even((value - 21 + event_id % 3) * 1000, 0) as bigint) end as b, value from speech where event_id % 7 <> 0)
select media_id, word_idx, word, a as start_ms, greatest(a, coalesce(b, a)) as end_ms, cast(round(least(1, greatest(0, value / 100)) * 1000000) as bigint) as probability from t""")
def transcript_words(spark: SparkSession, d: str) -> DataFrame:
    raw = A.speech(spark, d).select("media_id", F.col("event_id").alias("word_idx"), F.when(F.col("event_id") % 7 == 0, " \t").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" \n x "))).alias("word"), (F.col("value") - 20).alias("start"), F.when(F.col("event_id") % 5 != 0, F.col("value") - 21 + F.col("event_id") % 3).alias("end"), (F.col("value") / 100).alias("probability"))
    return captions.clean_words(raw).withColumn("probability", F.round(F.col("probability") * 1_000_000).cast("bigint"))


_HEAD = "case when len({0}) >= 2 then array_to_string(list_slice({0}, 1, 4), ' ') end"
_UP = "list_filter(string_split(replace(upper(trim(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))), 'ẞ', 'SS'), ' '), lambda x: x <> '')"


@query(f"""with t as (select conv_id, turn, case when turn % 3 = 0 then text else '  ' end as g, case when turn % 3 = 1 then text end as ti, case when turn % 2 = 0 then text end as tr from conversations),
w as (select *, list_filter(regexp_split_to_array(trim(g), '\\s+'), lambda x: x <> '') as gw, {_UP.format('ti')} as tw, {_UP.format('tr')} as rw from t)
select conv_id, turn, coalesce(case when len(gw) > 0 then array_to_string(list_slice(gw, 1, 5), ' ') end, {_HEAD.format('tw')}, {_HEAD.format('rw')}, 'ASSISTA AGORA') as headline from w""")
def resolve_headline(spark: SparkSession, d: str) -> DataFrame:
    said, turn = F.col("text"), F.col("turn")
    return A.table(spark, d, "conversations").select("conv_id", "turn", text.resolve_headline([F.when(turn % 3 == 0, said).otherwise("  ")], F.when(turn % 3 == 1, said), F.when(turn % 2 == 0, said)).alias("headline"))


@query("""with t as (select o_orderkey, o_orderkey % 4000 as total from orders), u as (select *, case when total <= 2000 then cast(round_even(total * 0.1, 0) as bigint) else 1000 end as off from t),
v as (select *, case when total - 2 * off <= 0 then least(off, greatest(0, total - 1)) else off end as a, case when total - 2 * off <= 0 then total else total - off end as b from u),
n as (select *, greatest(cast(round_even((b - a) / 500, 0) as bigint) + 1, 3) as n from v)
select o_orderkey, case when total <= 0 then '' else array_to_string(list_sort(list_distinct([cast(round_even(least(k * ((b - a) / (n - 1)) + a, total - 1), 0) as bigint) for k in range(n)])), ',') end as times, len(range(0, greatest(total, 1), 700))::int as samples from n""")
def frame_grid(spark: SparkSession, d: str) -> DataFrame:
    total = F.col("o_orderkey") % 4000
    return A.table(spark, d, "orders").select("o_orderkey", F.array_join(geometry.uniform_times(total, 500, 1000, 1000), ",").alias("times"), F.size(geometry.sample_times(F.lit(0).cast("bigint"), total, 700)).alias("samples"))


_EVEN = "cast(floor(round_even({0}, 0) / 2) * 2 as bigint)"


@query(f"""with t as (select o_orderkey, 100 + o_orderkey % 1900 as w, 100 + o_custkey % 1900 as h, 1 + o_orderkey % 5 / 10.0::double as s, o_custkey % 11 / 10.0::double as ax from orders),
z as (select *, {_EVEN.format('w / s')} as zw, {_EVEN.format('h / s')} as zh from t)
select o_orderkey, w / h <= 0.5625 * 1.1 as vertical, case when w / h >= 0.5625 then greatest(0, {_EVEN.format('h * 0.5625')}) else w end as crop_w, case when w / h >= 0.5625 then h else greatest(0, {_EVEN.format('w / 0.5625')}) end as crop_h, zw as zoom_w, zh as zoom_h,
{_EVEN.format('greatest(0, least(w - zw, ax * w - zw / 2))')} as zoom_x, {_EVEN.format('greatest(0, least(h - zh, 0.4::double * h - zh / 2))')} as zoom_y,
case when o_orderkey % 300 + 50 > o_orderkey % 200 and o_orderkey % 200 < 250 then o_orderkey % 200 else -1 end as from_ms, case when least(o_orderkey % 300 + 50, 250) > o_orderkey % 200 then least(o_orderkey % 300 + 50, 250) else -1 end as to_ms,
case when o_orderkey % 200 <> 0 then cast(round_even(o_orderkey % 200 * 44100 / 1000, 0) as bigint) else -1 end as samples from z""")
def frame_geometry(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    w, h = key % 1900 + 100, F.col("o_custkey") % 1900 + 100
    smart, zoom = geometry.smart_crop(w, h), geometry.zoom_crop(w, h, 1 + key % 5 / 10, F.col("o_custkey") % 11 / 10, F.lit(0.4))
    window = geometry.clamp_window(key % 200, key % 300 + 50, F.lit(250))
    span = geometry.sample_span(F.lit(0), key % 200, 44_100, F.lit(1_000_000).cast("bigint"))
    return A.table(spark, d, "orders").select("o_orderkey", geometry.is_vertical(w, h).alias("vertical"), smart["width"].alias("crop_w"), smart["height"].alias("crop_h"), zoom["width"].alias("zoom_w"), zoom["height"].alias("zoom_h"), zoom["x"].alias("zoom_x"), zoom["y"].alias("zoom_y"), window["start_ms"].alias("from_ms"), window["end_ms"].alias("to_ms"), span["end"].alias("samples")).na.fill(-1)


@query(f"""with {_SPEECH}, f as (select event_id, greatest(0, least(1, (value - 80) / 160)) as sharp, event_id % 100 / 100.0::double as expr, event_id % 37 / 36.0::double as light, event_type <> 'error' as face, event_id % 10 / 10.0::double as conf, event_id % 9 / 10.0::double as area from speech)
select event_id, cast(round(case when face then sharp * 0.35 + expr * 0.35 + light * 0.15 + least(1, conf * area * 2) * 0.15 else (sharp * 0.35 + expr * 0.35 + light * 0.15) / 0.85 end * 1000000) as bigint) as score from f""")
def frame_composite(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("frame_id")
    return A.frames(spark, d).select(e.alias("event_id"), _micro(scores.composite(F.col("sharpness"), e % 100 / 100, e % 37 / 36, F.col("face"), e % 10 / 10, e % 9 / 10), "score"))


@query(f"with {_SAMPLES} select media_id, cast(round(avg(abs(value) * 255) * 1000) as bigint) as mean, cast(round(stddev_pop(abs(value) * 255) * 1000) as bigint) as deviation from samples group by 1")
def luminance_stats(spark: SparkSession, d: str) -> DataFrame:
    mean, deviation = scores.luminance_stats(F.abs("value") * 255)
    return A.samples(spark, d).groupBy("media_id").agg(F.round(mean * 1000).cast("bigint").alias("mean"), F.round(deviation * 1000).cast("bigint").alias("deviation"))


@query(f"""with recursive {_SPEECH}, f as (select media_id, event_id * 7919 % 1000 / 1000.0 as x, event_type <> 'error' as d, row_number() over (partition by media_id order by start_ms, event_id) as rn from speech),
w as (select media_id, 0::bigint as rn, 0::double as ema, 0.5::double as hold, false as seen from totals
 union all select media_id, rn, case when d then ne else ema end, case when d and abs(ne - hold) >= 0.03 then ne else hold end, d from (select w.media_id, f.rn, f.d, w.ema, w.hold, case when w.seen then 0.15 * f.x + 0.85 * w.ema else f.x end as ne from w join f on f.media_id = w.media_id and f.rn = w.rn + 1))
select media_id, count(*) as samples, count(*) filter (seen) as detected, cast(round(coalesce(avg(hold) filter (seen), 0.5) * 1000) as bigint) as mean_x, case when count(*) filter (seen) / count(*) >= 0.8 then 'SMART_CROP' else 'AESTHETIC_FILL' end as mode from w where rn > 0 group by 1""")
def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    faces = A.faces(spark, d)
    rows = selection.trajectory(faces, selection.smooth_track(faces), 0.8)
    return rows.select("media_id", "samples", "detected", F.round(F.col("mean_x") * 1000).cast("bigint").alias("mean_x"), "mode")


def _track(spark: SparkSession, d: str) -> DataFrame:
    cuts = A.totals(spark, d).selectExpr("media_id", "total_ms div 4 as start_ms", "total_ms div 2 as end_ms")
    return selection.relative_track(A.faces(spark, d).withColumnRenamed("x", "hold"), cuts)


_TRACK = "track as (select media_id, event_id as sample_id, start_ms - total_ms // 4 as at_ms, event_id * 7919 % 1000 / 1000.0::double as hold from speech join totals using (media_id) where start_ms between total_ms // 4 and total_ms // 2)"


@query(f"""with {_SPEECH}, c as (select media_id, 1 as span_id, total_ms // 4 as a, total_ms // 2 as b from totals union all select media_id, 2, total_ms // 3, total_ms // 3 * 2 from totals)
select media_id, span_id, event_id as sample_id, start_ms - a as at_ms, event_id * 7919 % 1000 as x from speech join c using (media_id) where start_ms between a and b""")
def relative_track(spark: SparkSession, d: str) -> DataFrame:
    """Two cuts of each item that overlap."""
    one, two = (A.totals(spark, d).selectExpr("media_id", f"{k} as span_id", f"{a} as start_ms", f"{b} as end_ms") for k, a, b in ((1, "total_ms div 4", "total_ms div 2"), (2, "total_ms div 3", "total_ms div 3 * 2")))
    rows = selection.relative_track(A.faces(spark, d), one.unionByName(two))
    return rows.select("media_id", "span_id", "sample_id", "at_ms", F.round(F.col("x") * 1000).cast("bigint").alias("x"))


@query(f"""with {_SPEECH}, {_TRACK}, k as (select media_id, sample_id as k, at_ms / 1000 as t, greatest(0, least(1314, hold * 1920 - 303)) as x from track), h as (select media_id, -1 as k, 0.0 as t, arg_min(x, t * 1e9 + k) as x from k group by media_id having min(t) > 0),
p as (select *, lead(t) over w as t1, lead(x) over w as x1, row_number() over w as n from (select * from h union all select * from k) window w as (partition by media_id order by t, k))
select media_id, coalesce(string_agg('if(between(t,' || printf('%.3f', t) || ',' || printf('%.3f', t1) || '),(' || printf('%.2f', x) || '+' || printf('%.4f', (x1 - x) / (t1 - t)) || '*(t-' || printf('%.3f', t) || ')),', '' order by n) filter (t1 > t), '') || max(printf('%.2f', x)) filter (t1 is null) || repeat(')', count(*) filter (t1 > t)) as path from p group by 1""")
def crop_paths(spark: SparkSession, d: str) -> DataFrame:
    return selection.crop_path(_track(spark, d), 1920, 606)
