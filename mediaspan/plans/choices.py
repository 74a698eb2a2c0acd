"""Queries of landmarks, metadata flags, choices and frame selection over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.functions import landmarks, scores, settings
from mediaspan.operators import decisions
from mediaspan.plans import adapters as A
from mediaspan.plans.catalogue import _SPEECH, _WORDS, _greedy_sql, query

#: Metadata of the test jobs, in turn.
METADATA = (
    '{"dynamicZoom":true,"generate_shorts":"no"}',
    '{"dynamicZoom":" TRUE ","shorts":"yes"}',
    '{"dynamic_zoom":1.0,"generateShorts":1}',
    '{"dynamicZoom":null,"dynamic_zoom":true,"generateShorts":0,"shorts":true}',
    '{"generate_shorts":null,"shorts":true}',
    "{}",
    '{"dynamicZoom":"1.0","generateShorts":" Yes"}',
    '{"dynamicZoom":2,"shorts":false}',
    '{"dynamicZoom":[1],"dynamic_zoom":true,"generate_shorts":"1"}',
)
_micro = lambda c, name: F.round(c * 1_000_000).cast("bigint").alias(name)


def _flag_sql(keys: tuple[str, ...], yes: tuple[str, ...], default: str) -> str:
    texts = ", ".join(f"'{y}'" for y in yes)
    one = lambda k: f"""when json_exists(m, '$.{k}') then case json_type(m, '$.{k}') when 'NULL' then {default} when 'BOOLEAN' then (m ->> '$.{k}') = 'true'
 when 'VARCHAR' then lower(trim((m ->> '$.{k}'))) in ({texts}) else coalesce(try_cast((m ->> '$.{k}') as double) = 1, false) end"""  # noqa: E731
    return "case " + " ".join(map(one, keys)) + f" else {default} end"


_META = "t as (select o_orderkey, [" + ", ".join(f"'{m}'" for m in METADATA) + f"][o_orderkey % {len(METADATA)} + 1] as m from orders)"


@query(f"""with {_META} select o_orderkey, {_flag_sql(settings.ZOOM_KEYS, settings.ZOOM_YES, 'false')} as zoom, {_flag_sql(settings.SHORTS_KEYS, settings.SHORTS_YES, 'false')} as shorts,
{_flag_sql(settings.SHORTS_KEYS, settings.SHORTS_YES, 'true')} as shorts_by_default from t""")
def metadata_flags(spark: SparkSession, d: str) -> DataFrame:
    meta = F.element_at(F.array(*map(F.lit, METADATA)), (F.col("o_orderkey") % len(METADATA) + 1).cast("int"))
    rows = A.table(spark, d, "orders").select("o_orderkey", meta.alias("m"))
    m = F.col("m")
    return rows.select("o_orderkey", settings.zoom_enabled(m).alias("zoom"), settings.shorts_enabled(m, F.lit(False)).alias("shorts"), settings.shorts_enabled(m, F.lit(True)).alias("shorts_by_default"))


def _face(spark: SparkSession, d: str) -> DataFrame:
    """Points 36 to 57 from an embedding's components; each fifth vector lacks one, each eleventh has none."""
    part = lambda k, by: (F.element_at("embedding", (F.pmod(k * by, F.lit(64)) + 1).cast("int")).cast("double") + 0.5) * 400
    point = lambda k: F.struct(k.alias("key"), F.struct(part(k, F.lit(1)).alias("x"), part(k, F.lit(7)).alias("y")).alias("value"))
    at = F.filter(F.sequence(F.lit(36), F.lit(57)), lambda k: (F.col("vec_id") % 11 != 3) & ~((F.col("vec_id") % 5 == 0) & (k == 36 + F.col("vec_id") % 22)))
    return A.table(spark, d, "embeddings").select("vec_id", F.map_from_entries(F.transform(at, point)).alias("points"))


def _distance_sql(pair: tuple[int, int]) -> str:
    a, b = (k - 35 for k in pair)
    return f"sqrt(pow(xs[{b}] - xs[{a}], 2) + pow(ys[{b}] - ys[{a}], 2))"


def _aspect_sql(across: tuple[tuple[int, int], ...], along: tuple[int, int]) -> str:
    return f"coalesce(({' + '.join(map(_distance_sql, across))}) / {len(across)} / nullif({_distance_sql(along)}, 0), 0)"


@query(f"""with p as (select vec_id, k, case when vec_id % 11 <> 3 and not (vec_id % 5 = 0 and k = 36 + vec_id % 22) then k end as has, (embedding[k % 64 + 1]::double + 0.5) * 400 as x, (embedding[k * 7 % 64 + 1]::double + 0.5) * 400 as y
 from embeddings, unnest(generate_series(36, 57)) as g(k)),
f as (select vec_id, count(has) as n, list(case when has is not null then x end order by k) as xs, list(case when has is not null then y end order by k) as ys from p group by 1),
e as (select *, greatest(0, least(1, (least({_aspect_sql(*landmarks.LEFT_EYE)}, {_aspect_sql(*landmarks.RIGHT_EYE)}) - 0.12) / 0.23)) as eyes, greatest(0, least(1, ({_aspect_sql(*landmarks.MOUTH)} - 0.15) / 0.3)) as mouth,
 greatest(0, least(1, list_min(xs) / 640)) as x0, greatest(0, least(1, list_max(xs) / 640)) as x1, greatest(0, least(1, list_min(ys) / 480)) as y0, greatest(0, least(1, list_max(ys) / 480)) as y1 from f)
select vec_id, n > 0 as detected, case when n > 0 then cast(round(eyes * 1000000) as bigint) else -1 end as eyes, n > 0 and eyes < 0.25 as closed, case when n > 0 then cast(round(mouth * 1000000) as bigint) else -1 end as mouth,
case when n > 0 then cast(round((0.65 * mouth + 0.35 * eyes) * 1000000) as bigint) else -1 end as expression, case when n > 0 then cast(round(x0 * 1000000) as bigint) else -1 end as x, case when n > 0 then cast(round(y0 * 1000000) as bigint) else -1 end as y,
case when n > 0 then cast(round((x1 - x0) * 1000000) as bigint) else -1 end as width, case when n > 0 then cast(round((y1 - y0) * 1000000) as bigint) else -1 end as height from e""")
def face_landmarks(spark: SparkSession, d: str) -> DataFrame:
    m = landmarks.measures(F.col("points"), F.lit(640), F.lit(480))
    rows = _face(spark, d).select("vec_id", m.alias("m"))
    part = lambda field, name: F.coalesce(F.round(F.col(f"m.{field}") * 1_000_000).cast("bigint"), F.lit(-1).cast("bigint")).alias(name)
    named = {"eyes": "eye_openness", "mouth": "mouth_articulation", "expression": "expression_intensity", "x": "box.x", "y": "box.y", "width": "box.width", "height": "box.height"}
    return rows.select("vec_id", F.col("m.detected").alias("detected"), F.coalesce("m.eyes_closed", F.lit(False)).alias("closed"), *[part(field, name) for name, field in named.items()])


@query(f"""with {_WORDS}, cuts as (select media_id, seg_idx as span_id, start_ms + 360 as start_ms, start_ms + 360 + seg_idx % 3 * 30 as end_ms from segments)
select c.media_id, c.span_id, c.start_ms, c.end_ms, coalesce(bool_or(w.start_ms < c.end_ms and w.end_ms > c.start_ms), false) as captions from cuts c left join words w using (media_id) group by 1, 2, 3, 4""")
def captioned_cuts(spark: SparkSession, d: str) -> DataFrame:
    cuts = A.segments(spark, d).selectExpr("media_id", "seg_idx as span_id", "start_ms + 360 as start_ms", "start_ms + 360 + seg_idx % 3 * 30 as end_ms")
    return decisions.captioned(cuts, A.words(spark, d))


@query(f"""with {_WORDS}, i as (select media_id, count(*) as n, max(end_ms) as last, case media_id % 3 when 0 then -5 when 1 then null else 7000 end as given, media_id % 2 * 9000 as told from words group by 1),
r as (select *, case when given > 0 then given when told > 0 then told else last end as duration_ms from i)
select media_id, duration_ms, media_id % 4 <> 0 and n > 0 and duration_ms > 8000 as semantic, case when media_id % 2 = 0 then 0 when media_id % 3 = 0 then -1 else 1 end as words_used from r""")
def item_choices(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("media_id")
    rows = A.words(spark, d).groupBy("media_id").agg(F.count("*").alias("n"), F.max("end_ms").alias("last"))
    given = F.when(key % 3 == 0, -5).when(key % 3 == 2, 7000)
    rows = rows.withColumn("duration_ms", settings.resolve_duration(given, key % 2 * 9000, F.col("last")))
    none = F.array().cast("array<string>")
    source = settings.caption_source(F.when(key % 2 == 0, none), F.when(key % 3 == 0, none).otherwise(F.array(F.lit("own"))))
    mode = F.when(key % 4 == 0, "rule").otherwise("gemini")
    return rows.select("media_id", "duration_ms", settings.semantic_enabled(mode, F.col("n"), F.col("duration_ms"), F.lit(8000)).alias("semantic"), F.coalesce(F.size(source), F.lit(-1)).alias("words_used"))


@query("""select o_orderkey, abs(o_orderkey % 5 / 10.0::double + 0.35 + 0.15 + 0.2 - 1) <= 0.001 and o_orderkey % 200 <= o_custkey % 200 as weights, o_orderkey % 9 <= o_custkey % 9 and o_custkey % 9 <= 6 as lengths,
o_orderkey % 4 > 0 and o_orderkey % 4 <= 2 as headline, (o_orderkey % 7 <> 0) and o_custkey % 300 - 20 between 0 and 255 as rgb, o_orderkey % 3 <> 0 as mode from orders""")
def checked_settings(spark: SparkSession, d: str) -> DataFrame:
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit(" "), F.array_join(F.array_repeat(F.lit("word"), (key % 4).cast("int")), "\n "))
    channels = F.when(key % 7 == 0, F.array(other % 300, other % 300)).otherwise(F.array(F.lit(0).cast("bigint"), other % 300 - 20, F.lit(255).cast("bigint")))
    return A.table(spark, d, "orders").select(
        "o_orderkey",
        settings.valid_weights([key % 5 / 10, F.lit(0.35), F.lit(0.15), F.lit(0.2)], key % 200, other % 200).alias("weights"),
        settings.valid_shot_lengths(key % 9, other % 9, F.lit(6)).alias("lengths"),
        settings.valid_headline(text, 2).alias("headline"),
        settings.valid_rgb(channels).alias("rgb"),
        settings.valid_mode(F.when(key % 3 == 0, "auto").otherwise("smart")).alias("mode"),
    )


@query(f"with {_SPEECH} select media_id, min(start_ms) as x0, min(event_id % 100) as y0, max(end_ms) as x1, max(event_id % 100 + 50) as y1 from speech group by 1")
def enclosing_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = A.speech(spark, d).selectExpr("media_id", "start_ms as x0", "event_id % 100 as y0", "end_ms as x1", "event_id % 100 + 50 as y1")
    return decisions.enclosing_boxes(boxes, "media_id")


@query("select o_custkey % 10 as worker, count(*) as processed, count(*) filter (o_orderstatus = 'O') as succeeded, count(*) filter (o_orderstatus <> 'O') as failed, count(*) filter (o_orderstatus not in ('O', 'F')) as timed_out from orders group by 1")
def job_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "succeeded").when(F.col("o_orderstatus") == "F", "failed").otherwise("timed_out")
    return decisions.job_counts(A.table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("worker"), status.alias("status")), "worker")


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'INPUT_FILE_INVALID' when o_orderkey % 3 = 0 then 'NO_AUDIO_STREAM' when o_orderkey % 2 = 0 then 'NO_SPEECH_DETECTED' else 'NONE' end as error from orders""")
def input_errors(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    error = settings.input_error(key % 5 != 0, F.when(key % 3 != 0, True), key % 2 != 0)
    return A.table(spark, d, "orders").select("o_orderkey", F.coalesce(error, F.lit("NONE")).alias("error"))


@query(f"""with {_SPEECH}, s as (select media_id, event_id, start_ms, end_ms from speech where event_id % 50 = 0)
select *, 'semantic' as strategy from s union all select media_id, event_id, start_ms, end_ms, 'heuristic_fallback' from speech where media_id not in (select media_id from s)""")
def hook_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = A.speech(spark, d).select("media_id", "event_id", "start_ms", "end_ms")
    return decisions.preferred(rows.where("event_id % 50 = 0"), rows, "semantic", "heuristic_fallback")


_LUM = "event_id * 37 % 256"


def _reasons() -> Column:
    lum, closed = F.col("luminance"), F.col("frame_id") % 7 == 0
    return scores.rejections(F.col("sharpness") < 80, closed, ~F.col("face"), lum < 35, lum > 225)


@query(f"""with {_SPEECH} select media_id, count(*) as sampled, count(*) filter (value >= 80 and event_id % 7 <> 0 and event_type <> 'error' and {_LUM} between 35 and 225) as valid, count(*) filter (value < 80) as blurry, count(*) filter (event_id % 7 = 0) as closed_eyes,
count(*) filter ({_LUM} not between 35 and 225) as lighting, count(*) filter (event_type = 'error') as no_face from speech group by 1""")
def keyframe_counts(spark: SparkSession, d: str) -> DataFrame:
    return decisions.frame_counts(A.frames(spark, d), _reasons())


@query(_greedy_sql(f"""select *, row_number() over (partition by media_id order by score desc, s, i) as rn from (select media_id, start_ms as s, start_ms as e, event_id as i,
 cast(floor((greatest(0, least(1, (value - 80) / 160)) * 0.35 + event_id % 100 / 100.0::double * 0.35 + event_id % 37 / 36.0::double * 0.15 + least(1, event_id % 10 / 10.0::double * (event_id % 9 / 10.0::double) * 2) * 0.15) * 1000 + 0.000001) as bigint) as score
 from speech where value >= 80 and event_id % 7 <> 0 and event_type <> 'error' and {_LUM} between 35 and 225)""", "abs(y.s - c.s) >= 100000", 3, "media_id, k as rank, kept[k].i as frame_id, kept[k].s as at_ms, kept[k].score as score"))
def keyframe_selection(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("frame_id")
    score = scores.composite(F.col("sharpness"), e % 100 / 100, e % 37 / 36, F.col("face"), e % 10 / 10, e % 9 / 10)
    return decisions.select_keyframes(A.frames(spark, d), _reasons(), F.floor(score * 1000 + 0.000001), 100_000, 3)
