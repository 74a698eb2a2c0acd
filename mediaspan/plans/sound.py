"""Queries of audio in blocks over samples made from the embeddings, and the same in DuckDB's SQL, which works on single samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaspan.operators import audio
from mediaspan.plans import adapters as A
from mediaspan.plans.catalogue import query

#: Vectors of an item, samples a second, blocks of the queries (small, so that items have several).
VECTORS, RATE, BLOCK = 16, 1_000, 300
#: Settings of the queries.
CUTOFF, TARGET, CROSSFADE, LOOP_MS, LOOP_FADE = 150, 400, 15.0, 3_300, 120.0


def _rows(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("media_id").orderBy("vec_id")
    rows = A.table(spark, d, "embeddings").select(F.expr(f"vec_id div {VECTORS}").alias("media_id"), "vec_id", "embedding")
    return rows.select("media_id", "vec_id", (F.row_number().over(own) - 1).cast("long").alias("k"), "embedding")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Items of up to VECTORS vectors, each component is a sample."""
    rows = _rows(spark, d).select("media_id", "k", F.posexplode("embedding").alias("i", "v"))
    return audio.to_blocks(rows.select("media_id", F.lit(0).alias("channel"), F.lit(RATE).alias("rate"), (F.col("k") * 64 + F.col("i")).alias("pos"), F.col("v").cast("double").alias("value")), BLOCK)


def segments(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("vec_id") * 37 % 1000
    return _rows(spark, d).select("media_id", start.alias("start_ms"), (start + F.col("vec_id") * 53 % 90).alias("end_ms"))


_SOUND = f"""v as (select vec_id // {VECTORS} as media_id, vec_id, row_number() over (partition by vec_id // {VECTORS} order by vec_id) - 1 as k, embedding from embeddings),
s as (select media_id, k * 64 + unnest(range(len(embedding))) as pos, unnest(embedding)::double as value from v), items as (select media_id, count(*) as n from s group by 1)"""


def _low_pass_sql(name: str, cutoff: str) -> str:
    """CTEs that end in ``name`` (media_id, pos, value): every frequency is summed over all samples and every sample over all frequencies."""
    return f"""{name}_n as materialized (select media_id, pos, value, cast(pow(2, ceil(log2(n))) as bigint) as size from s join items using (media_id)),
{name}_g as materialized (select size, f, least(f, size - f) as b, round_even({cutoff} / ({RATE} / 2.0) * (size // 2), 0) as lo, least(round_even({cutoff} * 1.3 / ({RATE} / 2.0) * (size // 2), 0), size // 2) as hi from (select size, unnest(range(size)) as f from (select distinct size from {name}_n))),
{name}_f as materialized (select media_id, size, f, (case when b < lo then 1.0 when b < hi then 1 - (b - lo) / greatest(1, hi - lo - 1) else 0.0 end) / size as gain, sum(value * cos(2 * pi() * (f * pos % size) / size)) as re, sum(value * sin(2 * pi() * (f * pos % size) / size)) as im from {name}_n join {name}_g using (size) where b < greatest(lo, hi) group by media_id, size, f, b, lo, hi),
{name} as materialized (select media_id, pos, sum(gain * (re * cos(2 * pi() * (f * pos % size) / size) + im * sin(2 * pi() * (f * pos % size) / size))) as value from {name}_n join {name}_f using (media_id, size) group by media_id, pos)"""


_micro = lambda df: df.select("media_id", "pos", F.round(F.col("value") * 1_000_000).cast("bigint").alias("value"))


@query(f"with {_SOUND}, {_low_pass_sql('low', str(CUTOFF))} select media_id, pos, round(value * 1000000)::bigint as value from low")
def audio_low_pass(spark: SparkSession, d: str) -> DataFrame:
    return _micro(audio.to_samples(audio.low_pass(blocks(spark, d), CUTOFF, BLOCK), BLOCK))


@query(f"""with {_SOUND}, {_low_pass_sql('low', f'{TARGET * audio.CUTOFF}::double')}, m as (select media_id, n, greatest(1, round_even(n * {TARGET} / {RATE}.0, 0)::bigint) as m from items),
j as (select media_id, n, m, unnest(range(m)) as pos from m)
select j.media_id, j.pos, round((a.value + (b.value - a.value) * ((j.pos * n % m)::double / m)) * 1000000)::bigint as value from j
join low a on a.media_id = j.media_id and a.pos = j.pos * n // m join low b on b.media_id = j.media_id and b.pos = least(j.pos * n // m + 1, n - 1)""")
def audio_resampled(spark: SparkSession, d: str) -> DataFrame:
    return _micro(audio.to_samples(audio.resample(blocks(spark, d), TARGET, BLOCK), BLOCK))


_SPANS = f"""seg as (select media_id, vec_id * 37 % 1000 as start_ms, vec_id * 37 % 1000 + vec_id * 53 % 90 as end_ms from v),
b as (select *, max(end_ms) over (partition by media_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as b from seg),
g as (select *, sum(case when b is null or start_ms >= b then 1 else 0 end) over (partition by media_id order by start_ms, end_ms rows unbounded preceding) as i from b),
mg as (select media_id, i, min(start_ms) as a, max(end_ms) as e from g group by all),
cl as (select media_id, greatest(0, least(n, round_even(a * {RATE} / 1000.0, 0)::bigint)) as start, greatest(0, least(n, round_even(e * {RATE} / 1000.0, 0)::bigint)) as "end", n from mg join items using (media_id)),
sp as (select media_id, row_number() over w - 1 as span, count(*) over (partition by media_id) as spans, start, "end", coalesce(sum("end" - start) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as "offset",
least(round_even(least({CROSSFADE}, 1000.0 * ("end" - start) / {RATE} / 2) * {RATE} / 1000.0, 0)::bigint, ("end" - start) // 2) as fade, (sum("end" - start) over (partition by media_id))::bigint as total from cl where "end" > start window w as (partition by media_id order by start, "end"))"""


@query(f"with {_SOUND}, {_SPANS} select * from sp")
def audio_splice_spans(spark: SparkSession, d: str) -> DataFrame:
    items = blocks(spark, d).where("block = 0").select("media_id", "rate", "n")
    return audio.splice_spans(items, segments(spark, d), CROSSFADE)


@query(f"""with {_SOUND}, {_SPANS}, p as (select s.media_id, "offset" + pos - start as out, pos - start as a, "end" - pos as z, fade, span, spans, value from s join sp on sp.media_id = s.media_id and pos >= start and pos < "end")
select media_id, out as pos, round(value * case when span > 0 and a < fade then case when fade = 1 then 0 else sin(pi() / 2 * a / (fade - 1)) end else 1 end
* case when span < spans - 1 and z <= fade then case when fade = 1 then 0 else cos(pi() / 2 * (fade - z) / (fade - 1)) end else 1 end * 1000000)::bigint as value from p""")
def audio_spliced(spark: SparkSession, d: str) -> DataFrame:
    return _micro(audio.to_samples(audio.splice(blocks(spark, d), segments(spark, d), CROSSFADE, block=BLOCK), BLOCK))


@query(f"""with {_SOUND}, f as (select media_id, n, greatest(1, least(round_even({LOOP_FADE} * {RATE} / 1000.0, 0)::bigint, n // 2)) as fade from items),
l as (select *, case when n * 1000.0 / {RATE} >= {LOOP_MS} then 0 else greatest(1, ceil((ceil({LOOP_MS} * {RATE} / 1000.0) - n) / (n - fade)))::bigint end as loops from f),
c as (select media_id, n, fade, loops, unnest(range(loops + 1)) as i from l)
select media_id, i * (n - fade) + pos as pos, round(sum(value * case when i > 0 and pos < fade then case when fade = 1 then 1 else sin(pi() / 2 * pos / (fade - 1)) end else 1 end
* case when i < loops and pos >= n - fade then case when fade = 1 then 0 else cos(pi() / 2 * (pos - n + fade) / (fade - 1)) end else 1 end) * 1000000)::bigint as value from c join s using (media_id) group by all""")
def audio_looped(spark: SparkSession, d: str) -> DataFrame:
    return _micro(audio.to_samples(audio.loop(blocks(spark, d), LOOP_MS, LOOP_FADE, BLOCK), BLOCK))
