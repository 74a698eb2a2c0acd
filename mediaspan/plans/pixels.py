"""Queries of frames, masks and layers over pixels made from the embeddings, and the same in DuckDB's SQL, which works on pixels, not on tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaspan.operators import tiles
from mediaspan.plans import adapters as A
from mediaspan.plans.catalogue import query

#: Rows of a frame; tiles of the queries (small, so that the test frames have several).
ROWS, TILE = 48, 24
#: Settings of the queries.
BLUR, FEATHER, STROKE, GLOW, INTENSITY, OPACITY = 3, 2, 4, 6, 0.8, 0.7
STROKE_COLOUR, GLOW_COLOUR = (255, 250, 3), (255, 200, 0)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Frames of up to ROWS vectors, a component is a pixel: colours from its digits, alpha by its red."""
    own = Window.partitionBy("frame_id")
    rows = A.table(spark, d, "embeddings").select(F.expr(f"vec_id div {ROWS}").alias("frame_id"), "vec_id", "embedding")
    rows = rows.select("frame_id", F.count("*").over(own).cast("int").alias("height"), F.size("embedding").alias("width"), (F.row_number().over(own.orderBy("vec_id")) - 1).alias("y"), "embedding")
    rows = rows.select("frame_id", "height", "width", "y", F.posexplode("embedding").alias("x", "v"))
    digit = lambda k: F.pmod(F.floor(F.col("v").cast("double") * k), F.lit(256)).cast("int")
    rows = rows.select("frame_id", "height", "width", "y", "x", digit(512).alias("r"), digit(2048).alias("g"), digit(8192).alias("b"))
    return rows.withColumn("a", F.when(F.col("r") < 150, 0).when(F.col("r") < 190, 128).otherwise(255))


def frames(spark: SparkSession, d: str) -> DataFrame:
    return tiles.to_tiles(pixels(spark, d), list("rgba"), TILE)


def _mask(df: DataFrame) -> DataFrame:
    return df.select(*tiles.PLACE, F.transform("a", lambda a: F.when(a > 0, 255).otherwise(0)).alias("mask"))


_PIXELS = f"""v as (select vec_id // {ROWS} as frame_id, row_number() over (partition by vec_id // {ROWS} order by vec_id) - 1 as y, count(*) over (partition by vec_id // {ROWS}) as h, len(embedding) as w, embedding from embeddings),
e as (select frame_id, y, h, w, unnest(range(w)) as x, unnest(embedding)::double as v from v),
c as (select frame_id, y, x, h, w, (floor(v * 512)::bigint & 255) as r, (floor(v * 2048)::bigint & 255) as g, (floor(v * 8192)::bigint & 255) as b from e),
px as (select *, case when r < 150 then 0 when r < 190 then 128 else 255 end as a, case when r < 150 then 0 else 255 end as mask from c)"""


def _blur_sql(name: str, column: str, radius: int, sigma: float) -> str:
    """CTEs that end in ``name`` (frame_id, y, x, v): clamped neighbours along rows, then columns."""
    return f"""{name}_k as (select k, exp(-0.5 * pow(k / {sigma}::double, 2)) / sum(exp(-0.5 * pow(k / {sigma}::double, 2))) over () as weight from (select unnest(range(-{radius}, {radius + 1})) as k)),
{name}_h as (select p.frame_id, p.y, p.x, p.h, sum(weight * q.{column}) as v from px p cross join {name}_k join px q on q.frame_id = p.frame_id and q.y = p.y and q.x = greatest(0, least(p.w - 1, p.x + k)) group by all),
{name} as (select p.frame_id, p.y, p.x, sum(weight * q.v) as v from {name}_h p cross join {name}_k join {name}_h q on q.frame_id = p.frame_id and q.x = p.x and q.y = greatest(0, least(p.h - 1, p.y + k)) group by all)"""


_DILATED = f"""dil as (select p.frame_id, p.y, p.x, max(q.mask) as v from px p cross join (select unnest(range(-{STROKE}, {STROKE + 1})) as dy) cross join (select unnest(range(-{STROKE}, {STROKE + 1})) as dx)
join px q on q.frame_id = p.frame_id and q.y = p.y + dy and q.x = p.x + dx where dy * dy + dx * dx <= {STROKE * STROKE} group by all)"""
_LINES = f"""{_DILATED}, {_blur_sql('soft', 'mask', GLOW, GLOW / 2)},
lines as (select px.*, dil.v - mask as stroke, cast(round_even(soft.v * (1 - mask / 255.0) * {INTENSITY}, 0) as int) as glow from px join dil using (frame_id, y, x) join soft using (frame_id, y, x))"""
_milli = lambda c: F.round(c * 1000).cast("bigint")


@query(f"""with {_PIXELS}, l as (select frame_id, y, x, h, w, 299 * r + 587 * g + 114 * b as l from px),
n as (select *, coalesce(lag(l) over (partition by frame_id, x order by y), l) + coalesce(lead(l) over (partition by frame_id, x order by y), l) + coalesce(lag(l) over (partition by frame_id, y order by x), l) + coalesce(lead(l) over (partition by frame_id, y order by x), l) - 4 * l as e from l),
s as (select frame_id, count(*) as n, sum(l) as s, sum(l * l) as ss, sum(e) as e, sum(e * e) as ee, max(h) as h, max(w) as w from n group by 1),
m as (select frame_id, s::double / n / 1000 as mean, sqrt((ss - s::double * s::double / n) / n / 1e6) as std, case when h < 3 or w < 3 then 0 else (ee - e::double * e::double / n) / n / 1e6 end as var from s),
t as (select *, case when mean < 35 or mean > 225 then 0 else least(1, greatest(0, 0.7 * (1 - 2 * abs((mean - 35) / 190 - 0.5)) + 0.3 * least(std / 80, 1))) end as light from m)
select frame_id, round(mean * 1000)::bigint as luminance, round(std * 1000)::bigint as contrast, round(var * 1000)::bigint as sharpness, round(light * 1000)::bigint as light,
concat_ws(',', case when var < 80 then 'BLURRY' end, case when mean < 35 then 'DARK' end, case when mean > 225 then 'OVEREXPOSED' end) as reasons,
round(least(1, greatest(0, (least(1, greatest(0, (var - 80) / 160)) * 0.35 + light * 0.15) / 0.85)) * 1000)::bigint as score from t""")
def tile_measures(spark: SparkSession, d: str) -> DataFrame:
    rows = tiles.evaluated_frames(frames(spark, d), TILE)
    return rows.select("frame_id", *[_milli(F.col(c)).alias(c) for c in ("luminance", "contrast", "sharpness", "light", "score")], F.array_join("reasons", ",").alias("reasons"))


@query(f"with {_PIXELS}, {_blur_sql('soft', 'g', BLUR, max(BLUR / 2.5, 0.8))} select frame_id, y, x, round(v * 1000)::bigint as g from soft")
def tile_blur(spark: SparkSession, d: str) -> DataFrame:
    rows = tiles.to_pixels(tiles.blur(frames(spark, d), "g", BLUR, tile=TILE), ["g"], TILE)
    return rows.select("frame_id", "y", "x", _milli(F.col("g")).alias("g"))


@query(f"with {_PIXELS}, {_DILATED} select frame_id, y, x, v as mask from dil")
def mask_dilation(spark: SparkSession, d: str) -> DataFrame:
    return tiles.to_pixels(tiles.dilate(_mask(frames(spark, d)), "mask", STROKE, TILE), ["mask"], TILE)


@query(f"with {_PIXELS}, {_blur_sql('soft', 'a', FEATHER, max(FEATHER / 2.5, 0.8))} select frame_id, y, x, cast(round_even(v, 0) as int) as a from soft")
def mask_feather(spark: SparkSession, d: str) -> DataFrame:
    return tiles.to_pixels(tiles.feather(frames(spark, d), "a", FEATHER, TILE), ["a"], TILE)


@query(f"with {_PIXELS}, {_LINES} select frame_id, y, x, stroke, glow from lines")
def mask_outlines(spark: SparkSession, d: str) -> DataFrame:
    return tiles.to_pixels(tiles.outlines(_mask(frames(spark, d)), "mask", STROKE, GLOW, INTENSITY, TILE), ["stroke", "glow"], TILE)


_ONE = lambda c, k: f"cast(round_even(case when a = 255 then {c} else least(1, greatest(0, ({c} / 255.0 * a2 + k{k} * a1 * (1 - a2)) / greatest(a2 + a1 * (1 - a2), 1e-9))) * 255 end, 0) as int) as {c}"


@query(f"""with {_PIXELS}, {_LINES}, z as (select *, glow / 255.0 as ag, stroke / 255.0 * {OPACITY} as st, a / 255.0 as a2 from lines), o as (select *, st + ag * (1 - st) as a1 from z),
m as (select *, {', '.join(f'({s} / 255.0 * st + {g} / 255.0 * ag * (1 - st)) / greatest(a1, 1e-9) as k{k}' for k, (s, g) in enumerate(zip(STROKE_COLOUR, GLOW_COLOUR)))} from o)
select frame_id, y, x, {', '.join(_ONE(c, k) for k, c in enumerate('rgb'))}, cast(round_even((a2 + a1 * (1 - a2)) * 255, 0) as int) as a from m""")
def layered_subject(spark: SparkSession, d: str) -> DataFrame:
    return tiles.to_pixels(tiles.stroke_and_glow(frames(spark, d), STROKE, STROKE_COLOUR, OPACITY, GLOW, GLOW_COLOUR, INTENSITY, TILE), list("rgba"), TILE)


@query(f"""with {_PIXELS}, t as (select frame_id, y, x, (x / greatest(w - 1, 1)::double + y / greatest(h - 1, 1)::double) / 2 as t from px)
select frame_id, y, x, {', '.join(f'cast(round_even({a} * (1 - t) + {b} * t, 0) as int) as {c}' for c, a, b in zip('rgb', STROKE_COLOUR, (10, 20, 200)))} from t""")
def gradient_frames(spark: SparkSession, d: str) -> DataFrame:
    sizes = pixels(spark, d).groupBy("frame_id").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    return tiles.to_pixels(tiles.gradient(sizes, STROKE_COLOUR, (10, 20, 200), "diagonal", TILE), list("rgb"), TILE)
