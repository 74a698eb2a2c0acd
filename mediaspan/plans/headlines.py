"""Queries of headline layout over the names of parts, and the same in DuckDB's SQL, which walks from word to word for every size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.functions import layout
from mediaspan.plans import adapters as A
from mediaspan.plans.catalogue import query

#: The canvas, and the widths of printable letters by a rule.
WIDTH, HEIGHT = 1280, 720
FONT = layout.Font({chr(c): 300 + c * 37 % 400 for c in range(32, 127)}, other=500)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Each name four times in capitals, with a largest size, a side and a subject by its key."""
    k = F.col("p_partkey")
    rows = A.table(spark, d, "part").select("p_partkey", F.upper(F.concat_ws(" ", "p_name", "p_name", "p_name", "p_name")).alias("text"), (30 + k % 50 * 2).cast("int").alias("largest"), F.when(k % 2 == 1, "right").otherwise("left").alias("side"))
    k, right = F.col("p_partkey"), F.col("side") == "right"
    subject = F.when(k % 5 > 0, F.when(right, 500 + k % 600).otherwise(k % 300)).cast("int")
    return rows.withColumn("zone", layout.headline_zone(F.lit(WIDTH), F.lit(HEIGHT), F.col("side"), subject, F.lit(280)))


_PARTS = f"""p as (select p_partkey as k, string_split_regex(upper(concat_ws(' ', p_name, p_name, p_name, p_name)), '\\s+') as words, 30 + p_partkey % 50 * 2 as largest, p_partkey % 2 = 1 as r,
case when p_partkey % 5 > 0 then case when p_partkey % 2 = 1 then 500 + p_partkey % 600 else p_partkey % 300 end end as sx from part),
z0 as (select *, case when r then 40 else greatest(40, coalesce(sx + 280 + 40, floor({WIDTH} * 0.34)::int)) end as zl from p),
z as (select *, greatest(1, case when r then greatest(least(1050, {WIDTH} - 40, coalesce(sx - 40, floor({WIDTH} * (2.0 / 3))::int - 40)), 41) else greatest(least(1050, {WIDTH}) - 40, zl + 1) end - zl) as zw, floor({HEIGHT} * 0.12)::int as zt, floor({HEIGHT} * 0.62)::int - floor({HEIGHT} * 0.12)::int as zh from z0),
w as (select k, i, list_sum(list_transform(string_split(words[i], ''), lambda c: case when ascii(c) between 32 and 126 then 300 + ascii(c) * 37 % 400 else 500 end))::int as u from p, unnest(range(1, len(words) + 1)) as t(i)),
s as (select k, zw, zh, unnest(case when largest >= 36 then range(largest, 35, -2) else [36] end) as size from z),
walk as (select s.k, size, zw * 1000 // size as most, 1 as i, 1 as line, u from s join w on w.k = s.k and w.i = 1
 union all select walk.k, size, most, w.i, case when walk.u + {300 + 32 * 37 % 400} + w.u <= most then line else line + 1 end, case when walk.u + {300 + 32 * 37 % 400} + w.u <= most then walk.u + {300 + 32 * 37 % 400} + w.u else w.u end from walk join w on w.k = walk.k and w.i = walk.i + 1),
l as (select k, size, line, most, max(i) as last, max(u) as u from walk group by all),
m as (select k, size, count(*) as n, bool_and(u <= most) as narrow, (ceil(size * 930 / 1000.0) + ceil(size * 240 / 1000.0))::int as high from l group by k, size),
f as (select m.*, greatest(1, floor(high * 0.18)::int) as sp, narrow and high * n + greatest(1, floor(high * 0.18)::int) * (n - 1) <= zh as fits from m join z using (k)),
best as (select k, coalesce(max(size) filter (fits), 36) as size from f group by k),
b as (select best.k, best.size, n, high, sp, z.zl, z.zw, greatest(0, zt + floor((zh - (high * n + sp * (n - 1))) / 2)::int) as top from best join f using (k, size) join z using (k)),
x as (select b.*, line, last, ceil(u * b.size / 1000.0)::int as wide from b join l on l.k = b.k and l.size = b.size),
e as (select k, size, n, min(zl + floor((zw - wide) / 2)::int) as l, max(zl + floor((zw - wide) / 2)::int + wide) as r, any_value(top) as t, any_value(top + (n - 1) * (high + sp) + high) as bt, string_agg(last::varchar, ',' order by line) as ends from x group by k, size, n)"""


@query(f"""with recursive {_PARTS} select k as p_partkey, size::int as size, n::int as n_lines, ends, l as "left", case when r > 1050 and bt > 600 then t - (bt - 600) else t end::int as top, r as "right", case when r > 1050 and bt > 600 then 600 else bt end::int as bottom from e""")
def headline_layout(spark: SparkSession, d: str) -> DataFrame:
    """Size, lines (number of the last word of each) and box of every headline."""
    # a row takes a quarter of a millisecond and some four bytes of the file, so files' splits would make too few tasks
    parts = _parts(spark, d).repartition(3 * spark.sparkContext.defaultParallelism, "p_partkey")
    rows = parts.withColumn("fitted", layout.fit_headline(F.col("text"), FONT, F.col("zone"), F.col("largest")))
    rows = rows.withColumn("b", layout.headline_boxes(F.col("fitted"), FONT, F.col("zone"))["bbox"])
    counts = F.transform("fitted.lines", lambda x: F.size(layout.words_of(x["text"])))
    ends = F.aggregate(counts, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    return rows.select("p_partkey", "fitted.size", F.size("fitted.lines").alias("n_lines"), F.array_join(ends, ",").alias("ends"), "b.left", "b.top", "b.right", "b.bottom")


@query(f"""select p_partkey, case when p_partkey % 2 = 1 then greatest(0, {WIDTH} - (p_size * 30) - (p_partkey % 120 - 20)) else least(greatest(0, p_partkey % 120 - 20), greatest(0, {WIDTH} - p_size * 30)) end::int as x, ({HEIGHT} - p_size * 20)::int as y from part""")
def subject_places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    at = layout.place_subject(F.when(k % 2 == 1, "right").otherwise("left"), F.col("p_size") * 30, F.col("p_size") * 20, F.lit(WIDTH), F.lit(HEIGHT), k % 120 - 20)
    return A.table(spark, d, "part").select("p_partkey", at["x"].cast("int").alias("x"), at["y"].cast("int").alias("y"))
