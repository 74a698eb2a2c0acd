"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

Listed canonical URLs are (host, path prefix, verdict). A listed entry fits its host and every subdomain when the URL's path
starts with the entry's path; the longest fitting entry decides, an unfit URL is allowed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 32 bits in a block, bits set for each key.
BLOCK_WORDS, KEY_BITS = 8, 4
#: Largest list (entries) whose filter is a literal and whose table is broadcast.
BROADCAST_ENTRIES = 200_000
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: from there up to ``? #``. Both empty for null or without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    parts = "^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, parts, 1), _UPPER, _LOW), F.regexp_extract(rest, parts, 2)


def _bits(key: Column, blocks: int) -> list[tuple[Column, Column]]:
    """(word index from 1, bit) of each of a key's bits; all lie in one block."""
    h = F.xxhash64(key)
    block = F.pmod(h, F.lit(blocks)) * BLOCK_WORDS
    out = []
    for k in range(KEY_BITS):
        piece = F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 20)
        out.append(((block + F.pmod(piece, F.lit(BLOCK_WORDS)) + 1).cast("int"), F.pmod(F.shiftrightunsigned(piece, 8), F.lit(32)).cast("int")))
    return out


def bloom_words(listed: DataFrame, entries: int) -> list[int]:
    """The filter of ``listed.key``: about 16 bits a key, its words OR-ed by Spark. At most BROADCAST_ENTRIES / 2 words reach the driver."""
    blocks = max(1, -(-entries * 16 // (32 * BLOCK_WORDS)))
    pairs = listed.select(F.explode(F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in _bits(F.col("key"), blocks)])).alias("x"))
    words = [0] * (blocks * BLOCK_WORDS)
    for r in pairs.groupBy("x.w").agg(F.bit_or(F.expr("shiftleft(1L, x.b)")).alias("v")).collect():
        words[r["w"] - 1] = r["v"]
    return words


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``listed``: rows (host, path, verdict); rule is host + path. Each URL makes a key for every host suffix at a label boundary
    and every listed path length; keys that the filter passes are joined with the list. A tie in length goes to the smaller rule,
    then verdict. Columns of ``pages`` named host, path, rule or verdict are replaced. Null URLs, an empty list or no pages: no rule, allow.
    """
    listed = listed.where("host is not null and path is not null").select(
        F.concat("host", F.lit("\u0000"), "path").alias("key"), F.concat("host", "path").alias("rule"), F.length("path").alias("n"), "verdict"
    ).distinct()
    lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())  # at most the longest path's length
    entries = listed.count()
    host, path = host_and_path(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if not entries:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths]))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\u0000"), p))))
    small = entries <= BROADCAST_ENTRIES
    if small:
        words = bloom_words(listed, entries)
        table = F.lit(words)
        blocks = len(words) // BLOCK_WORDS

        def passes(key: Column) -> Column:
            found = F.lit(True)
            for w, b in _bits(key, blocks):
                found = found & (F.element_at(table, w).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0)
            return found

        keys = F.filter(keys, passes)
    sites = pages.where("host <> ''").select("host", "path").distinct().withColumn("key", F.explode(keys))
    side = F.broadcast(listed) if small else listed
    best = (
        sites.join(side, "key")
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("k"), "rule", "verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return pages.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


#: The query's list.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: page_id, host, path, rule, verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) as path from u
), r(rhost, rpath, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (
  select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(v, length(rhost || rpath)) as v
  from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id
)
select p.page_id, host, path, rule, coalesce(v, 'allow') as verdict from p left join m using (page_id)
"""
