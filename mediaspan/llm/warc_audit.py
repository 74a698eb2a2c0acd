"""WARC fixity audit: Merkle trees over ordered offset ranges of record files, compared between replicas from the root down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import stash

#: Bytes of a leaf's offset range; children of a node.
LEAF_BYTES, FANOUT = 1 << 14, 16


def payload_digest(payload: Column) -> Column:
    """SHA-256 of a payload; a null one hashes apart from an empty one."""
    return F.sha2(F.concat(F.when(payload.isNull(), "n").otherwise("v"), F.coalesce(payload, F.lit(""))).cast("binary"), 256)


def record_hashes(records: DataFrame) -> DataFrame:
    """file, offset, record_id, digest of records (file, offset, record_id, and a payload or its digest)."""
    digest = F.col("digest") if "digest" in records.columns else payload_digest(F.col("payload"))
    return records.select("file", F.col("offset").cast("long").alias("offset"), "record_id", digest.alias("digest"))


def _field(value: Column) -> Column:
    """A field with its length before it, so that no other list of fields reads alike; a null one is ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _folded(order: list[str | Column], digest: Column) -> Column:
    """Hash of a bounded group's entries in order."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct(*order, digest.alias("d")))), lambda x: F.concat(*[_field(x[f]) for f in [*order, "d"]]))
    return F.sha2(F.array_join(entries, "").cast("binary"), 256)


def merkle_levels(hashes: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees, leaves first: (file, node, digest, records); the last level has one node, 0, for each file.

    A leaf holds the records whose offset lies in its range of ``leaf_bytes``, so no task sees more than a range; a parent holds ``fanout`` ranges. The
    number of levels follows from the largest offset.
    """
    level = hashes.groupBy("file", F.expr(f"offset div {leaf_bytes}").alias("node")).agg(_folded(["offset", "record_id"], F.col("digest")).alias("digest"), F.count("*").alias("records"))
    levels = [stash(level, "level")]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top > 0:
        top //= fanout
        level = levels[-1].groupBy("file", F.expr(f"node div {fanout}").alias("up")).agg(_folded(["node"], F.col("digest")).alias("digest"), F.sum("records").alias("records"))
        levels.append(stash(level.withColumnRenamed("up", "node"), "level"))
    return levels


def audit(one: DataFrame, two: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records in which two replicas differ: file, record_id, offset_a, offset_b, digest_a, digest_b, kind (changed, moved, missing, extra).

    Roots are compared first and only branches that differ are followed; records are compared in the leaf ranges that differ. Null files or
    offsets are left out of the trees (a record without place cannot be audited). In ranges that differ, rows equal in all fields cancel out as often as both replicas hold them; what is
    left of a record id in a file is paired in the order of offset and digest, so a record that one replica holds once more is reported once. Empty replicas give every record of the other.
    """
    a, b = (stash(record_hashes(x.where("file is not null and offset is not null")), "records") for x in (one, two))
    la, lb = merkle_levels(a, leaf_bytes, fanout), merkle_levels(b, leaf_bytes, fanout)
    while len(la) != len(lb):  # a shallower tree gets parents
        short = la if len(la) < len(lb) else lb
        up = short[-1].groupBy("file", F.expr(f"node div {fanout}").alias("up")).agg(_folded(["node"], F.col("digest")).alias("digest"), F.sum("records").alias("records"))
        short.append(stash(up.withColumnRenamed("up", "node"), "level"))
    bad = None
    for x, y in zip(reversed(la), reversed(lb)):
        if bad is not None:
            up = bad.select("file", F.col("node").alias("up"))
            x, y = (z.withColumn("up", F.expr(f"node div {fanout}")).join(up, ["file", "up"], "left_semi") for z in (x, y))
        sides = [z.select("file", "node", F.struct("digest", "records").alias(name)) for z, name in ((x, "x"), (y, "y"))]
        both = sides[0].join(sides[1], ["file", "node"], "full")
        bad = stash(both.where("not (x <=> y)").select("file", "node"), "differ")
    inside = lambda z, one: z.withColumn("node", F.expr(f"offset div {leaf_bytes}")).join(bad, ["file", "node"], "left_semi").withColumn("d", F.lit(one))
    rows = inside(a, 1).unionByName(inside(b, -1)).groupBy("file", "record_id", "offset", "digest").agg(F.sum("d").alias("d")).where("d <> 0")
    rows = rows.withColumn("own", F.expr("d > 0")).withColumn("again", F.explode(F.sequence(F.lit(1), F.abs("d"))))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("file", "record_id", "own").orderBy("offset", "digest")))
    of = lambda own, c, s: F.max(F.when(F.col("own") if own else ~F.col("own"), F.col(c))).alias(f"{c}_{s}")
    pairs = rows.groupBy("file", "record_id", "nth").agg(of(True, "offset", "a"), of(True, "digest", "a"), of(False, "offset", "b"), of(False, "digest", "b")).drop("nth")
    kind = F.when(F.col("offset_b").isNull(), "missing").when(F.col("offset_a").isNull(), "extra").when(F.expr("not (digest_a <=> digest_b)"), "changed").otherwise("moved")
    return pairs.withColumn("kind", kind)


def page_records(pages: DataFrame, payload: Column) -> DataFrame:
    """Pages as hashed records: a file for each 1024 page ids, offsets by the lengths before in it. Texts are hashed before anything is shuffled."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + 64
    hashed = pages.select(F.expr("page_id div 1024").alias("file"), F.col("page_id").alias("record_id"), size.alias("size"), payload_digest(payload).alias("digest"))
    before = F.sum("size").over(W.partitionBy("file").orderBy("record_id").rowsBetween(W.unboundedPreceding, -1))
    return hashed.select("file", F.coalesce(before, F.lit(0)).alias("offset"), "record_id", "digest")


def op6_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against a replica with planted damage (altered when id mod 97 is 13, lost when id mod 211 is 5): record_id, file, kind, byte_offset."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    own = page_records(pages, F.col("html"))
    replica = page_records(pages, F.when(F.expr("page_id % 97 = 13"), F.concat("html", F.lit("!"))).otherwise(F.col("html"))).where("record_id % 211 <> 5")
    return audit(own, replica).select("record_id", "file", "kind", F.coalesce("offset_a", "offset_b").alias("byte_offset"))


OP6_SQL = """
with r as (
  select page_id as record_id, page_id // 1024 as file,
    cast(coalesce(sum(coalesce(strlen(html), 0) + 64) over (partition by page_id // 1024 order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_offset
  from pages
)
select record_id, file, case when record_id % 211 = 5 then 'missing' else 'changed' end as kind, byte_offset from r
where record_id % 211 = 5 or record_id % 97 = 13
"""
