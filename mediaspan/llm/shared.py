"""Helpers that several operators use: durable tables and connected components."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir``, or one in the warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


def stash(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later steps restart from there when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/mediaspan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage: Spark's cleaner then deletes shuffle files that no step refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Marks:
    """A bit table of keys as a small table to be broadcast, for rows that needn't be dealt anew: at least eight bits a key up to 2**MOST_BITS bits. ``kept`` rows may have one of the keys,
    rows ``left`` have none for sure; nulls are keys, too. Callers decide exactly afterwards, so the error costs time, not results.
    """

    MOST_BITS = 24

    def __init__(self, keys: DataFrame, column: str) -> None:
        bits = min(self.MOST_BITS, max(12, (8 * keys.count()).bit_length()))
        self.slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits + 6)
        self.bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(c).bitwiseAND(F.lit(63)).cast("int"))
        self.table = F.broadcast(keys.groupBy(self.slot(column).alias("__slot")).agg(F.bit_or(self.bit(column)).alias("__bits")))

    def _joined(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("__at", self.slot(column)).join(self.table, F.col("__at") == F.col("__slot"), "left").withColumn("__may", F.coalesce(F.col("__bits").bitwiseAND(self.bit(column)), F.lit(0).cast("long")) != 0)

    def kept(self, df: DataFrame, column: str) -> DataFrame:
        return self._joined(df, column).where("__may").select(*df.columns)

    def left(self, df: DataFrame, column: str) -> DataFrame:
        return self._joined(df, column).where("not __may").select(*df.columns)


class KeyTable:
    """A bit table of 64-bit hashes, broadcast: says no for sure, yes with some error. Its size has a bound (2**MOST_BITS bits, 16 MB);
    beyond 2**(MOST_BITS - 4) keys more strangers pass. Callers decide exactly afterwards, so the error costs time, not results.
    """

    MOST_BITS = 27

    def __init__(self, keys: DataFrame, column: str) -> None:
        keys = stash(keys.select(F.col(column).cast("long").alias("key")), "keys")
        self.bits = bits = min(self.MOST_BITS, max(10, (16 * keys.count()).bit_length()))
        slot = F.shiftrightunsigned("key", 64 - bits)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
        words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(bit).alias("v")).toArrow()
        filled = np.zeros(1 << (bits - 6), np.int64)
        filled[words["w"].to_numpy()] = words["v"].to_numpy()
        self.table = keys.sparkSession.sparkContext.broadcast(filled.view(np.uint8))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.table.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` (longs): rows (node, component), component being the smallest node.

    Each round, every node takes the neighbour of the least hash as parent, parents are followed twice, and edges are
    contracted to distinct pairs of parents. Hashes make the parent trees shallow whatever the ids' order; each round
    removes a constant share of the nodes. Null ends and self-links are ignored; no edges give no rows.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("n"))
    left = stash(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    mapping = None
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        parent = stash(both.groupBy("u").agg(F.least(order(F.col("u")), F.min(order(F.col("v"))))["n"].alias("p")), "parents")
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
        for _ in range(2):
            parent = parent.join(up, "p").select("u", F.col("q").alias("p"))
        parent = stash(parent, "parents")
        mapping = (
            parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
            if mapping is None
            else mapping.join(parent.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        )
        mapping = stash(mapping, "mapping")
        pu, pv = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left = left.join(pu, "u").join(pv, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        left = stash(left, "edges")
    if mapping is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = mapping.groupBy("root").agg(F.min("node").alias("component"))
    return mapping.join(least, "root").select("node", "component")
