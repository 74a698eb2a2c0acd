"""Domain tables made from the supplied test tables: the same definitions as in the catalogue's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01 in seconds.
EPOCH = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a segment of its user: one second is one ms, the value gives the length."""
    at = F.unix_seconds(F.col("ts").cast("timestamp")) - EPOCH
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), "event_id", at.alias("start_ms"), (at + F.floor(F.col("value") * 1000)).alias("end_ms"), "event_type", "value")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech(spark, sf_dir).groupBy("media_id").agg((F.max("end_ms") + 1000).alias("total_ms"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations, 400 ms apart and 350 ms long; turns are segments."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_idx"), F.posexplode(F.filter(F.split("text", "[ \n]+"), lambda w: w != "")).alias("pos", "word"))
    start = (F.col("seg_idx") * 1000 + F.col("pos")) * 400
    return rows.select("media_id", "seg_idx", (F.col("seg_idx") * 1000 + F.col("pos")).alias("word_idx"), "word", start.alias("start_ms"), (start + 350).alias("end_ms"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy("media_id", "seg_idx").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding components as a signal."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("media_id"), F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: value as sharpness, luminance from the id."""
    return speech(spark, sf_dir).select("media_id", F.col("event_id").alias("frame_id"), F.col("start_ms").alias("at_ms"), F.col("value").alias("sharpness"), (F.col("event_id") * 37 % 256).cast("double").alias("luminance"), (F.col("event_type") != "error").alias("face"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech(spark, sf_dir).select("media_id", F.col("event_id").alias("sample_id"), F.col("start_ms").alias("at_ms"), (F.col("event_id") * 7919 % 1000 / 1000.0).alias("x"), (F.col("event_type") != "error").alias("detected"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queue messages: native and wrapped ones in turn, every seventh malformed, every eleventh without a path, every thirteenth with a number as upload."""
    key = F.col("o_orderkey").cast("string")
    path = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.concat(F.lit(',"filePath":"/in/'), key, F.lit('.mp4"')))
    upload = F.when(F.col("o_orderkey") % 13 == 0, key).otherwise(F.concat(F.lit('"u'), key, F.lit('"')))
    fields = F.concat(F.lit('"jobId":"j'), key, F.lit('","uploadId":'), upload, path, F.lit(',"createdAt":"2024-01-01T00:00:00Z"'))
    native = F.concat(F.lit("{"), fields, F.lit(',"attempts":"'), (F.col("o_custkey") % 4).cast("string"), F.lit('"}'))
    wrapped = F.concat(F.lit('{"attempts":null,"data":{'), fields, F.lit('},"opts":{"attempts":'), (F.col("o_custkey") % 3 + 1).cast("string"), F.lit(".7}}"))
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('{"jobId":'), key)).when(F.col("o_orderkey") % 2 == 0, native).otherwise(wrapped)
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("payload"))
