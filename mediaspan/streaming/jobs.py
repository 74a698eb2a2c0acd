"""The job queue as a stream: files of JSON messages in, decoded jobs and quarantined messages out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mediaspan.sources.jobs import decode_jobs


def read_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as text lines of files that appear in ``folder``."""
    return spark.readStream.format("text").load(folder).withColumnRenamed("value", "payload")


def run_queue(messages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write jobs and quarantine with each batch's number as a partition, overwritten when a batch is repeated: deliveries stay idempotent."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = decode_jobs(batch).persist()
        rows.where("valid").select("job_id", "upload_id", "attempts").write.mode("overwrite").parquet(f"{out}/jobs/batch={number}")
        rows.where("not valid").select("payload").write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        rows.unpersist()

    return messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
