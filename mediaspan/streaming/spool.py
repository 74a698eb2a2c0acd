"""A queue that acknowledges: a spool folder as a stream source with offsets, jobs handled by micro-batches, retries as new messages.

Writers put files of one JSON message a line into ``<spool>/in`` (complete files, by rename). The source numbers them in ``<spool>/log``; a numbered file is deleted
when the batch that holds it is committed, so until then a restart reads it again. Everything a batch writes bears the batch's number and replaces what an
earlier attempt at it wrote: messages are neither lost nor handled twice in the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from mediaspan.sources.jobs import backoff_ms, decode_jobs, failure_payload

#: Files that are numbered for a batch at most; further ones wait for the next.
FILES = 1000
#: The code of errors without one, and of time-outs.
UNKNOWN, TIMED_OUT = "MEDIA_PROCESSING_ERROR", "TIMEOUT_EXCEEDED"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, root.rstrip("/")


def _names(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class Segment(InputPartition):
    """One numbered file."""

    path: str
    number: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.files = options["path"], int(options.get("filesperbatch", FILES))

    def _log(self) -> tuple[fs.FileSystem, str, list[tuple[int, str]]]:
        store, root = _store(self.path)
        return store, root, [(int(name.split("-")[0]), name) for name in _names(store, f"{root}/log")]

    def _acknowledged(self, store: fs.FileSystem, root: str) -> int:
        if store.get_file_info([f"{root}/_acknowledged"])[0].type != fs.FileType.File:
            return 0
        with store.open_input_stream(f"{root}/_acknowledged") as file:
            return int(file.read() or b"0")

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        """Number the files that have arrived, in the order of their names."""
        store, root, log = self._log()
        last = max([self._acknowledged(store, root), *(n for n, _ in log)])
        arrived = _names(store, f"{root}/in")[: self.files]
        store.create_dir(f"{root}/log", recursive=True)
        for number, name in enumerate(arrived, last + 1):
            store.move(f"{root}/in/{name}", f"{root}/log/{number:015d}-{name}")
        return {"number": last + len(arrived)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        _, root, log = self._log()
        return [Segment(f"{root}/log/{name}", n) for n, name in log if start["number"] < n <= end["number"]]

    def read(self, partition: Segment) -> Iterator[tuple]:
        store = _store(self.path)[0]
        with store.open_input_stream(partition.path) as file:
            lines = file.read().decode("utf-8", "replace").split("\n")
        for k, line in enumerate(lines):
            if line.strip():
                yield partition.number, k, line

    def commit(self, end: dict) -> None:
        """The batch is in the results: note the number, then delete its files."""
        store, root, log = self._log()
        with store.open_output_stream(f"{root}/_acknowledged") as file:
            file.write(str(max(end["number"], self._acknowledged(store, root))).encode())
        for n, name in log:
            if n <= end["number"]:
                store.delete_file(f"{root}/log/{name}")


class Spool(DataSource):
    """Format ``spool``: segment, line, payload. Option filesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return "segment long, line long, payload string"

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Reader(self.options)


def read_spool(spark: SparkSession, spool: str, **options: object) -> DataFrame:
    spark.dataSource.register(Spool)
    return spark.readStream.format("spool").options(**options).load(spool)


def handled(messages: DataFrame, handle: Callable[[DataFrame], DataFrame], now_ms: int, attempts: int = 3, retried: tuple[str, ...] = (TIMED_OUT,)) -> DataFrame:
    """``messages`` (payload and others) with job fields, status, error_code, transition (JSON, of failed ones) and retry (JSON of the next attempt).

    ``handle`` adds error_code and error (null: done) to valid jobs, row by row, so that one message's failure is its own. Status: done, failed, retried (a failure with one of
    the codes ``retried`` and attempts left: the message comes again with one attempt more, after a doubling pause), waiting (``notBefore`` is still to come; the
    message comes again as it is) or quarantined (no valid job).
    """
    rows = decode_jobs(messages).withColumn("not_before", F.get_json_object("payload", "$.notBefore").try_cast("bigint"))
    waits = F.col("valid") & (F.coalesce(F.col("not_before"), F.lit(0)) > now_ms)
    rows = rows.withColumn("waits", waits)
    tried = handle(rows.where("valid and not waits"))
    others = rows.where("not valid or waits").withColumns({"error_code": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    every = tried.select(*rows.columns, "error_code", "error").unionByName(others)
    code = F.when(F.col("error").isNotNull() | F.col("error_code").isNotNull(), F.coalesce("error_code", F.lit(UNKNOWN)))
    again = F.col("error_code").isin(*retried) & (F.col("attempts") < attempts)
    every = every.withColumn("error_code", code)
    status = F.when(~F.col("valid"), "quarantined").when(F.col("waits"), "waiting").when(again, "retried").when(F.col("error_code").isNotNull(), "failed").otherwise("done")
    every = every.withColumn("status", status)
    job = F.to_json(F.struct(F.col("job_id").alias("jobId"), F.col("upload_id").alias("uploadId"), F.col("file_path").alias("filePath"), F.col("created_at").alias("createdAt"), F.from_json(F.get_json_object("payload", "$.metadata"), "map<string,string>").alias("metadata"), (F.col("attempts") + 1).alias("attempts"), (F.lit(now_ms) + backoff_ms(F.col("attempts"))).alias("notBefore")))
    details = F.create_map(F.lit("errorType"), F.coalesce("error_code", F.lit(UNKNOWN)))
    return every.withColumns(
        {
            "transition": F.when(F.col("status") == "failed", failure_payload(F.col("error_code"), F.coalesce("error", F.lit("")), details)),
            "retry": F.when(F.col("status") == "retried", job).when(F.col("status") == "waiting", F.col("payload")),
        }
    ).drop("waits", "not_before")


def run_spool(spark: SparkSession, spool: str, out: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame], clock: Callable[[], int], counted: Callable[[int, dict], None] | None = None, attempts: int = 3, trigger: dict | None = None, **options: object) -> StreamingQuery:
    """Handle a spool's messages: results as ``<out>/results/batch=<number>``, retries back into the spool, counters of each batch to ``counted``.

    Only when both are written is the batch committed and are its messages deleted. A batch that stopped anywhere before that is done again in full and replaces its results.
    """

    def sink(batch: DataFrame, number: int) -> None:
        seen = Observation(f"jobs-{number}")
        counters = {"jobs_processed": F.count_if(F.col("status").isin("done", "failed", "retried")), "jobs_succeeded": F.count_if(F.col("status") == "done"), "jobs_failed": F.count_if(F.col("status").isin("failed", "retried")), "jobs_timed_out": F.count_if(F.col("error_code") == TIMED_OUT), "quarantined": F.count_if(F.col("status") == "quarantined"), "waiting": F.count_if(F.col("status") == "waiting")}
        rows = handled(batch, handle, clock(), attempts).observe(seen, *[c.alias(name) for name, c in counters.items()])
        target = f"{out}/results/batch={number}"
        rows.write.mode("overwrite").parquet(target)
        spark.read.parquet(target).where("retry is not null").select("retry").write.mode("overwrite").text(f"{spool}/retries/batch={number}")
        store, root = _store(spool)
        for name in _names(store, f"{root}/in"):
            if name.startswith(f"retry-{number}-"):
                store.delete_file(f"{root}/in/{name}")
        store.create_dir(f"{root}/in", recursive=True)
        for k, name in enumerate(_names(store, f"{root}/retries/batch={number}")):
            store.move(f"{root}/retries/batch={number}/{name}", f"{root}/in/retry-{number}-{k:05d}.jsonl")
        if counted:
            counted(number, seen.get)

    writer = read_spool(spark, spool, **options).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
