"""Job messages: queue envelopes as JSON text, decoded with SQL functions in batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.functions import text


def _field(v: Column, name: str) -> Column:
    """The field as a variant: SQL null if the key is absent, a variant null if its value is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column) -> Column:
    """A JSON string's value; null for values of other types."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _whole(v: Column) -> Column:
    """An integer of a number (towards zero), a boolean or the text of an integer."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(kind == "STRING", F.trim(F.try_variant_get(v, "$", "string")).try_cast("int"))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int"))
        .when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("int"))
    )


def decode_jobs(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """``raw`` with job_id, upload_id, file_path, created_at, attempts, valid. A native message has the keys jobId and uploadId at the top, others in ``data``; native wins.

    Valid ones have texts for all four fields and an object for metadata, if there is one; of others the fields are null. Attempts: top, then ``opts``, else 1. The text is parsed once.
    """
    v = F.col("_message")
    names = {"job_id": "jobId", "upload_id": "uploadId", "file_path": "filePath", "created_at": "createdAt"}
    native = _field(v, "jobId").isNotNull() & _field(v, "uploadId").isNotNull()
    rows = raw.withColumn("_message", F.try_parse_json(payload)).withColumn("_job", F.when(native, v).otherwise(_field(v, "data")))
    # each field is looked up once and each text read once: later columns refer to these
    looked = {f"_{c}": _field(F.col("_job"), name) for c, name in names.items()}
    rows = rows.select(*raw.columns, *[c.alias(n) for n, c in looked.items()], _field(F.col("_job"), "metadata").alias("_extra"), _field(v, "attempts").alias("_own"), F.try_variant_get(v, "$.opts.attempts", "variant").alias("_opts"))
    rows = rows.select(*raw.columns, "_extra", *[_text(F.col(n)).alias(n) for n in looked], F.coalesce(_whole(F.col("_own")), _whole(F.col("_opts")), F.lit(1)).alias("attempts"))
    good = F.col("_extra").isNull() | F.schema_of_variant("_extra").startswith("OBJECT")
    for n in looked:
        good = good & F.col(n).isNotNull()
    rows = rows.withColumn("valid", F.coalesce(good, F.lit(False)))
    return rows.select(*raw.columns, *[F.when(F.col("valid"), F.col(f"_{c}")).alias(c) for c in names], "attempts", "valid")


def transition_url(base: Column, upload_id: Column) -> Column:
    """``{upload_id}`` filled in, without slashes at the base's end."""
    return F.replace(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/uploads/{upload_id}/transition")), F.lit("{upload_id}"), upload_id)


def backoff_ms(attempt: Column) -> Column:
    return (500 * F.pow(F.lit(2), attempt - 1)).cast("bigint")


# The reasons of the two transitions.
DONE = "Audiovisual processing completed (VAD, surgical cuts, EBU R128 loudness)"
FAILED = "Video processing error: "


def success_metadata(path: Column, seconds: Column, segments: Column, silence_ms: Column, loudness: Column, zoomed: Column, zooms: Column, strategy: Column | None = None, thumbnail: Column | None = None, score: Column | None = None, shorts: Column | None = None) -> Column:
    """The report of a finished job; optional fields are left out of the JSON where they are null, shorts where there are none. ``loudness``: (integratedLufs, truePeakDbtp, lra)."""
    fields = {"processedVideoPath": path, "duration": seconds, "speechSegmentsCount": segments, "silenceRemovedMs": silence_ms, "loudness": loudness, "dynamicZoomApplied": zoomed, "zoomShotsCount": zooms, "zoomStrategy": strategy, "thumbnailPath": thumbnail, "thumbnailScore": score, "shorts": None if shorts is None else F.when(F.size(shorts) > 0, shorts)}
    return F.struct(*[c.alias(name) for name, c in fields.items() if c is not None])


def success_payload(metadata: Column, status: str = "AUTO_QA") -> Column:
    """JSON of a finished job's transition."""
    return F.to_json(F.struct(F.lit(status).alias("to"), F.lit(DONE).alias("reason"), metadata.alias("metadata")))


def failure_payload(code: Column, message: Column, details: Column | None = None) -> Column:
    """JSON of a failed job's transition; ``details`` (a map of texts) overrides the three fields."""
    known = F.create_map(F.lit("errorCode"), code, F.lit("errorType"), F.lit("WorkerError"), F.lit("errorDetails"), message)
    if details is not None:
        details = F.coalesce(details, F.create_map().cast("map<string,string>"))
        known = F.map_concat(F.map_filter(known, lambda k, v: ~F.map_contains_key(details, k)), details)
    return F.to_json(F.struct(F.lit("FAILED").alias("to"), F.concat(F.lit(FAILED), message).alias("reason"), known.alias("metadata")))


def enqueue_payload(job: Column, attempts: Column) -> Column:
    """JSON of a job (a struct) in the native form with its attempts."""
    return F.to_json(job.withField("attempts", attempts))


def publish_package(hook: Column, summary: Column, reason: Column, video_title: Column, tags: Column, most: int = 100, default: str = "Corte de alto impacto") -> Column:
    """(title, description, hashtags) of a cut; empty texts count as missing."""
    given = lambda c: F.nullif(c, F.lit(""))
    title = text.truncate_words(F.coalesce(given(hook), given(summary), given(video_title), F.lit(default)), most)
    tagged = text.hashtags(tags)
    return F.struct(title.alias("title"), F.concat_ws("\n\n", title, given(summary), given(reason), F.array_join(tagged, " ")).alias("description"), tagged.alias("hashtags"))
