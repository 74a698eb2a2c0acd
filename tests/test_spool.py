"""The acknowledging queue: stopped between writing and committing, nothing is lost or doubled; retries, waiting, counters."""

import json
import time

from pyspark.sql import functions as F

from mediaspan.streaming.spool import run_spool


def message(k, **more):
    return json.dumps({"jobId": f"j{k}", "uploadId": f"u{k}", "filePath": f"/{k}.mp4", "createdAt": "2024-01-01", "metadata": {"k": str(k)}, **more})


def put(spool, name, lines):
    (spool / "in").mkdir(parents=True, exist_ok=True)
    part = spool / f"_{name}"
    part.write_text("\n".join(lines))
    part.rename(spool / "in" / name)


def handle(rows):
    """Every seventh job fails for good, every fifth runs out of time until its third attempt."""
    k = F.regexp_extract("job_id", "[0-9]+", 0).cast("int")
    late = (k % 5 == 0) & (F.col("attempts") < 3)
    return rows.withColumns({"error_code": F.when(late, "TIMEOUT_EXCEEDED").when(k % 7 == 0, F.lit(None).cast("string")), "error": F.when(late, "too slow").when(k % 7 == 0, "broken file")})


def work(spark, tmp, until, stop_after=None, start=0):
    """Run until ``until(results)``; the sink's ``stop_after``-th batch fails after it has written everything."""
    now, counts, batches = [start], {}, []

    def clock():
        now[0] += 10_000
        return now[0]

    def counted(number, seen):
        batches.append(number)
        if stop_after is not None and len(batches) == stop_after:
            raise RuntimeError("stopped between writing and committing")
        counts[number] = seen

    query = run_spool(spark, str(tmp / "spool"), str(tmp / "out"), str(tmp / "checkpoint"), handle, clock, counted, trigger={"processingTime": "200 milliseconds"}, filesPerBatch=2)
    end = time.monotonic() + 100
    while query.isActive and time.monotonic() < end and not until(results(spark, tmp)):
        time.sleep(0.5)
    failed = query.exception() is not None
    query.stop()
    return counts, failed, now[0]


def results(spark, tmp):
    if not list((tmp / "out").glob("results/batch=*/_SUCCESS")):
        return []
    try:
        return spark.read.parquet(*[str(p.parent) for p in (tmp / "out").glob("results/batch=*/_SUCCESS")]).select("job_id", "status", "attempts", "error_code", "transition").collect()
    except Exception:  # noqa: BLE001 - a batch is being replaced
        return []


def test_nothing_lost_or_doubled(spark, tmp_path):
    for f in range(3):
        put(tmp_path / "spool", f"m{f}.jsonl", [message(k) for k in range(f * 10, f * 10 + 10)] + (["not json", '{"jobId": 5}'] if f == 1 else []))
    final = lambda rows: sorted(r.job_id for r in rows if r.status in ("done", "failed"))
    _, failed, now = work(spark, tmp_path, lambda rows: False, stop_after=1)
    assert failed and len(list((tmp_path / "spool/log").iterdir())) == 2  # not acknowledged
    counts, failed, _ = work(spark, tmp_path, lambda rows: len(final(rows)) >= 30, start=now)
    assert not failed
    rows = results(spark, tmp_path)
    assert final(rows) == sorted(f"j{k}" for k in range(30)), (len(counts), sorted((r.job_id or "", r.status, r.attempts) for r in rows))
    by = lambda status: sorted(int(r.job_id[1:]) for r in rows if r.status == status)
    assert by("failed") == [k for k in range(30) if k % 7 == 0]
    assert by("retried") == sorted([k for k in range(30) if k % 5 == 0] * 2)
    assert sum(r.status == "quarantined" for r in rows) == 2
    assert {r.attempts for r in rows if r.status in ("done", "failed") and int(r.job_id[1:]) % 5 == 0} == {3}
    assert all(r.error_code == "MEDIA_PROCESSING_ERROR" and json.loads(r.transition)["to"] == "FAILED" for r in rows if r.status == "failed")
    total = {name: sum(c[name] for c in counts.values()) for name in next(iter(counts.values()))}
    assert (total["jobs_succeeded"], total["jobs_failed"], total["jobs_timed_out"], total["quarantined"]) == (25, 5 + 12, 12, 2)


def test_messages_wait_for_their_time(spark, tmp_path):
    put(tmp_path / "spool", "a.jsonl", [message(1, notBefore=35_000), message(2)])
    work(spark, tmp_path, lambda rows: sum(r.status == "done" for r in rows) == 2)
    rows = results(spark, tmp_path)
    assert [r.job_id for r in rows if r.status == "done"].count("j1") == 1
    assert sum(r.status == "waiting" for r in rows) == 3  # at 10, 20 and 30 seconds
