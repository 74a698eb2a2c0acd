"""Substring dedup: seed with winnowed anchors, extend, and remove words of repeats of at least LENGTH words.

Of each 16 consecutive 20-word runs the one of least hash is an anchor, so every 35-word window holds an anchor that depends on
the window's words only: equal windows share it. Anchors that occur once in the corpus are dropped by an exact count. Around each
remaining anchor the match is extended both ways over all windows that hold it. Stretches of such windows are cut at window hashes into
blocks; a block whose words come twice is a repeat as a whole, and the windows of all other blocks are compared one by one with those of all
distinct blocks. Maximal repeats are the unions of windows that occur elsewhere. Equality is that of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, inside, mix, runs, sliding, slices, spans
from .shared import KeyTable, stash

LENGTH, SEED = 35, 20
#: Blocks have about this many windows.
BLOCK = 32
_U = np.uint64


def _anchors(w: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows that lie in one text, their anchors' hashes, hash of every anchor position)."""
    good = inside(w.first, length, len(w.hashes))
    if not good.any():
        return np.zeros(0, int), np.zeros(0, _U), np.zeros(0, _U)
    grams = runs(w.hashes, seed)
    near = length - seed + 1
    least = sliding(grams, near, np.minimum)
    kept = np.where(good, least, _U(0))
    edge = np.zeros(near - 1, _U)
    most = sliding(np.concatenate([edge, kept, edge]), near, np.maximum)
    starts = np.flatnonzero(good)
    return starts, least[starts], grams[(most == grams) & (most > 0)]


def _fresh(tids: list, seen: set) -> np.ndarray:
    """Which texts this task has not met yet; it remembers a bounded number."""
    if len(seen) > 200_000:
        seen.clear()
    out = np.zeros(len(tids), bool)
    for k, t in enumerate(tids):
        if t not in seen:
            seen.add(t)
            out[k] = True
    return out


def _each(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list]]:
    """Slices (of tid, text) with texts that repeat within the task emptied."""
    seen: set = set()
    for batch in parts:
        tids = batch.column(0).to_pylist()
        fresh = _fresh(tids, seen)
        texts = batch.column(1).filter(pa.array(fresh))
        tids = [t for t, f in zip(tids, fresh) if f]
        for at, w in slices(texts):
            yield w, tids[at : at + len(w.first) - 1]


def repeated_windows(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """tid, starts: runs (pos, n) of the windows whose words also start elsewhere. ``docs``: tid (hash of the text), text; equal texts count as one."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, _ in _each(parts):
            h, k = np.unique(_anchors(w, length, seed)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(k.astype(np.int64))], ["anchor", "k"])

    again = docs.mapInArrow(count, "anchor long, k long").groupBy("anchor").agg(F.sum("k").alias("k")).where("k > 1")
    table = KeyTable(again, "anchor")

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, tids in _each(parts):
            starts, least, _ = _anchors(w, length, seed)
            starts = starts[table.may_hold(least)]
            if not len(starts):
                continue
            doc = np.searchsorted(w.first, starts, "right") - 1
            hashes = runs(w.hashes, length)[starts]
            cut = (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1]) | (hashes[1:] % _U(BLOCK) == 0)
            begin = np.concatenate([[0], np.flatnonzero(cut) + 1])
            end = np.concatenate([begin[1:], [len(starts)]])
            own = np.array(tids, np.int64)[doc[begin]]
            pos = starts[begin] - w.first[doc[begin]]
            spot = mix(own.astype(_U) + mix(pos.astype(_U)))
            edges = np.concatenate([begin, [len(starts)]]).astype(np.int32) * 8
            content = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(hashes.tobytes())])
            columns = [pa.array(spans(hashes, begin, end).astype(np.int64)), pa.array(own), pa.array(pos.astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(spot.astype(np.int64)), content]
            yield pa.RecordBatch.from_arrays(columns, ["block", "tid", "pos", "n", "spot", "windows"])

    found = docs.mapInArrow(blocks, "block long, tid long, pos int, n int, spot long, windows binary")
    distinct = found.groupBy("block").agg(F.min("spot").alias("a"), F.max("spot").alias("b"), F.first("tid").alias("tid"), F.first("pos").alias("pos"), F.first("windows").alias("windows"))
    distinct = stash(distinct, "blocks")
    whole = found.select("block", "tid", "pos", "n").join(distinct.where("a <> b").select("block"), "block", "left_semi").select("tid", "pos", "n")

    def single(parts: Iterator[pa.RecordBatch], among: KeyTable | None) -> Iterator[pa.RecordBatch]:
        """Windows of distinct blocks, so that each row is another place; those of repeated blocks count as two."""
        for batch in parts:
            content = batch.column(3)
            edges = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1] // 8
            hashes = np.frombuffer(content.buffers()[2], np.int64)[edges[0] : edges[-1]]
            n = np.diff(edges)
            tid, pos, k = (np.repeat(batch.column(c).to_numpy(), n) for c in (0, 1, 2))
            pos = pos + (np.arange(len(hashes)) - np.repeat(edges[:-1] - edges[0], n))
            kept = among.may_hold(hashes.view(_U)) if among else np.ones(len(hashes), bool)
            yield pa.RecordBatch.from_arrays([pa.array(x[kept].astype(kind)) for x, kind in ((hashes, np.int64), (tid, np.int64), (pos, np.int32), (k, np.int64))], ["window", "tid", "pos", "k"])

    def exploded(rows: DataFrame, among: KeyTable | None = None) -> DataFrame:
        return rows.selectExpr("tid", "pos", "if(a = b, 1, 2) as k", "windows").mapInArrow(lambda parts: single(parts, among), "window long, tid long, pos int, k long")

    twice = exploded(distinct).groupBy("window").agg(F.sum("k").alias("k")).where("k > 1").select("window")
    twice = stash(twice, "windows")
    parts = exploded(distinct.where("a = b"), KeyTable(twice, "window")).drop("k").join(twice, "window", "left_semi").select("tid", "pos", F.lit(1).alias("n"))
    return whole.union(parts).groupBy("tid").agg(F.collect_set(F.struct("pos", "n")).alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (binary: kept words joined by one space), kept_sha256.

    Words are runs of anything but space and the control characters 9 to 13, unchanged. A word goes if a window of ``length`` words that covers it has a
    word sequence that starts anywhere else, in the same or another document, judged on the input. Null texts are empty;
    texts of fewer than ``length`` words stay whole; rows of the same id or text are documents of their own. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    copies = docs.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select("tid", F.lit(True).alias("copied"))
    marks = repeated_windows(docs.select("tid", "text"), length, seed).join(copies, "tid", "full").select("tid", F.coalesce("copied", F.lit(False)).alias("copied"), F.when(F.col("copied").isNull(), F.col("starts")).alias("starts"))
    marks = stash(marks, "marks")

    def kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out: list[list] = [[], [], [], []]
            texts, copied = batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()
            starts = batch.column(3)
            for k, text in enumerate(texts):
                words = text.as_py().split()
                n = len(words)
                at = starts[k].values if starts[k].is_valid else None
                if copied[k] and n >= length:
                    words = []
                elif at is not None and len(at):
                    edges = np.zeros(n + 1, np.int32)
                    pos, many = at.field(0).to_numpy(), at.field(1).to_numpy()
                    np.add.at(edges, pos, 1)
                    np.subtract.at(edges, pos + many + (length - 1), 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:n]) == 0)]
                rest = b" ".join(words)
                for column, x in zip(out, (n, n - len(words), rest, hashlib.sha256(rest).hexdigest())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())], ["id", "n_words", "n_removed", "kept", "kept_sha256"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.join(marks, "tid", "left").select("id", "text", "copied", "starts")
    return rows.mapInArrow(kept, f"id {kind}, n_words long, n_removed long, kept binary, kept_sha256 string").withColumnRenamed("id", id_col)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
