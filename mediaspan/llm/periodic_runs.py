"""Periodic runs of words (Kolpakov-Kucherov), one text after another inside Arrow batches.

A word of a run of exponent e comes at least floor(e) times in it, so a text is first cut at words that come less often; stretches shorter than a run
are left out. Each stretch is factorised: a suffix automaton of it, with the first end of each state, gives the longest factors that begin
earlier, too. Main's algorithm finds the runs that cross or touch the border of two factors, by common prefixes and suffixes around
it; runs inside a factor are copied from the factor's earlier occurrence. Words are compared as bytes, not by hashes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least exponent and length of a run.
EXPONENT, LENGTH = 4, 6
#: Bytes of output that a task gathers before it hands on a batch.
BATCH_BYTES = 1 << 22


def stretches(ids: list[int], least: int, length: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches that can hold a run: each word comes ``least`` times in its stretch, and each has ``length`` words."""
    todo = [(0, len(ids))]
    while todo:
        begin, end = todo.pop()
        if end - begin < length:
            continue
        often = Counter(ids[begin:end] if end - begin < len(ids) else ids)
        rare = {w for w, k in often.items() if k < least}
        if not rare:
            yield begin, end
            continue
        at = begin
        for i in [k for k in range(begin, end) if ids[k] in rare]:
            if i - at >= length:
                todo.append((at, i))
            at = i + 1
        if end - at >= length:
            todo.append((at, end))


def factors(w: list[int]) -> list[tuple[int, int]]:
    """(end, shift) of each factor of ``w``: the longest piece from its begin that also begins ``shift`` words earlier; shift 0 for a new word."""
    following: list[dict[int, int]] = [{}]
    suffix, longest, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(following)
        following.append({})
        suffix.append(0)
        longest.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = suffix[p]
        if p >= 0:
            q = following[p][c]
            if longest[q] == longest[p] + 1:
                suffix[new] = q
            else:
                copy = len(following)
                following.append(following[q].copy())
                suffix.append(suffix[q])
                longest.append(longest[p] + 1)
                first.append(first[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = suffix[p]
                suffix[q] = suffix[new] = copy
        last = new
    out, at, n = [], 0, len(w)
    while at < n:
        state, end, shift = 0, at, 0
        while end < n:
            state = following[state][w[end]]
            if first[state] >= end:
                break
            shift = end - first[state]
            end += 1
        end = max(end, at + 1)
        out.append((end, shift))
        at = end
    return out


def _prefixes(s: list[int]) -> list[int]:
    """For each place of ``s``, how many entries from there equal its beginning."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def runs_of(w: list[int], exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """All runs (start, end, smallest period) of ``w`` of at least ``exponent`` periods and ``length`` words, by start and end. ``exponent``: 2 or more."""
    n = len(w)
    found: dict[tuple[int, int], int] = {}
    by_start: list[list[int]] = [[] for _ in range(n)]

    def keep(b: int, e: int, p: int) -> None:
        if e - b < exponent * p or e - b < length or (b and w[b - 1] == w[b - 1 + p]) or (e < n and w[e] == w[e - p]):
            return
        if (b, e) not in found:
            by_start[b].append(e)
        elif found[b, e] <= p:
            return
        found[b, e] = p

    c = before = 0
    for end, shift in [*factors(w), (n, 0)]:  # the last border is the end of the text
        here = end - c
        low = max(0, c - 2 * before - here)
        t, u = w[low:c], w[c:end]
        a, b = len(t), here
        onward = _prefixes([*u, -1, *t, *u])
        back = _prefixes([*reversed(t), -1, *reversed(u), *reversed(t)])
        for p in range(1, b + 1):  # one period or more lies after the border
            right, left = onward[p] if p < b else 0, back[a + 1 + b - p]
            if right + left >= p:
                keep(c - left, c + p + right, p)
        for p in range(1, a + 1):  # one period or more lies before it
            right, left = onward[b + 1 + a - p], back[p] if p < a else 0
            right = min(right, b)
            if right + left >= p:
                keep(c - p - left, c + right, p)
        if shift:
            for s in range(c + 1 - shift, end - shift):  # an occurrence that overlaps the factor has copies of its own
                for e in by_start[s]:
                    if e < end - shift:
                        keep(s + shift, e + shift, found[s, e])
        before, c = here, end
    return sorted((b, e, p) for (b, e), p in found.items())


def text_runs(words: list, exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Runs (start, length, smallest period) of a list of words, by start and period."""
    number: dict = {}
    ids = [number.setdefault(x, len(number)) for x in words]
    out = []
    for begin, end in stretches(ids, exponent, length):
        out += [(begin + b, e - b, p) for b, e, p in runs_of(ids[begin:end], exponent, length)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run holds after its first period."""
    at, out = 0, []
    for first, last in sorted((b + p, b + n) for b, n, p in runs):
        if first > at:
            out += words[at:first]
        at = max(at, last)
    return out + words[at:]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, length: int = LENGTH, words_of: Callable[[object, bytes], list] | None = None) -> DataFrame:
    """Per row: id, n_words, runs (array of start, length, period: word numbers from 0, smallest period), collapsed (binary: the words kept, joined by one space).

    Words are runs of anything but space and the control characters 9 to 13; ``words_of(id, text)`` may give others. A run is a maximal stretch of period
    q (words q apart equal, q the least) with at least ``exponent`` periods and ``length`` words. Null and empty texts have no words and no runs; rows of the same id
    or text are judged each for itself, null ids stay; no rows give none. Other columns are ignored. One text is worked on in one task: memory
    grows with the longest text, not with the table.
    """
    split = words_of or (lambda _, text: text.split())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
            began, size = 0, 0
            rows: tuple[list, list, list] = ([], [], [])
            for k, text in enumerate(texts):
                words = split(ids[k], text.as_py() or b"")
                runs = text_runs(words, exponent, length)
                rest = b" ".join(collapse(words, runs))
                for column, x in zip(rows, (len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], rest)):
                    column.append(x)
                size += len(rest)
                if size > BATCH_BYTES or k + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(began, k + 1 - began), pa.array(rows[0], pa.int64()), pa.array(rows[1], run), pa.array(rows[2], pa.binary())], ["id", "n_words", "runs", "collapsed"])
                    began, size, rows = k + 1, 0, ([], [], [])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def with_made_runs(doc_id: object, text: bytes) -> list[bytes]:
    """The query's words: in texts whose id has a checksum that 10 divides, the words from a place on repeat with one period. A null id's digits are empty."""
    words = text.split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    out = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), words_of=with_made_runs)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    out = out.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.minus")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-F.col("best.minus") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
