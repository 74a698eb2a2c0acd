"""Spelling variants: words one edit apart, found by a positional q-gram index with a count filter, and the form that each leads to.

Words are dealt into shards so that each pair one edit apart meets in exactly one of them. A pair of lengths (m, m) or (m, m + 1) is of band m; with its first
difference in ``lo .. hi - 1`` both words have equal first ``lo`` and equal last ``m - hi`` letters, and that is the shard's key. The range is halved
for all words once and again wherever a shard has too many words, down to one place, where the alphabet bounds the shard. In a shard, an inverted
index lists each 2-gram by its place and the word's length; a word's lists are merged by a heap, and words in as many of them as one edit
leaves at least are compared.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stash

#: Letters, shortest word, fewest occurrences, and how much commoner a form must be.
LETTERS, LEAST_CHARS, LEAST_N, COMMONER = "A-Za-zÀ-ÿ", 7, 2, 10
#: Shards of more words are halved; a hot shard's rows are joined by so many salts; a task hands on its counts at so many words or letters.
SHARD, SALTS, HELD_WORDS, HELD_CHARS = 128, 16, 200_000, 1 << 23
_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, letters: str = LETTERS, change: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """word, n: the distinct words of ``least_chars`` letters and ``least_n`` occurrences or more.

    Words are maximal runs of ``letters``, only A-Z lower-cased; ``change(id, word)`` may alter a text's word (it may shorten it, not lengthen it). Null texts have none.
    """
    pattern = re.compile(f"[{letters}]{{{least_chars},}}")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for batch in parts:
            texts = batch.column(1).cast(pa.large_binary())
            for doc_id, text in zip(batch.column(0).cast(pa.binary()), texts):
                own, raw = doc_id.as_py() or b"", text.as_py() or b""
                for word, k in Counter(pattern.findall(raw.translate(_TO_LOWER).decode("utf-8", "replace"))).items():
                    if change:
                        word = change(own, word)
                        if len(word) < least_chars:
                            continue
                    held[word] += k
                    chars += len(word) if held[word] == k else 0
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield rows()
                    held, chars = Counter(), 0
        yield rows()

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _halves(rows: DataFrame) -> DataFrame:
    mid = F.expr("(lo + hi) div 2").cast("int")
    part = F.explode(F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi"))))
    return rows.select("word", "n", "m", part.alias("r")).select("word", "n", "m", "r.lo", "r.hi")


def _keyed(rows: DataFrame) -> DataFrame:
    tail = F.greatest(F.lit(0), F.col("m") - F.col("hi"))
    return rows.withColumn("head", F.substring("word", F.lit(1), F.col("lo"))).withColumn("tail", F.substring("word", F.length("word") - tail + 1, tail))


KEY = ["m", "lo", "hi", "head", "tail"]


def shards(words: DataFrame, least_chars: int = LEAST_CHARS, shard: int = SHARD) -> DataFrame:
    """m, lo, hi, members (word, n): every pair one edit apart is in exactly one row, the one whose range holds its first difference.

    The halving of shards above ``shard`` words ends after log2 of the longest word's length rounds at most.
    """
    size = F.length("word")
    bands = F.explode(F.when(size > least_chars, F.array(size, size - 1)).otherwise(F.array(size)))
    left = _halves(words.select("word", "n", bands.alias("m")).select("word", "n", "m", F.lit(0).alias("lo"), (F.col("m") + 1).alias("hi")))
    done = None
    while True:
        left = stash(_keyed(left), "shards")
        hot = stash(left.groupBy(*KEY).count().where(F.col("count") > shard).where("hi - lo > 1").select(*KEY), "hot")
        if hot.isEmpty():
            break
        salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = left.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        cool = rows.join(salted, [*KEY, "salt"], "left_anti").drop("salt")
        done = cool if done is None else done.unionByName(cool)
        left = _halves(rows.join(salted, [*KEY, "salt"], "left_semi"))
    done = left if done is None else done.unionByName(left)
    return done.groupBy(*KEY).agg(F.collect_list(F.struct("word", "n")).alias("members")).where(F.size("members") > 1).select("m", "lo", "hi", "members")


def near_in_shard(words: list[str], m: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sorted ``words`` one edit apart whose first difference lies in ``lo .. hi - 1``; word i has ``m`` letters, word j as many or one more."""
    tail = max(0, m - hi)
    lists: dict[tuple[int, str, int], list[int]] = defaultdict(list)
    own: list[list[tuple[int, str]]] = []
    for k, word in enumerate(words):
        padded = f"\0{word}\0"
        # 2-grams within the equal heads and tails are in every word and are not listed
        own.append([(at, padded[at : at + 2]) for at in range(lo, len(word) - tail + 1)])
        for at, gram in own[-1]:
            lists[at, gram, len(word)].append(k)
    of_length = {size: [k for k, word in enumerate(words) if len(word) == size] for size in (m, m + 1)}
    for i in of_length[m]:
        x = words[i]
        for size, shifts in ((m, (0,)), (m + 1, (0, 1))):
            least = size - tail - lo - 1  # of the longer word's grams here, one edit changes two at most
            if least < 1:
                candidates = of_length[size]
            else:
                postings = [p for at, gram in own[i] for s in shifts if (p := lists.get((at + s, gram, size)))]
                if size == m:
                    postings = [p[bisect_right(p, i) :] for p in postings]
                candidates = [j for j, same in groupby(heapq.merge(*postings)) if sum(1 for _ in same) >= least]
            for j in candidates:
                if size == m and j <= i:
                    continue
                y, k = words[j], lo
                while k < m and x[k] == y[k]:
                    k += 1
                if k < hi and x[k + 1 if size == m else k :] == y[k + 1 :]:
                    yield i, j


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS, shard: int = SHARD) -> DataFrame:
    """word, n, n_near, near_n, near: how many of ``words`` (word, n) are one inserted, deleted or replaced letter away, and the commonest of them (ties: smallest word).

    Words without any have n_near 0 and nulls. Every word is of ``least_chars`` letters or more; each word comes once.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for m, lo, hi, members in zip(*(batch.column(c).to_pylist() for c in range(4))):
                members = sorted((x["word"], x["n"]) for x in members)
                n_near, best = Counter(), {}
                for i, j in near_in_shard([x[0] for x in members], m, lo, hi):
                    for a, b in ((i, j), (j, i)):
                        n_near[a] += 1
                        rank = (-members[b][1], members[b][0])
                        best[a] = min(best.get(a, rank), rank)
                for a, k in n_near.items():
                    for column, x in zip(out, (members[a][0], k, -best[a][0], best[a][1])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "k", "near_n", "near"])

    links = shards(words, least_chars, shard).mapInArrow(work, "word string, k long, near_n long, near string")
    best = F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), "near"))
    rows = words.select("word", "n", F.lit(0).cast("long").alias("k"), F.lit(None).alias("best")).unionByName(links.select("word", F.lit(None).alias("n"), "k", best.alias("best")))
    return rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("k").alias("n_near"), F.min("best").alias("best")).select("word", "n", "n_near", (-F.col("best.minus")).alias("near_n"), F.col("best.near").alias("near"))


def group_variants(words: DataFrame, commoner: int = COMMONER, least_chars: int = LEAST_CHARS, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n. A word's form is its commonest near word where that comes ``commoner`` times as often or more; root is where forms lead to.

    Counts grow along forms, so there are no circles and a path is no longer than the logarithm of the largest count; paths are doubled each round. No words give no rows.
    """
    is_form = F.col("near_n") >= commoner * F.col("n")
    found = near_words(words, least_chars, shard).select("word", F.when(is_form, F.col("near")).alias("form"), "n", "n_near", F.when(is_form, F.col("near_n")).alias("form_n"))
    found = stash(found, "near")
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stash(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_slips(doc_id: bytes, word: str) -> str:
    """The query's words: one letter is missing where 31 divides the checksum of ``<doc_id>:<word>``. A null id is written as nothing."""
    h = zlib.crc32(word.encode(), zlib.crc32(doc_id + b":"))
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents with 7 letters and 2 occurrences or more: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; rows of one id or text count as often as they come; other columns are ignored; without words there are no rows.
    """
    words = stash(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=with_slips), "words")
    return group_variants(words)
