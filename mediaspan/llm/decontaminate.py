"""Benchmark decontamination: n-gram seeds join passages to test items, an upper bound dismisses most pairs of common seeds, Smith-Waterman alignment scores the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BLANKS, Words, inside, mix, runs, separators, slices
from .shared import stash

#: Words of a seed; punctuation separates words here, and A-Z count as a-z.
SEED = 3
#: Alignment: points for a match, a mismatch and a gap; a passage counts from this share of the item's perfect score on.
MATCH, MISMATCH, GAP, SCORE = 2, -1, -1, 0.5
#: Words of items (up to some 32 bytes each) that one pass over the documents is given as a broadcast; more items take several passes.
BROADCAST_SEEDS = 2_000_000
#: Seed hits, or words of passages, that a task looks at together.
BLOCK = 1_000_000
_CUTS = BLANKS | separators(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_U = np.uint64


def item_words(items: DataFrame) -> DataFrame:
    """item, n, words (64-bit hashes, little-endian) for each row of (item, text) that has words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at, w in slices(batch.column(1), _CUTS, True):
                n = np.diff(w.first)
                where = np.flatnonzero(n)
                words = [w.hashes[w.first[k] : w.first[k + 1]].astype("<u8").tobytes() for k in where]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + where)), pa.array(n[where].astype(np.int64)), pa.array(words, pa.binary())], ["item", "n", "words"])

    return items.mapInArrow(run, "item long, n long, words binary")


class Items:
    """Items of one pass: their words, the sorted seeds and each seed's items, and the sorted keys of all pairs (item, word)."""

    def __init__(self, ids: list[int], words: list[bytes], seed: int) -> None:
        self.ids, self.seed = np.array(ids, np.int64), seed
        self.words = [np.frombuffer(x, "<u8").astype(_U) for x in words]
        self.length = np.array([len(x) for x in self.words], np.int64)
        found = [np.unique(runs(x, seed)) for x in self.words]
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        hashes = np.concatenate([np.zeros(0, _U), *found])
        order = np.lexsort((owner, hashes))
        self.owner = owner[order]
        self.seeds, n = np.unique(hashes, return_counts=True)
        self.of = np.repeat(np.arange(len(self.seeds)), n)
        self.pairs = np.unique(self.key(np.repeat(np.arange(len(self.words)), self.length), np.concatenate([np.zeros(0, _U), *self.words])))

    @staticmethod
    def key(item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(word + item.astype(_U) * _U(0x9E3779B97F4A7C15))

    def held(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether the item has the word; a collision of hashes says yes, which only loosens the bound."""
        key = self.key(item, word)
        place = np.searchsorted(self.pairs, key)
        place[place == len(self.pairs)] = 0
        return self.pairs[place] == key

    def hits(self, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, word position of the seed in the slice), sorted, for every seed of a slice and each item that has it; an item's hits come together."""
        h = runs(w.hashes, self.seed)
        where = np.flatnonzero(inside(w.first, self.seed, len(w.hashes))) if len(h) else np.zeros(0, np.int64)
        if not len(where) or not len(self.seeds):
            return
        place = np.searchsorted(self.seeds, h[where])
        place[place == len(self.seeds)] = 0
        good = self.seeds[place] == h[where]
        where, place = where[good], place[good]
        text = np.searchsorted(w.first, where, "right") - 1
        each = np.bincount(place, minlength=len(self.seeds))[self.of]
        block = np.cumsum(np.bincount(self.owner, weights=each, minlength=len(self.ids))).astype(np.int64) // BLOCK
        for b in np.unique(block[self.owner[each > 0]]):
            kept = block[self.owner] == b
            begin = np.concatenate([[0], np.cumsum(np.bincount(self.of[kept], minlength=len(self.seeds)))])
            n = (begin[1:] - begin[:-1])[place]
            at = np.repeat(begin[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item = self.owner[kept][at]
            order = np.lexsort((np.repeat(where, n), item, np.repeat(text, n)))
            yield np.repeat(text, n)[order], item[order], np.repeat(where, n)[order]

    def passages(self, w: Words, score: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, low, high): the words within reach of a pair's seeds, reaches that meet being one passage, where they can hold the score.

        An alignment of at least ``score`` has no more than (3 - 2 * score) times the item's words in the passage: with m matches and e mismatches and gaps,
        2 * m - e >= 2 * score * n and m <= n. Its points are at most the best sum of a span in which a word of the item gives MATCH and another one MISMATCH.
        """
        for text, item, at in self.hits(w):
            reach = np.maximum(self.seed, np.floor((3 - 2 * score) * self.length[item]).astype(np.int64))
            low, high = np.maximum(w.first[text], at + self.seed - reach), np.minimum(w.first[text + 1], at + reach)
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
            start = np.flatnonzero(new)
            last = np.concatenate([start[1:], [len(new)]]) - 1
            text, item, low, high = text[start], item[start], low[start], high[last]
            part = np.cumsum(high - low) // BLOCK
            for k in np.unique(part):
                own = np.flatnonzero(part == k)
                n = high[own] - low[own]
                first = np.cumsum(n) - n
                cells = np.repeat(low[own] - first, n) + np.arange(n.sum())
                gain = np.where(self.held(np.repeat(item[own], n), w.hashes[cells]), MATCH, MISMATCH)
                total = np.cumsum(gain)
                # each passage lies wholly under the one before, so the running minimum starts anew
                shift = np.repeat(np.arange(len(own)) * (MATCH - MISMATCH) * (len(gain) + 1), n)
                before = np.minimum.accumulate(total - gain - shift)
                best = np.maximum.reduceat(total - shift - before, first)
                for i in own[best >= MATCH * score * self.length[item[own]]]:
                    yield int(text[i]), int(item[i]), int(low[i]), int(high[i])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word arrays: (score, begin, end) in the passage.

    Row by row over the item. A row's gaps along the passage are a running maximum, so each row is a few array operations; the start of each path is carried beside
    its score, packed into one integer (score high, later start low), hence ties go to the shorter span.
    """
    n = len(passage)
    wide = 1 << 32
    gap = -GAP * wide * np.arange(n + 1, dtype=np.int64)
    fresh = np.arange(n + 1, dtype=np.int64)  # score 0, starting here
    row, best, end = fresh.copy(), 0, 0
    for x in item:
        step = np.where(passage == x, MATCH, MISMATCH) * wide
        new = fresh.copy()
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        new = np.maximum(new, row + GAP * wide)
        new = np.maximum(new, np.maximum.accumulate(new + gap) - gap)
        row = np.where(new >= wide, new, fresh)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best >> 32, best & (wide - 1), end


def _scored(docs: DataFrame, items: Items, score: float) -> DataFrame:
    """doc, item, score, begin, end for the best alignment of each passage, from ``score`` on."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in parts:
            ids = batch.column(0).to_pylist()
            for at, w in slices(batch.column(1), _CUTS, True):
                out = []
                for text, item, low, high in items.passages(w, score):
                    points, first, last = align(items.words[item], w.hashes[low:high])
                    if (share := points / (MATCH * int(items.length[item]))) >= score:
                        begin = low - int(w.first[text])
                        out.append((ids[at + text], int(items.ids[item]), share, begin + first, begin + last))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], ["doc", "item", "score", "begin", "end"])

    return docs.mapInArrow(run, "doc long, item long, score double, begin int, end int")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, score: float = SCORE) -> DataFrame:
    """doc, item, score (0 to 1: share of the item's perfect score), begin, end: each pair's best passage (word positions) with a score of at least ``score``.

    Every n-gram of an item is a seed, however often it occurs, so copies of a leak cannot hide it. A pair's passages are the words that an alignment through one of
    its seeds can reach; those that cannot have the score by their words alone are dismissed, the others are aligned, all in the task that reads the document.
    Passages that share no ``seed`` consecutive words with the item are not found, whatever their score. Null or empty texts, and items of fewer than ``seed`` words,
    match nothing; repeated rows of a document give its pairs once; equal items each get their pairs; null ids are dropped.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    items = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))
    words = stash(item_words(items), "items")
    passes = -(-(words.agg(F.sum("n")).first()[0] or 0) // BROADCAST_SEEDS)
    found = docs.sparkSession.createDataFrame([], "doc long, item long, score double, begin int, end int")
    for k in range(passes):
        part = words.where(F.pmod(F.xxhash64("words", "item"), F.lit(passes)) == k).toArrow()
        found = found.union(_scored(docs, Items(part["item"].to_pylist(), part["words"].to_pylist(), seed), score))
    best = F.max(F.struct("score", (-F.col("begin")).alias("b"), "end")).alias("x")
    return found.groupBy("doc", "item").agg(best).select(F.col("doc").alias(id_col), F.col("item").alias(item_id), "x.score", (-F.col("x.b")).alias("begin"), "x.end")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item with a matching passage: doc_id, item_id, score, begin, end."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
