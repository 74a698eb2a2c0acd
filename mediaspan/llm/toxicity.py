"""Toxicity: a linear-chain conditional random field over sentences tags toxic tokens; its marginals make document scores.

Token labels come from labelled documents: a token is marked in a toxic document if its word is far commoner in toxic than in clean
ones. The field has two states, a weight for each known word, a bias and transitions, and is fitted on a bounded sample of labelled rows
by gradient ascent on its conditional likelihood. Scoring covers every token of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BLANKS, Words, separators, slices
from .shared import stash

#: Labelled documents that the fit reads at most, by the least hash of their id; and words that it keeps at most.
SAMPLE, VOCABULARY = 4_000, 50_000
#: Tokens of a sentence at most; a longer one is cut there.
SENTENCE = 48
#: Tokens of the fit's sample that are worked on at once (some 150 bytes each on the driver).
FIT_TOKENS = 200_000
#: Score from which a document is called toxic, and marginal from which a token adds to its score.
THRESHOLD, FAINT = 0.3, 0.2
_CUTS = BLANKS | separators(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789")
_STOPS = separators(b".!?\n")
_U = np.uint64


def sentences(w: Words) -> np.ndarray:
    """Where sentences begin among the words of a slice: at a text's start, after a stop, after SENTENCE words."""
    stop = np.concatenate([[0], np.cumsum(_STOPS[w.data])])
    new = np.ones(len(w.starts), bool)
    if len(w.starts):
        new[1:] = stop[w.starts[1:]] != stop[w.starts[:-1]]
        new[w.first[w.first < len(new)]] = True
        begin = np.flatnonzero(new)
        inner = np.arange(len(new)) - begin[np.cumsum(new) - 1]
        new |= inner % SENTENCE == 0
    return np.flatnonzero(new)


def parts(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """(k, to) such that the tokens from ``edges[k]`` to ``edges[to]`` are FIT_TOKENS at most, or those of one sentence or text."""
    k = 0
    while k < len(edges) - 1:
        to = max(k + 1, int(np.searchsorted(edges, edges[k] + FIT_TOKENS, "right")) - 1)
        yield k, to
        k = to


class Field:
    """Two-state chain: ``words`` (sorted hashes) with weights for state 1, ``bias``, 2x2 ``moves``; ``calibration`` of document scores."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.weights, self.bias, self.moves = words, np.zeros(len(words)), -2.0, np.zeros((2, 2))
        self.calibration = np.array([-2.0, 1.0, 1.0])

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, at, -1)

    def marginals(self, known: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over all sentences at once: P(state 1) of each token; expected moves of all; log partition of each sentence."""
        n = len(known)
        emit = np.ones((n, 2))
        emit[:, 1] = np.exp(np.clip(self.bias + np.append(self.weights, 0.0)[known], -30, 30))
        length = np.diff(np.append(begin, n))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        moves = np.exp(self.moves)
        forward, backward, norm = np.empty((n, 2)), np.ones((n, 2)), np.ones(n)
        active = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]) if len(length) else 0)]  # sentences longer than t
        for t, k in enumerate(active):
            at = begin[:k] + t
            a = emit[at] if t == 0 else (forward[at - 1] @ moves) * emit[at]
            norm[at] = a.sum(1)
            forward[at] = a / norm[at, None]
        pairs = np.zeros((2, 2))
        for t in range(len(active) - 1, 0, -1):
            at = begin[: active[t]] + t
            tail = emit[at] * backward[at] / norm[at, None]
            pairs += moves * (forward[at - 1].T @ tail)
            backward[at - 1] = tail @ moves.T
        logs = np.add.reduceat(np.log(norm), np.sort(begin)) if n else np.zeros(0)
        return (forward * backward)[:, 1], pairs, logs

    def fit(self, known: np.ndarray, begin: np.ndarray, labels: np.ndarray, rounds: int = 30, rate: float = 0.3, ridge: float = 0.02) -> None:
        """Adam on the penalised log-likelihood of the token labels; a gradient is summed over parts of whole sentences."""
        n = max(1, int(labels.sum()))
        edges = np.append(begin, len(known))
        runs = [(slice(edges[k], edges[to]), begin[k:to] - begin[k]) for k, to in parts(edges)]
        seen = np.zeros(4)
        for own, starts in runs:
            moves = 2 * labels[own][:-1].astype(np.int64) + labels[own][1:]
            seen += np.bincount(np.delete(moves, starts[1:] - 1), minlength=4)
        seen = seen.reshape(2, 2)
        size = len(self.weights)
        theta = np.concatenate([self.weights, [self.bias], self.moves.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            words, gaps, pairs = np.zeros(size), 0.0, np.zeros((2, 2))
            for own, starts in runs:
                p, moves, _ = self.marginals(known[own], starts)
                gap, good = labels[own] - p, known[own] >= 0
                words += np.bincount(known[own][good], gap[good], minlength=size)[:size]
                gaps, pairs = gaps + gap.sum(), pairs + moves
            grad = np.concatenate([words, [gaps], (seen - pairs).ravel()]) / n - ridge * theta / n
            m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.98**k)) + 1e-9)
            self.weights, self.bias, self.moves = theta[:size], float(theta[size]), theta[size + 1 :].reshape(2, 2)

    def features(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text: 1, the largest marginal, log of 1 + the sum of those from FAINT on: the small ones of a long clean text don't add up."""
        out = np.zeros((len(first) - 1, 3))
        out[:, 0] = 1
        full = first[1:] > first[:-1]
        if full.any():
            out[full, 1] = np.maximum.reduceat(p, first[:-1][full])
            out[full, 2] = np.log1p(np.add.reduceat(np.where(p >= FAINT, p, 0.0), first[:-1][full]))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.calibration, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of labels on features by Newton steps with a small ridge."""
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            w = w + np.linalg.solve(hess, x.T @ (y - p) - 0.1 * w)
        self.calibration = w


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_counts(rows: DataFrame) -> DataFrame:
    """word (hash; null counts documents), bad and all: in how many toxic documents, and in how many at all, each word stands. ``rows``: doc_id, text, toxic (0 or 1).

    Every row counts once, so a repeated row counts again. Counts of a slice of documents are added up before the exchange.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            toxic = batch.column(2).to_numpy(zero_copy_only=False)
            for at, w in slices(batch.column(1), _CUTS, True):
                n = len(w.first) - 1
                doc = np.repeat(np.arange(n), np.diff(w.first))
                order = np.lexsort((w.hashes, doc))
                h, d = w.hashes[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                word, of = np.unique(h[new], return_inverse=True)
                bad = toxic[at : at + n].astype(np.int64)
                in_bad = np.bincount(of, bad[d[new]], minlength=len(word)).astype(np.int64)
                in_all = np.bincount(of, minlength=len(word)).astype(np.int64)
                words = pa.array([*word.view(np.int64).tolist(), None], pa.int64())
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(in_bad, bad.sum())), pa.array(np.append(in_all, n))], ["word", "bad", "all"])

    return rows.mapInArrow(count, "word long, bad long, all long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))


def fit_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Field:
    """Fit on labelled documents that are not held out: words and their token labels come from counts over all of them, weights from at most ``sample``.

    A repeated label counts once, toxic if one of them says so; labels without a document, null labels and null ids are left out. Without documents of both
    classes, every score is the labels' mean (0.1 where there is none). The driver gets ``vocabulary`` words and the words of ``sample`` documents at most.
    """
    chosen = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # one plan at every size: a broadcast of few labels would only hide what the exchange of texts takes
    counts = stash(word_counts(texts.join(chosen.hint("merge"), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))), "words")
    total = counts.where("word is null").first()
    n_bad, n_all = max(1, total["bad"] if total else 0), max(1, total["all"] if total else 0)
    odds = ((F.col("bad") + 0.5) / (n_bad + 1)) / ((F.col("all") - F.col("bad") + 0.5) / (n_all - n_bad + 1))
    ranked = counts.where("word is not null and bad >= 3").select("word", odds.alias("odds"), (F.col("bad") / F.col("all")).alias("share"), (F.col("bad") * F.log(F.greatest(odds, F.lit(1.0)))).alias("strength"))
    kept = ranked.orderBy(F.desc("strength"), "word").limit(vocabulary).toArrow()
    word = kept["word"].to_numpy().astype(np.int64).view(_U)
    order = np.argsort(word)
    field = Field(word[order])

    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            toxic = batch.column(2).to_pylist()
            ids = batch.column(0).to_pylist()
            for at, w in slices(batch.column(1), _CUTS, True):
                begin = sentences(w)
                for k in range(len(w.first) - 1):
                    a, b = w.first[k], w.first[k + 1]
                    own = begin[(begin >= a) & (begin < b)] - a
                    yield pa.RecordBatch.from_arrays([pa.array([x]) if not isinstance(x, bytes) else pa.array([x], pa.binary()) for x in (int(ids[at + k]), int(toxic[at + k]), w.hashes[a:b].astype("<u8").tobytes(), own.astype("<i4").tobytes())], ["doc_id", "toxic", "words", "begin"])

    table = rows.mapInArrow(digest, "doc_id long, toxic long, words binary, begin binary").toArrow().sort_by("doc_id")
    toxic = table["toxic"].to_numpy()
    empty = np.zeros(0, np.int32)
    known = [field.known(np.frombuffer(x.as_buffer(), "<u8")).astype(np.int32) for x in table["words"]]
    first = np.concatenate([[0], np.cumsum([len(x) for x in known])]).astype(np.int64)
    known = np.concatenate([empty, *known])
    begin = np.concatenate([empty, *[np.frombuffer(x.as_buffer(), "<i4") + a for x, a in zip(table["begin"], first)]]).astype(np.int64)
    bad = toxic == 1
    if 0 < bad.sum() < len(bad):
        flagged = np.append((kept["share"].to_numpy()[order] >= 0.5) & (kept["odds"].to_numpy()[order] >= 4), False)
        field.fit(known, begin, (flagged[known] & (known >= 0) & np.repeat(bad, np.diff(first))).astype(np.int8))
        features = []
        for k, to in parts(first):
            own = slice(first[k], first[to])
            p = field.marginals(known[own], begin[(begin >= first[k]) & (begin < first[to])] - first[k])[0]
            features.append(field.features(p, first[k : to + 1] - first[k]))
        field.calibrate(np.concatenate(features), toxic.astype(float))
    else:
        mean = float(np.clip(toxic.mean(), 0.01, 0.99)) if len(toxic) else 0.1
        field.calibration = np.array([np.log(mean / (1 - mean)), 0.0, 0.0])
    return field


def tag_toxic(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", span_from: float = 0.5) -> DataFrame:
    """Every row of ``docs`` (id, text): id, score, spans (begin, end: byte offsets of runs of tokens whose marginal is at least ``span_from``).

    Only the text is read. Null and empty texts get the score of a text without marked tokens and no spans; rows that repeat come back as often.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(field)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = fitted.value
        for batch in parts:
            ids = batch.column(0)
            for at, w in slices(batch.column(1), _CUTS, True):
                p = field.marginals(field.known(w.hashes), sentences(w))[0]
                score = field.score(field.features(p, w.first))
                spans = [[] for _ in score]
                hot = np.flatnonzero(p >= span_from)
                for x in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1) if len(hot) else ():
                    k = int(np.searchsorted(w.first, x[0], "right")) - 1
                    spans[k].append({"begin": int(w.starts[x[0]] - w.offsets[k]), "end": int(w.ends[x[-1]] - w.offsets[k])})
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(score)), pa.array(score), pa.array(spans, kind)], ["id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, spans array<struct<begin: int, end: int>>")
    return out.withColumnRenamed("id", id_col)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted, spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return tag_toxic(docs, field).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
