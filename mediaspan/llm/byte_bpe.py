"""Byte-level BPE: Spark's higher-order functions fold ranked merges over the byte arrays of distinct words.

Words are counted over all documents first; the most frequent (FREQUENT at most) are folded once and broadcast. Then each task turns a block of documents into one
row: its other distinct words as the first states of their folds, every document as indexes of words, and the rank map as a table of id pairs. The fold runs in the JVM on the row's
words; ids of documents are then gathered from the folded words, and decoding takes the ids' binary pieces and concatenates them. Only the counts are shuffled.
"""

from __future__ import annotations

import base64
from array import array as numbers
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stash

#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Stretches of text that are kept as Python strings before they go to Arrow; words whose states are made at once.
STRETCHES, STATES = 50_000, 20_000
#: Rows of an Arrow batch that are counted at once; after each, Arrow's pool gives unused memory back.
COUNTED = 2_000
#: Words that are folded once and broadcast, at most; words of a block of these.
FREQUENT, FREQUENT_BLOCK = 250_000, 20_000
#: Words of more bytes are merged in the task (the fold takes time in the square of the length).
LONG_WORD = 256
#: Slots of the rank map, bits of an id.
SLOTS, ID_BITS = 1 << 20, 17
MASK, NONE = (1 << ID_BITS) - 1, 1 << 40
#: White space: of one byte, and the bytes of the rest as numbers.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WIDE = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)], np.uint32)


class Vocabulary:
    """Ranks of byte strings, read on the driver from a tiktoken file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.table, self.shift = self._rank_map()
        # pieces that are whole characters, and their ranks
        texts = {}
        for piece, rank in self.ranks.items():
            try:
                texts[piece.decode()] = rank
            except UnicodeDecodeError:
                pass
        self.names, self.name_ranks = pa.array(list(texts), pa.string()), np.array(list(texts.values()), np.int64)

    def _rank_map(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (a, b) whose pieces make a piece: its id is in slot ``shift[a] + b``, as ``id << ID_BITS | a``.

        One id more than there are pieces marks a word's ends; it makes no pair. Left ids with most partners are placed first, each at the first of a fixed run of random shifts that leaves its slots free.
        """
        partners: dict[int, list[tuple[int, int]]] = {}
        for piece, rank in self.ranks.items():
            for k in range(1, len(piece)):
                a, b = self.ranks.get(piece[:k]), self.ranks.get(piece[k:])
                if a is not None and b is not None:
                    partners.setdefault(a, []).append((b, rank))
        if len(self.pieces) >= min(SLOTS, 1 << ID_BITS):
            raise ValueError("too many ids for the rank map")
        table, shift = np.full(SLOTS, -1, np.int64), np.zeros(len(self.pieces) + 1, np.int32)
        shifts = np.random.default_rng(0)
        for a in sorted(partners, key=lambda a: (-len(partners[a]), a)):
            b, rank = np.array(partners[a], np.int64).T
            for _ in range(1000):
                at = int(shifts.integers(0, SLOTS - len(shift)))
                if (table[at + b] < 0).all():
                    break
            else:
                raise ValueError("the rank map needs more slots")
            table[at + b], shift[a] = (rank << ID_BITS) | a, at
        return table, shift

    def merge(self, word: bytes) -> list[int]:
        """Ranked merges of one long word, pair by pair from a heap."""
        import heapq

        ids, left, right = [int(self.bytes[b]) for b in word], list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        rank = lambda i: self.ranks.get(self.pieces[ids[i]] + self.pieces[ids[right[i]]]) if right[i] < len(ids) else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or right[i] >= len(ids) or ids[right[i]] != b:
                continue
            j = right[i]
            ids[i], ids[j], right[i] = r, -1, right[j]
            if right[i] < len(ids):
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k, ids[k], ids[right[k]]))
        return [x for x in ids if x >= 0]


def _pair(a: str, b: str) -> str:
    """SQL: ``rank << ID_BITS | a`` of the pair (a, b), the rank being NONE if it makes no piece. A slot that another left id took shows that id, an empty one -1."""
    slot = f"ranks[shift[{a}] + {b}]"
    return f"if({slot} & {MASK} = {a}, {slot}, {NONE << ID_BITS} + {a})"


def folded(end: int) -> Column:
    """SQL: the arrays of ids in ``words`` (``states``) after their ranked merges by the rank map in ``ranks`` and ``shift``.

    Arrays that need merges begin with the pair of the id ``end``; the others stay. The state has one number for each id: the rank of its pair with
    the next id, then the id. Each step takes the least number, the leftmost of equals (place p): it gives way to the new id, whose pairs with
    both neighbours are looked up.
    """
    left, new, right = f"int(s[p - 2] & {MASK})", f"int(shiftright(s[p - 1], {ID_BITS}))", f"int(s[p + 1] & {MASK})"
    merged = f"concat(slice(s, 1, p - 2), array({_pair(left, new)}, {_pair(new, right)}), slice(s, p + 2, size(s)))"
    step = f"transform(array(int(array_position(s, m))), p -> {merged})[0]"
    step = f"transform(array(array_min(s)), m -> if(m < {NONE << ID_BITS}, {step}, s))[0]"
    fold = f"aggregate(sequence(4, size(w)), w, (s, k) -> {step}, s -> transform(slice(s, 2, size(s) - 2), x -> x & {MASK}))"
    return F.expr(f"transform(words, w -> if(w[0] = {(NONE << ID_BITS) + end}, {fold}, w))")


def stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut where white space (of one byte) follows something else, as slices of their buffer, and where each text's begin among them.

    No match of the pattern begins in one run of white space and what follows it and ends in another, nor looks beyond, so each can be matched by itself.
    """
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    low = int(offsets[0])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    blank = BLANK[data[low:]]
    begins = np.zeros(len(blank) + 1, bool)
    np.greater(blank[1:], blank[:-1], out=begins[1:-1])
    # longer white space before a cut is of the same run
    wide = np.flatnonzero(begins[1:-1] & (data[low:-1] >= 128)) + low + 1 if len(blank) > 1 else np.zeros(0, np.int64)
    last = data[wide - 2].astype(np.uint32) << 8 | data[wide - 1]
    begins[wide[np.isin(last, WIDE) | np.isin(last | data[np.maximum(wide - 3, 0)].astype(np.uint32) << 16, WIDE)] - low] = False
    begins[offsets[:-1][offsets[1:] > offsets[:-1]] - low] = True
    cuts = np.flatnonzero(begins) + low
    edges = np.searchsorted(cuts, offsets)
    made = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, offsets[-1]).astype(np.int32)), texts.buffers()[2] or pa.py_buffer(b""))
    return made, edges.astype(np.int64)


def _lists(values: np.ndarray, edges: list[int] | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(edges, np.int32)), pa.array(values))


def _ends(widths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])


def _taken(begins: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The places begins[i], begins[i] + 1, ... (widths[i] of them) for every i, one after another."""
    ends = _ends(widths)
    return np.arange(ends[-1]) + np.repeat(begins - ends[:-1], widths)


def states(words: pa.Array, voc: Vocabulary, names: pa.Array | None = None, ids: np.ndarray | None = None, cuts: np.ndarray | None = None) -> pa.Array:
    """For each word its id, if it is a piece; the ids of the frequent word (``names``) that it is; its merges, if it is long; else the first state of its fold: byte ids between two ids
    that mark the ends, each with the rank of its pair with the next one."""
    # one lookup for all words: each builds a hash table of what it looks in
    find = lambda table: pc.fill_null(pc.index_in(words, value_set=table), -1).to_numpy(zero_copy_only=False)
    piece = find(voc.names)
    known = find(names) if names is not None and len(names) else np.full(len(words), -1, np.int32)
    made = [_states(words.slice(k, STATES), voc, piece[k : k + STATES].astype(np.int64), known[k : k + STATES].astype(np.int64), ids, cuts) for k in range(0, max(1, len(words)), STATES)]
    return made[0] if len(made) == 1 else pa.concat_arrays(made)


def _states(words: pa.Array, voc: Vocabulary, piece: np.ndarray, known: np.ndarray, ids: np.ndarray | None, cuts: np.ndarray | None) -> pa.Array:
    """``states`` of words whose places among the pieces and the frequent words (-1: none) are found."""
    end, no = len(voc.pieces), np.int64(NONE << ID_BITS)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    is_piece = piece >= 0
    is_known = ~is_piece & (known >= 0)
    is_long = ~is_piece & ~is_known & (size > LONG_WORD)
    to_fold = ~(is_piece | is_known | is_long)
    merges = {int(k): voc.merge(data[offsets[k] : offsets[k + 1]].tobytes()) for k in np.flatnonzero(is_long)}
    width = np.where(to_fold, size + 2, 1)
    if is_known.any():
        width[is_known] = np.diff(cuts)[known[is_known]]
    for k, found in merges.items():
        width[k] = len(found)
    at = _ends(width)
    out = np.empty(at[-1], np.int64)
    out[at[:-1][is_piece]] = voc.name_ranks[piece[is_piece]]
    if is_known.any():
        out[_taken(at[:-1][is_known], width[is_known])] = ids[_taken(cuts[known[is_known]], width[is_known])]
    for k, found in merges.items():
        out[at[k] : at[k + 1]] = found
    if to_fold.any():
        own = size[to_fold]
        row = np.full(int(own.sum()) + 2 * len(own) + 1, end, np.int64)
        row[_taken(_ends(own + 2)[:-1] + 1, own)] = voc.bytes[data[_taken(offsets[:-1][to_fold], own)]]
        a, slot = row[:-1], voc.table[voc.shift[row[:-1]] + row[1:]]
        out[_taken(at[:-1][to_fold], own + 2)] = np.where((slot & MASK) == a, slot, no + a)
    return _lists(out, at)


def frequent_words(docs: DataFrame, known: Broadcast, pattern: str, text_col: str, most: int = FREQUENT) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, ids, where each word's ids begin) of the words that come at least 2**k times in all texts, by the least k >= 1 that leaves at most ``most``; pieces are left out.

    What stands between single spaces is counted, and what comes more than once is cut into words, as if a space stood before it. A word that only stands otherwise is not found; it is folded where it is.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced = pc.match_substring_regex(known.value.names, "^ ")
        pieces = pc.utf8_slice_codeunits(known.value.names.filter(spaced), 1)
        for part in parts:
            for at in range(0, len(part), COUNTED):
                found = pc.value_counts(pc.list_flatten(pc.split_pattern(part.column(0).slice(at, COUNTED).fill_null(""), " ")))
                said, n = found.field(0), found.field(1)
                wanted = pc.and_(pc.invert(pc.is_in(said, value_set=pieces)), pc.less_equal(pc.binary_length(said), LONG_WORD))
                yield pa.RecordBatch.from_arrays([said.filter(wanted), n.filter(wanted)], ["said", "n"])
                del found, said, n, wanted
                pa.default_memory_pool().release_unused()

    def matches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        voc, find = known.value, regex.compile(pattern).findall
        for part in parts:
            words, counts = [], []
            for said, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = [w for w in find(f" {said}") if w.encode() not in voc.ranks]
                words += own
                counts += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    said = docs.select(text_col).mapInArrow(count, "said string, n long").groupBy("said").agg(F.sum("n").alias("n")).where("n > 1")
    counts = said.mapInArrow(matches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stash(counts, "counts")
    powers = {r["k"]: r["w"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("w")).collect()}  # 63 rows at most
    k = next(k for k in range(1, 65) if sum(w for p, w in powers.items() if p >= k) <= most)
    end = len(known.value.pieces)

    def block(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = known.value
        for part in parts:
            for at in range(0, len(part), FREQUENT_BLOCK):
                words = part.column(0).slice(at, FREQUENT_BLOCK)
                one = pa.array([0, len(words)], pa.int32())
                columns = [pa.ListArray.from_arrays(one, words), pa.ListArray.from_arrays(one, states(words, voc)), _lists(voc.table, [0, SLOTS]), _lists(voc.shift, [0, len(voc.shift)])]
                yield pa.RecordBatch.from_arrays(columns, ["names", "words", "ranks", "shift"])

    rows = counts.where(f"n >= {2**k}").select("word").mapInArrow(block, "names array<string>, words array<array<bigint>>, ranks array<bigint>, shift array<int>")
    found = rows.select(F.explode(F.arrays_zip("names", folded(end).alias("ids"))).alias("x")).select(F.col("x.names").alias("word"), F.col("x.ids").alias("ids")).toArrow()  # ``most`` rows
    ids = found["ids"].combine_chunks()
    cuts = np.asarray(ids.offsets.to_numpy(), np.int64) if len(ids) else np.zeros(1, np.int64)
    return found["word"].combine_chunks(), np.asarray(ids.values.to_numpy(zero_copy_only=False), np.int32), cuts


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """Every row: id, ids (binary, little-endian unsigned 32-bit), n_tokens; with ``check`` also decoded, the ids decoded in the task that made them.

    Each match of ``pattern`` is encoded by itself, as a whole if it is a piece; no special tokens. The pattern's matches have white space only at their start or are nothing else, and look no further
    than to the end of a run of it. Frequent words are folded once (``frequent_words``), the others in each block. Null texts are empty and empty texts have no ids;
    rows that repeat come back as often; other columns are ignored.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)
    common = spark.sparkContext.broadcast(frequent_words(docs, known, pattern, text_col))
    kind, end = docs.schema[id_col].dataType.simpleString(), len(vocabulary.pieces)

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        voc, find = known.value, regex.compile(pattern).findall
        names, flat, begins = common.value
        for batch in parts:
            ids, texts = batch.column(0), batch.column(1)
            chars, at = _ends(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)), 0
            while at < len(texts):
                begin, at = at, max(at + 1, min(len(texts), int(np.searchsorted(chars, chars[at] + BLOCK_CHARS))))
                own, edges = stretches(texts.slice(begin, at - begin))
                coded = own.dictionary_encode()
                index: dict[str, int] = {}
                codes, cuts = numbers("i"), [0]
                for k in range(0, len(coded.dictionary), STRETCHES):
                    for stretch in coded.dictionary.slice(k, STRETCHES).to_pylist():
                        codes.extend([index.setdefault(x, len(index)) for x in find(stretch)])
                        cuts.append(len(codes))
                of, cuts = coded.indices.to_numpy(zero_copy_only=False), np.array(cuts, np.int64)
                width = np.diff(cuts)[of]
                edges = _ends(width)[edges]
                codes = (np.frombuffer(codes, np.int32) if codes else np.zeros(0, np.int32))[_taken(cuts[:-1][of], width)]
                words = pa.array(list(index), pa.string())
                del coded, of, width, index, own
                words = states(words, voc, names, flat, begins)
                one = pa.array([0, at - begin], pa.int32())
                columns = [pa.ListArray.from_arrays(one, ids.slice(begin, at - begin)), pa.ListArray.from_arrays(one, _lists(codes, edges)), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), _lists(voc.table, [0, SLOTS]), _lists(voc.shift, [0, len(voc.shift)])]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "codes", "words", "ranks", "shift"])
                del columns, words, codes
                pa.default_memory_pool().release_unused()

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(known.value.pieces, pa.large_binary())
        for batch in parts:
            for row in range(batch.num_rows):
                ids, codes, words = (batch.column(k)[row].values for k in range(3))
                flat, cuts = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
                sequence, edges, widths = codes.values.to_numpy(zero_copy_only=False), codes.offsets.to_numpy(), np.diff(cuts)
                for k in range(0, len(ids), 256):
                    own = edges[k : k + 257]
                    at = sequence[own[0] : own[-1]]  # a list's children and offsets are those of the whole batch
                    width = widths[at]
                    ends = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
                    tokens = flat[np.arange(ends[-1]) + np.repeat(cuts[:-1][at] - ends[:-1], width)].astype("<u4")
                    ends = ends[own - own[0]]
                    texts = [tokens[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])]
                    columns = [ids.slice(k, len(texts)), pa.array(texts, pa.binary()), pa.array([len(t) // 4 for t in texts], pa.int64())]
                    if check:
                        columns.append(joined(tokens, ends, pieces))
                    yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "n_tokens", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(blocks, f"ids array<{kind}>, codes array<array<int>>, words array<array<bigint>>, ranks array<bigint>, shift array<int>")
    rows = rows.select("ids", "codes", folded(end).alias("words"))
    return rows.mapInArrow(gather, f"id {kind}, ids binary, n_tokens long" + ", decoded binary" * check).withColumnRenamed("id", id_col)


def joined(ids: np.ndarray, ends: np.ndarray, pieces: pa.Array) -> pa.Array:
    """The binary pieces of the ids between ``ends``, one after another: Arrow gathers them into one buffer, which is cut at the texts' ends."""
    taken = pieces.take(pa.array(ids.astype(np.int64)))
    at = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1][ends] if len(taken) else np.zeros(len(ends), np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at), taken.buffers()[2] or pa.py_buffer(b"")]).cast(pa.binary())


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the pieces of the ids, one after another. Null ids decode to null."""
    known = encoded.sparkSession.sparkContext.broadcast(vocabulary.pieces)

    @F.pandas_udf("binary")
    def pieces(column: pd.Series) -> pd.Series:
        table = pa.array(known.value, pa.large_binary())
        raw = [b"" if x is None else x for x in column]
        ids = np.frombuffer(b"".join(raw), "<u4")
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)])
        return pd.Series([None if x is None else y for x, y in zip(column, joined(ids, ends, table).to_pylist())], dtype=object)

    return encoded.withColumn("decoded", pieces(ids_col))


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[Vocabulary, str]:
    """Ranks and pattern of a public tokenizer, read where it is installed."""
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    vocabulary, pattern = tokenizer()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, vocabulary, pattern, check=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
