"""The field against all label paths, alignments against the full table of all pairs, and the pipeline's stages against plain Python."""

import hashlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

import corpus_pipeline
from mediaspan.llm import byte_bpe, decontaminate, toxicity

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
RNG = np.random.default_rng(11)
SYLLABLES = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrt"]


def prose(n):
    return " ".join(RNG.choice(SYLLABLES, n))


def smith_waterman(a, b):
    """Points of the best local alignment, cell by cell."""
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for k, y in enumerate(b):
            row.append(max(0, above[k] + (2 if x == y else -1), above[k + 1] - 1, row[k] - 1))
        best, above = max(best, *row), row
    return best


def leaks(texts, items):
    """Pairs that share three words in a row and align with half of the item's points."""
    grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    words = {i: (t or "").split() for i, t in texts.items()}
    out = {}
    for j, item in items.items():
        b = (item or "").split()
        for i, a in words.items():
            if grams(a) & grams(b) and (points := smith_waterman(b, a)) >= len(b):
                out[i, j] = points / (2 * len(b))
    return out


def edited(text, share):
    w = text.split()
    for k in np.flatnonzero(RNG.random(len(w)) < share):
        w[k] = RNG.choice(["", "x", "x y", w[k] + "s"])
    return " ".join(w)


def test_marginals_of_all_paths():
    field = toxicity.Field(np.arange(6, dtype=np.uint64))
    field.weights, field.bias, field.moves = RNG.normal(size=6), -0.4, RNG.normal(size=(2, 2))
    sizes = [1, 6, 3, 2, 5]
    known = RNG.integers(-1, 6, sum(sizes))
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    p, pairs, logs = field.marginals(known, begin)
    want, moves, norms = np.zeros(len(known)), np.zeros((2, 2)), []
    for at, n in zip(begin, sizes):
        gain = [field.bias + (field.weights[k] if k >= 0 else 0) for k in known[at : at + n]]
        paths = {y: np.exp(sum(g for g, s in zip(gain, y) if s) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=n)}
        norms.append(np.log(sum(paths.values())))
        for y, v in paths.items():
            share = v / sum(paths.values())
            want[at : at + n] += share * np.array(y)
            for a, b in zip(y, y[1:]):
                moves[a, b] += share
    assert np.allclose(p, want) and np.allclose(pairs, moves) and np.allclose(logs, norms)


def test_word_counts(spark):
    rows = [(k, prose(int(n)) + (". Bad, bad! " if k % 3 == 0 else "\n"), k % 3 == 0) for k, n in enumerate(RNG.integers(0, 60, 90))]
    rows += [rows[4], (900, "", True), (901, prose(200_000), False)]
    found = toxicity.word_counts(spark.createDataFrame([(i, t, int(b)) for i, t, b in rows], "doc_id long, text string, toxic int").repartition(5)).collect()
    bad, every = Counter(), Counter()
    for _, t, b in rows:
        own = set(t.lower().replace(".", " ").replace(",", " ").replace("!", " ").split())
        every.update(own)
        bad.update(own if b else ())
    total = [(r["bad"], r["all"]) for r in found if r["word"] is None]
    assert total == [(sum(b for *_, b in rows), len(rows))]
    assert Counter((r["bad"], r["all"]) for r in found if r["word"] is not None) == Counter((bad[w], n) for w, n in every.items())


def test_toxicity_of_repeated_and_long_rows(spark):
    rows = [(i, prose(30) + (" fool idiot" if i % 4 == 0 else ""), "clash") for i in range(200)]
    rows += [rows[0], rows[0], (500, prose(300_000), "clash"), (501, prose(300_000) + " fool idiot", "clash"), (502, None, None), (None, "fool idiot", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, 1), (3, None), (None, 1), (77_777, 1)], "doc_id long, toxic int")
    found = toxicity.tag_toxic(docs, toxicity.fit_field(docs, labels)).collect()
    assert len(found) == len(rows)
    flagged = Counter(r.doc_id for r in found if r.score >= toxicity.THRESHOLD)
    assert flagged == Counter([*range(0, 200, 4), 0, 0, 501, None])


@pytest.mark.parametrize("share", [0.0, 0.1, 0.3, 0.5])
def test_decontamination_of_all_pairs(spark, share):
    items = dict(enumerate([prose(int(n)) for n in RNG.integers(3, 30, 8)]))
    texts = dict(enumerate([prose(int(RNG.integers(0, 40))) + " " + edited(items[k % 8], share) + " " + prose(int(RNG.integers(0, 40))) for k in range(40)] + [None, "", items[0], items[0]]))
    docs = spark.createDataFrame([*texts.items(), (43, texts[43])], "doc_id long, text string").repartition(3)
    found = decontaminate.contaminated(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == leaks(texts, items)
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})


def without_lines(texts):
    seen, out = [], {}
    for i, t in sorted(texts.items()):
        keep = []
        for line in [] if t is None else t.split("\n"):
            s = frozenset(line.encode().translate(LOW).split())
            if not (s and any(10 * len(s & o) >= 8 * len(s | o) for o in seen)):
                keep.append(line)
            if s:
                seen.append(s)
        out[i] = None if t is None else "\n".join(keep)
    return out


def without_copies(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(LOW).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in texts.items() if find(i) == i}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """doc_id -> text of a table with toxic documents, shared lines, near copies, leaks, null and empty texts; labels and items beside it."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = {k: prose(20) for k in range(4)}
    clean = [prose(30) + "\n" + prose(25) for _ in range(120)]
    toxic = [prose(20) + ". idiot fool " + prose(8) for _ in range(60)]
    shared = prose(12)
    near = [edited(clean[0].replace("\n", " "), 0.02) for _ in range(10)]
    texts = dict(enumerate([*clean, *toxic, *[prose(20) + "\n" + shared for _ in range(10)], *near, *[prose(15) + " " + edited(items[k], 0.1) + "\n" + prose(9) for k in range(4)], None, "", "two words", clean[5], clean[6] + "\n" + clean[7]]))
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "more") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, extra string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(120 <= i < 180)) for i in range(180)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, items


def test_stages(spark, corpus):
    folder, texts, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def stage(name, docs, want):
        out = corpus_pipeline.stash(dict(corpus_pipeline.STAGES)[name](spark, docs, folder), name)
        rows = out.collect()
        assert out.columns == list(corpus_pipeline.COLUMNS) and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
        assert all(r.n_chars == len(r.text or "") for r in rows)
        return out, want

    docs, left = stage("toxicity", docs, {i: t for i, t in texts.items() if not 120 <= i < 180})
    docs, left = stage("line_dedup", docs, without_lines(left))
    docs, left = stage("ngram_jaccard", docs, without_copies(left))
    found = {i for i, _ in leaks(left, items)}
    assert len(found) == 4
    docs, left = stage("decontamination", docs, {i: t for i, t in left.items() if i not in found})
    check_tokens(corpus_pipeline.byte_bpe(spark, docs, folder), left)
    check_tokens(corpus_pipeline.run(spark, folder), left)


def check_tokens(frame, texts):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = {r.doc_id: r for r in frame.collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        ids = plain.encode_ordinary(t or "")
        assert rows[i].round_trip and rows[i].n_tokens == len(ids) and bytes(rows[i].ids) == np.array(ids, "<u4").tobytes()


def test_bpe_of_repeated_long_and_no_rows(spark):
    vocabulary, pattern = byte_bpe.tokenizer()
    long = prose(150_000) + " " + "ab" * 5_000
    rows = [(1, "one two"), (1, "one two"), (2, long), (None, "x"), (3, None), (4, "")]
    out = byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, pattern, check=True).collect()
    assert Counter((r.doc_id, hashlib.sha256(bytes(r.decoded)).hexdigest()) for r in out) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary, pattern).count() == 0


def test_bpe_cuts_at_white_space_of_every_kind(spark):
    """Texts are matched in stretches of white space and what follows; the ids are those of whole texts."""
    import random

    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rng = random.Random(8)
    signs = [" ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "a", "Qzx", "é", "12", "٣", "!", "'s", "'", "_", "​", "\x00", "𝒳", "中"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [" ", "\n \n", "x \n", "x" * 300 + " y", None]
    vocabulary, pattern = byte_bpe.tokenizer()
    out = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary, pattern, check=True).collect()
    assert len(out) == len(texts)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(texts[r.doc_id] or ""), texts[r.doc_id]
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_bpe_states_are_made_for_many_words_at_once():
    import pyarrow as pa

    vocabulary, _ = byte_bpe.tokenizer()
    end, none = len(vocabulary.pieces), byte_bpe.NONE << byte_bpe.ID_BITS
    words = ["a", " qzxw", "ü" * 200, " known", ""]
    got = byte_bpe.states(pa.array(words), vocabulary, pa.array(["other", " qzxw"]), np.array([1, 2, 3], np.int32), np.array([0, 1, 3])).to_pylist()
    assert got[:3] == [[vocabulary.ranks[b"a"]], [2, 3], vocabulary.merge(words[2].encode())]
    state = byte_bpe.states(pa.array([" qzxw"]), vocabulary).to_pylist()[0]
    ids = [end, *(int(vocabulary.bytes[b]) for b in b" qzxw"), end]
    pair = lambda a, b: vocabulary.ranks.get(vocabulary.pieces[a] + vocabulary.pieces[b]) if max(a, b) < end else None
    assert state == [(r << byte_bpe.ID_BITS) + a if (r := pair(a, b)) is not None else none + a for a, b in zip(ids, ids[1:])] + [none + end]
    many = pa.array([f" w{k}q" for k in range(byte_bpe.STATES + 5)])
    assert byte_bpe.states(many, vocabulary).slice(byte_bpe.STATES).to_pylist() == byte_bpe.states(many.slice(byte_bpe.STATES), vocabulary).to_pylist()
