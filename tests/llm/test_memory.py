"""What the operators hold at once."""

import numpy as np
import pyarrow as pa

from mediaspan.llm import byte_bpe, line_dedup, toxicity


def test_bpe_words_of_a_block_are_looked_up_once(monkeypatch):
    """Each lookup builds a hash table of the pieces or of all frequent words, so a block makes one of each, however many words it has."""
    vocabulary, _ = byte_bpe.tokenizer()
    calls, find = [], byte_bpe.pc.index_in
    monkeypatch.setattr(byte_bpe, "STATES", 10)
    monkeypatch.setattr(byte_bpe.pc, "index_in", lambda *a, **b: calls.append(1) or find(*a, **b))
    words = pa.array([f" w{k}q" for k in range(35)])
    got = byte_bpe.states(words, vocabulary, pa.array([" w3q"]), np.array([1, 2], np.int32), np.array([0, 2]))
    assert len(calls) == 2 and len(got) == 35 and got[3].as_py() == [1, 2]
    assert byte_bpe.states(words.slice(0, 0), vocabulary).to_pylist() == []


def test_toxicity_fit_works_on_parts(monkeypatch):
    """The fit holds states of FIT_TOKENS tokens at once, and its weights are those of one part."""
    rng = np.random.default_rng(3)
    known = rng.integers(-1, 9, 4_000).astype(np.int32)
    begin = np.flatnonzero(rng.random(4_000) < 0.1)
    begin = np.unique(np.append(begin, 0))
    labels = (known == 4).astype(np.int8)
    sizes, found, marginals = [], [], toxicity.Field.marginals
    monkeypatch.setattr(toxicity.Field, "marginals", lambda self, own, starts: sizes.append(len(own)) or marginals(self, own, starts))
    for most in (10_000, 500):
        monkeypatch.setattr(toxicity, "FIT_TOKENS", most)
        field = toxicity.Field(np.arange(9, dtype=np.uint64))
        field.fit(known, begin, labels)
        found.append(np.concatenate([field.weights, [field.bias], field.moves.ravel()]))
    assert sizes[0] == 4_000 and max(sizes[30:]) <= 500
    assert np.allclose(*found, rtol=1e-9, atol=1e-9)


def test_line_dedup_verifies_a_line_with_its_earliest_candidate_first(spark, monkeypatch):
    """Copies with one word changed all match the first line, so whole token sets travel with one pair of each and not with all pairs."""
    words = [f"word{k}" for k in range(30)]
    lines = [" ".join([*words[:k], f"other{k}", *words[k + 1 :]]) for k in range(20)]
    lines += [" ".join([*words[:9], *[f"new{k}" for k in range(21)]]), "short line", "Short  line"]
    rows, write = {}, line_dedup.stash

    def stash(df, name="part"):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "stash", stash)
    found = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert found == {k: int(0 < k < 20 or k == 22) for k in range(23)}
    assert rows["pairs"] == 20 * 19 // 2 + 1 and rows["heads"] == 20 and rows["rest"] == 0


def test_line_dedup_makes_tokens_again_without_the_table_of_classes_or_an_exchange_of_lines(spark, monkeypatch):
    """Verifying needs no order: the plan that makes the tokens of candidates again holds no literal of all classes, and lines are not dealt anew where each id has one row."""
    lines = [" ".join(f"word{(k * j) % 90}" for j in range(1, 31)) for k in range(12)]
    lines += [x.replace("word30", "other") for x in lines]
    plans, write = [], line_dedup.stash

    def stash(df, name="part"):
        if name == "tokens":
            plans.append(df._jdf.queryExecution().toString())
        return write(df, name)

    monkeypatch.setattr(line_dedup, "stash", stash)
    assert sum(r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()) >= 12
    assert len(plans) == 1 and len(plans[0]) < 100_000
    assert "first(said" not in plans[0]


def test_bpe_cuts_texts_as_their_white_space_says():
    """Stretches are slices of Arrow's buffer; no Python string is made for each word of a text."""
    import regex

    rng = np.random.default_rng(5)
    some = ["a", "\u00e9", "\u00e0", "\u0420", " ", "\u0085", "\u00a0", "\u2003", "\u2028", "\u3000", "\u1680", "\u205f", "\U0001f600", " ", " ", "\t", "\n", "\x1c", "\u4e00", "ab"]
    texts = ["", None, " ", "\u00a0", "\u00a0 x", "a\u00a0  b", "\u3000 \u00a0", "x", " y"] + ["".join(some[k] for k in rng.integers(0, len(some), int(n))) for n in rng.integers(0, 30, 500)] + [""]
    whole = pa.array(texts, pa.string())
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    for begin, n in ((0, len(texts)), (3, 200), (5, 1), (1, 1), (7, 0)):
        found, edges = byte_bpe.stretches(whole.slice(begin, n))
        found.validate(full=True)
        assert len(edges) == n + 1 and edges[-1] == len(found)
        for k, text in enumerate(texts[begin : begin + n]):
            own = found[edges[k] : edges[k + 1]].to_pylist()
            assert "".join(own) == (text or "")
            assert [w for x in own for w in pattern.findall(x)] == pattern.findall(text or "")
    assert len(byte_bpe.stretches(pa.array(["one two  three\nfour"]))[0]) == 4
