"""Spelling variants against a search over all words that differ by one letter."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mediaspan.llm import spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(counts):
    """word -> (form, root, n, n_near, form_n); words that share a form with one letter cut out are compared."""
    cut = defaultdict(set)
    for w in counts:
        cut[w].add(w)
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in cut.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items()}


def counted(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("shard", [1, 3, 128])
def test_pairs_whatever_the_shards(spark, shard):
    """Words of few letters, so that most are near; shards cut down to one place; very long words; counts in ties."""
    rng = random.Random(shard)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(260)}
    words |= {"x" * 3_000, "x" * 3_001, "x" * 1_500 + "y" + "x" * 1_499, "abcdefg", "abcdefgh", "zabcdefg"}
    counts = {w: rng.choice([2, 2, 5, 30, 300, 4_000, 50_000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling_variants.group_variants(df, shard=shard)) == brute(counts)


def test_hard_rows(spark):
    """Null and repeated ids, null and empty texts, letters outside the pattern, equal rows, clashing columns."""
    base = "abcdefgh ABCDEFGH abcdefghÿ Ābcdefghi abcdxfgh, short téléphone1téléphone"
    docs = [(1, base), (1, base), (None, base), (2, None), (3, ""), (None, None), (4, "abcdefgh " * 400), (5, "abcdefgx abcdefgx abcdefgz abcdefgz")]
    df = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, word string")
    words = spelling_variants.word_counts(df, change=spelling_variants.with_slips)
    want = brute(counted(docs))
    assert len(want) > 5
    assert rows(spelling_variants.group_variants(words)) == want
    assert rows(spelling_variants.group_variants(words.where(F.lit(False)))) == {}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(counted(docs))
    assert sum(1 for v in want.values() if v[0]) >= 5
    assert rows(spelling_variants.op12_spelling_variants(spark, sf)) == want
