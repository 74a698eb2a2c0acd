"""Periodic runs against a brute-force search of every period."""

import hashlib
import random
import zlib

import pytest

from mediaspan.llm import periodic_runs


def brute(w, exponent=4, length=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(length, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((b, e - b, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for b, n, q in runs for i in range(b + q, b + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def made(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("exponent,length", [(2, 2), (2, 6), (3, 1), (4, 6)])
def test_runs_of_random_words(exponent, length):
    rng = random.Random(exponent * 10 + length)
    for _ in range(1500):
        n, k = rng.randint(0, 40), rng.randint(1, 4)
        w = [f"w{rng.randrange(k)}" for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 6)
            w = w[:a] + [w[a + i % min(p, n - a)] for i in range(n - a)] + ["w0", "w1"]
        runs = periodic_runs.text_runs(w, exponent, length)
        assert runs == brute(w, exponent, length)
        assert periodic_runs.collapse(w, runs) == kept(w, runs)


def test_operator_on_hard_rows(spark):
    """Null and repeated ids, null and empty texts, repeated rows, one very long text, clashing columns."""
    long = " ".join(["a b c"] * 20_000 + [f"x{i}" for i in range(5_000)] + ["z"] * 5_000)
    rows = [(1, "a b a b a b a b", "q"), (1, "a b a b a b a b", "q"), (1, "a a a a a a", None), (None, "x x x x x x y", ""), (2, None, ""), (3, "", ""), (4, " \t\n", ""), (5, long, ""), (6, "A a A a A a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in periodic_runs.find_runs(docs).collect())
    want = sorted((i is None, i or 0, len(w), brute(w), b" ".join(kept(w, brute(w)))) for i, t, _ in rows if t is not long for w in [(t or "").encode().split()])
    assert [g for g in got if g[1] != 5] == want
    assert [(0, 60_000, 3), (65_000, 5_000, 1)] == next(g[3] for g in got if g[1] == 5)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    """Every document of the smallest table."""
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for i, text in docs:
        w, r = made(i, text), got[i]
        runs = brute(w)
        assert (r.n_runs, r.runs_sha256) == (len(runs), hashlib.sha256("".join(f"{b},{n},{q}\n" for b, n, q in runs).encode()).hexdigest())
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept(w, runs))).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        some += bool(runs)
    assert some > 5
