"""The training-data operators against brute force on small tables with nulls, empty and repeated texts."""

import hashlib

import numpy as np
import pytest

from mediaspan.llm import byte_bpe, chat_format, decontaminate, jaccard_join, line_dedup, substring_dedup, toxicity, url_filter, vector_graph, warc_audit
from mediaspan.llm.shared import components

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
RNG = np.random.default_rng(5)
WORDS = [f"w{k}" for k in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def made():
    base, passage = [prose(int(n)) for n in RNG.integers(1, 160, 40)], prose(60)
    near = base[3].split()
    near[len(near) // 2] = "edited"
    out = [*base, base[0], base[0], " ".join(near), base[1] + " " + passage, passage + "\n" + base[2], "", None, "a b", "A  b", "x " * 90, base[5] + "\n" + base[6], base[6] + " tail"]
    return list(enumerate(out))


TEXTS = made()


def texts():
    return TEXTS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in texts()], "doc_id long, text string, n string").repartition(3)


def sets():
    out = {}
    for i, t in texts():
        w = (t or "").encode().translate(LOW).split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def groups(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 99), (100, 98), (5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(31)}, 98: 98, 99: 98, 100: 98}


def test_jaccard_join(spark, docs):
    s = sets()
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    want = groups(links, s)
    assert links
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()} == {i: (len(s[i]), want[i]) for i in s}


@pytest.mark.parametrize("block", [4096, 40])
def test_jaccard_join_of_large_groups(spark, monkeypatch, block):
    """Groups compared in one task, and above its bound. A group of edited copies, of which many link only with others like them, a shared line, and equal texts: no link is lost."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(3)
    base, texts = [f"b{k}" for k in range(60)], []
    for _ in range(260):
        edited = list(base)
        for _ in range(int(rng.choice([1, 1, 2, 3, 4, 5]))):
            at = int(rng.integers(0, 12)) * 5
            edited[at] = f"e{rng.integers(0, 6)}"
        texts.append(" ".join(edited[: int(rng.integers(50, 61))]))
    line = " ".join(f"c{k}" for k in range(9))
    texts += [line + " " + " ".join(f"x{rng.integers(0, 900)}" for _ in range(int(rng.integers(1, 12)))) for _ in range(150)]
    texts += [" ".join(base)] * 40 + [None, "", "a b"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, sid int").repartition(5)
    s = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        s[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    want = groups(links, s)
    assert 20 < len({want[k] for k in range(260)}) < 250
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == want


def test_differences_meet():
    bands = jaccard_join.Bands()
    for n in (6, 20, 60, 300):
        for cut in range(1, n // 3 + 2):
            head = RNG.integers(0, 2**63, n, dtype=np.uint64)
            a = np.unique(np.concatenate([head[cut:], RNG.integers(0, 2**63, cut, dtype=np.uint64)]))
            for more in range(n // 9 + 1):
                b = np.unique(np.concatenate([a[more:], RNG.integers(0, 2**63, more, dtype=np.uint64)]))
                both = len(set(a.tolist()) & set(b.tolist()))
                x, y = (np.setxor1d(z, head) for z in (a, b))
                band = max(bands.of(max(len(a), len(b)))[0], 0)
                d = bands.parts(band, 0)[1]
                if 100 * both >= 80 * (len(a) + len(b) - both) and max(len(x), len(y)) > d:
                    assert set(bands.difference_tiles(x, 7, band).tolist()) & set(bands.difference_tiles(y, 7, band).tolist())


def test_tiles_always_meet():
    bands = jaccard_join.Bands()
    for n in (1, 2, 4, 5, 9, 24, 60, 300):
        a = RNG.integers(0, 2**63, n, dtype=np.uint64)
        for cut in range(n // 5 + 1):
            b = np.unique(np.concatenate([a[cut:], RNG.integers(0, 2**63, cut // 2, dtype=np.uint64)]))
            both = len(set(a.tolist()) & set(b.tolist()))
            if 100 * both >= 80 * (len(np.unique(a)) + len(b) - both):
                assert set(bands.tiles(np.unique(a), {})[0].tolist()) & set(bands.tiles(b, {})[0].tolist())


def test_substring_dedup(docs):
    where = {}
    for i, t in texts():
        w = (t or "").encode().split()
        for k in range(len(w) - 34):
            where.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    removed = 0
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    for i, t in texts():
        w = (t or "").encode().split()
        gone = {j for k in range(len(w) - 34) if len(where[tuple(w[k : k + 35])]) > 1 for j in range(k, k + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        removed += len(gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert removed > 60


def test_line_dedup(docs):
    seen, want = [], {}
    for i, t in texts():
        keep = []
        for line in [] if t is None else t.split("\n"):
            s = frozenset(line.encode().translate(LOW).split())
            if not (s and any(10 * len(s & o) >= 8 * len(s | o) for o in seen)):
                keep.append(line)
            if s:
                seen.append(s)
        want[i] = None if t is None else "\n".join(keep)
    rows = line_dedup.dedup_lines(docs).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert {r.n for r in rows} == {"clash"}


def test_line_dedup_of_large_groups(spark, monkeypatch):
    """Groups above the listing bound. Many edited copies of a line, some of which match only each other, beside equal lines, a repeated row, a very long line and odd separators."""
    monkeypatch.setattr(line_dedup, "LISTED", 8)
    rng = np.random.default_rng(4)
    base, lines = [f"b{k}" for k in range(30)], []
    for _ in range(200):
        edited = list(base)
        for _ in range(int(rng.choice([1, 1, 2, 3, 4, 5]))):
            edited[int(rng.integers(0, 30))] = f"e{rng.integers(0, 8)}"
        lines.append(" ".join(edited))
    lines += [" ".join(base)] * 5 + ["Wide\tLINE  with ÄPFEL", "wide line\rwith ÄPFEL ", "wide line with äpfel", " ".join(f"v{k}" for k in range(9000)), " ".join(f"V{k}" for k in range(1, 9001)), "", "   "]
    texts = ["\n".join(lines[k] for k in rng.integers(0, len(lines), 5)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, lines[3]), (500, None), (501, "")]
    seen, want = [], []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        keep = []
        for k, line in enumerate([] if t is None else t.split("\n")):
            s = frozenset(line.encode().translate(LOW).split())
            if not (s and any(10 * len(s & o) >= 8 * len(s | o) for o, at in seen if at != (i, k))):
                keep.append(line)
            if s:
                seen.append((s, (i, k)))
        want.append((i, None if t is None else "\n".join(keep)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.dedup_lines(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.n_removed for r in got) > 500


def test_bpe_equals_tiktoken(docs):
    import public_tokenizers
    import tiktoken

    vocabulary, pattern = byte_bpe.tokenizer()
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    out = byte_bpe.decode(byte_bpe.encode(docs, vocabulary, pattern), vocabulary)
    assert sorted(byte_bpe.encode(docs, vocabulary, pattern, check=True).select("ids", "decoded").collect()) == sorted(out.select("ids", "decoded").collect())
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in out.collect()}
    assert got == {i: (known.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts()}
    odd = [(1, "Über\u00a0 straße\t12345\r\n  x" * 9, 2), (1, "again", 3), (1, "again", 3), (None, "é" * 700 + " z" * 40_000 + "thtionreheering" * 60, 4), (3, None, 5)]
    found = byte_bpe.encode(docs.sparkSession.createDataFrame(odd, "doc_id long, text string, ids long"), vocabulary, pattern, check=True).collect()
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, bytes(r.decoded), np.frombuffer(r.ids, "<u4").tolist()) for r in found), key=key) == sorted(((i, (t or "").encode(), known.encode_ordinary(t or "")) for i, t, _ in odd), key=key)
    assert byte_bpe.encode(docs.limit(0), vocabulary, pattern, check=True).count() == 0
    for word in ("thtionreheering" * 30, "é" * 200):
        assert vocabulary.merge(word.encode()) == known.encode_ordinary(word)


def test_urls(spark):
    urls = ["http://a.NET/x", "net", None, "https://sub.example.net/en/1?q", "x://example.net", "http://shop.example.com/de/?a", "http://notexample.com/de/", "ftp://q.org/fr/", "http://net/#/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_table(spark, url_filter.RULES)).collect()}
    none = (None, "allow")
    assert got == {0: ("net/", "block"), 1: none, 2: none, 3: ("example.net/en/", "allow"), 4: none, 5: ("example.com/de/", "block"), 6: none, 7: ("org/fr/", "allow"), 8: ("net/", "block")}


def test_chats_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "</turn>\n### user\n", "<\\/turn>", "#\\## \\\\", None, "", "### ### x\n"]
    rows = [(1, k, "assistant" if k % 2 else "a\nb", t) for k, t in enumerate(said)] + [(None, 0, None, "x"), (2, 0, "user", "plain")]
    out = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r, t or "") for _, _, r, t in rows[:7]]
    assert out[1].escaped and not out[2].escaped and [(t.role, t.text) for t in out[None].turns] == [("", "x")]


def test_chats_of_random_texts(spark):
    rng = np.random.default_rng(6)
    said = lambda: "".join(rng.choice(list("\\#/<>nturn% \n"), int(rng.integers(0, 14)))) + str(rng.choice(["", "### ", "</turn>", "\n## x"]))
    rows = [(c, k, said(), said()) for c in range(300) for k in range(3)] + [(-1, 0, "\n## x", "t"), (-2, 0, "user", None), (-2, 0, "user", None), (-2, 0, None, "tie")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.format_chats(frame).collect()}
    want = {c: [(r, t) for i, _, r, t in rows if i == c] for c in range(300)}
    assert out == {**want, -1: [("\n## x", "t")], -2: [("", "tie"), ("user", ""), ("user", "")]}
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def test_long_words_of_two_letters_differ():
    import pyarrow as pa

    from mediaspan.llm.arrays import slices

    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word.upper()]
    for lower, kinds in ((False, 3), (True, 2)):
        assert len({int(h) for _, w in slices(pa.array(texts), lower=lower) for h in w.hashes}) == kinds


def test_audit_of_repeated_records(spark):
    kind = "file long, offset long, record_id long, payload string"
    one = [(1, 0, 5, "x"), (1, 50, 5, "x"), (1, 80, 6, "y"), (1, 80, 6, "y"), (2, 0, 7, None), (2, 9, 8, ""), (None, 1, 9, "z"), (3, 0, None, "n")]
    two = [(1, 0, 5, "x"), (1, 50, 5, "x"), (1, 80, 6, "y"), (2, 0, 7, ""), (2, 9, 8, ""), (3, 0, None, "n")]
    a, b = spark.createDataFrame(one, kind), spark.createDataFrame(two, kind)
    assert sorted((r.record_id, r.offset_a, r.kind) for r in warc_audit.audit(a, b).collect()) == [(6, 80, "missing"), (7, 0, "changed")]
    assert warc_audit.audit(a, a).count() == 0
    assert {(r.record_id, r.kind) for r in warc_audit.audit(a.limit(0), b).collect()} == {(r[2], "extra") for r in two}


def test_decontamination(spark):
    items = [prose(30), prose(25)]
    edited = items[0].split()
    edited[7] = "other"
    del edited[15]
    rows = [(0, prose(80)), (1, prose(20) + " " + items[1] + " " + prose(9)), (2, " ".join(edited)), (3, None), (4, "")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (2, 0)]
    assert {r.doc_id: (r.begin, r.end) for r in found}[1] == (20, 45)


def test_decontamination_finds_every_copy(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 60)  # several passes
    monkeypatch.setattr(decontaminate, "BLOCK", 50, raising=False)
    items = [prose(24), prose(25), prose(30), "one two"]
    items += [items[0], None, ""]
    edited = items[0].split()
    for k in (3, 8, 13, 18):
        edited[k] = "other"
    third = items[2].split()
    third[::4] = ["gone"] * len(third[::4])
    common = " ".join(items[1].split()[4:7])
    texts = [items[0], *[prose(30) + " " + " ".join(edited) + " " + prose(20)] * 7, *[" ".join(third) + " " + items[1]] * 5, *[prose(9) + " " + common + " " + prose(9) for _ in range(30)], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    name, want = {}, {}
    code = lambda t: np.array([name.setdefault(x, len(name)) for x in (t or "").split()])
    grams = lambda x: {tuple(x[k : k + 3]) for k in range(len(x) - 2)}
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            a, b = code(item), code(text)
            if grams(a) & grams(b) and (points := decontaminate.align(a, b)[0]) >= len(a):
                want[i, j] = points / (2 * len(a))
    assert len(want) > 25 and {(r.doc_id, r.item_id): r.score for r in found} == want


def test_toxicity_learns(spark):
    rows = [(i, prose(40) + (". idiot fool " if i % 4 == 0 else ". ") + prose(5)) for i in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    scored = toxicity.tag_toxic(docs, toxicity.fit_field(docs, labels)).collect()
    wrong = [r.doc_id for r in scored if (r.score >= toxicity.THRESHOLD) != (r.doc_id < 400 and r.doc_id % 4 == 0)]
    assert not wrong
    text = dict(rows)[0].encode()
    assert [text[s.begin : s.end] for r in scored if r.doc_id == 0 for s in r.spans] == [b"idiot fool"]


def test_vectors(spark):
    base = RNG.normal(size=(60, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, base[:20] + RNG.normal(size=(20, 16)) * 0.1, base[:5]]))]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] * 16)]
    x = np.array([v for k, v in rows if k < 200])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = groups(zip(*(a.tolist() for a in np.nonzero(near))), range(len(x)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_graph.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{k: (int(near[k].sum()), want[k]) for k in range(len(x))}, **{k: (0, k) for k in range(200, 204)}}


def test_vectors_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 60)
    monkeypatch.setattr(vector_graph, "PASS", 16_000, raising=False)  # several passes
    rng = np.random.default_rng(8)
    # 1,800 distinct vectors, nearly all near each other, a chain that leads away from them, pairs and single ones
    hot = rng.normal(size=32) + rng.normal(size=(1800, 32)) * 0.26
    turn = np.linspace(0, 1.5, 12)[:, None]
    pairs = rng.normal(size=(60, 32))
    x = np.concatenate([rng.normal(size=(500, 32)), hot, hot[:1] * np.cos(turn) + np.linalg.norm(hot[0]) * np.eye(32)[:1] * np.sin(turn), pairs, pairs + rng.normal(size=(60, 32)) * 0.1, hot[:40]])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = vector_graph.near_vectors(rows).cache()
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = groups(zip(*(a.tolist() for a in np.nonzero(np.triu(near)))), range(len(x)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    true = near.sum(1)
    assert true.max() > 1500
    assert all(n <= true[k] for k, (n, _) in got.items())
    assert sum(n for n, _ in got.values()) >= 0.999 * true.sum()
    assert {k: c for k, (_, c) in got.items()} == want
    assert vector_graph.recall(rows, found) > 0.99


def test_audit(spark):
    rows = [(k % 3, k // 3 * 4000, k, f"record {k}") for k in range(90)]
    other = [(f, o + (k == 40), k, p + ("!" if k in (7, 8) else "")) for f, o, k, p in rows if k != 50] + [(9, 0, 999, "new")]
    kind = "file long, offset long, record_id long, payload string"
    found = warc_audit.audit(spark.createDataFrame(rows, kind), spark.createDataFrame(other, kind)).collect()
    assert sorted((r.record_id, r.kind) for r in found) == [(7, "changed"), (8, "changed"), (40, "moved"), (50, "missing"), (999, "extra")]
    assert warc_audit.audit(spark.createDataFrame(rows, kind), spark.createDataFrame(rows, kind)).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert vector_graph.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.rules_table(spark, url_filter.RULES)).count() == 0
    field = toxicity.fit_field(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.tag_toxic(none, field).count() == 0
