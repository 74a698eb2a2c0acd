"""Personal data against plain patterns, and disclosing terms against counts in plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from mediaspan.llm import sanitise

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "generalised", "removed"]
WORD = re.compile(r"[^\W\d_](?:[^\W_]){2,}")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute_base(text):
    """(kind, start, end, value, before, after) of every value, by kind and start."""
    out = []
    for k, pattern in PATTERNS.items():
        found = list(re.finditer(pattern, text))
        for i, m in enumerate(found):
            before = text[found[i - 1].end() if i else 0 : m.start()]
            after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
            if passes(k, m.group()):
                out.append((k, m.start(), m.end(), m.group(), before, after))
    return out


def beside(before, after, context=sanitise.CONTEXT):
    if len(before) > context:
        before = re.sub(r"^[^\W_]+", "", before[-context - 1 :])
    if len(after) > context:
        after = re.sub(r"[^\W_]+$", "", after[: context + 1])
    return tuple(WORD.findall((before.rpartition("\n")[2] + "\n" + after.partition("\n")[0]).lower()))


def entity(kind, value):
    return kind, value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9+]", "", value)


def brute(rows, support=3, generalise=0.75, remove=0.9):
    """(id, all spans, base spans) of every row."""
    words, n_entity, together, contexts = Counter(), Counter(), Counter(), defaultdict(set)
    for _, text in rows:
        words.update(WORD.findall((text or "").lower()))
        for k, _, _, value, before, after in brute_base(text or ""):
            c, terms = entity(k, value), beside(before, after)
            n_entity[c] += 1
            for t in terms:
                together[c, t] += 1
                contexts[c, t].add(terms)
    total = sum(words.values())
    risky = {}
    for (c, t), n in together.items():
        if len(contexts[c, t]) >= support and n_entity[c] < total:
            d = 1 + math.log(min(1.0, n / words[t])) / -math.log(n_entity[c] / total)
            if d >= generalise:
                risky[c, t] = d
    out = []
    for i, text in rows:
        text, worst = text or "", {}
        found = brute_base(text)
        for k, _, _, value, before, after in found:
            for t in beside(before, after):
                d = risky.get((entity(k, value), t))
                if d is not None:
                    worst[t] = max(d, worst.get(t, d))
        base = [x[:3] for x in found]
        added = [("removed" if worst[m.group().lower()] >= remove else "generalised", *m.span()) for m in WORD.finditer(text) if m.group().lower() in worst]
        added = [a for a in added if not any(b[1] < a[2] and a[1] < b[2] for b in base)]
        out.append((i, base + sorted(added, key=lambda a: (KINDS.index(a[0]), a[1])), base))
    return out


def spans(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, [(KINDS[s.kind], s.start, s.end) for s in r.spans]) for r in df.collect()), key=repr)


def test_values_of_random_texts(spark):
    """Texts of the patterns' own letters, so that matches begin, end and fail in every way."""
    rng = random.Random(7)
    parts = ["a@b", "a@b.c", "@", ".", "x_y.z@q-r.co.uk", "1.2.3.4", "256.1.1.1", "000255.0.0.1", "4539578763621486", "4539 5787-6362 1486", "+1 (743) 555-3824", "+", "12", " ", "-", "é", "😀", "%", "(", "0", "\n", "00000000000000000", "+49.30 1234567"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    got = {r.id: [(KINDS[s.kind], s.start, s.end) for s in r.base] for r in sanitise.base_spans(df).collect()}
    want = {i: [x[:3] for x in brute_base(t)] for i, t in rows}
    assert got == want
    assert {k: sum(x[0] == k for v in want.values() for x in v) > 50 for k in PATTERNS} == dict.fromkeys(PATTERNS, True)


def test_terms_and_hard_rows(spark):
    """A name that stands beside one address only is masked where the address stands; null, empty, repeated and clean rows, clashing columns."""
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["the", "house", "of", "green", "tree", "was", "Élan"]) for _ in range(n))
    rows = [(i, f"{filler(30)}\nMarcellus wrote {filler(i)} ann@b.org, curator {filler(5)}.\nMarcellus {filler(40)}") for i in range(6)]
    rows += [(10, rows[0][1]), (10, rows[0][1]), (11, "Marcellus of the green house " + filler(200)), (12, None), (13, ""), (None, rows[1][1]), (None, None)]
    rows += [(20 + i, f"the curator {filler(20)}") for i in range(3)] + [(30, "ann@b.org " * 300 + "Marcellus"), (31, "Curator, +1 (743) 555-3824 " + filler(3))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    out = sanitise.sanitise(df)
    want = sorted(((i is None, i or 0, s) for i, s, _ in brute(rows)), key=repr)
    assert spans(out) == want
    assert {x[0] for _, _, s in want for x in s} >= {"email", "phone", "removed"}
    assert next(s for _, i, s in want if i == 11) == []
    texts = {r.doc_id: r.sanitised for r in out.collect()}
    assert texts[11] is None and texts[12] is None and "wrote" not in texts[0] and "[EMAIL]" in texts[0] and "ann@b" not in texts[30]
    assert texts[31].startswith("Curator, [PHONE] ")
    assert sanitise.sanitise(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """Runs of one character do not take time in their square, many values are placed right."""
    rows = [(1, "a" * 1_000_000 + "@"), (2, "1" * 1_000_000), (3, "+1 " + " " * 500_000), (4, "é 10.0.0.1 " * 20_000), (5, "1 " * 300_000), (6, "1." * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in sanitise.sanitise(df).select("doc_id", "spans").collect()}
    assert [len(got[i]) for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 20_000, 0]
    assert [(s.start, s.end) for s in got[4]] == [(11 * i + 2, 11 * i + 10) for i in range(20_000)]
    assert len(got[6]) == 75_000


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (all_spans, base) for i, all_spans, base in brute(rows)}
    got = sanitise.op13_pii(spark, sf).collect()
    assert len(got) == len(rows)
    text = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    for r in got:
        all_spans, base = want[r.doc_id]
        assert (r.spans, r.base_sha256) == (text(all_spans), hashlib.sha256(text(base).encode()).hexdigest())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in PATTERNS]
    assert sum(len(b) for _, b in want.values()) > 10


def test_no_python_workers(spark):
    """Native on the main path."""
    plan = sanitise.op13_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups"))


def test_sql_equals_the_query(spark, tmp_path):
    """DuckDB's rows on the smallest table, and on texts with terms that are masked."""
    import duckdb

    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["the", "house", "of", "green", "tree", "was", "Élan"]) for _ in range(n))
    rows = [(i, f"{filler(60)}\nMarcellus wrote {filler(i)} ann@b.org, curator {filler(25)} and 10.0.0.{i}.\nMarcellus {filler(40)}") for i in range(8)]
    rows += [(20, None), (21, ""), (22, "the curator " + filler(400)), (None, rows[0][1])]
    made = tmp_path / "made"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(made / "documents.parquet"))
    added = []
    for sf in (str(made), "/root/testdata/sf0.001"):
        got = sanitise.op13_pii(spark, sf)
        con = duckdb.connect()
        path = f"{sf}/documents.parquet/*.parquet" if sf == str(made) else f"{sf}/documents.parquet"
        con.execute(f"create view documents as select * from '{path}'")
        want = con.sql(f"select {', '.join(got.columns)} from ({sanitise.OP13_SQL})").fetchall()
        rows = [tuple(r) for r in got.collect()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)
        added.append(sum(r[-1] for r in rows))
    assert added[0] > 10
