r"""Personal data and what gives it away, in DataFrame expressions only.

Four kinds of values are found by patterns. Each value is an entity whose information content is IC(c) = -log p(c), p being its occurrences over all words
of the corpus. Words around an entity's occurrences are terms; PMI(c; t) = log(p(c | t) / p(c)) says how much of the entity a term gives away, p(c | t)
being the share of the term's occurrences in the whole corpus that stand beside the entity. In a text that holds the entity, a term beside it
whose PMI reaches GENERALISE of IC(c) is generalised to its class, one that reaches REMOVE is removed; both wherever they stand in that text.

The patterns begin where no shorter match could begin (look-behind, or the end of the match before) and are possessive: they
find the plain patterns' matches in time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stash

#: Characters of context on each side, words of a term, contexts that must hold a pair, shares of the information content.
CONTEXT, WORD, SUPPORT, GENERALISE, REMOVE = 100, r"\p{L}[\p{L}\p{N}]{2,}", 3, 0.75, 0.9
#: Prefix sums are made in blocks of so many entries.
BLOCK = 128
KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalised", "removed")

_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every text with a value of the kind holds.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}


def running(lengths: Column) -> Column:
    """For each entry of an array of ints, the sum of those before it; two levels of blocks keep copies short."""
    empty = F.array().cast("array<int>")
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    sums = lambda part, base: F.aggregate(part, F.struct(base.alias("at"), empty.alias("out")), step)["out"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    bases = sums(F.transform(blocks, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.when(F.size(lengths) > 0, F.flatten(F.zip_with(blocks, bases, sums))).otherwise(empty)


def _pieces(text: Column, pattern: str) -> Column:
    """Array of (value, before, after): every match with the text up to the match before and after it."""
    values, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    n = F.size(values)
    return F.arrays_zip(values.alias("value"), F.slice(rest, F.lit(1), n).alias("before"), F.slice(rest, F.lit(2), n).alias("after"))


def _starts(pieces: Column) -> Column:
    return F.zip_with(running(F.transform(pieces, lambda p: F.length(p["value"]) + F.length(p["before"]))), pieces, lambda at, p: at + F.length(p["before"]))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def weighed(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weighed) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    digits = F.translate(value, "+ ().-", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    plain = {"email": F.lower(value), "ip": value}.get(kind, F.translate(value, " ().-", ""))
    return F.concat(F.lit(f"{kind}:"), plain)


def _kept(kind: str, pieces: Column) -> Column:
    """The values of one kind that pass its check."""

    def at(start: Column, p: Column) -> Column:
        end, number = start + F.length(p["value"]), F.lit(KINDS.index(kind))
        sides = F.right(p["before"], F.lit(CONTEXT + 1)).alias("before"), F.left(p["after"], F.lit(CONTEXT + 1)).alias("after")
        return F.struct(number.alias("kind"), start.alias("start"), end.alias("end"), p["value"].alias("value"), _entity(kind, p["value"]).alias("entity"), *sides)

    return F.filter(F.zip_with(_starts(pieces), pieces, at), lambda s: _passes(kind, s["value"]))


def base_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) with ``base``: array of (kind: number in KINDS, start, end, entity, before, after), by kind and start; code points, end exclusive.

    ``before`` and ``after`` are up to CONTEXT + 1 characters, as far as the next value of the kind, before checks. Matches that fail their kind's check are
    dropped; others do not begin in them.
    """
    pieces = {k: F.when(F.contains("text", F.lit(_HINT[k])) if k == "email" else F.rlike("text", F.lit(_HINT[k])), _pieces(F.col("text"), _PATTERN[k])) for k in KINDS}
    rows = rows.select("*", *[p.alias(f"{k}_pieces") for k, p in pieces.items()])
    kind = "array<struct<kind:int,start:int,end:int,value:string,entity:string,before:string,after:string>>"
    all_spans = [F.coalesce(_kept(k, F.col(f"{k}_pieces")), F.array().cast(kind)) for k in KINDS]
    return rows.select("id", "text", F.concat(*all_spans).alias("base"))


def _terms(span: Column) -> Column:
    """Words beside a value, within its line and CONTEXT; a word that the context's end cuts is left out."""
    before = F.when(F.length(span["before"]) > CONTEXT, F.regexp_replace(span["before"], r"^[\p{L}\p{N}]+", "")).otherwise(span["before"])
    after = F.when(F.length(span["after"]) > CONTEXT, F.regexp_replace(span["after"], r"[\p{L}\p{N}]+$", "")).otherwise(span["after"])
    beside = F.concat(F.substring_index(before, "\n", -1), F.lit("\n"), F.substring_index(after, "\n", 1))
    return F.regexp_extract_all(F.lower(beside), F.lit(WORD), F.lit(0))


def disclosing(contexts: DataFrame, texts: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """entity, term, disclosure: terms that give away ``least`` of an entity's information content or more, by counts over all ``texts`` (text).

    ``contexts``: entity, terms (array), k (how often the context comes). A pair counts if at least ``support`` different contexts hold it, so that copies of one text prove nothing.
    """
    pairs = contexts.select("entity", "k", F.xxhash64("terms").alias("context"), F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term", "context").agg(F.sum("k").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("support"))
    pairs = pairs.where(F.col("support") >= support).select("entity", "term", "together")
    entities = contexts.groupBy("entity").agg(F.sum("k").alias("n_entity"))
    words = stash(texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "words")
    total = words.agg(F.sum("n_term")).first()[0] or 0
    content = -F.log(F.col("n_entity") / F.lit(max(total, 1)))
    share = F.least(F.lit(1.0), F.col("together") / F.col("n_term"))
    found = pairs.join(words, "term").join(entities, "entity").where(F.col("n_entity") < total)
    return found.select("entity", "term", (1 + F.log(share) / content).alias("disclosure")).where(F.col("disclosure") >= least)


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Array of (kind, start, end) of the words of ``text`` that ``terms`` (array of (term, kind)) names, but for those that touch ``base``."""
    pieces = _pieces(text, WORD)
    at = lambda start, p: F.struct(F.element_at(F.map_from_entries(terms), F.lower(p["value"])).alias("kind"), start.alias("start"), (start + F.length(p["value"])).alias("end"))
    named = F.filter(F.zip_with(_starts(pieces), pieces, at), lambda s: s["kind"].isNotNull())
    return F.filter(named, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Per row: id, spans (array of (kind, start, end): number in KINDS + TERM_KINDS, code points, end exclusive, by kind and start), sanitised.

    ``sanitised`` is the text with values and generalised terms replaced by their class in brackets and removed terms left out, of overlapping spans the first one;
    null where nothing was found and the text stands. Texts without values are left alone. Null texts are empty; rows of one id or text each give a
    row, null ids too; equal texts count as often as they come; no rows give none; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = base_spans(rows)
    some = F.size("base") > 0
    found = stash(found.select("id", F.when(some, F.sha2(F.col("text").cast("binary"), 256)).alias("key"), F.when(some, F.col("text")).alias("text"), "base"), "values")
    own = found.where("key is not null")
    distinct = own.groupBy("key").agg(F.first("base").alias("base"), F.count("*").alias("k")).select("key", "k", F.explode("base").alias("s"))
    contexts = stash(distinct.select("key", "k", "s.entity", _terms(F.col("s")).alias("terms")), "contexts")
    risky = stash(disclosing(contexts, rows, support, generalise), "risky")
    beside = contexts.select("key", "entity", F.explode("terms").alias("term")).distinct().join(risky, ["entity", "term"]).groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))
    kind = F.when(F.col("disclosure") >= remove, len(KINDS) + 1).otherwise(len(KINDS))
    beside = beside.groupBy("key").agg(F.collect_list(F.struct("term", kind.alias("kind"))).alias("terms"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    added = F.when(F.col("terms").isNotNull(), F.sort_array(_term_spans(F.col("text"), F.col("terms"), F.col("base"))))
    marked = own.join(beside, "key", "left").select("id", "text", plain.alias("base"), added.alias("added"))
    marked = marked.select("id", "text", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")).alias("spans"))
    out = marked.select("id", "spans", masked(F.col("text"), F.col("spans")).alias("sanitised"))
    clean = found.where("key is null").select("id", plain.alias("spans"), F.lit(None).cast("string").alias("sanitised"))
    return clean.unionByName(out).withColumnRenamed("id", id_col)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span (kind, start, end) replaced by its class."""
    names = [*(f"[{k.upper()}]" for k in KINDS), None, ""]
    first = lambda s: F.substring(text, s["start"] + 1, F.lit(1))
    name = lambda s: F.when(s["kind"] == len(KINDS), F.when(first(s) != F.lower(first(s)), "[NAME]").otherwise("[WORD]")).otherwise(F.element_at(F.array(*[F.lit(n or "") for n in names]), s["kind"] + 1))
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        grown = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, name(s))).alias("parts"))
        return F.when(s["start"] >= acc["at"], grown).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))

    return F.aggregate(by_place, begin, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms (spans that the method adds)."""
    out = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    kinds = F.array(*[F.lit(k) for k in (*KINDS, *TERM_KINDS)])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return out.select("doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["kind"] >= len(KINDS))).cast("long").alias("n_terms"))


def _matches_sql(name: str, source: str, kind: str, pattern: str) -> str:
    """A CTE of (rid, kind, value, start, stop, before, after): matches with their places by running sums."""
    return f"""{name}_m as (select rid, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as r from {source}), {name}_u as (select rid, m, r, unnest(range(1, len(m) + 1)) as i from {name}_m),
{name} as (select rid, {kind} as kind, m[i] as value, (sum(length(r[i]) + length(m[i])) over (partition by rid order by i) - length(m[i]))::bigint as start, (sum(length(r[i]) + length(m[i])) over (partition by rid order by i))::bigint as stop, right(r[i], {CONTEXT + 1}) as before, left(r[i + 1], {CONTEXT + 1}) as after from {name}_u)"""


_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
_DIGIT = "substring(reverse(digits), i, 1)::int"
#: The method again, with the plain patterns.
OP13_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
{", ".join(_matches_sql(k, "d", str(n), _PLAIN[k]) for n, k in enumerate(KINDS))},
every as ({" union all ".join(f"select * from {k}" for k in KINDS)}), digits as (select *, regexp_replace(value, '[^0-9]', '', 'g') as digits from every),
base as (select * from digits where case kind
  when 1 then list_bool_and(list_transform(string_split(value, '.'), lambda p: length(ltrim(p, '0')) < 3 or (length(ltrim(p, '0')) = 3 and ltrim(p, '0') <= '255')))
  when 2 then length(digits) between 16 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda i: case when i % 2 = 1 then {_DIGIT} when {_DIGIT} > 4 then 2 * {_DIGIT} - 9 else 2 * {_DIGIT} end)) % 10 = 0
  when 3 then length(digits) between 8 and 15 else true end),
sides as (select *, case when kind = 0 then lower(value) when kind = 1 then value when kind = 3 then '+' || digits else digits end as who, case when length(before) > {CONTEXT} then regexp_replace(before, '^[\\p{{L}}\\p{{N}}]+', '') else before end as b,
  case when length(after) > {CONTEXT} then regexp_replace(after, '[\\p{{L}}\\p{{N}}]+$', '') else after end as a from base),
contexts as (select rid, kind, who, regexp_extract_all(lower(string_split(b, chr(10))[-1] || chr(10) || string_split(a, chr(10))[1]), '{WORD}') as terms from sides),
pairs as (select kind, who, term, count(*) as together, count(distinct terms) as support from (select kind, who, terms, unnest(terms) as term from contexts) group by all),
words as (select term, count(*) as n from (select unnest(regexp_extract_all(lower(text), '{WORD}')) as term from d) group by 1), total as (select sum(n) as n from words), entities as (select kind, who, count(*) as n from contexts group by all),
risky as (select p.kind, p.who, p.term, 1 + ln(least(1.0::double, together::double / w.n)) / -ln(e.n::double / (select n from total)) as disclosure from pairs p join words w on w.term = p.term join entities e on e.kind = p.kind and e.who = p.who where support >= {SUPPORT} and e.n < (select n from total)),
worst as (select rid, x.term, max(disclosure) as disclosure from (select rid, kind, who, unnest(terms) as term from contexts) x join risky r on r.kind = x.kind and r.who = x.who and r.term = x.term where disclosure >= {GENERALISE} group by all),
named as (select * from d where rid in (select rid from worst)), {_matches_sql("said", "named", "4", WORD)},
added as (select s.rid, case when disclosure >= {REMOVE} then 5 else 4 end as kind, s.start, s.stop from said s join worst w on w.rid = s.rid and w.term = lower(s.value) where not exists (select 1 from base b where b.rid = s.rid and b.start < s.stop and s.start < b.stop)),
spans as (select rid, kind, start, stop, {[*KINDS, *TERM_KINDS]}[kind + 1] || ':' || start || ':' || stop as said from (select rid, kind, start, stop from base union all select * from added))
select doc_id, {", ".join(f"count(*) filter (kind = {n}) as n_{k}" for n, k in enumerate(KINDS))}, sha256(coalesce(string_agg(said, ',' order by kind, start) filter (kind < {len(KINDS)}), '')) as base_sha256, coalesce(string_agg(said, ',' order by kind, start), '') as spans, count(*) filter (kind >= {len(KINDS)}) as n_terms
from d left join spans using (rid) group by rid, doc_id
"""
