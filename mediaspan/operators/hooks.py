"""Hook anchors in timed words, and cuts around them: snapped to words and segments, fitted to a duration, scored.

Words are (media_id, word_idx, word, start_ms, end_ms) in the order of start, end and index; spans are (media_id, span_id, start_ms, end_ms).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediaspan.functions import text
from mediaspan.operators import intervals, selection, signal

KEY = "media_id"

# Words and phrases that mark a hook.
ADVERSATIVES = ("mas", "porem", "contudo", "entretanto", "todavia")
IMPACT = (
    "segredo", "secreto", "atencao", "alerta", "perceba", "repare", "descobri", "revelo", "revela", "revelar", "revelacao", "inacreditavel",
    "incrivel", "surpreendente", "importante", "proibido", "perigoso", "ninguem", "sabia", "verdade", "mudanca",
)
PHRASES = (
    "ninguem te conta", "ninguem vai te contar", "ninguem te contou", "o segredo e", "a verdade e", "a verdade e que", "preste atencao", "presta atencao",
    "isso vai mudar", "isso vai mudar tudo", "nao acredite em mim", "vou te mostrar", "quer saber por que", "voce sabia", "o motivo e", "por que voce",
    "eu vou te contar", "prossiga com atencao",
)


def anchors(words: DataFrame, segments: DataFrame, adversatives: Sequence[str] = ADVERSATIVES, impact: Sequence[str] = IMPACT, phrases: Sequence[str] = PHRASES) -> DataFrame:
    """Words that ask, turn, strike or begin a known phrase of two to four words, with score, reason and the first segment that holds their start (null for none)."""
    order = W.partitionBy(KEY).orderBy("start_ms", "end_ms", "word_idx")
    none = F.array().cast("array<string>")
    rows = words.withColumn("tokens", F.coalesce(F.filter(F.split(text.fragment(F.col("word")), r"(?U)\s+"), lambda t: t != ""), none))
    rows = rows.withColumn("ahead", F.concat("tokens", *[F.coalesce(F.lead("tokens", k).over(order), none) for k in (1, 2, 3)]))
    joined = [F.array_join(F.slice("ahead", 1, k), " ") for k in (2, 3, 4)]
    first = F.try_element_at("tokens", F.lit(1))
    rows = rows.withColumns({
        "asks": F.contains("word", F.lit("?")),
        "turn": F.when(first.isin(*adversatives), first),
        "strike": F.try_element_at(F.filter("tokens", lambda t: t.isin(*impact)), F.lit(1)),
        "phrase": F.coalesce(*[F.when((F.size("ahead") >= k) & j.isin(*phrases), j) for k, j in zip((2, 3, 4), joined)]),
    })
    named = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name} ('"), c, F.lit("')")))
    reasons = [F.when(F.col("asks"), "interrogacao retorica"), named("quebra adversativa", F.col("turn")), named("palavra de alto impacto", F.col("strike")), named("frase provocativa", F.col("phrase"))]
    worth = sum((F.when(r.isNotNull(), w).otherwise(0.0) for r, w in zip(reasons, (0.25, 0.25, 0.15, 0.30))), F.lit(0.50))
    rows = rows.withColumns({"reason": F.concat_ws("; ", *reasons), "score": F.round(F.least(F.lit(1.0), worth), 6)}).where("reason <> ''")
    rows = rows.select(KEY, "word_idx", "word", "start_ms", "end_ms", "score", "reason", F.col("start_ms").alias("at_ms"))
    return intervals.first_segments(rows, segments).withColumn("seg_idx", F.col("seg.seg_idx")).drop("seg", "at_ms")


def texts_within(spans: DataFrame, words: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Spans (each once) that hold whole words, with their number, their text (220 characters at most) and ``hook_text``, the words of the first five seconds."""
    items = words.select(KEY, "word_idx", "word", F.col("start_ms").alias("item_start_ms"), F.col("end_ms").alias("item_end_ms"))
    held = intervals.contained(items, spans, bucket_ms)
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["word"]), " ")
    place = F.struct("item_start_ms", "item_end_ms", "word_idx", "word")
    return held.groupBy(*spans.columns).agg(F.count("*").alias("n_words"), text.clip_text(listed(place)).alias("text"), listed(F.when(F.col("item_end_ms") <= F.col("start_ms") + 5000, place)).alias("hook_text"))


def candidates(words: DataFrame, segments: DataFrame, energy: DataFrame | None = None, step_ms: int = 250, **lists: Sequence[str]) -> DataFrame:
    """The best anchor of each segment (the first of equals; all words outside segments count as one), its span, and a confidence raised by the span's largest energy."""
    best = anchors(words, segments, **lists).groupBy(KEY, F.coalesce("seg_idx", F.lit(-1)).alias("seg_idx")).agg(
        F.min_by(F.struct("start_ms", "end_ms", "score", "reason"), F.struct((-F.col("score")).alias("s"), "start_ms", "end_ms", "word_idx")).alias("a")
    )
    spans = segments.select(KEY, "seg_idx", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    rows = best.join(spans, [KEY, "seg_idx"], "left").select(KEY, F.col("seg_idx").alias("span_id"), F.coalesce("s0", "a.start_ms").alias("start_ms"), F.coalesce("s1", "a.end_ms").alias("end_ms"), "a.score", "a.reason")
    boost = F.lit(0.0)
    if energy is not None:
        rows = signal.span_energy(rows, energy, step_ms)
        boost = F.when(F.col("max_energy") >= 0.85, 0.15).when(F.col("max_energy") >= 0.60, 0.10).otherwise(0.0)
    return rows.select(KEY, "span_id", "start_ms", "end_ms", "reason", F.round(F.least(F.lit(1.0), F.col("score") + boost), 6).alias("confidence"))


def _sides(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """Each row twice, with ``kind`` a at the first time and b at the second; its other columns as ``more``."""
    two = F.array(F.struct(F.lit("a").alias("kind"), first.alias("at_ms")), F.struct(F.lit("b").alias("kind"), second.alias("at_ms")))
    return rows.select(KEY, F.struct(*[c for c in rows.columns if c != KEY]).alias("more"), F.explode(two).alias("p")).select(KEY, "more", "p.*")


def snap(spans: DataFrame, words: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Spans (each span_id once; other columns stay) from the first word that ends after their start (else the last word) to the last one that starts before their end, not before the first; then to the segments that hold these words' starts. Media without words give none."""
    word = F.struct("start_ms", "end_ms", "word_idx")
    one = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    bounds = _sides(words.select(KEY, "start_ms", "end_ms", "word_idx"), F.col("end_ms"), F.col("start_ms")).withColumn("v", F.struct("more.start_ms", "more.end_ms", "more.word_idx")).drop("more")
    near = intervals.neighbours(_sides(spans, F.col("start_ms") + 1, F.col("end_ms") - 1), bounds, (KEY, "kind"))
    near = near.groupBy(KEY, F.col("more.span_id")).agg(F.any_value("more").alias("span"), one("a", "ceiling").alias("a"), one("b", "floor").alias("b"))
    rows = near.join(words.groupBy(KEY).agg(F.max(word).alias("last")), KEY).withColumn("a", F.coalesce("a", "last")).drop("last")
    rows = rows.withColumn("b", F.greatest("a", F.coalesce("b", "a")))
    start, end = F.col("a.start_ms"), F.col("b.end_ms")
    if segments is not None:
        held = intervals.first_segments(_sides(rows, F.col("a.start_ms"), F.col("b.start_ms")), segments)
        rows = held.groupBy(KEY, F.col("more.span_id")).agg(F.any_value("more").alias("m"), one("a", "seg").alias("sa"), one("b", "seg").alias("sb")).select(KEY, "span_id", "m.span", "m.a", "m.b", "sa", "sb")
        start, end = F.coalesce("sa.start_ms", start), F.coalesce("sb.end_ms", end)
    others = [F.col("span")[c].alias(c) for c in spans.columns if c not in (KEY, "span_id", "start_ms", "end_ms")]
    return rows.select(KEY, "span_id", start.alias("start_ms"), end.alias("end_ms"), *others)


def fit(spans: DataFrame, starts: DataFrame, ends: DataFrame, least: int, most: int) -> DataFrame:
    """Spans (each span_id once; other columns stay) of ``least`` to ``most`` ms. A short one grows to earlier starts, as far as ``most`` allows, then to later ends; a long one falls back to earlier ends, then to later starts. Those that cannot be fitted go.

    Walking from bound to bound ends at a bound that one range lookup gives: two rounds of lookups, however many bounds a walk would pass. ``starts`` and ``ends``: media_id, at_ms.
    """
    bounds = starts.select(KEY, F.lit("s").alias("kind"), "at_ms").union(ends.select(KEY, F.lit("e").alias("kind"), "at_ms")).withColumn("v", F.col("at_ms"))
    a, b = F.col("start_ms"), F.col("end_ms")
    length = b - a

    def look(rows: DataFrame, asked: dict[str, tuple[str, str, Column]]) -> DataFrame:
        """``rows`` with one column for each (kind, side, time) asked."""
        times = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), at.cast("bigint").alias("at_ms")) for name, (kind, _, at) in asked.items()]))
        probes = rows.select(KEY, F.struct(*[c for c in rows.columns if c != KEY]).alias("more"), times.alias("p")).select(KEY, "more", "p.*")
        found = intervals.neighbours(probes, bounds, (KEY, "kind")).groupBy(KEY, F.col("more.span_id"))
        found = found.agg(F.any_value("more").alias("more"), *[F.max(F.when(F.col("name") == name, F.col(side))).alias(name) for name, (_, side, _) in asked.items()])
        return found.select(KEY, "more.*", *asked)

    rows = look(spans.withColumns({"start_ms": a.cast("bigint"), "end_ms": b.cast("bigint")}), {
        "grown": ("s", "floor", b - least), "earliest": ("s", "ceiling", b - most), "cut": ("e", "floor", a + most), "least_end": ("e", "ceiling", a + least),
    })
    rows = rows.withColumns({
        "grown": F.when(F.col("grown") >= b - most, F.col("grown")),
        "from_": F.least("earliest", a),
        "cut": F.when(F.col("cut") >= a + least, F.col("cut")),
        "to_": F.least("least_end", b),
    })
    rows = look(rows, {"later": ("e", "ceiling", F.col("from_") + least), "late": ("s", "ceiling", F.col("to_") - most)})
    pair = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
    later = F.when(F.col("later") <= F.col("from_") + most, F.col("later"))
    late = F.when(F.col("late") <= F.col("to_") - least, F.col("late"))
    fitted = (
        F.when(length < least, F.coalesce(pair(F.col("grown"), b), pair(F.col("from_"), later)))
        .when(length > most, F.coalesce(pair(a, F.col("cut")), pair(late, F.col("to_"))))
        .otherwise(pair(a, b))
    )
    others = [c for c in spans.columns if c not in (KEY, "span_id", "start_ms", "end_ms")]
    return rows.withColumn("f", fitted).where("f is not null").select(KEY, "span_id", F.col("f.x").alias("start_ms"), F.col("f.y").alias("end_ms"), *others)


def strongest_peak(spans: DataFrame, peaks: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """The peak (start_ms, end_ms, peak_ms, intensity) of most intensity that each span holds wholly, the first of equals; spans without one are left out."""
    items = peaks.select(KEY, "peak_ms", "intensity", F.col("start_ms").alias("item_start_ms"), F.col("end_ms").alias("item_end_ms"))
    held = intervals.contained(items, spans.select(KEY, "span_id", "start_ms", "end_ms"), bucket_ms)
    best = F.struct((-F.col("intensity")).alias("i"), "item_start_ms")
    return held.groupBy(KEY, "span_id").agg(F.min_by("peak_ms", best).alias("peak_ms"), F.max("intensity").alias("intensity"))


def scored(spans: DataFrame, words: DataFrame, energy: DataFrame | None = None, step_ms: int = 250, semantic_weight: float = 0.7, energy_weight: float = 0.3, least: float = 0.6) -> DataFrame:
    """Spans (with confidence) that hold words, with texts and a score of confidence and largest energy (0.5 without energies); those below ``least`` go."""
    rows = spans.withColumn("max_energy", F.lit(0.5)) if energy is None else signal.span_energy(spans, energy, step_ms).drop("mean_energy")
    rows = texts_within(rows, words)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), semantic_weight * sure + energy_weight * F.col("max_energy")))
    rows = rows.withColumn("score", score).where(F.col("score") >= least)
    return rows.withColumns({"semantic_score": F.round(sure, 6), "energy_score": F.round("max_energy", 6), "score": F.round("score", 6)}).drop("confidence", "max_energy")


def cuts(words: DataFrame, segments: DataFrame, totals: DataFrame, energy: DataFrame | None = None, step_ms: int = 250, least_ms: int = 25_000, most_ms: int = 58_000, keep: int = 3, most_iou: float = 0.1, by_segments: bool = True, least: float = 0.6, **lists: Sequence[str]) -> DataFrame:
    """The ``keep`` best cuts of each item that overlap by at most ``most_iou``: candidates, clamped, snapped, fitted and scored."""
    found = candidates(words, segments, energy, step_ms, **lists).join(totals.select(KEY, "total_ms"), KEY)
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("total_ms")))
    found = found.withColumns({"start_ms": clamp("start_ms"), "end_ms": clamp("end_ms")}).where("end_ms > start_ms")
    bounds = segments if by_segments else words
    starts, ends = bounds.select(KEY, F.col("start_ms").alias("at_ms")).distinct(), bounds.select(KEY, F.col("end_ms").alias("at_ms")).distinct()
    fitted = fit(snap(found.select(KEY, "span_id", "start_ms", "end_ms", "confidence"), words, segments if by_segments else None), starts, ends, least_ms, most_ms)
    rows = scored(fitted, words, energy, step_ms, least=least)
    return selection.suppress_overlaps(rows.select(KEY, "start_ms", "end_ms", "score"), most_iou, min(keep, 3))
