"""Caption cues from timed words (media_id, word_idx, word, start_ms, end_ms)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediaspan.functions import text

KEY = "media_id"


def reindex_words(words: DataFrame, cut_start: int, cut_end: int | None) -> DataFrame:
    """Words that meet the cut, on its clock: no word shorter than 50 ms on input; ends are not clipped to the cut."""
    end = F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 50).otherwise(F.col("end_ms"))
    rows = words.withColumn("end_ms", end).where(F.col("end_ms") > cut_start)
    if cut_end is not None:
        rows = rows.where(F.col("start_ms") < cut_end)
    rows = rows.withColumn("start_ms", F.greatest(F.lit(0), F.col("start_ms") - cut_start))
    return rows.withColumn("end_ms", F.greatest(F.col("start_ms"), F.col("end_ms") - cut_start))


def cues(words: DataFrame, size: int) -> DataFrame:
    """Every ``size`` words in order make a cue: first start, last end, text joined by spaces."""
    n = (F.row_number().over(W.partitionBy(KEY).orderBy("word_idx")) - 1) / size
    rows = words.withColumn("cue", F.floor(n))
    by = rows.groupBy(KEY, "cue").agg(F.min_by("start_ms", "word_idx").alias("start_ms"), F.max_by("end_ms", "word_idx").alias("end_ms"), F.sort_array(F.collect_list(F.struct("word_idx", "word"))).alias("w"))
    return by.select(KEY, "cue", "start_ms", "end_ms", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


def clean_words(raw: DataFrame) -> DataFrame:
    """Recognised words (media_id, word_idx, word, start, end in seconds, probability): white space collapsed, times in ms from 0 on, no end before the start. Words without text or start go."""
    start = F.greatest(F.lit(0).cast("bigint"), text.to_ms(F.col("start")))
    rows = raw.withColumns({"word": text.collapse(F.col("word").cast("string")), "probability": text.probability(F.col("probability"))})
    rows = rows.where((F.col("word") != "") & text.to_ms(F.col("start")).isNotNull())
    return rows.select(KEY, "word_idx", "word", start.alias("start_ms"), F.greatest(start, F.coalesce(text.to_ms(F.col("end")), start)).alias("end_ms"), "probability")


def transcripts(segments: DataFrame, words: DataFrame) -> DataFrame:
    """media_id, text, segments (id, text, start_ms, end_ms, words) and words of each item: recognised segments (media_id, seg_idx, text, start, end in seconds) with their words
    (those of ``clean_words`` and seg_idx).

    Segments are numbered from 0 in the order of seg_idx; a missing start is 0, a missing or earlier end the start; the text is the segments' texts, empty ones left out, line by line. One row an item, as long as its transcript; items
    without segments give none, words without a segment are left out.
    """
    word = F.struct("word_idx", "word", "start_ms", "end_ms", "probability")
    spoken = words.groupBy(KEY, "seg_idx").agg(F.sort_array(F.collect_list(word)).alias("words"))
    start = F.greatest(F.lit(0).cast("bigint"), F.coalesce(text.to_ms(F.col("start")), F.lit(0).cast("bigint")))
    rows = segments.select(KEY, "seg_idx", text.collapse(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), start.alias("start_ms"), F.greatest(start, F.coalesce(text.to_ms(F.col("end")), start)).alias("end_ms"))
    rows = rows.join(spoken, [KEY, "seg_idx"], "left").withColumn("words", F.coalesce("words", F.array().cast(spoken.schema["words"].dataType)))
    whole = rows.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("seg_idx", "text", "start_ms", "end_ms", "words"))).alias("s"))
    said = F.array_join(F.filter(F.transform("s", lambda x: x["text"]), lambda t: t != ""), "\n")
    numbered = F.transform("s", lambda x, i: F.struct(i.cast("int").alias("id"), x["text"].alias("text"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["words"].alias("words")))
    return whole.select(KEY, said.alias("text"), numbered.alias("segments"), F.flatten(F.transform("s", lambda x: x["words"])).alias("words"))


def flat_words(words: Column, segments: Column) -> Column:
    """A transcript's words, or where it has none those of its segments, in order."""
    return F.when(F.size(words) > 0, words).otherwise(F.flatten(F.transform(segments, lambda s: s["words"])))


def cue_words(words: DataFrame, size: int) -> DataFrame:
    """Cues of ``size`` words with their words (word_idx, word, start_ms, end_ms) in order."""
    n = F.floor((F.row_number().over(W.partitionBy(KEY).orderBy("word_idx")) - 1) / size)
    by = words.withColumn("cue", n).groupBy(KEY, "cue").agg(F.sort_array(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms"))).alias("words"))
    return by.select(KEY, "cue", F.col("words")[0]["start_ms"].alias("start_ms"), F.element_at("words", -1)["end_ms"].alias("end_ms"), "words")


def karaoke_dialogues(cues: DataFrame, tag: str = "k", least_ms: int = 50) -> DataFrame:
    """One line a cue; each word after its length in hundredths of a second (half to even, 1 at least)."""
    length = lambda w: F.greatest(F.lit(1).cast("bigint"), F.rint(F.greatest(F.lit(least_ms), w["end_ms"] - w["start_ms"]) / 10).cast("bigint"))
    spoken = F.transform("words", lambda w: F.concat(F.lit("{\\" + tag), length(w).cast("string"), F.lit("}"), text.ass_escape(w["word"])))
    return cues.select(KEY, "cue", F.lit(0).alias("k"), text.dialogue(F.col("start_ms"), F.col("end_ms"), F.array_join(spoken, " ")).alias("line"))


def highlight_dialogues(cues: DataFrame, style: Style | None = None) -> DataFrame:
    """One line a word, on the word's time: the cue's words, the spoken one larger and in the highlight colour."""
    style = style or Style()
    size = round(style.active_scale * 100)
    mark = lambda colour, scale: F.concat(F.lit("{\\c"), text.ass_colour(F.lit(colour)), F.lit(f"\\fscx{scale}\\fscy{scale}}}"))
    shown = F.transform("words", lambda w, i: F.concat(F.when(i == F.col("k"), mark(style.highlight, size)).otherwise(mark(style.primary, 100)), text.ass_escape(w["word"])))
    rows = cues.select("*", F.posexplode("words").alias("k", "w"))
    return rows.select(KEY, "cue", "k", text.dialogue(F.col("w.start_ms"), F.col("w.end_ms"), F.concat(F.lit("{\\r} "), F.array_join(shown, " "))).alias("line"))


@dataclass(frozen=True)
class Style:
    """Caption style; colours as in ``text.ass_colour``."""

    font: str = "Montserrat"
    size: int = 52
    primary: str = "#FFFFFF"
    highlight: str = "#FFF200"
    outline: str = "#000000"
    shadow: str = "#80000000"
    bold: bool = True
    outline_width: float = 3.5
    shadow_depth: float = 1.5
    alignment: int = 2
    margin_l: int = 50
    margin_r: int = 50
    margin_v: int = 160
    active_scale: float = 1.05


# The names of style and event fields.
STYLE_FIELDS = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def documents(dialogues: DataFrame, style: Style | None = None, width: int = 1080, height: int = 1920) -> DataFrame:
    """A caption document of each item from its lines (cue, k, line). A document is one row, as long as the item's captions."""
    s = style or Style()
    head = ["[Script Info]", "ScriptType: v4.00+", f"PlayResX: {width}", f"PlayResY: {height}", "ScaledBorderAndShadow: yes", "WrapStyle: 0", "", "[V4+ Styles]", f"Format: {STYLE_FIELDS}"]
    colours = [c for name in (s.primary, s.highlight, s.outline, s.shadow) for c in (text.ass_colour(F.lit(name)), F.lit(","))]
    rest = f"{int(s.bold)},0,0,0,100,100,0,0,1,{s.outline_width},{s.shadow_depth},{s.alignment},{s.margin_l},{s.margin_r},{s.margin_v},1"
    styled = F.concat(F.lit(f"Style: Default,{s.font},{s.size},"), *colours, F.lit(rest))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("cue", "k", "line"))), lambda x: x["line"])
    body = F.array_join(F.concat(F.array(F.lit(""), F.lit("[Events]"), F.lit(f"Format: {EVENT_FIELDS}")), lines), "\n")
    return dialogues.groupBy(KEY).agg(F.concat(F.lit("\n".join(head) + "\n"), styled, F.lit("\n"), body, F.lit("\n")).alias("document"))


def document_counts(document: Column) -> Column:
    """Dialogue lines of a caption document and the words in them (texts in braces count, too)."""
    lines = F.filter(F.split(document, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.startswith(x, F.lit("Dialogue:")))
    shown = F.transform(lines, lambda x: F.coalesce(F.try_element_at(F.split(x, ",", 10), F.lit(10)), F.lit("")))
    words = F.transform(shown, lambda x: F.size(F.filter(F.split(F.translate(x, "{}", "  "), r"(?U)\s+"), lambda w: w != "")))
    return F.struct(F.size(lines).alias("cues"), F.aggregate(words, F.lit(0), lambda a, b: a + b).alias("words"))
