"""Flags in job metadata, checks of settings and choices among sources, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys in order of precedence, and the texts that mean yes.
ZOOM_KEYS, ZOOM_YES = ("dynamicZoom", "dynamic_zoom"), ("true", "1")
SHORTS_KEYS, SHORTS_YES = ("generate_shorts", "generateShorts", "shorts"), ("true", "1", "yes")


def variant_flag(value: Column, yes: tuple[str, ...], default: Column) -> Column:
    """A boolean as it is, the number 1, or a text that means yes (case and white space around don't matter); ``default`` for null, no for anything else."""
    kind = F.schema_of_variant(value)
    text = F.lower(F.regexp_replace(F.try_variant_get(value, "$", "string"), r"(?U)^\s+|\s+$", ""))
    number = F.coalesce(F.try_variant_get(value, "$", "double") == 1, F.lit(False))
    named = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(kind == "STRING", text.isin(*yes)).otherwise(number)
    return F.when(value.isNull() | F.is_variant_null(value), default).otherwise(named)


def metadata_flag(metadata: Column, keys: tuple[str, ...], yes: tuple[str, ...], null: Column, absent: Column) -> Column:
    """The flag under the first key that a JSON object has, even with a null (then ``null``); ``absent`` without any or for what isn't JSON."""
    parsed = F.try_parse_json(metadata)
    held = [F.try_variant_get(parsed, f"$.{k}", "variant") for k in keys]
    return F.coalesce(*[F.when(v.isNotNull(), variant_flag(v, yes, null)) for v in held], absent)


def zoom_enabled(metadata: Column) -> Column:
    return metadata_flag(metadata, ZOOM_KEYS, ZOOM_YES, F.lit(False), F.lit(False))


def shorts_enabled(metadata: Column, default: Column) -> Column:
    return metadata_flag(metadata, SHORTS_KEYS, SHORTS_YES, default, default)


def semantic_enabled(mode: Column, words: Column, total_ms: Column, least_shot_ms: Column) -> Column:
    """Whether shots are planned by meaning: the mode asks for it, there are words and more than one shot's time."""
    return F.coalesce((mode == "gemini") & (words > 0) & (total_ms > least_shot_ms), F.lit(False))


def resolve_duration(given: Column, transcript: Column, last_word_end: Column) -> Column:
    """The first of the given and the transcript's duration that is above 0, else the last word's end, else 0."""
    return F.coalesce(F.when(given > 0, given), F.when(transcript > 0, transcript), last_word_end, F.lit(0))


def caption_source(transcript: Column, own: Column) -> Column:
    """The transcript's words, even if none, else the cut's own unless there are none."""
    return F.coalesce(transcript, F.when(F.size(own) > 0, own))


def input_error(valid: Column, audio: Column, speech: Column) -> Column:
    """Why an item stops, by its first failing stage; null if it doesn't. What isn't known fails."""
    fails = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(fails(valid), "INPUT_FILE_INVALID").when(fails(audio), "NO_AUDIO_STREAM").when(fails(speech), "NO_SPEECH_DETECTED")


def valid_weights(weights: list[Column], low: Column, high: Column) -> Column:
    """Weights sum to 1 within a thousandth and the luminance window isn't turned round."""
    total = sum(weights[1:], weights[0])
    return (F.abs(total - 1) <= 1e-3) & (low <= high)


def valid_shot_lengths(least: Column, target: Column, most: Column) -> Column:
    return (least <= target) & (target <= most)


def valid_headline(text: Column, most: int) -> Column:
    """Some words, no more than ``most``."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.coalesce((words > 0) & (words <= most), F.lit(False))


def valid_rgb(channels: Column) -> Column:
    return F.coalesce((F.size(channels) == 3) & F.forall(channels, lambda c: c.between(0, 255)), F.lit(False))


def valid_mode(mode: Column) -> Column:
    """A result names the mode that was used, never the automatic choice."""
    return F.coalesce(F.upper(mode) != "AUTO", F.lit(False))
