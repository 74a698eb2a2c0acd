"""Column functions on words, captions and labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")


#: Letters with marks below U+2000 and the same without, where that is one letter.
_MARKED = [(c, _bare(c)) for c in map(chr, range(0xC0, 0x2000)) if len(_bare(c)) == 1 and _bare(c) != c]


def collapse(c: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fragment(c: Column) -> Column:
    """Lower-cased letters, digits and white space, without marks (letters up to U+1FFF)."""
    plain = F.translate(c, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))
    return F.lower(F.regexp_replace(plain, r"(?U)[^\p{L}\p{N}\s]", ""))


def first_words(c: Column, most: int = 5, default: str = "ASSISTA AGORA") -> Column:
    """The first ``most`` words as they are; ``default`` for none or null."""
    words = F.filter(F.split(collapse(c), " "), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, most), " ")).otherwise(default)


def fallback_headline(title: Column, transcript: Column, least: int = 2, most: int = 4, default: str = "ASSISTA AGORA") -> Column:
    """The headline of the title, else of the transcript, else ``default``."""
    return F.coalesce(headline(title, least, most), headline(transcript, least, most), F.lit(default))


def resolve_headline(given: list[Column], title: Column, transcript: Column) -> Column:
    """The first given text that isn't blank, cut to five words, else the fallback."""
    return F.coalesce(*[F.when(collapse(g) != "", first_words(g)) for g in given], fallback_headline(title, transcript))


def headline(c: Column, least: int = 2, most: int = 4) -> Column:
    """Upper-cased words, cut to ``most``; null with fewer than ``least``."""
    words = F.split(F.upper(collapse(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "))), " ")
    words = F.filter(words, lambda w: w != "")
    return F.when(F.size(words) >= least, F.array_join(F.slice(words, 1, most), " "))


def truncate_words(c: Column, most: int) -> Column:
    """The longest prefix of whole words within ``most`` characters; empty if the first word is longer."""
    c = collapse(c)
    cut = F.regexp_replace(F.substring(c, 1, most + 1), r"\s*\S*$", "")
    return F.when(F.length(c) <= most, c).otherwise(cut)


def hashtags(tags: Column) -> Column:
    """Stripped of white space, ``#`` in front, spaces as ``_``, the first of equals; empty ones go."""
    tags = F.filter(F.transform(tags, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: (t != "") & (t != "#"))
    return F.array_distinct(F.transform(tags, lambda t: F.translate(F.when(F.startswith(t, F.lit("#")), t).otherwise(F.concat(F.lit("#"), t)), " ", "_")))


def safe_name(c: Column) -> Column:
    """Letters, digits and ``._-`` stay, others become ``_``; ``short`` for nothing."""
    return F.when(F.coalesce(c, F.lit("")) == "", "short").otherwise(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_"))


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc, centiseconds rounded half to even."""
    cs = F.greatest(F.lit(0), F.rint(ms / 10).cast("bigint"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), two(F.floor(cs / 6000) % 60), F.lit(":"), two(F.floor(cs / 100) % 60), F.lit("."), two(cs % 100))


def ass_colour(c: Column) -> Column:
    """``RRGGBB`` or ``AARRGGBB``, with or without ``#``, as ``&HAABBGGRR&`` with the digits as they are; ``&H...`` as it is; white space around is ignored, others are null."""
    c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    h = F.regexp_replace(c, "^#+", "")
    argb = F.when(F.length(h) == 6, F.concat(F.lit("00"), h)).when(F.length(h) == 8, h)
    swapped = F.concat(F.lit("&H"), F.substring(argb, 1, 2), F.substring(argb, 7, 2), F.substring(argb, 5, 2), F.substring(argb, 3, 2), F.lit("&"))
    return F.when(F.upper(F.substring(c, 1, 2)) == "&H", c).otherwise(swapped)


def ass_escape(c: Column) -> Column:
    """Backslashes doubled, braces full-width, line ends as spaces."""
    return F.translate(F.replace(c, F.lit("\\"), F.lit("\\\\")), "{}\r\n", "｛｝  ")


def dialogue(start_ms: Column, end_ms: Column, text: Column) -> Column:
    return F.concat(F.lit("Dialogue: 0,"), ass_time(start_ms), F.lit(","), ass_time(end_ms), F.lit(",Default,,0,0,0,,"), text)


def flag(c: Column, words: tuple[str, ...] = ("true", "1")) -> Column:
    """A yes in free text; null is no."""
    return F.coalesce(F.lower(F.trim(c)).isin(*words), F.lit(False))


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds of seconds (a number or its text), half to even; null for what isn't one."""
    return F.rint(seconds.try_cast("double") * 1000).try_cast("bigint")


def probability(c: Column) -> Column:
    """Clamped to 0..1; 0 for what isn't a number."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.try_cast("double"))), F.lit(0.0))


def clip_text(c: Column, most: int = 220) -> Column:
    """At most ``most`` characters, the last three of them dots if it was longer."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def filter_path(c: Column) -> Column:
    """A path quoted for a filter text."""
    return F.concat(F.lit("'"), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:")), F.lit("'"), F.lit("”")), F.lit("'"))


def seconds_text(ms: Column) -> Column:
    """Seconds with six decimals."""
    return F.format_string("%.6f", ms / 1000)


def fixed(c: Column, places: int) -> Column:
    """A number with ``places`` (9 at most) decimals, rounded by its exact binary value, as C and Python print it: 0.00015 is a little less than it seems. Beyond 2**52 units of the last place its decimal form is rounded.

    The product with the power of ten is split into its rounded value and its error, so what is left over a half has the right sign.
    """
    unit, a = float(10**places), F.abs(c.cast("double"))
    wide = a * 134217729.0  # 2**27 + 1 cuts a double into halves whose products are exact
    high = wide - (wide - a)
    rough = a * unit
    error = (high * unit - rough) + (a - high) * unit
    whole = F.floor(rough)
    over = (rough - whole - 0.5) + error
    n = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    sign = F.when(F.startswith(c.cast("double").cast("string"), F.lit("-")), "-").otherwise("")
    exact = F.concat(sign, F.floor(n / 10**places).cast("string"), F.lit("."), F.lpad((n % 10**places).cast("string"), places, "0"))
    return F.when(rough < 2.0**52, exact).when(c.isNotNull(), F.format_string(f"%.{places}f", F.bround(c.cast("double"), places)))
