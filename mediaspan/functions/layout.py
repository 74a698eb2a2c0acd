"""Headlines on a canvas: greedy wrapping by a width table, the largest font size that fits, boxes of lines, the subject's place.

Widths are whole units, 1000 to the font size, so that whether a line fits is decided exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Margin, the corner that stays free of text, the zone's share of the height and width, smallest size, step and line spacing.
MARGIN, SAFE_X, SAFE_Y, TOP, BOTTOM, RIGHT_SHARE, LEFT_SHARE, SMALLEST, STEP, SPACING = 40, 1050, 600, 0.12, 0.62, 2 / 3, 0.34, 36, 2, 0.18


@dataclass(frozen=True)
class Font:
    """Advance of each character, of others, ascent and descent, in units of a thousandth of the size."""

    advances: dict[str, int] = field(default_factory=dict)
    other: int = 600
    ascent: int = 930
    descent: int = 240

    def units(self, text: Column) -> Column:
        """Width of a text in units."""
        near = F.array(*[F.lit(self.advances.get(chr(c), self.other)) for c in range(128)])
        far = {c: x for c, x in self.advances.items() if ord(c[0]) >= 128}
        table = F.create_map(*[F.lit(x) for pair in far.items() for x in pair]) if far else None
        rest = lambda c: F.coalesce(F.try_element_at(table, c), F.lit(self.other)) if far else F.lit(self.other)
        one = lambda c: F.when(c == "", 0).when(F.ascii(c) < 128, F.get(near, F.ascii(c))).otherwise(rest(c))
        return F.aggregate(F.split(text, ""), F.lit(0), lambda total, c: total + one(c))

    def line_height(self, size: Column) -> Column:
        return (F.ceil(size * self.ascent / 1000) + F.ceil(size * self.descent / 1000)).cast("int")


def words_of(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"[\s\x1c-\x1f\x85\xa0]+"), lambda w: w != "")


def _measured(text: Column, font: Font) -> Column:
    return F.transform(words_of(text), lambda w: F.struct(w.alias("text"), font.units(w).alias("units")))


def _wrap(words: Column, most: Column, space: int) -> Column:
    """Lines (text, units) of measured words: a word begins a line if the line would get wider than ``most`` units with it. No words give one empty line."""
    none = F.array().cast("array<struct<text:string,units:int>>")
    line = lambda text, units: F.struct(text.alias("text"), units.alias("units"))

    def step(acc: Column, w: Column) -> Column:
        open_, lines = acc["open"], acc["lines"]
        wider = open_["units"] + space + w["units"]
        longer = line(F.concat(open_["text"], F.lit(" "), w["text"]), wider)
        first, fits = open_.isNull(), wider <= most
        return F.struct(
            F.when(first | fits, lines).otherwise(F.concat(lines, F.array(open_))).alias("lines"),
            F.when(~first & fits, longer).otherwise(line(w["text"], w["units"])).alias("open"),
        )

    begin = F.struct(none.alias("lines"), F.lit(None).cast("struct<text:string,units:int>").alias("open"))
    empty = F.array(line(F.lit(""), F.lit(0)))
    return F.aggregate(words, begin, step, lambda acc: F.when(acc["open"].isNull(), empty).otherwise(F.concat(acc["lines"], F.array(acc["open"]))))


def wrap_lines(text: Column, font: Font, size: Column, width: Column) -> Column:
    """Lines of ``text`` at a font size, each as many words as fit ``width`` pixels."""
    most = F.floor(width * 1000 / size).cast("int")
    return F.transform(_wrap(_measured(text, font), most, font.advances.get(" ", font.other)), lambda line: line["text"])


def headline_zone(width: Column, height: Column, side: Column, subject_x: Column, subject_width: Column) -> Column:
    """(left, width, top, height) of the headline's zone beside the subject, whose place may be null."""
    room = F.coalesce(subject_x - MARGIN, F.floor(width * RIGHT_SHARE).cast("int") - MARGIN)
    right_end = F.greatest(F.least(F.lit(SAFE_X), width - MARGIN, room), F.lit(MARGIN + 1))
    left = F.greatest(F.lit(MARGIN), F.coalesce(subject_x + subject_width + MARGIN, F.floor(width * LEFT_SHARE).cast("int")))
    left_end = F.greatest(F.least(F.lit(SAFE_X), width) - MARGIN, left + 1)
    at_right = side == "right"
    begin, end = F.when(at_right, MARGIN).otherwise(left), F.when(at_right, right_end).otherwise(left_end)
    top = F.floor(height * TOP).cast("int")
    tall = F.greatest(F.floor(height * BOTTOM).cast("int") - top, F.lit(1))
    return F.struct(begin.alias("left"), F.greatest(end - begin, F.lit(1)).alias("width"), top.alias("top"), tall.alias("height"))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value made once for a row, however often it is used (the expressions in a fold's step are made anew at every step)."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _count_lines(units: Column, most: Column, space: int) -> Column:
    """How many lines ``_wrap`` makes of words of these ``units``. The state has the lines in its upper half, the width of the open one in its lower half."""
    half = 1 << 32
    open_ = lambda s: s.bitwiseAND(F.lit(half - 1))
    step = lambda s, w: F.when(open_(s) + w + space <= most, s + w + space).otherwise((F.shiftright(s, 32) + 1) * half + w)
    return F.greatest(F.lit(1), F.shiftright(F.aggregate(units, F.lit(half - 1).cast("bigint"), step), 32).cast("int"))


def fit_headline(text: Column, font: Font, zone: Column, largest: Column) -> Column:
    """(size, lines): the largest size from ``largest`` down in STEPs at which the wrapped lines fit the zone, or SMALLEST.

    A size below one that fits fits, too: its lines hold more units, are no more and are no higher. So sizes are searched by halves, counting lines only; the text is measured and wrapped once.
    """
    space = font.advances.get(" ", font.other)
    given = F.struct(_measured(text, font).alias("words"), zone["width"].alias("width"), zone["height"].alias("height"), largest.alias("largest"))
    most = lambda x, size: F.floor(x["width"] * 1000 / size).cast("int")

    def fits(x: Column, size: Column) -> Column:
        high = font.line_height(size)
        spacing = F.greatest(F.lit(1), F.floor(high * SPACING).cast("int"))
        tall = lambda m: _once(_count_lines(x["units"], m, space), lambda count: high * count + spacing * (count - 1) <= x["height"])
        return F.coalesce(_once(most(x, size), lambda m: (x["widest"] <= m) & tall(m)), F.lit(False))

    def found(x: Column) -> Column:
        """The number of sizes from ``largest`` down that don't fit, one less: grown by powers of two, the largest first."""
        count = F.when(x["largest"] >= SMALLEST, F.floor((x["largest"] - SMALLEST) / STEP).cast("int") + 1).otherwise(0)
        powers = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
        size = lambda last: x["largest"] - STEP * last
        last = lambda n: F.aggregate(powers, F.lit(-1), lambda acc, by: F.when(acc + by >= n, acc).when(_once(size(acc + by), lambda s: fits(x, s)), acc).otherwise(acc + by))
        return _once(count, lambda n: _once(last(n), lambda k: F.when(k + 1 < n, size(k + 1)).otherwise(SMALLEST)))

    def made(x: Column) -> Column:
        units = F.transform(x["words"], lambda w: w["units"].cast("bigint"))
        searched = _once(F.struct(units.alias("units"), F.when(units.isNotNull(), F.coalesce(F.array_max(units), F.lit(0))).alias("widest"), x["width"].alias("width"), x["height"].alias("height"), x["largest"].alias("largest")), found)
        return _once(searched, lambda size: _once(most(x, size), lambda m: F.struct(size.cast("int").alias("size"), _wrap(x["words"], m, space).alias("lines"))))

    return _once(given, made)


def headline_boxes(fitted: Column, font: Font, zone: Column) -> Column:
    """(bbox, boxes) as left, top, right, bottom: lines centred in the zone, all moved up where they reach into the corner beyond SAFE_X and SAFE_Y."""
    size, lines = fitted["size"], fitted["lines"]
    high = font.line_height(size)
    spacing = F.greatest(F.lit(1), F.floor(high * SPACING).cast("int"))
    block = high * F.size(lines) + spacing * (F.size(lines) - 1)
    top = F.greatest(F.lit(0), zone["top"] + F.floor((zone["height"] - block) / 2).cast("int"))

    def box(line: Column, i: Column) -> Column:
        wide = F.ceil(line["units"] * size / 1000).cast("int")
        left, up = zone["left"] + F.floor((zone["width"] - wide) / 2).cast("int"), top + i * (high + spacing)
        return F.struct(left.alias("left"), up.alias("top"), (left + wide).alias("right"), (up + high).alias("bottom"))

    def moved(boxes: Column) -> Column:
        edge = lambda of, side: of(F.transform(boxes, lambda b: b[side]))
        over = (edge(F.array_max, "right") > SAFE_X) & (edge(F.array_max, "bottom") > SAFE_Y)
        up = F.when(over, edge(F.array_max, "bottom") - SAFE_Y).otherwise(0)
        return _once(up, lambda up: F.struct(
            F.struct(edge(F.array_min, "left").alias("left"), (edge(F.array_min, "top") - up).alias("top"), edge(F.array_max, "right").alias("right"), (edge(F.array_max, "bottom") - up).alias("bottom")).alias("bbox"),
            F.transform(boxes, lambda b: F.struct(b["left"].alias("left"), (b["top"] - up).alias("top"), b["right"].alias("right"), (b["bottom"] - up).alias("bottom"))).alias("boxes"),
        ))

    return _once(F.transform(lines, box), moved)


def place_subject(side: Column, subject_width: Column, subject_height: Column, width: Column, height: Column, margin: Column) -> Column:
    """(x, y) of a subject at the canvas' left or right side, standing on its lower edge."""
    at_right = F.greatest(F.lit(0), width - subject_width - margin)
    at_left = F.least(F.greatest(F.lit(0), margin), F.greatest(F.lit(0), width - subject_width))
    return F.struct(F.when(side == "right", at_right).otherwise(at_left).alias("x"), (height - subject_height).alias("y"))
