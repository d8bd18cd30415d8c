"""Scalar expressions on text: names of frames, resolutions, notes, and key=value lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as text tools split them.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
BLANKS = " \t\n\r\x0b\x0c"


def frame_name(index: Column) -> Column:
    """frame_0007.jpg; four digits at least, more where the number has more."""
    return F.format_string("frame_%04d.jpg", index)


def frame_number(name: Column) -> Column:
    """The number in a frame's name, null for other names; order by this, not by the name."""
    return F.regexp_extract(name, r"^frame_([0-9]+)\.jpg$", 1).try_cast("long")


def is_frame_name(name: Column) -> Column:
    """Whether a name is frame_ and anything and .jpg."""
    return F.coalesce(name.like(r"frame\_%.jpg"), F.lit(False))


def resolution(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def time_offset(offset: Column, fps: float) -> Column:
    """Seconds to four digits, halves to even."""
    return F.bround(offset / F.lit(float(fps)), 4)


def note(offset: Column, reference: str) -> Column:
    aligned = F.concat(F.lit(f"Aligned to {reference} (reference); offset +"), offset.cast("string"), F.lit(" frames"))
    return F.when(offset == 0, F.lit("Reference view")).otherwise(aligned)


def lines(text: Column) -> Column:
    """The lines of a text without blanks around the whole; null and empty texts are one empty line."""
    stripped = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.split(stripped, LINE_END, -1)


def value_of(text_lines: Column, key: str) -> Column:
    """What follows the first = of the last line with this key; empty where the key or the = is missing."""
    own = F.filter(text_lines, lambda x: (x == F.lit(key)) | x.startswith(F.lit(f"{key}=")))
    line = F.try_element_at(own, F.lit(-1))
    return F.coalesce(F.substring(line, len(key) + 2, 1 << 30), F.lit(""))
