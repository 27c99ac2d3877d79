"""Text expressions: white space, scrubbing, trimming, Unicode-safe slices. Offsets count code points from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space after scrubbing, as a regex class that means the same in Java and RE2. Fixed values.
WS = r"\t\n\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Invisible code points, each replaced by one space. Fixed values; surrogates can't occur in UTF-8.
INVISIBLE = [
    ("0000", "0008"), ("000B", "000C"), ("000E", "001F"), ("007F", "009F"), ("00AD", "00AD"), ("034F", "034F"), ("061C", "061C"), ("115F", "1160"),
    ("17B4", "17B5"), ("180E", "180E"), ("200B", "200F"), ("202A", "202E"), ("2060", "2064"), ("2066", "206F"), ("2800", "2800"), ("3164", "3164"),
    ("FE00", "FE0F"), ("FEFF", "FEFF"), ("FFA0", "FFA0"), ("FFF9", "FFFB"), ("E0000", "E007F"), ("E0100", "E01EF"),
]
INVISIBLE_CLASS = "[" + "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in INVISIBLE) + "]"


def scrub(text: Column) -> Column:
    """Invisible characters become spaces; the length, and with it every offset, stays."""
    return F.regexp_replace(text, INVISIBLE_CLASS, " ")


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def trim_left(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+", "")


def trim_right(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+$", "")


def trimmed_span(text: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    """(surface, start, end) without white space at either end."""
    raw = cut(text, start, end)
    left = trim_left(raw)
    surface = trim_right(left)
    begin = start + F.length(raw) - F.length(left)
    return surface, begin, begin + F.length(surface)


def synthetic(sentences: list[str], lengths: list[int], least: Column, most: Column) -> Column:
    """sentences over and over, joined by spaces, until there are at least least tokens; then without the last ones while there are more
    than most, though never without all. lengths: the tokens of each sentence."""
    m, total = len(sentences), sum(lengths)
    sums = F.array(*(F.lit(sum(lengths[: i + 1])) for i in range(m)))
    fewer = lambda c, strict: F.size(F.filter(sums, lambda x: x < c if strict else x <= c))
    rounds = F.floor((least - 1) / F.lit(total))
    need = F.when(least <= 0, 0).otherwise(rounds * m + fewer(least - rounds * total, True) + 1)
    room = F.floor(most / F.lit(total))
    fit = F.greatest(F.lit(1), room * m + fewer(most - room * total, False))
    k = F.least(need, F.coalesce(fit, need)).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.element_at(F.array(*map(F.lit, sentences)), F.pmod(i - 1, F.lit(m)) + 1))
    return F.when(k > 0, F.array_join(parts, " ")).otherwise("")
