"""Column functions on OCR words, boxes and settings. All are built-in expressions, so Catalyst sees through them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that vertical writing shifts; brackets and dashes that it turns.
PUNCTUATION = "、。，．,."
TURNED = "()（）[]［］{}｛｝〈〉《》「」『』〔〕【】ー―—–－〜～"
#: White space as Python's strip() sees it; byte order mark, zero width and direction marks.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
INVISIBLE = "\ufeff\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e"


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def trunc(x: Column) -> Column:
    """Toward zero."""
    return x.cast("long")


def quad_box(points: Column) -> dict[str, Column]:
    """x0, y0, x1, y1 of four points."""
    xs, ys = ([F.get(F.get(points, F.lit(i)), F.lit(k)) for i in range(4)] for k in (0, 1))
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def quad_angle(points: Column) -> Column:
    """Degrees of the top edge."""
    return F.degrees(F.atan2(points[1][1] - points[0][1], points[1][0] - points[0][0] + F.lit(1e-6)))


def turned(angle: Column) -> Column:
    """The angle from 0 to 360."""
    return F.pmod(angle, F.lit(360.0))


def snap_rotation(angle: Column) -> Column:
    """The nearest of 0, 90, 180 and 270 that is within 10 degrees, else 0."""
    a = turned(angle)
    return F.when(F.abs(a - 90) <= 10, 90).when(F.abs(a - 180) <= 10, 180).when(F.abs(a - 270) <= 10, 270).otherwise(0)


def is_vertical(angle: Column) -> Column:
    a = turned(angle)
    return a.between(45, 135) | a.between(225, 315)


def clean_text(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def strip_invisible(text: Column) -> Column:
    """Without invisible marks; then without blanks, double quotes, single quotes and blanks at the ends, in this order. Null: ''."""
    out = F.translate(F.coalesce(text, F.lit("")), INVISIBLE, "")
    for ends in (SPACE, '"', "'", SPACE):
        out = F.regexp_replace(out, f"^{ends}+|{ends}+$", "")
    return out


def char_style(char: Column) -> Column:
    """punct, rotate or '' of one character in vertical writing."""
    return F.when(F.lit(PUNCTUATION).contains(char) & (char != ""), "punct").when(F.lit(TURNED).contains(char) & (char != ""), "rotate").otherwise("")


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole isn't positive."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value, which f may use several times, is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def in_order(values: Column) -> Column:
    """The array sorted, nulls last. sort_array compares natively where array_sort evaluates an expression for each comparison, but puts nulls first, so only arrays with nulls go the slow way."""
    return let(F.sort_array(values), lambda s: F.when(F.get(s, F.lit(0)).isNull(), F.array_sort(s)).otherwise(s))


def upper_median(values: Column) -> Column:
    """Element n div 2 (from 0) of the sorted array; null if it is empty."""
    return let(in_order(values), lambda s: F.get(s, (F.size(s) / 2).cast("int")))


def nearest_rank(values: Column, p: float) -> Column:
    """Element round((n - 1) p), half to even, of the sorted array."""
    return let(in_order(values), lambda s: F.get(s, F.bround((F.size(s) - 1) * F.lit(p), 0).cast("int")))


def inside(x: Column, y: Column, *box: str) -> Column:
    """Whether the point is in the half-open box; true where there is no box (null)."""
    x0, y0, x1, y1 = map(F.col, box)
    return x0.isNull() | ((x >= x0) & (x < x1) & (y >= y0) & (y < y1))
