"""OCR words from their wire form, and their coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quad_angle, quad_box, snap_rotation

WORDS = "array<struct<text:string,points:array<array<double>>>>"


def read_words(results: DataFrame, words: str = "words") -> DataFrame:
    """A row per valid word of `words` (JSON text, or an array of text and points): seq, text, points, box, angle, rot, is_v.

    Valid: text, and exactly four points of two numbers each. seq is the word's place as sent, from 0. Broken JSON gives no row.
    """
    rows = results.select(*[c for c in results.columns if c != words], F.posexplode(_words(results, words)).alias("seq", "w")).where(_valid(F.col("w")))
    return with_geometry(rows.withColumns({"text": F.col("w.text"), "points": F.col("w.points")}).drop("w"))


def count_words(results: DataFrame, words: str = "words") -> DataFrame:
    """valid and sent: how many words each row of results holds, from one reading of it and without a row per word; broken JSON: 0 and null."""
    rows = results.withColumn("_w", _words(results, words))
    return rows.withColumns({"valid": F.greatest(F.size(F.filter("_w", _valid)), F.lit(0)).cast("long"), "sent": F.when(F.col("_w").isNotNull(), F.size("_w")).cast("long")}).drop("_w", words)


def _words(results: DataFrame, words: str) -> Column:
    return F.from_json(words, WORDS) if dict(results.dtypes)[words] == "string" else F.col(words)


def _valid(w: Column) -> Column:
    numbers = F.forall(w["points"], lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    return (F.length(w["text"]) > 0) & (F.size(w["points"]) == 4) & numbers


def with_geometry(rows: DataFrame) -> DataFrame:
    """Adds box, angle, rot and is_v from points."""
    a = F.pmod(F.col("angle"), F.lit(360.0))
    rows = rows.withColumns(quad_box(F.col("points"))).withColumn("angle", quad_angle(F.col("points")))
    return rows.withColumns({"rot": snap_rotation(F.col("angle")), "is_v": a.between(45, 135) | a.between(225, 315)})


def scale_tokens(tokens: DataFrame, sx: float, sy: float) -> DataFrame:
    """Points and boxes by sx and sy; as they are where both are 1 but for 1e-6."""
    if abs(sx - 1) < 1e-6 and abs(sy - 1) < 1e-6:
        return tokens
    points = F.transform("points", lambda p: F.array(p[0] * sx, p[1] * sy))
    return tokens.withColumns({"points": points, "x0": F.col("x0") * sx, "x1": F.col("x1") * sx, "y0": F.col("y0") * sy, "y1": F.col("y1") * sy})


def px_to_pt(tokens: DataFrame) -> DataFrame:
    """x0_pt to y1_pt from the page's ox, oy, sx and sy."""
    return tokens.withColumns({f"{a}{i}_pt": F.col(f"o{a}") + F.col(f"{a}{i}") * F.col(f"s{a}") for a in "xy" for i in "01"})


def orientation(mode: str) -> Column:
    """Whether a word is set vertically: by the page's mode, the word's shape and its angle."""
    w, h, a = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.pmod(F.col("angle"), F.lit(360.0))
    if mode == "horizontal":
        return (a.between(45, 135) | a.between(225, 315)) & (h > w * 0.9)
    if mode == "vertical":
        return ~((w > h * 1.4) & ((a < 45) | (a > 315)))
    return F.lit(True)


def prefer_primary(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary words of each page that has any, the fallback's for the others; fallback_used tells which."""
    key = ["doc_id", "page_index"]
    pages = primary.select(*key).distinct()
    return primary.withColumn("fallback_used", F.lit(False)).unionByName(fallback.join(pages.hint("merge"), key, "left_anti").withColumn("fallback_used", F.lit(True)))
