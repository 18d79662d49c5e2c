"""Skew of pages from line segments and row profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_order

PAGE = ["doc_id", "page_index"]


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """wmedian: the lowest value whose cumulative weight is half of all or more. Weights of 0 and less don't count."""
    rows = rows.where(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    by = Window.partitionBy(*keys)
    acc = F.sum("_w").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"_a": acc, "_t": F.sum("_w").over(by)}).where(F.col("_a") >= F.col("_t") * 0.5).groupBy(*keys).agg(F.min(value).alias("wmedian"))


def weighted_mad(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """wmedian, and mad: the weighted median of distances from it."""
    med = weighted_median(rows, keys, value, weight)
    away = rows.join(med.hint("merge"), keys).withColumn("_d", F.abs(F.col(value) - F.col("wmedian")))
    return med.join(weighted_median(away, keys, "_d", weight).withColumnRenamed("wmedian", "mad").hint("merge"), keys)


@dataclass(frozen=True)
class SkewOptions:
    """The gates of skew_consensus; the defaults are those of whole pages, words need lower lengths."""

    tol: float = 12.0
    min_len_share: float = 0.16
    min_len: float = 60.0
    lines: int = 10
    first: int = 3000
    count: int = 12
    sum_len: float = 2800.0
    mad: float = 0.55
    small: float = 0.3


#: The gates for what is left of a skew after a page was turned.
STRICT = SkewOptions(tol=10.0, first=2500, sum_len=0.0, mad=0.45, small=0.25)


def segments_from_tokens(tokens: DataFrame) -> DataFrame:
    """seg_no, x1, y1, x2, y2, len: the top edge of each word."""
    p = F.col("points")
    out = tokens.select(*PAGE, F.col("seq").alias("seg_no"), p[0][0].alias("x1"), p[0][1].alias("y1"), p[1][0].alias("x2"), p[1][1].alias("y2"))
    return out.withColumn("len", F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)))


def skew_samples(segments: DataFrame, o: SkewOptions) -> DataFrame:
    """axis, a, len: the angle to an axis of segments near one; axis is null for all others. Needs min_side."""
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy("seg_no"))
    long = F.col("len") >= F.greatest(F.lit(o.min_len), (F.col("min_side") * o.min_len_share).cast("int"))
    raw = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    angle = F.when(raw > 90, raw - 180).when(raw < -90, raw + 180).otherwise(raw)
    rows = segments.withColumn("k", first).withColumn("use", (F.col("k") <= o.first) & long).withColumn("ang", F.round(angle, 9))
    flat, up = F.col("use") & (F.abs("ang") <= o.tol), F.col("use") & (F.abs(F.abs("ang") - 90) <= o.tol)
    rows = rows.withColumns({"axis": F.when(flat, "h").when(up, "v"), "a": F.when(flat, F.col("ang")).otherwise(F.when(F.col("ang") > 0, F.col("ang") - 90).otherwise(F.col("ang") + 90))})
    return rows.select(*PAGE, "axis", F.round("a", 9).alias("a"), "len")


def _array_median(samples: Column) -> Column:
    """The weighted median of an array of (v, w): the lowest v whose cumulative weight is half of all or more; null if it is empty."""
    ordered = in_order(samples)
    half = F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x["w"]) * 0.5
    start = F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast("double").alias("v"), half.alias("half"))
    step = lambda s, x: F.struct((s["acc"] + x["w"]).alias("acc"), F.when(s["v"].isNull() & (s["acc"] + x["w"] >= s["half"]), x["v"]).otherwise(s["v"]).alias("v"), s["half"].alias("half"))
    return F.aggregate(ordered, start, step)["v"]


def skew_consensus(segments: DataFrame, o: SkewOptions = SkewOptions()) -> DataFrame:
    """angle to turn by, ok, tag, mad, n and sumlen of each page: the weighted median of the axis with more length that is sure enough. A page's samples are gathered once."""
    rows = skew_samples(segments, o).where("axis IS NULL OR len > 0")
    gather = lambda axis: F.collect_list(F.when(F.col("axis") == axis, F.struct(F.col("a").alias("v"), F.col("len").alias("w")))).alias(axis)
    pages = rows.groupBy(*PAGE).agg(F.count("*").alias("all"), gather("h"), gather("v"))
    for x in "hv":
        pages = pages.withColumn(f"med_{x}", _array_median(F.col(x)))
        med = F.col(f"med_{x}")
        away = F.transform(x, lambda s: F.struct(F.abs(s["v"] - med).alias("v"), s["w"].alias("w")))
        pages = pages.withColumns({f"mad_{x}": _array_median(away), f"n_{x}": F.size(x).cast("long"), f"sum_{x}": F.aggregate(in_order(x), F.lit(0.0), lambda s, v: s + v["w"])})
    one = lambda x: F.struct(F.col(f"sum_{x}").alias("sumlen"), F.lit(x == "h").alias("flat"), F.col(f"med_{x}").alias("wmedian"), F.col(f"mad_{x}").alias("mad"), F.col(f"n_{x}").alias("n"))
    sure = F.filter(F.array(one("h"), one("v")), lambda s: (s["n"] >= o.count) & (s["sumlen"] >= o.sum_len) & (s["mad"] <= o.mad))
    pages = pages.withColumn("b", F.array_max(sure))
    apply = -F.col("b.wmedian")
    tag = F.when(F.col("all") < o.lines, "hough-none").when(F.col("b").isNull(), "hough-lowconf").when(F.abs(apply) < o.small, "hough-small").otherwise("hough")
    rows = pages.withColumn("tag", tag).withColumn("ok", F.col("tag") == "hough")
    known = F.col("tag").isin("hough", "hough-small")
    return rows.select(*PAGE, F.when(F.col("ok"), apply).otherwise(F.lit(0.0)).alias("angle"), "ok", "tag", *[F.when(known, F.col(f"b.{c}")).alias(c) for c in ("mad", "n", "sumlen")])


def _least_rectangle(points: np.ndarray) -> float:
    """The angle in degrees, from -45 (not included) to 45, of the sides of the rectangle of least area about the points: one side lies along an edge of their convex hull. Of equal areas the smallest turn counts, then the positive one."""
    points = np.unique(points, axis=0)
    hull: list[np.ndarray] = []
    for line in (points, points[::-1]):  # lower, then upper chain
        chain: list[np.ndarray] = []
        for p in line:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        hull += chain[:-1]
    if len(hull) < 2:
        return 0.0
    corners = np.array(hull)
    edges = np.roll(corners, -1, axis=0) - corners
    along = edges / np.hypot(edges[:, 0], edges[:, 1])[:, None]
    spread = [np.ptp(corners @ d.T, axis=0) for d in (along, np.stack([-along[:, 1], along[:, 0]], axis=1))]
    turn = np.round(np.degrees(np.arctan2(along[:, 1], along[:, 0])), 9) % 90
    turn = np.where(turn > 45, turn - 90, turn)
    return float(turn[np.lexsort((-turn, np.abs(turn), np.round(spread[0] * spread[1], 6)))[0]])


def _median_of(values: np.ndarray, weights: np.ndarray) -> float | None:
    """The lowest value whose cumulative weight is half of all or more, as `_array_median` has it; None without values."""
    if not len(values):
        return None
    order = np.lexsort((weights, values))
    total = np.cumsum(weights[order])
    k = int(np.argmax(total >= total[-1] * 0.5))
    return float(values[order[k]])


def _consensus(lines: np.ndarray, min_side: float, o: SkewOptions) -> tuple[float, str, float | None, int | None, float | None]:
    """angle, tag, mad, n and sumlen of one page, as skew_consensus has them, from its segments in order (x1, y1, x2, y2)."""
    dx, dy = lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1]
    length, raw = np.sqrt(dx * dx + dy * dy), np.degrees(np.arctan2(dy, dx))
    raw = np.where(raw > 90, raw - 180, np.where(raw < -90, raw + 180, raw))
    angle = np.round(raw, 9)
    use = (np.arange(len(lines)) < o.first) & (length >= max(o.min_len, int(min_side * o.min_len_share)))
    flat = use & (np.abs(angle) <= o.tol)
    up = use & ~flat & (np.abs(np.abs(angle) - 90) <= o.tol)
    best, every = None, int((~(flat | up) | (length > 0)).sum())
    for is_flat, some in ((True, flat), (False, up)):
        some = some & (length > 0)
        v, w = angle[some], length[some]
        v = np.round(v if is_flat else np.where(v > 0, v - 90, v + 90), 9)
        order = np.lexsort((w, v))
        total = float(np.cumsum(w[order])[-1]) if len(w) else 0.0
        med = _median_of(v, w)
        mad = _median_of(np.abs(v - med), w) if len(v) else None
        if mad is not None and len(v) >= o.count and total >= o.sum_len and mad <= o.mad:
            one = (total, is_flat, med, mad, len(v))
            best = one if best is None else max(best, one)
    if every < o.lines:
        return 0.0, "hough-none", None, None, None
    if best is None:
        return 0.0, "hough-lowconf", None, None, None
    total, _, med, mad, n = best
    return (0.0, "hough-small", mad, n, total) if abs(med) < o.small else (-med, "hough", mad, n, total)


def residual_skew(tokens: DataFrame, min_side: Column, o: SkewOptions = STRICT, most: float = 3.0, straight: float = 0.35, least_corners: int = 500) -> DataFrame:
    """angle, ok, method, mad, n, sumlen of what is left of each page's skew, in two steps.

    The consensus of segments under strict gates decides first: `hough`, turned by `most` degrees at the most; `hough-straight` ends it too. Pages
    without consensus, and these only, are told by the least rectangle about their words' corners: `minarearect`, unless there are
    few corners (-few), the turn is small (-straight), or more than `most`, which is refused (-too-big). Needs points. A page's words are few: they
    are gathered once, and both steps work on them.
    """
    keys = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in PAGE)
    corners = F.struct(F.col("seq"), min_side.cast("double").alias("side"), F.size("points").alias("size"), F.flatten("points").alias("xy"))
    pages = tokens.groupBy(*PAGE).agg(F.collect_list(corners).alias("words"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words in batch.column("words"):
                rows = words.values
                seq, side, xy = rows.field("seq").to_numpy(zero_copy_only=False), rows.field("side").to_numpy(zero_copy_only=False), rows.field("xy")
                points = xy.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
                sizes = rows.field("size").to_numpy(zero_copy_only=False)
                first = np.cumsum(sizes) - sizes
                order = np.argsort(seq, kind="stable")
                at = first[order]
                angle, tag, mad, n, total = _consensus(np.concatenate([points[at], points[at + 1]], axis=1), float(np.nan_to_num(side[0])), o)
                if tag in ("hough", "hough-small"):
                    method = "hough" if tag == "hough" else "hough-straight"
                    out.append((min(most, max(-most, angle)) + 0.0 if tag == "hough" else 0.0, tag == "hough", method, mad, n, total))
                    continue
                points = points[np.isfinite(points).all(axis=1)]
                turn, n = (_least_rectangle(points) if len(points) else 0.0), len(points)
                method = "minarearect-few" if n < least_corners else "minarearect-straight" if abs(turn) < straight else "minarearect-too-big" if abs(turn) > most else "minarearect"
                out.append((0.0 - turn if method == "minarearect" else 0.0, method == "minarearect", method, None, n, None))
            kinds = [pa.float64(), pa.bool_(), pa.string(), pa.float64(), pa.int64(), pa.float64()]
            made = [pa.array(list(v), k) for v, k in zip(zip(*out) if out else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PAGE), *made], names=[*PAGE, "angle", "ok", "method", "mad", "n", "sumlen"])

    return pages.mapInArrow(measure, keys + ", angle double, ok boolean, method string, mad double, n long, sumlen double")


def row_profile(tokens: DataFrame, angles: list[float], height: float = 8.0) -> DataFrame:
    """angle, row, mass: word widths by rows of `height` after their centres turn by each angle (degrees)."""
    rows = tokens.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "m": F.col("x1") - F.col("x0")}).withColumn("angle", F.explode(F.array(*map(F.lit, angles))))
    r = F.radians("angle")
    y = F.round(F.col("cy") * F.cos(r) - F.col("cx") * F.sin(r), 6)
    return rows.groupBy(*PAGE, "angle", F.floor(y / height).cast("int").alias("row")).agg(F.sum("m").alias("mass"))


def alignment_score(profile: DataFrame) -> DataFrame:
    """score: how much neighbouring rows differ, 0 for fewer than three. Rows without mass between others count."""
    w = Window.partitionBy(*PAGE, "angle").orderBy("row")
    before, at = F.lag("mass").over(w), F.lag("row").over(w)
    step = F.when(at.isNull(), F.lit(0.0)).when(at == F.col("row") - 1, F.abs(F.col("mass") - before)).otherwise(F.col("mass") + before)
    rows = profile.withColumn("step", step)
    return rows.groupBy(*PAGE, "angle").agg(F.when(F.max("row") - F.min("row") + 1 >= 3, F.sum("step")).otherwise(F.lit(0.0)).alias("score"))


def resolve_skew(scores: DataFrame, skew: DataFrame, most: float = 5.0) -> DataFrame:
    """angle of each page: 0, or its skew or the opposite where that aligns rows better, by two hundredths at least. scores: side (0, 1, -1) and score."""
    side = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("score"))), F.lit(0.0)).alias(f"s{s}".replace("-", "m"))
    rows = skew.join(scores.groupBy(*PAGE).agg(side(0), side(1), side(-1)).hint("merge"), PAGE, "left").fillna(0.0, ["s0", "s1", "sm1"])
    a = F.least(F.lit(most), F.greatest(F.lit(-most), F.col("angle")))
    a = F.when(F.abs(a) < 0.3, F.lit(0.0)).otherwise(a)
    rows = rows.withColumn("a", a)
    one = F.greatest("s0", "s1")
    best = F.when(F.col("sm1") > one, -F.col("a")).when(F.col("s1") > F.col("s0"), F.col("a")).otherwise(F.lit(0.0))
    top = F.greatest(one, "sm1")
    sure: Column = F.when(F.col("s0") > 1e-6, (top - F.col("s0")) / F.col("s0") >= 0.02).otherwise(top >= 5000)
    return rows.select(*PAGE, (F.when((F.col("a") != 0) & (best != 0) & sure, best).otherwise(F.lit(0.0)) + F.lit(0.0)).alias("angle"))
