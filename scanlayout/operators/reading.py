"""Reading order, tolerances, body region, columns and page measures. Everything groups by page, whose words are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, clean_text, in_order, inside, is_vertical, let, nearest_rank, trunc, upper_median

PAGE = ["doc_id", "page_index"]
BODY = ["bx0", "by0", "bx1", "by1"]


def _centre_x() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def _tolerance(heights: Column) -> Column:
    return let(upper_median(F.filter(heights, lambda h: h > 0)), lambda m: F.when(m.isNull(), F.lit(10.0)).otherwise(clamp(m * 0.8, 3.0, 20.0)))


def _column_tolerance(centres: Column, tol: Column) -> Column:
    """Of sorted centres."""
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(centres) - 1, F.lit(1))), lambda i: F.coalesce(F.get(centres, i) - F.get(centres, i - 1), F.lit(0.0))), lambda g: g > 0)
    wide = F.filter(gaps, lambda g: g >= F.greatest(tol * 1.2, F.lit(2.0)))
    pitch = lambda w: F.when(F.size(w) < 3, tol).otherwise(clamp(F.greatest(tol, upper_median(w) * 0.55), 3.0, 80.0))
    return F.when(F.size(centres) < 6, tol).otherwise(let(wide, pitch))


def _with_body(pages: DataFrame, width: float, height: float) -> DataFrame:
    """Adds bx0 to by1 to pages with words, an array of boxes."""
    h = lambda w: w["y1"] - w["y0"]
    mx, my = max(8.0, 0.05 * width), max(8.0, 0.05 * height)
    tall = in_order(F.filter(F.transform("words", h), lambda x: x > 0.5))
    middle = lambda k: F.get(F.col("tall_"), ((F.size("tall_") - k) / 2).cast("int"))
    within = lambda w: (w["x0"] > mx) & (w["x1"] < width - mx) & (w["y0"] > my) & (w["y1"] < height - my)
    pages = pages.withColumn("tall_", tall).withColumns({"med_": F.when(F.size("tall_") > 0, (middle(0) + middle(1)) / 2), "n_": F.size("words")})
    one = F.filter("words", lambda w: within(w) & (h(w) > 0.5) & (h(w) >= 0.75 * F.col("med_")) & (h(w) <= 2.2 * F.col("med_")))
    two = F.filter("words", lambda w: within(w) & (h(w) >= 0.65 * F.col("med_")))
    pages = pages.withColumn("one_", one).withColumn("use_", F.when(F.size("one_") < F.greatest(F.lit(12), trunc(F.col("n_") * 0.06)), two).otherwise(F.col("one_")))
    enough = (F.size("use_") >= F.greatest(F.lit(10), trunc(F.col("n_") * 0.04))) & F.col("med_").isNotNull()
    pad = F.greatest(F.lit(6.0), F.col("med_") * 0.4)
    edge = lambda c, p: nearest_rank(F.transform("use_", lambda b: b[c]), p)
    pages = pages.withColumns(
        {"bx0": F.greatest(F.lit(0.0), edge("x0", 0.05) - pad), "by0": F.greatest(F.lit(0.0), edge("y0", 0.05) - pad), "bx1": F.least(F.lit(width), edge("x1", 0.95) + pad), "by1": F.least(F.lit(height), edge("y1", 0.95) + pad), "ok_": enough}
    )
    sure = F.col("ok_") & (F.col("bx1") - F.col("bx0") >= 0.2 * width) & (F.col("by1") - F.col("by0") >= 0.2 * height)
    return pages.withColumn("sure_", sure).withColumns({c: F.when(F.col("sure_"), F.col(c)) for c in BODY}).drop("tall_", "med_", "n_", "one_", "use_", "ok_", "sure_")


def reading_tolerance(tokens: DataFrame) -> DataFrame:
    """tol: 0.8 of the upper median height, from 3 to 20; 10 where no word has a height."""
    return tokens.groupBy(*PAGE).agg(_tolerance(F.collect_list(F.col("y1") - F.col("y0"))).alias("tol"))


def column_tolerance(tokens: DataFrame, tol: DataFrame | None = None) -> DataFrame:
    """tol_x: 0.55 of the usual gap between columns, if at least three wide gaps show one; else the reading tolerance (of the page, or given as tol)."""
    pages = tokens.groupBy(*PAGE).agg(in_order(F.collect_list(_centre_x())).alias("c"), _tolerance(F.collect_list(F.col("y1") - F.col("y0"))).alias("tol"))
    if tol is not None:
        pages = pages.drop("tol").join(tol.hint("merge"), PAGE)
    return pages.select(*PAGE, _column_tolerance(F.col("c"), F.col("tol")).alias("tol_x"))


def body_region(tokens: DataFrame, width: float, height: float) -> DataFrame:
    """bx0, by0, bx1, by1 of the main text, null where it can't be told. Trimmed box quantiles over words of a usual height inside the margins."""
    pages = tokens.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("words"))
    return _with_body(pages, width, height).select(*PAGE, *BODY)


def page_layout(tokens: DataFrame, width: float, height: float) -> DataFrame:
    """The words with their page's tol, tol_x, bx0, by0, bx1 and by1: all from one gathering of each page's words, which are few, so words shuffle once."""
    own = [c for c in tokens.columns if c not in PAGE]
    pages = tokens.groupBy(*PAGE).agg(F.collect_list(F.struct(*own)).alias("words"))
    pages = pages.withColumn("tol", _tolerance(F.transform("words", lambda w: w["y1"] - w["y0"])))
    pages = pages.withColumn("c_", in_order(F.transform("words", lambda w: (w["x0"] + w["x1"]) / 2))).withColumn("tol_x", _column_tolerance(F.col("c_"), F.col("tol"))).drop("c_")
    return _with_body(pages, width, height).select(*PAGE, "tol", "tol_x", *BODY, F.inline("words"))


def with_page_values(tokens: DataFrame, *pages: DataFrame) -> DataFrame:
    """Page values on each word."""
    for page in pages:
        tokens = tokens.join(page.hint("merge"), PAGE, "left")
    return tokens


def reading_order(tokens: DataFrame, vertical: Column) -> DataFrame:
    """ord: from 1 on each page. Rows from the top, then from the left; or, where vertical, columns from the right, then from the top. Needs tol and tol_x."""
    row, column = trunc(F.col("y0") / F.col("tol")), -trunc(_centre_x() / F.col("tol_x"))
    order = Window.partitionBy(*PAGE).orderBy(F.when(vertical, column).otherwise(row), F.when(vertical, F.col("y0")).otherwise(F.col("x0")), F.when(vertical, F.col("x0")), "seq")
    return tokens.withColumn("ord", F.row_number().over(order))


def body_priority(tokens: DataFrame, height: float) -> DataFrame:
    """zone: 0 header, 1 body, 2 other, 3 footer. Needs bx0, by0, bx1, by1."""
    cx, cy, my = _centre_x(), (F.col("y0") + F.col("y1")) / 2, max(8.0, 0.05 * height)
    zone = F.when(cy <= 1.2 * my, 0).when(cy >= height - 1.2 * my, 3).when(inside(cx, cy, "bx0", "by0", "bx1", "by1"), 1).otherwise(2)
    return tokens.withColumn("zone", zone)


def text_layer(ordered: DataFrame, separator: str = " ") -> DataFrame:
    """page_text: the page's words by zone and order, as a search in the finished page would see them."""
    words = in_order(F.collect_list(F.struct("zone", "ord", "text")))
    return ordered.groupBy(*PAGE).agg(F.array_join(F.transform(words, lambda w: w["text"]), separator).alias("page_text"))


def _column(rows: DataFrame) -> DataFrame:
    return rows.withColumn("col_id", F.when(F.col("tol_x") > 1e-6, trunc(_centre_x() / F.col("tol_x")).cast("int")))


def column_anchors(tokens: DataFrame) -> DataFrame:
    """x0_med, cx_med of each column (col_id) inside the body. Needs tol_x and the body box."""
    cx, cy = _centre_x(), (F.col("y0") + F.col("y1")) / 2
    rows = _column(tokens).where(F.col("col_id").isNotNull() & inside(cx, cy, *BODY)).withColumn("cx", cx)
    return rows.groupBy(*PAGE, "col_id").agg(F.median("x0").alias("x0_med"), F.median("cx").alias("cx_med"))


def snap_to_column(tokens: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """x0_snapped: the column's x0 where the word lies in the body and within 0.75 of the tolerance of it. Anchors are those given, else the page's own, which need no join."""
    within = inside(_centre_x(), (F.col("y0") + F.col("y1")) / 2, *BODY)
    rows = _column(tokens)
    if anchors is None:
        column = F.median(F.when(within, F.col("x0"))).over(Window.partitionBy(*PAGE, "col_id"))
        rows = rows.withColumn("x0_med", F.when(F.col("col_id").isNotNull(), column))
    else:
        rows = rows.join(anchors.hint("merge"), [*PAGE, "col_id"], "left").drop("cx_med")
    near = within & (F.abs(F.col("x0") - F.col("x0_med")) <= F.col("tol_x") * 0.75)
    return rows.withColumn("x0_snapped", F.when(near, F.col("x0_med")).otherwise(F.col("x0"))).drop("col_id", "x0_med")


_METRICS = ["v_pitch", "v_colw", "h_height", "v_samples", "h_samples"]


def _metric_values(tokens: DataFrame, sx: float, sy: float) -> DataFrame:
    """Adds what each word gives to its page's metrics, so that texts are cleaned once and not for each measure."""
    w, h, n = (F.col("x1") - F.col("x0")) * sx, (F.col("y1") - F.col("y0")) * sy, F.col("_n")
    rows = tokens.withColumns({"_n": F.char_length(clean_text(F.col("text"))), "_v": is_vertical(F.col("angle"))})
    up, flat = (n > 0) & F.col("_v"), (n > 0) & ~F.col("_v")
    return rows.withColumns({"_pitch": F.when(up & (h > 0), h / n), "_colw": F.when(up & (w > 0), w), "_height": F.when(flat & (h > 0), h), "_up_one": up, "_flat_one": flat}).drop("_n", "_v")


_VALUES = ["_pitch", "_colw", "_height", "_up_one", "_flat_one"]


def _metrics() -> dict[str, Column]:
    """Aggregates over the values of a page's words."""
    return {"v_pitch": F.median("_pitch"), "v_colw": F.median("_colw"), "h_height": F.median("_height"), "v_samples": F.count_if("_up_one"), "h_samples": F.count_if("_flat_one")}


def _finished(rows: DataFrame) -> DataFrame:
    rows = rows.fillna(0.0, ["v_pitch", "v_colw", "h_height"])
    both = F.when((F.col("v_pitch") > 0) & (F.col("v_colw") > 0), F.least("v_pitch", "v_colw")).otherwise(F.greatest("v_pitch", "v_colw"))
    return rows.withColumn("v_fs", both * 0.9)


def page_metrics(tokens: DataFrame, sx: float, sy: float) -> DataFrame:
    """Medians of vertical pitch, column width, font size and horizontal height, 0 without samples; pages with some text. Needs angle."""
    out = _metric_values(tokens, sx, sy).groupBy(*PAGE).agg(*[c.alias(n) for n, c in _metrics().items()]).where("v_samples + h_samples > 0")
    return _finished(out).select(*PAGE, *_METRICS, "v_fs")


def with_page_metrics(tokens: DataFrame, sx: float, sy: float) -> DataFrame:
    """The words with their page's metrics, by a window over the page."""
    page = Window.partitionBy(*PAGE)
    return _finished(_metric_values(tokens, sx, sy).withColumns({n: c.over(page) for n, c in _metrics().items()}).drop(*_VALUES))


def dominant_direction(tokens: DataFrame) -> DataFrame:
    """vertical where over 0.4 of the angles are."""
    share = F.avg(is_vertical(F.col("angle")).cast("int"))
    return tokens.groupBy(*PAGE).agg(F.when(share > 0.4, "vertical").otherwise("horizontal").alias("direction"))


def coord_scale(tokens: DataFrame, width: Column, height: Column) -> DataFrame:
    """tx, ty: what brings the 95th percentile of right and lower edges to the page, 1 where it fits or is out of reason. Percentiles, sides and bounds count to six places and factors to nine, so that no last bit decides at a bound."""

    def factor(edge: str, side: Column) -> Column:
        p = F.round(F.percentile(F.when(F.col(edge) > 0, F.col(edge)), 0.95), 6)
        f = F.when(p.isNull() | (p <= 0) | p.between(F.round(side * 0.85, 6), F.round(side * 1.15, 6)), F.lit(1.0)).otherwise(F.round(side / p, 9))
        return F.when((f < 0.2) | (f > 5) | (F.abs(f - 1) < 0.02), F.lit(1.0)).otherwise(f)

    return tokens.withColumns({"pw": F.round(width, 6), "ph": F.round(height, 6)}).groupBy(*PAGE).agg(factor("x1", F.first("pw")).alias("tx"), factor("y1", F.first("ph")).alias("ty"))


def _starts(ys: Column, med: Column) -> Column:
    """Of sorted centres."""
    start = F.struct(F.get(ys, F.lit(0)).alias("c"), F.slice(ys, 1, 1).alias("starts"))

    def step(s: Column, y: Column) -> Column:
        near = F.abs(y - s["c"]) <= med * 0.55
        return F.struct(F.when(near, s["c"] * 0.8 + y * 0.2).otherwise(y).alias("c"), F.when(near, s["starts"]).otherwise(F.concat(s["starts"], F.array(y))).alias("starts"))

    return F.aggregate(F.slice(ys, F.lit(2), F.size(ys)), start, step)["starts"]


def _with_height(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("med_h", F.median(F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))).over(Window.partitionBy(*PAGE)))


def line_starts(tokens: DataFrame) -> DataFrame:
    """med_h, and starts: where lines begin, for each rotation. Centres in order form a line while each is within 0.55 med_h of a centre that moves with them."""
    rows = _with_height(tokens).groupBy(*PAGE, "rot").agg(F.first("med_h").alias("med_h"), in_order(F.collect_list((F.col("y0") + F.col("y1")) / 2)).alias("ys"))
    return rows.select(*PAGE, "rot", "med_h", _starts(F.col("ys"), F.col("med_h")).alias("starts"))


def assign_line(tokens: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """med_h, line_no: how many lines of the rotation start at the word's centre or above it. Starts are those given, else the page's own, which need no join."""
    if starts is None:
        own = [c for c in tokens.columns if c not in [*PAGE, "rot"]]
        rows = _with_height(tokens).groupBy(*PAGE, "rot").agg(F.first("med_h").alias("med_h"), F.collect_list(F.struct(*own)).alias("words"))
        rows = rows.withColumn("ys", in_order(F.transform("words", lambda w: (w["y0"] + w["y1"]) / 2))).withColumn("starts", _starts(F.col("ys"), F.col("med_h")))
        rows = rows.select(*PAGE, "rot", "med_h", "starts", F.inline("words"))
    else:
        rows = tokens.join(starts.hint("merge"), [*PAGE, "rot"])
    y = (F.col("y0") + F.col("y1")) / 2
    return rows.withColumn("line_no", F.size(F.filter("starts", lambda s: s <= y))).drop("starts")


def line_gaps(lined: DataFrame) -> DataFrame:
    """pos, gap: the word's place in its line, and its distance from the word before (null for the first)."""
    flat = F.col("rot").isin(0, 180)
    order = Window.partitionBy(*PAGE, "rot", "line_no").orderBy(F.when(flat, F.col("x0")).otherwise(F.col("y0")), F.col("y0") + F.col("y1"), "seq")
    gap = F.when(flat, F.col("x0") - F.lag("x1").over(order)).otherwise(F.col("y0") - F.lag("y1").over(order))
    return lined.withColumns({"pos": F.row_number().over(order), "gap": gap})


def build_lines(tokens: DataFrame) -> DataFrame:
    """Lines: rotate, line_no, rank (by rotation, top, left and number), text (a blank where the gap is over 0.45 med_h), box, fontsize and baseline. Needs rot."""
    rows = line_gaps(assign_line(tokens))
    piece = F.concat(F.when(F.col("gap") > F.col("med_h") * 0.45, " ").otherwise(""), F.col("text"))
    text = F.array_join(F.transform(in_order(F.collect_list(F.struct("pos", piece.alias("t")))), lambda x: x["t"]), "")
    out = rows.groupBy(*PAGE, F.col("rot").alias("rotate"), "line_no").agg(text.alias("text"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")], F.greatest(F.lit(4.0), F.median(F.col("y1") - F.col("y0")) * 0.9).alias("fontsize"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("rotate", "y0", "x0", "line_no")))
    return out.withColumns({"base_x": F.col("x0"), "base_y": F.col("y1") - (F.col("y1") - F.col("y0")) * 0.15})


def column_gaps(tokens: DataFrame) -> DataFrame:
    """gap: how far the centre of each word is from that of the next one to its right on the page (null for the rightmost)."""
    order = Window.partitionBy(*PAGE).orderBy(F.desc(_centre_x()), "seq")
    return tokens.withColumn("gap", F.lag(_centre_x()).over(order) - _centre_x())
