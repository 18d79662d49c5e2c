"""Page measures, settings and metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp

PAGE = ["doc_id", "page_index"]
#: The metadata keys that are kept.
META_KEYS = ["title", "author", "subject", "keywords", "creator", "producer", "creationDate", "modDate", "trapped"]
#: Setting, default, least and greatest.
INT_SETTINGS = {
    "dpi": (100, 72, 600), "jpeg_quality": (85, 40, 100), "binarize_strength": (0, 0, 100), "text_boldness": (0, -100, 100), "esrgan_tile": (256, 0, 2048), "bg_scale_percent": (50, 10, 100), "max_output_dpi": (400, 0, 2400),
    "gray_jpeg_quality_offset": (-10, -40, 0), "ocr_workers": (1, 0, 4),
}


def read_page_meta(*tables: DataFrame) -> DataFrame:
    """Page metadata of several schema generations: columns that a table lacks are null, then embed_scale is 1 and OCR sizes 0."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    for name, kind, value in (("embed_scale", "double", 1.0), ("ocr_w_px", "int", 0), ("ocr_h_px", "int", 0)):
        merged = merged.withColumn(name, F.coalesce(F.col(name), F.lit(value)).cast(kind) if name in merged.columns else F.lit(value).cast(kind))
    return merged


def pick_page(pages: DataFrame, page_no: int) -> DataFrame:
    """One page of each document: page_no (from 1), or the nearest there is (of two, the one before)."""
    others = [c for c in pages.columns if c != "doc_id"]
    best = pages.groupBy("doc_id").agg(F.min_by(F.struct(*others), F.struct(F.abs(F.col("page_index") - (page_no - 1)), "page_index")).alias("p"))
    return best.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"p.{c}").alias(c) for c in pages.columns])


def page_scales(meta: DataFrame) -> DataFrame:
    """sx, sy (points a pixel), tok_sx, tok_sy (page pixels an OCR pixel, 0.02 to 50; 1 if unknown) and xscale (0.85 to 1.25)."""
    ratio = lambda side: F.when((F.col(f"{side}_px") > 0) & (F.col(f"ocr_{side}_px") > 0), clamp(F.col(f"{side}_px") / F.col(f"ocr_{side}_px"), 0.02, 50.0)).otherwise(F.lit(1.0))
    base = lambda side: F.when((F.col("page_mode") == "original") & (F.col(f"{side}_px") > 0), F.col(f"page_{side}_pt") / F.col(f"{side}_px")).otherwise(F.lit(1.0))
    out = meta.withColumns({"sx": base("w"), "sy": base("h"), "tok_sx": ratio("w"), "tok_sy": ratio("h")})
    return out.withColumn("xscale", F.when(F.col("sy") * F.col("tok_sy") > 0, clamp(F.col("sx") * F.col("tok_sx") / (F.col("sy") * F.col("tok_sy")), 0.85, 1.25)).otherwise(F.lit(1.0)))


def render_size(pages: DataFrame, dpi: Column) -> DataFrame:
    """zoom, and pixels of the page at a resolution (72 at least), rounded up."""
    return pages.withColumn("zoom", F.greatest(F.lit(72), dpi) / 72.0).withColumns({"out_w_px": F.ceil(F.col("page_w_pt") * F.col("zoom")), "out_h_px": F.ceil(F.col("page_h_pt") * F.col("zoom"))})


def embed_scale(pages: DataFrame, percent: Column, cap_dpi: Column) -> DataFrame:
    """scale of the background: the user's share, and less where the resolution would pass the cap by over a hundredth."""
    user = clamp(percent / 100.0, 0.1, 1.0)
    eff = F.greatest(F.col("w_px") / (F.col("page_w_pt") / 72.0), F.col("h_px") / (F.col("page_h_pt") / 72.0)) * F.col("_user")
    capped = clamp(F.col("_user") * clamp(F.col("_cap") / eff, 0.05, 1.0), 0.05, 1.0)
    use = (F.col("page_mode") == "original") & (F.col("_cap") > 0) & (F.col("page_w_pt") > 1) & (F.col("page_h_pt") > 1)
    rows = pages.withColumns({"_user": user, "_cap": cap_dpi.cast("double")})
    return rows.withColumn("scale", F.when(use, F.when(eff > F.col("_cap") * 1.01, capped).otherwise(F.col("_user"))).otherwise(F.col("_user"))).drop("_user", "_cap")


def resize_dims(pages: DataFrame, scale: Column) -> DataFrame:
    """new_w, new_h: as they are from a scale of 0.999, else cut to whole pixels, 1 at least."""
    side = lambda c: F.when(scale >= 0.999, F.col(c)).otherwise(F.greatest(F.lit(1), (F.col(c) * scale).cast("int")))
    return pages.withColumns({"new_w": side("w_px"), "new_h": side("h_px")})


def effective_quality(quality: Column, is_gray: Column, offset: Column) -> Column:
    """10 to 100; grey pages add the offset, down to 25."""
    q = clamp(quality, 10, 100)
    return F.when(is_gray, F.greatest(F.lit(25), F.least(F.lit(100), q + offset))).otherwise(q)


def image_box(pages: DataFrame, images: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 of the placed background (page_w_pt by page_h_pt if none is valid): the image of the page's xref, else the largest."""
    area = (F.col("ix1") - F.col("ix0")) * (F.col("iy1") - F.col("iy0"))
    rows = images.where("ix1 > ix0 AND iy1 > iy0").join(pages.select(*PAGE, "xref").hint("merge"), PAGE)
    rank = F.struct((F.col("image_xref") == F.col("xref")).alias("own"), area.alias("area"), -F.col("image_no"))
    best = rows.groupBy(*PAGE).agg(F.max_by(F.struct("ix0", "iy0", "ix1", "iy1"), rank).alias("b"))
    whole = {"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.col("page_w_pt"), "y1": F.col("page_h_pt")}
    return pages.join(best.hint("merge"), PAGE, "left").select(*PAGE, *[F.coalesce(F.col(f"b.i{c}"), v).alias(c) for c, v in whole.items()])


def normalize_settings(raw: DataFrame) -> DataFrame:
    """Settings of their types and within their bounds; what can't be read gets the default. The old default strength of 60 becomes 0 unless `migrated` is true."""
    out = {n: clamp(F.coalesce(F.col(n).try_cast("int"), F.lit(d)), lo, hi) for n, (d, lo, hi) in INT_SETTINGS.items() if n in raw.columns}
    if "binarize_strength" in out:
        out["binarize_strength"] = F.when((F.col("binarize_strength").try_cast("int") == 60) & ~F.coalesce(F.col("migrated"), F.lit(False)), 0).otherwise(out["binarize_strength"])
    for n, d, lo, hi in (("gray_color_ratio_percent", 0.3, 0.0, 5.0), ("gray_p99_limit", 18.0, 5.0, 80.0), ("deskew_max_deg", 5.0, 0.0, 1e9)):
        if n in raw.columns:
            out[n] = clamp(F.coalesce(F.col(n).try_cast("double"), F.lit(d)), lo, hi)
    mode = F.trim("output_page_mode")
    return raw.withColumns(out | {"output_page_mode": F.when(mode.isin("original", "pixel"), mode).otherwise("original")})


def merge_metadata(meta: Column, app: str) -> Column:
    """The allowed keys with values, and the producer with the program's name once."""
    kept = F.map_filter(meta, lambda k, v: k.isin(META_KEYS) & (v != ""))
    old = kept["producer"]
    producer = F.when(old.isNull(), app).when(old.contains(app), old).otherwise(F.trim(F.concat(old, F.lit(f" | {app}"))))
    return F.map_concat(F.map_filter(kept, lambda k, v: k != "producer"), F.map_from_arrays(F.array(F.lit("producer")), F.array(producer)))


def ready_pages(meta: DataFrame, results: DataFrame) -> DataFrame:
    """Pages whose metadata and OCR result are both there."""
    return meta.join(results.hint("merge"), PAGE)


def unmatched_pages(meta: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pages without a word."""
    return meta.join(tokens.select(*PAGE).distinct().hint("merge"), PAGE, "left_anti")
