"""Quality roll-ups, release order and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rate
from .prefix import matched, numbered, running

PAGE = ["doc_id", "page_index"]
#: Fixed value: text methods by rank; the first wins ties.
METHODS = ["embedded", "fontfile", "builtin", "helv"]


def quality_summary(stats: DataFrame) -> DataFrame:
    """Totals by document, and of all (doc_id null, level 1). Counts of pages with a fallback of placement or of OCR, and of pages without words that don't look blank, come with the columns they need (ocr_fallback_used; ink_ratio)."""
    sums = [F.sum(c).alias(c) for c in ("total_tokens", "attempted_inserts", "ok_inserts", "insert_errors")]
    more = []
    if "ocr_fallback_used" in stats.columns:
        more.append(F.count_if(F.col("ocr_fallback_used")).alias("ocr_fallback_pages"))
    if "ink_ratio" in stats.columns:
        more.append(F.count_if((F.col("total_tokens") == 0) & (F.col("ink_ratio") >= 0.5)).alias("suspected_nonblank_pages"))
    out = stats.rollup("doc_id").agg(F.grouping("doc_id").cast("int").alias("level"), F.count("*").alias("pages"), *sums, F.count_if(F.col("total_tokens") == 0).alias("zero_pages"), *[F.count_if(F.col("fallback_stage") == s).alias(f"stage{s}") for s in (1, 2)], F.count_if(F.col("fallback_stage") > 0).alias("fallback_pages"), *more)
    return out.withColumns({"error_rate": rate(F.col("insert_errors"), F.col("attempted_inserts")), "ok_rate": rate(F.col("ok_inserts"), F.col("attempted_inserts"))})


def method_usage(attempts: DataFrame) -> DataFrame:
    """n of each document's methods, and the one used most."""
    counts = attempts.groupBy("doc_id", "method").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
    best = counts.groupBy("doc_id").agg(F.max_by("method", F.struct("n", -rank)).alias("effective"))
    return counts.join(best.hint("merge"), "doc_id")


def warn_pages(pages: DataFrame) -> DataFrame:
    """The first ten of each document's pages, from 1, as text. Pages are ranked by sixteenths of a document first, so that no list holds more than 176."""
    part = F.pmod(F.col("page_index"), F.lit(16))
    first = F.row_number().over(Window.partitionBy("doc_id", part).orderBy("page_index"))
    some = pages.withColumn("k_", first).where("k_ <= 11")
    out = some.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("page_index") + 1)).alias("p"))
    return out.select("doc_id", F.concat(F.concat_ws(",", F.slice("p", 1, 10).cast("array<string>")), F.when(F.size("p") > 10, ",...").otherwise("")).alias("pages"))


def ocr_empty_reason(pages: DataFrame, separate: Column) -> DataFrame:
    """Why pages without words have none, and whether they don't look blank. Needs err, raw_words, valid_words, tokens and ink_ratio."""
    reason = F.when(F.length("err") > 0, "worker_error").when(~separate, "singleproc_empty").when(F.col("raw_words") <= 0, "worker_empty").when(F.col("valid_words") <= 0, "wordsdata_invalid").otherwise("wordsdata_dropped")
    return pages.where("tokens = 0").select(*PAGE, reason.alias("reason"), (F.col("ink_ratio") >= 0.5).alias("suspected_nonblank"))


def job_outcome(jobs: DataFrame) -> DataFrame:
    """outcome of each document from pages written, cancelled and keep_partial."""
    some = F.col("written") > 0
    outcome = F.when(F.col("cancelled") & ~F.col("keep_partial"), "cancelled_no_output").when(some & F.col("cancelled"), "cancelled").when(some, "done").when(F.col("cancelled"), "cancelled_no_output").otherwise("error")
    return jobs.select("doc_id", outcome.alias("outcome"))


def in_order_release(pages: DataFrame, ready: str = "ocr_ready", width: int = 256) -> DataFrame:
    """released: whether a page and all before it, from page 0 on, are there and ready. A null counts as not ready; a page that is there more than once is ready if one of its rows is; rows without a page number are never released.

    The first gap is searched by ranges of `width` page numbers: each range tells how far its ready pages reach from its start, and the document goes
    on from range to range as long as they are whole. No step holds a document's pages in one task, only a value for each range.
    """
    pages = pages.withColumn("_range", F.floor(F.col("page_index") / width))
    there = pages.where(F.coalesce(F.col(ready), F.lit(False)) & (F.col("page_index") >= 0))
    on = lambda at, first, end: F.when(first == at, end).otherwise(at)
    reach = F.aggregate(F.array_sort(F.collect_set(F.col("page_index").cast("long"))), F.col("_range") * width, lambda at, p: on(at, p, at + 1))
    ranges = there.groupBy("doc_id", "_range").agg(reach.alias("_reach"))
    parts = F.array_sort(F.collect_list(F.struct("_range", "_reach")))
    gaps = ranges.groupBy("doc_id").agg(F.aggregate(parts, F.lit(0).cast("long"), lambda at, r: on(at, r["_range"] * width, r["_reach"])).alias("_gap"))
    released = (F.col("page_index") >= 0) & (F.col("page_index") < F.col("_gap"))
    return matched(pages, gaps, ["doc_id"], "left").withColumn("released", F.coalesce(released, F.lit(False))).drop("_range", "_gap")


def progress(pages: DataFrame) -> DataFrame:
    """done: the page's number in its document, from 1; total: the document's rows. Rows of one page number stand in any order."""
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("total"))
    done = running(pages, ["doc_id"], ["page_index"], {"done": F.lit(1)}).withColumn("done", F.col("done").cast("int"))
    return matched(done, totals, ["doc_id"])


def throttle(rows: DataFrame, key: str, order: list[str], first: int = 5, nth: int = 50) -> DataFrame:
    """The first few rows of a key, then each nth."""
    return numbered(rows, key, order).where((F.col("k") <= first) | (F.col("k") % nth == 0))


def once_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def split_control(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of pages, and messages that the worker couldn't start (page -1)."""
    control = F.col("page_index") == -1
    return results.where(~control), results.where(control)
