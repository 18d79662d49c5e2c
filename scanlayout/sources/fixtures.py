"""Page tables derived from the given tables by the formulas of FIXTURES.md, as Spark jobs that grow with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_index"]
PAGE_W, PAGE_H = 640.0, 840.0
#: Parts of pages for each part of documents that is read; words on a page.
SPREAD = 16
PAGE_WORDS = 240


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_texts(documents: DataFrame) -> DataFrame:
    """doc_id, page_index, line: documents' words by 240, joined by blanks, and dealt by page while they are texts. So what is grouped by page or made a window needs no exchange of single words. A part is about a sixteenth of what a task reads, so its words can be sorted in memory."""
    listed = documents.select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("ws")).where("size(ws) > 0")
    cut = F.expr(f"transform(sequence(0, CAST((size(ws) - 1) div {PAGE_WORDS} AS INT)), i -> struct(i AS page_index, array_join(slice(ws, i * {PAGE_WORDS} + 1, {PAGE_WORDS}), ' ') AS line))")
    return listed.select("doc_id", F.inline(cut)).repartition(page_parts(documents), *PAGE)


def page_parts(documents: DataFrame) -> int:
    """Into how many parts pages are dealt."""
    return SPREAD * documents.rdd.getNumPartitions()


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, seq, text, x0, y0, x1, y1: words of documents on pages of 240; odd documents are written vertically."""
    words = page_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*PAGE, F.posexplode(F.split("line", " ")).alias("seq", "text"))
    words = words.selectExpr(*PAGE, "seq", "text", f"CAST(page_index AS BIGINT) * {PAGE_WORDS} + seq AS w", "CAST(seq AS BIGINT) AS p", "doc_id % 2 AS v", "least(length(text), 10) AS n")
    placed = words.selectExpr(
        "doc_id", "page_index", "seq", "text",
        "CAST(IF(v = 0, 60 + (p % 12) * 44 + (w * 7) % 5, 560 - (p div 20) * 42 + (w * 7) % 5) AS DOUBLE) AS x0", "CAST(IF(v = 0, 70 + (p div 12) * 36 + (w * 13 + doc_id) % 7, 70 + (p % 20) * 36 + (w * 13 + doc_id) % 7) AS DOUBLE) AS y0",
        "CAST(IF(v = 0, 4 * n, 16 + (w % 3) * 2) AS DOUBLE) AS w", "CAST(IF(v = 0, 16 + (w % 3) * 2, 3 * n) AS DOUBLE) AS h",
    )
    return placed.selectExpr(*PAGE, "seq", "text", "x0", "y0", "x0 + w AS x1", "y0 + h AS y1")


def quads(words: DataFrame) -> DataFrame:
    """Adds points, the four corners of a slightly sheared box."""
    k = "(((doc_id % 7) - 3) * 0.02D * (x1 - x0))"
    flat, upright = f"array(array(x0, y0), array(x1, y0 + {k}), array(x1, y1 + {k}), array(x0, y1))", f"array(array(x1, y0), array(x1 + {k}, y1), array(x0 + {k}, y1), array(x0, y0))"
    return words.withColumn("points", F.expr(f"IF(doc_id % 2 = 0, {flat}, {upright})"))


def margin_tokens(words: DataFrame) -> DataFrame:
    """Moves some words to head and foot of the page and halves the height of some."""
    h = "(y1 - y0) * IF(seq % 31 = 0, 0.5D, 1D)"
    return words.withColumn("top", F.expr("CASE seq % 40 WHEN 0 THEN 12D WHEN 1 THEN 815D ELSE y0 END")).withColumn("h", F.expr(h)).drop("y0", "y1").withColumnRenamed("top", "y0").withColumn("y1", F.col("y0") + F.col("h")).drop("h")


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per lineitem."""
    order = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id", f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) - 1 AS INT) AS page_index", "CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS total_pages",
        "CAST(800 + (l_partkey % 50) * 8 AS INT) AS w_px", "CAST(1100 + (l_suppkey % 50) * 8 AS INT) AS h_px", "l_partkey % 10 <> 0 AS ocr_ready", "CAST(l_quantity AS INT) AS ocr_words", "l_discount * 10 AS ink_ratio",
        "IF(l_suppkey % 17 = 0, 'E', '') AS err", "l_partkey AS part", "l_suppkey AS supp",
    )


def attempts(words: DataFrame, stages: tuple[int, ...]) -> DataFrame:
    """One drawing attempt per word and stage: doc_id, page_index, seq, stage, ok, method."""
    tried = words.select(*PAGE, "seq", F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    return tried.selectExpr(*PAGE, "seq", "stage", "(doc_id * 7 + seq * 13 + stage) % IF(doc_id % 2 = 0, 41, 7) <> 0 AS ok", "element_at(array('embedded', 'fontfile', 'builtin', 'helv'), seq % 4 + 1) AS method")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, pixels: 8 by 8 grey pixels from embeddings."""
    return table(spark, sf_dir, "embeddings").selectExpr("CAST(label AS BIGINT) AS doc_id", "vec_id AS page_index", "transform(embedding, e -> CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5D) * 255))) AS INT)) AS pixels")


def luma_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select(*PAGE, F.explode("pixels").alias("bin")).groupBy(*PAGE, "bin").agg(F.count("*").alias("n"))


def chroma_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.expr("transform(sequence(0, size(pixels) div 2 - 1), i -> struct(pixels[2 * i] div 32 AS a, pixels[2 * i + 1] div 32 AS b))")
    return rasters(spark, sf_dir).select(*PAGE, F.explode(pairs).alias("p")).groupBy(*PAGE, F.col("p.a").cast("int").alias("a"), F.col("p.b").cast("int").alias("b")).agg(F.count("*").alias("n"))


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, kind, event_id, ts: metadata and OCR results as they arrive."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "CASE WHEN event_type IN ('view', 'signup') THEN 'meta' WHEN event_type = 'error' THEN 'ocr_error' ELSE 'ocr' END AS kind", "event_id", "CAST(ts AS TIMESTAMP) AS ts")
    side = Window.partitionBy("doc_id", F.col("kind") == "meta").orderBy("ts", "event_id")
    return rows.withColumn("page_index", (F.row_number().over(side) - 1).cast("int"))
