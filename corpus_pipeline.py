"""The corpus pipeline: each stage calls one operator, and its decisions take effect. The stages are written and read in between.

Every stage takes empty tables, nulls in any column, repeated rows, and extra columns of any names, and gives them back as they came."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlayout.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from scanlayout.llm.common import ROW_KEY, forget, saved, with_row_key, without
from scanlayout.llm.queries import tokenizer_path


def _packed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as a struct, so that no column's name clashes with one used inside, with a key for each row."""
    return with_row_key(docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole_row")))


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    return without(rows, dropped).select("whole_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, because they hold no letter, go; null texts do too. Learns from the labels that the documents bring."""
    model = language_id.fit(docs)
    told = language_id.predict(docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole_row")), model, carry=["whole_row"])
    return told.where((F.col("lang_pred") != "und") | F.col("whole_row.text").rlike(r"\p{L}")).select("whole_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays; null ids and repeated rows are rows like others."""
    rows = _packed_rows(docs)
    return _without(rows, exact_dedup.exact_dedup(rows, carry=ROW_KEY).where("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays; texts without words stay."""
    rows = _packed_rows(docs)
    return _without(rows, near_dedup.near_dedup(rows, carry=ROW_KEY).where("NOT kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    rows = _packed_rows(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(rows, decontaminate.contaminated(rows, items, carry=ROW_KEY))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(saved(packing.pieces_of(docs, tokenizer_path())))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packed),
]

#: A learned classifier, sampled signatures and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = saved(stage(spark, docs, sf_dir))
        forget(docs)  # what the stage before wrote; the input isn't ours
        docs = kept
    out = STAGES[-1][1](spark, docs, sf_dir)
    forget(docs)  # the last stage works on pieces that it wrote itself
    return out
