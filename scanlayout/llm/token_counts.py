"""Token counts: rollups kept by signed deltas, committed once per batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dedup import slices
from .tokens import token_bytes

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def words_1(text: Column) -> Column:
    """Version words-1: runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bpe_tokens(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Adds bpe: the ids that a public byte-level BPE gives each whole text (null: none)."""
    fields = [f for f in docs.schema.fields if f.name != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_bytes(tokenizer).encode
        for batch in batches:
            for part in slices(batch, 0):
                n = pa.array([len(ids) // 4 for ids in encode(part.column(0).to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], n], names=[*part.schema.names[1:], "bpe"])

    return docs.select(text, *[f.name for f in fields]).mapInArrow(count, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "bpe long"]))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by source, lang and tokenizer of changes (op, source, lang, tokenizer, tokens, old_tokens).

    insert: +1 document, +tokens; delete: -1, -tokens; revise: tokens - old_tokens, no document. Other ops count nothing, null
    counts are 0. Null keys are groups of their own. Partial sums go to the shuffle, so a hot source is a row a task.
    """
    op, tokens, old = F.col("op"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0).cast("long")
    signed = F.when(op == "insert", tokens).when(op == "delete", -tokens).when(op == "revise", tokens - old).otherwise(0).cast("long")
    return changes.groupBy(*KEYS).agg(F.sum(docs).alias("docs"), F.sum(signed).alias("tokens"))


@dataclass
class TokenCounts:
    """Totals in a folder: a version per batch, and a log of (batch_id, version), whose row is the commit.

    A batch is one job that adds its deltas to the last version's totals and writes the next; the log's row comes last, so a
    batch that broke off left no trace but files that its next try replaces. A batch_id that is in the log changes nothing.
    One writer at a time.
    """

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> TokenCounts:
        made = cls(spark, path)
        spark.createDataFrame([], TOTALS).write.mode("overwrite").parquet(f"{path}/version=0")
        made._log([("", 0)], "overwrite")
        return made

    def _log(self, rows: list[tuple[str, int]], mode: str) -> None:
        self.spark.createDataFrame(rows, "batch_id string, version long").coalesce(1).write.mode(mode).parquet(f"{self.path}/log")

    def committed(self) -> DataFrame:
        return self.spark.read.schema("batch_id string, version long").parquet(f"{self.path}/log")

    def version(self) -> int:
        return self.committed().agg(F.max("version")).first()[0]

    def totals(self) -> DataFrame:
        """Rows by source, lang and tokenizer; those without documents and tokens are gone."""
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/version={self.version()}")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits the batch; False if it was committed before."""
        if self.committed().where(F.col("batch_id") == batch_id).count():
            return False
        new = self.version() + 1
        both = self.totals().unionByName(deltas(changes)).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        both.where("docs != 0 OR tokens != 0").write.mode("overwrite").parquet(f"{self.path}/version={new}")
        self._log([(batch_id, new)], "append")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={new - 2}")  # the version before stays, for those who still read it
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return True


def rolled_up(totals: DataFrame) -> DataFrame:
    """Totals by tokenizer; tokenizer and source; tokenizer, source and language; and of all. level: how many of the three are summed over (0 to 3)."""
    level = F.grouping("tokenizer").cast("int") + F.grouping("source").cast("int") + F.grouping("lang").cast("int")
    return totals.rollup("tokenizer", "source", "lang").agg(level.alias("level"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
