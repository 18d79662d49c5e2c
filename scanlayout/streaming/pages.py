"""Assembly of pages from metadata and OCR results that arrive apart."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.quality import split_control

PAGE = ["doc_id", "page_index"]


def stream_join_pages(meta: DataFrame, ocr: DataFrame, bound: str = "120 seconds") -> DataFrame:
    """Each page's metadata with its OCR result if that comes within `bound`; without one (ocr_ts null) once the watermark passes."""
    left = meta.select(*PAGE, F.col("ts").alias("meta_ts")).withWatermark("meta_ts", bound)
    right = ocr.select(F.col("doc_id").alias("d"), F.col("page_index").alias("p"), F.col("ts").alias("ocr_ts"), "kind").withWatermark("ocr_ts", bound)
    near = F.expr(f"doc_id = d AND page_index = p AND ocr_ts BETWEEN meta_ts - INTERVAL {bound} AND meta_ts + INTERVAL {bound}")
    return left.join(right, near, "leftOuter").select(*PAGE, "meta_ts", "ocr_ts", "kind")


def stalled_pages(joined: DataFrame) -> DataFrame:
    """Pages whose result never came: rows for another try, where a single run would stop."""
    return joined.where("ocr_ts IS NULL").select(*PAGE, "meta_ts")


def stream_quality(attempts: DataFrame) -> DataFrame:
    """Running attempts, successes and pages' errors by document."""
    return attempts.groupBy("doc_id").agg(F.count("*").alias("attempted_inserts"), F.count_if("ok").alias("ok_inserts"), F.count_if(~F.col("ok")).alias("insert_errors"))


def once_per_key(rows: DataFrame, key: str, ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """The first row of each key that a stream brings, keys being forgotten behind the watermark."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def write_split(results: DataFrame, pages: str, control: str, checkpoint: str) -> None:
    """Runs a stream of results over what there is: pages to one folder, control messages to another. A batch has a folder of its own in each, so one that is repeated replaces itself."""

    def both(batch: DataFrame, n: int) -> None:
        for path, rows in zip((pages, control), split_control(batch)):
            rows.write.mode("overwrite").parquet(f"{path}/{n}")

    results.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(both).start().awaitTermination()


class InOrder(StatefulProcessor):
    """State of a document: `next`, the page whose turn it is; `waiting`, a map of pages that came before their turn; `until`, when the document is given up.

    A batch reads and writes the pages that come or go, never all that wait.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "page int")
        self.until = handle.getValueState("until", "ms long")
        self.waiting = handle.getMapState("waiting", "page int", "ms long")

    @staticmethod
    def _rows(doc: int, pages: list[int], released: bool) -> pd.DataFrame:
        n = len(pages)
        return pd.DataFrame({"doc_id": np.full(n, doc, dtype=np.int64), "page_index": np.array(pages, dtype=np.int32), "released": np.full(n, released)})

    def _keep_until(self, ms: int) -> None:
        old = self.until.get()[0] if self.until.exists() else None
        if old is None or ms > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
            self.until.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 0
        came: dict[int, int] = {}
        for frame in rows:
            for page, ms in zip(frame["page_index"].tolist(), frame["ts"].astype("datetime64[ms]").astype("int64").tolist()):
                came[page] = max(ms, came.get(page, ms))
        last = max(came.values())
        out = []
        while at in came or self.waiting.containsKey((at,)):
            if came.pop(at, None) is None:
                self.waiting.removeKey((at,))
            out.append(at)
            at += 1
        for page, ms in came.items():
            if page > at:
                self.waiting.updateValue((page,), (ms,))
        self.next.update((at,))
        self._keep_until(last + self.keep_ms)
        yield self._rows(key[0], out, True)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = sorted(k[0] for k in self.waiting.keys()) if self.waiting.exists() else []
        for state in (self.next, self.until, self.waiting):
            state.clear()
        yield self._rows(key[0], left, False)

    def close(self) -> None:
        pass


def stream_in_order_release(events: DataFrame, keep: str = "7 days", late: str = "1 hour") -> DataFrame:
    """doc_id, page_index, status of ready pages (doc_id, page_index, ts): released in order, each as soon as all before it came; or expired, pages still waiting once the watermark is `keep` past the document's last page, when its state goes. Repeats are dropped, and so are rows that come more than `late` behind. Needs the RocksDB state store (rocksdb)."""
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = events.select(F.col("doc_id").cast("long"), F.col("page_index").cast("int"), "ts").where("page_index >= 0").withWatermark("ts", late)
    out = rows.groupBy("doc_id").transformWithStateInPandas(InOrder(keep_ms), "doc_id long, page_index int, released boolean", "Append", "EventTime")
    return out.select(*PAGE, F.when(F.col("released"), "released").otherwise("expired").alias("status"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
