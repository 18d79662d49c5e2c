"""Image files in, plans and reports out."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import work_dir, written


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, width, height, n_channels, data (blue, green, red by row) and is_valid; a file that can't be decoded is a row without data."""
    image = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    ok = F.col("width") > 0
    return image.select("origin", *[F.when(ok, F.col(c)).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "n_channels"), ("data", "data"))], ok.alias("is_valid"))


def _bmp(width: int, height: int, channels: int, data: bytes) -> bytes:
    """A 24-bit bitmap file of bytes by row (blue, green, red; one channel is grey): rows from the bottom up, filled to four bytes."""
    rows = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)[::-1, :, :3]
    rows = np.repeat(rows, 3, axis=2) if channels == 1 else rows
    filled = np.zeros((height, -(-width * 3 // 4) * 4), dtype=np.uint8)
    filled[:, : width * 3] = rows.reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + filled.size, 0, 0, 54, 40, width, height, 1, 24, 0, filled.size, 2835, 2835, 0, 0) + filled.tobytes()


def write_page_images(rasters: DataFrame, path: str) -> DataFrame:
    """Writes doc_id-page_index.bmp for each image (width, height, n_channels, data), and gives doc_id, page_index and name; an image without data becomes a file of no pixels, which can't be read.

    Files are put under their name once they are whole, so a task that is run again replaces its own. path is a URI that executors can write to.
    """
    kinds = ", ".join(f"{c} {rasters.schema[c].dataType.simpleString()}" for c in ("doc_id", "page_index"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder)
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                data = _bmp(row["width"], row["height"], row["n_channels"], row["data"]) if row["data"] else b"BM"
                names.append(f"{row['doc_id']}-{row['page_index']}.bmp")
                part = f"{folder}/_{names[-1]}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(data)
                files.move(part, f"{folder}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_index"), pa.array(names, pa.string())], names=["doc_id", "page_index", "name"])

    made = rasters.select("doc_id", "page_index", "width", "height", "n_channels", "data").mapInArrow(write, kinds + ", name string")
    return written(made, work_dir(rasters.sparkSession))


def write_draw_plan(plan: DataFrame, path: str, buckets: int = 16) -> None:
    """The plan in folders by bucket of documents; Spark's commit shows all files or none. Rows stay in their parts, which are sorted by document and page: a document has a file for each part it is in, so a hot one's rows lie in many, and the plan isn't shuffled."""
    rows = plan.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    rows.sortWithinPartitions("bucket", "doc_id", "page_index", "seq", "char_no").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_quality_report(summary: DataFrame, settings: DataFrame, pages: DataFrame, path: str) -> None:
    """Three folders of JSON rows; `summary` comes last, so a report that has it is whole."""
    for name, rows in (("settings", settings), ("pages", pages), ("summary", summary)):
        rows.write.mode("overwrite").json(f"{path}/{name}")
