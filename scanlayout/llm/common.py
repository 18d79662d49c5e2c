"""What the operators share: the folder that all executors see, and word hashes of whole batches of texts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as SQL pattern and as characters.
WS_PATTERN = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"

#: Columns that name a row of a table of files.
ROW_KEY = ["_row_file", "_row_index"]

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset, under a temporary folder in local mode (tests); on a cluster, whose machines don't share such folders, an error."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="spark-llm-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        base = f"file://{_own_dir}"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Writes df to the shared folder, in folders by the columns of `by` if any, and reads it back: cuts the lineage, survives lost executors, and gives true sizes."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for the table goes once it is written
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what saved() wrote, once all that reads it has been written itself. Other tables stay."""
    for df in tables:
        if path := getattr(df, "_saved_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def carried(carry: Sequence[str], made: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Columns to carry through an operator as one struct, so that their names clash with none inside, and the columns to take out of it in the end.

    A carried column may not have the name of a result column.
    """
    if clash := sorted({c.lower() for c in carry} & {m.lower() for m in made}):
        raise ValueError(f"carried columns have names of results: {', '.join(clash)}")
    return ([F.struct(*carry).alias("carried_")] if carry else []), [F.col("carried_")[c].alias(c) for c in carry]


def held_out(doc_id: Column, mod: int) -> Column:
    """The fold rule of the contracts: crc32(doc_id as text) mod `mod` is 2; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == 2


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (uint64 in and out)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash_chunk(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    raw = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)]
    blank = _IS_WS[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    doc_at = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=doc_at[1:])
    counts = np.diff(np.searchsorted(starts, doc_at))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    inside = np.flatnonzero(~blank)
    at = np.cumsum(first)[inside] - 1
    place = inside - starts[at]
    powers = np.full(int(place.max()) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    value = (raw[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(value, np.searchsorted(inside, starts))), counts


def word_hashes(texts: Sequence[str | None], chunk_bytes: int = 512 << 10) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of the words of all texts, one after the other, and the number of words of each text.

    Words are runs of characters other than ASCII white space, with A-Z in lower case. A null text counts as empty.
    Works through whole texts half a MB at a time, so that memory stays bounded.
    """
    hashes, counts, parts, size = [], [], [], 0
    for text in texts:
        part = b"" if not isinstance(text, str) else text.encode("utf-8", "surrogatepass")
        parts.append(part)
        size += len(part) + 1
        if size >= chunk_bytes:
            h, n = _hash_chunk(parts)
            hashes.append(h)
            counts.append(n)
            parts, size = [], 0
    if parts:
        h, n = _hash_chunk(parts)
        hashes.append(h)
        counts.append(n)
    if not counts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each text and their number; a shorter text that has words has one run, all its words."""
    n = len(hashes)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    where = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(runs)])[:-1], runs) + np.arange(int(runs.sum()))
    length = np.repeat(np.minimum(counts, width), runs)
    out = np.zeros(len(where), dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, dtype=np.uint64)])
    for k in range(width):
        out = np.where(k < length, mix(out * multiplier + padded[where + k] + np.uint64(1)), out)
    assert n == offsets[-1]
    return out, runs


def text_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes (int64) of each text's words and their order, from word_hashes; 0 for a text without words."""
    starts = np.cumsum(counts) - counts
    place = (np.arange(len(hashes)) - np.repeat(starts, counts) + 1).astype(np.uint64)
    out = []
    for mixed in (mix(hashes * place), mix(hashes + place * np.uint64(0xBF58476D1CE4E5B9))):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
        out.append((total[starts + counts] - total[starts]).view(np.int64))
    return out[0], out[1]


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds the columns ROW_KEY, which name a row of files; a table that isn't read straight from files is written first."""
    keys = dict(zip(ROW_KEY, (F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index"))))
    try:
        return docs.select("*", *[c.alias(n) for n, c in keys.items()])
    except AnalysisException:
        return saved(docs).select("*", *[c.alias(n) for n, c in keys.items()])


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs (with ROW_KEY) without the rows whose keys are in dropped, and without ROW_KEY. The keys are written first, so the join knows their size."""
    return docs.join(saved(dropped.select(*ROW_KEY).distinct()), ROW_KEY, "left_anti").drop(*ROW_KEY)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for edges (a, b) of longs: the component is its smallest node.

    In each round a node is put together with one at most two links away, the least of these in an order drawn anew for the round, and only links
    between what is still apart go on. So nodes and links shrink by a factor from round to round, in chains and stars too, and all rounds together
    join little more rows than the first. Where each node went is then looked up from the last round back to the first.
    """
    live, steps = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()), []
    for k in range(most_rounds):
        drawn = lambda c: F.xxhash64(F.col(c), F.lit(k))  # noqa: B023, E731
        near = live.groupBy("a").agg(F.min_by("b", drawn("b")).alias("near"))
        near = saved(near.select(F.col("a").alias("node"), F.when(drawn("near") < drawn("a"), F.col("near")).otherwise(F.col("a")).alias("near")))
        beyond = live.join(near.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min_by("near", drawn("near")).alias("into"))
        step = saved(beyond.select(F.col("a").alias("node"), "into"))
        side = lambda c: step.select(F.col("node").alias(c), F.col("into").alias(f"{c}_into"))  # noqa: B023, E731
        left = live.where("a < b").join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where("a_into != b_into").select(F.col("a_into").alias("a"), F.col("b_into").alias("b"))
        rest = saved(left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        forget(live, near)
        live = rest
        steps.append(step)
        if not rest.limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    label = steps[-1].select("node", F.col("into").alias("label"))
    for step in steps[-2::-1]:
        later = label.select(F.col("node").alias("into"), "label")
        label = step.join(later.hint("merge"), "into", "left").select("node", F.coalesce("label", "into").alias("label"))
    label = saved(label)
    least = label.groupBy("label").agg(F.min("node").alias("component"))
    out = saved(label.join(least.hint("merge"), "label").select("node", "component"))
    forget(live, label, *steps)
    return out
