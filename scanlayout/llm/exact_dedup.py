"""Exact dedup: two-pass Bloom filtering; only rows with a possibly repeated fingerprint shuffle, and the rest pass straight through."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, carried, forget, saved

#: Bits of one bitmap of bitmap_construct_agg.
BLOCK_BITS = 32768
RESULT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WS_CHARS, "")


def _bits(key: Column, blocks: int, hashes: int) -> tuple[Column, list[Column]]:
    """A block for the key, and its bit positions there (from 0)."""
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(blocks)), [F.pmod(F.xxhash64(F.lit(i + 1), key), F.lit(BLOCK_BITS)) for i in range(hashes)]


def repeated_filter(keys: DataFrame, key: str, blocks: int, hashes: int) -> DataFrame:
    """First pass: a blocked Bloom filter (block, bitmap) of bits that two or more rows set. At most `blocks` rows of 4 KB."""
    block, bits = _bits(F.col(key), blocks, hashes)
    hits = keys.select(block.alias("block"), F.explode(F.array_distinct(F.array(*bits))).alias("bit")).groupBy("block", "bit").count()
    return hits.where("count > 1").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def maybe_repeated(keys: DataFrame, key: str, bloom: DataFrame, blocks: int, hashes: int) -> DataFrame:
    """Second pass: adds `maybe`, false only where the key is surely unique. Without shuffle: the filter has a fixed greatest size."""
    block, bits = _bits(F.col(key), blocks, hashes)
    looked_up = keys.withColumn("_block", block).join(F.broadcast(bloom.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap"))), "_block", "left")
    test = F.lit(True)
    for bit in bits:
        byte = F.conv(F.hex(F.substring("_bitmap", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        test &= byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8).cast("int") + 1)) != 0
    return looked_up.withColumn("maybe", F.col("_bitmap").isNotNull() & F.coalesce(test, F.lit(False))).drop("_block", "_bitmap")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_blocks: int = 16384, hashes: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns named in carry (any names but these: ValueError).

    Texts are equal when identical without ASCII white space (null: empty). Of equal texts the one with the most code points
    stays, then the smallest doc_id; of several rows with that doc_id and length one, any, is kept. A null doc_id comes before
    all others. Other columns of docs aren't read, whatever their names. An empty table gives an empty table.

    The fingerprints (some 50 bytes a row) are written once. Pass one sets the bits of each fingerprint and keeps those set twice
    or more. The filter has 16 bits a row. For one of more than max_blocks blocks of 4 KB (64 MB, some 33 million rows) the fingerprints are
    written once more, by their hash in folders, and each folder has a filter of its own, so the share of unique rows taken for repeated ones (1.4 %) is
    the same at every size, and a broadcast never grows. Pass two sends only possibly repeated rows to the shuffle; texts never
    shuffle. Large groups are counted with partial sums and joined by merge join, whose hot partitions Spark splits.
    """
    pack, unpack = carried(carry, RESULT)
    prints = saved(
        docs.select(F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("text_sha256"), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_n"), F.monotonically_increasing_id().alias("_row"), *pack)
    )
    blocks = prints.count() * 16 // BLOCK_BITS + 1
    parts = -(-blocks // max_blocks)
    blocks = -(-blocks // parts)
    tested = None
    if parts > 1:  # each part reads its own files only
        whole, part = prints, F.pmod(F.xxhash64(F.lit(-1), "text_sha256"), F.lit(parts)).cast("int")
        prints = saved(whole.withColumn("_part", part).repartition(F.col("_part"), F.pmod(F.col("_row"), F.lit(64))), by=["_part"])
        forget(whole)
    for k in range(parts):
        own = prints.where(F.col("_part") == k).drop("_part") if parts > 1 else prints
        some = maybe_repeated(own, "text_sha256", saved(repeated_filter(own, "text_sha256", blocks, hashes)), blocks, hashes)
        tested = some if tested is None else tested.unionByName(some)
    alone = tested.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *unpack)
    again = tested.where("maybe")
    best = F.min_by(F.struct("doc_id", "_row"), F.struct(-F.col("_n"), F.col("doc_id"), F.col("_row")))
    groups = saved(again.groupBy("text_sha256").agg(best.alias("_best"), F.count("*").alias("group_size")))
    joined = again.join(groups.hint("merge"), "text_sha256").select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256", *unpack)
    return alone.unionByName(joined)
