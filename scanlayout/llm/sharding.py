"""Sharding: a hierarchical weighted hash tree. Each document descends region, rack and shard by weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree_of(shards: int, racks: int = 2, per_rack: int = 2, base: int = 8) -> list[Shard]:
    """`base` shards in full racks and regions, and each one more in a new region of its own.

    A new shard so changes no weight but that of its own region, and takes rows only into itself.
    """
    per_region = racks * per_rack
    return [Shard(i // per_region, i // per_rack % racks, i) if i < base else Shard(base // per_region + 1 + i - base, 0, i) for i in range(shards)]


def _draw(key: Column, node: str, weight: float) -> Column:
    """An exponential arrival time with rate `weight`, from 52 bits of md5: of several nodes, the first wins with odds by weight.

    -ln(u) / weight, u in (0, 1); it depends only on the key, the node and its own weight, so other nodes' draws never change.
    """
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(node), key).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _first(draws: list[tuple[int, Column]]) -> Column:
    if len(draws) == 1:
        return F.lit(draws[0][0])
    return F.array_min(F.array(*[F.struct(draw.alias("t"), F.lit(number).alias("n")) for number, draw in draws]))["n"]


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key (string): the draws of a level are made only below the node chosen above it.

    A change of weights moves rows only into, or out of, the subtrees whose weight changed.
    """
    tree = sorted(tree, key=lambda s: (s.region, s.rack, s.shard))
    regions = {r: list(x) for r, x in groupby(tree, lambda s: s.region)}

    def choose(options: list[tuple[int, str, float]], then) -> Column:
        picked = _first([(n, _draw(key, node, w)) for n, node, w in options])
        if len(options) == 1:
            return then(options[0][0])
        out = None
        for n, _, _ in options:
            out = F.when(picked == n, then(n)) if out is None else out.when(picked == n, then(n))
        return out

    def in_rack(rack: list[Shard]) -> Column:
        return choose([(s.shard, f"s{s.shard}", s.weight) for s in rack], lambda n: F.lit(n))

    def in_region(region: list[Shard]) -> Column:
        racks = {r: list(x) for r, x in groupby(region, lambda s: s.rack)}
        return choose([(r, f"r{region[0].region}.{r}", sum(s.weight for s in x)) for r, x in racks.items()], lambda r: in_rack(racks[r]))

    return choose([(r, f"g{r}", sum(s.weight for s in x)) for r, x in regions.items()], lambda r: in_region(regions[r])).cast("int")


def assign_shards(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, doc_id: str = "doc_id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law 'key', shard, slot, grown_shard.

    The law is `key`: doc_id and the tree decide, texts and other rows don't. A null doc_id counts as the empty key; rows that
    share a doc_id share a shard, each with a slot of its own. A null text has size 1 and crc32 0. grown_shard is null without
    a grown tree. Columns of other names aren't read. An empty table gives an empty table.

    Slots are numbered without a task for a whole shard or a whole key: rows are ranked in `buckets` groups of each shard, by a hash of key,
    text and input partition, and each group starts where the sizes of those before it end. That table has at most shards * buckets rows, which bounds its broadcast.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.lit("key").alias("law"), shard_of(key, tree).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), F.pmod(F.xxhash64(key, raw, F.spark_partition_id()), F.lit(buckets)).cast("int").alias("_b"),
    )
    place = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_b").count().withColumn("_start", F.coalesce(F.sum("count").over(place), F.lit(0))).drop("count")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size")))
    return ranked.join(F.broadcast(starts), ["shard", "_b"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_start") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")
