"""Running sums and numbers within keys of any size, in two levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import work_dir


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Merge join on keys, null being equal to null; with left's keys and all other columns of both."""
    names = [f"_k{k}" for k in range(len(keys))]
    right = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in right.columns if c not in keys])
    return left.join(right.hint("merge"), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]), how).drop(*names)


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amounts: Mapping[str, Column]) -> DataFrame:
    """Adds the sum of each amount (a null one counts 0) over a key's rows up to and with this one, in the order given, nulls first.

    Rows are dealt over as many ranges of (keys, order) as there are shuffle partitions and written, so a hot key, or one order value
    of many rows, is spread as far as its order tells rows apart; each range is summed by itself and starts where the key's ranges before it end, of
    which there are no more than partitions. Rows that are equal in keys and order stand in any order.
    """
    spark, at = rows.sparkSession, [f"_o{k}" for k in range(len(order))]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select("*", *[F.col(o).alias(a) for o, a in zip(order, at)], *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(f"_a_{n}") for n, c in amounts.items()])
    path = work_dir(spark)
    dealt = named.repartitionByRange(parts, *keys, *at).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    sums = dealt.groupBy(*keys, "_part").agg(*[F.sum(f"_a_{n}").alias(f"_s_{n}") for n in amounts])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in amounts])
    inner = Window.partitionBy(*keys, "_part").orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("*", *[F.sum(f"_a_{n}").over(inner).alias(f"_i_{n}") for n in amounts])
    both = matched(summed, starts, [*keys, "_part"])
    return both.select(*[c for c in rows.columns if c not in amounts], *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in amounts])


def numbered(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """k: the row's number within its key, from 1."""
    return running(rows, [key], order, {"k": F.lit(1)}).withColumn("k", F.col("k").cast("int"))
