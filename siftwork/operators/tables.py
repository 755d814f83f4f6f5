"""Keyed tables: incremental upserts, caches, samples and top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.session import cut


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New rows, and old rows whose key they don't replace."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def to_do(items: DataFrame, cache: DataFrame, key: str, value: str, error: str) -> DataFrame:
    """Items not in the cache, or there without value and without error. A key that the cache holds often counts once."""
    known = cache.filter(F.col(value).isNotNull() | F.col(error).isNotNull()).select(F.col(key).alias("__k")).distinct()
    return items.join(known, F.col(key) == F.col("__k"), "left_anti")


def reuse_hash(new: DataFrame, old: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """new with digest from old where the size is unchanged, and `rehash` where it must be computed."""
    before = old.select(F.col(key).alias("__k"), F.col(size).alias("__s"), F.col(digest).alias("__d"))
    same = F.coalesce((F.col(size) == F.col("__s")) & (F.coalesce("__d", F.lit("")) != ""), F.lit(False))
    return new.join(before, F.col(key) == F.col("__k"), "left").withColumns({digest: F.when(same, F.col("__d")), "rehash": ~same}).drop("__k", "__s", "__d")


def systematic_sample(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Rows number int(i * n / k), i = 0..k-1, in the given order; all if there are no more.

    Range partitions are sorted apart and numbered by their sizes: no task sorts the whole.
    """
    names = rows.columns
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    parts = cut(parts.withColumn("__i", F.monotonically_increasing_id()))  # ranges are sampled: they must not be drawn twice
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    before = sizes.select("__p", "__first", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    at = parts.join(F.broadcast(before), "__p").withColumn("__at", F.col("__i") - F.col("__first") + F.col("__b"))  # a row a partition
    n = parts.count()
    if k >= n:
        return at.select(*names, F.col("__at").alias("position"))
    i = F.ceil(F.col("__at") * F.lit(k) / F.lit(n)).cast("long")
    hit = (i < k) & (F.floor(i * F.lit(n) / F.lit(k)) == F.col("__at"))
    return at.filter(hit).select(*names, F.col("__at").alias("position"))


def first_n(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, numbered."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= n)


def top_share(rows: DataFrame, key: str, value: str, n: int = 4) -> DataFrame:
    """(key, share): how much of a key's rows its n commonest values make up."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key).orderBy(F.desc("c"), value)
    ranked = counts.withColumns({"r": F.row_number().over(w), "t": F.sum("c").over(Window.partitionBy(key))})
    return ranked.filter(F.col("r") <= n).groupBy(key).agg((F.sum("c") / F.max("t")).alias("share"))
