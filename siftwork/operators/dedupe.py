"""Exact duplicates: size pre-filter, content groups, scored keeper, reasons and summary.

What is known of a group is aggregated, with partial sums before the shuffle, and joined back to its
members: a content of any number of copies is never one task's window. Where hashing means opening
files, size_candidates says which ones; a content that is at hand in its row is cheaper hashed
while it is scanned than moved to meet its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.session import cut


def size_candidates(files: DataFrame, size: str = "size") -> DataFrame:
    """Files whose size occurs more than once and isn't zero."""
    twice = files.filter(F.col(size) > 0).groupBy(size).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(size)
    return files.join(twice, size, "left_semi")


def duplicate_groups(files: DataFrame, size: str = "size", digest: str = "hash") -> DataFrame:
    """(size, hash, n_files, reclaim): contents held more than once."""
    return (
        files.filter(F.col(digest).isNotNull())
        .groupBy(size, digest)
        .agg(F.count(F.lit(1)).alias("n_files"))
        .filter("n_files > 1")
        .withColumn("reclaim", F.col(size) * (F.col("n_files") - 1))
    )


def duplicate_members(files: DataFrame, size: str = "size", digest: str = "hash") -> DataFrame:
    """Files whose content another file has too."""
    return files.join(duplicate_groups(files, size, digest).select(size, digest), [size, digest], "left_semi")


def choose_keeper(files: DataFrame) -> DataFrame:
    """Score, recommendation, keeper and reason for every member of a duplicate group.

    Needs path, size, hash, depth, in_trash, has_meta, meta_place, clean; a path is a file's name and
    stands there once. The keeper is outside trash if any is, has metadata if any of those does,
    then score, shortest path, path.
    """
    groups = (
        files.groupBy("size", "hash")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("depth").alias("min_depth"), F.bool_and("in_trash").alias("keeper_trash"),
            F.count_if(~F.col("in_trash")).alias("n_outside"), F.count_if(F.col("has_meta")).alias("n_meta"),
            F.count_if(F.col("has_meta") & ~F.col("in_trash")).alias("n_meta_outside"),
        )
        .filter("n > 1")
    )
    scored = files.join(groups, ["size", "hash"]).withColumns({
        "score": F.when(F.col("has_meta"), 100).otherwise(0)
        + F.when(F.col("meta_place") == "SameFolder", 2).otherwise(0)
        + F.when(F.col("depth") == F.col("min_depth"), 5).otherwise(0)
        + F.when(F.col("clean"), 1).otherwise(0),
        "n_able": F.when(F.col("n_outside") > 0, F.col("n_meta_outside")).otherwise(F.col("n_meta")),
    })
    order = F.struct("in_trash", (~F.col("has_meta")).alias("bare"), (-F.col("score")).alias("low"), F.length("path").alias("length"), F.lower("path").alias("folded"), "path")
    best = scored.groupBy("size", "hash").agg(F.min(order).alias("best")).select("size", "hash", F.col("best.path").alias("keeper"))
    scored = scored.join(best, ["size", "hash"])
    won = (
        F.when((F.col("n_able") == 0) & (F.col("n_meta") > 0), "KEEP: no copy outside trash has metadata; fallback order decides")
        .when(F.col("n_able") == 0, "KEEP: no copy in group has metadata; fallback order decides")
        .when(F.col("n_able") == 1, "KEEP: only copy with metadata")
        .otherwise(F.concat(F.lit("KEEP: best-scoring of "), F.col("n_able").cast("string"), F.lit(" copies with metadata")))
    )
    won = F.concat(won, F.when((F.col("n_outside") > 0) & (F.col("n_outside") < F.col("n")), "; trash copies excluded").otherwise(""))
    lost = (
        F.when(F.col("in_trash") & ~F.col("keeper_trash"), "DELETE: in trash and another copy exists elsewhere")
        .when(~F.col("has_meta") & (F.col("n_able") > 0), "DELETE: no metadata while another copy has it")
        .when(F.col("has_meta"), "DELETE: another copy with metadata scored higher")
        .otherwise("DELETE: lower score than keeper")
    )
    first = F.col("path") == F.col("keeper")
    return scored.withColumns({
        "recommendation": F.when(first, "KEEP").otherwise("DELETE"),
        "reason": F.when(first, won).otherwise(lost),
    })


def number_groups(groups: DataFrame, size: str = "size", digest: str = "hash") -> DataFrame:
    """Add group_id 'G00001', in byte order of '<size>, <hash>'. Only distinct groups are numbered.

    Range partitions count their groups and numbers continue across them, so no task holds all.
    """
    keyed = groups.select(size, digest, F.concat(F.col(size).cast("string"), F.lit(", "), digest).alias("__key")).distinct()
    parts = keyed.repartitionByRange("__key").sortWithinPartitions("__key").withColumn("__p", F.spark_partition_id())
    parts = cut(parts.withColumn("__i", F.monotonically_increasing_id()))  # ranges are sampled: they must not be drawn twice
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    before = sizes.withColumn(
        "__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    numbered = parts.join(F.broadcast(before.select("__p", "__first", "__before")), "__p")  # a row a partition
    return numbered.select(size, digest, F.format_string("G%05d", F.col("__i") - F.col("__first") + F.col("__before") + 1).alias("group_id"))


def dedupe_summary(members: DataFrame) -> DataFrame:
    """One row of counters over what choose_keeper returns."""
    per = members.groupBy("size", "hash").agg(
        F.count_if(F.col("recommendation") == "DELETE").alias("losers"),
        F.bool_or("has_meta").alias("any_meta"),
        F.bool_and(~F.col("has_meta") | (F.col("meta_place") == "OtherPart")).alias("only_other"),
        F.count_if(F.col("in_trash") & (F.col("recommendation") == "DELETE")).alias("trash_losers"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("losers"), F.lit(0)).alias("deletes"),
        F.coalesce(F.sum(F.col("size") * F.col("losers")), F.lit(0)).alias("reclaim_bytes"),
        F.count_if("any_meta").alias("groups_with_metadata"),
        F.count_if(F.col("any_meta") & F.col("only_other")).alias("groups_only_other_part"),
        F.coalesce(F.sum("trash_losers"), F.lit(0)).alias("trash_losers"),
    )
