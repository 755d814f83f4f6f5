"""Joins between files and the sidecar files that describe them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import scalars as S


def candidate_rows(files: DataFrame) -> DataFrame:
    """(path, folder, part_folder, priority, name, match): a row for each name that may describe a file."""
    return files.select(
        "path",
        S.parent(F.col("path")).alias("folder"),
        S.parent(S.part_relative(F.col("path"))).alias("part_folder"),
        F.posexplode(S.sidecar_candidates(S.base(F.col("path")))).alias("priority", "c"),
    ).select("path", "folder", "part_folder", "priority", "c.name", "c.match")


def match_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, sidecar, priority, match, place): SameFolder hits, and OtherPart hits in the same folder of another part.

    Both kinds come from one equi-join on the folder below the part and the name, case ignored. A path is a file: however often
    it is listed on either side, a hit is one row. Rows that repeat go before the join, where they would multiply.
    """
    wanted = candidate_rows(files.select("path").distinct())
    have = sidecars.select("path").distinct().select(
        F.col("path").alias("sidecar"),
        F.lower(S.parent(S.part_relative(F.col("path")))).alias("k1"),
        F.lower(S.base(F.col("path"))).alias("k2"),
    )
    hit = wanted.join(have, (F.lower("part_folder") == F.col("k1")) & (F.lower("name") == F.col("k2")))
    same = F.lower(S.parent(F.col("sidecar"))) == F.lower("folder")
    return hit.select("path", "sidecar", "priority", "match", F.when(same, "SameFolder").otherwise("OtherPart").alias("place"))


def attach(files: DataFrame, hits: DataFrame) -> DataFrame:
    """files with has_meta, meta_match, meta_place and sidecars, the best hit first."""
    order = F.struct("priority", (F.col("place") != "SameFolder").alias("other"), "sidecar", "match", "place")
    best = hits.groupBy("path").agg(F.array_sort(F.collect_list(order)).alias("h"))
    return files.join(best, "path", "left").select(
        *files.columns,
        F.col("h").isNotNull().alias("has_meta"),
        F.coalesce(F.col("h")[0]["match"], F.lit("")).alias("meta_match"),
        F.coalesce(F.when(F.exists("h", lambda x: x["place"] == "SameFolder"), "SameFolder").when(F.col("h").isNotNull(), "OtherPart"), F.lit("None")).alias("meta_place"),
        F.coalesce(F.transform("h", lambda x: x["sidecar"]), F.array().cast("array<string>")).alias("sidecars"),
    )


def orphans(sidecars: DataFrame, hits: DataFrame) -> DataFrame:
    """Sidecars that describe no file."""
    return sidecars.join(hits.select(F.col("sidecar").alias("path")), "path", "left_anti")


def still_needed(losers: DataFrame, kept: DataFrame, hits: DataFrame) -> DataFrame:
    """Sidecars of losers that a kept file also uses, and which therefore stay."""
    used = lambda files: hits.join(files.select("path"), "path", "left_semi").select("sidecar").distinct()
    return used(losers).join(used(kept), "sidecar", "left_semi")


def merge_first(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): the first non-empty value in order."""
    return rows.filter(F.col(value) != "").groupBy(key).agg(F.min_by(value, F.struct(order, value)).alias(value))


def merge_union(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): distinct values in the order of their first occurrence."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return rows.groupBy(key).agg(F.array_distinct(F.transform(ordered, lambda x: x[value])).alias("values"))
