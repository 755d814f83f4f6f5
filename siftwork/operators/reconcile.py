"""Reconciling inventories: archives against disk, content elsewhere, backups, albums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import scalars as S
from siftwork.operators import decisions as D
from siftwork.operators import similar
from siftwork.session import stored


def vote_folder(entries: DataFrame, disk: DataFrame, least: float = 0.5) -> DataFrame:
    """(archive, folder, votes): the folder that holds most of an archive's entries by path and size, if it holds enough."""
    votes = entries.join(disk.select("folder", F.col("rel").alias("entry"), "size"), ["entry", "size"]).groupBy("archive", "folder").agg(F.count(F.lit(1)).alias("votes"))
    sizes = entries.groupBy("archive").agg(F.count(F.lit(1)).alias("n"))
    best = similar.best_match(votes, "archive", F.desc("votes"), F.col("folder"))
    return best.join(sizes, "archive").filter(F.col("votes") >= F.col("n") * least).select("archive", "folder", "votes")


def find_entries(entries: DataFrame, source: DataFrame, quarantine: DataFrame) -> DataFrame:
    """entries (archive, entry, size) with place: present, quarantine, trash or missing. Both disks have rel, size."""
    there = lambda df, name: df.select(F.col("rel").alias("entry"), "size").distinct().withColumn(name, F.lit(True))
    both = entries.join(there(source, "s"), ["entry", "size"], "left").join(there(quarantine, "q"), ["entry", "size"], "left")
    place = F.when(F.col("s"), "present").when(F.col("q"), "quarantine").when(S.in_trash(F.col("entry")), "trash").otherwise("missing")
    return both.select(*entries.columns, place.alias("place"))


def archive_report(found: DataFrame, archives: DataFrame) -> DataFrame:
    """A row an archive: counters, status and per cent present. archives lists also empty ones."""
    count = lambda p: F.count_if(F.col("place") == p)
    per = found.groupBy("archive").agg(
        F.count(F.lit(1)).alias("files"), count("present").alias("present"), count("quarantine").alias("in_quarantine"),
        count("trash").alias("missing_trash"), count("missing").alias("missing"),
        F.count_if((F.col("place") == "missing") & F.lower("entry").endswith(".json")).alias("missing_json"),
    )
    counters = ["files", "present", "in_quarantine", "missing_trash", "missing", "missing_json"]
    all_ = archives.select("archive").join(per, "archive", "left").fillna(0, counters)
    ok = F.col("present") + F.col("in_quarantine")
    share = F.when(F.col("files") == 0, 100.0).otherwise(F.bround(100.0 * ok / F.when(F.col("files") > 0, F.col("files")), 1))
    return all_.withColumns({"status": D.archive_status(F.col("files"), ok, F.col("missing"), F.col("missing_trash")), "percent": share})


def content_elsewhere(wanted: DataFrame, library: DataFrame, quarantine: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """wanted with in_library, in_quarantine and other: a path of equal content, the library's first, then the least.

    All three have path (unique in wanted) and size. read gives (path, hash) for a table of paths; it is asked only for
    files whose size occurs on both sides, so whatever has a size of its own is never opened. Sizes and paths move first,
    then hashes. Null sizes and hashes are equal to nothing.
    """
    side = lambda df, n: df.select("path", "size", F.lit(n).alias("prio"))
    sides = side(library, 0).unionByName(side(quarantine, 1))
    held = stored(sides.join(wanted.select("size").distinct(), "size", "left_semi"))
    asked = stored(wanted.select("path", "size").join(held.select("size").distinct(), "size", "left_semi"))
    hashes = stored(read(held.select("path").union(asked.select("path")).distinct()).select("path", "hash"))
    best = held.join(hashes, "path").groupBy("size", "hash").agg(F.min(F.struct("prio", "path")).alias("b"))
    found = asked.join(hashes, "path").join(best, ["size", "hash"]).select("path", "b")
    return wanted.join(found, "path", "left").select(
        *wanted.columns, F.coalesce(F.col("b.prio") == 0, F.lit(False)).alias("in_library"),
        F.coalesce(F.col("b.prio") == 1, F.lit(False)).alias("in_quarantine"), F.coalesce("b.path", F.lit("")).alias("other"),
    )


def verify_backup(source: DataFrame, backup: DataFrame) -> DataFrame:
    """(rel, size, status) of every source file. Both have rel, size, hash."""
    there = backup.select("rel", F.col("size").alias("b_size"), F.col("hash").alias("b_hash"))
    return source.join(there, "rel", "left").select("rel", "size", D.backup_status(F.col("b_size"), F.col("size"), F.col("b_hash"), F.col("hash")).alias("status"))


def album_members(current: DataFrame, lost: DataFrame, library: DataFrame) -> DataFrame:
    """A row an album: how many files are there, the first and last of them, and how many of those lost were found again.

    current and lost have album, path, base_name, fingerprint; library has path, base_name, fingerprint.
    """
    every = album_files(current, lost, library)
    once = every.filter("path IS NOT NULL").groupBy("album", "path").agg(F.count_if("was_lost").alias("recovered"))
    there = once.groupBy("album").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_file"), F.max("path").alias("last_file"), F.sum("recovered").alias("recovered"))
    gone = every.groupBy("album").agg(F.count_if(F.col("path").isNull()).alias("not_in_library"))
    return gone.join(there, "album", "left").fillna(0, ["n_files", "recovered"]).select("album", "n_files", "first_file", "last_file", "recovered", "not_in_library")


def album_files(current: DataFrame, lost: DataFrame, library: DataFrame) -> DataFrame:
    """(album, path, was_lost): files now there, and lost ones as the library has them by name and fingerprint, null if it doesn't."""
    first = library.groupBy("base_name", "fingerprint").agg(F.min("path").alias("found"))
    again = lost.join(first, ["base_name", "fingerprint"], "left").select("album", F.col("found").alias("path"), F.lit(True).alias("was_lost"))
    return current.select("album", "path", F.lit(False).alias("was_lost")).unionByName(again)


def unchanged(expected: DataFrame, now: DataFrame, *keys: str) -> DataFrame:
    """Rows expected that are still there with equal keys; each is checked once however often it is named."""
    return expected.select(*keys).distinct().join(now.select(*keys), list(keys), "left_semi")


def album_titles(members: DataFrame, titles: DataFrame) -> DataFrame:
    """(album, title, first, last): the first title seen, else the album's name, and the dates of its files.

    members has album, date; titles has album, seen, title.
    """
    named = titles.filter(F.coalesce("title", F.lit("")) != "").groupBy("album").agg(F.min_by("title", "seen").alias("title"))
    dates = members.groupBy("album").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return dates.join(named, "album", "left").select("album", F.coalesce("title", F.col("album").cast("string")).alias("title"), "first", "last")
