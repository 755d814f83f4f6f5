"""Sources: file inventories, sidecar JSON, archive listings, CSV and JSON maps. Sinks: CSV, JSON and manifests.

Metadata-only scans prune the content column, so that listing doesn't read files.
"""

from __future__ import annotations

import hashlib
import os
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.functions import scalars as S
from siftwork.operators import sidecars as matching
from siftwork.session import stored

SIDECAR_SCHEMA = (
    "title string, description string, photoTakenTime struct<timestamp:string>,"
    "geoData struct<latitude:double,longitude:double,altitude:double>,"
    "geoDataExif struct<latitude:double,longitude:double,altitude:double>,"
    "people array<struct<name:string>>,"
    "googlePhotosOrigin struct<mobileUpload:struct<deviceFolder:struct<localFolderName:string>>>"
)
MANIFEST = T.StructType([
    T.StructField("TimeStamp", T.StringType()), T.StructField("Action", T.StringType()), T.StructField("SourcePath", T.StringType()),
    T.StructField("DestinationPath", T.StringType()), T.StructField("SizeBytes", T.LongType()), T.StructField("Hash", T.StringType()),
    T.StructField("Detail", T.StringType()),
])
_TRASH = re.compile(r"(^|[\\/])Google Photos[\\/](Trash|Bin)([\\/]|$)", re.I)
DECISIONS = "Path string, Decision string, Category string, Confidence double, Suggestion string, SizeBytes bigint, CopyOf string"


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, size, modified (and content) of every file under root, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


WALKED = "kind string, path string, size long, modified double, root string"


def walk(spark: SparkSession, roots: dict[str, str], prune_trash: bool = False, empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """((root, path, size, modified), (root, path, error)) of mounted folders, by name of their root.

    Executors list a level of folders at a time, so that no task holds a tree. Links are not followed. A folder
    that can't be listed is a row of errors, for incomplete_scan_guard. A folder given under two names counts for the
    first. prune_trash: trash folders are not entered. empty: whether files of no bytes are rows.
    """
    once: dict[str, str] = {}
    for name, folder in roots.items():
        once.setdefault(os.path.abspath(folder), name)
    level = spark.createDataFrame([(v, k) for k, v in once.items()], "root string, path string")
    found = None

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root, folder in zip(batch["root"], batch["path"], strict=True):
                rows = []
                try:
                    with os.scandir(folder) as entries:
                        for e in entries:
                            if e.is_symlink():
                                continue
                            if e.is_dir(follow_symlinks=False):
                                if not (prune_trash and _TRASH.search(e.path + "/")):
                                    rows.append(("folder", e.path, None, None, root))
                            else:
                                own = e.stat(follow_symlinks=False)
                                if own.st_size or empty:
                                    rows.append(("file", e.path, own.st_size, own.st_mtime, root))
                except OSError as error:
                    rows.append((f"error {error.strerror}", folder, None, None, root))
                for s in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[s : s + 10_000], columns=["kind", "path", "size", "modified", "root"]).astype({"size": "Int64"})

    while True:
        level = stored(level.repartition("path").mapInPandas(listed, WALKED))
        found = level if found is None else found.unionByName(level)
        level = level.filter("kind = 'folder'").select("root", "path")
        if level.isEmpty():
            break
    files = found.filter("kind = 'file'").select("root", "path", "size", F.timestamp_seconds("modified").alias("modified"))
    return files, found.filter("kind LIKE 'error%'").select("root", "path", F.expr("substr(kind, 7)").alias("error"))


def scan_library(files: DataFrame, sidecars: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Media of a library outside trash, without empty files, with their sidecars and a folded path to sort by."""
    own = files.filter((F.col("size") > 0) & ~S.in_trash(F.col("path")) & F.lower(S.split_name(S.base(F.col("path")))[1]).isin(*extensions))
    return matching.attach(own, matching.match_sidecars(own, sidecars)).withColumn("order", F.lower("path"))


def video_scans(library: DataFrame, new: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Videos with is_new. Of the new ones empty files are left out, of the library's they stay."""
    video = F.lower(S.split_name(S.base(F.col("path")))[1]).isin(*extensions)
    return new.filter(video & (F.col("size") > 0)).withColumn("is_new", F.lit(True)).unionByName(library.filter(video).withColumn("is_new", F.lit(False)))


def album_scan(files: DataFrame, root: str) -> DataFrame:
    """(album, path, base_name, size) of files that lie directly in an album's folder of an export below root."""
    below = F.substring(F.col("path"), len(root.rstrip("/")) + 2, 10**6)
    own = files.withColumn("album", S.album_of(S.parent(below))).filter(F.col("album").isNotNull())
    return own.select("album", "path", S.base_name(S.base(F.col("path"))).alias("base_name"), "size")


def file_index(files: DataFrame, root: str) -> DataFrame:
    """The three keys files are looked up by: path below root, path below the part, and name, each folded, with the size."""
    rel = F.substring(F.col("path"), len(root.rstrip("/")) + 2, 10**6)
    return files.select("path", "size", F.lower(rel).alias("rel"), F.lower(S.part_relative(rel)).alias("part_rel"), F.lower(S.base(rel)).alias("name"))


def trash_inventory(files: DataFrame) -> DataFrame:
    """(root, path, trash_folder, size) of files in trash folders, of all roots."""
    folder = F.regexp_extract("path", r"(?i)^(.*Google Photos[\\/](?:Trash|Bin))(?:[\\/]|$)", 1)
    return files.filter(S.in_trash(F.col("path"))).select("root", "path", folder.alias("trash_folder"), "size")


def scan_roots(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Files of several roots, each tagged by its name; a root given twice counts once."""
    out = None
    for name, root in {v: k for k, v in roots.items()}.items():
        part = scan(spark, name).withColumn("root", F.lit(root))
        out = part if out is None else out.unionByName(part)
    return out


def classify(name: Column, media: tuple[str, ...]) -> Column:
    """'sidecar', 'media' or 'other'."""
    return F.when(name.rlike(S.SIDECAR), "sidecar").when(F.lower(S.split_name(name)[1]).isin(*media), "media").otherwise("other")


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Sidecar facts by path; an unreadable file has null facts."""
    text = spark.read.option("recursiveFileLookup", True).option("wholetext", True).option("pathGlobFilter", "*.json").text(root)
    return text.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", SIDECAR_SCHEMA).alias("j")).select("path", "j.*")


ENTRIES = "archive string, entry string, position long, size long, modified string, crc long, unreadable boolean"


def list_archives(files: DataFrame) -> DataFrame:
    """(archive, entry, position, size, modified, crc, unreadable) of the zip files at the paths of `files`. Folders are left out.

    Only an archive's directory, at its end, is read, whatever its size. One that can't be opened is one row with a null entry.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with zipfile.ZipFile(_local(path)) as z:
                        rows = [
                            (path, i.filename, n, i.file_size, "{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}".format(*i.date_time), i.CRC, False)
                            for n, i in enumerate(z.infolist()) if not i.is_dir()
                        ]
                except (zipfile.BadZipFile, OSError):
                    rows = [(path, None, None, None, None, None, True)]
                for s in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[s : s + 10_000], columns=["archive", "entry", "position", "size", "modified", "crc", "unreadable"]).astype({"position": "Int64", "size": "Int64", "crc": "Int64"})

    return files.select("path").mapInPandas(entries, ENTRIES)


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def hash_files(paths: DataFrame, buffer: int = 1 << 20) -> DataFrame:
    """(path, hash, bytes) of the files at the given paths: SHA-256 in lower-case hex, read a buffer at a time. Null hash where a file can't be read.

    bytes is what was read. Paths are dealt over all tasks first, so that a list in one partition is read by many.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                digest, n = hashlib.sha256(), 0
                try:
                    with open(_local(path), "rb") as f:
                        while part := f.read(buffer):
                            digest.update(part)
                            n += len(part)
                    rows.append((path, digest.hexdigest(), n))
                except OSError:
                    rows.append((path, None, n))
            yield pd.DataFrame(rows, columns=["path", "hash", "bytes"])

    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(parts, "path").mapInPandas(read, "path string, hash string, bytes long")


def extraction_plan(entries: DataFrame, target: str, folders: DataFrame | None = None) -> DataFrame:
    """entries with where each would be written and an action. Each archive has a folder of its own under target, by its base name.

    entries: archive, entry, position (its place in the archive), unreadable. folders: paths of folders there are;
    an archive whose folder exists is skipped whole, as it was extracted before. Actions: Unreadable, Skip, Blocked (the
    entry would leave the folder), Conflict (an earlier entry of the same archive, or an archive of the same base name in
    another folder, has its place, in any case of letters), Extract. Archives that share a base name share a folder.
    """
    base = F.regexp_replace(F.regexp_extract("archive", r"([^/\\\\]*)$", 1), r"(?i)\.zip$", "")
    folder = F.concat(F.lit(target.rstrip("/") + "/"), base)
    rows = entries.withColumns({"folder": folder, "destination": F.concat(folder, F.lit("/"), "entry")})
    able = ~F.coalesce("unreadable", F.lit(False)) & ~F.coalesce(S.unsafe_entry(F.col("entry")), F.lit(True))
    firsts = rows.filter(able).groupBy(F.lower("destination").alias("place")).agg(F.min(F.struct("archive", "position")).alias("first"))
    rows = rows.withColumn("place", F.lower("destination")).join(firsts, "place", "left")
    done = F.lit(False)
    if folders is not None:
        rows = rows.join(folders.select(F.lower("path").alias("there")).distinct(), F.lower("folder") == F.col("there"), "left")
        done = F.col("there").isNotNull()
    action = (
        F.when(F.col("unreadable"), "Unreadable")
        .when(done, "Skip")
        .when(~able, "Blocked")
        .when(F.struct("archive", "position") != F.col("first"), "Conflict")
        .otherwise("Extract")
    )
    return rows.withColumn("action", action).select(*entries.columns, "folder", "destination", "action")


def verify_extraction(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The plan's rows to extract with a status: OK, SizeDiffers or Missing, by what is at the destination now."""
    there = files.select(F.col("path").alias("destination"), F.col("size").alias("now"))
    status = F.when(F.col("now").isNull(), "Missing").when(F.col("now") != F.col("size"), "SizeDiffers").otherwise("OK")
    return plan.filter("action = 'Extract'").join(there, "destination", "left").withColumn("status", status).drop("now")


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def read_json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(key, value) of a file that holds one JSON object."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, also for no rows. The default mode never reuses a name."""
    df.write.mode(mode).csv(path, header=True, escape='"')


def write_report(df: DataFrame, path: str, counters: dict[str, Column], mode: str = "errorifexists") -> dict:
    """Write a CSV report, and give aggregates of its rows, gathered while they are written: one pass over df, no job beside the writing."""
    seen = Observation()
    write_csv(df.observe(seen, *[c.alias(n) for n, c in counters.items()]), path, mode)
    return seen.get


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_manifest(actions: DataFrame, path: str, flush: int = 500) -> None:
    """Append actions to a manifest table, in files of at most `flush` rows. They all appear when the job ends; run_logged logs step by step."""
    rows = actions.select(*[F.col(f.name).cast(f.dataType) for f in MANIFEST])
    rows.write.mode("append").option("maxRecordsPerFile", flush).parquet(path)


def log_line(stamp: Column, level: str, message: Column) -> Column:
    """'[stamp] [LEVEL] message'."""
    return F.concat(F.lit("["), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit(f"] [{level.upper()}] "), message)


def incomplete_scan_guard(errors: DataFrame, report_only: bool, allow: bool = False) -> None:
    """Refuse anything but a report after errors of enumeration."""
    if not report_only and not allow and not errors.isEmpty():
        first = [r[0] for r in errors.limit(3).collect()]
        raise RuntimeError(f"the scan was incomplete: {first}")


def read_external(files: DataFrame, reader, schema: str, chunk: int = 100) -> DataFrame:
    """Rows that an outside reader gives for lists of at most `chunk` paths: tags, durations, frames or fingerprints.

    reader takes a list of paths and returns a pandas frame of the schema; it runs on the executors.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = batch["path"].tolist()
            for s in range(0, len(paths), chunk):
                yield reader(paths[s : s + chunk])

    return files.select("path").mapInPandas(read, schema)
