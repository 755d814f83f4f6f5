"""Roles: which columns of the test tables stand for files, sidecars, images and so on.

Each role is given twice, as a DataFrame and as a SQL common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import scalars as S
from siftwork.session import table

NAME = """CASE doc_id % 7
  WHEN 1 THEN concat('IMG_', doc_id, '(1).jpg') WHEN 2 THEN concat('IMG_', doc_id, '-edited.jpg')
  WHEN 3 THEN concat('IMG-2023', lpad(cast(doc_id % 12 + 1 as {s}), 2, '0'), lpad(cast(doc_id % 28 + 1 as {s}), 2, '0'), '-WA', lpad(cast(doc_id % 10000 as {s}), 4, '0'), '.jpg')
  WHEN 4 THEN concat('copy of ', doc_id, '.png') WHEN 5 THEN concat('IMG_2019', lpad(cast(doc_id % 12 + 1 as {s}), 2, '0'), '15_', lpad(cast(cast(floor(doc_id / 3600) as bigint) % 24 as {s}), 2, '0'),
      lpad(cast(cast(floor(doc_id / 60) as bigint) % 60 as {s}), 2, '0'), lpad(cast(doc_id % 60 as {s}), 2, '0'), '.mp4')
  ELSE concat('IMG_', doc_id, '.jpg') END"""
FOLDER = "CASE WHEN source IN ('src3', 'src4') THEN concat(source, '/Google Photos/Trash') ELSE concat(source, '/Google Photos/Album ', lang) END"
SIDE_NAME = """CASE WHEN toxic = 1 AND quality = 0 THEN concat('gone_', doc_id, '.jpg.supplemental-metadata.json')
  WHEN doc_id % 7 = 1 THEN concat('IMG_', doc_id, '.jpg.supplemental-metadata(1).json')
  WHEN doc_id % 7 = 2 THEN concat('IMG_', doc_id, '.jpg.supplemental-metadata.json') ELSE concat(name, '.supplemental-metadata.json') END"""
SIDE_FOLDER = "CASE WHEN quality = 1 THEN folder ELSE concat('other', substr(folder, strpos(folder, '/'))) END"


def _joined(sql: str) -> Column:
    """The SQL as a column: its concat leaves nulls out, as concat_ws does."""
    return F.expr(sql.replace("concat(", "concat_ws('', "))


def inventory(spark: SparkSession, sf_dir: str, hashed: bool = True) -> DataFrame:
    """Files: doc_id, lang, source, size, hash, name, folder, path."""
    docs = table(spark, sf_dir, "documents")
    out = docs.select(
        "doc_id", "lang", "source", F.octet_length("text").cast("long").alias("size"), *([S.content_hash(F.encode("text", "UTF-8")).alias("hash")] if hashed else []),
        _joined(NAME.format(s="string")).alias("name"), _joined(FOLDER).alias("folder"),
    )
    return out.withColumn("path", F.concat_ws("/", "folder", "name"))


INVENTORY = f"""files AS (
  SELECT *, concat(folder, '/', name) AS path FROM (
    SELECT doc_id, lang, source, strlen(text) AS size, sha256(text) AS hash, {NAME.format(s="varchar")} AS name, {FOLDER} AS folder FROM documents))"""


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars: doc_id they stand beside, path."""
    files = inventory(spark, sf_dir, hashed=False).select("doc_id", "name", "folder")
    own = files.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    folder = F.expr(SIDE_FOLDER.replace("strpos", "instr"))
    return own.select("doc_id", F.concat_ws("/", folder, F.expr(SIDE_NAME)).alias("path"))


SIDECARS = f"""sides AS (
  SELECT doc_id, concat({SIDE_FOLDER}, '/', {SIDE_NAME}) AS path FROM files JOIN labels USING (doc_id))"""

#: SQL for what operators.sidecars does over these roles.
HITS = """wanted AS (
  SELECT path, folder, substr(folder, strpos(folder, '/') + 1) AS part_folder, unnest([
      {'p': 0, 'n': concat(name, '.supplemental-metadata.json'), 'm': 'Exact'},
      CASE WHEN regexp_matches(name, '^(.+)\\((\\d+)\\)\\.[^.]*$') THEN {'p': 1, 'n': concat(regexp_extract(name, '^(.+)\\((\\d+)\\)(\\.[^.]*)$', 1),
        regexp_extract(name, '^(.+)\\((\\d+)\\)(\\.[^.]*)$', 3), '.supplemental-metadata(', regexp_extract(name, '^(.+)\\((\\d+)\\)(\\.[^.]*)$', 2), ').json'), 'm': 'Numbered'} END,
      CASE WHEN regexp_matches(name, '^(.+)-edited\\.[^.]*$') THEN {'p': 1, 'n': concat(regexp_extract(name, '^(.+)-edited(\\.[^.]*)$', 1),
        regexp_extract(name, '^(.+)-edited(\\.[^.]*)$', 2), '.supplemental-metadata.json'), 'm': 'EditedOriginal'} END]) AS c
  FROM files
), have AS (
  SELECT path AS sidecar, regexp_replace(path, '/[^/]*$', '') AS sfolder, regexp_extract(path, '[^/]*$') AS sname FROM sides
), hits AS (
  SELECT DISTINCT path, sidecar, c.p AS priority, c.m AS match, CASE WHEN lower(sfolder) = lower(folder) THEN 'SameFolder' ELSE 'OtherPart' END AS place
  FROM wanted JOIN have ON c IS NOT NULL AND lower(sname) = lower(c.n) AND lower(substr(sfolder, strpos(sfolder, '/') + 1)) = lower(part_folder)
)"""

ATTACHED = """attached AS (
  SELECT f.*, h.path IS NOT NULL AS has_meta, coalesce(h.match, '') AS meta_match,
         CASE WHEN h.path IS NULL THEN 'None' WHEN h.same THEN 'SameFolder' ELSE 'OtherPart' END AS meta_place, coalesce(h.sidecars, []) AS sidecars
  FROM files f LEFT JOIN (
    SELECT path, arg_min(match, (priority, place <> 'SameFolder', sidecar)) AS match, bool_or(place = 'SameFolder') AS same,
           list(sidecar ORDER BY priority, place <> 'SameFolder', sidecar) AS sidecars FROM hits GROUP BY path) h USING (path))"""

#: Members of duplicate groups with the keeper's score and place.
MEMBERS = """base AS (
  SELECT *, regexp_matches(path, '(^|[\\\\/])Google Photos[\\\\/](Trash|Bin)([\\\\/]|$)', 'i') AS in_trash, len(string_split(path, '/')) AS depth,
         regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9 _.-]*\\.[A-Za-z0-9]+$') AND NOT regexp_matches(name, '\\(\\d+\\)')
           AND NOT regexp_matches(name, '(copy|edited|duplicate)', 'i') AS clean,
         count(*) OVER (PARTITION BY size, hash) AS n FROM attached WHERE size > 0
), scored AS (
  SELECT *, (CASE WHEN has_meta THEN 100 ELSE 0 END + CASE WHEN meta_place = 'SameFolder' THEN 2 ELSE 0 END
         + CASE WHEN depth = min(depth) OVER (PARTITION BY size, hash) THEN 5 ELSE 0 END + CASE WHEN clean THEN 1 ELSE 0 END) AS score,
         count(*) FILTER (NOT in_trash) OVER (PARTITION BY size, hash) AS n_outside, count(*) FILTER (has_meta) OVER (PARTITION BY size, hash) AS n_meta,
         count(*) FILTER (has_meta AND NOT in_trash) OVER (PARTITION BY size, hash) AS n_meta_outside
  FROM base WHERE n > 1
), placed AS (
  SELECT *, row_number() OVER w AS place, first_value(path) OVER w AS keeper, bool_and(in_trash) OVER (PARTITION BY size, hash) AS keeper_trash,
         CASE WHEN n_outside > 0 THEN n_meta_outside ELSE n_meta END AS n_able
  FROM scored WINDOW w AS (PARTITION BY size, hash ORDER BY in_trash, has_meta DESC, score DESC, length(path), lower(path), path)
), members AS (
  SELECT *, CASE WHEN place = 1 THEN 'KEEP' ELSE 'DELETE' END AS recommendation, CASE WHEN place = 1 THEN
      CASE WHEN n_able = 0 AND n_meta > 0 THEN 'KEEP: no copy outside trash has metadata; fallback order decides'
           WHEN n_able = 0 THEN 'KEEP: no copy in group has metadata; fallback order decides'
           WHEN n_able = 1 THEN 'KEEP: only copy with metadata' ELSE concat('KEEP: best-scoring of ', n_able, ' copies with metadata') END
      || CASE WHEN n_outside > 0 AND n_outside < n THEN '; trash copies excluded' ELSE '' END
    WHEN in_trash AND NOT keeper_trash THEN 'DELETE: in trash and another copy exists elsewhere'
    WHEN NOT has_meta AND n_able > 0 THEN 'DELETE: no metadata while another copy has it'
    WHEN has_meta THEN 'DELETE: another copy with metadata scored higher' ELSE 'DELETE: lower score than keeper' END AS reason
  FROM placed
)"""
