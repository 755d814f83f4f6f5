"""Queries over exact duplicates and sidecars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import scalars as S
from siftwork.operators import dedupe, sidecars, tables
from siftwork.plans import roles
from siftwork.plans.register import query
from siftwork.session import cut, ensure_checkpoint_dir, table
from siftwork.sources import files as sources


@query("SELECT doc_id, size FROM (SELECT doc_id, strlen(text) AS size, count(*) OVER (PARTITION BY strlen(text)) AS n FROM documents) WHERE n > 1 AND size > 0")
def size_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.size_candidates(roles.inventory(spark, sf_dir, hashed=False).select("doc_id", "size"))


@query("SELECT count(*) AS sizes, count(*) FILTER (n = 1) AS unique_sizes, sum(n) FILTER (n > 1) AS candidates FROM (SELECT count(*) AS n FROM documents GROUP BY strlen(text))")
def unique_by_size_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = roles.inventory(spark, sf_dir, hashed=False).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("sizes"), F.count_if(F.col("n") == 1).alias("unique_sizes"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("candidates"))


@query("SELECT strlen(text) AS size, sha256(text) AS hash, count(*) AS n_files, strlen(text) * (count(*) - 1) AS reclaim FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are hashed while they are scanned; only hashes move."""
    return dedupe.duplicate_groups(roles.inventory(spark, sf_dir).select("size", "hash"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of duplicate groups, with their sidecars: files alone in their content meet none."""
    files = cut(dedupe.duplicate_members(roles.inventory(spark, sf_dir).filter("size > 0")))
    hits = sidecars.match_sidecars(files, roles.sidecars(spark, sf_dir))
    full = sidecars.attach(files, hits).withColumns({
        "depth": S.path_depth(F.col("path")), "clean": S.is_clean_name(F.col("name")), "in_trash": S.in_trash(F.col("path")),
    })
    return dedupe.choose_keeper(full)


_CTE = f"WITH {roles.INVENTORY}, {roles.SIDECARS}, {roles.HITS}, {roles.ATTACHED}, {roles.MEMBERS} "
_HITS = f"WITH {roles.INVENTORY}, {roles.SIDECARS}, {roles.HITS} "


@query(_CTE + "SELECT doc_id, path, size, hash, in_trash, has_meta, meta_place, meta_match, score, recommendation, keeper, reason FROM members")
def exact_dup_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of a duplicate group with the choice made."""
    return members(spark, sf_dir).select(
        "doc_id", "path", "size", "hash", "in_trash", "has_meta", "meta_place", "meta_match", "score", "recommendation", "keeper", "reason"
    )


@query(
    "SELECT size, hash, 'G' || lpad(cast(row_number() OVER (ORDER BY k) AS varchar), 5, '0') AS group_id FROM "
    "(SELECT strlen(text) AS size, sha256(text) AS hash, concat(strlen(text), ', ', sha256(text)) AS k FROM documents GROUP BY text HAVING count(*) > 1)"
)
def dup_group_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.number_groups(exact_dup_groups(spark, sf_dir).select("size", "hash"))


@query(
    _CTE + """SELECT path, size, recommendation, reason, CASE WHEN recommendation = 'DELETE' THEN concat('Quarantine/', path) ELSE '' END AS destination FROM members
    UNION ALL SELECT path, size, CASE WHEN size = 0 THEN 'SKIP' ELSE 'REVIEW' END, CASE WHEN size = 0 THEN 'SKIP: empty file' ELSE 'REVIEW: not hashed' END, ''
    FROM files WHERE size = 0 OR hash IS NULL"""
)
def dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and advisory rows, in the order of the report."""
    own = members(spark, sf_dir).withColumn("destination", F.when(F.col("recommendation") == "DELETE", F.concat(F.lit("Quarantine/"), "path")).otherwise(""))
    odd = roles.inventory(spark, sf_dir).filter("size = 0 OR hash IS NULL")
    empty = F.col("size") == 0
    advice = odd.select(
        "path", "size", F.when(empty, "SKIP").otherwise("REVIEW").alias("recommendation"),
        F.when(empty, "SKIP: empty file").otherwise("REVIEW: not hashed").alias("reason"), F.lit("").alias("destination"),
        F.lit("").alias("hash"), F.lit(0).alias("score"),
    )
    rows = own.select(advice.columns).unionByName(advice)
    return rows.orderBy("size", "hash", F.desc("score"), F.length("path")).select("path", "size", "recommendation", "reason", "destination")


@query(
    _CTE + """, per AS (SELECT size, hash, count(*) FILTER (recommendation = 'DELETE') AS losers, bool_or(has_meta) AS any_meta,
      bool_and(NOT has_meta OR meta_place = 'OtherPart') AS only_other, count(*) FILTER (in_trash AND recommendation = 'DELETE') AS trash_losers FROM members GROUP BY size, hash)
    SELECT count(*) AS groups, coalesce(sum(losers), 0)::bigint AS deletes, coalesce(sum(size * losers), 0)::bigint AS reclaim_bytes,
      count(*) FILTER (any_meta) AS groups_with_metadata, count(*) FILTER (any_meta AND only_other) AS groups_only_other_part,
      coalesce(sum(trash_losers), 0)::bigint AS trash_losers FROM per"""
)
def dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_summary(members(spark, sf_dir))


@query(
    _HITS + """SELECT CASE WHEN regexp_matches(f.path, 'Google Photos/(Trash|Bin)/', 'i') THEN 'trash' ELSE 'library' END AS place,
    count(*) FILTER (h.path IS NULL) AS none, count(*) FILTER (h.same) AS same_folder, count(*) FILTER (NOT h.same) AS other_part
    FROM files f LEFT JOIN (SELECT path, bool_or(place = 'SameFolder') AS same FROM hits GROUP BY path) h USING (path) GROUP BY 1"""
)
def sidecar_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = roles.inventory(spark, sf_dir, hashed=False)
    full = sidecars.attach(files, sidecars.match_sidecars(files, roles.sidecars(spark, sf_dir)))
    kind = lambda p: F.count_if(F.col("meta_place") == p)
    return full.groupBy(F.when(S.in_trash(F.col("path")), "trash").otherwise("library").alias("place")).agg(
        kind("None").alias("none"), kind("SameFolder").alias("same_folder"), kind("OtherPart").alias("other_part")
    )


@query(
    _HITS + """SELECT count(*) AS files, sum(size)::bigint AS bytes, count(*) FILTER (h.path IS NULL) AS none, count(*) FILTER (h.same) AS same_folder, count(*) FILTER (NOT h.same) AS other_part,
    count(*) FILTER (regexp_matches(f.path, 'Google Photos/(Trash|Bin)/', 'i')) AS in_trash FROM files f LEFT JOIN (SELECT path, bool_or(place = 'SameFolder') AS same FROM hits GROUP BY path) h USING (path)"""
)
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a coverage report, gathered while the report is written."""
    files = roles.inventory(spark, sf_dir, hashed=False)
    full = sidecars.attach(files, sidecars.match_sidecars(files, roles.sidecars(spark, sf_dir))).select("path", "size", "meta_place")
    counters = {"files": F.count(F.lit(1)), "bytes": F.sum("size")}
    counters |= {n: F.count_if(F.col("meta_place") == p) for n, p in (("none", "None"), ("same_folder", "SameFolder"), ("other_part", "OtherPart"))}
    counters["in_trash"] = F.count_if(S.in_trash(F.col("path")))
    got = sources.write_report(full, f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}", counters)
    return spark.createDataFrame([tuple(got[n] for n in counters)], ", ".join(f"{n} long" for n in counters))


@query(_HITS + "SELECT doc_id, path FROM sides WHERE path NOT IN (SELECT sidecar FROM hits)")
def orphan_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = roles.sidecars(spark, sf_dir)
    return sidecars.orphans(side, sidecars.match_sidecars(roles.inventory(spark, sf_dir, hashed=False), side)).select("doc_id", "path")


@query(_HITS + "SELECT path, c.p AS priority, c.n AS name, c.m AS match FROM wanted WHERE c IS NOT NULL")
def sidecar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecars.candidate_rows(roles.inventory(spark, sf_dir, hashed=False)).select("path", "priority", "name", "match")


def _placed(place: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = sidecars.match_sidecars(roles.inventory(spark, sf_dir, hashed=False), roles.sidecars(spark, sf_dir))
        return hits.filter(F.col("place") == place).select("path", "sidecar", "priority", "match")

    return run


for _name, _place in (("sidecar_same_folder", "SameFolder"), ("sidecar_cross_part", "OtherPart")):
    _f = _placed(_place)
    _f.__name__ = _name
    query(_HITS + f"SELECT path, sidecar, priority, match FROM hits WHERE place = '{_place}'")(_f)


@query("SELECT conv_id, arg_min(role, turn) AS role FROM conversations WHERE role <> '' GROUP BY conv_id")
def sidecar_merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecars.merge_first(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("SELECT conv_id, array_to_string(list(role ORDER BY first), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def sidecar_merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sidecars.merge_union(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return out.select("conv_id", F.array_join("values", ",").alias("roles"))


@query(
    """WITH f AS (SELECT DISTINCT source, lang, doc_id % 29 AS k, source IN ('src1', 'src2', 'src4') AND doc_id % 29 % 4 < 3 AS loser FROM documents),
    s AS (SELECT DISTINCT lang, doc_id % 29 AS k, concat(source, '/Google Photos/', lang, '/IMG_', doc_id % 29, '.jpg.supplemental-metadata.json') AS sidecar FROM documents WHERE source IN ('src1', 'src5'))
    SELECT DISTINCT sidecar FROM s WHERE EXISTS (SELECT 1 FROM f WHERE f.lang = s.lang AND f.k = s.k AND f.loser) AND EXISTS (SELECT 1 FROM f WHERE f.lang = s.lang AND f.k = s.k AND NOT f.loser)"""
)
def needed_by_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars that losers and kept files of several parts share, by folder and name below the part."""
    k = (F.col("doc_id") % 29).cast("string")
    docs = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("/Google Photos/"), "lang", F.lit("/IMG_"), k, F.lit(".jpg")).alias("rel"), (F.col("doc_id") % 29 % 4 < 3).alias("often"))
    docs = docs.distinct()
    files = docs.select(F.concat("source", "rel").alias("path"), (F.col("source").isin("src1", "src2", "src4") & F.col("often")).alias("loser"))
    side = docs.filter(F.col("source").isin("src1", "src5")).select(F.concat("source", "rel", F.lit(S.SIDECAR_SUFFIX)).alias("path"))
    return sidecars.still_needed(files.filter("loser"), files.filter("NOT loser"), sidecars.match_sidecars(files, side))


@query(
    """SELECT kind, in_trash, clean, count(*) AS n FROM (SELECT
      CASE WHEN regexp_matches(url, '\\.(html?|json)([?#]|$)', 'i') THEN 'sidecar' WHEN regexp_matches(url, '/$') THEN 'media' ELSE 'other' END AS kind,
      regexp_matches(url, '(^|[\\\\/])Google Photos[\\\\/](Trash|Bin)([\\\\/]|$)', 'i') AS in_trash,
      regexp_matches(n, '^[A-Za-z0-9][A-Za-z0-9 _.-]*\\.[A-Za-z0-9]+$') AND NOT regexp_matches(n, '\\(\\d+\\)') AND NOT regexp_matches(n, '(copy|edited|duplicate)', 'i') AS clean
      FROM (SELECT url, regexp_extract(url, '[^/]*$') AS n FROM pages)) GROUP BY ALL"""
)
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    kind = F.when(url.rlike(r"(?i)\.(html?|json)([?#]|$)"), "sidecar").when(url.rlike("/$"), "media").otherwise("other")
    rows = table(spark, sf_dir, "pages").select(kind.alias("kind"), S.in_trash(url).alias("in_trash"), S.is_clean_name(S.base(url)).alias("clean"))
    return rows.groupBy("kind", "in_trash", "clean").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT page_id, regexp_replace(url, '^[^/]*/', '') AS part_rel, len(string_split(url, '/')) AS depth, length(url) AS path_length,
    starts_with(lower(url) || '/', lower(regexp_extract(url, '^([^/]*//[^/]*)', 1)) || '/') AS overlaps,
    regexp_replace(CASE WHEN regexp_matches(n, '.+\\.[^.]*$') THEN regexp_extract(n, '^(.+)\\.[^.]*$', 1) ELSE n END, '\\(\\d+\\)$', '')
      || CASE WHEN regexp_matches(n, '.+\\.[^.]*$') THEN regexp_extract(n, '^.+(\\.[^.]*)$', 1) ELSE '' END AS base_name
    FROM (SELECT *, lower(regexp_extract(url, '[^/]*$')) AS n FROM pages)"""
)
def path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", S.part_relative(url).alias("part_rel"), S.path_depth(url).alias("depth"), F.length(url).alias("path_length"),
        S.paths_overlap(url, F.regexp_extract(url, "^([^/]*//[^/]*)", 1)).alias("overlaps"), S.base_name(S.base(url)).alias("base_name"),
    )


@query("SELECT doc_id, substr(sha1(concat(lower(concat(source, '/', lang, '/', doc_id)), '|', strlen(text), '|', doc_id)), 1, 20) AS key FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", S.cache_key(path, F.octet_length("text"), F.col("doc_id")).alias("key"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE nullif(l.quality, 0) IS NULL AND nullif(l.toxic, 0) IS NULL")
def cache_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a cached quality and without a cached error."""
    zero = lambda c: F.when(F.col(c) != 0, F.col(c))
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id"), zero("quality").alias("value"), zero("toxic").alias("error"))
    return tables.to_do(table(spark, sf_dir, "documents").select("doc_id"), cache, "doc_id", "value", "error")


@query(
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0"
)
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return tables.upsert(old, old.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


@query(
    """SELECT c_custkey AS zip, n.size, CASE WHEN o.size = n.size AND coalesce(o.hash, '') <> '' THEN o.hash END AS sha, NOT coalesce(o.size = n.size AND coalesce(o.hash, '') <> '', false) AS rehash
    FROM (SELECT c_custkey, c_nationkey AS size FROM customer) n LEFT JOIN
    (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS size, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE sha256(c_name) END AS hash
     FROM customer WHERE c_custkey % 2 = 0) o USING (c_custkey)"""
)
def hash_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("zip"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END").alias("size"),
        F.expr("CASE WHEN c_custkey % 5 = 0 THEN '' ELSE sha2(c_name, 256) END").alias("sha"),
    )
    return tables.reuse_hash(c.select(F.col("c_custkey").alias("zip"), F.col("c_nationkey").alias("size")), old, "zip", "size", "sha").select("zip", "size", "sha", "rehash")


@query("SELECT source, lang, count(*) AS n, sum(strlen(text))::bigint AS bytes, count(*) FILTER (strlen(text) > 4000) AS rejects, coalesce(sum(strlen(text)) FILTER (strlen(text) > 4000), 0)::bigint AS reject_bytes FROM documents GROUP BY source, lang")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("size") > 4000
    return (
        roles.inventory(spark, sf_dir, hashed=False).groupBy("source", "lang")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count_if(big).alias("rejects"), F.sum(F.when(big, F.col("size")).otherwise(0)).alias("reject_bytes"))
        .orderBy(F.desc("n"), "source", "lang")
    )


@query(
    "SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY lower(source), doc_id) - 1 AS position, count(*) OVER () AS n FROM documents) "
    "WHERE position IN (SELECT (i * (SELECT count(*) FROM documents)) // 300 FROM range(300) r(i)) OR n <= 300"
)
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 documents at even distances."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return tables.systematic_sample(docs, [F.lower("source"), F.col("doc_id")], 300).select("doc_id", "position")


@query("SELECT event_id, event_type, (props->>'k')::bigint AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "SELECT lang, round_even(sum(c) FILTER (r <= 4) / max(t), 9) AS share FROM (SELECT lang, c, row_number() OVER (PARTITION BY lang ORDER BY c DESC, source) AS r, sum(c) OVER (PARTITION BY lang) AS t "
    "FROM (SELECT lang, source, count(*) AS c FROM documents GROUP BY lang, source)) GROUP BY lang"
)
def flatness_topk_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.top_share(table(spark, sf_dir, "documents"), "lang", "source").select("lang", F.bround("share", 9).alias("share"))


@query(
    r"""SELECT page_id, regexp_matches(url, '[?#]') AS odd, concat('"', replace(url, '"', '""'), '"') AS csv,
      replace(replace(replace(replace(substr(html, 1, 300), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe,
      CASE WHEN n >= 1000000 THEN concat(round_even(n / 1000000.0, 1)::double, ' MB') WHEN n >= 1000 THEN concat(round_even(n / 1000.0, 1)::double, ' kB') ELSE concat(n, ' B') END AS size,
      regexp_matches(p, '(^|[/\\])\.\.([/\\]|$)') OR regexp_matches(p, '^([/\\]|[A-Za-z]:)') AS unsafe, regexp_matches(concat(p, CASE WHEN page_id % 3 = 0 THEN '[1]' ELSE '' END), '[][]') AS wildcard
    FROM (SELECT *, strlen(html) AS n, CASE page_id % 4 WHEN 0 THEN concat('../', page_id) WHEN 1 THEN concat('/', page_id) WHEN 2 THEN concat('a/..', page_id) ELSE concat('a/', page_id) END AS p FROM pages)"""
)
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatters for pages and lists, and the path tests."""
    i = F.col("page_id")
    name = i.cast("string")
    path = F.when(i % 4 == 0, F.concat(F.lit("../"), name)).when(i % 4 == 1, F.concat(F.lit("/"), name)).when(i % 4 == 2, F.concat(F.lit("a/.."), name)).otherwise(F.concat(F.lit("a/"), name))
    marked = F.concat(path, F.when(i % 3 == 0, "[1]").otherwise(""))
    return table(spark, sf_dir, "pages").select(
        i, F.col("url").rlike("[?#]").alias("odd"), S.csv_quote(F.col("url")).alias("csv"), S.html_escape(F.substring("html", 1, 300)).alias("safe"),
        S.bytes_text(F.octet_length("html").cast("long")).alias("size"), S.unsafe_entry(path).alias("unsafe"), S.has_wildcard(marked).alias("wildcard"),
    )


@query(
    """SELECT p_partkey, CASE WHEN lower(model) LIKE lower(make) || '%' THEN model ELSE trim(concat(make, ' ', model)) END AS camera FROM
    (SELECT p_partkey, trim(coalesce(nullif(p_brand, 'Brand#11'), '')) AS make, trim(CASE WHEN p_partkey % 2 = 0 THEN concat(lower(p_brand), ' ', p_type) ELSE p_type END) AS model FROM part)"""
)
def camera_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make and model in one, without the make twice."""
    make = F.when(F.col("p_brand") != "Brand#11", F.col("p_brand"))
    model = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lower("p_brand"), F.lit(" "), "p_type")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", S.camera_label(make, model).alias("camera"))


@query(
    """SELECT doc_id, CASE WHEN parts[4] NOT SIMILAR TO 'Photos from [0-9]{4}' AND len(parts) = 4 AND parts[2] = 'Takeout' AND parts[3] = 'Google Photos' THEN parts[4] END AS album
    FROM (SELECT doc_id, string_split(CASE doc_id % 5 WHEN 0 THEN concat(source, '/Takeout/Google Photos/', lang) WHEN 1 THEN concat(source, '/Takeout/Google Photos/Photos from ', 2000 + doc_id % 20)
      WHEN 2 THEN concat(source, '/Takeout/Google Photos/', lang, '/deeper') WHEN 3 THEN concat(source, '/Takeout/Drive/', lang) ELSE concat('Takeout/Google Photos/', lang) END, '/') AS parts FROM documents)"""
)
def album_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The album of a folder: exactly '<part>/Takeout/Google Photos/<album>', and no year's folder."""
    i = F.col("doc_id")
    at = lambda *parts: F.concat(*[F.lit(p) if "/" in p else F.col(p) for p in parts])
    folder = (
        F.when(i % 5 == 0, at("source", "/Takeout/Google Photos/", "lang"))
        .when(i % 5 == 1, F.concat("source", F.lit("/Takeout/Google Photos/Photos from "), (2000 + i % 20).cast("string")))
        .when(i % 5 == 2, at("source", "/Takeout/Google Photos/", "lang", "/deeper"))
        .when(i % 5 == 3, at("source", "/Takeout/Drive/", "lang"))
        .otherwise(at("Takeout/Google Photos/", "lang"))
    )
    return table(spark, sf_dir, "documents").select(i, S.album_of(folder).alias("album"))
