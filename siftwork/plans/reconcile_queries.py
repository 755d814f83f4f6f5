"""Queries over archives, trash, rejects, backups, albums and action plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import scalars as S
from siftwork.operators import decisions as D
from siftwork.operators import planner, reconcile, tables
from siftwork.plans.register import query
from siftwork.session import cut, table
from siftwork.sources import files
from siftwork.streaming import events as stream

ENTRY = "concat('Takeout/', CASE WHEN l_linenumber = 7 THEN 'Google Photos/Trash/' ELSE '' END, l_orderkey, '_', l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN '.json' ELSE '.jpg' END)"
_ZIP = f"""lines AS (SELECT *, {ENTRY} AS entry, l_quantity::bigint AS size, l_orderkey // 16 AS archive FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)),
  found AS (SELECT *, CASE WHEN l_suppkey % 3 <> 0 OR archive % 4 = 0 THEN 'present' WHEN l_suppkey % 9 = 0 THEN 'quarantine'
    WHEN regexp_matches(entry, 'Google Photos/(Trash|Bin)/') THEN 'trash' ELSE 'missing' END AS place FROM lines),
  zips AS (SELECT DISTINCT o_orderkey // 16 AS archive FROM orders)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as archive entries; a key that repeats is one entry. Worked out once for all that is asked of them."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    lines = lines.select("l_orderkey", "l_linenumber", "x.*")
    return cut(
        lines.select(
            F.expr(ENTRY).alias("entry"), F.col("l_quantity").cast("long").alias("size"), F.floor(F.col("l_orderkey") / 16).alias("archive"), "l_suppkey", "l_orderkey"
        )
    )


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _entries(spark, sf_dir)
    kept = (F.col("l_suppkey") % 3 != 0) | (F.col("archive") % 4 == 0)
    disk = lambda c: lines.filter(c).select(F.col("entry").alias("rel"), "size")
    return reconcile.find_entries(lines.select("archive", "entry", "size"), disk(kept), disk(~kept & (F.col("l_suppkey") % 9 == 0)))


@query(
    f"""WITH {_ZIP}, per AS (SELECT archive, count(entry) AS files, count(*) FILTER (place = 'present') AS present, count(*) FILTER (place = 'quarantine') AS in_quarantine,
      count(*) FILTER (place = 'trash') AS missing_trash, count(*) FILTER (place = 'missing') AS missing, count(*) FILTER (place = 'missing' AND entry LIKE '%.json') AS missing_json
      FROM zips LEFT JOIN found USING (archive) GROUP BY archive)
    SELECT *, CASE WHEN files = 0 THEN 'EMPTY ZIP' WHEN present + in_quarantine = 0 THEN 'NOT EXTRACTED' WHEN missing = 0 AND missing_trash = 0 THEN 'EXTRACTED'
      WHEN missing = 0 THEN 'EXTRACTED (Trash removed)' ELSE 'PARTIAL' END AS status, CASE WHEN files = 0 THEN 100.0::double ELSE round_even(100.0 * (present + in_quarantine) / files, 1)::double END AS percent FROM per"""
)
def zip_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    zips = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 16).alias("archive")).distinct()
    return reconcile.archive_report(_found(spark, sf_dir), zips)


@query(f"WITH {_ZIP} SELECT archive, place, entry FROM (SELECT archive, entry, row_number() OVER (PARTITION BY archive ORDER BY entry) AS place FROM found WHERE place = 'missing') WHERE place <= 3")
def zip_first_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three missing entries of each archive."""
    return tables.first_n(_found(spark, sf_dir).filter("place = 'missing'").drop("place"), "archive", 3, F.col("entry")).select("archive", "place", "entry")


@query(
    f"""WITH {_ZIP}, v AS (SELECT archive, CASE WHEN l_suppkey % 4 = 0 THEN 'old' ELSE concat('part', l_orderkey % 2) END AS folder, count(*) AS votes FROM lines WHERE l_suppkey % 3 <> 0 GROUP BY ALL),
    n AS (SELECT archive, count(*) AS n FROM lines GROUP BY archive)
    SELECT archive, folder, votes FROM (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY votes DESC, folder) AS r FROM v) JOIN n USING (archive) WHERE r = 1 AND votes >= n * 0.3"""
)
def zip_folder_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _entries(spark, sf_dir)
    folder = F.when(F.col("l_suppkey") % 4 == 0, "old").otherwise(F.concat(F.lit("part"), (F.col("l_orderkey") % 2).cast("string")))
    disk = lines.filter("l_suppkey % 3 <> 0").select(folder.alias("folder"), F.col("entry").alias("rel"), "size")
    return reconcile.vote_folder(lines.select("archive", "entry", "size"), disk, 0.3)


@query(
    f"WITH {_ZIP} SELECT archive, concat('zip-', archive, '.zip') AS zip_name, regexp_replace(concat('account-', archive, '-001'), '-[0-9]+[A-Z]?$', '') AS source, count(*) AS files, count(*) FILTER (NOT ends_with(entry, '.json')) AS photos, "
    "CASE WHEN count(*) FILTER (place = 'present') = 0 THEN 'not extracted' WHEN count(*) FILTER (place = 'present') = count(*) THEN 'extracted, not yet processed' "
    "ELSE concat('extracted and processed (', count(*) FILTER (place <> 'present'), ' of ', count(*), ' files since moved on)') END AS extraction FROM found GROUP BY archive"
)
def zip_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _found(spark, sf_dir).groupBy("archive").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.col("entry").endswith(".json")).alias("photos"), F.count_if(F.col("place") == "present").alias("p")
    )
    moved = F.concat(F.lit("extracted and processed ("), (F.col("files") - F.col("p")).cast("string"), F.lit(" of "), F.col("files").cast("string"), F.lit(" files since moved on)"))
    name = F.concat(F.lit("account-"), F.col("archive").cast("string"), F.lit("-001"))
    return per.select(
        "archive", F.concat(F.lit("zip-"), F.col("archive").cast("string"), F.lit(".zip")).alias("zip_name"), F.regexp_replace(name, "-[0-9]+[A-Z]?$", "").alias("source"), "files", "photos",
        F.when(F.col("p") == 0, "not extracted").when(F.col("p") == F.col("files"), "extracted, not yet processed").otherwise(moved).alias("extraction"),
    )


_TRASH = """t AS (SELECT doc_id AS id, source, text, strlen(text) AS size, lang <> 'fr' AS is_media FROM documents WHERE source IN ('src3', 'src4')),
  o AS (SELECT doc_id, text, CASE WHEN source = 'src5' THEN 1 ELSE 0 END AS prio FROM documents WHERE source NOT IN ('src3', 'src4')),
  m AS (SELECT t.id, min(prio) AS prio, arg_min(o.doc_id, (o.prio, concat('d', lpad(o.doc_id::varchar, 12, '0')))) AS other FROM t JOIN o ON t.text = o.text GROUP BY t.id),
  s AS (SELECT t.*, CASE WHEN NOT is_media THEN 'NotMedia' WHEN size > 0 AND prio = 0 THEN 'InLibrary' WHEN size > 0 AND prio = 1 THEN 'QuarantineOnly' ELSE 'TrashOnly' END AS status,
    coalesce('d' || lpad(m.other::varchar, 12, '0'), '') AS other FROM t LEFT JOIN m USING (id))"""


def _reader(spark: SparkSession, sf_dir: str, path: Column) -> Callable[[DataFrame], DataFrame]:
    """Reads the contents behind paths: here texts of documents."""
    texts = table(spark, sf_dir, "documents").select(path, S.content_hash(F.encode("text", "UTF-8")).alias("hash"))
    return lambda paths: texts.join(paths, "path", "left_semi")


def _trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path")
    docs = table(spark, sf_dir, "documents").select(path, F.col("doc_id").alias("id"), "source", "lang", F.octet_length("text").cast("long").alias("size"))
    trash = F.col("source").isin("src3", "src4")
    side = lambda c: docs.filter(~trash & c).select("path", "size")
    wanted = docs.filter(trash).select("path", "id", "source", (F.col("lang") != "fr").alias("is_media"), "size")
    found = reconcile.content_elsewhere(wanted, side(F.col("source") != "src5"), side(F.col("source") == "src5"), _reader(spark, sf_dir, path))
    return found.withColumn("status", D.trash_status(F.col("is_media"), F.col("size"), F.col("in_library"), F.col("in_quarantine")))


@query(f"WITH {_TRASH} SELECT id, size, is_media, status, other FROM s")
def trash_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trash(spark, sf_dir).select("id", "size", "is_media", "status", "other")


@query(
    f"WITH {_TRASH} SELECT source, count(*) AS files, sum(size)::bigint AS bytes, count(*) FILTER (is_media) AS media, count(*) FILTER (status = 'InLibrary') AS in_library, "
    "count(*) FILTER (status = 'QuarantineOnly') AS quarantine_only, count(*) FILTER (status = 'TrashOnly') AS trash_only FROM s GROUP BY source"
)
def trash_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda v: F.count_if(F.col("status") == v)
    return _trash(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if("is_media").alias("media"), count("InLibrary").alias("in_library"),
        count("QuarantineOnly").alias("quarantine_only"), count("TrashOnly").alias("trash_only"),
    )


@query(
    """WITH h AS (SELECT text, count(*) FILTER (doc_id % 3 = 1) > 0 AS lib, count(*) FILTER (doc_id % 3 = 2) > 0 AS qua FROM documents WHERE doc_id % 3 <> 0 GROUP BY text)
    SELECT d.source AS archive, count(*) AS missing, count(*) FILTER (h.lib) AS in_source, count(*) FILTER (NOT h.lib AND h.qua) AS in_quarantine_only, count(*) FILTER (h.text IS NULL) AS nowhere
    FROM documents d LEFT JOIN h USING (text) WHERE d.doc_id % 3 = 0 GROUP BY d.source"""
)
def missing_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what archives lack is somewhere else by size and content: in the library, else in quarantine."""
    path = F.col("doc_id").cast("string").alias("path")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("archive"), F.octet_length("text").alias("size"), path)
    side = lambda k: docs.filter(F.col("id") % 3 == k)
    found = reconcile.content_elsewhere(side(0), side(1), side(2), _reader(spark, sf_dir, path))
    return found.groupBy("archive").agg(
        F.count(F.lit(1)).alias("missing"), F.count_if("in_library").alias("in_source"), F.count_if("in_quarantine").alias("in_quarantine_only"),
        F.count_if(~F.col("in_library") & ~F.col("in_quarantine")).alias("nowhere"),
    )


_REJECT = """r AS (SELECT doc_id, concat(CASE WHEN doc_id % 17 = 0 THEN 'Else/' ELSE 'Root/' END, doc_id) AS path, strlen(text) AS size, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN strlen(text) + 1 ELSE strlen(text) END AS actual,
    CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 WHEN doc_id % 13 = 0 THEN doc_id + 100000000 END AS copy_of, lang AS category FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0),
  j AS (SELECT *, copy_of IN (SELECT doc_id FROM documents) AS there, copy_of IN (SELECT doc_id FROM r) AS rejected FROM r),
  s AS (SELECT *, CASE WHEN path NOT LIKE 'Root/%' THEN 'Not under the root' WHEN actual IS NULL THEN 'File no longer exists' WHEN actual <> size THEN 'File changed since it was classified'
    WHEN copy_of IS NOT NULL AND NOT there THEN 'The better copy no longer exists' WHEN copy_of IS NOT NULL AND rejected THEN 'The better copy is also marked for removal' ELSE '' END AS detail FROM j),
  p AS (SELECT *, CASE detail WHEN '' THEN 'Ready' WHEN 'File no longer exists' THEN 'Missing' ELSE 'Blocked' END AS status, concat('Holding/', substr(path, 6)) AS destination FROM s)"""


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").cast("long").alias("size"))
    marked = docs.filter("doc_id % 2 = 0 OR doc_id % 3 = 0").select(
        "doc_id", F.concat(F.when(i % 17 == 0, "Else/").otherwise("Root/"), i.cast("string")).alias("path"), "size",
        F.when(i % 11 == 0, None).when(i % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("actual"),
        F.when(i % 5 == 0, i + 1).when(i % 13 == 0, i + 100000000).alias("copy_of"), F.col("lang").alias("category"),
    )
    have = lambda df, name: df.select(F.col("doc_id").alias("copy_of")).withColumn(name, F.lit(True))
    full = marked.join(have(docs, "there"), "copy_of", "left").join(have(marked, "rejected"), "copy_of", "left").fillna(False, ["there", "rejected"])
    status = D.reject_status(F.col("path").startswith("Root/"), F.col("actual"), F.col("size"), F.col("copy_of").cast("string"), F.col("there"), F.col("rejected"))
    return full.withColumn("s", status).select("doc_id", "path", F.concat(F.lit("Holding/"), F.expr("substr(path, 6)")).alias("destination"), "size", "category", "s.status", "s.detail")


@query(f"WITH {_REJECT} SELECT doc_id, path, destination, size, category, status, detail FROM p")
def reject_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejects(spark, sf_dir)


@query(f"WITH {_REJECT} SELECT category, detail, count(*) AS n, sum(size)::bigint AS bytes, count(*) FILTER (status = 'Ready') AS ready FROM p GROUP BY category, detail")
def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejects(spark, sf_dir).groupBy("category", "detail").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count_if(F.col("status") == "Ready").alias("ready"))


_OVERLAY = """d AS (SELECT doc_id, lang AS category, ['keep', 'review', 'reject'][(doc_id % 3 + 1)::int] AS suggestion, CASE WHEN doc_id % 10 = 0 THEN 'keep' WHEN doc_id % 10 = 1 THEN 'reject' END AS choice,
  (doc_id % 100) / 100.0::double AS confidence, n_chars AS bytes FROM documents), o AS (SELECT *, coalesce(choice, CASE WHEN suggestion = 'reject' THEN 'reject' ELSE 'keep' END) AS decision FROM d)"""


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("category"), F.element_at(F.array(F.lit("keep"), F.lit("review"), F.lit("reject")), (i % 3 + 1).cast("int")).alias("suggestion"),
        F.when(i % 10 == 0, "keep").when(i % 10 == 1, "reject").alias("choice"), ((i % 100) / F.lit(100.0)).alias("confidence"), F.col("n_chars").alias("bytes"),
    )
    return rows.withColumn("decision", F.coalesce("choice", F.when(F.col("suggestion") == "reject", "reject").otherwise("keep")))


@query(f"WITH {_OVERLAY} SELECT doc_id, category, decision, confidence FROM o WHERE decision = 'reject' AND confidence >= 0.5")
def decision_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer's page shows for 'reject' from a confidence on, in its order."""
    return _overlay(spark, sf_dir).filter("decision = 'reject' AND confidence >= 0.5").orderBy(F.desc("confidence"), "doc_id").select("doc_id", "category", "decision", "confidence")


@query(f"WITH {_OVERLAY} SELECT category, count(*) AS n, count(*) FILTER (decision = 'reject') AS rejected, coalesce(sum(bytes) FILTER (decision = 'reject'), 0)::bigint AS bytes FROM o GROUP BY category")
def overlay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("decision") == "reject"
    return _overlay(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("rejected"), F.sum(F.when(out, F.col("bytes")).otherwise(0)).alias("bytes"))


_BACKUP = """b AS (SELECT c_custkey AS rel, c_nationkey AS size, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS b_size,
  sha256(c_name) AS hash, CASE WHEN c_custkey % 7 = 0 THEN sha256('x') ELSE sha256(c_name) END AS b_hash FROM customer WHERE c_custkey % 11 <> 0)"""


def _backup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rel"), F.col("c_nationkey").alias("size"), F.sha2("c_name", 256).alias("hash"))
    size = F.when(F.col("rel") % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))
    backup = c.filter("rel % 3 <> 0").select("rel", size.alias("size"), F.when(F.col("rel") % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("hash")).alias("hash"))
    return c.filter("rel % 11 <> 0"), backup


@query(f"WITH {_BACKUP} SELECT status, count(*) AS n FROM (SELECT CASE WHEN b_size IS NULL THEN 'MissingOnBackup' WHEN b_size <> size THEN 'SizeDiffers' WHEN b_hash <> hash THEN 'HashDiffers' ELSE 'OK' END AS status FROM b) GROUP BY status")
def backup_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.verify_backup(*_backup(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS rel FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 11 = 0")
def mirror_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mirror would delete: files on the backup alone."""
    source, backup = _backup(spark, sf_dir)
    return backup.join(source, "rel", "left_anti").select("rel")


_MANIFEST = "m AS (SELECT event_id AS seq, ['MovedMedia', 'MovedMetadata', 'ReviewRequired'][(event_id % 3 + 1)::int] AS action, concat('a/', event_id) AS source, concat('q/', event_id) AS destination, user_id AS size FROM events)"


@query(f"WITH {_MANIFEST} SELECT seq, destination AS from_path, source AS to_path, size FROM m WHERE action IN ('MovedMedia', 'MovedMetadata')")
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restore(spark, sf_dir).orderBy(F.desc("seq"))


def _restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    action = F.element_at(F.array(F.lit("MovedMedia"), F.lit("MovedMetadata"), F.lit("ReviewRequired")), (i % 3 + 1).cast("int"))
    text = lambda p: F.concat(F.lit(p), i.cast("string"))
    manifest = table(spark, sf_dir, "events").select(i.alias("seq"), action.alias("action"), text("a/").alias("source"), text("q/").alias("destination"), F.col("user_id").alias("size"))
    return planner.restore_plan(manifest)


@query(f"WITH {_MANIFEST} SELECT count(*) AS planned, (SELECT count(*) FROM events WHERE event_id % 3 < 2) AS expected FROM m WHERE action <> 'ReviewRequired'")
def plan_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's size, which the guard has compared with what was expected."""
    expected = table(spark, sf_dir, "events").filter("event_id % 3 < 2").count()
    plan = planner.check_expected(_restore(spark, sf_dir), expected)
    return plan.agg(F.count(F.lit(1)).alias("planned")).withColumn("expected", F.lit(expected).cast("long"))


@query(
    """WITH p AS (SELECT d.doc_id, d.lang AS album, concat('p', lpad(doc_id::varchar, 12, '0')) AS path, sha256(text) AS fp, doc_id % 50 AS base, doc_id % 3 AS k FROM documents d),
    f AS (SELECT base, fp, min(path) AS found FROM p WHERE k <> 0 GROUP BY base, fp),
    e AS (SELECT album, path, false AS lost FROM p WHERE k = 1 UNION ALL SELECT album, found, true FROM p LEFT JOIN f USING (base, fp) WHERE k = 0)
    SELECT album, count(DISTINCT path) AS n_files, min(path) AS first_file, max(path) AS last_file, count(*) FILTER (lost AND path IS NOT NULL) AS recovered, count(*) FILTER (path IS NULL) AS not_in_library FROM e GROUP BY album"""
)
def album_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("album"), F.concat(F.lit("p"), F.lpad(i.cast("string"), 12, "0")).alias("path"), (i % 50).alias("base_name"), F.sha2(F.encode("text", "UTF-8"), 256).alias("fingerprint"), (i % 3).alias("k")
    )
    return reconcile.album_members(docs.filter("k = 1"), docs.filter("k = 0"), docs.filter("k <> 0").select("path", "base_name", "fingerprint"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the streaming aggregate over the table as a batch."""
    return stream.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.bround("total", 4))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions by a gap of 30 minutes."""
    return stream.sessions(table(spark, sf_dir, "events"))


@query("SELECT CASE WHEN k = 1 THEN b ELSE a END AS path, CASE WHEN k = 1 THEN bs ELSE as_ END AS size, CASE WHEN k = 1 THEN a ELSE b END AS copy_of FROM (SELECT p_partkey AS a, p_partkey + 1 AS b, p_size AS as_, p_size + 1 AS bs, p_partkey % 3 AS k FROM part) WHERE k <> 0")
def pair_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    pairs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), F.col("p_size").alias("a_size"), (F.col("p_size") + 1).alias("b_size"),
        F.when(k == 1, "A").when(k == 2, "B").otherwise("both").alias("decision"),
    )
    return planner.pair_rejects(pairs)


@query("SELECT DISTINCT c_nationkey AS path, c_acctbal AS size FROM customer WHERE c_custkey % 4 <> 0 AND (c_nationkey, c_acctbal) IN (SELECT c_nationkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0)")
def keeper_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keepers that a second scan finds unchanged."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("path"), F.col("c_acctbal").alias("size"))
    return reconcile.unchanged(c.filter("c_custkey % 4 <> 0"), c.filter("c_custkey % 3 = 0"), "path", "size")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS album, CASE WHEN o_orderkey % 2 = 0 THEN concat('library/albums/', lower(o_orderpriority)) ELSE 'Library/2022' END AS dir FROM orders) WHERE album IS NOT NULL AND lower(dir) <> lower(concat('Library/Albums/', album))")
def albums_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(
        i, F.when(i % 3 == 0, F.col("o_orderpriority")).alias("album"), F.when(i % 2 == 0, F.concat(F.lit("library/albums/"), F.lower("o_orderpriority"))).otherwise("Library/2022").alias("dir")
    )
    return planner.albums_only(files).select("o_orderkey")


@query("WITH t AS (SELECT conv_id, arg_min(role, turn) AS title FROM conversations WHERE turn > 0 AND conv_id % 4 <> 0 GROUP BY conv_id) SELECT conv_id AS album, coalesce(title, conv_id::varchar) AS title, first, last FROM (SELECT conv_id, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY conv_id) LEFT JOIN t USING (conv_id)")
def album_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("album"), F.col("turn").alias("date"), "role")
    return reconcile.album_titles(c, c.filter("date > 0 AND album % 4 <> 0").select("album", F.col("date").alias("seen"), F.col("role").alias("title")))


@query(f"WITH {_OVERLAY} SELECT doc_id, concat('{{\"id\":', doc_id, ',\"c\":\"', category, '\",\"s\":\"', suggestion, '\",\"b\":', bytes, '}}') AS row FROM o WHERE category = 'en' AND confidence >= 0.25 AND doc_id::varchar LIKE '%7%'")
def triage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact rows of a reviewer's page: one category, from a confidence on, with a text in their name."""
    shown = _overlay(spark, sf_dir).filter((F.col("category") == "en") & (F.col("confidence") >= 0.25) & F.col("doc_id").cast("string").contains("7"))
    return shown.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("category").alias("c"), F.col("suggestion").alias("s"), F.col("bytes").alias("b"))).alias("row"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'ReviewRequired' WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'AlreadyInQuarantine'
      WHEN event_id % 3 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN 'ReviewRequired' WHEN event_id % 17 = 0 THEN 'QuarantineFailedRolledBack' ELSE 'MovedMedia' END AS outcome FROM events"""
)
def quarantine_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each planned move comes to."""
    by = lambda n: F.col("event_id") % n == 0
    path = F.when(by(13), "a[1].jpg").otherwise("a.jpg")
    return table(spark, sf_dir, "events").select("event_id", D.quarantine_outcome(~by(5), ~by(7), by(3), by(2), by(11), path, ~by(17)).alias("outcome"))


_BOXES = [("Asia/Hong_Kong", 22.1, 22.6, 113.8, 114.4), ("Asia/Shanghai", 18.0, 54.0, 73.0, 135.0), ("Europe/Berlin", 47.0, 55.0, 6.0, 15.0), ("Europe/Paris", 42.0, 51.0, -5.0, 8.0), ("America/New_York", 25.0, 45.0, -85.0, -67.0)]


@query(
    "WITH z(zone, south, north, west, east) AS (VALUES " + ", ".join(map(str, _BOXES)) + """), p AS (SELECT c_custkey, (c_custkey * 37 % 1800) / 10.0::double - 90 AS lat, (c_custkey * 101 % 3600) / 10.0::double - 180 AS lon FROM customer)
    SELECT c_custkey, lat, lon, coalesce((SELECT arg_min(zone, (north - south) * (east - west)) FROM z WHERE lat BETWEEN south AND north AND lon BETWEEN west AND east), 'UTC') AS zone FROM p"""
)
def zones_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone around each place, else UTC."""
    key = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select(key, ((key * 37 % 1800) / F.lit(10.0) - 90).alias("lat"), ((key * 101 % 3600) / F.lit(10.0) - 180).alias("lon"))
    return planner.zone_of(places, spark.createDataFrame(_BOXES, "zone string, south double, north double, west double, east double"), "UTC")


@query(
    r"""WITH e AS (SELECT event_id, event_id // 1000 AS position, concat('zips/', CASE WHEN event_id % 9 = 0 THEN 'old/' ELSE '' END, 'z', event_id % 5, CASE WHEN event_id % 2 = 0 THEN '.zip' ELSE '.ZIP' END) AS archive,
      CASE WHEN event_id % 11 = 0 THEN concat('../', event_id) WHEN event_id % 6 = 0 THEN concat('D/', event_id // 8, '.JPG') ELSE concat('d/', event_id // 8, '.jpg') END AS entry, event_id % 97 = 0 AS unreadable FROM events),
    d AS (SELECT *, concat('out/', regexp_replace(regexp_extract(archive, '([^/]*)$', 1), '\.zip$', '', 'i')) AS folder FROM e),
    c AS (SELECT *, concat(folder, '/', entry) AS destination, NOT unreadable AND NOT regexp_matches(entry, '(^|/)\.\.(/|$)') AS able FROM d)
    SELECT event_id AS entry_id, destination, CASE WHEN unreadable THEN 'Unreadable' WHEN folder = 'out/z4' THEN 'Skip' WHEN NOT able THEN 'Blocked'
      WHEN row_number() OVER (PARTITION BY lower(destination), able ORDER BY archive, position) > 1 THEN 'Conflict' ELSE 'Extract' END AS action FROM c"""
)
def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each entry of the archives would go; unsafe ones, second ones of a place and archives that are there already don't."""
    i = F.col("event_id")
    number = i.cast("string")
    eighth = F.floor(i / 8).cast("string")
    archive = F.concat(F.lit("zips/"), F.when(i % 9 == 0, "old/").otherwise(""), F.lit("z"), (i % 5).cast("string"), F.when(i % 2 == 0, ".zip").otherwise(".ZIP"))
    entry = F.when(i % 11 == 0, F.concat(F.lit("../"), number)).when(i % 6 == 0, F.concat(F.lit("D/"), eighth, F.lit(".JPG"))).otherwise(F.concat(F.lit("d/"), eighth, F.lit(".jpg")))
    entries = table(spark, sf_dir, "events").select(i.alias("entry_id"), F.floor(i / 1000).alias("position"), archive.alias("archive"), entry.alias("entry"), (i % 97 == 0).alias("unreadable"))
    there = table(spark, sf_dir, "events").filter("event_id % 5 = 4").select(F.lit("OUT/z4").alias("path"))
    return files.extraction_plan(entries, "out", there).select("entry_id", "destination", "action")
