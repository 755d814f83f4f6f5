"""Queries over logged moves: undo over chains, the state of half-done quarantines, folders that moves empty."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.operators import actions
from siftwork.plans.register import query
from siftwork.session import ensure_checkpoint_dir, table
from siftwork.sources.store import KeyedTable, run_logged

# A conversation's file goes through five places, a move a turn, and comes home with every fifth; a later file may take its place.
_CHAINS = """o AS (
  SELECT conv_id * 100000 + turn * 2 AS seq, conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
), m AS (
  SELECT seq, CASE seq % 2 WHEN 0 THEN 'MovedMedia' ELSE 'MovedMetadata' END AS action, concat('q', (i - 1) % 5, '/', c) AS source, concat('q', i % 5, '/', c) AS destination, c AS size FROM o
  UNION ALL SELECT seq + 1, 'ReviewRequired', concat('q0/', c), '', c FROM o WHERE i = 1
  UNION ALL SELECT 1000000000000000 + c, 'MovedMedia', concat('new/', c), concat('q0/', c), 7 FROM o WHERE i = n AND n % 5 <> 0 AND c % 3 = 0
), now AS (
  SELECT concat('q', n % 5, '/', c) AS path FROM o WHERE i = n AND c % 11 <> 0
  UNION SELECT concat('q0/', c) FROM o WHERE i = n AND (c % 3 = 0 OR c % 13 = 0)
  UNION SELECT concat('new/', c) FROM o WHERE i = n AND c % 21 = 0
)"""


def _chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn") * 2).alias("seq"), F.col("conv_id").alias("c"))
    w = Window.partitionBy("c")
    numbered = o.withColumns({"i": F.row_number().over(w.orderBy("seq")), "n": F.count(F.lit(1)).over(w)})
    place = lambda i: F.concat(F.lit("q"), (i % 5).cast("string"), F.lit("/"), F.col("c").cast("string"))
    named = lambda top: F.concat(F.lit(f"{top}/"), F.col("c").cast("string"))
    row = lambda df, seq, action, a, b, size: df.select(seq.alias("seq"), action.alias("action"), a.alias("source"), b.alias("destination"), size.cast("long").alias("size"))
    seq, i, n, c = (F.col(x) for x in ("seq", "i", "n", "c"))
    last = numbered.filter("i = n")
    manifest = (
        row(numbered, seq, F.when(seq % 2 == 0, "MovedMedia").otherwise("MovedMetadata"), place(i - 1), place(i), c)
        .union(row(numbered.filter("i = 1"), seq + 1, F.lit("ReviewRequired"), named("q0"), F.lit(""), c))
        .union(row(last.filter("n % 5 <> 0 AND c % 3 = 0"), 1_000_000_000_000_000 + c, F.lit("MovedMedia"), named("new"), named("q0"), F.lit(7)))
    )
    now = last.filter("c % 11 <> 0").select(place(n).alias("path")).union(last.filter("c % 3 = 0 OR c % 13 = 0").select(named("q0"))).union(last.filter("c % 21 = 0").select(named("new")))
    return manifest, now


@query(
    f"""WITH RECURSIVE {_CHAINS}, moves AS (SELECT * FROM m WHERE action IN ('MovedMedia', 'MovedMetadata') AND source <> destination),
    seen AS (SELECT seq, source AS path, true AS leaves FROM moves UNION ALL SELECT seq, destination, false FROM moves),
    links AS (SELECT came AS node, seq AS next FROM (SELECT *, lag(seq) OVER w AS came, lag(leaves) OVER w AS before FROM seen WINDOW w AS (PARTITION BY path ORDER BY seq)) WHERE leaves AND NOT before),
    walk AS (SELECT seq AS first_seq, seq AS cur, 1 AS moves FROM moves WHERE seq NOT IN (SELECT next FROM links) UNION ALL SELECT first_seq, next, moves + 1 FROM walk JOIN links ON cur = node),
    whole AS (SELECT first_seq, arg_max(cur, moves) AS last_seq, max(moves) AS moves FROM walk GROUP BY first_seq),
    f AS (SELECT w.*, a.source AS origin, a.size, b.destination AS place, b.destination IN (SELECT path FROM now) AND w.last_seq = max(w.last_seq) OVER (PARTITION BY b.destination) AS found,
      a.source IN (SELECT path FROM now) AS taken FROM whole w JOIN moves a ON a.seq = w.first_seq JOIN moves b ON b.seq = w.last_seq),
    k AS (SELECT *, CASE WHEN NOT found THEN 'SKIP not found' WHEN origin = place THEN 'HOME' ELSE 'RESTORE' END AS kind FROM f),
    g AS (SELECT *, kind = 'RESTORE' AND first_seq = max(first_seq) FILTER (kind = 'RESTORE') OVER (PARTITION BY origin) AS wins FROM k),
    blocked AS (SELECT a.first_seq FROM g a LEFT JOIN g b ON b.place = a.origin AND b.found WHERE a.wins AND a.taken AND NOT coalesce(b.wins, false)
      UNION SELECT a.first_seq FROM blocked x JOIN g b ON b.first_seq = x.first_seq JOIN g a ON a.origin = b.place AND a.wins AND a.taken WHERE b.found)
    SELECT first_seq, last_seq, origin, place, size, moves, CASE WHEN kind = 'RESTORE' AND (NOT wins OR first_seq IN (SELECT first_seq FROM blocked)) THEN 'SKIP occupied' ELSE kind END AS status FROM g"""
)
def restore_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restore row a file, over all moves of it, and why those that can't go back stay."""
    return actions.restore(*_chains(spark, sf_dir))


# A pair a document. What was moved, lost, changed or logged differs by its number.
_PAIRS = """e AS (SELECT doc_id AS i, doc_id % 3 <> 0 AS paired, doc_id % 19 AS k FROM documents), p AS (
  SELECT i AS pair_id, concat('keep/', i) AS keeper, concat('lib/', i, CASE WHEN i % 23 = 0 THEN '[1]' ELSE '' END, '.jpg') AS media, concat('q/', i, '.jpg') AS media_to,
         i % 1000 AS size, concat('h', i % 97) AS hash, CASE WHEN paired THEN concat('lib/', i, '.json') END AS side, CASE WHEN paired THEN concat('q/', i, '.json') END AS side_to, k, paired FROM e
), m AS (
  SELECT pair_id * 10 AS seq, 'MovedMedia' AS action, media AS source, media_to AS destination, hash FROM p WHERE k IN (1, 2, 3, 4, 5, 6, 7, 8)
  UNION ALL SELECT pair_id * 10 + 1, 'MovedMetadata', side, side_to, 's' FROM p WHERE paired AND k IN (1, 2, 3, 7, 9)
  UNION ALL SELECT pair_id * 10 + 2, 'RolledBack', media_to, media, hash FROM p WHERE k = 7
  UNION ALL SELECT pair_id * 10 + 3, 'ReviewRequired', media, '', hash FROM p WHERE k = 12
), now AS (
  SELECT keeper AS path, size, CASE WHEN k = 11 THEN 'changed' ELSE hash END AS hash FROM p WHERE k <> 10
  UNION ALL SELECT media, size, CASE WHEN k = 12 THEN 'changed' ELSE hash END FROM p WHERE k IN (0, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18)
  UNION ALL SELECT media_to, size + CASE WHEN k IN (2, 14) THEN 1 ELSE 0 END, hash FROM p WHERE k IN (1, 2, 3, 5, 6, 8, 13, 14, 15)
  UNION ALL SELECT side, 5, 's' FROM p WHERE paired AND k NOT IN (1, 2, 3, 4, 7, 8, 9)
  UNION ALL SELECT side_to, 5, CASE WHEN k = 3 THEN 'other' ELSE 's' END FROM p WHERE paired AND k IN (1, 2, 3, 7, 9, 13, 16, 18)
)"""


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    i, k = F.col("pair_id"), F.col("k")
    text = lambda a, b="": F.concat(F.lit(a), i.cast("string"), b if not isinstance(b, str) else F.lit(b))
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), (F.col("doc_id") % 3 != 0).alias("paired"), (F.col("doc_id") % 19).alias("k"))
    p = e.withColumns({
        "keeper": text("keep/"), "media": text("lib/", F.concat(F.when(i % 23 == 0, "[1]").otherwise(""), F.lit(".jpg"))), "media_to": text("q/", ".jpg"),
        "size": (i % 1000).cast("long"), "hash": F.concat(F.lit("h"), (i % 97).cast("string")), "side": F.when(F.col("paired"), text("lib/", ".json")), "side_to": F.when(F.col("paired"), text("q/", ".json")),
    })
    move = lambda rows, n, action, a, b, h: rows.select((i * 10 + n).alias("seq"), F.lit(action).alias("action"), F.col(a).alias("source"), b.alias("destination"), h.alias("hash"))
    sided, hash_ = p.filter("paired"), F.col("hash")
    manifest = (
        move(p.filter("k BETWEEN 1 AND 8"), 0, "MovedMedia", "media", F.col("media_to"), hash_)
        .union(move(sided.filter("k IN (1, 2, 3, 7, 9)"), 1, "MovedMetadata", "side", F.col("side_to"), F.lit("s")))
        .union(move(p.filter("k = 7"), 2, "RolledBack", "media_to", F.col("media"), hash_))
        .union(move(p.filter("k = 12"), 3, "ReviewRequired", "media", F.lit(""), hash_))
    )
    at = lambda rows, path, size, h: rows.select(F.col(path).alias("path"), size.cast("long").alias("size"), h.alias("hash"))
    now = (
        at(p.filter("k <> 10"), "keeper", F.col("size"), F.when(k == 11, "changed").otherwise(hash_))
        .union(at(p.filter("k = 0 OR k IN (6, 7) OR k >= 9"), "media", F.col("size"), F.when(k == 12, "changed").otherwise(hash_)))
        .union(at(p.filter("k IN (1, 2, 3, 5, 6, 8, 13, 14, 15)"), "media_to", F.col("size") + F.when(k.isin(2, 14), 1).otherwise(0), hash_))
        .union(at(sided.filter("k NOT IN (1, 2, 3, 4, 7, 8, 9)"), "side", F.lit(5), F.lit("s")))
        .union(at(sided.filter("k IN (1, 2, 3, 7, 9, 13, 16, 18)"), "side_to", F.lit(5), F.when(k == 3, "other").otherwise("s")))
    )
    return p.drop("paired", "k"), manifest, now


_STATE = f"""WITH {_PAIRS}, log AS (
  SELECT p.pair_id, coalesce(arg_max(m.source = p.media, seq) FILTER (m.source IN (p.media, p.media_to)), false) AS log_media,
         coalesce(arg_max(m.source = p.side, seq) FILTER (m.source IN (p.side, p.side_to)), false) AS log_side, arg_max(m.hash, seq) FILTER (m.source = p.side) AS side_hash
  FROM p LEFT JOIN m ON m.destination <> '' AND ((m.source = p.media AND m.destination = p.media_to) OR (m.source = p.media_to AND m.destination = p.media)
    OR (m.source = p.side AND m.destination = p.side_to) OR (m.source = p.side_to AND m.destination = p.side)) GROUP BY p.pair_id
), f AS (
  SELECT p.*, l.*, a.hash AS kh, a.size AS ks, b.hash AS mh, b.size AS ms, c.hash AS th, c.size AS ts, d.hash AS sh, d.size AS ss, t.hash AS uh, t.size AS us
  FROM p JOIN log l USING (pair_id) LEFT JOIN now a ON a.path = keeper LEFT JOIN now b ON b.path = media LEFT JOIN now c ON c.path = media_to LEFT JOIN now d ON d.path = side LEFT JOIN now t ON t.path = side_to
), s AS (
  SELECT *, CASE WHEN mh IS NULL AND th IS NULL THEN 'Lost' WHEN log_media AND mh IS NOT NULL AND th IS NOT NULL THEN 'Doubled'
    WHEN mh IS NULL AND paired AND NOT (uh IS NOT NULL AND sh IS NULL) THEN 'MediaMoved' WHEN mh IS NULL THEN 'Moved'
    WHEN paired AND uh IS NOT NULL AND sh IS NULL AND log_side THEN 'MetadataMoved' ELSE 'Planned' END AS state,
    coalesce(ts = size AND th = hash, false) AS to_same, coalesce(uh <> side_hash, false) AS side_changed FROM f
), j AS (
  SELECT *, CASE
    WHEN state = 'Lost' THEN 'ReviewRequired|Media is neither at its source nor in quarantine'
    WHEN state = 'Doubled' THEN 'ReviewRequired|Media was moved but is at its source too'
    WHEN state IN ('Moved', 'MediaMoved') AND NOT to_same THEN 'ReviewRequired|Post-move media verification failed'
    WHEN state = 'Moved' AND side_changed THEN 'ReviewRequired|Post-move metadata verification failed'
    WHEN state = 'Moved' THEN 'Done|'
    WHEN state = 'MediaMoved' AND sh IS NOT NULL AND uh IS NOT NULL THEN 'ReviewRequired|Metadata is at its source and in quarantine'
    WHEN state = 'MediaMoved' AND sh IS NULL THEN 'ReviewRequired|Metadata is neither at its source nor in quarantine'
    WHEN state = 'MediaMoved' THEN 'RollBackMedia|Media moved, metadata did not'
    WHEN state = 'MetadataMoved' AND side_changed THEN 'ReviewRequired|Post-move metadata verification failed'
    WHEN state = 'MetadataMoved' THEN 'RollBackMetadata|Metadata moved, media did not'
    WHEN NOT coalesce(ks = size AND kh = hash, false) THEN 'ReviewRequired|Keeper failed integrity check (exists/size/SHA-256)'
    WHEN NOT coalesce(ms = size AND mh = hash, false) THEN 'ReviewRequired|Failed pre-action revalidation (exists/size/SHA-256)'
    WHEN to_same AND (NOT paired OR sh IS NULL OR (ss = us AND sh = uh)) THEN 'AlreadyInQuarantine|Identical media and metadata already exist at destination; source left untouched'
    WHEN to_same THEN 'ReviewRequired|Destination contains identical media but companion metadata is missing or differs'
    WHEN th IS NOT NULL THEN 'ReviewRequired|Destination collision with differing media content'
    WHEN paired AND sh IS NOT NULL AND uh IS NOT NULL THEN 'ReviewRequired|Companion metadata destination already exists; media and metadata pair left untouched'
    WHEN contains(media, '[') OR contains(media, ']') THEN 'ReviewRequired|Source or destination path contains [ or ] (wildcard metacharacters for Move-Item -Destination); skipped for safety'
    ELSE 'Move|' END AS r FROM s
)
SELECT pair_id, CASE WHEN log_media AND log_side THEN 'both' WHEN log_media THEN 'media' WHEN log_side THEN 'metadata' ELSE 'none' END AS logged,
  state, string_split(r, '|')[1] AS step, string_split(r, '|')[2] AS detail FROM j"""


@query(_STATE)
def quarantine_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each planned pair of media and sidecar stands, and what comes next."""
    return actions.quarantine_state(*_pairs(spark, sf_dir))


# Trash folders with a level for each binary digit of a document's number; some files move, some stay.
_TREE = """t AS (
  SELECT concat('Takeout/Part ', doc_id % 5, '/', CASE WHEN doc_id % 2 = 0 THEN 'Trash' ELSE 'Bin' END) AS trash,
         concat('/', array_to_string(string_split(bin(doc_id // 4), ''), '/')) AS below, concat('/f', doc_id, '.jpg') AS name, doc_id % 5 < 2 OR doc_id % 7 <> 0 AS moves FROM documents
), files AS (SELECT DISTINCT concat(trash, below, name) AS path, concat(trash, below) AS folder, moves FROM t)"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    i = F.col("doc_id")
    trash = F.concat(F.lit("Takeout/Part "), (i % 5).cast("string"), F.when(i % 2 == 0, "/Trash").otherwise("/Bin"))
    below = F.concat(F.lit("/"), F.array_join(F.split(F.bin(F.floor(i / 4)), ""), "/"))
    name = F.concat(F.lit("/f"), i.cast("string"), F.lit(".jpg"))
    t = table(spark, sf_dir, "documents").select(trash.alias("trash"), F.concat(trash, below).alias("folder"), F.concat(trash, below, name).alias("path"), ((i % 5 < 2) | (i % 7 != 0)).alias("moves"))
    above = t.select("folder").distinct().select(F.explode(F.array_append(actions.folders_above(F.col("folder")), F.col("folder"))).alias("path")).distinct()
    return above, t.select("path"), t.filter("moves").select("path"), t.select(F.col("trash").alias("path"))


@query(
    f"""WITH RECURSIVE {_TREE}, up AS (SELECT DISTINCT folder FROM files UNION SELECT regexp_extract(folder, '^(.*)/[^/]*$', 1) FROM up WHERE contains(folder, '/')),
    held AS (SELECT DISTINCT folder FROM files WHERE path NOT IN (SELECT path FROM files WHERE moves)), full_ AS (SELECT folder FROM held UNION SELECT regexp_extract(folder, '^(.*)/[^/]*$', 1) FROM full_ WHERE contains(folder, '/')),
    tops AS (SELECT DISTINCT lower(trash) AS trash FROM t)
    SELECT folder, trash, trash NOT IN (SELECT lower(folder) FROM full_) AS whole FROM up JOIN tops ON starts_with(lower(folder) || '/', trash || '/') WHERE folder NOT IN (SELECT folder FROM full_)"""
)
def emptied_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the trash that hold nothing once the plan's files are gone."""
    return actions.emptied_folders(*_tree(spark, sf_dir))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT conv_id AS archive, turn AS position, role AS entry, length(text) AS size FROM conversations WHERE conv_id % 100 <> 7
    UNION ALL SELECT conv_id, turn, concat(role, '!'), length(text) FROM conversations WHERE conv_id % 100 = 7 AND turn % 2 = 0
    UNION ALL SELECT DISTINCT -conv_id - 1, 0, 'new', 1 FROM conversations WHERE conv_id % 50 = 7"""
)
def contents_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of archives, kept by archive: archives read again lose their old entries, new ones are added, the rest stays as it is on disk."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("archive"), F.col("turn").alias("position"), F.col("role").alias("entry"), F.length("text").cast("long").alias("size")
    )
    store = KeyedTable(spark, _folder(spark, "contents"), "archive", buckets=16)
    store.create(rows)
    store.merge(rows.filter("archive % 100 = 7 AND position % 2 = 0").withColumn("entry", F.concat("entry", F.lit("!"))))
    new = rows.filter("archive % 50 = 7").select((-F.col("archive") - 1).alias("archive")).distinct()
    store.merge(new.select("archive", F.lit(0).cast("long").alias("position"), F.lit("new").alias("entry"), F.lit(1).cast("long").alias("size")))
    return store.read()


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stands for work on files: those of an odd size fail."""
    for b in batches:
        failed = b["size"] % 2 == 1
        yield pd.DataFrame({"path": b["path"], "result": failed.map({True: "FAILED", False: "OK"}), "detail": failed.map({True: "odd size", False: ""})})


@query("SELECT concat('f', doc_id) AS path, CASE WHEN n_chars % 2 = 1 THEN 'FAILED' ELSE 'OK' END AS result, CASE WHEN n_chars % 2 = 1 THEN 'odd size' ELSE '' END AS detail FROM documents")
def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of actions worked through in steps; a second call with the same state adds nothing."""
    todo = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").cast("long").alias("size"))
    base = _folder(spark, "actions")
    for _ in range(2):
        run_logged(todo, _settle, "path string, result string, detail string", f"{base}/log", f"{base}/state", flush=20_000)
    return spark.read.parquet(f"{base}/log")
