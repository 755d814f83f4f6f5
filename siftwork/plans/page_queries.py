"""Queries over the reviewer's page: its rows, filters, pages and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators import pages
from siftwork.plans.register import query
from siftwork.session import cut, table

# Images out of documents: every seventh came by messenger and is a copy of the one before it.
_ROWS = """i AS (
  SELECT doc_id, concat('k', doc_id) AS id, concat('L/', source, '/', doc_id, '.jpg') AS path, concat(source, '/', CASE WHEN doc_id % 7 = 3 THEN concat('IMG-2023', lpad((doc_id % 12 + 1)::varchar, 2, '0'), '05-WA', lpad((doc_id % 10000)::varchar, 4, '0')) ELSE doc_id::varchar END, '.jpg') AS rel,
    ['meme', 'document', 'photo'][(doc_id % 3 + 1)::int] AS category, (doc_id % 1000) / 1000.0::double AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'reject' WHEN doc_id % 3 = 1 THEN 'review' ELSE 'keep' END AS suggestion,
    doc_id % 90 + 10 AS width, 40::bigint AS height, n_chars AS bytes, doc_id % 5 = 0 AS gps, lang = 'de' AS side_gps, doc_id % 4 AS people, CASE WHEN doc_id % 31 = 0 THEN 'WhatsApp Images' END AS upload_folder,
    CASE WHEN doc_id % 2 = 0 THEN concat('2021:0', doc_id % 9 + 1, ':03 10:00:00') END AS taken FROM documents
), t AS (
  SELECT i.*, o.id AS copy_id, o.path AS copy_of, CASE WHEN o.id IS NOT NULL THEN i.doc_id % 9 END AS copy_distance, o.width AS copy_width, o.height AS copy_height FROM i LEFT JOIN i o ON i.doc_id % 7 = 3 AND o.doc_id = i.doc_id - 1
), r AS (
  SELECT id, path, rel, regexp_extract(rel, '[^/]*$') AS name, CASE WHEN copy_id IS NULL THEN category ELSE 'whatsapp_copy' END AS category, category AS content, round_even(confidence, 3) AS confidence,
    CASE WHEN copy_id IS NULL THEN suggestion WHEN copy_distance <= 4 AND copy_width * copy_height >= 0.9 * width * height THEN 'reject' ELSE 'review' END AS suggestion,
    CASE WHEN copy_id IS NULL THEN '' WHEN copy_distance <= 4 AND copy_width * copy_height >= 0.9 * width * height THEN 'you have this photo in better quality'
      WHEN copy_width * copy_height >= 0.9 * width * height THEN 'similar to a photo you have' ELSE 'similar to a photo you have (but this copy is larger)' END AS note,
    'r' AS reasons, 'top' AS top3, width, height, bytes, 'JPEG' AS format, '' AS camera, gps OR side_gps AS gps, people, upload_folder,
    doc_id % 7 = 3 OR doc_id % 31 = 0 AS whatsapp, CASE WHEN doc_id % 7 = 3 THEN concat('2023-', lpad((doc_id % 12 + 1)::varchar, 2, '0'), '-05') ELSE coalesce(replace(substr(taken, 1, 10), ':', '-'), '') END AS date,
    0.5::double AS flatness, '0f' AS phash, copy_of, copy_distance, copy_id, copy_width, copy_height, doc_id FROM t
), d AS (
  SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'keep' WHEN doc_id % 10 = 1 THEN 'reject' WHEN suggestion = 'reject' THEN 'reject' ELSE 'keep' END AS decision FROM r
), p AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN category = 'whatsapp_copy' THEN copy_distance ELSE -confidence END, CASE WHEN category = 'whatsapp_copy' THEN -bytes ELSE 0 END, lower(rel), rel, id) AS place FROM d
)"""
_COLUMNS = ", ".join(pages.TRIAGE)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    number = i.cast("string")
    name = F.concat(F.when(i % 7 == 3, F.concat(F.lit("IMG-2023"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("05-WA"), F.lpad((i % 10000).cast("string"), 4, "0"))).otherwise(number), F.lit(".jpg"))
    third = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (i % 3 + 1).cast("int"))
    images = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("k"), number).alias("id"), F.concat(F.lit("L/"), "source", F.lit("/"), number, F.lit(".jpg")).alias("path"), F.concat("source", F.lit("/"), name).alias("rel"), name.alias("name"),
        third("meme", "document", "photo").alias("category"), ((i % 1000) / F.lit(1000.0)).alias("confidence"), third("reject", "review", "keep").alias("suggestion"), F.lit("").alias("note"),
        F.lit("r").alias("reasons"), F.lit("top").alias("top3"), (i % 90 + 10).alias("width"), F.lit(40).cast("long").alias("height"), F.col("n_chars").alias("bytes"), F.lit("JPEG").alias("format"), F.lit("").alias("camera"),
        (i % 5 == 0).alias("gps"), (F.col("lang") == "de").alias("side_gps"), (i % 4).alias("people"), F.when(i % 31 == 0, "WhatsApp Images").alias("upload_folder"),
        F.when(i % 2 == 0, F.concat(F.lit("2021:0"), (i % 9 + 1).cast("string"), F.lit(":03 10:00:00"))).alias("taken"), F.lit(0.5).alias("flatness"), F.lit("0f").alias("phash"),
    )
    before = images.select((i + 1).alias("doc_id"), F.col("id").alias("original"))
    matches = images.filter(i % 7 == 3).select("doc_id", F.col("id").alias("copy"), (i % 9).alias("distance")).join(before, "doc_id")
    return pages.triage_rows(images.drop("doc_id"), matches)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    choices = table(spark, sf_dir, "documents").filter("doc_id % 10 < 2").select(F.concat(F.lit("k"), i.cast("string")).alias("id"), F.when(i % 10 == 0, "keep").otherwise("reject").alias("choice"))
    return pages.page_numbers(pages.decision(_rows(spark, sf_dir), choices))


@query(f"WITH {_ROWS} SELECT {_COLUMNS} FROM r")
def triage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 28 columns of each image's row."""
    return _rows(spark, sf_dir)


@query(f"WITH {_ROWS} SELECT category, (place - 1) // 240 AS page, count(*) AS rows, arg_min(id, place) AS first, arg_max(id, place) AS last FROM p GROUP BY ALL")
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page of every category starts and ends with, in the page's order."""
    return pages.page_bounds(_placed(spark, sf_dir))


@query(
    f"""WITH {_ROWS}, c AS (SELECT * FROM p WHERE category IN ('photo', 'whatsapp_copy') AND contains(lower(rel), 'src1') AND (category = 'whatsapp_copy' OR confidence >= 0.4)),
    n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY place) AS nth FROM c) SELECT category, id, nth AS place, decision FROM n WHERE nth > 20 AND nth <= 40"""
)
def page_of_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 20, of photos and of copies, of what a search and a confidence leave; copies are exempt from the confidence."""
    rows = _placed(spark, sf_dir).drop("place", "page")
    both = [pages.shown(rows, c, search="SRC1 ", least=0.4) for c in ("photo", "whatsapp_copy")]
    placed = cut(pages.page_numbers(both[0].unionByName(both[1]), 20))
    page = [pages.read_page(placed, c, 1, 20) for c in ("photo", "whatsapp_copy")]
    return page[0].unionByName(page[1]).select("category", "id", "place", "decision")


@query(f"WITH {_ROWS} SELECT path AS Path, decision AS Decision, category AS Category, confidence AS Confidence, suggestion AS Suggestion, bytes AS SizeBytes, coalesce(copy_of, '') AS CopyOf FROM d WHERE decision = 'reject' OR suggestion = 'review'")
def decision_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions in the export's columns: what is rejected or under review."""
    return pages.decision_export(_placed(spark, sf_dir).filter("decision = 'reject' OR suggestion = 'review'"))


_SIMILAR = """q AS (SELECT a.o_orderkey AS k, concat('L/', CASE WHEN a.o_orderkey % 3 = 0 THEN 'Albums/' ELSE '' END, a.o_orderkey) AS a, concat('L/', CASE WHEN a.o_orderkey % 4 = 0 THEN 'Albums/' ELSE '' END, a.o_orderkey, 'b') AS b,
    (a.o_orderkey % 4)::int AS turn, (a.o_custkey % 997) / 128.0::double AS diff, (a.o_custkey % 500) / 32.0::double AS worst, a.o_custkey % 50 AS sa, a.o_custkey % 49 AS sb, 100 + a.o_custkey % 3 AS wa, 100 + a.o_custkey % 2 AS wb FROM orders a),
  k AS (SELECT *, CASE WHEN worst <= 4 OR ((wa <> wb OR turn <> 0) AND worst <= 10) THEN 'copy' ELSE 'shot' END AS kind, contains(a, '/Albums/') AS aa, contains(b, '/Albums/') AS ab FROM q),
  s AS (SELECT *, CASE WHEN kind = 'copy' AND aa <> ab AND (wa * 100) / (wb * 100) BETWEEN 0.95 AND 1.05 THEN CASE WHEN aa THEN 'A' ELSE 'B' END
    WHEN kind = 'copy' THEN CASE WHEN wb > wa OR (wb = wa AND sb > sa) THEN 'B' ELSE 'A' END ELSE 'both' END AS suggest FROM k)"""


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = lambda n, end: F.concat(F.lit("L/"), F.when(k % n == 0, "Albums/").otherwise(""), k.cast("string"), F.lit(end))
    pairs = table(spark, sf_dir, "orders").select(
        path(3, "").alias("a"), path(4, "b").alias("b"), F.concat(F.lit("k"), k.cast("string")).alias("ka"), F.concat(F.lit("l"), k.cast("string")).alias("kb"), (k % 4).cast("int").alias("rotation"),
        ((c % 997) / F.lit(128.0)).alias("diff"), ((c % 500) / F.lit(32.0)).alias("worst"), (c % 50).alias("a_size"), (c % 49).alias("b_size"),
        F.array(c % 3 + 100, F.lit(100).cast("long")).alias("a_dims"), F.array(c % 2 + 100, F.lit(100).cast("long")).alias("b_dims"),
    )
    return pages.similar_rows(pairs)


@query(
    f"WITH {_SIMILAR}, f(shown) AS (VALUES ('copy'), ('shot'), ('rot'), ('all')) SELECT shown, a, b, concat('k', k) AS ka, concat('l', k) AS kb, turn * 90 AS rotation, round_even(diff, 2) AS pixel_diff, round_even(worst, 2) AS worst_patch, kind, "
    "sa AS a_size, sb AS b_size, [wa, 100] AS a_dims, [wb, 100] AS b_dims, suggest FROM s, f WHERE shown = 'all' OR kind = shown OR (shown = 'rot' AND turn <> 0)"
)
def similar_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of similar pictures under each of the page's four filters."""
    rows = cut(_similar(spark, sf_dir))
    out = [pages.similar_shown(rows, show).withColumn("shown", F.lit(show)) for show in ("copy", "shot", "rot", "all")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    f"""WITH {_SIMILAR}, c AS (SELECT *, CASE WHEN k % 10 = 1 THEN 'both' WHEN k % 10 = 2 THEN 'A' ELSE suggest END AS choice FROM s)
    SELECT CASE choice WHEN 'A' THEN b ELSE a END AS Path, 'reject' AS Decision, CASE WHEN turn <> 0 THEN 'rotated copy' ELSE 'same-picture copy' END AS Category, round_even(diff, 2) AS Confidence,
      CASE WHEN suggest = choice THEN 'reject' ELSE 'keep' END AS Suggestion, CASE choice WHEN 'A' THEN sb ELSE sa END AS SizeBytes, CASE choice WHEN 'A' THEN a ELSE b END AS CopyOf FROM c WHERE choice <> 'both'"""
)
def similar_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the similar page exports: the side of each pair that a choice or the suggestion drops."""
    rows = _similar(spark, sf_dir)
    k = F.expr("cast(substr(ka, 2) as bigint)") % 10
    return pages.similar_export(rows, rows.filter(k.isin(1, 2)).select("a", "b", F.when(k == 1, "both").otherwise("A").alias("choice")))
