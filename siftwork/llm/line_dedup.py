"""Line deduplication with DataFrame functions only.

Lines are exploded in normalised, hashed form with their position; distinct documents are counted
per hash; lines over the threshold go everywhere but in the largest document holding them; what is
left is joined again by position.

Text moves once, in the final join by document. Counting moves 16 hash bytes a line and is
pre-aggregated before the shuffle; lines that many documents hold are dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.skew import dealt_join
from siftwork.session import stored, table

#: The white space stripped at both ends, and the letters that are lower-cased.
STRIP = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; the fast path is for text without other characters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _line_hash(line: Column, min_chars: int) -> Column:
    """128 hash bits of a line's key; null where the key is too short to count."""
    key = F.btrim(line, F.lit(STRIP))
    low = lower_ascii(key)
    return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(7), low).alias("h2")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines that many documents share.

    Returns the input's columns with text_col rewritten, and n_lines (before) and n_dropped;
    input columns of these two names are replaced. A null or empty text is one empty line and
    comes back as it was. Rows with a null id count for no line and keep all theirs; rows that
    repeat an id count as one document. The copy in the largest id stays, in all its lines.
    """
    base = docs.drop("n_lines", "n_dropped", "__lines", "__t")
    base = base.withColumns({"__lines": F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), "__t": F.xxhash64(text_col)})  # __t tells texts of one id apart
    hashed = F.transform("__lines", lambda x, i: F.struct(i.alias("pos"), _line_hash(x, min_chars).alias("h")))
    held = stored(
        base.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col("__t").alias("t"), F.explode(F.filter(hashed, lambda x: x["h"].isNotNull())).alias("x"))
        .select("id", "t", "x.pos", "x.h.h1", "x.h.h2")
    )
    key = ["h1", "h2"]
    often = held.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("last"))
    often = often.filter((F.col("n") >= min_docs) & ((F.col("least") < F.col("last")) | F.lit(min_docs <= 1))).select(*key, "n", "last")
    hits = stored(dealt_join(held, often, key, "n"))
    docs_of = hits.groupBy(*key, "id").agg(F.max("n").alias("n"), F.max("last").alias("last"))
    shared = docs_of.groupBy(*key).agg(F.count(F.lit(1)).alias("docs"), F.max("n").alias("n")).filter(F.col("docs") >= min_docs).select(*key, "n")
    counts = hits.groupBy(*key).agg(F.max("n").alias("n"))
    drops = (
        dealt_join(hits.filter(F.col("id") < F.col("last")).select("id", "t", "pos", *key), shared, key, "n", counts)
        .groupBy(F.col("id").alias("__id"), F.col("t").alias("__own"))
        .agg(F.collect_set("pos").alias("__drop"))
    )
    joined = base.join(drops, (F.col(id_col) == F.col("__id")) & (F.col("__t") == F.col("__own")), "left")
    n_lines = F.size("__lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("__drop")), lambda i: F.get("__lines", i))
    text = F.when(F.col("__drop").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text_col))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in base.columns if c not in ("__lines", "__t")],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col("__drop").isNotNull(), F.col("__drop"))), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of documents; one digest row a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256")
    )


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT d.*, coalesce(s.last <> d.doc_id, false) AS gone FROM keyed d LEFT JOIN shared s USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
