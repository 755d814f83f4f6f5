"""Substring dedup: repeated passages of 50 words by compaction of a De Bruijn graph.

1. Seeds. Of a window's 30-word grams the one with the smallest hash is its seed, so that equal windows
   have equal seeds wherever they stand. Neighbouring windows of one seed are a stretch. Stretches whose
   seed is in one document only can't repeat; they are most of all text and go no further.
2. Edges. A window, a k-mer of 50 tokens, is an edge from its first 49 words to its last 49. Where all
   stretches of a seed are alike, their edges are nonbranching among themselves, and the stretch stands
   for them as one; any other stretch gives each of its windows. Equal edges are one, and an
   edge repeats if it is in two documents or more.
3. Compaction. Of two edges that follow each other at their first occurrence, the second belongs to the
   path of the first if it follows at each occurrence of either: their numbers of occurrences agree, and so
   do the fingerprints of where the first ends and the second starts. A join of the repeated edges with
   themselves finds these steps; steps in a row are a nonbranching path. All of a path occurs in the
   same documents, so the path's smallest document is that of each of its windows.
4. Verification. A path's source coordinates are those of its first occurrence; the words there and at
   each other occurrence are read again and compared by a digest of 128 bits. A stretch that differs
   from its source, which takes two windows of one 64-bit hash, is left alone.

Hot edges, known as such from their seed's count, are dealt over many tasks. Texts move once, compressed and
dealt by document. Windows are judged on the input; the words that verified paths cover are cut from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm import skew
from siftwork.llm.words import WORD_BASE, U, arrow_rows, buffers, mix, ranges_hash, slices
from siftwork.session import SMALL_BATCHES, own_session, stored, table

#: Words of a window and of a seed. Longer seeds part stretches more finely, so that fewer windows stand alone.
WINDOW, SEED = 50, 30
#: A word's place is that in its document's texts: a text's number takes the upper bits.
PLACE_BITS = 32


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of keys[i:i+width] for each i, by doubling."""
    have, out = 1, keys
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def _seeds(window: int, k: int):
    per = window - k + 1

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = arrow_rows(batch, "id").cast(pa.int64()), arrow_rows(batch, "v").to_numpy()
            for part in slices(arrow_rows(batch, "text")):
                words = part.hashes()
                if len(words) < window:
                    continue
                grams = np.arange(len(words) - k + 1)
                grams = ranges_hash(words, grams, grams + k, WORD_BASE)
                place = U((1 << max(24, len(grams).bit_length())) - 1)
                keys = (grams & ~place) | np.arange(len(grams), dtype=U)  # ties: the leftmost
                anchor = (_window_min(keys, per) & place).astype(np.int64)
                n = np.diff(part.first)
                row = np.repeat(np.arange(len(n)), n)[: len(anchor)]
                start = np.arange(len(anchor))
                whole = start + window <= part.first[row + 1]
                anchor, row, start = anchor[whole], row[whole], start[whole]
                if not len(start):
                    continue
                new = np.ones(len(start), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(new)
                low, high = start[at], start[np.append(at[1:], len(start)) - 1]
                context = mix(ranges_hash(words, low, high + window, WORD_BASE) ^ (anchor[at] - low).astype(U))
                which = row[at] + part.rows.start
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(which)),
                        pa.array((low - part.first[row[at]]) + (versions[which] << PLACE_BITS)),
                        pa.array((high - low + 1).astype(np.int32)),
                        pa.array(grams[anchor[at]].view(np.int64)),
                        pa.array(context.view(np.int64)),
                    ],
                    names=["id", "low", "len", "seed", "context"],
                )

    return seeds


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the shuffle."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        at, data = buffers(arrow_rows(batch, "text"))
        packed = [pack(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([arrow_rows(batch, "id"), arrow_rows(batch, "v"), pa.array(packed, pa.binary())], names=["id", "v", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches of few rows, each with its texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for s in range(0, len(batch), rows):
            part = batch.slice(s, rows)
            yield part, pa.array([unpack(x.as_buffer()) if x.is_valid else None for x in arrow_rows(part, "packed")], pa.large_binary())


def _windows(window: int):
    """Every window of the stretches listed in spans, hashed."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches):
            ids, spans = arrow_rows(batch, "id").cast(pa.int64()), arrow_rows(batch, "spans").to_pylist()
            for part in slices(texts):
                own = [(r, s["low"], s["len"], s["hot"]) for r in range(part.rows.start, part.rows.stop) for s in spans[r]]
                if not own:
                    continue
                row, low, count, hot = (np.array(x) for x in zip(*own, strict=True))
                row, hot = np.repeat(row, count), np.repeat(hot, count)
                low = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
                start = (low & ((1 << PLACE_BITS) - 1)) + part.first[row - part.rows.start]
                own = ranges_hash(part.hashes(), start, start + window, WORD_BASE)
                for i in range(0, len(start), 100_000):
                    cut = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row[cut])), pa.array(own[cut].view(np.int64)), pa.array(low[cut]), pa.array(hot[cut])],
                        names=["id", "edge", "low", "hot"],
                    )

    return windows


def _digest(words: list[bytes], low: int, n: int, window: int) -> bytes:
    """Of the words that n windows from low on cover."""
    low &= (1 << PLACE_BITS) - 1
    return hashlib.blake2b(b" ".join(words[low : low + n + window - 1]), digest_size=16).digest()


def _sources(window: int):
    """A digest of the words at the source coordinates of each path."""

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches):
            out: dict[str, list] = {"edge": [], "hot": [], "least": [], "n": [], "digest": []}
            for i, text, paths in zip(arrow_rows(batch, "id").to_pylist(), texts, arrow_rows(batch, "paths").to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                for p in paths:
                    for name, value in (("edge", p["edge"]), ("hot", p["hot"]), ("least", i), ("n", p["n"]), ("digest", _digest(words, p["low"], p["n"], window))):
                        out[name].append(value)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return sources


def _cut_words(window: int):
    def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches):
            total, gone, kept = [], [], []
            for text, own in zip(texts, arrow_rows(batch, "spans").to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                total.append(len(words))
                own = [s for s in own or () if _digest(words, s["low"], s["n"], window) == s["digest"]]
                if own:
                    delta = np.zeros(len(words) + 1, np.int64)
                    low = np.array([s["low"] for s in own]) & ((1 << PLACE_BITS) - 1)
                    np.add.at(delta, low, 1)
                    np.add.at(delta, low + np.array([s["n"] for s in own]) + window - 1, -1)
                    keep = np.cumsum(delta[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    arrow_rows(batch, "id").cast(pa.int64()),
                    pa.array(total, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["id", "n_words", "n_removed", "text"],
            )

    return cut_words


def _salts(spark: SparkSession) -> int:
    return max(1, min(skew.HOT_ROWS // 10, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def repeated_edges(docs: DataFrame, packed: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(edge, salt, id, low, len): edges whose seed is in more than one document, and the windows each stands for.

    salt is -1, but for edges of hot seeds. docs: (id, v, text), packed: (id, v, packed) of the same.
    """
    seeds = docs.mapInArrow(_seeds(window, seed), "id long, low long, len int, seed long, context long")
    often = seeds.groupBy("seed").agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.min("context").alias("c0"), F.max("context").alias("c1"), F.count(F.lit(1)).alias("n")
    )
    often = often.filter("least < most").select("seed", (F.col("c0") != F.col("c1")).alias("branching"), "n")
    found = skew.dealt_join(seeds.select("id", "low", "len", "seed"), often, ["seed"], "n")
    found = stored(found.select("id", "low", "len", "seed", "branching", (F.col("n") >= skew.HOT_ROWS).alias("hot")))
    whole = found.filter("NOT branching").select("id", F.xxhash64("seed").alias("edge"), "low", "hot", "len")
    version = F.shiftright("low", PLACE_BITS)
    spans = found.filter("branching").groupBy("id", version.alias("v")).agg(F.collect_list(F.struct("low", "len", "hot")).alias("spans"))
    single = packed.join(spans, ["id", "v"]).select("id", "packed", "spans").mapInArrow(_windows(window), "id long, edge long, low long, hot boolean")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "low"), F.lit(_salts(docs.sparkSession))).cast("int")).otherwise(-1)
    edges = whole.unionByName(single.withColumn("len", F.lit(1))).select("edge", salt.alias("salt"), "id", "low", "len")
    return edges.repartition("edge", "salt")  # one exchange for the graph and for the occurrences of its paths


def compact_paths(edges: DataFrame) -> DataFrame:
    """(id, low, n, edge, hot): the nonbranching paths of repeated edges, at their first occurrence.

    A path has n windows and starts with an edge.
    """
    own = edges.groupBy("edge", "salt").agg(
        F.min(F.struct("id", "low")).alias("first"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"), F.max("len").alias("len"),
        F.bit_xor(F.xxhash64("id", "low")).alias("starts"), F.bit_xor(F.xxhash64("id", F.col("low") + F.col("len"))).alias("ends"),
    )
    hot = own.filter("salt >= 0").groupBy("edge").agg(
        F.min("first").alias("first"), F.max("most").alias("most"), F.sum("n").alias("n"), F.max("len").alias("len"),
        F.bit_xor("starts").alias("starts"), F.bit_xor("ends").alias("ends"),
    )
    all_ = own.filter("salt < 0").drop("salt").withColumn("hot", F.lit(False)).unionByName(hot.withColumn("hot", F.lit(True)))
    nodes = all_.filter("first.id < most").select("first.id", "first.low", "edge", "hot", "n", "len", "starts", "ends")
    ahead = nodes.select("id", (F.col("low") + F.col("len")).alias("low"), "n", F.col("ends").alias("starts"), F.lit(True).alias("linked"))
    steps = nodes.select("id", "low", "edge", "hot", "n", "len", "starts").join(ahead, ["id", "low", "n", "starts"], "left")
    path = F.max(F.when(F.col("linked").isNull(), F.col("low"))).over(Window.partitionBy("id").orderBy("low"))
    return (
        steps.withColumn("path", path)
        .groupBy("id", "path")
        .agg(
            F.sum("len").alias("n"),
            F.max(F.when(F.col("low") == F.col("path"), F.col("edge"))).alias("edge"),
            F.max(F.when(F.col("low") == F.col("path"), F.col("hot"))).alias("hot"),
        )
        .select("id", F.col("path").alias("low"), "n", "edge", "hot")
    )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id_col, n_words, n_removed, text): words left once repeated windows are cut, joined by one space.

    A word goes when a window that covers it also starts in a document with a smaller id. Texts
    of fewer than `window` words lose nothing; null and empty texts have no words and come back
    empty. Rows with a null id lose nothing. Rows that repeat an id are one document, so that no
    text among them is a reason to cut another; each is cut on its own. Extra columns are left out.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = plain.filter("id IS NOT NULL")
    pack = lambda df: df.mapInArrow(_pack, "id long, v long, packed binary").filter("id IS NOT NULL AND v IS NOT NULL")
    if named.groupBy("id").count().filter("count > 1").limit(1).count():  # number the texts of an id
        named = named.withColumn("v", (F.dense_rank().over(Window.partitionBy("id").orderBy("text")) - 1).cast("long"))
        once = named.dropDuplicates(["id", "v"])
        packed, texts = pack(named), pack(once)
    else:
        named = once = named.withColumn("v", F.lit(0).cast("long"))
        packed = texts = pack(named)
    edges = repeated_edges(once, texts, window, seed)
    version = F.shiftright("low", PLACE_BITS).alias("v")
    paths = compact_paths(edges).groupBy("id", version).agg(F.collect_list(F.struct("low", "n", "edge", "hot")).alias("paths"))
    sources = texts.join(paths, ["id", "v"]).select("id", "packed", "paths").mapInArrow(_sources(window), "edge long, hot boolean, least long, n long, digest binary")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(_salts(docs.sparkSession) - 1))).otherwise(F.array(F.lit(-1)))
    spans = (
        edges.join(sources.withColumn("salt", F.explode(salts)), ["edge", "salt"])
        .filter("id > least")
        .groupBy("id", version)
        .agg(F.collect_list(F.struct("low", "n", "digest")).alias("spans"))
    )
    held = packed.join(spans, ["id", "v"], "left").select("id", "packed", "spans")
    rest = plain.filter("id IS NULL").withColumn("v", F.lit(0).cast("long")).mapInArrow(_pack, "id long, v long, packed binary")
    return (
        held.unionByName(rest.select("id", "packed", F.expr("CAST(NULL AS array<struct<low:bigint,n:bigint,digest:binary>>)").alias("spans")))
        .mapInArrow(_cut_words(window), "id long, n_words long, n_removed long, text string")
        .withColumnRenamed("id", id_col)
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup of documents; one digest row a document. It runs in a session of its own, with small batches."""
    out = substring_dedup(table(own_session(spark, **SMALL_BATCHES), sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM words, unnest(range(1, greatest(len(w) - 48, 1))) AS r(i)
), firsts AS (
  SELECT h, min(doc_id) AS least FROM windows GROUP BY h
), bad AS (
  SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE doc_id > least
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM bad, unnest(range(0, 50)) AS r(j)
), each AS (
  SELECT doc_id, w[i] AS word, i FROM words, unnest(range(1, len(w) + 1)) AS r(i)
), kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each e
  ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.i GROUP BY e.doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
