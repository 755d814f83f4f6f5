"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Equal shingle sets are one class at once; a class's smallest id stands for it.
2. Each class is posted under every (coordinate, value) of its signature. Lists of one are
   dropped: a class left with fewer than MATCHES postings can't collide often enough.
3. Prefix and skip: of m remaining postings, only the m - MATCHES + 1 with the shortest lists
   are merged; two classes that collide MATCHES times must meet there. The long lists are
   skipped and only probed, through the signatures, when collisions are counted.
4. Each list links its members to its smallest one, not to each other, so what is emitted grows
   with the lists and not with their squares. Candidates with enough collisions are confirmed
   on whole shingle sets.
5. Lists whose members are one component by now hold nothing more. In the others, members
   outside the list's main component are compared with those of other components, each pair in one of
   the lists that it shares; a long list is cut in blocks of such members, so that a task compares
   one block with the list.

Before a pair leaves a join, a parity sketch bounds its similarity from above: each shingle flips
one of 1024 bits, so two sketches differ in at most as many bits as the sets have shingles not in
common. The bound never rejects a link, and copies just under the threshold rarely pass it.

Components are those of the graph of all links: step 5 leaves out only pairs already joined.
With 32 coordinates and 16 matches, a pair at Jaccard 0.85 is missed with probability 5e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.components import components
from siftwork.llm.words import WORD_BASE, U, arrow_rows, mix, ranges_hash, slices
from siftwork.session import SMALL_BATCHES, cut, own_session, table

COORDINATES, MATCHES, SHINGLE, PARITY_BITS = 32, 16, 5, 1024
#: Pairs up to which their texts' ids, 16 bytes a pair, are broadcast; beyond it texts are dealt by id.
BROADCAST_PAIRS = 500_000
#: Members of a list that meet the rest of it in one block.
LIST_BLOCK = 2048
_A = mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)) | U(1)
_TAG = mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0x165667B19E3779F9))


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row, in order. Shorter texts are one shingle."""
    for part in slices(column, lower=True):
        words = part.hashes()
        first = part.first
        n = np.diff(first)
        starts = np.arange(max(0, len(words) - width + 1))
        grams = ranges_hash(words, starts, starts + width, WORD_BASE)
        short = ranges_hash(words, first[:-1], first[1:], WORD_BASE)
        for r in range(len(n)):
            if n[r] >= width:
                yield np.unique(grams[first[r] : first[r + 1] - width + 1])
            else:
                yield short[r : r + 1] if n[r] else short[:0]


def signature(own: np.ndarray) -> np.ndarray:
    """Minima of the set under COORDINATES permutations, each value tagged by its coordinate."""
    x = own[None, :] * _A[:, None]
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    return mix(x.min(axis=1) ^ _TAG)


def parity(own: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits, each flipped once for every shingle that falls on it."""
    bits = np.bincount((mix(own) >> U(64 - 10)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _may_link(percent: int) -> Column:
    """False for pairs whose sizes or parity sketches rule out a link."""
    apart = sum((F.bit_count(F.col("par_a")[i].bitwiseXOR(F.col("par_b")[i])) for i in range(1, PARITY_BITS // 64)), F.bit_count(F.col("par_a")[0].bitwiseXOR(F.col("par_b")[0])))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return sizes & (apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


def _side(reps: DataFrame, x: str, *more: str) -> DataFrame:
    return reps.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("parity").alias(f"par_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in more])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, key, sig, odd, at = [], [], [], [], [0]
        for own in shingle_sets(arrow_rows(batch, "text")):
            size.append(len(own))
            key.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            if len(own):
                sig.append(signature(own).view(np.int64))
                odd.append(parity(own))
            at.append(at[-1] + (COORDINATES if len(own) else 0))
        flat, flags = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sig, odd))
        at = np.array(at)
        yield pa.RecordBatch.from_arrays(
            [
                arrow_rows(batch, "id").cast(pa.int64()),
                pa.array(size, pa.int64()),
                pa.array(key, pa.binary()),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)),
                pa.ListArray.from_arrays(pa.array(at // COORDINATES * (PARITY_BITS // 64), pa.int32()), pa.array(flags)),
            ],
            names=["id", "n_shingles", "key", "sig", "parity"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [x.tobytes() for x in shingle_sets(arrow_rows(batch, "text"))]
        for i in range(0, max(1, len(own)), 512):
            yield pa.RecordBatch.from_arrays(
                [arrow_rows(batch, "id")[i : i + 512].cast(pa.int64()), pa.array(own[i : i + 512], pa.binary())], names=["id", "own"]
            )


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(arrow_rows(batch, "own_a"), arrow_rows(batch, "own_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate((x, y))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * common >= percent * (len(both) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return confirm


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, key, sig, parity) of every document."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _sketches, "id long, n_shingles long, key binary, sig array<long>, parity array<long>"
    )


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives that are links. docs: (id, text)."""
    close = (
        pairs.join(_side(reps, "a", "sig"), "a")
        .join(_side(reps, "b", "sig"), "b")
        .filter(_may_link(percent))
        .filter(F.size(F.array_intersect("sig_a", "sig_b")) >= MATCHES)
        .select("a", "b")
    )
    close = cut(close)
    wanted = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if close.count() <= BROADCAST_PAIRS:
        wanted = F.broadcast(wanted)  # so that texts are filtered where they are scanned
    sets = docs.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(_sets, "id long, own binary")
    return (
        close.join(sets.select(F.col("id").alias("a"), F.col("own").alias("own_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("own").alias("own_b")), "b")
        .select("a", "b", "own_a", "own_b")
        .mapInArrow(_confirm(percent), "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), a row for each input row.

    Texts are lower-cased (A-Z) and cut into distinct 5-word shingles; fewer words are one
    shingle. Documents link when 100 * intersection >= percent * union; percent is 80 or more.
    Null, empty and blank texts have no shingle, link with nothing and are kept. Rows with a
    null id come back with a null component and are kept. Rows that repeat an id are one node,
    which links with whatever any of its texts links with. Ties go to the smaller id.
    """
    if percent < 80:
        raise ValueError("signatures are sized for a threshold of 80 or more")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = cut(sketch(docs, id_col, text_col))
    named = sketched.filter(F.col("id").isNotNull() & F.col("key").isNotNull())
    classes = named.groupBy("key").agg(F.min("id").alias("rep"))
    reps = cut(
        named.join(classes, (named["key"] == classes["key"]) & (F.col("id") == F.col("rep")), "left_semi")
        .dropDuplicates(["id", "key"])
        .select("id", "n_shingles", "sig", "parity")
    )
    own = named.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("k0"), F.max("key").alias("k1")).filter("rows > 1")
    same = None  # links between the classes of an id with several texts
    if own.limit(1).count():
        plain = plain.dropDuplicates()
        mixed_ids = own.filter("k0 <> k1").select("id")
        same = cut(named.join(mixed_ids, "id", "left_semi").join(classes, "key").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())
    posted = reps.select("id", F.explode("sig").alias("token"))
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    prefix = cut(
        posted.join(lists, "token")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))
        .filter(F.size("own") >= MATCHES)
        .select("id", F.explode(F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1))).alias("own"))
        .select("id", "own.token")
    )
    leads = prefix.groupBy("token").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = prefix.join(leads, "token").filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    links = _verified(stars, reps, plain, percent)
    links = cut(links if same is None else links.unionByName(same))
    first = components(links, "a", "b")

    placed = prefix.join(leads, "token").join(first, F.col("id") == F.col("node"), "left").select(
        "token", "id", "lead", F.coalesce("component", "id").alias("comp")
    )
    sizes = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")).filter("k > 1")
    blocks = F.ceil((F.col("all") - F.col("top.n")) / LIST_BLOCK).cast("int")
    open_lists = cut(placed.join(mixed.select("token", F.col("top.comp").alias("main"), blocks.alias("blocks")), "token"))
    held = open_lists.groupBy("id").agg(F.collect_set("token").alias("in"))  # fewer than COORDINATES tokens a text
    open_lists = open_lists.join(held, "id")
    ours = open_lists.filter("comp <> main").select(
        "token", "lead", F.col("id").alias("a"), F.col("comp").alias("comp_a"), F.col("in").alias("in_a"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    )
    theirs = open_lists.select("token", F.col("id").alias("b"), "comp", "main", F.col("in").alias("in_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rest = (
        ours.join(_side(reps, "a"), "a")
        .join(theirs.join(_side(reps, "b"), "b"), ["token", "block"])
        .filter("comp_a <> comp AND (comp = main OR a < b) AND a <> lead AND b <> lead")
        .filter(_may_link(percent) & (F.col("token") == F.array_min(F.array_intersect("in_a", "in_b"))))  # in the first list they share, once
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    more = _verified(rest, reps, plain, percent)
    joined = components(links.unionByName(more), "a", "b")

    grouped = (
        classes.join(joined, F.col("rep") == F.col("node"), "left")
        .select(F.col("key").alias("k"), F.coalesce("component", "rep").alias("component"))
    )
    return (
        sketched.select("id", "n_shingles", "key")
        .join(grouped, F.col("key") == F.col("k"), "left")
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
        )
    )


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(own_session(spark, **SMALL_BATCHES), sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
                              ELSE array_to_string(w[i:i + 4], ' ') END) AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""
