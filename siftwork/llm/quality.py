"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target text (labelled good) and one of raw
text (every document), give each document a log importance weight. Gumbel noise is added and
the k largest are sampled, where k is the number of documents whose weight passes the cut that
parts good from bad labels best.

N-grams are of words and of word shapes (case, digits, punctuation, length, repetition), so
that noise is told from prose in any vocabulary. The weight of a bucket is the smoothed ratio
(target + s) / (expected + s), where expected is what raw text would put there.

Three scans, no shuffle of text: raw and target counts, weights, and the sampled rows. What
reaches the driver is one count per bucket, the bounded labelled sample and histograms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.words import U, Slice, arrow_rows, mix, slices
from siftwork.session import SMALL_BATCHES, cut, own_session, table

BUCKETS = 1 << 16
#: Labelled rows used for the target model and for the cut, at most; taken in hash order.
SAMPLE = 20_000
SMOOTH = 20.0
_UPPER, _LOWER, _DIGIT, _PUNCT = (np.zeros(256, np.int32) for _ in range(4))
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_LOWER[128:] = 1
_DIGIT[48:58] = 1
_PUNCT[33:128] = 1
_SALTS = mix(np.arange(101, 107, dtype=U))
_PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 0


def _previous(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """x shifted by one word; 0 before each text's first word."""
    out = np.zeros_like(x)
    out[1:] = x[:-1]
    out[first[:-1][first[:-1] < len(x)]] = 0
    return out


def gram_buckets(part: Slice) -> list[np.ndarray]:
    """For each kind of n-gram the bucket of the one that ends at each word."""
    word = part.hashes()
    if not len(word):
        return []
    count = {}
    for name, kind in (("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("punct", _PUNCT)):
        total = np.zeros(len(part.data) + 1, np.int32)
        np.cumsum(kind[part.data], out=total[1:])
        count[name] = total[part.end] - total[part.start]
    last = part.data[part.end - 1].astype(np.int64)
    shape = np.minimum(count["upper"], 2).astype(np.int64)
    shape += 4 * (count["lower"] > 0) + 8 * (count["digit"] > 0) + 16 * np.minimum(count["punct"], 3)
    shape += 64 * np.minimum((part.end - part.start) // 4, 7) + 512 * np.where(_PUNCT[last] > 0, last, 0)
    shape = mix(shape.astype(U) + U(1))
    same = (word == _previous(word, part.first)).astype(U)
    run = same + U(2) * _previous(same, part.first)
    run = run + U(4) * _previous(run, part.first)
    before, shape_before = _previous(word, part.first), _previous(shape, part.first)
    pair = mix(shape * U(3) + shape_before)
    kinds = (word, mix(word * U(3) + before), shape, pair, mix(pair * U(5) + _previous(shape_before, part.first)), run)
    return [(mix(x + salt) >> U(48)).astype(np.int64) for x, salt in zip(kinds, _SALTS, strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = arrow_rows(batch, "good").to_numpy(zero_copy_only=False)
        for part in slices(arrow_rows(batch, "text")):
            own = np.repeat(good[part.rows], np.diff(part.first))
            for kind in gram_buckets(part):
                raw += np.bincount(kind, minlength=BUCKETS)
                target += np.bincount(kind[own], minlength=BUCKETS)
    full = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array(raw[full]), pa.array(target[full])], names=["bucket", "raw", "target"]
    )


def log_weights(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """The sum of the model's log ratios over each text's n-grams."""
    out = []
    for part in slices(column):
        total = np.zeros(len(part.first) - 1)
        full = np.flatnonzero(np.diff(part.first))
        if len(full):  # each text on its own, so that its weight is the same in any batch
            total[full] = np.add.reduceat(sum(model[k] for k in gram_buckets(part)), part.first[full])
        out.append(total)
    return np.concatenate(out) if out else np.zeros(0)


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, bound: int) -> DataFrame:
    """At most `bound` labelled ids in hash order: (sid, good)."""
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return (
        own.groupBy(F.col(id_col).alias("sid"))
        .agg(F.max((F.col(label_col) > 0).cast("int")).alias("good"))
        .orderBy(F.xxhash64("sid"), "sid")
        .limit(bound)
    )


def fit(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Log ratio of target to raw for each bucket. sample has at most SAMPLE rows, so it is broadcast."""
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))  # whatever else docs has
    own = plain.join(F.broadcast(sample), F.col("__id") == F.col("sid"), "left").select("text", F.coalesce(F.col("good") > 0, F.lit(False)).alias("good"))
    counts = own.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts.collect():  # one row for each of BUCKETS at most
        raw[bucket], target[bucket] = r, t
    expected = raw / max(1.0, raw.sum()) * target.sum()
    return np.log((target + SMOOTH) / (expected + SMOOTH))


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest errors on labelled rows, where a good row lost counts as ten bad ones kept.

    Among equals the middle of the widest gap. Without both labels nothing is cut.
    """
    if not len(scores) or good.all() or not good.any():
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    errors = 10 * np.append(0, np.cumsum(g)) + ((~g).sum() - np.append(0, np.cumsum(~g)))
    edges = np.concatenate(([s[0] - 1.0], s, [s[-1] + 1.0]))
    gap = edges[1:] - edges[:-1]
    best = max(np.flatnonzero(errors == errors[gap > 0].min()), key=lambda i: gap[i])
    return float((edges[best] + edges[best + 1]) / 2)


def gumbel(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise fixed by id and seed."""
    u = (F.xxhash64(id_col, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(scored: DataFrame, key: str, k: int, bins: int = 4096) -> float:
    """The k-th largest key, by histograms that zoom in; the driver sees `bins` counts a round."""
    low, high, n = scored.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        rows = (
            scored.filter(F.col(key).between(low, high))
            .groupBy(place.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for r in rows:
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
        if r.n == 1:
            break
    return float(low)


def quality_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    label_id_col: str = "doc_id", sample: int = SAMPLE, seed: int = 17,
) -> tuple[DataFrame, float, object]:
    """((id_col, log_weight, sort_key, kept) for each row, the sampled key from which rows are kept, the scoring UDF).

    Every row is scored on its whole text; a null, empty or blank text has weight 0. Rows that
    repeat an id get the same noise; of their weights the least counts for the label. Ties at the cut are all kept. Without labels of both kinds
    everything is kept. A null id has noise of its own and is judged like any other.
    """
    spark = docs.sparkSession
    chosen = cut(labelled_sample(labels, label_col, label_id_col, sample))
    model = spark.sparkContext.broadcast(fit(docs, chosen, id_col, text_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = log_weights(arrow_rows(batch, "text"), model.value)
            yield pa.RecordBatch.from_arrays([arrow_rows(batch, "id").cast(pa.int64()), pa.array(got)], names=["id", "log_weight"])

    @F.arrow_udf("double")
    def weight(text: pa.Array) -> pa.Array:
        return pa.array(log_weights(text, model.value))

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = cut(
        plain.mapInArrow(score, "id long, log_weight double").withColumn("sort_key", F.col("log_weight") + gumbel(F.col("id"), seed))
    )
    labelled = scored.join(F.broadcast(chosen), F.col("id") == F.col("sid"))
    known = labelled.groupBy("sid").agg(F.min("log_weight").alias("w"), F.max("good").alias("good")).select("w", "good").collect()  # `sample` rows at most
    at = best_cut(np.array([r[0] for r in known]), np.array([r[1] > 0 for r in known], bool))
    k = scored.filter(F.col("log_weight") >= at).count()
    least = kth_largest(scored, "sort_key", k)
    out = scored.select(F.col("id").alias(id_col), "log_weight", "sort_key", (F.col("sort_key") >= F.lit(least)).alias("kept"))
    return out, least, weight


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, **options) -> DataFrame:
    """The sampled rows of docs with all their columns; see quality_sample.

    Texts are scored again rather than shuffled to meet their decision: a text's weight depends on
    nothing but the text, so the decision is the same, also when a task is run again.
    """
    _, least, weight = quality_sample(docs, labels, id_col, text_col, seed=seed, **options)
    return docs.filter(weight(F.col(text_col)) + gumbel(F.col(id_col).cast("long"), seed) >= F.lit(least))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and decision for every document, with labels' quality as the target."""
    own = own_session(spark, **SMALL_BATCHES)
    docs = table(own, sf_dir, "documents").select("doc_id", "text")
    return quality_sample(docs, table(own, sf_dir, "labels"))[0]
