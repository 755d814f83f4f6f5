"""Classes of equal pictures, and hot chunks dealt over blocks."""

import random

from pyspark.sql import functions as F

from siftwork.operators import similar


def test_a_hundred_thousand_equal_pictures(spark):
    n = 100_000
    face = [F.array(*[F.lit(k).cast("long") for k in (11, 12, 13, 14)]).alias("hashes"), F.array(*[F.array(F.lit(1.0), F.lit(2.0))] * 4).alias("greys")]
    same = spark.range(n).select("id", (F.col("id") == n - 1).alias("is_new"), *face)
    other = spark.createDataFrame([(n + 5, False, [10, 9, 9, 9], [[1.0, 2.0]] * 4), (n + 6, False, None, None), (n + 7, True, None, None)], "id long, is_new boolean, hashes array<long>, greys array<array<double>>")
    members, pairs = similar.similar_classes(same.unionByName(other))
    assert [tuple(x) for x in members.groupBy("class_id", "n", "any_new").count().orderBy("class_id").collect()] == [(0, n, True, n), (n + 5, 1, False, 1), (n + 6, 1, False, 1), (n + 7, 1, True, 1)]
    assert [(x["a"], x["b"], x["distance"]) for x in pairs.collect()] == [(0, n + 5, 1)]


def test_hot_chunks_are_dealt(spark, monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(similar, "BLOCK", 7)
    low = [(i, r.getrandbits(20) << 32 | r.getrandbits(4)) for i in range(400)]  # two chunks are alike in all
    df = spark.createDataFrame(low, "id long, h long").repartition(5)
    for distance in (3, 7):
        got = similar.hamming_join(df.select(F.col("id").alias("a"), F.col("h").alias("x")), df.select(F.col("id").alias("b"), F.col("h").alias("y")), "x", "y", distance).collect()
        want = {(a, b): (x ^ y).bit_count() for a, x in low for b, y in low if (x ^ y).bit_count() <= distance}
        assert len(got) == len(want) and {(g["a"], g["b"]): g["distance"] for g in got} == want
