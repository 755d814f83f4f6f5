"""Models behind a cache, and counters that are gathered while a report is written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions.inference import embed_missing
from siftwork.sources import files


def model_of(folder):
    """A model that notes each loading, and each batch with its size."""

    def make():
        import uuid

        (folder / f"load-{uuid.uuid4().hex}").touch()

        def predict(x):
            (folder / f"batch-{len(x)}-{uuid.uuid4().hex}").touch()
            return np.stack([x.sum(axis=1), x.max(axis=1)], axis=1)

        return predict

    return make


def test_only_what_the_cache_lacks_is_asked_in_batches(spark, tmp_path):
    items = spark.range(200).select(F.col("id").alias("key"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("pixels"))
    items = items.unionByName(items.filter("key = 3")).unionByName(spark.createDataFrame([(900, None), (901, [1.0, None]), (902, [])], "key long, pixels array<float>")).coalesce(1)
    cache = spark.createDataFrame([(k, [0.0], None) for k in range(0, 100)] + [(100, None, "bad"), (101, None, None)], "key long, embedding array<float>, error string")
    got = {x["key"]: x for x in embed_missing(items, cache, model_of(tmp_path), 32).collect()}
    assert set(got) == set(range(101, 200)) | {900, 901, 902}
    assert all(got[k]["embedding"] == [k + 1.0, float(k)] and got[k]["error"] is None for k in range(101, 200))
    assert {got[k]["error"] for k in (900, 901, 902)} == {"unreadable"}
    sizes = [int(p.name.split("-")[1]) for p in tmp_path.glob("batch-*")]
    loads = len(list(tmp_path.glob("load-*")))
    assert sum(sizes) == 99 and max(sizes) <= 32 and 1 <= loads <= 8 and loads <= len(sizes)
    assert embed_missing(items, items.select("key", F.array(F.lit(1.0)).alias("embedding"), F.lit("").alias("error")), model_of(tmp_path)).count() == 0
    assert len(list(tmp_path.glob("batch-*"))) == len(sizes)  # nothing more was asked
    assert embed_missing(items.limit(0), cache, model_of(tmp_path)).count() == 0


def test_counters_take_no_job_of_their_own(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") % 7 == 0).alias("odd"))
    sc = spark.sparkContext
    sc.setJobGroup("report", "report")
    got = files.write_report(rows, str(tmp_path / "r"), {"n": F.count(F.lit(1)), "odd": F.count_if("odd"), "top": F.max("id")})
    jobs = sc.statusTracker().getJobIdsForGroup("report")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"n": 1000, "odd": 143, "top": 999} and len(jobs) == 1
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 1000
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_report(rows, str(tmp_path / "r"), {"n": F.count(F.lit(1))})
