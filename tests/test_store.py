"""Tables kept in place: how much a merge writes, and a log whose job is killed."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from siftwork.sources.store import KeyedTable, run_logged


def rows_of(df):
    return sorted(tuple(r) for r in df.select("k", "n", "v").collect())


def test_a_small_merge_writes_few_files(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 1000).alias("k"), F.floor(F.col("id") / 1000).alias("n"), F.lit("old").alias("v"))
    store = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=500)
    store.create(rows)
    before = set(store.read().inputFiles())
    new = spark.createDataFrame([(k, 9, "new") for k in range(8)] + [(5000, 0, "new"), (None, 0, "new")], "k long, n long, v string")
    touched = store.merge(new.unionByName(new.limit(0)))
    after = set(store.read().inputFiles())
    assert touched <= 10 and len(before - after) <= 10 and len(after - before) <= 10  # a hundredth of the keys, about a hundredth of the files
    assert len(before & after) >= 0.97 * len(before)
    want = sorted([r for r in rows_of(rows) if r[0] >= 8] + [(k, 9, "new") for k in range(8)] + [(5000, 0, "new")])
    assert rows_of(store.read().filter("k IS NOT NULL")) == want and store.read().filter("k IS NULL").count() == 1
    assert store.merge(new.limit(0)) == 0
    with pytest.raises(Exception, match="(?i)exist"):
        store.create(rows)


def test_merge_of_its_own_rows(spark, tmp_path):
    """What is merged may be read from the table itself; repeated rows of a key come whole."""
    store = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=4)
    store.create(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "b")], "k long, n long, v string"))
    store.merge(store.read().filter("k = 1").withColumn("v", F.lit("c")))
    store.merge(store.read().filter("k = 1").withColumn("v", F.concat("v", F.lit("!"))))
    assert rows_of(store.read()) == [(1, 1, "c!"), (1, 2, "c!"), (2, 1, "b")]


WORK = """
import os, signal
import pandas as pd
def worker(marker, pid):
    def work(batches):
        for b in batches:
            if (b["id"] == 150).any() and not os.path.exists(marker):
                open(marker, "w").close()
                os.kill(pid, signal.SIGKILL)
                import time; time.sleep(60)
            yield pd.DataFrame({"id": b["id"], "result": "OK"})
    return work
"""


def test_a_killed_log_goes_on(spark, tmp_path):
    """The driver is killed in the middle: whole steps stay readable, and a rerun logs each row once."""
    script = WORK + textwrap.dedent(f"""
        from siftwork.session import local_session
        from siftwork.sources.store import run_logged
        s = local_session(2)
        todo = s.range(200).repartitionByRange(20, "id")
        run_logged(todo, worker({str(tmp_path / "marker")!r}, os.getpid()), "id long, result string", {str(tmp_path / "log")!r}, {str(tmp_path / "state")!r}, flush=10, files=4)
    """)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", script], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=240)
    assert out.returncode == -9 and (tmp_path / "marker").exists()
    log = str(tmp_path / "log")
    early = [r["id"] for r in spark.read.parquet(log).collect()] if (tmp_path / "log/_spark_metadata/0").exists() else []
    assert len(early) == len(set(early)) < 200 and 150 not in early
    space = {}
    exec(WORK, space)
    for _ in range(2):  # the second finds nothing to do
        run_logged(spark.range(200), space["worker"](str(tmp_path / "marker"), 0), "id long, result string", log, str(tmp_path / "state"), flush=10, files=4)
    assert sorted(r["id"] for r in spark.read.parquet(log).collect()) == list(range(200))
    assert set(early) <= set(range(200)) and len(early) % 10 == 0
