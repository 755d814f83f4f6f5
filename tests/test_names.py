"""Collision-free names against naming one after the other, and totals of a key that spans ranges."""

import random
import re

from pyspark.sql import functions as F

from siftwork.operators import planner


def one_by_one(plan, existing):
    taken = {(d.lower(), n.lower()) for d, n in existing}
    last, out = {}, {}
    for source, d, name in sorted(plan, key=lambda r: (r[1].lower(), r[2].lower(), r[0].lower(), r[0])):
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        key = (d.lower(), name.lower())
        n, new = last.get(key, 1), name
        while (d.lower(), new.lower()) in taken:
            n += 1
            new = f"{stem} ({n}){ext}"
        last[key] = n
        taken.add((d.lower(), new.lower()))
        out[source] = new
    return out


def test_equals_naming_one_by_one(spark):
    r = random.Random(6)
    stems = ["a", "A", "a (2)", "a (3)", "a (2) (2)", "a (2) (3)", "a (1)", "a (02)", "b", "a.b", ".h", ".h (2)", "a (99999999999999999999)", "é", "É (4)", "(2)", " (2)"]
    for n in (0, 5, 60, 400):
        names = lambda k: [(r.choice("DdE"), r.choice(stems) + r.choice(["", "", ".jpg", ".JPG", "."])) for _ in range(k)]
        plan = [(f"s{r.random()}", d, x) for d, x in names(n)]
        existing = names(n // 6)
        got = planner.collision_free(spark.createDataFrame(plan, "source string, dir string, name string"), spark.createDataFrame(existing, "dir string, name string")).collect()
        assert {x["source"]: x["dest"] for x in got} == one_by_one(plan, existing) and len(got) == n
        assert all(x["renamed"] == (x["name"] != x["dest"]) for x in got)


def test_a_large_family_is_spread(spark):
    n = 200_000
    plan = spark.range(n).select(F.format_string("%09d", "id").alias("source"), F.lit("D").alias("dir"), F.lit("a.jpg").alias("name"))
    there = spark.createDataFrame([("d", f"A ({i}).jpg") for i in range(3, 1000, 7)], "dir string, name string")
    got = planner.collision_free(plan, there)
    assert got.select(F.lower("dest")).distinct().count() == n and got.join(there.select(F.lower("name").alias("low")), F.lower("dest") == F.col("low")).count() == 0
    last = got.orderBy(F.desc("source")).first()["dest"]
    assert int(re.search(r"\d+", last).group()) == n + len(range(3, 1000, 7))
    spread = planner.running(plan.limit(n), ["name"], ["source"], F.lit(1))
    sizes = [x["count"] for x in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * n


def test_nulls(spark):
    plan = spark.createDataFrame([("1", None, "a"), ("2", None, "a"), (None, "D", None), ("3", "D", None)], "source string, dir string, name string")
    assert sorted((x["source"] or "", x["dest"]) for x in planner.collision_free(plan).filter("name IS NOT NULL").collect()) == [("1", "a"), ("2", "a (2)")]
    assert planner.collision_free(plan).count() == 4
