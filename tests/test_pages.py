"""The reviewer's page: order and pages of all categories, filters, exports, video rows; and functions no query runs."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import scalars as S
from siftwork.operators import decisions as D
from siftwork.operators import pages
from siftwork.sources import files

ROWS = "id string, path string, rel string, category string, suggestion string, confidence double, bytes long, copy_distance long, copy_of string, page_no string"


def rows(spark, n):
    r = random.Random(3)
    data = [
        (f"k{i}", f"p{i}", r.choice(["A/x", "a/X", "b/y", "B/é"]) + str(r.randrange(40)), r.choice(["photo"] * 8 + ["meme", "whatsapp_copy"]), r.choice(["keep", "review", "reject"]), r.choice([0.0, 0.25, 0.5, 0.75]), r.randrange(5), r.randrange(4), None, "x")
        for i in range(n)
    ]
    return data, spark.createDataFrame(data, ROWS).repartition(3)


def order(x):
    return (x[7], -x[6], x[2].lower().encode(), x[2].encode(), x[0]) if x[3] == "whatsapp_copy" else (-x[5], 0, x[2].lower().encode(), x[2].encode(), x[0])


def test_pages_of_all_categories(spark):
    data, df = rows(spark, 900)
    placed = pages.page_numbers(df).cache()
    for category in ("photo", "meme", "whatsapp_copy"):
        want = [x[0] for x in sorted((x for x in data if x[3] == category), key=order)]
        got = []
        for page in range(-(-len(want) // 240)):
            own = [x["id"] for x in pages.read_page(placed, category, page).collect()]
            bounds = pages.page_bounds(placed).filter((F.col("category") == category) & (F.col("page") == page)).first()
            assert (bounds["rows"], bounds["first"], bounds["last"]) == (len(own), own[0], own[-1])
            got += own
        assert got == want
        assert pages.read_page(placed, category, 99).count() == 0
    assert pages.page_numbers(df.limit(0)).count() == 0


def test_filters(spark):
    data, df = rows(spark, 200)
    decided = pages.decision(df, spark.createDataFrame([("k1", "reject"), ("k2", "keep")], "id string, choice string"))
    by = {x["id"]: x["decision"] for x in decided.collect()}
    assert len(by) == 200 and by["k1"] == "reject" and by["k2"] == "keep" and all(by[x[0]] == ("reject" if x[4] == "reject" else "keep") for x in data[3:])
    ids = lambda *a, **k: {x["id"] for x in pages.shown(decided, *a, **k).collect()}
    assert ids("photo", least=0.5) == {x[0] for x in data if x[3] == "photo" and x[5] >= 0.5}
    assert ids("whatsapp_copy", least=0.9) == {x[0] for x in data if x[3] == "whatsapp_copy"}
    assert ids("photo", show="review", search=" A/X ") == {x[0] for x in data if x[3] == "photo" and x[4] == "review" and x[2].lower().startswith("a/x")}
    assert ids("photo", show="reject") == {x[0] for x in data if x[3] == "photo" and by[x[0]] == "reject"}
    with pytest.raises(KeyError):
        pages.similar_shown(df, "other")


def test_video_rows(spark):
    names = "id string, path string, rel string, name string, category string, confidence double, suggestion string, note string, why array<string>, top3 string, width int, height int, bytes long"
    videos = spark.createDataFrame([("a", "p/a", "a", "VID-20230505-WA0001.mp4", "meme", 0.98765, "reject", "", ["x", "y"], "t", 4, 3, 9), ("b", "p/b", "b", "b.mp4", "photo", 0.5, "keep", "", [], "", 8, 6, 10), ("c", "p/c", "c", "c.mp4", "photo", 0.5, "keep", "", [], "", 1, 1, 1)], names)
    got = {x["id"]: x for x in pages.video_rows(videos, spark.createDataFrame([("c", "b", True)], "id string, copy_of string, in_library boolean")).collect()}
    assert got["a"].asDict().keys() == pages.VIDEO.keys() and len(pages.TRIAGE) == 28
    assert (got["a"]["s"], got["a"]["nt"], got["a"]["cf"], got["a"]["why"], got["a"]["o"], got["a"]["wa"]) == ("review", "possible meme - check", 0.988, "x · y", "", True)
    assert (got["c"]["s"], got["c"]["nt"], got["c"]["c"], got["c"]["ct"], got["c"]["o"], got["c"]["oid"], got["c"]["ow"], got["c"]["oh"]) == ("reject", "already in your library", "video_copy", "video_copy", "p/b", "b", 8, 6)
    assert (got["b"]["s"], got["b"]["cf"], got["b"]["ppl"], got["b"]["gps"]) == ("keep", 0.5, 0, False)


def test_classify_and_heuristics(spark, tmp_path):
    """Functions of the library that no query runs."""
    (tmp_path / "map.json").write_text('{"a": "1", "é": "2"}', encoding="utf-8")
    assert {tuple(x) for x in files.read_json_map(spark, str(tmp_path / "map.json")).collect()} == {("a", "1"), ("é", "2")}
    sizes = spark.createDataFrame([(1170, 2532, ""), (1170, 2532, "Canon"), (4000, 3000, None)], "w int, h int, camera string")
    got = [tuple(x["c"]) for x in sizes.select(D.heuristic_category(F.col("w"), F.col("h"), F.col("camera")).alias("c")).collect()]
    assert got == [("screenshot", 0.7), ("unknown", 0.0), ("unknown", 0.0)]
    kinds = spark.createDataFrame([("a.JPG",), ("a.jpg.supplemental-metadata.json",), ("a.txt",)], "n string")
    assert [x[0] for x in kinds.select(files.classify(F.col("n"), (".jpg",))).collect()] == ["media", "sidecar", "other"]
    names = spark.createDataFrame([("x/IMG-20230505-WA0013.jpg", None), ("WhatsApp Images/a.jpg", None), ("b.jpg", "WhatsApp Video"), ("b.jpg", "Camera"), ("b.jpg", None)], "rel string, folder string")
    assert [x[0] for x in names.select(S.is_messenger(F.col("rel"), F.col("folder"))).collect()] == [True, True, True, False, False]
