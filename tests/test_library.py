"""Tables restated from the fixtures: duplicates, sidecars, dates, rules, names and plans."""

import io
import itertools
import json
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.functions import scalars as S
from siftwork.functions import vision
from siftwork.operators import decisions as D
from siftwork.operators import dedupe, planner, reconcile, sidecars, similar, tables
from siftwork.sources import files as sources
from siftwork.streaming import events as stream

ROOT = "Takeout/Google Photos"


def keepers(spark, files, sides):
    rows = spark.createDataFrame([(p, 4096, h) for p, h in files], "path string, size long, hash string")
    side = spark.createDataFrame([(s,) for s in sides], "path string")
    full = sidecars.attach(rows, sidecars.match_sidecars(rows, side)).withColumns({
        "depth": S.path_depth(F.col("path")), "clean": S.is_clean_name(S.base(F.col("path"))), "in_trash": S.in_trash(F.col("path")),
    })
    return {r.path: r for r in dedupe.choose_keeper(full).collect()}


def test_keeper_rules(spark):
    files = [
        (f"partA/{ROOT}/Album/cross.jpg", "1"), ("WhatsApp-001/IMG-20240101-WA0001.jpg", "1"),
        (f"partA/{ROOT}/Album/IMG(1).jpg", "2"), ("WhatsApp-001/IMG-20240101-WA0002.jpg", "2"),
        (f"partA/{ROOT}/Album/pic-edited.jpg", "3"), (f"partB/{ROOT}/Other/pic-edited.jpg", "3"),
        (f"partA/{ROOT}/Trash/trashed.jpg", "4"), (f"partB/{ROOT}/Album/trashed.jpg", "4"),
        (f"partA/{ROOT}/Bin/binned.jpg", "5"), (f"partB/{ROOT}/Album/binned.jpg", "5"),
    ]
    sides = [
        f"partB/{ROOT}/Album/cross.jpg{S.SIDECAR_SUFFIX}", f"partA/{ROOT}/Album/IMG.jpg.supplemental-metadata(1).json",
        f"partA/{ROOT}/Album/pic.jpg{S.SIDECAR_SUFFIX}", f"partA/{ROOT}/Trash/trashed.jpg{S.SIDECAR_SUFFIX}", f"partA/{ROOT}/Bin/binned.jpg{S.SIDECAR_SUFFIX}",
    ]
    got = keepers(spark, files, sides)
    kept = {p for p, r in got.items() if r.recommendation == "KEEP"}
    assert kept == {files[0][0], files[2][0], files[4][0], files[7][0], files[9][0]}
    assert (got[files[0][0]].meta_place, got[files[2][0]].meta_match, got[files[4][0]].meta_match) == ("OtherPart", "Numbered", "EditedOriginal")
    assert got[files[6][0]].reason.startswith("DELETE: in trash")


def test_orphans_and_needed(spark):
    files = spark.createDataFrame([(f"a/{ROOT}/A/own.jpg",), (f"b/{ROOT}/A/own.jpg",)], "path string")
    side = spark.createDataFrame([(f"a/{ROOT}/A/own.jpg{S.SIDECAR_SUFFIX}",), (f"c/{ROOT}/A/gone.jpg{S.SIDECAR_SUFFIX}",)], "path string")
    hits = sidecars.match_sidecars(files, side)
    assert [r.path for r in sidecars.orphans(side, hits).collect()] == [f"c/{ROOT}/A/gone.jpg{S.SIDECAR_SUFFIX}"]
    assert sidecars.still_needed(files.limit(0), files, hits).count() == 0
    assert sidecars.still_needed(files.filter("path like 'a%'"), files.filter("path like 'b%'"), hits).count() == 1


@pytest.mark.parametrize(
    ("name", "row", "source", "date"),
    [
        ("plain.jpg", {"taken": 1530860833}, "sidecar", "2018:07:06 15:07:13"),
        ("camera.jpg", {"exif_date": "2018:07:06 09:00:00", "taken": 1530860833}, "existing", "2018:07:06 09:00:00"),
        ("IMG-20230505-WA0013.jpg", {}, "whatsapp-name", "2023:05:05 12:00:00"),
        ("IMG-20170101-WA0001.jpg", {"taken": 1700000000}, "whatsapp-name", "2017:01:01 12:00:00"),
        ("IMG-20190101-WA0002.jpg", {"taken": 1530860833}, "sidecar", "2018:07:06 15:07:13"),
        ("scan.jpg", {"fallback": "2015-06-05T12:00:00"}, "fallback (approximate)", "2015:06:05 12:00:00"),
        ("clip.mp4", {"create_date": "0000:00:00 00:00:00", "taken": 1530860833}, "sidecar", "2018:07:06 15:07:13"),
        ("IMG_6397.mp4", {"create_date": "1970:01:01 00:00:00", "creation_date": "2016:11:22 23:30:47+08:00"}, "existing", "2016:11:22 23:30:47"),
        ("IMG_5842.mp4", {"create_date": "1970:01:01 00:00:00", "modify_date": "2016:11:22 23:21:17+08:00", "taken": 1769490360}, "existing", "2016:11:22 23:21:17"),
        ("nothing.jpg", {}, "none", None),
    ],
)
def test_date_precedence(spark, name, row, source, date):
    schema = "name string, zone string, exif_date string, xmp_date string, create_date string, creation_date string, modify_date string, taken long, fallback string"
    full = [name, "Asia/Hong_Kong", *(row.get(k.split()[0]) for k in schema.split(", ")[2:])]
    got = planner.choose_date(spark.createDataFrame([full], schema), 2026).first()
    assert (got.date_source, got.date_taken) == (source, date)


def test_forced_name_date(spark):
    schema = "name string, zone string, exif_date string, xmp_date string, create_date string, creation_date string, modify_date string, taken long, fallback string"
    rows = spark.createDataFrame([("20140215_193544.jpg", "UTC", "2004:02:10 02:16:14", None, None, None, None, None, None)], schema)
    assert planner.choose_date(rows, 2026, force_name=True).first().date_taken == "2014:02:15 19:35:44"


def test_gps_and_local_time(spark):
    row = spark.range(1).select(S.local_stamp(F.lit(1530860833), F.lit("Asia/Hong_Kong")).alias("a"), S.local_stamp(F.lit(1530860833), F.lit("Europe/London")).alias("b")).first()
    assert (row.a, row.b) == ("2018:07:06 15:07:13+08:00", "2018:07:06 08:07:13+01:00")


def test_shapes_and_rules(spark):
    sizes = [(1080, 2400), (2532, 1170), (4000, 3000), (1080, 1080), (1920, 1080), (750, 1334), (0, 5)]
    got = spark.createDataFrame(sizes, "w int, h int").select(S.screen_like(F.col("w"), F.col("h")).alias("s"), S.camera_shaped(F.col("w"), F.col("h")).alias("c")).collect()
    assert [r.s for r in got] == [True, True, False, False, False, True, False]
    assert [r.c for r in got] == [False, False, True, False, True, True, False]
    cases = [
        ("meme", 0.9, [], 0.0, False, "reject"), ("meme", 0.6, [], 0.0, False, "review"), ("meme", 0.9, ["GPS location"], 0.0, False, "review"),
        ("meme", 0.97, [], 0.3, False, "review"), ("meme", 0.97, [], 0.0, True, "review"), ("screenshot", 0.9, [], 0.0, True, "reject"),
        ("document", 0.9, [], 0.0, False, "review"), ("photo", 0.9, [], 0.0, False, "keep"), ("unreadable", 0.0, [], 0.0, False, "review"),
    ]
    rows = spark.createDataFrame([c[:5] for c in cases], "c string, p double, g array<string>, ph double, sh boolean")
    made = rows.select(D.decide(F.col("c"), F.col("p"), F.col("g"), F.col("ph"), F.col("sh")).alias("d")).collect()
    assert [r.d.suggestion for r in made] == [c[5] for c in cases]


def test_adjusted_probabilities(spark):
    p = F.create_map(*[x for c in S.CATEGORIES for x in (F.lit(c), F.lit(1 / 7))])
    one = lambda camera: spark.range(1).select(D.adjust_probabilities(p, F.lit(1080), F.lit(2400), F.lit(camera), F.lit("JPEG")).alias("p")).first().p
    bare, camera = one(""), one("Acme")
    assert max(bare, key=bare.get) == "screenshot" and max(camera, key=camera.get) == "photo"
    assert sum(bare.values()) == pytest.approx(1)


def test_copy_and_video_tables(spark):
    assert [r[0] for r in spark.createDataFrame([(4, 100.0, 100.0), (5, 200.0, 100.0), (2, 80.0, 100.0)], "d int, o double, c double").select(D.messenger_copy(F.col("d"), F.col("o"), F.col("c"))).collect()] == ["reject", "review", "review"]
    got = spark.createDataFrame([(0, False, None), (3, True, None), (3, False, "reject"), (3, False, None)], "n int, c boolean, s string").select(D.video_suggestion(F.col("n"), F.col("c"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["review", "reject", "review", "keep"]
    state = spark.createDataFrame([(True, True, False, False, False, "a", True), (False, True, False, False, False, "a", True), (True, True, True, True, False, "a", True), (True, True, False, False, False, "a[1]", True), (True, True, False, False, False, "a", False)],
                                  "k boolean, l boolean, t boolean, ts boolean, m boolean, p string, done boolean")
    out = state.select(D.quarantine_outcome(*[F.col(c) for c in state.columns])).collect()
    assert [r[0] for r in out] == ["MovedMedia", "ReviewRequired", "AlreadyInQuarantine", "ReviewRequired", "QuarantineFailedRolledBack"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=2, max_size=20), st.integers(0, 11))
def test_hamming_join_is_brute_force(spark, values, distance):
    values = values + [values[0] ^ 1, values[-1] ^ 5]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, h long")
    a, b = (rows.select(F.col("i").alias(x), F.col("h").alias(f"h{x}")) for x in "ab")
    got = {(r.a, r.b) for r in similar.hamming_join(a, b, "ha", "hb", distance, F.col("a") < F.col("b")).collect()}
    bits = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert got == {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if bits(values[i], values[j]) <= distance}


def test_hamming_join_refuses_what_meets_by_chance(spark):
    rows = spark.createDataFrame([(1, 1)], "i long, h long")
    with pytest.raises(ValueError):
        similar.hamming_join(rows, rows.withColumnRenamed("h", "g"), "h", "g", 12)


def test_similar_pictures(spark):
    grey = [0.0] * 4
    rows = [
        (1, [0, 10**9, 2**40, 77], [grey, grey, [9.0] * 4, grey], True), (2, [7, 1, 2, 3], [grey] * 4, False), (3, [2**40 + 1, 5, 6, 8], [[8.0] * 4] * 4, False),
        (4, [0xFFFF, 11, 12, 13], [grey] * 4, True), (5, [7, 1, 2, 3], [[7.0] * 4] * 4, False),
    ]
    df = spark.createDataFrame(rows, "id long, hashes array<long>, greys array<array<double>>, is_new boolean")
    assert {(r.a, r.b, r.rotation, r.distance, r["diff"]) for r in similar.similar_pictures(df).collect()} == {(1, 2, 0, 3, 0.0), (1, 3, 2, 1, 1.0)}


def test_messenger_and_video_matches(spark):
    columns = "id long, hash long, width int, height int, embedding array<double>"
    copies = spark.createDataFrame([(1, 0, 100, 100, [1.0, 0.0]), (2, 2**50, 100, 50, [1.0, 0.0])], columns)
    originals = spark.createDataFrame([(11, 63, 102, 100, [1.0, 0.0]), (12, 1, 90, 100, [1.0, 0.0]), (13, 63, 204, 200, [1.0, 0.0]), (14, 0, 100, 100, [0.0, 1.0]), (15, 127, 100, 100, [1.0, 0.0])], columns)
    assert [tuple(r) for r in similar.messenger_matches(copies, originals, cosine=0.92).collect()] == [(1, 13, 6)]
    assert [tuple(r) for r in similar.messenger_matches(copies, originals).collect()] == [(1, 14, 0)]
    rows = [(1, 10.0, [0, 0, 0], False, 5), (2, 10.5, [1, 2, 255], False, 9), (3, 10.4, [0, 0, 511], True, 50), (4, 9.4, [0, 0, 0], True, 50), (5, 9.9, [0, 0, 0], False, 4), (6, 0.0, [0, 0, 0], False, 1), (7, 10.2, [0, 0], False, 90)]
    every = spark.createDataFrame(rows, "id long, duration double, frames array<long>, in_library boolean, size long")
    assert {(r.id, r.copy_of) for r in similar.video_copies(every.filter("NOT in_library"), every).collect()} == {(1, 2), (2, 3), (5, 4)}


def test_band_join(spark):
    xs = [0.0, 0.4, 0.5, 1.0, -0.2, 7.0]
    rows = spark.createDataFrame(list(enumerate(xs)), "i long, v double")
    a, b = (rows.select(F.col("i").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
    got = {(r.a, r.b) for r in similar.band_join(a, b, "va", "vb", 0.5, F.col("a") < F.col("b")).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(xs)), 2) if abs(xs[i] - xs[j]) <= 0.5}


def test_collision_free_names(spark):
    plan = spark.createDataFrame([("s2", "D", "a.jpg"), ("s1", "D", "A.jpg"), ("s3", "D", "a (2).jpg"), ("s4", "D", "b.jpg"), ("s5", "E", "a.jpg")], "source string, dir string, name string")
    there = spark.createDataFrame([("D", "B.JPG")], "dir string, name string")
    got = {r.source: r.dest for r in planner.collision_free(plan, there).collect()}
    assert got == {"s3": "a (2).jpg", "s1": "A.jpg", "s2": "a (3).jpg", "s4": "b (2).jpg", "s5": "a.jpg"}


def test_refile(spark):
    rows = spark.createDataFrame([("2022-12 Trip 2022/23", None), (None, "2023:05:06 10:00:00"), ("", "")], "a string, d string")
    assert [tuple(r.t) for r in rows.select(D.refile_destination(F.col("a"), F.col("d")).alias("t")).collect()] == [
        ("Library/Albums/2022-12 Trip 2022-23", "album"), ("Library/2023/2023-05", "date"), ("Library/Undated", "undated"),
    ]


def test_plan_guard_and_restore(spark):
    m = spark.createDataFrame([(1, "MovedMedia", "a", "q", 1), (2, "Other", "b", "r", 1), (3, "MovedMetadata", "c", "s", 1)], "seq int, action string, source string, destination string, size int")
    plan = planner.restore_plan(m)
    assert [(r.from_path, r.to_path) for r in plan.orderBy(F.desc("seq")).collect()] == [("s", "c"), ("q", "a")]
    assert planner.check_expected(plan, 2) is plan
    with pytest.raises(ValueError):
        planner.check_expected(plan, 3)


def test_group_numbers_and_sample(spark):
    rows = spark.createDataFrame([(1000, "a"), (200, "b"), (200, "a")], "size long, hash string")
    assert {(r.size, r.hash): r.group_id for r in dedupe.number_groups(rows).collect()} == {(1000, "a"): "G00001", (200, "a"): "G00002", (200, "b"): "G00003"}
    for n, k in ((10, 4), (7, 7), (3, 5), (11, 1)):
        got = sorted(r.position for r in tables.systematic_sample(spark.range(n), [F.col("id")], k).collect())
        assert got == (list(range(n)) if k >= n else [int(i * n / k) for i in range(k)])


def test_archives(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr(zipfile.ZipInfo("Takeout/a.jpg", (2023, 5, 6, 7, 8, 10)), b"123")
        z.writestr("Takeout/dir/", b"")
        z.writestr("../evil.jpg", b"1")
    (tmp_path / "a.zip").write_bytes(raw.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    listed = sources.list_archives(sources.scan(spark, str(tmp_path)))
    got = {(r.entry, r.size, r.modified if r.entry == "Takeout/a.jpg" else None, r.unreadable) for r in listed.collect()}
    assert got == {("Takeout/a.jpg", 3, "2023-05-06 07:08:10", False), ("../evil.jpg", 1, None, False), (None, None, None, True)}
    plan = sources.extraction_plan(listed, "out")
    assert {r.entry: r.action for r in plan.collect()} == {"Takeout/a.jpg": "Extract", "../evil.jpg": "Blocked", None: "Unreadable"}
    there = spark.createDataFrame([("out/a/Takeout/a.jpg", 2)], "path string, size long")
    assert [r.status for r in sources.verify_extraction(plan, there).collect()] == ["SizeDiffers"]
    assert [r.status for r in sources.verify_extraction(plan, there.limit(0)).collect()] == ["Missing"]
    assert [r[0] for r in spark.createDataFrame([("../x",), ("a/../../b",), ("/abs",), ("C:x",), ("fine/..x",)], "e string").select(S.unsafe_entry(F.col("e"))).collect()] == [True, True, True, True, False]


def test_extraction_places(spark):
    rows = [("r/x.zip", "P.jpg", 0), ("r/x.zip", "p.jpg", 1), ("r/x.zip", "y.jpg", 2), ("r/x.zip", "y.jpg", 3), ("r/b.ZIP", "p.jpg", 0), ("s/x.zip", "z.jpg", 0), ("s/x.zip", "Y.jpg", 1), ("r/c.zip", "p.jpg", 0), ("r/c.zip", "/abs", 1)]
    entries = spark.createDataFrame([(*x, False) for x in rows], "archive string, entry string, position long, unreadable boolean")
    plan = {(r.archive, r.position): (r.destination, r.action) for r in sources.extraction_plan(entries, "out/", spark.createDataFrame([("OUT/C",)], "path string")).collect()}
    assert plan == {
        ("r/x.zip", 0): ("out/x/P.jpg", "Extract"), ("r/x.zip", 1): ("out/x/p.jpg", "Conflict"), ("r/x.zip", 2): ("out/x/y.jpg", "Extract"), ("r/x.zip", 3): ("out/x/y.jpg", "Conflict"),
        ("r/b.ZIP", 0): ("out/b/p.jpg", "Extract"), ("s/x.zip", 0): ("out/x/z.jpg", "Extract"), ("s/x.zip", 1): ("out/x/Y.jpg", "Conflict"), ("r/c.zip", 0): ("out/c/p.jpg", "Skip"), ("r/c.zip", 1): ("out/c//abs", "Skip"),
    }


def test_to_do_gives_each_item_once(spark):
    items = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    cache = spark.createDataFrame([(1, None, None), (1, None, None), (2, None, None), (2, "v", None), (3, None, "e")], "k long, v string, e string")
    assert sorted((r.k for r in tables.to_do(items, cache, "k", "v", "e").collect()), key=str) == [1, None]


def test_walk(spark, tmp_path):
    base = tmp_path / "part1/Takeout/Google Photos"
    for rel, data in (("Trip/a.jpg", b"1"), ("Trip/deep/b.jpg", b"22"), ("Trash/c.jpg", b"3"), ("Photos from 2020/d.jpg", b"4"), ("Trip/e.mp4", b"")):
        (base / rel).parent.mkdir(parents=True, exist_ok=True)
        (base / rel).write_bytes(data)
    (base / "Trip/link").symlink_to(base / "Trip")
    (base / f"Trip/a.jpg{S.SIDECAR_SUFFIX}").write_text("{}")
    roots = {"Library": str(tmp_path), "Again": str(tmp_path) + "/", "Gone": str(tmp_path / "nowhere")}
    files, errors = sources.walk(spark, roots)
    name = lambda p: p.rsplit("/", 1)[1]
    assert sorted(name(r.path) for r in files.collect()) == ["a.jpg", f"a.jpg{S.SIDECAR_SUFFIX}", "b.jpg", "c.jpg", "d.jpg", "e.mp4"]
    assert {(r.root, name(r.path)) for r in errors.collect()} == {("Gone", "nowhere")} and {r.root for r in files.collect()} == {"Library"}
    with pytest.raises(RuntimeError):
        sources.incomplete_scan_guard(errors.select("path"), report_only=False)
    clean, none = sources.walk(spark, {"Library": str(tmp_path)}, prune_trash=True, empty=False)
    assert sorted(name(r.path) for r in clean.collect()) == ["a.jpg", f"a.jpg{S.SIDECAR_SUFFIX}", "b.jpg", "d.jpg"] and none.isEmpty()
    assert [(r.album, r.base_name) for r in sources.album_scan(files.filter("path LIKE '%.jpg'"), str(tmp_path)).collect()] in ([("Trip", "a.jpg"), ("Trash", "c.jpg")], [("Trash", "c.jpg"), ("Trip", "a.jpg")])
    assert [name(r.path) for r in sources.trash_inventory(files).collect()] == ["c.jpg"]
    library = sources.scan_library(files, files.filter(F.col("path").rlike(S.SIDECAR)), (".jpg",)).collect()
    assert sorted((name(r.path), r.has_meta) for r in library) == [("a.jpg", True), ("b.jpg", False), ("d.jpg", False)]
    assert [(r.is_new, name(r.path)) for r in sources.video_scans(files, files, (".mp4",)).collect()] == [(False, "e.mp4")]
    assert {r.part_rel for r in sources.file_index(files, str(tmp_path)).filter("name = 'b.jpg'").collect()} == {"takeout/google photos/trip/deep/b.jpg"}
    assert sources.scan_roots(spark, {"One": str(tmp_path), "Two": str(tmp_path)}).select("root").distinct().count() == 1


def test_zones(spark):
    places = spark.createDataFrame([(22.3, 114.1), (31.2, 121.5), (0.0, 0.0), (None, 5.0), (22.1, 113.8)], "lat double, lon double")
    zones = spark.createDataFrame([("small", 22.1, 22.6, 113.8, 114.4), ("large", 18.0, 54.0, 73.0, 135.0)], "zone string, south double, north double, west double, east double")
    got = {(r.lat, r.lon): r.zone for r in planner.zone_of(places, zones, "home").collect()}
    assert got == {(22.3, 114.1): "small", (31.2, 121.5): "large", (0.0, 0.0): "home", (None, 5.0): "home", (22.1, 113.8): "small"}


def test_deletion_and_metadata_plans(spark):
    done = spark.createDataFrame([("MovedMedia", "q/a", 1), ("ReviewRequired", "q/b", 2)], "action string, destination string, size int")
    assert [r.path for r in planner.deletion_plan(done, "DELETE 1").collect()] == ["q/a"]
    with pytest.raises(ValueError):
        planner.deletion_plan(done, "yes")
    pairs = spark.createDataFrame([("a", "b", {"x": "1", "y": "2"}, {"y": "3"}), ("c", "d", {"x": "1"}, {"x": "1"})], "source string, target string, source_tags map<string,string>, target_tags map<string,string>")
    assert [(r.target, r.backup, r.tags) for r in planner.metadata_copy_plan(pairs).collect()] == [("b", "b_original", {"x": "1"})]


def test_formats(spark):
    row = spark.createDataFrame([("a\\b c/\u00e9&.jpg", 1_234_567)], "p string, n long")
    got = row.select(S.file_url(F.col("p")), S.csv_quote(F.lit('say "x"')), S.html_escape(F.lit("<a&b>")), S.bytes_text(F.col("n")), S.bytes_text(F.lit(999)), sources.log_line(F.timestamp_seconds(F.lit(0)), "warn", F.lit("odd"))).first()
    assert tuple(got) == ("file:///a/b%20c/%C3%A9%26.jpg", '"say ""x"""', "&lt;a&amp;b&gt;", "1.2 MB", "999 B", "[1970-01-01 00:00:00] [WARN] odd")


def test_sidecar_json_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text(json.dumps({"photoTakenTime": {"timestamp": "12"}, "people": [{"name": "A"}, {"name": "B"}], "geoData": {"latitude": 22.3, "longitude": 114.1, "altitude": 0}}))
    (tmp_path / "in/y.json").write_text("not json")
    rows = {r.path.rsplit("/", 1)[1]: r for r in sources.read_sidecars(spark, str(tmp_path / "in")).collect()}
    assert [p.name for p in rows["x.json"].people] == ["A", "B"] and rows["x.json"].photoTakenTime.timestamp == "12" and rows["y.json"].people is None
    one = spark.createDataFrame([("t", "MovedMedia", "a", "b", 1, "h", "")], sources.MANIFEST)
    for _ in range(2):
        sources.append_manifest(one, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    sources.write_csv(one.limit(0), str(tmp_path / "c"))
    assert sources.read_csv(spark, str(tmp_path / "c"), sources.MANIFEST).count() == 0
    with pytest.raises(Exception):
        sources.write_csv(one, str(tmp_path / "c"))
    with pytest.raises(RuntimeError):
        sources.incomplete_scan_guard(spark.createDataFrame([("denied",)], "e string"), report_only=False)


def test_backup_and_trash(spark):
    s = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("d", 4, "w")], "rel string, size int, hash string")
    b = spark.createDataFrame([("a", 1, "x"), ("b", 9, "y"), ("c", 3, "q")], "rel string, size int, hash string")
    assert {r.rel: r.status for r in reconcile.verify_backup(s, b).collect()} == {"a": "OK", "b": "SizeDiffers", "c": "HashDiffers", "d": "MissingOnBackup"}


def test_vision():
    grey = np.random.default_rng(0).integers(0, 255, (32, 32))
    assert vision.perceptual_hash(grey) == vision.perceptual_hash(grey + 3)
    assert len(set(vision.rotations(grey))) == 4
    assert vision.flatness(np.zeros((8, 8, 3), np.uint8)) == 1.0
    assert vision.thumbnail(np.full((300, 1000, 3), 7, np.uint8), 50)[16:24] == (50).to_bytes(4, "big") + (15).to_bytes(4, "big")
    assert vision.strip([np.zeros((4, 3, 3), np.uint8)] * 3).shape == (4, 17, 3)
    other = np.zeros((64, 64))
    other[:16, :16] = 8
    assert vision.worst_patch(np.zeros((64, 64)), other) == 8


def test_vision_udfs(spark):
    grey = np.random.default_rng(1).integers(0, 255, 1024).tolist()
    got = spark.createDataFrame([(grey, [1, 2, 3] * 4)], "g array<int>, c array<int>").select(vision.perceptual_hash_udf("g"), vision.flatness_udf("c")).first()
    assert got[0] == vision.perceptual_hash(np.array(grey).reshape(32, 32)) and got[1] == 1.0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    live = stream.read_events(spark, str(tmp_path / "e"), events.schema)
    q = stream.windowed_counts(live).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").select("start", "event_type", "n").collect())) == sorted(map(tuple, stream.windowed_counts(events).select("start", "event_type", "n").collect()))
    assert stream.once(events.union(events)).count() == events.count()
