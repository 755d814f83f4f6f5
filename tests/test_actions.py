"""Logged moves: undo over chains against a replay, states of interrupted quarantines, emptied folders on deep and wide trees."""

import random

from pyspark.sql import functions as F

from siftwork.operators import actions

MANIFEST = "seq long, action string, source string, destination string, size long"


def history(r, steps):
    """A random valid history: (manifest rows, path -> file id now, file id -> (origin, first, last))."""
    at, files, rows, new = {}, {}, [], 0
    for seq in range(steps):
        if not at or r.random() < 0.3:
            free = [p for p in "abcdefgh" if p not in at]
            if free:
                at[r.choice(free)] = new
                new += 1
        source = r.choice(list(at))
        free = [p for p in "abcdefghij" if p not in at]
        if not free:
            continue
        dest = r.choice(free)
        f = at.pop(source)
        at[dest] = f
        rows.append((seq, r.choice(["MovedMedia", "MovedMetadata"]), source, dest, f))
        origin, first, _ = files.get(f, (source, seq, seq))
        files[f] = (origin, first, seq)
        rows.append((seq, "ReviewRequired", source, "", f))
    return rows, at, files


def statuses(at, files, gone):
    place = {f: p for p, f in at.items() if p not in gone}
    kind = {f: "SKIP not found" if f not in place else "HOME" if place[f] == o else "RESTORE" for f, (o, _, _) in files.items()}
    best = {}
    for f, (o, first, _) in files.items():
        if kind[f] == "RESTORE":
            best[o] = max(best.get(o, (-1, None)), (first, f))
    wins = {f for _, f in best.values()}
    holder = {p: f for f, p in place.items()}
    stuck = set(f for f in kind if kind[f] == "RESTORE") - wins
    while True:
        more = {f for f in wins - stuck if files[f][0] in holder and holder[files[f][0]] not in wins - stuck}
        if not more:
            break
        stuck |= more
    return {f: "SKIP occupied" if f in stuck else kind[f] for f in kind}


def test_restore_equals_a_replay(spark):
    r = random.Random(5)
    for steps in (0, 12, 40, 160):
        rows, at, files = history(r, steps)
        gone = set(r.sample(sorted(at), len(at) // 4))
        now = spark.createDataFrame([(p,) for p in at if p not in gone] * 2, "path string")
        got = actions.restore(spark.createDataFrame(rows, MANIFEST), now).collect()
        want = statuses(at, files, gone)
        assert {x["size"]: (x["origin"], x["first_seq"], x["last_seq"], x["status"]) for x in got} == {f: (*files[f], want[f]) for f in files}
        assert len(got) == len(files)


def test_undo_in_order_never_overwrites(spark):
    """What is to be restored ends at home when undone in the order of the manifest, as far as nothing is skipped."""
    rows = [(1, "MovedMedia", "A", "T", 1), (2, "MovedMedia", "B", "A", 2), (3, "MovedMedia", "T", "B", 1)]
    df = spark.createDataFrame(rows, MANIFEST)
    now = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    status = lambda n: {x["size"]: x["status"] for x in actions.restore(df, n).collect()}
    assert status(now("A", "B")) == {1: "RESTORE", 2: "RESTORE"}  # they changed places
    assert status(now("A")) == {1: "SKIP not found", 2: "RESTORE"}
    assert status(now()) == {1: "SKIP not found", 2: "SKIP not found"}


def test_chains_of_a_thousand_moves(spark):
    n = 1000
    links = spark.range(n).select(F.col("id").alias("node"), (F.col("id") + 1).alias("next"))
    loops = spark.createDataFrame([(2000, 2001), (2001, 2002), (2002, 2000), (3000, 3000)], "node long, next long")
    got = {x["node"]: (x["last"], x["hops"], x["looped"]) for x in actions.chain_ends(links.union(loops)).collect()}
    assert got == {i: (n, n - i, False) for i in range(n)} | {i: (None, None, True) for i in (2000, 2001, 2002, 3000)}
    moves = spark.range(n).select(F.col("id").alias("seq"), F.lit("MovedMedia").alias("action"), F.concat(F.lit("p"), F.col("id")).alias("source"), F.concat(F.lit("p"), F.col("id") + 1).alias("destination"), F.lit(1).alias("size"))
    row = actions.restore(moves, spark.createDataFrame([(f"p{n}",)], "path string")).collect()
    assert [(x["origin"], x["place"], x["moves"], x["status"]) for x in row] == [("p0", f"p{n}", n, "RESTORE")]
    assert actions.restore(moves.limit(0), moves.select(F.col("source").alias("path"))).count() == 0


PLAN = "pair_id long, keeper string, media string, media_to string, size long, hash string, side string, side_to string"
LOG, NOW = "seq long, action string, source string, destination string, hash string", "path string, size long, hash string"


def test_interrupted_at_every_point(spark):
    """A pair whose job dies after any of its steps, with the log written or not, is rolled back, finished or reviewed."""
    full = [("k", 1, "h"), ("m", 1, "h"), ("s", 2, "t")]
    disk = {"start": full, "media": [("k", 1, "h"), ("m2", 1, "h"), ("s", 2, "t")], "both": [("k", 1, "h"), ("m2", 1, "h"), ("s2", 2, "t")], "side": [("k", 1, "h"), ("m", 1, "h"), ("s2", 2, "t")]}
    media, side, back = (1, "MovedMedia", "m", "m2", "h"), (2, "MovedMetadata", "s", "s2", "t"), (3, "RolledBack", "m2", "m", "h")
    cases = [
        ("start", [], ("none", "Planned", "Move")),
        ("start", [media, back], ("none", "Planned", "Move")),  # moved and put back
        ("media", [], ("none", "MediaMoved", "RollBackMedia")),  # died before it could log
        ("media", [media], ("media", "MediaMoved", "RollBackMedia")),
        ("both", [media], ("media", "Moved", "Done")),
        ("both", [media, side], ("both", "Moved", "Done")),
        ("side", [media, side, back], ("metadata", "MetadataMoved", "RollBackMetadata")),
        ("start", [media], ("media", "Planned", "Move")),  # logged, but the disk has it back
    ]
    plan, log, now, want = [], [], [], {}
    for i, (where, rows, answer) in enumerate(cases):
        own = lambda p, i=i: f"{i}/{p}" if p else p
        plan.append((i, own("k"), own("m"), own("m2"), 1, "h", own("s"), own("s2")))
        log += [(10 * i + seq, a, own(s), own(d), h) for seq, a, s, d, h in rows]
        now += [(own(p), n, h) for p, n, h in disk[where]]
        want[i] = answer
    got = actions.quarantine_state(spark.createDataFrame(plan, PLAN), spark.createDataFrame(log, LOG), spark.createDataFrame(now, NOW)).collect()
    assert {x["pair_id"]: (x["logged"], x["state"], x["step"]) for x in got} == want
    empty = actions.quarantine_state(spark.createDataFrame([], PLAN), spark.createDataFrame([], LOG), spark.createDataFrame([], NOW))
    assert empty.count() == 0 and empty.columns == ["pair_id", "logged", "state", "step", "detail"]


def test_emptied_folders(spark):
    paths = lambda x: spark.createDataFrame([(p,) for p in x], "path string")
    deep = "/".join(["R/Trash", *map(str, range(30))])
    chain = [deep.rsplit("/", i)[0] for i in range(32)]
    folders = [*chain, "R/Trash/side", "R/Bin", "R/Bin/Keep", "R/Album", "R/Trash2"]
    files = [f"{deep}/a.jpg", "R/Bin/Keep/b.jpg", "R/Bin/c.jpg", "R/Album/d.jpg", "e.jpg"]
    got = lambda moved: {(x["folder"], x["whole"]) for x in actions.emptied_folders(paths(folders), paths(files), paths(moved), paths(["R/TRASH", "R/Bin", "R/Bin"])).collect()}
    assert got([f"{deep.upper()}/A.jpg", "R/Bin/c.jpg"]) == {(p, True) for p in chain if p.startswith("R/Trash")} | {("R/Trash/side", True)}
    assert got(["R/Bin/Keep/b.jpg"]) == {("R/Trash/side", False), ("R/Bin/Keep", False)}
    wide = spark.range(1_000_000).select(F.concat(F.lit("R/Trash/w/"), F.col("id")).alias("path"))
    tops = paths(["R/Trash"])
    assert actions.emptied_folders(paths(["R/Trash", "R/Trash/w"]), wide, wide, tops).count() == 2
    assert actions.emptied_folders(paths(["R/Trash", "R/Trash/w"]), wide, wide.filter("path <> 'R/Trash/w/77'"), tops).count() == 0
