"""Logged moves of files: what they came to, what comes next, how they are undone, and which folders they empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import scalars as S
from siftwork.session import stored

#: Actions of a manifest that moved a file.
MOVES = ("MovedMedia", "MovedMetadata")


def chain_ends(links: DataFrame) -> DataFrame:
    """(node, last, hops, looped) of links (node, next), by pointer doubling: a chain of n links takes about log2(n) rounds.

    A node has one next at most and is the next of one at most, so no join key is hot. Nodes of a loop have looped and no last.
    """
    state = stored(links.select("node", F.col("next").alias("at"), F.lit(1).cast("long").alias("hops")))
    left, done, rounds = state, [], state.count().bit_length() + 1
    while rounds and not left.isEmpty():
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("then"), F.col("hops").alias("more"))
        met = stored(left.join(ahead, "at", "left"))
        done.append(met.filter("then IS NULL").select("node", "at", "hops"))
        left = met.filter("then IS NOT NULL").select("node", F.col("then").alias("at"), (F.col("hops") + F.col("more")).alias("hops"))
        state, rounds = left, rounds - 1
        for d in done:
            state = state.unionByName(d)
    out = left.select("node", F.lit(None).cast(left.schema["at"].dataType).alias("last"), F.lit(None).cast("long").alias("hops"), F.lit(True).alias("looped"))
    for d in done:
        out = out.unionByName(d.select("node", F.col("at").alias("last"), "hops", F.lit(False).alias("looped")))
    return out


def moved_files(manifest: DataFrame) -> DataFrame:
    """(first_seq, last_seq, origin, place, size, moves): a row for each file that a manifest moved, over all its moves.

    manifest: seq (unique), action, source, destination, size. A path holds one file at a time, so what leaves a path is
    what came there last, also where many files have been at one path. A move to the same place is none.
    """
    moves = manifest.filter(F.col("action").isin(*MOVES) & (F.col("source") != F.col("destination"))).select("seq", "source", "destination", "size")
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("path"), F.lit(c == "source").alias("leaves")) for c in ("source", "destination")]))
    seen = moves.select("seq", ends.alias("e")).select("seq", "e.*")
    w = Window.partitionBy("path").orderBy("seq")
    before = seen.withColumns({"came": F.lag("seq").over(w), "left": F.lag("leaves").over(w)})
    links = stored(before.filter("leaves AND came IS NOT NULL AND NOT left").select(F.col("came").alias("node"), F.col("seq").alias("next")))
    heads = moves.join(links.select(F.col("next").alias("seq")), "seq", "left_anti")
    ends = chain_ends(links)
    files = heads.join(ends.withColumnRenamed("node", "seq"), "seq", "left")
    files = files.select(
        F.col("seq").alias("first_seq"), F.coalesce("last", "seq").alias("last_seq"), F.col("source").alias("origin"), (F.coalesce("hops", F.lit(0)) + 1).alias("moves"), "size"
    )
    return files.join(moves.select(F.col("seq").alias("last_seq"), F.col("destination").alias("place")), "last_seq")


def restore(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """A row for each moved file: first_seq, last_seq, origin, place, size, moves and status. now: the paths there are.

    RESTORE: it goes back from place to origin. HOME: it is there already. SKIP not found: it isn't where it was moved
    last. SKIP occupied: another file is at its origin and stays there; nothing is overwritten. A file at another's origin that
    is itself restored makes way, and files that have changed places all go back. Of files of one origin, the one
    that left last gets it. Undo goes by last_seq, greatest first.
    """
    there = now.select(F.col("path")).distinct()
    files = moved_files(manifest)
    latest = F.max("last_seq").over(Window.partitionBy("place")) == F.col("last_seq")
    files = files.withColumn("latest", latest).join(there.withColumn("__at", F.lit(True)).withColumnRenamed("path", "place"), "place", "left")
    files = files.join(there.withColumn("taken", F.lit(True)).withColumnRenamed("path", "origin"), "origin", "left")
    found, home = F.col("latest") & F.col("__at").isNotNull(), F.col("origin") == F.col("place")
    kind = F.when(~found, "SKIP not found").when(home, "HOME").otherwise("RESTORE")
    files = files.withColumn("kind", kind)
    first = F.max(F.when(F.col("kind") == "RESTORE", F.col("first_seq"))).over(Window.partitionBy("origin")) == F.col("first_seq")
    files = stored(files.withColumn("wins", (F.col("kind") == "RESTORE") & F.coalesce(first, F.lit(False))).drop("latest", "__at"))
    holder = files.filter("kind <> 'SKIP not found'").select(F.col("place").alias("origin"), F.col("first_seq").alias("next"), F.col("wins").alias("goes"))
    wanting = files.filter("wins AND taken").select("first_seq", "origin").join(holder, "origin", "left")
    wanting = stored(wanting.select(F.col("first_seq").alias("node"), "next", F.coalesce("goes", F.lit(False)).alias("goes")))
    ends = chain_ends(wanting.filter("goes").select("node", "next"))
    stuck = wanting.filter("NOT goes").select("node")
    behind = ends.join(stuck.withColumnRenamed("node", "last"), "last", "left_semi").select("node")
    blocked = stuck.union(behind).select(F.col("node").alias("first_seq"), F.lit(True).alias("blocked"))
    status = F.when((F.col("kind") == "RESTORE") & (~F.col("wins") | F.col("blocked").isNotNull()), "SKIP occupied").otherwise(F.col("kind"))
    return files.join(blocked, "first_seq", "left").select("first_seq", "last_seq", "origin", "place", "size", "moves", status.alias("status"))


def quarantine_state(plan: DataFrame, manifest: DataFrame, now: DataFrame) -> DataFrame:
    """State and next step of each planned pair of a media file and its sidecar, from the log and what is on disk.

    plan: pair_id, keeper, media, media_to, size, hash (of media and keeper), side and side_to (null without a sidecar).
    manifest: seq, action, source, destination, hash; it may end in the middle of a pair, or lack a move that was made.
    now: path, size, hash. Returns pair_id, logged (the log's last word on where media and sidecar are: none, media,
    metadata, both), state (Planned, MediaMoved, MetadataMoved, Moved, Lost, Doubled), step and detail.

    step: Move; RollBackMedia or RollBackMetadata, where only one of a pair has moved; AlreadyInQuarantine; Done;
    ReviewRequired, where a check before or after fails. A pair is never left apart and nothing is overwritten.
    """
    roles = ("keeper", "media", "media_to", "side", "side_to")
    sides = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("path")) for r in roles]))
    wanted = plan.select("pair_id", sides.alias("x")).select("pair_id", "x.*").filter("path IS NOT NULL")
    seen = wanted.join(now.select("path", F.struct("size", "hash").alias("f")), "path")
    seen = seen.groupBy("pair_id").agg(*[F.max(F.when(F.col("role") == r, F.col("f"))).alias(f"at_{r}") for r in roles])
    # the log, replayed: the last move into or out of a pair's own places says where media and sidecar are
    ways = F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("destination"), F.lit(what).alias("what"), F.lit(out).alias("gone"))
                     for a, b, what, out in (("media", "media_to", "media", True), ("media_to", "media", "media", False), ("side", "side_to", "side", True), ("side_to", "side", "side", False))])
    ways = plan.select("pair_id", F.explode(ways).alias("w")).select("pair_id", "w.*").filter("source IS NOT NULL AND destination IS NOT NULL")
    log = manifest.filter(F.col("source") != "").select("seq", "source", "destination", F.col("hash").alias("log_hash"))
    log = ways.join(log, ["source", "destination"]).groupBy("pair_id").agg(
        *[F.coalesce(F.max_by("gone", F.when(F.col("what") == w, F.col("seq"))), F.lit(False)).alias(f"log_{w}") for w in ("media", "side")],
        F.max_by("log_hash", F.when((F.col("what") == "side") & F.col("gone"), F.col("seq"))).alias("side_hash"),
    )
    p = plan.join(seen, "pair_id", "left").join(log, "pair_id", "left")
    p = p.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("log_media", "log_side")})
    own = F.struct("size", "hash")
    has, same = lambda r: F.col(f"at_{r}").isNotNull(), lambda r: F.coalesce(F.col(f"at_{r}") == own, F.lit(False))
    paired, side_here, side_there = F.col("side").isNotNull(), has("side"), has("side_to")
    media_gone, side_gone = has("media_to") & ~has("media"), side_there & ~side_here
    state = (
        F.when(~has("media") & ~has("media_to"), "Lost")
        .when(F.col("log_media") & has("media") & has("media_to"), "Doubled")
        .when(media_gone & paired & ~side_gone, "MediaMoved")
        .when(media_gone, "Moved")
        .when(paired & side_gone & F.col("log_side"), "MetadataMoved")
        .otherwise("Planned")
    )
    logged = F.when(F.col("log_media") & F.col("log_side"), "both").when(F.col("log_media"), "media").when(F.col("log_side"), "metadata").otherwise("none")
    answer = lambda s, d="": F.struct(F.lit(s).alias("step"), F.lit(d).alias("detail"))
    review = lambda d: answer("ReviewRequired", d)
    odd_path = F.lit(False)
    for r in ("media", "media_to", "side", "side_to"):
        odd_path = odd_path | F.coalesce(S.has_wildcard(F.col(r)), F.lit(False))
    side_changed = F.coalesce(F.col("at_side_to.hash") != F.col("side_hash"), F.lit(False))
    side_equal = F.coalesce(F.col("at_side") == F.col("at_side_to"), F.lit(False))
    step = (
        F.when(F.col("state") == "Lost", review("Media is neither at its source nor in quarantine"))
        .when(F.col("state") == "Doubled", review("Media was moved but is at its source too"))
        .when(F.col("state").isin("Moved", "MediaMoved") & ~same("media_to"), review("Post-move media verification failed"))
        .when((F.col("state") == "Moved") & side_changed, review("Post-move metadata verification failed"))
        .when(F.col("state") == "Moved", answer("Done"))
        .when((F.col("state") == "MediaMoved") & side_here & side_there, review("Metadata is at its source and in quarantine"))
        .when((F.col("state") == "MediaMoved") & ~side_here, review("Metadata is neither at its source nor in quarantine"))
        .when(F.col("state") == "MediaMoved", answer("RollBackMedia", "Media moved, metadata did not"))
        .when((F.col("state") == "MetadataMoved") & side_changed, review("Post-move metadata verification failed"))
        .when(F.col("state") == "MetadataMoved", answer("RollBackMetadata", "Metadata moved, media did not"))
        .when(~same("keeper"), review("Keeper failed integrity check (exists/size/SHA-256)"))
        .when(~same("media"), review("Failed pre-action revalidation (exists/size/SHA-256)"))
        .when(same("media_to") & (~paired | ~side_here | side_equal), answer("AlreadyInQuarantine", "Identical media and metadata already exist at destination; source left untouched"))
        .when(same("media_to"), review("Destination contains identical media but companion metadata is missing or differs"))
        .when(has("media_to"), review("Destination collision with differing media content"))
        .when(paired & side_here & side_there, review("Companion metadata destination already exists; media and metadata pair left untouched"))
        .when(odd_path, review("Source or destination path contains [ or ] (wildcard metacharacters for Move-Item -Destination); skipped for safety"))
        .otherwise(answer("Move"))
    )
    return p.withColumn("state", state).select("pair_id", logged.alias("logged"), "state", step.alias("s")).select("pair_id", "logged", "state", "s.*")


def folders_above(path: Column) -> Column:
    """All folders above a path, the nearest one last; none for a bare name."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.slice(above, 1, F.size(parts) - 1)


def emptied_folders(folders: DataFrame, files: DataFrame, moved: DataFrame, trash: DataFrame) -> DataFrame:
    """(folder, trash, whole): folders inside a trash folder that hold no file, at any depth, once the moved files are gone.

    folders, files and moved: path; trash: path of the trash folders of the plan. whole: the trash folder itself is
    empty, so that it goes as one. Case is ignored. Files are folded to their folders first, so a folder of a million
    files moves as a row a task; each folder that stays then gives a row for each folder above it.
    """
    low = lambda df: df.select(F.lower("path").alias("low"))
    stay = files.select(F.col("path"), F.lower("path").alias("low")).join(low(moved).distinct(), "low", "left_anti")
    holding = stay.select(F.regexp_extract("low", r"^(.*)/[^/]*$", 1).alias("low")).filter("low <> ''").distinct()
    full = holding.select(F.explode(F.array_append(folders_above(F.col("low")), F.col("low"))).alias("low")).distinct()
    tops = low(trash).distinct().withColumnRenamed("low", "trash")
    inside = folders.select("path", F.lower("path").alias("low")).select("path", "low", F.explode(F.array_append(folders_above(F.col("low")), F.col("low"))).alias("trash")).join(tops, "trash")
    empty = inside.join(full, "low", "left_anti")
    whole = tops.join(full.withColumnRenamed("low", "trash"), "trash", "left_anti").withColumn("whole", F.lit(True))
    return empty.join(whole, "trash", "left").select(F.col("path").alias("folder"), "trash", F.coalesce("whole", F.lit(False)).alias("whole"))
