"""Metadata plans: which date a file gets, which tags are added, and where it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import scalars as S
from siftwork.session import stored

VIDEO = (".mp4", ".mov", ".m4v", ".3gp")
NOT_WRITABLE = (".avi", ".bmp")
EXIF_TYPES = (".jpg", ".jpeg", ".heic", ".webp", ".png")
XMP_DATE_TYPES = (".png", ".gif")


def choose_date(files: DataFrame, as_of_year: int, force_name: bool = False) -> DataFrame:
    """Add date_source, date_taken (local, zone-free) and fill_video.

    Needs name, zone, exif_date, xmp_date, create_date, creation_date, modify_date (strings as
    stored), taken (epoch seconds) and fallback (ISO text); all but name and zone may be null.
    An existing date wins; a video's placeholder gives way to its creation date, a sidecar date
    no later than a day after the last edit, or that edit; then the sidecar, unless over 36
    hours after the date in the name; then the name; then the fallback.
    """
    _, ext = S.split_name(F.lower("name"))
    zone = F.col("zone")
    files = files.withColumns({
        "__ext": ext,
        "__exif": F.coalesce(S.exif_date(F.col("exif_date")), S.exif_date(F.col("xmp_date"))),
        "__create": S.video_date(F.col("create_date"), zone, as_of_year),
        "__creation": S.video_date(F.col("creation_date"), zone, as_of_year),
        "__modify": S.video_date(F.col("modify_date"), zone, as_of_year),
        "__side": F.from_utc_timestamp(F.timestamp_seconds("taken"), zone),
        "__wa": F.try_to_timestamp(F.concat(F.nullif(S.messenger_date(F.col("name")), F.lit("")), F.lit(" 12:00:00"))),
        "__camera": S.camera_name_date(F.col("name")),
        "__fallback": F.try_to_timestamp("fallback"),
    })
    video = F.col("__ext").isin(*VIDEO, ".avi")
    pick = lambda source, value, fill=False: F.struct(F.lit(source).alias("source"), value.alias("at"), F.lit(fill).alias("fill"))
    name = F.coalesce("__wa", "__camera")
    named = F.when(F.col("__wa").isNotNull(), pick("whatsapp-name", F.col("__wa"))).otherwise(pick("camera-name", F.col("__camera")))
    late = F.unix_timestamp("__side") - F.unix_timestamp(name) > 36 * 3600
    chosen = F.when(F.lit(force_name) & F.col("__wa").isNull() & F.col("__camera").isNotNull(), pick("camera-name (forced)", F.col("__camera")))
    chosen = (
        chosen.when(video & F.col("__create").isNotNull(), pick("existing", F.col("__create")))
        .when(video & F.col("__creation").isNotNull(), pick("existing", F.col("__creation"), True))
        .when(video & (F.col("__side") <= F.col("__modify") + F.expr("INTERVAL 1 DAY")), pick("sidecar", F.col("__side"), True))
        .when(video & F.col("__modify").isNotNull(), pick("existing", F.col("__modify"), True))
        .when(~video & F.col("__exif").isNotNull(), pick("existing", F.col("__exif")))
        .when(F.col("__side").isNotNull() & name.isNotNull() & late, named)
        .when(F.col("__side").isNotNull(), pick("sidecar", F.col("__side")))
        .when(name.isNotNull(), named)
        .when(F.col("__fallback").isNotNull(), pick("fallback (approximate)", F.col("__fallback")))
        .otherwise(pick("none", F.lit(None).cast("timestamp")))
    )
    files = files.withColumn("__c", chosen)
    new = {"date_source": F.col("__c.source"), "date_taken": F.date_format("__c.at", "yyyy:MM:dd HH:mm:ss"), "fill_video": F.col("__c.fill")}
    return files.withColumns(new).drop("__ext", "__exif", "__create", "__creation", "__modify", "__side", "__wa", "__camera", "__fallback", "__c")


def missing_values(wanted: Column, present: Column) -> Column:
    """Values wanted and not yet present, each once, in their order."""
    return F.array_except(F.coalesce(wanted, F.array().cast("array<string>")), F.coalesce(present, F.array().cast("array<string>")))


def plan_tags(ext: Column, source: Column, stamp: Column, offset: Column, has_gps: Column, lat: Column, lon: Column, has_text: Column, text: Column, people: Column) -> Column:
    """Array of (tag, value) to add: dates of a new source, place, description and people a file lacks."""
    tag = lambda on, name, value: F.when(on, F.array(F.struct(F.lit(name).alias("tag"), value.cast("string").alias("value"))))
    none = F.array().cast("array<struct<tag:string,value:string>>")
    writable = ~ext.isin(*NOT_WRITABLE)
    video = ext.isin(*VIDEO)
    dated = writable & ~source.isin("existing", "none")
    place = writable & ~has_gps & lat.isNotNull()
    words = writable & ~has_text & (F.coalesce(text, F.lit("")) != "")
    parts = [
        *[tag(dated & video, t, F.concat(stamp, offset)) for t in ("QuickTime:CreateDate", "QuickTime:TrackCreateDate", "QuickTime:MediaCreateDate", "Keys:CreationDate")],
        tag(dated & ext.isin(*EXIF_TYPES), "EXIF:DateTimeOriginal", stamp),
        tag(dated & ext.isin(*EXIF_TYPES), "EXIF:OffsetTimeOriginal", offset),
        tag(dated & ext.isin(*XMP_DATE_TYPES), "XMP-exif:DateTimeOriginal", F.concat(stamp, offset)),
        tag(place & video, "Keys:GPSCoordinates", F.concat_ws(", ", F.format_string("%.6f", lat), F.format_string("%.6f", lon))),
        tag(place & ext.isin(*EXIF_TYPES), "EXIF:GPSLatitude*", F.format_string("%.6f", lat)),
        tag(place & ext.isin(*EXIF_TYPES), "EXIF:GPSLongitude*", F.format_string("%.6f", lon)),
        tag(words, "XMP-dc:Description", text),
        tag(words & ext.isin(".jpg", ".jpeg", ".heic"), "EXIF:ImageDescription", text),
        F.when(writable & (ext != ".gif"), F.transform(people, lambda p: F.struct(F.lit("XMP-iptcExt:PersonInImage+").alias("tag"), p.alias("value")))),
    ]
    return F.flatten(F.array(*[F.coalesce(p, none) for p in parts]))


def tags_text(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(t["tag"], F.lit("="), t["value"])), " | ")


def collision_free(plan: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Add dest: dir/name, or 'name (2).ext' and so on where that is planned before or exists; case is ignored.

    Order is lower(dir), lower(name), lower(source), source. The rows of a name get its own place, if that is free, and then the
    free numbers from 2 on. A number of a name is taken where a file of that name exists or is planned before the name; the j-th
    free one is j + 1 + the number of taken ones with fewer than j free before them. Rows and taken numbers are counted over
    range partitions, so a name of a million rows is spread over many tasks.

    Null folders and names count as empty. Whether a name's own place is free may depend on another name's numbers: that is so without an extension alone
    ('a' comes before 'a (2)', but 'a (2).jpg' before 'a.jpg'). Such names are settled level by level, a level
    for each number at the end of a name.
    """
    key = ["ldir", "lname"]
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    rows = plan.select("source", "dir", "name", low("dir").alias("ldir"), low("name").alias("lname"))
    names = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).withColumn("there", F.lit(False))
    if existing is not None:
        old = existing.select(low("dir").alias("ldir"), low("name").alias("lname")).distinct()
        names = names.unionByName(old.select(*key, F.lit(0).cast("long").alias("m"), F.lit(True).alias("there")))
        names = names.groupBy(*key).agg(F.max("m").alias("m"), F.max("there").alias("there"))
    stem, ext = S.split_name(F.col("lname"))
    number = F.regexp_extract(stem, r"^.* \(([1-9]\d{0,17})\)$", 1)
    number = F.when(number != "", number.cast("long"))
    parent = F.concat(F.regexp_replace(stem, r" \(\d+\)$", ""), ext)
    names = stored(names.withColumns({"n": F.when(number > 1, number), "parent": F.when(number > 1, parent)}))
    child = names.filter("n IS NOT NULL").select("ldir", F.col("parent").alias("lname"), "n", F.col("lname").alias("child"), "there")
    taken = child.filter(F.col("there") | (F.col("child") < F.col("lname")))
    taken = stored(running(taken.select(*key, "n"), key, ["n"], F.lit(1)).select(*key, "n", (F.col("n") - 1 - F.col("total")).alias("free")))  # free: numbers below n that are free
    # a name's own place: taken by a file, or by a number of a name without extension before it
    asked = child.filter(~F.col("there") & (F.col("child") > F.col("lname")))
    both = asked.select(*key, "n", "child", F.lit(0).alias("one")).unionByName(taken.select(*key, "n", F.lit(None).cast("string").alias("child"), F.lit(1).alias("one")))
    asked = running(both, key, ["n", "one"], F.col("one")).filter("one = 0").select("ldir", F.col("child").alias("lname"), F.col("lname").alias("parent"), (F.col("n") - 1 - F.col("total")).alias("place"))
    planned = names.filter("m > 0").select(*key, "m", "there").join(asked, key, "left")
    above = names.filter("m > 0").select("ldir", F.col("lname").alias("parent"), F.lit(True).alias("waits"))
    left = stored(planned.join(above, ["ldir", "parent"], "left"))
    settled = [left.filter("waits IS NULL").select(*key, "m", (~F.col("there")).alias("own"))]
    left = left.filter("waits")
    while not left.isEmpty():
        got = settled[-1].select("ldir", F.col("lname").alias("parent"), (F.col("m") - F.col("own").cast("long")).alias("made"))
        level = stored(left.join(got, ["ldir", "parent"]).select(*key, "m", (~F.col("there") & (F.col("place") > F.col("made"))).alias("own")))
        left = stored(left.join(level.select(*key), key, "left_anti"))
        settled.append(level)
    own = settled[0]
    for level in settled[1:]:
        own = own.unionByName(level)
    placed = running(rows.withColumn("lsource", low("source")), key, ["lsource", "source"], F.lit(1)).join(own.select(*key, "own"), key)
    placed = placed.withColumn("j", F.col("total") - F.col("own").cast("long"))
    both = placed.select(*key, "source", "dir", "name", "j", F.lit(0).alias("one")).unionByName(
        taken.select(*key, F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("dir"), F.lit(None).cast("string").alias("name"), F.col("free").alias("j"), F.lit(1).alias("one"))
    )
    done = running(both, key, ["j", "one"], F.col("one")).filter("one = 0")
    plain_stem, plain_ext = S.split_name(F.col("name"))
    dest = F.when(F.col("j") == 0, F.col("name")).otherwise(F.concat(plain_stem, F.lit(" ("), (F.col("j") + 1 + F.col("total")).cast("string"), F.lit(")"), plain_ext))
    return done.select("source", "dir", "name", dest.alias("dest")).withColumn("renamed", F.col("name") != F.col("dest"))


def running(rows: DataFrame, key: list[str], order: list[str], amount: Column) -> DataFrame:
    """rows with total: the sum of amount over the rows of their key up to and with theirs, in the given order.

    A key may be of any size: rows are sorted into ranges over all keys, summed in each, and what a key has in the ranges
    before, a row for each key and range, is added. Rows equal in key and order are taken in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.xxhash64(F.monotonically_increasing_id())  # so that equal rows may lie in several ranges
    dealt = rows.withColumns({"__amount": amount.cast("long"), "__salt": salt}).repartitionByRange(parts, *key, *order, "__salt")
    dealt = stored(dealt.withColumn("__range", F.spark_partition_id()))
    inside = F.sum("__amount").over(Window.partitionBy("__range", *key).orderBy(*order, "__salt").rowsBetween(Window.unboundedPreceding, 0))
    sums = dealt.groupBy("__range", *key).agg(F.sum("__amount").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select("__range", *key, F.coalesce(before, F.lit(0)).alias("__before"))
    out = dealt.withColumn("__inside", inside).join(before, ["__range", *key])
    return out.select(*rows.columns, (F.col("__inside") + F.col("__before")).alias("total"))


def restore_plan(manifest: DataFrame) -> DataFrame:
    """Moves to undo, the last first. seq orders the manifest."""
    done = manifest.filter(F.col("action").isin("MovedMedia", "MovedMetadata"))
    return done.select("seq", F.col("destination").alias("from_path"), F.col("source").alias("to_path"), "size")


def check_expected(plan: DataFrame, expected: int) -> DataFrame:
    """The plan, if it has as many rows as expected; else an error."""
    n = plan.count()
    if n != expected:
        raise ValueError(f"the plan has {n} rows, {expected} were expected")
    return plan


def pair_rejects(pairs: DataFrame, decision: str = "decision") -> DataFrame:
    """A row to reject for the side of a pair that isn't kept; none where both are. Needs a, b, a_size, b_size."""
    drop = lambda side, other, when: F.when(F.col(decision) == when, F.struct(F.col(side).alias("path"), F.col(f"{side}_size").alias("size"), F.col(other).alias("copy_of")))
    gone = F.coalesce(drop("b", "a", "A"), drop("a", "b", "B"))
    return pairs.select(gone.alias("r")).filter("r IS NOT NULL").select("r.*")


def albums_only(files: DataFrame, library: str = "Library") -> DataFrame:
    """Files of an album that aren't in its folder yet. Needs dir and album."""
    there = F.concat_ws("/", F.lit(library), F.lit("Albums"), S.safe_folder(F.col("album")))
    return files.filter((F.coalesce("album", F.lit("")) != "") & (F.lower("dir") != F.lower(there)))


def deletion_plan(actions: DataFrame, typed: str) -> DataFrame:
    """What a permanent deletion of quarantined files would remove: only after 'DELETE <number of files>' was typed."""
    plan = actions.filter(F.col("action").isin("MovedMedia", "MovedMetadata")).select(F.col("destination").alias("path"), "size")
    n = plan.count()
    if typed != f"DELETE {n}":
        raise ValueError(f"type 'DELETE {n}' to delete {n} files")
    return plan


def metadata_copy_plan(pairs: DataFrame) -> DataFrame:
    """Copies of metadata from one file to another, each with the backup that is written first.

    pairs: source, target, source_tags, target_tags (maps). Only tags that the target lacks are copied; nothing is planned where it has all.
    """
    absent = F.map_filter("source_tags", lambda k, v: ~F.map_contains_key("target_tags", k))
    plan = pairs.select("source", "target", F.concat("target", F.lit("_original")).alias("backup"), absent.alias("tags"))
    return plan.filter(F.size("tags") > 0)


#: Width of a cell, in degrees, by which places meet zones.
CELL = 1.0


def zone_of(places: DataFrame, zones: DataFrame, default: str) -> DataFrame:
    """places (lat, lon and others) with `zone`: that of the smallest box around them, else the default.

    zones: zone, south, north, west, east, in degrees. An equi-join on cells of a degree: a box is a row in each cell
    that it touches, a place one row, and no place is compared with boxes elsewhere.
    """
    grid = lambda low, high: F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL))
    boxes = zones.withColumn("__area", (F.col("north") - F.col("south")) * (F.col("east") - F.col("west")))
    boxes = boxes.withColumn("__y", F.explode(grid("south", "north"))).withColumn("__x", F.explode(grid("west", "east")))
    keyed = places.withColumns({"__y": F.floor(F.col("lat") / CELL), "__x": F.floor(F.col("lon") / CELL)})
    spots = keyed.select("lat", "lon", "__y", "__x").distinct()
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    near = spots.join(boxes, ["__y", "__x"]).filter(inside).groupBy("lat", "lon").agg(F.min(F.struct("__area", "zone")).alias("__best"))
    return places.join(near, ["lat", "lon"], "left").select(*places.columns, F.coalesce("__best.zone", F.lit(default)).alias("zone"))
