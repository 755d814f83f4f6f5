"""Scalar functions over columns. All stay in the JVM; patterns are plain Java regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, name lists and sizes whose exact form decides results.
TRASH = r"(?i)(^|[\\/])Google Photos[\\/](Trash|Bin)([\\/]|$)"
SIDECAR_SUFFIX = ".supplemental-metadata.json"
SIDECAR = r"(?i)\.supplemental-metadata(\(\d+\))?\.json$"
MESSENGER_NAME = r"(?i)^(IMG|VID|STK)-(\d{8})-WA\d+"
CAMERA_NAME = r"(?:^|\D)((?:20|19)\d{2})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})(?:\D|$)"
EXIF_DATE = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})"
VIDEO_DATE = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})(?:\.\d+)?([+-]\d{2}:\d{2}|Z)?"
CATEGORIES = ("photo", "screenshot", "meme", "advert", "greeting", "document", "news")
JUNK = ("screenshot", "meme", "advert", "greeting", "news")
SCREEN_WIDTHS = (640, 720, 750, 828, 1080, 1125, 1170, 1179, 1242, 1284, 1290, 1440, 1536, 1620, 1644, 1668)
SCREENS_16_9 = ((640, 1136), (750, 1334), (1242, 2208))
CAMERA_RATIOS = (4 / 3, 3 / 2, 16 / 9)


def content_hash(content: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(content, 256)


def split_name(name: Column) -> tuple[Column, Column]:
    """(stem, extension with its dot); a name that only starts with a dot has no extension."""
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def part_relative(rel: Column) -> Column:
    """Path without its first folder; the path itself if it has none."""
    return F.regexp_replace(rel, r"^[^/\\]*[/\\]", "")


def parent(rel: Column) -> Column:
    """Folder of a path, empty at the top."""
    return F.regexp_replace(F.regexp_extract(rel, r"^(.*)[/\\][^/\\]*$", 1), r"[/\\]+$", "")


def base(rel: Column) -> Column:
    return F.regexp_extract(rel, r"([^/\\]*)$", 1)


def path_depth(rel: Column) -> Column:
    return F.size(F.split(rel, r"[/\\]"))


def is_clean_name(name: Column) -> Column:
    return (
        name.rlike(r"^[A-Za-z0-9][A-Za-z0-9 _.-]*\.[A-Za-z0-9]+$") & ~name.rlike(r"\(\d+\)") & ~name.rlike(r"(?i)(copy|edited|duplicate)")
    )


def in_trash(rel: Column) -> Column:
    return rel.rlike(TRASH)


def sidecar_candidates(name: Column) -> Column:
    """Names that may hold a file's metadata, best first: array of (name, match)."""
    stem, ext = split_name(name)
    entry = lambda n, m: F.struct(n.alias("name"), F.lit(m).alias("match"))
    number = F.regexp_extract(stem, r"^(.+)\((\d+)\)$", 2)
    numbered = F.concat(F.regexp_extract(stem, r"^(.+)\((\d+)\)$", 1), ext, F.lit(".supplemental-metadata("), number, F.lit(").json"))
    edited = F.concat(F.regexp_extract(stem, r"^(.+)-edited$", 1), ext, F.lit(SIDECAR_SUFFIX))
    return F.filter(
        F.array(
            entry(F.concat(name, F.lit(SIDECAR_SUFFIX)), "Exact"),
            F.when(number != "", entry(numbered, "Numbered")),
            F.when(stem.rlike(r"^(.+)-edited$"), entry(edited, "EditedOriginal")),
        ),
        lambda x: x.isNotNull(),
    )


def paths_overlap(a: Column, b: Column) -> Column:
    """One path is the other, or a folder above it; case is ignored."""
    x, y = F.concat(F.lower(a), F.lit("/")), F.concat(F.lower(b), F.lit("/"))
    return x.startswith(y) | y.startswith(x)


def messenger_date(name: Column) -> Column:
    """'IMG-20230505-WA0013.jpg' -> '2023-05-05', else ''."""
    d = F.regexp_extract(name, MESSENGER_NAME, 2)
    return F.when(d == "", "").otherwise(F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def is_messenger(rel: Column, upload_folder: Column) -> Column:
    return (
        base(rel).rlike(MESSENGER_NAME) | F.lower(rel).contains("whatsapp") | F.coalesce(F.lower(upload_folder).startswith("whatsapp"), F.lit(False))
    )


def _timestamp(text: Column, pattern: str) -> Column:
    """Groups 1 to 6 of a pattern as a zone-free timestamp; null where they are none."""
    part = [F.regexp_extract(text, pattern, i) for i in range(1, 7)]
    return F.when(part[0] != "", F.try_to_timestamp(F.concat(*part), F.lit("yyyyMMddHHmmss")))


def camera_name_date(name: Column) -> Column:
    return _timestamp(name, CAMERA_NAME)


def exif_date(text: Column) -> Column:
    return F.when(~text.startswith("0000"), _timestamp(text, EXIF_DATE))


def video_date(text: Column, zone: Column, as_of_year: int) -> Column:
    """Local time of a video date; null for placeholders (before 1971, or over a year ahead)."""
    year = F.regexp_extract(text, VIDEO_DATE, 1)
    offset = F.regexp_extract(text, VIDEO_DATE, 7)
    sane = (year != "") & (year >= "1971") & (year <= str(as_of_year + 1))
    at = _timestamp(text, VIDEO_DATE)
    return F.when(sane, F.when(offset.isin("", "Z"), F.from_utc_timestamp(at, zone)).otherwise(at))


def valid_gps(lat: Column, lon: Column) -> Column:
    """(lat, lon), or null where they are missing, malformed, out of range or 0,0."""
    la, lo = lat.try_cast("double"), lon.try_cast("double")
    fine = (F.abs(la) <= 90) & (F.abs(lo) <= 180) & ~((F.abs(la) < 1e-6) & (F.abs(lo) < 1e-6)) & ~F.isnan(la) & ~F.isnan(lo)
    return F.when(fine, F.struct(la.alias("lat"), lo.alias("lon")))


def offset_text(minutes: Column) -> Column:
    """Minutes east of UTC as +hh:mm."""
    m = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int")))


def local_stamp(epoch: Column, zone: Column) -> Column:
    """Epoch seconds as 'yyyy:MM:dd HH:mm:ss+hh:mm' at a zone."""
    utc = F.timestamp_seconds(epoch)
    local = F.from_utc_timestamp(utc, zone)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(utc)) / 60).cast("int")
    return F.concat(F.date_format(local, "yyyy:MM:dd HH:mm:ss"), offset_text(minutes))


def screen_like(width: Column, height: Column) -> Column:
    """Looks like a full phone screen."""
    short, long_ = F.least(width, height), F.greatest(width, height)
    exact = F.lit(False)
    for w, h in SCREENS_16_9:
        exact = exact | ((short == w) & (long_ == h))
    some = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    return some & (exact | (short.isin(*SCREEN_WIDTHS) & (long_ / F.when(short > 0, short) >= 1.9)))


def camera_shaped(width: Column, height: Column) -> Column:
    """4:3, 3:2 or 16:9 within one per cent."""
    some = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    ratio = F.greatest(width, height) / F.when(F.least(width, height) > 0, F.least(width, height))
    fits = F.lit(False)
    for r in CAMERA_RATIOS:
        fits = fits | (F.abs(ratio - F.lit(r)) <= F.lit(0.01 * r))
    return some & F.coalesce(fits, F.lit(False))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def chunk(bits: Column, i: int, of: int) -> Column:
    """Part i of a 64-bit value cut into `of` parts."""
    low, high = 64 * i // of, 64 * (i + 1) // of
    return F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << (high - low)) - 1 if high - low < 63 else -1))


def pack_by_median(vector: Column, skip: int = 1) -> Column:
    """Bits of v > median, the first the most significant; the median leaves out the first `skip` values."""
    rest = F.sort_array(F.slice(vector, F.lit(skip + 1), F.size(vector)))
    n = F.size(vector) - skip
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    # each array of one element binds its value once; a plain expression would be worked out for every component
    median = F.transform(F.array(rest), lambda r: (F.get(r, low).cast("double") + F.get(r, high).cast("double")) / 2)
    packed = F.transform(
        median,
        lambda m: F.aggregate(vector, F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR((v.cast("double") > m).cast("long"))),
    )
    return packed[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of one length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return total / F.size(a)


def softmax(scores: Column, scale: float = 100.0) -> Column:
    """Softmax of an array of scores, largest subtracted first."""
    raw = F.transform(F.array(scores), lambda a: F.transform(F.array(F.array_max(a)), lambda top: F.transform(a, lambda s: F.exp((s - top) * scale)))[0])
    return F.transform(raw, lambda r: F.transform(F.array(F.aggregate(r, F.lit(0.0), lambda s, v: s + v)), lambda t: F.transform(r, lambda x: x / t))[0])[0]


def renormalise(weights: Column) -> Column:
    """Map of weights summing to 1; unchanged where they sum to 0."""
    total = lambda w: F.array(F.aggregate(F.map_values(w), F.lit(0.0), lambda s, v: s + v))
    divide = lambda w: F.transform(total(w), lambda t: F.transform_values(w, lambda _, v: v / F.when(t == 0, 1.0).otherwise(t)))[0]
    return F.transform(F.array(weights), divide)[0]


def safe_folder(name: Column) -> Column:
    """A folder name that any system takes."""
    clean = F.regexp_replace(name, r"[<>:\"/\\|?*\x00-\x1f]", "-")
    clean = F.regexp_replace(F.regexp_replace(clean, r"^[ .]+", ""), r"[ .]+$", "")
    return F.when(clean == "", "Album").otherwise(clean)


def base_name(name: Column) -> Column:
    """Lower-case name without a trailing '(n)'."""
    stem, ext = split_name(F.lower(name))
    return F.concat(F.regexp_replace(stem, r"\(\d+\)$", ""), ext)


def percent(x: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))


def camera_label(make: Column, model: Column) -> Column:
    """Make and model, without the make twice."""
    make, model = F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    return F.when(F.lower(model).startswith(F.lower(make)), model).otherwise(F.trim(F.concat_ws(" ", make, model)))


def has_wildcard(path: Column) -> Column:
    return path.rlike(r"[\[\]]")


def unsafe_entry(entry: Column) -> Column:
    """An archive entry that would leave its folder."""
    return entry.rlike(r"(^|[/\\])\.\.([/\\]|$)") | entry.rlike(r"^([/\\]|[A-Za-z]:)")


def cache_key(path: Column, size: Column, mtime: Column) -> Column:
    """First 20 hex digits of SHA-1 of 'lower(path)|size|mtime'."""
    return F.substring(F.sha1(F.encode(F.concat_ws("|", F.lower(path), size.cast("string"), mtime.cast("string")), "UTF-8")), 1, 20)


def size_ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def album_of(folder: Column) -> Column:
    """Album of a folder '<part>/Takeout/Google Photos/<album>'; null for any other and for 'Photos from YYYY'."""
    parts = F.split(folder, r"[/\\]")
    inside = (F.size(parts) == 4) & (F.get(parts, F.lit(1)) == "Takeout") & (F.get(parts, F.lit(2)) == "Google Photos")
    name = F.get(parts, F.lit(3))
    return F.when(inside & ~name.rlike(r"^Photos from \d{4}$"), name)


def csv_quote(text: Column) -> Column:
    """A CSV field: quoted, with quotes doubled; null is empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def html_escape(text: Column) -> Column:
    """Text for a page or an attribute."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def file_url(path: Column) -> Column:
    """A file's address, with each part of its path encoded."""
    parts = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit("file:///"), F.regexp_replace(F.array_join(parts, "/"), "^/+", ""))


def bytes_text(size: Column) -> Column:
    """A number of bytes for people: in GB, MB or kB with one decimal, or bytes."""
    shown = lambda unit, name: F.concat(F.bround(size / unit, 1).cast("double").cast("string"), F.lit(f" {name}"))
    return F.when(size >= 10**9, shown(10**9, "GB")).when(size >= 10**6, shown(10**6, "MB")).when(size >= 1000, shown(1000, "kB")).otherwise(F.concat(size.cast("string"), F.lit(" B")))
