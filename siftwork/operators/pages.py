"""The reviewer's page: its rows, its filters, its order, and pages of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import scalars as S
from siftwork.operators import decisions as D
from siftwork.operators import similar
from siftwork.operators.planner import running

#: Rows of a page.
PAGE = 240
#: Categories of copies, which are ordered by distance and which no confidence hides.
COPIES = ("whatsapp_copy",)
#: Columns of a triage row, in order.
TRIAGE = (
    "id path rel name category content confidence suggestion note reasons top3 width height bytes format camera gps people upload_folder whatsapp date flatness phash "
    "copy_of copy_distance copy_id copy_width copy_height"
).split()


def triage_rows(images: DataFrame, matches: DataFrame) -> DataFrame:
    """The 28 columns of a triage row (TRIAGE) for each image.

    images: id, path, rel, name, category, confidence, suggestion, note, reasons and top3 (texts), width, height, bytes, format, camera,
    gps, side_gps, people, upload_folder, taken (an EXIF time), flatness, phash. matches: copy, original (ids), distance, for messenger
    copies of images there are; such a row becomes a whatsapp_copy, with a suggestion of its own.
    """
    base = images.select(*[F.col(c) for c in images.columns if c not in ("gps", "side_gps", "taken")], (F.coalesce("gps", F.lit(False)) | F.coalesce("side_gps", F.lit(False))).alias("gps"), F.coalesce("taken", F.lit("")).alias("taken"))
    base = base.withColumns({
        "content": F.col("category"), "confidence": F.bround("confidence", 3), "whatsapp": S.is_messenger(F.col("rel"), F.col("upload_folder")),
        "date": F.coalesce(F.nullif(S.messenger_date(F.col("name")), F.lit("")), F.regexp_replace(F.substring("taken", 1, 10), ":", "-")),
    })
    original = images.select(F.col("id").alias("copy_id"), F.col("path").alias("copy_of"), F.col("width").alias("copy_width"), F.col("height").alias("copy_height"))
    pairs = matches.select(F.col("copy").alias("id"), F.col("original").alias("copy_id"), F.col("distance").alias("copy_distance")).join(original, "copy_id")
    rows = base.join(pairs, "id", "left")
    is_copy = F.col("copy_id").isNotNull()
    area, copy_area = F.col("copy_width") * F.col("copy_height"), F.col("width") * F.col("height")
    note = F.when(D.messenger_copy(F.col("copy_distance"), area, copy_area) == "reject", "you have this photo in better quality").otherwise(
        F.concat(F.lit("similar to a photo you have"), F.when(area >= 0.9 * copy_area, "").otherwise(" (but this copy is larger)"))
    )
    return rows.withColumns({
        "category": F.when(is_copy, COPIES[0]).otherwise(F.col("category")),
        "suggestion": F.when(is_copy, D.messenger_copy(F.col("copy_distance"), area, copy_area)).otherwise(F.col("suggestion")),
        "note": F.when(is_copy, note).otherwise(F.col("note")),
    }).select(*TRIAGE)


#: Columns of a video's row on the page, and what of a video they hold.
VIDEO = {
    "id": "id", "p": "path", "r": "rel", "c": "category", "ct": "category", "cf": "confidence", "s": "suggestion", "nt": "note", "why": "why", "t3": "top3", "w": "width", "h": "height",
    "b": "bytes", "cam": "", "gps": False, "ppl": 0, "wa": True, "d": "date", "o": "copy_of", "oid": "copy_id", "od": "", "ow": "copy_width", "oh": "copy_height",
}


def video_rows(videos: DataFrame, copies: DataFrame) -> DataFrame:
    """The page's columns (VIDEO) for each video.

    videos: id, path, rel, name, category, confidence, suggestion, note, why (an array of reasons), top3, width, height, bytes. copies: id, copy_of
    (ids, as of video_copies) and in_library, whether the copy is in the library. A rejection that only a model suggests is a review of a possible category, as on compressed frames it is
    often wrong; a copy is a video_copy, and rejected.
    """
    other = videos.select(F.col("id").alias("copy_id"), F.col("path").alias("copy_of"), F.col("width").alias("copy_width"), F.col("height").alias("copy_height"))
    rows = videos.join(copies.select("id", F.col("copy_of").alias("copy_id"), "in_library").join(other, "copy_id"), "id", "left")
    is_copy, model = F.col("copy_id").isNotNull(), F.col("suggestion") == "reject"
    rows = rows.withColumns({
        "note": F.when(is_copy & F.col("in_library"), "already in your library").when(is_copy, "a larger copy of this video is kept").when(model, F.concat(F.lit("possible "), "category", F.lit(" - check"))).otherwise(F.col("note")),
        "suggestion": F.when(is_copy, "reject").when(model, "review").otherwise(F.col("suggestion")), "category": F.when(is_copy, "video_copy").otherwise(F.col("category")),
        "confidence": F.when(is_copy, 1.0).otherwise(F.bround("confidence", 3)), "why": F.array_join("why", " · "), "date": S.messenger_date(F.col("name")),
    })
    held = {k: F.col(c) if isinstance(c, str) and c else F.lit(c) for k, c in VIDEO.items()}
    return rows.select(*[(F.coalesce(v, F.lit("")) if k in ("o", "oid") else v).alias(k) for k, v in held.items()])


def similar_rows(pairs: DataFrame) -> DataFrame:
    """Rows of the page of similar pictures: a, b, ka, kb, rotation in degrees, pixel_diff, worst_patch, kind, sizes, dims and suggest.

    pairs: a and b (paths), ka, kb, rotation (quarter turns), diff, worst, a_size, b_size, a_dims and b_dims (arrays of width and height).
    """
    pixels = lambda d: F.get(d, F.lit(0)) * F.get(d, F.lit(1))
    album = lambda p: F.contains(F.translate(p, "\\", "/"), F.lit("/Albums/"))
    rows = pairs.withColumn("kind", similar.pair_kind(F.col("worst"), F.col("a_dims"), F.col("b_dims"), F.col("rotation")))
    keep = similar.pair_keep(F.col("kind"), pixels("a_dims"), pixels("b_dims"), F.col("a_size"), F.col("b_size"), album("a"), album("b"))
    return rows.select(
        "a", "b", "ka", "kb", (F.col("rotation") * 90).alias("rotation"), F.bround("diff", 2).alias("pixel_diff"), F.bround("worst", 2).alias("worst_patch"), "kind",
        "a_size", "b_size", "a_dims", "b_dims", keep.alias("suggest"),
    )


def similar_shown(rows: DataFrame, show: str = "copy") -> DataFrame:
    """Rows of the similar page under one of its four filters: copy, shot, rot (turned) or all."""
    keep = {"copy": F.col("kind") == "copy", "shot": F.col("kind") == "shot", "rot": F.col("rotation") != 0, "all": F.lit(True)}
    return rows.filter(keep[show])


def decision(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """rows (id, suggestion) with decision: the reviewer's choice (id, choice; one a row), else reject where that is suggested, else keep."""
    own = F.coalesce("choice", F.when(F.col("suggestion") == "reject", "reject").otherwise("keep"))
    return rows.drop("choice").join(choices.select("id", "choice"), "id", "left").withColumn("decision", own).drop("choice")


def shown(rows: DataFrame, category: str, show: str = "all", search: str = "", least: float = 0.0) -> DataFrame:
    """Rows of one category: all, those under review, or those of a decision; with a text in rel (case is ignored), from a confidence on.

    Copies are shown whatever their confidence. Needs id, rel, category, suggestion, decision and confidence.
    """
    out = rows.filter(F.col("category") == category)
    if show != "all":
        out = out.filter((F.col("suggestion") if show == "review" else F.col("decision")) == show)
    if search.strip():
        out = out.filter(F.contains(F.lower("rel"), F.lit(search.strip().lower())))
    return out if category in COPIES else out.filter(F.col("confidence") >= least)


def page_numbers(rows: DataFrame, size: int = PAGE) -> DataFrame:
    """rows with place (from 1 in each category) and page (from 0), in the page's order, for all categories at once.

    Copies go by copy_distance, then bytes, greatest first; others by confidence, greatest first; then by lower(rel), rel and id.
    Places are counted over range partitions: no category is ordered by one task.
    """
    copy = F.col("category").isin(*COPIES)
    keys = {"__first": F.when(copy, F.col("copy_distance").cast("double")).otherwise(-F.col("confidence").cast("double")), "__second": F.when(copy, -F.col("bytes")).otherwise(0), "__third": F.lower("rel")}
    placed = running(rows.withColumns(keys), ["category"], [*keys, "rel", "id"], F.lit(1)).drop(*keys)
    return placed.withColumnRenamed("total", "place").withColumn("page", F.floor((F.col("place") - 1) / size))


def page_bounds(placed: DataFrame) -> DataFrame:
    """(category, page, rows, first, last): what a page starts and ends with, as ids; a row a page."""
    return placed.groupBy("category", "page").agg(F.count(F.lit(1)).alias("rows"), F.min_by("id", "place").alias("first"), F.max_by("id", "place").alias("last"))


def read_page(placed: DataFrame, category: str, page: int, size: int = PAGE) -> DataFrame:
    """One page, in order: a range of places, so that a table stored by place is read there alone."""
    at = F.col("place")
    return placed.filter((F.col("category") == category) & (at > page * size) & (at <= (page + 1) * size)).orderBy("place")


def decision_export(rows: DataFrame) -> DataFrame:
    """The decisions as the page exports them, by the export's column names."""
    names = {"Path": "path", "Decision": "decision", "Category": "category", "Confidence": "confidence", "Suggestion": "suggestion", "SizeBytes": "bytes", "CopyOf": "copy_of"}
    return rows.select(*[(F.coalesce(c, F.lit("")) if c == "copy_of" else F.col(c)).alias(n) for n, c in names.items()])


def similar_export(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """Rows to reject of the similar page, in the same columns: the side that a choice (a, b, choice: A, B or both), else the suggestion, drops."""
    chosen = rows.join(choices.select("a", "b", "choice"), ["a", "b"], "left").withColumn("k", F.coalesce("choice", "suggest"))
    what = F.when(F.col("rotation") != 0, "rotated copy").otherwise("same-picture copy")
    side = lambda k, out, other: F.when(F.col("k") == k, F.struct(
        F.col(out).alias("Path"), F.lit("reject").alias("Decision"), what.alias("Category"), F.col("pixel_diff").alias("Confidence"),
        F.when(F.col("suggest") == k, "reject").otherwise("keep").alias("Suggestion"), F.col(f"{out}_size").alias("SizeBytes"), F.col(other).alias("CopyOf"),
    ))
    return chosen.select(F.coalesce(side("A", "b", "a"), side("B", "a", "b")).alias("r")).filter("r IS NOT NULL").select("r.*")
