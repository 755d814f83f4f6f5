"""Ordered decision tables. The order of the rules is their meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions import scalars as S


def adjust_probabilities(p: Column, width: Column, height: Column, camera: Column, kind: Column) -> Column:
    """Map of class probabilities nudged by what the file says, summing to 1."""
    bare = F.coalesce(camera, F.lit("")) == ""
    shot = F.when(S.screen_like(width, height) & bare, 2.0).otherwise(1.0) * F.when((kind == "PNG") & bare, 1.3).otherwise(1.0)
    photo = F.when(~bare, 1.5).otherwise(1.0)
    return S.renormalise(F.transform_values(p, lambda k, v: v * F.when(k == "screenshot", shot).when(k == "photo", photo).otherwise(1.0)))


def top_classes(p: Column, n: int = 3) -> Column:
    """The n likeliest (class, probability), ties in the order of classes given by the map."""
    entries = F.transform(F.map_entries(p), lambda e, i: F.struct((-e["value"]).alias("k"), i.alias("i"), e["key"].alias("name"), e["value"].alias("p")))
    return F.slice(F.array_sort(entries), F.lit(1), F.lit(n))


def heuristic_category(width: Column, height: Column, camera: Column) -> Column:
    """(category, confidence) without a model."""
    shot = S.screen_like(width, height) & (F.coalesce(camera, F.lit("")) == "")
    return F.struct(F.when(shot, "screenshot").otherwise("unknown").alias("category"), F.when(shot, 0.7).otherwise(0.0).alias("confidence"))


def protection_reasons(people: Column, camera: Column, gps: Column) -> Column:
    return F.filter(
        F.array(
            F.when(people > 0, F.concat(people.cast("string"), F.lit(" tagged people"))),
            F.when(camera != "", F.concat(F.lit("camera data ("), camera, F.lit(")"))),
            F.when(gps, "GPS location"),
        ),
        lambda x: x.isNotNull(),
    )


def decide(category: Column, confidence: Column, protected: Column, photo: Column, camera_shape: Column, threshold: float = 0.75, most_photo: float = 0.15) -> Column:
    """(suggestion, note). The notes are fixed values."""
    answer = lambda s, n: F.struct(F.lit(s).alias("suggestion"), (n if isinstance(n, Column) else F.lit(n)).alias("note"))
    junk = category.isin(*S.JUNK)
    looks = F.concat(F.lit("looks like "), category)
    return (
        F.when(category == "unreadable", answer("review", "could not be opened"))
        .when(junk & (F.size(protected) > 0), answer("review", F.concat(looks, F.lit(" but has "), F.array_join(protected, ", "))))
        .when(junk & camera_shape & (category != "screenshot"), answer("review", F.concat(looks, F.lit(" but has camera photo proportions"))))
        .when(junk & (photo > most_photo), answer("review", F.concat(F.lit("could also be a photo ("), S.percent(photo), F.lit(")"))))
        .when(junk & (confidence >= threshold), answer("reject", ""))
        .when(junk, answer("review", "low confidence"))
        .when(category == "document", answer("review", "documents may be important"))
        .otherwise(answer("keep", ""))
    )


def messenger_copy(distance: Column, original_area: Column, copy_area: Column) -> Column:
    return F.when((distance <= 4) & (original_area >= 0.9 * copy_area), "reject").otherwise("review")


def video_suggestion(n_frames: Column, is_copy: Column, suggested: Column, suggest_junk: bool = False) -> Column:
    """A model's rejection is only a review for videos, unless asked for."""
    model = suggested if suggest_junk else F.when(suggested == "reject", "review").otherwise(suggested)
    return F.when(n_frames == 0, "review").when(is_copy, "reject").when(suggested.isNotNull(), model).otherwise("keep")


def quarantine_outcome(keeper_same: Column, loser_same: Column, there: Column, there_same: Column, meta_there: Column, path: Column, moved: Column) -> Column:
    """What a planned move comes to, from the observed state of its files."""
    return (
        F.when(~keeper_same | ~loser_same, "ReviewRequired")
        .when(there & there_same, "AlreadyInQuarantine")
        .when(there | meta_there | S.has_wildcard(path), "ReviewRequired")
        .when(moved, "MovedMedia")
        .otherwise("QuarantineFailedRolledBack")
    )


def trash_status(is_media: Column, size: Column, in_library: Column, in_quarantine: Column) -> Column:
    return (
        F.when(~is_media, "NotMedia")
        .when((size > 0) & in_library, "InLibrary")
        .when((size > 0) & in_quarantine, "QuarantineOnly")
        .otherwise("TrashOnly")
    )


def reject_status(under_root: Column, actual: Column, expected: Column, copy_of: Column, copy_there: Column, copy_rejected: Column) -> Column:
    """(status, detail) of a file marked for removal. actual: its size now, null if gone."""
    answer = lambda s, d: F.struct(F.lit(s).alias("status"), F.lit(d).alias("detail"))
    named = F.coalesce(copy_of, F.lit("")) != ""
    return (
        F.when(~under_root, answer("Blocked", "Not under the root"))
        .when(actual.isNull(), answer("Missing", "File no longer exists"))
        .when(actual != expected, answer("Blocked", "File changed since it was classified"))
        .when(named & ~copy_there, answer("Blocked", "The better copy no longer exists"))
        .when(named & copy_rejected, answer("Blocked", "The better copy is also marked for removal"))
        .otherwise(answer("Ready", ""))
    )


def archive_status(entries: Column, ok: Column, missing: Column, missing_trash: Column) -> Column:
    return (
        F.when(entries == 0, "EMPTY ZIP")
        .when(ok == 0, "NOT EXTRACTED")
        .when((missing == 0) & (missing_trash == 0), "EXTRACTED")
        .when(missing == 0, "EXTRACTED (Trash removed)")
        .otherwise("PARTIAL")
    )


def backup_status(there_size: Column, size: Column, there_hash: Column, digest: Column) -> Column:
    return (
        F.when(there_size.isNull(), "MissingOnBackup")
        .when(there_size != size, "SizeDiffers")
        .when(~there_hash.eqNullSafe(digest), "HashDiffers")
        .otherwise("OK")
    )


def refile_destination(album: Column, stamp: Column, library: str = "Library") -> Column:
    """(dir, reason): the album's folder, else year and month, else Undated."""
    y, m = F.substring(stamp, 1, 4), F.substring(stamp, 6, 2)
    answer = lambda d, r: F.struct(F.concat_ws("/", F.lit(library), *d).alias("dir"), F.lit(r).alias("reason"))
    return (
        F.when(F.coalesce(album, F.lit("")) != "", answer([F.lit("Albums"), S.safe_folder(album)], "album"))
        .when(F.coalesce(stamp, F.lit("")) != "", answer([y, F.concat_ws("-", y, m)], "date"))
        .otherwise(answer([F.lit("Undated")], "undated"))
    )
